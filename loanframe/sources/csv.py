"""CSV source and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import materialize

_EXTRA = "_beyond_the_header"
MAX_FILE_ROWS = 50_000


def _headers(spark: SparkSession, path: str, multi_line: bool) -> list[str]:
    """Column names as the file spells them, repeats included (one row is read)."""
    first = spark.read.option("header", False).option("multiLine", multi_line).csv(path).first()
    if first is None:
        raise ValueError(f"no rows in {path}")
    names = [n or f"column_{i}" for i, n in enumerate(first)]
    names[0] = names[0].removeprefix("\ufeff")
    return names


def _scan(spark: SparkSession, path: str, multi_line: bool) -> tuple[DataFrame, list[str]]:
    """(the lazy table with columns _c0, _c1, ... and what stands beyond the header, the header)."""
    names = _headers(spark, path, multi_line)
    places = [f"_c{i}" for i in range(len(names))]
    schema = ", ".join(f"`{c}` string" for c in [*places, _EXTRA])
    raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
           .option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path))
    tokens = F.array(*[F.lit(t) for t in K.CSV_NULL_TOKENS])
    return raw.select(*[F.when(~F.array_contains(tokens, F.col(c)), F.col(c)).alias(c) for c in places], _EXTRA), names


def _checked(kept: DataFrame, names: list[str], path: str, check_empty: bool, on_ragged: str) -> DataFrame:
    """The written table without its check column, which is read alone. (``DataFrame.observe`` would tell the same during
    the write, but a session that has observed a metric can't serialise fitted MLlib models with a summary any more.)"""
    bad = kept.where(F.col(_EXTRA).isNotNull()).select(_EXTRA).take(3) if on_ragged == "error" else []
    if bad:
        raise ValueError(f"rows with more than {len(names)} fields in {path}, e.g. followed by {[r[0] for r in bad]}")
    if check_empty and kept.isEmpty():
        raise ValueError(f"no rows in {path}")
    return kept.drop(_EXTRA)


def read_loans_csv(spark: SparkSession, path: str, check_empty: bool = True, multi_line: bool = False,
                   on_ragged: str = "error") -> DataFrame:
    """Header CSV read as all strings (no schema inference pass); the
    usual missing-value spellings become NULL. An empty file is an error.

    The file is scanned once: its rows are written to the shared folder,
    checked and read there. Headers are kept as written: a repeated header
    gives two columns of that name, which the normaliser merges.
    ``multi_line`` reads quoted line breaks (a file is then one split). Rows
    with more fields than headers are an error, or with ``on_ragged="keep"``
    are kept without the surplus; rows with fewer are filled with NULL.
    """
    table, names = _scan(spark, path, multi_line)
    return _checked(materialize(table, "upload-rows"), names, path, check_empty, on_ragged).toDF(*names)


def read_loans_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The normalised loans of a CSV upload: one scan of the file and one write of the result, checked."""
    from ..operators.normalize import normalize_loans

    table, names = _scan(spark, path, multi_line)
    kept = materialize(normalize_loans(table.toDF(*names, _EXTRA)), "upload")
    return _checked(kept, names, path, True, "error")


def upload(spark: SparkSession, path: str, multi_line: bool = False) -> dict:
    """A whole upload in one call: the file read, normalised and, if it has rows enough, fitted.

    Gives the file's columns, the normalised table and its columns, the load summary
    and the fitted models with their report."""
    from ..models.bundle import LoanModels, train_report
    from ..operators.reports import load_summary

    columns = _headers(spark, path, multi_line)
    table = read_loans_table(spark, path, multi_line)
    models = LoanModels.fit(table)
    return {"columns": columns, "normalized_columns": table.columns, "table": table,
            "summary": load_summary(table), "models": models, "train_info": train_report(spark, models)}


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write a report as records (JSON lines by default, or parquet/csv).

    The write keeps the plan's own partitioning: an aggregate report comes
    out of AQE's partition coalescing as one or a few files, while a
    loan-level frame (scored loans, a full watch-list) is still written by
    many tasks instead of being funnelled through one."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_loans_csv(df: DataFrame, path: str, mode: str = "overwrite", max_rows: int = MAX_FILE_ROWS) -> None:
    """Write a loan table as header CSV: one file per partition, or more where a partition has over ``max_rows`` rows.

    A file with quoted line breaks is read by one task, so the rows of a file bound that task."""
    df.write.mode(mode).option("header", True).option("maxRecordsPerFile", max_rows).csv(path)
