"""Policy rows, CSV source/sinks, streaming scoring."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from loanframe.operators import policy as P
from loanframe.operators import scoring as S
from loanframe.plans.catalog import loans, scored_rules
from loanframe.operators.normalize import normalize_loans
from loanframe.sources.csv import read_loans_csv, read_loans_table, upload, write_loans_csv, write_report
from loanframe.streaming.scoring import read_loan_stream, run_available_now, score_stream
from tests.conftest import SF_SMALL, rows


def test_policy_rows(spark):
    recs = P.policy_recommendations(scored_rules(spark, SF_SMALL)).collect()
    assert [r["rank"] for r in recs] == [1, 2, 3, 4, 5, 6]
    assert [r["title"] for r in recs] == [title for title, _ in P.RECOMMENDATIONS]
    assert recs[0]["body"].startswith("Portfolio of 1,500 loans")
    assert recs[2]["type"] == "warning" and recs[4]["type"] == "success"
    memo = P.policy_memo(scored_rules(spark, SF_SMALL)).collect()
    assert [r["title"] for r in memo] == [title for title, _ in P.MEMO]


def test_policy_empty(spark):
    empty = scored_rules(spark, SF_SMALL).where("false")
    assert P.policy_recommendations(empty).count() == 0


def test_csv_null_tokens_and_empty(spark):
    d = tempfile.mkdtemp(prefix="lf-csv-")
    p = os.path.join(d, "a.csv")
    with open(p, "w") as f:
        f.write("loan_amount,dpd\n100,NA\n,null\n300,45\n")
    df = read_loans_csv(spark, p)
    assert rows(df) == [("100", None), (None, None), ("300", "45")]
    e = os.path.join(d, "empty.csv")
    with open(e, "w") as f:
        f.write("loan_amount,dpd\n")
    with pytest.raises(ValueError):
        read_loans_csv(spark, e)


def test_write_report_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="lf-rep-")
    from loanframe.operators import reports as A
    rep = A.segment_breakdown(scored_rules(spark, SF_SMALL), "geography")
    write_report(rep, os.path.join(d, "seg"))
    back = spark.read.json(os.path.join(d, "seg"))
    assert back.count() == rep.count()


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="lf-stream-")
    src = loans(spark, SF_SMALL)
    src.write.parquet(os.path.join(d, "in"))
    out = run_available_now(score_stream(read_loan_stream(spark, os.path.join(d, "in"), src.schema,
                                                          max_files_per_trigger=1)),
                            os.path.join(d, "out"), os.path.join(d, "ckpt"))
    got = spark.read.parquet(out)
    want = S.score_rules(src)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def _file(tmp_path, text):
    (tmp_path / "up.csv").write_text(text, encoding="utf-8")
    return str(tmp_path / "up.csv")


def test_csv_repeated_headers_are_merged(spark, tmp_path):
    raw = read_loans_csv(spark, _file(tmp_path, "amount,amount,region\n,250.5,Metro\n100,7,Rural\n"))
    assert raw.columns == ["amount", "amount", "region"]
    assert sorted(r["loan_size"] for r in normalize_loans(raw).collect()) == [100.0, 250.5]


def test_csv_quoted_line_breaks(spark, tmp_path):
    path = _file(tmp_path, 'loan_id,note\nL1,"one\ntwo"\nL2,three\n')
    assert rows(read_loans_csv(spark, path, multi_line=True)) == [("L1", "one\ntwo"), ("L2", "three")]


def test_csv_ragged_rows(spark, tmp_path):
    path = _file(tmp_path, "loan_id,region\nL1,Metro,surplus\nL2\n")
    with pytest.raises(ValueError, match="more than 2 fields"):
        read_loans_csv(spark, path)
    assert rows(read_loans_csv(spark, path, on_ragged="keep")) == [("L1", "Metro"), ("L2", None)]


def test_unicode_spaces_are_stripped(spark, tmp_path):
    raw = read_loans_csv(spark, _file(tmp_path, "loan_id,region\nL1,Metro\u00a0\nL2,\u2003rural\u3000\n"))
    assert sorted(r["geography"] for r in normalize_loans(raw).collect()) == ["Metro", "Rural"]


def test_upload_in_one_call(spark, tmp_path):
    from loanframe.plans.catalog import raw_loans
    write_loans_csv(raw_loans(spark, SF_SMALL).limit(300), str(tmp_path / "up"))
    got = upload(spark, str(tmp_path / "up"))
    assert got["columns"][0] == "loan_id" and "value_proxy" in got["normalized_columns"]
    assert got["summary"].first()["total_loans"] == 300 == got["train_info"].first()["n_samples"]


def test_upload_is_one_scan(spark, tmp_path, monkeypatch):
    """Every row passes the normaliser once: emptiness and ragged rows are told from the written table."""
    import loanframe.operators.normalize as normalize
    reads, plain = spark.sparkContext.accumulator(0), normalize.normalize_loans

    def counted(table):
        @F.udf("string", useArrow=False)
        def seen(x):
            reads.add(1)
            return x
        return plain(table).withColumn("seen", seen("loan_id"))

    monkeypatch.setattr(normalize, "normalize_loans", counted)
    kept = read_loans_table(spark, _file(tmp_path, "loan_id,region\n" + "".join(f"L{i},Metro\n" for i in range(50))))
    assert kept.count() == 50 == reads.value and kept.columns[-1] == "seen"


def test_checks_are_made_on_the_written_table(spark, tmp_path):
    path = _file(tmp_path, "loan_id,region\nL1,Metro,surplus\nL2\n")
    with pytest.raises(ValueError, match="more than 2 fields"):
        read_loans_table(spark, path)
    with pytest.raises(ValueError, match="no rows"):
        read_loans_table(spark, _file(tmp_path, "loan_id,region\n"))


def test_an_upload_with_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    """A file with quoted line breaks is one split, so the writer bounds the rows of a file."""
    from loanframe.sources import csv
    path = str(tmp_path / "upload")
    rows = spark.range(csv.MAX_FILE_ROWS * 2 + 7, numPartitions=1).selectExpr("id", "concat('first\n', id) as note")
    csv.write_loans_csv(rows, path)
    assert len(list((tmp_path / "upload").glob("*.csv"))) == 3
    back = csv.read_loans_csv(spark, path, multi_line=True)
    assert back.exceptAll(rows.selectExpr("cast(id as string) id", "note")).isEmpty() and back.count() == rows.count()
