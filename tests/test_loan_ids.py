"""Loan ids by position: right whatever columns are kept and however AQE cuts the partitions."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanframe.operators.normalize import assign_loan_ids
from loanframe.session import ensure_checkpoint_dir
from loanframe.sources import fixtures

BIG = "/root/testdata/sf0.1"


@pytest.fixture(params=["64MB", "300KB"])
def sizes(spark, request):
    set_ = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": request.param,
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("order_col", ["ref", None])
def test_ids_are_positions(spark, sizes, order_col):
    raw = fixtures.raw_loans(spark, BIG).withColumnRenamed("loan_id", "ref")
    ids = assign_loan_ids(raw, order_col)
    assert set(ids.columns) == {*raw.columns, "loan_id"}
    n = raw.count()
    got = ids.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("loan_id").alias("ids"),
                  F.countDistinct("ref").alias("refs"), F.min("loan_id").alias("lo"), F.max("loan_id").alias("hi")).first()
    assert (got["rows"], got["ids"], got["refs"]) == (n, n, n)
    assert (got["lo"], got["hi"]) == ("LN-000001", f"LN-{n:06d}")
    if order_col:
        place = F.format_string("LN-%06d", F.row_number().over(Window.orderBy("ref")))
        assert ids.withColumn("want", place).where("want != loan_id").count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
