"""Reports: edge cases and invariants (sums, bands, partition independence)."""

from pyspark.sql import functions as F

from loanframe.operators import reports as A
from loanframe.operators import scoring as S
from loanframe.operators import topk as T
from loanframe.plans.catalog import loans, scored_rules
from tests.conftest import SF_SMALL, rows

LOAN_DDL = ("loan_id string, geography string, credit_quality string, product_type string, loan_size bigint, "
            "credit_score bigint, pricing_rate double, default_indicator int, delinquency_status string, "
            "loan_status string, value_proxy double, default_prob double, early_warning_score double, "
            "spending_shock int, cohort string, cluster int, cashflow_consistency double, dti_ratio double")


def frame(spark, data):
    base = dict(loan_id="L", geography="Metro", credit_quality="A", product_type="BNPL", loan_size=100,
                credit_score=700, pricing_rate=10.0, default_indicator=0, delinquency_status="Current",
                loan_status="Active", value_proxy=1.0, default_prob=0.1, early_warning_score=10.0,
                spending_shock=0, cohort="C1", cluster=0, cashflow_consistency=0.5, dti_ratio=0.1)
    cols = [c.split()[0] for c in LOAN_DDL.split(", ")]
    return spark.createDataFrame([tuple({**base, **d}[c] for c in cols) for d in data], LOAN_DDL)


def test_empty_portfolio(spark):
    empty = frame(spark, []).where("false")
    assert A.portfolio_metrics(empty).count() == 0
    assert rows(A.ew_bands(empty)) == [(0, 0, 0, 0)]
    rd = A.risk_distribution(empty)
    assert rows(rd, "grade", "count") == [(g, 0) for g in ["AAA", "AA", "A", "BBB", "BB", "B", "CCC"]]
    assert A.segment_breakdown(empty, "geography").columns[0] == "segment"
    assert A.segment_breakdown(empty, "no_such_column").count() == 0


def test_band_edges(spark):
    ews = [0.0, 20.0, 39.9, 40.0, 60.0, 60.1, 80.0, 100.0]
    df = frame(spark, [dict(loan_id=f"L{i}", early_warning_score=e) for i, e in enumerate(ews)])
    assert rows(A.ew_bands(df), "high", "medium", "low") == [(3, 2, 3)]
    assert dict(rows(A.ew_buckets(df))) == {"0-20": 1, "20-40": 2, "40-60": 1, "60-80": 2, "80-100": 2}
    levels = dict(rows(S.with_risk_level(df), "early_warning_score", "risk_level"))
    assert levels[40.0] == "Low" and levels[60.0] == "Medium" and levels[60.1] == "High"


def test_no_active_falls_back_to_all(spark):
    df = frame(spark, [dict(loan_id=f"L{i}", loan_status="Default", early_warning_score=float(i)) for i in range(5)])
    assert A.active_or_all(df).count() == 5
    assert [r[0] for r in rows(T.early_warning_signals(df, 3), "loan_id")] == ["L4", "L3", "L2"]
    mixed = df.unionByName(frame(spark, [dict(loan_id="A1", loan_status="Active")]))
    assert rows(A.active_or_all(mixed), "loan_id") == [("A1",)]


def test_null_keys_and_ids(spark):
    df = frame(spark, [dict(geography=None), dict(geography="Metro", loan_id=None), dict(geography="Metro")])
    seg = A.segment_breakdown(df, "geography")
    assert rows(seg, "segment", "count") == [("Metro", 1)]


def test_aum_tie_breaks(spark):
    df = frame(spark, [dict(loan_id="1", product_type="X", loan_size=500, default_indicator=1),
                       dict(loan_id="2", product_type="Y", loan_size=900, default_indicator=1),
                       dict(loan_id="3", product_type="Z", loan_size=100),
                       dict(loan_id="4", product_type="W", loan_size=200)])
    bw = A.best_worst(df, "product_type").first()
    assert bw["best_segment"] == "W" and bw["worst_segment"] == "Y"
    roi = A.roi_best_worst(df).first()
    assert roi["best_product"] == "W" and roi["worst_product"] == "Y"


def test_watchlist_by_grade_is_whole(spark):
    data = [dict(loan_id=f"L{i:03d}", credit_quality="CCC" if i % 50 == 0 else "A", early_warning_score=float(i))
            for i in range(300)]
    df = frame(spark, data)
    got = [r[0] for r in rows(T.early_warning_by_grade(df, "CCC"), "loan_id")]
    assert got == ["L250", "L200", "L150", "L100", "L050", "L000"]
    got = [r[0] for r in rows(T.early_warning_by_grade(df, "CCC", depth=200), "loan_id")]
    assert got == ["L250", "L200", "L150", "L100"]  # by request: the book's first 200 only
    none = df.withColumn("loan_status", F.lit("Default"))
    assert len(rows(T.early_warning_by_grade(none, "CCC"))) == 6
    mixed = df.withColumn("loan_status", F.when(F.col("credit_quality") == "A", "Active").otherwise("Default"))
    assert rows(T.early_warning_by_grade(mixed, "CCC")) == []  # the book has Active loans, the grade has none


def test_invariants_on_fixture(spark):
    sc = scored_rules(spark, SF_SMALL)
    total = sc.count()
    for key in ["geography", "employment_type", "product_type", "acquisition_channel", "credit_quality"]:
        assert A.segment_breakdown(sc, key).agg(F.sum("count")).first()[0] == total
    b = A.ew_bands(sc).first()
    assert b["high"] + b["medium"] + b["low"] == total
    assert A.ew_buckets(sc).agg(F.sum("count")).first()[0] == total
    assert A.risk_distribution(sc).agg(F.sum("count")).first()[0] == total
    lims = sc.agg(F.min("default_prob"), F.max("default_prob"), F.min("early_warning_score"),
                  F.max("early_warning_score")).first()
    assert 0 <= lims[0] <= lims[1] <= 1 and 0 <= lims[2] <= lims[3] <= 100
    assert A.cohort_analysis(sc).agg(F.sum("loans")).first()[0] == total


def test_partition_independence(spark):
    base = loans(spark, SF_SMALL)
    a = rows(A.portfolio_metrics(S.score_rules(base)))
    b = rows(A.portfolio_metrics(S.score_rules(base.repartition(13, "loan_id"))))
    c = rows(A.cohort_analysis(S.score_rules(base.repartition(3))))
    d = rows(A.cohort_analysis(S.score_rules(base.coalesce(1))))
    assert a == b and sorted(c) == sorted(d)


def test_auc_handles_one_class(spark):
    df = frame(spark, [dict(loan_id=str(i), default_prob=i / 10) for i in range(5)])
    assert rows(A.auc(df, "default_prob")) == [(0.0,)]
    df2 = frame(spark, [dict(loan_id="a", default_prob=0.9, default_indicator=1),
                        dict(loan_id="b", default_prob=0.1, default_indicator=0),
                        dict(loan_id="c", default_prob=0.5, default_indicator=1),
                        dict(loan_id="d", default_prob=0.5, default_indicator=0)])
    assert rows(A.auc(df2, "default_prob")) == [(0.875,)]


def test_grade_spine_ignores_off_ladder_grades(spark):
    """Keys off the 7-grade ladder never widen the dense reports (the
    broadcast aggregate is cut to the spine's keys)."""
    df = frame(spark, [dict(loan_id="1", credit_quality="A", loan_size=100),
                       dict(loan_id="2", credit_quality="ZZZ", loan_size=900),
                       dict(loan_id="3", credit_quality=None, loan_size=50)])
    rd = rows(A.risk_distribution(df), "grade", "count", "aum")
    assert [g for g, _, _ in rd] == ["AAA", "AA", "A", "BBB", "BB", "B", "CCC"]
    assert dict((g, (n, a)) for g, n, a in rd)["A"] == (1, 100)
    assert sum(n for _, n, _ in rd) == 1
    assert rows(A.grade_tiers(df), "tier", "count") == [("Investment", 1), ("Speculative", 0), ("Distressed", 0)]
    assert len(rows(A.pricing_by_grade(df))) == 7


def test_sums_are_truncated_once(spark):
    df = frame(spark, [dict(loan_id=str(i), pricing_rate=r) for i, r in enumerate([10.125, 10.125, 10.125, 12345678.9])])
    df = df.withColumns({"loan_size": F.lit(100.75),
                         "credit_score": F.when(F.col("loan_id") == "3", 701.9).otherwise(F.lit(700.9))})
    m = A.portfolio_metrics(df).first()
    assert (m["totalDisbursed"], m["avgTicketSize"], m["avgCreditScore"]) == (403, 100, 701)
    assert m["avgPricing"] == round((3 * 10.125 + 12345678.9) / 4, 2)
    seg = A.pricing_report(df).where("dimension = 'products'").first()
    assert (seg["totalDisbursed"], seg["avgScore"]) == (403, 701)


def test_auc_of_billions_of_loans(spark):
    """The counted pairs of 20 billion loans are exact, no overflow."""
    many = 10_000_000_000
    df = spark.createDataFrame([(0.2, many // 10, many), (0.6, many, many // 10)], "s double, pos long, neg long")
    got = A.auc_of_counts(df).first()["auc"]
    assert got == round((many / 10 * many / 2 + many * many + many * many / 20) / (1.1 * many) ** 2, 4)


def test_reports_without_their_key_are_empty(spark):
    df = frame(spark, [dict(loan_id="1")])
    for report, key in ((A.cohort_analysis, "cohort"), (A.cluster_profiles, "cluster")):
        none = report(df.drop(key))
        assert none.collect() == []
        if key in df.columns:
            assert none.columns == report(df).columns
