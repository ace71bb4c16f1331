"""R8 by a loaded bundle scores in all cores, whatever the splits of the files."""

from loanframe.plans.catalog import PLANS
from tests.conftest import SF_SMALL


def test_applications_are_dealt_to_all_cores_before_a_loaded_bundle_scores_them(spark):
    loaded, fitted = PLANS["predict_loans_reloaded"](spark, SF_SMALL), PLANS["predict_loans"](spark, SF_SMALL)
    for out in (loaded, fitted):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression")
    assert loaded.count() == fitted.count()
