"""Boxes are read and ordered once for ground truth, detections and counts."""

import pytest

from boxloom.plans import load_registry


@pytest.mark.parametrize("name", ["eval_per_domain", "average_precision_by_domain", "ap50_101pt"])
def test_line_items_are_not_read_again(spark, name):
    plan = load_registry()[name].build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_partkey") == 0
