"""Plan checks: no query may plan a cartesian product, a nested-loop join or a window over one partition."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF

# the linkers, lookup, negation and coverage are the operators that could fall back to pair enumeration
NAMES = ["q_l1_lookup_candidates", "q_p1_lookup", "q_x4_scope_attributes", "q_f2_link_levenshtein",
         "q_f3_link_jaro_winkler", "q_f4_link_token_sort", "q_f5_link_token_set", "q_b3_link_bm25", "q_d5_cosine_top10",
         "q_d5_balls_top10", "q_r1_coverage_gaps", "q_x3_overlap_pairs", "q_n5_merge_max", "q_t7_build_chunks", "q_t2_original_offsets",
         "q_s3_read_gazetteer"]


@pytest.mark.parametrize("name", NAMES)
def test_no_pair_enumeration(spark, monkeypatch, name):
    plans = []
    old = type(spark.range(0)).checkpoint
    # tables written on the way were planned too
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self, *a, **k: plans.append(self) or old(self, *a, **k))
    plans.append(E.queries()[name](spark, SF))
    plan = "\n".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "SinglePartition" in line:
            depth = line.index("Exchange")
            above = [x for x in lines[max(0, at - 4):at] if " Window " in x and x.index("Window") < depth]
            assert not above, above
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
