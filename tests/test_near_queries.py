import pytest

import __spark_entry__ as entry_module
from tallgrass.operators import matching

QUERIES = ["verdict_clusters", "dedup_clusters", "dedup_score_spread", "dedup_weakest_link", "verdict_findings", "cluster_members", "assessment"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_pair_of_a_block_is_written_out_before_it_is_scored(spark, small, monkeypatch, name):
    monkeypatch.setattr(matching, "_scored", lambda *a: pytest.fail("pairs were written out before they were scored"))
    entry_module.queries()[name](spark, small).collect()
