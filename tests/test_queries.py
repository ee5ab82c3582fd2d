"""Every named query against its SQL on the smallest tables."""

import pytest
from compare import compare

from broadsheet.plans import catalog

SF = "/root/testdata/sf0.001"
HEAVY = {"report_assignments", "merged_articles"}  # covered by test_duplicates


@pytest.mark.parametrize("name", sorted(set(catalog.PLANS) - HEAVY))
def test_query(spark, name):
    if name in catalog.CHECKS:
        problems, _ = compare(spark, SF, catalog.PLANS[name], catalog.CHECKS[name])
        assert not problems
    else:
        assert catalog.PLANS[name](spark, SF).columns
