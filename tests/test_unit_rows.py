"""Fields of a unit are gathered by one aggregation, not by windows over all nodes of a body."""

import re

from test_plans import plan

from chronolex import catalog


def test_fields_are_grouped(spark, sf_dir):
    text = plan(catalog.queries()["flat_subitem_regroup"](spark, sf_dir))
    windows = re.findall(r"\(\d+\) Window\n.*?Arguments: (.*?)\n", text, re.S)
    assert windows and not any("owner" in w for w in windows)
