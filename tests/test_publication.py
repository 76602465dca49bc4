"""publication_problem on a table too large to broadcast by its size: what moves, and the same rows either way."""

import re

import pytest

from citewell.operators import registry
from citewell.plans import inventory


def test_lines_move_as_numbers_and_meet_their_sources_in_place(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables beyond the threshold are planned
    try:
        found = inventory.publication_problems(spark, sf)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    met = [x for x in plan.splitlines() if re.search(r"Join \[source_id#\d+\], \[source_id#\d+\], LeftOuter", x)]  # chunks with sources
    assert len(met) == 1 and "BroadcastHashJoin" in met[0]
    assert "keys=[id#" not in plan  # lines are distinct by numbers, not by their text


@pytest.mark.parametrize("most", [0, 10**6])
def test_rows_do_not_depend_on_how_sources_are_met(spark, sf, duck, monkeypatch, most):
    monkeypatch.setattr(registry, "BROADCAST_SOURCES", most)
    for name in ("publication_problems", "pinned_evidence", "introduction_queue"):
        rows = sorted(map(tuple, inventory.QUERIES[name](spark, sf).collect()), key=str)
        assert rows == sorted(duck.execute(inventory.ORACLES[name]).fetchall(), key=str)
