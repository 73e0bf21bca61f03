"""Pairs of near copies are found inside cells, whatever the cut into cells and runs."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup as D


@pytest.mark.parametrize(("block", "entries", "meetings"), [(65536, 96, 1 << 21), (4, 96, 64)])
def test_meetings_stay_inside_a_cell(spark, monkeypatch, block, entries, meetings):
    """60 items share one head term: 1,770 meetings, of which no row leaves a task but the pairs that can be near."""
    for name, v in (("BLOCK", block), ("ENTRIES", entries), ("MEETINGS", meetings)):
        monkeypatch.setattr(D, name, v)
    n = 60
    near = [(10, 11), (10, 50), (3, 59)]
    rows = [(i, "hub", 0.3, 0.7) for i in range(n)] + [(i, f"own{i}-{k}", 0.3, 0.7) for i in range(n) for k in range(4)]
    rows += [(i, f"pair{p}", 0.7, 0.7) for p, ij in enumerate(near) for i in ij]
    lists = spark.createDataFrame(rows, "ord long, term string, w double, s double").withColumn("s", F.lit(0.5))
    got = D.candidates(lists, lists, 0.85)
    assert sorted((r.lo, r.hi) for r in got.collect()) == sorted(near)
    early, late = lists.where("ord <= 10"), lists.where("ord > 10")
    assert sorted((r.lo, r.hi) for r in D.candidates(early, late, 0.85).collect()) == sorted(near)
    x, y = (D.in_cells(d, 1, True, False) for d in (early, late))
    assert x.count() == early.select("ord").distinct().count() and y.columns == ["i", "j", "ord", "s", "terms", "ws"]
