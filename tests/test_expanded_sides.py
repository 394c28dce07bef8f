"""Sides that a join expands, or that one key too many users fill, are shuffled, whatever size the planner reckons."""

from __future__ import annotations

import re

import pytest

from redactframe.functions.contains import contains_join
from redactframe.operators import boxes, detect, matching

ENTRIES = "user_id long, key string, value string, key_order long"


@pytest.fixture
def stored(spark, tmp_path):
    """Small tables in files, which the planner likes to broadcast."""
    def make(rows, schema):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_gram_join_is_not_broadcast(stored):
    hays = stored([(1, "Asha Rao"), (2, "none")], "k long, hay string")
    needles = stored([(1, "Rao"), (2, "Rao")], "k long, needle string")
    met = contains_join(hays, needles, ["k"], "hay", "needle")
    assert "Broadcast" not in _plan(met)
    assert [tuple(r) for r in met.collect()] == [(1, "Asha Rao", "Rao")]


def test_box_cells_are_not_broadcast(stored):
    rows = [(1, i, float(x), 0.0, float(x) + 10, 10.0) for i, x in enumerate((0, 2, 40))]
    pairs = boxes.iou_pairs(stored(rows, "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double"), 0.1)
    assert "Broadcast" not in _plan(pairs)
    assert [(r["box_a"], r["box_b"]) for r in pairs.collect()] == [(0, 1)]


def test_backfill_shuffles_grams(stored):
    spans = stored([(1, 7, "Rao"), (1, 8, "zz")], "page_id long, span_id long, span_text string")
    nodes = stored([(1, 3, "Asha Rao", 1.0, 2.0)], "page_id long, node_idx long, text string, x double, y double")
    out = detect.backfill_boxes(spans, nodes)
    assert re.search(r"SortMergeJoin \[page_id#\d+L, __gram", _plan(out))
    assert {r["span_id"]: r["node_idx"] for r in out.collect()} == {7: 3, 8: None}


@pytest.mark.parametrize("names", [True, False])
def test_profile_entries_are_not_broadcast(stored, names):
    asked = stored([(1, "Full name *"), (1, "email")], "user_id long, wanted string")
    entries = stored([(1, "Full Name", "Asha", 1), (1, "email", "a@b.c", 2)], ENTRIES)
    out = matching.match_keys(asked, entries, names)
    assert "Broadcast" not in _plan(out)
    assert {(r["wanted"], r["key"]) for r in out.collect()} == {("Full name *", "Full Name"), ("email", "email")}
