"""Rows that a shape expands are dealt out, however few splits their file has."""

from __future__ import annotations

import pytest

from redactframe.sources.shapes import SHAPES
from redactframe.sources.tables import derived

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["form_pages", "form_fields", "profile_texts", "token_predictions"])
def test_derived_rows_are_dealt_out(spark, name):
    rows = derived(spark, SMALL, name)
    parts = rows.rdd.glom().map(len).collect()
    assert sum(n > 0 for n in parts) > 1
    assert sum(parts) == spark.read.parquet(f"{SMALL}/{SHAPES[name].base}.parquet").count()
