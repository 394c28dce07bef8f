import pytest

from redactframe.operators import redact


def replaced(label, needles):
    """Each distinct needle in turn, ignoring case."""
    import re

    for n in needles:
        label = re.sub(re.escape(n), "[REDACTED]", label, flags=re.I)
    return label


@pytest.mark.parametrize("few", [256, 2])
def test_labels_meet_the_needles_of_their_page(spark, rows, monkeypatch, few):
    """By lists, and by grams where a page has many needles: needles in the label, in the marker and across it; pages without any."""
    monkeypatch.setattr(redact, "FEW_NEEDLES", few)
    given = {1: ["Asha", "Rao", "red", "d] x"], 2: ["a.b"], 3: [], None: ["Asha"]}
    labels = ["Asha Rao", "asha x", "red line", "none", "a.b axb", "", None]
    fields = rows([(p, i, t) for p in given for i, t in enumerate(labels)], "page_id long, field_idx long, label string")
    entities = rows([(p, i, "PER", f" {n} ") for p in given for i, n in enumerate(given[p])], "page_id long, seq long, entity_type string, text string")
    found = redact.redact_entities(fields, entities).collect()
    want = [(p, i, t, t and replaced(t, given[p] if p else [])) for p in given for i, t in enumerate(labels)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_labels_are_not_shuffled_by_gram(spark, rows):
    fields = rows([(1, 0, "Asha Rao")], "page_id long, field_idx long, label string")
    entities = rows([(1, 0, "PER", "Rao")], "page_id long, seq long, entity_type string, text string")
    plan = redact.redact_entities(fields, entities)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
