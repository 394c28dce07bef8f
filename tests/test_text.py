import random
import re

import pytest
from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions.checksums import luhn_valid, verhoeff_valid
from redactframe.operators import detect, redact


def one(rows, text, column):
    return rows([(text,)], "text string").select(column.alias("v")).first()[0]


@pytest.mark.parametrize("text,kind,expected", [
    ("Contact: user@example.com", "email_pii", True),
    ("Call: +91 98765 43210", "phone_pii", True),
    ("Phone: (555) 123-4567", "phone_pii", True),
    ("SSN: 524-68-1903", "ssn_pii", True),
    ("Card: 4532 0151 1283 0366", "card_pii", True),
    ("Card: 4532-0151-1283-0366", "card_pii", True),
    ("Aadhaar: 5432 8761 9023", "aadhaar_pii", True),
    ("Copyright 2020-2026. All rights reserved.", "phone_pii", False),
    ("PIN: 400001", "ssn_pii", False),
    ("Email: not-an-email", "email_pii", False),
])
def test_element_patterns(rows, text, kind, expected):
    hits = {r["type"] for r in detect.pii_elements(rows([(1, text)], "id long, text string"), ["id"]).collect()}
    assert (kind in hits) == expected


@pytest.mark.parametrize("number,ok", [
    ("4532015112830366", True), ("5425233430109903", True), ("1234567890123456", False), ("411111", False)])
def test_luhn(rows, number, ok):
    assert one(rows, number, luhn_valid(F.col("text"))) is ok


@pytest.mark.parametrize("number,ok", [("499118665246", True), ("499118665247", False), ("4991", False)])
def test_verhoeff(rows, number, ok):
    assert one(rows, number, verhoeff_valid(F.col("text"))) is ok


def test_span_offsets_against_python(spark):
    rng = random.Random(7)
    pieces = ["user@a.com", "524-68-1903", "9876543210", "2345 6789 0123", "ABCDE1234F", "+1 555 123 4567", "abé123-45-6789", " x ", "é", ",", "12"]
    texts = [(i, "".join(rng.choice(pieces) + rng.choice([" ", "", "; "]) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    got = {tuple(r) for r in detect.pii_spans(spark.createDataFrame(texts, "doc_id long, text string")).select(
        "doc_id", "entity_type", "span_text", "start", "end").collect()}
    want = {
        (i, e, m.group(), m.start(), m.end())
        for i, t in texts for e, p in rules.SPAN_PATTERNS for m in re.finditer(p, t, re.ASCII)
    }
    assert got == want


def test_overlapping_types(rows):
    got = {r["entity_type"] for r in detect.pii_spans(rows([(1, "call 9876543210 now")], "doc_id long, text string")).collect()}
    assert got == {"PHONE", "IN_MOBILE"}


def test_scrub_is_stable_and_complete(spark):
    texts = [(t,) for t in [
        "Aadhaar: 2345 6789 0123\nPAN: ABCDE1234F\nSkills: React", "pay rahul@oksbi or mail a@example.com", "MH12 12345678901",
        "acct 50100234567890 mobile 9876543210", "L1234567 passport", "nothing here"]]
    d = spark.createDataFrame(texts, "text string").select("text", redact.scrub_ids(F.col("text")).alias("once"))
    out = d.select("text", "once", redact.scrub_ids(F.col("once")).alias("twice"), detect.is_never_store_value(F.col("once")).alias("left")).collect()
    for r in out:
        assert r["once"] == r["twice"] and not r["left"]
    clean = {r["text"]: r["once"] for r in out}
    assert "9876543210" in clean[texts[3][0]] and "50100234567890" not in clean[texts[3][0]]
    assert clean[texts[1][0]] == "pay [REDACTED] or mail a@example.com"


def test_entity_redaction_matches_sequential_rule(spark):
    rng = random.Random(3)
    names = ["Asha", "asha rao", "Red", "ACT", "Pune", "une", "a.b", "x", "D]", "rao"]
    fields = [(p, i, " ".join(rng.choice(["Asha", "ASHA RAO", "pune", "a.b", "axb", "red", "form", "name"]) for _ in range(rng.randint(0, 4))))
              for p in range(6) for i in range(12)]
    entities = [(p, s, rng.choice(["PER", "ORG", "LOC", "MISC"]), rng.choice(names)) for p in range(6) for s in range(5)]
    got = {(r[0], r[1]): r["redacted_label"] for r in redact.redact_entities(
        spark.createDataFrame(fields, "page_id long, field_idx long, label string"),
        spark.createDataFrame(entities, "page_id long, seq long, entity_type string, text string")).collect()}
    for p, i, label in fields:
        done, out = set(), label
        for _, _, kind, t in sorted(e for e in entities if e[0] == p):
            if kind != "MISC" and len(t) >= 2 and t.lower() not in done:
                done.add(t.lower())
                out = re.sub(re.escape(t), "[REDACTED]", out, flags=re.IGNORECASE) if label else out
        assert got[(p, i)] == out


def test_release_view_has_no_address(rows):
    d = rows([(1, "#a", "l", "t", 2.0, 10.0, 10.0, "https://secret", "title")],
             "page_id long, selector string, label string, type string, dpr double, viewport_w double, viewport_h double, url string, title string")
    assert redact.release_view(d).columns == redact.RELEASE_COLUMNS


def test_excerpt_hides_images(rows):
    assert one(rows, "a  data:image/png;base64,AAAA+/= b", redact.safe_excerpt(F.col("text"))) == "a [image] b"


@pytest.mark.parametrize("value,shown", [("2345 6789 0123", "XXXX XXXX 0123"), ("12345", "12345")])
def test_mask(rows, value, shown):
    assert one(rows, value, redact.mask_id(F.col("text"))) == shown
