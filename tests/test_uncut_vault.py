import random

import duckdb
import pytest

import __spark_entry__
from redactframe.functions.text import capitals
from redactframe.operators import documents as D


def test_claims_meet_every_text_of_their_owner(spark, rows):
    """Texts beyond the newest five and beyond 256 KB; short, long and absent needles, and another owner's text."""
    end = "a sentence at the very end of a long text"
    texts = [(1, i, i, f"Filler number {i}") for i in range(10, 30)] + [(1, 1, 1, "the OLD passage"), (1, 2, 2, "x " * 200_000 + end), (2, 3, 3, "other owner"), (2, 4, 4, None), (2, 5, 5, "")]
    vault = rows(texts, "owner_id long, doc_id long, extracted_at long, text string")
    values = [(1, 1, " old "), (2, 1, end.upper()), (3, 1, "other"), (4, 2, "other owner"), (5, 2, "old"), (6, 1, "x"), (7, 1, None), (8, 1, "at the very end of a long tale"), (9, 3, "old")]
    claims = rows(values, "claim_id long, owner_id long, value string")
    assert sorted(r["claim_id"] for r in D.vault_contains_all(claims, vault).collect()) == [1, 2, 4]
    assert [r["claim_id"] for r in D.vault_contains(claims, D.vault_retention(vault)).collect()] == [4]
    assert D.vault_contains_all(claims.limit(0), vault).count() == 0


def _found(spark, rows, texts, claims, first_bytes=16):
    from redactframe.functions.contains import found_in_long

    hays = rows(texts, "owner_id long, text string")
    asked = rows(claims, "owner_id long, needle string")
    return {tuple(r) for r in found_in_long(hays, asked, ["owner_id"], "text", "needle", first_bytes).select("owner_id", "needle").collect()}


def test_search_against_brute_force(spark, rows):
    """Needles of all lengths, in several letters, cut from texts or nearly so."""
    rng = random.Random(7)
    words = ["alpha", "ß", "é", "你好", "😀", "beta", "a", "zz", " ", "x" * 30]
    texts = [(rng.randrange(4), " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for _ in range(60)] + [(1, None), (1, ""), (None, "alpha beta")]
    needles = []
    for owner, text in texts:
        for _ in range(8):
            a = rng.randrange(len(text or "x"))
            cut = (text or "")[a:a + rng.choice([1, 2, 3, 7, 15, 16, 17, 40, 300])]
            needles.append((rng.choice([owner, 0, 3]), cut if rng.random() < 0.7 else cut + "!"))
    needles += [(0, None), (None, "alpha"), (0, "")]
    want = {(o, n) for o, n in needles if n and o is not None and any(p == o and n in (t or "") for p, t in texts)}
    for first_bytes in (1, 16):
        assert _found(spark, rows, texts, needles, first_bytes) == want
    assert len(want) > 100


def test_one_long_claim_moves_little(spark, rows):
    """With a claim of 2,000 characters, what is shuffled stays far below the texts, and one owner's texts stay where they are."""
    rng = random.Random(3)
    body = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)) for _ in range(40)]
    texts = [(1, b) for b in body]
    claims = [(1, body[17][5000:7000]), (1, body[3][100:2100] + "!"), (1, "abc"), (1, body[39][-30:])]
    assert _found(spark, rows, texts, claims) == {claims[0], claims[2], claims[3]}
    from redactframe.functions.contains import found_in_long

    plan = found_in_long(rows(texts, "owner_id long, text string"), rows(claims, "owner_id long, needle string"), ["owner_id"], "text", "needle")
    # rows leave the scan as matched needles only: nothing explodes texts into places or slices
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1 and "Generate" not in text


def test_spans_are_handed_on_once_a_task():
    """The same texts again and again: what was handed on before is not new, and no key is lost."""
    import numpy as np

    from redactframe.functions.spans import Recent

    rng = np.random.default_rng(2)
    keys = np.append(rng.integers(0, 2**64, 5000, dtype=np.uint64), np.arange(300, dtype=np.uint64))
    recent = Recent(1 << 20)
    assert recent.new(keys).all() or len(np.unique(keys & recent.last)) < len(keys)
    again = recent.new(keys)
    assert again.sum() < 200  # those that another key of their cell replaced
    few = Recent(4)
    for key in (0, 1, 2, 3, 4, 0):
        assert few.new(np.array([key], np.uint64))[0]
    assert not few.new(np.array([0], np.uint64))[0]


def test_capitals_are_those_of_sql(rows):
    letters = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    letters = [x for x in letters if x.upper() != x or x.title() != x or x.lower() != x]
    text = "".join(letters)
    want = duckdb.execute("SELECT upper(?)", [text]).fetchone()[0]
    assert rows([(text,)], "t string").select(capitals("t")).first()[0] == want


@pytest.mark.parametrize("name", ["vault_contains", "vault_contains_all"])
def test_claims_are_in_capitals_of_all_letters(spark, rows, tmp_path, name):
    """Claims are capitals of every letter, not of A to Z alone; the SQL makes the same."""
    docs = [(1, "  größe é ñandú", "s"), (2, "x. straße été", "s"), (4, "....ﬁne ŉa ʼn", "s"), (5, "abcdefgßß", "t"), (7, None, "t"), (None, "éé", "t"), (6, "x y", "s")]
    rows(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["claim_id"], r["owner_id"], r["value"]) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == set(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert {v for _, _, v in got} >= {" GRÖẞ", "FGẞẞ"}
