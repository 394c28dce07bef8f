from pathlib import Path

import brute
import pytest

import corpus_pipeline as P

SMALL = "/root/testdata/sf0.001"
SHARED = "this license line stands in very many of the documents here"
BASE = " ".join(f"the thing{i} of and with" for i in range(60))
DOCS = [
    (1, BASE, "en"), (2, BASE, "en"), (3, BASE.upper(), None), (None, BASE, "en"), (4, None, "en"), (5, "", "en"), (6, "12 !! 34", "en"),
    *[(20 + i, f"{SHARED}\nthe text of and in number {i} " + " ".join(f"the word{i * j} of" for j in range(40)), "en") for i in range(6)],
    (40, "the and of that with this from " * 30, "en"), (40, "the and of that with this from " * 30, "en"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string"


@pytest.fixture
def docs(rows):
    return rows([(d, t, g, "s", len(t or ""), "extra") for d, t, g in DOCS], COLUMNS)


def texts(df):
    return sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)


def near_roots(texts):
    """Component of each place: equal sets of 5-word shingles, and pairs of Jaccard similarity 0.8 or more."""
    sets = [brute.shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0]
    return brute.components(pairs, range(len(texts)))


def test_language_stage_rejects_only_texts_without_language(spark, docs):
    out = P.language_id(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert texts(out) == sorted([(d, t) for d, t, _ in DOCS if d not in (4, 5, 6)], key=str)


def test_language_stage_rejects_unlearned_scripts(spark, rows):
    """On the given table and some texts in other scripts: those go, all else stays, clashing names too."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", "doc_id AS __letter", "'x' AS __lang", "text AS __score")
    odd = ["Привет, как дела? Сегодня хорошая погода и мы идем гулять в парк.", "今日はとても良い天気ですね。公園に行きましょう。", "დღეს კარგი ამინდია და ჩვენ პარკში მივდივართ"]
    more = rows([(10_000 + i, t, "en", "s", len(t), i, "x", t) for i, t in enumerate(odd)], docs.schema)
    out = P.language_id(spark, docs.unionByName(more), SMALL)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_found_language_goes_on_to_the_pieces(spark, rows):
    """The stage gives the language that the model finds, not the given one, and the packed pieces have it."""
    words = {"en": "the of and with this that from have", "de": "der und nicht eine wird auch über größe"}
    text = lambda lang, i: " ".join(f"{w} {words[lang].split()[i % 8]}" for w in words[lang].split())
    known = [(i, text(lang, i // 2), lang, "s", 1, "") for i in range(80) for lang in [("en", "de")[i % 2]]]
    odd = [(100, text("de", 3), None, "s", 1, ""), (101, text("en", 3), "und", "s", 1, ""), (None, text("de", 4), "en", "s", 1, ""), (103, " ".join([text("de", 5)] * 50), None, "s", 1, "")]
    want = {100: "de", 101: "en", None: "de", 103: "de"}
    out = P.language_id(spark, rows(known + odd, COLUMNS), SMALL)
    assert {r["doc_id"]: r["lang"] for r in out.collect() if r["doc_id"] in want} == want
    assert {r["doc_id"]: r["lang"] for r in out.collect() if r["doc_id"] not in want} == {i: lang for i, _, lang, *_ in known}
    placed = P.pack_sequences(spark, out, SMALL).collect()
    assert {(r["doc_id"], r["lang"]) for r in placed if r["doc_id"] in want} == set(want.items())
    assert [(r["piece"], r["lang"]) for r in sorted(placed, key=lambda r: r["piece"]) if r["doc_id"] == 103] == [(0, "de"), (1, "de")]


def test_line_stage(spark, docs):
    out = P.dedup_lines(spark, docs, SMALL)
    assert out.columns == docs.columns
    want = [(d, t) for d, _, _, t in brute.dedup_lines([(d, t) for d, t, _ in DOCS])]
    assert texts(out) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_near_dedup_stage(spark, docs):
    out = P.near_dedup(spark, docs, SMALL)
    named = [(d, t) for d, t, _ in DOCS if d is not None]
    root = near_roots([t for _, t in named])
    heads = {min(named[j][0] for j in range(len(named)) if root[j] == root[i]) for i in range(len(named))}
    assert out.columns == docs.columns
    assert sorted([r["doc_id"] for r in out.collect()], key=str) == sorted([*heads, None], key=str)


def test_benchmark_stage(spark, rows):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = rows([(1, f"before {item} after", "en", "s", 1, ""), (2, "clean text", "en", "s", 1, ""), (3, None, None, None, None, None)], COLUMNS)
    out = P.remove_benchmarks(spark, docs, SMALL)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3]


def test_empty_tables_pass(spark, docs):
    state = docs.limit(0)
    for _, stage in P.STAGES:
        state = stage(spark, state, SMALL)
        assert state.count() == 0


def test_run_follows_the_stages(spark):
    """On the given table: what run() packs is what brute force keeps after the language stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in P.language_id(spark, docs, SMALL).collect()]
    assert len(kept) >= 0.98 * docs.count()
    kept = [(d, t) for d, _, _, t in brute.dedup_lines(kept)]
    root = near_roots([t for _, t in kept])
    first = {}
    for i, (d, _) in enumerate(kept):
        first[root[i]] = min(d, first.get(root[i], d))
    kept = [(d, t) for i, (d, t) in enumerate(kept) if first[root[i]] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {d for d, _, hit, _ in brute.contaminated(kept, items) if not hit}
    assert {r["doc_id"] for r in P.run(spark, SMALL).collect()} == want


def test_library_stands_without_this_part():
    import __spark_entry__

    source = Path(__spark_entry__.__file__).read_text()
    assert "ModuleNotFoundError" in source
    for path in Path(__spark_entry__.__file__).parent.glob("redactframe/**/*.py"):
        if "llm" not in path.parts:
            assert "redactframe.llm" not in path.read_text()
