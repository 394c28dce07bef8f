import hashlib
import sys

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from redactframe.llm import blocks, bpe, queries

PATH = queries.tokenizer_path()
GIVEN = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(PATH)


def encoded(texts, entries=()):
    """Ids of the texts by the encoder alone, with a lexicon of ``entries``."""
    voc = bpe.vocabulary(PATH)
    entries = sorted(set(entries))
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries, [voc.merge(w) for w in entries]))
    encoder, out = bpe.Encoder(voc, lexicon), []
    for block in blocks.blocks(pa.array(texts, pa.string())):
        ids, bounds = encoder.block(block)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def wanted(tokenizer, texts):
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_code_point_is_of_the_right_kind(tokenizer):
    """Each code point between a letter, a number, a sign and blanks, as the library's pre-tokenizer cuts it."""
    points = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    for a in range(0, len(points), 1 << 16):
        text = "\n".join(f"a{c}1{c}!{c} {c}x" for c in points[a:a + (1 << 16)])
        data = np.frombuffer(text.encode(), np.uint8)
        starts = bpe.words(data, np.array([0, len(data)]))
        at = np.cumsum((data & 0xC0) != 0x80)[starts] - 1
        want = [x for _, (x, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if at.tolist() != want:
            odd = next(i for i, (x, y) in enumerate(zip(at.tolist(), want, strict=False)) if x != y)
            raise AssertionError(f"word {odd}: {text[at[odd] - 10:at[odd] + 10]!r}")


ALPHABET = st.sampled_from([" ", "  ", "\n", "\t", " ", "'", "'s", "'re", "'ll", "'S", "s", "ve", "the", "a", "é", "ß", "中", "😀", "1", "23", "!", "_", "<|endoftext|>", "<|endof", "text|>", "\x00", "é"])


@given(st.lists(st.lists(ALPHABET, max_size=12).map("".join), min_size=1, max_size=6), st.booleans())
@settings(max_examples=400, deadline=None)
def test_texts_of_odd_parts(texts, known):
    tokenizer = tokenizers.Tokenizer.from_file(PATH) if not hasattr(test_texts_of_odd_parts, "t") else test_texts_of_odd_parts.t
    test_texts_of_odd_parts.t = tokenizer
    assert encoded(texts, [b" the", b"the", b"'s", b" a", b"!", b"  "] if known else ()) == wanted(tokenizer, texts)


@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_any_texts(texts):
    tokenizer = getattr(test_any_texts, "t", None) or tokenizers.Tokenizer.from_file(PATH)
    test_any_texts.t = tokenizer
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert encoded(texts) == wanted(tokenizer, texts)


def test_long_words(tokenizer):
    texts = ["ab" * 40_000, "x" * 100_000 + " y", "é" * 5000 + "'s", " " * 3000, "=" * 2000 + "\n" * 500 + "z"]
    assert encoded(texts) == wanted(tokenizer, texts)


@given(st.lists(st.one_of(st.binary(min_size=1, max_size=40), st.text("aeinorst ", min_size=1, max_size=60).map(str.encode)), max_size=20))
@settings(max_examples=300, deadline=None)
def test_words_merged_together_are_as_merged_alone(some):
    voc = bpe.vocabulary(PATH)
    sizes = np.array([len(w) for w in some], np.int64)
    ids, bounds = voc.merge_all(np.frombuffer(b"".join(some), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [voc.merge(w) for w in some]


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60))
@settings(max_examples=200, deadline=None)
def test_automaton_numbers_its_words(entries):
    entries = sorted(entries)
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries, [[i] for i in range(len(entries))]))
    probe = entries + [e + b"x" for e in entries] + [e[:-1] for e in entries] + [b"\xff\x00"]
    data, sizes = np.frombuffer(b"".join(probe), np.uint8), np.array([len(p) for p in probe])
    got = lexicon.places(data, np.cumsum(sizes) - sizes, sizes)
    place = {e: i for i, e in enumerate(entries)}
    assert got.tolist() == [place.get(p, -1) for p in probe]


def test_automaton_shares_suffixes():
    entries = sorted(a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"s", b"ed", b"ing"))
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries, [[0]] * len(entries)))
    # one end state; a state for the four endings; e, i, n; walk and talk share all but the first letter; jump has three more
    assert len(lexicon.finals) == 1 + 3 + 1 + 3 + 3 + 1


def test_given_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    got = {r["id"]: r for r in bpe.decode(bpe.encode(docs, PATH, most=2000), PATH).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["ids"] == tokenizer.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]]["text"] == r["text"]


def test_awkward_tables(spark, rows, tokenizer):
    schema = "doc_id string, text string, ids string, id int"
    assert bpe.encode(rows([], schema), PATH).collect() == []
    data = [(None, None), ("a", ""), ("b", "the the the <|endoftext|> the"), ("b", "the the the <|endoftext|> the"), (None, " y'all'll  ")]
    got = bpe.decode(bpe.encode(rows([(k, t, "clash", 1) for k, t in data], schema), PATH), PATH)
    assert got.columns == ["id", "ids", "text"]
    key = lambda r: (str(r[0]), r[2])
    want = [(k, tokenizer.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in data]
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(want, key=key)


def test_decode_of_odd_ids(rows, tokenizer):
    given_ids = [[0, 50256, 99, 222, 223], [], None, [99999, -1, None, 10], [160, 161], [50256] * 3]
    got = bpe.decode(rows([(i, x) for i, x in enumerate(given_ids)], "id int, ids array<int>"), PATH)
    want = [tokenizer.decode([i for i in x or [] if i is not None and i >= 0], skip_special_tokens=False) for x in given_ids]
    assert [r["text"] for r in got.orderBy("id").collect()] == want
    with pytest.raises(ValueError, match="exists"):
        bpe.decode(got, PATH)


def test_query_columns(spark, tokenizer):
    out = queries.op12_bpe(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in out.collect():
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))
