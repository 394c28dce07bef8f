"""Byte-level BPE encoding by a minimal acyclic transducer of frequent words, and decoding.

A scan counts the words that the tokenizer's pre-tokenizer makes of all texts. The frequent ones are encoded once and
compiled into an automaton that shares suffixes as well as prefixes; each arc carries a number, and the sum along a
word's path is the word's place in one array of token ids. The compiled lexicon is one file, which Spark hands to every
executor and each worker maps into memory. To encode a text, its distinct words walk the automaton together, one byte a
step; a word that it lacks is merged exactly, by ranks.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from redactframe.llm import blocks as B
from redactframe.llm.store import shared_folder, small_batches, written

#: Words in the lexicon at most, and bytes of a word in it at most. They decide cost, not results.
LEXICON_WORDS, LEXICON_BYTES = 1 << 16, 32
#: Distinct words that a counting task holds together, bytes of text that are encoded together, and bytes of a word that
#: is merged together with others.
HELD_WORDS, ENCODED_BYTES, TOGETHER_BYTES = 1 << 18, 1 << 20, 64
#: Token ids that are decoded in one step; a longer single list is a step of its own.
DECODED_IDS = 1 << 18
#: Counts are compared by their class, eight to a doubling.
_CLASSES = 8

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter, number, white space or other, for every code point, as the pre-tokenizer has it.

    Versions of Unicode differ from library to library: of the letters and numbers that the newer one lists, those that
    Python itself does not know yet are asked of the pre-tokenizer.
    """
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    out, new = np.zeros(0x110000, np.uint8), []
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = regex.findall(pattern, every)
        out[[ord(c) for c in found]] = kind
        new += [c for c in found if unicodedata.category(c) == "Cn"]
    out[[ord(c) for c in new]] = OTHER
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for kind, before in ((LETTER, "a"), (NUMBER, "1")):
        spans = split.pre_tokenize_str("\n".join(before + c for c in new))
        out[[ord(new[a // 3]) for _, (a, b) in spans if b - a == 2]] = kind
    return out


class Vocabulary:
    """A byte-level BPE tokenizer file: token bytes by id, merge ranks, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and spec["normalizer"] is None and spec["post_processor"] is None
        if model["type"] != "BPE" or not plain or model["ignore_merges"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        # the printable stand-ins that byte-level vocabularies write for bytes
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        stand_in = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.tokens[i] = bytes(stand_in[c] for c in token) if token not in self.added else token.encode()
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.byte_ids = [ids[c] for _, c in sorted((b, c) for c, b in stand_in.items())]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[left], ids[right]), (len(self.merges), ids[left + right]))
        pairs = np.array([left << 32 | right for left, right in self.merges], np.int64)
        self._order = np.argsort(pairs)
        self._pairs = pairs[self._order]
        self._results = np.array([merged for _, merged in self.merges.values()], np.int64)
        self._by_byte = np.array(self.byte_ids, np.int64)
        self.added_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)).encode()) if self.added else None

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: the pair of least rank, leftmost first, becomes one token, until none is left."""
        ids: list[int] = [self.byte_ids[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, merged, ids[i], right) for rank, merged, i, right in heap]
        heapq.heapify(heap)
        while heap:
            _, i, merged, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((merged, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], merged, ids[k]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], merged))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], merged))
        return [x for x in ids if x >= 0]


    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._order[at], len(self._order))

    def merge_all(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many short words and n + 1 bounds: all words take their next merge together."""
        ids, none = self._by_byte[B.gather(data, starts, lengths)], len(self._order)
        word = np.repeat(np.arange(len(starts)), lengths)
        rank = np.full(len(ids), none, np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        while len(ids) and rank.min() < none:
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank * len(ids) + np.arange(len(ids)), heads)  # least rank, then leftmost
            chosen, at = best // len(ids), best % len(ids)
            at, chosen = at[chosen < none], chosen[chosen < none]
            ids[at] = self._results[chosen]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at -= np.arange(len(at))  # each word before has lost one
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                rank[left] = np.where((right > left) & (word[left] == word[right]), self._ranks(ids[left], ids[right]), none)
        return ids.astype(np.uint32), np.searchsorted(word, np.arange(len(starts) + 1))


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each word of the texts begins, as byte places: runs of letters, numbers, other signs or white space, as the
    byte-level pre-tokenizer cuts them.

    A blank goes to the run behind it, other white space in front of a run is a word of its own, apart from what stands
    before it, and a contraction's ending is a word.
    """
    lead = (data & 0xC0) != 0x80
    place = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    head = np.zeros(n + 1, bool)  # texts begin here
    head[np.searchsorted(place, offsets)] = True
    same = np.zeros(n, bool)  # the point before belongs to the same text
    same[1:] = ~head[1:n]
    start = np.ones(n, bool)
    start[1:] = head[1:n] | (kind[1:] != kind[:-1])
    # a run behind white space: the last space is apart from those before it; a blank belongs to the run
    behind = np.flatnonzero(same & start & (kind != SPACE) & (np.concatenate(([OTHER], kind[:-1])) == SPACE))
    start[behind - 1] = True
    start[behind[points[behind - 1] == 0x20]] = False
    mark = np.flatnonzero(start & (points == 0x27))
    at = lambda i, step: np.where((i + step < n) & ~_crosses(head, i, step), points[np.minimum(i + step, n - 1)], 0)
    one, two = at(mark, 1), at(mark, 2)
    short = np.isin(one, np.array([ord(c) for c in "stmd"], np.uint32))
    long = np.zeros(len(mark), bool)
    for ending in ("re", "ve", "ll"):
        long |= (one == ord(ending[0])) & (two == ord(ending[1]))
    start[mark[short | long] + 1] = False
    for hit, size in ((short, 2), (long, 3)):
        ends = mark[hit] + size
        start[ends[ends < n]] = True
    return place[start]


def _crosses(head: np.ndarray, i: np.ndarray, step: int) -> np.ndarray:
    """Does a text begin at any of the ``step`` points behind i?"""
    out = np.zeros(len(i), bool)
    for k in range(1, step + 1):
        out |= head[np.minimum(i + k, len(head) - 1)]
    return out


def segments(block: B.Block, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets at which the texts, and added tokens inside them, begin; and places and ids of added tokens."""
    if voc.added_pattern is None:
        return block.offsets, np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, found = memoryview(np.ascontiguousarray(block.data)), []
    for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        found += [(m.start(), m.end(), voc.added[bytes(m[0]).decode()]) for m in voc.added_pattern.finditer(data, a, b)]
    cuts = np.array([x for a, b, _ in found for x in (a, b)], np.int64)
    return np.unique(np.concatenate((block.offsets, cuts))), np.array([a for a, _, _ in found], np.int64), np.array([i for _, _, i in found], np.int64)


def block_words(block: B.Block, voc: Vocabulary) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block's texts as binary values, where each begins, and places and ids of added tokens (no words)."""
    heads, added_at, added_ids = segments(block, voc)
    starts = words(block.data, heads)
    ends = np.append(starts[1:], len(block.data))
    if len(added_at):
        # an added token's bytes make words of their own, as the cuts are text bounds: they go
        token_ends = heads[np.searchsorted(heads, added_at) + 1]
        inside = np.searchsorted(added_at, starts, "right") - 1
        own = (inside < 0) | (starts >= token_ends[np.maximum(inside, 0)])
        starts, ends = starts[own], ends[own]
        data = B.gather(block.data, starts, ends - starts)
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    else:
        data, offsets = block.data, np.append(starts, len(block.data))
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return array, starts, added_at, added_ids


def word_counts(texts: DataFrame, path: str, longest: int = LEXICON_BYTES) -> DataFrame:
    """``word`` (bytes) and ``n`` over all texts of the one column, words of at most ``longest`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, held = vocabulary(path), []
        for batch in batches:
            for block in B.blocks(batch.column(0)):
                found = block_words(block, voc)[0]
                coded = found.filter(pc.less_equal(pc.binary_length(found), longest)).dictionary_encode()
                held.append(pa.table({"word": coded.dictionary, "n": np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))}))
            if sum(t.num_rows for t in held) > HELD_WORDS:
                held = [_added_up(held)]
                if held[0].num_rows > HELD_WORDS // 2:
                    yield from held.pop().to_batches(1 << 16)
        if held:
            yield from _added_up(held).to_batches(1 << 16)

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _added_up(held: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return out.select(["word", "n_sum"]).rename_columns(["word", "n"])


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS) -> list[bytes]:
    """The words of the highest classes of counts, as many whole classes as ``most`` words allow, sorted by bytes.

    Classes are counted by one aggregation, so no task sorts or holds all words; the driver gets at most ``most``.
    """
    graded = counts.where("n > 1").withColumn("grade", F.floor(F.log2("n") * _CLASSES).cast("int"))
    sizes = {r["grade"]: r["m"] for r in graded.groupBy("grade").agg(F.count(F.lit(1)).alias("m")).collect()}  # at most 63 * _CLASSES rows
    least, total = max(sizes, default=0) + 1, 0
    for grade in sorted(sizes, reverse=True):
        total += sizes[grade]
        if total > most:
            break
        least = grade
    found = graded.where(F.col("grade") >= least).select("word").toArrow().column(0)
    return sorted(v.as_py() for v in found)


def compile_lexicon(entries: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal acyclic transducer of sorted, distinct words, and their ids, as the bytes of one file.

    States are made equal from the longest-finished path back (the words are sorted, so a state is final once a word
    leaves its path). An arc's number counts the words that sort before those through it, so a path sums up to the
    word's place in sorted order, and equal suffixes keep equal numbers.
    """
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # final?, ((byte, target), ...)
    reach: list[int] = []  # words from the state on

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
            reach.append(final + sum(reach[t] for _, t in arcs))
        return registry[key]

    path: list[tuple[bool, list]] = [(False, [])]  # the states along the last word, not yet settled
    last = b""
    for word in entries:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        for depth in range(len(last), common, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[depth - 1], settle(final, arcs)))
        path += [(False, []) for _ in range(len(word) - common)]
        path[-1] = (True, path[-1][1])
        last = word
    for depth in range(len(last), 0, -1):
        final, arcs = path.pop()
        path[-1][1].append((last[depth - 1], settle(final, arcs)))
    root = settle(*path[0])

    keys, targets, numbers = [], [], []
    for state, (final, arcs) in enumerate(states):
        number = int(final)
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            numbers.append(number)
            number += reach[target]
    finals = np.array([f for f, _ in states], np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    arrays = [np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(numbers, "<i4"), finals, bounds.astype("<i8"), np.array([x for own in ids for x in own], "<u4")]
    head = struct.pack("<7q", root, *(len(a) for a in arrays))
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Lexicon:
    """A compiled lexicon, read from any buffer (a memory map) without copies."""

    def __init__(self, buffer):
        self.root, *sizes = struct.unpack_from("<7q", buffer)
        at, found = 56, []
        for size, kind in zip(sizes, ("<i8", "<i4", "<i4", "u1", "<i8", "<u4"), strict=True):
            found.append(np.frombuffer(buffer, kind, size, at))
            at += found[-1].nbytes + -found[-1].nbytes % 8
        self.keys, self.targets, self.numbers, self.finals, self.bounds, self.ids = found

    def places(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each word's place in the lexicon, -1 for a word it lacks; all words take a step together."""
        out = np.full(len(starts), -1, np.int64)
        live = np.arange(len(starts) if len(self.keys) else 0)
        state, number = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            ended = lengths[live] == step
            done = ended & (self.finals[state] == 1)
            out[live[done]] = number[done]
            live, state, number = live[~ended], state[~ended], number[~ended]
            key = state << 8 | data[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            live, arc = live[known], arc[known]
            state, number = self.targets[arc].astype(np.int64), number[known] + self.numbers[arc]
            step += 1
        return out


def build_lexicon(docs: DataFrame, path: str, text: str = "text", most: int = LEXICON_WORDS) -> str:
    """Compiles the frequent words of all texts into a file in the shared folder and registers it with Spark; returns its name."""
    small_batches(docs.sparkSession)
    voc = vocabulary(path)
    counts = written(word_counts(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")), path), "word-counts")
    entries = frequent_words(counts, most)
    target = shared_folder(docs.sparkSession, "lexicon") + ".bin"
    files, place = fs.FileSystem.from_uri(target)
    files.create_dir(place.rsplit("/", 1)[0])
    with files.open_output_stream(place, compression=None) as out:
        out.write(compile_lexicon(entries, [voc.merge(w) for w in entries]))
    docs.sparkSession.sparkContext.addFile(target)
    return target.rsplit("/", 1)[1]


@lru_cache(2)
def mapped(name: str) -> Lexicon:
    """The lexicon that Spark has put beside the worker, as a memory map that the executor's workers share."""
    with open(SparkFiles.get(name), "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Encoder:
    def __init__(self, voc: Vocabulary, lexicon: Lexicon):
        self.voc, self.lexicon = voc, lexicon

    def unseen(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the lexicon lacks, those of short words first, and their bounds in the order given."""
        short = lengths <= TOGETHER_BYTES
        ids, bounds = self.voc.merge_all(data, starts[short], lengths[short])
        own = [self.voc.merge(data[a:a + n].tobytes()) for a, n in zip(starts[~short], lengths[~short], strict=True)]
        sizes = np.zeros(len(starts), np.int64)
        first = np.zeros(len(starts), np.int64)
        sizes[short], first[short] = np.diff(bounds), bounds[:-1]
        sizes[~short] = [len(x) for x in own]
        first[~short] = len(ids) + np.cumsum(sizes[~short]) - sizes[~short]
        return np.concatenate((ids, *(np.array(x, np.uint32) for x in own))), np.stack((first, sizes))

    def block(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a block's texts, one after the other, and n + 1 bounds."""
        found, starts, added_at, added_ids = block_words(block, self.voc)
        coded = found.dictionary_encode()
        data, offsets = _binary(coded.dictionary)
        place = self.lexicon.places(data, offsets[:-1], np.diff(offsets))
        # ids of each distinct word: from the lexicon, then those merged here, then the added tokens
        lacking = np.flatnonzero(place < 0)
        new_ids, (new_first, new_many) = self.unseen(data, offsets[lacking], np.diff(offsets)[lacking])
        bounds = self.lexicon.bounds
        first = bounds[np.maximum(place, 0)]
        many = bounds[np.minimum(np.maximum(place, 0) + 1, len(bounds) - 1)] - first
        first[lacking], many[lacking] = len(self.lexicon.ids) + new_first, new_many
        pool = np.concatenate((self.lexicon.ids, new_ids, added_ids.astype(np.uint32)))
        index = coded.indices.to_numpy(zero_copy_only=False)
        first, many = first[index], many[index]
        if len(added_at):
            at = np.concatenate((starts, added_at))
            order = np.argsort(at, kind="stable")
            first = np.concatenate((first, len(pool) - len(added_at) + np.arange(len(added_at))))[order]
            many = np.concatenate((many, np.ones(len(added_at), np.int64)))[order]
            starts = at[order]
        total = np.concatenate(([0], np.cumsum(many)))
        return B.gather(pool, first, many), total[np.searchsorted(starts, block.offsets)]


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """``id`` and ``ids`` (token ids) of every row, as the tokenizer of the file at ``path`` encodes its whole text.

    A null or empty text has no ids. The strings of added tokens become their ids. Repeated rows are encoded each; an
    empty table gives an empty one; other columns are not read.
    """
    name = build_lexicon(docs, path, text, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path), mapped(name))
        for batch in batches:
            for block in B.blocks(batch.column(1), ENCODED_BYTES):
                ids, bounds = encoder.block(block)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row0, block.rows), lists], names=["id", "ids"])

    shape = T.StructType([T.StructField("id", docs.schema[key].dataType)]).add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, shape)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with a column ``into``: the text of the token ids, invalid UTF-8 replaced; null ids have the empty text.

    Ids that the vocabulary lacks, and null ids, are left out, as the tokenizer does.
    """
    if into in rows.columns:
        raise ValueError(f"column {into} exists")
    place = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        pool = np.frombuffer(b"".join(voc.tokens), np.uint8)
        size = np.array([len(t) for t in voc.tokens], np.int64)
        first = np.cumsum(size) - size
        for batch in batches:
            column = batch.column(place)
            lists = pc.fill_null(column, []) if column.null_count else column
            count = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            row = 0
            while row < batch.num_rows:  # some rows at a time, at least one
                end = max(row + 1, int(np.searchsorted(count, count[row] + DECODED_IDS, "right")) - 1)
                found = pc.fill_null(lists.slice(row, end - row).flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                known = (found >= 0) & (found < len(size))
                found = np.where(known, found, 0)
                many = np.where(known, size[found], 0)
                data = B.gather(pool, first[found], many).tobytes()
                bounds = np.concatenate(([0], np.cumsum(many)))[count[row:end + 1] - count[row]].tolist()
                texts = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(row, end - row).columns, texts], names=[*batch.schema.names, into])
                row = end

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))
