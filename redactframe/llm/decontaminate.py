"""Benchmark decontamination with suffix arrays over the training words.

The benchmark is the query set: its items become numbered words, and its suffixes are the queries. Each block of
training texts (a shard) becomes an array of the same word numbers; words that no item has, and text ends, break it.
The suffixes of a shard are sorted by prefix doubling up to the longest item. Every benchmark suffix is found in that
order by binary search, which gives its longest verbatim match in the shard. Where that is as long as the item window
that begins the suffix, the run of suffixes that agree over the window holds all places of it: ``scan`` and ``clean``
work on those. ``matches`` returns every benchmark suffix with its longest match over all shards and the place of it.

The training table is scanned once for each block of benchmark items, and nothing is shuffled. A block of items has a
bounded number of bytes, so what is sent to the tasks does not grow with either table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactframe.llm import blocks as B
from redactframe.llm.store import small_batches, written


@dataclass
class Queries:
    """Benchmark items as numbered words, and their suffixes in order."""

    items: list[str]
    words: np.ndarray  # word numbers from 1, item after item, a zero after each item
    item: np.ndarray  # item of each word
    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place + 1
    starts: np.ndarray  # first words of all windows
    windows: np.ndarray  # length of each window
    longest: int

    @classmethod
    def of(cls, items: list[str], texts: list[str | None], width: int) -> Queries:
        data, offsets = B.text_bytes(pa.array(texts, pa.string()))
        data = B.LOWER[data]
        begin, end, bounds = B.runs(B.ALNUM_OR_WIDE[data], offsets)
        hashes = B.span_hashes(data, begin, end)
        vocabulary = np.unique(hashes)
        numbers = np.searchsorted(vocabulary, hashes) + 1
        count = np.diff(bounds)
        # one break after each item
        words = np.zeros(len(numbers) + len(items), np.int64)
        item = np.repeat(np.arange(len(items)), count + 1)
        first = bounds[:-1] + np.arange(len(items))
        words[np.arange(len(numbers)) + B.owner(bounds)] = numbers
        window = np.minimum(count, width)
        per_item = np.where(count > 0, count - window + 1, 0)
        starts = np.arange(per_item.sum()) - np.repeat(np.cumsum(per_item) - per_item - first, per_item)
        return cls(items, words, item, vocabulary, starts, np.repeat(window, per_item), int(count.max(initial=0)))


def suffix_order(words: np.ndarray, depth: int) -> np.ndarray:
    """The non-zero places of ``words``, ordered by up to ``depth`` words from each on; a zero ends a suffix.

    Prefix doubling: the first key packs as many words as fit, then pairs of ranks at twice the distance make the
    next key, until ``depth`` words are covered or all ranks differ.
    """
    places = np.flatnonzero(words)
    if not len(places):
        return places
    base = int(words.max()) + 1
    rank = np.zeros(2 * len(words) + 64, np.int64)
    rank[:len(words)] = words
    key, goes_on, covered = rank[places], np.ones(len(places), bool), 1
    reach = base
    while covered < depth and reach * base < 2**62:
        goes_on &= rank[places + covered - 1] > 0
        key = key * base + np.where(goes_on, rank[places + covered], 0)
        reach *= base
        covered += 1
    while True:
        by = np.argsort(key, kind="stable")
        order, key = places[by], key[by]
        new = np.ones(len(key), np.int64)
        new[1:] = key[1:] != key[:-1]
        if covered >= depth or new.all():
            return order
        rank[:len(words)] = 0
        rank[order] = np.cumsum(new)
        key = rank[places] * np.int64(len(places) + 1) + rank[places + covered]
        covered *= 2


def _compare(words: np.ndarray, places: np.ndarray, query: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes against query prefixes of given lengths (-1, 0, 1), and how many words agree."""
    sign, agree = np.zeros(len(places), np.int8), np.zeros(len(places), np.int64)
    open_, k = np.flatnonzero(lengths > 0), 0
    while len(open_):
        a, b = words[places[open_] + k], query[at[open_] + k]
        same = (a == b) & (a > 0)
        sign[open_] = np.where(same, 0, np.sign(a - b)).astype(np.int8)
        agree[open_[same]] += 1
        k += 1
        open_ = open_[same & (lengths[open_] > k)]
    return sign, agree


def search(words: np.ndarray, order: np.ndarray, query: np.ndarray, at: np.ndarray, lengths: np.ndarray, past: bool = False) -> np.ndarray:
    """Binary search of every query prefix: the first suffix not below it, or with ``past`` the first above it."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        sign, _ = _compare(words, order[middle], query, at[open_], lengths[open_])
        right = sign <= 0 if past else sign < 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
    return low


@dataclass
class Shard:
    """A block of training texts: its numbered words, their suffix array, and the texts' bounds in words."""

    words: np.ndarray
    order: np.ndarray
    bounds: np.ndarray  # each text's first word among all words of the block

    @classmethod
    def of(cls, block: B.Block, queries: Queries) -> Shard:
        data = B.LOWER[block.data]
        begin, end, bounds = B.runs(B.ALNUM_OR_WIDE[data], block.offsets)
        hashes = B.span_hashes(data, begin, end)
        words = np.zeros(len(hashes) + block.rows + 1, np.int64)
        if len(queries.vocabulary):
            place = np.minimum(np.searchsorted(queries.vocabulary, hashes), len(queries.vocabulary) - 1)
            # a word's slot leaves room for one break after each text
            words[np.arange(len(hashes)) + B.owner(bounds)] = np.where(queries.vocabulary[place] == hashes, place + 1, 0)
        return cls(words, suffix_order(words, queries.longest), bounds)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds + np.arange(len(self.bounds)), places, "right") - 1

    def longest_matches(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every benchmark suffix: its place in the queries, its longest match in this shard, and where that is."""
        at = np.flatnonzero(queries.words)
        left = np.full(len(at), max(queries.longest, 1), np.int64)
        if not len(self.order):
            return at, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        near = search(self.words, self.order, queries.words, at, left)
        best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for side in (near - 1, near):
            place = self.order[np.clip(side, 0, len(self.order) - 1)]
            _, agree = _compare(self.words, place, queries.words, at, left)
            where = np.where(agree > best, place, where)
            best = np.maximum(best, agree)
        return at, best, where

    def hits(self, queries: Queries) -> Hits:
        """The occurrences of item windows: of the suffixes whose longest match here is as long as their window."""
        at, best, _ = self.longest_matches(queries)
        longest = np.zeros(len(queries.words), np.int64)
        longest[at] = best
        met = np.flatnonzero(longest[queries.starts] >= queries.windows)
        begin, window = queries.starts[met], queries.windows[met]
        low = search(self.words, self.order, queries.words, begin, window)
        count = search(self.words, self.order, queries.words, begin, window, past=True) - low
        which = np.repeat(np.arange(len(met)), count)
        places = B.gather(self.order, low, count)
        n = len(self.words) + 1
        inside = np.cumsum(np.bincount(places, minlength=n) - np.bincount(places + window[which], minlength=n)) > 0
        hit = inside[np.arange(self.bounds[-1]) + B.owner(self.bounds)]
        texts, begin = self.text_of(places), begin[which]
        _, length = _compare(self.words, places, queries.words, begin, np.full(len(places), max(queries.longest, 1)))
        first = np.concatenate(([0], np.flatnonzero(queries.words == 0) + 1))
        return Hits(hit, texts, queries.item[begin], begin - first[queries.item[begin]], length, places - self.bounds[texts] - texts)


@dataclass
class Hits:
    """Words inside an occurrence of a window; and of each occurrence its text, item, first word in the item, length of the match from there on, and first word in the text."""

    hit: np.ndarray
    text: np.ndarray
    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    place: np.ndarray

    def longest(self) -> Iterator[tuple[int, ...]]:
        """For each text, its occurrences of greatest length, one an item: text, item, start, length, place (least start and place first)."""
        order = np.lexsort((self.place, self.start, self.item, -self.length, self.text))
        text, item, length = self.text[order], self.item[order], self.length[order]
        top = np.zeros(len(order), np.int64)
        new = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(order) else order
        top[new] = new
        head = np.maximum.accumulate(top)
        use = length == length[head]
        use[1:] &= (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (length[1:] != length[:-1])
        yield from zip(*(c[order][use].tolist() for c in (self.text, self.item, self.start, self.length, self.place)), strict=True)


def query_blocks(benchmark: DataFrame, key: str, text: str, width: int, block_bytes: int) -> tuple[int, Iterator[Queries]]:
    """The benchmark as query sets of about ``block_bytes`` of text each: their number, and one at a time on the driver."""
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // block_bytes))

    def each() -> Iterator[Queries]:
        for part in range(parts):
            rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).orderBy("item", "text").collect()
            yield Queries.of([r["item"] for r in rows], [r["text"] for r in rows], width)

    return parts, each()


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, and its longest match that fills a
    window: ``match_words`` (its length), ``match_item``, ``match_start`` (first word in the item) and ``match_place`` (first
    word in the document), 0 and nulls without one; of equal lengths the smallest item (as a string), start and place.

    A window is ``width`` consecutive words of an item, or all words of a shorter item. Null and empty texts have no
    words and hit nothing; items without words have no window; rows that repeat an item id are one item, and an item
    without an id goes by the empty string. Repeated documents stay repeated. An empty benchmark hits nothing.
    """
    small_batches(docs.sparkSession)
    state = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    state = state.withColumn("hit", F.lit(None).cast("binary")).withColumn("items", F.lit(None).cast("array<string>"))
    state = state.withColumn("match", F.lit(None).cast("struct<words: bigint, item: string, start: bigint, place: bigint>"))
    result = T.StructType([state.schema["id"]]).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string")
    result = result.add("match_words", "long").add("match_item", "string").add("match_start", "long").add("match_place", "long")
    parts, queries = query_blocks(benchmark, item_key, item_text, width, block_bytes)
    for number, query in enumerate(queries):
        last = number == parts - 1

        def run(batches: Iterator[pa.RecordBatch], sent=docs.sparkSession.sparkContext.broadcast(query), last=last) -> Iterator[pa.RecordBatch]:
            nothing = hashlib.sha256(b"").hexdigest()
            for batch in batches:
                hits, items, best, n_words = *(batch.column(c).to_pylist() for c in (2, 3, 4)), [np.zeros(0, np.int64)]
                for block in B.blocks(batch.column(1)):
                    shard = Shard.of(block, sent.value)
                    found = shard.hits(sent.value)
                    n_words.append(np.diff(shard.bounds))
                    for t in np.unique(found.text):
                        own, row = found.hit[shard.bounds[t]:shard.bounds[t + 1]], block.row0 + t
                        if hits[row] is not None:  # what earlier blocks of items hit
                            own = own | np.unpackbits(np.frombuffer(hits[row], np.uint8), count=len(own)).astype(bool)
                        hits[row] = np.packbits(own).tobytes()
                    pairs = np.unique(found.text * np.int64(len(sent.value.items) + 1) + found.item)
                    for t, i in zip(*np.divmod(pairs, len(sent.value.items) + 1), strict=True):
                        row = block.row0 + t
                        items[row] = sorted({*(items[row] or ()), sent.value.items[i]})
                    for t, i, start, length, place in found.longest():
                        own, row = {"words": length, "item": sent.value.items[i], "start": start, "place": place}, block.row0 + t
                        order = lambda m: (-m["words"], m["item"].encode(), m["start"], m["place"])
                        best[row] = min((m for m in (best[row], own) if m), key=order)
                if last:
                    columns = [
                        batch.column(0), pa.array(np.concatenate(n_words), pa.int64()),
                        pa.array([int(np.bitwise_count(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in hits], pa.int64()),
                        pa.array([len(i or ()) for i in items], pa.int64()),
                        pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() if i else nothing for i in items], pa.string()),
                        pa.array([m["words"] if m else 0 for m in best], pa.int64()), pa.array([m and m["item"] for m in best], pa.string()),
                        pa.array([m and m["start"] for m in best], pa.int64()), pa.array([m and m["place"] for m in best], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=result.names)
                else:
                    columns = [batch.column(0), batch.column(1), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(best, batch.schema.field(4).type)]
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        state = state.mapInArrow(run, result if last else state.schema)
        if not last:
            state = written(state, "decontaminate")
    return state


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
            item_text: str = "text", width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Longest verbatim match of every benchmark suffix over all documents, and where it is.

    ``item`` (as a string), ``start`` (word of the item), ``length`` in words, ``id`` and ``place`` (word of that
    document). Each shard gives one candidate a suffix; the longest wins, then the smallest id and place. Suffixes of
    which no word occurs, null and empty texts and items without words have no row. Ids are of any orderable type.
    """
    state = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    shape = T.StructType().add("item", "string").add("start", "long").add("length", "long").add(T.StructField("id", state.schema["id"].dataType)).add("place", "long")
    found = None
    for query in query_blocks(benchmark, item_key, item_text, width, block_bytes)[1]:

        def run(batches: Iterator[pa.RecordBatch], sent=docs.sparkSession.sparkContext.broadcast(query)) -> Iterator[pa.RecordBatch]:
            q = sent.value
            begins = np.concatenate(([0], np.flatnonzero(q.words == 0) + 1))
            for batch in batches:
                for block in B.blocks(batch.column(1)):
                    shard = Shard.of(block, q)
                    at, best, where = shard.longest_matches(q)
                    at, best, where = at[best > 0], best[best > 0], where[best > 0]
                    texts = shard.text_of(where)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([q.items[i] for i in q.item[at]], pa.string()), pa.array(at - begins[q.item[at]], pa.int64()), pa.array(best, pa.int64()),
                        batch.column(0).take(pa.array(block.row0 + texts)), pa.array(where - shard.bounds[texts] - texts, pa.int64())], names=shape.names)

        part = state.mapInArrow(run, shape)
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct((-F.col("length")).alias("less"), "id", "place")).alias("b")
    return found.groupBy("item", "start").agg(best).select("item", "start", (-F.col("b.less")).alias("length"), "b.id", "b.place")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no benchmark window occurs."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    parts, queries = query_blocks(benchmark, item_key, item_text, width, block_bytes)
    for number, query in enumerate(queries):

        def run(batches: Iterator[pa.RecordBatch], sent=docs.sparkSession.sparkContext.broadcast(query)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for block in B.blocks(batch.column(at)):
                    keep[block.row0 + Shard.of(block, sent.value).hits(sent.value).text] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if number < parts - 1:
            docs = written(docs, "decontaminate")
    return docs
