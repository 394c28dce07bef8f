"""Document ingest rules, sentences, retrieval and the per-owner vault."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions.contains import contains_join, found_in_long
from redactframe.functions.text import collapse, lines, materialize, trim, words
from redactframe.operators.redact import scrub_ids
from redactframe.session import stored

# --- ingest -----------------------------------------------------------------


def doc_format(name: Column, mime: Column) -> Column:
    """Format by extension, else by MIME type, else null."""
    ext = trim(F.lower(F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise("")))
    m = F.lower(F.coalesce(mime, F.lit("")))
    by_ext = F.create_map(*[F.lit(x) for kv in rules.EXTENSION_FORMATS for x in kv])
    by_mime = F.create_map(*[F.lit(x) for kv in rules.MIME_FORMATS for x in kv])
    return F.coalesce(
        F.element_at(by_ext, ext), F.element_at(by_mime, m), F.when(F.startswith(m, F.lit("text/")), "text")
    )


def ingest_code() -> Column:
    """Reject code of a file, or null: payload, type, size, then the limits of structuring."""
    return (
        F.when(F.coalesce(F.length("payload"), F.lit(0)) == 0, "NO_FILE")
        .when(doc_format(F.col("name"), F.col("mime_type")).isNull(), "UNSUPPORTED")
        .when(F.col("n_bytes") == 0, "EMPTY")
        .when(F.col("n_bytes") > rules.MAX_DOCUMENT_BYTES, "TOO_LARGE")
        .when(F.col("text_chars") > rules.MAX_STRUCTURE_CHARS, "STRUCTURE_TOO_LARGE")
        .when(~F.coalesce(F.col("consented"), F.lit(False)), "STRUCTURE_CONSENT_REQUIRED")
    )


def split_ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files and the quarantine with its codes; together they are all rows."""
    coded = files.withColumn("reject_code", ingest_code())
    return coded.filter("reject_code IS NULL").drop("reject_code"), coded.filter("reject_code IS NOT NULL")


def needs_ocr(text: Column) -> Column:
    """Fewer than 50 visible characters: a scan without a text layer."""
    return F.length(F.regexp_replace(text, r"\s", "")) < rules.NEEDS_OCR_CHARS


# --- retrieval ----------------------------------------------------------------


def keywords(query_text: Column) -> Column:
    """Distinct words of three or more characters that are not stop words, in order."""
    stop = F.array(*[F.lit(w) for w in rules.STOPWORDS])
    return F.array_distinct(
        F.filter(words(query_text), lambda w: (F.length(w) >= rules.MIN_KEYWORD_CHARS) & ~F.array_contains(stop, w))
    )


def sentence_array(text: Column) -> Column:
    """Non-blank lines; a line over 400 characters is cut after . ! ? before a capital or digit."""
    per_line = F.transform(
        F.filter(F.transform(lines(text), trim), lambda s: s != ""),
        lambda s: F.when(F.length(s) <= rules.MAX_SNIPPET_CHARS, F.array(s)).otherwise(
            F.filter(F.transform(F.split(s, r"(?<=[.!?])\s+(?=[A-Z0-9])"), trim), lambda p: p != "")
        ),
    )
    return F.flatten(per_line)


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode(sentence_array(F.col("text"))).alias("sent_idx", "sentence"))


def clip(sentence: Column, cap: int = rules.MAX_SNIPPET_CHARS) -> Column:
    """At most ``cap`` characters, cut at the last space when that keeps over 60 % of it."""
    s = collapse(sentence)
    cut = F.substring(s, 1, cap)
    back = F.instr(F.reverse(cut), " ")
    last_space = F.when(back > 0, F.length(cut) - back).otherwise(-1)
    short = F.when(last_space > cap * 0.6, F.substring(cut, F.lit(1), last_space)).otherwise(cut)
    return F.when(F.length(s) <= cap, s).otherwise(F.concat(short, F.lit("…")))


#: Rows of a table that may be sent to all tasks, and numbers in the keyword lists of one. More of them are shuffled.
SENT_ROWS, SENT_NUMBERS = 1 << 17, 1 << 22


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def snippet_index(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Sentences of ``docs`` with the words of ``wanted`` (column ``word``) that they contain: doc_id, sent_idx, body, held.

    ``body`` is a 64-bit hash of the sentence, ``held`` a sorted array of such hashes of the words. Of sentences that hold the same words only the first k in
    document order are listed: any query scores them alike, so the others are in no answer. Words have letters and digits
    only, so they lie inside a run of these; they meet the distinct runs of the corpus, not its sentences. The runs that hold a
    word are sent to the sentences, where they are few enough.
    """

    def runs(text: str) -> Column:
        whole = F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))
        return F.explode(F.filter(whole, lambda r: F.length(r) >= rules.MIN_KEYWORD_CHARS)).alias("token")

    # the runs of a text are those of its sentences
    lexicon = contains_join(docs.select(runs("text")).distinct(), wanted, [], "token", "word", least=rules.MIN_KEYWORD_CHARS)
    lexicon = stored(lexicon.select(F.xxhash64("token").alias("token"), F.xxhash64("word").alias("word")))
    tokens = sentences(docs).select("doc_id", "sent_idx", F.xxhash64("sentence").alias("body"), runs("sentence")).withColumn("token", F.xxhash64("token"))
    held = tokens.join(_sent(lexicon), "token").groupBy("doc_id", "sent_idx", "body").agg(F.sort_array(F.collect_set("word")).alias("held"))
    order = Window.partitionBy("held").orderBy("doc_id", "sent_idx", "body")
    return held.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of each query with the least ``place``, and their ``rank``."""
    order = Window.partitionBy("query_id").orderBy("place")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_snippets(docs: DataFrame, queries: DataFrame, k: int = rules.DEFAULT_TOP_K) -> DataFrame:
    """The k best sentences per query over all documents.

    ``docs``: doc_id, text. ``queries``: query_id, text. Score = how many of the query's
    keywords the lower-cased sentence contains; ties keep document order (doc_id, sent_idx).

    Postings (word to sentence) come from ``snippet_index``. A first round scores the sentences of up to k documents of each
    keyword, which gives each query a k-th best place that any other answer has to beat. A sentence of score s or more holds one of
    a query's n - s + 1 rarest keywords, so the second round reads the postings of these only, and drops what does not
    reach the place before it is shuffled. Queries go to the postings, where their keyword lists are few enough; nothing else passes through the driver.

    Rows of one query_id are one query, repeated rows of a document count once. Queries without an id or a keyword, and
    null or blank texts, give no rows.
    """
    k = max(1, min(rules.MAX_TOP_K, k))
    uses = queries.filter(F.col("query_id").isNotNull()).select("query_id", F.explode(keywords(F.col("text"))).alias("word")).distinct()
    index = stored(snippet_index(docs, uses.select("word").distinct(), k))
    postings = index.select("*", F.explode("held").alias("word"))
    uses = uses.withColumn("word", F.xxhash64("word"))
    found = uses.join(postings.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word")
    rarest = F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda u: u["word"])
    asked = stored(found.groupBy("query_id").agg(rarest.alias("kw")))
    few = (asked.agg(F.sum(F.size("kw").cast("long") * F.size("kw"))).first()[0] or 0) <= SENT_NUMBERS

    def scored(postings: DataFrame, asked: DataFrame, *keep: str) -> DataFrame:
        """A row for each query and sentence that meet in a word: at the first of the query's words, rarest first, that the sentence holds."""
        asked = F.broadcast(asked) if few else asked
        met = materialize(postings.join(asked, "word"), ["query_id", "word", "doc_id", "sent_idx", "body", *keep], met=F.array_intersect("kw", "held"))
        place = F.struct((-F.size("met")).alias("loss"), "doc_id", "sent_idx", "body")
        return met.select("query_id", "word", F.get("met", F.lit(0)).alias("first"), place.alias("place"), *keep)

    # the first document of each word in each of k parts
    heads = postings.groupBy("word", F.pmod(F.xxhash64("doc_id"), F.lit(k)).alias("part")).agg(F.min("doc_id").alias("doc_id"))
    heads = postings.join(_sent(stored(heads.select("word", "doc_id"))), ["word", "doc_id"])
    first = _best(scored(heads, asked.withColumn("word", F.explode("kw"))).select("query_id", "place").distinct(), k)
    bound = stored(first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("place")).alias("last")))
    least = F.coalesce(-F.col("last.loss"), F.lit(1))
    reach = asked.join(bound, "query_id").withColumn("word", F.explode(F.slice("kw", F.lit(1), F.size("kw") - least + 1)))
    rivals = scored(postings, reach, "last").filter((F.col("word") == F.col("first")) & (F.col("last").isNull() | (F.col("place") <= F.col("last"))))
    best = stored(_best(rivals.select("query_id", "place"), k).select("query_id", "place.*", "rank"))
    own = docs.join(_sent(best.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = sentences(own).withColumn("body", F.xxhash64("sentence")).dropDuplicates(["doc_id", "sent_idx", "body"])
    return best.join(texts, ["doc_id", "sent_idx", "body"]).select(
        "query_id", "doc_id", "sent_idx", (-F.col("loss")).alias("score"), "rank", clip(F.col("sentence")).alias("snippet"))


# --- vault ----------------------------------------------------------------------


def vault_store(docs: DataFrame) -> DataFrame:
    """Normalise documents for storage: names and formats clipped, blanks dropped, identifiers scrubbed."""
    name = F.substring(trim(F.coalesce("doc_name", F.lit(""))), 1, rules.MAX_DOC_NAME_CHARS)
    fmt = F.substring(trim(F.coalesce("format", F.lit("text"))), 1, rules.MAX_DOC_FORMAT_CHARS)
    return docs.filter(trim(F.col("text")) != "").select(
        "owner_id", "doc_id", "extracted_at",
        F.when(name != "", name).otherwise("upload").alias("doc_name"),
        F.when(fmt != "", fmt).otherwise("text").alias("format"),
        scrub_ids(F.col("text")).alias("text"),
    )


def vault_retention(
    docs: DataFrame, max_docs: int = rules.VAULT_MAX_DOCS, max_bytes: int = rules.VAULT_MAX_BYTES
) -> DataFrame:
    """Newest documents of each owner within both limits; the newest one always stays, cut to fit.

    The document limit prunes inside every task before the shuffle (row_number with a
    limit), so an owner with very many documents still sends only ``max_docs`` per task,
    and the running size then looks at no more than ``max_docs`` rows per owner.
    """
    newest = Window.partitionBy("owner_id").orderBy(F.desc("extracted_at"), F.desc("doc_id"))
    kept = (
        docs.filter(F.length("text") > 0)
        .withColumn("age_rank", F.row_number().over(newest))
        .filter(F.col("age_rank") <= max_docs)
    )
    running = newest.rowsBetween(Window.unboundedPreceding, 0)
    sized = kept.withColumn("bytes_so_far", F.sum(F.octet_length("text").cast("long")).over(running))
    within = sized.filter((F.col("age_rank") == 1) | (F.col("bytes_so_far") <= max_bytes))
    return within.withColumn("text", shrink_to(F.col("text"), max_bytes))


def shrink_to(text: Column, max_bytes: int) -> Column:
    """Drop the last tenth again and again until the UTF-8 size fits."""
    # as many tenths as it can take down to the limit at four bytes a character, and some for rounding
    steps = F.ceil(F.log(F.greatest(4 * F.length(text), F.lit(2)) / F.lit(max(1, max_bytes))) / F.lit(math.log(1 / 0.9))).cast("int") + F.lit(8)
    fold = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
        text,
        lambda t, _: F.when(F.octet_length(t) <= max_bytes, t).otherwise(
            F.substring(t, F.lit(1), F.floor(F.length(t) * 0.9).cast("int"))
        ),
    )
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(fold)


def vault_list(docs: DataFrame) -> DataFrame:
    """Metadata only; the text column never leaves."""
    return docs.select("owner_id", "doc_id", "doc_name", "format", "extracted_at",
                       F.char_length("text").cast("long").alias("char_count"))


def vault_purge(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profile entries without document markers, and how many were removed per user."""
    marked = F.startswith("key", F.lit(rules.DOC_SOURCE_PREFIX))
    kept = entries.filter(~marked)
    removed = entries.groupBy("user_id").agg(F.count_if(marked).alias("removed"))
    return kept, removed


def vault_contains(claims: DataFrame, vault: DataFrame) -> DataFrame:
    """Claims whose value (two or more characters) appears in a stored text of the same owner.

    ``vault`` must be the retained vault: at most five documents and 256 KB per owner, so a
    claim meets at most five texts however many claims an owner has.
    """
    needle = F.lower(trim(F.col("value")))
    asked = claims.withColumn("__needle", needle).filter(F.length("__needle") >= 2)
    distinct = asked.select("owner_id", "__needle").distinct()
    folded = vault.select("owner_id", F.lower("text").alias("__text"))
    found = distinct.join(
        folded, (distinct["owner_id"] == folded["owner_id"]) & F.contains(F.col("__text"), F.col("__needle")), "left_semi"
    )
    return asked.join(found.hint("merge"), ["owner_id", "__needle"], "left_semi").drop("__needle")


def vault_contains_all(claims: DataFrame, vault: DataFrame) -> DataFrame:
    """As ``vault_contains``, over a vault of any number and length of texts per owner (no retention)."""
    asked = claims.withColumn("__needle", F.lower(trim(F.col("value")))).filter(F.length("__needle") >= 2)
    folded = vault.select("owner_id", F.lower("text").alias("__text"))
    found = found_in_long(folded, asked, ["owner_id"], "__text", "__needle")
    return asked.join(found.hint("merge"), ["owner_id", "__needle"], "left_semi").drop("__needle")
