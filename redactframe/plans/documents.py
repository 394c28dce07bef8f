"""Queries: ingest rules, retrieval, vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions.text import capitals
from redactframe.operators import documents as D
from redactframe.plans import sqltext as q
from redactframe.plans.registry import query
from redactframe.sources import files
from redactframe.sources.shapes import cte
from redactframe.sources.tables import derived, table

_EXT = f"{q.trim('lower(CASE WHEN contains(name, chr(46)) THEN regexp_extract(name, ' + q.lit(r'[.]([^.]*)$') + ', 1) ELSE chr(32) END)')}"
FORMAT_SQL = (
    "coalesce(CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN '{f}'" for e, f in rules.EXTENSION_FORMATS) + " END, CASE "
    + " ".join(f"WHEN lower(mime_type) = '{m}' THEN '{f}'" for m, f in rules.MIME_FORMATS)
    + " WHEN starts_with(lower(mime_type), 'text/') THEN 'text' END)"
)


@query("format_detect", oracle=f"{cte('files')} SELECT file_id, name, {FORMAT_SQL} AS format FROM files")
def format_detect(spark, sf):
    return derived(spark, sf, "files").select("file_id", "name", D.doc_format(F.col("name"), F.col("mime_type")).alias("format"))


REJECT_SQL = f"""CASE WHEN coalesce(length(payload), 0) = 0 THEN 'NO_FILE' WHEN {FORMAT_SQL} IS NULL THEN 'UNSUPPORTED' WHEN n_bytes = 0 THEN 'EMPTY'
 WHEN n_bytes > 15728640 THEN 'TOO_LARGE' WHEN text_chars > 60000 THEN 'STRUCTURE_TOO_LARGE' WHEN NOT coalesce(consented, false) THEN 'STRUCTURE_CONSENT_REQUIRED' END"""


@query("ingest_rejects", oracle=f"{cte('files')} SELECT file_id, reject_code FROM (SELECT file_id, {REJECT_SQL} AS reject_code FROM files) WHERE reject_code IS NOT NULL")
def ingest_rejects(spark, sf):
    return D.split_ingest(derived(spark, sf, "files"))[1].select("file_id", "reject_code")


@query("ingest_accepted", oracle=f"{cte('files')} SELECT file_id, name FROM files WHERE {REJECT_SQL} IS NULL")
def ingest_accepted(spark, sf):
    return D.split_ingest(derived(spark, sf, "files"))[0].select("file_id", "name")


@query("needs_ocr", oracle="SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) < 50 AS needs_ocr FROM documents")
def needs_ocr(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.needs_ocr(F.col("text")).alias("needs_ocr"))


def _ingested(rows):
    accepted, rejected = files.ingest_bytes(rows)
    return accepted.select("name", "format", F.lit(None).cast("string").alias("reject_code"), "needs_ocr", F.md5(F.encode("text", "UTF-8")).alias("text_md5")).unionByName(
        rejected.select("name", "format", "reject_code", F.lit(None).cast("boolean").alias("needs_ocr"), F.lit(None).cast("string").alias("text_md5")))


def _ingested_sql(text: str, code: str, format_: str, name: str, source: str) -> str:
    return f"""WITH f AS (SELECT {name} AS name, {format_} AS format, {code} AS reject_code, {text} AS t FROM {source})
 SELECT name, format, reject_code, CASE WHEN reject_code IS NULL THEN length(regexp_replace(t, '\\s', '', 'g')) < 50 END AS needs_ocr,
  CASE WHEN reject_code IS NULL THEN md5(t) END AS text_md5 FROM f"""


# Every document as a file: half of them with a byte order mark, a third with a malformed byte at the end.
@query("ingest_text", oracle=_ingested_sql(
    "text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END", "CASE WHEN coalesce(text, '') = '' AND (text IS NULL OR doc_id % 2 <> 0 AND doc_id % 3 <> 0) THEN 'EMPTY' END",
    "['text', 'md', 'csv', 'json'][doc_id % 4 + 1]", "doc_id || ['.txt', '.md', '.csv', '.json'][doc_id % 4 + 1]", "documents"))
def ingest_text(spark, sf):
    return _ingested(table(spark, sf, "documents").selectExpr(
        "concat('in/', doc_id, array('.txt', '.md', '.csv', '.json')[int(doc_id % 4)]) AS path",
        "concat(CASE WHEN doc_id % 2 = 0 THEN X'EFBBBF' ELSE X'' END, encode(text, 'UTF-8'), CASE WHEN doc_id % 3 = 0 THEN X'FF' ELSE X'' END) AS content"))


def _word_files(batches):
    """Each text as a DOCX file, a paragraph a line and two runs a paragraph; every fiftieth is no archive, another lacks its document part."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def run(text):
        return f'<w:r><w:t xml:space="preserve">{escape(text, {chr(13): "&#13;"})}</w:t></w:r>'

    def file(doc_id, text):
        if doc_id % 50 == 7:
            return text.encode()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            body = "".join(f"<w:p>{run(x[:len(x) // 2])}{run(x[len(x) // 2:])}</w:p>" for x in text.split("\n"))
            z.writestr("word/other.xml" if doc_id % 50 == 9 else "word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    for batch in batches:
        yield batch[["path"]].assign(content=[file(d, t) for d, t in zip(batch["doc_id"], batch["text"])])


_TIDY = q.trim("regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")


@query("ingest_docx", oracle=_ingested_sql(
    _TIDY, "CASE WHEN doc_id % 50 = 7 THEN CASE WHEN text = '' THEN 'EMPTY' ELSE 'DOCX_UNREADABLE' END WHEN doc_id % 50 = 9 THEN 'DOCX_NO_DOCUMENT' "
    "WHEN regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]') THEN 'DOCX_UNREADABLE' END",
    "'docx'", "doc_id || '.docx'", "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"))
def ingest_docx(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "concat('in/', doc_id, '.docx') AS path", "coalesce(text, '') AS text")
    return _ingested(rows.mapInPandas(_word_files, "path string, content binary"))


_STOP = "[" + ", ".join(q.lit(w) for w in rules.STOPWORDS) + "]"
KEYWORDS_SQL = f"""SELECT item_id AS query_id, w AS keyword, min(i) AS first_at FROM (SELECT item_id, l[i] AS w, i FROM (
  SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id, string_split_regex(lower(text), '[^a-z0-9]+') AS l FROM benchmark)))
  WHERE length(w) >= 3 AND NOT list_contains({_STOP}, w) GROUP BY item_id, w"""


@query("keywords", oracle=f"WITH k AS ({KEYWORDS_SQL}) SELECT query_id, string_agg(keyword, ' ' ORDER BY first_at) AS keywords FROM k GROUP BY query_id")
def keywords(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array_join(D.keywords(F.col("text")), " ").alias("keywords")
    ).filter("keywords <> ''")


# RE2 has no look-around: a marker goes between the end mark and the capital, twice for one-letter neighbours.
_MARK = "regexp_replace({x}, '([.!?])\\s+([A-Z0-9])', concat('\\1', chr(1), '\\2'), 'g')"
_CUT = _MARK.format(x=_MARK.format(x="s"))
SENTENCES_SQL = f"""WITH l AS (SELECT doc_id, i, {q.trim('l[i]')} AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM
   (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents))),
 p AS (SELECT doc_id, i, CASE WHEN length(s) <= 400 THEN [s] ELSE string_split({_CUT}, chr(1)) END AS parts FROM l WHERE s <> ''),
 e AS (SELECT doc_id, i, j, {q.trim('parts[j]')} AS sentence FROM (SELECT doc_id, i, parts, unnest(range(1, len(parts) + 1)) AS j FROM p)),
 sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS sent_idx, sentence FROM e WHERE sentence <> '')"""


@query("sentences", oracle=f"{SENTENCES_SQL} SELECT doc_id, sent_idx, sentence FROM sents")
def sentences(spark, sf):
    return D.sentences(table(spark, sf, "documents")).withColumn("sent_idx", F.col("sent_idx").cast("long"))


def clip_sql(x: str) -> str:
    s = q.collapse(x)
    cut = f"substr({s}, 1, 400)"
    back = f"instr(reverse({cut}), ' ')"
    return (f"CASE WHEN length({s}) <= 400 THEN {s} ELSE concat(CASE WHEN {back} > 0 AND 400 - {back} > 240 THEN substr({cut}, 1, 400 - {back}) ELSE {cut} END, '…') END")


TOPK_SQL = f"""{SENTENCES_SQL}, k AS ({KEYWORDS_SQL}),
 scored AS (SELECT k.query_id, s.doc_id, s.sent_idx, s.sentence, count(*) AS score FROM sents s JOIN k ON contains(lower(s.sentence), k.keyword) GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, sent_idx) AS rank FROM scored)
 SELECT query_id, doc_id, sent_idx, score, rank, {clip_sql('sentence')} AS snippet FROM ranked WHERE rank <= 8"""


@query("topk_snippets", oracle=TOPK_SQL)
def topk_snippets(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return D.top_snippets(table(spark, sf, "documents"), asked, k=8)


VAULT_BASE = ("SELECT source AS owner_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE concat('Doc ', cast(doc_id AS varchar(20))) END AS doc_name, "
              "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'pdf ' END AS format, (doc_id * 7919) % 1000003 AS extracted_at, text FROM documents")
STORE_SQL = f"""SELECT owner_id, doc_id, extracted_at, coalesce(nullif(substr({q.trim('doc_name')}, 1, 160), ''), 'upload') AS doc_name,
  coalesce(nullif(substr({q.trim("coalesce(format, 'text')")}, 1, 32), ''), 'text') AS format, {q.scrub('text')} AS text FROM ({VAULT_BASE}) WHERE {q.trim('text')} <> ''"""


def _vault_input(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "source AS owner_id", "doc_id",
        "CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE concat('Doc ', cast(doc_id AS varchar(20))) END AS doc_name",
        "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'pdf ' END AS format",
        "(doc_id * 7919) % 1000003 AS extracted_at", "text",
    )


@query("vault_store", oracle=STORE_SQL)
def vault_store(spark, sf):
    return D.vault_store(_vault_input(spark, sf))


def retention_sql(src: str, max_bytes: int) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY extracted_at DESC, doc_id DESC) AS age_rank FROM {src} WHERE length(text) > 0),
 b AS (SELECT *, sum(strlen(text)) OVER (PARTITION BY owner_id ORDER BY age_rank) AS so_far FROM r WHERE age_rank <= 5),
 w AS (SELECT * FROM b WHERE age_rank = 1 OR so_far <= {max_bytes})"""


@query("vault_retention", oracle=f"""WITH RECURSIVE v AS ({VAULT_BASE}), {retention_sql('v', 20000)},
 cut AS (SELECT owner_id, doc_id, text FROM w UNION ALL
   SELECT owner_id, doc_id, substr(text, 1, cast(floor(length(text) * 0.9) AS BIGINT)) FROM cut WHERE strlen(text) > 20000)
 SELECT c.owner_id, c.doc_id, w.age_rank, c.text FROM cut c JOIN w ON w.owner_id = c.owner_id AND w.doc_id = c.doc_id WHERE strlen(c.text) <= 20000""")
def vault_retention(spark, sf):
    kept = D.vault_retention(_vault_input(spark, sf), max_bytes=20000)
    return kept.select("owner_id", "doc_id", F.col("age_rank").cast("long").alias("age_rank"), "text")


@query("vault_list", oracle=f"SELECT owner_id, doc_id, doc_name, format, extracted_at, cast(length(text) AS BIGINT) AS char_count FROM ({STORE_SQL})")
def vault_list(spark, sf):
    return D.vault_list(D.vault_store(_vault_input(spark, sf)))


@query("vault_purge", oracle=f"{cte('profile_entries')} SELECT user_id, count(*) FILTER (starts_with(key, '_docSource')) AS removed FROM profile_entries GROUP BY user_id")
def vault_purge(spark, sf):
    return D.vault_purge(derived(spark, sf, "profile_entries"))[1]


@query("vault_contains", oracle=f"""WITH v AS ({VAULT_BASE}), {retention_sql('v', rules.VAULT_MAX_BYTES)},
 c AS (SELECT doc_id AS claim_id, source AS owner_id, CASE WHEN doc_id % 3 = 0 THEN ' x ' ELSE upper(substr(text, 1 + doc_id % 20, 4 + doc_id % 5)) END AS value FROM documents)
 SELECT claim_id, owner_id, value FROM c WHERE length({q.trim('value')}) >= 2 AND EXISTS (SELECT 1 FROM w WHERE w.owner_id = c.owner_id AND contains(lower(w.text), lower({q.trim('c.value')})))""")
def vault_contains(spark, sf):
    return D.vault_contains(_claims(spark, sf), D.vault_retention(_vault_input(spark, sf))).select("claim_id", "owner_id", "value")


def _claims(spark, sf):
    part = F.expr("substr(text, cast(1 + doc_id % 20 AS int), cast(4 + doc_id % 5 AS int))")
    value = F.when(F.col("doc_id") % 3 == 0, " x ").otherwise(capitals(part))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.col("source").alias("owner_id"), value.alias("value"))


@query("vault_contains_all", oracle=f"""WITH c AS (SELECT doc_id AS claim_id, source AS owner_id, CASE WHEN doc_id % 3 = 0 THEN ' x ' ELSE upper(substr(text, 1 + doc_id % 20, 4 + doc_id % 5)) END AS value FROM documents)
 SELECT claim_id, owner_id, value FROM c WHERE length({q.trim('value')}) >= 2 AND EXISTS (SELECT 1 FROM documents w WHERE w.source = c.owner_id AND contains(lower(w.text), lower({q.trim('c.value')})))""")
def vault_contains_all(spark, sf):
    """Claims against every document of their owner."""
    return D.vault_contains_all(_claims(spark, sf), _vault_input(spark, sf)).select("claim_id", "owner_id", "value")


@query("small_images", oracle=f"{cte('image_headers')} SELECT image_id, true_width AS width, true_height AS height FROM image_headers WHERE kind <> 'gif' AND (true_width < 28 OR true_height < 28)")
def small_images(spark, sf):
    """Image headers built from table values; the sizes must come back out of the bytes."""
    hex_of = lambda c, n: F.lpad(F.hex(c), n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex_of("true_width", 8), hex_of("true_height", 8), F.lit("0802000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC4000500FFC0001108"), hex_of("true_height", 4), hex_of("true_width", 4), F.lit("03011100021101"))
    body = F.unhex(F.when(F.col("kind") == "png", png).when(F.col("kind") == "jpeg", jpeg).otherwise("474946383961FFFF"))
    images = derived(spark, sf, "image_headers").select("image_id", body.alias("content"))
    return files.degenerate_images(images).select("image_id", "width", "height")
