"""Profile records: extraction from text, validation, normalisation, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactframe import rules
from redactframe.functions.checksums import luhn_valid, verhoeff_valid
from redactframe.functions.text import collapse, digits, jvm_regex, let, lines, matches, trim
from redactframe.operators.detect import is_never_store_key, is_never_store_value
from redactframe.operators.fields import clean_label, resolve_label_expr


def _forbidden(key: Column, value: Column) -> Column:
    return is_never_store_key(key, rules.PROFILE_NEVER_STORE_KEY) | is_never_store_value(value)


def clip_value(value: Column) -> Column:
    cap = rules.CLIP_PROFILE_VALUE_CHARS
    return F.when(F.length(value) > cap, F.concat(F.substring(value, 1, cap - 3), F.lit("..."))).otherwise(value)


def _first_per_key(entries: Column) -> Column:
    """Entries (key, rank, value) in key order, only the lowest rank of each key; n log n in a row's entries."""
    return let(F.array_sort(entries), lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["key"] != e["key"])))


def label_entries(text: Column, kyc: bool = False) -> Column:
    """``Label: value`` lines of a text as ARRAY<STRUCT<key, rank, value>>, the first line per key.

    Every step maps one array to the next, so each line is looked at once and nothing leaves the row. Lines and values
    beyond the rules' lengths are no profile entries.
    """
    cut = F.filter(F.transform(lines(text), trim), lambda x: (
        (x != "") & (F.length(x) <= rules.MAX_PROFILE_LINE_CHARS) & ~x.rlike(r"^\||^#{1,6}\s|^---+$")))
    plain = F.filter(F.transform(cut, lambda x: trim(F.regexp_replace(x, r"[*_]", ""))), lambda x: x.rlike(rules.LABEL_VALUE_LINE))
    pairs = F.transform(plain, lambda x, i: F.struct(
        clean_label(F.regexp_extract(x, rules.LABEL_VALUE_LINE, 1)).alias("label"), i.alias("rank"),
        collapse(F.regexp_extract(x, rules.LABEL_VALUE_LINE, 2)).alias("value")))

    def usable(e: Column) -> Column:
        fits = (e["label"] != "") & (e["value"] != "") & (F.length(e["value"]) <= rules.MAX_PROFILE_VALUE_CHARS)
        allowed = F.lit(True) if kyc else ~matches(e["label"], rules.SKIP_LABELS, True) & ~_forbidden(e["label"], e["value"])
        return fits & allowed & ~matches(e["label"], rules.NOISE_LABELS, True)

    named = F.transform(F.filter(pairs, usable), lambda e: F.struct(
        F.coalesce(resolve_label_expr(e["label"]), e["label"]).alias("key"), e["rank"].alias("rank"), clip_value(e["value"]).alias("value")))
    return _first_per_key(named)


def _exploded(docs: DataFrame, key: str, entries: Column, kyc: bool) -> DataFrame:
    out = docs.select(key, F.explode(entries).alias("e")).select(key, "e.key", "e.value")
    return out if kyc else out.filter(~_forbidden(F.col("key"), F.col("value")))


def label_values(docs: DataFrame, kyc: bool = False, key: str = "doc_id") -> DataFrame:
    """``Label: value`` lines as (key, profile key, value); the first line per key wins, no shuffle.

    Labels that resolve to no profile key are kept under their own text. ``kyc=True`` lets
    identifiers through.
    """
    return _exploded(docs, key, label_entries(F.col("text"), kyc), kyc)


def _cue(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_extract(text, jvm_regex(pattern, ignore_case), 1)


def _entries(pairs: list[tuple[str, Column]]) -> Column:
    made = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.filter(made, lambda e: F.coalesce(e["value"], F.lit("")) != "")


def cue_entries(text: Column) -> Column:
    """First match of every cue as ARRAY<STRUCT<key, value>>, identifiers included."""
    values = {k: _cue(text, p, ci) for k, ci, p in rules.CUE_PATTERNS}
    values["email"] = F.when(F.contains(text, F.lit("@")), values["email"])
    never = dict(rules.NEVER_STORE_VALUES)
    nid = F.regexp_replace(F.regexp_extract(text, jvm_regex(never["AADHAAR"]), 0), r"\s", "")
    name = trim(F.regexp_replace(values["fullName"], "(?i)" + rules.CUE_NAME_NOISE, ""))
    values["phone"] = F.right(digits(values["phone"]), F.lit(10))
    values["fullName"] = let(name, lambda n: F.when(F.length(n) >= 3, n))
    values["city"] = trim(F.regexp_replace(values["city"], "(?i)" + rules.CUE_CITY_NOISE, ""))
    for k in ("state", "college", "diagnosis"):
        values[k] = trim(values[k])
    values["bankAccount"] = let(values["bankAccount"], lambda a: F.when(luhn_valid(a), a))
    pairs = [("aadhaar", let(nid, lambda n: F.when(verhoeff_valid(n), n))), ("pan", F.regexp_extract(text, jvm_regex(never["PAN"]), 0))]
    return _entries(pairs + list(values.items()))


def cue_fields(docs: DataFrame, kyc: bool = False, key: str = "doc_id") -> DataFrame:
    """Cue extraction to long rows; no shuffle, one pass over the text."""
    out = docs.select(key, F.explode(cue_entries(F.col("text"))).alias("e")).select(
        key, "e.key", clip_value(F.col("e.value")).alias("value")
    )
    return out if kyc else out.filter(~_forbidden(F.col("key"), F.col("value")))


def indic_entries(text: Column) -> Column:
    """Spoken Hindi and Hinglish cues for name, city and e-mail."""
    def either(a: str, b: str) -> Column:
        first = trim(_cue(text, a, False))
        return F.coalesce(let(first, lambda v: F.when(v != "", v)), trim(_cue(text, b)))

    name = trim(F.regexp_replace(either(rules.INDIC_NAME, rules.INDIC_NAME_LATIN), "(?i)" + rules.INDIC_NAME_NOISE, ""))
    city = trim(F.regexp_replace(either(rules.INDIC_CITY, rules.INDIC_CITY_LATIN), "(?i)" + rules.INDIC_CITY_NOISE, ""))
    return _entries([("fullName", let(name, lambda n: F.when(F.length(n) >= 2, n))), ("city", city),
                     ("email", _cue(text, rules.INDIC_EMAIL, False))])


def indic_cues(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.explode(indic_entries(F.col("text"))).alias("e")).select(key, "e.key", "e.value")


def json_entries(text: Column, kyc: bool = False) -> Column:
    """Entries of a JSON-object text as ARRAY<STRUCT<key, rank, value>>; empty for any other text."""
    raw = F.filter(F.transform(F.map_entries(_as_map(text)), lambda e, i: F.struct(
        e["key"].alias("raw"), i.alias("rank"), trim(e["value"]).alias("value"))), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    kept = raw if kyc else F.filter(raw, lambda e: ~_forbidden(e["raw"], e["value"]))
    own = lambda e: F.coalesce(F.nullif(clean_label(e["raw"]), F.lit("")), e["raw"])
    named = F.transform(kept, lambda e: F.struct(F.coalesce(resolve_label_expr(e["raw"]), own(e)).alias("key"), e["rank"].alias("rank"), e["value"].alias("value")))
    return F.coalesce(_first_per_key(named), F.array().cast("array<struct<key:string,rank:int,value:string>>"))


def extract_profile(docs: DataFrame, kyc: bool = False, key: str = "doc_id") -> DataFrame:
    """Entries of a JSON object; of any other text cues, then spoken cues, then label lines, the earlier stage wins per key.

    Everything of a document comes out of its own row: one scan, no shuffle.
    """
    text = F.col("text")
    ranked = lambda entries, rank: F.transform(entries, lambda e: F.struct(
        e["key"].alias("key"), F.lit(rank).alias("rank"), clip_value(e["value"]).alias("value")))
    labelled = label_entries(text, kyc)
    labelled = labelled if kyc else F.filter(labelled, lambda e: ~_forbidden(e["key"], e["value"]))
    staged = _first_per_key(F.concat(ranked(cue_entries(text), 0), ranked(indic_entries(text), 1), ranked(labelled, 2)))
    entries = let(F.when(F.startswith(trim(text), F.lit("{")), json_entries(text, kyc)), lambda j: F.when(F.size(j) > 0, j).otherwise(staged))
    return _exploded(docs, key, entries, kyc)


def display_fields(entries: DataFrame) -> DataFrame:
    """Entries under the labels that people read; forbidden and blank ones go. Other columns pass."""
    labels = F.create_map(*[F.lit(x) for pair in rules.PROFILE_LABELS.items() for x in pair])
    kept = entries.filter(~_forbidden(F.col("key"), F.col("value"))).withColumn("value", trim(F.col("value"))).filter("value <> ''")
    return kept.withColumn("key", F.coalesce(F.try_element_at(labels, F.col("key")), F.col("key")))


_MAP = T.MapType(T.StringType(), T.StringType())


def _as_map(text: Column) -> Column:
    """JSON object text as a map; null for anything that is not an object."""
    return F.when(trim(text).startswith("{"), F.from_json(text, _MAP))


def json_profiles(raw: DataFrame, text: str, user: str = "user_id") -> DataFrame:
    """Entries of JSON-object profiles under their resolved keys, forbidden ones dropped."""
    entries = raw.select(user, F.posexplode(F.map_entries(_as_map(F.col(text)))).alias("pos", "e")).select(
        user, "pos", F.col("e.key").alias("raw_key"), trim(F.col("e.value")).alias("value"))
    kept = entries.filter((F.col("value") != "") & ~_forbidden(F.col("raw_key"), F.col("value")))
    own = F.coalesce(F.nullif(clean_label(F.col("raw_key")), F.lit("")), F.col("raw_key"))
    named = kept.withColumn("key", F.coalesce(resolve_label_expr(F.col("raw_key")), own))
    first = named.groupBy(user, "key").agg(F.min_by("value", "pos").alias("value"))
    return first.filter(~is_never_store_key(F.col("key"), rules.PROFILE_NEVER_STORE_KEY))


_PAIR = r"^\s*([^:]+?)\s*:\s*(.+?)\s*$"


def normalize_profile(raw: DataFrame, text: str, user: str = "user_id") -> DataFrame:
    """Any saved profile shape to long rows: JSON object, ``key: value`` lines, or one raw note.

    JSON that is not an object gives no rows; so do null and blank texts.
    """
    t = trim(F.col(text))
    parsed = F.from_json(t, _MAP)
    rows = F.filter(F.transform(lines(t), trim), lambda s: s != "")
    pairs = F.forall(rows, lambda s: s.rlike(_PAIR))
    is_json = F.expr("try_parse_json(__t)").isNotNull()
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = (
        F.when((F.col("__t") == "") | F.col("__t").isNull(), none)
        .when(F.startswith("__t", F.lit("{")) & parsed.isNotNull(),
              F.filter(F.transform(F.map_entries(parsed), lambda e: entry(e["key"], e["value"])), lambda e: e["value"].isNotNull()))
        .when(is_json, none)
        .when(pairs, F.transform(rows, lambda s: entry(F.regexp_extract(s, _PAIR, 1), F.regexp_extract(s, _PAIR, 2))))
        .otherwise(F.array(entry(F.lit("raw"), F.col("__t"))))
    )
    long = raw.withColumn("__t", t).select(user, F.posexplode(entries).alias("pos", "e"))
    return long.groupBy(user, F.col("e.key").alias("key")).agg(F.max_by("e.value", "pos").alias("value"))


def parse_profile(raw: DataFrame, text: str, user: str = "user_id") -> DataFrame:
    """Stricter form of the same input, with an error column instead of silent loss."""
    t = trim(F.coalesce(F.col(text), F.lit("")))
    parsed = F.from_json("__t", _MAP)
    jsonish = F.col("__t").rlike(r"^[\[{]")
    rows = F.filter(F.transform(F.split("__t", "\n"), trim), lambda s: s != "")
    all_pairs = F.forall(rows, lambda s: F.contains(s, F.lit(":")))
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    made = F.filter(
        F.transform(rows, lambda s: entry(trim(F.substring_index(s, ":", 1)),
                                          trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))))),
        lambda e: e["key"] != "",
    )
    entries = (
        F.when(jsonish, F.transform(F.map_entries(parsed), lambda e: entry(e["key"], e["value"])))
        .when(all_pairs, made)
        .otherwise(F.array(entry(F.lit("notes"), F.col("__t"))))
    )
    error = (
        F.when(F.startswith("__t", F.lit("[")), F.when(F.expr("try_parse_json(__t)").isNull(), "INVALID_JSON").otherwise("NOT_AN_OBJECT"))
        .when(jsonish & parsed.isNull(), "INVALID_JSON")
        .when(F.col("__t") == "", "EMPTY")
        .when(~jsonish & all_pairs & (F.size(made) == 0), "UNPARSEABLE")
    )
    base = raw.withColumn("__t", t).select(user, error.alias("error"), entries.alias("entries"))
    bad = base.filter("error IS NOT NULL").select(
        user, "error", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    good = (
        base.filter("error IS NULL").select(user, F.posexplode("entries").alias("pos", "e"))
        .groupBy(user, F.col("e.key").alias("key")).agg(F.max_by("e.value", "pos").alias("value"))
        .select(user, F.lit(None).cast("string").alias("error"), "key", "value")
    )
    return bad.unionByName(good)


def validate_fields(entries: DataFrame, max_fields: int = rules.MAX_STRUCT_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Structured output guard on long rows (doc_id, pos, key, value, value_type).

    Keeps the first ``max_fields`` distinct valid keys of a document in order and reports
    kept, dropped and total. The cap is a pruned rank over one row per key, so a document
    with very many entries is not gathered in one task.
    """
    from pyspark.sql import Window

    key, value = trim(F.col("key")), trim(F.col("value"))
    valid = entries.withColumn("key", key).withColumn("value", value).filter(
        (F.col("key") != "") & (F.length("key") <= rules.MAX_STRUCT_KEY_CHARS)
        & ~is_never_store_key(F.col("key")) & (F.col("value_type") == "string")
        & (F.col("value") != "") & (F.length("value") <= rules.MAX_STRUCT_VALUE_CHARS)
        & ~is_never_store_value(F.col("value"))
    )
    first_seen = valid.groupBy("doc_id", "key").agg(F.min("pos").alias("first_pos"))
    admitted = first_seen.withColumn(
        "n", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos"))
    ).filter(F.col("n") <= max_fields)
    cut = admitted.filter(F.col("n") == max_fields).select("doc_id", F.col("first_pos").alias("cut_pos"))
    accepted = (
        valid.join(admitted.select("doc_id", "key", "first_pos"), ["doc_id", "key"])
        .join(cut, "doc_id", "left")
        .filter(F.col("cut_pos").isNull() | (F.col("pos") <= F.col("cut_pos")))
    )
    kept = accepted.groupBy("doc_id", "key").agg(
        F.max_by("value", "pos").alias("value"), F.min("first_pos").alias("first_pos"), F.count("*").alias("used"))
    totals = entries.groupBy("doc_id").agg(F.count("*").alias("total"))
    used = kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("used").alias("used"))
    report = totals.join(used, "doc_id", "left").select(
        "doc_id", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("total") - F.coalesce("used", F.lit(0))).alias("dropped"), "total")
    return kept.select("doc_id", "key", "value", "first_pos"), report


def normalize_value(key: Column, value: Column) -> Column:
    """Dates of birth to ISO, gender words to one of three; everything else trimmed."""
    v = trim(value)
    low = F.lower(v)
    dmy = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
    iso = F.concat_ws("-", F.regexp_extract(v, dmy, 3), F.lpad(F.regexp_extract(v, dmy, 2), 2, "0"),
                      F.lpad(F.regexp_extract(v, dmy, 1), 2, "0"))
    gender = (
        F.when(low.rlike("^(m|male|man)$"), "male")
        .when(low.rlike("^(f|female|woman)$"), "female")
        .when(low.rlike("^(o|other|non-?binary)$"), "other")
        .otherwise(v)
    )
    return F.when((key == "dob") & v.rlike(dmy), iso).when(key == "gender", gender).otherwise(v)


def flatten_alias(key: Column) -> Column:
    """Display label to canonical key through the fixed alias table; unknown labels stay."""
    table = F.create_map(*[F.lit(x) for kv in rules.POPUP_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(table, trim(F.lower(key))), key)


ORIGIN_PRIORITY = {"extracted": 1, "popup": 2, "stored": 3}


def merge_profiles(entries: DataFrame) -> DataFrame:
    """One value per user and key: stored beats popup beats extracted, then the later entry."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ORIGIN_PRIORITY.items() for x in kv]), F.col("origin"))
    return (
        entries.filter(F.coalesce("value", F.lit("")) != "")
        .withColumn("key", flatten_alias(F.col("key")))
        .groupBy("user_id", "key")
        .agg(F.max_by(F.struct("value", "origin"), F.struct(rank, "entry_idx")).alias("w"))
        .select("user_id", "key", "w.value", "w.origin")
    )


def harvest_upsert(profile: DataFrame, harvested: DataFrame, skipped: DataFrame, now: int) -> DataFrame:
    """Values found in page controls overwrite the profile; skipped keys never enter.

    ``profile``: user_id, key, value, updated_at. ``harvested``: user_id, key, value, field_idx.
    """
    fresh = harvested.filter(F.length(trim(F.col("value"))) >= 2).join(skipped, ["user_id", "key"], "left_anti")
    last = fresh.groupBy("user_id", "key").agg(
        F.max_by(trim(F.col("value")), "field_idx").alias("new_value"),
        F.min(trim(F.col("value"))).alias("lo"), F.max(trim(F.col("value"))).alias("hi"),
    )
    joined = profile.join(last, ["user_id", "key"], "full")
    unchanged = F.col("new_value").isNull() | (
        F.col("value").isNotNull() & (F.col("lo") == F.col("value")) & (F.col("hi") == F.col("value")))
    return joined.select(
        "user_id", "key", F.coalesce("new_value", "value").alias("value"),
        F.when(unchanged, F.col("updated_at")).otherwise(F.lit(now)).alias("updated_at"),
    )


def profile_stats(entries: DataFrame) -> DataFrame:
    shown = entries.filter(F.col("key") != "_skipped")
    return shown.groupBy("user_id").agg(
        F.count_if(trim(F.coalesce("value", F.lit(""))) != "").alias("n_fields"), F.max("updated_at").alias("last_updated"))
