"""Model replies, action validation, and session analytics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactframe import rules
from redactframe.functions import urls
from redactframe.functions.ordered import running_totals, with_previous
from redactframe.functions.text import matches, round_half_up, trim

@F.pandas_udf(T.ArrayType(T.StringType()))
def json_candidates(replies: pd.Series) -> pd.Series:
    """Balanced {...} runs of each reply, the fenced block first, curly quotes also straightened.

    Brackets inside JSON strings make this a state scan, which no regular expression can do.
    """
    import re

    fence = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.IGNORECASE)
    mark = re.compile(r'["\\{}]')
    curly = re.compile("[“”‘’]")

    def runs(text: str) -> list[str]:
        out, depth, start, quoted, skip = [], 0, 0, False, -1
        for m in mark.finditer(text):
            at, ch = m.start(), m.group()
            if at == skip:
                continue
            if ch == "\\":
                if quoted:
                    skip = at + 1
            elif ch == '"':
                quoted = not quoted
            elif not quoted and ch == "{":
                start = at if depth == 0 else start
                depth += 1
            elif not quoted and depth:
                depth -= 1
                if depth == 0:
                    out.append(text[start : at + 1])
        return out

    def one(reply):
        if reply is None or not reply.strip():
            return []
        fenced = fence.search(reply)
        found = (runs(fenced.group(1)) if fenced else []) + runs(reply)
        return [v for s in found for v in dict.fromkeys((s, curly.sub('"', s)))]

    return replies.map(one)


def _field(a, name: str) -> Column:
    return a[name] if a is not None else F.col(name)


def reject_reason(a: Column | None = None) -> Column:
    """Why an action may not run, or null. ``a`` is an action struct; by default the row's columns."""
    f = lambda n: _field(a, n)
    sel, blank = trim(f("selector")), lambda c: F.coalesce(trim(c), F.lit("")) == ""
    inside = f("x").between(0, rules.ACTION_COORD_MAX) & f("y").between(0, rules.ACTION_COORD_MAX)
    act = f("action")
    click = (
        F.when(~blank(f("selector")), None)
        .when(~blank(f("text")), None)
        .when(f("x").isNull() | f("y").isNull(), "NO_TARGET")
        .when(~inside, "BAD_COORDINATES")
    )
    typed = (
        F.when(f("selector").isNull() | f("value").isNull(), "MISSING_FIELD")
        .when((sel == "") | (F.length(sel) > rules.ACTION_SELECTOR_CHARS) | ~sel.rlike(rules.SELECTOR_SAFE), "BAD_SELECTOR")
        .when(F.length(f("value")) > rules.ACTION_VALUE_CHARS, "VALUE_TOO_LONG")
    )
    navigate = F.when(
        f("url").isNull() | (F.length(f("url")) > rules.ACTION_URL_CHARS)
        | ~F.coalesce(urls.scheme(f("url")).isin("http", "https"), F.lit(False)) | urls.host(f("url")).isNull(), "BAD_URL")
    code = F.when(F.coalesce(f("code"), f("value"), F.lit("")) == "", "EMPTY_CODE")
    needs_selector = F.when(f("selector").isNull(), "MISSING_FIELD")
    return (
        F.when(act.isNull(), "NO_ACTION")
        .when(act == "click", click)
        .when(act == "type", typed)
        .when(act == "fill_many", F.when(~F.coalesce(f("n_fields") > 0, F.lit(False)), "NO_FIELDS"))
        .when(act == "fill", F.when(~F.coalesce(f("n_attempts") > 0, F.lit(False)), "NO_FIELDS"))
        .when(act == "write_code", code)
        .when(act == "scroll", F.when(~F.coalesce(f("direction").isin("up", "down"), F.lit(False)), "BAD_DIRECTION"))
        .when(act == "navigate", navigate)
        .when(act.isin("done", "key_press", "wait"), None)
        .when(act.isin("hover", "extract_text", "clear", "focus", "select"), needs_selector)
        .otherwise("UNKNOWN_ACTION")
    )


def canonical_action(action: Column) -> Column:
    """Off-schema spelling of a single fill becomes ``type``; the same checks then apply."""
    return F.when(action == "fill_field", "type").otherwise(action)


def validate_actions(actions: DataFrame) -> DataFrame:
    """Verdict and cleaned fields of every action; rejected rows keep their reason."""
    d = actions.withColumn("action", canonical_action(F.col("action")))
    for count in ("n_fields", "n_attempts"):
        d = d if count in d.columns else d.withColumn(count, F.lit(0))
    long_value = (
        (F.col("action") == "type") & (F.length("value") > rules.LONG_VALUE_CHARS)
        & ~matches(F.coalesce("prompt", F.lit("")), rules.INJECTION_INTENT, True)
    )
    reason = F.coalesce(reject_reason(), F.when(F.coalesce(long_value, F.lit(False)), "LONG_VALUE"))
    by_place = (F.col("action") == "click") & (F.coalesce(trim(F.col("selector")), F.lit("")) == "") & (
        F.coalesce(trim(F.col("text")), F.lit("")) == "")
    clipped = F.when(F.col("action").isin("hover", "extract_text", "clear", "focus"),
                     F.substring(trim(F.col("selector")), 1, rules.ACTION_SELECTOR_CHARS)).otherwise(trim(F.col("selector")))
    return d.withColumn("reason", reason).select(
        "action_id", "action", "reason", clipped.alias("selector"),
        F.when(by_place & F.col("reason").isNull(), round_half_up(F.col("x"))).alias("x"),
        F.when(by_place & F.col("reason").isNull(), round_half_up(F.col("y"))).alias("y"),
        F.when(F.col("action") == "done", F.substring(F.coalesce("summary", F.lit("")), 1, rules.ACTION_SUMMARY_CHARS)).alias("summary"),
        F.when(F.col("action") == "wait", F.coalesce("ms", F.lit(1000.0))).alias("ms"),
    )


def _text(v: Column, name: str) -> Column:
    """A member of a JSON value if it is a string, else null: a number is no text."""
    member = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def _number(v: Column, name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, f"$.{name}", "double"))


def _typed(v: Column) -> Column:
    """One entry of a field list. An entry may name its action, which then has to be ``type``."""
    named = F.schema_of_variant(F.try_variant_get(v, "$.action", "variant"))
    falsy = named.isNull() | (named == "VOID") | F.coalesce(F.try_variant_get(v, "$.action", "string").isin("", "0", "false"), F.lit(False))
    return F.struct(
        F.when(falsy | (_text(v, "action") == "type"), trim(_text(v, "selector"))).alias("selector"), _text(v, "value").alias("value"),
        _text(v, "profileKey").alias("profile_key"))


def _first_fields(v: Column) -> Column:
    """Usable entries of a ``fill_many`` list, first per selector, in order."""
    listed = F.coalesce(F.try_variant_get(v, "$.fields", "array<variant>"), F.array().cast("array<variant>"))
    usable = F.filter(F.transform(listed, _typed), lambda e: (
        (e["selector"] != "") & (F.length(e["selector"]) <= rules.ACTION_SELECTOR_CHARS) & e["selector"].rlike(rules.SELECTOR_SAFE)
        & (F.length(e["value"]) <= rules.ACTION_VALUE_CHARS)))
    return F.aggregate(usable, F.filter(usable, lambda e: F.lit(False)), lambda kept, e: F.when(
        F.exists(kept, lambda k: k["selector"] == e["selector"]), kept).otherwise(F.concat(kept, F.array(e))))


def _attempts(v: Column) -> Column:
    """What a ``fill`` proposes, as (label, value, selector): from a list of objects, or a map of labels to values."""
    listed = F.transform(
        F.filter(F.try_variant_get(v, "$.fields", "array<variant>"), lambda e: F.schema_of_variant(e).startswith("OBJECT")),
        lambda e: F.struct(
            F.coalesce(*[F.nullif(_text(e, n), F.lit("")) for n in ("profileKey", "label", "selector")]).alias("label"),
            _text(e, "value").alias("value"), _text(e, "selector").alias("selector")))
    mapped = F.transform(F.map_entries(F.try_variant_get(v, "$.fields", "map<string,variant>")), lambda e: F.struct(
        e["key"].alias("label"), F.when(F.schema_of_variant(e["value"]) == "STRING", e["value"].cast("string")).alias("value"), F.lit(None).cast("string").alias("selector")))
    return F.coalesce(listed, mapped)


def _opened(v: Column) -> Column:
    """A parsed candidate and its action; each is taken out once, as what follows reads them often."""
    return F.struct(v.alias("v"), _text(v, "action").alias("act"))


def _listed(o: Column) -> Column:
    return F.struct(o["v"].alias("v"), o["act"].alias("act"), F.when(o["act"] == "fill_many", _first_fields(o["v"])).alias("fields"))


def _shaped(o: Column) -> Column:
    """An opened candidate as typed columns; what has the wrong JSON type is null. A list of one field is a single fill."""
    v, act, fields = o["v"], o["act"], o["fields"]
    single = F.when(F.size(fields) == 1, F.get(fields, F.lit(0)))
    own = {n: _text(v, n) for n in ("selector", "text", "value", "code", "direction", "url", "summary", "key")}
    is_field = act == "fill_field"
    own["selector"] = F.when(single.isNotNull(), single["selector"]).when(is_field, F.coalesce(_text(v, "field_selector"), own["selector"])).otherwise(own["selector"])
    own["value"] = F.when(single.isNotNull(), single["value"]).when(act == "select", F.coalesce(F.try_variant_get(v, "$.value", "string"), F.lit(""))).otherwise(own["value"])
    return F.struct(
        F.when(single.isNotNull() | is_field, "type").otherwise(act).alias("action"), *[c.alias(n) for n, c in own.items()],
        *[_number(v, n).alias(n) for n in ("x", "y", "ms")], F.when(single.isNotNull(), single["profile_key"]).otherwise(_text(v, "profileKey")).alias("profile_key"),
        fields.alias("fields"), F.coalesce(F.size(fields), F.lit(0)).alias("n_fields"), F.when(act == "fill", _attempts(v)).alias("attempts"),
        F.when(act == "fill", F.coalesce(  # a map counts even when it is empty
            F.size(F.try_variant_get(v, "$.fields", "array<variant>")), F.size(F.try_variant_get(v, "$.fields", "map<string,variant>")) + 1)).alias("n_attempts"))


def _payload(a: Column) -> Column:
    """What an accepted action carries: only the members its kind reads, trimmed and clipped."""
    act, sel = a["action"], trim(a["selector"])
    aimed = F.coalesce(sel, F.lit("")) != ""
    worded = ~aimed & (F.coalesce(trim(a["text"]), F.lit("")) != "")
    click, place = act == "click", (act == "click") & ~aimed & ~worded
    short = F.substring(sel, 1, rules.ACTION_SELECTOR_CHARS)
    selector = (
        F.when(click, F.when(aimed, sel)).when(act == "write_code", F.coalesce(sel, F.lit("")))
        .when(act.isin("type", "select"), sel).when(act.isin("hover", "extract_text", "clear", "focus"), short))
    return F.struct(
        act.alias("action"), selector.alias("selector"), F.when(click & worded, trim(a["text"])).alias("text"),
        F.when(place, round_half_up(a["x"])).alias("x"), F.when(place, round_half_up(a["y"])).alias("y"),
        F.when(act.isin("type", "select"), a["value"]).alias("value"), F.when(act == "write_code", F.coalesce(a["code"], a["value"])).alias("code"),
        F.when(act == "scroll", a["direction"]).alias("direction"), F.when(act == "navigate", a["url"]).alias("url"),
        F.when(act == "done", F.substring(F.coalesce(a["summary"], F.lit("")), 1, rules.ACTION_SUMMARY_CHARS)).alias("summary"),
        F.when(act == "key_press", F.substring(F.coalesce(a["key"], F.lit("Enter")), 1, rules.ACTION_KEY_CHARS)).alias("key"),
        F.when(act == "wait", F.coalesce(a["ms"], F.lit(1000.0))).alias("ms"), F.when(act == "type", a["profile_key"]).alias("profile_key"),
        F.when(act == "fill_many", a["fields"]).alias("fields"), F.when(act == "fill", a["attempts"]).alias("attempts"))


def reply_actions(replies: DataFrame, reply: str = "raw") -> DataFrame:
    """The first valid action of each reply with all it carries (columns of ``_payload``; all null if there is none).

    Python only cuts out candidates; parsing, type checks and the rules stay in the engine. A ``fill`` ends the search
    too; what it comes to is up to page and profile (``matching.reply_fills`` on its ``attempts``).
    """
    opened = F.transform(F.transform("candidates", lambda c: F.try_parse_json(c)), _opened)
    parsed = replies.withColumn("candidates", json_candidates(reply)).withColumn("shaped", F.transform(F.transform(opened, _listed), _shaped))
    good = F.filter("shaped", lambda a: reject_reason(a).isNull())
    return parsed.withColumn("a", F.transform(F.slice(good, 1, 1), _payload)).withColumn("a", F.get("a", F.lit(0))).drop("candidates", "shaped").select(
        *[c for c in replies.columns if c != reply], "a.*")


def fill_many(items: DataFrame) -> DataFrame:
    """Valid items, first per selector; the action shrinks to a single type, or to nothing.

    Input: action_id, pos, selector, value. One aggregated row per action and selector, so a
    long item list is combined before the shuffle.
    """
    typed = items.withColumn("selector", trim(F.col("selector"))).filter(
        F.col("value").isNotNull() & (F.col("selector") != "") & (F.length("selector") <= rules.ACTION_SELECTOR_CHARS)
        & F.col("selector").rlike(rules.SELECTOR_SAFE) & (F.length("value") <= rules.ACTION_VALUE_CHARS))
    first = typed.groupBy("action_id", "selector").agg(F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    sizes = first.groupBy("action_id").agg(F.count("*").alias("n"))
    return first.join(sizes, "action_id").select(
        "action_id", "selector", "value", "pos", F.when(F.col("n") == 1, "type").otherwise("fill_many").alias("action"))


def stuck_keys(log: DataFrame, key: str, ts: str, event: str, signature: Column, segment: Column) -> DataFrame:
    """First row per key where the same signature came three times in a row."""
    d = log.select(key, ts, event, signature.alias("sig"), segment.alias("seg"))
    order = [ts, event]
    once = with_previous(d, [key], order, ["sig"], F.col("seg")).withColumn("again", F.coalesce(F.col("sig") == F.col("prev_sig"), F.lit(False)))
    twice = with_previous(once, [key], order, ["again"], F.col("seg"))
    hit = twice.filter(F.col("again") & F.coalesce(F.col("prev_again"), F.lit(False)))
    return hit.groupBy(key).agg(F.min_by(F.struct(event, ts, "sig"), F.struct(ts, event)).alias("h")).select(
        key, F.col(f"h.{event}").alias("stop_event"), F.col(f"h.{ts}").alias("stop_ms"), F.col("h.sig").alias("signature"))


def failure_runs(log: DataFrame, key: str, ts: str, event: str, failed: Column, segment: Column) -> DataFrame:
    """Runs of at least two failures without anything else in between."""
    d = log.select(key, ts, event, F.when(failed, 1).otherwise(0).alias("bad"), segment.alias("seg")).withColumn("good", 1 - F.col("bad"))
    grouped = running_totals(d, [key], [ts, event], {"goods": "good"}, F.col("seg")).filter("bad = 1")
    return grouped.groupBy(key, "goods").agg(
        F.count("*").alias("length"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms")
    ).filter(F.col("length") >= rules.MAX_FAILURES).drop("goods")


def _shown(number: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(number.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")


def step_label() -> Column:
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    parts = F.concat(
        F.when(some("selector"), F.concat(F.lit(" → "), "selector")).otherwise(""),
        F.when(some("value"), F.concat(F.lit(' = "'), F.substring("value", 1, 40), F.lit('"'))).otherwise(""),
        F.when(some("key"), F.concat(F.lit(" ["), "key", F.lit("]"))).otherwise(""),
        F.when(some("text"), F.concat(F.lit(' "'), "text", F.lit('"'))).otherwise(""),
        F.when(F.col("x").isNotNull() & F.col("y").isNotNull(),
               F.concat(F.lit(" at ("), _shown(F.col("x")), F.lit(", "), _shown(F.col("y")), F.lit(")"))).otherwise(""),
    )
    code = F.concat(F.lit(" ("), F.length(F.coalesce("code", F.lit(""))).cast("string"), F.lit(" chars)"))
    head = F.concat(F.lit("["), (F.col("step") + 1).cast("string"), F.lit("] "), "action")
    done = F.concat(F.lit("Done: "), F.coalesce(F.nullif("summary", F.lit("")), F.lit("Task complete.")))
    return F.when(F.col("action") == "done", done).otherwise(F.concat(head, F.when(F.col("action") == "write_code", code).otherwise(parts)))


def step_log(actions: DataFrame) -> DataFrame:
    """Labelled steps of a session in order, up to the step limit and the first ``done``."""
    first = Window.partitionBy("session_id").orderBy("step", "action_id")
    capped = actions.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rules.MAX_LOOP_STEPS)
    # at most MAX_LOOP_STEPS rows per session from here on
    rows = capped.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "action", step_label().alias("label")))).alias("s"))
    stop = F.array_position(F.transform("s", lambda e: e["action"]), "done")
    kept = F.when(stop > 0, F.slice("s", F.lit(1), stop.cast("int"))).otherwise(F.col("s"))
    return rows.select("session_id", F.array_join(F.transform(kept, lambda e: e["label"]), "\n").alias("log"),
                       F.size(kept).cast("long").alias("steps"))


def session_memory(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The last six messages per key, assistant replies clipped."""
    newest = Window.partitionBy(key).orderBy(F.desc("turn"))
    text = F.when(F.col("role") == "assistant", F.substring("text", 1, rules.MEMORY_CHARS)).otherwise(F.col("text"))
    return turns.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= rules.MEMORY_TURNS).select(
        key, "turn", "role", text.alias("text"))


def session_names(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Name from the first user message without the status emoji; thirty characters and an ellipsis."""
    first = turns.groupBy(key).agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first_text"), F.count("*").alias("messages"))
    clean = trim(F.regexp_replace("first_text", rules.SESSION_NAME_EMOJI, ""))
    cap = rules.SESSION_NAME_CHARS
    name = F.when(F.col("first_text").isNull(), "New chat").when(
        F.length(clean) > cap, F.concat(F.substring(clean, 1, cap), F.lit("…"))).otherwise(clean)
    return first.select(key, name.alias("name"), "messages")


def prune_empty(sessions: DataFrame) -> DataFrame:
    """Sessions with messages, plus only the first empty one per owner."""
    full = sessions.filter(F.col("messages") > 0)
    empty = sessions.filter(F.col("messages") == 0).groupBy("owner_id").agg(
        F.min_by(F.struct(*[c for c in sessions.columns if c != "owner_id"]), "session_id").alias("s"))
    return full.unionByName(empty.select("owner_id", "s.*").select(*sessions.columns))


def run_outcome() -> Column:
    """How a run step ended, first reason wins."""
    return (
        F.when(F.col("capture_error").isNotNull(), "capture")
        .when(F.col("model_error").isNotNull(), "model")
        .when(F.col("action").isNull(), "no_action")
        .when(F.col("exec_error").isNotNull(), "execute")
        .when(F.col("action").isin("done", "fill_many"), "done")
        .when(F.col("step") >= rules.MAX_AGENT_STEPS, "max_steps")
        .otherwise("continue")
    )


def run_summary() -> Column:
    return F.when(run_outcome() == "done", F.when(
        F.col("action") == "fill_many", F.concat(F.lit("Filled "), F.col("filled").cast("string"), F.lit(" field(s)."))
    ).otherwise(F.col("summary")))
