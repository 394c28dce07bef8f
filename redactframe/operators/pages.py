"""Raw HTML pages: visible text, form controls, privacy risk."""

from __future__ import annotations

import json
import re
from functools import reduce
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactframe import rules
from redactframe.functions import urls
from redactframe.functions.text import collapse, match_spans, matches, trim
from redactframe.operators.detect import visible_id_count

# Parts of a page that are never visible.
_DROPPED = [r"(?s)<!--.*?-->", r"(?is)<head\b.*?</head>", r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>"]
_HIDING = r"""(?:\shidden[\s=>]|display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0[;"'])"""
_HIDDEN = re.compile(rf"<[a-z][^>]*{_HIDING}", re.I | re.S | re.A)
_TOKEN, _NAME = re.compile(r"<[^>]*>|[^<]+|<"), re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
_VOID = {"input", "br", "img", "hr", "meta", "link"}
#: Named character references by name, as the standard library lists them, and the digit forms.
NAMED = {f"&{name};": chr(point) for name, point in name2codepoint.items() if name != "amp"}
NAMED["&nbsp;"] = " "  # layout shows it as a blank
_REFERENCE = r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
_AMPERSAND = r"&(?:amp|#0*38|#[xX]0*26);"
LABEL_ELEMENT = r"(?is)<label\b[^>]*>.*?</label>"
#: Native controls, and any element that is editable in place.
CONTROL_TAG = r"""(?is)<(?:(?:input|select|textarea)\b[^>]*|[a-z][a-z0-9]*\s(?:[^>]*?[\s"'])?contenteditable(?:\s*=\s*(?:"(?:true|plaintext-only)?"|'(?:true|plaintext-only)?'|true\b)[^>]*|\s[^>=]*)?)>"""


def _resolved(ref: Column) -> Column:
    """The character that a reference stands for; unknown names and impossible numbers stay as they are."""
    named = F.try_element_at(F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>"), ref)
    hexed = F.when(ref.rlike("^&#[xX]"), F.regexp_extract(ref, "^&#[xX]([0-9A-Fa-f]+);$", 1)).when(
        ref.rlike("^&#[0-9]"), F.hex(F.regexp_extract(ref, "^&#([0-9]+);$", 1).cast("bigint")))
    point = F.conv(hexed, 16, 10).cast("bigint")
    fits = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    numbered = F.when(fits, F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32"))
    return F.coalesce(named, numbered, ref)


def resolve_references(text: Column) -> Column:
    """Each different reference is replaced once; the ampersand goes last, so nothing is resolved twice."""
    refs = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))), lambda r: ~r.rlike(_AMPERSAND))
    out = F.aggregate(refs, text, lambda t, r: F.replace(t, r, _resolved(r)))
    return F.regexp_replace(F.when(F.contains(text, F.lit("&")), out).otherwise(text), _AMPERSAND, "&")


def _shown(page: str) -> str:
    """``page`` with a blank for each tag and text of elements that hide themselves, in one walk."""
    out: list[str] = []
    name, depth, since = "", 0, 0
    for token in _TOKEN.findall(page):
        out.append(token)
        if token[0] != "<":
            continue
        tag = _NAME.match(token)
        own = tag[1].lower() if tag else ""
        closes = token.startswith("</")
        opens = not closes and not token.endswith("/>") and own not in _VOID
        if not name:
            if opens and _HIDDEN.match(token):
                name, depth, since = own, 1, len(out) - 1
        elif own == name:
            depth += 1 if opens else -1 if closes else 0
            if not depth:
                out[since:] = [" " * (len(out) - since)]
                name = ""
    return "".join(out)


@F.pandas_udf(T.StringType())
def _without_hidden(html: pd.Series) -> pd.Series:
    return html.map(_shown, na_action="ignore")


def without_hidden(html: Column) -> Column:
    """The page without elements that hide themselves, whatever is nested in them.

    One walk over tags and texts, linear in the page, keeps the hiding element's name and how deep its like is nested; an
    element that never ends hides nothing. Pages without any hiding attribute are not taken apart.
    """
    walked = F.when(html.rlike("(?is)<[a-z][^>]*" + _HIDING), html)
    return F.coalesce(_without_hidden(walked), html)


def visible_text(html: Column) -> Column:
    """Page text with one line per text node (any tag ends a node)."""
    out = reduce(lambda t, p: F.regexp_replace(t, p, " "), _DROPPED, html)
    return resolve_references(F.regexp_replace(without_hidden(out), "<[^>]*>", "\n"))


def text_nodes(pages: DataFrame) -> DataFrame:
    """page_id, node_idx, text; nodes under three characters are skipped, the index keeps the gaps."""
    nodes = F.transform(F.split(visible_text(F.col("html")), "\n"), trim)
    return pages.select("page_id", F.posexplode(nodes).alias("node_idx", "text")).filter(
        F.length("text") >= rules.MIN_TEXT_NODE_CHARS
    )


def page_excerpt(html: Column) -> Column:
    return F.substring(collapse(visible_text(html)), 1, rules.PAGE_EXCERPT_CHARS)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag, empty string when absent."""
    p = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, p, g) for g in (1, 2, 3)])


def has_flag(tag: Column, name: str) -> Column:
    """Boolean attribute present; quoted values are blanked first so their words do not count."""
    bare = F.regexp_replace(tag, r"""("[^"]*"|'[^']*')""", '""')
    return bare.rlike(rf"(?i)\s{name}[\s=/>]")


def control_tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(CONTROL_TAG), F.lit(0))


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^<([A-Za-z]+)", 1))


CONTROL_ATTRIBUTES = [
    ("type", "type"), ("name", "name"), ("id", "id"), ("placeholder", "placeholder"), ("aria-label", "aria_label"),
    ("title", "title"), ("autocomplete", "autocomplete"), ("data-testid", "data_testid"), ("value", "value"),
    ("max", "max"), ("class", "css_class"),
]


def form_controls(pages: DataFrame) -> DataFrame:
    """One row per form control with its attributes, in document order."""
    t = F.col("tag_text")
    return pages.select("page_id", F.posexplode(control_tags(F.col("html"))).alias("field_idx", "tag_text")).select(
        "page_id", "field_idx", tag_name(t).alias("tag"),
        *[attribute(t, a).alias(c) for a, c in CONTROL_ATTRIBUTES],
        has_flag(t, "readonly").alias("readonly"), has_flag(t, "disabled").alias("disabled"),
        has_flag(t, "checked").alias("checked"),
    )


def label_elements(pages: DataFrame) -> DataFrame:
    """page_id, label_idx, for_id, label_text of all <label> elements."""
    whole = F.regexp_extract_all("html", F.lit(LABEL_ELEMENT), F.lit(0))
    return pages.select("page_id", F.posexplode(whole).alias("label_idx", "el")).select(
        "page_id", "label_idx", attribute(F.col("el"), "for").alias("for_id"),
        trim(F.regexp_replace("el", "<[^>]*>", "")).alias("label_text"),
    )


def attach_labels(controls: DataFrame, labels: DataFrame) -> DataFrame:
    """Resolve <label for=id>: the first non-blank label per page and id."""
    first = (
        labels.withColumn("label_text", trim(F.col("label_text")))
        .filter((F.col("label_text") != "") & (F.col("for_id") != ""))
        .groupBy("page_id", F.col("for_id").alias("id"))
        .agg(F.min_by("label_text", "label_idx").alias("for_label"))
    )
    return controls.join(first, ["page_id", "id"], "left")


def scannable(url: Column) -> Column:
    return F.coalesce(
        urls.scheme(url).isin("http", "https", "file") & ~F.endswith(F.lower(url), F.lit(".pdf")), F.lit(False)
    )


def risk_counts(pages: DataFrame) -> DataFrame:
    """Hits per risk factor of each page. Everything stays inside the row: no explode, no shuffle."""
    html = F.col("html")
    controls = control_tags(html)
    hay = lambda t: F.concat_ws(" ", *[F.nullif(attribute(t, a), F.lit(""))
                                       for a in ("name", "id", "placeholder", "aria-label", "data-testid")])
    is_type = lambda t, kind: (tag_name(t) == "input") & (F.lower(attribute(t, "type")) == kind)
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>"), F.lit(0))
    tracked = lambda s: reduce(lambda a, b: a | b, [F.contains(attribute(s, "src"), F.lit(t)) for t in rules.TRACKERS])
    labels = match_spans(html, LABEL_ELEMENT)

    def label_of(control):
        # a label names its control by id, or stands around it: places tell controls that are written alike apart
        tag = control["text"]
        mine = F.filter(labels, lambda el: (
            (attribute(el["text"], "for") != "") & (attribute(el["text"], "for") == attribute(tag, "id"))
            | (attribute(el["text"], "for") == "") & (el["start"] <= control["start"]) & (control["end"] <= el["end"])))
        shown = trim(F.regexp_replace(F.get(mine, F.lit(0))["text"], "<[^>]*>", ""))
        return F.coalesce(F.nullif(shown, F.lit("")), attribute(tag, "aria-label"))

    # places only where a box is ticked
    is_ticked = lambda t: is_type(t, "checkbox") & has_flag(t, "checked")
    ticked = F.when(F.exists(controls, is_ticked), F.filter(match_spans(html, CONTROL_TAG), lambda c: is_ticked(c["text"])))
    ticked = F.coalesce(ticked, F.array().cast("array<struct<text:string,start:int,end:int>>"))
    host = urls.host(F.col("url"))
    insecure = (F.coalesce(urls.scheme(F.col("url")), F.lit("")) != "https") & ~F.coalesce(
        host.isin(rules.LOCAL_HOSTS), F.lit(False))
    n = lambda c: F.size(c).cast("long")
    return pages.select(
        "page_id", host.alias("host"),
        F.when(insecure, 1).otherwise(0).cast("long").alias("no_https"),
        n(F.filter(controls, lambda t: is_type(t, "password"))).alias("password_fields"),
        n(F.filter(controls, lambda t: tag_name(t).isin("input", "textarea")
                   & matches(hay(t), rules.RISK_SENSITIVE_INPUT, True))).alias("sensitive_inputs"),
        n(F.filter(scripts, tracked)).alias("trackers"),
        n(F.filter(ticked, lambda c: matches(label_of(c), rules.RISK_CONSENT_LABEL, True))).alias("dark_patterns"),
        visible_id_count(visible_text(html)).cast("long").alias("pii_exposed"),
    )


def risk_report(counts: DataFrame) -> DataFrame:
    """Score, grade, colour and the list of factors that fired."""
    lost = reduce(
        lambda a, b: a + b,
        [F.least(F.col(f) * points, F.lit(most)) for f, _, points, most in rules.RISK_FACTORS],
    )
    score = F.greatest(F.lit(0), F.lit(100) - lost).cast("long")
    scored = counts.withColumn("score", score)
    grade = reduce(lambda acc, g: acc.when(F.col("score") >= g[0], g[1]), rules.RISK_GRADES[1:],
                   F.when(F.col("score") >= rules.RISK_GRADES[0][0], rules.RISK_GRADES[0][1])).otherwise(rules.RISK_LOWEST[0])
    colours = {g: c for _, g, c in rules.RISK_GRADES} | {rules.RISK_LOWEST[0]: rules.RISK_LOWEST[1]}
    colour = F.element_at(F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]), F.col("grade"))
    factors = F.filter(
        F.array(*[
            F.when(
                F.col(f) > 0,
                F.struct(F.lit(f).alias("id"),
                         F.replace(F.lit(rules.RISK_LABELS[f]), F.lit("{n}"), F.col(f).cast("string")).alias("label"),
                         F.lit(sev).alias("severity")),
            )
            for f, sev, _, _ in rules.RISK_FACTORS
        ]),
        lambda r: r.isNotNull(),
    )
    return scored.withColumn("grade", grade).withColumn("color", colour).withColumn("risks", factors)


def form_targets(pages: DataFrame) -> DataFrame:
    """Warnings about where forms send their data: insecure target, foreign host."""
    forms = F.regexp_extract_all("html", F.lit(r"(?is)<form\b[^>]*>"), F.lit(0))
    action = F.col("action")
    absolute = action.rlike("^https?://")
    target = urls.host(action)
    page_host = urls.host(F.col("url"))
    return (
        pages.select("page_id", "url", F.posexplode(forms).alias("form_idx", "form"))
        .withColumn("action", attribute(F.col("form"), "action"))
        .select(
            "page_id", "form_idx", "action",
            (F.startswith(action, F.lit("http://")) & (urls.scheme(F.col("url")) == "https")).alias("insecure_target"),
            F.when(absolute & ~urls.same_or_subdomain(target, page_host), target).alias("foreign_host"),
        )
    )


def risky_hosts(rows: DataFrame, host: str, domains=rules.RISKY_DOMAINS) -> DataFrame:
    """Rows whose host is, or is below, a listed domain: suffixes turn the subdomain test into equality.

    ``domains`` is a list or a one-column table of any length. Only distinct hosts are expanded and matched; the rows
    themselves take part in one semi-join on the host, so repeated rows stay and no column needs to be comparable.
    """
    listed = domains.toDF("suffix") if isinstance(domains, DataFrame) else rows.sparkSession.createDataFrame([(d,) for d in domains], "suffix string")
    hosts = rows.select(F.col(host).alias("__host")).distinct()
    parts = hosts.select("__host", F.explode(urls.host_suffixes(F.regexp_replace("__host", r"^www\.", ""))).alias("suffix"))
    hit = parts.join(listed, "suffix", "left_semi").select("__host").distinct()
    return rows.join(hit, rows[host] == hit["__host"], "left_semi")
