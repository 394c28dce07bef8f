"""Queries: HTML pages, risk, URL predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions import urls
from redactframe.functions.text import collapse
from redactframe.operators import pages
from redactframe.plans import sqltext as q
from redactframe.plans.registry import query
from redactframe.sources.shapes import NESTED_HIDDEN, cte
from redactframe.sources.tables import derived, table


def visible_sql(html: str) -> str:
    hiding = r"""(?:\shidden(?:[\s=][^>]*)?|(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0[;"'])[^>]*)"""
    flat = [rf"(?is)<{t}\b[^>]*{hiding}>.*?</{t}>" for t in ("div", "span", "p")]
    html = f"replace({html}, {q.lit(NESTED_HIDDEN)}, ' ')"
    out = reduce(lambda t, p: f"regexp_replace({t}, {q.lit(p)}, ' ', 'g')", pages._DROPPED + flat, html)
    out = f"regexp_replace({out}, '<[^>]*>', chr(10), 'g')"
    return reduce(lambda t, e: f"replace({t}, {q.lit(e[0])}, {q.lit(e[1])})", REFERENCES, out)


#: The references that occur in the tables and shapes, the ampersand last.
REFERENCES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&#8217;", "’"), ("&#x1F600;", "\U0001F600"),
    ("&eacute;", "é"), ("&amp;", "&"),
]


def attr_sql(tag: str, name: str) -> str:
    p = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return "concat(" + ", ".join(f"regexp_extract({tag}, {q.lit(p)}, {g})" for g in (1, 2, 3)) + ")"


def flag_sql(tag: str, name: str) -> str:
    bare = f"regexp_replace({tag}, {q.lit(chr(40) + chr(34) + '[^' + chr(34) + ']*' + chr(34) + '|' + chr(39) + '[^' + chr(39) + ']*' + chr(39) + ')')}, '\"\"', 'g')"
    return f"regexp_matches({bare}, {q.lit(rf'(?i)\s{name}[\s=/>]')})"


TAG_SQL = "lower(regexp_extract({t}, '^<([A-Za-z]+)', 1))"


@query("page_text", oracle=f"""WITH v AS (SELECT page_id, string_split({visible_sql('html')}, chr(10)) AS l FROM pages),
 n AS (SELECT page_id, i - 1 AS node_idx, {q.trim('l[i]')} AS text FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM v))
 SELECT page_id, node_idx, text FROM n WHERE length(text) >= 3""")
def page_text(spark, sf):
    return pages.text_nodes(table(spark, sf, "pages")).withColumn("node_idx", F.col("node_idx").cast("long"))


@query("page_excerpt", oracle=f"SELECT page_id, substr({q.collapse(visible_sql('html'))}, 1, 4000) AS excerpt FROM pages")
def page_excerpt(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.page_excerpt(F.col("html")).alias("excerpt"))


_CONTROL_COLS = ", ".join(f"{attr_sql('t', a)} AS {c}" for a, c in pages.CONTROL_ATTRIBUTES)


@query("form_controls", oracle=f"""{cte('form_pages')}, c AS (SELECT page_id, l[i] AS t, i - 1 AS field_idx FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT page_id, regexp_extract_all(html, {q.lit(pages.CONTROL_TAG)}) AS l FROM form_pages)))
 SELECT page_id, field_idx, {TAG_SQL.format(t='t')} AS tag, {_CONTROL_COLS}, {flag_sql('t', 'readonly')} AS readonly,
  {flag_sql('t', 'disabled')} AS disabled, {flag_sql('t', 'checked')} AS checked FROM c""")
def form_controls(spark, sf):
    return pages.form_controls(derived(spark, sf, "form_pages")).withColumn("field_idx", F.col("field_idx").cast("long"))


def placed_sql(src: str, pattern: str) -> str:
    """Matches with their places: pieces between matches give the running positions."""
    m, g = f"regexp_extract_all({src}, {q.lit(pattern)})", f"string_split_regex({src}, {q.lit(pattern)})"
    size = lambda l, to: f"coalesce(list_sum(list_transform({l}[1:{to}], lambda s: length(s))), 0)"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'t': {m}[i], 'a': {size(g, 'i')} + {size(m, 'i - 1')}}})"


def label_sql(control: str) -> str:
    """Text of the first label that names the control or stands around it, else its aria-label."""
    tag = f"{control}.t"
    around = f"e.a <= {control}.a AND {control}.a + length({tag}) <= e.a + length(e.t)"
    own = f"list_filter(lab, lambda e: ({attr_sql('e.t', 'for')} <> '' AND {attr_sql('e.t', 'for')} = {attr_sql(tag, 'id')}) OR ({attr_sql('e.t', 'for')} = '' AND {around}))[1].t"
    return f"coalesce(nullif({q.trim(f'regexp_replace({own}, {q.lit("<[^>]*>")}, {q.lit("")}, {q.lit("g")})')}, ''), {attr_sql(tag, 'aria-label')})"


def risk_counts_sql(src: str) -> str:
    hay = "concat_ws(' ', " + ", ".join(f"nullif({attr_sql('t', a)}, '')" for a in ("name", "id", "placeholder", "aria-label", "data-testid")) + ")"
    tag = TAG_SQL.format(t="t")
    kind = f"lower({attr_sql('t', 'type')})"
    tracked = " OR ".join(f"contains({attr_sql('t', 'src')}, {q.lit(t)})" for t in rules.TRACKERS)
    by_type = dict(rules.SPAN_PATTERNS)
    ids = " + ".join(f"len(regexp_extract_all(vis, {q.lit(by_type[e])}))" for e in ("AADHAAR", "PAN"))
    n = lambda l, c: f"cast(len(list_filter({l}, lambda t: {c})) AS BIGINT)"
    return f"""SELECT page_id, host,
      CASE WHEN coalesce({q.scheme('url')}, '') <> 'https' AND NOT coalesce(host IN ('localhost', '127.0.0.1'), false) THEN 1 ELSE 0 END AS no_https,
      {n('ctl', f"{tag} = 'input' AND {kind} = 'password'")} AS password_fields,
      {n('ctl', f"{tag} IN ('input', 'textarea') AND {q.has(hay, rules.RISK_SENSITIVE_INPUT, True)}")} AS sensitive_inputs,
      {n('scr', tracked)} AS trackers,
      {n('placed', f"{TAG_SQL.format(t='t.t')} = 'input' AND lower({attr_sql('t.t', 'type')}) = 'checkbox' AND {flag_sql('t.t', 'checked')} AND {q.has(label_sql('t'), rules.RISK_CONSENT_LABEL, True)}")} AS dark_patterns,
      cast({ids} AS BIGINT) AS pii_exposed
      FROM (SELECT page_id, url, {q.host('url')} AS host, regexp_extract_all(html, {q.lit(pages.CONTROL_TAG)}) AS ctl,
        {placed_sql('html', pages.LABEL_ELEMENT)} AS lab, {placed_sql('html', pages.CONTROL_TAG)} AS placed, regexp_extract_all(html, '(?is)<script\\b[^>]*>') AS scr, {visible_sql('html')} AS vis FROM {src})"""


def risk_sql(src: str) -> str:
    lost = " + ".join(f"least({f} * {p}, {m})" for f, _, p, m in rules.RISK_FACTORS)
    grade = "CASE " + " ".join(f"WHEN score >= {s} THEN '{g}'" for s, g, _ in rules.RISK_GRADES) + " ELSE 'F' END"
    colour = "CASE " + " ".join(f"WHEN score >= {s} THEN '{c}'" for s, _, c in rules.RISK_GRADES) + f" ELSE '{rules.RISK_LOWEST[1]}' END"
    ids = "concat_ws(',', " + ", ".join(f"CASE WHEN {f} > 0 THEN '{f}' END" for f, *_ in rules.RISK_FACTORS) + ")"
    return (f"SELECT page_id, host, cast(score AS BIGINT) AS score, {grade} AS grade, {colour} AS color, {ids} AS factors "
            f"FROM (SELECT *, greatest(0, 100 - ({lost})) AS score FROM ({risk_counts_sql(src)}))")


def _risk(df):
    report = pages.risk_report(pages.risk_counts(df))
    return report.select("page_id", "host", "score", "grade", "color",
                         F.array_join(F.transform("risks", lambda r: r["id"]), ",").alias("factors"))


@query("page_risk", oracle=risk_sql("pages"))
def page_risk(spark, sf):
    return _risk(table(spark, sf, "pages"))


@query("page_risk_forms", oracle=f"{cte('form_pages')} {risk_sql('form_pages')}")
def page_risk_forms(spark, sf):
    return _risk(derived(spark, sf, "form_pages"))


_FACTORS = " UNION ALL ".join(
    f"SELECT page_id, '{f}' AS id, '{sev}' AS severity, replace({q.lit(rules.RISK_LABELS[f])}, '{{n}}', cast({f} AS VARCHAR)) AS label FROM c WHERE {f} > 0"
    for f, sev, _, _ in rules.RISK_FACTORS
)


@query("risk_factors", oracle=f"{cte('form_pages')}, c AS ({risk_counts_sql('form_pages')}) {_FACTORS}")
def risk_factors(spark, sf):
    report = pages.risk_report(pages.risk_counts(derived(spark, sf, "form_pages")))
    return report.select("page_id", F.explode("risks").alias("r")).select("page_id", "r.id", "r.severity", "r.label")


@query("form_safety", oracle=f"""{cte('form_pages')}, f AS (SELECT page_id, url, i - 1 AS form_idx, {attr_sql('l[i]', 'action')} AS action FROM
  (SELECT page_id, url, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<form\\b[^>]*>') AS l FROM form_pages)))
 SELECT page_id, form_idx, action, starts_with(action, 'http://') AND {q.scheme('url')} = 'https' AS insecure_target,
  CASE WHEN regexp_matches(action, '^https?://') AND NOT ({q.host('action')} = {q.host('url')} OR ends_with({q.host('action')}, concat('.', {q.host('url')}))) THEN {q.host('action')} END AS foreign_host
 FROM f""")
def form_safety(spark, sf):
    return pages.form_targets(derived(spark, sf, "form_pages")).withColumn("form_idx", F.col("form_idx").cast("long"))


_SRC = r"""(?i)src="(https?://[^"]+)\""""
_RISKY = " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in rules.RISKY_DOMAINS)


@query("risky_domains", oracle=f"""{cte('form_pages')}, s AS (SELECT page_id, unnest(regexp_extract_all(html, {q.lit(_SRC)}, 1)) AS src FROM form_pages),
 h AS (SELECT page_id, src, {q.host('src')} AS host, regexp_replace({q.host('src')}, '^www\\.', '') AS h FROM s)
 SELECT page_id, src, host FROM h WHERE {_RISKY}""")
def risky_domains(spark, sf):
    links = derived(spark, sf, "form_pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit(_SRC), F.lit(1))).alias("src")
    ).withColumn("host", urls.host(F.col("src")))
    return pages.risky_hosts(links, "host")


#: A list beyond what a literal could hold, with most of the rule's domains in it.
_LONG_LIST = [*rules.RISKY_DOMAINS, *(f"listed{i}.example" for i in range(280)), "shop.example", "bank.example.org"]


@query("risky_domains_long", oracle=f"""{cte('form_pages')}, h AS (SELECT page_id, {q.host('url')} AS host FROM form_pages UNION ALL SELECT page_id, {q.host('url')} FROM form_pages),
 l AS (SELECT unnest([{', '.join(q.lit(d) for d in _LONG_LIST)}]) AS d)
 SELECT page_id, host FROM h WHERE EXISTS (SELECT 1 FROM l WHERE regexp_replace(host, '^www\\.', '') = d OR ends_with(regexp_replace(host, '^www\\.', ''), concat('.', d)))""")
def risky_domains_long(spark, sf):
    hosts = derived(spark, sf, "form_pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return pages.risky_hosts(hosts.unionAll(hosts), "host", _LONG_LIST)


@query("form_page_text", oracle=f"""{cte('form_pages')} SELECT page_id, {q.collapse(visible_sql('html'))} AS text FROM form_pages""")
def form_page_text(spark, sf):
    return derived(spark, sf, "form_pages").select("page_id", collapse(pages.visible_text(F.col("html"))).alias("text"))


@query("scannable_pages", oracle=f"SELECT page_id, url FROM pages WHERE {q.scheme('url')} IN ('http', 'https', 'file') AND NOT ends_with(lower(url), '.pdf')")
def scannable_pages(spark, sf):
    return table(spark, sf, "pages").filter(pages.scannable(F.col("url"))).select("page_id", "url")
