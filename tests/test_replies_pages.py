"""Reply payloads, page visibility and one-pass profiles."""

import re
import time

import pytest
from pyspark.sql import functions as F

from redactframe.operators import agents, detect, documents, pages, profile


def reply(rows, text):
    return agents.reply_actions(rows([(1, text)], "reply_id long, raw string")).first().asDict(recursive=True)


@pytest.mark.parametrize("text,want", [
    ('{"action":"type","selector":"#a","value":5} {"action":"click","text":" Go "}', {"action": "click", "text": "Go"}),
    ('{"action":"click","x":10.5,"y":2}', {"action": "click", "x": 11, "y": 2, "selector": None}),
    ('{"action":"click","x":"10","y":2}', {"action": None}),
    ('{"action":"done","summary":"' + "s" * 600 + '"}', {"action": "done", "summary": "s" * 500}),
    ('{"action":"key_press","key":7}', {"action": "key_press", "key": "Enter"}),
    ('{"action":"write_code","value":"v"}', {"action": "write_code", "code": "v", "selector": ""}),
    ('{"action":"fill_many","fields":[{"selector":"#a","value":"1"},{"selector":"#a","value":"2"}]}', {"action": "type", "selector": "#a", "value": "1", "fields": None}),
    ('{"action":"fill_many","fields":[]}', {"action": None}),
    ('{"action":"fill","fields":{}}', {"action": "fill", "attempts": []}),
    (None, {"action": None}),
    ("", {"action": None}),
])
def test_payload(rows, text, want):
    got = reply(rows, text)
    assert {k: got[k] for k in want} == want


def test_fill_many_keeps_order_and_first(rows):
    fields = [{"selector": s, "value": v} for s, v in (("#b", "1"), ("#a", "2"), (" #b ", "3"), ("<x>", "4"))]
    got = reply(rows, '{"action":"fill_many","fields":[' + ",".join(f'{{"selector":"{f["selector"]}","value":"{f["value"]}"}}' for f in fields) + "]}")
    assert [(f["selector"], f["value"]) for f in got["fields"]] == [("#b", "1"), ("#a", "2")]


@pytest.mark.parametrize("html,text", [
    ("<div hidden><div>a</div>SECRET TEXT</div>shown", "shown"),
    ("<div style='display: none'>x<div><div>y</div></div>z</div><div>shown</div>", "shown"),
    ("<p hidden>a</p>b", "b"),
    ("<div hidden>never closed", "never closed"),
    ("don&#8217;t &#x41; &eacute; &lt;b&gt; &amp;lt; &#38;lt; &nope; &#0; &#xD800; &#99999999;", "don’t A é <b> &lt; &lt; &nope; &#0; &#xD800; &#99999999;"),
    ("", ""),
])
def test_visible_text(rows, html, text):
    got = rows([(html,)], "html string").select(pages.collapse(pages.visible_text(F.col("html")))).first()[0]
    assert got == text


def test_editable_elements_and_labels(rows):
    html = ('<div contenteditable="true" id="e1">x</div><p contenteditable="false">y</p><span data-a="contenteditable">z</span><b contenteditable>w</b>'
            '<label><input type="checkbox" checked> I agree to marketing</label>')
    df = rows([(1, "https://a.example", html)], "page_id long, url string, html string")
    assert [r["tag"] for r in pages.form_controls(df).orderBy("field_idx").collect()] == ["div", "b", "input"]
    assert pages.risk_counts(df).first()["dark_patterns"] == 1


def test_risky_hosts_keep_repeated_rows_and_maps(rows):
    df = rows([("a.risky.example", {"k": 1}), ("a.risky.example", {"k": 1}), ("b.example", {}), (None, {})], "host string, extra map<string,int>")
    for more in (0, 300):
        listed = ["risky.example", *(f"x{i}.example" for i in range(more))]
        assert pages.risky_hosts(df, "host", listed).count() == 2


def test_profile_is_one_pass(rows):
    df = rows([(1, '{"Full Name":"Ravi","Email":"r@x.com","City":""}'), (2, "Full Name: Asha\nFull Name: B\nNotes - hi"), (3, "{broken\nCity: Pune"), (4, None)], "doc_id long, text string")
    out = profile.extract_profile(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["doc_id"], r["key"]): r["value"] for r in out.collect()}
    assert got[1, "fullName"] == "Ravi" and got[1, "email"] == "r@x.com" and (1, "city") not in got
    assert got[2, "fullName"].startswith("Asha") and got[3, "city"] == "Pune"
    shown = {r["key"] for r in profile.display_fields(out).collect()}
    assert "Full Name" in shown


def test_many_queries_share_one_scan(spark):
    """Twenty thousand queries over few words: the work follows keyword uses, not words times queries."""
    queries = spark.range(20_000).select(F.col("id").alias("query_id"), F.concat(F.lit("alpha word"), (F.col("id") % 500).cast("string")).alias("text"))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha and word"), F.col("id").cast("string"), F.lit(" here.")).alias("text"))
    out = documents.top_snippets(docs, queries, 2)
    assert out.count() == 40_000
    assert out.where("rank = 1 and score = 2").count() >= 20_000 // 10


def test_controls_written_alike_have_their_own_labels(rows):
    """Two boxes of equal text: each has the label that stands around it."""
    box, forms = '<input type="checkbox" checked>', []
    yes, no = f"<label>{box} I agree to share</label>", f"<label>Remember me {box}</label>"
    forms = [(1, yes + no, 1), (2, no + yes, 1), (3, yes + yes, 2), (4, no + no, 0), (5, box + yes, 1), (6, f'<label for="x">consent</label>{box}', 0)]
    counts = pages.risk_counts(rows([(i, "https://a.example", h) for i, h, _ in forms], "page_id int, url string, html string"))
    assert {r["page_id"]: r["dark_patterns"] for r in counts.collect()} == {i: n for i, _, n in forms}


def test_hidden_parts_take_time_in_proportion():
    """Twice the hidden blocks take about twice the time, not four times."""
    def seconds(n):
        page = "".join(f"<div hidden><div>{i}</div></div><p>shown {i}</p>" for i in range(n))
        begin = time.perf_counter()
        out = pages._shown(page)
        assert out.count("shown") == n and "<div" not in out
        return time.perf_counter() - begin

    seconds(4000)
    small, large = min(seconds(8000) for _ in range(3)), min(seconds(32_000) for _ in range(3))
    assert large < 10 * small


def test_rules_of_ones_own_need_no_digit(rows):
    texts = rows([(1, "call John now"), (2, "John 1"), (3, None), (4, "nobody")], "doc_id int, text string")
    found = detect.pii_spans(texts, patterns=[("NAME", "John")])
    assert sorted((r["doc_id"], r["start"]) for r in found.collect()) == [(1, 5), (2, 0)]


def test_replies_are_parsed_once(rows):
    replies = rows([(1, '{"action": "click", "selector": "#a"}')], "reply_id int, raw string")
    plan = agents.reply_actions(replies)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"parse_?json", plan, re.I)) <= 2
