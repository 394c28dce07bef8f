import json

import pytest
from pyspark.sql import functions as F

from redactframe.operators import fields, pages, profile

FORM = ("page_id long, field_idx long, tag string, type string, name string, id string, placeholder string, aria_label string, title string, "
        "autocomplete string, data_testid string, value string, max string, readonly boolean, disabled boolean, contenteditable boolean, "
        "content string, label string, css_class string, x double, y double, width double, height double")


def control(i, **kw):
    base = dict(page_id=1, field_idx=i, tag="input", type="text", name="", id=f"e{i}", placeholder="", aria_label="", title="", autocomplete="",
                data_testid="", value="", max="", readonly=False, disabled=False, contenteditable=False, content="", label="", css_class="",
                x=1.0, y=1.0, width=10.0, height=10.0)
    base.update(kw)
    return tuple(base.values())


def test_sensitive_rules(rows):
    cases = [
        (dict(type="password"), True), (dict(autocomplete="cc-number"), True), (dict(autocomplete="cc-csc"), True), (dict(autocomplete="cc-name"), True),
        (dict(name="user_password"), True), (dict(id="pin-code"), True), (dict(aria_label="CVV code"), True), (dict(name="portal_pin"), True),
        (dict(name="username"), False), (dict(name="search"), False), (dict(name="postal_code"), False), (dict(tag="select", name="card"), False),
        (dict(type="password", width=0.0), False), (dict(name="social-security"), True),
        (dict(tag="div", contenteditable=True, content="4532 0151 1283 0366"), True),
    ]
    d = rows([control(i, **kw) for i, (kw, _) in enumerate(cases)], FORM)
    hit = {r["field_idx"] for r in fields.sensitive_fields(d).collect()}
    assert hit == {i for i, (_, want) in enumerate(cases) if want}


def test_zero_size_control_claims_its_selector(rows):
    d = rows([control(0, id="a", type="password", width=0.0), control(1, id="a", type="password")], FORM)
    assert fields.sensitive_fields(d).count() == 0


@pytest.mark.parametrize("kw,key", [
    (dict(id="aadhaar-number"), "never_store"), (dict(name="pan_number"), "never_store"), (dict(id="cvv"), "never_store"),
    (dict(autocomplete="email"), "email"), (dict(autocomplete="tel"), "phone"), (dict(label="Email"), "email"), (dict(label="Full Name"), "fullName"),
    (dict(id="notes"), None), (dict(name="revenue"), None), (dict(value="4532015112830366"), "never_store"), (dict(name="card holder"), "cardholderName"),
])
def test_classifier(rows, kw, key):
    base = dict(id="q")
    base.update(kw)
    assert fields.classify_fields(rows([control(0, **base)], FORM)).first()["key"] == key


@pytest.mark.parametrize("label,key", [
    ("Father's Name", "fatherName"), ("PIN Code", "pincode"), ("Aadhaar No", None), ("Contact", None), ("**Skills**", "skills"),
    ("E-mail", "email"), ("Blood", "bloodGroup"), ("xyz", None)])
def test_label_resolver(rows, label, key):
    assert rows([(label,)], "l string").select(fields.resolve_label_expr(F.col("l"))).first()[0] == key


def extract(rows, text, **kw):
    return {r["key"]: r["value"] for r in profile.extract_profile(rows([(1, text)], "doc_id long, text string"), **kw).collect()}


def test_spoken_profile(rows):
    got = extract(rows, "My name is Ananya Krishnan and email is ananya@example.com phone 9876543210")
    assert "Ananya" in got["fullName"] and got["email"] == "ananya@example.com" and got["phone"] == "9876543210"


def test_identifiers_never_enter(rows):
    got = extract(rows, "Name: Safe Person\nAadhaar: 2345 6789 0123\nPAN: ABCDE1234F\nEmail: ok@x.com")
    assert got["email"] == "ok@x.com" and not {"aadhaar", "pan", "PAN", "Aadhaar"} & set(got)
    assert "pan" in extract(rows, "PAN: ABCDE1234F", kyc=True)
    got = extract(rows, "Name: Rahul Verma\nDL: MH12 12345678901\nUPI: upi://rahul@oksbi\nPassport: L1234567\nAccount: 50100234567890\nEmail: rv@example.com")
    assert set(got) == {"fullName", "email"}


def test_markdown_lines(rows):
    got = extract(rows, "**Website:** https://a.example/x\nSkills: Python, JS")
    assert got["website"] == "https://a.example/x" and got["skills"] == "Python, JS"


def test_long_values_are_clipped(rows):
    got = extract(rows, "Skills: " + "a" * 400)
    assert len(got["skills"]) == 200 and got["skills"].endswith("...")


def test_json_profile(rows):
    d = rows([(1, '{"Full Name":"Ravi","Email":"ravi@test.com"}')], "user_id long, raw string")
    assert {r["key"]: r["value"] for r in profile.json_profiles(d, "raw").collect()} == {"fullName": "Ravi", "email": "ravi@test.com"}


@pytest.mark.parametrize("raw,want", [
    ('{"a":"1","b":2}', {"a": "1", "b": "2"}), ("Name: A\nCity: B", {"Name": "A", "City": "B"}), ("free text", {"raw": "free text"}),
    ("", {}), ("   ", {}), (None, {}), ("[1,2]", {}), ("42", {}), ('{"a":null}', {}), ("k: a: b", {"k": "a: b"}),
])
def test_normalize(rows, raw, want):
    d = rows([(1, raw)], "user_id long, raw string")
    assert {r["key"]: r["value"] for r in profile.normalize_profile(d, "raw").collect()} == want


def test_validate_counts(rows):
    bad = [("skills", "x", "string"), ("university", "y", "string"), ("motherTongue", "z", "string"), ("aadhaarNumber", "1", "string"),
           ("idNumber", "2345 6789 9012", "string"), ("panRef", "ABCDE1234F", "string"), ("blank", " ", "string"), ("n", "42", "number"),
           ("k" * 65, "v", "string"), ("long", "v" * 2001, "string")]
    many = [(f"k{i}", "v", "string") for i in range(130)]
    data = [(1, i, *e) for i, e in enumerate(bad)] + [(2, i, *e) for i, e in enumerate(many)]
    kept, report = profile.validate_fields(rows(data, "doc_id long, pos long, key string, value string, value_type string"))
    assert {r["doc_id"]: (r["kept"], r["dropped"]) for r in report.collect()} == {1: (3, 7), 2: (120, 10)}
    assert kept.filter("doc_id = 2").count() == 120


def test_merge_priority(rows):
    d = rows([(1, 1, "Full Name", "FromRegex", "extracted"), (1, 2, "Full Name", "FromPopup", "popup"), (1, 3, "email", "e", "extracted"),
              (1, 4, "fullName", "Stored", "stored"), (1, 5, "skills", "", "stored")],
             "user_id long, entry_idx long, key string, value string, origin string")
    assert {r["key"]: r["value"] for r in profile.merge_profiles(d).collect()} == {"fullName": "Stored", "email": "e"}


def test_html_controls_and_labels(rows):
    html = ("<body><label for='a'> <b>Card</b> no </label><input id='a' name=cardno CHECKED type=\"checkbox\">"
            "<input aria-label=\"is checked now\" type=checkbox></body>")
    page = rows([(1, "http://x.example", html)], "page_id long, url string, html string")
    c = {r["field_idx"]: r for r in pages.form_controls(page).collect()}
    assert c[0]["id"] == "a" and c[0]["name"] == "cardno" and c[0]["checked"] and not c[1]["checked"]
    assert pages.label_elements(page).first()["label_text"] == "Card no"
    report = pages.risk_report(pages.risk_counts(page)).first()
    assert report["score"] == 100 - 30 - 15 and report["grade"] == "C"


def test_consent_label_by_for(rows):
    html = "<label for=m>I agree</label><input type=checkbox id=m checked>"
    page = rows([(1, "https://x.example", html)], "page_id long, url string, html string")
    assert pages.risk_counts(page).first()["dark_patterns"] == 1


def test_hidden_text_is_dropped(rows):
    html = "<head><title>t</title></head><body><script>var email='secret@hidden.com'</script><div style='display: none'>gone</div><p>shown &amp; kept</p></body>"
    page = rows([(1, html)], "page_id long, html string")
    assert [r["text"] for r in pages.text_nodes(page).collect()] == ["shown & kept"]


def test_long_domain_list_joins(rows):
    d = rows([(1, "a.b.tracker7.example"), (2, "tracker7.example.org"), (3, "www.tracker9.example")], "id long, host string")
    domains = [f"tracker{i}.example" for i in range(300)]
    assert {r["id"] for r in pages.risky_hosts(d, "host", domains).collect()} == {1, 3}


def test_profile_documents_round_trip(rows):
    from redactframe.sources.files import profile_documents

    d = rows([("Work", "email", "a@b.c"), ("Work", "city", "Pune")], "profile_name string, key string, value string")
    doc = json.loads(profile_documents(d).first()["document"])
    assert doc == {"profileName": "Work", "data": {"city": "Pune", "email": "a@b.c"}}
