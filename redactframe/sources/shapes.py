"""Row-wise derived inputs.

The base tables have no form controls, boxes, action logs or rare identifiers, so these
shapes compute them from ``customer``, ``orders`` and ``part`` one row at a time with
integer arithmetic and CASE. The expressions mean the same in Spark SQL and in DuckDB, so
a query and its oracle read identical rows, and the volume grows with the base table.
"""

from __future__ import annotations

from dataclasses import dataclass

from redactframe.plans.sqltext import lit


@dataclass(frozen=True)
class Shape:
    base: str
    columns: tuple[str, ...]

    def sql(self) -> str:
        return f"SELECT {', '.join(self.columns)} FROM {self.base}"


def pick(index: str, options: list[str | None]) -> str:
    """CASE that cycles through the options by ``index`` modulo their number."""
    whens = " ".join(f"WHEN {i} THEN {lit(o)}" for i, o in enumerate(options[:-1]))
    return f"CASE ({index}) % {len(options)} {whens} ELSE {lit(options[-1])} END"


def text(expr: str) -> str:
    return f"cast({expr} AS varchar(20))"


def padded(expr: str, width: int) -> str:
    return f"lpad({text(expr)}, {width}, '0')"


def block(key: str, size: int) -> str:
    return f"cast(floor({key} / {size}) AS bigint)"


C, O, P = "c_custkey", "o_orderkey", "p_partkey"

FIELD_NAMES = [
    "user_password", "postal_code", "portal_pin", "full_name", "aadhaar-number", "email", "revenue_total",
    "cvv", "card holder", "pan_number", "first name", "father's name", "mobile", "dob", "college", "notes",
    "cc-exp", "passport", "job title", "one-time-passcode", "reg no", "salary", "country", "social-security",
    "", "department", "otp_code",
]
FIELD_LABELS = ["Full Name", "", "Email", "PIN Code", "University", "Mother's Name", "Quantity", "Job Title", "Phone", "City"]

FORM_FIELDS = Shape("customer", (
    f"{block(C, 15)} AS page_id",
    f"{C} AS field_idx",
    f"{pick(f'{C} * 3 + 1', ['input', 'input', 'input', 'textarea', 'input', 'select', 'input', 'div', 'input', 'button'])} AS tag",
    f"{pick(f'{C} * 5', ['text', 'password', 'email', 'number', 'text', 'hidden', 'tel', 'text', 'checkbox', 'number', 'text'])} AS type",
    f"{pick(f'{C} * 7 + 2', FIELD_NAMES)} AS name",
    f"CASE WHEN {C} % 4 = 0 THEN '' ELSE concat('f', {text(f'{C} % 11')}) END AS id",
    f"{pick(C, ['', 'Enter value', '', '4532 0151 1283 0366', 'Security PIN', ''])} AS placeholder",
    f"{pick(f'{C} * 11 + 5', ['', '', 'CVV code', '', 'Applicant name', '', '', 'Student ID', ''])} AS aria_label",
    f"{pick(C, ['', '', '', 'Surname', '', '', 'Zip', ''])} AS title",
    f"{pick(f'{C} * 13', ['', 'cc-number', '', 'email', 'shipping-street', '', 'billing-cc-number', 'section-a tel', 'bday-day', '', 'CC-CSC', '', 'organization'])} AS autocomplete",
    f"{pick(C, ['', '', 'secret-box', '', '', '', ''])} AS data_testid",
    f"{pick(f'{C} * 17', ['', 'Asha', '4532015112830366', '', '1234567890123456', ' ', 'x', '', 'asha@example.com'])} AS value",
    f"{pick(C, ['', '100', '', '20000', '', '9999'])} AS max",
    f"CASE WHEN {C} % 9 = 0 THEN true ELSE false END AS readonly",
    f"CASE WHEN {C} % 12 = 5 THEN true ELSE false END AS disabled",
    f"CASE WHEN {C} % 7 = 6 THEN true ELSE false END AS contenteditable",
    f"CASE WHEN {C} % 2 = 0 THEN 'pay 4532 0151 1283 0366 now' ELSE 'hello' END AS content",
    f"{pick(f'{C} + 3', FIELD_LABELS)} AS label",
    f"{pick(C, ['', 'wide  box', '', 'row'])} AS css_class",
    f"cast(({C} * 37) % 600 AS double) AS x",
    f"cast(({C} * 53) % 400 AS double) AS y",
    f"cast(CASE WHEN {C} % 10 = 3 THEN 0 ELSE 40 + {C} % 90 END AS double) AS width",
    f"cast(CASE WHEN {C} % 23 = 3 THEN 0 ELSE 12 + {C} % 30 END AS double) AS height",
))

BOXES = Shape("part", (
    f"{block(P, 40)} AS image_id",
    f"{P} AS box_id",
    f"cast(({P} * 37) % 300 AS double) AS x1",
    f"cast(({P} * 53) % 200 AS double) AS y1",
    f"cast(({P} * 37) % 300 + CASE WHEN {P} % 31 = 0 THEN 1 ELSE 20 + p_size END AS double) AS x2",
    f"cast(({P} * 53) % 200 + 20 + p_size AS double) AS y2",
    f"cast({P} % 100 AS double) / 100 AS confidence",
))

IMAGES = Shape("part", (
    f"{P} AS image_id",
    f"cast(60 + ({P} * 97) % 2600 AS bigint) AS width",
    f"cast(40 + ({P} * 61) % 1900 AS bigint) AS height",
    f"CASE {P} % 3 WHEN 0 THEN cast(1 AS double) WHEN 1 THEN cast(2 AS double) ELSE cast(1.5 AS double) END AS dpr",
))

ID_TEXTS = Shape("orders", (
    f"{O} AS doc_id",
    "concat('ref ', CASE " + f"{O} % 8"
    f" WHEN 0 THEN concat({padded(f'{O} % 900 + 100', 3)}, '-', {padded(f'{O} % 90 + 10', 2)}, '-', {padded(f'{O} % 9000 + 1000', 4)})"
    f" WHEN 1 THEN concat('ABCDE', {padded(f'{O} % 10000', 4)}, 'F')"
    f" WHEN 2 THEN concat('9', {padded(O, 9)})"
    f" WHEN 3 THEN concat('2345 6789 ', {padded(f'{O} % 10000', 4)})"
    f" WHEN 4 THEN concat('u', {text(O)}, '@example.com or u', {text(O)}, '@oksbi')"
    f" WHEN 5 THEN concat('MH12 1234', {padded(f'{O} % 10000000', 7)}, ' and L', {padded(f'{O} % 1000000 + 1000000', 7)})"
    f" WHEN 6 THEN concat('acct 5010', {padded(O, 9)}, ' (555) 123-', {padded(f'{O} % 10000', 4)})"
    " ELSE 'none' END, ' end') AS text",
))

NATIONAL_IDS = Shape("orders", (
    f"{O} AS row_id",
    f"CASE WHEN {O} % 5 = 0 THEN '499118665246' ELSE concat(CASE WHEN {O} % 2 = 0 THEN '4991 1866 ' ELSE '49911866' END, "
    f"{padded(f'({O} * 7919) % 10000', 4)}, CASE WHEN {O} % 17 = 0 THEN '1' ELSE '' END) END AS number",
))

FILES = Shape("orders", (
    f"{O} AS file_id",
    "concat('doc', " + text(O) + ", " + pick(O, ['.PDF', '.docx', '.json', '.tar.csv', '.md', '.txt', '.png', '', '.', '. txt ']) + ") AS name",
    pick(f"{O} * 3", ['application/pdf', 'text/plain', 'text/x-markdown', 'image/png', 'TEXT/HTML', '', 'application/json',
                      'application/vnd.openxmlformats-officedocument.wordprocessingml.document']) + " AS mime_type",
    f"cast(CASE WHEN {O} % 19 = 0 THEN 0 WHEN {O} % 23 = 0 THEN 15728641 ELSE {O} * 11 END AS bigint) AS n_bytes",
    f"CASE WHEN {O} % 29 = 0 THEN NULL ELSE 'x' END AS payload",
    f"cast(CASE WHEN {O} % 13 = 0 THEN 60001 ELSE {O} % 60000 END AS bigint) AS text_chars",
    f"CASE WHEN {O} % 7 = 0 THEN false ELSE true END AS consented",
))

TOKEN_PREDICTIONS = Shape("orders", (
    f"{block(O, 10)} AS page_id",
    f"{O} AS token_idx",
    pick(O, ['Asha Rao', '##son', ' Delhi ', 'Acme Corp', '', 'Pune', 'Red', '  ', 'x']) + " AS word",
    pick(f"{O} * 5", [None, 'B-PER', 'I-ORG', 'B-LOC', 'O', 'B-MISC', 'i-per']) + " AS entity",
    pick(f"{O} * 3", [None, 'PER', 'ORG', 'LOC', 'MISC', None, 'per', '']) + " AS entity_group",
    f"cast(({O} * 7) % 101 AS double) / 100 AS score",
    f"cast({O} % 40 AS bigint) AS span_start",
    f"CASE WHEN {O} % 11 = 0 THEN false ELSE true END AS has_rect",
))

PROFILE_TEXTS = Shape("orders", (
    f"{O} AS doc_id",
    "concat("
    + pick(O, ['# Resume', '**Website:** https://a.example', 'Intro line without a pair', '| a | b |', '---', '']) + ", chr(10), "
    + pick(f"{O} * 3 + 1", ['Full Name', 'Name', "Father's Name", 'Candidate', 'First Name', 'Guardian'])
    + f", ': Person ', {text(O)}, chr(10), "
    + pick(O, ['Email', 'E-mail id', 'Mail']) + f", ' = u', {text(O)}, '@example.com', chr(13), chr(10), "
    + pick(f"{O} + 2", ['Aadhaar: 2345 6789 0123', 'PAN: ABCDE1234F', 'Skills: Python, JS', 'CGPA - 8.1', 'Contact: office',
                        'UPI: rahul@oksbi', 'City: Pune', 'http://x: y', 'use this: now', 'Passport: L1234567', 'PIN Code: 400001']) + ", chr(10), "
    + "'_Mobile_: 98765', " + padded(f"{O} % 100000", 5) + ", chr(10), "
    + "'DOB: 0', " + text(f"1 + {O} % 9") + ", '-11-1999', chr(10), "
    + pick(f"{O} * 7", ['Annual Income: 450000', 'Bank Account: 4532015112830366', 'IFSC: HDFC0ABC123', 'MRN: AB-12345',
                        'Diagnosis: mild asthma', 'Salary: 1,200.50', 'Account Number: 123456789012', 'Insurance: INS-778899',
                        'College: City Law School', 'State: Kerala']) + ", chr(10), "
    + "'Full Name: Second Person') AS text",
))

INDIC_TEXTS = Shape("orders", (
    f"{O} AS doc_id",
    pick(O, ['मेरा नाम: आशा राव', 'mera naam Asha Rao hai and email', 'शहर: पुणे', 'main Pune me rehta hoon Nagpur in',
             'ईमेल है asha@example.com', 'I live in Delhi', 'hello', 'meraa   naam: Ravi and city शहर: Mumbai hai'])
    + " AS text",
))

RAW_PROFILES = Shape("customer", (
    f"{C} AS user_id",
    pick(C, [
        '{"Full Name":"Ravi","Email":"ravi@test.com","age":"42"}',
        'Name: Asha',
        '{"Aadhaar":"2345 6789 0123","City":"Pune"}',
        '   ',
        '["a","b"]',
        'free text without pairs',
        '{"Phone":"9876543210","Note":"ABCDE1234F","blank":""}',
        '{broken',
        '42',
        'key only:',
        None,
        '{"Favourite Colour":"blue","Mother Tongue":"Hindi"}',
    ]) + " AS base",
    f"{C} % 3 AS extra_lines",
))
RAW_PROFILE_TEXT = (
    "CASE WHEN base = 'Name: Asha' THEN concat(' Name : Asha ', chr(10), chr(10), CASE extra_lines WHEN 0 THEN 'City: Pune: East' "
    "WHEN 1 THEN 'no pair here' ELSE 'Name: Rao' END) ELSE base END"
)

#: Candidate objects of replies; the queries' SQL reads these, the operator has to find them in the prose.
CANDIDATES = [
    '{"action":"click","selector":" #go "}', '{"action":"type","selector":"#a","value":"x { y"}', '{"note":1}', '{"action":"scroll","direction":"down"}',
    '{"action":"done","summary":"ok"}', '{"action":"unknown","selector":"#x"}', '{"action":"hover","selector":"#y"}', '{"action":"type","selector":"#a","value":5}',
    '{"action":"click","text":" Go "}', '{"action":"click","x":10.5,"y":20}', '{"action":"click","x":"10","y":20}', '{"action":"click","selector":"","x":70000,"y":1}',
    '{"action":"fill_many","fields":[{"selector":"#a","value":"1"},{"selector":" #a","value":"2"},{"selector":"#b","value":3},{"action":"type","selector":"#c","value":"4"},{"action":"click","selector":"#d","value":"5"}]}',
    '{"action":"fill_many","fields":[{"selector":"#only","value":"v","profileKey":"k"}]}', '{"action":"fill_many","fields":[{"selector":"<x>","value":"v"}]}',
    '{"action":"fill_many","fields":"none"}', '{"action":"navigate","url":"https://shop.example/a?b=1"}', '{"action":"navigate","url":7}', '{"action":"wait","ms":50}',
    '{"action":"wait","ms":"50"}', '{"action":"key_press","key":"Tab"}', '{"action":"key_press","key":1}', '{"action":"write_code","value":"print(1)"}',
    '{"action":"write_code","code":7}', '{"action":"extract_text","selector":"#t"}', '{"action":"focus","selector":9}', '{"action":"select","selector":" #s","value":3}',
    '{"action":"fill_field","field_selector":"#f","value":"w"}', '{"action":3}', '{"action":"clear","selector":"#q"}',
    '{"action":"fill","fields":{"Full name":"John Doe","City":" and ","Favourite":"blue"}}', '{"action":"fill","fields":[]}', '{"action":"fill","fields":"x"}',
    '{"action":"fill","fields":[{"selector":"#f1","label":"E-mail","value":"a@b.c"},{"label":"Notes","value":"and"},{"profileKey":"City","selector":"#none","value":5},7]}',
]

REPLIES = Shape("orders", (
    f"{O} AS reply_id",
    f"{block(O, 80)} AS user_id",
    f"concat({pick(f'{O} * 3', ['Sure. ', '```json', '', 'I think }} it is: '])}, {pick(O, CANDIDATES)}, {pick(f'{O} * 5', [' or else ', ' ', ' then '])}, "
    f"{pick(f'cast(floor({O} / 34) AS bigint)', CANDIDATES)}, {pick(f'{O} * 7', [' Let me know.', '', ' broken {', ' trailing } brace'])}) AS raw",
    f"{pick(O, CANDIDATES)} AS c1",
    f"{pick(f'cast(floor({O} / 34) AS bigint)', CANDIDATES)} AS c2",
))

ACTIONS = Shape("orders", (
    f"{O} AS action_id",
    f"{block(O, 12)} AS session_id",
    f"cast({O} % 12 AS bigint) AS step",
    pick(O, ['click', 'type', 'scroll', 'navigate', 'done', 'write_code', 'key_press', 'hover', 'wait', 'select',
             'clear', 'explode', 'click', 'fill_field', 'fill_many', 'focus', 'extract_text']) + " AS action",
    pick(f"{O} * 3 + 1", ['#go', ' #name_input ', None, 'input[name="q"]', '<script>', '', '*', 'a:nth-of-type(2) > b']) + " AS selector",
    pick(O, [None, 'Submit', '  ']) + " AS text",
    f"CASE WHEN {O} % 5 = 0 THEN NULL ELSE cast(({O} * 977) % 90000 AS double) / 2 - 500 END AS x",
    f"CASE WHEN {O} % 7 = 0 THEN NULL ELSE cast(({O} * 577) % 70000 AS double) / 4 END AS y",
    f"CASE WHEN {O} % 11 = 0 THEN NULL WHEN {O} % 13 = 0 THEN lpad('v', 2001, 'v') WHEN {O} % 17 = 0 THEN lpad('w', 150, 'w') "
    f"ELSE concat('val ', {text(f'{O} % 50')}) END AS value",
    pick(O, ['print(1)', None, '']) + " AS code",
    pick(f"{O} + 1", ['up', 'down', 'left', None]) + " AS direction",
    pick(O, ['https://a.example/x', 'ftp://a.example', 'javascript:alert(1)', 'HTTP://b.example', 'not a url', None]) + " AS url",
    f"CASE WHEN {O} % 3 = 0 THEN NULL ELSE lpad('s', cast(1 + {O} % 700 AS int), 's') END AS summary",
    pick(O, ['Enter', None, 'Tab']) + " AS key",
    f"CASE WHEN {O} % 2 = 0 THEN NULL ELSE cast({O} % 5000 AS double) END AS ms",
    f"CASE WHEN {O} % 10 = 0 THEN 'please type this into the editor' ELSE 'what is it' END AS prompt",
    pick(f"{O} * 5 + 2", ['success', 'error', 'skipped', 'success', 'error']) + " AS result",
    f"CASE WHEN {O} % 4 = 0 THEN false ELSE true END AS approved",
    f"cast({O} % 3 AS int) AS n_fields",
))

#: The one nested hidden element of the form pages; the SQL side takes it out as this string.
NESTED_HIDDEN = '<div style="display:none"><div>a</div>SECRET<div><div>b</div></div>2345 6789 0123</div>'

FORM_PAGES = Shape("customer", (
    f"{C} AS page_id",
    f"concat({pick(C, ['https://', 'http://', 'http://'])}, {pick(f'{C} * 3', ['shop.example', 'localhost:8080', 'bank.example.org', '127.0.0.1'])}, '/p', {text(C)}) AS url",
    "concat('<html><body>', "
    + pick(C, ['', '<script src="https://www.google-analytics.com/a.js"></script>',
               '<script src="/local.js"></script><script async src="https://cdn.hotjar.com/h.js"></script>',
               '<script src=\"https://static.segment.io/x.js\"></script><script src="https://x.doubleclick.net/y.js"></script>']) + ", "
    + f"'<form action=\"', {pick(f'{C} * 5', ['/submit', 'http://evil.example/x', 'https://pay.shop.example/x', 'https://shop.example/y', ''])}, '\">', "
    + pick(f"{C} + 1", ['<input type="password" name="pw" id="pw">', '<INPUT TYPE="PASSWORD" NAME="p2"><input type="password">', '']) + ", "
    + pick(f"{C} * 7", ['<input name="card_no" placeholder="Card">', '<textarea id="otp-box"></textarea><input name="pan number">',
                        '<input name="username" value="Asha" disabled>', '<select name="city"><option>Pune</option></select>', '']) + ", "
    + pick(f"{C} * 11", ['<input type="checkbox" checked aria-label="I agree to marketing">', '<input type="checkbox" checked aria-label="Remember me">',
                         '<input type="checkbox" aria-label="newsletter">', '', '<label><input type="checkbox" checked name="wrapped"> I agree to share &amp; sell</label>',
                         '<label for="c9">Subscribe to the newsletter</label><input type="checkbox" id="c9" checked>', '<label>Other</label><input type="checkbox" checked aria-label="consent">',
                         '<label>Remember me <input type="checkbox" checked></label><label><input type="checkbox" checked> I agree to share</label>',
                         '<label><input type="checkbox" checked> I agree to share</label><label>Remember me <input type="checkbox" checked></label>',
                         '<div contenteditable="true" id="note">x</div><p contenteditable=false>y</p><span class="e" contenteditable>z</span>']) + ", "
    + f"'</form>', {pick(f'{C} * 13', ['', NESTED_HIDDEN + '<div>shown</div>', '<p hidden>one</p>two'])}, '<p>', {pick(C, ['ID 2345 6789 ', 'ref ', 'PAN ABCDE1234F and ', 'don&#8217;t &amp;lt; ', '&eacute;t&eacute; &#x1F600; &unknown; '])}, {padded(f'{C} % 10000', 4)}, '</p></body></html>') AS html",
))

LABELS_SEEN = Shape("customer", (
    f"{C} AS label_id",
    pick(C, ["Full Name", "Father's Name", "PIN Code", "**Website**", "GitHub URL", "Aadhaar No", "Contact", "Blood", "Emergency Contact No",
             "My Skills", "Mother Tongue", "CGPA (10)", "Sem", "University Name", "xyz", "Job", "Driving Licence", "E-mail", "Mail",
             "Alternate Phone", "Year of Study", "  ", "Department", "Projects", "Org", "State/Province", "Nationality", "Card Number",
             "Lang", "Date of Birth", "Permanent Address", "Roll", "Title", "Insurance Id", "IFSC Code", "City of birth"])
    + " AS label",
))

PROFILE_ENTRIES = Shape("customer", (
    f"{block(C, 8)} AS user_id",
    f"{C} AS entry_idx",
    pick(C, ['Full Name', 'email', 'Phone', 'notes', 'City', 'Date of Birth', 'jobTitle', '_docSource:a', 'Guardian Name', 'skills', "Father's Name"])
    + " AS key",
    f"CASE WHEN {C} % 13 = 0 THEN '' WHEN {C} % 11 = 3 THEN 'met Asha Rao in Pune' ELSE concat(c_mktsegment, ' ', {text(f'{C} % 40')}) END AS value",
    f"cast(1700000000 + {C} * 37 % 5000 AS bigint) AS updated_at",
    f"CASE WHEN {C} % 5 = 0 THEN 'stored' WHEN {C} % 5 = 1 THEN 'popup' ELSE 'extracted' END AS origin",
))

USER_FIELDS = Shape("orders", (
    f"{block(O, 80)} AS user_id",
    f"{O} AS field_idx",
    f"concat('#f', {text(f'{O} % 60')}) AS selector",
    pick(f"{O} * 3", ['Full name *', 'E-mail', 'Phone number', 'City', 'Job Title', '', 'Applicant name', 'Skills', 'DOB', 'Date of Birth',
                      'Surname', 'Notes', 'Email address']) + " AS label",
    pick(O, ['text_input', 'text_input', 'text_input', 'password_input', 'sensitive_input']) + " AS type",
))

GT_ELEMENTS = Shape("customer", (
    f"{block(C, 12)} AS page_id",
    f"concat('#e', {text(f'{C} % 12')}) AS selector",
    f"CASE WHEN {C} % 3 = 0 THEN false ELSE true END AS sensitive",
    pick(C, ['password', 'email', 'card', 'plain', 'ssn']) + " AS type",
    pick(C, ['visible text', 'input type', 'keyword']) + " AS reason",
))

DETECTIONS = Shape("customer", (
    f"{block(C, 12)} AS page_id",
    f"concat('#e', {text(f'({C} * 5) % 9')}) AS selector",
    f"CASE WHEN {C} % 4 = 3 THEN false ELSE true END AS fired",
))

ERROR_MESSAGES = Shape("orders", (
    f"{O} AS row_id",
    pick(O, ['NO_CONTENT_SCRIPT: x', 'Error: Could not establish connection.', 'No active tab found', 'FACE_MODEL missing', 'NER_REDACTION_REQUIRED: y',
             'text cannot be sent to a remote AI', 'STRUCTURE_TOO_LARGE: 9', 'SCAN_ABORTED', 'call timed out after 60 s', 'VLM_BAD_RESPONSE: {',
             'VLM timed out', 'VLM is down', 'Inference worker failed: 1', 'ort-wasm missing', 'offscreen closed', "Unexpected token 'S'",
             'is not valid JSON', 'something else', '', 'STRUCTURE_RATE_LIMITED', 'STRUCTURE_CONSENT_REQUIRED', 'STRUCTURE_EMPTY_TEXT']) + " AS message",
))

RELEASES = Shape("orders", (
    f"{O} AS release_id",
    f"CASE WHEN {O} % 31 = 0 THEN false ELSE true END AS sanitized",
    pick(O, [None, None, None, None, None, None, 'model crashed', '']) + " AS error",
    pick(f"{O} * 3", ['data:image/png;base64,AA', 'data:image/jpeg;base64,BB', '', None, 'data:text/plain,x', 'data:image/png;base64,CC',
                      'data:image/png;base64,DD']) + " AS image",
    f"CASE WHEN {O} % 5 = 0 THEN false WHEN {O} % 37 = 0 THEN NULL ELSE true END AS face_pass",
    f"CASE WHEN {O} % 7 = 0 THEN false ELSE true END AS ner_pass",
    f"CASE WHEN {O} % 2 = 0 THEN true ELSE false END AS face_enabled",
    f"CASE WHEN {O} % 3 = 0 THEN false ELSE true END AS ner_enabled",
))

ENDPOINTS = Shape("customer", (
    f"{C} AS row_id",
    pick(C, ['http://localhost:8080/v1', 'http://127.0.0.1/x', 'http://[::1]:11434/api', 'https://api.example.com/v1', 'garbage', '', None,
             'http://localhost.evil.example/', 'HTTP://LOCALHOST/']) + " AS endpoint",
    f"concat('snippet ', {text(C)}) AS snippet",
))

AUDIT_ROWS = Shape("orders", (
    f"{O} AS row_id",
    f"concat('site', {text('o_custkey % 40')}, '.example') AS domain",
    f"CASE WHEN {O} % 4 = 0 THEN NULL ELSE cast({O} % 7 AS bigint) END AS fields_redacted",
    f"CASE WHEN {O} % 3 = 0 THEN NULL ELSE cast({O} % 5 AS bigint) END AS fields",
    f"CASE WHEN {O} % 6 = 0 THEN cast({O} % 4 AS bigint) ELSE NULL END AS faces_detected",
    f"CASE WHEN {O} % 2 = 0 THEN cast({O} % 3 AS bigint) ELSE NULL END AS faces",
    f"CASE WHEN {O} % 5 = 0 THEN concat('t', {text(O)}) ELSE NULL END AS timestamp",
    f"CASE WHEN {O} % 8 = 0 THEN NULL ELSE concat('at ', {text(O)}) END AS time",
))

REGIONS = Shape("part", (
    f"{block(P, 10)} AS page_id",
    f"{P} AS region_id",
    pick(P, ['password_input', 'sensitive_input', 'contenteditable_pii', 'face', 'photo', 'pii', 'filled_input', 'other']) + " AS type",
    f"cast(({P} * 37) % 1400 AS double) - 50 AS x",
    f"cast(({P} * 53) % 900 AS double) - 40 AS y",
    f"cast(CASE WHEN {P} % 17 = 0 THEN 0 ELSE 10 + p_size * 3 END AS double) AS w",
    f"cast(8 + p_size * 2 AS double) AS h",
    f"CASE {P} % 3 WHEN 0 THEN cast(1 AS double) WHEN 1 THEN cast(2 AS double) ELSE cast(1.25 AS double) END AS dpr",
    "cast(1280 AS bigint) AS canvas_w",
    "cast(720 AS bigint) AS canvas_h",
))

TEXT_NODES = Shape("part", (
    f"{block(P, 20)} AS page_id",
    f"{P} AS node_idx",
    f"concat(p_name, ' ', p_brand, ' ', p_type) AS text",
    f"cast(({P} * 3) % 500 AS double) AS x",
    f"cast(({P} * 7) % 500 AS double) AS y",
))
UNBOXED_SPANS = Shape("part", (
    f"{block(P, 20)} AS page_id",
    f"{P} AS span_id",
    f"CASE WHEN {P} % 4 = 0 THEN concat('Brand#', {text(f'{P} % 25')}) WHEN {P} % 4 = 1 THEN p_type WHEN {P} % 4 = 2 THEN p_name ELSE 'zz' END AS span_text",
))

CONFIGS = Shape("customer", (
    f"{C} AS config_id",
    f"{pick(C, ['apiKey', 'model', 'token', 'vlmApiKey'])} AS k1",
    f"{pick(f'{C} * 3', ['timeout', 'secret', 'theme2', 'authorization2'])} AS k2",
    f"{pick(f'{C} * 5', ['theme', 'authorization', 'Token'])} AS k3",
    f"concat('v', {text(C)}) AS v1",
    "'two' AS v2",
    "'three' AS v3",
))

RUNS = Shape("orders", (
    f"{O} AS run_id",
    f"cast(1 + {O} % 12 AS bigint) AS step",
    f"CASE WHEN {O} % 9 = 0 THEN 'capture failed' ELSE NULL END AS capture_error",
    f"CASE WHEN {O} % 7 = 0 THEN 'model failed' ELSE NULL END AS model_error",
    pick(O, ['click', None, 'done', 'fill_many', 'type']) + " AS action",
    f"CASE WHEN {O} % 11 = 0 THEN 'exec failed' ELSE NULL END AS exec_error",
    f"cast({O} % 6 AS bigint) AS filled",
    f"CASE WHEN {O} % 5 = 2 THEN concat('finished ', {text(O)}) ELSE NULL END AS summary",
))

FILL_ITEMS = Shape("lineitem", (
    "l_orderkey AS action_id",
    "(cast(l_linenumber AS bigint) * 10000000 + l_partkey) * 100000 + l_suppkey AS pos",
    pick("l_partkey", ['#a', ' #a ', '#b', '#c', '', '*bad*', '#d']) + " AS selector",
    f"CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE concat('v', {text('l_suppkey')}) END AS value",
))

SCANS = Shape("orders", (
    "o_custkey AS tab_id",
    f"{O} AS scan_id",
    f"cast({O} % 4 AS bigint) AS epoch",
    "o_orderstatus AS payload",
))

CONTROL_LABELS = Shape("customer", (
    f"{block(C, 15)} AS page_id",
    f"{C} AS label_idx",
    f"concat('f', {text(f'{C} % 11')}) AS for_id",
    f"{pick(C, [' Card number ', '', 'Your name', '  '])} AS label_text",
))

PHOTOS = Shape("part", (
    f"{block(P, 10)} AS page_id",
    f"{P} AS box_id",
    f"cast(({P} * 37) % 1600 - 150 AS double) AS x",
    f"cast(({P} * 53) % 1000 - 120 AS double) AS y",
    f"cast(20 + ({P} * 29) % 300 AS double) AS w",
    f"cast(20 + ({P} * 41) % 200 AS double) AS h",
    "cast(1280 AS double) AS viewport_w",
    "cast(720 AS double) AS viewport_h",
))

PAGE_META = Shape("customer", (
    f"{C} AS page_id",
    f"concat('#f', {text(C)}) AS selector",
    "c_name AS label",
    f"{pick(C, ['text_input', 'password_input', 'sensitive_input'])} AS type",
    f"CASE {C} % 4 WHEN 0 THEN cast(2 AS double) WHEN 1 THEN cast(1.5 AS double) WHEN 2 THEN cast(1 AS double) ELSE cast(1.25 AS double) END AS dpr",
    f"cast(({C} * 7) % 1501 AS double) AS viewport_w",
    f"cast(700 + {C} % 3 AS double) AS viewport_h",
    f"concat('https://site.example/', {text(C)}) AS url",
    f"concat('Title ', {text(C)}) AS title",
))

PREDICTED_BOXES = Shape("part", (
    f"{block(P, 40)} AS image_id",
    f"{P} AS pred_id",
    f"cast(({P} * 37) % 300 + {P} % 9 AS double) AS x1",
    f"cast(({P} * 53) % 200 + {P} % 7 AS double) AS y1",
    f"cast(({P} * 37) % 300 + 22 + p_size AS double) AS x2",
    f"cast(({P} * 53) % 200 + 19 + p_size AS double) AS y2",
))

RAW_FACES = Shape("part", (
    f"{P} AS face_id",
    f"cast(200 + ({P} * 97) % 2600 AS double) AS width",
    f"cast(150 + ({P} * 61) % 1900 AS double) AS height",
    f"cast(({P} * 13) % 100 AS double) / 100 AS ymin",
    f"cast(({P} * 17) % 100 AS double) / 100 AS xmin",
    f"cast(({P} * 13) % 100 + 8 AS double) / 100 AS ymax",
    f"cast(({P} * 17) % 100 + 9 AS double) / 100 AS xmax",
))

IMAGE_HEADERS = Shape("orders", (
    f"{O} AS image_id",
    f"cast(8 + ({O} * 37) % 900 AS bigint) AS true_width",
    f"cast(6 + ({O} * 53) % 700 AS bigint) AS true_height",
    f"CASE {O} % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'gif' END AS kind",
))

STRUCT_ENTRIES = Shape("orders", (
    f"{block(O, 200)} AS doc_id",
    f"{O} AS pos",
    f"CASE WHEN {O} % 31 = 0 THEN 'panRef' WHEN {O} % 37 = 0 THEN lpad('k', 65, 'k') WHEN {O} % 41 = 0 THEN '  ' "
    f"WHEN {O} % 7 = 0 THEN concat(' key', {text(f'{O} % 150')}, ' ') ELSE concat('key', {text(f'{O} % 150')}) END AS key",
    f"CASE WHEN {O} % 13 = 0 THEN '2345 6789 9012' WHEN {O} % 17 = 0 THEN lpad('v', 2001, 'v') WHEN {O} % 19 = 0 THEN ' ' ELSE concat(' v', {text(O)}) END AS value",
    f"CASE WHEN {O} % 23 = 0 THEN 'number' ELSE 'string' END AS value_type",
))

TYPED_VALUES = Shape("orders", (
    f"{O} AS row_id",
    pick(O, ['dob', 'gender', 'city']) + " AS key",
    pick(O, ['1/2/1999', 'M', ' Pune ', '03-11-2001', 'Woman', 'x', '12.12.1980', 'nonbinary', '', '1999-01-02', 'other', 'y']) + " AS value",
))

SKIPPED_KEYS = Shape("customer", (
    f"{C} AS user_id",
    pick(C, ['email', 'city', 'country', 'fullName', 'never']) + " AS key",
))

CLAIMS = Shape("orders", (
    f"{O} AS claim_id",
    f"{block(O, 80)} AS user_id",
    pick(f"{O} * 3", ['Full name', 'Email', 'Phone number', 'City', '', 'Job Title', 'Father name', 'Notes']) + " AS label",
    pick(f"{O} * 5", ['Full Name', 'email', 'phone', None, 'jobTitle', 'zzz', 'city', '', "Father's Name"]) + " AS profile_key",
    "CASE " + f"{O} % 7 WHEN 0 THEN 'asha rao' WHEN 1 THEN 'x' WHEN 2 THEN ' INVENTED value ' WHEN 3 THEN 'and' ELSE concat("
    + pick(block(O, 7), ['BUILDING ', 'machinery ', 'AUTOMOBILE ', 'Household ', 'FURNITURE ']) + f", {text(f'{O} % 40')}) END AS value",
))

SHAPES: dict[str, Shape] = {
    name.lower(): value for name, value in list(globals().items()) if isinstance(value, Shape)
}


def cte(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the oracle side."""
    return "WITH " + ", ".join(f"{n} AS ({SHAPES[n].sql()})" for n in names)
