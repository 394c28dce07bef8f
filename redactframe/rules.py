"""Rule tables that drive the operators.

Everything in this module is a FIXED VALUE: word lists, patterns, limits and
lookup tables whose exact content decides the results. They are stated plainly,
in their natural order, and compiled to column expressions elsewhere. Order
matters wherever a table is described as "first match wins".
"""

# --- fixed values: text patterns -------------------------------------------
# ``\b`` is written as in the rule; functions.text.jvm_regex gives it the ASCII
# meaning on the JVM.

SPAN_PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("IN_MOBILE", r"\b[6-9]\d{9}\b"),
    ("AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
]

ELEMENT_PATTERNS = [
    ("email", "email_pii", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    (
        "phone",
        "phone_pii",
        r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b|\+91\s?\d{5}\s?\d{5}\b",
    ),
    ("ssn", "ssn_pii", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("card16", "card_pii", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("aadhaar", "aadhaar_pii", r"\b\d{4}\s\d{4}\s\d{4}\b"),
]
ELEMENT_MIN_CHARS = 4

CARD_CANDIDATE = r"\b\d(?:[ -]?\d){12,18}\b"
CONTENTEDITABLE_CARD = r"\b\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\b"

# Values that must never be stored, in the order they are scrubbed.
NEVER_STORE_VALUES = [
    ("AADHAAR", r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("DL", r"[A-Z]{2}[- ]?\d{13}|[A-Z]{2}[- ]?\d{2}[- ]?\d{11}"),
    ("UPI", r"[\w.\-]{2,}@[a-z]{2,}(?![.\w])"),
    ("PASSPORT", r"\b[A-Z][1-9]\d{6,7}\b"),
    ("BANK_ACCOUNT", r"\b(?!([6-9]\d{9})\b)\d{9,18}\b"),
]
REDACTED = "[REDACTED]"

VAULT_NEVER_STORE_KEY = (
    r"aadhaar|uidai|pan\b|cvv|cvc|passport|upi|ssn|bank.?account|credit.?card|debit.?card|"
    r"licen[cs]e|driving|dl\b|voter|elector|account.?no|account.?number|card.?number|ifsc|iban|swift"
)
PROFILE_NEVER_STORE_KEY = (
    r"aadhaar|uidai|pan\b|cvv|cvc|passport|upi|ssn|credit\.?card|debit\.?card|licen[cs]e|driving|"
    r"dl\b|voter|elector|card\.?number|iban|swift|api\.?key|access\.?token"
)

# --- fixed values: form fields ----------------------------------------------
SENSITIVE_AUTOCOMPLETE = [
    "cc-number", "cc-exp", "cc-csc", "cc-name", "cc-type", "transaction-amount",
]
SENSITIVE_KEYWORDS = [
    "password", "pin", "secret", "ssn", "social-security",
    "credit", "card", "cvv", "csc", "otp", "aadhaar", "pan",
]
UNFILLABLE_INPUT_TYPES = [
    "hidden", "button", "submit", "reset", "image", "file",
    "checkbox", "radio", "password", "range", "color",
]
MASKED_FIELD_TYPES = ["password_input", "sensitive_input", "contenteditable_pii"]

SAFE_FIELD_PATTERNS = [
    r"\b(revenue|gross|net|profit|loss|margin|growth|rate|percent|%)\b",
    r"\b(q1|q2|q3|q4|quarter|annual|monthly|weekly|ytd|mtd)\b",
    r"\b(units|count|total|sum|avg|average|mean|median)\b",
    r"\b(chart|graph|metric|kpi|dashboard|analytics|report)\b",
    r"\b(date|time|timestamp|created|updated|modified)\b",
    r"\b(status|state|stage|category|type|label|tag)\b",
    r"\b(ship(ping)?|billing|deliver(y|to))\b",
    r"\b(street|avenue|road|city|state|zip|postal)\b",
]
NEVER_STORE_FIELD_PATTERNS = [
    r"aadhaar|aadhar|uidai",
    r"\bpan\b|pan[_-]?number|permanent\s*account",
    r"passport",
    r"licen[cs]e\s*(no|number|num)",
    r"voter\s*(id|no|number)",
    r"account\s*(no|number|num)",
    r"\bcvv\b|\bcsc\b|card\s*(no|number|num)",
    r"ifsc|swift\s*(code)?",
    r"\bupi\s*(pin|id)\b",
    r"\bssn\b|social\s*security",
    r"tax\s*id|tin\b",
    r"\b(diagnosis|medication|prescription|mrn|medical\.?record|insurance|blood\.?type|blood\.?group|"
    r"patient\.?id|health|allerg|symptom|treatment)\b",
    r"\b(salary|income|compensation|wage|annual|revenue|bank\.?account|account\.?number|ifsc|routing|iban|"
    r"swift|api\.?key|secret\.?key|access\.?token|private\.?key|auth\.?token)\b",
    r"\b(aadhaar|pan\.?number|pan\.?card|passport|voter|ration|driving\.?licen|dl\.?number)\b",
]
CARDHOLDER_PATTERN = r"\b(card.?(holder|name|owner)|cc.?name|cardholder)\b"
CARD_EXPIRY_PATTERN = (
    r"\b(exp(iry|ir(ation|es)?|.?date)?|cc.?exp|card.*expir|valid.?thru|valid.?until)\b"
)
FIELD_CARD_VALUE = r"(?:\d[ -]*?){13,19}"
SMALL_NUMBER_MAX = 10000

# autocomplete token -> profile key (None = known but not stored); first match wins
AUTOCOMPLETE_KEYS = [
    ("name", "fullName"),
    ("given-name", "firstName"),
    ("family-name", "lastName"),
    ("email", "email"),
    ("tel", "phone"),
    ("tel-national", "phone"),
    ("bday", "dob"),
    ("bday-day", None),
    ("bday-month", None),
    ("bday-year", None),
    ("sex", "gender"),
    ("street-address", "addressLine1"),
    ("address-line1", "addressLine1"),
    ("address-line2", "addressLine2"),
    ("address-level2", "city"),
    ("address-level1", "state"),
    ("postal-code", "pincode"),
    ("country", "country"),
    ("country-name", "country"),
    ("organization", "college"),
    ("organization-title", "occupation"),
]

# profile key <- keyword patterns; first rule wins
KEYWORD_KEYS = [
    ("fullName", [r"full\s*name", r"complete\s*name", r"applicant\s*name", r"candidate\s*name",
                  r"student\s*name", r"^name$", r"name\s*\(?\s*as\s*per"]),
    ("firstName", [r"first\s*name", r"given\s*name"]),
    ("lastName", [r"last\s*name", r"surname", r"family\s*name"]),
    ("guardianName", [r"guardian", r"father'?s?\s*name", r"mother'?s?\s*name", r"parent\s*name"]),
    ("email", [r"e-?mail"]),
    ("phone", [r"phone", r"mobile", r"contact\s*(no|number)", r"whats?app", r"\btel\b"]),
    ("dob", [r"date\s*of\s*birth", r"\bd\.?o\.?b\.?\b", r"birth\s*date"]),
    ("gender", [r"gender", r"\bsex\b"]),
    ("addressLine1", [r"address\s*(line)?\s*1", r"street\s*address", r"^address$",
                      r"residential\s*address", r"permanent\s*address", r"correspondence\s*address"]),
    ("addressLine2", [r"address\s*(line)?\s*2"]),
    ("pincode", [r"pin\s*code", r"\bpincode\b", r"postal\s*code", r"\bzip\b"]),
    ("city", [r"city", r"town\b", r"district"]),
    ("state", [r"state\b", r"province"]),
    ("country", [r"country", r"nationality"]),
    ("nationality", [r"nationality"]),
    ("college", [r"college", r"institut", r"universit", r"school\s*name"]),
    ("rollNumber", [r"roll\s*(no|number)", r"enrolment|enrollment\s*(no|number)?",
                    r"registration\s*(no|number)", r"reg\s*no", r"student\s*id"]),
    ("course", [r"course", r"program(\s*name)?", r"degree"]),
    ("branch", [r"branch", r"department", r"specialization|specialisation", r"\bstream\b"]),
    ("occupation", [r"occupation", r"profession", r"designation", r"job\s*title"]),
    ("annualIncome", [r"income", r"salary"]),
    ("sensitiveCode", [r"\b(otp|one.?time.?pass(word|code)?|verification.?code|passcode|pin.?code|"
                       r"portal.?pin|confirm.?pin)\b"]),
]
SENSITIVE_FIELD_KEYS = ["password", "cardholderName", "cardExpiry", "sensitiveCode"]

# --- fixed values: profile ---------------------------------------------------
PROFILE_KEYS = [
    "fullName", "firstName", "lastName", "email", "phone", "dob", "gender",
    "addressLine1", "addressLine2", "city", "state", "pincode", "country",
    "nationality", "college", "university", "rollNumber", "course", "branch",
    "yearOfStudy", "guardianName", "fatherName", "motherName", "emergencyContact",
    "bloodGroup", "occupation", "jobTitle", "organization", "annualIncome",
    "skills", "languages", "website", "github", "projectDescription", "cgpa",
    "semester", "department", "mrn", "insuranceId", "diagnosis", "salary",
    "bankAccount", "ifscCode",
]
PROFILE_LABELS = {
    "fullName": "Full Name",
    "firstName": "First Name",
    "lastName": "Last Name",
    "email": "Email",
    "phone": "Phone",
    "dob": "Date of Birth",
    "gender": "Gender",
    "addressLine1": "Address",
    "addressLine2": "Address Line 2",
    "city": "City",
    "state": "State",
    "pincode": "PIN Code",
    "country": "Country",
    "nationality": "Nationality",
    "college": "College",
    "university": "University",
    "rollNumber": "Roll Number",
    "course": "Course",
    "branch": "Branch",
    "yearOfStudy": "Year of Study",
    "guardianName": "Guardian Name",
    "fatherName": "Father's Name",
    "motherName": "Mother's Name",
    "emergencyContact": "Emergency Contact",
    "bloodGroup": "Blood Group",
    "occupation": "Occupation",
    "jobTitle": "Job Title",
    "organization": "Organization",
    "annualIncome": "Annual Income",
    "skills": "Skills",
    "languages": "Languages",
    "website": "Website",
    "github": "GitHub",
    "projectDescription": "Project Description",
    "cgpa": "CGPA",
    "semester": "Semester",
    "department": "Department",
}
LABEL_ALIASES = {
    "name": "fullName",
    "fullname": "fullName",
    "fathersname": "fatherName",
    "fathername": "fatherName",
    "mothersname": "motherName",
    "mothername": "motherName",
    "dateofbirth": "dob",
    "birthdate": "dob",
    "pincode": "pincode",
    "pin": "pincode",
    "zip": "pincode",
    "zipcode": "pincode",
    "mobilenumber": "phone",
    "mobile": "phone",
    "phonenumber": "phone",
    "tel": "phone",
    "address": "addressLine1",
    "streetaddress": "addressLine1",
    "addressline1": "addressLine1",
    "addressline2": "addressLine2",
    "institution": "college",
    "year": "yearOfStudy",
    "yearofstudy": "yearOfStudy",
    "job": "jobTitle",
    "title": "jobTitle",
    "company": "organization",
    "org": "organization",
    "employer": "organization",
    "income": "annualIncome",
    "salary": "annualIncome",
    "project": "projectDescription",
    "projectdescription": "projectDescription",
    "gpa": "cgpa",
    "blood": "bloodGroup",
    "bloodgroup": "bloodGroup",
    "emergency": "emergencyContact",
    "emergencycontact": "emergencyContact",
    "guardian": "guardianName",
    "language": "languages",
    "mothertongue": "languages",
}
SKIP_LABELS = (
    r"^(contact|education|address|family|project|projects|resume|demo|how this maps|suggested|use|"
    r"fields marked|identity|section)$"
)
NOISE_LABELS = r"^(use|suggested|fields marked|identity numbers)"
LABEL_VALUE_LINE = r"^([A-Za-z][A-Za-z0-9 .'/()&-]{0,48}?)\s*[:=\-–—]\s+(.+)$"
MAX_PROFILE_LINE_CHARS = 600
MAX_PROFILE_VALUE_CHARS = 2000
CLIP_PROFILE_VALUE_CHARS = 200

POPUP_ALIASES = {
    "fullname": "fullName",
    "full name": "fullName",
    "firstname": "firstName",
    "lastname": "lastName",
    "email": "email",
    "phone": "phone",
    "dob": "dob",
    "date of birth": "dob",
    "gender": "gender",
    "address": "addressLine1",
    "addressline1": "addressLine1",
    "city": "city",
    "state": "state",
    "pincode": "pincode",
    "pin code": "pincode",
    "college": "college",
    "course": "course",
    "organization": "college",
    "job title": "occupation",
    "father's name": "guardianName",
    "mother's name": "guardianName",
}

# cue patterns: (key, case-insensitive?, pattern with the value in group 1)
CUE_PATTERNS = [
    ("email", False, r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"),
    ("phone", False, r"((?:\+91[\s-]?)?[6-9]\d{9})"),
    ("dob", True, r"(?:DOB|Date of Birth|Birth\s*Date)[\s:]*(\d{2}[-/.]\d{2}[-/.]\d{4}|\d{4}[-/.]\d{2}[-/.]\d{2})"),
    ("fullName", True, r"(?:Full\s*Name|Name|Mera\s*naam|My\s*name\s*is)[\s:]*([A-Za-z\s]{3,35})"),
    ("city", True, r"(?:City|Location|Rehta\s*hoon|Raho)[\s:]*([A-Za-z\s]{3,20})"),
    ("state", True, r"(?:State)[\s:]*([A-Za-z\s]{3,20})"),
    ("pincode", True, r"(?:PIN|Pincode|Zip)[\s:]*(\d{6})"),
    ("college", True, r"(?:College|University|Institution)[\s:]*([A-Za-z\s]{3,40})"),
    ("annualIncome", True, r"(?:Income|Salary)[\s:]*(\d{5,10})"),
    ("mrn", True, r"(?:MRN|Medical Record Number)[\s:]*([A-Za-z0-9-]{5,20})"),
    ("insuranceId", True, r"(?:Insurance)[\s:]*([A-Za-z0-9-]{5,20})"),
    ("diagnosis", True, r"(?:Diagnosis)[\s:]*([A-Za-z0-9\s-]{3,40})"),
    ("salary", True, r"(?:Salary|Annual Compensation)[\s:]*([\d,\.]+)"),
    ("bankAccount", True, r"(?:Bank Account|Account Number)[\s:]*([\d-]{9,18})"),
    ("ifscCode", True, r"(?:IFSC)[\s:]*([A-Z]{4}0[A-Z0-9]{6})"),
]
CUE_NAME_NOISE = r"hai|is|and|email|phone|city"
CUE_CITY_NOISE = r"hai|in|is"
INDIC_NAME = r"मेरा\s*नाम[\s:]*([\x{0900}-\x{097F} A-Za-z]{2,40})"
INDIC_NAME_LATIN = r"(?:mera\s+naam|meraa\s+naam)[\s:]*([A-Za-z\s]{3,35})"
INDIC_NAME_NOISE = r"hai|है|and|email|phone|city|शहर"
INDIC_CITY = r"शहर[\s:]*([\x{0900}-\x{097F} A-Za-z]{2,24})"
INDIC_CITY_LATIN = r"(?:rehta\s*hoon|rahta\s*hun|I\s+live\s+in)[\s:]*([A-Za-z\s]{3,24})"
INDIC_CITY_NOISE = r"hai|है|in|is"
INDIC_EMAIL = r"(?:ईमेल|इमेल)\s*(?:है|:)?\s*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"

NAME_LIKE_KEYS = ["name", "fullname", "firstname", "lastname", "givenname", "familyname", "surname"]
FREE_TEXT_KEYS = ["raw", "notes", "Notes"]

MAX_STRUCT_FIELDS = 120
MAX_STRUCT_KEY_CHARS = 64
MAX_STRUCT_VALUE_CHARS = 2000

# Verhoeff: multiplication table of the dihedral group D5 and the position permutation
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]

# --- fixed values: documents and retrieval -----------------------------------
EXTENSION_FORMATS = [
    ("pdf", "pdf"), ("docx", "docx"), ("json", "json"), ("csv", "csv"), ("md", "md"), ("txt", "text"),
]
MIME_FORMATS = [
    ("application/pdf", "pdf"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"),
    ("application/json", "json"),
    ("text/csv", "csv"),
    ("text/markdown", "md"),
    ("text/x-markdown", "md"),
]
MAX_DOCUMENT_BYTES = 15 * 1024 * 1024
MAX_STRUCTURE_CHARS = 60000
NEEDS_OCR_CHARS = 50
PAGE_EXCERPT_CHARS = 4000
MIN_TEXT_NODE_CHARS = 3

VAULT_MAX_DOCS = 5
VAULT_MAX_BYTES = 256 * 1024
MAX_SNIPPET_CHARS = 400
DEFAULT_TOP_K = 3
MAX_TOP_K = 10
MAX_DOC_NAME_CHARS = 160
MAX_DOC_FORMAT_CHARS = 32
DOC_SOURCE_PREFIX = "_docSource"

STOPWORDS = (
    "a,an,the,and,or,but,not,no,so,if,of,in,on,at,for,with,by,from,as,to,into,about,"
    "what,which,who,whom,whose,where,when,why,how,is,are,was,were,be,been,being,am,"
    "do,does,did,have,has,had,will,would,can,could,should,shall,may,might,must,"
    "than,then,there,here,this,that,these,those,her,his,she,he,they,them,their,it,its,"
    "my,your,our,we,you,i,me,us,please,fill,out,till,over,under,between,during"
).split(",")
MIN_KEYWORD_CHARS = 3

# --- fixed values: risk, audit, gates ------------------------------------------
TRACKERS = [
    "google-analytics", "googletagmanager", "doubleclick", "facebook.net", "hotjar",
    "clarity.ms", "mixpanel", "amplitude", "segment.io", "intercom",
]
RISKY_DOMAINS = [
    "doubleclick.net", "googlesyndication.com", "google-analytics.com", "hotjar.com",
    "fullstory.com", "logrocket.com", "mixpanel.com", "amplitude.com", "segment.com",
    "heap.io", "clarity.ms", "mouseflow.com", "crazyegg.com", "inspectlet.com",
    "facebook.net", "connect.facebook.net", "twitter.com", "t.co", "linkedin.com",
]
RISK_SENSITIVE_INPUT = r"aadhaar|aadhar|pan\b|ssn|social.sec|credit|card|cvv|otp|passport"
RISK_CONSENT_LABEL = r"market|promo|newslet|adverti|partner|third.party|consent|agree"
# id, severity, points per hit, most points
RISK_FACTORS = [
    ("no_https", "high", 30, 30),
    ("password_fields", "medium", 10, 20),
    ("sensitive_inputs", "high", 15, 25),
    ("trackers", "medium", 5, 15),
    ("dark_patterns", "medium", 10, 15),
    ("pii_exposed", "high", 20, 30),
]
RISK_LABELS = {
    "no_https": "No HTTPS — data sent unencrypted",
    "password_fields": "{n} password field(s) exposed",
    "sensitive_inputs": "{n} sensitive input(s) detected",
    "trackers": "{n} tracker script(s) found",
    "dark_patterns": "{n} pre-ticked consent box(es)",
    "pii_exposed": "{n} ID number(s) visible in page",
}
RISK_GRADES = [(85, "A", "#16a34a"), (70, "B", "#65a30d"), (55, "C", "#d97706"), (35, "D", "#ea580c")]
RISK_LOWEST = ("F", "#dc2626")
LOCAL_HOSTS = ["localhost", "127.0.0.1"]
LOCAL_ENDPOINT_HOSTS = ["localhost", "127.0.0.1", "[::1]", "::1"]

ACTION_LOG_CAP = 500
SCAN_LOG_CAP = 50
FORBIDDEN_CONFIG_KEYS = ["vlmApiKey", "apiKey", "authorization", "token", "secret"]

# message substrings -> code; first rule wins
ERROR_RULES = [
    (["NO_CONTENT_SCRIPT", "Receiving end does not exist", "Could not establish connection"], "NO_CONTENT_SCRIPT"),
    (["No active tab"], "NO_ACTIVE_TAB"),
    (["FACE_REDACTION", "FACE_MODEL"], "FACE_REDACTION_REQUIRED"),
    (["NER_REDACTION", "NER_MODEL"], "NER_REDACTION_REQUIRED"),
    (["cannot be sent to a remote AI"], "STRUCTURE_REMOTE_REJECTED"),
    (["STRUCTURE_EMPTY_TEXT"], "STRUCTURE_EMPTY_TEXT"),
    (["STRUCTURE_TOO_LARGE"], "STRUCTURE_TOO_LARGE"),
    (["STRUCTURE_RATE_LIMITED"], "STRUCTURE_RATE_LIMITED"),
    (["STRUCTURE_CONSENT_REQUIRED"], "STRUCTURE_CONSENT_REQUIRED"),
    (["SCAN_ABORTED"], "SCAN_ABORTED"),
    (["timed out"], "TIMEOUT"),
    (["VLM_BAD_RESPONSE"], "VLM_BAD_RESPONSE"),
    (["VLM"], "BACKEND_UNAVAILABLE"),
    (["Inference worker failed"], "INIT_FAILED"),
    (["no available backend", "Failed to fetch dynamically imported module", "blob:chrome-extension",
      "blob URL path disabled", "inlined WASM factory missing", "ort-wasm"], "INIT_FAILED"),
    (["offscreen"], "OFFSCREEN_ERROR"),
    (["is not valid JSON", "Unexpected token", "Unexpected end of JSON", "JSON.parse"], "BAD_JSON"),
]

# --- fixed values: boxes ---------------------------------------------------------
NER_MIN_SCORE = 0.8
NER_GROUPS = ["PER", "ORG", "LOC"]
FACE_PAD_RATIO = 0.45
NMS_IOU = 0.4
NMS_MIN_SIDE = 2
LETTERBOX_SIDE = 128
TILE_MAX, TILE_MIN, TILE_RATIO, TILE_MIN_STRIDE, TILE_MIN_EDGE, TILE_CAP = 512, 160, 1.2, 128, 96, 24
PHOTO_MIN_SIDE, PHOTO_MAX_RATIO, PHOTO_MIN_RATIO = 48, 3.0, 0.25
MIN_IMAGE_SIDE = 28

# --- fixed values: actions --------------------------------------------------------
ACTION_SELECTOR_CHARS, ACTION_VALUE_CHARS, ACTION_SUMMARY_CHARS, ACTION_URL_CHARS = 256, 2000, 500, 2048
ACTION_KEY_CHARS = 50
ACTION_COORD_MAX = 65535
SELECTOR_SAFE = r"""^[\w#.\[\]="':()>+ ,-]*$"""
# the actions whose bare objects are cut out of a reply
REPLY_ACTIONS = (
    "click|type|write_code|scroll|navigate|done|fill_many|key_press|hover|extract_text|clear|focus|select|wait"
)
MAX_AGENT_STEPS = 10
MAX_LOOP_STEPS = 15
MAX_FAILURES = 2
LONG_VALUE_CHARS = 100
INJECTION_INTENT = (
    r"\b(write\s*(this\s*)?(to|into)\s*(the\s*)?(ide|editor)|type\s*(this\s*)?(into|in)\s*(the\s*)?(editor|field)|"
    r"inject\s*(this\s*)?(into|in)\s*(the\s*)?(page|field|editor)|"
    r"fill\s*(this\s*)?(into|in)\s*(the\s*)?(field|editor|form)|put\s*(it\s*)?in\s*(the\s*)?(editor|ide|field))\b"
)
MEMORY_TURNS = 6
MEMORY_CHARS = 500
SESSION_NAME_CHARS = 30
SESSION_NAME_EMOJI = "[📸🔒]"

# --- fixed values: evaluation targets and stream timings ---------------------------
EVAL_TARGETS = [
    ("precision", 0.90, "ge"),
    ("recall", 0.85, "ge"),
    ("f1", 0.875, "ge"),
    ("over_redaction", 0.10, "le"),
]
EVAL_IOU = 0.5
RATE_LIMIT_MS = 1000
