"""Small builders for the oracle SQL: literals, patterns and shared fragments."""

from __future__ import annotations

from redactframe import rules

SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def one(v):
        return lit(v) if v is None or isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows) + ")"


def in_list(items: list[str]) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def trim(x: str) -> str:
    return f"trim({x}, {SPACE})"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def squash(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '\\D', '', 'g')"


def has(x: str, pattern: str, ignore_case: bool = False) -> str:
    flag = "(?i)" if ignore_case else ""
    return f"regexp_matches({x}, {lit(flag + pattern)})"


def any_has(x: str, patterns: list[str], ignore_case: bool = False) -> str:
    return "(" + " OR ".join(has(x, p, ignore_case) for p in patterns) + ")"


# RE2 has no look-around: the same languages, written without it.
RE2_NEVER_STORE = {
    "AADHAAR": (dict(rules.NEVER_STORE_VALUES)["AADHAAR"], rules.REDACTED),
    "PAN": (dict(rules.NEVER_STORE_VALUES)["PAN"], rules.REDACTED),
    "DL": (dict(rules.NEVER_STORE_VALUES)["DL"], rules.REDACTED),
    "UPI": (r"[\w.\-]{2,}@[a-z]{2,}([^.\w]|$)", rules.REDACTED + r"\1"),
    "PASSPORT": (dict(rules.NEVER_STORE_VALUES)["PASSPORT"], rules.REDACTED),
    "BANK_ACCOUNT": (r"\b(?:\d{9}|[0-5]\d{9}|\d{11,18})\b", rules.REDACTED),
}


def scrub(x: str) -> str:
    for pattern, replacement in RE2_NEVER_STORE.values():
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return x


def never_store_value(x: str) -> str:
    return any_has(x, [p for p, _ in RE2_NEVER_STORE.values()])


URL_SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::\d*)?)?"


def scheme(x: str) -> str:
    return f"lower(nullif(regexp_extract({x}, {lit(URL_SHAPE)}, 1), ''))"


def host(x: str) -> str:
    return f"lower(nullif(trim(regexp_extract({x}, {lit(URL_SHAPE)}, 2)), ''))"
