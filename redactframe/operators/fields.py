"""Form-control detection and classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactframe import rules
from redactframe.functions.checksums import luhn_valid
from redactframe.functions.text import any_match, first_present, let, matches, materialize, squash, trim, words


def selector() -> Column:
    """#id, then tag[name=".."], then tag.classes, then a positional stand-in.

    Without a DOM tree the last step numbers the control instead of giving its path.
    """
    classes = F.regexp_replace(trim(F.col("css_class")), r"\s+", ".")
    return (
        F.when(F.col("id") != "", F.concat(F.lit("#"), "id"))
        .when(F.col("name") != "", F.concat("tag", F.lit('[name="'), "name", F.lit('"]')))
        .when(classes != "", F.concat("tag", F.lit("."), classes))
        .otherwise(F.concat("tag", F.lit(":nth("), F.col("field_idx").cast("string"), F.lit(")")))
    )


def field_label() -> Column:
    """Label text, aria-label, placeholder, name, id: the first that is not blank."""
    return first_present(*[F.col(c) for c in ("label", "aria_label", "placeholder", "name", "id")])


def attribute_tokens() -> Column:
    joined = F.concat_ws(" ", "name", "id", "aria_label", "data_testid", "placeholder")
    return F.array_distinct(words(joined))


def sensitive_fields(controls: DataFrame, password_layer: bool = True) -> DataFrame:
    """Ordered rules per control; per page and selector the first rule (then document order) wins.

    A zero-size control still claims its selector, so it can hide a later visible twin.
    """
    tokens = attribute_tokens()
    hyphenated = [k for k in rules.SENSITIVE_KEYWORDS if "-" in k]
    keyword = F.arrays_overlap(tokens, F.array(*[F.lit(k) for k in rules.SENSITIVE_KEYWORDS]))
    for k in hyphenated:
        keyword = keyword | F.contains(F.array_join(tokens, "-"), F.lit(k))
    auto = reduce(
        lambda a, b: a | b, [F.contains(F.lower("autocomplete"), F.lit(k)) for k in rules.SENSITIVE_AUTOCOMPLETE]
    )
    is_input = F.col("tag") == "input"
    rule_no = (
        F.when(is_input & (F.col("type") == "password"), 1)
        .when(is_input & auto, 2)
        .when(F.col("tag").isin("input", "textarea") & keyword, 3)
        .when(F.col("contenteditable") & matches(F.col("content"), rules.CONTENTEDITABLE_CARD), 4)
    )
    reasons = F.array(
        F.lit('type="password"'),
        F.concat(F.lit('autocomplete="'), F.col("autocomplete"), F.lit('"')),
        F.lit("keyword match in attributes"),
        F.lit("potential card number in contenteditable"),
    )
    kinds = F.array(*[F.lit(k) for k in (
        "password_input", "sensitive_input", "sensitive_input", "contenteditable_pii")])
    hits = controls.withColumn("rule", rule_no).filter("rule IS NOT NULL").select(
        "page_id", selector().alias("selector"), "rule", "field_idx",
        F.get(reasons, F.col("rule") - 1).alias("reason"),
        F.get(kinds, F.col("rule") - 1).alias("type"),
        first_present(F.col("label"), F.col("placeholder"), F.col("aria_label")).alias("label"),
        "x", "y", "width", "height",
    )
    first = hits.groupBy("page_id", "selector").agg(
        F.min_by(
            F.struct("field_idx", "reason", "type", "label", "x", "y", "width", "height"),
            F.struct("rule", "field_idx"),
        ).alias("f")
    )
    out = first.select("page_id", "selector", "f.*").filter((F.col("width") != 0) & (F.col("height") != 0))
    return out if password_layer else without_passwords(out)


def without_passwords(fields: DataFrame) -> DataFrame:
    """The password layer switched off: those rows leave, all other layers stay."""
    return fields.filter(F.col("type") != "password_input")


def is_fillable() -> Column:
    typed = F.when(F.col("type") == "", "text").otherwise(F.lower("type"))
    return (
        ~F.col("disabled")
        & ~F.col("readonly")
        & (
            ((F.col("tag") == "input") & ~typed.isin(rules.UNFILLABLE_INPUT_TYPES))
            | F.col("tag").isin("select", "textarea")
        )
    )


def fillable_fields(controls: DataFrame) -> DataFrame:
    """Visible, editable controls, first per page and selector."""
    usable = controls.filter(is_fillable() & (F.col("width") != 0) & (F.col("height") != 0))
    rows = usable.select(
        "page_id", selector().alias("selector"), "field_idx", field_label().alias("label"),
        F.lit("text_input").alias("type"), (F.length(trim(F.col("value"))) > 0).alias("has_value"),
        "x", "y", "width", "height",
    )
    packed = rows.groupBy("page_id", "selector").agg(
        F.min_by(F.struct("field_idx", "label", "type", "has_value", "x", "y", "width", "height"), "field_idx").alias("f")
    )
    return packed.select("page_id", "selector", "f.*")


def fields_for_fill(fillable: DataFrame, sensitive: DataFrame) -> DataFrame:
    """All fillable fields plus the sensitive ones whose selector is not among them."""
    cols = ["page_id", "selector", "field_idx", "label", "type"]
    extra = sensitive.join(fillable.select("page_id", "selector"), ["page_id", "selector"], "left_anti")
    return fillable.select(*cols).unionByName(extra.select(*cols))


def is_safe_field(text: Column) -> Column:
    return (text != "") & any_match(text, rules.SAFE_FIELD_PATTERNS, ignore_case=True)


def classify_fields(controls: DataFrame) -> DataFrame:
    """One CASE chain in rule order: key, reason, sensitive.

    The reason names the step (and autocomplete token) that decided.
    """
    def words_of(*names):
        return F.concat_ws(" ", *[F.nullif(F.col(n), F.lit("")) for n in names])

    # The label counts twice in the text the rules see: as the control's own label and as resolved label.
    own_label = F.coalesce(
        F.nullif("label", F.lit("")), F.nullif("aria_label", F.lit("")), F.lit("")
    )
    id_text = F.concat(words_of("label", "name", "id", "aria_label", "title"), F.lit(" "), own_label)
    all_text = F.concat(words_of("label", "name", "id", "aria_label", "placeholder", "title"), F.lit(" "), own_label)
    safe_text = words_of("name", "id", "placeholder", "aria_label")
    auto = F.lower("autocomplete")
    auto_tokens = F.split(auto, r"\s+")

    d = controls.select(
        "page_id", "field_idx", "tag", "type", "readonly", "max", "value", "placeholder",
        id_text.alias("id_text"), all_text.alias("all_text"), safe_text.alias("safe_text"),
        auto.alias("auto"), auto_tokens.alias("auto_tokens"),
    )
    scannable = F.col("tag").isin("input", "textarea", "select", "button")
    addressed = F.col("auto").rlike("^(shipping|billing)-") & ~F.col("auto").rlike("cc-|bday")
    card_like = lambda c: F.col(c).rlike(rules.FIELD_CARD_VALUE) & luhn_valid(F.col(c))

    steps: list[tuple[Column, str | None, Column]] = [
        (~scannable, None, F.lit("not_scannable")),
        (F.col("type") == "password", "password", F.lit("password_type")),
        (is_safe_field(F.col("safe_text")), None, F.lit("allowlist_safe")),
        (addressed, None, F.lit("shipping_or_billing")),
        (F.col("readonly") & (F.col("type") == "number"), None, F.lit("readonly_number")),
        ((F.col("type") == "number") & (F.expr("try_cast(max AS int)") < rules.SMALL_NUMBER_MAX), None,
         F.lit("small_number")),
        (card_like("value"), "never_store", F.lit("luhn_valid_card_value")),
        (card_like("placeholder"), "never_store", F.lit("luhn_valid_card_placeholder")),
        (matches(F.col("all_text"), rules.CARDHOLDER_PATTERN, True), "cardholderName", F.lit("cardholder_name_pattern")),
        (matches(F.col("all_text"), rules.CARD_EXPIRY_PATTERN, True), "cardExpiry", F.lit("card_expiry_pattern")),
        (any_match(F.col("id_text"), rules.NEVER_STORE_FIELD_PATTERNS, True), "never_store", F.lit("identifier_pattern")),
    ]
    for token, key in rules.AUTOCOMPLETE_KEYS:
        steps.append((F.array_contains("auto_tokens", token), key, F.lit(f"autocomplete={token}")))
    for key, patterns in rules.KEYWORD_KEYS:
        steps.append((any_match(F.col("all_text"), patterns, True), key, F.lit(f"keyword:{key}")))

    step = reduce(lambda acc, i: acc.when(steps[i][0], i + 1), range(1, len(steps)), F.when(steps[0][0], 1))
    keys = F.array(*[F.lit(key).cast("string") for _, key, _ in steps])
    reasons = F.array(*[reason for _, _, reason in steps])
    decided = materialize(d, ["page_id", "field_idx"], step=step)
    return decided.select(
        "page_id", "field_idx", F.get(keys, F.col("step") - 1).alias("key"), F.get(reasons, F.col("step") - 1).alias("reason")
    ).withColumn("sensitive", F.coalesce(F.col("key").isin(rules.SENSITIVE_FIELD_KEYS), F.lit(False)))


def clean_label(raw: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(raw, r"[*_#`]+", ""), r"\s+", " "))


def resolve_label_expr(label: Column) -> Column:
    """Profile key for a label, as one expression over the fixed 43-key table.

    Alias first, then exact key or label, then containment for tokens of four or more
    characters; the first key in list order wins. Null when nothing fits or the label
    names something that must never be stored.
    """
    import re

    flat = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    exact: dict[str, str] = {}
    for k in rules.PROFILE_KEYS:
        for form in (flat(k), flat(rules.PROFILE_LABELS.get(k, k))):
            exact.setdefault(form, k)
    known = {**exact, **rules.LABEL_ALIASES}
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    table = F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(flat(k)).alias("a"), F.lit(flat(rules.PROFILE_LABELS.get(k, k))).alias("b"))
        for k in rules.PROFILE_KEYS
    ])

    def by_token(token: Column) -> Column:
        fits = F.filter(
            table,
            lambda r: F.contains(r["a"], token) | F.contains(token, r["a"]) | F.contains(r["b"], token)
            | F.contains(token, r["b"]),
        )
        fuzzy = F.when(F.length(token) >= 4, F.get(fits, F.lit(0))["key"])
        return F.when(token != "", F.coalesce(F.element_at(lookup, token), fuzzy))

    def by_label(cleaned: Column) -> Column:
        blocked = (
            (cleaned == "")
            | matches(cleaned, rules.SKIP_LABELS, True)
            | matches(cleaned, rules.PROFILE_NEVER_STORE_KEY, True)
        )
        return F.when(~blocked, let(squash(cleaned), by_token))

    return let(clean_label(label), by_label)


def photo_boxes(images: DataFrame) -> DataFrame:
    """Images big enough, in view, and not too wide or narrow to be a photo."""
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    ratio = F.col("w") / F.col("h")
    return images.filter((F.col("w") >= rules.PHOTO_MIN_SIDE) & (F.col("h") >= rules.PHOTO_MIN_SIDE)).filter(
        (bottom >= 0) & (F.col("y") <= F.col("viewport_h"))
        & (right >= 0) & (F.col("x") <= F.col("viewport_w"))
        & (ratio <= rules.PHOTO_MAX_RATIO) & (ratio >= rules.PHOTO_MIN_RATIO)
    )
