"""Validation and parsing of amounts, dates, identifiers and organisations as Columns.

Every validator gives a struct with ``valid``; nothing raises on bad input. Digits
and blanks are ASCII unless a pattern names others. Words are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.text import halfwidth

AMOUNT_PREFIX = "^(?:中标|成交|预算|控制价|合同|采购|项目)?(?:（[^）]*）)?(?:金额|总价|价格|价)?[：:\\s]*(?:人民币|美元|欧元)?\\s*"
AMOUNT = (
    "^(￥|¥|人民币|美元|USD|\\$|欧元|EUR|€)?\\s*(\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)\\s*"
    "(亿元|万元|万元人民币|元|元人民币|万|亿|)?\\s*$"
)
CURRENCIES = {"人民币": "CNY", "￥": "CNY", "¥": "CNY", "美元": "USD", "USD": "USD", "$": "USD", "欧元": "EUR", "EUR": "EUR", "€": "EUR"}
DATES = (
    "^(\\d{4})年(\\d{1,2})月(\\d{1,2})日(?:\\s*(?:(\\d{1,2})\\s*[时点]\\s*(\\d{1,2})\\s*分(?:\\s*\\d{1,2}\\s*秒)?|(\\d{1,2}):(\\d{1,2})))?\\s*$",
    "^(\\d{4})-(\\d{1,2})-(\\d{1,2})(?:\\s+(\\d{1,2}):(\\d{1,2}))?()()\\s*$",
    "^(\\d{4})\\.(\\d{1,2})\\.(\\d{1,2})(?:\\s+(\\d{1,2}):(\\d{1,2}))?()()\\s*$",
)
IDENTIFIER = "^[A-Za-z0-9][A-Za-z0-9_-]{3,}$"
BRACKETED_IDENTIFIER = "(?:招标|项目|采购|合同)?编号\\s*[：:]\\s*([A-Za-z0-9_-]+)"
UNITS = {"万元人民币": 10_000.0, "元人民币": 1.0, "万元": 10_000.0, "亿元": 100_000_000.0, "万美元": None, "美元": None, "欧元": None, "日元": None, "元": 1.0}
ORG_TYPES = (
    ("government", "局|委|办|厅|部|政府|街道办事处"),
    ("institution", "院|校|所|中心|站|馆|医院|学校|大学"),
    ("enterprise", "公司|集团|厂|店|商行"),
    ("social_org", "协会|基金会|商会|联合会"),
)
CATEGORIES = (
    ("医疗", "医疗|医院|器械|药品"),
    ("教育", "教育|学校|教学|图书"),
    ("IT", "电脑|服务器|网络|软件|系统|it|信息化"),
    ("工程", "工程|施工|建设|装修|改造"),
)
NOTICE_KINDS = ("tender", "award", "correction", "cancellation", "cancel")


def bound(value: Column, make) -> Column:
    """``make`` of a value that is computed once, however often the result names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _scale(unit: Column) -> Column:
    return F.when(F.contains(unit, F.lit("亿")), 1e8).when(F.contains(unit, F.lit("万")), 1e4).otherwise(1.0)


def validate_amount(raw: Column, expected: str = "CNY") -> Column:
    """struct(valid, value in yuan, normalized, currency, zero)."""
    text = F.trim(F.regexp_replace(F.trim(raw), AMOUNT_PREFIX, ""))
    text = F.regexp_replace(text, "\\s*（\\s*(万元|亿元|元|万|亿)\\s*）\\s*$", "$1")
    text = F.trim(F.regexp_replace(text, "（[^）]*）$", ""))
    part = lambda t, i: F.regexp_extract(t, AMOUNT, i)

    def parsed(t: Column) -> Column:
        number = F.replace(part(t, 2), F.lit(","), F.lit("")).try_cast("double")
        return F.struct(number.alias("number"), (number * _scale(part(t, 3))).alias("value"), part(t, 1).alias("sign"))

    def told(p: Column) -> Column:
        value, currency = p["value"], F.coalesce(*(F.when(p["sign"] == k, F.lit(v)) for k, v in CURRENCIES.items()), F.lit(expected))
        valid = p["number"].isNotNull()
        shown = (
            F.when(value >= 1e8, F.format_string("%.2f亿元", value / 1e8))
            .when(value >= 1e4, F.format_string("%.2f万元", value / 1e4))
            .when(valid, F.format_string("%.2f元", value))
        )
        return F.struct(valid.alias("valid"), value.alias("value"), shown.alias("normalized"), F.when(valid, currency).alias("currency"), (p["number"] == 0).alias("zero"))

    return bound(bound(F.coalesce(text, F.lit("")), parsed), told)


def lots_verdict(total: Column, lots: Column) -> Column:
    """struct(valid, lot_sum, differs): whether all lots are amounts, and whether they add up to the total."""
    parsed = F.transform(lots, validate_amount)
    lot_sum = F.aggregate(parsed, F.lit(0.0), lambda s, a: s + F.coalesce(a["value"], F.lit(0.0)))
    valid, value = F.forall(parsed, lambda a: a["valid"]), validate_amount(total)["value"]
    return F.struct(valid.alias("valid"), lot_sum.alias("lot_sum"), (F.abs(value - lot_sum) > magnitude_tolerance(value)).alias("differs"))


def magnitude_tolerance(amount: Column) -> Column:
    """Tolerance by size, kept for lot sums only."""
    return F.when(amount >= 10_000, 50.0).when(amount >= 100, 0.5).otherwise(0.005)


def precision_tolerance(precision: Column, unit: Column) -> Column:
    """Half the least unit shown; without it a careful guess from the unit; null where it cannot be told."""
    text = F.translate(F.trim(precision), "０１２３４５６７８９．", "0123456789.")
    number = F.regexp_extract(text, "^(\\d+\\.?\\d*)\\s*(.+)$", 1).try_cast("double")
    name = F.trim(F.regexp_extract(text, "^(\\d+\\.?\\d*)\\s*(.+)$", 2))
    factor, known = F.lit(None).cast("double"), sorted(UNITS.items(), key=lambda kv: len(kv[0]))
    for key, value in known:  # the longest name that the unit contains decides
        factor = F.when(F.contains(name, F.lit(key)), F.lit(value).cast("double")).otherwise(factor)
    has = lambda w: F.contains(unit, F.lit(w))
    guess = (
        F.when(has("万"), 50.0).when(has("亿"), 500_000.0).when(has("美元") | has("欧元") | has("日元"), F.lit(None).cast("double")).when(has("元"), 0.005)
    )
    return F.coalesce(number * factor / 2, guess)


def validate_date(raw: Column) -> Column:
    """struct(valid, normalized): notes in brackets are dropped, 29 February is always a day, times are not checked."""
    text = F.trim(raw)
    for _ in range(3):  # nested notes
        text = F.trim(F.regexp_replace(text, "[（(][^（）()]*[）)]", ""))

    def parsed(t: Column) -> Column:
        part = lambda i: F.coalesce(*(F.nullif(F.regexp_extract(t, p, i), F.lit("")) for p in DATES)).try_cast("int")
        hour, minute = F.coalesce(part(4), part(6)), F.coalesce(part(5), part(7))
        return F.struct(part(1).alias("year"), part(2).alias("month"), part(3).alias("day"), hour.alias("hour"), minute.alias("minute"))

    def told(p: Column) -> Column:
        year, month, day, hour, minute = (p[n] for n in ("year", "month", "day", "hour", "minute"))
        longest = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        valid = F.coalesce(month.between(1, 12) & (day >= 1) & (day <= longest) & year.isNotNull(), F.lit(False))
        date = F.format_string("%04d-%02d-%02d", year, month, day)
        shown = F.when(hour.isNotNull() & minute.isNotNull(), F.concat(date, F.format_string(" %02d:%02d", hour, minute))).otherwise(date)
        return F.struct(valid.alias("valid"), F.when(valid, shown).alias("normalized"))

    return bound(bound(F.coalesce(text, F.lit("")), parsed), told)


def validate_identifier(raw: Column) -> Column:
    """struct(valid, normalized): the first of several, without notes in brackets, or one that a note names."""
    text = halfwidth(F.trim(raw))
    text = F.trim(F.split(F.trim(F.split(text, "、", 2)[0]), "[；;]", 2)[0])
    notes = F.regexp_extract_all(text, F.lit("\\([^)]*\\)"), F.lit(0))
    main = F.replace(F.trim(F.regexp_replace(text, "\\([^)]*\\)", "")), F.lit(" "), F.lit(""))
    named = F.filter(F.transform(notes, lambda n: F.regexp_extract(n, BRACKETED_IDENTIFIER, 1)), lambda n: n.rlike(IDENTIFIER))
    chosen = F.when(main.rlike(IDENTIFIER), main).otherwise(F.try_element_at(named, F.lit(1)))
    return F.struct(chosen.isNotNull().alias("valid"), F.upper(chosen).alias("normalized"))


def first_number(column: Column) -> Column:
    """First number of a text, its unit ignored."""
    return F.regexp_extract(F.replace(column, F.lit(","), F.lit("")), "[-+]?\\d+(?:\\.\\d+)?(?:[eE][-+]?\\d+)?", 0).try_cast("double")


def parse_timestamp(column: Column) -> Column:
    """The first of seven formats that fits."""
    shapes = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d", "yyyy年M月d日", "yyyy.M.d")
    return F.coalesce(*(F.try_to_timestamp(F.trim(column), F.lit(s)) for s in shapes))


def amount_shown(value: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit("-"))
        .when(value >= 1e8, F.format_string("%.2f亿元", value / 1e8))
        .when(value >= 1e4, F.format_string("%.2f万元", value / 1e4))
        .otherwise(F.format_string("%.2f元", value))
    )


def org_name(column: Column) -> Column:
    """Name without brackets and blanks, its middle dots alike; null is empty."""
    name = F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), "[（(].*?[)）]", "")
    return F.regexp_replace(F.regexp_replace(name, "[\\s\\u3000]+", ""), "[·•・]", "·")


def _first_class(column: Column, classes: tuple, default: str) -> Column:
    chosen = F.lit(default)
    for label, words in reversed(classes):
        chosen = F.when(column.rlike(words), F.lit(label)).otherwise(chosen)
    return chosen


def org_type(column: Column) -> Column:
    return _first_class(F.coalesce(column, F.lit("")), ORG_TYPES, "unknown")


def category(column: Column) -> Column:
    return _first_class(F.lower(F.coalesce(column, F.lit(""))), CATEGORIES, "其他")


def notice_kind(column: Column) -> Column:
    """Null counts as a tender, "cancel" as cancellation, anything unknown as other."""
    known = F.when(column == "cancel", F.lit("cancellation")).when(column.isin(*NOTICE_KINDS), column).otherwise(F.lit("other"))
    return F.when(column.isNull(), F.lit("tender")).otherwise(known)


def platform_type(column: Column) -> Column:
    head = F.split(F.lower(F.coalesce(column, F.lit(""))), ":")[0]
    return F.when(head.rlike("gov|ccgp|ggzy"), "official").when(head.rlike("bid|zhaobiao"), "commercial").otherwise("unknown")


def relevance(text: Column, topic: str, words: list[str]) -> Column:
    """1 for the whole topic, else the share of its words that the text contains; 0.5 without a topic."""
    if not topic:
        return F.lit(0.5)
    text = F.lower(text)
    if not words:
        return F.when(F.contains(text, F.lit(topic.lower())), 1.0).otherwise(0.5)
    hits = sum(F.contains(text, F.lit(w)).cast("int") for w in words)
    return F.when(F.contains(text, F.lit(topic.lower())), 1.0).otherwise(hits / len(words))


def time_range_days(text: str | None) -> int | None:
    """Days that a spoken range means; on the driver, since it is part of a query."""
    import re

    if not isinstance(text, str) or not text.strip():
        return None
    for pattern, factor in ((r"(\d+)\s*(?:d|天|日)", 1), (r"(\d+)\s*(?:m|个月|月)", 30), (r"(\d+)\s*(?:y|年)", 365), (r"(\d+)", 1)):
        if m := re.search(pattern, text, re.IGNORECASE):
            return int(m[1]) * factor
    return None


def contact_hash(column: Column) -> Column:
    """SHA-256 of a trimmed contact; empty gives null."""
    return F.when(F.trim(column) != "", F.sha2(F.trim(column), 256))


def content_hash(column: Column) -> Column:
    return F.sha2(F.coalesce(column, F.lit("")), 256)


def material_hash(column: Column, side: int = 500) -> Column:
    """SHA-256 of both ends of a text; they overlap in short texts."""
    tail = F.substring(column, F.greatest(F.lit(1), F.length(column) - side + 1), F.lit(side))
    return F.sha2(F.concat(F.substring(column, 1, side), tail), 256)


def lenient_json(column: Column, schema: str) -> Column:
    """from_json of the text, of it without fences, of its outer braces, and with trailing commas mended."""
    bare = F.trim(F.regexp_replace(column, "(?s)^\\s*```(?:json)?|```\\s*$", ""))
    braces = F.regexp_extract(column, "(?s)\\{.*\\}", 0)
    mended = F.regexp_replace(braces, ",\\s*([}\\]])", "$1")
    strict = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
    found = [F.from_json(c, schema, strict) for c in (column, bare, braces, mended)]
    full = lambda s: F.when(F.length(F.to_json(s)) > 2, s)  # noqa: E731  a struct of nulls is a failure
    return F.coalesce(*map(full, found))
