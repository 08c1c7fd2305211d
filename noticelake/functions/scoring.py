"""How predicted values are held against annotated ones, and small keys and parts of notices, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.values import UNITS, bound, contact_hash, parse_timestamp, precision_tolerance, validate_amount, validate_date, validate_identifier

#: What may stand before a date, units by which the tolerance is told, classes of annotation, organisations and regions, aliases.
DATE_PREFIX = (
    "^(开标时间|投标截止时间|投标文件递交截止时间|提交投标文件截止时间|截止时间|响应文件递交截止时间|响应文件提交截止时间"
    "|递交截止时间|询价截止时间|更正日期|发布日期|公告时间|发布时间|采购公告时间|原公告时间)[：:\\s]*"
)
DATE_FIELDS = ("publish_date", "bid_deadline")
GOLD_CLASSES = {
    "present": "should_have_value", "ambiguous": "should_have_value", "multi_value": "should_have_value",
    "absent": "should_not_have_value", "not_applicable": "should_not_have_value", "attachment_only": "attachment_only", "unreadable": "unreadable",
}
DECIMAL_UNITS = (("亿元", "100000000"), ("亿", "100000000"), ("万元", "10000"), ("万", "10000"), ("元", "1"))
ORG_KINDS = (
    ("医院", "医疗机构"), ("临床", "医疗机构"), ("卫生院", "医疗机构"), ("大学", "教育机构"), ("学校", "教育机构"), ("学院", "教育机构"),
    ("教育委员会", "政府机构"), ("教育局", "政府机构"), ("人民政府", "政府机构"), ("财政局", "政府机构"), ("厅", "政府机构"), ("局", "政府机构"),
    ("委员会", "政府机构"), ("中心", "事业单位"), ("院所", "事业单位"), ("研究院", "事业单位"), ("研究所", "事业单位"),
    ("公司", "企业"), ("集团", "企业"), ("厂", "企业"),
)
ROLE_KINDS = {"winner": "企业", "purchaser": "政府机构"}
REGIONS = (
    ("北京", "北京"), ("上海", "上海"), ("广东", "广东"), ("深圳", "广东"), ("广州", "广东"), ("浙江", "浙江"), ("杭州", "浙江"), ("江苏", "江苏"), ("南京", "江苏"),
    ("四川", "四川"), ("成都", "四川"), ("湖北", "湖北"), ("武汉", "湖北"), ("山东", "山东"), ("济南", "山东"), ("陕西", "陕西"), ("西安", "陕西"),
    ("福建", "福建"), ("福州", "福建"), ("厦门", "福建"), ("天津", "天津"), ("重庆", "重庆"), ("辽宁", "辽宁"), ("沈阳", "辽宁"), ("大连", "辽宁"),
    ("河南", "河南"), ("郑州", "河南"), ("湖南", "湖南"), ("长沙", "湖南"), ("安徽", "安徽"), ("合肥", "安徽"), ("河北", "河北"), ("石家庄", "河北"),
    ("江西", "江西"), ("南昌", "江西"), ("山西", "山西"), ("太原", "山西"), ("云南", "云南"), ("昆明", "云南"), ("广西", "广西"), ("南宁", "广西"),
    ("甘肃", "甘肃"), ("兰州", "甘肃"), ("贵州", "贵州"), ("贵阳", "贵州"), ("海南", "海南"), ("海口", "海南"), ("吉林", "吉林"), ("长春", "吉林"),
    ("黑龙江", "黑龙江"), ("哈尔滨", "黑龙江"), ("内蒙古", "内蒙古"), ("呼和浩特", "内蒙古"), ("宁夏", "宁夏"), ("银川", "宁夏"), ("新疆", "新疆"), ("乌鲁木齐", "新疆"),
    ("西藏", "西藏"), ("拉萨", "西藏"), ("青海", "青海"), ("西宁", "青海"),
)
ALIASES = {
    "win_company": ("winner_name", "win_company", "中标人", "中标企业"),
    "tender_org": ("purchaser_name", "tender_org", "采购人", "采购单位"),
    "win_amount": ("amount", "win_amount", "中标金额", "合同金额"),
    "budget_amount": ("amount", "budget_amount", "预算金额"),
    "publish_time": ("publish_date", "publish_time", "发布日期"),
    "win_date": ("publish_date", "win_date", "中标日期", "成交日期"),
    "project_name": ("project_name", "title", "项目名称"),
    "location": ("location", "region", "地区"),
    "source_url": ("source_url", "notice_url", "url"),
    "source_platform": ("source_platform", "platform"),
}
DEADLINE_PATTERNS = (
    "投标截止时间[：:]\\s*(?:20\\d{2}[\\-/年]\\d{1,2}[\\-/月]\\d{1,2}[^。\\n]*点[^。\\n]*分[^。\\n]*)",
    "截止时间[：:]\\s*(?:20\\d{2}[\\-/年]\\d{1,2}[\\-/月]\\d{1,2}[^。\\n]*点[^。\\n]*分[^。\\n]*)",
    "开标时间[：:]\\s*(?:20\\d{2}[\\-/年]\\d{1,2}[\\-/月]\\d{1,2}[^。\\n]*点[^。\\n]*分[^。\\n]*)",
    "递交.*截止[：:]\\s*(?:20\\d{2}[\\-/年]\\d{1,2}[\\-/月]\\d{1,2}[^。\\n]*)",
    "(?:20\\d{2}年\\d{1,2}月\\d{1,2}日\\s*\\d{1,2}[:：]\\d{2}[^。\\n]*)(?:开标|截止)",
)
DEADLINE_TIME = "20\\d{2}年\\d{1,2}月\\d{1,2}日\\s*\\d{1,2}[:：]\\d{2}"
#: Fields in the text of attachments, by a pattern each (fixed values).
ATTACHMENT_PATTERNS = {
    "project_name": "(?:项目名称|项目名|工程名称|采购项目名)\\s*[:：]\\s*([^\\n\\r，。；]{2,100})",
    "bid_number": "(?:招标编号|项目编号|采购编号|标段编号)\\s*[:：]\\s*([A-Z0-9\\-/]{6,40})",
    "budget_amount": "(?:预算金额|项目预算|采购预算|控制价)\\s*[:：]\\s*(\\d+(?:\\.\\d+)?\\s*(?:万元|亿元|元|万|亿))",
    "deadline": "(?:投标截止时间|报名截止时间|截止时间|投标截止日期)\\s*[:：]\\s*(\\d{4}年\\d{1,2}月\\d{1,2}日(?:\\s*\\d{1,2}:\\d{1,2})?)",
    "tender_org": "(?:招标人|采购人|招标单位|采购单位)\\s*[:：]\\s*([^\\n\\r，。；]{2,50})",
    "agency": "(?:代理机构|招标代理|采购代理)\\s*[:：]\\s*([^\\n\\r，。；]{2,50})",
    "contact_name": "(?:联系人|项目联系人)\\s*[:：]\\s*([^\\n\\r，。；]{2,30})",
    "contact_phone": "(?:联系电话|电话|联系方式)\\s*[:：]\\s*(\\d{3,4}-?\\d{7,8})",
}
#: Longest texts of a notice's fields.
LONGEST = {"project_name": 500, "bid_number": 100, "location": 200, "tender_org": 300, "agency": 300, "contact_name": 100, "notice_type": 50, "source_url": 500}


def _none(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def scored_date(raw: Column) -> Column:
    """A date as ``YYYY-MM-DD[ HH:MM]`` for scoring: without what stands before it, and without a time of midnight; null if it is none."""
    text = F.regexp_replace(F.trim(raw), DATE_PREFIX, "")
    iso = lambda i: F.regexp_extract(text, "(\\d{4}-\\d{2}-\\d{2})[ T](\\d{1,2}):(\\d{2})", i)
    fallback = F.when(iso(1) != "", F.concat(iso(1), F.lit(" "), F.lpad(iso(2), 2, "0"), F.lit(":"), iso(3)))
    told = F.coalesce(validate_date(text)["normalized"], fallback)
    return F.when(F.substring(told, 12, 5) == "00:00", F.substring(told, 1, 10)).otherwise(told)


def date_equal(predicted: Column, gold: Column) -> Column:
    """Whether two dates are of one day and, if both have a time, of one minute."""
    p, g = scored_date(predicted), scored_date(gold)
    timed = (F.length(p) > 10) & (F.length(g) > 10)
    return F.coalesce((F.substring(p, 1, 10) == F.substring(g, 1, 10)) & (~timed | (p == g)), F.lit(False))


def _unit(raw: Column) -> Column:
    """The unit that an amount is written in, the longest name first."""
    names = sorted(UNITS, key=len, reverse=True) + ["亿", "万"]
    return _none(F.regexp_extract(raw, "|".join(names), 0))


def amount_equal(predicted: Column, gold: Column) -> Column:
    """Whether two amounts differ by no more than the wider tolerance of their units; else whether their first numbers are the same text."""
    number = lambda c: _none(F.regexp_extract(c, "\\d+\\.?\\d*", 0))
    tolerance = F.greatest(*(F.coalesce(precision_tolerance(F.lit(None).cast("string"), _unit(c)), F.lit(0.0)) for c in (gold, predicted)))

    def told(x: Column) -> Column:
        near = F.abs(x["p"]["value"] - x["g"]["value"]) <= x["tolerance"]
        return F.coalesce(F.when(x["p"]["valid"] & x["g"]["valid"], near).otherwise(x["same"]), F.lit(False))

    same = (number(predicted) == number(gold)).alias("same")
    return bound(F.struct(validate_amount(predicted).alias("p"), validate_amount(gold).alias("g"), tolerance.alias("tolerance"), same), told)


def value_correct(field: Column, predicted: Column, gold_values: Column) -> Column:
    """Whether a value agrees with any of the annotated ones: amounts and dates by their rules, other values if one contains the other."""
    value = F.trim(predicted)

    def agrees(raw: Column) -> Column:
        gold = F.trim(F.coalesce(raw, F.lit("")))
        other = F.contains(value, gold) | F.contains(gold, value)
        rule = F.when(field == "amount", amount_equal(value, gold)).when(field.isin(*DATE_FIELDS), date_equal(value, gold)).otherwise(other)
        return (gold != "") & rule

    return F.coalesce((F.coalesce(predicted, F.lit("")) != "") & F.exists(gold_values, agrees), F.lit(False))


def gold_class(status: Column) -> Column:
    """What an annotation's status asks of a prediction; unknown ones ask for a value."""
    return F.coalesce(*(F.when(status == k, F.lit(v)) for k, v in GOLD_CLASSES.items()), F.lit("should_have_value"))


def calibration_grade(status: Column, has_value: Column, verified: Column, validated: Column) -> Column:
    """Display grade of a row of group D, for calibration."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    low = F.coalesce(status == "absent", F.lit(False)) | ~yes(has_value) | ~yes(verified)
    return F.when(low, "low").when(yes(validated), "high").otherwise("review")


def decimal_amount(raw: Column) -> Column:
    """An amount as a decimal in yuan by the first unit of the list that it contains; null if the rest is no number."""
    text = F.trim(F.replace(raw, F.lit(","), F.lit("")))
    told = text.try_cast("decimal(30,6)")
    for unit, factor in reversed(DECIMAL_UNITS):
        number = F.trim(F.replace(text, F.lit(unit), F.lit(""))).try_cast("decimal(24,6)")
        told = F.when(F.contains(text, F.lit(unit)), (number * F.lit(factor).cast("decimal(9,0)")).cast("decimal(30,6)")).otherwise(told)
    return told


def _first_rule(name: Column, rules: tuple, default: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(name, F.lit(k)), F.lit(v)) for k, v in rules), default)


def org_meta(name: Column, role: Column) -> Column:
    """struct(kind, region) of an organisation by the first words of the lists that its name contains; by its role if none does."""
    empty = F.coalesce(name, F.lit("")) == ""
    by_role = F.coalesce(*(F.when(role == k, F.lit(v)) for k, v in ROLE_KINDS.items()), F.lit("其他"))
    kind = F.when(empty, "未知").otherwise(_first_rule(name, ORG_KINDS, by_role))
    return F.struct(kind.alias("kind"), F.when(empty, "未知").otherwise(_first_rule(name, REGIONS, F.lit("未知"))).alias("region"))


def signature(template: Column, hits: Column, text_hash: Column) -> Column:
    """Sixteen hex digits that stand for a page's structure: template, hits by selector in order, hash of its key text."""
    shown = F.transform(F.array_sort(F.map_entries(hits)), lambda e: F.concat(F.lit("('"), e["key"], F.lit("', "), e["value"].cast("string"), F.lit(")")))
    return F.substring(F.sha2(F.concat_ws("|", template, F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")), text_hash), 256), 1, 16)


def file_name(name: Column) -> Column:
    """A safe file name: no path, no characters that some systems forbid, a hundred characters at most."""
    clean = F.replace(F.trim(F.regexp_replace(name, '[\\\\/:*?"<>|]', "_")), F.lit(".."), F.lit(""))
    return F.substring(F.regexp_extract(clean, "[^/]*$", 0), 1, 100)


def url_file_name(url: Column) -> Column:
    """The safe name of the last part of an address's path."""
    path = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    return file_name(F.coalesce(_none(F.regexp_extract(path, "[^/]*$", 0)), F.lit("attachment")))


def push_hash(ids: Column) -> Column:
    """SHA-256 of the sorted ids of a push, written as a list."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(ids), lambda i: i.cast("string")), ", "), F.lit("]")), 256)


def cache_key(query: Column) -> Column:
    """SHA-256 of a query in lower case without white space."""
    return F.sha2(F.regexp_replace(F.lower(query), "\\s+", ""), 256)


def deadline(content: Column) -> Column:
    """struct(text, start, end) of a bid's deadline by ordered patterns, narrowed to the date and time where it has them."""
    matched = F.coalesce(*(_none(F.regexp_extract(content, p, 0)) for p in DEADLINE_PATTERNS))
    text = F.coalesce(_none(F.regexp_extract(matched, DEADLINE_TIME, 0)), matched)
    start = F.position(text, content) - 1
    return F.when(text.isNotNull(), F.struct(text.alias("text"), start.alias("start"), (start + F.length(text)).alias("end")))


def find_span(body: Column, quote: Column) -> Column:
    """struct(start, end) of a quote's first occurrence, of the trimmed quote if it has none; null without."""

    def at(q: Column) -> Column:
        start = F.position(q, body)
        return F.when((q != "") & (start > 0), F.struct((start - 1).alias("start"), (start - 1 + F.length(q)).alias("end")))

    return F.coalesce(at(quote), at(F.regexp_replace(quote, "^\\s+|\\s+$", "")))


def first_code(text: Column, patterns: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first code one of whose patterns a text contains, in any case."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(p.lower())), F.lit(code)) for code, listed in patterns for p in listed))


def date_prefix(iso: Column, chars: int = 10) -> Column:
    """The day, or the month, of an ISO timestamp; what is shorter stays."""
    return F.when(F.length(iso) >= chars, F.substring(iso, 1, chars)).otherwise(iso)


def by_alias(own: dict[str, Column], fields: Column, name: str) -> Column:
    """A field by its aliases: the first filled column of that name, else the first of ``fields`` (field_name, raw_value, value)."""
    listed = ALIASES.get(name, (name,))
    found = F.get(F.filter(fields, lambda f: f["field_name"].isin(*listed)), F.lit(0))
    return F.coalesce(*(_none(own[a].cast("string")) for a in listed if a in own), _none(found["raw_value"]), found["value"])


def notice_row(picked: dict[str, Column]) -> list[Column]:
    """The columns of a notice from an item's picked values: cut to their longest, amounts and times parsed, contacts hashed, unnamed ones named."""
    none = F.lit(None).cast("string")
    text = lambda k: _none(F.substring(picked.get(k, none), 1, LONGEST[k]))
    return [
        F.coalesce(text("project_name"), F.lit("未命名")).alias("project_name"),
        *(text(k).alias(k) for k in LONGEST if k != "project_name"),
        decimal_amount(picked.get("budget_amount", none)).alias("budget_amount"),
        *(parse_timestamp(picked.get(k, none)).alias(k) for k in ("publish_time", "deadline")),
        *(contact_hash(picked.get(k, none)).alias(k) for k in ("contact_phone", "contact_email")),
        F.coalesce(picked.get("core_content", none), F.lit("")).alias("core_content"),
    ]


def evidence_refusal(support: Column, role: Column, has_evidence: Column, levels: tuple[str, ...], roles: tuple[str, ...]) -> Column:
    """Why a field's evidence may not be written; null if it may."""
    return (
        F.when(~support.isin(*levels) | support.isNull(), "support_level")
        .when(~has_evidence & support.isin("direct", "equivalent"), "no_evidence")
        .when(has_evidence & (~role.isin(*roles) | role.isNull()), "evidence_role")
    )


def attachment_fields(text: Column) -> Column:
    """struct of the fields that an attachment's text states, null where it does not; the budget in yuan, the deadline as a time."""
    raw = {k: F.trim(_none(F.regexp_extract(text, p, 1))) for k, p in ATTACHMENT_PATTERNS.items()}
    told = {**raw, "budget_amount": decimal_amount(raw["budget_amount"]).cast("double"), "deadline": parse_timestamp(raw["deadline"])}
    return F.struct(*(c.alias(k) for k, c in told.items()))


def validate_field(kind: Column, raw: Column) -> Column:
    """struct(valid, normalized) by the validator of a field's kind; of an unknown kind nothing is valid."""
    of = lambda x: F.struct(F.coalesce(x["valid"], F.lit(False)).alias("valid"), x["normalized"].alias("normalized"))
    none = F.struct(F.lit(False).alias("valid"), F.lit(None).cast("string").alias("normalized"))
    return F.when(kind == "amount", of(validate_amount(raw))).when(kind == "date", of(validate_date(raw))).when(kind == "project_identifier", of(validate_identifier(raw))).otherwise(none)
