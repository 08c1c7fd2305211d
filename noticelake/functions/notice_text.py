"""Fields of a notice's text by ordered patterns (fixed values), each with a window of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.values import validate_amount

FIELDS = {
    "tender_org": ("采购单位[：:\\s]*([^\\s，,；;]{2,40}?)(?=行政区域|\\s|，|,|；|;|$)", "采购人[：:\\s]*([^\\s，,；;]{2,40})"),
    "location": ("行政区域[：:\\s]*([^\\s，,；;]{2,20}?)(?=公告时间|\\s|，|,|$)",),
    "publish_time": ("公告时间[：:\\s]*(\\d{4}年\\d{1,2}月\\d{1,2}日(?:\\s*\\d{1,2}:\\d{2})?)", "发布时间[：:\\s]*(\\d{4}-\\d{1,2}-\\d{1,2})"),
    "budget_amount": ("预算金额[：:\\s]*([￥¥]?\\s*[0-9,.]+\\s*(?:亿元|万元|元))", "预算[：:\\s]*([0-9,.]+\\s*(?:亿元|万元|元))"),
    "win_amount": ("总中标金额[：:\\s]*([￥¥]?\\s*[0-9,.]+\\s*(?:亿元|万元|元))", "中标金额[：:\\s]*([￥¥]?\\s*[0-9,.]+\\s*(?:亿元|万元|元))"),
    "bid_number": ("项目编号[：:\\s]*([A-Za-z0-9_-]{4,40})", "招标编号[：:\\s]*([A-Za-z0-9_-]{4,40})"),
}
DEADLINES = (
    "投标截止时间[：:\\s]*(\\d{4}年\\d{1,2}月\\d{1,2}日\\s*\\d{1,2}[:：时点]\\d{1,2})",
    "提交投标文件截止时间[：:\\s]*(\\d{4}年\\d{1,2}月\\d{1,2}日\\s*\\d{1,2}[:：时点]\\d{1,2})",
    "开标时间[：:\\s]*(\\d{4}年\\d{1,2}月\\d{1,2}日\\s*\\d{1,2}[:：时点]\\d{1,2})",
    "截止时间[：:\\s]*(\\d{4}-\\d{1,2}-\\d{1,2}\\s+\\d{1,2}:\\d{2})",
    "截止[：:\\s]*(\\d{4}年\\d{1,2}月\\d{1,2}日)",
)
KINDS = (("award", "中标|成交"), ("correction", "更正|变更"), ("tender", "招标|采购公告|磋商|谈判"), ("cancellation", "废标|终止"))
BEFORE, AFTER, HEAD = 10, 5, 200


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def notice_type(title: Column, text: Column) -> Column:
    """By the title, else by the first characters of the text; awards before corrections before tenders."""
    head = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, HEAD))
    return F.coalesce(*(F.when(F.coalesce(title, F.lit("")).rlike(p), F.lit(k)) for k, p in KINDS), *(F.when(head.rlike(p), F.lit(k)) for k, p in KINDS))


def field(text: Column, name: str) -> Column:
    """struct(value, evidence): the value and the text around its first occurrence."""
    value = first_match(text, FIELDS[name])
    at = F.position(value, text)
    start = F.greatest(F.lit(1), at - BEFORE)
    return F.struct(F.trim(value).alias("value"), F.when(at > 0, F.substring(text, start, at - start + F.length(value) + AFTER)).alias("evidence"))


def fields(text: Column, title: Column) -> Column:
    """struct of all fields, the amounts in yuan, and the notice type."""
    amounts = ("budget_amount", "win_amount")
    plain = [field(text, n).alias(n) for n in FIELDS if n not in amounts]
    paid = [validate_amount(F.regexp_replace(field(text, n)["value"], "\\s+", ""))["value"].alias(n) for n in amounts]
    return F.struct(*plain, *paid, notice_type(title, text).alias("notice_type"), first_match(text, DEADLINES).alias("deadline"))


def fill_empty(own: Column, parsed: Column) -> Column:
    """The own value unless it is null, empty or zero."""
    empty = own.isNull() | (own.cast("string") == "") | F.coalesce(own.try_cast("double") == 0, F.lit(False))
    return F.when(~empty, own).otherwise(parsed)
