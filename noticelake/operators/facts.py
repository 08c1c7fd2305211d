"""Facts stated in a text (amounts, dates, shares, counts, telephones, addresses, numbers) and their check against a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories and patterns in the order in which facts are listed (fixed values), digits in ASCII.
PATTERNS = {
    "金额": "\\d+(?:\\.\\d+)?\\s*(?:亿元|亿|万元|万|元)",
    "日期": "\\d{4}年\\d{1,2}月\\d{1,2}日|\\d{4}-\\d{1,2}-\\d{1,2}|\\d{4}/\\d{1,2}/\\d{1,2}",
    "百分比": "\\d+(?:\\.\\d+)?\\s*%",
    "数量": "\\d+\\s*(?:台|套|个|批|项|份|辆)",
    "联系电话": "\\d{3,4}-?\\d{7,8}",
    "邮箱": "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+",
    "招标编号": "(?:SH|ZB|GG|BJ|GD|JS|ZJ|FZ|XM|CG|GS|GZ)-[A-Z0-9-]{4,28}|[A-Z]{2,}\\d{4,}[A-Z0-9]*(?:-[A-Z0-9]+)?",
}
#: Categories that must be found in the source.
STRICT = ("金额", "日期", "联系电话", "邮箱", "招标编号")


def facts(text: Column) -> Column:
    """Array of distinct (category, value), by category."""
    of = lambda k, p: F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))), lambda v: F.struct(F.lit(k).alias("category"), F.trim(v).alias("value")))
    return F.array_distinct(F.concat(*(of(k, p) for k, p in PATTERNS.items())))


def canonical_amount(value: Column) -> Column:
    number = F.regexp_extract(value, "(\\d+(?:\\.\\d+)?)\\s*(亿元|亿|万元|万|元)", 1).try_cast("double")
    unit = F.regexp_extract(value, "(\\d+(?:\\.\\d+)?)\\s*(亿元|亿|万元|万|元)", 2)
    return number * F.when(F.contains(unit, F.lit("亿")), 1e8).when(F.contains(unit, F.lit("万")), 1e4).otherwise(1.0)


def canonical_date(value: Column) -> Column:
    pattern = "(\\d{4})[年\\-/.](\\d{1,2})[月\\-/.](\\d{1,2})"
    part = lambda i: F.regexp_extract(value, pattern, i)
    return F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "y-M-d")


def check(rows: DataFrame, id_col: str, content: str, source: str, strict: bool = False) -> DataFrame:
    """Per row: facts, verified and hallucinated counts and ``passed``; without content or source it passes."""
    c, s = F.coalesce(content, F.lit("")), F.coalesce(source, F.lit(""))
    listed = rows.select(id_col, s.alias("s"), F.when((c != "") & (s != ""), facts(c)).otherwise(F.array().cast("array<struct<category:string,value:string>>")).alias("f"))
    bare = lambda x: F.regexp_replace(x, "\\s+", "")
    # What the source says is read once a document, and only for documents that state anything.
    said = lambda k, canon: F.when(F.size("f") > 0, F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(PATTERNS[k]), F.lit(0)), canon)))
    given = listed.select(id_col, "f", F.when(F.size("f") > 0, bare(F.col("s"))).alias("bare"), said("金额", canonical_amount).alias("amounts"), said("日期", canonical_date).alias("dates"))
    one = given.select(id_col, "bare", "amounts", "dates", F.explode_outer("f").alias("one"))
    equal = lambda listed, canon: F.array_contains(listed, canon(F.col("one.value")))
    kind = F.col("one.category")
    found = F.contains("bare", bare(F.col("one.value"))) | ((kind == "金额") & equal("amounts", canonical_amount)) | ((kind == "日期") & equal("dates", canonical_date))
    wrong = kind.isNotNull() & ~F.coalesce(found, F.lit(False)) & (F.lit(strict) | kind.isin(*STRICT))
    sums = one.groupBy(id_col).agg(F.count("one").alias("n_facts"), F.count_if(wrong).alias("n_wrong"))
    return sums.select(id_col, "n_facts", (F.col("n_facts") - F.col("n_wrong")).alias("n_verified"), "n_wrong", (F.col("n_wrong") == 0).alias("passed"))
