"""Roles of sources, reposts, conflicts between stated values, and display grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import bigrams, jaccard

#: Parts of host names and marks of reposts (fixed values).
OFFICIAL = ("ccgp", "gov", "gpo", "ggzy", "jczx")
COMMERCIAL = ("bidcenter", "chinabidding", "bidnews", "procurement", "zhaobiao")
REPOST_MARKS = "转载|来源：|文章来源|信息来源|转自"
UPSTREAM_MARKS = "转自|来源：|文章来源：|信息来源：|原文链接"
DISPLAY_RULE_VERSION = "v1.0-frozen"
STRONG, WEAK, UNREADABLE = ("direct", "equivalent"), ("unsupported", "contradicted"), ("absent", "ambiguous", "unreadable")


def _any(name: Column, parts: tuple[str, ...]) -> Column:
    return name.rlike("|".join(parts))


def source_role(host: Column, content: Column, first: Column | None = None, index: Column | None = None, authorized: Column | None = None) -> Column:
    """Role of a page: marked first publication or index, unknown host, empty page, official, commercial, marked repost, unknown."""
    no = F.lit(False)
    first, index, authorized = (x if x is not None else no for x in (first, index, authorized))
    text, name = F.coalesce(content, F.lit("")), F.coalesce(host, F.lit(""))
    marked, official, commercial = text.rlike(REPOST_MARKS), _any(name, OFFICIAL), _any(name, COMMERCIAL)
    return (
        F.when(first, "official_original")
        .when(index, "index_only")
        .when(name == "", "unknown")
        .when((F.length(F.trim(text)) < 10) & ~authorized & ~official, "index_only")
        .when(official & marked, "official_repost")
        .when(official, "official_original")
        .when(commercial & authorized, "authorized_original")
        .when(commercial | marked, "commercial_repost")
        .otherwise("unknown")
    )


def source_group(url: Column, simhash: Column) -> Column:
    """Group id of one page; it includes the address, so it is no cluster id (see repost_clusters)."""
    return F.substring(F.sha2(F.concat_ws("|", url, simhash.cast("string")), 256), 1, 16)


def fact_key(project: Column, field: Column, value: Column) -> Column:
    """Key of an asserted value: equal keys mean equal values."""
    return F.substring(F.sha2(F.concat_ws("|", project, field, value), 256), 1, 16)


def comparable(a: str, b: str, keys: tuple[str, ...] = ("project_id", "field_name", "amount_type", "lot_id", "entity_role")) -> Column:
    """First reason why two assertions cannot be compared, null if they can; nulls equal each other."""
    reasons = ("different_project", "different_field", "different_amount_type", "different_lot", "different_entity_role")
    return F.coalesce(*(F.when(~F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), F.lit(r)) for k, r in zip(keys, reasons, strict=True)))


def conflict(key_a: Column, key_b: Column, project: Column, type_a: Column, type_b: Column) -> Column:
    """same, unknown without a project, conflict within a notice type, version_diff across types."""
    return (
        F.when(key_a == key_b, "same").when(F.coalesce(project, F.lit("")) == "", "unknown").when(type_a.eqNullSafe(type_b), "conflict").otherwise("version_diff")
    )


def _given(project: str) -> Column:
    return F.coalesce(F.col(project).cast("string"), F.lit("")) != ""


def conflict_counts(rows: DataFrame, keys: list[str], value: str, kind: str) -> DataFrame:
    """One row per assertion (keys, value, kind) with n_conflicts and n_version_diffs: how many assertions of its keys contradict it.

    The same rule as conflict_pairs(), from counts: of the assertions of a key, those of its kind have other values, and
    of the rest those of its value are no contradiction. So a key of m assertions costs m rows, not their pairs. Rows
    without a project (the first key) give none; null values, kinds and further keys are values of their own.
    """
    each = rows.filter(_given(keys[0])).groupBy(*keys, value, kind).agg(F.lit(1).alias("_one"))
    names = [*keys, value, kind]
    counted = each
    for by, name in ((keys, "_all"), ([*keys, kind], "_kind"), ([*keys, value], "_value")):
        sums = each.groupBy(*by).agg(F.count("*").alias(name)).select(*(F.col(c).alias(f"_{name}_{c}") for c in by), name)
        counted = counted.join(sums, [counted[c].eqNullSafe(sums[f"_{name}_{c}"]) for c in by]).select(*counted.columns, name)
    return counted.select(*names, (F.col("_kind") - 1).alias("n_conflicts"), (F.col("_all") - F.col("_kind") - F.col("_value") + 1).alias("n_version_diffs"))


def conflict_pairs(rows: DataFrame, keys: list[str], value: str, order: str, kind: str) -> DataFrame:
    """Pairs of rows of equal keys, nulls included, with different values: keys, both orders, values and the verdict.

    The first key is the project; rows without one (null or empty) cannot be compared and are in no pair.
    Rows of equal key, kind and value are one assertion, kept by its first row, so that repeats make no pairs.
    """
    once = rows.filter(_given(keys[0])).groupBy(*keys, value, kind).agg(F.min(order).alias(order))
    a, b = once.alias("a"), once.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    pairs = a.join(b, same + [F.col(f"a.{order}") < F.col(f"b.{order}"), ~F.col(f"a.{value}").eqNullSafe(F.col(f"b.{value}"))])
    verdict = F.when(F.col(f"a.{kind}").eqNullSafe(F.col(f"b.{kind}")), "conflict").otherwise("version_diff")
    return pairs.select(*(F.col(f"a.{k}") for k in keys), F.col(f"a.{order}").alias("first"), F.col(f"b.{order}").alias("second"), verdict.alias("verdict"))


def repost_features(a: str, b: str) -> Column:
    """struct of ten features of a pair of pages (host, content, identifier, notice_type, title, simhash, publisher, published, links)."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    given = lambda n: (F.coalesce(x(n), F.lit("")) != "") & (F.coalesce(y(n), F.lit("")) != "")
    same = lambda n: F.coalesce(given(n) & (x(n) == y(n)), F.lit(False))
    either = lambda marks: F.coalesce(x("content").rlike(marks), F.lit(False)) | F.coalesce(y("content").rlike(marks), F.lit(False))
    under = F.coalesce(given("host") & (F.endswith(x("host"), y("host")) | F.endswith(y("host"), x("host"))), F.lit(False))
    titles = F.coalesce(jaccard(bigrams(F.trim(x("title"))), bigrams(F.trim(y("title")))) >= 0.6, F.lit(False))
    near = F.coalesce(given("content") & (F.bit_count(x("simhash").bitwiseXOR(y("simhash"))) <= 3), F.lit(False))
    dates = F.coalesce(given("published") & (F.substring(x("published"), 1, 10) == F.substring(y("published"), 1, 10)), F.lit(False))
    links = F.coalesce(F.arrays_overlap(x("links"), y("links")), F.lit(False))
    named = {"domain": under, "marker": either(REPOST_MARKS), "identifier": same("identifier"), "kind": same("notice_type"), "title": titles, "simhash": near, "publisher": same("publisher"), "date": dates, "links": links, "upstream": either(UPSTREAM_MARKS)}
    return F.struct(*(c.alias(k) for k, c in named.items()))


def repost_verdict(features: Column, least: int = 3) -> Column:
    names = ("domain", "marker", "identifier", "kind", "title", "simhash", "publisher", "date", "links", "upstream")
    count = sum(features[n].cast("int") for n in names)
    return F.when(count < least, "independent").when(features["simhash"], "same_source_repost").otherwise("likely_repost")


def repost_told(page: str) -> Column:
    """struct of what the verdict on pairs asks of a page (host, content, title, simhash, links), made once a page; null for what is not given.

    ``marks`` holds a bit for each kind of mark, ``grams`` a number for each gram of the title.
    """
    of = lambda n: F.col(f"{page}.{n}")
    marked = lambda marks, bit: F.when(of("content").rlike(marks), bit).otherwise(0)
    code = lambda c: F.ascii(c).cast("long")
    grams = F.array_distinct(F.transform(bigrams(F.trim(of("title"))), lambda g: F.shiftleft(code(g), 22) + F.when(F.length(g) > 1, code(F.substring(g, 2, 1)) + 1).otherwise(0)))
    return F.struct(
        F.nullif(of("host"), F.lit("")).alias("host"),
        (marked(REPOST_MARKS, 1) + marked(UPSTREAM_MARKS, 2)).alias("marks"),
        F.when(F.size(grams) > 0, grams).alias("grams"),
        F.when(of("content") != "", of("simhash")).alias("simhash"),
        F.when(F.size(of("links")) > 0, of("links")).alias("links"),
    )


def told_verdict(x: Column, y: Column, least: int = 3) -> Column:
    """repost_verdict() of two pages of repost_told() without identifier, kind, publisher and date; titles are compared only where they decide."""
    one = lambda c: F.when(c, 1).otherwise(0)
    near = F.bit_count(x["simhash"].bitwiseXOR(y["simhash"])) <= 3
    under = F.endswith(x["host"], y["host"]) | F.endswith(y["host"], x["host"])
    count = F.bit_count(x["marks"].bitwiseOR(y["marks"])) + one(near) + one(under) + one(F.arrays_overlap(x["links"], y["links"]))
    both = F.size(F.array_intersect(x["grams"], y["grams"]))
    titles = F.try_divide(both, F.size(x["grams"]) + F.size(y["grams"]) - both) >= 0.6
    return F.when(F.when(count == least - 1, titles).otherwise(count >= least), F.when(near, "same_source_repost").otherwise("likely_repost")).otherwise("independent")


def display_grade(support: Column, role: Column, status: Column) -> Column:
    """low for what is unread, weak or of unknown role; high for strong support from the original; else review."""
    support, role, status = (F.lower(F.coalesce(c, F.lit(d))) for c, d in ((support, "unsupported"), (role, "unknown"), (status, "present")))
    low = status.isin(*UNREADABLE) | support.isin(*WEAK) | (role == "unknown")
    return F.when(low, "low").when(support.isin(*STRONG) & (role == "official_original"), "high").otherwise("review")


def cross_verified(status: Column) -> Column:
    return F.coalesce(status.isin("independent", "consistent_unknown"), F.lit(False))


def repost_clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster) of linked pairs (a, b): least id reachable; pairs with a null link nothing.

    Rounds of contraction: each id goes to its least neighbour if that is below it, chains of these are followed by
    doubling, and the links between what is left are the next round's. An id that stays has a neighbour that goes, so
    a round halves the ids with links at least, and a chain of links takes rounds by its length's logarithm.
    """
    from noticelake.sources.scratch import stored

    given = pairs.select("a", "b").filter("a is not null and b is not null")
    both = stored(given.unionByName(given.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("id"), F.col("a").alias("cluster")).distinct()
    links = both.filter("a <> b")
    onward = lambda ups: ups.join(ups.select(F.col("a").alias("up"), F.col("up").alias("far")), "up").select("a", "up", "far")
    while not links.isEmpty():
        ups = links.groupBy("a").agg(F.min("b").alias("up")).select("a", F.least("a", "up").alias("up"))
        while True:  # until every id knows the last of its chain
            once = onward(ups).select("a", F.col("far").alias("up"))
            twice = stored(onward(once))
            ups = twice.select("a", F.col("far").alias("up"))
            if twice.filter("up <> far").isEmpty():
                break
        top = lambda c: ups.select(F.col("a").alias(c), F.col("up").alias(f"_{c}"))  # noqa: B023, E731
        labels = stored(labels.join(top("cluster"), "cluster", "left").select("id", F.coalesce("_cluster", "cluster").alias("cluster")))
        links = stored(links.join(top("a"), "a").join(top("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct())
    return labels


def combined(pages: DataFrame, field: str | None = None, value: str | None = None, project: str | None = None) -> DataFrame:
    """(id, role, simhash, source_group, fact_key, n_candidates, nearest) of pages (id, url, host, content, simhash).

    Candidates are all other pages within the fingerprint's radius; ``nearest`` is the one of least distance, then id.
    Both are found per fingerprint, so a text that a third of all pages share is matched once. Pages are read once, what
    is told of them is stored without their contents. Fingerprint 0 has no
    candidates, an empty field or value no key. Ids are unique and not null; extra columns are left aside.
    """
    from noticelake.operators.simhash import near_prints
    from noticelake.sources.scratch import stored

    given = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    key = F.when((given(field) != "") & (given(value) != ""), fact_key(given(project), given(field), given(value)))
    role, group = source_role(F.col("host"), F.col("content")), source_group(F.col("url"), F.col("simhash"))
    told = stored(pages.select("id", role.alias("role"), "simhash", group.alias("source_group"), key.alias("fact_key")))
    prints = told.select("id", "simhash")
    held = prints.filter("simhash <> 0").groupBy(F.col("simhash").alias("y")).agg(F.count("*").alias("m"), F.min("id").alias("first"))
    later = prints.join(held.select(F.col("y").alias("simhash"), "first"), "simhash").filter("id > first").groupBy("simhash").agg(F.min("id").alias("second"))
    around = near_prints(prints, prints).join(held, "y").withColumn("distance", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))))
    others = F.when(F.col("x") != F.col("y"), F.struct("distance", F.col("first").alias("id")))
    per = around.groupBy("x").agg(F.sum("m").alias("m"), F.min(others).alias("other"), F.min(F.when(F.col("x") == F.col("y"), F.col("first"))).alias("first"))
    joined = told.join(per.withColumnRenamed("x", "simhash"), "simhash", "left").join(later, "simhash", "left")
    same = F.when(F.col("id") != F.col("first"), F.col("first")).otherwise(F.col("second"))
    return joined.select(
        *told.columns,
        F.coalesce(F.col("m") - 1, F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce(same, F.col("other.id")).alias("nearest"),
    )
