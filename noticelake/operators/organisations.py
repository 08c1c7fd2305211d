"""Names of organisations from any of the ids that they go by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY_ID = "^[A-Z0-9]{26}$"


def resolved_names(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, name) of rows (id, org_id): by entity id (26 capitals and digits, a capital at least), else by hash, else by the name itself.

    ``entities`` has organization_id and name. Each way is an equi join with one row a key; what none finds has a null name.
    """
    ids = entities.groupBy(F.col("organization_id").alias("org_id")).agg(F.min("name").alias("by_id"))
    names = entities.select("name").distinct()
    hashes = names.groupBy(F.concat(F.lit("org_"), F.substring(F.sha1("name"), 1, 12)).alias("org_id")).agg(F.min("name").alias("by_hash"))
    found = asked.join(ids, "org_id", "left").join(hashes, "org_id", "left").join(names.select(F.col("name").alias("org_id"), F.col("name").alias("own")), "org_id", "left")
    entity = F.when(F.col("org_id").rlike(ENTITY_ID) & F.col("org_id").rlike("[A-Z]"), F.col("by_id"))
    return found.select("id", F.coalesce(entity, "by_hash", "own").alias("name"))


def resolve(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(id, method, organization_id, confidence) of rows (id, code, name): by credit code, then exact name, then a near name.

    ``known`` has organization_id, name and code; of equal codes, names and distances the least id wins. Names are
    normalised by the caller. Near names are within 3 bits of a SimHash and are matched by fingerprint, not by row;
    only names that nothing else resolves are hashed. A blank name is ``empty_name``, whatever its code.
    Tables grow with the organisations and their sizes are not known from a file's, so none of them is broadcast.
    """
    from noticelake.operators.simhash import near_prints, simhash_column
    from noticelake.sources.scratch import stored

    least = F.min("organization_id")
    by_code = known.filter("code <> ''").groupBy("code").agg(least.alias("_code"))
    by_name = known.filter("name <> ''").groupBy("name").agg(least.alias("_name"))
    first = asked.select("id", "code", "name").join(by_code.hint("merge"), "code", "left").join(by_name.hint("merge"), "name", "left")
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    hash_ = simhash_column()("name").alias("simhash")
    open_names = stored(first.filter("_code is null and _name is null").filter(~blank).select("name").distinct().select("name", hash_))
    prints = stored(by_name.select("_name", hash_).groupBy(F.col("simhash").alias("y")).agg(F.min("_name").alias("_near")))
    close = near_prints(open_names, prints.select(F.col("y").alias("simhash"))).join(prints.hint("merge"), "y")
    best = close.groupBy("x").agg(F.min(F.struct(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).alias("d"), F.col("_near").alias("org"))).alias("best"))
    near = open_names.join(best.hint("merge"), F.col("simhash") == F.col("x")).select("name", "best")
    joined = first.join(near.hint("merge"), "name", "left")
    method = (
        F.when(blank, "empty_name").when(F.col("_code").isNotNull(), "exact_credit_code").when(F.col("_name").isNotNull(), "exact_name").when(F.col("best").isNotNull(), "fuzzy_name").otherwise("no_match")
    )
    sure = F.when(method == "exact_credit_code", 1.0).when(method == "exact_name", 0.95).when(method == "fuzzy_name", F.greatest(F.lit(0.7), F.round(0.9 - 0.1 * F.col("best.d"), 2))).otherwise(0.0)
    org = F.when(~blank, F.coalesce("_code", "_name", "best.org"))
    return joined.select("id", method.alias("method"), org.alias("organization_id"), sure.alias("confidence"))
