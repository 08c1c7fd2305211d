"""Rows that a batch adds to stored tables: parties, identifiers, snapshots, evidence and pushes, with the counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions import scoring as sc
from noticelake.functions import values as v

#: Roles of extracted fields and report keys of signals (fixed values).
FIELD_ROLES = {"purchaser_name": "purchaser", "winner_name": "winner"}
SIGNAL_KEYS = {
    "中标活跃度": "award_activity",
    "公开中标集中度": "award_concentration",
    "废标公告关联": "cancellation_link",
    "明确投标否决": "explicit_rejection",
    "信息冲突观察": "info_conflict",
    "高频共现提示": "high_freq_cooccurrence",
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def usable_fields(fields: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Current present fields of the given names whose value is not blank, trimmed."""
    value = F.trim("raw_value")
    kept = fields.filter(F.col("field_name").isin(*names) & (F.col("field_status") == "present") & F.col("is_current"))
    return kept.withColumn("raw_value", value).filter("raw_value <> ''")


def _unknown(rows: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """The different values of ``columns`` in ``rows`` that ``known`` lacks, by one grouping and without a sort; what holds a null is never known."""
    said = known.select(*columns, F.lit(True).alias("_known")).dropna(subset=columns)
    both = rows.select(*columns, F.lit(False).alias("_known")).unionByName(said)
    return both.groupBy(*columns).agg(F.bool_or("_known").alias("_known")).filter("not _known").select(*columns)


def participants(fields: DataFrame, chain: DataFrame, known: DataFrame) -> DataFrame:
    """New (notice_id, organisation, role) from current fields, once each, without those known.

    ``fields`` has tender_id, field_name, field_status, is_current and raw_value, ``chain`` tender_id and notice_id;
    fields of a tender without a notice are left for a later run. Null values and ids give no row.
    """
    named = usable_fields(fields, tuple(FIELD_ROLES)).join(chain.select("tender_id", "notice_id").hint("shuffle_hash"), "tender_id")
    role = F.element_at(_map(FIELD_ROLES), F.col("field_name"))
    rows = named.select("notice_id", v.org_name(F.col("raw_value")).alias("organisation"), role.alias("role"))
    return _unknown(rows, known, ["notice_id", "organisation", "role"])


def identifiers(fields: DataFrame, chain: DataFrame, known: DataFrame, longest: int = 200) -> DataFrame:
    """New (project_id, raw_value) of project identifiers, cut to the column's width, once each, without those known."""
    named = usable_fields(fields, ("project_identifier",)).join(chain.select("tender_id", "project_id").hint("shuffle_hash"), "tender_id")
    rows = named.select("project_id", F.substring("raw_value", 1, longest).alias("raw_value"))
    return _unknown(rows, known, ["project_id", "raw_value"])


def migration_counters(tenders: DataFrame, known: DataFrame, fields: DataFrame) -> DataFrame:
    """One row for a run: total, migrated, skipped, participants, identifiers.

    A tender is skipped if its address (made from its id where empty) is known or an earlier one has it. Fields that
    are processed count, written or not; they are counted by tender before tenders are looked up.
    """
    address = F.when(F.coalesce("source_url", F.lit("")) == "", F.concat(F.lit("migrated://tender/"), F.col("tender_id").cast("string"))).otherwise(F.col("source_url"))
    chains = tenders.select(address.alias("source_url"))
    fresh = chains.distinct().join(known.select("source_url"), "source_url", "left_anti").agg(F.count("*").alias("migrated"))
    total = chains.agg(F.count("*").alias("total"))
    of = lambda names: F.count_if(F.col("field_name").isin(*names))
    used = usable_fields(fields, (*FIELD_ROLES, "project_identifier")).groupBy("tender_id").agg(of(FIELD_ROLES).alias("p"), of(["project_identifier"]).alias("i"))
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = used.join(tenders.select("tender_id"), "tender_id", "left_semi").agg(sums("p").alias("participants"), sums("i").alias("identifiers"))
    one = total.join(F.broadcast(fresh)).join(F.broadcast(counts))  # one row each
    return one.select("total", "migrated", (F.col("total") - F.col("migrated")).alias("skipped"), "participants", "identifiers")


def new_snapshots(crawl: DataFrame, latest: DataFrame, text: str | None = None, key: tuple[str, ...] = ("url",)) -> DataFrame:
    """Pages of a crawl (url, html) that differ from the latest snapshot (url, content_hash, version): url, html, content_hash, version, file.

    The hash is of the cleaned text where a column is named and not empty, else of the html. Of several pages of one
    key in a crawl each differing content is one version, in order of its hash; of several snapshots the one of the
    greatest version counts. Null html counts as empty. ``key`` names what a page is known by; it includes the url.
    """
    body = F.coalesce("html", F.lit(""))
    hashed = body if text is None else F.when(F.coalesce(text, F.lit("")) != "", F.col(text)).otherwise(body)
    pages = crawl.select(*key, body.alias("html"), F.sha2(hashed, 256).alias("content_hash"))
    once = pages.groupBy(*key, "content_hash").agg(F.min("html").alias("html"))
    last = latest.groupBy(*key).agg(F.max(F.struct("version", "content_hash")).alias("_last"))
    before = last.select(*key, F.col("_last.content_hash").alias("_hash"), F.col("_last.version").alias("_version"))
    changed = once.join(before, list(key), "left").filter(~F.col("content_hash").eqNullSafe(F.col("_hash")))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("content_hash"))
    made = changed.withColumn("version", (F.coalesce("_version", F.lit(0)) + number).cast("long"))
    file = F.concat(F.substring(F.sha2("url", 256), 1, 16), F.lit("_v"), F.col("version").cast("string"), F.lit(".html"))
    return made.select(*key, "html", "content_hash", "version", file.alias("file"))


def evidence_rows(found: DataFrame, id_col: str, snapshot: str, raw: str, side: int = 20) -> DataFrame:
    """Evidence rows of quotes (id, quote, start, end in code points, match_method, confidence 0 to 1) with contexts and the texts' hashes.

    Confidence is a whole number of hundredths; an empty text has no hash. Written with ``append_table``.
    """
    digest = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.sha2(c, 256))
    first = F.greatest(F.col("start") - side, F.lit(0)).cast("int")
    return found.select(
        id_col,
        F.col("quote").alias("evidence_text"),
        F.substring(F.col(raw), first + 1, F.col("start").cast("int") - first).alias("context_before"),
        F.substring(F.col(raw), F.col("end").cast("int") + 1, F.lit(side)).alias("context_after"),
        F.col("start").alias("raw_start"),
        F.col("end").alias("raw_end"),
        "match_method",
        F.floor(F.col("confidence") * 100).cast("int").alias("confidence"),
        digest(snapshot).alias("snapshot_sha256"),
        digest(raw).alias("raw_text_sha256"),
    )


def trigger(subscriptions: DataFrame, unpushed: DataFrame, recent: DataFrame) -> DataFrame:
    """(subscription_id, status, n, content_hash) of one run over subscriptions (subscription_id, is_active, due, delivered).

    ``unpushed`` has (subscription_id, id) not yet in the log, ``recent`` (subscription_id, content_hash) of the last
    pushes. In this order: inactive ones are skipped, others wait until due, have nothing new, repeat a recent push,
    or are pushed, of which only the delivered ones are ok. A null flag counts as false; an unknown or null
    subscription has no row.
    """
    packs = unpushed.groupBy("subscription_id").agg(F.collect_list("id").alias("ids")).select("subscription_id", F.size("ids").cast("long").alias("n"), sc.push_hash(F.col("ids")).alias("content_hash"))
    seen = recent.select("subscription_id", "content_hash").distinct().withColumn("repeated", F.lit(True))
    joined = subscriptions.join(packs, "subscription_id", "left").join(seen, ["subscription_id", "content_hash"], "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    status = (
        F.when(no("is_active"), "skipped")
        .when(no("due"), "not_due")
        .when(F.col("n").isNull(), "no_new")
        .when(F.col("repeated"), "skipped_duplicate")
        .when(no("delivered"), "push_failed")
        .otherwise("ok")
    )
    return joined.select("subscription_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), "content_hash")


def push_log(run: DataFrame, unpushed: DataFrame) -> DataFrame:
    """(subscription_id, id, content_hash) to append once a run's pushes are delivered; anything else comes again in the next run."""
    return unpushed.join(run.filter("status = 'ok'").select("subscription_id", "content_hash"), "subscription_id")


def flat_signals(signals: DataFrame, org: str) -> DataFrame:
    """(org, flat): a map from report key to (observed_value, observation_period) of signals (org, signal_name, observed_value, observation_period).

    A name without a key stands for itself; of several signals of a key the greatest value stays. An organisation has
    as many entries as there are signal names.
    """
    key = F.coalesce(F.try_element_at(_map(SIGNAL_KEYS), F.col("signal_name")), F.col("signal_name"), F.lit(""))
    entry = F.struct("observed_value", F.coalesce("observation_period", F.lit("")).alias("observation_period"))
    once = signals.groupBy(org, key.alias("key")).agg(F.max(entry).alias("entry"))
    return once.groupBy(org).agg(F.map_from_entries(F.collect_list(F.struct("key", "entry"))).alias("flat"))


def short_hash(column: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text; null for an empty one."""
    return F.when(F.coalesce(column, F.lit("")) != "", F.substring(F.sha2(column, 256), 1, 16))


def dataset_hash(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, n, dataset_hash): a hash of all rows whatever their order and partitions; repeated rows count, nulls differ from empty texts.

    Each row's SHA-256 is cut into parts that are summed before the shuffle, so no task sees more than sums.
    """
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    digest = F.sha2(F.concat_ws("\x1f", *texts), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
    sums = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(part(i).alias(f"_{i}") for i in range(4)))
    told = F.concat_ws(":", F.col("n").cast("string"), *(F.coalesce(F.col(f"_{i}").cast("string"), F.lit("0")) for i in range(4)))
    return sums.select(*(by or []), "n", F.substring(F.sha2(told, 256), 1, 16).alias("dataset_hash"))
