"""Deletions as rewrites: rows to keep are what an anti join leaves; every deletion has an audit table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.sources.scratch import stored


@dataclass(frozen=True)
class Hop:
    """Rows of ``child`` go where their ``key`` is the ``parent_key`` of a row of ``parent`` that goes."""

    child: str
    key: str
    parent: str
    parent_key: str


@dataclass(frozen=True)
class Spared:
    """Rows of ``table`` stay where their ``key`` is the ``by_key`` of a row of ``by`` that stays."""

    table: str
    key: str
    by: str
    by_key: str


#: What hangs on what: sources by their address or that of their origin, tenders by theirs (in the order of deletion).
ROOTS = {"notice_sources": ("source_url", "origin_url"), "tenders": ("source_url",), "scrape_jobs": ("url",)}
HOPS = (
    Hop("notice_versions", "notice_source_id", "notice_sources", "notice_source_id"),
    Hop("notice_participants", "notice_id", "notice_sources", "notice_id"),
    Hop("extracted_fields", "tender_id", "tenders", "id"),
    Hop("field_evidence_links", "field_id", "extracted_fields", "id"),
    Hop("evidence", "tender_id", "tenders", "id"),
    Hop("party_roles", "tender_id", "tenders", "id"),
    Hop("push_logs", "tender_id", "tenders", "id"),
)
SPARED = (Spared("evidence", "id", "field_evidence_links", "evidence_id"),)


def cascade(tables: dict[str, DataFrame], root: str, key: str, doomed: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete the rows of ``root`` that meet ``doomed`` and all rows of other tables with their key.

    Gives what remains of each table and an audit of true counts (table, deleted).
    """
    gone = tables[root].filter(doomed).select(key).distinct()
    kept = {name: df.join(gone, key, "left_anti") for name, df in tables.items()}
    audit = None
    for name, df in tables.items():
        count = df.join(gone, key, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        audit = count if audit is None else audit.unionByName(count)
    return kept, audit


def delete_user_data(tables: dict[str, DataFrame], user: object, key: str = "user_id") -> dict[str, DataFrame]:
    """Tables without a user's rows; tables without that column, as public notices, stay."""
    return {n: df.filter(~F.col(key).eqNullSafe(F.lit(user))) if key in df.columns else df for n, df in tables.items()}


def forget_snapshots(versions: DataFrame, doomed: Column, path: str = "snapshot_path") -> DataFrame:
    """Version rows stay; the paths of deleted snapshots become null."""
    return versions.withColumn(path, F.when(~F.coalesce(doomed, F.lit(False)), F.col(path)))


def _marked(df: DataFrame, key: str, keys: DataFrame, mark: str) -> DataFrame:
    """``df`` with a column that tells whether its ``key`` is among the only column of ``keys``; a null never is."""
    listed = keys.toDF(f"_{mark}").filter(f"_{mark} is not null").distinct().withColumn(mark, F.lit(True))
    return df.join(listed, df[key] == F.col(f"_{mark}"), "left").drop(f"_{mark}").withColumn(mark, F.coalesce(mark, F.lit(False)))


def delete_closure(
    tables: dict[str, DataFrame], targets: DataFrame, roots: dict[str, tuple[str, ...]] = ROOTS, hops: tuple[Hop, ...] = HOPS, spared: tuple[Spared, ...] = SPARED
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete all that hangs on ``targets`` (one column) over a graph of keys: what remains of each table, and an audit.

    A row of a root table goes where any of the root's columns is a target, of other tables where any hop reaches it,
    unless it is spared. ``hops`` stand in an order in which the parents of a table, and what spares it, come before it.
    The audit has a row for each table and cause (the first that holds) with true counts: table, cause, deleted, spared.
    Only the keys of deleted rows are written between hops. Tables that are not given are passed over; null keys hang on
    nothing; repeated rows all go or all stay; a row that two causes reach counts for the first.
    """
    order = [t for t in dict.fromkeys([*roots, *(h.child for h in hops)]) if t in tables]
    causes: dict[str, list[tuple[str, str, DataFrame]]] = {t: [] for t in order}
    kept, audits = {name: df for name, df in tables.items() if name not in order}, []
    for name in order:
        causes[name] += [(c, c, targets) for c in roots.get(name, ())]
        marked, stays = tables[name], F.lit(False)
        for i, (_, key, keys) in enumerate(causes[name]):
            marked = _marked(marked, key, keys, f"_by{i}")
        for i, s in enumerate(s for s in spared if s.table == name and s.by in kept):
            marked = _marked(marked, s.key, kept[s.by].select(s.by_key), f"_for{i}")
            stays = stays | F.col(f"_for{i}")
        cause = F.coalesce(*(F.when(F.col(f"_by{i}"), F.lit(c)) for i, (c, _, _) in enumerate(causes[name])), F.lit(None).cast("string"))
        marked = marked.withColumns({"_cause": cause, "_stays": stays})
        goes = F.col("_cause").isNotNull() & ~F.col("_stays")
        kept[name] = marked.filter(~goes).select(*tables[name].columns)
        counts = marked.filter("_cause is not null").groupBy(F.lit(name).alias("table"), F.col("_cause").alias("cause"))
        audits.append(counts.agg(F.count_if(~F.col("_stays")).alias("deleted"), F.count_if("_stays").alias("spared")))
        for hop in hops:
            if hop.parent == name and hop.child in tables:
                gone = stored(marked.filter(goes).select(hop.parent_key).distinct())
                causes[hop.child].append((f"{hop.parent}.{hop.parent_key}", hop.key, gone))
    return kept, reduce(DataFrame.unionByName, audits)


def audit_record(audit: DataFrame, scope: str, target: str, basis: str, operator: str, at: str) -> DataFrame:
    """The audit with who asked for it, why, and when: one row for each table and cause, its id made from all of these."""
    named = audit.withColumns({"deletion_scope": F.lit(scope), "target": F.lit(target), "request_basis": F.lit(basis), "operator": F.lit(operator), "executed_at": F.lit(at).cast("timestamp")})
    return named.withColumn("audit_id", F.substring(F.sha2(F.concat_ws("|", F.lit(scope), F.lit(target), F.lit(basis), F.lit(operator), F.lit(at), "table", "cause"), 256), 1, 16))
