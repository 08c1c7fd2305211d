"""Bootstrap intervals over projects with exact draws: N draws of N projects in every replicate, made in parallel.

The N draws of a replicate fall into blocks of projects as a multinomial, which is split by
conditional binomials: first over the blocks, by their sizes, then within each block over its
projects. Every block of a replicate has a generator seeded by (seed, replicate, block), so
draws do not depend on partitions or order, no draw travels, and no weight has a bound.

Defined results: rows without a project are left out; fewer than two projects are an error;
a replicate of denominator 0 gives 0, as the ratio itself does; null numerators and
denominators count as 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Projects of a block: what one task draws for at once.
BLOCK = 4096


def block_draws(sizes: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """How many of a replicate's draws fall into each block: by one generator, the same for whoever asks."""
    return np.random.default_rng((seed, replicate, 0)).multinomial(sizes.sum(), sizes / sizes.sum())


def project_weights(size: int, draws: int, replicate: int, block: int, seed: int) -> np.ndarray:
    """How often each project of a block is drawn in a replicate."""
    return np.random.default_rng((seed, replicate, block + 1)).multinomial(draws, np.full(size, 1 / size))


def weighted_sums(rows: DataFrame, project: str, numerator: str, denominator: str, replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(replicate, x, y, weight): per replicate and block the weighted sums and the number of draws."""
    sums = rows.filter(F.col(project).isNotNull()).groupBy(F.col(project).cast("string").alias("project"))
    sums = sums.agg(F.coalesce(F.sum(numerator), F.lit(0)).cast("double").alias("x"), F.coalesce(F.sum(denominator), F.lit(0)).cast("double").alias("y"))
    count = sums.count()
    if count < 2:
        raise ValueError(f"resampling takes two projects at least, not {count}")
    blocks = -(-count // block)
    dealt = sums.withColumn("block", F.pmod(F.xxhash64("project"), F.lit(blocks)).cast("int"))
    # One row a block, of thousands of projects each.
    sizes = {r["block"]: r["count"] for r in dealt.groupBy("block").count().collect()}
    shared = rows.sparkSession.sparkContext.broadcast(np.array([sizes.get(i, 0) for i in range(blocks)]))

    def drawn(batch: pd.DataFrame) -> pd.DataFrame:
        batch, number = batch.sort_values("project"), int(batch["block"].iloc[0])
        x, y, out = batch["x"].to_numpy(), batch["y"].to_numpy(), []
        for r in range(1, replicates + 1):
            w = project_weights(len(batch), int(block_draws(shared.value, r, seed)[number]), r, number, seed)
            out.append((r, float(w @ x), float(w @ y), int(w.sum())))
        return pd.DataFrame(out, columns=["replicate", "x", "y", "weight"])

    return dealt.groupBy("block").applyInPandas(drawn, "replicate int, x double, y double, weight long")


def interval(rows: DataFrame, project: str, numerator: str, denominator: str, replicates: int = 1000, seed: int = 42, linear: bool = False, block: int = BLOCK) -> DataFrame:
    """(point, low, high, n_draws): a ratio of sums with its 95 % interval.

    The ends are the order statistics int(n * 0.025) and int(n * 0.975) - 1, or, if ``linear``, interpolated percentiles.
    """
    parts = weighted_sums(rows, project, numerator, denominator, replicates, seed, block)
    ratio = lambda x, y: F.coalesce(F.try_divide(F.sum(x), F.sum(y)), F.lit(0.0))
    per = parts.groupBy("replicate").agg(ratio("x", "y").alias("r"), F.sum("weight").alias("weight"))
    if linear:
        low, high = (F.percentile("r", F.lit(q)) for q in (0.025, 0.975))
    else:
        ordered = F.sort_array(F.collect_list("r"))  # one number a replicate
        low, high = ordered[int(replicates * 0.025)], ordered[max(0, int(replicates * 0.975) - 1)]
    ends = per.agg(low.alias("low"), high.alias("high"), F.max("weight").alias("n_draws"))
    point = rows.filter(F.col(project).isNotNull()).agg(ratio(numerator, denominator).alias("point"))
    return point.join(F.broadcast(ends)).select("point", "low", "high", "n_draws")
