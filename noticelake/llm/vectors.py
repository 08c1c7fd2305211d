"""Operator 12: near-duplicate vectors by a subspace pigeonhole join.

Vectors of length one are rotated onto the principal axes of a bounded sample and cut
into blocks of BLOCK_DIMS axes. A cosine of t is a squared distance of 2 - 2t, and the
squared distance is the sum over the blocks; so if every block had more than its share
of that budget, the sum would too. Every link is therefore within the budget of at least
one block. The shares are in proportion to the blocks' variances. Blocks with next to no
variance get none, which keeps the argument: a part of a sum is no more than the sum.

Each block is range-joined on its own. Its space is cut into the Voronoi cells of centres
of the sample; a vector is at home in one cell and visits those cells before it, in the
order of their numbers, that a vector within its budget can be in (by the distance to the
plane between two centres and by the cell's radius). So each pair of a block meets once.
The members of a cell are dealt into chunks and compared chunk with chunk, so that neither
a hot cell nor a group of copies is one task's work. What is within the budget is checked
by its cosine in double precision, and counts in the first block that it is within the
budget of, so that no list of pairs has to be made distinct. Only counts of links and
the links of a spanning forest leave a task.

Equal vectors are one class from the start and are not compared.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; neither do rows without an id, whose component is null; vectors of
different lengths are not compared; equal vectors link with each other; repeated rows are
repeated in the result and count as other vectors; ids that repeat with other vectors are
linked by each of them; a component has the least id of its rows; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import bounded_batches
from noticelake.llm.components import components
from noticelake.llm.scratch import stored

COSINE = 0.9
#: Axes of a block, and the share of the mean variance of a block below which it gets no budget.
BLOCK_DIMS, LEAST_VARIANCE = 16, 0.01
#: Vectors that axes and centres are fitted on, about; vectors for each centre, and centres of a block at most.
FIT_ROWS, CELL_ROWS, MOST_CELLS = 20_000, 16_384, 1024
#: Members of a chunk, vectors that are dealt in one step, rows and columns of a tile of distances, and candidates that are checked in one step.
CHUNK, TILE = 16_384, 1024
TILE_ROWS, TILE_COLUMNS, STEP = 512, 2048, 32_768
#: What rounding may add to a squared distance of vectors of length one: in double and in single precision.
SLACK, COARSE = 1e-9, 1e-5


class Space:
    """Axes, blocks with their budgets, and the centres of each block."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float = COSINE, block_dims: int = BLOCK_DIMS):
        """``sample``: vectors of length one; ``n``: the number of all vectors."""
        variance, axes = np.linalg.eigh(np.cov(sample, rowvar=False, bias=True).reshape(sample.shape[1], -1))
        order = np.argsort(-variance, kind="stable")
        variance, self.axes = np.maximum(variance[order], 0), np.ascontiguousarray(axes[:, order])
        cuts = [slice(i, min(i + block_dims, len(variance))) for i in range(0, len(variance), block_dims)]
        own = np.array([variance[c].sum() for c in cuts])
        if not own.sum():
            own[:] = 1
        kept = own >= LEAST_VARIANCE * own.mean()
        self.blocks = [c for c, k in zip(cuts, kept, strict=True) if k]
        self.budgets = (2 - 2 * cosine + SLACK) * own[kept] / own[kept].sum()
        self.cosine = cosine
        turned = self.turned(sample)
        self.centres = [centres(turned[:, c], min(MOST_CELLS, math.ceil(n / CELL_ROWS))) for c in self.blocks]
        self.radii: list[np.ndarray] = []

    def turned(self, x: np.ndarray) -> np.ndarray:
        """``x`` on the axes, each row by the same sums in the same order whatever stands beside it."""
        out = np.zeros(x.shape)
        for i in range(x.shape[1]):
            out += x[:, i : i + 1] * self.axes[i]
        return out

    def home(self, y: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row, and its squared distances to all centres."""
        squares = _squares(y[:, self.blocks[block]], self.centres[block])
        return squares.argmin(axis=1), squares

    def visits(self, y: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home cell of each row, and (row, cell) for the cells before it that it can have a partner in."""
        home, squares = self.home(y, block)
        far = math.sqrt(self.budgets[block]) + COARSE
        between = np.sqrt(_squares(self.centres[block], self.centres[block]))[home]
        rows = np.arange(len(y))
        plane = (squares - squares[rows, home][:, None]) / np.maximum(2 * between, 1e-300)
        near = (plane <= far) & (np.sqrt(squares) <= self.radii[block] + far) & (np.arange(squares.shape[1]) < home[:, None])
        return home, *np.nonzero(near)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0)


def centres(points: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different centres of ``points`` after a few steps of k-means from a fixed start."""
    points = np.unique(points, axis=0)
    out = points[np.random.default_rng(7).permutation(len(points))[: max(1, n)]]
    for _ in range(4 if len(out) > 1 else 0):
        own = np.concatenate([_squares(points[i : i + TILE], out).argmin(axis=1) for i in range(0, len(points), TILE)])
        counts = np.bincount(own, minlength=len(out))
        sums = np.stack([np.bincount(own, weights=points[:, i], minlength=len(out)) for i in range(points.shape[1])], axis=1)
        out = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], out)
    return np.unique(out, axis=0)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision; any finite size is in range."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(v: Column) -> Column:
    """A vector that has a direction."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _sample(classes: DataFrame, n: int, seed: int = 11) -> np.ndarray:
    """Vectors of length one of about FIT_ROWS classes, drawn by hash."""
    part = max(1, n // FIT_ROWS)
    drawn = classes.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(part)) == 0).orderBy("key", "id").limit(2 * FIT_ROWS)
    return unit_rows(drawn.select("vector").toArrow().column(0))


def _dealt(classes: DataFrame, space: Space) -> DataFrame:
    """Rows (block, cell, i, j, side, id, key, copies, vector): each for one comparison of chunk i with chunk j of a cell.

    Chunks of visitors have the numbers -1, -2, ..., and are compared with those of a cell's own members only.
    """
    spark = classes.sparkSession
    rough = spark.sparkContext.broadcast(space)
    cell_of = [("block", pa.int32()), ("cell", pa.int32())]
    members, visitors = pa.schema([*cell_of, ("members", pa.int64()), ("radius", pa.float64())]), pa.schema([*cell_of, ("visitors", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = rough.value
        most: dict[tuple[int, int], list] = {}
        for batch in batches:
            if batch.num_rows:
                y = space.turned(unit_rows(batch.column("vector")))
                for b in range(len(space.blocks)):
                    home, squares = space.home(y, b)
                    near = np.sqrt(squares[np.arange(len(y)), home])
                    for c in np.unique(home).tolist():
                        own = most.setdefault((b, c), [0, 0.0])
                        own[0] += int((home == c).sum())
                        own[1] = max(own[1], float(near[home == c].max()))
        if most:
            yield pa.RecordBatch.from_pylist([{"block": b, "cell": c, "members": m, "radius": r} for (b, c), (m, r) in most.items()], schema=members)

    cells = classes.select("vector").mapInArrow(counted, "block int, cell int, members long, radius double")
    homes = [np.zeros(len(c), dtype=np.int64) for c in space.centres]
    space.radii = [np.zeros(len(c)) for c in space.centres]
    # One row a cell; there are at most MOST_CELLS in a block.
    for r in cells.groupBy("block", "cell").agg(F.sum("members").alias("members"), F.max("radius").alias("radius")).collect():
        homes[r["block"]][r["cell"]], space.radii[r["block"]][r["cell"]] = r["members"], r["radius"] + COARSE
    fitted = spark.sparkContext.broadcast(space)

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = fitted.value
        seen = [np.zeros(len(c), dtype=np.int64) for c in space.centres]
        for batch in batches:
            if batch.num_rows:
                y = space.turned(unit_rows(batch.column("vector")))
                for b, own in enumerate(seen):
                    own += np.bincount(space.visits(y, b)[2], minlength=len(own))
        yield pa.RecordBatch.from_pylist([{"block": b, "cell": c, "visitors": int(v)} for b, own in enumerate(seen) for c, v in enumerate(own) if v], schema=visitors)

    guests = [np.zeros(len(c), dtype=np.int64) for c in space.centres]
    for r in classes.select("vector").mapInArrow(visited, "block int, cell int, visitors long").groupBy("block", "cell").agg(F.sum("visitors").alias("visitors")).collect():
        guests[r["block"]][r["cell"]] = r["visitors"]
    chunks = spark.sparkContext.broadcast(([-(-x // CHUNK) for x in homes], [-(-x // CHUNK) for x in guests]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, (own, other) = fitted.value, chunks.value
        names = ("block", "cell", "i", "j", "side")
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                batch = whole.slice(at, TILE)
                y, key = space.turned(unit_rows(batch.column("vector"))), batch.column("key").to_numpy(zero_copy_only=False)
                for b in range(len(space.blocks)):
                    home, rows, cells = space.visits(y, b)
                    out: list[tuple] = []
                    here = key % np.maximum(own[b][home], 1)
                    for r, (cell, at_home) in enumerate(zip(home.tolist(), here.tolist(), strict=True)):
                        k, guests = int(own[b][cell]), int(other[b][cell])
                        out += [(r, b, cell, min(at_home, j), max(at_home, j), int(j < at_home)) for j in range(k)]
                        out += [(r, b, cell, at_home, -1 - j, 0) for j in range(guests)]
                    for r, cell in zip(rows.tolist(), cells.tolist(), strict=True):
                        j = -1 - int(key[r] % other[b][cell])
                        out += [(r, b, cell, i, j, 1) for i in range(int(own[b][cell]))]
                    table = np.array(out, dtype=np.int64)
                    for part in range(0, len(table), 4 * TILE):
                        rows_of = table[part : part + 4 * TILE]
                        taken = batch.take(pa.array(rows_of[:, 0]))
                        columns = [pa.array(rows_of[:, c], pa.int32()) for c in range(1, 6)]
                        yield pa.RecordBatch.from_arrays([*columns, *taken.columns], [*names, *taken.schema.names])

    kind = classes.schema["vector"].dataType.simpleString()
    own = classes.select("id", "key", "copies", "vector")
    return own.mapInArrow(deal, f"block int, cell int, i int, j int, side int, id long, key long, copies long, vector {kind}")


def _within(y: np.ndarray, z: np.ndarray, cut: slice) -> np.ndarray:
    """Squared distances of rows of ``y`` and ``z`` in a block, by the same sums for the same pair wherever it stands."""
    out = np.zeros(len(y))
    for i in range(cut.start, cut.stop):
        out += (y[:, i] - z[:, i]) ** 2
    return out


def links_between(x: np.ndarray, side: np.ndarray, same: bool, block: int, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the two sides that are linked and within the budget of ``block`` and of no block before it."""
    left = np.arange(len(x)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    part = (x @ space.axes[:, space.blocks[block]]).astype(np.float32)
    squares, ones = (part * part).sum(axis=1, keepdims=True), np.ones((len(x), 1), dtype=np.float32)
    # One product of these gives all squared distances of a tile.
    rows = np.concatenate((-2 * part, squares, ones), axis=1)[left]
    columns = np.concatenate((part, ones, squares), axis=1)[right]
    most = np.float32(space.budgets[block] + COARSE)
    for i in range(0, len(left), TILE_ROWS):
        for j in range(i - i % TILE_COLUMNS if same else 0, len(right), TILE_COLUMNS):
            tile = rows[i : i + TILE_ROWS] @ columns[j : j + TILE_COLUMNS].T
            p, q = np.divmod(np.flatnonzero(tile.ravel() <= most), tile.shape[1])
            p, q = p + i, q + j
            if same:
                p, q = p[q > p], q[q > p]
            for at in range(0, len(p), STEP):
                a, b = left[p[at : at + STEP]], right[q[at : at + STEP]]
                own, place = np.unique(np.concatenate((a, b)), return_inverse=True)
                turned, y, z = space.turned(x[own]), place[: len(a)], place[len(a) :]
                for earlier in range(block + 1):
                    inside = _within(turned[y], turned[z], space.blocks[earlier]) <= space.budgets[earlier]
                    good = inside if earlier == block else ~inside
                    y, z = y[good], z[good]
                a, b = own[y], own[z]
                linked = (x[a] * x[b]).sum(axis=1) >= space.cosine
                if linked.any():
                    yield a[linked], b[linked]


def _compared(dealt: DataFrame, space: Space) -> DataFrame:
    """(id, key, links, root_id, root_key): per unit of comparison, vectors with their links found there and the least vector that these join them to."""
    fitted = dealt.sparkSession.sparkContext.broadcast(space)
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("links", pa.int64()), ("root_id", pa.int64()), ("root_key", pa.int64())])

    def compared(unit: tuple, table: pa.Table) -> pa.Table:
        block, _, i, j = (k.as_py() for k in unit)
        table = table.sort_by([("id", "ascending"), ("key", "ascending")])
        side, copies = table["side"].to_numpy(), table["copies"].to_numpy()
        links, root = np.zeros(len(side), dtype=np.int64), np.arange(len(side))
        for a, b in links_between(unit_rows(table["vector"]), side, i == j, block, fitted.value):
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            while True:  # the least root of either end, until all ends agree
                low = np.minimum(root[a], root[b])
                if (root[a] == low).all() and (root[b] == low).all():
                    break
                for end in (a, b):
                    np.minimum.at(root, root[end], low)
                    np.minimum.at(root, end, low)
                while (root[root] != root).any():
                    root = root[root]
        rows = pa.array(np.flatnonzero(links))
        own, top = table.take(rows), table.take(pa.array(root[links > 0]))
        return pa.table([own["id"], own["key"], pa.array(links[links > 0]), top["id"], top["key"]], schema=schema)

    return dealt.groupBy("block", "cell", "i", "j").applyInArrow(compared, "id long, key long, links long, root_id long, root_key long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id and kept."""
    bounded_batches(vectors.sparkSession)
    v = F.col(vector_col)
    able = usable(v) & F.col(id_col).isNotNull()
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.when(able, F.xxhash64(v)).alias("key"), F.when(able, F.xxhash64(F.lit(1), v)).alias("check"), v.alias("vector")
    )
    classes = stored(
        rows.filter(F.col("key").isNotNull()).groupBy("key", "check").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    )
    found = None
    for r in classes.groupBy(F.size("vector").alias("dims")).count().orderBy("dims").collect():
        own = classes.filter(F.size("vector") == r["dims"])
        space = Space(_sample(own, r["count"]), r["count"], cosine)
        part = _compared(_dealt(own, space), space)
        found = part if found is None else found.unionByName(part)
    named = rows.select("id", "key", "check")
    if found is None:
        linked = named.withColumns({"links": F.lit(0).cast("long"), "label": F.col("id")})
    else:
        found = stored(found)
        node = lambda i, k: F.struct(F.col(i).alias("id"), F.col(k).alias("set"))
        labels = components(
            found.filter("root_id <> id or root_key <> key").select(node("root_id", "root_key").alias("a"), node("id", "key").alias("b"))
        )
        labels = labels.select(F.col("node.id").alias("id"), F.col("node.set").alias("key"), F.col("label.id").alias("label"))
        counts = found.groupBy("id", "key").agg(F.sum("links").alias("links")).join(labels, ["id", "key"], "left")
        of_class = (
            classes.join(counts, ["id", "key"], "left")
            .select("key", "check", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("label", "id").alias("label"))
        )
        linked = named.join(of_class, ["key", "check"], "left")
    component = F.coalesce("label", "id").alias("component_id")
    return linked.select(
        F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component, F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
