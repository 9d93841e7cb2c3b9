"""Density clusters by true neighbours within a radius (DBSCAN), through a distributed radius join.

Equal vectors are one point with a weight. Points are dealt into cells along random projections, which never lengthen a
distance: two points within the radius differ by at most the radius on every axis. A point also goes to each cell whose
border lies within the radius, so the cell of its home holds all its neighbours. Along an axis on which the points hardly
spread, cells would only copy them, and there are none.

A crowded cell is not compared with itself at once. Its points ask one block of its members first, then more and more of them,
and a point asks on only while something is open: whether it is core, or whether it belongs to the largest cluster found so
far. Where neighbours are many, nearly all points are settled by the first block, and what is moved grows with the rows; points
that stay open are compared with all members of their cell, in wide blocks. A task forms the distances of one pair of blocks as
matrix products, strip by strip, and only counts, spanning links or labels leave it.
"""
from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrum.functions.vectors import is_finite
from clustrum.operators.ordering import global_index
from clustrum.session import bounded_collect, checked_broadcast, materialize

#: Members of a cell that its points ask first.
BLOCK_POINTS = 2048
#: A wide block in blocks, as long as its vectors hold no more than WIDE_VALUES numbers.
WIDE_BLOCKS, WIDE_VALUES = 8, 1 << 22
#: From round to round a point that is still open asks this many times more members.
ROUND_GROWTH = 4
#: Pairs of points of which a task holds the distances, and of which it holds whether they are close.
DISTANCE_PAIRS, CLOSE_PAIRS = 1 << 22, 1 << 26
#: A cell's width in radii: wider cells copy fewer points over their borders, narrower ones compare fewer.
CELL_RADII = 2.0


def point_key(vector: Column | str) -> Column:
    """128-bit digest of a vector's values, equal for equal vectors (0.0 and -0.0 included)."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.md5(F.array_join(F.transform(column, lambda x: (x.cast("double") + F.lit(0.0)).cast("string")), ",", "null").cast("binary"))


def weighted_points(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(point, v, weight, first_id): the distinct usable vectors, as doubles, how many rows have each, and the least of their ids."""
    usable = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & is_finite(vector)).select(
        point_key(vector).alias("point"), F.col(vector).cast("array<double>").alias("v"), F.col(id_column).alias("id"))
    return usable.groupBy("point").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("first_id"))


def projection_axes(dimension: int, axes: int, seed: int) -> np.ndarray:
    """Orthonormal directions (one a column): random ones, or the coordinates themselves where there are no more than `axes`."""
    if dimension <= axes:
        return np.eye(dimension)
    return np.linalg.qr(np.random.default_rng([seed, dimension]).normal(size=(dimension, axes)))[0]


def spread_axes(points: DataFrame, width: float, axes: int, seed: int) -> dict[int, list[bool]]:
    """Of each vector length, along which of its axes the points spread by more than half a cell (standard deviation)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(0)
            lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for d in np.unique(lengths).tolist():
                at = flat[starts[lengths == d][:, None] + np.arange(d)] @ projection_axes(d, axes, seed) / width
                sums[d] = sums.get(d, 0) + np.stack([np.full(at.shape[1], float(len(at))), at.sum(axis=0), (at * at).sum(axis=0)], axis=1)
        rows = [(d, k, *row) for d, total in sums.items() for k, row in enumerate(total.tolist())]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["d", "axis", "n", "s", "q"])

    found = points.select("v").mapInArrow(add, "d int, axis int, n double, s double, q double").groupBy("d", "axis").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    wide: dict[int, list[bool]] = {}
    for r in sorted(bounded_collect(found, 1_000_000, "vector lengths and axes")):
        # A sum beyond doubles decides for cells.
        wide.setdefault(r.d, []).append(not r.q / r.n - (r.s / r.n) ** 2 <= 0.25)
    return wide


def cell_members(points: DataFrame, radius: float, axes: int, seed: int) -> DataFrame:
    """(cell, home, point, v, weight): each point in its own cell and in all cells that begin or end within `radius` of it."""
    width = CELL_RADII * radius
    wide = spread_axes(points, width, axes, seed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            rows, cells, home = [], [], []
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                at = flat[starts[own][:, None] + np.arange(d)] @ projection_axes(d, axes, seed)[:, wide[d]]
                base = np.floor(at / width)
                # A little more than the radius, against rounding of the projections.
                reach = radius + 1e-9 * (np.abs(at) + radius)
                near = [np.ones(at.shape, bool), at - base * width <= reach, (base + 1) * width - at <= reach]
                for steps in itertools.product((0, 1, 2), repeat=at.shape[1]):
                    there = np.flatnonzero(np.all([np.ones(len(at), bool), *(near[s][:, k] for k, s in enumerate(steps))], axis=0))
                    moved = (base[there] + [(0, -1, 1)[s] for s in steps]).astype(np.int64)
                    rows.append(own[there])
                    cells += [f"{d}|" + ",".join(map(str, c)) for c in moved.tolist()]
                    home.append(np.full(len(there), not any(steps)))
            if rows:
                taken = batch.take(pa.array(np.concatenate(rows)))
                yield pa.record_batch(
                    [pa.array(cells, pa.string()), pa.array(np.concatenate(home)), *taken.columns], ["cell", "home", *batch.schema.names])

    return points.mapInArrow(deal, "cell string, home boolean, point string, v array<double>, weight long")


def block_pairs(members: DataFrame, block: int = BLOCK_POINTS) -> DataFrame:
    """(unit, cell, asks, point, v, weight): all members of a cell against its home points, in pairs of blocks of `block` points."""
    return unit_pairs(members.where("home").drop("home"), members.drop("home"), block, block)


def unit_pairs(asking: DataFrame, asked: DataFrame, ask_points: int, asked_points: int) -> DataFrame:
    """(unit, cell, asks, ...): what a task compares: points that ask for their neighbours (`asks`) and points of their cell.

    Both sides: cell, point, v and the same further columns. Larger cells are cut into pairs of blocks of about `ask_points` and
    `asked_points`; others share units. Cells that lack a side are dropped. A row moves once for each block of the other side.
    """
    count = lambda side, name: side.groupBy("cell").agg(F.count(F.lit(1)).alias(name))
    cut = lambda n, size: F.ceil(F.col(n) / size).cast("long")
    sizes = materialize(count(asking, "n_asking").join(count(asked, "n_asked"), "cell"), "cell-sizes")
    one = (F.col("n_asking") <= ask_points) & (F.col("n_asked") <= asked_points)
    bins = max(1, (sizes.where(one).agg(F.sum("n_asked")).first()[0] or 0) // asked_points)
    shared = F.when(one, F.pmod(F.xxhash64("cell"), F.lit(bins))).alias("shared")
    cells = checked_broadcast(sizes.select("cell", cut("n_asking", ask_points).alias("ask_blocks"), cut("n_asked", asked_points).alias("asked_blocks"), shared))

    def dealt(side: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("point", F.lit(1)), F.col(own))
        met = F.transform(F.sequence(F.lit(0).cast("long"), F.col(other) - 1), lambda x: F.concat_ws("|", "cell", *((mine, x) if asks else (x, mine))))
        unit = F.when(F.col("shared").isNotNull(), F.array(F.col("shared").cast("string"))).otherwise(met)
        return side.join(cells, "cell").select(F.explode(unit).alias("unit"), "cell", F.lit(asks).alias("asks"), *columns)

    columns = [c for c in asking.columns if c != "cell"]
    return dealt(asking, "ask_blocks", "asked_blocks", True).unionAll(dealt(asked, "asked_blocks", "ask_blocks", False))


def within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Whether each row of `a` lies within `radius` of each of `b`; where the product's rounding could decide, by differences."""
    close = np.empty((len(a), len(b)), bool)
    right = (b * b).sum(axis=1)
    rows = max(1, DISTANCE_PAIRS // max(1, len(b)))
    for start in range(0, len(a), rows):
        strip = a[start:start + rows]
        squares = (strip * strip).sum(axis=1)[:, None] + right
        gap = squares - 2 * (strip @ b.T) - radius * radius
        near = gap <= 0
        unsure = np.flatnonzero(np.abs(gap) <= 1e-12 * (squares + radius * radius) * max(8, a.shape[1]))
        for at in np.array_split(unsure, max(1, len(unsure) * a.shape[1] // (1 << 22))):
            i, j = np.divmod(at, len(b))
            near[i, j] = ((strip[i] - b[j]) ** 2).sum(axis=1) <= radius * radius
        close[start:start + rows] = near
    return close


def _per_unit(blocks: DataFrame, find: Callable, schema: str, radius: float) -> DataFrame:
    """Applies `find(asking, asked, close)` to every cell of every unit, strip by strip of the asking side: two tables of points,
    and which lie within the radius."""
    def run(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by("cell").combine_chunks()
        names = unit["cell"].to_pandas().to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        found = []
        for start, end in zip(starts, [*starts[1:], len(names)]):
            cell = unit.slice(start, end - start)
            asks = cell["asks"].to_numpy()
            asking, asked = cell.filter(pa.array(asks)), cell.filter(pa.array(~asks))
            if asking.num_rows and asked.num_rows:
                a, b = (t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (asking, asked))
                rows = max(1, CLOSE_PAIRS // len(b))
                found += [find(asking.slice(at, rows), asked, within(a[at:at + rows], b, radius)) for at in range(0, len(a), rows)]
        kept = [f for f in found if f.num_rows]
        return pa.concat_tables(kept) if kept else empty

    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    empty = pa.table({n: pa.array([], {"string": pa.string(), "long": pa.int64()}[k]) for n, k in zip(names, kinds)})
    return blocks.groupBy("unit").applyInArrow(run, schema)


def _counts(asking: pa.Table, asked: pa.Table, close: np.ndarray) -> pa.Table:
    weights, rows = asked["weight"].to_numpy(), max(1, DISTANCE_PAIRS // close.shape[1])
    near = np.concatenate([close[at:at + rows] @ weights for at in range(0, len(close), rows)])
    return pa.table({"point": asking["point"], "near": pa.array(near)})


def _spanning_links(asking: pa.Table, asked: pa.Table, close: np.ndarray) -> pa.Table:
    """Links that join what `close` joins, fewer than there are points: a search from side to side that takes each point once."""
    left, right = asking["point"].to_pylist(), asked["point"].to_pylist()
    out: list[tuple[str, str]] = []
    open_rows, open_columns = np.ones(len(left), bool), np.ones(len(right), bool)
    for first in range(len(left)):
        if not open_rows[first]:
            continue
        open_rows[first] = False
        rows = np.array([first])
        while len(rows):
            columns = np.flatnonzero(close[rows].any(axis=0) & open_columns)
            open_columns[columns] = False
            out += [(left[first], right[c]) for c in columns.tolist() if right[c] != left[first]]
            rows = np.flatnonzero(close[:, columns].any(axis=1) & open_rows)
            open_rows[rows] = False
            out += [(left[first], left[r]) for r in rows.tolist()]
    a, b = zip(*out) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})


def _least_labels(asking: pa.Table, asked: pa.Table, close: np.ndarray) -> pa.Table:
    """Of each asking point with a labelled neighbour the least label among them."""
    labels = asked["label"].to_numpy()
    order = np.argsort(labels, kind="stable")
    ranked = close[:, order]
    some = np.flatnonzero(ranked.any(axis=1))
    return pa.table({"point": asking["point"].take(pa.array(some)), "label": pa.array(labels[order[ranked[some].argmax(axis=1)]], pa.int64())})


def connected(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(point, root): the least point of each node's component. `links`: a, b; `nodes`: point.

    Alternating stars: links move to the least neighbour, first of the larger ends, then of the smaller; neighbours are never
    gathered. Each round is written out; about log(nodes) rounds.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = materialize(
            large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        # Done when every point but the roots has one link, to a root.
        ends = small.select(F.col("a").alias("p"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionAll(
            small.select(F.col("b").alias("p"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        open_ends = ends.groupBy("p").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 OR (up > 0 AND root > 0)")
        edges = small
        if open_ends.isEmpty():
            break
    return nodes.select("point").join(edges.select(F.col("a").alias("point"), F.col("b").alias("root")), "point", "left").select(
        "point", F.coalesce("root", "point").alias("root"))


def dealt_parts(members: DataFrame, block: int) -> tuple[DataFrame, int]:
    """`members` with `parts`, the blocks of their cell, and `part`, the block a member is in by hash; and the most parts of a cell."""
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    crowded = checked_broadcast(sizes.select("cell", F.ceil(F.col("n") / block).cast("long").alias("parts")))
    most = crowded.agg(F.max("parts")).first()[0] or 1
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    return members.join(crowded, "cell", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("point", F.lit(2)), "parts")), most


def _rounds(most: int) -> Iterator[tuple[int, int]]:
    """Parts asked in each round, as the first and the one after the last: one, then ROUND_GROWTH times more each time."""
    first, last = 0, 1
    while first < most:
        yield first, last
        first, last = last, last + ROUND_GROWTH * (last - first)


def _asked_round(asking: DataFrame, members: DataFrame, first: int, last: int, block: int, wide: int) -> DataFrame:
    """Units of the asking points against the members of the parts of a round."""
    sides = [d.select("cell", "point", "v", "weight") for d in (asking, members.where(F.col("part").between(first, last - 1)))]
    # A part holds about `block` points; it is not cut because of a few more.
    return unit_pairs(*sides, wide, wide if first else min(wide, 2 * block))


def core_points(members: DataFrame, most: int, radius: float, min_neighbours: int, block: int, wide: int) -> DataFrame:
    """(point): those with rows of `min_neighbours` within the radius. A point asks round by round until it has that many."""
    asking, found, short = members.where("home"), None, None
    for first, last in _rounds(most):
        near = _per_unit(_asked_round(asking, members, first, last, block, wide), _counts, "point string, near long", radius)
        near = (near if short is None else near.unionByName(short)).groupBy("point").agg(F.sum("near").alias("near"))
        near = materialize(near, "near")
        core, short = near.where(F.col("near") >= min_neighbours).select("point"), near.where(F.col("near") < min_neighbours)
        found = core if found is None else found.unionByName(core)
        if last < most:
            asking = materialize(asking.where(F.col("parts") > last).join(checked_broadcast(core), "point", "left_anti"), "asking")
            if asking.isEmpty():
                break
    return materialize(found, "core")


def core_roots(members: DataFrame, most: int, core: DataFrame, radius: float, block: int, wide: int) -> DataFrame:
    """(point, root): the component of each core point among links within the radius. `members`: the core ones.

    After the first round only points outside one component, the largest then, ask on. Two points of different components are
    never both in that one; the other one has asked all members of its cell.
    """
    asking, roots, anchor = members.where("home"), None, None
    for first, last in _rounds(most):
        links = _per_unit(_asked_round(asking, members, first, last, block, wide), _spanning_links, "a string, b string", radius)
        if roots is None:
            roots = materialize(connected(links, core), "roots")
            anchor = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").first()
        else:
            between = links.join(roots.toDF("a", "x"), "a").join(roots.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
            joined = connected(between, roots.select(F.col("root").alias("point")).distinct()).toDF("root", "to")
            roots = materialize(roots.join(checked_broadcast(joined), "root").select("point", F.col("to").alias("root")), "roots")
        if last < most:
            if anchor is None:
                break
            largest = roots.where(F.col("point") == anchor.root).select("root")
            rest = checked_broadcast(roots.join(F.broadcast(largest), "root", "left_anti").select("point"))
            asking = materialize(asking.where(F.col("parts") > last).join(rest, "point", "left_semi"), "asking")
            if asking.isEmpty():
                break
    return roots


def radius_cluster(
    df: DataFrame, id_column: str, vector: str, radius: float, min_neighbours: int = 10, min_cluster_size: int = 1,
    axes: int = 3, seed: int = 42, block: int = BLOCK_POINTS,
) -> DataFrame:
    """(id, cluster_id, is_core): density clusters of rows by Euclidean distance, noise -1.

    A row is core when `min_neighbours` rows, itself included, lie within `radius`. Core rows within `radius` of each other are
    in one cluster. Another row joins the cluster of a core row within its radius; where those are of several clusters, the
    one with the least id of a core row. Clusters of fewer than `min_cluster_size` rows become noise; the others are numbered
    from 0 by falling size, ties by that id. `axes`, `seed` and `block` set the cost, not the result.

    Null and empty vectors and those with null or non-finite entries are noise; vectors of different lengths are never
    neighbours; repeated rows and null ids are kept; an empty table gives no rows. Further columns are not read.
    """
    if radius <= 0 or min_neighbours < 1:
        raise ValueError("radius and min_neighbours must be positive")
    points = materialize(weighted_points(df, id_column, vector), "points")
    members = materialize(cell_members(points.select("point", "v", "weight"), radius, axes, seed), "cell-members")
    members, most = dealt_parts(members, block)
    longest = points.agg(F.max(F.size("v"))).first()[0] or 1
    wide = max(block, min(WIDE_BLOCKS * block, WIDE_VALUES // longest))
    core = core_points(members, most, radius, min_neighbours, block, wide)
    core_set = checked_broadcast(core)
    core_members = materialize(members.join(core_set, "point", "left_semi"), "core-members")
    roots = core_roots(core_members, most, core, radius, block, wide)
    weights = points.select("point", "weight", "first_id")
    clusters = roots.join(weights, "point").groupBy("root").agg(F.min("first_id").alias("first_id"))
    ranked = materialize(global_index(clusters, ["first_id", "root"], "label").select("root", "label"), "clusters")
    labels = materialize(roots.join(ranked, "root").select("point", "label"), "core-labels")
    columns = ["cell", "point", "v", "weight", "label"]
    others = materialize(members.where("home").join(core_set, "point", "left_anti").withColumn("label", F.lit(None).cast("long")).select(columns), "others")
    met = core_members.join(checked_broadcast(others.select("cell").distinct()), "cell", "left_semi")
    pairs = unit_pairs(others, met.join(labels, "point").select(columns), wide, wide)
    border = _per_unit(pairs, _least_labels, "point string, label long", radius).groupBy("point").agg(F.min("label").alias("label"))
    labelled = labels.withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))
    labelled = materialize(labelled.join(weights, "point"), "point-labels")
    sizes = labelled.groupBy("label").agg(F.sum("weight").alias("size")).where(F.col("size") >= min_cluster_size)
    numbered = global_index(sizes.withColumn("falling", -F.col("size")), ["falling", "label"], "number")
    final = labelled.join(numbered.select("label", F.col("number").cast("int").alias("cluster_id")), "label", "left").select(
        "point", "cluster_id", "is_core")
    rows = df.select(F.col(id_column), point_key(vector).alias("point"))
    return rows.join(checked_broadcast(final), "point", "left").select(
        id_column, F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
