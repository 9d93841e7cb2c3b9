"""Density clusters by radius against a plain search over all pairs."""
import numpy as np
import pytest

from clustrum.operators import density


def brute(points, radius, least, smallest):
    """DBSCAN over all pairs; labels numbered as the operator does."""
    x = np.array(points, dtype=np.float64)
    close = ((x[:, None] - x[None]) ** 2).sum(-1) <= radius * radius
    core = close.sum(1) >= least
    group = {i: i for i in np.flatnonzero(core)}
    changed = True
    while changed:
        changed = False
        for i in group:
            best = min(group[j] for j in np.flatnonzero(close[i] & core))
            if best < group[i]:
                group[i], changed = best, True
    for i in np.flatnonzero(~core):
        if (near := close[i] & core).any():
            group[i] = min(group[j] for j in np.flatnonzero(near) if core[j])
    sizes = {}
    for label in group.values():
        sizes[label] = sizes.get(label, 0) + 1
    ranked = sorted((-n, label) for label, n in sizes.items() if n >= smallest)
    number = {label: k for k, (_, label) in enumerate(ranked)}
    return [number.get(group.get(i), -1) for i in range(len(points))], core.tolist()


def found(spark, points, *options, **more):
    frame = spark.createDataFrame([(i, [float(c) for c in p], 5, "c") for i, p in enumerate(points)], "id int, v array<double>, cell int, unit string")
    rows = sorted(density.radius_cluster(frame.repartition(3), "id", "v", *options, **more).collect())
    return [r.cluster_id for r in rows], [r.is_core for r in rows]


def blobs(seed, d, copies=60):
    """Groups, a chain, lonely points and many rows at one place; coordinates in quarters, so that distances are exact."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, 0.8, (50, d)) for c in (0, 6)] + [rng.uniform(-30, -10, (15, d))]
    chain = np.zeros((40, d))
    chain[:, 0] = np.linspace(12, 30, 40)
    points = np.round(np.concatenate([*parts, chain]) * 4) / 4 + 0.0
    return np.concatenate([points, np.tile(points[:1], (copies, 1))]).tolist()


@pytest.mark.parametrize("d,radius,block", [(1, 0.5, 2048), (2, 1.0, 2048), (2, 1.0, 16), (5, 2.0, 30)])
def test_equals_a_search_over_all_pairs(spark, d, radius, block):
    points = blobs(d, d)
    expected = brute(points, radius, 6, 8)
    assert found(spark, points, radius, 6, 8, block=block) == expected and len(set(expected[0])) > 2


def test_neighbours_on_the_radius_count_and_cells_do_not_matter(spark):
    grid = [(i, j) for i in range(12) for j in range(9)]
    expected = brute(grid, 1.0, 5, 1)
    assert sum(expected[1]) == 10 * 7
    for seed, axes in ((1, 1), (2, 2)):
        assert found(spark, grid, 1.0, 5, axes=axes, seed=seed, block=20) == expected


def test_one_place_with_most_rows_is_one_point(spark):
    points = [(0.0, 0.0)] * 400 + [(0.25, 0.0), (-0.0, 0.0), (9.0, 9.0)]
    labels, core = found(spark, points, 0.5, 10)
    assert labels == [0] * 402 + [-1] and core == [True] * 402 + [False]
    frame = spark.createDataFrame(list(enumerate(points)), "id int, v array<double>")
    assert {(r.weight, r.first_id) for r in density.weighted_points(frame, "id", "v").collect()} == {(401, 0), (1, 400), (1, 402)}


def test_a_crowded_cell_is_compared_in_many_units(spark):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(f"{i:032d}", x.tolist(), 1) for i, x in enumerate(rng.normal(0, 0.01, (500, 3)))], "point string, v array<double>, weight long")
    blocks = density.block_pairs(density.cell_members(points, 1.0, 2, 1), 50)
    sizes = [r["count"] for r in blocks.groupBy("unit").count().collect()]
    assert len(sizes) >= 100 and max(sizes) < 220


def test_what_is_moved_grows_with_the_rows(spark, monkeypatch):
    moved, per_unit = [], density._per_unit

    def counted(blocks, *rest):
        moved[-1] += blocks.count()
        return per_unit(blocks, *rest)

    monkeypatch.setattr(density, "_per_unit", counted)
    vectors = np.random.default_rng(3).normal(size=(1600, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    for n in (400, 1600):  # 25 and 100 blocks, all in one crowded place
        moved.append(0)
        labels, core = found(spark, vectors[:n], 1.2, 5, block=16)
        assert set(labels) == {0} and all(core)
    assert moved[1] < 6 * moved[0]


def test_clusters_that_grow_together_over_the_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    # One tight group, the largest at first; six chains that meet only link by link; a second group; lonely points.
    tight = np.round(rng.normal(0, 0.1, (40, 6)) * 8) / 8 + 3
    chains = np.concatenate([np.eye(6)[[i]] * np.arange(0, 6, 0.25)[:, None] for i in range(6)])
    points = np.concatenate([tight, chains, np.round(rng.normal(0, 0.1, (20, 6)) * 8) / 8 - 2, -4 * np.eye(6)]) + 0.0
    expected = brute(points, 0.5, 3, 1)
    assert len(set(expected[0])) == 4 and expected[0][40] == 0
    members = density.cell_members(spark.createDataFrame([(str(i), p.tolist(), 1) for i, p in enumerate(points)], "point string, v array<double>, weight long"), 9.0, 3, 1)
    assert {r.cell for r in members.collect()} == {"6|"} and members.where("home").count() == members.count() == len(points)
    monkeypatch.setattr(density, "spread_axes", lambda *_: {6: [False] * 3})
    assert found(spark, points, 0.5, 3, block=4) == expected


def test_unusable_rows_are_noise_and_nothing_gives_nothing(spark):
    rows = [(1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [1.0]), (6, [1.0, 0.0]), (None, [1.0]), (7, [float("inf")])]
    frame = spark.createDataFrame(rows, "id int, v array<double>")
    out = {(r.id, r.cluster_id) for r in density.radius_cluster(frame, "id", "v", 1.0, 2).collect()}
    assert out == {(1, -1), (2, -1), (3, -1), (4, -1), (5, 0), (6, -1), (None, 0), (7, -1)}
    assert density.radius_cluster(frame.limit(0), "id", "v", 1.0).count() == 0
    for bad in (dict(radius=0.0), dict(radius=1.0, min_neighbours=0)):
        with pytest.raises(ValueError):
            density.radius_cluster(frame, "id", "v", **bad)


def test_spanning_links_join_what_is_close():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for share in (0.0, 0.01, 0.03, 0.2, 1.0):
        close = rng.random((40, 55)) < share
        left, right = [f"p{i}" for i in range(40)], [f"p{i + 20}" for i in range(55)]
        links = density._spanning_links(pa.table({"point": left}), pa.table({"point": right}), close).to_pylist()
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        def groups(pairs):
            parent.clear()
            for a, b in pairs:
                parent[root(a)] = root(b)
            return {frozenset(y for y in parent if root(y) == root(x)) for x in parent if len({y for y in parent if root(y) == root(x)}) > 1}

        wanted = groups([(left[i], right[j]) for i, j in zip(*np.nonzero(close))])
        assert groups([(r["a"], r["b"]) for r in links]) == wanted and len(links) <= 95
