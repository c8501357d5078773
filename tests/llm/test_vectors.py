import numpy as np
import pytest

from quarryline.llm import vectors

SCHEMA = "emb_id long, pros_emb array<float>, code string, id int, unit string"


def rows(groups, copies=0, singles=30, seed=1):
    rng = np.random.default_rng(seed)
    out, number = [], 1
    for size in groups:
        centre = rng.normal(size=64)
        for _ in range(size):
            out.append((number, centre + rng.normal(size=64) * 0.12))
            number += 1
    for _ in range(singles):
        out.append((number, rng.normal(size=64)))
        number += 1
    same = rng.normal(size=64)
    for _ in range(copies):
        out.append((number, same))
        number += 1
    return [(i, [float(x) for x in v * s], "x", 1, "y") for (i, v), s in zip(out, rng.uniform(0.2, 5, len(out)).repeat(1))]


def brute(data, k=5, radius=0.12):
    table = {}
    for i, v, *_ in data:
        if i is None or v is None or len(v) != 64 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        table[i] = np.asarray(v, dtype="float32").astype("float64")
    ids = np.array(sorted(table))
    units = np.array([table[i] / np.linalg.norm(table[i]) for i in ids])
    distance = np.round(1 - units @ units.T, 7)
    pairs, label = set(), np.arange(len(ids))
    for a in range(len(ids)):
        near = sorted((distance[a, b], ids[b]) for b in range(len(ids)) if b != a and distance[a, b] <= radius)
        pairs |= {(min(ids[a], b), max(ids[a], b)) for _, b in near[:k]}
        label[a] = min([a, *[b for b in range(len(ids)) if distance[a, b] <= radius]])
    groups = {}
    for a in range(len(ids)):
        groups.setdefault(label[a], []).append(ids[a])
    clusters = {(i, g[0]) for g in groups.values() if len(g) >= 3 for i in g}
    return {tuple(map(int, p)) for p in pairs}, {tuple(map(int, c)) for c in clusters}


DIRTY = [
    (None, [1.0] * 64, None, None, None),
    (9001, None, None, None, None),
    (9002, [], None, None, None),
    (9003, [1.0] * 63, None, None, None),
    (9004, [1.0] * 65, None, None, None),
    (9005, [0.0] * 64, None, None, None),
    (9006, [float("nan")] + [1.0] * 63, None, None, None),
    (9007, [float("inf")] + [1.0] * 63, None, None, None),
    (9008, [None] + [1.0] * 63, None, None, None),
]


@pytest.fixture(scope="module")
def data():
    found = rows([7, 3, 12, 2, 5])
    return found + found[:4] + DIRTY


def test_neighbours_match_brute_force(spark, data):
    want, _ = brute(data)
    got = {tuple(r) for r in vectors.neighbour_pairs(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == want


def test_clusters_match_brute_force(spark, data):
    _, want = brute(data)
    got = [tuple(r) for r in vectors.similarity_clusters(spark.createDataFrame(data, SCHEMA)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_small_cells_and_classes(spark):
    data = rows([40, 3, 9], singles=200, seed=5)
    want, clusters = brute(data)
    df = spark.createDataFrame(data, SCHEMA)
    found = {(min(r.id, r.neighbour), max(r.id, r.neighbour)) for r in vectors.nearest_neighbours(df, cell_rows=64, class_rows=20).collect()}
    assert len(found & want) >= 0.9 * len(want) and not {p for p in found if p[1] > 52}
    got = {tuple(r) for r in vectors.similarity_clusters(df, cell_rows=64).collect()}
    assert len(got & clusters) >= 0.9 * len(clusters)


def test_large_class_is_exact(spark):
    """A class above the limit, with noise in all dimensions, in many cells and blocks."""
    data = rows([1500, 4], singles=20, seed=7)
    data += [(5000 + i, v, *rest) for i, (_, v, *rest) in enumerate(data[:9] * 2)]
    want, _ = brute(data)
    df = spark.createDataFrame(data, SCHEMA)
    found = vectors.nearest_neighbours(df, cell_rows=128, class_rows=200, block_rows=400).collect()
    assert {(min(r.id, r.neighbour), max(r.id, r.neighbour)) for r in found} == want
    assert len(found) == len({(r.id, r.neighbour) for r in found})


def test_copies_of_one_vector(spark):
    """A third of the rows share one vector: ties go to the smaller id and nothing is lost."""
    data = [(i, [float(x) for x in v], *rest) for i, v, *rest in rows([4], singles=40, copies=0)]
    same = [float(x) for x in np.random.default_rng(9).normal(size=64)]
    data += [(1000 + i, same, "x", 1, "y") for i in range(25)]
    want, clusters = brute(data)
    df = spark.createDataFrame(data, SCHEMA)
    assert {tuple(r) for r in vectors.neighbour_pairs(df).collect()} == want
    assert {tuple(r) for r in vectors.similarity_clusters(df).collect()} == clusters


def test_report(spark):
    data = rows([6, 4], singles=5)
    found = {r.cluster_id: r for r in vectors.cluster_report(spark.createDataFrame(data, SCHEMA)).collect()}
    assert {k: r.cluster_size for k, r in found.items()} == {1: 6, 7: 4}
    units = {i: np.array(v) / np.linalg.norm(v) for i, v, *_ in data}
    centre = sum(units[i] for i in range(1, 7))
    assert found[1].medoid == max(range(1, 7), key=lambda i: units[i] @ centre) and len(found[1].typical) == 3


def test_empty_and_unusable(spark):
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(DIRTY, SCHEMA)):
        assert vectors.neighbour_pairs(df).count() == 0
        assert vectors.similarity_clusters(df).count() == 0
        assert vectors.cluster_report(df).count() == 0


def test_chi_square_quantile():
    assert abs(vectors.chi_square_quantile(0.99, 16) - 32.0) < 0.1
    assert abs(vectors.chi_square_quantile(0.95, 10) - 18.307) < 0.05


def test_nearest_search_against_brute_force(spark):
    pick = np.random.default_rng(5)
    centres = pick.normal(size=(12, 64))
    vectors_ = [centres[pick.integers(12)] + 0.4 * pick.normal(size=64) for _ in range(900)] + [pick.normal(size=64) for _ in range(100)]
    rows = [(int(i) * 5, [float(x) for x in v], "x") for i, v in enumerate(vectors_)]
    rows += [(7001 + i, rows[3][1], "x") for i in range(9)] + [(7100, [x * 2 for x in rows[3][1]], "x"), rows[4], (None, rows[5][1], "x"), (7200, None, "x"), (7300, [0.0] * 64, "x"), (7400, [1.0] * 63, "x"), (7500, [float("nan")] * 64, "x")]
    df = spark.createDataFrame(rows, "emb_id long, pros_emb array<float>, position string")
    good = {i: np.float32(v).astype("float64") for i, v, _ in rows if i is not None and v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    units = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    want = {}
    for at, i in enumerate(ids):
        if i % 100 == 0:
            order = sorted((round(1 - float(units[at] @ units[b]), 6), j) for b, j in enumerate(ids) if j != i)[:5]
            want[i] = order
    for cell_rows in (64, 1 << 15):
        got = {}
        for r in vectors.nearest_search(df, cell_rows=cell_rows).collect():
            got.setdefault(r.emb_id, []).append((r.position, round(abs(r.distance), 6), r.neighbour))
        assert set(got) == set(want) and all(sorted(p for p, _, _ in rows_) == [1, 2, 3, 4, 5] for rows_ in got.values())
        hits = sum(len({j for _, j in want[i]} & {j for _, _, j in got[i]}) for i in want)
        assert hits >= 0.99 * 5 * len(want)
    assert vectors.nearest_search(df.limit(0)).count() == 0
    assert vectors.nearest_search(df.where("emb_id in (0, 5)")).select("emb_id", "neighbour").collect() == [(0, 5)]


def test_cells_near_reach_what_is_near():
    pick = np.random.default_rng(2)
    points = pick.normal(size=(500, 64)).astype("float32")
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = vectors.fit_trees(points, 500, 8)[0]
    projected, cells = points @ vectors.projections()[0], vectors.cells_of(points, [tree])[0]
    q, c = vectors.cells_near(projected[:20], np.full(20, 6.0, "float32"), tree)
    reached = set(zip(q.tolist(), c.tolist()))
    assert len(reached) == len(q)
    for i in range(20):
        assert (i, int(cells[i])) in reached
        near = np.flatnonzero(((projected - projected[i]) ** 2).sum(axis=1) <= 5.9)
        assert {(i, int(x)) for x in cells[near]} <= reached


def test_links_of_a_dense_cell_need_little_memory():
    import tracemalloc

    points = np.random.default_rng(1).normal(size=64) + 1e-4 * np.random.default_rng(3).normal(size=(4000, 64))
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype("float32")
    tracemalloc.start()
    root, unsure = vectors.local_roots(4000, vectors.near_pairs(points, vectors.projections()[0], 0.126), 0.114)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (root == 0).all() and unsure.shape == (2, 0) and peak < 220e6


def test_links_near_the_radius_are_verified(spark):
    """Three vectors in a row at 0.1 and then just below or above 0.12 of the third."""
    rows, number = [], 0
    for k, far in enumerate((0.1155, 0.119, 0.1199, 0.1201, 0.121, 0.1245)):
        a, b, c = np.eye(64)[3 * k : 3 * k + 3]
        turn = lambda d, away: (1 - d) * a + np.sqrt(1 - (1 - d) ** 2) * away
        group = [a, a * 3 + 1e-4 * c, turn(0.05, -b), turn(far, b)]
        rows += [(number + i, [float(x) for x in v]) for i, v in enumerate(group)]
        number += 10
    rows.append((900, rows[3][1]))
    found = {r.emb_id: r.cluster_id for r in vectors.similarity_clusters(spark.createDataFrame(rows, "emb_id long, pros_emb array<float>"), least=2).collect()}
    assert {i for i in found if i % 10 == 3 and i < 900} == {3, 13, 23}
    assert all(found[i] == i // 10 * 10 for i in found if i < 900) and found[900] == 0 and len(found) == 22
