"""Groups of similar vectors and nearest neighbours over one spatial index.

The index: vectors are normalised and projected by several independent Gaussian
(2-stable) projections to a few dimensions.  In each projection a kd-tree, whose
split values come from a bounded sample, divides the space into cells of about
``CELL_ROWS`` vectors.  Vectors near a split of one projection lie inside a cell
of another, so the cells of the projections overlap; that is the margin.

A class too large for one block is first searched in the cells of one table, which bounds each
vector's k-th distance, and then block against block; only blocks and leaves that
the bounds exclude for certain are left out, so its neighbours are exact.

Within a cell the vectors are ordered by a second kd-tree over the projected
coordinates, leaf by leaf.  A leaf is verified against the other leaves in the
order of projected distance until a chi-square test says that, with probability
``CONFIDENCE``, no closer vector is left: for a pair at distance r the squared
projected distance over r^2 follows a chi-square law of ``DIMENSIONS`` degrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quarryline.llm.components import frontier_components
from quarryline.plans.lineage import cut, width

WIDTH = 64
RADIUS = 0.12
NEIGHBOURS = 5
TABLES = 6
DIMENSIONS = 16
CELL_ROWS = 4096
LEAF_ROWS = 512
#: The kd-trees are fitted on about this many vectors at most; every vector is indexed.
SAMPLE_ROWS = 60_000
CONFIDENCE = 0.999
#: 8-bit components leave an error of about 0.001 in a cosine; links this near the radius are verified with whole vectors.
SLACK = 0.006
#: Distances are compared to nine decimals; a bound reaches a little further.
ROUNDING = 2e-9
#: A class of more distinct vectors than this is searched block against block instead of as one block.
CLASS_ROWS = 6000
#: About so many vectors of such a class make a block.
BLOCK_ROWS = 1 << 15


def chi_square_quantile(p: float, degrees: int) -> float:
    """Wilson and Hilferty's approximation of the chi-square quantile."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return degrees * (1 - 2 / (9 * degrees) + z * (2 / (9 * degrees)) ** 0.5) ** 3


def projections(tables: int = TABLES, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The fixed Gaussian matrices, one of WIDTH x dimensions for each table."""
    return np.random.default_rng(20250101).normal(size=(tables, WIDTH, dimensions)).astype("float32")


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are usable vectors, and these vectors as float64.

    Usable: WIDTH components, all finite and not null, not all zero.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == WIDTH)
    if not len(rows):
        return rows, np.zeros((0, WIDTH))
    flat = column.take(pa.array(rows)).flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), dtype="float64").reshape(-1, WIDTH)
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return rows[good], values[good]


def unit(values: np.ndarray) -> np.ndarray:
    """Vectors of length one, safe against overflow of the squares."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def quantised(units: np.ndarray) -> np.ndarray:
    """Unit vectors as signed bytes, scaled to each vector's largest component."""
    return np.rint(units * (127 / np.abs(units).max(axis=1, keepdims=True))).astype("int8")


def restored(codes: pa.Array) -> np.ndarray:
    """Quantised vectors as float32 unit vectors."""
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    raw = np.frombuffer(codes.buffers()[2], dtype="int8", offset=0)
    offsets = np.frombuffer(codes.buffers()[1], dtype="int32")[codes.offset : codes.offset + len(codes) + 1]
    values = raw[offsets[0] : offsets[-1]].reshape(-1, WIDTH).astype("float32")
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize if len(rows) else 0
    offsets = np.arange(len(rows) + 1, dtype="int32") * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _hash(rows: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in np.ascontiguousarray(rows)], dtype="uint64").view("int64")


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, values = usable(batch.column(1))
        ids = batch.column(0).take(pa.array(rows))
        codes = quantised(unit(values)) if len(rows) else np.zeros((0, WIDTH), "int8")
        yield pa.RecordBatch.from_arrays([ids, pa.array(_hash(codes), pa.int64()), _binary(codes)], ["id", "code_key", "code"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, values = usable(batch.column(1))
        ids = batch.column(0).take(pa.array(rows))
        units = unit(values) if len(rows) else np.zeros((0, WIDTH))
        code_keys = _hash(quantised(units)) if len(rows) else np.zeros(0, "int64")
        single = units.astype("float32")
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(code_keys, pa.int64()), pa.array(_hash(single), pa.int64()), _binary(single)], ["id", "code_key", "unit_key", "unit"]
        )


def fit_trees(sample: np.ndarray, rows: int, cell_rows: int) -> list[list[np.ndarray]]:
    """For each table the split values of a kd-tree, level by level.

    Level d splits on projected coordinate d modulo their number, at the median
    of the sample in each node.  The depth follows the number of rows.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, rows / cell_rows)))))
    trees = []
    for matrix in projections():
        points, nodes, levels = sample @ matrix, np.zeros(len(sample), "int64"), []
        for level in range(depth):
            x, splits = points[:, level % DIMENSIONS], np.zeros(1 << level, "float32")
            order = np.argsort(nodes, kind="stable")
            starts = np.searchsorted(nodes[order], np.arange((1 << level) + 1))
            for node in range(1 << level):
                own = x[order[starts[node] : starts[node + 1]]]
                splits[node] = np.median(own) if len(own) else 0.0
            levels.append(splits)
            nodes = nodes * 2 + (x > splits[nodes])
        trees.append(levels)
    return trees


def cells_of(units: np.ndarray, trees: list[list[np.ndarray]]) -> np.ndarray:
    """The cell of every vector in each table, tables x rows."""
    out = np.zeros((len(trees), len(units)), "int64")
    for t, (matrix, levels) in enumerate(zip(projections(len(trees)), trees)):
        points = units @ matrix
        for level, splits in enumerate(levels):
            out[t] = out[t] * 2 + (points[:, level % DIMENSIONS] > splits[out[t]])
    return out


def leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Leaves of a kd-tree over ``points``, halved at the widest coordinate until small enough."""
    todo, done = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        x = points[rows]
        x = x[:, np.argmax(x.max(axis=0) - x.min(axis=0))]
        order = np.argpartition(x, len(x) // 2)
        todo += [rows[order[: len(x) // 2]], rows[order[len(x) // 2 :]]]
    return done


def near_pairs(units: np.ndarray, matrix: np.ndarray, radius: float, k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (query, other, cosine distance) within ``radius`` in one cell, a leaf of queries at a time.

    Other leaves come in the order of projected distance.  A query leaves off as
    soon as the squared projected distance of the next leaf exceeds the chi-square
    quantile times its bound: the radius, or its k-th best distance when ``k`` is given.
    """
    points = units @ matrix
    parts = leaves(points, LEAF_ROWS)
    low = np.array([points[p].min(axis=0) for p in parts])
    high = np.array([points[p].max(axis=0) for p in parts])
    quantile = chi_square_quantile(CONFIDENCE, matrix.shape[1])
    for number, part in enumerate(parts):
        mine = points[part]
        gaps = np.maximum(0, np.maximum(low[None] - mine[:, None], mine[:, None] - high[None]))
        gaps = np.einsum("qld,qld->ql", gaps, gaps)
        bound, best = np.full(len(part), 2 * radius), np.full((len(part), (k or 0) + 1), np.inf)
        found_q, found_o, found_d = [], [], []
        for leaf in np.argsort(gaps.min(axis=0), kind="stable"):
            # links are symmetric, so without k one of the two directions is enough
            active = np.flatnonzero(gaps[:, leaf] <= quantile * bound) if k or leaf >= number else ()
            if not len(active):
                continue
            distance = 1 - units[part[active]] @ units[parts[leaf]].T
            near = distance <= radius
            if near.any():
                q, o = np.nonzero(near)
                found_q.append(part[active[q]])
                found_o.append(parts[leaf][o])
                found_d.append(distance[q, o])
            if k:
                best[active] = np.partition(np.concatenate([best[active], distance], axis=1), k, axis=1)[:, : k + 1]
                bound = np.minimum(2 * radius, 2 * np.maximum(best[:, k], 0))
        if found_q:
            yield np.concatenate(found_q), np.concatenate(found_o), np.concatenate(found_d)


def contraction() -> np.ndarray:
    """An orthonormal projection: projected distances never exceed the true ones."""
    return np.linalg.qr(projections()[0].astype("float64"))[0]


def cross_pairs(
    units: np.ndarray, bounds: np.ndarray, others: np.ndarray, other_bounds: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (row, other, cosine distance) of two blocks that lie within the bound of either vector.

    A pair of leaves is left out only where their boxes are further apart than any bound allows.
    """
    matrix = contraction()
    sides = []
    for block, limits in ((units, bounds), (others, other_bounds)):
        points = block @ matrix
        parts = leaves(points, LEAF_ROWS)
        sides.append([(p, points[p].min(axis=0), points[p].max(axis=0), limits[p].max()) for p in parts])
    for mine, low, high, limit in sides[0]:
        found_q, found_o, found_d = [], [], []
        for theirs, other_low, other_high, other_limit in sides[1]:
            gap = np.maximum(0, np.maximum(other_low - high, low - other_high))
            if gap @ gap > 2 * max(limit, other_limit) + ROUNDING:
                continue
            distance = 1 - units[mine] @ others[theirs].T
            q, o = np.nonzero(distance <= np.maximum(bounds[mine][:, None], other_bounds[theirs][None]) + ROUNDING)
            found_q.append(mine[q])
            found_o.append(theirs[o])
            found_d.append(distance[q, o])
        if found_q:
            yield np.concatenate(found_q), np.concatenate(found_o), np.concatenate(found_d)


def nearest_ids(q: np.ndarray, o: np.ndarray, dist: np.ndarray, own: list, theirs: list, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest other ids (id, neighbour, distance) of each id of the vectors ``q`` among those of their pairs."""
    order = np.lexsort((dist, q))
    q, o, dist = q[order], o[order], dist[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else ()
    for s, e in zip(starts, np.r_[starts[1:], len(q)]):
        cut_at = dist[min(s + k, e - 1)]
        pool = sorted((dist[x], i) for x in range(s, e) if dist[x] <= cut_at for i in theirs[o[x]])
        for me in own[q[s]]:
            taken = 0
            for x, i in pool:
                if i != me:
                    yield me, i, x
                    taken += 1
                    if taken == k:
                        break


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Smallest linked index of each index: components of the links of at most ``sure``; and the further links between them, 2 x links.

    The links of one leaf at a time are joined and let go, so memory stays in
    proportion to the cell, also where all its vectors are near each other.
    """
    root, unsure = np.arange(n), [np.zeros((2, 0), "int64")]
    for q, o, d in pairs:
        further = d > sure
        a, b = q[further], o[further]
        q, o = q[~further], o[~further]
        while True:
            apart = root[q] != root[o]
            if not apart.any():
                break
            q, o = q[apart], o[apart]
            np.minimum.at(root, np.maximum(root[q], root[o]), np.minimum(root[q], root[o]))
            while (root != root[root]).any():
                root = root[root]
        still = root[a] != root[b]
        unsure.append(np.stack([np.minimum(a, b)[still], np.maximum(a, b)[still]]))
    links = np.unique(np.concatenate(unsure, axis=1), axis=1)
    return root, links[:, root[links[0]] != root[links[1]]]


class SimilarityIndex:
    """Similarity classes of a table's usable vectors: components of the links of at most ``radius``.

    ``ids`` and ``vectors`` name the columns; all other columns are ignored, also
    those with names used here.  Rows with a null id or without a usable vector
    take no part.  A repeated id counts once; its deliveries bear the same vector.
    """

    def __init__(self, df: DataFrame, ids: str, vectors: str, radius: float = RADIUS, cell_rows: int = CELL_ROWS):
        self.spark, self.radius, self.cell_rows = df.sparkSession, radius, cell_rows
        self.rows = df.select(F.col(ids).cast("long").alias("id"), F.col(vectors).cast("array<float>").alias("vector")).where("id is not null")
        codes = self.rows.mapInArrow(_codes, "id long, code_key long, code binary")
        # copies of one vector become one row, before any row meets another
        self.distinct = cut(codes.groupBy("code_key").agg(F.min("id").alias("rep"), F.first("code").alias("code"), (F.max("id") > F.min("id")).alias("copied")))
        self.trees = self._fit()

    def _fit(self) -> list[list[np.ndarray]]:
        self.size = rows = self.distinct.count()
        share = min(1.0, SAMPLE_ROWS / max(1, rows))
        # the sample is bounded by SAMPLE_ROWS; it only places the splits
        sample = self.distinct.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("code").toArrow()
        units = restored(sample.column(0)) if sample.num_rows else np.zeros((0, WIDTH), "float32")
        return fit_trees(units, rows, self.cell_rows)

    @cached_property
    def classes(self) -> DataFrame:
        """``code_key, class`` of every vector that has a neighbour or a copy."""
        trees, radius, matrices = self.trees, self.radius, projections()

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                cells = cells_of(restored(batch.column(1)), trees)
                for t in range(len(trees)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(batch.num_rows, t, "int32")), pa.array(cells[t]), batch.column(0), batch.column(1)], ["t", "cell", "key", "code"]
                    )

        def local(key: tuple, cell: pa.Table) -> pa.Table:
            keys = cell.column("key").to_numpy()
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            units = restored(cell.column("code").combine_chunks().take(pa.array(order)))
            root, open_ = local_roots(len(keys), near_pairs(units, matrices[key[0].as_py()], radius + SLACK), radius - SLACK)
            linked = root != np.arange(len(keys))
            src, dst = np.r_[keys[linked], keys[open_[0]]], np.r_[keys[root[linked]], keys[open_[1]]]
            return pa.table({"src": src, "dst": dst, "sure": np.r_[np.ones(linked.sum(), bool), np.zeros(len(open_[0]), bool)]})

        n = self.width()
        links = cut(
            self.distinct.select("code_key", "code")
            .mapInArrow(spread, "t int, cell long, key long, code binary")
            .repartition(n, "t", "cell")
            .groupBy("t", "cell")
            .applyInArrow(local, "src long, dst long, sure boolean")
        )
        alone = self.distinct.where("copied").select(F.col("code_key").alias("src"), F.col("code_key").alias("dst"))
        found = cut(frontier_components(links.where("sure").select("src", "dst").union(alone)).select(F.col("node").alias("code_key"), F.col("component").alias("class")))
        return self._verified(found, links.where("not sure").select("src", "dst").distinct())

    def _verified(self, found: DataFrame, unsure: DataFrame) -> DataFrame:
        """The classes joined by the links near the radius that hold for the whole vectors."""
        label = lambda side: found.select(F.col("code_key").alias(side), F.col("class").alias(f"{side}_class"))
        apart = unsure.join(label("src"), "src", "left").join(label("dst"), "dst", "left")
        apart = apart.select("src", "dst", *[F.coalesce(f"{side}_class", side).alias(f"{side}_class") for side in ("src", "dst")])
        # most of these links are inside a class already
        apart = cut(apart.where("src_class != dst_class"))
        if apart.isEmpty():
            return found
        units = self.rows.mapInArrow(_units, "id long, code_key long, unit_key long, unit binary")
        asked = apart.select(F.explode(F.array("src", "dst")).alias("code_key")).distinct()
        units = cut(units.join(asked, "code_key", "left_semi").groupBy("code_key", "unit_key").agg(F.first("unit").alias("unit")))
        side = lambda name: units.select(F.col("code_key").alias(name), F.col("unit").alias(f"{name}_unit"))
        radius = self.radius

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    a, b = (_floats(pa.chunked_array([batch.column(c)])) for c in (4, 5))
                    near = np.round(1 - (a * b).sum(axis=1), 9) <= radius
                    yield batch.filter(pa.array(near)).select(["src", "dst", "src_class", "dst_class"])

        met = apart.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "src_class", "dst_class", "src_unit", "dst_unit")
        held = cut(met.mapInArrow(verify, "src long, dst long, src_class long, dst_class long").distinct())
        merged = frontier_components(held.select("src_class", "dst_class"), "src_class", "dst_class").toDF("class", "whole")
        # a vector without a sure link is in no class yet
        ends = held.select(F.explode(F.array(F.struct(F.col("src").alias("code_key"), F.col("src_class").alias("class")), F.struct(F.col("dst").alias("code_key"), F.col("dst_class").alias("class")))).alias("x")).select("x.*")
        return cut(found.union(ends).distinct().join(merged, "class", "left").select("code_key", F.coalesce("whole", "class").alias("class")))

    def width(self) -> int:
        """Partitions for work on all cells: some sixteen cells each, and no fewer than the session's width."""
        return max(width(self.spark), TABLES * self.size // (16 * self.cell_rows))

    def members(self) -> DataFrame:
        """``id, code_key, unit_key, unit, class`` of all rows in a class, each id once for each vector."""
        units = self.rows.mapInArrow(_units, "id long, code_key long, unit_key long, unit binary")
        return units.join(self.classes, "code_key")


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    column = pa.concat_arrays([column]) if column.offset else column
    raw = np.frombuffer(column.buffers()[2], dtype="float32")
    first = np.frombuffer(column.buffers()[1], dtype="int32")[0] // 4
    return raw[first : first + len(column) * WIDTH].reshape(-1, WIDTH).astype("float64")


def distinct_units(index: SimilarityIndex, smallest: int) -> DataFrame:
    """Distinct vectors of the classes, each with its ``smallest`` smallest ids and the number of its ids.

    The window keeps the first ids only, and Spark applies that limit before the
    shuffle, so a vector that a third of all rows share stays small.
    """
    members = index.members()
    first = Window.partitionBy("unit_key").orderBy("id")
    ranked = members.select("unit_key", "class", "id", "unit").withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= smallest)
    return ranked.groupBy("unit_key", "class").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("unit").alias("unit"))


_PAIRS = "id long, neighbour long, distance double"


def _pairs(rows: list[tuple[int, int, float]]) -> pa.Table:
    a, b, d = zip(*rows) if rows else ((), (), ())
    return pa.table({"id": pa.array(a, pa.int64()), "neighbour": pa.array(b, pa.int64()), "distance": pa.array(d, pa.float64())})


def _blocks(index: SimilarityIndex, large: DataFrame, first: DataFrame, k: int, block_rows: int) -> DataFrame:
    """``class, block, ids, unit, bound`` of the vectors of large classes.

    Blocks follow the cells of the first table, so near vectors share one; places
    within a cell are dealt by hash, so a block stays near ``block_rows`` whatever
    the cell holds.  ``bound`` is the k-th distance in ``first``, else the radius.
    """
    trees = index.trees[:1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = cells_of(_floats(pa.chunked_array([batch.column(3)])).astype("float32"), trees)[0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    placed = large.select("unit_key", "class", "ids", "unit").mapInArrow(place, "unit_key long, class long, ids array<long>, unit binary, cell long")
    rank = Window.partitionBy("id").orderBy("distance", "neighbour")
    best = first.groupBy("id", "neighbour").agg(F.min("distance").alias("distance")).withColumn("n", F.row_number().over(rank))
    kth = best.where(F.col("n") == k).select("id", "distance")
    owners = large.select("unit_key", F.explode("ids").alias("id")).join(kth, "id", "left")
    bounds = owners.groupBy("unit_key").agg(F.max(F.coalesce("distance", F.lit(index.radius))).alias("bound"))
    cells = placed.groupBy("class", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    position = F.col("start") + F.pmod(F.xxhash64("unit_key"), F.col("n"))
    return placed.join(cells, ["class", "cell"]).join(bounds, "unit_key").select("class", F.floor(position / block_rows).alias("block"), "ids", "unit", "bound")


def _exact(index: SimilarityIndex, large: DataFrame, first: DataFrame, k: int, block_rows: int) -> DataFrame:
    """All pairs of ids in large classes that may be among the k nearest, given the distances in ``first``."""
    blocks = cut(_blocks(index, large, first, k, block_rows))
    matrix = contraction()

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = pd.DataFrame(_floats(pa.chunked_array([batch.column(2)])) @ matrix)
            keys = [batch.column(0).to_numpy(), batch.column(1).to_numpy()]
            low, high = points.groupby(keys).min(), points.groupby(keys).max()
            bound = pd.Series(batch.column(3).to_numpy()).groupby(keys).max()
            floats = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(low.index.get_level_values(0)), pa.array(low.index.get_level_values(1)), pa.array(list(low.to_numpy()), floats), pa.array(list(high.to_numpy()), floats), pa.array(bound.to_numpy())],
                ["class", "block", "low", "high", "bound"],
            )

    boxes = blocks.select("class", "block", "unit", "bound").mapInArrow(corners, "class long, block long, low array<double>, high array<double>, bound double")
    merged = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(DIMENSIONS)]).alias(c)
    boxes = boxes.groupBy("class", "block").agg(merged(F.min, "low"), merged(F.max, "high"), F.max("bound").alias("bound"))
    a, b = (boxes.select("class", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "low", "high", "bound")]) for side in "ab")
    gap = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda total, x: total + x * x) <= 2 * F.greatest("bound_a", "bound_b") + ROUNDING
    pairs = cut(a.join(b, "class").where(F.col("block_a") <= F.col("block_b")).where(near).select("class", "block_a", "block_b"))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        units, others = _floats(left.column("unit")), _floats(right.column("unit"))
        bounds, other_bounds = left.column("bound").to_numpy(), right.column("bound").to_numpy()
        own, theirs = left.column("ids").to_pylist(), right.column("ids").to_pylist()
        same = key[1] == key[2]
        if same:
            others, other_bounds, theirs = units, bounds, own
        back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, o, dist in cross_pairs(units, bounds, others, other_bounds):
            dist = np.where(q == o, 0.0, np.round(dist, 9)) if same else np.round(dist, 9)
            mine, other = dist <= bounds[q] + ROUNDING, dist <= other_bounds[o] + ROUNDING
            rows += nearest_ids(q[mine], o[mine], dist[mine], own, theirs, k)
            if not same:
                back.append((o[other], q[other], dist[other]))
        if back:
            rows += nearest_ids(*map(np.concatenate, zip(*back)), theirs, own, k)
        return _pairs(rows)

    keys, n = ("class", "block_a", "block_b"), max(index.width(), pairs.count())

    def side(block: str) -> DataFrame:
        # columns under names of their own, as both sides come from the same two tables
        rows = pairs.join(blocks.withColumnRenamed("block", block), ["class", block])
        rows = rows.select(*[F.col(c).alias(f"{c}_of_{block}") for c in keys], *[F.col(c).alias(c) for c in ("ids", "unit", "bound")])
        return rows.repartition(n, *[f"{c}_of_{block}" for c in keys])

    sides = [side(b).groupBy(*[f"{c}_of_{b}" for c in keys]) for b in keys[1:]]
    return sides[0].cogroup(sides[1]).applyInArrow(meet, _PAIRS)


def nearest_neighbours(
    df: DataFrame, ids: str = "emb_id", vectors: str = "pros_emb", k: int = NEIGHBOURS, radius: float = RADIUS, cell_rows: int = CELL_ROWS, class_rows: int = CLASS_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest other ids of every id, as ``id, neighbour, distance``, within ``radius`` of cosine distance.

    Ties go to the smaller id; distances are compared to nine decimals.  A null id
    or a vector that isn't usable has no neighbours and is nobody's neighbour; an
    id without another within the radius has no row; an empty table gives none.
    """
    index = SimilarityIndex(df, ids, vectors, radius, cell_rows)
    matrices, trees = projections(), index.trees[:1]
    vectors_ = cut(distinct_units(index, k + 1))
    sizes = vectors_.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    sized = vectors_.join(sizes, "class")
    small = sized.where(F.col("size") <= class_rows).select(F.lit(-1).alias("t"), F.col("class").alias("cell"), "ids", "unit")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = cells_of(_floats(pa.chunked_array([batch.column(1)])).astype("float32"), trees)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, "int32")), pa.array(cells[0]), batch.column(0), batch.column(1)], ["t", "cell", "ids", "unit"])

    def search(key: tuple, block: pa.Table) -> pa.Table:
        units, own = _floats(block.column("unit")), block.column("ids").to_pylist()
        matrix = matrices[max(0, key[0].as_py())].astype("float64")
        rows = []
        for q, o, dist in near_pairs(units, matrix, radius, k):
            rows += nearest_ids(q, o, np.where(q == o, 0.0, np.round(dist, 9)), own, own, k)
        return _pairs(rows)

    def searched(parts: DataFrame) -> DataFrame:
        return parts.repartition(index.width(), "t", "cell").groupBy("t", "cell").applyInArrow(search, _PAIRS)

    found = searched(small)
    large = sized.where(F.col("size") > class_rows)
    if not sizes.where(F.col("size") > class_rows).isEmpty():
        # a first search in the cells of one table bounds the k-th distances for the exact one
        first = cut(searched(large.select("ids", "unit").mapInArrow(spread, "t int, cell long, ids array<long>, unit binary")))
        found = found.union(first).union(_exact(index, large, first, k, block_rows))
    # ids beyond the first k + 1 of a shared vector: their neighbours are its first k ids
    shared = vectors_.where(F.size("ids") > k).select("unit_key", F.slice("ids", 1, k).alias("first"), F.col("ids")[k].alias("last"))
    rest = index.members().select("id", "unit_key").join(shared, "unit_key").where(F.col("id") > F.col("last"))
    rest = rest.select("id", F.explode("first").alias("neighbour"), F.lit(0.0).alias("distance"))
    rank = Window.partitionBy("id").orderBy("distance", "neighbour")
    best = found.union(rest).groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
    return best.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k).drop("n")


def neighbour_pairs(df: DataFrame, ids: str = "emb_id", vectors: str = "pros_emb") -> DataFrame:
    """Unordered pairs, smaller id first, where one is among the other's nearest: ``emb_id_a, emb_id_b``."""
    found = nearest_neighbours(df, ids, vectors)
    return found.select(F.least("id", "neighbour").alias("emb_id_a"), F.greatest("id", "neighbour").alias("emb_id_b")).distinct()


#: Queries of a search that meet one block of rows at once.
QUERY_ROWS = 1 << 13
#: Distances of a search are compared to six decimals.
COMPARED = 6


def cells_near(points: np.ndarray, reach: np.ndarray, levels: list[np.ndarray], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a kd-tree no further than ``reach`` (squared, projected) from each point: point, cell."""
    found_q, found_c = [], []
    step = max(1, chunk >> len(levels))
    for at in range(0, len(points), step):
        x, far = points[at : at + step], reach[at : at + step]
        query, node = np.arange(len(x)), np.zeros(len(x), "int64")
        gaps = np.zeros((len(x), points.shape[1]), "float32")
        for level, splits in enumerate(levels):
            axis = level % points.shape[1]
            off = x[query, axis] - splits[node]
            sides = []
            for side in (0, 1):
                beyond = np.maximum(gaps[:, axis], np.maximum(0, off if side == 0 else -off))
                total = (gaps * gaps).sum(axis=1) - gaps[:, axis] ** 2 + beyond**2
                keep = np.flatnonzero(total <= far[query])
                moved = gaps[keep]
                moved[:, axis] = beyond[keep]
                sides.append((query[keep], node[keep] * 2 + side, moved))
            query, node, gaps = (np.concatenate(parts) for parts in zip(*sides))
        found_q.append(query + at)
        found_c.append(node)
    return (np.concatenate(found_q), np.concatenate(found_c)) if found_q else (np.zeros(0, "int64"), np.zeros(0, "int64"))


def nearest_search(df: DataFrame, ids: str = "emb_id", vectors: str = "pros_emb", k: int = NEIGHBOURS, every: int = 100, cell_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest other ids, at any distance, of every id divisible by ``every``: ``emb_id, position, neighbour, distance``.

    All rows are searched.  A query is verified in the cell of its own vector first;
    its k-th distance there tells, by the chi-square test, in which other cells of the
    tree a nearer vector may lie, and these are verified too.  Distances are compared
    to six decimals, ties go to the smaller id.  A null id, or a vector that isn't
    usable, is no query and nobody's neighbour; with fewer than k other ids there are
    fewer rows, and an empty table gives none.
    """
    index = SimilarityIndex(df, ids, vectors, cell_rows=cell_rows)
    levels, matrix = index.trees[0], projections()[0]
    units = index.rows.mapInArrow(_units, "id long, code_key long, unit_key long, unit binary")
    # of a vector that many ids share the first k + 1 are enough; Spark limits them before the shuffle
    first = Window.partitionBy("unit_key").orderBy("id")
    ranked = units.select("unit_key", "id", "unit").withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    rows = ranked.groupBy("unit_key").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("unit").alias("unit"))
    queries = units.where(F.col("id") % every == 0).groupBy("id").agg(F.min("unit").alias("unit"))
    blocks = 1 + index.rows.where(F.col("id") % every == 0).count() // QUERY_ROWS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = cells_of(_floats(pa.chunked_array([batch.column(1)])).astype("float32"), [levels])[0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    rows = cut(rows.select("ids", "unit").mapInArrow(place, "ids array<long>, unit binary, cell long"))
    queries = cut(queries.select("id", "unit").mapInArrow(place, "id long, unit binary, cell long").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))
    every_part = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        others, theirs = _floats(right.column("unit")), right.column("ids").to_pylist()
        mine, own = _floats(left.column("unit")), left.column("id").to_pylist()
        for at in range(0, len(mine) if len(others) else 0, 256):
            distance = np.round(1 - mine[at : at + 256] @ others.T, COMPARED)
            kth = np.partition(distance, min(k, len(others) - 1), axis=1)[:, min(k, len(others) - 1)]
            q, o = np.nonzero(distance <= kth[:, None])
            out += nearest_ids(q, o, distance[q, o], [[i] for i in own[at : at + 256]], theirs, k)
        return _pairs(out)

    def search(asked: DataFrame) -> DataFrame:
        n = max(width(index.spark), blocks * (1 + index.size // cell_rows))
        sides = [asked.repartition(n, "cell", "part").groupBy("cell", "part"), rows.select("ids", "unit", "cell", every_part).repartition(n, "cell", "part").groupBy("cell", "part")]
        return sides[0].cogroup(sides[1]).applyInArrow(meet, _PAIRS)

    rank = Window.partitionBy("id").orderBy("distance", "neighbour")
    best = lambda found: found.groupBy("id", "neighbour").agg(F.min("distance").alias("distance")).withColumn("position", F.row_number().over(rank)).where(F.col("position") <= k)
    own = cut(best(search(queries)))
    quantile = chi_square_quantile(CONFIDENCE, DIMENSIONS)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _floats(pa.chunked_array([batch.column(1)])).astype("float32") @ matrix
                reach = quantile * 2 * (np.asarray(batch.column(4).fill_null(2.0)) + 10.0**-COMPARED)
                q, cell = cells_near(points, reach.astype("float32"), levels)
                other = cell != batch.column(2).to_numpy()[q]
                q, cell = q[other], cell[other]
                taken = batch.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(cell), taken.column(3)], ["id", "unit", "cell", "part"])

    bounds = own.where(F.col("position") == k).select("id", F.col("distance").alias("bound"))
    routed = queries.join(bounds, "id", "left").select("id", "unit", "cell", "part", "bound").mapInArrow(route, "id long, unit binary, cell long, part int")
    found = best(own.select("id", "neighbour", "distance").union(search(routed)))
    return found.select(F.col("id").alias("emb_id"), "position", "neighbour", "distance")


def similarity_clusters(df: DataFrame, ids: str = "emb_id", vectors: str = "pros_emb", radius: float = RADIUS, least: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Members of the clusters, as ``emb_id, cluster_id``.

    A cluster is a density-connected class of at least ``least`` different ids
    (every member is a core point, as the class's members lie within ``radius`` of
    each other); ``cluster_id`` is its smallest id.  Copies of one vector are
    members.  Null ids and unusable vectors belong to no cluster.
    """
    index = SimilarityIndex(df, ids, vectors, radius, cell_rows)
    codes = index.rows.mapInArrow(_codes, "id long, code_key long, code binary").select("id", "code_key")
    members = cut(codes.join(index.classes, "code_key").select("id", "class").distinct())
    sizes = members.groupBy("class").agg(F.min("id").alias("cluster_id"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return members.join(sizes, "class").select(F.col("id").alias("emb_id"), "cluster_id")


def cluster_report(df: DataFrame, ids: str = "emb_id", vectors: str = "pros_emb", typical: int = 3) -> DataFrame:
    """Size and most typical members of each cluster: ``cluster_id, cluster_size, medoid, typical``.

    The medoid is the member nearest the centroid of the unit vectors, the smallest
    id on ties; ``typical`` holds the first ``typical`` members in that order.  Sums
    are taken per component before the shuffle, so a cluster of any size is never
    in one task.
    """
    clusters = cut(similarity_clusters(df, ids, vectors))
    rows = df.select(F.col(ids).cast("long").alias("emb_id"), F.col(vectors).cast("array<float>").alias("vector")).where(F.col(ids).isNotNull())
    units = rows.mapInArrow(_units, "id long, code_key long, unit_key long, unit binary")
    rank_one = units.groupBy("id").agg(F.first("unit").alias("unit")).join(clusters, units["id"] == clusters["emb_id"]).select("emb_id", "cluster_id", "unit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = pd.DataFrame(_floats(pa.chunked_array([batch.column(1)])))
            total = frame.groupby(batch.column(0).to_numpy()).sum()
            counts = frame.groupby(batch.column(0).to_numpy()).size()
            yield pa.RecordBatch.from_arrays([pa.array(total.index.to_numpy("int64")), pa.array(counts.to_numpy("int64")), pa.array(list(total.to_numpy()), pa.list_(pa.float64()))], ["cluster_id", "n", "total"])

    partial = rank_one.select("cluster_id", "unit").mapInArrow(sums, "cluster_id long, n long, total array<double>")
    parts = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(WIDTH)]
    centres = partial.groupBy("cluster_id").agg(F.sum("n").alias("cluster_size"), *parts)
    centres = centres.select("cluster_id", "cluster_size", F.array(*[f"s{i}" for i in range(WIDTH)]).alias("centre"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units_, centre = _floats(pa.chunked_array([batch.column(3)])), np.asarray(batch.column(4).flatten()).reshape(-1, WIDTH)
                norm = np.maximum(np.sqrt((centre * centre).sum(axis=1)), 1e-300)
                far = np.round(1 - (units_ * centre).sum(axis=1) / norm, 6)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(far)], ["cluster_id", "cluster_size", "emb_id", "far"])

    scored = rank_one.join(centres, "cluster_id").select("cluster_id", "cluster_size", "emb_id", "unit", "centre")
    scored = scored.mapInArrow(score, "cluster_id long, cluster_size long, emb_id long, far double")
    order = Window.partitionBy("cluster_id").orderBy("far", "emb_id")
    top = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= typical)
    return top.groupBy("cluster_id", "cluster_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "emb_id"))), lambda x: x["emb_id"]).alias("typical")).select(
        "cluster_id", "cluster_size", F.col("typical")[0].alias("medoid"), "typical"
    )
