"""Vector search and similarity in blocks: exact k nearest, gates, an inverted-file index, clusters.

Rows are packed into blocks of vectors; a block of queries meets a block of rows in one matrix
product that returns the best rows only. Vectors are normalised in double precision; a zero
vector stays zero. Vectors of different lengths stand in different blocks and never meet. Null and
empty vectors are left out. Keys may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.skew import salted_join
from weftgraph.runtime import cut

BLOCK_ROWS = 8192
EMIT_ROWS = 65_536


def unit(c: Column | str) -> Column:
    """The vector divided by its length, in double; a zero vector is divided by one."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of the batch as normalised matrices, one per length, with their places."""
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(valid, np.diff(vectors.offsets.to_numpy()), 0)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        m = np.asarray(vectors.take(pa.array(at)).flatten(), np.float64).reshape(len(at), dim)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        yield m / np.where(norm == 0, 1.0, norm), at


def _ids(c: pa.Array) -> np.ndarray:
    return c.to_numpy(zero_copy_only=False)


def pack(df: DataFrame, key: str, vector: str, group: str | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """(grp, block, ids, dim, data): up to ``rows`` vectors of one length per block, without a shuffle; with ``group`` sorted by it first."""
    kind = df.schema[key].dataType

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[object, int], list] = {}

        def emit(k: tuple[object, int]) -> pa.RecordBatch:
            ids, mats = zip(*held.pop(k))
            every = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)
            return pa.RecordBatch.from_arrays([pa.array([k[0]], pa.string()), listed, pa.array([k[1]], pa.int32()), pa.array([np.vstack(mats).ravel()], pa.list_(pa.float64()))], ["grp", "ids", "dim", "data"])

        for batch in batches:
            groups = np.asarray(batch.column(2).to_pylist(), object)
            for m, at in _matrices(batch.column(1)):
                mine = groups[at]
                for g in dict.fromkeys(mine.tolist()):
                    pick = np.flatnonzero(mine == g)
                    k = g, m.shape[1]
                    for lo in range(0, len(pick), rows):
                        part = pick[lo : lo + rows]
                        held.setdefault(k, []).append((batch.column(0).take(pa.array(at[part])), m[part]))
                        if sum(len(i) for i, _ in held[k]) >= rows:
                            yield emit(k)
        for k in list(held):
            yield emit(k)

    source = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(group).cast("string") if group else F.lit("")).alias("g")).filter("id is not null and v is not null")
    if group:
        source = source.repartition("g", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("g")
    packed = source.mapInArrow(blocks, f"grp string, ids array<{kind.simpleString()}>, dim int, data array<double>")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _id_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def _best(k: int, exclude_self: bool, places: int):
    slack = 2 * 10.0**-places

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("q_dim")[r].as_py()
                if dim != batch.column("dim")[r].as_py():
                    continue
                q, d = (np.asarray(batch.column(c)[r].values).reshape(-1, dim) for c in ("q_data", "data"))
                qk, dk = (batch.column(c)[r].values for c in ("q_ids", "ids"))
                qi, di = _ids(qk), _ids(dk)
                for lo in range(0, len(qi), 512):
                    s = q[lo : lo + 512] @ d.T
                    if exclude_self:
                        s[qi[lo : lo + 512, None] == di[None, :]] = -np.inf
                    edge = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
                    i, j = np.nonzero((s >= edge[:, None] - slack) & np.isfinite(s))  # whatever may tie with the last one once rounded
                    for at in range(0, len(i), EMIT_ROWS):
                        x, y = i[at : at + EMIT_ROWS], j[at : at + EMIT_ROWS]
                        yield pa.RecordBatch.from_arrays([qk.take(pa.array(lo + x)), dk.take(pa.array(y)), pa.array(s[x, y])], ["query_id", "id", "sim"])

    return score


def _rank(pairs: DataFrame, k: int, places: int) -> DataFrame:
    rounded = pairs.withColumn("sim", F.round("sim", places)).distinct()
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))).filter(F.col("rank") <= k)


def knn(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 6, exclude_self: bool = False, places: int = 9) -> DataFrame:
    """(query_id, id, sim, rank): the exact ``k`` rows of greatest cosine per query; ties by id.

    Similarities are rounded to ``places`` before ranking. Queries and rows meet block by block;
    rows whose vector has another length than the query's are no neighbours of it.
    """
    q = pack(queries, key, vector).select(F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data"))
    d = pack(rows, key, vector).select("ids", "dim", "data")
    pairs = q.crossJoin(d).mapInArrow(_best(k, exclude_self, places), f"query_id {_id_type(queries, key)}, id {_id_type(rows, key)}, sim double")  # a query set against all rows, in blocks
    return _rank(pairs, k, places)


def gated(nearest: DataFrame, k: int = 5, tau: float = 0.5, margin: float = 0.05) -> DataFrame:
    """Of the ranked (at least two) nearest rows: none if the best is under ``tau`` or no ``margin`` ahead of the second, else those from ``tau`` on within ``k``."""
    top = nearest.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("_first"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("_second"))
    clear = top.filter((F.col("_first") >= tau) & (F.col("_second").isNull() | (F.col("_first") - F.col("_second") >= margin))).select("query_id")
    return nearest.join(clear, "query_id", "left_semi").filter((F.col("rank") <= k) & (F.col("sim") >= tau))


# ---------------------------------------------------------------- inverted-file index


#: Begins the name of the cell of all vectors whose length isn't that of the centroids.
OTHER = "d"


def _reach(centroids: np.ndarray):
    """The greatest angle between a cell's centroid and the rows of a block; all of the sphere for a centroid that is no unit vector."""

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell, dim = batch.column("grp")[r].as_py(), batch.column("dim")[r].as_py()
                if cell.startswith(OTHER):
                    continue
                c = centroids[int(cell)]
                whole = abs(np.linalg.norm(c) - 1) > 1e-6
                m = np.asarray(batch.column("data")[r].values).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([np.pi if whole else float(np.arccos(np.clip(m @ c, -1, 1)).max()) + 1e-7])], ["grp", "reach"])

    return angles


class InvertedFile:
    """Cells around centroids that were fitted on a bounded sample; every row is in the cell of its nearest centroid.

    ``sample`` bounds the rows the centroids are fitted on (documented parameter); the index holds all
    rows. Searches read the ``probes`` cells nearest to each query, then those of the rest whose
    reach (the greatest angle of a row to the centroid) allows a row as near as the last one found,
    so that the result is that of the exact search.
    """

    def __init__(self, rows: DataFrame, key: str, vector: str, cells: int = 64, sample: int = 20_000, rounds: int = 10):
        self.key, self.vector, self.id_type = key, vector, _id_type(rows, key)
        picked = rows.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).limit(sample).select(vector).collect()
        lengths = [len(r[0]) for r in picked]
        usual = max(sorted(set(lengths)), key=lengths.count, default=0)  # centroids have the length that most vectors of the sample have
        m = np.array([r[0] for r in picked if len(r[0]) == usual], np.float64).reshape(-1, usual)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        self.centroids = m[:: max(1, len(m) // max(1, min(cells, len(m))))][:cells].copy()
        for _ in range(rounds):
            near = (m @ self.centroids.T).argmax(axis=1)
            for c in range(len(self.centroids)):
                if (mine := m[near == c]).size:
                    mean = mine.mean(axis=0)
                    self.centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
        self.blocks = cut(pack(self._cells(rows, 1), key, vector, "cell"))
        self.reach = np.full(len(self.centroids), -1.0)  # of a cell without rows
        for r in self.blocks.mapInArrow(_reach(self.centroids), "grp string, reach double").groupBy("grp").agg(F.max("reach").alias("reach")).collect():
            self.reach[int(r.grp)] = r.reach

    def _cells(self, df: DataFrame, probes: int) -> DataFrame:
        centroids, key, vector = self.centroids, self.key, self.vector

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for m, ok in _matrices(batch.column(1)):
                    if m.shape[1] == centroids.shape[1]:
                        n = min(probes, len(centroids))
                        names = np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :n].ravel().astype(str).tolist()
                    else:
                        n, names = 1, [f"{OTHER}{m.shape[1]}"] * len(ok)
                    at = pa.array(np.repeat(ok, n))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(names, pa.string())], [key, vector, "cell"])

        return df.select(key, F.col(vector).cast("array<double>").alias(vector)).filter(F.col(vector).isNotNull()).mapInArrow(assign, f"{key} {_id_type(df, key)}, {vector} array<double>, cell string")

    def _open(self, df: DataFrame, probes: int, places: int) -> DataFrame:
        """The queries (with ``_last``, the last similarity found) once per cell beyond the probes that can hold a row as near."""
        centroids, reach, key, vector, slack = self.centroids, self.reach, self.key, self.vector, 10.0**-places

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for m, ok in _matrices(batch.column(1)):
                    if m.shape[1] != centroids.shape[1]:
                        continue  # one cell holds all of them, and it was searched
                    dots = m @ centroids.T
                    most = np.cos(np.maximum(0.0, np.arccos(np.clip(dots, -1, 1)) - reach))
                    rest = (reach >= 0) & (most >= np.asarray(batch.column(2))[ok, None] - slack)
                    np.put_along_axis(rest, np.argsort(-dots, axis=1, kind="stable")[:, :probes], False, 1)
                    i, c = np.nonzero(rest)
                    at = pa.array(ok[i])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(c.astype(str).tolist(), pa.string())], [key, vector, "cell"])

        return df.select(key, F.col(vector).cast("array<double>").alias(vector), "_last").filter(F.col(vector).isNotNull()).mapInArrow(cells, f"{key} {_id_type(df, key)}, {vector} array<double>, cell string")

    def _meet(self, cells: DataFrame, k: int, exclude_self: bool, places: int) -> DataFrame:
        q = pack(cells, self.key, self.vector, "cell").select("grp", F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data"))
        return self.blocks.join(q, "grp").select("q_ids", "q_dim", "q_data", "ids", "dim", "data").mapInArrow(_best(k, exclude_self, places), f"query_id {_id_type(cells, self.key)}, id {self.id_type}, sim double")

    def search(self, queries: DataFrame, k: int = 6, probes: int = 8, exclude_self: bool = False, places: int = 9) -> DataFrame:
        first = cut(_rank(self._meet(self._cells(queries, probes), k, exclude_self, places), k, places))
        last = first.filter(F.col("rank") == k).select(F.col("query_id").alias(self.key), F.col("sim").alias("_last"))
        left = queries.join(last, self.key, "left").withColumn("_last", F.coalesce("_last", F.lit(-2.0)))  # fewer than k found: every cell
        more = self._meet(self._open(left, probes, places), k, exclude_self, places)
        return _rank(first.drop("rank").unionByName(more), k, places)


# ---------------------------------------------------------------- clusters


def similar_pairs(df: DataFrame, key: str, vector: str, tau: float, group: str | None = None) -> DataFrame:
    """(a, b) with a < b of rows of one group whose cosine is ``tau`` or more; only such pairs leave a block product."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                if dim != batch.column("q_dim")[r].as_py():
                    continue
                x, y = (np.asarray(batch.column(c)[r].values).reshape(-1, dim) for c in ("q_data", "data"))
                xi, yi = (_ids(batch.column(c)[r].values) for c in ("q_ids", "ids"))
                for lo in range(0, len(xi), 512):
                    i, j = np.nonzero(x[lo : lo + 512] @ y.T >= tau)
                    a, b = xi[lo + i], yi[j]
                    ok = a != b
                    if not ok.any():
                        continue
                    a, b, first = a[ok], b[ok], a[ok] < b[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(first, a, b)), pa.array(np.where(first, b, a))], ["a", "b"])

    blocks = cut(pack(df, key, vector, group))
    left = blocks.select("grp", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data"))
    met = left.join(blocks, "grp").filter("q_block <= block").select("q_ids", "q_dim", "q_data", "ids", "dim", "data")
    kind = _id_type(df, key)
    return met.mapInArrow(pairs, f"a {kind}, b {kind}").distinct()


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): the least id that is reachable; nodes without pairs are their own.

    Every round hands the least label to the neighbours and then follows labels to theirs, so the
    distance covered doubles, until no label changes. Each round is checkpointed; hub nodes are spread.
    """
    both = cut(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    labels = cut(nodes.select(F.col("id"), F.col("id").alias("component")).distinct())
    while True:
        offered = salted_join(both, labels.select(F.col("id").alias("src"), "component"), ["src"], F.col("dst"), how="inner").select(F.col("dst").alias("id"), "component")
        least = labels.unionByName(offered).groupBy("id").agg(F.min("component").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("_next"))
        stepped = cut(salted_join(least, jump, ["component"], F.col("id"), how="left").select("id", F.least("component", "_next").alias("component")))
        if stepped.join(labels.withColumnRenamed("component", "_old"), "id").filter("component <> _old").isEmpty():
            return stepped
        labels = stepped


def canonical_members(members: DataFrame) -> DataFrame:
    """Rows (group, component, name, support, ord) → with ``canon``: the most supported name, then the shortest, then the first."""
    best = members.groupBy("group", "component").agg(F.max_by("name", F.struct("support", -F.length("name"), -F.col("ord"))).alias("canon"))
    return members.join(best, ["group", "component"])
