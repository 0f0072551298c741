"""Embedding near-dedup by an epsilon grid order join.

Two unit vectors have cosine >= c exactly if they lie within eps = sqrt(2 - 2c). Vectors are projected on the leading
principal dimensions (fitted on a bounded sample, ``SAMPLE``; any rotation keeps distances), and sorted by their grid
cells of side eps in those dimensions, then by id, so equal cells divide too. The sequence is cut into blocks of at most
``BLOCK``, with bounding boxes, and the blocks into a tree of ``FAN`` children. Pairs of intervals are joined
recursively, level by level as a table, and dropped where their boxes lie farther apart than eps; surviving pairs of
blocks are divided the same way inside a task down to ``LEAF`` vectors, which are compared by matrix product. Products
in single precision only pass over pairs that are clearly below the threshold; every link is confirmed in double precision.

A pair of blocks returns link counts and a spanning forest, at most two rows a vector, so a cluster's square is never
written. No pair of rows and no id is dropped: only provably distant blocks are.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null id,
link with nothing; vectors of different lengths do not link; rows that share a vec_id are one vertex and do not count
as links of each other: equal vectors of it count once, different ones each, as what other vectors link with; an empty table gives
no rows; labels and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.components import components

COSINE = 0.95
SAMPLE, GRID_DIMS, BOX_DIMS = 4000, 8, 16
BLOCK, LEAF, FAN = 4096, 512, 32
#: Single precision is this far from double at most, for unit vectors of some thousand dimensions.
SLACK = 1e-4


def usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal(sample: np.ndarray, dims: int) -> np.ndarray:
    """Leading principal directions, as columns."""
    _, vectors = np.linalg.eigh(np.cov(sample.T) if len(sample) > 1 else np.eye(sample.shape[1]))
    return vectors[:, ::-1][:, :dims]


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<f8").reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Joined:
    """Links between the rows of two blocks, found by dividing both."""

    def __init__(self, x: np.ndarray, y: np.ndarray, same: bool, axes: np.ndarray, cosine: float):
        self.x, self.y, self.same, self.cosine = x, y, same, cosine
        self.px, self.py = x @ axes, y @ axes
        self.x32, self.y32 = x.astype(np.float32), y.astype(np.float32)
        self.reach = 2 - 2 * cosine + 1e-9
        self.i: list[np.ndarray] = []
        self.j: list[np.ndarray] = []

    def near(self, a: int, b: int, c: int, d: int) -> bool:
        p, q = self.px[a:b], self.py[c:d]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        return float((gap * gap).sum()) <= self.reach

    def run(self, a: int, b: int, c: int, d: int) -> None:
        if (self.same and d <= a) or not self.near(a, b, c, d):
            return
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(self.x32[a:b] @ self.y32[c:d].T >= self.cosine - SLACK)
            i, j = i + a, j + c
            if self.same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 65536):  # in double precision, in bounded parts
                u, v = i[at : at + 65536], j[at : at + 65536]
                ok = np.einsum("ij,ij->i", self.x[u], self.y[v]) >= self.cosine
                self.i.append(u[ok])
                self.j.append(v[ok])
            return
        if b - a >= d - c:
            m = (a + b) // 2
            self.run(a, m, c, d)
            self.run(m, b, c, d)
        else:
            m = (c + d) // 2
            self.run(a, b, c, m)
            self.run(a, b, m, d)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least row that links lead to, for each of n rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def blocks_of(vectors: DataFrame, axes: dict[int, np.ndarray], cosine: float, n: int) -> DataFrame:
    """(part, block, dim, ids, data, lo, hi) from (vec_id, embedding, dim), in epsilon grid order."""
    side = float(np.sqrt(2 - 2 * cosine))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            cells, data = [], []
            for v in batch.column("embedding").to_pylist():
                x = _unit(np.array([v], dtype=np.float64))
                at = axes.get(x.shape[1])
                p = np.zeros(GRID_DIMS) if at is None else np.pad(x[0] @ at[:, :GRID_DIMS], (0, max(0, GRID_DIMS - at.shape[1])))
                # order-preserving bytes: 16 bits for each cell number
                cells.append((np.floor(p / side).astype(np.int64) + 32768).clip(0, 65535).astype(">u2").tobytes())
                data.append(x.astype("<f8").tobytes())
            columns = [batch.column("vec_id"), batch.column("dim"), pa.array(cells, pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "cell", "data"])

    parts = max(1, -(-n // BLOCK))
    rows = vectors.mapInArrow(celled, "vec_id long, dim int, cell binary, data binary")
    order = ["dim", "cell", "vec_id"]
    sorted_rows = rows.repartitionByRange(parts, *order).coalesce(parts).sortWithinPartitions(*order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list[int] = []
        data: list[bytes] = []
        dim, block = None, 0

        def made() -> pa.RecordBatch:
            x = _matrix(b"".join(data), dim)
            at = axes.get(dim)
            p = np.zeros((len(x), BOX_DIMS))
            if at is not None:
                p[:, : at.shape[1]] = x @ at
            out = {"part": part, "block": part * 2**20 + block, "dim": dim, "ids": np.array(ids, "<i8").tobytes(), "data": x.tobytes(), "lo": p.min(axis=0).tolist(), "hi": p.max(axis=0).tolist()}
            return pa.RecordBatch.from_pylist([out], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if ids and (row["dim"] != dim or len(ids) >= BLOCK):
                    yield made()
                    ids, data, block = [], [], block + 1
                dim = row["dim"]
                ids.append(row["vec_id"])
                data.append(row["data"])
        if ids:
            yield made()

    f64 = pa.list_(pa.float64())
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("lo", f64), ("hi", f64)])
    return sorted_rows.mapInArrow(packed, "part long, block long, dim int, ids binary, data binary, lo array<double>, hi array<double>")


def near_blocks(blocks: DataFrame, parts: int, cosine: float) -> DataFrame:
    """(a, b) block ids whose boxes are within reach, a <= b, found from the tree's top down."""
    box = [F.col("lo")[k].alias(f"l{k}") for k in range(BOX_DIMS)] + [F.col("hi")[k].alias(f"h{k}") for k in range(BOX_DIMS)]
    leaves = common.checkpointed(blocks.select("part", "block", *box))
    merged = [F.min(f"l{k}").alias(f"l{k}") for k in range(BOX_DIMS)] + [F.max(f"h{k}").alias(f"h{k}") for k in range(BOX_DIMS)]
    levels = [leaves.groupBy(F.col("part").alias("node")).agg(*merged)]
    width = parts
    while width > FAN:
        width = -(-width // FAN)
        levels.append(levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(*merged))

    def side(level: DataFrame, tag: str) -> DataFrame:
        return level.select(*(F.col(c).alias(f"{c}_{tag}") for c in level.columns))

    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"l{k}_a") - F.col(f"h{k}_b"), F.col(f"l{k}_b") - F.col(f"h{k}_a"))
    reached = sum((gap(k) * gap(k) for k in range(1, BOX_DIMS)), gap(0) * gap(0)) <= 2 - 2 * cosine + 1e-9
    spread = lambda c, alias: F.explode(F.sequence(c * FAN, c * FAN + (FAN - 1))).alias(alias)
    # above the top level stands one root
    pairs = leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"))
    for level in reversed(levels):
        down = pairs.select("pb", spread(F.col("pa"), "node_a")).select("node_a", spread(F.col("pb"), "node_b")).where("node_a <= node_b")
        pairs = down.join(side(level, "a"), "node_a").join(side(level, "b"), "node_b").where(reached)
        pairs = common.checkpointed(pairs.select(F.col("node_a").alias("pa"), F.col("node_b").alias("pb")))
    own = leaves.withColumnRenamed("part", "node").withColumnRenamed("block", "id")
    pairs = pairs.withColumnsRenamed({"pa": "node_a", "pb": "node_b"}).join(side(own, "a"), "node_a").join(side(own, "b"), "node_b")
    return pairs.where((F.col("id_a") <= F.col("id_b")) & reached).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def linked(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows (id, n, a, b): counts of links of an id, or a link of a spanning forest of a pair of blocks."""
    vector = F.col("embedding").cast("array<double>")
    vectors = embeddings.select(F.col("vec_id").cast("long"), vector.alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    if vectors.groupBy("vec_id").count().where("count > 1").limit(1).count():
        vectors = vectors.dropDuplicates()
    vectors = vectors.withColumn("dim", F.size("embedding"))
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["embedding"])
    axes = {d: principal(_unit(np.array(v, dtype=np.float64)), min(d, BOX_DIMS)) for d, v in by_dim.items()}
    n = vectors.count()
    blocks = common.checkpointed(blocks_of(vectors, axes, cosine, n))
    # each pair's first block is the one that balances how often a block comes first
    pairs = near_blocks(blocks, max(1, -(-n // BLOCK)), cosine)
    swap = (F.xxhash64("a", "b") % 2 == 0) & (F.col("a") != F.col("b"))
    pairs = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    data = lambda t: blocks.select(*(F.col(c).alias(f"{c}_{t}") for c in ("dim", "ids", "data")), F.col("block").alias(t))
    placed = pairs.join(data("a"), "a").join(data("b"), "b").where("dim_a = dim_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, 1):
            row = batch.to_pylist()[0]
            dim, same = row["dim_a"], row["a"] == row["b"]
            x, y = _matrix(row["data_a"], dim), _matrix(row["data_b"], dim)
            ids = np.frombuffer(row["ids_a"], "<i8")
            ids = ids if same else np.concatenate([ids, np.frombuffer(row["ids_b"], "<i8")])
            job = Joined(x, y, same, axes.get(dim, np.zeros((dim, 1))), cosine)
            job.run(0, len(x), 0, len(y))
            i = np.concatenate([*job.i, np.zeros(0, np.int64)]).astype(np.int64)
            j = np.concatenate([*job.j, np.zeros(0, np.int64)]).astype(np.int64) + (0 if same else len(x))
            other = ids[i] != ids[j]
            i, j = i[other], j[other]
            count = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            least = forest(i, j, len(ids))
            has, moved = np.nonzero(count)[0], np.nonzero(least != np.arange(len(ids)))[0]
            none = [None] * len(has)
            arrays = [
                pa.array([*ids[has].tolist(), *[None] * len(moved)], pa.int64()),
                pa.array([*count[has].tolist(), *[None] * len(moved)], pa.int64()),
                pa.array([*none, *ids[least[moved]].tolist()], pa.int64()),
                pa.array([*none, *ids[moved].tolist()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "a", "b"])

    return common.checkpointed(placed.mapInArrow(run, "id long, n long, a long, b long"))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of embeddings."""
    found = linked(embeddings, cosine)
    counts = found.where("id is not null").groupBy(F.col("id").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    own = components(found.where("a is not null").select("a", "b"), found.count()).withColumnRenamed("id", "vec_id")
    out = embeddings.select(F.col("vec_id").cast("long")).join(counts, "vec_id", "left").join(own, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "embeddings"))
