"""Compression of vectors to codes: a codebook for each part of a vector, refined in rounds.

Components become integers, so every distance, sum and mean is exact and no result depends on the order of additions.
Vectors are packed into columnar blocks, (component, row) matrices of at most ``BLOCK`` rows, and written once to the
checkpoint folder; each round is an RDD treeAggregate over them. Within a block, distances to all entries accumulate dimension by
dimension, ``np.add.at`` adds the rows to (part, entry, position) int64 sums and (part, entry) counts, and these tensors,
whose size depends on the vectors' length alone, merge through a reduction tree. The driver holds codebooks and one round's tensors.

Defined results: a vector that is null or holds null or non-finite components is dropped; an empty vector is kept, its
parts are empty. Vectors of each length have codebooks of their own; where a length is no multiple of ``parts``, its first
parts are longer by one. Rows that share an id are rows of their own, in order of their components where the first
ones are sought; rows without an id are last there. With fewer rows than entries there are as many entries as rows. Components too large for
exact int64 distances are computed with unbounded integers; an error beyond the range of long is the largest long. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 8192
#: Copies of a label's sum, and rows of that label by them, where the labels are too many to broadcast.
SALTS = 64

Book = dict[int, list[np.ndarray]]


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of each part of a vector."""
    at = [length // parts * i + min(i, length % parts) for i in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def exact(length: int) -> int:
    """The largest integer whose squared distances, summed over ``length`` components, stay within int64."""
    return min(2**31 - 1, math.isqrt(2**63 // (4 * max(length, 1))) - 1)


def integers(rows: list) -> np.ndarray:
    """A matrix of int64 where that is exact, and of Python integers beyond."""
    length = len(rows[0])
    large = any(abs(c) > exact(length) for v in rows for c in v)
    return np.array(rows, dtype=object if large else np.int64).reshape(len(rows), length)


def whole(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x)."""
    x = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1) * scale
    if not x.size or np.abs(x).max() <= exact(x.shape[1]):
        return np.floor(x).astype(np.int64)
    return integers([[math.floor(Fraction(c) * scale) for c in v] for v in vectors])


def blocks(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(length, n, ids, labels, narrow, data) of whole vectors in columnar blocks."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")).where(F.coalesce(sound, F.lit(False)))
    schema = pa.schema([("length", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("narrow", pa.bool_()), ("data", pa.binary())])

    def made(length: int, kept: list[tuple]) -> pa.RecordBatch:
        ids, labels, vectors = zip(*kept, strict=True)
        x = whole(list(vectors), scale).T
        narrow = x.dtype != object
        raw = np.ascontiguousarray(x, dtype="<i4").tobytes() if narrow else ",".join(map(str, x.ravel())).encode()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((length, list(ids), list(labels), narrow, raw), schema.types, strict=True)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in common.small_batches(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept = held.setdefault(len(row[2]), [])
                kept.append(row)
                if len(kept) == BLOCK:
                    yield made(len(row[2]), held.pop(len(row[2])))
        for length, kept in held.items():
            yield made(length, kept)

    return rows.mapInArrow(pack, "length int, ids array<bigint>, labels array<string>, narrow boolean, data binary")


def matrix(length: int, n: int, narrow: bool, data: bytes) -> np.ndarray:
    if narrow:
        return np.frombuffer(data, "<i4").reshape(length, n).astype(np.int64)
    return np.array([int(v) for v in data.split(b",")] if length else [], dtype=object).reshape(length, n)


def assigned(x: np.ndarray, book: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, row): the nearest entry, the lower one of equals, and its squared distance."""
    if any(b.dtype == object for b in book):
        x = x.astype(object)
    index = np.zeros((parts, x.shape[1]), dtype=np.int64)
    error = np.zeros((parts, x.shape[1]), dtype=x.dtype)
    for p, (a, b) in enumerate(bounds(len(x), parts)):
        far = np.zeros((len(book[p]), x.shape[1]), dtype=x.dtype)
        for j in range(a, b):
            off = x[j] - book[p][:, j - a].astype(x.dtype)[:, None]
            far += off * off
        index[p] = far.argmin(axis=0)
        error[p] = np.take_along_axis(far, index[p][None], axis=0)[0]
    return index, error


def tensors(x: np.ndarray, book: list[np.ndarray], parts: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums (entry, position) of each part, and counts (part, entry)."""
    index, _ = assigned(x, book, parts)
    counts = np.zeros((parts, len(book[0])), dtype=np.int64)
    sums = []
    for p, (a, b) in enumerate(bounds(len(x), parts)):
        total = np.zeros((len(book[p]), b - a), dtype=x.dtype)
        np.add.at(total, index[p], x[a:b].T)
        np.add.at(counts[p], index[p], 1)
        sums.append(total)
    return sums, counts


def merged(a: dict, b: dict) -> dict:
    """Tensors of both, by length of vectors."""
    out = dict(a)
    for length, (sums, counts) in b.items():
        if length in out:
            sums, counts = [s + t for s, t in zip(out[length][0], sums, strict=True)], out[length][1] + counts
        out[length] = (sums, counts)
    return out


def first_entries(packed: DataFrame, parts: int, entries: int) -> Book:
    """Codebooks of each length's first vectors, by id."""
    Found = dict[int, list[tuple]]

    def least(a: Found, b: Found) -> Found:
        return {n: sorted([*a.get(n, []), *b.get(n, [])])[:entries] for n in a.keys() | b.keys()}

    def added(acc: Found, row: tuple) -> Found:
        length, ids, narrow, data = row
        order = np.array([(i is None, i or 0) for i in ids], dtype=[("none", "?"), ("id", "<i8")])
        last = np.sort(order)[:entries][-1]
        x = matrix(length, len(ids), narrow, data)
        chosen = [k for k, o in enumerate(order.tolist()) if o <= last.item()]
        return least(acc, {length: [(*order[k].item(), tuple(x[:, k].tolist())) for k in chosen]})

    found = packed.select("length", "ids", "narrow", "data").rdd.treeAggregate({}, added, least, depth=3)
    made = {n: integers([v for *_, v in rows]) for n, rows in found.items()}
    return {n: [x[:, a:b] for a, b in bounds(n, parts)] for n, x in made.items()}


def renewed(entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each entry with rows."""
    out = entries.astype(np.result_type(entries, sums))
    used = counts > 0
    out[used] = sums[used] // counts[used][:, None]
    return out


def trained(packed: DataFrame, book: Book, parts: int, rounds: int) -> Book:
    """Codebooks after all rounds."""
    rdd = packed.select("length", F.size("ids").alias("n"), "narrow", "data").rdd
    for _ in range(rounds):
        now = packed.sparkSession.sparkContext.broadcast(book)

        def added(acc: dict, row: tuple, now=now) -> dict:
            return merged(acc, {row[0]: tensors(matrix(*row), now.value[row[0]], parts)})

        found = rdd.treeAggregate({}, added, merged, depth=3)
        book = {n: [renewed(entries, *x) for entries, *x in zip(book[n], *found[n], strict=True)] for n in book}
        now.unpersist()
    return book


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of the entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(c)) for entries in book for c in entries.ravel()).encode()).hexdigest()


def coded(packed: DataFrame, book: Book, parts: int) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256)."""
    names = {n: digest(b) for n, b in book.items()}
    top = 2**63 - 1
    now = packed.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, 1):
            row = batch.to_pylist()[0]
            n = row["length"]
            index, error = assigned(matrix(n, len(row["ids"]), row["narrow"], row["data"]), now.value[n], parts)
            codes = index.astype(np.uint8).T.tobytes().hex()
            code = [codes[i : i + 2 * parts] for i in range(0, len(codes), 2 * parts)]
            errors = [min(top, int(e)) for e in error.sum(axis=0)]
            arrays = [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(code, pa.string()), pa.array(errors, pa.int64()), pa.array([names[n]] * len(code), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return packed.mapInArrow(run, "vec_id long, label string, code string, error long, codebooks_sha256 string")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """Adds label_error, the errors of equal labels summed; nulls are equal."""
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")).cast("decimal(38,0)"), top).cast("long").alias("label_error"))
    sums = common.checkpointed(sums)
    if sums.count() <= common.BROADCAST_ROWS:
        return rows.join(F.broadcast(sums), rows["label"].eqNullSafe(sums["label"])).drop("label")
    # one label may hold a third of all rows
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "of")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(sums, rows["label"].eqNullSafe(sums["of"]) & (rows["salt"] == sums["salt"])).drop("label", "of", "salt")


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Book]:
    """(vec_id, label, code, error, codebooks_sha256), a row per vector, and the codebooks by length of vectors."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    packed = common.checkpointed(blocks(embeddings, scale))
    book = trained(packed, first_entries(packed, parts, entries), parts, rounds)
    return coded(packed, book, parts), book


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = compressed(common.read(spark, sf_dir, "embeddings"))
    return with_label_errors(rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
