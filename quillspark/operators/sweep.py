"""Seed sweep: one text classifier a seed, and the seed whose predictions agree most with a reference.

A model is logistic regression over hashed words and word pairs, trained by stochastic steps; the seed sets its first weights and
the order of its rows. Training rows are dealt by a hash of their key into shards of about ``SHARD_ROWS`` or, where texts are long, of about ``SHARD_PLACES``
words and word pairs; each (seed, shard) is trained in a task of its own, and a seed's model is the mean of its shards' weights. One shard is the
plain sequential run. So no task holds more than a shard, however many rows there are and however long, and the result is the same on any partitioning.

Rows to predict are never shuffled: the models, SEEDS times ``FEATURES`` numbers at most, travel with the tasks, and the agreement of
all seeds is counted in the same pass. Of equal seeds the first one given wins.

Defined results: training rows with a null key, a null or empty text or another label than the two are left out; rows of one key are all used, in the
order of text and label; without a row of both labels there is no model (ValueError). A null or empty text is predicted by the bias alone; a row with a
null reference agrees with nothing. Texts may be of any length: memory is in proportion to a batch of ``SLICE`` rows. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import lineage
from quillspark.operators.training import LABELS

FEATURES, EPOCHS, RATE, DECAY, SPREAD = 1 << 14, 5, 0.5, 1e-5, 0.01
SHARD_ROWS, SHARD_PLACES, SEEDS, SLICE = 10_000, 20_000_000, 64, 256


def placed(rows: DataFrame, text: Column, out: str) -> DataFrame:
    """rows with ``out``: places of the words and word pairs of a text among FEATURES, with repeats.

    Words are a column of their own, as an expression that names them several times would cut the text as often. A run of word characters is a word.
    """
    rows = rows.withColumn(out, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w{2,}"), F.lit(0)))
    words = F.col(out)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return rows.withColumn(out, F.transform(F.concat(words, pairs), lambda t: (F.crc32(t.cast("binary")) % FEATURES).cast("int")))


def unit(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and 1 + log of their counts, in unit length."""
    seen, counts = np.unique(places, return_counts=True)
    values = 1 + np.log(counts)
    return seen, values / max(np.sqrt(values @ values), 1e-12)


def fitted(rows: list[tuple[np.ndarray, int]], seed: int) -> np.ndarray:
    """Weights, the bias last, after EPOCHS passes over (places, 0 or 1), each in an order that the seed draws."""
    return _fitted([(*short(x), y) for x, y in rows], seed)


def short(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and their counts, in few bytes: a shard is held in this form, and ``_fitted`` makes ``unit``'s numbers of it row by row."""
    seen, counts = np.unique(places, return_counts=True)
    return seen.astype(np.uint16), counts.astype(np.uint32)


def _fitted(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    weights = np.append(rng.normal(0, SPREAD, FEATURES), 0.0)
    ones = sum(y for *_, y in rows)
    # both classes weigh the same, as far as a shard has both
    weight = [len(rows) / (2 * max(k, 1)) if 0 < ones < len(rows) else 1.0 for k in (len(rows) - ones, ones)]
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for i in rng.permutation(len(rows)):
            at, counts, y = rows[i]
            x = 1 + np.log(counts.astype(np.int64))
            x /= max(np.sqrt(x @ x), 1e-12)
            slope = weight[y] * (1 / (1 + np.exp(-np.clip(weights[at] @ x + weights[-1], -30, 30))) - y)
            weights[at] -= rate * (slope * x + DECAY * weights[at])
            weights[-1] -= rate * slope
    return weights


@dataclass
class Sweep:
    """Models by seed, in the order of the seeds."""

    seeds: tuple[int, ...]
    weights: np.ndarray

    def predicted(self, rows: DataFrame, text: str, out: str = "predicted") -> DataFrame:
        """rows with ``out``, the labels by seed, in order."""
        weights, names = self.weights, [f"c{i}" for i in range(len(rows.columns))]
        kind = T.ArrayType(T.StringType())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(at, SLICE)
                    made = []
                    for places in batch.column(batch.num_columns - 1):
                        seen, x = unit(np.asarray(places.values, dtype=np.int64))
                        made.append([LABELS[int(s > 0)] for s in weights[:, seen] @ x + weights[:, -1]])
                    kept = batch.columns[:-1]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.list_(pa.string()))], names=[*names, "made"])

        asked = placed(rows.toDF(*names), F.col(names[rows.columns.index(text)]), "places")
        schema = T.StructType([*asked.schema.fields[:-1], T.StructField("made", kind)])
        return asked.mapInArrow(run, schema).toDF(*rows.columns, out)

    def results(self, predicted: DataFrame, reference: str, column: str = "predicted") -> DataFrame:
        """One row a seed: (ord, seed, agreed, interventional, n), of rows that ``predicted`` made. One pass, partial sums only."""
        counts = [
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(s).cast("long").alias("seed"),
                F.count_if(F.col(column)[i] == F.col(reference)).alias("agreed"),
                F.count_if(F.col(column)[i] == LABELS[0]).alias("interventional"),
                F.count("*").alias("n"),
            )
            for i, s in enumerate(self.seeds)
        ]
        return predicted.agg(F.array(*counts).alias("r")).select(F.inline("r"))

    def chosen(self, predicted: DataFrame, reference: str, column: str = "predicted") -> int:
        """The place of the seed of most agreement."""
        best = self.results(predicted, reference, column).agg(F.max_by("ord", F.struct("agreed", -F.col("ord"))).alias("ord"))
        return best.first()["ord"]


def train(rows: DataFrame, key: str, text: str, label: str, seeds: Sequence[int]) -> Sweep:
    """A model a seed."""
    if not 0 < len(seeds) <= SEEDS or len(set(seeds)) < len(seeds):
        raise ValueError(f"between 1 and {SEEDS} different seeds")
    usable = F.col(key).isNotNull() & (F.coalesce(text, F.lit("")) != "") & F.col(label).isin(*LABELS)
    tied = F.struct(F.col(text).alias("t"), F.col(label).alias("l"))
    # a key's rows are told apart by their hash; the text itself does not travel
    made = rows.where(usable).select(F.col(key).cast("string").alias("key"), F.xxhash64(tied).alias("tie"), F.col(text).alias("text"), (F.col(label) == LABELS[1]).cast("int").alias("y"))
    made = lineage.kept(placed(made, F.col("text"), "places").drop("text"))
    counts = made.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.sum(F.size("places")).alias("places")).first()
    if not counts["n"] or not 0 < counts["ones"] < counts["n"]:
        raise ValueError("training needs rows of both labels")
    shards = max(-(-counts["n"] // SHARD_ROWS), -(-counts["places"] // SHARD_PLACES))
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("key", "tie"), F.lit(shards))).withColumn("seed", F.explode(F.array(*(F.lit(s).cast("long") for s in seeds))))

    def one(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order = pc.sort_indices(group.select(["key", "tie"]), [("key", "ascending"), ("tie", "ascending")]).to_numpy()
        places, y, seed, shard = (group.column(c).chunk(0) for c in ("places", "y", "seed", "shard"))
        offsets, values, y = places.offsets.to_numpy(), places.values.to_numpy(), y.to_numpy()
        weights = _fitted([(*short(values[offsets[i] : offsets[i + 1]]), int(y[i])) for i in order], seed[0].as_py())
        return pa.table({"seed": seed[:1], "shard": shard[:1], "rows": pa.array([len(order)], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary())})

    parts = dealt.groupBy("seed", "shard").applyInArrow(one, "seed long, shard long, rows long, weights binary")

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Running means by seed over one partition's shards, sorted, so that only one row of weights is held."""
        at, mean, rows = None, None, 0
        for b in batches:
            for seed, n, blob in zip(b.column("seed").to_pylist(), b.column("rows").to_pylist(), b.column("weights"), strict=True):
                if seed != at:
                    if at is not None:
                        yield _row(at, mean)
                    at, mean, rows = seed, np.zeros(FEATURES + 1), 0
                rows += n
                mean += (np.frombuffer(blob.as_buffer(), dtype=np.float64) - mean) * (n / rows)
        if at is not None:
            yield _row(at, mean)

    models = lineage.kept(parts.repartition(len(seeds), "seed").sortWithinPartitions("seed", "shard").mapInArrow(mixed, "seed long, weights binary"))
    # SEEDS rows at most
    found = {r["seed"]: np.frombuffer(bytes(r["weights"])) for r in models.collect()}
    return Sweep(tuple(int(s) for s in seeds), np.stack([found[int(s)] for s in seeds]))


def _row(seed: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([seed], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["seed", "weights"])
