"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct words (letters only, Unicode lower-cased) and word openings of four and five letters, hashed to 2**24 numbers.
Features are all terms that at least ``MIN_TEXTS`` sampled texts hold, however alike their shares in the two classes: a term that
matters only beside another one, such as a group's name beside an insult, has to be there to be learned. The score is
sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>). Weights and whole factor vectors are shrunk towards zero in training (L1 for
weights, its grouped form for vectors), so that terms that add nothing weigh little. The machine is fitted on a bounded sample of labelled rows
(``SAMPLE_PER_CLASS`` whole texts of each class, chosen by hash); documents with crc32(doc_id) mod 3 = 1 are never
learned from. Label, language, source and id are not inputs of a score.

Cost: one narrow scoring pass in Arrow batches; the sample's ids are the only thing broadcast and the model, bounded by
the sample, travels in the closure.

Defined results: a null or empty text scores as a text without known terms; repeated rows get equal scores; without
labels of both classes the score is 0; an empty table gives no rows; other columns are ignored; a null doc_id is never learned from and
is not held out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common

SAMPLE_PER_CLASS = 3000
HASH_BITS, MIN_TEXTS, FACTORS = 24, 4, 4
EPOCHS, AVERAGED, LEAST_STEPS, BATCH = 12, 4, 2000, 64
#: Learning rates of weights and factors, and how much a text's gradient must outweigh to move them from zero.
RATE, FACTOR_RATE, SHRINK, FACTOR_SHRINK, START = 0.3, 0.05, 0.03, 0.3, 0.05
TOXIC_AT = 0.7
FOLDS, HELD_OUT_FOLD = 3, 1

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str, openings: dict[str, tuple[int, ...]]) -> set[int]:
    """Distinct hashed terms; ``openings`` caches a word's terms."""
    out: set[int] = set()
    for w in set(_WORD.findall(text.lower())):
        got = openings.get(w)
        if got is None:
            if len(openings) > 300_000:
                openings.clear()
            kinds = ["=" + w, *(f"^{w[:n]}" for n in (4, 5) if len(w) >= n)]
            got = openings[w] = tuple(zlib.crc32(k.encode()) >> (32 - HASH_BITS) for k in kinds)
        out.update(got)
    return out


@dataclass
class Machine:
    numbers: np.ndarray  # hashed terms, sorted
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Places of the known ones of distinct terms."""
        at = np.searchsorted(self.numbers, terms)
        at = np.minimum(at, max(len(self.numbers) - 1, 0))
        return at[self.numbers[at] == terms] if len(self.numbers) else at[:0]

    def score(self, terms: np.ndarray) -> float:
        at = self.places(terms)
        v = self.factors[at].astype(np.float64)
        s = v.sum(axis=0)
        z = self.bias + float(self.linear[at].sum(dtype=np.float64)) + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


class _Batch:
    """Some rows: their features side by side, and how to sum over a row's features and over a feature's rows."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.label = np.array([y for y, _ in rows], dtype=float)
        sizes = np.array([len(x) for _, x in rows])
        self.flat = np.concatenate([x for _, x in rows])
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.used, self.place = np.unique(self.flat, return_inverse=True)
        self.order = np.argsort(self.place, kind="stable")
        self.starts = np.searchsorted(self.place[self.order], np.arange(len(self.used)))
        self.filled = np.flatnonzero(sizes)
        self.begins = (np.cumsum(sizes) - sizes)[self.filled]

    def by_row(self, x: np.ndarray) -> np.ndarray:
        """Sums along the last axis, over each row's features."""
        out = np.zeros((*x.shape[:-1], len(self.label)), dtype=x.dtype)
        if x.shape[-1]:
            out[..., self.filled] = np.add.reduceat(x, self.begins, axis=-1)
        return out

    def by_feature(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[..., self.order], self.starts, axis=-1) if x.shape[-1] else x


def fit(rows: list[tuple[int, np.ndarray]], seed: int = 7) -> Machine | None:
    """Adaptive gradient steps on (label, hashed terms), each followed by the shrinking of what it touched.

    The machine is the mean of what the last AVERAGED epochs end with.
    """
    if {r[0] for r in rows} != {0, 1}:
        return None
    numbers, texts = np.unique(np.concatenate([r[1] for r in rows]), return_counts=True)
    rng = np.random.default_rng(seed)
    n = int((texts >= MIN_TEXTS).sum())
    machine = Machine(numbers[texts >= MIN_TEXTS], 0.0, np.zeros(n, np.float32), np.zeros((n, FACTORS), np.float32))
    known = [(y, machine.places(t)) for y, t in rows]
    order = rng.permutation(len(known))
    batches = [_Batch([known[i] for i in order[at : at + BATCH]]) for at in range(0, len(order), BATCH)]
    w0, w, v = 0.0, np.zeros(n, np.float32), rng.normal(0, START, (FACTORS, n)).astype(np.float32)
    seen_0, seen_w, seen_v = 1e-3, np.full(n, 1e-3, np.float32), np.full(n, 1e-3, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(batches)))
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            vf = v[:, b.flat]
            s = b.by_row(vf)
            z = w0 + b.by_row(w[b.flat]) + 0.5 * ((s * s).sum(axis=0) - b.by_row((vf * vf).sum(axis=0)))
            error = ((1 / (1 + np.exp(-np.clip(z, -80, 80))) - b.label) / len(b.label)).astype(np.float32)
            e = error[b.row]
            gw, gv = b.by_feature(e), b.by_feature(e * (s[:, b.row] - vf))
            seen_w[b.used] += gw**2
            seen_v[b.used] += (gv**2).mean(axis=0)
            seen_0 += float(error.sum()) ** 2
            rate, factor_rate = RATE / np.sqrt(seen_w[b.used]), FACTOR_RATE / np.sqrt(seen_v[b.used])
            moved = w[b.used] - rate * gw
            w[b.used] = np.sign(moved) * np.maximum(np.abs(moved) - rate * (SHRINK / len(b.label)), 0)
            moved = v[:, b.used] - factor_rate * gv
            size = np.maximum(np.sqrt((moved * moved).sum(axis=0)), 1e-12)
            v[:, b.used] = moved * np.maximum(1 - factor_rate * (FACTOR_SHRINK / len(b.label)) / size, 0)
            w0 -= RATE * float(error.sum()) / seen_0**0.5
        if epoch >= epochs - AVERAGED:
            machine.bias += w0 / AVERAGED
            machine.linear += w / AVERAGED
            machine.factors += v.T / AVERAGED
    return machine


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine | None:
    """Fit on the sampled labelled documents of the other folds; only their term numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in common.small_batches(batches, 256):
            found = [np.array(sorted(terms(t or "", cache)), "<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("_label").cast(pa.int32()), pa.array(found, pa.binary())],
                names=["doc_id", "label", "terms"],
            )

    learn = labels.where(fold(F.col("doc_id")) != HELD_OUT_FOLD)
    rows = common.labelled_sample(docs, learn, "toxic", per_class).mapInArrow(run, "doc_id long, label int, terms binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.terms))
    return fit([(r.label, np.frombuffer(r.terms, "<i4").astype(np.int64)) for r in rows])


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in common.small_batches(batches):
            scores = []
            for text in batch.column("text").to_pylist():
                own = terms(text or "", cache) if machine else ()
                scores.append(machine.score(np.array(sorted(own), dtype=np.int64)) if machine else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return score(docs, train(docs, common.read(spark, sf_dir, "labels")))
