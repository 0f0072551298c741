"""Quality rules: text statistics with fixed limits, then a hashed n-gram logistic regression.

Words are runs of characters other than space, tab and line breaks. Features are hashed word 1-grams, word 2-grams and
character 3-grams, each kind as shares of its own count, so a text's length does not move its score. The model is
fitted on a bounded sample of labelled rows (``SAMPLE_PER_CLASS``), its probability calibrated by Platt's method on rows
held out of the fit, and every whole text is scored in Arrow batches against the fixed threshold ``KEEP_AT``.

Cost: one narrow pass over the documents; only the bounded sample of ids is broadcast, and the model (a few MB, its
size set by ``BITS``) travels in the task's closure.

Defined results: a null or empty text has no words and fails the base rules; repeated rows get equal results; without
labels of both classes there is no model, ``probability`` is null and the base rules decide alone; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import common

#: Each kind of n-gram has 2**BITS buckets.
BITS = 16
KINDS = 3
SAMPLE_PER_CLASS = 1500
EPOCHS, RATE, PENALTY, GAIN = 80, 0.1, 1e-4, 20.0
#: Fixed limits.
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_AT = 10, 20, 0.5

SYMBOLS = "#*$%&|<>"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def repeated_words(hashes: np.ndarray, window: int = 5) -> int:
    """Words that lie in a window of words which occurs twice or more; overlapping windows count a word once."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    mix = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(29)))
    order = np.argsort(mix, kind="stable")
    same = mix[order][1:] == mix[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: bytes, words: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 text and its words' hashes."""
    raw = np.frombuffer(text, dtype=np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return points - int(_SPACE[raw].sum()), int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated_words(words)


def hashed(text: bytes, words: np.ndarray) -> list[np.ndarray]:
    """Bucket numbers of each kind of n-gram, one for each occurrence, kinds apart."""
    size, shift = 1 << BITS, np.uint32(32 - BITS)
    one = (words >> np.uint64(32)).astype(np.uint32)
    two = one[:-1] * np.uint32(0x9E3779B1) + one[1:]
    raw = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    three = (raw[:-2] * np.uint32(0x01000193) + raw[1:-1]) * np.uint32(0x01000193) + raw[2:] if len(raw) > 2 else raw[:0]
    return [(x * np.uint32(0x85EBCA6B) >> shift).astype(np.int64) + k * size for k, x in enumerate((one, two, three))]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, kinds: list[np.ndarray]) -> float:
        return self.bias + GAIN * sum(float(self.weights[x].mean()) for x in kinds if len(x))

    def probability(self, kinds: list[np.ndarray]) -> float:
        z = np.clip(self.slope * self.margin(kinds) + self.shift, -500, 500)
        return float(1 / (1 + np.exp(-z)))


def _sparse(kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    index, share = [], []
    for x in kinds:
        if len(x):
            i, c = np.unique(x, return_counts=True)
            index.append(i)
            share.append(GAIN * c / len(x))
    return (np.concatenate(index), np.concatenate(share)) if index else (np.zeros(0, np.int64), np.zeros(0))


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 500) -> tuple[float, float]:
    """Slope and shift of the logistic that maps held-out margins to probabilities, with Platt's smoothed targets."""
    good, bad = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b, scale = 1.0, 0.0, max(1.0, float(np.abs(margin).max(initial=1.0)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        a -= 2 * float(((p - target) * margin).mean()) / scale**2
        b -= 2 * float((p - target).mean())
    return max(a, 1e-3), b


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model | None:
    """Logistic regression by Adam on (label, bucket numbers, values); every fourth row is held out for calibration."""
    train, held = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if not i % 4]
    if {r[0] for r in train} != {0, 1}:
        return None
    index, value = np.concatenate([r[1] for r in train]), np.concatenate([r[2] for r in train])
    row = np.repeat(np.arange(len(train)), [len(r[1]) for r in train])
    label = np.array([r[0] for r in train], dtype=float)
    weigh = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / len(train)
    w, b = np.zeros(KINDS << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = np.bincount(row, weights=w[index] * value, minlength=len(train)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) * weigh
        grad = np.bincount(index, weights=error[row] * value, minlength=len(w)) + PENALTY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-6)
    model = Model(w.astype(np.float32), b)
    if held and {r[0] for r in held} == {0, 1}:
        margin = np.array([b + float((w[i] * x).sum()) for _, i, x in held])
        model.slope, model.shift = platt(margin, np.array([r[0] for r in held]))
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` labelled documents of each class; only their hashed counts reach the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, 256):
            out = [_sparse(hashed(t, common.word_hashes(np.frombuffer(t, np.uint8)))) for t in common.text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("_label").cast(pa.int32()),
                    pa.array([i.astype("<i4").tobytes() for i, _ in out], pa.binary()),
                    pa.array([x.astype("<f4").tobytes() for _, x in out], pa.binary()),
                ],
                names=["doc_id", "label", "i", "x"],
            )

    sample = common.labelled_sample(docs, labels, "quality", per_class)
    rows = sample.mapInArrow(features, "doc_id long, label int, i binary, x binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.i))
    return fit([(r.label, np.frombuffer(r.i, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(float)) for r in rows])


def _fields() -> list[T.StructField]:
    kinds = {"long": T.LongType(), "double": T.DoubleType()}
    return [T.StructField(f"_q_{name}", kinds[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))]


def _scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with the statistics and the probability in columns _q_...; columns of those names are replaced."""

    def make(column: Callable[[str], pa.Array]) -> list[pa.Array]:
        rows = []
        for text in common.text_bytes(column("text").cast(pa.string())):
            words = common.word_hashes(np.frombuffer(text, np.uint8))
            rows.append((len(words), *statistics(text, words), model.probability(hashed(text, words)) if model else None))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 5 + [pa.float64()], strict=True)]

    return common.carried(docs, _fields(), make)


def _verdicts() -> tuple[Column, Column]:
    n = F.col("_q_n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return failed, ~failed & F.coalesce(F.col("_q_probability") >= KEEP_AT, F.lit(True))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, the statistics, probability, base_failed and kept."""
    failed, kept = _verdicts()
    own = [F.col(f.name).alias(f.name[3:]) for f in _fields()]
    out = _scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    return out.select("doc_id", *own, failed.alias("base_failed"), kept.alias("kept"))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The whole rows of the documents that are kept."""
    return _scored(docs, model).where(_verdicts()[1]).drop(*(f.name for f in _fields()))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
