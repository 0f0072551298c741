"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and perplexity limits by language.

Symbols are characters as they are (code points of 16 bits; the few beyond share a private range), n-grams have ``ORDER`` of them in
a 64-bit code, and every document is padded at both ends. Trusted text is every document labelled quality 1.

1. Each task counts its trusted n-grams by language; the counts are summed in a table sharded by n-gram.
2. Continuation counts, discounts, context totals and probabilities come from joins of these sharded tables.
3. Documents are packed once; the packs, compressed, are written to a table bucketed by pack and read again from there, so the order of the input
   does not matter and texts are never shuffled. A pack asks for its distinct n-grams; the distinct n-grams of all packs are given
   their log-probability by joins, with the lower orders where an n-gram was never seen, and are cut into shards of about ``SHARD_ROWS``.
   A shard goes once to each ``SHARD_PACKS`` packs of its language and is kept there while their requests pass; each answer
   returns to its pack, where the documents are summed. Requests travel as compressed differences, answers without their
   n-grams, which the pack finds again in its texts.
4. One fold of ``FOLDS`` of the trusted documents, by a hash of the text, so copies share it, is held out of the counts. A language's
   limit is the ``QUANTILE`` of the log-perplexity of its held-out documents, which the model has not seen. A
   language with fewer than ``LEAST_TRUSTED`` of them, whose own quantile is not determined, has at least its median times the pooled
   limit, which is that quantile of the ratio to the median over all languages. A document above the limit is rejected.

What is gathered grows with the text: counts cover all trusted documents and requests all documents. The number of shards follows from
the count of distinct n-grams, so a shard's rows are bounded, as are a pack's; no other key's rows are collected.

Defined results: a null or empty text has no perplexity and is rejected; a null language is a language of its own; a language
without held-out trusted documents is not judged and its documents with text stay; repeated rows get equal results, and rows that
share a doc_id are trusted together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common

ORDER, BITS = 4, 16
#: Distinct n-grams in a shard at most, about, and how many packs are answered by one copy of it, about.
SHARD_ROWS, SHARD_PACKS = 100_000, 1024
QUANTILE = 0.99
FOLDS, HELD, LEAST_TRUSTED = 4, 0, 100
#: A table with a row a language is broadcast up to this many rows, as a shuffle by language has a task for each.
BROADCAST_LANGUAGES = 10_000
#: Characters that a task counts at once.
COUNTED = 2_000_000
#: Bytes of a pack's texts at most, if its last document does not pass it.
PACK_CHARS = 16_000_000
#: Where code points beyond 16 bits are put, and how many places they share.
_PRIVATE, _PLACES = 0xE000, 0x1900


def folded(text: str) -> np.ndarray:
    """16-bit symbols of the text; 0 is the padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((points > 0) & (points < 0x10000), points, _PRIVATE + points % _PLACES).astype(np.uint16)


def codes(symbols: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol and at the end's padding, the last symbol in the lowest bits."""
    pad = np.zeros(ORDER - 1, np.uint64)
    s = np.concatenate([pad, symbols.astype(np.uint64), pad[:1]])
    n = len(symbols) + 1
    out = s[:n].copy()
    for k in range(1, ORDER):
        out = (out << np.uint64(BITS)) | s[k : k + n]
    return out.view(np.int64)


#: Fixed values of the 64-bit hash that Spark's xxhash64 computes of a long, and its seed.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = np.uint64(42)


def shards_of(rows: int) -> int:
    """Shards for so many distinct n-grams, a power of two."""
    return 1 << max(0, -(-rows // SHARD_ROWS) - 1).bit_length()


def shard_of(code: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each code, as ``_shard`` tells it."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    h = turned(code.view(np.uint64) * _P2, 31) * _P1 ^ (_SEED + _P5 + np.uint64(8))
    h = turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return ((h ^ (h >> np.uint64(32))) & np.uint64(shards - 1)).astype(np.int32)


def _shard(code: Column, shards: int) -> Column:
    return F.xxhash64(code).bitwiseAND(F.lit(shards - 1)).cast("int")


def suffix_of(code: Column, symbols: int) -> Column:
    return code.bitwiseAND(F.lit((1 << BITS * symbols) - 1 if symbols < ORDER else -1))


def fold_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) % FOLDS


def counted(trusted: DataFrame) -> DataFrame:
    """(lang, code, n) over the trusted documents (lang, text) that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])
            held.clear()

        for batch in common.small_batches(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and fold_of(text) != HELD:
                    held.setdefault(lang, []).append(codes(folded(text)))
                    size += len(text)
            if size > COUNTED:
                yield from flush()
                size = 0
        yield from flush()
        common.give_back()

    return trusted.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _by_language(table: DataFrame, languages: int) -> DataFrame:
    return F.broadcast(table) if languages <= BROADCAST_LANGUAGES else table


def model(counts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """For k = 1..ORDER: probabilities (lang, code, p) of seen k-grams, and back-off weights (lang, code, bow) of contexts.

    Last, what a symbol weighs below all orders, (lang, floor): one in as many as the model's symbols and one for all others.
    """
    orders = [common.checkpointed(counts)]
    rows = orders[0].count()
    for k in range(ORDER - 1, 0, -1):
        shorter = orders[0].groupBy("lang", suffix_of(F.col("code"), k).alias("code")).agg(F.count("*").alias("n"))
        orders.insert(0, common.checkpointed(shorter, rows))
    floors = common.checkpointed(orders[0].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("floor")), rows)
    languages = floors.count()
    probs, weights = [], []
    for k, grams in enumerate(orders, 1):
        few = lambda i: F.count_if(F.col("n") == i)
        y = F.try_divide(few(1), few(1) + 2 * few(2))
        cut = [F.coalesce(F.greatest(F.least(i - (i + 1) * y * F.try_divide(few(i + 1), few(i)), F.lit(float(i))), F.lit(0.05)), F.lit(0.5)) for i in (1, 2, 3)]
        cuts = grams.groupBy("lang").agg(*(c.alias(f"d{i}") for i, c in enumerate(cut, 1)))
        own = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.least(own, F.col("n").cast("double"))
        context = F.shiftrightunsigned("code", BITS).alias("context")
        cutted = common.checkpointed(grams.join(_by_language(cuts, languages), "lang").select("lang", "code", context, "n", own.alias("d")), rows)
        totals = cutted.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        totals = common.checkpointed(totals.select("lang", "context", "total", (F.col("left") / F.col("total")).alias("bow")), rows)
        joined = cutted.join(totals, ["lang", "context"])
        if k == 1:
            lower = joined.join(_by_language(floors, languages), "lang").withColumnRenamed("floor", "low")
        else:
            below = probs[-1].select("lang", F.col("code").alias("suffix"), F.col("p").alias("low"))
            lower = joined.withColumn("suffix", suffix_of(F.col("code"), k - 1)).join(below, ["lang", "suffix"])
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("bow") * F.col("low")
        probs.append(common.checkpointed(lower.select("lang", "code", p.alias("p")), rows))
        weights.append(totals.select("lang", F.col("context").alias("code"), "bow"))
        common.release(grams, cutted)
    return probs, weights, floors


def resolved(asked: DataFrame, rows: int, probs: list[DataFrame], weights: list[DataFrame], floors: DataFrame) -> DataFrame:
    """(lang, code, logp) of ``rows`` distinct n-grams (lang, code), backing off where one was not seen."""
    out = asked.withColumn("logp", F.lit(None).cast("double")).withColumn("off", F.lit(0.0))
    held: list[DataFrame] = []
    for k in range(ORDER, 0, -1):
        out = out.withColumn("gram", suffix_of(F.col("code"), k)).withColumn("context", F.shiftrightunsigned("gram", BITS))
        p = probs[k - 1].select("lang", F.col("code").alias("gram"), "p")
        w = weights[k - 1].select("lang", F.col("code").alias("context"), "bow")
        out = out.join(p, ["lang", "gram"], "left").join(w, ["lang", "context"], "left")
        out = out.select(
            "lang",
            "code",
            F.coalesce("logp", F.col("off") + F.log("p")).alias("logp"),
            (F.col("off") + F.coalesce(F.log("bow"), F.lit(0.0))).alias("off"),
        )
        before, out = held, common.checkpointed(out, rows)
        held = [out]
        common.release(*before)
    out = out.join(_by_language(floors, floors.count()), "lang", "left")
    return out.select("lang", "code", F.coalesce("logp", F.col("off") + F.log(F.coalesce("floor", F.lit(2.0**-BITS)))).alias("logp"))


class _Distinct:
    """Distinct codes, gathered in bounded memory."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, code: np.ndarray) -> None:
        self.held.append(code)
        self.size += len(code)
        if self.size > 2_000_000 + 2 * len(self.held[0]):
            self.held = [self.all()]
            self.size = len(self.held[0])

    def all(self) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *self.held]))


_META = pa.schema([("doc_id", pa.int64()), ("bytes", pa.int64()), ("fold", pa.int8())])


def packed(docs: DataFrame) -> DataFrame:
    """(pack, lang, meta, texts) of rows (doc_id, lang, text): documents of one language, the texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list[bytes]]] = {}
        size, pack = 0, TaskContext.get().partitionId() << 24
        press = zstandard.ZstdCompressor(level=3)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pack
            for lang, (meta, texts) in held.items():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _META) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*meta, strict=True), _META.types, strict=True)], schema=_META))
                columns = [pa.array([pack], pa.int64()), pa.array([lang]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([press.compress(b"".join(texts))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["pack", "lang", "meta", "texts"])
                pack += 1
            held.clear()

        for batch in common.small_batches(batches):
            for doc_id, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                meta, texts = held.setdefault(lang, ([], []))
                meta.append((doc_id, len(raw), fold_of(text or "")))
                texts.append(raw)
                size += len(raw)
                if size >= PACK_CHARS:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("doc_id", "lang", "text").mapInArrow(run, "pack long, lang string, meta binary, texts binary")


def bucketed(packs: DataFrame) -> tuple[DataFrame, int, Callable[[], None]]:
    """The packs as a table in the checkpoint folder, in as many buckets as a shuffle has partitions, and what deletes it."""
    spark = packs.sparkSession
    name = f"packs_{uuid.uuid4().hex}"
    path = f"{common.ensure_checkpoint_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs.write.bucketBy(buckets, "pack").option("path", path).option("compression", "none").saveAsTable(name)

    def delete() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        common.remove(spark, path)

    return spark.table(name), buckets, delete


def _documents(meta: bytes, texts: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, fold, symbols) of a pack's documents."""
    table = pa.ipc.open_stream(meta).read_all()
    raw, at = zstandard.ZstdDecompressor().decompress(texts), 0
    for doc_id, size, fold in zip(*(table.column(c).to_pylist() for c in ("doc_id", "bytes", "fold")), strict=True):
        yield doc_id, fold, folded(raw[at : at + size].decode("utf-8", "surrogatepass"))
        at += size


def _asked(meta: bytes, texts: bytes) -> np.ndarray:
    """A pack's distinct n-grams, sorted."""
    held = _Distinct()
    for _, _, symbols in _documents(meta, texts):
        if len(symbols):
            held.add(codes(symbols))
    return held.all()


def _pressed(code: np.ndarray) -> bytes:
    """Sorted codes as compressed differences, byte planes apart."""
    steps = np.diff(code, prepend=code.dtype.type(0)).astype("<i8")
    return zstandard.ZstdCompressor(level=3).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _opened(pressed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(pressed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def requests(packs: DataFrame) -> DataFrame:
    """(pack, lang, codes): the distinct n-grams of each pack, sorted, as ``_pressed`` makes them; packs without any have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, 1):
            row = batch.to_pylist()[0]
            code = _asked(row["meta"], row["texts"])
            if len(code):
                columns = [batch.column("pack"), batch.column("lang"), pa.array([_pressed(code)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["pack", "lang", "codes"])

    return packs.mapInArrow(run, "pack long, lang string, codes binary")


def _distinct(asked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, 8):
            seen: dict[str, list[np.ndarray]] = {}
            for lang, pressed in zip(batch.column("lang").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                seen.setdefault(lang, []).append(_opened(pressed))
            for lang, parts in seen.items():
                code = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code, pa.int64())], names=["lang", "code"])

    return asked.mapInArrow(run, "lang string, code long").distinct()


def sliced(asked: DataFrame, shards: int) -> DataFrame:
    """(pack, lang, shard, codes): the requests, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, 1):
            code = _opened(batch.column("codes")[0].as_py())
            shard = shard_of(code, shards)
            order = np.argsort(shard, kind="stable")
            code, ends = code[order], np.searchsorted(shard[order], np.arange(shards + 1))
            some = np.flatnonzero(ends[:-1] < ends[1:])
            parts = pa.array([_pressed(code[ends[s] : ends[s + 1]]) for s in some], pa.binary())
            pack, lang = (pa.array(batch.column(c).to_pylist() * len(some), t) for c, t in (("pack", pa.int64()), ("lang", pa.string())))
            yield pa.RecordBatch.from_arrays([pack, lang, pa.array(some, pa.int32()), parts], names=["pack", "lang", "shard", "codes"])

    return asked.mapInArrow(run, "pack long, lang string, shard int, codes binary")


def answers(asked: DataFrame, scored: DataFrame, shards: int) -> DataFrame:
    """(pack, shard, logps): to each request the log-probabilities in its order, little-endian 32-bit floats."""
    entry = F.struct("code", F.col("logp").cast("float").alias("logp"))
    known = scored.groupBy("lang", _shard(F.col("code"), shards).alias("shard")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    copies = common.checkpointed(asked.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_PACKS).cast("int").alias("copies")))
    languages = copies.count()
    known = known.join(_by_language(copies, languages), "lang").select(
        "lang", "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("pack"),
        F.col("entries.code").alias("known"), F.col("entries.logp").alias("logp"), F.lit(None).cast("binary").alias("codes"),
    )
    asking = sliced(asked, shards).join(_by_language(copies, languages), "lang").select(
        "lang", "shard", F.pmod(F.xxhash64("pack"), F.col("copies")).cast("int").alias("copy"), "pack",
        F.lit(None).cast("array<long>").alias("known"), F.lit(None).cast("array<float>").alias("logp"), "codes",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = logp = np.zeros(0)
        for batch in common.small_batches(batches, 64):
            packs, shard, out = [], [], []
            for i, (pack, s) in enumerate(zip(batch.column("pack").to_pylist(), batch.column("shard").to_pylist(), strict=True)):
                if pack is None:  # a shard, which its requests follow
                    known, logp = (np.array(batch.column(c)[i].values) for c in ("known", "logp"))
                    continue
                asks = _opened(batch.column("codes")[i].as_py())
                packs.append(pack)
                shard.append(s)
                out.append(logp[np.searchsorted(known, asks)].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array(shard, pa.int32()), pa.array(out, pa.binary())], names=["pack", "shard", "logps"])

    keys = ("lang", "shard", "copy")
    both = known.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, F.col("pack").asc_nulls_first())
    return both.mapInArrow(run, "pack long, shard int, logps binary")


def perplexities(packs: DataFrame, buckets: int, replies: DataFrame, shards: int) -> DataFrame:
    """(doc_id, lang, fold, n, logp) for each document; a pack's answers go to its bucket, the packs stay where they are."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int8(), pa.int64(), pa.float64())
        for batch in common.small_batches(batches, 1):
            row = batch.to_pylist()[0]
            known = _asked(row["meta"], row["texts"])
            logp = np.empty(len(known), "<f4")
            logp[np.argsort(shard_of(known, shards), kind="stable")] = np.frombuffer(b"".join(row["parts"] or ()), "<f4")
            out = []
            for doc_id, fold, symbols in _documents(row["meta"], row["texts"]):
                total = float(logp[np.searchsorted(known, codes(symbols))].sum(dtype=np.float64)) if len(symbols) else None
                out.append((doc_id, row["lang"], fold, len(symbols), total))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "lang", "fold", "n", "logp"])

    parts = F.sort_array(F.collect_list(F.struct("shard", "logps")))
    replied = replies.repartition(buckets, "pack").groupBy("pack").agg(parts.alias("parts")).select("pack", F.col("parts.logps").alias("parts"))
    met = packs.join(replied, "pack", "left").select("lang", "meta", "texts", "parts")
    return met.mapInArrow(summed, "doc_id long, lang string, fold byte, n long, logp double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_symbols, log_perplexity, limit, kept): one row per row of docs."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("\x00"))
    source = docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), F.col("text").cast("string"))
    good = common.checkpointed(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct())
    packs, buckets, delete = bucketed(packed(source))
    try:
        probs, weights, floors = model(counted(common.among(source, good).select("lang", "text")))
        asked = common.checkpointed(requests(packs))
        distinct = common.checkpointed(_distinct(asked))
        found = distinct.count()
        scored = common.checkpointed(resolved(distinct, found, probs, weights, floors), found)
        common.release(distinct, floors, *probs)
        rows = common.checkpointed(perplexities(packs, buckets, answers(asked, scored, shards_of(found)), shards_of(found)))
        common.release(asked, scored)
    finally:
        delete()
    value = -F.col("logp") / (F.col("n") + 1)
    rows = rows.select("doc_id", "lang", "fold", F.col("n").alias("n_symbols"), value.alias("log_perplexity"))
    unseen = common.among(rows.where((F.col("fold") == HELD) & F.col("log_perplexity").isNotNull()), good).select("lang", F.col("log_perplexity").alias("_unseen"))
    own = F.percentile_approx("_unseen", [0.5, quantile], 10000)
    q = common.checkpointed(unseen.groupBy("lang").agg(own.alias("q"), F.count("*").alias("n")).select("lang", F.col("q")[0].alias("mid"), F.col("q")[1].alias("top"), "n"))
    languages = q.count()
    ratio = unseen.join(_by_language(q, languages), "lang").select((F.col("_unseen") / F.col("mid")).alias("ratio"))
    pooled = ratio.agg(F.percentile_approx("ratio", quantile, 10000)).first()[0]
    limit = F.when(F.col("n") >= LEAST_TRUSTED, F.col("top")).otherwise(F.greatest("top", F.col("mid") * F.lit(pooled)))
    q = q.select("lang", limit.alias("limit"))
    out = rows.join(_by_language(q, languages), "lang", "left")
    kept = F.col("log_perplexity").isNotNull() & F.coalesce(F.col("log_perplexity") <= F.col("limit"), F.lit(True))
    return out.select("doc_id", F.nullif("lang", F.lit("\x00")).alias("lang"), "n_symbols", "log_perplexity", "limit", kept.alias("kept"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
