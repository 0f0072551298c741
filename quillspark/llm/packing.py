"""Packing by power-of-two decomposition.

A document's token ids are cut from the front into pieces of ``max_length`` and then into the powers of two of the
rest's binary form, largest first. Pieces of one length form a bucket, and a training batch takes sequences of one
bucket, so every sequence is exactly one piece: nothing is padded and no sequence crosses documents.

The plan is one narrow pass (scan, tokenize in Arrow batches, number the pieces): no shuffle, so no key can be hot.

Defined results: a null or empty text is the end-of-document id alone (one piece of length 1); repeated rows are packed
once each; a null doc_id stays null; an empty table gives no pieces; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"
#: Entries kept in a worker's chunk cache before it is emptied.
CACHE_ENTRIES = 400_000


class ByteBpe:
    """Ids of a byte-level BPE: the json file's own library is the definition; its rank file is a faster equal path.

    Chunks between single spaces never share a token with their neighbours, so their ids are cached. A text with
    another white-space layout, or with the string of a special token, takes the plain path. The json file's library is
    held only from the first text that needs it until ``forget``, as a worker keeps this object between tasks.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.forget()

    @cached_property
    def plain(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def forget(self) -> None:
        """Drop what grew with the texts, and the plain library; both come back when they are asked for."""
        self.known = {}
        self.__dict__.pop("plain", None)
        common.give_back()

    def _chunk(self, chunk: str) -> bytes:
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        ids = self.known[chunk] = np.array(self.fast.encode_ordinary(" " + chunk), dtype="<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        if not first or any(not c or c[0].isspace() or c[-1].isspace() for c in rest) or first[-1].isspace():
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        known, chunk = self.known, self._chunk
        head = np.array(self.fast.encode_ordinary(first), dtype="<u4").tobytes()
        return head + b"".join([known.get(c) or chunk(c) for c in rest])


@cache
def _bpe(json_path: str, ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(json_path, ranks_path, pattern)


def cuts(n: int, max_length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    whole, rest = divmod(n, max_length)
    out = [(i * max_length, max_length) for i in range(whole)]
    start = whole * max_length
    while rest:
        length = 1 << (rest.bit_length() - 1)
        out.append((start, length))
        start, rest = start + length, rest - length
    return out


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, end_id: int = 1, max_length: int = 2048) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset); ids are little-endian uint32."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(json_path, ranks_path, pattern)
        for batch in common.small_batches(batches, 256):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (bpe.encode(text) if text else b"") + end
                n = len(ids) // 4
                rows += [(doc_id, s, k, ids[4 * s : 4 * (s + k)], n) for s, k in cuts(n, max_length)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            names = ("doc_id", "start", "length", "ids", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        rows = columns = None
        bpe.forget()

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
    return pieces.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def packed(docs: DataFrame) -> DataFrame:
    """pack() with the production tokenizer."""
    import public_tokenizers as public

    return pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
