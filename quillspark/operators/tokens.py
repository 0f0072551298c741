"""Training examples as token ids: truncation, label masks, and padded batches of like lengths.

Defined results: null texts are empty; ids past the limits are cut; texts are encoded as ordinary text, without special tokens, so that a special token's string is
no special token. Any order and partitioning of rows gives the same ids; which rows share a batch depends on the partitioning alone, and every row is in one batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values
MAX_INPUT, MAX_TARGET, MASKED = 1024, 384, -100
SLICE = 256
#: Pieces of texts whose ids a worker remembers before it forgets them all.
PIECES = 200_000


class Encoder:
    """The first ids of a text, as the tokenizer file's own library gives them for the whole.

    A byte-level byte-pair vocabulary never joins what a single space divides, so pieces are encoded one by one until there are ids enough, and remembered.
    A text with another layout of white space so far, and any other kind of vocabulary, is encoded whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.whole.encode_special_tokens = True
        with open(vocabulary, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.pieces = plain and kind["model"]["type"] == "BPE" and kind.get("normalizer") is None and all(t["special"] for t in kind.get("added_tokens", []))
        self.known: dict[str, list[int]] = {}

    def _encoded(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def first(self, text: str, most: int) -> list[int]:
        if not self.pieces:
            return self._encoded(text)[:most]
        out, end = [], -1
        while len(out) < most and end < len(text):
            start, end = end + 1, text.find(" ", end + 1)
            end = len(text) if end < 0 else end
            piece = text[start:end]
            if not piece or piece[0].isspace() or piece[-1].isspace():
                return self._encoded(text)[:most]
            piece = f" {piece}" if start else piece
            ids = self.known.get(piece)
            if ids is None:
                if len(self.known) >= PIECES:
                    self.known.clear()
                ids = self.known[piece] = self._encoded(piece)
            out += ids
        return out[:most]


def tokenised(rows: DataFrame, input: str, output: str, vocabulary: str, prefix: str = "", max_input: int = MAX_INPUT, max_target: int = MAX_TARGET) -> DataFrame:
    """rows with ``input_ids`` of prefix and input, and ``labels`` of the output.

    ``vocabulary`` is the path of a tokenizer file that every executor has.
    """
    names = [f"c{i}" for i in range(len(rows.columns))]
    at = [(rows.columns.index(input), max_input, prefix), (rows.columns.index(output), max_target, "")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                made = []
                for i, most, first in at:
                    texts = [first + (t or "") for t in batch.column(i).to_pylist()]
                    ids = [encoder.first(t, most) for t in texts]
                    made.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "input_ids", "labels"])

    named = rows.toDF(*names)
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([*named.schema.fields, T.StructField("input_ids", ids), T.StructField("labels", ids)])
    return named.mapInArrow(run, schema).toDF(*rows.columns, "input_ids", "labels")


def batches(tokens: DataFrame, key: str, size: int = 8, pad: int = 0, partitions: int | None = None) -> DataFrame:
    """Batches of at most ``size`` rows (key, input_ids, labels) of like lengths, padded to the longest of the batch.

    Columns: keys, input_ids and attention_mask (row after row, in one array each), labels (MASKED where padded), rows, width and label_width. Rows are dealt evenly, whatever their
    keys are, and sorted by length inside a partition, so only a partition's last batch is short.
    """
    sized = tokens.select(F.col(key).cast("string").alias("key"), "input_ids", "labels", F.size("input_ids").alias("n"), F.size("labels").alias("m"))
    dealt = sized.repartition(partitions or max(1, sized.sparkSession.sparkContext.defaultParallelism))
    ordered = dealt.sortWithinPartitions("n", "m", "key", "input_ids", "labels")

    def padded(lists: list[list[int]], fill: int) -> tuple[list[int], int]:
        width = max(map(len, lists))
        out = np.full((len(lists), width), fill, dtype=np.int32)
        for i, x in enumerate(lists):
            out[i, : len(x)] = x
        return out.ravel(), width

    def one(rows: list[dict]) -> pa.RecordBatch:
        ids, width = padded([r["input_ids"] for r in rows], pad)
        mask, _ = padded([[1] * r["n"] for r in rows], 0)
        labels, label_width = padded([r["labels"] for r in rows], MASKED)
        made = {"keys": [[r["key"] for r in rows]], "input_ids": [ids], "attention_mask": [mask], "labels": [labels], "rows": [len(rows)], "width": [width], "label_width": [label_width]}
        return pa.RecordBatch.from_pydict(made, schema=kind)

    numbers = pa.list_(pa.int32())
    kind = pa.schema([("keys", pa.list_(pa.string())), *((n, numbers) for n in ("input_ids", "attention_mask", "labels")), *((n, pa.int32()) for n in ("rows", "width", "label_width"))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in source:
            for at in range(0, b.num_rows, SLICE):
                for row in b.slice(at, SLICE).to_pylist():
                    held.append(row)
                    if len(held) == size:
                        yield one(held)
                        held = []
        if held:
            yield one(held)

    return ordered.mapInArrow(run, "keys array<string>, input_ids array<int>, attention_mask array<int>, labels array<int>, rows int, width int, label_width int")
