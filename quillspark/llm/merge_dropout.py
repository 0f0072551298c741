"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A text is cut into segments (spaces, then a run without spaces); no piece of the vocabulary crosses a segment's end. In
each segment the agenda of byte-pair merging is processed: the candidate of best rank, leftmost first, is taken from the
agenda; a keyed hash of (seed, variant, step, place, piece) decides whether it is skipped, otherwise its two
symbols merge and their new neighbours become candidates. What is left is the segmentation; characters without a piece
become byte pieces. ``variant`` is a keyed hash of the document's id, moved on by the segment's number in its text, so each
occurrence of a word is cut on its own. With dropout 0 the ids are those of the plain encoder.

A segment's agenda without any skip, its path, does not depend on the occurrence; a worker remembers it, up to ``KNOWN`` segments. An occurrence whose hashes skip
none of the path's merges has the plain ids; every other one has its agenda processed with its own hashes. These are processed side
by side as arrays, one step of every segment's agenda at a time; segments of ``WIDE`` symbols and more one by one with a heap.

Defined results: a null or empty text has no ids and decodes to the empty text; a null doc_id hashes as an empty string; the vocabulary's
mark for a space is written as bytes where a text holds it itself; repeated rows get equal ids; an empty table gives no
rows; other columns are kept by ``encode`` and ``decode``, which replace columns of the names they add.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import common

SEED, DROPOUT = 20240607, 0.1
WIDE, KNOWN, _STRIDE = 40, 200_000, 0x9E3779B97F4A7C15
SPACE = "▁"
_SEGMENT = re.compile(r" *[^ ]+| +")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(key: np.ndarray, step: np.ndarray | int, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Keyed 32-bit hashes."""
    x = key ^ (np.asarray(step, np.uint64) * _M1 + place.astype(np.uint64) * _M2 + piece.astype(np.uint64) * _M3)
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x >> np.uint64(32)


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses the start of a word")
        self.char = {p: i for p, i in pieces.items() if len(p) == 1}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = sorted(plain, key=lambda i: -sp.get_score(i))
        self.rank = np.full(n + 1, n + 1, dtype=np.int32)
        self.rank[order] = np.arange(len(order))
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * 65536 + b] = i
        self.pairs = pairs
        self.none = n
        self._hash(np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int32))
        self.point = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.char.items():
            self.point[ord(c)] = i
        self.point[ord(" ")], self.point[ord(SPACE)] = self.char.get(SPACE, -1), -1
        self.text = [b""] * n
        for p, i in pieces.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])

    def _hash(self, keys: np.ndarray, made: np.ndarray) -> None:
        """An open-addressing table of the pairs, at most an eighth full."""
        bits = max(8, int(len(keys)).bit_length() + 3)
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self.keys, self.made = np.full(self.slots, -1, dtype=np.int64), np.full(self.slots, self.none, dtype=np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]  # of several for one slot the last stays
            won = self.keys[at[left]] == keys[left]
            self.made[at[left[won]]] = made[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) % self.slots

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _M1) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or ``none``."""
        key = left.astype(np.int64) * 65536 + right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        got = self.keys[at]
        out = np.where(got == key, self.made[at], np.int32(self.none))
        flat, far = key.ravel(), np.flatnonzero((got != key) & (got >= 0) & (key >= 0))
        at, result = at.ravel(), out.ravel()
        while len(far):
            at[far] = (at[far] + 1) % self.slots
            got = self.keys[at[far]]
            hit = got == flat[far]
            result[far[hit]] = self.made[at[far[hit]]]
            far = far[~hit & (got >= 0)]
        return result.reshape(key.shape)


def _keys(variant: np.ndarray, seed: int) -> np.ndarray:
    """64-bit keys of variants."""
    x = (variant ^ np.uint64(seed * _STRIDE % 2**64)) * _M2
    x = (x ^ (x >> np.uint64(31))) * _M3
    return x ^ (x >> np.uint64(29))


class Encoder:
    def __init__(self, path: str, seed: int, dropout: float):
        self.vocabulary = Vocabulary(path)
        self.seed, self.limit = seed, np.uint64(round(dropout * 2**32))
        self._forget()

    def _forget(self) -> None:
        """Of known segments: number, plain ids, and where its path starts in the paths' places and pieces."""
        self.number: dict[str, int] = {}
        self.plain: list[bytes] = []
        self.first = np.zeros(1, np.int64)
        self.place, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def symbols(self, segment: str) -> tuple[list[int], list[str]]:
        """Vocabulary ids, -1 for a character without one, and the characters; only spaces become the space mark."""
        char = self.vocabulary.char
        marks = char.get(SPACE, -1)
        return [marks if c == " " else -1 if c == SPACE else char.get(c, -1) for c in segment], list(segment)

    def _ids(self, symbols: list[int], starts: list[int], chars: list[str]) -> bytes:
        out = []
        for s, at in zip(symbols, starts, strict=True):
            if s >= 0:
                out.append(s)
            else:
                out += [self.vocabulary.byte[b] for b in chars[at].encode("utf-8", "surrogatepass")]
        return np.array(out, dtype="<u2").tobytes()

    def alone(self, variant: int, segment: str) -> bytes:
        """One segment with a heap."""
        v, (ids, chars) = self.vocabulary, self.symbols(segment)
        n = len(ids)
        left, right, key = list(range(-1, n - 1)), [*range(1, n), -1], _keys(np.array([variant], dtype=np.uint64), self.seed)
        heap: list[tuple[int, int, int, int, int]] = []

        def push(a: int) -> None:
            b = right[a]
            if b >= 0 and ids[a] >= 0 and ids[b] >= 0 and (piece := v.pairs.get(ids[a] * 65536 + ids[b])) is not None:
                heapq.heappush(heap, (int(v.rank[piece]), a, piece, ids[a], ids[b]))

        for a in range(n):
            push(a)
        gone, step = [False] * n, 0
        while heap:
            _, a, piece, x, y = heapq.heappop(heap)
            b = right[a]
            if gone[a] or b < 0 or ids[a] != x or ids[b] != y:
                continue
            step += 1
            if _mixed(key, step, np.array([a]), np.array([piece]))[0] < self.limit:
                continue
            ids[a], gone[b], right[a] = piece, True, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            push(a)
            if left[a] >= 0:
                push(left[a])
        rest = [i for i in range(n) if not gone[i]]
        return self._ids([ids[i] for i in rest], rest, chars)

    def together(self, wanted: list[str], key: np.ndarray | None, path: list | None = None) -> list[bytes]:
        """Ids of segments of like length, one agenda step of each at a time. Without keys nothing is skipped; ``path`` then
        gets the segments' numbers, places and pieces of each step."""
        v, n = self.vocabulary, len(wanted)
        sizes = np.fromiter(map(len, wanted), dtype=np.int64, count=n)
        width = int(sizes.max()) + 1
        live = np.arange(width) < sizes[:, None]
        ids = np.full((n, width), -1, dtype=np.int32)
        points = np.frombuffer("".join(wanted).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ids[live] = v.point[points]
        place = np.arange(width, dtype=np.int32)
        right = np.where(place + 1 < sizes[:, None], place + 1, width - 1).astype(np.int32).ravel()
        left = np.tile(place - 1, (n, 1)).ravel()
        piece = np.full((n, width), v.none, dtype=np.int32)
        piece[:, :-1] = v.merged(ids[:, :-1], ids[:, 1:])
        ranks = v.rank[piece]
        # from here by cell: a row's first cell and the place; the views share the tables' memory
        ids, live, piece, rank = ids.ravel(), live.ravel(), piece.ravel(), ranks.ravel()
        row, step, never = np.arange(n), 0, v.rank[v.none]
        while len(row):
            step += 1
            at = (ranks if len(row) == n else ranks[row]).argmin(axis=1)
            cell = row * width + at
            best = piece[cell]
            some = best != v.none
            if not some.all():
                row, at, cell, best = row[some], at[some], cell[some], best[some]
            if not len(row):
                break
            if path is not None:
                path.append((row, at, best))
            first = row * width
            if key is not None:
                skip = _mixed(key[row], step, at, best) < self.limit
                if skip.any():
                    gone, kept = cell[skip], ~skip
                    piece[gone], rank[gone] = v.none, never
                    first, at, cell, best = first[kept], at[kept], cell[kept], best[kept]
            b = first + right[cell]
            after = right[b]
            ids[cell], ids[b], live[b] = best, -1, False
            right[cell] = after
            left[first + after] = at
            before = left[cell]
            piece[b], rank[b] = v.none, never
            # without a symbol before, the cell before the row is meant: the last one of a row, always empty
            earlier = first + before
            new = v.merged(np.concatenate([best, ids[earlier]]), np.concatenate([ids[first + after], best]))
            new[len(cell) :][before < 0] = v.none
            to = np.concatenate([cell, earlier])
            piece[to], rank[to] = new, v.rank[new]
        ids, live = ids.reshape(n, width), live.reshape(n, width)
        out, counts = ids[live], live.sum(axis=1)
        ends = np.cumsum(counts)
        raw, plain = out.astype("<u2").tobytes(), np.add.reduceat(out < 0, ends - counts) == 0
        found = [raw[end - count : end] if ok else b"" for end, count, ok in zip((2 * ends).tolist(), (2 * counts).tolist(), plain.tolist(), strict=True)]
        if len(odd := np.flatnonzero(~plain)):
            i, at = np.nonzero(live[odd])
            spelled, sizes_of = self._spelled(out[~np.repeat(plain, counts)], points[(np.cumsum(sizes) - sizes)[odd][i] + at])
            raw, ends = spelled.tobytes(), 2 * np.cumsum(np.bincount(i, weights=sizes_of).astype(np.int64))
            for k, begin, end in zip(odd.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                found[k] = raw[begin:end]
        return found

    def _spelled(self, symbols: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, byte pieces of their code points where there is no piece, and how many each symbol has."""
        known, byte = symbols >= 0, np.array(self.vocabulary.byte, dtype="<u2")
        sizes = np.where(known, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        first = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), "<u2")
        out[first[known]] = symbols[known]
        for k in range(4):
            has = ~known & (sizes > k)
            of = sizes[has]
            bits = points[has].astype(np.int64) >> 6 * (of - 1 - k)
            out[first[has] + k] = byte[bits & 0x3F | 0x80 if k else bits | np.array([0, 0, 0xC0, 0xE0, 0xF0])[of]]
        return out, sizes

    @staticmethod
    def parts(text: str) -> list[str]:
        """Segments without their first space."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [s[1:] for s in _SEGMENT.findall(" " + text)]
        return text.split(" ")

    def learn(self, parts: list[str]) -> None:
        """Remember the paths of segments, given without their first space, that are not known yet."""
        new = [p for p in dict.fromkeys(parts) if p not in self.number]
        if len(self.number) + len(new) > KNOWN and self.number:
            self._forget()
            new = list(dict.fromkeys(parts))
        if not new:
            return
        first, places, pieces = [self.first], [self.place], [self.piece]
        for some in _alike(new):
            steps: list = []
            self.plain += self.together([" " + p for p in some], None, steps)
            self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
            row, place, piece = (np.concatenate([x[k] for x in steps] or [np.zeros(0, np.int64)]) for k in range(3))
            order = np.argsort(row, kind="stable")  # steps stay in their order
            first.append(first[-1][-1] + np.cumsum(np.bincount(row, minlength=len(some))))
            places.append(place[order].astype(np.int32))
            pieces.append(piece[order].astype(np.int32))
        self.first, self.place, self.piece = (np.concatenate(x) for x in (first, places, pieces))

    def skipping(self, number: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether the keys skip a merge of their segments' paths."""
        first, steps = self.first[number], self.first[number + 1] - self.first[number]
        of = np.repeat(np.arange(len(number)), steps)
        step = np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)
        at = first[of] + step
        skip = _mixed(key[of], step + 1, self.place[at], self.piece[at]) < self.limit
        return np.bincount(of[skip], minlength=len(number)) > 0

    def cut(self, parts: list[str], variant: np.ndarray) -> list[bytes]:
        """Ids of segments, given without their first space."""
        out = [b""] * len(parts)
        wide = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) >= WIDE
        for i in np.flatnonzero(wide).tolist():
            out[i] = self.alone(int(variant[i]), " " + parts[i])
        short = np.flatnonzero(~wide)
        for at in range(0, len(short), KNOWN // 2):
            place = short[at : at + KNOWN // 2]
            some, key = parts if len(place) == len(parts) else [parts[i] for i in place.tolist()], _keys(variant[place], self.seed)
            self.learn(some)
            number = np.fromiter(map(self.number.__getitem__, some), dtype=np.int64, count=len(some))
            got = list(map(self.plain.__getitem__, number.tolist()))
            own = np.flatnonzero(self.skipping(number, key))
            for group in _alike([some[i] for i in own.tolist()], numbers=True):
                chosen = own[group]
                for i, ids in zip(chosen.tolist(), self.together([" " + some[i] for i in chosen.tolist()], key[chosen]), strict=True):
                    got[i] = ids
            for i, ids in zip(place.tolist(), got, strict=True):
                out[i] = ids
        return out

    def encode(self, texts: list[tuple[int, str]]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of (document's hash, text); a segment's variant also depends on its number."""
        documents = [self.parts(text) for _, text in texts]
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        own = np.repeat(np.array([v for v, _ in texts], dtype=np.uint64), sizes)
        number = (np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
        ids = iter(self.cut([p for d in documents for p in d], own + number * np.uint64(_STRIDE)))
        return [b"".join(islice(ids, len(d))) for d in documents]


def _alike(parts: list[str], most: int = 8192, numbers: bool = False) -> Iterator:
    """The segments, or their numbers, in groups of like length."""
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 2
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        for at in range(0, len(group), most):
            some = group[at : at + most]
            yield some if numbers else [parts[i] for i in some.tolist()]


@cache
def _encoder(path: str, seed: int, dropout: float) -> Encoder:
    return Encoder(path, seed, dropout)


def variant_of(doc_id: object, seed: int = SEED) -> int:
    return xxhash.xxh3_64_intdigest("" if doc_id is None else str(doc_id), seed=seed)


def encode(docs: DataFrame, path: str, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """Adds ``ids``: little-endian unsigned 16-bit piece ids of the whole text."""

    def make(column: Callable[[str], pa.Array]) -> list[pa.Array]:
        names = [variant_of(i, seed) for i in column("doc_id").to_pylist()]
        texts = [t or "" for t in column("text").to_pylist()]
        return [pa.array(_encoder(path, seed, dropout).encode(list(zip(names, texts, strict=True))), pa.binary())]

    return common.carried(docs, [T.StructField("ids", T.BinaryType())], make, 256)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the text of ``ids``, without the space put before it."""

    def make(column: Callable[[str], pa.Array]) -> list[pa.Array]:
        table = _encoder(path, 0, 0.0).vocabulary.text
        out = [b"".join([table[i] for i in np.frombuffer(x or b"", "<u2").tolist()])[1:] for x in column("ids").to_pylist()]
        return [pa.array(out, pa.binary()).cast(pa.string())]

    return common.carried(encoded, [T.StructField("decoded", T.StringType())], make)


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    path = public.path("piece_bpe_32k.model")
    docs = common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return decode(encode(docs, path), path).select(
        "doc_id",
        (F.octet_length("ids") / 2).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.length("decoded").cast("long").alias("decoded_chars"),
        same.alias("lossless"),
    )
