"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct five-word shingles. Equal sets are one vertex. Every vertex has a signature of minwise
coordinates; a tree's root branches it by two of them, so a node holds the vertices that agree on the chosen token.
``TREES`` independent trees are grown: with 2 * TREES root coordinates a pair at the threshold 0.85 meets in none of them
with probability 0.15 ** 8 = 3e-7 (0.80: 3e-6). A node of more than ``LIMIT`` vertices branches again, by the two coordinates on which
its vertices agree least, so common passages do not hold it together; a pair parts there with probability 0.15 ** 2 or a little more.

A node of at most ``LIMIT`` vertices is compared exhaustively. Signatures first: pairs that agree in ``SKETCH`` coordinates are
candidates (a pair at the threshold has fewer with probability about 1e-5; 1e-4 at 0.80), unless they met in the node of an earlier
root. A node's candidates fall into parts; a text travels, compressed, to each part that holds it, and all pairs of
the part are confirmed on the full sets by a product of incidence matrices, in whole numbers. So a text travels at most once a node, and
chains of weak candidates do not gather.

A large node whose vertices agree with its commonest values in ``DENSE`` of the coordinates on average is a crowd, which branching would not divide.
Crowds that share vertices are one. A crowd is dealt into chunks, each with the same few leaders. What the chunks do not
connect to the crowd's main component is then compared in blocks with the rest and, unless its exact distances to the leaders prove it too
far (Jaccard distance is a metric), with the main component's chunks. A link has both ends in the main component or one
end among the rest, so none is lost. Tasks give spanning forests, so links never grow with a group's square.

The ids of documents with their parts are broadcast up to common.BROADCAST_ROWS parts, and joined by a shuffle beyond.

Defined results: a null or empty text, or one of white space, has the empty set and links with nothing; a null doc_id
keeps its row, with a null component, and links with nothing; rows that share a doc_id are one document; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.components import components

WORDS, PERCENT = 5, 85
TREES, BRANCH, COORDS = 4, 2, 32
LIMIT, DENSE, MAX_DEPTH = 256, 0.8, 12
#: Coordinates, of COORDS, in which a candidate's signatures agree at least.
SKETCH = 17
LEADERS, REFERENCES = 4, 3
#: Columns of an incidence matrix that are multiplied at once.
WIDTH = 32768
_ROOTS = TREES * BRANCH

_rng = np.random.default_rng(20240607)
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)
_SCALE = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of UTF-8 text; fewer words count as one sequence."""
    h = common.word_hashes(np.frombuffer(text.lower(), dtype=np.uint8))
    if not len(h):
        return h
    width = min(k, len(h))
    n = len(h) - width + 1
    mix = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        mix += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(31))) * _PLACE[i % WORDS]
        mix = (mix << np.uint64(7)) | (mix >> np.uint64(57))
    mix ^= mix >> np.uint64(32)
    mix *= np.uint64(0xD6E8FEB86659FD93)
    mix ^= mix >> np.uint64(32)
    return np.unique(mix)


def signature(items: np.ndarray) -> np.ndarray:
    """COORDS minwise values, 31 bits each."""
    out = np.empty(COORDS, dtype=np.uint64)
    for i in range(COORDS):
        out[i] = ((items ^ _FLIP[i]) * _SCALE[i]).min()
    return (out >> np.uint64(33)).astype(np.int32)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) for each row; digest and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            sizes, digests, sigs = [], [], []
            for text in common.text_bytes(batch.column("text")):
                items = shingles(text)
                sizes.append(len(items))
                digests.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                sigs.append(signature(items) if len(items) else None)
            arrays = [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "digest", "sig"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig array<int>")


def overlaps(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets, or of the first ``split`` with the others, by incidence matrices."""
    sizes = [len(x) for x in sets]
    row = np.repeat(np.arange(len(sets)), sizes)
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    twice = np.bincount(column, minlength=1) > 1  # what one set holds alone meets nothing
    keep = twice[column]
    row, column = row[keep], (np.cumsum(twice) - 1)[column[keep]]
    left = len(sets) if split is None else split
    out = np.zeros((left, len(sets) if split is None else len(sets) - split), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = int(twice.sum())
    for at in range(0, shared, WIDTH):
        a, b = np.searchsorted(column, (at, at + WIDTH))
        part = np.zeros((len(sets), min(WIDTH, shared - at)), dtype=np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += (part[:left] @ (part if split is None else part[left:]).T).astype(np.int64)  # each product is exact
    return out


def linked(both: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs, exactly: 100 * intersection >= percent * union, from intersections and sizes."""
    return np.nonzero(100 * both >= percent * (left[:, None] + right[None, :] - both))


def sizes_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([len(x) for x in sets], dtype=np.int64)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (least, member) that connect what the pairs (i, j) of n places connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(n))
            return label[moved], moved
        label = new


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys; the rows come sorted by them."""
    now: tuple | None = None
    rows: list[dict] = []
    for batch in common.small_batches(batches, 256):
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if rows:
                    yield rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield rows


def _forest(ids: list[int], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    least, member = spanning(i, j, len(ids))
    name = np.array(ids, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(name[least]), pa.array(name[member])], names=["a", "b"])


def sketch_parts(nodes: DataFrame) -> DataFrame:
    """(part, rep) of rows (node, upto, handled, rep, sig) of small nodes: the parts into which a node's candidates fall.

    A pair that agrees in an earlier root coordinate (below ``upto``) whose node was small (a bit of ``handled``) met there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("node",)):
            sig = np.array([r["sig"] for r in rows], dtype=np.int32)
            agree = np.zeros((len(sig), len(sig)), dtype=np.int16)
            met = np.zeros((len(sig), len(sig)), dtype=bool)
            mask, upto = np.array([r["handled"] for r in rows], dtype=np.int64), rows[0]["upto"]
            for k in range(COORDS):
                same = sig[:, k, None] == sig[None, :, k]
                agree += same
                if k < upto:
                    met |= same & (mask[:, None] >> k & 1 > 0)
            i, j = np.nonzero((agree >= SKETCH) & ~met)
            least, member = spanning(i, j, len(sig))
            held = np.concatenate([np.unique(least), member])
            root = np.concatenate([np.unique(least), least])
            name = np.array([xxhash.xxh3_64_intdigest(f"{rows[0]['node']},{rows[r]['rep']}".encode()) for r in root], dtype=np.uint64)
            reps = np.array([r["rep"] for r in rows], dtype=np.int64)[held]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(reps)], names=["part", "rep"])

    dealt = nodes.select("node", "upto", "handled", "rep", "sig").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, "part long, rep long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(of, rep, packed) of rows (doc_id, text, of): compressed texts; ``of`` is kept as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            packed = pa.array([zlib.compress(t, 1) for t in common.text_bytes(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("of"), batch.column("doc_id"), packed], names=["of", "rep", "packed"])

    source = docs.select("of", F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, f"of {docs.schema['of'].dataType.simpleString()}, rep long, packed binary")


def _set(row: dict) -> np.ndarray:
    return shingles(zlib.decompress(row["packed"]))


def part_links(texts: DataFrame, percent: int) -> DataFrame:
    """Links inside each part of rows (part, rep, packed), at most LIMIT rows a part, as spanning forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("part",)):
            sets = [_set(r) for r in rows]
            size = sizes_of(sets)
            yield _forest([r["rep"] for r in rows], *linked(overlaps(sets), size, size, percent))

    return texts.repartition("part").sortWithinPartitions("part", "rep").mapInArrow(run, "a long, b long")


def _dealt(salt: str, into: Column) -> Column:
    return F.pmod(F.xxhash64("rep", F.lit(salt)), into).cast("int")


def crowd_links(texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the crowds, from rows (grp, size, rep, packed)."""
    texts = common.checkpointed(texts)
    n = texts.count()
    chunks = F.ceil(F.col("size") / LIMIT).cast("int")
    order = F.struct(F.xxhash64("rep", F.lit("leader")), "rep")
    heads = texts.groupBy("grp").agg(*(F.min(F.when(F.pmod(F.xxhash64("rep"), F.lit(LEADERS)) == k, order)).alias(f"h{k}") for k in range(LEADERS)))
    heads = heads.select("grp", F.explode(F.array(*(F.struct(F.col(f"h{k}.rep").alias("rep"), F.lit(k).alias("lead")) for k in range(LEADERS)))).alias("h"))
    heads = common.checkpointed(heads.select("grp", "h.rep", "h.lead").where("rep is not null"), n)
    lead = texts.join(F.broadcast(heads) if heads.count() <= 10_000 else heads, ["grp", "rep"])
    dealt = texts.select("grp", _dealt("chunk", chunks).alias("chunk"), "rep", F.lit(None).cast("int").alias("lead"), "packed")
    led = lead.select("grp", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "rep", "lead", "packed")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("grp", "chunk")):
            sets = [_set(r) for r in rows]
            size, both = sizes_of(sets), overlaps(sets)
            forest = _forest([r["rep"] for r in rows], *linked(both, size, size, percent))
            far = np.full((len(rows), LEADERS), np.nan)
            for k, r in enumerate(rows):
                if r["lead"] is not None:
                    distance = 1 - both[:, k] / np.maximum(size + size[k] - both[:, k], 1)
                    far[:, r["lead"]] = np.where(np.arange(len(rows)) == k, 0.0, distance)
            own = [k for k, r in enumerate(rows) if r["lead"] is None]
            ids = pa.array([rows[k]["rep"] for k in own], pa.int64())
            none, lists = pa.nulls(forest.num_rows, pa.list_(pa.float64())), pa.array(far[own].tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([forest.column("a"), forest.column("b"), none], names=["a", "b", "far"])
            yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(own), pa.int64()), lists], names=["a", "b", "far"])

    keys = ("grp", "chunk")
    found = dealt.unionByName(led).repartition(*keys).sortWithinPartitions(*keys, F.col("lead").isNull(), "rep")
    found = common.checkpointed(found.mapInArrow(first, "a long, b long, far array<double>"))
    links = found.where("b is not null").select("a", "b")
    # the largest component of each crowd is its main one; everything else asks
    named = components(links, (LEADERS + 1) * n).withColumnRenamed("id", "rep")
    far = found.where("b is null").select(F.col("a").alias("rep"), "far").dropDuplicates(["rep"])
    own = texts.select("grp", "rep").distinct().join(named, "rep", "left").join(far, "rep", "left")
    own = common.checkpointed(own.select("grp", "rep", F.coalesce("component", "rep").alias("component"), "far"), n)
    each = own.groupBy("grp", "component").agg(F.count("*").alias("n"))
    main = each.groupBy("grp").agg(F.max(F.struct("n", "component")).alias("m")).select("grp", F.col("m.component").alias("main"))
    main = common.checkpointed(main, n)
    # distances to the leaders within the main component
    at = [F.col("far")[k] for k in range(LEADERS)]
    reach = own.join(main, "grp").where("component = main").groupBy("grp").agg(*(f(F.nanvl(at[k], F.lit(None).cast("double"))).alias(f"{t}{k}") for k in range(LEADERS) for f, t in ((F.min, "lo"), (F.max, "hi"))))
    slack = 1 - percent / 100 + 1e-9
    apart = F.lit(False)
    for k in range(LEADERS):
        apart = apart | F.coalesce(~F.isnan(at[k]) & ((at[k] > F.col(f"hi{k}") + slack) | (at[k] < F.col(f"lo{k}") - slack)), F.lit(False))
    rest = own.join(main, "grp").where("component <> main").join(reach, "grp").select("grp", "rep", (~apart).alias("near"))
    rest = common.checkpointed(rest, n)
    if rest.limit(1).count() == 0:
        return links
    blocks = common.checkpointed(rest.groupBy("grp").agg(F.ceil(F.count("*") / LIMIT).cast("int").alias("rest"), F.ceil(F.count_if("near") / LIMIT).cast("int").alias("near")), n)
    few = blocks.count() <= 10_000
    held = texts.join((F.broadcast(blocks) if few else blocks).withColumnRenamed("near", "nears"), "grp")
    asking = held.join(rest, ["grp", "rep"])
    answering = held.join(rest.select("grp", "rep"), ["grp", "rep"], "left_anti").where("nears > 0")
    side = lambda df, kind, x, y, left: df.select("grp", F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), F.lit(left).alias("left"), "rep", "packed")
    every = lambda last: F.explode(F.sequence(F.lit(0), last - 1))
    near = asking.where("near").withColumn("_x", _dealt("near", F.col("nears")))
    mine = asking.withColumn("_x", _dealt("rest", F.col("rest")))
    tables = [
        side(near, 0, F.col("_x"), every(chunks), True),
        side(answering.withColumn("_y", _dealt("chunk", chunks)), 0, every(F.col("nears")), F.col("_y"), False),
        side(mine, 1, F.col("_x"), F.explode(F.sequence("_x", F.col("rest") - 1)), True),
        side(mine, 1, F.explode(F.sequence(F.lit(0), "_x")), F.col("_x"), False),
    ]

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("grp", "kind", "x", "y")):
            split = sum(r["left"] for r in rows)
            if 0 < split < len(rows):
                sets = [_set(r) for r in rows]
                size = sizes_of(sets)
                i, j = linked(overlaps(sets, split), size[:split], size[split:], percent)
                yield _forest([r["rep"] for r in rows], i, j + split)

    keys = ("grp", "kind", "x", "y")
    both = tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])
    both = both.repartition(*keys).sortWithinPartitions(*keys, F.col("left").desc(), "rep")
    return links.unionByName(both.mapInArrow(second, "a long, b long"))


def _splits(big: DataFrame, rows: int) -> DataFrame:
    """(node, share, p0, p1) of rows (node, rep, sig): mean share of the commonest values, and the two coordinates with the least.

    A value's share is counted for those of REFERENCES members, chosen by hash; one row a node and task is shuffled.
    """
    some = [F.min(F.struct(F.xxhash64("rep", F.lit(f"reference {r}")), "sig")).alias(f"m{r}") for r in range(REFERENCES)]
    heads = big.groupBy("node").agg(*some).select("node", *(F.col(f"m{r}.sig").alias(f"ref{r}") for r in range(REFERENCES)))
    heads = common.checkpointed(heads, rows)
    met = big.join(F.broadcast(heads) if heads.count() <= 10_000 else heads, "node")
    same = [F.count_if(F.col("sig")[k] == F.col(f"ref{r}")[k]).alias(f"s{r}_{k}") for r in range(REFERENCES) for k in range(COORDS)]
    counts = met.groupBy("node").agg(F.count("*").alias("n"), *same)
    most = [F.greatest(*(F.col(f"s{r}_{k}") for r in range(REFERENCES))) / F.col("n") for k in range(COORDS)]
    by = F.sort_array(F.array(*(F.struct(x.alias("share"), F.lit(k).alias("at")) for k, x in enumerate(most))))
    node = counts.select("node", (sum(most[1:], most[0]) / COORDS).alias("share"), by.alias("by"))
    out = common.checkpointed(node.select("node", "share", *(F.col("by")[k]["at"].alias(f"p{k}") for k in range(BRANCH))), rows)
    common.release(heads)
    return out


def grown(vertices: DataFrame, n: int) -> tuple[list[DataFrame], DataFrame | None, list[DataFrame]]:
    """All trees over (rep, sig): the parts (part, rep) of each level, the crowds' (node, rep) if any, and what to release once they are read."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.get("sig", F.lit(i))) for i in range(_ROOTS)))
    rooted = vertices.select(F.posexplode(keys).alias("upto", "node"), "rep")
    sizes = rooted.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    shared = rooted.join(sizes, "node").groupBy("rep").agg(F.collect_list(F.struct("node", "upto", "size")).alias("nodes"))
    # signatures are fetched only for vertices that share a node
    held = common.checkpointed(shared.join(vertices, "rep"), n)
    small = F.aggregate("nodes", F.lit(0), lambda acc, x: acc + F.when(x["size"] <= LIMIT, F.call_function("shiftleft", F.lit(1), x["upto"])).otherwise(0))
    level = held.select(F.explode("nodes").alias("at"), "rep", "sig", small.alias("handled"))
    level = level.select("at.node", "at.upto", "at.size", "handled", "rep", "sig")
    parts, crowds, spare = [], None, [held]
    for depth in range(MAX_DEPTH + 1):
        parts.append(sketch_parts(level.where(F.col("size") <= LIMIT)))
        big = level.where(F.col("size") > LIMIT)
        m = big.count()
        if m == 0:
            break
        big = common.checkpointed(big)
        splits = _splits(big, m)
        crowd = (F.col("share") >= DENSE) | F.lit(depth == MAX_DEPTH)
        dense = big.join(splits.where(crowd), "node", "left_semi").select("node", "rep")
        crowds = dense if crowds is None else crowds.unionByName(dense)
        branched = big.join(splits.where(~crowd), "node")
        pick = lambda k: F.xxhash64("node", f"p{k}", F.get("sig", F.col(f"p{k}")))
        below = branched.select(F.explode(F.array_distinct(F.array(*map(pick, range(BRANCH))))).alias("node"), "handled", "rep", "sig")
        below = common.checkpointed(below)
        sizes = below.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        level = below.join(sizes, "node").withColumn("upto", F.lit(_ROOTS))
        spare += [big, splits, below]
    return parts, crowds, spare


def crowds_of(rows: DataFrame, n: int) -> DataFrame:
    """(rep, grp, size) of the crowds' rows (node, rep): crowds that share vertices are one group."""
    each = common.checkpointed(rows.groupBy("rep").agg(F.collect_set("node").alias("nodes")), n)
    first = F.array_min("nodes")
    touching = each.where(F.size("nodes") > 1).select(first.alias("a"), F.explode("nodes").alias("b")).distinct()
    named = components(touching, n)
    own = each.select("rep", first.alias("id")).join(named, "id", "left").select("rep", F.coalesce("component", "id").alias("grp"))
    own = common.checkpointed(own, n)
    sizes = own.groupBy("grp").agg(F.count("*").alias("size"))
    return common.checkpointed(own.join(sizes, "grp").select(F.col("rep").alias("doc_id"), "grp", "size"), n)


def small(ids: DataFrame, entries: int) -> DataFrame:
    """ids, marked for broadcast if its entries, those of its arrays counted one by one, are few."""
    return F.broadcast(ids) if entries <= common.BROADCAST_ROWS else ids


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs. SKETCH and TREES suit a percent of 80 or more."""
    rows = common.checkpointed(signed(docs))
    n = rows.count()
    usable = rows.where("digest is not null and doc_id is not null")
    vertices = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "sig")).alias("least"))
    vertices = common.checkpointed(vertices.select("digest", F.col("least.doc_id").alias("rep"), F.col("least.sig").alias("sig")), n)
    parts, crowds, spare = grown(vertices.select("rep", "sig"), n)
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    every = common.checkpointed(every.groupBy("rep").agg(F.collect_set("part").alias("of")).withColumnRenamed("rep", "doc_id"), n)
    grouped = crowds_of(crowds, n) if crowds is not None else None
    common.release(*spare)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    if usable.groupBy("doc_id").count().where("count > 1").limit(1).count():
        source = source.dropDuplicates()
    bound = every.agg(F.sum(F.size("of"))).first()[0] or 0
    texts = packed_texts(source.join(small(every, bound), "doc_id"))
    links = part_links(texts.select(F.explode("of").alias("part"), "rep", "packed"), percent)
    if grouped is not None:
        crowded = grouped.count()
        bound += 3 * (LEADERS + 1) * crowded
        held = source.join(small(grouped, crowded), "doc_id").select("doc_id", "text", F.struct("grp", "size").alias("of"))
        links = links.unionByName(crowd_links(packed_texts(held).select("of.*", "rep", "packed"), percent))
    found = components(links, bound)
    named = vertices.select("digest", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    named = common.checkpointed(named.select("digest", F.coalesce("component", "rep").alias("component")), n)
    common.release(vertices, every)
    out = rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
