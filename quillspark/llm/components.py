"""Connected components of a link table by contraction, with tables and checkpoints only.

Each round points every vertex to its least neighbour or itself, follows the pointers until they stand still, renames
the links by them and drops what became a loop or a repeat. The rounds' pointers are composed as they come. Sums and
minima are pre-aggregated; the renaming joins have the pointers' unique keys on one side, so a hub's rows on the other
side can be split. Each table is written by no more tasks than its rows need, and deleted when its successor is written.
Nothing is gathered on the driver but counts.

Defined results: null ends and loops are ignored, repeated links count once, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, release

MAX_ROUNDS = 60


def _renamed(links: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    own = roots.select(F.col("id").alias(column), F.col("root").alias("_root"))
    rest = [c for c in links.columns if c != column]
    return links.join(own, column, "left").select(F.coalesce("_root", column).alias(column), *rest)


def _followed(parents: DataFrame, rows: int) -> DataFrame:
    """Rows (id, root, moved) of a checkpointed forest (id, root) with root < id or root = id, each pointing at its root; parents is released."""
    for _ in range(MAX_ROUNDS):
        up = parents.where(F.col("id") != F.col("root")).select(F.col("id").alias("root"), F.col("root").alias("_up"))
        moved = parents.join(up, "root", "left")
        jumped = checkpointed(moved.select("id", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), rows)
        release(parents)
        parents = jumped
        if jumped.where("moved").limit(1).count() == 0:
            return parents
    raise RuntimeError("pointers did not come to rest")


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows (id, component) for each end of a link (a, b): component is the least id that links lead to. ``rows`` bounds the links, if known."""
    links = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = checkpointed(links.distinct(), rows)
    found: DataFrame | None = None
    most = 0
    for _ in range(MAX_ROUNDS):
        n = links.count()
        if n == 0:
            break
        most = max(most, 2 * n)
        both = links.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(
            links.select(F.col("a").alias("id"), F.col("a").alias("root"))
        )
        roots = _followed(checkpointed(both.groupBy("id").agg(F.min("root").alias("root")), 2 * n), 2 * n)
        ends = _renamed(_renamed(links, roots, "a"), roots, "b").where("a <> b")
        left = checkpointed(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n)
        release(links)
        links = left
        if found is None:
            found = roots
        else:
            old, found = found, checkpointed(_renamed(found.select("id", "root"), roots, "root"), most)
            release(old, roots)
    else:
        raise RuntimeError("links did not contract")
    if found is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    release(links)
    return found.select("id", F.col("root").alias("component"))
