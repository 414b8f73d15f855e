"""The greedy choice: go through rows in a total order and keep each that conflicts with no kept row.

This is the lexicographically first maximal independent set of the conflict
graph.  A dropped row holds nothing against later rows, so it isn't a cascade of
`dropDuplicates`.  Conflicts come as shared keys (a group of any size, never
expanded into its pairs) and as explicit pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.runtime import materialize

#: Undecided rows, and their keys and pairs, up to which one task finishes the choice.
FINISH_ROWS = 200_000


def _order() -> F.Column:
    return F.struct("rank", "id")


def _finish(rows: DataFrame, schema: str) -> DataFrame:
    """Decide the rest in one task; the caller has counted that it is within FINISH_ROWS."""

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        every = pd.concat(got).sort_values("n", kind="stable")
        no, ids, keys, earlier = (every[c].tolist() for c in ("n", "id", "key", "earlier"))
        taken: set = set()
        kept_at: set[int] = set()
        out: dict = {}
        i = 0
        while i < len(no):
            end = i
            while end < len(no) and no[end] == no[i]:
                end += 1
            own = [k for k in keys[i:end] if isinstance(k, str)]
            free = not any(k in taken for k in own) and not any(e == e and e in kept_at for e in earlier[i:end])
            if free:
                taken.update(own)
                kept_at.add(no[i])
            out[ids[i]] = free
            i = end
        yield pd.DataFrame({"id": list(out), "kept": list(out.values())})

    return rows.repartition(1).mapInPandas(decide, schema)


def greedy_keep(nodes: DataFrame, keys: DataFrame, pairs: DataFrame | None = None, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """(id, kept) for every row of nodes.

    nodes: (id, rank), unique ids; rank of any sortable type, ties settled by id.
    keys: (id, key), where equal keys conflict and null keys never do.
    pairs: (a, b) ids in conflict, in any direction.
    """
    kind = dict(nodes.dtypes)["id"]
    nodes = materialize(nodes.select("id", "rank"), "greedy-nodes")
    keys = keys.where("id IS NOT NULL AND key IS NOT NULL").select("id", F.col("key").cast("string").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = materialize(keys.join(shared, "key", "left_semi").join(nodes, "id").select("id", "rank", "key"), "greedy-keys")
    if pairs is not None:
        a = nodes.select(F.col("id").alias("a"), F.col("rank").alias("ra"))
        b = nodes.select(F.col("id").alias("b"), F.col("rank").alias("rb"))
        first = F.struct("ra", "a") < F.struct("rb", "b")
        both = pairs.where("a <> b").join(a, "a").join(b, "b")
        links = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi")).distinct()
    else:
        links = nodes.select(F.col("id").alias("lo"), F.col("id").alias("hi")).limit(0)
    links = materialize(links, "greedy-links")
    alive = materialize(keys.select("id").union(links.select("lo")).union(links.select("hi")).distinct().join(nodes, "id"), "greedy-alive")
    done = [nodes.join(alive, "id", "left_anti").select("id", F.lit(True).alias("kept"))]
    while True:
        left = alive.count()
        if not left:
            break
        if left + keys.count() + links.count() <= finish_rows:
            # Bounded by the count above, so that one window over all of it is no unbounded group.
            numbered = materialize(alive.select("id", F.row_number().over(_window()).alias("n")), "greedy-numbered")
            early = links.join(numbered.select(F.col("id").alias("lo"), F.col("n").alias("earlier")), "lo").select(F.col("hi").alias("id"), "earlier")
            rows = keys.select("id", "key", F.lit(None).cast("int").alias("earlier")).unionByName(early.select("id", F.lit(None).cast("string").alias("key"), "earlier"))
            done.append(_finish(numbered.join(rows, "id", "left").select("id", "n", "key", "earlier"), f"id {kind}, kept boolean"))
            break
        heads = keys.groupBy("key").agg(F.min(_order()).alias("head"))
        later = keys.join(heads, "key").where(_order() > F.col("head")).select("id")
        taken = materialize(alive.join(later.union(links.select(F.col("hi").alias("id"))).distinct(), "id", "left_anti").select("id"), "greedy-taken")
        beaten_keys = keys.join(taken, "id", "left_semi").select("key").distinct()
        beaten = keys.join(beaten_keys, "key", "left_semi").select("id").union(links.join(taken.select(F.col("id").alias("lo")), "lo", "left_semi").select("hi"))
        lost = materialize(beaten.distinct().join(taken, "id", "left_anti"), "greedy-lost")
        done += [taken.select("id", F.lit(True).alias("kept")), lost.select("id", F.lit(False).alias("kept"))]
        gone = taken.union(lost)
        alive = materialize(alive.join(gone, "id", "left_anti"), "greedy-alive")
        keys = materialize(keys.join(gone, "id", "left_anti"), "greedy-keys")
        live = alive.select("id")
        links = materialize(links.join(live.withColumnRenamed("id", "lo"), "lo", "left_semi").join(live.withColumnRenamed("id", "hi"), "hi", "left_semi"), "greedy-links")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _window():
    from pyspark.sql import Window

    return Window.orderBy("rank", "id")
