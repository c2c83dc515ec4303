"""Upserts: per-property last writer wins, edges that need both ends, replacement of what one source wrote.

A batch of operations is folded to one row per key: every property takes the value of the last operation
that assigned it, and an assigned null removes it. The fold is one aggregation with map-side combine, so
many writes to one key cost no window; the result is merged into a snapshot by one full outer join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(ops: DataFrame, keys: list[str], seq: str | list[str], assigns: dict[str, list[str] | None], kind: str = "kind") -> DataFrame:
    """Fold operations to (keys, properties, <property>__set).

    ``assigns`` maps a property to the operation kinds that assign it (None: all). ``seq`` is a total
    order of the operations of a key. ``<property>__set`` tells whether any operation assigned it.
    """
    order = F.struct(*([seq] if isinstance(seq, str) else seq))
    aggs = []
    for p, kinds in assigns.items():
        here = F.lit(True) if kinds is None else F.col(kind).isin(*kinds)
        last = F.max_by(F.struct(F.col(p)), F.when(here, order))
        aggs += [last[p].alias(p), F.max(here).alias(f"{p}__set")]
    return ops.groupBy(*keys).agg(*aggs)


def upsert(snapshot: DataFrame, folded: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot with a folded batch written over it: assigned properties change, others survive."""
    props = [c for c in snapshot.columns if c not in keys]
    s, b = snapshot.alias("s"), folded.alias("b")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = [F.coalesce(f"s.{k}", f"b.{k}").alias(k) for k in keys]
    for p in props:
        out.append((F.when(F.col(f"b.{p}__set"), F.col(f"b.{p}")).otherwise(F.col(f"s.{p}")) if p in folded.columns else F.col(f"s.{p}")).alias(p))
    return s.join(b, on, "full_outer").select(*out)


def stamped(ops: DataFrame, keys: list[str], seq: list[str], assigns: dict[str, list[str] | None], kind: str = "kind") -> DataFrame:
    """(keys, one column ``(at, value)`` per property): the last operation that assigned it; null if none did."""
    cols = []
    for p, kinds in assigns.items():
        here = F.lit(True) if kinds is None else F.col(kind).isin(*kinds)
        cols.append(F.max_by(F.struct(F.struct(*seq).alias("at"), F.col(p).alias("value")), F.when(here, F.struct(*seq))).alias(p))
    return ops.groupBy(*keys).agg(*cols)


def merged_stamps(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both of ``stamped``: of every property the later assignment, whichever came first."""
    o, n = old.alias("o"), new.alias("n")
    later = lambda p: F.when(F.col(f"o.{p}").isNull() | (F.col(f"n.{p}.at") >= F.col(f"o.{p}.at")), F.coalesce(f"n.{p}", f"o.{p}")).otherwise(F.col(f"o.{p}")).alias(p)
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return o.join(n, on, "full_outer").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], *[later(p) for p in new.columns if p not in keys])


def edges_with_ends(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) whose both ends exist as nodes (id); the others are silently not written."""
    return edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi").join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")


def add_label(nodes: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """Nodes with ``label`` added to the labels of those whose id is in ``ids``."""
    marked = ids.select("id").distinct().withColumn("_m", F.lit(True))
    return nodes.join(marked, "id", "left").withColumn("labels", F.when(F.col("_m"), F.array_union("labels", F.array(F.lit(label)))).otherwise(F.col("labels"))).drop("_m")


def without_repo(nodes: DataFrame, repo: str) -> DataFrame:
    """Nodes that do not belong to a repository; commits belong by the prefix of their id, shared nodes (null repo) stay."""
    own = F.coalesce(F.col("repo") == repo, F.lit(False)) if "repo" in nodes.columns else F.lit(False)
    return nodes.where(~own & ~F.col("id").startswith(f"{repo}@"))


def without_database(nodes: DataFrame, database: str) -> DataFrame:
    """Nodes whose id is not the database's (``engine://host/name``) or below it."""
    return nodes.where((F.col("id") != database) & ~F.col("id").startswith(f"{database}/"))


def detached(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch no removed node (id)."""
    g = gone.select("id").distinct()
    return edges.join(g.withColumnRenamed("id", "src"), "src", "left_anti").join(g.withColumnRenamed("id", "dst"), "dst", "left_anti")


def duplicates(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has: what a uniqueness constraint would refuse."""
    return nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
