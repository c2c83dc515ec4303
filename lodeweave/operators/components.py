"""Connected components of a graph given as memberships in hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.runtime import cut, hot_keys, spread_join

#: Rows of one hub or component that are joined in one task.
HOT = 100_000


def components(members: DataFrame, node: str = "node", hub: str = "hub", most_rounds: int = 60) -> DataFrame:
    """(node, component): nodes that share a hub, directly or through others, get the same least node.

    Hubs replace pairs: a hub of n nodes costs n rows, never n*n, and its minimum is pre-aggregated
    before the shuffle, and what comes back to the members of a hot hub or component is joined in parts, so
    one hub may hold any share of the rows. Labels are also followed one step
    (label of the label) every round, so the number of rounds grows with the logarithm of the
    longest path. Null nodes and null hubs link nothing; an empty input gives an empty result.
    """
    m = members.select(F.col(node).alias("node"), F.col(hub).alias("hub")).where("node is not null and hub is not null").distinct()
    shared = m.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
    links = cut(m.join(shared.select("hub"), "hub", "left_semi"))
    hot = hot_keys(links.groupBy("hub").agg(F.count("*").alias("n")), "hub", HOT)
    labels = cut(links.groupBy("node").agg(F.min("node").alias("label")))
    many = labels.count() > HOT  # else no label can be hot
    for _ in range(most_rounds):
        least = links.join(labels, "node").groupBy("hub").agg(F.min("label").alias("low"))
        near = spread_join(links, least, "hub", hot).groupBy("node").agg(F.min("low").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        over = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        hot_labels = hot_keys(step.groupBy("next").agg(F.count("*").alias("n")), "next", HOT) if many else None
        step = cut(spread_join(step, over, "next", hot_labels, "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        done = step.where("next <> label").limit(1).count() == 0
        labels = step.select("node", F.col("next").alias("label"))
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", F.col("label").alias("component"))
