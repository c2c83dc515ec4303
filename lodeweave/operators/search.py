"""Search, neighbourhood, counts and paging over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.text import caption
from lodeweave.operators.graph import Graph

READ_CAP, READ_DEFAULT, PAGE_DEFAULT = 500, 200, 25


def clamp(value, default: int = PAGE_DEFAULT, least: int = 1, most: int | None = None) -> int:
    """A limit or offset from outside: the default for what is no number, else within bounds."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return default
    n = max(least, n)
    return min(n, most) if most is not None else n


def page(df: DataFrame, limit=PAGE_DEFAULT, offset=0, order=("id", "label")) -> DataFrame:
    """One page in a total order."""
    cols = [F.col(c).asc_nulls_last() for c in order if c in df.columns]
    return df.orderBy(*cols).offset(clamp(offset, 0, 0)).limit(clamp(limit))


def page_report(df: DataFrame, limit=PAGE_DEFAULT, offset=0) -> dict:
    """rows, total, limit, offset and whether more follow."""
    limit, offset = clamp(limit), clamp(offset, 0, 0)
    total = df.count()
    rows = [r.asDict(recursive=True) for r in page(df, limit, offset).collect()]
    return {"rows": rows, "total": total, "limit": limit, "offset": offset, "hasMore": offset + len(rows) < total}


def label_counts(g: Graph) -> DataFrame:
    return g.all_nodes().groupBy("label").agg(F.count("*").alias("n"))


def rel_counts(g: Graph, *types: str) -> DataFrame:
    return g.all_rels(*types).groupBy("type").agg(F.count("*").alias("n"))


def search_nodes(g: Graph, label: str, prop: str, value: str) -> DataFrame:
    """Nodes of a label whose property holds the value, case-sensitive; the empty value matches all that have the property."""
    n = g.nodes[label]
    if prop not in n.columns:
        raise ValueError(f"{label} has no property {prop!r}")
    return n.where(F.col(prop).cast("string").contains(F.lit(value)))


def search_codebase(g: Graph, text: str, kind: str = "all", repo: str | None = None) -> DataFrame:
    """(label, id, name, ref): code by name, fqn or path and schema objects by name or definition, in any case.

    ``repo`` filters by equality; schema objects have no repository and drop out with it.
    """
    t = F.lit(text.lower())
    parts = []
    holds = lambda *cols: F.coalesce(F.array_max(F.array(*[F.lower(F.col(c)).contains(t).cast("int") for c in cols])), F.lit(0)) == 1
    if kind in ("code", "all"):
        parts.append(g.all_nodes("File", "Class", "Method").where(holds("name", "fqn", "path")))
    if kind in ("schema", "all"):
        parts.append(g.all_nodes("Table", "Column", "StoredProcedure").where(holds("name", "definition")))
    if not parts:
        raise ValueError(f"unknown kind {kind!r}")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if repo is not None:
        out = out.where(F.col("repo") == repo)
    return out.select("label", "id", "name", F.coalesce("fqn", "path", F.nullif("owner", F.lit("")), "id").alias("ref"))


def search_any(g: Graph, text: str) -> DataFrame:
    """(label, id, name): nodes of any label whose name, id or path holds the text, case-sensitive."""
    t = F.lit(text)
    holds = F.coalesce(F.col("name").contains(t), F.lit(False)) | F.col("id").cast("string").contains(t) | F.coalesce(F.col("path").contains(t), F.lit(False))
    return g.all_nodes().where(holds).select("label", "id", "name")


def find_table(g: Graph, text: str) -> DataFrame:
    """(label, id, name): tables and columns whose name holds the text, case-sensitive."""
    return g.all_nodes("Table", "Column").where(F.col("name").contains(F.lit(text))).select("label", "id", "name")


def find_procedure(g: Graph, text: str) -> DataFrame:
    """(id, name, database): procedures whose name or definition holds the text, case-sensitive."""
    p = g.nodes["StoredProcedure"]
    return p.where(F.col("name").contains(F.lit(text)) | F.col("definition").contains(F.lit(text))).select("id", "name", "database")


def neighbors(g: Graph, node_id: str) -> DataFrame:
    """(rel, from_id, neighbor_label, neighbor_id) one undirected step from a node; a self loop comes once."""
    r = g.all_rels().where((F.col("src") == node_id) | (F.col("dst") == node_id))
    out = r.where(F.col("src") == node_id).select(F.col("type").alias("rel"), F.col("src").alias("from_id"), F.col("dst_label").alias("neighbor_label"), F.col("dst").alias("neighbor_id"))
    back = r.where((F.col("dst") == node_id) & (F.col("src") != F.col("dst"))).select(F.col("type").alias("rel"), F.col("src").alias("from_id"), F.col("src_label").alias("neighbor_label"), F.col("src").alias("neighbor_id"))
    return out.union(back)


def degrees(g: Graph, *types: str) -> DataFrame:
    """(label, id, degree): how many relationships touch each node; a self loop touches twice."""
    r = g.all_rels(*types)
    ends = r.select(F.col("src_label").alias("label"), F.col("src").alias("id")).union(r.select("dst_label", "dst"))
    return ends.groupBy("label", "id").agg(F.count("*").alias("degree"))


def database_table_counts(g: Graph) -> DataFrame:
    """(database, tables), 0 where a database has none."""
    d, s, t = g.nodes["Database"], g.rels["HAS_SCHEMA"], g.rels["HAS_TABLE"]
    per = s.join(t.select(F.col("src").alias("dst"), F.col("dst").alias("t")), "dst").groupBy("src").agg(F.count("t").alias("n"))
    return d.join(per, d["id"] == per["src"], "left").select(F.col("name").alias("database"), F.coalesce("n", F.lit(0)).alias("tables"))


def sample(g: Graph, n: int, *types: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, id, caption, degree) and links of the first n relationships in a total order."""
    links = g.all_rels(*types).orderBy("type", "src", "dst").limit(clamp(n, READ_DEFAULT, 1, READ_CAP))
    ends = links.select(F.col("src_label").alias("label"), F.col("src").alias("id")).union(links.select("dst_label", "dst"))
    deg = ends.groupBy("label", "id").agg(F.count("*").alias("degree"))
    return deg.join(g.all_nodes(), ["label", "id"]).select("label", "id", caption(F.col("name"), F.col("id")).alias("caption"), "degree"), links


def label_sample(g: Graph, label: str, limit=PAGE_DEFAULT) -> DataFrame:
    """(id, properties as JSON) of the first nodes of a label."""
    n = g.nodes[label]
    return n.orderBy("id").limit(clamp(limit)).select("id", F.to_json(F.struct(*[c for c in n.columns if c != "id"])).alias("properties"))
