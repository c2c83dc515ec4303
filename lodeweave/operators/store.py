"""Snapshots of the graph as versioned Parquet, and a replayable script of its operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.graph import RELATIONSHIPS, Graph
from lodeweave.operators.published import Pointer


class SnapshotStore:
    """Versions of a graph under one folder; readers see the version that was published last, whole.

    A version lists a folder for every label and type. ``update`` writes only what changed and lists the
    other folders again, so a batch of one label costs that label.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.pointer = spark, path.rstrip("/"), Pointer(spark, path)

    def _manifest(self) -> dict:
        return self.pointer.get() or {"version": None, "nodes": {}, "rels": {}}

    def version(self) -> str | None:
        return self._manifest()["version"]

    def write(self, g: Graph) -> str:
        """Write a whole graph as a new version and switch to it by one atomic rename."""
        return self._publish({"nodes": {}, "rels": {}}, g)

    def update(self, g: Graph) -> str:
        """Write the labels and types of ``g``; the others stay as they are."""
        return self._publish(self._manifest(), g)

    def _publish(self, base: dict, g: Graph) -> str:
        v = f"v-{uuid.uuid4().hex}"
        made = {"version": v, "nodes": dict(base["nodes"]), "rels": dict(base["rels"])}
        for kind, frames in (("nodes", g.nodes), ("rels", g.rels)):
            for name, df in frames.items():
                df.write.parquet(f"{self.path}/{v}/{kind}/{name}")
                made[kind][name] = f"{v}/{kind}/{name}"
        self.pointer.set(made)
        return v

    def read(self) -> Graph:
        m = self._manifest()
        load = lambda kind: {n: self.spark.read.parquet(f"{self.path}/{folder}") for n, folder in m[kind].items()}
        return Graph(load("nodes"), load("rels"))


def literal(c: Column, kind: str) -> Column:
    """A value as text of the script: null, true, 1, 'it\\'s', ['a', 'b']."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    quote = lambda x: F.concat(F.lit("'"), escaped(x), F.lit("'"))
    if kind == "string":
        text = quote(c)
    elif kind.startswith("array<string"):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, quote), ", "), F.lit("]"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def script(nodes: DataFrame, label: str) -> DataFrame:
    """(statement): one replayable upsert per node, in the order of ids."""
    props = [c for c in nodes.columns if c != "id"]
    kinds = dict(nodes.dtypes)
    sets = F.concat_ws(", ", *[F.concat(F.lit(f"n.{p} = "), literal(F.col(p), kinds[p])) for p in props])
    return nodes.orderBy("id").select(F.concat(F.lit(f"MERGE (n:{label} {{id: "), literal(F.col("id"), "string"), F.lit("})"), F.when(F.lit(bool(props)), F.concat(F.lit(" SET "), sets)).otherwise(F.lit("")), F.lit(";")).alias("statement"))


def rel_script(rels: DataFrame, kind: str) -> DataFrame:
    """(statement): one replayable upsert per relationship, in the order of its ends; both must exist."""
    props = [c for c in rels.columns if c not in ("src", "dst", "src_label")]
    kinds = dict(rels.dtypes)
    sets = F.concat_ws(", ", *[F.concat(F.lit(f"r.{p} = "), literal(F.col(p), kinds[p])) for p in props])
    a = F.col("src_label") if "src_label" in rels.columns else F.lit(RELATIONSHIPS[kind][0])
    end = lambda name, label, c: F.concat(F.lit(f"({name}:"), label, F.lit(" {id: "), literal(F.col(c), "string"), F.lit("})"))
    body = F.concat(F.lit("MATCH "), end("a", a, "src"), F.lit(", "), end("b", F.lit(RELATIONSHIPS[kind][1]), "dst"), F.lit(f" MERGE (a)-[r:{kind}]->(b)"))
    return rels.orderBy("src", "dst").select(F.concat(body, F.concat(F.lit(" SET "), sets) if props else F.lit(""), F.lit(";")).alias("statement"))


def split_statements(text: str) -> list[str]:
    """Statements of a script: semicolons end them, but not within quotes or comments."""
    out, now, i, quote = [], "", 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            now += text[i : i + 2] if c == "\\" else c
            i += 2 if c == "\\" else 1
            quote = "" if c == quote else quote
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif c == ";":
            out.append(now.strip())
            now, i = "", i + 1
        else:
            quote = c if c in "'\"`" else ""
            now, i = now + c, i + 1
    return [s for s in [*out, now.strip()] if s]
