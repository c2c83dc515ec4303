"""Command line over a stored snapshot: ingest (git, db, vds, link) and read (verify, status, search, impact, query, emit)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.facade import GraphAnalytics
from lodeweave.operators import ingest, link, search
from lodeweave.operators.graph import Graph
from lodeweave.operators.store import SnapshotStore, rel_script, script
from lodeweave.sources import working_copy


def over(old: Graph, new: Graph) -> Graph:
    """The new nodes and relationships over the old ones of the same labels and types: properties a new row lacks survive."""
    nodes, rels = {}, {}
    for k, df in new.nodes.items():
        if k not in old.nodes:
            nodes[k] = df
            continue
        o, n = old.nodes[k].alias("o"), df.alias("n")
        both = lambda c: F.coalesce(*[F.col(f"{x}.{c}") for x, f in (("n", df), ("o", old.nodes[k])) if c in f.columns]).alias(c)  # noqa: B023, E731
        nodes[k] = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(*[both(c) for c in dict.fromkeys([*old.nodes[k].columns, *df.columns])])
    for k, df in new.rels.items():
        rels[k] = df if k not in old.rels else df.unionByName(old.rels[k].join(df.select("src", "dst"), ["src", "dst"], "left_anti"), allowMissingColumns=True)
    return Graph(nodes, rels)


def print_table(df: DataFrame, most: int = 500, width: int = 46) -> None:
    """Rows in aligned columns, values cut to a width for display."""
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(most).collect()]
    table = [df.columns, *[[v if len(v) <= width else v[: width - 1] + "\u2026" for v in r] for r in rows]]
    wide = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    for r in table:
        print("  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip())


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodeweave")
    p.add_argument("snapshot", help="folder of the snapshot store")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("verify", help="counts per label and relationship type")
    sub.add_parser("status", help="repositories and their state")
    git = sub.add_parser("git", help="a working copy into the snapshot")
    for x in ("path", "repo"):
        git.add_argument(x)
    git.add_argument("--since", default="", help="a commit to go on from, or auto")
    git.add_argument("--lines", action="store_true")
    db = sub.add_parser("db", help="the databases of an address into the snapshot")
    db.add_argument("url")
    db.add_argument("--schema", action="append")
    vds = sub.add_parser("vds", help="a catalog of services, from Parquet, into the snapshot")
    vds.add_argument("rows")
    sub.add_parser("link", help="link code and schema").add_argument("--passes", default=",".join(link.PASSES))
    for name, arg in (("search", "text"), ("impact", "target"), ("query", "text"), ("emit", "label")):
        sub.add_parser(name).add_argument(arg)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lodeweave").getOrCreate()
    store = SnapshotStore(spark, a.snapshot)
    g = store.read()
    api = GraphAnalytics(g)
    if a.command in ("git", "db", "vds", "link"):
        if a.command == "git":
            stored = g.nodes["Repository"].where(F.col("id") == a.repo).select("last_commit").first() if "last_commit" in getattr(g.nodes.get("Repository"), "columns", []) else None
            new = working_copy.graph_of(spark, a.path, a.repo, since=(stored[0] or "" if stored else "") if a.since == "auto" else a.since, with_lines=a.lines)
        elif a.command == "db":
            new = working_copy.read_database(spark, a.url, a.schema)
        elif a.command == "vds":
            new = ingest.services(spark.read.parquet(a.rows), g.nodes["Table"])
        else:
            made = link.run(a.passes.split(","), g.nodes["Class"], g.nodes["View"], g.nodes["StoredProcedure"], g.nodes["Table"])
            new = Graph({}, {name.upper(): df for name, df in made.items()})
        store.update(over(g, new))
        print_table(search.label_counts(store.read()).orderBy("label"))
        return 0
    if a.command == "emit":
        for r in (script(g.nodes[a.label], a.label) if a.label in g.nodes else rel_script(g.rels[a.label], a.label)).toLocalIterator():
            print(r["statement"])
        return 0
    made = {"verify": lambda: api.get_schema(), "status": lambda: [r.asDict() for r in g.nodes["Repository"].orderBy("id").limit(500).collect()], "search": lambda: api.search_codebase(a.text), "impact": lambda: api.explain_impact(a.target), "query": lambda: api.read_query(a.text)}
    print(json.dumps(made[a.command](), indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
