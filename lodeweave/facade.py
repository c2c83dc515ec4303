"""The analytics as one object: twelve read-only methods that return plain data."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators import impact, recipes, search
from lodeweave.operators.graph import Graph
from lodeweave.query import pattern

SCHEMA_TTL = 60.0


def _rows(df: DataFrame, limit: int = 500) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def _report(df: DataFrame, *order, limit: int = 500) -> dict:
    """The first rows in an order, how many there are in all, and whether more follow."""
    rows, total = _rows(df.orderBy(*order), limit), df.count()
    return {"rows": rows, "total": total, "truncated": total > len(rows)}


class GraphAnalytics:
    """Answers over one graph. Lists are bounded by their limits; nothing else is brought to the driver."""

    def __init__(self, graph: Graph, clock=time.monotonic):
        self.graph, self._clock, self._schema = graph, clock, None

    def get_schema(self, ttl: float = SCHEMA_TTL, refresh: bool = False) -> dict:
        """Labels and relationship types with counts; remembered for ``ttl`` seconds, 0 asks anew."""
        now = self._clock()
        if refresh or ttl <= 0 or self._schema is None or now - self._schema[0] > ttl:
            labels = {r["label"]: r["n"] for r in search.label_counts(self.graph).collect()}
            rels = {r["type"]: r["n"] for r in search.rel_counts(self.graph).collect()}
            self._schema = (now, labels, rels)
        order = lambda d: dict(sorted(d.items(), key=lambda kv: (-kv[1], kv[0])))
        return {"labels": order(self._schema[1]), "relationships": order(self._schema[2])}

    def read_query(self, query: str, params: dict | None = None, limit: int | None = None) -> list[dict]:
        return pattern.read(self.graph, query, params, limit)

    def search_nodes(self, label: str, prop: str, value: str, limit=25, offset=0) -> dict:
        return search.page_report(search.search_nodes(self.graph, label, prop, value), limit, offset)

    def node_neighbors(self, node_id: str, limit=50) -> list[dict]:
        return _rows(search.neighbors(self.graph, node_id).orderBy("rel", "neighbor_id"), search.clamp(limit, 50, 1, 500))

    def search_codebase(self, text: str, kind: str = "all", repo: str | None = None, limit=25, offset=0) -> dict:
        return search.page_report(search.search_codebase(self.graph, text, kind, repo), limit, offset)

    def find_code(self, text: str, limit=25, offset=0) -> dict:
        return self.search_codebase(text, "code", None, limit, offset)

    def find_table(self, text: str, limit=25, offset=0) -> dict:
        return search.page_report(search.find_table(self.graph, text), limit, offset)

    def find_procedure(self, text: str, limit=25) -> list[dict]:
        return _rows(search.find_procedure(self.graph, text).orderBy("id"), search.clamp(limit))

    def impact_of_column(self, column: str) -> dict:
        return _report(impact.impact_of_column(self.graph, column), "bucket", "database", "table", "name")

    def explain_impact(self, target: str, kind: str = "auto") -> dict:
        """Rows, counts per bucket and a one-line summary."""
        df = impact.explain_impact(self.graph, target, kind)
        counts = {r["bucket"]: r["count"] for r in df.groupBy("bucket").count().collect()}
        words = [f"{n} {b.replace('_', ' ')}{'s' if n != 1 and not b.endswith('y') else ''}" if not b.endswith("y") or n == 1 else f"{n} {b[:-1].replace('_', ' ')}ies" if b != "foreign_key" else f"{n} foreign keys" for b, n in sorted(counts.items())]
        return {"target": target, "counts": counts, "total": sum(counts.values()), "summary": f"{target}: " + (", ".join(words) or "nothing found"), **{k: v for k, v in _report(df, "severity", "bucket", "database", "name").items() if k != "total"}}

    def find_dead_code(self, repo: str, cutoff: str, kind: str = "files", limit=200) -> list[dict]:
        df = impact.dead_files(self.graph, cutoff) if kind == "files" else impact.dead_classes(self.graph, cutoff)
        return _rows(df.where(F.col("repo") == repo).orderBy(F.col("last_changed").asc_nulls_first(), "path"), search.clamp(limit, 200, 1, 500))

    def blast_radius_of_file(self, path: str) -> dict:
        df = impact.blast_radius(self.graph, path)
        r = _report(df, "repo", "class")
        callers = _report(df.select(F.explode("callers").alias("caller")).distinct(), "caller")
        return {"path": path, "found": r["total"] > 0, "classes": r["rows"], "truncated": r["truncated"], "caller_files": [x["caller"] for x in callers["rows"]], "callers_total": callers["total"]}

    def fk_hotspots(self, limit=20) -> list[dict]:
        return _rows(recipes.fk_hotspots(self.graph, search.clamp(limit, 20)))
