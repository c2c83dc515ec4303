"""The HTTP surface as a pure function: route a request to the facade, without a server."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, unquote, urlsplit

from lodeweave.facade import GraphAnalytics
from lodeweave.operators import search
from lodeweave.query.guard import Refused, denial

MOST_BODY = 64 * 1024


def route(api: GraphAnalytics, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """(status, payload) of a request; a refused query never reads the graph."""
    url = urlsplit(target)
    q = {k: v[-1] for k, v in parse_qs(url.query).items()}
    parts = [unquote(p) for p in url.path.strip("/").split("/")]
    if parts[:1] != ["api"]:
        return 404, {"error": "not found"}
    parts = parts[1:]
    if parts == ["query"]:
        if method != "POST":
            return 405, {"error": "use POST"}
        if len(body) > MOST_BODY:
            return 413, {"error": "body too large"}
        try:
            asked = json.loads(body or b"{}")
        except ValueError:
            return 400, {"error": "body is not JSON"}
        reason = denial(asked.get("query", ""))
        if reason:
            return 403, {"error": reason}
        try:
            rows = api.read_query(asked["query"], asked.get("params"), search.clamp(asked.get("limit"), search.READ_DEFAULT, 1, search.READ_CAP))
        except Refused as e:
            return 400, {"error": str(e)}
        return 200, {"columns": sorted({k for r in rows for k in r}), "rows": rows, "count": len(rows)}
    if method != "GET":
        return 405, {"error": "use GET"}
    if parts == ["schema"]:
        return 200, api.get_schema()
    if parts == ["status"]:
        repos = [r.asDict() for r in api.graph.nodes["Repository"].orderBy("id").limit(search.READ_CAP).collect()] if "Repository" in api.graph.nodes else []
        return 200, {"connected": bool(api.graph.nodes), "repositories": repos, "databases": [r.asDict() for r in search.database_table_counts(api.graph).orderBy("database").limit(search.READ_CAP).collect()] if "Database" in api.graph.nodes else []}
    if parts == ["search"]:
        return 200, search.page_report(search.search_any(api.graph, q.get("q", "")), q.get("limit"), q.get("offset"))
    if parts == ["code"]:
        return 200, api.search_codebase(q.get("q", ""), q.get("kind", "all"), q.get("repo"), q.get("limit"), q.get("offset"))
    if len(parts) == 3 and parts[0] == "labels" and parts[2] == "sample":
        if parts[1] not in api.graph.nodes:
            return 404, {"error": "unknown label"}
        return 200, {"rows": [r.asDict() for r in search.label_sample(api.graph, parts[1], search.clamp(q.get("limit"), 25, 1, 500)).collect()]}
    if len(parts) == 3 and parts[0] == "node" and parts[2] == "neighbors":
        return 200, {"rows": api.node_neighbors(parts[1], q.get("limit", 50))}
    if parts == ["graph", "sample"]:
        nodes, links = search.sample(api.graph, q.get("limit", 120))
        return 200, {"nodes": [r.asDict() for r in nodes.collect()], "links": [r.asDict() for r in links.collect()]}
    return 404, {"error": "not found"}
