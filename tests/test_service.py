import json

import pytest

from lodeweave.facade import GraphAnalytics
from lodeweave.operators.graph import Graph
from lodeweave.service import route
from lodeweave.sources import repositories


@pytest.fixture(scope="module")
def api(spark):
    c = spark.createDataFrame([("c1", "order_id", "orders", "s", "d", "int", True)], "id string, name string, `table` string, schema string, database string, data_type string, is_nullable boolean")
    t = spark.createDataFrame([("t1", "orders", "d")], "id string, name string, database string")
    p = spark.createDataFrame([("p1", "recalc", "d", "update orders set order_id = 1")], "id string, name string, database string, definition string")
    v = p.limit(0)
    k = spark.createDataFrame([("k1", "a.Order", "r", "Order")], "id string, fqn string, repo string, name string")
    f = spark.createDataFrame([("f1", "a.py", "r")], "id string, path string, repo string")
    e = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    return GraphAnalytics(Graph({"Column": c, "Table": t, "StoredProcedure": p, "View": v, "Class": k, "File": f}, {"HAS_COLUMN": e(("t1", "c1")), "FOREIGN_KEY": e(), "REFERENCES": e(), "MAPS_TO": e(("k1", "t1")), "USES_TABLE": e(("p1", "t1")), "BASED_ON": e(), "CONTAINS_CLASS": e(("f1", "k1")), "IMPORTS": e()}))


def test_facade(api):
    r = api.explain_impact("orders")
    assert r["counts"] == {"column": 1, "procedure": 1, "entity": 1} and "1 procedure" in r["summary"]
    assert [x["via"] for x in r["rows"] if x["bucket"] == "procedure"] == ["definition,link"]
    assert api.explain_impact("order_id", "column")["counts"]["column"] == 1
    assert api.search_codebase("order")["total"] == 4 and api.find_code("a.py")["rows"][0]["ref"] == "a.py"
    assert api.get_schema()["labels"]["Column"] == 1


def test_schema_is_remembered(api):
    now = [0.0]
    a = GraphAnalytics(api.graph, clock=lambda: now[0])
    a.get_schema()
    first = a._schema
    now[0] = 59
    a.get_schema()
    assert a._schema is first
    now[0] = 61
    a.get_schema()
    assert a._schema is not first


@pytest.mark.parametrize("method, target, body, status", [
    ("GET", "/api/schema", b"", 200), ("GET", "/api/search?q=order&limit=2", b"", 200), ("GET", "/api/labels/Nope/sample", b"", 404), ("GET", "/api/labels/Table/sample", b"", 200), ("GET", "/api/node/t1/neighbors", b"", 200), ("GET", "/api/graph/sample", b"", 200),
    ("POST", "/api/query", json.dumps({"query": "MATCH (t:Table) RETURN t.name AS n"}).encode(), 200), ("POST", "/api/query", json.dumps({"query": "CREATE (n)"}).encode(), 403), ("POST", "/api/query", json.dumps({"query": "MATCH (n:Nope) RETURN n"}).encode(), 400), ("POST", "/api/query", b"{", 400), ("POST", "/api/query", b" " * 70_000, 413), ("GET", "/api/query", b"", 405), ("POST", "/api/schema", b"", 405), ("GET", "/x", b"", 404),
])
def test_routes(api, method, target, body, status):
    assert route(api, method, target, body)[0] == status


def test_sources(tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(["https://h/a/b.git", {"path": "/x/y", "name": "z"}]))
    assert [e["name"] for e in repositories.repositories_from(tmp_path / "r.json")] == ["b", "z"]
    (tmp_path / "d.json").write_text(json.dumps([{"url": "mysql://u@h/x", "passwordEnv": "P"}]))
    assert repositories.databases_from(tmp_path / "d.json", {"P": "q"})[0]["password"] == "q"
    pages = {1: [{"http_url_to_repo": "u1", "path": "a"}, {"http_url_to_repo": "u2", "last_activity_at": "2024"}], 2: [{"http_url_to_repo": "u2"}]}
    assert [r["url"] for r in repositories.group_listing(lambda p: pages.get(p, []))] == ["u1", "u2"]
    assert [r["url"] for r in repositories.group_listing(lambda p: pages.get(p, []), "2023")] == ["u2"]
    got = repositories.each_source([{"name": "a"}, {"name": "b"}], lambda s: 1 / (s["name"] == "a"))
    assert [g["ok"] for g in got] == [True, False]
    assert repositories.working_copy(str(tmp_path), tmp_path) == tmp_path
