import json
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import text
from lodeweave.operators import graph, impact, link, merge, search, store
from lodeweave.sources import catalog, history, parsers, structure, tree

V = "database string, id string, definition string"
T = "database string, id string, name string"


def test_links_by_whole_token(spark):
    views = spark.createDataFrame([("a", "v1", "SELECT * FROM Orders o JOIN [sys_identity] ON x.orders_x"), ("a", "v2", "select cost from order_header"), (None, "v3", "orders"), ("a", "v4", None), ("b", "v5", "my table")], V)
    tables = spark.createDataFrame([("a", "t1", "orders"), ("a", "t2", "os"), ("a", "t3", "identity"), ("a", "t4", "order_header"), ("b", "t5", "orders"), ("b", "t6", "my table"), ("a", "t7", "a.orders"), (None, "t8", "orders")], T)
    assert {tuple(r) for r in link.mentions(views, tables).collect()} == {("v1", "t1"), ("v2", "t4"), ("v5", "t6")}
    assert {tuple(r) for r in link.mentions(views, tables, across=True).collect()} == {("v1", "t5")}
    assert {tuple(r) for r in link.mentions(views, tables, least=2).collect()} == {("v1", "t1"), ("v2", "t4"), ("v5", "t6")}
    with pytest.raises(ValueError, match="nope"):
        link.run(["nope"], views, views, views, tables)


def test_fold_and_upsert(spark):
    ops = spark.createDataFrame([("a", 1, "scan", "h1", 5), ("a", 2, "touch", None, 9), ("a", 3, "scan", None, 7), ("b", 4, "touch", "x", 1)], "id string, seq int, kind string, hash string, total int")
    folded = merge.fold(ops, ["id"], "seq", {"hash": ["scan"], "total": None})
    assert {r["id"]: (r["hash"], r["total"], r["hash__set"]) for r in folded.collect()} == {"a": (None, 7, True), "b": (None, 1, False)}
    twice = merge.fold(ops.union(ops), ["id"], "seq", {"hash": ["scan"], "total": None})
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, folded.collect()))
    snap = spark.createDataFrame([("a", "old", 1, "keep"), ("b", "kept", 2, None), ("c", "c", 3, None)], "id string, hash string, total int, extra string")
    got = {r["id"]: tuple(r)[1:] for r in merge.upsert(snap, folded, ["id"]).collect()}
    assert got == {"a": (None, 7, "keep"), "b": ("kept", 1, None), "c": ("c", 3, None)}


def test_edges_and_replacement(spark):
    n = spark.createDataFrame([("r/x", "r"), ("s/x", "s"), ("r@1", None), ("ext/y", None)], "id string, repo string")
    e = spark.createDataFrame([("r/x", "s/x"), ("s/x", "ext/y"), ("s/x", "gone")], "src string, dst string")
    assert merge.edges_with_ends(e, n, n).count() == 2
    left = merge.without_repo(n, "r")
    assert {r["id"] for r in left.collect()} == {"s/x", "ext/y"}
    assert merge.detached(e, n.join(left, "id", "left_anti")).count() == 2
    assert merge.duplicates(n.union(n), ["id"]).count() == 4
    lab = merge.add_label(n.withColumn("labels", F.array(F.lit("Class"))), n.where("id = 'r/x'"), "Entity")
    assert {r["id"] for r in lab.where("array_contains(labels, 'Entity')").collect()} == {"r/x"}


def test_snapshots_and_script(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "g"))
    assert s.version() is None and s.read().nodes == {}
    n = spark.createDataFrame([("a'1", "x\\y", None, ["p", "q"], True)], "id string, name string, n int, tags array<string>, ok boolean")
    first = s.write(graph.Graph({"Class": n}, {}))
    second = s.write(graph.Graph({"Class": n.union(n)}, {"IMPORTS": spark.createDataFrame([("a", "b")], "src string, dst string")}))
    assert first != second == s.version() and s.read().nodes["Class"].count() == 2 and s.read().rels["IMPORTS"].count() == 1
    line = store.script(n, "Class").first()[0]
    assert line == "MERGE (n:Class {id: 'a\\'1'}) SET n.name = 'x\\\\y', n.n = null, n.tags = ['p', 'q'], n.ok = true;"
    assert store.split_statements("a 'x;y'; // c;d\n b \"\\\";\" ;; `z;`") == ["a 'x;y'", "b \"\\\";\"", "`z;`"]


def test_search_and_paging(spark):
    g = graph.Graph({"Table": spark.createDataFrame([(f"t{i}", f"Orders{i}", "db") for i in range(7)], "id string, name string, database string"), "Column": spark.createDataFrame([("c1", "order_id", "db")], "id string, name string, database string")}, {"REFERENCES": spark.createDataFrame([("t1", "t1"), ("t1", "t2")], "src string, dst string")})
    r = search.page_report(search.find_table(g, "Orders"), limit=3, offset="6")
    assert (r["total"], len(r["rows"]), r["hasMore"], r["offset"]) == (7, 1, False, 6)
    assert search.clamp("x") == 25 and search.clamp(-3) == 1 and search.clamp(900, most=500) == 500 and search.clamp(None, 0, 0) == 0
    assert {tuple(x) for x in search.neighbors(g, "t1").collect()} == {("REFERENCES", "t1", "Table", "t1"), ("REFERENCES", "t1", "Table", "t2")}
    assert {x["id"]: x["degree"] for x in search.degrees(g).collect()} == {"t1": 3, "t2": 1}
    with pytest.raises(ValueError):
        search.search_nodes(g, "Table", "nope", "x")


def test_impact_of_empty_graph(spark):
    e = lambda s: spark.createDataFrame([], s)
    g = graph.Graph({"Column": e("id string, name string, `table` string, schema string, database string, data_type string, is_nullable boolean"), "Table": e("id string, name string"), "StoredProcedure": e(T + ", definition string"), "View": e(T + ", definition string"), "Class": e("id string, fqn string, repo string")}, {r: e("src string, dst string") for r in ("FOREIGN_KEY", "USES_TABLE", "BASED_ON", "MAPS_TO", "HAS_COLUMN")})
    assert impact.explain_impact(g, "x").count() == 0 and impact.column_blast_radius(g, "x").count() == 0


@pytest.mark.parametrize("name, want", [("A.JAVA", "java"), ("pom.xml", "maven"), ("Dockerfile", "docker"), ("a.tar.sh", "shell"), ("noext", None), (".py", "python"), (None, None)])
def test_file_type(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(text.file_type("n")).first()[0] == want


def test_paths_and_urls(spark):
    df = spark.createDataFrame([("a/node_modules/x.js",), ("src/a.py",), ("x/Thumbs.db",), ("target",), (None,)], "p string")
    assert [r[0] for r in df.select(text.kept_path("p")).collect()] == [False, True, False, True, None]
    u = spark.createDataFrame([("https://u:p@ss@h/x@y",), ("git@h:x",), (None,), ("https://h/@s/x",)], "u string")
    assert [r[0] for r in u.select(text.strip_credentials("u")).collect()] == ["https://h/x@y", "git@h:x", None, "https://h/@s/x"]


def test_modules_and_tree(spark, tmp_path):
    for p, c in {"pom.xml": "<project/>", "sub/pom.xml": "<project/>", "sub/src/A.java": "class A { }\n", "sub/node_modules/b.js": "x", "latin.py": b"# \xe9\nx = 1", "skip.bin": "z"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(c if isinstance(c, bytes) else c.encode())
    files = tree.scan_tree(spark, str(tmp_path), "r")
    got = {r["relpath"]: r for r in files.collect()}
    assert set(got) == {"pom.xml", "sub/pom.xml", "sub/src/A.java", "latin.py"} and got["latin.py"]["lines"] == ["# \xe9", "x = 1"] and got["latin.py"]["type"] == "python"
    m = tree.modules_by_longest_prefix(files, tree.find_modules(files))
    assert {r["relpath"]: r["root"] for r in m.collect()} == {"pom.xml": "", "sub/pom.xml": "sub", "sub/src/A.java": "sub", "latin.py": ""}
    assert tree.scan_tree(spark, str(tmp_path), "r", spark.createDataFrame([("latin.py",)], "relpath string")).count() == 1


def test_git_log(spark, tmp_path):
    run = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=A@x.example", *a], check=True, capture_output=True, **k)
    run("init", "-q", "-b", "main")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("a\nb\n")
    run("add", "-A")
    run("commit", "-qm", "first")
    run("mv", "d/f.txt", "d/g.txt")
    (tmp_path / "h.txt").write_text("x\n")
    run("add", "-A")
    run("commit", "-qm", "second")
    a, b = (history.log_rows(history.read_log(spark, str(tmp_path), m)) for m in ("numstat", "name-status"))
    files = history.changed_files(history.numstat(a), history.name_status(b))
    c = {r["message"]: r for r in history.commits(a, files).collect()}
    assert c["first"]["insertions"] == 2 and c["first"]["parents"] == [] and c["second"]["parents"] == [c["first"]["hash"]] and c["second"]["files_changed"] == 2
    assert {(r["path"], r["change_type"]) for r in files.where(F.col("hash") == c["second"]["hash"]).collect()} == {("d/g.txt", "R"), ("h.txt", "A")}
    assert [tuple(r) for r in history.authors(history.commits(a, files)).collect()] == [("a@x.example", "A B", "A@x.example")]
    assert history.resolve_since("auto", c["first"]["hash"], history.commits(a, files)) == c["first"]["hash"] and history.resolve_since("auto", None, a) == "" and history.resolve_since("zzz", None, a) == ""


@pytest.mark.parametrize("p, want", [("d/{old => new}/f", "d/new/f"), ("a => b", "b"), ("{ => x}/f", "x/f"), ("d/{x => }/f", "d/f"), ("plain", "plain")])
def test_rename_tokens(spark, p, want):
    assert spark.createDataFrame([(p,)], "p string").select(history.normal_path("p")).first()[0] == want


def test_parsers():
    j = parsers.extract("java", ["package a.b;", "import c.D; import static x.Y.z;", "@Entity @Table(name = \"t_x\")", "public abstract class K<T> extends L<T> implements M, N {", "  /* void no() { } */ protected List<String> f(int a) {", "    return g(1);", "  }", "}"])
    assert j["package"] == "a.b" and j["types"][0]["mapped_table"] == "t_x" and j["types"][0]["extends"] == "L" and j["types"][0]["implements"] == ["M", "N"] and [m["name"] for m in j["methods"]] == ["f"]
    p = parsers.extract("python", ["from .m import (A as B,", "    C)", "import x.y as z", "@dataclass", "class K(Base, P):", "    __tablename__ = 'k'", "    class Meta:", "        db_table = 'k2'", "    async def _f(self) -> int:", "        def inner(): pass", "def g(): ...", "class E(Enum): pass"])
    assert [i["fqn"] for i in p["imports"]] == [".m.A", ".m.C", "x.y"] and p["types"][0]["mapped_table"] == "k2" and p["types"][0]["stereotype"] == "DataClass" and [(m["name"], m["owner"], m["visibility"]) for m in p["methods"]] == [("_f", "K", "protected"), ("g", "", "public")] and p["types"][1]["kind"] == "enum"
    t = parsers.extract("typescript", ["import {A, type B as C} from './m'", "@Component({", "  selector: 'x'", "})", "export class K extends L<M> implements N {", "  private f(a: string): void { if (a) { } }", "}", "export const g = async (x) => { }", "export interface I extends J { m(): string }"])
    assert [i["fqn"] for i in t["imports"]] == ["./m/A", "./m/B"] and t["types"][0]["stereotype"] == "Component" and t["types"][0]["extends"] == "L" and ("f", "K", "private") in [(m["name"], m["owner"], m["visibility"]) for m in t["methods"]] and t["types"][1]["implements"] == ["J"]
    g = parsers.extract("go", ["package a", "import (", '\tq "b/c"', ")", "type S struct {", "\tBase", "\tn int", "}", "type R interface {", "\tio.Reader", "\tClose() error", "}", "type C int", "func (s *S) Get(n int) (int, error) {", "\treturn 1, nil", "}", "func new() {}"])
    assert g["imports"][0]["fqn"] == "b/c" and g["types"][0]["extends"] == "Base" and g["types"][1]["implements"] == ["io.Reader"] and [(m["name"], m["owner"], m["visibility"]) for m in g["methods"]] == [("Close", "R", "public"), ("Get", "S", "public"), ("new", "", "package")]
    for lang in ("java", "python", "typescript", "go"):
        for junk in (["\x00\xff{{{((("], ['"""', "class"], ["@", "class {", "func ("], []):
            assert set(parsers.extract(lang, junk)) == {"package", "imports", "types", "methods"}
    assert parsers.extract("css", ["x"]) is None


def test_structures_and_pom(spark):
    df = spark.createDataFrame([(1, "python", ["class A:", "  def f(self): pass"]), (2, "css", ["x"]), (3, "java", None)], "k int, t string, l array<string>")
    got = {r["k"]: r for r in structure.structures(df, "k", "t", "l").collect()}
    assert set(got) == {1, 3} and got[1]["types"][0]["name"] == "A" and got[1]["methods"][0]["owner"] == "A" and got[3]["types"] == []
    pom = structure.parse_pom("<project xmlns='http://m'><parent><groupId>g</groupId><version>2</version></parent><artifactId>a</artifactId><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId></dependency></dependencies></project>")
    assert (pom["group_id"], pom["version"], pom["dependencies"][0]["scope"]) == ("g", "2", "compile") and structure.parse_pom("<nope")["artifact_id"] == ""


def test_catalog_sources(spark):
    u = catalog.parse_db_url("postgres://u%40x:p@h/a,b")
    assert (u["engine"], u["port"], u["user"], u["databases"]) == ("postgres", 5432, "u@x", ["a", "b"])
    with pytest.raises(ValueError):
        catalog.parse_db_url("foo://h/x")
    d = spark.createDataFrame([("CREATE INDEX i ON t USING btree (a, lower(b), c) WHERE (d > 1)",), ("none",), (None,)], "d string")
    assert [r[0] for r in d.select(catalog.index_columns("d")).collect()] == [["a", "lower(b)", "c"], [], None]
    prof = {(r["table"], r["column"]): (r["rows"], r["distinct_values"]) for r in catalog.profile({"t": spark.createDataFrame([(1, None), (1, 2)], "a int, b int")}).collect()}
    assert prof == {("t", "a"): (2, 1), ("t", "b"): (2, 1)}
    s, q, f = (spark.createDataFrame(x, y) for x, y in (([(1,), (2,)], "sid int"), ([(1, "q")], "sid int, query string"), ([(1, "f1"), (1, "f2"), (2, "lost")], "sid int, field string")))
    assert sorted((r["sid"], r["field"]) for r in catalog.vds_scan(s, q, f).collect() if r["field"]) == [(1, "f1"), (1, "f2")]


def test_stream_upserts(spark, tmp_path):
    from lodeweave.streaming.ingest import upsert_stream

    src = tmp_path / "in"
    src.mkdir()
    schema = "id string, seq int, kind string, name string"
    write = lambda n, rows: (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("id", "seq", "kind", "name"), r))) for r in rows))
    s = store.SnapshotStore(spark, str(tmp_path / "g"))
    for n, rows in enumerate([[("a", 1, "x", "one"), ("a", 2, "x", "two")], [("a", 3, "x", None), ("b", 4, "x", "b")]]):
        write(n, rows)
        q = upsert_stream(spark.readStream.schema(schema).json(str(src)), s, "Class", {"name": None}, ["seq"], str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert {r["id"]: r["name"] for r in s.read().nodes["Class"].collect()} == {"a": None, "b": "b"}


def test_history_graph(spark):
    rows = [("r", "1", "1", "A", "A@x", "t", "B", None, "t", [], "m", 1, 1, 1, datetime(2022, 1, 1)), ("r", "2", "2", None, None, "t", "B", "", "t", ["1", "0"], "m", 1, 1, 1, datetime(2022, 1, 2))]
    g = graph.history_graph(spark.createDataFrame(rows, "repo string, commit_hash string, short_hash string, author_name string, author_email string, authored_at string, committer_name string, committer_email string, committed_at string, parents array<string>, message string, insertions int, deletions int, files_changed int, recorded_at timestamp"))
    assert {r["id"] for r in g.nodes["Author"].collect()} == {"a@x", "b"} and g.rels["PARENT"].count() == 2 and g.rels["AUTHORED"].count() == 1


def test_spread_join_and_hot_components(spark, monkeypatch):
    from lodeweave import runtime
    from lodeweave.operators import components as comp

    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), ("none", 2), ("b", 1)], "k string, v int")
    one = spark.createDataFrame([("hot", "x"), ("b", "y"), ("unused", "z")], "k string, w string")
    hot = runtime.hot_keys(big.groupBy("k").count().withColumnRenamed("count", "n"), "k", 5)
    assert hot.first()["_parts"] == 10 and runtime.hot_keys(big.groupBy("k").count().withColumnRenamed("count", "n"), "k", 50) is None
    for how in ("inner", "left"):
        assert sorted(map(tuple, runtime.spread_join(big, one, "k", hot, how).collect()), key=str) == sorted(map(tuple, big.join(one, "k", how).collect()), key=str)
    monkeypatch.setattr(comp, "HOT", 4)
    rows = [(i, "hub") for i in range(30)] + [(29, "h2"), (31, "h2"), (32, "h3"), (33, "h3"), (None, "hub"), (40, None)]
    got = dict(map(tuple, comp.components(spark.createDataFrame(rows, "node bigint, hub string")).collect()))
    assert {n for n, c in got.items() if c == 0} == {*range(30), 31} and got[33] == 32


def test_frames_of_a_kept_catalog_do_not_join_it_again(spark):
    """What frames share is materialised once: the same rows, and no frame's plan holds the joins of foreign keys."""
    from lodeweave.plans import graph_queries as gq

    plain, kept = gq.both(spark, "/root/testdata/sf0.001"), gq.kept(gq.both)(spark, "/root/testdata/sf0.001")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    for kind, name in (("rels", "REFERENCES"), ("rels", "FOREIGN_KEY"), ("rels", "CONTAINS_CLASS"), ("nodes", "Table")):
        a, b = (getattr(g, kind)[name] for g in (plain, kept))
        assert joins(b) == 0 and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count(), name
    assert joins(plain.rels["REFERENCES"]) > 1
