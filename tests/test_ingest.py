import subprocess

import pytest
from pyspark.sql import functions as F

from lodeweave.__main__ import main, over, print_table
from lodeweave.operators import impact, ingest, merge, recipes
from lodeweave.operators.graph import Graph
from lodeweave.operators.store import SnapshotStore, rel_script
from lodeweave.plans import ingest_queries
from lodeweave.sources import catalog, history, working_copy
from lodeweave.sources.structure import poms

POM = "<project><parent><groupId>org.acme</groupId><version>1.0</version></parent><artifactId>core</artifactId><dependencies><dependency><groupId>org.lib</groupId><artifactId>lib</artifactId><version>2</version></dependency><dependency><artifactId/></dependency></dependencies></project>"
JAVA = "package org.acme.core;\nimport java.util.List;\n@Entity\n@Table(name = \"orders\")\npublic class Order extends Base implements Kept, Dated {\n    public int total() {\n        return 1;\n    }\n}\n"
PY = "import json\n\n\nclass Task(Base):\n    def run(self):\n        pass\n\n\ndef helper():\n    pass\n"


def git(path, *args):
    subprocess.run(["git", "-C", str(path), "-c", "user.name=Ada", "-c", "user.email=ADA@x.org", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def copy(tmp_path_factory):
    p = tmp_path_factory.mktemp("wc")
    git(p, "init", "-q", "-b", "main")
    for name, text in {"core/pom.xml": POM, "core/src/Order.java": JAVA, "core/task.py": PY, "node_modules/x.js": "class X {}", "readme.md": "hi"}.items():
        (p / name).parent.mkdir(parents=True, exist_ok=True)
        (p / name).write_text(text)
    git(p, "add", "-A")
    git(p, "commit", "-qm", "first")
    git(p, "tag", "v1")
    git(p, "mv", "core/task.py", "core/job.py")
    (p / "core/job.py").write_text(PY + "\nX = 1\n")
    git(p, "add", "-A")
    git(p, "commit", "-qm", "second")
    return p


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def edges(df):
    return {(r["src"], r["dst"]) for r in df.select("src", "dst").collect()}


def test_working_copy(spark, copy):
    g = working_copy.graph_of(spark, str(copy), "r", "https://u:p@h/r", with_lines=True)
    assert ids(g.nodes["Module"]) == {"r/core"} and ids(g.nodes["Dependency"]) == {"org.lib:lib:2"} and edges(g.rels["DEPENDS_ON"]) == {("r/core", "org.lib:lib:2")}
    assert g.nodes["Module"].first()["group_id"] == "org.acme"
    assert ids(g.nodes["Package"]) == {"r/core/org.acme.core"} and ("r/core/org.acme.core", "r/core/src/Order.java") in edges(g.rels["CONTAINS_FILE"]) and ("r/core", "r/core/job.py") in edges(g.rels["CONTAINS_FILE"])
    assert edges(g.rels["EXTENDS"]) == {("r/org.acme.core.Order", "ext/Base"), ("r/core.job.Task", "ext/Base")} and edges(g.rels["IMPLEMENTS"]) == {("r/org.acme.core.Order", "ext/Kept"), ("r/org.acme.core.Order", "ext/Dated")}
    assert ("r/org.acme.core.Order", "ext/java.util.List") in edges(g.rels["IMPORTS"]) and edges(g.rels["HAS_METHOD"]) >= {("r/org.acme.core.Order", "r/org.acme.core.Order#total"), ("r/core.job.Task", "r/core.job.Task#run")}
    assert edges(g.rels["CONTAINS_METHOD"]) == {("r/core/job.py", "r/core/job.py#helper")}
    order = g.nodes["Class"].where("name = 'Order'").first()
    assert (order["stereotype"], order["mapped_table"], order["type"]) == ("Entity", "orders", "class")
    assert {tuple(r["labels"]) for r in ingest.labelled(g).where("id = 'r/org.acme.core.Order'").collect()} == {("Class", "Entity")}
    assert g.nodes["Line"].where("file_id = 'r/core/src/Order.java'").count() == 9 and ("r/readme.md:1", "r/readme.md:2") not in edges(g.rels["NEXT_LINE"])
    assert g.nodes["Commit"].where("not stub").count() == 2 and g.nodes["Author"].first()["id"] == "ada@x.org"
    kinds = {(r["dst"], r["change_type"]) for r in g.rels["CHANGED"].collect()}
    assert ("r/core/job.py", "R") in kinds and ("r/core/task.py", "A") in kinds and "r/core/task.py" in ids(g.nodes["File"])  # known from the log alone
    assert ids(g.nodes["Branch"]) == {"r#branch/main"} and ids(g.nodes["Tag"]) == {"r#tag/v1"} and len(edges(g.rels["TAGS"])) == 1
    assert g.nodes["Repository"].first()["url"] == "https://h/r" and g.nodes["Repository"].first()["last_commit"] == history.head_commit(str(copy))


def test_incremental_reads_only_what_changed(spark, copy):
    first = subprocess.run(["git", "-C", str(copy), "rev-parse", "v1"], capture_output=True, check=True).stdout.decode().strip()
    g = working_copy.graph_of(spark, str(copy), "r", since=first)
    assert ids(g.nodes["File"].where("hash is not null")) == {"r/core/job.py"} and g.nodes["Commit"].where("not stub").count() == 1
    assert {r["relpath"] for r in history.changed_paths(spark, str(copy), "0" * 40).collect()} >= {"core/pom.xml", "readme.md"}


def test_log_in_chunks(spark, copy):
    one, many = (sorted((r["hash"], r["path"]) for r in history.numstat(history.log_rows(history.read_log(spark, str(copy), "numstat", chunk=c))).collect()) for c in (50, 1))
    assert one == many and len(one) == 6
    assert history.read_log(spark, str(copy), "numstat", limit=1).where(F.col("line").startswith("\x1e")).count() == 1


def test_command_line(spark, copy, tmp_path, capsys):
    assert main([str(tmp_path / "s"), "git", str(copy), "r"]) == 0
    assert main([str(tmp_path / "s"), "git", str(copy), "r", "--since", "auto"]) == 0  # nothing new: nothing lost
    g = SnapshotStore(spark, str(tmp_path / "s")).read()
    assert g.nodes["Class"].where("not external").count() == 2 and g.nodes["Repository"].count() == 1 and g.nodes["Commit"].count() == 2
    assert "Class" in capsys.readouterr().out
    print_table(spark.createDataFrame([("a", None), ("b" * 60, 2)], "x string, y int"))
    assert "b" * 45 + "…" in capsys.readouterr().out


def test_new_rows_over_old(spark):
    old = Graph({"File": spark.createDataFrame([("f", "h", 3)], "id string, hash string, total_lines int")}, {"X": spark.createDataFrame([("a", "b")], "src string, dst string")})
    new = Graph({"File": spark.createDataFrame([("f", "n"), ("g", "m")], "id string, name string")}, {"X": spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")})
    g = over(old, new)
    assert {tuple(r) for r in g.nodes["File"].collect()} == {("f", "h", 3, "n"), ("g", None, None, "m")} and g.rels["X"].count() == 2


def test_late_operations_lose(spark):
    ops = "id string, name string, size int, at int"
    one, two = spark.createDataFrame([("a", "new", 1, 5), ("b", None, 2, 1)], ops), spark.createDataFrame([("a", "old", 7, 3), ("a", None, 9, 6), ("c", "c", 1, 1)], ops)
    s = lambda df: merge.stamped(df, ["id"], ["at"], {"name": None, "size": None})
    late = merge.merged_stamps(s(one), s(spark.createDataFrame([("a", "old", 7, 3)], ops)), ["id"])
    assert late.where("id = 'a'").select("name.value", "size.value").first()[:] == ("new", 1)
    both = {r["id"]: (r["name"]["value"], r["size"]["value"]) for r in merge.merged_stamps(s(one), s(two), ["id"]).collect()}
    assert both == {"a": (None, 9), "b": (None, 2), "c": ("c", 1)}


def test_database_rows(spark):
    tables = spark.createDataFrame([("s", "t"), ("s", "u")], "schema string, name string")
    columns = spark.createDataFrame([("s", "t", "id", 1, "int", False, "PRI", "", ""), ("s", "u", "t_id", 1, "int", True, "MUL", "", ""), ("s", "v_view", "x", 1, "int", True, "", "", "")], "schema string, table string, name string, ordinal int, data_type string, is_nullable boolean, column_key string, `default` string, extra string")
    routines = spark.createDataFrame([("s", "p", None, "SELECT 1" * 20_000, ["IN a int"])], "schema string, name string, type string, definition string, parameters array<string>")
    views = spark.createDataFrame([("s", "v_view", "SELECT * FROM t")], "schema string, name string, definition string")
    keys = spark.createDataFrame([("fk", "u", "t_id", "t", "id", "s"), ("gone", "u", "t_id", "elsewhere", "id", "s")], "constraint_name string, from_table string, from_column string, to_table string, to_column string, schema_name string")
    ix = catalog.mysql_indexes(spark.createDataFrame([("s", "t", "PRIMARY", 2, "b", 0, "BTREE"), ("s", "t", "PRIMARY", 1, "id", 0, "BTREE")], "table_schema string, table_name string, index_name string, seq_in_index int, column_name string, non_unique int, index_type string"))
    g = working_copy.schema_graph("mysql", "db1", "shop", tables, columns, routines, views, keys, ix)
    assert ids(g.nodes["Table"]) == {"mysql://db1/shop/s/t", "mysql://db1/shop/s/u", "mysql://db1/shop/s/elsewhere"} and ids(g.nodes["Column"]) == {"mysql://db1/shop/s/t#id", "mysql://db1/shop/s/u#t_id", "mysql://db1/shop/s/elsewhere#id"}
    assert len(edges(g.rels["FOREIGN_KEY"])) == 2 and edges(g.rels["HAS_TABLE"]) == {("mysql://db1/shop/s", "mysql://db1/shop/s/t"), ("mysql://db1/shop/s", "mysql://db1/shop/s/u")}
    assert g.nodes["Index"].first()["columns"] == ["id", "b"] and len(g.nodes["StoredProcedure"].first()["definition"]) == 160_000
    other = working_copy.schema_graph("mysql", "db2", "shop", tables, columns, routines, views, keys)
    assert not ids(g.nodes["Table"]) & ids(other.nodes["Table"])  # two servers with one database name


def test_engines(spark):
    pg = catalog.postgres_indexes(spark.createDataFrame([("s", "t", "i", "CREATE UNIQUE INDEX i ON s.t USING btree (a, lower(b)) WHERE (c > 0)")], "schemaname string, tablename string, indexname string, indexdef string")).first()
    assert (pg["is_unique"], pg["index_type"], pg["columns"]) == (True, "btree", ["a", "lower(b)"])
    ms = catalog.mssql_indexes(spark.createDataFrame([("s", "t", "i", 0, "HEAP", 2, "b"), ("s", "t", "i", 0, "HEAP", 1, "a")], "schema string, table string, name string, is_unique int, type_desc string, key_ordinal int, column string")).first()
    assert ms["columns"] == ["a", "b"] and not ms["is_unique"]
    sch = spark.createDataFrame([("sys",), ("INFORMATION_SCHEMA",), ("shop",)], "name string")
    assert [r["name"] for r in catalog.user_schemas(sch, "mssql").collect()] == ["shop"] and catalog.user_schemas(sch, "mssql", ["sys"]).count() == 1
    assert catalog.mysql_foreign_keys(spark.createDataFrame([("c", "a", "b", None, None), ("d", "a", "b", "t", "id")], "constraint_name string, table_name string, column_name string, referenced_table_name string, referenced_column_name string")).count() == 1


def test_poms_and_sources(spark):
    got = [r["pom"] for r in poms(spark.createDataFrame([(1, POM), (2, "<broken"), (3, None)], "k int, text string")).orderBy("k").collect()]
    assert got[0]["artifact_id"] == "core" and got[0]["dependencies"][0]["scope"] == "compile" and got[1]["artifact_id"] == got[2]["artifact_id"] == ""
    r = spark.createDataFrame([("x", "y'", 3)], "src string, dst string, insertions int")
    assert rel_script(r, "CHANGED").first()[0] == "MATCH (a:Commit {id: 'x'}), (b:File {id: 'y\\''}) MERGE (a)-[r:CHANGED]->(b) SET r.insertions = 3;"


def test_empty_sources(spark, tmp_path):
    (tmp_path / "empty.md").write_text("")
    g = ingest.code(spark.createDataFrame([], "repo string, url string, default_branch string, ingest_status string"), spark.createDataFrame([], "repo string, relpath string, name string, type string, extension string, hash string, total_lines int, lines array<string>"),
                    spark.createDataFrame([], "repo string, relpath string, package string, imports array<struct<fqn:string,line:int>>, types array<struct<name:string,kind:string,line:int,visibility:string,is_abstract:boolean,is_final:boolean,extends:string,implements:array<string>,stereotype:string,mapped_table:string>>, methods array<struct<name:string,owner:string,line:int,return_type:string,visibility:string>>"), spark.createDataFrame([], "repo string, root string, pom struct<group_id:string,artifact_id:string,version:string,packaging:string,description:string,dependencies:array<struct<group_id:string,artifact_id:string,version:string,scope:string>>>"), with_lines=True)
    assert all(df.count() == 0 for df in [*g.nodes.values(), *g.rels.values()])


def test_log_entries_agree_with_the_log_by_lines(spark):
    """Both logs merged within a commit's row: same order, another order, one-sided paths, renames, binaries, no files."""
    head = lambda h, p="": "\x1e" + "\x1f".join([h, h[:2], "A", "a@x", "2024-01-02", "C", "c@x", "2024-01-03", p, "m"])
    logs = [
        ("h1", "", ["1\t2\ta.py", "-\t-\td/{old => b.bin}"], ["M\ta.py", "R087\twas/b.bin\td/b.bin"]), ("h2", "h1", ["3\t4\tx", "5\t6\ty"], ["A\ty", "M\tx"]),
        ("h3", "h1 h2", ["7\t8\tonly-counted"], ["D\tonly-named", "not a line of a log"]), ("h4", "", [], []),
    ]
    e = spark.createDataFrame([("r", head(h, p), a, b) for h, p, a, b in logs], "repo string, header string, stat array<string>, status array<string>")
    parsed = history.parsed_entries(e)
    lines = lambda k: spark.createDataFrame([("r", i, x) for i, x in enumerate(x for log in logs for x in [head(*log[:2]), *log[k]])], "repo string, line_no bigint, line string")
    stat, status = (history.log_rows(lines(k), "repo") for k in (2, 3))
    files = history.changed_files(history.numstat(stat), history.name_status(status))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(history.entry_changes(parsed)) == rows(files) and len(rows(files)) == 6
    by_line = history.commits(stat, files)
    assert rows(history.entry_commits(parsed)) == rows(by_line.select(*history.entry_commits(parsed).columns)) and by_line.count() == 4


@pytest.mark.parametrize("name", ["log_changed_files", "ingest_changed", "ingest_commits"])
def test_changes_of_a_large_repository_are_not_ordered_in_one_task(spark, name):
    """A log is written and read commit by commit: no window over a repository, and no exchange of single changes."""
    plan = ingest_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_last_change_and_churn_from_the_sums_by_file(spark):
    """The sums that are kept give what the changes give, and files are read without going through the changes again."""
    kept, plain = ingest_queries.history(spark, "/root/testdata/sf0.001", keep=lambda df: df.cache()), ingest_queries.history(spark, "/root/testdata/sf0.001")
    files = spark.read.parquet("/root/testdata/sf0.001/scanned_files.parquet").select(F.concat_ws("/", "repo", "relpath").alias("id"), "repo", F.col("relpath").alias("path")).distinct()
    for g in (kept, plain):
        g.nodes["File"] = files
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(impact.last_change(kept)) == rows(impact.last_change(plain)) and kept.per_file is not None
    cols = ["repo", "path", "churn", "inserted", "deleted", "commits"]
    assert rows(recipes.churn(kept, None).select(*cols)) == rows(recipes.churn(plain, None).select(*cols))
