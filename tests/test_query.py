import pytest

from lodeweave.operators.graph import Graph
from lodeweave.query.guard import Refused, denial, masked
from lodeweave.query.pattern import compile_query, read, read_sql


@pytest.mark.parametrize("query, reason", [
    ("", "empty"), ("  // nothing here", "empty"), ("PROFILE", "empty"), ("y" * 9000, "longer"), ("MATCH (a:File) RETURN a.id; RETURN 2", "multi"), ("MATCH (a:File) SET a.path = 'z' RETURN a", "SET"), ("MATCH (a:File) DETACH DELETE a", "DETACH"), ("INSERT (:File)", "INSERT"), ("MERGE (a:File) RETURN a", "MERGE"),
    ("MATCH (a) WHERE a.name = 'it\\'s' CALL tools.wait(9) RETURN a", "tools.wait"), ('RETURN "a\\"b" ; DROP INDEX i', "multi"), ("EXPLAIN SHOW INDEXES", "SHOW"), ("MATCH (a) RETURN a.id AS i UNION USE other MATCH (b) RETURN b.id AS i", "USE"), ("CALL { USE other MATCH (b) RETURN b } RETURN b", "USE"),
    ("LOAD CSV FROM 'file' AS row RETURN row", "LOAD CSV"), ("RETURN tools . text /* x */ . join ('x') AS j", "tools.text"), ("MATCH (a) WHERE tools.near(a.name, 'x') RETURN a", "tools.near"), ("MATCH (a) RETURN a LIMIT 9_999", "LIMIT"), ("MATCH (a) RETURN a LIMIT 0xFF", "LIMIT"),
    ("MATCH (a) /* never", "unterminated comment"), ("MATCH (a:`never) RETURN a", "unterminated quoted"), ("MATCH (a) WHERE a.x = 'never RETURN a", "unterminated string"), ("MATCH (a) RETURN a \u00a7", "unexpected"),
])
def test_refused(query, reason):
    assert reason in (denial(query) or "")


@pytest.mark.parametrize("query", ["MATCH (n) RETURN n LIMIT 500", "MATCH (n:Set) WHERE n.delete = 1 RETURN n", "CALL db.labels() YIELD label RETURN label", "MATCH (a)-[:CREATE]->(b) RETURN a", "RETURN date.truncate('day', $d)", "MATCH (n) RETURN n;", "MATCH (n) WHERE n.name = 'DROP; CREATE' RETURN n"])
def test_allowed(query):
    assert denial(query) is None


def test_mask_keeps_offsets():
    q = "RETURN 'LIMIT 5' // LIMIT"
    assert len(masked(q)) == len(q) and "LIMIT" not in masked(q)


@pytest.fixture(scope="module")
def g(spark):
    f = spark.createDataFrame([("f1", "a.py", "r1"), ("f2", "b.py", "r1"), ("f3", "c.py", None)], "id string, path string, repo string")
    c = spark.createDataFrame([("c1", "One", 3), ("c2", "Two", None), ("c3", "three", 5)], "id string, name string, line_no int")
    has = spark.createDataFrame([("f1", "c1"), ("f1", "c2"), ("f2", "c3")], "src string, dst string")
    imp = spark.createDataFrame([("c1", "c3"), ("c2", "c2")], "src string, dst string")
    return Graph({"File": f, "Class": c}, {"CONTAINS_CLASS": has, "IMPORTS": imp})


@pytest.mark.parametrize("query, want", [
    ("MATCH (f:File) WHERE f.repo = 'r1' RETURN f.path AS p ORDER BY p", [("a.py",), ("b.py",)]),
    ("MATCH (f:File {path: $p})-[:CONTAINS_CLASS]->(c:Class) RETURN c.name AS n ORDER BY n", [("One",), ("Two",)]),
    ("MATCH (c:Class)<-[:CONTAINS_CLASS]-(f:File) RETURN f.path AS p, count(DISTINCT c) AS n ORDER BY n DESC, p", [("a.py", 2), ("b.py", 1)]),
    ("MATCH (f:File) OPTIONAL MATCH (f)-[:CONTAINS_CLASS]->(c:Class) WHERE c.line_no > 1 RETURN f.path AS p, collect(c.name) AS ns ORDER BY p", [("a.py", ["One"]), ("b.py", ["three"]), ("c.py", [])]),
    ("MATCH (f:File)-[:CONTAINS_CLASS]->(c:Class) WITH f, count(*) AS n WHERE n > 1 RETURN f.path AS p, n", [("a.py", 2)]),
    ("MATCH (a:Class)-[:IMPORTS]-(b:Class) RETURN a.name AS a, b.name AS b ORDER BY a", [("One", "three"), ("Two", "Two"), ("three", "One")]),
    ("MATCH (c:Class) RETURN c.name AS n ORDER BY c.line_no DESC, n SKIP 1 LIMIT 1", [("three",)]),
    ("MATCH (c:Class) WHERE toLower(c.name) STARTS WITH 't' AND c.line_no IS NULL RETURN c.name + '!' AS x, coalesce(c.line_no, 0) AS l", [("Two!", 0)]),
    ("MATCH (f:File) RETURN f.path AS x UNION MATCH (c:Class) WHERE c.name IN ['One', 'x'] RETURN c.name AS x", [("One",), ("a.py",), ("b.py",), ("c.py",)]),
    ("MATCH (c:Class) RETURN count(*) AS n, max(c.line_no) AS m, substring('abc', 1, 1) AS s, CASE WHEN count(*) > 2 THEN 'many' ELSE 'few' END AS k", [(3, 5, "b", "many")]),
    ("MATCH (a:File)-[:CONTAINS_CLASS]->(x:Class)-[:IMPORTS]->(y:Class)<-[:CONTAINS_CLASS]-(b:File) WHERE a.id <> b.id RETURN a.path AS a, b.path AS b", [("a.py", "b.py")]),
    ("MATCH (x:File|Class) RETURN count(x) AS n", [(6,)]),
])
def test_patterns(g, query, want):
    rows = [tuple(r) for r in compile_query(g, query, {"p": "a.py"}).collect()]
    assert (rows if "ORDER" in query else sorted(rows)) == want


@pytest.mark.parametrize("query", ["MATCH (n:Nope) RETURN n", "MATCH (a)-[:NOPE]->(b) RETURN a", "MATCH (a:File)-[*1..3]->(b) RETURN a", "MATCH (a:File) RETURN b.x", "MATCH (a:File) RETURN foo(a.id)"])
def test_outside_the_subset(g, query):
    with pytest.raises(Refused):
        compile_query(g, query)


def test_read_limits_and_sql(spark, g):
    assert len(read(g, "MATCH (c:Class) RETURN c.id AS id", limit=2)) == 2
    assert read_sql(spark, g, "SELECT count(*) AS n FROM File").first()["n"] == 3
    for bad in ("DROP TABLE File", "CREATE TABLE x (a int)", "INSERT INTO File VALUES ('a', 'b', 'c')"):
        with pytest.raises(Refused):
            read_sql(spark, g, bad)


@pytest.fixture(scope="module")
def catalog(spark):
    t = spark.createDataFrame([("t1", "a", "d"), ("t2", "b", "d"), ("t3", "c", "e")], "id string, name string, database string")
    ix = spark.createDataFrame([("i1", "ix", ["x", "YY"]), ("i2", "iy", []), ("i3", "iz", None)], "id string, name string, columns array<string>")
    c = spark.createDataFrame([("c1", "A", "a", "Entity"), ("c2", "B", None, "")], "id string, name string, mapped_table string, stereotype string")
    r = spark.createDataFrame([("t1", "t2"), ("t2", "t2")], "src string, dst string")
    m = spark.createDataFrame([("c1", "t1")], "src string, dst string")
    return Graph({"Table": t, "Index": ix, "Class": c}, {"REFERENCES": r, "MAPS_TO": m})


@pytest.mark.parametrize("query, want", [
    ("MATCH (t:Table) WHERE NOT (t)<-[:REFERENCES]-() RETURN t.name AS n", [("a",), ("c",)]), ("MATCH (t:Table) WHERE NOT (t)-[:REFERENCES]->(:Table) AND NOT (t)<-[:REFERENCES]-() AND NOT (:Class)-[:MAPS_TO]->(t) RETURN t.name AS n", [("c",)]),
    ("MATCH (t:Table) WHERE NOT EXISTS { MATCH (t)<-[:REFERENCES]-(o:Table) WHERE o.id <> t.id } RETURN t.name AS n", [("a",), ("c",)]), ("MATCH (t:Table) RETURN t.name AS n, COUNT { (t)<-[:REFERENCES]-() } AS k", [("a", 0), ("b", 2), ("c", 0)]),
    ("MATCH (i:Index) WHERE any(x IN i.columns WHERE toLower(x) CONTAINS 'y') RETURN i.name AS n", [("ix",)]), ("MATCH (i:Index) WHERE all(x IN i.columns WHERE x = 'q') RETURN i.name AS n", [("iy",)]), ("MATCH (i:Index {name: 'ix'}) RETURN reduce(a = '', x IN i.columns | a + x) AS r, [x IN i.columns WHERE x <> 'x' | toLower(x)] AS l", [("xYY", ["yy"])]),
    ("CALL db.labels() YIELD label AS l RETURN l", [("Class",), ("Index",), ("Table",)]), ("CALL db.relationshipTypes()", [("MAPS_TO",), ("REFERENCES",)]), ("UNWIND $names AS n MATCH (t:Table {name: n}) RETURN t.id AS id", [("t1",)]), ("UNWIND [1, 2] AS x RETURN x * 2 AS y", [(2,), (4,)]),
    ("MATCH (c:Class), (t:Table) WHERE toLower(c.mapped_table) = toLower(t.name) RETURN c.name AS c, t.name AS t", [("A", "a")]), ("MATCH (e:Entity) RETURN e.name AS n, labels(e) AS l", [("A", ["Class", "Entity"])]), ("MATCH (n) WHERE n:Table OR n:Class RETURN n.id AS i", [("c1",), ("c2",), ("t1",), ("t2",), ("t3",)]),
    ("MATCH (a:Table)-[:REFERENCES]->(b:Table) WHERE a <> b RETURN a.name AS a", [("a",)]), ("MATCH (t:Table)<-[:REFERENCES]-(o:Table) RETURN collect(DISTINCT {name: o.name})[0].name AS n", [("a",)]), ("MATCH (t:Table)<-[r:MAPS_TO]-(c) RETURN type(r) AS ty, startNode(r).id AS s, head(labels(c)) AS l", [("MAPS_TO", "c1", "Class")]),
    ("MATCH (t:Table) OPTIONAL MATCH (t)<-[:MAPS_TO]-(c:Class) WHERE NOT (c)-[:MAPS_TO]->(:Table {name: 'a'}) RETURN t.name AS n, c.name AS c", [("a", None), ("b", None), ("c", None)]),
])
def test_conditions_lists_and_procedures(catalog, query, want):
    assert sorted(map(tuple, compile_query(catalog, query, {"names": ["a", "z"]}).collect())) == want


@pytest.mark.parametrize("query", ["MATCH (c:Class), (t:Table) RETURN c.name AS c, t.name AS t", "MATCH (t:Table) WHERE EXISTS { MATCH (:Class)-[:MAPS_TO]->(:Table) } RETURN t.id AS i", "CALL { MATCH (n:Table) RETURN n } RETURN 1 AS x", "MATCH (t:Nope) RETURN t.id AS i"])
def test_refuses_products_and_subqueries(catalog, query):
    with pytest.raises(Refused):
        compile_query(catalog, query)


@pytest.mark.parametrize("query", [
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM Class INSERT INTO a SELECT id INSERT INTO b SELECT id", "REPLACE TABLE t USING parquet AS SELECT 1", "UNCACHE TABLE Class", "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')", "SELECT reflect('java.lang.Math', 'abs', 1)", "SELECT * FROM text.`/etc/hostname`",
    "SELECT * FROM range(5)", "SET x = 1", "SELECT (SELECT max(id) FROM other) FROM Class", "SELECT id FROM Class; SELECT 1", "SELECT id FROM Class WHERE id IN (SELECT java_method('a', 'b'))", "SELECT id FROM Class ORDER BY reflect('a', 'b')", "WITH x AS (SELECT * FROM other) SELECT * FROM x", "SELECT current_user()", "", "x" * 9000,
])
def test_sql_that_is_refused(spark, catalog, query):
    with pytest.raises(Refused):
        read_sql(spark, catalog, query)


@pytest.mark.parametrize("query, n", [
    ("WITH x AS (SELECT * FROM `Table`) SELECT t.id FROM x t JOIN `REFERENCES` r ON r.src = t.id WHERE EXISTS (SELECT 1 FROM Class c WHERE c.mapped_table = t.name)", 1), ("SELECT id, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM Class", 2), ("SELECT explode(columns) AS c FROM Index", 2), ("SELECT id FROM Index LATERAL VIEW explode(columns) t AS c", 2),
    ("SELECT id FROM Class WHERE id IN (SELECT src FROM MAPS_TO) UNION ALL SELECT id FROM `Table`", 4), ("SELECT name, count(*) AS c FROM Class GROUP BY name HAVING count(*) > 0 ORDER BY c LIMIT 1", 1),
])
def test_sql_that_is_allowed(spark, catalog, query, n):
    spark.range(7).createOrReplaceTempView("Class")
    assert read_sql(spark, catalog, query).count() == n
    assert spark.table("Class").count() == 7 and not spark.catalog.tableExists("MAPS_TO")  # the session is as it was
    spark.catalog.dropTempView("Class")


def test_time_limit(spark, catalog):
    import pyspark.sql.functions as F

    slow = spark.range(0, 10**12, 1, 4).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("name"))
    with pytest.raises(TimeoutError):
        read(Graph({"Slow": slow}, {}), "MATCH (s:Slow) WHERE s.id = 'never' RETURN s.id AS i", seconds=2)
