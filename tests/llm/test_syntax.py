import ast
import json

import pytest

from lodeweave.llm import syntax
from lodeweave.llm.grammars import failure
from lodeweave.llm.peg import Grammar, Tokens

VALID = {
    "json": ['{"a": [1, -2.5e3, true, null, "x\\u0041"]}', "[]", '"s"'],
    "xml": ['<?xml version="1.0"?><!-- c --><a x="1"><b/>t&amp;<![CDATA[<]]></a>', "<a>\n</a>\n"],
    "python": ["", "x: int = 3\nasync def f(a, /, b=1, *c, d, **e) -> int:\n    return await g(*a, **b)\n", "match p:\n    case Point(x=0) | [1, *_] if y:\n        pass\n    case _:\n        pass\n", "with (open(a) as b, c):\n    d[1:2, ...] = {k: v for k, v in e if f} | {*g}\n", "def f[T](x: T): ...\ntype A = int\nprint(f'{x!r}')\n", "if (n := 3) > 2: x = lambda *a, b=1: (yield)\n"],
    "java": ["", 'package a; import static b.C.*; @A(x = {1, 2}) public sealed class D<T extends E & F> permits G { int[] a = {1}, b[]; <U> D(U u) throws X { this(); } record R(int x) { R { } } enum E { A(1) { }, B; } }', "class A { void f() { var x = (List<String>) y; Runnable r = () -> { }; int z = switch (q) { case 1, 2 -> 3; default -> { yield 4; } }; for (var i : xs) if (o instanceof String s && s.length() >> 1 > 2) continue; String::valueOf; try (var a = b()) { } finally { } } }", "interface I { default void f() { } int g(); } @interface J { int x() default 1; }"],
    "go": ["package a\n\nimport (\n\t\"b\"\n)\n\nfunc (s *T[K]) f(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[1]; ok && v != nil {\n\t\treturn 1, nil\n\t}\n\tfor i := range xs {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch t := x.(type) {\n\tcase int:\n\tdefault:\n\t}\n\treturn T{a: []int{1, 2}}, nil\n}\n", "package a\nfunc F[T any](x T) T { return x }\ntype S struct {\n\tA int `json:\"a\"`\n\t*B\n}\n"],
    "javascript": ["", "'use strict'\nclass A extends B { #x = 1; static y; get z() { return this.#x } async *g() {} }\nconst {a, ...b} = c ?? d?.e?.[1] \nlet r = /[/]\\//g.test(s) ? `a${`b${c}`}` : x => ({y: 1})\nfor (const x of y) ; label: for (;;) break label", "import a, {b as c} from 'd'\nexport default async function () {}\nexport * as q from 'r'\n"],
    "typescript": ["", "abstract class A<T extends B = C> implements D { private readonly x?: number[] = []; constructor(private y: string) { super() } @dec() f<U>(this: A, a?: U): a is B { return a as unknown as B } [k: string]: any }", "type A = {readonly [K in keyof B]?: B[K]} & (C | D)[]; interface E extends F<G> { (x: number): string; m?(): void }\nenum X { A = 1, B }\ndeclare module 'm' { export const a: typeof b }\nlet f = <T,>(x: T): x is T => x!; let g = h<number>(1)"],
    "sql": ["", "CREATE TABLE a (id bigint NOT NULL PRIMARY KEY, n decimal(12,2) DEFAULT 0, CONSTRAINT f FOREIGN KEY (n) REFERENCES b (id) ON DELETE CASCADE); INSERT INTO a VALUES (1, 'it''s'), (2, NULL);", "WITH c AS (SELECT x.*, count(*) OVER (PARTITION BY y ORDER BY z) FROM d x LEFT JOIN e USING (id) WHERE a IN (SELECT 1) AND b NOT LIKE 'q%') SELECT CASE WHEN c THEN 1 ELSE 2 END FROM c GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 DESC LIMIT 3", "CREATE PROCEDURE p AS $body$\nBEGIN\n UPDATE x SET y = 1;\nEND; $body$"],
}
INVALID = {
    "json": ["", "{a: 1}", "[1,]", '{"a": 1', "[01]", "'x'"], "xml": ["", "<a><b></a></b>", "<a", "text", "<a x=1/>", "<a/><b/>", "<a>&</a>"],
    "python": ["print 'x'", "def f(:\n  pass", "if x:\ny", "  x = 1", "x = (1", "<<<<<<< HEAD\nx = 1\n=======\n", "a = 'b", "f() = 1", "x = 1 +"],
    "java": ["class A {", "class A { void f() { if (x { } } }", "clas A { }", "class A { <<<<<<< HEAD }"], "go": ["", "func f() {}", "package a\nfunc f() {", "package a\nfunc f() { x := }", "package a\n=======\n"],
    "javascript": ["class A {", "let x: number = 1", "function (", "`a${b`", "a b c"], "typescript": ["interface A { x: ", "class A { f( { } }", "let x: = 1", ">>>>>>> b"], "sql": ["CREATE TABLE a (x int", "INSERT INTO a VALUES (1", "package a;", "SELECT FROM WHERE", "<<<<<<< HEAD"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert failure(language, text) == 0


@pytest.mark.parametrize("language, text", [(k, t) for k, v in INVALID.items() for t in v])
def test_invalid(language, text):
    assert failure(language, text) > 0


def test_agrees_with_standard_parsers():
    import pathlib

    for p in sorted(pathlib.Path(ast.__file__).parent.glob("*.py"))[:25]:
        text = p.read_text(encoding="utf-8", errors="replace")
        assert failure("python", text) == 0, p
        cut = text[: len(text) // 2]
        try:
            ast.parse(cut)
            ok = True
        except SyntaxError:
            ok = False
        assert (failure("python", cut) == 0) == ok, p
    assert failure("json", json.dumps({"a": [1.5, None, {"b": "\n\u2028"}] * 50}, indent=1)) == 0


def test_deep_and_long_texts():
    assert failure("json", "[" * 3000 + "]" * 3000) == 0
    assert failure("python", "x = [" + "1, " * 20_000 + "]\n") == 0


def test_engine_reports_furthest_failure():
    g = Grammar("File = Ab* EOF ; Ab = 'a' ('b' 'c' / 'b' 'd') ;", {"a", "b", "c", "d"}, "File")
    t = Tokens()
    for i, k in enumerate("abdabx"):
        t.add(k, k, i)
    assert g.parse(t) == 5
    assert Grammar("File = (!'b' 'a')+ &EOF ;", {"a", "b"}, "File").parse(Tokens(["a", "a"], ["a", "a"], [1, 1], [False] * 2, [False] * 2)) == -1


LINE = "array<struct<line_no int, line_text string, line_type string>>"


def test_check_files(spark):
    rows = [
        (1, "r", "python", [(2, "  pass", ""), (1, "if x:", "")], "c"), (2, "r", "python", [(1, "<<<<<<< HEAD", ""), (2, "x = 1", "")], "c"), (3, "r", "json", [], "c"), (4, "r", "java", None, "c"), (5, "r", "markdown", [(1, "((", "")], "c"),
        (6, None, "Java", [(1, "class A {", "")], "c"), (7, "r", "sql", [(1, "package a;", ""), (2, "class B { }", "")], "c"), (8, "r", None, [(1, "x", "")], "c"), (9, "r", "python", [(1, None, "")], "c"),
    ]
    df = spark.createDataFrame(rows, f"file_id bigint, repo string, file_type string, code_lines {LINE}, language string")
    got = {r["file_id"]: r for r in syntax.check_files(df).collect()}
    assert {k: r["is_valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 6: False, 7: False, 9: True}
    assert got[2]["cause"] == "conflict" and got[6]["cause"] == "truncated" and got[7]["cause"] == "other language" and got[2]["failed_at_line"] == 1
    rate = {(r["repo"], r["language"]): (r["n_files"], r["n_invalid"]) for r in syntax.rates(syntax.check_files(df)).collect()}
    assert rate["r", "python"] == (3, 1) and rate[None, "java"] == (1, 1)
    assert syntax.check_files(df.limit(0)).count() == 0


SQL_STATEMENTS = [
    "COMMENT ON TABLE a.b IS 'x'", "COMMENT ON COLUMN a.b.c IS NULL", "GRANT SELECT, INSERT (a, b) ON TABLE t TO u WITH GRANT OPTION", "GRANT ALL PRIVILEGES ON db.* TO 'u'@'%'", "REVOKE EXECUTE ON FUNCTION f(int, text) FROM PUBLIC", "GRANT r TO u", "SET search_path TO a, b", "SET x = 1", "SET NAMES utf8", "CREATE USER u IDENTIFIED BY 'x'",
    "CREATE ROLE r WITH LOGIN PASSWORD 'x' VALID UNTIL 'y'", "CREATE LOGIN l WITH PASSWORD = 'x', DEFAULT_DATABASE = d", "CREATE SEQUENCE IF NOT EXISTS s AS bigint START WITH 1 INCREMENT BY -1 OWNED BY t.c", "CREATE TYPE m AS ENUM ('a', 'b')", "CREATE TYPE m AS (a int, b text)", "ALTER ROLE r WITH PASSWORD 'x'", "ALTER SEQUENCE s RESTART WITH 5", "ALTER TYPE m ADD VALUE 'c'",
    "DECLARE @x int = 1, @y varchar(10)", "DECLARE c CURSOR FOR SELECT 1", "CALL f(1, 'a')", "EXEC p @a = 1, @b = 'x'", "COPY t (a, b) FROM STDIN WITH (FORMAT csv)", "EXPLAIN SELECT 1", "USE d", "CREATE SCHEMA IF NOT EXISTS s", "CREATE EXTENSION IF NOT EXISTS e", "ALTER TABLE t OWNER TO u", "BEGIN", "COMMIT", "IF OBJECT_ID('t') IS NOT NULL DROP TABLE t",
]
SQL_BROKEN = [
    "COMMENT ON TABLE x IS", "GRANT SELECT ON", "GRANT SELECT ON t TO", "SET x =", "CREATE USER u IDENTIFIED BY", "CREATE ROLE r WITH PASSWORD", "CREATE SEQUENCE s START WITH", "CREATE TYPE m AS ENUM ('a',", "CREATE TYPE m AS", "ALTER ROLE r WITH PASSWORD", "ALTER SEQUENCE s", "ALTER TABLE t OWNER TO", "DECLARE @x int =", "CALL f(1,", "EXEC p @a =", "COPY t FROM", "REVOKE SELECT ON t",
    "COMMENT ON TABLE x IS 'a' CREATE TABLE t (a int);", "SET NOCOUNT ON CREATE TABLE t (a int,, b)", "GRANT SELECT ON t TO u CREATE TABLE t (a int,, b)", "CREATE SCHEMA s CREATE TABLE t (a int,, b)", "CREATE PROCEDURE p(a int,, b int) AS BEGIN SELECT 1; END",
]


@pytest.mark.parametrize("text", SQL_STATEMENTS)
def test_sql_statements(text):
    assert failure("sql", text + ";") == 0 and failure("sql", text) == 0


@pytest.mark.parametrize("text", SQL_BROKEN)
def test_sql_broken_statements(text):
    assert failure("sql", text) > 0


def test_sql_batches_without_semicolons():
    assert failure("sql", "SET NOCOUNT ON\nSET QUOTED_IDENTIFIER ON\nDECLARE @a int = 1\nSET @a = @a + 1\nCREATE TABLE t (a int)\nGO\nEXEC p @a\nSELECT 1\n") == 0
