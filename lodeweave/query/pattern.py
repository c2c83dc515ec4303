"""A subset of the pattern language, compiled to DataFrames.

MATCH / OPTIONAL MATCH with node patterns, labels, property maps and relationships (directed, reverse,
undirected, alternatives), WHERE with three-valued logic and patterns as conditions (also EXISTS {} and COUNT {}),
WITH, UNWIND, the schema procedures, RETURN [DISTINCT] with aggregates, ORDER BY, SKIP, LIMIT and UNION [ALL].
Labels select typed tables, so a label scan reads one table; a pattern step is an equi-join on ids, a pattern as
a condition a join with the distinct ids it holds for. What the subset does not hold is refused with a
reason, as are patterns that nothing connects, which would give all pairs.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.graph import Graph
from lodeweave.query.guard import DEFAULT_LIMIT, MAX_LIMIT, TIMEOUT_SECONDS, Refused, Token, denial, tokens
from lodeweave.query.sql_guard import sql_denial

_CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "ORDER", "SKIP", "LIMIT", "UNION", "CALL", "UNWIND"}
# Labels that frameworks give to classes, beside their own.
FRAMEWORK_LABELS = ["Entity", "ManagedBean", "EJBBean", "DataClass", "Component", "Service", "NgModule", "Controller"]
_AGGREGATES = {"count", "sum", "max", "min", "avg", "collect"}


def _text(c: Column) -> bool:
    """Whether an expression is known to be text, where ``+`` joins instead of adding."""
    return vars(c).get("_is_text", False)


@dataclass
class Scope:
    df: DataFrame | None = None
    nodes: dict[str, dict[str, str]] = field(default_factory=dict)  # variable -> property -> column
    labels: dict[str, list[str]] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)  # name -> column


class Compiler:
    def __init__(self, graph: Graph, params: dict | None = None):
        self.g, self.params, self.serial = graph, params or {}, 0
        self._texts: set[str] = set()
        self._locals: dict[str, Column] = {}  # variables of list functions

    # -- tokens ---------------------------------------------------------------
    def run(self, query: str) -> DataFrame:
        reason = denial(query)
        if reason:
            raise Refused(reason)
        self.t: list[Token] = [x for x in tokens(query) if x.text != ";"]
        self.k = 0
        out = self._single()
        while self._word("UNION"):
            everything = self._word("ALL")
            other = self._single()
            if other.columns != out.columns:
                raise Refused("UNION needs the same columns on both sides")
            out = out.union(other) if everything else out.union(other).distinct()
        if self.k < len(self.t):
            raise Refused(f"not supported: {self.t[self.k].text!r}")
        return out

    def _peek(self, n: int = 0) -> Token:
        return self.t[self.k + n] if self.k + n < len(self.t) else Token("end", "", -1)

    def _word(self, *words: str) -> bool:
        if all(self._peek(i).word == w for i, w in enumerate(words)):
            self.k += len(words)
            return True
        return False

    def _sign(self, s: str) -> bool:
        if self._peek().text == s and self._peek().kind == "sign":
            self.k += 1
            return True
        return False

    def _need(self, s: str) -> None:
        if not self._sign(s):
            raise Refused(f"expected {s!r} before {self._peek().text!r}")

    def _name(self) -> str:
        x = self._peek()
        if x.kind not in ("name", "quoted"):
            raise Refused(f"expected a name before {x.text!r}")
        self.k += 1
        return x.text.strip("`")

    def _fresh(self, hint: str) -> str:
        self.serial += 1
        return f"{hint}_{self.serial}"

    # -- clauses --------------------------------------------------------------
    def _single(self) -> DataFrame:
        s = Scope()
        while True:
            if self._word("OPTIONAL", "MATCH"):
                s = self._match(s, optional=True)
            elif self._word("MATCH"):
                s = self._match(s, optional=False)
            elif self._word("WITH"):
                s = self._project(s, last=False)
            elif self._word("UNWIND"):
                s = self._unwind(s)
            elif self._word("CALL"):
                s = self._procedure(s)
                if self.k == len(self.t):
                    return s.df.select(*[F.col(c).alias(n) for n, c in s.values.items()])
            elif self._word("RETURN"):
                return self._project(s, last=True)
            else:
                raise Refused(f"not supported: {self._peek().text!r}")

    def _unwind(self, s: Scope) -> Scope:
        """UNWIND list AS x: a row for every element; none for an empty or null list."""
        items = self._expr(s)
        if not self._word("AS"):
            raise Refused("expected AS")
        name, col = self._name(), self._fresh("v")
        base = s.df if s.df is not None else SparkSession.getActiveSession().range(1)
        return Scope(base.select("*", F.explode(items).alias(col)), s.nodes, s.labels, {**s.values, name: col})

    def _procedure(self, s: Scope) -> Scope:
        """CALL db.labels(), db.relationshipTypes() or db.propertyKeys() [YIELD x [AS y]]."""
        if s.df is not None or self._peek().text == "{":
            raise Refused("subqueries by CALL are not supported")
        parts = [self._name()]
        while self._sign("."):
            parts.append(self._name())
        self._need("(")
        self._need(")")
        every = {**self.g.nodes, **self.g.rels}
        made = {"db.labels": ("label", list(self.g.nodes)), "db.relationshiptypes": ("relationshipType", list(self.g.rels)), "db.propertykeys": ("propertyKey", sorted({c for df in every.values() for c in df.columns} - {"id", "src", "dst", "labels"}))}
        name, values = made[".".join(parts).lower()]
        shown = name
        if self._word("YIELD"):
            if self._name() != name:
                raise Refused(f"the procedure yields {name}")
            shown = self._name() if self._word("AS") else name
        col = self._fresh("v")
        self._texts.add(col)
        return Scope(SparkSession.getActiveSession().createDataFrame([(v,) for v in values], f"`{col}` string"), {}, {}, {shown: col})

    def _condition(self, s: Scope, counted: bool = False) -> Column:
        """A pattern as a condition (or, ``counted``, as a number of matches): joined by the ids of its known variables."""
        if s.df is None:
            raise Refused("a pattern cannot stand here as a condition")
        kept = self._part_vars, self._bound, self._copies
        inner, tied, filters, part = Scope(None, dict(s.nodes), dict(s.labels), dict(s.values)), [], [], None
        while True:
            part = self._pattern(inner, s, part, tied, filters)
            if not self._sign(","):
                break
        inner.nodes |= self._copies
        inner.df = part
        for f in filters:
            inner.df = inner.df.where(f)
        if self._word("WHERE"):
            inner.df = self._where(inner)
        self._part_vars, self._bound, self._copies = kept
        if not tied:
            raise Refused("a pattern as a condition needs a variable that is known outside")
        keys = [(a, self._fresh("k")) for a, _ in tied]
        found = inner.df.select(*[F.col(b).alias(k) for (_, b), (_, k) in zip(tied, keys)]).groupBy(*[k for _, k in keys]).agg(F.count("*").alias(mark := self._fresh("found")))
        s.df = s.df.join(found, reduce(lambda x, y: x & y, [F.col(a) == F.col(k) for a, k in keys]), "left")
        n = F.coalesce(F.col(mark), F.lit(0))
        return n if counted else n > 0

    def _is_pattern(self) -> bool:
        """Whether a parenthesis opens a node of a pattern: a relationship follows it."""
        if self._peek(1).text not in (")", ":") and self._peek(1).kind not in ("name", "quoted") or self._peek(2).text == ".":
            return False
        depth, n = 0, 0
        while self._peek(n).kind != "end":
            depth += {"(": 1, ")": -1}.get(self._peek(n).text, 0)
            if depth == 0:
                a, b = self._peek(n + 1).text, self._peek(n + 2).text
                return a in ("<-",) and b in ("[", "-") or a == "-" and b in ("[", "-", "->") or a == "->"
            n += 1
        return False

    def _match(self, s: Scope, optional: bool) -> Scope:
        new = Scope(None, dict(s.nodes), dict(s.labels), dict(s.values))
        tied: list[tuple[str, str]] = []  # a known column and the column of its copy
        filters: list[Column] = []
        part = None
        while True:
            part = self._pattern(new, s, part, tied, filters)
            if not self._sign(","):
                break
        seen = Scope(None, new.nodes, new.labels, new.values)
        if s.df is None:
            new.df = part
            for f in filters:
                new.df = new.df.where(f)
            if self._word("WHERE"):
                new.df = self._where(new)
            return new
        on = [F.col(a) == F.col(b) for a, b in tied] + filters
        if self._word("WHERE"):
            seen.df = part
            seen.nodes = {**new.nodes, **self._copies}
            on.append(self._expr(seen))
            part = seen.df
        cond = reduce(lambda a, b: a & b, on) if on else F.lit(True)
        new.df = s.df.join(part, cond, "left" if optional else "inner")
        return new

    def _where(self, s: Scope) -> DataFrame:
        cond = self._expr(s)  # patterns in it add to the frame first
        return s.df.where(cond)

    def _node(self, new: Scope, old: Scope, tied: list, filters: list) -> tuple[str, DataFrame | None]:
        """Reads (v:L|M {p: x}); returns the variable's id column and the table to join, None if it is bound in this part."""
        self._need("(")
        var = self._name() if self._peek().kind in ("name", "quoted") else self._fresh("anon")
        labels = []
        if self._sign(":"):
            labels.append(self._name())
            while self._sign("|") or self._sign(":"):
                labels.append(self._name())
        given = self._map(new) if self._peek().text == "{" else {}
        self._need(")")
        if var in new.nodes and var not in old.nodes or var in getattr(self, "_part_vars", set()):
            return var, None
        pre = self._fresh(var)
        labels = labels or old.labels.get(var) or list(self.g.nodes)
        unknown = [x for x in labels if x not in self.g.nodes]
        framework = len(labels) == 1 and unknown and "stereotype" in self.g.nodes.get("Class", SparkSession.getActiveSession().range(0)).columns and (labels[0] in FRAMEWORK_LABELS)
        if unknown and not framework:
            raise Refused(f"unknown label {unknown[0]}")
        if framework:
            n = self.g.nodes["Class"].where(F.col("stereotype") == labels[0]).withColumn("labels", F.array(F.lit("Class"), F.lit(labels[0])))
            labels = ["Class"]
        elif len(labels) == 1:
            n = self.g.nodes[labels[0]].withColumn("labels", F.array(F.lit(labels[0])))
        else:
            n = self.g.all_nodes(*labels).withColumn("labels", F.array("label")).drop("label")
        cols = {c: f"{pre}.{c}".replace(".", "__") for c in n.columns}
        self._texts |= {cols[c] for c, kind in n.dtypes if kind == "string"}
        table = n.select(*[F.col(c).alias(x) for c, x in cols.items()])
        if var in old.nodes:
            tied.append((old.nodes[var]["id"], cols["id"]))
            self._copies[var] = cols
        else:
            new.nodes[var], new.labels[var] = cols, labels
        self._part_vars.add(var)
        self._bound[var] = cols
        for k, v in given.items():
            if k in cols and old.df is not None:
                filters.append(F.col(cols[k]) == v)  # may name what is known outside
            else:
                table = table.where(F.col(cols[k]) == v) if k in cols else table.where(F.lit(False))
        return var, table

    def _pattern(self, new: Scope, old: Scope, part: DataFrame | None, tied: list, filters: list) -> DataFrame:
        if part is None:
            self._part_vars, self._bound, self._copies = set(), {}, {}
        var, table = self._node(new, old, tied, filters)
        if table is not None:
            part = table if part is None else part.join(table, F.lit(True))  # what WHERE equates becomes the join's condition
        while self._peek().text in ("-", "<-", "->", "<"):
            left = self._sign("<-") or (self._sign("<") and (self._need("-") or True))
            if not left:
                self._need("-")
            types, rvar = [], None
            if self._sign("["):
                if self._peek().kind in ("name", "quoted"):
                    rvar = self._name()
                if self._sign(":"):
                    types.append(self._name())
                    while self._sign("|"):
                        self._sign(":")
                        types.append(self._name())
                if self._peek().text in ("*", "{"):
                    raise Refused("variable length paths and relationship maps are not supported")
                self._need("]")
            right = self._sign("->") or (self._sign("-") and self._sign(">"))
            if not right and not left and self.t[self.k - 1].text == "]":
                self._need("-")
            here = self._bound[var]["id"]
            other, table = self._node(new, old, tied, filters)
            there = self._bound[other]["id"]
            rel, cols = self._rel(types, rvar)
            if rvar:
                new.nodes[rvar] = cols
            a, b = cols["src"], cols["dst"]
            if left:
                a, b = b, a
            if left == bool(right):  # undirected: both directions, a self loop once
                back = rel.where(F.col(a) != F.col(b)).select(*[F.col(b if c == a else a if c == b else c).alias(c) for c in rel.columns])
                rel = rel.unionByName(back)
            if "src_label" in cols:  # types whose sources differ in label
                part = part.join(rel, (F.col(here) == F.col(a)) & F.array_contains(F.col(self._bound[var]["labels"]), F.col(cols["src_label"])) if a == cols["src"] else F.col(here) == F.col(a))
            else:
                part = part.join(rel, F.col(here) == F.col(a))
            meet = F.col(b) == F.col(there)
            if "src_label" in cols and b == cols["src"]:
                meet = meet & F.array_contains(F.col(self._bound[other]["labels"]), F.col(cols["src_label"]))
            part = part.join(table, meet) if table is not None else part.where(meet)
            var = other
        return part

    def _rel(self, types: list[str], rvar: str | None) -> tuple[DataFrame, dict[str, str]]:
        types = types or list(self.g.rels)
        unknown = [x for x in types if x not in self.g.rels]
        if unknown:
            raise Refused(f"unknown relationship type {unknown[0]}")
        pre = self._fresh(rvar or "rel")
        one = len(types) == 1
        df = self.g.rels[types[0]].withColumn("type", F.lit(types[0])) if one else self.g.all_rels(*types).select("type", "src", "dst")
        cols = {c: f"{pre}__{c}" for c in df.columns}
        return df.select(*[F.col(c).alias(x) for c, x in cols.items()]), cols

    def _map(self, s: Scope) -> dict[str, Column]:
        out = {}
        self._need("{")
        while not self._sign("}"):
            k = self._name()
            self._need(":")
            out[k] = self._expr(s)
            self._sign(",")
        return out

    # -- projection -------------------------------------------------------------
    def _project(self, s: Scope, last: bool):
        distinct = self._word("DISTINCT")
        items: list[tuple[str, Column, bool, str | None]] = []
        while True:
            start = self.k
            self._used_aggregate = False
            bare = self._peek().text.strip("`") if self._peek().kind in ("name", "quoted") and (self._peek(1).text in (",", "", "}") or self._peek(1).word in _CLAUSES | {"AS"}) else None
            c = self._expr(s)
            text = "".join(x.text for x in self.t[start : self.k])
            name = self._name() if self._word("AS") else text
            items.append((name, c, self._used_aggregate, bare if bare in s.nodes else None))
            if not self._sign(","):
                break
        order, limit, skip = [], None, None
        new = Scope(None, {}, {}, {})
        keys = [(n, c, v) for n, c, agg, v in items if not agg]
        aggs = [(n, c) for n, c, agg, _ in items if agg]
        base = s.df if s.df is not None else SparkSession.getActiveSession().range(1)
        picked, out = [], []
        for n, c, v in keys:
            if v and not last:
                cols = {p: f"{self._fresh(n)}__{p}" for p in s.nodes[v]}
                picked += [F.col(s.nodes[v][p]).alias(x) for p, x in cols.items()]
                new.nodes[n], new.labels[n] = cols, s.labels.get(v, [])
            else:
                col = self._fresh("v") if not last else n
                picked.append(c.alias(col))
                new.values[n] = col
                out.append(n)
        if aggs:
            extra = [(n, self._fresh("a") if not last else n, c) for n, c in aggs]
            names = [f"_g{i}" for i in range(len(picked))]
            plain = [x.alias(g) for x, g in zip(picked, names)]
            frame = base.groupBy(*plain).agg(*[c.alias(x) for _, x, c in extra])
            final = [f for f in base.select(*picked).columns]
            frame = frame.select(*[F.col(g).alias(f) for g, f in zip(names, final)], *[F.col(x) for _, x, _ in extra])
            new.values |= {n: x for n, x, _ in extra}
        else:
            frame = base.select(*picked)
        if distinct:
            frame = frame.distinct()
        new.df = frame
        if not last and self._word("WHERE"):
            new.df = self._where(new)
        if self._word("ORDER"):
            if not self._word("BY"):
                raise Refused("expected BY")
            while True:
                e = self._expr(new if not s.nodes or aggs or distinct or not last else Scope(None, s.nodes, s.labels, {**s.values, **new.values}))
                desc = self._word("DESC") or self._word("DESCENDING")
                self._word("ASC")
                order.append(e.desc_nulls_first() if desc else e.asc_nulls_last())
                if not self._sign(","):
                    break
        if self._word("SKIP"):
            skip = self._count(s)
        if self._word("LIMIT"):
            limit = self._count(s)
        if order:
            new.df = new.df.orderBy(*order)
        if skip:
            new.df = new.df.offset(skip)
        if limit is not None:
            new.df = new.df.limit(limit)
        return new.df.select(*[F.col(f"`{n}`") for n, *_ in items]) if last else new

    def _count(self, s: Scope) -> int:
        x = self._peek()
        self.k += 1
        return int(self.params[x.text[1:]]) if x.kind == "param" else int(float(x.text.replace("_", "")))

    # -- expressions --------------------------------------------------------------
    def _expr(self, s: Scope) -> Column:
        a = self._xor(s)
        while self._word("OR"):
            a = a | self._xor(s)
        return a

    def _xor(self, s: Scope) -> Column:
        a = self._not(s)
        while self._word("AND"):
            a = a & self._not(s)
        return a

    def _not(self, s: Scope) -> Column:
        return ~self._not(s) if self._word("NOT") else self._compare(s)

    def _compare(self, s: Scope) -> Column:
        a = self._sum(s)
        while True:
            t = self._peek()
            if t.text in ("=", "<>", "<", ">", "<=", ">=") and t.kind == "sign":
                self.k += 1
                b = self._sum(s)
                if "_id_of" in vars(a) and "_id_of" in vars(b):  # nodes are equal if their ids are
                    a, b = F.col(a._id_of), F.col(b._id_of)
                a = {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[t.text]
            elif self._word("IS", "NOT", "NULL"):
                a = a.isNotNull()
            elif self._word("IS", "NULL"):
                a = a.isNull()
            elif self._word("CONTAINS"):
                a = a.contains(self._sum(s))
            elif self._word("STARTS", "WITH"):
                a = a.startswith(self._sum(s))
            elif self._word("ENDS", "WITH"):
                a = a.endswith(self._sum(s))
            elif self._word("IN"):
                a = F.array_contains(self._sum(s), a)
            else:
                return a

    def _sum(self, s: Scope) -> Column:
        a = self._product(s)
        while self._peek().text in ("+", "-") and self._peek().kind == "sign":
            op = self._peek().text
            self.k += 1
            b = self._product(s)
            text = _text(a) or _text(b)
            a = self._mark(F.concat(a, b), True) if op == "+" and text else a + b if op == "+" else a - b
        return a

    def _product(self, s: Scope) -> Column:
        a = self._atom(s)
        while self._peek().text in ("*", "/", "%") and self._peek().kind == "sign":
            op = self._peek().text
            self.k += 1
            b = self._atom(s)
            a = a * b if op == "*" else a / b if op == "/" else a % b
        return a

    def _mark(self, c: Column, text: bool) -> Column:
        c._is_text = text
        return c

    def _atom(self, s: Scope) -> Column:
        t = self._peek()
        if t.kind == "string":
            self.k += 1
            return self._mark(F.lit(t.text[1:-1].replace("\\'", "'").replace('\\"', '"').replace("\\\\", "\\")), True)
        if t.kind == "number":
            self.k += 1
            x = t.text.replace("_", "")
            return F.lit(float(x) if "." in x or "e" in x.lower() else int(x))
        if t.kind == "param":
            self.k += 1
            if t.text[1:] not in self.params:
                raise Refused(f"no parameter {t.text}")
            v = self.params[t.text[1:]]
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else self._mark(F.lit(v), isinstance(v, str))
        if self._sign("-"):
            return -self._atom(s)
        if t.text == "(" and self._is_pattern():
            return self._condition(s)
        if self._sign("("):
            c = self._expr(s)
            self._need(")")
            return self._after(c, s)
        if t.word in ("EXISTS", "COUNT") and self._peek(1).text == "{":
            self.k += 2
            self._word("MATCH")
            c = self._condition(s, counted=t.word == "COUNT")
            self._need("}")
            return c
        if t.text == "[" and self._peek(1).kind == "name" and self._peek(2).word == "IN":
            self.k += 1
            return self._after(self._listed(s), s)
        if self._sign("["):
            items = []
            while not self._sign("]"):
                items.append(self._expr(s))
                self._sign(",")
            return self._after(F.array(*items), s)
        if t.text == "{":
            m = self._map(s)
            return F.struct(*[c.alias(k) for k, c in m.items()])
        if self._word("CASE"):
            out = None
            while self._word("WHEN"):
                cond = self._expr(s)
                if not self._word("THEN"):
                    raise Refused("expected THEN")
                v = self._expr(s)
                out = F.when(cond, v) if out is None else out.when(cond, v)
            if self._word("ELSE"):
                out = out.otherwise(self._expr(s))
            if not self._word("END"):
                raise Refused("expected END")
            return out
        if t.word in ("TRUE", "FALSE", "NULL") and self._peek(1).text not in (".", "("):
            self.k += 1
            return F.lit({"TRUE": True, "FALSE": False, "NULL": None}[t.word])
        name = self._name()
        if name in self._locals:
            c = self._locals[name]
            return self._after(c.getField(self._name()) if self._sign(".") else c, s)
        while self._peek().text == "." and self._peek(2).text in ("(", ".") and name not in s.nodes and name not in s.values:
            self.k += 1
            name = f"{name}.{self._name()}"
        if self._sign("("):
            return self._after(self._call(name.lower(), s), s)
        if self._sign("."):
            p = self._name()
            if name in s.values:
                return self._after(F.col(f"`{s.values[name]}`").getField(p), s)
            cols = s.nodes.get(name)
            if cols is None:
                raise Refused(f"unknown variable {name}")
            return self._after(self._mark(F.col(cols[p]), cols[p] in self._texts) if p in cols else F.lit(None).cast("string"), s)
        if name in s.values:
            return self._after(self._mark(F.col(f"`{s.values[name]}`"), s.values[name] in self._texts), s)
        if name in s.nodes and "labels" in s.nodes[name] and self._sign(":"):
            wanted = [self._name()]
            while self._sign("|"):
                wanted.append(self._name())
            return F.arrays_overlap(F.col(s.nodes[name]["labels"]), F.array(*map(F.lit, wanted)))
        if name in s.nodes:
            node = F.struct(*[F.col(x).alias(p) for p, x in s.nodes[name].items()])
            if "id" in s.nodes[name]:
                node._id_of = s.nodes[name]["id"]
            return node
        raise Refused(f"unknown variable {name}")

    def _with_local(self, s: Scope, start: int, **given: Column) -> Column:
        """The expression from a token on, with variables of a list function."""
        before, self._locals, self.k = self._locals, {**self._locals, **given}, start
        c = self._expr(s)
        self._locals = before
        return c

    def _listed(self, s: Scope) -> Column:
        """x IN list [WHERE condition] [| value] up to the closing bracket."""
        name = self._name()
        self._word("IN")
        items = self._expr(s)
        if self._word("WHERE"):
            at = self.k
            items = F.filter(items, lambda x: self._with_local(s, at, **{name: x}))
        if self._sign("|"):
            then = self.k
            items = F.transform(items, lambda x: self._with_local(s, then, **{name: x}))
        self._need("]")
        return items

    def _list_function(self, f: str, s: Scope) -> Column:
        """any, all, none, single (x IN list WHERE condition) and reduce(a = start, x IN list | value)."""
        if f == "reduce":
            acc = self._name()
            self._need("=")
            first = self._expr(s)
            self._need(",")
        name = self._name()
        if not self._word("IN"):
            raise Refused("expected IN")
        items = self._expr(s)
        if f == "reduce":
            self._need("|")
            at = self.k
            out = F.aggregate(items, first, lambda a, x: self._with_local(s, at, **{acc: self._mark(a, _text(first)), name: x}))
        else:
            if not self._word("WHERE"):
                raise Refused("expected WHERE")
            at = self.k
            holds = lambda x: self._with_local(s, at, **{name: x})
            out = F.exists(items, holds) if f == "any" else F.forall(items, holds) if f == "all" else ~F.exists(items, holds) if f == "none" else F.size(F.filter(items, holds)) == 1
        self._need(")")
        return out

    def _after(self, c: Column, s: Scope) -> Column:
        while self._peek().text in ("[", "."):
            if self._sign("."):
                c = c.getField(self._name())
                continue
            self.k += 1
            lo = self._expr(s) if self._peek().text != ".." else F.lit(0)
            if self._sign(".."):
                hi = self._expr(s) if self._peek().text != "]" else F.size(c)
                c = F.slice(c, (lo + 1).cast("int"), F.greatest(F.lit(0), hi - lo).cast("int"))
            else:
                c = F.get(c, lo)
            self._need("]")
        return c

    def _call(self, f: str, s: Scope) -> Column:
        if f in _AGGREGATES:
            self._used_aggregate = True
            distinct = self._word("DISTINCT")
            if f == "count" and self._sign("*"):
                self._need(")")
                return F.count("*")
            v = self._peek().text.strip("`") if self._peek(1).text == ")" else None
            if v in s.nodes:
                self.k += 1
                cols = s.nodes[v]
                x = F.col(cols["id"]) if "id" in cols else F.struct(F.col(cols["src"]), F.col(cols["dst"])) if f == "count" and distinct else F.col(cols["src"])
            else:
                x = self._expr(s)
            self._need(")")
            if f == "count":
                return F.countDistinct(x) if distinct else F.count(x)
            if f == "collect":
                return F.sort_array(F.collect_set(x) if distinct else F.collect_list(x))
            return {"sum": F.coalesce(F.sum(x), F.lit(0)), "max": F.max(x), "min": F.min(x), "avg": F.avg(x)}[f]
        if f in ("any", "all", "none", "single", "reduce") and self._peek().kind == "name" and (self._peek(1).word == "IN" or f == "reduce"):
            return self._list_function(f, s)
        if f in ("type", "labels", "id", "elementid", "startnode", "endnode", "properties", "keys") and self._peek().text.strip("`") in s.nodes:
            cols = s.nodes[self._name()]
            self._need(")")
            if f in ("properties", "keys"):
                own = {p: x for p, x in cols.items() if p not in ("id", "labels", "src", "dst", "type", "src_label")}
                return F.struct(*[F.col(x).alias(p) for p, x in own.items()]) if f == "properties" else F.array_compact(F.array(*[F.when(F.col(x).isNotNull(), p) for p, x in own.items()]))
            if f in ("startnode", "endnode") and self._sign("."):
                if self._name() != "id":
                    raise Refused("only the id of an end is known")
            return self._mark(F.col({"type": cols.get("type"), "labels": cols.get("labels"), "id": cols.get("id"), "elementid": cols.get("id"), "startnode": cols.get("src"), "endnode": cols.get("dst")}[f]), f not in ("labels",))
        args = []
        while not self._sign(")"):
            args.append(self._expr(s))
            self._sign(",")
        make = {
            "tolower": lambda a: self._mark(F.lower(a), True), "toupper": lambda a: self._mark(F.upper(a), True), "tostring": lambda a: self._mark(a.cast("string"), True), "tointeger": lambda a: a.try_cast("bigint"), "trim": lambda a: self._mark(F.trim(a), True), "size": lambda a: F.char_length(a) if _text(a) else F.size(a),
            "coalesce": lambda *a: F.coalesce(*a), "head": lambda a: F.get(a, F.lit(0)), "last": lambda a: F.element_at(a, -1), "abs": F.abs, "date": lambda a=None: a.cast("date") if a is not None else F.current_date(), "datetime": lambda a=None: a.cast("timestamp") if a is not None else F.current_timestamp(), "localdatetime": lambda a=None: a.cast("timestamp_ntz") if a is not None else F.localtimestamp(), "date.truncate": lambda unit, a: F.call_function("date_trunc", unit, a).cast("date"), "duration.indays": lambda a, b: F.date_diff(b, a), "range": lambda a, b: F.sequence(a, b), "tofloat": lambda a: a.try_cast("double"), "toboolean": lambda a: a.try_cast("boolean"), "left": lambda a, n: self._mark(F.left(a, n), True), "right": lambda a, n: self._mark(F.right(a, n), True), "reverse": F.reverse, "round": F.round, "nullif": F.nullif, "replace": lambda a, b, c: self._mark(F.replace(a, b, c), True), "split": lambda a, b: F.split(a, b), "substring": lambda a, b, n=None: self._mark(F.substr(a, (b + 1).cast("int"), n.cast("int") if n is not None else F.lit(2**31 - 1)), True),
        }
        if f not in make:
            raise Refused(f"function {f} is not supported")
        return make[f](*args)


def compile_query(graph: Graph, query: str, params: dict | None = None) -> DataFrame:
    """The DataFrame of a query over the graph; a refusal raises ``Refused`` before anything is read."""
    out = Compiler(graph, params).run(query)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        raise Refused("patterns must be connected by a relationship or an equality")
    return out


def _rows(spark: SparkSession, df: DataFrame, limit: int | None, seconds: float) -> list[dict]:
    """At most ``limit`` rows (200 unless given, never over 500), within a time limit."""
    n = min(MAX_LIMIT, max(1, limit or DEFAULT_LIMIT))
    sc, group, late = spark.sparkContext, f"read-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    sc.setJobGroup(group, "guarded read", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in df.limit(n).collect()]
    except Exception:
        if late.is_set():
            raise TimeoutError(f"the query took more than {seconds:g} seconds") from None
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def read(graph: Graph, query: str, params: dict | None = None, limit: int | None = None, seconds: float = TIMEOUT_SECONDS) -> list[dict]:
    """Rows of a guarded query."""
    df = compile_query(graph, query, params)
    return _rows(df.sparkSession, df, limit, seconds)


def read_sql(spark: SparkSession, graph: Graph, query: str, limit: int | None = None) -> DataFrame:
    """Guarded SQL over the graph as views (``File``, ``IMPORTS``, ...): one query that names nothing else.

    The query is parsed and checked before anything is registered; the views live while it is analysed, and views
    of the session that have their names come back after it.
    """
    views = {**graph.nodes, **graph.rels}
    reason = sql_denial(spark, query, set(views))
    if reason:
        raise Refused(reason)
    before = {name: spark.table(name) for name in views if spark.catalog.tableExists(name)}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(query).limit(min(MAX_LIMIT, max(1, limit or DEFAULT_LIMIT)))
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)
