"""Packrat parsing of parsing-expression grammars over tokens.

A grammar is a text of rules ``Name = alternatives ;`` with ordered choice ``/``, ``* + ?``, predicates
``! &``, literals in quotes, token kinds in capitals (``WORD``: a name or any reserved word; ``EOS``: here a
line or block ends; ``ADJ``: no blank before) and ``~``, which forgets the memo where no choice before it can
be taken back in another way (memory only; results never change). It is compiled once into Python
functions: every rule remembers its result by position, alternatives are skipped by their first tokens,
and the furthest position at which a token did not fit is kept.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

END = "$"


@dataclass
class Tokens:
    """keys: reserved word, sign or kind; texts; line: 1-based line; fresh: begins a line; tight: no blank before."""

    keys: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    line: list[int] = field(default_factory=list)
    fresh: list[bool] = field(default_factory=list)
    tight: list[bool] = field(default_factory=list)

    def add(self, key: str, text: str, line: int, fresh: bool = False, tight: bool = False) -> None:
        self.keys.append(key)
        self.texts.append(text)
        self.line.append(line)
        self.fresh.append(fresh)
        self.tight.append(tight)


_META = re.compile(r"\s+|#[^\n]*|'([^']+)'|([A-Z][a-z]\w*)|([A-Z][A-Z_]*)|([=;/*+?!&()~])")


def _read(text: str) -> dict[str, tuple]:
    toks, at = [], 0
    while at < len(text):
        m = _META.match(text, at)
        if not m:
            raise ValueError(f"bad grammar at {text[at : at + 30]!r}")
        at = m.end()
        if m.lastindex:
            toks.append((m.lastindex, m.group(m.lastindex)))
    pos = 0

    def peek():
        return toks[pos] if pos < len(toks) else (0, "")

    def choice():
        nonlocal pos
        alts = [seq()]
        while peek() == (4, "/"):
            pos += 1
            alts.append(seq())
        return alts[0] if len(alts) == 1 else ("choice", alts)

    def seq():
        items = []
        while peek()[0] in (1, 2, 3) or peek() in ((4, "("), (4, "!"), (4, "&"), (4, "~")):
            items.append(prefix())
        return items[0] if len(items) == 1 else ("seq", items)

    def prefix():
        nonlocal pos
        if peek() in ((4, "!"), (4, "&")):
            kind = peek()[1]
            pos += 1
            return ("not" if kind == "!" else "and", suffix())
        return suffix()

    def suffix():
        nonlocal pos
        x = atom()
        while peek() in ((4, "*"), (4, "+"), (4, "?")):
            x = ({"*": "star", "+": "plus", "?": "opt"}[peek()[1]], x)
            pos += 1
        return x

    def atom():
        nonlocal pos
        kind, value = peek()
        pos += 1
        if kind == 1:
            return ("lit", value)
        if kind == 2:
            return ("rule", value)
        if kind == 3:
            return ("kind", value)
        if value == "~":
            return ("forget",)
        x = choice()
        pos += 1  # )
        return x

    rules = {}
    while pos < len(toks):
        name = toks[pos][1]
        pos += 2
        rules[name] = choice()
        if peek() != (4, ";"):
            raise ValueError(f"bad rule {name} before {toks[pos : pos + 3]}")
        pos += 1
    return rules


class Grammar:
    """A compiled grammar; ``parse`` returns -1 if all tokens were consumed, else the furthest failing token."""

    def __init__(self, text: str, reserved: set[str], start: str):
        self.rules, self.reserved, self.start = _read(text), reserved, start
        used = {n[1] for r in self.rules.values() for n in self._walk(r) if n[0] == "rule"}
        if used - set(self.rules):
            raise ValueError(f"no such rules: {used - set(self.rules)}")
        self._analyse()
        self._make = self._compile()

    def _walk(self, n):
        yield n
        for x in n[1:]:
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, tuple):
                    yield from self._walk(y)

    def _is_name(self, lit: str) -> bool:
        return bool(re.fullmatch(r"[^\W\d]\w*", lit)) and lit not in self.reserved

    def _first(self, n) -> tuple[frozenset, bool]:
        """(keys it can begin with, may consume nothing)"""
        kind = n[0]
        if kind == "lit":
            return (frozenset(["NAME"]) if self._is_name(n[1]) else frozenset([n[1]])), False
        if kind == "kind":
            if n[1] == "WORD":
                return frozenset(self.reserved | {"NAME"}), False
            if n[1] in ("EOS", "ADJ"):
                return frozenset(), True
            return frozenset([END if n[1] == "EOF" else n[1]]), False
        if kind == "rule":
            return self.first[n[1]]
        if kind == "choice":
            got = [self._first(x) for x in n[1]]
            return frozenset().union(*(g[0] for g in got)), any(g[1] for g in got)
        if kind == "seq":
            keys = frozenset()
            for x in n[1]:
                f, empty = self._first(x)
                keys |= f
                if not empty:
                    return keys, False
            return keys, True
        if kind in ("star", "opt"):
            return self._first(n[1])[0], True
        if kind == "plus":
            return self._first(n[1])
        return frozenset(), True  # predicates, forget

    def _analyse(self):
        self.first = {r: (frozenset(), False) for r in self.rules}
        while True:
            new = {r: self._first(x) for r, x in self.rules.items()}
            if new == self.first:
                return
            self.first = new

    def _compile(self):
        sets: list[frozenset] = []
        lines: list[str] = []
        count = iter(range(10**9))

        def put(depth, s):
            lines.append("    " * depth + s)

        def in_set(keys):
            if len(keys) == 1:
                return f"== {next(iter(keys))!r}"
            if keys not in sets:
                sets.append(keys)
            return f"in S{sets.index(keys)}"

        def miss(d, i):
            put(d, f"if {i} > far: far = {i}")

        def gen(n, i, o, d):
            kind = n[0]
            if kind == "lit":
                put(d, f"if T[{i}] == {n[1]!r} and K[{i}] == 'NAME':" if self._is_name(n[1]) else f"if K[{i}] == {n[1]!r}:")
                put(d + 1, f"{o} = {i} + 1")
                put(d, "else:")
                put(d + 1, f"{o} = -1")
                miss(d + 1, i)
            elif kind == "kind":
                test = {"WORD": f"K[{i}] {in_set(frozenset(self.reserved | {'NAME'}))}", "EOS": f"N[{i}] or K[{i}] == '}}' or K[{i}] == '$'", "ADJ": f"A[{i}]", "EOF": f"K[{i}] == '$'"}.get(n[1], f"K[{i}] == {n[1]!r}")
                put(d, f"if {test}:")
                put(d + 1, f"{o} = {i}" + (" + 1" if n[1] not in ("EOS", "ADJ", "EOF") else ""))
                put(d, "else:")
                put(d + 1, f"{o} = -1")
                miss(d + 1, i)
            elif kind == "rule":
                put(d, f"{o} = p_{n[1]}({i})")
            elif kind == "seq":
                t = f"v{next(count)}"
                put(d, f"{t} = {i}")
                for k, x in enumerate(n[1]):
                    if k:
                        put(d, f"if {t} >= 0:")
                    u = f"v{next(count)}"
                    gen(x, t, u, d + bool(k))
                    put(d + bool(k), f"{t} = {u}")
                put(d, f"{o} = {t}")
            elif kind == "choice":
                t, r = f"v{next(count)}", f"v{next(count)}"
                put(d, f"{t} = {i}")
                put(d, f"{r} = -1")
                for x in n[1]:
                    keys, empty = self._first(x)
                    put(d, f"if {r} < 0" + ("" if empty else f" and K[{t}] {in_set(keys)}") + ":")
                    gen(x, t, r, d + 1)
                put(d, f"if {r} < 0 and {t} > far: far = {t}")
                put(d, f"{o} = {r}")
            elif kind in ("star", "plus"):
                t, u = f"v{next(count)}", f"v{next(count)}"
                keys, empty = self._first(n[1])
                put(d, f"{t} = {i}")
                begin = f"v{next(count)}"
                if kind == "plus":
                    put(d, f"{begin} = False")
                put(d, "while True:" if empty else f"while K[{t}] {in_set(keys)}:")
                gen(n[1], t, u, d + 1)
                put(d + 1, f"if {u} < 0 or {u} == {t}: break")
                if kind == "plus":
                    put(d + 1, f"{begin} = True")
                put(d + 1, f"{t} = {u}")
                if not empty:
                    put(d, f"if {t} > far: far = {t}")
                put(d, f"{o} = {t}" + (f" if {begin} else -1" if kind == "plus" else ""))
            elif kind == "opt":
                t, u = f"v{next(count)}", f"v{next(count)}"
                keys, empty = self._first(n[1])
                put(d, f"{t} = {u} = {i}")
                if not empty:
                    put(d, f"if K[{t}] {in_set(keys)}:")
                gen(n[1], t, u, d + (not empty))
                put(d, f"{o} = {t} if {u} < 0 else {u}")
            elif kind in ("not", "and"):
                t, u, kept = f"v{next(count)}", f"v{next(count)}", f"v{next(count)}"
                put(d, f"{t} = {i}")
                put(d, f"{kept} = far")
                gen(n[1], t, u, d)
                put(d, f"far = {kept}")
                put(d, f"{o} = {t} if {u} {'<' if kind == 'not' else '>='} 0 else -1")
            elif kind == "forget":
                put(d, "for m in MEMOS: m.clear()")
                put(d, f"{o} = {i}")

        put(0, "def make(K, T, N, A):")
        put(1, "far = 0")
        for r in self.rules:
            put(1, f"m_{r} = {{}}")
        put(1, f"MEMOS = [{', '.join('m_' + r for r in self.rules)}]")
        for r, x in self.rules.items():
            put(1, f"def p_{r}(i):")
            put(2, "nonlocal far")
            put(2, f"r = m_{r}.get(i)")
            put(2, "if r is not None: return r")
            gen(x, "i", "r", 2)
            put(2, f"m_{r}[i] = r")
            put(2, "return r")
        put(1, "def run():")
        put(2, f"return p_{self.start}(0), far")
        put(1, "return run")
        space = {f"S{k}": s for k, s in enumerate(sets)}
        exec(compile("\n".join(lines), f"<grammar {self.start}>", "exec"), space)  # noqa: S102 - our own text
        return space["make"]

    def parse(self, t: Tokens) -> int:
        if sys.getrecursionlimit() < 200_000:
            sys.setrecursionlimit(200_000)
        n = len(t.keys)
        end = t.line[-1] if n else 1
        # a few end marks, so that predicates may look ahead
        keys, texts = t.keys + [END] * 3, t.texts + [""] * 3
        done, far = self._make(keys, texts, t.fresh + [True] * 3, t.tight + [False] * 3)()
        del end
        return -1 if done == n else min(max(far, done), n)
