"""Python: imports, classes and functions by indentation, decorators, tables of object mappers."""

from __future__ import annotations

import re

from lodeweave.sources.parsers.common import declared, split_top

_ENUM, _FACE = {"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"}, {"Protocol", "ABC", "ABCMeta"}
_DATA = {"dataclass", "dataclasses.dataclass", "attr.s", "attrs.define", "define"}


def logical(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line, indent, text) of logical lines: brackets and backslashes join, comments and triple-quoted texts go."""
    out, depth, now, start, quote, indent = [], 0, "", 1, "", 0
    for no, line in enumerate(lines, 1):
        fresh = not now
        if fresh and not quote:
            start, indent = no, len(line) - len(line.lstrip())
        i = 0
        while i < len(line):
            if quote:
                end = line.find(quote, i)
                i = len(line) if end < 0 else end + 3
                quote = quote if end < 0 else ""
                continue
            c = line[i]
            if line.startswith(('"""', "'''"), i):
                quote, i = line[i : i + 3], i + 3
                now += '""'
                continue
            if c == "#":
                break
            if c in "\"'":
                j = i + 1
                while j < len(line) and line[j] != c:
                    j += 2 if line[j] == "\\" else 1
                now, i = now + line[i : j + 1], j + 1
                continue
            depth = max(0, depth + (c in "([{") - (c in ")]}"))
            now, i = now + c, i + 1
        if quote or depth or now.endswith("\\"):
            now = now.removesuffix("\\") + " "
            continue
        if now.strip():
            out.append((start, indent, now.strip()))
        now = ""
    if now.strip():
        out.append((start, indent, now.strip()))
    return out


def visibility(name: str) -> str:
    if name.startswith("__") and name.endswith("__"):
        return "public"
    return "private" if name.startswith("__") else "protected" if name.startswith("_") else "public"


def _imports(text: str) -> list[str]:
    if m := re.match(r"import\s+(.+)", text):
        return [re.split(r"\s+as\s+", x)[0].strip() for x in m.group(1).split(",")]
    if m := re.match(r"from\s+([.\w]+)\s+import\s+\(?(.*?)\)?$", text):
        base, names = m.group(1), [re.split(r"\s+as\s+", x)[0].strip() for x in m.group(2).split(",")]
        return [base if n == "*" else f"{base}{'' if base.endswith('.') else '.'}{n}" for n in names if n]
    return []


def extract(lines: list[str]) -> dict:
    out = {"package": "", "imports": [], "types": [], "methods": []}
    scopes: list[tuple[int, str, dict | None]] = []  # indent, kind, type
    decorators: list[str] = []
    for no, indent, text in logical(lines):
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        if text.startswith("@"):
            decorators.append(text[1:].split("(")[0].strip())
            continue
        owner = next((t for _, k, t in reversed(scopes) if k == "class"), None)
        if m := re.match(r"class\s+(\w+)\s*(?:\[[^\]]*\])?\s*(?:\((.*)\))?\s*:", text):
            bases = [b for b in split_top(m.group(2) or "") if "=" not in b]
            last = [re.sub(r"\[.*", "", b).rsplit(".", 1)[-1] for b in bases]
            kind = "enum" if _ENUM & set(last) else "interface" if _FACE & set(last) or "metaclass=ABCMeta" in (m.group(2) or "").replace(" ", "") else "class"
            plain = [re.sub(r"\[.*", "", b) for b in bases]
            t = declared(m.group(1), kind, no, visibility=visibility(m.group(1)), is_abstract=kind == "interface", extends=plain[0] if plain else "", implements=plain[1:], stereotype="DataClass" if _DATA & set(decorators) else "")
            if not (owner and m.group(1) == "Meta"):
                out["types"].append(t)
                scopes.append((indent, "class", t))
            else:
                scopes.append((indent, "class", owner))
        elif m := re.match(r"(?:async\s+)?def\s+(\w+)\s*(?:\[[^\]]*\])?\s*\(.*\)\s*(?:->\s*(.+?))?\s*:", text):
            if not any(k == "def" for _, k, _ in scopes):
                out["methods"].append({"name": m.group(1), "owner": owner["name"] if owner else "", "line": no, "return_type": m.group(2) or "", "visibility": visibility(m.group(1))})
            scopes.append((indent, "def", None))
        elif text.startswith(("import ", "from ")):
            out["imports"] += [{"fqn": f, "line": no} for f in _imports(text)]
        elif owner and not any(k == "def" for _, k, _ in scopes) and (m := re.match(r"(?:__tablename__|db_table)\s*(?::\s*\w+\s*)?=\s*[\"']([^\"']+)[\"']", text)):
            owner["mapped_table"], owner["stereotype"] = m.group(1), owner["stereotype"] or "Entity"
        decorators = []
    return out
