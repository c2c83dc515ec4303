"""Go: package, imports, structs, interfaces, aliases, enumerations by iota, functions and methods."""

from __future__ import annotations

import re

from lodeweave.sources.parsers.common import blanked, declared

_FUNC = re.compile(r"^func\s*(?:\(\s*(?:\w+\s+)?\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*\((.*)$")
_TYPE = re.compile(r"^(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+(=\s*)?(struct|interface|[\w.*\[\]]+)\s*(\{)?")


def visibility(name: str) -> str:
    return "public" if name[:1].isupper() else "package"


def extract(lines: list[str]) -> dict:
    out = {"package": "", "imports": [], "types": [], "methods": []}
    group, current, depth = "", None, 0
    for no, line in enumerate(blanked(lines, "//", ("/*", "*/"), '"', keep_strings=True), 1):
        s = line.strip()
        if not s:
            continue
        if line.startswith(("func ", "type ")):  # a declaration at the margin: what came before is over, whatever its braces say
            current, depth, group = None, 0, ""
        if current is not None:
            if depth == 1 and (m := re.match(r"^\*?([\w.]+)\s*(?:`.*)?$", s)) and s != "}":
                if current["kind"] == "struct" and not current["extends"]:
                    current["extends"] = m.group(1)
                else:
                    current["implements"].append(m.group(1))
            elif depth == 1 and current["kind"] == "interface" and (m := re.match(r"^(\w+)\s*\(", s)):
                out["methods"].append({"name": m.group(1), "owner": current["name"], "line": no, "return_type": "", "visibility": visibility(m.group(1))})
            depth += s.count("{") - s.count("}")
            if depth <= 0:
                current, depth = None, 0
            continue
        if group:
            if s.startswith(")"):
                group = ""
            elif group == "import" and (m := re.search(r"\"([^\"]+)\"", s)):
                out["imports"].append({"fqn": m.group(1), "line": no})
            elif group == "type" and (m := _TYPE.match(s)):
                current, depth = _typed(out, m, no, s)
            elif group == "const" and "iota" in s and (m := re.match(r"\w+\s+(\w+)\s*=", s)):
                for t in out["types"]:
                    if t["name"] == m.group(1):
                        t["kind"] = "enum"
            continue
        if depth:
            depth = max(0, depth + s.count("{") - s.count("}"))
            continue
        if m := re.match(r"package\s+(\w+)", s):
            out["package"] = m.group(1)
        elif m := re.match(r"(import|type|const|var)\s*\($", s):
            group = m.group(1)
        elif m := re.match(r"import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", s):
            out["imports"].append({"fqn": m.group(1), "line": no})
        elif m := _FUNC.match(s):
            ret = re.search(r"\)\s*([^({]+|\([^)]*\))?\s*\{?\s*$", m.group(3))
            out["methods"].append({"name": m.group(2), "owner": m.group(1) or "", "line": no, "return_type": (ret.group(1) or "").strip() if ret else "", "visibility": visibility(m.group(2))})
            depth = max(0, s.count("{") - s.count("}"))
        elif s.startswith("type ") and (m := _TYPE.match(s)):
            current, depth = _typed(out, m, no, s)
    return out


def _typed(out: dict, m: re.Match, no: int, s: str) -> tuple[dict | None, int]:
    kind = m.group(3) if m.group(3) in ("struct", "interface") else "alias"
    t = declared(m.group(1), kind, no, visibility=visibility(m.group(1)), extends="" if kind != "alias" else m.group(3))
    out["types"].append(t)
    depth = s.count("{") - s.count("}")
    return (t, depth) if depth > 0 and kind != "alias" else (None, 0)
