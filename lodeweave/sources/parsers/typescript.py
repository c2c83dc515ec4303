"""TypeScript and JavaScript: imports, classes, interfaces, aliases, enums, functions, methods at member depth."""

from __future__ import annotations

import re

from lodeweave.sources.parsers.common import bare, blanked, declared, split_top

# Decorators by the label they give a class.
STEREOTYPES = {"Entity": "Entity", "Component": "Component", "Injectable": "Service", "NgModule": "NgModule", "Module": "NgModule", "Controller": "Controller"}
_TYPE = re.compile(r"^(?P<head>(?:(?:export|default|declare|abstract|const)\s+)*)(?P<kind>class|interface|enum|type|namespace)\s+(?P<name>[\w$]+)(?P<rest>.*)$")
_FUNCTION = re.compile(r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(?:<[^(]*>)?\s*\(.*?\)?\s*(?::\s*([^{]+?))?\s*[{;]?\s*$")
_ARROW = re.compile(r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::\s*([^=]+?))?\s*=>")
_METHOD = re.compile(r"^(?P<mods>(?:(?:public|private|protected|static|readonly|async|override|abstract|get|set)\s+)*)\*?\s*(?P<name>#?[\w$]+)\s*\??\s*(?:<[^(]*>)?\s*\((?P<args>.*)$")
_NOT = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "super", "new", "throw", "await", "typeof", "do", "else"}


def _imports(text: str) -> list[str]:
    if m := re.match(r"(?:import|export)\s+(?:type\s+)?(.+?)\s+from\s+['\"]([^'\"]+)['\"]", text):
        what, source = m.groups()
        names = [re.split(r"\s+as\s+", re.sub(r"^type\s+", "", x.strip()))[0] for g in re.findall(r"\{([^}]*)\}", what) for x in g.split(",") if x.strip()]
        first = re.sub(r"\{[^}]*\}", "", what).strip(" ,")
        names += [x.strip() for x in first.split(",") if x.strip() and not x.strip().startswith("*")]
        return [f"{source}/{n}" for n in names] or [source]
    if m := re.match(r"import\s+['\"]([^'\"]+)['\"]", text):
        return [m.group(1)]
    return re.findall(r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", text)


def extract(lines: list[str]) -> dict:
    out = {"package": "", "imports": [], "types": [], "methods": []}
    code = blanked(lines, "//", ("/*", "*/"), "\"'`", keep_strings=True)
    shape = blanked(lines, "//", ("/*", "*/"), "\"'`")
    depth, owner, at_depth, decorators, open_call = 0, None, 0, [], 0
    joined, joined_at = "", 0
    for no, (line, plain) in enumerate(zip(code, shape), 1):
        s = line.strip()
        if open_call:
            open_call = max(0, open_call + plain.count("(") - plain.count(")"))
            continue
        while m := re.match(r"@(\w+)(?:\.\w+)*\s*", s):
            rest = s[m.end() :]
            args = ""
            if rest.startswith("("):
                level, k = 0, 0
                for k, c in enumerate(rest):
                    level += (c == "(") - (c == ")")
                    if level == 0:
                        break
                if level:
                    open_call, args, rest = level, rest, ""
                else:
                    args, rest = rest[1:k], rest[k + 1 :]
            decorators.append((m.group(1), args))
            s = rest.strip()
        if re.match(r"(?:import|export)\b[^;'\"]*\{[^}]*$", s) and " class " not in s and depth == 0 and not _TYPE.match(s) and not _FUNCTION.match(s):
            joined, joined_at = s, no
            continue
        if joined:
            joined += " " + s
            if "}" in s:
                out["imports"] += [{"fqn": f, "line": joined_at} for f in _imports(joined)]
                joined = ""
            continue
        if owner and depth < at_depth:
            owner = None
        if not s:
            pass
        elif (found := _imports(s)) and depth == 0:
            out["imports"] += [{"fqn": f, "line": no} for f in found]
        elif (m := _TYPE.match(s)) and (m.group("kind") != "type" or "=" in m.group("rest")):
            rest = m.group("rest").split("{")[0]
            ext = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|$)", rest) if m.group("kind") in ("class", "interface") else None
            imp = re.search(r"\bimplements\s+(.*)$", rest)
            parents = [bare(x) for x in split_top(ext.group(1))] if ext else []
            label = next(((STEREOTYPES[d], a) for d, a in decorators if d in STEREOTYPES), ("", ""))
            table = ""
            if label[0] == "Entity":
                t = re.search(r"['\"]([^'\"]+)['\"]", label[1])
                table = t.group(1) if t else m.group("name")
            kind = m.group("kind")
            faces = [bare(x) for x in split_top(imp.group(1))] if imp else []
            t = declared(m.group("name"), kind, no, visibility="public" if "export" in m.group("head") else "package", is_abstract="abstract" in m.group("head"), extends=parents[0] if parents and kind == "class" else "", implements=faces + (parents if kind == "interface" else []), stereotype=label[0], mapped_table=table)
            out["types"].append(t)
            if kind in ("class", "interface"):
                owner, at_depth = t["name"], depth + 1
            decorators = []
        elif depth == 0 and (m := _FUNCTION.match(s) or _ARROW.match(s)):
            out["methods"].append({"name": m.group(1), "owner": "", "line": no, "return_type": (m.group(2) or "").strip(), "visibility": "public" if s.startswith("export") else "package"})
        elif owner and depth == at_depth and (m := _METHOD.match(s)) and m.group("name") not in _NOT and "=" not in s[: m.start("args")]:
            ret = re.search(r"\)\s*:\s*([^{;]+?)\s*[{;]?\s*$", s)
            vis = next((v for v in ("private", "protected") if v in m.group("mods")), "private" if m.group("name").startswith("#") else "public")
            out["methods"].append({"name": m.group("name"), "owner": owner, "line": no, "return_type": ret.group(1) if ret else "", "visibility": vis})
            decorators = []
        depth = max(0, depth + plain.count("{") - plain.count("}"))
    return out
