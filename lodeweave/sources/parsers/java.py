"""Java: package, imports, types with what they extend, methods, annotations."""

from __future__ import annotations

import re

from lodeweave.sources.parsers.common import bare, blanked, declared, split_top

# Annotations by the label they give a class.
STEREOTYPES = {"Entity": "Entity", "ManagedBean": "ManagedBean", "Named": "ManagedBean", "Stateless": "EJBBean", "Stateful": "EJBBean", "Singleton": "EJBBean", "MessageDriven": "EJBBean"}
_TYPE = re.compile(r"^(?P<mods>(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*)(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>\w+)(?P<rest>.*)$")
_METHOD = re.compile(r"^(?P<mods>(?:(?:public|protected|private|abstract|final|static|synchronized|native|default|strictfp)\s+)*)(?:<[^>]+>\s+)?(?P<type>[\w.$]+(?:<[^()]*>)?(?:\[\])*)\s+(?P<name>\w+)\s*\((?P<args>[^;{]*)(?:\)|$)")
_ANNOTATION = re.compile(r"^@(\w+(?:\.\w+)*)(?:\s*\(((?:[^()\"]|\"[^\"]*\"|\([^()]*\))*)\))?\s*")
_NOT_TYPES = {"return", "new", "throw", "else", "case", "assert", "yield", "package", "import"}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "synchronized", "return", "new", "super", "this", "try", "do"}


def _visibility(mods: str) -> str:
    return next((v for v in ("public", "protected", "private") if v in mods.split()), "package")


def extract(lines: list[str]) -> dict:
    out = {"package": "", "imports": [], "types": [], "methods": []}
    waiting: list[tuple[str, str]] = []
    for no, line in enumerate(blanked(lines, "//", ("/*", "*/"), '"\'', keep_strings=True), 1):
        s = line.strip()
        while m := _ANNOTATION.match(s):
            if m.group(1) == "interface":
                break
            waiting.append((m.group(1).rsplit(".", 1)[-1], m.group(2) or ""))
            s = s[m.end() :]
        if not s:
            continue
        if m := re.match(r"package\s+([\w.]+)\s*;", s):
            out["package"] = m.group(1)
        elif m := re.match(r"import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", s):
            if not s.rstrip("; ").endswith("*") and not s.startswith("import static"):
                out["imports"].append({"fqn": m.group(1), "line": no})
        elif m := _TYPE.match(s):
            rest = m.group("rest").split("{")[0]
            ext = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|\bpermits\b|$)", rest)
            imp = re.search(r"\bimplements\s+(.*?)(?=\bpermits\b|$)", rest)
            parents = [bare(x) for x in split_top(ext.group(1))] if ext else []
            kind = {"@interface": "annotation"}.get(m.group("kind"), m.group("kind"))
            names = [a for a, _ in waiting]
            table = next((t.group(1) for a, args in waiting if a == "Table" and (t := re.search(r"\bname\s*=\s*\"([^\"]+)\"", args))), m.group("name") if "Entity" in names else "")
            faces = [bare(x) for x in split_top(imp.group(1))] if imp else []
            out["types"].append(declared(
                m.group("name"), kind, no, visibility=_visibility(m.group("mods")), is_abstract="abstract" in m.group("mods"), is_final="final" in m.group("mods"), extends=parents[0] if parents and kind != "interface" else "",
                implements=faces + (parents if kind == "interface" else []), stereotype=next((STEREOTYPES[a] for a in names if a in STEREOTYPES), ""), mapped_table=table,
            ))
            waiting = []
        elif (m := _METHOD.match(s)) and m.group("type") not in _NOT_TYPES and m.group("name") not in _NOT_NAMES and "=" not in s[: m.start("args")]:
            # every method belongs to the first type of its file
            out["methods"].append({"name": m.group("name"), "owner": out["types"][0]["name"] if out["types"] else "", "line": no, "return_type": m.group("type"), "visibility": _visibility(m.group("mods"))})
            waiting = []
        else:
            waiting = []
    return out
