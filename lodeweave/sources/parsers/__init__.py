"""Tolerant structure parsers: lines in, declarations out. They never raise and never judge validity.

Each language module has ``extract(lines)`` that returns package, imports (fqn, line), types and methods;
``PARSERS`` is where a language is added.
"""

from __future__ import annotations

from lodeweave.sources.parsers import golang, java, python, typescript

PARSERS = {"java": java.extract, "python": python.extract, "typescript": typescript.extract, "javascript": typescript.extract, "go": golang.extract}
EMPTY = {"package": "", "imports": [], "types": [], "methods": []}


def extract(file_type: str | None, lines: list[str]) -> dict | None:
    """Structure of a file, None for types without a parser; a parser that stumbles gives an empty structure."""
    parser = PARSERS.get(file_type or "")
    if parser is None:
        return None
    try:
        return parser(lines)
    except Exception:  # noqa: BLE001 - any input is allowed
        return dict(EMPTY)
