"""Helpers of the parsers."""

from __future__ import annotations

import re


def blanked(lines: list[str], line_comment: str, block: tuple[str, str] | None, quotes: str, keep_strings: bool = False) -> list[str]:
    """Lines without comments; strings are blanked too (their quotes stay) unless ``keep_strings``."""
    out, inside = [], False
    for line in lines:
        now, i = "", 0
        while i < len(line):
            if inside:
                end = line.find(block[1], i)
                if end < 0:
                    i = len(line)
                else:
                    inside, i = False, end + len(block[1])
                continue
            if line_comment and line.startswith(line_comment, i):
                break
            if block and line.startswith(block[0], i):
                inside, i = True, i + len(block[0])
                continue
            c = line[i]
            if c in quotes:
                j = i + 1
                while j < len(line) and line[j] != c:
                    j += 2 if line[j] == "\\" else 1
                body = line[i + 1 : min(j, len(line))]
                now += c + (body if keep_strings else " " * len(body)) + c
                i = j + 1
                continue
            now, i = now + c, i + 1
        out.append(now)
    return out


def split_top(text: str) -> list[str]:
    """Parts between commas that no bracket encloses."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [x for x in [*out, now.strip()] if x]


def bare(name: str) -> str:
    return re.sub(r"<.*", "", name).strip()


def declared(name: str, kind: str, line: int, **more) -> dict:
    return {"name": name, "kind": kind, "line": line, "visibility": "public", "is_abstract": False, "is_final": False, "extends": "", "implements": [], "stereotype": "", "mapped_table": ""} | more
