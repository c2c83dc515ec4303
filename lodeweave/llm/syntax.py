"""Source files that do not parse: packrat grammars, furthest failure, cause and rates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.grammars import LEXERS, failure
from lodeweave.runtime import ship

LANGUAGES = tuple(LEXERS)
_CONFLICT = re.compile(r"^(<{7} ?\S|={7}\s*$|>{7} ?\S|\|{7} ?\S)", re.M)


def file_text(lines: str | Column = "code_lines") -> Column:
    """The lines of a file in line order, joined by newlines; null lines are empty, null stays null."""
    c = F.col(lines) if isinstance(lines, str) else lines
    ordered = F.array_sort(F.transform(c, lambda x: F.struct(F.coalesce(x["line_no"], F.lit(0)).alias("n"), F.coalesce(x["line_text"], F.lit("")).alias("t"))))
    return F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")


def verdict(language: str, text: str) -> tuple[bool, int | None, str | None]:
    """(valid, line of the furthest failure, cause): cause is 'conflict', 'truncated', 'other language' or 'syntax'."""
    try:
        line = failure(language, text)
    except RecursionError:
        return False, None, "nesting"
    if not line:
        return True, None, None
    lines = text.split("\n")
    near = "\n".join(lines[max(0, line - 2) : line + 1])
    if _CONFLICT.search(near):
        return False, line, "conflict"
    for other in LANGUAGES:
        if other not in (language, "sql") and text.strip() and not failure(other, text):
            return False, line, "other language"
    return False, line, "truncated" if line >= len("\n".join(lines).rstrip().split("\n")) else "syntax"


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: dict[tuple[str, str], tuple] = {}  # copies within a batch are parsed once
        out = []
        for language, text in zip(b["language"], b["text"]):
            if (language, text) not in seen:
                seen[language, text] = verdict(language, text)
            out.append(seen[language, text])
        got = pd.DataFrame(out, columns=["is_valid", "failed_at_line", "cause"])
        got["failed_at_line"] = got["failed_at_line"].astype("Int32")
        yield pd.concat([b[["file_id", "repo", "language"]].reset_index(drop=True), got], axis=1)


def check_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, is_valid, failed_at_line, cause), one row per scan of a file in a known language.

    Files of other types and files whose lines are null (nothing was read) give no row. An empty file
    is judged by its grammar: valid in most languages, not in JSON, XML and Go. Ties cannot arise;
    repeated scans each give a row; extra columns are ignored.
    """
    ship(files.sparkSession)
    known = files.select("file_id", "repo", F.lower(F.trim("file_type")).alias("language"), file_text().alias("text"))
    known = known.where(F.col("language").isin(*LANGUAGES) & F.col("text").isNotNull())
    return known.mapInPandas(_check, "file_id bigint, repo string, language string, is_valid boolean, failed_at_line int, cause string")


def rates(checked: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid files, conflicts and the invalid share."""
    return checked.groupBy("repo", "language").agg(
        F.count("*").alias("n_files"), F.count_if(~F.col("is_valid")).alias("n_invalid"), F.count_if(F.col("cause") == "conflict").alias("n_conflicts"), F.avg((~F.col("is_valid")).cast("double")).alias("invalid_share")
    )
