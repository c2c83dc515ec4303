"""Structure of source files as DataFrames, and Maven descriptors."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.runtime import ship
from lodeweave.sources.parsers import EMPTY, extract

STRUCTURE = "package string, imports array<struct<fqn:string,line:int>>, types array<struct<name:string,kind:string,line:int,visibility:string,is_abstract:boolean,is_final:boolean,extends:string,implements:array<string>,stereotype:string,mapped_table:string>>, methods array<struct<name:string,owner:string,line:int,return_type:string,visibility:string>>"


def structures(files: DataFrame, key: str, file_type: str, lines: str | Column) -> DataFrame:
    """(key, package, imports, types, methods) of every file with a parser; whole files, one pass."""
    ship(files.sparkSession)
    kind = files.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, ls in zip(b["key"], b["type"], b["lines"]):
                s = extract(t, [x or "" for x in ls] if ls is not None else [])
                if s is not None:
                    s = {**EMPTY, **s}
                    rows.append((k, s["package"], s["imports"], s["types"], s["methods"]))
            yield pd.DataFrame(rows, columns=[key, "package", "imports", "types", "methods"])

    src = files.select(F.col(key).alias("key"), F.col(file_type).alias("type"), (F.col(lines) if isinstance(lines, str) else lines).alias("lines"))
    return src.mapInPandas(run, f"{key} {kind}, {STRUCTURE}")


def namespace(relpath: Column, file_type: Column, package: Column) -> Column:
    """What qualifies the names a file declares: its package in Java, its dotted path in Python, its folder in Go, its path elsewhere."""
    stem = F.regexp_replace(relpath, r"\.[^./]*$", "")
    dotted = F.regexp_replace(F.regexp_replace(F.translate(stem, "/", "."), r"\.__init__$", ""), r"^(?:src|lib)\.", "")
    folder = F.regexp_replace(F.regexp_replace(relpath, r"/?[^/]*$", ""), "/", ".")
    return F.when(file_type == "java", package).when(file_type == "python", dotted).when(file_type == "go", F.coalesce(F.nullif(folder, F.lit("")), package)).otherwise(F.translate(stem, "/", "."))


def parse_pom(text: str | None) -> dict:
    """Coordinates, packaging and dependencies of a pom; parents lend group and version; a malformed one gives nothing."""
    none = {"group_id": "", "artifact_id": "", "version": "", "packaging": "", "description": "", "dependencies": []}
    try:
        root = ElementTree.fromstring(text or "")
    except ElementTree.ParseError:
        return none
    space = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""
    get = lambda node, *path: next((t.strip() for t in [node.findtext("/".join(space + p for p in path)) or ""] if t.strip()), "")
    deps = [{"group_id": get(d, "groupId"), "artifact_id": get(d, "artifactId"), "version": get(d, "version"), "scope": get(d, "scope") or "compile"} for d in root.findall(f"{space}dependencies/{space}dependency")]
    return {
        "group_id": get(root, "groupId") or get(root, "parent", "groupId"), "artifact_id": get(root, "artifactId"), "version": get(root, "version") or get(root, "parent", "version"),
        "packaging": get(root, "packaging") or "jar", "description": get(root, "description"), "dependencies": deps,
    }


POM = "struct<group_id:string,artifact_id:string,version:string,packaging:string,description:string,dependencies:array<struct<group_id:string,artifact_id:string,version:string,scope:string>>>"


def poms(files: DataFrame) -> DataFrame:
    """Files (text, ...) with ``pom`` in place of the text: coordinates and dependencies, blank for a malformed one."""
    ship(files.sparkSession)

    @F.pandas_udf(POM)
    def parse(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_pom(t) for t in text], columns=["group_id", "artifact_id", "version", "packaging", "description", "dependencies"])

    return files.select(*[c for c in files.columns if c != "text"], parse("text").alias("pom"))
