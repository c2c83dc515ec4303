"""Repository trees: files of a working copy, their modules and their text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.text import TYPE_BY_EXTENSION, TYPE_BY_NAME, file_type, kept_path
from lodeweave.runtime import ship


def decoded_lines(content: bytes | None) -> list[str]:
    """Lines of a file: UTF-8, else Latin-1; no empty piece after the last newline. Null content has none."""
    if content is None:
        return []
    try:
        return bytes(content).decode("utf-8").splitlines()
    except UnicodeDecodeError:
        return bytes(content).decode("latin-1").splitlines()


def scan_tree(spark: SparkSession, root: str, repo: str, only_paths: DataFrame | None = None) -> DataFrame:
    """(repo, relpath, name, type, extension, hash, total_lines, lines) of the supported files below a folder.

    Skipped folders and files are left out; with ``only_paths`` (relpath) nothing else is read.
    """
    ship(spark)
    # names that no type is known for are not even opened; the listing tells extensions in any case
    either = lambda x: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    known = ",".join([*(f"*{either(e)}" for e in TYPE_BY_EXTENSION), *TYPE_BY_NAME])
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{known}}}").load(root)
    top = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), f"^\\Q{top}\\E/", "")
    f = raw.select(rel.alias("relpath"), "content").withColumn("name", F.element_at(F.split("relpath", "/"), -1)).withColumn("type", file_type("name")).where(F.col("type").isNotNull() & kept_path("relpath"))
    if only_paths is not None:
        f = f.join(only_paths.select("relpath").distinct(), "relpath", "left_semi")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["lines"] = [decoded_lines(c) for c in b.pop("content")]
            yield b

    f = f.select("relpath", "name", "type", F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).alias("extension"), F.md5("content").alias("hash"), "content")
    out = f.mapInPandas(decode, "relpath string, name string, type string, extension string, hash string, lines array<string>")
    return out.select(F.lit(repo).alias("repo"), "relpath", "name", "type", "extension", "hash", F.size("lines").alias("total_lines"), "lines")


def find_modules(files: DataFrame) -> DataFrame:
    """(repo, root): folders with a pom.xml, else those with a Gradle build; repositories without either have the root ''."""
    name = F.element_at(F.split("relpath", "/"), -1)
    folder = F.regexp_replace(F.col("relpath"), r"/?[^/]*$", "").alias("root")
    marked = files.select("repo", folder, F.when(name == "pom.xml", 2).when(name.isin("build.gradle", "build.gradle.kts"), 1).otherwise(0).alias("w"))
    best = marked.groupBy("repo").agg(F.max("w").alias("best"))
    some = marked.join(best, "repo").where("w = best and best > 0").select("repo", "root").distinct()
    return some.union(best.where("best = 0").select("repo", F.lit("")))


def modules_by_longest_prefix(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files (repo, relpath, ...) with ``root``: the deepest module folder that holds them, null if none.

    Each path is exploded into its ancestor folders and equi-joined, where a prefix comparison would be
    a nested loop; the deepest hit is a pre-aggregated maximum.
    """
    parts = F.split("relpath", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    a = files.select("repo", "relpath").distinct().select("repo", "relpath", F.explode(above).alias("root"))
    hit = a.join(modules.select("repo", "root"), ["repo", "root"]).groupBy("repo", "relpath").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.join(hit, ["repo", "relpath"], "left")
