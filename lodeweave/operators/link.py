"""Linking code and catalog: four bulk passes, each an equi-join.

Whole-token containment of a table name in a definition would be a nested loop over definitions times
tables. Exploding the distinct tokens of each definition makes it an equi-join on (database, token); only
names that hold a blank, which no token can equal, are compared by containment, with definitions that
hold the first token of the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.text import SEPARATORS, definition_tokens

PASSES = ("maps_to", "based_on", "uses_table", "cross_db_reference")


def maps_to(classes: DataFrame, tables: DataFrame) -> DataFrame:
    """(src, dst): classes whose mapped table equals a table's name in any case; databases do not matter."""
    c = classes.where("mapped_table <> ''").select(F.col("id").alias("src"), F.lower("mapped_table").alias("n"))
    return c.join(tables.select(F.col("id").alias("dst"), F.lower("name").alias("n")), "n").select("src", "dst").distinct()


def mentions(definitions: DataFrame, tables: DataFrame, least: int = 4, across: bool = False) -> DataFrame:
    """(src, dst): definitions (id, database, definition) that hold a table's name (id, database, name) as a whole token.

    Within one database, or with ``across`` in different ones (null databases never match). Names shorter
    than ``least`` or holding a separator other than a blank never match.
    """
    d = definitions.where("definition is not null").select(F.col("id").alias("src"), F.col("database").alias("sdb"), definition_tokens("definition").alias("padded"))
    tokens = d.select("src", "sdb", F.explode(F.array_distinct(F.split(F.trim("padded"), " +"))).alias("token"))
    t = tables.where(F.char_length("name") >= least).select(F.col("id").alias("dst"), F.col("database").alias("tdb"), F.lower("name").alias("name"))
    t = t.where(F.translate("name", SEPARATORS.replace(" ", ""), "\u0001" * (len(SEPARATORS) - 1)).contains("\u0001") == F.lit(False))
    where = (F.col("sdb") != F.col("tdb")) if across else (F.col("sdb") == F.col("tdb"))
    one = tokens.join(t.where(~F.col("name").contains(" ")), (F.col("token") == F.col("name")) & where).select("src", "dst")
    wide = t.where(F.col("name").contains(" ")).withColumn("first", F.get(F.split(F.trim("name"), " +"), F.lit(0)))
    near = tokens.join(wide, (F.col("token") == F.col("first")) & where).select("src", "dst", "name")
    more = near.join(d.select("src", "padded"), "src").where(F.col("padded").contains(F.concat(F.lit(" "), "name", F.lit(" ")))).select("src", "dst")
    return one.union(more).distinct()


def run(names: list[str], classes: DataFrame, views: DataFrame, procedures: DataFrame, tables: DataFrame, least: int = 4) -> dict[str, DataFrame]:
    """The named passes; an unknown name is an error."""
    unknown = set(names) - set(PASSES)
    if unknown:
        raise ValueError(f"unknown link passes: {', '.join(sorted(unknown))}")
    made = {
        "maps_to": lambda: maps_to(classes, tables), "based_on": lambda: mentions(views, tables, least),
        "uses_table": lambda: mentions(procedures, tables, least), "cross_db_reference": lambda: mentions(views, tables, least, across=True),
    }
    return {n: made[n]() for n in names}
