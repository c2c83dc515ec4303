"""Catalog sources: INFORMATION_SCHEMA over JDBC, row mappers, index parsing and profiling."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Engines, their aliases, default ports and drivers, and schemas that belong to the system.
ENGINES = {"mysql": ("mysql", 3306, "com.mysql.cj.jdbc.Driver"), "postgres": ("postgresql", 5432, "org.postgresql.Driver"), "mssql": ("sqlserver", 1433, "com.microsoft.sqlserver.jdbc.SQLServerDriver")}
ALIASES = {"mysql": "mysql", "mariadb": "mysql", "postgres": "postgres", "postgresql": "postgres", "pg": "postgres", "mssql": "mssql", "sqlserver": "mssql"}
SYSTEM_SCHEMAS = {"mysql": ["information_schema", "mysql", "performance_schema", "sys"], "postgres": ["information_schema", "pg_catalog", "pg_toast"], "mssql": ["INFORMATION_SCHEMA", "sys", "guest"]}


def engine_of(name: str) -> str:
    try:
        return ALIASES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown database engine {name!r}; known: {', '.join(sorted(ALIASES))}") from None


def parse_db_url(url: str) -> dict:
    """engine, host, port, user, password and databases of an address; a missing port is the engine's own."""
    u = urlsplit(url)
    engine = engine_of(u.scheme)
    names = [unquote(p) for p in u.path.strip("/").split(",") if p]
    return {"engine": engine, "host": u.hostname or "localhost", "port": u.port or ENGINES[engine][1], "user": unquote(u.username or ""), "password": unquote(u.password or ""), "databases": names}


def user_schemas(schemas: DataFrame, engine: str, only: list[str] | None = None) -> DataFrame:
    """Schemas (name) to read: the given ones, else all but the system's; the least of several spellings of a given name."""
    if only:
        return schemas.where(F.col("name").isin(*only))
    system = [x.lower() for x in SYSTEM_SCHEMAS[engine_of(engine)]]
    return schemas.where(~F.lower("name").isin(*system) & ~F.lower("name").startswith("pg_temp"))


def read_information_schema(spark: SparkSession, url: str, table: str, schemas: list[str] | None = None) -> DataFrame:
    """One INFORMATION_SCHEMA table over JDBC, without the system's schemas; filters reach the database."""
    c = parse_db_url(url)
    name, _, driver = ENGINES[c["engine"]]
    base = f"jdbc:{name}://{c['host']}:{c['port']}" + (f";databaseName={c['databases'][0]}" if c["engine"] == "mssql" else f"/{c['databases'][0]}") if c["databases"] else f"jdbc:{name}://{c['host']}:{c['port']}/"
    df = spark.read.format("jdbc").options(url=base, dbtable=f"INFORMATION_SCHEMA.{table.upper()}", user=c["user"], password=c["password"], driver=driver).load()
    df = df.toDF(*[x.lower() for x in df.columns])
    col = "routine_schema" if "routine_schema" in df.columns else "constraint_schema" if "constraint_schema" in df.columns and "table_schema" not in df.columns else "table_schema"
    return df.where(F.col(col).isin(*schemas)) if schemas else df.where(~F.col(col).isin(*SYSTEM_SCHEMAS[c["engine"]]))


def tables_of(info_tables: DataFrame) -> DataFrame:
    """Base tables only."""
    return info_tables.where("table_type = 'BASE TABLE'").select(F.col("table_schema").alias("schema"), F.col("table_name").alias("name"))


def columns_of(info_columns: DataFrame) -> DataFrame:
    """Columns with nullability as a boolean and nulls of texts as ''."""
    txt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in info_columns.columns else F.lit("")
    return info_columns.select(F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("column_name").alias("name"), F.col("ordinal_position").cast("int").alias("ordinal"), txt("data_type").alias("data_type"), (F.upper(txt("is_nullable")) == "YES").alias("is_nullable"), txt("column_key").alias("column_key"), txt("column_default").alias("default"), txt("extra").alias("extra"))


def views_of(info_views: DataFrame) -> DataFrame:
    """Views with their whole definitions, '' where the server hides them."""
    return info_views.select(F.col("table_schema").alias("schema"), F.col("table_name").alias("name"), F.coalesce("view_definition", F.lit("")).alias("definition"))


def routines_of(info_routines: DataFrame, info_parameters: DataFrame) -> DataFrame:
    """Routines with whole bodies and parameters as 'MODE name type' in their order, joined by specific name."""
    p = info_parameters.where("parameter_name is not null").select(F.col("specific_schema").alias("s"), F.col("specific_name").alias("n"), F.struct(F.col("ordinal_position").cast("int").alias("o"), F.concat_ws(" ", "parameter_mode", "parameter_name", "data_type").alias("sig")).alias("p"))
    per = p.groupBy("s", "n").agg(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["sig"]).alias("parameters"))
    r = info_routines.select(F.col("routine_schema").alias("schema"), F.col("routine_name").alias("name"), "specific_name", F.col("routine_type").alias("type"), F.coalesce("routine_definition", F.lit("")).alias("definition"))
    return r.join(per, (r["schema"] == per["s"]) & (r["specific_name"] == per["n"]), "left").select("schema", "name", "type", "definition", F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters"))


def foreign_keys_of(key_usage: DataFrame, referential: DataFrame) -> DataFrame:
    """ANSI foreign keys: constraint and referenced key usage joined by name, schema and position."""
    a, r, b = key_usage.alias("a"), referential.alias("r"), key_usage.alias("b")
    j = a.join(r, (F.col("a.constraint_name") == F.col("r.constraint_name")) & (F.col("a.constraint_schema") == F.col("r.constraint_schema")))
    j = j.join(b, (F.col("r.unique_constraint_name") == F.col("b.constraint_name")) & (F.col("r.unique_constraint_schema") == F.col("b.constraint_schema")) & (F.col("a.ordinal_position") == F.col("b.ordinal_position")))
    return j.select(F.col("a.constraint_name").alias("constraint_name"), F.col("a.table_name").alias("from_table"), F.col("a.column_name").alias("from_column"), F.col("b.table_name").alias("to_table"), F.col("b.column_name").alias("to_column"))


def index_columns(definition: str | Column) -> Column:
    """Columns of a CREATE INDEX definition: what stands in its first balanced parentheses, without its WHERE."""
    d = F.col(definition) if isinstance(definition, str) else definition
    inner = F.regexp_extract(d, r"\(((?:[^()]|\([^()]*\))*)\)", 1)
    parts = F.regexp_extract_all(inner, F.lit(r"((?:[^,()]|\([^()]*\))+)"), 1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def mysql_indexes(statistics: DataFrame) -> DataFrame:
    """(schema, table, name, is_unique, index_type, columns) of MySQL's STATISTICS, a row a column."""
    s = statistics.select(F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("index_name").alias("name"), F.struct(F.col("seq_in_index").cast("int").alias("at"), F.col("column_name").alias("c")).alias("part"), (F.col("non_unique") == 0).alias("is_unique"), "index_type")
    return s.groupBy("schema", "table", "name").agg(F.max("is_unique").alias("is_unique"), F.max("index_type").alias("index_type"), F.transform(F.array_sort(F.collect_list("part")), lambda x: x["c"]).alias("columns"))


def postgres_indexes(pg_indexes: DataFrame) -> DataFrame:
    """The same from PostgreSQL's definitions."""
    d = F.col("indexdef")
    return pg_indexes.select(F.col("schemaname").alias("schema"), F.col("tablename").alias("table"), F.col("indexname").alias("name"), F.upper(d).startswith("CREATE UNIQUE").alias("is_unique"), F.regexp_extract(d, r"(?i)\bUSING (\w+)", 1).alias("index_type"), index_columns(d).alias("columns"))


def mssql_indexes(rows: DataFrame) -> DataFrame:
    """The same from the index catalog of SQL Server, a row a column; columns in key order."""
    s = rows.select("schema", "table", "name", (F.col("is_unique") == 1).alias("is_unique"), F.col("type_desc").alias("index_type"), F.struct(F.col("key_ordinal").cast("int").alias("at"), F.col("column").alias("c")).alias("part"))
    return s.groupBy("schema", "table", "name").agg(F.max("is_unique").alias("is_unique"), F.max("index_type").alias("index_type"), F.transform(F.array_sort(F.collect_list("part")), lambda x: x["c"]).alias("columns"))


def mysql_foreign_keys(key_usage: DataFrame) -> DataFrame:
    """Foreign keys of MySQL, whose key usage names the referenced columns itself."""
    return key_usage.where("referenced_table_name is not null").select("constraint_name", F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), F.col("referenced_table_name").alias("to_table"), F.col("referenced_column_name").alias("to_column"))


def indexes_of(rows: DataFrame) -> DataFrame:
    """(table, name, is_unique, columns) of index rows (table, name, is_unique, column, position), columns in key order."""
    return rows.groupBy("table", "name").agg(F.max("is_unique").alias("is_unique"), F.transform(F.sort_array(F.collect_list(F.struct("position", "column"))), lambda x: x["column"]).alias("columns"))


def spark_catalog(spark: SparkSession, database: str) -> DataFrame:
    """(table, name, ordinal, data_type, is_nullable) of the tables of a Spark database."""
    rows = [(t.name, c.name, i + 1, c.dataType, c.nullable) for t in spark.catalog.listTables(database) for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"))]
    return spark.createDataFrame(rows, "table string, name string, ordinal int, data_type string, is_nullable boolean")


def vds_scan(services: DataFrame, queries: DataFrame, fields: DataFrame) -> DataFrame:
    """Services with their queries and where fields; fields hang on the query, so a service without one has none."""
    q = queries.withColumn("qsid", F.col("sid"))
    return services.join(q, "sid", "left").join(fields.withColumnRenamed("sid", "fsid"), F.col("fsid") == F.col("qsid"), "left").drop("fsid", "qsid")


def profile(tables: dict[str, DataFrame], most_rows: int | None = None) -> DataFrame:
    """(table, column, rows, distinct_values) with one pass over each table.

    Above ``most_rows`` rows distinct values are not counted (null), as counting them costs a shuffle.
    """
    parts = []
    for name, df in tables.items():
        exact = most_rows is None or df.count() <= most_rows
        aggs = [F.count("*").alias("_rows"), *[(F.countDistinct(F.col(c)) if exact else F.lit(None).cast("bigint")).alias(f"d{i}") for i, c in enumerate(df.columns)]]
        kinds = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(df.columns)])
        parts.append(df.agg(*aggs).select(F.lit(name).alias("table"), F.col("_rows").alias("rows"), F.inline(kinds)).select("table", "column", "rows", "distinct_values"))
    return reduce(DataFrame.unionByName, parts)
