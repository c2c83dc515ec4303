"""References to records that do not exist, kept as keyed state that advances period by period.

Three kinds of event meet at a key: a parent arrives, a parent goes, a reference is made. The state of a
key is its number of live parents and of references; while no parent is live its references wait.
``OrphanStore`` keeps that state in a folder: ``advance`` applies one batch of events: new references probe the
index of parents, arriving parents resolve what waits, parents that go reopen it. Only keys that a batch
touches are read from the index and written anew; references are appended once and never rewritten.
``snapshots`` tells how many references waited at the end of each batch.

Scale: nothing here groups a key into one task. Events are pre-aggregated per (key, instant), the opening
balance of each day comes from a window over days, and only the instants of one key *and* day are ordered
together, so a key that attracts a third of all references is split by time.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators.published import Pointer
from lodeweave.runtime import checkpoint_dir, scratch_path

_DAY = 86_400 * 1_000_000
_NEVER = -(2**63) + 1
_NO_DATABASE = "\u0000none"
_KEY = "d string, tab string, col string"


def identifier(c: str | Column, last_part: bool = True) -> Column:
    """Comparable form of a typed identifier; null for null or blank.

    Case, surrounding blanks, identifier quotes (`` ` " [ ] ``) and, with ``last_part``, a leading
    schema qualifier do not matter.
    """
    c = F.col(c) if isinstance(c, str) else c
    c = F.trim(F.regexp_replace(F.lower(c), r"[\s ]+", " "))
    if last_part:
        c = F.regexp_replace(c, r'^(?:(?:`[^`]*`|"[^"]*"|\[[^\]]*\]|[^.`"\[\]]*)\s*\.\s*)+(?=\S)', "")
    return F.nullif(F.trim(F.translate(c, '`"[]', "    ")), F.lit(""))


def references(foreign_keys: DataFrame, vds_rows: DataFrame) -> DataFrame:
    """All references as rows (source_table, record_id, db, tab, col, at).

    A null or blank target refers to nothing and gives no row; ``col`` is null where only the table
    is named. Extra columns of the inputs are ignored.
    """
    fk = foreign_keys.select(
        F.lit("foreign_keys").alias("source_table"), F.col("fk_id").cast("bigint").alias("record_id"), F.col("database_name").alias("db"),
        identifier("to_table").alias("tab"), identifier("to_column").alias("col"), F.unix_micros(F.col("collected_at").cast("timestamp")).alias("at"),
    )
    vds = vds_rows.select(
        F.lit("vds_rows").alias("source_table"), F.col("vds_id").cast("bigint").alias("record_id"), F.col("database_name").alias("db"),
        identifier("coretable").alias("tab"), F.lit(None).cast("string").alias("col"), F.unix_micros(F.col("collected_at").cast("timestamp")).alias("at"),
    )
    return fk.unionByName(vds).where(F.col("tab").isNotNull())


def parents(catalog_columns: DataFrame) -> DataFrame:
    """Life spans of what can be referenced: (db, tab, col, born, gone), ``col`` null for a table.

    A row without first_seen_at has always been there; without dropped_at it still is. Repeated
    rows count once. A span that ends before it begins never lived.
    """
    c = catalog_columns.select(
        F.col("database_name").alias("db"), identifier("table_name").alias("tab"), identifier("column_name").alias("name"),
        F.coalesce(F.unix_micros(F.col("first_seen_at").cast("timestamp")), F.lit(-(2**62))).alias("born"), F.unix_micros(F.col("dropped_at").cast("timestamp")).alias("gone"),
    ).where(F.col("db").isNotNull() & F.col("tab").isNotNull() & (F.col("gone").isNull() | (F.col("gone") > F.col("born"))))
    keys = c.select("db", "tab", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.col("name")))).alias("col"), "born", "gone")
    return keys.distinct()


def _keyed(df: DataFrame) -> DataFrame:
    """One string key of database, table and column, unambiguous for nulls."""
    return df.withColumn("key", F.to_json(F.struct(F.coalesce("db", F.lit("")).alias("d"), "tab", "col")))


def events(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """The event stream (key, at, turn, delta, source_table, record_id).

    At one instant parents arrive and go (turn 0) before references probe (turn 1): a parent is live
    from its first instant and no longer at its last. A reference without a time probes at the
    beginning of time, so that nothing is known to be live; one without a database has a key of its own.
    """
    none = [F.lit(None).cast("string").alias("source_table"), F.lit(None).cast("bigint").alias("record_id")]
    s = _keyed(spans)
    come = s.select("key", F.col("born").alias("at"), F.lit(0).alias("turn"), F.lit(1).alias("delta"), *none)
    go = s.where(F.col("gone").isNotNull()).select("key", F.col("gone").alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("delta"), *none)
    r = _keyed(refs.withColumn("db", F.when(F.col("db").isNull(), F.lit(_NO_DATABASE)).otherwise(F.col("db"))))
    ask = r.select("key", F.coalesce("at", F.lit(_NEVER)).alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("delta"), "source_table", "record_id")
    return come.unionByName(go).unionByName(ask)


def replay(stream: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """The references (turn 1) of the events with ``live``: how many parents their key had when they were made.

    ``opening`` (key, live) is the saved parent index; keys without a row start at 0.
    """
    instants = stream.groupBy("key", "at").agg(F.sum("delta").alias("delta")).withColumn("day", F.floor(F.col("at") / _DAY))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = instants.groupBy("key", "day").agg(F.sum("delta").alias("change"))
    carried = days.select("key", "day", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("carry"))
    if opening is not None:
        opened = opening.select("key", F.col("live").alias("opened"))
        carried = carried.join(opened, "key", "left").select("key", "day", (F.col("carry") + F.coalesce("opened", F.lit(0))).alias("carry"))
    within = Window.partitionBy("key", "day").orderBy("at")
    balance = instants.join(carried, ["key", "day"]).select("key", "at", (F.col("carry") + F.sum("delta").over(within)).cast("bigint").alias("live"))
    return stream.where("turn = 1").join(balance, ["key", "at"])


def probe(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """The references with ``is_orphan``, replayed in one batch: no target was live when they were made.

    Returns (source_table, record_id, at, key, is_orphan), one row per reference row. Empty tables
    give no rows; without any parent every reference is an orphan.
    """
    return replay(events(refs, spans)).select("source_table", "record_id", _time("at"), "key", (F.col("live") <= 0).alias("is_orphan"))


def _time(c: str) -> Column:
    """The time of a reference; null for one without."""
    return F.when(F.col(c) > F.lit(_NEVER), F.col(c)).alias(c)


class OrphanStore:
    """Pending-orphan state under a folder that all executors share.

    Every batch adds a segment of references (key, source_table, record_id, at, is_orphan) and one of the
    index (key, live, n_refs, was_open, is_open, batch) for the keys it touched; the last segment that
    holds a key counts. Index segments are merged after every ``MERGED``. A batch becomes visible when
    the pointer moves to it, so one that failed is simply applied again and one that succeeded never is.
    """

    MERGED = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.pointer = spark, path.rstrip("/"), Pointer(spark, path)

    def _state(self) -> dict:
        return self.pointer.get() or {"batch": None, "index": [], "log": [], "refs": []}

    def _read(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    _INDEX = "key string, live bigint, n_refs bigint, was_open bigint, is_open bigint, batch bigint"
    _REFS = "key string, source_table string, record_id bigint, at bigint, is_orphan boolean, batch bigint"

    def index(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, live, n_refs, is_open): the state of all keys, or of the given ones (key)."""
        segments = self._read(self._state()["index"], self._INDEX)
        if keys is not None:
            segments = segments.join(keys, "key", "left_semi")
        last = segments.groupBy("key").agg(F.max_by(F.struct("live", "n_refs", "is_open"), "batch").alias("s"))
        return last.select("key", "s.live", "s.n_refs", "s.is_open")

    def references(self) -> DataFrame:
        """Every reference with is_orphan, as it was when the reference was made, and its batch."""
        return self._read(self._state()["refs"], self._REFS)

    def waiting(self) -> DataFrame:
        """The references that wait for a parent now."""
        return self.references().join(self.index().where("is_open > 0").select("key"), "key", "left_semi")

    def advance(self, stream: DataFrame, batch: int) -> DataFrame:
        """Apply a batch of events (numbers grow); returns what changed: (key, source_table, record_id, change).

        'orphan': a new reference that found no parent; 'resolved': it waited and a parent came; 'reopened':
        its last parent went. A reference may be an orphan and resolved in one batch. A batch that was
        applied before is not applied again.
        """
        state = self._state()
        if state["batch"] is None or batch > state["batch"]:
            touched = stream.groupBy("key").agg(F.sum("delta").alias("change"), F.count_if(F.col("turn") == 1).alias("new"))
            old = self.index(stream.select("key").distinct())
            index = touched.join(old, "key", "left").select(
                "key", (F.coalesce("live", F.lit(0)) + F.col("change")).cast("bigint").alias("live"), (F.coalesce("n_refs", F.lit(0)) + F.col("new")).cast("bigint").alias("n_refs"), F.coalesce("is_open", F.lit(0)).cast("bigint").alias("was_open"),
            )
            index = index.select("*", F.when(F.col("live") <= 0, F.col("n_refs")).otherwise(0).cast("bigint").alias("is_open"), F.lit(batch).cast("bigint").alias("batch"))
            refs = replay(stream, old).select("key", "source_table", "record_id", "at", (F.col("live") <= 0).alias("is_orphan"), F.lit(batch).cast("bigint").alias("batch"))
            with ThreadPoolExecutor(2) as pool:  # neither needs the other
                for done in [pool.submit(df.write.mode("overwrite").parquet, f"{self.path}/{name}-{batch}") for name, df in (("index", index), ("refs", refs))]:
                    done.result()
            segments, gone = [*state["index"], f"index-{batch}"], []
            if len(segments) > self.MERGED:
                last = self._read(segments, self._INDEX).groupBy("key").agg(F.max_by(F.struct("live", "n_refs", "was_open", "is_open"), "batch").alias("s"), F.max("batch").alias("batch"))
                last.select("key", "s.*", "batch").write.mode("overwrite").parquet(f"{self.path}/merged-{batch}")
                gone = [s for s in segments if s.startswith("merged-")]
                segments = [f"merged-{batch}"]
            self.pointer.set({"batch": batch, "index": segments, "log": [*state["log"], f"index-{batch}"], "refs": [*state["refs"], f"refs-{batch}"]})
            self.pointer.drop(*gone)
        return self.changes(batch)

    def changes(self, batch: int) -> DataFrame:
        """What an applied batch changed, from its segments."""
        index = self._read([n for n in self._state()["log"] if n == f"index-{batch}"], self._INDEX)
        turned = index.where("n_refs > 0").select("key", (F.col("live") > 0).alias("now"), (F.col("was_open") > 0).alias("waited"), "was_open", "is_open")
        refs = self.references().where(F.col("batch") <= batch).join(turned, "key")
        new = F.col("batch") == batch
        moved = F.array_compact(F.array(
            F.when(new & F.col("is_orphan"), "orphan"),
            F.when(F.when(new, F.col("is_orphan")).otherwise(F.col("waited")) & F.col("now"), "resolved"),
            F.when(F.when(new, ~F.col("is_orphan")).otherwise(~F.col("waited")) & ~F.col("now"), "reopened"),
        ))
        return refs.select("key", "source_table", "record_id", F.explode(moved).alias("change"))

    def snapshots(self) -> DataFrame:
        """(db, tab, batch, n_open): references that waited at the end of every batch that changed their number."""
        log = self._read(self._state()["log"], self._INDEX)
        k = F.from_json("key", _KEY)
        moved = log.select(k["d"].alias("d"), k["tab"].alias("tab"), "batch", (F.col("is_open") - F.col("was_open")).alias("moved")).groupBy("d", "tab", "batch").agg(F.sum("moved").alias("moved")).where("moved <> 0")
        so_far = Window.partitionBy("d", "tab").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # one row a batch
        return moved.select(F.nullif("d", F.lit(_NO_DATABASE)).alias("db"), "tab", "batch", F.sum("moved").over(so_far).alias("n_open"))


def by_period(refs: DataFrame, spans: DataFrame, months: int = 1, path: str | None = None) -> OrphanStore:
    """The store after all events were applied in batches of so many months, in a new folder of the shared file system.

    Batches are numbered by their last month (year * 12 + month - 1); what has no time belongs to the earliest. The
    events are written once, a folder for every period, and each batch reads its own.
    """
    spark = refs.sparkSession
    checkpoint_dir(spark)
    base = path or scratch_path(spark, "orphans")
    t = F.timestamp_micros(F.greatest(F.col("at"), F.lit(_DAY)))
    stream = events(refs, spans).withColumn("batch", (F.floor((F.year(t) * 12 + F.month(t) - 1) / months) * months + months - 1).cast("bigint"))
    stream.write.mode("overwrite").partitionBy("batch").parquet(f"{base}/events")
    stored = spark.read.schema(stream.schema).parquet(f"{base}/events")
    store = OrphanStore(spark, f"{base}/state")
    for r in stored.select("batch").distinct().orderBy("batch").collect():  # periods
        store.advance(stored.where(F.col("batch") == r["batch"]).drop("batch"), int(r["batch"]))
    return store


def snapshot_counts(probed: DataFrame) -> DataFrame:
    """Orphan and all references per (db, target, month made): db, tab, month, n_references, n_orphans."""
    k = F.from_json("key", _KEY)
    return (
        probed.select(F.nullif(k["d"], F.lit(_NO_DATABASE)).alias("db"), k["tab"].alias("tab"), F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("month"), "is_orphan")
        .groupBy("db", "tab", "month")
        .agg(F.count("*").alias("n_references"), F.count_if("is_orphan").alias("n_orphans"))
    )
