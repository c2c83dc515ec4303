"""Session helpers shared by all operators: table access, lineage cuts, shipping code to workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, a local
    shell) a folder of this machine is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodeweave-"))
    return str(sc._jsc.sc().getCheckpointDir().get())


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; it is removed when the session's Python process ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/lodeweave-{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_remove_scratch)
    _scratch.append((spark, path))
    return path


_scratch: list[tuple[SparkSession, str]] = []


def _remove_scratch() -> None:
    for spark, path in _scratch:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone, and with it what could be removed
            return


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: cuts lineage like ``cut``, columnar and compressed."""
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """``df``, hinted for broadcast if its rows take at most so many bytes; beyond it the planner shuffles both sides.

    For materialised tables of bounded row width: names and keys count with 40 bytes, arrays with 120, all else with 8.
    """
    width = 16 + sum(120 if f.dataType.typeName() == "array" else 40 if f.dataType.typeName() in ("string", "binary") else 8 for f in df.schema)
    return F.broadcast(df) if df.count() * width <= most_bytes else df


def hot_keys(counts: DataFrame, key: str, most: int = 100_000) -> DataFrame | None:
    """(key, _parts) of the keys with more than ``most`` rows, from (key, n); None if there are none. There can be (rows / ``most``)."""
    hot = cut(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_parts")))
    return hot if hot.limit(1).count() else None


def spread_join(big: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``big`` joined with ``one`` (at most one row a key), the rows of ``hot_keys`` spread over several tasks.

    Rows of a hot key are parted by their hash, and the key's row in ``one`` is repeated for every part. The result
    is that of a plain join; ``how`` is inner or left.
    """
    if hot is None:
        return big.join(one, key, how)
    parts = lambda df: df.join(F.broadcast(hot), key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    left = parts(big).withColumn("_part", F.pmod(F.xxhash64(*big.columns), "_parts").cast("int")).drop("_parts")
    right = parts(one).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def parallelism(spark: SparkSession, per_core: int = 2) -> int:
    """A partition count that follows the cluster, not the machine of the driver."""
    return max(8, int(spark.sparkContext.defaultParallelism) * per_core, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers once a session, so that UDFs import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_lodeweave_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="lodeweave-")) / "lodeweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for root, _, names in os.walk(_PACKAGE):
            for n in sorted(names):
                if n.endswith((".py", ".peg")):
                    p = Path(root) / n
                    z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._lodeweave_shipped = True
