"""What the operators share: scratch tables in the shared folder, safe column names, a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows above which a table is joined by a shuffle and not by a broadcast.
BROADCAST_ROWS = 200_000
#: Rows of one key that a task may get.
HOT_ROWS = 2_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; one of our own only in local mode where it is unset."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        own = spark.sparkContext.getCheckpointDir()
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not own:
        own = f"file://{tempfile.mkdtemp(prefix='lodeseek-')}"
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which goes when the application ends."""
    own = f"{scratch_dir(spark)}/lodeseek-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{own}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` (narrow, already written) has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def joined_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count is within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def joined_unevenly(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined with the written ``keyed``, which has each key once and how often ``rows`` have it.

    Frequent keys are broadcast, so that the rows of one stay where they are; the bound of frequent keeps their number
    below BROADCAST_ROWS at any size. Rows of the other keys are shuffled.
    """
    most = keyed.agg(F.max(count).alias("most"), F.sum(count).alias("total")).first()
    bound = max(HOT_ROWS, (most["total"] or 0) // BROADCAST_ROWS)
    if (most["most"] or 0) <= bound:
        return rows.join(keyed, keys)
    hot = keyed.where(F.col(count) > bound)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col(count) <= bound), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, of):
    """``of(value)`` with ``value`` computed once a row, also where the optimizer would put it into each of its uses."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with marks added until none is among ``columns`` (compared as Spark does, without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
