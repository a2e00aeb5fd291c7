"""What the operators of this package share: scratch tables, checked broadcasts, batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D, written for Java's regular expressions.
WS = "\\x20\\x09-\\x0D"
#: The most that any operator here broadcasts of a table whose size grows with the data.
BROADCAST_BYTES = 32 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _own[app]


class Scratch:
    """Tables that an operator writes between its steps, under one folder of the shared directory.

    A written table cuts the lineage: when an executor is lost, later steps read the files again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loomgraph_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables that no later step reads."""
        for x in tables:
            if path := getattr(x, "_loomgraph_path", None):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """The table marked for broadcast if its counted size is within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], n: int, row_bytes: int, held: str = "held", how: str = "left", per_task: int = 1 << 20) -> DataFrame:
    """Join of many rows with a table of n rows, unique in its keys, whose column `held` tells how many of the rows have each key; `held` goes.

    The table is broadcast within the bound. Beyond it both sides are shuffled by key, and the rows of a key that more than
    per_task rows have are dealt to several tasks, each with its own copy of the table's row, so no key's rows must fit in one task. The table of such
    keys is broadcast: it has at most a row for every per_task input rows. Keys must not be null.
    """
    if n * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table.drop(held)), on, how)
    hot = F.broadcast(table.where(F.col(held) > per_task).select(*on, F.ceil(F.col(held) / per_task).alias("_salts")))
    salted = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_salts")))).drop("_salts")
    copies = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col(held) / per_task), F.lit(1)) - 1)
    dealt = table.withColumn("_salt", F.explode(F.when(F.col(held) > per_task, copies).otherwise(F.array(F.lit(0).cast("long"))))).drop(held)
    return salted.join(dealt, [*on, "_salt"], how).drop("_salt")


def batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of whole texts must stay small: at most so many rows each in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
