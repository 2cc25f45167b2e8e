"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: While it is set, a query's shuffle files go when it ends instead of when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables that ``written`` made in this process and ``drop_written`` has not deleted yet.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='healthloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: a cut in the lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/healthloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        _made.append(path)
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes the intermediate tables made so far. For a caller that has written its results: they read these tables."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def bounded(small: DataFrame, most: int = 50_000) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most ``most`` of them; beyond, it is joined by a shuffle."""
    return F.broadcast(small) if small.count() <= most else small.hint("merge")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns whose names an operator is about to add (any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def free(name: str, taken: set[str]) -> str:
    """name, with underscores added until it is none of those taken (lower case)."""
    while name.lower() in taken:
        name += "_"
    return name


def keyed_join(left: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner", bound: int = 50_000, salts: int = 32) -> DataFrame:
    """left joined to small, which has one row a key and is already written, so counting it is cheap.

    Up to ``bound`` rows small is broadcast. Beyond, it is repeated ``salts`` times and left is dealt by
    (key, hash of ``spread``), so a key with a third of all rows goes to many tasks.
    """
    if small.count() <= bound:
        return left.join(F.broadcast(small), key, how)
    salt = free("__salt", {c.lower() for c in (*left.columns, *small.columns)})
    salted = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [key, salt], how).drop(salt)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
