"""Reading tables, and cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``, or, on a local master that has none, one of our own."""
    conf = spark.sparkContext.getConf()
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or conf.get("spark.checkpoint.dir")
        or spark.sparkContext.getCheckpointDir()
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one evaluation, no lineage, and it survives the loss of executors.

    Unlike ``checkpoint()`` the copy is compressed and columnar, so later readers prune columns.
    The copy is dropped by :func:`release`, or when the process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._termloom_path = path
    return back


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/termloom-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def release(df: DataFrame) -> None:
    """Delete the table behind a DataFrame of :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_termloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def mark() -> int:
    """A point in time for :func:`release_since`."""
    return len(_written)


def release_since(point: int, *keep: DataFrame) -> None:
    """Delete all tables of :func:`materialize` written since a point, but those of ``keep``; nothing lazy may still read them."""
    kept = {getattr(df, "_termloom_path", None) for df in keep}
    for spark, path in _written[point:]:
        if path not in kept:
            _delete(spark, path)
    _written[point:] = [x for x in _written[point:] if x[1] in kept]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def spread(scan: DataFrame) -> DataFrame:
    """A scan for heavy work by row: dealt out evenly if it has fewer partitions than the cluster has cores, else as it is.

    Small files come as one partition each; on large tables nothing is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def join_hot(left: DataFrame, right: DataFrame, key: str, member: str, block: int = 2000) -> DataFrame:
    """The inner join on ``key`` of a side with few rows a key, ``left``, and one with any number, ``right``, hot keys cut.

    A key with c rows on the right gets ceil(c / block) parts by the hash of ``member``; its rows on the left go to every
    part. Counts of hot keys are broadcast only while they are few.
    """
    hot = materialize(right.groupBy(key).agg(F.count("*").alias("_c")).filter(F.col("_c") > block), "hot")
    n = hot.count()
    if n == 0:
        return left.join(right, key)
    side = F.broadcast(hot) if n <= 100_000 else hot
    parts = F.coalesce(F.ceil(F.col("_c") / block), F.lit(1)).cast("int")
    many = right.join(side, key, "left").withColumn("_p", F.pmod(F.xxhash64(member), parts).cast("int")).drop("_c")
    few = left.join(side, key, "left").withColumn("_p", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_c")
    return few.join(many, [key, "_p"]).drop("_p")


def block_pairs(
    left: DataFrame, right: DataFrame, key: str, member: str, block: int = 2000
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Split the hot keys of a many-to-many self join into tiles of at most ``2 * block`` rows.

    ``left`` and ``right`` are row subsets of the same postings. A key with c rows gets ceil(c / block) blocks by the
    hash of ``member``; a row goes to every tile (i, j), i <= j, of its block. Joined on the returned columns, with
    ``_bi = _bj or l._b <> r._b``, every pair of rows of a key meets in exactly one tile, in bounded work.
    The list of hot keys is broadcast only while it is small; beyond that it is joined by a shuffle.
    """
    both = left if left is right else left.unionByName(right)
    hot = materialize(both.groupBy(key).agg(F.count("*").alias("_c")).filter(F.col("_c") > block), "hot")
    n = hot.count()
    names = [key, "_bi", "_bj"]
    if n == 0:
        flat = lambda d: d.withColumns({"_b": F.lit(0), "_bi": F.lit(0), "_bj": F.lit(0)})
        return flat(left), flat(right), names
    side = F.broadcast(hot) if n <= 100_000 else hot

    def tile(d: DataFrame) -> DataFrame:
        nb = F.coalesce(F.ceil(F.col("_c") / block), F.lit(1)).cast("int")
        d = d.join(side, key, "left").withColumn("_nb", nb).withColumn(
            "_b", F.pmod(F.xxhash64(member), F.col("_nb")).cast("int")
        )
        d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        return d.withColumns({"_bi": F.least("_b", "_o"), "_bj": F.greatest("_b", "_o")}).drop("_c", "_nb", "_o")

    return tile(left), tile(right), names
