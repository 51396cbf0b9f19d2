"""Session, lineage and skew helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(
    name: str = "marquee", cores: str = "8", shuffle_partitions: int = 8, folder: str | None = None
) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="marquee-"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a session on one machine that has none gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="marquee-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def write_once(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it from there.

    For rows that are read several times or that a loop builds on: a lost executor costs no more than
    a new read, columns that are not needed are not read, and Spark knows the size.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete_written(df: DataFrame) -> None:
    """Delete the folder of a table of ``write_once`` that nothing reads any more."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


BROADCAST_ROWS = 100_000


def broadcast_rows(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint for a table of at most ``most`` rows, if that is few enough."""
    return F.broadcast(df) if most <= BROADCAST_ROWS else df


def stable_hash(seed: int, *cols: Column) -> Column:
    """First 32 bits of md5(seed:col:...), the same on every partitioning and in SQL engines."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


HOT_ROWS = 200_000


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that hold ``HOT_ROWS`` rows or more, with their count as ``_rows``.

    Counts are combined before the shuffle, so the hot keys cost nothing themselves.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= HOT_ROWS)


def skew_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """Equi-join on equally named ``keys`` that spreads the left side's hot keys over many tasks.

    Rows of a hot key get one of as many salts as the key has times ``HOT_ROWS`` rows; the right side repeats its rows for
    those keys only, once per salt. All other rows keep salt 0. ``how`` may be inner, left, left_semi or left_anti.
    ``hot`` names the hot keys and their ``_rows`` where the caller knows the counts already. The hot keys are written
    first: Spark broadcasts them if their size allows, and joins them like any table otherwise.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    hot = hot_keys(left, keys) if hot is None else hot
    hot = write_once(hot.select(*keys, F.ceil(F.col("_rows") / HOT_ROWS).alias("_salts")))
    # a salt from the row's content is the same when a lost task runs again; a random one is not
    spread = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_salts")), F.lit(0).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts") - 1, F.lit(0).cast("long")))

    def mark(df: DataFrame) -> DataFrame:
        renamed = hot.withColumnsRenamed({k: f"_hot_{k}" for k in keys})
        same = [df[k].eqNullSafe(renamed[f"_hot_{k}"]) for k in keys]
        return df.join(renamed, same, "left").drop(*[f"_hot_{k}" for k in keys])

    salted_left = mark(left).withColumn("_salt", spread).drop("_salts")
    salted_right = mark(right).withColumn("_salt", F.explode(every)).drop("_salts")
    return salted_left.join(salted_right, keys + ["_salt"], how).drop("_salt")


def dense_index(df: DataFrame, group: str, key: str, name: str, buckets: int = 1024) -> DataFrame:
    """Number the distinct ``key`` values of each group from 0, in hash order, without one big sort.

    Keys fall into hash buckets; only the bucket sizes (``buckets`` rows a group) are summed up in
    order, and the keys are numbered inside their bucket.
    """
    bucketed = df.withColumn("_bucket", F.pmod(stable_hash(0, F.col(key)), F.lit(buckets)))
    sizes = bucketed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy(key)
    return (
        bucketed.join(offsets, [group, "_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def block_rows(spark: SparkSession, rows: int, most: int, least: int = 256) -> int:
    """Rows per block: ``most`` on big tables, fewer on small ones so that all cores have work."""
    return max(least, min(most, rows // spark.sparkContext.defaultParallelism))


def spread(df: DataFrame) -> DataFrame:
    """A table too small to be read by as many tasks as there are cores, dealt over the cores; any other as it is.

    Spark cuts no input finer than ``spark.sql.files.openCostInBytes``, so below that much for each core some would be idle
    while rows that are costly to work on lie in few tasks. The size is Spark's own estimate of the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (4 << 20) else df


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Size of files or folders, whatever file system they are in."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        size += place.getFileSystem(conf).getContentSummary(place).getLength()
    return size


def size_shuffles(spark: SparkSession, *paths: str, bytes_per_task: int = 128 << 20, growth: float = 3.0) -> int:
    """Set the number of shuffle partitions for the input's size, and return it.

    Adaptive execution merges small partitions but never makes more of them. ``growth`` is how much
    bigger the shuffled rows are than the compressed files.
    """
    wanted = int(input_bytes(spark, *paths) * growth / bytes_per_task) + 1
    number = min(200_000, max(wanted, spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.shuffle.partitions", str(number))
    return number
