"""What several operators share: tables, lineage cuts, flat byte views and components."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the five ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that goes to a Python worker, in a session that says nothing of them (Spark's default is 64 MB).
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound batches by :data:`BATCH` unless the session has a bound of its own.

    A worker holds a batch and reads the next, and the executor builds one besides, so with long
    texts batches are much of an executor's memory. Results don't hang on them.
    """
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; with a local master, the warehouse where none is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not context._jsc.sc().getCheckpointDir().isDefined() and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    current = context._jsc.sc().getCheckpointDir()
    if folder is None:
        folder = current.get() if current.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/lexloom-shared"
    if not current.isDefined():
        context.setCheckpointDir(folder)
        _delete_at_end(spark, context._jsc.sc().getCheckpointDir().get())
    return folder


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    """Delete a folder of our own when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table that a loop rewrites."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again; it goes when the application ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/lexloom/{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_end(spark, folder)  # a folder is marked only where it exists
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/lexloom/" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 22):
    """Cut a batch where its texts (or a column of their sizes) pass ``most_bytes``, so that scratch arrays stay small."""
    held = batch.column(column)
    sizes = held.to_numpy() if pa.types.is_integer(held.type) else np.diff(flat(held)[1])
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def thrifty(run):
    """``run`` of a mapInArrow, whose worker gives memory back to the system when its task ends.

    Spark keeps Python workers for later tasks; what Arrow and the C library hold free in them would
    count against the executor all the while.
    """

    def thrifty_run(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return thrifty_run


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: ``(id, root)`` for each end of ``edges(a, b)``.

    Alternates large-star and small-star steps: each node hands its neighbours to its smallest
    neighbour, until the graph is a star per component whose centre is the smallest id. A step
    is two partial aggregations and a join, so that a hub's neighbours are never in one task
    (adaptive execution splits the join); the lineage is cut after each round. The rounds end
    when every edge's lower end is a centre: it leads nowhere, and its upper end leads only there.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("leads"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("id").agg(F.sum("leads").alias("leads"), F.max("centre").alias("centre")).where("leads + centre > 1")
        if open_.isEmpty():
            roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
            return roots.union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
