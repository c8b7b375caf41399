"""The build of a corpus in stages, with a report of each, behind a gate that asks whether to build at all.

A stage writes its table and is measured while it does so; nothing is counted in a job of its own.
The gate compares what a build was made from with what there is now: it refuses, builds anew or
reuses. Its snapshot is written last, so a build that broke off counts as none.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REPORT = "place int, stage string, rows_in long, rows_out long, measures map<string,long>, elapsed_ms long"
SNAPSHOT = "rows long, digest decimal(38,0), model string, written long"


class NotReady(RuntimeError):
    """No corpus to answer from, and none may be built."""


@dataclass(frozen=True)
class Stage:
    """``make`` takes the table of the stage before; ``measures`` are SQL aggregates over its rows, without distinct ones."""

    name: str
    make: Callable[[DataFrame], DataFrame]
    measures: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Ready:
    """What the gate did, and why."""

    action: str
    reason: str
    rows: int
    written: int
    model: str | None


def observed(df: DataFrame, path: str, measures: dict[str, str]) -> dict[str, int]:
    """Write a table; its ``rows`` and ``measures`` come from the same job."""
    seen = Observation()
    named = [F.coalesce(F.expr(c).cast("long"), F.lit(0)).alias(k) for k, c in measures.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *named).write.mode("overwrite").parquet(path)
    return seen.get


def run(source: DataFrame, root: str, stages: Sequence[Stage]) -> DataFrame:
    """Build all stages, each from the written table of the one before, and write and return the report.

    The first stage's ``rows_in`` are the rows of ``source`` as they are read for it.
    """
    spark, rows = source.sparkSession, []
    read = Observation()
    table, before = source.observe(read, F.count(F.lit(1)).alias("rows")), None
    for place, stage in enumerate(stages, 1):
        begun = time.monotonic()
        found = observed(stage.make(table), f"{root}/{stage.name}", stage.measures)
        taken = int((time.monotonic() - begun) * 1000)
        given = read.get["rows"] if before is None else before
        before = found.pop("rows")
        rows.append((place, stage.name, given, before, found, taken))
        table = spark.read.parquet(f"{root}/{stage.name}")
    spark.createDataFrame(rows, REPORT).coalesce(1).write.mode("overwrite").parquet(f"{root}/report")
    return report(spark, root)


def report(spark: SparkSession, root: str) -> DataFrame:
    """That of the last build."""
    return spark.read.schema(REPORT).parquet(f"{root}/report")


def fingerprint(source: DataFrame) -> tuple[int, object]:
    """Rows and a digest of the bag of rows, in one pass; nulls and nested values count."""
    whole = F.xxhash64(F.to_json(F.struct(*sorted(f"`{c}`" for c in source.columns)), {"ignoreNullFields": "false"})).cast("decimal(20,0)")
    r = source.agg(F.count("*").alias("rows"), F.coalesce(F.sum(whole), F.lit(0)).cast("decimal(38,0)").alias("digest")).first()
    return r.rows, r.digest


def snapshot(spark: SparkSession, root: str):
    """The row that the last whole build left, or None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot/_SUCCESS")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(SNAPSHOT).parquet(f"{root}/snapshot").first() if there else None


def _forget(spark: SparkSession, root: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def blocked(held, model: str | None) -> str | None:
    """Why what is there may not be replaced without leave: it was made with another model."""
    return "other model" if held is not None and held.model != model else None


def stale(spark: SparkSession, root: str, held, now: tuple[int, object], last: str) -> str | None:
    """Why what is there is not what a build would give; the written table is counted from its files' footers."""
    if held is None:
        return "no snapshot"
    if held.rows != now[0]:
        return "row count"
    if held.digest != now[1]:
        return "rows changed"
    return None if spark.read.parquet(f"{root}/{last}").count() == held.written else "rows differ"


def ensure_ready(source: DataFrame, root: str, stages: Sequence[Stage], model: str | None = None, rebuild: bool = False, allow: bool = False) -> Ready:
    """Reuse the build in ``root``, or build it anew where it is stale.

    An empty source is refused, and so is a build of another ``model``, unless ``rebuild`` asks for a
    new one or ``allow`` lifts the block; refusals raise :class:`NotReady` and leave all as it was.
    """
    spark = source.sparkSession
    now = fingerprint(source)
    if not now[0]:
        raise NotReady("no source rows")
    held = snapshot(spark, root)
    block = blocked(held, model)
    if block and not (rebuild or allow):
        raise NotReady(block)
    reason = "asked for" if rebuild else "allowed" if block else stale(spark, root, held, now, stages[-1].name)
    if reason is None:
        return Ready("reuse", "up to date", held.rows, held.written, held.model)
    _forget(spark, root)
    made = run(source, root, stages)
    written = made.orderBy(F.desc("place")).first().rows_out
    spark.createDataFrame([(*now, model, written)], SNAPSHOT).coalesce(1).write.mode("overwrite").parquet(f"{root}/snapshot")
    return Ready("rebuild", reason, now[0], written, model)
