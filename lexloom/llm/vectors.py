"""What both vector searches share: which rows take part, and matrices of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import flat, written  # noqa: F401


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix of doubles."""
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def taking_part(vectors: DataFrame, component, nonzero: bool) -> DataFrame:
    """``(row, vec_id, v)``: rows with a vector of finite components, written once.

    ``component`` maps a double to what is compared, which must be finite too. Of several lengths
    only the most frequent takes part (ties: the longest). ``row`` names a row, as ids may repeat
    or be null; a row without id is a candidate, and its ties come last.
    """
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(component(x.cast("double"))) < F.lit(float("inf"))))
    good = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    if nonzero:
        good = good.where(F.exists("embedding", lambda x: x != 0))
    sizes = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    good = good.where(F.size("embedding") == (sizes.n if sizes else 0))
    picked = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(doubles, component).alias("v"))
    return written(picked.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v"))


def contenders(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors, the ``k + 1`` of smallest id.

    Equal vectors score alike and ties go to smaller ids, so no other one can be among any
    query's ``k`` best: the result is whole, and copies without number cost k + 1 rows. The rank
    is limited within each partition before the shuffle.
    """
    order = W.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "row")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth")


def best(found: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The ``k`` best distinct candidates of each query, ranked from 1."""
    order = W.partitionBy("query").orderBy(F.desc(by), F.asc_nulls_last("vec_id"), "row")
    ranked = found.dropDuplicates(["query", "row"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_of(scores: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` best scores and what comes within ``slack`` of them; -inf never."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        least = np.full(len(scores), -np.inf)
    return np.nonzero((scores >= least[:, None] - slack) & np.isfinite(scores))
