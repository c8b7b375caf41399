"""Approximate nearest neighbours by cosine, with shifted Hilbert curves.

Each curve projects the unit vectors onto a few random orthogonal directions, shifts them at
random and orders them by Hilbert index. A curve's keys are cut at sampled splitters into cells
of about ``per_cell`` rows each, so cells grow in number with the table and not in size. A query looks at
the cells of its own key and at ``reach`` cells on either side, on every curve that is used;
candidates of all curves are merged and ranked by exact cosine in double precision on the
original vectors.

How many curves and how far to look depends on the data, so it is measured: a bounded sample of
queries is compared with all rows by brute force. For each number of curves the least reach is
found with which the share of true neighbours within it on some curve is at least ``recall`` (a
little above what is promised), and the number that reads least is taken. Data with structure
need few cells. Random directions in many dimensions have none, and there the reach covers much
of a curve.

Cells are dealt to tiles of neighbouring cells; vectors go to one tile of each curve, queries
to the tiles they reach. In a tile rows lie by cell, and queries of one cell are multiplied with
the cells in their reach only. Of equal vectors only those take part that can be in a result.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do those of an unusual length. Ids may repeat or be null (such a row is a candidate, last of its
ties); a query leaves out its own row only. Old columns are not kept. With k candidates or fewer
all are returned. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written
from lexloom.llm.vectors import best, contenders, matrix, taking_part, top_of

DIMENSIONS, BITS = 8, 5
#: Rows in a cell, about, and keys that splitters are taken from, at most (so larger tables have larger cells).
PER_CELL, SPLITTERS = 32, 65_536
#: Curves that are used at least.
FEWEST = 4


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows) with ``bits`` bits in each dimension.

    Skilling's transform: undo excess rotations from the highest bit down, Gray-encode, interleave.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class Curves:
    """Random directions and shifts of several curves."""

    def __init__(self, curves: int, width: int, seed: int):
        rng = np.random.default_rng(seed)
        self.directions = [np.linalg.qr(rng.normal(size=(width, min(width, DIMENSIONS))))[0] for _ in range(curves)]
        self.shifts = [rng.uniform(0, 1, size=min(width, DIMENSIONS)) for _ in range(curves)]
        self.scale = np.sqrt(width)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows x curves) keys; projections are spread over four standard deviations either way, and shifted by one at most."""
        out = []
        for direction, shift in zip(self.directions, self.shifts):
            place = (unit @ direction * self.scale + 4 + shift) / 9
            out.append(hilbert_index(np.clip((place * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS))
        return np.stack(out, axis=1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in one order of operations, so that equal vectors score equally."""
    dot, aa, bb = (np.einsum("ij,ij->i", x, y) for x, y in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True) if len(m) else m
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m


def _scores(queries: pa.Table, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """A block of queries against a block of rows: the best of each query, with exact scores."""
    q, v = matrix(queries.column("v").combine_chunks()), matrix(batch.column("v"))
    qrow, row = queries.column("row").to_numpy(), batch.column("row").to_numpy()
    rough = _unit(q) @ _unit(v).T if len(q) and len(v) else np.zeros((len(q), len(v)))
    rough[qrow[:, None] == row[None, :]] = -np.inf
    i, j = top_of(rough, k, 1e-9)
    arrays = [queries.column("row").combine_chunks().take(pa.array(i)), queries.column("vec_id").combine_chunks().take(pa.array(i)), batch.column("row").take(pa.array(j)), batch.column("vec_id").take(pa.array(j)), pa.array(cosines(q[i], v[j]) if len(i) else np.zeros(0))]
    return pa.RecordBatch.from_arrays(arrays, names=["query", "query_id", "row", "vec_id", "score"])


_FOUND = "query long, query_id long, row long, vec_id long, score double"


def pick_reach(apart: np.ndarray, cells: int, recall: float) -> tuple[int, int]:
    """(curves, reach) that read the fewest cells, at least ``FEWEST`` curves, of (neighbours x curves) distances in cells."""
    options = []
    for c in range(min(FEWEST, apart.shape[1]), apart.shape[1] + 1):
        nearest = np.sort(apart[:, :c].min(axis=1))
        reach = int(nearest[int(np.ceil(recall * len(nearest))) - 1]) + 1
        options.append((c * min(cells, 2 * reach + 1), c, reach))
    return min(options)[1:]


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50, curves: int = 16, per_cell: int = PER_CELL, recall: float = 0.93, sample: int = 192, tile_rows: int = 8192, seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = taking_part(vectors, lambda x: x, nonzero=True)
    width = rows.select(F.size("v").alias("n")).first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    maps = Curves(curves, width.n, seed)
    asked = F.pmod("vec_id", F.lit(every)) == 0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = maps.keys(_unit(matrix(batch.column("v")))) if batch.num_rows else np.zeros((0, curves), np.int64)
            flat_keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), curves).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat_keys], names=["row", "vec_id", "v", "keys"])

    schema = "row long, vec_id long, v array<double>, keys array<bigint>"
    candidates = written(contenders(rows, k).mapInArrow(keyed, schema))
    queries = rows.where(asked).mapInArrow(keyed, schema)
    n = candidates.count()

    # Splitters of each curve from a bounded sample of keys: curves x cells numbers, at most a few in a hundred thousand rows' keys.
    cells = max(1, -(-n // per_cell))
    seen = np.array([r["keys"] for r in candidates.orderBy(F.xxhash64("row", F.lit(seed))).limit(SPLITTERS).select("keys").collect()])
    cells = min(cells, len(seen))
    splitters = [np.sort(seen[:, c])[(np.arange(1, cells) * len(seen)) // cells] for c in range(curves)]

    # The reach, from a bounded sample of queries against all rows.
    few = pa.Table.from_pylist([{"row": r.row, "vec_id": r.vec_id, "v": r.v, "keys": r["keys"]} for r in queries.orderBy(F.xxhash64("row")).limit(sample).collect()], schema=pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("keys", pa.list_(pa.int64()))]))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _scores(few, batch, k)

    true = candidates.select("row", "vec_id", "v").mapInArrow(brute, _FOUND)
    truth = best(true.withColumn("query_id", F.col("query")).withColumn("vec_id", F.col("row")), k).select("query_id", F.col("vec_id").alias("row"))
    near = truth.join(candidates.select("row", "keys"), "row").collect() if few.num_rows else []
    own = dict(zip(few.column("row").to_pylist(), few.column("keys").to_pylist()))
    apart = np.array([[abs(int(np.searchsorted(s, a, "right")) - int(np.searchsorted(s, b, "right"))) for s, a, b in zip(splitters, own[r.query_id], r["keys"])] for r in near], dtype=np.int64)
    used, reach = pick_reach(apart, cells, recall) if len(apart) else (1, 0)

    size = max(1, tile_rows // -(-n // max(1, cells)))  # cells in a tile, by the rows that a cell really has

    def spread(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("keys").flatten().to_numpy().reshape(-1, curves)
                for c in range(used):
                    cell = np.searchsorted(splitters[c], keys[:, c], "right")
                    low = np.maximum(cell - reach, 0) // size if query else cell // size
                    high = np.minimum(cell + reach, cells - 1) // size if query else low
                    times = high - low + 1
                    at = np.repeat(np.arange(len(cell)), times)
                    tile = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + low[at]
                    for s in range(0, len(at), 4096):
                        part = batch.select(["row", "vec_id", "v"]).take(pa.array(at[s : s + 4096]))
                        m = part.num_rows
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(m, c, np.int32)), pa.array(tile[s : s + 4096].astype(np.int32)), pa.array(cell[at[s : s + 4096]].astype(np.int32)), pa.array(np.full(m, not query))], names=["row", "vec_id", "v", "curve", "tile", "cell", "side"])

        return run

    spread_schema = "row long, vec_id long, v array<double>, curve int, tile int, cell int, side boolean"
    both = queries.mapInArrow(spread(True), spread_schema).unionByName(candidates.mapInArrow(spread(False), spread_schema))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by tile, its queries first, both by cell; queries are held, the others pass in batches."""
        held, here, asking = [], None, None
        for whole in batches:
            place = whole.column("curve").to_numpy().astype(np.int64) * cells + whole.column("tile").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(place)) + 1, len(place)]
            for a, b in zip(edges[:-1], edges[1:]):
                if place[a] != here:
                    held, here, asking = [], place[a], None
                part = whole.slice(a, b - a)
                m = int((~part.column("side").to_numpy(zero_copy_only=False)).sum())
                if m:
                    held.append(part.slice(0, m))
                    asking = None
                if held and m < part.num_rows:
                    asking = asking or pa.Table.from_batches(held)
                    data = part.slice(m)
                    cell, theirs = asking.column("cell").to_numpy(), data.column("cell").to_numpy()
                    for s in range(0, len(cell), 16):  # queries of neighbouring cells, and what is in reach of any of them
                        e = min(s + 16, len(cell))
                        low, high = np.searchsorted(theirs, [cell[s] - reach, cell[e - 1] + reach + 1])
                        if low < high:
                            yield _scores(asking.slice(s, e - s), data.slice(low, high - low), k)

    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(count, "curve", "tile").sortWithinPartitions("curve", "tile", "side", "cell", "row").mapInArrow(search, _FOUND)
    return best(found, k)
