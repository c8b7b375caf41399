"""SimHash near-duplicates with the generalised pigeonhole principle.

Fingerprints have 64 bits; two link if they differ in ``tau`` bits or fewer. If the bits are cut
into parts with thresholds t_i, and the sum of (t_i + 1) is tau + 1, every linking pair agrees
to within t_i bits in some part i; a threshold of -1 leaves a part out. Bits that go together
are put into one part, so that the parts are as independent as they can be; thresholds are
allotted by dynamic programming on the candidates that each part would give at each threshold,
estimated from a bounded sample of fingerprints. The plan only decides the work: any plan finds
all links.

Equal fingerprints are one node, so copies cost one row. Each fingerprint goes to the bucket of
its value in each part (threshold 0), or is also probed to all values within t_i bits of it.
A bucket is searched breadth first: each fingerprint taken up is compared with those that are
not yet reached, in one vector operation, and only the links of a spanning forest leave the
task. Before that, a bucket that is more than ``in_task`` fingerprints is cut by the same
principle once more: of its bits outside the part, cut into tau + 1 fields, two that link agree
in one at least, so each fingerprint goes to the finer bucket of each field, level by level,
until every bucket fits a task. Each level fixes more bits, and few distinct fingerprints are
left to a bucket whose bits are fixed, so the levels end. Links are the same at every
``in_task``. Components come from star contraction
(:func:`lexloom.llm.common.components`).

Edge cases: a null text and one without words have fingerprint zero and link like any other.
Repeated rows and repeated or null ids are allowed (a component's id is its smallest non-null
one). Old columns that clash with new ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from lexloom.llm.common import WORD, components, cut, thrifty, written

_WORDS = re.compile(WORD.encode())
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Each byte's eight bits (lowest first) as eight one-byte lanes of a 64-bit number.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> list[int]:
    words = _WORDS.findall(text.translate(_LOWER))
    if not words:
        return []
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [hashed(joined, seed)]
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[: len(words) - shingle]]
    return [hashed(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of ``hashes``."""
    counts = np.zeros(64, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 255):  # a lane holds 255 at most
        counts += _LANES[octets[at : at + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """Add ``fp`` (the fingerprint as a signed long); ``text`` is dropped."""
    kept = [c for c in docs.columns if c not in (text, "fp")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.zeros(batch.num_rows, np.uint64)
            for i, value in enumerate(batch.column("__bytes")):
                hashes = shingle_hashes(value.as_py() or b"", shingle)
                if hashes:
                    fps[i] = majority(np.array(hashes, dtype="<u8"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("__bytes")).mapInArrow(thrifty(run), schema)


# -- the plan -----------------------------------------------------------------------------
def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the 64 bits into near-equal parts, each grown by the bits most correlated with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(float)
    centred = bits - bits.mean(axis=0) if len(bits) else bits
    spread = np.sqrt((centred**2).sum(axis=0))
    tie = np.abs(centred.T @ centred) / np.maximum(np.outer(spread, spread), 1e-12)
    free, out = list(range(64)), []
    for k in range(parts, 0, -1):
        size, part = -(-len(free) // k), [free.pop(0)]
        while len(part) < size:
            best = max(free, key=lambda b: (tie[b, part].sum(), -b))
            free.remove(best)
            part.append(best)
        out.append(sorted(part))
    return out


def full(part: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in part))


def masks(part: list[int], within: int) -> np.ndarray:
    """All 64-bit numbers with up to ``within`` bits of ``part`` set."""
    return np.array([sum(1 << b for b in c) for k in range(within + 1) for c in itertools.combinations(part, k)], dtype=np.uint64)


def plan(sample: np.ndarray, rows: int, tau: int = 3, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """Parts of bits with thresholds of least estimated cost: rows to probe, and pairs to verify."""
    n = len(sample)
    differ = sample[:, None] ^ sample[None, :]
    scale = (rows / max(n, 1)) ** 2 / 2
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for count in range(1, most_parts + 1):
        parts = group_bits(sample, count)
        cost = np.full((count, tau + 2), np.inf)  # by threshold + 1
        for i, part in enumerate(parts):
            apart = np.bitwise_count(differ & full(part)) if n else np.zeros((0, 0))
            cost[i, 0] = 0
            for t in range(tau + 1):
                probes = sum(len(list(itertools.combinations(range(len(part)), k))) if k < 3 else len(part) ** 3 / 6 for k in range(t + 1))
                if probes <= 4096:
                    pairs = max(0, np.count_nonzero(apart <= t) - n) * scale
                    cost[i, t + 1] = pairs + 20.0 * rows * (probes + (t > 0))
        # least[i][s]: of the first i parts with thresholds + 1 that add up to s
        least, choice = np.full((count + 1, tau + 2), np.inf), np.zeros((count + 1, tau + 2), int)
        least[0, 0] = 0
        for i in range(count):
            for s in range(tau + 2):
                options = least[i, s - np.arange(s + 1)] + cost[i, : s + 1]
                choice[i + 1, s] = int(options.argmin())
                least[i + 1, s] = options.min()
        total, s, chosen = float(least[count, tau + 1]), tau + 1, []
        for i in range(count, 0, -1):
            chosen.append((parts[i - 1], int(choice[i, s]) - 1))
            s -= choice[i, s]
        if np.isfinite(total) and (best is None or total < best[0]):
            best = total, [c for c in reversed(chosen) if c[1] >= 0]
    return best[1]


# -- probe and verify ---------------------------------------------------------------------
def forest(fps: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints, breadth first."""
    left, out = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= tau
            if near.any():
                got = left[near]
                out += [(x, y) for y in got]
                queue += list(got)
                left = left[~near]
    return out


def _bucket_links(tau: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; small buckets are compared at growing lags, large ones searched."""
        held: list[pa.RecordBatch] = []

        def settle(lot: pa.Table) -> pa.RecordBatch:
            part, fixed, key = (lot.column(c).to_numpy() for c in ("part", "fixed", "key"))
            fp = lot.column("fp").to_numpy().view(np.uint64)
            first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (fixed[1:] != fixed[:-1]) | (key[1:] != key[:-1])])
            sizes = np.diff(np.r_[first, len(fp)])
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            small = np.repeat(sizes <= 24, sizes)
            group, tiny = np.repeat(np.arange(len(first)), sizes)[small], fp[small]
            for lag in range(1, 24):
                if len(tiny) <= lag:
                    break
                near = (group[lag:] == group[:-lag]) & (np.bitwise_count(tiny[lag:] ^ tiny[:-lag]) <= tau)
                a.append(tiny[:-lag][near])
                b.append(tiny[lag:][near])
            for f, n in zip(first[sizes > 24].tolist(), sizes[sizes > 24].tolist()):
                links = forest(np.unique(fp[f : f + n]), tau)
                if links:
                    found = np.array(links, dtype=np.uint64)
                    a.append(found[:, 0])
                    b.append(found[:, 1])
            a, b = np.concatenate(a), np.concatenate(b)
            other = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[other].view(np.int64)), pa.array(b[other].view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 65536:
                lot = pa.Table.from_batches(held)
                part, fixed, key = (lot.column(c).to_numpy() for c in ("part", "fixed", "key"))
                other = np.flatnonzero((part != part[-1]) | (fixed != fixed[-1]) | (key != key[-1]))
                if len(other):
                    yield settle(lot.slice(0, other[-1] + 1))
                    held = lot.slice(other[-1] + 1).to_batches()
        if sum(x.num_rows for x in held):
            yield settle(pa.Table.from_batches(held))

    return run


def fields(fixed: int, count: int) -> list[np.uint64]:
    """The bits that are not set in ``fixed``, as ``count`` masks of near-equal numbers of them."""
    bits = [b for b in range(64) if not fixed >> b & 1]
    return [full(bits[i * len(bits) // count : (i + 1) * len(bits) // count]) for i in range(count)]


def _finer(tau: int):
    """Each row of a large bucket goes to the finer bucket of each field of its free bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, fixed, key, fp = (batch.column(c).to_numpy() for c in ("part", "fixed", "key", "fp"))
            fixed, key, fp = fixed.view(np.uint64), key.view(np.uint64), fp.view(np.uint64)
            for mask in np.unique(fixed):
                here = fixed == mask
                for m in fields(int(mask), tau + 1):
                    wider = np.full(int(here.sum()), mask | m)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[here].view(np.int64), part[here], wider.view(np.int64), (key[here] | (fp[here] & m)).view(np.int64))], names=["fp", "part", "fixed", "key"])

    return run


def links(nodes: DataFrame, tau: int = 3, in_task: int = 16_384, sample: int = 2048) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``nodes(fp)`` that connect all within ``tau`` bits."""
    rows = nodes.count()
    taken = nodes.orderBy(F.xxhash64("fp")).limit(sample).collect()
    parts = plan(np.array([r.fp for r in taken], dtype=np.int64).view(np.uint64), rows, tau)
    where = ["part", "fixed", "key"]

    def buckets(i: int, part: list[int], t: int):
        whole = int(full(part).astype(np.int64))
        flips = F.array(*[F.lit(int(m)) for m in masks(part, t).view(np.int64)])
        return F.transform(flips, lambda m: F.struct(F.lit(i).alias("part"), F.lit(whole).alias("fixed"), F.col("fp").bitwiseXOR(m).bitwiseAND(F.lit(whole)).alias("key")))

    columns = [buckets(i, part, t) for i, (part, t) in enumerate(parts)]
    # A pair meets wherever both probe to; with threshold t both sides flip up to t bits, which also
    # finds pairs up to 2 t apart in the part. They are verified on all bits.
    probes = nodes.select("fp", F.explode(F.concat(*columns)).alias("at")).select("fp", "at.*")
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = None
    while True:
        # A bucket with no more than tau free bits isn't cut: few distinct fingerprints are left to it.
        large = written(probes.groupBy(*where).count().where((F.col("count") > in_task) & (F.bit_count("fixed") < 64 - tau)).select(*where))
        part = probes.join(large, where, "left_anti").repartition(n, *where).sortWithinPartitions(*where).mapInArrow(thrifty(_bucket_links(tau)), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if large.isEmpty():
            return found
        probes = written(probes.join(large, where, "left_semi").select("fp", *where).mapInArrow(thrifty(_finer(tau)), "fp long, part int, fixed long, key long").distinct())


def _named(nodes: DataFrame, tau: int, in_task: int) -> DataFrame:
    """``nodes`` with ``root``, a fingerprint that names the component."""
    edges = written(links(nodes.select("fp"), tau, in_task).distinct())
    roots = components(edges)
    return nodes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 5, tau: int = 3, in_task: int = 16_384) -> DataFrame:
    """Each row's ``doc_id``, ``fp`` and ``component_id``, the smallest id that links reach from it.

    The default takes five words; op9's contract asks for three.
    """
    marked = written(fingerprints(docs.select("doc_id", text), text, shingle))
    named = _named(written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"))), tau, in_task)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(per_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, rooted: DataFrame, text: str = "text") -> DataFrame:
    """Of each root of ``rooted(doc_id, mark, root)`` one row of ``docs``: smallest id (null last), then first text.

    ``mark`` is ``xxhash64`` of the text; rows of one id are told apart by it. Of rows equal in id and
    text the first by their other columns stays, as far as Spark can order these (maps it can't).
    Columns of ``docs`` may have any names.
    """
    rooted = written(rooted)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    keep = rooted.join(least, "root").where("doc_id <=> least").select("doc_id", "mark", "root").distinct()
    names = docs.columns
    inner = {c: f"__c{i}" for i, c in enumerate(names)}
    plain = docs.toDF(*inner.values())
    found = plain.join(keep, F.equal_null(plain[inner["doc_id"]], keep["doc_id"]) & (F.xxhash64(inner[text]) == keep["mark"]))
    ordered = [inner[text], *(c for n, c in inner.items() if n not in (text, "doc_id") and _orderable(docs.schema[n].dataType))]
    order = F.struct(*[x for c in ordered for x in (F.col(c).isNull().alias(f"{c}_no"), F.col(c))])
    row = F.min_by(F.struct(*inner.values()), order)
    return found.groupBy("root").agg(row.alias("row")).select(*[F.col(f"row.{c}").alias(n) for n, c in inner.items()])


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return _orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def one_of_each(docs: DataFrame, text: str = "text", shingle: int = 5, tau: int = 3, in_task: int = 16_384) -> DataFrame:
    """One row of each component: that with the smallest id (null last), and of equal ids the first text."""
    marked = written(fingerprints(docs.select("doc_id", F.xxhash64(text).alias("mark"), F.col(f"`{text}`").alias("__text")), "__text", shingle))
    named = _named(written(marked.select("fp").distinct()), tau, in_task)
    return first_of_each(docs, marked.join(named, "fp").select("doc_id", "mark", "root"), text)
