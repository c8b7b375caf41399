"""Exact removal of repeated byte strings with a sparse, range-partitioned suffix array.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else.

Suffixes. Every window of ``length`` bytes picks one suffix that starts in it: the one whose
first ``gram`` bytes hash lowest (the leftmost of ties). The choice hangs on the window's bytes
alone, so equal windows pick suffixes at the same place within them, and about one suffix in 85
bytes stands for all. Windows are equal exactly if they lie alike around suffixes that agree on
as many bytes to either side.

Plan.
1. One scan picks the suffixes: two hashes (of the leading gram, and of all bytes that its
   windows can cover), the document's key and the range of windows. They are written once.
2. Suffixes whose gram occurs once are dropped (counted by partial aggregation, then a join
   that adaptive execution splits). Equal surroundings form a class; all windows of a class
   with two members are repeated, without any comparison, so thousands of copies cost one row.
3. Where a gram has several classes, one suffix of each class is compared with the others: its
   bytes are fetched and range-partitioned by the leading bytes of the suffixes, with splitters
   that Spark samples. Each bucket sorts its suffixes, and the reversed bytes before them, by
   multikey quicksort on eight-byte symbols. Longest common prefixes of neighbours in both
   orders tell which windows two suffixes share. Equal leading bytes share a bucket, so suffixes
   that are to be compared never straddle a boundary.
4. Suffixes that are compared together are those of one gram, unless these are more than
   ``in_task``. Then the distances at which their windows begin are halved, and each half needs
   more equal bytes on either side: suffixes go to a finer group by those bytes, level by level,
   until a group fits a task or is one distance, where it is one window and needs no comparison.
   What is found is the same at every ``in_task``.
5. Spans of windows go back to their documents by key, each distinct one once (so a document's
   list is in proportion to its text), and each document is cut.

Texts are read in stretches of ``stretch`` bytes with the margins that their windows need.

Edge cases: null text is empty. Repeated rows are documents of their own, so their windows
repeat. Ids may be null or repeat. Old columns that clash with new ones are replaced. Very long
texts are handled whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import discard, flat, mix64, slices, thrifty, written

LENGTH, GRAM = 200, 32
_BITS = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) that start at each place."""
    h, step, k = _BITS[raw], 1, 0
    while step < gram:
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * _ODD[k % 6] + h[step:]
        h ^= h >> np.uint64(32)
        step, k = 2 * step, k + 1
    return mix64(h)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    blocks = np.concatenate([keys, np.full(-n % width, 2**64 - 1, dtype=np.uint64)]).reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def range_hashes(grams: np.ndarray, low: np.ndarray, high: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the bytes [low, high), at least ``gram`` long, from the hashes of grams that cover them."""
    out = mix64((high - low).astype(np.uint64))
    for i in range(int(-(-(high - low).max() // gram)) if len(low) else 0):
        at = np.minimum(low + i * gram, high - gram)
        out = np.where(low + i * gram < high, mix64(out * _ODD[0] + grams[at] * _ODD[1 + i % 5]), out)
    return out


def _pick(raw: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, suffix start, first and last window start, gram hash, surroundings' hash); starts count from the document's."""
    width, empty = length - gram + 1, np.zeros(0, np.int64)
    if len(raw) < length:
        return empty, empty, empty, empty, empty, empty
    grams = gram_hashes(raw, gram)
    keys = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least(keys, width)
    sizes = np.diff(ends)
    long = np.flatnonzero(sizes >= length)
    counts = sizes[long] - length + 1
    if not len(long):
        return empty, empty, empty, empty, empty, empty
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends[long], counts)
    owner = np.repeat(long, counts)
    at = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    doc, a = owner[first], at[first]
    low, high = np.maximum(a - (width - 1), ends[doc]), np.minimum(a + length, ends[doc + 1])
    around = range_hashes(grams, low, high, gram) ^ mix64((a - low).astype(np.uint64) + np.uint64(1))
    return doc, a - ends[doc], window[first] - ends[doc], window[last] - ends[doc], grams[a].view(np.int64), around.view(np.int64)


def pick_suffixes(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, stretch: int = 1 << 22) -> tuple[np.ndarray, ...]:
    """As :func:`_pick`; a text alone is taken in stretches of windows, so that scratch arrays stay small."""
    if len(ends) != 2 or len(raw) <= stretch + 2 * length:
        return _pick(raw, ends, length, gram)
    lots: list[tuple[np.ndarray, ...]] = []
    for w in range(0, len(raw) - length + 1, stretch):
        last = min(w + stretch, len(raw) - length + 1) - 1
        low, high = max(0, w - length), min(len(raw), last + 2 * length)
        doc, a, first, to, grams, around = _pick(raw[low:high], np.array([0, high - low]), length, gram)
        first, to = np.maximum(first + low, w), np.minimum(to + low, last)
        here = first <= to
        lot = [x[here] for x in (doc, a + low, first, to, grams, around)]
        if lots and len(lots[-1][1]) and len(lot[1]) and lots[-1][1][-1] == lot[1][0]:  # picked on both sides of the border
            lot[2][0] = lots[-1][2][-1]
            lots[-1] = tuple(x[:-1] for x in lots[-1])
        lots.append(tuple(lot))
    return tuple(np.concatenate(x) for x in zip(*lots))


def multikey_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``symbols`` (unsigned, most significant first), and how many leading symbols each shares with its predecessor in it.

    Multikey quicksort: rows are sorted by one symbol, and only runs of equal ones go on to the next.
    """
    rows, columns = symbols.shape
    order, shared = np.arange(rows), np.zeros(rows, dtype=np.int64)
    run = np.zeros(rows, dtype=np.int64)  # of the places that are still tied
    places = np.arange(rows)
    for c in range(columns):
        if not len(places):
            break
        symbol = symbols[order[places], c]
        by = np.lexsort((symbol, run))
        order[places] = order[places][by]
        symbol = symbol[by]
        new_run = np.r_[True, run[1:] != run[:-1]]
        same = ~new_run & np.r_[False, symbol[1:] == symbol[:-1]]
        shared[places[same]] = c + 1
        group = np.cumsum(~same) - 1
        tied = np.bincount(group)[group] > 1
        places, run = places[tied], group[tied]
    return order, shared


def _symbols(bytes_: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols of eight bytes; a last one of the length puts what ends before what goes on with NULs."""
    pad = -bytes_.shape[1] % 8
    wide = np.ascontiguousarray(np.pad(bytes_, ((0, 0), (0, pad))))
    return np.c_[wide.view(">u8").astype(np.uint64), lengths.astype(np.uint64)]


def _common(order: np.ndarray, bytes_: np.ndarray, lengths: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Common bytes of each row in ``order`` with the one before it, none past either's length."""
    n, out = bytes_.shape[1], np.zeros(len(order), dtype=np.int64)
    for at in range(1, len(order), 65536):
        a, b = order[at : at + 65536], order[at - 1 : min(at + 65536, len(order)) - 1]
        differ = bytes_[a] != bytes_[b]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
        out[at : at + len(a)] = np.minimum(same, np.minimum(lengths[a], lengths[b]))
    return out


def shared_windows(before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, near: np.ndarray, far: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of suffixes repeat: a Boolean (suffix x bytes before it).

    ``before`` holds the bytes before each suffix, nearest first, ``after`` its own, both padded;
    a suffix has windows that begin ``near`` to ``far`` bytes before it. Two windows are equal if
    as many bytes before both suffixes and the rest after them agree. Both orders are sorted once;
    for each distance, runs of long enough common prefixes number the classes on either side.
    """
    n, width = len(after), before.shape[1] + 1
    hit = np.zeros((n, width), dtype=bool)
    if n < 2:
        return hit
    right, shared = multikey_order(_symbols(after, n_after))
    right_common = _common(right, after, n_after, shared)
    left, shared = multikey_order(_symbols(before, n_before))
    left_common = _common(left, before, n_before, shared)
    right_class, left_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(int(near.min()), min(int(far.max()), width - 1) + 1):
        right_class[right] = np.cumsum(right_common < length - d)
        left_class[left] = np.cumsum(left_common < d) if d else 0
        active = np.flatnonzero((near <= d) & (d <= far))
        key = right_class[active] * (n + 1) + left_class[active]
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        hit[active[order], d] = np.r_[False, same] | np.r_[same, False]
    return hit


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true cells: row, first, last column."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, in_task: int = 20_000) -> DataFrame:
    """Rows ``(id, mark, low, high)``: bytes [low, high) of a document to remove, in parts that may overlap.

    ``docs`` has ``id`` (non-null long), ``mark`` (a hash of the row) and ``bytes``.
    """
    width = length - gram + 1
    if not 1 <= width <= 1 << 16:
        raise ValueError("length - gram must be 0 to 65535")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "bytes", 1 << 20):
                doc, a, low, high, g, c = pick_suffixes(*flat(batch.column("bytes")), length, gram)
                doc = pa.array(doc)
                where = (a << 32) | ((a - high) << 16) | (a - low)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(doc), batch.column("mark").take(doc), pa.array(where), pa.array(g), pa.array(c)], names=["id", "mark", "place", "gram", "around"])

    # place: the suffix's start, and how far before it its last and its first window begin (two bytes each).
    picked = written(docs.select("id", "mark", "bytes").mapInArrow(thrifty(pick), "id long, mark long, place long, gram long, around long"))
    # Written, so that both sides of the join are plain exchanges and a hot gram can be split.
    often = written(picked.groupBy("gram").count().where("count > 1").select("gram"))
    tied = written(picked.join(often, "gram", "left_semi"))
    discard(picked, often)

    classes = written(tied.groupBy("gram", "around").agg(F.count("*").alias("members"), F.min(F.struct("id", "mark", "place")).alias("one")))
    certain = tied.join(classes.where("members > 1").select("gram", "around"), ["gram", "around"], "left_semi")
    start, near, far = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(F.lit(65535)), F.col("place").bitwiseAND(F.lit(65535))
    sure = certain.select("id", "mark", (start - far).alias("low"), (start - near + length).alias("high"))

    # Written, so that a gram of many classes can be split in the join.
    several = written(classes.groupBy("gram").count().where("count > 1").select("gram", (F.col("count") > in_task).alias("hot")))
    asked = classes.join(several, "gram").select("gram", "around", "members", "one.*", "hot")
    wanted = asked.groupBy("id", "mark").agg(F.collect_list(F.struct("gram", "around", "members", "place", "hot")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "around", "members", "place", "hot", "lead", "n_before", "bytes"]
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            raw, ends = flat(batch.column("bytes"))
            lists = batch.column("asked")
            doc = np.repeat(np.arange(batch.num_rows), [len(v) for v in lists])
            rows = lists.flatten()
            fields = {name: rows.field(i) for i, name in enumerate(names[:5])}
            a = (fields["place"].to_numpy() >> 32) + ends[doc]
            low, high = np.maximum(a - (width - 1), ends[doc]), np.minimum(a + length, ends[doc + 1])
            cut_out = [raw[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist())]
            lead = [raw[x : x + gram].tobytes() for x in a.tolist()]
            yield pa.RecordBatch.from_arrays([*fields.values(), pa.array(lead, pa.binary()), pa.array(a - low), pa.array(cut_out, pa.binary())], names=names)

    fields = "gram long, around long, members long, place long, hot boolean, lead binary, n_before long, bytes binary"
    fetched = written(docs.select("id", "mark", "bytes").join(wanted, ["id", "mark"]).select("bytes", "asked").mapInArrow(thrifty(fetch), fields))

    def matrices(batch: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
        raw, ends = flat(batch.column("bytes"))
        n, nb = batch.num_rows, batch.column("n_before").to_numpy()
        na = np.diff(ends) - nb
        padded = np.concatenate([raw, np.zeros(1, np.uint8)])
        place = batch.column("place").to_numpy()
        columns = np.arange(width - 1)
        before = np.where(columns < nb[:, None], padded[np.where(columns < nb[:, None], (ends[:-1] + nb)[:, None] - 1 - columns, 0)], 0) if n else np.zeros((0, width - 1), np.uint8)
        columns = np.arange(length)
        after = np.where(columns < na[:, None], padded[np.where(columns < na[:, None], (ends[:-1] + nb)[:, None] + columns, 0)], 0) if n else np.zeros((0, length), np.uint8)
        return before.astype(np.uint8), nb, after.astype(np.uint8), na, (place >> 16) & 65535, place & 65535

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket, in the order of leading bytes: groups are compared in lots of some thousand suffixes."""
        held: list[pa.RecordBatch] = []

        def settle(lot: pa.Table) -> pa.RecordBatch:
            *sides, near_, far_ = matrices(lot)
            near_, far_ = np.maximum(near_, lot.column("nearest").to_numpy()), np.minimum(far_, lot.column("farthest").to_numpy())
            hit = shared_windows(*sides, near_, far_, length)
            hit &= (lot.column("members").to_numpy() == 1)[:, None]
            row, first, last = _runs(hit)
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([lot.column("gram").combine_chunks().take(take), lot.column("around").combine_chunks().take(take), pa.array(first), pa.array(last)], names=["gram", "around", "first", "last"])

        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4096:
                lot = pa.Table.from_batches(held)
                group = lot.column("group").to_numpy()
                other = np.flatnonzero(group != group[-1])
                if len(other):  # the last group may go on in the next batch
                    yield settle(lot.slice(0, other[-1] + 1))
                    held = lot.slice(other[-1] + 1).to_batches()
        if held and sum(b.num_rows for b in held):
            yield settle(pa.Table.from_batches(held))

    buckets = max(1, int(fetched.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    result = "gram long, around long, first long, last long"

    def compared(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange(buckets, "lead", "group").sortWithinPartitions("lead", "group").mapInArrow(thrifty(compare), result)

    names = ["gram", "around", "members", "place", "lead", "n_before", "bytes", "group", "nearest", "farthest"]

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row in the finer groups of both halves of its group's distances, and a hash of all that the half's windows hold."""
        for whole in batches:
            for batch in (whole.slice(at, 2048) for at in range(0, whole.num_rows, 2048)):
                before, nb, after, na, near_, far_ = matrices(batch)
                line = np.concatenate([before[:, ::-1], after], axis=1)
                grams = gram_hashes(np.r_[line.ravel(), np.zeros(gram, np.uint8)], gram)
                own, low, high = (batch.column(c).to_numpy() for c in ("gram", "nearest", "farthest"))
                middle = (low + high) // 2
                for nearest, farthest in ((low, middle), (middle + 1, high)):
                    row = np.flatnonzero((nearest <= farthest) & (near_ <= farthest) & (far_ >= nearest))
                    nearest, farthest = nearest[row], farthest[row]
                    at = row * line.shape[1] + width - 1  # where the suffix begins
                    # All windows of the half hold `nearest` bytes before the suffix and length - farthest of its own.
                    key = range_hashes(grams, at - nearest, at + length - farthest, gram)
                    key = mix64(key ^ mix64(own.view(np.uint64)[row] + nearest.astype(np.uint64)))
                    first, last = np.minimum(farthest, nb[row]), np.minimum(length - nearest, na[row])
                    held = range_hashes(grams, at - first, at + last, gram) ^ mix64(first.astype(np.uint64) + np.uint64(1))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names[:7]), pa.array(key.view(np.int64)), pa.array(nearest), pa.array(farthest), pa.array(held.view(np.int64))], names=[*names, "held"])

    grouped = fetched.withColumns({"group": F.col("gram"), "nearest": F.lit(0).cast("long"), "farthest": F.lit(width - 1).cast("long")})
    found, left = compared(grouped.where("not hot").drop("hot")), grouped.where("hot").drop("hot")
    key = ["gram", "group", "nearest"]
    while not left.isEmpty():
        spread = written(left.mapInArrow(thrifty(halves), "gram long, around long, members long, place long, lead binary, n_before long, bytes binary, group long, nearest long, farthest long, held long"))
        # Rows that hold the same repeat in all the half's windows; one of them stands for them from here on.
        alike = written(spread.groupBy(*key, "held").agg(F.count("*").alias("n"), F.min("around").alias("around")))
        equal = spread.where("members = 1").join(alike.where("n > 1").select(*key, "held"), [*key, "held"], "left_semi")
        found = found.unionByName(equal.select("gram", "around", F.greatest("nearest", near).alias("first"), F.least("farthest", far).alias("last")))
        one = spread.join(alike, [*key, "held", "around"]).withColumn("members", F.greatest("members", "n")).select(*names)
        large = written(alike.groupBy(*key).count().where(F.col("count") > in_task).select(*key))
        found = found.unionByName(compared(one.join(large, key, "left_anti").select(*names)))
        left = one.join(large, key, "left_semi").select(*names)

    maybe = classes.where("members = 1").select("gram", "around", "one.*").join(found, ["gram", "around"])
    rest = maybe.select("id", "mark", (start - F.col("last")).alias("low"), (start - F.col("first") + length).alias("high"))
    return sure.unionByName(rest)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.withColumns({"__bytes": raw, "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__mark": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c in ("doc_id", text)])})


def _cut(docs: DataFrame, text: str, new: dict[str, str], make, length: int, gram: int, in_task: int) -> DataFrame:
    kept = [c for c in docs.columns if c not in new]
    keyed = _keyed(docs, text)
    found = spans(keyed.select(F.col("__id").alias("id"), F.col("__mark").alias("mark"), F.col("__bytes").alias("bytes")), length, gram, in_task)
    gathered = found.groupBy("id", "mark").agg(F.collect_set(F.struct("low", "high")).alias("__spans")).withColumnsRenamed({"id": "__id", "mark": "__mark"})
    frame = keyed.select(*[F.col(f"`{c}`") for c in kept if c != text or text not in new], "__id", "__mark", "__bytes").join(gathered, ["__id", "__mark"], "left").drop("__id", "__mark")
    kept = [c for c in frame.columns if c not in ("__bytes", "__spans")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"`{c}` {kind}" for c, kind in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            raw, ends = flat(batch.column("__bytes"))
            lists, rows = batch.column("__spans"), []
            parts = lists.flatten()
            lows, highs = parts.field(0).to_numpy(), parts.field(1).to_numpy()
            sizes = np.array([0 if not v.is_valid else len(v) for v in lists], dtype=np.int64)
            at = np.cumsum(sizes) - sizes
            for i in range(batch.num_rows):
                body = raw[ends[i] : ends[i + 1]]
                edge = np.zeros(len(body) + 1, np.int32)
                np.add.at(edge, lows[at[i] : at[i] + sizes[i]], 1)
                np.add.at(edge, highs[at[i] : at[i] + sizes[i]], -1)
                gone = np.cumsum(edge[:-1]) > 0
                rows.append(make(body, gone))
            columns = list(zip(*rows)) if rows else [()] * len(new)
            kinds = {"bigint": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(list(v), type=kinds[k]) for v, k in zip(columns, new.values()))], names=[*kept, *new])

    return frame.mapInArrow(thrifty(run), schema)


def remove(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, in_task: int = 20_000) -> DataFrame:
    """The documents with repeated byte strings taken out of ``text``; broken characters at cuts are dropped."""
    columns = docs.columns

    def make(body: np.ndarray, gone: np.ndarray):
        return (body[~gone].tobytes().decode("utf-8", "ignore"),)

    return _cut(docs, text, {text: "string"}, make, length, gram, in_task).select(*[F.col(f"`{c}`") for c in columns])


def digests(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, in_task: int = 20_000) -> DataFrame:
    """``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each document."""

    def make(body: np.ndarray, gone: np.ndarray):
        runs = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
        return len(body), int(gone.sum()), runs, hashlib.sha256(body[~gone].tobytes()).hexdigest()

    return _cut(docs, text, {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}, make, length, gram, in_task).drop(text)
