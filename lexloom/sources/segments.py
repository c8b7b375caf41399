"""An index that takes changes: segments, tombstones, merges by size, and manifests that publish generations.

A folder of the index holds segments and manifests. A segment is a batch's new or changed documents
(``docs``: key, law, text, fingerprint) with their shards (:mod:`lexloom.operators.postings`). A change
buries a document's older version, a deletion its only one: ``dead`` of the generation that did it
names shard and place, ``terms`` what came to each term's number of documents and what went.

A manifest ``N.json`` lists the segments, tombstones and counts of generation N. It is written
beside and renamed, never over another: readers see a generation whole or not at all, and keep the
one that they loaded; of two writers of one generation the second fails. What a batch wrote
before it could publish belongs to no manifest and is cleared by :func:`vacuum`. A batch of a
stream is named in the manifest, so that one that comes again does nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import postings


@dataclass
class Manifest:
    """One generation. ``segments``: name and number of documents, dead ones included; ``batches``: the last one of each stream."""

    generation: int = 0
    documents: int = 0
    words: int = 0
    shards: int = 0
    segments: dict[str, int] = field(default_factory=dict)
    dead: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark: SparkSession, root: str) -> list[int]:
    """Those published, in order."""
    at, files = _files(spark, f"{root}/manifests")
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def manifest(spark: SparkSession, root: str, generation: int | None = None) -> Manifest:
    """Of a generation, by default the last; an empty one where there is none."""
    known = generations(spark, root)
    if not known:
        return Manifest()
    n = known[-1] if generation is None else generation
    return Manifest(**json.loads(spark.read.text(f"{root}/manifests/{n:010}.json", wholetext=True).first().value))


def _publish(spark: SparkSession, root: str, made: Manifest) -> None:
    """Atomically, or not at all if the generation is there by now."""
    temporary, files = _files(spark, f"{root}/manifests/_{uuid.uuid4().hex}")
    final, _ = _files(spark, f"{root}/manifests/{made.generation:010}.json")
    out = files.create(temporary, False)
    out.write(bytearray(json.dumps(asdict(made)).encode()))
    out.close()
    jvm = spark._jvm
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE  # fails where the target exists
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(final).toUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(temporary), files.makeQualified(final), options)


def _union(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _dead(spark: SparkSession, root: str, made: Manifest) -> DataFrame:
    return _union(spark, [f"{root}/{d}" for d in made.dead], "shard long, place int")


def _shards(spark: SparkSession, root: str, made: Manifest) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{s}/shards" for s in made.segments])


def _live(spark: SparkSession, root: str, made: Manifest) -> DataFrame:
    """(key, shard, place, length) of the documents that count."""
    placed = _shards(spark, root, made).where("term is null").select("shard", F.posexplode(F.arrays_zip("keys", "lengths")).alias("place", "of"))
    placed = placed.select("shard", "place", F.col("of.keys").alias("key"), F.col("of.lengths").alias("length"))
    return placed.join(_dead(spark, root, made), ["shard", "place"], "left_anti").select("key", "shard", "place", "length")


def _of_keys(docs: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Documents of some keys; of a few, which are counted, the keys go to the texts, so that no text is shuffled."""
    few = keys.limit(postings.SMALL + 1).count() <= postings.SMALL
    return docs.join(F.broadcast(keys) if few else keys, on, "left_semi")


def live_documents(spark: SparkSession, root: str, made: Manifest | None = None) -> DataFrame | None:
    """(key, law, text, fingerprint) of the documents that count; None without any segment.

    A key lives in one segment: what buried its older versions named their places.
    """
    made = made or manifest(spark, root)
    if not made.segments:
        return None
    placed = _live(spark, root, made).select("key", F.shiftright("shard", 44).alias("generation"))
    return _documents(spark, root, made).join(placed, ["key", "generation"], "left_semi").drop("generation")


def _documents(spark: SparkSession, root: str, made: Manifest) -> DataFrame:
    """(key, law, text, fingerprint, generation) of all segments, dead documents included."""
    parts = [spark.read.parquet(f"{root}/{s}/docs").withColumn("generation", F.lit(int(s.split("-")[1]))) for s in made.segments]
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    return docs


def fingerprint(law: str = "law", text: str = "text"):
    return F.xxhash64(F.col(law), F.col(text))


def _term_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def apply(spark: SparkSession, root: str, upserts: DataFrame, deletes: DataFrame | None = None, stream: str | None = None, batch: int | None = None, **shards) -> Manifest:
    """Publish a generation with new versions of ``upserts(key, text, [law])`` and without ``deletes(key)``.

    Keys are unique in ``upserts``; a key in both stays. The batch of a stream that is already in
    does nothing. Returns the last manifest.
    """
    before = manifest(spark, root)
    if stream is not None and batch is not None and before.batches.get(stream, -1) >= batch:
        return before
    g = before.generation + 1
    tag = f"{g:010}-{uuid.uuid4().hex[:8]}"
    segment = f"segment-{g}-{tag[-8:]}"
    law = F.col("law") if "law" in upserts.columns else F.lit(None)
    rows = upserts.select("key", law.cast("string").alias("law"), "text").withColumn("fingerprint", fingerprint())
    rows.write.parquet(f"{root}/{segment}/docs")
    docs = spark.read.parquet(f"{root}/{segment}/docs")
    postings.shards(docs, "key", law="law", generation=g, **shards).write.parquet(f"{root}/{segment}/shards")
    written = spark.read.parquet(f"{root}/{segment}/shards")
    new, words, more = postings.facts(written)
    made = Manifest(g, before.documents + new, before.words + words, before.shards + more, dict(before.segments), list(before.dead), list(before.terms), dict(before.batches))
    changes = postings.terms_of(written)
    if before.segments:
        gone = docs.select("key") if deletes is None else docs.select("key").unionByName(deletes.select("key")).distinct()
        buried = _live(spark, root, before).join(gone, "key", "left_semi").persist()
        buried.select("shard", "place").write.parquet(f"{root}/dead-{tag}")
        made.dead.append(f"dead-{tag}")
        old = buried.agg(F.count("*").alias("n"), F.sum("length").alias("words")).first()
        made.documents, made.words = made.documents - old.n, made.words - (old.words or 0)
        texts = _of_keys(_documents(spark, root, before), buried.select("key", F.shiftright("shard", 44).alias("generation")), ["key", "generation"])
        changes = changes.unionByName(_term_counts(texts).withColumn("df", -F.col("df")))
    changes.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{root}/terms-{tag}")
    if before.segments:
        buried.unpersist()
    made.terms.append(f"terms-{tag}")
    made.segments[segment] = new
    if stream is not None and batch is not None:
        made.batches[stream] = batch
    _publish(spark, root, made)
    return made


def changes(spark: SparkSession, root: str, docs: DataFrame, made: Manifest | None = None) -> DataFrame:
    """(key, change) of a whole snapshot ``docs(key, text, [law])`` against the index: added, changed, deleted or unchanged."""
    law = F.col("law") if "law" in docs.columns else F.lit(None)
    now = docs.select("key", law.cast("string").alias("law"), "text").select("key", fingerprint().alias("now"), F.lit(True).alias("here"))
    made = made or manifest(spark, root)
    old = live_documents(spark, root, made) if made.segments else now.select("key", F.col("now").alias("fingerprint")).where("false")
    both = now.join(old.select("key", "fingerprint", F.lit(True).alias("there")), "key", "full_outer")
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(F.col("now") == F.col("fingerprint"), "unchanged").otherwise("changed")
    return both.select("key", change.alias("change"))


def sync(spark: SparkSession, root: str, docs: DataFrame, **options) -> Manifest:
    """Bring the index to a whole snapshot: only documents that differ are read into a segment."""
    before = manifest(spark, root)
    if not before.segments:  # all are new
        return apply(spark, root, docs.where("key is not null"), **options)
    found = changes(spark, root, docs, before).persist()
    try:
        upserts = _of_keys(docs, found.where("change in ('added', 'changed')").select("key"), ["key"])
        return apply(spark, root, upserts, found.where("change = 'deleted'").select("key"), **options)
    finally:
        found.unpersist()


def merge(spark: SparkSession, root: str, fan: int = 4, **shards) -> Manifest:
    """Of segments of one order of size, if there are ``fan`` or more, make one without its dead documents.

    Orders are powers of ``fan``, so a document is written anew once for each order at most.
    """
    before = manifest(spark, root)
    orders: dict[int, list[str]] = {}
    for name, rows in before.segments.items():
        order = 0
        while fan ** (order + 1) <= rows:
            order += 1
        orders.setdefault(order, []).append(name)
    some = next((names for _, names in sorted(orders.items()) if len(names) >= fan), None)
    if some is None:
        return before
    g = before.generation + 1
    tag = f"{g:010}-{uuid.uuid4().hex[:8]}"
    segment = f"segment-{g}-{tag[-8:]}"
    part = Manifest(segments={n: before.segments[n] for n in some}, dead=before.dead)
    live_documents(spark, root, part).write.parquet(f"{root}/{segment}/docs")
    docs = spark.read.parquet(f"{root}/{segment}/docs")
    postings.shards(docs, "key", law="law", generation=g, **shards).write.parquet(f"{root}/{segment}/shards")
    kept = {n: rows for n, rows in before.segments.items() if n not in some}
    left = Manifest(segments=kept, dead=before.dead)
    made = Manifest(g, before.documents, before.words, 0, kept | {segment: docs.count()}, [], list(before.terms), dict(before.batches))
    if kept and before.dead:  # of segments that stay
        numbers = _shards(spark, root, left).where("term is null").select("shard")
        _dead(spark, root, before).join(numbers, "shard", "left_semi").write.parquet(f"{root}/dead-{tag}")
        made.dead = [f"dead-{tag}"]
    if len(made.terms) > 1:
        _union(spark, [f"{root}/{t}" for t in made.terms], "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(f"{root}/terms-{tag}")
        made.terms = [f"terms-{tag}"]
    made.shards = _shards(spark, root, made).where("term is null").count()
    _publish(spark, root, made)
    return made


def load(spark: SparkSession, root: str, generation: int | None = None) -> postings.Index:
    """The index of a generation; later changes don't touch it."""
    made = manifest(spark, root, generation)
    if not made.segments:
        raise FileNotFoundError(f"no generation in {root}")
    terms = _union(spark, [f"{root}/{t}" for t in made.terms], "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    index = postings.index_of(_shards(spark, root, made), terms, (made.documents, made.words / max(1, made.documents), made.shards))
    dead = _dead(spark, root, made).groupBy("shard").agg(F.collect_list("place").alias("dead"))  # a shard's places, at most
    return postings.Index(index.postings, index.heads.join(dead, "shard", "left"), index.terms, index.documents, index.mean_length, index.shards)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete what none of the last ``keep`` generations names; returns the names. No batch may be under way."""
    known = generations(spark, root)
    used: set[str] = set()
    for g in known[-keep:]:
        made = manifest(spark, root, g)
        used |= {*made.segments, *made.dead, *made.terms}
    at, files = _files(spark, root)
    gone = []
    for f in files.listStatus(at):
        name = f.getPath().getName()
        if name.startswith(("segment-", "dead-", "terms-")) and name not in used:
            files.delete(f.getPath(), True)
            gone.append(name)
    for g in known[:-keep]:
        files.delete(_files(spark, f"{root}/manifests/{g:010}.json")[0], False)
    return sorted(gone)


def follow(spark: SparkSession, source: DataFrame, root: str, checkpoint: str, name: str, **trigger):
    """A stream ``source(key, text, [law])`` into the index, a generation for each batch, each applied once.

    Of several versions of a key in one batch that of the largest ``version`` (if there is such a column) counts.
    """

    def each(batch: DataFrame, number: int) -> None:
        columns = [c for c in ("key", "text", "law") if c in batch.columns]
        newest = F.max_by(F.struct(*columns), F.col("version") if "version" in batch.columns else F.lit(0))
        rows = batch.groupBy("key").agg(newest.alias("row")).select("row.*")
        apply(batch.sparkSession, root, rows, stream=name, batch=number)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
