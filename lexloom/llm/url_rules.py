"""URL filtering by given rules and by association rules mined from labelled URLs.

A given rule names a host (it fits that host and all its subdomains) and the start of a path;
of several that fit, the longest wins. Those URLs are also the labels: Spark's FP-growth mines
which combinations of URL tokens go with ``allow`` or ``block`` among them. Mined rules are
pruned by support and confidence, and a rule is dropped where a part of its tokens says the same
with no less confidence. URLs that no given rule fits are judged by the mined rule of highest
confidence, then support, then most tokens, whose tokens all occur; by ``default`` if none does.

Tokens are the host's endings and its labels, the path's segments with and without their place
(digits folded), and the names of query parameters. Many of them imply one another, and each one
that does doubles the itemsets without saying more. So frequent tokens that occur in just the
same labelled URLs are one item of the mining (told by their count and a sum of row hashes), and
a rule holds where any of an item's tokens occurs: these are the rules that mining each token
gives, once each. An item must occur in ``support`` of all labelled URLs and in ``least`` of them.
Frequent tokens are at most 1 / ``support`` times the tokens of a URL; only they are sent to
tasks.

Both kinds are matched by inverted index: given rules by each ending of the host; mined rules by
the one of their items that the fewest rules hold, in a join with the distinct sets of items of
the URLs to judge, with the other items checked. Rules stay a distributed table.

Edge cases: a null URL or one without ``://`` has empty host and path and gets ``default``.
Repeated rows are judged each. Without labelled URLs nothing is mined. Old columns that clash
with new ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written

_REST = "(?s)^.*?://(.*)$"
_LABEL = "verdict="


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.regexp_extract(url, _REST, 1), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_extract(url, _REST, 1), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: str, path: str, url: str | None) -> list[str]:
    labels = host.split(".") if host else []
    out = {f"host:{'.'.join(labels[i:])}" for i in range(len(labels))} | {f"label:{x}" for x in labels if x}
    parts = [re.sub(r"[0-9]+", "0", x) for x in path.split("/") if x]
    out |= {f"path{i}:{x}" for i, x in enumerate(parts)} | {f"path:{x}" for x in parts}
    query = (url or "").partition("#")[0].partition("?")[2]
    out |= {f"query:{x.partition('=')[0]}" for x in query.split("&") if x}
    return sorted(out)


@dataclass(frozen=True)
class Given:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: Sequence[str]) -> list[Given]:
    """``"block example.org/es/"``: verdict, host, and the path from the first slash on."""
    out = []
    for line in lines:
        verdict, _, place = line.partition(" ")
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {line}")
        host, slash, path = place.partition("/")
        out.append(Given(host.lower(), slash + path, verdict))
    return out


class GivenIndex:
    """Given rules by host."""

    def __init__(self, rules: Sequence[Given]):
        self.by_host: dict[str, list[Given]] = defaultdict(list)
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
            self.by_host[r.host].append(r)

    def match(self, host: str, path: str) -> Given | None:
        best, at = None, 0
        while host and at >= 0:
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r.path):
                    if best is None or (-len(r.text), r.text) < (-len(best.text), best.text):
                        best = r
                    break
            at = host.find(".", at) + 1 or -1
        return best


def with_tokens(pages: DataFrame, rules: Sequence[Given]) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``given`` (its verdict) and ``tokens``."""
    new = {"host": "string", "path": "string", "rule": "string", "given": "string", "tokens": "array<string>"}
    kept = [c for c in pages.columns if c not in new]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {k}" for c, k in new.items())])
    rules = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = GivenIndex(rules)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hits = [index.match(h, p) for h, p in zip(hosts, paths)]
            found = [tokens(h, p, u) for h, p, u in zip(hosts, paths, batch.column("__url").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*kept, "host", "path"]), pa.array([h and h.text for h in hits], pa.string()), pa.array([h and h.verdict for h in hits], pa.string()), pa.array(found, pa.list_(pa.string()))], names=[*kept, *new])

    return pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("url").alias("__url")).mapInArrow(run, schema)


def items_of(labelled: DataFrame, fewest: float) -> dict[str, str]:
    """Each token of at least ``fewest`` rows of ``labelled(tokens)`` to its item: the first token that occurs in just the same rows."""
    each = labelled.select(F.monotonically_increasing_id().alias("row"), "tokens").select(F.xxhash64("row").alias("h"), F.explode(F.array_distinct("tokens")).alias("token"))
    counted = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s")).where(F.col("n") >= fewest)
    return {t: min(r.tokens) for r in counted.groupBy("n", "s").agg(F.collect_list("token").alias("tokens")).collect() for t in r.tokens}


def with_items(table: DataFrame, items: dict[str, str]) -> DataFrame:
    """Add ``items``: those of a row's tokens that have one, sorted and distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({items[t] for t in ts if t in items}) for ts in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, "items"])

    return table.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema), "items array<string>"]))


_RULES = "tokens array<string>, verdict string, confidence double, support double"


def mine(labelled: DataFrame, support: float = 0.01, confidence: float = 0.8, least: int = 10) -> tuple[DataFrame, dict[str, str]]:
    """(rules, items) of ``labelled(tokens, given)``: rules from items to a verdict, without those of which a part says the same as surely."""
    spark = labelled.sparkSession
    baskets = labelled.where("given is not null and size(tokens) > 0").select("tokens", "given")
    n = baskets.count()
    fewest = max(support * n, least)
    items = items_of(baskets, fewest) if n >= least else {}
    if not items:
        return spark.createDataFrame([], _RULES), items
    rows = with_items(baskets, items).select(F.concat("items", F.array(F.concat(F.lit(_LABEL), "given"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=fewest / n * (1 - 1e-9), minConfidence=confidence).fit(rows)
    is_verdict = F.element_at("consequent", 1).startswith(_LABEL)
    found = model.associationRules.where(is_verdict & ~F.exists("antecedent", lambda t: t.startswith(_LABEL)))
    rules = written(found.select(F.array_sort("antecedent").alias("tokens"), F.replace(F.element_at("consequent", 1), F.lit(_LABEL), F.lit("")).alias("verdict"), "confidence", "support"))
    part = rules.where("size(tokens) > 1").select("tokens", "verdict", "confidence", F.explode("tokens").alias("t")).select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("t")).alias("part"))
    parts = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("of_part"))
    spare = part.join(parts, ["part", "verdict"]).where("of_part >= confidence").select("tokens", "verdict").distinct()
    return written(rules.join(spare, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "support")), items


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(items, verdict, mined)`` of the ``sets(items)`` that a rule fits: by highest confidence, then support, then most items."""
    uses = rules.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("uses"))
    each = rules.select("*", F.explode("tokens").alias("t")).join(uses, "t")
    keyed = each.groupBy("tokens", "verdict").agg(F.min(F.struct("uses", "t"))["t"].alias("t"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    asked = sets.select("items", F.explode("items").alias("t")).join(keyed, "t").where(F.size(F.array_except("tokens", "items")) == 0)
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.size("tokens"), "tokens", "verdict")
    return asked.groupBy("items").agg(F.min_by(F.struct("verdict", "tokens"), order).alias("x")).select("items", F.col("x.verdict").alias("by"), F.array_join("x.tokens", " & ").alias("mined"))


def judge(pages: DataFrame, rules: Sequence[str], support: float = 0.01, confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``mined`` (the items of the mined rule that judged, or null)."""
    ready = written(with_tokens(pages, parse_rules(rules)))
    found, items = mine(ready.select("tokens", "given"), support, confidence)
    kept = [F.col(f"`{c}`") for c in ready.columns if c not in ("rule", "given", "tokens", "verdict", "mined", "items", "by")]
    ready = ready.drop("items", "by", "mined", "verdict")
    open_ = with_items(ready.where("given is null"), items)
    # Written, so that a set of items that many URLs share can be split in the join.
    answers = written(matched(open_.where("size(items) > 0").select("items").distinct(), found))
    judged = open_.join(answers, "items", "left").select(*kept, "rule", F.coalesce("by", F.lit(default)).alias("verdict"), "mined")
    return ready.where("given is not null").select(*kept, "rule", F.col("given").alias("verdict"), F.lit(None).cast("string").alias("mined")).unionByName(judged)
