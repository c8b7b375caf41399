"""Text functions on columns; all stay in the JVM and in generated code where Spark has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.fixed import ANSWER_MARK, ARTICLE_REF, BLOCK_HEAD, CITED_LABEL, DIGITS, FILE_DATE, LINE_NOISE, LINE_PUNCTUATION, LIST_MARKER, LOCAL_MARKS, NATION, NUMERAL, UNITS  # noqa: F401


def u_trim(text: Column) -> Column:
    """Strip Unicode white space at both ends, U+3000 included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Without zero-width characters and spaces between Chinese characters, stripped."""
    text = F.regexp_replace(text, "[​‌‍﻿]", "")
    return u_trim(F.regexp_replace(text, r"(?<=[一-鿿])[ \t]+(?=[一-鿿])", ""))


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def folded(text: Column) -> Column:
    """For matching materials: no white space, lower case."""
    return F.lower(squeeze(text))


def question_key(text: Column) -> Column:
    """A question without all but word characters and Chinese ones."""
    return F.regexp_replace(text, r"(?U)[^\w一-鿿]+", "")


def file_law_name(stem: Column) -> Column:
    return F.regexp_replace(stem, FILE_DATE, "")


def file_version(stem: Column) -> Column:
    parts = [F.regexp_extract(stem, FILE_DATE, i) for i in (1, 2, 3)]
    return F.when(parts[0] == "", "unknown").otherwise(F.concat_ws("-", *parts))


def law_id(name: Column, registry: dict[str, str]) -> Column:
    hashed = F.concat(F.lit("law_"), F.substring(F.sha1(name.cast("binary")), 1, 10))
    if not registry:
        return hashed
    known = F.create_map(*[F.lit(x) for pair in registry.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), hashed)


def references(text: Column, own: Column) -> Column:
    """Ordered distinct article references but its own."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(ARTICLE_REF), F.lit(0))), lambda x: x != own)


def cn_to_int(numeral: Column) -> Column:
    """Chinese numeral to integer; null for anything else (an empty one, junk, or a zero not written 零)."""
    values = F.create_map(*[F.lit(x) for pair in (DIGITS | UNITS).items() for x in pair])
    start = F.struct(F.lit(0).alias("section"), F.lit(0).alias("number"))

    def step(acc: Column, char: Column) -> Column:
        v = values[char]
        unit = char.isin(*UNITS)
        section = acc["section"] + F.when(unit, F.when(acc["number"] == 0, 1).otherwise(acc["number"]) * v).otherwise(0)
        return F.struct(section.alias("section"), F.when(unit, 0).otherwise(v).alias("number"))

    total = F.aggregate(F.split(numeral, ""), start, step, lambda acc: acc["section"] + acc["number"])
    return F.when(numeral.rlike(f"^{NUMERAL}+$") & ((total != 0) | (numeral == "零")), total)


def article_number(raw: Column) -> Column:
    """第N条 in digits or numerals to a number, else null (digits other than 0-9 too)."""
    body = u_trim(F.regexp_replace(F.regexp_replace(u_trim(raw), "^第", ""), "条$", ""))
    return F.when(body.rlike(r"^\d{1,9}$"), F.expr("1") * body.try_cast("int")).otherwise(cn_to_int(body))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single one is itself, none the empty string."""
    s = squeeze(text)
    return F.when(F.length(s) < 2, F.array(s)).otherwise(F.array_distinct(_pairs(s)))


def _pairs(s: Column) -> Column:
    """Neighbouring characters. Characters are split once: a substring at each place would read from the start."""
    chars = F.split(s, "")
    n = F.length(s) - 1
    return F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: F.concat(a, b))


def terms(text: Column) -> Column:
    """Search terms: lower-cased runs of letters and digits, and bigrams of runs of Chinese characters."""
    low = F.lower(text)
    mixed = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}&&[^一-鿿]]+"), F.lit(0))
    chinese = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))
    grams = F.flatten(F.transform(chinese, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(_pairs(r))))
    return F.when(low.rlike("[一-鿿]"), F.concat(mixed, grams)).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def is_local(name: Column) -> Column:
    return name.rlike(LOCAL_MARKS)


def plain_law_name(name: Column) -> Column:
    """Without the country's name, unless that is all."""
    return F.when(name == NATION, name).otherwise(F.regexp_replace(name, NATION, ""))


def citation(law: Column, version: Column, article: Column | None = None) -> Column:
    base = F.concat(F.lit("《"), law, F.lit("》("), version, F.lit(")"))
    return base if article is None else F.concat(base, article)


def cited_labels(text: Column) -> Column:
    """Ordered distinct numbers of [依据N], either bracket."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITED_LABEL), F.lit(1)), lambda x: x.cast("int")))


def tolerant_boolean(text: Column) -> Column:
    low = F.lower(u_trim(text))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def braces(text: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("int"), F.lit(default))))


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def call_key(tool: Column, arguments: Column) -> Column:
    """Tool name and its arguments in key order."""
    return F.concat(tool, F.lit(":"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(arguments)))))


def uuid6_seconds(uid: Column) -> Column:
    """Unix time of a version 6 UUID; null for others."""
    ticks = F.conv(F.concat(F.substring(uid, 1, 8), F.substring(uid, 10, 4), F.substring(uid, 16, 3)), 16, 10).cast("bigint")
    good = uid.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-6[0-9a-fA-F]{3}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
    return F.when(good, (ticks - F.lit(0x01B21DD213814000)) / 1e7)


def seconds_to_midnight(ts: Column) -> Column:
    return F.lit(86400) - F.pmod(F.unix_timestamp(ts), F.lit(86400))


def valid_doc_id(doc_id: Column) -> Column:
    return doc_id.rlike("^[0-9a-f]{12}$")


def round_half_up(value: Column, places: int = 6) -> Column:
    return F.round(value, places)


def segments(answer: Column) -> Column:
    """An answer as ordered plain and reference parts; mismatched brackets are plain."""
    marks = ANSWER_MARK
    parts = F.regexp_extract_all(answer, F.lit(rf"(?s){marks}|.+?(?={marks}|$)"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(f"^(?:{marks})$"), "ref").otherwise("text").alias("kind"), p.alias("text")))
