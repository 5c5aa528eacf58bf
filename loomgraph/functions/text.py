"""Ids, names, dates and text as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: relation ids are hashes of parts joined by these two characters.
RELATION_ID_DELIMITER = "\\|"


def node_id(domain: str, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(domain), key.cast("string")))


def entity_id(domain_and_raw: Column) -> Column:
    return F.md5(domain_and_raw)


def relation_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws(RELATION_ID_DELIMITER, *parts))


def packed(c: Column) -> Column:
    """A text id as bytes, different for different ids: 16 for one of 32 lower-case hex digits, else 17 zeros and its UTF-8.

    Loops over large graphs move ids this way: a hash takes half the room, in memory, shuffles and files.
    """
    return F.when(c.rlike(r"\A[0-9a-f]{32}\z"), F.unhex(c)).otherwise(F.concat(F.unhex(F.lit("00" * 17)), F.encode(c, "UTF-8")))


def unpacked(c: Column) -> Column:
    """The id that packed() made bytes of."""
    return F.when(F.octet_length(c) == 16, F.lower(F.hex(c))).otherwise(F.decode(F.substring(c, 18, (1 << 31) - 1), "UTF-8"))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """Version-5 UUID of a name: SHA-1 of namespace and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def json_text(c: Column) -> Column:
    """A string as ASCII JSON: quotes around it, other characters than ASCII as escapes of their UTF-16 units."""
    raw = F.to_json(F.array(c.cast("string")))
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(x: Column) -> Column:
        n = F.ascii(x)
        high, low = F.lit(0xD800) + F.floor((n - 0x10000) / 1024), F.lit(0xDC00) + F.pmod(n - 0x10000, F.lit(1024))
        return F.when(n < 128, x).when(n < 0x10000, unit(n.cast("long"))).otherwise(F.concat(unit(high.cast("long")), unit(low.cast("long"))))

    return F.array_join(F.transform(F.split(F.substring(raw, F.lit(2), F.length(raw) - 2), ""), escaped), "")


def identity_uuid(**fields: Column) -> Column:
    """Version-5 UUID (object-identifier namespace) of the JSON list of [field, value], by field name."""
    pairs = [F.concat(F.lit("["), F.lit(f'"{k}"'), F.lit(", "), json_text(v), F.lit("]")) for k, v in sorted(fields.items())]
    return uuid5(F.concat(F.lit("["), F.concat_ws(", ", *pairs), F.lit("]")), uuid.NAMESPACE_OID)


def strip_quotes(c: Column) -> Column:
    return F.translate(c, "\"'\\", "")


def joined(values: Column, delimiter: str = "|") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), delimiter)


def bracket_label(c: Column, at_end: bool = False, default: str = "") -> Column:
    """The word in [brackets], in title case without spaces; the default if there is none."""
    found = F.regexp_extract(c, r"\[([a-zA-Z]+)\]" + ("$" if at_end else ""), 1)
    return F.regexp_replace(F.initcap(F.when(found == "", F.lit(default)).otherwise(found)), " ", "")


def relation_name(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), " ", "_")


def year_of_text(c: Column) -> Column:
    """The first four digits in a row as a date on January 1; null if there are none."""
    y = F.regexp_extract(c, r"(\d{4})", 1)
    return F.when(y != "", F.concat(y, F.lit("-01-01")))


def year_start(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def year_of_epoch(seconds: Column) -> Column:
    return F.year(F.timestamp_seconds(seconds))


def render_path(triples: Column) -> Column:
    """[s-r->o] <> [...] of an array of structs s, r, o."""
    return F.array_join(F.transform(triples, lambda t: F.format_string("[%s-%s->%s]", t["s"], t["r"], t["o"])), " <> ")


def without_thoughts(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def split_by_markers(c: Column, markers: list[str]) -> Column:
    import re

    pattern = "|".join(re.escape(m) for m in markers)
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def clean_name(c: Column) -> Column:
    """No control characters, outer quotes or runs of white space."""
    plain = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(plain), r"^[\"']+|[\"']+$", ""), r"\s+", " "))


def levels(path: Column) -> Column:
    return F.split(path, "/")


def same_parent(a: Column, b: Column) -> Column:
    up = lambda c: F.slice(levels(c), F.lit(1), F.size(levels(c)) - 1)
    return up(a) == up(b)


def sentence_chunks(text: Column, size: int) -> Column:
    """Sentences (ended by . ! or ? and white space) packed in order into chunks of at most `size` characters; a longer sentence is a chunk of its own."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        fits = F.char_length(acc["open"]) + 1 + F.char_length(s) <= size
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), s.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["open"], s).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), s.alias("open")))
        )

    return F.aggregate(sentences, start, add, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Runs of `size` items, each starting size - overlap after the one before; the last may be shorter."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1 - overlap, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, size))
