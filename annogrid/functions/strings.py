"""Parsing of metadata strings as Catalyst expressions: XMP packets, rationals, numbers, key names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of_bytes(content: Column) -> Column:
    """UTF-8 bytes as a string without the bytes that aren't valid."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")


def packet(text: Column, begin: str, end: str) -> Column:
    """The text from the first `begin` to the first `end` after it, both included; null if either is missing."""
    start = F.instr(text, begin)
    tail = F.substring(text, start, F.length(text))
    stop = F.instr(tail, end)
    return F.when((start > 0) & (stop > 0), F.substring(tail, F.lit(1), stop + len(end) - 1))


def last_by_key(entries: Column) -> Column:
    """A map of (key, value) entries; of equal keys the last. The entries are worked out once, as the variable of a function."""

    def kept(bound: Column) -> Column:
        return F.filter(bound, lambda e, i: ~F.exists(F.slice(bound, i + 2, F.size(bound)), lambda q: q["key"] == e["key"]))

    return F.map_from_entries(F.get(F.transform(F.array(entries), kept), F.lit(0)))


def attributes(tag: Column) -> Column:
    """name="value" attributes of a start tag as a map; of equal names the last."""
    pattern = r'([\w:]+)="([^"]*)"'
    names, values = (F.regexp_extract_all(tag, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return last_by_key(pairs)


def xmp_attributes(content: Column) -> Column:
    """Attributes of the first rdf:Description in a file's XMP packet; a map with XMP_error where there is none."""
    whole = packet(text_of_bytes(content), "<x:xmpmeta", "</x:xmpmeta>")
    tag = F.regexp_extract(whole, r"<rdf:Description([^>]*)>", 1)
    error = lambda why: F.create_map(F.lit("XMP_error"), F.lit(why))
    return F.when(whole.isNull(), error("No XMP metadata found")).when(~F.contains(whole, F.lit("<rdf:Description")), error("No rdf:Description found")).otherwise(attributes(tag))


def rational(text: Column) -> Column:
    """'7/2', '1 1/2', '-3/4' or '24' as a number; null for anything else or a zero denominator."""
    negative = F.startswith(F.trim(text), F.lit("-"))
    plain = F.regexp_replace(F.trim(text), "^-", "")

    def one(t: Column) -> Column:
        top, bottom = F.split_part(t, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(t, F.lit("/"), F.lit(2))
        return F.when(F.contains(t, F.lit("/")), F.try_divide(top, bottom.try_cast("double"))).otherwise(top)

    total = F.aggregate(F.transform(F.split(plain, r"\s+"), one), F.lit(0.0), lambda a, v: a + v)
    return F.when(negative, -total).otherwise(total)


def number_or_null(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"^[+-]?\d*\.?\d+$")), text.try_cast("double"))


def local_names(metadata: Column) -> Column:
    """A map with the part of each key after its last colon; of equal names the last."""
    entries = F.transform(F.map_entries(metadata), lambda e: F.struct(F.element_at(F.split(e["key"], ":"), -1).alias("key"), e["value"].alias("value")))
    return last_by_key(entries)


def merged_maps(*maps: Column) -> Column:
    """Maps united; a later map's value wins."""
    entries = F.concat(*(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps))
    return last_by_key(entries)
