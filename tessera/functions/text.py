"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_slice(text: Column, offset: Column, length: Column) -> Column:
    """the substring at a UTF-16 offset, as message entities give it (an astral character counts two)."""
    return F.decode(F.substr(F.encode(text, "UTF-16LE"), (offset * 2 + 1).cast("int"), (length * 2).cast("int")), "UTF-16LE")


def links_of(text: Column, entities: Column) -> Column:
    """array<struct<url, texte>> of entities (type, offset, length, url): hidden links with their anchor, plain ones with null."""
    anchor = lambda e: utf16_slice(text, e["offset"], e["length"])
    kept = F.filter(entities, lambda e: e["type"].isin("text_url", "url"))
    hidden = lambda e: e["type"] == "text_url"
    return F.transform(kept, lambda e: F.struct(F.when(hidden(e), e["url"]).otherwise(anchor(e)).alias("url"), F.when(hidden(e), anchor(e)).alias("texte")))


def hrefs(html: Column) -> Column:
    """F20 for pages: the addresses of links."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def numbered(text: Column, expected: Column) -> Column:
    """the items of a numbered list, null unless there are `expected` of them."""
    items = F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d+\.[ \t]*(.*)$"), F.lit(1))
    return F.when(F.size(items) == expected, F.transform(items, lambda x: F.trim(x)))


def channel_name(text: Column) -> Column:
    """a channel's name from an address, an @name or a name."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^(https?://)?(www\.)?(t\.me|telegram\.me)/(s/)?", ""), r"^@|[/?].*$", "")


def entity_name(text: Column) -> Column:
    """lower case, without punctuation at the edges."""
    return F.lower(F.regexp_replace(F.trim(text), r"^[\p{P}\s]+|[\p{P}\s]+$", ""))


def xml_escape(text: Column) -> Column:
    """F21."""
    out = text
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def length_of(items: Column) -> Column:
    """F16: the length of a list, 0 for null."""
    return F.coalesce(F.size(items), F.lit(0))
