"""Extraction from scraped pages, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def first_int(c: Column) -> Column:
    return F.replace(F.regexp_extract(text.digits(c), r"(\d[\d,]*)", 1), F.lit(","), F.lit("")).try_cast("int")


def width_percent(style: Column) -> Column:
    return F.regexp_extract(style, r"width:\s*(\d+(?:\.\d+)?)%", 1).try_cast("double")


def stars(percent: Column, places: int = 2) -> Column:
    return F.bround(percent / 100 * 5, places)


#: Parts of a link's host, and the network it is of.
NETWORKS = {"instagram": "instagram", "t.me": "telegram", "telegram": "telegram", "whatsapp": "whatsapp", "wa.me": "whatsapp", "linkedin": "linkedin"}


def links(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))


def social(html: Column) -> Column:
    """Network to link; the last link of a network wins."""

    def network(link: Column) -> Column:
        out = F.lit(None).cast("string")
        for part, name in reversed(NETWORKS.items()):
            out = F.when(link.contains(part), name).otherwise(out)
        return out

    named = F.filter(F.transform(links(html), lambda x: F.struct(network(x).alias("k"), x.alias("v"))), lambda e: e["k"].isNotNull())
    empty = F.create_map().cast("map<string, string>")
    return F.aggregate(named, empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"])))


def canonical_url(url: Column) -> Column:
    """Without the query, and without slashes at the end."""
    return F.rtrim(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("/"))


def attribute(html: Column, name: str, fallback: str | None = None) -> Column:
    """The digits of an attribute, or those after `fallback` in the page."""
    out = F.nullif(F.regexp_extract(html, name + r'="(\d+)"', 1), F.lit(""))
    if fallback:
        out = F.coalesce(out, F.nullif(F.regexp_extract(html, fallback + r"\D{0,4}(\d+)", 1), F.lit("")))
    return out


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def plain(html: Column) -> Column:
    """Text without scripts, styles and tags."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    return text.collapse(F.regexp_replace(c, r"(?s)<[^>]*>", " "))


def usable_comment(c: Column, rate: Column) -> Column:
    return (F.length(c) > 1) & rate.isNotNull()
