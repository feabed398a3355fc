"""HTML to text as one Column expression, without a shuffle or a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, ascii_lower, bind, trim_ws

NAMED = {"nbsp": " ", "lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def decode_entities(c: Column) -> Column:
    """Named and numeric entities; an unknown one stays without its end, a number that is no character goes."""

    def one(t: Column) -> Column:
        name = F.regexp_extract(t, r"(?s)^&([^;]{0,13})", 1)
        number = F.when(name.rlike("^#[0-9]+$"), F.substring(name, 2, 20).try_cast("int")).when(name.rlike("^#x[0-9A-Fa-f]+$"), F.conv(F.substring(name, 3, 20), 16, 10).try_cast("int"))
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        # the bytes of UTF-32 are the code point; the decoder takes them in the JVM
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        out = F.when(name.startswith("#"), F.when(F.coalesce(valid, F.lit(False)), char).otherwise(""))
        for k, v in NAMED.items():
            out = out.when(name == k, v)
        return F.when(t.startswith("&"), out.otherwise(F.concat(F.lit("&"), name))).otherwise(t)

    parts = F.regexp_extract_all(c, F.lit(r"(?s)(&[^;]{0,13}(?:.|$)|[^&]+)"), 1)
    return F.when(c.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Text outside tags, scripts and styles, a line feed for each paragraph, line break and list item.

    A page is cut before its script and style tags, of which it has few, and each part takes two
    passes.  Where a tag has another "<" in it, such a cut could fall inside one, so such a
    page is taken tag by tag.
    """
    text = F.when(c.rlike("<[^<>]*<"), _by_tags(c)).otherwise(_by_cuts(c))
    return decode_entities(trim_ws(text))


def _by_cuts(c: Column) -> Column:
    marker = f"<{WS}*/?(?i:script|style)[^>]*>"
    parts = F.split(c, f"(?={marker})")
    head = lambda t: ascii_lower(F.regexp_extract(t, f"^<{WS}*(/?(?i:script|style))[^>]*>", 1))

    def shown(t: Column, i: Column, marks: Column) -> Column:
        last = lambda name: F.try_element_at(F.filter(F.slice(marks, 1, i + 1), lambda m: m.endswith(name)), F.lit(-1))
        hidden = F.coalesce(last("script") == "script", F.lit(False)) | F.coalesce(last("style") == "style", F.lit(False))
        # in a script only the tags are left, whose breaks still count
        tags = F.when(hidden & (F.size(marks) > 1), F.regexp_replace(t, "(?<=>)[^<]+", "")).otherwise(t)
        return F.regexp_replace(F.regexp_replace(tags, f"<{WS}*(?i:br|/p|/li|p|li)[^>]*>", "\n"), r"(?s)<[^>]*(?:>|\z)", "")

    return bind(parts, lambda p: bind(F.transform(p, head), lambda marks: F.array_join(F.transform(p, lambda t, i: shown(t, i, marks)), "")))


def _by_tags(c: Column) -> Column:
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(<[^>]*(?:>|$)|[^<]+)"), 1)
    tag = lambda t: ascii_lower(trim_ws(F.regexp_replace(t, "^<|>$", "")))
    closed = lambda t: t.startswith("<") & t.endswith(">")

    def turns(name: str) -> Column:
        """Where such tags stand and whether they open; pages have few of them."""
        marked = F.transform(parts, lambda t, i: F.struct(i.alias("i"), tag(t).startswith(name).alias("open"), (closed(t) & tag(t).rlike(f"^/?{name}")).alias("is")))
        return F.filter(marked, lambda m: m["is"])

    def inside(all_: Column, i: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(all_, lambda m: m["i"] < i), F.lit(-1))["open"], F.lit(False))

    breaks = lambda t: closed(t) & tag(t).rlike("^(?:br|/p|/li|p|li)")
    show = lambda t, i, scripts, styles: F.when(t.startswith("<"), F.when(breaks(t), F.lit("\n")).otherwise("")).when(inside(scripts, i) | inside(styles, i), "").otherwise(t)
    bound = F.struct(parts.alias("parts"), turns("script").alias("scripts"), turns("style").alias("styles"))
    return bind(bound, lambda p: F.array_join(F.transform(p["parts"], lambda t, i: show(t, i, p["scripts"], p["styles"])), ""))


def looks_like_html(c: Column) -> Column:
    """Whether a text has the tags of a page, or any end tag."""
    return bind(ascii_lower(c), lambda low: low.rlike("<(?:html|body|table|div)") | (low.contains("</") & low.contains(">")))
