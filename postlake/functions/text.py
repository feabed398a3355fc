"""Text expressions: white space, folding, subjects, headers, message ids and escaping.

All are Columns of built-in functions, so they stay inside generated code; null in, null out
unless said otherwise.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space beyond ASCII has to be named: \s alone is ASCII in the JVM's expressions.
WS_CHARS = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CHARS}]"
INVISIBLE = "\u034f\u00ad\ufeff\u200b\u200c\u200d\u2060\u180e\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
SPACES = "\u00a0\u2007\u202f\u2009\u200a"


def bind(value: Column, f) -> Column:
    """f(value) with value made once: inlined, it would be made again at every place where f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    """Without those characters of a regular expression's class at either end."""
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def tokens(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda t: t != "")


def lines(c: Column) -> Column:
    """Lines without their ends; a trailing line feed starts no line."""
    return F.split(F.regexp_replace(F.regexp_replace(c, r"\r\n", "\n"), r"\n\z", ""), "\n")


def _literals(patterns: tuple[str, ...] | list[str]) -> Column:
    """An array of the patterns, of one literal that the optimizer splits: plans with hundreds of literals are slow to make."""
    return F.split(F.lit("\x01".join(patterns)), "\x01") if len(patterns) > 1 else F.array(*map(F.lit, patterns)).cast("array<string>")


def contains_any(c: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """Whether any of the patterns is a substring."""
    return F.exists(_literals(patterns), lambda p: c.contains(p))


def count_of(c: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """How many of the patterns are substrings."""
    return F.size(F.filter(_literals(patterns), lambda p: c.contains(p)))


def keep_first(items: Column) -> Column:
    """An array without later repeats."""
    return F.array_distinct(items)


def normalize_text(c: Column) -> Column:
    """Line ends, invisible characters, runs of blanks and of more than two line feeds put in order."""
    out = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    out = F.translate(out, "\r\u2028\u2029" + SPACES + INVISIBLE, "\n\n\n" + " " * len(SPACES))
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    # runs that are no single blank
    out = F.regexp_replace(out, f" *[{WS_CHARS}&&[^\n ]][{WS_CHARS}&&[^\n]]*|  +", " ")
    return trim_ws(F.replace(out, F.lit(" \n"), F.lit("\n")))


def normalize_line_ends(c: Column) -> Column:
    """Every kind of line end as a line feed."""
    return F.translate(F.regexp_replace(c, r"\r\n", "\n"), "\r\u2028\u2029", "\n\n\n")


def first_nonempty_line(c: Column) -> Column:
    return F.get(F.filter(F.transform(F.split(normalize_line_ends(c), "\n"), trim_ws), lambda x: x != ""), F.lit(0))


def subject_key(c: Column) -> Column:
    """The subject without reply and forward marks, for grouping; null if nothing is left."""
    out = ascii_lower(F.regexp_replace(trim_ws(c), f"{WS}+", " "))
    return blank_to_null(trim_ws(F.regexp_replace(out, r"^(?:(?:re|fwd|fw):\s*)+", "")))


def display_subject(c: Column) -> Column:
    """The subject without those marks, in its own case."""
    out = trim_ws(F.regexp_replace(trim_ws(F.coalesce(c, F.lit(""))), r"^(?i:(?:re|fwd|fw):\s*)+", ""))
    return F.when(out == "", F.lit("(no-subject)")).otherwise(out)


def mentioned_urls(c: Column) -> Column:
    """Sorted distinct words that start like a URL, without closing punctuation."""
    found = F.filter(tokens(c), lambda t: t.startswith("http://") | t.startswith("https://"))
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.regexp_replace(t, r"[.,;:)\]]+$", ""))))


def csv_escape(c: Column) -> Column:
    """A CSV field, quoted where it has to be."""
    return F.when(c.rlike("[\",\n\r]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def html_escape(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def script_json(c: Column) -> Column:
    """JSON that may stand in a script element: no end tag, comment or line separator in it."""
    for raw, code in (("&", "0026"), ("<", "003c"), (">", "003e"), ("\u2028", "2028"), ("\u2029", "2029")):
        c = F.replace(c, F.lit(raw), F.lit("\\u" + code))
    return c


def safe_filename(c: Column) -> Column:
    """At most 120 characters that every file system takes."""
    out = strip_chars(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]", "_"), "._")
    return F.when(out == "", F.lit("attachment")).otherwise(F.substring(out, 1, 120))


def header_slice(c: Column) -> Column:
    """What comes before the first empty line, CRLF searched for first."""
    return F.when(c.contains("\r\n\r\n"), F.substring_index(c, "\r\n\r\n", 1)).otherwise(F.substring_index(c, "\n\n", 1))


def raw_headers(c: Column) -> Column:
    """Unfolded headers by lower-case name; the last of a name counts and empty values are dropped."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\r\n", "\n"), r"(?s)(?:^|\n)[ \t]*\n.*$", "")
    # a continuation of a line that is no header is dropped with that line
    plain = F.regexp_replace(plain, r"(?m)^(?![ \t])[^:\n]*$(?:\n[ \t][^\n]*)*", "")
    unfolded = F.split(F.regexp_replace(plain, r"[ \t]*\n[ \t]+", " "), "\n")
    named = F.filter(unfolded, lambda x: x.contains(":") & ~x.rlike(r"^[ \t]"))
    pairs = F.transform(named, lambda x: F.struct(ascii_lower(trim_ws(F.substring_index(x, ":", 1))).alias("k"), trim_ws(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("v")))
    filled = F.filter(pairs, lambda p: (p["v"] != "") & (p["k"] != ""))
    order = F.transform(filled, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i")))
    last = F.filter(order, lambda p: ~F.exists(order, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
    return F.map_from_arrays(F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"]))


def message_id(c: Column) -> Column:
    """A message id without brackets, in ASCII lower case."""
    out = F.regexp_replace(trim_ws(c), "^<+|>+$", "")
    return ascii_lower(trim_ws(out))


def references(c: Column) -> Column:
    """Ids between white space or commas, in order, repeats kept (M06); an empty array for null."""
    found = F.transform(F.split(F.coalesce(c, F.lit("")), f"[{WS_CHARS},]+"), message_id)
    return F.filter(found, lambda x: x != "")
