"""The body that the other operators look at: style sheets, tags and footers taken off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import html_to_text, looks_like_html
from .text import ascii_lower, bind, lines, normalize_text, trim_ws

_SET = r"[A-Za-z0-9\s.,#@:_\-*+>~\[\]()=\"'/;%]"
#: A selector that has a comma, blank, dot or the like inside, begins with @, or is a single name.
_SELECTOR = rf"(?:@{_SET}*|{_SET}*?[.#\[\]*]{_SET}*|{_SET}*?[^\s;,{{}}][, ]+{_SET}*?[^\s;,{{}}]{_SET}*|[;,\s]*[A-Za-z][A-Za-z0-9_-]*[;,\s]*)"
STYLES = rf"^(?:(?=[^{{]{{1,221}}\{{)(?!(?i)[^{{]*https?://)[;,\s]*(?=[^{{;,\s])(?=[^{{]{{1,170}}\{{){_SELECTOR}\{{[^}}<]*:[^}}<]*\}}[\s}};]*+){{1,400}}+"
IMAGE_LINES = "^(?:view image:|follow image link:|caption:)"
STRONG = "unsubscribe|manage preferences|view in browser|mailing list"
FOOTER = rf"{STRONG}|privacy policy|terms|all rights reserved|follow us|(?:facebook|instagram|linkedin|youtube)\.com|(?:x|twitter)\.com/|^https?://"
TAILS = ("this email was intended for", "unsubscribefrom daily digest messages", "visit your settings to manage")


def strip_styles(c: Column) -> Column:
    """Without the style rules that a text begins with, 400 at most."""
    return trim_ws(F.regexp_replace(trim_ws(c), STYLES, ""))


def strip_footer(c: Column) -> Column:
    """Without image captions and the footer of a newsletter; texts of under four lines are only trimmed.

    The footer begins at the first footer line in the last two thirds if it and what follows
    have two such lines and a strong one; later lines have no more of them after them.
    """
    footer = lambda x: x["low"].rlike(FOOTER)

    def cut_lines(all_: Column) -> Column:
        n = F.size(all_)
        first = F.array_position(F.transform(all_, lambda x, i: (i >= F.floor(n / 3)) & footer(x)), True).cast("int")

        def by(first: Column) -> Column:
            rest = F.slice(all_, F.greatest(first, F.lit(1)), n)
            cut = (first > 0) & F.exists(rest, lambda x: x["low"].rlike(STRONG)) & (F.size(F.filter(rest, footer)) >= 2)
            return F.when(cut, F.slice(all_, 1, first - 1)).otherwise(all_)

        return bind(first, by)

    def cut_tail(kept: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda x, i: (i >= F.floor(F.size(kept) / 2)) & x["low"].rlike("|".join(TAILS))), True).cast("int")
        return bind(at, lambda at: F.when(at > 0, F.slice(kept, 1, at - 1)).otherwise(kept))

    def cut_marks(t: Column) -> Column:
        def by(low: Column) -> Column:
            out = t
            for m in reversed(TAILS):
                at = F.instr(low, m)
                out = F.when((at > 0) & (F.octet_length(F.substr(t, F.lit(1), at - 1)) >= F.floor(F.octet_length(t) / 3)), F.substr(t, F.lit(1), at - 1)).otherwise(out)
            return trim_ws(out)

        return bind(ascii_lower(t), by)

    def of(all_: Column) -> Column:
        """all_: struct(line, low) of the lines."""
        plain = lambda some: F.when(F.size(some) > 0, some).otherwise(all_)
        some = bind(F.filter(all_, lambda x: ~x["low"].rlike(IMAGE_LINES)), plain)
        return bind(bind(some, cut_lines), lambda kept: trim_ws(F.array_join(F.transform(cut_tail(kept), lambda x: x["line"]), "\n")))

    def by(all_: Column) -> Column:
        # each line is trimmed and lowered once, for every rule
        read = F.transform(all_, lambda x: F.struct(x.alias("line"), ascii_lower(trim_ws(x)).alias("low")))
        return F.when(F.size(all_) < 4, trim_ws(c)).otherwise(bind(bind(read, of), cut_marks))

    return bind(lines(c), by)


def canonical_body(text: Column, html: Column) -> Column:
    """The text, or else the HTML as text, without styles and footers; empty for neither."""
    has = lambda c: F.coalesce(trim_ws(c) != "", F.lit(False))
    plain = lambda t: strip_footer(F.when(looks_like_html(t), html_to_text(t)).otherwise(t))
    body = F.when(has(text), bind(strip_styles(text), plain)).when(has(html), strip_footer(html_to_text(trim_ws(html)))).otherwise("")
    return bind(bind(body, strip_styles), lambda t: normalize_text(F.when(has(html), strip_footer(t)).otherwise(t)))
