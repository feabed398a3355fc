"""Dates, places and links of a message's reply, and what kind of event they are of.

Lines are taken in order with a count of those since a marketing heading, so this runs in one
Arrow function; the word lists are the lexicon's.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..lexicon import RESERVATIONS, Lexicon
from .segmentation import _DIGIT, _any, _lower, add_made, size

MONTHS = tuple("dec nov oct sep aug jul jun may apr mar feb jan".split())
DAYS = tuple("sun sat fri thu wed tue mon".split())
ZONES = set("utc gmt cet cest bst pst pdt mst mdt cst cdt est edt".split())
HOSTS = re.compile(r"calendly\.com|webex\.com|zoom\.us|teams\.microsoft\.com|meet\.google\.com")
HEADERS = tuple(f"{k}:" for k in "sent from to cc subject message-id de para asunto enviado envoyé objet von gesendet betreff".split()) + ("enviado el:",)
STREETS, ROOMS = re.compile("drive|lane|boulevard|avenue|road|street"), re.compile("floor|campus|building|unit|suite|room|office|venue")
COUNTRIES = re.compile("uk|united states|usa|switzerland|belgium|netherlands|poland|italy|spain|germany|france|singapore|indonesia")
UNITS = re.compile("[0-9]+(?:mm|cm|km|m|kg|mg|g|lbs|lb|oz|ml|l|bar|psi|kv|v|ma|a|kw|w|db|khz|mhz|ghz|hz|c|f)")
SALES = re.compile("promo|coupon|deal|discount|sale|% off")
NUMBER = re.compile(r"[0-9]*(?:\. |\) )")
EDGES = ",;.:()[]<>\"' \t"
BLOCK = 8
SCHEMA = "kind string, reservation_type string, dates array<struct<raw:string,has_time:boolean>>, locations array<string>, meeting_links array<string>, timezones array<string>, is_complete boolean, missing array<string>, confidence string"
_TEXTS = pa.list_(pa.string())
KINDS = {"kind": pa.string(), "reservation_type": pa.string(), "dates": pa.list_(pa.struct([("raw", pa.string()), ("has_time", pa.bool_())])), "locations": _TEXTS, "meeting_links": _TEXTS, "timezones": _TEXTS, "is_complete": pa.bool_(), "missing": _TEXTS, "confidence": pa.string()}


def _tokens(line: str) -> list[str]:
    return [t.strip(EDGES) for t in line.split()]


def timed(line: str) -> bool:
    return ":" in line and any(re.match("[0-9]+:[0-9]{2}", t) for t in _tokens(line))


def numeric_date(line: str) -> bool:
    marks = [m for m in "-/" if line.count(m) >= 2]
    for t in _tokens(line) if marks else ():
        for mark in marks:
            parts = t.split(mark)
            years = [p for p in parts if len(p) == 4]
            if len(parts) == 3 and all(re.fullmatch("[0-9]+", p) for p in parts) and years and 1900 <= int(years[0]) <= 2100:
                return True
    return False


def month_day(line: str) -> bool:
    low = _lower(line)
    return bool(_DIGIT.search(low)) and _any(low, MONTHS) and any(re.fullmatch("[0-9]{1,2}", t) for t in _tokens(low))


def month_range(line: str) -> bool:
    low = _lower(line)
    return "-" in low and bool(_DIGIT.search(low)) and _any(low, MONTHS) and any(re.fullmatch("[0-9]{1,2}-[0-9]{1,2}", t) for t in _tokens(low))


def explicit(line: str) -> bool:
    """A date that is more than a month and a number."""
    return numeric_date(line) or month_range(line) or (_any(_lower(line), DAYS) and month_day(line))


def is_place(line: str) -> bool:
    low = _lower(line)
    if not 8 <= size(line) <= 120 or "http://" in low or "https://" in low or low.startswith(("*", "#", "- ")) or re.search(r"[\[\]()]", low):
        return False
    digit = bool(re.search("[0-9]", line))
    town = size(line) <= 64 and bool(COUNTRIES.search(low)) and sum(bool(p.strip()) for p in line.split(",")) >= 2 and "," in line
    return (digit and bool(STREETS.search(low) or ROOMS.search(low))) or town


def _noise(line: str, lexicon: Lexicon, counting: int) -> tuple[bool, bool]:
    """(is an entry of a marketing list, is the heading of one)."""
    listed = lambda t: lexicon.finds("event_marketing_list_noise", _lower(t))
    first = line.split()[0]
    heading = (line.startswith("#") or first.isdigit()) and listed(line)
    number = NUMBER.match(line)
    bare = line.lstrip("#-* ")
    item = re.match(r"[0-9]+(?:\. |\) )", bare)
    return heading or bool(number and listed(line[number.end() :])) or bool(counting and item) or (line.startswith(("* ", "- ")) and listed(line)), heading


def event_of(subject: str | None, reply: str | None, mail_kind: str | None, lexicon: Lexicon) -> dict | None:
    """The event hint of a reply, None where no line has a date."""
    text = (reply or "").strip()
    if not _DIGIT.search(text):
        return None
    news = mail_kind in ("newsletter", "promotion")
    dates, places, links, zones = [], [], [], []
    rows = [x for x in (line.strip() for line in text.split("\n")) if x]
    plain = [(x, low) for x in rows if not (low := _lower(x)).startswith(HEADERS)]
    counting = 0
    for line, low in plain:
        digit = bool(_DIGIT.search(line))
        time, shaped = (timed(line), explicit(line)) if digit else (False, False)
        noise, heading = _noise(line, lexicon, counting) if news else (False, False)
        if heading:
            counting = BLOCK
            noise = True
        if digit and (shaped or month_day(line)) and not (size(line) > 180 or (size(line) > 120 and "http" in low)):
            if time or shaped or not (noise or any(len(t) >= 3 and UNITS.fullmatch(t) for t in _tokens(low))):
                dates.append({"raw": line, "has_time": time})
        counting = max(0, counting - 1)
    if not dates:
        return None
    for line, low in plain:
        if re.search("(?:utc|gmt)[+-]", low) or any(t in ZONES for t in _tokens(low)):
            zones.append(line)
        link = next((t for t in _tokens(line) if t.startswith(("http://", "https://")) and HOSTS.search(_lower(t))), None) if "http" in line else None
        if link and link not in links:
            links.append(link)
        if is_place(line) and places[-1:] != [line]:
            places.append(line)
    places = places[:3]
    source = f"{_lower(subject or '')}\n{_lower(text)}"
    has = lambda family: lexicon.finds(f"event_{family}", source)
    short = any(d["has_time"] or size(d["raw"]) <= 96 for d in dates)
    sales = news and bool(SALES.search(source))
    shipping = has("shipping_intent") and short and has("shipping_hard_structure" if news else "shipping_structure")
    if news:
        meeting = bool(links) and short and (has("meeting_intent") or has("meeting_invite_verb"))
    else:
        meeting = has("meeting_intent") and (bool(links) or has("meeting_invite_verb"))
    reservation = has("reservation_intent") and short and not sales
    anchored = lambda: any(timed(x) or explicit(x) for x in rows)
    kind = (
        "shipping" if shipping else "meeting" if meeting else "reservation" if reservation
        else "deadline" if has("deadline") and short
        else "availability" if has("availability") and short and not sales and anchored() else "generic"
    )
    if news and kind == "generic":
        return None
    clock, where = any(d["has_time"] for d in dates), bool(places or links)
    missing = ["location"] * (not where) + ["timezone"] * (clock and not zones)
    of = next((k for k in RESERVATIONS if has(f"reservation_{k}")), "other") if reservation else None
    return {"kind": kind, "reservation_type": of, "dates": dates, "locations": places, "meeting_links": links, "timezones": zones, "is_complete": not missing, "missing": missing, "confidence": "medium" if missing else "high"}


def add_events(messages: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The messages with a struct of SCHEMA as event, null where there is none; messages: subject, reply, mail_kind and others."""
    of = lambda *x: {"event": event_of(*x, lexicon)}
    made = StructType([StructField("event", StructType.fromDDL(SCHEMA))])
    return add_made(messages, made, {"event": pa.struct(list(KINDS.items()))}, of, "subject", "reply", "mail_kind")


def event_hints(messages: DataFrame, key: str, lexicon: Lexicon) -> DataFrame:
    """(key, SCHEMA) of the messages that have an event; messages: key, subject, reply, mail_kind."""
    return add_events(messages.select(F.col(key), "subject", "reply", "mail_kind"), lexicon).where(F.col("event").isNotNull()).select(key, "event.*")
