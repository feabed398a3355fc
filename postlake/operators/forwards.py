"""Forwarded mail inside bodies: headers in seven languages, the parts of each, and what it forwards in turn.

Each forwarded block holds the next, so one Arrow function walks down; it gives one row for
every level, so nothing downstream recurses.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segmentation import body_parts, capped_salutation, lots, size

SCAN_LINES, LEAST_BYTES, WINDOW = 80, 48, 10
_KEYS = {
    "from": "from de von da van od", "to": "to a à para an aan do", "cc": "cc", "subject": "subject objet betreff asunto oggetto onderwerp temat",
    "date": "date sent envoyé gesendet enviado enviadoel inviato verzonden wysłano", "message_id": "message-id",
}
FIELD = {key: field for field, keys in _KEYS.items() for key in keys.split()}
_ANCHORS = {k for k in FIELD if FIELD[k] in ("date", "subject")} | {"from", "de", "von"}
_HEADS = _ANCHORS | {"to", "cc", "message-id", "para", "da", "van", "od"}
ADDRESS = pa.struct([("address", pa.string()), ("name", pa.string())])
_TEXT, _TEXTS, _ADDRESSES = pa.string(), pa.list_(pa.string()), pa.list_(ADDRESS)
KINDS = {
    "path": _TEXT, "depth": pa.int32(), "from": _ADDRESSES, "to": _ADDRESSES, "cc": _ADDRESSES, "subject": _TEXT, "date": _TEXT, "message_id": _TEXT, "header_lines": _TEXTS, "reply_text": _TEXT, "salutation": _TEXT, "signature": _TEXT,
    "disclaimers": _TEXTS, "quoted": _TEXTS, "forwarded": _TEXTS, "confidence": _TEXT, "has_unparsed_tail": pa.bool_(),
}
_A = "array<struct<address:string,name:string>>"
SCHEMA = f"path string, depth int, `from` {_A}, `to` {_A}, cc {_A}, subject string, date string, message_id string, header_lines array<string>, reply_text string, salutation string, signature string, disclaimers array<string>, quoted array<string>, forwarded array<string>, confidence string, has_unparsed_tail boolean"


def header_line(line: str) -> str:
    """A line without quote marks, blanks before a colon and emphasis around its key."""
    s = re.sub(" +:", ":", re.sub(" +", " ", re.sub(r"^(?:\s*>)+", "", line).strip()))
    for mark in "*_":
        if s.startswith(mark) and ":" in s:
            key, value = s.split(":", 1)
            if key := key.strip().strip(mark).strip():
                return f"{key}:{value.strip().removeprefix(mark).strip()}"
    return s


def key_value(line: str) -> tuple[str, str] | None:
    key, colon, value = header_line(line).partition(":")
    return (key.replace(" ", "").lower(), value.strip()) if colon else None


def address_of(part: str) -> dict | None:
    """'name <address>' or an address alone."""
    s = part.strip()
    inner = re.search(r"(?s)<(.*)>", s)
    e = (inner[1] if inner else s).strip().strip("<>,.;").strip().lower()
    if not (6 <= size(e) <= 254 and re.fullmatch(r"(?s)[^@]+@.*\..*", e)) or e.endswith("@"):
        return None
    name = s.split("<", 1)[0].strip().strip("\"'").strip() if inner else ""
    return {"address": e, "name": name or None}


def addresses(value: str) -> list[dict]:
    """Addresses between commas and semicolons outside quotes and brackets, the first of each."""
    parts = re.findall(r'(?:"[^"]*"?|<[^>]*>?|[^,;"<])+', value)
    out: dict[str, dict] = {}
    for part in parts:
        part = re.sub("mailto:|MAILTO:", "", part)
        found = address_of(part)
        tokens = [] if found else [t.strip("<>()[],;:\"'").lower().strip(".") for t in part.split()]
        for a in [found] if found else [address_of(t) for t in tokens if "@" in t and "." in t]:
            if a:
                out.setdefault(a["address"], a)
    return list(out.values())


def parse_headers(lines: list[str]) -> tuple[dict, int]:
    """(fields and header_lines, line where the body begins) of a forwarded block; fewer than two headers are none."""
    found: dict = {"header_lines": []}
    last, i, end = -1, 0, min(len(lines), SCAN_LINES)
    rule = lambda t: t.startswith(("====", "----"))
    while i < end:
        t = lines[i].strip()
        pair = key_value(t) if t and not rule(t) else None
        field = FIELD.get(pair[0]) if pair else None
        if field is None:
            if len(found["header_lines"]) >= 2:
                break
            i += 1
            continue
        value, to = pair[1], i
        # addresses go on without being indented
        while to + 1 < end and (x := lines[to + 1]).strip() and not rule(x.strip()) and key_value(x) is None and (field in ("from", "to", "cc") or x[0] in " \t"):
            to += 1
            value += " " + x.strip()
        if field in ("from", "to", "cc"):
            value = addresses(value)
        elif field == "message_id":
            value = re.sub("^<+|>+$", "", value).strip().lower()
        if value:
            found[field] = value
        found["header_lines"].append(header_line(t))
        last, i = to, to + 1
    if len(found["header_lines"]) < 2:
        return found, 0
    begin = last + 1
    while begin < len(lines) and not lines[begin].strip():
        begin += 1
    return found, begin


def without_header_bundle(reply: str) -> str:
    """A reply up to the first window of lines that reads like a block of headers."""
    text = reply.strip()
    lines = text.split("\n")
    keys = [_plain_key(line) for line in lines]
    for i in range(len(lines)):
        window = [k for k in keys[i : i + WINDOW] if k in _HEADS]
        if len(window) >= 3 and any(k in _ANCHORS for k in window):
            return "\n".join(lines[:i]).strip()
    return text


def _plain_key(line: str) -> str | None:
    key, colon, _ = re.sub(r"^(?:\s*>)+", "", line).strip().partition(":")
    return key.replace(" ", "").lower() if colon else None


def segments(blocks: list[str]) -> list[dict]:
    """One row for every forwarded block and those inside it; path counts them from 0, level by level."""
    out: list[dict] = []
    todo = [(raw, (i,), frozenset()) for i, raw in enumerate(blocks)][::-1]
    while todo:
        raw, path, above = todo.pop()
        lines = raw.strip().split("\n")
        fields, begin = parse_headers(lines)
        body = "\n".join(lines[begin:]).strip() if begin < len(lines) else raw.strip()
        row = {"path": ".".join(map(str, path)), "depth": len(path) - 1, "reply_text": "", "disclaimers": [], "quoted": [], "forwarded": [], "has_unparsed_tail": False, "from": [], "to": [], "cc": []} | fields
        parts = body_parts_of(body)
        row |= {"reply_text": without_header_bundle(parts["reply"]), "salutation": capped_salutation(parts["salutation"]), "signature": parts["signature"]} | {k: parts[k] for k in ("disclaimers", "quoted", "forwarded")}
        heads = len(row["header_lines"])
        row["confidence"] = "high" if heads >= 2 and row["reply_text"] else "medium" if heads or row["reply_text"] or row["signature"] else "low"
        inner = []
        for x in row["forwarded"]:
            if size(x) < LEAST_BYTES or x in above:
                row["has_unparsed_tail"] = True
            else:
                inner.append((x, (*path, len(inner)), above | {x}))
        out.append(row)
        todo += inner[::-1]
    return out


def body_parts_of(body: str) -> dict:
    """body_parts() without its second look for a footer."""
    parts = body_parts(body)
    blocks = [b for b in parts["blocks"] if b["kind"] == "reply"]
    signature = next((b["text"] for b in parts["blocks"] if b["kind"] == "signature"), None)
    return parts | {"reply": "\n\n".join(b["text"] for b in blocks), "signature": signature}


def forwarded_segments(parts: DataFrame, key: str) -> DataFrame:
    """(key, SCHEMA) of all forwarded segments of segmentation.with_parts()."""
    return _rows_of(parts.select(F.col(key), "forwarded"), key, lambda blocks: segments(blocks or []))


def body_segments(messages: DataFrame, key: str, body: str) -> DataFrame:
    """forwarded_segments() of bodies, cut by the same worker, which gives back none of their other parts."""
    return _rows_of(messages.select(F.col(key), F.col(body).cast("string")), key, lambda text: segments(body_parts(text)["forwarded"]))


def _rows_of(rows: DataFrame, key: str, of: Callable[..., list[dict]]) -> DataFrame:
    """(key, SCHEMA) of what of() makes of the second column, a lot of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches):
            found = [of(x) for x in lot.column(1).to_pylist()]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            flat = [r for x in found for r in x]
            yield pa.RecordBatch.from_arrays([lot.column(0).take(at), *(pa.array([r.get(k) for r in flat], t) for k, t in KINDS.items())], names=[key, *KINDS])

    return rows.mapInArrow(run, f"{key} {rows.dtypes[0][1]}, {SCHEMA}")


def merged_forwards(attached: Column | str, named: Column | str) -> Column:
    """Ids of attached forwards, then those named in bodies that aren't among them."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.concat(F.coalesce(as_column(attached), F.array().cast("array<string>")), F.coalesce(as_column(named), F.array().cast("array<string>"))))
