"""Decoding of raw messages: the one step that needs Python for every message.

parse() yields one row a message, or a row with error set; the bytes of attachments stay out of
it and come from attachments(), so that later shuffles don't carry them.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import header_slice, raw_headers

_A = "array<struct<address:string,name:string>>"
_ATT = "array<struct<filename:string,mime_type:string,size:bigint,sha256:string,content_id:string,content_disposition:string>>"
SCHEMA = f"path string, offset bigint, message_id string, in_reply_to string, `references` array<string>, subject string, date string, internal_date string, `from` {_A}, `to` {_A}, cc {_A}, bcc {_A}, reply_to {_A}, body_text string, body_html string, attachments {_ATT}, forwarded array<struct<message_id:string,subject:string,`from`:{_A},date:string>>, date_raw string, headers map<string,string>, error string"


def message_id(s: str) -> str:
    return s.strip().lstrip("<").rstrip(">").strip().lower()


def normalize(address: str) -> str | None:
    a = address.strip().strip("<>,.;").strip().lower()
    at = a.find("@")
    return a if 6 <= len(a.encode()) <= 254 and 0 < at < len(a) - 1 and "." in a[at:] else None


def addresses(msg, name: str) -> list[dict]:
    found = email.utils.getaddresses([str(v) for v in msg.get_all(name, [])])
    return [{"address": a, "name": n.strip() or None} for n, raw in found if (a := normalize(raw))]


def date_of(msg) -> str | None:
    try:
        return email.utils.parsedate_to_datetime(str(msg["date"])).isoformat() if msg["date"] else None
    except (ValueError, TypeError):
        return None


def _ids(msg, name: str) -> list[str]:
    return [i for x in str(msg.get(name, "")).replace(",", " ").split() if (i := message_id(x))]


def decode(raw: bytes) -> tuple[dict, list[tuple[dict, bytes]]]:
    """The fields of a message, and its attachments with their bytes."""
    msg = email.message_from_bytes(raw, policy=email.policy.default)
    text = html = None
    parts, forwarded = [], []
    stack = [msg]
    while stack:
        part = stack.pop()
        kind, how = part.get_content_type(), part.get_content_disposition()
        if kind == "message/rfc822":
            inner = part.get_payload(0)
            forwarded.append({"message_id": next(iter(_ids(inner, "message-id")), None), "subject": str(inner["subject"]) if inner["subject"] else None, "from": addresses(inner, "from"), "date": date_of(inner)})
        elif part.is_multipart():
            stack += reversed(part.get_payload())
        elif kind in ("text/plain", "text/html") and how != "attachment" and (text if kind == "text/plain" else html) is None:
            try:
                body = part.get_content()
            except LookupError:
                body = part.get_payload(decode=True).decode("utf-8", "replace")
            if kind == "text/plain":
                text = body
            else:
                html = body
        elif data := part.get_payload(decode=True):
            parts.append(({"filename": part.get_filename(), "mime_type": kind if part["content-type"] else "application/octet-stream", "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "content_id": (str(part["content-id"]).strip().strip("<>") if part["content-id"] else None), "content_disposition": how}, data))
    fields = {"message_id": next(iter(_ids(msg, "message-id")), None), "in_reply_to": next(iter(_ids(msg, "in-reply-to")), None), "references": _ids(msg, "references"), "subject": str(msg["subject"]) if msg["subject"] else None, "date": date_of(msg)}
    fields |= {k: addresses(msg, k.replace("_", "-")) for k in ("from", "to", "cc", "bcc", "reply_to")}
    return fields | {"body_text": text, "body_html": html, "attachments": [a for a, _ in parts], "forwarded": forwarded}, parts


def parse(raw: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Messages of SCHEMA; internal_date is the date, else the separator's (S05). What can't be decoded has error set, or raises."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                named = dict(row["headers"] or [])
                base = {"path": row["path"], "offset": row["offset"], "headers": list(named.items()), "date_raw": named.get("date")}
                try:
                    fields, _ = decode(row["raw"] or b"")
                    out.append(base | fields | {"internal_date": fields["date"] or row["separator_date"]})
                except Exception as e:
                    if fail_fast:
                        raise
                    out.append(base | {"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in out], schema=schema)

    headers = raw_headers(header_slice(F.decode("raw", "ISO-8859-1"))).alias("headers")
    return raw.select("path", "offset", "separator_date", "raw", headers).mapInArrow(run, SCHEMA)


def headers_only(raw: DataFrame) -> DataFrame:
    """Headers, size and separator date without a look at bodies, all in the JVM."""
    text = F.decode("raw", "ISO-8859-1")
    return raw.select("path", "offset", raw_headers(header_slice(text)).alias("headers"), F.col("size").alias("rfc822_size") if "size" in raw.columns else F.octet_length("raw").cast("long").alias("rfc822_size"), F.col("separator_date").alias("internal_date"))


def attachments(raw: DataFrame) -> DataFrame:
    """(sha256, filename, bytes) of all attachments; deduplicate by sha256 before writing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("raw").to_pylist():
                found = decode(value or b"")[1]
                yield pa.RecordBatch.from_arrays([pa.array([a["sha256"] for a, _ in found], pa.string()), pa.array([a["filename"] for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.binary())], names=["sha256", "filename", "bytes"])

    return raw.select("raw").mapInArrow(run, "sha256 string, filename string, bytes binary")
