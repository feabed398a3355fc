"""Bodies cut into salutation, reply, signature, disclaimer, quoted and forwarded blocks.

The rules look back and forth over lines with stops that depend on what was found, so they run
in one Arrow function a batch; everything before and after it is Columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..wordlists import MARKERS

BLOCKS = "array<struct<kind:string,start:int,end:int,text:string>>"
_M = {k: tuple(v.split("|")) for k, v in MARKERS.items()}
_ON = ("on ", "le ", "el ", "am ", "il ", "op ", "w dniu ", "den ", "v ")
_SUBJECTS = ("subject:", "betreff:", "objet:", "oggetto:", "onderwerp:", "temat:")
_SEPARATORS = tuple(x.strip("-").strip() for x in _M["quote_separators"])
_MONTH = re.compile("jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec")
_NAME = re.compile(r"[A-Z][A-Za-z'-]*")
_EDGES = ",;:.()<>[]\"'"
#: Sign-offs that count only as a whole line, and that alone are too short to be one.
_THANKS = {"a+", "cdlt", "cheers", "many thanks", "merci", "merci beaucoup", "thank you", "thanks"}
#: Cues that count as the beginning of a line, and those that count as all of it.
_CUES = tuple(x for x in _M["signature_cues"] if x not in _THANKS and x != "your best") + ("your best,", "your best.") * ("your best" in _M["signature_cues"])
_WHOLE_CUES = {x for x in _M["signature_cues"] if x in _THANKS or x == "your best"}
_PLACE = tuple("usa|ksa|canada|germany|france|city|po box|p.o.box|unit |boulevard|blvd|road|street|avenue".split("|"))
_ORG = tuple("support|technician|engineer|director|manager|company|ltd|sas|gmbh|llc|inc".split("|"))
_IMAGE = ("logo", "[image", "cid:")
_LINKED = ("http://", "https://", "www.")
_TITLE = re.compile("lead|head of|vp|cfo|cto|ceo|coo|consultant|technician|engineer|director|manager")
_CAPITALS = re.compile("[A-Z&/-]{2,}")
_DIGIT = re.compile("[0-9]")
_FOOTER = ("all rights reserved", "copyright", "do not reply", "manage your notification settings", "notification settings", "please do not reply", "unsubscribe")
_FOOTER_LINE = (*_FOOTER, "harap jangan membalas", "manage preferences", "powered by", "view in browser")
SALUTATION_BYTES, SIGNATURE_CHARS = 50, 300


def _lower(s: str) -> str:
    # bytes.lower() is of ASCII letters
    return s.lower() if s.isascii() else s.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _any(low: str, marks: tuple[str, ...]) -> bool:
    return any(m in low for m in marks)


def core(line: str) -> str:
    """The line without quote marks, in ASCII lower case."""
    return _lower((re.sub(r"^(?:\s*>)+", "", line) if ">" in line else line).strip())


def header_core(line: str) -> str:
    """core() without blanks before the colon and without emphasis around a key."""
    c = core(line)
    return re.sub(r"^[*_]*([^:*_]{1,20}?)[*_]*\s*:[*_]*", r"\1:", c) if ":" in c else c


def is_forward(line: str) -> bool:
    c = core(line)
    return c.startswith(_M["forward_markers"]) or "forwarded message" in c


def is_quote(line: str) -> bool:
    t = core(line).strip("-").strip()
    wrote = any(w in t for w in _M["wrote_tokens"]) and (t.endswith(":") or t.endswith(_M["wrote_tokens"]))
    if t.startswith(_SEPARATORS) or (wrote and t.startswith(_ON)):
        return True
    # a key's emphasis goes, what follows stays
    return "sent:" in t and (head := header_core(t)).startswith("from:") and "sent:" in head


def is_starred_name(line: str) -> bool:
    t = line.strip()
    return len(t) > 2 and t[0] == t[-1] == "*" and all(c.isalpha() or c.isspace() or c == "'" for c in t[1:-1])


def size(s: str) -> int:
    """Lengths are in bytes of UTF-8 wherever a rule has a limit."""
    return len(s) if s.isascii() else len(s.encode())


def is_datetime(line: str) -> bool:
    t = line.strip()
    if size(t) > 50 or not (_DIGIT.search(t) or t[4:5] == t[7:8] == "-"):
        return False
    day = month = year = False
    for w in t.split():
        bare = w.strip(",:.;")
        if re.fullmatch("[0-9]{4}", bare):
            year = True
        elif re.fullmatch(r"\+?[0-9]{1,10}", bare):
            day = True
        elif _MONTH.search(w.strip(",:.").lower()):
            month = True
    dated = (day and month and year) or (size(t) == 10 and t[4:5] == t[7:8] == "-")
    clock = any(re.fullmatch("[0-9]+:[0-9]+", w) for w in t.split())
    return dated and (clock or size(t) < 30)


def is_header_key(line: str) -> bool:
    return ":" in line and header_core(line).startswith(_M["header_keys"])


def quote_start(lines: list[str]) -> tuple[int, str] | None:
    """(line, kind) where quoted or forwarded text begins, by the first line that shows it."""
    marks, first = 0, 0
    for i, line in enumerate(lines):
        t = line.strip()
        if not t:
            marks = 0
            continue
        if is_forward(t):
            return i, "forwarded"
        if is_quote(t) or is_starred_name(t) or is_datetime(t):
            return i, "quoted"
        if is_header_key(t) and sum(bool(x.strip()) and is_header_key(x) for x in lines[i : i + 10]) >= 3:
            if any(is_forward(x) for x in lines[max(0, i - 4) : i] if x.strip()):
                return i, "forwarded"
            subject = next((header_core(x).split(":", 1)[1].strip() for x in lines[i : i + 10] if header_core(x).startswith(_SUBJECTS)), "")
            return i, "forwarded" if subject.startswith(("fwd:", "fw:")) else "quoted"
        if t.startswith(">"):
            first = first if marks else i
            marks += 1
            if marks == 2:
                return first, "quoted"
        else:
            marks = 0
    return None


def is_salutation(line: str) -> bool:
    c, raw = core(line), line.strip()
    for p in _M["salutation_prefixes"]:
        if c == p or c.startswith((p + " ", p + ",", p + ":")) or (c.startswith(p) and len(raw) > len(p) and "A" <= raw[len(p)] <= "Z"):
            return True
    return False


def _name_like(line: str) -> bool:
    if size(line.strip()) > 60:
        return False
    words = [w.strip(_EDGES) for w in line.split()]
    return 0 < len(words) <= 4 and all(_NAME.fullmatch(w) for w in words) and (len(words) > 1 or len(words[0]) > 1)


def _title_like(line: str) -> bool:
    t = line.strip()
    words = t.split()
    return 0 < len(words) <= 6 and size(t) <= 48 and (any(_CAPITALS.fullmatch(w.strip(_EDGES)) for w in words) or bool(_TITLE.search(_lower(t))))


def _email_like(line: str) -> bool:
    return "@" in line and any("." in t.split("@", 1)[1] for t in (w.strip(_EDGES) for w in line.split()) if "@" in t)


def _phone_like(line: str) -> bool:
    return any(c in line for c in "+- ") and len(_DIGIT.findall(line)) >= 8


def _strong(line: str) -> bool:
    return _email_like(line) or _phone_like(line) or _any(_lower(line), _LINKED)


def _soft(line: str) -> bool:
    low = _lower(line)
    return any(_any(low, marks) for marks in (_PLACE, _ORG, _IMAGE))


def contact_score(line: str) -> int:
    """Two for an address, number, link or image mark, one for words of places and of organisations or titles."""
    low = _lower(line)
    return 2 * (_email_like(line) + _phone_like(line) + _any(low, _LINKED) + _any(low, _IMAGE)) + _any(low, _PLACE) + _any(low, _ORG)


def _bare(c: str) -> str:
    return c.rstrip(",.;:!").strip()


def _cue(c: str) -> bool:
    """Whether a core line is a sign-off."""
    c = _bare(c)
    return c.startswith(_CUES) or c in _WHOLE_CUES


def _inline(line: str) -> int | None:
    """Where a sign-off begins inside a line."""
    low = _lower(line)
    if " your best" not in low:
        return None
    return next((low.index(m) + 1 for m in (" your best,", " your best.", " your best!", " your best") if m in low), None)


def _sentence(line: str, least: int, words: int) -> bool:
    t = line.strip()
    return size(t) >= least and len(t.split()) >= words and t[-1] in ".!?:"


def _stops(line: str) -> bool:
    t = line.strip()
    return t.startswith(">") or is_starred_name(t) or is_datetime(t) or is_quote(t)


def signature_start(lines: list[str], end: int) -> tuple[tuple[int, int] | None, int | None]:
    """((line, character in it) of the signature, line of the disclaimer) in the text before line end.

    Three passes, each over the last 60 lines with text from the bottom up: scored cues, a
    terminal sign-off of at most four lines, a block of contact lines.  Then sentences before
    a sign-off are given back to the reply, and names and contacts right above are taken in.
    """
    some = [i for i in range(end) if lines[i].strip()]
    text = [lines[i].strip() for i in some]
    cores = [core(t) for t in text]
    n, floor = len(some), max(0, len(some) - 60)
    gap = lambda k: some[k] - some[k - 1] - 1 if k else 0
    # of the last lines only, each judged once though up to eight lines look at it
    strong_, soft_, named_ = ({k: f(text[k]) for k in range(floor, n)} for f in (_strong, _soft, _name_like))
    found = fallback = disclaimer = None
    for k in range(n - 1, floor - 1, -1):
        t, c = text[k], cores[k]
        if _stops(t) or any(f in c for f in _M["footer_cues"]):
            break
        if any(d in c for d in _M["disclaimer_cues"]):
            disclaimer = some[k]
        cue = _cue(c)
        signs = cue or _inline(t) is not None
        marks = (t == "--") + c.startswith(_M["mobile_signature_cues"]) + signs
        below = range(k + 1, min(k + 8, n))
        contact = any(strong_[x] for x in below)
        named = sum(named_[x] for x in below[:2])
        score = 3 * marks + 2 * (gap(k) >= 2) + sum(2 if strong_[x] else soft_[x] for x in below) + named
        strong = bool(marks) or contact
        prose = _sentence(t, 48, 8) and "A" <= t[0] <= "Z"
        score -= 3 * (not contact and prose) + 2 * (not strong and not named) + 2 * (n - k < 3 and not cue)
        if signs and (named or contact or (_bare(c) not in _THANKS and gap(k) >= 1 and n - k <= 4 and not prose)):
            found = k
            break
        if fallback is None and score >= 4 and strong:
            fallback = k
    found = fallback if found is None else found
    if found is None:
        for k in range(n - 1, floor - 1, -1):
            if _stops(text[k]):
                break
            if not _cue(cores[k]) or gap(k) < 1 or n - k > 4:
                continue
            rest = text[k + 1 :]
            if all(_name_like(x) or _title_like(x) or _soft(x) or _strong(x) for x in rest) and not _sentence(text[k], 64, 10) and (rest or _bare(cores[k]) not in _THANKS):
                found = k
                break
    if found is None:
        block = []
        for k in range(n - 1, floor - 1, -1):
            if _stops(text[k]):
                break
            if contact_score(text[k]) or _name_like(text[k]) or _title_like(text[k]) or _cue(cores[k]):
                block.append(k)
            elif block:
                break
        scores = [contact_score(text[k]) for k in block]
        if len(block) >= 3 and sum(scores) >= 3 and sum(_sentence(text[k], 64, 10) for k in block) <= 1 and (gap(block[-1]) >= 1 or any(_strong(text[k]) for k in block)):
            found = block[-1]
    if found is None:
        return None, disclaimer
    plain = lambda k: not (_name_like(text[k]) or _title_like(text[k]) or _soft(text[k]) or _strong(text[k]))
    while found + 1 < n and cores[found] and not _cue(cores[found]) and plain(found) and len(text[found].split()) >= 4 and text[found][-1] in ".!?":
        after = next((k for k in range(found + 1, min(found + 4, n)) if _cue(cores[k]) or not plain(k)), None)
        if after is None or not _cue(cores[after]) or gap(after) < 1:
            break
        found = after
    while found > 0 and not _sentence(text[found - 1], 64, 10):
        c, t = cores[found - 1], text[found - 1]
        if not (c == "--" or "[image]" in c or _cue(c) or not plain(found - 1) or c.startswith("always here to help")):
            break
        found -= 1
    line = some[found]
    return (line, _inline(lines[line]) or 0), disclaimer


def footer_cut(text: str) -> int | None:
    """Where a footer begins in the last two thirds: at its first mark, if two marks or one and a link follow."""
    low = _lower(text)
    third = size(text) // 3
    cuts = [at for m in _FOOTER if (at := low.find(m)) >= 0 and size(text[:at]) > third]
    if not cuts:
        return None
    at = min(cuts)
    marks = sum(m in low[at:] for m in _FOOTER)
    linked = "http://" in low[at:] or "https://" in low[at:]
    return at if (marks >= 2 or (marks and linked)) and size(text[:at].strip()) >= 24 and size(text[at:].strip()) >= 24 else None


def split_footer(reply: str) -> tuple[str, str] | None:
    """(reply, signature) where a reply ends in a footer: by footer_cut(), else by the marks of its last 40 lines."""
    lines = reply.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    if len(lines) < 4:
        return None
    at = footer_cut(reply)
    if at is not None:
        return reply[:at].strip(), reply[at:].strip()
    low = [_lower(x) for x in lines]
    marks = [sum(m in x for m in _FOOTER_LINE) + ("http://" in x or "https://" in x) for x in low]
    for i in range(max(0, len(lines) - 40), len(lines)):
        if not (sum(marks[i:]) >= 2 and 2 <= sum(bool(x.strip()) for x in lines[i:]) <= 24):
            continue
        head, tail = "\n".join(lines[:i]).strip(), "\n".join(lines[i:]).strip()
        if size(head) >= 24 and size(tail) >= 24:
            return head, tail
    return None


def segment(text: str | None) -> list[dict]:
    """Blocks in order; start and end count characters of the text.  Null and blank texts have none."""
    if not text or not text.strip():
        return []
    lines = text.split("\n")
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x) + 1)
    quote = quote_start(lines)
    end = quote[0] if quote else len(lines)
    head = [i for i in range(end) if lines[i].strip()][:6]
    hello = next((i for i in head if is_salutation(lines[i])), None)
    sign, line = signature_start(lines, end)
    limit = min(at[end], len(text))
    signature = None if sign is None else at[sign[0]] + sign[1]
    disclaimer = None if line is None else at[line]
    if signature is not None and disclaimer is not None and disclaimer < signature:
        disclaimer = None
    if signature is None:
        signature = footer_cut(text[: limit if disclaimer is None else disclaimer])
    start = 0 if hello is None else at[hello] + len(lines[hello])
    stop = next((x for x in (signature, disclaimer) if x is not None), limit)
    marks = [("salutation", at[hello], start)] if hello is not None else []
    marks.append(("reply", start, stop))
    if signature is not None:
        marks.append(("signature", signature, limit if disclaimer is None else disclaimer))
    if disclaimer is not None:
        marks.append(("disclaimer", disclaimer, limit))
    if quote:
        marks.append((quote[1], at[quote[0]], len(text)))
    out = []
    for kind, s, e in marks:
        body = text[s:e]
        if body.strip():
            s += len(body) - len(body.lstrip())
            out.append({"kind": kind, "start": s, "end": s + len(body.strip()), "text": body.strip()})
    return out


def capped_salutation(s: str | None) -> str | None:
    """At most 50 characters of a longer one, up to the first mark of punctuation after the fourth."""
    if s is None or size(s) <= SALUTATION_BYTES:
        return s
    return s[: next((i + 1 for i, c in enumerate(s[:50]) if i > 3 and c in ",.!?;:"), 50)]


def capped_signature(s: str | None) -> str | None:
    """At most 300 characters of a longer one, in whole lines if it has several."""
    if s is None or size(s) <= SIGNATURE_CHARS:
        return s
    cut = s[:SIGNATURE_CHARS]
    return cut[: cut.rindex("\n")] if "\n" in cut else cut


def body_parts(text: str | None) -> dict:
    """The blocks of a body by kind, with the reply's footer as signature where there is none."""
    blocks = segment(text)
    of = lambda kind: [b["text"] for b in blocks if b["kind"] == kind]
    reply, signature = "\n\n".join(of("reply")), next(iter(of("signature")), None)
    if signature is None and (split := split_footer(reply)):
        reply, signature = split
    return {"salutation": next(iter(of("salutation")), None), "reply": reply, "signature": signature, "disclaimers": of("disclaimer"), "quoted": of("quoted"), "forwarded": of("forwarded"), "blocks": blocks}


def with_blocks(messages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, blocks) of every message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([segment(t) for t in batch.column(1).to_pylist()], kind)], names=[key, "blocks"])

    rows = messages.select(F.col(key), F.col(body).cast("string"))
    return rows.mapInArrow(run, f"{key} {rows.dtypes[0][1]}, blocks {BLOCKS}")


PARTS = f"salutation string, reply string, signature string, disclaimers array<string>, quoted array<string>, forwarded array<string>, blocks {BLOCKS}"
_TEXTS, _BLOCK = pa.list_(pa.string()), pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
KINDS = {"salutation": pa.string(), "reply": pa.string(), "signature": pa.string(), "disclaimers": _TEXTS, "quoted": _TEXTS, "forwarded": _TEXTS, "blocks": pa.list_(_BLOCK)}
LOT = 256  # rows that a worker holds the results of


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in lots of LOT rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, LOT):
            yield batch.slice(at, LOT)


def add_made(messages: DataFrame, made: StructType, kinds: dict[str, pa.DataType], of: Callable[..., dict], *given: str) -> DataFrame:
    """The messages with the columns that of() makes of the given ones; the others pass through, so nothing is joined."""
    names, places = messages.columns, [messages.columns.index(c) for c in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches):
            found = [of(*x) for x in zip(*(lot.column(i).to_pylist() for i in places), strict=True)]
            yield pa.RecordBatch.from_arrays([*lot.columns, *(pa.array([f[k] for f in found], t) for k, t in kinds.items())], names=[*names, *kinds])

    return messages.mapInArrow(run, StructType([*messages.schema.fields, *made.fields]))


def add_parts(messages: DataFrame, body: str, *parts: str) -> DataFrame:
    """The messages with those parts of their bodies, or all of them."""
    parts = parts or tuple(KINDS)
    made = StructType.fromDDL(PARTS)
    return add_made(messages, StructType([made[k] for k in parts]), {k: KINDS[k] for k in parts}, body_parts, body)


def with_parts(messages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, salutation, reply, signature, disclaimers, quoted, forwarded, blocks) of every message."""
    return add_parts(messages.select(F.col(key), F.col(body).cast("string").alias("text")), "text").select(key, *KINDS)


def salutation_cap(c: Column) -> Column:
    """capped_salutation() as a Column."""
    head = F.substring(c, 1, 50)
    cut = F.regexp_extract(head, r"(?s)^(.{4}[^,.!?;:]*[,.!?;:])", 1)
    return F.when(F.octet_length(c) <= SALUTATION_BYTES, c).when(cut != "", cut).otherwise(head)


def signature_cap(c: Column) -> Column:
    """capped_signature() as a Column."""
    head = F.substring(c, 1, SIGNATURE_CHARS)
    return F.when(F.octet_length(c) <= SIGNATURE_CHARS, c).when(head.contains("\n"), F.regexp_replace(head, r"(?s)\n[^\n]*\z", "")).otherwise(head)


def reply_text(blocks: Column) -> Column:
    """The reply blocks with blank lines between."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["kind"] == "reply"), lambda b: b["text"]), "\n\n")


def first_block(blocks: Column, kind: str) -> Column:
    return F.get(F.filter(blocks, lambda b: b["kind"] == kind), F.lit(0))["text"]


def forwarded_ids(blocks: Column) -> Column:
    """Message ids named in forwarded blocks, first occurrences."""
    from ..functions.text import message_id

    text = F.array_join(F.transform(F.filter(blocks, lambda b: b["kind"] == "forwarded"), lambda b: b["text"]), "\n")
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^[> *]*message-id:\s*(\S{10,})"), 1), message_id))
