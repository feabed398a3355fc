"""Everything that is found in a message, in the order of its stages.

Decoding is one Arrow function; canonical bodies are Columns; segmentation, forwards and events
are Arrow functions that take a body or reply alone; the hints are Columns.  No stage shuffles.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bodies import canonical_body
from ..lexicon import Lexicon, default_lexicon
from ..sources import mime
from . import contacts, events, forwards, hints, segmentation


def bound(df: DataFrame, **made: Column) -> DataFrame:
    """df with columns that are made once: a generator keeps them from being put in the place of every use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


@F.pandas_udf(segmentation.PARTS)
def parts(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([segmentation.body_parts(t) for t in body], columns=["salutation", "reply", "signature", "disclaimers", "quoted", "forwarded", "blocks"])


@F.pandas_udf(f"array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in forwards.SCHEMA.split(', '))}>>")
def segments(blocks: pd.Series) -> pd.Series:
    return pd.Series([[{k: r.get(k) for k in forwards.KINDS} for r in forwards.segments(list(x))] if x is not None else [] for x in blocks], dtype=object)


def event(subject: Column, reply: Column, kind: Column, lexicon: Lexicon) -> Column:
    names = list(events.KINDS)

    @F.pandas_udf(events.SCHEMA)
    def run(subject: pd.Series, reply: pd.Series, kind: pd.Series) -> pd.DataFrame:
        found = [events.event_of(s, r, k, lexicon) or {} for s, r, k in zip(subject, reply, kind)]
        return pd.DataFrame([{n: e.get(n) for n in names} for e in found], columns=names)

    return run(subject, reply, kind)


def analyse(raw: DataFrame, lexicon: Lexicon | None = None, owners: list[str] | None = None, fail_fast: bool = False) -> DataFrame:
    """Messages of mime.parse() with body, parts of it, and all hints; a message that can't be decoded has only error.

    The gate of lifecycle hints goes by the provisional kind, mail_kind by those hints too.
    """
    lexicon = lexicon or default_lexicon()
    df = bound(mime.parse(raw, fail_fast), body=canonical_body(F.col("body_text"), F.col("body_html")))
    df = df.withColumn("parts", parts("body")).select("*", "parts.salutation", F.col("parts.reply").alias("reply_text"), "parts.signature", "parts.blocks")
    ids = F.transform("forwarded", lambda x: x["message_id"])
    df = df.withColumns({"forwarded_ids": forwards.merged_forwards(F.filter(ids, lambda x: x.isNotNull()), segmentation.forwarded_ids(F.col("blocks"))), "forwarded_segments": segments("parts.forwarded")})
    df = bound(df, signature_entities=contacts.signature_entities(F.col("signature")), signals=hints.mail_kind_signals(F.col("subject"), F.col("body"), F.col("headers")))
    people = {k: F.col(k) for k in ("from", "to", "cc", "bcc", "reply_to")}
    df = bound(df, contact_hints=contacts.contact_hints(people, F.col("salutation"), F.col("signature_entities")), provisional=hints.mail_kind(hints.scores_of(F.col("signals"))))
    df = df.withColumn("event_hint", event(F.col("subject"), F.col("reply_text"), F.col("provisional.kind"), lexicon))
    first = F.get("from", F.lit(0))["address"]
    df = bound(df, lifecycle=hints.lifecycle(F.col("subject"), F.col("body"), F.col("headers"), hints.lifecycle_gate(F.col("provisional.kind")), lexicon, first))
    emails = lambda *names: F.transform(F.concat(*names), lambda a: a["address"])
    return df.withColumns({
        "event_hint": F.when(F.col("event_hint.kind").isNotNull(), F.col("event_hint")),
        "mail_kind": hints.mail_kind(hints.scores_of(F.col("signals"), F.col("lifecycle.confidence") == "high")),
        "unsubscribe_hints": hints.unsubscribe(F.col("headers"), F.col("body")), "billing_actions": hints.billing_actions(F.col("body"), lexicon, F.col("lifecycle.kind")),
        "attachment_hints": F.transform("attachments", hints.attachment_hint), "direction": hints.direction(emails("from", "reply_to"), emails("to", "cc", "bcc"), owners or []),
    }).drop("parts", "signals", "provisional")
