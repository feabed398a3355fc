"""Thread keys, grouping, de-duplication and reply trees over message tables.

A message table has message_id, in_reply_to, references (array), subject, date, internal_date,
uid, body and participants (array of addresses); other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, message_id, subject_key, trim_ws


def short_hash(root: Column) -> Column:
    """The first 16 hex digits of the id's SHA-256."""
    return F.substring(F.sha2(message_id(root), 256), 1, 16)


def participants_key(addresses: Column) -> Column:
    found = F.filter(F.transform(addresses, lambda a: ascii_lower(trim_ws(a))), lambda a: a != "")
    return F.array_join(F.array_sort(F.array_distinct(found)), ",")


def fallback_id(subject: Column, date: Column, senders: Column, body: Column) -> Column:
    """An id made of what a message without one has."""
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("fallback:"), F.sha2(F.concat(none(subject), none(date), none(F.array_join(senders, "")), F.substring(none(body), 1, 512)), 256))


def root_id(m: Column | None = None) -> Column:
    """First reference, else the message replied to, else the own id, else subject and participants."""
    some = lambda c: F.when(trim_ws(c) != "", c)
    key, people = subject_key(F.col("subject")), F.nullif(participants_key(F.col("participants")), F.lit(""))
    weak = F.coalesce(F.concat(F.lit("subject:"), key, F.lit("|participants:"), people), F.concat(F.lit("subject:"), key))
    own = some(F.col("message_id"))
    return F.coalesce(some(F.get("references", F.lit(0))), some(F.col("in_reply_to")), own, weak, fallback_id(F.col("subject"), F.col("date"), F.col("senders"), F.col("body")))


def with_keys(messages: DataFrame) -> DataFrame:
    """Adds message_key, thread_id and ts, the milliseconds messages are ordered by."""
    own = F.coalesce(F.when(trim_ws(F.col("message_id")) != "", F.col("message_id")), fallback_id(F.col("subject"), F.col("date"), F.col("senders"), F.col("body")))
    millis = lambda c: F.unix_millis(F.try_to_timestamp(F.col(c)))
    return messages.withColumns({"message_key": short_hash(own), "thread_id": short_hash(root_id()), "ts": F.coalesce(millis("date"), millis("internal_date"), F.lit(0).cast("long"))})


def threads(keyed: DataFrame) -> DataFrame:
    """One row a thread: its messages in order, first and latest time."""
    m = F.struct("ts", F.coalesce("uid", F.lit(0).cast("long")).alias("uid"), "message_key")
    return keyed.groupBy("thread_id").agg(F.array_sort(F.collect_list(m)).alias("messages"), F.max("ts").alias("latest"), F.count("*").alias("n"))


def account_threads(keyed: DataFrame) -> DataFrame:
    """One row for every thread of an account, over all mailboxes that share it."""
    m = F.struct("ts", F.coalesce("uid", F.lit(0).cast("long")).alias("uid"), "message_key")
    return keyed.groupBy("account_id", "thread_id").agg(F.array_sort(F.collect_set("mailbox")).alias("mailboxes"), F.array_sort(F.collect_list(m)).alias("messages"), F.max("ts").alias("latest"), F.count("*").alias("n"))


def with_gmail(messages: DataFrame, fetched: DataFrame) -> DataFrame:
    """Messages with the thread id and labels of a second fetch by uid; own labels stay where it has none."""
    found = fetched.select(F.col("uid").alias("uid__"), F.col("thrid").alias("thrid__"), F.col("labels").alias("labels__"))
    both = messages.join(found, F.col("uid") == F.col("uid__"), "left")
    labels = F.when(F.size(F.coalesce("labels__", F.array().cast("array<string>"))) > 0, F.col("labels__")).otherwise(F.col("labels"))
    return both.withColumns({"thrid": F.coalesce("thrid__", "thrid"), "labels": labels}).drop("uid__", "thrid__", "labels__")


def newest_threads(keyed: DataFrame, n: int) -> DataFrame:
    """The messages of the n threads with the latest message, of equals those of the greater id."""
    top = keyed.groupBy("thread_id").agg(F.max("ts").alias("latest")).orderBy(F.desc("latest"), F.desc("thread_id")).limit(n)
    return keyed.join(top.select("thread_id"), "thread_id", "left_semi")


def dedupe(messages: DataFrame) -> DataFrame:
    """First message of each id in the order of path and idx; messages without an id stay.

    Rows without an id never meet in one partition: each has a key of its own.
    """
    mid = F.nullif(message_id(F.col("message_id")), F.lit(""))
    key = F.coalesce(mid, F.concat(F.lit("\x00"), F.col("path"), F.lit("\x00"), F.col("idx").cast("string")))
    first = Window.partitionBy("__key").orderBy("path", "idx")
    return messages.withColumn("__key", key).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__key", "__n")


def parents(keyed: DataFrame) -> DataFrame:
    """(thread_id, message_key, parent_key): in_reply_to if the thread has it, else the last reference it has.

    Of messages that share an id the last in order is the parent.
    """
    mid = message_id(F.col("message_id"))
    ids = keyed.where(mid != "").groupBy("thread_id", mid.alias("ref")).agg(F.max(F.struct("ts", "uid", "message_key")).alias("p"))
    ids = ids.select("thread_id", "ref", F.col("p.message_key").alias("found"))
    wanted = F.filter(F.concat(F.coalesce("references", F.array().cast("array<string>")), F.array(F.coalesce("in_reply_to", F.lit("")))), lambda r: message_id(r) != "")
    calls = keyed.select("thread_id", "message_key", F.posexplode(F.transform(wanted, message_id)).alias("pos", "ref"))
    hits = calls.join(ids, ["thread_id", "ref"]).where("found <> message_key").groupBy("thread_id", "message_key").agg(F.max_by("found", "pos").alias("parent_key"))
    return keyed.select("thread_id", "message_key", "ts", "uid").join(hits, ["thread_id", "message_key"], "left")


def reply_tree(linked: DataFrame) -> DataFrame:
    """(thread_id, message_key, parent_key, depth, is_root, is_orphan) of parents().

    A thread's nodes are walked in one row of that thread's keys, without the messages: about
    100 bytes a message, so that a thread of ten million messages takes a worker 1 GB.
    The root is the first without a parent, the others are orphans; of a cycle the first
    message in order is an orphan whose parent is cut.
    """
    schema = "thread_id string, message_key string, parent_key string, depth int, is_root boolean, is_orphan boolean"
    rows = linked.groupBy("thread_id").agg(F.array_sort(F.collect_set(F.struct("ts", "uid", "message_key", "parent_key"))).alias("m"))

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for thread, m in zip(batch.column("thread_id").to_pylist(), batch.column("m").to_pylist()):
                order = list(dict.fromkeys(x["message_key"] for x in m))
                parent = {x["message_key"]: x["parent_key"] for x in m}
                children: dict[str, list[str]] = {}
                for k in order:
                    if parent[k]:
                        children.setdefault(parent[k], []).append(k)
                seen: set[str] = set()
                first = True
                for top in [k for k in order if not parent[k]] + order:
                    if top in seen:
                        continue
                    seen.add(top)
                    out.append((thread, top, None, 0, first, not first))
                    first = False
                    todo = [(top, 0)]
                    while todo:
                        node, depth = todo.pop()
                        for c in children.get(node, ()):
                            if c not in seen:
                                seen.add(c)
                                out.append((thread, c, node, depth + 1, False, False))
                                todo.append((c, depth + 1))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["thread_id", "message_key", "parent_key", "depth", "is_root", "is_orphan"])

    return rows.mapInArrow(walk, schema)


def expunged(known: DataFrame, current: DataFrame) -> DataFrame:
    """uids that are known but no longer there."""
    return known.select("uid").distinct().join(current.select("uid"), "uid", "left_anti")
