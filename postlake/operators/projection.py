"""The declarative query over projection rows: filter, sort, limit, facets, graph and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import address_email
from ..functions.text import ascii_lower, display_subject, mentioned_urls

SORTS = {"date_asc": ("date", False), "subject_asc": ("subject", False), "subject_desc": ("subject", True)}


@dataclass
class ProjectionQuery:
    """Empty strings and a limit of None switch a condition off."""

    subject_contains: str = ""
    date_from: str = ""
    date_to: str = ""
    mail_kind: str = ""
    event_kind: str = ""
    lifecycle_kind: str = ""
    sort: str = "date_desc"
    limit: int | None = None


def day(c: Column) -> Column:
    """The first ten characters, nothing of a shorter string."""
    return F.when(F.length(c) >= 10, F.substring(c, 1, 10)).otherwise("")


def apply_query(rows: DataFrame, q: ProjectionQuery) -> DataFrame:
    """Filter, then sort by the string, then limit; of equals the first in the mailbox's order, which ordinal is, comes first."""
    if q.subject_contains:
        rows = rows.where(ascii_lower(F.col("subject")).contains(ascii_lower(F.lit(q.subject_contains))))
    d = day(F.col("date"))
    if q.date_from:
        rows = rows.where((d == "") | (d >= q.date_from))
    if q.date_to:
        rows = rows.where((d == "") | (d <= q.date_to))
    for column, value in (("mail_kinds", q.mail_kind), ("event_kinds", q.event_kind), ("lifecycle_kinds", q.lifecycle_kind)):
        if value:
            rows = rows.where(F.array_contains(column, value))
    by, down = SORTS.get(q.sort, ("date", True))
    rows = rows.orderBy(F.desc(by) if down else F.asc(by), "ordinal")
    return rows if q.limit is None else rows.limit(q.limit)


def facets(rows: DataFrame) -> DataFrame:
    """(facet, value): the sorted distinct kinds that aren't empty."""
    each = [rows.select(F.lit(c).alias("facet"), F.explode(f"{c}s").alias("value")) for c in ("mail_kind", "event_kind", "lifecycle_kind")]
    return each[0].unionByName(each[1]).unionByName(each[2]).where("value <> ''").distinct()


def graph_links(rows: DataFrame, group: str = "thread", layer: str = "all") -> DataFrame:
    """Distinct (source, target, kind); layer core holds threads, people adds participants, all adds URLs and days."""
    key = display_subject(F.col("subject")) if group == "subject" else F.col("thread_id")
    m = F.concat(F.lit("M:"), F.col("message_key"))
    link = lambda s, t, kind: F.struct(s.alias("source"), t.alias("target"), F.lit(kind).alias("kind"))
    found = [F.array(link(F.concat(F.lit("T:"), key), m, "contains"))]
    if layer != "core":
        people = F.filter(F.transform(F.concat("from", "to", "cc"), address_email), lambda a: a != "")
        found.append(F.transform(people, lambda a: link(m, F.concat(F.lit("P:"), a), "participant")))
        if layer != "people":
            found.append(F.transform(mentioned_urls(F.col("reply_text")), lambda u: link(m, F.concat(F.lit("U:"), u), "mentions")))
            dated = F.when(F.length("date") >= 10, F.substring("date", 1, 10)).otherwise(F.col("date"))
            found.append(F.filter(F.array(link(m, F.concat(F.lit("D:"), dated), "dated")), lambda x: x["target"] != "D:"))
    return rows.select(F.explode(F.concat(*found)).alias("x")).select("x.*").distinct()


def graph_nodes(rows: DataFrame, group: str = "thread", layer: str = "all") -> DataFrame:
    """(id, node_type, label, body, snippet); label and body are those of the first row by ordinal.

    First is a min over a struct, which combines before the shuffle; no row order is assumed.
    """
    key = display_subject(F.col("subject")) if group == "subject" else F.col("thread_id")
    none = F.lit(None).cast("string")
    node = lambda i, t, label, body=none: F.struct(i.alias("id"), F.lit(t).alias("node_type"), label.alias("label"), body.alias("body"))
    m = F.concat(F.lit("M:"), F.col("message_key"))
    found = [F.array(node(F.concat(F.lit("T:"), key), "thread", F.col("subject")), node(m, "message", F.col("subject"), F.col("reply_text")))]
    if layer != "core":
        people = F.filter(F.transform(F.concat("from", "to", "cc"), address_email), lambda a: a != "")
        found.append(F.transform(people, lambda a: node(F.concat(F.lit("P:"), a), "person", a)))
        if layer != "people":
            found.append(F.transform(mentioned_urls(F.col("reply_text")), lambda u: node(F.concat(F.lit("U:"), u), "url", u)))
            dated = F.when(F.length("date") >= 10, F.substring("date", 1, 10)).otherwise(F.col("date"))
            found.append(F.filter(F.array(node(F.concat(F.lit("D:"), dated), "date", dated)), lambda x: x["label"] != ""))
    each = rows.select("ordinal", F.explode(F.concat(*found)).alias("x"))
    first = each.groupBy("x.id", "x.node_type").agg(F.min(F.struct("ordinal", "x.label", "x.body")).alias("f"))
    return first.select("id", "node_type", "f.label", "f.body", F.substring("f.body", 1, 240).alias("snippet"))


def stats(rows: DataFrame, group: str = "thread", layer: str = "all") -> DataFrame:
    """One row of counts (R07): one scan gives every row's keys, and distinct keys of either kind are counted."""
    each = _parts(rows, group, layer)
    none = F.lit("").alias("y"), F.lit("").alias("z")
    own = F.array(*(F.struct(F.lit(w).alias("what"), F.col("thread_id").alias("x"), *none) for w in "tr"))
    ids = each.select(F.explode(F.concat(own, "nodes", "links")).alias("e")).select("e.*")
    # rows are counted as they are, the others once each
    once = ids.groupBy("what", "x", "y", "z").agg(F.count("*").alias("c"))
    count = lambda w, c: F.coalesce(F.sum(F.when(F.col("what") == w, c)), F.lit(0)).cast("long")
    return once.agg(count("r", F.col("c")).alias("n_rows"), count("t", F.lit(1)).alias("n_threads"), count("n", F.lit(1)).alias("n_nodes"), count("l", F.lit(1)).alias("n_links"))


def _parts(rows: DataFrame, group: str, layer: str) -> DataFrame:
    """(thread_id, key, message_key, nodes, links): the keys of a row's nodes and links."""
    key = display_subject(F.col("subject")) if group == "subject" else F.col("thread_id")
    item = lambda what, x, y, z: F.struct(F.lit(what).alias("what"), x.alias("x"), y.alias("y"), z.alias("z"))
    m, none = F.concat(F.lit("M:"), "message_key"), F.lit("")
    people = F.array_distinct(F.filter(F.transform(F.concat("from", "to", "cc"), address_email), lambda a: a != ""))
    urls = F.coalesce(mentioned_urls(F.col("reply_text")), F.array().cast("array<string>"))
    days = F.when(F.col("date") != "", F.array(F.substring("date", 1, 10))).otherwise(F.array().cast("array<string>"))
    kinds = [("P:", people, "participant", layer != "core"), ("U:", urls, "mentions", layer == "all"), ("D:", days, "dated", layer == "all")]

    def node(p: str):
        return lambda x: item("n", F.concat(F.lit(p), x), none, none)

    def link(p: str, k: str):
        return lambda x: item("l", m, F.concat(F.lit(p), x), F.lit(k))

    shown = [x for x in kinds if x[3]]
    nodes = F.concat(F.array(item("n", F.concat(F.lit("T:"), key), none, none), item("n", m, none, none)), *(F.transform(xs, node(p)) for p, xs, _, _ in shown))
    links = F.concat(F.array(item("l", F.concat(F.lit("T:"), key), m, F.lit("contains"))), *(F.transform(xs, link(p, k)) for p, xs, k, _ in shown))
    return rows.select("thread_id", key.alias("key"), "message_key", nodes.alias("nodes"), links.alias("links"))


@dataclass
class Dataset:
    rows: DataFrame
    nodes: DataFrame
    links: DataFrame
    facets: DataFrame
    stats: DataFrame


def project(rows: DataFrame, q: ProjectionQuery, group: str = "thread", layer: str = "all") -> Dataset:
    """Everything the query gives, computed after filter and limit."""
    found = apply_query(rows, q)
    by, down = SORTS.get(q.sort, ("date", True))
    # without a limit the order of rows is only a display matter, so a global window would be waste
    if q.limit is not None:
        found = found.withColumn("ordinal", F.row_number().over(Window.orderBy(F.desc(by) if down else F.asc(by), "ordinal")).cast("long"))
    return Dataset(found, graph_nodes(found, group, layer), graph_links(found, group, layer), facets(found), stats(found, group, layer))


def attach_paths(attachments: DataFrame, paths: DataFrame) -> DataFrame:
    """The attachments with the path of their content where they have none yet."""
    found = paths.select("sha256", F.col("path").alias("__path"))
    return attachments.join(found, "sha256", "left").withColumn("path", F.coalesce("path", "__path")).drop("__path")


def distinct_attachments(attachments: DataFrame) -> DataFrame:
    """The first attachment of each content by message and place, empty ones left out."""
    first = Window.partitionBy("sha256").orderBy("message_key", "idx")
    return attachments.where("size > 0").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
