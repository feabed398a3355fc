"""Near-duplicate groups with an LSH forest over MinHash signatures.

1. Every document gets K MinHash values of its three-word shingles (16 low bits of each
   minimum are kept) and a hash of its whole word sequence.  Documents that agree in that
   hash are copies; they collapse to one node of what follows.
2. Every tree of the forest orders the signatures by another permutation of their columns.
   Documents that share the first MIN_DEPTH values of an order form a region, which is
   sorted by the values that follow.  A region of more than REGION documents is split by
   the next value, and again, down to MAX_DEPTH, so the depth adapts to how crowded a part
   of the order is.  The first candidates are each region's members with its first one
   (hubs).  When those are verified, the trees are walked once more: all pairs of a region
   that the hubs haven't joined, and, in regions that are crowded down to MAX_DEPTH and
   between regions that share MIN_DEPTH values, the longest-common-prefix neighbours.
3. A pair whose signatures agree in a share of THRESHOLD - PLAY or more is verified by its
   texts: the Jaccard similarity of their shingle sets must be THRESHOLD.  Groups are the
   connected components of verified pairs.

A pair of similarity THRESHOLD shares the first values of some tree with probability 0.96.

The work is linear in documents times trees: no step lists all pairs of a region of more
than REGION documents, and none drops a document from one.

Rows of a region come sorted and are worked off STREAM at a time: what is kept between is
its hubs and last REGION rows, however many documents a region has.

Defined results: null and empty texts and texts without a word are in no group.  Texts of
one or two words have their word sequence as the only shingle.  Rows with the same doc_id
and text count once; rows that share a doc_id but not the text are documents of their own,
each with its own group and links.  Rows with a null doc_id are in no group.  Of a group the
document with the smallest doc_id (of those that share it, the one with the smallest hash of
its text) is kept.  Very long texts are taken whole; an empty table has no groups.  Other columns
are ignored by near_duplicates() and kept as they are by stage_near_duplicates(); where a row
is there several times with other values in them, the values that come first as JSON stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, among, by_slots, chunks, components, mix, named, prefix, ragged, rows_of, sent_slots, shared_checkpoints, signed, slot_of, spans, table, tidy, words

K = 100
TREES = 33
MIN_DEPTH, MAX_DEPTH = 3, 8
REGION = 32
NEIGHBOURS = 2
THRESHOLD = 0.45  # Jaccard similarity of the shingle sets
PLAY = 0.1  # two standard errors of the signatures' estimate of it
SHINGLE = 3
SALTS = 256
STREAM = 2_000_000  # rows of a region that a task holds, about

_random = np.random.default_rng(20240229)
MULTIPLIERS = _random.integers(1, 1 << 63, K, dtype=U64) * U64(2) + U64(1)
#: The first MIN_DEPTH columns of the trees are spread over the signature; the rest of each order is its own permutation.
ORDERS = [[(t * MIN_DEPTH + i) % K for i in range(MIN_DEPTH)] for t in range(TREES)]
ORDERS = [o + [int(c) for c in np.random.default_rng(t).permutation(K) if c not in o][: MAX_DEPTH - MIN_DEPTH] for t, o in enumerate(ORDERS)]


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, hash of its word sequence, its first shingle, all shingles' hashes) of the texts that have words."""
    w = words(texts)
    count = np.diff(w.bounds)
    some = np.flatnonzero(count)
    sums = prefix(w.hash)
    # a sum of hashes of word and place: polynomials modulo 2**64 have collisions among very long sequences
    place = ragged(np.zeros(len(count), np.int64), count)
    keyed = mix(w.hash ^ mix(place.astype(U64) + U64(1)))
    whole = mix(np.add.reduceat(keyed, w.bounds[some])) if len(some) else np.zeros(0, U64)
    width = np.minimum(count[some], SHINGLE)
    shingles = count[some] - width + 1
    first = np.cumsum(shingles) - shingles
    at = np.arange(int(shingles.sum())) + np.repeat(w.bounds[some] - first, shingles)
    return some, whole, first, spans(sums, at, at + np.repeat(width, shingles))


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, hash of its word sequence, signature as K uint16) of the texts that have words."""
    some, whole, first, hashes = shingle_hashes(texts)
    out = np.empty((len(some), K), np.uint16)
    if len(some):
        for k in range(K):
            low = np.minimum.reduceat(((hashes * MULTIPLIERS[k]) >> U64(32)).astype(np.uint32), first)
            out[:, k] = low & np.uint32(0xFFFF)
    return some, signed(whole), out


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    out = [np.zeros(0, U64)] * len(texts)
    some, _, first, hashes = shingle_hashes(texts)
    for i, own in zip(some.tolist(), np.split(hashes, first[1:]) if len(some) else ()):
        out[i] = np.unique(own)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        some, whole, sig = signatures(batch.column("text"))
        raw = pa.Array.from_buffers(pa.binary(2 * K), len(some), [None, pa.py_buffer(np.ascontiguousarray(sig).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), batch.column("part").take(pa.array(some)), pa.array(whole), raw], names=["doc_id", "part", "whole", "sig"])


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width) if len(column) else np.zeros((0, width), kind)


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key of tree and first values, label of the values that follow, node, root) of every node and tree."""
    for batch in batches:
        sig = _matrix(batch.column("sig"), K, np.uint16)
        for t, order in enumerate(ORDERS):
            key = np.full(len(sig), t + 1, U64)
            for c in order[:MIN_DEPTH]:
                key = key << U64(16) | sig[:, c].astype(U64)
            label = sig[:, order[MIN_DEPTH:]].astype(U64)
            packed = label[:, 0] << U64(48) | label[:, 1] << U64(32) | label[:, 2] << U64(16) | label[:, 3]
            # the sign is flipped so that signed order is the order of the values
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(packed ^ U64(1 << 63))), pa.array(label[:, 4].astype(np.int32)), batch.column("node"), batch.column("root")], names=["key", "label", "last", "node", "root"])


def forest_pairs(key: np.ndarray, label: np.ndarray, last: np.ndarray, doc: np.ndarray, root: np.ndarray, hubs: bool) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of rows sorted by key, label, last: the candidates of step 2, with hubs or of the others that differ in root."""
    some = np.zeros(len(key), np.bool_)
    some[1:] = key[1:] == key[:-1]
    some[:-1] |= some[1:]
    key, label, last, doc, root = (x[some] for x in (key, label, last, doc, root))
    n = len(key)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = key[1:] == key[:-1]
    diff = label[1:].view(U64) ^ label[:-1].view(U64)
    lcp = np.where(same, MIN_DEPTH, 0)
    for k, shift in enumerate((48, 32, 16, 0)):
        lcp = np.where(same & (diff >> U64(shift) == 0), MIN_DEPTH + 1 + k, lcp)
    lcp = np.where(same & (diff == 0) & (last[1:] == last[:-1]), MAX_DEPTH, lcp)
    found = []
    open_ = np.ones(n, np.bool_)
    area, small = np.zeros(n, np.int64), np.zeros(n, np.bool_)
    for depth in range(MIN_DEPTH, MAX_DEPTH + 1):
        region = np.concatenate([[0], np.cumsum(lcp < depth)])
        start = np.flatnonzero(np.concatenate([[True], lcp < depth]))
        size = np.diff(np.append(start, n))
        done = open_ & (size[region] <= REGION) if depth < MAX_DEPTH else open_
        if hubs:
            hub = doc[start][region]
            # a crowded region also keeps a hub at its least depth
            found.append((hub, doc) if depth == MIN_DEPTH else (hub[done], doc[done]))
        area[done], small[done] = depth * n + region[done], size[region[done]] <= REGION
        open_ &= ~done
    for step in range(1, 1 if hubs else min(n, REGION)):
        near = (area[step:] == area[:-step]) & small[step:]
        if step <= NEIGHBOURS:
            near |= key[step:] == key[:-step]
        elif not near.any():
            break
        near &= root[step:] != root[:-step]
        found.append((doc[:-step][near], doc[step:][near]))
    a = np.concatenate([np.minimum(x, y) for x, y in found])
    b = np.concatenate([np.maximum(x, y) for x, y in found])
    keep = a != b
    return a[keep], b[keep]


def _carried(rows: list[np.ndarray]) -> list[np.ndarray]:
    """What the next rows of an open region have to meet: the first row of its last part at every depth, and the last REGION rows."""
    key, label, last = rows[0], rows[1].view(U64), rows[2]
    n = len(key)
    same = key == key[-1]
    first = {int(np.argmax(same))}
    for shift in (48, 32, 16, 0):
        first.add(int(np.argmax(same & (label >> U64(shift) == label[-1] >> U64(shift)))))
    first.add(int(np.argmax(same & (label == label[-1]) & (last == last[-1]))))
    at = np.array(sorted(first | set(range(max(0, n - REGION), n))))
    return [x[at] for x in rows]


def _candidates(batches: Iterator[pa.RecordBatch], hubs: bool, stream: int = STREAM) -> Iterator[pa.RecordBatch]:
    """Candidates of a sorted partition; the rows of the last key wait for the next batch, up to so many."""
    held: list[list[np.ndarray]] = []
    names = ("key", "label", "last", "node", "root")
    load = 0

    def give(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = forest_pairs(*rows, hubs)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.ones(len(a), np.bool_)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], names=["a", "b"])

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(new[0]):
            continue
        load += len(new[0])
        if held and held[-1][0][-1] == new[0][0] == new[0][-1] and load < stream:
            held.append(new)
            continue
        rows = [np.concatenate(x) for x in zip(*held, new)]
        cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
        if cut:
            yield give([x[:cut] for x in rows])
            rows = [x[cut:] for x in rows]
        if len(rows[0]) >= stream:
            yield give(rows)
            rows = _carried(rows)
        held, load = [rows], len(rows[0])
    if held:
        yield give([np.concatenate(x) for x in zip(*held)])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures agree well enough for a look at the texts."""
    for batch in batches:
        if batch.num_rows:
            equal = np.mean(_matrix(batch.column("sa"), K, np.uint16) == _matrix(batch.column("sb"), K, np.uint16), axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(equal >= THRESHOLD - PLAY))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose shingle sets have a Jaccard similarity of THRESHOLD; rows of one a that follow each other share its set."""
    last, one = None, np.zeros(0, U64)
    for batch in chunks(batches, "tb"):
        at, left = batch.column("a").to_numpy(), batch.column("ta")
        keep = np.zeros(batch.num_rows, np.bool_)
        for i, other in enumerate(shingle_sets(batch.column("tb"))):
            if last is None or last != at[i]:
                last = at[i]
                one = shingle_sets(left.slice(i, 1))[0]
            shared = len(np.intersect1d(one, other, assume_unique=True))
            keep[i] = shared and shared >= THRESHOLD * (len(one) + len(other) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def near_duplicate_rows(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, part, group_id, kept, n_links) of every distinct row that has a copy or near copy."""
    shared_checkpoints(spark)
    signed_docs = rows_of(docs).mapInArrow(tidy(_sign), "doc_id bigint, part bigint, whole bigint, sig binary").checkpoint()
    place = F.struct("doc_id", "part")
    # a node for every word sequence, with the first document that has it
    nodes = signed_docs.groupBy(F.col("whole").alias("node")).agg(F.min("sig").alias("sig"), F.min(place).alias("first")).checkpoint()
    sigs = nodes.select("node", "sig")

    def pairs(rows: DataFrame, hubs: bool) -> DataFrame:
        trees = rows.select("node", "sig", "root").mapInArrow(tidy(_orders), "key bigint, label bigint, last int, node bigint, root bigint")
        found = trees.repartition("key").sortWithinPartitions("key", "label", "last", "node").mapInArrow(tidy(lambda batches: _candidates(batches, hubs)), "a bigint, b bigint")
        return found.distinct()

    def verified(p: DataFrame) -> DataFrame:
        left = p.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        both = left.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        alike = both.select("a", "b", "sa", "sb").mapInArrow(tidy(_alike), "a bigint, b bigint").checkpoint()
        # only the texts of nodes in such pairs are shuffled, each once
        some = alike.select(F.col("a").alias("node")).unionByName(alike.select(F.col("b").alias("node"))).distinct()
        ids = nodes.join(some, "node").select("node", F.col("first.doc_id").alias("id"), F.col("first.part").alias("part"))
        rows = among(rows_of(docs), ids, spark).alias("r")
        texts = rows.join(ids.alias("i"), (F.col("r.doc_id") == F.col("i.id")) & (F.col("r.part") == F.col("i.part"))).select("node", "text").repartition("node").dropDuplicates(["node"])
        # a hub of very many is there once for each of SALTS shares of them
        salted = alike.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
        left = salted.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        both = salted.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(left, ["a", "salt"])
        return both.select("a", "b", "ta", "tb").mapInArrow(tidy(_verify), "a bigint, b bigint").distinct().checkpoint()

    first = verified(pairs(nodes.select("node", "sig", F.lit(0).cast("long").alias("root")), True))
    hubs = components(first, spark)
    joined = nodes.select("node", "sig").join(hubs, "node", "left").withColumn("root", F.coalesce("root", "node"))
    edges = first.unionByName(verified(pairs(joined, False))).distinct()
    groups = components(edges, spark)
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    # counts and first documents are gathered by node before they are by group, so no group's rows come together
    members = signed_docs.select("doc_id", "part", F.col("whole").alias("node")).distinct()
    sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.min(place).alias("first")).join(groups, "node", "left").join(ends, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = sizes.groupBy("root").agg(F.sum("n").alias("all"), F.min("first").alias("head")).where(F.col("all") > 1)
    found = sizes.join(heads, "root").select("node", "head", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("int").alias("n_links"))
    return members.join(found, "node").select("doc_id", "part", F.col("head.doc_id").alias("group_id"), (place == F.col("head")).alias("kept"), "n_links")


def near_duplicates(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, group_id, kept, n_links) of every document that has a copy or near copy.

    group_id is the group's smallest doc_id.  n_links counts the document's verified links to
    other word sequences and its copies of the same one.
    """
    return near_duplicate_rows(docs, spark).drop("part")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), spark)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop all documents of each group but the first; rows with the same doc_id and text stay once."""
    plain, names = named(docs)
    rows = plain.withColumns({"id__": F.col(names["doc_id"]).cast("long"), "part__": F.xxhash64(F.col(names["text"]).cast("string"))})
    same = lambda other: (F.col("id__") == other["doc_id"]) & (F.col("part__") == other["part"])
    drop = near_duplicate_rows(docs, spark).where("not kept").select("doc_id", "part").checkpoint()
    again = rows.where("id__ is not null").groupBy(F.col("id__").alias("doc_id"), F.col("part__").alias("part")).count().where("count > 1").select("doc_id", "part").checkpoint()
    # only rows that may be dropped or occur again are shuffled with their texts
    asked = sent_slots(drop.unionByName(again), spark)
    sure, doubt = (by_slots(rows, slot_of(F.col("part__")), asked, there) for there in (False, True))
    kept = doubt.join(drop, same(drop), "left_anti")
    once = kept.join(again, same(again), "left_anti")
    several = kept.join(again, same(again), "left_semi")
    order = Window.partitionBy("id__", "part__").orderBy(F.to_json(F.struct(*plain.columns)))
    several = several.withColumn("rank__", F.row_number().over(order)).where("rank__ = 1").drop("rank__")
    return sure.unionByName(once).unionByName(several).select(*plain.columns).toDF(*docs.columns)
