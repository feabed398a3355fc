"""Winnowed anchors and the grouping of their occurrences, shared by the two substring operators.

A window is T successive words.  The anchor of a window is the k-gram of least hash in it
(the leftmost of equals), so equal windows have equal anchors at equal offsets wherever they
stand.  The windows of a document that have the same anchor occurrence are neighbours; they
make one row with that anchor's hash and the hash of the context that they span together.
Any two equal windows therefore meet in the group of their anchor, and rows of equal context
agree in all their windows without a look at the words.

A document is a distinct pair of doc_id and text: part, a hash of the text, tells rows that
share a doc_id apart.  Places are ordered by doc_id, part, position.

Hot groups: every task remembers contexts that it has met (Combiner).  Of a context's
occurrences in a task at most a few are shuffled; the others are settled there as copies of
the earlier one and go anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, among, chunks, docs_of, prefix, signed, spans, tidy, words

T = 50  # words of a window: the length from which a repeat counts
GRAM = 25
POSITION_BITS = U64(28)
CACHE_BITS = 18  # contexts that a task remembers, in bits
SEEDS = "settled boolean, anchor bigint, context bigint, doc_id bigint, part int, start int, windows int, source bigint, source_part int, source_start int"
FIRST, COPY, EDGE, SETTLED = 0, 1, 2, 3


def part_of(text: Column) -> Column:
    return F.shiftright(F.xxhash64(text), 33).cast("int")


def parted(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text) of the rows that can have repeats."""
    return docs_of(docs).where("doc_id is not null and text is not null").select("doc_id", part_of(F.col("text")).alias("part"), "text")


def anchors(texts: pa.Array, t: int = T, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, context, text index, start, windows) of all texts, starts counted in words of the text."""
    w = words(texts)
    n, none = len(w.hash), np.zeros(0, np.int64)
    count = np.diff(w.bounds)
    long = np.flatnonzero(count >= t)
    if not len(long):
        return (none,) * 5
    sums = prefix(w.hash)
    pos = np.arange(n - gram + 1)
    grams = spans(sums, pos, pos + gram)
    low = (grams >> POSITION_BITS << POSITION_BITS) | pos.astype(U64)
    width, need = 1, t - gram + 1
    while width * 2 <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if need > width:
        low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
    lengths = count[long] - t + 1
    doc = np.repeat(long, lengths)
    at = np.arange(int(lengths.sum())) + np.repeat(w.bounds[long] - (np.cumsum(lengths) - lengths), lengths)
    chosen = (low[at] & ((U64(1) << POSITION_BITS) - U64(1))).astype(np.int64)
    new = np.ones(len(at), np.bool_)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    m = np.diff(np.append(first, len(at)))
    start = at[first]
    context = spans(sums, start, start + m - 1 + t)
    return signed(grams[chosen[first]]), signed(context), doc[first], start - w.bounds[doc[first]], m


def later(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether the places (doc, part, start) of one come after those of the other."""
    (a, b, c), (x, y, z) = one, other
    return (a > x) | ((a == x) & ((b > y) | ((b == y) & (c > z))))


class Combiner:
    """Settles occurrences of keys that a task has met, in bounded memory.

    The first occurrence of a key and the first one after it go on, so that the task that
    gathers the key sees that there is a copy.  What comes after a remembered place is a copy
    of it.  A key that has lost its slot to another goes on once more; nothing is dropped.
    """

    def __init__(self) -> None:
        size = 1 << CACHE_BITS
        self.key, self.doc, self.part, self.start = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.state = np.zeros(size, np.int8)  # 0 empty, 1 met once, 2 met again

    def __call__(self, key: np.ndarray, doc: np.ndarray, part: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """(order of the rows, settled, source doc, part and start of the settled), the last four in that order."""
        order = np.lexsort((start, part, doc, key))
        key, doc, part, start = key[order], doc[order], part[order], start[order]
        n = len(key)
        new = np.ones(n, np.bool_)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        other = new.copy()  # a place of its own, not a repeated row
        other[1:] |= (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1])
        place = np.cumsum(other)
        rank = place - place[first][run]
        head = key[first], doc[first], part[first], start[first]
        slot = (head[0].view(U64) >> U64(64 - CACHE_BITS)).astype(np.int64)
        met = (self.state[slot] > 0) & (self.key[slot] == head[0])
        kept = self.doc[slot], self.part[slot], self.start[slot]
        earlier = met & later(head[1:], kept)
        # a row that equals the remembered place is the same row again and goes on
        source = [np.where(earlier, a, b) for a, b in zip(kept, head[1:])]
        goes = np.where(earlier, np.where(self.state[slot] == 2, 0, 1), 2)
        settled = (rank >= goes[run]) & later((doc, part, start), tuple(x[run] for x in source))
        again = (met & ((self.state[slot] == 2) | earlier | later(kept, head[1:]))) | (np.maximum.reduceat(rank, first) > 0)
        self.key[slot], self.doc[slot], self.part[slot], self.start[slot] = head[0], *source
        self.state[slot] = np.where(again, 2, 1)
        return order, settled, *(x[run] for x in source)


def _seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    combine = Combiner()
    for batch in chunks(batches):
        anchor, context, row, start, m = anchors(batch.column("text"))
        if not len(row):
            continue
        doc, part = batch.column("doc_id").to_numpy()[row], batch.column("part").to_numpy()[row]
        order, settled, *source = combine(context, doc, part, start)
        columns = [settled, anchor[order], context[order], doc[order], part[order], start[order].astype(np.int32), m[order].astype(np.int32), source[0], source[1].astype(np.int32), source[2].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["settled", "anchor", "context", "doc_id", "part", "start", "windows", "source", "source_part", "source_start"])


def seeds(docs: DataFrame) -> DataFrame:
    return parted(docs).mapInArrow(tidy(_seed), SEEDS)


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts out rows that come ordered by settled, anchor, context, place.

    Of each context the first row is the representative and the others are copies of it.  A
    representative whose anchor has other contexts too is an edge, whose windows have to be
    compared one by one (dup: it has copies); else it is a first occurrence if it has
    copies, and unique if not.  Between batches only two rows and a flag are kept, however
    many occurrences an anchor has.
    """
    names = ["anchor", "context", "doc_id", "part", "start", "windows"]
    tail: list[np.ndarray] | None = None
    crowded = False  # the tail's anchor has had other contexts

    def emit(rows: list[np.ndarray], kind: np.ndarray, dup: np.ndarray, source: list[np.ndarray], pick: np.ndarray) -> pa.RecordBatch:
        columns = [kind.astype(np.int32), rows[2], rows[3].astype(np.int32), rows[4].astype(np.int32), rows[5].astype(np.int32), rows[0], dup, source[0], source[1].astype(np.int32), source[2].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c[pick]) for c in columns], names=["kind", "doc_id", "part", "start", "windows", "anchor", "dup", "source", "source_part", "source_start"])

    def sort_out(rows: list[np.ndarray], crowded: bool, last: bool) -> tuple[pa.RecordBatch, list[np.ndarray] | None, bool]:
        anchor, context, doc, part, start, _ = rows
        n = len(anchor)
        new_anchor, new, same = np.ones(n, np.bool_), np.ones(n, np.bool_), np.zeros(n, np.bool_)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new[1:] = new_anchor[1:] | (context[1:] != context[:-1])
        same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (part[1:] == part[:-1]) & (start[1:] == start[:-1])
        if same.any():
            keep = ~same
            rows, new_anchor, new = [x[keep] for x in rows], new_anchor[keep], new[keep]
            n = len(new)
        group = np.cumsum(new_anchor) - 1
        contexts = np.bincount(group[new])
        contexts[0] += crowded
        run = np.cumsum(new) - 1
        many = np.bincount(run)[run] > 1
        edge = new & (contexts[group] > 1)
        kind = np.where(~new, COPY, np.where(edge, EDGE, FIRST))
        pick = ~new | edge | many
        head = np.flatnonzero(new)[run]
        source = [rows[k][head] for k in (2, 3, 4)]
        if last:
            return emit(rows, kind, many, source, pick), None, False
        cut = int(np.flatnonzero(new)[-1])
        pick[cut : cut + 2] = False
        return emit(rows, kind, many, source, pick), [x[cut : cut + 2] for x in rows], bool(contexts[group[cut]] > 1)

    for batch in batches:
        done = batch.column("settled")
        if done.true_count:
            some = batch.filter(done)
            rows = [some.column(c).to_numpy() for c in names]
            yield emit(rows, np.full(len(rows[0]), SETTLED), np.zeros(len(rows[0]), np.bool_), [some.column(c).to_numpy() for c in ("source", "source_part", "source_start")], np.ones(len(rows[0]), np.bool_))
            batch = batch.filter(pc.invert(done))
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in names]
        if tail is not None:
            rows = [np.concatenate(x) for x in zip(tail, rows)]
        out, tail, crowded = sort_out(rows, crowded, False)
        yield out
    if tail is not None:
        yield sort_out(tail, crowded, True)[0]


SORTED = "kind int, doc_id bigint, part int, start int, windows int, anchor bigint, dup boolean, source bigint, source_part int, source_start int"


def spread(key: str) -> Column:
    """Where a row goes: to the others of its key, or anywhere if it is settled."""
    return F.when(F.col("settled"), F.xxhash64("doc_id", "part", "start")).otherwise(F.col(key))


def grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", spread("anchor")).repartition("place").sortWithinPartitions("settled", "anchor", "context", "doc_id", "part", "start").drop("place").mapInArrow(tidy(sorted_runs), SORTED)


def edge_texts(docs: DataFrame, edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, part, text, edges) of the documents that have edges, with all of a document's edges in one row.

    Texts of most other documents aren't shuffled.
    """
    per_doc = edges.groupBy(F.col("doc_id").alias("id"), F.col("part").alias("id_part")).agg(F.array_sort(F.collect_set(F.struct("start", "windows", "anchor", "dup"))).alias("edges"))
    rows = parted(docs).withColumn("part", F.col("part").cast("long"))
    rows = among(rows, edges.select("part"), spark).withColumn("part", F.col("part").cast("int"))
    return rows.join(per_doc, (rows["doc_id"] == per_doc["id"]) & (rows["part"] == per_doc["id_part"])).select("doc_id", "part", "text", "edges")


def edge_arrays(batch: pa.RecordBatch, t: int = T):
    """(words of the batch, row, start, windows, anchor, dup) of its edges that lie inside their texts."""
    w = words(batch.column("text"))
    column = batch.column("edges")
    flat = column.flatten()
    row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
    start, m, anchor = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    dup = flat.field(3).to_numpy(zero_copy_only=False)
    inside = start + m - 1 + t <= np.diff(w.bounds)[row]
    return w, row[inside], start[inside].astype(np.int64), m[inside].astype(np.int64), anchor[inside], dup[inside]


#: What is known of a match: a copy and its earlier occurrence, or a first occurrence, of words start:end.
MATCHES = ["doc_id", "part", "is_copy", "source", "source_part", "source_start", "start", "end"]
MAXIMAL = "doc_id bigint, part int, is_copy boolean, start int, `end` int, source bigint, source_start int"
REPEATS = "doc_id bigint, part int, is_copy boolean, start_word int, end_word int, n_words int, source_doc_id bigint, source_start int, match_start int, match_words int"


def _streamed(batches: Iterator[pa.RecordBatch], names: list[str], join) -> Iterator[pa.RecordBatch]:
    """join(rows, last) -> (batch, rows to keep) over sorted rows, of which it keeps one for the next batch."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [x if x.dtype == np.bool_ else x.astype(np.int64) for x in (batch.column(c).to_numpy(zero_copy_only=False) for c in names)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        out, held = join(rows, False)
        yield out
    if held is not None:
        yield join(held, True)[0]


def _runs(keys: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where runs of spans begin that overlap or touch and agree in keys, in rows sorted by keys and start."""
    other = np.ones(len(start), np.bool_)
    other[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    # a running maximum of ends within each group, by lifting each group above the one before
    lift = (np.cumsum(other) - 1) << 32
    reach = np.maximum.accumulate(end + lift) - lift
    other[1:] |= start[1:] > reach[:-1]
    return np.flatnonzero(other)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches at the same distance that overlap or touch grow into one."""

    def join(rows: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray] | None]:
        first = _runs(rows[:6], rows[6], rows[7])
        out = [*(x[first] for x in rows[:7]), np.maximum.reduceat(rows[7], first)]
        done = len(first) if last else len(first) - 1
        doc, part, copy, source, _, shift, start, end = (x[:done] for x in out)
        columns = [doc, part.astype(np.int32), copy, start.astype(np.int32), end.astype(np.int32), source, (start - shift).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "part", "is_copy", "start", "end", "source", "source_start"]), None if last else [x[done:] for x in out]

    return _streamed(batches, ["doc_id", "part", "is_copy", "source", "source_part", "shift", "start", "end"], join)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What matches cover without a gap is one repeat, with the longest of them."""

    def join(rows: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray] | None]:
        doc, part, copy, start, end, source, source_start, at, size = rows
        first = _runs([doc, part, copy], start, end)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
        order = np.lexsort((at, -size, run))
        best = order[first]  # the first of the longest in each run
        out = [*(x[first] for x in (doc, part, copy, start)), np.maximum.reduceat(end, first), *(x[best] for x in (source, source_start, at, size))]
        done = len(first) if last else len(first) - 1
        doc, part, copy, start, end, source, source_start, at, size = (x[:done] for x in out)
        ints = lambda *xs: [pa.array(x.astype(np.int32)) for x in xs]
        of = lambda *xs: [pa.array(x.astype(np.int32), mask=~copy) for x in xs]
        columns = [pa.array(doc), *ints(part), pa.array(copy), *ints(start, end, end - start), pa.array(source, mask=~copy), *of(source_start, at, size)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "is_copy", "start_word", "end_word", "n_words", "source_doc_id", "source_start", "match_start", "match_words"]), None if last else [x[done:] for x in out]

    return _streamed(batches, ["doc_id", "part", "is_copy", "start", "end", "source", "source_start", "match_start", "match_words"], join)


def merged(matches: DataFrame) -> DataFrame:
    """REPEATS of MATCHES: maximal matches of the same documents at the same distance, then all words that they cover without a gap.

    Both passes see a document's rows in one partition, so there is one shuffle.
    """
    here = F.when(F.col("is_copy"), F.col("start") - F.col("source_start")).otherwise(0).alias("shift")
    only = lambda c: F.when(F.col("is_copy"), F.col(c)).otherwise(0).alias(c)
    rows = matches.select("doc_id", "part", "is_copy", only("source"), only("source_part"), here, "start", "end").repartition("doc_id", "part")
    found = rows.sortWithinPartitions("doc_id", "part", "is_copy", "source", "source_part", "shift", "start", "end").mapInArrow(tidy(_extended), MAXIMAL)
    found = found.withColumns({"match_start": F.col("start"), "match_words": F.col("end") - F.col("start")})
    return found.sortWithinPartitions("doc_id", "part", "is_copy", "start", "end", "source").mapInArrow(tidy(_covered), REPEATS)


def settled(sorted_rows: DataFrame, t: int = T) -> DataFrame:
    """MATCHES of the rows of grouped() that need no further comparison."""
    end = (F.col("start") + F.col("windows") - 1 + t).alias("end")
    return sorted_rows.where(F.col("kind") != EDGE).select("doc_id", "part", F.col("kind").isin(COPY, SETTLED).alias("is_copy"), "source", "source_part", "source_start", "start", end)
