"""Repeated text by suffix arrays and longest previous factors, keeping first occurrences.

Winnowed anchors (see seeds) cut the documents into overlapping pieces such that any two
equal windows of T = 50 words lie in pieces of the same anchor.  An anchor of one piece has no
repeat.  The pieces of all others are dealt by anchor, so each portion holds whole anchors, and every portion builds the suffix
array of its pieces, laid one after the other in the order of their places:

* prefix doubling ranks all suffixes, and the ranks of every doubling are kept;
* the previous and the next smaller position in suffix order, found by pointer jumping,
  are the two earlier suffixes that have most in common with each suffix;
* their longest common prefixes, read off the kept ranks, give the longest previous factor.

A place whose previous factor has T words or more begins a later copy, of which the factor is
the row unless an earlier place's factor covers it; what a copy points to and that is none itself is a first occurrence.  deduplicated() removes the later
copies and keeps the first.

Factors run within pieces, which are all of the text around an anchor that can hold a window
with it; merged() joins what neighbouring pieces have of one repeat.  Copies that a task has
settled before the shuffle (seeds.Combiner) are in no array.  An anchor of more than
CROWD pieces, which no task should hold whole, has its windows compared by their hashes
instead, as in substrings; its results are the same.

Defined results are those of substrings: null texts and ids, empty texts and texts of under
50 words have no repeats; rows with the same doc_id and text count once, and rows that share a
doc_id but not the text are documents of their own; repeats within a document count; very
long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, ragged, shared_checkpoints, signed, table, tidy
from .seeds import EDGE, MATCHES, SETTLED, T, edge_arrays, edge_texts, grouped, merged, seeds, settled
from .substrings import edge_matches, without_copies

PORTION_WORDS = 150_000  # words of a suffix array, about; an anchor is never split
CROWD = 2_000  # pieces of an anchor in a suffix array, at most


def doubled_ranks(text: np.ndarray, least: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... values, until least values or all ranks differ."""
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while width < least and ranks[-1].max(initial=0) + 1 < len(text):
        r = ranks[-1]
        after = np.zeros(len(r), np.int64)
        if width < len(r):
            after[:-width] = r[width:] + 1
        ranks.append(np.unique(r * (len(r) + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return ranks


def smaller(order: np.ndarray) -> np.ndarray:
    """For each place of order the nearest place before it with a smaller value, -1 if there is none."""
    n = len(order)
    at = np.arange(-1, n - 1)
    todo = np.flatnonzero((at >= 0) & (order[at] > order))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] >= 0) & (order[at[todo]] > order[todo])]
    return at


def common_prefix(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of the suffixes at i and at j, up to twice the widest ranks."""
    n = len(ranks[0])
    out = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        for _ in range(2 if k == len(ranks) - 1 else 1):
            a, b = i + out, j + out
            inside = (a < n) & (b < n)
            out += np.where(inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)]), 1 << k, 0)
    return out


def previous_factors(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) of the longest previous factor at each place; lengths are exact up to least, source -1 if there is none."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks = doubled_ranks(text, least)
    order = np.lexsort((np.arange(n), ranks[-1]))
    before = smaller(order)
    after = n - 1 - smaller(order[::-1])[::-1]
    length, source = np.zeros(n, np.int64), np.full(n, -1)
    for near in (before, after):
        some = np.flatnonzero((near >= 0) & (near < n))
        i, j = order[some], order[near[some]]
        common = common_prefix(ranks, i, j)
        better = common > length[i]
        length[i[better]], source[i[better]] = common[better], j[better]
    return length, source


def factors(pieces: list[np.ndarray], t: int = T) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, source) of the previous factor of t words or more at every place of the pieces laid end to end, a divider after each; 0 and -1 for none.

    The last array tells the places whose factor ends beyond those of all places before it in its
    piece: the others lie within one of these.
    """
    total = sum(len(p) + 1 for p in pieces)
    text = np.empty(total, np.int64)
    divider = np.zeros(total, np.bool_)
    at = 0
    for p in pieces:
        text[at : at + len(p)] = p
        divider[at + len(p)] = True
        at += len(p) + 1
    words = np.unique(text[~divider], return_inverse=True)[1]
    text[~divider] = words + len(pieces)
    text[divider] = np.arange(len(pieces))  # all different, so no match runs across one
    length, source = previous_factors(text, max(2 * t, max(map(len, pieces), default=0)))
    length = np.where(length >= t, length, 0)
    # no factor runs across a divider, so ends of earlier pieces are no greater than a piece's first place
    end = np.arange(total) + length
    before = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
    return length, np.where(length > 0, source, -1), (length > 0) & (end > before)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        w, row, start, m, anchor, dup = edge_arrays(batch)
        size = m - 1 + T
        flat = signed(w.hash)[ragged(start + w.bounds[row], size)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column("doc_id").take(take), batch.column("part").take(take), pa.array(start.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(dup), lists], names=["anchor", "doc_id", "part", "start", "windows", "dup", "words"])


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies and first occurrences of pieces that come with equal anchors together."""

    def give(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "part", "start")] + [("dup", "descending")])
        doc, part, start, m, dup = (rows.column(c).to_numpy() for c in ("doc_id", "part", "start", "windows", "dup"))
        column = rows.column("words").combine_chunks()
        bounds, flat = column.offsets.to_numpy(), column.values.to_numpy()
        new = np.ones(len(doc), np.bool_)
        new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1])  # a repeated row gives the same piece again
        pick = np.flatnonzero(new)
        pieces = [flat[bounds[i] : bounds[i + 1]] for i in pick]
        length, source, greatest = factors(pieces)
        size = np.array([len(p) + 1 for p in pieces])
        begin = np.cumsum(size) - size
        place_of = lambda at: (piece := np.searchsorted(begin, at, "right") - 1, start[pick[piece]] + at - begin[piece])
        at = np.flatnonzero(greatest)
        (here, word), (there, earlier) = place_of(at), place_of(source[at])
        # places that begin a window of some source and of no copy, in runs
        turns = np.zeros(len(length) + 1, np.int64)
        np.add.at(turns, source[at], 1)
        np.add.at(turns, source[at] + length[at] - T + 1, -1)
        first = (np.cumsum(turns)[:-1] > 0) & (length == 0)
        known = ragged(begin[dup[pick]], m[pick][dup[pick]].astype(np.int64))  # all windows of a piece with copies of it as a whole
        first[known] |= length[known] == 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], first.astype(np.int8), [0]])))
        of, at_word = place_of(edges[::2])
        run = edges[1::2] - edges[::2]
        columns = [np.concatenate(x) for x in ((doc[pick[here]], doc[pick[of]]), (part[pick[here]], part[pick[of]]), (np.ones(len(at), np.bool_), np.zeros(len(of), np.bool_)), (doc[pick[there]], np.zeros(len(of), doc.dtype)), (part[pick[there]], np.zeros(len(of), part.dtype)), (earlier, np.zeros(len(of), np.int64)), (word, at_word), (word + length[at], at_word + run - 1 + T))]
        return pa.RecordBatch.from_arrays([pa.array(c if k in (0, 2, 3) else c.astype(np.int32)) for k, c in enumerate(columns)], names=MATCHES)

    held: list[pa.RecordBatch] = []
    load = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        load += len(batch.column("words").flatten())
        if load >= PORTION_WORDS:
            rows = pa.Table.from_batches(held)
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield give(rows.slice(0, cut).combine_chunks())
                held = rows.slice(cut).to_batches()
                load = sum(len(b.column("words").flatten()) for b in held)
    if held:
        yield give(pa.Table.from_batches(held).combine_chunks())


def repeats_by_suffixes(docs: DataFrame, spark: SparkSession, crowd: int = CROWD) -> DataFrame:
    """seeds.REPEATS of all maximal repeats of 50 words and more."""
    shared_checkpoints(spark)
    rows = grouped(seeds(docs)).checkpoint()
    # copies that were settled before the shuffle are known; their first occurrence has another copy here
    gathered = rows.where(F.col("kind") != SETTLED)
    crowds = gathered.groupBy(F.col("anchor").alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("of")
    crowded = gathered.join(crowds, F.col("anchor") == F.col("of"), "left_semi")
    pieces = edge_texts(docs, gathered.join(crowds, F.col("anchor") == F.col("of"), "left_anti"), spark).mapInArrow(tidy(_pieces), "anchor bigint, doc_id bigint, part int, start int, windows int, dup boolean, words array<bigint>")
    fine = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "part", "start").mapInArrow(tidy(_factor), "doc_id bigint, part int, is_copy boolean, source bigint, source_part int, source_start int, start int, `end` int")
    rest = edge_matches(edge_texts(docs, crowded.where(F.col("kind") == EDGE), spark))
    known = settled(rows.where(F.col("kind") == SETTLED)).unionByName(settled(crowded))
    return merged(known.unionByName(fine.select(MATCHES)).unionByName(rest.select(MATCHES)))


def deduplicated(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """docs without the later copies that repeats_by_suffixes() finds, as substrings.without_copies()."""
    return without_copies(docs, spark, repeats_by_suffixes)


def op6_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_by_suffixes(table(spark, sf_dir, "documents"), spark).drop("part")
