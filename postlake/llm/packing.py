"""Best-fit packing of documents into bins of CAPACITY words, improved by local search.

A document's length is its number of words between white space (of any kind that Unicode
has), at least one.  Longer documents are cut into pieces of CAPACITY and a rest.  Documents
are dealt by a hash of id and length to shards of about SHARD_BINS bins' worth of words, which
are packed side by side; no step crosses a shard, which costs about one bin in SHARD_BINS:
best fit, longest piece first, then a search that exchanges or moves pieces between bins
that aren't full.  A step takes the fullest such bin that can gain, and of these the step
that fills it most:

* move: a piece from an emptier bin that fits the gap;
* one for one: a piece for a longer one of an emptier bin;
* two for one: two pieces of one emptier bin for one piece, or one for two.

Every step makes a fuller bin fuller at the cost of an emptier one, so the sum of squared
fills grows with each and the search ends; emptied bins go.  At its end no bin can be
improved by a step with any emptier bin.

Rows of equal id and length are interchangeable here.  They are counted before they are dealt, and
dealt LOT at a time, so that no id, null included, fills a shard.

Defined results: null, empty and blank texts have length 1, so every row is placed exactly
once.  Rows with equal doc_id are placed each on their own, told apart by copy 0, 1, ... in
the order of their lengths.  Ties are broken by doc_id, copy and piece, so the result doesn't
depend on the rows' order.  A very long text is a piece for every CAPACITY words.  An empty table
has no bins.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_checkpoints, table

CAPACITY = 2048
SHARD_BINS = 512
LOT = 256  # rows of equal id and length that are dealt together, at most
SCHEMA = "shard int, bin int, fill int, position int, doc_id bigint, copy int, piece int, start int, length int"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: each piece, in the order given, goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i, s in enumerate(sizes):
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - s, len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= s
        if left:
            insort(room, (left, b))
    return bins


class Search:
    """Local search over the bins that aren't full, in rounds until a round takes no step.

    A round visits the bins from the fullest to the emptiest.  A bin that is visited leaves
    the lists of sizes that the bins after it can give, so singles and pairs hold only pieces,
    and pairs of pieces of one bin, of bins that are no fuller than the one visited, and the
    best partner for a gap is a bisection.  A size is listed once a bin.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins = dict(enumerate(bins))
        self.fill = {b: sum(sizes[i] for i in x) for b, x in self.bins.items()}
        self.singles: list[tuple[int, int]] = []
        self.pairs: list[tuple[int, int]] = []
        self.steps = 0

    def _entries(self, b: int) -> tuple[set[int], set[int]]:
        s = sorted(self.sizes[i] for i in self.bins[b])
        return set(s), {x + y for k, x in enumerate(s) for y in s[:k]}

    def _change(self, b: int, add: bool) -> None:
        for entries, of in zip((self.singles, self.pairs), self._entries(b)):
            for size in of:
                if add:
                    insort(entries, (size, b))
                else:
                    del entries[bisect_left(entries, (size, b))]

    def _gain(self, b: int) -> tuple | None:
        """The step that fills bin b most: (gain, what leaves b, what comes, from bin)."""
        gap = self.capacity - self.fill[b]
        singles, pairs = self._entries(b)
        found: tuple | None = None
        for leave, width in [(0, 0), *((x, 1) for x in sorted(singles)), *((x, 2) for x in sorted(pairs))]:
            for entries, come in ((self.singles, 1), (self.pairs, 2)):
                if width + come > 3 or width == 0 and come == 2:
                    continue
                at = bisect_right(entries, (leave + gap, len(self.sizes))) - 1
                if at >= 0 and entries[at][0] > leave + (found[0] if found else 0):
                    found = (entries[at][0] - leave, (leave, width), (entries[at][0], come), entries[at][1])
                    if found[0] == gap:
                        return found
        return found

    def _take(self, b: int, size: int, width: int) -> list[int]:
        """Pieces of bin b, width of them, that have this size in all."""
        have = sorted(self.bins[b], key=lambda i: (self.sizes[i], i))
        if width == 1:
            return [next(i for i in have if self.sizes[i] == size)]
        if width == 2:
            return next([i, j] for k, i in enumerate(have) for j in have[:k] if self.sizes[i] + self.sizes[j] == size)
        return []

    def _round(self) -> int:
        order = sorted((self.fill[b], b) for b in self.bins if self.fill[b] < self.capacity)
        lists = [self._entries(b) for _, b in order]
        self.singles = sorted((s, b) for (_, b), (x, _) in zip(order, lists) for s in x)
        self.pairs = sorted((s, b) for (_, b), (_, x) in zip(order, lists) for s in x)
        steps = 0
        while order:
            _, b = order.pop()
            self._change(b, False)
            while self.fill[b] < self.capacity and (step := self._gain(b)):
                _, (leave, out), (come, into), other = step
                give, take = self._take(b, leave, out), self._take(other, come, into)
                self._change(other, False)
                del order[bisect_left(order, (self.fill[other], other))]
                self.bins[b] = [i for i in self.bins[b] if i not in give] + take
                self.bins[other] = [i for i in self.bins[other] if i not in take] + give
                self.fill[b] += come - leave
                self.fill[other] += leave - come
                if self.bins[other]:
                    self._change(other, True)
                    insort(order, (self.fill[other], other))
                else:
                    del self.bins[other], self.fill[other]
                steps += 1
        return steps

    def run(self) -> list[list[int]]:
        while steps := self._round():
            self.steps += steps
        return [self.bins[b] for b in sorted(self.bins)]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes into sizes, which must be sorted from the longest and be at most capacity."""
    return Search(best_fit(sizes, capacity), sizes, capacity).run()


def packing(docs: DataFrame, spark: SparkSession, capacity: int = CAPACITY, shard_bins: int = SHARD_BINS) -> DataFrame:
    """One row for every piece of every row of docs: its shard, bin, and place in the bin."""
    shared_checkpoints(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # what stands before a first and after a last blank are no words
    ends = text.rlike(r"(?U)^\s").cast("int") + F.right(text, F.lit(1)).rlike(r"(?U)^\s").cast("int")
    number = F.greatest(F.lit(1), F.size(F.split(text, r"(?U)\s+")) - ends)
    long = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("words")).groupBy("doc_id", "words").agg(F.count("*").alias("n")).checkpoint()
    total = long.agg(F.sum(F.col("words") * F.col("n"))).first()[0] or 0
    shards = max(1, -(-int(total) // (capacity * shard_bins)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("words").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = long.withColumn("before", before).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT))))
    first = F.col("before") + F.col("lot") * LOT
    lots = lots.select("doc_id", "words", first.cast("int").alias("first"), F.least(F.lit(LOT), F.col("n") - F.col("lot") * LOT).cast("int").alias("n"), "lot")
    dealt = lots.withColumn("shard", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "words", "lot", F.lit(7)), F.lit(shards)).cast("int")).drop("lot")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "first"], kind="stable", na_position="first")
        lot = np.repeat(np.arange(len(frame)), frame["n"])
        first = np.cumsum(frame["n"].to_numpy(np.int64)) - frame["n"].to_numpy(np.int64)
        copy = frame["first"].to_numpy(np.int64)[lot] + np.arange(len(lot)) - first[lot]
        words = frame["words"].to_numpy(np.int64)[lot]
        own = frame["doc_id"].astype("Int64").to_numpy()[lot]
        pieces = -(-words // capacity)
        row = np.repeat(np.arange(len(lot)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(capacity, words[row] - piece * capacity)
        order = np.lexsort((piece, row, -length))
        row, piece, length = row[order], piece[order], length[order]
        bins = pack(length.tolist(), capacity)
        at = np.array([i for b in bins for i in b], np.int64)
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        place = np.concatenate([np.arange(len(b)) for b in bins]) if bins else number
        fill = np.bincount(number, weights=length[at])[number].astype(int)
        ids = own[row[at]]
        shard = int(frame["shard"].iloc[0])
        return pd.DataFrame({"shard": shard, "bin": number, "fill": fill, "position": place, "doc_id": pd.array(ids, "Int64"), "copy": copy[row[at]], "piece": piece[at], "start": piece[at] * capacity, "length": length[at]})

    return dealt.groupBy("shard").applyInPandas(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"), spark)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of docs, which come as they are: no row is dropped here."""
    return packing(docs, spark)
