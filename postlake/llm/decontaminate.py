"""Benchmark decontamination with SimHash windows.

Windows have sizes near those of the benchmark's items: an item of n words uses the largest
size of SIZES that leaves STRIDE - 1 words of play, so that wherever the item stands in a
document, one of the document's windows at multiples of STRIDE lies wholly inside it.  An
item gives the fingerprints of all its windows of that size, of the next size below for items
that stand in part, and of PART words for long items that are altered throughout; an item too short for the smallest size has a size of its own and
stride 1.  Items of under SHORT words, which have few windows to be found by when they stand
in part or altered, also give all windows of SHORT_PART words, those under twice that of SHORTEST_PART,
at stride 1.  A fingerprint is the 64-bit SimHash of a window's words, weighted by their length.

Two fingerprints within RADIUS bits differ in at most RADIUS // BLOCKS bits of one of their
BLOCKS blocks.  The index lists, for each block and value, the item windows whose block is
within that distance, so looking up the four block values of a document's window finds every
item window within the radius, without exception.  Each (document, item) place so found is
verified: of the item's three-word shingles, weighted by their letters, at least
MIN_SIMILARITY must be in the words of the document that the item would cover there, SLACK
words more on either side.

The items are indexed in portions of PORTION windows, and each portion is broadcast and
takes one pass over the documents; of several portions one is held at a time, so that the
size of what is sent is bounded whatever the size of the benchmark.  A worker keeps its index from task to task.

Defined results: null and empty texts, null ids and items without a word match nothing.
Very long texts are scanned whole, SLICE words at a time with an overlap of the largest
window, so that no place is missed and memory is bounded.  Rows that share a doc_id but not the text
are looked at each on their own; an empty table or benchmark gives no rows.
Items of one or two words have their word sequence as the only shingle.  Of several places
of an item in a document the one of highest similarity counts, of equals the first.
Repeated rows count once.  Other columns are ignored by contaminated() and kept as they are
by stage_decontaminate(), where rows with a null doc_id stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, chunks, docs_of, named, prefix, ragged, shared_checkpoints, spans, table, tidy, words

SIZES = (12, 16, 24, 32, 44, 60, 88, *(128 << k for k in range(10)))
STRIDE = 4
PART = 24
SHORT, SHORT_PART, SHORTEST_PART = 20, 8, 4
RADIUS, BLOCKS = 11, 4
MIN_SIMILARITY = 0.5
SHINGLE, SLACK = 3, 4
PORTION = 50_000
SLICE = 200_000  # a multiple of STRIDE
SCHEMA = "doc_id bigint, part bigint, item_id bigint, similarity double, start_word int, end_word int"
#: +1 or -1 for each bit of a byte.
SIGNS = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), 1, -1).astype(np.int8)


def weights(w: Words) -> np.ndarray:
    """1 for words of up to three bytes, 2 up to six, 3 beyond."""
    return (1 + ((w.end - w.start) > 3) + ((w.end - w.start) > 6)).astype(np.int8)


def features(w: Words) -> np.ndarray:
    """The weighted sign vector of each word."""
    signs = SIGNS[w.hash.view(np.uint8).reshape(-1, 8)].reshape(-1, 64)
    return signs * weights(w)[:, None]


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(U64).ravel()


class Sums:
    """Sums of k successive rows of a matrix of signs, at every row, in the smallest integers that hold them.

    Sums of 1, 2, 4, ... rows are kept, and those of k rows are made of them.
    """

    def __init__(self, rows: np.ndarray, most: int) -> None:
        self.levels, self.most = [rows], most  # most: the greatest value in a row

    def _kind(self, k: int) -> type:
        return np.int8 if self.most * k < 1 << 7 else np.int16 if self.most * k < 1 << 15 else np.int32

    def _level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            have, width = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.add(have[:-width], have[width:], dtype=self._kind(2 * width)) if len(have) > width else have[:0])
        return self.levels[j]

    def of(self, k: int) -> np.ndarray:
        n, out, at = len(self.levels[0]) - k + 1, None, 0
        if n <= 0:
            return self.levels[0][:0]
        for j in range(k.bit_length()):
            if k >> j & 1:
                part = self._level(j)[at : at + n]
                out = part.astype(self._kind(k), copy=False) if out is None else np.add(out, part, dtype=self._kind(k))
                at += 1 << j
        return out


def fingerprints(w: Words, size: int, stride: int, runs_: Sums, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, text, start) of the windows of size words at multiples of stride.

    runs_: the summed features of each run of stride words; first: each text's first run.
    """
    count = np.diff(w.bounds)
    number = np.maximum((count - size) // stride + 1, 0)
    row = np.repeat(np.arange(len(count)), number)
    step = ragged(np.zeros(len(count), np.int64), number)
    return packed(runs_.of(size // stride)[first[row] + step]), row, step * stride


def runs(w: Words, stride: int) -> tuple[Sums, np.ndarray]:
    """Sums of features over runs of stride words; every text starts a run of its own.  A text's last run, if it isn't full, is in no window."""
    count = np.diff(w.bounds)
    number = -(-count // stride)
    first = np.concatenate([[0], np.cumsum(number)])
    words_ = Sums(features(w), 3)
    if stride == 1:
        return words_, first
    begin = np.repeat(w.bounds[:-1], number) + stride * ragged(np.zeros(len(count), np.int64), number)
    full = words_.of(stride)
    return Sums(full[np.minimum(begin, len(full) - 1)] if len(full) else full, 3 * stride), first


def shingles(w: Words, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, weight, index of the first word) of a text's shingles; the weight is the number of bytes in them."""
    a, b = int(w.bounds[row]), int(w.bounds[row + 1])
    width = min(SHINGLE, b - a)
    at = np.arange(a, b - width + 1) if width else np.zeros(0, np.int64)
    size = np.concatenate([[0], np.cumsum(w.end - w.start)])
    return spans(prefix(w.hash), at, at + width), size[at + width] - size[at], at - a


@dataclass
class Index:
    """Item windows of one size, and the lists of them by block and value."""

    size: int
    stride: int
    mark: np.ndarray  # fingerprints
    item: np.ndarray
    offset: np.ndarray
    lists: list[tuple[np.ndarray, np.ndarray]]


def within(bits: int, radius: int) -> np.ndarray:
    """All values of so many bits with at most radius bits set."""
    values = np.arange(1 << bits)
    return values[np.bitwise_count(values) <= radius]


def index(size: int, stride: int, mark: np.ndarray, item: np.ndarray, offset: np.ndarray) -> Index:
    ball = within(64 // BLOCKS, RADIUS // BLOCKS)
    lists = []
    for k in range(BLOCKS):
        value = (mark >> U64(k * 16) & U64(0xFFFF)).astype(np.int64)
        near = (value[:, None] ^ ball[None, :]).ravel()
        order = np.argsort(near, kind="stable")
        start = np.searchsorted(near[order], np.arange((1 << 16) + 1))
        lists.append((start, (order // len(ball)).astype(np.int32)))
    return Index(size, stride, mark, item, offset, lists)


@dataclass
class Items:
    ids: list[int]
    length: np.ndarray
    shingles: list[tuple[np.ndarray, np.ndarray]]
    width: np.ndarray
    windows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]  # size, stride, fingerprint, item, offset

    def indexes(self) -> list[Index]:
        return [index(*x) for x in self.windows]


def windows_of(n: int) -> list[tuple[int, int]]:
    """(size, stride) of the windows that an item of n words is found by."""
    fit = [s for s in SIZES if s + STRIDE - 1 <= n]
    out = [(s, STRIDE) for s in sorted({*fit[-2:], *(s for s in fit if s == PART)})]
    if n and not fit:
        out.append((n, 1))
    if SHINGLE < n < SHORT:
        out.append((SHORT_PART if n >= 2 * SHORT_PART else min(n - 1, SHORTEST_PART), 1))
    return out


def item_table(ids: list[int], texts: list[str]) -> Items:
    w = words(pa.array(texts, pa.string()))
    length = np.diff(w.bounds)
    by: dict[tuple[int, int], list[int]] = {}
    for i, n in enumerate(length):
        for key in windows_of(int(n)):
            by.setdefault(key, []).append(i)
    sums, first = runs(w, 1)
    found = []
    for (size, stride), members in sorted(by.items()):
        keep = np.zeros(len(ids), np.bool_)
        keep[members] = True
        mark, row, start = fingerprints(w, size, 1, sums, first)
        pick = keep[row]
        found.append((size, stride, mark[pick], row[pick], start[pick]))
    parts = []
    for i in range(len(ids)):
        h, weight, _ = shingles(w, i)
        h, at = np.unique(h, return_index=True)
        parts.append((h, weight[at]))
    return Items(ids, length, parts, np.minimum(length, SHINGLE), found)


def lookup(ix: Index, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document window, item window) of all pairs within RADIUS."""
    found_d, found_i = [], []
    for k, (start, members) in enumerate(ix.lists):
        value = (mark >> U64(16 * k) & U64(0xFFFF)).astype(np.int64)
        low = start[value]
        number = start[value + 1] - low
        d = np.repeat(np.arange(len(mark)), number)
        i = members[ragged(low, number)]
        near = np.bitwise_count(mark[d] ^ ix.mark[i]) <= RADIUS
        found_d.append(d[near])
        found_i.append(i[near])
    return np.concatenate(found_d), np.concatenate(found_i)


def slices(w: Words, overlap: int) -> Iterator[tuple[int, Words]]:
    """(number of words before it, words) of the parts of a single long text, or all of a batch."""
    n = len(w.hash)
    if len(w.bounds) != 2 or n <= SLICE:
        yield 0, w
        return
    for a in range(0, n, SLICE):
        b = min(n, a + SLICE + overlap)
        yield a, Words(w.data, w.offsets, np.array([0, b - a]), w.start[a:b], w.end[a:b], w.hash[a:b])


def scan(items: Items, indexes: list[Index], w: Words) -> list[tuple[int, int, float, int, int]]:
    """(row, item, similarity, start, end) of the verified places, the best of each row and item."""
    places: list[np.ndarray] = []
    for begin, part in slices(w, max((ix.size for ix in indexes), default=0)):
        built = {stride: runs(part, stride) for stride in {ix.stride for ix in indexes}}
        for ix in indexes:
            mark, row, start = fingerprints(part, ix.size, ix.stride, *built[ix.stride])
            d, i = lookup(ix, mark)
            places.append(np.stack([row[d], ix.item[i], begin + start[d] - ix.offset[i]], axis=1))
    found = np.unique(np.concatenate(places), axis=0) if places else np.zeros((0, 3), np.int64)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    sums = prefix(w.hash)
    for row, item, begin in found.tolist():
        a, n = int(w.bounds[row]), int(w.bounds[row + 1] - w.bounds[row])
        low, high = max(0, begin - SLACK), min(n, begin + int(items.length[item]) + SLACK)
        width = int(items.width[item])
        at = np.arange(a + low, a + high - width + 1)
        h, weight = items.shingles[item]
        there = np.isin(h, spans(sums, at, at + width))
        similarity = float(weight[there].sum() / weight.sum())
        if similarity >= MIN_SIMILARITY and similarity > best.get((row, item), (0.0,))[0]:
            best[row, item] = (similarity, max(0, begin), min(n, begin + int(items.length[item])))
    return [(r, i, *x) for (r, i), x in sorted(best.items())]


def portions(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items in portions of about PORTION windows each."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    ids: list[int] = []
    texts: list[str] = []
    load = 0
    for r in rows.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        n = len(words(pa.array([r["text"]])).hash)
        load += sum(n - size + 1 for size, _ in windows_of(n))
        if load > PORTION:
            yield item_table(ids, texts)
            ids, texts, load = [], [], 0
    if ids:
        yield item_table(ids, texts)


_of_worker: dict[str, list[Index]] = {}


def indexes_of(key: str, items: Items) -> list[Index]:
    """The indexes of a portion, which a worker keeps until another portion comes."""
    if key not in _of_worker:
        _of_worker.clear()
        _of_worker[key] = items.indexes()
    return _of_worker[key]


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, part, item_id, similarity, start_word, end_word): each distinct row's best place of each item that it holds."""
    rows = docs_of(docs).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("part"), "text")

    def found_in(items: Items) -> DataFrame:
        sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            indexes = indexes_of(key, items)
            for batch in chunks(batches):
                found = scan(items, indexes, words(batch.column("text")))
                at = pa.array([x[0] for x in found], pa.int64())
                columns = [[items.ids[x[1]] for x in found], *([x[k] for x in found] for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("part").take(at), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int32(), pa.int32())))], names=["doc_id", "part", "item_id", "similarity", "start_word", "end_word"])

        return rows.mapInArrow(tidy(run), SCHEMA)

    out = None
    for items in portions(benchmark):
        if out is not None and out.count_of == 1:
            shared_checkpoints(spark)
            out = Found(out.rows.checkpoint(), 2)
        found = found_in(items)
        out = Found(found, 1) if out is None else Found(out.rows.unionByName(found.checkpoint()), 2)
    all_ = out.rows if out is not None else spark.createDataFrame([], SCHEMA)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), F.col("end_word").alias("e")))
    return all_.groupBy("doc_id", "part", "item_id").agg(best.alias("b")).select("doc_id", "part", "item_id", "b.similarity", (-F.col("b.s")).alias("start_word"), F.col("b.e").alias("end_word"))


@dataclass
class Found:
    """Rows of the portions so far; those of several are written before the next is sent."""

    rows: DataFrame
    count_of: int


def contaminated(docs: DataFrame, benchmark: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, end_word): each document's best place of each item that it holds."""
    return contaminated_rows(docs, benchmark, spark).drop("part")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spark)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text holds an item; rows with a null doc_id stay."""
    plain, names = named(docs)
    bad = contaminated_rows(docs, table(spark, sf_dir, "benchmark"), spark).select("doc_id", "part").distinct()
    same = (F.col(names["doc_id"]).cast("long") == bad["doc_id"]) & (F.xxhash64(F.col(names["text"]).cast("string")) == bad["part"])
    return plain.join(bad, same, "left_anti").toDF(*docs.columns)
