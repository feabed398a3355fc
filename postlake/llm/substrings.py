"""Substring deduplication by seed and extend.

Documents are joined on winnowed anchors (see seeds): each occurrence of an anchor with the
first one in places' order that agrees with it.  That pair is a seed.  It is extended both ways
as far as windows have that anchor: at once where whole contexts are equal, word by word at
the edges of passages, where each window before and after is looked up by its hash.  What
lies beyond is extended by the neighbouring anchors: matches of two documents at the same
distance that overlap or touch grow into one maximal match, and every one is of T words or
more.  What the matches of a document cover without a gap is one repeat.

The result is exact: a word lies in a repeat of is_copy = true if it is in a window of T = 50
words that occurs at an earlier place, and in one of is_copy = false if it is in a window
that occurs again later but not earlier.  A copy's row also has the longest match in it:
match_words words from match_start are those from source_start of source_doc_id, which is
earlier.  Places are ordered by doc_id, then by text, then by position.  Words are compared in
lower case, without punctuation and white space.

Defined results: null texts and ids, empty texts and texts of under 50 words have no repeats.
Rows with the same doc_id and text count once; rows that share a doc_id but not the text are
documents of their own.  A passage that repeats within one document counts.  Very long texts
are taken whole, an empty table has no repeats.  In stage_substrings() rows with a null
doc_id stay as they are, every row is cut by its own text's repeats, and other columns, whatever
their names, are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, named, prefix, ragged, shared_checkpoints, signed, spans, table, tidy, words
from .seeds import EDGE, MATCHES, T, Combiner, edge_arrays, edge_texts, grouped, merged, part_of, seeds, settled, spread

WINDOWS = "settled boolean, anchor bigint, doc_id bigint, part int, start int, dup boolean, source bigint, source_part int, source_start int"


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the edges, as a row of its own that has its hash for an anchor."""
    combine = Combiner()
    for batch in chunks(batches):
        w, row, start, m, _, dup = edge_arrays(batch)
        if not len(row):
            continue
        at, rows = ragged(start, m), np.repeat(row, m)
        begin = at + w.bounds[rows]
        hashes = signed(spans(prefix(w.hash), begin, begin + T))
        doc, part = batch.column("doc_id").to_numpy()[rows], batch.column("part").to_numpy()[rows]
        order, done, *source = combine(hashes, doc, part, at)
        # one that has copies of its whole context is a first occurrence even if no window row tells so
        columns = [done, hashes[order], doc[order], part[order], at[order].astype(np.int32), np.repeat(dup, m)[order], source[0], source[1].astype(np.int32), source[2].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["settled", "anchor", "doc_id", "part", "start", "dup", "source", "source_part", "source_start"])


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrences and copies among windows that come ordered by settled, hash, place."""
    names = ["doc_id", "part", "is_copy", "source", "source_part", "source_start", "start"]

    def give(doc, part, copy, source, start, pick) -> pa.RecordBatch:
        columns = [doc, part, copy, source[0], source[1].astype(np.int32), source[2].astype(np.int32), start]
        return pa.RecordBatch.from_arrays([pa.array(c[pick]) for c in columns], names=names)

    before: tuple | None = None  # hash of the last row, its place, the place of the hash's first row
    pending: tuple | None = None  # the first window of the last hash, while it has no copy
    for batch in batches:
        if not batch.num_rows:
            continue
        done, anchor, doc, part, start, dup, *own = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("settled", "anchor", "doc_id", "part", "start", "dup", "source", "source_part", "source_start"))
        if done.any():
            yield give(doc, part, done, own, start, done)
            anchor, doc, part, start, dup = (x[~done] for x in (anchor, doc, part, start, dup))
        if not len(anchor):
            continue
        new, same = np.ones(len(anchor), np.bool_), np.zeros(len(anchor), np.bool_)
        new[1:] = anchor[1:] != anchor[:-1]
        same[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (part[1:] == part[:-1]) & (start[1:] == start[:-1])
        if before is not None and before[0] == anchor[0]:
            new[0] = False
            same[0] = before[1] == (doc[0], part[0], start[0])
        run = np.cumsum(new)
        copies = ~new & ~same
        others = np.bincount(run[copies], minlength=run[-1] + 1)
        if pending is not None and others[0]:
            yield give(*(np.array([x]) for x in pending[:2]), np.zeros(1, np.bool_), [np.array([x]) for x in pending], np.array([pending[2]], np.int32), np.ones(1, np.bool_))
        if others[0] or run[-1]:
            pending = None
        first = new & ((others[run] > 0) | dup)
        head = np.flatnonzero(new)
        carried = before[2] if before is not None else (0, 0, 0)
        source = [np.concatenate([np.array([c], x.dtype), x[head]])[run] for c, x in zip(carried, (doc, part, start))]
        yield give(doc, part, copies, source, start, first | copies)
        if len(head) and not first[head[-1]]:
            pending = (doc[head[-1]], part[head[-1]], start[head[-1]])
        before = (anchor[-1], (doc[-1], part[-1], start[-1]), tuple(x[-1] for x in source))


def edge_matches(edges: DataFrame) -> DataFrame:
    """MATCHES of the windows of edge_texts()."""
    fine = edges.mapInArrow(tidy(windows), WINDOWS).withColumn("place", spread("anchor")).repartition("place").drop("place")
    fine = fine.sortWithinPartitions("settled", "anchor", "doc_id", "part", "start").mapInArrow(tidy(resolve), "doc_id bigint, part int, is_copy boolean, source bigint, source_part int, source_start int, start int")
    return fine.withColumn("end", F.col("start") + T)


def repeats(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """seeds.REPEATS of all maximal repeats of 50 words and more."""
    shared_checkpoints(spark)
    rows = grouped(seeds(docs)).checkpoint()
    fine = edge_matches(edge_texts(docs, rows.where(F.col("kind") == EDGE), spark))
    return merged(settled(rows).unionByName(fine.select(MATCHES)))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"), spark).drop("part")


def without_spans(texts: pa.Array, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str | None]:
    """The texts without the words start:end of the given rows, and what stands between those words."""
    w = words(texts)
    out = texts.to_pylist()
    count = np.diff(w.bounds)
    end = np.minimum(end, count[row])
    ok = start < end
    row, start, end = row[ok], start[ok], end[ok]
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), np.append(first, len(row))[1:].tolist()):
        r = int(row[a])
        at, parts = int(w.offsets[r]), []
        for x, y in zip(w.start[w.bounds[r] + start[a:b]].tolist(), w.end[w.bounds[r] + end[a:b] - 1].tolist()):
            parts.append(w.data[at : max(at, x)].tobytes())
            at = max(at, y)
        parts.append(w.data[at : w.offsets[r + 1]].tobytes())
        out[r] = b"".join(parts).decode("utf-8", "replace")
    return out


def without_copies(docs: DataFrame, spark: SparkSession, find: Callable[[DataFrame, SparkSession], DataFrame] = repeats) -> DataFrame:
    """docs with the copies cut out of text and n_chars set; first occurrences stay, a document of which no word is left goes."""
    cuts = find(docs, spark).where("is_copy").groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts"))
    # columns by their places: their names may be anything
    plain, names = named(docs)
    text, size = names["text"], names.get("n_chars")
    packed = plain.withColumns({"id__": F.col(names["doc_id"]).cast("long"), "part__": part_of(F.col(text).cast("string"))})
    both = packed.join(cuts, (F.col("id__") == cuts["doc_id"]) & (F.col("part__") == cuts["part"]), "left").select(*plain.columns, F.col("cuts").alias("cuts__"))
    schema = plain.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            held = batch.column("cuts__")
            size_of = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            columns = {c: batch.column(c) for c in schema.names}
            cut = np.flatnonzero(size_of)
            if len(cut):
                flat = held.drop_null().flatten()
                row = np.repeat(cut, size_of[cut])
                start, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                texts = without_spans(batch.column(text), row, start, end)
                columns[text] = pa.array(texts, batch.column(text).type)
                if size:
                    old = columns[size].to_pylist()
                    columns[size] = pa.array([len(texts[i]) if size_of[i] else old[i] for i in range(len(old))], columns[size].type)
            out = pa.RecordBatch.from_arrays(list(columns.values()), names=schema.names)
            yield out.filter(pa.array((size_of == 0) | (np.diff(words(columns[text]).bounds) > 0))) if len(cut) else out

    return both.mapInArrow(tidy(run), schema).toDF(*docs.columns)


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the copies out of text and set n_chars; a document of which no word is left goes, all others stay."""
    return without_copies(docs, spark)
