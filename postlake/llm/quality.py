"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad.  Its score for good is linear in features of the line
and of the lines before and after it; a transition weight for each pair of neighbouring
labels ties the chain together.  The marginal probabilities of good come from the
forward-backward algorithm, and a document's quality is their mean weighted by the lines'
lengths.

The weights are fitted by gradient ascent on the conditional likelihood of the labelled
documents' lines, each of which takes its document's label, over a sample bounded by
SAMPLE_DOCS documents.  All their lines are used; for fitting, a chain of more than
CHAIN lines counts as several.  All lines of all documents are scored in whole chains.

Defined results: null, empty and blank texts have quality null, 0 lines and keep false.
Blank lines are no lines.  Without labels of both kinds every document with lines has
quality 1.  Conflicting labels of a document count as bad; null labels are ignored.
Repeated rows give repeated rows, a null doc_id is carried through, other columns are ignored;
an empty table has no rows.  Very long texts are scored whole, with memory in proportion to their lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunks, docs_of, mix, prefix, spans, table, words

SAMPLE_DOCS = 4000  # labelled documents to fit to, at most
CHAIN = 128  # lines of a chain in fitting
MIN_QUALITY = 0.4
STEPS, RATE, SHRINK = 300, 0.05, 1e-3
SCHEMA = "doc_id bigint, quality double, n_lines int, bad_lines int, keep boolean"
NAMES = ("one", "length", "letters", "upper", "digits", "marks", "symbols", "words", "word_length", "distinct", "repeated", "stop")

_CLASS = np.full(256, 5, np.uint8)  # 0 lower or not ASCII, 1 upper, 2 digit, 3 space, 4 mark, 5 symbol
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, text index, length in bytes) of all lines that aren't blank."""
    w = words(texts)
    n = len(w.data)
    if not n:
        return np.zeros((0, len(NAMES))), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.unique(np.concatenate([w.offsets[:-1][np.diff(w.offsets) > 0], np.flatnonzero(w.data == 10) + 1]))
    start = start[start < n]
    kinds = _CLASS[w.data]
    count = np.stack([np.add.reduceat((kinds == k).astype(np.int32), start) for k in range(6)], axis=1).astype(float)
    size = count.sum(axis=1)
    solid = size - count[:, 3]
    doc = np.searchsorted(w.offsets, start, "right") - 1
    line_of = np.searchsorted(start, w.start, "right") - 1
    number = np.bincount(line_of, minlength=len(start))
    letters = np.bincount(line_of, weights=w.end - w.start, minlength=len(start))
    pair = np.unique(mix(w.hash) ^ mix(line_of.astype(U64)), return_index=True)[1]
    distinct = np.bincount(line_of[pair], minlength=len(start))
    short = np.bincount(line_of, weights=(w.end - w.start) <= 3, minlength=len(start))
    bounds = np.searchsorted(w.start, np.append(start, n))
    whole = mix(spans(prefix(w.hash), bounds[:-1], bounds[1:])) ^ mix(doc.astype(U64))
    first = np.unique(whole, return_index=True)[1]
    again = np.ones(len(start))
    again[first] = 0
    s, m = np.maximum(solid, 1), np.maximum(number, 1)
    x = np.stack([np.ones(len(start)), np.log1p(size) / 5, (count[:, 0] + count[:, 1]) / s, count[:, 1] / s, count[:, 2] / s, count[:, 4] / s, count[:, 5] / s, np.log1p(number) / 4, letters / m / 10, distinct / m, again, short / m], axis=1)
    keep = solid > 0
    return x[keep], doc[keep], size[keep].astype(np.int64)


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and after it, zero at a document's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (doc[1:] == doc[:-1])[:, None]
        before[1:] = x[:-1] * same
        after[:-1] = x[1:] * same
    return np.concatenate([x, before, after], axis=1)


def chains(doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line indexes, mask) of documents of like numbers of lines, as padded matrices."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(doc)))
    level = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    for k in np.unique(level):
        mine = level == k
        most = int(length[mine].max())
        step = np.arange(most)
        mask = step[None, :] < length[mine][:, None]
        yield np.where(mask, first[mine][:, None] + step[None, :], 0), mask


@dataclass
class Model:
    weight: np.ndarray  # of the features, for good against bad
    turn: np.ndarray  # 2 x 2, of label pairs; 0 is bad


def forward_backward(score: np.ndarray, mask: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of good, expected label pairs of each chain, and log partition; score is that of good, bad has 0."""
    n, t = score.shape
    emit = np.stack([np.zeros_like(score), score], axis=2) * mask[:, :, None]
    forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    forward[:, 0] = emit[:, 0]
    for i in range(1, t):
        step = np.logaddexp(forward[:, i - 1, 0, None] + turn[0], forward[:, i - 1, 1, None] + turn[1]) + emit[:, i]
        forward[:, i] = np.where(mask[:, i, None], step, forward[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = np.logaddexp(turn[:, 0] + (emit[:, i + 1] + backward[:, i + 1])[:, 0, None], turn[:, 1] + (emit[:, i + 1] + backward[:, i + 1])[:, 1, None])
        backward[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
    z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    good = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None]) * mask
    pairs = np.zeros((n, 2, 2))
    if t > 1:
        joint = forward[:, :-1, :, None] + turn + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pairs = (np.exp(joint) * mask[:, 1:, None, None]).sum(axis=1)
    return good, pairs, z


def marginals(model: Model, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    score = with_neighbours(x, doc) @ model.weight
    out = np.zeros(len(x))
    for at, mask in chains(doc):
        out[at[mask]] = forward_backward(score[at], mask, model.turn)[0][mask]
    return out


def train(x: np.ndarray, chain: np.ndarray, label: np.ndarray, doc: np.ndarray | None = None) -> Model:
    """Gradient ascent (Adam) on the mean conditional log likelihood of the lines' labels, which are 0 or 1.

    A line's neighbours are those of its document, whichever chain they are in.
    """
    features = with_neighbours(x, chain if doc is None else doc)
    batches = list(chains(chain))
    theta = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    # documents of either label weigh the same in all
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    for step in range(1, STEPS + 1):
        weight, turn = theta[:-4], theta[-4:].reshape(2, 2)
        score = features @ weight
        slope = np.zeros_like(theta)
        for at, mask in batches:
            good, pairs, _ = forward_backward(score[at], mask, turn)
            y, s = label[at] * mask, share[at[:, 0]]
            residual = ((y - good) * mask * s[:, None])[mask]
            slope[:-4] += residual @ features[at[mask]]
            seen = np.zeros_like(pairs)
            if mask.shape[1] > 1:
                for a in (0, 1):
                    for b in (0, 1):
                        seen[:, a, b] = ((label[at[:, :-1]] == a) & (label[at[:, 1:]] == b) & mask[:, 1:]).sum(axis=1)
            slope[-4:] += ((seen - pairs) * s[:, None, None]).sum(axis=0).ravel()
        slope = slope / len(label) - SHRINK * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + RATE * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        x, doc, _ = line_features(batch.column("text"))
        number = np.bincount(doc, minlength=batch.num_rows)
        use = np.flatnonzero(number > 0)
        rows = [x[np.searchsorted(doc, i) : np.searchsorted(doc, i, "right")].ravel() for i in use]
        pick = pa.array(use)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pick), batch.column("good").take(pick), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "good", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """The model of the sample_docs labelled documents of lowest id hash; None without labels of both kinds."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("good")).where("id is not null and good is not null")
    sample = known.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    # the sample has sample_docs rows of two numbers, whatever the input's size
    rows = docs_of(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("doc_id", "good", "text")
    rows = rows.mapInArrow(_sample_features, "doc_id bigint, good int, x array<double>").orderBy("doc_id", "x").collect()
    if len({r["good"] for r in rows}) < 2:
        return None
    x = [np.array(r["x"]).reshape(-1, len(NAMES)) for r in rows]
    number = [len(a) for a in x]
    doc = np.repeat(np.arange(len(rows)), number)
    part = np.concatenate([np.arange(n) // CHAIN for n in number])
    chain = np.cumsum(np.append(0, (np.diff(doc) != 0) | (np.diff(part) != 0)))
    return train(np.concatenate(x), chain, np.repeat([r["good"] for r in rows], number), doc)


def score(docs: DataFrame, model: Model | None, min_quality: float = MIN_QUALITY) -> DataFrame:
    """(doc_id, quality, n_lines, bad_lines, keep) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            x, doc, size = line_features(batch.column("text"))
            good = marginals(model, x, doc) if model else np.ones(len(x))
            n = batch.num_rows
            weight = np.bincount(doc, weights=size, minlength=n)
            quality = np.bincount(doc, weights=size * good, minlength=n) / np.maximum(weight, 1)
            number = np.bincount(doc, minlength=n)
            bad = np.bincount(doc, weights=good < 0.5, minlength=n)
            none = number == 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(quality, mask=none), pa.array(number.astype(np.int32)), pa.array(bad.astype(np.int32)), pa.array(~none & (quality >= min_quality))], names=["doc_id", "quality", "n_lines", "bad_lines", "keep"])

    return docs_of(docs).mapInArrow(run, SCHEMA)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
