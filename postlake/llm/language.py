"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of pieces of labelled texts,
taken from all over them.  A text is
put in lower case and encoded with each dictionary in blocks of BLOCK bytes, each block
afresh, so that a long text goes on being compared with the dictionaries and not with
itself.  The language of the smallest code wins, and the text is rejected when the margin
of the runner-up, as a share of the smallest code, is narrow.

Defined results: a null, empty or blank text, and every text when fewer than two languages
are known, has lang_pred null, margin 0 and accepted false.  Ties go to the language that
sorts first and have margin 0, so they are rejected.  Long texts are encoded whole.
Repeated rows give repeated rows; a null doc_id is carried through.  Other columns are
ignored by classify() and kept as they are by stage_language().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, docs_of, named, shared_checkpoints, table, tidy

SAMPLE_DOCS = 256  # labelled documents of a language that its dictionary is made of, at most
DICT_BYTES = 64 << 10  # size of a dictionary, at most
LEAST_BYTES = 4 << 10  # size up to which dictionaries are filled even if another language has less
PIECE = 64  # characters of a text that are taken at one place
BLOCK = 2048
LEVEL = 3
MIN_MARGIN = 0.01  # of the smallest code
SCHEMA = "doc_id bigint, lang_pred string, margin double, accepted boolean"


def fit(labelled: DataFrame, lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries from a bounded sample: the sample_docs documents of each language with the lowest id hash.

    The sample is chosen on ids alone; texts are read for the chosen ids only.  The bytes of
    a dictionary are shared equally among the sampled documents, and what short ones leave
    goes to the longer ones, so that no long document fills it while others have more to
    give, and few documents fill it as well as many.  A document longer than its share gives
    pieces from every part of its text: the text is cut into as many equal parts as there are
    pieces, and the place in each part is a hash of the id and the part's number.

    All dictionaries have the size that the language with the least text can fill (but
    LEAST_BYTES if that is less), as a larger one would win by its size.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    ids = rows.select("lang", "doc_id").where("lang is not null and doc_id is not null").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs)
    shared_checkpoints(labelled.sparkSession)
    # chosen has sample_docs rows a language at most, whatever the input's size
    sample = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).where("text <> ''").distinct().checkpoint()
    sizes: dict[str, list[int]] = {}
    for r in sample.select("lang", F.octet_length("text").alias("n")).collect():
        sizes.setdefault(r["lang"], []).append(r["n"] + 1)
    if not sizes:
        return {}
    dict_bytes = min(dict_bytes, max(LEAST_BYTES, min(map(sum, sizes.values()))))
    # a table of Arrow, as a list would need Python workers of another kind, which stay beside the others
    shares = labelled.sparkSession.createDataFrame(pa.table({"lang": pa.array(list(sizes), pa.string()), "share": pa.array([level(v, dict_bytes) for v in sizes.values()], pa.int64())}))
    # n characters, of which the share holds most; the line feed after each piece counts
    n, most = F.length("text").cast("long"), F.floor(F.col("share") * F.length("text") / F.octet_length("text"))
    number = F.greatest(F.lit(1), F.floor(F.col("most") / PIECE))
    width = F.least(F.lit(PIECE), F.greatest(F.lit(2), F.col("most"))) - 1
    room = F.greatest(F.lit(0), F.floor(F.col("n") / F.col("number")) - F.col("width"))
    place = lambda k: F.floor(k * F.col("n") / F.col("number")) + F.pmod(F.xxhash64("doc_id", k), F.col("room") + 1) + 1
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.col("number") - 1), lambda k: F.substr(F.col("text"), place(k).cast("int"), F.col("width").cast("int")))
    sample = sample.join(F.broadcast(shares), "lang").withColumns({"n": n, "most": most}).withColumn("number", number).withColumn("width", width).withColumn("room", room)
    part = F.when(F.octet_length("text") < F.col("share"), F.col("text")).otherwise(F.array_join(pieces, "\n"))
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in sample.select("lang", "rank", part.alias("part")).collect():
        parts.setdefault(r["lang"], []).append((r["rank"], r["part"]))
    return {k: "\n".join(x for _, x in sorted(v)).encode()[:dict_bytes] for k, v in sorted(parts.items())}


def level(sizes: list[int], total: int) -> int:
    """The share of each so that together they take total, where none takes more than its size; 1 at least."""
    left = total
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) >= left:
            return max(1, left // (len(sizes) - k))
        left -= size
    return total


def coder(dictionaries: dict[str, bytes], level: int = LEVEL) -> Callable[[list], tuple[np.ndarray, np.ndarray]]:
    """A function of texts: index of the best language in sorted order (-1: none) and margin."""
    coders = []
    for name in sorted(dictionaries):
        d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def run(texts: list) -> tuple[np.ndarray, np.ndarray]:
        best, margin = np.full(len(texts), -1), np.zeros(len(texts))
        for i, text in enumerate(texts):
            if len(coders) < 2 or not text or text.isspace():
                continue
            raw = text.lower().encode()
            blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
            sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
            first, second = sorted(sizes)[:2]
            best[i], margin[i] = sizes.index(first), (second - first) / first
        return best, margin

    return run


def classify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, margin, accepted) for every row of docs."""
    names = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(dictionaries)
        for batch in batches:
            best, margin = encode(batch.column("text").to_pylist())
            pred = pa.array([names[b] if b >= 0 else None for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pred, pa.array(margin), pa.array((best >= 0) & (margin >= min_margin))], names=["doc_id", "lang_pred", "margin", "accepted"])

    return docs_of(docs).mapInArrow(run, SCHEMA)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose language is accepted, with all their columns; null, empty and blank texts are not."""
    dictionaries = fit(docs)
    plain, names = named(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(dictionaries)
        for batch in chunks(batches, names["text"]):
            best, margin = encode(batch.column(names["text"]).to_pylist())
            yield batch.filter(pa.array((best >= 0) & (margin >= MIN_MARGIN)))

    return plain.mapInArrow(tidy(keep), plain.schema).toDF(*docs.columns)
