"""Vectorised word and hash tables shared by the corpus operators.

A word is a maximal run of ASCII letters and digits and of non-ASCII bytes, with ASCII
and Latin-1 letters in lower case.  All hashes are polynomial prefix sums modulo 2**64
that are finished with a bijective mix, so the hash of every span of bytes or words is
two gathers and a multiplication.  Null texts count as empty texts.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
CHUNK_BYTES = 1 << 20
FILTER_BITS = 1 << 25  # of the bitmap that keeps texts that nothing asks for from being shuffled
LONG_WORD = 256  # bytes from which a word has a cryptographic hash
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)

_WORD = np.zeros(256, np.bool_)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the table grows by doubling and is kept by the worker."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher on 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial sums of values (one more entry than there are values)."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(BASE, len(values))[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of values[start:end] for arrays of bounds, the same wherever the span lies."""
    raw = (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]
    return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of some texts: bounds[i]:bounds[i+1] are those of text i."""

    data: np.ndarray
    offsets: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them, nulls as empty texts."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_bytes(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    if len(low) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        upper = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
        low[upper] += 32
    return low


def words(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    n = len(data)
    inside = np.zeros(n + 2, np.bool_)
    inside[1:-1] = _WORD[data]
    first = np.zeros(n + 1, np.bool_)
    first[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    low = lower_bytes(data)
    hashes = spans(prefix(low.astype(U64) + U64(1)), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        # polynomials modulo 2**64 have collisions among very long strings of two letters
        hashes[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return Words(data, offsets, np.searchsorted(start, offsets), start, end, hashes)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about limit bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Give memory that is free in this process, Arrow's and the C library's, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run of mapInArrow(), so that a worker that waits for its next task doesn't keep the free memory of the last one."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of length[i] each, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return np.arange(total, dtype=np.int64) + shift


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def docs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, so that no other column of the input can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... and the new name of each; so a column may have any name."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text); part is a hash of the text that tells rows with the same doc_id apart."""
    return docs_of(docs).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("part"), "text")


def slot_of(part: Column) -> Column:
    return F.pmod(part, F.lit(FILTER_BITS).cast("long"))


def sent_slots(ids: DataFrame, spark: SparkSession) -> Broadcast:
    """The bitmap of the slots of ids' parts, of bounded size."""
    slots = ids.select(slot_of(F.col("part")).alias("p")).groupBy((F.col("p") / 8).cast("long").alias("byte")).agg(F.bit_or(F.pow(F.lit(2), F.col("p") % 8).cast("int")).cast("short").alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    bitmap[slots.column("byte").to_numpy()] = slots.column("bits").to_numpy()
    return spark.sparkContext.broadcast(bitmap)


def by_slots(rows: DataFrame, slot: Column, sent: Broadcast, there: bool = True) -> DataFrame:
    """rows whose slot is in the bitmap, or those whose slot is not."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("slot__").to_numpy()
            hit = (sent.value[p // 8] >> (p % 8).astype(np.uint8) & 1) == there
            yield batch.select(schema.names).filter(pa.array(hit))

    return rows.withColumn("slot__", slot).mapInArrow(tidy(run), schema)


def among(rows: DataFrame, ids: DataFrame, spark: SparkSession) -> DataFrame:
    """rows without most of those whose part is not in ids, by a bitmap of hashes of bounded size."""
    return by_slots(rows.select("doc_id", F.col("part").cast("long").alias("part"), "text"), slot_of(F.col("part")), sent_slots(ids, spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that of setCheckpointDir(); where neither is set, as in tests on one machine, a new one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="postlake-"))
    return context.getCheckpointDir()


def shared_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() write to shared_folder()."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges (a, b).

    Alternates large-star and small-star steps.  The minimum of every neighbourhood is an
    aggregate that is joined back, so a node of a million neighbours is no single row.
    Each round is checkpointed to shared storage and the loop ends when a round changes nothing.
    """
    shared_checkpoints(spark)
    now = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct().checkpoint()
    before = None
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        low = both.groupBy("u").agg(F.least("u", F.min("w")).alias("low"))
        large = both.join(low, "u").where("w > u").select(F.col("w").alias("v"), F.col("low").alias("m")).where("v <> m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(least, "v").select("v", "m", "low")
        now = small.select(F.col("m").alias("v"), F.col("low").alias("m")).unionByName(least.select("v", F.col("low").alias("m"))).where("v <> m").distinct().checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("m", "v"))).first()
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("m").alias("root"))
        before = state
