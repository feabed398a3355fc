"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text has H[0] = 1 and H[i + 1] = (H[i] * B + c[i]) mod P for its code
points c, for two primes P and bases B at once.  The hash of any span i:j is
H[j] - H[i] * B**(j - i), so two spans of any documents are compared in constant time, and
because equality of prefixes is monotone, their longest common extension is found by binary
search.  prefix_array(), span() and extension() do this for code points.

fingerprints() works over whole tables.  The fingerprint of a document is H at its end.  The
hashes of its openings of RUNG, 2 RUNG, 4 RUNG, ... code points lead to the document it is
compared with: the first one that shares the longest opening which an earlier document shares
with it.  Of the two texts the prefix arrays are made again, and binary search over span
hashes gives how many code points they have in common from the start and from the end.

Defined results: null and empty texts have fingerprint 1 + 2**31 (that of no code points)
and 0 characters, and have no twin.  A text of under RUNG code points is compared with none.  The
first document is the one of smallest doc_id, of rows that share it the one with the smallest
hash of its text; twin_id is null for it, and near_id is null without an earlier document
that shares an opening.  Rows that share a doc_id but not the text are documents of their own.  Repeated rows
give repeated rows, a null doc_id is carried through but is never first nor compared, and other columns
are ignored.  Very long texts are hashed whole, with memory in proportion to their length; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, among, chunks, docs_of, rows_of, shared_checkpoints, table

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 1_664_525_007)
INVERSES = tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES))
RUNG = 32
SALTS, FEW, SHARE = 16, 4, 64  # parts that a document's partners are counted in, partners of a part that stay together, and size of a share
PRINTS = "doc_id bigint, part bigint, n_chars int, fingerprint bigint, openings array<bigint>"
_tables: dict[tuple[int, int], np.ndarray] = {}


def power_table(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo prime, kept by the worker and doubled as longer texts come."""
    have = _tables.get((base, prime), np.ones(1, U64))
    while len(have) <= n:
        have = np.concatenate([have, have * U64(pow(base, len(have), prime)) % U64(prime)])
    _tables[base, prime] = have
    return have


def _prefixes(points: np.ndarray, first: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """H of the text that begins at first[of], up to the places at, both primes in one number."""
    out = np.zeros(len(at), U64)
    begins = np.zeros(len(points) + 1, np.int64)
    length = np.diff(np.append(first, len(points)))
    begins = np.repeat(first, length)
    place = np.arange(len(points)) - begins
    longest = int(length.max()) if len(length) else 0
    for base, inverse, prime in zip(BASES, INVERSES, PRIMES):
        up, down, p = power_table(base, prime, longest), power_table(inverse, prime, longest), U64(prime)
        sums = np.zeros(len(points) + 1, U64)
        np.cumsum(points * down[place] % p, out=sums[1:])
        n = at - first[of]
        body = (sums[at] - sums[first[of]]) % p * up[np.maximum(n - 1, 0)] % p
        out = out << U64(31) | (up[n] + body) % p
    return out


def prefix_array(text: str) -> np.ndarray:
    """H[0] .. H[len(text)], both primes packed in one number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    at = np.arange(len(points) + 1)
    return _prefixes(points, np.zeros(1, np.int64), at, np.zeros(len(at), np.int64))


def span(h: np.ndarray, i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
    """The hash of i:j from the H at i and at j, as if the span stood alone."""
    return _span(h[i], h[j], np.asarray(j) - np.asarray(i))


def _span(hi: np.ndarray, hj: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = U64(0)
    for shift, base, prime in zip((31, 0), BASES, PRIMES):
        up, p, mask = power_table(base, prime, int(np.max(n, initial=0))), U64(prime), U64((1 << 31) - 1)
        a, b = (np.asarray(hi) >> U64(shift)) & mask, (np.asarray(hj) >> U64(shift)) & mask
        out = out << U64(31) | (b + p - a * up[n] % p + up[n]) % p
    return out


def extension(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How many code points agree from place i of the text with prefix array a and place j of that with b."""
    low, high = 0, min(len(a) - 1 - i, len(b) - 1 - j)
    while low < high:
        middle = (low + high + 1) // 2
        if span(a, i, i + middle) == span(b, j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, first place and length of each)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    length = np.array([len(t) for t in texts], np.int64)
    return points, np.cumsum(length) - length, length


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        points, first, length = _points(texts)
        number = np.where(length >= RUNG, np.floor(np.log2(np.maximum(length, RUNG) // RUNG)).astype(int) + 1, 0)
        of = np.repeat(np.arange(len(texts)), number)
        offsets = np.concatenate([[0], np.cumsum(number)])
        rung = np.arange(len(of)) - offsets[:-1][of]
        some = np.flatnonzero(length)
        hashes = _prefixes(points, first, np.concatenate([first[of] + (RUNG << rung), (first + length)[some]]), np.concatenate([of, some])).view(np.int64)
        whole = np.full(len(texts), 1 << 31 | 1, np.int64)
        whole[some] = hashes[len(of) :]
        openings = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes[: len(of)]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(length.astype(np.int32)), pa.array(whole), openings], names=["doc_id", "part", "n_chars", "fingerprint", "openings"])


def extensions(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points that each pair of texts has in common from the start and from the end, by binary search over span hashes."""
    sides = []
    for texts in (left, right):
        points, first, length = _points(texts)
        at = np.arange(len(points) + len(texts))
        of = np.repeat(np.arange(len(texts)), length + 1)
        # H of every text in a row of length + 1 places
        row = first + np.arange(len(texts))
        place = at - row[of]
        sides.append((_prefixes(points, first, first[of] + place, of) if len(points) else np.full(len(at), 1 << 31 | 1, U64), row, length))
    (h, p, n), (g, q, m) = sides
    found = []
    for from_end in (False, True):
        low, high = np.zeros(len(n), np.int64), np.minimum(n, m)
        while (low < high).any():
            middle = (low + high + 1) // 2
            i, j = (n - middle, m - middle) if from_end else (np.zeros_like(middle),) * 2
            same = _span(h[p + i], h[p + i + middle], middle) == _span(g[q + j], g[q + j + middle], middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(low, middle - 1))
        found.append(low)
    return found[0], found[1]


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        head, tail = extensions(batch.column("text").to_pylist(), batch.column("other").to_pylist())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "near_id")), pa.array(head.astype(np.int32)), pa.array(tail.astype(np.int32))], names=["doc_id", "part", "near_id", "head_chars", "tail_chars"])


def fingerprints(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """(doc_id, n_chars, fingerprint, twin_id, near_id, head_chars, tail_chars) of every row of docs.

    What is first is an aggregate that is joined back, so that an opening of very many
    documents is spread by adaptive skew handling.  Only the texts of documents that are
    compared are shuffled.
    """
    shared_checkpoints(spark)
    rows = docs_of(docs).withColumn("part", F.xxhash64("text")).mapInArrow(_print, PRINTS).checkpoint()
    place = F.struct("doc_id", "part")
    known = rows.where("doc_id is not null").groupBy("doc_id", "part").agg(F.min("n_chars").alias("n_chars"), F.min("fingerprint").alias("fingerprint"), F.min("openings").alias("openings"))
    # documents of one text agree in part, so they are gathered by it
    twins = known.where("n_chars > 0").groupBy(F.col("fingerprint").alias("f"), F.col("n_chars").alias("n")).agg(F.min("doc_id").alias("twin"))
    rungs = known.select("doc_id", "part", F.posexplode("openings").alias("rung", "opening"))
    first = rungs.groupBy(F.col("rung").alias("r"), F.col("opening").alias("o")).agg(F.min(place).alias("first"), F.count("*").alias("many")).where("many > 1")
    near = rungs.join(first, (F.col("rung") == F.col("r")) & (F.col("opening") == F.col("o"))).where(F.col("first") < place)
    near = near.groupBy("doc_id", "part").agg(F.max_by("first", "rung").alias("near")).select("doc_id", "part", F.col("near.doc_id").alias("near_id"), F.col("near.part").alias("near_part")).checkpoint()
    ends = near.select("doc_id", "part").unionByName(near.select(F.col("near_id").alias("doc_id"), F.col("near_part").alias("part"))).distinct()
    texts = among(rows_of(docs), ends, spark).join(ends, ["doc_id", "part"]).repartition("doc_id", "part").dropDuplicates(["doc_id", "part"])
    # a document that very many are compared with is there once for every share of them; they are counted in SALTS parts
    counted = near.withColumn("s", F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)))
    many = counted.groupBy("near_id", "near_part", "s").agg(F.count("*").alias("n"))
    share = F.when(F.col("n") > FEW, F.col("s") * (1 << 32) + 1 + F.pmod(F.xxhash64("part", "doc_id"), F.ceil(F.col("n") / SHARE))).otherwise(0)
    salted = counted.join(many, ["near_id", "near_part", "s"]).withColumn("salt", share).drop("s", "n")
    shares = salted.select("near_id", "near_part", "salt").distinct()
    others = shares.join(texts.select(F.col("doc_id").alias("near_id"), F.col("part").alias("near_part"), F.col("text").alias("other")), ["near_id", "near_part"])
    pairs = salted.join(texts, ["doc_id", "part"]).join(others, ["near_id", "near_part", "salt"])
    found = pairs.select("doc_id", "part", "near_id", "text", "other").mapInArrow(_extend, "doc_id bigint, part bigint, near_id bigint, head_chars int, tail_chars int")
    both = rows.join(twins, (F.col("fingerprint") == F.col("f")) & (F.col("n_chars") == F.col("n")), "left").join(found, ["doc_id", "part"], "left")
    return both.select("doc_id", "n_chars", "fingerprint", F.when(F.col("twin") < F.col("doc_id"), F.col("twin")).alias("twin_id"), "near_id", "head_chars", "tail_chars")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), spark)


_HASH = "list_reduce(list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (h * {b} + c) % {p}, 1::BIGINT)"
_COMMON = "CASE WHEN near_id IS NOT NULL THEN coalesce(list_min(list_filter(range(1, most + 1), lambda i: a[{i}] <> b[{i}])) - 1, most)::INTEGER END"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT doc_id, t, length(t)::INTEGER AS n_chars,
    CASE WHEN t = '' THEN 2147483649 ELSE {_HASH.format(text="t", b=BASES[0], p=PRIMES[0])} * 2147483648 + {_HASH.format(text="t", b=BASES[1], p=PRIMES[1])} END AS fingerprint,
    min(doc_id) OVER (PARTITION BY t) AS twin
  FROM d
), r AS (SELECT doc_id, k, left(t, {RUNG} * (1 << k)) AS o FROM d, range(0, 26) AS x(k) WHERE length(t) >= {RUNG} * (1 << k)),
w AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY k, o) AS first FROM r),
near AS (SELECT doc_id, max_by(first, k) AS near_id FROM w WHERE first < doc_id GROUP BY doc_id),
x AS (
  SELECT f.*, near_id, string_split(f.t, '') AS a, string_split(o.t, '') AS b, least(length(f.t), length(o.t)) AS most
  FROM f LEFT JOIN near USING (doc_id) LEFT JOIN d AS o ON o.doc_id = near_id
)
SELECT doc_id, n_chars, fingerprint, CASE WHEN t <> '' AND twin <> doc_id THEN twin END AS twin_id, near_id,
  {_COMMON.format(i="i")} AS head_chars, {_COMMON.format(i="-i")} AS tail_chars
FROM x
"""
