"""Each corpus operator against brute force, exact round trips or held-out labels, and on awkward tables."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard

import corpus_pipeline
from conftest import DATA
from oracle import actual, expected
from postlake.llm import common, decontaminate, fingerprints, language, neardup, packing, quality, substrings, suffixes, tokenids, toxicity

CLASHING = ["id", "__id", "__cuts", "row", "key", "a", "b", "hub", "anchor", "start", "words", "shard", "f", "o", "toxic", "good", "a.b", "c0", "id__", "part", "part__", "node", "first", "x`y", "settled", "rank__"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", `{c.replace('`', '``')}` int" for c in CLASHING)


def documents(spark, rows):
    """rows: (doc_id, text, lang), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "web", None if t is None else len(t), *range(len(CLASHING))) for i, t, g in rows], SCHEMA)


def prose(seed, n, vocabulary=None):
    r = random.Random(seed)
    vocabulary = vocabulary or [f"{a}{b}{c}" for a in "bcdfgklmnprst" for b in "aeiou" for c in ("n", "rt", "sk", "l")]
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def table():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def awkward(spark):
    long = prose(1, 60_000)
    rows = [(None, None, None), (None, prose(2, 80), "en"), (1, None, "en"), (2, "", "en"), (3, "   \n", None), (4, "x", "en"), (5, "?!", "de"), (6, prose(3, 120), "en"), (6, prose(3, 120), "en"), (6, prose(4, 120), "de"), (7, prose(3, 120), "de"), (8, long, "en"), (9, long, "de"), (10, "l" * 200_000, "en")]
    return documents(spark, rows).checkpoint()


def operators(spark):
    bench = spark.createDataFrame([(1, prose(3, 120)), (None, "x"), (2, None), (3, "")], "item_id bigint, text string")
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (8, 1, 0), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    return {
        "op1": lambda d: decontaminate.contaminated(d, bench, spark), "op2": lambda d: packing.packing(d, spark), "op3": lambda d: language.classify(d, language.fit(d)), "op4": lambda d: substrings.repeats(d, spark),
        "op5": lambda d: toxicity.toxic(d, toxicity.fit(d, labels)), "op6": lambda d: suffixes.repeats_by_suffixes(d, spark), "op7": lambda d: tokenids.tokens_to_blocks(d, spark), "op8": lambda d: fingerprints.fingerprints(d, spark),
        "op9": lambda d: neardup.near_duplicates(d, spark), "op10": lambda d: quality.score(d, quality.fit(d, labels)),
    }


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_awkward_and_empty_tables(spark, awkward, name):
    run = operators(spark)[name]
    assert run(awkward.where("false")).collect() == []
    found = run(awkward).collect()
    if name in ("op3", "op8", "op10"):
        assert len(found) == 14  # one row for every row of the input
    if name == "op1":
        assert {(r["doc_id"], r["item_id"]) for r in found} == {(6, 1), (7, 1)}
    if name == "op2":
        assert sum(r["length"] for r in found if r["doc_id"] == 8) == 60_000 and {r["copy"] for r in found if r["doc_id"] == 6} == {0, 1, 2}
        assert [r["length"] for r in found if r["doc_id"] in (1, 2, 3, 4, 5)] == [1] * 5 and sorted(r["length"] for r in found if r["doc_id"] is None) == [1, 80]
    if name in ("op4", "op6"):
        assert {(r["doc_id"], r["is_copy"], r["n_words"], r["source_doc_id"], r["source_start"]) for r in found} == {(6, False, 120, None, None), (7, True, 120, 6, 0), (8, False, 60_000, None, None), (9, True, 60_000, 8, 0)}
    if name == "op9":
        # the other text of doc_id 6 is in no group
        assert {tuple(r) for r in found} == {(6, 6, True, 1), (7, 6, False, 1), (8, 8, True, 1), (9, 8, False, 1)}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, awkward, name, stage):
    for docs in (awkward, awkward.where("false")):
        out = stage(spark, docs, DATA)
        assert out.dtypes == docs.dtypes
        kept = out.select("doc_id").collect()
        if name != "language_id" and docs is awkward:
            assert None in {r["doc_id"] for r in kept} and 4 in {r["doc_id"] for r in kept}


def test_components_match_union_find(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in root if find(x) != x}
    got = common.components(spark.createDataFrame(pairs, "a bigint, b bigint"), spark)
    assert {(r["node"], r["root"]) for r in got.collect()} == want


def shingles(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_near_duplicates_against_all_pairs(spark, table):
    docs = {r["doc_id"]: shingles(r["text"] or "") for r in table}
    groups = {r["doc_id"]: r["group_id"] for r in neardup.op9_near_duplicates(spark, DATA).collect()}
    near = [(a, b) for a, b in itertools.combinations(docs, 2) if docs[a] and docs[b] and len(docs[a] & docs[b]) >= 0.6 * len(docs[a] | docs[b])]
    assert near and sum(groups.get(a, -1) == groups.get(b, -2) for a, b in near) >= 0.9 * len(near)
    for a in groups:
        assert max(len(docs[a] & docs[b]) / max(1, len(docs[a] | docs[b])) for b in groups if b != a and groups[b] == groups[a]) > 0.25


def test_documents_that_share_half_their_text_stay_apart(spark):
    common_text = prose(40, 110)
    rows = [(i, f"{common_text} {prose(1000 + i, 90)}", "en") for i in range(2000)]
    twin = rows[7][1].split()
    rows.append((5000, " ".join(twin[:190] + ["changed"] * 3), "en"))
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.35 < len(a & b) / len(a | b) < neardup.THRESHOLD
    found = {(r["doc_id"], r["group_id"]) for r in neardup.near_duplicates(documents(spark, rows), spark).collect()}
    assert found == {(7, 7), (5000, 7)}


def test_near_duplicates_at_the_threshold_and_in_crowds(spark):
    rows, pairs = [], []
    for i in range(300):
        w = prose(5000 + i, 200)
        rows += [(2 * i, w, "en"), (2 * i + 1, " ".join(w.split()[: 126 + i % 8]) + " " + prose(6000 + i, 74 - i % 8), "en")]
        pairs.append((2 * i, 2 * i + 1))
    crowd = prose(41, 100)
    for i in range(300):
        own = prose(7000 + i, 60)
        rows += [(1000 + 2 * i, f"{crowd} {own} {prose(8000 + i, 40)}", "en"), (1001 + 2 * i, f"{crowd} {own} {prose(9000 + i, 40)}", "en")]
    for a, b in pairs:
        x, y = shingles(rows[a][1]), shingles(rows[b][1])
        assert neardup.THRESHOLD <= len(x & y) / len(x | y) < 0.52
    groups = {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(documents(spark, rows), spark).collect()}
    assert np.mean([groups.get(a, -1) == groups.get(b, -2) for a, b in pairs]) >= 0.9
    assert np.mean([groups.get(1000 + 2 * i, -1) == groups.get(1001 + 2 * i, -2) == 1000 + 2 * i for i in range(300)]) >= 0.9


def brute_repeats(rows, t=50):
    """(doc_id, is copy, words) of every document's words in windows that occur earlier, or only later."""
    seen, places = {}, {}
    w = common.words(pa.array([r["text"] for r in rows], pa.string()))
    for k in sorted(range(len(rows)), key=lambda k: rows[k]["doc_id"]):
        h = w.hash[w.bounds[k] : w.bounds[k + 1]].tolist()
        for i in range(len(h) - t + 1):
            seen.setdefault(tuple(h[i : i + t]), []).append((rows[k]["doc_id"], i))
    for found in seen.values():
        for n, (doc, i) in enumerate(found):
            if n or len(found) > 1:
                places.setdefault((doc, n > 0), set()).update(range(i, i + t))
    return {(d, c, x) for (d, c), s in places.items() for x in s}


@pytest.mark.parametrize("query", [substrings.op4_repeated_passages, suffixes.op6_previous_factors])
def test_repeats_against_all_windows(spark, table, query):
    found = query(spark, DATA).collect()
    got = {(r["doc_id"], r["is_copy"], x) for r in found for x in range(r["start_word"], r["end_word"])}
    assert got and got == brute_repeats(table)


@pytest.mark.parametrize("run", [substrings.repeats, suffixes.repeats_by_suffixes])
def test_passages_inside_other_text(spark, run):
    p = prose(7, 70)
    rows = [(i, f"{prose(100 + i, 30 + i)} {p.upper() if i % 2 else p} {prose(200 + i, 40)}", "en") for i in range(6)] + [(9, p + " " + p, "en"), (10, prose(7, 49), "en")]
    found = run(documents(spark, rows), spark).collect()
    got = {(r["doc_id"], r["is_copy"], x) for r in found for x in range(r["start_word"], r["end_word"])}
    assert got == brute_repeats([{"doc_id": i, "text": t} for i, t, _ in rows]) and len({g[0] for g in got}) == 7


def test_longest_previous_factors():
    r = np.random.default_rng(3)
    text = r.integers(0, 3, 300)
    length, source = suffixes.previous_factors(text, 16)
    for i in range(len(text)):
        best = 0
        for j in range(i):
            n = 0
            while i + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            best = max(best, n)
        assert min(length[i], 16) == min(best, 16)


def test_multi_index_finds_all_fingerprints_within_radius():
    r = np.random.default_rng(1)
    marks = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = marks[:200].copy()
    for k in range(200):
        for bit in r.choice(64, int(r.integers(0, 16)), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    ix = decontaminate.index(12, 1, marks, np.arange(400), np.zeros(400, np.int64))
    found = set(zip(*(x.tolist() for x in decontaminate.lookup(ix, near))))
    distance = np.bitwise_count(near[:, None] ^ marks[None, :])
    assert found == set(zip(*(x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS))))


def test_decontamination_catches_altered_items_and_leaves_clean_documents(spark):
    items = [(i, prose(i, n)) for i, n in enumerate((8, 14, 20, 30, 45, 80, 140, 600))]
    rows = [(100, prose(999, 3000), "en")]
    for i, text in items:
        w = text.split()
        for k in range(len(w) // 15):
            w[15 * k + 7] = "changed"
        rows += [(i, f"{prose(50 + i, 33 + i)} {text} {prose(70 + i, 60)}", "en"), (20 + i, f"{prose(80 + i, 41)} {' '.join(w)} {prose(90 + i, 50)}", "en")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents(spark, rows), bench, spark).collect()}
    assert got == {(i, i) for i, _ in items} | {(20 + i, i) for i, _ in items}


@pytest.mark.parametrize("n", (6, 8, 10, 13, 16, 19))
def test_short_items_in_part_and_altered_against_similarity(n):
    items = [prose(300 + 40 * n + i, n).split() for i in range(150)]
    table = decontaminate.item_table(list(range(150)), [" ".join(w) for w in items])
    indexes = table.indexes()
    size = lambda s: sum(len("".join(x)) for x in s)
    triples = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    for replaced, share in ((True, 0.1), (True, 0.2), (False, 0.3), (False, 0.4)):
        docs, want = [], set()
        for i, w in enumerate(items):
            r, k = random.Random(i), round(share * n)
            if replaced:
                hit = r.sample(range(n), k)
                there = [f"zz{x}" if j in hit else x for j, x in enumerate(w)]
            else:
                there = w[k:] if i % 2 else w[: n - k]
            docs.append(f"{prose(20 + i, r.randrange(1, 40))} {' '.join(there)} {prose(900 + i, 40)}")
            if size(triples(w) & triples(there)) >= decontaminate.MIN_SIMILARITY * size(triples(w)):
                want.add((i, i))
        got = {x[:2] for x in decontaminate.scan(table, indexes, common.words(pa.array(docs)))}
        assert len(want) > 10 and len(want & got) >= 0.95 * len(want)


def squares(bins, sizes):
    return sum(sum(sizes[i] for i in b) ** 2 for b in bins)


def test_packing_is_a_local_optimum():
    r = random.Random(2)
    for _ in range(20):
        sizes = sorted((r.choice((r.randint(1, 100), r.randint(30, 60))) for _ in range(120)), reverse=True)
        before, bins = packing.best_fit(sizes, 100), packing.pack(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(before) and squares(bins, sizes) >= squares(before, sizes)
        fill = [sum(sizes[i] for i in b) for b in bins]
        for x, y in itertools.permutations(range(len(bins)), 2):
            if fill[y] < fill[x] < 100:
                outs = [()] + [c for k in (1, 2) for c in itertools.combinations(bins[x], k)]
                for out in outs:
                    for come in (c for k in (1, 2) for c in itertools.combinations(bins[y], k) if len(out) + k <= 3 and (out or k == 1)):
                        gain = sum(sizes[i] for i in come) - sum(sizes[i] for i in out)
                        assert not 0 < gain <= 100 - fill[x]


def test_packing_query_places_every_word_once(spark, table):
    found = packing.op2_packing(spark, DATA).toPandas()
    words = {r["doc_id"]: max(1, len((r["text"] or "").split())) for r in table}
    assert found.groupby("doc_id")["length"].sum().to_dict() == words
    assert (found.groupby(["shard", "bin"])["length"].sum() == found.groupby(["shard", "bin"])["fill"].first()).all() and found["fill"].max() <= packing.CAPACITY


def test_language_matches_compression_by_hand_and_labels(spark, table):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    dictionaries = language.fit(docs)
    got = {r["doc_id"]: r for r in language.classify(docs, dictionaries).collect()}
    coders = {k: zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for k, d in dictionaries.items()}
    for r in table[:60]:
        if (r["text"] or "").strip():
            raw = r["text"].lower().encode()
            size = {k: sum(len(c.compress(raw[i : i + language.BLOCK])) for i in range(0, len(raw), language.BLOCK)) for k, c in coders.items()}
            assert abs(size[got[r["doc_id"]]["lang_pred"]] - min(size.values())) <= 0.02 * min(size.values())
    known = [r for r in table if r["lang"] in dictionaries and len((r["text"] or "").split()) >= 20 and got[r["doc_id"]]["accepted"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in known]) > 0.95


def test_language_dictionaries_come_from_whole_texts(spark, table):
    header = prose(77, 50)[:300]
    rows = [(r["doc_id"], f"{header} {r['text']}" if k % 10 else r["text"], r["lang"]) for k, r in enumerate(table) if r["lang"] and len((r["text"] or "").split()) >= 20]
    docs = documents(spark, rows)
    dictionaries = language.fit(docs)
    accepted = {r["doc_id"]: r["accepted"] for r in language.classify(docs, dictionaries).collect()}
    assert np.mean(list(accepted.values())) > 0.97
    # few long texts fill a dictionary, and each from all of its parts
    long = [(i, " ".join(f"w{i}x{k:05d}" for k in range(20_000)), g) for i, g in enumerate(("en", "en", "de"))]
    for name, d in language.fit(documents(spark, long)).items():
        assert 0.95 * language.DICT_BYTES < len(d) <= language.DICT_BYTES
        for i, _, g in long:
            places = [int(x) for x in re.findall(rf"w{i}x(\d{{5}})", d.decode())]
            assert g != name and not places or g == name and all(any(2000 * k <= x < 2000 * (k + 1) for x in places) for k in range(10))


def test_toxicity_folding_exceptions_and_brute_force(spark, table):
    filler = prose(4, 20)
    texts = ["you idіot", "you 1D10T!", "ｉｄｉｏｔ", "take out the trash can", "an idiotproof plan", "worthle$s scum", filler, "crétin", "what a ret4rd"]
    rows = [(i, f"{t} {filler}" if t != filler else t, "en") for i, t in enumerate(texts)]
    got = {r["doc_id"] for r in toxicity.toxic(documents(spark, rows)).collect()}
    assert got == {0, 1, 2, 5, 7, 8}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    both = toxicity.machines(lexicon, toxicity.EXCEPTIONS)
    terms = {toxicity.fold(k) for k in lexicon}
    for r in table[:80]:
        text = toxicity.fold(r["text"] or "")
        starts = {m.start() for t in terms for m in re.finditer(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", text)}
        plain = {m[0] for m in toxicity.matches(r["text"] or "", [both[0], toxicity.automaton({}, (), False)])}
        assert plain <= starts and bool(plain) == bool(starts)
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    found = {r["doc_id"] for r in toxicity.toxic(docs, lexicon).collect()}
    assert np.mean([(d in found) == bool(t) for d, t in labels.items()]) > 0.95


def test_token_blocks_round_trip_and_checksum(spark, table):
    blocks = tokenids.op7_token_blocks(spark, DATA)
    rows = tokenids.blocks_to_tokens(blocks).collect()
    with open(tokenids.VOCABULARY, "rb") as f:
        coder = tokenids.vocabulary(f.read())
    parts = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        parts.setdefault(r["doc_id"], []).extend(r["ids"])
    assert parts == {r["doc_id"]: coder.encode_ordinary(r["text"] or "") for r in table}
    coded = sum(len(r["payload"]) for r in blocks.collect())
    assert coded < 2 * sum(map(len, parts.values()))  # under 16 bits an id
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="checksum"):
        tokenids.blocks_to_tokens(blocks.withColumn("crc", F.col("crc") + 1)).collect()


def test_fingerprints_match_sql_and_extensions(spark):
    assert actual(fingerprints.op8_fingerprints(spark, DATA)) == expected(fingerprints.OP8_SQL, DATA)
    a, b = "xx" + "abc\néd" * 9 + "!", "abc\néd" * 9 + "?"
    ha, hb = fingerprints.prefix_array(a), fingerprints.prefix_array(b)
    for i, j in itertools.product(range(len(a)), range(0, len(b), 5)):
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert fingerprints.extension(ha, i, hb, j) == n


def test_marginals_against_all_labellings():
    r = np.random.default_rng(0)
    score, turn = r.normal(size=(3, 6)), r.normal(size=(2, 2))
    mask = np.arange(6)[None, :] < np.array([6, 1, 4])[:, None]
    good, pairs, z = quality.forward_backward(score, mask, turn)
    for row, n in enumerate((6, 1, 4)):
        weight, marginal = 0.0, np.zeros(6)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(score[row, i] * y[i] for i in range(n)) + sum(turn[y[i], y[i + 1]] for i in range(n - 1)))
            weight += w
            marginal[:n] += w * np.array(y)
        assert np.allclose(good[row], marginal / weight) and np.isclose(z[row], np.log(weight)) and np.isclose(pairs[row].sum(), n - 1)


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r["keep"] for r in quality.score(docs, quality.fit(docs, labels.where("doc_id % 2 = 0"))).collect()}
    held = [r for r in labels.where("doc_id % 2 = 1").collect() if r["quality"] is not None and r["doc_id"] in got]
    assert np.mean([got[r["doc_id"]] == bool(r["quality"]) for r in held]) > 0.9


def test_pipeline_runs_its_stages_in_order(spark, table):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substrings", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, DATA).toPandas()
    kept = set(out["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in table}
    copies = pd.Series(texts).groupby(pd.Series(texts)).transform("size") > 1
    assert kept < set(texts) and len({texts[d] for d in kept if copies[d]}) == len([d for d in kept if copies[d]])
    words = re.compile(r"[^\W_]+")
    flat = {d: " ".join(words.findall(texts[d].lower())) for d in kept if texts[d]}
    for item in pq.read_table(f"{DATA}/benchmark.parquet").column("text").to_pylist():
        assert not any(" ".join(words.findall(item.lower())) in t for t in flat.values())
