"""Rows that share a doc_id, hot groups worked off in parts, and brute force where the operators' own tests are loose."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard

import corpus_pipeline
from conftest import DATA
from postlake.llm import common, decontaminate, fingerprints, language, neardup, packing, quality, seeds, substrings, suffixes, toxicity
from test_operators import brute_repeats, documents, prose


def texts_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_look_at_rows_that_share_an_id_each_by_its_own_text(spark):
    passage, other, near = prose(1, 60), prose(2, 90), prose(3, 80)
    docs = documents(spark, [(1, passage, "en"), (6, f"{passage} {prose(4, 30)}", "en"), (6, other, "en"), (7, near, "en"), (8, near, "en"), (8, other + " more words here", "en")])
    cut = dict(((d, len(t.split())), t) for d, t in texts_of(substrings.without_copies(docs, spark)))
    assert cut[(6, 30)] == " " + prose(4, 30) and cut[(6, 90)] == other and (1, 60) in cut and (8, 3) in cut
    one = documents(spark, [(1, passage, "en"), (6, passage, "en"), (6, other, "en"), (6, other, "en")])
    assert texts_of(neardup.stage_near_duplicates(spark, one, DATA)) == [(1, passage), (6, other)]
    item = pq.read_table(f"{DATA}/benchmark.parquet").column("text")[0].as_py()
    two = documents(spark, [(1, f"{passage} {item}", "en"), (1, other, "en"), (2, near, "en")])
    assert texts_of(decontaminate.stage_decontaminate(spark, two, DATA)) == [(1, other), (2, near)]


def words_of(found):
    return {(r["doc_id"], r["is_copy"], x) for r in found for x in range(r["start_word"], r["end_word"])}


def hot(n=60):
    p, q = prose(7, 70), prose(8, 120)
    rows = [(i, f"{prose(100 + i, 10 + i % 7)} {p} {prose(200 + i, 12)}", "en") for i in range(n)] + [(500 + i, q, "en") for i in range(n)] + [(900, f"{q} {p} {p}", "en"), (900, f"{q} {p} {p}", "en")]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [2, 18])
@pytest.mark.parametrize("find", [substrings.repeats, suffixes.repeats_by_suffixes, lambda d, s: suffixes.repeats_by_suffixes(d, s, crowd=3)])
def test_hot_passages_and_their_sources(spark, monkeypatch, bits, find):
    monkeypatch.setattr(seeds, "CACHE_BITS", bits)
    rows = hot()
    found = find(documents(spark, rows).repartition(2), spark).collect()
    distinct = sorted({(i, t) for i, t, _ in rows})
    assert words_of(found) == brute_repeats([{"doc_id": i, "text": t} for i, t in distinct])
    text = {i: t.lower().split() for i, t in distinct}
    for r in found:
        if r["is_copy"]:
            source = text[r["source_doc_id"]][r["source_start"] : r["source_start"] + r["match_words"]]
            assert r["match_words"] >= 50 and source == text[r["doc_id"]][r["match_start"] : r["match_start"] + r["match_words"]]
            assert (r["source_doc_id"], r["source_start"]) < (r["doc_id"], r["match_start"]) and r["start_word"] <= r["match_start"] and r["match_start"] + r["match_words"] <= r["end_word"]
    assert len({(r["doc_id"], r["is_copy"], r["start_word"]) for r in found}) == len(found)


def test_combiner_settles_what_is_known_and_sends_the_rest():
    combine = seeds.Combiner()
    key = np.array([5, 5, 5, 9], np.int64)
    place = lambda *x: (np.array(x, np.int64), np.zeros(len(x), np.int32), np.zeros(len(x), np.int32))
    order, settled, source, _, _ = combine(key, *place(3, 1, 2, 4))
    # the two first of a key go on, the third is a copy of the first
    assert key[order].tolist() == [5, 5, 5, 9] and settled.tolist() == [False, False, True, False] and source[2] == 1
    assert combine(key[:2], *place(8, 0))[1].tolist() == [False, False]  # an earlier one takes the place
    _, settled, source, _, _ = combine(key[:2], *place(8, 8))
    assert settled.tolist() == [True, True] and source.tolist() == [0, 0]
    # repeated rows of the first place aren't copies of it
    other = seeds.Combiner()
    assert not other(np.zeros(3, np.int64), *place(1, 1, 1))[1].any() and not other(np.zeros(1, np.int64), *place(2))[1].any()


def test_suffix_arrays_remove_later_copies(spark):
    p = prose(9, 64)
    docs = documents(spark, [(1, f"start {p} end", "en"), (2, f"{prose(10, 20)} {p} {prose(11, 20)}", "en"), (3, p, "en"), (None, p, "en")])
    assert texts_of(suffixes.deduplicated(docs, spark).where("doc_id is not null")) == [(1, f"start {p} end"), (2, f"{prose(10, 20)}  {prose(11, 20)}")]


def test_regions_are_worked_off_in_parts():
    r = np.random.default_rng(4)
    n = 3000
    label, last = r.integers(0, 4, n).astype(np.int64) << 48, r.integers(0, 2, n).astype(np.int32)
    order = np.lexsort((np.arange(n), last, label))
    rows = [np.zeros(n, np.int64), label[order], last[order], np.arange(n, dtype=np.int64), np.zeros(n, np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "label", "last", "node", "root"])
    for stream in (200, 10_000):
        edges = set()
        for out in neardup._candidates(iter([batch.slice(i, 50) for i in range(0, n, 50)]), True, stream):
            edges |= set(zip(out.column("a").to_pylist(), out.column("b").to_pylist()))
        # the first row of the region is joined with all of them
        root = {i: i for i in range(n)}
        for a, b in edges:
            x, y = a, b
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        assert all(r == i or root[i] < i for i, r in root.items()) and sum(root[i] == i for i in root) == 1


def test_near_duplicate_links_against_all_pairs(spark):
    base = prose(20, 100).split()
    rows = [(i, " ".join(base[: 100 - i] + [f"x{i}y{k}" for k in range(i)]), "en") for i in range(0, 12, 2)] + [(50, prose(21, 60), "en"), (51, prose(21, 60), "en"), (52, prose(21, 60).upper(), "en")]
    found = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in neardup.near_duplicates(documents(spark, rows), spark).collect()}
    assert {d: found[d] for d in (50, 51, 52)} == {d: (50, 2) for d in (50, 51, 52)}
    assert {found[i] for i in range(0, 12, 2)} == {(0, 5)}


def test_long_sequences_of_one_polynomial_hash_are_no_copies(spark):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, other = (" ".join(pair[b] for b in bits) for pair in (("ab", "cd"), ("cd", "ab")))
    w = common.words(pa.array([one, other]))
    assert len(set(common.spans(common.prefix(w.hash), w.bounds[:-1], w.bounds[1:]).tolist())) == 1
    assert len(set(neardup.signatures(pa.array([one, other]))[1].tolist())) == 2
    assert len(set(common.words(pa.array(["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)])).hash.tolist())) == 2


def similarity(item, there):
    size = lambda s: sum(len("".join(x)) for x in s)
    triples = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return size(triples(item) & triples(there)) / size(triples(item))


def test_decontamination_query_against_all_places(spark):
    """Every document and item of the smallest tables, by the share of the item's shingles in the best place."""
    items = {r["item_id"]: re.findall(r"[^\W_]+", r["text"].lower()) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()}
    docs = {r["doc_id"]: re.findall(r"[^\W_]+", (r["text"] or "").lower()) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.op1_decontamination(spark, DATA).collect()}
    grams = {}
    for i, w in items.items():
        for k in range(len(w) - 2):
            grams.setdefault(tuple(w[k : k + 3]), []).append((i, k))
    want = {}
    for d, w in docs.items():
        places = {(i, p - k) for p in range(len(w) - 2) for i, k in grams.get(tuple(w[p : p + 3]), ())}
        for i, begin in places:
            s = similarity(items[i], w[max(0, begin - decontaminate.SLACK) : begin + len(items[i]) + decontaminate.SLACK])
            if s >= decontaminate.MIN_SIMILARITY:
                want[d, i] = max(want.get((d, i), 0), s)
    assert set(got) <= set(want) and len(set(got) & set(want)) >= 0.97 * len(want)
    assert sum(abs(got[k] - want[k]) < 1e-9 for k in got) >= 0.97 * len(got)


def test_decontamination_of_long_texts_and_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 400)
    items = [(1, prose(60, 30)), (2, prose(61, 700)), (3, prose(62, 15))]
    text = f"{prose(63, 390)} {items[0][1]} {prose(64, 371)} {items[2][1]} {prose(65, 50)} {items[1][1]} {prose(66, 700)}"
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, [(9, text, "en")])
    got = [(r["item_id"], r["similarity"]) for r in decontaminate.contaminated(docs, bench, spark).orderBy("item_id").collect()]
    assert got == [(1, 1.0), (2, 1.0), (3, 1.0)]
    monkeypatch.setattr(decontaminate, "PORTION", 20)
    assert [(r["item_id"], r["similarity"]) for r in decontaminate.contaminated(docs, bench, spark).orderBy("item_id").collect()] == got


def test_language_margins_by_hand(spark):
    table = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    dictionaries = language.fit(docs)
    assert max(map(len, dictionaries.values())) - min(map(len, dictionaries.values())) < 0.1 * language.DICT_BYTES
    coders = []
    for k in sorted(dictionaries):
        d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=language.LEVEL)
        coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    got = {r["doc_id"]: r for r in language.classify(docs, dictionaries).collect()}
    for r in table:
        if not (r["text"] or "").strip():
            assert not got[r["doc_id"]]["accepted"] and got[r["doc_id"]]["lang_pred"] is None
            continue
        raw = r["text"].lower().encode()
        size = [sum(len(c.compress(raw[i : i + language.BLOCK])) for i in range(0, len(raw), language.BLOCK)) for c in coders]
        first, second = sorted(size)[:2]
        mine = got[r["doc_id"]]
        assert mine["lang_pred"] == sorted(dictionaries)[size.index(first)] and mine["margin"] == (second - first) / first
        assert mine["accepted"] == (mine["margin"] >= language.MIN_MARGIN)


def plain_toxicity(text, lexicon, exceptions):
    """Score by looking for every term at every place, without an automaton."""
    found = set()
    for accents in (True, False):
        folded = toxicity.fold(text) if accents else toxicity.fold(text).translate(toxicity.ACCENTS)
        free = [(m.start(), m.end()) for t in exceptions for x in {toxicity.fold(t)} for m in re.finditer(rf"(?<![^\W_])(?={re.escape(x)}(?![^\W_]))", folded) for m in [re.compile(re.escape(x)).match(folded, m.start())]]
        best = {}
        for term, weight in sorted(lexicon.items()):
            if accents or term in toxicity.LEXICON:
                key = toxicity.fold(term) if accents else toxicity.fold(term).translate(toxicity.ACCENTS)
                if key and (key not in best or best[key][1] < weight):
                    best[key] = (term, weight)
        for key, (term, weight) in best.items():
            for m in re.finditer(rf"(?=({re.escape(key)}))", folded):
                a, b = m.start(), m.start() + len(key)
                if not (a and folded[a - 1].isalnum()) and not (b < len(folded) and folded[b].isalnum()):
                    found.add((a, b, term, weight))
        if toxicity.fold(text).isascii():
            break
    free = [(m.start(), m.start() + len(x)) for folded in {toxicity.fold(text), toxicity.fold(text).translate(toxicity.ACCENTS)} for x in {toxicity.fold(t) for t in exceptions} for m in re.finditer(rf"(?={re.escape(x)})", folded) if not (m.start() and folded[m.start() - 1].isalnum()) and not (m.start() + len(x) < len(folded) and folded[m.start() + len(x)].isalnum())]
    found = [m for m in found if not any(a <= m[0] and m[1] <= b for a, b in free)]
    taken = []
    for m in sorted(found, key=lambda m: (m[0] - m[1], m[0], m[2])):
        if all(m[1] <= t[0] or t[1] <= m[0] for t in taken):
            taken.append(m)
    return 100 * sum(m[3] for m in taken) / len(text.split()) if taken else 0.0


def test_toxicity_scores_by_hand_and_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lexicon = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxic(docs, lexicon).collect()}
    held = [r for r in labels.where("doc_id % 2 = 1").collect() if r["toxic"] is not None]
    assert np.mean([(r["doc_id"] in got) == bool(r["toxic"]) for r in held]) > 0.97
    odd = ["you idіot, take out the trash can", "crétin cretin trash can trash", "shut up shop and shut up", "1d10t " * 3 + "kill yourself kill", "flame retarded retarded"]
    rows = [(i, t, "en") for i, t in enumerate(odd)]
    mine = {r["doc_id"]: r["score"] for r in toxicity.toxic(documents(spark, rows), toxicity.LEXICON, min_score=0.01).collect()}
    for i, t, _ in rows:
        assert mine.get(i, 0.0) == pytest.approx(plain_toxicity(t, toxicity.LEXICON, toxicity.EXCEPTIONS)), t
    for r in docs.limit(60).collect():
        s = plain_toxicity(r["text"], lexicon, toxicity.EXCEPTIONS) if r["text"] else 0.0
        assert got.get(r["doc_id"], 0.0) == pytest.approx(s if s >= toxicity.MIN_SCORE else 0.0)


def test_toxicity_is_linear_in_exceptions():
    both = toxicity.machines(toxicity.LEXICON, toxicity.EXCEPTIONS)
    began = time.perf_counter()
    assert len(toxicity.matches("trash can trash " * 8000, both)) == 8000
    assert time.perf_counter() - began < 5


def test_quality_query_by_hand(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist():
        x, _, size = quality.line_features(pa.array([r["text"] or ""]))
        mine = got[r["doc_id"]]
        assert mine["n_lines"] == len(x) == sum(bool(re.sub(r"[ \t\n\x0b\x0c\r]", "", line)) for line in (r["text"] or "").split("\n"))
        if not len(x):
            assert mine["quality"] is None and not mine["keep"]
            continue
        # the chain by plain sums of products, scaled line by line
        score = quality.with_neighbours(x, np.zeros(len(x), int)) @ model.weight
        turn = np.exp(model.turn)
        forward, backward = [], [np.ones(2)]
        for s in score:
            v = (forward[-1] @ turn if forward else np.ones(2)) * np.array([1.0, np.exp(s)])
            forward.append(v / v.sum())
        for s in score[:0:-1]:
            v = turn @ (np.array([1.0, np.exp(s)]) * backward[-1])
            backward.append(v / v.sum())
        good = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, backward[::-1])]
        assert mine["quality"] == pytest.approx(np.average(good, weights=size), abs=1e-6)
        assert mine["keep"] == (mine["quality"] >= quality.MIN_QUALITY)


def test_quality_is_fitted_to_all_lines(spark):
    rows = [(i, "\n".join(prose(700 + 31 * i + k, 8) for k in range(300)), "en") for i in range(4)] + [(10 + i, "\n".join("$$ 12 %% 34 ## !!" for _ in range(300)), "en") for i in range(4)]
    labels = spark.createDataFrame([(d, int(d < 10), 0) for d, _, _ in rows], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, rows)
    assert {r["doc_id"] for r in quality.score(docs, quality.fit(docs, labels)).where("keep").collect()} == {0, 1, 2, 3}


def test_extensions_of_pairs():
    r = random.Random(3)
    pairs = [("".join(r.choice("abé") for _ in range(r.randrange(0, 30))), "".join(r.choice("abé") for _ in range(r.randrange(0, 30)))) for _ in range(200)] + [("x" * 500 + "a", "x" * 500 + "b"), ("", ""), ("q" * 900, "q" * 900)]
    head, tail = fingerprints.extensions([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), h, t in zip(pairs, head, tail):
        common_ = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert (h, t) == (common_(a, b), common_(a[::-1], b[::-1]))


def test_packing_of_one_hot_id(spark):
    docs = documents(spark, [(None, prose(i % 3, 40 + i % 3), "en") for i in range(900)] + [(5, " \n", "en"), (6, "\nfoo bar", "en"), (7, "foo bar\t", "en"), (8, "", "en")])
    found = packing.packing(docs, spark, capacity=100, shard_bins=8).toPandas()
    hot_ = found[found["doc_id"].isna()]
    assert len(hot_) == 900 and sorted(hot_["copy"]) == list(range(900)) and hot_["shard"].nunique() > 3
    assert dict(zip(*found.dropna(subset=["doc_id"])[["doc_id", "length"]].T.to_numpy())) == {5: 1, 6: 2, 7: 2, 8: 1}
    assert (found.groupby(["shard", "bin"])["length"].sum() <= 100).all()


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    docs = documents(spark, [(None, None, None), (1, "", "en"), (2, prose(1, 80), "en"), (2, prose(2, 80), "de"), (3, prose(1, 80), "en"), (4, " \n", "en"), (5, prose(5, 3000), "de")] + [(10 + i, prose(900 + i, 40), "ende"[i % 2 * 2 :][:2]) for i in range(20)]).select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.createDataFrame([(1, prose(905, 40)), (None, None)], "item_id bigint, text string")
    for name, rows in (("full", docs), ("empty", docs.where("false"))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert name == "empty" and out == [] or {r["length"] for r in out if r["doc_id"] == 5} == {2048, 952} or not any(r["doc_id"] == 5 for r in out)
        assert not {r["doc_id"] for r in out} & {15, 3, 1, 4, None}


def brute_pipeline(spark):
    """Stage by stage over the smallest tables, each against plain code on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, DATA).checkpoint()
        yield name, before, [r.asDict() for r in docs.collect()]


def test_pipeline_stages_against_brute_force(spark):
    for name, before, after in brute_pipeline(spark):
        kept = {r["doc_id"]: r["text"] for r in after}
        old = {r["doc_id"]: r["text"] for r in before}
        assert set(kept) <= set(old)
        if name == "near_duplicates":
            sets = {d: {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for d, t in old.items() for w in [re.findall(r"[^\W_]+", (t or "").lower())] if w}
            root = {d: d for d in old}

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in itertools.combinations(sorted(sets), 2):
                if len(sets[a] & sets[b]) >= neardup.THRESHOLD * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
            want = {d for d in old if find(d) == d}
            assert len(set(kept) ^ want) <= 0.02 * len(want)
        if name == "substrings":
            cut = {}
            for d, copy, x in brute_repeats(before):
                if copy:
                    cut.setdefault(d, set()).add(x)
            for d, t in old.items():
                w = common.words(pa.array([t or ""]))
                rest = [bytes(w.data[a:b]).decode() for k, (a, b) in enumerate(zip(w.start, w.end)) if k not in cut.get(d, ())]
                if d in cut and not rest:
                    assert d not in kept
                else:
                    v = common.words(pa.array([kept[d] or ""]))
                    assert [bytes(v.data[a:b]).decode() for a, b in zip(v.start, v.end)] == rest and (d in cut or kept[d] == t)
        if name == "language_id":
            assert all(kept[d] == old[d] for d in kept)


def test_a_much_wanted_partner_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "FEW", 1)
    monkeypatch.setattr(fingerprints, "SHARE", 2)
    head = prose(70, 12)
    rows = [(i, f"{head} {prose(500 + i, 6)}", "en") for i in range(60)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(spark, rows), spark).collect()}
    assert len(got) == 60 and got[0]["near_id"] is None
    for i in range(1, 60):
        near = rows[got[i]["near_id"]][1]
        same = next(k for k, (a, b) in enumerate(zip(rows[i][1] + "\0", near + "\1")) if a != b)
        assert got[i]["near_id"] < i and got[i]["head_chars"] == same
