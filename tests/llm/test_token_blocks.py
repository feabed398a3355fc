"""Token blocks: exact round trips of hard blocks, hash collisions of pieces, and vocabularies of more ids."""

import numpy as np
import pyarrow as pa
import pytest

from postlake.llm import tokenids
from postlake.llm.common import U64, prefix, spans


@pytest.fixture(scope="module")
def raw():
    with open(tokenids.VOCABULARY, "rb") as f:
        return f.read()


@pytest.mark.parametrize("parts,most", [(256, 1 << 16), (1024, 200_000), (4096, 1 << 20)])
def test_blocks_of_any_ids_round_trip(parts, most):
    r = np.random.default_rng(parts)
    ids = [r.integers(0, most, 700), np.zeros(tokenids.BLOCK, int), np.full(5, most - 1), np.zeros(0, int), np.tile(r.integers(0, most, 9), 300), r.integers(0, 3, tokenids.BLOCK), r.zipf(1.3, 2000) % most, np.array([most - 1])]
    coded = tokenids.encode(ids, parts)
    back = tokenids.decode(coded, [len(x) for x in ids], parts)
    assert all(np.array_equal(a, b) for a, b in zip(ids, back))
    # each block decodes alone, and what repeats costs little
    assert np.array_equal(tokenids.decode(coded[4:5], [len(ids[4])], parts)[0], ids[4])
    assert len(coded[1]) < 120 and len(coded[4]) < 300 and coded[3] == b""


def test_more_blocks_than_lanes_and_carries():
    r = np.random.default_rng(7)
    ids = [r.integers(0, 1 << r.integers(1, 17), r.integers(0, 40)) for _ in range(tokenids.LANES + 200)]
    assert all(np.array_equal(a, b) for a, b in zip(ids, tokenids.decode(tokenids.encode(ids), [len(x) for x in ids])))


def test_pieces_of_one_hash_keep_their_own_ids(raw):
    # polynomial hashes modulo 2**64 agree on these two for every odd base
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, other = ("".join(pair[b] for b in bits) for pair in ("ab", "ba"))
    data = np.frombuffer((one + other).encode(), np.uint8)
    h = spans(prefix(data.astype(U64) + U64(1)), np.array([0, 2048]), np.array([2048, 4096]))
    assert h[0] == h[1]
    tokens, coder = tokenids.Tokens(raw), tokenids.vocabulary(raw)
    texts = [one, f"x {other} y", None, "", f"{other}\n{one} z", one[:-1], other]
    for _ in range(2):
        ids, number = tokens(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(number)[:-1])] == [coder.encode_ordinary(t or "") for t in texts]


def test_long_texts_are_made_into_ids_part_by_part(raw, monkeypatch):
    monkeypatch.setattr(tokenids, "PORTION_BYTES", 1000)
    tokens, coder = tokenids.Tokens(raw), tokenids.vocabulary(raw)
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{x}é  {x}\n\n" for x in r.integers(0, 900, 2000)), "l" * 5000, "a b c  d" * 300]
    ids, number = tokens(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(number)[:-1])] == [coder.encode_ordinary(t) for t in texts]


def test_lost_places_are_found_again(raw, monkeypatch):
    monkeypatch.setattr(tokenids, "PLACE_BITS", 4)
    monkeypatch.setattr(tokenids, "KNOWN", 60)
    tokens, coder = tokenids.Tokens(raw), tokenids.vocabulary(raw)
    for k in range(4):
        texts = [" ".join(f"q{x * 7 % 50}" for x in range(20 * k, 20 * k + 60)), "tail"]
        ids, number = tokens(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(number)[:-1])] == [coder.encode_ordinary(t) for t in texts]
