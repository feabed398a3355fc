"""Token blocks cost few CPU seconds and little memory, and their bytes are those of the first coder."""

import hashlib
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from postlake.llm import tokenids


@pytest.fixture(scope="module")
def blocks():
    r = np.random.default_rng(3)
    return [r.zipf(1.2, tokenids.BLOCK) % 50_000 for _ in range(300)]


def cpu(run) -> float:
    began = time.thread_time()
    run()
    return time.thread_time() - began


def yardstick() -> None:
    """Sorts, gathers and sums over arrays as large as those of a lot, on any machine."""
    x = np.random.default_rng(0).integers(0, 1 << 14, (32, tokenids.BLOCK)).astype(np.uint16)
    for _ in range(20):
        at = (np.argsort(x, axis=1, kind="stable") + (np.arange(32) * tokenids.BLOCK)[:, None]).ravel()
        np.bincount(x.ravel()[at].astype(np.int64), minlength=1 << 14)
        np.maximum.accumulate(at)


def test_blocks_are_coded_in_little_time(blocks):
    tokenids.encode(blocks[:32])
    least = min(cpu(lambda: tokenids.encode(blocks)) / cpu(yardstick) for _ in range(5))
    assert least < 18


def test_blocks_are_coded_in_little_memory(blocks):
    tracemalloc.start()
    try:
        tokenids.encode(blocks)
        assert tracemalloc.get_traced_memory()[1] < 70e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("parts,digest", [(256, "bafad1260140866a"), (4096, "2f3c30226eeea293")])
def test_bytes_of_blocks_stay_as_they_are(parts, digest):
    r = np.random.default_rng(parts)
    most = min(parts << 8, 1 << 20)
    lengths = [0, 1, 2, 31, 32, 33, 64, 65, 500, tokenids.BLOCK - 1, tokenids.BLOCK] * 4
    ids = [r.integers(0, most, n) if i % 3 else np.resize(r.integers(0, most, 7), n) for i, n in enumerate(lengths)]
    coded = tokenids.encode(ids, parts)
    assert hashlib.blake2b(b"|".join(coded), digest_size=8).hexdigest() == digest
    assert all(np.array_equal(a, b) for a, b in zip(ids, tokenids.decode(coded, lengths, parts)))


def test_new_pieces_go_through_the_tokenizer_together():
    with open(tokenids.VOCABULARY, "rb") as f:
        raw = f.read()
    tokens, coder = tokenids.Tokens(raw), tokenids.vocabulary(raw)
    calls = []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return coder.encode_ordinary(text)

    tokens.coder = Counted()
    r = np.random.default_rng(9)
    texts = [" ".join(f"{'xyz'[x % 3]}{x}é" for x in r.integers(0, 1 << 40, 500)) for _ in range(20)]
    # white space beyond a blank, at the ends of pieces or in them, must not join what stands on other lines
    texts += [" ", "\n", "a \n b", "a\n", "\na", "x ", " y z", "　", "tab\tq", "don't 'll", " 'll", "a\r\n\r\nb", "exactly16bytes!!", "exactly17bytes!!!", None, ""]
    ids, number = tokens(pa.array(texts))
    assert len(calls) < 50
    assert [x.tolist() for x in np.split(ids, np.cumsum(number)[:-1])] == [coder.encode_ordinary(t or "") for t in texts]
