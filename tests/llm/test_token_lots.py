"""Token blocks are coded, and pieces looked up, in lots whose tables are small; what comes out is as of each alone."""

import tracemalloc

import numpy as np
import pyarrow as pa

from postlake.llm import tokenids


def peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_steps_are_found_in_small_lots():
    r = np.random.default_rng(2)
    blocks = [r.zipf(1.2, tokenids.BLOCK) % 50_000 for _ in range(130)]
    assert peak(lambda: tokenids.encode(blocks)) < 100
    coded = tokenids.encode(blocks)
    assert [coded[i] for i in (0, 31, 32, 129)] == [tokenids.encode([blocks[i]])[0] for i in (0, 31, 32, 129)]


def test_pieces_are_looked_up_in_small_parts():
    with open(tokenids.VOCABULARY, "rb") as f:
        tokens = tokenids.Tokens(f.read())
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 900, 2000)) for _ in range(400)]
    ids, number = tokens(pa.array(texts))
    assert peak(lambda: tokens(pa.array(texts))) < 130
    assert ids[: number[0]].tolist() == tokens.coder.encode_ordinary(texts[0])
