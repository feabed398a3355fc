"""Workers are reused, so what a stage has freed must not stay with them; nor may small tables need workers of their own."""

import subprocess
import sys

import pytest

from postlake.llm import language, neardup

#: MB that the process holds after a task of a step, beyond what it held before.
TASK = """
import re
import numpy as np, pyarrow as pa
from postlake.llm import neardup, seeds, suffixes
from postlake.llm.common import powers, BASE, INVERSE

run = {of}
r = np.random.default_rng(1)
words = np.array([f"w{{x}}" for x in range(5000)])

def batches():
    for k in range(5):
        texts = [" ".join(words[r.integers(0, 5000, 400)]) for _ in range(1000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([0] * 1000), pa.array(texts)], names=["doc_id", "part", "text"])

def sorted_pieces():
    for k in range(40):
        own = [r.integers(0, 400, 2000) for _ in range(60)]
        yield pa.RecordBatch.from_arrays([pa.array([k] * 60), pa.array(range(60)), pa.array([0] * 60, pa.int32()), pa.array([0] * 60, pa.int32()), pa.array([1951] * 60, pa.int32()), pa.array([False] * 60), pa.array(own, pa.list_(pa.int64()))], names=["anchor", "doc_id", "part", "start", "windows", "dup", "words"])

def held():
    return sum(map(int, re.findall(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

powers(BASE, 1 << 20), powers(INVERSE, 1 << 20)
before = held()
for _ in run(sorted_pieces() if "_factor" in "{of}" else batches()):
    pass
print(held() - before)
"""


def held_after(of: str) -> float:
    return float(subprocess.run([sys.executable, "-c", TASK.format(of=of)], check=True, capture_output=True, text=True).stdout)


@pytest.mark.parametrize("step", ["neardup._sign", "seeds._seed", "suffixes._factor"])
def test_memory_is_given_back_at_the_end_of_a_task(step):
    assert held_after(f"neardup.tidy({step})") < 12 < held_after(step)


def test_stages_tidy_up_after_themselves(spark, monkeypatch):
    released = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(language, "tidy", lambda run: lambda batches: (yield from run(batches)) or released.add(1))
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de", ("the cat and the dog " if i % 2 else "der hund und die katze ") * 9) for i in range(40)], "doc_id long, lang string, text string")
    assert language.stage_language(spark, docs, "").count() == 40
    assert released.value > 0


def test_shares_of_dictionaries_need_no_rdd_of_python(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "en" if i % 2 else "de", f"text {i} " * 9) for i in range(40)], "doc_id long, lang string, text string").localCheckpoint()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert sorted(language.fit(docs)) == ["de", "en"]


def test_texts_of_rows_that_stay_are_not_shuffled(spark):
    import numpy as np

    r = np.random.default_rng(3)
    texts = [" ".join(f"{x:x}" for x in r.integers(0, 1 << 60, 600)) for _ in range(300)]
    rows = [(i, t, f"k{i}") for i, t in enumerate(texts)]
    rows += [(900, texts[7], "copy"), (8, texts[8], "k8"), (None, texts[9], "no id"), (None, texts[9], "no id"), (901, None, "no text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(4).localCheckpoint()
    context = spark.sparkContext._jsc.sc()

    def written() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    out = neardup.stage_near_duplicates(spark, docs, "").collect()
    assert written() - before < sum(map(len, texts)) // 2
    assert sorted((-1 if x is None else x, n) for x, _, n in out) == sorted([*((i, f"k{i}") for i in range(300)), (-1, "no id"), (-1, "no id"), (901, "no text")])
