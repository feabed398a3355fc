"""Work that a query does for a message: what is made once, and what a worker holds at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlake import registry
from postlake.functions import address, bodies
from postlake.functions.text import ascii_lower
from postlake.lexicon import default_lexicon
from postlake.operators import contacts, hints, segmentation


def plan_of(spark, made):
    """The plan of an expression of a text column, as a string."""
    return spark.range(1).select(F.col("id").cast("string").alias("s")).select(made(F.col("s")).alias("x"))._jdf.queryExecution().analyzed().toString()


def test_url_tokens_make_each_step_once(spark):
    plan = plan_of(spark, address.url_tokens)
    assert plan.count("regexp_") + plan.count("RLIKE") < 40
    words = " ".join(["word", "end.", "...", "a.example", "http://x", "[t](HTTPS://B.example/p)", "<www.c.example>", "me@d.example", "e..f"] * 200)
    found = spark.createDataFrame([(words,)], "s string").select(address.url_tokens(F.col("s"))).first()[0]
    assert found == ["https://a.example", "HTTPS://B.example/p", "https://www.c.example", "https://e..f"]


def test_signature_entities_split_a_text_once(spark):
    plan = plan_of(spark, contacts.signature_entities)
    assert plan.count("split(") == 2 and plan.count("regexp_") + plan.count("RLIKE") < 60


def colliding(spark, folder):
    """Conversations two of whose messages have the same uid, 100 * conv_id + turn."""
    rows = [(1, 100, "user", "Hello Tom,\nsee you on 3 May 2024"), (2, 0, "user", "Hello Ann,\nno date"), (3, 0, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name, n", [("r01_reply_rows", 3), ("r15_canonical_threads", 3), ("h02_contact_hints", None), ("h04_event_hints", None)])
def test_parts_of_bodies_are_not_joined(spark, tmp_path, name, n):
    df = registry.queries()[name](spark, colliding(spark, tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") <= 2
    assert n is None or df.count() == n


def test_event_terms_lower_a_text_once(spark):
    plan = plan_of(spark, lambda s: hints.event_terms(ascii_lower(s), default_lexicon()))
    assert plan.count("translate(") == 1


def test_footers_read_a_line_once(spark):
    assert plan_of(spark, bodies.strip_footer).count("translate(") <= 2


def test_forwarded_segments_take_one_worker_and_small_lots(spark, tmp_path):
    df = registry.queries()["g14_forwarded_segments"](spark, colliding(spark, tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["uid"])
    found = list(segmentation.lots([batch]))
    assert max(x.num_rows for x in found) <= segmentation.LOT and pa.Table.from_batches(found) == pa.Table.from_batches([batch])
