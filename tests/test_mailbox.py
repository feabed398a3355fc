"""The mailbox queries against their SQL, and the operators' behaviour on hand-written mail."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from oracle import actual, expected
from postlake import lexicon as lx
from postlake import registry
from postlake.functions import address, html, text
from postlake.operators import hints, projection, segmentation, threads
from postlake.sinks import exports
from postlake.sources import mbox, mime
from postlake.streaming import sync

LEXICON = lx.default_lexicon()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    got, want = actual(registry.queries()[name](spark, DATA)), expected(registry.oracle_sql()[name], DATA)
    assert got == want and got[1]


def test_rows_only_queries(spark):
    for name in registry.queries().keys() - registry.oracle_sql().keys():
        assert registry.queries()[name](spark, DATA).count() > 0


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (text.message_id, " <<A.b@C>> ", "a.b@c"),
        (text.subject_key, "RE: Fwd: re:  Big   Plan re: x", "big plan re: x"),
        (text.display_subject, "Re: FW: ", "(no-subject)"),
        (text.normalize_text, "a​b\r\n\r\n\n\nc  \t d  \n", "ab\n\nc d"),
        (text.safe_filename, "../a b?.pdf", "a_b_.pdf"),
        (text.references, "<A@x>, <b@X>\t<A@x>", ["a@x", "b@x", "a@x"]),
        (address.normalize_email, "Foo <FOO@Example.com> ", "foo@example.com"),
        (address.normalize_email, "@b.example", None),
        (address.root_domain, "a.b.co.uk", "co.uk"),
        (address.url_host, "HTTPS://www.Example.com:80/x?y", "example.com:80"),
        (address.url_tokens, "see (www.a.example/x), [t](https://b.example/y) and <https://c.example>. mailto:x@d.example", ["https://www.a.example/x", "https://b.example/y", "https://c.example"]),
        (address.phone_tokens, "+48-123-456-789 12 34567890123456789", ["48123456789"]),
        (html.html_to_text, "<p>a &lt;b&gt; &#65;&#x42;&copy;</p><script>x<br></script>c<unclosed", "a <b> AB&copy\n\nc"),
    ],
)
def test_expressions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_profile_has_no_dot_boundary(spark):
    got = one(spark, "https://netflix.com/Some/x", address.profile)
    assert (got["type"], got["handle"]) == ("twitter_x", "some")
    got = one(spark, "http://www.linkedin.com/company/Acme/about", address.profile)
    assert (got["type"], got["handle"], got["host"]) == ("linkedin_company", "acme", "linkedin.com")


def test_raw_headers_last_wins_and_orphan_continuations_go(spark):
    raw = "A: 1\r\nB: two\r\n\tmore\r\nno header\r\n C: 3\r\na: 4\r\nD:\r\n\r\nE: 5"
    assert one(spark, raw, lambda c: text.raw_headers(text.header_slice(c))) == {"a": "4", "b": "two more"}


def test_lexicon_boundaries_overrides_and_errors(spark):
    assert one(spark, "galapagos", LEXICON.classify_billing) is None and one(spark, "(pago)", LEXICON.classify_billing) == "pay_now"
    ops = lx.parse_overrides('# note\n\n{"op": "add_pattern", "target": "lifecycle_keyword_patterns", "pattern": " Trial Over "}\n')
    more = lx.apply_overrides(LEXICON, ops + ops)
    assert more.patterns["lifecycle_keyword"].count("trial over") == 1
    for bad in ('{"op": "drop", "target": "x", "pattern": "y"}', '{"op": "add_pattern", "target": "x", "pattern": " "}', '{"op": "add_pattern", "target": "x", "pattern": "y", "z": 1}'):
        with pytest.raises(ValueError):
            lx.parse_overrides(bad)
    with pytest.raises(ValueError, match="unknown target"):
        lx.apply_overrides(LEXICON, [("nothing", "x")])
    with pytest.raises(ValueError, match="version"):
        lx.from_config({"version": 2})


REPLY = "Hi Tom,\n\nThe plan works for me, see you.\n\nBest regards,\nAnna Kow\nanna@corp.example\n\nOn Mon, Jan 1, 2024 Bob wrote:\n> old\n> text"


def test_segmentation():
    kinds = {b["kind"]: b["text"] for b in segmentation.segment(REPLY)}
    assert kinds["salutation"] == "Hi Tom," and kinds["reply"] == "The plan works for me, see you." and kinds["signature"].startswith("Best regards,") and kinds["quoted"].startswith("On Mon")
    for b in segmentation.segment(REPLY):
        assert REPLY[b["start"] : b["end"]] == b["text"]
    assert segmentation.segment(None) == segmentation.segment(" \n") == []


@pytest.mark.parametrize(
    "body,kind",
    [
        ("x\n-----Original Message-----\ny", "quoted"),
        ("x\nBegin forwarded message:\nFrom: a", "forwarded"),
        ("x\nAm 1. Januar schrieb Bob:\ny", "quoted"),
        ("x\nLe lundi, Bob a écrit :\ny", "quoted"),
        ("x\n*Bob Doe*\ny", "quoted"),
        ("x\nFrom: a\nSent: b\nTo: c\nSubject: FW: d\ny", "forwarded"),
        ("x\nVon: a\nGesendet: b\nAn: c\nBetreff: d\ny", "quoted"),
        ("x\n> one\n> two", "quoted"),
        ("x\n> one\nno second", None),
        ("Jan 5, 2024 10:30\nrest", "quoted"),
    ],
)
def test_quote_start(body, kind):
    found = segmentation.quote_start(body.split("\n"))
    assert (found[1] if found else None) == kind


def test_projection_on_few_rows(spark):
    rows = spark.createDataFrame(
        [("t", "k2", 1, "Re: Plan", "2024-01-02T00:00:00Z", ["B <b@x.example>"], [], [], "see https://u.example/a.", ["personal"], [], []), ("t", "k1", 2, "Plan", "", ["a@x.example"], ["B <b@x.example>"], [], "", ["personal"], [], [])],
        "thread_id string, message_key string, ordinal bigint, subject string, date string, `from` array<string>, `to` array<string>, cc array<string>, reply_text string, mail_kinds array<string>, event_kinds array<string>, lifecycle_kinds array<string>",
    )
    out = projection.project(rows, projection.ProjectionQuery(date_from="2025-01-01", limit=10))
    assert [r["message_key"] for r in out.rows.collect()] == ["k1"]  # no date passes the date filter
    out = projection.project(rows, projection.ProjectionQuery(sort="date_desc", limit=1))
    assert {r["id"] for r in out.nodes.collect()} == {"T:t", "M:k2", "P:b@x.example", "U:https://u.example/a", "D:2024-01-02"}
    assert out.stats.first().asDict() == {"n_rows": 1, "n_threads": 1, "n_nodes": 5, "n_links": 4}
    assert exports.csv_rows(rows).where("message_key = 'k2'").first()["from"] == "B <b@x.example>"
    assert "Reply: Re: Plan" in exports.markdown(rows).first()["value"]


def test_reply_tree_cuts_cycles(spark):
    linked = spark.createDataFrame([("t", "a", 1, 1, "b"), ("t", "b", 2, 2, "a"), ("t", "c", 3, 3, "b")], "thread_id string, message_key string, ts bigint, uid bigint, parent_key string")
    got = {r["message_key"]: (r["parent_key"], r["depth"]) for r in threads.reply_tree(linked).collect()}
    assert got == {"a": (None, 0), "b": ("a", 1), "c": ("b", 2)}


MAIL = b"""From: Anna <Anna@Corp.example>
To: b@x.example, bad
Message-ID: <M1@Corp.example>
References: <R1@x> <R2@x>
Subject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=
Date: Mon, 1 Jan 2024 10:00:00 +0200
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=zz

--zz
Content-Type: text/plain; charset=utf-8

hello
--zz
Content-Type: message/rfc822

Message-ID: <inner@x.example>
Subject: in

body
--zz
Content-Type: application/octet-stream
Content-Disposition: attachment; filename=a.bin
Content-Transfer-Encoding: base64

AAECAwQFBgcICQoLDA0ODw==
--zz--
"""


def test_mbox_ranges_and_mime(spark, tmp_path):
    line = b"From a@b.example Mon Jan  1 10:00:00 2024 +0100\n"
    path = tmp_path / "x.mbox"
    path.write_bytes(b"junk\n" + b"".join(line + MAIL + b"\n>From here\n>>From there\nFrom now on, text\n" for _ in range(20)))
    spark.dataSource.register(mbox.MboxDataSource)
    strict = lambda: spark.read.format("mbox").option("strict", "true")
    whole = [(r["offset"], bytes(r["raw"])) for r in strict().load(str(path)).collect()]
    assert len(whole) == 20 and b"\nFrom here\n>>From there\nFrom now on" in whole[0][1]
    for size in (97, 700, 5000):
        parts = strict().option("splitBytes", size).load(str(path)).collect()
        assert sorted((r["offset"], bytes(r["raw"])) for r in parts) == whole
    assert strict().option("maxMessages", 3).load(str(path)).count() == 3
    assert spark.read.format("mbox").load(str(path)).count() == 40  # any line that begins so, unless strict
    head = strict().option("headersOnly", "true").load(str(path)).first()
    assert b"Message-ID" in bytes(head["raw"]) and b"hello" not in bytes(head["raw"]) and head["size"] == len(whole[0][1])
    (tmp_path / "y.EML").write_bytes(MAIL)
    raw = mbox.read_folder(spark, str(tmp_path))
    row = mime.parse(raw.where("path like '%EML'")).first()
    assert (row["message_id"], row["subject"], row["date"], row["references"]) == ("m1@corp.example", "Grüße", "2024-01-01T10:00:00+02:00", ["r1@x", "r2@x"])
    assert [a["address"] for a in row["to"]] == ["b@x.example"] and row["body_text"].strip() == "hello" and row["error"] is None
    assert [(a["filename"], a["size"]) for a in row["attachments"]] == [("a.bin", 16)] and row["forwarded"][0]["message_id"] == "inner@x.example"
    assert mbox.separator_date("From a Mon Jan 1 10:00:00 2024 XYZ") == "2024-01-01T10:00:00+00:00" and mbox.separator_date("From a b") is None
    head = mime.headers_only(raw.where("path like '%EML'")).first()
    assert head["headers"]["to"] == "b@x.example, bad" and head["rfc822_size"] == len(MAIL)
    assert mime.attachments(raw).select("sha256").distinct().count() == 1


def test_sync_is_idempotent(spark, tmp_path):
    schema = "account_id string, mailbox string, uid bigint, uidvalidity bigint, modseq bigint, vanished boolean, body string"
    rows = [("a", "in", 1, 1, 1, False, "x"), ("a", "in", 2, 1, 2, False, "y"), ("a", "in", 1, 1, 3, False, "x2"), ("a", "in", 2, 1, 4, True, None), ("a", "in", 1, 1, 3, False, "x2"), ("a", "in", 3, 1, 5, False, "z")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    query = sync.sync(spark, str(tmp_path / "in" / "*"), schema, str(tmp_path / "t"), str(tmp_path / "c"), 2)
    query.awaitTermination(120)
    state = sync.state(spark, str(tmp_path / "t"))
    assert {(r["uid"], r["body"]) for r in sync.visible(state).collect()} == {(1, "x2"), (3, "z")} == {(r["uid"], r["body"]) for r in sync.visible(sync.latest(spark.createDataFrame(rows, schema))).collect()}
    assert sync.checkpoints(state).first()["highest_modseq"] == 5
    # a batch of another mailbox leaves the versions of this one alone, and running it again changes nothing
    merge = sync.merge_into(str(tmp_path / "t"))
    for _ in range(2):
        merge(spark.createDataFrame([("b", "out", 9, 1, 1, False, "w")], schema), 90)
    assert {(r["account_id"], r["uid"]) for r in sync.visible(sync.state(spark, str(tmp_path / "t"))).collect()} == {("a", 1), ("a", 3), ("b", 9)}
    assert len([p for p in (tmp_path / "t" / "version=90").iterdir() if p.name.startswith("box=")]) == 1
    sync.vacuum(spark, str(tmp_path / "t"))
    assert sync.visible(sync.state(spark, str(tmp_path / "t"))).count() == 3
    (tmp_path / "bad" / "version=0").mkdir(parents=True)
    (tmp_path / "bad" / "version=0" / "_SUCCESS").write_text("")
    (tmp_path / "bad" / "version=0" / "x.parquet").write_text("no table")
    with pytest.warns(UserWarning, match="anew"):
        assert sync.state(spark, str(tmp_path / "bad"), fresh=True) is None


def test_windowed_counts_of_a_stream_with_a_watermark(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    for i, rows in enumerate((["2024-01-01 10:05", "2024-01-01 10:50"], ["2024-01-01 15:00"], ["2024-01-01 10:10", "2024-01-01 19:00"], ["2024-01-01 23:59"])):
        spark.createDataFrame([(r, "x") for r in rows], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        out = sync.windowed_counts(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out"))
        out.trigger(availableNow=True).start().awaitTermination(120)
    got = {r["window_start"].hour: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # the row of 10:10 comes after the watermark has passed its window
    assert got[10] == 2 and got[15] == 1


def test_hints_without_headers(spark):
    df = spark.createDataFrame([("Hello", "nothing here", {}), (None, None, {"from": "x"})], "s string, b string, h map<string,string>")
    got = df.select(hints.mail_kind(hints.mail_kind_scores(F.col("s"), F.col("b"), F.col("h"))).alias("k"), hints.unsubscribe(F.col("h"), F.col("b")).alias("u")).collect()
    assert [(r["k"]["kind"], r["k"]["confidence"], r["u"]) for r in got] == [("unknown", "low", [])] * 2
