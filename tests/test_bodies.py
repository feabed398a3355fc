"""Bodies, signatures, contacts, events and forwards on hand-written mail; exports and lexicons."""

import json

import pytest
from pyspark.sql import functions as F

from postlake import lexicon as lx
from postlake.functions import bodies, html, text
from postlake.operators import contacts, events, forwards, hints, segmentation, threads
from postlake.sinks import exports
from postlake.sources import mbox
from postlake.streaming import sync

LEXICON = lx.default_lexicon()


def parts(t):
    return segmentation.body_parts(t)


#: body, reply, beginning of the signature (None: no signature)
SIGNED = [
    ("Hello Ada,\n\nThe numbers are in the table below.\n\nBest regards,\nGrace\n\nDisclaimer: this mail is confidential.\n\nOn Tue, Jan 2, 2024 at 10:00 Ada <ada@x.example> wrote:\n> older", "The numbers are in the table below.", "Best regards"),
    ("Hi all,\n\nTopics:\n- budget\n- rooms\n- food\n\nTell me what is missing.\n", "Topics:\n- budget\n- rooms\n- food\n\nTell me what is missing.", None),
    ("The main point.\n\nFreundliche Grüße / Best regards\nErika Muster\nChemistry Expert", "The main point.", "Freundliche"),
    ("Could we talk on Friday?\n\nRgds\nMarie", "Could we talk on Friday?", "Rgds"),
    ("One line.\n\nThank you,\nOlga", "One line.", "Thank you"),
    ("Une ligne.\n\nMerci,\nLuc", "Une ligne.", "Merci"),
    ("A line.\n\nA+\nLuc", "A line.", "A+"),
    ("We held the first course today.\nKind regards\n--\nPaul Klee\nCEO\npaul@klee.example", "We held the first course today.", "Kind regards"),
    ("Le texte de la question.\n\nEst-ce possible ?\n\n\ncdlt\nLuc DURAND\nhttps://shop.example/#/c/luc\nmailto:luc@durand.example", "Le texte de la question.\n\nEst-ce possible ?", "cdlt"),
    ("Merci de la réponse.\n\nLa suite est bonne.\n\n\nLuc DURAND\nDURAND FRERES SAS\n12 Avenue du Lac\nhttp://www.durand.example/\n+33 1 22 33 44 55", "Merci de la réponse.\n\nLa suite est bonne.", "Luc DURAND"),
    ("Bonjour,\n\nUn premier paragraphe.\n\n\nUn autre paragraphe, qui est assez long pour que rien ne le prenne pour la fin de la lettre ou pour une carte.\n\nMerci.", "Un premier paragraphe.\n\n\nUn autre paragraphe, qui est assez long pour que rien ne le prenne pour la fin de la lettre ou pour une carte.\n\nMerci.", None),
    ("See https://shop.example/#/c/7 until noon.\nThat is one of the steps of the plan.\nIs it done?", "See https://shop.example/#/c/7 until noon.\nThat is one of the steps of the plan.\nIs it done?", None),
    ("Look at the sensor in the lab.\n\nI try again later.\n\nBest regards,", "Look at the sensor in the lab.\n\nI try again later.", "Best regards,"),
    ("Good to hear.\n\nIt is done now.\n\nKind regards,\nLena Berg\nCOO", "Good to hear.\n\nIt is done now.", "Kind regards"),
    ("That was quick, Lena! Your best,\nMia", "That was quick, Lena!", "Your best"),
    ("It works with the new cable as we saw in the hall.\n\nPlease leave this sentence where it is, it belongs to what I say.\n\nBest regards,\nLuc DURAND\nDURAND FRERES SAS\nluc@durand.example", "It works with the new cable as we saw in the hall.\n\nPlease leave this sentence where it is, it belongs to what I say.", "Best regards"),
    ("The device needs a new key.\n\nSo I ask you for it as soon as you can\nso that I can go on with this.\n\nBest regards,", "The device needs a new key.\n\nSo I ask you for it as soon as you can\nso that I can go on with this.", "Best regards,"),
]


@pytest.mark.parametrize("body,reply,signature", SIGNED)
def test_signatures(body, reply, signature):
    got = parts(body)
    assert got["reply"] == reply
    assert got["signature"] is None if signature is None else got["signature"].startswith(signature)


@pytest.mark.parametrize(
    "body",
    [
        "Danke sehr.\n\nViele Grüße\nErika\n\nVon: Amt <amt@x.example>\nGesendet: Dienstag, 6. Februar 2024 07:16\nAn: Erika <e@x.example>\nBetreff: Re: Thema\n\nalt",
        "Merci bien.\n\nCordialement,\nLuc\n\nDe : Bureau <b@x.example>\nEnvoyé : mardi 6 février 2024 02:55\nÀ : Luc <l@x.example>\nObjet : Re: Sujet\n\nancien",
        "Lo veo ahora.\n\nSaludos,\nAna\n\nDe: Oficina <o@x.example>\nEnviado el: jueves, 24 de octubre\nPara: Ana <a@x.example>\nAsunto: Re: Tema\n\nantes",
        "Fine\n\n---- on Thu, 18 Jan 2024 16:40:44 +0700 Jo <j@x.example> wrote ----\n> quoted",
    ],
)
def test_quotes_in_languages(body):
    got = parts(body)
    assert len(got["quoted"]) == 1 and got["reply"] == body.split("\n")[0]


def test_footers_become_signatures():
    reply = "The article of this week is about gardens and their soil.\nMore of it next week."
    body = f"{reply}\nunsubscribe at https://news.example/u\nall rights reserved, News Ltd, Green Street"
    assert segmentation.segment(body)[1]["kind"] == "signature" and parts(body)["reply"] == reply
    head, tail = segmentation.split_footer(f"{reply}\n\npowered by X https://x.example/12345\nview in browser please")
    assert head.startswith("The article") and tail.endswith("view in browser please")
    assert segmentation.split_footer("too\nshort") is None


def test_caps(spark):
    cases = ["Hi Ada,", "Hello dear colleagues of the whole company, we write to you", "x" * 70, None, "Hi! " + "y" * 60, "é" * 30]
    long = ["line one\n" * 60, "z" * 400, "short", None, "é" * 200]
    got = spark.createDataFrame([(c,) for c in cases], "v string").select(segmentation.salutation_cap(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in got] == [segmentation.capped_salutation(c) for c in cases] and got[1]["r"] == "Hello dear colleagues of the whole company,"
    got = spark.createDataFrame([(c,) for c in long], "v string").select(segmentation.signature_cap(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in got] == [segmentation.capped_signature(c) for c in long] and len(got[0]["r"]) <= 300 and got[0]["r"].endswith("one")


def one(spark, f, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names)).alias("r")).first()["r"]


def test_canonical_bodies(spark):
    styled = "body,td { color:#111; font:11px Verdana; } p.x{margin:0}\n Dear Ada <table><tr><td>Name</td></tr></table> Yours"
    assert one(spark, bodies.strip_styles, "h1, h2 { a:b } ; Hi { there }") == "Hi { there }"
    assert one(spark, bodies.strip_styles, "word word {no css}") == "word word {no css}"
    assert one(spark, bodies.strip_styles, "a{b:c}" * 300 + "rest") == "rest"
    got = one(spark, bodies.canonical_body, styled, None)
    assert got.startswith("Dear Ada") and got.endswith("Yours") and "color" not in got and "<" not in got
    page = "<p>One</p><p>Two of them</p><p>Three</p><p>Follow us</p><p>Unsubscribe here</p><p>https://x.example</p>"
    assert one(spark, bodies.canonical_body, None, page).replace("\n", " ").split() == ["One", "Two", "of", "them", "Three"]
    assert one(spark, bodies.canonical_body, " \n", None) == "" and one(spark, bodies.canonical_body, None, None) == ""
    assert one(spark, bodies.strip_footer, "a\nb") == "a\nb"
    assert one(spark, bodies.strip_footer, "one\ntwo\nCaption: x\nthree\nfour\nThis email was intended for you\nmore") == "one\ntwo\nthree\nfour"


def test_html_by_cuts_is_html_by_tags(spark):
    pages = ["<p>a<script>x<br>y<p>z</script>b<style>c</style>d", "<SCRIPT src=x>1</SCRIPT >2< br >3", "a<script>never closed <br> text", "<li>x</li>y<unclosed", "", "no tags", "<style><script>a</style>b</script>c", "t\n<p\nclass='x'>u</p>"]
    df = spark.createDataFrame([(p,) for p in pages], "v string")
    assert [tuple(r) for r in df.select(html._by_cuts(F.col("v")), html._by_tags(F.col("v"))).collect()] == [(r[0], r[0]) for r in df.select(html._by_tags(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "line,name",
    [("Hi Ada,", "Ada"), ("DearThomas,", "Thomas"), ("Hello", None), ("Bonjour, Luc Durand; merci", "Luc Durand"), ("Hallo Erika from Bonn", "Erika"), ("hola Ana gracias por todo", "Ana"), ("Dear Bo, please", "Bo"), ("Hi -- !", None), ("Ada Lovelace.", "Ada Lovelace"), ("hi Jo black friday is near", "Jo"), ("Dzień dobry Ola", "Ola")],
)
def test_salutation_names(spark, line, name):
    assert one(spark, contacts.salutation_name, line) == name


def hints_of(spark, signature, salutation=None, sender=("ada@corp.example", "Ada Byron")):
    df = spark.createDataFrame([(signature, salutation, [sender], [("bo@else.example", None)])], "g string, s string, f array<struct<address:string,name:string>>, t array<struct<address:string,name:string>>")
    headers = {"from": F.col("f"), "to": F.col("t")}
    rows = df.select(F.explode(contacts.contact_hints(headers, F.col("s"), contacts.signature_entities(F.col("g")))).alias("c")).select("c.*").collect()
    return [r.asDict() for r in rows]


def test_contact_hints(spark):
    got = hints_of(spark, "Ada Byron\nSales Manager\nCorp GmbH\n12 Lake Street\nada.byron@corp.example\n+49 30 1234 5678 49301234567\nlinkedin.com/in/adabyron\nhttps://www.corp.example/team", "Hi Bo,")
    assert [(h["source"], h["email"] or h["phone"] or h["name"]) for h in got if not h["url"]] == [("from_header", "ada@corp.example"), ("to_header", "bo@else.example"), ("salutation", "Bo"), ("signature", "ada.byron@corp.example"), ("signature", "49301234567")]
    urls = {h["url"]: h for h in got if h["url"]}
    page, site = urls["https://linkedin.com/in/adabyron"], urls["https://www.corp.example/team"]
    assert (page["profile_type"], page["handle"], page["linked_entity_key"], page["link_reason"], page["confidence"]) == ("linkedin_person", "adabyron", "ada byron|corp.example", "name_handle_match", "medium")
    assert (site["profile_type"], site["linked_entity_key"], site["link_reason"]) == ("website", "ada byron|corp.example", "domain_match")
    lone = hints_of(spark, "Ada\nhttps://tiktok.com/@someone")
    assert [(h["profile_type"], h["linked_entity_key"], h["confidence"]) for h in lone if h["url"]] == [("tiktok", None, "medium")]
    assert not [h for h in hints_of(spark, None) if h["source"] == "signature"]


def test_url_links_match_a_plain_loop(spark):
    """Every anchor in turn, as the scoring rule is told, against the sorted minimum."""
    signature = "Corp Labs Inc\nx@corp.example y@other.example\nlinkedin.com/company/corp-labs\nx.com/ada\ngithub.com/zzz\nhttps://other.example/a"
    got = hints_of(spark, signature, "Dear Zzz,")
    anchors = [h for h in got if not h["url"] and h["link_key"]]
    words = lambda s: [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (s or "").lower()).split() if len(w) >= 3]
    for h in (h for h in got if h["url"]):
        best = None
        handle = "".join(c for c in h["handle"] or "" if c.isalnum())
        for a in anchors:
            domain = a["email"].split("@")[1] if a["email"] else None
            score = 3 * (domain is not None and ".".join(domain.split(".")[-2:]) == ".".join(h["company_domain"].split(".")[-2:]))
            score += 2 * bool(handle and any(t in handle or handle in t for t in words(a["name"])))
            score += 2 * bool(handle and h["profile_type"] == "linkedin_company" and any(t in handle or handle in t for t in words("Corp Labs Inc")))
            score += a["source"] == "from_header"
            if score > 0 and not (best and (score < best[0] or (score == best[0] and best[1]["source"] == "from_header"))):
                best = (score, a)
        assert h["linked_entity_key"] == (best[1]["link_key"] if best and best[0] >= 3 else None)


@pytest.mark.parametrize(
    "subject,reply,kind,want",
    [
        ("Plan", "Let us meet on 2024-03-01 10:30 CET.\nJoin at https://zoom.us/j/99", None, ("meeting", True, [])),
        ("Visit", "Would 16-18 April be good for you?\nWe are on site.", None, ("generic", False, ["location"])),
        ("Visit", "The new plate is 3mm thick and it may bend in 2 places.\nNothing else.", None, None),
        ("Re: Form", "Enviado el: jueves, 24 de octubre de 2024 20:28\nFrom: x@y.example\nThanks.", None, None),
        ("Pickup", "Please schedule pickup on 2024-02-28 10:30 CET.\nCall the courier, the waybill number is 288.", None, ("shipping", False, ["location"])),
        ("Digest", "In late 2025 they changed it all.\nMore in our digest.", "newsletter", None),
        ("Wealth", "### 3 Tricks billionaires use in markets\n1. Hold cash if markets fall in may.\n2. Buy stocks.", "newsletter", None),
        ("30% Flash Sale", "Get 30% off in our Lightning Deal, September 27 (11:20 AM-11:20 PM EST).\nIt is available now.", "newsletter", None),
        ("Your Reservation At Cafe Luna", "Your reservation at the restaurant is below.\nDate & Time: 2024-12-24 12:00 CET\nTable for 2 guests.", "transactional", ("reservation", False, ["location"])),
        ("Plan", "Meeting on 2024-03-12 10:30 CET.\nRoom 402, Building 7.\nA line that has campus growth but no number.", None, ("meeting", True, [])),
        ("Teams", "some questions came from the teams.\nWe wait.", None, None),
        ("x", None, None, None),
    ],
)
def test_events(subject, reply, kind, want):
    got = events.event_of(subject, reply, kind, LEXICON)
    if want is None:
        assert got is None
    else:
        assert (got["missing"], got["is_complete"]) == (want[2], want[1]) and got["kind"] in (want[0], "generic")
        if "Room 402" in reply:
            assert got["locations"] == ["Room 402, Building 7."]
        if kind == "transactional":
            assert got["kind"] == "reservation" and got["reservation_type"] == "restaurant"


def test_forwards_in_languages_and_levels():
    heads = ["From To Date Subject", "De A Envoyé Objet", "De Para Enviado_el Asunto", "Von An Gesendet Betreff", "Da A Inviato Oggetto", "Van Aan Verzonden Onderwerp", "Od Do Wysłano Temat"]
    for keys in heads:
        f, t, d, s = (k.replace("_", " ") for k in keys.split())
        raw = f"---- Forwarded message ----\n{f}: Ada <ada@x.example>\n{t}: Bo <bo@x.example>\n{d}: 20 1 2024 12:34\n{s}: Test\n\nThe text.\n\n*From:* Old <old@x.example>\n*Sent:* Tue\n*To:* Bo <bo@x.example>\n*Subject:* Older\n\nOlder text.\n"
        (got,) = forwards.segments([raw])
        assert ([a["address"] for a in got["from"]], [a["address"] for a in got["to"]], got["date"], got["subject"]) == (["ada@x.example"], ["bo@x.example"], "20 1 2024 12:34", "Test")
        assert got["reply_text"] == "The text." and got["confidence"] == "high" and "*From:*" in got["quoted"][0]
    nested = "---- Forwarded message ----\nFrom: Outer <o@x.example>\nSubject: Outer\n\n---- Forwarded message ----\nFrom: Inner <i@x.example>\nSubject: Inner\n\nText within"
    got = forwards.segments([nested, "FYI", ""])
    assert [(r["path"], r["depth"], r.get("subject")) for r in got] == [("0", 0, "Outer"), ("0.0", 1, "Inner"), ("1", 0, None), ("2", 0, None)]
    cc = "Fwd\nFrom: A <a@x.example>\nCc: B <b@x.example>, \"C, D\" <c@x.example>,\nE <e@x.example>\nDate: x\n\nBody."
    assert [a["address"] for a in forwards.segments([cc])[0]["cc"]] == ["b@x.example", "c@x.example", "e@x.example"]
    # the first window of ten lines with three header keys counts, and it begins before them
    assert forwards.without_header_bundle("Yes.\n" + "line\n" * 9 + "\nFrom: a\nSent: b\nTo: c\nold") == "Yes.\nline\nline\nline" and forwards.without_header_bundle(" ") == ""


CONFIG = {
    "version": 1, "known_billing_senders": ["Billing"], "lifecycle_keyword_patterns": ["Renewed", {"pattern": "plan [0-9]+", "match_mode": "regex"}], "confirmation_gate_patterns": [],
    "lifecycle_rules": [{"id": "r", "kind": "subscription_renewed", "priority": 1, "any": [{"pattern": "renewed (?:until|to)", "match_mode": "regex"}, "prolonged"]}],
    "billing_action_rules": [{"id": "b", "action_kind": "pay_now", "patterns": ["pay"]}],
}


def test_lexicon_files_expressions_and_overrides(spark, tmp_path):
    path = tmp_path / "l.json"
    path.write_text(json.dumps(CONFIG))
    own = lx.load(str(path))
    assert own.patterns["confirmation_gate"] == [] and own.patterns["event_meeting_intent"] == LEXICON.patterns["event_meeting_intent"]
    rows = [("your subscription is renewed until may",), ("it was prolonged.",), ("unprolonged",), ("x",)]
    got = spark.createDataFrame(rows, "t string").select(own.classify_lifecycle(F.col("t")).alias("k"), own.matches("lifecycle_keyword", F.lit("plan 12")).alias("m"), own.matches("confirmation_gate", F.col("t")).alias("g")).collect()
    assert [r["k"] for r in got] == ["subscription_renewed", "subscription_renewed", None, None] and got[0]["m"] and not any(r["g"] for r in got)
    for bad, of in (({"lifecycle_keyword_patterns": []}, "empty"), ({"version": 2}, "version"), ({"lifecycle_keyword_patterns": [{"pattern": "(", "match_mode": "regex"}]}, "invalid"), ({"lifecycle_keyword_patterns": [{"pattern": "x", "match_mode": "fuzzy"}]}, "match_mode")):
        with pytest.raises(ValueError, match=of):
            lx.from_config(CONFIG | bad)
    ops = lx.parse_overrides('{"op": "add_pattern", "target": "lifecycle_keyword_patterns", "pattern": "[A-Z]+ x", "match_mode": "regex"}\n{"op": "add_pattern", "target": "lifecycle_keyword", "pattern": "RENEWED"}')
    more = lx.apply_overrides(own, ops)
    assert [str(p) for p in more.patterns["lifecycle_keyword"]] == ["renewed", "plan [0-9]+", "[A-Z]+ x"]
    with pytest.raises(ValueError):
        lx.parse_overrides('{"op": "add", "target": "x", "pattern": "y"}')


def test_final_kinds_and_related_billing(spark):
    df = spark.createDataFrame([("Plan renewed", "newsletter weekly", {})], "s string, b string, h map<string,string>")
    signals = hints.mail_kind_signals(F.col("s"), F.col("b"), F.col("h"))
    got = df.select(hints.scores_of(signals).alias("a"), hints.scores_of(signals, F.lit(True)).alias("b"), hints.billing_actions(F.lit("View invoice https://x.example"), LEXICON, F.lit("order_confirmation")).alias("c")).first()
    score = lambda xs: {x["kind"]: -x["minus"] for x in xs}
    assert score(got["b"]).get("transactional", 0) == score(got["a"]).get("transactional", 0) + 3
    assert [c["related_lifecycle_kind"] for c in got["c"]] == ["order_confirmation"]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i % 3}", f"m{i}", f"s </script> {i}", f"2024-01-0{i + 1}", ["a@x.example"], [], [], f"body {i}", ["personal"], [], [], ["q1\nq2"], ["f"], [("a.pdf", 5)]) for i in range(7)], "thread_id string, message_key string, subject string, date string, `from` array<string>, `to` array<string>, cc array<string>, reply_text string, mail_kinds array<string>, event_kinds array<string>, lifecycle_kinds array<string>, quoted array<string>, forwarded array<string>, attachments array<struct<filename:string,size:int>>")
    pages = exports.write_html(rows, str(tmp_path / "r.html"), most=3, links=spark.createDataFrame([("T:1", "M:</script>", "contains")], "source string, target string, kind string"))
    told = "".join(open(p, encoding="utf-8").read() for p in pages)
    assert len(pages) == 3 and all(f"body {i}" in told for i in range(7)) and told.count("</script>") == 2
    exports.write_json_array(rows.orderBy("date"), str(tmp_path / "a.json"))
    assert [r["message_key"] for r in json.load(open(tmp_path / "a.json"))] == [f"m{i}" for i in range(7)]
    mark = {r["thread_id"]: r["value"] for r in exports.markdown(rows).collect()}
    assert "### Quoted\n\n> q1\n> q2" in mark["t0"] and "- a.pdf (5 bytes)" in mark["t0"]
    full = exports.profile(rows, "full")
    exports.write_files(exports.thread_files(full), str(tmp_path / "threads"))
    assert sorted(p.name for p in (tmp_path / "threads").iterdir()) == [f"thread_t{i}.json" for i in range(3)]
    assert exports.load_canonical(spark, str(tmp_path / "threads")).count() == 7
    small = exports.profile(rows, "compact").select(F.explode("messages").alias("m")).select("m.*")
    assert {r["attachments_count"] for r in small.collect()} == {1}
    with pytest.raises(ValueError):
        exports.profile(rows, "other")
    keyed = rows.withColumns({"salutation": F.lit("Hi"), "reply": F.col("reply_text"), "signature": F.lit("z" * 400), "disclaimers": F.array().cast("array<string>")})
    tree = spark.createDataFrame([("t0", "m0", None, 0, True, False), ("t0", "m3", "m0", 1, False, False)], "thread_id string, message_key string, parent_key string, depth int, is_root boolean, is_orphan boolean")
    got = exports.profile(keyed.where("message_key in ('m0', 'm3')"), "tree", tree).first()["messages"]
    assert [(m["message_key"], m["parent_key"], len(m["signature"])) for m in got] == [("m0", None, 300), ("m3", "m0", 300)]
    assert exports.browser_sheet(rows).count() == 7
    found = spark.createDataFrame([("s1", "b.txt", bytearray(b"x")), ("s1", "a?.txt", bytearray(b"x")), ("s2", None, bytearray(b""))], "sha256 string, filename string, bytes binary")
    exports.write_attachments(found, str(tmp_path / "files"), files=True)
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "files").iterdir()] == [("s1_a_.txt", b"x")]


def test_accounts_unseen_and_forced(spark):
    m = spark.createDataFrame([("a", "in", "t", 1, "k1", 5), ("a", "out", "t", 2, "k2", 9), ("b", "in", "t", 3, "k3", 1)], "account_id string, mailbox string, thread_id string, uid bigint, message_key string, ts bigint")
    got = {r["account_id"]: (r["mailboxes"], r["n"], r["latest"]) for r in threads.account_threads(m).collect()}
    assert got == {"a": (["in", "out"], 2, 9), "b": (["in"], 1, 1)}
    flags = spark.createDataFrame([(1, ["\\Seen"]), (2, []), (3, None)], "uid bigint, flags array<string>")
    assert [r["uid"] for r in sync.unseen(flags).orderBy("uid").collect()] == [2, 3]
    old = spark.createDataFrame([("a", "in", 1), ("a", "in", 2), ("b", "in", 7)], "account_id string, mailbox string, uid bigint")
    new = old.where("uid = 2")
    assert {tuple(r) for r in sync.forced(old, new).collect()} == {("a", "in", 2), ("b", "in", 7)}


def test_folder_of_mixed_case(spark, tmp_path):
    line = b"From a@b.example Mon Jan  1 10:00:00 2024\n"
    (tmp_path / "a.MBOX").write_bytes(line + b"Subject: one\n\nx\n")
    (tmp_path / "b.mbox").write_bytes(line + b"Subject: two\n\ny\n" + line + b"Subject: three\n\nz\n")
    (tmp_path / "c.eMl").write_bytes(b"Subject: four\n\nw\n")
    raw = mbox.read_folder(spark, str(tmp_path))
    assert raw.count() == 4 and raw.where("from_line is not null").count() == 3


def test_normalized_text_keeps_single_blanks(spark):
    assert one(spark, text.normalize_text, "a \t b  c d \n\n\n\n e \r\nf g​") == "a b c d\n\n e\nf\ng"


class Client:
    """Answers like a server with three messages."""

    capabilities = ("IMAP4REV1", "CONDSTORE", "X-GM-EXT-1")

    def __init__(self):
        self.asked = []

    def select(self, mailbox, readonly):
        self.asked.append((mailbox, readonly))

    def uid(self, command, *rest):
        self.asked.append((command, *rest))
        if command == "SEARCH":
            return "OK", [b"3 7 12"]
        return "OK", [(b'1 (UID 7 RFC822.SIZE 11 INTERNALDATE "01-Jan-2024 10:00:00 +0000" FLAGS (\\Seen \\Flagged) MODSEQ (99) X-GM-THRID 1234 X-GM-LABELS (Inbox "My Label") RFC822 {11}', b"Subject: a\n"), b")", (b"2 (UID 12 RFC822 {0}", b""), b" FLAGS ())"]


def test_imap_requests_and_answers():
    from postlake.sources import imap

    client = Client()
    assert imap.select(client, "Sent", after=5) == [7, 12] and client.asked == [("Sent".join('""'), True), ("SEARCH", None, "UID 6:*")]
    first, second = imap.fetch(client, [7, 12])
    assert first == (7, 99, "01-Jan-2024 10:00:00 +0000", ["\\Seen", "\\Flagged"], 11, "1234", ["Inbox", "My Label"], b"Subject: a\n")
    assert second[0] == 12 and second[3] == [] and second[7] == b""
    assert client.asked[-1] == ("FETCH", "7,12", "(UID RFC822 INTERNALDATE FLAGS RFC822.SIZE MODSEQ X-GM-THRID X-GM-LABELS)")
    assert imap.fetch_items(False, False, True) == "(UID RFC822.HEADER INTERNALDATE FLAGS RFC822.SIZE)" and imap.changed_since(5, True, False).endswith("MODSEQ) (CHANGEDSINCE 5 VANISHED)")
    assert [len(c) for c in imap.chunked(list(range(450)))] == [200, 200, 50]
    one_, two = imap.accounts('[[accounts]]\nhost = "h"\nusername = "u"\npassword = "p"\nmailbox = "Sent"\naccount_id = "w"\n[account]\nhost = "i"\nusername = "u"\npassword = "p"\ntls = false')
    assert (one_.port, one_.mailbox, one_.account_id, two.mailbox) == (993, "Sent", "w", "INBOX") and one_.options()["port"] == "993"
    with pytest.raises(ValueError):
        two.options()


MESSAGE = """From: Ada Byron <ada@corp.example>
To: Owner <owner@example.com>
Subject: Invoice and a meeting
Date: Mon, 1 Jan 2024 10:00:00 +0000
Message-ID: <M9@corp.example>
List-Unsubscribe: <https://l.example/u>
Content-Type: text/plain; charset=utf-8

Hi Owner,

let us meet on 2024-03-01 10:30 CET.
https://zoom.us/j/9
View invoice https://shop.example/inv/7

That is all that I have to say.

Best regards,
Ada Byron
Corp GmbH
linkedin.com/in/adabyron

---- Forwarded message ----
From: Bo <bo@b.example>
Subject: Older
Message-ID: <inner.1234@b.example>

Older text that was sent by Bo some time ago.
"""


def test_all_stages_of_a_message(spark):
    from postlake.operators import mail

    raw = spark.createDataFrame([("a.eml", 0, None, bytearray(MESSAGE.encode())), ("b.eml", 0, None, bytearray(b""))], "path string, offset bigint, separator_date string, raw binary")
    got = {r["path"]: r.asDict(recursive=True) for r in mail.analyse(raw, owners=["owner@example.com"]).collect()}
    a = got["a.eml"]
    assert a["salutation"] == "Hi Owner," and a["reply_text"].startswith("let us meet") and a["signature"].startswith("Best regards,")
    assert a["forwarded_ids"] == ["inner.1234@b.example"] and [s["subject"] for s in a["forwarded_segments"]] == ["Older"] and a["forwarded_segments"][0]["from"] == [{"address": "bo@b.example", "name": "Bo"}]
    assert {h["linked_entity_key"] for h in a["contact_hints"] if h["url"]} == {"ada byron|corp.example"} and "Owner" in {h["name"] for h in a["contact_hints"] if h["source"] == "salutation"}
    assert a["event_hint"]["meeting_links"] == ["https://zoom.us/j/9"] and a["event_hint"]["is_complete"]
    assert [b["kind"] for b in a["billing_actions"]] == ["view_invoice"] and a["direction"]["direction"] == "inbound" and a["unsubscribe_hints"][0]["url"] == "https://l.example/u"
    assert a["mail_kind"]["kind"] and a["date_raw"].startswith("Mon, 1 Jan") and a["headers"]["subject"] == "Invoice and a meeting"
    b = got["b.eml"]
    assert b["body"] == "" and b["event_hint"] is None and b["contact_hints"] == [] and b["reply_text"] == ""
