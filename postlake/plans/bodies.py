"""Registered queries of bodies, contacts, events and forwards, and of the scalars that the other queries don't use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import bodies as B
from ..functions import html as H
from ..functions import text as T
from ..operators import contacts, events, forwards, segmentation, threads
from ..sinks import exports
from .mailbox import MAIL_SQL, _q, mail, sql_list
from .queries import KEYS_SQL, LEXICON, LINES, LOW, ROWS_SQL, STRIP, TRIM, WORDS, WS, kinds, lifecycles, query
from .queries import rows as plain_rows

CSS = "body,td { color:#222; font:11px/1.3 Verdana; } .x{margin:0} p { a:b }; "
FOOT = "\nSee you soon and thanks for all of your help today\nView image: https://i.example/1\nFollow us on facebook.com/x\nmanage preferences or unsubscribe\nhttps://a.example/u\nThis email was intended for you"
GREET = ("Dear ", "Hello", "hi ", "Bonjour, ", "Thanks ", "Hallo-", "Witam Anna from Acme ", "Hola Ana gracias por ", "")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mailbox with style rules before some bodies, footers after others, and as HTML in some."""
    k = F.col("k")
    m = mail(spark, sf_dir)
    body = F.concat(F.when(k % 4 == 1, CSS).otherwise(""), "body", F.when(k % 3 == 1, FOOT).otherwise(""))
    return m.select("uid", "k", "subject", "headers", body.alias("body"), F.when(k % 5 == 0, F.concat(F.lit("<p>"), "body", F.lit("</p>"))).alias("html"))


TEXTS_SQL = f"WITH {MAIL_SQL}, texts AS (SELECT uid, k, subject, CASE WHEN k % 4 = 1 THEN {_q(CSS)} ELSE '' END || body || CASE WHEN k % 3 = 1 THEN {_q(FOOT)} ELSE '' END AS body, CASE WHEN k % 5 = 0 THEN '<p>' || body || '</p>' END AS html FROM mail)"


# --- bodies ------------------------------------------------------------------------------------------------
@query(f"SELECT page_id, regexp_matches({LOW('html')}, '<(?:html|body|table|div)') OR (contains(html, '</') AND contains(html, '>')) AS page, regexp_matches({LOW('url')}, '<(?:html|body|table|div)') OR (contains(url, '</') AND contains(url, '>')) AS address FROM pages")
def t04_inline_html(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", H.looks_like_html(F.col("html")).alias("page"), H.looks_like_html(F.col("url")).alias("address"))


_set = "[A-Za-z0-9\\s.,#@:_*+>~()=\"/;%\\[\\]" + "''" + "-]"
_rule = f"(?:[;,\\s]*(?:@{_set}*|{_set}*[.#\\[\\]*]{_set}*|{_set}*[^\\s;,{{{{}}}}][, ]+[^\\s;,{{{{}}}}]{_set}*|[A-Za-z][A-Za-z0-9_-]*[;,\\s]*)\\{{[^}}<]*:[^}}<]*\\}}[\\s}};]*)".replace("{{", "{").replace("}}", "}")


def STYLES(x: str) -> str:  # noqa: N802
    return TRIM(f"regexp_replace({TRIM(x)}, '^{_rule}{{1,400}}', '')")


@query(TEXTS_SQL + f" SELECT uid, {STYLES('body')} AS body FROM texts")
def t05_strip_styles(spark, sf_dir):
    return texts(spark, sf_dir).select("uid", B.strip_styles(F.col("body")).alias("body"))


_low = LOW(TRIM("l"))
_all = "string_split(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))"
_tail = "|".join(B.TAILS)


def FOOTER(source: str, columns: str, x: str, name: str) -> str:  # noqa: N802
    """CTEs that end in name, which has the columns and body, x of source without its footer."""
    cuts = " ".join(f"WHEN contains({LOW('t')}, {_q(m)}) AND octet_length(encode(left(t, instr({LOW('t')}, {_q(m)})::INT - 1))) >= octet_length(encode(t)) // 3 THEN left(t, instr({LOW('t')}, {_q(m)})::INT - 1)" for m in B.TAILS)
    return f"""{name}0 AS (SELECT {columns}, {x} AS raw, {_all.format(x=x)} AS every FROM {source}),
{name}1 AS (SELECT *, list_filter(every, lambda l: NOT regexp_matches({_low}, '{B.IMAGE_LINES}')) AS plain FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN len(plain) > 0 THEN plain ELSE every END AS ls FROM {name}1),
{name}3 AS (SELECT *, list_position(list_transform(ls, lambda l, i: i - 1 >= len(ls) // 3 AND regexp_matches({_low}, '{B.FOOTER}')), true) AS f FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN f > 0 AND len(list_filter(ls[f:], lambda l: regexp_matches({_low}, '{B.FOOTER}'))) >= 2 AND len(list_filter(ls[f:], lambda l: regexp_matches({_low}, '{B.STRONG}'))) > 0 THEN ls[:f - 1] ELSE ls END AS kept FROM {name}3),
{name}5 AS (SELECT *, list_position(list_transform(kept, lambda l, i: i - 1 >= len(kept) // 2 AND regexp_matches({_low}, '{_tail}')), true) AS g FROM {name}4),
{name}6 AS (SELECT *, {TRIM("array_to_string(CASE WHEN g > 0 THEN kept[:g - 1] ELSE kept END, chr(10))")} AS t FROM {name}5),
{name} AS (SELECT {columns}, CASE WHEN len(every) < 4 THEN {TRIM("raw")} ELSE {TRIM(f"CASE {cuts} ELSE t END")} END AS body FROM {name}6)"""


@query(TEXTS_SQL + ", " + FOOTER("texts", "uid", "body", "cut") + " SELECT uid, body FROM cut")
def t06_strip_footer(spark, sf_dir):
    return texts(spark, sf_dir).select("uid", B.strip_footer(F.col("body")).alias("body"))


_sp = "[^\\S\\n]|[\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
_norm = f"regexp_replace(translate(regexp_replace(body, '\\r\\n', chr(10), 'g'), chr(13) || chr(8232) || chr(8233), chr(10) || chr(10) || chr(10)), '[{T.INVISIBLE}]', '', 'g')"
NORMAL = TRIM(f"regexp_replace(regexp_replace(regexp_replace({_norm}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?:{_sp})+', ' ', 'g'), '(?m) +$', '', 'g')")


@query(
    TEXTS_SQL + ", " + FOOTER("texts", "uid, html", STYLES("body"), "one") + f", styled AS (SELECT uid, html, {STYLES('body')} AS body FROM one), "
    + FOOTER("styled", "uid, html", "body", "two") + f", done AS (SELECT s.uid, CASE WHEN s.html IS NOT NULL THEN two.body ELSE s.body END AS body FROM styled s JOIN two USING (uid)) SELECT uid, {NORMAL} AS body FROM done"
)
def t07_canonical_body(spark, sf_dir):
    return texts(spark, sf_dir).select("uid", B.canonical_body(F.col("body"), F.col("html")).alias("body"))


@query(f"SELECT doc_id, translate(regexp_replace(text, '\\r\\n', chr(10), 'g'), chr(13) || chr(8232) || chr(8233), chr(10) || chr(10) || chr(10)) AS body FROM documents")
def t08_line_ends(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.normalize_line_ends(F.col("text")).alias("body"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e'), chr(8232), '\\u2028'), chr(8233), '\\u2029') AS script, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;') AS html FROM pages")
def t12_escapes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", T.script_json(F.col("html")).alias("script"), T.html_escape(F.col("url")).alias("html"))


# --- parts of bodies ---------------------------------------------------------------------------------------
_head, _sig = "left(body, 50)", "left(body, 300)"


@query(
    "WITH " + MAIL_SQL + f""" SELECT uid, CASE WHEN octet_length(encode(body)) <= 50 THEN body WHEN regexp_matches({_head}, '(?s)^.{{4}}[^,.!?;:]*[,.!?;:]') THEN regexp_extract({_head}, '(?s)^.{{4}}[^,.!?;:]*[,.!?;:]') ELSE {_head} END AS salutation,
  CASE WHEN octet_length(encode(body)) <= 300 THEN body WHEN contains({_sig}, chr(10)) THEN regexp_replace({_sig}, '(?s)\\n[^\\n]*$', '') ELSE {_sig} END AS signature FROM mail"""
)
def g17_caps(spark, sf_dir):
    return mail(spark, sf_dir).select("uid", segmentation.salutation_cap(F.col("body")).alias("salutation"), segmentation.signature_cap(F.col("body")).alias("signature"))


def greetings(df: DataFrame) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, GREET)), (F.col("uid") % len(GREET) + 1).cast("int"))
    return df.select("uid", F.concat(pick, F.substring("body", 1, 40)).alias("line"))


_pre = "^(?i:" + contacts.GREETINGS + ")(?:$|([ ,:;.!-]|[A-Z]))"
_rest = f"CASE WHEN regexp_matches(line, '{_pre}') THEN regexp_replace(substr(line, length(regexp_extract(line, '^(?i:{contacts.GREETINGS})')) + 1), '^[\\s,:;.-]+', '') ELSE line END"
_upto = lambda m: f"left(rest, greatest(instr(' ' || {LOW('rest')} || ' ', {_q(m)})::INT - 2, 0))"
_cut = (
    "CASE WHEN contains(rest, ',') THEN regexp_replace(rest, '(?s),.*$', '') WHEN contains(rest, ';') THEN regexp_replace(rest, '(?s);.*$', '') "
    + " ".join(f"WHEN contains(' ' || {LOW('rest')} || ' ', {_q(m)}) THEN {_upto(m)}" for m in (" from ", *contacts.TAILS))
    + " ELSE rest END"
)


@query(
    "WITH " + MAIL_SQL + f""", g AS (SELECT uid, {TRIM(f"({sql_list(GREET)})[uid % {len(GREET)} + 1] || left(body, 40)")} AS line FROM mail), r AS (SELECT *, {_rest} AS rest FROM g),
n AS (SELECT uid, line, {TRIM(f"regexp_replace(regexp_replace({TRIM(_cut)}, '[\\s,.;:!?]+$', ''), '{WS}+', ' ', 'g')")} AS name FROM r)
SELECT uid, CASE WHEN {LOW('line')} NOT IN ({", ".join(map(_q, contacts.GREETINGS.split("|")))}) AND regexp_matches(name, '[\\pL\\pN]') THEN name END AS name FROM n"""
)
def g18_salutation_names(spark, sf_dir):
    return greetings(mail(spark, sf_dir)).select("uid", contacts.salutation_name(F.col("line")).alias("name"))


_some = lambda test: f"array_to_string(list_sort(list_distinct(list_filter(lines, lambda l: {test}))), chr(10))"
_words = lambda w: f"regexp_matches({LOW('l')}, '{w}')"


@query(
    "WITH " + MAIL_SQL + f""", w AS (SELECT uid, {WORDS("body")} AS ws, {LINES("body")} AS lines FROM mail),
e AS (SELECT uid, lines, list_distinct(list_filter(list_transform(ws, lambda t: regexp_replace(regexp_replace({LOW(STRIP("t", '<>()\\[\\]{},;:"' + "'"))}, '^(?:mailto:)+', ''), '^[.]+|[.]+$', '', 'g')), lambda t: contains(t, '@') AND contains(t, '.'))) AS emails,
  list_distinct(list_filter(list_transform(ws, lambda t: regexp_replace(t, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 8 AND 15)) AS phones FROM w)
SELECT uid, array_to_string(list_sort(emails), ' ') AS emails, array_to_string(list_sort(phones), ' ') AS phones, {_some(_words(contacts.ORGANISATION))} AS organization_lines, {_some(_words(contacts.TITLE))} AS title_lines, {_some(_words(contacts.PLACE) + " OR length(regexp_replace(l, '[^0-9]', '', 'g')) >= 4")} AS address_lines, len(emails) = 0 AND len(phones) = 0 AS is_partial FROM e"""
)
def h01_signature_entities(spark, sf_dir):
    """Of whole bodies, so that every rule has work; h02 takes the signatures."""
    join = lambda c, by: F.array_join(F.array_sort(F.col(c)), by).alias(c.split(".")[1])
    e = mail(spark, sf_dir).select("uid", contacts.signature_entities(F.col("body")).alias("e"))
    return e.select("uid", join("e.emails", " "), join("e.phones", " "), *(join(f"e.{k}_lines", "\n") for k in ("organization", "title", "address")), "e.is_partial")


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mailbox with canonical bodies and the parts of each."""
    m = mail(spark, sf_dir).withColumn("canonical", B.canonical_body(F.col("body"), F.lit(None).cast("string")))
    return segmentation.add_parts(m, "canonical")


def parsed(xs):
    return F.filter(F.transform(xs, A.parse_address), lambda a: a.isNotNull())


@query()
def h02_contact_hints(spark, sf_dir):
    m = mail(spark, sf_dir).select("uid", "headers", "to", "cc", B.canonical_body(F.col("body"), F.lit(None).cast("string")).alias("canonical"))
    df = segmentation.add_parts(m, "canonical", "salutation", "signature").withColumn("entities", contacts.signature_entities(F.col("signature")))
    headers = {"from": parsed(F.array(F.element_at("headers", F.lit("from")))), "to": parsed(F.col("to")), "cc": parsed(F.col("cc"))}
    return df.select("uid", F.posexplode(contacts.contact_hints(headers, F.col("salutation"), F.col("entities"))).alias("place", "c")).select("uid", "place", "c.*")


DATES = ("Your parcel ships on 12 March 2024, tracking number 77", "Deadline: 2024-05-06 10:00 UTC", "Table for two, reservation for Friday 3 May 2024\n12 High Street, Leeds", "Zoom meeting 2024-06-01 09:30 GMT https://zoom.us/j/1", "I am available on Monday 3 June 2024 from 10:00", "12 bar 40 mm in May", "No date here")


@query()
def h04_event_hints(spark, sf_dir):
    line = F.element_at(F.array(*map(F.lit, DATES)), (F.col("uid") % len(DATES) + 1).cast("int"))
    m = mail(spark, sf_dir).withColumn("canonical", B.canonical_body(F.col("body"), F.lit(None).cast("string")))
    m = kinds(m.select("uid", "subject", "headers", "body", "canonical")).select("uid", "subject", "canonical", F.col("mk.kind").alias("mail_kind"))
    df = segmentation.add_parts(m, "canonical", "reply").select("uid", "subject", F.concat_ws("\n", "reply", line).alias("reply"), "mail_kind")
    return events.event_hints(df, "uid", LEXICON)


@query()
def g14_forwarded_segments(spark, sf_dir):
    m = mail(spark, sf_dir)
    inner = F.concat(F.lit("\n\n---------- Forwarded message ---------\nFrom: Ann Lee <ann@a.example>\nDate: Mon, 1 Jan 2024\nSubject: Plans\nTo: Bo <bo@b.example>,\n cy@c.example\nMessage-ID: <inner."), F.col("uid").cast("string"), F.lit("@mail.example>\n\nHello Bo,\nhere are the plans that we spoke of.\n\nBest regards,\nAnn Lee"))
    nested = F.when(F.col("uid") % 2 == 0, F.concat(inner, F.lit("\n\nBegin forwarded message:\n*Von:* Dora <dora@d.example>\n*Gesendet:* 3. Januar\n*Betreff:* Alt\n\nAlter Text, der weitergeleitet wurde."))).otherwise(inner)
    m = m.select("uid", F.concat(F.substring("body", 1, 60), nested).alias("body"))
    return forwards.body_segments(m, "uid", "body").drop("header_lines")


@query("WITH " + MAIL_SQL + ", f AS (SELECT uid, CASE WHEN k % 2 = 0 THEN ['a@x.example', 'b@x.example'] ELSE [] END AS attached, CASE WHEN k % 3 = 0 THEN ['B@x.example', 'c' || k || '@x.example'] ELSE [] END AS named FROM mail) SELECT uid, array_to_string(list_concat(attached, list_filter(list_transform(named, lambda i: lower(i)), lambda i: NOT list_contains(attached, i))), ' ') AS ids FROM f")
def m12_forwarded_ids(spark, sf_dir):
    blocks = lambda text: F.array(F.struct(F.lit("forwarded").alias("kind"), text.alias("text")))
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit("> Message-ID: <B@x.example>\nhello\nmessage-id: <c"), F.col("k").cast("string"), F.lit("@x.example>"))).otherwise("no id")
    attached = F.when(F.col("k") % 2 == 0, F.array(F.lit("a@x.example"), F.lit("b@x.example"))).otherwise(F.array().cast("array<string>"))
    return mail(spark, sf_dir).select("uid", F.array_join(forwards.merged_forwards(attached, segmentation.forwarded_ids(blocks(text))), " ").alias("ids"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection rows with replies cut out of canonical bodies, event kinds of event hints, and the other hints of canonical bodies."""
    m = mail(spark, sf_dir).withColumn("body", B.canonical_body(F.col("body"), F.lit(None).cast("string")))
    m = threads.with_keys(m)
    kept = ("thread_id", "message_key", "uid", "subject", "date", "senders", "to", "cc")
    df = lifecycles(m.select(*kept, "body", "headers")).select(*kept, "body", F.col("mk.kind").alias("mail_kind"), "final", F.col("lc.kind").alias("lc_kind"))
    df = events.add_events(segmentation.add_parts(df, "body", "reply"), LEXICON)
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    return df.select("thread_id", "message_key", F.col("uid").alias("ordinal"), "subject", F.coalesce("date", F.lit("")).alias("date"), F.col("senders").alias("from"), "to", "cc", F.col("reply").alias("reply_text"), some("final.kind", "final.second").alias("mail_kinds"), some("event.kind").alias("event_kinds"), some(F.replace(F.col("lc_kind"), F.lit("_"), F.lit(""))).alias("lifecycle_kinds"))


@query()
def r01_reply_rows(spark, sf_dir):
    return exports.csv_rows(rows(spark, sf_dir))


@query()
def r15_canonical_threads(spark, sf_dir):
    return exports.canonical_messages(analysed(spark, sf_dir).transform(threads.with_keys))


# --- accounts, snapshots and exports -----------------------------------------------------------------------
@query(
    KEYS_SQL
    + ", a AS (SELECT *, 'a' || conv_id % 3 AS account_id, 'box' || turn % 2 AS mailbox FROM keyed) SELECT account_id, thread_id, array_to_string(list_sort(list_distinct(list(mailbox))), ',') AS mailboxes, count(*) AS n, max(ts) AS latest FROM a GROUP BY ALL"
)
def r16_account_threads(spark, sf_dir):
    m = mail(spark, sf_dir).withColumns({"account_id": F.concat(F.lit("a"), (F.col("conv_id") % 3).cast("string")), "mailbox": F.concat(F.lit("box"), (F.col("turn") % 2).cast("string"))})
    return threads.account_threads(threads.with_keys(m)).select("account_id", "thread_id", F.array_join("mailboxes", ",").alias("mailboxes"), "n", "latest")


@query("WITH " + MAIL_SQL + ", g AS (SELECT uid, 'T' || conv_id AS thrid, CASE WHEN k % 4 = 0 THEN [] ELSE ['Inbox', 'k' || k] END AS labels FROM mail WHERE k % 3 <> 0) SELECT m.uid, g.thrid, array_to_string(CASE WHEN len(g.labels) > 0 THEN g.labels ELSE ['own'] END, ',') AS labels FROM mail m LEFT JOIN g USING (uid)")
def s13_gmail_metadata(spark, sf_dir):
    m = mail(spark, sf_dir)
    fetched = m.where("k % 3 <> 0").select("uid", F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("thrid"), F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Inbox"), F.concat(F.lit("k"), F.col("k").cast("string")))).alias("labels"))
    own = m.select("uid", F.lit(None).cast("string").alias("thrid"), F.array(F.lit("own")).alias("labels"))
    return threads.with_gmail(own, fetched).select("uid", "thrid", F.array_join("labels", ",").alias("labels"))


@query("WITH " + MAIL_SQL + " SELECT uid FROM mail WHERE k % 3 <> 1")
def x06_unseen(spark, sf_dir):
    from ..streaming import sync

    flags = F.when(F.col("k") % 3 == 1, F.array(F.lit("\\Answered"), F.lit("\\Seen"))).otherwise(F.array(F.lit("\\Flagged")))
    return sync.unseen(mail(spark, sf_dir).withColumn("flags", flags)).select("uid")


@query("SELECT user_id AS uid, max(event_id) AS modseq FROM events WHERE event_id % 5 <> 0 GROUP BY ALL")
def x02_full_sync(spark, sf_dir):
    """A full read after an invalidation replaces all that is known of a mailbox: what it doesn't have is gone."""
    from ..streaming import sync

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("a").alias("account_id"), F.lit("in").alias("mailbox"), F.col("user_id").alias("uid"), F.col("event_id").alias("modseq"), F.lit(False).alias("vanished"))
    old, new = e.withColumn("uidvalidity", F.lit(1)), e.where("event_id % 5 <> 0").withColumn("uidvalidity", F.lit(1))
    return sync.visible(sync.latest(sync.forced(old, new))).select("uid", "modseq")


_flat = lambda c: f"array_to_string(\"{c}\", ' | ')"


@query(ROWS_SQL + f" SELECT date, {_flat('from')} AS \"from\", {_flat('to')} AS \"to\", {_flat('cc')} AS cc, subject, {_flat('mail_kinds')} AS mail_kinds, {_flat('event_kinds')} AS event_kinds, {_flat('lifecycle_kinds')} AS lifecycle_kinds, {TRIM(f"regexp_replace(reply_text, '{WS}+', ' ', 'g')")} AS body, message_key FROM rows")
def k07_browser_rows(spark, sf_dir):
    return exports.browser_rows(plain_rows(spark, sf_dir))


# --- scalars -----------------------------------------------------------------------------------------------
_raw = "WITH " + MAIL_SQL + ", a AS (SELECT uid, unnest(list_concat(list_concat(senders, \"to\"), list_concat(cc, [h_from, '\"Q, R\" <Q.R@x.example>', 'bad'])) ) AS raw FROM mail)"
_email = f"lower({TRIM(STRIP(TRIM("CASE WHEN regexp_matches(raw, '(?s)<.*>') THEN regexp_extract(raw, '(?s)^[^<]*<(.*)>[^>]*$', 1) ELSE raw END"), '<>,.;'))})"
_named = f"CASE WHEN regexp_matches(raw, '(?s)<.*>') THEN nullif({TRIM(STRIP(TRIM("split_part(raw, '<', 1)"), chr(34) + "''"))}, '') END"
_valid = "octet_length(encode(email)) BETWEEN 6 AND 254 AND regexp_matches(email, '(?s)^[^@]+@.*\\..*$') AND NOT ends_with(email, '@')"


@query(_raw + f", e AS (SELECT uid, raw, {_email} AS email, {_named} AS name FROM a) SELECT uid, raw, CASE WHEN {_valid} THEN email END AS address, CASE WHEN {_valid} THEN name END AS name, CASE WHEN {_valid} THEN CASE WHEN name IS NULL THEN email ELSE name || ' <' || email || '>' END END AS shown FROM e")
def a03_parse_address(spark, sf_dir):
    raw = F.explode(F.concat("senders", "to", "cc", F.array(F.element_at("headers", F.lit("from")), F.lit('"Q, R" <Q.R@x.example>'), F.lit("bad")))).alias("raw")
    p = mail(spark, sf_dir).select("uid", raw).withColumn("a", A.parse_address(F.col("raw")))
    return p.select("uid", "raw", "a.address", "a.name", A.format_address(F.col("a")).alias("shown"))


@query("WITH " + MAIL_SQL + f", n AS (SELECT uid, {LOW(TRIM(f"regexp_replace(subject, '{WS}+', ' ', 'g')"))} AS n, CASE WHEN k % 3 > 0 THEN 'd' || k || '.example' END AS d FROM mail) SELECT uid, n || '|' || coalesce(d, '') AS link_key, array_to_string(list_filter(regexp_split_to_array(n, '[^a-z0-9]+'), lambda t: length(t) >= 3), ' ') AS tokens FROM n")
def a10_link_keys(spark, sf_dir):
    domain = F.when(F.col("k") % 3 > 0, F.concat(F.lit("d"), F.col("k").cast("string"), F.lit(".example")))
    return mail(spark, sf_dir).select("uid", A.link_key(F.col("subject"), domain).alias("link_key"), F.array_join(A.name_tokens(F.col("subject")), " ").alias("tokens"))


_host = LOW(STRIP("regexp_extract(regexp_replace(url, '^(?i:https?://)?(?i:www[.])*', ''), '^[^/?#]*')", "."))
_path = "regexp_replace(regexp_replace(url, '^(?i:https?://)?(?i:www[.])*', ''), '^[^/?#]*', '')"
_profile = "CASE " + " ".join("WHEN " + " OR ".join(f"ends_with(host, '{e}')" for e in ends) + f" THEN '{name}'" for name, ends in A.PROFILES)
SITES = ("https://www.linkedin.com/company/Acme/about", "http://linkedin.com/in/jo-doe?x=1", "https://linkedin.com/feed", "https://X.com/Someone", "github.com/Some/repo", "https://www.example.org/a", "https://youtu.be/abc#t", "https://m.facebook.com/")


@query(
    "WITH " + MAIL_SQL + f""", u AS (SELECT uid, ({sql_list(SITES)})[k % {len(SITES)} + 1] AS url FROM mail), p AS (SELECT uid, url, {_host} AS host, {LOW(_path)} AS path FROM u),
s AS (SELECT *, nullif(regexp_extract(path, '^/*([^/?#]*)', 1), '') AS seg, regexp_replace(path, '^/+', '') AS p FROM p)
SELECT uid, url, CASE WHEN ends_with(host, 'linkedin.com') THEN CASE WHEN starts_with(p, 'company/') THEN 'linkedin_company' WHEN starts_with(p, 'in/') THEN 'linkedin_person' ELSE 'other' END ELSE {_profile} ELSE 'website' END END AS type,
  CASE WHEN ends_with(host, 'linkedin.com') AND starts_with(p, 'company/') THEN nullif(regexp_extract(p, '^(?:company/)+([^/]*)', 1), '') WHEN ends_with(host, 'linkedin.com') AND starts_with(p, 'in/') THEN nullif(regexp_extract(p, '^(?:in/)+([^/]*)', 1), '') WHEN ends_with(host, 'linkedin.com') OR {_profile} END IS NOT NULL THEN seg END AS handle, host FROM s"""
)
def a13_profiles(spark, sf_dir):
    url = F.element_at(F.array(*map(F.lit, SITES)), (F.col("k") % len(SITES) + 1).cast("int"))
    return mail(spark, sf_dir).select("uid", url.alias("url")).select("uid", "url", A.profile(F.col("url")).alias("p")).select("uid", "url", "p.*")


@query("WITH " + MAIL_SQL + ", r AS (SELECT uid, CASE WHEN k % 4 = 0 THEN NULL ELSE CASE WHEN k % 2 = 0 THEN array_to_string(refs, ', ') ELSE array_to_string(refs, chr(10) || ' ') END || ' <LAST@X>' END AS raw FROM mail) SELECT uid, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(raw, ''), '[\\s,]+'), lambda x: lower(regexp_replace(x, '^<+|>+$', '', 'g'))), lambda x: x <> ''), ' ') AS ids FROM r")
def m06_references(spark, sf_dir):
    joined = F.when(F.col("k") % 2 == 0, F.array_join("references", ", ")).otherwise(F.array_join("references", "\n "))
    raw = F.when(F.col("k") % 4 != 0, F.concat(joined, F.lit(" <LAST@X>")))
    return mail(spark, sf_dir).select("uid", F.array_join(T.references(raw), " ").alias("ids"))


_names = ("../a b?.pdf", "", "...", "Rechnung Nr. 7.PDF", "x" * 130, "ä_ö.txt")


@query("WITH " + MAIL_SQL + f", n AS (SELECT uid, ({sql_list(_names)})[k % {len(_names)} + 1] AS raw, sha256(uid::VARCHAR) AS sha FROM mail), s AS (SELECT *, regexp_replace(regexp_replace(raw, '[^A-Za-z0-9._-]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS safe FROM n) SELECT uid, sha || '_' || CASE WHEN safe = '' THEN 'attachment' ELSE left(safe, 120) END AS name FROM s")
def k08_attachment_names(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, _names)), (F.col("k") % len(_names) + 1).cast("int"))
    return mail(spark, sf_dir).select("uid", exports.attachment_name(F.sha2(F.col("uid").cast("string"), 256), raw).alias("name"))
