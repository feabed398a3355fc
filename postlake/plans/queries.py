"""The registered queries over the mailbox view and the pages table, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import html as H
from ..functions import text as T
from ..lexicon import RESERVATIONS, bounded, default_lexicon
from ..operators import hints, projection, segmentation, threads
from ..sinks import exports
from ..streaming import sync
from ..wordlists import MAIL_KINDS, NEWSLETTER_SENDERS
from .mailbox import MAIL_SQL, _q, duplicated, mail, sql_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LEXICON = default_lexicon()


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# --- pieces of SQL ---------------------------------------------------------------------------------
LOW = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WS = T.WS
TRIM = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
STRIP = lambda x, c: f"regexp_replace({x}, {_q(f'^[{c}]+|[{c}]+$')}, '', 'g')"
MID = lambda x: LOW(TRIM(f"regexp_replace({TRIM(x)}, '^<+|>+$', '', 'g')"))
SHORT = lambda x: f"left(sha256({MID(x)}), 16)"
WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"
COUNT = lambda t, items: f"len(list_filter({sql_list(items)}, lambda p: contains({t}, p)))"
LINES = lambda x: f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {TRIM('l')}), lambda l: l <> '')"
SUBJECT = "nullif(" + TRIM(f"regexp_replace({LOW(f"regexp_replace({TRIM('subject')}, '{WS}+', ' ', 'g')")}, '^(?:(?:re|fwd|fw):\\s*)+', '')") + ", '')"
DISPLAY = f"coalesce(nullif({TRIM(f"regexp_replace({TRIM('subject')}, '^(?i:(?:re|fwd|fw):\\s*)+', '')")}, ''), '(no-subject)')"
ADDRESS_EMAIL = lambda x: LOW(TRIM(f"CASE WHEN regexp_matches({x}, '<[^>]*>') THEN regexp_extract({x}, '<([^>]*)>', 1) ELSE {x} END"))
URLS = f"list_sort(list_distinct(list_transform(list_filter({WORDS('body')}, lambda w: starts_with(w, 'http://') OR starts_with(w, 'https://')), lambda w: regexp_replace(w, '[.,;:)\\]]+$', ''))))"
FALLBACK = "'fallback:' || sha256(coalesce(subject, '') || coalesce(date, '') || array_to_string(senders, '') || left(body, 512))"
PEOPLE = f"array_to_string(list_sort(list_distinct(list_transform(list_concat(senders, \"to\", cc), lambda a: {LOW(TRIM('a'))}))), ',')"
KEYS_SQL = (
    "WITH "
    + MAIL_SQL
    + f""", keyed AS (
  SELECT *, {SHORT(f"coalesce(message_id, {FALLBACK})")} AS message_key,
    {SHORT(f"coalesce(refs[1], in_reply_to, message_id, 'subject:' || {SUBJECT} || '|participants:' || {PEOPLE})")} AS thread_id,
    epoch_ms(coalesce(date, internal_date)::TIMESTAMPTZ) AS ts
  FROM mail
)"""
)


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.with_keys(mail(spark, sf_dir))


# --- threads -----------------------------------------------------------------------------------------
@query(KEYS_SQL + " SELECT thread_id, array_to_string(list_transform(list_sort(list({'ts': ts, 'uid': uid, 'k': message_key})), lambda m: m.k), ',') AS keys, max(ts) AS latest, count(*) AS n FROM keyed GROUP BY thread_id")
def r09_threads(spark, sf_dir):
    t = threads.threads(keyed(spark, sf_dir))
    return t.select("thread_id", F.array_join(F.transform("messages", lambda m: m["message_key"]), ",").alias("keys"), "latest", "n")


@query(KEYS_SQL + " SELECT uid, message_key, thread_id, ts FROM keyed")
def r10_thread_keys(spark, sf_dir):
    return keyed(spark, sf_dir).select("uid", "message_key", "thread_id", "ts")


@query(KEYS_SQL + " SELECT uid, message_key, thread_id FROM keyed WHERE thread_id IN (SELECT thread_id FROM keyed GROUP BY thread_id ORDER BY max(ts) DESC, thread_id DESC LIMIT 25)")
def r05_newest_threads(spark, sf_dir):
    return threads.newest_threads(keyed(spark, sf_dir), 25).select("uid", "message_key", "thread_id")


@query(
    "WITH " + MAIL_SQL + f""", twice AS (
  SELECT path, idx, message_id FROM mail UNION ALL SELECT 'b.mbox', idx, lower(regexp_replace(message_id, '[<>]', '', 'g')) FROM mail WHERE conv_id % 11 = 5)
SELECT path, idx, message_id FROM twice QUALIFY row_number() OVER (PARTITION BY coalesce(nullif({MID("message_id")}, ''), path || '|' || idx) ORDER BY path, idx) = 1"""
)
def r12_dedupe(spark, sf_dir):
    return threads.dedupe(duplicated(mail(spark, sf_dir))).select("path", "idx", "message_id")


PARENT_SQL = KEYS_SQL + f""", ids AS (SELECT thread_id, {MID("message_id")} AS ref, max_by(message_key, (ts, uid, message_key)) AS found FROM keyed WHERE message_id IS NOT NULL GROUP BY ALL),
calls AS (SELECT thread_id, message_key, unnest(list_transform(list_concat(refs, [coalesce(in_reply_to, '')]), lambda r: {MID("r")})) AS ref, generate_subscripts(list_concat(refs, [coalesce(in_reply_to, '')]), 1) AS pos FROM keyed),
hits AS (SELECT thread_id, message_key, max_by(found, pos) AS parent_key FROM calls JOIN ids USING (thread_id, ref) WHERE found <> message_key GROUP BY ALL),
linked AS (SELECT thread_id, message_key, ts, uid, parent_key FROM keyed LEFT JOIN hits USING (thread_id, message_key))"""  # fmt: skip


@query(PARENT_SQL + " SELECT thread_id, message_key, parent_key FROM linked")
def r13_reply_parent(spark, sf_dir):
    return threads.parents(keyed(spark, sf_dir)).select("thread_id", "message_key", "parent_key")


@query(
    PARENT_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, tops AS (SELECT thread_id, message_key, row_number() OVER (PARTITION BY thread_id ORDER BY ts, uid, message_key) AS n FROM linked WHERE parent_key IS NULL),
walk AS (SELECT thread_id, message_key, NULL::VARCHAR AS parent_key, 0 AS depth, n = 1 AS is_root, n > 1 AS is_orphan FROM tops
  UNION ALL SELECT l.thread_id, l.message_key, l.parent_key, w.depth + 1, false, false FROM linked l JOIN walk w ON l.thread_id = w.thread_id AND l.parent_key = w.message_key)
SELECT * FROM walk"""
)
def r14_reply_tree(spark, sf_dir):
    return threads.reply_tree(threads.parents(keyed(spark, sf_dir)))


# --- hints ---------------------------------------------------------------------------------------------
S = lambda k: COUNT("t", MAIL_KINDS[k].split("|"))
SENDERS = f"{COUNT('lower(h_from)', NEWSLETTER_SENDERS.split('|'))} > 0"
AUTO = f"{COUNT('lower(h_from)', ['no-reply', 'noreply', 'newsletter', 'updates@'])} > 0"
HINTS_SQL = (
    KEYS_SQL
    + f""", s0 AS (SELECT *, lower(subject) || chr(10) || lower(body) AS t, {LOW("subject")} || chr(10) || {LOW("body")} AS a FROM keyed),
s1 AS (SELECT *, 2 * {S("promotion")} AS promo, 2 * {S("transactional")} AS trans, {S("personal")} AS pers,
  {S("notification")} + contains(t, 'notification')::INT + 2 * h_auto::INT + ({AUTO} AND NOT {SENDERS})::INT AS notif,
  2 * {S("newsletter")} + 3 * (h_unsub IS NOT NULL)::INT + 3 * h_list::INT + 2 * h_bulk::INT + 2 * ({SENDERS})::INT + ({SENDERS} AND {AUTO})::INT AS news0 FROM s0),
s2 AS (SELECT *, news0 + (news0 >= 3 AND promo >= 3)::INT AS news FROM s1),
s3 AS (SELECT *, list_sort(list_filter([{{'minus': -trans, 'rank': 0, 'kind': 'transactional'}}, {{'minus': -news, 'rank': 1, 'kind': 'newsletter'}}, {{'minus': -notif, 'rank': 2, 'kind': 'notification'}}, {{'minus': -promo, 'rank': 3, 'kind': 'promotion'}}, {{'minus': -pers, 'rank': 4, 'kind': 'personal'}}], lambda r: r.minus < 0)) AS sc FROM s2),
s4 AS (SELECT *, coalesce(sc[1].kind, 'unknown') AS mail_kind, coalesce(-sc[1].minus, 0) AS score, coalesce(-sc[2].minus, 0) AS score2 FROM s3),
s5 AS (SELECT *, CASE WHEN score >= 5 AND score - score2 >= 2 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS how, CASE WHEN score - score2 <= 1 AND score2 >= 3 THEN sc[2].kind END AS second,
  CASE WHEN mail_kind IN ('transactional', 'notification') THEN 'allow' WHEN mail_kind IN ('newsletter', 'promotion') THEN 'block' ELSE 'strong_only' END AS gate,
  {COUNT("a", hints.STRUCTURE)} >= 2 AS strong FROM s4)"""
)


def bound(df: DataFrame, **made) -> DataFrame:
    """df with columns that are made once: a generator keeps them from being put in the place of every use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def kinds(df: DataFrame) -> DataFrame:
    """Provisional kinds, by which the lifecycle gate goes."""
    df = bound(df, signals=hints.mail_kind_signals(F.col("subject"), F.col("body"), F.col("headers")))
    return bound(df, mk=hints.mail_kind(hints.scores_of(F.col("signals"))))


def lifecycles(df: DataFrame) -> DataFrame:
    """kinds() with the lifecycle hint, and the final kinds, which a lifecycle hint of high confidence has a say in."""
    gate = hints.lifecycle_gate(F.col("mk.kind"))
    df = bound(kinds(df), lc=hints.lifecycle(F.col("subject"), F.col("body"), F.col("headers"), gate, LEXICON))
    return bound(df, final=hints.mail_kind(hints.scores_of(F.col("signals"), F.col("lc.confidence") == "high")))


@query(HINTS_SQL + " SELECT uid, gate, strong FROM s5")
def h07_lifecycle_gate(spark, sf_dir):
    return kinds(keyed(spark, sf_dir)).select("uid", hints.lifecycle_gate(F.col("mk.kind")).alias("gate"), hints.strong_structure(F.concat_ws("\n", "subject", "body")).alias("strong"))


FINAL = "trans + 3 * (open AND lk IS NOT NULL AND strong)::INT"
RX = lambda t, ps: f"regexp_matches({t}, {_q(bounded(ps))})"
RULES = "CASE " + " ".join("WHEN " + " AND ".join(RX("a", g) for g in r.groups) + f" THEN {_q(r.kind)}" for r in LEXICON.lifecycle) + " END"
SIGNALS = "CASE " + " ".join("WHEN " + " AND ".join(RX("a", g) for g in r.groups) + f" THEN {_q(r.signal)}" for r in LEXICON.lifecycle) + " END"
LAST = lambda test: f"list_filter({LINES('body')}, lambda l: {test})[-1]"
VALUE = lambda rx: TRIM(f"regexp_replace({LAST(f"regexp_matches({LOW('l')}, '{rx}')")}, '(?s)^[^:]*:', '')")
NAME, EMAIL, PLAN, DATE = "^customer name:", "^customer email:", "^(?:offer|plan):", "^(?:effective |renewal )?date:"
MONEY = LAST(f"regexp_matches({LOW('l')}, '\\$| usd| eur| gbp') AND NOT regexp_matches({LOW('l')}, '{NAME}|{EMAIL}|{PLAN}|{DATE}')")
LIFE_SQL = (
    HINTS_SQL
    + f""", life AS (SELECT *, {RULES} AS lk, {SIGNALS} AS signal, {VALUE(PLAN)} AS plan_name, {VALUE(NAME)} AS customer_name, {VALUE(EMAIL)} AS customer_email, {VALUE(DATE)} AS effective_date_raw, {MONEY} AS amount_raw,
  gate = 'allow' OR (strong AND {RX("a", LEXICON.patterns["lifecycle_keyword"])}) OR (gate = 'strong_only' AND ({COUNT(LOW("h_from"), LEXICON.patterns["known_billing_senders"])} > 0 OR {RX("a", LEXICON.patterns["confirmation_gate"])})) AS open FROM s5),
hits AS (SELECT * FROM life WHERE open AND lk IS NOT NULL),
f1 AS (SELECT *, list_sort(list_filter([{{'minus': -({FINAL}), 'rank': 0, 'kind': 'transactional'}}, {{'minus': -news, 'rank': 1, 'kind': 'newsletter'}}, {{'minus': -notif, 'rank': 2, 'kind': 'notification'}}, {{'minus': -promo, 'rank': 3, 'kind': 'promotion'}}, {{'minus': -pers, 'rank': 4, 'kind': 'personal'}}], lambda r: r.minus < 0)) AS fsc FROM life),
f2 AS (SELECT *, coalesce(fsc[1].kind, 'unknown') AS final_kind, coalesce(-fsc[1].minus, 0) AS fscore, coalesce(-fsc[2].minus, 0) AS fscore2 FROM f1),
final AS (SELECT *, CASE WHEN fscore >= 5 AND fscore - fscore2 >= 2 THEN 'high' WHEN fscore >= 3 THEN 'medium' ELSE 'low' END AS fhow, CASE WHEN fscore - fscore2 <= 1 AND fscore2 >= 3 THEN fsc[2].kind END AS fsecond FROM f2)"""
)


@query(LIFE_SQL + " SELECT uid, final_kind AS kind, fhow AS confidence, fscore::INTEGER AS score, fsecond AS second, mail_kind AS provisional FROM final")
def h05_mail_kind(spark, sf_dir):
    return lifecycles(keyed(spark, sf_dir)).select("uid", "final.*", F.col("mk.kind").alias("provisional"))


@query(
    LIFE_SQL + f""" SELECT uid, lk AS kind, CASE WHEN strong THEN 'high' WHEN lk IN ('subscription_canceled', 'subscription_renewed') THEN 'medium' ELSE 'low' END AS confidence, regexp_replace({TRIM("string_split(h_from, '@')[2]")}, '>+$', '') AS provider,
  plan_name, customer_name, customer_email, amount_raw, CASE WHEN regexp_matches({LOW("amount_raw")}, '\\$| usd') THEN 'USD' WHEN contains({LOW("amount_raw")}, ' eur') THEN 'EUR' WHEN contains({LOW("amount_raw")}, ' gbp') THEN 'GBP' END AS currency, effective_date_raw, signal FROM hits"""
)
def h09_lifecycle(spark, sf_dir):
    gate = hints.lifecycle_gate(F.col("mk.kind"))
    lc = hints.lifecycle(F.col("subject"), F.col("body"), F.col("headers"), gate, LEXICON)
    return kinds(keyed(spark, sf_dir)).select("uid", F.inline(F.filter(F.array(lc), lambda x: x.isNotNull())))


BILLS = "CASE " + " ".join(f"WHEN {RX(LOW('line'), ps)} THEN {_q(k)}" for _, k, ps in LEXICON.billing) + " END"
LINE_URLS = f"list_filter(list_transform({WORDS('line')}, lambda w: {STRIP('w', '<>()\\[\\]\"\',')}), lambda w: regexp_matches(w, '^https?://'))"


@query(
    "WITH " + MAIL_SQL + f""", ln AS (SELECT uid, unnest({LINES("body")}) AS line, generate_subscripts({LINES("body")}, 1) AS pos FROM mail),
cl AS (SELECT *, {BILLS} AS kind, {LINE_URLS} AS urls FROM ln),
ex AS (SELECT uid, kind, pos, line, CASE WHEN len(urls) > 0 THEN unnest(urls) END AS url FROM cl WHERE kind IS NOT NULL AND len(urls) > 0 UNION ALL SELECT uid, kind, pos, line, NULL FROM cl WHERE kind IS NOT NULL AND len(urls) = 0)
SELECT uid, kind, url, line AS label, CASE WHEN url IS NULL THEN 'body_text' ELSE 'body_link' END AS source, CASE WHEN url IS NULL THEN 'low' ELSE 'medium' END AS confidence FROM ex
QUALIFY row_number() OVER (PARTITION BY uid, kind, url IS NULL, coalesce(url, {LOW("line")}) ORDER BY pos) = 1"""
)
def h10_billing_actions(spark, sf_dir):
    return mail(spark, sf_dir).select("uid", F.explode(hints.billing_actions(F.col("body"), LEXICON)).alias("b")).select("uid", "b.*").drop("related_lifecycle_kind")


@query(
    "WITH " + MAIL_SQL + f""", parts AS (SELECT uid, unnest(list_transform(string_split(h_unsub, ','), lambda p: {STRIP(TRIM("p"), "<>")})) AS p FROM mail WHERE h_unsub IS NOT NULL),
ln AS (SELECT uid, unnest({LINES("body")}) AS line, generate_subscripts({LINES("body")}, 1) AS pos FROM mail),
cl AS (SELECT *, {LINE_URLS} AS urls FROM ln WHERE regexp_matches({LOW("line")}, 'unsubscribe|manage preferences')),
found AS (
  SELECT uid, 'url' AS kind, 'header_list_unsubscribe' AS source, p AS url, NULL AS email, 'list_unsubscribe' AS label, 'high' AS confidence, 0 AS pos FROM parts WHERE regexp_matches(p, '^https?://')
  UNION ALL SELECT uid, 'mail_to', 'header_list_unsubscribe', NULL, {TRIM("p[8:]")}, 'list_unsubscribe', 'high', 0 FROM parts WHERE starts_with(p, 'mailto:')
  UNION ALL SELECT uid, CASE WHEN contains({LOW("h_post")}, 'one-click') THEN 'one_click' ELSE 'unknown' END, 'header_list_unsubscribe_post', NULL, NULL, h_post, 'high', 0 FROM mail WHERE h_post IS NOT NULL
  UNION ALL SELECT uid, CASE WHEN contains({LOW("line")}, 'manage preferences') THEN 'manage_preferences' ELSE 'url' END, 'body_link', unnest(urls), NULL, 'unsubscribe_link', 'medium', pos FROM cl
  UNION ALL SELECT uid, 'unknown', 'body_text', NULL, NULL, line, 'low', pos FROM cl WHERE len(urls) = 0)
SELECT uid, kind, source, url, email, label, confidence FROM found QUALIFY row_number() OVER (PARTITION BY uid, source, kind, url, email ORDER BY pos) = 1"""
)
def h06_unsubscribe(spark, sf_dir):
    return mail(spark, sf_dir).select("uid", F.explode(hints.unsubscribe(F.col("headers"), F.col("body"))).alias("u")).select("uid", "u.*")


OWNERS = ["owner@example.com", "User.0@gmail.com", "user.3@gmail.com"]
_own = lambda x: f"{LOW(ADDRESS_EMAIL(x))} IN ('owner@example.com', 'user.0@gmail.com', 'user.3@gmail.com')"


@query(
    "WITH " + MAIL_SQL + f""", d AS (SELECT uid, len(list_filter(senders, lambda x: {_own("x")})) > 0 AS fo, len(list_filter(senders, lambda x: NOT ({_own("x")}))) > 0 AS fx, len(list_filter(list_concat("to", cc), lambda x: {_own("x")})) > 0 AS ro, len(list_filter(list_concat("to", cc), lambda x: NOT ({_own("x")}))) > 0 AS rx FROM mail),
e AS (SELECT uid, CASE WHEN fo AND rx AND NOT fx THEN 1 WHEN NOT fo AND ro THEN 2 WHEN fo AND ro THEN 3 ELSE 4 END AS n FROM d)
SELECT uid, ['outbound', 'inbound', 'self', 'unknown'][n] AS direction, ['high', 'high', 'medium', 'low'][n] AS confidence, 'owner@example.com' AS matched_owner, ['from_owner', 'to_owner', 'both', 'no_match'][n] AS reason FROM e"""
)
def h11_direction(spark, sf_dir):
    emails = lambda c: F.transform(c, A.address_email)
    return mail(spark, sf_dir).select("uid", hints.direction(emails(F.col("senders")), emails(F.concat("to", "cc")), OWNERS).alias("d")).select("uid", "d.*")


_res = "CASE " + " ".join(f"WHEN {COUNT('a', LEXICON.patterns[f'event_reservation_{k}'])} > 0 THEN '{k}'" for k in RESERVATIONS) + f" WHEN {COUNT('a', LEXICON.patterns['event_reservation_intent'])} > 0 THEN 'other' END"
_events = [f for f in LEXICON.patterns if f.startswith("event_")]


@query("WITH " + MAIL_SQL + f", x AS (SELECT uid, {LOW('subject')} || chr(10) || {LOW('body')} AS a FROM mail) SELECT uid, " + ", ".join(f"{COUNT('a', LEXICON.patterns[f])} > 0 AS {f.removeprefix('event_')}" for f in _events) + f", {_res} AS reservation_type FROM x")
def l08_event_terms(spark, sf_dir):
    text = T.ascii_lower(F.concat_ws("\n", "subject", "body"))
    return mail(spark, sf_dir).select("uid", hints.event_terms(text, LEXICON).alias("e")).select("uid", "e.*")


@query("WITH " + MAIL_SQL + f", x AS (SELECT uid, {LOW('subject')} || chr(10) || {LOW('body')} AS a FROM mail) SELECT uid, {RULES} AS kind, {SIGNALS} AS signal, {RX('a', LEXICON.patterns['lifecycle_keyword'])} AS keyword, {RX('a', LEXICON.patterns['confirmation_gate'])} AS gate FROM x")
def l05_rule_match(spark, sf_dir):
    text = T.ascii_lower(F.concat_ws("\n", "subject", "body"))
    return mail(spark, sf_dir).select("uid", LEXICON.classify_lifecycle(text).alias("kind"), LEXICON.lifecycle_signal(text).alias("signal"), LEXICON.matches("lifecycle_keyword", text).alias("keyword"), LEXICON.matches("confirmation_gate", text).alias("gate"))


# --- projection ------------------------------------------------------------------------------------------
ROWS_SQL = (
    LIFE_SQL
    + f""", rows AS (SELECT thread_id, message_key, uid AS ordinal, subject, coalesce(date, '') AS date, senders AS "from", "to", cc, body AS reply_text,
  list_filter([final_kind, fsecond], lambda x: x IS NOT NULL) AS mail_kinds, CASE WHEN {_res} IS NOT NULL THEN ['reservation'] ELSE [] END AS event_kinds,
  CASE WHEN open AND lk IS NOT NULL THEN [replace(lk, '_', '')] ELSE [] END AS lifecycle_kinds, body FROM final)"""
)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection rows of the mailbox (R01), with whole bodies as replies; bodies.rows() has them with their replies and events."""
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    booked = F.when(LEXICON.reservation_type(T.ascii_lower(F.concat_ws("\n", "subject", "body"))).isNotNull(), F.lit("reservation"))
    return lifecycles(keyed(spark, sf_dir)).select("thread_id", "message_key", F.col("uid").alias("ordinal"), "subject", F.coalesce("date", F.lit("")).alias("date"), F.col("senders").alias("from"), "to", "cc", F.col("body").alias("reply_text"), some("final.kind", "final.second").alias("mail_kinds"), some(booked).alias("event_kinds"), some(F.replace(F.col("lc.kind"), F.lit("_"), F.lit(""))).alias("lifecycle_kinds"))


FLAT = ["from", "to", "cc", "mail_kinds", "event_kinds", "lifecycle_kinds"]
FLAT_SQL = "thread_id, message_key, subject, date, " + ", ".join(f"array_to_string(\"{c}\", '; ') AS \"{c}\"" for c in FLAT) + ", reply_text"


def flat(df: DataFrame) -> DataFrame:
    return df.select("thread_id", "message_key", "subject", "date", *(F.array_join(c, "; ").alias(c) for c in FLAT), "reply_text")


@query(ROWS_SQL + f" SELECT {FLAT_SQL} FROM rows")
def r01_projection_rows(spark, sf_dir):
    return flat(rows(spark, sf_dir))


Q = projection.ProjectionQuery("i", "2024-01-02", "2024-02-20", mail_kind="transactional", sort="subject_asc", limit=40)
Q_SQL = ROWS_SQL + ", q AS (SELECT *, CASE WHEN length(date) >= 10 THEN left(date, 10) ELSE '' END AS d FROM rows), picked AS (SELECT * FROM q WHERE contains(lower(subject), 'i') AND (d = '' OR d >= '2024-01-02') AND (d = '' OR d <= '2024-02-20') AND list_contains(mail_kinds, 'transactional') ORDER BY subject, ordinal LIMIT 40)"


@query(Q_SQL + f" SELECT {FLAT_SQL} FROM picked")
def r02_filter_sort_limit(spark, sf_dir):
    return flat(projection.apply_query(rows(spark, sf_dir), Q))


@query(ROWS_SQL + " SELECT DISTINCT facet, value FROM (SELECT 'mail_kind' AS facet, unnest(mail_kinds) AS value FROM rows UNION ALL SELECT 'event_kind', unnest(event_kinds) FROM rows UNION ALL SELECT 'lifecycle_kind', unnest(lifecycle_kinds) FROM rows)")
def r06_facets(spark, sf_dir):
    return projection.facets(rows(spark, sf_dir))


def _links(key: str, layer: str) -> str:
    m = "'M:' || message_key"
    out = f"SELECT 'T:' || {key} AS source, {m} AS target, 'contains' AS kind FROM rows"
    if layer != "core":
        out += f" UNION SELECT {m}, 'P:' || a, 'participant' FROM (SELECT message_key, {ADDRESS_EMAIL('p')} AS a FROM (SELECT message_key, unnest(list_concat(\"from\", \"to\", cc)) AS p FROM rows)) WHERE a <> ''"
    if layer == "all":
        out += f" UNION SELECT {m}, 'U:' || unnest({URLS}), 'mentions' FROM rows UNION SELECT {m}, 'D:' || left(date, 10), 'dated' FROM rows WHERE date <> ''"
    return out


def _nodes(key: str) -> str:
    return f"""each AS (
  SELECT 'T:' || {key} AS id, 'thread' AS node_type, subject AS label, NULL AS body, ordinal FROM rows
  UNION ALL SELECT 'M:' || message_key, 'message', subject, reply_text, ordinal FROM rows
  UNION ALL SELECT 'P:' || a, 'person', a, NULL, ordinal FROM (SELECT ordinal, {ADDRESS_EMAIL("p")} AS a FROM (SELECT ordinal, unnest(list_concat("from", "to", cc)) AS p FROM rows)) WHERE a <> ''
  UNION ALL SELECT 'U:' || u, 'url', u, NULL, ordinal FROM (SELECT ordinal, unnest({URLS}) AS u FROM rows)
  UNION ALL SELECT 'D:' || left(date, 10), 'date', left(date, 10), NULL, ordinal FROM rows WHERE date <> '')"""


NODES_SQL = "SELECT id, node_type, arg_min(label, ordinal) AS label, arg_min(body, ordinal) AS body, left(arg_min(body, ordinal), 240) AS snippet FROM each GROUP BY ALL"


@query(ROWS_SQL + ", " + _nodes("thread_id") + NODES_SQL)
def r08_graph_nodes(spark, sf_dir):
    return projection.graph_nodes(rows(spark, sf_dir))


for _name, _key, _group, _layer in (("r08_graph_links", "thread_id", "thread", "all"), ("r08_graph_by_subject", DISPLAY, "subject", "all"), ("r08_graph_people_layer", "thread_id", "thread", "people"), ("r08_graph_core_layer", "thread_id", "thread", "core")):
    query(ROWS_SQL + " " + _links(_key, _layer), _name)(lambda spark, sf_dir, g=_group, y=_layer: projection.graph_links(rows(spark, sf_dir), g, y))


@query(ROWS_SQL + ", " + _nodes("thread_id") + f", n AS ({NODES_SQL}), l AS ({_links('thread_id', 'all')}) SELECT (SELECT count(*) FROM rows) AS n_rows, (SELECT count(DISTINCT thread_id) FROM rows) AS n_threads, (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM l) AS n_links")
def r07_stats(spark, sf_dir):
    return projection.stats(rows(spark, sf_dir))


ATT_SQL = "WITH " + MAIL_SQL + """, att AS (SELECT uid AS message_key, conv_id % 3 AS idx, sha256((conv_id % 20)::VARCHAR) AS sha256, ((conv_id * 7919) % 1200000 * (conv_id % 5 > 0)::INT)::BIGINT AS size, ['Logo.png', 'a.pdf', NULL, 'icon.gif'][turn % 4 + 1] AS filename,
  ['image/png', 'application/pdf', 'IMAGE/gif'][conv_id % 3 + 1] AS mime_type, CASE WHEN k % 3 = 0 THEN 'cid' || k END AS content_id, ['inline', 'attachment', 'Inline'][k % 3 + 1] AS content_disposition, CASE WHEN k % 7 = 0 THEN 'own' END AS path FROM mail)"""


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda e, *items: F.element_at(F.array(*map(F.lit, items)), F.expr(f"cast({e} + 1 as int)"))
    return mail(spark, sf_dir).select(F.col("uid").alias("message_key"), F.expr("conv_id % 3").alias("idx"), F.sha2(F.expr("cast(conv_id % 20 as string)"), 256).alias("sha256"), F.expr("(conv_id * 7919) % 1200000 * cast(conv_id % 5 > 0 as int)").alias("size"), pick("turn % 4", "Logo.png", "a.pdf", None, "icon.gif").alias("filename"), pick("conv_id % 3", "image/png", "application/pdf", "IMAGE/gif").alias("mime_type"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("cid"), F.col("k").cast("string"))).alias("content_id"), pick("k % 3", "inline", "attachment", "Inline").alias("content_disposition"), F.when(F.col("k") % 7 == 0, F.lit("own")).alias("path"))


@query(ATT_SQL + f", i AS (SELECT *, content_id IS NOT NULL OR lower(content_disposition) = 'inline' AS is_inline, starts_with(lower(mime_type), 'image/') AS im FROM att) SELECT message_key, is_inline, is_inline AND im AND size <= 40000 AND {COUNT("lower(coalesce(filename, ''))", hints.LOGO)} > 0 AS is_probable_logo, im AND size <= 2000 AS is_tracking_pixel_like, CASE WHEN size < 4000 THEN 'tiny' WHEN size < 64000 THEN 'small' WHEN size < 1000000 THEN 'medium' ELSE 'large' END AS size_bucket FROM i")
def h03_attachment_hints(spark, sf_dir):
    a = attachments(spark, sf_dir)
    return a.select("message_key", hints.attachment_hint(F.struct(*a.columns)).alias("h")).select("message_key", "h.*")


@query(ATT_SQL + ", paths AS (SELECT DISTINCT sha256, 'files/' || sha256 AS path FROM att WHERE size > 0) SELECT message_key, sha256, coalesce(att.path, paths.path) AS path FROM att LEFT JOIN paths USING (sha256)")
def r17_attachment_paths(spark, sf_dir):
    a = attachments(spark, sf_dir)
    paths = a.where("size > 0").select("sha256", F.concat(F.lit("files/"), "sha256").alias("path")).distinct()
    return projection.attach_paths(a, paths).select("message_key", "sha256", "path")


@query(ATT_SQL + " SELECT sha256, message_key, size FROM att WHERE size > 0 QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY message_key, idx) = 1")
def r18_distinct_attachments(spark, sf_dir):
    return projection.distinct_attachments(attachments(spark, sf_dir)).select("sha256", "message_key", "size")


@query("WITH " + MAIL_SQL + " SELECT uid FROM mail WHERE uid % 3 = 0")
def r20_expunged(spark, sf_dir):
    m = mail(spark, sf_dir)
    return threads.expunged(m, m.where("uid % 3 <> 0"))


# --- scalars -----------------------------------------------------------------------------------------------
_addr = 'WITH ' + MAIL_SQL + ', a AS (SELECT uid, unnest(list_concat(list_concat(senders, "to"), list_concat(cc, [h_from]))) AS raw FROM mail), e AS (SELECT *, ' + f"lower({TRIM(STRIP(TRIM("CASE WHEN regexp_matches(raw, '(?s)<.*>') THEN regexp_extract(raw, '(?s)^[^<]*<(.*)>[^>]*$', 1) ELSE raw END"), '<>,.;'))}) AS email FROM a), d AS (SELECT *, CASE WHEN contains(email, '@') THEN {LOW(TRIM("regexp_replace(email, '(?s)^[^@]*@', '')"))} END AS domain FROM e)"


@query(_addr + f" SELECT uid, raw, email, domain, array_to_string(list_filter(string_split(domain, '.'), lambda x: x <> '')[-2:], '.') AS root, CASE WHEN domain IN ({', '.join(map(_q, A.PERSONAL))}) THEN 'personal' ELSE 'company' END AS bucket, 'email:' || sha256(email) AS entity, {ADDRESS_EMAIL('raw')} AS bare FROM d")
def a01_addresses(spark, sf_dir):
    raw = F.explode(F.concat("senders", "to", "cc", F.array(F.element_at("headers", F.lit("from")))))
    e = mail(spark, sf_dir).select("uid", raw.alias("raw")).withColumn("email", A.normalize_email(F.col("raw"))).withColumn("domain", A.email_domain(F.col("email")))
    return e.select("uid", "raw", "email", "domain", A.root_domain(F.col("domain")).alias("root"), A.domain_bucket(F.col("domain")).alias("bucket"), A.entity_id(F.col("raw")).alias("entity"), A.address_email(F.col("raw")).alias("bare"))


_rest = "regexp_replace(url, '^(?i:https?://)?(?i:www[.])*', '')"


@query(f"SELECT page_id, {LOW(STRIP(f"regexp_extract({_rest}, '(?s)^[^/?#]*')", '.'))} AS host, {LOW(f"list_filter(string_split(regexp_extract(regexp_replace({_rest}, '(?s)^[^/?#]*', ''), '(?s)^[^?#]*'), '/'), lambda x: x <> '')[1]")} AS segment FROM pages")
def a11_url_parts(spark, sf_dir):
    u = F.col("url")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", A.url_host(u).alias("host"), A.first_segment(A.url_path(u)).alias("segment"))


@query("WITH " + MAIL_SQL + f""", w AS (SELECT uid, {WORDS("body")} AS ws FROM mail)
SELECT uid, array_to_string(list_sort(list_distinct(list_filter(list_transform(ws, lambda t: regexp_replace(regexp_replace({LOW(STRIP("t", '<>()\\[\\]{},;:"' + "'"))}, '^(?:mailto:)+', ''), '^[.]+|[.]+$', '', 'g')), lambda t: contains(t, '@') AND contains(t, '.')))), ' ') AS emails,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(ws, lambda t: regexp_replace(t, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 8 AND 15))), ' ') AS phones FROM w""")  # fmt: skip
def a14_contact_tokens(spark, sf_dir):
    join = lambda a: F.array_join(F.array_sort(a), " ")
    return mail(spark, sf_dir).select("uid", join(A.email_tokens(F.col("body"))).alias("emails"), join(A.phone_tokens(F.col("body"))).alias("phones"))


@query()
def a16_url_tokens(spark, sf_dir):
    # bound, since an explode has its array made a second time by a filter of its size
    m = bound(mail(spark, sf_dir).select("uid", "body"), urls=A.url_tokens(F.col("body")))
    return m.select("uid", F.explode("urls").alias("url")).select("uid", "url", A.profile(F.col("url")).alias("p")).select("uid", "url", "p.*")


_sp = "[^\\S\\n]|[\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
_norm = f"regexp_replace(translate(regexp_replace(text, '\\r\\n', chr(10), 'g'), chr(13) || chr(8232) || chr(8233), chr(10) || chr(10) || chr(10)), '[{T.INVISIBLE}]', '', 'g')"


@query(f"SELECT doc_id, {TRIM(f"regexp_replace(regexp_replace(regexp_replace({_norm}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?:{_sp})+', ' ', 'g'), '(?m) +$', '', 'g')")} AS body FROM documents")
def t01_normalize_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.normalize_text(F.col("text")).alias("body"))


_flag = lambda n: f"coalesce(last_value(CASE WHEN closed AND starts_with(tag, '{n}') THEN true WHEN closed AND starts_with(tag, '/{n}') THEN false END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"


@query(f"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<[^>]*(?:>|$)|[^<]+')) AS t, generate_subscripts(regexp_extract_all(html, '(?s)<[^>]*(?:>|$)|[^<]+'), 1) AS i FROM pages),
m AS (SELECT *, {LOW(TRIM("regexp_replace(t, '^<|>$', '', 'g')"))} AS tag, starts_with(t, '<') AND ends_with(t, '>') AS closed FROM p),
f AS (SELECT *, {_flag("script")} AS sc, {_flag("style")} AS st FROM m),
o AS (SELECT page_id, {TRIM("string_agg(CASE WHEN starts_with(t, '<') THEN CASE WHEN closed AND regexp_matches(tag, '^(?:br|/p|/li|p|li)') THEN chr(10) ELSE '' END WHEN sc OR st THEN '' ELSE t END, '' ORDER BY i)")} AS body FROM f GROUP BY page_id),
n AS (SELECT page_id, body, unnest(regexp_extract_all(body, '(?s)&[^;]{{0,13}}(?:.|$)|[^&]+')) AS t, generate_subscripts(regexp_extract_all(body, '(?s)&[^;]{{0,13}}(?:.|$)|[^&]+'), 1) AS i FROM o),
e AS (SELECT *, regexp_extract(t, '(?s)^&([^;]{{0,13}})', 1) AS name FROM n)
SELECT page_id, string_agg(CASE WHEN NOT starts_with(t, '&') THEN t WHEN name = 'nbsp' THEN ' ' WHEN name = 'lt' THEN '<' WHEN name = 'gt' THEN '>' WHEN name = 'amp' THEN '&' WHEN name = 'quot' THEN '"' WHEN name = 'apos' THEN chr(39)
  WHEN regexp_matches(name, '^#[0-9]+$') THEN chr(name[2:]::INTEGER) WHEN starts_with(name, '#') THEN '' ELSE '&' || name END, '' ORDER BY i) AS body FROM e GROUP BY page_id""")  # fmt: skip
def t02_html_to_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", H.html_to_text(F.col("html")).alias("body"))


@query(KEYS_SQL + f" SELECT uid, {SUBJECT} AS subject_key, {DISPLAY} AS display, array_to_string({URLS}, ' ') AS urls, CASE WHEN regexp_matches(body, '[\",\\n\\r]') THEN '\"' || replace(body, '\"', '\"\"') || '\"' ELSE body END AS csv FROM keyed")
def t09_subjects_urls_csv(spark, sf_dir):
    return mail(spark, sf_dir).select("uid", T.subject_key(F.col("subject")).alias("subject_key"), T.display_subject(F.col("subject")).alias("display"), F.array_join(T.mentioned_urls(F.col("body")), " ").alias("urls"), T.csv_escape(F.col("body")).alias("csv"))


@query("WITH " + MAIL_SQL + """, h AS (SELECT uid, unnest([('from', h_from), ('subject', subject), ('x-long', 'one two')]) AS p FROM mail) SELECT uid, p[1] AS name, p[2] AS value FROM h""".replace("('", "{'a': '").replace("', ", "', 'b': ").replace(")]", "}]").replace("), {", "}, {").replace("p[1]", "p.a").replace("p[2]", "p.b"))
def m04_raw_headers(spark, sf_dir):
    m = mail(spark, sf_dir)
    raw = F.concat(F.lit("Subject: old\r\nFrom: "), F.element_at("headers", F.lit("from")), F.lit("\r\nX-Long: one\r\n\ttwo\r\nnot a header\r\n dropped: x\r\nEmpty:\r\nSUBJECT: "), "subject", F.lit("\r\n\r\nBody: no\r\n"))
    return m.select("uid", F.explode(T.raw_headers(T.header_slice(raw))).alias("name", "value"))


@query(ROWS_SQL + " SELECT thread_id, message_key, subject, date, " + ", ".join(f"array_to_string(\"{c}\", '; ') AS \"{c}\"" for c in FLAT[:3]) + ", reply_text, " + ", ".join(f"array_to_string(\"{c}\", '; ') AS \"{c}\"" for c in FLAT[3:]) + " FROM rows")
def k04_csv_rows(spark, sf_dir):
    return exports.csv_rows(rows(spark, sf_dir))


# --- segmentation and incremental sync ---------------------------------------------------------------------
@query()
def g11_reply_text(spark, sf_dir):
    b = segmentation.with_blocks(mail(spark, sf_dir), "uid", "body")
    first = {k: segmentation.first_block(F.col("blocks"), k).alias(k) for k in ("salutation", "signature", "quoted", "forwarded", "disclaimer")}
    return b.select("uid", segmentation.reply_text(F.col("blocks")).alias("reply"), *first.values(), F.size("blocks").alias("n_blocks"))


@query("SELECT user_id AS uid, arg_max(event_type, event_id) AS body, max(event_id) AS modseq FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def x03_incremental_upsert(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    changes = e.select(F.lit("a").alias("account_id"), F.lit("in").alias("mailbox"), F.col("user_id").alias("uid"), F.lit(1).alias("uidvalidity"), F.col("event_id").alias("modseq"), (F.col("event_type") == "error").alias("vanished"), F.col("event_type").alias("body"))
    return sync.visible(sync.latest(changes)).select("uid", "body", "modseq")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def x09_windowed_counts(spark, sf_dir):
    counts = sync.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
