"""A mailbox made of the conversations table, as DataFrame and as DuckDB SQL.

The tables have no mail, so every turn becomes a message: with ids and references, or without
them in some conversations, and with a head and a tail that give the hint operators work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADS = ("Hi Tom,\n", "", "Bonjour,\n")
TAILS = (
    "\nBest regards,\nAnna Kow\nanna@corp.example +48123456789 www.corp.example",
    "\nUnsubscribe: https://news.example.com/u?id=1",
    "\nYour subscription has been canceled\nCustomer name: Jo Doe\nCustomer email: jo@x.example\nPlan: Gold\nTotal $12.50",
    "\nOrder confirmation\nView invoice https://shop.example/inv/7\nDate: 2024-02-01",
    "\nManage preferences (https://news.example.com/p), [site](https://linkedin.com/company/Acme/)",
    "\nOn Mon, Jan 1 2024 Bob wrote:\n> old text\n> more",
    "\nMeeting on zoom, join us\n12/03/2024 10:30",
    "",
    "\nInvoice number: 77\nPlan: Basic\nAmount 10 EUR\npayment failed",
    "\nsale discount 20% off coupon",
    "\n-----Original Message-----\nFrom: a@b.example\nSent: today",
    "\nTable for two at the restaurant, booking id 9",
    "\nplease find attached, let me know. https://github.com/Someone/repo",
    "\nnewsletter weekly digest read more unsubscribe",
    "\nPay now <https://pay.example/x>, pago",
    "\nSent from my phone",
)
SUBJECTS = ("Topic", "Weekly newsletter", "Invoice", "Alert", "Plans")
DOMAINS = ("Gmail.com", "mail.corp.example", "billing.stripe.example", "substack.com")


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a message table, with headers as a map."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    k, conv, turn = F.expr("(conv_id * 31 + turn * 7) % 16"), F.col("conv_id").cast("string"), F.col("turn")
    ids = F.col("conv_id") % 7 != 3
    mid = lambda t: F.concat(F.lit("<C"), conv, F.lit("-T"), t.cast("string"), F.lit("@Mail.Example.com>"))
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (at + 1).cast("int"))
    secs = F.expr("conv_id * 3600 + turn * 60")
    two = lambda e: F.lpad(F.expr(e).cast("string"), 2, "0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (secs / 86400).cast("int")).cast("string")
    date = F.concat(day, F.lit("T"), two("(conv_id * 3600 + turn * 60) % 86400 div 3600"), F.lit(":"), two("turn % 60"), F.lit(":00+00:00"))
    sender = F.concat(F.col("role"), F.lit("."), k.cast("string"), F.lit("@"), pick(DOMAINS, k % 4))
    to = F.when(k % 3 == 0, F.array(F.lit("owner@example.com"))).when(k % 3 == 1, F.array(F.lit("Team <team@corp.example>"), F.lit("owner@example.com"))).otherwise(F.array(F.lit("other@example.org")))
    when = lambda cond, v: F.when(cond, v)
    headers = {"from": F.concat(F.initcap("role"), F.lit(" <"), sender, F.lit(">")), "list-unsubscribe": when(k % 5 == 1, F.lit("<https://l.example/u>, <mailto: out@l.example>")), "list-unsubscribe-post": when(k % 10 == 1, F.lit("List-Unsubscribe=One-Click")), "list-id": when(k % 8 == 1, F.lit("<l.example>")), "precedence": when(k % 8 == 5, F.lit("Bulk")), "auto-submitted": when(k % 8 == 7, F.lit("auto-generated"))}
    pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in headers.items())), lambda p: p["v"].isNotNull())
    return c.select(
        "conv_id", turn, k.alias("k"), F.lit("a.mbox").alias("path"), F.expr("conv_id * 100 + turn").alias("idx"), F.expr("conv_id * 100 + turn").alias("uid"),
        when(ids, mid(turn)).alias("message_id"),
        when(ids & (turn > 0), mid(turn - 1)).alias("in_reply_to"),
        when(ids & (turn > 0) & (F.col("conv_id") % 3 != 1), F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(turn - 1, F.lit(0))), mid)).otherwise(F.array().cast("array<string>")).alias("references"),
        F.concat(F.expr("repeat('Re: ', cast(turn as int))"), pick(SUBJECTS, F.col("conv_id") % 5), F.lit(" "), (F.col("conv_id") % 50).cast("string")).alias("subject"),
        when(F.col("conv_id") % 13 != 4, date).alias("date"), date.alias("internal_date"),
        F.array(sender).alias("senders"), to.alias("to"), when(k % 5 == 0, F.array(F.lit("CC <cc@Example.org>"))).otherwise(F.array().cast("array<string>")).alias("cc"),
        F.concat(pick(HEADS, k % 3), "text", pick(TAILS, k)).alias("body"),
        F.map_from_entries(pairs).alias("headers"),
    ).withColumn("participants", F.concat("senders", "to", "cc"))


def duplicated(messages: DataFrame) -> DataFrame:
    """The messages with copies of some of them from another file, whose ids differ in case and brackets."""
    copies = messages.where("conv_id % 11 = 5").withColumn("path", F.lit("b.mbox")).withColumn("message_id", F.lower(F.regexp_replace("message_id", "[<>]", "")))
    return messages.unionByName(copies)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


_MID = "'<C' || conv_id || '-T' || {t} || '@Mail.Example.com>'"
MAIL_SQL = f"""mail AS (
  SELECT conv_id, turn, k, 'a.mbox' AS path, conv_id * 100 + turn AS idx, conv_id * 100 + turn AS uid,
    CASE WHEN ids THEN {_MID.format(t="turn")} END AS message_id,
    CASE WHEN ids AND turn > 0 THEN {_MID.format(t="(turn - 1)")} END AS in_reply_to,
    CASE WHEN ids AND turn > 0 AND conv_id % 3 <> 1 THEN list_transform(range(0, turn), lambda t: {_MID.format(t="t")}) ELSE [] END AS refs,
    repeat('Re: ', turn::INTEGER) || ({sql_list(SUBJECTS)})[conv_id % 5 + 1] || ' ' || (conv_id % 50) AS subject,
    CASE WHEN conv_id % 13 <> 4 THEN day END AS date, day AS internal_date,
    [sender] AS senders,
    CASE k % 3 WHEN 0 THEN ['owner@example.com'] WHEN 1 THEN ['Team <team@corp.example>', 'owner@example.com'] ELSE ['other@example.org'] END AS "to",
    CASE WHEN k % 5 = 0 THEN ['CC <cc@Example.org>'] ELSE [] END AS cc,
    ({sql_list(HEADS)})[k % 3 + 1] || text || ({sql_list(TAILS)})[k + 1] AS body,
    upper(role[1]) || role[2:] || ' <' || sender || '>' AS h_from,
    CASE WHEN k % 5 = 1 THEN '<https://l.example/u>, <mailto: out@l.example>' END AS h_unsub,
    CASE WHEN k % 10 = 1 THEN 'List-Unsubscribe=One-Click' END AS h_post,
    k % 8 = 1 AS h_list, k % 8 = 5 AS h_bulk, k % 8 = 7 AS h_auto
  FROM (SELECT *, (conv_id * 31 + turn * 7) % 16 AS k, conv_id % 7 <> 3 AS ids,
      role || '.' || ((conv_id * 31 + turn * 7) % 16) || '@' || ({sql_list(DOMAINS)})[(conv_id * 31 + turn * 7) % 4 + 1] AS sender,
      strftime(TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60), '%Y-%m-%dT%H:%M:%S+00:00') AS day
    FROM conversations)
)"""
