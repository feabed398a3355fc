"""Hints of single messages as Columns: mail kind, unsubscribe, lifecycle, billing, direction, attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, bind, contains_any, count_of, lines, strip_chars, tokens, trim_ws
from ..lexicon import Lexicon
from ..wordlists import MAIL_KINDS, NEWSLETTER_SENDERS

#: In the order that breaks ties.
KINDS = ("transactional", "newsletter", "notification", "promotion", "personal", "unknown")
WEIGHTS = {"promotion": 2, "newsletter": 2, "transactional": 2, "notification": 1, "personal": 1}
STRUCTURE = ("customer name:", "customer email:", "offer:", "plan:", "invoice number:", "order id:", "payment failed", "due date:")
LOGO = ("facebook", "icon", "linkedin", "logo", "signature", "twitter")


def header(headers: Column, name: str) -> Column:
    return F.element_at(headers, F.lit(name))


def mail_kind_signals(subject: Column, body: Column, headers: Column) -> Column:
    """struct of the counts and flags that mail_kind_scores() weighs; each is looked for once."""
    text = F.concat(F.lower(F.coalesce(subject, F.lit(""))), F.lit("\n"), F.lower(F.coalesce(body, F.lit(""))))
    low = lambda name: F.lower(header(headers, name))
    sender = F.coalesce(low("from"), F.lit(""))
    flags = {
        "bulk": contains_any(sender, NEWSLETTER_SENDERS.split("|")), "automatic": contains_any(sender, ("no-reply", "noreply", "newsletter", "updates@")), "unsubscribe": header(headers, "list-unsubscribe").isNotNull(),
        "list": header(headers, "list-id").isNotNull(), "precedence": low("precedence").rlike("bulk|list"), "generated": low("auto-submitted").contains("auto-generated"),
    }
    return bind(text, lambda t: F.struct(*(count_of(t, MAIL_KINDS[k].split("|")).alias(k) for k in WEIGHTS), t.contains("notification").alias("word"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items())))


def scores_of(signals: Column, lifecycle_high: Column | None = None) -> Column:
    """array of struct(score, rank, kind) of the kinds with any signal, the best first."""
    flag = lambda c, n: F.when(c, n).otherwise(0)
    s = signals
    score = {k: s[k] * w for k, w in WEIGHTS.items()}
    news = score["newsletter"] + flag(s["unsubscribe"], 3) + flag(s["list"], 3) + flag(s["precedence"], 2) + flag(s["bulk"], 2) + flag(s["bulk"] & s["automatic"], 1)
    score["newsletter"] = news + flag((news >= 3) & (score["promotion"] >= 3), 1)
    # the word notification counts twice
    score["notification"] = score["notification"] + flag(s["word"], 1) + flag(s["generated"], 2) + flag(s["automatic"] & ~s["bulk"], 1)
    if lifecycle_high is not None:
        score["transactional"] = score["transactional"] + flag(F.coalesce(lifecycle_high, F.lit(False)), 3)
    rows = F.array(*(F.struct((-score[k]).alias("minus"), F.lit(KINDS.index(k)).alias("rank"), F.lit(k).alias("kind")) for k in WEIGHTS))
    return F.array_sort(F.filter(rows, lambda r: r["minus"] < 0))


def mail_kind_scores(subject: Column, body: Column, headers: Column, lifecycle_high: Column | None = None) -> Column:
    return bind(mail_kind_signals(subject, body, headers), lambda s: scores_of(s, lifecycle_high))


def mail_kind(scores: Column) -> Column:
    """struct(kind, confidence, score, second) from mail_kind_scores(); second is null unless it comes close."""

    def of(scores: Column) -> Column:
        top, second = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
        s, s2 = -top["minus"], F.coalesce(-second["minus"], F.lit(0))
        confidence = F.when((s >= 5) & (s - s2 >= 2), "high").when(s >= 3, "medium").otherwise("low")
        return F.struct(F.coalesce(top["kind"], F.lit("unknown")).alias("kind"), confidence.alias("confidence"), F.coalesce(s, F.lit(0)).alias("score"), F.when((s - s2 <= 1) & (s2 >= 3), second["kind"]).alias("second"))

    return bind(scores, of)


def lifecycle_gate(kind: Column) -> Column:
    """allow, block or strong_only for the primary kind."""
    return F.when(kind.isin("transactional", "notification"), "allow").when(kind.isin("newsletter", "promotion"), "block").otherwise("strong_only")


def strong_structure(text: Column) -> Column:
    """Whether two of the marks of a billing message are there."""
    return count_of(ascii_lower(text), STRUCTURE) >= 2


def _trimmed_lines(body: Column) -> Column:
    return F.filter(F.transform(lines(F.coalesce(body, F.lit(""))), trim_ws), lambda x: x != "")


def lifecycle(subject: Column, body: Column, headers: Column, gate: Column, lexicon: Lexicon, first_from: Column | None = None) -> Column:
    """The lifecycle hint as a struct, null where the gate or the rules give none; of several lines for a field the last counts.

    The cheap gate comes first; rules and lines are looked at only where it is open.
    """
    text = F.concat(ascii_lower(F.coalesce(subject, F.lit(""))), F.lit("\n"), ascii_lower(F.coalesce(body, F.lit(""))))
    known = lexicon.matches("known_billing_senders", ascii_lower(F.coalesce(header(headers, "from"), F.lit(""))))
    sender = header(headers, "from")
    provider = F.when(sender.contains("@"), strip_chars(trim_ws(F.get(F.split(sender, "@"), F.lit(1))), ">"))
    provider = F.coalesce(provider, first_from if first_from is not None else F.lit(None).cast("string"))

    def hint(found: Column, strong: Column) -> Column:
        """found: struct(rule, lines); the lines as struct(line, low)."""
        rule = found["rule"]
        kind = lexicon.lifecycle_values(rule, lambda r: r.kind)
        last = lambda test: F.try_element_at(F.filter(found["lines"], test), F.lit(-1))["line"]
        name = lambda x: x["low"].startswith("customer name:")
        email = lambda x: x["low"].startswith("customer email:")
        plan = lambda x: x["low"].rlike("^(?:offer|plan):")
        date = lambda x: x["low"].rlike("^(?:effective |renewal )?date:")
        money = lambda x: x["low"].rlike(r"\$| usd| eur| gbp") & ~(name(x) | email(x) | plan(x) | date(x))
        value = lambda test: trim_ws(F.regexp_replace(last(test), "(?s)^[^:]*:", ""))
        currency = lambda a: F.when(ascii_lower(a).rlike(r"\$| usd"), "USD").when(ascii_lower(a).contains(" eur"), "EUR").when(ascii_lower(a).contains(" gbp"), "GBP")
        confidence = F.when(strong, "high").when(kind.isin("subscription_canceled", "subscription_renewed"), "medium").otherwise("low")
        fields = lambda a: F.struct(kind.alias("kind"), confidence.alias("confidence"), provider.alias("provider"), value(plan).alias("plan_name"), value(name).alias("customer_name"), value(email).alias("customer_email"), a.alias("amount_raw"), currency(a).alias("currency"), value(date).alias("effective_date_raw"), lexicon.lifecycle_values(rule, lambda r: r.signal).alias("signal"))
        return F.when(kind.isNotNull() & (kind != "unknown"), bind(last(money), fields))

    def of(t: Column, strong: Column) -> Column:
        open_ = (gate == "allow") | (strong & lexicon.matches("lifecycle_keyword", t)) | ((gate == "strong_only") & (known | lexicon.matches("confirmation_gate", t)))
        found = bind(lexicon.lifecycle_rule(t), lambda rule: F.struct(rule.alias("rule"), F.when(rule.isNotNull(), F.transform(_trimmed_lines(body), lambda x: F.struct(x.alias("line"), ascii_lower(x).alias("low")))).alias("lines")))
        return F.when(open_, bind(found, lambda f: hint(f, strong)))

    return bind(text, lambda t: bind(count_of(t, STRUCTURE) >= 2, lambda strong: of(t, strong)))


def _line_urls(line: Column) -> Column:
    return F.filter(F.transform(tokens(line), lambda t: strip_chars(t, r"<>()\[\]\"',")), lambda t: t.startswith("http://") | t.startswith("https://"))


def billing_actions(body: Column, lexicon: Lexicon, lifecycle_kind: Column | None = None) -> Column:
    """array of struct(kind, url, label, source, confidence, related_lifecycle_kind), first occurrences."""
    related = F.lit(None).cast("string") if lifecycle_kind is None else lifecycle_kind

    def of(line: Column) -> Column:
        kind, urls = lexicon.classify_billing(ascii_lower(line)), _line_urls(line)
        row = lambda url, source, how: F.struct(kind.alias("kind"), url.alias("url"), line.alias("label"), F.lit(source).alias("source"), F.lit(how).alias("confidence"), related.alias("related_lifecycle_kind"))
        none = F.array(row(F.lit(None).cast("string"), "body_text", "low"))
        found = F.when(F.size(urls) > 0, F.transform(urls, lambda u: row(u, "body_link", "medium"))).otherwise(none)
        return F.filter(found, lambda r: r["kind"].isNotNull())

    every = F.flatten(F.transform(_trimmed_lines(body), of))
    key = lambda r: F.concat_ws("|", r["kind"], r["source"], F.coalesce(r["url"], ascii_lower(r["label"])))
    return _first_by(every, key)


def _first_by(items: Column, key) -> Column:
    """Without items whose key occurs before."""
    keys = F.transform(items, key)
    return F.filter(items, lambda r, i: F.array_position(keys, key(r)) == i + 1)


def unsubscribe(headers: Column, body: Column) -> Column:
    """array of struct(kind, source, url, email, label, confidence): headers, then the body's lines."""
    none = F.lit(None).cast("string")
    row = lambda kind, source, url, email, label, how: F.struct(kind.alias("kind"), F.lit(source).alias("source"), url.alias("url"), email.alias("email"), label.alias("label"), F.lit(how).alias("confidence"))
    parts = F.filter(F.transform(F.split(F.coalesce(header(headers, "list-unsubscribe"), F.lit("")), ","), lambda p: strip_chars(trim_ws(p), "<>")), lambda p: p != "")
    urls = F.transform(F.filter(parts, lambda p: p.rlike("^https?://")), lambda u: row(F.lit("url"), "header_list_unsubscribe", u, none, F.lit("list_unsubscribe"), "high"))
    mails = F.transform(F.filter(parts, lambda p: p.startswith("mailto:")), lambda m: row(F.lit("mail_to"), "header_list_unsubscribe", none, trim_ws(F.regexp_replace(m, "^mailto:", "")), F.lit("list_unsubscribe"), "high"))
    post = header(headers, "list-unsubscribe-post")
    click = F.when(ascii_lower(post).contains("one-click"), F.lit("one_click")).otherwise(F.lit("unknown"))
    posts = F.filter(F.array(row(click, "header_list_unsubscribe_post", none, none, post, "high")), lambda r: r["label"].isNotNull())

    def of(line: Column) -> Column:
        low, found = ascii_lower(line), _line_urls(line)
        kind = F.when(low.contains("manage preferences"), F.lit("manage_preferences")).otherwise(F.lit("url"))
        return F.when(F.size(found) > 0, F.transform(found, lambda u: row(kind, "body_link", u, none, F.lit("unsubscribe_link"), "medium"))).otherwise(F.array(row(F.lit("unknown"), "body_text", none, none, line, "low")))

    cues = F.filter(_trimmed_lines(body), lambda x: ascii_lower(x).rlike("unsubscribe|manage preferences"))
    every = F.concat(urls, mails, posts, F.flatten(F.transform(cues, of)))
    return _first_by(every, lambda r: F.concat_ws("|", r["source"], r["kind"], F.coalesce(r["url"], F.lit("")), F.coalesce(r["email"], F.lit(""))))


def direction(senders: Column, recipients: Column, owners: list[str]) -> Column:
    """struct(direction, confidence, matched_owner, reason) for arrays of addresses; null without owners.

    matched_owner is the smallest owner.
    """
    mine = sorted({x for o in owners if (x := o.strip().lower())})
    if not mine:
        return F.lit(None).cast("struct<direction:string,confidence:string,matched_owner:string,reason:string>")
    own = lambda a: ascii_lower(a).isin(*mine)
    from_own, from_other = F.exists(senders, own), F.exists(senders, lambda a: ~own(a))
    to_own, to_other = F.exists(recipients, own), F.exists(recipients, lambda a: ~own(a))
    pick = lambda a, b, c, d: F.when(from_own & to_other & ~from_other, a).when(~from_own & to_own, b).when(from_own & to_own, c).otherwise(d)
    return F.struct(pick("outbound", "inbound", "self", "unknown").alias("direction"), pick("high", "high", "medium", "low").alias("confidence"), F.lit(mine[0]).alias("matched_owner"), pick("from_owner", "to_owner", "both", "no_match").alias("reason"))


def attachment_hint(a: Column) -> Column:
    """struct(is_inline, is_probable_logo, is_tracking_pixel_like, size_bucket) of an attachment struct."""
    name, size = ascii_lower(F.coalesce(a["filename"], F.lit(""))), a["size"]
    inline = a["content_id"].isNotNull() | F.coalesce(ascii_lower(a["content_disposition"]) == "inline", F.lit(False))
    image = ascii_lower(a["mime_type"]).startswith("image/")
    bucket = F.when(size < 4000, "tiny").when(size < 64000, "small").when(size < 1000000, "medium").otherwise("large")
    return F.struct(inline.alias("is_inline"), (inline & image & (size <= 40000) & contains_any(name, LOGO)).alias("is_probable_logo"), (image & (size <= 2000)).alias("is_tracking_pixel_like"), bucket.alias("size_bucket"))


def event_terms(text: Column, lexicon: Lexicon) -> Column:
    """struct of flags for the event families, and the reservation type."""
    families = [f for f in lexicon.patterns if f.startswith("event_")]
    flags = bind(text, lambda t: F.struct(*(lexicon.matches(f, t).alias(f) for f in families)))
    return bind(flags, lambda e: F.struct(*(e[f].alias(f.removeprefix("event_")) for f in families), lexicon.reservation_of(lambda f: e[f]).alias("reservation_type")))
