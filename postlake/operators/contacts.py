"""Contacts of a message: names in salutations, what a signature holds, and hints that link URLs to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions.text import WS, ascii_lower, bind, blank_to_null, tokens, trim_ws

GREETINGS = "hi|hello|dear|bonjour|salut|hola|buenos|hallo|hej|ciao|dzień dobry|witam"
#: What follows a name without a comma, in the order in which it is looked for.
TAILS = " thank | thanks | merci | gracias | danke | grazie | dank | dziękuj| please | veuillez | por favor | bitte | per favore | alstublieft | proszę | transaction id| order id| confirmation id| discount | sale | offer | deal | black friday | cyber monday ".split("|")
ORGANISATION = "technologies|company|gmbh|corp|sarl|inc|llc|ltd|sas|ag|sa"
TITLE = "responsable|technician|consultant|engineer|director|manager|support|expert|sales"
PLACE = "boulevard|avenue|germany|street|canada|france|blvd|city|road|usa"
HINT = "struct<name:string,email:string,phone:string,url:string,profile_type:string,handle:string,source:string,role:string,confidence:string,company_domain:string,link_key:string,linked_entity_key:string,link_reason:string>"
FIELDS = [f.split(":")[0] for f in HINT[7:-1].split(",")]


def salutation_name(line: Column) -> Column:
    """The name in a salutation line, null for none."""
    prefix = f"^(?i:{GREETINGS})(?=$|[ ,:;.!-]|[A-Z])"
    line = trim_ws(line)
    rest = F.when(line.rlike(prefix), F.regexp_replace(F.regexp_replace(line, prefix, ""), r"^[\s,:;.-]+", "")).otherwise(line)

    def cut(c: Column) -> Column:
        def of(padded: Column) -> Column:
            upto = lambda mark: F.substr(c, F.lit(1), F.greatest(F.instr(padded, mark) - 2, F.lit(0)))
            out = F.when(c.contains(","), F.substring_index(c, ",", 1)).when(c.contains(";"), F.substring_index(c, ";", 1)).when(padded.contains(" from "), upto(" from "))
            for mark in TAILS:
                out = out.when(padded.contains(mark), upto(mark))
            return out.otherwise(c)

        return bind(F.concat(F.lit(" "), ascii_lower(c), F.lit(" ")), of)

    name = trim_ws(F.regexp_replace(F.regexp_replace(trim_ws(bind(rest, cut)), r"[\s,.;:!?]+$", ""), f"{WS}+", " "))
    exact = ascii_lower(line).isin(*GREETINGS.split("|"))
    return bind(name, lambda x: F.when(~exact & x.rlike(r"[\p{L}\p{N}]"), x))


def signature_entities(signature: Column) -> Column:
    """struct(emails, phones, urls, organization_lines, title_lines, address_lines, is_partial); marks count inside words."""

    def of(x: Column) -> Column:
        """x: struct(s, words, rows); the rows as struct(line, low)."""
        words = x["words"]
        some = lambda test: F.array_distinct(F.transform(F.filter(x["rows"], test), lambda r: r["line"]))
        has = lambda marks: lambda r: r["low"].rlike(marks)
        placed = lambda r: r["low"].rlike(PLACE) | (F.regexp_count(r["line"], F.lit("[0-9]")) >= 4)
        found = F.struct(A.email_tokens_of(words).alias("emails"), A.phone_tokens_of(words).alias("phones"), A.url_tokens_of(words).alias("urls"), some(has(ORGANISATION)).alias("organization_lines"), some(has(TITLE)).alias("title_lines"), some(placed).alias("address_lines"))
        return bind(found, lambda e: F.struct(*(e[k].alias(k) for k in ("emails", "phones", "urls", "organization_lines", "title_lines", "address_lines")), ((F.size(e["emails"]) == 0) & (F.size(e["phones"]) == 0) & (x["s"] != "")).alias("is_partial")))

    def split(s: Column) -> Column:
        rows = F.filter(F.transform(F.split(s, r"\r?\n"), trim_ws), lambda x: x != "")
        return F.struct(s.alias("s"), tokens(s).alias("words"), F.transform(rows, lambda x: F.struct(x.alias("line"), ascii_lower(x).alias("low"))).alias("rows"))

    return bind(bind(F.coalesce(trim_ws(signature), F.lit("")), split), of)


def _hint(**given: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(*(given.get(f, none).cast("string").alias(f) for f in FIELDS))


def contact_hints(headers: dict[str, Column], salutation: Column, entities: Column) -> Column:
    """Array of HINT: header addresses, the salutation's name, the signature's addresses, numbers and URLs.

    headers: arrays of struct(address, name) for from, to, cc, bcc, reply_to.  A URL is linked
    to the person that it fits best: 3 for the domain, 2 for a name in the handle, 2 for the
    organisation of a company page, 1 for the sender; from 3 on it is linked.  Of equals the
    first sender counts, or else the last.
    """
    mail = lambda a: ascii_lower(trim_ws(a["address"]))
    known = lambda xs: F.coalesce(xs, F.array().cast("array<struct<address:string,name:string>>"))
    of_header = lambda role: lambda a: _hint(name=a["name"], email=mail(a), source=F.lit(f"{role}_header"), role=F.lit(role), confidence=F.lit("high"), company_domain=A.email_domain(mail(a)), link_key=A.link_key(a["name"], A.email_domain(mail(a))))
    lists = [F.transform(F.filter(known(xs), lambda a: mail(a) != ""), of_header(role)) for role, xs in headers.items()]
    name = salutation_name(salutation)
    mentioned = lambda source, how, **more: _hint(source=F.lit(source), role=F.lit("mentioned"), confidence=F.lit(how), **more)
    greeted = F.filter(F.array(mentioned("salutation", "low", name=name, link_key=A.link_key(name, F.lit("")))), lambda h: h["name"].isNotNull())
    mails = F.transform(entities["emails"], lambda e: mentioned("signature", "medium", email=e, company_domain=A.email_domain(e), link_key=A.link_key(F.lit(""), A.email_domain(e))))
    phones = F.transform(entities["phones"], lambda p: mentioned("signature", "low", phone=p))
    organisation = F.array_distinct(F.flatten(F.transform(entities["organization_lines"], A.name_tokens)))
    either = lambda h: lambda t: h.contains(t) | t.contains(h)

    def best(anchors: Column, p: Column) -> Column:
        """struct(score, link_key, reason) of the anchor that a profile fits best; p: struct(type, handle, host, plain)."""
        root = F.when(p["host"] != "", A.root_domain(p["host"]))

        def one(a: Column, i: Column) -> Column:
            domain = F.coalesce(A.root_domain(a["domain"]) == root, F.lit(False))
            named = F.coalesce(F.exists(a["tokens"], either(p["plain"])), F.lit(False))
            page = (p["type"] == "linkedin_company") & F.coalesce(F.exists(organisation, either(p["plain"])), F.lit(False))
            sender = a["sender"]
            score = F.when(domain, 3).otherwise(0) + F.when(named, 2).otherwise(0) + F.when(page, 2).otherwise(0) + sender.cast("int")
            reason = F.when(page, "org_slug_match").when(named, "name_handle_match").when(domain, "domain_match").otherwise("weak")
            return F.struct((-score).alias("minus"), (~sender).alias("other"), F.when(sender, i).otherwise(-i).alias("place"), a["link_key"].alias("link_key"), reason.alias("reason"))

        return F.array_min(F.transform(anchors, one))

    def with_urls(hints: Column) -> Column:
        linkable = F.filter(hints, lambda h: h["link_key"].isNotNull())
        anchors = F.transform(linkable, lambda h: F.struct(h["link_key"].alias("link_key"), A.email_domain(h["email"]).alias("domain"), F.coalesce(A.name_tokens(h["name"]), F.array().cast("array<string>")).alias("tokens"), (h["source"] == "from_header").alias("sender")))

        def of(anchors: Column) -> Column:
            def link(u: Column) -> Column:
                profile = bind(A.profile(u), lambda p: F.struct(p["type"].alias("type"), p["handle"].alias("handle"), p["host"].alias("host"), blank_to_null(F.regexp_replace(ascii_lower(p["handle"]), "[^a-z0-9]", "")).alias("plain")))
                both = bind(profile, lambda p: F.struct(p.alias("p"), best(anchors, p).alias("b")))

                def hint(x: Column) -> Column:
                    p, b = x["p"], x["b"]
                    linked = F.coalesce(b["minus"] <= -3, F.lit(False))
                    confidence = F.when(linked, F.when(b["minus"] <= -5, "high").otherwise("medium")).when(p["type"] == "website", "low").otherwise("medium")
                    return mentioned_url(u, p, confidence, F.when(linked, b["link_key"]), F.when(linked, b["reason"]))

                return bind(both, hint)

            return F.concat(hints, F.transform(distinct_urls(entities["urls"]), link))

        return bind(anchors, of)

    def mentioned_url(u: Column, p: Column, confidence: Column, key: Column, reason: Column) -> Column:
        return _hint(url=u, profile_type=p["type"], handle=p["handle"], source=F.lit("signature"), role=F.lit("mentioned"), confidence=confidence, company_domain=blank_to_null(p["host"]), link_key=key, linked_entity_key=key, link_reason=reason)

    return bind(F.concat(*lists, greeted, mails, phones), with_urls)


def distinct_urls(urls: Column) -> Column:
    """The first of each URL, whatever its case."""
    low = lambda u: ascii_lower(trim_ws(u))
    return bind(F.transform(urls, low), lambda all_: F.filter(urls, lambda u, i: F.array_position(all_, low(u)) == i + 1))
