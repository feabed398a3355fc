"""Address, domain, URL and contact-token expressions, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, ascii_lower, bind, blank_to_null, strip_chars, tokens, trim_ws

PERSONAL = ("aol.com", "gmail.com", "gmx.com", "googlemail.com", "hotmail.com", "icloud.com", "live.com", "mac.com", "mail.com", "me.com", "msn.com", "outlook.com", "proton.me", "protonmail.com", "rocketmail.com", "yahoo.com", "yandex.com", "yandex.ru", "ymail.com", "zoho.com")
#: (profile type, host endings); an ending needs no dot before it.
PROFILES = (("twitter_x", ("x.com", "twitter.com")), ("instagram", ("instagram.com",)), ("tiktok", ("tiktok.com",)), ("youtube", ("youtube.com", "youtu.be")), ("facebook", ("facebook.com",)), ("github", ("github.com",)))


def normalize_email(c: Column) -> Column:
    """The address inside brackets if there are any, lower case; null where it is no address."""
    s = trim_ws(c)
    inner = F.when(s.rlike("(?s)<.*>"), F.regexp_extract(s, "(?s)^[^<]*<(.*)>[^>]*$", 1)).otherwise(s)
    e = F.lower(trim_ws(strip_chars(trim_ws(inner), "<>,.;")))
    return F.when(F.octet_length(e).between(6, 254) & e.rlike(r"(?s)^[^@]+@.*\..*$") & ~e.endswith("@"), e)


def address(email: Column, name: Column) -> Column:
    """struct(address, name) with a blank name as null; null where the address isn't valid."""
    a = normalize_email(email)
    return F.when(a.isNotNull(), F.struct(a.alias("address"), blank_to_null(trim_ws(name)).alias("name")))


def parse_address(c: Column) -> Column:
    """'name <address>' or an address alone as struct(address, name)."""
    named = c.rlike("(?s)<.*>")
    name = F.when(named, strip_chars(trim_ws(F.substring_index(c, "<", 1)), "\"'"))
    return address(c, name)


def entity_id(email: Column) -> Column:
    return F.concat(F.lit("email:"), F.sha2(normalize_email(email), 256))


def format_address(a: Column) -> Column:
    """'name <address>', or the address where there is no name."""
    name = trim_ws(a["name"])
    return F.when(F.coalesce(name, F.lit("")) == "", a["address"]).otherwise(F.concat(name, F.lit(" <"), a["address"], F.lit(">")))


def address_email(c: Column) -> Column:
    """What stands between the first < and the next >, or all, lower case."""
    return ascii_lower(trim_ws(F.when(c.rlike("<[^>]*>"), F.regexp_extract(c, "<([^>]*)>", 1)).otherwise(c)))


def email_domain(c: Column) -> Column:
    """What follows the first @."""
    return F.when(c.contains("@"), ascii_lower(trim_ws(F.regexp_replace(c, "(?s)^[^@]*@", ""))))


def root_domain(c: Column) -> Column:
    """The last two labels."""
    labels = F.filter(F.split(c, r"\."), lambda x: x != "")
    return F.array_join(F.when(F.size(labels) > 2, F.slice(labels, -2, 2)).otherwise(labels), ".")


def domain_bucket(c: Column) -> Column:
    return F.when(c.isin(*PERSONAL), F.lit("personal")).otherwise(F.lit("company"))


def link_key(name: Column, domain: Column) -> Column:
    """'name|domain' of whichever there are (A10)."""
    n = F.coalesce(ascii_lower(trim_ws(F.regexp_replace(name, f"{WS}+", " "))), F.lit(""))
    d = F.coalesce(domain, F.lit(""))
    return F.when((n != "") | (d != ""), F.concat(n, F.lit("|"), d))


def url_host(c: Column) -> Column:
    """Host with its port, without scheme and www., lower case."""
    rest = F.regexp_replace(trim_ws(c), "^(?i:https?://)?(?i:www[.])*", "")
    return ascii_lower(strip_chars(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), "."))


def url_path(c: Column) -> Column:
    rest = F.regexp_replace(trim_ws(c), "^(?i:https?://)?(?i:www[.])*", "")
    return F.regexp_replace(rest, "(?s)^[^/?#]*", "")


def first_segment(path: Column) -> Column:
    """The first path segment that isn't empty, lower case."""
    plain = F.regexp_extract(path, "(?s)^[^?#]*", 0)
    return ascii_lower(F.get(F.filter(F.transform(F.split(plain, "/"), trim_ws), lambda x: x != ""), F.lit(0)))


def profile(url: Column) -> Column:
    """struct(type, handle, host) of a profile URL."""
    path = url_path(url)
    return bind(F.struct(url_host(url).alias("host"), first_segment(path).alias("seg"), ascii_lower(F.regexp_replace(path, "^/+", "")).alias("p")), _profile)


def _profile(parts: Column) -> Column:
    """profile() of struct(host, seg, p): the host, the first path segment, the path without slashes before it."""
    host, seg, p = parts["host"], parts["seg"], parts["p"]
    handle = lambda kind: blank_to_null(trim_ws(F.regexp_extract(p, f"^(?:{kind}/)+([^/]*)", 1)))
    linked, company, person = host.endswith("linkedin.com"), p.startswith("company/"), p.startswith("in/")
    kind = F.when(linked, F.when(company, F.lit("linkedin_company")).when(person, F.lit("linkedin_person")).otherwise(F.lit("other")))
    known = linked
    for name, ends in PROFILES:
        hit = F.lit(False)
        for e in ends:
            hit = hit | host.endswith(e)
        kind, known = kind.when(hit, F.lit(name)), known | hit
    handle_ = F.when(linked & company, handle("company")).when(linked & person, handle("in")).when(known, seg)
    return F.struct(kind.otherwise(F.lit("website")).alias("type"), handle_.alias("handle"), host.alias("host"))


def email_tokens(c: Column) -> Column:
    """Words that look like addresses, first occurrences in order."""
    return email_tokens_of(tokens(c))


def email_tokens_of(words: Column) -> Column:
    """email_tokens() of words."""
    like = lambda t: t.contains("@") & t.contains(".")
    bare = F.transform(F.filter(words, like), lambda t: strip_chars(F.regexp_replace(ascii_lower(strip_chars(t, r"<>()\[\]{},;:\"'")), "^(?:mailto:)+", ""), "."))
    return F.array_distinct(F.filter(bare, like))


def phone_tokens(c: Column) -> Column:
    """The digits of words that have 8 to 15 of them, first occurrences in order."""
    return phone_tokens_of(tokens(c))


def phone_tokens_of(words: Column) -> Column:
    """phone_tokens() of words."""
    digits = F.transform(F.filter(words, lambda t: (F.length(t) >= 8) & t.rlike("[0-9]")), lambda t: F.regexp_replace(t, "[^0-9]", ""))
    return F.array_distinct(F.filter(digits, lambda d: F.length(d).between(8, 15)))


def url_tokens(c: Column) -> Column:
    """Words that are URLs or hosts, also inside brackets and markdown links, with a scheme."""
    return url_tokens_of(tokens(c))


def url_tokens_of(words: Column) -> Column:
    """url_tokens() of words.

    Only words with a dot between other characters are looked at, as every host has one.  A step
    uses the one before once, or binds it.
    """
    edge = r"<>()\[\]{},;.!?\"'"

    def candidates(t: Column) -> Column:
        low = ascii_lower(t)
        some = lambda cond, x: F.when(cond, x)
        return F.array(
            t,
            some(t.rlike(r"\]\([^)]*\)"), F.regexp_extract(t, r"\]\(([^)]*)\)", 1)),
            some(low.contains("<http"), F.regexp_extract(t, "(?s)^.*?<(?i)(http.*)$", 1)),
            some(low.contains("<www."), F.regexp_extract(t, r"(?s)^.*?<(?i)(www\..*)$", 1)),
            some(t.contains("]"), F.regexp_replace(t, r"(?s)^[^\]]*\]", "")),
        )

    def with_scheme(t: Column) -> Column:
        low = ascii_lower(t)
        host_like = t.rlike(r"(?s)^[^.]+\.") & ~(t.contains("@") & ~t.contains("/"))
        url = F.when(low.startswith("mailto:") | (t == ""), None).when(low.rlike("^https?://"), t).when(low.startswith("www.") | host_like, F.concat(F.lit("https://"), t))
        return F.regexp_replace(url, r"[.,;!?)\]]+$", "")

    def canonical(raw: Column) -> Column:
        # after a bracket, after an angle bracket, before its end, after the text of a link
        t = F.regexp_replace(strip_chars(raw, edge), r"(?s)^[^\]]*\](?=(?i:https?://|www\.|[^.@]+\.))", "")
        t = strip_chars(F.regexp_replace(t, r"(?s)^.*?<(?=(?i:http|www\.))", ""), edge)
        t = F.regexp_replace(F.regexp_replace(t, "(?s)^([^>]+)>.*$", "$1"), r"(?s)^.*?\]\((?=.)", "")
        return bind(bind(strip_chars(t, edge), with_scheme), lambda url: F.when(url_host(url).rlike(r"\A[^\[\]<> ]*[.][^\[\]<> ]*\z"), url))

    dotted = F.filter(words, lambda t: t.rlike(r"[^.][.]+[^.]"))
    raw = F.filter(F.flatten(F.transform(dotted, candidates)), lambda x: x.isNotNull())
    return F.array_distinct(F.filter(F.transform(raw, canonical), lambda u: u.isNotNull()))


def name_tokens(c: Column) -> Column:
    """ASCII letters and digits of the words of three and more of them, lower case."""
    return F.filter(F.split(ascii_lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)
