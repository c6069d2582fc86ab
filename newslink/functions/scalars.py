"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: German and English stop words that carry no topic.
STOP_WORDS = "aber als am an auch auf aus bei bin bis da dann das dass dem den der des die doch du durch ein eine einem einen einer eines er es für haben hat ich ihr im in ist ja kein man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur a about after all also an and any are as at be been but by can do for from had has have he her his i if in into is it its more my no not of on or our she so some than that the their them then there they this to up was we were what when which who will with would you your".split()


def base_link(url: Column) -> Column:
    """The network location of a URL; empty for null and for what is no URL."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def url_path(url: Column) -> Column:
    """The path without query, fragment, parameters of the last part and slashes at its ends."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"^//[^/?#]*", ""), r"[?#][\s\S]*$", "")
    return F.coalesce(F.trim(F.regexp_replace(rest, r";[^/]*$", ""), F.lit("/")), F.lit(""))


def url_last_segment(url: Column) -> Column:
    return F.element_at(F.split(url_path(url), "/"), -1)


def version_parts(url: Column) -> Column:
    """Parts of a whole URL between slashes without `preview`."""
    return F.filter(F.split(F.trim(url, F.lit("/")), "/"), lambda p: p != "preview")


def version_key(url: Column) -> Column:
    """Equal for URLs that differ in trailing -<number> groups of the last part only."""
    parts = version_parts(url)
    last = F.regexp_replace(F.element_at(parts, -1), r"(-[0-9]+)+$", "")
    return F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"), F.lit("/"), last)


def clean_text(text: Column) -> Column:
    """Tags, then URLs, then entities become blanks; white space is collapsed; null becomes empty."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"https?://[^ \t\n\r]+", " "), r"&[A-Za-z]+;", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))


def normalise_text(text: Column) -> Column:
    """Lower case, letters only, without stop words."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]", " "), r"[0-9]+", " ")
    words = F.filter(F.split(x, " +"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_join(words, " ")


def cluster_hash(number: Column, date: Column) -> Column:
    return F.sha2(F.concat(number.cast("string"), date.cast("string")), 256)


def user_color(user: Column) -> Column:
    return F.concat(F.lit("#"), F.left(F.md5(user), F.lit(6)))


def slug(title: Column) -> Column:
    """A title as a key: URL-decoded, umlauts spelled out, other signs as hyphens, lower case; unusable titles get a hash.

    Only % with two hexadecimal digits is decoded; other % and + are signs of the title.
    """
    title = F.coalesce(title, F.lit(""))
    escaped = F.regexp_replace(F.regexp_replace(title, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    x = F.coalesce(F.try_url_decode(escaped), title)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.lower(F.trim(F.regexp_replace(x, r"[^a-zA-Z0-9_.-]", "-"), F.lit("-")))
    return F.when(x.rlike(r"^[0-9]*$"), F.concat(F.lit("container-"), F.left(F.md5(title), F.lit(8)))).otherwise(x)


def editor_type(user: Column) -> Column:
    v4, v6 = user.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), user.rlike(r"^[0-9a-fA-F:]+$") & user.contains(":")
    return F.when(v4, "ipv4").when(v6, "ipv6").otherwise("registered")


def ip_bits(ip: Column) -> Column:
    """The 32 or 128 bits of an IPv4 or IPv6 address as a string of 0 and 1; null for what is no address."""
    octets = F.split(ip, r"\.")
    v4 = F.array_join(F.transform(octets, lambda o: F.lpad(F.bin(o.cast("bigint")), 8, "0")), "")
    sides = F.transform(F.split(ip, "::"), lambda s: F.filter(F.split(s, ":"), lambda g: g != ""))
    left, right = sides[0], F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    groups = F.when(ip.contains("::"), F.concat(left, zeros, right)).otherwise(left)
    v6 = F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    is_v4 = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(octets, lambda o: o.cast("int") <= 255)
    is_v6 = ip.rlike(r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*$") & ~ip.rlike("[0-9a-fA-F]{5}") & (F.size(groups) == 8) & (F.size(F.split(ip, "::")) <= 2)
    return F.when(is_v4, v4).when(is_v6, v6)


def json_from_text(text: Column, schema: str) -> Column:
    """The JSON object within free text; null where there is none or it is malformed."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def without_comments(text: Column) -> Column:
    """Lines that begin with # are dropped."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.trim(line).startswith("#")), "\n")


def parse_array_literal(text: Column) -> Column:
    """Elements of `{a,"b, c"}`: quotes stripped, blanks dropped."""
    inner = F.regexp_replace(text, r"^\{|\}$", "")
    fields = F.regexp_extract_all(inner, F.lit(r'("[^"]*"|[^,"]+)'), F.lit(1))
    return F.filter(F.transform(fields, lambda x: F.trim(F.regexp_replace(x, '^ *"|" *$', ""))), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]*)"), F.lit(1)), lambda s: F.trim(s)), lambda s: s != "")


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))).cast("bigint")
