"""Content identity: canonical URLs, platform ids, dedupe keys, URL checks and accounts. Columns but for one Unicode fold."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that only track, hosts of one video platform, and its path forms that carry an id.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "igshid", "tt_from"]
VIDEO_HOSTS = ["youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com"]
VIDEO_PATHS = ["embed", "shorts", "v", "live"]
VIDEO_ID = "^[A-Za-z0-9_-]{11}$"
#: Fixed value: query keys that may carry a credential.
SECRET_KEY = r"(?i)token|secret|password|signature|credential|api.?key|authorization|^auth$|^sig$|^x-(?:amz|goog)-"
#: Blocks of IPv4 addresses that are not public (first address, bits of the prefix), after IANA's registry.
PRIVATE_BLOCKS = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
]
#: What a string claim says if the address is not verified.
UNVERIFIED = ["", "false", "0", "no", "null", "none", "undefined", "unverified"]


def _decoded(text: Column) -> Column:
    """Form-decoded; as it is if its percent signs are malformed."""
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pairs(query: Column) -> Column:
    """The query's fields as (k, v); one without a value has an empty one."""
    field = lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(F.regexp_replace(x, "^[^=]*=?", "")).alias("v"))
    return F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), field)


def _ipv4(text: Column | str) -> Column:
    """A dotted quad as a number."""
    parts = F.split(F.lit(text) if isinstance(text, str) else text, r"\.")
    return sum((F.try_element_at(parts, F.lit(i + 1)).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.try_element_at(parts, F.lit(1)).cast("long") * 256**3)


def _public_host(host: Column) -> Column:
    """A name with a dot of letters, digits and hyphens, or a public address in its usual form; no other form of a number."""
    quad = host.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
    number, private = _ipv4(host), F.lit(False)
    for first, bits in PRIVATE_BLOCKS:
        private = private | (F.shiftright(number, 32 - bits) == F.shiftright(_ipv4(first), 32 - bits))
    local = (host == "localhost") | host.rlike(r"\.(?:local|internal|localhost)$")
    name = F.contains(host, F.lit(".")) & host.rlike("^[a-z0-9.-]+$") & ~host.rlike("^[0-9a-fx.]+$") & ~local
    six = host.rlike(r"^\[[23][0-9a-f]{3}:[0-9a-f:]+\]$") & ~host.rlike(r"^\[2001:(?:0?db8:|[01]?[0-9a-f]{0,2}:)")
    return F.when(quad, ~private).otherwise(name | six)


def url_parts(url: Column | str) -> Column:
    """(canonical, platform_id, has_credentials, safe) of a link, whose scheme may be missing; nulls if it can't be read.

    The canonical form is https, without www, tracking keys, fragment, default port and trailing slash, its query in
    order; links to one video have one form. Safe links lead to a public web address on a usual port.
    """
    whole = F.trim(F.col(url) if isinstance(url, str) else url)
    whole = F.when(whole.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), whole).when(whole != "", F.concat(F.lit("https://"), whole))
    part = lambda n: F.regexp_extract(whole, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", n)
    login = F.regexp_extract(part(2), "^(.*)@", 1)
    place = F.regexp_replace(part(2), "^.*@", "")
    shape = r"^(\[[0-9A-Fa-f:.]*\]|[^:\[\]]*)(?::(\d{0,5}))?$"
    host, port = F.regexp_replace(F.lower(F.regexp_extract(place, shape, 1)), r"\.$", ""), F.regexp_extract(place, shape, 2)
    bare, pairs, path = F.regexp_replace(host, r"^www\.", ""), _pairs(part(4)), part(3)

    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    plain_path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    shown_port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    canonical = F.concat(F.lit("https://"), bare, shown_port, plain_path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))

    named = F.try_element_at(F.filter(pairs, lambda p: p["k"] == "v"), F.lit(-1))["v"]
    video = F.when(bare == "youtu.be", F.regexp_extract(path, "^/+([^/]*)", 1))
    video = video.when(bare.isin(VIDEO_HOSTS) & path.rlike("^/watch/*$"), named)
    video = video.when(bare.isin(VIDEO_HOSTS), F.regexp_extract(path, rf"^/+(?:{'|'.join(VIDEO_PATHS)})/+([^/]+)", 1))
    video = F.when(video.rlike(VIDEO_ID), video)

    readable = (whole != "") & place.rlike(shape)
    secret = (login != "") | F.exists(pairs, lambda p: p["k"].rlike(SECRET_KEY))
    safe = F.lower(part(1)).isin("http", "https") & (login == "") & port.isin("", "80", "443") & _public_host(host)
    return F.struct(
        F.when(readable, F.coalesce(F.concat(F.lit("https://youtube.com/watch?v="), video), canonical)).alias("canonical"),
        F.when(readable, F.concat(F.lit("youtube:"), video)).alias("platform_id"),
        F.coalesce(readable & secret, F.lit(False)).alias("has_credentials"),
        F.coalesce(readable & safe, F.lit(False)).alias("safe"),
    )


def email_verified(claim: Column) -> Column:
    """Whether a claim, as JSON text, proves an address: true, or any string that doesn't say no; anything else fails closed."""
    said = F.lower(F.trim(F.regexp_extract(claim, r'(?s)^\s*"(.*)"\s*$', 1)))
    return F.coalesce(F.when(F.trim(claim) == "true", True).when(claim.rlike(r'(?s)^\s*".*"\s*$'), ~said.isin(UNVERIFIED)), F.lit(False))


def resolve_logins(logins: DataFrame, accounts: DataFrame, deleted: DataFrame) -> DataFrame:
    """(login_id, outcome, account_id): whose account each login of a batch reaches.

    logins: login_id, subject, email, claim; accounts: account_id, email, subject (null for a legacy one), addresses once
    each; deleted: subjects of deleted accounts. A known subject decides alone. Else a legacy account of the address is
    bound if the claim proves it, an address that another subject holds is refused, and a new account is made. Of a
    batch's logins for an unbound or new address the first admitted one takes it, with later ones of its subject.
    """
    gone = deleted.select("subject", F.lit(True).alias("gone")).distinct()
    known = accounts.where("subject is not null").groupBy("subject").agg(F.min("account_id").alias("own"))
    holders = accounts.select("email", F.col("account_id").alias("holder"), F.col("subject").alias("held_by"))
    met = logins.join(gone, "subject", "left").join(known, "subject", "left").join(holders, "email", "left").withColumn("proven", email_verified(F.col("claim")))
    fixed = F.when(F.col("subject").isNull(), "no subject").when(F.col("gone"), "deleted").when(F.col("own").isNotNull(), "already bound")
    fixed = fixed.when(F.col("held_by").isNotNull(), "refused").when(F.col("holder").isNotNull() & ~F.col("proven"), "unproven")
    judged = met.withColumn("fixed", fixed)
    first = judged.where("fixed is null").groupBy("email").agg(F.min(F.struct("login_id", "subject")).alias("first"))
    taken = judged.join(first, "email", "left")
    winner = F.when(F.col("first.subject") != F.col("subject"), "refused").when(F.col("first.login_id") != F.col("login_id"), "already bound")
    outcome = F.coalesce("fixed", winner, F.when(F.col("holder").isNotNull(), "bound"), F.lit("created"))
    reached = F.when(outcome == "already bound", F.coalesce("own", "holder")).when(outcome == "bound", F.col("holder"))
    return taken.select("login_id", outcome.alias("outcome"), reached.alias("account_id"))


def normalize_text(text: str | None) -> str:
    """Without accents, case, punctuation and repeated space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).casefold()
    return " ".join(re.sub(r"[^\w\s]", " ", plain).split())


@F.pandas_udf(T.StringType())
def normalized_content(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text)


def content_hash(normalized: Column) -> Column:
    return F.when(normalized != "", F.concat(F.lit("sha256:"), F.sha2(normalized, 256)))


def dedupe_key(parts: Column, normalized: Column) -> Column:
    """The first of: platform id, canonical URL, hash of the normalized content."""
    return F.coalesce(parts["platform_id"], F.concat(F.lit("url:"), parts["canonical"]), content_hash(normalized))


def source_domain(url: Column) -> Column:
    return F.coalesce(F.replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("www."), F.lit("")), F.lit(""))


def source_type(domain: Column) -> Column:
    has = lambda s: F.contains(domain, F.lit(s))
    return F.when(has("youtube.com") | has("youtu.be"), "youtube").when(has("tiktok.com"), "tiktok").when(has("instagram.com"), "instagram").when(has("amazon."), "product").otherwise("article")


def video_source(url: Column) -> Column:
    """Whether a link is a video: the platform's name, ``video`` for others, null for none."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH"))
    under = lambda d: (host == d) | F.endswith(host, F.lit(f".{d}"))
    plain = host.isin("vimeo.com", "www.vimeo.com", "dailymotion.com", "www.dailymotion.com", "twitch.tv", "www.twitch.tv", "fb.watch")
    reel = under("facebook.com") & path.rlike(r"/(reel|reels|watch|videos|share/r)(/|$)")
    return F.when((host == "youtu.be") | under("youtube.com"), "youtube").when(under("instagram.com") | under("tiktok.com") | under("tt.site") | reel | plain | path.rlike(r"(?i)\.(mp4|webm|mov|m4v|mkv|m3u8)$"), "video")


def short_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def extract_urls(text: Column) -> Column:
    """Distinct http(s) links of a text in order, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\bhttps?://[^\s<>\"']+"), 0)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}'\"]+$", "")))
