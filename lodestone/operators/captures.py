"""Captured texts: what in them is prose, and whether there is any.

A site's interface is told by counting, not by a list of its words: a short line that stands on many captures of one site
is a button or a menu, whatever it says and in whichever language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An interface line has so few words, stands on so many captures of its site, and on more than this share of them.
FEW_WORDS, LEAST, SHARE = 4, 5, 0.02
#: Lines that a reader service puts before a page, and how it says that there was none.
READER_LINE = r"^(?:Title|URL Source|Published Time|Markdown Content):.*$"
READER_ERROR = r"(?i)target url returned error\s+(\d{3})"
#: Numbers with a unit each, and nothing else: what stands below a post.
COUNTS_LINE = r"^[\d.,]+\s?[KMB]?\s?\p{L}{0,12}(?:\s*[·|,]\s*[\d.,]+\s?[KMB]?\s?\p{L}{0,12})*$"
#: A page of fewer words that asks for a proof of humanity, or says that a video is gone, says nothing else.
SHORT_PAGE, WALL = 60, r"(?i)captcha|verify you are human|video (?:currently )?unavailable"


def plain_lines(text: Column) -> Column:
    """The lines of a text without markdown, images and reader lines; what is nothing else is an empty line."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"!\[[^\[\]\n]*\]\([^()\s]*\)", "")
    body = F.regexp_replace(body, r"\[([^\[\]\n]*)\]\([^()\s]*\)", "$1")
    bare = lambda x: F.regexp_replace(x, r"^[ *#\t\r]+|[ *\t\r]+$", "")
    return F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(bare(x), READER_LINE, ""))


def interface_lines(lines: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(site, known): the interface lines of each site in lower case, from ``lines`` (site, lines), a row a capture.

    A site's list is bounded: each of its lines stands on more than ``share`` of its captures, and a capture is finite.
    Counts combine on the map side, so a site with a third of all captures is no hot key. A null site is a site.
    """
    short = F.filter(F.array_distinct(F.transform("lines", F.lower)), lambda x: (x != "") & (F.regexp_count(x, F.lit(r"\S+")) <= FEW_WORDS))
    counts = lines.select("site", F.explode(short).alias("line")).groupBy("site", "line").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    captures = lines.groupBy(F.col("site").alias("of")).agg(F.count("*").alias("captures"))
    frequent = counts.join(captures, F.col("site").eqNullSafe(F.col("of"))).where(F.col("k") > share * F.col("captures"))
    return frequent.groupBy("site").agg(F.collect_list("line").alias("known"))


def prose(captures: DataFrame, key: str, site: str, text: str, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(key, prose) of captures: their lines without markup, interface and counts, one by one; a null text has none."""
    lines = captures.select(key, F.col(site).alias("site"), plain_lines(F.col(text)).alias("lines"))
    known = interface_lines(lines, least, share).withColumnRenamed("site", "of")
    met = lines.join(known, F.col("site").eqNullSafe(F.col("of")), "left")
    said = lambda x: (x != "") & ~F.coalesce(F.array_contains("known", F.lower(x)), F.lit(False)) & ~x.rlike(COUNTS_LINE)
    return met.select(key, F.array_join(F.filter("lines", said), "\n").alias("prose"))


def outcome(text: Column) -> Column:
    """usable, empty, or retry for what an upstream error kept from being read."""
    body = F.coalesce(text, F.lit(""))
    code = F.regexp_extract(body, READER_ERROR, 1)
    words = F.regexp_count(body, F.lit(r"\S+"))
    link = F.trim(body).rlike(r"(?i)^(?:link:\s*)?https?://\S+$")
    wall = (words < SHORT_PAGE) & body.rlike(WALL)
    return F.when(code >= "500", "retry").when((code != "") | (words == 0) | link | wall, "empty").otherwise("usable")


#: What a page behind a wall says, and the names of query keys that carry a secret.
WALL_WORDS = (
    r"(?:log\s?in|sign in) (?:to|with)|this (?:video|post|content|account) is private|content (?:isn.t|is not) available|subscribe to (?:read|continue)|"
    r"^(?:facebook|instagram|tiktok|youtube)\s*[-–:]?\s*(?:login|log in|sign in)|^private video"
)
SECRET_KEYS = r"token|secret|password|signature|credential|api.?key|authorization|^auth$|^sig$|^x-(?:amz|goog)-"
#: Characters that a public text has at least, and those of it that are looked at for a wall.
PUBLIC_CHARS, LOOKED_AT = 40, 2_000


def carries_secret(url: Column) -> Column:
    """Whether a URL has user info, or a query key that names a secret and has a value. A null URL carries none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: F.regexp_like(p, F.lit("^[^=]*=.")))
    return F.contains(rest, F.lit("@")) | F.exists(pairs, lambda p: F.substring_index(p, "=", 1).rlike(f"(?i){SECRET_KEYS}"))


def anonymous_usable(url: Column, provenance: Column, title: Column, text: Column, private: Column, login: Column) -> Column:
    """Whether what was fetched may be shared with others: proven, long enough, marked neither private nor behind a login, by a URL
    that carries no secret, and saying nothing of a wall in its title or its first 2,000 characters."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    walled = lambda t: t.rlike(f"(?i){WALL_WORDS}")
    marked = F.coalesce(private, F.lit(False)) | F.coalesce(login, F.lit(False))
    return ~carries_secret(url) & (F.coalesce(provenance, F.lit("none")) != "none") & (F.char_length(body) >= PUBLIC_CHARS) & ~marked & ~walled(F.coalesce(title, F.lit(""))) & ~walled(F.substring(body, 1, LOOKED_AT))


def evidence_level(transcript: Column, others: list[Column]) -> Column:
    """full_transcript for four words of it or more, partial if there is any other evidence, else metadata_only. Blank is none."""
    words = F.regexp_count(F.coalesce(transcript, F.lit("")), F.lit(r"\S+"))
    some = [F.coalesce(F.trim(x) != "", F.lit(False)) for x in others]
    anything = some[0]
    for more in some[1:]:
        anything = anything | more
    return F.when(words >= 4, "full_transcript").when(anything, "partial").otherwise("metadata_only")
