"""Text functions: query terms, profiles, intents, tags, cleaning, chunks."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words without retrieval signal.
STOPWORDS = (
    "a an the this that these those my our your their its is are was were be been am i me we you they he she it to of in on at for with about "
    "from by as and or but if then than so such into over under again very just do does did doing have has had having save saved saving want "
    "wanted need needed look looking"
).split()
#: What marks each content profile, in the order they are tried.
PROFILE_MARKERS = {
    "recipe": ["recipe", "ingredients", "preheat", "bake", "whisk", "tablespoon", "teaspoon", "simmer", "bake time", "serves", "cook time"],
    "product": ["in stock", "price", "buy", "cart", "shipping", "specifications", "battery life", "warranty", "add to", "our verdict", "review of"],
    "tutorial": ["tutorial", "how to", "step 1", "prerequisite", "you will", "in this guide", "getting started", "install", "run the"],
    "list": ["top 5", "top 10", "5 skills", "claude skills", "list of", "here are", "checklist", "the following", "compilation", "things worth", "tools worth", "worth saving"],
}
#: Phrases that say why something was saved.
INTENT_PHRASES = {
    "project": ["for my project", "my project", "work project", "for work", "for the team", "side project"],
    "try_later": ["try later", "try this later", "want to try", "wanna try", "try this", "later maybe"],
    "consider_buying": ["thinking about buying", "consider buying", "might buy", "want to buy", "buy this"],
    "research": ["research this", "research later", "read again", "look at this later", "study this"],
}
#: Words that make a guess at the category without a model.
CATEGORY_WORDS = {"recipe": ["recipe", "ingredient", "cook", "preheat", "chicken", "mushroom", "risotto"], "product": ["buy", "price", "review", "$"], "tutorial": ["tutorial", "how to", "fix", "aws", "tool", "setup"]}
#: Tags that say nothing, and words that no tag starts with besides the stop words.
BANNED_TAGS = ["interesting", "useful", "video content", "saved", "pending", "memory"]
TAG_NOISE = "every should most people only scratch surface what can five help automatically right before across know unlock reactions comments original audio see more how".split()
#: Suffixes that the light stemmer takes off.
SUFFIXES = ["ings", "ing", "ies", "ied", "ed", "es", "s"]

CHUNK_WORDS, CHUNK_STEP = 800, 640


def any_of(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def _family(hay: Column, families: dict[str, list[str]], first: Column | None = None) -> Column:
    """The first family with a phrase in a lower-case text."""
    kind = first
    for name, phrases in families.items():
        kind = F.when(any_of(hay, phrases), name) if kind is None else kind.when(any_of(hay, phrases), name)
    return kind


def whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def query_terms(text: Column) -> Column:
    """A query's words that carry signal, lower-cased, in order of first occurrence."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)[\w&&[^_]][\w\-_.+]*"), 0)
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[-._]+|[-._]+$", ""))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(plain, lambda w: (w != "") & ~F.array_contains(stop, w)))


def match_terms(terms: Column) -> Column:
    """The terms as an OR match takes them: word characters only."""
    return F.array_distinct(F.filter(F.transform(terms, lambda t: F.regexp_replace(t, r"(?U)[\W_]+", "")), lambda t: t != ""))


def matched(terms: Column, text: Column) -> Column:
    """The terms that occur in a text at the start of a word."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(terms, lambda t: F.regexp_like(hay, F.concat(F.lit(r"(?U)(?<!\w)\Q"), t, F.lit(r"\E"))))


def evidence_reason(terms: Column, document: Column, chunk: Column, stamp: Column, note: Column, intent: Column) -> Column:
    """What matched, in the user's words: the document, else the chunk, the note, the intent, else only the meaning."""
    said = lambda text, where: F.when(F.size(matched(terms, text)) > 0, F.concat(F.array_join(matched(terms, text), " + "), where))
    place = F.when(stamp.isNotNull(), F.concat(F.lit(" (at "), stamp, F.lit(")"))).otherwise(F.lit(" (in the content)"))
    return F.coalesce(said(document, F.lit("")), said(chunk, place), said(note, F.lit(" (your note)")), said(intent, F.lit(" (your intent)")), F.lit("similar meaning"))


#: Characters of a text that show its profile.
PROFILE_CHARS = 4_000


def classified(rows: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, profile, category, intent); each text is lower-cased once, for all of them."""
    body, head = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(title), F.lit(""))
    own = rows.select(key, head.alias("__title"), body.alias("__text"), F.lower(body).alias("__low"), F.lower(F.concat(head, F.lit("\n"), F.substring(body, 1, PROFILE_CHARS))).alias("__head"))
    return own.select(key, _profile(F.col("__title"), F.col("__text"), F.col("__head")).alias("profile"), _category(F.lower("__title"), F.col("__low")).alias("category"), _family(F.col("__low"), INTENT_PHRASES).alias("intent"))


def _profile(title: Column, text: Column, head: Column) -> Column:
    kind = _family(head, PROFILE_MARKERS, F.when(title.rlike(r"^\s*\d{1,3}\s+\S"), "list"))
    return kind.when(F.regexp_count(text, F.lit(r"(?:^|\s)\d+[.)]\s+")) >= 2, "list").otherwise("general")


def _category(hint: Column, text: Column) -> Column:
    kind = None
    for name, words in CATEGORY_WORDS.items():
        found = any_of(text, words) | any_of(hint, words)
        spaced = [w for w in words if " " in w]
        found = found | any_of(F.concat(hint, F.lit(" "), F.substring(text, 1, max(map(len, spaced)))), spaced) if spaced else found
        kind = F.when(found, name) if kind is None else kind.when(found, name)
    return kind.otherwise("article")


def profile(title: Column, text: Column) -> Column:
    """The content profile: a title that starts with a count, the first family of markers, numbered lines, else general."""
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    return _profile(title, text, F.lower(F.concat(title, F.lit("\n"), F.substring(text, 1, PROFILE_CHARS))))


def infer_intent(text: Column) -> Column:
    return _family(F.lower(F.coalesce(text, F.lit(""))), INTENT_PHRASES)


def guess_category(hint: Column, text: Column) -> Column:
    return _category(F.lower(F.coalesce(hint, F.lit(""))), F.lower(F.coalesce(text, F.lit(""))))


def clean_tags(tags: Column) -> Column:
    """At most thirty distinct tags of one to three words that say something."""
    plain = F.transform(tags, lambda t: F.regexp_replace(F.lower(F.trim(t)), r"\s+", " "))
    noise = F.array(*map(F.lit, [*STOPWORDS, *TAG_NOISE]))
    first = lambda t: F.element_at(F.split(F.trim(F.regexp_replace(t, r"(?U)[\W_]+", " ")), " "), 1)
    good = F.filter(plain, lambda t: (t != "") & (F.char_length(t) <= 80) & ~t.isin(BANNED_TAGS) & (first(t) != "") & ~F.array_contains(noise, first(t)) & (F.size(F.split(t, " ")) <= 3))
    return F.slice(F.array_distinct(good), 1, 30)


def semantic_topics(values: Column, labels: list[str]) -> Column:
    """At most two catalogue labels; null if there are more values or one that the catalogue lacks."""
    known = F.create_map(*(F.lit(x) for label in labels for x in (label.lower(), label)))
    mapped = F.transform(values, lambda v: F.element_at(known, F.lower(F.trim(v))))
    return F.when((F.size(values) <= 2) & ~F.exists(mapped, lambda m: m.isNull()), F.array_distinct(mapped))


def light_stem(word: Column) -> Column:
    """A word without its first fitting suffix, if four characters stay."""
    out = None
    for suffix in SUFFIXES:
        fits = F.endswith(word, F.lit(suffix)) & (F.char_length(word) >= len(suffix) + 4)
        cut = F.substring(word, F.lit(1), F.char_length(word) - len(suffix))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(word)


def word_chunks(rows: DataFrame, key: str, text: str, size: int = CHUNK_WORDS, step: int = CHUNK_STEP) -> DataFrame:
    """(key, chunk_idx, chunk_text): windows of ``size`` words; a text of no more words is one chunk, verbatim."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    own = rows.select(key, F.col(text).alias("__text"), words.alias("__words"))
    count = F.greatest(F.lit(1), F.ceil((F.size("__words") - size) / step).cast("int") + 1)
    spread = own.select(key, "__text", "__words", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_idx"))
    body = F.when(F.size("__words") <= size, F.coalesce("__text", F.lit(""))).otherwise(F.array_join(F.slice("__words", F.col("chunk_idx") * step + 1, F.lit(size)), " "))
    return spread.select(key, "chunk_idx", body.alias("chunk_text"))


#: Fixed value: a time marker of transcripts.
MARKER = r"(?:(?<=^)|(?<=[\s\[\(\-]))(\d{1,2}:\d{2}(?::\d{2})?)(?=$|[\s\]\)\.\,\:])"


def seconds_of(stamp: Column) -> Column:
    """Seconds of ``mm:ss`` or ``h:mm:ss``; null for anything else."""
    fields = F.transform(F.split(stamp, ":"), lambda x: x.cast("int"))
    value = F.when(F.size(fields) == 3, fields[0] * 3600 + F.try_element_at(fields, F.lit(2)) * 60 + F.try_element_at(fields, F.lit(3))).otherwise(fields[0] * 60 + F.try_element_at(fields, F.lit(2)))
    return F.when(stamp.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), value)


def timed_sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_idx, start_timestamp, start_seconds, body): a text cut at its time markers; no time is invented."""
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), MARKER, "\u0001$1\u0002")
    pieces = rows.select(key, F.posexplode(F.split(marked, "\u0001")).alias("at", "piece"))
    stamped = pieces.select(key, "at", F.when(F.col("at") > 0, F.substring_index("piece", "\u0002", 1)).alias("start_timestamp"), F.when(F.col("at") > 0, F.substring_index("piece", "\u0002", -1)).otherwise(F.col("piece")).alias("body"))
    trimmed = stamped.withColumn("body", F.regexp_replace("body", r"^[ \t\n\[\]()]+|[ \t\n\[\]()]+$", "")).where("body <> ''")
    return trimmed.select(key, F.col("at").alias("section_idx"), "start_timestamp", seconds_of(F.col("start_timestamp")).alias("start_seconds"), "body")


def timed_chunks(rows: DataFrame, key: str, text: str, size: int = CHUNK_WORDS, step: int = CHUNK_STEP) -> DataFrame:
    """(key, chunk_idx, chunk_text, start_timestamp, start_seconds): each section in windows of words, numbered through the text.

    A chunk has its section's time, or none; a blank or null text has no chunk.
    """
    section = F.struct(F.col(key).alias("of"), "section_idx", "start_timestamp", "start_seconds")
    cut = word_chunks(timed_sections(rows, key, text).select(section.alias("section"), "body"), "section", "body", size, step)
    place = F.row_number().over(W.partitionBy("section.of").orderBy("section.section_idx", "chunk_idx")) - 1
    numbered = cut.withColumn("place", place)
    return numbered.select(F.col("section.of").alias(key), F.col("place").alias("chunk_idx"), F.trim("chunk_text").alias("chunk_text"), "section.start_timestamp", "section.start_seconds")


def url_only(text: Column) -> Column:
    return F.trim(text).rlike(r"(?i)^(?:link:\s*)?https?://\S+\s*$")


#: Fixed value: characters from which a run of prose is not logged as it stands.
LONG_RUN = 200
#: Fixed value: what a run of prose is made of.
PROSE_RUN = r"[\p{L}\p{N} '.,;:!?\-_()\[\]]+"


def digest(value: Column) -> Column:
    """What stands for a hidden value: the first twelve digits of its SHA-256."""
    return F.concat(F.lit("<"), F.substring(F.sha2(value, 256), 1, 12), F.lit(">"))


def _cut(text: Column, pattern: Column, hidden: Column) -> Column:
    """A text in which each match of a pattern is replaced by what ``hidden`` gives for it; what was put in is not looked at again."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern)
    pieces = F.zip_with(between, F.concat(F.transform(found, hidden), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)


def redact_long_runs(text: Column) -> Column:
    """Runs of letters, digits, spaces and plain marks that are long and hold a space, as prose does, become their digest and length; codes stay."""
    said = lambda run: F.format_string("content=[private %s %d chars]", F.substring(F.sha2(run, 256), 1, 12), F.char_length(run))
    hidden = lambda run: F.when((F.char_length(run) >= LONG_RUN) & F.contains(run, F.lit(" ")), said(run)).otherwise(run)
    return _cut(text, F.lit(PROSE_RUN), hidden)


def redact_known(text: Column, known: Column) -> Column:
    """A text with each of the known values (an array) replaced by its digest; null and empty ones hide nothing.

    The text is cut at all values at once, the longest first where several begin, so no digest is cut in turn.
    """
    quoted = lambda v: F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    longer = lambda a, b: F.coalesce(F.nullif(F.char_length(b) - F.char_length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0))
    values = F.array_sort(F.filter(F.coalesce(known, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")), longer)
    return F.when(F.size(values) > 0, _cut(text, F.array_join(F.transform(values, quoted), "|"), digest)).otherwise(text)


def mask_share_paths(path: Column) -> Column:
    """A path, or a line with paths, without the tokens of shares."""
    return F.regexp_replace(path, r"(/(?:s|api/v1/shares)/)[^/?#\s]+", "$1<share-token>")


#: How long a slug and an id of a log may be, and what else than letters and digits they hold.
SLUG_MOST, ID_MOST = 64, 128
SLUG_MARKS, ID_MARKS = r"._:/{}\-", r"_:./\-"


def _closed(value: Column, marks: str, most: int) -> Column:
    return value.rlike(rf"^[\p{{L}}\p{{N}}{marks}]{{1,{most}}}\z")


def safe_slug(value: Column) -> Column:
    """A field that may stand in a log, trimmed; null for free text. A slash is allowed in route templates alone."""
    plain = F.regexp_replace(value, r"^\s+|\s+$", "")
    route = plain.startswith("/") & plain.contains("{") & plain.contains("}") & ~plain.contains("//")
    return F.when(_closed(plain, SLUG_MARKS, SLUG_MOST) & (~plain.contains("/") | route), plain)


def safe_route(path: Column) -> Column:
    """A route template as it is, anything else as unmatched, so no address with an id or a search is logged."""
    return F.coalesce(safe_slug(path), F.lit("unmatched"))


def safe_request_id(value: Column) -> Column:
    """A caller's request id, trimmed; null, for which a new one is to be made, if it is empty, too long or could forge a line."""
    plain = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(_closed(plain, ID_MARKS, ID_MOST), plain)


#: How reasons begin that explain nothing.
VACUOUS = ["matched:", "similar meaning", "related"]


def reason_terms(reason: Column) -> Column:
    """The terms that a reason claims: split at plus signs and commas, without what stands in brackets."""
    plain = F.regexp_replace(F.coalesce(reason, F.lit("")), r"\([^)]*\)", " ")
    return F.filter(F.transform(F.split(plain, "[+,]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def vacuous_reason(reason: Column) -> Column:
    low = F.lower(F.regexp_replace(F.coalesce(reason, F.lit("")), r"^\s+|\s+$", ""))
    return (low == "") | low.rlike("^(?:" + "|".join(VACUOUS) + ")")


def close_tags(vocabulary: list[str], terms: list[str], least: float = 0.8) -> list[str]:
    """Terms with, for each of four letters or more that the vocabulary lacks, its closest entry appended."""
    out = list(terms)
    for term in terms:
        if len(term) >= 4 and term not in vocabulary:
            near = difflib.get_close_matches(term, vocabulary, n=1, cutoff=least)
            out += [x for x in near if x not in out]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _widened(terms: pd.Series, vocabulary: pd.Series) -> pd.Series:
    return pd.Series([close_tags([] if v is None else list(v), list(t)) for t, v in zip(terms, vocabulary, strict=True)])


#: Fixed value: tags of an owner, by name, that a misspelt term is held against.
MOST_TAGS = 1_000


def typo_expand(queries: DataFrame, vocabulary: DataFrame, most: int = MOST_TAGS) -> DataFrame:
    """Queries (owner, query_id, terms) widened by each owner's own tag vocabulary (owner, tag), its first ``most`` tags by name.

    An owner's tags are distinct and cut before they meet in an array, and each query is widened by itself, so no task
    holds an owner's queries. A higher ``most`` takes all tags.
    """
    ranked = vocabulary.where("tag is not null").distinct().withColumn("__n", F.row_number().over(W.partitionBy("owner").orderBy("tag"))).where(F.col("__n") <= most)
    known = ranked.groupBy("owner").agg(F.array_sort(F.collect_list("tag")).alias("__tags"))
    return queries.join(known, "owner", "left").select("owner", "query_id", _widened("terms", F.col("__tags")).alias("terms"))
