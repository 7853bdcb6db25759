"""HTML text, licenses, token counts, media and line dedup against plain versions on small tables."""

import cmath
import hashlib
import io
import json
import math
import random
import time
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import html, licenses, lines, media, registry, tokens
from lodestone.llm.words import Words, lowered

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", None, "a", "Ünï çødé 漢字 🙂 <|endoftext|> x", "  spaces\t\ttabs\r\nlines  \x1c\x85 end  ", "don't we'll I'M 12345 ... !!??", "same", "same", "x" * 5000, "naïve words " * 3000]


def documents(spark, texts=ODD):
    rows = [(i if i != 5 else None, t, f"s{i % 3}" if i != 2 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash")).withColumn("media", F.lit(1)).withColumn("size", F.lit(2))


def test_tokens_equal_the_library(spark, data):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rows = documents(spark, [*ODD, *(r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect()), "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(0x100, 0x3000, 7)))])
    found = tokens.count_tokens(rows, path, 10).collect()
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    assert len(found) == len(texts)
    for r in found:
        n = len(own.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 10)
    assert tokens.count_tokens(rows.where("false"), path).count() == 0


def test_worker_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_SIZE", 3)
    monkeypatch.setattr(tokens, "LONGEST", 6)
    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    counter = tokens.Counter(spec, tokens.frequent_lengths(spec))
    counter.unlike.add("é")
    texts = [f"qzx{i}v wqpt{i} zzq{i}kk café  été — “quoted”\u0378 x<|endoftext|>\ue000 {'long' * 50}" for i in range(20)]
    assert [n for t in texts for n in counter.counts([t])] == [len(counter.tokenizer.encode(t).ids) for t in texts]
    assert counter.counts(texts) == [len(counter.tokenizer.encode(t).ids) for t in texts]
    assert max(map(len, set(counter.known) - set(counter.frequent))) <= 6


def test_every_assigned_character_counts_as_in_the_library():
    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    counter = tokens.Counter(spec, tokens.frequent_lengths(spec))
    texts = ["".join(f"ab{chr(c)}c {chr(c)}1 {chr(c)}, {chr(c)}\n" for c in range(start, start + 500) if not 0xD800 <= c < 0xE000) for start in [*range(1, 0x3200, 500), *range(0xA000, 0x11000, 1500), *range(0x1E000, 0x1FC00, 500)]]
    assert counter.counts(texts) == [len(counter.tokenizer.encode(t).ids) for t in texts]


def test_other_tokenizers_are_refused():
    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    tokens.checked(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            tokens.checked(json.dumps(json.loads(spec) | change))


def test_peaks_far_apart_are_told_apart():
    time, bins = np.array([0, 5_000, 5_000_000], np.int32), np.array([3, 4, 5], np.int32)
    assert len(set(media.peak_pairs(time, bins)[1].tolist())) == 3
    late = media.peak_pairs(time + np.array([0, 1, 0], np.int32), bins)[1]
    assert set(late.tolist()) != set(media.peak_pairs(time, bins)[1].tolist())


def plain_feature(payload):
    """The peak pairs of a text by a plain Fourier sum."""
    signal = [b - 128 for b in payload] + [0] * max(0, 128 - len(payload))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 127) for i in range(128)]
    best = []
    for start in range(0, len(signal) - 127, 64):
        frame = [x * w for x, w in zip(signal[start : start + 128], window, strict=True)]
        power = [abs(sum(x * cmath.exp(-2j * math.pi * k * i / 128) for i, x in enumerate(frame))) for k in range(1, 65)]
        best.append((max(power), power.index(max(power)) + 1))
    peaks = [(i, b) for i, (p, b) in enumerate(best) if p > 1e-3 and p >= max(x[0] for x in best[max(0, i - 1) : i + 2]) - 1e-4]
    return sorted((peaks[i][0], peaks[i][1], peaks[j][1], peaks[j][0] - peaks[i][0]) for i in range(len(peaks)) for j in (i + 1, i + 2) if j < len(peaks))


def test_feature_equals_a_plain_transform(spark):
    texts = ["short", "The quick brown fox jumps over the lazy dog; " * 30, "ä" * 200 + "xyz" * 99]
    rows = media.store_as_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        own = [(t, h >> 40, h >> 32 & 255, h & (1 << 32) - 1) for t, h in zip(r.peak_time, r.peak_hash, strict=True)]
        assert sorted(own) == plain_feature(bytes(r.payload))


def test_media_round_trip(spark):
    rows = documents(spark)
    own = media.store_as_media(rows)
    digests = {r.doc_id: r for r in media.media_digest(own).collect()}
    stored = {r.doc_id: r for r in own.collect()}
    for r in rows.collect():
        text = (r.text or "").encode()
        padded = text + bytes(-len(text) % 64 or (0 if text else 64))
        d = digests[r.doc_id]
        with wave.open(io.BytesIO(bytes(stored[r.doc_id].media))) as file:
            assert file.readframes(file.getnframes()) == padded
        assert (d.n_bytes, d.payload_bytes, d.tail_crc32) == (len(text), len(padded), zlib.crc32(padded[-64:]))
        assert d.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert d.media_sha256 == hashlib.sha256(bytes(stored[r.doc_id].media)).hexdigest()
    assert digests[6].feature == digests[7].feature and digests[0].feature == digests[1].feature
    assert len(stored[9].peak_time) > 50 and stored[9].peak_time == sorted(stored[9].peak_time)
    assert media.store_as_media(rows.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav>
<main><article class="post"><header class="article-header"><h1>Big &amp; bold</h1></header><p>One  <b>two</b>
three<br>four<p>Five &lt;six&gt;&#33;<ul><li>a<li>b</ul><div class="ad-box">Buy</div><div id="cookieNotice">Cookies</div>
<div>Follow us everywhere</div><script>var a = "<p>no</p>";</script><form><p>mail</p></form><section class="comments"><p>nice post</p></section></article>
<aside>side</aside></main><div role="contentinfo">foot</div><footer>&copy; me</footer></body></html>"""


def text_blocks(source):
    page = html.Page(source)
    return page.blocks(page.roots())


def test_html_rules():
    assert text_blocks(PAGE) == ["Big & bold", "One two three four", "Five <six>!", "a", "b", "Follow us everywhere"]
    assert text_blocks("<p>a<p>b<div>c</div>d") == ["a", "b", "c", "d"]
    assert text_blocks("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl>") == ["a", "b", "c", "d", "e"]
    for odd in (None, "", "<", "<p", "</div></p>", "<!", "<![", "<![endif]-->", "<!-- open", "<script>open", "&#"):
        text_blocks(odd)


@pytest.mark.parametrize("section", ["<![foo[bar", "<![foo[bar]]>", "<![CDATA[gone > gone]]>", "<![if !IE]>", "<![", "<!>", "<!foo>", "<?php x ?>", "</>", "</ x>"])
def test_odd_sections_are_comments(section):
    assert text_blocks(f"<article><p>one</p>{section}<p>two</p></article>")[:1] == ["one"]
    assert text_blocks(f"<article><p>one</p>{section}><p>two</p></article>")[-1].endswith("two")


@pytest.mark.parametrize("tag", ["div", "span", "blockquote", "b", "ul", "li", "p"])
def test_nesting_of_any_depth(tag):
    page = html.Page(f"<article>{f'<{tag}>x ' * 100_000}end")
    roots = page.roots()
    assert page.blocks(roots, page.digests(roots), {1})[-1].endswith("end")


def test_numbers_of_any_length():
    assert text_blocks(f"<p>a&#{'9' * 5000};b&#{'0' * 5000}65;c&#x41;</p>") == ["a\ufffdbAcA"]


def test_reader_comments_go_even_as_articles():
    blog = '<div id="comments"><ol class="comment-list"><li class="comment"><article class="comment-body"><p>reader says</p></article></li></ol></div>'
    assert text_blocks(f"<article><p>post</p></article>{blog}") == text_blocks(f"<article><p>post</p>{blog}</article>") == ["post"]
    assert text_blocks('<article class="reply"><p>no</p></article><article><p>post</p></article>') == ["post"]


def test_roots_are_chosen_by_what_they_hold():
    long = "the story goes on " * 9
    assert text_blocks(f'<div><p>{long}</p></div><article class="card">teaser</article>') == [long.strip(), "teaser"]
    assert text_blocks("<main><p>lead</p><article>the article is longer</article><div>beside</div><p>tail</p></main>") == ["lead", "the article is longer", "tail"]
    assert text_blocks(f"<article><main><p>in</p></main><p>{long}</p></article>") == ["in", long.strip()]
    for name in ('class="sidebar-left"', 'class="search-list"', 'id="widget-list"'):
        assert text_blocks(f'<div {name}><div class="content">all there is</div></div>') == ["all there is"]
        assert text_blocks(f"<div {name}>{long}</div><article>post</article>") == ["post"]


@pytest.mark.parametrize(("source", "text"), [("a<!-- never closed <p>b", ["a"]), ("a<!-->b", ["ab"]), ("<script><!-- x </script>text", ["text"]), ('<p>x</p><a href="', ["x"]), ("a < b and <3", ["a < b and <3"]), ("a<!-- b --><p>c<!-- d", ["a", "c"])])
def test_markup_that_the_end_cuts_off(source, text):
    assert text_blocks(source) == text


@pytest.mark.parametrize("piece", ["<a ", "<!--", '<a href="', "<a b='>", "</", "<!", "<?", "&#", "</a ", "<![", "<p><!-"])
@pytest.mark.parametrize("last", ["", ">"])
def test_broken_markup_takes_no_long_time(piece, last):
    began = time.process_time()
    text_blocks(piece * (500_000 // len(piece)) + last)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("attribute", ['class="related-work"', 'class="search-results"', 'id="content-widget-main"', 'class="ad-hoc social-science"', 'class="comment-on-law"', 'id="share-price"'])
def test_text_is_not_lost_by_parts_of_names(attribute):
    assert text_blocks(f"<body {attribute}><article><p>one</p><div {attribute}>two</div></article></body>") == ["one", "two"]
    assert text_blocks(f"<div {attribute}><p>one</p></div>") == ["one"]


@pytest.mark.parametrize("attribute", ['class="ad"', 'class="x ad-box"', 'id="cookieNotice"', 'class="post-comments"', 'class="related-posts"', 'class="share-buttons"', 'role="search"', "hidden"])
def test_boilerplate_by_whole_names_goes(attribute):
    assert text_blocks(f"<article><p>one</p><div {attribute}>two</div></article>") == ["one"]


def test_a_wrapper_of_the_article_stays():
    assert text_blocks('<div class="widget"><article><p>one</p></article><p>two</p></div>') == ["one"]
    assert text_blocks('<div class="header"><main>one</main></div>') == ["one"]


def plain_templates(pages):
    """Per host, the block subtrees on over half of its distinct contents and on five at least, counted on nested tuples."""

    def tree(page, i):
        parts = []
        for part in page.parts[i]:
            if isinstance(part, str):
                if part.strip():
                    parts.append(" ".join(part.split()))
            elif page.kept[part] and (inner := tree(page, part)):
                parts.append(inner)
        return (page.tags[i], *parts) if parts else None

    def subtrees(node):
        found = {node} if node[0] in html.BLOCK else set()
        return found.union(*(subtrees(x) for x in node[1:] if isinstance(x, tuple)))

    hosts = {}
    for host, source in pages:
        page = html.Page(source)
        tops = tuple(t for r in page.roots() if (t := tree(page, r)))
        hosts.setdefault(host, {})[tops] = set().union(*(subtrees(t) for t in tops)) - set(tops)
    counts = {host: [sum(x in own for own in contents.values()) for x in set().union(*contents.values())] for host, contents in hosts.items()}
    return {host: sum(n >= 5 and n > len(hosts[host]) / 2 for n in c) for host, c in counts.items()}


def test_template_counts_equal_plain(spark):
    rng = random.Random(11)
    part = lambda depth: f"<{(t := rng.choice(['div', 'p', 'section', 'b']))}>{rng.choice('abc')}{part(depth - 1) if depth else ''}</{t}>"
    pages = [(rng.choice(["a", "a", "b", None]), "".join(part(rng.randrange(3)) for _ in range(rng.randrange(1, 5)))) for _ in range(200)]
    found = {}
    for r in html.template_subtrees(spark.createDataFrame(pages, "host string, html string")).collect():
        found[r.host] = found.get(r.host, 0) + 1
    assert found == {host: n for host, n in plain_templates(pages).items() if n}


def test_site_template_goes_and_articles_stay(spark):
    rows = [(i, f"https://a.org/{i}", PAGE.replace("One", f"One{i}")) for i in range(8)]
    rows += [(100 + i, "https://b.org/same", PAGE) for i in range(8)]  # copies of one page are no template
    rows += [(200, None, PAGE), (201, "https://a.org/x", None), (202, "nonsense", ""), (None, "https://a.org/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    found = {r.page_id: r for r in html.extract_text(pages).collect()}
    assert len(found) == len(rows)
    assert found[3].text == "One3 two three four"  # all else recurs on the eight pages of the host
    assert found[103].text.endswith("Follow us everywhere") and found[200].text == found[103].text
    assert (found[201].text, found[202].text, found[202].n_chars) == ("", "", 0)
    assert found[103].n_chars == len(found[103].text)
    assert html.extract_text(pages.where("false")).count() == 0


def test_pages_keep_their_whole_article(spark, data):
    import html as entities
    import re

    found = {r.page_id: r.text for r in registry.op1_html_text(spark, data).collect()}
    for page in spark.read.parquet(f"{data}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", page.html, re.S).group(1)
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert found[page.page_id] == "\n".join(p for p in parts if p)


def shingles(text, size):
    words = [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()]
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def test_licenses_equal_brute_force(spark):
    rng = random.Random(5)
    filler = ["alpha", "license", "the", "under", "granted", "rights", "software", "omega"]
    texts = []
    for name, template in licenses.TEMPLATES.items():
        before, after = (" ".join(rng.choices(filler, k=rng.randrange(40))) for _ in range(2))
        words = template.split()
        texts += [f"{before} {template} {after}", template.upper(), f"{before} {' '.join(words[: len(words) // 2])} {after}"]
        if len(words) > 40:
            words[10] = "changed"
            texts.append(f"{before} {' '.join(words)} {after}")
    texts += ["", None, "rights", "All rights", "all rights reserved all rights reserved"]
    found = {(r.doc_id, r.license) for r in licenses.scan_licenses(documents_by_position(spark, texts)).collect()}
    expected = set()
    for i, text in enumerate(texts):
        for name, template in licenses.TEMPLATES.items():
            size = min(5, len(shingles(template, 1)))
            own, there = set(shingles(template, size)), shingles(text or "", size)
            most = len(own) * 3
            share = max((len(own & set(there[a : a + most])) / len(own) for a in range(max(1, len(there)))), default=0)
            if share >= 0.8:
                expected.add((i, name))
    assert found == expected
    assert licenses.scan_licenses(documents_by_position(spark, texts).where("false")).count() == 0


def documents_by_position(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license", F.lit("clash"))


def test_band_settings_follow_the_guarantee():
    for group in licenses._groups(licenses.TEMPLATES, 0.8):
        least = min(-(-8 * len(s) // 10) / (group.width + len(s) - -(-8 * len(s) // 10)) for s in group.shingles)
        assert least >= 1 or 1 - (1 - least**licenses.ROWS) ** group.bands >= licenses.COLLISION


def test_words_are_hashed_by_content():
    words = Words([lowered("One, two one"), b"", lowered("ONE étude")])
    assert list(words.doc) == [0, 0, 0, 2, 2] and words.hash[0] == words.hash[2] == words.hash[3] != words.hash[1]
    assert len(Words([]).hash) == 0


def plain_line_dedup(rows, ratio, least):
    hosts = {}
    for _, host, text in rows:
        hosts.setdefault(host, set()).add(text or "")
    out = []
    for key, host, text in rows:
        count = lambda x: sum(x in {y.strip(" ") for y in t.split("\n")} for t in hosts[host])  # noqa: B023, E731
        bad = lambda x: x.strip(" ") != "" and count(x.strip(" ")) >= least and count(x.strip(" ")) > ratio * len(hosts[host])  # noqa: B023, E731
        out.append((key, host, None if text is None else "\n".join(x for x in text.split("\n") if not bad(x))))
    return out


def test_line_dedup_equals_plain(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None]), "\n".join(rng.choice(["menu", " menu ", "", f"line {rng.randrange(9)}", f"own {i}"]) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(90, "a", None), (91, "a", ""), (91, "a", "menu"), (None, "b", "menu\nx"), (93, "c", "menu")] + [(100 + i, "b", "copied page\nof many copies") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_chars", F.char_length("text").cast("long")).withColumn("host", F.lit("clash"))
    found = lines.drop_boilerplate_lines(docs, ratio=0.3, min_pages=3)
    assert sorted(map(repr, ((r.doc_id, r.source, r.text) for r in found.collect()))) == sorted(map(repr, plain_line_dedup(rows, 0.3, 3)))
    assert found.where("n_chars <> char_length(text)").count() == 0
    assert lines.drop_boilerplate_lines(docs.where("false")).count() == 0
    wide = lines.drop_boilerplate_lines(docs, ratio=0.3, min_pages=3)
    assert set(docs.columns) < set(wide.columns)


def test_line_dedup_runs_no_python(spark, data):
    plan = registry.op10_line_dedup(spark, data)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_registered_sql(spark, data, duck):
    for name, sql in registry.oracle_sql().items():
        frame = registry.queries()[name](spark, data)
        columns = sorted(frame.columns)
        result = duck.execute(sql)
        found = [c[0] for c in result.description]
        expected = sorted(repr(tuple(row[found.index(c)] for c in columns)) for row in result.fetchall())
        assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == expected


def test_every_notice_is_told_from_its_likes(spark):
    names = list(licenses.TEMPLATES)
    texts = [f"before it {licenses.TEMPLATES[n]} and after" for n in names]
    best = {}
    for r in licenses.scan_licenses(documents_by_position(spark, texts)).collect():
        best.setdefault(r.doc_id, {})[r.license] = r.containment
    assert all(best[i][n] == 1.0 for i, n in enumerate(names))
    assert best[names.index("gpl-2.0")]["gpl-3.0"] < 1.0 and best[names.index("agpl-3.0")]["gpl-3.0"] < 1.0
