"""Main text, media signatures and prefix hashes."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import struct
import time
import wave
import zipfile
import zlib

import numpy as np
import pytest

from vocabspark.llm import html_text, media, spans

ARTICLE = "<h1>A title</h1><p>First, long&nbsp;paragraph of   the\n article, with <b>bold</b> and <a href=x>a link</a>.</p><p>Second &amp; last, it says &lt;here&gt;.<br>Next line.</p>"
WANT = "A title\n\nFirst, long paragraph of the article, with bold and a link.\n\nSecond & last, it says <here>. Next line."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=1>Menu</a></nav><article>{ARTICLE}</article><footer>Foot</footer></body></html>",
        f"<body><div id='header'>Site</div><ul class=menu><li><a href=1>one</a></ul><div class='content'>{ARTICLE}</div><div class='sidebar'><p>Side, text, with, commas, a, lot, of, them.</p></div></body>",
        f"<main>{ARTICLE}<form><p>Name, please, now</p><input></form><section class='comments'><p>Reader says, a, lot, of, things, here, and, more.</p></section></main>",
        f"<div class='cookie-notice'>We use cookies, many, of, them.</div><article>{ARTICLE}<aside>Aside</aside><div class=ad>Buy, now</div><script>var x='</p><p>no';</script></article>",
        f"<article>{ARTICLE}",
        f"<!-- <p>hidden</p> --><ARTICLE>{ARTICLE}</ARTICLE><p hidden>no</p>",
    ],
)
def test_article(page):
    assert html_text.main_text(page) == WANT


LONG = [f"Paragraph {i}, with enough words, commas and length to count as text of the article, {'and more ' * i}so it goes on." for i in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in LONG)


@pytest.mark.parametrize(
    "page, title",
    [
        (f"<div id='content' class='has-sidebar'>{BODY}</div><div class='sidebar'><p>Side text</p></div>", None),
        (f"<body class='no-sidebar'><div class='post-with-comments'><article>{BODY}</article><div class='comments'><p>A reader, says</p></div></div>", None),
        (f"<div class='content'><div class='entry-header'><h1>Title</h1></div>{BODY}</div>", "Title"),
        (f"<div class='search'><div class='widget'>{BODY}</div></div><div id=footer>Foot</div>", None),
        (f"<article><p>{LONG[0]} <svg class='i'/></p>{''.join(f'<p>{p}</p>' for p in LONG[1:])}</article>", None),
        (f"<div class='main-text'>{BODY}</div><div class='comments'>{''.join(f'<p>Reader {i}, with {LONG[4]}</p>' for i in range(30))}</div>", None),
    ],
)
def test_names_that_tell_of_the_layout(page, title):
    assert html_text.main_blocks(page) == ([title] if title else []) + LONG


def test_scoring_without_an_article_element():
    """The best container by its points, computed slowly from the markup, is the one that is kept."""
    rng = random.Random(8)
    for _ in range(60):
        groups = [[f"{'word ' * rng.randint(3, 60)}end{', more' * rng.randint(0, 6)}" for _ in range(rng.randint(1, 6))] for _ in range(4)]
        linked = [rng.random() < 0.4 for _ in groups]
        shown = lambda p, link: f"<p><a href=x>{p}</a></p>" if link else f"<p>{p}</p>"
        page = "".join(f"<section><div>{''.join(shown(p, link) for p in g)}</div></section>" for g, link in zip(groups, linked))
        points = [0 if link else sum(1 + p.count(",") + min(len(p) / 100, 3) for p in g) for g, link in zip(groups, linked)]
        kept = html_text.main_blocks(page)
        if max(points) > sum(points) / 3:  # else the page's root, two levels above, is the best container
            best = points.index(max(points))
            assert [p for p in kept if p in groups[best]] == groups[best]
            assert not any(p in kept for g, link in zip(groups, linked) if link for p in g if p not in groups[best])


def test_long_pages_of_odd_tags():
    """Time linear in the page: names that aren't open, deep nests, blocks inside long inline runs."""
    began = time.time()
    for page in ("<b>" * 100_000 + "</i>" * 100_000 + "x", "<b>" * 100_000 + "<div>x</div>" * 50_000, "<p>" + "<b>" * 50_000 + "</p>" * 50_000, "<ul>" + "<b>" * 60_000 + "<li>x</li>" * 60_000, "<div>" * 100_000 + "<li>x</li>" * 30_000):
        assert "x" in html_text.main_text(page) or "x" not in page
    assert time.time() - began < 20


def test_open_tags_and_odd_pages():
    assert html_text.main_blocks("<article><h1>T</h1><p><b>One two.<br><p>Three</p></article>") == ["T", "One two.", "Three"]
    assert html_text.main_blocks("<ul><li>a<li>b</ul>") == ["a", "b"]
    for page in (None, "", "<", "<p", "<!--", "<a href='", "</p></p>", "<script>x", "&#xfffffff;&bogus;", "<" * 5000, "<div>" * 30000 + "x", "a<b", "<p \"'>x", "<>x</>"):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("plain text only") == "plain text only"
    assert html_text.main_text("x " * 100_000 + "<p>" + "y " * 50_000).count("y") == 50_000


def test_pages_table(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    rows = html_text.extract(pages.withColumnsRenamed({}), ["page_id", "url"], "html").collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    import html as h
    import re

    for page in pages.collect():
        body = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", " ", x.replace("<b>", ""))).split()) for x in re.split(r"</h1>|</?p>", body)]
        assert next(r.text for r in rows if r.page_id == page.page_id) == "\n\n".join(b for b in blocks if b)


def test_likeness_goes_on_after_differences():
    rng = random.Random(6)
    make = lambda words: spans.Prefixes(spans.codes(" ".join(words))).fingerprint()
    words = [f"word{rng.randrange(5000)}" for _ in range(400)]
    for places in ((40, 360), (10, 390), (5, 100, 200, 300)):
        changed = words.copy()
        for at in places:
            changed[at] = "another"
        assert spans.likeness(make(words), make(changed)) > (0.9 if len(places) == 2 else 0.8)
        inserted = words.copy()
        for at in places[::-1]:
            inserted[at:at] = ["one", "more"]
        assert spans.likeness(make(words), make(inserted)) > (0.9 if len(places) == 2 else 0.8)
    other = [f"word{rng.randrange(5000)}" for _ in range(400)]
    assert spans.likeness(make(words), make(other)) < 0.1
    assert 0.6 < spans.likeness(make(words), make(words[:280] + other[:120])) < 0.8
    assert 0.4 < spans.likeness(make(words), make(words + other)) < 0.6  # another scale of cuts
    assert 0.4 < spans.likeness(make(words), make(other[:300] + words[:50] + other[300:] + words[50:])) < 0.6
    for text in ("a" * 100_000, "ab" * 50_000, ""):
        mark = spans.Prefixes(spans.codes(text)).fingerprint()
        assert len(mark) < 20_000 and spans.likeness(mark, mark) == 1.0


def test_spans_are_hashed_free_of_their_places():
    rng = random.Random(7)
    text = "".join(rng.choice("ab") for _ in range(300))
    whole = spans.Prefixes(spans.codes(text))
    starts, ends = np.array([0, 17, 100, 299]), np.array([9, 80, 300, 300])
    for i, (h0, h1) in enumerate(zip(*whole.free(starts, ends))):
        part = spans.Prefixes(spans.codes(text[starts[i] : ends[i]]))
        assert (int(h0), int(h1)) == part.span(0, part.n)
    cut = whole.own_spans(8)
    assert cut["length"].sum() == 300
    assert list(spans._coarser(cut, 1 << 40)) == [(*whole.span(0, 300), 300)]


def _wav() -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(bytes(range(256)) * 3)
    return out.getvalue()


def _zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello" * 50)
    return out.getvalue()


def test_many_magic_bytes():
    """Time linear in the bytes where nothing is confirmed."""
    began = time.time()
    for data in (b"%PDF-1 " * 80_000, b"\x1f\x8b\x08" * 80_000, b"\x1f\x8b\x08\x08 " * 80_000 + b"\0", b"PK\x03\x04" * 100_000, b"%PDF-1 startxref" * 30_000, b"\x1f\x8b\x08\0\0\0\0\0\0\0" * 50_000):
        found, rejected = media.objects(data)
        assert not found and rejected >= 30_000
    assert time.time() - began < 12
    named = io.BytesIO()
    with gzip.GzipFile("a name", "wb", fileobj=named) as out:
        out.write(b"text " * 5000)
    assert media.objects(b"\x1f\x8b\x08\xe0 junk " + named.getvalue() + b"tail")[0] == [(10, 10 + len(named.getvalue()), "application/gzip")]


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff!\xf9\x04\x00\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd12\xff\x0034\xff\xd0\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
OBJECTS = {"image/png": media.store(b"x" * 384), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/wav": _wav(), "application/zip": _zip(), "application/gzip": gzip.compress(b"data" * 999), "application/pdf": b"%PDF-1.4\nstuff startxref 9 %%EOF"}


def test_types_and_carving():
    for kind, data in OBJECTS.items():
        assert media.sniff(data, "text/html") == (kind, []), kind
        cut, found = media.objects(data[:-1])
        assert not cut or kind in ("application/pdf",), kind
    blob, want = b"junk BM RIFF PK\x03\x04 GIF89a \xff\xd8\xff", []
    for kind, data in OBJECTS.items():
        want.append((len(blob), len(blob) + len(data), kind))
        blob += data + b" between "
    assert media.objects(blob)[0] == want
    assert media.sniff(blob, "image/png") == (media.UNKNOWN, want) and media.sniff(b"hello", "text/plain") == ("text/plain", [])


def test_pdf_ends_at_its_last_section():
    body = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    first = body + b"xref\n0 1\ntrailer <<>>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF\n"
    more = first + b"2 0 obj\n<<>>\nendobj\n"
    updated = more + b"xref\n2 1\ntrailer <</Prev 9>>\nstartxref\n" + str(len(more)).encode() + b"\n%%EOF\r\n"
    for data in (first, updated):
        assert media.sniff(data, "application/pdf") == ("application/pdf", [])
    two = b".." + updated + first + b"--" + first
    assert [(s, e) for s, e, _ in media.objects(two)[0]] == [(2, 2 + len(updated)), (2 + len(updated), 2 + len(updated + first)), (len(two) - len(first), len(two))]


def test_round_trip(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "x" * 192), (-3, "ä" * 97), (-3, "ä" * 97)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    stored = media.store_texts(rows, ["doc_id"], "text")
    for r in media.describe(stored, ["doc_id", "n_bytes"], "media", "declared").collect():
        data = texts[r.doc_id].encode()
        whole = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]))
        assert r.type == "image/png" and r.was_wrong and r.carved == []
    assert media.describe(stored.limit(0), ["doc_id"], "media", "declared").count() == 0
    mixed = spark.createDataFrame([(1, bytearray(b"..." + GIF + b"--" + JPEG)), (2, None), (3, bytearray(b"")), (4, bytearray(GIF))], "id long, media binary")
    got = sorted((r.id, r.type, r.at, bytes(r.data)) for r in media.carve(mixed, ["id"], "media").collect())
    assert got == [(1, "image/gif", 3, GIF), (1, "image/jpeg", 5 + len(GIF), JPEG), (4, "image/gif", 0, GIF)]


def test_prefix_arrays():
    rng = random.Random(6)
    a = "".join(rng.choice("abé\U0001f600") for _ in range(300))
    b = a[40:200] + "zz" + a[210:]
    x, y = spans.Prefixes(spans.codes(a)), spans.Prefixes(spans.codes(b))
    for _ in range(500):
        i, j, n = rng.randrange(300), rng.randrange(len(b)), rng.randrange(60)
        same = i + n <= 300 and j + n <= len(b) and a[i : i + n] == b[j : j + n]
        assert x.equal(i, y, j, n) == same
    assert x.extension(40, y, 0) == 160 and x.extension(210, y, 162) == 90 and y.extension(0, x, 40) == 160
    assert x.span(0, 300) != y.span(0, len(b))
    tail = spans.Prefixes(spans.codes(a[:200] + "q" * 50), [s[:201] for s in x.sums])
    assert tail.fingerprint() == spans.Prefixes(spans.codes(a[:200] + "q" * 50)).fingerprint()


def test_likeness():
    rng = random.Random(7)
    make = lambda t: spans.Prefixes(spans.codes(t)).fingerprint()
    for n in (1, 5, 64, 100, 1000, 20_000):
        text = "".join(rng.choice("abcdefgh ") for _ in range(n))
        other = "".join(rng.choice("abcdefgh ") for _ in range(n))
        assert spans.likeness(make(text), make(text)) == 1.0
        if n >= 100:
            assert spans.likeness(make(text), make(other)) < 0.1
            assert 0.65 <= spans.likeness(make(text), make(text[: n - n // 4] + other[: n // 4])) <= 0.8
            middle = text[: n // 2] + "#" + text[n // 2 + 1 :]
            assert spans.likeness(make(text), make(middle)) > 0.9
            assert spans.likeness(make(text), make("#" + text)) > 0.9
    assert spans.likeness(make(""), make("")) == 1.0 and spans.likeness(make(""), make("a")) == 0.0


def test_follower_order(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "null id"), (None, None), (7000, ""), (7001, "one"), (7001, "two"), (7002, None)], "doc_id long, text string")
    for df, parts in ((docs.unionByName(odd), 5), (docs.limit(1), 3), (odd, 2)):
        rows = sorted(((r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "") for r in df.collect()))
        got = sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_chars, r.edited_sha256) for r in spans.fingerprints(df.repartition(3), "doc_id", "text", parts).collect())
        want = []
        for i, (key, text) in enumerate(rows):
            after, cut = rows[(i + 1) % len(rows)][1], len(text) // 4
            want.append((key, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()))
        assert got == sorted(want)
    assert spans.fingerprints(docs.limit(0), "doc_id", "text").count() == 0
