"""Containers, archives, pages and chats: round trips, broken input and known answers."""

import io
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import chat, html, media, warc


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 48, 576 * 48 + 1, 576 * 147 + 5])
def test_media_round_trip(n):
    payload = media.pad(os.urandom(n))
    assert len(payload) >= 576 and len(payload) % 576 == 0
    content = media.store(payload)
    (track,) = media.tracks(content)
    assert media.read_samples(content, track) == payload
    assert (track.codec, track.width, track.height) == ("raw ", 24, 24)
    assert track.seconds == pytest.approx(len(payload) / 576 / 24)
    for offset, length in track.keyframes():
        assert content[offset : offset + length] in payload
    assert len(track.keys) == -(-len(payload) // (576 * 12))


def test_broken_media_raises_only_value_errors():
    rng = random.Random(1)
    good = media.store(media.pad(b"x" * 9000))
    for _ in range(500):
        bad = bytearray(good)
        for _ in range(3):
            bad[rng.randrange(700)] = rng.randrange(256)
        try:
            media.tracks(bytes(bad[: rng.randrange(1, len(bad))]))
        except ValueError:
            pass


def test_long_box_sizes():
    inner = media._box(b"free", b"abc")
    long = b"\0\0\0\1mdat" + (16 + len(inner)).to_bytes(8, "big") + inner
    assert [(b.kind, b.end - b.body) for b in media.boxes(memoryview(long + b"\0\0\0\0free123"))] == [(b"mdat", 11), (b"free", 3)]


def test_media_columns(spark):
    files = [(1, media.store(media.pad(b"a" * 10_000))), (2, b"junk"), (3, None), (4, media._box(b"moov"))]
    got = {r["id"]: r for r in media.media_columns(spark.createDataFrame([(a, bytearray(b) if b is not None else None, "x") for a, b in files], "id long, content binary, codec string"), "id", "content").collect()}
    assert (got[1]["codec"], got[1]["n_samples"], got[1]["n_keyframes"], len(got[1]["keyframes"])) == ("raw ", 18, 2, 2)
    assert all(got[i]["codec"] is None and got[i]["error"] for i in (2, 3, 4))


def test_stored_texts(spark):
    rows = [(1, "é"), (2, None), (3, ""), (1, "é")]
    got = media.digest_media(media.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["payload_bytes"]) for r in got) == [(1, 2, 576), (1, 2, 576), (2, 0, 576), (3, 0, 576)]
    assert len({tuple(r)[2:] for r in got}) == 2


@pytest.mark.parametrize("step", [1_000, 1 << 25])
def test_op7_digests_are_those_of_the_payload(spark, monkeypatch, step):
    """Against hashlib and zlib, with the stored form made here once more."""
    import hashlib
    import zlib

    monkeypatch.setattr(media, "STEP", step)
    rows = [(i, t) for i, t in enumerate(["é", None, "", "x" * 575, "x" * 576, "y" * 577, "wörter " * 30_000, "z" * 3_000_000])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in media.digest_media(media.store_texts(df)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-32:])
        stored = media.store(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and padded in stored


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_and_lengths(version):
    records = [warc.legacy_record(u, p, 2 * i + version - 1) for i, (u, p) in enumerate([("http://a/", b"one"), ("http://b/x y", b"URL 1.2.3.4 20200101000000 text/html 5\n\nHTTP/"), (None, b"")])]
    data = warc.write_arc(records, version)
    back = list(warc.read_arc(io.BytesIO(data)))
    assert [(r.version, r.content) for r in back] == [(version, r.content) for r in records]
    assert [r.fields["url"] for r in back] == ["http://a/", "http://b/x%20y", "-"]
    with pytest.raises(ValueError, match="declares"):
        list(warc.read_arc(io.BytesIO(data[:-60])))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(b"no line\n")))


def test_arc_url_with_spaces():
    line = b"http://a/b c 1.2.3.4 20200101000000 text/html 3\nabc\n"
    head = warc.write_arc([], 1)
    (r,) = warc.read_arc(io.BytesIO(head + line))
    assert (r.fields["url"], r.fields["ip"], r.content) == ("http://a/b c", "1.2.3.4", b"abc")


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.text(max_size=20))
def test_record_ids_hold_the_source(number, url):
    urn = warc.record_id(url, "20200101000000", "ABC", number)
    assert warc.source_id(urn) == number and urn == warc.record_id(url, "20200101000000", "ABC", number) != warc.record_id(url, "20200101000000", "ABD", number)


def test_warc_records_round_trip():
    record = warc.legacy_record("http://a/", "ü".encode() * 100, 5)
    first = warc.to_warc(record, 5)
    ((h, _),) = warc.read_warc(io.BytesIO(first))
    raw = first + warc.to_warc(record, 6, h["warc-record-id"])
    (h1, b1), (h2, b2) = warc.read_warc(io.BytesIO(raw))
    assert (h1["warc-type"], h2["warc-type"]) == ("response", "revisit")
    assert warc.split_http(b1)[1] == "ü".encode() * 100 and warc.split_http(b2)[1] == b""
    assert h1["warc-payload-digest"] == h2["warc-payload-digest"] == "sha1:" + warc.digest("ü".encode() * 100)
    assert h2["warc-refers-to"] == h1["warc-record-id"] and warc.source_id(h2["warc-record-id"]) == 6
    assert h1["warc-date"].endswith("Z") and len(h1["warc-date"]) == 20


def test_archives(spark):
    rows = [(3, "u", "same"), (1, "v", "same"), (7, None, None), (5, "w", ""), (5, "w", ""), (None, "x", "same"), (9, "y\n", "\r\n\r\nWARC/1.0\r\n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(warc.write_archives(df)).collect()), key=str)
    assert got == sorted([(3, "revisit", 1, 4), (1, "response", None, 4), (None, "revisit", 1, 4), (7, "revisit", 5, 0), (5, "response", None, 0), (5, "response", None, 0), (9, "response", None, 14)], key=str)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_every_reference_is_a_record_of_the_archives(spark):
    rows = [(i, f"http://host/{i}", f"payload {i % 7}" if i % 3 else None) for i in range(60)]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    headers = {}
    for r in files.collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            for h, block in warc.read_warc(f):
                headers[h["warc-record-id"]] = h
                assert h["warc-block-digest"] == "sha1:" + warc.digest(block)
    revisits = [h for h in headers.values() if h["warc-type"] == "revisit"]
    assert len(headers) == 60 and len(revisits) == 60 - 8
    for h in revisits:
        original = headers[h["warc-refers-to"]]
        assert original["warc-type"] == "response" and original["warc-payload-digest"] == h["warc-payload-digest"]


def test_a_reference_to_nothing_raises(spark, tmp_path):
    record = warc.legacy_record("http://a/", b"text", 5)
    (tmp_path / "a.warc.gz").write_bytes(warc.to_warc(record, 6, "<urn:uuid:00000000-0000-8000-8000-000000000000>"))
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    with pytest.raises(Exception, match="refers to"):
        warc.read_archives(files).collect()


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>if (a < b) "</p>"</script></head><body class="post">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li>About</ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies. Accept them all, please, for this is a long notice about nothing at all.</div>
<div id="content"><h2>Title &amp; more</h2><p>First paragraph, with <b>bold</b> and <a href="x">a link</a> in it,
 and enough words to be text.<p>Short.<ul><li>one item<li>two &lt;items&gt;</ul><p title="a > b">Last&nbsp;one has a few more words in it than the others do.</div>
<aside><p>Related: a story that is as long as the paragraphs in the article itself, or longer.</p></aside>
<form><p>Subscribe to our letter, it is good</p><input></form>
<div class="comments"><p>I liked this article a lot, and so I write a long comment beneath it.</p></div>
<footer>&copy; 2020 Someone</footer></body></html>"""


def test_main_text():
    want = "Title & more\nFirst paragraph, with bold and a link in it, and enough words to be text.\nShort.\none item\ntwo <items>\nLast one has a few more words in it than the others do."
    assert html.main_text(PAGE) == want


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- x", "<script>x", "<nav>Home</nav>", "</div></p>", "<a href='x>y"])
def test_pages_without_text(page):
    assert html.main_text(page) in ("",) if page != "</div></p>" else html.main_text(page) == ""


def test_broken_and_large_pages_end_soon():
    assert html.main_text("<p>" + "<b>" * 50_000 + "word " * 50_000).count("word") == 50_000
    assert html.main_text("<div>" * 20_000 + "<article>some words here") == "some words here"
    html.main_text('<a "' * 20_000)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 9), st.floats(0, 9)), min_size=1, max_size=7), st.data())
def test_minimum_cut_is_minimal(costs, data):
    n = len(costs)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    links = [(*p, data.draw(st.floats(0, 5))) for p in data.draw(st.lists(st.sampled_from(pairs), max_size=8))] if pairs else []
    drop, keep = [c[0] for c in costs], [c[1] for c in costs]

    def cost(labels):
        return sum(k if x else d for x, d, k in zip(labels, drop, keep)) + sum(w for a, b, w in links if labels[a] != labels[b])

    best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cost(html.minimum_cut(drop, keep, links)) == pytest.approx(best, abs=1e-6)


def test_extraction_of_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, len(html.main_text(PAGE)))] * 2 + [(2, 0)]


T = chat.INSTRUCT


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</s>"]), st.text(alphabet=st.sampled_from("ab\\</s>[INST]/\n«SY<ROLE é"), max_size=30)), min_size=1, max_size=6))
def test_chat_round_trip(spark, turns):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(rows)
    r = out.select("formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss")).first()
    assert [tuple(t) for t in r["turns"]] == turns
    assert r["loss"] == "".join(x for role, x in turns if role == "assistant")
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]


def test_chat_order_nulls_and_automaton(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 1, "assistant", "x"), (3, 1, "system", None), (3, 2, "user", ""), (4, None, None, None), (4, None, None, None), (None, 1, "user", "n"), (5, 1, "user", "a"), (5, 2, "user", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: True, 4: False, None: True, 5: False}
    assert got[1]["formatted"] == "[INST]a[/INST]<s>b</s>" and len(got[4]["segments"]) == 6
    assert [s["text"] for s in got[1]["segments"] if s["loss"]] == ["b"]
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("odd", ["<svg class=i/>", "<svg><style/><path/></svg>", "<video-player></video-player>", "<button-x>", "<object-y>", "<button>", "<svg>a <svg>b</svg> c</svg>", "<video>old browser</video>", "<script>a</scripty> b</script >"])
def test_text_after_odd_elements_stays(odd):
    words = "some plain words of an article that goes on for a while"
    assert html.main_text(f"<article><p>{words}</p>{odd}<p>{words}</p></article>").split("\n") == [words, words]


@pytest.mark.parametrize("name", ["math", "object", "noscript"])
def test_text_that_shows_in_its_place_stays(name):
    assert html.main_text(f"<article><p>as we see, <{name}>x is two</{name}> and so it is for all of the others</p></article>") == "as we see, x is two and so it is for all of the others"


PARA = "<p>" + "some words of running text here " * 10 + "</p>"


@pytest.mark.parametrize("name", ["content with-sidebar", "page has-header", "form-article", "layout no-sidebar", "legal-article", "related-story-main", "post comments-closed"])
def test_names_are_evidence_not_proof(name):
    page = f"<body><nav><a href=x>All the pages</a></nav><div class='{name}'><article><h1>A title</h1>{PARA * 4}</article></div><footer>Imprint</footer></body>"
    lines = html.main_text(page).split("\n")
    assert lines[0] == "A title" and len(lines) == 5


@pytest.mark.parametrize("part", ["<div class='sidebar'>{}</div>", "<div id=comments>{}</div>", "<div class='ad-box'>{}</div>", "<aside>{}</aside>", "<div class='post-comments'><article class='comment'>{}</article></div>", "<div class='cookie-bar'>{}</div>", "<aside><article>{}</article></aside>"])
def test_parts_of_an_article_that_are_no_text_go(part):
    page = f"<body><article><h1>A title</h1>{PARA * 4}{part.format(PARA)}</article>{part.format(PARA)}</body>"
    assert len(html.main_text(page).split("\n")) == 5


def test_large_pages_take_time_in_proportion():
    import random
    import time

    rng = random.Random(1)
    kinds = ["<p>short one</p>", "<ul><li><a href=x>link text</a></li></ul>", "<div class=related>" + PARA + "</div>", PARA]
    page = "<body>" + "".join(f"<div><p>{'w ' * rng.randint(1, 30)}</p></div>" if rng.random() < 0.3 else rng.choice(kinds) for _ in range(20_000))
    found = html.blocks(page)
    drop, keep = html.costs(found)
    began = time.process_time()
    html.minimum_cut(drop, keep, html.edges(found))
    assert len(found) == 20_000 and time.process_time() - began < 2


def test_op8_finds_the_articles_of_the_test_pages(spark):
    """Against another reading of the pages: what stands between the article's tags, cut at block tags."""
    import re
    from html import unescape

    from lodestrata.llm import queries
    from lodestrata.llm.shared import load

    sf = "/root/testdata/sf0.001"

    def plain(page):
        (body,) = re.findall(r"(?s)<article>(.*?)</article>", page)
        cut = (re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x) for x in re.split(r"</?(?:h1|p)>", body))
        return "\n".join(x for x in (" ".join(unescape(c).split()) for c in cut) if x)

    got = {r["page_id"]: r for r in queries.op8_html_extraction(spark, sf).collect()}
    pages = load(spark, sf, "pages").collect()
    assert len(got) == len(pages) > 0
    for r in pages:
        assert got[r["page_id"]]["text"] == plain(r["html"]) and got[r["page_id"]]["n_chars"] == len(plain(r["html"]))
