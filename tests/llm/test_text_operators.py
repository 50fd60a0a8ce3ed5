"""Operators on single texts: BPE, fingerprints, rules, pages, conversations."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import time

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from intakelake.llm import bpe, chat, fingerprint, html_text, queries, rules
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, score double, mark string, bucket int, _counts int, ids string"
LONG = "Ab cé 12 " * 30_000
EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, LONG), (None, "no id"), (None, None), (5, "x y\nx y\n\n#$ z"), (6, "x y\nx y\n\n#$ z"), (7, " \t\n")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, None, "s", 0.5, "m", 1, 2, "x") for i, t in EDGE], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def own(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@pytest.fixture(scope="module")
def judge():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_bpe_is_the_tokenizers(codec, judge):
    rng = random.Random(1)
    for letters in ("ab", "a", "aA", "thestion", "é€x", " \n\t", "0123", "=-*", "ß ü", "a  \x1c\x85 '"):
        for n in (1, 2, 23, 24, 25, 64, 700, 9000):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert own(codec, text) == judge(text), (letters, n)
    for point in itertools.chain(range(0xD800), range(0xE000, 0x30000, 7)):
        text = f"a {chr(point)}{chr(point)} 9{chr(point)}b\n{chr(point)}"
        assert own(codec, text) == judge(text), hex(point)


def test_bpe_joins_like_a_monoid(codec):
    rng = random.Random(2)
    for _ in range(300):
        a, b, c = (bytes(rng.choice(b"the stion ab") for _ in range(rng.randrange(40))) for _ in range(3))
        e = codec.merge
        assert codec.join(e(a), e(b)) == e(a + b)
        assert codec.join(codec.join(e(a), e(b)), e(c)) == codec.join(e(a), codec.join(e(b), e(c))) == e(a + b + c)


def test_bpe_rows(spark, edge, empty, codec, judge):
    got = bpe.digests(bpe.decode(bpe.encode(edge, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)).collect()
    want = sorted((str(i), len(judge(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in EDGE)
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in got) == want
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_query_is_the_tokenizers(spark, judge):
    want = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = judge(d.text or "")
        want[d.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, SF).collect()} == want


def test_prefix_hashes_answer_spans_and_extensions():
    rng = random.Random(3)
    for n in (0, 1, 15, 16, 17, 400):
        a, b = ("".join(rng.choice("abé€ ") for _ in range(k)) for k in (n, 300))
        x, y = (fingerprint.Prefix.of(fingerprint.code_points(t)) for t in (a, b))
        keep, take = n - n // 2, min(n // 2, 300)
        assert x.then(keep, y, take).fingerprint() == fingerprint.Prefix.of(fingerprint.code_points(a[:keep] + b[:take])).fingerprint()
        for _ in range(60):
            i, j, c = rng.randrange(n + 1), rng.randrange(301), 0
            while i + c < n and j + c < 300 and a[i + c] == b[j + c]:
                c += 1
            assert x.common(i, y, j) == c
            size = rng.randrange(min(n - i, 300 - j) + 1)
            assert (x.span(i, size) == y.span(j, size)) == (a[i : i + size] == b[j : j + size])


def compared_by_hand(rows):
    known = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda x: (-x[0], x[1]))
    out = [(i, t, t) for i, t in ((i, t or "") for i, t in rows if i is None)]
    out += [(i, t, u) for (i, t), (_, u) in zip(known, known[1:] + known[:1])]
    for i, text, following in out:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        marks = [fingerprint.Prefix.of(fingerprint.code_points(t)).fingerprint() for t in (text, edited, following)]
        yield (str(i), len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], fingerprint.likeness(*marks[:2]), fingerprint.likeness(marks[0], marks[2]))


@pytest.mark.parametrize("rows", [1000, 3])
def test_fingerprints_of_neighbours(spark, edge, empty, rows, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", rows)
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = sorted((str(r.doc_id), *(r[n] for n in names)) for r in fingerprint.compared(edge).collect())
    assert got == sorted(compared_by_hand(EDGE))
    assert fingerprint.compared(empty).count() == 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), *(r[n] for n in names)) for r in queries.op9_fingerprints(spark, SF).collect())
    assert got == sorted(compared_by_hand(docs))


def test_rules_match_sql_and_their_filter(spark, edge, empty):
    assert compare(spark, connect(SF), SF, queries.op8_rules, queries.OP8_SQL).startswith("ok")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in queries.op8_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in rules.keep_good(docs).collect()} == kept and kept
    judged = {(r.doc_id, r.n_words, r.n_symbols, r.n_dup_lines, r.base_failed, r.kept) for r in rules.judged(edge).collect()}
    assert {(1, 0, 0, 0, True, False), (2, 0, 0, 0, True, False), (5, 6, 2, 1, True, False), (7, 0, 0, 0, True, False)} <= judged
    assert rules.keep_good(edge).columns == edge.columns and rules.keep_good(edge).count() == 0
    assert rules.judged(empty).count() == rules.keep_good(empty).count() == 0


def test_repeated_windows_by_hand():
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice("abc") for _ in range(rng.randrange(30))]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
        assert rules.count_text(" ".join(w).encode())[5] == len(covered)


PAGES = {
    "": "",
    "plain words": "plain words",
    "<nav>menu</nav><article><h1>A &amp; B</h1><p>One\n two<b>three</b>.<p>Four<br>five &eacute;&#33;</article><footer>foot</footer>": "A & B One twothree. Four five é!",
    "<body><header><a href=x>Home</a></header><div id=content><p>Long text of the page, with words.</p><p>Second part of it, more words.</p></div>"
    "<div class='sidebar'><p>Side side side side side side side side side side</p></div><section class=comments><p>I say so too, at length and more</p></section></body>":
        "Long text of the page, with words. Second part of it, more words.",
    "<article><p>Text</p><aside>Aside</aside><form>Form <input></form><script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><div class=\"cookie-notice\">Cookies</div><p>Rest &lt;b&gt;</p></article>":
        "Text Rest <b>",
    "<div><ul><li><a href=a>first link</a><li><a href=b>second link</a><li><a href=c>third link</a></ul></div><div><p>Here stands what the page is about, in a sentence.</p><p>And here another one, of like length as that.</p></div>":
        "Here stands what the page is about, in a sentence. And here another one, of like length as that.",
    # names that do not say what an element is, or are an inline element's or a heading's
    '<div class="content with-sidebar"><article><p>Main words stand here.</p></article></div>': "Main words stand here.",
    '<article><h2 id="related-work">Related work</h2><p>Body text.</p><p class="notice">Mind <span class="share">share</span> this.</p><div id="social-policy">Policy text.</div></article>':
        "Related work Body text. Mind share this. Policy text.",
    '<div id="sidebar-right"><main><p>Main words stand here.</p></main></div><div class="sidebar">Side words stand here.</div>': "Main words stand here.",
    '<div class="widget-content"><p>No article is marked, and all there is stands in here.</p><p>So the name says nothing.</p></div>': "No article is marked, and all there is stands in here. So the name says nothing.",
    '<div class="comment-box"><p>Nothing but this is on the page, so this is what it is about.</p></div>': "Nothing but this is on the page, so this is what it is about.",
    # names that do
    '<article><p>Text.</p><div class="ad-slot">Buy</div><p class="ad">Buy</p><section id="comments-list"><p>I say</p></section><div class="share-buttons">Share</div><p>Rest.</p></article>': "Text. Rest.",
    '<body><div class="site-header">Top</div><div id="content"><p>Long text of the page, with words.</p><p>Second part of it, more words.</p></div><div class="reader-comments"><p>'
    + "I say a lot, and more than the page does. " * 6 + "</p></div></body>": "Long text of the page, with words. Second part of it, more words.",
}


def test_main_text():
    for page, text in PAGES.items():
        assert html_text.main_text(page) == text, page
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert html_text.main_text(deep) == "deep"
    assert html_text.main_text("<p>a</p>" + "<a " * 100_000).startswith("a <a")
    for broken in ("<", "<p", "<p a='", "</", "<!--", "<script>", "&", "<a href=\"x>y", "<p><b></p></b>"):
        html_text.main_text(broken * 3)


@pytest.mark.parametrize("page", ["<div>{n}</section>{n}", "<b>{n}<div></div>{n}", "<b><div><i>{n}</b>{n}", "<p>{n}<td>{n}</p>{n}", "<ul><li>{n}<table><tr><td>{n}</li>{n}", "<a '{n}>", "<div class='ad'>{n}x"])
def test_nested_pages_take_linear_time(page):
    def seconds(n):
        whole = re.sub(r"((?:<[^{]*>|<a '))\{n\}", lambda m: m[1] * n, page)
        t = time.process_time()
        html_text.main_text(whole)
        return time.process_time() - t

    assert seconds(100_000) < max(20 * seconds(10_000), 1) and seconds(100_000) < 15


def test_densities_by_nested_loops():
    """Counts, densities and their sums of every page, from a walk over each node's whole subtree."""
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet' WHERE html IS NOT NULL").fetchall() + [(x,) for x in PAGES]:
        nodes = html_text.parse(page)
        html_text.settle(nodes)
        body = html_text.weigh(nodes)

        def below(n):
            return [n] + [y for x in n.parts if isinstance(x, html_text.Node) and not x.apart for y in below(x)]

        def chars(n, link=False):
            return sum(len(" ".join(x.split())) for y in below(n) if y.link or not link for x in y.parts if isinstance(x, str))

        def density(n):
            c, t = chars(n), max(len(below(n)) - 1, 1)
            lc, lt = max(chars(n, True), 1), max(sum(y.tag == "a" for y in below(n)[1:]), 1)
            own = chars(n, True)
            spread = math.log(c * own / max(c - own, 1) + chars(body, True) / max(chars(body), 1) * c + math.e)
            return c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(spread), 0.1)

        for n in nodes:
            if not n.apart:
                assert n.chars == chars(n) and (n.link or n.link_chars == chars(n, True))
                assert math.isclose(n.density, density(n) if n.chars else 0.0)
                assert math.isclose(n.total, sum(density(x) for x in n.parts if isinstance(x, html_text.Node) and not x.apart and x.chars), abs_tol=1e-9)


def test_page_rows(spark):
    rows = [(1, "u", None, "t"), (2, None, "<p>a</p>", "t"), (None, "u", "<p>a</p>", "t"), (2, None, "<p>a</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(str, (tuple(r) for r in html_text.extracted(pages).collect()))) == sorted(map(str, [(1, "u", "", 0), (2, None, "a", 1), (2, None, "a", 1), (None, "u", "a", 1)]))
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_escapes_come_back():
    for n in range(5):
        for t in itertools.product("<|\x10n\n", repeat=n):
            text = "".join(t)
            assert chat.read_turns(f"{chat.ROLE}{chat.escape_role(text)}\n{chat.escape(text)}{chat.END}") == [(text, text)]


def test_chat_matches_sql(spark):
    assert compare(spark, connect(SF), SF, queries.op2_chat, queries.OP2_SQL).startswith("ok")


def test_chat_examples(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "<|end|>"), (1, 3, "user", "q"), (1, 4, "assistant", ""), (1, 5, "user", "left"), (2, 0, None, "only"),
             (None, None, "assistant", "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, example int")
    rows = chat.examples(df).collect()
    first = sorted([r for r in rows if r.conv_id == 1], key=lambda r: r.example)
    assert [(r.closing, chat.read_turns(r.text)) for r in first] == [
        (False, [("system", "s"), ("user", ""), ("assistant", "<|end|>")]),
        (False, [("system", "s"), ("user", ""), ("assistant", "<|end|>"), ("user", "q"), ("assistant", "")]), (True, [("user", "left")])]
    assert [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in first[:2]] == ["<|end|>", ""]
    read = {r.conv_id: r for r in chat.digests(chat.examples(df)).collect()}
    assert {c: (r.n_turns, r.n_examples, r.loss_chars) for c, r in read.items()} == {1: (6, 2, 7), 2: (1, 0, 0), 3: (2, 2, 8), None: (1, 1, 1)}
    assert read[3].turns_sha256 == hashlib.sha256(b"assistant\nsame\n" * 2).hexdigest()
    assert chat.digests(chat.examples(df.limit(0))).count() == 0
