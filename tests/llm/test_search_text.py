"""Search, subword and HTML operators against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.llm import subword as SW
from stratavox.llm.ann import build_graph, nearest_neighbours, robust_prune
from stratavox.llm.bm25 import ShardIndex, search_bm25, terms_of
from stratavox.llm.html_extract import extract_html, main_text
from stratavox.llm.queries import tokenizer_file


def bm25_by_brute_force(rows, queries, k=10, most=None, k1=1.2, b=0.75):
    tf = [dict(zip(*[x.tolist() for x in terms_of(t)], strict=True)) for _, t in rows]
    size = [sum(x.values()) for x in tf]
    n, mean = len(rows), max(sum(size) / len(rows), 1e-9)
    df = Counter(t for x in tf for t in x)
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    signed = lambda t: int(np.uint64(t).astype(np.int64))
    out = {}
    for qid, text in queries:
        q = dict(zip(*[x.tolist() for x in terms_of(text)], strict=True))
        pick = sorted((t for t in q if t in idf), key=lambda t: (-(1 + math.log(q[t])) * idf[t], signed(t)))[:most]
        hits = []
        for (i, _), x, m in zip(rows, tf, size, strict=True):
            if i is not None and any(t in x for t in pick):
                hits.append((-sum(idf[t] * x[t] * (k1 + 1) / (x[t] + k1 * (1 - b + b * m / mean)) for t in sorted(pick, key=signed) if t in x), i))
        out[qid] = sorted(hits)[:k]
    return out


@pytest.mark.parametrize("options", [{}, {"shard_docs": 60, "query_terms": 8}, {"shard_docs": 20, "first_docs": 25, "broadcast_terms": 0, "block_terms": 150}], ids=["one_shard", "eight_terms", "blocks_of_hashes"])
def test_bm25_against_brute_force(spark, options):
    rng = random.Random(2)
    vocab = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))) for i in range(200)]
    rows += [(1000 + i, "common pair of words") for i in range(150)] + [(3, rows[3][1]), (2000, None), (2001, ""), (None, rows[5][1]), (7, "Common, PAIR!")]
    queries = [(1000, "common pair of words"), (2001, ""), (5, rows[5][1]), (5000, "absent entirely")] + [(i, rows[i][1]) for i in range(0, 200, 20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in search_bm25(d, spark.createDataFrame(queries, "query_id bigint, text string"), **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.doc_id))
    for qid, want in bm25_by_brute_force(rows, queries, most=options.get("query_terms")).items():
        assert [i for _, i in got[qid]] == [i for _, i in want]
        assert np.allclose([s for s, _ in got[qid]], [s for s, _ in want])
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert search_bm25(empty, empty.withColumnRenamed("doc_id", "query_id")).count() == 0


@pytest.mark.parametrize("options", [{}, {"shard_docs": 30, "first_docs": 5}], ids=["one_shard", "shards"])
def test_bm25_of_all_terms(spark, monkeypatch, options):
    from stratavox.llm import queries as Q

    rng = random.Random(6)
    vocab = [f"w{int(rng.paretovariate(0.8))}" for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90)))) for i in range(400)]
    rows += [(i, rows[i - 397][1]) for i in range(400, 403)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(Q, "table", lambda *_: d)
    monkeypatch.setattr(Q, "search_bm25", lambda *a, **b: search_bm25(*a, **b, **options))
    got = defaultdict(list)
    for r in Q.op4_bm25_block_max(spark, "").orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.doc_id))
    for qid, want in bm25_by_brute_force(rows, [r for r in rows if r[0] % 20 == 0], most=None).items():
        assert [i for _, i in got[qid]] == [i for _, i in want]
        assert np.allclose([s for s, _ in got[qid]], [s for s, _ in want])


def shard_of_two_kinds(n=1000, seed=5):
    """Documents of two vocabularies in turn, some equal, with a few words of both."""
    rng = np.random.default_rng(seed)
    rows = [np.unique(np.concatenate([rng.choice(60, 25), rng.choice(900, 4) + 200]) + 60 * (d % 2) * (rng.random(29) < 2)) for d in range(n)]
    rows[40], rows[400] = rows[10], rows[10]
    doc, term = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    return rows, doc, term, rng.random(len(term)) + 0.5


def test_blocks_hold_similar_documents_whatever_their_ids():
    rows, doc, term, worth = shard_of_two_kinds()
    share = np.bincount(term, minlength=2000) / len(rows)
    index = ShardIndex(np.arange(len(rows)), doc, term, worth, 2000, share)
    common = index.place[np.arange(60)]  # of even documents; each block of ids would hold some
    bound = index.block_max[common[common >= 0]].sum(0)
    assert (common >= 0).all() and (bound < bound.max() / 2).sum() >= 3


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_shard_search_against_plain_sums(k):
    rows, doc, term, worth = shard_of_two_kinds()
    worth[np.isin(doc, (40, 400))] = np.tile(worth[doc == 10], 2)
    queries = [*rows[:300], np.array([1999]), np.zeros(0, int), np.arange(0, 1300, 7)]
    cuts, asked = np.concatenate([[0], np.cumsum([len(q) for q in queries])]), np.concatenate(queries)
    index = ShardIndex(np.arange(len(rows)) + 7, doc, term, worth, 2000, np.bincount(asked, minlength=2000) / len(queries))
    sums = np.stack([np.bincount(doc[on := np.isin(term, q)], worth[on], minlength=len(rows)) for q in queries])
    floor = np.sort(sums, axis=1)[:, -min(k, len(rows))]
    for thresholds in (np.full(len(queries), -np.inf), floor, np.where(np.arange(len(queries)) % 2, floor, -np.inf)):
        found = {i: dict(zip(ids.tolist(), scores.tolist(), strict=True)) for i, ids, scores in index.top(cuts, asked, thresholds, k)}
        for i, s in enumerate(sums):
            must = np.flatnonzero((s > 0) & (s >= floor[i] * (1 + 1e-9)))
            got = found.get(i, {})
            assert set((must + 7).tolist()) <= set(got) and all(got[d] == pytest.approx(s[d - 7]) for d in got)
            if thresholds[i] > 0:
                assert all(v >= thresholds[i] * (1 - 1e-9) for v in got.values())
    assert {17, 47, 407} <= set(dict((i, ids.tolist()) for i, ids, _ in index.top(cuts, asked, np.full(len(queries), -np.inf), k))[10])


def test_shard_search_where_no_query_of_a_batch_can_reach():
    rows, doc, term, worth = shard_of_two_kinds()
    cuts, asked = np.concatenate([[0], np.cumsum([len(q) for q in rows])]), np.concatenate(rows)
    index = ShardIndex(np.arange(len(rows)), doc, term, worth, 2000, np.bincount(asked, minlength=2000) / len(rows))
    assert list(index.top(cuts, asked, np.full(len(rows), 1e6), 10)) == []
    floors = np.where(np.arange(len(rows)) == 17, -np.inf, 1e6)
    assert [i for i, _, _ in index.top(cuts, asked, floors, 10)] == [17]
    assert list(index.top(np.zeros(4, int), np.zeros(0, int), np.full(3, -np.inf), 10)) == []


def test_shard_search_without_common_terms():
    n = 500
    index = ShardIndex(np.arange(n), np.arange(n), np.arange(n), np.full(n, 2.0), n, np.full(n, 1 / n))
    assert index.matrix.shape[1] == 0
    found = {i: (ids.tolist(), scores.tolist()) for i, ids, scores in index.top(np.arange(n + 1), np.arange(n), np.full(n, -np.inf), 10)}
    assert found == {i: ([i], [2.0]) for i in range(n)}


def test_prune_keeps_the_nearest_and_spreads():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[5] = x[4]
    kept = robust_prune(x, 0, np.arange(300), 10, 1.2)
    d = ((x - x[0]) ** 2).sum(1)
    assert kept[0] == np.argsort(d)[1] and len(kept) <= 10 and 0 not in kept
    for i, a in enumerate(kept):
        assert all(1.44 * ((x[a] - x[c]) ** 2).sum() > d[a] - 1e-4 for c in kept[:i])
    graph, entry = build_graph(x, 12)
    seen, todo = {entry}, [entry]
    while todo:
        for v in graph[todo.pop()]:
            if v >= 0 and v not in seen:
                seen.add(int(v))
                todo.append(int(v))
    assert len(seen) >= 298 and (graph < 300).all()


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[200:260] = x[200]  # a hot vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[7], (900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [float("inf")] * 16), (None, [1.0] * 16), (905, []), (1000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(0))
    got = defaultdict(list)
    for r in nearest_neighbours(df, F.col("id") % 100 == 0, shard_size=300, blocks_per_group=1, block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    assert set(got) == {i for i in range(0, 900, 100)}
    hit = 0
    exact = x.astype(np.float64)
    for q, near in got.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        want = sorted((float(s), i) for i, s in enumerate(d) if i != q)[:10]
        assert near == sorted(near) and len(near) == 10
        assert all(abs(s - d[i]) < 1e-12 for s, i in near)
        hit += len({i for _, i in near} & {i for _, i in want})
    assert hit / 90 >= 0.9
    assert [i for _, i in got[200]] == list(range(201, 211))
    both = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.9]), (1, [0.0, 3.0]), (2, [0.0, 1.2])], "vec_id bigint, embedding array<float>")
    found = [(r.query_id, r.rank, r.vec_id, round(r.score, 3)) for r in nearest_neighbours(both, F.col("id") < 2).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 2, 0.2), (0, 2, 1, 0.9), (1, 1, 2, 0.7), (1, 2, 0, 0.9)]
    assert nearest_neighbours(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_query_recall_on_the_table(spark):
    from stratavox.llm.queries import op5_pruned_graph_ann

    sf = "/root/testdata/sf0.1"
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(list(x))
    m = np.stack(list(x.values()))
    got = defaultdict(set)
    for r in op5_pruned_graph_ann(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    hit = total = 0
    for q in got:
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        want = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit, total = hit + len(got[q] & set(want)), total + 10
    assert hit / total >= 0.9


# ---------------------------------------------------------------- subwords


@pytest.fixture(scope="module")
def vocab():
    return SW.Vocabulary(tokenizer_file("piece_bpe_32k.model"))


TEXTS = ["", "a", " a  b\n\tx ▁y  ñ日本 😀", "the quick brown fox " * 30, "x" * 500, "\n\n\n", "▁", "word" * 100 + " é", "\u0000 ￿", "    indented    text "]


def best_score(v, text):
    """Full dynamic programme over the whole text."""
    s = " " + text
    best = [0] + [SW.LEAST] * len(s)
    for i in range(len(s)):
        for k in range(1, min(v.longest, len(s) - i) + 1):
            if s[i : i + k] in v.pieces:
                best[i + k] = max(best[i + k], best[i] + v.pieces[s[i : i + k]][1])
        if s[i] not in v.pieces:
            best[i + 1] = max(best[i + 1], best[i] + v.fallback(s[i])[1])
    return best[-1]


def test_streaming_equals_full_viterbi_and_round_trips(vocab):
    rng = random.Random(0)
    of_id = {i: s for i, s in vocab.pieces.values()}
    for t in TEXTS:
        ids = SW.encode(vocab, t)
        assert SW.decode(vocab, ids) == t == "".join(SW.decode_stream(vocab, ids))
        if not t:
            continue
        assert sum(of_id.get(i, -SW.BYTE_COST) for i in ids) == best_score(vocab, t)
        stream, got, at, s = SW.StreamingViterbi(vocab), [], 0, " " + t
        while at < len(s):
            k = rng.randint(1, 40)
            got += stream.push(s[at : at + k])
            at += k
        held = stream.held
        assert got + stream.finish() == ids
        assert held <= SW.WINDOW * vocab.longest


def test_common_words_stay_whole(vocab):
    of_id = {i: p for p, (i, _) in vocab.pieces.items()}
    words = "the here and with from that which world time people".split()
    assert [of_id[i] for i in SW.encode(vocab, " ".join(words))] == [" " + w for w in words]


@pytest.mark.parametrize("text", ["x" * 1_000_000, "ab" * 60_000, "qz7" * 60_000, "日本" * 30_000, "😀" * 20_000, "0123456789abcdef" * 60_000, " " * 200_000], ids=["x", "ab", "qz7", "jp", "emoji", "hex", "spaces"])
def test_very_long_stretches_are_bounded(vocab, text):
    stream = SW.StreamingViterbi(vocab)
    got = stream.push(" " + text) + stream.finish()
    assert stream.held <= SW.WINDOW * vocab.longest
    assert SW.decode(vocab, got) == text and SW.encode(vocab, text) == got
    short = text[:6000]
    of_id = {i: s for i, s in vocab.pieces.values()}
    cost = sum(of_id.get(i, -SW.BYTE_COST) for i in SW.encode(vocab, short))
    assert best_score(vocab, short) >= cost >= best_score(vocab, short) * 1.02  # costs are negative; forced commits lose a piece in 64


def test_encode_and_decode_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1))
    enc = SW.encode_documents(df, tokenizer_file("piece_bpe_32k.model"), check=True)
    assert enc.filter("round_trip").count() == len(rows)
    back = SW.decode_documents(enc, tokenizer_file("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == sorted((i is None, i or 0, t or "") for i, t in rows)
    assert SW.encode_documents(df.limit(0), tokenizer_file("piece_bpe_32k.model")).count() == 0


# ---------------------------------------------------------------- HTML


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Menu</a></ul></nav><div class="wrap">%s<div id="sidebar"><p>side, text, long, more, and more</p></div></div>
<div class="comments"><p>nice, post</p></div><div class="cookie-notice">We use cookies, really, always</div><form><p>Name, mail</p></form>
<footer>&copy; 2024</footer><script>var t="<p>no</p>";</script></body></html>"""


def test_pages_by_hand():
    body = '<div class="content"><h2>A &amp; B</h2><p>One,  two\n three&nbsp;&lt;4&gt;.<br>five <b>six</b>.<div class="ad">Buy</div><ul><li>a<li>b</ul><table><tr><td>x<td>y</table><!-- no --><p>Last</div>'
    assert main_text(PAGE % body) == "A & B\nOne, two three <4>. five six.\na\nb\nx\ny\nLast"
    assert main_text(PAGE % "<article><section><p>Long text, with commas, and more of it.</p></section><section><p>s</p></section></article>") == "Long text, with commas, and more of it.\ns"
    assert main_text("plain, no tags") == "plain, no tags"
    assert main_text("<p>open<p>second <a href='q'>link") == "open\nsecond link"
    assert [main_text(p) for p in (None, "", "   ", "<html></html>", "<!-- never closed", "<script>x", "< 3 >")] == ["", "", "", "", "", "", "< 3 >"]


TEXT = "A long sentence, with commas, that is the article."


@pytest.mark.parametrize(
    "page",
    [
        '<article><p class="ad">Buy<p>%s</p></article>',
        '<ul><li class="share">Share<li>x</ul><article><p>%s</p></article>',
        '<div><p class="promo">Buy</div><article><p>%s</p></article>',
        '<table><tr><td class="ad">Buy<td>%s</table>',
        '<table><tr class="ad"><td>Buy<tr><td>%s</table>',
        "<head><title>t</title><meta x><body><p>%s</p>",
        "<head><title>t</title>%s",
        "<div><button>Send<p>%s</p></div>",
        '<p><span class="ad">Buy<p>%s</p>',
        '<p>%s<span class="ad">Buy</p>',
        '<div class="ad">Buy<article><p>%s</p></article>',
        "<nav><a href=x>Menu</a><article><p>%s</p></article></body></html>",
        '<div><dl><dt class="ad">Buy<dd>%s</dl></div>',
        "<select><option>one<option>two</select><p>%s</p>",
        '<div><span class="ad">x<span>y</span>z</span>%s</div>',
        '<div>%s<script>if (a<b) "</p>"</script></div>',
    ],
)
def test_pruned_elements_without_end_tags(page):
    assert main_text(page % TEXT) in (TEXT, "x\n" + TEXT)


def test_deep_and_long_pages():
    import time

    began = time.time()
    assert main_text("<div>" * 10_000 + f"<p>{TEXT}</p>") == TEXT
    assert main_text("<section><table><tr><td>" + "<div>" * 10_000 + "</section>" * 10_000 + TEXT) == TEXT
    assert main_text(f"<p>{TEXT}</p>" * 3000).count(TEXT) == 3000
    assert main_text("<div class='ad'>" * 5000 + f"<p>{TEXT}</p>") == TEXT
    assert time.time() - began < 5
    one = main_text("<p>a <video><source x></video>b <script>c</script><svg><path d='x'/></svg>d</p>")
    assert one == "a b d"


class Plain(__import__("html.parser", fromlist=["HTMLParser"]).HTMLParser):
    """A plain parser of well-formed pages: the texts of all blocks that are in no pruned element."""

    def __init__(self):
        super().__init__()
        self.open, self.out = [], [""]

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, dict(attrs).get("class") == "ad" or tag in ("nav", "aside", "form")))
        self.out.append("")

    def handle_endtag(self, tag):
        self.open.pop()
        self.out.append("")

    def handle_data(self, data):
        if not any(bad for _, bad in self.open):
            self.out[-1] += data

    def texts(self):
        return [" ".join(t.split()) for t in self.out if t.strip()]


def test_tag_soup_against_a_plain_parser():
    """Optional end tags are left out at random; the text is that of the well-formed page."""
    rng = random.Random(5)

    def tree(depth):
        kind = rng.choice(["p", "ul", "table", "div", "text"] if depth < 4 else ["text", "p"])
        bad = ' class="ad"' if rng.random() < 0.2 else ""
        word = lambda: " ".join(rng.choice(["one", "two,", "three", "four."]) for _ in range(rng.randint(1, 9)))
        if kind == "text":
            return (f"<div>{word()}</div>",) * 2
        if kind == "p":
            t = f"<p{bad}>{word()}"
            return t + "</p>", t
        if kind == "ul":
            items = [f"<li{' class=%sad%s' % (chr(34), chr(34)) if rng.random() < 0.2 else ''}>{word()}" for _ in range(rng.randint(1, 4))]
            return f"<ul{bad}>" + "".join(i + "</li>" for i in items) + "</ul>", f"<ul{bad}>" + "".join(items) + "</ul>"
        if kind == "table":
            cells = [f"<td{' class=%sad%s' % (chr(34), chr(34)) if rng.random() < 0.2 else ''}>{word()}" for _ in range(rng.randint(1, 4))]
            return f"<table{bad}><tr>" + "".join(c + "</td>" for c in cells) + "</tr></table>", f"<table{bad}><tr>" + "".join(cells) + "</table>"
        inner = [tree(depth + 1) for _ in range(rng.randint(1, 4))]
        return f"<div{bad}>" + "".join(a for a, _ in inner) + "</div>", f"<div{bad}>" + "".join(b for _, b in inner) + "</div>"

    for _ in range(400):
        parts = [tree(0) for _ in range(4)]
        whole, soup = ("<article>" + "".join(x[k] for x in parts) + "</article>" for k in (0, 1))
        want = Plain()
        want.feed(whole)
        assert main_text(whole) == main_text(soup) == "\n".join(want.texts())


def test_link_lists_lose_to_text():
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>A long link title, number {i}</a></li>" for i in range(30)) + "</ul></div>"
    assert main_text(f"<body>{links}<div><p>Some words, of text, here.</p><p>And a few more, there.</p></div></body>") == "Some words, of text, here.\nAnd a few more, there."


def test_documents_of_the_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract_html(pages).collect()}
    for r in pages.collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", q))).split()) for q in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "<p>x</p>"), (1, "u", "<p>x</p>")], "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted(r.text for r in extract_html(odd).collect()) == ["", "", "x", "x"]
    assert extract_html(odd.limit(0)).count() == 0


STORY = "".join(f"<p>Words of part {i} of a story, long enough, with commas, to be told from notes and menus of a page.</p>" for i in range(4))


@pytest.mark.parametrize(
    "page",
    [
        '<div id="page" class="site has-sidebar"><article>%s</article></div>', '<div class="layout right-sidebar">%s</div>', '<article class="post comments-open">%s</article>', '<main class="content nav-fixed">%s</main>',
        '<div class="modal-open"><article>%s</article></div>', '<div id="search-page">%s</div>', '<form id="aspnetForm">%s</form>', '<form><div class="right-sidebar"><section>%s</section></div></form>',
        '<div class="modal-open"><h1 hidden>x</h1><div>%s</div><div class="comments"><p>First! And a comment, long, longer, longest, of a reader who, as ever, goes on.</p></div></div>',
        '<div class="has-sidebar"><div>%s</div><div class="sidebar"><p>News, of other things, here.</p></div><form><p>Name, and address, please.</p></form></div>',
        '<div>%s</div><div hidden><p>Hidden, unseen, and long, so long that, were it shown, it would, by its commas, win.</p></div><p style="display: none">no</p>',
    ],
)
def test_words_on_wrappers_do_not_prune_the_article(page):
    got = main_text(f"<html><body>{page % STORY}</body></html>")
    assert [x for x in got.split("\n") if x != "x"] == [f"Words of part {i} of a story, long enough, with commas, to be told from notes and menus of a page." for i in range(4)]


def test_suspects_that_hold_all_text_are_still_no_article():
    for words in ("comments", "cookie-notice", "advert", "newsletter signup"):
        assert main_text(f'<body><div class="{words}">{STORY}</div></body>') == ""


def test_scores_against_a_plain_tree():
    """400 random pages without articles: the scores, siblings and wrappers of main_text() as their definitions say, container by container."""
    rng = random.Random(12)

    def grow(depth):
        words = rng.choice(["", "", "", "sidebar", "comments", "modal-open", "a b", "left rail"])
        kids = [grow(depth - 1) if depth and rng.random() < 0.5 else (rng.choice(["", "x, " * rng.randint(0, 6)]) + "word " * rng.randint(1, 60)).strip() + rng.choice(["", "", "|" + "link words " * rng.randint(1, 9)]) for _ in range(rng.randint(1, 4))]
        return (words, kids)

    def html(n):
        return f'<div class="{n[0]}">' + "".join(html(k) if isinstance(k, tuple) else "<p>" + k.split("|")[0] + ("<a>" + k.split("|")[1] + "</a>" if "|" in k else "") + "</p>" for k in n[1]) + "</div>"

    def text(k):
        return " ".join(k.replace("|", "").split())

    linked = lambda k: len(k.split("|")[1].strip()) if "|" in k else 0
    below = lambda n: [x for k in n[1] for x in (below(k) if isinstance(k, tuple) else [k])]

    def whole(n):
        return sum(len(text(k)) - linked(k) for k in below(n))

    layout, bad = {"sidebar", "modal-open", "left rail"}, {"comments"}

    def prune(n, total):
        return (n[0], [k if isinstance(k, str) else prune(k, total) for k in n[1] if isinstance(k, str) or k[0] not in layout | bad or k[0] in layout and 2 * whole(k) > total])

    def containers(n, path=()):
        yield n, path
        for k in n[1]:
            if isinstance(k, tuple):
                yield from containers(k, (*path, n))

    def points(n):
        return sum(((1 + text(k).count(",") + min(len(text(k)) / 100, 3)) * (1 - linked(k) / len(text(k))) if isinstance(k, str) else points(k) / 2) for k in n[1])

    def dense(n):
        return sum(linked(k) for k in below(n)) / max(sum(len(text(k)) for k in below(n)), 1)

    def score(n):
        return points(n) * (1 - dense(n)) * (0.5 if n[0] in layout else 1)

    found = 0
    for _ in range(400):
        root = ("", [grow(3) for _ in range(rng.randint(1, 3))])
        page = "<html><body>" + "".join(html(k) for k in root[1]) + "</body></html>"
        left = prune(root, whole(root))
        every = list(containers(left))
        if not below(left):
            assert main_text(page) == ""
            continue
        top = max(score(n) for n, _ in every)
        best, path = max((e for e in every if abs(score(e[0]) - top) < 1e-9), key=lambda e: len(e[1]))
        if sum(abs(score(n) - top) < 1e-9 for n, _ in every) > 1:
            continue  # ties are by place
        around = {id(x) for x in (*path, best)}

        def told(n, around=around):
            return [x for k in n[1] for x in ([text(k)] if isinstance(k, str) else told(k) if k[0] not in layout or id(k) in around else [])]

        want = []
        for k in path[-1][1] if path else [best]:
            if k is best:
                want += told(k)
            elif isinstance(k, tuple):
                want += told(k) if k[0] not in layout and score(k) >= max(top * 0.2, 1e-9) else []
            elif len(text(k)) > 80 and linked(k) / len(text(k)) < 0.25:
                want.append(text(k))
        assert main_text(page).split("\n") == want
        found += 1
    assert found > 250
