"""Text operators against brute force, with null, empty, repeated and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.llm import language as LA
from stratavox.llm import packing as PK
from stratavox.llm import pii as PI
from stratavox.llm import quality as QU
from stratavox.llm.near_dedup import drop_near_duplicates, near_duplicate_classes, prob_min_hash
from stratavox.llm.queries import QUERIES, tokenizer_file
from stratavox.llm.substring_dedup import deep_shallow, remove_repeats, repeats_by_brute_force

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _id string, node int, spans string, length int"
#: Names that the operators use inside.
CLASHES = "_text _k1 _k2 _gx _gid _salt _rank _before _score _predicted _n _x _spans c0 c1 _len html_in base found label class_id kept n_bytes bands".split()


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    rows = spark.createDataFrame([(i, t, "en", None, None, 1.0, "x", 3, "y", 4) for i, t in zip(ids, texts, strict=True)], DOCS)
    return rows.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


ODD = [None, "", "   ", "\n", "word", "é" * 300, "a" * 900, "ab " * 400, "x\u0000y", "😀 " * 50]


# ---------------------------------------------------------------- quality


def test_fm_identity_equals_pairwise_sum():
    rng = np.random.default_rng(0)
    fm = QU.FactorisationMachine(0.3, rng.normal(size=QU.DIM).astype(np.float32), rng.normal(size=(QU.DIM, 4)).astype(np.float32))
    rows = [QU.features(t, 5) for t in ("one two two three", "", "A!! B!!")]
    starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])[:-1]])
    got = fm.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
    for (i, x), z in zip(rows, got, strict=True):
        pairs = sum(float(fm.v[i[a]] @ fm.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert np.isclose(z, 0.3 + float((fm.w[i] * x).sum()) + pairs, atol=1e-3)


def test_quality_held_out_accuracy(spark):
    got = QUERIES["op1_quality_fm"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = got.filter("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col("quality")).cast("int").alias("ok")).agg(F.avg("ok"), F.count("*")).first()
    assert r[1] > 50 and r[0] > 0.9
    assert got.filter("held_out").count() == sum(zlib.crc32(str(i.doc_id).encode()) % 5 == 0 for i in got.select("doc_id").collect())


def plain_scores(model, rows):
    """Scores by loops over all pairs of features, a row (text, n_chars) at a time."""
    out = []
    for text, n in rows:
        idx, val = QU.features(text, n)
        vs = [model.v[i].astype(float) * float(x) for i, x in zip(idx, val, strict=True)]
        z = float(model.bias) + sum(float(model.w[i]) * float(x) for i, x in zip(idx, val, strict=True))
        z += sum(float(a @ b) for k, a in enumerate(vs) for b in vs[:k])
        out.append(1 / (1 + np.exp(-min(max(z, -30), 30))))
    return out


def test_quality_query_against_plain_loops(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = QU.fit_quality(d.select("doc_id", "text", "n_chars"), labels)
    rows = {r.doc_id: (r.text, r.n_chars) for r in d.filter("length(text) < 1500").collect()}
    got = {r.doc_id: r for r in QUERIES["op1_quality_fm"](spark, SF).collect()}
    assert len(got) == d.count()
    for i, want in zip(rows, plain_scores(model, rows.values()), strict=True):
        assert abs(got[i].score - want) < 1e-4 and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert abs(want - 0.3) < 1e-4 or got[i].predicted == (want >= 0.3)


def test_quality_of_odd_rows(spark):
    d = docs(spark, ODD, [None, *range(len(ODD) - 1)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = QU.fit_quality(d, none)
    out = QU.score_quality(d, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert QU.score_quality(d.limit(0), model).count() == 0
    assert QU.score_quality(d, model, out=("score", "_score")).columns == [c for c in d.columns if c not in ("score", "_score")] + ["score", "_score"]
    one_class = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    assert all(r.predicted == 1 for r in QU.score_quality(d, QU.fit_quality(d, one_class), keep=("doc_id",)).collect())


# ---------------------------------------------------------------- exact substrings


def fragments(n, seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(400)) for _ in range(6)]
    out = []
    for _ in range(n):
        t = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, 300)
            t += rng.choice(base)[i : i + rng.randint(5, 120)] + rng.choice(["", "x", "yy"])
        out.append(t)
    return out


@pytest.mark.parametrize("options", [{}, {"hot_runs": 3}, {"hot_runs": 2, "levels": 0}, {"broadcast_rows": 0}], ids=["sorted", "split", "split_to_windows", "shuffled"])
def test_substrings_against_brute_force(spark, options):
    texts = fragments(90) + ODD
    texts += [texts[0], texts[0]]
    d = docs(spark, texts, [*range(len(texts) - 2), 0, None])
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(d, width=40, gram=12, **options).collect())
    assert got == sorted(repeats_by_brute_force(texts, 40))


def test_substring_edges(spark):
    assert remove_repeats(docs(spark, [])).count() == 0
    two = docs(spark, ["p" + "q" * 199, "p" + "q" * 199 + "é"], [1, 1])
    rows = remove_repeats(two, keep=("lang",), as_text=True).orderBy("n_bytes").collect()
    assert [(r.n_removed, r.kept, r.lang) for r in rows] == [(200, "", "en"), (200, "é", "en")]
    assert {r.n_removed for r in remove_repeats(docs(spark, ["z" * 199, "z" * 199])).collect()} == {0}


def test_deep_shallow_groups():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab") for _ in range(50)) * 3 + bytes(rng.choice(b"abc") for _ in range(300))
    data = data + b"c" * 60 + data[100:260]
    for shallow in (8, 16, 40):
        got = {tuple(sorted(g.tolist())) for g in deep_shallow(data, np.arange(len(data) - 40), 40, shallow)}
        want = defaultdict(list)
        for i in range(len(data) - 40):
            want[data[i : i + 40]].append(i)
        assert got == {tuple(v) for v in want.values() if len(v) > 1}


# ---------------------------------------------------------------- near duplicates


def classes_by_brute_force(texts, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    part = list(range(len(texts)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) / len(a | b) >= least:
                part[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def edited(n, seed=2, words=120, most=4):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 5) + str(rng.randint(0, 999)) for _ in range(words)]
    out = []
    for _ in range(n):
        b = list(base)
        for _ in range(rng.randint(1, most)):
            b[rng.randrange(words)] = str(rng.random())
        out.append(" ".join(b))
    return out


def test_near_duplicates_against_brute_force(spark):
    texts = edited(60) + edited(25, 9, 40, 2) + ["one two", "one two", "one  two", "lone words here"] + [None, "", "  "]
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicate_classes(docs(spark, texts)).collect()}
    want = classes_by_brute_force(texts)
    sizes = Counter(want)
    assert got == {i: (c, sizes[c]) for i, c in enumerate(want)}


def test_classes_do_not_depend_on_partitions(spark):
    texts = edited(70, 11, 60, 3) + edited(30, 12, 200, 20)
    found = []
    for n in (1, 3, 17):
        d = docs(spark, texts).repartition(n, F.rand(n))
        found.append({r.doc_id: r.class_id for r in near_duplicate_classes(d, window=4, block=8, chunk=5).collect()})
    assert found[0] == found[1] == found[2]


def test_skewed_counts_do_not_matter(spark):
    texts = ["a " * 50 + "b " * 5 + "a " * 5, "a " * 5 + "b " * 50 + "a " * 5 + "c"]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) > 0.8
    assert len({r.class_id for r in near_duplicate_classes(docs(spark, texts)).collect()}) == 1


def test_large_buckets_keep_their_links(spark):
    texts = edited(120, 5, 200, 2)  # nearly all similar: buckets above the window of 8
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(docs(spark, texts), window=8, block=16).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_brute_force(texts)


def test_large_buckets_find_what_their_windows_miss(spark):
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(400)]
    texts = [" ".join(base)]
    for _ in range(150):  # each at about 0.83 of the base and less of one another: a star
        b = list(base)
        for i in rng.sample(range(0, 400, 5), 7):
            b[i] = str(rng.random())
        texts.append(" ".join(b))
    want = classes_by_brute_force(texts)
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(docs(spark, texts), window=2, block=8, chunk=10).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 1


def test_repeated_lines_do_not_hide_near_duplicates(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        words = [str(rng.random()) for _ in range(500)]
        texts += [" ".join(words), " ".join(words + words[:24] * 300)]
    want = classes_by_brute_force(texts)
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 6


def test_one_of_each_class_stays(spark):
    texts = [*edited(10, 4), "alone in here", None, "", "alone in here"]
    kept = drop_near_duplicates(docs(spark, texts, [*range(12), 12, 10])).collect()
    assert len([r for r in kept if r.text == "alone in here"]) == 1 and len(kept) == len(set(classes_by_brute_force(texts[:11]))) + 2
    assert set(kept[0].asDict()) == set(docs(spark, []).columns)
    assert drop_near_duplicates(docs(spark, [])).count() == 0
    assert near_duplicate_classes(docs(spark, ["a b", None], [None, None])).count() == 2


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(7)
    ids = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    of_a, of_b = dict(zip(ids[:300].tolist(), a, strict=True)), dict(zip(ids[100:].tolist(), b, strict=True))
    both = of_a.keys() & of_b.keys()
    want = sum(1 / sum(max(of_a.get(e, 0) / of_a[d], of_b.get(e, 0) / of_b[d]) for e in of_a.keys() | of_b.keys()) for d in both)
    m = 4000
    sig = prob_min_hash(np.repeat([0, 1], 300), np.concatenate([ids[:300], ids[100:]]), np.concatenate([a, b]), 2, m)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


# ---------------------------------------------------------------- language


def test_automaton_accepts_exactly_the_substrings():
    text = "abcbcabab"
    trans = LA.suffix_automaton([ord(c) for c in text])
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def accepts(s):
        state = 0
        for c in s:
            if ord(c) not in trans[state]:
                return False
            state = trans[state][ord(c)]
        return True

    rng = random.Random(0)
    tries = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(500)} | subs
    assert {s for s in tries if accepts(s)} == {s for s in tries if s in subs}


def test_phrases_against_plain_parsing():
    samples = {"x": "the cat sat on the mat and ran", "y": "der hund sitzt auf dem dach"}
    model = LA.CrossParser.fit(samples)
    texts = ["the hund sat", "qqq", "mat and ran on the dach", "a"]

    def count(sample, text, block=10**6):
        if len(text) > block:
            return sum(count(sample, text[s : s + block]) for s in range(0, len(text), block))
        i = n = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in sample and text[i] in sample:
                k += 1
            n, i = n + 1, i + k
        return n

    whole = "the cat sat on the mat and ran " * 200
    assert abs(int(model.phrases([whole])[0][0]) - count(samples["x"], whole, 2048)) <= 4  # in the blocks of the query
    got = model.phrases(texts, block=10**6)
    unseen = [sum(c not in samples["x"] for c in t) for t in texts]
    for t, row, u in zip(texts, got, unseen, strict=True):
        assert abs(int(row[0]) - count(samples["x"], t)) <= u + 1
        assert abs(int(row[1]) - count(samples["y"], t)) <= sum(c not in samples["y"] for c in t) + 1


def test_language_query_against_plain_parsing(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 900").limit(60).collect()
    picked = {}
    real = LA.CrossParser.fit

    def keep(samples):
        picked.update(samples)
        return real(samples)

    LA.CrossParser.fit = keep
    try:
        got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, SF).collect()}
    finally:
        LA.CrossParser.fit = real
    assert len(got) == d.count() and len(picked) >= 2
    for r in rows:
        text = LA.normalise(r.text)
        costs = {}
        for lang, sample in picked.items():
            n, cur = 1, ""
            for c in text:
                if cur + c in sample:
                    cur += c
                else:
                    n, cur = n + 1, c if c in sample else ""
            costs[lang] = n * np.log2(max(len(sample), 2))
        low = sorted(costs.values())
        assert got[r.doc_id].lang_pred == (min(sorted(costs), key=costs.get) if text else "und")
        assert not text or abs(got[r.doc_id].score - low[1] / (low[0] + low[1])) < 1e-9


def test_language_held_out(spark):
    got = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = got.filter("held_out").join(d, "doc_id").filter("n_chars > 100").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()
    assert r[0] > 0.97
    odd = docs(spark, [*ODD, "123 --", "the word"], [None] * (len(ODD) + 2))
    out = LA.identify_language(odd, LA.fit_languages(d.limit(0))).collect()
    assert {r.lang_pred for r in out} == {"und"} and len(out) == len(ODD) + 2
    model = LA.fit_languages(d)
    assert model.predict(["½ ²", "①", "Ⅷ٣", "12 ½ der", None])[0][:3] == ["und"] * 3 and model.predict(["½ der"])[0] != ["und"]
    out = {r.score for r in LA.identify_language(odd, LA.fit_languages(d)).filter("lang_pred = 'und'").collect()}
    assert out == {0.0}


# ---------------------------------------------------------------- packing


def test_plan_is_valid_and_tight():
    rng = random.Random(1)
    for _ in range(120):
        cap = rng.choice([10, 30, 100])
        h = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 300)))
        bins, seen = defaultdict(list), Counter()
        for n, a, b, first, per, off in PK.plan_bins(dict(h), cap):
            for r in range(a, b):
                bins[first + (r - a) // per].append((off + (r - a) % per * n, n))
                seen[n, r] += 1
        assert seen == Counter({(n, r): 1 for n, c in h.items() for r in range(c)})
        for items in bins.values():
            end = 0
            for o, n in sorted(items):
                assert o == end
                end += n
            assert end <= cap and sum(3 * n > cap for _, n in items) <= 2
        total = sum(n * c for n, c in h.items())
        assert len(bins) <= max(-(-total // cap), sum(c for n, c in h.items() if 2 * n > cap)) * 1.25 + 2


def test_packing_pieces(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    long = " ".join(f"w{i}" for i in range(1500))
    texts = [*ODD, "plain text", "plain text", "an <|endoftext|> here", " " * 5000, long]
    d = docs(spark, texts, [*range(len(texts) - 1), None])
    pieces = PK.tokenize_pieces(d, tokenizer_file())
    by = defaultdict(list)
    for r in pieces.collect():
        by[r.doc_id].append(r)
    for i, t in zip([*range(len(texts) - 1), None], texts, strict=True):
        ids = (tok.encode(t, add_special_tokens=False).ids if t else []) + [2]
        rows = sorted(by[i], key=lambda r: r.piece)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4").tolist() == ids
        assert all(r.length == 1024 for r in rows[1:]) and rows[0].length <= 1024
        assert [r.start for r in rows] == np.cumsum([0, *[r.length for r in rows[:-1]]]).tolist()
    packed = PK.assign_sequences(pieces).collect()
    assert len(packed) == pieces.count()
    seqs = defaultdict(list)
    for r in packed:
        seqs[r.sequence_id].append((r.offset, r.length))
    for items in seqs.values():
        items.sort()
        assert [o for o, _ in items] == np.cumsum([0, *[n for _, n in items[:-1]]]).tolist() and sum(n for _, n in items) <= 1024
    assert PK.assign_sequences(PK.tokenize_pieces(docs(spark, []), tokenizer_file())).count() == 0
    rng = random.Random(2)
    quick, plain = PK.ByteBpe(tokenizer_file()), PK.ByteBpe(tokenizer_file(), fast=False)
    for _ in range(500):
        t = "".join(rng.choice(["the", " ", "é", "日本", "\n", "12", "'ll", "<|endoftext|>", "x" * 40, "\t", "😀", "!?"]) for _ in range(rng.randint(0, 12)))
        assert quick.encode(t) == plain.encode(t)
    own = pieces.withColumns({c: F.lit("clash") for c in CLASHES})
    assert PK.assign_sequences(own, salt_rows=3).columns == [*own.columns, "sequence_id", "offset"]
    same = lambda df: sorted((r.sequence_id, r.offset, r.length) for r in df.collect())
    assert same(PK.assign_sequences(own, salt_rows=3)) == same(PK.assign_sequences(pieces))


# ---------------------------------------------------------------- personal data


def plain_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], ("email", "ip", "card", "phone").index(s[2])))


def test_seed_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", "x@y.", "q@@r.com", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-1234", "+12", "é", " ", "-", "%", "a@b.c@d.e", "12-34", "９", ".", "m@n.o-", "4111-1111-1111-1111 22"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        assert PI.base_spans(t) == plain_spans(t), t


def pii_by_brute_force(texts, rounds=2, least=5, sure=0.8):
    """The whole graph in dictionaries; spans per text."""
    scans = [PI.places_of(t) for t in texts]
    edge = {}
    for _, places in scans:
        for p in places:
            for x in p["patterns"]:
                for k in [p["kind"]] if p["kind"] else p["fits"]:
                    edge[x, p["value"], k] = edge.get((x, p["value"], k), False) or p["kind"] is not None
    score = {e: float(seed) for e, seed in edge.items()}
    weight = defaultdict(lambda: 0.5)
    for (x, v, _), seed in edge.items():
        weight[x, v] = max(weight[x, v], 1.0 if seed else 0.5)
    around = Counter()
    for (x, _), w in weight.items():
        around[x] += w
    for _ in range(rounds):
        mass, support = Counter(), Counter()
        for (x, v, k), s in score.items():
            seed = edge[x, v, k]
            mass[x, k] += s * (1.0 if seed else 0.5)
            support[x, k] += s >= 0.5
        good = {xk: m / (around[xk[0]] + 1) for xk, m in mass.items() if support[xk] >= least and m / (around[xk[0]] + 1) >= sure}
        miss = defaultdict(lambda: 1.0)
        for x, v, k in edge:
            if (x, k) in good:
                miss[v, k] *= max(1 - good[x, k], 1e-6)
        score = {(x, v, k): 1.0 if seed else 1 - miss[v, k] for (x, v, k), seed in edge.items()}
    out = []
    for spans, places in scans:
        found = [(good[x, k], p["start"], p["end"], k) for p in places if not p["kind"] for k in p["fits"] for x in p["patterns"] if (x, k) in good]
        out.append(",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans + PI.choose(found), key=lambda s: (s[0], PI.KINDS.index(s[2]), s[1]))))
    return out


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(0)
    filler = ["alpha", "beta", "gamma", "delta", "omega"]
    words = lambda: " ".join(rng.choice(filler) for _ in range(4))
    texts = [f"{words()} please call me at +1 (5{i:02d}) 555-12{i:02d} now {words()}" for i in range(24)]
    texts += [f"{words()} please call me at 555-01{i:02d}-99 now {words()}" for i in range(2)] + [f"{words()} order 555-01{i:02d}-77 shipped" for i in range(3)]
    texts += [f"{words()} please call me at 555 123 4567 now", "see +1 (555) 555-0199 10.0.0.1 there", "+1 (555) 555-0198 4111111111111111", *ODD]
    got = {r.doc_id: r for r in PI.find_pii(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    want = pii_by_brute_force(texts)
    for i, t in enumerate(texts):
        assert got[i].base == ",".join(f"{k}:{s}:{e}" for s, e, k in plain_spans(t or ""))
        assert got[i].spans == want[i]
    for i in (24, 25):
        at = texts[i].index("555-")
        assert got[i].spans == f"phone:{at}:{at + 11}"
    assert all(got[i].spans == "" for i in (26, 27, 28))
    at = texts[29].index("555")
    assert got[29].spans == f"phone:{at}:{at + 12}" and got[30].spans == "phone:4:21,ip:22:30" and got[31].spans.startswith("phone:0:17")
    red = {r.doc_id: r.text for r in PI.redact_pii(docs(spark, texts)).collect()}
    assert "call me at [phone] now" in red[0] and "[phone]" in red[24] and red[26] == texts[26] and red[32] is None
    assert PI.find_pii(docs(spark, [])).count() == 0
    assert PI.find_pii(docs(spark, ["mail a@b.cd", "mail a@b.cd"], [None, None])).filter("spans = 'email:5:11'").count() == 2
    own = docs(spark, texts)
    back = PI.redact_pii(own)
    assert back.columns == own.columns and {tuple(r[c] for c in CLASHES) for r in back.collect()} == {("clash",) * len(CLASHES)}


def test_pii_query_against_brute_force_with_added_spans(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rng = random.Random(9)
    planted = [f"word the {'+1 (%03d) 555-%04d' % (rng.randrange(1000), rng.randrange(10000))} 10.{i}.7.9 of" for i in range(4)]
    texts = [t for _, t in rows] + planted
    got = {r.doc_id: r for r in PI.find_pii(docs(spark, texts)).collect()}
    want = pii_by_brute_force(texts)
    assert [got[i].spans for i in range(len(texts))] == want
    # every planted number that the grammars lose is found by its shape, and nothing else there
    assert all(got[i].spans.count("phone:9:26") == 1 and got[i].spans.count(":") == 4 for i in range(len(rows), len(texts)))


def test_pii_query_counts_base_spans_and_lists_all(spark, tmp_path):
    texts = [f"please call me at +1 (5{i:02d}) 555-12{i:02d} now" for i in range(24)] + ["please call me at 555-01-99 now", None, "a@b.cd 10.0.0.1"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_pii"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        assert [got[i][f"n_{k}"] for k in PI.KINDS] == [sum(kind == k for *_, kind in base) for k in PI.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
    assert got[24].n_phone == 0 and got[24].spans.startswith("phone:18:")


def test_pii_of_very_long_odd_texts():
    import time

    began = time.time()
    for t in ("1" * 1_000_000, "@" * 1_000_000, "1234a" * 200_000, "12 34-" * 160_000, "1." * 500_000, "a@b." * 250_000, "+1 " * 300_000, "x " + "0" * 5000 + ".1.1.1", "(" * 1_000_000, "1 " * 400_000):
        spans, _ = PI.places_of(t)
    assert spans == [] and PI.base_spans("x " + "0" * 5000 + ".1.1.1 ") == [(2, 5008, "ip")]
    assert time.time() - began < 60


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_dedup", "substring_dedup", "pii", "packing"]
    for k, (name, step) in enumerate(P.STAGES):
        out = step(spark, d, SF)
        if k < len(P.STAGES) - 1:
            assert out.columns == d.columns and [t for _, t in out.dtypes] == [t for _, t in d.dtypes]
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = {r.doc_id: r.text for r in d.collect()}
        if name == "quality":
            model = QU.fit_quality(d, spark.read.parquet(f"{SF}/labels.parquet"))
            short = [r for r in d.collect() if len(r.text or "") < 1500]
            kept = {r.doc_id for r in out.collect()}
            for r, s in zip(short, plain_scores(model, [(r.text, r.n_chars) for r in short]), strict=True):
                assert abs(s - 0.3) < 1e-4 or (r.doc_id in kept) == (s >= 0.3)
        if name == "packing":
            from tokenizers import Tokenizer

            tok, by = Tokenizer.from_file(tokenizer_file()), defaultdict(list)
            for r in out.collect():
                by[r.doc_id].append(r)
            assert by.keys() == before.keys()
            for i, found in by.items():
                found.sort(key=lambda r: r.piece)
                assert np.frombuffer(b"".join(bytes(r.ids) for r in found), "<u4").tolist() == tok.encode(before[i], add_special_tokens=False).ids + [2]
        if name in ("quality", "near_dedup"):
            assert all(before[r.doc_id] == r.text for r in out.collect()) and 0 < out.count() < len(before)
        if name == "near_dedup":
            ids = sorted(before)
            roots = classes_by_brute_force([before[i] for i in ids])
            assert {r.doc_id for r in out.collect()} == {ids[c] for c in set(roots)}
        if name == "substring_dedup":
            want = [w[3] for w in repeats_by_brute_force([before[i] for i in sorted(before)], 200)]
            got = {r.doc_id: r.text for r in out.collect()}
            same = sum(hashlib.sha256(got[i].encode()).hexdigest() == w for i, w in zip(sorted(before), want, strict=True))
            assert len(got) == len(want) and same >= len(want) - 2  # cuts inside a character leave out its bytes
        if name == "pii":
            got = {r.doc_id: r.text for r in out.collect()}
            ids = sorted(before)
            assert [got[i] for i in ids] == [PI.redact(before[i], s) for i, s in zip(ids, pii_by_brute_force([before[i] for i in ids]), strict=True)]
        d = out
    assert d.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_language_of_long_texts_only(spark):
    """40 English texts of 6400 characters and 40 short German ones: both are learned, by windows of the long ones."""
    rng = random.Random(3)
    english, german = "the cat sat on the mat and ran with dogs over hills".split(), "der hund sitzt auf dem dach und läuft mit katzen über hügel".split()
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(english, 1600), "en") for i in range(40)] + [(100 + i, text(german, 60), "de") for i in range(40)] + [(700, "x y z " * 50, "once")] * 300
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert min(len(t) for _, t, la in rows if la == "en") > 4000
    model = LA.fit_languages(d, folds=1, held_out=5)
    assert model.langs == ["de", "en", "once"]  # the last has one id, above its threshold
    got = {r.doc_id: r.lang_pred for r in LA.identify_language(d, model).collect()}
    assert all(got[i] == la for i, _, la in rows)


def test_rare_characters_are_looked_up_alike_and_tables_stay_small():
    rng = random.Random(4)
    samples = {f"l{k}": "".join(chr(0x4E00 + rng.randrange(k * 300, k * 300 + 3000)) if rng.random() < 0.9 else " " for _ in range(8000)) for k in range(8)}
    small = LA.CrossParser.fit(samples, dense_bytes=1 << 20)
    size = lambda m: m.table.nbytes + m.keys.nbytes + m.to.nbytes
    assert len(small.alphabet) > 3000 and size(small) < 8 << 20
    assert size(LA.CrossParser.fit(samples)) < 100 << 20
    few = {"a": "the cat sat on the mat " * 3, "b": "der hund saß auf dem dach " * 3}
    dense, sparse = LA.CrossParser.fit(few), LA.CrossParser.fit(few, dense_bytes=1)
    assert sparse.width == 2 and not len(dense.keys)
    texts = ["the cat saß auf", "mat dach qqq", "", "ß", *samples.values()]
    assert (dense.phrases(texts) == sparse.phrases(texts)).all()
    whole = list(samples.values())
    assert (small.phrases(whole).argmin(1) == np.arange(8)).all()


def test_quality_learns_from_long_texts(spark):
    rows = [(i, ("good words here " if i % 2 else "bad junk there ") * 5000, 75_000) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id bigint, quality int, toxic int")
    fit = QU.fit_quality(d, labels, folds=1, held_out=5)
    got = {r.doc_id: r.score for r in QU.score_quality(d, fit).collect()}
    assert min(s for i, s in got.items() if i % 2) > max(s for i, s in got.items() if i % 2 == 0) + 0.1
    one = QU.fit_quality(d, labels, folds=1, held_out=5, max_features=1)  # one row: the prior
    assert not one.w.any()
