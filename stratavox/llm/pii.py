"""PII by bootstrapped contextual extraction.

Seeds are entities of four plain grammars (email, ip, card, phone). Their surroundings become lexical patterns: words before and
after, digits as a wildcard, and the shape of the entity itself. Patterns and identifier-like strings form a bipartite graph that
Spark scores in rounds (pattern confidence from the scores of what it surrounds, instance score from the patterns around it).
Confident patterns then add unseen identifiers as spans: those the grammars miss because they are written otherwise, or because
they run into a neighbour ("+1 (555) 555-0100 10.0.0.1" is too long for a phone, but its shape is a phone's).
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.common import column, map_batches, stage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Digits with the separators of the grammars between them.
_NUMBERS = re.compile(r"[+(]{0,2}[0-9]+(?:[\x20().-]{1,3}[0-9]+)*")
_WORDISH = _LOCAL | frozenset("@")
#: Words of a number that are looked at together.
TOKENS = 4


def _luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _byte(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches, found from each @ outwards so that plain words cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """Seed spans (start, end, kind) in code points, by start, then in the order of KINDS."""
    if not text:
        return []
    out = _emails(text)
    for m in _DOTS.finditer(text):
        if m[0].count(".") >= 3:  # matches take four parts each, from the left
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(_byte(p) for p in four):
                    out.append((at, end, "ip"))
                at = end + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, list[str]]]:
    """Identifier-like strings outside the seed spans, with the kinds each could be: runs of letters, digits and marks around an @;
    one to TOKENS words of digits with separators. They may overlap. The time is linear in the text."""
    taken = [(s, e) for s, e, _ in spans]
    at, last = text.find("@"), 0
    while at >= 0:
        s, e = at, at + 1
        while s > last and text[s - 1] in _WORDISH:
            s -= 1
        while e < len(text) and text[e] in _WORDISH:
            e += 1
        last = e
        while e > s and text[e - 1] in ".-%":
            e -= 1
        if s < text.find("@", s) < e - 1 and not _meets(taken, s, e):
            yield s, e, ["email"]
        at = text.find("@", last)
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        start = m.start()
        for s, e in [*_within(taken, m.start(), m.end()), (m.end(), m.end())]:
            words = [w.span() for w in _WORD.finditer(text, start, max(start, s))]
            start = max(start, e)
            for i in range(len(words)):
                digits = 0
                for j in range(i, min(i + TOKENS, len(words))):
                    digits += sum(c in _TEN for c in text[words[j][0] : words[j][1]]) if words[j][1] - words[j][0] < 40 else 40
                    if digits > 19:
                        break
                    s1, e1 = words[i][0], words[j][1]
                    while e1 > s1 and text[e1 - 1] not in _TEN:
                        e1 -= 1
                    while s1 < e1 and text[s1] in ".-)":
                        s1 += 1
                    if digits >= 4 and not (s1 and text[s1 - 1].isalnum()) and not text[e1 : e1 + 1].isalnum():
                        fits = [k for k in KINDS[1:] if _shape(k, text[s1:e1], digits)]
                        if fits:
                            yield s1, e1, fits


_TEN = frozenset("0123456789")
_WORD = re.compile(r"[^\x20]+")


def _within(spans: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Those of the spans, sorted by start, that meet start..end. Of one kind they do not overlap, so a few steps back suffice."""
    k = bisect.bisect_left(spans, (start, start))
    out = [x for x in spans[max(0, k - len(KINDS)) : k] if x[1] > start]
    while k < len(spans) and spans[k][0] < end:
        out.append(spans[k])
        k += 1
    return out


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    return bool(_within(spans, start, end))


def _shape(kind: str, s: str, digits: int) -> bool:
    """Whether an unseen string of digits and separators could be of the kind at all."""
    if kind == "ip":
        return s.count(".") == 3 and all(p.isdecimal() and p.isascii() and _byte(p) for p in s.split("."))
    if kind == "card":
        return 12 <= digits <= 19 and not set(s) - _TEN - {" ", "-"} and _luhn("".join(c for c in s if c in _TEN))
    return 7 <= digits <= 15 and s.count("(") == s.count(")") and s.count("+") == (s[0] == "+")


_DIGITS = re.compile("[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: its shape with digits kept apart and with runs of them as one, two words before, one before and
    one after, one before, one after. Digits in words are a wildcard. Windows of 80 characters hold the words."""
    value = _LETTERS.sub("a", text[start:end])
    found = ["S " + _DIGITS.sub(lambda m: "9" * len(m[0]), value), "R " + _DIGITS.sub("#", value)]
    left = _DIGITS.sub("#", text[max(0, start - 80) : start].lower()).split()
    right = _DIGITS.sub("#", text[end : end + 80].lower()).split()
    if len(left) > 1:
        found.append("L " + " ".join(left[-2:]))
    if left and right:
        found.append(f"M {left[-1]} _ {right[0]}")
    if left:
        found.append("B " + left[-1])
    if right:
        found.append("A " + right[0])
    return found


def _text_of(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_FOUND = "array<struct<kind:string,start:int,end:int,value:string,fits:array<string>,patterns:array<string>>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("fits", pa.list_(pa.string())), ("patterns", pa.list_(pa.string()))]))


def places_of(text: str | None) -> tuple[list[tuple[int, int, str]], list[dict]]:
    """The seed spans of a text and, for the graph, every seed and every other identifier-like string with its patterns."""
    spans = base_spans(text)
    places = [{"kind": k, "start": s, "end": e, "value": text[s:e], "fits": [], "patterns": patterns_of(text, s, e)} for s, e, k in spans]
    for s, e, fits in candidates(text or "", spans):
        places.append({"kind": None, "start": s, "end": e, "value": text[s:e], "fits": fits, "patterns": patterns_of(text, s, e)})
    return spans, places


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_k1"), F.xxhash64(F.col(text_col), F.col(id_col), F.lit(7)).alias("_k2"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        both = [places_of(text) for text in column(b, "_text")]
        return pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array([_text_of(s) for s, _ in both], pa.string()), pa.array([p for _, p in both], _FOUND_TYPE)], names=["_id", "_k1", "_k2", "base", "found"])

    return map_batches(rows, f"_id {id_type}, _k1 bigint, _k2 bigint, base string, found {_FOUND}", run)


def score_graph(places: DataFrame, rounds: int, min_support: int, min_confidence: float) -> DataFrame:
    """Scores patterns and instances in turn over distinct (pattern, value, kind) edges; returns accepted (pattern, kind, confidence).

    An edge joins a pattern with a value for each kind the value could be. Seeds keep score 1 for their own kind, all other
    values start at 0 and count half, as nothing is known of them. The support of a pattern for a kind are its values of score 0.5
    or more; its confidence is the summed score over one more than all distinct values it surrounds, so that little support
    counts for less.
    """
    edges = places.select("value", F.explode("patterns").alias("pattern"), F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(F.col("fits")).alias("kinds"), F.col("kind").isNotNull().alias("seed"))
    edges = edges.select("pattern", "value", F.explode("kinds").alias("kind"), "seed").groupBy("pattern", "value", "kind").agg(F.max("seed").alias("seed"))
    edges = stage(edges.withColumn("score", F.col("seed").cast("double")))
    counts = lambda seed: F.when(seed, 1.0).otherwise(0.5)
    total = stage(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")).groupBy("pattern").agg(F.sum(counts(F.col("seed"))).alias("total")))
    patterns = None
    for k in range(rounds):
        patterns = edges.groupBy("pattern", "kind").agg(F.sum(F.col("score") * counts(F.col("seed"))).alias("mass"), F.count_if(F.col("score") >= 0.5).alias("support")).filter(F.col("support") >= min_support)
        patterns = patterns.join(total, "pattern").withColumn("confidence", F.col("mass") / (F.col("total") + 1)).filter(F.col("confidence") >= min_confidence)
        patterns = stage(patterns.select("pattern", "kind", "confidence"))
        if k < rounds - 1:
            lift = edges.join(patterns, ["pattern", "kind"])
            lift = lift.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("lifted"))
            edges = stage(edges.join(lift, ["value", "kind"], "left").select("pattern", "value", "kind", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("lifted", F.lit(0.0))).alias("score")))
    return patterns


def choose(found: list[tuple[float, int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping (confidence, start, end, kind) the most confident counts, then the longest, the first, and the first kind."""
    kept: list[tuple[int, int]] = []
    out = []
    for _, s, e, k in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], KINDS.index(x[3]))):
        at = bisect.bisect_left(kept, (s, e))
        if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or kept[at][0] >= e):
            kept.insert(at, (s, e))
            out.append((s, e, k))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, min_support: int = 5, min_confidence: float = 0.8) -> DataFrame:
    """One row per input row: id, base (seed spans as kind:start:end, comma-joined) and spans (seeds and added ones).

    Null and empty texts have no spans. Rows with equal id and text get equal results. An added span never overlaps a seed
    or another added span of its row; choose() says which counts.
    """
    return _find(docs, id_col, text_col, rounds, min_support, min_confidence).select(F.col("_id").alias(id_col), "base", "spans")


def _find(docs: DataFrame, id_col: str, text_col: str, rounds: int, min_support: int, min_confidence: float) -> DataFrame:
    scanned = stage(_scan(docs, id_col, text_col))
    places = scanned.filter(F.size("found") > 0).select("_k1", "_k2", F.explode("found").alias("p")).select("_k1", "_k2", "p.*")
    patterns = score_graph(places, rounds, min_support, min_confidence)
    fresh = places.filter(F.col("kind").isNull()).select("_k1", "_k2", "start", "end", F.explode("fits").alias("kind"), "patterns")
    fresh = fresh.select("_k1", "_k2", "start", "end", "kind", F.explode("patterns").alias("pattern")).join(patterns, ["pattern", "kind"])
    added = fresh.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("confidence", "start", "end", "kind")).alias("more"))
    out = scanned.select("_id", "_k1", "_k2", "base").join(added, ["_k1", "_k2"], "left").select("_id", "_k1", "_k2", "base", "more")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for base, more in zip(column(b, "base"), column(b, "more"), strict=True):
            if more:
                seeds = [(int(s), int(e), k) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                new = choose([(x["confidence"], x["start"], x["end"], x["kind"]) for x in more])
                base = _text_of(sorted(seeds + new, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))
            spans.append(base)
        return pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(spans, pa.string())], names=["_id", "_k1", "_k2", "base", "spans"])

    id_type = out.schema["_id"].dataType.simpleString()
    return map_batches(out, f"_id {id_type}, _k1 bigint, _k2 bigint, base string, spans string", run)


def redact(text: str | None, spans: str) -> str | None:
    """The text with each span replaced by its kind in square brackets; of overlapping spans the first counts."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans.split(","):
        kind, start, end = s.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
            at = int(end)
        elif int(end) > at:
            at = int(end)
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, min_support: int = 5, min_confidence: float = 0.8, broadcast_rows: int = 500_000) -> DataFrame:
    """docs, all rows and columns, with every span of find_pii() replaced in the text. Texts without spans pass unchanged."""
    spans = stage(_find(docs, id_col, text_col, rounds, min_support, min_confidence).filter("spans <> ''").select("_k1", "_k2", F.col("spans").alias("_spans")).dropDuplicates(["_k1", "_k2"]))
    spans = F.broadcast(spans) if spans.count() <= broadcast_rows else spans
    names, fields = docs.columns, docs.schema.fields
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the columns are called
    key, at = F.col(f"c{names.index(id_col)}"), names.index(text_col)
    rows = rows.withColumns({"_k1": F.xxhash64(key, F.col(f"c{at}")), "_k2": F.xxhash64(F.col(f"c{at}"), key, F.lit(7))}).join(spans, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [redact(t, s) if s else t for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))], names=[f"c{i}" for i in range(len(names))])

    return map_batches(rows, schema, run).toDF(*names)
