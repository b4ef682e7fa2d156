"""Language identification by cross-parsing entropy.

A suffix automaton of sample text per language yields longest-match phrases of a text: from each phrase's end the next
longest string that occurs in the sample. Phrases times log2 of the sample's length, per character, estimates the cross
entropy; the language of least entropy wins.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavox.llm.common import column, crc_mod, map_batches

_GAP = re.compile(r"[\W\d_]+")
UNKNOWN, SPACE = 0, 1


def normalise(text: str | None) -> str:
    """Lower case; every run of non-letters is one space. What the pattern takes for letters includes numerals such as ½, which go too."""
    if not text:
        return ""
    text = _GAP.sub(" ", text.lower())
    if not text.isascii():
        odd = [c for c in set(text) if c > "\x7f" and not c.isalpha()]
        for c in odd:
            text = text.replace(c, " ")
        if odd:
            text = " ".join(text.split())
    return text.strip()


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton that accepts every substring of the sequence; state 0 is the start."""
    trans: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(trans)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(trans[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


#: Bytes of the dense part of a model's transitions.
DENSE_BYTES = 48 << 20


@dataclass
class CrossParser:
    """table[state * width + code] is the next state or -1 for the commonest characters, whose codes are below width; others are looked up
    among `keys`, sorted state * codes + code. start holds each language's start state, cost its log2 sample length."""

    langs: list[str]
    alphabet: dict[str, int]
    table: np.ndarray
    start: np.ndarray
    cost: np.ndarray
    width: int
    keys: np.ndarray
    to: np.ndarray

    @classmethod
    def fit(cls, samples: dict[str, str], dense_bytes: int = DENSE_BYTES) -> CrossParser:
        langs = sorted(samples)
        n = Counter(c for lang in langs for c in samples[lang] if c != " ")
        alphabet = {c: i + 2 for i, c in enumerate(sorted(n, key=lambda c: (-n[c], c)))} | {" ": SPACE}
        codes = len(alphabet) + 1
        automata = [suffix_automaton([alphabet[c] for c in samples[lang]]) for lang in langs]
        start = np.concatenate([[0], np.cumsum([len(a) for a in automata])]).astype(np.int64)
        width = int(min(codes, max(2, dense_bytes // (4 * max(int(start[-1]), 1)))))
        table = np.full(int(start[-1]) * width, -1, np.int32)
        keys, to = [], []
        for at, trans in zip(start.tolist(), automata, strict=False):
            for s, out in enumerate(trans, at):
                for c, t in out.items():
                    if c < width:
                        table[s * width + c] = t + at
                    else:
                        keys.append(s * codes + c), to.append(t + at)
        order = np.argsort(np.array(keys, np.int64))
        return cls(langs, alphabet, table, start[:-1].astype(np.int32), np.log2([max(len(samples[x]), 2) for x in langs]), width, np.array(keys, np.int64)[order], np.array(to, np.int32)[order])

    def _next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none, of a row of states for each language and a code for each column."""
        if not len(self.keys):
            return self.table.take(state * self.width + code)
        out = self.table.take(state * self.width + np.minimum(code, self.width - 1))
        rare = np.flatnonzero(code >= self.width)
        if len(rare):
            key = state[:, rare].astype(np.int64) * (len(self.alphabet) + 1) + code[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[:, rare] = np.where(self.keys[at] == key, self.to[at], -1)
        return out

    def _codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not hasattr(self, "_lookup"):
            self._lookup = np.zeros(0x2000, np.uint16)
            self._rare = {ord(c): i for c, i in self.alphabet.items() if ord(c) >= 0x2000}
            for c, i in self.alphabet.items():
                if ord(c) < 0x2000:
                    self._lookup[ord(c)] = i
        codes = self._lookup[np.minimum(points, 0x1FFF)]
        high = np.flatnonzero(points >= 0x1FFF)
        for i in high:
            codes[i] = self._rare.get(int(points[i]), UNKNOWN)
        return codes

    def phrases(self, texts: list[str], block: int = 2048, lanes: int = 1500) -> np.ndarray:
        """Phrase counts, a row for each text and a column for each language. Texts are parsed in blocks of `block` characters, all of them."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        parts: list[tuple[int, np.ndarray]] = []
        for i, t in enumerate(texts):
            codes = self._codes(t)
            parts += [(i, codes[s : s + block]) for s in range(0, len(codes), block)]
        parts.sort(key=lambda p: -len(p[1]))
        every = np.arange(len(self.alphabet) + 1)
        root = self._next(np.repeat(self.start[:, None], len(every), axis=1), every)
        restart = np.where(root < 0, self.start[:, None], root).astype(np.int32)
        for at in range(0, len(parts), lanes):
            group = parts[at : at + lanes]
            sizes = np.array([len(p[1]) for p in group])
            grid = np.zeros((sizes[0], len(group)), np.uint16)
            for k, (_, c) in enumerate(group):
                grid[: len(c), k] = c
            state = np.repeat(self.start[:, None], len(group), axis=1)
            count = np.ones(state.shape, np.int64)
            active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes longer than each position
            for pos in range(sizes[0]):
                n = active[pos]
                c = grid[pos, :n]
                nxt = self._next(state[:, :n], c)
                miss = nxt < 0
                count[:, :n] += miss
                state[:, :n] = np.where(miss, restart.take(c, axis=1), nxt)
            np.add.at(out, [p[0] for p in group], count.T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; `und` and 0 where there is no letter or nothing was learned.

        The score is the runner-up's share of the two least entropies: 0.5 for a tie, near 1 for a clear case, 1 alone.
        """
        clean = [normalise(t) for t in texts]
        known = [i for i, t in enumerate(clean) if t]
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if known and self.langs:
            entropy = self.phrases([clean[i] for i in known]) * self.cost
            best = entropy.argmin(axis=1)
            low = np.sort(entropy, axis=1)
            conf = low[:, 1] / (low[:, 0] + low[:, 1]) if entropy.shape[1] > 1 else np.ones(len(known))
            for i, b, s in zip(known, best, conf, strict=True):
                langs[i], scores[i] = self.langs[b], s
        return langs, scores


def fit_languages(docs: DataFrame, chars_per_lang: int = 32_000, docs_per_lang: int = 64, text_chars: int = 4000, most_langs: int = 200, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CrossParser:
    """Fit on a bounded sample: about docs_per_lang rows of each language, chosen by a hash of the id, outside the held-out fold; of these
    as many as reach chars_per_lang characters. A text of more than text_chars gives a window of that length, at a place hashed from
    its id. The most_langs languages of most rows are learned (ties: the smaller name).

    Null ids, texts and languages and empty texts take no part.
    """
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (crc_mod(id_col, folds) != held_out))
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter(F.length("_text") > 0)
    counts = rows.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(most_langs).collect()
    if not counts:
        return CrossParser.fit({})
    h = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
    below = F.create_map(*[x for r in counts for x in (F.lit(r["_lang"]), F.lit(int(1_000_000 * min(1.0, docs_per_lang / r["n"])) + 1))])
    at = 1 + F.pmod(F.xxhash64("_id", F.lit(1)), F.greatest(F.lit(1), F.length("_text") - text_chars + 1))
    part = rows.select("_id", "_lang", F.substring("_text", at.cast("int"), F.lit(text_chars)).alias("_text"), F.xxhash64("_id").alias("_h"))
    first = Window.partitionBy("_lang").orderBy("_h", "_id", "_text")

    def take(some: DataFrame) -> list:
        """At most 4 * docs_per_lang rows of a language, of which Spark keeps as many a task before it shuffles."""
        return some.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= 4 * docs_per_lang).orderBy("_h", "_id", "_text").collect()

    samples: dict[str, str] = {}

    def learn(found: list) -> None:
        for r in found:
            have = samples.get(r["_lang"], "")
            if len(have) < chars_per_lang and (clean := normalise(r["_text"])):
                samples[r["_lang"]] = have + clean + " "

    learn(take(part.filter(h < F.element_at(below, F.col("_lang")))))
    # A language whose rows share few ids may have had all of them above its threshold.
    left = [r["_lang"] for r in counts if r["_lang"] not in samples]
    if left:
        learn(take(part.filter(F.col("_lang").isin(left))))
    return CrossParser.fit(samples)


def identify_language(docs: DataFrame, model: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score. Null ids and repeated rows are kept. The model, bounded by its sample, is a broadcast variable."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = [], []
        texts = column(b, "_text")
        for at in range(0, len(texts), 1000):
            a, s = shared.value.predict(texts[at : at + 1000])
            langs += a
            scores.append(s)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=["_id", "lang_pred", "score"])

    return map_batches(rows, f"_id {id_type}, lang_pred string, score double", run).withColumnRenamed("_id", id_col)
