"""Streaming Viterbi encoding and decoding with a SentencePiece vocabulary.

Pieces score by a Zipf law over the vocabulary's own ranking, the logarithm of 1 / ((rank + 1) H) with H the sum of 1 / (rank + 1), as
a merge-ranked vocabulary holds no probabilities; characters without a piece fall back to their UTF-8 bytes at a fixed extra cost.
Best paths are kept for the boundaries that a future piece could still start from, a window of the longest piece. Once all of
them trace back through one boundary, the ids before it are committed, so memory does not grow with the text. A text whose
paths never meet, as a run of one letter can be, commits the best path so far once WINDOW longest pieces are held; that costs
it at most about a piece each time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.common import column, map_batches

#: Scores are integers, millionths of a natural logarithm, so that sums and ties do not depend on where a path starts.
UNIT = 1_000_000
BYTE_COST = 12 * UNIT
LEAST = -(1 << 62)
SPACE_MARK = "▁"


class Vocabulary:
    """Pieces of a model file with spaces for their marks; ids, scores, bytes and the set of their endings."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces: dict[str, tuple[int, int]] = {}
        self.byte_ids = [0] * 256
        self.bytes: list[bytes] = [b""] * size
        plain = []
        for i in range(size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte_ids[b], self.bytes[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((-sp.get_score(i), i, p.replace(SPACE_MARK, " ")))
                self.bytes[i] = plain[-1][2].encode()
        norm = math.log(sum(1 / (r + 1) for r in range(len(plain))) or 1)
        for rank, (_, i, p) in enumerate(sorted(plain)):
            self.pieces[p] = (i, -round(UNIT * (math.log(rank + 1) + norm)))
        self.longest = max(map(len, self.pieces), default=1)
        #: Every ending of a piece, with (id, score) if it is a piece itself and else with an empty tuple.
        self.endings: dict[str, tuple[int, int] | tuple[()]] = {p[k:]: () for p in self.pieces for k in range(len(p))} | self.pieces
        # Stretches end where no piece crosses, so that all paths meet: before a run of spaces, at a line break or tab without a piece of
        # its own, and between letters and other characters. Whether that holds is read off the vocabulary.
        solo = "".join(c for c in "\n\r\t" if not any(c in p for p in self.pieces))
        plain_words = [p.lstrip(" ") for p in self.pieces]
        mixed = any(a.isalpha() != b.isalpha() for p in plain_words for a, b in zip(p, p[1:], strict=False))
        if any(" " in p for p in plain_words):
            self.cut = re.compile(r"(?s).+")
        else:
            words = rf"[^ {solo}]+" if mixed else rf"(?:[^\W\d_]+|(?:[^ {solo}\w]|[\d_])+)"
            self.cut = re.compile((rf"[{solo}]|" if solo else "") + rf"[ ]*{words}|[ ]+")
        self.memo: dict[str, tuple[int, ...]] = {}
        self.stream = StreamingViterbi(self)

    def fallback(self, c: str) -> tuple[tuple[int, ...], int]:
        raw = c.encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in raw), -BYTE_COST * len(raw)


#: Most boundaries held, in longest pieces.
WINDOW = 64


class StreamingViterbi:
    """push() characters in any portions and finish(); both return the ids that are certain by then. Ties go to the longer last piece."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.held = 0  # most boundaries ever held
        self._restart("")

    def _restart(self, tail: str) -> None:
        """Holds one boundary, with `tail` as the characters before it."""
        self.tail = tail
        self.scores: list[int] = [0]  # of the boundaries held
        self.back: list[int] = [0]  # length of the last piece of the best path to each
        self.ids: list = [None]  # and its id, or ids of bytes
        self.look = 4 * self.v.longest

    def push(self, text: str) -> list[int]:
        v, out, longest, get = self.v, [], self.v.longest, self.v.endings.get
        buf = self.tail + text
        scores, back, ids = self.scores, self.back, self.ids
        for at in range(len(self.tail) + 1, len(buf) + 1):
            c = buf[at - 1]
            got = get(c)
            if got:
                best, size, via = scores[-1] + got[1], 1, got[0]
            else:
                via, best = v.fallback(c)
                best, size = best + scores[-1], 1
            if got is not None:
                for n in range(2, min(longest, len(scores)) + 1):
                    got = get(buf[at - n : at])
                    if got:
                        s = scores[-n] + got[1]
                        if s >= best:
                            best, size, via = s, n, got[0]
                    elif got is None:
                        break
            scores.append(best)
            back.append(size)
            ids.append(via)
            if len(scores) >= self.look:
                self.held = max(self.held, len(scores))
                out += self._commit(longest)
                if len(scores) >= WINDOW * longest:
                    out += self._force(buf[max(0, at - 2 * longest) : at])
                    scores, back, ids = self.scores, self.back, self.ids
                self.look = max(4 * longest, min(2 * len(scores), WINDOW * longest))
        self.held = max(self.held, len(scores))
        self.tail = buf[-longest:]
        return out

    def _take(self, to: int) -> list[int]:
        """Ids of the best path to a held boundary; what is before it is let go."""
        found, b = [], to
        while b > 0:
            found.append(self.ids[b])
            b -= self.back[b]
        out: list[int] = []
        for x in reversed(found):
            if isinstance(x, tuple):
                out += x
            else:
                out.append(x)
        low = self.scores[to]
        self.scores[:] = [s - low for s in self.scores[to:]]
        del self.back[:to], self.ids[:to]
        return out

    def _commit(self, alive: int) -> list[int]:
        """Ids up to the last boundary that the best paths to the last `alive` boundaries all run through."""
        top = len(self.scores) - 1
        paths = set(range(max(0, top - alive + 1), top + 1))
        b = top
        while len(paths) > 1:
            if b in paths:
                paths.discard(b)
                paths.add(b - self.back[b])
            b -= 1
        return self._take(paths.pop())

    def _force(self, recent: str) -> list[int]:
        """Ids of the best path up to a longest piece before the end; the characters after it, the last of `recent`, are gone over again."""
        top = b = len(self.scores) - 1
        while b > 0 and top - b < self.v.longest:
            b -= self.back[b]
        out = self._take(b)
        again = recent[len(recent) - (top - b) :]
        self._restart("")
        return out + self.push(again)

    def finish(self) -> list[int]:
        out = self._commit(1)
        self._restart("")
        return out


def encode(v: Vocabulary, text: str | None, memo_size: int = 500_000, memo_chars: int = 48) -> list[int]:
    """Ids of a text, with a leading space as these vocabularies expect. Null and empty texts have none.

    The text is streamed in stretches between places where all paths meet, whatever comes; the ids of short stretches, words
    mostly, are remembered.
    """
    if not text:
        return []
    out: list[int] = []
    memo, stream = v.memo, v.stream
    for seg in v.cut.findall(" " + text):
        ids = memo.get(seg)
        if ids is None:
            ids = stream.push(seg)
            ids += stream.finish()
            if len(seg) <= memo_chars:
                if len(memo) >= memo_size:
                    memo.clear()
                memo[seg] = tuple(ids)
        out += ids
    return out


def decode(v: Vocabulary, ids: Iterable[int]) -> str:
    """The text of the ids without the leading space; bytes that form no character become U+FFFD."""
    table = v.bytes
    raw = b"".join([table[i] for i in ids])
    return raw[raw.startswith(b" ") :].decode("utf-8", "replace")


def decode_stream(v: Vocabulary, ids: Iterable[int]) -> Iterator[str]:
    """Text as soon as its characters are whole."""
    import codecs

    decoder, first = codecs.getincrementaldecoder("utf-8")("replace"), True
    for i in ids:
        s = decoder.decode(v.bytes[i])
        if s and first:
            s, first = s[s.startswith(" ") :], False
        if s:
            yield s
    if s := decoder.decode(b"", True):
        yield s


_vocabs: dict[str, Vocabulary] = {}


def _vocab(path: str) -> Vocabulary:
    if path not in _vocabs:
        _vocabs[path] = Vocabulary(path)
    return _vocabs[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """One row per input row: id and ids (little-endian unsigned 32-bit), with check also round_trip: whether decoding gives the text back.

    Null text counts as empty. Every text without lone surrogates comes back unchanged.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v, ids, same = _vocab(model_path), [], []
        for text in column(b, "_text"):
            got = encode(v, text)
            ids.append(np.array(got, "<u4").tobytes())
            if check:
                same.append(decode(v, got) == (text or ""))
        arrays = [b.column(0), pa.array(ids, pa.binary())] + ([pa.array(same, pa.bool_())] if check else [])
        return pa.RecordBatch.from_arrays(arrays, names=["_id", "ids"] + ["round_trip"] * check)

    return map_batches(rows, f"_id {id_type}, ids binary" + ", round_trip boolean" * check, run).withColumnRenamed("_id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and text. Null ids give an empty text."""
    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = _vocab(model_path)
        texts = [decode(v, np.frombuffer(x or b"", "<u4").tolist()) for x in column(b, "_ids")]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    return map_batches(rows, f"_id {id_type}, text string", run).withColumnRenamed("_id", id_col)
