"""SentencePiece BPE by a merge-type prefix table.

A sequence of pieces is the BPE encoding of its text exactly if each adjacent pair is (its own encoding). So every prefix of a
text has one last piece: of the pieces that an automaton finds to end there, the one that is compatible with the last piece of
what stands before it. The table of last pieces is filled from left to right, and the ids are read from it backwards.

No piece has a blank mark after another character, so no merge crosses the start of a word: words are encoded on their own, and
a bounded cache per worker keeps them. Characters without a piece never merge and become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import as_texts

MARK = "▁"
#: Words and pairs kept per worker; each cache is emptied when it is full.
CACHE_WORDS, CACHE_PAIRS, CACHE_CHARS = 1_000_000, 2_000_000, 48
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixTable:
    """Encoder and decoder for a BPE model that only adds a leading blank and does not normalise otherwise."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.begin, self.end, self.pieces = sp.bos_id(), sp.eos_id(), [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(sp.encode(t, out_type=int) != self.plain(t) for t in (" a", "a  b", "　ﬁ ", "")):
            raise ValueError("only BPE models with a leading blank and without normalisation are supported")
        self.chars = {c for c in self.ids if len(c) == 1}
        #: Marks that no piece has after a letter: at the end of a word they are encoded on their own.
        self.enders = {c for c in ".,;:!?" if not any(c == b and a.isalpha() for p in self.ids for a, b in zip(p, p[1:]))}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.shown = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.marked = [not special[i] and p.startswith(MARK) for i, p in enumerate(self.pieces)]
        self.is_byte = [sp.is_byte(i) for i in range(n)]

    def merge(self, text: str) -> list[str]:
        """The definition: join the adjacent pair whose piece scores highest, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def plain(self, text: str) -> list[int]:
        """Slow encoding by the definition alone, for checks."""
        return [i for p in (self.merge(MARK + text.replace(" ", MARK)) if text else ()) for i in ([self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode()])]

    def fit(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > CACHE_PAIRS:
                self.fits.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.fits[key] = self.merge(a + b) == [a, b]
        return known

    def segment(self, text: str) -> list[int]:
        """Ids of a stretch that no merge leaves, from its prefix table."""
        n = len(text)
        last, size = [-1] * (n + 1), [1] * (n + 1)  # by the prefix's length; -1: a character without a piece
        fits, fit = self.fits, self.fit
        for end, (length, piece) in self.automaton.iter(text):  # ends ascend
            i = end + 1
            if last[i] >= 0:
                continue
            j = i - length
            if j and (before := last[j]) >= 0:
                ok = fits.get(before << 32 | piece)
                if not (fit(before, piece) if ok is None else ok):
                    continue
            last[i], size[i] = piece, length
        out, i = [], n
        while i:
            if last[i] >= 0:
                out.append(last[i])
            else:
                out += [self.byte[b] for b in reversed(text[i - 1].encode())]
            i -= size[i]
        return out[::-1]

    def word(self, word: str) -> bytes:
        """Ids, as uint32 bytes, of a word with its leading blank mark (or of a run of them with what follows)."""
        if "\n" in word and "\n" not in self.chars:  # a line end has no piece: it splits a word
            got = np.array([self.byte[10]], "<u4").tobytes().join(self.cached(p) if p else b"" for p in word.split("\n"))
        elif word[-1] in self.enders and word[-2:-1].isalpha():
            got = self.cached(word[:-1]) + self.cached(word[-1])
        else:
            got = np.array(self.segment(word), "<u4").tobytes()
        return got

    def cached(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = self.word(word)
            if len(word) <= CACHE_CHARS:
                if len(self.words) > CACHE_WORDS:
                    self.words.clear()
                self.words[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as uint32 bytes, without begin and end."""
        if not text:
            return b""
        if "  " in text or MARK in text or text[0] == " ":
            parts = _SEGMENT.findall(MARK + text.replace(" ", MARK))
        else:
            parts = [MARK + w for w in text.split(" ")]
        get, slow = self.words.get, self.cached
        return b"".join([get(p) or slow(p) for p in parts])

    def decode(self, ids: list[int]) -> str:
        shown = self.shown
        raw = b"".join([shown[i] for i in ids])
        first = next((i for i in ids if shown[i]), None)
        if first is not None and self.marked[first]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_bytes(ids)

    def _decode_bytes(self, ids: list[int]) -> str:
        """As decode, where a run of byte pieces is not UTF-8: each byte that starts no character becomes U+FFFD."""
        out, run, first = [], bytearray(), True

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.is_byte[i]:
                run += self.shown[i]
                first = False
            elif self.shown[i]:
                flush()
                piece = self.shown[i].decode()
                out.append(piece[1:] if first and self.marked[i] else piece)
                first = False
        flush()
        return "".join(out)


@lru_cache(2)
def table(path: str) -> PrefixTable:
    """One per worker process."""
    return PrefixTable(path)


def _round(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = table(path)
    begin, end = (np.array([i], "<u4").tobytes() for i in (model.begin, model.end))
    for batch in batches:
        rows = []
        for text in as_texts(batch.column(1)):
            raw = begin + model.encode(text) + end
            back = model.decode(np.frombuffer(raw, "<u4").tolist())
            rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = table(path)
    for batch in batches:
        ids = [[model.begin, *np.frombuffer(model.encode(t), "<u4").tolist(), model.end] for t in as_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids) with begin and end ids. Null text is empty; doc_ids may be null or repeat; extra columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_encode, path=model_path or default_path()), "doc_id long, ids array<int>")


def op10(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each row's whole text in one pass, without a shuffle.

    Null and empty texts are the begin and end ids alone; a text is encoded whole, however long; doc_ids may be null or repeat, and
    equal rows each have their row; other columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_round, path=model_path or default_path()), schema)
