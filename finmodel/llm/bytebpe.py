"""Byte-level BPE through the tokenizers library, for each distinct chunk once instead of for each text.

The pre-token pattern of this tokenizer always starts a token at a blank that is followed by a non-blank. So a text may be cut
there, its chunks encoded on their own and joined again. Only a blank before an added token (such as ``<|endoftext|>``) belongs to
the blanks before it, since the library takes added tokens out first: no cut is made there. Chunks repeat a lot: a bounded pool
per worker keeps their ids.

Whole columns are cut and dictionary-encoded by Arrow, so Python sees each distinct chunk of a batch once; the ids of the texts
are then taken from the pool by NumPy. The few texts that Arrow's cut at every blank does not fit go through ``chunks``.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept per worker, and the longest that are kept; the cache is emptied when it is full.
CACHE_CHUNKS, CACHE_CHARS = 1_000_000, 48
_BLANK_RUN = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunks(text: str, added: tuple[str, ...] = ()) -> list[str]:
    """Pieces whose encodings join to that of the text; all but the first stand without the blank that starts them."""
    if inside := [a for a in added if a in text]:
        if any(" " in a for a in inside):
            return [text]
        return re.split(rf" (?=\S)(?!{'|'.join(map(re.escape, inside))})", text)
    for m in _BLANK_RUN.finditer(text):
        if m.start() and text[m.start() - 1].isspace():  # a blank inside a longer run does not start a token
            return _CUT.split(text)
    return text.split(" ")


class ByteBpe:
    """Ids of texts as little-endian uint32 bytes. Added tokens inside a text get their own id, as by the library's default."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens.values()):
            raise ValueError("added tokens that depend on the text around them are not supported")
        self.added = tuple(t.content for t in tokens.values())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # in a byte-level vocabulary each character is a byte
        for piece, i in vocabulary.items():
            self.n_bytes[i] = len(piece.encode()) if i in tokens else len(piece)
        self.heads: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self._empty_pool()

    def _empty_pool(self) -> None:
        """The pool: the place of a chunk (with its lead), and by place where its ids begin and end."""
        self.place: dict[str, dict[str, int]] = {"": {}, " ": {}}
        self.ends, self.ids, self.used = np.zeros(1 << 16, np.int64), np.empty(1 << 17, np.uint32), 0

    def _grown(self, array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])

    def _pooled(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Adds the ids of some chunks, one after the other; returns the place of the first."""
        first, end = self.used, int(self.ends[self.used])
        self.ids, self.ends = self._grown(self.ids, end + len(ids)), self._grown(self.ends, first + len(counts) + 1)
        self.ids[end : end + len(ids)] = ids
        self.ends[first + 1 : first + len(counts) + 1] = end + np.cumsum(counts)
        self.used += len(counts)
        return first

    def _places(self, chunks: pa.Array, lead: str) -> np.ndarray:
        """The places of distinct chunks in the pool, which takes up those it does not have."""
        known, words = self.place[lead], chunks.to_pylist()
        found = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            bulk = plain_start(chunks)[new] if lead else np.zeros(len(new), bool)
            for some, encode in ((new[bulk], self._joined), (new[~bulk], self._alone)):
                if len(some):
                    fresh = [words[k] for k in some.tolist()]
                    first = self._pooled(*encode(fresh, lead))
                    known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
                    found[some] = np.arange(first, first + len(fresh))
        return found

    def _alone(self, new: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of chunks that are encoded each on its own."""
        got = [e.ids for at in range(0, len(new), 20_000) for e in self.tokenizer.encode_batch_fast([lead + c for c in new[at : at + 20_000]], add_special_tokens=False)]
        return np.array(list(itertools.chain.from_iterable(got)), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _joined(self, new: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks that start with a blank and a non-blank: many are encoded as one text, which the library does much
        faster, and its ids are dealt out by the number of bytes that each stands for."""
        all_ids, all_counts = [], []
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([lead + lead.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            sizes = pc.binary_length(pa.array(part, pa.string())).to_numpy().astype(np.int64) + 1
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes)) + 1
            all_ids.append(ids)
            all_counts.append(np.diff(ends, prepend=0))
        return np.concatenate(all_ids), np.concatenate(all_counts)

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets of the parts of each text, distinct parts, which of them each part is, places of the parts in the pool, texts
        that a cut at every blank does not fit) of a column without nulls."""
        parts = pc.split_pattern(column, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], parts.flatten()
        coded = flat.dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        if self.used > CACHE_CHUNKS:
            self._empty_pool()
        plain = plain_start(words)[which]  # a cut may stand before the part
        plain[offsets[:-1]] = True
        odd = np.add.reduceat(~plain, offsets[:-1]) > 0
        for a in self.added:
            odd |= pc.match_substring(column, a).to_numpy(zero_copy_only=False)
        at = self._places(words, " ")[which]
        heads, back = np.unique(which[offsets[:-1]], return_inverse=True)
        at[offsets[:-1]] = self._places(words.take(pa.array(heads)), "")[back]
        return offsets, words, which, at, odd

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each) of an Arrow string column; null is empty."""
        if not len(column):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        column = as_strings(column)
        offsets, _, _, at, odd = self._cut(column)
        sizes = self.ends[at + 1] - self.ends[at]
        if odd.any():
            sizes[np.repeat(odd, np.diff(offsets))] = 0
        counts = np.add.reduceat(sizes, offsets[:-1])
        before = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.ends[at] - before, sizes) + np.arange(int(sizes.sum()))]
        if odd.any():
            alone = [np.frombuffer(x, "<u4") for x in self.encode_few([column[int(k)].as_py() for k in np.flatnonzero(odd)])]
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for k, x in zip(np.flatnonzero(odd).tolist(), alone, strict=True):
                pieces[k], counts[k] = x, len(x)
            ids = np.concatenate(pieces)
        return ids, counts

    def run_counts(self, column: pa.Array, run: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(bytes, ids) of each run of ``run`` chunks of each text; None for a text that needs ``chunks``. The column has no nulls."""
        if not len(column):
            return []
        offsets, words, which, at, odd = self._cut(column)
        sizes, width = self.ends[at + 1] - self.ends[at], pc.binary_length(words).to_numpy().astype(np.int64)[which] + 1
        width[offsets[:-1]] -= 1
        runs = -(-np.diff(offsets) // run)
        last = np.cumsum(runs)
        starts = np.repeat(offsets[:-1], runs) + run * (np.arange(last[-1]) - np.repeat(last - runs, runs))
        both = zip(np.split(np.add.reduceat(width, starts), last[:-1]), np.split(np.add.reduceat(sizes, starts), last[:-1]), strict=True)
        return [None if skip else got for skip, got in zip(odd.tolist(), both, strict=True)]

    def _fresh(self, new: list[str], lead: str) -> dict[str, bytes]:
        """Ids of unseen chunks."""
        bulk = [bool(lead and c) and not c[0].isspace() for c in new]
        got = {}
        for some, encode in (([c for c, k in zip(new, bulk, strict=True) if k], self._joined), ([c for c, k in zip(new, bulk, strict=True) if not k], self._alone)):
            if some:
                ids, counts = encode(some, lead)
                raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                got.update((c, raw[s:e]) for c, s, e in zip(some, [0, *ends], ends))
        return got

    def _lookup(self, known: dict[str, bytes], wanted: list[list[str]], lead: str) -> list[list[bytes]]:
        """Ids of every wanted chunk, list by list."""
        found = [list(map(known.get, chunk_list)) for chunk_list in wanted]
        gaps = [k for k, f in enumerate(found) if None in f]
        if not gaps:
            return found
        got = self._fresh(list({c for k in gaps for c, ids in zip(wanted[k], found[k], strict=True) if ids is None}), lead)
        for k in gaps:
            found[k] = [got[c] if ids is None else ids for c, ids in zip(wanted[k], found[k], strict=True)]
        if len(known) + len(got) > CACHE_CHUNKS:
            known.clear()
        known.update((c, ids) for c, ids in got.items() if len(c) <= CACHE_CHARS)
        return found

    def counts(self, cut: list[str]) -> list[int]:
        """Number of ids of each chunk of one text."""
        return [len(ids) // 4 for ids in self._lookup(self.heads, [cut[:1]], "")[0] + self._lookup(self.rest, [cut[1:]], " ")[0]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def encode_few(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, for a few texts."""
        cut = [chunks(t, self.added) for t in texts]
        heads = self._lookup(self.heads, [c[:1] for c in cut], "")
        rest = self._lookup(self.rest, [c[1:] for c in cut], " ")
        return [h[0] + b"".join(r) for h, r in zip(heads, rest, strict=True)]


@lru_cache(2)
def encoder(path: str) -> ByteBpe:
    """One per worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(path)


def plain_start(chunks: pa.Array) -> np.ndarray:
    """Whether each chunk starts with a character that is no blank."""
    blank = pc.or_(pc.equal(pc.binary_length(chunks), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(chunks, 0, 1)))
    return ~blank.to_numpy(zero_copy_only=False)


def as_strings(column: pa.Array) -> pa.Array:
    """An Arrow string column without nulls, valid UTF-8; null is empty, bytes that are not UTF-8 become U+FFFD."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array(as_texts(column), pa.string())
    return column.fill_null("") if column.null_count else column


def as_texts(column: pa.Array) -> list[str]:
    """An Arrow string column as str; null is empty, bytes that are not UTF-8 become U+FFFD."""
    return [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]
