"""Token counts that follow edits.

A document is kept as a segment tree over runs of pre-tokens: a leaf has the text of a run, and every node the characters and
tokens below it. An edit finds its leaves by descending the tree on characters. Only the touched leaves are encoded anew, and a
neighbour where the edit comes within two characters of their border, since whether a border starts a pre-token depends on one
character on either side; where the vocabulary has added tokens, an edit can make or break one, so their length is added to the
two. The sums above the leaves are updated, and the count of the document is that of the root.

Trees outlive a job: ``build`` gives a row per document with its text and, by leaf, bytes and tokens; ``update`` applies edits to
such rows and gives the new ones. Inner nodes are sums of the leaves, so they are not stored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut
from .bytebpe import ByteBpe, as_strings, chunks, default_path, encoder

#: Chunks of a leaf, and texts that are cut together.
RUN, BUILD_ROWS = 16, 4096
Edit = tuple[int, int, str]  # at, characters taken out, text put in


class CountTree:
    """Token counts of one text under edits; ``encoded`` counts the characters that were encoded since the tree was built."""

    def __init__(self, text: str, bpe: ByteBpe) -> None:
        cut = chunks(text, bpe.added)
        parts = [cut[0], *(" " + c for c in cut[1:])]
        counts = bpe.counts(cut)
        self._set(bpe, ["".join(parts[i : i + RUN]) for i in range(0, len(parts), RUN)], [sum(counts[i : i + RUN]) for i in range(0, len(parts), RUN)])

    @classmethod
    def stored(cls, text: str, widths: list[int], tokens: list[int], bpe: ByteBpe) -> CountTree:
        """The tree of a text whose leaves have these bytes and tokens; nothing is encoded."""
        tree, raw, ends = cls.__new__(cls), text.encode(), list(itertools.accumulate(widths))
        tree._set(bpe, [raw[e - w : e].decode() for e, w in zip(ends, widths, strict=True)], tokens)
        return tree

    def _set(self, bpe: ByteBpe, leaves: list[str], counts: list[int]) -> None:
        self.bpe, self.encoded, self.leaves = bpe, 0, leaves
        self.reach = max(map(len, bpe.added), default=0)
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(leaves)] = map(len, leaves)
        self.tokens[self.size : self.size + len(leaves)] = counts
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def by_leaf(self) -> tuple[list[int], list[int]]:
        """Bytes and tokens of each leaf."""
        return [len(x.encode()) for x in self.leaves], self.tokens[self.size : self.size + len(self.leaves)]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of the leaf that holds the character ``at``; the last one with characters for the end."""
        at = max(0, min(at, self.chars[1] - 1))
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        i = self.size + leaf
        self.leaves[leaf], self.chars[i], self.tokens[i] = text, len(text), tokens
        while i := i // 2:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, at: int, drop: int, put: str) -> int:
        """Replaces ``drop`` characters from ``at`` by ``put``; returns the new count. Places beyond the text are its end."""
        total = self.chars[1]
        at = max(0, min(at, total))
        drop = max(0, min(drop, total - at))
        first, start = self.find(at - 2 - self.reach)
        last, before = self.find(at + drop + 1 + self.reach)
        end = before + self.chars[self.size + last]
        old = "".join(self.leaves[first : last + 1])
        new = old[: at - start] + put + old[at - start + drop :]
        assert end - start == len(old)
        self.encoded += len(new)
        self._put(first, new, len(self.bpe.encode_few([new])[0]) // 4)
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._put(leaf, "", 0)
        return self.n_tokens


_MASKED = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+|\d(?:[ -]?\d){6,}")


def cleaning_edits(text: str) -> list[Edit]:
    """Edits of a usual cleaning step: mail addresses and numbers of 7 or more digits are masked, repeated lines are taken out."""
    edits: list[Edit] = []
    seen, at = set(), 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            edits.append((at, min(len(line) + 1, len(text) - at), ""))
        else:
            edits += [(at + m.start(), len(m[0]), "[masked]") for m in _MASKED.finditer(line)]
        seen.add(line)
        at += len(line) + 1
    return edits


def apply_edits(text: str, edits: list[Edit]) -> str:
    """The text after non-overlapping edits whose places are those of the text given."""
    for at, drop, put in sorted(edits, reverse=True):
        text = text[:at] + put + text[at + drop :]
    return text


_TREE = "doc_id long, text string, widths array<int>, tokens array<int>"


def _lists(rows: list) -> pa.Array:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))


def _trees(doc_ids: pa.Array, texts: pa.Array, leaves: list[tuple]) -> list[pa.Array]:
    return [doc_ids, texts, _lists([x[0] for x in leaves]), _lists([x[1] for x in leaves])]


def _build(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, BUILD_ROWS):
            part = batch.slice(at, BUILD_ROWS)
            texts = as_strings(part.column(1))
            leaves = [got if got is not None else CountTree(texts[k].as_py(), bpe).by_leaf() for k, got in enumerate(bpe.run_counts(texts, RUN))]
            yield pa.RecordBatch.from_arrays(_trees(part.column(0), texts, leaves), ["doc_id", "text", "widths", "tokens"])


def build(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, text, widths, tokens): each row's whole text with the bytes and tokens of every leaf of its tree, to be kept.

    Null text is empty (one leaf of nothing); doc_ids may be null or repeat; a text may be very long; other columns are ignored;
    an empty table gives an empty result.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(partial(_build, path=tokenizer_path or default_path()), _TREE)


_CHANGES = ["n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_chars_encoded"]


def _update(batches: Iterator[pa.RecordBatch], path: str, edits_of: Callable[[str], list[Edit]]) -> Iterator[pa.RecordBatch]:
    bpe = encoder(path)
    for batch in filter(len, batches):
        texts, widths, tokens = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
        before = [int(np.sum(x)) for x in np.split(tokens.flatten().to_numpy(), tokens.offsets.to_numpy()[1:-1] - tokens.offsets[0].as_py())]
        rows, new = [], {}
        for k, (text, n) in enumerate(zip(texts, before, strict=True)):
            edits = edits_of(text)
            if edits:
                tree = new[k] = CountTree.stored(text, widths[k].as_py(), tokens[k].as_py(), bpe)
                for at, drop, put in sorted(edits, reverse=True):  # from the end, so places stay
                    tree.edit(at, drop, put)
                rows.append((n, len(edits), tree.n_tokens, tree.chars[1], tree.encoded))
            else:
                rows.append((n, 0, n, len(text), 0))
        if new:  # else the rows stay as they are
            leaves = [new[k].by_leaf() if k in new else (widths[k].values.to_numpy(), tokens[k].values.to_numpy()) for k in range(len(texts))]
            cols = _trees(batch.column(0), pa.array([new[k].text() if k in new else t for k, t in enumerate(texts)], pa.string()), leaves)
        else:
            cols = batch.columns
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", "text", "widths", "tokens", *_CHANGES])


def update(trees: DataFrame, edits_of: Callable[[str], list[Edit]], tokenizer_path: str | None = None) -> DataFrame:
    """The rows of ``build`` after the edits that ``edits_of`` gives for each text, and the counts before and after.

    Only the leaves that an edit touches, and neighbours at their border, are encoded (n_chars_encoded); other rows are passed on.
    """
    work = partial(_update, path=tokenizer_path or default_path(), edits_of=edits_of)
    return trees.select("doc_id", "text", "widths", "tokens").mapInArrow(work, _TREE + "".join(f", {c} long" for c in _CHANGES))


def count_with_edits(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = cleaning_edits, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, n_chars_encoded) of each row's whole text, without a shuffle.

    The trees are built and written, then the edits are applied to the trees as read back. Null text is empty; doc_ids may be null
    or repeat, and equal rows each have their count; a text may be very long; other columns are ignored; an empty table gives an
    empty result.
    """
    return update(cut(build(docs, tokenizer_path), "trees"), edits_of, tokenizer_path).select("doc_id", *_CHANGES)
