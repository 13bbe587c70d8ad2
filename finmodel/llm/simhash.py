"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``2 * half`` bits share at least one point within ``half`` bits of both. So every distinct fingerprint
emits all variants of at most ``half`` flipped bits, the variants are shuffled, and equal variants name colliding pairs, which
are verified on the fingerprints. Members of a collision are linked by a spanning forest, never by all pairs: links are only
used through the components they form.

Scale: variants are dealt to buckets by a linear code of their bits, so ``code(f ^ mask) = code(f) ^ code(mask)``. A fingerprint
therefore travels once to each bucket that one of its variants falls into, and the reducer writes out the variants that belong
there; a variant costs no bytes of its own in the shuffle. The number of buckets follows the number of fingerprints, so a
reducer's work is bounded however large the input is, and passes over parts of the buckets bound what lies on disk at a time.
Equal fingerprints are merged before, so a hot text costs one ball. Each reducer returns a spanning forest of what it linked.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut, cut_path, freed_shuffles, remove, row_key
from .components import components, forest

_OFFSETS = np.arange(8, dtype=np.intp) * 256
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Variants that one reducer takes on average; fingerprints that one block of a bucket comes from; bytes of a fingerprint that
#: one pass may shuffle.
BUCKET_VARIANTS, BLOCK, PASS_BYTES = 3_000_000, 4096, 2048
#: Members of a run of equal variants up to which its pairs are compared together with those of all other such runs.
SHORT_RUN = 32


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``words``-word shingle, repeats included; the whole sequence if there are fewer words; none without words."""
    parts = text.lower().split()  # of bytes: only A-Z, and only the six ASCII blanks
    if not parts:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(joined, seed)], np.uint64)
    ends = list(itertools.accumulate(map(len, parts)))
    starts = [0, *(e + i for i, e in enumerate(ends[:-1], 1))]
    return np.array([h(joined[s : e + i], seed) for i, (s, e) in enumerate(zip(starts, ends[words - 1 :], strict=False), words - 1)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 where more than half of the hashes have it; zero for none."""
    if not len(hashes):
        return 0
    cells = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + _OFFSETS
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit hash of a shingle, from its first (the splitmix64 finaliser)."""
    if k == 0:
        return h
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], words: int, n_words64: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        out: list[list[int]] = [[] for _ in range(n_words64)]
        for t in texts:
            h = shingle_hashes(t or b"", words)
            for k, column in enumerate(out):
                column.append(majority(_spread(h, k)))
        cols = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in out]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *(f"f{k}" for k in range(n_words64))])


def fingerprints(docs: DataFrame, words: int = 4, n_words64: int = 1) -> DataFrame:
    """(doc_id, f0, f1 ...): ``n_words64`` 64-bit SimHash words of each row's whole text; null and blank texts give zero."""
    schema = "doc_id long, " + ", ".join(f"f{k} long" for k in range(n_words64))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(partial(_fingerprint_batches, words=words, n_words64=n_words64), schema)


@lru_cache(4)
def ball(bits: int, half: int) -> np.ndarray:
    """All masks of at most ``half`` of the ``bits`` lowest bits."""
    return np.array([sum(1 << i for i in c) for r in range(half + 1) for c in itertools.combinations(range(bits), r)], np.uint64)


def code(values: np.ndarray, bits: int, width: int) -> np.ndarray:
    """A linear code of ``width`` bits: code(x ^ y) = code(x) ^ code(y). Each bit position has a pseudo-random word of its own."""
    words = [xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(bits)]
    out = np.zeros(values.shape, np.uint32)
    for k in range(width):
        mask = np.uint64(sum(1 << i for i, w in enumerate(words) if w >> k & 1))
        out |= (np.bitwise_count(values & mask) & 1).astype(np.uint32) << np.uint32(k)
    return out


@lru_cache(4)
def _coded(bits: int, half: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The masks in ascending order of their codes, and the codes."""
    masks = ball(bits, half)
    codes = code(masks, bits, width)
    order = np.argsort(codes, kind="stable")
    return masks[order], codes[order]


@dataclass(frozen=True)
class Search:
    """``bands`` groups of ``bits`` bits are hashed with all variants of at most ``half`` flips; a pair is a candidate if a band
    differs in at most ``2 * half`` bits, and a link if the first ``checked`` words differ in at most ``within``."""

    bits: int = 64
    half: int = 2
    within: int = 4
    bands: int = 1
    checked: int = 1
    least_width: int = 8

    def width(self, n: int) -> int:
        """Bits of the bucket code for n fingerprints."""
        return max(self.least_width, math.ceil(math.log2(max(1.0, n * len(ball(self.bits, self.half)) / BUCKET_VARIANTS))))

    def sent(self, width: int) -> int:
        """Bytes of one fingerprint in the shuffle of a band."""
        return min(1 << width, len(ball(self.bits, self.half))) * (8 if self.bits == 64 else 16 + 4 + 8 * self.checked)


def band_values(words: np.ndarray, band: int, bits: int) -> np.ndarray:
    """The band-th group of ``bits`` bits (64 at most) of fingerprints given as rows of 64-bit words."""
    word, at = divmod(band * bits, 64)
    got = words[:, word] >> np.uint64(at)
    if at + bits > 64:
        got = got | (words[:, word + 1] << np.uint64(64 - at))
    return got & np.uint64(2**bits - 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of about BLOCK rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= BLOCK):
            table = pa.Table.from_batches(held).combine_chunks()
            held = []
            for at in range(0, table.num_rows, BLOCK):
                yield [c.chunk(0).to_numpy(zero_copy_only=False) for c in table.slice(at, BLOCK).combine_chunks().columns]


_SENT = ["bucket", "nodes", "labels", "values", "checks"]


def _emit(batches, search: Search, width: int, bands: tuple[int, ...], part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The fingerprints of a block by the bucket of a band that some of their variants fall into, for one part of the buckets."""
    own = np.unique(_coded(search.bits, search.half, width)[1])
    whole = search.bits == 64  # then the fingerprint is its own node, label and check
    for columns in _blocks(batches):
        nodes, labels = columns[:2]
        words = np.stack([c.view(np.uint64) for c in columns[2:]], 1)
        for band in bands:
            values = band_values(words, band, search.bits)
            target = code(values, search.bits, width)[:, None] ^ own
            who, _ = keep = np.nonzero((target.astype(np.uint64) * np.uint64(parts)) >> np.uint64(width) == part)
            target = target[keep]
            order = np.argsort(target, kind="stable")
            target, who = target[order], who[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1, [len(target)]]) if len(target) else np.zeros(1, int)
            rows: list[list] = [[] for _ in _SENT]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                i = who[s:e]
                sent = (b"", b"", values[i].tobytes(), b"") if whole else (nodes[i].tobytes(), labels[i].tobytes(), values[i].astype(np.uint32).tobytes(), words[i, : search.checked].tobytes())
                for column, x in zip(rows, ((band << width) + int(target[s]), *sent), strict=True):
                    column.append(x)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[1:])], _SENT)


def _near(words: np.ndarray, a: np.ndarray, b: np.ndarray, within: int) -> np.ndarray:
    """Whether the fingerprints of rows a and b lie within ``within`` bits, with little memory."""
    parts = [np.bitwise_count(words[a[at : at + 65536]] ^ words[b[at : at + 65536]]).sum(axis=-1) <= within for at in range(0, len(a), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def collide(variants: np.ndarray, who: np.ndarray, labels: np.ndarray, words: np.ndarray, within: int) -> np.ndarray:
    """Verified links (rows of two labels) that span, with the labels, every set of fingerprints which share a variant and lie
    within ``within`` bits. Fingerprints of one label count as linked already; the links are a forest."""
    order = np.argsort(variants)
    v = variants[order]
    same = v[1:] == v[:-1]
    if not same.any():
        return np.empty((0, 2), np.int64)
    inside = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    v, who = v[inside], who[order[inside]]
    head = np.concatenate([[True], v[1:] != v[:-1]])
    member = np.flatnonzero(~head)
    heads = np.flatnonzero(head)
    start = heads[np.cumsum(head) - 1]
    a, b = who[start[member]], who[member]
    near = labels[a] == labels[b]
    check = np.flatnonzero(~near)
    near[check] = _near(words, a[check], b[check], within)
    out = [np.stack([labels[a[near]], labels[b[near]]], 1)]
    # A member far from the first of its run may be near others: compare it with the run, and link it once to each class there.
    far_at = member[~near]
    if len(far_at):
        run = np.searchsorted(heads, far_at, side="right") - 1
        ends = np.append(heads[1:], len(v))
        close = np.ones(len(v), bool)
        close[far_at] = False
        size = ends[run] - heads[run]
        short = (size > 2) & (size <= SHORT_RUN)
        at, begin, stop = far_at[short], heads[run][short], ends[run][short]
        for lag in range(1, SHORT_RUN - 1):  # pairs of two far members once, and a far one with one near the first
            after, before = at + lag < stop, at - lag > begin
            before[before] = close[at[before] - lag]
            x, y = np.concatenate([at[after], at[before]]), np.concatenate([at[after] + lag, at[before] - lag])
            apart = labels[who[x]] != labels[who[y]]
            x, y = x[apart], y[apart]
            hit = _near(words, who[x], who[y], within)
            out.append(np.stack([labels[who[x[hit]]], labels[who[y[hit]]]], 1))
        for r in np.unique(run[size > SHORT_RUN]):
            group = who[heads[r] : ends[r]]
            classes = np.where(close[heads[r] : ends[r]], labels[group[0]], labels[group])
            for i in np.flatnonzero(~close[heads[r] : ends[r]]):
                other = np.flatnonzero(classes != classes[i])
                hit = other[np.bitwise_count(words[group[other]] ^ words[group[i]]).sum(axis=-1) <= within]
                for j in hit[np.unique(classes[hit], return_index=True)[1]]:
                    out.append(np.array([[labels[group[i]], labels[group[j]]]]))
                    classes[classes == classes[j]] = classes[i]
    pairs = np.concatenate(out)
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], 1), axis=0)
    return np.array(forest(pairs.tolist()) or np.empty((0, 2)), np.int64)


def _reducer(search: Search, width: int):
    def reduce(key, table):
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        if search.bits == 64:
            values = read("values", np.uint64)
            labels, words = values.view(np.int64), values[:, None]
        else:
            values = read("values", np.uint32).astype(np.uint64)
            labels, words = read("labels", np.int64), read("checks", np.uint64).reshape(-1, search.checked)
        masks, codes = _coded(search.bits, search.half, width)
        wanted = code(values, search.bits, width) ^ np.uint32(key[0].as_py() & ((1 << width) - 1))
        low, high = np.searchsorted(codes, wanted, "left"), np.searchsorted(codes, wanted, "right")
        who = np.repeat(np.arange(len(values)), high - low)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        variants = values[who] ^ masks[low[who] + nth]
        pairs = collide(variants if search.bits > 32 else variants.astype(np.uint32), who, labels, words, search.within)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return reduce


def links(prints: DataFrame, search: Search, bands: range | None = None) -> tuple[list[DataFrame], list[str]]:
    """(node, label, f0 ...) of distinct fingerprints -> (a, b) links between labels, and the folders that hold them.

    Bands, or for large inputs parts of a band, are shuffled in passes of about PASS_BYTES a fingerprint; a pass's shuffle files
    go when it ends. Of 64-bit searches node and label are the fingerprint itself.
    """
    spark, bands = prints.sparkSession, bands if bands is not None else range(search.bands)
    n = prints.count()
    width = search.width(n)
    each = search.sent(width)
    parts = min(1 << width, 1 << max(0, math.ceil(math.log2(each / PASS_BYTES))))
    together = max(1, PASS_BYTES // each)
    src = prints.repartition(max(8, min(20_000, math.ceil(n / (4 * BLOCK)))))
    done, paths = [], []
    with freed_shuffles(spark):
        for at in range(0, len(bands), together):
            for part in range(parts):
                emit = partial(_emit, search=search, width=width, bands=tuple(bands[at : at + together]), part=part, parts=parts)
                blocks = src.mapInArrow(emit, "bucket long, nodes binary, labels binary, values binary, checks binary")
                out, path = cut_path(blocks.groupBy("bucket").applyInArrow(_reducer(search, width), "a long, b long"), "links")
                done.append(out)
                paths.append(path)
    return done, paths


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def near_duplicates(docs: DataFrame, words: int = 4, search: Search = Search()) -> DataFrame:
    """(doc_id, f0, component_id): one row per row of ``docs``; component_id is the smallest doc_id reachable over links.

    Null and blank texts have fingerprint zero and link like any other; repeated doc_ids stay as they are; a null doc_id keeps
    its row, links like any other and is never the smallest unless its whole class has none (then component_id is null). Two texts
    under one doc_id are not linked by that. Extra columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    fps = cut(fingerprints(docs, words), "fingerprints")
    classes = cut(fps.groupBy("f0").agg(F.min("doc_id").alias("least")), "classes")
    edges, paths = links(classes.select(F.col("f0").alias("node"), F.col("f0").alias("label"), "f0"), search)
    found = components(_all(edges))
    remove(spark, *paths)
    named = cut(classes.join(found, F.col("f0") == F.col("node"), "left").select(F.col("f0").alias("print"), "least", F.coalesce("component", "f0").alias("component")), "named")
    ids = cut(named.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    labels = cut(named.join(ids, "component").select("print", "component_id"), "labels")
    return fps.join(labels, F.col("f0") == F.col("print"), "left").select("doc_id", "f0", "component_id")


def op2(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of the 4-word, 64-bit, 4-bit contract; as ``near_duplicates``."""
    got = near_duplicates(docs)
    return got.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: The pipeline's search for candidates: 1,024 bits over five-word shingles, hashed in 39 bands of 26 bits with all variants of at most
#: one bit; what collides is compared on 256 bits. Texts of Jaccard similarity 0.8 differ in 39 of these on average (standard
#: deviation 6; 48 for very short ones), unrelated ones in 128 (8); no band differs in at most 2 bits for 1 of 20,000 pairs.
PIPELINE, N64 = Search(bits=26, half=1, within=80, bands=39, checked=4, least_width=1), 16
#: The rule: two texts are near-duplicates if their sets of WORDS-word shingles have a Jaccard similarity of LEAST_PERCENT or more.
WORDS, LEAST_PERCENT = 5, 80
#: Members of a group of candidates that are compared in one cell, members that every cell of a large group has, members of a task.
CELL, PIVOTS, CELL_ROWS = 1024, 8, 4000


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, WORDS))


def _class_batches(batches: Iterator[pa.RecordBatch], n64: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "node", *(f"f{k}" for k in range(n64))]
    for batch in batches:
        nodes, out = [], [[] for _ in range(n64)]
        for t in batch.column(2).cast(pa.binary()).to_pylist():
            distinct = shingle_set(t or b"")
            nodes.append(xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes()) if len(distinct) else None)
            for k, column in enumerate(out):
                column.append(majority(_spread(distinct, k)))
        known = np.array([x is None for x in nodes], bool)
        node = pa.array(np.array([x or 0 for x in nodes], np.uint64).view(np.int64), mask=known)
        cols = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in out]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, *cols], names)


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["node", "component", "block", "blocks", "shingles"]
    for batch in batches:
        sets = [shingle_set(t or b"").tobytes() for t in batch.column(4).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(sets, pa.binary())], names)


class _Sets:
    """Shingle sets as runs of small numbers, to count what one has in common with many."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets])
        self.vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.pieces = np.split(flat, np.cumsum(self.sizes)[:-1])
        self.marked = np.zeros(len(self.vocabulary), bool)

    def joined(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([self.pieces[i] for i in of]), np.concatenate([[0], np.cumsum(self.sizes[of])[:-1]])

    def alike(self, i: int, of: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        self.marked[self.pieces[i]] = True
        both = np.add.reduceat(self.marked[flat], starts, dtype=np.int64)
        self.marked[self.pieces[i]] = False
        return 100 * both >= LEAST_PERCENT * (self.sizes[i] + self.sizes[of] - both)


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) that span every class of the sets under the exact rule; the sets are distinct and not empty.

    A class grows from its first member: each member is compared with all that no class has yet, so a large class costs little.
    """
    held, free, links = _Sets(sets), np.arange(len(sets)), []
    while len(free) > 1:
        queue, free = [int(free[0])], free[1:]
        run, stale = held.joined(free), False
        while queue and len(free):
            i = queue.pop()
            if stale:
                run, stale = held.joined(free), False
            hit = held.alike(i, free, *run)
            if hit.any():
                found = free[hit].tolist()
                links += [(i, j) for j in found]
                queue += found
                free, stale = free[~hit], True
    return links


def across(sets: list[np.ndarray], labels: np.ndarray, rest: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) between each member of ``rest`` and every other label that has a member similar to it, once a label."""
    held, links = _Sets(sets), []
    of = np.arange(len(sets))
    run = held.joined(of)
    for i in rest.tolist():
        hit = of[held.alike(i, of, *run) & (labels != labels[i])]
        links += [(i, int(j)) for j in hit[np.unique(labels[hit], return_index=True)[1]]]
    return links


def _pairs(pairs: list[tuple[int, int]]) -> pa.Table:
    pairs = forest(pairs)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _verify(table: pa.Table) -> pa.Table:
    """Links of cells that compare all their members."""
    cells: dict[tuple, dict[int, bytes]] = {}
    for c, i, node, shingles in zip(*(table.column(x).to_pylist() for x in ("component", "block", "node", "shingles")), strict=True):
        cells.setdefault((c, i), {})[node] = shingles
    pairs: list[tuple[int, int]] = []
    for members in cells.values():
        nodes = list(members)
        pairs += [(nodes[x], nodes[y]) for x, y in similar([np.frombuffer(members[n], np.uint64) for n in nodes])]
    return _pairs(pairs)


def _verify_rest(table: pa.Table) -> pa.Table:
    """Links of cells that compare some members with all others of a block."""
    cells: dict[tuple, dict[int, tuple]] = {}
    for c, i, j, node, label, rest, shingles in zip(*(table.column(x).to_pylist() for x in ("component", "i", "block", "node", "label", "rest", "shingles")), strict=True):
        cell = cells.setdefault((c, i, j), {})
        cell[node] = (label, rest or cell.get(node, (0, False))[1], shingles)
    pairs: list[tuple[int, int]] = []
    for members in cells.values():
        nodes, rows = list(members), list(members.values())
        found = across([np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[0] for r in rows]), np.flatnonzero([r[1] for r in rows]))
        pairs += [(nodes[x], nodes[y]) for x, y in found]
    return _pairs(pairs)


def _dealt(cells: DataFrame, by: tuple[str, ...], rows: int, verify) -> DataFrame:
    """Cells put together into tasks of about CELL_ROWS members."""
    task = F.pmod(F.xxhash64(*by), F.lit(max(1, math.ceil(rows / CELL_ROWS))))
    return cells.withColumn("task", task).groupBy("task").applyInArrow(verify, "a long, b long")


def verified(keyed: DataFrame, classes: DataFrame, coarse: DataFrame, repeated: bool) -> tuple[DataFrame, list[str]]:
    """(a, b) links between nodes of one candidate group (node, component) whose shingle sets meet the rule, and their folders.

    A group of more than CELL members is dealt by hash into blocks. First each block is compared in itself and with PIVOTS members
    of the group, which makes one class of most of a large group. Then only members outside the group's largest class are
    compared with the blocks again. So each two members are compared unless they are known to be of one class, and the work of
    a group whose members are mostly alike grows in proportion to it.
    """
    spark = keyed.sparkSession
    found = coarse.withColumnRenamed("node", "linked")
    named, p0 = cut_path(classes.select("node", "least").join(found, F.col("node") == F.col("linked"), "left").select("node", "least", F.coalesce("component", "node").alias("component")), "named")
    sizes, p1 = cut_path(named.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").select(F.col("component").alias("c"), F.ceil(F.col("size") / CELL).alias("blocks")), "sizes")
    members = named.join(sizes, F.col("component") == F.col("c")).select("node", "component", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "blocks", F.col("least.doc_id").alias("m_id"), F.col("least.text_key").alias("m_key"))
    one = keyed.dropDuplicates(["doc_id", "text_key"]) if repeated else keyed
    texts = members.join(one, members["m_id"].eqNullSafe(one["doc_id"]) & (members["m_key"] == one["text_key"])).select("node", "component", "block", "blocks", "text")
    sets, p2 = cut_path(texts.mapInArrow(_set_batches, "node long, component long, block long, blocks long, shingles binary"), "sets")
    remove(spark, p0, p1)
    total, largest = sets.agg(F.count("*"), F.max("blocks")).first()
    cells = sets.select("component", "block", "node", "shingles")
    if (largest or 0) > 1:
        leads = sets.where("blocks > 1").select("component", "blocks", "node").withColumn("place", F.expr("row_number() OVER (PARTITION BY component ORDER BY node)")).where(F.col("place") <= PIVOTS)
        pivots = leads.select(F.col("component").alias("c"), F.col("node").alias("lead")).join(sets, F.col("node") == F.col("lead")).select("component", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "node", "shingles")
        cells = cells.union(pivots)
    first, p3 = cut_path(_dealt(cells, ("component", "block"), total, _verify), "verified")
    if (largest or 0) <= 1:
        remove(spark, p2)
        return first, [p3]
    known = components(first).select(F.col("node").alias("linked"), F.col("component").alias("known"))
    listed = sets.where("blocks > 1").select("node", "component", "block", "blocks").join(known, F.col("node") == F.col("linked"), "left")
    labelled, p4 = cut_path(listed.select("node", "component", "block", "blocks", F.coalesce("known", "node").alias("label")), "labels")
    counts = labelled.groupBy("component", "label").agg(F.count("*").alias("n"))
    most, p5 = cut_path(counts.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0").select(F.col("component").alias("c"), "main", F.ceil(F.col("others") / CELL).alias("parts")), "main")
    judged = labelled.join(most, F.col("component") == F.col("c")).select(F.col("node").alias("n"), "label", (F.col("label") != F.col("main")).alias("rest"), "parts")
    open_sets, p6 = cut_path(sets.join(judged, F.col("node") == F.col("n")).select("node", "component", "block", "blocks", "label", "rest", "parts", "shingles"), "open")
    remove(spark, p2, p4, p5)
    asked = open_sets.where("rest").select("component", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).alias("i"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "node", "label", "rest", "shingles")
    others = open_sets.select("component", F.explode(F.expr("sequence(0L, parts - 1)")).alias("i"), "block", "node", "label", F.lit(False).alias("rest"), "shingles")
    rows = open_sets.agg(F.sum("parts"), F.sum(F.when(F.col("rest"), F.col("blocks")).otherwise(0))).first()
    second, p7 = cut_path(_dealt(asked.union(others), ("component", "i", "block"), (rows[0] or 0) + (rows[1] or 0), _verify_rest), "verified")
    remove(spark, p6)
    return first.union(second), [p3, p7]


def near_groups(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text_key, component) of every row under the exact rule, and whether rows repeat both doc_id and text.

    Texts of one shingle set are one class, named by a 64-bit hash of the set. Near fingerprints make groups of candidates; within
    them the sets themselves decide. The first band is searched alone: what it links is one label afterwards, and the other bands
    look only for links between labels, so a group of many near copies is not linked again by each band. Texts without words are a
    class of their own (component null).
    """
    spark, cols = docs.sparkSession, [f"f{k}" for k in range(N64)]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, text_key long, node long, " + ", ".join(f"{c} long" for c in cols)
    prints, p0 = cut_path(keyed.mapInArrow(partial(_class_batches, n64=N64), schema), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("least")
    classes, p1 = cut_path(prints.where("node IS NOT NULL").groupBy("node").agg(first, *[F.min(c).alias(c) for c in cols]), "classes")
    rows = cut(prints.select("doc_id", "text_key", "node"), "rows")
    remove(spark, p0)
    seeds, made = links(classes.select("node", F.col("node").alias("label"), *cols), PIPELINE, range(1))
    seed = components(_all(seeds)).select(F.col("node").alias("linked"), F.col("component").alias("label"))
    labelled, p2 = cut_path(classes.join(seed, F.col("node") == F.col("linked"), "left").select("node", F.coalesce("label", "node").alias("label"), *cols), "labelled")
    more, added = links(labelled, PIPELINE, range(1, PIPELINE.bands))
    coarse = components(_all([seed.select(F.col("linked").alias("a"), F.col("label").alias("b")), *more]))
    remove(spark, p2, *made, *added)
    repeated = bool(rows.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count())
    pairs, paths = verified(keyed, classes, coarse, repeated)
    exact = components(pairs).withColumnRenamed("node", "linked")
    remove(spark, p1, *paths)
    return rows.join(exact, F.col("node") == F.col("linked"), "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("component")), repeated


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest doc_id (null after all others).

    Rows are told apart by (doc_id, text), so a doc_id that is repeated with another text, or is null, is judged by its own text. Of
    rows that repeat both, one stays. Null, empty and blank texts are one group; a text of fewer than five words is one shingle.
    An empty table gives an empty result; other columns are kept as they are, whatever their names.
    """
    groups, repeated = near_groups(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("best")
    kept = cut(groups.groupBy("component").agg(best).select(F.col("best.doc_id").alias("kept_id_"), F.col("best.text_key").alias("kept_key_")), "kept")
    key = row_key(docs["text"])
    if not repeated:
        return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["kept_id_"]) & (key == kept["kept_key_"]), "left_semi")
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_"), docs["doc_id"].cast("long").alias("id_"), key.alias("key_"))
    left = marked.join(kept, F.col("id_").eqNullSafe(F.col("kept_id_")) & (F.col("key_") == F.col("kept_key_")), "left_semi")
    return left.dropDuplicates(["id_", "key_"]).select("row_.*")
