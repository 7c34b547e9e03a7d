"""Evaluation texts leaking into training text: CGK embedding, bit-sampling LSH over windows, exact verification.

Items and documents are read as words. What is searched for are windows of ``window`` words, the least passage that counts;
an item with fewer words is one window of its own size. Each window is embedded by the random walk of Chakraborty,
Goldenberg and Koucky, which turns few edits (words added, dropped or changed) into few differing places; a few places of
the walk are sampled as a bucket key. This is repeated with other walks and places, as often as the chance that a pair with
edits at the worst places shares a bucket asks for, which is measured for the given window and edits. Pairs of windows that
share a bucket are compared exactly by edit distance. Equal windows share every bucket, so they are always found.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12
MAX_EDITS = 2
#: Places sampled of a walk. It stays with a word for two steps on average, so it has left the window after that many.
PLACES, STEPS = 4, 2
TARGET_RECALL = 0.999
#: Words of items that one index holds; indexes that one scan of the documents meets; letters a task holds meanwhile.
WORDS_PER_BLOCK = 500_000
BLOCKS_PER_SCAN = 64
LETTERS_HELD = 32_000_000
#: Documents searched, and pairs of windows compared, at once.
TEXTS, PAIRS = 500, 100_000

#: Letters of a text whose words are read at once.
LONG_TEXT = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"[\W_]")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    """Longest runs of letters and digits, without letter case."""
    return _WORD.findall(text.lower()) if text else []


def edits_for(size: int, window: int = WINDOW, max_edits: int = MAX_EDITS) -> int:
    """Edits allowed in a window of ``size`` words: ``max_edits`` for a whole one, fewer in proportion for a shorter item."""
    return max_edits * min(size, window) // window


class Walk:
    """One random walk over windows of ``size`` symbols, and the places sampled over its whole length."""

    def __init__(self, rng: np.random.Generator, size: int) -> None:
        steps = STEPS * size
        self.size = size
        edges = np.linspace(0, steps, min(PLACES, steps) + 1).astype(int)
        self.places = rng.integers(edges[:-1], edges[1:])  # one in each part of the walk, so that no two read one word
        self.turns = rng.integers(0, 2**63, steps, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        self.mixers = rng.integers(0, 2**63, len(self.places), dtype=np.int64).astype(_U) * _U(2) + _U(1)

    def keys(self, symbols: np.ndarray, past: np.uint64) -> np.ndarray:
        """Bucket keys of windows of random codes; at each step the walk reads a symbol, whose code says whether it goes on."""
        n = len(symbols)
        flat, base = np.ascontiguousarray(symbols).ravel(), np.arange(n) * self.size
        at, key, k = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=_U), 0
        for j in range(int(self.places[-1]) + 1):
            symbol = np.where(at >= self.size, past, flat[base + np.minimum(at, self.size - 1)])
            if self.places[k] == j:
                key = (key ^ symbol) * self.mixers[k]
                k += 1
            at += ((symbol * self.turns[j]) >> _U(63)).astype(np.int64)
        return key ^ (key >> _U(29))


@functools.cache
def hit_chance(size: int, edits: int) -> float:
    """The least chance, over kinds and places of ``edits`` edits, that two windows of ``size`` words share a bucket.

    Windows of one length differ by changed words, or by a word added and another dropped. Both kinds are tried with the
    edits at the start, in the middle, at the end and apart, on random windows and walks (a fixed seed).
    """
    if not edits:
        return 1.0
    rng, n, least = np.random.default_rng(7), 250, 1.0
    spots = sorted({(p, q) for p in (0, 1, size // 2, size - 2, size - 1) for q in (0, 1, size // 2, size - 2, size - 1) if p < q < size and p >= 0}) or [(0, 0)]
    walks = [Walk(rng, size) for _ in range(24)]
    for p, q in spots:
        for kind in range(3 if edits > 1 else 1):
            hits = 0
            for walk in walks:
                code = rng.integers(1, 2**63, (n, size + edits + 1), dtype=np.int64).astype(_U)
                a, b = code[:, :size].copy(), code[:, :size].copy()
                if kind == 0:
                    for i, x in enumerate(sorted({p, q, *range(size)}, key=lambda s: (s not in (p, q), s))[:edits]):
                        b[:, x] = code[:, size + i]
                else:  # a word added at one place and one dropped at the other
                    cut, put = (p, q) if kind == 1 else (q, p)
                    rest = np.delete(b, cut, axis=1)
                    b = np.insert(rest, min(put, size - 1), code[:, size], axis=1)
                    for i in range(edits - 2):
                        b[:, (p + 2 + i) % size] = code[:, size + 1 + i]
                hits += (walk.keys(a, _U(1)) == walk.keys(b, _U(1))).sum()
            least = min(least, hits / (n * len(walks)))
    return max(least, 1e-3)


def repetitions(recall: float = TARGET_RECALL, size: int = WINDOW, edits: int = MAX_EDITS) -> int:
    """Walks needed so that a pair with that many edits at the worst places shares a bucket with the chance ``recall``."""
    p = hit_chance(size, edits)
    return 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))


class _Sized:
    """All distinct item windows of one size: whose they are, and their buckets."""

    def __init__(self, rows: np.ndarray, owners: np.ndarray, edits: int, walks: list[Walk], code: np.ndarray, base: int) -> None:
        self.size, self.edits, self.walks = rows.shape[1], edits, walks
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)  # a passage that many items share is one window
        pairs = np.unique(np.stack([which.ravel(), owners], axis=1), axis=0)
        self.owners, self.begins = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.buckets = []
        for walk in walks:
            keys = walk.keys(code[self.rows], code[-1])
            order = np.argsort(keys, kind="stable")
            self.buckets.append((keys[order], order))
        self.pairs = np.unique(self.rows[:, :-1] * base + self.rows[:, 1:]) if self.size > 1 else np.empty(0, np.int64)


class WindowIndex:
    """All windows of a block of items, by bucket, and the search in it."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, max_edits: int = MAX_EDITS, recall: float = TARGET_RECALL, whole_walks: int | None = None, seed: int = 1) -> None:
        """``whole_walks``: the repetitions for whole windows, if they are known already."""
        self.vocabulary: dict[str, int] = {}
        by_size: dict[int, tuple[list, list]] = {}
        for i, t in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)]
            if ids:
                rows, owners = by_size.setdefault(min(window, len(ids)), ([], []))
                rows += [ids[s : s + window] for s in range(max(0, len(ids) - window) + 1)]
                owners += [i] * (max(0, len(ids) - window) + 1)
        rng = np.random.default_rng(seed)
        self.code = rng.integers(1, 2**63, len(self.vocabulary) + 2, dtype=np.int64).astype(_U)  # 0: unknown, last: past the end
        self.base = len(self.vocabulary) + 1
        self.sized = []
        for size, (rows, owners) in sorted(by_size.items()):
            edits = edits_for(size, window, max_edits)
            times = whole_walks if whole_walks and size == window else repetitions(recall, size, edits)
            self.sized.append(_Sized(np.array(rows, dtype=np.int64), np.array(owners, dtype=np.int64), edits, [Walk(rng, size) for _ in range(times)], self.code, self.base))

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text number, item id, fewest edits, words of the window) of every text and item with windows near enough."""
        ids = [self._ids(t) for t in texts]
        flat = np.array([v for x in ids for v in (*x, -1)], dtype=np.int64)  # -1 parts the texts
        owner = np.repeat(np.arange(len(ids)), [len(x) + 1 for x in ids])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for s in self.sized:
            starts = self._usable(flat, s)
            for a in range(0, len(starts), 20_000):
                for at, row, edits in self._near(flat, starts[a : a + 20_000], s):
                    for place, r, e in zip(at.tolist(), row.tolist(), edits.tolist(), strict=True):
                        text = int(owner[place])
                        for i in s.owners[s.begins[r] : s.begins[r + 1]].tolist():
                            if e < best.get((text, i), (s.edits + 1, 0))[0]:
                                best[text, i] = (e, s.size)
        return [(t, i, e, n) for (t, i), (e, n) in best.items()]

    def _ids(self, text: str | None) -> list[int]:
        """Word numbers of a text (0: in no item); of a long one, the words themselves are never all held at once."""
        known, out, at = self.vocabulary.get, [], 0
        while at < len(text or ""):
            gap = _GAP.search(text, at + LONG_TEXT)
            end = gap.start() if gap else len(text)
            out += [known(w, 0) for w in words_of(text[at:end])]
            at = end
        return out

    def _usable(self, flat: np.ndarray, s: _Sized) -> np.ndarray:
        """Starts of windows inside one text that can be near at all: an edit spoils one word and two pairs of neighbours."""
        n = len(flat) - s.size + 1
        if n <= 0:
            return np.empty(0, np.int64)

        def within(marks: np.ndarray, width: int) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(marks)))
            return total[width : width + n] - total[:n]

        ok = (within(flat < 0, s.size) == 0) & (within(flat > 0, s.size) >= max(1, s.size - s.edits))
        wanted = s.size - 1 - 2 * s.edits
        if wanted > 0 and ok.any():
            pair = flat[:-1] * self.base + flat[1:]
            pair[(flat[:-1] <= 0) | (flat[1:] <= 0)] = -1
            found = np.searchsorted(s.pairs, pair)
            has = s.pairs[np.minimum(found, len(s.pairs) - 1)] == pair
            ok &= within(has, s.size - 1) >= wanted
        return np.flatnonzero(ok)

    def _near(self, flat: np.ndarray, starts: np.ndarray, s: _Sized) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, item window, edits) of the pairs that share a bucket and are near enough, at most ``PAIRS`` at a time."""
        windows = np.lib.stride_tricks.sliding_window_view(flat, s.size)[starts]
        symbols = self.code[windows]
        held, size = [], 0

        def compared(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at, row = np.divmod(np.unique(np.concatenate(codes)), len(s.rows))
            edits = edit_distances(windows[at], s.rows[row], s.edits)
            near = np.flatnonzero(edits <= s.edits)
            return starts[at[near]], row[near], edits[near]

        for walk, (keys, order) in zip(s.walks, s.buckets, strict=True):
            mine = walk.keys(symbols, self.code[-1])
            lo = np.searchsorted(keys, mine)
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == mine)
            if not len(hit):
                continue
            lo = lo[hit]
            many = np.searchsorted(keys, mine[hit], "right") - lo
            upto = np.cumsum(many)
            total, a = int(upto[-1]), 0
            while a < total:  # a bucket of any size is taken in parts
                number = np.arange(a, min(total, a + PAIRS))
                at = np.searchsorted(upto, number, "right")
                entry = lo[at] + number - (upto[at] - many[at])
                held.append(hit[at] * len(s.rows) + order[entry])
                size += len(number)
                a += PAIRS
                if size >= PAIRS:
                    yield compared(held)
                    held, size = [], 0
        if held:
            yield compared(held)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of rows of word numbers (0 equals nothing), exact up to ``most``, else larger."""
    n, w = a.shape
    out = np.full(n, most + 1, dtype=np.int64)
    same = ((a == b) & (a != 0)).all(axis=1)
    out[same] = 0
    rest = np.flatnonzero(~same)
    if not len(rest) or most == 0:
        return out
    # With that few edits, all but ``most`` words are matched on diagonals no farther from the middle than ``most``.
    x, y = a[rest], b[rest]
    matched = np.zeros(len(rest), dtype=np.int64)
    for shift in range(-most, most + 1):
        u, v = x[:, max(0, shift) : w + min(0, shift)], y[:, max(0, -shift) : w - max(0, shift)]
        matched += ((u == v) & (u != 0)).sum(axis=1)
    rest = rest[matched >= w - most]
    x, y = a[rest], b[rest]
    row = np.tile(np.arange(w + 1), (len(rest), 1))
    for i in range(1, w + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, w + 1):
            if abs(i - j) > most + 1:
                new[:, j] = most + 1
                continue
            u, v = x[:, i - 1], y[:, j - 1]
            cost = ((u != v) | (u == 0)).astype(np.int64)
            new[:, j] = np.minimum(np.minimum(row[:, j] + 1, new[:, j - 1] + 1), row[:, j - 1] + cost)
        row = new
    out[rest] = np.minimum(row[:, w], most + 1)
    return out


def leaks(documents: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW, max_edits: int = MAX_EDITS, recall: float = TARGET_RECALL) -> DataFrame:
    """``item_id``, ``doc_id``, ``edits``, ``words``: items and documents with windows within ``max_edits`` words of each other.

    ``words`` is the size of the windows: ``window``, or all words of a shorter item, of which fewer edits are allowed
    (:func:`edits_for`). ``edits`` is the fewest found; 0 means that the words are shared one after the other, which is
    always found. A pair of windows with edits is found with at least the chance ``recall``, wherever they lie; a document
    and an item that share a longer passage have many such pairs. Null and empty texts match nothing. Documents are read
    once, whole, without a shuffle and with any number of hits; the items, a stated set, are cut into blocks of bounded
    size, and a task that has gathered ``LETTERS_HELD`` of documents takes one block after the other.
    """
    spark = documents.sparkSession
    slim_items = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    total = slim_items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * WORDS_PER_BLOCK)))
    walks = repetitions(recall, window, max_edits)
    slim = documents.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t")).filter("t IS NOT NULL")
    kind = slim.schema["d"].dataType.simpleString()
    out = None
    for first in range(0, blocks, BLOCKS_PER_SCAN):
        held = [
            spark.sparkContext.broadcast(sorted((r["i"], r["t"]) for r in slim_items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).toLocalIterator()))
            for k in range(first, min(blocks, first + BLOCKS_PER_SCAN))
        ]

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            only = WindowIndex(held[0].value, window, max_edits, recall, walks) if len(held) == 1 else None
            gathered, letters = [], 0

            def met() -> Iterator[pa.RecordBatch]:
                for h in held:
                    index = only or WindowIndex(h.value, window, max_edits, recall, walks)
                    for b in gathered:
                        for at in range(0, b.num_rows, TEXTS):
                            part = b.slice(at, TEXTS)
                            found = index.search(part.column(1).to_pylist())
                            if found:
                                t, i, e, n = zip(*found, strict=True)
                                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), part.column(0).take(pa.array(t, pa.int64())), pa.array(e, pa.int32()), pa.array(n, pa.int32())], names=["item_id", "doc_id", "edits", "words"])

            for b in batches:
                gathered.append(b)
                letters += b.column(1).nbytes
                if only or letters >= LETTERS_HELD:
                    yield from met()
                    gathered, letters = [], 0
            if gathered:
                yield from met()

        found = slim.mapInArrow(run, f"item_id bigint, doc_id {kind}, edits int, words int")
        out = found if out is None else out.unionByName(found)
    return out
