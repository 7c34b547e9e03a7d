"""Same or nearly same records across splits, by Aho-Corasick scans of all training texts.

Each distinct evaluation text is cut into ``max_mismatches + 1`` pieces. A passage of a training text that is within that
many mismatches of an evaluation text holds at least one piece unchanged at its place, so an automaton over the pieces
finds every candidate; candidates are then compared letter by letter, many at once. The letters that near passages repeat
unchanged make intervals of the evaluation text, which are merged into its coverage.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankstead.functions.text import folded

#: Distinct evaluation texts, and letters in them, that one automaton holds.
TEXTS_PER_SHARD = 200_000
LETTERS_PER_SHARD = 20_000_000
#: Shards that one scan of the training texts meets, and letters of training texts that a task holds meanwhile.
SHARDS_PER_SCAN = 64
LETTERS_HELD = 32_000_000
#: Candidates that are compared at once.
CANDIDATES = 50_000


def pieces(length: int, count: int) -> list[tuple[int, int]]:
    """(start, end) of ``count`` nearly equal pieces of a text; pieces of a text shorter than ``count`` may be empty."""
    cuts = [length * i // count for i in range(count + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the texts in a row, and where each text begins."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


class PieceAutomaton:
    """Finds, in texts, the passages within ``max_mismatches`` of an evaluation text: the whole text, or any part ``inside``."""

    def __init__(self, texts: list[str], max_mismatches: int, inside: bool = False) -> None:
        self.texts, self.most, self.inside = texts, max_mismatches, inside
        self.codes, self.starts = _codes(texts)
        found: dict[str, dict] = {}
        self.any_text: dict[int, list[int]] = {}  # texts so short that every passage of their length is near
        for i, t in enumerate(texts):
            if len(t) <= max_mismatches:
                self.any_text.setdefault(len(t), []).append(i)
                continue
            for a, b in pieces(len(t), max_mismatches + 1):
                # Without ``inside``, a piece counts only in texts of one length and at one place.
                found.setdefault(t[a:b], {}).setdefault(a if inside else (len(t), a), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.filled = bool(found)
        if self.filled:
            self.automaton.make_automaton()

    def _candidates(self, text: str) -> set[tuple[int, int]]:
        """(evaluation text, place in ``text`` where it would begin) of all that share a piece."""
        n, out = len(text), set()
        if self.filled:
            lengths = self.starts
            for end, (size, places) in self.automaton.iter(text):
                begin = end + 1 - size
                if self.inside:
                    for a, which in places.items():
                        at = begin - a
                        if at >= 0:
                            out.update((i, at) for i in which if at + lengths[i + 1] - lengths[i] <= n)
                else:
                    which = places.get((n, begin))
                    if which:
                        out.update((i, 0) for i in which)
        for length, which in self.any_text.items():
            if length == n or self.inside and length < n:
                out.update((i, at) for i in which for at in range(n - length + 1))
        return out

    def near(self, texts: list[str]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text, evaluation text, mismatches, where its letters are repeated) of each near passage."""
        flat, starts = _codes(texts)
        held: list[tuple[int, int, int]] = []
        for row, text in enumerate(texts):
            held += ((i, row, at) for i, at in self._candidates(text))
            if len(held) >= CANDIDATES:
                yield from self._compared(held, flat, starts)
                held = []
        yield from self._compared(held, flat, starts)

    def _compared(self, held: list[tuple[int, int, int]], flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        if not held:
            return
        which, rows, at = np.array(held, dtype=np.int64).T
        lengths = self.starts[which + 1] - self.starts[which]
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            step = max(1, 4_000_000 // max(n, 1))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                span = np.arange(n)
                same = self.codes[self.starts[which[part]][:, None] + span] == flat[(starts[rows[part]] + at[part])[:, None] + span]
                far = n - same.sum(axis=1)
                for j in np.flatnonzero(far <= self.most).tolist():
                    yield int(rows[part[j]]), int(which[part[j]]), int(far[j]), same[j]


def _intervals(same: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals, those that touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scans(train: DataFrame, text: Column, keep: list[str], eval_df: DataFrame, eval_text: str, texts_per_shard: int, out: T.StructType, found) -> DataFrame:
    """Scan the training texts with the automata of all shards, in one pass over up to ``SHARDS_PER_SCAN`` of them.

    A task gathers training texts up to ``LETTERS_HELD`` letters, then takes one shard after the other, so it holds one
    automaton at a time, and makes it once where there is but one. ``found`` turns a block of texts into record batches.
    """
    spark = train.sparkSession
    texts = eval_df.select(folded(eval_text).alias("t")).filter("t IS NOT NULL").distinct()
    n, letters = texts.agg(F.count(F.lit(1)), F.sum(F.length("t"))).first()
    shards = max(1, -(-n // texts_per_shard), -(-(letters or 0) // LETTERS_PER_SHARD))
    slim = train.select(text.alias("_t"), *keep).filter("_t IS NOT NULL")
    whole = None
    for first in range(0, shards, SHARDS_PER_SCAN):
        held = [
            spark.sparkContext.broadcast(sorted(r["t"] for r in texts.filter(F.pmod(F.xxhash64("t"), F.lit(shards)) == s).toLocalIterator()))
            for s in range(first, min(shards, first + SHARDS_PER_SCAN))
        ]

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            kept, block, letters = {}, [], 0

            def met() -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(block)
                for k, h in enumerate(held):
                    machine = kept.get(k) or found.machine(h.value)
                    if len(held) == 1:
                        kept[k] = machine
                    yield from found(machine, table)

            for b in batches:
                block.append(b)
                letters += b.column(0).nbytes
                if len(held) == 1 or letters >= LETTERS_HELD:
                    yield from met()
                    block, letters = [], 0
            if block:
                yield from met()

        part = slim.mapInArrow(scan, out)
        whole = part if whole is None else whole.unionByName(part)
    return whole


class _Pairs:
    """Near pairs of a block; a training text met twice in it is looked up once."""

    def __init__(self, most: int, inside: bool) -> None:
        self.most, self.inside = most, inside

    def machine(self, texts: list[str]) -> PieceAutomaton:
        return PieceAutomaton(texts, self.most, self.inside)

    def __call__(self, machine: PieceAutomaton, table: pa.Table) -> Iterator[pa.RecordBatch]:
        distinct = table.column(0).combine_chunks().dictionary_encode()
        code, texts = distinct.indices.to_numpy(), distinct.dictionary.to_pylist()
        best: dict[tuple[int, int], int] = {}
        for t, i, d, _ in machine.near(texts):
            best[t, i] = min(d, best.get((t, i), d))
        if not best:
            return
        by_text: dict[int, list[tuple[int, int]]] = {}
        for (t, i), d in best.items():
            by_text.setdefault(t, []).append((i, d))
        rows, which, far = [], [], []
        for row in np.flatnonzero(np.isin(code, list(by_text))).tolist():
            for i, d in by_text[code[row]]:
                rows.append(row)
                which.append(machine.texts[i])
                far.append(d)
        kept = table.take(pa.array(rows, pa.int64()))
        columns = [kept.column(c).combine_chunks() for c in table.column_names[1:]]
        for a in range(0, len(rows), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([*[c[part] for c in columns], pa.array(which[part], pa.string()), pa.array(far[part], pa.int32())], names=[*table.column_names[1:], "eval_text", "mismatches"])


class _Spans(_Pairs):
    """Merged intervals of a block's near passages by evaluation text, with the rows near it and the fewest mismatches."""

    def __call__(self, machine: PieceAutomaton, table: pa.Table) -> Iterator[pa.RecordBatch]:
        distinct = table.column(0).combine_chunks().dictionary_encode()
        copies, texts = np.bincount(distinct.indices.to_numpy(), minlength=len(distinct.dictionary)), distinct.dictionary.to_pylist()
        spans: dict[int, list[tuple[int, int]]] = {}
        rows: dict[int, set[int]] = {}
        nearest: dict[int, int] = {}
        for t, i, d, same in machine.near(texts):
            own = spans.setdefault(i, [])
            own += _intervals(same)
            if len(own) > 1000:
                spans[i] = _merged(own)
            rows.setdefault(i, set()).add(t)
            nearest[i] = min(d, nearest.get(i, d))
        out = [(machine.texts[i], int(copies[list(rows[i])].sum()), nearest[i], [{"a": a, "b": b} for a, b in _merged(own)]) for i, own in spans.items()]
        if out:
            cols = list(zip(*out, strict=True))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["eval_text", "n", "nearest", "spans"])


def near_texts(train: DataFrame, train_id: str, train_text: str, eval_df: DataFrame, eval_text: str, max_mismatches: int = 2, texts_per_shard: int = TEXTS_PER_SHARD, inside: bool = False, keep: list[str] = ()) -> DataFrame:
    """``train_id``, columns ``keep`` of the training row, ``eval_text`` (folded) and ``mismatches`` of every near pair of a
    training row and a distinct evaluation text.

    Texts are compared without letter case and surrounding white space. A pair is near if the texts have one length and
    differ in at most ``max_mismatches`` places; with ``inside``, also if a passage of a longer training text does. Null
    texts match nothing; two empty texts are the same. The distinct evaluation texts are split by hash into shards of
    bounded size, each with an automaton of its own; all meet the training texts in one scan without shuffle. Training
    rows may be skewed in any way.
    """
    ids = [F.col(train_id).alias("train_id"), *keep]
    slim = train.select(folded(train_text).alias("_folded"), *ids)
    schema = T.StructType([*slim.schema.fields[1:], T.StructField("eval_text", T.StringType()), T.StructField("mismatches", T.IntegerType())])
    return _scans(slim, F.col("_folded"), ["train_id", *keep], eval_df, eval_text, texts_per_shard, schema, _Pairs(max_mismatches, inside))


def cross_split_overlaps(eval_df: DataFrame, eval_id: str, eval_text: str, train: DataFrame, train_id: str, train_text: str, max_mismatches: int = 2, inside: bool = False) -> DataFrame:
    """Every near pair: ``eval_id``, ``train_id``, ``mismatches``; see :func:`near_texts`."""
    near = near_texts(train, train_id, train_text, eval_df, eval_text, max_mismatches, inside=inside)
    names = eval_df.select(F.col(eval_id).alias("eval_id"), folded(eval_text).alias("eval_text"))
    return near.join(names, "eval_text").select("eval_id", "train_id", "mismatches")


def coverage(eval_df: DataFrame, eval_id: str, eval_text: str, train: DataFrame, train_id: str, train_text: str, max_mismatches: int = 2, inside: bool = False) -> DataFrame:
    """Per evaluation record: ``n_train`` rows near it, ``nearest`` mismatches (null if none) and ``covered``, the share of
    its letters that near training texts (``inside``: near passages of longer ones too) repeat unchanged.

    Each block of training texts merges its matched intervals before anything moves; the distinct intervals that are left
    are merged by one pass in order of their starts. There are at most as many as an evaluation text has pairs of places.
    Records without any near text have ``n_train`` 0 and ``covered`` 0; null texts have null ``covered``.
    """
    schema = T.StructType.fromDDL("eval_text string, n bigint, nearest int, spans array<struct<a: int, b: int>>")
    slim = train.select(folded(train_text).alias("_folded"))
    blocks = _scans(slim, F.col("_folded"), [], eval_df, eval_text, TEXTS_PER_SHARD, schema, _Spans(max_mismatches, inside))
    # One row per evaluation text and block brings its counts along with the first of its intervals.
    long = blocks.select("eval_text", "nearest", F.posexplode_outer("spans").alias("k", "s"), "n").select("eval_text", "nearest", F.when(F.coalesce("k", F.lit(0)) == 0, F.col("n")).otherwise(0).alias("n"), F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    distinct = long.groupBy("eval_text", "a", "b").agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"))
    upto = F.max("b").over(Window.partitionBy("eval_text").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(upto, F.lit(0))), F.lit(0))
    merged = distinct.withColumn("fresh", F.coalesce(fresh, F.lit(0))).groupBy("eval_text").agg(F.sum("n").alias("n_train"), F.min("nearest").alias("nearest"), F.sum("fresh").alias("letters"))
    names = eval_df.select(F.col(eval_id).alias("eval_id"), folded(eval_text).alias("eval_text"))
    n = F.length("eval_text")
    share = F.when(n > 0, F.coalesce("letters", F.lit(0)) / n).when(n == 0, F.lit(0.0))
    return names.join(merged, "eval_text", "left").select("eval_id", F.coalesce("n_train", F.lit(0)).cast("bigint").alias("n_train"), "nearest", share.alias("covered"))
