"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

BPE's result for a text's prefix ends in one token that is fixed by the prefix; the tokens before it are the result for
the shorter prefix. So a transducer that reads bytes tells for each byte the token that ends there: the one vocabulary
entry that BPE lets follow the last token of the prefix before it (two tokens may follow each other exactly if BPE gives
these two for their joined bytes). Its state is what the next tokens can depend on: the last bytes that begin some token,
and the last tokens at these places. What has been read is put out as soon as all ways the text can go on share it, which
is after at most as many bytes as the longest token has, or at the end of a word.

States and transitions are made when first needed and kept in a table of bounded size.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the transition table and of the table of whole words; a full table is emptied.
MAX_TRANSITIONS = 1_000_000
MAX_WORDS = 200_000
#: Bytes of a word after which what is settled is put out; letters of a text whose words are taken one by one.
LONG_WORD, LONG_TEXT = 4096, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file with one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """The transducer of one vocabulary, whose ids are also the order of the merges."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.size_of = {i: len(b) for b, i in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t))}  # proper ones
        self._built: dict[int, tuple[list[int], list[int], tuple[int, int]]] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: the last bytes that begin some token, and the last token of each prefix from the place before them on
        # (-1: the prefix is empty).
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        self.index = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, list[int]] = {}  # a blank and what follows up to the next
        self._follows: dict[int, bool] = {}
        # By the last bytes that begin a token, and one more: those of them that again begin one, and the tokens that end
        # here, each with the number of bytes before it.
        self.tails: dict[bytes, tuple[bytes, list[tuple[int, int]]]] = {}

    def _ends(self, token: int) -> tuple[list[int], list[int], tuple[int, int]]:
        """How BPE builds a token: the symbols at its left and right end as they come to be, and the last two parts."""
        known = self._built.get(token)
        if known is None:
            data, ranks = self.bytes_of[token], self.ranks
            parts = [data[i : i + 1] for i in range(len(data))]
            lefts, rights, split = [ranks[parts[0]]], [ranks[parts[-1]]], (-1, -1)
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                split = (ranks[parts[at]], ranks[parts[at + 1]])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    lefts.append(rank)
                if at == len(parts) - 1:
                    rights.append(rank)
            known = self._built[token] = (lefts, rights, split)
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE gives just ``a`` and ``b`` for their joined bytes: no merge crosses the border.

        A symbol at the border is there until the merge that takes it in. A crossing merge happens if it comes before both
        of these; of equal merges the one further left is first.
        """
        pair = a << 32 | b
        known = self._follows.get(pair)
        if known is not None:
            return known
        rights, lefts, ranks, bytes_of = self._ends(a)[1], self._ends(b)[0], self.ranks, self.bytes_of
        known = True
        for i, x in enumerate(rights):
            x_until = rights[i + 1] if i + 1 < len(rights) else 1 << 60
            for j, y in enumerate(lefts):
                made = ranks.get(bytes_of[x] + bytes_of[y])
                if made is not None and made < x_until and (j + 1 == len(lefts) or made <= lefts[j + 1]) and self._ends(made)[2] == (x, y):
                    known = False
                    break
            if not known:
                break
        self._follows[pair] = known
        return known

    def _number(self, state: tuple[bytes, tuple[int, ...]]) -> int:
        at = self.index.get(state)
        if at is None:
            at = self.index[state] = len(self.states)
            self.states.append(state)
        return at

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the token that ends with the byte."""
        begun, lasts = self.states[state]
        tail = begun + bytes((byte,))
        seen = self.tails.get(tail)
        if seen is None:
            n = len(tail)
            reach = next((k for k in range(n) if tail[k:] in self.prefixes), n)
            seen = self.tails[tail] = (tail[reach:], [(k, t) for k in range(n) if (t := self.ranks.get(tail[k:])) is not None])
        begins, endings = seen
        for before, token in endings:
            left = lasts[before]
            if left < 0 or self.follows(left, token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        made = self.steps[state << 8 | byte] = (self._number((begins, (*lasts, token)[-len(begins) - 1 :])), token)
        return made

    def _settled(self, ends: list[int], state: int) -> int:
        """How many of the bytes read are settled: where the ways back from all places that matter still have met."""
        n = len(ends)
        ways = {max(0, n - k) for k in range(len(self.states[state][0]) + 1)}
        while len(ways) > 1:
            at = max(ways)
            ways.remove(at)
            ways.add(at - self.size_of[ends[at - 1]])
        return ways.pop()

    def _out(self, ends: list[int], upto: int) -> list[int]:
        """The tokens of the first ``upto`` bytes; ``ends`` has the last token of each prefix."""
        out, size_of = [], self.size_of
        while upto:
            token = ends[upto - 1]
            out.append(token)
            upto -= size_of[token]
        out.reverse()
        return out

    def encode_word(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token. Of a long one, what is settled is put out every ``LONG_WORD`` bytes."""
        self._bound()
        if len(data) > LONG_WORD:
            return self._encode_long(data)
        state, ends, steps = 0, [], self.steps.get
        for byte in data:
            state, token = steps(state << 8 | byte) or self._step(state, byte)
            ends.append(token)
        return tuple(self._out(ends, len(ends)))

    def _encode_long(self, data: bytes) -> tuple[int, ...]:
        state, ends, out = 0, [], []
        for a in range(0, len(data), LONG_WORD):
            for byte in data[a : a + LONG_WORD]:
                state, token = self.steps.get(state << 8 | byte) or self._step(state, byte)
                ends.append(token)
            cut = self._settled(ends, state)
            out += self._out(ends, cut)
            del ends[:cut]
            now = self.states[state]
            self._bound()
            state = self._number(now)
        return tuple(out + self._out(ends, len(ends)))

    def _bound(self) -> None:
        if len(self.steps) > MAX_TRANSITIONS or len(self._follows) > MAX_TRANSITIONS or len(self.tails) > MAX_TRANSITIONS:
            self._reset()

    def encode(self, text: str | None, pattern: regex.Pattern, blanks_lead: bool = False) -> list[int]:
        """Ids of a text; null and the empty text give an empty list.

        ``blanks_lead`` says that a word of the pattern holds blanks only as its first letter, or is white space only, and
        that white space before a word leaves it the last blank. Then a text may be cut before every blank that no white
        space follows, and pieces met before need no pattern.
        """
        if not text:
            return []
        if not blanks_lead:
            return self._words(text, pattern)
        first, *rest = text.split(" ")
        if "" in rest:  # blanks in a row, or one at the end
            return self._words(text, pattern)
        out, pieces = self._words(first, pattern), self.pieces
        for piece in rest:
            ids = pieces.get(piece)
            if ids is None:
                if piece[0].isspace():
                    return self._words(text, pattern)
                ids = self._words(" " + piece, pattern)
                if len(piece) <= 64:
                    if len(pieces) >= MAX_WORDS:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out

    def _words(self, text: str, pattern: regex.Pattern) -> list[int]:
        out: list[int] = []
        # The words of a long text are not all held at once.
        for word in pattern.findall(text) if len(text) < LONG_TEXT else (m.group() for m in pattern.finditer(text)):
            ids = self.words.get(word)
            if ids is None:
                ids = self.encode_word(word.encode("utf-8"))
                if len(word) <= 64:
                    if len(self.words) >= MAX_WORDS:
                        self.words.clear()
                    self.words[word] = ids
            out += ids
        return out


_KEPT: dict[str, Transducer] = {}


def _kept(name: str, ranks: dict[bytes, int]) -> Transducer:
    """This process's transducer for a vocabulary: what one task has determinised serves the tasks after it."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Transducer(ranks)
    return _KEPT[name]


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes], errors: str = "strict") -> Iterator[str]:
    """Text of a stream of ids, piece by piece; a character whose bytes lie in several tokens comes with the last one.

    The incremental UTF-8 decoder holds at most three bytes of an unfinished character. With ``errors="strict"``, bytes
    that are no UTF-8, and a character left unfinished at the end, raise ``UnicodeDecodeError``; an unknown id raises
    ``KeyError``.
    """
    machine = codecs.getincrementaldecoder("utf-8")(errors)
    for i in ids:
        if piece := machine.decode(bytes_of[i]):
            yield piece
    if piece := machine.decode(b"", final=True):
        yield piece


def encode_column(df: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int], pattern: str, blanks_lead: bool = False) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row, without special tokens; null and empty texts have no ids.

    For ``blanks_lead`` see :meth:`Transducer.encode`.

    The vocabulary (a megabyte) is broadcast. One pass, no shuffle; whole texts of any length, each row on its own.
    """
    held = df.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.md5(repr(sorted(ranks.items())).encode()).hexdigest()
    slim = df.select(id_col, F.col(text_col).alias("_text"))
    kind = slim.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, words = _kept(name, held.value), regex.compile(pattern)
        gc.disable()  # the tables, bounded and without cycles, would be gone through again and again
        try:
            for b in batches:
                for at in range(0, max(b.num_rows, 1), 500):
                    part = b.slice(at, 500)
                    ids = pa.array([machine.encode(t.as_py(), words, blanks_lead) for t in part.column(1)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])
        finally:
            gc.enable()

    return slim.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_column(df: DataFrame, id_col: str, ids_col: str, ranks: dict[bytes, int]) -> DataFrame:
    """``id_col`` and ``text`` of every row of ids; a null list gives a null text, an empty one the empty text."""
    held = df.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})
    slim = df.select(id_col, F.col(ids_col).alias("_ids"))
    kind = slim.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = held.value
        for b in batches:
            texts = [None if x is None else "".join(decode_stream(x, bytes_of)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return slim.mapInArrow(run, f"`{id_col}` {kind}, text string")
