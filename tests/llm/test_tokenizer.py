import os
import random

import pytest
import regex

from rankstead.llm import queries, tokenizer

VOCABULARY = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def machine():
    return tokenizer.Transducer(tokenizer.read_ranks(VOCABULARY)), regex.compile(queries.SPLIT_PATTERN)


def texts():
    rnd = random.Random(7)
    letters = list("abcdefghij  \n\t'se\"<|endoftext|>=-#ÄÖß漢字かなกำ👨‍🔬  ́﻿0123456789²Ⅳ\r\x00\x85ACGT")
    out = ["", " ", "don't we'll THEY'RE", "a" * 3000, "=" * 1000, " " * 700, "\n" * 300, "ACDEFGHIKL" * 300, "<|endoftext|>", "naïve cöperative ﬁt"]
    out += ["".join(rnd.choices(letters, k=rnd.randint(0, 50))) for _ in range(3000)]
    return out + ["".join(chr(rnd.choice([rnd.randint(32, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(15)) for _ in range(500)]


def test_ids_equal_the_library_and_decode_back(machine):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    m, pattern = machine
    for text, want in zip(texts(), t.encode_batch(texts(), add_special_tokens=False)):
        ids = m.encode(text, pattern)
        assert ids == want.ids == m.encode(text, pattern, blanks_lead=True)
        assert "".join(tokenizer.decode_stream(ids, m.bytes_of)) == text


def test_pieces_between_blanks_give_the_same_ids(machine):
    m, pattern = machine
    rnd = random.Random(11)
    for _ in range(4000):
        text = "".join(rnd.choices(["a", "bc", " ", " ", "\n", "\t", "\u00a0", "\u2009", "1", "'s", ".", "é", "\x1c", "\r\n"], k=rnd.randint(0, 14)))
        assert m.encode(text, pattern, blanks_lead=True) == m.encode(text, pattern), repr(text)


def test_long_words_are_put_out_on_the_way(machine, monkeypatch):
    m, pattern = machine
    rnd = random.Random(12)
    words = ["".join(rnd.choices("ACDEFGHIKLMNPQRSTVWYacd", k=n)) for n in (50, 99, 500)] + ["=" * 300, "ab" * 150]
    want = [m.encode(w, pattern) for w in words]
    monkeypatch.setattr(tokenizer, "LONG_WORD", 7)
    monkeypatch.setattr(tokenizer, "LONG_TEXT", 10)
    m.words.clear()
    assert [m.encode(w, pattern) for w in words] == want
    monkeypatch.setattr(tokenizer, "MAX_TRANSITIONS", 20)
    m.words.clear()
    assert [m.encode(w, pattern) for w in words] == want


def test_tables_may_be_emptied_at_any_time(machine, monkeypatch):
    m, pattern = machine
    sample = texts()[:200]
    want = [m.encode(t, pattern) for t in sample]
    monkeypatch.setattr(tokenizer, "MAX_TRANSITIONS", 5)
    monkeypatch.setattr(tokenizer, "MAX_WORDS", 3)
    assert [m.encode(t, pattern) for t in sample] == want


def test_streaming_splits_characters(machine):
    m, _ = machine
    raw = "漢👨é".encode()
    pieces = list(tokenizer.decode_stream([m.ranks[bytes([b])] for b in raw], m.bytes_of))
    assert pieces == ["漢", "👨", "é"]
    with pytest.raises(UnicodeDecodeError):
        list(tokenizer.decode_stream([m.ranks[raw[:1]]], m.bytes_of))


def test_frame_edges(spark, machine):
    m, pattern = machine
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "abc", 0), (3, "abc", 0), (4, "xyz " * 50_000, 0)], "doc_id int, text string, ids int")
    out = tokenizer.encode_column(df, "doc_id", "text", m.ranks, queries.SPLIT_PATTERN)
    got = sorted((r["doc_id"], len(r["ids"])) for r in out.collect())
    assert got[:4] == [(1, 0), (2, 0), (3, len(m.encode("abc", pattern)))] + [(3, len(m.encode("abc", pattern)))]
    back = {r["doc_id"]: r["text"] for r in tokenizer.decode_column(out, "doc_id", "ids", m.ranks).collect()}
    assert back == {1: "", 2: "", 3: "abc", 4: "xyz " * 50_000}
    assert tokenizer.encode_column(df.limit(0), "doc_id", "text", m.ranks, queries.SPLIT_PATTERN).count() == 0
