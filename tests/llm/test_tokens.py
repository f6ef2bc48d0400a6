"""Encoders of texts: what they hold in memory, what they hand to the library, and ids against the library's own."""

from __future__ import annotations

import base64
import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from dockflow.llm import bpe, lm, packing, token_files, tokens
from tokenizers import Tokenizer

BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
WORD_JSON = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def odd_words(n: int = 3000) -> list[str]:
    rng = random.Random(3)
    parts = [*"abcXYZ  .,\n\n'0123-_", *"éÉßİıªµºÅØ×÷ǅɏɐə", "́", "\xa0", " ", "\x1c", "\t", "\r", "日", "а", "Σ", "ς"]
    parts += ["'s", "'ll", "<|endoftext|>", "Ġ", "</w>", "\x00", "Å", "that.\nAnd ", "É.,\nb., "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*texts, "", " ", "a ", "a\nb c\nd. e.\nF,. g\n\nh", "x " * 3, "a" * 300 + " " + "b" * 150 + ".,", ".,\n.,"]


def words(n: int, at: int = 0) -> list[str]:
    return ["".join(chr(97 + (k // 26**i) % 26) for i in range(5)) for k in range(at, at + n)]


def check_ids(encode, path: str, texts: list[str]) -> None:
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_ids_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 4000)
    texts = odd_words()
    byte_level, word_level = tokens.ByteLevelEncoder(BYTE_JSON), tokens.WordEncoder(WORD_JSON)
    for part in (byte_level.after_blank, byte_level.alone, word_level.words):
        part.table.limit = 3000  # gives way again and again
    check_ids(byte_level.encode_many, BYTE_JSON, texts)
    check_ids(lambda t: word_level.encode_many([x.encode() for x in t]), WORD_JSON, texts)


def test_a_table_of_ids_is_bounded_in_bytes_and_keeps_what_comes_again():
    asked = []

    def compute(strings: pa.Array) -> tokens.Runs:
        asked.extend(strings.to_pylist())
        return tokens.joined([s.encode() for s in strings.to_pylist()], "u1")

    table = tokens.IdTable(compute, "u1", limit=20_000)
    for at in range(0, 20_000, 200):
        often = ["again", "and again"]
        place = table.find(pa.array([*often, *words(200, at)]))
        starts = tokens.starts_of(table.sizes)[place]
        assert bytes(tokens.gathered(table.ids, starts, table.sizes[place])).decode() == "".join([*often, *words(200, at)])
        assert table.weight() <= 20_000 + 200 * 40
    assert asked.count("again") == 1 and len(asked) == 20_002
    # One entry takes a fraction of what two objects and a slot of a dict take.
    table = tokens.IdTable(compute, "u1", limit=1 << 20)
    table.find(pa.array(words(20_000)))
    assert table.weight() < 20_000 * 40


def test_packing_holds_no_words_while_it_cuts(monkeypatch):
    """the pass that cuts sequences runs in workers that have encoded before."""
    encoder = tokens.byte_level(BYTE_JSON)
    encoder.encode_many(["some words here\nand there, again"])
    assert len(encoder.after_blank.table.keys) and len(encoder.alone.table.keys)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    assert list(packing._cut(iter([]))) == []
    assert not any(len(m.keys) for m in encoder.memos if isinstance(m, tokens.IdTable)) and not encoder.after_blank.stops


def test_words_of_letters_skip_the_pattern():
    """a word is encoded once, whatever stops follow it and whatever slice it is in."""
    encoder, lines = tokens.WordEncoder(WORD_JSON), []
    own = encoder.words.matched
    encoder.words.matched = SimpleNamespace(encode_batch_fast=lambda t, **k: lines.extend(t) or own.encode_batch_fast(t, **k))
    encoder.words.tokenizer = None
    encoder.words.stops.update({".": b"", "..,": b""})
    for text in (b"Word. word..,  other\n", b"other. WORD word"):
        encoder.encode_many([text])
    assert sorted(" ".join(lines).split()) == ["other", "word"]


def test_reading_token_files_holds_no_words():
    encoder = token_files.word_level(WORD_JSON)
    encoder.encode_many([b"some words"])
    assert len(encoder.words.table.keys) and list(token_files._documents(iter([]))) == []
    assert not len(encoder.words.table.keys)


def test_a_block_is_read_in_runs_of_documents(monkeypatch):
    """documents that follow each other are decoded together."""
    parts = [np.random.default_rng(n).integers(0, 40, n).astype(np.uint16) for n in [1, 3000, 1, 70, *range(1, 1500)]]
    symbols, left, right, lengths = token_files.compress(np.concatenate(parts))
    names, one = ["symbols", "left", "right", "lengths"], lambda v, t: pa.array([v], t)
    payload = [one(x.tobytes(), pa.binary()) for x in (symbols, left, right, lengths)]
    arrays = [*payload, one(list(range(len(parts))), pa.list_(pa.int64())), one([len(p) for p in parts], pa.list_(pa.int64()))]
    row = pa.RecordBatch.from_arrays([*arrays, pa.array([10])], [*names, "keys", "sizes", "first"])
    calls, ids = [], token_files.BlockReader.ids
    monkeypatch.setattr(token_files.BlockReader, "ids", lambda self, a, b: calls.append(a) or ids(self, a, b))
    got = [r for b in token_files._documents(iter([row])) for r in b.to_pylist()]
    assert [r["key"] for r in got] == list(range(len(parts))) and len(calls) == 2
    for r, part, end in zip(got, parts, np.cumsum([len(p) for p in parts]).tolist(), strict=True):
        assert (r["start"], r["n_tokens"]) == (10 + end - len(part), len(part))
        assert np.frombuffer(r["ids"], "<u4").tolist() == part.tolist()


def test_subwords_of_many_words_stay_below_their_bound():
    """the words that a worker of op7 remembers take the bytes they are bounded by, not several times as many."""
    own = lm.Subwords(BYTE_JSON)
    own.words.table.limit = 100_000
    for at in range(0, 20_000, 1000):
        own.split_many([" ".join(words(1000, at)).encode()])
        assert sum(m.weight() for m in own.memos if isinstance(m, tokens.IdTable)) <= 100_000 + 1000 * 60


def test_bpe_of_odd_words_with_tables_that_give_way(monkeypatch):
    """blocks of new pre-tokens are merged together; equal ones once, also across slices."""
    monkeypatch.setattr(tokens, "SLICE", 4000)
    monkeypatch.setattr(bpe, "BLOCK", 300)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    merged, texts = [], odd_words()
    merge = codec.merged
    codec.merged = lambda pieces: merged.extend(pieces) or merge(pieces)
    for text, ids in zip(texts, codec.encode_many(texts), strict=True):
        assert ids.tolist() == own.encode_ordinary(text) and codec.decode(ids) == text.encode()
    assert merged and len(merged) == len(set(merged))
    codec.pieces.limit = codec.after_blank.limit = 5000
    for text, ids in zip(texts, codec.encode_many(texts), strict=True):
        assert ids.tolist() == own.encode_ordinary(text)


def test_a_byte_without_a_rank_is_an_error():
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    codec.ranks = {k: v for k, v in codec.ranks.items() if k != b"q"}
    try:
        codec.merge([b"qx"])
    except KeyError:
        return
    raise AssertionError("no error")


def test_a_queue_takes_several_positions_at_once():
    queue = bpe.RankQueue(5000)
    queue.push(70, [5, 9])
    queue.push(70, 7)
    queue.push(3, np.array([4, 2]).tolist())
    assert [queue.pop(), queue.pop(), queue.pop()] == [(3, [2, 4]), (70, [5, 7, 9]), None]
