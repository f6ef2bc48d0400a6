"""Encoding whole texts with a public tokenizer, each distinct word of a slice once.

The vocabulary file's path is a parameter: every executor reads its own copy of the file. Texts are cut only where both
sides encode independently, so the ids are those of the whole text. Arrow splits the texts and numbers their distinct
words; ids of words are kept in a bounded table from slice to slice and spread over the places by numpy.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dockflow.llm.common import Memo

#: Bytes of a table of words.
MEMO = 40 << 20
#: Bytes of text that are split at once.
SLICE = 6 << 20
#: White space before a blank, as `str.isspace` has it.
_BLANK_AFTER_SPACE = "[\t-\r\x1c- \x85\xa0  -     　] "
#: Latin letters, each a letter to any version of Unicode, composed, and of one lower-case letter.
_LETTERS = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]"
_WORD, _WORD_BEFORE = f"^{_LETTERS}+$", f"^{_LETTERS}+"
_TWO_LINES = rf"^(?P<a>{_LETTERS}+)(?P<b>[.,]*)\n(?P<c>{_LETTERS}+)(?P<d>[.,]*)$"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # such a string in a text is ordinary text
    if found.get_vocab_size() > 1 << 16:
        raise ValueError(f"{path}: ids above 65535 need a wider type")
    return found


@lru_cache(maxsize=4)
def matched(path: str):
    """The same model over lines of matches of its pattern, which are spelled in the byte-level alphabet."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.normalizer, found.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
    return found


def _alphabet() -> dict[int, str]:
    """The byte-level character of each byte but the blank."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden) if b != 32}


_ALPHABET = _alphabet()
BLANK = "Ġ"


def spelled(line: str) -> str:
    """A line of words in the byte-level alphabet, its blanks kept."""
    return line if line.isascii() else line.encode().decode("latin-1").translate(_ALPHABET)


Runs = tuple[np.ndarray, np.ndarray]  # ids one after the other, and how many each string has


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of `sizes` ids from `starts` on, one after the other."""
    shift = (starts - (np.cumsum(sizes) - sizes)).astype(np.int32 if len(ids) < 1 << 30 and sizes.sum() < 1 << 30 else np.int64)
    at = np.repeat(shift, sizes)
    at += np.arange(len(at), dtype=at.dtype)
    return ids.take(at)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def joined(found: list[bytes], kind: str) -> Runs:
    ids = np.frombuffer(b"".join(found), kind)
    return ids, np.array([len(f) for f in found], np.int64) // ids.itemsize


class IdTable:
    """Ids of strings, computed once, as Arrow keys beside one array, bounded in bytes.

    A table beyond `limit` bytes keeps what was looked up again after it came, or nothing where that fills half of it; it
    holds at most `limit` and what the last slice brought.
    """

    def __init__(self, compute: Callable[[pa.Array], Runs], kind: str = "<u2", limit: int = MEMO):
        self.compute, self.kind, self.limit = compute, kind, limit
        self.forget()
        Memo.alive.add(self)

    def forget(self) -> None:
        self.keys, self.ids = pa.array([], pa.string()), np.zeros(0, self.kind)
        self.sizes, self.again = np.zeros(0, np.int64), np.zeros(0, bool)

    def weight(self) -> int:
        return self.keys.nbytes + self.ids.nbytes + self.sizes.nbytes + self.again.nbytes

    def _trim(self) -> None:
        kept = np.flatnonzero(self.again)
        starts, sizes = starts_of(self.sizes)[kept], self.sizes[kept]
        keys, ids = self.keys.take(pa.array(kept)), gathered(self.ids, starts, sizes)
        self.forget()
        if 2 * (keys.nbytes + ids.nbytes + 9 * len(keys)) <= self.limit:
            self.keys, self.ids, self.sizes, self.again = keys, ids, sizes, np.zeros(len(keys), bool)

    def find(self, strings: pa.Array) -> np.ndarray:
        """The places of distinct strings in the table, which hold until the next call."""
        if self.weight() > self.limit:
            self._trim()
        at = pc.index_in(strings, value_set=self.keys)
        place = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(place < 0)
        self.again[place[place >= 0]] = True
        if len(missing):
            new = strings.take(pa.array(missing))
            ids, sizes = self.compute(new)
            place[missing] = len(self.keys) + np.arange(len(missing))
            self.keys = pa.concat_arrays([self.keys, new])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.again = np.append(self.again, np.zeros(len(missing), bool))
        return place


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, A-Z lower-cased, one after the other, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    words, counts = parts.flatten(), parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)  # of a text without words
    if empty.any():
        counts -= np.diff(np.concatenate([[0], np.cumsum(empty)])[np.concatenate([[0], np.cumsum(counts)])])
        words = words.filter(pa.array(~empty))
    return words, counts


def cut(runs: Runs, counts: np.ndarray) -> list[np.ndarray]:
    """The ids of each text of so many words."""
    ends = np.concatenate([[0], np.cumsum(runs[1])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [runs[0][a:b] for a, b in zip(ends, ends[1:])]


def in_slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about `SLICE` bytes, with the place of the first; NULL is empty. One text is never cut."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(at, at[1:]):
        if a < b:
            yield a, texts.slice(a, b - a)


def _id_bytes(found: list) -> list[bytes]:
    return [array("H", e.ids).tobytes() for e in found]


#: Words of letters that are encoded in one call, and the longest of them.
TOGETHER, LONG_WORD = 200, 100


def encode_words(encoder, words: list[str], lead: str) -> list[bytes]:
    """Ids of each word behind `lead`. Words of letters alone are one match of either tokenizer's pattern, so a line of
    them is encoded at once and cut by the number of the match; lines where that gives other words are encoded singly."""
    found: dict[str, bytes] = {}
    plain = [w for w in words if len(w) <= LONG_WORD and w.isalpha()]
    lines = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
    whole = encoder.encode_batch([lead + " ".join(line) for line in lines], add_special_tokens=False) if lines else []
    for line, e in zip(lines, whole):
        cuts = np.flatnonzero(np.diff(np.array(e.word_ids))) + 1
        if len(cuts) + 1 == len(line):
            ids = array("H", e.ids).tobytes()
            at = [0, *(2 * cuts).tolist(), len(ids)]
            found.update(zip(line, (ids[a:b] for a, b in zip(at, at[1:]))))
    rest = [w for w in words if w not in found]
    if rest:
        found.update(zip(rest, _id_bytes(encoder.encode_batch_fast([lead + w for w in rest], add_special_tokens=False))))
    return [found[w] for w in words]


class Words:
    """Ids of words behind `lead`, with full stops and commas behind letters taken as a match of their own.

    Words of Latin letters are one match of any pattern, so lines of them skip the pattern: behind a blank a word begins
    where an id does that starts with one; a vocabulary with a suffix of words ends them; else a blank parts them. Lines
    where that gives other words are encoded singly.
    """

    def __init__(self, path: str, lead: str, folded: bool = False):
        self.tokenizer, self.matched, self.lead, self.folded = tokenizer(path), matched(path), lead, folded
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.suffix = self.tokenizer.model.end_of_word_suffix
        self.first = np.array([n.startswith(BLANK) for n in names])
        self.last = np.array([bool(self.suffix) and n.endswith(self.suffix) for n in names])
        self.blank = self.tokenizer.token_to_id(BLANK)
        self.table = IdTable(self._computed)
        self.stops = Memo(lambda stops: self._encode([stops])[0], 1 << 16)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return _id_bytes(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _line(self, words: list[str]) -> str:
        line = spelled(" ".join(words).lower() if self.folded else " ".join(words))
        if self.suffix:
            return line
        return BLANK + line.replace(" ", f" {BLANK}") if self.lead else line.replace(" ", f" {BLANK} ")

    def _sizes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a line without those that part words, and how many each word has."""
        if self.suffix:
            return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if self.lead:
            return ids, np.diff(np.flatnonzero(self.first[ids]), append=len(ids))
        between = ids == self.blank
        return ids[~between], np.diff(np.flatnonzero(between), prepend=-1, append=len(ids)) - 1

    def _of_letters(self, words: list[str]) -> Runs:
        lines = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for line, e in zip(lines, self.matched.encode_batch_fast(list(map(self._line, lines)), add_special_tokens=False)):
            own, n = self._sizes(np.frombuffer(array("H", e.ids), np.uint16))
            if len(n) != len(line) or n.sum() != len(own) or not n.all():
                own, n = joined(self._encode([self.lead + w for w in line]), "<u2")
            ids.append(own)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _computed(self, words: pa.Array) -> Runs:
        plain = pc.match_substring_regex(words, _WORD).to_numpy(zero_copy_only=False)
        plain &= pc.binary_length(words).to_numpy(zero_copy_only=False) <= LONG_WORD
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        a = self._of_letters(words.filter(pa.array(plain)).to_pylist())
        b = joined(encode_words(self.tokenizer, words.filter(pa.array(~plain)).to_pylist(), self.lead), "<u2")
        ids, sizes = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        back = np.argsort(order)
        return gathered(ids, starts_of(sizes)[back], sizes[back]), sizes[back]

    def cores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and of each word where its two runs begin and how long they are: letters and what stands behind, or the word."""
        core = pc.ascii_rtrim(words, ".,")
        plain = pc.and_(pc.match_substring_regex(core, _WORD), pc.not_equal(core, words))
        coded = pc.if_else(plain, core, words).dictionary_encode()
        place = self.table.find(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        behind = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        tails = pc.replace_substring_regex(words.take(pa.array(behind)), _WORD_BEFORE, "").dictionary_encode()
        ids, sizes = joined([self.stops[t] for t in tails.dictionary.to_pylist()], "<u2")
        at = tails.indices.to_numpy(zero_copy_only=False)
        starts, lengths = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        starts[:, 0], lengths[:, 0] = starts_of(self.table.sizes)[place], self.table.sizes[place]
        starts[behind, 1], lengths[behind, 1] = (starts_of(sizes) + len(self.table.ids))[at], sizes[at]
        return np.concatenate([self.table.ids, ids]), starts, lengths

    def runs(self, words: pa.Array) -> Runs:
        """Ids of distinct words."""
        ids, starts, sizes = self.cores(words)
        return gathered(ids, starts.ravel(), sizes.ravel()), sizes.sum(1)


class ByteLevelEncoder:
    """Ids of texts under a byte-level vocabulary, as 16-bit arrays."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.after_blank, self.alone = Words(path, " "), Words(path, "")
        self.memos = [m for w in (self.after_blank, self.alone) for m in (w.table, w.stops)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return _id_bytes(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _runs(self, found: pa.Array) -> Runs:
        """Ids of distinct chunks, each behind a blank. One line feed between letters, or stops, is a match of its own."""
        parts = pc.extract_regex(found, _TWO_LINES)
        two = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        at, a, b = np.flatnonzero(two), pc.struct_field(parts, "a"), pc.struct_field(parts, "b")
        first = pc.if_else(pa.array(two), pc.binary_join_element_wise(a, b, ""), found)
        coded = first.dictionary_encode()
        ids, sizes = self.after_blank.runs(coded.dictionary)
        place = coded.indices.to_numpy(zero_copy_only=False)
        c, d = (pc.struct_field(parts, k).take(pa.array(at)) for k in "cd")
        coded = pc.binary_join_element_wise(c, d, "").dictionary_encode()
        next_ids, next_sizes = self.alone.runs(coded.dictionary)
        feed = np.frombuffer(self.alone.stops["\n"], "<u2")
        starts, lengths = np.zeros((len(found), 3), np.int64), np.zeros((len(found), 3), np.int64)
        starts[:, 0], lengths[:, 0] = starts_of(sizes)[place], sizes[place]
        starts[at, 1], lengths[at, 1] = len(ids), len(feed)
        place = coded.indices.to_numpy(zero_copy_only=False)
        starts[at, 2], lengths[at, 2] = starts_of(next_sizes)[place] + len(ids) + len(feed), next_sizes[place]
        return gathered(np.concatenate([ids, feed, next_ids]), starts.ravel(), lengths.ravel()), lengths.sum(1)

    def encode_slice(self, texts: pa.Array) -> list[np.ndarray]:
        return by_chunks(texts, lambda heads: joined(self._encode(heads), "<u2"), self._runs)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        return [ids for _, part in in_slices(pa.array(texts, pa.string())) for ids in self.encode_slice(part)]


def by_chunks(texts: pa.Array, whole: Callable[[list[str]], Runs], behind: Callable[[pa.Array], Runs]) -> list[np.ndarray]:
    """Ids of texts cut before each blank, blanks left out: a byte-level pattern starts a new match at a blank that a word
    follows, and at one that follows a word. `whole` encodes what stands before the first blank, and texts where blanks meet
    other white space; `behind` encodes distinct chunks, each behind a blank."""
    meets = pc.match_substring_regex(texts, _BLANK_AFTER_SPACE)
    parts = pc.split_pattern(pc.if_else(meets, "", texts), " ")
    counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, first = parts.flatten(), starts_of(counts)
    heads = pc.if_else(meets, texts, flat.take(pa.array(first)))
    ids, sizes = whole(heads.to_pylist())
    rest = np.ones(len(flat), bool)
    rest[first] = False
    coded = flat.filter(pa.array(rest)).dictionary_encode()
    next_ids, next_sizes = behind(coded.dictionary)
    at = coded.indices.to_numpy(zero_copy_only=False)
    starts, lengths = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
    starts[first], lengths[first] = starts_of(sizes), sizes
    starts[rest], lengths[rest] = starts_of(next_sizes)[at] + len(ids), next_sizes[at]
    return cut((gathered(np.concatenate([ids, next_ids]), starts, lengths), lengths), counts)


class WordEncoder:
    """Ids of texts under a vocabulary whose pre-tokens never hold white space and whose case is folded."""

    def __init__(self, path: str):
        self.words = Words(path, "", folded=True)
        self.memos = [self.words.table, self.words.stops]

    def encode_slice(self, texts: pa.Array) -> list[np.ndarray]:
        words, counts = words_of(texts)
        coded = words.dictionary_encode()
        ids, sizes = self.words.runs(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        return cut((gathered(ids, starts_of(sizes)[at], sizes[at]), sizes[at]), counts)

    def encode_many(self, texts: list[bytes]) -> list[np.ndarray]:
        return [ids for _, part in in_slices(pa.array(texts, pa.binary())) for ids in self.encode_slice(part)]


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


@lru_cache(maxsize=2)
def word_level(path: str) -> WordEncoder:
    return WordEncoder(path)
