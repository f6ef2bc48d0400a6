"""Collocations: phrases of two to five words counted in tiles of frequency-ranked ids, level by level.

Words that occur often enough get ids by rank of their count, texts become runs of ids with breaks at piece ends, and
pairs (id of the first words, id of the last word) are counted. A buffer of pairs is split into tiles of `TILE` x `TILE`
ids: a tile that holds many of them is counted by one dense bincount at its direct addresses, all others as sorted
coordinates. Pairs that are frequent are ranked and become ids of the next level, so phrases of m words are pairs of a
phrase of m - 1 words and a word; only positions whose both parts of m - 1 words are frequent take part, which loses
nothing, as no phrase is more frequent than its parts. Counts leave a task merged; Spark sums them.

Tables of ids are sent to the tasks, so their size is bounded: `WORDS` words and `PHRASES` phrases of each length, the
most frequent first. What is not in a full table may still be frequent; such words and phrases are counted by their
spelling, in the same pass and the same sum, so no result depends on the bounds. Marks of bounded size tell which these
may be: all frequent words and phrases have their bit set, so that what is surely rare is left out beside full tables, too.

A phrase's best cut joins the counts of its parts; phrases contained in a longer one of the same count are dropped (the
longer one need only have one word more: a phrase between the two would have that count, too). Arithmetic is in integers
and 38-digit decimals.

Defined results: A-Z only is lower-cased; NULL and empty texts have no words; documents without a language belong to
`und`. Repeated rows count each time. Very long texts are read in slices, of which no phrase sees the border. Equal
scores and counts are ordered by the bytes of the phrase. Languages without a frequent phrase, and an empty table, give
no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.session import staged

WORDS = 1 << 18
PHRASES = 1 << 19
LONGEST = 5
TILE = 1024
#: A tile with this share of its cells seen in one buffer is counted densely.
DENSE = 1 / 16
BUFFER = 1 << 20
SLICE = 1 << 20
DISTINCT = 250_000
#: Bits of a table of marks, two primes: the first one while it has 64 for each mark.
MARKS = 999_983, 99_999_989

#: States of a position that has no id: no frequent phrase starts here, or one may that no table knows.
DEAD, UNKNOWN = -1, -2
#: Width of an id in a packed pair.
BITS = 21

_BLANK = re.compile(rb"[ \t]")
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t" + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 10)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text with b"\\n" at ends of pieces, in lists of bounded size; b"" may lie between."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + SLICE < end:
            space = _BLANK.search(text, at + SLICE)
            end = space.start() if space else end
        yield text[at:end].translate(_LOWER).replace(b"\n", b" \n ").split(b" ")
        at = end


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Languages and their texts, joined by line ends to about one slice each."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: Counter = Counter()
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
        held[lang].append(text.as_py() or b"")
        sizes[lang] += len(held[lang][-1])
        if sizes[lang] >= SLICE:
            yield lang, b"\n".join(held.pop(lang))
            sizes[lang] = 0
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def _spelled(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """Rows of counts by language and spelling; the counters are emptied."""
    for lang, counter in counts.items():
        counter.pop(b"", None)
        counter.pop(b"\n", None)
        items = list(counter.items())
        for at in range(0, len(items), 50_000):
            phrases, n = zip(*items[at : at + 50_000])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(n), pa.int64()),
                    pa.array([lang] * len(n)),
                    pa.array(phrases, pa.binary()).cast(pa.string()),
                    pa.array(n, pa.int64()),
                ],
                ["pair", "lang", "phrase", "n"],
            )
    counts.clear()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in _by_language(batch):
            for words in tokens(text):
                counts[lang].update(words)
                if sum(map(len, counts.values())) > DISTINCT:
                    yield from _spelled(counts)
    yield from _spelled(counts)


class Marks:
    """Numbers by their remainders, a bit each: one whose bit is not set is none of them."""

    def __init__(self, size: int, bits: bytes):
        self.size, self.bits = size, bits

    def __contains__(self, number: int) -> bool:
        at = number % self.size
        return bool(self.bits[at >> 3] >> (at & 7) & 1)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers % self.size
        return (np.frombuffer(self.bits, np.uint8)[at >> 3] >> (at & 7) & 1).astype(bool)


def marks(numbers: DataFrame, number: str) -> Marks:
    """The marks of an expression of a table; what is collected is bounded by their size."""
    size = next((m for m in MARKS if 64 * numbers.count() <= m), MARKS[-1])
    at = numbers.select(F.expr(f"CAST(pmod({number}, {size}) AS LONG)").alias("at"))
    words = at.groupBy(F.expr("at DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))
    found, bits = words.toArrow(), np.zeros(size // 64 + 1, "<i8")
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return Marks(size, bits.tobytes())


#: The number of a spelled word or phrase, here and in Python.
SPELLED = "crc32(concat(lang, phrase))"


def spelled_number(lang: str, phrase: bytes) -> int:
    return zlib.crc32(phrase, zlib.crc32(lang.encode()))


class Ids(dict):
    """Id of each word of a language. Others are dead, or unknown where the marks of all frequent words have them."""

    def __init__(self, known: dict[bytes, int], frequent: Marks | None, lang: str):
        super().__init__(known)
        self.frequent, self.lang = frequent, lang

    def __missing__(self, word: bytes) -> int:
        return UNKNOWN if self.frequent and spelled_number(self.lang, word) in self.frequent else DEAD


def _encode(words):
    """Runs of ids, one for each slice; words that may be frequent without an id are kept by their spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, full = words.value
        skip, tables = len(known) + 1, {}
        empty = lambda lang: Ids({b"": skip, b"\n": DEAD}, full, lang)
        for i, (lang, word) in enumerate(known):
            if lang not in tables:
                tables[lang] = empty(lang)
            tables[lang][word] = i
        for batch in batches:
            for lang, text in _by_language(batch):
                table, whole, spelled = tables.get(lang) or empty(lang), [np.zeros(0, np.int32)], []
                for found in tokens(text):
                    ids = np.fromiter(map(table.__getitem__, found), np.int32, len(found))
                    if full:
                        spelled += [found[i] for i in np.flatnonzero(ids == UNKNOWN)]
                    whole.append(ids[ids != skip])
                ids = np.concatenate(whole)
                ids = ids[~((ids == DEAD) & np.r_[True, ids[:-1] == DEAD])]  # one break is enough
                if len(ids):
                    others = pa.array([spelled], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
                    runs = pa.array([ids.astype("<i4").tobytes()])
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), runs, others], ["lang", "ids", "others"])

    return run


class Pairs:
    """Ranks of the frequent pairs of one level: a table by direct address for the lowest tile, search elsewhere.

    `frequent` has all frequent pairs where the table does not, `spelled` those phrases that are no pair of ids.
    """

    def __init__(self, pairs: np.ndarray, frequent: Marks | None = None, spelled: Marks | None = None):
        order = np.argsort(pairs)
        self.keys, self.ranks, self.frequent, self.spelled = pairs[order], order.astype(np.int32), frequent, spelled
        a, b = pairs >> BITS, pairs & ((1 << BITS) - 1)
        near = (a < TILE) & (b < TILE)
        self.lowest = np.full(TILE * TILE, DEAD, np.int32)
        self.lowest[a[near] * TILE + b[near]] = np.flatnonzero(near)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), DEAD, np.int32)
        near = (a < TILE) & (b < TILE)
        out[near] = self.lowest[a[near].astype(np.int64) * TILE + b[near]]
        far = np.flatnonzero(~near)
        if len(far) and len(self.keys):
            pairs = (a[far].astype(np.int64) << BITS) | b[far]
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            out[far] = np.where(self.keys[at] == pairs, self.ranks[at], DEAD)
        if self.frequent:
            rest = np.flatnonzero(out == DEAD)
            out[rest[self.frequent.has((a[rest].astype(np.int64) << BITS) | b[rest])]] = UNKNOWN
        return out


def count_tiles(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed pairs and their counts: dense tiles by bincount, the rest by sorted coordinates."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    across = int(b.max()) // TILE + 1
    tile = (a // TILE) * across + b // TILE
    is_dense = np.bincount(tile) >= DENSE * TILE * TILE
    pairs, counts = [], []
    for t in np.flatnonzero(is_dense):
        inside = tile == t
        cells = np.bincount((a[inside] % TILE) * TILE + b[inside] % TILE, minlength=TILE * TILE)
        seen = np.flatnonzero(cells)
        pairs.append(((t // across * TILE + seen // TILE) << BITS) | (t % across * TILE + seen % TILE))
        counts.append(cells[seen])
    rest = ~is_dense[tile]
    coordinates, n = np.unique((a[rest] << BITS) | b[rest], return_counts=True)
    return np.concatenate([*pairs, coordinates]), np.concatenate([*counts, n])


class Totals:
    """Counts of pairs of one task, merged whenever the buffer is full."""

    def __init__(self):
        self.a, self.b, self.held = [], [], 0
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)

    def merge(self) -> None:
        if not self.held:
            return
        pairs, counts = count_tiles(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.held = [], [], 0
        pairs, counts = np.r_[self.pairs, pairs], np.r_[self.counts, counts]
        order = np.argsort(pairs, kind="stable")
        pairs, counts = pairs[order], counts[order]
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        self.pairs, self.counts = pairs[first], np.add.reduceat(counts, first)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for at in range(0, len(self.pairs), 100_000):
            pairs = self.pairs[at : at + 100_000]
            none = pa.nulls(len(pairs), pa.string())
            n = pa.array(self.counts[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(pairs), none, none, n], ["pair", "lang", "phrase", "n"])
        self.pairs, self.counts = self.pairs[:0], self.counts[:0]


def _count_level(length: int, words, levels: list):
    """Counts of phrases of `length` words: as pairs of ids, or by spelling where a part has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = words.value
        tables = [level.value for level in levels]
        totals, spelled = Totals(), defaultdict(Counter)

        def extend(first: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            """Positions where a phrase of `size` words may be frequent, and which of them have a pair of ids."""
            n = max(len(ids) - size + 1, 0)
            live = (first[:n] != DEAD) & (first[1 : n + 1] != DEAD)
            return live, live & (first[:n] >= 0) & (ids[size - 1 :][:n] >= 0)

        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[r].as_py(), "<i4")
                lang, others, number = batch.column("lang")[r].as_py(), None, None

                def spelling(at: np.ndarray, size: int) -> Iterator[bytes]:
                    nonlocal others, number
                    if others is None:
                        others, number = batch.column("others")[r].as_py(), np.cumsum(ids == UNKNOWN) - 1
                    spell = lambda i: known[ids[i]][1] if ids[i] >= 0 else others[number[i]].encode()
                    return (b" ".join(map(spell, range(t, t + size))) for t in at.tolist())

                first = ids
                for size, table in zip(range(2, length), tables):
                    live, paired = extend(first, ids, size)
                    found = np.full(len(live), DEAD, np.int32)
                    at = np.flatnonzero(paired)
                    found[at] = table.look_up(first[at], ids[at + size - 1])
                    rest = np.flatnonzero(live & ~paired)
                    if len(rest) and table.spelled:
                        seen = [spelled_number(lang, p) in table.spelled for p in spelling(rest, size)]
                        found[rest[seen]] = UNKNOWN
                    first = found
                live, paired = extend(first, ids, length)
                at = np.flatnonzero(paired)
                totals.add(first[at], ids[at + length - 1])
                rest = np.flatnonzero(live & ~paired)
                if len(rest):
                    spelled[lang].update(spelling(rest, length))
                    if sum(map(len, spelled.values())) > DISTINCT:
                        yield from _spelled(spelled)
                if totals.held >= BUFFER:
                    totals.merge()
                    if len(totals.pairs) > BUFFER:
                        yield from totals.rows()
        yield from totals.rows()
        yield from _spelled(spelled)

    return run


COUNTED = "pair long, lang string, phrase string, n long"


def _spell_pairs(words, before):
    """Language and spelling of packed pairs; `before` spells the ids of their first parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = words.value[0], before.value
        for batch in batches:
            pair = batch.column("pair").to_numpy(zero_copy_only=False)
            lasts = (pair & ((1 << BITS) - 1)).tolist()
            firsts = (pair >> BITS).tolist()
            langs = [known[j][0] for j in lasts]
            phrases = [parts[i] + b" " + known[j][1] for i, j in zip(firsts, lasts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("pair"), pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                 batch.column("n")],
                ["pair", "lang", "phrase", "n"],
            )

    return run


def _leading(table: DataFrame, limit: int) -> tuple[dict[str, list], bool]:
    """Columns of the most frequent rows up to the limit, and whether more are left."""
    found = table.orderBy(F.desc("n"), "lang", "phrase").limit(limit + 1).toArrow()
    columns = found.slice(0, limit).to_pydict()
    return columns | {"phrase": [p.encode() for p in columns["phrase"]]}, found.num_rows > limit


def frequent(
    docs: DataFrame,
    least: int = 100,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    words_limit: int = WORDS,
    phrases_limit: int = PHRASES,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, n) of all phrases of up to `longest` words that occur `least` times, and (lang, n) of all words."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_count_words, COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    every = staged(counted)
    sizes = staged(every.groupBy("lang").agg(F.sum("n").alias("n")))
    single = every.where(F.col("n") >= least)
    top, full = _leading(single, words_limit)
    words = sc.broadcast((list(zip(top["lang"], top["phrase"])), marks(single, SPELLED) if full else None))
    runs = staged(rows.mapInArrow(_encode(words), "lang string, ids binary, others array<string>"))

    found = [single.select("lang", "phrase", F.lit(1).alias("m"), "n")]
    levels, parts = [], sc.broadcast(top["phrase"])
    for m in range(2, longest + 1):
        counts = runs.mapInArrow(_count_level(m, words, list(levels)), COUNTED)
        sums = counts.groupBy("pair", "lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        often = staged(sums)
        paired = often.where("pair IS NOT NULL").mapInArrow(_spell_pairs(words, parts), COUNTED)
        table = staged(paired.unionByName(often.where("pair IS NULL")))
        found.append(table.select("lang", "phrase", F.lit(m).alias("m"), "n"))
        if m < longest:
            pairs, others = table.where("pair IS NOT NULL"), table.where("pair IS NULL")
            top, more = _leading(pairs, phrases_limit)
            frequent_pairs = marks(pairs, "pair") if more else None
            spelled = None if others.isEmpty() else marks(others, SPELLED)
            levels.append(sc.broadcast(Pairs(np.array(top["pair"], np.int64), frequent_pairs, spelled)))
            parts = sc.broadcast(top["phrase"])
    out = found[0]
    for table in found[1:]:
        out = out.unionByName(table)
    return staged(out), sizes


def scored(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, n, score) of the phrases of two and more words that no longer one replaces."""
    many = phrases.where("m > 1").select("lang", "phrase", "m", F.col("n").alias("a"))
    word = F.split("phrase", " ", -1)
    join = lambda start, size: F.array_join(F.slice(word, start, size), " ")
    k = F.col("k")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).select(
        "*", join(F.lit(1), k).alias("first"), join(k + 1, F.col("m") - k).alias("rest")
    )
    count = lambda name, to: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(to))
    parts = cuts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"])
    whole = parts.join(sizes, "lang")
    wide = lambda c, digits=19: f"CAST({c} AS DECIMAL({digits},0))"
    value = F.expr(f"(1000 * {wide('a')} * {wide('n', 15)}) DIV ({wide('l')} * {wide('r')})")
    best = F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("best")
    cut = whole.groupBy("lang", "phrase", "m", "a", "n").agg(best)

    ends = F.array(join(F.lit(1), F.col("m") - 1), join(F.lit(2), F.col("m") - 1))
    inner = many.where("m > 2").select("lang", F.explode(ends).alias("phrase"), F.col("a").alias("longer"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = cut.join(longest, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a")
    return kept.select("lang", "phrase", "m", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, least: int = 100, report: int = 2000, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count and spelling."""
    phrases, sizes = frequent(docs, least, **options)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(phrases, sizes).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= report).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
