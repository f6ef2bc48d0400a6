"""Language-model scoring: a causal self-attention model in numpy over subword ids, beside a word unigram score.

One pass over all documents splits them into word hashes and subword ids, which are staged; word counts, subword counts and
all context windows of the training documents come from that table and grow with the corpus. Subwords fall into classes
by their counts: frequent ones have a class of their own, the others share classes of equal mass. The attention model
predicts the next class from the classes before it; the counts give a subword's share of its class. The classes form
`BRANCH` groups of `BRANCH`: one softmax names the group, a second one, with weights of that group, the class within it. Their
product is a probability over all classes at the price of two short softmaxes for a target.

Training is local Adam on groups of windows with the weights averaged after each round, so one more executor shortens it.
Every window is trained on once: it belongs to one of the rounds by a hash. Windows travel as runs: `RUN` windows that
follow each other in a text, dealt by a hash of key, text and place, so copies of a text are spread.

Scoring cuts each text into windows of `WINDOW` ids that overlap by half and scores the second half of each under a
causal mask, so every id is scored once, with 17 to 32 ids before it (fewer at the start). All windows of a batch of
texts go through one masked attention.

Word counts of unlimited vocabulary: words at or above a count that at most `TOP_WORDS` words reach are a sorted table of
that bounded size in every task; all rarer words are joined by hash, where no key is frequent.

Words are runs of characters other than blank and 0x09 to 0x0D, A-Z lower-cased, identified by 64-bit hashes.

Defined results: NULL and empty texts are the end token alone. Rows without an id belong to fold 0 and are not learned
from. Repeated rows get equal scores. Texts of any length
are read whole; their windows are scored in blocks. An empty table gives no rows. Other columns, whatever their names, take
no part. Without training documents counts are 0 and the model is untrained, uniform within
classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import as_bytes, lean, mix, only
from dockflow.llm.tokens import Words, cut, gathered, in_slices, starts_of, words_of
from dockflow.session import staged

WINDOW, HALF = 32, 16
WIDTH, HIDDEN = 16, 32
OWN_CLASSES, SHARED_CLASSES = 240, 8
CLASSES = OWN_CLASSES + 2 * SHARED_CLASSES
BRANCH = 16  # groups, and classes of a group
START = CLASSES  # input only: before the text
SHARE = 1  # one window in so many is trained on
ROUNDS = 2  # parts of the windows, one after the other
WINDOWS_A_GROUP = 32768
#: Groups of a task, once there are so many tasks.
GROUPS, TASKS = 8, 64
RUN = 16
BATCH = 128
RATE = 0.02
TOGETHER = 128  # windows scored by one attention: what they need stays in a core's cache
TOP_WORDS = 1 << 20
SEED = 5


class Subwords:
    """Subword ids of words behind a blank, and hashes of the words."""

    def __init__(self, path: str):
        self.words = Words(path, " ")
        self.memos, self.tokenizer = [self.words.table, self.words.stops], self.words.tokenizer
        self.size = self.tokenizer.get_vocab_size()
        self.end = self.size - 1

    def split_slice(self, texts: pa.Array) -> list[tuple[bytes, bytes]]:
        """Of each text the 64-bit hashes of its words, and its subword ids with the end id."""
        words, counts = words_of(texts)
        coded = words.dictionary_encode()
        ids, sizes = self.words.runs(coded.dictionary)
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), "<u8", len(names))
        at, end = coded.indices.to_numpy(zero_copy_only=False), np.array([self.end], "<u2").tobytes()
        found = cut((gathered(ids, starts_of(sizes)[at], sizes[at]), sizes[at]), counts)
        own = cut((hashes[at], np.ones(len(at), np.int64)), counts)
        return [(h.tobytes(), i.tobytes() + end) for h, i in zip(own, found)]

    def split_many(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        return [row for _, part in in_slices(pa.array(texts, pa.binary())) for row in self.split_slice(part)]

    def split(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        hashes, ids = self.split_many([text])[0]
        return np.frombuffer(hashes, "<i8"), np.frombuffer(ids, "<u2")

    def after_blank(self) -> np.ndarray:
        """Which ids start with a blank."""
        return np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(self.size)])


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


def windows(classes: np.ndarray, start: int = START) -> np.ndarray:
    """Rows of WINDOW + 1 classes: the inputs of a window and the target after its last; padded with `start`, then -1."""
    n = -(-len(classes) // HALF)
    line = np.full(HALF + 1 + HALF * n, -1, np.int32)
    line[: HALF + 1] = start
    line[HALF + 1 : HALF + 1 + len(classes)] = classes
    return np.lib.stride_tricks.sliding_window_view(line, WINDOW + 1)[::HALF]


def runs(ids: np.ndarray, start: int, share: int, text: int, key: int) -> list[tuple[int, int, bytes]]:
    """Hash to deal by, number of windows, and line of the runs of a text: all of its windows, or one in `share` by hash.

    A line holds what `windows` cuts its windows from, without the padding at the end.
    """
    n = -(-len(ids) // HALF)
    line = np.concatenate([np.full(HALF + 1, start, "<u2"), ids.astype("<u2")])
    if share == 1:
        cuts = [(at, min(at + RUN, n)) for at in range(0, n, RUN)]
    else:
        place = mix(np.arange(n, dtype=np.uint64) + np.uint64(text))
        cuts = [(int(at), int(at) + 1) for at in np.flatnonzero(place % np.uint64(share) == 0)]
    if not cuts:
        return []
    deal = mix(np.array([at for at, _ in cuts], np.uint64) + (mix(np.array([key], np.uint64)) ^ np.uint64(text)))
    return [
        (int(h), to - at, line[HALF * at : HALF * (to + 1) + 1].tobytes()) for h, (at, to) in zip(deal, cuts)
    ]


def unrolled(classes: np.ndarray, n: int) -> np.ndarray:
    """The windows of a line of classes."""
    line = np.full(HALF * (n + 1) + 1, -1, np.int32)
    line[: len(classes)] = classes
    return np.lib.stride_tricks.sliding_window_view(line, WINDOW + 1)[::HALF]


_SHAPES = {
    "embed": (CLASSES + 1, WIDTH), "place": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH),
    "o": (WIDTH, WIDTH), "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, WIDTH), "top": (WIDTH, BRANCH),
    "top_bias": (BRANCH,), "low": (BRANCH, WIDTH, BRANCH), "low_bias": (BRANCH, BRANCH),
}
#: Query i of the second half sees inputs up to its own.
_MASK = np.where(np.arange(WINDOW) <= np.arange(HALF, WINDOW)[:, None], 0.0, -1e9).astype(np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in _SHAPES]).astype(np.float32)


def initial(class_counts: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    p = {n: rng.standard_normal(s) * (s[-2] ** -0.5 if len(s) > 1 else 0) for n, s in _SHAPES.items()}
    p["embed"], p["place"] = p["embed"] * 5.0, p["place"] * 2.0
    p["top"], p["low"] = p["top"] * 0.1, p["low"] * 0.1
    mass = (class_counts + 1.0).reshape(BRANCH, BRANCH)
    p["top_bias"] = np.log(mass.sum(1) / mass.sum())
    p["low_bias"] = np.log(mass / mass.sum(1, keepdims=True))
    return pack(p)


def exponents(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of each row, its sum, and the logarithm of the sum of the row as given; shifted only where that overflows."""
    ones = np.ones(y.shape[-1], y.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(y)
        s = e @ ones
    if (np.isfinite(s) & (s > 0)).all():
        return e, s, np.log(s)
    shift = y.max(-1)
    e = np.exp(y - shift[..., None])
    s = e @ ones
    return e, s, np.log(s) + shift


def trunk(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """What the heads see after each input of the second half, one row each; x is [windows, WINDOW]."""
    n = len(x)
    h = p["embed"].take(x.ravel(), axis=0).reshape(n, WINDOW, WIDTH)
    h += p["place"]
    flat, last = h.reshape(-1, WIDTH), h[:, HALF:].reshape(-1, WIDTH)
    q = (last @ (p["q"] * np.float32(WIDTH**-0.5))).reshape(n, HALF, WIDTH)
    k, v = (flat @ p["k"]).reshape(h.shape), (flat @ p["v"]).reshape(h.shape)
    a = q @ k.transpose(0, 2, 1)
    a += _MASK
    a, s, _ = exponents(a)
    a /= s[..., None]
    c = (a @ v).reshape(-1, WIDTH)
    r = last + c @ p["o"]
    f = r @ p["w1"]
    f += p["b1"]
    np.maximum(f, 0, out=f)
    return r + f @ p["w2"], (flat, last, q, k, v, a, c, r, f)


def grouped(high: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by group, and (group, from, to) of the groups that occur."""
    order = np.argsort(high.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(high, minlength=BRANCH)).tolist()
    return order, [(g, a, b) for g, a, b in zip(range(BRANCH), [0, *ends], ends) if a < b]


def group_logits(p: dict[str, np.ndarray], z: np.ndarray, high: np.ndarray, groups: list[tuple[int, int, int]]) -> np.ndarray:
    """Of the classes within the group of each row; rows are in the order of their groups."""
    low = p["low_bias"].take(high, axis=0)
    for g, a, b in groups:
        low[a:b] += z[a:b] @ p["low"][g]
    return low


def forward(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Log probabilities of every class after each input of the second half."""
    z = trunk(p, x)[0]
    top = z @ p["top"] + p["top_bias"]
    low = np.einsum("nw,gwl->ngl", z, p["low"]) + p["low_bias"]
    top, low = top - exponents(top)[2][:, None], low - exponents(low)[2][..., None]
    return (top[..., None] + low).reshape(len(z), -1)


def target_scores(p: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of each target (flat) after the inputs of the second half: `forward` for these classes only."""
    z, row = trunk(p, x)[0], np.arange(len(target))
    high = target // BRANCH
    top = z @ p["top"]
    top += p["top_bias"]
    found = top[row, high] - exponents(top)[2]
    order, groups = grouped(high)
    low = group_logits(p, z.take(order, axis=0), high[order], groups)
    found[order] += low[row, target[order] % BRANCH] - exponents(low)[2]
    return found


def gradient(p: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log probability of the targets of some windows."""
    x, target = rows[:, :-1].clip(0), rows[:, HALF + 1 :].ravel()
    z, (flat, last, q, k, v, a, c, r, f) = trunk(p, x)
    real, row = target >= 0, np.arange(len(target))
    weight = (real / max(real.sum(), 1)).astype(z.dtype)
    target = target.clip(0)
    high = target // BRANCH

    def slopes(y: np.ndarray, chosen: np.ndarray, weight: np.ndarray) -> np.ndarray:
        d, s, _ = exponents(y)
        d *= (weight / s)[:, None]
        d[row, chosen] -= weight
        return d

    d = slopes(z @ p["top"] + p["top_bias"], high, weight)
    g = {"top": z.T @ d, "top_bias": d.sum(0), "low": np.zeros_like(p["low"]), "low_bias": np.zeros_like(p["low_bias"])}
    dz = d @ p["top"].T
    order, groups = grouped(high)
    sorted_z = z.take(order, axis=0)
    d = slopes(group_logits(p, sorted_z, high[order], groups), target[order] % BRANCH, weight[order])
    back = np.empty_like(z)
    for j, i, e in groups:
        back[i:e] = d[i:e] @ p["low"][j].T
        g["low"][j] = sorted_z[i:e].T @ d[i:e]
    found, firsts = [j for j, _, _ in groups], [i for _, i, _ in groups]
    g["low_bias"][found] = np.add.reduceat(d, firsts)
    dz[order] += back
    df = dz @ p["w2"].T
    df *= f > 0
    g["w2"], g["w1"], g["b1"] = f.T @ dz, r.T @ df, df.sum(0)
    dr = dz + df @ p["w1"].T
    dc = dr @ p["o"].T
    g["o"] = c.T @ dr
    dot = np.einsum("ij,ij->i", dc, c).reshape(q.shape[:2])  # of the attention weights with their slopes
    dc = dc.reshape(q.shape)
    dv = (a.transpose(0, 2, 1) @ dc).reshape(-1, WIDTH)
    ds = dc @ v.transpose(0, 2, 1)
    ds -= dot[..., None]
    ds *= a
    dq, dk = (ds @ k).reshape(-1, WIDTH), (ds.transpose(0, 2, 1) @ q).reshape(-1, WIDTH)
    dq *= np.float32(WIDTH**-0.5)
    g["q"], g["k"], g["v"] = last.T @ dq, flat.T @ dk, flat.T @ dv
    dh = dk @ p["k"].T
    dh += dv @ p["v"].T
    dr += dq @ p["q"].T
    dh = dh.reshape(len(x), WINDOW, WIDTH)
    dh[:, HALF:] += dr.reshape(q.shape)
    g["place"] = dh.sum(0)
    places = x.ravel().astype(np.uint16)
    order = np.argsort(places, kind="stable")
    n = np.bincount(places, minlength=len(p["embed"]))
    seen = np.flatnonzero(n)
    g["embed"] = np.zeros_like(p["embed"])
    g["embed"][seen] = np.add.reduceat(dh.reshape(-1, WIDTH).take(order, axis=0), (np.cumsum(n) - n)[seen])
    return g


def warm_allocator() -> None:
    """A freed block of 24 MB raises the size from which the C library returns every array to the system at once."""
    np.empty(24 << 20, np.uint8)


def train_locally(flat: np.ndarray, rows: np.ndarray, rate: float) -> np.ndarray:
    """Adam over the windows, in the order of a hash of their place."""
    flat = flat.astype(np.float32)
    p, m, s = unpack(flat), np.zeros_like(flat), np.zeros_like(flat)
    rows = rows[np.argsort(mix(np.arange(len(rows), dtype=np.uint64)))]
    for t, at in enumerate(range(0, len(rows), BATCH), 1):
        g = pack(gradient(p, rows[at : at + BATCH]))
        m += np.float32(0.1) * (g - m)
        s += np.float32(0.01) * (g * g - s)
        flat -= np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(s * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-8))
    return flat


class Model:
    """Classes of subwords, their shares, and the attention weights."""

    def __init__(self, counts: np.ndarray, after_blank: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.classes = np.zeros(len(counts), np.int32)
        self.classes[order[:OWN_CLASSES]] = np.arange(OWN_CLASSES)
        for side in (0, 1):
            rest = order[OWN_CLASSES:]
            rest = rest[after_blank[rest] == bool(side)]
            mass = np.cumsum(counts[rest] + 0.1)
            part = np.minimum((mass / mass[-1] * SHARED_CLASSES).astype(int), SHARED_CLASSES - 1) if len(rest) else mass
            self.classes[rest] = OWN_CLASSES + side * SHARED_CLASSES + part
        smooth = counts + 0.1
        self.class_counts = np.bincount(self.classes, counts, CLASSES)
        self.share = np.log(smooth / np.bincount(self.classes, smooth, CLASSES)[self.classes])
        self.flat = initial(self.class_counts)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of ids; each is computed by itself, so that equal texts score alike."""
        p, out = unpack(self.flat), np.array([self.share[t].sum() for t in texts], float)
        for i, text in enumerate(texts):
            rows = windows(self.classes[text])
            for at in range(0, len(rows), TOGETHER):
                part = rows[at : at + TOGETHER]
                target = part[:, HALF + 1 :].ravel()
                found = target_scores(p, part[:, :-1].clip(0), target.clip(0))
                out[i] += np.where(target >= 0, found, 0.0).sum(dtype=np.float64)
        return out / np.log(10)


_SPLIT = "row long, key {kind}, held_out boolean, deal long, windows long, words binary, ids binary"


def _split(path: str):
    """Every row with the hashes of its words, its subword ids, the number of its windows and a hash to deal them by."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = subwords(path)
        only(*own.memos)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            names = as_bytes(batch, "name")
            for at, texts in in_slices(batch.column("text")):
                part, size = texts.cast(pa.binary()).to_pylist(), len(texts)
                words, ids = zip(*own.split_slice(texts))
                digest = lambda values: np.fromiter(map(xxhash.xxh64_intdigest, values), np.uint64, size)
                deal = (mix(digest(names[at : at + size])) ^ digest(part)).view(np.int64)
                windows = [-(-len(b) // (2 * HALF)) for b in ids]
                arrays = [pa.array(np.arange(number, number + size)), *(batch.column(c).slice(at, size) for c in ("key", "held_out"))]
                arrays += [pa.array(deal), pa.array(windows), pa.array(words, pa.binary()), pa.array(ids, pa.binary())]
                number += size
                yield pa.RecordBatch.from_arrays(arrays, ["row", "key", "held_out", "deal", "windows", "words", "ids"])

    return run


def _count(size: int):
    """kind 0: word hash and count; 1: subword and count."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        counts, held, n = np.zeros(size, np.int64), [], 0

        def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], ["kind", "key", "n"])

        for batch in batches:
            for words, ids in zip(as_bytes(batch, "words"), as_bytes(batch, "ids")):
                counts += np.bincount(np.frombuffer(ids, "<u2"), minlength=size)
                held.append(np.frombuffer(words, "<i8"))
                n += len(held[-1])
                if n > 2_000_000:
                    yield rows(0, *np.unique(np.concatenate(held), return_counts=True))
                    held, n = [], 0
        if n:
            yield rows(0, *np.unique(np.concatenate(held), return_counts=True))
        seen = np.flatnonzero(counts)
        yield rows(1, seen, counts[seen])

    return run


def _train(model: Model, texts: DataFrame, share: int) -> None:
    """Rounds of local training, each on its part of the windows; the weights are averaged by number of windows.

    A class is one byte; START, which stands before a text, is counted.
    """
    n = (texts.agg(F.sum("windows")).first()[0] or 0) / share / max(ROUNDS, 1)
    parts = max(1, min(TASKS, round(n / WINDOWS_A_GROUP)), round(n / WINDOWS_A_GROUP / GROUPS))
    classes, unknown = model.classes.astype("<u2"), START

    @lean
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = []
                part = batch.slice(at, 256)
                for deal, ids in zip(part.column("deal").to_numpy().view(np.uint64).tolist(), as_bytes(part, "ids")):
                    found += runs(classes[np.frombuffer(ids, "<u2")], unknown, share, deal, 0)
                if found:
                    deal, n, lines = zip(*found)
                    lines = [np.frombuffer(line, "<u2") for line in lines]
                    before = [int((line[: HALF + 1] == unknown).sum()) for line in lines]
                    coded = [line[k:].astype(np.uint8).tobytes() for line, k in zip(lines, before)]
                    arrays = [pa.array(np.array(deal, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(before)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(coded, pa.binary())], ["key", "n", "before", "classes"])

    coded = texts.select("deal", "ids").mapInArrow(code, "key long, n long, before long, classes binary")
    spread = staged(coded.repartition(parts, "key").sortWithinPartitions("key", "classes"))
    for r in range(ROUNDS if n else 0):
        flat, rate = model.flat, RATE * 0.5**r

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only()
            warm_allocator()
            held = []
            for b in batches:
                for k, before, classes in zip(*(b.column(c).to_pylist() for c in ("n", "before", "classes"))):
                    line = np.concatenate([np.full(before, START, np.int32), np.frombuffer(classes, np.uint8)])
                    held.append(unrolled(line, k).astype(np.int16))
            if held:
                rows = np.concatenate(held)
                held.clear()
                order = np.argsort(mix(np.arange(len(rows), dtype=np.uint64)))
                groups = np.array_split(order, max(1, round(len(rows) / WINDOWS_A_GROUP)))
                trained = sum(train_locally(flat, rows[g].astype(np.int32), rate).astype(float) * len(g) for g in groups)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(trained) + 1)), pa.array(np.append(trained, len(rows)))], ["at", "value"]
                )

        turn = spread.where(F.pmod(F.shiftrightunsigned("key", 32), F.lit(ROUNDS)) == r)
        total = turn.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("v")).collect()
        if total:
            summed = np.zeros(len(flat) + 1)
            for row in total:
                summed[row["at"]] = row["v"]
            model.flat = (summed[:-1] / summed[-1]).astype(np.float32)


def score(
    docs: DataFrame, held_out: Column, path: str, key: str = "doc_id", text: str = "text", share: int = SHARE
) -> DataFrame:
    """`key`, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    `held_out` is a Boolean column; rows where it is true are scored but not learned from. One window in `share` is
    trained on.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).alias("text"), held_out.alias("held_out")
    )
    split = staged(rows.mapInArrow(_split(path), _SPLIT.format(kind=kind)))
    train = split.where(~F.col("held_out"))
    own = subwords(path)
    found = train.select("words", "ids").mapInArrow(_count(own.size), "kind int, key long, n long")
    gathered = staged(found.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    counts = np.zeros(own.size, np.int64)
    for r in gathered.where("kind = 1").collect():
        counts[r["key"]] = r["n"]
    model = Model(counts, own.after_blank())
    _train(model, train, share)

    octave = F.floor(8 * F.log2("n")).cast("int")
    words = gathered.where("kind = 0").select("key", "n", octave.alias("octave"))
    # The end token is counted once a document: the last subword id of each.
    ends = int(counts[own.end])
    total, kinds, least = ends, int(ends > 0), 0
    steps = words.groupBy("octave").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    at_least = 0
    for step in sorted(steps, key=lambda s: -s["octave"]):
        total, kinds, at_least = total + step["n"], kinds + step["words"], at_least + step["words"]
        if at_least > TOP_WORDS and not least:
            least = step["octave"] + 1
    top = words.where(F.col("octave") >= least).select("key", "n").orderBy("key").toArrow()
    norm = total + 0.1 * (kinds + 1)
    unit = lambda c: np.log10((c + 0.1) / norm)
    shared = spark.sparkContext.broadcast((model, top["key"].to_numpy(), unit(top["n"].to_numpy())))
    end_score, end_known = float(unit(ends)), int(ends > 0)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        warm_allocator()
        model, keys, values = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, base, known, rare, ids = [], [], [], [], []
                for words, line in zip(as_bytes(part, "words"), as_bytes(part, "ids")):
                    hashes = np.frombuffer(words, "<i8")
                    place = np.searchsorted(keys, hashes).clip(max=max(len(keys) - 1, 0))
                    hit = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
                    n.append(len(hashes) + 1)
                    base.append(float(values[place[hit]].sum()) + end_score)
                    known.append(int(hit.sum()) + end_known)
                    rare.append(hashes[~hit])
                    ids.append(np.frombuffer(line, "<u2"))
                arrays = [*(part.column(c) for c in ("row", "key", "held_out")), pa.array(n), pa.array(known), pa.array(base)]
                arrays += [pa.array(model.scores(ids)), pa.array(rare, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "key", "held_out", "n_tokens", "known", "base", "score", "rare"])

    schema = (
        f"row long, key {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>"
    )
    main = staged(split.select("row", "key", "held_out", "words", "ids").mapInArrow(run, schema))
    counted = main.select("row", F.explode("rare").alias("key")).join(
        words.where(F.col("octave") < least).select("key", "n"), "key", "left"
    )
    own_score = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(norm))
    rest = counted.groupBy("row").agg(F.sum(own_score).alias("more"), F.count("n").alias("more_known"))
    zero = F.lit(0)
    return main.drop("rare").join(rest, "row", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
