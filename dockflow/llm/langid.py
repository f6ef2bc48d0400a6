"""Language identification by the nearest of several clustered centroids per language.

A text becomes hashed byte 2- and 3-gram counts (ASCII lower-cased, ASCII non-letters folded into one blank), weighted by
log(1 + count) and inverse document frequency, and scaled to length one. Each language has several spherical k-means
centroids; the nearest by cosine names the language, and a text farther from it than the language's own documents are
is rejected.

A short text has a low cosine to any centroid, a long one of noise may have a higher one. What is compared is therefore
the closeness cosine^2 / (1 - cosine^2) for each distinct gram of the text, which hardly depends on length. A language's
floor is `REJECT_SHARE` of the median closeness of all its training documents, copies included, each measured as if it
were not in the sample that its centroid was made of.

Document frequencies and floors cover every training document. Only the centroids are fitted on a sample, of at most
`SAMPLE_PER_LANGUAGE` documents of each language, chosen by hash.

Defined results: NULL text or a text without a letter is `und` with score 0, and counts as rejected. Without training
documents every text is `und`. Repeated rows get equal results; texts of any length are read whole, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import as_bytes, lean, only, sliced

DIMS = 4096
SAMPLE_PER_LANGUAGE = 800
CENTROIDS_PER_LANGUAGE = 4
KMEANS_ROUNDS = 10
#: A text is rejected below this share of the median closeness of the language's training documents.
REJECT_SHARE = 1 / 18
#: Steps of the logarithm of closeness that medians are taken in.
STEPS = 100
UNKNOWN = "und"
BLOCK = 1 << 20

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else (c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256)
)


def has_letter(text: bytes) -> bool:
    if not text.isascii():
        return any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return any(c != 32 for c in text.translate(_FOLD, delete=b" \t\n\r\x0b\x0c"))


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed 2- and 3-grams of the whole text."""
    out = np.zeros(DIMS, np.int64)
    folded = b" " + text.translate(_FOLD) + b" "
    for start in range(0, len(folded) - 1, BLOCK):
        b = np.frombuffer(folded, np.uint8, min(BLOCK + 2, len(folded) - start), start).astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
        shift = np.uint32(20)
        out += np.bincount((two[:BLOCK] * np.uint32(0x165667B1)) >> shift, minlength=DIMS)
        out += np.bincount((three[:BLOCK] ^ (three[:BLOCK] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, minlength=DIMS)
    out[_BLANKS] = 0
    return out


def _blank_dims() -> np.ndarray:
    b = np.uint32(32)
    with np.errstate(over="ignore"):
        two = b * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
        three = two * np.uint32(0xC2B2AE3D) + b * np.uint32(0x27D4EB2F) + np.uint32(1)
        pair = (two * np.uint32(0x165667B1)) >> np.uint32(20)
        triple = ((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
    return np.array([pair, triple], np.int64)


#: Grams of blanks only say nothing about the language.
_BLANKS = _blank_dims()


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray

    def judge(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0 to 1, and whether the text is rejected."""
        names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(known), 256):
            rows = known[at : at + 256]
            counts = np.stack([gram_counts(texts[i]) for i in rows])
            cosine = weigh(counts, self.idf) @ self.centroids.T
            best = cosine.argmax(1)
            c = cosine[np.arange(len(rows)), best]
            near = closeness(c, counts)
            for i, j, c, t in zip(rows, best, c, near):
                names[i], scores[i], rejected[i] = self.languages[j], min(max(float(c), 0.0), 1.0), t < self.floors[j]
        return names, scores, rejected


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def closeness(cosine: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logarithm of cosine^2 / (1 - cosine^2) for each distinct gram."""
    square = np.clip(cosine.astype(float), 1e-6, 1.0) ** 2
    return np.log(square / np.maximum(1 - square, 1e-9) / np.maximum((counts > 0).sum(1), 1))


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learns from the text and language of the given rows; rows lacking either take no part."""
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    frequency = dict(
        rows.mapInArrow(_document_frequency, "dim int, n long").groupBy("dim").agg(F.sum("n")).collect()
    )
    df = np.array([frequency.get(d, 0) for d in range(DIMS)], float)
    idf = (np.log((1 + sum(totals.values())) / (1 + df)) + 1).astype(np.float32)
    names, centroids, floors, clusters = [], [], [], {}
    if totals:
        scale = 1 << 40
        share = F.lit(0)
        for name, n in sorted(totals.items()):
            share = F.when(F.col("lang") == name, F.lit(int(scale * min(1.0, SAMPLE_PER_LANGUAGE / n)))).otherwise(share)
        # Copies of one text share their hash: one of them stands for all.
        marked = rows.withColumn("mark", F.xxhash64("text")).withColumn("inside", F.pmod("mark", F.lit(scale)) < share)
        chosen = marked.where("inside").dropDuplicates(["lang", "mark"]).select("text", "lang")
        sample: dict[str, list[np.ndarray]] = {}
        for r in chosen.mapInArrow(_sample_counts, "lang string, dims binary, counts binary").collect():
            if len(sample.setdefault(r["lang"], [])) < 2 * SAMPLE_PER_LANGUAGE:
                row = np.zeros(DIMS, np.int32)
                row[np.frombuffer(r["dims"], np.uint16)] = np.frombuffer(r["counts"], np.int32)
                sample[r["lang"]].append(row)
        for name in sorted(sample):
            clusters[name] = sums = cluster(weigh(np.stack(sample[name]), idf))
            names += [name] * len(sums)
            centroids += list(unit(sums))
        steps: dict[str, list[tuple[int, int]]] = {}
        measured = marked.select("text", "lang", "inside").mapInArrow(_member_steps(idf, clusters), "lang string, step int")
        for r in measured.groupBy("lang", "step").agg(F.count("*").alias("n")).collect():
            steps.setdefault(r["lang"], []).append((r["step"], r["n"]))
        floors = [median(steps.get(name, [])) + np.log(REJECT_SHARE) for name in names]
    return LanguageModel(idf, names, np.array(centroids, np.float32).reshape(-1, DIMS), np.array(floors))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray) -> np.ndarray:
    """Spherical k-means, seeded by the farthest vector each time: the sum of the members of each cluster."""
    v = v[np.lexsort(v[:, :8].T)]
    seeds = [int((v @ v.mean(0)).argmax())]
    while len(seeds) < min(CENTROIDS_PER_LANGUAGE, len(v)):
        seeds.append(int((v @ v[seeds].T).max(1).argmin()))
    sums = v[seeds]
    for _ in range(KMEANS_ROUNDS):
        own = (v @ unit(sums).T).argmax(1)
        sums = np.stack([v[own == j].sum(0) if (own == j).any() else sums[j] for j in range(len(sums))])
    return sums


def members_cosine(v: np.ndarray, sums: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Cosine of each vector to the nearest centroid; one that is inside the sample is taken out of its own first."""
    cosine = v @ unit(sums).T
    own, row = cosine.argmax(1), np.arange(len(v))
    left = sums[own] - v
    size = np.linalg.norm(left, axis=1)
    without = cosine.copy()
    without[row, own] = np.where(size > 1e-3, np.einsum("ij,ij->i", v, left) / np.maximum(size, 1e-3), 0)
    return np.where(inside, without.max(1), cosine.max(1))


def median(steps: list[tuple[int, int]]) -> float:
    """Of closeness, from counts of its steps; none: nothing is rejected."""
    if not steps:
        return -np.inf
    step, n = np.array(sorted(steps)).T
    below = np.cumsum(n)
    return (step[np.searchsorted(below, below[-1] / 2)] + 0.5) / STEPS


def _member_steps(idf: np.ndarray, clusters: dict[str, np.ndarray]):
    """Language and step of closeness of every document with a letter."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in sliced(batches):
            texts, inside = as_bytes(batch, "text"), np.array(batch.column("inside").to_pylist(), bool)
            of: dict[str, list[int]] = {}
            for i, name in enumerate(batch.column("lang").to_pylist()):
                if name in clusters and has_letter(texts[i]):
                    of.setdefault(name, []).append(i)
            for name, rows in of.items():
                for at in range(0, len(rows), 256):
                    part = rows[at : at + 256]
                    counts = np.stack([gram_counts(texts[i]) for i in part])
                    near = closeness(members_cosine(weigh(counts, idf), clusters[name], inside[part]), counts)
                    step = np.floor(near * STEPS).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(step)], ["lang", "step"])

    return run


@lean
def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    df = np.zeros(DIMS, np.int64)
    for batch in sliced(batches):
        for text in as_bytes(batch, "text"):
            df += gram_counts(text) > 0
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(df)], ["dim", "n"])


@lean
def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only()
    for batch in sliced(batches):
        rows = [gram_counts(t) for t in as_bytes(batch, "text")]
        dims = [np.flatnonzero(c) for c in rows]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang").cast(pa.string()),
                pa.array([d.astype(np.uint16).tobytes() for d in dims], pa.binary()),
                pa.array([c[d].astype(np.int32).tobytes() for c, d in zip(rows, dims)], pa.binary()),
            ],
            ["lang", "dims", "counts"],
        )


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, lang_pred, score, rejected for every row; other columns take no part, whatever their names."""
    kind = docs.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in sliced(batches):
            names, scores, rejected = model.judge(as_bytes(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                ["key", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("key", key)


def keep_known(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows whose language is recognised, all columns as they were."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in sliced(batches):
            yield batch.filter(pa.array(~model.judge(as_bytes(batch, text))[2]))

    return docs.mapInArrow(run, docs.schema)
