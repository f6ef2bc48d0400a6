"""Clustering, collocations and sharding against their plain definitions, and on odd rows."""

from __future__ import annotations

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from dockflow.llm import clustering, phrases, sharding
from dockflow.llm.oracle import STATEMENTS
from dockflow.llm.queries import QUERIES
from dockflow.session import scratch_dir
from odd_rows import odd_texts, with_clashes
from oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in odd_texts()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return with_clashes(spark.createDataFrame(rows, schema)).repartition(3).cache()


@pytest.mark.parametrize("key", ["op11_centroid_clusters", "op12_collocations"])
def test_query_equals_sql(spark, key):
    assert compare(spark, connect(SMALL), key, QUERIES[key], STATEMENTS[key], SMALL) == ""


# ---- clustering


def vector_rows(seed=0, n=60, dims=4):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dims).round(3).tolist()) for i in range(n)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]  # repeats and missing ids
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1])]  # equal vectors
    odd = [(90, None), (91, []), (92, [1.0] * (dims + 1)), (93, [1.0, None, 0.0, 0.0]), (94, [math.nan] * dims)]
    return rows, odd + [(95, [math.inf, 0.0, 0.0, 0.0]), (None, None)]


@pytest.mark.parametrize("k", [1, 7, 200])
def test_clusters_equal_plain_definition(spark, k):
    rows, odd = vector_rows()
    schema = "vec_id long, embedding array<double>"
    vectors = with_clashes(spark.createDataFrame(rows + odd, schema)).repartition(4)
    found, centroids = clustering.lloyd(vectors, k=k, rounds=3, dims=4)
    got = Counter((r.vec_id, r.cluster, r.distance) for r in found.collect())
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = brute.clusters(whole, k, 3, "2:", 4)
    assert got == Counter((whole[n][0], c, d) for n, (c, d) in want.items())
    assert len(centroids) == min(k, len(rows))
    digest = clustering.with_inertia(found, centroids)
    assert digest.columns == ["cluster", "vec_id", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert digest.select("inertia").distinct().count() == 1


def test_clusters_of_nothing_and_of_too_large(spark):
    schema = "vec_id long, embedding array<double>"
    found, centroids = clustering.lloyd(spark.createDataFrame([], schema))
    assert clustering.with_inertia(found, centroids).count() == 0
    with pytest.raises(Exception, match="too large for exact 64-bit distances"):
        clustering.lloyd(spark.createDataFrame([(1, [1e9] * 4)], schema), dims=4)


def test_dots_move_by_changed_components_only():
    rng = np.random.default_rng(1)
    for size in (100, 1 << 26):  # below and above what double precision holds
        v, old = rng.integers(-size, size, (50, 8)), rng.integers(-size, size, (5, 8))
        new = old.copy()
        new[1, 3] += 17
        new[4] = rng.integers(-size, size, 8)
        exact = np.array([[sum(int(x) * int(y) for x, y in zip(a, c)) for c in new] for a in v])
        assert (clustering.moved_dots(v, v @ old.T, new - old) == exact).all()


def test_rounds_leave_one_table(spark):
    rows, _ = vector_rows()
    from dockflow import session

    before = len(session._MADE)
    clustering.lloyd(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, rounds=4, dims=4)
    fs = lambda p: __import__("os").path.exists(p)
    assert sum(fs(p) for p in session._MADE[before:]) == 2  # the vectors and the last assignment


# ---- collocations


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("bounds", [{}, {"words_limit": 5, "phrases_limit": 4}, {"words_limit": 1, "phrases_limit": 1}])
def test_collocations_equal_plain_definition(odd, bounds):
    want = brute.collocations([(t, lang) for _, t, lang in odd_texts()], 3, 40)
    assert want and collected(phrases.collocations(odd, least=3, report=40, **bounds)) == want


@pytest.mark.parametrize("bounds", [{}, {"words_limit": 40, "phrases_limit": 30}])
def test_collocations_of_a_table(spark, bounds):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5)
    want = brute.collocations([(r.text, r.lang) for r in docs.collect()], 8, 500)
    assert collected(phrases.collocations(docs, least=8, report=500, **bounds)) == want


def test_rare_words_stay_out_beside_a_full_table(spark):
    """Only the frequent words without an id are kept by their spelling, not all rare ones."""
    rare = [f"r{i}" for i in range(2000)]
    text = " ".join(f"aa bb {w} cc bb" for w in rare)
    counted = spark.createDataFrame([("xx", "aa", 2000), ("xx", "bb", 4000), ("xx", "cc", 2000)], "lang string, phrase string, n long")
    words = SimpleNamespace(value=([("xx", b"bb")], phrases.marks(counted, phrases.SPELLED)))
    (found,) = phrases._encode(words)([pa.RecordBatch.from_pydict({"lang": ["xx"], "text": [text]})])
    others = Counter(found["others"][0].as_py())
    assert others["aa"] == others["cc"] == 2000
    assert sum(others.values()) < 4200


def test_rare_phrases_stay_out_beside_a_full_table(spark):
    pairs = spark.createDataFrame([(7 << phrases.BITS | 9,), (5000 << phrases.BITS | 3,), (2 << phrases.BITS | 4000,)], "pair long")
    known = phrases.Pairs(np.array([7 << phrases.BITS | 9]), phrases.marks(pairs, "pair"))
    a, b = np.array([7, 7, 5000, 5000, 2, 2]), np.array([9, 10, 3, 4, 4000, 4001])
    assert known.look_up(a, b).tolist() == [0, phrases.DEAD, phrases.UNKNOWN, phrases.DEAD, phrases.UNKNOWN, phrases.DEAD]


def test_long_texts_are_sliced_without_loss(spark, monkeypatch):
    text = ("alpha beta gamma.  delta\tAlpha beta gamma ÄB " * 300) + "x" * 5000 + " alpha beta"
    found = {}
    for size in (1 << 20, 64):
        monkeypatch.setattr(phrases, "SLICE", size)
        words = [w for part in phrases.tokens(text.encode()) for w in part if w]
        found[size] = words
    assert found[64] == found[1 << 20]
    assert b"\n" in found[64] and "Äb".encode() in found[64]


def test_collocations_of_nothing(odd):
    assert phrases.collocations(odd.limit(0)).count() == 0
    assert phrases.collocations(odd, least=10**9).count() == 0


def test_tiles_count_every_pair(monkeypatch):
    monkeypatch.setattr(phrases, "TILE", 16)
    rng = np.random.default_rng(0)
    a = np.r_[rng.integers(0, 16, 5000), rng.integers(0, 900, 400)].astype(np.int32)
    b = np.r_[rng.integers(0, 16, 5000), rng.integers(0, 900, 400)].astype(np.int32)
    pairs, counts = phrases.count_tiles(a, b)
    want = Counter((int(x) << phrases.BITS) | int(y) for x, y in zip(a, b))
    assert dict(zip(pairs.tolist(), counts.tolist())) == want
    known = phrases.Pairs(pairs, False)
    assert (known.look_up(a, b) == [pairs.tolist().index((int(x) << phrases.BITS) | int(y)) for x, y in zip(a, b)]).all()
    assert (known.look_up(np.array([15, 950]), np.array([950, 3])) == phrases.DEAD).all()


def test_scores_are_exact_beyond_64_bits(spark):
    n = 10**14 + 1
    rows = [("xx", "a", 1, n // 3), ("xx", "b", 1, n // 7), ("xx", "a b", 2, n // 11)]
    sizes = spark.createDataFrame([("xx", n)], "lang string, n long")
    got = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, m int, n long"), sizes).first()
    assert got.score == 1000 * (n // 11) * n // ((n // 3) * (n // 7))


# ---- sharding


def slots_are_whole(rows, shards):
    sizes = Counter(r.shard for r in rows)
    assert sorted(sizes.get(s, 0) for s in range(shards)) == sorted(sharding.shard_sizes(len(rows), shards).tolist())
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in sorted(sizes) for i in range(sizes[s])]


@pytest.mark.parametrize("sizes", [{}, {"segment_rows": 2, "bucket": 1, "groups": 2}, {"segment_bytes": 1}])
def test_shards_hold_all_rows_once(odd, sizes):
    docs = odd.withColumn("shard", F.lit("old")).withColumn("slot", F.lit("old"))
    dealt = sharding.shuffled(docs, 5, **sizes)
    rows = dealt.collect()
    slots_are_whole(rows, 5)
    assert Counter((r.doc_id, r.text, r["row"], r["key"]) for r in rows) == Counter(
        (r.doc_id, r.text, r["row"], r["key"]) for r in odd.collect()
    )
    assert dealt.columns == [*odd.columns, "shard", "slot"]


def test_shards_of_nothing_and_of_few(odd):
    assert sharding.shuffled(odd.limit(0), 24).count() == 0
    slots_are_whole(sharding.shuffled(odd.limit(3), 24).collect(), 24)


def test_shuffle_is_uniform_and_repeatable(spark):
    rows = spark.range(6000, numPartitions=3).select(F.col("id").alias("doc_id"))
    one, two, other = (
        {r.doc_id: (r.shard, r.slot) for r in sharding.shuffled(rows, 6, seed=s, segment_rows=500, bucket=100).collect()}
        for s in (1, 1, 2)
    )
    assert one == two and one != other
    # Where each twelfth of the input ends up: 12 x 6 shards x 4 quarters of the slots.
    cells = Counter((i // 500, s, slot // 250) for i, (s, slot) in one.items())
    expected = 6000 / (12 * 6 * 4)
    chi = sum((cells[a, s, q] - expected) ** 2 / expected for a in range(12) for s in range(6) for q in range(4))
    assert chi < 360  # 253 degrees of freedom or so, standard deviation 22


def test_matrix_has_exact_sums_and_law(spark):
    counts = spark.createDataFrame([(i, i % 7 + 1) for i in range(100)], "segment long, n long")
    rows = sharding.communication_matrix(counts, 8, 3, groups=5).collect()
    cells = {r.segment: np.diff([0, *r.ends]) for r in rows}
    assert all(cells[i].sum() == i % 7 + 1 and (cells[i] >= 0).all() for i in range(100))
    assert (sum(cells.values()) == sharding.shard_sizes(sum(i % 7 + 1 for i in range(100)), 8)).all()
    rng = np.random.default_rng(0)
    drawn = Counter(tuple(sharding.deal_rows(rng, np.array([2, 1]), [1, 2]).ravel().tolist()) for _ in range(6000))
    assert set(drawn) == {(1, 0, 1, 1), (0, 1, 2, 0)} and abs(drawn[1, 0, 1, 1] / 6000 - 2 / 3) < 0.03


def test_wide_urn_follows_the_same_law():
    rng = np.random.default_rng(0)
    drawn = Counter(sharding.wide_hypergeometric(rng, 6, 5, 4) for _ in range(20_000))
    law = {k: math.comb(6, k) * math.comb(5, 4 - k) / math.comb(11, 4) for k in range(5)}
    assert all(abs(drawn[k] / 20_000 - p) < 0.02 for k, p in law.items())
    large = [sharding.wide_hypergeometric(rng, 3 * 10**10, 6 * 10**10, 9 * 10**6) for _ in range(200)]
    spread = (9e6 * (1 / 3) * (2 / 3)) ** 0.5
    assert abs(np.mean(large) - 3e6) < 5 * spread / 200**0.5 and 0.75 < np.std(large) / spread < 1.25
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3
    assert sharding.wide_hypergeometric(rng, 10, 5, 15) == 10


def test_written_shards_keep_the_order_of_slots(spark, odd):
    out = scratch_dir(spark)
    sharding.write(sharding.shuffled(odd, 3), out)
    files = spark.read.parquet(out)
    assert files.count() == odd.count()
    rows = files.withColumn("f", F.input_file_name()).orderBy("f", F.monotonically_increasing_id()).collect()
    by_shard = {s: [r.slot for r in rows if r.shard == s] for s in range(3)}
    assert all(slots == sorted(slots) for slots in by_shard.values())
