"""Every corpus operator against its plain definition on whole small tables, and on odd rows."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from dockflow.llm import ann, bpe, common, components, langid, lm, minhash, packing, quality, suffix_dedup, token_files, url_filter
from dockflow.llm.common import crc_fold, fold
from dockflow.llm.oracle import STATEMENTS
from dockflow.llm.queries import QUERIES
from dockflow.session import scratch_dir
from odd_rows import odd_texts, with_clashes
from oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"
BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
WORD_JSON = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in odd_texts()]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return with_clashes(spark.createDataFrame(rows, schema)).repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    out = {}
    for path in (BYTE_JSON, WORD_JSON):
        out[path] = Tokenizer.from_file(path)
        out[path].encode_special_tokens = True
    return out


@pytest.mark.parametrize("key", sorted(STATEMENTS))
def test_query_matches_sql(spark, key):
    assert compare(spark, connect(SMALL), key, QUERIES[key], STATEMENTS[key], SMALL) == ""


# ---- nearest neighbours --------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank string")


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], "", ""), (1, [1.0, 1.0], "", ""), (2, [1.0, -1.0], "", ""), (3, None, "", ""), (4, [], "", "")]
    rows += [(5, [0.0, 0.0], "", ""), (6, [float("nan"), 1.0], "", ""), (7, [float("inf"), 1.0], "", ""), (20, [2.0, 0.0], "", "")]
    rows += [(8, [None, 1.0], "", ""), (9, [1.0, 2.0, 3.0], "", ""), (1, [1.0, 1.0], "", ""), (None, [1.0, 1.0], "", "")]
    found = ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=3).collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    assert by == {0: [(20, 2.0), (1, 1.0), (1, 1.0)], 20: [(0, 2.0), (1, 2.0), (1, 2.0)]}


def test_neighbours_of_no_vectors(spark):
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_blocks_agree_with_brute_force():
    rng = np.random.default_rng(1)
    c = np.concatenate([rng.standard_normal((3000, 37)), rng.standard_normal((2, 37)) * 1e6]).astype(np.float32).astype(float)
    c[5] = c[6]
    ids = np.arange(len(c)) * 3
    heaps = ann.tile_search(ids[:40], c[:40], ids, c, 20).heaps
    for i in range(40):
        scores = (c * c[i]).cumsum(axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:20]
        assert sorted(heaps[i], reverse=True) == [(scores[j], -ids[j]) for j in order]


# ---- URL filter ----------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "no scheme", "http://Org", "http://a.ORG/x?y#z", "https://example.org/es/1", "https://x.example.org/en/12#a",
            "https://example.org/en/2", "http://a.com/fr/q", "http://a.com/de/q", "http://notorg/x", "://", "http://h?x/y", "a://b://c/d"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(0, None, "clash"), (None, "http://a.org/x", "clash")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert by[0] == by[1] == by[10] == ("", "", None, "allow")
    assert by[2] == ("org", "", None, "allow")
    assert by[3] == ("a.org", "/x", "org/", "allow")
    assert by[4] == ("example.org", "/es/1", "example.org/es/", "block")
    assert by[5] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert by[6][2:] == ("org/", "allow")
    assert by[7][2:] == ("com/fr/", "allow") and by[8][2:] == ("com/de/", "block")
    assert by[9] == ("notorg", "/x", None, "allow") and by[11] == ("h", "", None, "allow")
    assert by[12] == ("b:", "//c/d", None, "allow")


def test_a_template_that_labels_reject_takes_the_rest_of_its_host(spark):
    rules = (("block", "shop.test/ads/1"), ("allow", "shop.test/news/"))
    urls = [f"http://shop.test/ads/{n}" for n in range(100, 200)] + [f"http://shop.test/news/{n}" for n in range(50)]
    rows = [(i, u) for i, u in enumerate([*urls, "http://shop.test/ads/777", "http://shop.test/blog/x"])]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    rest, blog = got[len(urls)], got[len(urls) + 1]
    assert (rest.template, rest.rule, rest.verdict) == ("/ads/*", None, "block")
    assert (blog.template, blog.rule, blog.verdict) == ("/blog/x", None, "allow")


def test_branches_deep_in_a_path_are_apart(spark):
    rules = (("block", "deep.test/blog/2024/05/13/ads/1"), ("allow", "deep.test/blog/2024/05/13/post/1"))
    start = "http://deep.test/blog/2024/05/13"
    urls = [f"{start}/{kind}/{n}/x" for kind in ("ads", "post") for n in range(100, 200)]
    rows = [(i, u) for i, u in enumerate([*urls, f"{start}/ads/777/x", f"{start}/post/777/x", "http://deep.test" + "/a" * 300])]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    ads, post, long = (got[len(urls) + i] for i in range(3))
    assert (ads.template, ads.rule, ads.verdict) == ("/blog/*/*/*/ads/*/x", None, "block")
    assert (post.template, post.rule, post.verdict) == ("/blog/*/*/*/post/*/x", None, "allow")
    assert long.template == "/a" * 300


def test_names_deep_in_a_path_become_wildcards(spark):
    word = lambda n: "".join(chr(97 + n // 26**i % 26) for i in range(3))
    rows = [(n, f"http://deep.test/a/b/c/d/e/{word(n)}/end.html") for n in range(20)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.template for r in got} == {"/a/b/c/d/e/*/end.html"}


def test_alike_branches_merge_at_every_node_as_in_sql(spark):
    """Six segments and more below one host: sections and days merge where their shares agree, leaves first."""
    word = lambda n: "".join(chr(97 + n // 26**i % 26) for i in range(3))
    urls = []
    for host in ("www.shop.org", "shop.com", "h.net"):
        for lang in ("es", "fr", "de", "en"):
            for section in ("ads", "blog", "news"):
                for part in ("a", "b", "c"):
                    for n in range(6):
                        urls.append(f"http://{host}/{lang}/x/{section}/y/{part}/{word(n * n)}/z/q{n % 2}.html")
    urls += [f"http://a.example.org/en/{n}/s/t/u/v{'/w' * (n % 4)}" for n in range(40)] + [None, "none", "http://shop.com"]
    urls += ["http://shop.com/de/x/y/z/bad/p1", "http://shop.com" + "/a" * 40] + urls[:5]
    urls += [f"http://m.com/{'de' if n % 3 else 'fr'}/{s}/k/{word(n)}" for n in range(30) for s in ("u", "v")]
    rows = [(i, u) for i, u in enumerate(urls)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).toPandas()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]))
    want = con.execute(STATEMENTS["op2_url_filters"]).df()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    assert key(got) == key(want)
    assert got.merged.str.count(r"\?").max() >= 3


def test_a_chain_without_branches_is_one_step(spark):
    urls = [f"http://deep.test{'/a' * 60}/{end}/{n}" for end in ("x", "y") for n in range(20)] + [f"http://deep.test{'/a' * 60}"]
    rows = list(enumerate(urls))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.template for r in got} == {"/a" * 60, "/a" * 60 + "/x/*", "/a" * 60 + "/y/*"}


def test_no_urls(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# ---- removal of repeats --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 0])
def test_repeats(spark, docs, texts, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r.doc_id: r for r in suffix_dedup.digests(docs).collect()}
    for i, (b, spans) in brute.covered(texts).items():
        want = (len(b), sum(hi - lo for lo, hi in spans), len(spans), brute.sha(brute.without(b, spans)))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_repeats_of_odd_rows(odd, none):
    got = defaultdict(list)
    for r in suffix_dedup.digests(odd).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed))
    first, copies = got[1][0], got[5]
    assert first[1] == 0 or first[0] > first[1]  # the first text repeats itself
    assert copies == [(first[0], first[0])] * 2  # both rows of a repeated document go as one
    assert got[2] == [(0, 0)] and got[3] == [(0, 0)] and got[6] == [(1, 0)]
    assert got[9][0] == (300_000, 300_000 - 5) and got[10][0][1] >= 29_900
    assert suffix_dedup.digests(none).count() == 0


def test_repeats_leave_whole_characters(odd):
    rows = suffix_dedup.without_repeats(odd)
    assert rows.columns == odd.columns
    assert rows.count() == odd.count() and rows.where("text is null").count() == odd.where("text is null").count()
    assert rows.where("row = 'extra row' and kept = 'extra kept'").count() == odd.count()


def test_anchors_of_equal_strings_agree_across_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 5000, np.uint8).tobytes()
    at, gram, around = suffix_dedup.anchors(text)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 512)
    again = suffix_dedup.anchors(text)
    assert all((a == b).all() for a, b in zip((at, gram, around), again))


# ---- byte-level BPE ------------------------------------------------------------------------------------------------


def test_bpe(docs, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in texts:
        assert np.frombuffer(got[i], "<u4").tolist() == own.encode_ordinary(t or "")
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in ("a" * 5000, "ab" * 3000, " " * 999, "  x \n \n  y\u00a0 z ", "it's  'll\t\tok \x1c x", "日本語" * 500, "e\u0301" * 50, "\n \nb  "):
        assert codec.encode(t).tolist() == own.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_bpe_of_odd_rows(odd, none):
    digests = bpe.decoded_digests(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    want = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        want[r.doc_id].append(brute.sha((r.text or "").encode()))
    got = defaultdict(list)
    for r in digests.collect():
        got[r.doc_id].append(r.decoded_sha256)
        assert (r.n_tokens == 0) == (r.decoded_sha256 == brute.sha(b""))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_merged_together_are_those_merged_alone():
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = np.random.default_rng(5)
    pieces = [bytes(rng.choice(list(b"aabnt eros\xc3\xa9"), rng.integers(1, 40)).tolist()) for _ in range(400)] + [b"aa" * 300]
    assert codec.merge(pieces) == [codec.merge([p])[0] for p in pieces] and codec.merge([]) == []
    # Ranks that a merge can lead below its own are taken in the order of the ranks, too.
    codec.ranks = {bytes([c]): 200 + c for c in range(256)} | {b"bc": 9, b"abc": 3, b"ab": 20, b"cb": 9}
    for text in (b"abcbc", b"bcbcbc", b"abcabcab"):
        parts = [text[i : i + 1] for i in range(len(text))]
        while True:
            joined = [(codec.ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not joined or min(joined)[0] == 10**9:
                break
            i = min(joined)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert codec.merge([text])[0] == [codec.ranks[p] for p in parts]


def test_memo_is_bounded_in_bytes():
    memo = common.Memo(lambda k: k * 2, limit=20_000)
    for i in range(2000):
        key = str(i) * (1000 if i % 97 == 0 else 1)
        assert memo[key] == key * 2 and memo["0" * 1000] == "0" * 2000
        held = sum(common.ENTRY + 3 * len(k) for k in (*memo, *memo.before))
        assert held <= 2 * (20_000 + common.ENTRY + 3 * 4000)
    other = common.Memo(lambda k: k)
    other["x"], memo.lacks(["x"])
    common.only(other)
    assert not memo and not memo.before and list(other) == ["x"] and memo.lacks(["x", "x"]) == ["x"]


def test_rank_queue_is_a_priority_queue():
    rng = np.random.default_rng(4)
    queue, want = bpe.RankQueue(50_000), []
    for rank, place in zip(rng.integers(0, 50_000, 2000).tolist(), rng.integers(0, 100, 2000).tolist()):
        queue.push(rank, place)
        want.append((rank, place))
    buckets = defaultdict(list)
    for rank, place in sorted(want):
        buckets[rank].append(place)
    assert [queue.pop() for _ in buckets] == sorted(buckets.items()) and queue.pop() is None
    assert not any(any(level) for level in queue.levels)


# ---- quality -------------------------------------------------------------------------------------------------------


def test_quality_of_odd_rows(odd, none):
    got = defaultdict(list)
    for r in quality.judge(odd).collect():
        got[r.doc_id].append(r)
    for i in (2, 3, 4):
        assert (got[i][0].n_words, got[i][0].word_chars, got[i][0].base_failed, got[i][0].kept) == (0, 0, True, False)
    assert got[5][0] == got[5][1] and got[9][0].n_repeat_words == 60_000 and got[9][0].base_failed
    assert got[11][0].n_symbols == 6
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and quality.judge(none).count() == 0


# ---- near duplicates -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, texts, size):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.groups(docs, size=size).collect()}
    assert got == brute.near_duplicates(texts, size)


def test_links_that_no_centre_has(spark):
    """A chain of texts, each similar to its neighbours only."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(f"z{i}x{k}" if k % 41 in range(i, i + 4) else w for k, w in enumerate(base))) for i in range(12)]
    rows += [(100 + i, " ".join([*base[: 380 - i], *[f"q{j}" for j in range(30)]])) for i in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()}
    assert got == brute.near_duplicates(rows, 1)


def _rows_of_tile(sets, roots, own):
    hashes = pa.array([sorted(x) for x in sets], pa.list_(pa.int64()))
    return pa.table({"own": pa.array(own, pa.int32()), "root": pa.array(roots, pa.int64()), "hashes": hashes})


def test_a_group_gives_rows_by_its_size_not_by_its_pairs():
    """200 sets of which every two are linked: one row for each but the least; between joined blocks one row for all."""
    sets = [{*range(100), 1000 + i} for i in range(200)]
    roots = [500 - i for i in range(200)]
    whole = minhash._tile(_rows_of_tile(sets, roots, [0] * 200), 80)
    assert sorted(zip(*whole.to_pydict().values())) == [(301, r) for r in range(302, 501)]
    cross = minhash._tile(_rows_of_tile(sets, roots, [i % 2 for i in range(200)]), 80)
    assert cross.to_pydict() == {"u": [301], "v": [302]}


def test_tiles_of_blocks_join_what_the_links_join():
    rng = np.random.default_rng(5)
    n, blocks = 240, 3
    base = [set(rng.choice(4000, 40, replace=False).tolist()) for _ in range(30)]
    sets = [base[i % 30] - set(rng.choice(sorted(base[i % 30]), rng.integers(0, 8), replace=False).tolist()) for i in range(n)]
    roots, own = rng.permutation(n) // 2, rng.integers(0, blocks, n)
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    links = {(roots[a], roots[b]) for a in range(n) for b in range(n) if near(a, b) and roots[a] != roots[b]}
    found = set()
    for i in range(blocks):
        for j in range(i, blocks):
            at = [k for k in range(n) if own[k] in (i, j)]
            tile = minhash._tile(_rows_of_tile([sets[k] for k in at], [roots[k] for k in at], [own[k] for k in at]), 80)
            found |= set(zip(*tile.to_pydict().values()))

    def labels(edges):
        top = list(range(n))
        for _ in range(n):
            before = list(top)
            for u, v in edges:
                top[u] = top[v] = min(top[u], top[v])
            if top == before:
                return top

    assert labels(found) == labels(links) and len(found) < len(links) / 4


def test_near_duplicates_of_odd_rows(odd, none):
    got = defaultdict(list)
    for r in minhash.groups(odd).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[2] == [(0, 2, True)] and got[4] == [(0, 4, True)] and got[6] == [(1, 6, True)]
    assert [x[1:] for x in got[5]] == [(1, False)] * 2 and got[1][0][1:] == (1, True)
    assert sorted(got[None]) == [(0, None, True), (got[None][1][0], None, True)] or len(got[None]) == 2
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 0
    assert kept.count() == odd.count() - 2 and minhash.groups(none).count() == 0


def test_components(spark):
    edges = [(9, 3), (3, 7), (1, 2), (2, 5), (8, 9), (4, 4)]
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {3: 3, 7: 3, 8: 3, 9: 3, 1: 1, 2: 1, 5: 1}


# ---- language models -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("top", [lm.TOP_WORDS, 50])
def test_unigram_scores(docs, texts, top, monkeypatch):
    monkeypatch.setattr(lm, "TOP_WORDS", top)
    monkeypatch.setattr(lm, "ROUNDS", 0)
    want, n = brute.unigrams(texts, {i: crc_fold(i, 10) == 0 for i, _ in texts})
    for r in lm.score(docs, fold("doc_id", 10) == 0, BYTE_JSON).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*want[r.doc_id][:2], n, crc_fold(r.doc_id, 10) == 0)
        assert r.base_score == pytest.approx(want[r.doc_id][2])


def test_training_raises_the_held_out_score(docs, monkeypatch):
    total = lambda: lm.score(docs, fold("doc_id", 10) == 0, BYTE_JSON, share=2).where("held_out").agg(F.sum("score")).first()[0]
    trained = total()
    monkeypatch.setattr(lm, "ROUNDS", 0)
    assert trained > total() * 0.95  # log scores are negative


def test_every_window_is_trained_on(docs, texts, monkeypatch):
    assert lm.SHARE == 1
    own, rng = lm.subwords(BYTE_JSON), np.random.default_rng(4)
    for n in (1, 15, 16, 17, 255, 256, 257, 5000):
        ids = rng.integers(0, lm.START, n)
        found = [lm.unrolled(np.frombuffer(line, "<u2"), k) for _, k, line in lm.runs(ids, lm.START, 1, 7, 8)]
        assert (np.concatenate(found) == lm.windows(ids)).all()
    seen = []
    monkeypatch.setattr(lm, "ROUNDS", 0)
    monkeypatch.setattr(lm, "_train", lambda model, texts, share: seen.append(texts.agg(F.sum("windows")).first()[0] / share))
    lm.score(docs, fold("doc_id", 10) == 0, BYTE_JSON)
    assert seen == [sum(-(-len(own.split((t or "").encode())[1]) // lm.HALF) for i, t in texts if crc_fold(i, 10) != 0)]


def test_production_training_raises_the_held_out_score(docs, monkeypatch):
    total = lambda: lm.score(docs, fold("doc_id", 10) == 0, BYTE_JSON).where("held_out").agg(F.sum("score")).first()[0]
    trained = total()
    monkeypatch.setattr(lm, "ROUNDS", 0)
    assert trained > total() * 0.95


def test_gradient_is_the_slope():
    rng = np.random.default_rng(6)
    p = {n: v.astype(np.float64) for n, v in lm.unpack(lm.initial(np.ones(lm.CLASSES))).items()}
    rows = lm.windows(rng.integers(0, lm.CLASSES, 50)).astype(np.int32)

    def loss():
        y = lm.forward(p, rows[:, :-1].clip(0))
        t = rows[:, lm.HALF + 1 :].ravel()
        return -y[np.flatnonzero(t >= 0), t[t >= 0]].mean()

    g = lm.gradient(p, rows)
    for name in p:
        at = tuple(int(rng.integers(0, k)) for k in p[name].shape)
        step = 1e-4
        p[name][at] += step
        up = loss()
        p[name][at] -= 2 * step
        down = loss()
        p[name][at] += step
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=2e-5)


def test_scores_are_those_of_attention_token_by_token():
    """Every id by itself, from the definition, in double precision."""
    rng = np.random.default_rng(8)
    model = lm.Model(rng.integers(0, 50, 2000), rng.random(2000) < 0.5)
    model.flat = (model.flat + rng.normal(0, 0.2, len(model.flat))).astype(np.float32)
    texts = [rng.integers(0, 2000, n) for n in (1, 15, 16, 17, 40, 333)]
    weights = {n: v.astype(np.float64) for n, v in lm.unpack(model.flat).items()}
    want = [brute.attention_score(weights, model.classes[t].tolist(), lm) + model.share[t].sum() / np.log(10) for t in texts]
    assert model.scores(texts) == pytest.approx(want, rel=1e-4)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(9)
    p = lm.unpack(lm.initial(rng.integers(0, 1000, lm.CLASSES).astype(float)))
    rows = lm.windows(rng.integers(0, lm.CLASSES, 70))
    y = lm.forward(p, rows[:, :-1].clip(0))
    assert np.exp(y).sum(1) == pytest.approx(np.ones(len(y)), rel=1e-4)
    target = rows[:, lm.HALF + 1 :].ravel().clip(0)
    assert lm.target_scores(p, rows[:, :-1].clip(0), target) == pytest.approx(y[np.arange(len(y)), target], rel=1e-4)
    steep = np.array([[300.0, 1.0, -300.0], [-400.0, -401.0, -402.0]], np.float32)
    assert lm.exponents(steep)[2] == pytest.approx([300.0, -400 + np.log(1 + np.exp(-1) + np.exp(-2))], rel=1e-4)


def test_subwords_are_those_of_the_library(texts):
    own = lm.subwords(BYTE_JSON)
    for _, text in texts[:60]:
        words = (text or "").encode().lower().split()
        alone = [i for w in words for i in own.tokenizer.encode(" " + w.decode(), add_special_tokens=False).ids]
        hashes, ids = own.split((text or "").encode())
        assert ids.tolist() == [*alone, own.end]
        assert hashes.view(np.uint64).tolist() == [xxhash.xxh64_intdigest(w) for w in words]


def test_windows_score_every_id_once():
    for n in (1, 16, 17, 33, 100):
        rows = lm.windows(np.arange(n))
        target = rows[:, lm.HALF + 1 :].ravel()
        assert target[target >= 0].tolist() == list(range(n))
        assert ((rows[:, lm.HALF : -1] == target.reshape(len(rows), -1) - 1) | (target.reshape(len(rows), -1) <= 0)).all()


def test_scores_of_odd_rows(odd, none):
    got = defaultdict(list)
    for r in lm.score(odd, fold("doc_id", 10) == 0, BYTE_JSON).collect():
        got[r.doc_id].append(r)
    assert got[2][0].n_tokens == 1 and got[2][0].score < 0 and got[5][0] == got[5][1]
    assert np.isfinite([r.score for rows in got.values() for r in rows]).all()
    assert all(r.held_out for r in got[None])
    assert lm.score(none, fold("doc_id", 10) == 0, BYTE_JSON).count() == 0


# ---- language ------------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found) and not any(r.rejected for r in found)


def test_language_of_odd_rows(odd, none, docs):
    model = langid.fit(docs)
    got = defaultdict(list)
    for r in langid.predict(odd, model).collect():
        got[r.doc_id].append((r.lang_pred, r.rejected))
    for i in (2, 3, 4, 11):
        assert got[i] == [("und", True)]
    assert got[5][0] == got[5][1] and got[9][0][0] != "und" and sorted(got[None])[0] == ("fr", False)
    kept = langid.keep_known(odd, model)
    assert kept.columns == odd.columns and kept.where("doc_id in (2, 3, 4, 11)").count() == 0
    empty = langid.fit(none)
    assert langid.predict(none, empty).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def test_unknown_languages_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(3)
    unknown = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
        "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 3000)),
        base64.b64encode(rng.bytes(2000)).decode(),
        "int main(int argc, char **argv) { for (int i = 0; i < argc; i++) { printf(argv[i]); } return 0; }",
        "qxzj " * 20,
    ]
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    for times in (1, 8):
        assert model.judge([(t * times).encode() for t in unknown])[2].all()
    known = docs.where((fold("doc_id", 4) == 2) & F.col("text").isNotNull())
    assert not langid.predict(known, model).where("rejected").count()
    pieces = [" ".join(r.text.split()[:n]).encode() for r in known.limit(60).collect() for n in (20, 50) if len(r.text.split()) >= 50]
    assert pieces and model.judge(pieces)[2].mean() < 0.02


# ---- token files ---------------------------------------------------------------------------------------------------


def test_token_files(spark, docs, texts, library):
    out = scratch_dir(spark)
    token_files.write(docs, WORD_JSON, out)
    got, start = {r.doc_id: r for r in token_files.read(spark, out).collect()}, 0
    for i, t in sorted(texts):
        ids = [*library[WORD_JSON].encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        start += len(ids)


def test_token_files_of_odd_rows(spark, odd, none, library):
    for table in (odd, none):
        out = scratch_dir(spark)
        token_files.write(table, WORD_JSON, out)
        got = token_files.read(spark, out).orderBy("start").collect()
        want = table.orderBy("doc_id", F.xxhash64("text")).collect()
        assert [r.doc_id for r in got] == [r.doc_id for r in want]
        for r, w in zip(got, want):
            ids = [*library[WORD_JSON].encode(w.text or "", add_special_tokens=False).ids, 1]
            assert np.frombuffer(r.ids, "<u4").tolist() == ids


def test_no_frequent_pair_is_left(texts):
    """On a block of real ids, and on runs of one id, whose pairs overlap."""
    encoder = token_files.word_level(WORD_JSON)
    real = np.concatenate(encoder.encode_many([(t or "").encode() for _, t in texts]))
    for ids in (real, np.full(30_000, 7, np.uint16), np.tile(np.array([3, 3, 5], np.uint16), 9000)):
        symbols, left, right, lengths = token_files.compress(ids)
        pairs, counts = np.unique((symbols[:-1].astype(np.uint32) << 16) | symbols[1:], return_counts=True)
        assert not len(counts) or counts.max() < token_files.LEAST
        reader = token_files.BlockReader(*(p.tobytes() for p in (symbols, left, right, lengths)))
        assert (reader.ids(0, len(ids)) == ids).all() and len(symbols) + 2 * len(left) < len(ids)


def test_ids_must_leave_room_for_rules(spark, docs):
    with pytest.raises(ValueError, match="stand for rules"):
        token_files.write(docs, BYTE_JSON, scratch_dir(spark))


def test_any_run_of_a_block_can_be_read():
    rng = np.random.default_rng(8)
    ids = np.concatenate([np.tile(rng.integers(0, 300, 40), 200), np.full(3001, 7), rng.integers(0, 49_408, 999)]).astype(np.uint16)
    parts = token_files.compress(ids)
    assert len(parts[0]) < len(ids) / 4
    reader = token_files.BlockReader(*(p.tobytes() for p in parts))
    for a, b in [(0, len(ids)), (5, 5), (17, 8123), (10_000, 10_001), (len(ids) - 1, len(ids))]:
        assert (reader.ids(a, b) == ids[a:b]).all()


# ---- packing -------------------------------------------------------------------------------------------------------


def check_packing(rows, pieces, encode):
    by, lengths = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        lengths[p.sequence_id].append((p.offset, p.length))
    whole = defaultdict(list)
    for i, t in rows:
        whole[i].append([*encode(t or ""), 0])
    assert set(by) == set(whole)
    for i, want in whole.items():
        assert sum(p.length for p in by[i]) == sum(map(len, want))
        for p in by[i]:
            ids = np.frombuffer(p.ids, "<u4").tolist()
            assert any(ids == w[p.start : p.start + p.length] and p.doc_tokens == len(w) for w in want)
    for parts in lengths.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0


def test_packing(docs, texts, library):
    encode = lambda t: library[BYTE_JSON].encode(t, add_special_tokens=False).ids
    check_packing(texts, packing.pack(docs, BYTE_JSON).collect(), encode)


def test_packing_of_odd_rows(odd, none, library):
    encode = lambda t: library[BYTE_JSON].encode(t, add_special_tokens=False).ids
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check_packing(rows, packing.pack(odd, BYTE_JSON).collect(), encode)
    assert packing.pack(none, BYTE_JSON).count() == 0


def test_hilbert_neighbours_are_one_step_apart():
    side = np.arange(8)
    cells = np.array(np.meshgrid(*[side] * 3, indexing="ij")).reshape(3, -1).T
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_folds_agree(spark):
    rows = spark.range(50).select("id", fold("id", 7).alias("f")).collect()
    assert all(r.f == crc_fold(r.id, 7) == zlib.crc32(str(r.id).encode()) % 7 for r in rows)
