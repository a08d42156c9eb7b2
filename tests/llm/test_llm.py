"""Operators against brute force, exact round trips or held-out accuracy, and edge cases."""

import collections
import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from lodestone.llm import components, langid, linededup, maxscore, mixing, ngramjoin, packing, quality, registry, sharding, substring, winnowing
from lodestone.llm.common import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def edge_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    base = " ".join(f"b{i}" for i in range(60))
    return [
        (1, base, "en", "a", None), (2, base, "en", "a", 1), (3, base + " tail", "en", None, 2), (3, base + " tail", "en", None, 2),
        (4, "", "en", "b", 0), (5, None, None, None, None), (None, base, "en", "b", 3), (6, long, "de", "b", 4),
        (7, " \n\t ", "en", "a", 5), (8, "one", "en", "a", 6), (9, "x y z " * 50, "fr", "c", 7), (10, "Ünï çødé 漢字 \U0001f600", "fr", "c", 8),
    ]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """A folder with an edge-case documents table (and one with none), a clashing column added."""
    out = {}
    for name, rows in (("edge", edge_rows()), ("empty", [])):
        folder = str(tmp_path_factory.mktemp(name))
        df = spark.createDataFrame(rows, DOC).selectExpr("*", "doc_id AS score", "source AS shard")
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (8, 0, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(0, [1.0, 2.0], 0), (50, [1.0, None], 0), (1, None, 0), (100, [0.5, float("nan")], 0), (2, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)] if rows else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
        spark.createDataFrame([(1, None, None), (2, "http://a.b/c", "<p>x</p><p>y</p>"), (3, "x", "")] if rows else [], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
        out[name] = folder
    return out


#: Tested with edge cases of their own in test_resample_merkle_chat.py.
APART = {"op11_resample", "op12_merkle", "op13_chat"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - APART))
def test_edge_cases_and_empty_tables(spark, edges, name):
    assert registry.QUERIES[name](spark, edges["empty"]).count() == 0
    found = registry.QUERIES[name](spark, edges["edge"]).toPandas()
    if name not in ("op6_maxscore", "op8_packing", "op10_linededup"):
        assert len(found) == len(edge_rows())
    if name == "op6_maxscore":
        assert found[["query_id", "rank", "vec_id", "score"]].sort_values("rank").values.tolist() == [[0, 1, 2, 256 * 256 * 5], [0, 2, 3, 256 * 256 * 5], [0, 3, 3, 256 * 256 * 5]]
    if name == "op5_ngramjoin":
        got = dict(zip(found.doc_id, found.component_id))
        assert got[1] == got[2] == got[3] == 1 and got[4] == 4 and got[8] == 8
    if name == "op3_substring":
        assert found[found.doc_id == 2].n_removed.tolist() == [60] and found[found.doc_id == 8].n_removed.tolist() == [0]
    if name == "op9_langid":
        assert set(found[found.doc_id.isin([4, 5, 7])].lang_pred) == {"und"}


def test_sharding(spark, docs):
    out = sharding.op1_sharding(spark, SF).toPandas().merge(docs[["doc_id", "text"]])
    assert (out["size"] == out.text.map(lambda t: len(t.encode()) + 16)).all()
    assert (out.text_crc32 == out.text.map(lambda t: zlib.crc32(t.encode()))).all()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = out[out.shard != out.grown_shard]
    assert set(moved.grown_shard) <= {40} and len(moved) < 40


def rendezvous_score(key, shard, weight=1.0, seed=0):
    """-weight / ln(u) of a key and a shard, from the published hash function."""
    h = 42
    for part in (int(seed).to_bytes(4, "little"), int(key is None).to_bytes(4, "little"), str("" if key is None else key).encode(), int(shard).to_bytes(4, "little")):
        h = xxhash.xxh64(part, seed=h).intdigest()
    return -weight / math.log(((h >> 11) + 0.5) / (1 << 53))


def test_sharding_matches_brute_force(spark):
    weights = [1.0, 2.0, 0.5, 1.5]
    rows = [(k,) for k in [*range(300), None, -5, 1 << 40]]
    out = sharding.shard(spark.createDataFrame(rows, "k long"), "k", weights, grown_weight=1.0).collect()
    assert len(out) == len(rows)
    for r in out:
        scores = [rendezvous_score(r.k, i, w) for i, w in enumerate([*weights, 1.0])]
        assert r.shard == max(range(4), key=lambda i: (scores[i], -i))
        assert r.grown_shard == max(range(5), key=lambda i: (scores[i], -i))


def test_sharding_follows_weights(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    counts = sharding.shard(df, "k", [1.0, 3.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert abs(counts[1] / 20_000 - 0.75) < 0.02


def test_waterfill():
    assert mixing.waterfill([10, 10, 10], [5, 2, 1], 3) == [18.75, 7.5, 3.75]
    assert mixing.waterfill([1, 10, 10], [100, 1, 1], 3) == [3, 9, 9]
    assert mixing.waterfill([], [], 3) == []


def test_mixing_meets_targets(spark, docs):
    out = mixing.op2_mixing(spark, SF).toPandas()
    again = mixing.op2_mixing(spark, SF).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert (out.taken <= 3 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
    by = out.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), short=("size", "median"))
    assert abs(by.target.sum() - by["size"].sum()) < 1e-3 * by["size"].sum()
    assert ((by.taken - by.target).abs() <= by.short.clip(lower=30)).all()
    repeated = mixing.mix(table(spark, SF, "documents")).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    assert repeated == {d: c for d, c in zip(out.doc_id, out.copies) if c}


def test_mixing_rates_solve_the_dual(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("abc"), rng.choice([0, 3, 10, 50, 400])) for i in range(600)]
    out = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    sums = [sum(z for _, s, z in rows if s == name) for name in "abc"]
    targets = dict(zip("abc", mixing.waterfill(sums, [5, 2, 1], 3)))
    for name, g in out.groupby("source"):
        z, target = g["size"].to_numpy(float), targets[name]
        assert g.target.iloc[0] == pytest.approx(target)
        low, high, mean = -1e3, 1e3, z.sum() / len(z)
        for _ in range(200):  # the tilt by bisection
            mid = (low + high) / 2
            rates = 3 / (1 + 2 * np.exp(-np.clip(mid * z / mean, -700, 700)))
            low, high = (mid, high) if (rates * z).sum() < target else (low, mid)
        assert np.allclose(g.rate[g["size"] > 0], rates[z > 0], atol=1e-4)
        # Copies are the rates rounded, but for the few that settle the source's total.
        assert (g.copies[g["size"] > 0] - g.rate[g["size"] > 0]).abs().max() <= 3 and abs((g.copies * z).sum() - target) <= 400
    assert (out.copies <= 3).all()


@pytest.mark.parametrize("count", [30, 3000])
def test_mixing_of_many_sources(spark, count):
    rows = [(i, f"s{i % count:05d}", 10 + i % 7) for i in range(2 * count)]
    out = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, source string, size long")).toPandas()
    by = out.groupby("source").agg(taken=("copies", "sum"), target=("target", "first"))
    assert len(by) == count and len(out) == 2 * count and by.target.sum() == pytest.approx(sum(r[2] for r in rows))


def test_mixing_keeps_rows_that_are_alike(spark):
    rows = [(1, "a", "one two three")] * 7 + [(None, None, "x y")] * 5 + [(2, "b", "p q r s")] * 3
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    plan = mixing.mix_plan(spark.createDataFrame([(d, s, len(t.split())) for d, s, t in rows], "doc_id long, source string, size long")).toPandas()
    assert out.groupby("source", dropna=False).size().to_dict().get("a", 0) == plan[plan.source == "a"].copies.sum()
    assert len(out) == plan.copies.sum()


def brute_substring(docs, window=20):
    seen, out = set(), {}
    for d, t in zip(docs.doc_id, docs.text):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_matches_brute_force(spark, docs):
    got = {r[0]: tuple(r[1:]) for r in substring.op3_substring(spark, SF).collect()}
    assert got == brute_substring(docs)


def test_substring_index_grows_batch_by_batch(spark, docs):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = [rng.choice("abcdef") for _ in range(rng.randint(0, 90))]
        if rows and rng.random() < 0.7:
            other = rows[rng.randrange(len(rows))][1].split()
            a = rng.randint(0, len(other))
            words[len(words) // 2 : len(words) // 2] = other[a : a + rng.randint(0, 50)]
        rows.append((i, " ".join(words)))
    want = brute_substring(pd.DataFrame(rows, columns=["doc_id", "text"]), 8)
    index, got = substring.FingerprintIndex(spark, window=8, gram=3, fanout=2), {}
    for i in range(0, 60, 15):
        batch = spark.createDataFrame(rows[i : i + 15], "doc_id long, text string")
        got |= {r[0]: tuple(r[1:]) for r in index.add(batch).collect()}
        index.commit()
    assert got == want
    assert len(index.runs) < 4


def random_passages(n, seed, letters="abcdef"):
    """Texts of few words with much of each taken from those before."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(letters) for _ in range(rng.randint(0, 90))]
        if rows and rng.random() < 0.7:
            other = rows[rng.randrange(len(rows))][1].split()
            a = rng.randint(0, len(other))
            words[len(words) // 2 : len(words) // 2] = other[a : a + rng.randint(0, 50)]
        rows.append((i, " ".join(words)))
    return rows


def test_substring_index_is_opened_again_and_compacted(spark, tmp_path, monkeypatch):
    """Six batches, each added by an index opened anew from the manifest, with hot representatives."""
    monkeypatch.setattr(substring, "HOT_ROWS", 3)
    rows = random_passages(90, 5, "ab")
    want = brute_substring(pd.DataFrame(rows, columns=["doc_id", "text"]), 8)
    got, levels, folder = {}, [], f"file://{tmp_path}/index"
    for i in range(0, 90, 15):
        index = substring.FingerprintIndex(spark, window=8, gram=3, fanout=4, folder=folder, buckets=3)
        batch = spark.createDataFrame(rows[i : i + 15], "doc_id long, text string")
        got |= {r[0]: tuple(r[1:]) for r in index.add(batch).collect()}
        index.commit()
        levels.append(sorted(r["level"] for r in index.runs))
    assert got == want
    assert levels == [[0], [0, 0], [0, 0, 0], [1], [0, 1], [0, 0, 1]]
    assert any(r["hot"] for r in index.runs)


def test_substring_runs_are_merged_without_an_exchange(spark, tmp_path):
    index = substring.FingerprintIndex(spark, window=8, gram=3, folder=f"file://{tmp_path}/index", buckets=3)
    index.add(spark.createDataFrame(random_passages(30, 6), "doc_id long, text string")).collect()
    index.commit()
    asked = spark.range(0, 1000).select(substring.F.col("id").alias("g")).groupBy("g").count().select("g")
    plan = index._history(asked)._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "Bucketed: true" in line)
    join = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line)
    assert join < scan and not any("Exchange" in line for line in plan[join:scan])


def mirrored_words():
    """Two words of 1,024 letters that polynomials modulo 2^64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]


def test_words_of_one_structure_are_told_apart(spark):
    first, second = mirrored_words()
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{first} {tail}"), (2, f"{second} {tail}"), (3, f"{first} {tail}")]
    index = substring.FingerprintIndex(spark)
    assert {r.doc_id: r.n_removed for r in index.add(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 0, 2: 0, 3: 20}
    rows += [(4, f"x y z {first}"), (5, f"x y z {second}")]
    got = {r.doc_id: (r.class_id, r.component_id) for r in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, (99, 100)).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (1, 1), 4: (4, 4), 5: (5, 5)}


def test_segments_of_texts_past_the_position_bits(monkeypatch):
    """Places that start anew in the midst of a text change nothing."""
    monkeypatch.setattr(substring, "_LOW", 6)
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4, 700).astype(np.uint64)
    words[200:300], words[400:430] = 7, 7
    g, m, first = substring.segments(substring.grams(words, 3), np.array([len(words)]) - 2, 8, 3)
    windows = {}
    for a, n in zip(first.tolist(), m.tolist()):
        inside = [tuple(words[i : i + 10]) for i in range(a, a + n)]
        assert len(set(inside)) == n
        windows |= dict.fromkeys(range(a, a + n))
    assert list(windows) == list(range(698 - 8 + 1))


def test_quality_on_held_out_rows(spark):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.op4_quality(spark, "/root/testdata/sf0.01").toPandas().merge(labels)
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_quality_sees_repeated_words_to_the_end():
    head = [f"w{i}" for i in range(2500)]
    assert quality.features(" ".join(head))[-2] == 0
    assert quality.features(" ".join([*head, *["junk"] * 500]))[-2] == pytest.approx(499 / 2999)


def test_prior_without_negatives():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(2, 1, (400, 4)), rng.normal(-2, 1, (120, 4))
    unl = np.concatenate([rng.normal(2, 1, (280, 4)), neg])
    prior = quality.estimated_prior(pos, unl)
    assert 0.5 < prior < 0.9
    scorer = quality.train_nnpu(pos, unl, 0.7)
    assert (scorer(pos) >= 0.5).mean() > 0.95 and (scorer(neg) < 0.5).mean() > 0.95


def brute_components(docs, k, num, den):
    sets = {}
    for i, t in zip(docs.doc_id, docs.text):
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for j, n in collections.Counter(j for g in sets[i] for j in holders[g]).items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            holders[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join_matches_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.op5_ngramjoin(spark, SF).collect()}
    assert got == brute_components(docs, 4, 85, 100)


def near_copies():
    """Groups of near copies large enough for leaders, a chain, and outsiders that share its shingles."""
    rng, rows = random.Random(7), []
    base = [f"t{i}" for i in range(120)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(60, 90):
        chain[i - 60] = f"d{i}"
        rows.append((i, " ".join(chain)))
    for i in range(90, 110):
        rows.append((i, " ".join(base[:30] + [f"o{i}_{j}" for j in range(60)])))
    return rows


@pytest.mark.parametrize("k,share", [(4, (85, 100)), (5, (80, 100))])
def test_jaccard_join_of_large_groups(spark, k, share):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, share).collect()}
    assert got == brute_components(pd.DataFrame(rows, columns=["doc_id", "text"]), k, *share)


def test_jaccard_join_of_repeated_and_null_ids(spark):
    """Null doc_ids link like any; rows of one doc_id are judged each by its text."""
    words = [f"t{i}" for i in range(100)]
    bridge = [*words[:8], *(f"u{i}" for i in range(92))]
    texts = {1: words, None: ["z0", *words[1:]], 2: ["z0", "z1", *words[2:]], 7: bridge, 8: ["q", *bridge[1:]]}
    rows = [(d, " ".join(w)) for d, w in texts.items()] + [(9, " ".join(words)), (9, " ".join(bridge)), (9, "alone")] * 2 + [(None, "lonely words"), (4, None)]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, (98, 100)).collect())
    assert got == collections.Counter([(1, 100, 1), (None, 100, 1), (2, 100, 1), (7, 100, 7), (8, 100, 7), (9, 100, 1), (9, 100, 7), (9, 1, 9), (9, 100, 1), (9, 100, 7), (9, 1, 9), (None, 2, None), (4, 0, 4)])


def test_verifier_counts_words_not_hashes():
    rng = random.Random(2)
    for k, vocabulary in ((4, 30), (5, 3), (2, 200)):
        a, b = ([f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 200))] for _ in range(2))
        sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b)]
        for packs in (True, False):
            v = ngramjoin.Verifier(" ".join(a), k)
            if not packs:
                v.packs, v.mine = False, sets[0]
                v.mine = {tuple(x.encode() for x in g) for g in sets[0]}
            assert v.shared(" ".join(b)) == len(sets[0] & sets[1])


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_maxscore_shard_is_exact():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.integers(-200, 200, (500, 33)), np.zeros((20, 33), int), np.ones((30, 33), int)]).astype(np.int64)
    ids = rng.permutation(len(rows)).astype(np.int64)
    queries = np.concatenate([rows[:20], np.zeros((1, 33), np.int64)])
    own = np.append(ids[:20], -1)
    for q, (name, got_ids, got) in zip(queries, maxscore.maxscore_shard(queries, own, rows, ids, 5)):
        want = sorted((-int(s), int(i)) for s, i in zip(rows @ q, ids) if i != name)[:5]
        assert [(-int(s), int(i)) for s, i in zip(got, got_ids)] == want


@pytest.mark.parametrize("copies", [2, 6, 9])
def test_maxscore_shard_with_repeated_query_ids(copies):
    rng = np.random.default_rng(copies)
    rows = rng.integers(-200, 200, (400, 33)).astype(np.int64)
    rows[:copies] = rows[0] * 3
    ids = np.append(np.full(copies, 7), 100 + rng.permutation(400 - copies)).astype(np.int64)
    (own, got_ids, got), = maxscore.maxscore_shard(rows[:1], ids[:1], rows, ids, 5)
    want = sorted((-int(s), int(i)) for s, i in zip(rows @ rows[0], ids) if i != own)[:5]
    assert [(-int(s), int(i)) for s, i in zip(got, got_ids)] == want


def test_maxscore_of_large_components_and_several_shards(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [int(x) for x in rng.integers(-50, 50, 9)]) for i in range(400)] + [(1000, [1 << 31] * 9), (1001, [1 << 31, -(1 << 31)] + [0] * 7), (1002, [5, 7])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    want = {}
    for q, v in rows:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:5]
            want[q] = [(i, -s) for s, i in scores]
    if max(abs(s) for x in want.values() for _, s in x) >= 1 << 63:
        raise AssertionError("scores of this test fit a long")
    for shard_rows, query_rows in ((8192, 2048), (60, 3)):
        got = collections.defaultdict(list)
        for r in maxscore.top_k(df, df.filter("id % 50 = 0"), 5, shard_rows, query_rows).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert dict(got) == want
    big = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0])], "id long, e array<double>")
    with pytest.raises(Exception, match="too large"):
        maxscore.top_k(*[big.select("id", maxscore.quantized(maxscore.F.col("e"), 256).alias("v"))] * 2, 5).collect()


def test_short_text_shares_fingerprints_with_a_long_one_that_holds_it(spark):
    """Words are winnowed in texts of any length, so w + k - 1 common words are found across all of them."""
    short = "the committee met again on a cold day in the old town hall"
    for pad in (0, 3, 12, 60, 400):
        long = " ".join([*(f"before{i}" for i in range(pad)), short, *(f"after{i}" for i in range(pad))])
        row = spark.createDataFrame([(short, long)], "a string, b string").select(winnowing.winnow(winnowing.F.col("a")).alias("a"), winnowing.winnow(winnowing.F.col("b")).alias("b")).first()
        assert len({x >> 24 for x in row.a} & {x >> 24 for x in row.b}) >= 2


def test_packing_deals_rows_without_an_id_over_groups(spark):
    df = spark.createDataFrame([(None, "same words here")] * 300 + [(7, "same words here")] * 300, "doc_id long, text string")
    out = packing.pack(df, packing.vocabulary(), group_docs=100).toPandas()
    groups = out.groupby(out.sequence_id // (1 << 32)).size()
    assert len(out) == 600 and len(groups) == 6 and groups.max() < 200


def test_stages_choose_among_alike_rows_by_their_content(spark):
    rows = [(1, "one two three four five six", lang, source, 1) for lang, source in (("en", "a"), ("de", "b"), (None, "c"))]
    stage = dict(corpus_pipeline.STAGES)["n-gram jaccard join"]
    got = [stage(spark, spark.createDataFrame(part, DOC.replace("text string, lang string", "text string, lang string")), SF).collect() for part in (rows, rows[::-1], rows[1:] + rows[:1])]
    assert len(got[0]) == 1 and got[0] == got[1] == got[2]
    many = [(1, "one two three", "en", s, 1) for s in "aab" for _ in range(5)] + [(2, "four", "de", "b", 1)]
    mixed = [sorted(map(tuple, mixing.mix(spark.createDataFrame(part, DOC)).collect())) for part in (many, many[::-1])]
    assert mixed[0] == mixed[1]


def brute_winnow(text, k=winnowing.GRAM, w=winnowing.WINDOW, short=winnowing.SHORT, run=winnowing.RUN):
    """[(hash's upper 40 bits, position, is of characters)] of a text in order."""
    mask = (1 << 64) - 1
    rot = lambda x, n: ((x << n | x >> (64 - n)) & mask) if n % 64 else x

    def chosen(items, mark):
        hs = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in items]
        if not hs:
            return []
        if len(hs) < k:
            h = 42
            for x in hs:
                h = xxhash.xxh64(x.to_bytes(8, "little"), seed=h).intdigest()
            found = [h]
        else:
            found = []
            for i in range(len(hs) - k + 1):
                h = 0
                for x in hs[i : i + k]:
                    h = rot(h, 1) ^ x
                found.append(h)
        upper = [h >> 24 for h in found]
        signed = [h - (1 << 40) if h >> 39 else h for h in upper]
        out = []
        for i in range(max(1, len(found) - w + 1)):
            j = min(range(i, min(i + w, len(found))), key=lambda j: (signed[j], -j))
            if (x := (upper[j], j, mark)) not in out[-w:]:
                out.append(x)
        return out

    words = [x for x in re.split("[ \t\n\x0b\x0c\r]+", text) if x]
    words = [c for x in words for c in (x if len(x) > winnowing.LONG or re.search(winnowing.BLANKLESS.replace("\\x{20000}-\\x{3FFFF}", "\U00020000-\U0003ffff").replace("\\x{", "\\u").replace("}", ""), x) else [x])]
    runs = [text[i : i + run] for i in range(max(1, len(text) - run + 1))] if words else []
    return (chosen(runs, True) if len(text) <= short else []) + chosen(words, False)


def test_winnowing_matches_brute_force(spark, docs):
    extra = ["", " \n ", "one", "a b", "x y z " * 20, "x " * 40, "漢字 and words " * 9, "y" * 70 + " tail of it", "é ü " * 30, "w" * 97, "v" * 96 + " ", "t " * 96, "s " * 97]
    texts = [*docs.text[:80], *extra]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = winnowing.fingerprint_pairs(rows).select("doc_id", winnowing.as_text(winnowing.F.col("prints")).alias("f"), winnowing.as_text(winnowing.F.col("edited_prints")).alias("e"), winnowing.likeness(winnowing.F.col("prints"), winnowing.F.col("edited_prints")).alias("near_edited"), winnowing.likeness(winnowing.F.col("prints"), winnowing.F.col("next_prints")).alias("near_next")).collect()
    shown = lambda f: " ".join(f"{h:X}:{'c' if c else ''}{p}" for h, p, c in f)

    def like(a, b):
        a, b = {h for h, _, _ in a}, {h for h, _, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for r in out:
        t, n = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        half = len(t) // 2
        mine, edited, after = brute_winnow(t), brute_winnow(t[: len(t) - half] + n[:half]), brute_winnow(n)
        assert r.f == shown(mine) and r.e == shown(edited), r.doc_id
        assert (r.near_edited, r.near_next) == (pytest.approx(like(mine, edited)), pytest.approx(like(mine, after)))
    for k, w in ((1, 4), (3, 5), (5, 1), (7, 6)):
        got = rows.select("doc_id", winnowing.as_text(winnowing.winnow(winnowing.F.col("text"), k, w)).alias("f")).collect()
        assert all(r.f == shown(brute_winnow(texts[r.doc_id], k, w)) for r in got)


def test_winnowing(spark, docs):
    out = winnowing.op7_winnowing(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = list(docs.text)
    for i, r in enumerate(out.itertuples()):
        t, n = texts[i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
    same = out.merge(docs[["doc_id", "text"]]).groupby("text").fingerprint.nunique()
    assert (same == 1).all() and out.near_edited.mean() > 10 * out.near_next.mean()


def test_winnowing_of_short_and_blankless_texts(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    texts = [" ".join(word() for _ in range(n)) for n in range(10, 32)]
    texts += ["".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(n)) for n in (12, 20, 40)]
    texts += ["".join(word() for _ in range(n)) for n in (30, 60)] + [texts[0]]
    out = winnowing.fingerprint_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = out.select("doc_id", winnowing.F.size("prints").alias("n"), winnowing.likeness(winnowing.F.col("prints"), winnowing.F.col("edited_prints")).alias("near")).collect()
    assert len(got) == len(texts) and all(r.n > 2 and r.near > 0 for r in got)


def test_winnowing_chooses_rightmost_minimum(spark):
    text = "a b c d e " * 24
    row = spark.createDataFrame([(text,)], "text string").select(winnowing.as_text(winnowing.winnow(winnowing.F.col("text"), 1, 7)).alias("f")).first().f
    hashes = [x.split(":") for x in row.split()]
    # Five words repeat, so each window of seven holds its minimum again at its rightmost place.
    assert len({h for h, _ in hashes}) == 1 and [int(p) % 5 for _, p in hashes] == [int(hashes[0][1]) % 5] * len(hashes)


def test_successors_of_sparse_ids(spark):
    ids = sorted({random.Random(i).randrange(-(1 << 62), 1 << 62) for i in range(300)}) + [(1 << 62) + i for i in range(3)]
    got = winnowing.with_next(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string"), ["text"]).collect()
    assert {r.doc_id: r.next_text for r in got} == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1])}


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    out = packing.op8_packing(spark, SF).toPandas()
    whole = Tokenizer.from_file(packing.vocabulary()).encode_batch(list(docs.text), add_special_tokens=False)
    ids = {d: [*e.ids, 2] for d, e in zip(docs.doc_id, whole)}
    for r in out.itertuples():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens
    assert out.groupby("doc_id").length.sum().to_dict() == {d: len(i) for d, i in ids.items()}
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert out.length.sum() / (4096 * out.sequence_id.nunique()) > 0.95


def test_encoder_on_odd_words():
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    full = Tokenizer.from_file(path)
    texts = ["It's WE'LL don't.. ΣΑΣ σας İstanbul ÅNGSTRÖM été a1b2 ##!! x.,y  nb sp 漢字 \U0001f600\U0001f600 ''s '' Ünder...", "", "plain words only here"]
    assert packing.WordEncoder(path).encode(texts) == [np.array(full.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_first_fit_decreasing():
    rng = random.Random(9)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    bins, room, want = packing.FirstFit(300, 100), [], []
    for n in sizes:
        for i, r in enumerate(room):
            if r >= n:
                break
        else:
            i = len(room)
            room.append(100)
        want.append((i, 100 - room[i]))
        room[i] -= n
    assert [bins.add(n) for n in sizes] == want


def test_langid_on_held_out_rows(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op9_langid(spark, "/root/testdata/sf0.01").toPandas().merge(docs[["doc_id", "lang"]])
    assert (out[out.held_out].lang_pred == out[out.held_out].lang).mean() > 0.97


def test_langid_learns_every_language(spark):
    """1,500 languages of a word of their own and one of all: none is dropped, tables hold what was counted."""
    name = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(3))
    train = [(i, f"{name(i)}x{name(i)[::-1]}q common".replace("0", "a"), f"l{i:04}") for i in range(1500)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert len(model.langs) == 1500 and len(model.words.logs) == 3000
    assert sum(t.logs.nbytes + t.langs.nbytes + t.rest.nbytes for t in [model.words, *model.grams.values()]) < 2_000_000
    assert all(t.full is None or t.full.nbytes <= langid.FULL for t in [model.words, *model.grams.values()])
    for table_ in [model.words, *model.grams.values()]:  # written out or not, rows and means are the same
        places, full = list(range(0, len(table_), 97))[:5], table_.full
        table_.full = None
        sparse = [table_.scores(p) for p in places], table_.mean(places)
        table_.full = np.tile(table_.rest, (len(table_), 1))
        table_.full[np.repeat(np.arange(len(table_)), np.diff(table_.edges)), table_.langs] = table_.logs
        assert all((a == table_.scores(p)).all() for a, p in zip(sparse[0], places)) and np.allclose(sparse[1], table_.mean(places), atol=1e-6)
        table_.full = full
    got = langid.predict(spark.createDataFrame(train[:40], "doc_id long, text string, lang string"), model, ["lang"]).collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_langid_knows_letters_from_numerals():
    assert langid.words_of("² ½ ³ 12 ٣ Ⅷ _") == [] and langid.words_of("A²b Été½ x_y 3d") == ["a", "b", "été", "x", "y", "d"]


def test_langid_scores_match_brute_force(spark):
    train = [(1, "the cat the hat", "en"), (2, "der hut die katze", "de"), (3, "hats² und", "de")]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    counts = {lang: collections.Counter(w for _, t, x in train if x == lang for w in re.findall("[a-z]+", t)) for lang in ("de", "en")}

    def table_(of):
        every = {g for c in of.values() for g in c}
        return {g: [math.log((of[x][g] + 0.5) / sum(of[x][h] + 0.5 for h in every)) for x in ("de", "en")] for g in every}

    words = table_(counts)
    grams = {n: table_({x: collections.Counter({g: k for g, k in sum((collections.Counter({f"^{w}$"[i : i + n]: c}) for w, c in counts[x].items() for i in range(len(w) + 3 - n)), collections.Counter()).items()}) for x in counts}) for n in langid.ORDERS}
    for word in ("the", "hut", "cats", "unders", "qqq", "ö"):
        want = words.get(word)
        if want is None:
            for n in langid.ORDERS:
                found = [grams[n][g] for i in range(len(word) + 3 - n) if (g := f"^{word}$"[i : i + n]) in grams[n]]
                if found:
                    want = np.mean(found, axis=0)
                    break
        assert np.allclose(model.score_word(word), want if want is not None else [0, 0], atol=1e-5), word


def plain_features(text):
    """A text's features, byte by byte."""
    marks = ".,;:!?|#*%$&@/\\-_=+<>()[]{}\"'`~^"
    raw = list((text or "").encode())

    def kind(b):
        c = chr(b)
        if b < 128 and c.isalpha():
            return 0 if c.islower() else 1
        if b < 128 and c.isdigit():
            return 2
        if b < 128:
            return 3 if c in " \t\x0b\x0c\r" else 4 if c == "\n" else 7 + marks.index(c) if c in marks else 7 + len(marks)
        return 5 if b >= 192 else 6

    if not raw:
        return [0.0] * quality.FEATURES
    kinds = 8 + len(marks)
    ks = [kind(b) for b in raw]
    one, two = collections.Counter(ks), collections.Counter(zip(ks, ks[1:]))
    out = [math.sqrt(one[i] / len(ks)) for i in range(kinds)] + [math.sqrt(two[i, j] / max(1, len(ks) - 1)) for i in range(kinds) for j in range(kinds)]
    words, lines = bytes(raw).split(), [x for x in bytes(raw).split(b"\n") if x.strip()]
    w, sizes, after = len(words), [len(x) for x in words], list(zip(words, words[1:]))
    mean = sum(sizes) / w if w else 0
    return out + [
        math.log1p(len(raw)) / 10, math.log1p(w) / 10, mean / 10, math.sqrt(sum((x - mean) ** 2 for x in sizes) / w) / 10 if w else 0, len(set(words)) / w if w else 0,
        len(set(after)) / (w - 1) if w > 1 else 1, len(set(words)) / math.sqrt(w) / 10 if w else 0, len(set(lines)) / len(lines) if lines else 1,
        math.log1p(w / max(1, len(lines))) / 10, min(1.0, max(sizes) / 100) if w else 0, sum(a == b for a, b in after) / (w - 1) if w > 1 else 0, 1.0,
    ]


def test_quality_scores_match_brute_force(spark):
    """Scores anew from bytes and the fitted numbers; the fitted numbers have a lower risk than none and than the same dealt anew."""
    texts = [None, "", " \n ", "One sentence, plainly put.", "a a a a!!! $$$\n\nb", "Ünï çødé 漢字 \U0001f600\t7", "x" * 300, "line\nline\nother 12 (3) [4] {5} ~ ^"]
    train = [(i, (" ".join(["Good text, well written."] * (1 + i % 4)) if i % 3 else "bad bad !!! $$$ " * (1 + i % 5))) for i in range(240)]
    docs, marks = spark.createDataFrame(train, "doc_id long, text string"), spark.createDataFrame([(i, 1) for i in range(1, 200) if i % 3 == 1], "doc_id long, quality int")
    model = quality.fit(docs, marks)
    got = quality.predict(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), model, ["k"]).collect()
    for r in got:
        z = [max(-6, min(6, (x - m) / s)) for x, m, s in zip(plain_features(texts[r.k]), model.mean, model.scale)]
        want = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(z, model.weights)) + model.bias))))
        assert abs(r.score - want) < 1e-4 and r.predicted == int(r.score >= 0.5)
    rows = lambda keep: np.clip((np.array([plain_features(t) for i, t in train if keep(i)]) - model.mean) / model.scale, -6, 6)
    pos, unl = rows(lambda i: i < 200 and i % 3 == 1), rows(lambda i: True)
    prior = quality.estimated_prior(np.array([plain_features(t) for i, t in train if i < 200 and i % 3 == 1], dtype=np.float32), np.array([plain_features(t) for _, t in train], dtype=np.float32))

    def risk(w, b):
        loss = lambda x, y: np.log1p(np.exp(-y * np.clip(x @ w + b, -30, 30))).mean()
        return prior * loss(pos, 1) + max(0.0, loss(unl, -1) - prior * loss(pos, -1)) + 0.5 * quality.DECAY * (w @ w)

    rng = np.random.default_rng(1)
    assert 0.4 < prior < 0.95
    least = risk(model.weights, model.bias)
    assert least < risk(0 * model.weights, math.log(prior / (1 - prior))) and all(least < risk(rng.permutation(model.weights), model.bias) for _ in range(20))


def test_quality_scores_do_not_depend_on_labels_of_the_other_class(spark):
    docs = spark.createDataFrame([(i, ("Good text, well written. " if i % 2 else "bad bad !!! $$$ ") * (1 + i % 5)) for i in range(300)], "doc_id long, text string")
    marks = [(i, 1) for i in range(1, 120, 2)]
    score = lambda labels: {r.doc_id: r.score for r in quality.predict(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int")), ["doc_id"]).collect()}
    alone = score(marks)
    assert alone == score(marks + [(i, 0) for i in range(0, 40, 2)])
    assert all((s >= 0.5) == (d % 2 == 1) for d, s in alone.items())


def test_line_dedup_by_join_and_by_broadcast(spark, monkeypatch):
    rows = [(i, f"h{i % 3}", f"head {i % 3}\nbody {i}\nfoot") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    found = []
    for most in (50_000, 0):
        monkeypatch.setattr(linededup, "BROADCAST_LINES", most)
        found.append(sorted(map(tuple, linededup.drop_boilerplate(df, "host", "text").collect())))
    assert found[0] == found[1] and found[0][4] == (4, "h1", "body 4", 3, 2)


def test_line_dedup(spark):
    rows = [(i, "h", f"head\n\nbody {i}\n foot ") for i in range(10)] + [(10 + i, "g", f"head\nother {i}") for i in range(2)] + [(20 + i, "h", "copied page\nof two lines") for i in range(50)] + [(90, None, "x"), (91, "h", None)]
    out = linededup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, host string, text string"), "host", "text").toPandas().set_index("page_id")
    assert out.text[3] == "\nbody 3" and out._n_dropped[3] == 2 and out._n_lines[3] == 3
    assert out.text[10] == "head\nother 0" and out.text[25] == "copied page\nof two lines" and out.text[90] == "x" and out.text[91] is None


def test_oracles_on_small_tables(spark):
    for name in sorted(set(registry.ORACLES) - APART):
        sql = registry.ORACLES[name]
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
        want = con.sql(sql).df()
        got = registry.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()[list(want.columns)]
        key = list(want.columns)
        assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(str).values.tolist()


def test_pipeline(spark, edges):
    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        assert docs.columns == columns, name
    rejected = {r[0] for r in quality.predict(table(spark, SF, "documents").select("doc_id", "text"), quality.fit(table(spark, SF, "documents").filter(~langid.held_out(quality.F.col("doc_id"), 3, 1)), table(spark, SF, "labels").filter(~langid.held_out(quality.F.col("doc_id"), 3, 1))), ["doc_id"]).filter("predicted = 0").collect()}
    assert sizes[0] == 200 - len(rejected) and sizes[1] == sizes[0] and sizes[2] < sizes[1]
    packed = corpus_pipeline.packing_stage(spark, docs, SF)
    assert packed.filter("start = 0").count() == sizes[3]
    for folder in edges.values():
        corpus_pipeline.run(spark, folder).count()


CLASHING = "_k _d _o _z _m _n _s _t _b _g _h _x0 c0 c1 copies rate size score shard predicted held_out component_id component class_id n_shingles id n _host _lines _n_lines _n_dropped _all _rows _copy _again _c _u _end host key mark sequence_id".split()


def test_stages_keep_columns_of_any_name(spark, edges):
    """Columns that bear the operators' own names pass through, and change no row."""
    docs = spark.createDataFrame(edge_rows(), DOC)
    more = docs.select("*", *[corpus_pipeline.F.xxhash64("doc_id", "text", corpus_pipeline.F.lit(c)).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES:
        want, got = stage(spark, docs, edges["edge"]), stage(spark, more, edges["edge"])
        if name == "packing":
            assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))
            continue
        assert got.columns == more.columns, name
        slim = lambda x: sorted(str(tuple(r)) for r in x.select("doc_id", "text", "source").collect())
        assert slim(want) == slim(got), name
        if name != "line dedup":
            whole = lambda x: {tuple(r) for r in x.select("doc_id", "text", *CLASHING).collect()}
            assert whole(got) <= whole(more), name


def test_stages_on_edge_rows(spark, edges):
    """What each stage does with nulls, blanks, repeats and long texts."""
    docs = spark.createDataFrame(edge_rows(), DOC)
    run = dict(corpus_pipeline.STAGES)
    lines = {(r.doc_id, r.text) for r in run["line dedup"](spark, docs, "").collect()}
    assert {t for d, t in lines if d in (4, 5)} == {"", None} and (8, "one") in lines and len([1 for d, _ in lines if d == 7]) == 1
    near = sorted(str(r.doc_id) for r in run["n-gram jaccard join"](spark, docs, "").collect())
    assert near == sorted(map(str, [1, 4, 5, 6, 7, 8, 9, 10]))  # the row without a doc_id is a copy of 1
    mixed = collections.Counter(r.doc_id for r in run["mixing sources"](spark, docs, "").collect())
    # Texts without words take none, at the rate of no length: once, or the cap where their source is taken whole.
    assert all(mixed[d] in (1, 3) for d in (4, 5, 7))
    packed = run["packing"](spark, docs, "").toPandas()
    assert packed[packed.start == 0].shape[0] == len(docs.collect()) and packed[packed.doc_id == 4].length.tolist() == [1]


def test_text_hashes_are_those_of_words():
    from lodestone.llm import wordhash

    rng = random.Random(4)
    texts = ["", "  ", None, "one", "\tA b\x0bc\x1cd e 中文 ", *(" ".join(rng.choice("abcxyz") * rng.randint(1, 9) for _ in range(rng.randint(0, 80))) for _ in range(40)), "y" * 300 + " z"]
    words = [wordhash.words_of(t) for t in texts]
    seen: dict[bytes, int] = {}
    for lots in (len(texts), 7, 1):
        for i in range(0, len(texts), lots):
            hashes, sizes = wordhash.text_hashes(texts[i : i + lots])
            assert sizes.tolist() == [len(w) for w in words[i : i + lots]]
            for w, h in zip((w for ws in words[i : i + lots] for w in ws), hashes.tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_gram_hashes():
    from lodestone.llm import wordhash

    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 3, 4, 5, 6, 7, 20):
        h = wordhash.grams(x, k)
        assert len(h) == 400 - k + 1
        seen = {}
        for i, v in enumerate(h.tolist()):
            assert seen.setdefault(tuple(x[i : i + k].tolist()), v) == v
        assert len(set(seen.values())) == len(seen)
    assert len(wordhash.grams(x[:3], 5)) == 0


def test_packing_does_not_depend_on_the_words_remembered(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{j % 97}x{i % 13}, Aa{j}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    rows = [sorted(map(tuple, packing.pack(docs, packing.vocabulary(), remembered=n).collect())) for n in (20, packing.CACHE_WORDS)]
    assert rows[0] == rows[1] and len(rows[0]) == 40
    encoder = packing.WordEncoder(packing.vocabulary(), 1000)
    for i in range(30):
        encoder.encode([" ".join(f"abc{i}x{j}" for j in range(100))])
        assert len(encoder.known) + len(encoder.before) <= 1600


def test_rounds_without_pairs_or_links_plan_no_components(spark, monkeypatch):
    called = []
    monkeypatch.setattr(ngramjoin, "components", lambda edges: called.append(1) or components.components(edges))
    apart = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(5)]
    got = lambda rows: {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100)).collect()}
    assert got(apart) == {i: i for i in range(5)} and called == []
    linked = [*apart, (9, f"{apart[2][1]} end"), (10, f"{apart[2][1]} stop"), (11, apart[0][1])]
    assert got(linked) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 2, 10: 2, 11: 0} and len(called) == 1


def test_mixing_sends_its_numbers_without_python_workers(spark):
    cells = spark.createDataFrame([(0, 3, 2), (1, 4, 1)], "_s int, size long, n long")
    given = mixing._given(cells, _lam=[0.5, 1e9], _offset=[1, 2])
    assert given.filter("_s = 1").first().asDict() == {"_s": 1, "size": 4, "n": 1, "_lam": 1e9, "_offset": 2}
    assert "LocalTableScan [_s" in given._jdf.queryExecution().executedPlan().toString().replace("#", " ")


def test_workers_of_the_pipeline_load_no_pandas():
    code = "import sys; from lodestone.llm import linededup, mixing, ngramjoin, packing, quality; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2]).returncode == 0
