"""Resampling, Merkle manifest and chat formatting: SQL twins on given and on edge-case tables, brute force."""

import datetime
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import chat, merkle, registry, resample
from lodestone.session import ship

SF = "/root/testdata/sf0.01"
NEW = ["op11_resample", "op12_merkle", "op13_chat"]
DOC = "doc_id long, text string, lang string, source string, n_chars long"
TALK = "conv_id long, turn long, role string, text string"


def edge_documents():
    base, long = " ".join(f"B{i}" for i in range(40)), " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, base, "en", "a", None), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (2, "Other", "en", "a", 1), (3, "", None, "b", 0), (None, None, None, None, None), (None, base, "en", "b", 3), (None, base, "en", "b", 3)]
    rows += [(6, long, "de", "b", 4), (7, " \n\t ", "", "a", 5), (8, "one", "Z", "a", 6), (9, "x y z " * 50, "é", "c", 7), (10, "Ünï çødé 漢字 \U0001f600 ABC", "é", "c", 8)]
    return rows + [(100 + i, f"{base} {i} A" * (1 + i % 3), "en", "d", i) for i in range(60)]


def edge_talks():
    hard = "<s>[INST] a <\\/s> [\\\\/INST] \\ [ROLE]x</s>"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 1, "assistant", hard), (1, 1, "assistant", ""), (1, None, "[ROLE]s</s>", "x"), (2, 0, None, None), (None, 0, "user", "q"), (None, 0, "user", "q"), (None, 1, "assistant", "\U0001f600 漢")]
    return rows + [(3, i, "assistant" if i % 2 else "user", f" turn {i} ok </s>\n" * (1 + i % 4)) for i in range(500)] + [(4, 0, "assistant", "lang " * 40_000)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    ship(spark)
    out = {"given": SF}
    for name in ("edge", "empty"):
        folder, some = str(tmp_path_factory.mktemp(name)), name == "edge"
        spark.createDataFrame(edge_documents() if some else [], DOC).selectExpr("*", "doc_id AS score", "source AS leaf", "1 AS bucket", "text AS h1").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "b1 B2 c"), (2, None), (3, "漢字 one")] if some else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame(edge_talks() if some else [], TALK).selectExpr("*", "role AS loss", "1 AS spans").write.parquet(f"{folder}/conversations.parquet")
        out[name] = folder
    return out


def both(spark, name, folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        path = f"{folder}/{t}"
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got = registry.QUERIES[name](spark, folder)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall()
    return sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()), sorted(map(repr, want))


@pytest.mark.parametrize("name", NEW)
@pytest.mark.parametrize("at", ["given", "edge", "empty"])
def test_query_matches_its_twin(spark, tables, name, at):
    got, want = both(spark, name, tables[at])
    assert got == want
    assert len(got) == {"op11_resample": {"edge": 73, "empty": 0}, "op12_merkle": {"edge": 73, "empty": 0}, "op13_chat": {"edge": 8, "empty": 1}}[name].get(at, len(got))


# Resampling


def brute_features(text, sizes, buckets):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isascii() and (c.isdigit() or c.islower()) or ord(c) > 127 else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    return len(words), sorted(zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1))


def test_chunks_lose_and_repeat_no_feature(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "Cé", "x" * 90, "7", "--"]) for _ in range(rng.randint(0, 400))) for _ in range(40)] + [None, "", "y" * 500, "... !!"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for sizes, chunk in (((1, 1), 64), ((1, 3), 50), ((2, 4), 200), ((1, 2), 1 << 16)):
        found = resample.features(df, "k", "t", sizes, 997, chunk).toPandas()
        assert chunk > 1000 or len(found) > len(texts)
        for k, g in found.groupby("key"):
            n, ids = brute_features(texts[k], sizes, 997)
            assert g.words.sum() == n and g["first"].sum() == 1
            assert sorted(np.concatenate([np.frombuffer(b, "<u2") for b in g.buckets]).tolist()) == ids and g.n.sum() == len(ids)


def test_resampling_of_several_sizes_matches_brute_force(spark):
    rng = random.Random(4)
    raw = [(rng.randint(0, 30), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    aim = [(" ".join(rng.choice("abc") for _ in range(30)),) for _ in range(5)]
    got = resample.resample(spark.createDataFrame(raw, "k long, t string"), spark.createDataFrame(aim, "u string"), "k", "t", "u", (1, 3), 50, 30, 5, 7, 40).collect()
    s, t = np.zeros(50), np.zeros(50)
    for _, x in raw:
        np.add.at(s, brute_features(x, (1, 3), 50)[1], 1)
    for (x,) in aim:
        np.add.at(t, brute_features(x, (1, 3), 50)[1], 1)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s.sum() + 50) / ((s[i] + 1) * (t.sum() + 50)))) for i in range(50)]
    rows = []
    for k, x in raw:
        words, ids = brute_features(x, (1, 3), 50)
        weight = sum(gain[i] for i in ids) // len(ids) if ids else 0
        u = (int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        rows.append((k, len(ids), weight, weight + math.floor(-1000 * math.log(-math.log(u))), words))
    fit = sorted((r for r in rows if r[4] >= 5), key=lambda r: (-r[3], r[0], r[1], r[2]))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(fit[: len(fit) * 30 // 100])]
    rest = [(*r[:4], None) for r in fit[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < 5]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, drawn + rest))


# Merkle manifest


def sha(*parts_):
    return hashlib.sha256("".join(parts_).encode()).hexdigest()


def brute_tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def brute_manifest(rows, fanout):
    """rows (group, key, leaf, at_hand) with hex digests."""
    groups = {}
    for g, k, leaf, hand in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, leaf, hand))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g])], fanout) for g in order}
    forest = brute_tree([trees[g][-1][0] for g in order], fanout)
    out = []
    for j, g in enumerate(order):
        for i, (has, k, leaf, hand) in enumerate(sorted(groups[g])):
            siblings, node = [], hand
            for held, at in ((trees[g], i), (forest, j)):
                for level in held[:-1]:
                    start = at // fanout * fanout
                    left, right = level[start:at], level[at + 1 : start + fanout]
                    siblings, node, at = siblings + left + right, sha(*left, node, *right), at // fanout
            out.append((g, k if has else None, leaf, trees[g][-1][0], forest[-1][0], sha(*siblings), node, node == forest[-1][0]))
    return out


@pytest.mark.parametrize("fanout,depth,n", [(2, 1, 70), (3, 2, 200), (8, 1, 200), (8, 4, 90)])
def test_manifest_of_small_blocks_matches_brute_force(spark, fanout, depth, n):
    """Several levels of blocks, groups of one row, more groups than a block."""
    rng = random.Random(n)
    rows = []
    for _ in range(n):
        leaf = sha(str(rng.randint(0, n // 2)))
        rows.append((rng.choice([None, "", "en", "en", "en", *"abcdefghij"]), rng.choice([None, *range(n // 3)]), leaf, rng.choice([leaf, sha("other")])))
    df = spark.createDataFrame(rows, "g string, k long, leaf string, at_hand string").select("g", "k", F.unhex("leaf").alias("leaf"), F.unhex("at_hand").alias("at_hand"))
    got = merkle.manifest(df, "g", "k", merkle.Shape(fanout, depth)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_manifest(rows, fanout)))


def test_leaf_of_types(spark):
    row = spark.createDataFrame([(1, None, "é", datetime.date(2024, 1, 2))], "a long, b string, c string, d date").select(F.hex(merkle.leaf_of(*[F.col(c) for c in "abcd"])).alias("x")).first()
    assert row.x.lower() == sha("1:1", "-", "2:é", "10:2024-01-02")


# Chat formatting

BITS = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<", "[", "/", "s>", "INST]", "\\", "\\\\", "<\\s>", "[\\/INST]", " ok ", "\n", "é", "\U0001f600", "漢", "!!", ">", "]", "  "])
TEXT = st.lists(BITS, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=6))
def test_rendering_is_read_back(turns):
    turns = [chat.Turn(*t) for t in turns]
    text, spans = chat.render(turns)
    back = chat.read_back(text)
    assert back == spans and [chat.Turn(t.role, chat.unescape(text[t.start : t.end])) for t in back] == turns


def test_unbalanced_marks_are_refused():
    with pytest.raises(ValueError):
        chat.read_back("<s>a[/INST]")


def test_masks_cover_assistants_texts_and_nothing_else(spark):
    rng = random.Random(9)
    bits = ["<s>", "</s>", "[INST]", "\\", "!!", "é", "\U0001f600", "漢字", " word", "\n", ">", "<"]
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", "assistant", "tool"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))) for i in range(400)]
    for r in chat.format_chats(spark.createDataFrame(rows, TALK), chat.vocabulary()).collect():
        own = [t for t in chat.read_back(r.formatted) if t.role == "assistant"]
        wanted = {i for t in own for i in range(t.start, t.end)}
        covered = set()
        for (start, end), loss, span in zip(r.offsets, r.loss, r.spans):
            assert loss == bool(wanted & set(range(start, end)))
            assert (set(range(span.start, span.end)) if loss else set()) == wanted & set(range(start, end))
            covered |= set(range(span.start, span.end))
        assert covered == wanted
        assert chat.loss_text(r.formatted, r.loss, np.array(r.spans).reshape(-1, 2)) == "".join(x for _, _, role, x in sorted(q for q in rows if q[0] == r.conv_id) if role == "assistant")
