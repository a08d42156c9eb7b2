"""Operators whose results SQL does not give: goldens, twins in plain Python, properties, plans, files."""

import json
import math
import os
import random
import re
import uuid
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import ablation, audit, dedup, evaluation, generate, keyword, retrieval, sampling, tfidf, topics
from lodestone.operators.corpus import corpus, keyword_index, known_items, passages, vectors
from lodestone.plans import operations
from lodestone.sources import scans, scratch, sinks

SF = "/root/testdata/sf0.001"


def one(spark, column_of, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column_of(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 3 and "mrr" in df.columns


@pytest.mark.parametrize(
    "raw,want",
    [
        ("use `pip` and `git` here", "use pip and git here"),
        ("see\n```python\nx = **1**\n```", "see\n```python\nx = **1**\n```"),
        ("```sql\na\n``` mid ```sh\nb\n```", "```sql\na\n``` mid ```sh\nb\n```"),
        ("```bash ls```", "```bash ls\n```"),
        ("### Head\n**b** [l](u)\n```py\nc\n```", "Head\nb l\n```py\nc\n```"),
        ("```\nfirst\nsecond\n```", "```first\nsecond\n```"),
        ("```c++\nint x;\n```", "```c++\nint x;\n```"),
        ("* one\n* two", "one\n two"),
        ("a <placeholder> b <{IMAGE: x}> {{ v }} {% if %}", "a  b"),
        ("a\n\n\n\nb", "a\n\nb"),
    ],
)
def test_clean_markup(spark, raw, want):
    assert one(spark, T.clean_markup, raw) == want


def test_small_text_functions(spark):
    assert one(spark, T.normalize, "  ÉTÉ, Ça va?\n ok ") == "été ça va ok"
    assert one(spark, T.expand_urls, "see public.ecr.aws/lambda/x:3.8 now") == "see public ecr aws lambda x 3 8 now"
    assert one(spark, T.section_key, "module-3-extra") == "module-3" and one(spark, T.section_key, "misc") == "misc"
    assert one(spark, lambda c: T.word_match("r", c), "use r now") and not one(spark, lambda c: T.word_match("r", c), "rust")
    assert one(spark, T.strip_openings, "To fix this:\n run it") == "run it"
    assert one(spark, T.unaccented, "Éçà") == "Eca"
    assert one(spark, T.short_name, "a/b/c") == "c" and T.collection_name("faq", "qa") == "faq_qa"
    for name in ("x", "abc", "4f1fe161b1", "é"):
        assert one(spark, T.uuid5_dns, name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    same = "6BA7B810-9DAD-11D1-80B4-00C04FD430C8"
    assert one(spark, T.index_id, same) == same.lower()
    assert json.loads(one(spark, T.fenced_json, 'x\n```json\n{"a": 1}\n```')) == {"a": 1}
    assert one(spark, T.snippet, "aa bb\ncc", "bb") == "aa bb cc"


def test_metrics_fixture(spark):
    rows = [("a", ["e"] + ["x"] * 9), ("b", ["x", "e"]), ("c", ["x"] * 6 + ["e"]), ("d", ["x"])]
    df = spark.createDataFrame(rows, "q string, hits array<string>").withColumn("rank", M.rank_of(F.col("hits"), F.lit("e")))
    got = df.agg(*M.summary(F.col("rank"), F.lit(0.5), F.lit("c"), F.lit("d"))).first()
    assert round(got.mrr, 6) == 0.410714 and round(got.ndcg_10, 6) == 0.491066 and got.hit_rate_1 == 0.25 and got.hit_rate_5 == 0.5
    assert round(got.rank_std, 6) == 4.645787 and got.failure_count == 1 and got.map_score == got.mrr and got.cross_course_contamination == 1.0
    latency = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "v double")
    assert tuple(latency.agg(*[M.nearest_rank(p, "v") for p in (0.5, 0.95, 0.99)]).first()) == (20, 40, 40)
    assert latency.filter("v > 99").agg(M.nearest_rank(0.5, "v")).first()[0] == 0.0


def test_fusion_fixtures(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "query_id long, rank int, doc_id string, score double")
    v, b = ranked([(1, 1, "x", 0.9), (1, 2, "y", 0.5)]), ranked([(1, 1, "y", 12.0), (1, 2, "z", 4.0)])
    got = {r.doc_id: round(r.score, 6) for r in retrieval.rrf(v, b, 10).collect()}
    assert got == {"y": 0.032522, "x": 0.016393, "z": 0.016129}
    got = {r.doc_id: r.score for r in retrieval.minmax_fusion(v, b, 10).collect()}
    assert got == {"x": 0.7, "y": 0.3, "z": 0.0}
    single = retrieval.minmax_fusion(ranked([(1, 1, "x", 0.9)]), b.limit(0), 10).collect()
    assert [(r.doc_id, r.score) for r in single] == [("x", 0.0)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(1, 12)), min_size=1, max_size=30))
def test_metric_bounds(spark, ranks):
    df = spark.createDataFrame([(r,) for r in ranks], "rank int")
    got = df.agg(*M.summary(F.col("rank"), F.lit(0.0), F.lit(""), F.lit(""))).first()
    rates = [got.hit_rate_1, got.hit_rate_3, got.hit_rate_5, got.hit_rate_10]
    assert rates == sorted(rates) and all(0 <= x <= 1 for x in rates) and got.mrr == got.map_score
    assert got.ndcg_1 == got.hit_rate_1 and got.ndcg_5 <= got.ndcg_10 and got.hit_rate_1 <= got.mrr + 1e-12


def test_similarity_is_asymmetric():
    assert dedup.similarity("tide", "diet") == 0.25 and dedup.similarity("diet", "tide") == 0.5
    assert dedup.similarity("ab" * 150, "ba" * 150) == 0.0


def plain_greedy(rows, threshold):
    gone, out = set(), []
    for i in range(len(rows)):
        if rows[i][0] in gone:
            continue
        for j in range(i + 1, len(rows)):
            if rows[j][0] in gone:
                continue
            ratio = SequenceMatcher(None, rows[i][1], rows[j][1]).ratio()
            if ratio >= threshold:
                keep, drop = sorted((rows[i][0], rows[j][0]))
                gone.add(drop)
                out.append((keep, drop, round(ratio, 4)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefgh ", max_size=60), st.lists(st.tuples(st.integers(0, 60), st.text("abcxyz", max_size=3)), max_size=4), st.sampled_from([0.5, 0.8, 0.95]), st.sampled_from([1, 8]))
def test_comparison_bounds_change_nothing(text, edits, threshold, times):
    """Edited copies, short ones and such as are long enough for frequent characters to be ignored."""
    left = right = text * times
    for at, put in edits:
        right = right[:at] + put + right[at + 1 :]
    ratio = SequenceMatcher(None, left, right).ratio()
    want = [(1, 2, ratio)] if ratio >= threshold and left + right else []
    got = dedup._tile(pd.DataFrame({"id": [1, 2], "text": [left, right], "side": [0, 0]}), threshold)
    assert list(got.itertuples(index=False, name=None)) == want


def test_greedy_in_tiles_matches_plain_greedy(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE_DOCS", 3)
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(60)).strip() for _ in range(4)]
    rows = []
    for i in range(90):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = rng.choice("abcxyz")
        rows.append((i, "".join(text[: rng.randint(50, 60)]), rng.choice("pq")))
    heads = spark.createDataFrame(rows, "id long, text string, block string")
    for threshold in (0.8, 0.9):
        got = dedup.greedy(dedup.similar_pairs(heads, threshold)).collect()
        want = [x for block in "pq" for x in plain_greedy([(i, t) for i, t, b in rows if b == block], threshold)]
        assert len(want) > 20 and sorted(map(tuple, got)) == sorted(want)


def test_near_duplicates_scoped_and_global(spark):
    rows = [(1, "How?", "attempt 2 of the very long answer text", "a", "s"), (2, "how", "attempt#2 of the very long answer text", "b", "s"), (3, "how", "something else", "b", "s"), (4, "How", "something else!", "b", "s")]
    docs = spark.createDataFrame(rows, "id long, question string, answer string, course string, section string")
    assert {(r.kept_id, r.removed_id) for r in dedup.near_duplicates(docs).collect()} == {(3, 4)}
    both = dedup.near_duplicates(docs, course_aware=False)
    assert {(r.kept_id, r.removed_id) for r in both.collect()} == {(1, 2), (3, 4)}
    kept = dedup.keep(docs, both)
    assert dedup.near_duplicates(kept, course_aware=False).count() == 0 and kept.count() == 2


def test_chi_square_tail():
    assert sampling.chi_square_p(0.05, 3) == pytest.approx(0.9971, abs=1e-4)
    assert sampling.chi_square_p(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert sampling.chi_square_p(0, 3) == 1.0 and sampling.chi_square_p(40.0, 5) < 1e-6


def test_allocation_gives_the_rest_once(spark):
    docs = spark.createDataFrame([(i, g) for g, n in (("a", 50), ("b", 30), ("c", 2)) for i in range(n)], "id long, g string")
    got = {r.stratum: r.allocated for r in sampling.allocate(docs, ["g"], 10, 1, 5).collect()}
    assert got == {"a": 5, "b": 4, "c": 1}
    sample = sampling.stratified_sample(docs.withColumn("id", F.monotonically_increasing_id()), ["g"], 10)
    assert sample.count() == 10


def test_boundary_pairs(spark):
    docs = spark.createDataFrame([(1, "g", "aa bb"), (2, "g", "cc dd"), (3, "h", "bb cc")], "id long, c string, t string")
    got = {(r.c, r.term) for r in tfidf.counts(docs, "c", "t", across=True).collect()}
    assert ("g", "bb cc") in got and ("h", "bb cc") in got
    assert ("g", "bb cc") not in {(r.c, r.term) for r in tfidf.counts(docs, "c", "t").collect()}



@pytest.mark.parametrize("stop", [[], ["aa", "w1"]])
def test_terms_are_counted_within_tasks(spark, monkeypatch, stop):
    """Counts against a plain loop; no word is a row of a shuffle, and a task's counts are cut into several parts."""
    monkeypatch.setattr(tfidf, "COUNTED_WORDS", 40)
    monkeypatch.setattr(tfidf, "BUCKET_CHARS", 500)
    rng = random.Random(3)
    text = lambda: rng.choice(["", "É ", "x "]) + " ".join(rng.choice(["aa", "Bb", "c", "w1", "w_2", "ÉÉ", "é" * 300]) for _ in range(rng.randint(0, 30)))
    rows = [(i, rng.choice(["g", "h", None]), rng.choice([text(), text(), None])) for i in range(120)]
    want, groups = {}, {}
    for _, g, t in rows:
        ws = [w for w in re.findall("[a-z0-9_]{2,}", (t or "").lower()) if w not in stop]
        whole = groups.setdefault(g, [])
        pairs = [f"{a} {b}" for a, b in zip(([whole[-1]] if whole and ws else []) + ws, (ws if whole and ws else ws[1:]))]
        whole.extend(ws)
        for term in ws + pairs:
            want[g, term] = want.get((g, term), 0) + 1
    found = tfidf.counts(spark.createDataFrame(rows, "id long, c string, t string").repartition(2), "c", "t", stop, True)
    assert {(r.c, r.term): r.tf for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_entities_prefer_the_longest(spark):
    docs = spark.createDataFrame([(1, "Use VS Code with github codespaces code"), (2, "nothing")], "id long, t string")
    found = topics.entities(docs, "t", {"TOOL": ["vs code", "code", "github", "github codespaces"], "LANGUAGE": ["with"]})
    assert [(r.pos, r.term) for r in found.orderBy("pos").collect()] == [(1, "vs code"), (3, "with"), (4, "github codespaces"), (6, "code")]
    rows = {r.id: r for r in topics.tag(docs, found).collect()}
    assert rows[1].ner_primary_entity == "vs code" and rows[2].ner_entities == [] and rows[2].ner_primary_entity is None


def test_entities_of_many_words_and_with_marks(spark):
    rows = [(1, "It says CUDA out of memory, cuda again"), (2, "c or C++ with scikit-learn"), (3, "scikit learn, .NET and net"), (4, ""), (5, None), (6, "++")]
    docs = spark.createDataFrame(rows, "id long, t string")
    patterns = {"ERROR": ["cuda out of memory", "++"], "TOOL": ["cuda", "scikit-learn", ".net"], "LANGUAGE": ["c", "c++", "cuda"]}
    want = [(1, 2, "cuda out of memory", "ERROR"), (1, 6, "cuda", "TOOL"), (2, 0, "c", "LANGUAGE"), (2, 2, "c++", "LANGUAGE"), (2, 4, "scikit-learn", "TOOL"), (3, 2, ".net", "TOOL")]
    for small in (0, 10):
        assert sorted(tuple(r) for r in topics.entities(docs, "t", patterns, small).collect()) == want
    assert topics.entities(docs, "t", {}).count() == 0


def test_cluster_quality(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [3.0, 0.0], 0), (3, [0.0, 2.0], 1), (4, [5.0, 5.0], -1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, topic int")
    # Members of topic 0 are at cosine distance 0 from each other and 1 from topic 1, whose only member counts 0.
    got = topics.cluster_quality(df).first()
    assert (got.silhouette, got.topics) == (round(2 / 3, 6), 2) and got.davies_bouldin == round(1 / 8**0.5, 6)
    for part in (df.filter("topic = 0"), df.filter("topic = -1")):
        got = topics.cluster_quality(part).first()
        assert got.silhouette is None and got.davies_bouldin is None


def test_suggested_labels(spark):
    df = spark.createDataFrame([("timeouts", 5), ("zoomed", 4), ("wget", 4), ("bash", 3), ("plain", 9), ("rare", 1)], "term string, n long")
    assert {(r.term, r.label) for r in topics.suggest(df).collect()} == {("timeouts", "ERROR"), ("zoomed", "ADMIN"), ("wget", "TOOL"), ("bash", "LANGUAGE")}


def test_reclassify_order(spark):
    rows = [(1, 0, "TOOL", "q"), (2, 0, "TOOL", "q"), (3, 0, "TOOL", "q"), (4, 0, "TOOL", "q"), (5, 0, "OTHER", "plain"), (6, 0, "OTHER", "an error here"), (7, -1, "OTHER", "plain")]
    df = spark.createDataFrame(rows, "id long, topic int, category string, q string")
    got = {r.id: (r.new_category, r.source) for r in topics.reclassify(df, "q", {"ERROR": ["error"]}).collect()}
    assert got[1] == ("TOOL", "unchanged") and got[6] == ("ERROR", "rules") and got[7] == ("OTHER", "fallback")
    assert got[5] == ("OTHER", "fallback")  # 4 of 7 votes are fewer than four fifths
    got = {r.id: r.source for r in topics.reclassify(df.filter("id < 6"), "q", {"ERROR": ["error"]}).collect()}
    assert got[5] == "cluster"


def test_missing_measures_are_neutral(spark):
    rows = [("a", 0.1, None, 0.9, 1), ("b", 0.3, 0.2, 0.5, 1)]
    df = spark.createDataFrame(rows, "model string, outlier_ratio double, keyword_overlap double, confidence_mean double, cross_course_topics long")
    got = {r.model: r.composite for r in topics.composite(df).collect()}
    assert got["a"] == pytest.approx(0.35 + 0.125 + 0.25 + 0.15) and got["b"] == pytest.approx(0.25 + 0.15)
    assert {r.model for r in topics.pareto(df).collect()} == {"b"}


def test_context_stops_at_the_first_overflow(spark):
    docs = spark.createDataFrame([(1, "a" * 900), (2, "b " * 700), (3, "c" * 900), (4, "d" * 600), (5, "e")], "id long, answer string")
    ranked = spark.createDataFrame([(7, i, i, 1.0) for i in range(1, 6)] + [(8, 1, 99, 1.0)], "query_id long, rank int, doc_id long, score double")
    got = {r.query_id: r for r in generate.pack_context(ranked, docs).collect()}
    assert got[7].n_docs == 3 and got[7].context.split("\n\n---\n\n")[1].endswith("b...") and got[8].context == generate.NOTHING


def test_model_is_given_whole_contexts(spark):
    rows = operations.contexts(spark, SF).join(passages(spark, SF), "query_id").collect()
    want = {r.query_id: len(operations.TEMPLATE.replace("{question}", r.query_text).replace("{context}", r.context).split()) for r in rows}
    assert any(r.n_docs > 1 and len(r.context) > 400 for r in rows)
    assert {r.query_id: r.prompt_tokens for r in entry.queries()["llm_generate"](spark, SF).collect()} == want


def test_model_failures_are_rows(spark):
    def broken(prompts):
        raise RuntimeError("down")

    rows = spark.createDataFrame([(1, "a\n\nb c"), (2, "d")], "id long, prompt string")
    assert {r.error for r in generate.call_model(rows, "id", broken).collect()} == {"down"}
    assert {r.id: r.content for r in generate.call_model(rows, "id", generate.cascade(broken, generate.echo_client)).collect()} == {1: "b c", 2: "d"}
    assert generate.first_object('say {x} {"a": {"b": 1}} end') == {"a": {"b": 1}} and generate.first_object("none") is None
    assert generate.batches(rows, "id", 1).select("batch").distinct().count() == 2


def test_model_scorer(spark):
    def load():
        import numpy as np

        return lambda q, t: np.array([[0.0, len(b) - 3.0] for b in t])

    docs = spark.createDataFrame([(1, "a"), (2, "bbbbbb")], "id long, answer string")
    ranked = spark.createDataFrame([(9, 1, 1, 0.9), (9, 2, 2, 0.1)], "query_id long, rank int, doc_id long, score double")
    queries = spark.createDataFrame([(9, "q")], "query_id long, query_text string")
    got = retrieval.rerank(ranked, queries, docs, 2, retrieval.model_scorer(load)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1] and got[0].score == pytest.approx(1 / (1 + math.exp(-3)), abs=1e-6)


def test_upsert_and_gate(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert {tuple(r) for r in evaluation.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    m = spark.createDataFrame([("base", 0.9), ("x", 0.879), ("y", 0.885)], "config string, hit_rate_1 double")
    assert {r.config for r in evaluation.regression_gate(m, "base").filter("regressed").collect()} == {"x"}


def test_patches():
    assert ablation.Patch().label == "baseline" and not ablation.Patch().needs_rerun
    assert ablation.Patch(null_entity=True, skip_rules=True).label == "no_entity+skip_rules" and ablation.Patch(skip_ner=True).needs_rerun
    assert ablation.Patch(null_low_confidence=True, threshold=0.4).label == "low_conf_04"


def test_markdown_scan(spark, tmp_path):
    folder = tmp_path / "raw" / "course-a" / "general"
    folder.mkdir(parents=True)
    files = {
        "1": "---\nid: abc\nquestion: 'What\n  now?'\n---\nUse `x`.\n",
        "2": "no fence",
        "3": "---\nid: a",
        "4": "---\nid: [\n---\nx",
        "5": "---\nid: 1234567890\nquestion: q\n---\nx",
        "6": "---\nid: 31053272e0\nquestion: q\n---\nbody --- more",
        "7": "---\nid: k\nquestion: 5\n---\nx",
        "8": "---\nid: m\nquestion: q\n---\n  \n",
        "9": "---\nid: skipme\nquestion: q\n---\nx",
    }
    for name, text in files.items():
        (folder / f"{name}.md").write_text(text)
    good, bad = scans.parse_markdown(scans.walk(spark, str(tmp_path / "raw")), ["skipme"])
    assert {(r.id, r.question, r.answer, r.course, r.section) for r in good.collect()} == {("abc", "What now?", "Use x.", "course-a", "general"), ("31053272e0", "q", "body --- more", "course-a", "general")}
    reasons = {r.path.rsplit("/", 1)[-1][0]: r.reason for r in bad.collect()}
    assert set(reasons) == set("234578") and reasons["2"].startswith("No YAML") and reasons["5"].startswith("Missing or non-string id") and reasons["8"] == "Blank answer"


def test_json_scans(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "question": "q", "extra": 3}\n\nnot json\n{"id": "2"}\n')
    rows, bad = scans.jsonl(spark, str(tmp_path / "c.jsonl"))
    assert {r.id for r in rows.collect()} == {"1", "2"} and [r.line for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception):
        scans.jsonl(spark, str(tmp_path / "c.jsonl"), strict=True)[0].collect()
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"expected_id": "d1", "course": "c", "original_question": "o?", "prompt_results": {"chaos": ["x", "y"]}}]}))
    assert {r.id for r in scans.query_variants(spark, str(tmp_path / "q.json")).collect()} == {"d1_orig", "d1_chaos_0", "d1_chaos_1"}
    (tmp_path / "topic_a.json").write_text(json.dumps({"results": {"m": {"metadata": {"model": "m"}, "assignments": [{"id": "1", "topic": 3}, {"id": "1", "topic": 4}]}}}))
    (tmp_path / "topic_all.json").write_text("{}")
    (tmp_path / "topic_bad.json").write_text("oops")
    got = scans.assignments(spark, str(tmp_path / "topic_*.json")).collect()
    assert [(r.model, r.id, r.topic) for r in got] == [("m", "1", 4)]
    (tmp_path / "p.json").write_text('{"TOOL": ["a b", "c"]}')
    assert {tuple(r) for r in scans.patterns_json(spark, str(tmp_path / "p.json")).collect()} == {("TOOL", "a b"), ("TOOL", "c")}
    (tmp_path / "t.csv").write_text("term,score\n A ,1\nb,2\n")
    assert {r.term for r in scans.terms_csv(spark, str(tmp_path / "t.csv")).collect()} == {"a", "b"}
    assert scans.terms_csv(spark, str(tmp_path / "none.csv")).count() == 0
    assert len(scans.file_digest(spark, str(tmp_path / "t.csv")).first().digest) == 16
    assert scans.cached_vectors(spark, str(tmp_path / "no"), 3) is None


def test_sinks(spark, tmp_path):
    docs, meta = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string"), spark.createDataFrame([(1, 0), (2, 1)], "id long, topic int")
    assert sinks.write_index(docs, meta, str(tmp_path / "ix")) == 2
    with pytest.raises(ValueError):
        sinks.write_index(docs, meta.limit(1), str(tmp_path / "ix2"))
    for v in (1, 2):
        sinks.upsert_summaries(spark, spark.createDataFrame([("m", "c", v)], "model string, config string, v int"), str(tmp_path / "s"))
        sinks.replace_run(spark.createDataFrame([(v,)], "v int"), str(tmp_path / "r"), "one")
        sinks.replace_run(spark.createDataFrame([(9,)], "v int"), str(tmp_path / "r"), "two")
    assert [r.v for r in sinks.read_table(spark, str(tmp_path / "s")).collect()] == [2]
    assert {(r.v, r.run_id) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {(2, "one"), (9, "two")}
    assert [sinks.append_new(docs, str(tmp_path / "a"), "id") for _ in range(2)] == [2, 0]
    sinks.log_run(spark, str(tmp_path / "log"), "r1", {"mrr": 0.5}, {"k": "v"})
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_replaced_tables_survive_errors_and_crashes(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "model string, config string, v int"
    assert sinks.read_table(spark, path) is None
    rows = lambda: sorted(map(tuple, sinks.read_table(spark, path).collect()))
    sinks.upsert_summaries(spark, spark.createDataFrame([("m", "a", 1), ("m", "b", 1)], ddl), path)
    with pytest.raises(AnalysisException):
        sinks.upsert_summaries(spark, spark.createDataFrame([("m", "c")], "model string, config string"), path)
    assert rows() == [("m", "a", 1), ("m", "b", 1)]
    # A version that was being written when the driver was lost: no _SUCCESS, so the one before stays current.
    torn = tmp_path / "t" / "v=2"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"torn")
    assert rows() == [("m", "a", 1), ("m", "b", 1)]
    old = sinks.read_table(spark, path)
    for v in (2, 3):
        sinks.upsert_summaries(spark, spark.createDataFrame([("m", "b", v)], ddl), path)
        assert rows() == [("m", "a", 1), ("m", "b", v)]
        if v == 2:
            assert old.filter("v = 1").count() == 2  # a reader keeps its version
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v=3", "v=4"]
    with pytest.raises(AnalysisException):
        sinks.append_new(spark.createDataFrame([(1,)], "other long"), path, "id")


def test_stream_batches_count_once(spark, tmp_path):
    """The driver is lost after a batch is written and before the stream has noted it; later a batch is torn."""
    source, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    for i in range(3):
        spark.createDataFrame([(i, "x"), (i + 1, "y")], "id long, t string").coalesce(1).write.mode("append").parquet(str(source))
    sink, lost = sinks.batch_sink(out, "id"), []

    def crash(rows, batch):
        sink(rows, batch)
        if batch == 1 and not lost:
            lost.append(batch)
            raise RuntimeError("the driver is lost here")

    def run(write):
        stream = spark.readStream.schema("id long, t string").option("maxFilesPerTrigger", 1).parquet(str(source))
        return stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(write).start()

    with pytest.raises(Exception, match="lost"):
        run(crash).awaitTermination()
    run(crash).awaitTermination()
    assert lost == [1] and sorted(r.id for r in sinks.batches(spark, out).collect()) == [0, 1, 2, 3]
    os.remove(f"{out}/batch=2/_SUCCESS")
    assert sinks.batches(spark, out).count() < 4
    sink(spark.createDataFrame([(2, "x"), (3, "y")], "id long, t string"), 2)
    sink(spark.createDataFrame([(9, "never")], "id long, t string"), 2)
    assert sorted(r.id for r in sinks.batches(spark, out).collect()) == [0, 1, 2, 3]


def plain_bm25(docs, queries, k, boosts, must):
    """docs, queries: dicts. The formula, document by document."""
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    scores = {}
    for field, boost in boosts.items():
        words = {d["id"]: split(d[field]) for d in docs}
        mean = sum(map(len, words.values())) / len(docs)
        for q in queries:
            for d in docs:
                total = 0.0
                for t in split(q["query_text"]):
                    tf, df = words[d["id"]].count(t), sum(t in w for w in words.values())
                    total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[d["id"]]) / mean)) if tf else 0.0
                if total and all(q[m] is not None and q[m] == d[m] for m in must):
                    key = (q["query_id"], d["id"])
                    scores[key] = max(scores.get(key, 0.0), boost * total)
    out = []
    for q in {q["query_id"] for q in queries}:
        best = sorted((-round(s, 6), d) for (x, d), s in scores.items() if x == q)[:k]
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("boosts,must", [({"a": 1.0}, []), ({"a": 2.0, "b": 1.0}, []), ({"b": 1.0}, ["lang"])])
def test_keyword_index_matches_plain_scores_and_skips_blocks(spark, boosts, must):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(n))
    docs = [{"id": i, "a": rng.choice([None, "", text(rng.randint(1, 8))]), "b": text(rng.randint(0, 40)), "lang": rng.choice(["en", "de", None])} for i in range(300)]
    docs += [dict(docs[7], id=1000 + i) for i in range(12)]  # ties
    queries = [{"query_id": i, "query_text": rng.choice([None, "nothing here", text(1), text(3), text(12) + " ax ax"]), "lang": rng.choice(["en", "de", None])} for i in range(25)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "id long, a string, b string, lang string")
    asked = spark.createDataFrame([tuple(q.values()) for q in queries], "query_id long, query_text string, lang string")
    index = keyword.build_index(df, ["a", "b"], attributes=["lang"], size=4)
    found = keyword.search_index(keyword.open_index(spark, index.path), asked, 5, boosts, must, 2)
    got = sorted(map(tuple, found.ranked.collect()))
    want = plain_bm25(docs, queries, 5, boosts, must)
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))
    scored = found.first.unionByName(found.later)
    assert scored.count() == scored.distinct().count() < found.bounded.count()


@pytest.mark.parametrize("boosts,must", [({"a": 1.0}, []), ({"a": 2.0, "b": 1.0}, []), ({"b": 1.0}, ["lang"])])
def test_scan_gives_the_same_rows_and_shuffles_no_pairs(spark, boosts, must):
    """Shards meet blocks of queries in a task: k rows a query and shard leave it, not a row a (query, block)."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(n))
    docs = [{"id": i, "a": rng.choice([None, "", text(rng.randint(1, 8))]), "b": text(rng.randint(0, 40)), "lang": rng.choice(["en", "de", None])} for i in range(300)]
    docs += [dict(docs[7], id=1000 + i) for i in range(12)]  # ties
    queries = [{"query_id": i, "query_text": rng.choice([None, "nothing here", text(1), text(3), text(12) + " ax ax"]), "lang": rng.choice(["en", "de", None])} for i in range(25)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "id long, a string, b string, lang string")
    asked = spark.createDataFrame([tuple(q.values()) for q in queries], "query_id long, query_text string, lang string")
    index = keyword.build_index(df, ["a", "b"], attributes=["lang"], chars=3000)
    assert index.shards > 5
    got = sorted(map(tuple, keyword.scan_index(index, asked, 5, boosts, must, block=10).collect()))
    want = plain_bm25(docs, queries, 5, boosts, must)
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))
    assert index.lists.filter("field >= 0").groupBy("shard", "field", "term").count().filter("count > 1").count() == 0


def test_scan_reads_shards_and_queries_where_they_lie(spark):
    """Neither the index nor a copy of the queries a shard is shuffled; a part of the shards keeps k rows a query."""
    docs = spark.range(400).selectExpr("id", "concat('w', id % 7, ' w', id % 5) AS a", "'en' AS lang")
    index = keyword.build_index(docs, ["a"], attributes=["lang"], chars=60)
    assert index.shards > 30 and index.docs.count() == 400
    want = spark.createDataFrame([(0, [1], ["w1"])], "_q int, query_id array<long>, terms array<string>")
    met = keyword._met(index, want, [0], [0])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and met.count() == index.shards
    assert met.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism * want.rdd.getNumPartitions()


def test_similarity_and_notes_do_not_join_words(spark, monkeypatch):
    """No row a (term, pair of groups) or (document, word) is shuffled; both ways give the same rows."""
    rng = random.Random(4)
    rows = [(g, f"t{t}", rng.random()) for g in ["a", "b", "c", None, "d"] for t in rng.sample(range(300), 120)] + [("e", "alone", 1.0)]
    fitted = spark.createDataFrame(rows, "g string, term string, score double")
    docs = spark.createDataFrame([(i // 2, rng.choice([None, "", "T1 t2, t3 x t4", "t9 t2 t2", "none"])) for i in range(60)], "id long, answer string")
    terms = spark.createDataFrame([(f"t{i}",) for i in (1, 2, 3, 4, 2)] + [("t9 t2",)], "term string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(tfidf.similarity(fitted, "g")) and "Join" not in plan(topics.concept_notes(docs, terms))
    new = [sorted(map(tuple, df.collect())) for df in (tfidf.similarity(fitted, "g"), topics.concept_notes(docs, terms))]
    monkeypatch.setattr(tfidf, "GRAM_GROUPS", 0)
    monkeypatch.setattr(topics, "NOTE_TERMS", 0)
    old = [sorted(map(tuple, df.collect())) for df in (tfidf.similarity(fitted, "g"), topics.concept_notes(docs, terms))]
    assert new == old and len(new[0]) == 6 and len(new[1]) > 20


def test_tfidf_retrieve_shuffles_no_row_a_document_and_term(spark):
    rng = random.Random(9)
    texts = [rng.choice([None, "", " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 25)))]) for _ in range(120)] + ["w1 w2 w2"] * 3
    asked = ["w1 w2 w2", "w5 w5 w30 new", "new", "", None]
    docs, queries = spark.createDataFrame(list(enumerate(texts)), "id long, t string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    got = tfidf.retrieve(docs, queries, "t", 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    bags = [Counter((t or "").split()) for t in texts]
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in b for b in bags))) + 1 for b in bags for w in b}
    weigh = lambda bag: {w: (1 + math.log(n)) * idf[w] for w, n in bag.items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = []
    for q, v in ((q, weigh(Counter((t or "").split()))) for q, t in enumerate(asked)):
        found = [(-round(sum(v[w] * u[w] for w in v if w in u) / (norm(v) * norm(u)), 6), d) for d, u in enumerate(map(weigh, bags)) if set(u) & set(v)]
        want += [(q, i + 1, d, -x) for i, (x, d) in enumerate(sorted(found)[:5])]
    assert sorted(map(tuple, got.collect())) == want and len(want) == 10


def test_blocks_skipped_on_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    found = keyword.search_index(keyword_index(spark, sf), known_items(spark, sf), 10, {"answer": 1.0}, blocks=4)
    assert found.first.count() + found.later.count() < 0.7 * found.bounded.count()


def test_automaton_finds_what_the_join_finds(spark):
    rng = random.Random(8)
    bits = ["c", "C++", "c++", ".NET", "net", "k-means", "k means", "kmeans", "vs", "code", "vs code", "é", "x_1", ",", "!", "  "]
    docs = spark.createDataFrame([(i, rng.choice([None, "", " ".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))])) for i in range(200)], "id long, t string")
    patterns = topics.title_variants({"LANGUAGE": ["c", "C++", ".net", "é"], "TOOL": ["vs code", "code vs code", "k-means", "x_1"], "CONCEPT": ["k means", "net", "c"]})
    assert patterns["TOOL"] == ["vs code", "vscode", "code vs code", "codevscode", "k-means", "x_1"]
    both = [sorted(map(tuple, topics.entities(docs, "t", patterns, small).collect())) for small in (1000, 0)]
    assert both[0] == both[1] and len(both[0]) > 500
    assert "Generate" not in topics.entities(docs, "t", patterns)._jdf.queryExecution().toString()


def test_subtopic_keywords_are_those_of_the_classes(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 4} word{i % 4} other{i}") for i in range(40)], "id long, t string")
    placed = spark.createDataFrame([(i, i % 2, i % 4 // 2) for i in range(40)], "id long, topic int, subtopic int")
    got = topics.subtopic_keywords(docs, placed, "t", 1).collect()
    assert sorted((r.topic, r.subtopic, r.term) for r in got) == [(0, 0, "word0"), (0, 1, "word2"), (1, 0, "word1"), (1, 1, "word3")]


def test_quarantine(spark):
    docs = spark.createDataFrame([("1", "q", "a", "c"), ("2", " ", "a", None)], "id string, question string, answer string, course string")
    good, bad = audit.quarantine(docs, ["id", "question", "answer", "course"])
    assert good.count() == 1 and bad.first().reason == "question,course"


def test_block_product_equals_relational_join(spark):
    vecs, asked = vectors(spark, SF), known_items(spark, SF)
    fast = {tuple(r) for r in retrieval.knn(vecs, asked, 10).collect()}
    slow = {tuple(r) for r in retrieval.knn(vecs.withColumn("one", F.lit(1)), asked.withColumn("one", F.lit(1)), 10, must=["one"]).collect()}
    assert {x[:3] for x in fast} == {x[:3] for x in slow}



def test_filtered_neighbours_are_block_products(spark):
    """With equality filters, nulls and keys of one side included: the plain loop's rows, and no row a (query, vector)."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.choice([0, 1, None]), rng.choice(["a", None])) for i in range(150)] + [(900, [1.0, 0.0, 0.0, 0.0], 7, "a")]
    ask = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.choice([0, 1, 2, None]), rng.choice(["a", None])) for i in range(30)]
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)
    want = []
    for q, v, *keys in ask:
        found = sorted((-cosine(v, w), i) for i, w, *own in rows if own == keys)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    frames = spark.createDataFrame(rows, "id long, v array<double>, topic int, lang string"), spark.createDataFrame(ask, "query_id long, v array<double>, topic int, lang string")
    got = retrieval.knn(*frames, 5, must=["topic", "lang"])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().executedPlan().toString()


def test_plans_push_down_and_limit_early(spark):
    filtered = retrieval.knn(vectors(spark, SF), known_items(spark, SF), 10, must=["topic"])
    assert "WindowGroupLimit" in filtered._jdf.queryExecution().executedPlan().toString()
    lean = corpus(spark, SF).filter("section = 'src1'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in lean and "ReadSchema: struct<doc_id:bigint,source:string>" in lean


def test_searches_leave_their_ranked_rows_alone_in_scratch(spark, tmp_path, monkeypatch):
    vecs, asked, index = vectors(spark, SF), known_items(spark, SF), keyword_index(spark, SF)
    for module in (scratch, keyword):
        monkeypatch.setattr(module, "folder", lambda _: str(tmp_path))
    answer = {"question": 0.0, "answer": 1.0}
    for search in (lambda: retrieval.search("hybrid_rrf", corpus(spark, SF), vecs, asked, index=index), lambda: retrieval.bm25(index, asked, 10, answer), lambda: retrieval.bm25(corpus(spark, SF), asked, 10, answer)):
        before = {p.name for p in tmp_path.iterdir()}
        rows = search()
        new = [p for p in tmp_path.iterdir() if p.name not in before]
        # Two lists of a fusion, one of a plain search: no blocks of vectors or queries, no index of its own.
        assert len(new) == (2 if not before else 1) and all({"rank", "doc_id"} <= set(spark.read.parquet(str(p)).columns) for p in new)
        assert rows.count() > 0


def test_longest_matches_are_those_of_difflib():
    """Texts of any alphabet, from 200 characters on, with edits and moved pieces: the ratio of difflib, or none below the threshold."""
    rng = random.Random(11)
    found = 0
    for _ in range(400):
        letters = rng.choice(["abcdefghijklmnopqrstuvwxyz 0123456789", "ab ", "abcdefgh" + "".join(map(chr, range(0x4E00, 0x4E00 + rng.choice([5, 400]))))])
        text = rng.choices(letters, [rng.choice([1, 1, 20, 60]) for _ in letters], k=rng.choice([200, 201, 260, 700]))
        other = list(text)
        for _ in range(rng.choice([0, 1, 3, 10, 40])):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 2)] = rng.choices(letters, k=rng.randint(0, 2)) if rng.random() < 0.8 else text[at : at + 20]
        for a, b in (("".join(text), "".join(other)), ("".join(other), "".join(text))):
            ratio = SequenceMatcher(None, a, b).ratio()
            for threshold in (0.5, 0.95, ratio or 0.1):
                want = ratio if ratio >= threshold else None
                assert dedup.ratio_from(a, b, threshold, dedup.Matches(b) if len(b) >= 200 else None) == want
                found += want is not None
    assert found > 500


def test_tiles_hold_many_texts_and_compare_few(monkeypatch):
    """Texts of one language that are not alike are told apart by marks of their runs: they never reach a comparison."""
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(4000)]
    texts = [" ".join(rng.choices(words[:60], k=60) + rng.choices(words, k=90)) for _ in range(150)]
    texts.append(texts[7] + " x")
    compared, own = [], dedup.ratio_from
    monkeypatch.setattr(dedup, "ratio_from", lambda *a: compared.append(a) or own(*a))
    got = dedup._tile(pd.DataFrame({"id": range(151), "text": texts, "side": [0] * 151}), 0.95)
    assert got[["a", "b"]].values.tolist() == [[7, 150]] and len(compared) < 5
    assert dedup.TILE_DOCS >= 512  # a tile's texts are dealt to a task once for each other tile


def test_one_of_several_columns_is_block_products(spark, monkeypatch):
    """must and should as columns, nulls and repeated ids included: the plain loop's rows, and no row a pair."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 40)
    rng = random.Random(8)
    pick = lambda: (rng.choice(["a", None]), rng.choice([0, 1, None]), rng.choice(["s", "t", "u", None]))
    rows = [(i % 190, [rng.gauss(0, 1) for _ in range(4)], *pick()) for i in range(200)]
    ask = [(i, [rng.gauss(0, 1) for _ in range(4)], *pick()) for i in range(30)] + [(30, [0.0] * 4, "a", 0, "s"), (31, [1.0] * 4, "z", 0, "s")]
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) or 1.0), 6)
    frames = spark.createDataFrame(rows, "id long, v array<double>, lang string, topic int, section string"), spark.createDataFrame(ask, "query_id long, v array<double>, lang string, topic int, section string")
    for threshold in (None, 0.2):
        want = []
        for q, v, lang, *keys in ask:
            found = sorted((-cosine(v, w), i) for i, w, l, *own in rows if l == lang and any(x == y for x, y in zip(own, keys)))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate([x for x in found if threshold is None or -x[0] >= threshold][:7])]
        got = retrieval.knn(*frames, 7, threshold, must=["lang"], should=["topic", "section"])
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, retrieval.knn(*frames, 3, must=["lang"], should=[]).collect())) == sorted(map(tuple, retrieval.knn(*frames, 3, must=["lang"]).collect()))


@pytest.mark.parametrize("cells,common,stretches", [(1 << 22, 300, 8), (60, 10**9, 2), (60, 0, 8)])
def test_scan_adds_up_blocks_of_queries(spark, monkeypatch, cells, common, stretches):
    """Queries a few at a time, common terms as products or all as lists, many shards a part: the plain loop's rows."""
    for name, value in (("CELLS", cells), ("COMMON", common), ("STRETCHES", stretches)):
        monkeypatch.setattr(keyword, name, value)
    rng = random.Random(12)
    words = {lang: [rng.choice("abcdefghij") + rng.choice("klmnop") + lang for _ in range(40)] for lang in "uvw"}
    text = lambda lang, n: " ".join(rng.choices(words[lang], [40 // (i + 1) + 1 for i in range(40)], k=n))
    docs = [{"id": (i * 7919) % 1000, "a": text(lang, rng.randint(1, 6)), "b": text(lang, rng.randint(1, 12)), "lang": rng.choice([lang, None])} for i in range(160) for lang in [rng.choice("uuvw")]]
    docs += [dict(docs[5], id=2000 - i) for i in range(30)]  # more ties than rows are asked for
    queries = [{"query_id": 90 - i, "query_text": docs[i * 3]["b"] + " " + text(rng.choice("uvw"), 2), "lang": docs[i * 3]["lang"]} for i in range(24)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "id long, a string, b string, lang string")
    asked = spark.createDataFrame([tuple(q.values()) for q in queries], "query_id long, query_text string, lang string")
    index = keyword.build_index(df, ["a", "b"], attributes=["lang"], chars=1200)
    for boosts, must in (({"b": 1.0}, []), ({"a": 2.0, "b": 1.0}, ["lang"])):
        got = sorted(map(tuple, keyword.scan_index(index, asked, 4, boosts, must, block=10).collect()))
        want = plain_bm25(docs, queries, 4, boosts, must)
        assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))
