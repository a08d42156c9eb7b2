"""Model answers by content: asked once, checked, resumed after a crash."""

import json
import os
import re
import sys

import pytest
from pyspark import cloudpickle

from lodestone.operators import extraction as X
from lodestone.sources import sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests


def test_replies_are_checked():
    good = {"entities": [" Docker ", ""], "categories": ["TOOL", "BOGUS"], "primary_entity": None, "primary_category": "NOPE"}
    want = {"entities": ["docker"], "categories": ["TOOL", "OTHER"], "primary_entity": None, "primary_category": "OTHER"}
    assert X.parse_entities(json.dumps([good]), 2) == [want, None]
    assert X.parse_entities("```json\n" + json.dumps([good, good]) + "\n```", 1) == [want]
    for bad in (None, "", "no array", "[1, 2]", '{"a": 1}', "[broken", json.dumps([{"entities": "x"}]), json.dumps([dict(good, primary_entity=3)]), json.dumps([{k: v for k, v in good.items() if k != "primary_entity"}])):
        assert X.parse_entities(bad, 2) == [None, None]
    assert X.variants('["a", "b", " ", "a", "c", "d"]', "b") == ["a", "c", "d"] and X.variants("x\n\ny", "z") == ["x", "y"] and X.variants(None, "z") == []


class Counting:
    """A client that notes every question it is asked in a folder, as workers share no memory."""

    def __init__(self, folder, broken=()):
        self.folder, self.broken = str(folder), set(broken)

    def note(self, text):
        with open(f"{self.folder}/asked", "a") as f:
            f.write(text + "\n")

    def asked(self):
        path = f"{self.folder}/asked"
        out = open(path).read().split("\n")[:-1] if os.path.exists(path) else []
        if out:
            os.remove(path)
        return sorted(out)

    def __call__(self, prompts):
        out = []
        for p in prompts:
            questions = re.findall(r"^\d+\. (.*)$", p, re.M)
            for q in questions:
                self.note(q)
            out.append("nonsense" if set(questions) & self.broken else json.dumps([{"entities": q.split()[:1], "categories": ["TOOL"], "primary_entity": q.split()[0], "primary_category": "TOOL"} for q in questions]))
        return out


def test_entities_are_asked_once_a_text(spark, tmp_path):
    client, path = Counting(tmp_path, ["Bad one"]), str(tmp_path / "store")
    docs = spark.createDataFrame([(1, "Docker fails"), (2, "Docker fails"), (3, None), (4, "Python env"), (5, "Bad one")], "id long, q string").repartition(1)
    tagged = lambda df, c: {r.id: (r.entities, r.primary_category) for r in X.model_entities(df, "q", c, path, 1, 2).collect()}
    want = {1: (["docker"], "TOOL"), 2: (["docker"], "TOOL"), 3: ([], "OTHER"), 4: (["python"], "TOOL"), 5: ([], "OTHER")}
    assert tagged(docs, client) == want and client.asked() == ["Bad one", "Docker fails", "Python env"]
    assert sinks.batches(spark, f"{path}/quarantine").count() == 1
    client.broken = set()
    assert tagged(docs, client)[5] == (["bad"], "TOOL") and client.asked() == ["Bad one"]
    assert tagged(docs, client)[1] == want[1] and client.asked() == []


def test_a_crash_between_tiers_loses_no_answer(spark, tmp_path, monkeypatch):
    client, path = Counting(tmp_path), str(tmp_path / "store")
    docs = spark.createDataFrame([(i, f"w{i} text") for i in range(12)], "id long, q string").repartition(1)
    real, calls = X.append_batch, []

    def failing(rows, to):
        calls.append(to)
        if len(calls) == 5:  # the replies of the second tier are written, its answers not
            raise RuntimeError("lost")
        return real(rows, to)

    monkeypatch.setattr(X, "append_batch", failing)
    with pytest.raises(RuntimeError):
        X.model_entities(docs, "q", client, path, 3, 2)
    first = client.asked()
    monkeypatch.setattr(X, "append_batch", real)
    out = X.model_entities(docs, "q", client, path, 3, 2).collect()
    again = client.asked()
    assert len(first) == 12 and 0 < len(again) < 12 and sorted(r.entities[0] for r in out) == sorted(f"w{i}" for i in range(12))


def test_editing_one_text_encodes_one(spark, tmp_path):
    note, path = Counting(tmp_path), str(tmp_path / "v")

    def encode(texts):
        for t in texts:
            note.note(t)
        return [[float(len(t)), 1.0] for t in texts]

    run = lambda rows: {r.id: r.v for r in X.embedded(spark.createDataFrame(rows, "id long, t string"), "t", encode, path).collect()}
    rows = [(1, "aa"), (2, "bbb"), (3, "aa"), (4, None)]
    assert run(rows) == {1: [2.0, 1.0], 2: [3.0, 1.0], 3: [2.0, 1.0], 4: None} and note.asked() == ["aa", "bbb"]
    assert run([(1, "aa"), (2, "bbbb"), (3, "aa"), (4, None)])[2] == [4.0, 1.0] and note.asked() == ["bbbb"]
    assert run(rows)[2] == [3.0, 1.0] and note.asked() == []


def test_queries_are_synthesized_by_style(spark, tmp_path):
    docs = spark.createDataFrame([(1, "how to x"), (2, None)], "id long, q string")

    def client(prompts):
        return [json.dumps(["v1 of " + p.split("\n\n")[1], "how to x", "v2", "v3", "v4"]) if "novice" in p else "" for p in prompts]

    got = sorted(map(tuple, X.synthesized(docs, "id", "q", ["novice", "expert"], client, str(tmp_path)).collect()))
    assert got == [(1, "novice", 0, "v1 of how to x"), (1, "novice", 1, "v2"), (1, "novice", 2, "v3")]
