"""Near duplicates in large groups: links against all pairs, and how many pairs are compared."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import near, quality
from tidewatch.llm.learn import logistic


def shingles(text, size):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size):
    """Component (smallest index) of each row by all pairs."""
    sets = [shingles(t or "", size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(rows))]


def group(rng, n, words, changed, start=0, vocabulary=10_000):
    base = [f"t{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(words), changed):
            w[at] = f"x{rng.randrange(vocabulary)}"
        out.append((start + i, " ".join(w)))
    return out


@pytest.fixture
def seen(monkeypatch):
    """Numbers of pairs that are read and compared."""
    counts = []
    plain = near.confirmed

    def counted(pairs, rows, words):
        counts.append(pairs.count())
        return plain(pairs, rows, words)

    monkeypatch.setattr(near, "confirmed", counted)
    return counts


@pytest.mark.parametrize(("changed", "vocabulary"), [(3, 10_000), (2, 30), (5, 4)])
def test_a_group_of_near_copies_is_compared_in_proportion(spark, seen, changed, vocabulary):
    rng = random.Random(changed)
    rows = group(rng, 250, 30, changed, vocabulary=vocabulary)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()}
    assert [got[i] for i, _ in rows] == brute(rows, 2)
    assert sum(seen) < 40 * len(rows)


def test_rows_without_id_are_no_pairs(spark, seen):
    """100 near copies without id and one with: about as many comparisons as rows, not their square."""
    rng = random.Random(1)
    rows = [(5, " ".join(f"t{i}" for i in range(40)))] + [(None, t) for _, t in group(rng, 100, 40, 1)] + [(None, "something else entirely here now")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(frame, 2).collect()
    assert sum(seen) < 600 and len(got) == len(rows)
    kept = near.deduplicated(frame, 2).collect()
    want = brute(rows, 2)
    assert len(kept) == len(set(want)) and {r["doc_id"] for r in kept} == {5, None}


def test_repeated_ids_join_the_components_of_their_texts(spark):
    a, b, c = ("%s" % " ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(3, a), (9, a + " more"), (9, b), (7, b + " more"), (8, c), (None, c), (None, a), (2, "lone words")]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"], r["kept"]) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    # the two rows without an id count as one document, which joins c with a
    assert [g[1:] for g in got] == [(2, 2, True), (3, 3, True), (7, 3, False), (8, 3, False), (9, 3, False), (9, 3, False), (None, 3, False), (None, 3, False)]


def test_columns_of_any_name_and_kind_stay(spark):
    text = " ".join(f"w{i}" for i in range(20))
    names = "doc_id long, text string, _node string, node long, gone long, again long, row long, m map<string,int>"
    rows = [(1, text, "n", 1, 1, 1, 1, {"a": 1}), (1, text, "n", 1, 1, 1, 1, {"a": 1}), (2, text + " more", "n", 2, 2, 2, 2, None), (3, "other words", "k", 3, 3, 3, 3, {"b": 2})]
    got = near.deduplicated(spark.createDataFrame(rows, names), 5)
    assert got.columns == [c.split()[0] for c in names.replace("map<string,int>", "map").split(", ")]
    assert sorted((r["doc_id"], r["_node"], r["gone"]) for r in got.collect()) == [(1, "n", 1), (3, "k", 3)]


def test_prefixes_hold_a_shared_shingle_of_every_link(spark):
    rng = random.Random(4)
    rows = group(rng, 60, 25, 2) + group(rng, 60, 25, 1, start=100, vocabulary=3)
    texts = spark.createDataFrame(rows, "id long, text string")
    tokens: dict[int, set] = {}
    for r in near.prefixes(texts, 2).collect():
        tokens.setdefault(r["id"], set()).add(r["token"])
    for i, t in rows:
        n = len(shingles(t, 2))
        assert len(tokens[i]) == n - -(-8 * n // 10) + 1
    for i, t in rows:
        for j, u in rows:
            x, y = shingles(t, 2), shingles(u, 2)
            if i < j and 100 * len(x & y) >= 80 * len(x | y):
                assert tokens[i] & tokens[j]


def test_pair_weights_in_blocks_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    f = rng.integers(0, 2, (90, 7)).astype(np.float32)
    over, under = rng.integers(0, 90, (40, 5)), np.arange(40)
    d = (f[over] - f[under][:, None, :]).reshape(-1, 7).astype(float)
    whole = logistic(d, np.ones(len(d)), ridge=2e-3)
    for block in (1, 7, 256):
        np.testing.assert_allclose(quality.pair_weights(f, over, under, 2e-3, block=block), whole, atol=1e-9)


def test_pair_scores_against_a_plain_descent(spark):
    """The fitted order of texts agrees with plain gradient descent on the same pairs."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "words", "here"]) for _ in range(60)) + ".", 1) for i in range(40)]
    rows += [(100 + i, "###" * rng.randrange(1, 9) + " " + "7 " * rng.randrange(3, 30), 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels, ["doc_id"]).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert held and all(r["predicted"] == (r["doc_id"] < 100) for r in held)
    x = quality.measures(docs.orderBy("doc_id").select("text").toArrow()["text"])
    y = np.array([1] * 40 + [0] * 40)
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
    w = np.zeros(z.shape[1])
    for _ in range(300):
        d = z[y == 1][:, None, :] - z[y == 0][None, :, :]
        p = 1 / (1 + np.exp(-(d @ w)))
        w += 0.5 * ((1 - p)[..., None] * d).mean((0, 1))
    plain = z @ w
    scores = np.array([got[i]["score"] for i in sorted(got)])
    assert (plain[:40].min() > plain[40:].max()) == (scores[:40].min() > scores[40:].max())
    assert docs.filter(F.col("doc_id") < 0).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_a_filter_of_nodes_loses_none(spark, monkeypatch, bits):
    monkeypatch.setattr(near, "FILTER_BITS", bits)
    rows = spark.range(3000).select((F.col("id") * 7919 - 5_000_000).alias("id"), F.col("id").cast("string").alias("text"))
    ids = rows.filter("id % 50 = 0").select("id")
    wanted = {r["id"] for r in ids.collect()}
    passed = {r["id"] for r in near._asked(ids, rows).collect()}
    assert wanted <= passed and (bits == 64 or len(passed) < 3 * len(wanted) + 50)
    assert {r["id"] for r in near._texts_of(ids.union(ids), rows.union(rows)).collect()} == wanted
