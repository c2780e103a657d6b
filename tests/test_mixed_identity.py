"""Duplicates in data sets where only some records carry an identifier, against a walk row by row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import dedup

COLUMNS = "client_id string, ts_seconds double, event_type string, payload string, uid string, original_order long"


def walked(rows):
    """Owner of every row, and rows that disagree with an earlier one of their identifier; keyed by original_order."""
    kept, owner, clashes = [], {}, set()
    for row in sorted(rows, key=lambda r: (r[1], r[5])):
        for old in kept:
            named = row[4] is not None and old[4] is not None
            if row[4] == old[4] if named else row[:4] == old[:4]:
                owner[row[5]] = old[5]
                if named and (row[0], *row[2:4]) != (old[0], *old[2:4]):
                    clashes.add(row[5])
                break
        else:
            kept.append(row)
            owner[row[5]] = row[5]
    return owner, clashes


def chained(seed):
    """Few identifiers over few keys, so that rows wait for each other across many of both."""
    rng = random.Random(seed)
    places = rng.sample(range(10_000), 160)
    rows = []
    for place in places:
        when = float(rng.randrange(25))
        payload = rng.choice([None, "", "a"]) if seed % 2 else "a"
        rows.append(("m", when, "scan", payload, rng.choice([None, f"k{rng.randrange(14)}", f"k{rng.randrange(14)}"]), place))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_owners_are_those_of_a_walk_in_order(spark, seed):
    rows = chained(seed)
    owner, clashes = walked(rows)
    got = dedup.judged(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    assert len(got) == len(rows)
    assert {r["at"]["original_order"]: r["owner"]["original_order"] for r in got} == owner
    assert {r["at"]["original_order"] for r in got if r["conflict"]} == clashes


def test_counts_of_valid_and_invalid_data(spark):
    rows = chained(2)
    owner, clashes = walked(rows)
    assert not clashes
    events = spark.createDataFrame(rows, COLUMNS)
    kept = {r["original_order"]: r["copies"] for r in dedup.deduplicated(events, by_uid=True).collect()}
    assert kept == {p: list(owner.values()).count(p) for p in set(owner.values())}
    assert tuple(dedup.accounting(events, by_uid=True).first()) == ("READY", len(kept), len(rows) - len(kept))
    last = max(rows, key=lambda r: (r[1], r[5]))
    named = next(r for r in rows if owner[r[5]] == r[5] and r[4] is not None)
    more = [*rows, ("m", last[1] + 1, "scan", "other", named[4], 20_000), ("m", last[1] + 2, "scan", "a", named[4], 20_001)]
    clash = spark.createDataFrame(more, COLUMNS)
    assert dedup.deduplicated(clash, by_uid=True).count() == 0
    assert tuple(dedup.accounting(clash, by_uid=True).first()) == ("Invalid", 0, len(rows) - len(kept))


def test_a_chain_longer_than_a_round(spark):
    """Each key's first row without identifier waits for an identifier that waits for the key before."""
    rows = [("m", 0.0, "scan", "a", None, 0)]
    for i in range(6):
        rows += [("m", float(i), "scan", "a", f"k{i}", 100 * i + 1), ("m", i + 1.0, "scan", "a", f"k{i}", 100 * i + 50), ("m", i + 1.0, "scan", "a", None, 100 * i + 60)]
    owner, _ = walked(rows)
    got = dedup.judged(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {r["at"]["original_order"]: r["owner"]["original_order"] for r in got} == owner


def test_one_identifier_and_one_key_may_hold_most_rows(spark):
    rows = [("m", 5.0, "scan", "a", None if i % 3 == 0 else f"k{i % 2}", i) for i in range(3000)]
    owner, _ = walked(rows)
    got = dedup.judged(spark.createDataFrame(rows, COLUMNS).repartition(4)).collect()
    assert {r["at"]["original_order"]: r["owner"]["original_order"] for r in got} == owner


def test_data_without_any_identifier_goes_by_the_exact_key(spark):
    rows = [("m", 4.0, "scan", "b", None, 2), ("m", 4.0, "scan", "b", None, 3), ("n", 4.0, "scan", "b", None, 4)]
    kept = dedup.deduplicated(spark.createDataFrame(rows, COLUMNS), by_uid=True).collect()
    assert {r["original_order"]: r["copies"] for r in kept} == {2: 2, 4: 1}
    assert dedup.deduplicated(spark.createDataFrame([], COLUMNS), by_uid=True).collect() == []


def test_accounting_by_identifier_and_without_any(spark):
    rows = [("m", float(t), "scan", p, u, i) for i, (t, p, u) in enumerate([(0, "a", "x"), (1, "a", "x"), (2, "b", "y"), (3, "c", "y"), (4, "a", "x"), (3, "c", "z"), (1, "c", "z")])]
    events = spark.createDataFrame(rows, COLUMNS)
    assert tuple(dedup.accounting(events, by_uid=True).first()) == ("Invalid", 0, 1)
    assert tuple(dedup.accounting(events.filter("uid <> 'y'"), by_uid=True).first()) == ("READY", 2, 3)
    bare = events.withColumn("uid", F.lit(None).cast("string")).unionByName(events.withColumn("uid", F.lit(None).cast("string")))
    assert tuple(dedup.accounting(bare, by_uid=True).first()) == ("READY", 6, 8)
