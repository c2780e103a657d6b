"""The multiset hash against sums over words in plain Python, with the hash function of another library."""

import hashlib
import random

import xxhash
from pyspark.sql import types as T

from tidewatch.llm import multiset_hash as M

SCHEMA = "doc_id long, text string, shard string"


def _hash(*parts) -> int:
    """Hash of texts, longs (8 bytes) and ints (a tuple with 4 bytes), each seeded by the one before."""
    seed = 42
    for p in parts:
        raw = p.encode() if isinstance(p, str) else p
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def _sums(text: str) -> dict[str, int]:
    lines = text.split("\n")
    out = dict.fromkeys(M.SUMS, 0)
    out["paragraphs"] = len(lines)
    for line in lines:
        for i in range(M.EQUAL):
            out[f"e{i}"] = (out[f"e{i}"] + _hash(i.to_bytes(4, "little"), line)) % 2**32
        words = line.split(" ")
        for h0 in [_hash(a, b) for a, b in zip(words, words[1:])] or [_hash(line)]:
            out["pairs"] += 1
            for half, h in enumerate((h0, _hash(h0.to_bytes(8, "little")))):
                for i in range(M.NEAR // 2):
                    out[f"n{half * M.NEAR // 2 + i}"] += (h >> i & 1) + ((h >> i + 31 & 1) << 31)
    return out


def _print(s: dict[str, int]) -> str:
    return "".join(f"{s[c]:0{8 if c[0] == 'e' else 16}x}" for c in M.SUMS)


def _signs(s: dict[str, int]) -> list[int]:
    return [2 * (s[f"n{i}"] >> 31 * j & 2**31 - 1) - s["pairs"] for i in range(M.NEAR) for j in range(2)]


def _like(a: list[int], b: list[int]) -> float:
    both = sum(x * x for x in a) + sum(x * x for x in b)
    return min(1.0, max(0.0, 2 * sum(x * y for x, y in zip(a, b)) / both)) if both else 1.0


def _brute(rows: list[tuple]) -> list[tuple]:
    docs = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for i, (d, t) in enumerate(docs):
        follows = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follows[:half]
        x, y, z = _sums(t), _sums(edited), _sums(follows)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), _print(x), _print(y), round(_like(_signs(x), _signs(y)), 9), round(_like(_signs(x), _signs(z)), 9)))
    return sorted(out, key=str)


def _rows(spark, rows: list[tuple]) -> list[tuple]:
    got = M.compared(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=str)


def test_against_plain_sums(spark):
    draw = random.Random(5)
    words = ["alpha", "beta", "straße", "𝒳", "", "gamma\n", "delta"]
    rows = [(7 * i - 40, " ".join(draw.choices(words, k=draw.choice([0, 1, 2, 9, 40]))), "z") for i in range(30)]
    rows += [(None, "no id", None), (None, None, "z"), (3, None, "z"), (3, "same id", "z"), (3, "same id", "z"), (9**15, "", "z")]
    rows += [(500, " ".join(draw.choices(words, k=700)), "z"), (501, "one word " * 255, "z"), (502, "\n" * 600, "z")]
    assert _rows(spark, rows) == _brute(rows)


def test_one_document_follows_itself(spark):
    assert _rows(spark, [(1, "alone here", None)]) == _brute([(1, "alone here", None)])
    assert _rows(spark, [(None, None, None)]) == _brute([(None, None, None)])


def test_sums_keep_other_columns(spark):
    rows = spark.createDataFrame([("a b c", 1, 2)], T.StructType([T.StructField("t", T.StringType()), T.StructField("e0", T.IntegerType()), T.StructField("pairs", T.IntegerType())]))
    got = M.with_sums(rows, "t", "x").first()
    assert (got["e0"], got["pairs"], got["x"]["pairs"], got["x"]["paragraphs"]) == (1, 2, 2, 1)
