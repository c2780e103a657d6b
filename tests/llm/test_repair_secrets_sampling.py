"""Conversation repair, secret scans and importance resampling against brute force on small and odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import conversations, importance, secret_scan
from tidewatch.llm import words as W

CONVERSATION = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def tie(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def repair(rows):
    """Faults and the least of the cheapest edits by trying all edits forward, state by state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, tie(r[2], r[3])))
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(states):
        for _ in range(2):
            for q, (cost, audit, out) in list(states.items()):
                for role in ("user", "assistant"):
                    if (q, role[0]) in legal:
                        new = (cost + 2, audit + "I", (*out, f"{role}:"))
                        states[role[0]] = min(states.get(role[0], new), new)
        return states

    states = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for q, (cost, audit, out) in inserted(states).items():
            options = [(q, (cost + 3, audit + "D", out))]
            if fault in ("", "truncated"):
                late = fault == "truncated"
                if (q, role[:1]) in legal:
                    options.append((role[:1], (cost + late, audit + "K", (*out, f"{role}:{text}"))))
                options += [(r[0], (cost + 2 + late, audit + "R", (*out, f"{r}:{text}"))) for r in ("user", "assistant") if (q, r[0]) in legal]
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        states = after
    cost, audit, out = min(v for k, v in inserted(states).items() if k in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    heads = [r[2][:1] for r in rows]
    count = Counter(faults)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def compared(spark, rows, partitions=3):
    got = conversations.repaired(conversations.damaged(spark.createDataFrame(rows, CONVERSATION).repartition(partitions))).collect()
    left = damage(rows)
    want = {(c, *repair([r for r in left if r[0] == c])) for c in {r[0] for r in rows}}
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want
    assert got == [] or list(got[0].asDict()) == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_conversations(rng):
    roles, texts = ["user", "assistant", "system"], ["Hi.", "Hello there", "  ", "", None, "What?", "ok.", "No!  ", "Wort ohne Ende …"]
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(roles) if rng.random() < 0.8 else rng.choice(["tool", None, "", "agent"])
            text = rng.choice(texts)
            rows.append((c, rng.choice([t, t, t, None, rng.randrange(4)]), role, text if text is None or rng.random() < 0.4 else f"{text} {rng.randrange(30)}."))
    return rows


def test_repair_of_odd_rows(spark):
    compared(spark, odd_conversations(random.Random(1)))


@pytest.mark.parametrize(("chunk", "block"), [(4, 3), (7, 16)])
def test_repair_of_conversations_in_many_chunks(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(chunk)
    rows = odd_conversations(rng)[:60]
    rows += [(1000, t // 2, rng.choice(["user", "assistant", "system"]), f"turn {rng.randrange(200)}" + rng.choice([".", "", " "])) for t in range(300)]
    rows += [(1001, 3, "user", "same.")] * 50 + [(1002, None, None, None)] * 20 + [(1003, 1, "user", "x" * 100_000 + ".")]
    compared(spark, rows)


def test_repair_of_no_rows(spark):
    compared(spark, [])
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    compared(spark, [(dropped, 0, "user", "Hi.")])


def test_repair_ignores_other_columns_and_keeps_the_kind_of_the_id(spark):
    rows = spark.createDataFrame([("c", 0, "user", "Hi.", 1, "k"), ("c", 1, "assistant", "Yes.", 2, "l")], "conv_id string, turn int, role string, text string, first int, key string")
    got = conversations.repaired(conversations.damaged(rows)).collect()
    assert got[0]["conv_id"] == "c" and len(got) == 1


def test_auction_prices_are_distances():
    rng = random.Random(2)
    for _ in range(100):
        codes = bytes(rng.randrange(9) for _ in range(rng.randrange(0, 20)))
        far = [[0 if q == w else math.inf for w in range(4)] for q in range(4)]
        for code in reversed(codes):  # plain backward steps, with up to two insertions before each row
            step = [[math.inf] * 4 for _ in range(4)]
            for q in range(4):
                for w in range(4):
                    step[q][w] = min(cost + far[to][w] for _, cost, to in conversations._ROW_ARCS[code][q])
            for _ in range(3):
                for q in range(4):
                    for _, cost, to in conversations._INSERTS[q]:
                        step[q] = [min(a, cost + b) for a, b in zip(step[q], step[to], strict=True)]
            far = step
        got = conversations.distances(codes)
        assert [x if x < conversations.NONE else math.inf for x in got] == [x for row in far for x in row]


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m[2]) >= 12]
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def test_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(4)
    pieces = ["token", "PassWord", "api_key", "apikey", "=", ": ", " = ", '"', "'", "AKIA", "AKIAB12", "0123456789ABCDEF", "deadbeefdeadbeef", "é聖😀", "\n", "\t", "secret.value-1", "x", " ", "ſecret", "-", "a" * 15]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", None, "token=abcdefghijkl " * 3000, "f" * 200_000]
    rows = spark.createDataFrame([(None if i % 50 == 3 else i // 2, t, 1, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, row int, tokens string, base int").repartition(3)
    got = secret_scan.scanned(rows)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def want(i, t):
        spans = base_spans(t or "")
        listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in spans)
        return (None if i % 50 == 3 else i // 2, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest())

    rows = got.collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(want(i, t) for i, t in enumerate(texts))
    for r in rows:
        own = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == r["base_sha256"]


def battery(token):
    """The four statistics and both p-values of one token, from the definitions."""
    kind = next(k for k, p in (("hex", "[0-9a-f]+|[0-9A-F]+"), ("base32", "[A-Z2-7]+"), ("lower", "[0-9a-z]+"), ("mixed", "[0-9A-Za-z]+"), ("base64", ".+")) if re.fullmatch(p, token))
    alphabet = secret_scan.ALPHABETS[kind]
    token = token.lower() if kind == "hex" else token.replace("-", "+").replace("_", "/") if kind == "base64" else token
    x = np.array([alphabet.index(c) for c in token], float)
    n, size = len(x), len(alphabet)
    counts = np.bincount(x.astype(int), minlength=size)
    chi = ((counts - n / size) ** 2 / (n / size)).sum()
    z = [(chi - (size - 1)) / math.sqrt(2 * (size - 1) * (1 - 1 / n))]
    high = x >= size // 2
    ones = high.sum()
    mean = 2 * ones * (n - ones) / n + 1
    z.append((1 + (high[1:] != high[:-1]).sum() - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)))
    d = x - x.mean()
    z += [((d[k:] * d[:-k]).sum() / (d @ d) + 1 / n) * math.sqrt(n) for k in (1, 2)]
    t = sum(v * v for v in z) / 2
    pairs = (counts * (counts - 1) / 2).sum()
    meet, three = secret_scan.ORDINARY[kind]
    all_pairs = n * (n - 1) / 2
    sd = math.sqrt(all_pairs * meet * (1 - meet) + n * (n - 1) * (n - 2) * (three - meet**2))
    return kind, math.exp(-t) * (1 + t), math.erfc(-(pairs + 0.5 - all_pairs * meet) / sd / math.sqrt(2)) / 2


def test_battery_follows_its_definitions(spark):
    rng = random.Random(6)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/-_"]
    tokens = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (24, 33, 80, 256)]
    tokens = [t for t in tokens if re.search("[0-9]", t) and re.search("[A-Za-z]", t)]
    got = {r["token"]: r for r in secret_scan.tested(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    for t in set(tokens) & set(got):
        kind, random_p, ordinary_p = battery(t)
        assert got[t]["encoding"] == kind
        assert got[t]["random_p"] == pytest.approx(random_p, abs=1e-9)
        assert got[t]["ordinary_p"] == pytest.approx(ordinary_p, abs=2e-7)
    assert len(got) > 15
    words = ["onlylettersinthisword", "12345678901234567890123", "UpperAndLowerWithoutDigits"]
    assert secret_scan.tested(spark.createDataFrame([(t,) for t in words], "token string")).count() == 0


def test_secrets_without_a_name_are_found_and_identifiers_left_alone(spark):
    rng = random.Random(3)
    secrets, rows = [], []
    letters = string.ascii_letters + string.digits
    for i in range(120):
        secrets.append("".join(rng.choice(letters) for _ in range(40)))
        plain = "some getUserNameById2AndThenSomething the_quick_brown_fox_jumps_12_times abcdefghijklmnopqrstuvwxyz0123456789 words"
        rows.append((i, f"{plain} {secrets[-1]} end" if i % 2 else f"{plain} token = {secrets[-1]}"))
    hit = 0
    for r in secret_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        found = [rows[r["doc_id"]][1][int(a) : int(e)] for k, a, e in spans if k == "random"]
        assert set(found) <= {secrets[r["doc_id"]]} if r["doc_id"] % 2 else not found
        hit += len(found)
    assert hit >= 57  # of 60
    assert secret_scan.scanned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@pytest.mark.parametrize("segment", [16, 300, 1 << 20])
def test_crcs_of_ngrams_come_from_prefixes(monkeypatch, segment):
    monkeypatch.setattr(W, "SEGMENT", segment)
    rng = random.Random(segment)
    texts = [None, "", "One", "é聖 Naïf-word 12", "x" * 5000, " ".join("y" * rng.choice([1, 3, 900, 2100]) + "Zz" for _ in range(40)), " ".join(f"w{rng.randrange(99)}" for _ in range(3000))]
    data, offsets = W.flat(pa.array(texts, pa.string()))
    crc, begin, words = importance.features(data, offsets)
    for i, t in enumerate(texts):
        w, g = grams(t)
        assert words[i] == len(w)
        assert crc[begin[i] : begin[i + 1]].tolist() == [zlib.crc32(x.encode()) for x in g]


def draw(documents, target):
    """The contract, row by row."""
    s, t = (Counter(zlib.crc32(g.encode()) % 10000 for x in texts for g in grams(x)[1]) for texts in ([d[1] for d in documents], target))
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    rows = []
    for doc_id, text in documents:
        words, g = grams(text)
        weight = sum(gain(zlib.crc32(x.encode()) % 10000) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    may = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = [(*r[:4], i + 1 if i < 25 * len(may) // 100 else None) for i, r in enumerate(may)]
    return Counter(ranks) + Counter((*r[:4], None) for r in rows if r[4] < 20)


def test_resampling_follows_the_contract(spark):
    rng = random.Random(9)
    documents = [(i, " ".join(f"W{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(60)))) for i in range(150)]
    documents += [(None, documents[3][1])] * 40 + [documents[5]] * 30 + [(200, None), (201, ""), (202, "é聖 " * 50), (203, "long " * 60000)]
    target = [" ".join(f"w{rng.randrange(12)}" for _ in range(30)), None, "", "w1 w2"]
    docs = spark.createDataFrame([(*d, 1, 2, b"x") for d in documents], "doc_id long, text string, rank int, _row int, found binary").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert Counter(tuple(r) for r in importance.resampled(docs, goal).collect()) == draw(documents, target)
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(nothing, goal).collect() == []
    few = importance.resampled(docs.limit(30), nothing.select("text")).collect()
    assert len(few) == 30


def test_sql_of_the_new_queries_agrees_with_brute_force():
    """The registered SQL against the row-by-row versions above."""
    con = duckdb.connect()
    rows = odd_conversations(random.Random(8))
    con.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows], pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))
    cur = con.execute(conversations._ORACLE)
    left = damage(rows)
    assert {tuple(r) for r in cur.fetchall()} == {(c, *repair([r for r in left if r[0] == c])) for c in {r[0] for r in rows}}
