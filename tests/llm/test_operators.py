"""Operators of the training-data subpackage: brute force, round trips, and tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, html_text, multiset_hash, near, pieces, quality, substring, token_files, toxicity, url_filter
from tidewatch.llm import words as W
from tidewatch.llm.common import tokenizer_path
from tidewatch.session import fresh_path

PASSAGE = " ".join(f"word{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, c0 string, id long, shard int"
ROWS = [
    (1, PASSAGE + " alpha beta"), (2, "lead " + PASSAGE + " gamma"), (3, PASSAGE + " alpha beta"), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "ONE"),
    (9, "x" * 30000), (10, "ab " * 9000), (11, "Short words here. " * 3 + "\nÉté naïf 聖 😀"), (11, "Short words here. " * 3 + "\nÉté naïf 聖 😀"), (12, "it " + " ".join(f"w{i}" for i in range(30))),
    (None, "no id at all but some words"), (13, "item zero has exactly ten words in it and then"), (14, "tiny item"),
]
ITEMS = [("0", "Item ZERO has exactly ten words in it, and then."), ("1", "tiny item"), ("2", None), ("3", ""), (None, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 0.5, "c", 9, 3) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(1, 12)] + [(1, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def split(text, pattern=r"[^\x20\x09-\x0D]+", lower=False):
    text = text or ""
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def test_words_match_patterns_and_do_not_depend_on_segments(monkeypatch):
    import pyarrow as pa

    texts = [t for _, t in ROWS]
    data, offsets = W.flat(pa.array(texts))
    for kind, pattern, lower in (("space", r"[^\x20\x09-\x0D]+", False), ("lower", r"[^\x20\x09-\x0D]+", True), ("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        start, end, first = W.bounds(data, offsets, kind)
        counts = [len(split(t, pattern, lower)) for t in texts]
        assert np.diff(first).tolist() == counts
        whole = W.hashes(data, start, end, kind)
        named = dict(zip(whole.tolist(), [w for t in texts for w in split(t, pattern, lower)], strict=True))
        assert len(set(named.values())) == len(named)


def test_substring_matches_brute_force(docs, empty):
    first = {}
    for i, t in ROWS:
        w = split(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), set()).add(math.inf if i is None else i)
    want = []
    for i, t in ROWS:
        w = split(t)
        gone = set()
        for k in range(len(w) - 12):
            if min(first[tuple(w[k : k + 13])]) < (math.inf if i is None else i):
                gone |= set(range(k, k + 13))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    got = [tuple(r) for r in substring.judged(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring.judged(empty).count() == 0
    kept = {r["doc_id"]: r for r in substring.deduplicated(docs).collect()}
    assert 3 not in kept and kept[2]["text"] == "lead\ngamma" and kept[2]["n_chars"] == 10 and kept[4]["text"] is None or kept[4]["text"] == ""
    spans = {(r["doc_id"], r["start_word"], r["n_words"], r["ref_doc_id"]) for r in substring.duplicate_spans(docs).collect()}
    assert (2, 1, 60, 1) in spans and (3, 0, 62, 1) in spans


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(spark, docs, empty, size):
    rng = np.random.default_rng(3)
    base = [f"t{x}" for x in rng.integers(0, 5000, 80)]
    rows = list(ROWS)
    for k in range(25):
        w = list(base)
        for at in rng.integers(0, 80, k // 4):
            w[at] = f"n{rng.integers(0, 9)}"
        rows.append((100 + k, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = split(t, lower=True)
        sets.setdefault(math.inf if i is None else i, []).append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x & y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    got = near.near_duplicates(table, size).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None if i == math.inf else i, None if root(i) == math.inf else root(i)) for i in ids}
    assert len(got) == len(rows) and near.near_duplicates(empty, size).count() == 0
    assert near.deduplicated(docs, size).columns == docs.columns


def test_deduplicated_rows_with_shared_or_missing_ids_match_brute_force(spark):
    rng = np.random.default_rng(8)
    text = lambda k: " ".join(f"k{k}n{x}" for x in range(60))
    near_to = lambda k: text(k) + " tail"
    rows = [(5, text(5)), (9, text(9)), (None, text(5)), (None, near_to(5)), (None, near_to(9)), (None, text(20)), (None, text(21)), (None, text(21)), (None, None), (None, ""), (None, "")]
    rows += [(30, text(30)), (30, text(31)), (31, near_to(31)), (32, near_to(30)), (33, text(33)), (33, text(33)), (33, text(34)), (34, text(33))]
    for _ in range(40):
        k = int(rng.integers(50, 62))
        rows.append((None if rng.random() < 0.3 else int(rng.integers(100, 112)), [text(k), near_to(k), "lead " + near_to(k)][rng.integers(0, 3)]))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (split(t, lower=True) for _, t in rows)]
    groups = []
    for k, x in enumerate(sets):
        met = [g for g in groups if any(x & sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]) for j in g)]
        groups = [g for g in groups if g not in met] + [sum(met, [k])]
    number = lambda i: math.inf if i is None else i
    got = near.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(groups)
    for g in groups:
        least = min(number(rows[j][0]) for j in g)
        assert sum(r["text"] == t and number(r["doc_id"]) == least for r in got for t in {rows[j][1] for j in g}) == (1 if sets[g[0]] else sum(rows[j][1] == rows[g[0]][1] for j in range(len(rows))))


def test_odd_sketch_bits_grow_with_difference():
    keys = W.mix(np.arange(1, 2001, dtype=np.uint64))
    bits = []
    for other in (0, 100, 400, 1500):
        both = np.concatenate([keys[:1500], keys[other : other + 1500] if other else keys[:1500]])
        s = near.odd_sketches(near.samples(both[: len(both)], np.array([0, 1500])))
        bits.append(int(np.unpackbits((s[0] ^ s[1]).view(np.uint8)).sum()))
    assert bits[0] == 0 and bits == sorted(bits) and bits[1] < near.MOST_BITS < bits[3]


def test_decontamination_matches_brute_force(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want = []
    for i, t in ROWS:
        w, hit, names = split(t, pattern, True), set(), set()
        for item, x in ITEMS:
            v = split(x, pattern, True)
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[k : k + n]:
                        hit |= set(range(j, j + n))
                        names.add(item or "")
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert sorted((tuple(r) for r in decontaminate.judged(docs, bench, ["doc_id"]).collect()), key=str) == sorted(want, key=str)
    several = decontaminate.BLOCK_CHARS
    try:
        decontaminate.blocks.__defaults__ = (20,)
        assert sorted((tuple(r) for r in decontaminate.judged(docs, bench, ["doc_id"]).collect()), key=str) == sorted(want, key=str)
    finally:
        decontaminate.blocks.__defaults__ = (several,)
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)
    assert decontaminate.judged(empty, bench, ["doc_id"]).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.judged(docs, bench.limit(0), ["doc_id"]).collect())


def test_token_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for table, rows in ((docs, want), (empty, [])):
        out = fresh_path(spark, "test-tokens")
        token_files.write(table, out, path)
        assert sorted((tuple(r) for r in token_files.read(spark, out).collect()), key=str) == sorted(rows, key=str)
    cache = token_files.WordCache(path)
    for t in ("Hello<|endoftext|>World  it's x", "don't you're\r\n\x0bzz\x1cq 12ab3", "WORD*** <|ENDOFTEXT|>. a.b, İI ﬁ １２!"):
        assert cache.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes()
    values = np.sort(np.random.default_rng(1).integers(0, 10**9, 3000))
    packed = token_files.elias_fano(values)
    assert (token_files.decoded(3000, *packed[:3]) == values).all()
    assert all(token_files.select(i, *packed) == values[i] for i in range(0, 3000, 11))


def test_token_cache_gives_the_ids_of_the_library(monkeypatch, tmp_path):
    import json
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(7)
    marks = ["a", "B", "zz", "é", "E\u0301", "H\u0331", "İ", "Σ", "ﬁ", "１", "क़", "42", "'", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", ".", "***", "—", "\u0301", " ", " ", "\n", "\t", "\x0b", "\x85", "\xa0", "😀", "聖", "\x00", "-", "ᄀ", "ᅡ"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["İ. x", "क़. x", "", None, " \n"]
    said = json.load(open(path))
    said["normalizer"]["normalizers"].pop()  # keeps the case
    (tmp_path / "cased.json").write_text(json.dumps(said))
    for file in (path, str(tmp_path / "cased.json")):
        library, cache = Tokenizer.from_file(file), token_files.WordCache(file)
        monkeypatch.setattr(token_files, "CACHE_ENTRIES", 150)
        for lo in range(0, len(texts), 500):
            ids, sizes = cache.encode_all(pa.array(texts[lo : lo + 500]))
            want = [library.encode(t or "", add_special_tokens=False).ids for t in texts[lo : lo + 500]]
            assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_token_blocks_end_with_the_document_that_fills_them(monkeypatch):
    import types

    import pyarrow as pa

    monkeypatch.setattr(token_files, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(token_files, "BLOCK_IDS", 7)
    monkeypatch.setattr(token_files, "CHUNK_BYTES", 40)
    path, texts = tokenizer_path("word_bpe_49k.json"), [None, "", "a b c d e f", "a", "a b", "a b c " * 9, "", "it is"] * 5
    batches = [pa.record_batch({"doc_id": pa.array([None if i < 2 else i for i in range(lo, lo + 8)], pa.int64()), "text": pa.array(texts[lo : lo + 8])}) for lo in range(0, 40, 8)]
    blocks = [x for b in token_files._packed(iter(batches), path, 1) for x in b.to_pylist()]
    cache = token_files.WordCache(path)
    assert b"".join(b["ids"] for b in blocks) == b"".join(cache.encode(t) + b"\x01\x00" for t in texts)
    assert [b["n_ids"] >= 7 for b in blocks[:-1]] == [True] * (len(blocks) - 1) and len(blocks) > 5
    assert [b["before"] for b in blocks] == np.cumsum([0, *(b["n_ids"] for b in blocks)])[:-1].tolist() and sum(b["n_docs"] for b in blocks) == 40
    for b in blocks:
        ends = token_files.decoded(b["n_docs"], b["end_low_bits"], b["end_low"], b["end_high"])
        assert ends[-1] == b["n_ids"] and (len(ends) < 2 or ends[-2] < 7)
    docs = [d for b in blocks for d in [None] * b["n_null"] + (token_files.decoded(b["n_docs"] - b["n_null"], b["doc_low_bits"], b["doc_low"], b["doc_high"]) + b["first_id"]).tolist()]
    assert docs == [None, None, *range(2, 40)]


def test_token_files_order_repeated_ids_without_texts_as_range_keys(spark):
    texts = [f"{'same start ' * (k % 3)}text {k}" for k in range(200)] + ["copy"] * 20
    rows = [(None if k % 3 == 0 else k % 2, t) for k, t in enumerate(texts)]
    got = token_files.ordered(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"rangepartitioning\((.*), 7\)", plan)
    assert len(keys) == 1 and "text#" not in re.sub(r"xxhash64\(text#\d+, \d+\)", "", keys[0])
    found = [(r["doc_id"], r["h"], r["text"], r["p"]) for r in got.select("doc_id", "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("p")).collect()]
    assert len({x[3] for x in found}) > 3 and sorted(((x[0], x[2]) for x in found), key=str) == sorted(rows, key=str)
    assert [x[:3] for x in found] == sorted((x[:3] for x in found), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def test_multiset_hash(spark, docs, empty):
    got = multiset_hash.compared(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["fingerprint"] == by_id[3]["fingerprint"] != by_id[2]["fingerprint"] and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert multiset_hash.compared(empty).count() == 0
    rows = spark.createDataFrame([("a", "p one\nq two"), ("b", "q two\np one"), ("c", "p one"), ("d", "q two")], "k string, t string")
    sums = {r["k"]: r.asDict() for r in multiset_hash.fingerprints(rows, ["k"], "t").collect()}
    add = multiset_hash.combined(sums["c"], sums["d"])
    assert all(sums["a"][c] == sums["b"][c] == add[c] for c in multiset_hash.SUMS)
    assert multiset_hash.combined(add, sums["d"], -1) == {c: sums["c"][c] for c in multiset_hash.SUMS}


def test_classifiers_handle_odd_rows(docs, empty, labels):
    for judge in (quality.judged, toxicity.judged):
        for known in (labels, labels.limit(0)):
            got = judge(docs, known, ["doc_id"]).collect()
            assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert judge(empty, labels, ["doc_id"]).count() == 0
    assert quality.accepted(docs, labels).columns == docs.columns


def test_held_out_accuracy(spark):
    rows = [(i, " ".join([f"w{(i * 7 + k * k) % 97}" for k in range(60)] + (["vile"] * 3 if i % 5 == 0 else [])) + ("***" * 40 if i % 3 == 0 else "")) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    for judge, right in ((quality.judged, lambda i: i % 3 != 0), (toxicity.judged, lambda i: i % 5 == 0)):
        held = [r for r in judge(table, known, ["doc_id"]).collect() if r["held_out"]]
        assert sum(r["predicted"] == right(r["doc_id"]) for r in held) > 0.95 * len(held)


def test_urls(spark):
    urls = ["HTTP://A.Example.NET/en/x?q", "http://example.net/de/", "https://x.example.com/de/1#t", "ftp://b.org/fr/?a", "no scheme", None, "http://", "http://notexample.com/de/", "://h.com#/de/"]
    page = '<a href="http://x.example.com/de/1">a</a><a href=/rel>b</a>'
    table = spark.createDataFrame([(i, u, page if i % 2 else None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judged(table, ["page_id"]).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1][2:] == ("net/", "block") and got[2][2:] == ("example.com/de/", "block")
    assert got[3] == ("b.org", "/fr/", "org/fr/", "allow") and got[4][:3] == got[5][:3] == got[6][:3] == ("", "", None) and got[7][2] is None and got[8][:3] == ("h.com", "", None)
    # notexample.com links to a blocked page: distrust flows back to it
    masses = {r["host"]: r for r in url_filter.host_masses(table, url_filter.RULES).collect()}
    assert masses["notexample.com"]["distrust"] > 0 and url_filter.judged(table.limit(0), ["page_id"]).count() == 0


def test_html(spark):
    page = '<html><head><title>T t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><article><h1>Head &amp; <b>bo</b>ld</h1><p>Body {} text<br>more\n  words</p><aside class="related">See also this</aside></article><footer>&copy; foot note</footer></body></html>'
    rows = [(i, "u", page.format(f"number {i} of some longer story")) for i in range(40)] + [(90, "u", None), (91, None, ""), (92, "u", "<p>only &am"), (93, "u", "<<>< <p"), (94, "u", page.format("cut")[:-60])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extracted(table, ["page_id", "url"]).collect()}
    assert got[3]["text"] == "Head & bold Body number 3 of some longer story text more words" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[90]["text"] == got[91]["text"] == "" and got[92]["text"] == "only &am" and got[94]["text"].startswith("Head & bold Body cut text")
    assert html_text.extracted(table.limit(0), ["page_id", "url"]).count() == 0


def test_html_adverts_in_articles_and_menu_heavy_pages():
    lead, rest = " ".join(f"lead{k}" for k in range(30)), " ".join(f"rest{k}" for k in range(80))
    advert = " ".join(f"buy{k}" for k in range(40))
    box = "".join(f"<li><a href=/{k}>other story {k}</a></li>" for k in range(20))
    page = "<html><body><div class=outer><nav>{menu}</nav><article><h1>Head line</h1><p>{lead}</p>{mid}<p>{rest}</p></article><div class=legal><p>{legal}</p></div></div></body></html>"
    legal = " ".join(f"legal{k}" for k in range(20))
    light = html_text.fit([page.format(menu="one two", lead=lead, rest=rest, mid="", legal=legal)] * 20)
    heavy = html_text.fit([page.format(menu="<p>menu entry</p>" * 400, lead=lead, rest=rest, mid="", legal=legal * 20)] * 20)
    want = f"Head line {lead} {rest}"
    for model in (light, heavy):
        for menu in ("one two", "<p>menu entry</p>" * 400):
            for mid in ("", f"<div class=advert><p>{advert}</p></div>", f"<aside class=related><ul>{box}</ul></aside>", f"<div class=ad>{advert}</div><aside><p>{advert}</p></aside>"):
                assert html_text.extract(page.format(menu=menu, lead=lead, rest=rest, mid=mid, legal=legal), model) == want
        plain = f"<html><body><div class=content><h1>Head line</h1><p>{lead}</p><div class=advert><p>{advert}</p></div><p>{rest}</p></div></body></html>"
        assert html_text.extract(plain, model) == want


def test_pieces(docs, empty):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, v = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path)
    got = pieces.encoded(docs, path, ["doc_id"]).collect()
    texts = dict(ROWS)
    assert all(r["round_trip"] and library.decode(r["ids"]) == (texts[r["doc_id"]] or "") and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert {r["doc_id"] for r in got} == set(texts) and pieces.encoded(empty, path, ["doc_id"]).count() == 0
    n = 4000
    out = pieces.sampled(["the cat"] * n, W.mix(np.arange(n, dtype=np.uint64)), v, 3)
    assert all(len({tuple(x[0].tolist()) for x in o}) == 3 and o[0][2] >= o[1][2] >= o[2][2] for o in out)
    p = {tuple(x[0].tolist()): math.exp(x[1]) for o in out for x in o}
    top = max(p, key=p.get)
    assert abs(sum(tuple(o[0][0].tolist()) == top for o in out) / n - p[top]) < 0.03
    assert sum(p.values()) < 1 + 1e-4 and abs(np.mean([sum(math.exp(x[1]) / x[3] for x in o) for o in out]) - 1) < 0.05


def test_pieces_against_every_segmentation():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model, v = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ids = {model.id_to_piece(i): i for i in usable}
    assert v.longest == max(map(len, ids))

    def ways(unit):  # (ids, weight) of every segmentation
        if not unit:
            yield [], 0.0
        for k in range(1, len(unit) + 1):
            own = [ids[unit[:k]]] if unit[:k] in ids else [v.byte_id[x] for x in unit[0].encode()] if k == 1 else None
            if own:
                for rest, w in ways(unit[k:]):
                    yield [*own, *rest], w + sum(v.weight[i] for i in own)

    texts = ["the cat  sat", " é\U0001f9ff x", "▁a b▁▁", "naïve  "]
    for text in texts:
        units = re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁"))
        all_ways = {(): 0.0}
        for u in units:
            own = list(ways(u))
            norm = math.log(sum(math.exp(w) for _, w in own))
            all_ways = {(*a, *b): p + w - norm for a, p in all_ways.items() for b, w in own}
        # among many other texts: neither place nor neighbours change a sample or its probability
        crowd = [text, *(f"other words {j} " * 40 for j in range(300)), text]
        got = pieces.sampled(crowd, np.full(len(crowd), 99, np.uint64), v, 3)
        alone = pieces.sampled([text], np.full(1, 99, np.uint64), v, 3)[0]
        for one in (got[0], got[-1], alone):
            assert [x[0].tolist() for x in one] == [x[0].tolist() for x in alone] and len(one) == min(3, len(all_ways))
            assert all(abs(all_ways[tuple(x[0].tolist())] - x[1]) < 1e-9 for x in one)
            assert [x[2] for x in one] == pytest.approx([x[2] for x in alone], abs=1e-9)


def test_pipeline_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline

    docs = [(i, f"alpha{i} beta{i} gamma{i} " + " ".join(f"u{i}x{k}" for k in range(40)) + ".", "en", "s", 1) for i in range(30)]
    junk = [(100 + i, "*** ### " * 30 + f"j{i}", "en", "s", 1) for i in range(10)]
    copy = [(200, docs[3][1], "en", "s", 1), (201, "fresh start " + " ".join(f"u5x{k}" for k in range(20)) + " fresh stop " + " ".join(f"z{k}" for k in range(30)), "en", "s", 1), (202, " ".join(f"b{k}" for k in range(12)) + " own words here", "en", "s", 1)]
    where = str(tmp_path)
    spark.createDataFrame(docs + junk + copy, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(30), *range(100, 110)]], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([("q", " ".join(f"b{k}" for k in range(12)))], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    got = corpus_pipeline.run(spark, where).filter(F.col("sample") == 1).collect()
    library = pieces.Vocabulary(tokenizer_path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: library.decode(np.array(r["ids"])) for r in got}
    assert {*range(30), 201} == set(texts) and texts[0] == docs[0][1]
    assert "u5x3" not in texts[201] and "fresh start" in texts[201] and "z29" in texts[201]
