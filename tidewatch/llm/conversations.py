"""Conversation repair: the cheapest edits that restore the order of roles, by an auction for shortest paths.

The lattice of a conversation has one column per row (and one after the last) and four states: nothing kept yet,
``s`` kept, last kept ``u``, last kept ``a``. Arcs delete, keep or re-role the next row or insert a message; their costs are
integers. Node prices start as lower bounds. A path grows from its origin along an arc whose cost plus the price behind it
is least if that equals the price of the path's end; otherwise the end's price rises to it and the path is cut
back by one node. When the path reaches a node of known price, the origin's price is its distance. Prices never break
``price(v) <= cost + price(w)``, so every arc of every cheapest path is tight, and walking tight arcs in the order D, I, K, R
(leaving dead ends) gives the least edit string. The lattice is solved in blocks of columns from the end, so no price
has to climb further than one block.

A conversation may hold any share of all rows. Rows are counted up to identical ones, then ordered by conversation and turn in ranges
of about equal size; "seen earlier" is a marker row at the first turn of each text, which sorts just before it, so
nothing is joined. A conversation inside one range and of at most :data:`CHUNK` rows is solved on the spot. Others
are cut into chunks: each is reduced to its 4 x 4 distances (in parallel), a walk from the last chunk to the first turns these into the
prices behind each chunk, chunks are traced for each state they may be entered in (in parallel), and one walk forward picks the
traces. The walks hold a few numbers, but the repaired text's SHA-256 needs the bytes of a conversation in order,
so those of one conversation pass through one task as a stream.

Rows: nulls in role and text, and in the key of the damage, count as one space; a null conv_id is a conversation of its own;
null turns come first. Rows of equal turn go in the order of the SHA-256 of their length-prefixed role and text.
Identical rows follow each other, the first is no duplicate. A conversation whose rows are all dropped is returned with zeros; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import batches_of, groups_for, query, shuffle_partitions, table
from tidewatch.session import written

#: rows of a chunk, columns of a block, bytes of a range, longest kept pattern, kept patterns of a task
CHUNK, BLOCK, RANGE_BYTES, CACHED, PATTERNS = 256, 16, 32 << 20, 64, 1 << 16

START, S, U, A = range(4)
NONE = 1 << 60
#: price behind the last row: nothing kept or a whole turn ends; else user or assistant (or both) are inserted
END = (0, 4, 2, 0)
_TAIL = ("", "II", "I", "")
_BLANK = " \t\n\v\f\r"
#: code of a row: 0 must go; else 1 + initial (other, s, u, a) and 4 more if it is truncated
_GO = 0
#: state after keeping or writing a user or an assistant in each state
_NEXT = {U: (U, U, None, U), A: (None, None, A, None)}


def _arcs(code: int, q: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the arcs over one row, least edit first."""
    out = [("D", 3, q)]
    if code == _GO:
        return out
    initial, extra = (code - 1) % 4, int(code > 4)
    kept = S if initial == 1 and q == START else _NEXT[initial][q] if initial in _NEXT else None
    if kept is not None:
        out.append(("K", extra, kept))
    out.extend(("R", 2 + extra, role) for role in (U, A) if _NEXT[role][q] is not None)
    return out


_ROW_ARCS = {code: [_arcs(code, q) for q in range(4)] for code in range(9)}
_INSERTS = [[("I", 2, U)], [("I", 2, U)], [("I", 2, A)], [("I", 2, U)]]
_LEAST = [min(cost for q in range(4) for _, cost, _ in _ROW_ARCS[code][q]) for code in range(9)]
#: all arcs of a node in the order of edits: (edit, cost, columns further, next state)
_ALL = {code: [sorted([(e, c, 1, w) for e, c, w in _ROW_ARCS[code][q]] + [(e, c, 0, w) for e, c, w in _INSERTS[q]]) for q in range(4)] for code in range(9)}


def prices(codes: bytes, behind: tuple[int, ...]) -> list[int]:
    """Prices of all nodes (column by column) after auctions from every state of each block's first column."""
    n = len(codes)
    price = [0] * (4 * n) + list(behind)
    hi = n
    while hi > 0:
        lo = max(0, hi - BLOCK)
        # states u and a never lead back to s or to nothing, so with no price behind them they are dead
        dead = price[4 * hi + U] >= NONE and price[4 * hi + A] >= NONE
        floor = min(price[4 * hi : 4 * hi + 4])
        for i in range(hi - 1, lo - 1, -1):
            floor += _LEAST[codes[i]]
            price[4 * i : 4 * i + 4] = [floor, floor, NONE if dead else floor, NONE if dead else floor]
        for origin in range(4 * lo, 4 * lo + 4):
            path = [origin]
            while path and price[origin] < NONE:
                v = path[-1]
                if v >= 4 * hi:
                    break
                i, q = divmod(v, 4)
                least, best = NONE, -1
                for _, cost, further, w in _ALL[codes[i]][q]:
                    through = cost + price[4 * (i + further) + w]
                    if through < least:
                        least, best = through, 4 * (i + further) + w
                if price[v] < least:
                    price[v] = least
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(best)
        hi = lo
    return price


def distances(codes: bytes) -> list[int]:
    """Cost from each state before the first row to each state after the last one, row by row of a 4 x 4 table."""
    to = [prices(codes, tuple(0 if w == q else NONE for w in range(4)))[:4] for q in range(4)]
    return [min(to[w][q], NONE) for q in range(4) for w in range(4)]


def trace(codes: bytes, price: list[int], q: int) -> tuple[str, int] | None:
    """The least edit string along tight arcs from state q on, and the state after the last row."""
    n, dead, edits, path = len(codes), set(), [], [q]
    if price[q] >= NONE:
        return None
    while path:
        v = path[-1]
        if v >= 4 * n and price[v] < NONE:
            return "".join(edits), v - 4 * n
        i, state = divmod(v, 4)
        step = None
        if i < n:
            for edit, cost, further, w in _ALL[codes[i]][state]:
                to = 4 * (i + further) + w
                if price[v] == cost + price[to] and to not in dead:
                    step = edit, to
                    break
        if step is None:
            dead.add(path.pop())
            if edits:
                edits.pop()
            continue
        edits.append(step[0])
        path.append(step[1])
    return None


def solved(codes: bytes, known: dict) -> tuple[int, str]:
    """Cost and least edit string of a whole conversation; ``known`` keeps short patterns of the same task."""
    if codes in known:
        return known[codes]
    price = prices(codes, END)
    edits, state = trace(codes, price, START)
    out = price[START], edits + _TAIL[state]
    if len(codes) <= CACHED and len(known) < PATTERNS:
        known[codes] = out
    return out


class Repair:
    """Walks edits over rows and hashes the repaired conversation piece by piece."""

    def __init__(self):
        self.hash, self.state, self.any = hashlib.sha256(), START, False

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def walk(self, edits: str, codes: bytes, roles: list, texts: list) -> None:
        i = 0
        for edit in edits:
            if edit == "K":
                self.state = (codes[i] - 1) % 4
                self._put(roles[i], texts[i])
            elif edit != "D":
                self.state = A if self.state == U else U
                self._put("user" if self.state == U else "assistant", texts[i] if edit == "R" else "")
            i += edit != "I"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the number of copies (0 for a dropped row) after the damage."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw").isin(0, 1), "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 0, "").when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and a row ``first`` before the first occurrence of each, in ranges of their order.

    ``kind`` is 0 blank, 1 truncated, 2 sound; ``initial`` 0 other, 1 s, 2 u, 3 a.
    """
    cells = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    cells = cells.withColumn("key", key).withColumn("digest", digest)
    marks = cells.filter("copies > 0").groupBy("key", "digest").agg(F.min(F.struct("turn")).alias("at"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(_BLANK)), -1, 1)
    kind = F.when(last == "", 0).when(F.instr(F.lit(".!?"), last) == 0, 1).otherwise(2)
    head = F.substring("role", 1, 1)
    initial = F.when(head == "s", 1).when(head == "u", 2).when(head == "a", 3).otherwise(0)
    columns = ["key", "turn", "digest", "first", "conv_id", "role", "text", "copies", "kind", "initial"]
    cells = cells.withColumns({"first": F.lit(0), "kind": kind, "initial": initial}).select(*columns)
    none = F.lit(None)
    types = dict(cells.dtypes)
    marks = marks.select("key", F.col("at.turn").alias("turn"), "digest", F.lit(1).alias("first"), *(none.cast(types[c]).alias(c) for c in columns[4:]))
    parts = groups_for(rows, RANGE_BYTES)
    order = [F.asc("key"), F.asc_nulls_first("turn"), F.asc("digest")]
    return cells.unionByName(marks).repartitionByRange(parts, *order).sortWithinPartitions(*order, F.desc("first"))


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_CHUNK = (
    "whole boolean, key string, turn long, digest string, id long, cost long, audit string, repaired_sha256 string, "
    "codes binary, initials binary, roles array<string>, texts array<string>, distances array<long>, "
    "low long, high long, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, gaps long"
)
_LEGAL = {(1, 2), (2, 3), (3, 2)}


class _Chunk:
    """Rows of one conversation on their way into a chunk."""

    def __init__(self, key: str, conv, turn, digest: str):
        self.key, self.conv, self.turn, self.digest = key, conv, turn, digest
        self.codes, self.initials, self.roles, self.texts = bytearray(), bytearray(), [], []
        self.low = self.high = self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role: str, text: str, kind: int, initial: int, again: bool) -> None:
        if self.initials and (self.initials[-1], initial) not in _LEGAL:
            self.illegal += 1
        if kind == 0:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif kind == 1:
            self.truncated += 1
        go = kind == 0 or again
        self.codes.append(_GO if go else 1 + initial + 4 * (kind == 1))
        self.initials.append(initial)
        self.roles.append(None if go else role)
        self.texts.append(None if go else text)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.low, self.high, self.last_turn = self.first_turn, turn, turn

    def row(self, whole: bool, number: int, known: dict) -> dict:
        codes = bytes(self.codes)
        out = {"whole": whole, "key": self.key, "turn": self.turn, "digest": self.digest, "id": number, "conv_id": self.conv, "low": self.low, "high": self.high, "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn}
        out |= {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns}
        if whole:
            cost, audit = solved(codes, known)
            repair = Repair()
            repair.walk(audit, codes, self.roles, self.texts)
            return out | {"cost": cost, "audit": audit, "repaired_sha256": repair.hash.hexdigest()}
        return out | {"codes": codes, "initials": bytes(self.initials), "roles": self.roles, "texts": self.texts, "distances": distances(codes)}


def _arrow(spec: str, conv: pa.DataType) -> pa.Schema:
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    fields = [pa.field(*(lambda n, k: (n, kinds[k]))(*f.split(" "))) for f in spec.split(", ")]
    return pa.schema([*fields, pa.field("conv_id", conv)])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return batches_of(schema, {f.name: [r.get(f.name) for r in rows] for f in schema})


def chunked(rows: DataFrame) -> DataFrame:
    """Results of conversations that lie whole in one range, and chunks of all others."""
    ordered = _ordered(rows)
    kind = dict(ordered.dtypes)["conv_id"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, out = TaskContext.get().partitionId() << 40, 0, []
        schema, here, first_key, mark, cut, known = None, None, None, None, False, {}

        def close(whole: bool) -> None:
            nonlocal made, here
            made += 1
            out.append(here.row(whole and not cut and here.key != first_key, part + made, known))
            here = None

        for batch in batches:
            schema = schema or _arrow(_CHUNK, batch.schema.field("conv_id").type)
            for r in batch.to_pylist():
                if r["first"]:
                    mark = r["key"], r["turn"], r["digest"]
                    continue
                if first_key is None:
                    first_key = r["key"]
                if here is not None and here.key != r["key"]:
                    close(True)
                    cut = False
                if here is None:
                    here = _Chunk(r["key"], r["conv_id"], r["turn"], r["digest"])
                fresh = mark == (r["key"], r["turn"], r["digest"])
                for i in range(r["copies"]):
                    if len(here.codes) == CHUNK:
                        cut = True
                        close(False)
                        here = _Chunk(r["key"], r["conv_id"], r["turn"], r["digest"])
                    here.add(r["turn"], r["role"], r["text"], r["kind"], r["initial"], not (fresh and i == 0))
                    if len(out) >= CHUNK:
                        yield _batch(out, schema)
                        out.clear()
            if out:
                yield _batch(out, schema)
                out.clear()
        if here is not None:
            close(False)  # the next range may go on with it
            yield _batch(out, schema)

    return written(ordered.mapInArrow(step, f"{_CHUNK}, conv_id {kind}"), "conversation-chunks")


def _walk(rows: DataFrame, order: list, step, schema: str) -> DataFrame:
    """Rows of each conversation in order, streamed through one task."""
    return rows.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key", *order).mapInArrow(step, schema)


def _behind(chunks: DataFrame) -> DataFrame:
    """``id``, the prices behind each chunk and whether it is the last of its conversation."""
    schema = pa.schema([("id", pa.int64()), ("behind", pa.list_(pa.int64())), ("last", pa.bool_())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, price = None, END
        for batch in batches:
            rows = {"id": [], "behind": [], "last": []}
            for r in batch.to_pylist():
                last = r["key"] != key
                if last:
                    key, price = r["key"], END
                for name, value in (("id", r["id"]), ("behind", list(price)), ("last", last)):
                    rows[name].append(value)
                d = r["distances"]
                price = tuple(min(NONE, *(d[4 * q + w] + price[w] for w in range(4))) for q in range(4))
            yield batches_of(schema, rows)

    order = [F.desc_nulls_last("turn"), F.desc("digest"), F.desc("id")]
    return written(_walk(chunks.select("key", "turn", "digest", "id", "distances"), order, step, "id long, behind array<long>, last boolean"), "prices-behind")


def _joined(chunks: DataFrame) -> DataFrame:
    """Results of conversations that were cut into chunks."""
    kind = dict(chunks.dtypes)["conv_id"]
    traced_spec = _CHUNK.replace("audit string, ", "").replace("distances array<long>", "audits array<string>, states array<long>, costs array<long>, last boolean")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or _arrow(traced_spec, batch.schema.field("conv_id").type)
            rows = batch.to_pylist()
            for r in rows:
                price = prices(r["codes"], tuple(r["behind"]))
                found = [trace(r["codes"], price, q) for q in range(4)]
                r["audits"], r["states"] = [x and x[0] for x in found], [x and x[1] for x in found]
                r["costs"] = price[:4]
            yield _batch(rows, schema)

    result = f"key string, cost long, audit string, repaired_sha256 string, {_STATS}, conv_id {kind}"

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, now = None, None, None
        for batch in batches:
            schema = schema or _arrow(result.rsplit(", ", 1)[0], batch.schema.field("conv_id").type)
            done = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    key, state, audit, repair = r["key"], START, [], Repair()
                    now = {"conv_id": r["conv_id"], "key": key, "cost": r["costs"][START], "low": None, "turns": 0, "end": None, "high": None, "initial": None, **dict.fromkeys(_COUNTS, 0)}
                edits, after = r["audits"][state], r["states"][state]
                if r["last"]:
                    edits += _TAIL[after]
                repair.walk(edits, r["codes"], r["roles"], r["texts"])
                audit.append(edits)
                state = after
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    now[c] += r[c]
                if r["codes"]:
                    if now["initial"] is not None and (now["initial"], r["initials"][0]) not in _LEGAL:
                        now["illegal"] += 1
                    now["initial"] = r["initials"][-1]
                if r["low"] is not None:
                    now["turns"] += r["turns"] - (r["first_turn"] == now["end"])
                    now["low"] = r["low"] if now["low"] is None else now["low"]
                    now["high"], now["end"] = r["high"], r["last_turn"]
                if r["last"]:
                    gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
                    done.append(now | {"gaps": gaps, "audit": "".join(audit), "repaired_sha256": repair.hash.hexdigest()})
            if done:
                yield _batch(done, schema)

    both = chunks.drop("cost", "audit", "repaired_sha256").join(_behind(chunks), "id")
    both = both.mapInArrow(traced, f"{traced_spec}, conv_id {kind}")
    return _walk(both, [F.asc_nulls_first("turn"), F.asc("digest"), F.asc("id")], finished, result)


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copies): faults, cost, edits, hash of the repaired text."""
    stage = chunked(rows)
    columns = ["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"]
    return stage.filter("whole").select(*columns).unionByName(_joined(stage.filter("NOT whole")).select(*columns))


_ORACLE = r"""
WITH RECURSIVE steps AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
src AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS d FROM conversations CROSS JOIN steps),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) FROM src WHERE d <> 0),
placed AS MATERIALIZED (SELECT conv_id, turn, role, text, left(role, 1) AS h,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS i FROM damaged),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'o' END AS fault,
    coalesce(lag(h) OVER (PARTITION BY conv_id ORDER BY i) || h NOT IN ('su', 'ua', 'au'), false) AS illegal FROM ordered),
ins(q, e, c, q2, p) AS (VALUES (0, '', 0, 0, ''), (1, '', 0, 1, ''), (2, '', 0, 2, ''), (3, '', 0, 3, ''),
    (0, 'I', 2, 2, 'user:' || chr(10)), (1, 'I', 2, 2, 'user:' || chr(10)), (2, 'I', 2, 3, 'assistant:' || chr(10)), (3, 'I', 2, 2, 'user:' || chr(10)),
    (0, 'II', 4, 3, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 'II', 4, 3, 'user:' || chr(10) || 'assistant:' || chr(10)),
    (2, 'II', 4, 2, 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 'II', 4, 3, 'user:' || chr(10) || 'assistant:' || chr(10))),
ops(q, e, c, q2, h) AS (VALUES (0, 'D', 3, 0, ''), (1, 'D', 3, 1, ''), (2, 'D', 3, 2, ''), (3, 'D', 3, 3, ''),
    (0, 'K', 0, 1, 's'), (0, 'K', 0, 2, 'u'), (1, 'K', 0, 2, 'u'), (3, 'K', 0, 2, 'u'), (2, 'K', 0, 3, 'a'),
    (0, 'R', 2, 2, ''), (1, 'R', 2, 2, ''), (3, 'R', 2, 2, ''), (2, 'R', 2, 3, '')),
moves AS MATERIALIZED (SELECT ins.q, ins.e AS pre, ops.e AS e, ins.c + ops.c AS c, ops.q2, h, p FROM ins JOIN ops ON ops.q = ins.q2),
walk(conv_id, i, q, cost, audit, out) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', '' FROM src
    UNION ALL
    SELECT conv_id, i, q2, cost, audit, out FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, q2 ORDER BY cost, audit) AS place FROM (
            SELECT w.conv_id, f.i, m.q2, w.cost + m.c + CASE WHEN m.e <> 'D' AND fault = 't' THEN 1 ELSE 0 END AS cost, w.audit || m.pre || m.e AS audit,
                w.out || m.p || CASE m.e WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10)
                    ELSE CASE m.q2 WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text || chr(10) END AS out
            FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
            JOIN moves m ON m.q = w.q AND (m.h = '' OR m.h = f.h) AND (m.e = 'D' OR fault IN ('t', 'o'))))
    WHERE place = 1),
facts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM f GROUP BY conv_id),
tails AS (SELECT w.conv_id, w.i, w.cost + ins.c AS cost, w.audit || ins.e AS audit, w.out || ins.p AS out FROM walk w JOIN ins ON ins.q = w.q WHERE ins.q2 IN (0, 3)),
ends AS (SELECT t.*, row_number() OVER (PARTITION BY t.conv_id ORDER BY cost, audit) AS place FROM tails t
    LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM t.conv_id WHERE t.i = coalesce(n, 0))
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit,
    sha256(left(out, greatest(length(out) - 1, 0))) AS repaired_sha256
FROM ends e LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM e.conv_id WHERE place = 1
"""


@query("op11_auction_conversation_repair", _ORACLE)
def op11_auction_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation of the table."""
    return repaired(damaged(table(spark, folder, "conversations")))
