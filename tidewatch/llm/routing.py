"""Questions of many documents about hashed keys, answered in groups of keys.

A map task packs its distinct keys into one binary row per group of keys, so Spark shuffles arrays and not
one row per key. A key that many documents share is asked about once per task and shard: tasks merge
their own repeats first, so no group of keys grows with a frequent key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ASK = "part int, kind int, shard int, keys binary, checks binary, values binary"
ANSWER = "shard int, keys binary, values binary"
_ASK = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("values", pa.binary())])
_ANSWER = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])
#: kinds of rows: a question, keys that are known to be shared, an answer that passes through
QUESTION, SHARED, READY = 0, 1, 2


def pack(x: np.ndarray) -> bytes:
    """Integers as their smallest and the differences to it in the narrowest width."""
    if not len(x):
        return b""
    x = x.astype(np.int64)
    low = x.min()
    rest = (x - low).view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(rest.max()) < 1 << (8 * w))
    return low.tobytes() + bytes([width]) + rest.astype(f"<u{width}").tobytes()


def unpack(b: bytes | None) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    return np.frombuffer(b, f"<u{b[8]}", offset=9).astype(np.uint64).view(np.int64) + np.frombuffer(b, np.int64, 1)


def keys_of(b: bytes | None) -> np.ndarray:
    return np.frombuffer(b or b"", np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The group of each key: monotone in the key, so ordered keys have ordered groups."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cuts(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of equal values in ordered groups."""
    if not len(groups):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
    return at, np.append(at[1:], len(groups))


class Rows:
    """Rows of one schema, gathered column by column."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.columns = schema, [[] for _ in schema]

    def add(self, *values) -> None:
        for c, v in zip(self.columns, values, strict=True):
            c.append(v)

    def table(self) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)


def ask(rows: Rows, parts: int, kind: int, keys: np.ndarray, values: np.ndarray | None, checks: np.ndarray | None = None, shard: int = -1) -> None:
    """Add one row per group of ordered keys."""
    groups = part_of(keys, parts)
    for a, b in zip(*cuts(groups), strict=True):
        rows.add(int(groups[a]), kind, shard, keys[a:b].tobytes(), None if checks is None else checks[a:b].tobytes(), None if values is None else pack(values[a:b]))


def asks() -> Rows:
    return Rows(_ASK)


def answers() -> Rows:
    return Rows(_ANSWER)


def answer(rows: Rows, shards: np.ndarray, keys: np.ndarray, values: np.ndarray | None = None) -> None:
    """Add one row per shard."""
    order = np.argsort(shards, kind="stable")
    shards, keys = shards[order], keys[order]
    values = None if values is None else values[order]
    for a, b in zip(*cuts(shards), strict=True):
        rows.add(int(shards[a]), keys[a:b].tobytes(), None if values is None else pack(values[a:b]))
