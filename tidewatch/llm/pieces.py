"""SentencePiece encoding and decoding: sampled segmentations without replacement by Gumbel top-k.

A text is written as the vocabulary writes it (a leading blank, blanks as U+2581) and cut into units, runs of
blanks with what follows; no piece crosses a unit. The lattice of a unit has an edge for every piece of the
vocabulary, and for a character without a piece the edge of its bytes. Merge ranks become weights by the
Zipf-Mandelbrot law, -log(rank + 2.7); a backward pass turns them into probabilities of the next piece, so a path
is drawn exactly in proportion to its weight.

Each path of a document has a Gumbel-perturbed log-probability, and the k largest are k distinct samples without
replacement. They are found by an A-star search in order of the perturbed values, over sets of paths: the
largest value of all paths is drawn for the whole lattice and goes to a sampled path; what is left splits into
the sets that leave this path at one decision, and each set draws its largest value below that bound. The set
with the largest value is opened next. A sample's inclusion score is the probability that its perturbed value
exceeds the largest value left, 1 - exp(-exp(log_prob - kappa)).

Random numbers are hashes of the row key (doc_id), the sample, and the place in the text, so they depend neither
on batches nor on executors. Null and empty texts have one segmentation without pieces; fewer than k segmentations
give fewer samples. A null doc_id is a key of its own. Decoding gives the text back, except that U+2581 in a
text reads as a blank. One pass over whole texts, no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.common import query, table, tokenizer_path

SAMPLES, SHIFT = 2, 2.7
#: bytes of text at once, and characters of a piece that fit the bits of a mask
CHUNK, MOST = 1 << 19, 62
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``first``."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Vocabulary:
    """Piece ids by a hash of their characters, weights, and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        rank = np.minimum(-np.array([model.get_score(i) for i in range(n)]), n)
        self.bytes = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        self.weight = -np.log(rank + SHIFT)
        pieces, named = [], []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[i], self.byte_id[value] = bytes([value]), i
                self.weight[i] = -np.log(n + SHIFT)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace("▁", " ").encode()
                pieces.append(piece)
                named.append(i)
        length = np.array(list(map(len, pieces)), np.int64)
        self.longest = int(length.max())
        if self.longest > MOST:
            raise ValueError(f"a piece has {self.longest} characters; {MOST} at most")
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(length)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(points + np.uint64(1)) * _powers(self.longest)[_spans(np.zeros(len(length), np.int64), length)])])
        hashes = sums[1:] - np.repeat(sums[ends - length], length)
        # hash of the first characters -> id, or -1
        whole = np.zeros(len(points), bool)
        whole[ends - 1] = True
        longer = set(hashes[~whole].tolist())
        prefixes = dict.fromkeys(longer, -1) | dict(zip(hashes[whole].tolist(), named, strict=True))
        bits = max(18, (3 * len(prefixes)).bit_length())
        self.shift, slots = np.uint64(64 - bits), 1 << bits
        self.keys, self.ids, self.longer, used = np.zeros(slots + 1, np.uint64), np.full(slots + 1, -1, np.int32), np.zeros(slots + 1, bool), np.zeros(slots + 1, bool)
        for h, i in prefixes.items():
            at = (h * int(_BASE) % 2**64) >> (64 - bits)
            while used[at]:
                at = (at + 1) % slots
            self.keys[at], self.ids[at], self.longer[at], used[at] = h, i, h in longer, True
        self.slots, self.used = slots, used

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hashed prefix in the table; that of none is the last, which holds no piece."""
        at = ((hashes * _BASE) >> self.shift).astype(np.int64)
        hit = self.keys[at] == hashes
        out = np.where(hit & self.used[at], at, self.slots)
        open_ = np.flatnonzero(~hit & self.used[at])
        while len(open_):
            at[open_] = (at[open_] + 1) % self.slots
            here = at[open_]
            hit, used = self.keys[here] == hashes[open_], self.used[here]
            out[open_[hit & used]] = here[hit & used]
            open_ = open_[~hit & used]
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


class Lattice:
    """Edges and next-piece probabilities of many units. A unit of n characters has n + 1 slots; the edges of a slot
    stand side by side, shorter ones first, and slots stand by the characters left to the end of their units."""

    def __init__(self, units: pa.Array, v: Vocabulary):
        length = pc.utf8_length(units).to_numpy().astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(length + 1)])
        data, offsets = W.flat(units)
        points = np.frombuffer(np.insert(data, offsets[1:], 0).tobytes().decode().encode("utf-32-le"), np.uint32)
        self.points = np.where(points == 0x20, np.uint32(0x2581), points)
        n = len(points)
        self.end = np.repeat(self.start[1:] - 1, length + 1)
        left = self.end - np.arange(n)
        mixed, power = W.mix(self.points.astype(np.uint64) + np.uint64(1)), _powers(v.longest)
        live = np.flatnonzero(left)
        h = np.zeros(len(live), np.uint64)
        self.degree = np.zeros(n, np.int64)
        found = []
        for k in range(v.longest):  # on from the prefixes of longer pieces only
            h += mixed[live + k] * power[k]
            place = v.find(h)
            ids = v.ids[place]
            if not k:
                ids[ids < 0] = -2  # its bytes
            good = np.flatnonzero(ids != -1)
            at = live[good]
            found.append((at, self.degree[at], ids[good]))
            self.degree[at] += 1
            on = np.flatnonzero(v.longer[place] & (left[live] > k + 1))
            if not len(on):
                break
            live, h = live[on], h[on]
        order = np.argsort(left, kind="stable")
        cut = np.searchsorted(left[order], np.arange(left.max() + 2))
        degree = self.degree[order]
        bound = np.concatenate([[0], np.cumsum(degree)])
        self.first = np.empty(n, np.int64)
        self.first[order] = bound[:-1]
        self.piece, self.next = np.empty(bound[-1], np.int32), np.empty(bound[-1], np.int64)
        self.slot = np.repeat(order, degree)
        for k, (at, rank, ids) in enumerate(found):
            edge = self.first[at] + rank
            self.piece[edge], self.next[edge] = ids, at + k + 1
        score = v.weight[self.piece]
        lone = np.flatnonzero(self.piece < 0)
        code = self.points[self.next[lone] - 1]
        score[lone] = (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)) * v.weight[v.byte_id[0]]
        back = np.zeros(n)
        for r in range(1, len(cut) - 1):
            lo, hi = cut[r], cut[r + 1]
            a, z = bound[lo], bound[hi]
            s = score[a:z]
            s += back[self.next[a:z]]
            top = np.maximum.reduceat(s, bound[lo:hi] - a)
            top += np.log(np.add.reduceat(np.exp(s - np.repeat(top, degree[lo:hi])), bound[lo:hi] - a))
            back[order[lo:hi]] = top
            s -= np.repeat(top, degree[lo:hi])
        self.log_p, self.p = score, np.exp(score)

    def draw(self, slots: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge drawn at each slot."""
        edge = self.first[slots]
        last, rest = edge + self.degree[slots] - 1, u - self.p[edge]
        live = np.flatnonzero((rest > 0) & (edge < last))
        while len(live):
            now = edge[live] + 1
            over = rest[live] - self.p[now]
            edge[live], rest[live] = now, over
            live = live[(over > 0) & (now < last[live])]
        return edge

    def others(self, slots: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities of the edges of each slot without those of the mask, a row a slot."""
        rank = np.arange(max(1, self.degree[slots].max(initial=1)))
        open_ = (rank < self.degree[slots][:, None]) & ((mask[:, None] >> rank) & 1 == 0)
        return np.where(open_, self.p[np.where(open_, self.first[slots][:, None] + rank, 0)], 0.0)


def _hashed(key: np.ndarray, *parts) -> np.ndarray:
    """Hashes that depend on the row key and a place."""
    for p in parts:
        key = W.mix(key + np.asarray(p).astype(np.uint64) * _BASE + np.uint64(0x27D4EB2F))
    return key


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row key and a place."""
    return ((_hashed(key, *parts) >> np.uint64(11)).astype(float) + 0.5) / 2**53


def _below(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at a location, given that they are below a bound."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.log(np.exp(np.minimum(location - bound, 700)) - np.log(u)))


def _walk(lat: Lattice, slot: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw pieces from each slot to the end of its unit: the edges, those of a slot in a row, and how many each has."""
    out, end, step = [], lat.end[slot], 0
    live, count = np.flatnonzero(slot < end), np.zeros(len(slot), np.int64)
    here, key, end = slot[live], key[live], end[live]
    while len(live):
        edge = lat.draw(here, _uniform(key, step))
        out.append((live, edge))
        count[live] += 1
        here, step = lat.next[edge], step + 1
        on = np.flatnonzero(here < end)
        live, here, key, end = live[on], here[on], key[on], end[on]
    first = np.cumsum(count) - count
    edges = np.empty(int(count.sum()), np.int64)
    for k, (rows, edge) in enumerate(out):
        edges[first[rows] + k] = edge
    return edges, count


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units, the place of every unit among them, and the first unit of each text (one more than texts)."""
    data, offsets = W.flat(pc.replace_substring(texts, "▁", " "))
    size = np.diff(offsets)
    data = np.insert(data, offsets[:-1][size > 0], 0x20)
    offsets = np.concatenate([[0], np.cumsum(size + (size > 0))])
    blank = data == 0x20
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[offsets[:-1][size > 0]] = True
    at = np.flatnonzero(begins)
    units = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
    return units.dictionary, units.indices.to_numpy().astype(np.int64), np.searchsorted(at, offsets)


def sampled(texts: list[str] | pa.Array, keys: np.ndarray, v: Vocabulary, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to k samples in order of their perturbed values: ids, log_prob, perturbed value, inclusion score."""
    n = len(texts)
    units, which, first = _units(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    count = np.diff(first)
    if not len(which):
        return [[(np.zeros(0, np.int64), 0.0, 0.0, 1.0)] for _ in range(n)]
    lat = Lattice(units, v)
    begin = lat.start[which]
    doc = np.repeat(np.arange(n), count)
    unit = np.arange(len(which)) - first[doc]
    bound = -np.log(-np.log(_uniform(keys, 0)))  # the largest perturbed value: the lattice has mass one
    paths: list[dict] = []
    regions = {name: np.zeros(0, t) for name, t in (("doc", int), ("path", int), ("at", int), ("value", float), ("mask", int))}
    alive = count > 0
    for s in range(k):
        if s:  # open the region with the largest value of each document
            best = np.full(n, -np.inf)
            np.maximum.at(best, regions["doc"], regions["value"])
            head = np.flatnonzero(regions["value"] == best[regions["doc"]])
            head = head[np.unique(regions["doc"][head], return_index=True)[1]]
            if not len(head):
                break
            opened = {name: x[head] for name, x in regions.items()}
            rest = np.ones(len(regions["doc"]), bool)
            rest[head] = False
            regions = {name: x[rest] for name, x in regions.items()}
            docs, mask = opened["doc"], opened["mask"]
            alive = np.zeros(n, bool)
            alive[docs] = True
            bound = np.full(n, -np.inf)
            bound[docs] = opened["value"]
        leaves, mask_at, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not s:
            edge, drawn = _walk(lat, begin, _hashed(keys[doc], 0, unit))
            row = np.repeat(np.arange(len(which)), drawn)
            starts = np.concatenate([[0], np.cumsum(np.bincount(doc, drawn, n).astype(np.int64))])
        else:
            turn, turn_unit = np.empty(len(docs), np.int64), np.empty(len(docs), np.int64)
            for p in np.unique(opened["path"]):
                mine = opened["path"] == p
                turn[mine], turn_unit[mine] = paths[p]["edge"][opened["at"][mine]], paths[p]["unit"][opened["at"][mine]]
                leaves[docs[mine]] = opened["at"][mine] - paths[p]["starts"][docs[mine]]
            # another piece at the turn, then free draws to the end of the text
            slot = lat.slot[turn]
            total = np.cumsum(lat.others(slot, mask), axis=1)
            u = _uniform(keys[docs], 1000 + s, 1)
            turn = lat.first[slot] + np.minimum((total <= (u * total[:, -1])[:, None]).sum(1), lat.degree[slot] - 1)
            mask_at[docs] = mask
            last = np.full(n, len(which), np.int64)
            last[docs] = turn_unit
            free = np.flatnonzero(np.arange(len(which)) >= last[doc])
            begins = begin[free]
            begins[np.searchsorted(free, turn_unit)] = lat.next[turn]
            tail, drawn = _walk(lat, begins, _hashed(keys[doc[free]], s, unit[free]))
            tails = np.bincount(doc[free], drawn, n).astype(np.int64)[docs]
            size[docs] = leaves[docs] + 1 + tails
            starts = np.concatenate([[0], np.cumsum(size)])
            edge, row = np.empty(starts[-1], np.int64), np.empty(starts[-1], np.int64)
            for p in np.unique(opened["path"]):
                mine = docs[opened["path"] == p]
                to, of = _spans(starts[mine], leaves[mine]), _spans(paths[p]["starts"][mine], leaves[mine])
                edge[to], row[to] = paths[p]["edge"][of], paths[p]["unit"][of]
            to = starts[docs] + leaves[docs]
            edge[to], row[to] = turn, turn_unit
            to = _spans(to + 1, tails)
            edge[to], row[to] = tail, np.repeat(free, drawn)
        path = {"doc": doc[row], "unit": row, "edge": edge, "log_p": lat.log_p[edge]}
        d = path["doc"]
        run = np.concatenate([[0], np.cumsum(path["log_p"])])
        before = run[:-1] - run[starts[d]]
        path["starts"], path["total"], path["value"], path["alive"] = starts, run[starts[1:]] - run[starts[:-1]], bound, alive
        # what is left of the opened set: it leaves the new path at the turn or later
        place = np.arange(len(d)) - starts[d]
        late = np.flatnonzero(place >= leaves[d])
        at_turn = place[late] == leaves[d[late]]
        slot = lat.slot[edge[late]]
        mask = np.where(at_turn, mask_at[d[late]], 0) | (1 << (edge[late] - lat.first[slot]))
        rest = -np.expm1(path["log_p"][late])
        turned = np.flatnonzero(at_turn & (mask_at[d[late]] > 0))
        rest[turned] = lat.others(slot[turned], mask[turned]).sum(1)
        with np.errstate(divide="ignore"):
            location = before[late] + np.log(np.where(rest > 1e-12, rest, 0))
        value = _below(location, bound[d[late]], _uniform(_hashed(keys, 2000 + s)[d[late]], place[late]))
        new = {"doc": d[late], "path": np.full(len(late), s), "at": late, "value": value, "mask": mask}
        good = ~np.isneginf(value)
        regions = {name: np.concatenate([x, new[name][good]]) for name, x in regions.items()}
        paths.append(path)
    kappa = np.full(n, -np.inf)
    np.maximum.at(kappa, regions["doc"], regions["value"])
    out: list[list] = [[] if c else [(np.zeros(0, np.int64), 0.0, 0.0, 1.0)] for c in count]
    for path in paths:
        ids = lat.piece[path["edge"]].astype(np.int64)
        for i in np.flatnonzero(path["alive"]):
            lo, hi = path["starts"][i], path["starts"][i + 1]
            mine = ids[lo:hi]
            if (mine < 0).any():
                at, parts, done = np.flatnonzero(mine < 0), [], 0
                for j, s in zip(at, lat.next[path["edge"][lo + at]] - 1, strict=True):
                    parts += [mine[done:j], v.byte_id[list(chr(lat.points[s]).encode())]]
                    done = j + 1
                mine = np.concatenate([*parts, mine[done:]])
            phi = float(path["total"][i])
            out[i].append((mine, phi, float(path["value"][i]), float(-np.expm1(-np.exp(min(phi - kappa[i], 700.0)))) if np.isfinite(kappa[i]) else 1.0))
    return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def encoded(documents: DataFrame, model: str, columns: list[str], k: int = SAMPLES, with_ids: bool = True) -> DataFrame:
    """Per document and sample: the chosen columns, sample (from 1), n_ids, ids_crc32, log_prob, perturbed, inclusion
    and round_trip; and ids, if asked for."""
    names = [f"c{i}" for i in range(len(columns))]
    rows = documents.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names]
    extra = ["sample", "n_ids", "ids_crc32", "log_prob", "perturbed", "inclusion", "round_trip", *(["ids"] if with_ids else [])]
    schema = ", ".join([*kinds, "sample int, n_ids long, ids_crc32 long, log_prob double, perturbed double, inclusion double, round_trip boolean", *(["ids array<int>"] if with_ids else [])])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _VOCABULARIES:
            _VOCABULARIES[model] = Vocabulary(model)
        v = _VOCABULARIES[model]
        for batch in batches:
            _, offsets = W.flat(batch["text"])
            for lo, hi in W.chunks(offsets, CHUNK):
                texts = batch["text"].slice(lo, hi - lo).to_pylist()
                keys = W.mix(batch["id"].slice(lo, hi - lo).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(0xB5AD4ECEDA1CE2A9))
                found = sampled(batch["text"].slice(lo, hi - lo), keys, v, k)
                row = [i for i, x in enumerate(found) for _ in x]
                flat = [(s, *x) for xs in found for s, x in enumerate(xs, 1)]
                ids = [x[1] for x in flat]
                columns_out = [*(batch[c].slice(lo, hi - lo).take(pa.array(row, pa.int64())) for c in names), pa.array([x[0] for x in flat], pa.int32()), pa.array(list(map(len, ids)), pa.int64())]
                columns_out.append(pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))
                columns_out += [pa.array([x[j] for x in flat], pa.float64()) for j in (2, 3, 4)]
                columns_out.append(pa.array([v.decode(x) == texts[i].replace("▁", " ") for i, x in zip(row, ids, strict=True)], pa.bool_()))
                if with_ids:
                    sizes = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int32)
                    columns_out.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns_out, [*names, *extra])

    return rows.mapInArrow(step, schema).select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), *extra)


@query("op9_gumbel_top_k_pieces")
def op9_gumbel_top_k_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of every document of the table, with the crc32 of their ids."""
    return encoded(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"], with_ids=False)
