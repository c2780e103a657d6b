"""Token-id files with Elias-Fano document boundaries.

Documents are encoded in ascending doc_id order, range-partitioned, each with an end id. A file holds blocks of
about a million ids: the concatenated ids at 16 bits (32 for larger vocabularies), and two Elias-Fano sequences,
the end of each document in the block and the doc_ids. A sequence of n values up to U keeps the low
floor(log2(U / n)) bits of each value packed, and the high parts as a bit vector in which value i sets bit
(v >> l) + i: about 2 + log2(U / n) bits a value, against 64 in a table. Sampled positions of every 256th set bit
let :func:`select` find one offset without reading the rest.

The container is a folder of Parquet files with binary columns, so it can lie in any store that Spark writes to.

Null texts are empty and have the end id alone. Null doc_ids come first. Rows that repeat a doc_id follow each
other in the order of their texts' hashes and then of their texts. The empty table makes no block and reads back as
no row.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import words as W
from tidewatch.llm.common import groups_for, query, table, tokenizer_path
from tidewatch.session import fresh_path

BLOCK_IDS, SAMPLE = 1 << 20, 256
#: bytes of the stored table per partition, bytes of text encoded at once, entries of a worker's cache of encoded pieces, and words in a call's line
PARTITION_BYTES, CHUNK_BYTES, CACHE_ENTRIES, LINE = 12 << 20, 8 << 20, 1_200_000, 64
#: marks that end a piece; after a letter or digit they are split off before anything is merged
_MARKS = ".,;:!?*&%$#"

#: blanks and line breaks; bytes of pieces that are cut before the library sees them, by kind (0: the piece stays whole)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[ord("'"), ord("<")]] = 0
_LOWER = W.KINDS["lower"][1]
#: normaliser and splitter for which pieces may be cut so
_NORMALIZER = str({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]})
_SPLITTER = str(
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }
)

_LIST = "low_bits int, low binary, high binary, samples binary"
SCHEMA = "shard int, block int, before long, n_docs long, n_ids long, id_bytes int, ids binary, n_null long, first_id long, " + ", ".join(f"{p}_{c}" for p in ("end", "doc") for c in _LIST.split(", "))


def elias_fano(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Low bits, packed low parts, high bit vector and select samples of non-decreasing values from 0 on."""
    n = len(values)
    if not n:
        return 0, b"", b"", b""
    values = values.astype(np.uint64)
    low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
    shifts = np.arange(low_bits, dtype=np.uint64)
    low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel())
    spot = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(spot[-1]) + 1, np.uint8)
    high[spot] = 1
    return low_bits, low.tobytes(), np.packbits(high).tobytes(), spot[::SAMPLE].astype("<u4").tobytes()


def _low(low_bits: int, low: bytes, first: int, count: int) -> np.ndarray:
    if not low_bits:
        return np.zeros(count, np.int64)
    lo, hi = first * low_bits, (first + count) * low_bits
    bits = np.unpackbits(np.frombuffer(low, np.uint8, -(-hi // 8) - lo // 8, lo // 8))[lo % 8 :][: hi - lo]
    return bits.reshape(count, low_bits).astype(np.int64) @ (np.int64(1) << np.arange(low_bits, dtype=np.int64))


def decoded(n: int, low_bits: int, low: bytes, high: bytes) -> np.ndarray:
    """All values."""
    spot = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[:n]
    return ((spot - np.arange(n)) << low_bits) + _low(low_bits, low, 0, n)


def select(i: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> int:
    """Value i: from the sample before it, the bit vector is scanned for the set bits between."""
    spot, left = int(np.frombuffer(samples, "<u4", 1, i // SAMPLE * 4)[0]), i % SAMPLE
    byte, step = spot // 8, 64
    skip = spot % 8
    while True:
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8, min(step, len(high) - byte), byte))[skip:])
        if left < len(bits):
            return ((byte * 8 + skip + int(bits[left]) - i) << low_bits) + int(_low(low_bits, low, i, 1)[0])
        left, byte, skip = left - len(bits), byte + step, 0


class WordCache:
    """Encodes many texts by their pieces between blanks and line breaks; each new piece goes to the library once.

    Where normaliser and splitter are the known ones, they never join text over white space, so the ids of a text are
    those of its pieces in order; ASCII pieces are lower-cased and cut where the splitter cuts them. Any other
    vocabulary gets whole texts. A full cache keeps the pieces that were met again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        said = json.loads(self.tokenizer.to_str())
        known_kind = str(said["normalizer"]) == _NORMALIZER and str(said["pre_tokenizer"]) == _SPLITTER and said["model"].get("end_of_word_suffix") == "</w>"
        self.cuts = known_kind and all("<" in t["content"] and not re.search(r"\s", t["content"]) for t in said["added_tokens"])
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        """No piece: piece -> place, and per place the first id, the number of ids and the chunks that met it."""
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, f"<u{self.width}")
        self.first, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def parts(piece: str) -> tuple[str, ...]:
        """Texts that the vocabulary's splitter and lower-casing treat as this piece, which more pieces share."""
        core = piece.rstrip(_MARKS)
        # the last character as the normaliser leaves it: a mark of its own would join what follows
        if "'" in piece or "<" in piece or not core or not unicodedata.normalize("NFC", core[-1]).lower()[-1].isalnum():
            return (piece,)
        low = core.lower() if core.isascii() else core
        return (low, piece[len(core) :]) if len(core) < len(piece) else (low,)

    def _of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and how many each has."""
        size = self.size[places]
        before = np.cumsum(size) - size
        return self.ids[np.repeat(self.first[places] - before, size) + np.arange(size.sum())], size

    def _put(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size, self.met = np.concatenate([self.size, sizes]), np.concatenate([self.met, np.zeros(len(sizes), np.int64)])
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row from the library, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array(list(map(len, ids)), np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes

    def _learn(self, pieces: list[str]) -> None:
        split = {p: self.parts(p) for p in pieces if not p.isascii()}  # the others are cut already
        whole = dict.fromkeys(p for p in pieces if p not in split) | dict.fromkeys(x for parts in split.values() for x in parts if x not in self.known)
        letters, single = [x for x in whole if x.isalpha()], [x for x in whole if not x.isalpha()]
        # words of letters go to the library by lines: each is cut once at least, so as many closing ids as words mean one a word
        lines = [letters[i : i + LINE] for i in range(0, len(letters), LINE)]
        ids, sizes = self._library([" ".join(x) for x in lines])
        closes, line = self.closing[ids], np.repeat(np.arange(len(lines)), sizes)
        good = np.bincount(line[closes], minlength=len(lines)) == list(map(len, lines))
        ids, closes = ids[good[line]], closes[good[line]]
        self._put(list(chain.from_iterable(compress(lines, good))), ids, np.diff(np.flatnonzero(closes) + 1, prepend=0))
        single += chain.from_iterable(compress(lines, ~good))
        self._put(single, *self._library(single))
        more = {p: parts for p, parts in split.items() if p not in self.known}
        if more:
            ids, sizes = self._of(np.array([self.known[x] for parts in more.values() for x in parts], np.int64))
            self._put(list(more), ids, np.add.reduceat(sizes, np.cumsum([0, *map(len, more.values())])[:-1]))

    def _forget(self) -> None:
        """Keep the pieces that more than one chunk met, if they are at most half of what fits."""
        again, names = self.met > 1, list(self.known)
        places = np.flatnonzero(again)
        ids, sizes = self._of(places)
        self._empty()
        if len(places) <= CACHE_ENTRIES // 2:
            self._put([names[i] for i in places.tolist()], ids, sizes)

    def _places(self, pieces: list[str]) -> np.ndarray:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + 2 * len(new) > CACHE_ENTRIES:
            self._forget()
            new = [p for p in pieces if p not in self.known]
        if new:
            self._learn(new)
        places = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.met[places] += 1
        return places

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; null counts as empty."""
        if not self.cuts:
            return self._library([t or "" for t in texts.to_pylist()])
        data, offsets = W.flat(texts)
        inside = ~_BLANK[data]
        rows = offsets - np.searchsorted(np.flatnonzero(~inside), offsets)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        data, begins = data[inside], begins[inside]
        if not len(data):
            return self.ids[:0], np.zeros(len(offsets) - 1, np.int64)
        begins[rows[rows < len(data)]] = True
        at, kind = np.flatnonzero(begins), _KIND[data]
        plain = np.repeat(np.minimum.reduceat(kind, at) > 0, np.diff(at, append=len(data)))
        begins[1:] |= plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        data = np.where(plain, _LOWER[data], data)
        at = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        ids, sizes = self._of(self._places(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()])
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(at, rows)])

    def encode(self, text: str) -> bytes:
        """Ids of one text, as its file holds them."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype(f"<u{self.width}").tobytes()


_CACHES: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def _packed(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    cache, shard = _cache(path), TaskContext.get().partitionId()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    before = block = filled = 0
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    docs: list[int | None] = []

    def row() -> pa.RecordBatch:
        ends = np.cumsum(np.concatenate(sizes))
        full = [d for d in docs if d is not None]
        first = full[0] if full else 0
        raw = np.concatenate(ids).astype(f"<u{cache.width}").tobytes()
        values = [shard, block, before, len(docs), int(ends[-1]), cache.width, raw, len(docs) - len(full), first, *elias_fano(ends), *elias_fano(np.array(full, np.int64) - first)]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds[c.split()[1]]) for v, c in zip(values, SCHEMA.split(", "), strict=True)], names)

    for batch in batches:
        names_of = batch["doc_id"].to_pylist()
        for lo, hi in W.chunks(W.flat(batch["text"])[1], CHUNK_BYTES):
            found, counts = cache.encode_all(batch["text"].slice(lo, hi - lo))
            ends = np.cumsum(counts)
            found = np.insert(found, ends, end_id)
            counts, ends = counts + 1, np.concatenate([[0], ends + np.arange(1, hi - lo + 1)])
            done = 0
            while done < hi - lo:  # a block ends with the document that fills it
                full = int(np.searchsorted(ends[1:], ends[done] + BLOCK_IDS - filled))
                stop = min(full + 1, hi - lo)
                ids.append(found[ends[done] : ends[stop]])
                sizes.append(counts[done:stop])
                docs += names_of[lo + done : lo + stop]
                filled += int(ends[stop] - ends[done])
                done = stop
                if filled >= BLOCK_IDS:
                    yield row()
                    before, block, filled, ids, sizes, docs = before + filled, block + 1, 0, [], [], []
    if docs:
        yield row()


def ordered(documents: DataFrame, parts: int) -> DataFrame:
    """doc_id and text in order of doc_id, hash of the text and text, over ranges of the first two.

    Spark samples the keys of the ranges to the driver, so whole texts are none of them.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = F.xxhash64("text")
    return rows.repartitionByRange(parts, "doc_id", hashed).sortWithinPartitions("doc_id", hashed, "text")


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode the whole texts in ascending doc_id order and write the files."""
    rows = ordered(documents, groups_for(documents, PARTITION_BYTES))
    rows.mapInArrow(lambda it: _packed(it, tokenizer, end_id), SCHEMA).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32."""
    blocks = spark.read.parquet(folder)
    # one row per partition of the writer, like the bounds of a range partitioning
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    starts = np.concatenate([[0], np.cumsum([totals.get(s, 0) for s in range(max(totals, default=0) + 1)])])
    shared = spark.sparkContext.broadcast(starts)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                n, ends = b["n_docs"], decoded(b["n_docs"], b["end_low_bits"], b["end_low"], b["end_high"])
                begins = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(b["ids"], f"<u{b['id_bytes']}").astype("<u4")
                docs = decoded(n - b["n_null"], b["doc_low_bits"], b["doc_low"], b["doc_high"]) + b["first_id"]
                sums = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * b["n_null"] + docs.tolist(), pa.int64()), pa.array(begins + b["before"] + shared.value[b["shard"]]), pa.array(ends - begins), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op3_elias_fano_token_files")
def op3_elias_fano_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every document, write the files and read them back."""
    out = fresh_path(spark, "token-files")
    write(table(spark, folder, "documents"), out, tokenizer_path("word_bpe_49k.json"))
    return read(spark, out)
