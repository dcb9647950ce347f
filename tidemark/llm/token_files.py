"""Token ids in Simple-8b word-aligned files.

A file is a Parquet part of blocks in ascending doc_id order; a block's payload holds the ids of whole documents as
64-bit words of Simple-8b behind a header with the documents, their lengths, and offsets to decode ranges.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh_path, table

#: Ids and bits of each by selector. Selector 0 is a run of zeros; 1 is the escape, an id of over 60
#: bits, whose words stand after the packed ones in order.
SELECTORS = [(240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 1
BLOCK_IDS = 1 << 16
OFFSET_EVERY = 512
MAGIC = b"TMS8"
_HEADER = struct.Struct("<4sIQQQ")


def widths(ids: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned 64-bit integers."""
    high = ids >> np.uint64(32)
    if not high.any():
        return np.frexp(ids.astype(np.float64))[1]
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escaped ids and, for each OFFSET_EVERYth word, the number of ids before it."""
    n = len(ids)
    ids = np.asarray(ids, dtype=np.uint64)
    width = widths(ids)
    choice = np.full(n, ESCAPE, dtype=np.int64)
    largest = int(width.max(initial=0))
    for sel in range(len(SELECTORS) - 1, -1, -1):  # from the fewest ids a word to the most
        count, bits = SELECTORS[sel]
        if sel == ESCAPE:
            continue
        if largest <= bits:
            choice[:] = sel
            continue
        over = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(width > bits, out=over[1:])
        fits = over[np.minimum(np.arange(n) + count, n)] == over[:-1]
        if not fits.any():
            if sel > ESCAPE:
                continue
            break
        choice[fits] = sel
    step = np.array([c for c, _ in SELECTORS])[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, dtype=np.int64)
    picked = choice[starts] if n else choice
    padded = np.concatenate([ids, np.zeros(240, dtype=np.uint64)])
    words = picked.astype(np.uint64) << np.uint64(60)
    for sel in np.unique(picked):
        count, bits = SELECTORS[sel]
        if sel > ESCAPE:
            at = np.flatnonzero(picked == sel)
            part = padded[starts[at][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[at] |= np.bitwise_or.reduce(part, axis=1)
    return words, ids[starts[picked == ESCAPE]], starts[::OFFSET_EVERY]


def unpack(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the words."""
    picked = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[picked]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for sel in np.unique(picked):
        count, bits = SELECTORS[sel]
        at = starts[picked == sel]
        if sel == ESCAPE:
            out[at] = escaped[: len(at)]
        elif bits:
            part = (words[picked == sel][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            out[at[:, None] + np.arange(count)] = part
    return out[:n]


def write_block(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    words, escaped, offsets = pack(ids)
    head = _HEADER.pack(MAGIC, len(doc_ids), len(ids), len(words), len(escaped))
    missing = [i is None for i in doc_ids]
    arrays = [(np.array([0 if i is None else i for i in doc_ids]), "<i8"), (np.array(missing), "<u1"), (np.array(lengths), "<u8"), (offsets, "<u8"), (words, "<u8"), (escaped, "<u8")]
    return head + b"".join(np.asarray(a).astype(kind).tobytes() for a, kind in arrays)


def open_block(payload: bytes) -> dict:
    """The arrays of a block: docs, missing (1: the id is null), lengths, offsets, words, escaped; and n_ids."""
    magic, n_docs, n_ids, n_words, n_escaped = _HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at, out = _HEADER.size, {"n_ids": n_ids}
    for name, count, kind in (("docs", n_docs, "<i8"), ("missing", n_docs, "<u1"), ("lengths", n_docs, "<u8"), ("offsets", -(-n_words // OFFSET_EVERY), "<u8"), ("words", n_words, "<u8"), ("escaped", n_escaped, "<u8")):
        out[name] = np.frombuffer(payload, kind, count, at)
        at += out[name].nbytes
    return out


def read_range(payload: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a block; only the words between the offsets around them are decoded."""
    b = open_block(payload)
    stop = min(stop, b["n_ids"])
    if start >= stop:
        return np.zeros(0, dtype=np.uint64)
    first = int(np.searchsorted(b["offsets"], start, "right")) - 1
    last = int(np.searchsorted(b["offsets"], stop, "left"))
    words = b["words"][first * OFFSET_EVERY : last * OFFSET_EVERY]
    skipped = int(((b["words"][: first * OFFSET_EVERY] >> np.uint64(60)) == ESCAPE).sum())
    base = int(b["offsets"][first])
    end = int(b["offsets"][last]) if last < len(b["offsets"]) else b["n_ids"]
    return unpack(words, b["escaped"][skipped:], end - base)[start - base : stop - base]


#: Distinct pieces whose ids a Python worker holds at most; beyond it, it starts anew.
PIECES = 600_000
#: What a tokenizer file must say for its pieces to be split here, by the same pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_LATIN = [chr(c) for c in range(0x250)]
_class = lambda kind: "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == kind)
#: Texts of these characters alone normalise to their lower case; the four signs that only Python takes for blanks are out.
_PLAIN = re.compile("[\x00-\x1b\x20-\u017f]*")
_PIECE = re.compile(SPLIT.replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N")))
_BLANK = re.compile("[ \n\t\r]+")
#: The signs that stand for bytes in the vocabulary: visible Latin-1 characters for themselves, the rest from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SIGNS = dict(zip(sorted(range(256), key=lambda b: b not in _VISIBLE), map(chr, [*sorted(_VISIBLE), *range(256, 256 + 256 - len(_VISIBLE))]), strict=True))


class PieceIds(dict):
    """Ids, as little-endian unsigned 32-bit integers, of normalised pieces: each distinct one goes through the library's
    model once. Texts of Latin characters are lower-cased and split here as the library would; in others every chunk
    between blanks with a further character, and whole texts with a special token's string, go to the library."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.chunks = _Chunks(self)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        told = json.loads(spec)
        self.special = [x["content"] for x in told["added_tokens"]]
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers") or []]
        self.known = kinds == NORMALIZERS and steps[0].get("pattern") == {"Regex": SPLIT} and [x.get("type") for x in steps] == ["Split", "ByteLevel"]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isprintable() else "".join(map(_SIGNS.__getitem__, piece.encode()))
        ids = self[piece] = struct.pack(f"<{len(found := self.model.tokenize(mapped))}I", *[t.id for t in found])
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.known or any(x in text for x in self.special):
            return self._library(text)
        for held in (self, self.chunks):
            if len(held) > PIECES:
                held.clear()
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.chunks.__getitem__, text.split()))
        return b"".join(b"".join(map(self.chunks.__getitem__, c.split())) if _PLAIN.fullmatch(c) else self._library(c) for c in _BLANK.split(text))


class _Chunks(dict):
    """Ids of what stands between blanks, in plain texts: its pieces' in turn."""

    def __init__(self, pieces: PieceIds):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = b"".join(map(self.pieces.__getitem__, _PIECE.findall(chunk.lower())))
        return ids


@functools.lru_cache(maxsize=1)
def _coder(spec: str) -> PieceIds:
    """One table for all tasks of a worker."""
    return PieceIds(spec)


def _written(spec, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        coder, part = _coder(spec.value), TaskContext.get().partitionId()
        docs, lengths, held, size, block, before = [], [], [], 0, 0, 0

        def row():
            payload = write_block(docs, lengths, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["part", "block", "before", "n_ids", "payload"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = coder.ids(text.as_py()) + end
                docs.append(doc)
                lengths.append(len(raw) // 4)
                held.append(raw)
                size += len(raw) // 4
                if size >= BLOCK_IDS:
                    yield row()
                    docs, lengths, held, block, before, size = [], [], [], block + 1, before + size, 0
        if docs:
            yield row()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1) -> None:
    """Encode every text of docs (doc_id, text), end_id after each, into the files of path.

    Parts are ranges of doc_id, in order; a null doc_id comes first and rows that repeat one stand by their text. Null
    texts are empty ones: the end id alone. One shuffle deals the texts by range; a worker holds one block at a time.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    parts = max(1, docs.rdd.getNumPartitions())
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_written(spec, end_id), "part int, block int, before long, n_ids long, payload binary").write.option("compression", "uncompressed").parquet(path)


def _read(bases):
    def run(batches):
        for batch in batches:
            out = []
            for part, before, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = open_block(payload.as_py())
                ids = unpack(b["words"], b["escaped"], b["n_ids"]).astype("<u4")
                lengths = b["lengths"].astype(np.int64)
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                first = bases.value[part] + before
                out.append(pa.RecordBatch.from_arrays([pa.array(b["docs"], pa.int64(), mask=b["missing"].astype(bool)), pa.array(ends - lengths + first), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]))
            yield from out

    return run


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files of path, decoded from them. What goes to the
    driver is one count for each file."""
    blocks = spark.read.schema("part int, block int, before long, n_ids long, payload binary").parquet(path)
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = {}, 0
    for part, n in sizes:
        bases[part], total = total, total + n
    return blocks.select("part", "before", "payload").mapInArrow(_read(spark.sparkContext.broadcast(bases)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = fresh_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), path)
    return read_tokens(spark, path)
