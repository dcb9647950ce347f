"""Byte-level BPE by monoid tree reduction.

A text's encoding is folded over a balanced tree. Leaves are encoded on their own; two neighbours are joined by
re-encoding a window around their boundary, grown outward to the nearest cut on either side beyond which no token can
change. A cut is a place where a space or line feed follows a character that isn't white space: no match of the
splitting pattern holds white space after anything else, and it never looks back, so that matches on both sides of a
cut are those of either side alone, whatever stands beyond. Decoding concatenates the bytes of halves up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import table

LEAF_CHARS = 2048
LEAF_IDS = 1024
SEEDS = 32  # characters of the first window on either side


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in blob.splitlines() if x)}


class MonoidBPE:
    """encode and decode of whole texts; pattern and ranks are those of the tokenizer.

    Cuts are proven for the pattern of public_tokenizers; with any other, a text is one leaf.
    """

    def __init__(self, ranks: bytes, pattern: str, leaf_chars: int = LEAF_CHARS):
        import public_tokenizers
        import tiktoken

        self.leaf = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})
        self.leaf_chars = leaf_chars if pattern == public_tokenizers.PATTERN else sys.maxsize

    @staticmethod
    def _cut_before(text: str, at: int, low: int) -> int:
        """The last cut in text[low:at], low if there is none; the window grows twofold until it holds one."""
        size = SEEDS
        while True:
            start = max(low, at - size)
            end = at
            while (p := max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end))) > start:
                if not text[p - 1].isspace():
                    return p
                end = p
            if start == low:
                return low
            size *= 2

    @staticmethod
    def _cut_after(text: str, at: int, high: int) -> int:
        """The first cut in text[at + 1:high], high if there is none; the window grows twofold until it holds one."""
        size = SEEDS
        while True:
            end, p = min(high, at + size), at
            while True:
                a, b = text.find(" ", p + 1, end), text.find("\n", p + 1, end)
                p = a if b < 0 or 0 <= a < b else b
                if p < 0:
                    break
                if not text[p - 1].isspace():
                    return p
            if end == high:
                return high
            size *= 2

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf_chars:
            return self.leaf.encode_ordinary(text[low:high])
        mid = (low + high) // 2
        left, right = self._encode(text, low, mid), self._encode(text, mid, high)
        a, b = self._cut_before(text, mid, low), self._cut_after(text, mid, high)
        stale, spent = len(self.leaf.encode_ordinary(text[a:mid])), len(self.leaf.encode_ordinary(text[mid:b]))
        if stale:
            del left[-stale:]
        left += self.leaf.encode_ordinary(text[a:b])
        left += right[spent:]
        return left

    def encode(self, text: str | None) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.leaf.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _coded(ranks, pattern: str, with_ids: bool):
    """Batches of (doc_id, text) to (doc_id, n_tokens, ids as 32-bit little-endian or digest, decoded bytes or digest)."""
    def run(batches):
        bpe = MonoidBPE(ranks.value, pattern)
        for batch in batches:
            n, ids_out, back = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                raw, decoded = np.asarray(ids, dtype="<u4").tobytes(), bpe.decode(ids)
                n.append(len(ids))
                ids_out.append(raw if with_ids else hashlib.sha256(raw).hexdigest())
                back.append(decoded if with_ids else hashlib.sha256(decoded).hexdigest())
            kind = pa.binary() if with_ids else pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_out, kind), pa.array(back, kind)], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def code(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every row of docs (doc_id long, text string): the ids as little-endian
    unsigned 32-bit integers and the bytes they decode to, or the SHA-256 of either.

    Null texts count as empty: no ids. The rank file is read once on the driver and broadcast; its size is that of the
    vocabulary and doesn't grow with the data. Rows are coded each for itself, in bounded memory and without a shuffle.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())
    kind = "string" if digests else "binary"
    return docs.select("doc_id", "text").mapInArrow(_coded(ranks, pattern, not digests), f"doc_id long, n_tokens long, ids {kind}, decoded {kind}")


def op4_bpe_monoid(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    out = code(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
