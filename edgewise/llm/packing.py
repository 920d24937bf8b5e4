"""Packing by power-of-two decomposition.

A document of n tokens becomes pieces of 4096 tokens and then one piece for each bit
that is set in the rest, longest first. Each piece is a sequence: its length is a
power of two, so there is no padding and no sequence crosses documents. Equal lengths
form a bucket, from which a trainer draws whole batches.

Defined cases: a null or empty text is the end token alone; repeated rows are packed
one by one; extra columns are ignored; a very long text is cut like any other.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 4096
END_ID = 2
#: Parts whose ids a worker keeps; beyond it they become the older half of the cache.
CACHE_WORDS = 300_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary"
)


class WordIds(dict):
    """Ids of whole texts by way of their blank-separated parts.

    No match of the pre-tokenizer crosses white space, so the ids of a text are those
    of its parts in order; most parts recur, so each is encoded once. ASCII letters
    are lower-cased first, as the tokenizer does (not in a text with ``<|``, where a
    special token may be spelt). A closing run of ASCII marks after a letter or number
    is a match of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode, self.older = Tokenizer.from_file(path).encode, {}

    def __missing__(self, part: bytes) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            base = part.rstrip(b".,!#$%&*|")
            if len(base) < len(part) and base and base.decode().lower()[-1].isalnum():
                ids = self[base] + self[part[len(base) :]]
            else:
                ids = np.array(self.encode(part.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[part] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        raw = text.encode()
        return b"".join(map(self.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    """One cache for all tasks of a worker process."""
    return WordIds(path)


def piece_lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of n tokens: whole sequences, then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with ``sequence_id`` and ``offset``; a narrow pass.

    ``tokenizer`` is a file of the tokenizers library that each worker can open.
    ``ids`` holds the piece as little-endian unsigned 32-bit numbers, unless
    ``with_ids`` is false. ``sequence_id`` numbers the pieces within a partition, with
    the partition in its upper bits: unique without a shuffle, and the same when a
    lost task runs again over its split.
    """

    def run(batches):
        encode, end = word_ids(tokenizer), np.array([END_ID], "<u4").tobytes()
        types = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, rows = batch.slice(at, 500), []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids, start = encode(text or "") + end, 0
                    n_all = len(ids) // 4
                    for n in piece_lengths(n_all):
                        piece = ids[4 * start : 4 * (start + n)]
                        rows.append((doc_id, start, n, zlib.crc32(piece), n_all, n.bit_length() - 1, piece if with_ids else None))
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), types)], schema=types)

    out = docs.select("doc_id", "text").mapInArrow(run, PIECES)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
