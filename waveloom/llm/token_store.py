"""Token ids on disk, with Elias-Fano encoded document boundaries.

A store is a folder of Parquet files. Every row is a segment: `data` is one concatenated array of little-endian ids
behind a header and the Elias-Fano code (Elias 1974, Fano 1971) of the positions at which its documents end, and
`doc_ids` are the documents' ids. Segments of a part follow each other in ascending doc_id order, and so do parts.

Layout of `data`: magic `EFT1`; uint32 item size, documents, ids, low bits per value, bytes of the low and of the
high bits; low bits; high bits; ids. The k-th end (from 0) is (select1(k) - k) << low bits | low(k), where select1
is the place of the k-th set bit of the high bits, so any document is found without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hold, slices
from .token_ids import SLICE_BYTES, SLICE_ROWS, default_path, encoder

MAGIC, HEADER = b"EFT1", struct.Struct("<4s6I")
#: A segment closes once it has so many ids or documents; a longer document has a segment of its own.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 1 << 13
#: For select1, the set bits before each block of so many bytes are counted when a segment is opened: 32 bits for 512.
RANK_BYTES = 64


@dataclass
class EliasFano:
    """A non-decreasing sequence of n values below 2**32."""

    n: int
    low_bits: int
    low: bytes
    high: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        high = np.zeros(n + (universe >> bits) + 1, np.uint8)
        high[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def __post_init__(self):
        self._high = np.frombuffer(self.high + bytes(-len(self.high) % RANK_BYTES), np.uint8)
        counts = np.bitwise_count(self._high).reshape(-1, RANK_BYTES).sum(1, dtype=np.uint32)
        self._rank = np.cumsum(counts, dtype=np.uint32) - counts

    def select1(self, k: np.ndarray) -> np.ndarray:
        """The places of the k-th set bits of the high bits: by the ranks of blocks, the bytes of a block, the bits of a byte."""
        block = np.searchsorted(self._rank, k, "right") - 1
        own = self._high.reshape(-1, RANK_BYTES)[block]
        until = np.cumsum(np.bitwise_count(own), 1, dtype=np.int64)
        left = k - self._rank[block].astype(np.int64)
        byte = (until <= left[:, None]).sum(1)
        each = np.arange(len(k))
        left -= until[each, byte] - np.bitwise_count(own[each, byte])
        bits = np.unpackbits(own[each, byte][:, None], axis=1, bitorder="little")
        return (block * RANK_BYTES + byte) * 8 + (np.cumsum(bits, 1) <= left[:, None]).sum(1)

    def values(self, k: np.ndarray) -> np.ndarray:
        """The values at some places, by select1 and their low bits; the code is not decoded."""
        k = np.asarray(k, np.int64)
        at = k[:, None] * self.low_bits + np.arange(self.low_bits)
        low = np.frombuffer(self.low, np.uint8)
        bits = (low[at >> 3] >> (at & 7)) & 1 if self.low_bits else np.zeros((len(k), 0), np.int64)
        return (self.select1(k) - k) << self.low_bits | bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        return int(self.values(np.array([k]))[0])

    def decode(self) -> np.ndarray:
        """All values at once."""
        places = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (places - np.arange(self.n)) << self.low_bits | low


def pack_segment(documents: list[bytes], item: int) -> bytes:
    ends = np.cumsum([len(d) // item for d in documents])
    code = EliasFano.encode(ends)
    head = HEADER.pack(MAGIC, item, code.n, int(ends[-1]) if len(ends) else 0, code.low_bits, len(code.low), len(code.high))
    return b"".join([head, code.low, code.high, *documents])


@dataclass
class Segment:
    """A segment opened for reading."""

    ends: EliasFano
    ids: np.ndarray

    @classmethod
    def open(cls, data: bytes) -> Segment:
        magic, item, n, n_ids, bits, low, high = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEADER.size
        code = EliasFano(n, bits, bytes(data[at : at + low]), bytes(data[at + low : at + low + high]))
        return cls(code, np.frombuffer(data, f"<u{item}", n_ids, at + low + high))

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends[k - 1] if k else 0), self.ends[k]

    def document(self, k: int) -> np.ndarray:
        start, end = self.span(k)
        return self.ids[start:end]


STORE = "part long, segment long, n_docs long, n_ids long, doc_ids array<long>, data binary"


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 0) -> None:
    """Encode whole texts and write them in ascending doc_id order (ties by text; a null id first).

    Null text counts as empty; end_id follows every document, if given. Repeated rows are written repeatedly; an empty
    table gives a store without segments; other columns are ignored. One range shuffle of the texts; a task holds one
    segment at a time.
    """
    tokenizer = tokenizer or default_path()

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        hold("encoder")
        encode = encoder(tokenizer)
        tail = b"" if end_id is None else np.array([end_id], encode.dtype).tobytes()
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def segment():
            return pa.RecordBatch.from_pydict(
                {"part": [part], "segment": [number], "n_docs": [len(ids)], "n_ids": [size // encode.dtype.itemsize], "doc_ids": [ids], "data": [pack_segment(held, encode.dtype.itemsize)]},
                pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())]),
            )

        for batch in slices(batches, 1, SLICE_ROWS, SLICE_BYTES):
            for doc_id, own in zip(batch.column(0).to_pylist(), encode.encode_many(batch.column(1))):
                own += tail
                if ids and (size + len(own) > SEGMENT_IDS * encode.dtype.itemsize or len(ids) >= SEGMENT_DOCS):
                    yield segment()
                    ids, held, size, number = [], [], 0, number + 1
                ids.append(doc_id)
                held.append(own)
                size += len(own)
        if ids:
            yield segment()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, STORE).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Empty documents have n_tokens 0, or 1 with an end id; equal ids (and null ones) keep a row each; a store without segments gives none.

    Offsets are kept per segment; the start adds the ids of earlier parts and segments, summed over one row per segment
    within a part and over one row per part across parts.
    """
    store = spark.read.schema(STORE).parquet(path)
    sizes = store.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "segment", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("segment_start"))
    bases = bases.join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("base"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = Segment.open(row["data"])
                ends = found.ends.values(np.arange(found.ends.n))
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = found.ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(ends), pa.int64()), pa.array([row["segment"]] * len(ends), pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts),
                        pa.array([zlib.crc32(wide[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64()),
                    ],
                    ["part", "segment", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spans = store.select("part", "segment", "doc_ids", "data").mapInArrow(
        run, "part long, segment long, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return spans.join(bases, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
