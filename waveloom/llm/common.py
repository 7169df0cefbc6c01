"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, scratch  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches, column: int, rows: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice has at most `rows` rows and about `size` bytes of text; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


_HELD: list[tuple[str, Callable[[], None]]] = []


def hold(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """A Python worker remembers things for one operator at a time: when it is dealt another one's work, the former's memory is given back."""
    if _HELD and _HELD[0][0] == owner:
        return
    for _, gone in _HELD:
        gone()
    _HELD[:] = [(owner, forget)]
    pa.default_memory_pool().release_unused()


def word_hashes(texts: pa.Array, of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """of(bytes) of every word of some texts, one after another, and how many words each text has. Each distinct word is hashed once."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    texts = pc.fill_null(texts, "")
    for c in "\t\n\x0b\x0c\r":
        texts = pc.replace_substring(texts, c, " ")
    lists = pc.split_pattern(texts, " ")
    real = pc.not_equal(pc.binary_length(lists.values), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = lists.values.filter(real).dictionary_encode()
    _, offsets, data = coded.dictionary.buffers()
    at = np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1].tolist() if len(coded.dictionary) else [0]
    data = memoryview(data) if data is not None else b""
    hashed = np.fromiter((of(data[a:b]) for a, b in zip(at, at[1:])), np.uint64, len(at) - 1)
    return hashed[coded.indices.to_numpy()], np.diff(before[lists.offsets.to_numpy()])


def words(text: str) -> list[str]:
    """Words of the contracts: runs of anything but 0x20 and 0x09 to 0x0D."""
    if text.isascii():
        # str.split() also cuts at 0x1C to 0x1F, which the contracts count as word characters
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]
