"""Pages of texts that exchange compact fingerprints.

Texts are dealt into pages of a few megabytes by a hash. A page sends each distinct fingerprint once,
packed into one binary row for each bucket; buckets answer to pages. A very common fingerprint thus
meets in a bucket once for each page, however many texts of the page hold it.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import words as W
from assayer.llm.tables import shuffle_partitions

PAGE_BYTES = 8 << 20


def dealt(df: DataFrame, key: str, text: str, carry: list[str], pages: int) -> DataFrame:
    """Columns page, key, text and those to carry."""
    page = F.pmod(F.xxhash64(key, text), F.lit(pages)).cast("int").alias("_page")
    return df.select(page, F.col(key), F.col(text), *(F.col(c) for c in carry if c not in (key, text)))


def sizes(df: DataFrame, text: str, page_bytes: int = PAGE_BYTES) -> tuple[int, int, int]:
    """(bytes of all texts, pages, buckets)."""
    total = int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    least = shuffle_partitions(df.sparkSession)
    return total, max(least, total // page_bytes + 1), max(2 * least, total // (16 << 20) + 1)


def width_for(items: float, buckets: int) -> int:
    """Bytes of a fingerprint (3 to 5) so that, with its bucket, about one in 500 is like another by chance."""
    return min(5, max(3, ceil((log2(max(2, items)) + 9 - log2(buckets)) / 8)))


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Low bytes of each value, as rows of bytes."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def unpack(parts: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (W.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def cut(group: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """``group`` is sorted: its distinct values, and the bytes of each column's rows in each."""
    if not len(group):
        return group, [[] for _ in columns]
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(at[1:], len(group))
    return group[at], [[c[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)] for c in columns]


def blobs(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def isin(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Like numpy.isin; ``wanted`` is sorted."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values
