"""Substring dedup by fixed-block anchors.

Every document is indexed at its non-overlapping blocks of words and probed with every rolling window
of that length. A window of ``size`` words holds a whole block wherever it stands, so windows around
block hits are all that can repeat; they are extended to exact repeats by comparing whole windows,
of which each page sends one with its smallest document.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from assayer.llm import pages as P
from assayer.llm import words as W
from assayer.llm.tables import read, schema_of


class _Page:
    """Words of a page; texts without a key take no part in matches."""

    def __init__(self, table: pa.Table, key: str, text: str):
        self.words = W.words(W.plain(table.column(text)))
        self.hashes = self.words.hashes()
        keys = table.column(key)
        self.keyed = keys.is_valid().to_numpy(zero_copy_only=False)
        self.keys = keys.fill_null(0).to_numpy().astype(np.int64)

    def windows(self, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        rolled, at = W.windows(self.hashes, self.words.doc, size, seed)
        keep = self.keyed[self.words.doc[at]]
        return rolled[keep], at[keep]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return self.keys[self.words.doc[at]]


def _least(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the smallest document of each."""
    order = np.lexsort((docs, values))
    values, docs = values[order], docs[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new], docs[new]


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 13, carry: list[str] | None = None) -> DataFrame:
    """Key, n_words, n_removed, kept (the words that stay, joined by one space); the columns to carry in a struct ``carried``.

    A word goes if it lies in a window of ``size`` words whose sequence also starts in a document with
    a smaller key. Null text counts as empty; rows without a key neither lose nor cause anything; rows
    that repeat a key do not count as smaller than each other. Windows are compared by 64-bit hashes
    within independently hashed buckets. An empty table gives no rows.
    """
    block = (size + 1) // 2
    df = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []))
    carry, name, key, text = df.columns[2:], key, "_key", "_text"
    total, pages, buckets = P.sizes(df, text)
    width = P.width_for(total / 4, buckets)
    shift, mask = np.uint64(8 * width), np.uint64((1 << 8 * width) - 1)
    docs = P.dealt(df, key, text, carry, pages)

    def probes(table: pa.Table) -> pa.Table:
        page = _Page(table, key, text)
        rolled, at = page.windows(block, 1)
        first = page.words.first[page.words.doc[at]]
        unique, code, times = np.unique(rolled, return_inverse=True, return_counts=True)
        indexed = np.bincount(code, (at - first) % block == 0, len(unique)) > 0
        bucket = P.bucket_of(unique, buckets)
        order = np.argsort(bucket, kind="stable")
        flags = ((times > 1) + 2 * indexed).astype(np.uint8)[order]
        ids, (fps, marks) = P.cut(bucket[order], P.pack(unique[order], width), flags)
        return pa.table({"_bucket": pa.array(ids.astype(np.int32)), "_page": pa.array([table.column("_page")[0].as_py()] * len(ids), pa.int32()), "_fps": pa.array(fps, pa.binary()), "_flags": pa.array(marks, pa.binary())})

    def hits(table: pa.Table) -> pa.Table:
        parts = P.blobs(table, "_fps")
        fps, flags = P.unpack(parts, width), np.frombuffer(b"".join(P.blobs(table, "_flags")), np.uint8)
        unique, code = np.unique(fps, return_inverse=True)
        times = np.bincount(code, 1 + (flags & 1), len(unique))
        shared = ((times > 1) & (np.bincount(code, flags & 2, len(unique)) > 0))[code]
        owner = np.repeat(np.arange(len(parts)), [len(p) // width for p in parts])[shared]
        rows, (found,) = P.cut(owner, P.pack(fps[shared], width))
        return table.select(["_bucket", "_page"]).take(pa.array(rows)).append_column("_found", pa.array(found, pa.binary()))

    def candidates(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"_bucket": pa.array([], pa.int32()), "_page": pa.array([], pa.int32()), "_windows": pa.array([], pa.binary()), "_docs": pa.array([], pa.binary())})
        page = _Page(table, key, text)
        short, at = page.windows(block, 1)
        wanted = [
            (np.uint64(b) << shift) | P.unpack([f], width) for b, f in zip(found.column("_bucket").to_pylist(), P.blobs(found, "_found"), strict=True)
        ]
        wanted = np.sort(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
        hit = np.zeros(len(page.hashes) + 1, np.int64)
        hit[at[P.isin((P.bucket_of(short, buckets).astype(np.uint64) << shift) | (short & mask), wanted)] + 1] = 1
        hit = np.cumsum(hit)
        whole, start = page.windows(size, 2)
        near = hit[start + size - block + 1] > hit[start]
        values, least = _least(whole[near], page.doc_of(start[near]))
        bucket = P.bucket_of(values, buckets)
        order = np.argsort(bucket, kind="stable")
        ids, (windows, owners) = P.cut(bucket[order], values[order], least[order])
        return pa.table({"_bucket": pa.array(ids.astype(np.int32)), "_page": pa.array([table.column("_page")[0].as_py()] * len(ids), pa.int32()), "_windows": pa.array(windows, pa.binary()), "_docs": pa.array(owners, pa.binary())})

    def later(table: pa.Table) -> pa.Table:
        parts = P.blobs(table, "_windows")
        windows, owners = np.frombuffer(b"".join(parts), np.uint64), np.frombuffer(b"".join(P.blobs(table, "_docs")), np.int64)
        unique, code = np.unique(windows, return_inverse=True)
        least = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(least, code, owners)
        repeat = owners > least[code]
        owner = np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts])[repeat]
        rows, (found,) = P.cut(owner, windows[repeat])
        return table.select(["_page"]).take(pa.array(rows)).append_column("_found", pa.array(found, pa.binary()))

    def strip(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([], out_schema(table.schema))
        page = _Page(table, key, text)
        whole, start = page.windows(size, 2)
        elsewhere = np.sort(np.frombuffer(b"".join(P.blobs(found, "_found")), np.uint64))
        doc = page.doc_of(start)
        values, least = _least(whole, doc)
        gone = P.isin(whole, elsewhere) | (doc > least[np.searchsorted(values, whole)])
        removed = W.covered(start[gone], size, len(page.hashes))
        count = np.concatenate([[0], np.cumsum(removed)])[page.words.first]
        blob, stays, first = page.words.data.tobytes(), (~removed).tolist(), page.words.first.tolist()
        kept = []
        for k, (a, b) in enumerate(zip(page.words.text_at[:-1].tolist(), page.words.text_at[1:].tolist(), strict=True)):
            own = blob[a:b].split()
            kept.append(b" ".join(compress(own, stays[first[k] : first[k + 1]]) if count[k + 1] > count[k] else own))
        out = {key: table.column(key), "n_words": pa.array(page.words.counts.astype(np.int64)), "n_removed": pa.array(np.diff(count).astype(np.int64))}
        out |= {"kept": pa.array(kept, pa.binary()).view(pa.string())} | {c: table.column(c) for c in carry}
        return pa.table(out)

    def out_schema(own: pa.Schema) -> pa.Schema:
        fields = [own.field(key), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("kept", pa.string())]
        return pa.schema(fields + [own.field(c) for c in carry])

    by_page = docs.groupBy("_page")
    sent = by_page.applyInArrow(probes, "_bucket int, _page int, _fps binary, _flags binary")
    answered = sent.groupBy("_bucket").applyInArrow(hits, "_bucket int, _page int, _found binary")
    windows = by_page.cogroup(answered.groupBy("_page")).applyInArrow(candidates, "_bucket int, _page int, _windows binary, _docs binary")
    repeats = windows.groupBy("_bucket").applyInArrow(later, "_page int, _found binary")
    out = schema_of(df, [key], ("n_words", LongType()), ("n_removed", LongType()), ("kept", StringType()))
    return by_page.cogroup(repeats.groupBy("_page")).applyInArrow(strip, StructType([*out.fields, *(df.schema[c] for c in carry)])).withColumnRenamed(key, name)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


#: DuckDB: all windows of 13 words by their first document.
OP6_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s),
hit AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
gone_of AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, len(coalesce(ps, []))::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM split s LEFT JOIN gone_of g ON g.doc_id = s.doc_id
"""
