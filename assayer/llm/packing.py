"""Best-fit packing: non-negative least squares over length patterns, then residuals.

Documents become token pieces of at most ``budget`` tokens. Only the histogram of piece lengths
(``budget`` numbers at most) reaches the driver, where few-document patterns that fill a sequence
exactly are fitted to it; what rounding leaves over is packed best-fit-decreasing on the histogram.
Executors then give the r-th piece of each length its place, from its rank alone.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import words as W
from assayer.llm.segments import HashedSegments
from assayer.llm.tables import materialize, read

PIECES = "piece int, start long, length long, ids_crc32 long"


@lru_cache(2)
def word_encoder(blob: str) -> HashedSegments:
    """Ids of white-space-separated runs of lower-cased text; kept for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(blob)
    tokenizer.encode_special_tokens = True  # texts are cut at their strings before
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    for piece, i in tokenizer.get_vocab().items():
        last[i] = piece.endswith("</w>")

    def ids_of(new: list[bytes]) -> list[np.ndarray]:
        texts = [w.decode() for w in new]
        # A run of letters is one word, whose last id alone ends a word: many are encoded in one call.
        letters = [k for k, t in enumerate(texts) if t.isalpha()]
        others = [k for k, t in enumerate(texts) if not t.isalpha()]
        out: list = [None] * len(texts)
        if letters:
            ids = np.array(tokenizer.encode_batch_fast([" ".join(texts[k] for k in letters)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(last[ids]) + 1
            ids = ids.tolist()
            if len(ends) != len(letters):
                raise ValueError("the tokenizer's words do not end as expected")
            for k, a, b in zip(letters, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[k] = ids[a:b]
        for k, e in zip(others, tokenizer.encode_batch_fast([texts[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    return HashedSegments(ids_of, limit=500_000)


@lru_cache(2)
def added_tokens(blob: str) -> tuple[re.Pattern, dict[bytes, int]]:
    """Strings that the library takes for tokens of their own in the text as it stands, and their ids."""
    added = json.loads(blob).get("added_tokens", [])
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that are matched in another way than as plain strings")
    ids = {t["content"].encode(): t["id"] for t in added}
    return re.compile(b"(" + b"|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + b")" if ids else b"(?!)"), ids


def lowered(text: bytes) -> bytes:
    """Composed and lower-cased as the tokenizer's normaliser does it, letter by letter."""
    if text.isascii():
        return text.lower()
    own = text.decode()
    if not unicodedata.is_normalized("NFC", own):
        own = unicodedata.normalize("NFC", own)
    return own.replace("\u03a3", "\u03c3").lower().encode()


def stops_apart(data: np.ndarray) -> np.ndarray:
    """A lone stop or comma between a letter and white space is a token of its own: set apart, more words are alike."""
    if len(data) < 3:
        return data
    stop = np.zeros(len(data), bool)
    inner = data[1:-1]
    stop[1:-1] = ((inner == 46) | (inner == 44)) & (data[:-2] >= 97) & (data[:-2] <= 122) & ((data[2:] == 32) | (data[2:] == 10))
    out = np.full(len(data) + int(stop.sum()), 32, np.uint8)
    out[np.arange(len(data)) + np.cumsum(stop)] = data
    return out


def token_pieces(batches: Iterator[pa.RecordBatch], blob: str, budget: int, end_id: int, key: str, text: str) -> Iterator[pa.RecordBatch]:
    # White space always ends a token and is dropped, so each run between it can be encoded on its own.
    cache = word_encoder(blob)
    added, id_of = added_tokens(blob)
    W._OWN_CACHES["packing"] = word_encoder.cache_clear
    for batch in W.slices(batches, text, own="packing"):
        cache.trim()
        data, at = W.raw(W.plain(batch.column(text)))
        whole = data.tobytes()
        texts, first, between = [], [0], []  # parts of texts, each text's first part, and the added token behind a part
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            parts = added.split(whole[a:b])
            texts += parts[::2]
            between += [*(id_of[x] for x in parts[1::2]), end_id]
            first.append(len(texts))
        texts = [stops_apart(np.frombuffer(lowered(t), np.uint8)).tobytes() for t in texts]
        w = W.words(pa.array(texts, pa.binary()).view(pa.string()))
        joined, start, end = w.data.tobytes(), w.start, w.end
        codes = cache.codes_of(w.hashes(), lambda i: joined[start[i] : end[i]])
        rows, sizes = cache.values(codes)
        token_at = np.concatenate([[0], np.cumsum(sizes)])[w.first]
        ids = np.insert(rows[:, 0], token_at[1:], between).astype("<u4")
        token_at = (token_at + np.arange(len(token_at)))[first]
        out = []
        for k in range(batch.num_rows):
            own = ids[token_at[k] : token_at[k + 1]]
            for piece, a in enumerate(range(0, len(own), budget)):
                part = own[a : a + budget]
                out.append((k, piece, a, len(part), zlib.crc32(part.tobytes())))
        row, piece, start, length, crc = (np.array(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(key).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
            [key, "piece", "start", "length", "ids_crc32"],
        )


def enumerate_patterns(present: np.ndarray, budget: int, triples: int = 12_000) -> list[tuple[int, ...]]:
    """Patterns of one to three pieces that fill a sequence, from lengths that occur."""
    have = np.zeros(budget + 1, bool)
    have[present] = True
    out = [(budget,)] if have[budget] else []
    a = np.arange(1, budget // 2 + 1)
    a = a[have[a] & have[budget - a]]
    out += [(int(budget - x), int(x)) for x in a]
    # Triples: for each shortest length, middle lengths at even steps; steps follow from how many are wanted.
    small = present[present <= budget // 3]
    each = max(1, triples // max(1, len(small)))
    for x in small.tolist():
        mid = np.arange(x, (budget - x) // 2 + 1)
        mid = mid[have[mid] & have[budget - x - mid]]
        if len(mid):
            for y in np.unique(mid[np.linspace(0, len(mid) - 1, min(each, len(mid))).astype(int)]).tolist():
                out.append((budget - x - y, y, x))
    return out


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - histogram||, by accelerated projected gradients."""
    if not patterns:
        return np.zeros(0)
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([x for p in patterns for x in p])
    n = len(histogram)

    def ahead(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, x[column], n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(column, r[row], len(patterns))

    probe = np.ones(len(patterns))
    for _ in range(30):  # largest eigenvalue of A'A
        probe = back(ahead(probe))
        bound = np.linalg.norm(probe)
        probe /= bound
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(ahead(y) - histogram) / (bound * 1.01))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def best_fit(left: np.ndarray, budget: int) -> dict[tuple[int, ...], int]:
    """Best-fit-decreasing over a histogram: equal sequences are handled together."""
    opened: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # by room left
    rooms = np.zeros(budget + 1, bool)
    for size in range(budget, 0, -1):
        count = int(left[size])
        while count:
            fits = np.flatnonzero(rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                pattern, many = next(iter(opened[room].items()))
                fill = room // size
                if count >= fill:
                    use = min(many, count // fill)
                else:
                    use, fill = 1, count
                count -= use * fill
                if many == use:
                    del opened[room][pattern]
                    rooms[room] = bool(opened[room])
                else:
                    opened[room][pattern] = many - use
                opened[room - fill * size][pattern + (size,) * fill] += use
                rooms[room - fill * size] = True
            else:
                fill = min(budget // size, count)
                use = count // fill
                count -= use * fill
                opened[budget - fill * size][(size,) * fill] += use
                rooms[budget - fill * size] = True
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in opened.values():
        for pattern, many in groups.items():
            if many:
                out[pattern] += many
    return out


def plan(histogram: np.ndarray, budget: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that hold every piece of the histogram exactly once."""
    patterns = enumerate_patterns(np.flatnonzero(histogram), budget)
    fitted = np.floor(fit_counts(patterns, histogram.astype(float)) + 1e-6).astype(np.int64)
    left, out = histogram.astype(np.int64).copy(), []
    for k in np.argsort(-fitted, kind="stable").tolist():
        own, many = np.unique(patterns[k], return_counts=True)
        use = int(min(fitted[k], (left[own] // many).min()))
        if use > 0:
            left[own] -= use * many
            out.append((patterns[k], use))
    return out + sorted(best_fit(left, budget).items())


def runs(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs, and the first sequence and the offset of each run."""
    taken: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, many in planned:
        offset = 0
        for size in pattern:
            out[size].append((taken[size], sequence, offset))
            taken[size] += many
            offset += size
        sequence += many
    return {size: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for size, rows in out.items()}


def place(batches: Iterator[pa.RecordBatch], by_length: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length).tolist():
            mine = np.flatnonzero(length == size)
            first, base, at = by_length[size]
            k = np.searchsorted(first, rank[mine], "right") - 1
            sequence[mine], offset[mine] = base[k] + rank[mine] - first[k], at[k]
        kept = [i for i, name in enumerate(batch.schema.names) if name not in ("rank",)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)],
            [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"],
        )


def pack(df: DataFrame, tokenizer_path: str, budget: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", salt_rows: int = 50_000) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Ids are those that the library gives with ``add_special_tokens=False``: strings of its added tokens in
    a text are those tokens. Null text counts as empty (one piece: the end id alone). Rows that repeat
    a key or have none are packed each for itself. An empty table gives no rows. Other columns are left out. Lengths that many
    pieces share are ranked in salted groups of about ``salt_rows``. Of three-piece patterns some 12,000
    are tried at most (``enumerate_patterns``); what they do not hold is packed best-fit, so no piece is lost.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = f.read()
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    pieces = materialize(
        df.select(key, text).mapInArrow(lambda it: token_pieces(it, blob, budget, end_id, key, text), f"{key} {kind}, {PIECES}")
    )
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `budget` rows
    histogram = np.zeros(budget + 1, np.int64)
    for size, n in counted.items():
        histogram[size] = n
    by_length = spark.sparkContext.broadcast(runs(plan(histogram, budget)))
    salts = max(16, int(histogram.sum()) // salt_rows)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "salt").orderBy(key, "piece", "ids_crc32")
    ranked = (
        salted.withColumn("own", F.row_number().over(within) - 1).join(before, ["length", "salt"])
        .select(key, "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).cast("long").alias("rank"))
    )
    return ranked.mapInArrow(lambda it: place(it, by_length.value), f"{key} {kind}, {PIECES}, sequence_id long, offset long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
