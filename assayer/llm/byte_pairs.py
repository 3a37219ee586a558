"""Byte-level BPE: encoding by a queue of merge ranks over linked symbols, decoding by joining vocabulary strings.

Texts are cut at the strings of added tokens, then into words by four classes of characters, for whole
batches at once. Each distinct word is merged once while it stays cached: a heap holds (rank, place) of
neighbours that can be merged, symbols are linked both ways, and entries whose symbols have changed
meanwhile are skipped. Ids turn into text by one gather from the vocabulary's bytes.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import words as W
from assayer.llm.packing import added_tokens
from assayer.llm.segments import HashedSegments
from assayer.llm.tables import read

SCHEMA = "ids array<int>, decoded string"
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: What may follow an apostrophe as one word with it.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_signs() -> list[str]:
    """The sign that stands for each byte in vocabularies: printable Latin-1 is itself, the rest follows from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Classes:
    """Space, letter, number or other, for each code point; the library's own splitter is asked once for each it has not seen."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self._split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self._of = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn(np.arange(128))

    def _learn(self, points: np.ndarray) -> None:
        for c in points.tolist():
            # Twice between a letter and a sign: a letter joins the first, white space stands apart from its like, a sign joins the last.
            begins = {a for _, (a, _) in self._split(f"a{chr(c)}{chr(c)}!")}
            self._of[c] = LETTER if 1 not in begins else SPACE if 2 in begins else NUMBER if 3 in begins else OTHER

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self._of[points]
        if (out == UNKNOWN).any():
            self._learn(np.unique(points[out == UNKNOWN]))
            out = self._of[points]
        return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point of each character of UTF-8 bytes, and the byte at which it begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    for least, size, low in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        mine = np.flatnonzero((points >= least) & (data[at] >= least) & (data[at] < (256 if size == 4 else least + (0x20 if size == 2 else 0x10))))
        value = points[mine] & low
        for k in range(1, size):
            value = value << 6 | (data[at[mine] + k] & 0x3F)
        points[mine] = value
    return points, at


def cut_words(data: np.ndarray, text_at: np.ndarray, classes: Classes) -> W.Words:
    """Words of all texts: a run of letters, digits or signs with one space before it, or white space; suffixes stand apart."""
    points, byte_at = code_points(data)
    n = len(points)
    if not n:
        empty = np.zeros(0, np.int64)
        return W.Words(data, text_at, empty, empty, empty, np.zeros(len(text_at), np.int64))
    kind = classes(points)
    first = np.zeros(n, bool)  # characters that begin a text
    starts = np.searchsorted(byte_at, text_at[:-1][text_at[:-1] < len(data)])
    first[starts] = True
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    run_end = np.append(run[1:], n)
    begins = change.copy()
    # The last of a run of white space that meets a word stands apart; if it is a space, the word begins with it.
    inner = (kind[run] == SPACE) & (run_end < n)
    inner[inner] &= ~first[run_end[inner]]
    last = run_end[inner] - 1
    begins[last] = True
    spaced = last[points[last] == 32] + 1
    begins[spaced] = False
    # A lone apostrophe right behind a word, and letters that it may be followed by.
    lone = run[(points[run] == 39) & (run_end - run == 1) & begins[run] & (run_end < n)]
    lone = lone[~first[lone + 1] & (kind[lone + 1] == LETTER)]
    ends_of = dict(zip(run.tolist(), run_end.tolist(), strict=True)) if len(lone) else {}
    for a in lone.tolist():
        letters = "".join(map(chr, points[a + 1 : min(a + 3, ends_of[a + 1])].tolist()))
        for suffix in SUFFIXES:
            if letters.startswith(suffix):
                begins[a + 1] = False
                if a + 1 + len(suffix) < n:
                    begins[a + 1 + len(suffix)] = True
                break
    at = np.flatnonzero(begins)
    start = byte_at[at]
    end = np.append(start[1:], len(data))
    word_at = np.searchsorted(start, text_at)
    return W.Words(data, text_at, start, end, np.repeat(np.arange(len(text_at) - 1), np.diff(word_at)), word_at)


class Merges:
    """Merge ranks of a vocabulary, and its strings as bytes."""

    def __init__(self, blob: str):
        spec = json.loads(blob)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normaliser or a prefix space is supported")
        vocab = model["vocab"]
        signs = byte_signs()
        self.of_byte = [vocab[s] for s in signs]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        byte = {s: b for b, s in enumerate(signs)}
        added = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        strings = [b""] * (max([*vocab.values(), *added]) + 1)
        for text, i in [*vocab.items(), *((t, i) for i, t in added.items())]:
            strings[i] = bytes(byte[c] for c in text) if all(c in byte for c in text) else text.encode()
        self.size = np.array([len(s) for s in strings], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: always the pair of lowest rank is merged, of equal ones the first."""
        symbols = [self.of_byte[b] for b in word]
        ranks, n = self.ranks, len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(hit[0], k, hit[1]) for k in range(n - 1) if (hit := ranks.get((symbols[k], symbols[k + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, k, merged = heapq.heappop(queue)
            right = after[k]
            if right < 0 or symbols[k] < 0 or ranks.get((symbols[k], symbols[right]), (-1,))[0] != rank:
                continue  # stale: one of the two has been merged since
            symbols[k], symbols[right] = merged, -1
            after[k] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = k
                if hit := ranks.get((merged, symbols[beyond])):
                    heapq.heappush(queue, (hit[0], k, hit[1]))
            if (left := before[k]) >= 0 and (hit := ranks.get((symbols[left], merged))):
                heapq.heappush(queue, (hit[0], left, hit[1]))
        return [s for s in symbols if s >= 0]

    def text(self, ids: np.ndarray, row_at: np.ndarray) -> list[str]:
        """The vocabulary strings of each row's ids joined; bytes that are no UTF-8 give U+FFFD, unknown ids nothing."""
        known = (ids >= 0) & (ids < len(self.size))
        own = np.where(known, ids, 0)
        size = np.where(known, self.size[own], 0)
        ends = np.cumsum(size)
        whole = self.bytes[np.repeat(self.at[own] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.concatenate([[0], ends])[row_at].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(2)
def encoder(blob: str) -> tuple[Merges, Classes, HashedSegments]:
    """Kept for all tasks of a worker."""
    merges = Merges(blob)
    return merges, Classes(), HashedSegments(lambda new: [merges.merge(w) for w in new], limit=400_000)


def encode_batches(batches: Iterator[pa.RecordBatch], blob: str, key: str, text: str) -> Iterator[pa.RecordBatch]:
    merges, classes, cache = encoder(blob)
    added, id_of = added_tokens(blob)
    W._OWN_CACHES["byte pairs"] = encoder.cache_clear
    for batch in W.slices(batches, text, own="byte pairs"):
        cache.trim()
        data, at = W.raw(W.plain(batch.column(text)))
        whole = data.tobytes()
        parts_at, first, between = [0], [0], []  # parts between added tokens; each text's first part; the token behind each part, or -1
        if any(s in whole for s in id_of):
            kept = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                parts = added.split(whole[a:b])
                kept += parts[::2]
                between += [*(id_of[x] for x in parts[1::2]), -1]
                first.append(len(kept))
            data = np.frombuffer(b"".join(kept), np.uint8)
            parts_at = np.concatenate([[0], np.cumsum([len(p) for p in kept])])
        else:
            parts_at, first, between = at, np.arange(len(at)), np.full(len(at) - 1, -1)
        w = cut_words(data, parts_at, classes)
        joined, start, end = data.tobytes(), w.start, w.end
        codes = cache.codes_of(w.hashes(), lambda i: joined[start[i] : end[i]])  # noqa: B023
        rows, sizes = cache.values(codes)
        token_at = np.concatenate([[0], np.cumsum(sizes)])[w.first]
        ids, between = rows[:, 0], np.asarray(between)
        behind = np.flatnonzero(between >= 0)
        ids = np.insert(ids, token_at[1:][behind], between[behind])
        shift = np.concatenate([[0], np.cumsum(between >= 0)])
        row_at = (token_at + shift)[np.asarray(first)]
        lists = pa.ListArray.from_arrays(pa.array(row_at.astype(np.int32)), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(key), lists, pa.array(merges.text(ids, row_at), pa.string())], [key, "ids", "decoded"])


def decode_batches(batches: Iterator[pa.RecordBatch], blob: str, key: str, ids: str) -> Iterator[pa.RecordBatch]:
    merges = encoder(blob)[0]
    for batch in batches:
        column = batch.column(ids).cast(pa.list_(pa.int64()))
        sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
        flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        texts = merges.text(flat, np.concatenate([[0], np.cumsum(sizes)]))
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "decoded"])


def _blob(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, ids, decoded.

    Ids are the library's with ``add_special_tokens=False``; strings of its added tokens in a text are those tokens.
    ``decoded`` is what those ids stand for, special tokens with them. Null text counts as empty: no ids, empty text. Repeated
    rows and rows without a key are encoded each for itself, an empty table gives no rows, and other columns are
    left out. Texts are taken whole; memory follows the longest one and a cache of 400,000 words.
    """
    blob, kind = _blob(tokenizer_path), df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lambda batches: encode_batches(batches, blob, key, text), f"`{key}` {kind}, {SCHEMA}")


def decode(df: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ``df``: key, decoded. Null lists and ids that are null or unknown stand for nothing."""
    blob, kind = _blob(tokenizer_path), df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(lambda batches: decode_batches(batches, blob, key, ids), f"`{key}` {kind}, decoded string")


def op13_byte_pairs(spark, sf_dir: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded text."""
    import public_tokenizers

    out = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
