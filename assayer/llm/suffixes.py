"""Byte-exact repeats: interval expansion on a Burrows-Wheeler transform, up to the minimum length.

Every string of ``size`` bytes is represented by its anchor, the smallest hashed gram in it, so equal
strings share an anchor at the same place. An anchor's context is the text of all strings that it
represents. Contexts that occur twice are repeats as a whole; only where one anchor stands in
different contexts must bytes be compared. Those contexts go to the anchor's bucket, where a
breadth-first backward extension on their Burrows-Wheeler transform finds all common prefixes shorter
than ``size``: what no such boundary separates is a repeat. Anchors with very many contexts
are compared by hashes of single strings instead, spread over all buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from assayer.llm import pages as P
from assayer.llm import words as W
from assayer.llm.tables import read, schema_of

_U = np.uint64
FULL, SEND, SPREAD = 1, 2, 4
#: Some hundred bytes of working memory go to each byte of a page.
PAGE_BYTES = 3 << 20


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (cyclic) sorted by their first ``depth`` bytes or more, ties by place; and each one's dense rank."""
    n = len(data)
    key = np.zeros(n, _U)
    for k in range(8):
        key = (key << _U(8)) | np.roll(data, -k).astype(_U)
    known = 8
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if known >= depth:
            return order, rank
        key = rank.astype(_U) * _U(n) + np.roll(rank, -known).astype(_U)
        known *= 2


def boundaries(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes, and which of them share fewer than ``size`` bytes with the one before.

    Common prefixes are found by increasing length: each new boundary of length l is extended by
    every byte that precedes its interval, which gives the boundaries of length l + 1.
    """
    order, rank = suffix_order(data, size)
    n = len(data)
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    ranked = rank[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))  # rows where a tied group begins
    before = data[order - 1]
    back = start[rank[order - 1]]  # the group's first row after one step to the left
    same = np.argsort(before, kind="stable")
    previous = np.full(n, -1, np.int64)
    follows = before[same[1:]] == before[same[:-1]]
    previous[same[1:][follows]] = same[:-1][follows]
    first = data[order]
    split = np.concatenate([[True], first[1:] != first[:-1]])
    new = np.flatnonzero(split)
    for _ in range(1, size):
        if not len(new):
            break
        every = np.append(np.flatnonzero(split), n)
        ends = every[np.searchsorted(every, new, "right")]
        lengths = ends - new
        total = np.cumsum(lengths)
        rows = np.repeat(new - (total - lengths), lengths) + np.arange(total[-1])
        found = back[rows[previous[rows] < np.repeat(new, lengths)]]
        found = np.unique(found[~split[found]])
        split[found] = True
        new = found
    return order, split


def repeated_starts(data: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """For texts that lie one after the other: which places start a string of ``size`` bytes that occurs twice or more."""
    n = len(data)
    at = np.concatenate([[0], np.cumsum(lengths)])
    joined = np.zeros(n + len(lengths), np.uint8)  # a zero after each text; strings over it are left out below
    place = np.arange(n) + np.repeat(np.arange(len(lengths)), lengths)
    joined[place] = data
    whole = np.repeat(at[1:], lengths) - np.arange(n) >= size
    if not whole.any():
        return whole
    order, split = boundaries(joined, size)
    is_start = np.zeros(len(joined), bool)
    is_start[place[whole]] = True
    group = np.cumsum(split) - 1
    many = np.bincount(group, is_start[order]) > 1
    out = np.zeros(len(joined), bool)
    out[order] = many[group]
    return out[place] & whole


class _Page:
    """Bytes of a page, the anchors of all its strings and their contexts."""

    def __init__(self, table: pa.Table, text: str, size: int, gram: int):
        self.data, self.at = W.raw(W.plain(table.column(text)))
        self.size = size
        n, data = len(self.data), self.data
        self.row = np.repeat(np.arange(len(self.at) - 1, dtype=np.int32), np.diff(self.at))
        self.low = self.high = self.anchor = np.zeros(0, np.int64)
        self.hash = self.context = np.zeros(0, _U)
        if n < size:
            return
        base, power, self._inverse = W._powers(W._room(n), 9)
        self._total = np.zeros(n + 1, _U)
        np.cumsum(base[data] * power[:n], out=self._total[1:])
        m = n - gram + 1
        grams = W.mix((self._total[gram:] - self._total[:m]) * self._inverse[:m])
        ranked = (grams & _U(0xFFFFFFFF00000000)) | np.arange(m, dtype=_U)
        ranked[self.row[:m] != self.row[gram - 1 :]] = _U(0xFFFFFFFFFFFFFFFF)
        wide = size - gram + 1
        blocks = np.concatenate([ranked, np.full(-m % wide, 0xFFFFFFFFFFFFFFFF, _U)]).reshape(-1, wide)
        del ranked
        ahead = np.minimum.accumulate(blocks, 1).ravel()[:m]
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()[:m]
        del blocks
        q = m - wide + 1
        chosen = np.minimum(behind[:q], ahead[wide - 1 :]) & _U(0xFFFFFFFF)
        del ahead, behind
        inside = np.flatnonzero(self.row[:q] == self.row[size - 1 : size - 1 + q])  # strings within one text
        if not len(inside):
            return
        anchor = chosen[inside].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)]))
        self.low = inside[new]  # first and last string of each anchor
        self.high = inside[np.append(new[1:] - 1, len(inside) - 1)]
        self.anchor = anchor[new]
        self.hash = grams[self.anchor]
        span = self.span_hash(self.low, self.high + size)
        self.context = W.mix(span ^ W.mix(self.hash + (self.anchor - self.low).astype(_U)))

    def span_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return W.mix((self._total[b] - self._total[a]) * self._inverse[a] + (b - a).astype(_U))

    def strings(self, chosen: np.ndarray) -> np.ndarray:
        """Places of all strings of these contexts."""
        many = self.high[chosen] - self.low[chosen] + 1
        total = np.cumsum(many)
        return np.repeat(self.low[chosen] - (total - many), many) + np.arange(total[-1] if len(total) else 0)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 200, gram: int = 64, most_contexts: int = 2000, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Key, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay); the columns to carry in a struct ``carried``.

    ``as_text`` makes ``kept`` a string; parts of a character that was cut go with the cut.

    A byte goes if it lies in a string of ``size`` bytes that also starts anywhere else, in the same
    text or another; all copies go. Null text counts as empty. Rows count each for itself, also when
    they repeat a key or have none. Whole contexts and the strings of anchors with more than
    ``most_contexts`` contexts are compared by 64-bit hashes within hashed buckets, others by bytes.
    """
    df = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []))
    carry, name, key, text = df.columns[2:], key, "_key", "_text"
    _, pages, buckets = P.sizes(df, text, PAGE_BYTES)
    docs = P.dealt(df, key, text, carry, pages)
    own = "_bucket int, _page int, _kind int, _a binary, _b binary, _c binary"

    def answer(bucket, page, kind, a, b, c) -> pa.Table:
        return pa.table({
            "_bucket": pa.array(bucket, pa.int32()), "_page": pa.array(page, pa.int32()), "_kind": pa.array(kind, pa.int32()),
            "_a": pa.array(a, pa.binary()), "_b": pa.array(b, pa.binary()), "_c": pa.array(c, pa.binary()),
        })

    def anchors(table: pa.Table) -> pa.Table:
        page = _Page(table, text, size, gram)
        context, one, times = np.unique(page.context, return_index=True, return_counts=True)
        bucket = P.bucket_of(page.hash[one], buckets)
        order = np.argsort(bucket, kind="stable")
        ids, (a, b, c) = P.cut(bucket[order], P.pack(page.hash[one][order], 5), context[order], (times[order] > 1).astype(np.uint8))
        return answer(ids, [table.column("_page")[0].as_py()] * len(ids), [0] * len(ids), a, b, c)

    def judge(table: pa.Table) -> pa.Table:
        parts = P.blobs(table, "_b")
        anchor, context = P.unpack(P.blobs(table, "_a"), 5), np.frombuffer(b"".join(parts), _U)
        multi = np.frombuffer(b"".join(P.blobs(table, "_c")), np.uint8)
        owner = np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts])
        # A page's number decides which of equal contexts stands for them, whatever order rows come in.
        page = np.array(table.column("_page").to_pylist())[owner]
        order = np.lexsort((page, context))
        new = np.concatenate([[True], context[order][1:] != context[order][:-1]])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        chosen = np.zeros(len(order), bool)
        chosen[order[new]] = True
        full = (np.bincount(group, 1 + multi) > 1)[group]
        _, code = np.unique(anchor, return_inverse=True)
        contexts = np.bincount(code, chosen)[code]
        asked = chosen & (contexts > 1)
        state = (full * FULL + (asked & (contexts <= most_contexts)) * SEND + (asked & (contexts > most_contexts)) * SPREAD).astype(np.uint8)
        some = np.flatnonzero(state)
        rows, (b, c) = P.cut(owner[some], context[some], state[some])
        at = table.select(["_bucket", "_page"]).take(pa.array(rows))
        return answer(at.column(0).to_pylist(), at.column(1).to_pylist(), [0] * len(rows), [b""] * len(rows), b, c)

    def states(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        context = np.frombuffer(b"".join(P.blobs(found, "_b")), _U)
        state = np.frombuffer(b"".join(P.blobs(found, "_c")), np.uint8)
        order = np.argsort(context)
        return context[order], state[order]

    def look(context: np.ndarray, known: np.ndarray, state: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(context), np.uint8)
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        return np.where(known[at] == context, state[at], 0).astype(np.uint8)

    def send(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows or not found.num_rows:
            return answer([], [], [], [], [], [])
        page, number = _Page(table, text, size, gram), table.column("_page")[0].as_py()
        state = look(page.context, *states(found))
        _, one = np.unique(page.context, return_index=True)
        once = np.zeros(len(state), bool)
        once[one] = True
        sent = np.flatnonzero(once & (state & SEND > 0))
        bucket = P.bucket_of(page.hash[sent], buckets)
        sent, bucket = sent[np.argsort(bucket, kind="stable")], np.sort(bucket)
        spans = np.array([page.data[a:b].tobytes() for a, b in zip(page.low[sent].tolist(), (page.high[sent] + size).tolist(), strict=True)], object)
        ids, (b, c) = P.cut(bucket, page.context[sent], state[sent])
        at = np.searchsorted(bucket, np.append(ids, buckets)) if len(ids) else np.zeros(1, np.int64)
        lengths = (page.high[sent] + size - page.low[sent]).astype(np.int32)
        a = [lengths[x:y].tobytes() + b"".join(spans[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        first = answer(ids, [number] * len(ids), [0] * len(ids), a, b, c)
        spread = np.flatnonzero(state & SPREAD > 0)
        if not len(spread):
            return first
        place = page.strings(spread)
        # Strings of a context that occurs elsewhere too count twice.
        twice = np.repeat(state[spread] & FULL, page.high[spread] - page.low[spread] + 1)
        values, code, times = np.unique(page.span_hash(place, place + size), return_inverse=True, return_counts=True)
        multi = ((times > 1) | (np.bincount(code, twice) > 0)).astype(np.uint8)
        bucket = P.bucket_of(values, buckets)
        order = np.argsort(bucket, kind="stable")
        ids, (b, c) = P.cut(bucket[order], values[order], multi[order])
        return pa.concat_tables([first, answer(ids, [number] * len(ids), [1] * len(ids), [b""] * len(ids), b, c)])

    def compare(table: pa.Table) -> pa.Table:
        parts, flags = P.blobs(table, "_b"), P.blobs(table, "_c")
        bucket, page, kind = (table.column(c).to_pylist() for c in ("_bucket", "_page", "_kind"))
        owner = np.repeat(np.arange(len(parts)), [len(p) // 8 for p in parts])
        values, flag = np.frombuffer(b"".join(parts), _U), np.frombuffer(b"".join(flags), np.uint8)
        if kind[0] == 1:
            _, code = np.unique(values, return_inverse=True)
            shared = (np.bincount(code, 1 + flag) > 1)[code]
            rows, (b,) = P.cut(owner[shared], values[shared])
            return answer([bucket[r] for r in rows], [page[r] for r in rows], [1] * len(rows), [b""] * len(rows), b, [b""] * len(rows))
        lengths, texts = [], []
        for blob, p in zip(P.blobs(table, "_a"), parts, strict=True):
            head = len(p) // 8 * 4
            lengths.append(np.frombuffer(blob[:head], np.int32))
            texts.append(blob[head:])
        lengths = np.concatenate(lengths).astype(np.int64)
        starts = repeated_starts(np.frombuffer(b"".join(texts), np.uint8), lengths, size)
        # For each context that stands alone: which of its strings occur elsewhere, one bit each.
        at = np.concatenate([[0], np.cumsum(lengths)])
        wide = size - gram + 1
        bits = np.zeros((len(lengths), (wide + 7) // 8 * 8), bool)
        count = np.minimum(lengths - size + 1, wide)
        line = np.repeat(np.arange(len(lengths)), count)
        column = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
        bits[line, column] = starts[at[line] + column]
        some = np.flatnonzero(bits.any(1) & (flag & FULL == 0))
        rows, (a, b) = P.cut(owner[some], np.packbits(bits[some], 1), values[some])
        return answer([bucket[r] for r in rows], [page[r] for r in rows], [2] * len(rows), a, b, [b""] * len(rows))

    kind = pa.string() if as_text else pa.binary()
    fields = [(key, None), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", kind)]

    def cut_out(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            schema = [table.schema.field(key), *(pa.field(n, t) for n, t in fields[1:]), *(table.schema.field(c) for c in carry)]
            return pa.Table.from_batches([], pa.schema(schema))
        page = _Page(table, text, size, gram)
        kinds = np.array(found.column("_kind").to_pylist(), np.int64)
        of = [found.filter(pa.array(kinds == k)) for k in range(3)]
        state = look(page.context, *states(of[0]))
        places = [page.strings(np.flatnonzero(state & FULL > 0))]
        if of[1].num_rows and len(page.low):
            every = page.strings(np.flatnonzero(state & SPREAD > 0))
            places.append(every[P.isin(page.span_hash(every, every + size), np.sort(np.frombuffer(b"".join(P.blobs(of[1], "_b")), _U)))])
        if of[2].num_rows:
            known = np.frombuffer(b"".join(P.blobs(of[2], "_b")), _U)
            bits = np.unpackbits(np.frombuffer(b"".join(P.blobs(of[2], "_a")), np.uint8).reshape(len(known), -1), axis=1)
            order = np.argsort(known)
            at = np.minimum(np.searchsorted(known[order], page.context), len(known) - 1)
            mine = np.flatnonzero(known[order][at] == page.context)
            line, column = np.nonzero(bits[order[at[mine]]])
            places.append(page.low[mine[line]] + column)
        removed = W.covered(np.concatenate(places), size, len(page.data))
        begins = removed.copy()
        begins[1:] &= ~removed[:-1] | (page.row[1:] != page.row[:-1])
        gone, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[page.at]).astype(np.int64) for x in (removed, begins))
        stays = page.data[~removed].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.diff(page.at) - gone)]).tolist()
        kept = [stays[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if as_text:
            kept = [x.decode(errors="ignore") for x in kept]
        out = {key: table.column(key), "n_bytes": pa.array(np.diff(page.at).astype(np.int64)), "n_removed": pa.array(gone), "n_spans": pa.array(spans), "kept": pa.array(kept, kind)}
        return pa.table(out | {c: table.column(c) for c in carry})

    by_page = docs.groupBy("_page")
    judged = by_page.applyInArrow(anchors, own).groupBy("_bucket").applyInArrow(judge, own)
    sent = by_page.cogroup(judged.groupBy("_page")).applyInArrow(send, own)
    compared = sent.groupBy("_bucket", "_kind").applyInArrow(compare, own)
    out = schema_of(df, [key], ("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept", StringType() if as_text else BinaryType()))
    out = StructType([*out.fields, *(df.schema[c] for c in carry)])
    return by_page.cogroup(judged.unionByName(compared).groupBy("_page")).applyInArrow(cut_out, out).withColumnRenamed(key, name)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
