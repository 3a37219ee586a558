"""N-gram Jaccard join with adaptive multi-match prefixes.

Each document's distinct word shingles are ordered from rare to frequent by an estimate of fixed size.
A document that shares l of its first n - ceil(t n) + l shingles with no other can have no partner
at similarity t; l grows, document by document, while the longer prefix is estimated to save more
verification than its longer lists cost. Documents with one set of shingles form one class.

Links are found in steps that together miss none. First each document is verified against the
smallest document that it shares most lists with, which connects most of a group of copies. Then only
documents of different components are verified, if they share enough prefix shingles and if what
stands behind the last shared one could still make them similar. Long lists of copies are never paired:
their documents are compared with one of them, the pivot, and meet again by what they do not have in
common with it (``differences``), which is rare by nature. That does not help where documents of common
lines only meet on many lists of different pivots; there pairs are fewer than shingles to read (``_worth``).

Before texts are sent to a pair, its marks are compared: a bit string for each set, in which every shingle
flips one bit. Sets that differ in d shingles have marks that differ in at most d bits, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import words as W
from assayer.llm.graph import components
from assayer.llm.tables import Scratch, materialize, read

_U = np.uint64
SLICES = 64
#: Lists of more documents are compared by a pivot; so many times, what is left then is paired.
LONG_LIST, MOST_PIVOTS = 32, 6
#: A pivot's long lists are paired all the same if that makes at most so many pairs for each shingle that comparing with it reads.
PAIRS_A_SHINGLE = 32
#: Ids, or pairs of ids, that are broadcast.
FEW_IDS = 500_000
#: Words of 64 bits in a set's marks, at least; they double until there are as many bits as shingles.
MARK_WORDS = 4
#: A list that is estimated to hold more documents is dealt to several tasks.
ONE_TASK = 20_000


def sketch_bits(text_bytes: int) -> int:
    """Counters of the frequency estimate: one for each 64 bytes of text, within 64 thousand and 4 million."""
    return min(22, max(16, (text_bytes // 64).bit_length()))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, row by row; a text with fewer words is one shingle."""
    w = W.words(W.plain(column), lower=True)
    hashes = w.hashes(21)
    rolled, at = W.windows(hashes, w.doc, size, 5)
    rows = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    whole = np.zeros(len(short), _U)
    for k in range(size - 1):
        more = w.counts[short] > k
        whole[more] = whole[more] * _U(0x9E3779B97F4A7C15) + hashes[w.first[short[more]] + k]
    rows = np.concatenate([rows, short])
    values = np.concatenate([rolled, W.mix(whole + w.counts[short].astype(_U))])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    at = np.searchsorted(rows, np.arange(n + 1))
    return total[at[1:]] - total[at[:-1]]


def set_marks(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """For each of ``n`` sets words in which each of its shingles has flipped one bit."""
    words = np.full(n, MARK_WORDS, np.int64)
    many = np.bincount(rows, minlength=n)
    while (few := 64 * words < many).any():
        words[few] *= 2
    first = np.concatenate([[0], np.cumsum(words)])
    at = W.mix(values ^ _U(0xD6E8FEB86659FD93)) & (64 * words[rows] - 1).astype(_U)
    marks = np.zeros(first[-1], _U)
    np.bitwise_xor.at(marks, first[rows] + (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(marks.view(np.int64)))


def _may_be_alike(n: Column, marks: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sets of these sizes and marks can be similar enough: if they differ in d shingles, they share (n + m - d) / 2.

    Marks of twice the length are folded first; if one are longer still, sizes alone are compared.
    """

    def apart(a: Column, b: Column) -> Column:
        bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return F.aggregate(bits, F.lit(0), lambda total, more: total + more)

    def folded(a: Column, size: Column) -> Column:
        return F.zip_with(F.slice(a, F.lit(1), size), F.slice(a, size + 1, size), lambda x, y: x.bitwiseXOR(y))

    one, two = F.size(marks), F.size(other)
    least = F.when(one == two, apart(marks, other)).when(one == 2 * two, apart(folded(marks, two), other)).when(two == 2 * one, apart(marks, folded(other, one))).otherwise(F.abs(n - m))
    return 100 * (n + m - least) >= percent * (n + m + least)


def signatures(batches: Iterator[pa.RecordBatch], bits: int, key: str, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """For each text its set's size, two hashes and marks; at the end, this task's part of the frequency estimate."""
    names = ["id", "n", "h1", "h2", "marks", "part", "counts"]
    counts = np.zeros(1 << bits, np.uint32)
    for batch in W.slices(batches, text):
        n = batch.num_rows
        rows, values = shingle_sets(batch.column(text), size)
        np.add.at(counts, (values >> _U(64 - bits)).astype(np.int64), 1)
        signed = [pa.array(_sums(rows, W.mix(values ^ _U(k * 0x632BE59BD9B4E019)), n).view(np.int64)) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), *signed, set_marks(rows, values, n), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    parts = [c.tobytes() for c in _coded(counts).reshape(SLICES, -1)]
    nothing = pa.nulls(SLICES, pa.int64())
    yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.nulls(SLICES, pa.list_(pa.int64())), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)


def _coded(counts: np.ndarray) -> np.ndarray:
    """One byte a counter: itself below 64, above it eight steps for each factor of two."""
    return np.where(counts < 64, counts, np.minimum(255, 64 + np.rint(8 * np.log2(np.maximum(counts, 64) / 64.0)))).astype(np.uint8)


#: What each byte of ``_coded`` stands for.
_VALUES = np.where(np.arange(256) < 64, np.arange(256), 64 * 2.0 ** ((np.arange(256) - 64) / 8)).astype(np.float32)


def _add_up(table: pa.Table, coded: bool) -> pa.Table:
    """Sum of a slice's counters over the tasks of one lane, or over all lanes."""
    total = np.float32(0)
    for part in table.column("counts"):
        own = part.as_buffer()
        total = total + (_VALUES[np.frombuffer(own, np.uint8)] if coded else np.frombuffer(own, np.float32))
    return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def added_up(parts: DataFrame) -> DataFrame:
    """(part, counts) of all tasks, in two steps: a task of either sums about as many rows as the root of their number."""
    lanes = max(1, math.isqrt(parts.where("part = 0").count()))
    by_lane = parts.withColumn("lane", F.spark_partition_id() % lanes).groupBy("part", "lane").applyInArrow(lambda t: _add_up(t, True), "part int, counts binary")
    return by_lane.groupBy("part").applyInArrow(lambda t: _add_up(t, False), "part int, counts binary")


class Frequencies:
    """How many texts hold a shingle, estimated: a counter less what all counters hold on average.

    What lies within four standard deviations of that average counts as nothing, but is still ranked.
    """

    def __init__(self, counts: np.ndarray):
        noise = counts.mean() if len(counts) else 0.0
        excess = counts - noise
        self._excess = np.where(excess > 4 * np.sqrt(noise), excess, 0).astype(np.float32)
        # Eighths of a deviation up to four deviations, then eighths of a factor of two.
        apart = excess / max(1.0, np.sqrt(noise))
        self._rank = np.floor(np.where(apart < 4, 8 * apart, 32 + 8 * np.log2(np.maximum(apart, 4) / 4))).astype(np.int16)
        self._shift = _U(64 - (len(counts) - 1).bit_length())

    def _at(self, values: np.ndarray) -> np.ndarray:
        return (values >> self._shift).astype(np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        return self._excess[self._at(values)]

    def rank(self, values: np.ndarray) -> np.ndarray:
        """Shingles are ordered by their counters, then by hash.

        Also within the noise: of a text's shingles few are in its prefix, and one that many texts hold
        is seldom among those with the smallest counters, where the order of hashes alone would not tell.
        """
        return self._rank[self._at(values)]


def prefixes(batches: Iterator[pa.RecordBatch], often: Frequencies, key: str, text: str, size: int, percent: int, most_matches: int, cost: float, one_task: int) -> Iterator[pa.RecordBatch]:
    """Each document's prefix: (shingle, id, set size, matches required, the shingle's place, which part of its list it is dealt to). Equal sets of a slice are sent once."""
    for batch in W.slices(batches, text):
        rows, values = shingle_sets(batch.column(text), size)
        n = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)
        able = np.flatnonzero((n > 0) & batch.column(key).is_valid().to_numpy(zero_copy_only=False))
        _, one = np.unique(np.stack([n.astype(_U), _sums(rows, W.mix(values ^ _U(5)), len(n))])[:, able], axis=1, return_index=True)
        sent = np.zeros(len(n), bool)
        sent[able[one]] = True
        keep = sent[rows]
        rows, values, n = rows[keep], values[keep], np.where(sent, n, 0)
        order = np.lexsort((values, often.rank(values), rows))
        values = values[order]
        excess = often(values).astype(np.float64)
        first = np.searchsorted(rows, np.arange(len(n) + 1))
        place = np.arange(len(rows)) - first[rows]
        load = np.concatenate([[0], np.cumsum(excess)])
        least = n - -(-percent * n // 100)
        # Estimated cost of each choice: lists to read, and candidates that meet often enough, to verify.
        choices = np.stack([
            np.minimum(n, least + m) + cost * (load[first[:-1] + np.minimum(n, least + m)] - load[first[:-1]]) / m for m in range(1, most_matches + 1)
        ])
        matches = np.minimum(choices.argmin(0) + 1, np.maximum(1, n - least))
        mine = place < (least + matches)[rows]
        r = rows[mine]
        parts = excess[mine].astype(np.int64) // one_task + 1
        spread = W.mix(batch.column(key).fill_null(0).to_numpy()[r].view(_U))
        part = np.where(parts > 1, 1 + (spread % parts.astype(_U)).astype(np.int64), 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values[mine].view(np.int64)), batch.column(key).take(pa.array(r)), pa.array(n[r]), pa.array(matches[r].astype(np.int32)), pa.array(place[mine].astype(np.int32)), pa.array(part.astype(np.int32))],
            ["token", "id", "n", "matches", "place", "part"],
        )


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * shared >= percent * (n + m - shared)


def verify_batches(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, ("left_text", "right_text")):
        n = batch.num_rows
        (r1, v1), (r2, v2) = (shingle_sets(batch.column(c), size) for c in ("left_text", "right_text"))
        k1, k2 = (W.mix(v + r.astype(_U) * _U(0x9E3779B97F4A7C15)) for r, v in ((r1, v1), (r2, v2)))
        both = np.bincount(r1[np.isin(k1, k2)], minlength=n)
        union = np.bincount(r1, minlength=n) + np.bincount(r2, minlength=n) - both
        yield batch.filter(pa.array((100 * both >= percent * union) & (both > 0))).select(["u", "v"])


DIFFERENCES = "pivot long, kind int, token long, rep long, n long, inter long, pivot_n long, linked boolean, left int"
BESIDE, AWAY = 0, 1
#: A rank behind those of all counters.
LAST = 10_000


def differences(batches: Iterator[pa.RecordBatch], often: Frequencies, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """What each document ``rep`` does not have in common with its pivot, as two kinds of prefix; and one row without a token.

    Let i be the shingles that a document shares with the pivot T, q = percent / (100 + percent), and a
    pair (A, B) with o >= q (nA + nB) shared shingles be similar. Not both are similar to T, or T
    connects them. Of o at most min(iA, iB) lie in T. If that is too few, A and B share shingles outside
    T: those are of kind ``BESIDE``. Else one of them is smaller than T. As |A & B & T| =
    iA + iB - |T| + |what both lack of T|, they then share at least q (nA + nT) - iA >= 1 of: shingles outside T, and
    shingles of T that they lack; these are of kind ``AWAY``, A being one that is not similar to T.

    Prefixes are in the order of ``often``: of d shingles of which m must be shared, the first d - m + 1.
    ``left`` counts the shingles from this one on.
    """
    for batch in W.slices(batches, ("left_text", "right_text"), 2 << 20):
        count = batch.num_rows
        (r1, v1), (r2, v2) = (shingle_sets(batch.column(c), size) for c in ("left_text", "right_text"))
        k1, k2 = (W.mix(v + r.astype(_U) * _U(0x9E3779B97F4A7C15)) for r, v in ((r1, v1), (r2, v2)))
        in_pivot, in_rep = np.isin(k1, k2), np.isin(k2, k1)
        n, m, inter = (np.bincount(r, minlength=count).astype(np.int64) for r in (r1, r2, r1[in_pivot]))
        linked = 100 * inter >= percent * (n + m - inter)

        def need(other: np.ndarray, n=n) -> np.ndarray:
            return -(-percent * (n + other) // (100 + percent))

        plus_row, plus = r1[~in_pivot], v1[~in_pivot]
        minus_row, minus = r2[~in_rep], v2[~in_rep]
        at_least = np.maximum(1, need(-(-percent * n // 100)) - inter)
        away = (100 * inter >= percent * n) & (~linked | (n < m))
        shared = np.where(linked, 1, np.maximum(1, need(m) - inter))
        parts = [
            (BESIDE, plus_row, plus, often.rank(plus), at_least, np.ones(count, bool)),
            (AWAY, np.concatenate([plus_row, minus_row]), np.concatenate([plus, W.mix(minus ^ _U(0xA0761D6478BD642F))]),
             np.concatenate([often.rank(plus), np.full(len(minus), LAST, np.int16)]), shared, away),
        ]
        found = [(np.full(count, -1, np.int32), np.zeros(count, np.int64), np.arange(count), np.zeros(count, np.int32))]
        for kind, row, value, rank, least, wanted in parts:
            order = np.lexsort((value, rank, row))
            order = order[wanted[row[order]]]
            row, value = row[order], value[order]
            many = np.bincount(row, minlength=count)
            left = many[row] - (np.arange(len(row)) - (np.cumsum(many) - many)[row])
            mine = left >= least[row]
            found.append((np.full(mine.sum(), kind, np.int32), value[mine].view(np.int64), row[mine], left[mine].astype(np.int32)))
        kind, value, row, left = (np.concatenate(c) for c in zip(*found, strict=True))
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("pivot").take(at), pa.array(kind), pa.array(value), batch.column("rep").take(at), pa.array(n[row]), pa.array(inter[row]), pa.array(m[row]), pa.array(linked[row]), pa.array(left)],
            ["pivot", "kind", "token", "rep", "n", "inter", "pivot_n", "linked", "left"],
        )


def _sides(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one list side by side, the other columns numbered 1 and 2."""
    rest = [c for c in df.columns if c not in keys]
    left, right = (df.select(*keys, *(F.col(c).alias(f"{c}{k}") for c in rest)) for k in (1, 2))
    return left.join(right, keys).where("component1 < component2")


def _different(df: DataFrame, keys: list[str], listed: Column, central: Column) -> DataFrame:
    """Adds ``listed`` (each row meets at most so many others) and ``next`` (a pivot) to rows of lists on which two components meet."""
    lists = df.groupBy(*keys).agg(F.min("component").alias("a"), F.max("component").alias("b"), listed.alias("listed"), F.min(F.struct(central, F.col("rep").alias("rep"))).alias("next"))
    return df.join(lists.where("a < b and listed > 0").select(*keys, "listed", F.col("next.rep").alias("next")), keys)


def _worth(rest: DataFrame, long_list: int, pairs_a_shingle: int) -> DataFrame:
    """Adds to rows of lists whether their list is ``long``: over ``long_list`` documents, and pairs cost more than its pivot does.

    All long lists of one pivot are long together or not at all, as a document is compared with it once for all of them.
    """
    of_rep = rest.where(F.col("listed") > long_list).groupBy("next", "rep").agg(F.sum("listed").alias("pairs"), F.max("n").alias("n"))
    of_pivot = of_rep.groupBy("next").agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n"))
    worth = of_pivot.where(F.col("pairs") > pairs_a_shingle * F.col("n")).select("next", F.lit(True).alias("worth"))
    return rest.join(worth, "next", "left").withColumn("long", F.col("worth").isNotNull() & (F.col("listed") > long_list)).drop("worth")


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, most_matches: int = 4, cost: float = 5.0, long_list: int = LONG_LIST, most_pivots: int = MOST_PIVOTS, one_task: int = ONE_TASK, pairs_a_shingle: int = PAIRS_A_SHINGLE) -> DataFrame:
    """Key, n_shingles, component_id for every row.

    Letters A-Z count as lower-case. Two texts link when their sets of ``size``-word shingles have a
    Jaccard similarity of ``percent`` or more; shingles are 64-bit hashes. Texts without words or null
    link with nothing, and rows without a key have no component. Keys (long) are expected to be unique: rows that
    repeat one come out each for itself, with one component that holds the links of all. Other columns are left
    out; an empty table gives no rows. Lists of more than ``long_list`` documents are compared by
    pivots, up to ``most_pivots`` times in a row, unless they give at most ``pairs_a_shingle`` pairs for each shingle
    that this would read; what is still on a long list then is paired. Lists of an
    estimated size of more than ``one_task`` are dealt to several tasks while they are made.
    """
    scratch = Scratch(df.sparkSession)
    try:
        return _groups(df, scratch, key, text, size, percent, most_matches, cost, long_list, most_pivots, one_task, pairs_a_shingle)
    finally:
        scratch.clear()


def _groups(df: DataFrame, scratch: Scratch, key: str, text: str, size: int, percent: int, most_matches: int, cost: float, long_list: int, most_pivots: int, one_task: int, pairs_a_shingle: int) -> DataFrame:
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    bits = sketch_bits(int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0))
    signed = scratch(docs.mapInArrow(lambda it: signatures(it, bits, "id", "text", size), "id long, n long, h1 long, h2 long, marks array<long>, part int, counts binary"))
    slices = added_up(signed.where("part is not null").select("part", "counts")).collect()  # the estimate, of a fixed size
    counts = np.zeros((SLICES, (1 << bits) // SLICES), np.float32)
    for r in slices:
        counts[r["part"]] = np.frombuffer(r["counts"], np.float32)
    shared = spark.sparkContext.broadcast(Frequencies(counts.ravel()))  # 4 << bits bytes
    rows = signed.where("part is null").select("id", "n", "h1", "h2")
    of_copies = ["n", "h1", "h2"]
    classes = scratch(rows.where("n > 0 and id is not null").groupBy(*of_copies).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    member = materialize(rows.join(classes, of_copies, "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "id")).alias("rep")))
    marks = scratch(signed.where("n > 0 and id is not null").select("id", "n", "marks"))
    scratch.drop(signed, classes)

    def few(ids: DataFrame) -> DataFrame:
        """Up to ``FEW_IDS`` are broadcast, so that what they meet is not shuffled."""
        return F.broadcast(ids) if ids.count() <= FEW_IDS else ids

    of_id = few(member.where("id <> rep").select("id", "rep"))
    of_list = of_id.withColumnsRenamed({"id": "first", "rep": "first_rep"})

    sent = docs.mapInArrow(lambda it: prefixes(it, shared.value, "id", "text", size, percent, most_matches, cost, one_task), "token long, id long, n long, matches int, place int, part int")
    # A shingle of one document only is on no list. Parts of a long list have a first document each, and all stay.
    own_list = Window.partitionBy("token", "part")
    listed = sent.withColumn("first", F.min(F.struct("id", "n")).over(own_list)).withColumn("last", F.max("id").over(own_list)).where("first.id < last or part > 0")
    # Written, so that the shuffle of all prefixes goes before the next ones begin.
    listed = scratch(listed.select("token", "id", "n", "matches", "place", F.col("first.id").alias("first"), F.col("first.n").alias("first_n")))
    scratch.drop()
    # How many of a document's shingles before this one are on no list: no document that shares this one has them.
    before = F.row_number().over(Window.partitionBy("id").orderBy("place")) - 1
    numbered = listed.withColumn("lone", F.greatest(F.col("place") - before, F.lit(0)))
    lists = scratch(
        numbered.join(of_id, "id", "left").withColumn("rep", F.coalesce("rep", "id")).select("token", "rep", "n", "matches", "place", "lone", "first", "first_n")
        .join(of_list, "first", "left")
        .select("token", "rep", "n", "matches", "place", "lone", F.coalesce("first_rep", "first").alias("first"), "first_n")  # equal sets have equal sizes
    )
    scratch.drop(listed)

    def texts_of(*ids: DataFrame) -> DataFrame:
        every = ids[0].toDF("id")
        for more in ids[1:]:
            every = every.unionByName(more.toDF("id"))
        return scratch(docs.join(few(scratch(every.distinct())), "id", "left_semi"))

    def beside(pairs: DataFrame, table: DataFrame, u: str, v: str) -> DataFrame:
        """Pairs with the other columns of ``table`` for either id, as ``left_`` and ``right_`` ones."""
        left, right = (table.select(F.col("id").alias(k), *(F.col(c).alias(f"{side}_{c}") for c in table.columns if c != "id")) for k, side in ((u, "left"), (v, "right")))
        if pairs.count() > FEW_IDS:
            return pairs.join(right, v).join(left, u)  # one more shuffle of the table
        # Only rows that are a pair's first are shuffled, to the pairs that have the other one.
        return F.broadcast(pairs).join(right, v).join(left.join(F.broadcast(pairs.select(u)), u, "left_semi"), u)

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose marks leave it open whether they are similar."""
        alike = _may_be_alike(*map(F.col, ("left_n", "left_marks", "right_n", "right_marks")), percent)
        return scratch(beside(pairs, marks, "u", "v").where(alike).select("u", "v").distinct())

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        out = scratch(beside(pairs, texts, "u", "v").mapInArrow(lambda it: verify_batches(it, size, percent), "u long, v long"))
        scratch.drop()  # texts were shuffled
        return out

    # Each document against the one that is smallest in most of its lists; those without a link then once for each component.
    candidates = scratch(
        lists.where((F.col("rep") != F.col("first")) & _alike(F.col("n"), F.col("first_n"), percent))
        .groupBy("rep", "first").agg(F.count("*").alias("c"), F.max("lone").alias("lone"), F.first("n").alias("n"), F.first("first_n").alias("m"))
        .where(_enough(F.least(F.col("n") - F.col("lone"), F.col("m")), F.col("n"), F.col("m"), percent)).select("rep", "first", "c")
    )
    texts = texts_of(candidates.select("rep"), candidates.select("first"))

    def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()

    tried = scratch(ordered(candidates.groupBy("rep").agg(F.max_by("first", F.struct("c", -F.col("first"))).alias("first")), "first", "rep"))
    links = verified(near(tried), texts)
    named = components(links)
    alone = candidates.join(named.select(F.col("id").alias("rep")), "rep", "left_anti")
    of_first = named.select(F.col("id").alias("first"), F.col("component_id").alias("of"))
    again = alone.join(of_first, "first", "left").groupBy("rep", F.coalesce("of", "first")).agg(F.max_by("first", F.struct("c", -F.col("first"))).alias("first"))
    again = scratch(ordered(again, "first", "rep").join(tried, ["u", "v"], "left_anti"))
    tried, links = tried.unionByName(again), links.unionByName(verified(near(again), texts))
    named = components(links)
    scratch.drop(candidates, texts)
    # What is left to compare: documents of different components on one list.
    of_rep = named.select(F.col("id").alias("rep"), "component_id")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(of_rep, "rep", "left").withColumn("component", F.coalesce("component_id", "rep")).drop("component_id")

    own = placed(lists.select("token", "rep", "n", "matches", "place", "lone").distinct())
    on_lists = scratch(_different(own, ["token"], F.count("*"), F.col("lone")))
    scratch.drop(lists)
    rest = _worth(on_lists, long_list, pairs_a_shingle)
    reach = F.least(F.col("n1") - F.col("lone1"), F.col("n2") - F.col("lone2"))
    # Two documents that meet on short lists only share as many of those as they must; what they share up to the last one is counted.
    met = (
        _sides(rest.where("not long").drop("listed", "next", "long"), ["token"])
        .where(_enough(reach, F.col("n1"), F.col("n2"), percent))
        .groupBy("rep1", "rep2")
        .agg(F.count("*").alias("shared"), F.first(F.least("matches1", "matches2")).alias("need"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max("place1").alias("p1"), F.max("place2").alias("p2"))
        .withColumn("most", F.col("shared") + F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) - 1)
        .where((F.col("shared") >= F.col("need")) & _enough(F.col("most"), F.col("n1"), F.col("n2"), percent))
    )
    found = [scratch(ordered(met, "rep1", "rep2"))]
    keys = ["pivot", "kind", "token"]
    hot = scratch(rest.where("long").select("rep", "next").distinct())
    scratch.drop(on_lists)
    texts = texts_of(hot.select("rep"))
    for step in range(most_pivots):
        to_pivot = scratch(hot.where("rep <> next").select("rep", F.col("next").alias("pivot")).distinct())
        if to_pivot.isEmpty():
            break
        apart = scratch(beside(to_pivot, texts, "rep", "pivot").mapInArrow(lambda it: differences(it, shared.value, size, percent), DIFFERENCES))
        scratch.drop()
        links = links.unionByName(scratch(apart.where("kind = -1 and linked").select(F.col("rep").alias("u"), F.col("pivot").alias("v"))))
        # One of a pair is not similar to the pivot; away from it, the other is smaller than the pivot.
        apart_from, smaller = F.count_if(~F.col("linked")), F.count_if(F.col("n") < F.col("pivot_n"))
        listed = F.when(F.col("kind") == BESIDE, apart_from).otherwise(F.least(apart_from, smaller))
        on_lists = scratch(_different(placed(apart.where("kind >= 0")), keys, listed, -F.col("inter")))
        scratch.drop(to_pivot, apart)
        rest = _worth(on_lists, long_list, pairs_a_shingle)
        short = rest.where("not long") if step < most_pivots - 1 else rest
        n1, n2, least = F.col("n1"), F.col("n2"), F.least("inter1", "inter2")
        left = F.least("left1", "left2")
        most = F.when(F.col("kind") == BESIDE, least + left).otherwise(F.col("inter1") + F.col("inter2") - F.col("pivot_n1") + left)
        inside = _enough(least, n1, n2, percent) & (F.least("n1", "n2") < F.col("pivot_n1"))
        right_kind = F.when(F.col("kind") == AWAY, inside).otherwise(~_enough(least, n1, n2, percent))
        pairs = _sides(short.drop("listed", "next", "long"), keys).where(~(F.col("linked1") & F.col("linked2")) & _alike(n1, n2, percent) & right_kind & _enough(most, n1, n2, percent))
        found.append(scratch(ordered(pairs, "rep1", "rep2")))
        hot = scratch(rest.where("long").select("rep", "next").distinct())
        scratch.drop(on_lists)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = near(scratch(every.distinct().join(tried, ["u", "v"], "left_anti")))
    scratch.drop(texts)
    more = verified(every, texts_of(every.select("u"), every.select("v")))
    final = components(links.unionByName(more)).withColumnRenamed("id", "rep")
    shared.destroy()
    return member.join(final, "rep", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep", "id").alias("component_id")
    )


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents"))


#: DuckDB: pairs that share a shingle, counted; then the smallest id reachable by links.
OP10_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.u = d.doc_id
"""
