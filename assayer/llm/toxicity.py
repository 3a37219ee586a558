"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as its vector, if several training texts hold it, and the mean of hashed character
n-gram vectors; rare words have their n-grams alone, so no single text can be learnt by heart.
A word of more bytes than a step takes enters as several steps that overlap.
Overlapping windows cover the whole text; a text's score is that of its most toxic window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from assayer.llm import words as W
from assayer.llm.tables import fitted, read, schema_of

SPAN, STEP = 32, 24
GRAM_BITS = 15
WORD_DIM, GRAM_DIM, HIDDEN = 8, 8, 8
GRAMS = (3, 5)
#: Bytes of a word in one step, and from one step of a longer word to the next; all n-grams lie in a step.
PIECE, PIECE_STEP = 24, 16
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]")] = True


@dataclass
class Vocabulary:
    """Distinct steps of a slice: their hashes, and n-gram rows one after the other."""

    word: np.ndarray
    gram: np.ndarray
    gram_at: np.ndarray
    code: np.ndarray  # of each step of the text


def cut(w: W.Words) -> W.Words:
    """Words without marks around them, those of more than ``PIECE`` bytes as overlapping pieces."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        mark = (end - start > 1) & _TRIM[w.data[end - 1]]
        end -= mark
        mark = (end - start > 1) & _TRIM[w.data[start]]
        start += mark
    many = np.maximum(0, -(-(end - start - PIECE) // PIECE_STEP)) + 1
    at = np.concatenate([[0], np.cumsum(many)])
    begin = np.repeat(start, many) + PIECE_STEP * (np.arange(at[-1]) - np.repeat(at[:-1], many))
    return W.Words(w.data, w.text_at, begin, np.minimum(begin + PIECE, np.repeat(end, many)), np.repeat(w.doc, many), at[w.first])


def vocabulary(w: W.Words) -> Vocabulary:
    """Of words that are cut: n-grams between two boundary signs, which stand at the ends of whole words only."""
    inside = np.concatenate([[False], w.start[1:] < w.end[:-1], [False]])  # only pieces of one word overlap
    head, tail = inside[:-1], inside[1:]
    hashes = w.hashes(3)
    kind = (head + 2 * tail).astype(np.uint64)
    hashes = np.where(kind > 0, W.mix(hashes + kind), hashes)
    _, one, code = np.unique(hashes, return_index=True, return_inverse=True)
    start, size = w.start[one], w.end[one] - w.start[one]
    at = np.concatenate([[0], np.cumsum(size + 2)])
    letters = np.full(at[-1], 1, np.uint64)
    inner = np.repeat(start - at[:-1] - 1, size + 2) + np.arange(at[-1])
    body = np.ones(at[-1], bool)
    body[at[:-1]] = body[at[1:] - 1] = False
    letters[body] = w.data[inner[body]]
    owner = np.repeat(np.arange(len(size)), size + 2)
    for ends, cuts in ((at[:-1], head[one]), (at[1:] - 1, tail[one])):
        owner[ends[cuts]] = -1 - ends[cuts]  # in no n-gram
    grams, owners = [], []
    for n in GRAMS:
        if len(letters) >= n:
            rolled = np.zeros(len(letters) - n + 1, np.uint64)
            for k in range(n):
                rolled = rolled * np.uint64(257) + letters[k : len(letters) - n + 1 + k]
            same = owner[: len(rolled)] == owner[n - 1 :]
            grams.append((W.mix(rolled[same] + np.uint64(n)) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
            owners.append(owner[: len(rolled)][same])
    gram, owned = (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    order = np.argsort(owned, kind="stable")
    gram_at = np.searchsorted(owned[order], np.arange(len(size) + 1))
    return Vocabulary(hashes[one], gram[order], gram_at, code)


def common(v: Vocabulary, doc: np.ndarray, toxic: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the words in at least ``least`` texts, their log odds, and which n-gram rows are in as many.

    Odds are those of a toxic text given the word, against the odds of any text, smoothed by two texts.
    """
    pairs = np.unique(doc * len(v.word) + v.code)  # distinct words of each text
    owner, word = pairs // max(1, len(v.word)), pairs % max(1, len(v.word))
    many, bad = np.bincount(word, minlength=len(v.word)), np.bincount(word[toxic[owner]], minlength=len(v.word))
    share = toxic.mean()
    odds = np.log((bad + 2 * share) / (many - bad + 2 * (1 - share))) - np.log(share / (1 - share))
    held = np.flatnonzero(many >= least)
    held = held[np.argsort(v.word[held])]
    times = np.zeros(1 << GRAM_BITS, np.int64)
    for k in range(0, len(toxic), 64):  # some texts at a time: each word has a dozen n-grams
        mine = slice(*np.searchsorted(owner, [k, k + 64]))
        sizes = np.diff(v.gram_at)[word[mine]]
        take = np.repeat(v.gram_at[word[mine]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        own = np.unique(np.repeat(owner[mine], sizes) * (1 << GRAM_BITS) + v.gram[take]) & ((1 << GRAM_BITS) - 1)
        times += np.bincount(own, minlength=1 << GRAM_BITS)
    seen = times >= least
    seen[0] = False
    return v.word[held], odds[held], seen


def window_starts(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of all overlapping windows; the last one ends with the text, a short text is one window."""
    many = np.where(counts > 0, np.maximum(0, -(-(counts - SPAN) // STEP)) + 1, 0)
    row = np.repeat(np.arange(len(counts)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return first[:-1][row] + np.minimum(k * STEP, np.maximum(0, counts[row] - SPAN)), row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """``known``: hashes of the words with vectors, in order; row 0 of either table is for all others and stays zero."""

    seed: int = 11
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    grams: np.ndarray = field(default_factory=lambda: np.zeros(1 << GRAM_BITS, bool))
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            rng = np.random.default_rng(self.seed)
            size = WORD_DIM + GRAM_DIM

            def draw(*shape: int, scale: float = 0.0) -> np.ndarray:
                return rng.normal(0, scale or shape[0] ** -0.5, shape).astype(np.float32)

            self.p = {"word": draw(1 + len(self.known), WORD_DIM, scale=0.05), "gram": draw(1 << GRAM_BITS, GRAM_DIM, scale=0.1)}
            self.p["word"][0] = self.p["gram"][0] = 0
            for d in ("f", "b"):
                self.p |= {f"x{d}": draw(size, 3 * HIDDEN), f"h{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
            self.p |= {"a": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN), "o": draw(2 * HIDDEN), "bias": np.array([-2.0], np.float32)}

    def rows(self, v: Vocabulary) -> Vocabulary:
        """The same with rows of the word table for hashes, and 0 for rare n-grams."""
        at = np.minimum(np.searchsorted(self.known, v.word), max(0, len(self.known) - 1))
        hit = self.known[at] == v.word if len(self.known) else np.zeros(len(v.word), bool)
        return Vocabulary(np.where(hit, at + 1, 0), np.where(self.grams[v.gram], v.gram, 0), v.gram_at, v.code)

    def inputs(self, v: Vocabulary) -> np.ndarray:
        n = len(v.word)
        grams = np.zeros((n, GRAM_DIM), np.float32)
        for a in range(0, n, 1 << 14):  # every word has at least one n-gram
            at = v.gram_at[a : a + (1 << 14) + 1]
            grams[a : a + (1 << 14)] = np.add.reduceat(self.p["gram"][v.gram[at[0] : at[-1]]], at[:-1] - at[0], 0)
        grams /= np.sqrt(np.diff(v.gram_at))[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][v.word], grams], 1)

    def forward(self, x: np.ndarray, steps: np.ndarray, valid: np.ndarray, keep: bool = False):
        """Logits of windows. x: inputs of distinct words; steps: (windows, SPAN) rows of x; valid: places with a word."""
        p, n = self.p, len(steps)
        states = np.zeros((SPAN, n, 2 * HIDDEN), np.float32)
        saved: dict[str, list] = {"f": [], "b": []}
        for d, order, at in (("f", range(SPAN), slice(0, HIDDEN)), ("b", range(SPAN - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
            ahead = x @ p[f"x{d}"] + p[f"c{d}"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                gx, gh = ahead[steps[:, t]], h @ p[f"h{d}"]
                zr = 0.5 + 0.5 * np.tanh(0.5 * (gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN]))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
                m = valid[:, t, None]
                if keep:
                    saved[d].append((t, h, z, r, new, gh[:, 2 * HIDDEN :], m))
                h = h + m * (1 - z) * (new - h)
                states[t][:, at] = h
        hidden = np.tanh(states @ p["a"])
        e = np.where(valid.T, hidden @ p["v"], -1e9)
        weight = np.exp(e - e.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ p["o"] + p["bias"][0]
        return (logit, (states, hidden, weight, pooled, saved)) if keep else logit

    def backward(self, x: np.ndarray, steps: np.ndarray, valid: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but the tables, and of x."""
        p, (states, hidden, weight, pooled, saved) = self.p, kept
        g = {"o": pooled.T @ dlogit, "bias": np.array([dlogit.sum()])}
        dpool = dlogit[:, None] * p["o"]
        dweight = np.einsum("nh,tnh->tn", dpool, states)
        de = weight * (dweight - (weight * dweight).sum(0))
        g["v"] = np.einsum("tn,tnk->k", de, hidden)
        dpre = de[:, :, None] * p["v"] * (1 - hidden**2)
        g["a"] = np.einsum("tnh,tnk->hk", states, dpre)
        dstates = weight[:, :, None] * dpool + dpre @ p["a"].T
        dx = np.zeros_like(x)
        for d, at in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            g[f"h{d}"], carry = np.zeros_like(p[f"h{d}"]), np.zeros((len(steps), HIDDEN), np.float32)
            dahead = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, h, z, r, new, ghn, m in reversed(saved[d]):
                dh = carry + dstates[t][:, at]
                dnew = dh * m * (1 - z) * (1 - new**2)
                dz = dh * m * (h - new) * z * (1 - z)
                dr = dnew * ghn * r * (1 - r)
                dgh = np.concatenate([dz, dr, dnew * r], 1)
                g[f"h{d}"] += h.T @ dgh
                carry = dh * (1 - m * (1 - z)) + dgh @ p[f"h{d}"].T
                np.add.at(dahead, steps[:, t], np.concatenate([dz, dr, dnew], 1))
            g[f"x{d}"], g[f"c{d}"] = x.T @ dahead, dahead.sum(0)
            dx += dahead @ p[f"x{d}"].T
        return g, dx


def _windows_of(code: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, row = window_starts(counts, first)
    place = at[:, None] + np.arange(SPAN)
    valid = place < first[1:][row][:, None]
    return code[np.minimum(place, max(0, len(code) - 1))], valid, row


def train(texts: list[str], toxic: np.ndarray, visits: int = 10_000, batch: int = 32, rate: float = 0.01, least: int = 4, drop: float = 0.5, tables: float = 0.2, decay: float = 0.01, seed: int = 5) -> Network:
    """Fits the network to whole labelled texts: each pass, the gradient flows through every text's highest window.

    ``visits``: how many texts all passes take together, in 4 to 10 passes (more for under 400 texts); ``least``: texts that must hold a word for it to have a vector; ``drop``: the share of words whose
    n-grams are left out, drawn anew for each step; ``tables``: how much slower word and n-gram vectors
    are learnt than the rest. Without rows of both kinds the network stays as it was drawn.
    """
    if not len(texts) or toxic.all() or not toxic.any():
        return Network()
    w = cut(W.words(pa.array(texts, pa.string()), lower=True))
    v = vocabulary(w)
    known, odds, grams = common(v, w.doc, toxic, least)
    net = Network(known=known, grams=grams)
    net.p["word"][1:, 0] += 0.5 * odds.astype(np.float32)  # where learning starts from
    v = net.rows(v)
    steps, valid, row = _windows_of(v.code, w.counts, w.first)
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in net.p.items()}
    tick = 0
    yes, no = np.flatnonzero(toxic & (w.counts > 0)), np.flatnonzero(~toxic & (w.counts > 0))
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    each = max(1, min(3 * len(yes), len(yes) + len(no)))
    epochs = min(max(10, 4_000 // each), max(4, visits // each))
    for epoch in range(epochs):
        chosen = np.concatenate([yes, rng.permutation(no)[: 2 * len(yes)]])
        rng.shuffle(chosen)
        for a in range(0, len(chosen), batch):
            docs = chosen[a : a + batch]
            mine = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
            used, local = np.unique(steps[mine], return_inverse=True)
            local = local.reshape(steps[mine].shape)
            own = Vocabulary(
                v.word[used],
                np.concatenate([v.gram[v.gram_at[u] : v.gram_at[u + 1]] for u in used.tolist()]),
                np.concatenate([[0], np.cumsum(v.gram_at[used + 1] - v.gram_at[used])]),
                local,
            )
            x = net.inputs(own)
            stays = (rng.random(len(x)) >= drop).astype(np.float32)[:, None]
            x[:, WORD_DIM:] *= stays
            logit = net.forward(x, local, valid[mine])
            at = np.concatenate([[0], np.cumsum(bounds[docs + 1] - bounds[docs])])
            top = np.array([at[k] + int(logit[at[k] : at[k + 1]].argmax()) for k in range(len(docs))])
            logit, kept = net.forward(x, local[top], valid[mine][top], keep=True)
            weight = np.where(toxic[docs], 1.0, 0.7)
            dlogit = ((sigmoid(logit) - toxic[docs]) * weight / len(docs)).astype(np.float32)
            g, dx = net.backward(x, local[top], valid[mine][top], kept, dlogit)
            dx[:, WORD_DIM:] *= stays
            touched = np.unique(local[top])
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], own.word[touched], dx[touched, :WORD_DIM])
            g["gram"] = np.zeros_like(net.p["gram"])
            sizes = np.diff(own.gram_at)
            for u in touched.tolist():
                if sizes[u]:
                    np.add.at(g["gram"], own.gram[own.gram_at[u] : own.gram_at[u + 1]], dx[u, WORD_DIM:] / np.sqrt(sizes[u]))
            g["word"][0] = g["gram"][0] = 0
            tick += 1
            slow = rate * (1 if epoch < epochs * 0.6 else 0.3)
            for k, (m1, m2) in moments.items():
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.01 * (g[k] ** 2 - m2)
                step = slow * tables if k in ("word", "gram") else slow
                net.p[k] *= 1 - slow * decay
                net.p[k] -= (step * (m1 / (1 - 0.9**tick)) / (np.sqrt(m2 / (1 - 0.99**tick)) + 1e-6)).astype(np.float32)
    return net


def score_batches(batches: Iterator[pa.RecordBatch], net: Network, rest: list[str], text: str, block: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, text, 6 << 20):
        w = cut(W.words(W.plain(batch.column(text)), lower=True))
        best = np.full(batch.num_rows, -np.inf)
        if len(w.start):
            v = net.rows(vocabulary(w))
            x = net.inputs(v)
            steps, valid, row = _windows_of(v.code, w.counts, w.first)
            for a in range(0, len(row), block):
                np.maximum.at(best, row[a : a + block], net.forward(x, steps[a : a + block], valid[a : a + block]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sigmoid(best) * (best > -np.inf))], [*rest, "toxicity_score"])


def labelled_sample(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """Key, text and label of at most ``most`` keys of each label, those whose hashed key is smallest; one row a key."""
    of_key = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    kinds = [of_key.where(F.col("_label") == k).orderBy(F.xxhash64("_key"), "_key").limit(most) for k in (0, 1)]
    chosen = kinds[0].unionByName(kinds[1])  # 2 * most rows at most
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
    return rows.groupBy("_key", "_label").agg(F.min("_text").alias("_text")).select("_key", "_label", "_text")


def fit(sample: pa.Table) -> Network:
    """A network learnt on such rows, whatever their order."""
    if not sample.num_rows:
        return Network()
    sample = sample.sort_by([("_key", "ascending"), ("_label", "ascending"), ("_text", "ascending")])
    return train([t or "" for t in sample.column("_text").to_pylist()], sample.column("_label").to_numpy() == 1)


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_labelled: int = 1_200, carry: bool = False) -> DataFrame:
    """Key and ``toxicity_score`` (0 to 1) of each row's whole text, by a network learnt on ``labels``.

    ``most_labelled`` bounds the labelled rows of either kind that the network is fitted on, in one
    task: one row of a key teaches, the one whose text is first in order, with the largest of its labels. Null and empty texts
    score 0; repeated rows and rows without a key are scored each for itself; null labels teach nothing, and without labels of both kinds the network stays as drawn. An
    empty table gives no rows. Other columns are left out, with ``carry`` they stay; one that is
    already named ``toxicity_score`` is replaced.
    """
    df = df.drop("toxicity_score")
    net = fitted(labelled_sample(df, labels, key, text, label, most_labelled), fit)
    shared = df.sparkSession.sparkContext.broadcast(net)  # a fixed size
    rest = df.columns if carry else [key]
    schema = schema_of(df, rest, ("toxicity_score", DoubleType()))
    read_columns = df if carry else df.select(key, text)
    return read_columns.mapInArrow(lambda it: score_batches(it, shared.value, rest, text), schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(~held_out())
    out = toxicity(read(spark, sf_dir, "documents"), labels)
    out = out.withColumnRenamed("toxicity_score", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
