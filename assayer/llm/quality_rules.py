"""Quality rules: text statistics and a learned decision list.

Statistics come from whole texts. Sequential covering learns, from labelled statistics, an ordered
list of threshold conjunctions that reject a text; the list is emitted as one Spark conditional.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import words as W
from assayer.llm.tables import fitted, materialize, read

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_lower", "n_bangs")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_row(mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def repeated_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier one."""
    full = [x for x in lines if x.strip()]
    return len(full) - len(set(full))


def statistics(batches: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, text):
        column = W.plain(batch.column(text))
        w = W.words(column)
        hashes = w.hashes()
        rolled, at = W.windows(hashes, w.doc, WINDOW)
        own = W.mix(rolled ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, code, times = np.unique(own, return_inverse=True, return_counts=True)
        repeated = W.covered(at[times[code] > 1], WINDOW, len(hashes))
        order = np.lexsort((hashes, w.doc))
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
        data, text_at = w.data, w.text_at
        blob = data.tobytes()
        ends = [(a, b) for a, b in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)]
        counts = {
            "n_words": w.counts,
            "word_chars": _per_row(((data & 0xC0) != 0x80) & ~W._SPACE[data], text_at),
            "n_symbols": _per_row(_SYMBOL[data], text_at),
            "n_dup_lines": np.array([repeated_lines(blob[a:b].split(b"\n")) for a, b in ends], np.int64),
            "n_repeat_words": _per_row(repeated, w.first),
            "n_distinct_words": _per_row(new, w.first),  # words of a row are next to each other in this order too
            "n_upper": _per_row((data >= 65) & (data <= 90), text_at),
            "n_lower": _per_row((data >= 97) & (data <= 122), text_at),
            "n_bangs": _per_row(data == 33, text_at),
        }
        yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], [key, *COUNTS])


def text_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and counts of each row's whole text; null text counts as empty. Other columns are left out.

    Windows are compared by 64-bit hashes within one text.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lambda it: statistics(it, key, text), ", ".join([f"{key} {kind}", *(f"{c} long" for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Shares that the list sets thresholds on, as (numerator, denominator) of counts.
SHARES = {
    "symbols_a_word": ("n_symbols", "n_words"),
    "duplicate_lines_a_word": ("n_dup_lines", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "lower_share": ("n_lower", "word_chars"),
    "bangs_a_word": ("n_bangs", "n_words"),
}


def features(df: DataFrame) -> DataFrame:
    """Adds the shares; 0 where there is nothing to divide by."""
    shares = {name: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) for name, (a, b) in SHARES.items()}
    return df.withColumns(shares | {"words": F.col("n_words").cast("double")})


FEATURES = [*SHARES, "words"]


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    at: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] >= self.at if self.above else x[:, self.feature] < self.at


def _match(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: list[np.ndarray]) -> list[Condition]:
    """Adds the condition of the largest information gain until no good row is covered."""
    rule: list[Condition] = []
    held = np.ones(len(x), bool)
    while len(rule) < most:
        p0, n0 = (bad & held).sum(), (~bad & held).sum()
        if not p0 or not n0:
            break
        before, best, gain = math.log2(p0 / (p0 + n0)), None, 1e-9
        for f, values in enumerate(cuts):
            place = np.searchsorted(values, x[held, f], "right")
            p = np.bincount(place[bad[held]], minlength=len(values) + 1)
            n = np.bincount(place[~bad[held]], minlength=len(values) + 1)
            for above in (True, False):
                ps, ns = (p[::-1].cumsum()[::-1][1:], n[::-1].cumsum()[::-1][1:]) if above else (p.cumsum()[:-1], n.cumsum()[:-1])
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - before), 0)
                if len(gains) and gains.max() > gain:
                    gain, best = gains.max(), Condition(f, above, float(values[gains.argmax()]))
        if best is None:
            break
        rule.append(best)
        held &= best.holds(x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.9, seed: int = 7) -> list[list[Condition]]:
    """Ordered conjunctions that cover ``bad`` rows: each is grown on two thirds and pruned on the rest.

    A rule enters the list only if it is right in ``precision`` of the rows it covers. No rows, or
    rows of one kind only, give an empty list.
    """
    rules: list[list[Condition]] = []
    if not len(x) or bad.all() or not bad.any():
        return rules
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 257)[1:])) for f in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, np.quantile(x[bad, f], np.linspace(0, 1, 65))])) for f, c in enumerate(cuts)]
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and (left & bad).any():
        rule = _grow(x[left & part], bad[left & part], max_conditions, cuts)
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            m = _match(r, x) & left & ~part
            p, n = (m & bad).sum(), (m & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        m = _match(rule, x) & left
        if (m & bad).sum() < max(1, precision * m.sum()):
            break
        rules.append(rule)
        left &= ~m
    return rules


def verdict(rules: list[list[Condition]], names: list[str]) -> Column:
    """The list as one conditional: the first rule that holds rejects, else the text is kept."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & (F.col(names[c.feature]) >= c.at if c.above else F.col(names[c.feature]) < c.at)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def decide(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = 20_000) -> DataFrame:
    """Key, counts, shares, ``base_failed`` and ``kept`` for every row.

    The list is learnt on at most ``max_labelled`` labelled rows, those whose hashed key is smallest;
    label 0 means reject, null labels are left out. Without labels all that passes the base is kept. It is
    learnt in one task, and the driver gets the rules alone. Null texts count as empty, so they fail the base. Repeated rows and
    rows without a key are judged each for itself, but of a labelled key one row teaches, the first by its counts, with the least of
    its labels. Other columns are left out; an empty table gives no rows.
    """
    stats = features(materialize(text_statistics(df, key, text))).withColumn("base_failed", base_failed())
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_label")).orderBy(F.xxhash64(key), key).limit(max_labelled)
    rows = stats.join(F.broadcast(chosen), key).where("not base_failed")  # max_labelled keys at most
    rows = rows.groupBy(key).agg(F.min(F.struct(*FEATURES, "_label")).alias("r")).select("r.*")  # and a row for each
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(fitted(rows, learnt), FEATURES))


def learnt(rows: pa.Table) -> list[list[Condition]]:
    """Rules from such rows, whatever their order."""
    if not rows.num_rows:
        return []
    rows = rows.sort_by([(c, "ascending") for c in (*FEATURES, "_label")])
    x = np.column_stack([rows.column(c).to_numpy().astype(float) for c in FEATURES])
    return learn(x, rows.column("_label").to_numpy() == 0)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = decide(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
