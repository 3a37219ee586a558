"""Hard negatives, importance resampling and byte pairs against plain versions, on tables made to be awkward."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from assayer.llm import byte_pairs, importance, negatives
from tests.llm.test_operators import AWKWARD

tokenizers_at = pytest.importorskip("public_tokenizers")


# Hard negatives.
def mined(rows, percent=(30, 90), positives=5, most=10):
    """Every anchor against every distinct usable row, by whole numbers."""
    good = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good[(i, label, tuple(v))] = (i, label, [math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for i, label, q in good.values():
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, y, strict=True)), j, other) for j, other, y in good.values() if len(y) == len(q)]
        best = sorted((s, j) for s, j, other in scored if other == label and j != i)[:positives]
        for s, j in best:
            window = sorted((t, k) for t, k, other in scored if other != label and percent[0] * -s <= 100 * -t <= percent[1] * -s)[:most]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(window)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 0.5, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, score double, row string").repartition(3)


def test_negatives(spark):
    pick = np.random.default_rng(3)
    middle = pick.normal(size=(6, 8))
    rows = [(k, [float(x) for x in middle[k % 6] + 0.4 * pick.normal(size=8)], int(pick.integers(0, 3))) for k in range(1500)]
    rows += [(5000 + k, rows[7][1], k % 3) for k in range(700)]  # one vector that a third of all rows hold
    rows += [(400, rows[400][1], rows[400][2])] * 50 + [(None, [1.0] * 8, 1), (9001, None, 1), (9002, [1.0] * 8, None), (9003, [float("nan")] + [1.0] * 7, 1)]
    rows += [(9004, [None] + [1.0] * 7, 1), (9005, [float("inf")] * 8, 1), (9006, [], 1), (9100, [0.0] * 8, 1), (9200, [1.0, 2.0], 1), (9201, [1.5, 2.0], 1), (9202, [0.5, 1.0], 2)]
    df = vectors(spark, rows)
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())
    assert got == mined(rows)
    assert len({r[0] for r in got}) > 10


def test_negatives_of_nothing(spark):
    from pyspark.sql import functions as F

    assert negatives.hard_negatives(vectors(spark, [(1, [1.0], 1)]).where("false"), F.lit(True)).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(1, None, 1), (2, [1.0], None)]), F.lit(True)).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(100, [1.0], 1), (2, [0.5], 2)]), F.lit(True)).collect() == []  # no positives


def test_scores_beyond_doubles():
    big = np.array([[2.0**40, 3.0, 1.0]])
    assert negatives.scores_of(big, np.array([[2.0**15, 1.0, 0.0], [2.0**15, 0.0, 1.0]])).tolist() == [[2**55 + 3, 2**55 + 1]]
    assert negatives.scores_of(big, np.array([[2.0**40, 0.0, 0.0]])).tolist() == [[negatives.MOST]]


def test_bounds_hold():
    """No row of a list scores outside the bounds by which lists are skipped."""
    pick = np.random.default_rng(1)
    x = np.floor(pick.normal(size=(2000, 16)) * 100)
    centroid = negatives.k_means(x[:500], 16)
    own = negatives.nearest(x, centroid)
    radius = np.array([np.sqrt(((x[own == k] - c) ** 2).sum(1)).max(initial=0) for k, c in enumerate(centroid)])
    for q in x[:50]:
        reach = np.linalg.norm(q) * radius[own]
        assert (np.abs(x @ q - (centroid @ q)[own]) <= reach + 1e-6).all()


# Importance resampling.
def resampled(docs, target, percent, longest, buckets, least):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    source, wanted = Counter(b for _, t in docs for b in features(t)), Counter(b for t in target for b in features(t))
    s, t = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in source}
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append((i, len(f), weight, score, len(words(text)) >= least and score is not None))
    order = sorted(((-r[3], r[0]) for r in out if r[4]))
    rank = {x: k + 1 for k, x in enumerate(order[: percent * len(order) // 100])}
    return sorted(((i, n, w, s, rank.get((-s, i)) if ok else None) for i, n, w, s, ok in out), key=repr)


@pytest.mark.parametrize("longest,least,percent", [(1, 20, 10), (3, 1, 50), (2, 0, 100)])
def test_resampling(spark, longest, least, percent):
    pick = random.Random(4)
    vocabulary = ["Alpha", "béta", "GAMMA", "delta9", "漢字", "ß", "İx", "the", "of"]
    docs = [(k, " ".join(pick.choice(vocabulary) for _ in range(pick.randint(0, 60)))) for k in range(100, 700)]
    docs += [(i, t) for i, t, _ in AWKWARD] + [(None, "the of the " * 20)]
    target = ["the of the of Alpha", None, "", "béta-gamma\x7fdelta9"]
    df = spark.createDataFrame([(i, t, 1.0, 2, 3) for i, t in docs], "doc_id long, text string, score double, block int, own int").repartition(4)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(df, aim, percent, longest, 1000, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(docs, target, percent, longest, 1000, least)


def test_resampling_repeated_and_empty(spark):
    """A third of all rows are one row: each has a rank of its own."""
    rows = [(7, "one two three " * 10)] * 400 + [(k, f"word{k} and others " * 9) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    ranks = [r["rank"] for r in importance.resample(df, aim, 50).collect()]
    assert len(ranks) == 1200 and sorted(r for r in ranks if r) == list(range(1, 601))
    assert importance.resample(df.where("false"), aim).collect() == []
    assert len(importance.resample(df, aim.where("false")).collect()) == 1200


def test_matrix_is_sparse_rows(spark, sf_dir):
    """Stored entries are as many as the distinct (document, bucket) pairs, and add up to all features."""
    import pyarrow as pa

    texts = [t for _, t, _ in AWKWARD]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    for block in importance.matrix_blocks(iter([batch]), 2, 50, "id", "text", "long"):
        for _, row_at, bucket, count in importance._entries(block):
            assert len(bucket) == row_at[-1] and (np.diff(row_at) <= 50).all() and bucket.max() < 50 and (count > 0).all()


# Byte pairs.
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers_at.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    pick = random.Random(5)
    signs = [*" \n\t'sdtmrevl1aé½́ 漢🙂\U0001e900՘!.<|", "<|endoftext|>", " '", "'re"]
    out = [t for _, t, _ in AWKWARD] + ["don't we're I'll 'tis ''s '' 's' x's' 've've'LL", "   ", "'s", " 's", "<|endoftext|>", "a <|endoftext|>  <|endoftext|> b", "\x1c\x1d a \x85 b\xa0c "]
    out += ["".join(pick.choice(signs) for _ in range(pick.randint(1, 60))) for _ in range(1500)]
    out += ["".join(chr(c) for c in (pick.randrange(0x110000) for _ in range(30)) if not 0xD800 <= c <= 0xDFFF) for _ in range(500)]
    return out


def test_byte_pairs(spark, library):
    texts = odd_texts()
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string").repartition(4)
    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in byte_pairs.encode(df, tokenizers_at.path("byte_bpe_50k.json")).collect()}
    expected = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[k][0] for k in range(len(texts))] == expected
    assert [got[k][1] for k in range(len(texts))] == [library.decode(ids, skip_special_tokens=False) for ids in expected]
    assert byte_pairs.encode(df.where("false"), tokenizers_at.path("byte_bpe_50k.json")).collect() == []


def test_decoding_of_any_ids(spark, library):
    pick = random.Random(6)
    lists = [[pick.randrange(50257) for _ in range(pick.randint(0, 30))] for _ in range(300)]
    df = spark.createDataFrame([*enumerate(lists), (300, None), (301, [None, 99999, -1, 50256])], "doc_id long, ids array<int>").repartition(3)
    got = {r["doc_id"]: r["decoded"] for r in byte_pairs.decode(df, tokenizers_at.path("byte_bpe_50k.json")).collect()}
    assert [got[k] for k in range(300)] == [library.decode(ids, skip_special_tokens=False) for ids in lists]
    assert (got[300], got[301]) == ("", "<|endoftext|>")


def test_merges_skip_stale_entries(library):
    """Words in which the same pairs overlap again and again."""
    with open(tokenizers_at.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        merges = byte_pairs.Merges(f.read())
    for word in ("aaaaaaaaaaaaaaaaa", "ababababab", "thethethethe", "eeeeeeeeettttttttt", "-" * 101, "x" * 5000):
        assert merges.merge(word.encode()) == library.encode(word, add_special_tokens=False).ids


# Queries.
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_importance"])
def test_query(spark, sf_dir, name):
    from assayer.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, wanted = QUERIES[name](spark, sf_dir).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(wanted.column_names)
    assert sorted(map(repr, got.select(columns).to_pylist())) == sorted(map(repr, wanted.select(columns).to_pylist()))


def test_query_of_byte_pairs(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in byte_pairs.op13_byte_pairs(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        row = got[r["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
