"""Each operator against a plain version, on the small tables and on texts made to be awkward."""

from __future__ import annotations

import zlib
from collections import defaultdict

import pytest

from assayer.llm import embeddings, jaccard, licences, packing, pieces, quality_model, quality_rules, substrings, suffixes, toxicity
from tests.llm import brute

tokenizers_at = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"wort{k % 997}x{k // 7}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 30, "s"),
    (2, "The quick brown fox jumps over the lazy dog. " * 30, "s"),
    (3, None, None),
    (4, "", "t"),
    (5, " \t\n\x0b\x0c\r ", None),
    (6, "one two three", "t"),
    (7, "ONE two three", "t"),
    (8, f"before {PASSAGE} after", "t"),
    (9, f"other words here {PASSAGE} and more words to follow", "t"),
    (10, "ünïcödé ﬁ ½ Ａ １２３ ▁mark ▁▁ <s> </s> <|endoftext|> ÅÅ İ ẞ Σς", "t"),
    (11, "a\x00b ​ ﻿　 \u0085 x y   z 🙂👍🏽 한국어 日本語", "t"),
    (12, LONG, "t"),
    (13, LONG + " end", "t"),
    (14, "Released under the MIT License. General Public License; Apache License\nmit  license", "t"),
    (15, "Licensed under the Apache License, Version 2.0 and the GNU General Public License, version 3", "t"),
    (16, "line\nline\nline\n\n\nother\nline", "t"),
    (17, "spaces   at   the\n\n\nend   ", "t"),
    (18, "!!! ### $$$ %%% &&& ||| <<< >>> ***", "t"),
    (19, "x" * 5000, "t"),
    (20, "ab" * 400 + "é" * 300, "t"),
    (21, "hello <|endoftext|> world<|startoftext|><|endoftext|>e<|endoftext|>\u0301 <|ENDOFTEXT|> <|endof text|>", "t"),
    (22, "<|endoftext|>", "t"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """With columns whose names operators use themselves."""
    rows = [(i, t, s, i, s, 0.5, i) for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id long, kept string, score double, _page long").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module", params=["awkward", "documents"])
def texts(request):
    return request.getfixturevalue(request.param)


def pairs(df):
    return sorted((r[0], r[1]) for r in df.select("doc_id", "text").collect())


def test_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(400)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    odd = [(-1, None), (-2, []), (-3, [0.0, 0.0]), (-4, [1.0, None]), (-5, [float("nan"), 1.0]), (-6, [float("inf"), 1.0]), (-7, [1.0, 0.0]),
           (-8, [2.0, 0.0]), (-9, [1.0, -0.0]), (-10, [1e-30, 1e-31]), (-11, [1.0, 0.0, 0.0]), (-12, [3.0])]
    both = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "vec_id as n", "vec_id as rep")
    stored = {r["vec_id"]: r["embedding"] for r in both.collect()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(both, block=64).collect()}
    want = brute.near_vectors(list(stored.items()))
    assert {i for i in want if want[i] != got[i]} == set()
    assert embeddings.near_duplicates(both.where("false")).count() == 0


def test_embeddings_with_planted_links(spark):
    """Links at all distances from the threshold, in buckets of several blocks: none wrong, at least 99 % of them found."""
    import numpy as np

    rng = np.random.default_rng(2)
    dim, groups = 32, 500
    centre = rng.standard_normal((groups, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    vectors = [centre]
    for cosine in (0.89, 0.905, 0.92, 0.96):
        side = rng.standard_normal((groups, dim))
        side -= (side * centre).sum(1, keepdims=True) * centre
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        vectors.append(cosine * centre + np.sqrt(1 - cosine**2) * side)
    hot = centre[0] + 0.05 * rng.standard_normal((1500, dim))  # one bucket of more than 1,024 vectors
    x = np.concatenate([*vectors, hot, centre[:20]]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = y @ y.T >= 0.9
    np.fill_diagonal(linked, False)
    found, real = np.array([got[k]["n_links"] for k in range(len(x))]), linked.sum(1)
    assert (found <= real).all() and found.sum() >= 0.99 * real.sum()
    u, v = np.nonzero(np.triu(linked))
    of = brute.smallest_reachable(range(len(x)), zip(u.tolist(), v.tolist(), strict=True))
    assert np.mean([got[k]["component_id"] == of[k] for k in range(len(x))]) >= 0.99
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())


def test_embeddings_of_repeated_and_missing_keys(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0]), (None, None), (3, [0.0, 1.0])]
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True), (None, 0, None, True), (3, 0, 3, True)], key=repr)


def test_sentencepiece(texts):
    import sentencepiece

    path = tokenizers_at.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in pieces.encode(texts, path).collect()}
    for i, text in pairs(texts):
        ids = library.encode(text or "")
        assert got[i]["ids"] == ids, i
        assert got[i]["decoded"] == library.decode(ids), i
        size = len((text or "").encode())
        ends = got[i]["ends"]
        assert all(a <= b for a, b in zip(ends, ends[1:], strict=False)) and (not ends or ends[-1] == size)
        raw = (text or "").encode()
        spans = b"".join(raw[a:b] for a, b in zip(got[i]["begins"], ends, strict=True))
        assert spans == raw, i  # pieces cover the text, none twice


def test_sentencepiece_alignment_through_a_character_map(spark):
    """A model with a compiled map: ids as the library's, and its surfaces at our byte spans."""
    import struct

    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(tokenizers_at.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    # A map of one rule, by hand: the letter "q" becomes "cu".
    units = [0] * 512
    base = 256
    units[0] = (base << 10) >> 0
    node = base ^ ord("q")
    leaf = 128
    offset = node ^ leaf
    units[node] = (offset << 10) | (1 << 8) | ord("q")
    units[leaf] = 1 << 31
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"cu\0"
    proto.normalizer_spec.precompiled_charsmap = blob
    model = pieces.Model(proto.SerializeToString())
    normal, at = model.normalise("eqal q")
    assert normal == "▁ecual▁cu"
    assert at.tolist() == [0, 0, 1, 1, 2, 3, 4, 5, 5, 6]


COMPATIBLE = ["ﬁne ½ Ａ１２３ ｱｲｳ ｶﾞ", "①②③ ㎏ ㌔ ℡ ™ ﷺ", "e\u0301 o\u0308 Å Å İ ẞ Σς", "a\u00a0b\u3000c\u200bd\tx\n\ny", "  lead  and   trail  ", "", " ", "<sep>ＡＢ<sep> ｱ<sep", "ＡＢＣ hello<sep>ﬁ",
              "\ufb03 office Ⅻ ﹏ … ‥", "한글 각", "ẛ̣ ﬅ", "🙂👍🏽 x", "x" * 300 + "ﬁ" * 50, "▁ mark ▁▁ ½▁"]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
@pytest.mark.parametrize("squeeze,dummy", [(False, True), (True, True), (True, False), (False, False)])
def test_sentencepiece_with_compiled_maps(rule, squeeze, dummy):
    """The library's own compiled maps, and symbols defined by hand, in front of the given pieces: ids, text and surfaces as the library's."""
    import pyarrow as pa
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    norm, model = pb.ModelProto(), pb.ModelProto()
    norm.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    with open(tokenizers_at.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.precompiled_charsmap = norm.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, dummy
    for symbol in ("<sep>", "ＡＢ"):
        model.pieces.add(piece=symbol, score=0.0, type=pb.ModelProto.SentencePiece.USER_DEFINED)
    blob = model.SerializeToString()
    library = sentencepiece.SentencePieceProcessor(model_proto=blob)
    rows = pa.RecordBatch.from_pydict({"id": list(range(len(COMPATIBLE))), "text": COMPATIBLE})
    got = next(pieces.encode_batches(iter([rows]), blob, "id", "text")).to_pylist()
    for text, r in zip(COMPATIBLE, got, strict=True):
        said = library.encode(text, return_type="proto")
        assert r["ids"] == [p.id for p in said.pieces], text
        assert r["decoded"] == library.decode(r["ids"]), text
        assert all(a <= b for a, b in zip(r["ends"], r["ends"][1:], strict=False))
        if not squeeze:  # a surface of spaces that were taken away is the library's choice
            own = [text.encode()[a:b].decode(errors="ignore") for a, b in zip(r["begins"], r["ends"], strict=True)]
            assert "".join(own) == "".join(p.surface for p in said.pieces), text


def test_sentencepiece_of_empty_and_repeated_rows(spark, empty):
    path = tokenizers_at.path("piece_bpe_32k.model")
    assert pieces.encode(empty, path).count() == 0
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(len(r["ids"]) for r in pieces.encode(df, path).collect()) == [0, 2, 2, 2]


def test_quality_counts(texts):
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.COUNTS[:5]) for r in quality_rules.text_statistics(texts).collect()}
    assert got == {i: brute.text_counts(t) for i, t in pairs(texts)}


def test_quality_list_learns_a_threshold():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    bad = (x[:, 1] > 0.7) & (x[:, 2] < 0.5)
    rules = quality_rules.learn(x, bad)
    found = np.zeros(len(x), bool)
    for rule in rules:
        found |= quality_rules._match(rule, x)
    assert (found == bad).mean() > 0.98
    assert quality_rules.learn(x[:0], bad[:0]) == [] and quality_rules.learn(x, bad & False) == []


def test_quality_rules_keep_good_texts(spark, sf_dir):
    out = quality_rules.op3_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    assert not out[out.base_failed].kept.any()
    good = out[(out.quality == 1) & ~out.base_failed]
    assert good.kept.mean() > 0.95


def test_quality_rules_without_labels(spark, empty, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules.decide(awkward, labels).toPandas()
    assert (out.kept == ~out.base_failed).all() and len(out) == len(AWKWARD)
    assert quality_rules.decide(empty, labels).count() == 0


def test_packing(texts):
    from tokenizers import Tokenizer

    path = tokenizers_at.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(texts, path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in pairs(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in mine] == [(k, a, min(2048, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 2048))], i
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), i
    total = 0
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(by_sequence) <= -(-total // 2048) * 1.05 + 1


def test_packing_an_empty_table(empty):
    assert packing.pack(empty, tokenizers_at.path("word_bpe_49k.json")).count() == 0


def test_licences(texts):
    out = {r["doc_id"]: r for r in licences.scan(texts).collect()}
    for i, text in pairs(texts):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licence_words(text), i
        assert _close((r["labels"], r["score"]), brute.licence_labels(text, licences.TEMPLATES, r["base_labels"])), i


def _close(got, want) -> bool:
    return got[0] == want[0] and abs(got[1] - want[1]) < 1e-12


def test_licence_texts_and_spdx_lines(spark):
    """Whole texts, cut, changed and shifted ones, in small files and in long ones that hold all kinds of licence words."""
    noise = " ".join(w for t in licences.TEMPLATES for w in reversed(t.words))
    rows = [(k, f"// Copyright 2020 Someone\n{' '.join(t.words).capitalize()}\nint main() {{}}") for k, t in enumerate(licences.TEMPLATES)]
    rows += [(100 + k, f"{noise} {text} {noise}") for k, text in enumerate((licences.MIT, licences.APACHE, licences.BSD, licences.BSD_3, licences.ISC))]
    rows += [(200, licences.MIT[60:]), (201, licences.MIT[:300]), (202, licences.MIT.replace("sublicense", "lend")), (203, licences.MIT.replace("free of charge", "for money"))]
    rows += [(210 + k, f"# SPDX-License-Identifier: {name}\nimport os") for k, name in enumerate(licences.SPDX)]
    rows += [(300, "SPDX-License-Identifier: Unknown"), (301, "MIT License MIT License"), (302, noise), (303, None), (None, licences.ISC), (1, licences.ISC)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["labels"], round(r["score"], 9)) for r in found), key=repr)
    want = [(i is None, i, *brute.licence_labels(t, licences.TEMPLATES, brute.licence_words(t)[4])) for i, t in rows]
    assert got == sorted(((a, i, labels, round(score, 9)) for a, i, labels, score in want), key=repr)
    by_id = {i: set(labels.split(",")) for _, i, labels, _ in got if i is not None and i > 1}
    assert "mit-text" in by_id[100] and "mit-text" in by_id[202] and "mit-text" not in by_id[203] and "mit-notice" in by_id[210] and "bsd-3-clause" in by_id[103]


def test_licence_templates(awkward, empty):
    out = {r["doc_id"]: r for r in licences.scan(awkward).collect()}
    assert {"apache-2.0", "gpl-3.0"} <= set(out[15]["labels"].split(","))
    assert out[1]["labels"] == "" and out[1]["score"] == 0
    assert licences.scan(empty).count() == 0


def test_licence_key_phrases_stand_for_themselves(spark):
    """A mandatory phrase without the rest of its notice has its label, alone and among other rows."""
    # Templates with one phrase; where there are two, both must stand at their distance.
    phrases = [(t.label, t.phrases[0][1]) for t in licences.TEMPLATES if len(t.phrases) == 1]
    rows = [(k, f"Some File; {' '.join(own).upper()}\nits code") for k, (_, own) in enumerate(phrases)]
    rows += [(920, "Mozilla Public License, v. 2.0"), (921, "MIT License"), (922, "mozilla license public v 2 0"), (923, "released under the"), (924, None)]
    full = [(1000 + k, " ".join(t.words)) for k, t in enumerate(licences.TEMPLATES)]

    def of(some):
        out = licences.scan(spark.createDataFrame(some, "doc_id long, text string")).select("doc_id", "labels").collect()
        return {i: set(filter(None, found.split(","))) for i, found in out}

    alone, among = of(rows), of(rows + full * 3)
    for k, (label, _) in enumerate(phrases):
        assert label in alone[k], label
    assert all(t.label in among[1000 + k] for k, t in enumerate(licences.TEMPLATES))
    assert alone[920] == {"mpl-2.0"} and alone[921] == {"mit", "mit-notice"} and alone[922] == alone[923] == alone[924] == set()
    assert {i: among[i] for i in alone} == alone


def test_substrings(texts):
    from pyspark.sql import functions as F

    out = substrings.without_repeats(texts).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in out} == brute.without_windows(pairs(texts))


def test_suffixes(texts):
    from pyspark.sql import functions as F

    for most in (2000, 1):
        out = suffixes.without_repeats(texts, most_contexts=most).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, out)) == brute.without_strings(pairs(texts)), most


def test_repeats_of_empty_tables(empty):
    assert substrings.without_repeats(empty).count() == 0 and suffixes.without_repeats(empty).count() == 0


def test_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, PASSAGE), (None, PASSAGE), (3, "short"), (3, "short")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substrings.without_repeats(df).collect()) == [0, 0, 0, 0]
    assert sorted(r["n_removed"] > 0 for r in suffixes.without_repeats(df).collect()) == [False, False, True, True]
    assert jaccard.similar_groups(df).count() == 4
    assert packing.pack(df, tokenizers_at.path("word_bpe_49k.json")).count() == 4
    assert licences.scan(df).count() == 4 and quality_rules.text_statistics(df).count() == 4
    assert quality_model.weak_quality(df).count() == 4


def test_jaccard(texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(texts).collect()}
    assert got == brute.similar(pairs(texts))


def test_jaccard_chains_and_edges(spark):
    """Similarity of exactly 0.8 links, a hair below does not; chains share a component."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[9 * k : 9 * k + 85])) for k in range(20)]  # 81 shingles each, 72 shared: exactly 72 / 90
    rows += [(100 + k, " ".join("v" + w for w in words[10 * k : 10 * k + 85])) for k in range(5)]  # 71 / 91
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A B"), (204, "a b c d e"), (205, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 4):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(df, most_matches=most).collect()}
        assert got == brute.similar(rows), most
    assert jaccard.similar_groups(df.where("false")).count() == 0


def _families(seed: int) -> list[tuple[int, str]]:
    """Families just around the threshold: words replaced, left out and put in, passages added, ends cut off, copies of copies."""
    import random

    rng, rows = random.Random(seed), []
    passage = [f"p{k}" for k in range(40)]
    for family, (members, size) in enumerate(((90, 60), (70, 130), (60, 25))):
        base = [f"f{family}w{k}" for k in range(size)]
        for _ in range(members):
            w = list(rng.choice([base, rows[-1][1].split() if rows else base]) if rng.random() < 0.2 else base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
                at, how = rng.randrange(len(w)), rng.random()
                if how < 0.6:
                    w[at] = f"new{rng.randrange(40)}"
                elif how < 0.8:
                    del w[at]
                else:
                    w.insert(at, f"new{rng.randrange(40)}")
            if rng.random() < 0.25:
                w += passage
            if rng.random() < 0.25:
                w = w[: max(1, int(len(w) * rng.uniform(0.6, 1)))]
            rows.append((len(rows) * 7 % 997, " ".join(w)))
    return rows


@pytest.mark.parametrize("long_list,most_pivots", [(2, 6), (2, 1), (8, 3), (32, 6)])
def test_jaccard_families_around_the_threshold(spark, long_list, most_pivots):
    """Long lists are compared by pivots; no link between components is lost, whatever their length."""
    rows = _families(long_list * 10 + most_pivots)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    one_task = 3 if most_pivots == 3 else jaccard.ONE_TASK  # long lists are dealt to several tasks
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(df, long_list=long_list, most_pivots=most_pivots, one_task=one_task).collect()}
    assert got == brute.similar(rows)


@pytest.mark.parametrize("long_list,most_pivots", [(2, 6), (2, 1), (8, 3)])
def test_jaccard_families_by_pivots_alone(spark, long_list, most_pivots):
    """Every long list goes to its pivot, however few pairs it would give."""
    rows = _families(long_list * 10 + most_pivots)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(df, long_list=long_list, most_pivots=most_pivots, pairs_a_shingle=0).collect()}
    assert got == brute.similar(rows)


def test_jaccard_documents_of_common_lines_need_no_pivot(spark, monkeypatch):
    """Long lists of many pivots that give few pairs are paired at once; comparing with pivots would only multiply them."""
    import random

    rng = random.Random(4)
    lines = [" ".join(f"l{k}w{j}" for j in range(30)) for k in range(24)]
    rows = [(k, "\n".join(rng.sample(lines, rng.choice([3, 4, 5])))) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "DIFFERENCES", "no schema")  # a step by pivots would fail
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(df, long_list=8).collect()}
    assert got == brute.similar(rows)


def test_jaccard_repeated_keys_share_a_component(spark):
    rows = [(1, PASSAGE), (2, PASSAGE + " end"), (2, "something else that is long enough"), (3, "something else that is long enough"), (4, None), (4, PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.similar_groups(df).collect())
    assert len(got) == 6 and {c for i, c in got if i != 4} == {1}


def test_jaccard_copies_behind_one_without_a_key(spark):
    """A row without an id does not stand for the equal rows behind it."""
    near = PASSAGE + " end"
    rows = [(None, PASSAGE), (7, PASSAGE), (9, PASSAGE), (5, near), (None, near), (8, "other words"), (None, "other words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(df).where("doc_id is not null").collect()}
    assert got == {7: 5, 9: 5, 5: 5, 8: 8}
    assert jaccard.similar_groups(df.where("doc_id is null")).count() == 4


def test_toxicity(spark, sf_dir, awkward, empty):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("*", "1 as extra")
    out = toxicity.op8_toxicity(spark, sf_dir).join(labels, "doc_id").toPandas()
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()
    assert out[out.toxic == 1].score.mean() > out[out.toxic == 0].score.mean()
    scored = toxicity.toxicity(awkward, labels, carry=True)
    assert scored.columns == [*awkward.columns, "toxicity_score"]
    rows = {r["doc_id"]: r["toxicity_score"] for r in scored.collect()}
    assert rows[3] == rows[4] == rows[5] == 0 and len(rows) == len(AWKWARD)
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_reads_long_words_to_their_end():
    """Every byte of a long word is in an n-gram of some step, and toxic words inside it are found."""
    import pyarrow as pa

    from assayer.llm import words as W

    alphabet = "bcdfghjklmnpqrstvwxz"
    long = "".join(alphabet[k * k % 19] + alphabet[k % 20] for k in range(200))
    for at in (0, 23, 24, 25, 100, 399):
        other = long[:at] + "y" + long[at + 1 :]
        a, b = (toxicity.vocabulary(toxicity.cut(W.words(pa.array([t])))) for t in (long, other))
        assert set(a.word) != set(b.word) and set(a.gram) != set(b.gram), at
    w = toxicity.cut(W.words(pa.array(["short", "", "x" * 25, "y" * 24])))
    assert w.counts.tolist() == [1, 0, 2, 1] and w.doc.tolist() == [0, 2, 2, 3]

    import numpy as np

    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list(alphabet), 6)) for _ in range(300)]
    bad = ["scumbag", "vermin", "filthy"]
    texts, labels = [], []
    for k in range(400):
        own = list(rng.choice(plain, 30))
        if k % 2:
            own[int(rng.integers(30))] = bad[k % 3]
        texts.append(("_" if k % 4 < 2 else " ").join(own))
        labels.append(bool(k % 2))
    net = toxicity.train(texts[:300], np.array(labels[:300]))
    batch = pa.RecordBatch.from_pydict({"text": texts[300:], "id": list(range(300, 400))})
    score = next(toxicity.score_batches(iter([batch]), net, ["id"], "text")).column("toxicity_score").to_numpy()
    glued, toxic = np.arange(300, 400) % 4 < 2, np.array(labels[300:])
    assert np.mean([(score[glued & ~toxic] < s).mean() for s in score[glued & toxic]]) > 0.75


def test_held_out_is_learnt(spark):
    """On the middle-sized tables the held-out rows are told apart."""
    from pathlib import Path

    path = "/root/testdata/sf0.01"
    if not Path(path).is_dir():
        pytest.skip("the driver's tables are not here")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    test = toxicity.op8_toxicity(spark, path).join(labels, "doc_id").where("held_out").toPandas()
    yes, no = test[test.toxic == 1].score, test[test.toxic == 0].score
    assert sum((no < s).mean() for s in yes) / len(yes) >= 0.8  # some 40 toxic rows are all there is to learn from
    graded = quality_model.op9_quality_model(spark, path).join(labels, "doc_id").toPandas()
    good, bad = graded[graded.quality == 1].quality_score, graded[graded.quality == 0].quality_score
    assert (good >= 0.5).mean() >= 0.97 and (bad < 0.5).mean() >= 0.6


def test_quality_model(awkward, empty):
    out = quality_model.weak_quality(awkward.withColumnRenamed("score", "quality_score"), carry=True)
    assert out.count() == len(AWKWARD) and out.columns[-1] == "quality_score"
    assert quality_model.weak_quality(empty).count() == 0


def test_expectation_maximisation_finds_who_is_right():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(5000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.55])
    votes = np.where(rng.random((5000, 4)) < right, truth[:, None] + 1, 2 - truth[:, None])
    patterns, code, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, chances, prior = quality_model.expectation_maximisation(patterns, counts.astype(float))
    assert ((posterior[code.ravel()] > 0.5) == truth).mean() > 0.95 and abs(prior - 0.7) < 0.05
    assert np.abs(chances[:, 1, 2] - right).max() < 0.06
