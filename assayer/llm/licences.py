"""License scans with DataFrame functions only: a positional index of rare licence words.

Corpus-wide document frequencies order all words of the licence templates, which an index holds with
their positions. Of each file its own rarest licence words are looked up, and of every mandatory key phrase
that it may hold the phrase's rarest word. Each of their places proposes alignments with the templates that hold
the word; the looked-up words must agree at their relative positions there, then key phrases are verified.
As no phrase can stand without its rarest word, no place of one is missed, whatever else the file or other rows hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.tables import read

#: A word is a run of bytes that are neither ASCII marks nor spaces; letters are lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # mandatory, with the place in the template


def split(text: str) -> tuple[str, ...]:
    return tuple(re.findall(WORD, text.lower()))


def template(label: str, text: str, *phrases: str) -> Template:
    """Without phrases the whole text is mandatory."""
    own, found = split(text), []
    for phrase in map(split, phrases or (text,)):
        at = next(i for i in range(len(own)) if own[i : i + len(phrase)] == phrase)
        found.append((at, phrase))
    return Template(label, own, tuple(found))


# The words of public licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = """nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""
GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of
the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either
in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
CC = "This work is licensed under a Creative Commons {0} International License"
#: Identifiers as they stand behind ``SPDX-License-Identifier:``, and their labels.
SPDX = {
    "MIT": "mit-notice", "Apache-2.0": "apache-2.0", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "ISC": "isc", "MPL-2.0": "mpl-2.0", "GPL-2.0": "gpl-2.0",
    "GPL-3.0": "gpl-3.0", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl-3.0", "CC-BY-4.0": "cc-by-4.0", "CC-BY-SA-4.0": "cc-by-sa-4.0", "CC-BY-NC-4.0": "cc-by-nc-4.0",
    "CC0-1.0": "cc0-1.0", "Unlicense": "unlicense",
}
#: What is looked for: notices of one line, whole texts and file headers, and SPDX lines.
TEMPLATES = (
    template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    template("mit-notice", "Released under the MIT License", "mit license"),
    template("gpl-3.0", "licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    template("gpl-2.0", "licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    template("lgpl", "licensed under the GNU Lesser General Public License", "gnu lesser general public license"),
    template("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", "gnu affero general public license version 3"),
    template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    template("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0"),
    template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use in source and binary forms"),
    template("mit-text", MIT, "permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction"),
    template("bsd-2-clause", BSD, "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice"),
    template("bsd-3-clause", BSD_3, "contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    template("isc", ISC, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    template("apache-2.0", APACHE, "you may not use this file except in compliance with the license", "software distributed under the license is distributed on an as is basis"),
    template("mpl-2.0", MPL, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    template("gpl-2.0", GNU.format("General Public License", "2"), "gnu general public license as published by the free software foundation either version 2 of the license"),
    template("gpl-3.0", GNU.format("General Public License", "3"), "gnu general public license as published by the free software foundation either version 3 of the license"),
    template("lgpl", GNU.format("Lesser General Public License", "3"), "gnu lesser general public license as published by the free software foundation"),
    template("agpl-3.0", GNU.format("Affero General Public License", "3"), "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    template("unlicense", UNLICENSE, "this is free and unencumbered software released into the public domain"),
    template("cc-by-4.0", CC.format("Attribution 4.0"), "creative commons attribution 4 0 international license"),
    template("cc-by-sa-4.0", CC.format("Attribution-ShareAlike 4.0"), "creative commons attribution sharealike 4 0 international license"),
    template("cc-by-nc-4.0", CC.format("Attribution-NonCommercial 4.0"), "creative commons attribution noncommercial 4 0 international license"),
    template("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", "cc0 1 0 universal"),
    *(template(label, f"SPDX-License-Identifier: {name}") for name, label in SPDX.items()),
)
#: Phrases of the base labels.
BASE = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}


def word_list(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def rank_words(df: DataFrame, templates: tuple[Template, ...], text: str) -> list[str]:
    """All template words, those found in fewest rows first; one counter for each word reaches the driver."""
    every = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(_literal(every), word_list(text))
    counted = {r["word"]: r["n"] for r in df.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(every, key=lambda w: (counted.get(w, 0), w))


def _literal(words: list[str] | tuple[str, ...]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _stands(words: Column, at: Column, phrase: tuple[str, ...]) -> Column:
    """Whether the phrase begins at this index; an index outside the text matches nothing."""
    return (at >= 0) & F.forall(F.transform(_literal(phrase), lambda w, k: F.coalesce(F.get(words, at + k) == w, F.lit(False))), lambda same: same)


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Indices at which the phrase begins."""
    first = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[-1], i - (len(phrase) - 1))), lambda i: i >= 0)
    return F.filter(first, lambda i: _stands(words, i, phrase[:-1]))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, rarest: int = 8, agree: int = 2) -> DataFrame:
    """Key, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    ``rarest``: how many of a file's own licence words are looked up, by document frequency over the
    whole table, besides the rarest word of each key phrase; ``agree``: how many looked-up words (all that the
    key phrases hold, if fewer) must stand at one alignment. A template counts where all its key phrases stand at their
    places; score is the largest share of a template's words that stand at theirs, and 0.5 at least
    for a base label. Null text counts as empty: no words, empty label lists, score 0. Repeated
    rows and rows without a key are scanned each for itself; other columns are left out; an empty table gives no rows.
    """
    ranked = rank_words(df, templates, text)
    place = {w: k for k, w in enumerate(ranked)}
    rare = [[min(phrase, key=place.__getitem__) for _, phrase in t.phrases] for t in templates]
    anchors = sorted({w for ws in rare for w in ws}, key=place.__getitem__)
    vocabulary = sorted({*ranked, *(p[-1] for p in BASE.values())}, key=lambda w: place.get(w, len(place)))
    words, hits, looked_up, none = F.col("_words"), F.col("_hits"), F.col("_looked_up"), F.array().cast("array<int>")
    # The file's own licence words, rarest first; the rarest of them with all their places.
    found = df.select(F.col(key), word_list(text).alias("_words"))
    found = found.withColumn("_own", F.array_intersect(_literal(vocabulary), words))
    found = found.withColumn("_anchors", F.array_intersect(_literal(anchors), F.col("_own")))
    some = F.size("_anchors") > 0  # else no key phrase can stand here
    found = found.withColumn("_looked_up", F.array_union("_anchors", F.slice("_own", 1, rarest)))
    found = found.withColumn("_hits", F.when(some, F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(looked_up, h["w"]))))
    base = {label: F.when(F.array_contains("_own", phrase[-1]), _places(words, phrase)).otherwise(none) for label, phrase in BASE.items()}
    shares = []
    for t, own in zip(templates, rare, strict=True):
        # Postings of the template: its words with their positions; those looked up propose where it would begin.
        postings = F.transform(_literal(t.words), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        asked = F.filter(postings, lambda p: F.array_contains(looked_up, p["w"]))
        starts = F.array_distinct(F.flatten(F.transform(F.filter(asked, lambda p: p["w"].isin(*own)), lambda p: F.transform(F.filter(hits, lambda h: h["w"] == p["w"]), lambda h: h["i"] - p["i"]))))
        inside = sorted({w for _, phrase in t.phrases for w in phrase})
        need = F.least(F.lit(agree), F.size(F.array_intersect(looked_up, _literal(inside))))

        def standing(postings: Column, s: Column) -> Column:
            return F.size(F.filter(postings, lambda p: F.coalesce(F.get(words, s + p["i"]) == p["w"], F.lit(False))))

        agreeing = F.filter(starts, lambda s: standing(asked, s) >= need)
        for at, phrase in t.phrases:
            agreeing = F.filter(agreeing, lambda s: _stands(words, s + at, phrase))
        share = F.transform(agreeing, lambda s: standing(postings, s) / F.lit(float(len(t.words))))
        may = F.lit(True)
        for w in own:
            may = may & F.array_contains("_anchors", w)
        shares.append(F.when(may, F.coalesce(F.array_max(share), F.lit(0.0))).otherwise(F.lit(0.0)))
    out = found.select(
        key,
        F.size(words).cast("long").alias("n_words"),
        F.concat(*base.values()).alias("_places"),
        F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for label, c in base.items()))).alias("_base"),
        F.when(some, F.array(*shares)).otherwise(F.array(*[F.lit(0.0)] * len(shares))).alias("_shares"),
    )
    names = _literal([t.label for t in templates])
    own_labels = F.filter(F.transform(names, lambda n, i: F.when(F.get(F.col("_shares"), i) > 0, n)), lambda n: n.isNotNull())
    return out.select(
        key,
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort("_base")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat("_base", own_labels)))).alias("labels"),
        F.greatest(F.array_max("_shares"), F.when(F.size("_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
