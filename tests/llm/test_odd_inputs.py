"""Licence versions, labels that teach nothing, hot groups without ids, words that a polynomial hash confuses."""

import math
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import bytetools as bt
from palisade.llm import decontamination, exact_dedup, license_scan, substring_dedup, toxicity

#: Headers as their projects wrap them, and what they are.
HEADERS = (
    ("GPL-2.0", """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""),
    ("GPL-3.0", """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""),
    ("GPL", """You should have received a copy of the GNU General Public License
along with this program.  If not, see the address below."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 3 of the License, or (at your option) any later version."""),
    ("AGPL-3.0", """it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License"""),
    ("BSD", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products"""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0\nInternational License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 License."),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSL-1.0", """// Distributed under the Boost Software License, Version 1.0.
// (See accompanying file or copy at the address below)"""),
    ("Zlib", """  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software."""),
    ("Proprietary", "Copyright 2020 Some Company. All rights reserved."),
    (None, "All rights reserved seats at the theatre were sold out"),
    (None, "The general public licensed the library for version 2 of the play"),
)


def test_versions_of_real_headers(spark):
    rows = [(k, t) for k, (_, t) in enumerate(HEADERS)]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licences(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {k: name for k, (name, _) in enumerate(HEADERS)}


TEXTS = [(k, f"text {k} with some words " + ("you utter fool and idiot " if k % 3 == 0 else "fine weather today ")) for k in range(40)]


@pytest.mark.parametrize("labels", [[], [(k, 1) for k in range(20)], [(k, 0) for k in range(20)], [(2, None), (3, 7)]])
def test_labels_that_teach_nothing(spark, labels):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.judge_toxicity(docs, known).collect()
    assert len(got) == 40 and all(r["predicted"] == 0 and 0 <= r["score"] < 1e-9 for r in got)
    assert toxicity.clean_documents(docs, known).count() == 40


def test_training_texts_are_bounded_by_the_labelled_ids(spark):
    rows = TEXTS + [(1, f"another text {k}") for k in range(500)] + [(1, None), (2, TEXTS[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(40)] * 3 + [(1, 0)], "doc_id long, toxic int")
    found = toxicity.labelled_sample(docs, known, "doc_id", "text", "toxic").collect()
    assert len(found) == len({(r["_id"], r["label"]) for r in found})
    assert {(r["_id"], r["label"]) for r in found} >= {(1, 0), (1, 1)} or toxicity.held_out is None


def _plain_score(model, text):
    """The score of an ASCII text by loops: pieces of words, n-grams, windows, steps of both directions, attention, tops."""
    p, t = model.network.p, toxicity
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    pieces = []
    for word in re.findall("[a-z]+", text.lower()):
        pieces += [word[k * t.PIECE : k * t.PIECE + t.LETTERS] for k in range(max(-(-(len(word) - t.LETTERS) // t.PIECE), 0) + 1)]
    vectors = []
    for word in pieces:
        raw = np.frombuffer(word.encode(), np.uint8)
        bucket = int(bt.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) % (t.WORD_BUCKETS - 1) + 1
        grams, own = [], "<" + word
        for n in t.GRAM_SIZES:
            for j in range(len(own) - n + 1):
                h = n
                for c in own[j : j + n]:
                    h = (h ^ ord(c)) * 16777619 % 2**32
                grams.append((h ^ (h >> 15)) % (t.GRAM_BUCKETS - 1) + 1)
        mean = sum((p["gram"][g].astype(float) for g in grams), np.zeros(t.GRAM_DIM)) / max(len(grams), 1)
        vectors.append(np.concatenate([p["word"][bucket], mean]))
    starts = range(0, max(-(-(len(vectors) - t.WINDOW) // t.STRIDE), 0) * t.STRIDE + 1, t.STRIDE) if vectors else []
    logits = []
    for at in starts:
        window = vectors[at : at + t.WINDOW]
        window += [np.zeros(t.WORD_DIM + t.GRAM_DIM)] * (t.WINDOW - len(window))
        states = []
        for side, order in (("f", 1), ("b", -1)):
            h, own = np.zeros(t.HIDDEN), []
            for x in window[::order]:
                xp, a = x @ p["w" + side] + p["b" + side], h @ p["u" + side]
                r, z, n = (np.zeros(t.HIDDEN) for _ in range(3))
                for k in range(t.HIDDEN):
                    r[k], z[k] = sigmoid(xp[k] + a[k]), sigmoid(xp[t.HIDDEN + k] + a[t.HIDDEN + k])
                    n[k] = math.tanh(xp[2 * t.HIDDEN + k] + r[k] * a[2 * t.HIDDEN + k])
                h = n + z * (h - n)
                own.append(h)
            states.append(own[::order])
        both = [np.concatenate(x) for x in zip(*states, strict=True)]
        weight = [math.exp(float(h @ p["att"][:, 0])) for h in both]
        logits.append(sum(w * float(h @ p["out"][:, 0]) for w, h in zip(weight, both, strict=True)) / sum(weight) + float(p["c"][0]))
    logits.sort(reverse=True)
    features = [sum(logits[:top]) / len(logits[:top]) if logits else -8.0 for top in t._TOPS]
    return sigmoid(float(np.dot([*features, 1.0], model.weights)))


def test_scores_equal_plain_loops(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    known = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(40)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, known)
    more = [(100, ""), (101, "... 123"), (102, "word " * 100 + "you utter fool and idiot " + "fine weather " * 40), (103, "Donaudampfschifffahrtsgesellschaftskapitaen you idiot"), (104, "a b c " * 30)]
    rows = TEXTS[:10] + more
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()}
    for k, text in rows:
        assert got[k] == pytest.approx(_plain_score(model, text), abs=1e-5), k
    assert max(got[k] for k, _ in rows) - min(got[k] for k, _ in rows) > 0.3


def test_hot_groups_without_ids_are_spread(spark):
    rows = [(None, "same")] * 3000 + [(7, "same")] * 1000 + [(k, f"text {k}") for k in range(100, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = exact_dedup.exact_dedup(docs)
    assert got.where("keep_id = 7 and group_size = 4000").count() == 4000 and got.where("kept").count() == 1050
    members = docs.select("doc_id", F.col("text").alias("_norm"), F.monotonically_increasing_id().alias("_row"), F.md5("text").alias("_h"))
    groups = members.groupBy("_h").agg(F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    spread = members.withColumn("_key", F.pmod(F.xxhash64("_row"), F.lit(exact_dedup.SPREAD)))
    assert groups.count() == 1 and spread.where("_norm = 'same'").select("_key").distinct().count() > 1500


def test_long_words_of_few_letters_stay(spark):
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest}")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.words_removed(rows) and got[2][1] == 0 and got[3][1] == 13


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_items_with_ids_of_any_type(spark, kind):
    item = "A question of some length, with all its words in one order; what is the answer to it?"
    docs = spark.createDataFrame([(1, "before it. " + item + " after it."), (2, "nothing")], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    items = spark.createDataFrame([(5, item)], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    r = decontamination.find_leaks(docs, items).collect()
    assert [(str(x["doc_id"]), str(x["item_id"]), x["edit_distance"]) for x in r] == [("1", "5", 0)]
