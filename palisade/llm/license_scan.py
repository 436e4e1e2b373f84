"""Licence scans: a paragraph classifier whose finds a template comparison confirms.

Multinomial logistic regression on hashed word uni- and bigrams tells licence families and a
class "unknown" apart. The probability that a family needs is calibrated on sentences that
weren't fitted on. A find counts only if it also holds most word bigrams of one of the family's templates.

Paragraphs stand between blank lines. Judged are each line, and, where a paragraph has several lines or
many words, windows of it that overlap, with its lines joined; whole texts are read. Only what holds one
of needles() is scored: the comparison can confirm nothing else, as it needs CONFIRM of a
template's bigrams and the needles are in more than the rest of them.
One projection over the documents: no shuffle, no Python.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of
from .hashed_logistic import HashedLogistic, bound, fit, word_grams

BUCKETS = 4096
REGULARISATION = 0.0005
#: Share of a template's word bigrams that a paragraph must hold.
CONFIRM = 0.75
#: Words of a window, and from one to the next: each run of WINDOW - STRIDE words, more than any template has, stands whole in one.
WINDOW, STRIDE = 32, 8
UNKNOWN = "unknown"

#: Notices by family, as their publishers word them (fixed values), a template a line, of fewer words than windows overlap.
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS
SPDX-License-Identifier: Apache-2.0""",
    "MIT": """Released under the MIT License
Licensed under the MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
SPDX-License-Identifier: MIT""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
The software is provided "as is" and the author disclaims all warranties with regard to this software
SPDX-License-Identifier: ISC""",
    "GPL": """This work is licensed under the GNU General Public License, version 3
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
You should have received a copy of the GNU General Public License along with this program
GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version
Licensed under the GPL version 3
SPDX-License-Identifier: GPL-2.0-only
SPDX-License-Identifier: GPL-3.0-or-later""",
    "LGPL": """Licensed under the GNU Lesser General Public License, version 3
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
SPDX-License-Identifier: LGPL-2.1-only
SPDX-License-Identifier: LGPL-3.0-or-later""",
    "AGPL": """Licensed under the GNU Affero General Public License, version 3
it under the terms of the GNU Affero General Public License as published by the Free Software Foundation
SPDX-License-Identifier: AGPL-3.0-or-later""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted under this license
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
Released under the BSD 3-Clause License
SPDX-License-Identifier: BSD-2-Clause
SPDX-License-Identifier: BSD-3-Clause""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered
SPDX-License-Identifier: BSL-1.0""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty
In no event will the authors be held liable for any damages arising from the use of this software
SPDX-License-Identifier: Zlib""",
    "Artistic-2.0": """under the terms of the Artistic License (2.0)
This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0
SPDX-License-Identifier: Artistic-2.0""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0
SPDX-License-Identifier: MPL-2.0""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
SPDX-License-Identifier: EPL-2.0""",
    "CC-BY": """This work is licensed under a Creative Commons Attribution 4.0 International License
Licensed under CC BY 4.0
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License
Licensed under CC BY-NC 4.0
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License
Licensed under CC BY-SA 4.0
This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License
Licensed under CC BY-NC-SA 4.0
This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License
SPDX-License-Identifier: CC-BY-4.0
SPDX-License-Identifier: CC-BY-NC-SA-4.0""",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright under Creative Commons Zero
Released into the public domain under the CC0 1.0 license""",
    "Unlicense": """This is free and unencumbered software released into the public domain
SPDX-License-Identifier: Unlicense""",
    "Proprietary": """All rights reserved
Copyright, all rights reserved. No part may be reproduced without written permission""",
}

#: Words and pairs of words (fixed values) that tell versions of a family apart, looked for where a notice stands, then in
#: all that the document says of licences. Without one, or with those of several, the family is named without a version.
VERSIONS = {
    "GPL": {"2.0": ("version 2", "gpl 2.0", "gpl 2", "gpl v2", "gplv2"), "3.0": ("version 3", "gpl 3.0", "gpl 3", "gpl v3", "gplv3")},
    "LGPL": {
        "2.0": ("version 2", "lgpl 2.0", "lgpl 2", "lgplv2"), "2.1": ("version 2.1", "lgpl 2.1", "lgplv2.1"), "3.0": ("version 3", "lgpl 3.0", "lgpl 3", "lgplv3"),
    },
    "AGPL": {"3.0": ("version 3", "agpl 3.0", "agpl 3", "agplv3")},
    "BSD": {"2-Clause": ("bsd 2", "2 clause", "simplified bsd"), "3-Clause": ("bsd 3", "3 clause", "neither the", "new bsd", "revised bsd")},
}
#: Elements of a Creative Commons licence in the order of its name, and its versions.
CC_ELEMENTS = {"NC": ("noncommercial", "nc"), "SA": ("sharealike", "sa"), "ND": ("noderivatives", "noderivs", "nd")}
CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")
#: With these words, or as the line's last ones, reserved rights are a notice.
NOTICE = ("copyright", "permission", "unauthorized", "prohibited")

#: Sentences of the families that are in no template, to calibrate on.
HELD_OUT = """Apache-2.0	This project is distributed under the Apache License 2.0, see the file for its terms
Apache-2.0	Available under the terms of the Apache License, Version 2.0
MIT	The code is distributed under the MIT License, see the license file
MIT	This package is licensed under the terms of the MIT license
ISC	Permission to use, copy, modify and distribute this software is hereby granted without fee for any purpose
GPL	This program is distributed under the GNU General Public License, either version 3 or a later one
GPL	You can redistribute it under the terms of the GNU General Public License as published
LGPL	The library is released under the GNU Lesser General Public License, version 3 or later
AGPL	The server is released under the GNU Affero General Public License, version 3
BSD	Distributed under the 3-Clause BSD License, redistribution and use in source form are permitted
MPL-2.0	This file is subject to the Mozilla Public License, version 2.0
EPL-2.0	Made available under the Eclipse Public License, version 2.0
CC-BY	The text is available under the Creative Commons Attribution 4.0 International license
CC-BY	The images are available under a Creative Commons Attribution-NonCommercial 4.0 license
CC-BY	The text is available under a Creative Commons Attribution-ShareAlike 4.0 license
CC0-1.0	To the extent possible under law all copyright is waived with CC0 1.0
BSL-1.0	The headers are distributed under the Boost Software License, Version 1.0, see the file
Zlib	The library is provided as-is, without any express or implied warranty of the authors
Artistic-2.0	You can redistribute the module under the terms of the Artistic License 2.0
Unlicense	The author released this unencumbered software into the public domain
Proprietary	All rights are reserved and no part may be reproduced without permission"""

#: Lines that name licences, rights or permissions without granting any, and plain prose.
OTHERS = """His driving license was suspended last year
The pilot renewed her license in version 2 of the test
A fishing license is required at the lake
The council will licence taxis under the new law
Human rights are universal
Voting rights and civil rights were debated
You need permission to enter the building
She asked permission from the general public
The public library is free of charge
Poetic license is allowed in this work
The version 3 release was delayed
The committee reserved all the seats
Dealers must display their license plate
The software can be modified by any person
The artist holds the copyright of the song
The film was released under the title of the book
Copyright law differs between countries
This work is in the public interest
The creative team has commons sense
Terms of the agreement were not disclosed
Warranty claims go to the source of the fault
Redistribution of wealth and use of land
The apache helicopter was shown
Students at mit wrote the article
The licensed electrician worked under the roof
Please read the notice before use
The weather was fine and the sea was calm
Licensed premises close at ten"""

#: Stems of lines that speak of licences; they are scored too, and count as unknown where they are no find.
STEMS = ("licens", "licenc", "copyright", "permission", "redistribution")
#: Words that are needles only where others don't suffice.
FREQUENT = frozenset("the of and or to in by for with without under from this that it may not use form source work file version program code".split())
#: What stands between paragraphs.
BLANK = r"\n[^\p{L}\p{N}]*\n"


def needles() -> list[str]:
    """Words of which each text with CONFIRM of a template's bigrams holds one: of each template as many words, long
    ones first, as are in more bigrams than such a text may lack."""
    chosen = list(STEMS)
    for texts in TEMPLATES.values():
        for text in texts.split("\n"):
            words = _words(text)
            pairs = set(zip(words, words[1:], strict=False))
            covered = {p for p in pairs if any(n in w for n in chosen for w in p)}
            for word in sorted(set(words), key=lambda w: (w in FREQUENT, -len(w), w)):
                if len(covered) > len(pairs) - math.ceil(CONFIRM * len(pairs)):
                    break
                if word in chosen:
                    continue
                chosen.append(word)
                covered |= {p for p in pairs if word in p}
    return chosen


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}.]+|\.(?!\d)"), lambda w: w != "")


def features(words: Column) -> Column:
    return F.concat(words, word_grams(words, 2))


def _lines(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    made = spark.range(1).select(F.explode(F.split(F.lit("\n".join(f"{k}\t{t}" for k, t in rows)), "\n")).alias("_r"))
    return made.select(F.split("_r", "\t")[0].alias("label"), F.split("_r", "\t")[1].alias("line"))


def training_rows() -> list[tuple[str, str]]:
    """(label, line). Each template also stands behind and before other words, as notices do."""
    around = [("", "."), ("Notice: ", " for details."), ("", " by the authors")]
    rows = [(k, a + t + b) for k, ts in TEMPLATES.items() for t in ts.split("\n") for a, b in around]
    return rows + [(UNKNOWN, a + t + b) for t in OTHERS.split("\n")[::2] for a, b in around]


def held_out_rows() -> list[tuple[str, str]]:
    """The same, of sentences that training_rows() doesn't have, in any surroundings."""
    rows = [tuple(line.split("\t")) for line in HELD_OUT.split("\n")]
    return rows + [(UNKNOWN, t) for t in OTHERS.split("\n")[1::2]]


class LicenceModel:
    """The fitted classifier and the probability that its finds need."""

    def __init__(self, classifier: HashedLogistic, threshold: float):
        self.classifier, self.threshold = classifier, threshold

    def best(self, words: Column) -> Column:
        """struct(p, family) of the likeliest class."""
        p = self.classifier.probabilities(features(words))
        named = F.transform(
            F.arrays_zip(p.alias("p"), F.array(*map(F.lit, self.classifier.classes)).alias("family")),
            lambda x: F.struct(x["p"].alias("p"), x["family"].alias("family")),
        )
        return F.array_max(named)


def fit_licences(spark: SparkSession) -> LicenceModel:
    """Fits on the templates and calibrates on held-out sentences: the threshold is the probability, from 0.3 to 0.9,
    at which the fewest of them are judged wrongly (in the middle of equals)."""
    rows = _lines(spark, training_rows()).select(features(words_of(F.col("line"))).alias("features"), "label")
    classes = [UNKNOWN, *TEMPLATES]
    model = LicenceModel(fit(rows, classes, BUCKETS, REGULARISATION), 0.5)
    judged = _lines(spark, held_out_rows()).select("label", model.best(words_of(F.col("line"))).alias("b")).collect()  # some thirty
    wrong = lambda at: sum((r["b"]["family"] if r["b"]["p"] >= at else UNKNOWN) != r["label"] for r in judged)
    steps = [k / 100 for k in range(30, 91)]
    fewest = min(map(wrong, steps))
    equal = [at for at in steps if wrong(at) == fewest]
    model.threshold = equal[len(equal) // 2]
    return model


def template_share(words: Column, family: Column) -> Column:
    """The largest share of a template's word bigrams that the paragraph holds, over the family's."""
    own = word_grams(words, 2)
    shares = []
    for name, texts in TEMPLATES.items():
        of_family = []
        for text in texts.split("\n"):
            ws = _words(text)
            pairs = sorted({f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)}) or ws
            held = F.size(F.array_intersect(own, F.array(*map(F.lit, pairs))))
            of_family.append(held / F.lit(float(len(pairs))))
        shares.append((name, F.greatest(*of_family, F.lit(0.0))))
    return reduce(lambda e, s: e.when(family == s[0], s[1]), shares[1:], F.when(family == shares[0][0], shares[0][1])).otherwise(0.0)


def named(family: Column, words: Column, around: Column, document: Column) -> Column:
    """The family with its version. words: of the find; around: of its paragraph; document: of all paragraphs scored."""
    out = F.when(family == "CC-BY", _creative_commons(words))
    for name, versions in VERSIONS.items():
        out = out.when(family == name, F.coalesce(_version(name, versions, words), _version(name, versions, around), _version(name, versions, document), F.lit(name)))
    return out.otherwise(family)


def _version(name: str, versions: dict[str, tuple[str, ...]], words: Column) -> Column:
    """The version that the words tell, if they tell one."""
    told = bound(features(words), lambda own: F.array_compact(F.array(*[
        F.when(F.arrays_overlap(own, F.array(*map(F.lit, tells))), F.lit(f"{name}-{v}")) for v, tells in versions.items()
    ])))
    return F.when(F.size(told) == 1, told[0])


def _creative_commons(words: Column) -> Column:
    has = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    parts = [F.when(has(ws), F.lit(k)) for k, ws in CC_ELEMENTS.items()]
    version = F.coalesce(*[F.when(F.array_contains(words, v), F.lit(v)) for v in CC_VERSIONS])
    return F.concat_ws("-", F.lit("CC-BY"), *parts, version)


def is_notice(family: Column, words: Column) -> Column:
    """Whether reserved rights stand in a notice; other families do anyway."""
    return (family != "Proprietary") | (F.element_at(words, -1) == "reserved") | F.arrays_overlap(words, F.array(*map(F.lit, NOTICE)))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w.]+|\.(?!\d)", text.lower()) if w]


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenceModel | None = None
) -> DataFrame:
    """One row per input row: doc_id, license, probability, n_paragraphs, families, n_unknown.

    license is the family of the surest find (ties: the later name), null without any, with its version if the text
    tells one (see VERSIONS). n_paragraphs
    counts the lines that are finds, and each family that only windows find once a paragraph;
    n_unknown the lines with a needle that are neither finds nor in a paragraph with a find of windows;
    families names all found families, sorted and joined by commas (empty without any).
    Null and empty texts have none. Repeated rows and null ids pass through; an empty table gives
    an empty result; other columns are ignored.
    """
    model = model or fit_licences(docs.sparkSession)
    text = F.regexp_replace(text_of(text_col), "\r\n?", "\n")
    words = needles()
    cue = lambda s: bound(F.lower(s), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in words]))
    cued = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(cue(text), F.filter(F.split(text, BLANK), cue)).otherwise(F.array().cast("array<string>")).alias("_blocks"),
    )
    unit = lambda w, k, line: F.struct(w.alias("w"), k.alias("k"), F.lit(line).alias("line"))
    lines = F.flatten(F.transform("_blocks", lambda b, k: F.transform(F.filter(F.split(b, "\n"), cue), lambda s: unit(words_of(s), k, True))))
    several = F.transform("_blocks", lambda b: F.struct(words_of(b).alias("w"), b.contains("\n").alias("wrapped")))
    worded = cued.withColumn("_several", several)
    windows = F.flatten(
        F.transform("_several", lambda x, k: F.transform(window_starts(x["w"], x["wrapped"]), lambda at: unit(F.slice(x["w"], at, WINDOW), k, False)))
    )
    worded = worded.withColumn("_units", F.concat(lines, windows))
    judged = worded.withColumn(
        "_best", F.transform("_units", lambda u: F.struct(model.best(u["w"]).alias("b"), u["w"].alias("w"), u["k"].alias("k"), u["line"].alias("line")))
    )
    sure = F.filter(
        "_best",
        lambda x: (x["b"]["family"] != UNKNOWN)
        & (x["b"]["p"] >= model.threshold)
        & (template_share(x["w"], x["b"]["family"]) >= CONFIRM)
        & is_notice(x["b"]["family"], x["w"]),
    )
    judged = judged.withColumn("_found", sure)
    all_words = F.flatten(F.transform("_several", lambda b: b["w"]))
    judged = judged.withColumn("_all", F.when(F.size("_found") > 0, all_words))
    name = lambda x: named(x["b"]["family"], x["w"], F.col("_several")[x["k"]]["w"], F.col("_all"))
    sure = F.transform(
        "_found", lambda x: F.struct(F.struct(x["b"]["p"].alias("p"), name(x).alias("family")).alias("b"), x["k"].alias("k"), x["line"].alias("line"))
    )
    found = judged.withColumn("_sure", F.transform(sure, lambda x: F.struct(x["b"].alias("b"), x["k"].alias("k"), x["line"].alias("line"))))
    of = lambda line: F.transform(
        F.filter("_sure", lambda x: x["line"] == line), lambda x: F.struct(x["k"].alias("k"), x["b"]["family"].alias("family"))
    )
    wrapped = F.array_except(of(False), of(True))
    alone = lambda c: F.size(F.filter(c, lambda x: x["line"] & ~F.array_contains("_blocks_found", x["k"])))
    found = found.withColumn("_wrapped", wrapped).withColumn("_blocks_found", F.transform("_wrapped", lambda x: x["k"]))
    top = F.array_max(F.transform("_sure", lambda x: x["b"]))
    return found.select(
        "doc_id",
        top["family"].alias("license"),
        top["p"].alias("probability"),
        (F.size(of(True)) + F.size("_wrapped")).cast("long").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_sure", lambda x: x["b"]["family"]))), ",").alias("families"),
        (alone("_best") - alone("_sure")).cast("long").alias("n_unknown"),
    )


def window_starts(words: Column, wrapped: Column) -> Column:
    """From 1, a window each STRIDE words; none for a line of its own that one window holds."""
    n = F.size(words)
    last = F.greatest(F.ceil((n - WINDOW) / STRIDE).cast("int"), F.lit(0)) * STRIDE + 1
    return F.when(wrapped | (n > WINDOW), F.sequence(F.lit(1), last, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
