"""Operator 3: licence notices found by a trained paragraph classifier.

DataFrame functions and Spark's own logistic regression only. A paragraph is a
line, or a window of a wrapped notice's lines (2 to `MOST_LINES`, without a blank
line among them); windows count only if confirmed. Texts are taken apart into blocks of
lines first, so that windows are only ever made of one block's lines. Its features are which words and
word pairs it has of those that the notices below and frequent ones of plain
paragraphs have. A multinomial logistic regression tells licence families, notices of
other licences (`unknown`) and plain text apart. It learns from the templates, from
licence names in usual forms, and from plain paragraphs of a bounded sample of the
documents.

A paragraph is licence-like if the summed probability of all licence classes
exceeds `bar`, which at most `PASSING` of the plain paragraphs kept apart exceed. It
gets the likeliest family if the unknown class isn't too likely beside it (`doubt`,
the bar that tells known and other licences apart best on names in forms kept
apart), if it has the family's distinguishing terms and none that tell of another
licence (`TELLING`), and if a template of that family confirms it, by having at
least `CONFIRM` of its words and word pairs in the paragraph. Else it is `unknown`, if it
speaks of licences, permission or copyright (`SPEAKS`), or plain; an unknown line that
speaks of "the license" a few lines below a notice belongs to that. A paragraph
without any `CUE` has neither, so only those with one are classified.

Defined results: null and empty texts have no paragraphs; blank lines are none;
rows with an equal key are one document, rows with a null key too; families come
once, sorted; unknown lines that follow each other are one notice; lines of any
length are read whole; other columns are ignored, whatever their names; an empty
table gives none.
"""

from __future__ import annotations

import textwrap

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.common import written

#: Documents whose paragraphs are the plain class; share of a template's terms that confirms it; share of plain paragraphs that may pass the bar.
SAMPLE, CONFIRM, PASSING = 800, 0.6, 0.001
#: Plain paragraphs that a term must be in to be a feature, and how many such terms are, beside those of the notices.
USUAL, PLAIN_TERMS = 5, 20_000

#: Notices by family, from the public texts of the licences and usual short forms; fixed values.
TEMPLATES: dict[str, list[str]] = {
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU AGPL v3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright by the author, all rights reserved.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}

#: Names of the families' licences; fixed values.
NAMES: dict[str, list[str]] = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "bsd-3-clause": ["BSD 3-Clause License", "three-clause BSD License", "BSD-3-Clause"],
    "cc-by-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0 license", "CC-BY-4.0"],
    "cc-by-nc-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0 license", "CC-BY-NC-4.0"],
    "cc-by-sa-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0 license", "CC-BY-SA-4.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"],
    "mit": ["MIT License", "MIT licence", "MIT"],
    "mpl-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0"],
}

#: Names of other licences; fixed values.
OTHER_NAMES = [
    "Academic Free License 3.0",
    "Apache License, Version 1.1",
    "Artistic License 2.0",
    "BSD 2-Clause License",
    "Boost Software License 1.0",
    "CC BY-NC-ND 4.0 license",
    "CC BY-NC-SA 4.0 license",
    "CC BY-ND 4.0 license",
    "CC0 1.0 Universal Public Domain Dedication",
    "Common Development and Distribution License",
    "Creative Commons Attribution-ShareAlike 3.0 License",
    "Eclipse Public License 2.0",
    "European Union Public Licence 1.2",
    "GNU General Public License, version 2",
    "GNU LGPL v3",
    "GNU Lesser General Public License, version 2.1",
    "ISC License",
    "Microsoft Public License",
    "Python Software Foundation License",
    "SIL Open Font License 1.1",
    "Unlicense",
    "zlib License",
    "custom license",
    "license of its authors",
    "proprietary license",
    "terms below",
]

#: Forms that a name stands in, to learn from and to set bars on.
FORMS = [
    "Licensed under the {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "Distributed under the terms of the {}.",
    "This software is available under the {} (see LICENSE).",
    "SPDX-License-Identifier: {}",
]
HELD_OUT_FORMS = ["Use of this file is governed by the {}.", "This project is licensed under the {}.", "Content is available under the {}, see the file LICENSE."]

#: Notices of no family above, from public texts and usual forms; fixed values.
UNKNOWN_TEMPLATES = [
    "Licensed under the terms below.",
    "This work is licensed to members only.",
    "Released under a proprietary license.",
    "Licensed under a custom license.",
    "See the license for the terms of use.",
    "This license grants no rights to third parties.",
    "Distributed under its own licence.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "This is free and unencumbered software released into the public domain.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "No part of this publication may be reproduced without the prior written permission of the publisher.",
]

#: Notices kept apart from training, on which the bar of the unknown class is set, beside names in `HELD_OUT_FORMS`.
HELD_OUT: dict[str, list[str]] = {
    "agpl-3.0": ["Distributed under the GNU Affero General Public License, version 3 or later."],
    "all-rights-reserved": ["Copyright 2019 Example Press. All rights reserved."],
    "bsd-3-clause": ["This software is distributed under the BSD 3-Clause License."],
    "cc-by-sa-4.0": ["Text is available under the CC BY-SA 4.0 license."],
    "mit": ["This software is released under the MIT License (see LICENSE)."],
}

#: What a family's notice must have, one term of each list, and terms that tell of another licence.
_THREE, _FOUR, _TWO = ["3", "v3", "gplv3", "agplv3"], ["4", "v4"], ["2", "v2"]
_NC, _SA = ["nc", "noncommercial", "non commercial"], ["by sa", "nc sa", "sharealike", "share alike"]
_ND = ["by nd", "nc nd", "noderivatives", "noderivs", "no derivatives", "no derivs"]
_CC = ["cc", "creative", "creativecommons"]
TELLING: dict[str, tuple[list[list[str]], list[str]]] = {
    "agpl-3.0": ([["affero", "agpl", "agplv3"], _THREE], ["lesser", "lgpl"]),
    "all-rights-reserved": ([["rights reserved"]], []),
    "apache-2.0": ([["apache"], _TWO], []),
    "bsd-3-clause": ([["bsd", "redistribution"]], [f"{n} clause" for n in ("0", "1", "2", "4", "zero", "one", "two", "four")]),
    "cc-by-4.0": ([_CC, _FOUR], [*_NC, *_SA, *_ND]),
    "cc-by-nc-4.0": ([_CC, _FOUR, _NC], [*_SA, *_ND]),
    "cc-by-sa-4.0": ([_CC, _FOUR, _SA], [*_NC, *_ND]),
    "gpl-3.0": ([["gnu", "gpl", "gplv3"], _THREE], ["lesser", "lgpl", "lgplv3", "library general", "affero", "agpl", "agplv3"]),
    "mit": ([["mit license", "mit licence", "mit", "permission"]], ["mit 0", "no attribution"]),
    "mpl-2.0": ([["mozilla", "mpl"], _TWO], []),
}

#: What an unknown notice speaks of; `all-rights-reserved` must end so, or go on after a mark.
SPEAKS = r"licen[sc]|permission|permitted|copyright|redistribut|public domain"
RESERVED = r"rights reserved\s*($|[^\p{L}\p{N}\s])"

#: An unknown line that speaks so of a notice's licence, at most `MOST_LINES` lines below it, belongs to the notice.
REFERS = r"\bthe licen[sc]e\b"

#: A wrapped notice is looked for in windows of up to `MOST_LINES` lines of at most `WRAPPED` characters; a paragraph without
#: `CUE` (lower case) is plain, as every family's telling terms or its templates have it.
MOST_LINES, WRAPPED = 8, 200
CUE = rf"gnu|gpl|affero|apache|bsd|creative|\bcc\b|mozilla|\bmpl\b|\bmit\b|rights|{SPEAKS}"

PLAIN, UNKNOWN = "plain", "unknown"
CLASSES = [PLAIN, UNKNOWN, *sorted(TEMPLATES)]


def _cued(x: Column) -> Column:
    return F.lower(x).rlike(CUE)


#: Lines of a block; blocks overlap by the lines that a window starting in one may reach into the next.
BLOCK = 32

_PARAGRAPHS = "array<struct<start: int, end: int, paragraph: string>>"


def _blocks(lines: Column) -> Column:
    """Lines in blocks, with the number of each block's first line, of those blocks that have a `CUE`."""
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(BLOCK))
    every = F.transform(starts, lambda i: F.struct(i.alias("first"), F.slice(lines, i + 1, F.lit(BLOCK + MOST_LINES - 1)).alias("lines")))
    return F.filter(every, lambda b: F.exists(b["lines"], _cued))


def _paragraphs(first: Column, lines: Column, good: Column) -> Column:
    """The paragraphs with a `CUE` that start in a block: lines that aren't blank, and each run of 2 to `MOST_LINES` lines that are all `good`."""

    def runs(i: Column) -> Column:
        sizes = F.filter(F.array(*[F.lit(k) for k in range(2, MOST_LINES + 1)]), lambda k: (i + k <= F.size(lines)) & F.forall(F.slice(good, i + 1, k), lambda g: g))
        return F.transform(sizes, lambda k: F.struct((first + i).alias("start"), (first + i + k - 1).alias("end"), F.array_join(F.slice(lines, i + 1, k), " ").alias("paragraph")))

    def starting(x: Column, i: Column) -> Column:
        single = F.struct((first + i).alias("start"), (first + i).alias("end"), x.alias("paragraph"))
        return F.when(F.trim(x) != "", F.concat(F.array(single), runs(i))).otherwise(F.array().cast(_PARAGRAPHS))

    return F.filter(F.flatten(F.transform(F.slice(lines, 1, F.lit(BLOCK)), starting)), lambda p: _cued(p["paragraph"]))


def _words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(paragraph, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _terms(rows: DataFrame, paragraph: str = "paragraph") -> DataFrame:
    """`rows` with `terms`, the words and word pairs."""
    worded = rows.withColumn("_words", _words(F.col(paragraph)))
    paired = NGram(n=2, inputCol="_words", outputCol="_pairs").transform(worded)
    return paired.withColumn("terms", F.concat("_words", "_pairs")).drop("_words", "_pairs")


def _notices() -> list[tuple[str, str]]:
    """Notices to learn from, with their classes; of long ones also the lines that they are wrapped to."""
    rows = [(t, f) for f, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in UNKNOWN_TEMPLATES]
    rows += [(line, f) for t, f in rows if len(t) > 100 for line in textwrap.wrap(t, 72)]
    rows += [(form.format(n), f) for f, ns in NAMES.items() for n in ns for form in FORMS]
    return rows + [(form.format(n), UNKNOWN) for n in OTHER_NAMES for form in FORMS]


def _held_out() -> list[tuple[str, bool]]:
    """Notices to set the bar of the unknown class on, and whether their licence is a known one."""
    rows = [(t, True) for ts in HELD_OUT.values() for t in ts] + [(form.format(n), True) for ns in NAMES.values() for n in ns for form in HELD_OUT_FORMS]
    return rows + [(form.format(n), False) for n in OTHER_NAMES for form in HELD_OUT_FORMS]


class Scanner:
    """A vocabulary, a trained model, the bars of its licence-like and its unknown class, and the templates' terms."""

    def __init__(self, vocabulary: CountVectorizerModel, model: LogisticRegressionModel, bar: float, template_terms: dict[str, list[list[str]]], doubt: float = 0.5) -> None:
        self.vocabulary, self.model, self.bar, self.template_terms, self.doubt = vocabulary, model, bar, template_terms, doubt

    def classified(self, rows: DataFrame) -> DataFrame:
        """`rows` (with paragraph and terms) with `family`: a family, `unknown`, or null for plain text; and `share`, how much of a template a family's notice has."""
        out = self.model.transform(self.vocabulary.transform(rows)).withColumn("_p", vector_to_array("probability"))
        licence = 1 - F.get("_p", F.lit(CLASSES.index(PLAIN)))
        families = F.slice("_p", 3, len(TEMPLATES))
        likeliest = F.array_position(families, F.array_max(families)).cast("int")
        family = F.element_at(F.array(*[F.lit(f) for f in sorted(TEMPLATES)]), likeliest)
        terms = F.array_distinct("terms")
        shares = F.array(*[F.greatest(*[F.size(F.array_intersect(terms, F.array(*[F.lit(t) for t in each]))) / F.lit(float(len(each))) for each in self.template_terms[f]], F.lit(0.0)) for f in sorted(TEMPLATES)])
        telling = F.array(*[self._tells(f) for f in sorted(TEMPLATES)])
        sure = _doubt(F.col("_p")) <= self.doubt
        share = F.when((licence > self.bar) & sure, F.when(F.element_at(telling, likeliest), F.element_at(shares, likeliest)))
        out = out.withColumn("_licence", licence > self.bar).withColumn("_likeliest", family).withColumn("share", share)
        speaks = F.lower("paragraph").rlike(SPEAKS)
        named = F.when(F.col("share") >= CONFIRM, F.col("_likeliest")).when(speaks, UNKNOWN)
        return out.withColumn("family", F.when(F.col("_licence"), named)).drop("_p", "_licence", "_likeliest", "features", "rawPrediction", "probability", "prediction")

    @staticmethod
    def _tells(family: str) -> Column:
        needed, other = TELLING[family]
        out = ~F.arrays_overlap("terms", F.array(*[F.lit(t) for t in other])) if other else F.lit(True)
        for terms in needed:
            out = out & F.arrays_overlap("terms", F.array(*[F.lit(t) for t in terms]))
        return out & F.lower("paragraph").rlike(RESERVED) if family == "all-rights-reserved" else out


def _doubt(p: Column) -> Column:
    """How likely the unknown class is beside the likeliest family."""
    unknown = F.get(p, F.lit(CLASSES.index(UNKNOWN)))
    return unknown / (unknown + F.array_max(F.slice(p, 3, len(TEMPLATES))))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Scanner:
    """A scanner from the notices above and the plain paragraphs of up to `sample` documents, taken by a hash of the key."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null")
    picked = texts.select("key").distinct().orderBy(F.xxhash64(F.lit("licence"), "key"), "key").limit(sample)
    texts = texts.join(F.broadcast(picked), "key").groupBy("key").agg(F.min("text").alias("text"))  # `sample` keys, and one text of each
    # notices among them would be learned as plain text, so paragraphs that speak of licences or rights are left out
    plain = texts.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("paragraph")).filter(F.trim("paragraph") != "").filter(~F.lower("paragraph").rlike(rf"{SPEAKS}|\brights\b"))
    plain = _terms(plain.distinct()).select("paragraph", "terms", (F.pmod(F.xxhash64("paragraph"), F.lit(2)) == 1).alias("apart"))
    plain = written(plain, "licence-plain")
    notices = _terms(spark.createDataFrame(_notices(), "paragraph string, family string")).select("paragraph", "family", F.array_distinct("terms").alias("terms"))
    found = [tuple(r) for r in notices.collect()]  # the notices above
    terms = {f: [t for p, g, t in found if g == f and p in TEMPLATES[f]] for f in TEMPLATES}
    usual = plain.filter("not apart").select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= USUAL)
    usual = [r.term for r in usual.orderBy(F.desc("n"), "term").limit(PLAIN_TERMS).collect()]
    vocabulary = CountVectorizerModel.from_vocabulary(sorted({x for _, _, t in found for x in t}.union(usual)), inputCol="terms", outputCol="features")
    vocabulary.setBinary(True)
    vocabulary.setMinTF(1.0)
    learned = vocabulary.transform(notices.select("family", "terms").unionByName(plain.filter("not apart").select(F.lit(PLAIN).alias("family"), "terms")))
    number = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("family")).cast("double") - 1
    # a few thousand short rows: in few partitions, so that each step of the fit is a small job
    learned = written(learned.select("features", number.alias("label"), F.when(F.col("family") == PLAIN, 1.0).otherwise(20.0).alias("weight")).coalesce(2), "licence-sample")
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-4, maxIter=60).fit(learned)
    licence = 1 - F.get(vector_to_array("probability"), F.lit(CLASSES.index(PLAIN)))
    bar = model.transform(vocabulary.transform(plain.filter("apart"))).select(F.percentile(licence, 1 - PASSING)).first()[0]
    held = _terms(spark.createDataFrame(_held_out(), "paragraph string, known boolean"))
    doubts = [tuple(r) for r in model.transform(vocabulary.transform(held)).select(_doubt(vector_to_array("probability")), "known").collect()]  # the notices above
    return Scanner(vocabulary, model, max(0.5, float(bar or 0.0)), terms, parting(doubts))


def parting(values: list[tuple[float, bool]]) -> float:
    """The middle of the range of bars that part low values marked True from high ones marked False with the fewest errors."""
    values = sorted(values)
    wrong = [sum(not k for _, k in values[:i]) + sum(k for _, k in values[i:]) for i in range(len(values) + 1)]
    best = wrong.index(min(wrong))
    low, high = values[best - 1][0] if best else 0.0, values[best][0] if best < len(values) else 1.0
    return (low + high) / 2


def _found(docs: DataFrame, scanner: Scanner, key: str, text: str) -> DataFrame:
    """`key`, `row`, `n` and the classified paragraphs of `docs`: lines, and the windows of lines that a family's template confirms, if they are notices; before them, a row without a paragraph for each text, with the number `n` of its lines."""

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    # each step is a select of its own, so that a text is split once, and no row of a block carries the text, no paragraph its block
    rows = rows.select("key", "row", F.split("text", "\n").alias("lines"), _cued(F.col("text")).alias("cued"))
    blank = F.array().cast("array<struct<first: int, lines: array<string>>>")
    rows = rows.select("key", "row", F.size(F.filter("lines", lambda x: F.trim(x) != "")).alias("n"), F.when(F.col("cued"), _blocks(F.col("lines"))).otherwise(blank).alias("blocks"))
    rows = rows.select("key", "row", "n", F.explode_outer("blocks").alias("b")).select("key", "row", "n", F.col("b.first").alias("first"), F.col("b.lines").alias("lines"))
    good = F.transform("lines", lambda x: (F.trim(x) != "") & (F.length(x) <= WRAPPED))
    rows = rows.select("key", "row", "n", "first", "lines", good.alias("good"))
    found = F.concat(F.array(F.lit(None).cast(_PARAGRAPHS[6:-1])), F.coalesce(_paragraphs(F.col("first"), F.col("lines"), F.col("good")), F.array().cast(_PARAGRAPHS)))
    rows = rows.select("key", "row", "n", found.alias("paragraphs"))
    rows = rows.select("key", "row", "n", F.explode("paragraphs").alias("p")).select("key", "row", "n", "p.*")
    found = scanner.classified(_terms(rows))
    return found.filter(F.col("paragraph").isNull() | F.col("family").isNotNull() & ((F.col("start") == F.col("end")) | (F.col("share") >= CONFIRM)))


def _apart(found: Column) -> Column:
    """How many notices of `found` there are that don't overlap, and their families.

    A confirmed line goes before a window, a window of the same family with more of its template, or as much in fewer lines, before
    another, and unknown lines are last. One pass in the order of the lines: a window that reaches into one of another family is
    left, as the one that starts after it follows.
    """
    struct = "struct<row: bigint, start: int, end: int, worth: double, family: string, refers: boolean>"
    start = F.struct(F.lit(None).cast(struct).alias("last"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("families"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        same = last.isNotNull() & (last["row"] == x["row"])
        over = same & (x["start"] <= last["end"])
        # unknown lines that follow each other are one notice
        on = same & ~over & (last["family"] == UNKNOWN) & (x["family"] == UNKNOWN) & (x["start"] == last["end"] + 1)
        # one that refers to the licence of a notice above is a part of that
        part = same & ~over & (x["family"] == UNKNOWN) & (last["family"] != UNKNOWN) & x["refers"] & (x["start"] <= last["end"] + MOST_LINES)
        closed = last.isNotNull() & ~over & ~on & ~part
        kept = last.withField("end", F.greatest(last["end"], x["end"]))
        better = (x["worth"] > last["worth"]) & ((x["family"] == last["family"]) | (last["family"] == UNKNOWN) | (x["start"] == x["end"]))
        return F.struct(
            F.when(part, kept).when(over & ~better, last).otherwise(x).alias("last"),
            (acc["n"] + closed.cast("long")).alias("n"),
            F.when(closed, F.array_union(acc["families"], F.array(last["family"]))).otherwise(acc["families"]).alias("families"),
        )

    def end(acc: Column) -> Column:
        any_ = acc["last"].isNotNull()
        return F.struct((acc["n"] + any_.cast("long")).alias("n"), F.when(any_, F.array_union(acc["families"], F.array(acc["last"]["family"]))).otherwise(acc["families"]).alias("families"))

    return F.aggregate(F.array_sort(found), start, step, end)


#: What `licenses` may have, in order.
FOUND = sorted([UNKNOWN, *TEMPLATES])


def scan(docs: DataFrame, scanner: Scanner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `licenses` (families found, sorted), `n_paragraphs` (lines) and `n_notices` (a wrapped notice is one) of every document."""
    single = F.col("start") == F.col("end")
    worth = F.when(F.col("family") == UNKNOWN, 0.0).when(single, 2.0).otherwise(F.col("share") - 0.01 * (F.col("end") - F.col("start")))
    notice = F.when(F.col("paragraph").isNotNull(), F.struct("row", "start", "end", worth.alias("worth"), "family", F.lower("paragraph").rlike(REFERS).alias("refers")))
    # notices are gathered by row, so a key's rows, however many, are only ever summed
    by_row = _found(docs, scanner, key, text).groupBy("key", "row").agg(F.collect_list(notice).alias("notices"), F.max("n").alias("n"))
    by_row = by_row.withColumn("notices", _apart(F.col("notices")))
    bits = F.aggregate("notices.families", F.lit(0), lambda acc, f: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), (F.array_position(F.array(*[F.lit(x) for x in FOUND]), f) - 1).cast("int"))))
    every = by_row.select("key", "n", F.col("notices.n").alias("notices"), bits.alias("bits")).groupBy("key").agg(F.sum("n").alias("n"), F.sum("notices").alias("notices"), F.bit_or("bits").alias("bits"))
    families = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, f) for i, f in enumerate(FOUND)]), lambda f: f.isNotNull())
    return every.select(F.col("key").alias(key), families.alias("licenses"), F.col("n").alias("n_paragraphs"), F.col("notices").alias("n_notices"))


def notices(docs: DataFrame, scanner: Scanner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `paragraph` and `family` of every licence-like line and of every window of lines that is confirmed."""
    return _found(docs, scanner, key, text).filter("paragraph is not null").select(F.col("key").alias(key), "paragraph", "family")
