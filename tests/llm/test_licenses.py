import re
import textwrap

import numpy as np
import pytest

from seqframe.llm import licenses

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scanner(spark):
    return licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_planted_notices(spark, scanner):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forms = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.", "all-rights-reserved": "All rights reserved."}
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {k: sorted(f for f, line in forms.items() if line in t.split("\n")) for k, t in texts.items()}
    rows = {r.doc_id: r for r in licenses.scan(docs, scanner).collect()}
    assert {k: r.licenses for k, r in rows.items()} == want and any(want.values())
    for k, t in texts.items():
        lines = [x for x in t.split("\n") if x.strip(" ")]
        assert rows[k].n_paragraphs == len(lines)
        assert rows[k].n_notices == sum(x in forms.values() for x in lines)


def test_families_and_unknown(spark, scanner):
    cases = {
        1: ("This software is released under the MIT License (see LICENSE).", ["mit"]),
        2: ("licensed under the apache license, version 2.0", ["apache-2.0"]),
        3: ("Licensed under a Flurbish custom license with its own terms.", ["unknown"]),
        4: ("The weather in the north was mild and dry for weeks.\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0.", ["cc-by-nc-4.0", "mit"]),
        5: (None, []),
        6: ("", []),
        7: (" \n\n", []),
        8: ("the and of " * 30_000, []),
    }
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in cases.items()] + [(5, None, "y")], "doc_id long, text string, family string")
    assert {r.doc_id: r.licenses for r in licenses.scan(docs, scanner).collect()} == {k: w for k, (_, w) in cases.items()}
    assert licenses.scan(docs.limit(0), scanner).count() == 0


def test_trains_without_documents(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert [r.licenses for r in licenses.scan(docs, licenses.train(docs.limit(0))).collect()] == [["mit"]]


def test_main_path_has_no_python(spark, scanner):
    plan = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"), scanner)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_other_licences_are_unknown(spark, scanner):
    cases = [
        "Licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC-ND 3.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under the Apache License, Version 1.1.",
        "Released under the BSD 2-Clause License.",
    ]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.doc_id: (r.licenses, r.n_notices) for r in licenses.scan(docs, scanner).collect()} == {k: (["unknown"], 1) for k in range(len(cases))}


def test_wrapped_notices(spark, scanner):
    long = {f: licenses.TEMPLATES[f][3] for f in ("mit", "gpl-3.0", "bsd-3-clause")}
    cases, want = [], {}
    for f, notice in long.items():
        for width in (45, 60, 72):
            for before in ("", "# ", " * "):
                k = len(cases)
                lines = [before + x for x in textwrap.wrap(notice, width)]
                cases.append((k, "\n".join(["The weather in the north was mild and dry for weeks.", "", *lines, "", "The end of the story."])))
                want[k] = ([f], 1, len(lines) + 2)
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    assert {r.doc_id: (r.licenses, r.n_notices, r.n_paragraphs) for r in licenses.scan(docs, scanner).collect()} == want


ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def test_other_cases(spark, scanner):
    mit = "\n".join(textwrap.wrap(licenses.TEMPLATES["mit"][3], 80))
    cases = [
        (mit, ["mit"], 1),
        ("\n".join(textwrap.wrap(ISC, 72)), ["unknown"], None),
        ("CC0 1.0 Universal (CC0 1.0) Public Domain Dedication, a license without conditions.", ["unknown"], 1),
        ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this story.", ["unknown"], 1),
        ("Licensed under the Eclipse Public License 2.0", ["unknown"], 1),
        ("All rights reserved words of the park", [], 0),
        ("Copyright 2011 The Press. All rights reserved.", ["all-rights-reserved"], 1),
        ("The rights of way were granted in the old town, and the permission slip was lost by the boys.", [], 0),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs, scanner).collect()}
    assert {k: rows[k].licenses for k in rows} == {k: want for k, (_, want, _) in enumerate(cases)}
    assert all(n is None or rows[k].n_notices == n for k, (_, _, n) in enumerate(cases))


def test_null_and_repeated_keys_and_clashing_names(spark, scanner):
    line = "Released under the MIT License."
    docs = spark.createDataFrame([(None, line, 1, 2, 3), (None, line + "\n\nx", 1, 2, 3), (4, "a\nb", 1, 2, 3), (4, "Licensed under CC BY 4.0.", 1, 2, 3)], "doc_id string, text string, row int, paragraph int, n int")
    rows = {r.doc_id: (r.licenses, r.n_paragraphs, r.n_notices) for r in licenses.scan(docs, scanner).collect()}
    assert rows == {None: (["mit"], 3, 2), "4": (["cc-by-4.0"], 3, 1)}


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_a_notice_and_the_lines_that_refer_to_it(spark, scanner):
    lines = APACHE.split("\n")
    cases = [APACHE, "\n".join(lines[:3]), APACHE + "\n\nThe end.", "The weather was mild.\n" + APACHE, APACHE + "\n\nLicensed under the Eclipse Public License 2.0"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = {r.doc_id: (r.licenses, r.n_notices) for r in licenses.scan(docs, scanner).collect()}
    assert rows == {**dict.fromkeys(range(4), (["apache-2.0"], 1)), 4: (["apache-2.0", "unknown"], 2)}


def test_texts_of_many_cue_lines(spark, scanner):
    """Windows are made a block at a time: texts of 50 KB and of 5 MB of lines that all have a cue."""
    line = "a line of some words about the copyright of things and the rights of all the others"
    docs = spark.createDataFrame([(1, "\n".join([line] * 616)), (2, "\n".join([line] * 60_000)), (3, "\n".join([line + " x" * 100_000] * 40))], "doc_id long, text string")
    rows = {r.doc_id: r.n_paragraphs for r in licenses.scan(docs, scanner).collect()}
    assert rows == {1: 616, 2: 60_000, 3: 40}


def test_blocks_give_the_windows_of_whole_texts(spark, scanner):
    """A wrapped notice at every place around the end of a block."""
    wrapped = textwrap.wrap(licenses.TEMPLATES["mit"][3], 60)
    cases = [(k, "\n".join([*["The weather was mild."] * k, "", *wrapped, "", "The end."])) for k in range(licenses.BLOCK - 10, licenses.BLOCK + 4)]
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    assert {r.doc_id: (r.licenses, r.n_notices, r.n_paragraphs) for r in licenses.scan(docs, scanner).collect()} == {k: (["mit"], 1, k + len(wrapped) + 1) for k, _ in cases}


def plainly(paragraph, scanner, model):
    """The family of a paragraph and its share, without Spark."""
    words = [w for w in re.split(r"[\W_]+", paragraph.lower()) if w]
    terms = set(words) | {" ".join(p) for p in zip(words, words[1:], strict=False)}
    weights, intercepts, place = model
    logits = intercepts + sum((weights[:, place[t]] for t in terms if t in place), start=0)
    p = np.exp(logits - logits.max())
    p /= p.sum()
    known = p[2:]
    family = sorted(licenses.TEMPLATES)[int(known.argmax())]
    share = 0
    if 1 - p[0] <= scanner.bar:
        return None, 0
    needed, other = licenses.TELLING[family]
    tells = all(terms & set(x) for x in needed) and not terms & set(other) and (family != "all-rights-reserved" or re.search(r"rights reserved\s*($|[^\w\s])", paragraph.lower()))
    if p[1] / (p[1] + known.max()) <= scanner.doubt and tells:
        share = max(len(terms & set(t)) / len(t) for t in scanner.template_terms[family])
    if share >= licenses.CONFIRM:
        return family, share
    return ("unknown" if re.search(licenses.SPEAKS, paragraph.lower()) else None), share


def test_against_a_plain_version(spark, scanner):
    """Lines of the real table and made-up ones, all of them, without the filter by cues."""
    lines = {x for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for x in r.text.split("\n") if x.strip()}
    lines |= {f.format(n) for ns in [*licenses.NAMES.values(), licenses.OTHER_NAMES] for n in ns for f in (*licenses.FORMS, *licenses.HELD_OUT_FORMS, "In the end, {} and the park.")} | set(licenses.UNKNOWN_TEMPLATES)
    model = (scanner.model.coefficientMatrix.toArray(), scanner.model.interceptVector.toArray(), {t: i for i, t in enumerate(scanner.vocabulary.vocabulary)})
    want = {x: plainly(x, scanner, model)[0] for x in lines}
    docs = spark.createDataFrame(list(enumerate(sorted(lines))), "doc_id long, text string").repartition(4)
    found = {r.paragraph: r.family for r in licenses.notices(docs, scanner).collect()}
    assert found == {x: f for x, f in want.items() if f} and len(found) > 150
    known = {f.format(n): (fam if f not in licenses.FORMS else None) for fam, ns in licenses.NAMES.items() for n in ns for f in licenses.HELD_OUT_FORMS}
    right = sum(found.get(x) == fam for x, fam in known.items())
    assert right >= 0.7 * len(known)  # short forms such as a bare name may stay unknown
    other = [f.format(n) for n in licenses.OTHER_NAMES for f in licenses.HELD_OUT_FORMS]
    assert sum(found.get(x) == "unknown" for x in other) >= 0.95 * len(other)
