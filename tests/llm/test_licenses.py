import re
from itertools import product
from re import _parser

import pytest
from tests.conftest import SF
from tests.llm import odd

from pointloom.llm import licenses


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    words = words_of(text)
    starts, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        starts += found
        labels |= {label} if found else set()
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def brute_labels(text):
    """All rules without the prefilter, and the suppression as a loop over spans."""
    line = " " + " ".join(words_of(text)) + " "
    found = []
    for label, keyword, pattern, priority in licenses.rules():
        if keyword in line:
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", line):
                first = line.count(" ", 0, m.start()) - 1
                found.append((first, -(first + 1 + m.group().count(" ")) - 1, priority, label))
    kept = []
    for d in sorted(found):
        if not any(d[1] >= k[1] and k[2] <= d[2] for k in kept):
            kept.append(d)
    strong = [d for d in kept if d[2] < licenses.HINT]
    base = set(filter(None, brute(text)[4].split(",")))
    return ",".join(sorted(base | {d[3] for d in (strong or kept)}))


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
SAYINGS = [
    "Licensed under the Apache License, Version 2.0 (the License)",
    "SPDX-License-Identifier: GPL-3.0 only. GNU General Public License v3",
    "This is CC BY-SA 4.0, and CC-BY too; cc by nc nd",
    "the GNU Lesser General Public License version 2.1 or later",
    "All Rights Reserved. all rights reserved all rights RESERVED",
    "general public licensee; accby; cc bye; reserved rights all",
    "under an MIT licence; redistribution and use in source and binary forms",
    "licensed under something quite else",
    "generalé public license general public license general public license",
]


@pytest.mark.parametrize("source", ["odd", "sayings", "documents"])
def test_scan_equals_brute_force(spark, source):
    if source == "documents":
        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    elif source == "odd":
        docs = odd.table(spark)
    else:
        rows = list(enumerate(SAYINGS)) + [(100, " filler word ".join(SAYINGS)), (101, " ".join(SAYINGS) * 40)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    ours = sorted((str(r["doc_id"]), *[str(r[n]) for n in NAMES]) for r in licenses.scan(docs).collect())
    assert ours == sorted((str(k), *map(str, brute(t)), brute_labels(t)) for k, t in texts)


def test_contained_detections_are_suppressed(spark):
    text = "it is under the GNU Lesser General Public License version 2.1 or later"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["base_labels"] == "gpl" and row["labels"] == "gpl,lgpl-2.1"
    assert len(row["detections"]) == 1


def test_there_are_hundreds_of_rules_and_stems_cover_them():
    rules = licenses.rules()
    assert len(rules) >= 400
    for label, keyword, pattern, _ in rules:
        plain = re.sub(r"\(\?:|\[sc\]|[()?]", "", keyword + " " + pattern)
        assert any(s in plain for s in licenses.STEMS) or re.search(r"\bcc(0|\b)", plain), label


def test_empty_table(spark):
    assert licenses.scan(odd.empty(spark)).count() == 0


def samples(parsed):
    """A text for each combination of the alternatives of a parsed pattern."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "NOT_LITERAL":
            parts.append(["x"])
        elif name == "IN":
            parts.append(["x"] if str(arg[0][0]) == "NEGATE" else [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg])
        elif name == "BRANCH":
            parts.append([t for branch in arg[1] for t in samples(branch)])
        elif name == "SUBPATTERN":
            parts.append(samples(arg[-1]))
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            texts = samples(inner)
            parts.append([t * n for n in range(low, min(int(high), low + 1) + 1) for t in (texts if n else [""])])
        else:
            raise AssertionError(name)
    return ["".join(x) for x in product(*parts)]


def test_gates_let_every_alternative_through():
    for label, keyword, pattern, _ in licenses.rules():
        for text in samples(_parser.parse(pattern)):
            assert re.fullmatch(pattern, text), (pattern, text)
            assert keyword in f" {text} ", (label, keyword, text)
            assert any(s in text for s in licenses.STEMS) or re.search(r"\bcc(0|\b)", text), (label, text)


@pytest.mark.parametrize(
    ("text", "label"),
    [("GNU Library General Public License version 2", "lgpl-2"), ("no unauthorised copying", "proprietary"),
     ("under the Open Data Commons Database License", "odbl"), ("see the Server Side Public License.", "sspl"),
     ("Unless required by applicable law or agreed to in writing, software\n distributed under the License is distributed on an \"AS IS\" BASIS", "apache-2.0"),
     ("Redistributions of source code must retain the above copyright\n * notice", "bsd"),
     ("any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose", "warranty-disclaimer")],
)
def test_spellings_behind_the_gates(spark, text, label):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert label in row["labels"].split(",")
