"""Cases that operators once passed over."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm.licence_digests import COPYRIGHT, known, licence_scan, register
from tidewright.llm.line_chunks import dedup_lines
from tidewright.llm.queries import settings

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def small_batches(spark):
    settings(spark)


@pytest.mark.parametrize("out", ["en", "de"])
def test_language_left_out_of_the_learning_is_rejected(spark, out):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("text rlike '[a-z]'")
    some = docs.withColumn("lang", F.when(F.col("lang") != out, F.col("lang"))).checkpoint()
    kept = corpus_pipeline.language_id(spark, some, SF_DIR).groupBy(F.col("lang").isNull().alias("foreign")).count().collect()
    all_ = some.groupBy(F.col("lang").isNull().alias("foreign")).count().collect()
    kept, all_ = ({r.foreign: r["count"] for r in x} for x in (kept, all_))
    assert kept.get(True, 0) <= 0.02 * all_[True] and kept[False] >= 0.99 * all_[False]


def test_mixed_chunks_find_runs_short_passages_and_copies(spark):
    rng = random.Random(6)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(4))
    copies = [[line() for _ in range(n)] for n in range(2, 40)] + [[line()] * n + [line()] for n in range(2, 12)] + [[line()] * n for n in range(2, 12)]
    rows = [(2 * k + j, "\n".join(c)) for k, c in enumerate(copies) for j in (0, 1)]
    passages = [[line() for _ in range(12)] for _ in range(40)]
    rows += [(1000 + 2 * k + j, "\n".join([line() for _ in range(5)] + p + [line() for _ in range(5)])) for k, p in enumerate(passages) for j in (0, 1)]
    docs = spark.createDataFrame(rows + [(5000, "only"), (5001, "only"), (5002, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_lines(docs, mixed=True).collect()}
    for k, c in enumerate(copies):
        assert got[2 * k].n_removed < len(c) and got[2 * k + 1].n_removed == len(c) == got[2 * k + 1].n_lines
        assert len(set(c)) < len(c) or got[2 * k].n_removed == 0
    assert all(got[1000 + 2 * k].n_removed == 0 for k in range(40)) and got[5001].n_removed == 0
    gone = [got[1001 + 2 * k].n_removed for k in range(40)]
    assert max(gone) <= 12 and sum(g > 0 for g in gone) >= 36 and sum(gone) > 0.5 * 12 * 40


def test_licences_above_code_and_in_lines(spark):
    text = {}
    for i, t in known():
        text[i] = max(text.get(i, ""), t, key=len)
    rows, want = [], set()
    for k, i in enumerate(("MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause")):
        words = text[i].split(" ")
        wrapped = text[i] if len(text[i]) > 4000 else "\n".join(" ".join(words[j : j + 9]) for j in range(0, len(words), 9))
        rows.append((k, "#!/bin/sh\n# Copyright 2020 Someone\n" + "\n".join(f"# {x}" for x in wrapped.split("\n")) + "\nimport os\n"))
        want.add((k, i))
    rows += [(50, "// SPDX-License-Identifier: MPL-2.0\nint x;"), (51, "# Tool\n\nThis project is licensed under the MIT License.\n"), (52, "Permission is hereby granted,\nfree of charge, to\nnobody"), (53, None)]
    want |= {(50, "MPL-2.0"), (51, "MIT")}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licence_scan(docs, register(spark)).collect()
    assert want <= {(r.doc_id, r.license_id) for r in got} and not {52, 53} & {r.doc_id for r in got}
    assert all(max(r.line for r in got if r.doc_id == k) >= 3 and min(r.line for r in got if r.doc_id == k) <= 4 for k in range(10))
    assert {r.line for r in got if r.doc_id in (0, 1)} == {3} and len([r for r in got if r.doc_id == 0]) == 1


def test_every_registered_text_is_found_in_any_wrapping(spark):
    rows, want, unlucky = [], {}, set()
    for n, (i, text) in enumerate(known()):
        for width in (6, 7, 8, 9, 10, 11, 12, 17):
            # The text's own copyright lines stay lines; all else is one paragraph between them.
            wrapped, words = [], []
            for x in [*text.split("\n"), "© end"]:
                if re.search(COPYRIGHT, x):
                    wrapped += [" ".join(words[j : j + width]) for j in range(0, len(words), width)] + [x]
                    words = []
                else:
                    words += x.split()
            wrapped.pop()
            # Two licences show a notice inside a sentence; a line that starts with it is read as a copyright line.
            if sum(bool(re.search(COPYRIGHT, x)) for x in wrapped) > sum(bool(re.search(COPYRIGHT, x)) for x in text.split("\n")):
                unlucky.add((i, width))
                continue
            doc = 100 * n + 2 * width
            # As the whole text, and behind comment marks above code.
            rows += [(doc, "\n".join(wrapped)), (doc + 1, "\n".join(["#!/bin/sh", "# (c) 2021 Someone", *("# " + x for x in wrapped), "exit 0"]))]
            want[doc], want[doc + 1] = i, i
    changed = {i: t for i, t in known() if i in ("GPL-3.0", "Apache-2.0", "MPL-2.0")}
    rows += [(-k, t.replace("You must retain", "You may drop").replace("under Patent Claims", "under no claims").replace("copyright on the Program", "copyright on nothing")) for k, t in enumerate(changed.values(), 1)]
    got = {}
    for r in licence_scan(spark.createDataFrame(rows, "doc_id long, text string"), register(spark)).collect():
        got.setdefault(r.doc_id, set()).add((r.line, r.license_id))
    missed = [(d, i) for d, i in want.items() if not any(found == i and (line == 0) == (d % 2 == 0) for line, found in got.get(d, ()) if d % 2 or line == 0)]
    assert len(want) == 16 * len(known()) - 2 * len(unlucky) and not missed, missed
    assert {i for i, _ in unlucky} <= {"GPL-2.0", "GPL-3.0"} and len(unlucky) <= 4
    assert not any(line == 0 for d in (-1, -2, -3) for line, _ in got.get(d, ()))
