"""The corpus pipeline against a plain Python version of its stages, and the entry point with and without the subpackage."""

import hashlib
import math
import random
import shutil
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_operators import shingle_set, split

ROOT = Path(__file__).resolve().parents[2]
POOLS = {"en": ["the", "and", "with", "thing", "other"], "de": ["der", "und", "nicht", "über", "straße"], "fr": ["les", "être", "avec", "où", "ça"]}


def made(rng, lang, n):
    return " ".join(rng.choice(POOLS[lang]) + rng.choice("aeiou") * rng.randrange(1, 4) + rng.choice("bdnrst") for _ in range(n))


def corpus():
    rng = random.Random(8)
    passage = [made(rng, "en", 9) for _ in range(14)]
    items = [(k, made(rng, "en", 30)) for k in range(4)]
    rows = []
    for i in range(240):
        lang = list(POOLS)[i % 3]
        lines = [made(rng, lang, rng.randrange(4, 12)) for _ in range(rng.randrange(2, 9))]
        if i % 11 == 0:
            lines[1:1] = passage
        if i % 23 == 0:
            lines.append(items[i % 4][1])
        rows.append((i, "\n".join(lines), lang, f"src{i % 5}" if i % 2 else "hot", len("\n".join(lines))))
    for i in range(240, 280):  # copies and near copies
        text = rows[(i * 7) % 60][1]
        w = text.split(" ")
        if i % 2 and len(w) > 30:
            w[20] = "changed"
        rows.append((i, " ".join(w), rows[(i * 7) % 60][2], None, len(text)))
    rows += [(300, None, "en", "hot", 0), (301, "", "en", "hot", 0), (302, "12 34 !", "en", "hot", 7)]
    return rows, items


def without_repeats(rows):
    """Line dedup as documented: chunks end where the rolling hash is a multiple of four."""
    cut, first = {}, {}
    for i, t, *_ in rows:
        lines, chunk, last = t.split("\n"), [], 0
        cut[i] = []
        for k, line in enumerate(lines):
            h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
            chunk.append(line)
            if k == len(lines) - 1 or (h + 31 * last) % 4 == 0:
                cut[i].append((k - len(chunk) + 1, chunk))
                chunk = []
            last = h
        for start, c in cut[i]:
            if len(c) > 1:
                first[tuple(c)] = min(first.get(tuple(c), (i, start)), (i, start))
    out = []
    for i, t, *rest in rows:
        kept = [c for start, c in cut[i] if len(c) == 1 or not any(x.strip() for x in c) or first[tuple(c)] == (i, start)]
        if kept:
            text = "\n".join(x for c in kept for x in c)
            out.append((i, text, *rest[:2], len(text)))
    return out


def one_of_each(rows):
    sets, up = {i: shingle_set(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return [r for r in rows if find(r[0]) == r[0]]


def mixed(rows):
    size = {r[0]: len(split(r[1])) for r in rows}
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size[r[0]]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, free, rest = {}, set(total), sum(total.values())
    while True:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * total[s]}
        if not full:
            break
        for s in full:
            target[s] = 3 * total[s]
            rest -= 3 * total[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    taken, ahead = {}, defaultdict(int)
    for r in sorted(rows, key=lambda r: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16)):
        need, s = math.floor(target[r[3]] + 0.5), total[r[3]]
        taken[r[0]] = need // s * size[r[0]] + max(0, min(size[r[0]], need % s - ahead[r[3]]))
        ahead[r[3]] += size[r[0]]
    return {(*r, size[r[0]], taken[r[0]]): target[r[3]] for r in rows if taken[r[0]] > 0}


def test_pipeline_is_its_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = without_repeats([r for r in rows if r[0] < 300])
    left = one_of_each(left)
    left = [r for r in left if not any(100 * len(shingle_set(t) & shingle_set(r[1])) >= 80 * len(shingle_set(t)) for _, t in items)]
    want = mixed(left)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) < 280 and {(r.doc_id, r.text, r.lang, r.source, r.n_chars, r["size"], r.taken) for r in got} == set(want)
    assert all(abs(r.target - want[r.doc_id, r.text, r.lang, r.source, r.n_chars, r["size"], r.taken]) < 1e-6 for r in got)
    assert [r.position for r in got] == sorted(r.position for r in got)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("there", [True, False])
def test_entry_with_and_without_the_subpackage(tmp_path, there):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm" if not there else "x", "__pycache__"))
    if not there:
        (tmp_path / "repo/corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, sum(n.startswith('op') and n[2].isdigit() for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True).stdout.split()
    assert out[1:] == (["True", "13", "True"] if there else ["False", "0", "True"])
