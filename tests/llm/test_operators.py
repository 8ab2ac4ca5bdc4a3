"""Edge cases and brute-force comparisons of the corpus operators on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewright.llm.containment import contained_items, decontaminated
from tidewright.llm.curriculum import curriculum_mix
from tidewright.llm.language_bitmask import identified, languages, learn
from tidewright.llm.level_doubling import remove_repeats
from tidewright.llm.licence_digests import licence_scan, register
from tidewright.llm.line_chunks import dedup_lines
from tidewright.llm.multi_index import nearest
from tidewright.llm.ngram_jaccard import ngram_jaccard_join
from tidewright.llm.path_templates import judge_urls
from tidewright.llm.queries import settings
from tidewright.llm.weak_pii import SpanClassifier, base_matches, candidates, loose_matches, personal_spans

SCHEMA = "doc_id long, text string, lang string, source string, size string, keys string, node string"


@pytest.fixture(scope="module", autouse=True)
def small_batches(spark):
    settings(spark)


def test_words_of_parts_hash_alike(monkeypatch):
    from tidewright.llm import words as w

    rng = random.Random(9)
    texts = ["".join(rng.choice("abé \n\t") for _ in range(rng.randrange(0, 90))).encode() for _ in range(60)] + [None, b"", b"  "]
    whole, counts = w.word_hashes(texts)
    assert counts.tolist() == [len((t or b"").split()) for t in texts]
    by_hash = dict(zip(whole.tolist(), [x for t in texts for x in (t or b"").split()]))
    assert len(by_hash) == len(set(by_hash.values()))
    for size in (1, 7, 50):
        monkeypatch.setattr(w, "PART_BYTES", size)
        again, n = w.word_hashes(texts)
        assert (again == whole).all() and (n == counts).all()


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, src, "x", "y", "z") for i, t, lang, src in rows], SCHEMA)


def words(rng, n, pool=None):
    return " ".join(rng.choice(pool) if pool else f"w{rng.randrange(10**6)}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, blanks, repeated rows, one long text."""
    rng = random.Random(5)
    rows, base = [], words(rng, 120)
    rows += [(i, base, "en", "a") for i in range(40, 46)]
    for i in range(60, 140):  # near copies, more than a column is paired for
        w = base.split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a"))
    passage = words(rng, 40)
    rows += [(i, f"{words(rng, 25)}\n{passage}\n{words(rng, rng.randrange(3, 60))}", "en", "b") for i in range(200, 260)]
    rows += [(i, f"{passage} {words(rng, rng.randrange(0, 12))}", "en", "b") for i in range(260, 300)]
    rows += [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one two", "en", None), (5, "One  TWO", "en", "a"), (None, base, "en", "a"), (None, None, None, None)]
    rows += [(6, "same same " * 50, "en", "a"), (7, "same " * 30, "en", "a"), (8, words(rng, 30_000), "en", "a")]
    rows += [(9, base, "en", "a"), (9, base, "en", "a")]
    return rows


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingle_set(t):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join_is_brute_force(spark):
    rows = corpus()
    got = {(r[0], r[1], r[2]) for r in ngram_jaccard_join(table(spark, rows)).collect()}
    sets = {(i, t): shingle_set(t) for i, t, *_ in rows}
    up = {i: i for i, *_ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(i, s) for (i, _), s in sets.items() if i is not None and s]
    for a, (i, x) in enumerate(known):
        for j, y in known[:a]:
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    want = {(i, len(sets[i, t]), None if i is None else find(i)) for i, t, *_ in rows}
    assert got == want


def kept_words(rows, size):
    first = {}
    for i, t, *_ in rows:
        w = split(t)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("size", [3, 13, 30])
def test_repeats_are_brute_force(spark, size):
    rows = corpus()
    want = Counter((i, n, g, hashlib.sha256(k.encode()).hexdigest(), None if row[1] is None else k) for row, (i, n, g, k) in zip(rows, kept_words(rows, size)))
    assert Counter(tuple(r) for r in remove_repeats(table(spark, rows), size).collect()) == want
    assert Counter(tuple(r) for r in remove_repeats(table(spark, rows), size, texts=False).collect()) == Counter(k[:4] for k in want.elements())


def test_containment_is_brute_force(spark):
    rows = corpus()
    texts = [t for _, t, *_ in rows if t and len(t) > 100]
    rng = random.Random(2)
    items = [(k, " ".join(split(texts[k * 7])[10:40]).upper()) for k in range(12)]
    items += [(50, "one two"), (51, None), (52, ""), (None, texts[0]), (53, words(rng, 40))]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = Counter()
    for i, t, *_ in rows:
        for q, text in items:
            s = shingle_set(text)
            c = len(s & shingle_set(t))
            if q is not None and s and 100 * c >= 80 * len(s):
                want[i, q, c, len(s)] += 1
    docs = table(spark, rows)
    assert Counter(tuple(r[:4]) for r in contained_items(docs, frame).collect()) == want
    left = decontaminated(docs, frame)
    free = [(i, t) for i, t, *_ in rows if not any(100 * len(s & shingle_set(t)) >= 80 * len(s) for q, text in items if q is not None and (s := shingle_set(text)))]
    assert left.columns == docs.columns and Counter((r[0], r[1]) for r in left.collect()) == Counter(free)
    assert contained_items(docs, frame.limit(0)).count() == 0


def test_containment_in_several_blocks(spark, monkeypatch):
    from tidewright.llm import containment

    docs = table(spark, corpus())
    items = spark.createDataFrame([(k, " ".join(split(t)[5:30])) for k, (_, t, *_) in enumerate(corpus()) if t and len(t) > 200], "item_id long, text string")
    once = Counter(tuple(r) for r in contained_items(docs, items).collect())
    monkeypatch.setattr(containment, "BLOCK_BYTES", 4000)
    assert once and Counter(tuple(r) for r in contained_items(docs, items).collect()) == once


def test_line_chunks(spark):
    block = "\n".join(f"a line of passage number {k}" for k in range(40))
    rows = [(i, f"own line {i}\n{block}\nlast line {i}", "en", "s") for i in (3, 1, 2, 2)] + [(4, None, None, None), (5, "", "en", None), (6, "\n\n\n\n", "en", "s"), (7, "\n\n\n\n", "en", "s"), (None, block, "en", "s")]
    docs = table(spark, rows)
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    found = defaultdict(list)
    for r in got.collect():
        found[r.doc_id].append(r)
    assert found[1][0].n_removed == 0 and found[1][0].text == rows[1][1]
    for i in (2, 3):
        for r in found[i]:
            assert r.n_removed >= 25 and r.text.startswith(f"own line {i}\n") and r.text.endswith(f"\nlast line {i}")
            assert len(r.text.split("\n")) == r.n_lines - r.n_removed
    assert len(found[2]) == 2 and found[2][0].text == found[2][1].text
    assert found[4][0].text is None and found[4][0].n_lines == 0 and found[5][0].text == "" and found[5][0].n_lines == 1
    assert found[6][0].n_removed == found[7][0].n_removed == 0 and found[None][0].text == block
    assert dedup_lines(docs.limit(0)).count() == 0


def test_mix_takes_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(1, 90)), "en", "hot" if i % 3 else f"s{i % 21}") for i in range(3000)] + [(i, None, None, None) for i in range(3000, 3005)] + [(None, "a b", None, None), (7, "a b c", "en", "hot"), (7, "a b c", "en", "hot")]
    docs = table(spark, rows)
    got = curriculum_mix(docs).collect()
    assert len(got) == len(rows) and got == curriculum_mix(docs.repartition(7)).collect()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and all(target[s] <= 3 * size[s] + 1e-6 for s in target)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at)
    assert curriculum_mix(docs.limit(0)).count() == 0 and curriculum_mix(table(spark, [(1, None, None, None)])).first().target == 0


def test_language_filters(spark):
    rng = random.Random(4)
    pools = {"en": ["the", "and", "with", "thing", "other"], "de": ["der", "und", "nicht", "über", "straße"], "fr": ["les", "être", "avec", "où", "ça"]}
    rows = [(i, words(rng, rng.randrange(3, 40), pools[lang]), lang, lang) for i, lang in enumerate(list(pools) * 80)]
    docs = table(spark, rows + [(1000, None, "en", None), (1001, "", "en", None), (1002, "123 -- 45", "en", None), (1003, "the other", None, None), (None, "über und", None, None)])
    model = learn(docs)
    got = {r.doc_id: r for r in languages(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None)
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows if got[i].held_out]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "de"] and got[1000].score == 0
    kept = identified(docs, model, 0.2)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 2
    none = learn(docs.limit(0))
    assert {r.lang_pred for r in languages(docs, none).collect()} == {"und"} and languages(docs.limit(0), model).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_base_patterns_match_as_written():
    rng = random.Random(6)
    kinds = list(BASE)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@+- ()2é-9%\n0") for _ in range(rng.randrange(1, 60)))
        got = [(k, s, e) for k, s, e, _ in base_matches(text)]
        assert got == [(kinds.index(n), *m.span()) for n in kinds for m in re.finditer(BASE[n], text)]


def test_loose_spellings():
    text = "a.b (at) mail (dot) org, c[at]d.net, (212) 555-0100, 212-555-0101, x212 555 0102, +1 212-555-0103, 1212-555-0104, 212-555-0105-1, 212) 555-0106"
    got = [text[s:e] for _, s, e in loose_matches(text)]
    assert got == ["a.b (at) mail (dot) org", "c[at]d.net", "(212) 555-0100", "212-555-0101", "212 555 0102", "212-555-0103"]
    assert [text[s:e] for _, s, e, _ in candidates(text)[1]] == got[:-1]


def test_long_runs_take_linear_time():
    for text in ("a" * 10**6, "1" * 10**6, "1." * 10**5, "@" * 10**5, "+1" * 10**5, "a.b@c." * 10**5, "1 " * 10**5):
        candidates(text)


def test_personal_spans(spark):
    card, near = "4111 1111 1111 1111", "4111 1111 1111 1112"
    rows = [(1, f"é mail a.b@x.org, call +1 (212) 555-0100, card {card}, host 10.0.0.1", "en", "s"), (2, f"{near} 300.1.1.1 +12 plain", "en", "s"), (3, None, None, None), (4, "", "en", None), (None, "x@y.zz", "en", "s"), (5, "clean words only", "en", "s")]
    got = {r.doc_id: r for r in personal_spans(table(spark, rows)).collect()}
    one = got[1]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1)
    want = []
    for kind, part in (("email", "a.b@x.org"), ("ip", "10.0.0.1"), ("card", card), ("phone", "+1 (212) 555-0100")):
        at = rows[0][1].index(part)
        want.append(f"{kind}:{at}:{at + len(part)}")
    assert one.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(one.spans.split(","))
    for i in (2, 3, 4, 5):
        assert got[i].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].spans == "" and got[None].n_email == 1
    assert personal_spans(table(spark, rows).limit(0)).count() == 0


def test_agreement_finds_the_reliable_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.5
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 for p in (0.95, 0.9, 0.9, 0.55, 0.5)], 1)
    codes = Counter(int(sum(v * 3 ** (4 - j) for j, v in enumerate(row)) * 8) for row in votes)
    model = SpanClassifier(codes)
    right = np.mean([(model.chance[int(sum(v * 3 ** (4 - j) for j, v in enumerate(row)) * 8)] > 0.5) == t for row, t in zip(votes, truth)])
    assert right > 0.93


def test_nearest_has_high_recall(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    vectors[100:1100] = vectors[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [1.0], 1), (5080, [None] * 16, 1), (None, vectors[0].tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = nearest(frame, candidates=400).collect()
    exact = vectors.astype(float) @ vectors.astype(float).T
    hits = total = 0
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
        assert r.query_id != r.vec_id and abs(r.score - exact[r.query_id, r.vec_id]) < 1e-9
    assert set(by) == set(range(0, 3000, 20))
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        want = sorted((i for i in range(3000) if i != q), key=lambda i: (-exact[q, i], i))[:20]
        hits += len({r.vec_id for r in found} & set(want))
        total += 20
    assert hits / total >= 0.9
    few = frame.filter("vec_id < 5")
    assert {(r.query_id, r.vec_id) for r in nearest(few).collect()} == {(0, i) for i in range(1, 5)}
    assert nearest(frame.filter("vec_id >= 5000")).count() in (0, 1) and nearest(frame.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, "HTTPS://WWW.Example.com/en/x?q#f"), (2, "http://example.com/en/1"), (3, "http://a.b.net/es/"), (4, "http://net/fr/x"), (5, "http://xnet/fr/x"), (6, "http://a.com"), (7, "http://a.com/"), (8, None), (9, "no host"), (10, "x://h?y://z/"), (None, "http://e.org/a/b")]
    rows += [(100 + i, f"http://mixed.net/{'fr' if i % 10 else 'de'}/{i}") for i in range(60)] + [(2, "http://example.com/en/1")]
    frame = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, path string")
    got = defaultdict(list)
    for r in judge_urls(frame).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("www.example.com", "/en/x", "www.example.com/en/", "allow")] and got[2] == [("example.com", "/en/1", "example.com/en/", "block")] * 2
    assert got[3][0][2:] == ("net/es/", "block") and got[4][0][2:] == ("net/fr/", "block") and got[5][0][2] is None
    assert got[6] == [("a.com", "", None, "allow")] and got[7] == [("a.com", "/", "com/", "allow")]
    assert got[8] == got[9] == [("", "", None, "allow")] and got[10][0][:2] == ("h", "") and got[None][0][0] == "e.org"
    assert sum(map(len, got.values())) == len(rows) and {got[100 + i][0][3] for i in range(60) if i % 10 == 0} == {"allow"}
    assert judge_urls(frame.limit(0)).count() == 0


def test_mixed_templates_are_rejected_by_purity(spark):
    rows = [(i, f"http://h{i % 3}.net/{'fr' if i % 2 else 'es'}{'' if i % 9 else 'x'}/p") for i in range(90)]
    rows += [(200 + i, f"http://bad.net/u{i}/fr") for i in range(5)] + [(300 + i, f"http://worse.net/{'fr' if i < 40 else f'z{i}'}/{i}") for i in range(44)]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[300].template == "/fr/*" and got[343].template == "/*/*" and got[200].template == "/*/fr"


def test_licences(spark):
    mit = "Copyright (c) 2020 Someone\n\nReleased under the MIT Licence!\n"
    rows = [(1, mit, "en", "s"), (2, "text\nLicensed under the Apache License, Version 2.0\nmore", "en", "s"), (3, None, None, None), (4, "", "en", None), (5, "Released under the MIT License and more", "en", "s"), (None, "released under the mit license", "en", "s"), (2, "x", "en", "s")]
    docs = table(spark, rows)
    got = Counter((r.doc_id, r.line, r.license_id) for r in licence_scan(docs, register(spark)).collect())
    assert got == Counter([(1, 0, "MIT"), (1, 3, "MIT"), (2, 2, "Apache-2.0"), (None, 0, "MIT"), (None, 1, "MIT")])
    assert licence_scan(docs.limit(0), register(spark)).count() == 0 and licence_scan(docs, register(spark, []).limit(0)).count() == 0


def near_misses(rng, n):
    """Documents of one core and some of a dozen passages: most pairs lie just under the bound, some reach it."""
    core, parts = [f"c{i}" for i in range(150)], [[f"p{k}w{i}" for i in range(14)] for k in range(12)]
    return [" ".join(core + [w for k in sorted(rng.sample(range(12), 5)) for w in parts[k]]) for _ in range(n)]


@pytest.mark.parametrize("side, n", [(1 << 19, 100), (1 << 19, 200), (3000, 200)])
def test_pairs_under_the_bound_are_sums_and_not_rows(spark, monkeypatch, side, n):
    from tidewright.llm import ngram_jaccard as nj

    monkeypatch.setattr(nj, "SIDE", side)
    given = []
    products = nj._products
    monkeypatch.setattr(nj, "_products", lambda nodes, *more: given.append(nodes.count()) or products(nodes, *more))
    rng = random.Random(n)
    texts = near_misses(rng, n) + [" ".join(f"u{k}x{i}" for i in range(60 + k)) for k in range(20)] + [" ".join(f"u{k}x{i}" for i in range(60)) for k in range(20)]
    texts += [words(rng, 400)] * 3 + [words(rng, 4)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(table(spark, rows)).collect()}
    assert got == components_by_force(rows)
    assert len(given) == 1 and given[0] <= len(rows)  # what the products read grows with the documents


def components_by_force(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    label = {i: i for i in sets}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}
