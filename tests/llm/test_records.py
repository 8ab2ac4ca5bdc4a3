"""Archives, manifests and hard negatives against plain Python on small tables with every odd case."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewright.llm import hard_negatives
from tidewright.llm.capture_index import captures, url_key, write_archive
from tidewright.llm.hard_negatives import mine
from tidewright.llm.merkle import climb, leaf_digest, manifest, numbered, tampered_manifest
from tidewright.llm.queries import settings


@pytest.fixture(scope="module", autouse=True)
def small_batches(spark):
    settings(spark)


# ------------------------------------------------------------------------------------------------ archives

PAGES = "page_id long, url string, html string, key string, line string, part string, __sha string"


def page_rows():
    rows = [(i, f"http://{'www.' * (i % 2)}Site{i % 5}.example.com/a/{i % 40}?q={i}#x", f"<p>{i % 60}</p>" * (i % 7)) for i in range(1, 300)]
    rows += [(400 + i, "https://hot.example.com/", "same page") for i in range(200)]
    rows += [(700, None, "no target"), (701, "-", "a dash"), (702, "no scheme at all", None), (703, "http://ü.example/ä b\r\nX: y", "\r\n\r\nWARC/1.1\r\n"), (704, "", ""), (None, "http://x.org", "nobody's"), (None, "http://x.org", "same page")]
    rows += [(705, "http://u:p@h.org:80/z", "é" * 10), (706, "http://10.0.0.7:8080/z", "x" * 3_000_000), (707, "http://h.org/z", "twice"), (707, "http://h.org/z", "twice")]
    return [(*r, "k", "l", "p", "s") for r in rows]


def expected_records(rows, least=0):
    by = defaultdict(list)
    for page_id, _, html, *_ in rows:
        by[(html or "").encode()].append(page_id)
    out = []
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        first = min((i for i in by[payload] if i is not None), default=None)
        again = len(payload) >= least and first is not None and page_id != first
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got_records(frame):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str)


@pytest.mark.parametrize("least", [0, 9])
def test_archives_read_back_through_their_index(spark, tmp_path, least):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    folder = f"file://{tmp_path}/a"
    write_archive(pages, folder, min_bytes=least, lines=16)
    found = captures(spark, folder, pages.select("url"))
    assert got_records(found) == expected_records(rows, least)
    whole = {r.page_id: r for r in found.collect()}
    assert whole[703].payload == b"\r\n\r\nWARC/1.1\r\n" and whole[703].url == "http://%C3%BC.example/%C3%A4%20b%0D%0AX:%20y" and whole[700].url is None
    assert len(whole[706].payload) == 3_000_000 and whole[401].payload is None and whole[401].refers_to == 400
    # archives are plain WARC: members of one gzip file, record after record
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "a", "warc").iterdir())
    assert raw.count(b"WARC-Type: ") == len(rows) and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    directory = spark.read.parquet(f"{folder}/directory").orderBy("first_key", "last_key").collect()
    assert sum(d.n for d in directory) == len(rows) and all(d.n <= 16 for d in directory)
    assert all(x.last_key <= y.first_key for x, y in zip(directory, directory[1:]))


def test_lookups_of_some_urls(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES)
    folder = f"file://{tmp_path}/a"
    write_archive(pages, folder, lines=16)
    asked = ["https://hot.example.com/#top", "https://HOT.example.com:443", "http://nowhere.org/", None, "http://h.org/z", "zzz", "http://h.org/z"]
    found = captures(spark, folder, spark.createDataFrame([(u,) for u in asked], "url string"))
    keys = {url_key(u) for u in asked}
    assert got_records(found) == [r for r in expected_records(rows) if r[0] in {p[0] for p in rows if url_key(p[1]) in keys} and r[0] is not None]
    assert captures(spark, folder, pages.select("url").limit(0)).count() == 0


def test_empty_archive(spark, tmp_path):
    write_archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/a")
    assert captures(spark, f"file://{tmp_path}/a", spark.createDataFrame([("http://a.org/",)], "url string")).count() == 0


def test_a_broken_record_is_told(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/", "text")], "page_id long, url string, html string")
    write_archive(pages, f"file://{tmp_path}/a")
    (file,) = Path(tmp_path, "a", "warc").iterdir()
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"text\r\n", b"next\r\n"), 6, mtime=0))
    with pytest.raises(Exception, match="broken record|incorrect|Error"):
        captures(spark, f"file://{tmp_path}/a", pages.select("url")).collect()


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.Example.com/a?b=1#c", "com,example,www)/a?b=1"), ("https://example.com:443", "com,example)/"), ("http://example.com:81/", "com,example:81)/"),
        ("http://1.2.3.4/x", "1.2.3.4)/x"), ("nothing", "nothing"), (None, "-"), ("http://a.b?x", "b,a)/?x".replace("/?", "?")), ("http://a.b/é", "b,a)/%C3%A9"),
    ],
)
def test_keys(url, key):
    assert url_key(url) == key


# ------------------------------------------------------------------------------------------------ manifests


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def merkle(digests, width):
    """Top and, for each leaf, (left, right) of every level."""
    paths, at, now = [[] for _ in digests], list(range(len(digests))), digests
    while len(now) > 1:
        for leaf, p in enumerate(at):
            z = p - p % width
            paths[leaf].append(("".join(now[z:p]), "".join(now[p + 1 : z + width])))
            at[leaf] = p // width
        now = ["".join(now[z : z + width]) for z in range(0, len(now), width)]
        now = [sha(x) for x in now]
    return now[0], paths


def folded(path, digest):
    for left, right in path:
        digest = sha(left + digest + right)
    return digest


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx string, leaf string, n string, `__part` string"


def doc_rows(sources):
    rng = random.Random(3)
    rows = []
    for source, n in sources.items():
        for _ in range(n):
            rows.append((rng.randrange(10**6), rng.choice([None, "", "Text Ünder Änother", "lower", "A" * 50_000, "1:2-", "ZZ top"]), rng.choice([None, "en"]), source, rng.choice([None, 7])))
    return [(*r, "t", "i", "l", "n", "p") for r in rows]


@pytest.mark.parametrize("sources, width", [({None: 18, "": 1, "b": 300, "ä": 17, "Z": 16}, 16), ({f"s{i:03d}": 1 for i in range(40)}, 16), ({"only": 33}, 16), ({"one": 1}, 16), ({"a": 9, "b": 6, None: 1}, 2)])
def test_manifest_against_plain_hashing(spark, sources, width):
    rows = doc_rows(sources)
    rows += [rows[0], (None, "Text", None, rows[0][3], None, *"tilnp")]  # a repeated row, a row without an id
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    by = defaultdict(list)
    for doc_id, text, lang, source, n, *_ in rows:
        leaf = sha("".join(map(field, (doc_id, source, lang, n, text))))
        shown = text.translate(lower) if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else text
        by[source].append((doc_id is not None, doc_id or 0, leaf, sha("".join(map(field, (doc_id, source, lang, n, shown)))), doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [merkle([x[2] for x in sorted(by[s])], width) for s in order]
    root, over = merkle([t[0] for t in trees], width)
    want = []
    for s, (top, paths), above in zip(order, trees, over):
        for (_, _, leaf, shown, doc_id), path in zip(sorted(by[s]), paths):
            end = folded(path + above, shown)
            want.append((doc_id, leaf, top, root, sha("".join(x + y for x, y in path + above)), end, end == root))
    got = [tuple(r) for r in tampered_manifest(spark.createDataFrame(rows, DOCS).repartition(3), width).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(got) < 40 or any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_nothing_and_its_columns(spark):
    found = tampered_manifest(spark.createDataFrame([], DOCS))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and found.count() == 0


def test_a_changed_leaf_and_only_it_is_told(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"t{i}") for i in range(200)], "doc_id long, source string, text string")
    leaf = leaf_digest(F.col("doc_id"), F.col("text"))
    other = F.when(F.col("doc_id") == 77, F.sha2(F.lit("x"), 256)).otherwise(leaf)
    got = manifest(docs.select("doc_id", "source", leaf.alias("leaf"), other.alias("presented"), F.lit(1).alias("extra")))
    assert [r.doc_id for r in got.filter("not verified").collect()] == [77] and got.select("root").distinct().count() == 1


def test_numbering_splits_a_large_group(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else None, i) for i in range(3000)], "g string, i long").repartition(7)
    got = numbered(rows, "g", "i")
    assert {(r.g, r.i): (r.idx, r.n, r.tree) for r in got.collect()} == {("hot" if i % 3 else None, i): (i - i // 3 - 1, 2000, 1) if i % 3 else (i // 3, 1000, 0) for i in range(3000)}
    tops, levels = climb(got.select("tree", "idx", "n", F.col("g").alias("digest")))
    assert tops.count() == 2 and len(levels) == 3


# ------------------------------------------------------------------------------------------------ hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, score long, kind int, variant int, anchor_id long"


def vector_rows(seed=1, n=400, dims=4):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.3, 0.0, 0.1, 0.25, 0.5, 1.0]) for _ in range(dims)], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]  # coarse, so scores tie
    rows += [(1000, None, 1), (1100, [0.5] * dims, None), (1200, [0.5, None, 0.1, 0.1], 1), (1300, [float("nan")] * dims, 1), (1400, [float("inf")] * dims, 1), (None, [0.5] * dims, 1)]
    rows += [(1500, [0.0] * dims, 0), (1600, [1.0, 1.0], 0), (1601, [1.0, 0.9], 0), (1602, [1.0, 0.8], 1), (1700, [], 2), (1701, [], 2), (1800, [0.9] * dims, 77)]
    rows += [(501, [0.5] * dims, 1)] * 3 + [(502 + i, [0.5] * dims, i % 3) for i in range(90)]
    return [(*r, 1, 2, 3, 4) for r in rows]


def mined(rows, every=100, positives=5, negatives=5):
    import math

    good = {(i, lab, tuple(math.floor(256 * float(x)) for x in v)) for i, v, lab, *_ in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, lab, q in good:
        if i % every:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(q, p)), j, m == lab) for j, m, p in good if j != i and len(p) == len(q)})
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            for rank, (t, k, _) in enumerate([x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives], 1):
                out.append((i, j, rank, k, -s, -t))
    return sorted(out)


@pytest.mark.parametrize("tile, block", [(1 << 21, 16_384), (64, 2)])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, tile, block):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "ANCHORS", block)
    rows = vector_rows()
    got = sorted(tuple(r) for r in mine(spark.createDataFrame(rows, VECTORS).repartition(5)).collect())
    assert got == mined(rows) and len(got) > 40


def test_hard_negatives_of_many_seeds(spark):
    for seed in range(2, 5):
        rows = vector_rows(seed, 150, 3)
        got = sorted(tuple(r) for r in mine(spark.createDataFrame(rows, VECTORS), every=10, positives=3, negatives=4).collect())
        assert got == mined(rows, 10, 3, 4) and len(got) > 40


def test_hard_negatives_of_large_numbers_and_of_nothing(spark):
    rows = [(i, [1e6 + i, -1e6], i % 2) for i in range(12)] + [(100 + i, [1e200 * (1 + i % 3), 1.0, 0.5], i % 2) for i in range(6)]
    rows = [(*r, 1, 2, 3, 4) for r in rows]
    got = sorted(tuple(r) for r in mine(spark.createDataFrame(rows[:12], VECTORS)).collect())
    assert got == mined(rows[:12]) and len(got) > 10
    assert all(r.positive_score == r.negative_score == hard_negatives.LONGEST for r in mine(spark.createDataFrame(rows, VECTORS)).filter("anchor_id = 100").collect())
    assert mine(spark.createDataFrame([], VECTORS)).count() == 0 and mine(spark.createDataFrame(rows[1:12], VECTORS)).count() == 0
