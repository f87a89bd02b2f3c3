"""op7 and op10 against brute force, op6 against all pairs, components against union-find."""
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from fleetpulse.llm import minhash_dedup, paragraph_dedup
from fleetpulse.llm.common import connected_components
from fleetpulse.llm.minhash_dedup import near_duplicates
from fleetpulse.llm.vector_dedup import near_vectors
from odd_tables import none, odd  # noqa: F401

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def shingles(text, width):
    words = WORD.findall(lowered(text))
    return frozenset() if not words else frozenset([tuple(words)] if len(words) < width else zip(*(words[k:] for k in range(width))))


def grouped(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def alike(sets, percent=80):
    for (a, x), (b, y) in combinations(sorted(sets.items()), 2):
        both = len(x & y)
        if both and 100 * both >= percent * (len(x) + len(y) - both):
            yield a, b


@pytest.mark.parametrize("width", [4, 5])
def test_minhash_equals_all_pairs(spark, odd, width):
    rng = random.Random(width)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 4])):
            copy = [w if rng.random() > 0.02 else rng.choice(vocabulary) for w in base]
            rows.append((100 + len(rows), " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    rows += [(r.doc_id, r.text) for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, 80).collect()}
    sets = {i: shingles(t, width) for i, t in rows}
    want = grouped(sets, alike(sets))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_tables_with_keys_do_not_stay(spark):
    """Behind the result only ids, digests, classes and components are left; it is still right when read again."""
    from fleetpulse.session import shared_dir

    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {x.getPath().getName() for x in files.listStatus(where)} if files.exists(where) else set()
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "other words " + text.upper()), (5, " ".join(f"v{k}" for k in range(40))), (None, text), (6, None)]
    before = names()
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert {x.split("-")[0] for x in names() - before} == {"digests", "classes", "components"}
    want = {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True), (6, 6, True), (None, None, True)}
    for _ in range(2):
        assert {(r.doc_id, r.component_id, r.kept) for r in found.collect()} == want


def test_minhash_odd_and_empty(odd, none):
    rows = near_duplicates(odd, 4).collect()
    assert len(rows) == odd.count()
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (2, 4, 10, 11)} == {2: 1, 4: 4, 10: 6, 11: 6}
    assert near_duplicates(none).collect() == []


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, k) for k in range(2000, 2100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links + links[:9], "u long, v long")).collect()}
    assert got == grouped({x for e in links for x in e}, links)
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = []
    for k in range(600):
        v = base[rng.integers(30)] * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.3])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0, None], 1), (1003, [float("nan")] + [1.0] * 15, 1), (1004, rows[0][1], None),
             (1005, [], 1), (None, rows[0][1], rows[0][2]), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, rows[0][1], rows[0][2])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    good = {i: (np.array(v), lab) for i, v, lab in rows if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, (v, _) in good.items()}
    links = [(a, b) for a, b in combinations(sorted(good), 2) if good[a][1] == good[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    n = Counter(x for e in links for x in e)
    want = grouped([i for i, *_ in rows if i is not None], links)
    found = sum(r.n_links for r in got)
    assert found >= 0.9 * 2 * len(links) and all(r.n_links <= n[r.vec_id] for r in got)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {i: (n[i], c, c == i) for i, c in want.items()}
    assert [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, True)]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_paragraphs(spark, odd, none):
    rng = random.Random(5)
    say = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    passage = ". ".join(say(9) for _ in range(7)) + "."
    paragraph = say(60)
    changed = paragraph.split()
    changed[30] = "other"
    rows = [(1, say(20) + "\n" + paragraph + "\n" + say(10)), (2, say(40) + "\n" + " ".join(changed)), (3, say(12) + ". " + passage + " " + say(15)),
            (4, say(30) + "! " + passage + " " + say(3)), (5, say(200)), (6, "short line again\n" + say(9)), (7, "short line again\n" + say(9))]
    got = {r.doc_id: r for r in paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2, 4}
    assert got[2].text == dict(rows)[2].split("\n")[0] + "\n"
    assert got[4].text.encode() + passage[:0].encode() == dict(rows)[4].replace(passage, "").encode()
    kept = paragraph_dedup.without_repeats(odd.dropDuplicates(["doc_id"]))
    assert kept.columns == odd.columns and kept.count() == 13
    assert paragraph_dedup.repeated_passages(none).collect() == []


def test_short_paragraphs(spark):
    """Lines from one shingle on take part: boilerplate, near copies of short lines, sentences of five words."""
    near = "all rights of this work are kept by those who wrote it in the year of the first print and nobody else has any right to it at all"
    rows = [(1, "alpha one\nread the terms of use\nbeta"), (2, "gamma\nRead the  terms of use"), (3, near), (4, "delta\n" + near + " now"),
            (5, "epsilon zeta eta. We write to you today. theta"), (6, "iota kappa. We write to you today. lambda mu"), (7, "four words are few"), (8, "four words are few")]
    got = {r.doc_id: r.text for r in paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: "gamma\n", 4: "delta\n", 6: "iota kappa.  lambda mu"}


@pytest.mark.parametrize("n", [6, 40, 70, 150, 165, 230])
def test_paragraph_keys_meet_at_the_threshold(n):
    """Pairs at the threshold, also across the border of the short ones: all share a key."""
    rng = np.random.default_rng(n)
    scheme = minhash_dedup.Scheme(paragraph_dedup.BANDS, paragraph_dedup.ROWS)
    cut, met = n - -(-80 * n // 100), 0
    for k in range(400):
        pool = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        pair = [np.sort(x) for x in ((pool, pool[cut:]) if k % 2 else (pool[cut // 2 :], pool[: n - (cut - cut // 2)]))]
        a, b = (minhash_dedup._keys(x, scheme.minima(x), scheme, 80, paragraph_dedup.SHORT) for x in pair)
        met += len(np.intersect1d(a, b)) > 0
    assert met == 400


def test_line_numbers_have_a_bound(monkeypatch):
    monkeypatch.setattr(paragraph_dedup, "MOST_LINES", 3)
    run = lambda text: [b.to_pylist() for b in paragraph_dedup._lines(5)([pa.RecordBatch.from_pydict({"doc_id": [7], "text": [text]})])]
    assert run("a\n\none two three four five\nshort") == [[{"doc_id": 23, "text": "one two three four five"}]]
    with pytest.raises(ValueError):
        run("a\n\n\none two three four five")


def test_candidates_of_buckets():
    """Pairs of many small buckets and of split ones, against every pair; a pair needs one bucket, that of its first common key."""
    rng = np.random.default_rng(4)
    scheme = minhash_dedup.Scheme()
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 40)), dtype=np.uint64)
        for _ in range(5):
            own = np.where(rng.random(len(base)) < 0.06, rng.integers(0, 1 << 63, len(base), dtype=np.uint64), base)
            sets.append(np.unique(own[: max(1, len(own) - int(rng.integers(0, 2)))]))
    low = scheme.all_minima(sets)
    assert all((low[k] == scheme.minima(s)).all() for k, s in enumerate(sets))
    tiny = scheme.signature(low)
    component = rng.integers(0, 100, len(sets))
    rows = []
    for blocks in (1, 3):
        block = np.arange(len(sets)) % blocks
        for k, own in enumerate(sets):
            for place, key in enumerate(minhash_dedup._keys(own, low[k], scheme, 80, 160).tolist()):
                for other in range(blocks):
                    x, y = min(int(block[k]), other), max(int(block[k]), other)
                    rows.append((key ^ blocks, x, y, int(block[k]), k + 1000 * blocks, place, len(own), int(component[k])))
    rows.sort(key=lambda r: (r[:3], r[3] != r[1], r[6]))
    columns = ["key", "x", "y", "block", "doc_id", "place", "size", "component"]
    whole = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(8)] + [pa.array([tiny[r[4] % 1000].tobytes() for r in rows])], names=[*columns, "tiny"])
    cut = [whole.slice(at, 37) for at in range(0, whole.num_rows, 37)]
    found = set()
    for batch in minhash_dedup.whole_groups(cut, ["key", "x", "y"]):
        ids = batch.column("doc_id").to_numpy()
        for i, j in minhash_dedup._candidates(batch, scheme, 80):
            found |= {(int(min(a, b)), int(max(a, b))) for a, b in zip(ids[i], ids[j])}
    alike_pairs = [(a, b) for a, b in combinations(range(len(sets)), 2) if component[a] != component[b]
                   and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert len(alike_pairs) > 100
    assert all((a + 1000 * n, b + 1000 * n) in found for a, b in alike_pairs for n in (1, 3))
    opened = [r for batch in minhash_dedup._open_members(scheme, 80)(iter(cut)) for r in batch.column("doc_id").to_pylist()]
    assert set(opened) == {x for pair in found for x in pair}


def test_many_small_buckets_in_time():
    """30,000 buckets of three members take seconds: no data frame per bucket."""
    import time

    rng = np.random.default_rng(1)
    n, tiny = 90_000, [rng.integers(0, 256, 32, dtype=np.uint8).tobytes() for _ in range(3)]
    columns = {"key": np.arange(n) // 3, "x": np.zeros(n, int), "y": np.zeros(n, int), "block": np.zeros(n, int), "doc_id": np.arange(n),
               "place": np.zeros(n, int), "size": np.full(n, 20), "component": np.arange(n)}
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), pa.array(tiny * (n // 3))], names=[*columns, "tiny"])
    start = time.perf_counter()
    assert list(minhash_dedup._open_members(minhash_dedup.Scheme(), 80)(iter([batch]))) == []
    assert time.perf_counter() - start < 20
