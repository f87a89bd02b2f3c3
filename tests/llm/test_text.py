"""op1, op2, op4 and op5 on small and odd tables; suffix order against sorting; the chain against enumeration."""
import hashlib
import itertools
import random

import numpy as np
import pytest

from fleetpulse.llm import contamination, suffix_dedup, suffix_sort, toxicity, url_filter
from fleetpulse.llm.registry import RULES
from odd_tables import none, odd  # noqa: F401


def test_chain_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(25):
        first = np.concatenate(([0], np.cumsum(rng.integers(0, 6, rng.integers(1, 5)))))
        score, chain = rng.normal(0, 3, first[-1]), rng.normal(0, 1, 5)
        want = []
        for a, b in zip(first[:-1], first[1:]):
            total, one = 0.0, np.zeros(b - a)
            for y in itertools.product((0, 1), repeat=int(b - a)):
                v = np.exp(sum(score[a + k] for k in range(b - a) if y[k]) + (chain[0] if y and y[0] else 0)
                           + sum(chain[1 + 2 * y[k] + y[k + 1]] for k in range(b - a - 1)))
                total, one = total + v, one + v * np.array(y)
            want += (one / total).tolist() if b > a else []
        got = toxicity.marginals(score, first, chain, pairs=True)[0] if len(score) else []
        assert np.allclose(got, want)


def test_toxicity_learns_and_points(spark, odd, none):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(500):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 60))]
        if k % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "grim", "foulest", "foulish"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, known).collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 60 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    text = dict(rows)[0]
    assert [text[s.start : s.end] for s in got[0].spans][0] in ("vile", "rotten", "grim", "foulest", "foulish")
    rows = toxicity.toxicity(odd, known.union(spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic int"))).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(none, known).collect() == []
    assert {r.score for r in toxicity.toxicity(odd, known.limit(0)).collect()} == {0.01}


def test_urls(spark):
    rules = spark.createDataFrame([*RULES, ("org", "/en/1", "block"), (None, "/", "block"), ("a.b", None, "allow"), ("x.org", "/", "block"), ("x.org", "/", "allow")],
                                  "host string, path string, action string")
    urls = {"http://a.example.org/es/9?x": "example.org/es/", "https://EXAMPLE.ORG/es/": "example.org/es/", "http://notexample.org/en/1": "org/en/1",
            "http://example.com/de/#": "com/de/", "http://example.net/": None, "org/x": None, "http://org": None, "x://org/?q": "org/", "http://x.org/e": "x.org/",
            "http://example.org:80/es/": None, "": None, "://": None, "http://b.example.org/en/123": "example.org/en/1"}
    rows = [(k, u) for k, u in enumerate(urls)] + [(90, None), (None, "http://q.org/"), (0, next(iter(urls)))]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule"), rules).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[k].rule for k, _ in enumerate(urls)] == list(urls.values())
    assert (by[90].host, by[90].path, by[90].rule, by[90].verdict) == ("", "", None, "allow")
    assert by[8].verdict == "block" and by[None].rule == "org/" and by[1].host == "example.org"
    assert url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_colliding_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda text: len(text))
    import pyarrow as pa
    batch = next(url_filter._pack([pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array(["ab/", "cd/"]), pa.array([1, 0])], names=["part", "rule", "block"])]))
    import pyarrow.parquet as pq
    import tempfile
    path = tempfile.mkdtemp() + "/one.parquet"
    pq.write_table(pa.Table.from_batches([batch]), path)
    assert url_filter.DigestArray(path).probe(["cd/", "ab/", "ef/", "x"]).tolist() == [0, 1, -1, -1]


def test_templates(spark, odd, none):
    item = "Yesterday the farmer Alice sold 12 km of rope and 7 cows to the merchant Bob for 30 euros while Alice kept 12 goats at home with care"
    other = item.replace("Alice", "Carol").replace("12", "95").replace("7 cows", "8 cows").replace("Bob", "Dave").replace("30", "61")
    mixed = item.replace("12 km", "95 km").replace("sold", "sold").replace("farmer Alice", "farmer Zoe")
    docs = spark.createDataFrame([(1, "before it " + item + " and after"), (2, "so " + other + " then"), (3, "so " + mixed + " then"), (4, "the farmer sold rope")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "tiny"), (3, None), (None, item), (4, "words that no document here has in it anywhere at all")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.contaminated(docs, bench).collect()}
    assert {d: r.kind for d, r in got.items()} == {1: "verbatim", 2: "reparameterised"}
    assert got[2].coverage == 1.0 and got[2].n_slots >= 5 and got[2].consistency == 1.0
    rows = contamination.contaminated(odd, spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {1, 2}
    assert contamination.contaminated(none, bench).collect() == [] and contamination.contaminated(docs, bench.limit(0)).collect() == []


def test_templates_of_names_and_numbers_anywhere(spark):
    """Names at sentence starts and in two parts, numbers with separators: other values, the same template."""
    item = "At noon Alice Brown has 12 apples. Bob has 7 more than Alice. How many apples does Bob have?"
    other = "At noon Carol White has 30 apples. Dan has 9 more than Carol. How many apples does Dan have?"
    price = "A shop pays 1,200 euros for 3.5 tons of corn and sells each ton for 410 euros to Eve at the market"
    cheap = price.replace("1,200", "900").replace("3.5", "4").replace("410", "1,250.75").replace("Eve", "Max")
    names = "Dear friends Anna, Berta, Carla, Doris, Emma and Frida met at the lake for a long swim in the cold water"
    title = "Long Walks Along The Silver River Under Pale Autumn Skies"
    docs = spark.createDataFrame([(1, "First. " + other + " And then?"), (2, "so " + cheap + " now"), (3, "see " + title + " there"),
                                  (4, "see Ten Books About Old Cities And Their Long Lost Bridges there"),
                                  (5, "so " + names.replace("Anna", "Gerda").replace("Carla", "Ines").replace("Emma", "Jutta") + " again"),
                                  (6, "so " + other.replace("than Carol", "than Zoe").replace("does Dan", "does Alice"))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, price), (3, title), (4, names)], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.contaminated(docs, bench).collect()}
    assert {d: (r.item_id, r.kind) for d, r in got.items()} == {1: (1, "reparameterised"), 2: (2, "reparameterised"), 3: (3, "verbatim"), 5: (4, "reparameterised")}
    assert all(r.coverage == 1.0 and r.consistency == 1.0 for r in got.values())


def test_copy_beside_inconsistent_siblings(spark):
    """A copy counts by its own alignment, also with a word put in; siblings with other values beside it take nothing away."""
    item = "so the baker sold 12 loaves to the inn and kept 12 rolls for the mill while 12 more loaves went to the old bridge"
    values = iter(range(50, 99))
    sheet = ". ".join("then " + "".join(str(next(values)) if w == "12" else w for w in item.replace(" ", "| |").split("|")) for _ in range(4))
    docs = spark.createDataFrame([(1, sheet + ". " + item + ". " + sheet), (2, sheet), (3, sheet + ". " + item.replace("12", "77")),
                                  (4, sheet + ". " + item.replace("for the mill", "for the new mill"))], "doc_id long, text string")
    got = {r.doc_id: r for r in contamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert {d: (r.kind, r.consistency) for d, r in got.items()} == {1: ("verbatim", 1.0), 3: ("reparameterised", 1.0), 4: ("verbatim", 1.0)}


@pytest.mark.parametrize("alphabet,limit,small", [(2, 3, 0), (4, 100_000, 2048), (3, 5, 2048)])
def test_suffix_order(monkeypatch, alphabet, limit, small):
    monkeypatch.setattr(suffix_sort, "SMALL_ALPHABET", small)
    rng = np.random.default_rng(alphabet)
    for _ in range(150):
        n = int(rng.integers(1, 50))
        text = np.append(rng.integers(1, alphabet + 1, n - 1), 0)
        sorter = suffix_sort.SuffixSorter(text, 6, limit)
        where, common = (np.concatenate(x).tolist() for x in zip(*sorter.suffixes()))
        sorter.close()
        plain = text.tolist()
        order = sorted(range(n), key=lambda i: plain[i:])
        assert where == order
        assert common == [0] + [next(k for k in range(7) if k == 6 or max(a, b) + k >= n or plain[a + k] != plain[b + k]) for a, b in zip(order, order[1:])]


def removed(texts, length):
    docs, seen = [(t or "").encode() for t in texts], {}
    for b in docs:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    for b in docs:
        mark = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[1 + p : 1 + p + length] = True
        yield len(b), int(mark.sum()), int((mark[1:] & ~mark[:-1]).sum()), hashlib.sha256(bytes(x for x, m in zip(b, mark[1:]) if not m)).hexdigest()


@pytest.mark.parametrize("length,hot", [(40, 200_000), (64, 2)])
def test_repeated_bytes(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_SYMBOLS", 3000)
    rng = random.Random(length)
    draw = lambda n, al: "".join(rng.choice(al) for _ in range(n))
    shared = [draw(rng.randint(30, 200), "abcdé ") for _ in range(6)]
    rows = []
    for k in range(200):
        text = "".join(rng.choice(shared)[rng.randint(0, 20) : rng.randint(40, 200)] if rng.random() < 0.4 else draw(rng.randint(0, 60), "abcdefgé ")
                       for _ in range(rng.randint(0, 6)))
        text = rng.choice(["a" * rng.randint(0, 200), "ab " * rng.randint(0, 70)]) if rng.random() < 0.08 else text
        rows.append((k if rng.random() > 0.03 else None, None if rng.random() < 0.02 else text))
    rows += rows[:5]
    got = suffix_dedup.byte_report(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    want = [(r[0], *x) for r, x in zip(rows, removed([t for _, t in rows], length))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_repeated_bytes_odd(odd, none):
    rows = odd.collect()
    got = suffix_dedup.byte_report(odd).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r.doc_id, *x)) for r, x in zip(rows, removed([r.text for r in rows], 400)))
    kept = suffix_dedup.without_repeats(odd)
    assert kept.columns == odd.columns
    sums = {(r.doc_id, r.kept_sha256) for r in got}
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect()} == sums
    assert suffix_dedup.byte_report(none).collect() == [] and suffix_dedup.without_repeats(none).collect() == []


def test_cut_characters_leave_valid_text(spark):
    """Strings that end inside a two-byte character: the rest of it becomes U+FFFD, the text stays valid."""
    shared = "shared words of forty bytes and then some é"
    docs = spark.createDataFrame([(1, "first " + shared), (2, "other " + shared[:-1] + "è ")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs, 40).collect()}
    assert got[1] == "first�" and got[2] == "other� "
