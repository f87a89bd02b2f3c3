"""Collocations: the filters are lossless, both vocabulary paths agree, and odd rows give defined results."""
import numpy as np
import pytest

from fleetpulse.llm import collocations as co
from odd_tables import none, odd  # noqa: F401


def test_feistel_round_trip():
    rng = np.random.default_rng(3)
    for h in (4, 20, 33, 64):
        mask = (1 << h) - 1 if h < 64 else 2**64 - 1
        left = rng.integers(0, 2**63, 5000, dtype=np.uint64) & np.uint64(mask)
        right = rng.integers(0, 2**63, 5000, dtype=np.uint64) & np.uint64(mask)
        perm = co.Feistel(h)
        a, b = perm.forward(left, right)
        assert (a <= mask).all() and (b <= mask).all()
        back = perm.backward(a, b)
        assert (back[0] == left).all() and (back[1] == right).all()


def brute(rows, top=2000, min_count=10, share=50):
    import re
    from collections import Counter
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i:i + k])] += 1
    out = []
    for lang, fl in f.items():
        cand = {p: a for p, a in fl.items() if len(p) >= 2 and a >= min_count}
        rows_l = []
        for p, a in cand.items():
            if len(p) == 2 and any(len(q) == 3 and (q[:2] == p or q[1:] == p) and 100 * b >= share * a for q, b in cand.items()):
                continue
            cuts = [((1000000 * a * a) // (fl[p[:k]] * fl[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            rows_l.append((lang, " ".join(p), a, fl[p[:k]], fl[p[k:]], n[lang], s))
        rows_l.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(rows_l[:top])]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_tiny_documents_both_paths(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.text, r.lang) for r in docs.select("text", "lang").collect()], top=50)
    broadcast = co.collocations(docs, top=50)
    assert broadcast.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collected(broadcast) == want
    monkeypatch.setattr(co, "BROADCAST_BYTES", -1)
    assert collected(co.collocations(docs, top=50)) == want


def test_odd_rows(spark):
    base = ["Alpha beta gamma. ALPHA BETA gamma; alpha\tbeta", "x y z x y z x y z", None, "", "été à été à"]
    rows = [(i, base[i % len(base)], ["en", None, "fr"][i % 3]) for i in range(90)] + [(1000, "alpha beta " * 5000, "en")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, lang string, phrase string, rank int")
    assert collected(co.collocations(df, top=20)) == brute([(t, l) for _, t, l in rows], top=20)


def test_empty(none):
    assert co.collocations(none).count() == 0


def test_words_and_pieces_of_slices():
    import pyarrow as pa
    words, first, opens = co._split(pa.array(["A b,C", None, " ,. ", "d\te\x0bF.", "g"]))
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f", "g"]
    assert first.tolist() == [0, 3, 3, 3, 6, 7]
    assert opens.tolist() == [True, False, True, True, False, True, True]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "fr", "fr", "en"]), pa.array(["b a b", "b", None, "b.B", ""])], names=["lang", "text"])
    assert [tuple(r.values()) for b in co._counted(iter([batch])) for r in sorted(b.to_pylist(), key=str)] == [("en", "a", 1), ("en", "b", 3), ("fr", "b", 2)]
    (ids,) = co._to_ids(pa.array(["a", "b"]))(iter([batch]))
    assert ids.column("ids").to_pylist() == [[0, 2, 1, 2], [0, 2], [], [0, 2, 0, 2], []]
    assert ids.column("ids").type == pa.list_(pa.int32())
