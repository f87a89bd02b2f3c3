"""op3, op8 and op9: ids and counts equal the libraries', files and packings are whole."""
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetpulse.llm import packing, token_counts, wavelet
from fleetpulse.llm.tokens import WordEncoder
from odd_tables import none, odd  # noqa: F401

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "é", "the", " the", ".", "'s", "1", "23", "<s>", "</s>", "▁", "\u00a0", "e\u0301", "ﬁ", "😀", "\r", "\x1c", "\x00", "A", "Σ",
       "İ", "\u2003", "<|endoftext|>", "<|ENDOFTEXT|>", "'", "ll", "\u212b", "x", "中", "ß", "µ", "ſ", "_", "٣", "²", "½", ","]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_and_pieces_equal_the_libraries():
    whole, encode = Tokenizer.from_file(WORDS), WordEncoder(WORDS, words=300)
    assert all(np.frombuffer(encode(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts(4000, 1))
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    count = token_counts.PieceCounter(PIECES, token_counts.whole_tokens(PIECES), words=20_000)
    assert all(count(t) == len(model.encode(t)) for t in texts(4000, 2))


def test_columns_of_texts_equal_the_library():
    """Whole columns, with words of letters, signs, digits and contractions side by side, nulls and texts that cannot be folded."""
    rng = random.Random(3)
    parts = [*ODD, "###", "&&&", "the", "Été", "ÀÖ", "×", "÷", "ç", "'re", "'s", "!'", "...", "don't", "x'll.y", "'S", "<", "|", "-", "\xad", "ª", "º", "¼", "\x85"]
    column = [None, "", " ", "\n", "<", "|endoftext|>", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)), "é", "a"]
    whole, encode = Tokenizer.from_file(WORDS), WordEncoder(WORDS, words=300)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in column]
    for step in (1, 7, 5000):
        got = [x for a in range(0, len(column), step) for x in encode.many(pa.array(column[a : a + step], pa.string()))]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
    assert encode.many(pa.array([], pa.string())) == []


def test_signs_do_not_take_the_whole_library():
    """2,000 different words, each with signs behind it: words go to the merge model and the signs are looked up once."""
    encode, calls = WordEncoder(WORDS), []
    whole = encode.whole

    class Counted:
        def encode(self, text, **options):
            calls.append(text)
            return whole.encode(text, **options)

    encode.whole = Counted()
    text = " ".join(f"{a}{b}{c}###" for a in "abcdefghijklm" for b in "abcdefghijkl" for c in "abcdefghijklm")
    assert np.frombuffer(encode.many(pa.array([text]))[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(calls) <= 2


def test_token_counts(odd, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    key = lambda r: repr(r)
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 4096) for r in odd.collect()]
    assert sorted((tuple(r) for r in token_counts.token_counts(odd, PIECES).collect()), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(none, PIECES).collect() == []


def test_token_files(spark, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 500)
    whole = Tokenizer.from_file(WORDS)
    ids = sorted(((r.doc_id is not None, r.doc_id or 0), np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [2], "<u2").tobytes()) for r in odd.collect())
    start, want = 0, []
    for (known, doc_id), code in ids:
        codes = np.frombuffer(code, "<u2").tolist()
        want.append((doc_id if known else None, start, len(codes), crc(codes)))
        start += len(codes)
    got = [tuple(r) for r in wavelet.token_files(odd, WORDS, 2).collect()]
    assert sorted(got, key=lambda r: (r[1], r[2])) == sorted(want, key=lambda r: (r[1], r[2]))
    assert wavelet.token_files(none, WORDS).collect() == []
    folder = str(tmp_path / "w")
    wavelet.write_shards(odd, WORDS, folder)
    row = spark.read.parquet(folder).orderBy("shard").first()
    one = wavelet.WaveletShard(row.data)
    tokens = one.decode().tolist()
    assert [one.access(k) for k in range(min(one.n, 60))] == tokens[:60]
    for token in {*tokens[:5], 2, 49_000}:
        assert one.occurrences(token) == [k for k, t in enumerate(tokens) if t == token]
        assert one.count(token, 30) == tokens[:30].count(token)
    assert sum(r.n for r in wavelet.lookup(spark, folder, [2]).collect()) == odd.count()


@pytest.mark.parametrize("n,levels", [(0, 3), (1, 1), (70_000, 4)])
def test_shard_round_trip(n, levels):
    tokens = np.random.default_rng(n).integers(0, 1 << levels, n).astype(np.uint16)
    one = wavelet.WaveletShard(wavelet.build_shard(tokens, [None, 5], np.array([0, n]), levels))
    assert one.decode().tolist() == tokens.tolist() and one.doc_ids == [None, 5]
    if n > 60_000:
        assert one.occurrences(3) == np.flatnonzero(tokens == 3).tolist() and one.count(3, 66_000) == int((tokens[:66_000] == 3).sum())


def unpacked(histogram, capacity):
    rows, bins = packing.plan(histogram, capacity), {}
    for length, n in histogram.items():
        own = rows[rows[:, 0] == length]
        for k in range(n):
            r = own[own[:, 1] <= k][-1]
            bins.setdefault(int(r[3] + (k - r[1]) // r[2]), []).append((int(r[4] + (k - r[1]) % r[2] * length), length))
    return bins


def test_plans_are_gapless_and_no_worse_than_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(200):
        capacity = int(rng.integers(4, 60))
        sizes = rng.integers(1, capacity + 1, rng.integers(0, 45))
        bins = unpacked({int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True))}, capacity)
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        left = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [r for r in left if r >= s]
            if fits:
                left.remove(min(fits))
            left.append((min(fits) if fits else capacity) - s)
        assert sum(map(len, bins.values())) == len(sizes) and len(bins) <= len(left)


def test_dominance_keeps_the_optimum():
    """The reduction never costs a sequence: exhaustive packing of small instances."""
    def fewest(sizes, capacity):
        best = [len(sizes)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[k] <= capacity:
                    bins[b] += sizes[k]
                    go(k + 1, bins)
                    bins[b] -= sizes[k]
            go(k + 1, [*bins, sizes[k]])
        go(0, [])
        return best[0]
    rng = np.random.default_rng(3)
    for _ in range(150):
        capacity = int(rng.integers(6, 30))
        sizes = sorted(rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist(), reverse=True)
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = packing.reduce_dominated(counts, capacity)
        rest = [s for s in range(capacity, 0, -1) for _ in range(counts[s])]
        assert sum(n for n, _ in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)


def test_pack(odd, none):
    whole = Tokenizer.from_file(WORDS)
    rows = packing.pack(odd, WORDS, 512, 1).collect()
    codes = [(r.doc_id, whole.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in odd.collect()]
    want = sorted(repr((d, k, s, len(c[s : s + 512]), crc(c[s : s + 512]))) for d, c in codes for k, s in enumerate(range(0, len(c), 512)))
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == want
    for number in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == number), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert packing.pack(none, WORDS).collect() == []
