"""Exact token ids of whole texts by the tokenizers library, with the work done once per distinct word and worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fleetpulse.llm.common import by_bytes, text_buffers

SLICE = 1 << 21             # bytes of text whose words are looked up together


def _byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTER, _SIGN, _LEAD = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x21, 0x7F)]] = _SIGN
_KIND[[*range(0x30, 0x3A), 0x27]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0xC3] = _LEAD         # À to ÿ, letters but for × and ÷


def _apart(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space between each letter and ASCII sign that are neighbours. No piece of the tokenizer's pattern reaches from
    one to the other, but for those that begin with an apostrophe, which counts as no sign here."""
    kind = _KIND[raw]
    lead = np.flatnonzero(kind == _LEAD)
    tail = np.minimum(lead + 1, len(raw) - 1)
    kind[lead] = kind[tail] = np.where((raw[tail] == 0x97) | (raw[tail] == 0xB7), 0, _LETTER)
    cut = np.flatnonzero(kind[1:] + kind[:-1] * np.uint8(4) == _LETTER + 4 * _SIGN) + 1
    cut = np.concatenate((cut, np.flatnonzero(kind[1:] + kind[:-1] * np.uint8(4) == _SIGN + 4 * _LETTER) + 1))
    cut.sort()
    return np.insert(raw, cut, 32), offsets + np.searchsorted(cut, offsets, "left")


class _Words:
    """Ids of words, `most` at the most: when the new half is full, the half before it is forgotten."""

    def __init__(self, most: int):
        self.half, self.old = max(most // 2, 1), {}
        self.new: dict[str, bytes] = {"": b""}

    def add(self, word: str, ids: bytes) -> bytes:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {"": b""}
        self.new[word] = ids
        return ids


class WordEncoder:
    """Ids of a text as little-endian unsigned integers.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its space-separated pieces
    one after another. A piece is encoded by the library once and remembered. Texts of Latin-1 characters are
    lower-cased first, as the tokenizer itself does; their pieces of letters go straight to its merge model; every other
    piece, and every text with a special string, takes the whole library path. At most `words` pieces are remembered.
    """

    def __init__(self, path: str, words: int = 600_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.type = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = {b: c for b, c in _byte_alphabet().items()}
        self.packed = [k.to_bytes(self.type.itemsize, "little") for k in range(self.whole.get_vocab_size())]
        self.folded, self.raw = _Words(words), _Words(words)

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join([self.packed[k] for k in ids])

    def _letters(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(shown)])

    def _known(self, word: str, known: _Words) -> bytes:
        out = known.new.get(word)
        if out is not None:
            return out
        out = known.old.get(word)
        if out is None:
            folded = known is self.folded
            if folded and word.isalpha():
                out = self._letters(word)
            elif folded and word[-1] in ".," and word[:-1].isalpha():
                out = self._known(word[:-1], known) + self._known(word[-1], known)
            else:
                out = self._pack(self.whole.encode(word, add_special_tokens=False).ids)
        return known.add(word, out)

    def _found(self, words: list[str], known: _Words) -> list[bytes]:
        found = list(map(known.new.get, words))
        if None in found:
            for k, w in enumerate(words):
                if found[k] is None:
                    found[k] = self._known(w, known)
        return found

    def __call__(self, text: str) -> bytes:
        known = self.raw
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text, known = text.lower(), self.folded
            except UnicodeEncodeError:
                pass
        return b"".join(self._found(text.replace("\n", " ").split(" "), known))

    def many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a column (null: empty). Texts that can be folded are split by Arrow, and each distinct
        word of them is looked up once; the others go one by one."""
        raw, offsets = text_buffers(texts)
        odd = np.flatnonzero(raw >= 0xC4)                   # no lead byte of Latin-1
        odd = np.append(odd, np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)))
        odd = np.unique(np.searchsorted(offsets, odd, "right") - 1)
        out: list[bytes] = [b""] * len(texts)
        for k in odd.tolist():
            out[k] = self(texts[k].as_py() or "")
        rest = np.setdiff1d(np.arange(len(texts)), odd)
        if len(rest):
            raw, offsets = text_buffers(texts.take(pa.array(rest)) if len(odd) else texts)
            raw, offsets = _apart(np.where(raw == 10, np.uint8(32), raw), offsets)
            plain = pa.Array.from_buffers(pa.large_string(), len(rest), [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(raw)])
            parts = pc.split_pattern(pc.utf8_lower(plain), " ")
            words = parts.flatten().dictionary_encode()
            codes = pa.array(self._found(words.dictionary.to_numpy(zero_copy_only=False).tolist(), self.folded), pa.large_binary()).take(words.indices)
            raw, ends = text_buffers(codes)
            ends = ends[np.asarray(parts.offsets)]
            body = raw.tobytes()
            for k, a, b in zip(rest.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                out[k] = body[a:b]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple]:
    """(doc_id, ids) of each row: the ids of the whole text and then `end`; null texts are empty."""
    encode = encoder(path)
    tail = np.array([end], encode.type).tobytes()
    for batch in by_bytes(batches, "text", SLICE):
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.many(batch.column("text"))):
            yield doc_id, ids + tail
