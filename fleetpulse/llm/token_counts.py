"""Token counts by sentencepiece: vocabulary strings proven to be one token are counted directly, only the rest is merged."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_UNITS = re.compile(r" +[^ \n]*|\n[^ \n]*")
LINE = "\n"


def splittable(processor) -> bool:
    """Units may be counted apart: no piece holds a space mark after another character, none a line break, and the
    text is neither normalised nor stripped (probed, since the model's settings are not part of the library's API)."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    probes = {" a": 2, "a ": 2, "a\tb": 3, "ﬁ": processor.encode("aﬁ", out_type=str).count("ﬁ") + 1}
    return (not any(SPACE in p.lstrip(SPACE) or LINE in p for p in pieces)
            and all(len(processor.encode(k)) == v for k, v in probes.items())
            and processor.encode(" a", out_type=str) != processor.encode("a", out_type=str))


def whole_tokens(path: str) -> list[str]:
    """Offline proof: the words w whose vocabulary string (space mark + w) the library encodes as that single token."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    if not splittable(processor):
        raise ValueError(f"{path}: its merges cross spaces or lines; count whole texts instead")
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    words = [p[1:] for p in pieces if p.startswith(SPACE) and len(p) > 1 and not p.startswith(SPACE * 2)]
    return [w for w, ids in zip(words, processor.encode(words)) if len(ids) == 1]


class PieceCounter:
    """Tokens of whole texts. A unit is a run of spaces and what follows up to a space or line break, or a line break
    and what follows it; merges never cross units. Counts of at most `words` other units are remembered."""

    def __init__(self, path: str, proven: list[str], words: int = 400_000):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.proven = dict.fromkeys(proven, 1)
        self.words = words
        self.known = dict(self.proven)

    def _merge(self, word: str) -> int:
        """`word` follows one space, or begins with a line break and follows none."""
        if len(self.known) >= self.words:
            self.known = dict(self.proven)
        n = len(self.processor.encode(word)) - (word[:1] == LINE)
        self.known[word] = n
        return n

    def _spaced(self, unit: str) -> int:
        """A unit with its spaces; the library puts one space before what it encodes."""
        return len(self.processor.encode(unit[1:])) if len(unit) > 1 else 1

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")  # the model writes spaces as this mark
        words = text.replace(LINE, " " + LINE).split(" ")
        if "" in words or words[0][:1] == LINE:
            total = 0
            for unit in _UNITS.findall(" " + text):
                word = unit[1:] if unit[0] == " " and unit[1:2] not in (" ", "") else unit if unit[0] == LINE else None
                n = self.known.get(word) if word is not None else self._spaced(unit)
                total += self._merge(word) if n is None else n
            return total
        found = list(map(self.known.get, words))
        if None in found:
            for k, word in enumerate(words):
                if found[k] is None:
                    found[k] = self.known.get(word) or self._merge(word)
        return sum(found)


_COUNTERS: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs` (doc_id, text), by the sentencepiece model at `path`.

    A map over the rows without a shuffle. Null and empty texts have 0 tokens; null ids and repeated rows are kept as they
    are; other columns are ignored; an empty table gives an empty result. The list of proven words is at most the
    vocabulary and travels with the task.
    """
    proven = whole_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = PieceCounter(path, proven)
        count = _COUNTERS[path]
        for batch in batches:
            texts = batch.column("text")
            n = [count(texts[k].as_py() or "") for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
