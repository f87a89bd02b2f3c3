"""Toxic spans by a linear-chain conditional random field; token marginals make document scores and offending offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import _BYTE, _powers, by_bytes, mix, text_buffers, released

TRAIN_DOCS = 600           # labelled documents of each class that the model is fitted on
ROUNDS = 20
TABLE = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TEMPLATES = 6


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, digits and non-ASCII bytes inside a text: starts, ends, and the first token of each text."""
    solid = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (~np.concatenate(([False], solid))[:-1] | edge[:-1]))
    ends = np.flatnonzero(solid & (~np.concatenate((solid, [False]))[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Six hashed features of each token: word, its first 4 and 6 bytes, its last 4, the words before and behind."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])

    def piece(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) + np.uint64(salt << 32))

    out = np.empty((_TEMPLATES, len(starts)), np.uint64)
    out[0] = piece(starts, ends, 1)
    out[1] = piece(starts, np.minimum(starts + 4, ends), 2)
    out[2] = piece(starts, np.minimum(starts + 6, ends), 3)
    out[3] = piece(np.maximum(ends - 4, starts), ends, 4)
    out[4, 1:], out[5, :-1] = mix(out[0, :-1] + np.uint64(5)), mix(out[0, 1:] + np.uint64(6))
    begin, close = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    out[4, begin] = out[5, close] = 0
    return out


def marginals(score: np.ndarray, first: np.ndarray, chain: np.ndarray, pairs: bool = False):
    """P(toxic) of each token by forward-backward over all texts at once; `chain`: start log-odds and 4 transition scores.

    The tokens are cut into about sqrt(n) lanes. Each lane multiplies its 2×2 step matrices, the lanes' products are
    chained, and a second sweep gives the messages inside. A text's first matrix forgets what came before. With `pairs`
    also the summed edge marginals and the texts' P(first is toxic).
    """
    n = len(score)
    if n == 0:
        return np.zeros(0), np.zeros(4), 0.0
    wide = int(np.ceil(np.sqrt(n)))
    lanes = -(-n // wide)
    w = np.exp(np.clip(score, -30, 30))
    t = np.exp(chain[1:].reshape(2, 2))
    begin = np.zeros(n, bool)
    begin[first[:-1][np.diff(first) > 0]] = True
    m = np.zeros((4, lanes * wide))           # m00, m01, m10, m11; the padding is the identity
    m[0] = m[3] = 1
    m[0, :n], m[1, :n] = np.where(begin, 1.0, t[0, 0]), np.where(begin, np.exp(chain[0]), t[0, 1]) * w
    m[2, :n], m[3, :n] = np.where(begin, 1.0, t[1, 0]), np.where(begin, np.exp(chain[0]), t[1, 1]) * w
    m = np.ascontiguousarray(m.reshape(4, lanes, wide).transpose(2, 0, 1))   # step, cell, lane

    p = np.array([np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)])
    for k in range(wide):
        a, b, c, d = m[k]
        p = np.array([p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d])
        p /= p.sum(axis=0)
    fore, back = np.empty((2, lanes)), np.empty((2, lanes))
    x, y = 0.5, 0.5
    for k in range(lanes):
        fore[:, k] = x, y
        x, y = x * p[0, k] + y * p[2, k], x * p[1, k] + y * p[3, k]
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for k in range(lanes - 1, -1, -1):
        back[:, k] = x, y
        x, y = p[0, k] * x + p[1, k] * y, p[2, k] * x + p[3, k] * y
        x, y = x / (x + y), y / (x + y)
    alpha, beta = np.empty((wide, 2, lanes)), np.empty((wide, 2, lanes))
    for k in range(wide):
        a, b, c, d = m[k]
        fore = np.array([fore[0] * a + fore[1] * c, fore[0] * b + fore[1] * d])
        fore /= fore.sum(axis=0)
        alpha[k] = fore
    for k in range(wide - 1, -1, -1):
        beta[k] = back
        a, b, c, d = m[k]
        back = np.array([a * back[0] + b * back[1], c * back[0] + d * back[1]])
        back /= back.sum(axis=0)
    alpha, beta = (z.transpose(1, 2, 0).reshape(2, -1)[:, :n] for z in (alpha, beta))
    both = alpha * beta
    one = both[1] / both.sum(axis=0)
    if not pairs:
        return one
    inner = np.flatnonzero(~begin)
    u, v = alpha[:, inner - 1], beta[:, inner]
    joint = np.array([u[0] * t[0, 0] * v[0], u[0] * t[0, 1] * w[inner] * v[1], u[1] * t[1, 0] * v[0], u[1] * t[1, 1] * w[inner] * v[1]])
    return one, (joint / joint.sum(axis=0)).sum(axis=1), float(one[begin].sum())


def feature_slots(feats: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 for the features that stand in at least two documents, 0 for all others; and their hashes."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    slots, names, used = np.zeros(feats.shape, np.int32), [], 0
    for row, out in zip(feats, slots):
        order = np.argsort(row, kind="stable")
        new = np.concatenate(([True], row[order][1:] != row[order][:-1]))
        head = np.flatnonzero(new)
        owner = doc[order]
        keep = (np.minimum.reduceat(owner, head) < np.maximum.reduceat(owner, head)) & (row[order][head] != 0)
        number = np.where(keep, used + np.cumsum(keep), 0).astype(np.int32)
        out[order] = np.repeat(number, np.diff(np.append(head, len(row))))
        names.append(row[order][head][keep])
        used += int(keep.sum())
    return slots, np.concatenate(names)


def token_labels(slots: np.ndarray, first: np.ndarray, toxic: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Labelled tokens from labelled documents: in a toxic document the tokens whose word or beginning stands in several
    toxic documents and far oftener there than elsewhere; if no document has one, each one's most telling token.

    Documents count as often as the word before (`context`) differs, so copies of one toxic text do not make all its
    words suspect; the gain in likelihood over an even spread must outweigh the number of features looked at."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    best = np.full(slots.shape[1], -np.inf)
    sure = np.zeros(slots.shape[1], bool)
    n1, n0 = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    for row in slots[:3]:
        seen = np.unique(row.astype(np.int64) * len(toxic) + doc)
        name, owner = seen // len(toxic), seen % len(toxic)
        in1 = np.bincount(name, toxic[owner], int(row.max()) + 1)
        in0 = np.bincount(name, 1 - toxic[owner], int(row.max()) + 1)
        own = toxic[doc] > 0
        pairs = np.unique(row[own].astype(np.int64) << 32 | context[own].astype(np.int64))
        in1 = np.minimum(in1, np.bincount(pairs >> 32, minlength=len(in1)))
        odds = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
        best = np.maximum(best, odds[row])
        both, share = np.maximum(in1 + in0, 1), n1 / (n1 + n0)
        gain = in1 * np.log(np.maximum(in1, 1) / (both * share)) + in0 * np.log(np.maximum(in0, 1) / (both * (1 - share)))
        sure |= ((odds > np.log(4)) & (gain > np.log(len(in1)) - 2))[row] & (row > 0)
    label = sure & (toxic[doc] > 0)
    if not label.any():
        for k in np.flatnonzero((toxic > 0) & (np.diff(first) > 0)):
            label[first[k] + int(best[first[k] : first[k + 1]].argmax())] = True
    return label


def fit_labelled(slots: np.ndarray, context: np.ndarray, first: np.ndarray, toxic: np.ndarray, names: np.ndarray) -> dict:
    """The chain from labelled documents; toxic ones in which no token could be labelled teach it nothing."""
    label = token_labels(slots, first, toxic, context)
    has = np.bincount(np.repeat(np.arange(len(toxic)), np.diff(first)), label, len(toxic)) > 0
    used = np.flatnonzero((toxic == 0) | has)
    own, cut = _subset(slots, first, used)
    return _table(fit_chain(own, cut, _subset(label[None], first, used)[0][0].astype(float), names))


def fit_chain(slots: np.ndarray, first: np.ndarray, label: np.ndarray, names: np.ndarray, piece: int = 1 << 18) -> dict:
    """Maximum conditional likelihood with an L2 penalty by full-batch Adam; the gradient is summed over pieces of whole
    documents, so memory follows the largest piece."""
    size = len(names) + 1
    theta = np.zeros(size + 6)                # slot 0 stands for every other feature; then bias, start, transitions
    theta[-6] = -3.0
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    cuts = [0]
    while cuts[-1] < len(first) - 1:
        cuts.append(max(int(np.searchsorted(first, first[cuts[-1]] + piece, "right")) - 1, cuts[-1] + 1))
    n = max(len(label), 1)
    for k in range(1, ROUNDS + 1):
        grad = np.zeros_like(theta)
        for a, b in zip(cuts[:-1], cuts[1:]):
            part, y, local = slots[:, first[a] : first[b]], label[first[a] : first[b]], first[a : b + 1] - first[a]
            if not len(y):
                continue
            score = np.full(len(y), theta[-6])
            for row in part:
                score += theta[row]
            one, joint, starts = marginals(score, local, theta[-5:], pairs=True)
            for row in part:
                grad[:size] += np.bincount(row, one - y, size)
            begin = local[:-1][np.diff(local) > 0]
            inner = np.ones(len(y), bool)
            inner[begin] = False
            inner = np.flatnonzero(inner)
            whole = y.astype(int)
            grad[-6] += (one - y).sum()
            grad[-5] += starts - y[begin].sum()
            grad[-4:] += joint - np.bincount(2 * whole[inner - 1] + whole[inner], minlength=4)[:4]
        grad[0] = 0
        grad += 0.05 * theta * (np.arange(len(theta)) < size)
        mean, var = 0.9 * mean + 0.1 * grad / n, 0.999 * var + 0.001 * (grad / n) ** 2
        theta -= 0.4 * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.999**k)) + 1e-9)
    return {"names": names, "theta": theta[1:size], "bias": theta[-6], "chain": theta[-5:].copy()}


def _table(model: dict) -> dict:
    """The weights in a fixed table by the low bits of the feature hash, with 16 high bits as a check; the larger weight stays."""
    order = np.argsort(np.abs(model["theta"]))
    names, theta = model["names"][order], model["theta"][order]
    weight, check = np.zeros(TABLE, np.float32), np.zeros(TABLE, np.uint16)
    at = (names & np.uint64(TABLE - 1)).astype(np.int64)
    weight[at], check[at] = theta, (names >> np.uint64(48)).astype(np.uint16)
    return {"weight": weight, "check": check, "bias": model["bias"], "chain": model["chain"]}


def _scored(feats: np.ndarray, table: dict) -> np.ndarray:
    out = np.full(feats.shape[1], table["bias"])
    for row in feats:
        at = (row & np.uint64(TABLE - 1)).astype(np.int64)
        out += np.where(table["check"][at] == (row >> np.uint64(48)).astype(np.uint16), table["weight"][at], 0)
    return out


def document_features(one: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-odds of the strongest token and the log of the expected number of toxic tokens; texts without tokens as if clean."""
    out = np.tile(np.array([[-12.0], [0.0]]), (1, len(first) - 1))
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        top = np.clip(np.maximum.reduceat(one, first[full]), 6e-6, 1 - 6e-6)
        out[0, full] = np.log(top / (1 - top))
        out[1, full] = np.log1p(np.add.reduceat(np.where(one > 0.01, one, 0), first[full]))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps for a small penalised logistic regression."""
    x = np.vstack([np.ones(x.shape[1]), x])
    b = np.zeros(len(x))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        penalty = np.diag([1e-6, 0.1, 0.1])
        b = b - np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)) @ x.T + penalty, x @ (weight * (p - y)) + penalty @ b)
    return b


def _subset(feats: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    take = np.concatenate([np.arange(first[k], first[k + 1]) for k in chosen] or [np.zeros(0, int)]).astype(np.int64)
    return feats[:, take], np.concatenate(([0], np.cumsum(np.diff(first)[chosen])))


def train(texts: list[str | None], toxic: list[int], weights: list[float]) -> dict:
    """Chain weights from all given documents; the document score is fitted on out-of-fold marginals (two folds).

    `weights` undo the sampling of the classes. With one class only, every document gets that class's share.
    """
    toxic_, weights_ = np.array(toxic, float), np.array(weights, float)
    if not len(toxic_) or toxic_.min() == toxic_.max():
        share = float(toxic_[0]) if len(toxic_) else 0.0
        return {"constant": min(max(share, 0.01), 0.99)}
    pieces = [tokenized(part) for part in _pieces(texts)]
    first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[4]) for p in pieces]))))
    feats = np.concatenate([features(p[0], *p[2:]) for p in pieces], axis=1)
    slots, names = feature_slots(feats, first)
    context = (feats[4] & np.uint64(0x7FFFFFFF)).astype(np.int32)
    del feats, pieces
    fold = np.arange(len(toxic_)) % 2
    x = np.empty((2, len(toxic_)))
    for side in (0, 1):
        fit, held = np.flatnonzero(fold != side), np.flatnonzero(fold == side)
        own, cut = _subset(slots, first, fit)
        part = fit_labelled(own, _subset(context[None], first, fit)[0][0], cut, toxic_[fit], names)
        x[:, held] = np.concatenate([_document(piece, part)[0] for piece in _pieces([texts[k] for k in held])], axis=1)
    model = fit_labelled(slots, context, first, toxic_, names)
    return model | {"document": _logistic(x, toxic_, weights_)}


def _pieces(texts: list) -> Iterator[pa.Array]:
    """A list of texts as arrays of about a megabyte."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    return (part.column(0) for part in by_bytes([batch], "text"))


def tokenized(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """raw, offsets, starts, ends, first of an array of texts."""
    raw, offsets = text_buffers(texts)
    return (raw, offsets, *tokens(raw, offsets))


def _document(texts: pa.Array, table: dict) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Document features, token marginals and tokens of an array of texts."""
    raw, offsets, starts, ends, first = tokenized(texts)
    one = marginals(_scored(features(raw, starts, ends, first), table), first, table["chain"]) if len(starts) else np.zeros(0)
    return document_features(one, first), one, (raw, offsets, starts, ends, first)


def judge(texts: pa.Array, model: dict) -> tuple[np.ndarray, list]:
    """Scores of whole texts and their toxic spans [start, end) in characters (tokens of marginal ≥ 0.5, neighbours joined)."""
    n = len(texts)
    if "constant" in model:
        return np.full(n, model["constant"]), [[] for _ in range(n)]
    x, one, (raw, offsets, starts, ends, first) = _document(texts, model)
    spans: list[list] = [[] for _ in range(n)]
    hits = np.flatnonzero(one >= 0.5)
    owner = np.searchsorted(first, hits, "right") - 1
    last = (-1, -2)
    for k, doc in zip(hits.tolist(), owner.tolist()):
        whole = raw[offsets[doc] : offsets[doc + 1]].tobytes()
        a, b = (len(whole[: z - offsets[doc]].decode("utf-8", "ignore")) for z in (starts[k], ends[k]))
        if last == (doc, k - 1):
            spans[doc][-1]["end"] = b
        else:
            spans[doc].append({"start": a, "end": b})
        last = (doc, k)
    b = model["document"]
    return 1 / (1 + np.exp(-np.clip(b[0] + b[1:] @ x, -30, 30))), spans


def training_rows(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[list, list, list]:
    """About `bound` labelled documents of each class, chosen by a hash of doc_id; rows held out are never among them.

    Of several labels of a document the larger counts; null labels and ids are left out.
    """
    rows = labels.where("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2")
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    cut = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, bound / n)))]) if sizes else F.create_map(F.lit(0), F.lit(0.0))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 < F.element_at(cut, F.col("toxic")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = slim.join(F.broadcast(chosen), "doc_id").collect()   # both sides are bounded by `bound`
    got.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    rates = {k: min(1.0, bound / n) for k, n in sizes.items()}
    return [r["text"] for r in got], [r["toxic"] for r in got], [1 / rates[r["toxic"]] for r in got]


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for each row of `docs` (doc_id, text); `labels` has (doc_id, toxic).

    The model is fitted on about `bound` labelled documents of each class and has a fixed size; scoring is a map over all
    whole texts, without a shuffle. Only texts enter a score. Null and empty texts score like texts without any toxic
    token; a null doc_id is not held out; repeated rows score alike; other columns are ignored; without labels every
    score is 0.01; an empty table gives an empty result.
    """
    model = train(*training_rows(docs, labels, bound))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            score, spans = judge(batch.column("text"), sent.value)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(released(run), "doc_id long, score double, spans array<struct<start:long,end:long>>")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
