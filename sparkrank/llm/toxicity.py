"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are of documents, so tokens are labelled first: in toxic training documents, the words
with a feature (the word, its beginnings, its ending) that toxic documents hold far more often
than clean ones. A two-state chain is then trained on the tokens of the sample; in scoring,
forward-backward marginals give each word's probability, runs of probable words are the
offending spans, and their sum and maximum give the document's score through a logistic curve
fitted on the same sample.

Whole texts are scored, in blocks; the chain runs over a block's words at once, a document's
first word cutting it off from the one before. Nothing but the text enters a score.

A null or empty text has no words and gets the least score. Repeated rows get equal scores. A
label that is null is none; of repeated labels of one doc_id the larger holds. Without training
documents of both kinds the score is 0 everywhere.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.llm.near_dedup import SHINGLE, THRESHOLD, aligned, labelled, order_min_hashes, shingles
from sparkrank.llm.shared import only
from sparkrank.llm.tokens import BASES, Block, blocks, byte_sums, mix, span_hash

#: The bound of the training sample: so many labelled documents of each kind, those with the least hashes of their ids
#: after copies and near copies have gone, found among CANDIDATES times as many and among SAMPLE_BYTES of text of each
#: kind; a text over MOST_BYTES is scored like any other but not learned from.
TRAIN_DOCS, CANDIDATES, SAMPLE_BYTES, MOST_BYTES = 1500, 2, 12_000_000, 1_000_000
#: Digits of a score. A score's last bits depend on the documents that it is computed along with.
DIGITS = 9
#: Slots of the hashed feature weights, and the lengths in bytes of the beginnings and endings of a word that are features.
SLOTS, HEADS, TAILS = 1 << 18, (4, 5, 6, 7, 8, 9, 10), (4,)
#: A feature labels tokens from so many standard deviations and so much difference of logarithms on, in so many toxic documents.
LEAST_Z, LEAST_ODDS, LEAST_DOCS = 5.0, 3.0, 4
#: Training of the chain.
ROUNDS, RATE, DECAY = 40, 0.5, 2.0
#: One in so many documents of the sample is kept from the chain, for the document curve.
CURVE_EVERY = 3
#: Words of a chain that are multiplied one after the other; the rest is done side by side.
COLUMNS = 256
#: A word is part of a span from this probability on.
SPAN_PROBABILITY = 0.5


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would be longer, so that offsets are those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def features(block: Block) -> np.ndarray:
    """Slots of each word's features: the word, its beginnings, its endings (the whole word if it is shorter)."""
    sums = byte_sums(block.buf)
    out = [span_hash(sums, block.start, block.end, BASES[0])]
    out += [span_hash(sums, block.start, np.minimum(block.start + n, block.end), BASES[0]) for n in HEADS]
    out += [span_hash(sums, np.maximum(block.end - n, block.start), block.end, BASES[0]) for n in TAILS]
    salt = mix(np.arange(1, len(out) + 1, dtype=np.uint64))
    return np.array([(mix(h ^ s) >> np.uint64(46)).astype(np.int32) for h, s in zip(out, salt, strict=True)])


def _scan(odds: np.ndarray, first: np.ndarray, chain: np.ndarray, start: float, backward: bool) -> np.ndarray:
    """Ratios of the two states' messages at each word, from the left or from the right.

    odds: of state 1 by the word alone. chain: 2 x 2 potentials of neighbouring states. The words are laid out in
    rows of COLUMNS; products along the rows are taken for all rows at once, then rows are chained.
    """
    n = len(odds)
    rows = -(-n // COLUMNS)

    def laid(x: np.ndarray, fill: float) -> np.ndarray:
        return np.concatenate((x, np.full(rows * COLUMNS - n, fill))).reshape(rows, COLUMNS).T

    o = laid(odds, 1.0)
    # what leads from the word before to this one
    t00, t10 = laid(np.where(first, 1.0, chain[0, 0]), 1.0), laid(np.where(first, 1.0, chain[1, 0]), 1.0)
    t01, t11 = laid(np.where(first, start, chain[0, 1]), 1.0) * o, laid(np.where(first, start, chain[1, 1]), 1.0) * o
    steps = range(COLUMNS - 1, -1, -1) if backward else range(COLUMNS)
    p00, p01, p10, p11 = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k, c in enumerate(steps):
        a, b, d, e = t00[c], t01[c], t10[c], t11[c]
        if backward:
            p00, p01, p10, p11 = a * p00 + b * p10, a * p01 + b * p11, d * p00 + e * p10, d * p01 + e * p11
        else:
            p00, p01, p10, p11 = p00 * a + p01 * d, p00 * b + p01 * e, p10 * a + p11 * d, p10 * b + p11 * e
        if k % 8 == 7:
            scale = 1 / (p00 + p01 + p10 + p11)
            p00, p01, p10, p11 = p00 * scale, p01 * scale, p10 * scale, p11 * scale
    into = np.empty(rows)  # the ratio that enters each row
    ratio = 1.0
    products = list(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True))
    for r in range(rows - 1, -1, -1) if backward else range(rows):
        into[r] = ratio
        a, b, d, e = products[r]
        ratio = (d + e * ratio) / (a + b * ratio) if backward else (b + e * ratio) / (a + d * ratio)
    out = np.empty((COLUMNS, rows))
    ratio = into
    for c in steps:
        if backward:
            out[c] = ratio  # from the words after this one
            ratio = (t10[c] + t11[c] * ratio) / (t00[c] + t01[c] * ratio)
        else:
            ratio = (t01[c] + t11[c] * ratio) / (t00[c] + t10[c] * ratio)
            out[c] = ratio
    return out.T.reshape(-1)[:n]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    chain: np.ndarray  # logarithms of the potentials of neighbours
    start: float  # logarithm of the odds of state 1 at a first word
    curve: np.ndarray  # of the document score

    def messages(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = np.exp(np.clip(self.weights[slots].sum(axis=0, dtype=np.float64) + self.bias, -30, 30))
        chain, start = np.exp(self.chain), float(np.exp(self.start))
        return odds, _scan(odds, first, chain, start, False), _scan(odds, first, chain, start, True)

    def marginals(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of each word to be toxic."""
        if not slots.shape[1]:
            return np.zeros(0)
        _, left, right = self.messages(slots, first)
        both = left * right
        return both / (1 + both)

    def score(self, total: np.ndarray, most: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(_summary(total, most, n_words) @ self.curve, -30, 30))), DIGITS)


def _summary(total: np.ndarray, most: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What the document curve sees: expected toxic words, their share, and the most probable one."""
    return np.stack([np.ones(len(total)), np.log(total + 1e-2), np.log((total + 1e-2) / (n_words + 20)), most], axis=1)


def _firsts(block: Block) -> np.ndarray:
    first = np.zeros(len(block.start), dtype=bool)
    first[block.first[block.n_words > 0]] = True
    return first


def _per_document(block: Block, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total, most = np.bincount(block.doc, weights=p, minlength=len(block.texts)).astype(np.float64), np.zeros(len(block.texts))
    some = block.n_words > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, block.first[some])
    return total, most


def label_tokens(parts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> list[np.ndarray]:
    """Of each part of the sample - its words' slots and documents, which no other part holds: True for the words of toxic documents with a feature typical of such documents."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    typical = np.zeros(SLOTS, dtype=bool)
    for row in range(len(parts[0][0]) if n1 and n0 and parts else 0):
        with_1, with_0 = np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64)
        for slots, doc in parts:
            pairs = np.unique(slots[row].astype(np.int64) * len(toxic) + doc)
            slot, is_toxic = pairs // len(toxic), toxic[pairs % len(toxic)]
            with_1 += np.bincount(slot[is_toxic], minlength=SLOTS)
            with_0 += np.bincount(slot[~is_toxic], minlength=SLOTS)
        share = (with_1 + with_0) / (n1 + n0)
        z = (with_1 / n1 - with_0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        odds = np.log((with_1 + 0.5) / (n1 + 1)) - np.log((with_0 + 0.5) / (n0 + 1))
        typical |= (z >= LEAST_Z) & (odds >= LEAST_ODDS) & (with_1 >= LEAST_DOCS)
    return [typical[slots].any(axis=0) & toxic[doc] for slots, doc in parts]


def unlike(texts: list[str]) -> list[int]:
    """One of each group of copies and near copies: their words would count as often as they are copied. Near copies are those of near_dedup."""
    out: list[int] = []
    seen: dict[int, list[int]] = {}  # texts kept, by sketch
    held: dict[int, np.ndarray] = {}
    for ids, block in _sample_blocks(texts):
        hashes, doc, bounds = shingles(block, SHINGLE)
        for k, (i, own) in enumerate(zip(ids, order_min_hashes(labelled(hashes, doc), bounds, 6, 1).tolist(), strict=True)):
            if any(own):
                sequence = hashes[bounds[k] : bounds[k + 1]]
                near = [held[j] for j in {j for s in own for j in seen.get(s, ())}]
                near = [x for x in near if min(len(x), len(sequence)) >= THRESHOLD * max(len(x), len(sequence))]
                if any(aligned(sequence.tolist(), x.tolist(), THRESHOLD) for x in near):
                    continue
                held[i] = sequence.copy()
                for s in own:
                    seen.setdefault(s, []).append(i)
            out.append(i)
    return out


def _sample_blocks(texts: list[str]) -> Iterator[tuple[list[int], Block]]:
    """The sample in blocks, as in scoring, so that hashes are held of one block at a time."""
    for ids, part in blocks(list(range(len(texts))), [lowered(t).encode() for t in texts]):
        block = Block(part, separators=None)
        block.split()
        yield ids, block


def train(texts: list[str], toxic: list[bool], most: int = TRAIN_DOCS) -> Model:
    """Fit the chain on a part of a sample of labelled documents, the first `most` of each kind that are unlike, and the document curve on the rest."""
    apart = unlike(texts)
    apart = sorted(i for kind in (True, False) for i in [i for i in apart if bool(toxic[i]) == kind][:most])
    texts, toxic = [texts[i] for i in apart], [toxic[i] for i in apart]
    for_curve = [i % CURVE_EVERY == 0 for i in range(len(texts))]
    for kind in (True, False):
        own = [c for c, t in zip(for_curve, toxic, strict=True) if t == kind]
        if all(own) or not any(own):  # too few to part
            for_curve = [True] * len(texts)
            break
    alone = any(c != for_curve[0] for c in for_curve)
    chain_part = [i for i, c in enumerate(for_curve) if not (alone and c)]
    model = _train_chain([texts[i] for i in chain_part], np.array([toxic[i] for i in chain_part], dtype=bool))
    curve_part = [i for i, c in enumerate(for_curve) if c]
    target = np.array([toxic[i] for i in curve_part], dtype=np.float64)
    x = np.concatenate([_summary(*_per_document(block, model.marginals(features(block), _firsts(block))), block.n_words) for _, block in _sample_blocks([texts[i] for i in curve_part])])
    for _ in range(25):  # ridge-penalised logistic regression by Newton's method
        s = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
        gradient = x.T @ (target - s) - 0.1 * model.curve
        model.curve += np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + 0.1 * np.eye(x.shape[1]), gradient)
    return model


def _train_chain(texts: list[str], truth: np.ndarray) -> Model:
    """Gradients are summed block by block, so that only the slots are held for all words at once."""
    parts = [(features(block), _firsts(block), block.doc + ids[0]) for ids, block in _sample_blocks(texts) if len(block.start)]
    labels = label_tokens([(slots, doc) for slots, _, doc in parts], truth)
    parts = [(slots, first, ~first[1:], y) for (slots, first, _), y in zip(parts, labels, strict=True)]
    model = Model(np.zeros(SLOTS, dtype=np.float32), -4.0, np.zeros((2, 2)), 0.0, np.zeros(4))
    observed, pairs, n_true = np.zeros(SLOTS), np.zeros((2, 2)), sum(int(y.sum()) for y in labels)
    for slots, _, inner, y in parts:
        observed += sum(np.bincount(own[y], minlength=SLOTS) for own in slots)
        pairs += [[np.count_nonzero(inner & (y[:-1] == a) & (y[1:] == b)) for b in (False, True)] for a in (False, True)]
    grown, grown_bias, grown_chain = np.zeros(SLOTS), 0.0, np.zeros((2, 2))
    for _ in range(ROUNDS if n_true else 0):
        g, g_bias, g_chain = observed - DECAY * model.weights, float(n_true), pairs.copy()
        chain = np.exp(model.chain)
        for slots, first, inner, _ in parts:
            odds, left, right = model.messages(slots, first)
            p = left * right / (1 + left * right)
            for own in slots:
                g -= np.bincount(own, weights=p, minlength=SLOTS)
            g_bias -= p.sum()
            # expected pairs of neighbouring states
            after = (odds * right)[1:]
            joint = [chain[0, 0], chain[0, 1] * after, chain[1, 0] * left[:-1], chain[1, 1] * left[:-1] * after]
            share = inner / (joint[0] + joint[1] + joint[2] + joint[3])
            g_chain -= np.array([(x * share).sum() for x in joint]).reshape(2, 2)
        grown += g * g
        model.weights += (RATE * g / np.sqrt(grown + 1e-6)).astype(np.float32)
        grown_bias += g_bias**2
        model.bias += RATE * g_bias / np.sqrt(grown_bias + 1e-6)
        grown_chain += g_chain**2
        model.chain += RATE * g_chain / np.sqrt(grown_chain + 1e-6)
        model.chain = np.clip(model.chain - model.chain[0, 0], -8, 8)
    return model


def in_training_fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """A model from at most `sample` labelled documents of each kind outside the held-out fold; None without both kinds."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(in_training_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = only(docs, doc_id=doc_id, text=text)
    known = known.select("doc_id", (F.col("toxic") > 0).alias("toxic"), F.xxhash64("doc_id").alias("place"))
    picked = [r for kind in ("toxic", "not toxic") for r in known.where(kind).orderBy("place", "doc_id").limit(CANDIDATES * sample).collect()]
    if not picked:
        return None
    chosen = F.broadcast(spark.createDataFrame([(r["doc_id"], r["toxic"], r["place"]) for r in picked], "doc_id long, toxic boolean, place long"))
    rows = own.where(F.octet_length("text") <= MOST_BYTES).join(chosen, "doc_id").groupBy("place", "doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("place", "doc_id"))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).drop("upto")
    # the sample, bounded as it is, meets in one task; the driver gets the parameters alone
    fitted = rows.coalesce(1).mapInArrow(_train_task(sample), "model binary").collect()
    return Model(*pickle.loads(fitted[0]["model"])) if fitted else None


def _train_task(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        toxic = [row[2] for row in rows]
        if any(toxic) and not all(toxic):
            m = train([text for *_, text in rows], toxic, most)
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps((m.weights, m.bias, m.chain, m.start, m.curve))]})

    return run


_OUT = "doc_id long, score double, n_toxic double, spans array<struct<start: int, end: int, probability: double>>"


def _score(model: Model):
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = Block([lowered(t).encode() for t in texts], separators=None)
                block.split()
                p = model.marginals(features(block), _firsts(block))
                total, most = _per_document(block, p)
                spans: list[list[dict]] = [[] for _ in texts]
                hot = np.flatnonzero(p >= SPAN_PROBABILITY)
                fresh = np.flatnonzero(np.concatenate(([True], (np.diff(hot) > 1) | (np.diff(block.doc[hot]) > 0)))) if len(hot) else hot
                for i, j in zip(fresh.tolist(), np.append(fresh[1:], len(hot)).tolist() if len(hot) else [], strict=True):
                    a, b = int(hot[i]), int(hot[j - 1])
                    d = int(block.doc[a])
                    base = int(block.begins[d])
                    lead, own = bytes(block.buf[base : block.start[a]]).decode(), bytes(block.buf[block.start[a] : block.end[b]]).decode()
                    spans[d].append({"start": len(lead), "end": len(lead) + len(own), "probability": float(p[a : b + 1].max())})
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.score(total, most, block.n_words), pa.float64()), pa.array(total, pa.float64()), pa.array(spans, pa.list_(span))], names=["doc_id", "score", "n_toxic", "spans"])

    return run


def score_documents(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, n_toxic (expected toxic words), spans (start, end, probability).

    start and end count characters of the text.
    """
    own = only(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if model is None:
        return own.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("n_toxic"), F.array().cast("array<struct<start: int, end: int, probability: double>>").alias("spans"))
    return own.mapInArrow(_score(model), _OUT)
