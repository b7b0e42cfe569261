"""Toxicity by multiple-instance learning.

Only documents carry labels; sentences are the instances. A sentence's probability is logistic in its distinct words, a document's is
the noisy-or of its sentences: 1 - prod(1 - p). The weights are fitted by proximal Adam on the documents' likelihood, and the
sentences with a high probability are then where a document offends.

The classifier is fitted on at most ``max_train`` labelled documents, the first in the order of a hash of their id; that bound is what
the driver holds. Scoring is row-wise over all documents, with no exchange.

Defined results: null or empty text scores 0; a null label is no label; a document labelled twice is toxic if either label is;
rows with a null id are scored and never learned from; without any usable label every score is 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

SENTENCE = re.compile(r"[.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word's features: itself, and its prefixes of three to seven letters."""
    return [word] + [word[:n] + "*" for n in range(3, min(7, len(word)) + 1)]


class _Weights(dict):
    """Summed weights of a word's features, kept for a bounded number of words."""

    limit = 300_000

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        x = sum(get(f, 0.0) for f in features(word))
        if len(self) >= self.limit:
            self.clear()
        self[word] = x
        return x


@dataclass
class MilModel:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)


def sentences(text: str) -> list[list[str]]:
    """Distinct words of each sentence, lower-cased, in order of first use; sentences without words are left out."""
    return [list(dict.fromkeys(w)) for s in SENTENCE.split(text.lower()) if (w := TOKEN.findall(s))]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(texts: list[str], labels: list[int], min_docs: int = 4, rounds: int = 150, rate: float = 0.1, l1: float = 3e-4) -> MilModel:
    """Noisy-or weights from document labels."""
    if not texts or len(set(labels)) < 2:
        return MilModel()
    ids: dict[str, int] = {}
    df: Counter = Counter()
    words, lengths, doc_of = [], [], []
    for d, t in enumerate(texts):
        seen: set[str] = set()
        for s in sentences(t):
            words.append(np.array([ids.setdefault(w, len(ids)) for w in s], np.int32))
            lengths.append(len(s))
            doc_of.append(d)
            seen.update(s)
        df.update({f for w in seen for f in features(w)})
    vocab = {f: i for i, f in enumerate(sorted(f for f, c in df.items() if c >= min_docs))}
    del df
    # word -> features, as pairs
    pairs = np.array([(i, vocab[f]) for w, i in ids.items() for f in features(w) if f in vocab], np.int32).reshape(-1, 2)
    of_word, of_feature = pairs[:, 0], pairs[:, 1]
    idx = np.concatenate(words) if words else np.empty(0, np.int32)
    sent = np.repeat(np.arange(len(lengths)), lengths)
    doc_of = np.array(doc_of, np.int64)
    y = np.array(labels, np.float64)
    n, m, v = len(texts), len(vocab), len(ids)
    w, bias = np.zeros(m), -6.0
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for k in range(1, rounds + 1):
        x = np.bincount(of_word, weights=w[of_feature], minlength=v)
        z = bias + np.bincount(sent, weights=x[idx], minlength=len(lengths))
        total = np.maximum(np.bincount(doc_of, weights=softplus(z), minlength=n), 1e-9)
        # d loss / d total, for -y log(1 - e^-T) + (1 - y) T
        slope = ((1 - y) - y / np.expm1(np.minimum(total, 500.0))) / n
        g = slope[doc_of] / (1 + np.exp(-z))
        by_word = np.bincount(idx, weights=g[sent], minlength=v)
        grad = np.append(np.bincount(of_feature, weights=by_word[of_word], minlength=m), g.sum())
        # soft threshold on the gradient at zero, a constant pull elsewhere
        at = np.append(w, bias)
        pull = np.where(at[:m] != 0, np.sign(at[:m]) * l1, -np.clip(grad[:m], -l1, l1))
        grad[:m] += pull
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        step = rate * m1 / (1 - 0.9**k) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-5)
        new = at - step
        # a weight that would cross zero stops there
        new[:m] = np.where((at[:m] != 0) & (np.sign(new[:m]) != np.sign(at[:m])), 0.0, new[:m])
        w, bias = new[:m], float(new[m])
    back = list(vocab)
    return MilModel(bias, {back[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)})


def score(text: str, bias: float, weights: _Weights) -> tuple[float, list[float]]:
    """A document's probability and those of its sentences (as :func:`sentences` has them)."""
    get = weights.__getitem__
    ps, total = [], 0.0
    base = float(np.log1p(np.exp(bias)))
    for s in SENTENCE.split(text.lower()):
        w = TOKEN.findall(s)
        if not w:
            continue
        x = sum(map(get, set(w)))
        if x:
            v = float(np.logaddexp(0.0, bias + x))
        else:
            v = base
        total += v
        ps.append(v)
    return 1.0 - float(np.exp(-total)), [1.0 - float(np.exp(-v)) for v in ps]


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def is_held_out(c):
    return F.crc32(c.cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, label: str = "toxic") -> MilModel:
    """A model from at most ``max_train`` labelled rows that aren't held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col("doc_id")))
    ids = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # bounded by max_train rows of 12 bytes
    rows = tidy(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    text, y = rows.column("text").to_pylist(), rows.column("y").to_pylist()
    return fit([text[i] for i in order], [int(y[i] > 0) for i in order])


def score_documents(docs: DataFrame, model: MilModel, at: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, offending): offending are the numbers and probabilities of sentences at or over ``at``."""
    bias, weights = model.bias, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Weights(weights)
        for b in batches:
            s, bad = [], []
            for t in b.column(1):
                p, each = score(t.as_py(), bias, table)
                s.append(p)
                bad.append([{"sentence": i, "p": x} for i, x in enumerate(each) if x >= at] if p >= at else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(bad, pa.list_(pa.struct([("sentence", pa.int64()), ("p", pa.float64())])))], names=["doc_id", "score", "offending"])

    out = tidy(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, offending array<struct<sentence: long, p: double>>")
    return out.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "offending")
