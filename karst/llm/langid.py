"""Operator 1: language identification by averaged hashed subword embeddings.

Every word, lower-cased and closed by spaces, gives its character n-grams of
lengths ``GRAMS``; each is hashed to a row of an embedding table.  A text is the
average of its rows, over the whole text, and a linear softmax turns that into a
probability for each language.  Table and softmax are trained together by
stochastic gradient descent in numpy on the driver, on a bounded sample of
labelled rows.  As the average is linear, the trained table times the softmax
weights is folded into one small table of scores that is broadcast: buckets times
languages, whatever the input.

Calibration: on sample rows kept out of training, a temperature is fitted so that
scores are probabilities, and the rejection threshold is set so that at most the
share ``REJECT`` of rightly classified rows falls below it.  Texts with no letter
are ``und`` and rejected.

Defined results: null text and text without letters give ``und``, score 0 and
rejected; with no labelled row at all every row is ``und``; with one language
every text with letters gets it, score 1; a null doc_id is predicted like any
other and is not held out; repeated rows get equal rows; an empty table gives no
rows; columns other than id, text and, for learning, lang play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import as_text, documents

GRAMS = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSIONS = 16
#: Bound of the training sample: rows, and characters of a row that may be in it.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 20_000
EPOCHS = 4
BATCH = 32
RATE = 0.5
#: The share of rightly classified calibration rows that may be rejected.
REJECT = 0.0005
UNDETERMINED = "und"
_BLOCK = 1 << 18
_SPACE = 32


def _codes(text: str) -> np.ndarray:
    """Code points, lower-cased, every non-letter a space, spaces at both ends."""
    lower = text.lower()
    codes = np.frombuffer(lower.encode("utf-32-le", "replace"), dtype="<u4")
    high = codes[codes >= 128]
    keep = (codes >= 97) & (codes <= 122)
    if len(high):
        letters = {c for c in np.unique(high).tolist() if chr(c).isalpha()}
        keep |= np.isin(codes, np.fromiter(letters, dtype=np.uint32, count=len(letters)))
    out = np.full(len(codes) + 2, _SPACE, dtype=np.uint32)
    out[1:-1] = np.where(keep, codes, _SPACE)
    return out


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all subwords of a text, block by block."""
    codes = _codes(text)
    for at in range(0, max(len(codes) - 1, 1), _BLOCK):
        c = codes[at : at + _BLOCK + max(GRAMS) - 1].astype(np.uint64)
        inner = c != _SPACE
        h, parts = c, []
        for n in range(2, max(GRAMS) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) ^ c[n - 1 :] * np.uint64(0x9E3779B1)
            if n in GRAMS:
                # no space inside, and not a lone space-letter pair at both ends only
                ok = inner[1 : len(c) - n + 2] if n > 2 else inner[: len(c) - 1] | inner[1:]
                for k in range(2, n - 1):
                    ok = ok & inner[k : len(c) - n + 1 + k]
                ok = ok[:_BLOCK]
                x = h[:_BLOCK][ok]
                parts.append(((x ^ (x >> np.uint64(17))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48))
        if parts:
            yield np.concatenate(parts).astype(np.int64) & (BUCKETS - 1)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # languages x buckets: embedding table times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        """None for a text without letters."""
        total, n = np.zeros(len(self.languages)), 0
        for b in subwords(text):
            n += len(b)
            total += [np.take(s, b).sum(dtype=np.float64) for s in self.scores]
        return total / n + self.bias if n else None

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        logits = self.logits(text) if text and self.languages else None
        if logits is None:
            return UNDETERMINED, 0.0, True
        p = self.probabilities(logits)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fits a model on whole texts; every tenth row only calibrates."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages, np.zeros((len(languages), BUCKETS), np.float32), np.zeros(len(languages)))
    rows = []
    for text, label in zip(texts, labels):
        blocks = list(subwords(text))
        if blocks:
            b, n = np.unique(np.concatenate(blocks), return_counts=True)
            rows.append((b, (n / n.sum()).astype(np.float32), languages.index(label)))
    held, rows = rows[::10], [r for i, r in enumerate(rows) if i % 10]
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((BUCKETS, DIMENSIONS)) / np.sqrt(DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps = EPOCHS * -(-len(rows) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = [rows[i] for i in order[at : at + BATCH]]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            sizes = [len(r[0]) for r in some]
            b = np.concatenate([r[0] for r in some])
            share = np.concatenate([r[1] for r in some])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            mean = np.add.reduceat(table[b] * share[:, None], starts, axis=0)
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), [r[2] for r in some]] -= 1
            back = p @ weights.T  # gradient of each text's average
            weights -= rate * (mean.T @ p)
            bias -= rate * 0.1 * p.sum(axis=0)
            change = np.repeat(back, sizes, axis=0) * share[:, None] * rate
            spots, where = np.unique(b, return_inverse=True)
            by = np.argsort(where, kind="stable")
            table[spots] -= np.add.reduceat(change[by], np.searchsorted(where[by], np.arange(len(spots))), axis=0)
    model = Model(languages, np.ascontiguousarray((table @ weights).T), bias.astype(np.float64))
    _calibrate(model, held or rows)
    return model


def _calibrate(model: Model, rows: list) -> None:
    logits = np.array([[(s[b] * w).sum() for s in model.scores] for b, w, _ in rows]) + model.bias
    truth = np.array([r[2] for r in rows])

    def loss(t: float) -> float:
        # one row more, spread over all languages: without it a faultless sample would ask for certainty
        model.temperature = t
        log = np.log(model.probabilities(logits) + 1e-12)
        return -(log[np.arange(len(rows)), truth].sum() + log.mean()) / (len(rows) + 1)

    model.temperature = min(np.geomspace(0.02, 20, 61), key=loss)
    p = model.probabilities(logits)
    right = p.argmax(axis=1) == truth
    if right.any():
        model.threshold = float(np.quantile(p.max(axis=1)[right], REJECT, method="lower")) * 0.9


def held_out(id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Trains on a hash sample of about ``rows`` labelled rows (at most 1.2 times as many) that are not held out."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id))
    usable = usable.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    usable = usable.filter(F.length("text").between(1, SAMPLE_CHARS))
    there = usable.count()
    share = int(min(1.0, rows / max(there, 1)) * (1 << 30))
    some = usable.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share).limit(int(1.2 * rows))
    found = sorted((tuple(r) for r in some.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return train([r[1] for r in found], [r[2] for r in found])


def identify(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [shared.value.predict(t) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["id"], "held_out": x["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]})

    rows = docs.select(F.col(id).cast("long").alias("id"), held_out(id).alias("held_out"), as_text(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, columns as they are, whose text the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def taken(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.predict(t)[2] for t in texts], dtype=bool)

    return docs.filter(taken(as_text(text)))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
