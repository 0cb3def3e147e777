"""Reading level: regularised ordinal regression on text features, calibrated to graded passages.

Features of a document: log words per sentence, mean word length, share of long words, word rarity
(mean negative log share of its words in the corpus), lexical diversity (distinct words of a text of
its length, as Guiraud's index), connectives per word, commas per sentence as a proxy of clause depth,
and log length. Standardised on the graded passages; a proportional-odds model with a ridge penalty
is fitted to them by BFGS on the driver: the graded table is small by definition, and at most
`fit_rows` of its rows are used, those whose texts have the smallest hashes. Cut points are fitted with the weights.

Word shares are counted over all documents. Only words with a share of at least 1 / `vocabulary` are
sent to the executors, which are at most `vocabulary` words whatever the corpus; rarer words all
count as rare as that bound.

Defined results: English is decided by the text (function words of four languages), not by the lang
column; NULL, blank, other and too short texts (fewer than min_words) get no row; texts of any length
are read whole; repeated rows give repeated rows; with no graded passage there is no row.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselite.session import materialize

WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n|\n(?=[-*#])")
# fixed values: common function words of the languages
FUNCTION_WORDS = {
    "en": "the a an and of to in is that this these those it for on with as was are be by at from or our one every each which not but when until while because".split(),
    "de": "der die das und ist nicht ein eine einen mit von zu den dem des auf für im sich auch wird aus bei nach jede jeder weil aber ohne vor".split(),
    "es": "el la los las y de que en un una es por con para del se al como más pero sus cada sin desde este esta porque hasta".split(),
    "fr": "le la les et de des un une du est que en dans pour qui par sur avec plus pas ce cette chaque sans parce pendant mais au".split(),
}
# fixed values: connectives that join clauses or sentences
CONNECTIVES = frozenset("although because whereas while until when so but and then however therefore since unless if though thus hence moreover".split())
FEATURES = ("log_sentence_words", "word_length", "long_words", "rarity", "diversity", "connectives", "commas", "log_words")


def clean(text: str) -> str:
    """Entities and a byte-order mark resolved, line ends unified."""
    text = text.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n")
    return html.unescape(text) if "&" in text else text


def is_english(words: list[str]) -> bool:
    """Whether English function words are the most frequent ones among the languages known here."""
    n = Counter(words)
    score = {lang: sum(n[w] for w in own) for lang, own in FUNCTION_WORDS.items()}
    return score["en"] > 0 and score["en"] >= max(score.values()) and score["en"] >= 0.1 * len(words)


def features(text: str, words: list[str], rarity: dict[str, float], rarest: float) -> list[float]:
    n = len(words)
    ends = [s for s in SENTENCE_END.split(text) if len(WORD.findall(s)) >= 3]
    sentences = max(1, len(ends))
    spoken = sum(len(WORD.findall(s)) for s in ends) or n
    return [
        math.log(spoken / sentences),
        sum(map(len, words)) / n,
        sum(len(w) > 9 for w in words) / n,
        sum(rarity.get(w, rarest) for w in words) / n,
        len(set(words)) / math.sqrt(n),
        sum(w in CONNECTIVES for w in words) / n,
        math.log1p(text.count(",") / sentences),
        math.log(n),
    ]


def word_rarity(documents: DataFrame, text: str, vocabulary: int) -> tuple[dict[str, float], float]:
    """Negative log share of every word with a share of at least 1 / vocabulary, and that of all others."""
    words = documents.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    counts = materialize(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")  # read twice, counted once
    total = counts.agg(F.sum("n")).first()[0] or 0
    rarest = math.log(vocabulary)
    if not total:
        return {}, rarest
    common = counts.where(F.col("n") >= math.ceil(total / vocabulary)).toArrow()
    return {w: math.log(total / n) for w, n in zip(common.column("w").to_pylist(), common.column("n").to_pylist())}, rarest


class OrdinalRegression:
    """P(band <= j) = sigmoid(cut_j - w x), ridge on w, fitted by BFGS with backtracking."""

    def __init__(self, ridge: float = 1.0, steps: int = 400):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, bands: np.ndarray) -> OrdinalRegression:
        self.levels = np.unique(bands)
        y = np.searchsorted(self.levels, bands)
        k = len(self.levels)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - self.mean) / self.scale
        share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y), 0.02, 0.98)
        cuts = np.log(share / (1 - share))
        # cut points as first one and logs of the gaps keep their order
        theta = np.r_[np.zeros(z.shape[1]), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.1))]

        def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
            w, c = t[: z.shape[1]], t[z.shape[1] :]
            gaps = np.exp(np.clip(c[1:], -20, 20))
            cut = np.r_[-np.inf, c[0] + np.r_[0, np.cumsum(gaps)], np.inf]
            s = z @ w
            up, down = _sigmoid(cut[y + 1] - s), _sigmoid(cut[y] - s)
            p = np.maximum(up - down, 1e-12)
            du, dd = up * (1 - up) / p, down * (1 - down) / p
            gw = z.T @ (du - dd) + self.ridge * w
            dcut = np.zeros(k + 1)
            np.add.at(dcut, y + 1, -du)
            np.add.at(dcut, y, dd)
            inner = dcut[1:k]
            gc = np.r_[inner.sum(), [inner[j:].sum() * gaps[j - 1] for j in range(1, k - 1)]] if k > 1 else np.zeros(0)
            return -np.log(p).sum() + 0.5 * self.ridge * w @ w, np.r_[gw, gc]

        if k > 1:
            theta = _descend(loss, theta, self.steps)
        self.w, c = theta[: z.shape[1]], theta[z.shape[1] :]
        self.cuts = c[0] + np.r_[0, np.cumsum(np.exp(np.clip(c[1:], -20, 20)))] if k > 1 else np.zeros(0)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = (x - self.mean) / self.scale @ self.w
        return self.levels[np.searchsorted(self.cuts, s)]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -500, 500)))


def _descend(loss, theta: np.ndarray, steps: int) -> np.ndarray:
    """BFGS with backtracking; the problem has a dozen unknowns."""
    value, grad = loss(theta)
    h = np.eye(len(theta)) / max(1.0, np.linalg.norm(grad))
    for _ in range(steps):
        step = -h @ grad
        if step @ grad >= 0:
            h = np.eye(len(theta)) / max(1.0, np.linalg.norm(grad))
            step = -h @ grad
        rate = 1.0
        while rate > 1e-10:
            new_value, new_grad = loss(theta + rate * step)
            if new_value <= value + 1e-4 * rate * (step @ grad):
                break
            rate /= 2
        else:
            break
        s, yv = rate * step, new_grad - grad
        theta, done, value, grad = theta + s, abs(value - new_value) < 1e-10, new_value, new_grad
        sy = s @ yv
        if sy > 1e-12:
            a = np.eye(len(theta)) - np.outer(s, yv) / sy
            h = a @ h @ a.T + np.outer(s, s) / sy
        if done:
            break
    return theta


def fit(graded: DataFrame, rarity: dict[str, float], rarest: float, *, text: str = "text", band: str = "band", fit_rows: int = 20_000, ridge: float = 1.0) -> OrdinalRegression | None:
    """The model of the graded passages that have a band and a text; None if there is none."""
    rows = graded.select(text, band).where(F.col(text).isNotNull() & F.col(band).isNotNull()).orderBy(F.xxhash64(text), text, band).limit(fit_rows).collect()
    x, y = [], []
    for t, b in rows:
        t = clean(t)
        if words := WORD.findall(t.lower()):
            x.append(features(t, words, rarity, rarest)), y.append(b)
    return OrdinalRegression(ridge).fit(np.array(x), np.array(y)) if x else None


def _score(shared, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rarity, rarest = shared.value
        for batch in batches:
            ids, x = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = clean(t)
                words = WORD.findall(t.lower())
                if len(words) >= min_words and is_english(words):
                    ids.append(i), x.append(features(t, words, rarity, rarest))
            bands = model.predict(np.array(x)) if x else np.zeros(0, "i4")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bands.astype("i4"), pa.int32())], names=["doc_id", "band"])

    return run


def reading_bands(documents: DataFrame, graded: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 40, vocabulary: int = 50_000, ridge: float = 1.0) -> DataFrame:
    """doc_id, band of every English document of at least min_words words."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rarity, rarest = word_rarity(docs, "text", vocabulary)
    model = fit(graded, rarity, rarest, ridge=ridge)
    if model is None:
        return spark.createDataFrame([], "doc_id long, band int")
    return docs.mapInArrow(_score(spark.sparkContext.broadcast((model, rarity, rarest)), min_words), "doc_id long, band int")
