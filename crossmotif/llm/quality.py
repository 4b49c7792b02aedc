"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled good; all other text counts as unlabelled, whatever it is. The share of
good documents in the unlabelled text is estimated from how far the two distributions of a first model's scores can
be told apart (the least ratio of their tails bounds it). The classifier then minimises the unbiased risk with that
share, the part of it that estimates the risk on bad text being held non-negative: where a batch drives it below
zero, the step goes the other way. Features are taken from whole texts: shape statistics in bins, and counts of
hashed byte trigrams.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmotif.runtime import pick, stored

SAMPLE_ROWS = 6_000  # trusted positives, and as many unlabelled documents, used for fitting at most
SLOTS = 1 << 10  # of hashed trigrams
PIECE = 1 << 20  # bytes looked at together
SYMBOLS = b"#$%&*|{}<>[]\\^~@=+_/"
BINS = 10
# Weight of the trigrams beside the statistics, and shrinkage: chosen among 1, 10 and 32, and 0.002 to 0.1, by held-out AUC.
TRIGRAM_SCALE, RIDGE = 10.0, 0.05
ACCEPT = 0.5
_KIND = np.zeros(256, dtype=np.uint8)  # 0 other, 1 small letter, 2 capital, 3 digit, 4 white space, 5 symbol, 6 punctuation, 7 beyond ASCII
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[np.frombuffer(SYMBOLS, dtype=np.uint8)] = 5
_KIND[np.frombuffer(b".,;:!?'\"()-`", dtype=np.uint8)] = 6
_KIND[128:] = 7
# What a byte adds to its word: bits of four counters of 16 bits each (letters, capitals, vowels, signs).
_ADDS = np.zeros(256, dtype=np.uint64)
_ADDS[np.isin(_KIND, [1, 2, 3, 7])] += np.uint64(1)
_ADDS[_KIND == 2] += np.uint64(1 << 16)
_ADDS[np.isin(np.arange(256), list(b"aeiouyAEIOUY")) | (_KIND == 7)] += np.uint64(1 << 32)
_ADDS[(_KIND == 5) | (np.arange(256) == ord("!"))] += np.uint64(1 << 48)
# Slot of a trigram: the exclusive or of what its three bytes are given.
_TRI = np.random.default_rng(11).integers(0, SLOTS, (3, 256), dtype=np.int16)
LONGEST = 60_000  # bytes of a word; a longer one counts as several, so that its counters hold

STATS = (
    "log_bytes", "log_words", "small", "capital", "digit", "white", "symbol", "punctuation", "beyond", "control", "word_bytes", "distinct_words", "top_word",
    "same_as_last", "distinct_lines", "line_bytes", "ends_sentence", "signed_words", "capital_words", "long_words", "bare_words", "no_vowel", "distinct_pairs", "byte_entropy",
)


def _word_shares(data: np.ndarray) -> list[float]:
    """Shares of the words that end a sentence, hold a symbol or mark of exclamation, are all capitals, have over 20 bytes,
    have no letter or digit, and have letters but no vowel."""
    white = _KIND[data] == 4
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts = edge[~white[edge]]
    if len(data) and not white[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return [0.0] * 6
    ends = edge[white[edge]]
    if not white[-1]:
        ends = np.concatenate([ends, [len(data)]])
    size = ends - starts
    if size.max() > LONGEST:
        parts = -(-size // LONGEST)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + (np.arange(parts.sum()) - first) * LONGEST
        size = np.minimum(np.repeat(ends, parts) - starts, LONGEST)
        ends = starts + size
    # The white space behind a word adds nothing to it.
    sums = np.add.reduceat(_ADDS[data], starts)
    letters, capitals, vowels, signs = ((sums >> np.uint64(s)) & np.uint64(0xFFFF) for s in (0, 16, 32, 48))
    last = data[ends - 1]
    tests = ((last == 46) | (last == 33) | (last == 63), signs > 0, (letters > 0) & (capitals == letters), size > 20, letters == 0, (letters > 0) & (vowels == 0))
    return [float(t.mean()) for t in tests]


def statistics(text: str, data: np.ndarray) -> np.ndarray:
    """Shape statistics of a whole text, in the order of STATS."""
    n = max(1, len(data))
    by_byte = np.bincount(data, minlength=256)
    kinds = np.bincount(_KIND, weights=by_byte, minlength=8) / n
    words = text.split()
    w = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    share = by_byte[by_byte > 0] / n
    return np.array([
        math.log1p(len(data)), math.log1p(len(words)), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[0], (n - kinds[4] * n) / w, len(seen) / w,
        max(seen.values(), default=0) / w, sum(map(eq, words, islice(words, 1, None))) / w, len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        *_word_shares(data), len(set(zip(words, islice(words, 1, None)))) / w, -float((share * np.log2(share)).sum()),
    ])


def trigrams(data: np.ndarray) -> np.ndarray:
    """Root of the share of each slot of hashed byte trigrams, over the whole text."""
    counts = np.zeros(SLOTS)
    for at in range(0, max(0, len(data) - 2), PIECE):
        b = data[at : at + PIECE + 2]
        h = _TRI[0][b[:-2]] ^ _TRI[1][b[1:-1]] ^ _TRI[2][b[2:]]
        counts += np.bincount(h, minlength=SLOTS)
    return np.sqrt(counts / max(1.0, counts.sum()))


def raw_features(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    return np.concatenate([statistics(text, data), trigrams(data)]).astype(np.float32)


@dataclass
class Model:
    """Weights over the bins of the statistics and the trigram slots; without weights every text scores ``prior``."""

    prior: float
    edges: np.ndarray | None = None  # of the bins, one row a statistic
    centre: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0

    def expand(self, raw: np.ndarray) -> np.ndarray:
        """Rows of raw features as model inputs: a step for every edge that a statistic passes, trigrams centred."""
        k, width = len(STATS), self.edges.size
        out = np.empty((len(raw), width + SLOTS), dtype=np.float32)
        out[:, :width] = (raw[:, :k, None] > self.edges[None]).reshape(len(raw), -1)
        np.subtract(raw[:, k:], self.centre, out=out[:, width:])
        out[:, width:] *= np.float32(TRIGRAM_SCALE)
        return out

    def score(self, raw: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(raw), self.prior)
        z = self.expand(raw).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_risk_step(x_p: np.ndarray, x_u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[np.ndarray, float, float]:
    """(gradient of the weights, of the bias, estimated risk on bad text) of the non-negative risk with logistic loss.

    The risk is prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]); where the second part is below zero,
    only its negative is followed, which lifts it.
    """
    z_p, z_u = x_p @ w + b, x_u @ w + b
    s_p, s_u = 1 / (1 + np.exp(-np.clip(z_p, -30, 30))), 1 / (1 + np.exp(-np.clip(z_u, -30, 30)))
    bad = float(np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean())
    g_bad_u, g_bad_p = s_u / len(z_u), -prior * s_p / len(z_p)
    if bad < 0:
        g_u, g_p = -g_bad_u, -g_bad_p
    else:
        g_u, g_p = g_bad_u, g_bad_p + prior * (s_p - 1) / len(z_p)
    return x_u.T @ g_u + x_p.T @ g_p, float(g_u.sum() + g_p.sum()), bad


def minimise(x: np.ndarray, at_p: np.ndarray, at_u: np.ndarray, prior: float, ridge: float, epochs: int = 40, batch: int = 256) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over batches of the positives and the unlabelled among the rows of ``x``, whose places are
    given; the last third of the steps is averaged."""
    rng = np.random.default_rng(5)
    w, b = np.zeros(x.shape[1]), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    steps = epochs * max(1, -(-max(len(at_p), len(at_u)) // batch))
    mean, taken = np.zeros(len(w) + 1), 0
    for t in range(1, steps + 1):
        p, u = (x[at[rng.integers(0, len(at), min(batch, len(at)))]].astype(np.float64) for at in (at_p, at_u))
        g_w, g_b, _ = nn_risk_step(p, u, w, b, prior)
        g = np.append(g_w + ridge * w, g_b)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if 3 * t > 2 * steps:
            mean, taken = mean + np.append(w, b), taken + 1
    return mean[:-1] / taken, float(mean[-1] / taken)


def tail_ratio(s_p: np.ndarray, s_u: np.ndarray) -> float:
    """Bound of the share of positives among unlabelled scores: the least ratio, over all thresholds, of the shares that
    lie below it, each side allowed an error that shrinks with its sample."""
    at = np.unique(np.quantile(s_p, np.linspace(0.02, 1, 99)))
    below_p, below_u = (np.searchsorted(np.sort(s), at, side="right") / len(s) for s in (s_p, s_u))
    above_p, above_u = 1 - below_p, 1 - below_u
    slack = lambda n: math.sqrt(math.log(40) / (2 * n))
    bounds = []
    for p, u in ((above_p, above_u), (below_p, below_u)):
        enough = p > 0.2
        bounds += list((u[enough] + slack(len(s_u))) / (p[enough] + slack(len(s_p))))
    return float(np.clip(min(bounds, default=0.5), 0.05, 0.95))


def fit_arrays(raw: np.ndarray, trusted: np.ndarray, prior: float | None = None, ridge: float = RIDGE) -> Model:
    """A model from raw features of trusted positives and of unlabelled documents."""
    k = len(STATS)
    at_p, at_u = np.flatnonzero(trusted), np.flatnonzero(~trusted)
    edges = np.quantile(raw[:, :k], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    # Beyond what trusted text shows: both ends of its range are edges too.
    ends = np.quantile(raw[at_p, :k], [0.005, 0.995], axis=0).T
    model = Model(0.5, np.concatenate([edges, ends], axis=1).astype(np.float32), raw[:, k:].mean(axis=0))
    x = model.expand(raw)
    if prior is None:
        found = []
        for fold in (0, 1):  # scores of rows that the first model has not seen
            (fit_p, new_p), (fit_u, new_u) = ((at[fold::2], at[1 - fold :: 2]) for at in (at_p, at_u))
            if not min(map(len, (fit_p, new_p, fit_u, new_u))):
                continue
            w, b = minimise(x, fit_p, fit_u, 0.5, ridge, epochs=15)
            found.append(tail_ratio(*(x[at] @ w.astype(np.float32) + np.float32(b) for at in (new_p, new_u))))
        prior = float(np.mean(found)) if found else 0.5
    model.prior = prior
    model.weights, model.bias = minimise(x, at_p, at_u, prior, ridge)
    return model


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [raw_features(t.as_py() or "").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("trusted"), pa.array(rows, pa.binary())], names=["trusted", "raw"])


def held_out(id_):
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(text, trusted): at most ``sample`` documents labelled good, and as many of all the others, by the smallest hashes
    of their ids. Never a held-out row, and never a label but "good"; one text an id. Label ids of another type count
    where they can be read as the documents'."""
    kind = pick(docs, id=id_col).schema["id"].dataType.simpleString()
    marks = pick(labels, id="doc_id", quality="quality").withColumn("id", F.expr(f"try_cast(id as {kind})")).where("id is not null").groupBy("id").agg(F.min("quality").alias("quality"))
    good = marks.where("quality = 1").select(F.col("id").alias("of"), F.lit(True).alias("trusted"))
    ids = pick(docs, id=id_col).where("id is not null").where(~held_out(F.col("id"))).distinct()
    both = ids.join(good, F.expr("id = of"), "left").select("id", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    first = lambda which: both.where(which).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = first("trusted").unionAll(first("not trusted"))
    texts = pick(docs, key=id_col, text=text_col).join(F.broadcast(chosen), F.expr("key = id"))  # 2 x ``sample`` ids
    return texts.groupBy("id", "trusted").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_ROWS, prior: float | None = None) -> Model:
    """A model from at most 2 x ``sample`` documents; ``prior`` is the share of good text among unlabelled, estimated if
    not given. Without trusted positives or other text nothing can be learned, and every text scores 0.5."""
    rows = stored(training_rows(docs, labels, id_col, text_col, sample).select("text", "trusted"), "quality-sample")
    found = rows.mapInArrow(_raw, "trusted boolean, raw binary").toArrow()  # 2 x ``sample`` rows of 4 KB
    found = found.sort_by([("trusted", "ascending"), ("raw", "ascending")])
    trusted = found.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
    if trusted.all() or not trusted.any():
        return Model(0.5)
    raw = np.empty((len(trusted), len(STATS) + SLOTS), dtype=np.float32)
    for i, row in zip(np.random.default_rng(3).permutation(len(trusted)), found.column("raw")):
        raw[i] = np.frombuffer(row.as_buffer(), dtype=np.float32)
    trusted = trusted[np.argsort(np.random.default_rng(3).permutation(len(trusted)))]
    del found
    return fit_arrays(raw, trusted, prior)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for at in range(0, batch.num_rows, 256):
            texts = batch.column("text").slice(at, 256)
            found.append(model.score(np.stack([raw_features(t.as_py() or "") for t in texts])))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(found) if found else [], pa.float64())], names=["id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, from the whole text.

    Null texts score as empty ones, by the model like any other; a null doc_id counts as an empty one for ``held_out``;
    repeated rows are scored each, alike; an empty table gives no row. A score at the threshold is predicted good.
    """
    rows = pick(docs, id=id_col, text=text_col)
    scored = rows.mapInArrow(lambda b: _score(b, model), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
