"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - threshold_k): one set of weights over hashed text features for all
grades, and ordered thresholds. Features are hashed shapes of white-space tokens (runs of letters,
capitals, digits; each punctuation mark is itself), pairs of neighbouring shapes, and lower-cased
tokens, and tokens that repeat the one before, each counted as a share of the text's tokens. The expected grade and the tail probability
P(grade >= keep_from) come from the fitted model.

Fitted on a bounded sample: about ``PER_GRADE`` rated documents of each grade at most.

Defined results for odd input: null and empty texts have no features and get the grade that the
thresholds alone give; ratings that are null do not count, of several ratings of a document the highest does; with one grade
that grade is certain, without any rating every text has the least grade to keep; a tail of exactly 0.5 is kept; repeated rows get equal results; very long texts are scored whole,
in a chunk of their own, and are left out of the sample; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _sample
from graphloom.llm._linear import Rows, adam, sigmoid
from graphloom.llm._memory import trim
from graphloom.llm.language import chunks

PER_GRADE = 1500
BUCKETS = 1 << 17
#: Characters that are worked on at once; a worker needs about 100 bytes for each.
CHUNK_CHARS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000: 0 white space, 1 small letter, 2 capital, 3 digit, 4 other
    beyond ASCII, else the ASCII mark itself."""
    out = np.full(0x3000, 4, np.uint64)
    for c in range(0x3000):
        ch = chr(c)
        out[c] = 0 if ch.isspace() else 3 if ch.isdigit() else 2 if ch.isupper() else 1 if ch.isalpha() else c if c < 128 else 4
    return out


_CLASS = _classes()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of all texts: an entry for each token's shape, pair, own hash and
    repetition, valued 1 / tokens, the own hash a tenth of that."""
    joined = "\n".join([t or "" for t in texts]) + "\n"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    k = _CLASS[np.minimum(c, 0x2FFF)]
    ink = k > 0
    begin = np.flatnonzero(ink & ~np.r_[False, ink[:-1]])
    if not len(begin):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0)
    row = np.searchsorted(np.cumsum(sizes), begin, side="right")
    # shape: a run of one class counts once; its place within the token is the number of runs before it
    run = ink & (k != np.r_[np.uint64(0), k[:-1]])
    order = np.cumsum(run)
    token = np.cumsum(np.bincount(begin, minlength=len(c))) - 1
    place = (order - order[begin][token]).astype(np.uint64)
    mixed = (k + np.uint64(1)) * _P * ((place + np.uint64(1)) * np.uint64(2) + np.uint64(1))
    mixed ^= mixed >> np.uint64(33)
    shape = np.add.reduceat(np.where(run, mixed, np.uint64(0)), begin)
    low = np.where((c >= 65) & (c <= 90), c + 32, c).astype(np.uint64)
    at = (np.arange(len(c)) - begin[np.maximum(token, 0)]).astype(np.uint64)
    word = (low + np.uint64(11)) * _Q * (at * np.uint64(2) + np.uint64(3))
    word ^= word >> np.uint64(31)
    word = np.add.reduceat(np.where(ink, word, np.uint64(0)), begin)
    before = np.r_[np.uint64(0), shape[:-1]]
    before[np.r_[True, row[1:] != row[:-1]]] = 0
    pair = shape * _Q + before * _P + np.uint64(5)
    bucket = lambda x, salt: (((x + np.uint64(salt)) * _P) >> np.uint64(64 - 17)).astype(np.int64)
    n = np.bincount(row, minlength=len(texts))[row]
    again = np.r_[False, (word[1:] == word[:-1]) & (row[1:] == row[:-1])]
    repeated = np.full(again.sum(), 1, np.int64)
    return np.r_[row, row, row, row[again]], np.r_[bucket(shape, 1), bucket(pair, 2), bucket(word, 3), repeated], np.r_[1 / n, 1 / n, 0.1 / n, 1 / n[again]]


def fit(texts: list[str | None], grades: np.ndarray, counts: dict | None = None, rounds: int = 300) -> dict:
    """Weights and thresholds. ``counts`` (rows of each grade) weighs the sample back to the table's shares."""
    levels = sorted(set(grades.tolist()))
    if len(levels) < 2:
        return {"levels": [int(x) for x in levels] or [0], "w": np.zeros(BUCKETS, np.float32), "cut": np.zeros(0)}
    row, col, val, n = [], [], [], len(texts)
    for a, b in chunks(texts, CHUNK_CHARS):
        r, c, x = features(texts[a:b])
        # equal entries of a row are added up, chunk by chunk
        both, inverse = np.unique(r.astype(np.int64) * BUCKETS + c, return_inverse=True)
        row.append((both // BUCKETS + a).astype(np.int32))
        col.append((both % BUCKETS).astype(np.int32))
        val.append(np.bincount(inverse, x).astype(np.float32))
    x = Rows(np.concatenate(row), np.concatenate(col), np.concatenate(val), n, BUCKETS)
    y = np.searchsorted(levels, grades)
    m = len(levels) - 1
    share = np.array([(counts or {}).get(g, (grades == g).sum()) / (grades == g).sum() for g in levels])
    weight = (share / (share @ np.bincount(y) / n))[y]

    def cuts(p):
        return p[0] + np.r_[0, np.cumsum(np.exp(p[1:]))]

    def gradient(v):
        w, p = v[:BUCKETS], v[BUCKETS:]
        z, t = x.dot(w), cuts(p)
        s = sigmoid(z[:, None] - t)
        # log likelihood of the grade: P(y = k) = s[k-1] - s[k]
        full = np.c_[np.ones(n), s, np.zeros(n)]
        prob = np.maximum(full[np.arange(n), y] - full[np.arange(n), y + 1], 1e-9)
        d = np.c_[np.zeros(n), s * (1 - s), np.zeros(n)]
        up, down = d[np.arange(n), y], d[np.arange(n), y + 1]
        gz = -weight * (up - down) / prob / n
        gt = np.zeros(m)
        for k in range(m):
            gt[k] = np.sum(weight * (np.where(y == k + 1, d[:, k + 1], 0) - np.where(y == k, d[:, k + 1], 0)) / prob) / n
        gp = np.r_[gt.sum(), np.cumsum(gt[::-1])[::-1][1:] * np.exp(p[1:])]
        return np.r_[x.back(gz) + 2e-5 * w, gp]

    v = adam(gradient, np.r_[np.zeros(BUCKETS), -2.0, np.zeros(m - 1)], rounds, 0.3)
    return {"levels": [int(g) for g in levels], "w": v[:BUCKETS].astype(np.float32), "cut": cuts(v[BUCKETS:])}


def tails(texts: list[str | None], model: dict) -> np.ndarray:
    """P(grade > level k) for every text and every level but the last."""
    row, col, val = features(texts)
    z = np.bincount(row, val * model["w"][col], len(texts))
    return sigmoid(z[:, None] - model["cut"])


def ratings_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Graded ratings out of binary labels: 0 poor, 1 good but toxic, 2 good."""
    return labels.select(key, F.expr("quality * (2 - toxic)").alias("grade"))


def grade(docs: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", rating: str = "grade", held: int = 5, keep_from: int = 1, per_grade: int = PER_GRADE, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``carry``, held_out, expected_grade, tail (probability of ``keep_from`` or better) and keep
    (tail >= 0.5) for every whole text.

    The fit reads ratings of rows whose crc32(key as text) modulo ``held`` is not 0.
    """
    spark = docs.sparkSession
    learn = ratings.select(F.col(key), F.col(rating).cast("int").alias("grade")).where(_sample.remainder(F.col(key), held) != 0)
    sample, counts = _sample.sampled(docs, learn, key, text, "grade", per_grade)
    got = sample.toPandas().sort_values(key, kind="stable")
    fitted = fit(got["text"].tolist(), got["grade"].to_numpy(int), counts)
    model = spark.sparkContext.broadcast(fitted if len(got) else fitted | {"levels": [keep_from]})

    @F.pandas_udf("expected double, tail double")
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model.value
        levels = np.array(m["levels"], float)
        for series in batches:
            texts = series.tolist()
            p = np.concatenate([tails(texts[a:b], m) for a, b in chunks(texts, CHUNK_CHARS)] or [np.zeros((0, len(m["cut"])))])
            at = int(np.searchsorted(levels, keep_from))
            tail = np.ones(len(p)) if at == 0 else p[:, at - 1] if at <= p.shape[1] else np.zeros(len(p))
            yield pd.DataFrame({"expected": levels[0] + p @ np.diff(levels), "tail": tail})
            trim()

    d = docs.select(F.col(key), *carry, F.col(text).alias("text_")).select(key, *carry, (_sample.remainder(F.col(key), held) == 0).alias("held_out"), graded("text_").alias("r_"))
    return d.select(key, *carry, "held_out", F.col("r_.expected").alias("expected_grade"), F.col("r_.tail").alias("tail"), (F.col("r_.tail") >= 0.5).alias("keep"))
