"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons, lexicons mined from the training labels, and patterns.
A generative label model takes the votes as noisy signs of a hidden class: class-conditional means
(the voters' accuracies) and a shared covariance (their correlations), estimated by EM, with the
labels that are known as one more, nearly reliable, sign; rows without a label take part in the estimate. A linear
classifier over words and votes is then trained on the model's posterior labels, and scores every whole text.

Fitted on a bounded sample: about ``PER_CLASS`` documents of each label and ``UNLABELLED`` without one at most, none of them held out.

Defined results for odd input: null and empty texts have no words and no votes and get the
classifier's base score; repeated rows get equal scores, also if their key is null or occurs with other texts; a very long
text is scored whole (it is one row of one task) and is left out of the sample; of two labels of one document the higher
counts; without any labels the lexicons alone decide; a score of exactly 0.5 is predicted toxic; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _sample
from graphloom.llm._linear import Rows, adam, sigmoid
from graphloom.llm._memory import trim

#: Rows of each label that the fit takes at most, about.
PER_CLASS = 2500
#: Rows without a label that the fit takes at most, about, and what one counts against a labelled one.
UNLABELLED, UNLABELLED_WEIGHT = 2500, 0.3
#: Words that the classifier knows at most.
VOCABULARY = 8_000
MINED_VOTERS, MINED_UNITS = 16, 256

#: Lexicons of common insults and slurs of intent, one voter each.
LEXICONS = {
    "intellect": "idiot moron stupid imbecile dumb fool dimwit dullard idiots morons",
    "worth": "trash scum worthless garbage filth vermin loser losers lowlife",
    "mockery": "clown pathetic laughable joke crybaby coward weakling",
    "disgust": "disgusting gross vile repulsive nasty sickening revolting",
    "threat": "kill hurt destroy beat murder burn",
    "hate": "hate despise loathe detest",
    "german": "idioten dumm trottel abschaum widerlich versager dreck",
    "french": "imbécile ordure nul crétin dégoûtant minable pourriture",
    "spanish": "estúpido basura imbécil asqueroso inútil escoria payaso",
}
#: Patterns, one voter each.
PATTERNS = {
    "second person": r"\b(?:you|your|u)\b[^.!?\n]{0,20}\b(?:are|r|such)\b",
    "masked word": r"\b[A-Za-z]{1,3}[*@#$]{2,}[A-Za-z]{0,3}\b",
    "shouted line": r"(?m)^[A-Z !]{20,}$",
    "stressed end": r"[!?]{3,}",
}
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = [re.compile(p) for p in PATTERNS.values()]


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def units_of(words: set[str]) -> set[str]:
    """The words and their stems: prefixes of 3 to 7 letters, marked by ``~``. Insults are inflected and compounded."""
    return words | {w[:p] + "~" for w in words for p in range(3, min(8, len(w)))}


def votes(text: str | None, units: set[str], lexicons: list[frozenset]) -> list[int]:
    """Indexes of the voters that fire: lexicons first, then patterns."""
    out = [i for i, x in enumerate(lexicons) if not x.isdisjoint(units)]
    return out + [len(lexicons) + i for i, p in enumerate(_PATTERNS) if text and p.search(text)]


def mine(names: list[str], pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> list[frozenset]:
    """Lexicons of the words and stems that most raise the odds of label 1; dealt in turn to the
    voters. ``pos`` and ``neg`` count the texts of either label that have each unit."""
    score = np.log((pos + 0.1) / (n1 + 0.2)) - np.log((neg + 0.1) / (n0 + 0.2))
    # a unit counts if it is a sign by itself: odds of ten to one, and more often seen in toxic texts than chance allows
    some = np.flatnonzero((score > 2.3) & (pos >= 4 + 3 * neg * n1 / max(1, n0)))
    best = sorted(some.tolist(), key=lambda i: (-score[i] * np.sqrt(pos[i]), names[i]))[:MINED_UNITS]
    return [frozenset(names[i] for i in best[k::MINED_VOTERS]) for k in range(MINED_VOTERS)]


def mined_share(units: set[str], mined: frozenset) -> float:
    """How many mined units the text has, damped by its length."""
    return len(units & mined) / max(20, len(units)) ** 0.5


def label_model(x: np.ndarray, y: np.ndarray, rounds: int = 10, trust: float = 0.97) -> np.ndarray:
    """Posterior of class 1 for each row of votes ``x`` (0/1); ``y`` holds the known label or nan.

    The votes' class means are the voters' accuracies, the shared covariance their correlations:
    voters that always fire together count once.
    """
    known = ~np.isnan(y)
    sign = np.where(known, np.where(y == 1, 1, -1) * np.log(trust / (1 - trust)), 0.0)
    q = np.where(known, np.where(y == 1, trust, 1 - trust), np.clip(0.05 + 0.3 * x.sum(1), 0, 0.95))
    anchored = (y == 1).any() and (y == 0).any()
    for r in range(rounds):
        # known labels start the estimate; rows without one refine it, at a lower weight
        weight = np.where(known, 1.0, 0.0 if r == 0 else UNLABELLED_WEIGHT) if anchored else np.ones(len(x))
        a, b = weight * q, weight * (1 - q)
        n1, n0 = a.sum() + 1, b.sum() + 1
        m1, m0 = (a @ x + 0.05) / n1, (b @ x + 0.01) / n0
        d1, d0 = x - m1, x - m0
        total = weight.sum()
        cov = ((d1 * a[:, None]).T @ d1 + (d0 * b[:, None]).T @ d0) / total
        cov += np.diag(0.01 + 0.1 * np.diag(cov) / total)
        w = np.linalg.solve(cov, m1 - m0)
        q = sigmoid((x - (m1 + m0) / 2) @ w + np.log(n1 / n0) + sign)
    return q


def fit(sample: pd.DataFrame, counts: dict) -> dict:
    """Model from a frame (text, label; nan where there is none) that was drawn out of ``counts`` rows of each label, which
    weigh the sampled rows. Keys: lexicons, words, known, votes, mined, share, bias."""
    number: dict[str, int] = {}
    docs, fired = [], []
    for t in sample["text"]:
        # sorted: the numbers do not depend on how a set is laid out
        docs.append(np.array([number.setdefault(u, len(number)) for u in sorted(units_of(words_of(t)))], np.int32))
        fired.append([i for i, p in enumerate(_PATTERNS) if t and p.search(t)])
    names, y, n = list(number), sample["label"].to_numpy(float), len(docs)
    fixed = [frozenset(v.split()) for v in LEXICONS.values()]
    labelled = ~np.isnan(y)
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    if not ones or not zeros:
        return {"lexicons": fixed, "words": {}, "known": frozenset(), "votes": [3.0] * len(fixed) + [0.0] * len(_PATTERNS), "mined": frozenset(), "share": 0.0, "bias": -2.0}
    sizes = np.array([len(d) for d in docs])
    row, col = np.repeat(np.arange(n), sizes), np.concatenate(docs)
    # words count by the labelled rows alone
    told = labelled[row]
    df, hits = np.bincount(col[told], minlength=len(names)), np.bincount(col[told], y[row[told]], len(names))
    lexicons = fixed + mine(names, hits, df - hits, ones, zeros)
    x = np.zeros((n, len(lexicons) + len(_PATTERNS)))
    mined_row = np.zeros(n)
    for i, words in enumerate(lexicons):
        member = np.zeros(len(names), bool)
        member[[number[w] for w in words if w in number]] = True
        per = np.bincount(row, member[col], n)
        x[:, i] = per > 0
        if i >= len(LEXICONS):
            mined_row += per
    for i, p in enumerate(fired):
        x[i, [len(lexicons) + j for j in p]] = 1
    target = label_model(x, y)
    rate = ones / (ones + zeros)
    # the units whose share of label 1 departs most from the sample's, in standard deviations
    far = np.where(df >= 5, np.abs(hits - df * rate) / np.sqrt(np.maximum(df, 1) * rate * (1 - rate)), -1)
    chosen = np.argsort(-far, kind="stable")[:VOCABULARY]
    chosen = chosen[far[chosen] >= 0]
    v, width = len(chosen), x.shape[1]
    at = np.full(len(names), -1)
    at[chosen] = np.arange(v)
    keep = at[col] >= 0
    row, col = row[keep], at[col[keep]]
    on = np.argwhere(x > 0)
    # word entries are damped by the text's length, votes are not; the share of mined units comes last
    size = np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
    share = mined_row / np.sqrt(np.maximum(20, sizes))
    every = np.arange(n)
    rows = Rows(np.r_[row, on[:, 0], every, every], np.r_[col, v + on[:, 1], np.full(n, v + width), np.full(n, v + width + 1)], np.r_[1 / size[row], np.ones(len(on)), share, np.ones(n)], n, v + width + 2)
    ridge = np.r_[np.full(v, 1e-3), np.full(width + 1, 3e-5), 0.0]
    # each label weighs as much as it does among all labelled rows
    share_of = np.where(y == 1, counts.get(1, ones) / ones, counts.get(0, zeros) / zeros)
    share_of = np.where(labelled, share_of / share_of[labelled].mean(), UNLABELLED_WEIGHT)
    share_of /= share_of.mean()
    w = adam(lambda w: rows.back(share_of * (sigmoid(rows.dot(w)) - target)) / n + ridge * w, np.zeros(v + width + 2), 200, 0.15)
    vocabulary = {names[i]: k for k, i in enumerate(chosen.tolist())}
    mined = frozenset().union(*lexicons[len(LEXICONS) :])
    return {
        "lexicons": lexicons,
        "words": {a: float(w[i]) for a, i in vocabulary.items() if abs(w[i]) > 1e-4},
        "known": frozenset(vocabulary),
        "votes": w[v : v + width].tolist(),
        "mined": mined,
        "share": float(w[v + width]),
        "bias": float(w[-1]),
    }


def score(text: str | None, model: dict) -> float:
    units = units_of(words_of(text))
    weights = model["words"]
    seen = units & model["known"]
    total = sum([weights.get(w, 0.0) for w in seen]) / max(1, len(seen)) ** 0.5 + model["share"] * mined_share(units, model["mined"])
    return float(sigmoid(model["bias"] + total + sum(model["votes"][i] for i in votes(text, units, model["lexicons"]))))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", held: int = 5, per_class: int = PER_CLASS, unlabelled: int = UNLABELLED, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``carry``, held_out, score, predicted for every whole text.

    The fit reads rows whose crc32(key as text) modulo ``held`` is not 0, with their labels or without.
    """
    spark = docs.sparkSession
    learn = labels.select(F.col(key), F.col(label).alias("label")).where(_sample.remainder(F.col(key), held) != 0)
    sample, counts = _sample.sampled(docs, learn, key, text, "label", per_class, unlabelled=unlabelled, where=_sample.remainder(F.col(key), held) != 0)
    model = spark.sparkContext.broadcast(fit(sample.toPandas().sort_values(key, kind="stable"), counts))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        for texts in batches:
            yield pd.Series([score(t, m) for t in texts], dtype="float64")
            trim()

    d = docs.select(F.col(key), *carry, F.col(text).alias("text_")).select(key, *carry, (_sample.remainder(F.col(key), held) == 0).alias("held_out"), scored("text_").alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
