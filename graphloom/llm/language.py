"""Language identification: script ranges narrow the candidates, per-word scores come from
character trigrams and whole words, and Viterbi with a switching penalty labels the spans of a text
that mixes languages.

Fitted on a bounded sample: about ``PER_LANGUAGE`` documents of each language at most; more languages than
``_sample.MAX_CLASSES`` are refused.

Defined results for odd input: a text that is null or has no letter (numerals such as one half or a circled one are none) is
``und`` with score 0 and no spans; ties go to the language that comes first by code point; without any training row every text
is ``und``; repeated rows get equal results; rows with a null language are not learned from, whatever rows share their key; very long
texts are worked on whole, in a chunk of their own; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _sample
from graphloom.llm._memory import trim

PER_LANGUAGE = 3000
BUCKETS = 1 << 16
#: Cost of a change of language between two words, in units of log odds.
SWITCH = 12.0
#: Characters that are worked on at once.
CHUNK_CHARS = 1_000_000
#: First code points of script ranges (Latin, Greek, Cyrillic, Armenian, Hebrew,
#: Arabic, Indic, Thai to Georgian, Hangul Jamo, other, kana, Han, Hangul, Latin again).
SCRIPT_STARTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x1100, 0x1200, 0x3040, 0x3100, 0xAC00, 0xD800])
#: Runs of letters, and of numerals that are neither digits nor letters: those without a letter are no words.
_WORD = re.compile(r"[^\W\d_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def lettered(words: list[str]) -> np.ndarray:
    """Whether each word has a letter."""
    return np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all character trigrams (with word ends) of the words, where each word's begin, and
    the bucket of each whole word."""
    joined = "\x02" + "\x02".join(words) + "\x02"
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (c[:-2] * _M1) ^ (c[1:-1] * _M2) ^ (c[2:] * _M3)
    h ^= h >> np.uint64(29)
    inner = c[1:-1] != 2
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    letters = c[1:-1][inner]
    place = np.arange(len(letters), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    whole = np.add.reduceat((letters + np.uint64(7)) * _M3 ^ (place + np.uint64(1)) * _M2, starts) * _M1
    bucket = lambda x: ((x * _M1) >> np.uint64(48)).astype(np.int64)
    return bucket(h[inner]), starts, bucket(whole ^ (whole >> np.uint64(31)))


def script_of(words: list[str]) -> np.ndarray:
    """Script range of each word's first letter."""
    s = np.searchsorted(SCRIPT_STARTS, np.fromiter((ord(w[0]) for w in words), np.int64, len(words)), side="right") - 1
    return np.where(s == len(SCRIPT_STARTS) - 1, 0, s)


def viterbi(score: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of each word; ``score`` holds the words of all texts one after another. All texts
    advance together, longest first, so a step works on those that still have words."""
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    back, path = np.zeros(score.shape, np.int16), np.zeros(len(score), np.int16)
    now = np.zeros((len(lengths), score.shape[1]))
    own = np.arange(score.shape[1], dtype=np.int16)
    for t, k in enumerate(active):
        at = begin[:k] + t
        if t:
            prev = now[:k]
            arg = prev.argmax(1)
            jump = prev[np.arange(k), arg] - penalty
            stay = prev >= jump[:, None]
            back[at] = np.where(stay, own, arg[:, None])
            now[:k] = np.where(stay, prev, jump[:, None])
        now[:k] += score[at]
    state = now.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        path[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return path


def label(texts: list[str | None], model: dict, penalty: float = SWITCH) -> list[tuple[str, float, list]]:
    """(language, score, spans) of each text; a span is (first word, number of words, language)."""
    langs = model["langs"]
    found = [_WORD.findall(t.lower()) if t and langs else [] for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    out: list[tuple[str, float, list]] = [("und", 0.0, [])] * len(texts)
    codes, distinct = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    rows = np.repeat(np.arange(len(texts)), lengths)
    keep = lettered(distinct)
    if not keep.all():
        at = keep[codes]
        codes, rows = (np.cumsum(keep) - 1)[codes[at]], rows[at]
        distinct, lengths = distinct[keep], np.bincount(rows, minlength=len(texts))
    if not len(codes):
        return out
    distinct = list(distinct)
    g, starts, whole = grams(distinct)
    s = np.add.reduceat(model["gram"][g], starts, axis=0) + model["word"][whole]
    allowed = model["scripts"][script_of(distinct)]
    s = np.where(allowed | ~allowed.any(1)[:, None], s, -1e4)
    letters = np.fromiter(map(len, distinct), np.int64, len(distinct))[codes]
    path = viterbi(s[codes], lengths, penalty)
    share = np.bincount(rows * len(langs) + path, letters, len(texts) * len(langs)).reshape(len(texts), -1)
    total = share.sum(1)
    best = share.argmax(1)
    change = np.r_[True, (path[1:] != path[:-1]) | (rows[1:] != rows[:-1])]
    first = np.flatnonzero(change)
    size = np.diff(np.r_[first, len(path)])
    begin = np.cumsum(lengths) - lengths
    spans: dict[int, list] = {}
    for a, n in zip(first.tolist(), size.tolist()):
        r = int(rows[a])
        spans.setdefault(r, []).append((a - int(begin[r]), n, langs[path[a]]))
    for i in np.flatnonzero(total):
        out[i] = (langs[best[i]], float(share[i, best[i]] / total[i]), spans.get(int(i), []))
    return out


def chunks(texts: list[str | None], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fit(sample: DataFrame, text: str, lang: str) -> dict:
    """Log odds of trigram and word buckets for each language, against the mean of all.

    Counted on the executors; the driver gets a row for each language and bucket that occurs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = _WORD.findall(t.lower()) if t else []
                words = [w for w, ok in zip(words, lettered(words).tolist()) if ok]
                if words:
                    g, _, whole = grams(words)
                    x = sums.setdefault(name, np.zeros((2, BUCKETS)))
                    x[0] += np.bincount(g, minlength=BUCKETS)
                    x[1] += np.bincount(whole, minlength=BUCKETS)
                    y = scripts.setdefault(name, np.zeros(len(SCRIPT_STARTS)))
                    y += np.bincount(script_of(words), minlength=len(SCRIPT_STARTS))
        for name, x in sums.items():
            for kind, v in ((0, x[0]), (1, x[1]), (2, scripts[name])):
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "kind": pa.array([kind] * len(at), pa.int32()), "bucket": pa.array(at, pa.int64()), "n": pa.array(v[at], pa.float64())})

    counted = sample.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(count, "lang string, kind int, bucket long, n double")
    found = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    code = {x: i for i, x in enumerate(langs)}
    tables = [np.zeros((BUCKETS if kind < 2 else len(SCRIPT_STARTS), len(langs))) for kind in range(3)]
    for kind in range(3):
        f = found[found["kind"] == kind]
        tables[kind][f["bucket"].to_numpy(int), f["lang"].map(code).to_numpy(int)] = f["n"].to_numpy()
    logs = []
    for x in tables[:2]:
        p = np.log((x + 0.3) / (x.sum(0) + 0.3 * BUCKETS)) if len(langs) else x
        logs.append((p - p.mean(1, keepdims=True)).astype(np.float32) if len(langs) else p)
    shares = tables[2] / np.maximum(1, tables[2].sum(0))
    return {"langs": langs, "gram": logs[0], "word": logs[1], "scripts": shares >= 0.01}


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held: tuple[int, int] = (4, 2), per_language: int = PER_LANGUAGE, penalty: float = SWITCH) -> DataFrame:
    """``key``, held_out, lang_pred, score, spans for every whole text.

    Learns from rows whose crc32(key as text) modulo held[0] is not held[1]. ``score`` is the share
    of the text's letters in spans of the predicted language.
    """
    spark = docs.sparkSession
    sample, _ = _sample.sampled_rows(docs.where(_sample.remainder(F.col(key), held[0]) != held[1]), key, text, lang, per_language)
    model = spark.sparkContext.broadcast(fit(sample, "text", lang))

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # a word has a number for each language
        chars = CHUNK_CHARS * 8 // max(8, len(model.value["langs"]))
        for series in batches:
            texts, out = series.tolist(), []
            for a, b in chunks(texts, chars):
                out += label(texts[a:b], model.value, penalty)
            yield pd.DataFrame({"lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "spans": [[{"start": s, "words": n, "lang": v} for s, n, v in x[2]] for x in out]})
            trim()

    d = docs.select(F.col(key), F.col(text).alias("t")).select(key, (_sample.remainder(F.col(key), held[0]) == held[1]).alias("held_out"), labelled("t").alias("r"))
    return d.select(key, "held_out", "r.lang_pred", "r.score", "r.spans")
