"""Spelling variants by two-dimensional range reporting.

Two words are near if one edit (a replaced, inserted or deleted code point) turns one into the other. A word t of length L stands
at a point: its rank among the words in forward order, and its rank among the words read backwards. For an edit at position i,
the words that agree with the query before i are an interval in forward order, and those that agree behind i one in reverse
order; the words in both are those of a rectangle, which a wavelet tree over the reverse ranks reports in the logarithm of
the words for each. Replacements ask for words of the same length, insertions for words longer by one; deletions are
insertions read from the other side. An insertion into a run of equal letters counts at the run's end only, so a pair is
found once.

Spark deals the work: with h = L // 2, an edit before h leaves the last L - h code points of t as they are, one from h on the
first h. So each word goes to two places as a point (by its head and its tail) and to two as a query for words longer by one;
places are buckets by length and hash of head or tail, sized to ``POINTS`` words. A head or tail shared by more words than
that is hot: its points are dealt to several trees, and its queries go to each of these. No list of a group's pairs
is made, only pairs of near words.

Words: maximal runs of letters, ASCII capitals made small, and ``spoil`` may drop a code point of one run in 97 (a corpus has
typing errors of its own; the query plants more by a fixed rule so that there is something to find).

Defined results for odd input: null texts and texts without letters have no words; a null doc_id counts as empty text; very
long texts and words are worked on whole; repeated rows count again; words of equal number: the smallest in code-point
order is the form; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm._memory import trim
from graphloom.session import discard, materialize

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT, SPOILED = 5, 3, 97
#: Words of a wavelet tree, and code points of its words, about.
POINTS, POINT_CHARS = 10_000, 400_000
_HEAD, _TAIL = 0, 1
_POINT, _QUERY = 0, 1


class WaveletTree:
    """Reports which places of an interval hold a value of an interval, for many rectangles at once. ``values`` are a permutation."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        v = np.asarray(values, np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (v >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of every value in [low, high) at a place in [lo, hi): the tree is walked level by level for all queries."""
        query = np.flatnonzero((lo < hi) & (low < high))
        lo, hi, base = lo[query], hi[query], np.zeros(len(query), np.int64)
        for k in range(self.bits):
            width = 1 << (self.bits - 1 - k)
            one_lo, one_hi = self.ones[k][lo], self.ones[k][hi]
            zero = (lo - one_lo, hi - one_hi, base)
            one = (self.zeros[k] + one_lo, self.zeros[k] + one_hi, base + width)
            lo, hi, base = (np.concatenate([a, b]) for a, b in zip(zero, one))
            query = np.concatenate([query, query])
            keep = (lo < hi) & (base < high[query]) & (base + width > low[query])
            query, lo, hi, base = query[keep], lo[keep], hi[keep], base[keep]
        return query, base


def letters(words: list[str], width: int) -> np.ndarray:
    """(words, width) code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), width).astype(np.int64)


def _narrow(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each [lo, hi) whose ``column`` is ``want``; the column is sorted within each."""

    def bound(strict: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = a < b
            if not open_.any():
                return a
            mid = (a + b) >> 1
            v = column[np.minimum(mid, len(column) - 1)]
            right = open_ & ((v <= want) if strict else (v < want))
            a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)

    return bound(False), bound(True)


def _intervals(sorted_letters: np.ndarray, asked: np.ndarray, least: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from ``least`` to ``most``: the interval of sorted words that begin with the asked words' prefix of that length."""
    lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), len(sorted_letters), np.int64)
    out = []
    for n in range(most + 1):
        if n >= least:
            out.append((lo, hi))
        if n < most:
            lo, hi = _narrow(sorted_letters[:, n], lo, hi, asked[:, n])
    return out


def near(points: list[str], same: list[str], shorter: list[str], length: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Near words among ``points`` of ``length`` code points, for edits behind (``_HEAD``) or before (``_TAIL``) the middle:
    (query in ``same``, point) of replacements, and (query in ``shorter``, point) of insertions."""
    x = letters(points, length)
    forward = np.lexsort(x.T[::-1])
    backward = np.lexsort(x.T)
    rank = np.empty(len(x), np.int64)
    rank[backward] = np.arange(len(x))
    tree = WaveletTree(rank[forward])
    ahead, behind = x[forward], x[backward][:, ::-1]
    half = length // 2
    first, last = (half, length - 1) if kind == _HEAD else (0, half - 1)
    out = []
    for words, extra in ((same, 0), (shorter, 1)):
        pairs = [np.zeros((2, 0), np.int64)]
        if words and last >= first:
            q = letters(words, length - extra)
            starts = _intervals(ahead, q, first, last)
            # behind position i of the point stand length - 1 - i code points
            ends = _intervals(behind, q[:, ::-1], length - 1 - last, length - 1 - first)
            for i in range(first, last + 1):
                (lo, hi), (low, high) = starts[i - first], ends[last - i]
                who, at = tree.report(lo, hi, low, high)
                point = backward[at]
                if extra:  # the last place of a run of equal letters stands for all
                    fits = q[who, i] != x[point, i] if i < length - 1 else np.ones(len(who), bool)
                else:
                    fits = q[who, i] != x[point, i]
                pairs.append(np.stack([who[fits], point[fits]]))
        out.extend(np.concatenate(pairs, axis=1))
    return tuple(out)


def _search(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs (a, b) of one bucket: both ways of each near pair that it finds."""
    kind, length = key[0].as_py(), key[1].as_py()
    role, words, own = np.asarray(table.column("role")), np.asarray(table.column("word"), object), np.asarray(table.column("own"))
    size = np.array([len(w) for w in words.tolist()], np.int64)
    points = words[(role == _POINT) & own]
    if not len(points):
        return pa.table({"word": pa.array([], pa.string()), "other": pa.array([], pa.string())})
    same, shorter = words[(role == _POINT) & (size == length)], words[role == _QUERY]
    a, b, c, d = near(points.tolist(), same.tolist(), shorter.tolist(), length, kind)
    left, right = np.concatenate([same[a], shorter[c], points[d]]), np.concatenate([points[b], points[d], shorter[c]])
    trim()
    return pa.table({"word": pa.array(left, pa.string()), "other": pa.array(right, pa.string())})


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other): every ordered pair of near words among the distinct ones of ``words``, once."""
    d = words.select("word").withColumn("size", F.length("word"))
    half = lambda n: F.floor(n / 2).cast("int")

    def place(kind: int, role: int) -> DataFrame:
        n = F.col("size") + (1 if role == _QUERY else 0)
        part = F.substring("word", F.lit(1), half(n)) if kind == _HEAD else F.substring("word", half(n) + (0 if role == _QUERY else 1), n - half(n))
        return d.select(F.lit(kind).alias("kind"), n.alias("length"), part.alias("part"), F.lit(role).alias("role"), "word")

    rows = place(_HEAD, _POINT).unionAll(place(_TAIL, _POINT)).unionAll(place(_HEAD, _QUERY)).unionAll(place(_TAIL, _QUERY))
    # sizes of buckets: a row for each length of words
    sizes = {r["size"]: r["n"] for r in d.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = {n: max(1, -(-count // POINTS), -(-count * n // POINT_CHARS)) for n, count in sizes.items()}
    if not buckets:
        return rows.select("word", F.col("part").alias("other")).limit(0)
    rows = rows.where(F.col("length").isin(list(buckets)))
    count = F.create_map(*[F.lit(x) for n, b in buckets.items() for x in (n, b)])
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("part"), F.try_element_at(count, F.col("length"))).cast("int"))
    # hot heads and tails: as many as fill a tree, so at most two for each POINTS words; they are broadcast
    hot = rows.where(F.col("role") == _POINT).groupBy("kind", "length", "part").agg(F.count(F.lit(1)).alias("n"))
    hot = hot.select("kind", "length", "part", F.ceil(F.greatest(F.col("n") / POINTS, F.col("n") * F.col("length") / POINT_CHARS)).cast("int").alias("trees")).where("trees > 1")
    rows = rows.join(F.broadcast(hot), ["kind", "length", "part"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("trees")).cast("int")
    dealt = rows.select("kind", "length", "bucket", F.when(F.col("trees") > 1, F.xxhash64("part")).otherwise(F.lit(0)).alias("group"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), own.alias("home"), "role", "word")
    dealt = dealt.withColumn("own", F.col("tree") == F.col("home")).drop("home")
    return dealt.groupBy("kind", "length", "bucket", "group", "tree").applyInArrow(_search, "word string, other string")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spoil(key: Column, run: Column) -> Column:
    """The run, without one code point if 97 divides the crc32 of key and run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SPOILED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", spoiled: bool = True) -> DataFrame:
    """(word, n) of words long and frequent enough. Runs of a text are counted by task before the shuffle."""
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(RUN), 0)).alias("run"))
    words = runs.select((spoil(F.col("key"), F.col("run")) if spoiled else F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of forms of every word that has a form (word, form). Chains are halved each round;
    their length is at most the logarithm of the largest count, as counts double along them."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(at.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        more = not step.where("moved").isEmpty()
        discard(at)
        at = step
        if not more:
            return at.select("word", "root")


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n): the form is the near word of largest n, if that is at least twice the word's."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words)
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = pairs.join(other, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best"))
    d = words.join(best, "word", "left")
    takes = -F.col("best.m") >= 2 * F.col("n")
    d = materialize(d.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(d.where("form is not null"))
    return d.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
