"""Scores texts by a causal self-attention model over subword ids, beside a smoothed count of words.

What is learned comes from all training texts (those whose key has no remainder of 0 by ``HELD``):

1. Words are counted by Spark, in tasks first. The counts give the base score.
2. Every distinct word is encoded once by a public subword vocabulary; the counts of subwords and of pairs of them in words, and of first
   and last subwords, make the model's vocabulary and its bigram tables (``attention.Tables``).
3. The network is trained in ``ROUNDS`` rounds on windows of all training texts: a task takes one pass of Adam over its windows from the common
   weights, and Spark adds the changes up, weighed by windows, in whole numbers. Texts are cut at white space into pieces of about ``PIECE`` bytes, and
   the key and the place of a piece say in which round it is trained on: each subword once, or in up to ``PASSES`` passes
   if there are fewer than ``FLOOR``.
4. Texts are scored whole, in overlapping windows, each token once. In the same pass the words that are not among the ``HOT`` commonest
   are listed; their counts come by a join, which thus has no hot words of the training texts.

The probability of a text is that of its words, each with one blank before it, and of the end; a subword outside the model's vocabulary counts
as ``OTHER`` times its share of these, so the probabilities of all sequences of subwords add up to one.

Defined results for odd input: null and empty texts, and texts of white space, have one token (the end); a null key counts as empty text; rows that
share a key are scored each; very long texts are scored whole, in pieces that keep their context, and words beyond ``LONG_WORD`` characters are encoded in parts
of that size; without training texts the base has no counts and the model is even; equal counts: the smaller id or
word first; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _sample, attention
from graphloom.llm._memory import trim
from graphloom.llm.attention import END, OTHER, STEP, VOCAB
from graphloom.session import discard, materialize

HELD, SMOOTH = 10, 0.1
#: Words whose counts and subwords are sent to every task; rarer ones are joined. Distinct words that a task holds, about, before it passes counts on.
HOT, COUNTED = 200_000, 400_000
ROUNDS, PASSES, FLOOR, PIECE = 8, 4, 4_000_000, 1024
#: Learning rate of the first round; it falls to a twelfth.
SPEED = 0.01
#: Bytes of text that are counted, and looked up, at once; subwords that are scored at once. Longer texts are worked on in parts of these sizes.
SLAB, SCORED, CHUNK = 16_000_000, 1_000_000, 120_000
#: Subwords of a row of windows, about.
ROW = 4096
LONG_WORD = 1000
_FINE = 1 << 20


def model_file(name: str = "piece_bpe_32k.model") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Subword ids of words, each as if a blank stood before it."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = self.model.get_piece_size()

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(subwords of all words in a row, how many of each)."""
        texts = [w.decode("utf-8", "replace") for w in words]
        out = self.model.encode(texts, num_threads=1)
        if max(map(len, texts), default=0) > LONG_WORD:
            for i, t in enumerate(texts):
                if len(t) > LONG_WORD:
                    out[i] = [x for j in range(0, len(t), LONG_WORD) for x in self.model.encode(t[j : j + LONG_WORD])]
        if not all(out):
            out = [x or [self.model.unk_id()] for x in out]
        lens = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int64, int(lens.sum())), lens


def parts(b: bytes, size: int) -> list[bytes]:
    """The text in parts of about ``size`` bytes, cut at white space."""
    out, lo = [], 0
    while len(b) - lo > size:
        hi = lo + size
        while hi < len(b) and b[hi] not in b" \t\n\r\x0b\x0c":
            hi += 1
        out.append(b[lo:hi])
        lo = hi
    return [*out, b[lo:]]


def _strings(texts: list[bytes]) -> pa.StringArray:
    """Bytes as strings, not looked into: parts may begin or end within a character."""
    held = pa.array(texts, pa.binary())
    return pa.StringArray.from_buffers(len(held), held.buffers()[1], held.buffers()[2])


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in a row, ASCII capitals made small; how many of each text). White space is what ASCII has of it."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, n = lists.flatten(), np.diff(np.asarray(lists.offsets))
    empty = np.asarray(pc.equal(pc.binary_length(words), 0))
    if empty.any():  # before leading and behind trailing white space
        n = n - np.bincount(np.repeat(np.arange(len(n)), n)[empty], minlength=len(n))
        words = words.filter(pa.array(~empty))
    return words, n


def _sums(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n values each; a run's sum does not depend on what is before it."""
    out, some = np.zeros(len(n), v.dtype if v.dtype.kind == "f" else np.int64), n > 0
    if some.any():
        out[some] = np.add.reduceat(v, (np.cumsum(n) - n)[some], dtype=out.dtype)
    return out


def pieces_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(rows, last part or not, texts): runs of rows of about ``size`` bytes together, or one part of a longer text."""
    texts = batch.column("text")
    long = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    lo = 0
    while lo < len(long):
        if long[lo] > size:
            cut = parts(texts[lo].as_py().encode("utf-8", "surrogatepass"), size)
            for k, part in enumerate(cut):
                yield np.array([lo]), np.array([k + 1 == len(cut)]), _strings([part])
            lo += 1
            continue
        ends = np.cumsum(long[lo:])
        hi = lo + max(1, int(np.searchsorted(ends, size, side="right")))
        over = np.flatnonzero(long[lo:hi] > size)
        hi = lo + int(over[0]) if len(over) else hi
        yield np.arange(lo, hi), np.ones(hi - lo, bool), texts.slice(lo, hi - lo)
        lo = hi


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of (text string), ASCII capitals made small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in batches:
            for _, _, part in pieces_of(b, SLAB):
                found = pc.value_counts(split(part)[0])
                held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                if sum(t.num_rows for t in held) > 4 * COUNTED:
                    held = [summed()]
                    if held[0].num_rows > COUNTED:
                        yield from held[0].cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()
                        held = []
        if held:
            yield from summed().cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches()
        held.clear()
        trim()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_pairs(words: DataFrame, proto: bytes) -> DataFrame:
    """(a, b, n): how often subword b follows a inside words of (word, n); -1 is the edge of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(proto)
        size = encode.size + 1
        for batch in batches:
            ids, lens = encode(batch.column("word").cast(pa.binary()).to_pylist())
            n, lens = np.asarray(batch.column("n")), lens + 1
            if not len(lens):
                continue
            ends = np.cumsum(lens)
            b = np.zeros(ends[-1], np.int64)
            inner = np.ones(len(b), bool)
            inner[ends - 1] = False
            b[inner] = ids + 1
            a = np.r_[0, b[:-1]]
            pair, at = np.unique(a * size + b, return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, at, np.repeat(n, lens))
            yield pa.RecordBatch.from_pydict({"a": pa.array(pair // size - 1, pa.int32()), "b": pa.array(pair % size - 1, pa.int32()), "n": pa.array(total)})

    return words.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _hot(words, proto: bytes) -> dict:
    """Words with their counts and subwords, encoded once for all tasks."""
    ids, lens = Encoder(proto)([w.encode("utf-8", "replace") for w in words["word"]])
    return {"words": pa.array(words["word"].tolist(), pa.string()), "n": words["n"].to_numpy(np.float64), "ids": ids.astype(np.int32), "lens": lens}


class Corpus:
    """What the counts of the training texts give: bounded by the vocabularies."""

    def __init__(self, words: DataFrame, texts: int, proto: bytes):
        spark = words.sparkSession
        self.texts = texts
        total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.tokens, self.distinct = total + texts, distinct + (texts > 0)
        self.below = math.log10(self.tokens + SMOOTH * (self.distinct + 1))
        # the hot words: all from a count on, so that ties do not matter
        have, least = 0, None
        for n, k in sorted(((r["n"], r["k"]) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).toLocalIterator()), reverse=True):
            if have + k > HOT:
                break
            have, least = have + k, n
        self.least = least if least is not None else 1 << 62
        self.hot = words.where(F.col("n") >= self.least).toPandas()
        pairs = materialize(count_pairs(words, proto), "pairs")
        size = Encoder(proto).size
        self.id_counts = np.zeros(size, np.int64)
        for r in pairs.where("b >= 0").groupBy("b").agg(F.sum("n").alias("n")).collect():
            self.id_counts[r["b"]] = r["n"]
        common = [int(i) for i in np.argsort(-self.id_counts, kind="stable")[: VOCAB - 2] if self.id_counts[i]]
        self.own = np.full(size, OTHER, np.int32)
        self.own[common] = np.arange(2, 2 + len(common))
        rest = self.own == OTHER
        #: Logarithm of an id's share of ``OTHER``.
        self.share = np.where(rest, np.log((self.id_counts + SMOOTH) / (self.id_counts[rest].sum() + SMOOTH * max(1, rest.sum()))), 0.0)
        number = spark.createDataFrame([(-1, -1)] + [(i, int(self.own[i])) for i in common], "id int, own int")
        named = pairs
        for c in ("a", "b"):
            named = named.join(F.broadcast(number.select(F.col("id").alias(c), F.col("own").alias(f"{c}_own"))), c, "left")
        table = named.groupBy(F.coalesce("a_own", F.lit(OTHER)).alias("a"), F.coalesce("b_own", F.lit(OTHER)).alias("b")).agg(F.sum("n").alias("n")).toPandas()
        discard(pairs)
        within, first, last = np.zeros((VOCAB, VOCAB)), np.zeros(VOCAB), np.zeros(VOCAB)
        a, b, n = (table[c].to_numpy(np.int64) for c in ("a", "b", "n"))
        both, begin, end = (a >= 0) & (b >= 0), (a < 0) & (b >= 0), (a >= 0) & (b < 0)
        within[a[both], b[both]] = n[both]
        first[b[begin]], last[a[end]] = n[begin], n[end]
        first[END] += texts
        self.tables = attention.Tables(within, first, last)
        self.subwords = int(self.id_counts.sum()) + texts


class Vocabulary:
    """The subwords of words: of hot words from the corpus, of others encoded where they come up."""

    def __init__(self, corpus: dict, proto: bytes):
        self.c, self.encode = corpus, Encoder(proto)
        hot = corpus["hot"]
        self.words, self.size = hot["words"], len(hot["words"])
        self.hot = self._arrays(hot["ids"], hot["lens"])
        self.base = np.r_[np.log10(hot["n"] + SMOOTH) - corpus["below"], 0.0]

    def _arrays(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the model, subwords of each word, logarithm of its shares)."""
        ends = np.cumsum(lens)
        return self.c["number"][ids].astype(np.int32), lens, np.add.reduceat(self.c["share"][ids], ends - lens) if len(lens) else np.zeros(0)

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of words in a row: (place among the hot words or -1; subwords in a row; how many of each; logarithms of shares; the words that are not hot)."""
        at = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)
        rare = words.filter(pa.array(at < 0))
        coded = rare.dictionary_encode()
        own = self._arrays(*self.encode(coded.dictionary.cast(pa.binary()).to_pylist()))
        flat, lens, extra = (np.concatenate([a, b]) for a, b in zip(self.hot, own))
        number = at.copy()
        number[at < 0] = self.size + np.asarray(coded.indices, np.int64)
        begin = np.cumsum(lens) - lens
        n = lens[number]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[number] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return at, ids, n, extra[number], rare


class _Sequence:
    """A text on its way: the block before, the subword before, and subwords that do not fill a block yet."""

    def __init__(self, end: int):
        self.end, self.prev = end, end
        self.lead = self.left = np.zeros(0, np.int32)

    def feed(self, ids: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, targets) of whole blocks, or of all that is left; targets of the block before are -1."""
        t = np.concatenate([self.left, ids, [self.end]] if last else [self.left, ids]).astype(np.int32)
        x = np.concatenate([[self.prev], t[:-1]]).astype(np.int32)
        n = len(t) if last else len(t) // STEP * STEP
        out = np.concatenate([self.lead, x[:n]]), np.concatenate([np.full(len(self.lead), -1, np.int32), t[:n]])
        if n and not last:
            self.prev, self.lead, self.left = int(t[n - 1]), x[n - STEP : n], t[n:]
        elif not last:
            self.left = t
        return out


def training_windows(texts: DataFrame, corpus, proto: bytes) -> DataFrame:
    """(slot, inputs, targets, sizes) of all of (key, text), in pieces cut at white space; a piece goes to one of ``ROUNDS`` slots by its key and place.
    Every subword and every end is the target of one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(corpus.value, proto)
        end = corpus.value["end"]
        held: dict[int, list] = {}
        drawn: list[tuple] = []
        before = end

        def encode() -> None:
            """The windows' inputs and targets of the drawn (slot, piece, last), which are in the order of their texts."""
            nonlocal before
            words, size = split(_strings([d[1] for d in drawn]))
            _, ids, n, _, _ = vocabulary.look(words)
            at = np.r_[0, np.cumsum(n)]
            hi = np.cumsum(size)
            for (slot, _, last), a, b in zip(drawn, hi - size, hi):
                t = ids[at[a] : at[b]]
                t = np.concatenate([t, [end]]) if last else t
                if len(t):
                    held.setdefault(slot, []).append((np.concatenate([[before], t[:-1]]), t))
                    # the end of a text is what is before the next one
                    before = t[-1]
            drawn.clear()

        def full(slot: int) -> pa.RecordBatch:
            """A row for about ``ROW`` subwords: the writer looks at its memory every hundred rows only, and packs what is large in buffers outside the heap."""
            own = held.pop(slot)
            size = np.array([len(s[0]) for s in own], np.int32)
            row = (np.cumsum(size, dtype=np.int64) - size) // ROW
            cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(own)]
            x, y = ([np.concatenate([s[i] for s in own[lo:hi]]).astype(np.int16).tobytes() for lo, hi in zip(cuts, cuts[1:])] for i in (0, 1))
            sizes = [size[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_pydict({"slot": pa.array([slot] * len(x), pa.int32()), "inputs": pa.array(x, pa.binary()), "targets": pa.array(y, pa.binary()), "sizes": pa.array(sizes, pa.binary())})

        for b in batches:
            for i, key in enumerate(b.column("key").to_pylist()):
                text = b.column("text")[i]
                pieces = parts(bytes(memoryview(text.as_buffer())) if text.is_valid else b"", PIECE)
                for k, piece in enumerate(pieces):
                    drawn.append((zlib.crc32(b"%b:%d" % ((key or "").encode(), k)) % ROUNDS, piece, k + 1 == len(pieces)))
                    if len(drawn) >= 1024:
                        encode()
                        for slot in [s for s in held if len(held[s]) >= 256]:
                            yield full(slot)
        if drawn:
            encode()
        for slot in list(held):
            yield full(slot)
        trim()

    return texts.select("key", "text").mapInArrow(run, "slot int, inputs binary, targets binary, sizes binary")


def fit(train: DataFrame, corpus: Corpus, shared, proto: bytes) -> dict:
    """The network's weights, after ``ROUNDS`` rounds over the windows of (key, text)."""
    spark = train.sparkSession
    weights = attention.flat(attention.start()).astype(np.float64)
    if not corpus.tokens:
        return attention.shaped(weights)
    passes = min(PASSES, max(1, -(-FLOOR // corpus.subwords)))
    drawn = training_windows(train, shared, proto)
    least = spark.sparkContext.defaultParallelism
    rows = materialize(drawn.repartition(least) if corpus.subwords < 2 * FLOOR else drawn, "windows")
    passes = min(ROUNDS, passes * 2 if passes > 1 else 1)
    for r in range(ROUNDS):
        now, rate = attention.shaped(weights), SPEED * 12.0 ** (-r / (ROUNDS - 1))

        def run(batches: Iterator[pa.RecordBatch], now=now, rate=rate, r=r) -> Iterator[pa.RecordBatch]:
            x, y = [], []
            for b in batches:
                for i, t, s in zip(*(b.column(c).to_pylist() for c in ("inputs", "targets", "sizes"))):
                    one = attention.windows(np.frombuffer(i, np.int16).astype(np.int32), np.frombuffer(t, np.int16).astype(np.int32), np.frombuffer(s, np.int32).astype(np.int64))
                    x.append(one[0].astype(np.int16))
                    y.append(one[1].astype(np.int16))
            if not x:
                return
            x, y = np.concatenate(x), np.concatenate(y)
            new, _, _ = attention.train(now, shared.value["tables"], x.astype(np.int32), y.astype(np.int32), rate, seed=r)
            change = np.rint((attention.flat(new).astype(np.float64) - attention.flat(now)) * _FINE).astype(np.int64) * len(x)
            trim()
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(change) + 1), pa.int32()), "value": pa.array(np.r_[change, len(x)])})

        part = rows.where((F.col("slot") + r) % ROUNDS < passes).select("inputs", "targets", "sizes")
        got = part.mapInArrow(run, "place int, value long").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        if len(got):
            value = np.zeros(len(weights) + 1)
            value[got["place"].to_numpy()] = got["value"].to_numpy()
            weights = attention.flat(now).astype(np.float64) + value[:-1] / value[-1] / _FINE
    discard(rows)
    return attention.shaped(weights)


def _score_texts(texts: DataFrame, shared, proto: bytes) -> DataFrame:
    """(row, key, held_out, n_tokens, n_hot, base, score, cold): the words that are not hot are listed in ``cold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        vocabulary, scorer, end = Vocabulary(c, proto), attention.Scorer(c["weights"], c["tables"]), c["end"]

        def work(words: pa.Array, size: np.ndarray, sequences: list, last: np.ndarray) -> tuple:
            """(words, hot ones, base, score) of each text, and the words that are not hot with their numbers by text."""
            at, ids, n, extra, rare = vocabulary.look(words)
            ends, hot = np.r_[0, np.cumsum(size)], at >= 0
            sums = lambda v: _sums(v, size)
            tok = np.r_[0, np.cumsum(n)][ends]
            score = sums(extra)
            fed = [s.feed(ids[tok[i] : tok[i + 1]], bool(last[i])) for i, s in enumerate(sequences)]
            lo = 0
            while lo < len(fed):
                # as many texts as have about CHUNK subwords, at least one
                hi, held = lo, 0
                while hi < len(fed) and (held == 0 or held + len(fed[hi][0]) <= CHUNK):
                    held += len(fed[hi][0])
                    hi += 1
                x, y = (np.concatenate([f[k] for f in fed[lo:hi]]) for k in (0, 1))
                got = scorer.score(x, y, np.array([len(f[0]) for f in fed[lo:hi]], np.int64))
                score[lo:hi] += _sums(got, np.array([int((f[1] >= 0).sum()) for f in fed[lo:hi]], np.int64))
                lo = hi
            return size + last, sums(hot), sums(vocabulary.base[at]), score, rare, sums(~hot)

        for b in batches:
            total = [np.zeros(b.num_rows, k) for k in (np.int64, np.int64, np.float64, np.float64, np.int64)]
            cold, open_ = [], {}
            for rows, last, part in pieces_of(b, SCORED):
                words, size = split(part)
                sequences = [open_.setdefault(int(i), _Sequence(end)) for i in rows]
                *found, rare, many = work(words, size, sequences, last)
                for t, v in zip(total, [*found, many]):
                    t[rows] += v.astype(t.dtype)
                cold.append(rare)
                for i in rows[last]:
                    del open_[int(i)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(total[4])], pa.int32()), pa.concat_arrays(cold) if cold else pa.array([], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in ("row", "doc", "held_out")] + [pa.array(t) for t in total[:4]] + [lists], names=["row", "doc", "held_out", "n_tokens", "n_hot", "base", "score", "cold"])
        trim()

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.select("row", "doc", "held_out", "text").mapInArrow(run, f"row long, doc {kind}, held_out boolean, n_tokens long, n_hot long, base double, score double, cold array<string>")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are logarithms to base 10."""
    spark = docs.sparkSession
    with open(vocabulary or model_file(), "rb") as f:
        proto = f.read()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), (_sample.remainder(F.col(key), HELD) == 0).alias("held_out"), F.col(text).cast("string").alias("text"))
    train = texts.where("not held_out")
    words = materialize(count_words(train), "words")
    corpus = Corpus(words, train.count(), proto)
    sent = {"hot": _hot(corpus.hot, proto), "below": corpus.below, "share": corpus.share, "number": corpus.tables.number[corpus.own], "end": int(corpus.tables.number[END]), "tables": corpus.tables}
    shared = spark.sparkContext.broadcast(sent)
    weights = fit(train, corpus, shared, proto)
    shared.unpersist()
    shared = spark.sparkContext.broadcast(sent | {"weights": weights})
    scored = materialize(_score_texts(texts, shared, proto), "scored")
    base = lambda n: F.log10(n + SMOOTH) - corpus.below
    cold = scored.select("row", F.explode("cold").alias("word")).join(words.where(F.col("n") < corpus.least), "word", "left")
    cold = cold.groupBy("row").agg(F.sum(base(F.coalesce("n", F.lit(0)))).alias("cold_base"), F.count("n").alias("cold_known"))
    out = scored.drop("cold").join(cold, "row", "left")
    return out.select(
        F.col("doc").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("cold_known", F.lit(0)) + int(corpus.texts > 0)).cast("long").alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("cold_base", F.lit(0.0)) + base(F.lit(corpus.texts))).alias("base_score"),
        (F.col("score") / math.log(10)).alias("score"),
    )
