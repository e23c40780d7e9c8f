"""The training-data operators against brute force, and on odd input."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import _components, embedding_dedup, fingerprint, language, mixing, near_dedup, quality, segmentation, token_counts, toxicity, url_filter
from graphloom.llm._shingles import shingle_sets
from graphloom.session import materialize

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; a table may have them too.
CLASHING = ["key_", "k", "t", "s", "x", "r", "r_", "size", "node", "doc", "score", "label", "rule", "text_", "block", "canonical", "cell", "ghost"]
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, columns with clashing names."""
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [
        (1, "The cat sat on the mat.\nIt was happy there all day long.", "en", "a", 5),
        (1, "The cat sat on the mat.\nIt was happy there all day long.", "en", "a", 5),
        (2, None, None, None, None),
        (None, "no key here at all my friend", "en", "b", 3),
        (3, "", "fr", "", 0),
        (4, long, "en", "a", len(long)),
        (5, long + " end", "en", "b", len(long) + 4),
        (6, " \t\n ", "de", "b", 4),
        (7, "日本 ▁x é\n\n  two  spaces ", "en", "é", 10),
        (8, "Short.", "en", "b", 6),
    ]
    d = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        d = d.withColumn(c, F.lit("clash"))
    return d


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(spark, n=120, seed=5):
    """Texts of two vocabularies, with insults in some and junk in some; labels for all."""
    rng = random.Random(seed)
    en, de = ["the", "house", "walks", "river", "under", "green", "stone", "happy"], ["der", "hauses", "läuft", "fluss", "unter", "grüne", "steins", "froh"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(de if i % 3 == 0 else en) for _ in range(rng.randint(20, 60))]
        toxic, poor = i % 5 == 1, i % 7 == 2
        if toxic:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "trash"]))
        if poor:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "de" if i % 3 == 0 else "en", f"s{i % 4}", 0))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


# op1 ----------------------------------------------------------------------------------------------

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_urls(spark):
    urls = ["http://A.Example.ORG/en/12?x", "https://example.org/es/1", "https://badexample.org/es/1", "http://x.com/de/5#t", "http://x.com", "org/en/1", None, "http://?q", "http://www.b.net/p/?utm_a=1&id=2", "https://b.net/p?id=2#z", "http://b.net/p", "http://b.net/p"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([("b.net/p?id=2",), ("b.net/p?id=2",), (None,), ("",)], "canonical string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, listed, RULES).collect()}
    assert len(got) == len(urls)
    see = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"])
    assert see(0) == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert see(1) == ("example.org", "/es/1", "example.org/es/", "block")
    assert see(2) == ("badexample.org", "/es/1", "org/", "allow")
    assert see(3) == ("x.com", "/de/5", "com/de/", "block")
    assert see(4) == ("x.com", "", None, "allow") and see(5) == ("", "", None, "allow") == see(6) and see(7)[:2] == ("", "")
    assert see(8)[3] == see(9)[3] == "block" and see(10)[3] == see(11)[3] == "allow"
    none = url_filter.filter_urls(pages.limit(0), listed.limit(0), RULES)
    assert none.count() == 0 and url_filter.filter_urls(pages, listed.limit(0), []).where("verdict = 'block'").count() == 0


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(4000).select(F.concat(F.lit("site.net/"), F.col("id").cast("string")).alias("canonical"))
    pages = spark.range(12000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://site.net/"), F.col("id").cast("string")).alias("url"))
    r = url_filter.filter_urls(pages, listed, []).agg(F.count_if("listed").alias("listed"), F.count_if("bloom_hit").alias("hit"), F.count_if(F.col("listed") & ~F.col("bloom_hit")).alias("missed")).first()
    assert r["listed"] == 4000 and r["missed"] == 0 and r["hit"] < 4000 + 8000 * 0.01


# op2 ----------------------------------------------------------------------------------------------


def xx(t):
    """The engine's 64-bit hash of a string, signed."""
    import xxhash

    return int(np.uint64(xxhash.xxh64(t.encode(), seed=42).intdigest()).view(np.int64))


def cut_by_hash(items, one_in, between):
    return "".join(w + ("\n" if xx(w) % one_in == 0 else between) for w in items).split("\n")


def pieces(t):
    out = []
    for p in re.split(r"\n+|(?<=[.!?])[ \t]+", t or ""):
        for q in cut_by_hash(re.split(r"[ \t\n\x0b\f\r]+", p), 8, " ") if len(p) > 400 else [p]:
            out += cut_by_hash(q, 32, "") if len(q) > 1600 else [q]
    return {p for p in out if p}


def in_order(rows):
    """Rows (key, text) as the fingerprints follow each other."""
    return sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), xx(r[1]), r[1]))


def brute_fingerprints(rows):
    """(key, n_chars, edited_sha256, near_edited, near_next, edited_difference) of every row."""
    rows, out = in_order(rows), []
    near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i, (k, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), round(near(pieces(t), pieces(e)), 9), round(near(pieces(t), pieces(n)), 9), len(pieces(t) ^ pieces(e))))
    return sorted(out, key=str)


def see_fingerprints(d):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), r["edited_difference"]) for r in fingerprint.fingerprints(d).collect()), key=str)


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = ["\n".join(f"line {rng.randrange(400)} of it." for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(60)]
    texts += [" ".join(f"word{rng.randrange(40)}" for _ in range(rng.randrange(400))) for _ in range(10)] + ["ab" * 3000, "The " * 500, "".join(rng.choice("日月火水木金土曜") for _ in range(3000))]
    d = spark.createDataFrame([(i * 37, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    assert see_fingerprints(d) == brute_fingerprints([(i * 37, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(d).collect()}
    order = sorted(range(len(texts)), key=lambda i: -i)
    for at, i in enumerate(order):
        t, n = texts[i], texts[order[(at + 1) % len(texts)]]
        r, e = got[i * 37], t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (pieces(t) == pieces(e))
    assert all(0 < got[i * 37]["near_edited"] < 1 for i in range(60, 70) if len(texts[i]) > 1000)


def test_fingerprints_of_odd_input(spark):
    r = fingerprint.fingerprints(odd(spark)).collect()
    assert len(r) == 10 and {x["n_chars"] for x in r if x["doc_id"] == 2} == {0}
    assert len({x["fingerprint"] for x in r if x["doc_id"] == 1}) == 1
    assert see_fingerprints(odd(spark)) == brute_fingerprints([(r["doc_id"], r["text"]) for r in odd(spark).collect()])
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    assert fingerprint.fingerprints(odd(spark).where("doc_id = 8")).first()["near_next"] == 1.0


@pytest.mark.parametrize("kind", ["dense", "hashed", "hot", "copies"])
def test_next_in_small_ranges(spark, kind):
    """Sparse (hashed) keys, and many rows of a null or repeated key, with different texts or equal ones."""
    rng = random.Random(1)
    ids = {"dense": lambda: rng.randrange(-150, 150), "hashed": lambda: rng.randrange(-(1 << 63), 1 << 63)}.get(kind, lambda: rng.choice([None, None, 7, rng.randrange(40)]))
    rows = [(ids(), "same" if kind == "copies" and i % 2 else f"t{i}") for i in range(300)]
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    got = fingerprint.with_next(d, rows=8)
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and all("], [b#" in line for line in windows)
    seen = Counter()
    for r in got.collect():
        seen[r["doc_id"], r["text"], r["next_text"]] += r["copies"]
    s = in_order(rows)
    assert seen == Counter((*a, b[1]) for a, b in zip(s, s[1:] + s[:1]))


# op3 ----------------------------------------------------------------------------------------------


def reshared(sizes, weights, total):
    """Targets by the words of the contract: share by weight, cap, reshare the excess, until none is above."""
    out, open_, left = {}, set(range(len(sizes))), total
    while True:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 2 * sizes[i] + 1e-9]
        if not over:
            return [out.get(i, left * weights[i] / w if i in open_ else 0) for i in range(len(sizes))]
        for i in over:
            out[i] = 2 * sizes[i]
            left -= out[i]
            open_.discard(i)
        if not open_:
            return [out[i] for i in range(len(sizes))]


@needs_data
def test_mixing(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix_plan(d, carry=("source",)).collect()
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    assert len(rows) == len(text) and all(r["size"] == len(WORD.findall(text[r["doc_id"]])) for r in rows)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(x["words"] for x in r["slices"])
    names = sorted(size)
    want = reshared([size[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()))
    assert [target[n] for n in names] == pytest.approx(want)
    assert all(abs(taken[n] - target[n]) <= 1 for n in names)
    per = Counter()
    for r in rows:
        for x in r["slices"]:
            per[x["shard"]] += x["words"]
    assert len(per) == 16 and max(per.values()) - min(per.values()) <= 64 * (len(names) + 2)
    again = mixing.mix_plan(d.repartition(7)).collect()
    assert {r["doc_id"]: r["slices"] for r in rows} == {r["doc_id"]: r["slices"] for r in again}


def test_mixed_texts(spark):
    d, _ = corpus(spark, 40)
    out = mixing.mix(d).collect()
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(d).collect()}
    got, text = Counter(), {r["doc_id"]: r["text"] for r in d.collect()}
    for r in out:
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["text"] in text[r["doc_id"]]
    assert dict(got) == {k: v for k, v in plan.items() if v}


def test_mixing_odd_input(spark):
    r = mixing.mix_plan(odd(spark)).collect()
    assert len(r) == 10 and all(x["taken"] <= 2 * x["size"] for x in r) and {x["size"] for x in r if x["doc_id"] in (2, 3, 6)} == {0}
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(odd(spark)).count() > 0


def test_mixing_of_equal_keys_and_texts_agrees(spark):
    """Rows that differ in a carried column only keep their places in a rerun; maps among the columns do no harm."""
    d = spark.range(400).selectExpr("id % 3 as doc_id", "concat('w ', id % 2, ' x y') as text", "concat('s', id % 2) as source", "id as n", "map('a', id) as m")
    see = lambda x: sorted((r["n"], str(r["slices"])) for r in mixing.mix_plan(x, carry=("n", "m"), weights=(3, 1)).collect())
    want = see(d)
    assert want == see(d.repartition(9)) == see(d.orderBy(F.desc("n")))
    assert mixing.mix(d).count() == mixing.mix(d.repartition(5)).count() > 0


def test_quotas_add_up():
    q = mixing.split_quotas([5, 0, 1000, 77], 7, 3)
    assert [sum(x) for x in zip(*q)] == [5, 0, 1000, 77] and max(map(sum, q)) - min(map(sum, q)) <= 2


# op4, op9, op10 -----------------------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark):
    d, labels = corpus(spark, 400)
    r = toxicity.toxicity(d, labels).join(labels, "doc_id").collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in r)
    held = [x for x in r if x["held_out"]]
    assert sum(x["predicted"] == x["toxic"] for x in held) / len(held) > 0.95
    # labels of held-out rows do not matter
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert {x["doc_id"]: x["score"] for x in r} == {x["doc_id"]: x["score"] for x in toxicity.toxicity(d, flipped).collect()}


def test_label_model_counts_copies_of_a_voter_once():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = (rng.random((4000, 2)) < np.where(y[:, None], 0.9, 0.05)).astype(float)
    bad = (rng.random(4000) < np.where(y, 0.45, 0.35)).astype(float)
    x = np.c_[good, np.repeat(bad[:, None], 8, 1)]
    q = toxicity.label_model(x, np.where(rng.random(4000) < 0.1, y.astype(float), np.nan))
    assert ((q > 0.5) == y).mean() > 0.9


def test_language(spark):
    d, _ = corpus(spark, 300)
    r = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in r if x["held_out"]]
    assert held and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in r)
    assert sum(x["lang_pred"] == x["lang"] for x in held) / len(held) > 0.95
    mixed = spark.createDataFrame([(1000, "the house walks under the green stone " * 4 + "der hauses läuft unter grüne steins froh " * 8, None, "a", 0)], SCHEMA)
    spans = language.identify(d.unionByName(mixed)).where("doc_id = 1000").first()
    assert [s["lang"] for s in spans["spans"]] == ["en", "de"] and spans["spans"][0]["words"] == 28 and spans["lang_pred"] == "de"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([5, 0, 3, 1])
    s = rng.normal(size=(9, 3)) * 2
    got, at = language.viterbi(s, lengths, 1.5), 0
    import itertools

    for n in lengths:
        if n:
            value = lambda p: sum(s[at + i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert value(tuple(got[at : at + n])) == pytest.approx(value(best))
        at += n


def test_quality(spark):
    d, labels = corpus(spark, 400)
    g = quality.ratings_of(labels)
    r = quality.grade(d, g).join(g, "doc_id").collect()
    held = [x for x in r if x["held_out"]]
    assert sum(x["keep"] == (x["grade"] > 0) for x in held) / len(held) > 0.95
    assert all(0 <= x["tail"] <= 1 and 0 <= x["expected_grade"] <= 2 for x in r)


def test_ordinal_thresholds_are_ordered():
    texts = ["aaa " * 10, "AAA " * 10, "a$ " * 10] * 20
    m = quality.fit(texts, np.array([0, 1, 2] * 20))
    p = quality.tails(texts[:3], m)
    assert (np.diff(m["cut"]) > 0).all() and p[0, 0] < 0.5 < p[1, 0] and p[1, 1] < 0.5 < p[2, 1]


@pytest.mark.parametrize("run", [lambda d, l: toxicity.toxicity(d, l), lambda d, l: language.identify(d), lambda d, l: quality.grade(d, quality.ratings_of(l))])
def test_classifiers_on_odd_input(spark, run):
    _, labels = corpus(spark, 8)
    labels = labels.unionByName(spark.createDataFrame([(None, None, None), (1, None, 1)], labels.schema))
    r = run(odd(spark), labels).collect()
    assert len(r) == 10
    assert run(empty(spark), labels).count() == 0
    assert run(odd(spark), labels.limit(0)).count() == 10
    for x in r:
        if "lang_pred" in x.asDict() and x["doc_id"] in (2, 3, 6):
            assert x["lang_pred"] == "und" and x["score"] == 0


def test_toxicity_scores_by_hand(spark):
    """The score of every text from the fitted weights, word by word."""
    d, labels = corpus(spark, 300)
    rows = {r["doc_id"]: r for r in labels.collect()}
    frame = d.toPandas()
    frame["label"] = [float(rows[i]["toxic"]) if i % 4 else float("nan") for i in frame["doc_id"]]
    m = toxicity.fit(frame, {0: 200, 1: 50})
    for t in frame["text"].tolist() + ["", None, "You are such scum!!! 12"]:
        words = set(re.findall(r"[^\W\d_]+", (t or "").lower()))
        units = set(words)
        for w in words:
            units |= {w[:n] + "~" for n in (3, 4, 5, 6, 7) if n < len(w)}
        seen = [u for u in units if u in m["known"]]
        z = m["bias"] + sum(m["words"].get(u, 0.0) for u in seen) / math.sqrt(max(1, len(seen)))
        z += m["share"] * len([u for u in units if u in m["mined"]]) / math.sqrt(max(20, len(units)))
        z += sum(w for w, lexicon in zip(m["votes"], m["lexicons"]) if any(u in units for u in lexicon))
        z += sum(w for w, p in zip(m["votes"][len(m["lexicons"]) :], toxicity.PATTERNS.values()) if re.search(p, t or ""))
        assert toxicity.score(t, m) == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_toxicity_learns_from_rows_without_labels(spark):
    d, labels = corpus(spark, 400)
    known = labels.where("doc_id < 60")
    sample, counts = toxicity._sample.sampled(d, known.withColumnRenamed("toxic", "label"), "doc_id", "text", "label", 1000, unlabelled=1000, where=F.col("doc_id") % 2 == 0)
    got = sample.collect()
    assert {r["doc_id"] for r in got if r["label"] is not None} == set(range(60)) and {r["doc_id"] for r in got if r["label"] is None} == set(range(60, 400, 2))
    r = toxicity.toxicity(d, known).join(labels, "doc_id").where("doc_id >= 60").collect()
    assert sum(x["predicted"] == x["toxic"] for x in r) / len(r) > 0.95


def test_language_scores_by_hand(spark):
    """Spans and score from the fitted tables, by plain numbers and all paths of short texts."""
    import itertools

    d, _ = corpus(spark, 60)
    m = language.fit(d, "text", "lang")
    full = (1 << 64) - 1
    m1, m2, m3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9

    def bucket(x):
        return ((x * m1) & full) >> 48

    def score(w):
        padded, total = "\x02" + w + "\x02", 0.0
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            h = (ord(a) * m1 & full) ^ (ord(b) * m2 & full) ^ (ord(c) * m3 & full)
            total = total + m["gram"][bucket(h ^ (h >> 29))].astype(float)
        h = sum(((ord(c) + 7) * m3 & full) ^ ((i + 1) * m2 & full) for i, c in enumerate(w)) & full
        h = h * m1 & full
        return total + m["word"][bucket(h ^ (h >> 31))].astype(float)

    for t in ("the river under", "der hauses läuft stone", "Fluss 12 green, froh_under", "happy"):
        words = re.findall(r"[^\W\d_]+", t.lower())
        s = [score(w) for w in words]
        value = lambda p: sum(s[i][x] for i, x in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        path = max(itertools.product(range(2), repeat=len(words)), key=value)
        letters = Counter()
        for w, x in zip(words, path):
            letters[x] += len(w)
        best = max(letters, key=lambda x: (letters[x], -x))
        lang, sc, spans = language.label([t], m)[0]
        assert lang == m["langs"][best] and sc == pytest.approx(letters[best] / sum(letters.values()))
        assert [x for _, n, x in spans for _ in range(n)] == [m["langs"][x] for x in path]


def test_many_languages(spark):
    """More than a byte can number, none left out; too many are refused."""
    rng = random.Random(3)
    words = {i: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for i in range(300)}
    rows = [(i, " ".join(rng.choice(words[i % 300]) for _ in range(30)), f"l{i % 300:03}", "a", 0) for i in range(1500)]
    d = spark.createDataFrame(rows, SCHEMA)
    r = language.identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(x["lang_pred"] == x["lang"] for x in r) / len(r) > 0.95 and len({x["lang_pred"] for x in r}) > 200
    with pytest.raises(ValueError, match="classes"):
        language.identify(spark.range(1500).selectExpr("id as doc_id", "'a' as text", "cast(id as string) as lang"))


def test_letterless_numerals_have_no_language(spark):
    d, _ = corpus(spark, 60)
    odd_ones = spark.createDataFrame([(900 + i, t, None, "a", 0) for i, t in enumerate(["½", "x²", "①②", "½ the", "٣", "_", "Ⅷ"])], SCHEMA)
    got = {r["doc_id"]: r for r in language.identify(d.unionByName(odd_ones)).where("doc_id >= 900").collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(900, 907)] == [True, False, True, False, True, True, True]
    assert all(r["score"] == 0 and r["spans"] == [] for r in got.values() if r["lang_pred"] == "und")


def test_rows_without_a_language_teach_nothing(spark):
    d, _ = corpus(spark, 80)
    same = d.withColumn("lang", F.lit(None).cast("string")).withColumn("text", F.lit("zzz qqq xxx"))
    sample, counts = language._sample.sampled_rows(d.unionByName(same), "doc_id", "text", "lang", 1000)
    assert {r["text"] for r in sample.collect()}.isdisjoint({"zzz qqq xxx"}) and sum(counts.values()) == 80


def test_samples_are_bounded_by_keys(spark):
    """A key that very many rows share gives one row; more classes than a map of a few are all taken."""
    d = spark.range(20_000).selectExpr("if(id < 15000, 7, id) as doc_id", "concat('text ', id) as text", "'en' as lang")
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 300 as int) as label")
    sample, counts = toxicity._sample.sampled(d, labels, "doc_id", "text", "label", 10)
    got = sample.collect()
    assert len(counts) == 300 and len(got) < 300 * 30 and sum(r["doc_id"] == 7 for r in got) <= 1
    hot = d.where("doc_id = 7").withColumn("text", F.lit("same"))
    sample, _ = language._sample.sampled_rows(hot, "doc_id", "text", "lang", 100_000)
    assert sample.count() == 1
    with pytest.raises(ValueError, match="classes"):
        toxicity._sample.sampled(d, labels.withColumn("label", F.col("doc_id")), "doc_id", "text", "label", 10)


def test_quality_by_hand(spark):
    """Tail probabilities and grades from the fitted weights, token by token."""
    texts = ["aaa Bbb, 12 ccc ccc"] * 3 + ["The HOUSE!! is the house... é日 x-1", "", None, " \n\t "] + ["good words here"] * 10 + ["BAD!! $$ 99"] * 10
    grades = np.array([1, 1, 1, 2, 0, 0, 0] + [2] * 10 + [0] * 10)
    m = quality.fit(texts, grades)
    full, p, q = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def kind(ch):
        c = ord(ch)
        if c >= 0x3000:
            c, ch = 0x2FFF, chr(0x2FFF)
        return 0 if ch.isspace() else 3 if ch.isdigit() else 2 if ch.isupper() else 1 if ch.isalpha() else c if c < 128 else 4

    def hashed(x, salt):
        return ((x + salt) * p & full) >> (64 - 17)

    def z_of(t):
        tokens = "".join(ch if kind(ch) else " " for ch in t or "").split()
        total, last_shape, last_word = 0.0, 0, None
        for w in tokens:
            shape, word, runs, before = 0, 0, 0, None
            for at, ch in enumerate(w):
                if kind(ch) != before:
                    x = (kind(ch) + 1) * p * (runs * 2 + 3) & full
                    shape = shape + (x ^ (x >> 33)) & full
                    runs, before = runs + 1, kind(ch)
                low = ord(ch) + 32 if "A" <= ch <= "Z" else ord(ch)
                x = (low + 11) * q * (at * 2 + 3) & full
                word = word + (x ^ (x >> 31)) & full
            pair = (shape * q + last_shape * p + 5) & full
            total += (m["w"][hashed(shape, 1)] + m["w"][hashed(pair, 2)] + 0.1 * m["w"][hashed(word, 3)] + (m["w"][1] if word == last_word else 0)) / len(tokens)
            last_shape, last_word = shape, word
        return total

    got = quality.tails(texts, m)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx([1 / (1 + math.exp(-(z_of(t) - c))) for c in m["cut"]], abs=1e-5)
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    ratings = spark.createDataFrame([(i, int(g)) for i, g in enumerate(grades)], "doc_id long, grade int")
    for r in quality.grade(d, ratings).collect():
        assert 0 <= r["tail"] <= 1 and r["keep"] == (r["tail"] >= 0.5) and r["tail"] <= r["expected_grade"] <= 2 * r["tail"] + 1e-9


# op5 ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return segmentation.vocabulary()


def all_segmentations(text, v, pieces):
    """(ids, log probability) of every segmentation, by enumeration."""
    out, score = [], dict(zip(v["ids"].tolist(), v["score"].tolist()))
    s = " " + text

    def go(at, ids, lp):
        if at == len(s):
            out.append((tuple(ids), lp))
            return
        bare = s[at] not in pieces
        for n in range(1, min(v["width"], len(s) - at) + 1):
            p = s[at : at + n]
            if p in pieces:
                go(at + n, ids + [pieces[p]], lp + score[pieces[p]])
        if bare:
            b = s[at].encode()
            go(at + 1, ids + [int(v["byte"][x]) for x in b], lp + v["byte_score"] * len(b))

    go(0, [], 0.0)
    z = math.log(sum(math.exp(lp) for _, lp in out))
    return {ids: lp - z for ids, lp in out}


def rows_of(lat, f, n):
    ids, ends = segmentation.ids_of(lat, f["path"], n)
    return {r: tuple(ids[([0] + ends.tolist())[r] : ends[r]].tolist()) for r in f["rows"].tolist()}


def test_the_whole_vocabulary_is_used(vocabulary):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=segmentation.MODEL)
    known = set(vocabulary["ids"].tolist())
    assert known == {i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    assert any(sp.id_to_piece(i).startswith("▁▁") for i in known)


@pytest.mark.parametrize("text", ["the", "a é∑", "hat\nx", "a   of", "  b", "c  ", " \n  "])
def test_samples_follow_the_lattice(vocabulary, text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=segmentation.MODEL)
    known = set(vocabulary["ids"].tolist())
    pieces = {sp.id_to_piece(i).replace("▁", " "): i for i in known}
    n, k = 6000, 3
    want = all_segmentations(text, vocabulary, pieces)
    lat = segmentation.Units(vocabulary)
    found, limit = segmentation.sample([text] * n, np.arange(n), k, lat, 9)
    seen = [[] for _ in range(n)]
    for f in found:
        rows = rows_of(lat, f, n)
        for r, lp in zip(f["rows"].tolist(), f["logp"].tolist()):
            assert lp == pytest.approx(want[rows[r]], abs=2e-3)
            seen[r].append(rows[r])
    assert all(len(set(s)) == len(s) == min(k, len(want)) for s in seen)
    first = Counter(s[0] for s in seen)
    for ids, lp in want.items():
        p = math.exp(lp)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    if len(want) > 1:
        second = Counter(s[1] for s in seen)
        for ids, lp in want.items():
            p = sum(math.exp(o) * math.exp(lp) / sum(math.exp(z) for y, z in want.items() if y != x) for x, o in want.items() if x != ids)
            assert abs(second[ids] / n - p) < 5 * math.sqrt(max(p * (1 - p), 0) / n) + 2e-3
    assert np.isfinite(limit).all() == (len(want) > k)


def test_samples_do_not_depend_on_chunks(vocabulary, monkeypatch):
    """Equal numbers whatever the chunk and the kept units are, also where units are dropped all the time or all hashes are equal."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the ", "of ", "Haus", "é", "  ", "\n", "x" * rng.randrange(1, 30), "▁", "ing", "∑"]) for _ in range(rng.randrange(60))) for _ in range(120)]
    keys = np.arange(120)

    def run(size, limit):
        lat, out = segmentation.Units(vocabulary, limit), []
        for at in range(0, 120, size):
            part = texts[at : at + size]
            found, left = segmentation.sample(part, keys[at : at + size], 2, lat, 4)
            for r, f in enumerate(found):
                ids = rows_of(lat, f, len(part))
                out += [(at + i, r, s, lp, ids[i], left[i]) for i, s, lp in zip(f["rows"].tolist(), f["score"].tolist(), f["logp"].tolist())]
        return sorted(out)

    want = run(120, 10**9)
    assert run(7, 200) == want and run(1, 0) == want
    monkeypatch.setattr(segmentation, "unit_hashes", lambda c, begin, lengths: lengths.astype(np.uint64) % np.uint64(3))
    assert run(20, 10**9) == want


def test_segment_and_decode(spark):
    d = odd(spark)
    s = segmentation.segment(d, k=2)
    rows = s.collect()
    text = defaultdict(set)
    for r in d.collect():
        text[r["doc_id"]].add(r["text"] or "")
    back = segmentation.pieces_to_text(s).collect()
    assert all(r["text"] in text[r["doc_id"]] for r in back) and all(r["round_trip"] for r in rows if r["rank"] == 1)
    assert {r["inclusion"] for r in rows if r["doc_id"] in (2, 3)} == {1.0} and {r["rank"] for r in rows if r["doc_id"] == 3} == {1}
    assert all(hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest() == r["digest"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    again = {(r["doc_id"], r["rank"], r["digest"]) for r in segmentation.segment(d.repartition(5), k=2, emit_ids=False).collect()}
    assert again == {(r["doc_id"], r["rank"], r["digest"]) for r in rows}
    assert segmentation.segment(empty(spark)).count() == 0


# op6 ----------------------------------------------------------------------------------------------


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def near_copies(n=150, seed=3):
    """A family of texts, each made from an earlier one by a few edits, and loners."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = {0: [word() for _ in range(150)]}
    for i in range(1, n):
        if i % 6 == 0:
            texts[i] = [word() for _ in range(rng.randint(1, 120))]
        else:
            t = list(texts[rng.randrange(i)] if i % 5 else texts[0])
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = word().upper()
            texts[i] = t
    return {i: " ".join(t) for i, t in texts.items()}


@pytest.mark.parametrize("node, rounds", [(1024, 6), (12, 3), (12, 1)])
def test_near_duplicates(spark, node, rounds):
    texts = near_copies()
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], SCHEMA)
    r = near_dedup.near_duplicates(d, percent=85, node=node, rounds=rounds).collect()
    sets = sets_of(texts)
    assert {x["doc_id"]: x["n_shingles"] for x in r} == {i: len(s) for i, s in sets.items()}
    assert {x["doc_id"]: x["component_id"] for x in r} == brute(sets, 85)
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in r)


def template_family(shared, own, edits, apart, n=150, seed=9):
    """Texts of a template whose passages of own words keep them below the threshold, each with a twin just above it."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    template = [word() for _ in range(shared)]
    texts = {}
    for i in range(0, 2 * n, 2):
        t = list(template)
        for _ in range(edits):
            t[rng.randrange(len(t))] = word()
        t += [word() for _ in range(own)]
        twin = list(t)
        for at in range(apart):
            twin[(at + 1) * len(t) // (apart + 1)] = word()
        texts[i], texts[i + 1] = " ".join(t), " ".join(twin)
    return texts


@pytest.mark.parametrize("shared, own, edits, apart, branches", [(300, 0, 4, 4, False), (60, 80, 0, 2, True)])
def test_twins_of_a_template_family(spark, monkeypatch, shared, own, edits, apart, branches):
    texts = template_family(shared, own, edits, apart)
    sets = sets_of(texts)
    near = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
    far = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(0, len(texts), 2) for j in range(0, i, 2)]
    assert sorted(far)[int(0.99 * len(far))] < 0.85 <= min(near) and min(near) < 0.88
    written = []
    monkeypatch.setattr(near_dedup, "materialize", lambda df, tag: written.append(tag) or materialize(df, tag))
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], SCHEMA)
    r = near_dedup.near_duplicates(d, percent=85, node=12).collect()
    assert {x["doc_id"]: x["component_id"] for x in r} == brute(sets, 85)
    assert branches == ("deeper" in written)


@pytest.mark.parametrize("trees, least", [(1, 0.93), (3, 0.995)])
def test_branching_on_keeps_pairs_together(trees, least):
    """Twins just above the threshold that share one node still share one after three rounds more."""
    import pyarrow as pa

    texts = list(template_family(130, 0, 3, 2).values())
    own = [[{"node": 7, "trees": trees}] for _ in texts]
    for _ in range(3):
        batch = pa.RecordBatch.from_pydict({"key": range(len(texts)), "hash": range(len(texts)), "text": texts, "nodes": own})
        found = defaultdict(set)
        for b in near_dedup._deeper(iter([batch])):
            for i, n in zip(b.column("key").to_pylist(), b.column("node").to_pylist()):
                found[i].add(n)
        # only nodes that the twins share matter further
        own = [[{"node": n, "trees": 1} for n in sorted(found[i] & found[i ^ 1])[:40]] for i in range(len(texts))]
    assert sum(1 for x in own[::2] if x) >= least * len(texts) / 2


def test_beyond_the_broadcast_bounds(spark, monkeypatch):
    """What is larger than a broadcast may be is joined by a shuffle, to the same rows."""
    from graphloom.llm import pipeline as cp

    texts = near_copies(60)
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in texts.items()], SCHEMA)
    see = lambda: sorted(map(tuple, near_dedup.near_duplicates(d, node=12).collect()))
    kept = lambda: sorted(r["doc_id"] for r in cp.drop_near_copies(spark, d, "").collect())
    pages = spark.createDataFrame([(i, f"http://h.net/{i % 9}") for i in range(40)], "page_id long, url string")
    listed = spark.createDataFrame([("h.net/3",), ("h.net/5",)], "canonical string")
    urls = lambda: sorted(map(str, url_filter.filter_urls(pages, listed, []).collect()))
    want = see(), kept(), urls()
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(cp, "BROADCAST_IDS", 0)
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    assert (see(), kept(), urls()) == want


def test_overlaps_by_both_ways():
    rng = random.Random(4)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randrange(1, 50))], np.uint64)) for _ in range(40)]
    got = near_dedup.overlaps(sets)
    assert all(got[a, b] == len(set(sets[a].tolist()) & set(sets[b].tolist())) for a in range(40) for b in range(40))


def brute_rows(rows, percent):
    """The component of each key by brute force over rows (key, text), keys of several texts included."""
    sets = sets_of(dict(enumerate(t for _, t in rows)))
    root = {k: k for k, _ in rows if k is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (ka, _) in enumerate(rows):
        for b in range(a):
            kb = rows[b][0]
            if ka is not None and kb is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(ka), find(kb)))
                root[y] = x
    return [k if k is None or not sets[i] else find(k) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("node, shingles", [(1024, 4_000_000), (12, 4_000_000), (1024, 900)])
def test_near_duplicates_of_repeated_keys(spark, monkeypatch, node, shingles):
    """Keys with several texts, rows that repeat, a key that holds a third of all rows; nodes bounded by documents or by shingles."""
    rng = random.Random(5)
    rows = [(5, "a b c d e f g"), (5, "h i j k l m n"), (3, "h i j k l m n"), (9, "a b c d e f g"), (5, ""), (None, "a b c d e f g")]
    texts = list(near_copies(90).values())
    for t in texts:
        rows += [(rng.choice([7, rng.randrange(100, 160), rng.randrange(100, 160)]), t)] * rng.choice([1, 1, 1, 4])
    rows += [(200, texts[1])] * 40
    d = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in rows], SCHEMA)
    want = sorted(zip([k for k, _ in rows], brute_rows(rows, 85)), key=str)
    see = lambda: sorted(((x["doc_id"], x["component_id"]) for x in near_dedup.near_duplicates(d, node=node, shingles=shingles).collect()), key=str)
    assert see() == want
    assert {c for k, c in want if k in (3, 5, 9)} == {3, 5} and [c for k, c in want if k == 9] == [3]
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert see() == want


def test_shingles_of_a_text_in_parts():
    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab", "c", " ", "\n", "\t", "é"]) for _ in range(rng.randrange(200))) for _ in range(40)] + ["", None, "x" * 90]
    assert all((a == b).all() for a, b in zip(shingle_sets(texts), shingle_sets(texts, chars=17)))


def test_near_duplicates_odd_input(spark):
    r = near_dedup.near_duplicates(odd(spark)).collect()
    by = {x["doc_id"]: x for x in r}
    assert len(r) == 10 and by[5]["component_id"] == 4 and by[4]["kept"] and not by[5]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"] and all(by[i]["n_shingles"] == 0 and by[i]["kept"] for i in (2, 3, 6))
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_shingles_are_those_of_the_words():
    texts = ["A b c d e f", "a B c d e F", "a b", "", None, "x\x0by\x0cz q w e r"]
    got = shingle_sets(texts)
    assert (got[0] == got[1]).all() and [len(g) for g in got] == [2, 2, 1, 0, 0, 2]


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["node"]: r["component"] for r in _components.components(chain).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}


# op7 ----------------------------------------------------------------------------------------------


def test_rollups(spark, tmp_path):
    d = odd(spark)
    store = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    assert store.commit("b1", token_counts.insert(d)) and not store.commit("b1", token_counts.insert(d))
    enc = token_counts.encoding(token_counts.TOKENIZERS["byte_bpe_50k@1"], open(token_counts.TOKENIZERS["byte_bpe_50k@1"], "rb").read())
    want = defaultdict(lambda: [0, 0])
    for r in d.collect():
        for name, n in (("words@1", len(WORD.findall(r["text"] or ""))), ("byte_bpe_50k@1", len(enc.encode_ordinary(r["text"] or "")))):
            want[r["source"], r["lang"], name][0] += 1
            want[r["source"], r["lang"], name][1] += n
    see = lambda: {(r["source"], r["lang"], r["tokenizer"]): [r["documents"], r["tokens"]] for r in store.totals().collect()}
    assert see() == dict(want)
    # a write that was cut off has no success marker and does not count
    store.commit("b2", token_counts.insert(d))
    os.remove(tmp_path / "r/deltas/batch=b2/_SUCCESS")
    assert see() == dict(want)
    assert store.commit("b2", token_counts.delete(d)) and see() == {}
    store.commit("b3", token_counts.insert(d.where("doc_id = 8")).unionByName(token_counts.delete(d.limit(0))))
    before = see()
    store.compact()
    assert see() == before and len(store.committed()) == 1 and not store.commit("b1", token_counts.insert(d))
    assert store.commit("none", token_counts.insert(empty(spark))) and see() == before


def test_rollups_of_many_long_batches(spark, tmp_path):
    """Ids that no folder name could hold together, or one by itself; a compaction that was cut off does not count."""
    d = spark.createDataFrame([("a b", "s", "en", 1)], "text string, source string, lang string, sign int")
    store = token_counts.TokenRollup(spark, str(tmp_path / "r"), {"words@1": None})
    ids = [f"{i}-" + "x" * n for i, n in enumerate([60, 60, 60, 60, 60, 300, 3000])]
    assert all(store.commit(i, d) for i in ids) and not any(store.commit(i, d) for i in ids)
    see = lambda: [(r["documents"], r["tokens"]) for r in store.totals().collect()]
    assert see() == [(7, 14)]
    store.compact()
    at = tmp_path / "r/deltas"
    assert see() == [(7, 14)] and len(os.listdir(at)) == 1 and not any(store.commit(i, d) for i in ids)
    assert store.commit("more", d) and see() == [(8, 16)]
    # as if the second compaction had stopped before its list was in place, and before the old folders were gone
    import shutil

    shutil.copytree(at, tmp_path / "before")
    store.compact()
    new = next(x for x in os.listdir(at) if x not in os.listdir(tmp_path / "before"))
    for x in os.listdir(tmp_path / "before"):
        shutil.copytree(tmp_path / "before" / x, at / x)
    assert len(os.listdir(at)) == 3 and see() == [(8, 16)]
    os.remove(at / new / "_BATCHES")
    assert see() == [(8, 16)] and not store.commit("more", d)
    for bad in ("", "a/b", "a=b", "~a", "a\nb"):
        with pytest.raises(ValueError):
            store.commit(bad, d)


# op8 ----------------------------------------------------------------------------------------------


def brute_embeddings(rows, cosine=0.95):
    """(id, n_links, component) of rows (id, vector) by all pairs of equal length."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    links, root = Counter(), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in good:
        for b in good:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    low = {}
    for i in good:
        low[find(i)] = min(low.get(find(i), 1 << 60), rows[i][0])
    return [(k, links[i], low[find(i)] if i in unit else k) for i, (k, _) in enumerate(rows)]


def vectors_of(seed=6, dims=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, dims))
    return np.concatenate([base, base[:20] + 0.12 * rng.normal(size=(20, dims)), base[:10] * 3, np.repeat(base[:1], 30, 0), base[1] + 0.2 * rng.normal(size=(40, dims))])


def see_embeddings(d, **parameters):
    r = embedding_dedup.near_embeddings(d, **parameters).collect()
    assert all(x["kept"] == (x["component_id"] == x["vec_id"]) or x["vec_id"] is None for x in r)
    return sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in r), key=str)


@pytest.mark.parametrize("kind", ["double", "float"])
@pytest.mark.parametrize("block, coded", [(1024, 16), (7, 16), (16, 0)])
def test_embeddings(spark, monkeypatch, kind, block, coded):
    """Exact on small tables: several vectors of one id, lengths of few vectors, zero and broken vectors, crowded cells in small blocks."""
    monkeypatch.setattr(embedding_dedup, "CODED", coded)
    monkeypatch.setattr(embedding_dedup, "CODED_ROWS", 30)
    x, y = vectors_of(), vectors_of(7, 5)[:25]
    rows = [(i, v) for i, v in enumerate(np.float32(x).astype(float).tolist())]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [None] + [1.0] * 23), (904, []), (905, [1.0, 2.0]), (None, rows[0][1]), (906, [float("inf")] + [1.0] * 23)]
    # lengths of few vectors; one id for many vectors of both lengths
    rows += [(300 + i, v) for i, v in enumerate(np.float32(y).astype(float).tolist())] + [(700, [1.0, 2.0, 3.0]), (701, [1.0, 2.0, 3.0]), (699, [1.0, 2.0, 3.01])]
    rows += [(50, v) for _, v in rows[62:75]] + [(50, [3.0, 1.0, 1.0]), (50, [1e-30, 1e-30]), (800, [2e-30, 2e-30])]
    d = spark.createDataFrame([(i, v, "clash") for i, v in rows], f"vec_id long, embedding array<{kind}>, id string")
    assert see_embeddings(d, recall=1.0, block=block) == sorted(brute_embeddings(rows), key=str)


def test_embeddings_of_one_sided_pairs(spark, monkeypatch):
    """With few visits a pair that only one side finds counts at both its ends."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(80, 16))
    x = np.concatenate([base + 0.16 * rng.normal(size=base.shape) for _ in range(5)])
    models = []
    fit = embedding_dedup.fit
    monkeypatch.setattr(embedding_dedup, "fit", lambda *a: models.append({**fit(*a), "visits": 2}) or models[-1])
    monkeypatch.setattr(embedding_dedup, "CELL", 4)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {i: n for i, n, _ in see_embeddings(d)}
    u = embedding_dedup.unit(x)
    cells = embedding_dedup.cells_of(u, models[0])
    reach = (cells[:, :, None] == cells[None, :, 0][:, None, :]).any(1)
    link = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    assert (link & (reach != reach.T)).sum() > 10
    assert [got[i] for i in range(len(u))] == (link & (reach | reach.T)).sum(1).tolist()


def test_embeddings_reach_the_recall(spark):
    x = np.random.default_rng(3).normal(size=(600, 32))
    noise = np.random.default_rng(5).normal(size=x.shape)
    near = x + 0.3 * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near]))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = see_embeddings(d), sorted(brute_embeddings(rows), key=str)
    assert sum(n for _, n, _ in got) >= 0.98 * sum(n for _, n, _ in want) > 400
    assert embedding_dedup.near_embeddings(d.limit(0)).count() == 0
    assert see_embeddings(d.where("vec_id = 1")) == [(1, 0, 1)]


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random((50, 9)), rng.random((50, 7))
    got = embedding_dedup.traversal(d1, d2, 12)
    total = (d1[:, :, None] + d2[:, None, :]).reshape(50, -1)
    assert all(np.allclose(np.sort(total[i])[:12], total[i][got[i]]) for i in range(50))


# pipeline -----------------------------------------------------------------------------------------


@needs_data
def test_pipeline(spark):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    clean = cp.drop_toxic(spark, d, DATA).cache()
    ids = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == d.columns and sum(i in ids for i, r in labels.items() if not r["toxic"]) == sum(not r["toxic"] for r in labels.values())
    good = cp.drop_poor(spark, clean, DATA).cache()
    kept = {r["doc_id"] for r in good.collect()}
    fine = [i for i in ids if i in labels and labels[i]["quality"]]
    assert good.columns == d.columns and sum(i in kept for i in fine) / len(fine) > 0.98
    alone = cp.drop_near_copies(spark, good, DATA).cache()
    sets = sets_of({i: text[i] for i in kept})
    assert {r["doc_id"] for r in alone.collect()} == {i for i, c in brute_by_prefix(sets, 80).items() if i == c}
    mixed = cp.mix_sources(spark, alone, DATA).cache()
    assert mixed.columns == d.columns and {r["doc_id"] for r in mixed.select("doc_id").collect()} <= {r["doc_id"] for r in alone.collect()}
    out = cp.encode(spark, mixed, DATA)
    assert out.where("rank = 1").count() == mixed.count() and out.where("rank = 1 and not round_trip").count() == 0
    # a row names its slice, and slices of one document are drawn by themselves
    slices = {r["s"]: r["n_chars"] for r in mixed.select(F.xxhash64("doc_id", "text").alias("s"), "n_chars").collect()}
    rows = out.select("doc_id", "slice", "rank", "n_chars", "digest").collect()
    named = {r["slice"]: r["n_chars"] for r in rows}
    # equal slices have names, and samples, of their own
    assert len(named) == mixed.count() > len(slices) and slices.items() <= named.items() and len({(r["slice"], r["rank"], r["digest"]) for r in rows}) == len({(r["slice"], r["rank"]) for r in rows})
    assert [s for s, _ in cp.STAGES] == ["toxicity", "quality classifier", "MinHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_pipeline_stages_on_odd_input(spark, tmp_path):
    import corpus_pipeline as cp

    _, labels = corpus(spark, 60)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd(spark), empty(spark)):
        d = docs
        for i, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, d, str(tmp_path))
            if i < 4:
                assert out.columns == docs.columns
            d = out.cache()
            d.count()
    # without labels nothing is known to be poor
    labels.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert cp.drop_poor(spark, odd(spark), str(tmp_path / "none")).count() == 10


def brute_by_prefix(sets, percent):
    """All links by shared rare shingles: exact."""
    df = Counter(g for s in sets.values() for g in s)
    index, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        s = sorted(sets[i], key=lambda g: (df[g], g))
        for g in s[: len(s) - math.ceil(percent / 100 * len(s)) + 1]:
            index[g].append(i)
    for l in index.values():  # noqa: E741
        for x in range(len(l)):
            for y in range(x):
                a, b = find(l[x]), find(l[y])
                if a != b and 100 * len(sets[l[x]] & sets[l[y]]) >= percent * len(sets[l[x]] | sets[l[y]]):
                    root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@needs_data
def test_registered(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in q} and "pipeline" in q
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    df = q["op1_url_filter"](spark, DATA)
    cur = con.execute(entry.oracle_sql()["op1_url_filter"])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, ([r[c] for c in names] for r in df.collect()))) == sorted(map(str, map(list, cur.fetchall())))


def test_segmentation_query_gives_and_checks_every_segmentation(spark, tmp_path):
    from graphloom.llm import queries

    rows = [(1, "the nation then"), (2, "a  line\nand another \u2581 mark"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_segmentation(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in got)
