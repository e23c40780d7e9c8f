"""Document fingerprints (native): an invertible Bloom lookup sketch of a text's paragraphs.

A text is cut at line breaks and sentence ends (long pieces further, at places that their words choose); each distinct piece gives a key: 40 bits of hash
and 24 check bits of that hash. A block has 4 subtables of 4 cells; a key is xor-ed into one cell of each
subtable. Sketches of two versions subtract cell by cell (xor), shared keys cancel, and peeling
recovers the keys that only one of them has: a cell whose check bits fit holds a single key, which
is then taken out of its other cells. A sketch that is too small leaves cells that do not peel; the
pair is then sketched again with more blocks, and a block that does not peel with four times as many, until all peel.

Likeness = shared pieces / all pieces (Jaccard), from the piece counts and the recovered difference.

Defined results for odd input: a null text is an empty text; two empty texts are alike (1.0); pieces
count once however often they repeat; equal texts have equal sketches; rows with a null doc_id come last and rows of one
doc_id follow each other by the hash of their texts, repeated rows each by the next; a very long text is one row and one
task's memory, its pieces are numbers; equal pieces of a text are one; an empty table gives an empty result; extra columns are left
out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialize

#: Cells of a block: four subtables of four.
CELLS = 16
#: Bits of a key: 0-23 check the rest; 24-31 choose the cells, 32 and up the block.
CHECK_BITS, SLOT_SHIFT, BLOCK_SHIFT = 24, 24, 32
#: Keys of a block, of both sides, that are peeled.
LEAF = 12
ROUNDS = 10
#: Characters of a piece that is not cut further.
LONG = 400
#: Rows of a range of keys, about, and ranges at most (their bounds, 24 bytes each, are on the driver and in the plan).
RANGE_ROWS, MAX_RANGES = 2_000, 50_000


def _check(key: str) -> str:
    """SQL: the check bits that belong to a key."""
    return f"(xxhash64(shiftright({key}, {CHECK_BITS})) & {(1 << CHECK_BITS) - 1}L)"


def _cut_by_hash(items: Column, one_in: int, between: str) -> Column:
    """The items joined again, and cut behind those that their hash chooses: the same places wherever a run of them occurs."""
    end = lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(one_in)) == 0, "\n").otherwise(between)
    return F.split(F.array_join(F.transform(items, lambda w: F.concat(w, end(w))), ""), "\n")


def _shorter(cut: Column, longest: int, parts) -> Column:
    """``cut`` with ``parts`` of those pieces that are longer than ``longest``, where there are any."""
    each = lambda c: F.flatten(F.transform(c, lambda s: F.when(F.length(s) > longest, parts(s)).otherwise(F.array(s))))
    return F.element_at(F.transform(F.array(cut), lambda c: F.when(F.exists(c, lambda s: F.length(s) > longest), each(c)).otherwise(c)), 1)


def pieces(text: Column) -> Column:
    """Distinct keys of a text's paragraphs, cut further at sentence ends. What stays longer than ``LONG`` is cut behind
    words that their hash chooses, and what stays longer than four times that behind such characters."""
    cut = F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?])[ \t]+")
    finer = lambda s: _shorter(_cut_by_hash(F.split(s, r"\s+"), 8, " "), 4 * LONG, lambda x: _cut_by_hash(F.split(x, ""), 32, ""))
    upper = lambda s: F.xxhash64(s).bitwiseAND(F.lit(-(1 << CHECK_BITS)))
    high = F.array_remove(F.array_distinct(F.transform(_shorter(cut, LONG, finer), upper)), upper(F.lit("")))
    return F.transform(high, lambda k: k + F.xxhash64(F.shiftright(k, CHECK_BITS)).bitwiseAND(F.lit((1 << CHECK_BITS) - 1)))


#: SQL: a mask and a value for each cell; a key belongs to the cell if its masked bits are the value.
SLOTS = "array(" + ", ".join(f"named_struct('m', {3 << (SLOT_SHIFT + 2 * (i // 4))}L, 'v', {(i % 4) << (SLOT_SHIFT + 2 * (i // 4))}L)" for i in range(CELLS)) + ")"


def _cells(ds: str) -> str:
    """SQL: the cells of one block that holds the keys ``ds``."""
    return f"transform({SLOTS}, w -> aggregate({ds}, 0L, (s, d) -> if((d & w.m) = w.v, s ^ d, s)))"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with ``name`` bound to value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _peel(cells: str) -> str:
    """SQL: struct(ok, n): whether the block's difference peeled, and how many keys it gave.

    A key is taken for pure if its check bits and its cell fit. One that is so by chance is put in where it does not belong and
    comes out again later, so keys that were taken twice do not count.
    """
    fits = f"x <> 0 and (x & w.m) = w.v and (x & {(1 << CHECK_BITS) - 1}L) = {_check('x')}"
    pure = f"array_remove(array_distinct(zip_with(s.cells, {SLOTS}, (x, w) -> if({fits}, x, 0L))), 0L)"
    rest = f"zip_with(s.cells, {SLOTS}, (x, w) -> aggregate(p, x, (t, q) -> if((q & w.m) = w.v, t ^ q, t)))"
    step = f"if(s.stop, s, {_let(pure, 'p', f"if(size(p) = 0, named_struct('cells', s.cells, 'found', s.found, 'stop', true), named_struct('cells', {rest}, 'found', flatten(array(s.found, p)), 'stop', false))")})"
    once = "if(size(array_distinct(s.found)) = size(s.found), size(s.found), size(filter(array_distinct(s.found), k -> size(filter(s.found, y -> y = k)) % 2 = 1)))"
    done = f"named_struct('ok', forall(s.cells, x -> x = 0), 'n', {once})"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', cast(array() as array<bigint>), 'stop', false), (s, r) -> {step}, s -> {done})"


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> x ^ y)"


def _difference(a: str, b: str) -> str:
    """SQL: struct(open, n): the keys that only one of ``a`` and ``b`` has, counted by peeling ever smaller blocks.

    A block of more than ``LEAF`` keys goes on as four blocks, by two more bits of its keys. Of a smaller one both sides are
    xor-ed into one set of cells, which is the difference of their sketches; if that does not peel, it goes on as four blocks
    too. ``open`` is how many are left after all bits: none, as different keys differ in their block or their cells.
    """
    peeled = _let(_peel(_cells("flatten(array(g.a, g.b))")), "t", "named_struct('g', g, 'ok', t.ok, 'n', t.n)")
    tried = f"transform(s.p, g -> if(size(g.a) + size(g.b) > {LEAF}, named_struct('g', g, 'ok', false, 'n', 0), {peeled}))"
    side = lambda c: f"filter(x.g.{c}, d -> (shiftrightunsigned(d, {BLOCK_SHIFT} + 2 * r) & 3L) = v)"
    parts = f"filter(transform(array(0L, 1L, 2L, 3L), v -> named_struct('a', {side('a')}, 'b', {side('b')})), y -> size(y.a) + size(y.b) > 0)"
    rest = f"flatten(transform(filter(z, x -> not x.ok), x -> {parts}))"
    step = _let(tried, "z", f"named_struct('p', {rest}, 'n', aggregate(z, s.n, (t, x) -> t + if(x.ok, x.n, 0)))")
    start = f"named_struct('p', array(named_struct('a', {a}, 'b', {b})), 'n', 0)"
    return f"aggregate(sequence(0, {(64 - BLOCK_SHIFT) // 2}), {start}, (s, r) -> if(size(s.p) = 0, s, {step}), s -> named_struct('open', size(s.p), 'n', s.n))"


def with_difference(d: DataFrame, a: str, b: str, sketch_a: str, sketch_b: str, out: str) -> DataFrame:
    """Adds ``out``: the number of pieces that only one of the piece lists ``a`` and ``b`` has.

    First from the stored one-block sketches; where they do not peel, larger sketches are made, block by block.
    """
    d = d.withColumn(f"{out}0", F.expr(_peel(_subtract(sketch_a, sketch_b))))
    d = d.withColumn(f"{out}1", F.expr(f"if({out}0.ok, named_struct('open', 0, 'n', {out}0.n), {_difference(a, b)})"))
    failed = F.raise_error(F.lit("a block of keys did not peel"))
    return d.withColumn(out, F.when(F.col(f"{out}1.open") == 0, F.col(f"{out}1.n")).otherwise(failed)).drop(f"{out}0", f"{out}1")


def fingerprint(count: str, sketch: str) -> Column:
    """Piece count and the one-block sketch as a string: ``count:cell;cell...`` in hexadecimal."""
    return F.expr(f"concat(cast({count} as string), ':', array_join(transform({sketch}, x -> if(x = 0, '', hex(x))), ';'))")


def likeness(a: str, b: str, d: str) -> Column:
    """Jaccard from the two counts and the size of the recovered difference (SQL names)."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1.0D, (size({a}) + size({b}) - {d}) / cast(size({a}) + size({b}) + {d} as double))")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = RANGE_ROWS, ranges: int = MAX_RANGES) -> DataFrame:
    """(doc_id, text, keys, next_text, next_keys, copies): the text of the row with the next smaller key, and for the last
    row the first row's, both with their pieces' keys, which are made once. Null keys come last; equal keys follow each other by their texts' hashes. ``copies`` rows are equal.

    Rows are dealt to ranges of (key, hash of the text), whose bounds come from a range partitioning of these
    numbers alone, so neither sparse keys nor many rows of one key make a range large. A window works
    inside a range only. A range's last row needs the first row of the range that follows: that one is added to it as a
    ghost. Equal rows that are more than a range holds (at most ``ranges`` such groups) are counted, and go on as
    two: one in its place, and one that stands for the others, each followed by its equal.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # in ascending order: no key, then ~key (which is -key - 1 and cannot overflow), then the hash
    place = ["n", "d", "h"]
    d = d.select("k", "t", F.col("k").isNull().alias("n"), F.bitwise_not(F.coalesce("k", F.lit(0).cast("long"))).alias("d"), F.xxhash64("t").alias("h"))
    light = materialize(d.select(*place), "places")
    total = light.count()
    rows = max(rows, -(-total // ranges))
    d = d.withColumn("a", pieces(F.col("t"))).withColumn("copies", F.lit(1).cast("long"))
    hot = materialize(light.groupBy(*place).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > rows).drop("c"), "hot")
    if not hot.isEmpty():
        many = d.join(F.broadcast(hot), place, "left_semi").groupBy("k", "t", *place).agg(F.sum("copies").alias("c")).withColumn("a", pieces(F.col("t")))
        many = materialize(many, "many")
        light = light.join(F.broadcast(hot), place, "left_anti").unionAll(hot)
        d = d.join(F.broadcast(hot), place, "left_anti").select("k", "t", "a", *place, "copies").unionAll(many.select("k", "t", "a", *place, F.lit(1).cast("long")))
    ranged = light.repartitionByRange(max(1, -(-total // rows)), *place).groupBy(F.spark_partition_id().alias("r")).agg(F.min(F.struct(*place)).alias("head"))
    heads = sorted((r["head"]["n"], r["head"]["d"], r["head"]["h"]) for r in ranged.collect())
    if not heads:
        return d.select(F.col("k").alias(key), F.col("t").alias(text), F.col("a").alias("keys"), F.col("t").alias("next_text"), F.col("a").alias("next_keys"), "copies")
    # a row's range is the last one whose first row is not behind it: found by halving, among bounds that are one constant
    bounds = "from_json('[" + ",".join(f'{{"n":{str(n).lower()},"d":{x},"h":{h}}}' for n, x, h in heads) + "]', 'array<struct<n:boolean,d:bigint,h:bigint>>')"
    steps = ", ".join(str(1 << i) for i in reversed(range(len(heads).bit_length())))
    d = d.withColumn("b", F.expr(f"aggregate(array({steps}), 0, (p, s) -> if(get({bounds}, p + s) <= struct(n, d, h), p + s, p))"))
    first = spark.createDataFrame([(*x, (i - 1) % len(heads)) for i, x in enumerate(heads)], "n boolean, d long, h long, goes int")
    ghosts = d.select("t", *place).join(F.broadcast(first), place).groupBy("goes").agg(F.min("t").alias("t"))
    ghosts = ghosts.select(F.lit(None).cast("long").alias("k"), "t", pieces(F.col("t")).alias("a"), F.lit(None).cast("boolean").alias("n"), F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("h"), F.lit(0).cast("long").alias("copies"), F.col("goes").alias("b"), F.lit(1).alias("ghost"))
    every = d.select("k", "t", "a", *place, "copies", "b", F.lit(0).alias("ghost")).unionAll(ghosts)
    w = Window.partitionBy("b").orderBy("ghost", *place, "t")
    out = every.select("k", "t", "a", "copies", "ghost", F.lead("t").over(w).alias("x"), F.lead("a").over(w).alias("c")).where("ghost = 0").select("k", "t", "a", "x", "c", "copies")
    if not hot.isEmpty():
        out = out.unionAll(many.where("c > 1").select("k", "t", "a", F.col("t").alias("x"), F.col("a").alias("c"), (F.col("c") - 1).alias("copies")))
    return out.select(F.col("k").alias(key), F.col("t").alias(text), F.col("a").alias("keys"), F.col("x").alias("next_text"), F.col("c").alias("next_keys"), "copies")


def edited(text: Column, next_text: Column) -> Column:
    """The text whose last half (rounded down) is replaced by as many first code points of the next."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.coalesce(next_text, F.lit("")), F.lit(1), half))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    the sizes of the recovered differences, for every whole text."""
    d = with_next(docs, key, text).select(F.col(key), F.col(text).alias("t"), F.col("next_text").alias("x"), F.col("copies").alias("copies_"), F.col("keys").alias("a"), F.col("next_keys").alias("c"))
    d = d.withColumn("e", edited(F.col("t"), F.col("x")))
    d = d.select(key, "copies_", F.length("t").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"), "a", pieces(F.col("e")).alias("b"), "c")
    for v in "abc":
        d = d.withColumn(f"s{v}", F.expr(_cells(v)))
    d = with_difference(d, "a", "b", "sa", "sb", "de")
    d = with_difference(d, "a", "c", "sa", "sc", "dn")
    # rows that stand for several equal ones
    once = F.when(F.col("copies_") > 1, F.sequence(F.lit(1).cast("long"), F.col("copies_"))).otherwise(F.array(F.lit(1).cast("long")))
    return d.withColumn("copy_", F.explode(once)).select(
        key,
        "n_chars",
        "edited_sha256",
        fingerprint("size(a)", "sa").alias("fingerprint"),
        fingerprint("size(b)", "sb").alias("edited_fingerprint"),
        likeness("a", "b", "de").alias("near_edited"),
        likeness("a", "c", "dn").alias("near_next"),
        F.col("de").cast("long").alias("edited_difference"),
        F.col("dn").cast("long").alias("next_difference"),
    )
