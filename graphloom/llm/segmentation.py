"""SentencePiece encoding and decoding with sampled segmentations.

A text's lattice has an edge for every vocabulary piece that fits at a position (and byte pieces for
a character that no piece covers). Its segmentations are drawn without replacement by the Gumbel
top-k trick, with a perturbed A-star search: the whole lattice is a region whose best perturbed
score is drawn first and whose best segmentation is then sampled; taking it out leaves regions (same path up to a
position, another piece there), each of which has its mass and, cut off by its parent's, its own best perturbed score; the
region of the highest is opened next. So the k results are distinct, ordered, and exact; the score
of the best region that is left is the threshold of the inclusion scores
1 - exp(-exp(logp - threshold)). All draws are functions of the row's key and the seed.

A piece's marks come first (runs of marks are pieces too), so no piece reaches over the start of a run of blanks or over
a line break, and a lattice falls apart into units: a run of blanks with the word that follows. Lattices of distinct units are kept
from chunk to chunk of a task, within a bound, and forward and sampling steps run over all units of a chunk together. A row's
numbers depend on its key and text alone, not on its chunk.

A model without probabilities (BPE) gives its merge order; a piece of rank r then has log
probability -alpha * log(r + 10), up to a constant; ``alpha`` flattens or sharpens the distribution.

Defined results for odd input: null and empty texts have one segmentation, the empty one (logp 0,
inclusion 1); a text with fewer segmentations than k gives all of them; a mark character in a text is
spelled in bytes, so decoding gives every text back exactly; repeated rows (equal key and text) get
equal results, a null key counts as key 0; a very long text is a chunk of its own; equal perturbed scores go to the earlier place;
an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._memory import slices
from graphloom.llm._shingles import _power, mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that stands for a space in pieces.
MARK = "▁"
#: Characters that are worked on at once; a worker needs about 250 bytes for each.
CHUNK_CHARS = 250_000
#: Characters of units whose lattices are kept from chunk to chunk, about 120 bytes each.
HELD_CHARS = 800_000
_B = np.uint64(0x9E3779B97F4A7C15)
_FIXED = float(1 << 32)
_FILTER_BITS = 21
_TABLE_BITS = 18


def vocabulary(path: str = MODEL, alpha: float = 1.0) -> dict:
    """The lattice's tables of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces, ids, ranks, byte = [], [], [], np.full(256, -1, np.int64)
    for i in range(n):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte[int(p[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and p and " " not in p and "\n" not in p:
            if MARK in p.lstrip(MARK):
                raise ValueError(f"piece {p!r} goes on over the start of a word: units would not be independent")
            pieces.append(p.replace(MARK, " "))
            ids.append(i)
            ranks.append(max(0.0, -sp.get_score(i)))
    score = -alpha * np.log(np.array(ranks) + 10.0)
    score -= np.log(np.exp(score).sum())
    width = max(map(len, pieces))
    if width > 31:
        raise ValueError(f"a piece has {width} characters: sizes are marked in 32 bits")
    keys = hashes(pieces)
    order = np.argsort(keys)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two pieces have one hash")
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[keys >> np.uint64(64 - _FILTER_BITS)] = True
    more = np.zeros(1 << _FILTER_BITS, bool)
    more[hashes(sorted({p[:i] for p in pieces for i in range(1, len(p))})) >> np.uint64(64 - _FILTER_BITS)] = True
    # a slot for most keys; keys whose slot is taken are looked up among themselves
    sorted_keys = keys[order]
    table = np.zeros(1 << _TABLE_BITS, np.int32)
    slots = (sorted_keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
    table[slots[::-1]] = np.arange(len(keys))[::-1]
    late = np.flatnonzero(table[slots] != np.arange(len(keys)))
    late = late if len(late) else np.zeros(1, np.int64)
    return {"more": more, "table": table, "late": sorted_keys[late], "late_at": late, "keys": keys[order], "ids": np.array(ids, np.int64)[order], "score": score[order], "bits": bits, "width": width, "byte": byte, "byte_score": float(score.min()) - 1.0, "n": n}


def hashes(words: list[str]) -> np.ndarray:
    """Hash of each string: a polynomial over its code points, then mixed."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        h = 0
        for ch in w:
            h = (h * int(_B) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return mixed(out)


class Units:
    """Lattices of distinct units, as arrays; they stay from chunk to chunk, so a word that comes again is not built again.

    A unit's positions (characters) follow each other, ``start`` is the first of each unit, and ``left`` the characters from a
    position to the unit's end; ``first[at]`` to ``first[at + 1]`` are the edges from a position, by size. Of an edge: ``size`` in
    characters, ``piece`` (-2: bytes), ``p``, its probability given that a path reaches the position, ``cum``, the running sum of
    these (2 at the last), and ``rest``, what the other edges have. A unit's numbers depend on the unit alone.

    Units are found by a 64-bit hash and then compared character by character, so equal hashes do no harm.
    Beyond ``limit`` characters those units that were seen once go, and of the others the rarest: that costs the time to
    build them again if they come again, and changes no result.
    """

    UNIT = {"start": np.int64, "length": np.int64, "hash": np.uint64, "seen": np.int64}
    PLACE = {"char": np.uint32, "left": np.int32, "degree": np.int8}
    EDGE = {"size": np.int8, "piece": np.int32, "p": np.float32, "cum": np.float32, "rest": np.float32}

    def __init__(self, v: dict, limit: int = HELD_CHARS):
        self.v, self.limit = v, limit
        self.room = {c: np.empty(1024, t) for part in (self.UNIT, self.PLACE, self.EDGE) for c, t in part.items()}
        self.room["first"] = np.zeros(1024, np.int64)
        self._empty()

    def _empty(self) -> None:
        self.units = self.n = self.edges = 0
        self.slots = np.full(1 << 12, -1, np.int32)

    def _add(self, columns: dict, at: int) -> None:
        """Appends to columns that hold ``at`` values; their room grows by half."""
        for c, x in columns.items():
            held = self.room[c]
            if at + len(x) > len(held):
                self.room[c] = np.empty(max(at + len(x), len(held) * 3 // 2), held.dtype)
                self.room[c][:at] = held[:at]
            self.room[c][at : at + len(x)] = x

    def _index(self, units: np.ndarray) -> None:
        """Gives units a slot, which starts at the upper bits of their hash and goes on to the next free one."""
        if self.units * 3 > len(self.slots):
            self.slots = np.full(1 << (self.units * 6).bit_length(), -1, np.int32)
            units = np.arange(self.units)
        at = self._slot(self.room["hash"][units])
        while len(units):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = units[free]
            rest = np.flatnonzero(self.slots[at] != units)
            units, at = units[rest], (at[rest] + 1) & (len(self.slots) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The unit of each hash, or -1."""
        out, ask, at = np.full(len(h), -1, np.int64), np.arange(len(h)), self._slot(h)
        while len(ask):
            unit = self.slots[at]
            same = (unit >= 0) & (self.room["hash"][unit] == h[ask])
            out[ask[same]] = unit[same]
            on = np.flatnonzero((unit >= 0) & ~same)
            ask, at = ask[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def codes(self, c: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of the units that lie in ``c`` (code points) from ``begin`` on, which hold until the next call."""
        if self.n > self.limit:
            self._shrink()
        h = unit_hashes(c, begin, lengths)
        out = self._find(h)
        new = np.flatnonzero(out < 0)
        if len(new):
            _, one, which = np.unique(h[new], return_index=True, return_inverse=True)
            out[new] = self.units + which
            self._build(c, begin[new[one]], lengths[new[one]], h[new[one]])
            self._index(np.arange(self.units - len(one), self.units))
        # another unit of an equal hash is built by itself
        other = np.flatnonzero(self.room["length"][out] != lengths)
        if not len(other):
            at = np.repeat(self.room["start"][out] - begin, lengths) + np.arange(len(c))
            wrong = np.flatnonzero(self.room["char"][at] != c)
            other = np.unique(np.searchsorted(begin, wrong, side="right") - 1)
        else:
            other = np.arange(len(out))
        if len(other):
            out[other] = self.units + np.arange(len(other))
            self._build(c, begin[other], lengths[other], h[other])
        seen = self.room["seen"][: self.units]
        seen += np.bincount(out, minlength=self.units)
        return out

    def _build(self, c: np.ndarray, begin: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> None:
        places, edges = build(c[_ranges(begin, lengths)], lengths, self.v)
        self._append(places, edges, lengths, h, np.zeros(len(lengths), np.int64))

    def _append(self, places: dict, edges: dict, lengths: np.ndarray, h: np.ndarray, seen: np.ndarray) -> None:
        self._add({"start": self.n + np.cumsum(lengths) - lengths, "length": lengths, "hash": h, "seen": seen}, self.units)
        self._add({"first": self.edges + np.cumsum(places["degree"], dtype=np.int64)}, self.n + 1)
        self._add(places, self.n)
        self._add(edges, self.edges)
        self.units += len(lengths)
        self.n += len(places["left"])
        self.edges += len(edges["size"])

    def _shrink(self) -> None:
        """Keeps the units that were seen most, up to a half of the limit."""
        r = self.room
        seen, lengths = r["seen"][: self.units], r["length"][: self.units]
        order = np.argsort(-seen, kind="stable")
        keep = np.sort(order[(np.cumsum(lengths[order]) <= self.limit // 2) & (seen[order] > 1)])
        begin, size = r["start"][keep], lengths[keep]
        at = _ranges(begin, size)
        out = _ranges(r["first"][begin], r["first"][begin + size] - r["first"][begin])
        held = {c: r[c][at] for c in self.PLACE}, {c: r[c][out] for c in self.EDGE}, size.copy(), r["hash"][keep], seen[keep] // 2
        self._empty()
        self._append(*held)
        self._index(np.arange(self.units))


def split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each with a blank ahead (texts without characters: nothing), where the units begin, their
    lengths, and the number of units of each text. A unit is a run of blanks with the word that follows, a word, or a line break."""
    c = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts)))
    line = c == 10
    start = c == 32
    start[1:] &= c[:-1] != 32
    start |= line
    start[1:] |= line[:-1]
    if len(c):
        begins = np.r_[0, ends[:-1]]
        start[begins[begins < len(c)]] = True
    begin = np.flatnonzero(start)
    return c, begin, np.diff(np.r_[begin, len(c)]), np.diff(np.r_[0, np.searchsorted(begin, ends)])


def unit_hashes(c: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Polynomials over the units' code points, mixed: sums that begin at one place for all, brought back to the unit's own."""
    term = (c + np.uint64(1)) * _power(len(c))[: len(c)]
    sums = np.r_[np.uint64(0), np.cumsum(term)]
    return mixed((sums[begin + lengths] - sums[begin]) * _inverse(len(c))[begin])


_inverses = np.ones(1, np.uint64)


def _inverse(n: int) -> np.ndarray:
    """The inverses of the first n powers (modulo 2^64)."""
    global _inverses
    if len(_inverses) < n:
        one = np.uint64(pow(int(_power(2)[1]), -1, 1 << 64))
        _inverses = np.r_[np.uint64(1), np.cumprod(np.full(n * 3 // 2, one, np.uint64))]
    return _inverses


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after another."""
    ahead = np.cumsum(size) - size
    return np.repeat(begin - ahead, size) + np.arange(int(size.sum()))


def build(c: np.ndarray, lengths: np.ndarray, v: dict) -> tuple[dict, dict]:
    """Positions and edges of units (their code points one after another), as ``Units`` holds them.

    Edges are laid out by their position's distance to the unit's end, so a step of the backward pass
    (masses from the ends on) works on a run of them, and are put in text order last.
    """
    n = len(c)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    order = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n)
    rank[n] = n
    code = c.astype(np.uint64) + np.uint64(1)
    h = code.copy()
    at, on, found = np.arange(n), np.zeros(n, bool), []
    degree = np.zeros(n, np.int64)
    for size in range(1, v["width"] + 1):
        if size > 1:
            # only on from what begins some longer piece
            at = at[on]
            at = at[left[at] >= size]
            if not len(at):
                break
            h[at] = h[at] * _B + code[at + size - 1]
        key = mixed(h[at])
        slot = key >> np.uint64(64 - _FILTER_BITS)
        on, may = v["more"][slot], v["bits"][slot]
        some, key = at[may], key[may]
        where = v["table"][(key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
        hit = v["keys"][where] == key
        # the few keys whose slot another key has taken
        lost = np.flatnonzero(~hit)
        if len(lost):
            w = np.minimum(np.searchsorted(v["late"], key[lost]), len(v["late"]) - 1)
            ok = v["late"][w] == key[lost]
            where[lost[ok]], hit[lost[ok]] = v["late_at"][w[ok]], True
        some, where = some[hit], where[hit]
        ids, score = v["ids"][where], v["score"][where]
        if size == 1:
            # a character without a piece of its own is spelled in bytes
            self_ids, self_score = np.full(n, -2, np.int64), v["byte_score"] * bytes_of(c)
            self_ids[some], self_score[some] = ids, score
            some, ids, score = np.arange(n), self_ids, self_score
        if len(some):
            found.append((size, some, ids, score))
            degree[some] += 1
    by_left = degree[order]
    first = np.r_[0, np.cumsum(by_left)]
    total = int(first[-1])
    size, piece, p, to = np.empty(total, np.int8), np.empty(total, np.int32), np.empty(total, np.float32), np.empty(total, np.int64)
    filled = first[:-1].copy()
    for step, some, ids, score in found:
        place = rank[some]
        e = filled[place]
        size[e], piece[e], p[e], to[e] = step, ids, score, rank[np.where(left[some] == step, n, some + step)]
        filled[place] += 1
    # log mass from each position to the end of its unit, from the ends on
    mass = np.zeros(n + 1, np.float32)
    rest = np.empty(total, np.float32)
    far = left[order]
    bounds = np.searchsorted(far, np.arange(1, (int(far[-1]) if n else 0) + 2))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if lo == hi:
            continue
        a, b = int(first[lo]), int(first[hi])
        starts, counts = first[lo:hi] - a, by_left[lo:hi]
        s = p[a:b] + mass[to[a:b]]
        top = np.maximum.reduceat(s, starts)
        s = np.exp(s - np.repeat(top, counts))
        sums = np.add.reduceat(s, starts)
        mass[lo:hi] = top + np.log(sums)
        s /= np.repeat(sums, counts)
        p[a:b] = s
        # what the other edges have: summed where an edge has most, so that little is not lost
        most = s > 0.5
        rest[a:b] = np.where(most, np.repeat(np.add.reduceat(np.where(most, np.float32(0), s), starts), counts), 1 - s)
    cum, head, count = p.copy(), first[:-1], by_left
    for step in range(1, int(degree.max()) if n else 0):
        more = count > step
        head, count = head[more], count[more]
        cum[head + step] += cum[head + step - 1]
    cum[first[1:] - 1] = 2.0
    back = _ranges(first[:-1][rank[:-1]], degree)
    edges = {"size": size[back], "piece": piece[back], "p": p[back], "cum": cum[back], "rest": rest[back]}
    return {"char": c, "left": left, "degree": degree}, edges


def bytes_of(c: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))


def uniform(seed: np.ndarray, slot: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that a row's seed, a place and the draw's salt decide."""
    h = mixed(seed ^ ((slot.astype(np.uint64) + np.uint64(salt << 40)) * _B))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def below(g: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """The perturbed score g of a region, cut off at cap: -log(exp(-cap) + exp(-g)); no region (-inf) stays none."""
    return np.where(g > -np.inf, -np.logaddexp(-cap, -np.maximum(g, -1e300)), -np.inf)


class Paths:
    """Segmentations of rows, their pieces one after another, by row and place.

    row; at (position in ``Units``); edge; slot (number of the piece's first character within its row, so equal
    places of two paths of a row have equal slots); p (conditional probability); taken (bits of the sizes besides the
    piece's own that no later path with this prefix may take here); live (the place starts a region: not so before the
    place where the path left an earlier one). ``rest`` is the probability of a place's other pieces, where it is not the edge's."""

    COLUMNS = ("row", "at", "edge", "slot", "p", "taken", "live")

    def __init__(self, row, at, edge, slot, p, taken=None, live=None, rest=None):
        self.row, self.at, self.edge, self.slot, self.p = row, at, edge, slot, p
        self.taken = np.zeros(len(row), np.int32) if taken is None else taken
        self.live = np.ones(len(row), bool) if live is None else live
        self.rest = rest
        self.starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)

    def part(self, some) -> list[np.ndarray]:
        return [getattr(self, c)[some] for c in self.COLUMNS]


def walk(lat: Units, row: np.ndarray, at: np.ndarray, slot: np.ndarray, seeds: np.ndarray, salt: int) -> Paths:
    """Samples a path from each position ``at`` to the end of its unit, all units a piece at a time."""
    r = lat.room
    cum, first, sizes, probs = r["cum"], r["first"], r["size"], r["p"]
    steps, taken, alive = [], np.zeros(len(row), np.int64), np.arange(len(row))
    here, place, own, left = at, slot, seeds[row], r["left"][at]
    while len(alive):
        u = uniform(own, place, salt)
        edge = first[here]
        # on to the next edge while the running sum stays below the draw (a position's last edge ends above 1)
        go = np.flatnonzero(cum[edge] <= u)
        while len(go):
            edge[go] += 1
            go = go[cum[edge[go]] <= u[go]]
        steps.append((alive, here, edge, place))
        taken[alive] += 1
        size = sizes[edge]
        left = left - size
        more = np.flatnonzero(left > 0)
        size = size[more]
        alive, place, here, own, left = alive[more], place[more] + size, here[more] + size, own[more], left[more]
    offset = np.cumsum(taken) - taken
    total = int(taken.sum())
    out = [np.empty(total, np.int64) for _ in range(3)]
    for t, (alive, *values) in enumerate(steps):
        where = offset[alive] + t
        for o, x in zip(out, values):
            o[where] = x
    at, edge, place = out
    return Paths(np.repeat(row, taken), at, edge, place, probs[edge])


def sample(texts: list[str | None], keys: np.ndarray, k: int, lat: Units, seed: int) -> tuple[list[dict], np.ndarray]:
    """Up to k segmentations of each text: for each rank a dict of rows, score (perturbed), logp and
    path, and each row's threshold (the best perturbed score that is left)."""
    c, begin, lengths, counts = split(texts)
    n = len(texts)
    unit_row = np.repeat(np.arange(n), counts)
    codes = lat.codes(c, begin, lengths)
    unit_at = lat.room["start"][codes]
    unit_slot = begin - begin[(np.cumsum(counts) - counts)[unit_row]]
    seeds = mixed(keys.astype(np.int64).view(np.uint64) ^ mixed(np.array([seed], np.uint64)))

    path = walk(lat, unit_row, unit_at, unit_slot, seeds, 0)
    score = gumbel(uniform(seeds, np.zeros(n, np.int64), 3000))
    out: list[dict] = []
    rows = np.arange(n)
    held: list[tuple[Paths, np.ndarray, np.ndarray]] = []
    for r in range(k + 1):
        if r:
            best, who = np.full(n, -np.inf), np.full(n, -1)
            for i, (p, free, cap) in enumerate(held):
                if len(p.starts):
                    of = p.row[p.starts]
                    # a path's regions are cut off at one score, which keeps their order
                    top = below(np.maximum.reduceat(free, p.starts), cap[of])
                    up = top > best[of]
                    best[of[up]], who[of[up]] = top[up], i
            rows = np.flatnonzero(np.isfinite(best))
            if r == k or not len(rows):
                return out, best
            score = best
            path = branch(lat, held, who, seeds, r, unit_row, unit_at, unit_slot)
        # logs in units of 2^-32: their sums do not depend on what else is in the chunk
        logs = np.log(np.maximum(path.p, np.float32(1e-37)), dtype=np.float64)
        logs = (logs * _FIXED).astype(np.int64)
        ahead = np.cumsum(logs) - logs
        ends = np.r_[path.starts[1:], len(logs)][: len(path.starts)] - 1
        logp = np.zeros(n)
        logp[path.row[path.starts]] = (ahead[ends] + logs[ends] - ahead[path.starts]) / _FIXED
        out.append({"rows": rows, "score": score[rows], "logp": logp[rows], "path": path})
        # the regions that the path leaves: at each live place, the pieces that are not taken
        rest = lat.room["rest"][path.edge].astype(np.float64)
        if path.rest is not None:
            rest[path.rest[0]] = path.rest[1]
        free = np.full(len(logs), -np.inf)
        some = np.flatnonzero(path.live & (rest > 0))
        row = path.row[some]
        mass = (ahead[some] - ahead[_first_of(path, n)[row]]) / _FIXED + np.log(rest[some])
        free[some] = mass + gumbel(uniform(seeds[row], path.slot[some], 1000 + r))
        held.append((path, free, score))
    raise AssertionError("not reached")


def _first_of(path: Paths, n: int) -> np.ndarray:
    """Each row's first piece."""
    out = np.zeros(n, np.int64)
    out[path.row[path.starts]] = path.starts
    return out


def branch(lat: Units, held: list, who: np.ndarray, seeds: np.ndarray, r: int, unit_row: np.ndarray, unit_at: np.ndarray, unit_slot: np.ndarray) -> Paths:
    """The next path of each row that has a region (``who``: whose path it is of): that path up to the
    region's place, a piece there that is not taken, and a fresh path from there on. The region is
    closed; what is left of it starts at the new path's place."""
    c = lat.room
    parts, rests = [], []
    for i, (p, free, _) in enumerate(held):
        mine = who == i
        if not mine.any():
            continue
        top = np.full(len(who), np.nan)
        top[p.row[p.starts]] = np.maximum.reduceat(free, p.starts)
        where = np.flatnonzero(mine[p.row] & (free == top[p.row]))
        where = where[np.r_[True, p.row[where][1:] != p.row[where][:-1]]]
        free[where] = -np.inf
        row, at, slot = p.row[where], p.at[where], p.slot[where]
        taken = p.taken[where] | np.left_shift(1, c["size"][p.edge[where]].astype(np.int32))
        turn = np.full(len(who), -1, np.int64)
        turn[row] = slot
        kept = p.part(np.flatnonzero(p.slot < turn[p.row]))
        kept[-1][:] = False
        # the place's edges, those that are taken at probability 0
        count = c["first"][at + 1] - c["first"][at]
        edges = c["first"][at][:, None] + np.arange(int(count.max()))
        there = edges < c["first"][at + 1][:, None]
        edges = np.where(there, edges, c["first"][at][:, None])
        probs = np.where(there & ((taken[:, None] >> c["size"][edges]) & 1 == 0), c["p"][edges].astype(np.float64), 0.0)
        cum = np.cumsum(probs, axis=1)
        u = uniform(seeds[row], slot, 2000 + r) * cum[:, -1]
        pick = np.minimum((cum <= u[:, None]).sum(1), probs.shape[1] - 1)
        edge = edges[np.arange(len(at)), pick]
        size = c["size"][edge].astype(np.int64)
        probs[np.arange(len(at)), pick] = 0
        changed = [row, at, edge, slot, c["p"][edge], taken, np.ones(len(row), bool)]
        go = c["left"][at] > size
        later = np.flatnonzero((unit_slot > turn[unit_row]) & mine[unit_row])
        fresh = [np.concatenate(x) for x in ((row[go], unit_row[later]), ((at + size)[go], unit_at[later]), ((slot + size)[go], unit_slot[later]))]
        order = np.argsort(fresh[0] << 36 | fresh[2])
        new = walk(lat, *[x[order] for x in fresh], seeds, r).part(slice(None))
        cols, at_changed = _in_rows([kept, changed, new], len(who))
        parts.append(cols)
        rests.append((at_changed, probs.sum(1)))
    if len(parts) == 1:
        return Paths(*parts[0], rest=rests[0])
    ahead = np.cumsum([0] + [len(x[0]) for x in parts])
    cols = [np.concatenate(x) for x in zip(*parts)]
    order = np.argsort(cols[0], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Paths(*[x[order] for x in cols], rest=(place[np.concatenate([a + x for a, (x, _) in zip(ahead.tolist(), rests)])], np.concatenate([x for _, x in rests])))


def _in_rows(groups: list[list], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Three groups of columns, each sorted by its first (the row), as one: by row, and within a row group after group;
    and where the second group's rows are."""
    counts = [np.bincount(g[0], minlength=n) for g in groups]
    total = sum(counts)
    base = np.cumsum(total) - total
    out = [np.empty(int(total.sum()), c.dtype) for c in groups[0]]
    places = []
    for g, k in zip(groups, counts):
        places.append(np.arange(len(g[0])) + np.repeat(base - (np.cumsum(k) - k), k))
        base = base + k
        for o, c in zip(out, g):
            o[places[-1]] = c
    return out, places[1]


def ids_of(lat: Units, path: Paths, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all pieces, bytes spelled out, and where each of the n rows ends."""
    byte = lat.v["byte"]
    ids = lat.room["piece"][path.edge]
    rows = np.bincount(path.row, minlength=n)
    odd = np.flatnonzero(ids == -2)
    if len(odd):
        chars = lat.room["char"][path.at[odd]]
        size = bytes_of(chars)
        ids[odd] = byte[np.minimum(chars, 127)]
        spelled = np.ones(len(ids), np.int64)
        spelled[odd] = size
        long = np.flatnonzero(size > 1)
        first = (np.cumsum(spelled) - spelled)[odd[long]]
        ids = np.repeat(ids, spelled)
        for at, ch in zip(first.tolist(), chars[long].tolist()):
            for b, x in enumerate(chr(ch).encode("utf-8", "surrogatepass")):
                ids[at + b] = byte[x]
        rows += np.bincount(path.row[odd], size - 1, n).astype(np.int64)
    return ids, np.cumsum(rows)


def decoder(path: str = MODEL) -> list[bytes]:
    """Bytes of each piece id; control pieces have none."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    spell = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
    return [spell(i) for i in range(sp.vocab_size())]


def decode(ids, spell: list[bytes]) -> str:
    """The text of piece ids: pieces joined, marks as spaces, without the leading one."""
    return b"".join(map(spell.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def pieces_to_text(encoded: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the decoded text of a column of piece ids (null ids: null)."""
    spell = encoded.sparkSession.sparkContext.broadcast(decoder(model))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if x is None else decode(x, spell.value) for x in b], dtype=object)

    return encoded.withColumn(out, text(ids))


def segment(
    docs: DataFrame,
    k: int = 2,
    model: str = MODEL,
    alpha: float = 1.0,
    seed: int = 11,
    key: str = "doc_id",
    text: str = "text",
    draw: str | None = None,
    carry: tuple[str, ...] = (),
    emit_ids: bool = True,
    chunk_chars: int = CHUNK_CHARS,
    held_chars: int = HELD_CHARS,
) -> DataFrame:
    """Up to k distinct sampled segmentations of every whole text: ``key``, ``carry``, rank (1 is the best
    perturbed score), n_pieces, logp, score, inclusion, digest (SHA-256 of the ids as little-endian
    32-bit numbers), round_trip (the segmentation decodes to the text) and, with
    ``emit_ids``, ids. ``draw`` is the number that, with the seed, decides a row's draws: the key, if not another column.
    """
    import hashlib

    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary(model, alpha), decoder(model)))
    names = [f"c{i}" for i in range(len(carry))]
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(draw or key).cast("long").alias("draw"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, names)])
    kinds = {"key": pa.int64()} | {n: to_arrow_type(d.schema[n].dataType) for n in names}
    kinds |= {"rank": pa.int32(), "n_pieces": pa.int64(), "logp": pa.float64(), "score": pa.float64(), "inclusion": pa.float64(), "digest": pa.string(), "round_trip": pa.bool_()}
    fields = "key long" + "".join(f", {n} {d.schema[n].dataType.simpleString()}" for n in names) + ", rank int, n_pieces long, logp double, score double, inclusion double, digest string, round_trip boolean"
    if emit_ids:
        kinds["ids"], fields = pa.list_(pa.int32()), fields + ", ids array<int>"

    def pieces(rows: dict[str, list], lat: Units) -> pa.RecordBatch:
        spell, texts = shared.value[1], rows["text"]
        numbers = np.array([0 if x is None else x for x in rows["draw"]], np.int64)
        found, limit = sample(texts, numbers, k, lat, seed)
        cols: dict[str, list] = {x: [] for x in (*kinds, "ids")}
        for r, f in enumerate(found):
            ids, ends = ids_of(lat, f["path"], len(texts))
            ids = ids.astype("<i4")
            hi = ends[f["rows"]]
            lo = np.r_[0, ends][f["rows"]]
            with np.errstate(over="ignore"):
                inclusion = -np.expm1(-np.exp(np.minimum(f["logp"] - limit[f["rows"]], 700)))
            for i, a, b in zip(f["rows"].tolist(), lo.tolist(), hi.tolist()):
                own = ids[a:b]
                cols["digest"].append(hashlib.sha256(own.tobytes()).hexdigest())
                cols["round_trip"].append(decode(own.tolist(), spell) == (texts[i] or ""))
                for c in ("key", *names):
                    cols[c].append(rows[c][i])
                if emit_ids:
                    cols["ids"].append(own)
            cols["rank"] += [r + 1] * len(f["rows"])
            cols["n_pieces"] += (hi - lo).tolist()
            cols["logp"] += f["logp"].tolist()
            cols["score"] += f["score"].tolist()
            cols["inclusion"] += inclusion.tolist()
        return pa.RecordBatch.from_pydict({c: pa.array(cols[c], t) for c, t in kinds.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Units(shared.value[0], held_chars)
        for part in slices(batches, 2_000):
            rows = dict(zip(("key", "draw", "text", *names), part))
            lo = size = 0
            for i, t in enumerate(rows["text"]):
                size += len(t) if t else 0
                if size >= chunk_chars or i + 1 == len(rows["text"]):
                    yield pieces({c: x[lo : i + 1] for c, x in rows.items()}, lat)
                    lo, size = i + 1, 0

    out = d.mapInArrow(run, fields)
    return out.select(F.col("key").alias(key), *[F.col(n).alias(c) for n, c in zip(names, carry)], *[c for c in out.columns if c not in ("key", *names)])
