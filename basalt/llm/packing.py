"""Best-fit packing by bin completion.

Documents become token IDs plus one end token; longer ones than a sequence are cut, no others. How well
pieces fit depends on their lengths alone, so the search sees a histogram: at most `capacity` numbers,
whatever the data's size. Bin completion takes the largest length left, enumerates undominated fillings
of the rest of its sequence, and applies the best as often as the counts allow. Best-fit solutions are
the incumbents; the branch and bound goes on to other fillings only while waste above the lower bound is left.
The bound is the largest of the bounds by total length, by items that cannot share a sequence, and by dual
feasible functions (Martello and Toth's L2; Fekete and Schepers).

A piece's place follows from its length and its rank among pieces of that length. Ranks are dealt within
parts of bounded size, so no task gets all pieces of a common length.

Null texts are empty: one piece, the end token. Repeated rows are packed each for itself. An empty table
gives an empty result. Columns besides doc_id and text are not read.
"""
from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import stored, text_batches, texts

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that one task ranks.
PART = 50_000
#: Steps of enumeration that count as a node of the search.
STEPS = 100
#: Words whose IDs a worker keeps: about 200 bytes each.
_CACHE_WORDS = 300_000
_LONG_WORD = 64
#: Letters whose lower case and normal form are plain, then marks: two tokenizer words at most, told by rule.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|]*)")
#: str.split() cuts at these too, the tokenizer's white space does not hold them.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 for
    itself, the rest in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token IDs as little-endian unsigned 32-bit bytes.

    The tokenizer never joins text across white space, so IDs are kept by word and each distinct word is
    encoded once while it stays in the cache. Words of plain letters, with marks after them or not, go straight
    to the tokenizer's model; all others through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.words, self.parts = Tokenizer.from_file(path), {}, {}
        self.model, self.letters = self.tok.model, _byte_letters()

    def _encode(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    def _part(self, s: str) -> bytes:
        got = self.parts.get(s)
        if got is None:
            seen = s if s.isascii() else "".join(map(self.letters.__getitem__, s.encode()))
            got = np.array([t.id for t in self.model.tokenize(seen)], "<u4").tobytes()
            if len(s) <= _LONG_WORD:
                self.parts[s] = got
        return got

    def _word(self, w: str) -> bytes:
        m = _PLAIN.fullmatch(w)
        if not m:
            return self._encode([w])[0]
        return self._part(m[1].lower()) + (self._part(m[2]) if m[2] else b"")

    def batch(self, strings: list[str]) -> Iterator[bytes]:
        known = self.words
        if len(known) + len(self.parts) > _CACHE_WORDS:
            known.clear()
            self.parts.clear()
        for s in strings:
            if _ODD_SPACE.search(s):
                yield self._encode([s])[0]
                continue
            words = s.split()
            try:
                yield b"".join(map(known.__getitem__, words))
            except KeyError:
                new = set(words).difference(known)
                for w in new:
                    known[w] = self._word(w)
                yield b"".join(map(known.__getitem__, words))
                for w in new:
                    if len(w) > _LONG_WORD:
                        del known[w]


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The worker's encoder: its cache lasts from task to task."""
    return Encoder(path)


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        enc = _encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            out = []
            for i, ids in zip(b.column("doc_id").to_pylist(), enc.batch(b.column("text").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, _PIECES)


# -- the search ------------------------------------------------------------------


@functools.lru_cache(maxsize=4)
def _weights(capacity: int, kinds: int = 20) -> np.ndarray:
    """Row k: k * capacity times the dual feasible value of each length; row 0: capacity times its share of a sequence.

    Value k is floor((k + 1) x / capacity) / k, or the share itself where that division is even."""
    x = np.arange(capacity + 1, dtype=np.int64)
    rows = [x]
    for k in range(1, kinds + 1):
        even = (k + 1) * x % capacity == 0
        rows.append(np.where(even, k * x, (k + 1) * x // capacity * capacity))
    return np.stack(rows)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: for every e up to half a sequence, lengths below e count nothing, those above
    capacity - e a whole sequence, the others each of the values of _weights."""
    if not counts:
        return 0
    weights = _weights(capacity)
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    sums = np.zeros((len(weights), capacity + 2), np.int64)
    np.cumsum(weights * n, axis=1, out=sums[:, 1:])
    number = np.concatenate([[0], np.cumsum(n)])
    e = np.arange(0, capacity // 2 + 1)
    whole = number[-1] - number[capacity - e + 1]
    middle = sums[:, capacity - e + 1] - sums[:, e]
    unit = np.array([capacity, *(k * capacity for k in range(1, len(weights)))])[:, None]
    return int((whole - (-middle // unit)).max())


def _spread(sums: int, by: int) -> int:
    """Bits of sums, each also at the `by` places above."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        sums |= sums << step
        done += step
    return sums


def dominated(filling: tuple[tuple[int, int], ...], waste: int, counts: dict[int, int], available: int) -> bool:
    """Whether a piece that is left may take the place of nothing, of a shorter piece of the filling, or of several pieces
    together no longer than it. available: a bit for each length in counts."""
    ones, several = 1, 0  # bits: nothing and single pieces; sums of two pieces or more
    for x, n in filling:
        if counts[x] == n:
            available &= ~(1 << x)
        for _ in range(n):
            several |= (several << x) | ((ones & ~1) << x)
            ones |= 1 << x
    return bool(available & (_spread(ones << 1, waste - 1) if waste else 0) or available & _spread(several, waste))


def fillings(room: int, counts: dict[int, int], lengths: list[int], limit: int = 400, every: bool = False) -> tuple[list[tuple[tuple[int, int], ...]], bool, int]:
    """Fillings ((length, how often), ...) of room, least waste first, larger pieces first among equals; whether these
    are all; and the steps taken.

    Dominated fillings are left out, unless the enumeration ended before it met an undominated one. Enumeration takes
    longer lengths first and stops after limit fillings or 20 * limit steps, or, unless every is set, at once when nothing is wasted."""
    found: list[tuple[int, tuple]] = []
    fit = [x for x in lengths if x <= room]
    smallest = fit[-1] if fit else 0
    available = sum(1 << x for x in fit)
    spare: list[tuple[int, tuple]] = []
    steps = [0]

    def go(k: int, left: int, chosen: tuple) -> bool:
        steps[0] += 1
        if left == 0 or not fit or left < smallest or k == len(fit):
            if not dominated(chosen, left, counts, available):
                found.append((left, chosen))
            elif not found and (not spare or left < spare[0][0]):
                spare[:] = [(left, chosen)]
            return left == 0 and not every or len(found) >= limit or steps[0] > 20 * limit
        x = fit[k]
        if x > left:  # skip to the first length that fits
            lo, hi = k, len(fit)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if fit[mid] > left else (lo, mid)
            return go(lo, left, chosen)
        for n in range(min(left // x, counts[x]), -1, -1):
            if go(k + 1, left - n * x, (*chosen, (x, n)) if n else chosen):
                return True
        return False

    import sys

    old = sys.getrecursionlimit()
    sys.setrecursionlimit(max(old, 4 * len(fit) + 1000))
    try:
        stopped = go(0, room, ())
    finally:
        sys.setrecursionlimit(old)
    best = [c for _, c in sorted(found or spare, key=lambda f: (f[0], [-x for x, n in f[1] for _ in range(min(n, 8))]))]
    return best or [()], not stopped, steps[0]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over the histogram: each piece, longest first, goes to the fullest sequence that has room.
    Sequences of equal filling are one entry; a sequence that takes one piece of a length takes all that fit."""
    open_: dict[int, dict[tuple, int]] = {}  # room: sequences by filling
    for x in sorted((x for x, n in counts.items() if n), reverse=True):
        n = counts[x]
        for room in [r for r in sorted(open_) if r >= x] + [capacity]:
            k = room // x
            groups = list(open_.pop(room, {}).items()) if room < capacity else [((), n)]
            for filling, c in groups:
                full = min(c, n // k)
                rest = min(n - full * k, k - 1) if c > full else 0
                n -= full * k + rest
                for m, took in ((full, k), (1 if rest else 0, rest), (0 if room == capacity else c - full - (rest > 0), 0)):
                    if m:
                        after = open_.setdefault(room - took * x, {})
                        key = (*filling, (x, took)) if took else filling
                        after[key] = after.get(key, 0) + m
    return [(f, m) for groups in open_.values() for f, m in groups.items()]


def longest_first(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """First-fit decreasing over the histogram, a sequence at a time: another incumbent."""
    left, out = {x: n for x, n in counts.items() if n}, []
    lengths = sorted(left, reverse=True)
    while lengths:
        bin_, room = [], capacity
        for x in lengths:
            n = min(left[x], room // x)
            if n:
                bin_.append((x, n))
                room -= n * x
        times = min(left[x] // n for x, n in bin_)
        for x, n in bin_:
            left[x] -= n * times
        lengths = [x for x in lengths if left[x]]
        out.append((tuple(bin_), times))
    return out


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 20_000, branches: int = 3) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns [(((length, how often), ...), times)] that use up counts in few sequences.

    Depth first over the fillings of the largest length left, fewest sequences first found by best fit. A
    branch ends when its waste so far leaves it no better than the incumbent. The first pass takes `branches`
    fillings a node; each next pass three times as many, out of three times as long an enumeration, until no filling
    was left out. The search ends at the lower bound or after `nodes` nodes in all passes; STEPS
    steps of enumeration count as a node."""
    counts = {x: n for x, n in counts.items() if n}
    bound = lower_bound(counts, capacity)
    best = min((f(counts, capacity) for f in (best_fit, longest_first)), key=lambda p: sum(t for _, t in p))
    best_n = sum(t for _, t in best)
    seen, limit, first, whole = 0.0, 400, True, False
    while best_n > bound and seen < nodes and not whole:
        whole, stack = True, [(counts, (), 0)]  # counts left, chain of patterns (pattern, times, before), sequences used
        while stack and best_n > bound and seen < nodes:
            left, chain, used = stack.pop()
            seen += 1
            rest = sum(x * n for x, n in left.items())
            if used + -(-rest // capacity) >= best_n or not first and used + lower_bound(left, capacity) >= best_n:
                continue
            if not left:
                best_n, best = used, []
                while chain:
                    best.append(chain[:2])
                    chain = chain[2]
                continue
            top = max(left)
            one = dict(left)
            one[top] -= 1
            lengths = sorted((x for x, n in one.items() if n), reverse=True)
            found, complete, steps = fillings(capacity - top, one, lengths, limit, not first)
            seen += steps / STEPS
            whole = whole and complete and len(found) <= branches
            for f in reversed(found[:branches]):
                pattern = dict(f)
                pattern[top] = pattern.get(top, 0) + 1
                most = min(left[x] // n for x, n in pattern.items())
                whole = whole and (most == 1 or not first)
                for times in (most,) if first or most == 1 else (1, most):
                    after = {x: n for x, n in ((x, n - times * pattern.get(x, 0)) for x, n in left.items()) if n}
                    stack.append((after, (tuple(sorted(pattern.items(), reverse=True)), times, chain), used + times))
        first, branches, limit = False, 3 * branches, 3 * limit
    return best


def segments(patterns) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: where it begins, its first sequence and offset, pieces in a sequence."""
    rows, given, base = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for x, n in pattern:
            lo = given.get(x, 0)
            given[x] = lo + n * times
            rows.append((x, lo, base, offset, n))
            offset += x * n
        base += times
    rows.sort()
    return dict(zip(("length", "lo", "seq", "offset", "n"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset; sequences are gapless from offset 0 and at most capacity long."""
    with text_batches(docs.sparkSession):
        cut = stored(pieces(docs, tokenizer, capacity), "pieces")
    hist = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    at = segments(solve(hist, capacity))
    spark = docs.sparkSession
    parts = spark.createDataFrame([(x, -(-n // PART)) for x, n in sorted(hist.items())], "length bigint, parts bigint")
    dealt = cut.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), "parts"))
    counts = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    span = 1 << 40
    keys = at["length"] * span + at["lo"]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(keys, length * span + rank, side="right") - 1
            t = rank - at["lo"][k]
            cols = [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(at["seq"][k] + t // at["n"][k]), pa.array(at["offset"][k] + t % at["n"][k] * length)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PIECES + ", sequence_id bigint, offset bigint")
