"""Toxicity: misspelt lexicon terms by Levenshtein automata over a trie, weighed by their context.

The lexicon is learned from labelled texts: words, and stems that begin words, far commoner in toxic
texts. A word meets the trie through its Levenshtein automaton: states are rows of edit distances up to
a bound, and branches whose state has no distance within it are cut. A word with a term at distance 0, 1
or 2 is a hit, with the weight that hits of that term and distance have in the labelled texts. Around a
hit, quotation marks and words of reporting take weight off and words of address add to it. A text's
strongest hits make its raw score, calibrated by isotonic regression on the labelled rows.

Null and empty texts have raw score 0 and get the calibrated score of that. Repeated rows are scored
each for itself. Without usable labels there are no terms and every score is 0.5. An empty table gives
an empty result. Columns besides doc_id and text are not read.
"""
from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import crc_mod, stored, text_batches, texts
from basalt.llm.learn import Isotonic, calibrate, labelled

#: Labelled rows that the lexicon is learned from: those of smallest hash. Calibration uses all of them.
LEXICON_ROWS = 20_000
SHORTEST, LONGEST = 4, 16
_STRIP = ".,;:!?\"'()[]{}<>«»„“”‚‘’…*_-#%&$@+~|/\\=^`"
_QUOTES = frozenset("\"«»„“”‚‘’")
#: Words that report speech or name a word, and words of address, in the corpus's languages.
REPORTING = frozenset("said says called calls calling wrote quoted quote word term insult insults slur sagte nannte genannt wort dit appelé mot dijo llamó palabra".split())
ADDRESS = frozenset("you your you're youre du dich dir ihr euch tu te vous toi usted tú ti vosotros".split())
WINDOW = 6
QUOTED, REPORTED, ADDRESSED = 0.35, 0.7, 1.2
_CACHE = 400_000


def word_of(token: str) -> str:
    return token.strip(_STRIP)


@dataclass
class Node:
    term: int = -1
    stem: bool = False
    bound: int = 0  # the largest distance that a term at or below the node allows
    next: dict[str, Node] = field(default_factory=dict)


class Automaton:
    """Levenshtein automaton of a word: step() maps a row of capped edit distances on reading a character.
    Rows are the states; equal rows are one state, whose steps are remembered."""

    def __init__(self, word: str, most: int):
        self.word, self.most, self.steps = word, most, {}
        self.start = tuple(min(i, most + 1) for i in range(len(word) + 1))

    def step(self, row: tuple, ch: str) -> tuple:
        got = self.steps.get((row, ch))
        if got is None:
            cap, out = self.most + 1, [min(row[0] + 1, self.most + 1)]
            for i, w in enumerate(self.word):
                out.append(min(row[i] + (w != ch), row[i + 1] + 1, out[i] + 1, cap))
            got = self.steps[row, ch] = tuple(out)
        return got


def distance_allowed(n: int) -> int:
    return 0 if n < 5 else 1 if n < 10 else 2


class Lexicon:
    """Terms as a trie. terms: (text, whether longer words that begin with it count too)."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms, self.root = terms, Node()
        self.lengths = sorted({len(t) for t, _ in terms})
        parts: dict[str, set[tuple[int, int]]] = {}
        for k, (t, stem) in enumerate(terms):
            at, d = self.root, distance_allowed(len(t))
            for ch in t:
                at = at.next.setdefault(ch, Node())
                at.bound = max(at.bound, d)
            at.term, at.stem = k, stem
            for i in range(d + 1):
                lo = i * len(t) // (d + 1)
                parts.setdefault(t[lo : (i + 1) * len(t) // (d + 1)], set()).add((lo, d))
        self.parts = ahocorasick.Automaton()
        for part, places in parts.items():
            self.parts.add_word(part, (len(part), tuple(places)))
        if parts:
            self.parts.make_automaton()
        self.cache: dict[str, tuple[int, int] | None] = {}

    def may_match(self, w: str) -> bool:
        """Edits of a term within its bound d leave one of d + 1 parts whole, at most d from its place (pigeonhole)."""
        return any(abs(end + 1 - n - lo) <= d for end, (n, places) in self.parts.iter(w) for lo, d in places)

    def search(self, w: str) -> tuple[int, int] | None:
        """(term, distance) of the nearest term, the longest among equals; None if none is near enough."""
        if not self.terms or len(w) < SHORTEST - 1 or not self.may_match(w):
            return None
        best: tuple | None = None
        auto = Automaton(w[: self.lengths[-1] + 2], 2)
        whole = len(auto.word) == len(w)
        stack = [(self.root, auto.start, 0)]
        while stack:
            node, row, depth = stack.pop()
            if best and min(row) > best[0]:
                continue
            if node.term >= 0:
                d = row[-1] if whole and not node.stem else min(row) if node.stem else 9
                if d <= distance_allowed(depth) and (best is None or (d, -depth) < best[:2]):
                    best = (d, -depth, node.term)
            for ch, child in node.next.items():
                nxt = auto.step(row, ch)
                if min(nxt) <= child.bound:
                    stack.append((child, nxt, depth + 1))
        return best and (best[2], best[0])

    def hit(self, token: str) -> tuple[int, int] | None:
        """search() of a lower-case token without the marks around it, remembered."""
        try:
            return self.cache[token]
        except KeyError:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            got = self.cache[token] = self.search(word_of(token))
            return got


@functools.lru_cache(maxsize=1)
def _lexicon(terms: tuple[tuple[str, bool], ...]) -> Lexicon:
    """The worker's lexicon: its cache lasts from task to task."""
    return Lexicon(list(terms))


def context(tokens: list[str], k: int) -> float:
    """Factor for a hit at tokens[k]: below 1 if it is quoted or reported, above if it addresses someone."""
    lo, near = max(0, k - WINDOW), tokens[max(0, k - WINDOW) : k + WINDOW + 1]
    before, after = "".join(tokens[lo:k]), "".join(tokens[k + 1 : k + WINDOW + 1])
    own = tokens[k]
    opened = own[0] in _QUOTES or sum(map(before.count, _QUOTES)) % 2 == 1
    closed = own.rstrip(".,;:!?")[-1:] in _QUOTES or any(q in after for q in _QUOTES)
    words = {word_of(t) for t in near}
    return (QUOTED if opened and closed else 1.0) * (REPORTED if words & REPORTING else 1.0) * (ADDRESSED if words & ADDRESS else 1.0)


def raw_score(text: str, lexicon: Lexicon, weights: dict[tuple[int, int], float]) -> float:
    """Weights of the hits times their context, the strongest first and each next at half, below 1."""
    tokens = text.lower().split()
    hits = [(k, h) for k, h in enumerate(map(lexicon.hit, tokens)) if h]
    total, part = 0.0, 1.0
    for v in sorted((weights.get(h, 0.0) * context(tokens, k) for k, h in hits), reverse=True):
        total, part = total + v * part, part / 2
    return total / (1 + total)


# -- learning ----------------------------------------------------------------------


def _forms(words: set[str]) -> set[str]:
    """Each word as `=word`, and its prefixes."""
    out = set()
    for w in words:
        if SHORTEST <= len(w) <= 2 * LONGEST:
            if len(w) <= LONGEST:
                out.add(f"={w}")
            out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def _form_counts(rows: DataFrame, only: frozenset | None) -> DataFrame:
    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for t in b.column("text").to_pylist():
                forms = _forms({word_of(w) for w in t.lower().split()})
                seen.update(forms if only is None else forms & only)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["form", "n"])

    return rows.select("text").mapInArrow(run, "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))


def _without_copies(sample: DataFrame) -> DataFrame:
    """One text of each that begin alike, and of each that end alike: copies of one toxic text would make
    terms of all its words."""
    words = F.split(F.lower("text"), r"\s+")
    return sample.withColumn("_w", F.slice(words, 1, 5)).dropDuplicates(["_w", "y"]).withColumn("_w", F.slice(F.reverse(words), 1, 5)).dropDuplicates(["_w", "y"]).drop("_w")


def lowest_odds_ratio(p: int, q: int, n1: int, n0: int, z: float = 2.58) -> float:
    """Lower 99 % confidence bound of the odds ratio of a form in p of n1 toxic and q of n0 other texts (Woolf, Haldane)."""
    a, b, c, d = p + 0.5, q + 0.5, n1 - p + 0.5, n0 - q + 0.5
    return a * d / (b * c) * math.exp(-z * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def learn_terms(sample: DataFrame, least: int = 6, lift: float = 30.0) -> list[tuple[str, bool]]:
    """Terms from sample(text, y), a bounded number of rows: in `least` toxic texts or more, copies aside, however
    many toxic texts there are, `lift` times as common in toxic texts as in others or more, and with an odds ratio
    that lies above 1 by its confidence bound. Of a chain of prefixes with the same texts the longest counts, and no
    term that begins with a chosen stem."""
    sample = stored(_without_copies(sample), "sample")
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return []
    pos = {r.form: r.n for r in _form_counts(sample.where("y = 1"), None).where(F.col("n") >= least).collect()}
    neg = {r.form: r.n for r in _form_counts(sample.where("y = 0"), frozenset(pos)).collect()}

    def strong(f):
        p, q = pos[f], neg.get(f, 0)
        return (p + 0.5) / (n1 + 1) / ((q + 0.5) / (n0 + 1)) >= lift and lowest_odds_ratio(p, q, n1, n0) > 1

    longer: dict[str, list[str]] = {}  # forms of one more character
    for f in pos:
        if not f.startswith("="):
            longer.setdefault(f[:-1], []).append(f)
    chosen: list[tuple[str, bool]] = []
    stems: set[str] = set()
    for f in sorted((f for f in pos if not f.startswith("=") and strong(f)), key=lambda f: (len(f), f)):
        if any(f[:k] in stems for k in range(SHORTEST, len(f) + 1)):
            continue
        stems.add(f)  # covers all that begin with it
        while more := [g for g in longer.get(f, ()) if pos[g] >= 0.9 * pos[f]]:
            f = more[0]
        chosen.append((f, pos.get(f"={f}", 0) < 0.9 * pos[f]))
    chosen += [(f[1:], False) for f in pos if f.startswith("=") and strong(f) and not any(f[1 : k + 1] in stems for k in range(SHORTEST, len(f)))]
    return sorted(set(chosen))


def learn_weights(sample: DataFrame, terms: list[tuple[str, bool]]) -> dict[tuple[int, int], float]:
    """Log-odds of a text with hits of (term, distance), 0 where that isn't above 0."""

    def run(batches):
        lexicon = _lexicon(tuple(terms))
        for b in batches:
            seen: Counter = Counter()
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                seen.update((*h, y) for h in {lexicon.hit(w) for w in t.lower().split()} if h)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], pa.int32()) for i in range(3)] + [pa.array(seen.values(), pa.int64())], ["term", "d", "y", "n"])

    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {(r.term, r.d, r.y): r.n for r in sample.select("text", "y").mapInArrow(run, "term int, d int, y int, n bigint").groupBy("term", "d", "y").agg(F.sum("n").alias("n")).collect()}
    by_d: Counter = Counter()
    for (_, d, y), c in counts.items():
        by_d[d, y] += c

    def odds(p, q):
        return math.log((p + 0.5) / (n[1] + 1) / ((q + 0.5) / (n[0] + 1)))

    out = {}
    for k in range(len(terms)):
        for d in range(3):
            p, q = counts.get((k, d, 1), 0), counts.get((k, d, 0), 0)
            # A term's own counts, and those of its distance as two texts' worth of prior.
            prior = 2 / max(1, by_d[d, 1] + by_d[d, 0])
            out[k, d] = max(0.0, odds(p + prior * by_d[d, 1], q + prior * by_d[d, 0])) if by_d[d, 1] + by_d[d, 0] else 1.0
    return out


def _raw(rows: DataFrame, terms, weights, more: str = "") -> DataFrame:
    keep = [c.split()[0] for c in more.split(",") if c]

    def run(batches):
        lexicon = _lexicon(tuple(terms))
        for b in batches:
            raw = [raw_score(t, lexicon, weights) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.float64()), *(b.column(c) for c in keep)], ["doc_id", "raw", *keep])

    return rows.select("doc_id", "text", *keep).mapInArrow(run, "doc_id bigint, raw double" + (f", {more}" if more else ""))


def score(docs: DataFrame, labels: DataFrame, lexicon_rows: int = LEXICON_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs. Labels of rows whose crc32(doc_id) mod 5 is 0
    are never read. Each text is read twice: lexicon_rows of them to learn terms, all of them to score."""
    rows = texts(docs)
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id").cast("bigint"), 5) != 0))
    some = known.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(lexicon_rows)
    sample = stored(rows.join(F.broadcast(stored(some, "sample-labels")), "doc_id").select("text", F.col("toxic").alias("y")), "sample")
    with text_batches(docs.sparkSession):
        terms = learn_terms(sample)
        weights = learn_weights(sample, terms) if terms else {}
        raw = stored(_raw(rows, terms, weights), "raw")
    curve = calibrate(labelled(raw, known, "toxic"), bins=2000, lo=0.0, hi=1.0) if terms else Isotonic(np.array([0.0]), np.array([0.5]))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(curve(b.column("raw").to_numpy()))], ["doc_id", "score"])

    scored = raw.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
