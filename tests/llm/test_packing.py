import random
import zlib

import numpy as np
import pytest

from basalt.llm import packing
from basalt.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check(spark, tok, rows, capacity=2048):
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = sorted(map(tuple, packing.pack(docs, capacity=capacity).collect()))
    want = []
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert [g[:5] for g in got] == sorted(want)
    seqs = {}
    for _, _, _, n, _, s, at in got:
        seqs.setdefault(s, []).append((at, n))
    for spans in seqs.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= capacity
    return len(seqs), sum(w[3] for w in want)


CASES = [None, "", " ", "Hello, World's  test", "a b c\x85d\x1ce\x1ff", "Σας ΟΔΟΣ İstanbul é ́x", "<|endoftext|> x<|startoftext|>y", "日本語 😀😀 don't we'll", "x" * 3000 + " y", "word " * 5000, "12345 \r\n\t\v\f6"]


def test_cases(spark, tok):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(3, CASES[3], "x")]
    n, total = check(spark, tok, rows)
    assert n <= -(-total // 2048) + 1
    check(spark, tok, rows, 16)


def test_real_texts_and_parts(spark, tok, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    n, total = check(spark, tok, rows)
    assert n <= -(-total // 2048) + 1


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def fewest(lengths, capacity):
    """Brute force: the fewest sequences."""
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in sorted({b: i for i, b in enumerate(bins)}.values()):
            if bins[i] + lengths[k] <= capacity:
                bins[i] += lengths[k]
                go(k + 1, bins)
                bins[i] -= lengths[k]
        go(k + 1, [*bins, lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


def test_solver_matches_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        cap = rnd.choice([10, 20, 50])
        lengths = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 10))]
        counts = {x: lengths.count(x) for x in lengths}
        sol = packing.solve(counts, cap, branches=100)
        used = {}
        for pattern, times in sol:
            assert sum(x * n for x, n in pattern) <= cap
            for x, n in pattern:
                used[x] = used.get(x, 0) + n * times
        assert used == counts and sum(t for _, t in sol) == fewest(lengths, cap)


def test_query(spark):
    assert QUERIES["op9_best_fit_packing"](spark, "/root/testdata/sf0.001").select("doc_id").distinct().count() == 200


def test_search_at_production_defaults():
    rnd = random.Random(9)
    cases = [(2048, [1104, 997, 895, 838, 828, 774, 553, 550, 541, 465, 375])]
    cases += [(2048, [rnd.randint(300, 1200) for _ in range(rnd.randint(6, 11))]) for _ in range(60)]
    for cap, lengths in cases:
        counts = {x: lengths.count(x) for x in lengths}
        for sol, least in ((packing.solve(counts, cap), fewest(lengths, cap)), (packing.best_fit(counts, cap), 0)):
            used = {}
            for pattern, times in sol:
                assert sum(x * n for x, n in pattern) <= cap
                for x, n in pattern:
                    used[x] = used.get(x, 0) + n * times
            assert used == counts and (not least or sum(t for _, t in sol) == least)


def test_best_fit_takes_the_fullest_sequence():
    rnd = random.Random(10)
    for _ in range(200):
        cap = rnd.choice([10, 50, 200])
        lengths = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(1, 60))), reverse=True)
        rooms = []
        for x in lengths:
            fit = [k for k, r in enumerate(rooms) if r >= x]
            if fit:
                rooms[min(fit, key=lambda k: rooms[k])] -= x
            else:
                rooms.append(cap - x)
        got = packing.best_fit({x: lengths.count(x) for x in lengths}, cap)
        assert sorted(cap - sum(x * n for x, n in p) for p, t in got for _ in range(t)) == sorted(rooms)


def test_lower_bound_and_dominance_against_brute_force():
    rnd = random.Random(12)
    for _ in range(300):
        cap = rnd.choice([7, 10, 20, 50, 100])
        lengths = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        assert -(-sum(lengths) // cap) <= packing.lower_bound(counts, cap) <= (fewest(lengths, cap) if lengths else 0)
        if lengths:
            top = max(lengths)
            one = {x: n - (x == top) for x, n in counts.items()}
            rest = sorted((x for x, n in one.items() if n), reverse=True)
            found, whole, _ = packing.fillings(cap - top, one, rest, every=True)
            assert whole  # some undominated filling begins a best packing
            after = []
            for f in found:
                left = dict(one)
                for x, n in f:
                    left[x] -= n
                others = [x for x, n in left.items() for _ in range(n)]
                after.append(1 + (fewest(others, cap) if others else 0))
            assert min(after) == fewest(lengths, cap)


def test_lower_bound_beyond_the_total():
    rnd = random.Random(13)
    for lo, hi, n in ((700, 1499, 1000), (683, 1023, 900), (513, 682, 600)):
        lengths = [rnd.randint(lo, hi) for _ in range(n)]
        counts = {x: lengths.count(x) for x in lengths}
        bound, used = packing.lower_bound(counts, 2048), sum(t for _, t in packing.best_fit(counts, 2048))
        assert -(-sum(lengths) // 2048) < bound <= used <= 1.03 * bound
