import re
from collections import defaultdict

import pytest

from basalt.llm import mixing
from basalt.llm.queries import QUERIES


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def aims(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rate = (total - sum(2 * size[s] for s in full)) / sum(w[s] for s in free) if free else 0
        more = {s for s in free if rate * w[s] >= 2 * size[s]}
        if not more:
            return size, {s: 2 * size[s] if s in full else rate * w[s] for s in order}
        full |= more


def check(spark, rows, schema="doc_id long, text string, source string"):
    docs = spark.createDataFrame(rows, schema)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, target = aims(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        f = r.target / r.source_size if r.source_size else 0
        assert not r.size or int(f + 1e-9) <= r.copies <= -(-f // 1)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    return got


def test_cases(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}") for i in range(300)]
    rows += [(300, None, "s0"), (301, "", None), (302, " x ", None), (303, "y" * 9999, "tiny"), (304, " ", "s\U0001f600"), (305, "z z", "s￿")]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert got[300].size == got[301].taken == 0 and got[304].size == 1


def test_a_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 8)
    check(spark, [(i, "w " * (1 + i * 13 % 50), "hot" if i % 3 else "b") for i in range(700)])


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.taken) for r in got] == [(0, 0)] * 3


def test_rounding_is_unbiased():
    import random

    rnd, n, runs = random.Random(1), 7, 20000
    size, p, hits = [3, 50, 7, 7, 20, 1, 9], [0.2, 0.5, 0.9, 0.35, 0.6, 0.1, 0.75], [0] * 7
    for _ in range(runs):
        done, carry = mixing.round_in_order(list(range(n)), size, p, [rnd.random() for _ in p])
        done += [(carry[0], int(rnd.random() < carry[2]))] if carry else []
        assert sorted(i for i, _ in done) == list(range(n))
        for i, k in done:
            hits[i] += k
    assert all(abs(h / runs - q) < 0.02 for h, q in zip(hits, p, strict=True))


def test_repeated(spark):
    docs = spark.createDataFrame([(i, "w " * 5, f"s{i % 2}", i) for i in range(40)], "doc_id long, text string, source string, copies long")
    mixed = mixing.mix(docs)
    out = mixing.repeated(docs, mixed)
    assert out.columns == docs.columns and out.count() == mixed.agg({"copies": "sum"}).head()[0]


def test_query(spark):
    assert QUERIES["op6_source_mixing"](spark, "/root/testdata/sf0.001").count() == 200
