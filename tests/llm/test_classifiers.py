import zlib

import numpy as np
import pytest

from basalt.llm import learn, quality, toxicity
from basalt.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_statistics_of_odd_texts():
    for b in (b"", b" \n\t", b"a", b"\xc3\xa9" * 70000, b"x " * 100000, b"!!! ### $$$\n\n"):
        s = quality.statistics(b)
        assert len(s) == len(quality.STATISTICS) and np.isfinite(s).all() and max(map(abs, s)) <= 250


def test_ridge_sums_over_partitions_match_a_direct_solution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(int)
    rows = spark.createDataFrame([([float(v) for v in r], int(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y int").repartition(7)
    m = learn.fit_ridge(rows, 3, n_features=40, ridge=1e-2)
    phi = m.features(x)
    pen = np.eye(41) * 1e-2 * 300 / 41
    pen[-1, -1] = 0
    assert np.allclose(m.coef, np.linalg.solve(phi.T @ phi + pen, phi.T @ y), atol=1e-6)
    assert ((m.raw(x) > 0.5) == y).mean() > 0.9


def test_pool_adjacent():
    rng = np.random.default_rng(4)
    x = np.sort(rng.uniform(size=50))
    pos = rng.integers(0, 11, size=50)
    f = learn.pool_adjacent(x, [10] * 50, pos)
    got = f(np.linspace(-1, 2, 400))
    assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() <= 1
    # brute force: min over right ends of max over left ends of means
    cum = np.concatenate([[0], np.cumsum(pos)])
    iso = [max(min((cum[b + 1] - cum[a]) / (10 * (b - a + 1)) for b in range(i, 50)) for a in range(i + 1)) for i in range(50)]
    assert np.allclose(f(x), iso, atol=0.06)


@pytest.mark.parametrize("op, label, mod, rest, least", [("op5_quality_classifier", "quality", 3, 1, 0.98), ("op8_toxicity", "toxic", 5, 0, 0.98)])
def test_held_out_accuracy(spark, op, label, mod, rest, least):
    got = QUERIES[op](spark, SF).collect()
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 10000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    assert len(held) > 500 and np.mean([a == b for a, b in held]) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labels_nulls_and_empty(spark, module):
    docs = spark.createDataFrame([(1, None, "x", 0.0), (2, "", "x", 0.0), (2, "", "x", 0.0), (3, "word " * 5, "x", 0.0)], "doc_id long, text string, x string, score double")
    labels = spark.createDataFrame([(1, None, None), (3, 7, None)], "doc_id long, quality int, toxic int")
    got = module.score(docs, labels).collect()
    assert [r.score for r in got] == [0.5] * 4 and module.score(docs.limit(0), labels).count() == 0


def test_pipeline_stage_keeps_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == good


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_search_matches_edit_distance():
    import random

    rnd = random.Random(6)
    terms = [("idiot", False), ("disgusting", False), ("lowei", True), ("scum", False), ("worthless", False)]
    lex = toxicity.Lexicon(terms)
    words = ["idiot", "ldiot", "idoit", "disqustin", "loweischaft", "lowweischaft", "scun", "scum", "worthles5", "", "x" * 200]
    for _ in range(4000):
        w = list(rnd.choice(terms)[0] + rnd.choice(["", "x", "ung"]))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "o", "t"])
        words.append("".join(w))
    for w in words:
        best = None
        for k, (t, stem) in enumerate(terms):
            d = min(distance(w[:n], t) for n in range(len(w) + 1)) if stem else distance(w, t)
            if len(w) >= toxicity.SHORTEST - 1 and d <= toxicity.distance_allowed(len(t)) and (best is None or (d, -len(t)) < best[:2]):
                best = (d, -len(t), k)
        assert lex.search(w) == (best and (best[2], best[0])), w


def test_quotation_weighs_less_than_abuse():
    lex = toxicity.Lexicon([("idiot", False)])
    w = {(0, 0): 4.0, (0, 1): 2.0}
    abuse, plain, misspelt, quoted = (toxicity.raw_score(t, lex, w) for t in ("you idiot, go", "an idiot here", "an idiott here", 'he said "idiot" and left'))
    assert abuse > plain > misspelt > 0 and plain > quoted > 0 and toxicity.raw_score("", lex, w) == 0


def test_rare_insults_are_learned_among_many_toxic_texts(spark):
    """One in 10 toxic texts and no clean one, of 2200 toxic texts: below 1 % of them; and more than 200 insults."""
    def name(k):
        return "".join(chr(97 + (k * 7919 + 13) // 17**i % 23) for i in range(7)) + "xq"

    words = sorted({name(k) for k in range(260)})
    rows = [(f"t{k} a{k} b{k} common {words[k % len(words)] if k < 10 * len(words) else 'commonly'} c{k} d{k} e{k} f{k}", 1) for k in range(2800)]
    rows += [(f"u{k} v{k} w{k} common commonly x{k} y{k} z{k}", 0) for k in range(16000)]
    terms = toxicity.learn_terms(spark.createDataFrame(rows, "text string, y int"))
    lex = toxicity.Lexicon(terms)
    assert len(words) > 200 and all(lex.hit(w) and lex.hit(w)[1] == 0 for w in words) and not lex.hit("commonly") and not lex.hit("common")


def test_every_hit_counts():
    lexicon = toxicity.Lexicon([("blorgle", False)])
    got = toxicity.raw_score("blorgle " * 40, lexicon, {(0, 0): 3.0})
    total = 3.0 * (2 - 2.0**-39)
    assert abs(got - total / (1 + total)) < 1e-15
    assert got > toxicity.raw_score("blorgle " * 16, lexicon, {(0, 0): 3.0})
    assert 0 <= toxicity.raw_score("blorgle " * 50_000, lexicon, {(0, 0): 3.0}) < 1


def test_scores_take_one_worker_a_task(spark):
    """Two steps of Python in a row would have a task take two workers, which stay."""
    sf = "/root/testdata/sf0.001"
    scored = quality.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert scored._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
