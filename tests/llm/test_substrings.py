import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from basalt.llm import substrings
from basalt.llm.queries import QUERIES


def brute(rows, length=50):
    first = {}
    data = sorted({i: (t or "").encode() for i, t in rows}.items())
    for i, t in data:
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = {}
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(df, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}
    want = brute(rows)
    assert got == want, {i: (got.get(i), want[i]) for i in want if got.get(i) != want[i]}


def corpus(seed):
    rnd = random.Random(seed)

    def text(n):
        return "".join(rnd.choice("abcdé f\n") for _ in range(n))

    passages = [text(n) for n in (30, 49, 50, 51, 60, 90, 300)]
    rows = []
    for i in range(150):
        parts = [rnd.choice([*passages, text(rnd.randint(0, 120)), "the and of to in " * rnd.randint(1, 6), "x" * rnd.randint(0, 200)]) for _ in range(rnd.randint(0, 6))]
        rows.append((i * 3, "".join(parts)))
    for k in range(20):  # near copies
        t = list(rows[k][1])
        for _ in range(rnd.randint(0, 3)):
            if t:
                t[rnd.randrange(len(t))] = "Z"
        rows.append((1000 - k, "".join(t)))
    rows += [(2001, None), (2002, ""), (2003, passages[2]), (2004, passages[2]), (2005, passages[1]), (2006, passages[1]), (2007, "q" * 50000), (2008, "q" * 49), (2009, "q" * 50), (5000, passages[6] * 3)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, starts string").repartition(5)
    check(substrings.remove_repeats(df), rows)
    check(substrings.summary(df), rows)


def test_small_buffers_and_slices(monkeypatch):
    """Runs that cross tasks, batches, flushes of the buffer and slices of a text."""
    monkeypatch.setattr(substrings, "BUFFER", 40)
    monkeypatch.setattr(substrings, "SLICE", 64)
    monkeypatch.setattr(substrings, "GROUP", 300)
    rows = corpus(3)
    found = in_process(rows, 7)
    want = brute(rows)
    assert {i: found.get(i, 0) for i in want} == {i: x[1] for i, x in want.items()}


def in_process(rows, size):
    """The four rounds over batches of a few rows, without Spark: doc_id and bytes removed."""

    def sort(batches, *by):
        t = pa.Table.from_batches(list(batches))
        return t.sort_by([(c, "ascending") for c in ("key", *by)]).to_batches(max_chunksize=size)

    def by_doc(batches):
        out = {}
        for b in batches:
            for i, x, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "starts", "at")), strict=True):
                out.setdefault(i, ([], []))[x is None].append(at if x is None else x)
        return out

    def docs(**more):
        fields = [("doc_id", pa.int64()), ("text", pa.string()), *((n + end, pa.list_(t)) for n in more for end, t in (("", pa.binary()), ("_at", pa.int32())))]
        some = [{"doc_id": i, "text": t, **{n + end: m[i][k] for n, m in more.items() for k, end in enumerate(("", "_at"))}} for i, t in rows if all(i in m for m in more.values())]
        for k in range(0, len(some), 5):
            yield pa.RecordBatch.from_pylist(some[k : k + 5], pa.schema(fields))

    s = substrings
    shared = by_doc(s._shared(sort(s._sampled(50)(docs()), "doc_id")))
    ranked = pa.Table.from_batches(list(s._ranked(sort(s._surrounded(50)(docs(shared=shared)), "sub", "doc_id"))))
    doomed = by_doc(ranked.filter(pc.invert(ranked["open"])).to_batches())
    open_ = ranked.filter(ranked["open"]).to_batches(max_chunksize=size)
    sides = by_doc(s._shared(sort(s._sides(open_), "doc_id")))
    own = by_doc(s._doomed(sort(s._strings(50)(docs(sides=sides)), "sub", "doc_id")))

    def places(found):
        return np.unique(np.concatenate([*(np.frombuffer(x, "<i4") for x in found[0]), np.array(found[1], np.int64)])).astype(np.int64)

    none = ([], [])
    return {i: int(s.covered(len((t or "").encode()), places(doomed.get(i, none)), places(own.get(i, none)), 50).sum()) for i, t in rows}


def test_ranks_are_those_of_the_bytes():
    data = np.frombuffer(bytes(random.Random(3).choices(b"ab", k=400)), np.uint8)
    for k in (1, 2, 3, 18, 50, 82):
        r = substrings.Ranks(data).of(k)
        assert len(r) == len(data) - k + 1
        seen = {}
        for i, x in enumerate(r.tolist()):
            assert seen.setdefault(x, data[i : i + k].tobytes()) == data[i : i + k].tobytes()
        assert len(seen) == len({data[i : i + k].tobytes() for i in range(len(r))})


def test_kept_bytes_and_odd_rows(spark):
    t = "0123456789" * 6
    docs = spark.createDataFrame([(1, t, "k"), (2, "A" + t + "B", "k"), (2, "A" + t + "B", "k"), (None, t, "k"), (3, t[:49], "k")], "doc_id long, text string, part string")
    got = sorted(((r.doc_id, bytes(r.kept).decode()) for r in substrings.remove_repeats(docs).collect()), key=str)
    assert [x for x in got if x[0] is not None] == [(1, t), (2, "AB"), (2, "AB"), (3, t[:49])]
    assert (None, t) in got
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.summary(docs).collect()) == [(0, 0), (1, 0), (2, 60), (2, 60), (3, 0)]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op2_suffix_array_dedup"](spark, sf), rows)
