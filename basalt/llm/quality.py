"""Quality classifier: statistics of a text, random Fourier features, ridge, isotonic calibration.

Inputs are statistics of the whole text alone. Null and empty texts have the statistics of no words, and
get a score like any other. Repeated rows are scored each for itself; a row labelled twice counts twice.
Without usable labels every score is 0.5. An empty table gives an empty result. Columns besides doc_id
and text are not read.
"""
from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import crc_mod, ids_and_bytes, stored, text_batches, texts
from basalt.llm.learn import FourierRidge, Isotonic, calibrate, fit_ridge, labelled

_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123))
_DIGIT = b"0123456789"
_STOPS = b".,;:?'\"()-"
_SYMBOL = bytes(c for c in range(33, 127) if c not in _LETTER + _DIGIT + _STOPS)
_HIGH = bytes(range(128, 256))

STATISTICS = ("log_words", "mean_word", "long_word", "distinct_words", "top_word", "same_next", "distinct_pairs", "upper", "digits", "stops", "symbols", "high_bytes", "distinct_lines", "words_in_line", "one_byte_words", "symbol_words")


def statistics(b: bytes) -> list[float]:
    """The numbers named in STATISTICS; all bounded, so one odd text cannot outweigh others in a sum."""
    words = b.split()
    n, size = len(words), max(len(b), 1)

    def share(chars: bytes) -> float:
        return (len(b) - len(b.translate(None, chars))) / size

    letters = max(share(_LETTER), 1 / size)
    lines = [x for x in b.split(b"\n") if x.strip()]
    if not n:
        return [0.0] * 7 + [0.0, share(_DIGIT), share(_STOPS), share(_SYMBOL), share(_HIGH), 0.0, 0.0, 0.0, 0.0]
    counts = Counter(words)
    symbols = set(_SYMBOL)
    return [
        float(np.log1p(n)), min(sum(map(len, words)) / n, 40.0), min(max(map(len, counts)), 100) / 100, len(counts) / n, max(counts.values()) / n,
        sum(map(operator.eq, words, words[1:])) / n, len(set(zip(words, words[1:]))) / max(n - 1, 1),
        share(_UPPER) / letters, share(_DIGIT), share(_STOPS), share(_SYMBOL), share(_HIGH),
        len(set(lines)) / len(lines), min(n / len(lines), 200.0) / 200, sum(c for w, c in counts.items() if len(w) == 1) / n, sum(c for w, c in counts.items() if w[-1] in symbols) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, its statistics."""

    def run(batches):
        for b in batches:
            ids, rows = [], []
            for i, t in ids_and_bytes(b):
                ids.append(i)
                rows.append(statistics(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return texts(docs).mapInArrow(run, "doc_id bigint, x array<double>")


def _raw(rows: DataFrame, model: FourierRidge, more: str = "", of_raw=lambda raw: raw) -> DataFrame:
    """doc_id and raw, what of_raw makes of its score, in one step of Python: two in a row take two workers a task."""
    keep = [c.split()[0] for c in more.split(",") if c]
    n = len(STATISTICS)

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(of_raw(model.raw(x))), *(b.column(c) for c in keep)], ["doc_id", "raw", *keep])

    return rows.select("doc_id", "x", *keep).mapInArrow(run, "doc_id bigint, raw double" + (f", {more}" if more else ""))


def fit(rows: DataFrame, labels: DataFrame) -> tuple[FourierRidge | None, Isotonic]:
    """Both stages from the labelled rows whose crc32(doc_id) mod 3 is not 1. All of them count. The calibration is of scores
    by models that did not see the row: one fitted where the remainder is 0 scores those of remainder 2, and the other way round."""
    train = stored(labelled(rows, labels, "quality").where(crc_mod(F.col("doc_id"), 3) != 1), "train")
    model = fit_ridge(train, len(STATISTICS))
    if model is None:
        return None, Isotonic(np.array([0.0]), np.array([0.5]))
    folds = [train.where(crc_mod(F.col("doc_id"), 3) == k) for k in (0, 2)]
    models = [fit_ridge(f, len(STATISTICS)) or model for f in folds]
    unseen = _raw(folds[1], models[0], "y int").unionByName(_raw(folds[0], models[1], "y int"))
    return model, calibrate(unseen)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    with text_batches(docs.sparkSession):
        rows = stored(with_statistics(docs), "statistics")
    model, curve = fit(rows, labels)
    if model is None:
        scored = rows.select("doc_id", F.lit(0.5).alias("score"))
    else:
        scored = _raw(rows, model, of_raw=curve).withColumnRenamed("raw", "score")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected. Rejected IDs are the short side of the join."""
    bad = score(docs, labels).where("predicted = 0").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("_bad"), "left_anti")
