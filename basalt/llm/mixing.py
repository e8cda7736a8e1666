"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its words times a factor between 0 and 2, so each of its documents asks for
that many copies: whole ones, and a fraction. Fractions meet in pairs. Mass moves between the two, in
words, at random but without bias, until one of them is 0 or 1; the other goes on to the next pair.
Pairs meet first within parts of a source of bounded size, then the parts' leftovers among each other, up
a tree, until one fraction a source is left and is rounded. Each document keeps its expected number of
copies, and a source's words miss its target by one document's words at most.

Rows with a null doc_id are documents of their own. Null texts have size 0; documents of size 0 are in the result and take nothing. Null sources are one
source, last in order. Repeated rows are documents of their own. All randomness comes from hashes of
doc_id, so reruns agree. Columns besides doc_id, text and source are not read.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.ordinal import dense_ordinals
from basalt.llm.common import WORD, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Fractions that one task rounds in order at a level of the tree.
FAN = 4096
_EPS = 1e-9


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source"), words.alias("size"), *more)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target. Sources in order of code point (null last) take the weights in
    turn. Weights split share of all words; a target above most times its source's words stops there, and
    what it leaves is shared again by weight among the others until none is above.

    The loop runs once for each round of sources that stop; each round is one aggregate over the sources.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ordered = stored(by.orderBy(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id()), "sources")
    at = dense_ordinals(ordered, "_m", "i")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("i") % len(weights) + 1).cast("int"))
    rated = stored(at.select("source", "source_size", "n_docs", w.alias("w"), (F.col("source_size") * most).alias("cap")), "rated")
    total = rated.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0] * share
    rate, stopped = 0.0, -1
    while True:  # rate: words for each unit of weight of the sources that have not stopped
        full = F.col("w") * rate >= F.col("cap") if stopped >= 0 else F.lit(False)
        used, free, n = rated.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w"))), F.sum(full.cast("int"))).head()
        if not free or n == stopped:
            break
        rate, stopped = max(rate, (total - used) / free), n
    return rated.select("source", "source_size", "n_docs", F.least("cap", F.col("w") * F.lit(rate)).alias("target"))


def round_in_order(ids: list, size: list, p: list, u: list) -> tuple[list[tuple], tuple | None]:
    """Pivotal rounding down one list: [(id, copies 0 or 1)] for all but the last fraction, and that one.

    u: a uniform number for each item, used when it meets the fraction carried so far."""
    done, carry = [], None
    for i, s, q, x in zip(ids, size, p, u, strict=True):
        if q <= _EPS or q >= 1 - _EPS:
            done.append((i, int(q > 0.5)))
            continue
        if carry is None:
            carry = (i, s, q)
            continue
        j, t, r = carry
        up, down = min(t * (1 - r), s * q), min(t * r, s * (1 - q))  # words that can move to, from the carried one
        gives = -down if x < up / (up + down) else up
        r, q = r + gives / t, q - gives / s
        settled_carry = r <= _EPS or r >= 1 - _EPS
        if settled_carry:
            done.append((j, int(r > 0.5)))
        if q <= _EPS or q >= 1 - _EPS:
            done.append((i, int(q > 0.5)))
            carry = None if settled_carry else (j, t, r)
        else:
            carry = (i, s, q)
    return done, carry


def _level(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "h", "doc_id", "row"], ascending=[False, True, True, True], kind="stable")
    done, carry = round_in_order(list(range(len(pdf))), pdf["size"].tolist(), pdf["p"].tolist(), pdf["u"].tolist())
    p = pd.Series(float("nan"), index=range(len(pdf)))
    for i, k in done:
        p[i] = k
    if carry:
        p[carry[0]] = carry[2]
    out = pdf[["doc_id", "row", "sid", "part", "size"]].reset_index(drop=True)
    out["p"], out["left"] = p, [bool(carry) and i == carry[0] for i in range(len(pdf))]
    return out


def mix(docs: DataFrame, seed: int = 17, row: str | None = None, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and copies; one row per document.
    row: a column of docs with a number for each row, which the result has too."""
    sized = sizes(docs, F.col(row).alias("row")) if row else sizes(docs).withColumn("row", F.monotonically_increasing_id())
    sized = stored(sized, "sizes")
    aims = stored(targets(sized, **options).withColumn("sid", F.monotonically_increasing_id()), "targets")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parts = F.greatest(F.ceil(F.col("n_docs") / FAN), F.lit(1))
    all_docs = sized.join(aims, sized["source"].eqNullSafe(aims["source"])).select(sized["*"], "sid", "source_size", "target", f.alias("f"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), parts).alias("part"))
    whole = F.floor(F.col("f") + _EPS)
    at = stored(all_docs.select("*", whole.alias("whole"), (F.col("f") - whole).alias("q")), "wanted")
    state = at.where(f"size > 0 and q > {_EPS}").select("doc_id", "row", "sid", "part", "size", F.col("q").alias("p"))
    settled = []
    widest = aims.agg(F.coalesce(F.max(parts), F.lit(1))).head()[0]
    level = 0
    schema = "doc_id bigint, row bigint, sid bigint, part bigint, size bigint, p double, left boolean"
    while True:
        u = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(f"u{level}")), F.lit(1 << 52)) / float(1 << 52)
        dealt = state.select("*", u.alias("u"), F.xxhash64("doc_id", F.lit(seed), F.lit(f"o{level}")).alias("h"))
        rounded = stored(dealt.groupBy("sid", "part").applyInPandas(_level, schema), f"level{level}")
        if widest <= 1:
            break
        settled.append(rounded.where("not left").select("row", "p"))
        state = rounded.where("left").select("doc_id", "row", "sid", F.floor(F.col("part") / FAN).alias("part"), "size", "p")
        widest, level = -(-widest // FAN), level + 1
    last = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("last")), F.lit(1 << 52)) / float(1 << 52)
    settled.append(rounded.select("row", F.when(F.col("left"), (last < F.col("p")).cast("double")).otherwise(F.col("p")).alias("p")))
    extra = settled[0]
    for s in settled[1:]:
        extra = extra.unionByName(s)
    copies = (F.col("whole") + F.coalesce(F.col("p").cast("int"), F.lit(0))).cast("bigint")
    return at.join(extra, "row", "left").select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *([F.col("row").alias(row)] if row else []))


def repeated(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies. key must be unique in docs; rows that may have
    a null or repeated doc_id need a row key that mix() carried."""
    n = mixed.where("copies > 0").select(F.col(key).alias("_id"), F.col("copies").alias("_n"))
    return docs.join(n, F.col(key).eqNullSafe(F.col("_id"))).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Rows of docs, null and repeated doc_id included, each as often as the mix takes it."""
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return repeated(rows, mix(rows, row="_row"), "_row").select(*docs.columns)
