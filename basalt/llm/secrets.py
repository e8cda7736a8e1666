"""Secret scan [native]: pattern spans, and spans that look random to a pair of character Markov models.

Every expression is a DataFrame function; no Python runs on the executors. Nulls and empty texts have
no spans. Repeated rows are scanned each for itself; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import texts

_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = rf"""(?:{"|".join(map(_either_case, _KEYWORDS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run too short for 20 holds no other match
HEX = r"[0-9a-f]{24,}"
#: Runs of characters that a random string can consist of.
RANDOM = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
_SCALE = 1000


@dataclass(frozen=True)
class MarkovPair:
    """log(P(b | a, random) / P(b | a, ordinary)) in thousandths for ASCII codes a, b at a * 128 + b."""

    table: tuple[int, ...]
    #: Mean of a pair of characters, in thousandths, from which a string counts as random.
    threshold: int


def _codes(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.ascii(c))


def train(samples: DataFrame, threshold: float = 0.25, smoothing: float = 0.5) -> MarkovPair:
    """Fits both models on samples(sample, secret: 1 random, 0 ordinary). What comes to the driver is a
    count for each pair of ASCII characters and label, so at most 2 * 128 * 128 rows at any size."""
    codes = samples.where(F.col("sample").isNotNull()).select("secret", _codes(F.col("sample")).alias("c"))
    pairs = codes.where(F.size("c") > 1).select("secret", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(F.get("c", i).alias("a"), F.get("c", i + 1).alias("b")))).alias("p"))
    counts = pairs.where("p.a < 128 and p.b < 128").groupBy("secret", "p.a", "p.b").count().collect()
    import math

    seen: dict = {}
    total: dict = {}
    for label, a, b, n in counts:
        seen[label, a, b] = n
        total[label, a] = total.get((label, a), 0) + n
    alphabet = 67  # letters, digits and + / _ = -

    def log_p(label, a, b):
        return math.log((seen.get((label, a, b), 0) + smoothing) / (total.get((label, a), 0) + smoothing * alphabet))

    table = tuple(round(_SCALE * (log_p(1, a, b) - log_p(0, a, b))) for a in range(128) for b in range(128))
    return MarkovPair(table, round(threshold * _SCALE))


def generated_samples(ordinary_texts: DataFrame, n: int = 3000) -> DataFrame:
    """Labelled samples: n digests written as base64, hex or mixed letters and digits (random), and the words of
    ordinary_texts(text) alone and joined as identifiers (ordinary)."""
    spark = ordinary_texts.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    random = spark.range(0, n, 1, 4).select(F.when(F.col("id") % 3 == 0, b64).when(F.col("id") % 3 == 1, F.regexp_replace(b64, "[+/=]", "")).otherwise(digest).alias("sample"), F.lit(1).alias("secret"))
    words = ordinary_texts.select(F.regexp_extract_all(F.col("text"), F.lit(r"[A-Za-z]{2,}"), F.lit(0)).alias("w")).where(F.size("w") > 1)
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.array(F.get("w", i), F.get("w", i + 1)))).alias("p"))
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    forms = F.array(a, F.concat_ws("_", F.lower(a), F.lower(b)), F.concat_ws("-", F.lower(a), F.lower(b)), F.concat(F.lower(a), F.initcap(b)), F.upper(F.concat_ws("_", a, b)), F.concat(F.lower(a), F.lit("/"), F.lower(b)), F.concat(F.lower(a), F.lower(b)))
    return random.unionByName(pairs.select(F.explode(forms).alias("sample"), F.lit(0).alias("secret")))


#: Items that a running fold joins at a time.
_BLOCK = 256


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(items: Column, start: Column, step, kind: str) -> Column:
    """An array (of type kind) of what step(state, item) gives as second for each item; its first is the next state. Joined in
    blocks, then blocks: joining one by one would copy all of an array for each item."""

    def one(state, item):
        return _let(F.struct(*(c.alias(n) for c, n in zip(step(state["state"], item), ("state", "out"), strict=True))), lambda x: F.struct(x["state"].alias("state"), F.concat(state["out"], F.array(x["out"])).cast(kind).alias("out")))

    def block(state, some):
        done = F.aggregate(some, F.struct(state["state"].alias("state"), F.array().cast(kind).alias("out")), one)
        return _let(done, lambda x: F.struct(x["state"].alias("state"), F.concat(state["out"], F.array(x["out"])).cast(f"array<{kind}>").alias("out")))

    def whole(xs):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda k: F.slice(xs, k * _BLOCK + 1, F.lit(_BLOCK)))
        folded = F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), block)
        return F.when(F.size(xs) > 0, F.flatten(folded["out"])).otherwise(F.array().cast(kind))

    return _let(items, whole)


_SPAN = "struct<start:int,rank:int,end:int,m:string,v:string>"


def _spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Leftmost non-overlapping matches as an array of (start, rank, end, m: the match, v: its value), in code points.

    The pieces between matches give the starts. Texts without a match skip both passes."""
    found = F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(F.split(text, pattern, -1)) - 1, F.lit(0))),
        F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if keep else 0)).alias("v")),
        lambda piece, m: F.struct(F.length(piece).alias("gap"), m["m"].alias("m"), m["v"].alias("v")),
    )

    def step(at, x):
        end = at + x["gap"] + F.length(x["m"])
        return end, F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["m"].alias("m"), x["v"].alias("v"))

    walked = _running(found, F.lit(0), step, f"array<{_SPAN}>")
    kept = F.filter(walked, keep) if keep else walked
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _free(runs: Column, base: Column) -> Column:
    """The runs that no base span overlaps: none before ends after their start, none after starts before their end. Two passes
    over all spans in order of starts."""
    kind = f"array<struct<s:{_SPAN},free:boolean>>"
    is_base = lambda s: s["rank"] < 3
    ahead = _running(F.array_sort(F.concat(base, runs)), F.lit(-1), lambda end, s: (F.when(is_base(s), F.greatest(end, s["end"])).otherwise(end), F.struct(s.alias("s"), (is_base(s) | (end <= s["start"])).alias("free"))), kind)
    back = _running(F.reverse(ahead), F.lit(2**31 - 1), lambda start, x: (F.when(is_base(x["s"]), F.least(start, x["s"]["start"])).otherwise(start), F.struct(x["s"].alias("s"), (x["free"] & ~is_base(x["s"]) & (start >= x["s"]["end"])).alias("free"))), kind)
    alone = F.transform(F.filter(back, lambda x: x["free"]), lambda x: x["s"])
    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(alone)


def is_random(s: Column, model: MarkovPair) -> Column:
    """Whether the mean log-likelihood ratio of s's character pairs reaches the model's threshold."""
    table = F.split(F.lit(",".join(map(str, model.table))), ",").cast("array<int>")
    total = F.aggregate(
        _codes(s),
        F.struct(F.lit(-1).alias("last"), F.lit(0).cast("bigint").alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0)).otherwise(F.coalesce(F.get(table, acc["last"] * 128 + c), F.lit(0)))).alias("sum")),
    )["sum"]
    return total >= (F.length(s) - 1) * F.lit(model.threshold)


def _digest(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """doc_id and found: every span of a text as (start, rank in KINDS, end, m: the match), by start, then rank.

    Pattern spans always stay; a run of characters counts as random only where no pattern span overlaps it.
    """
    t = F.col("text")
    base = texts(docs).select(
        "doc_id", "text",
        _spans(t, ASSIGN, 0, keep=lambda s: F.length(s["v"]) >= 6).alias("assign"),
        _spans(t, ACCESS, 1).alias("access"),
        _spans(t, HEX, 2).alias("hex"),
        _spans(t, RANDOM, 3).alias("runs"),
    )
    base = base.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    base = base.withColumn("free", _free(F.col("runs"), F.col("base")))
    free = F.filter("free", lambda r: is_random(r["m"], model))
    return base.select("doc_id", "assign", "access", "hex", "base", F.array_sort(F.concat(F.col("base"), free)).alias("found"))


def summary(docs: DataFrame, model: MarkovPair) -> DataFrame:
    """Counts by kind, the digest of the pattern spans, and all spans as kind:start:end."""
    found = scan(docs, model)
    return found.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _digest(F.col("found")).alias("spans"),
    )
