import hashlib
import re

from basalt.llm import secrets
from basalt.llm.queries import QUERIES

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ("assign", "access", "hex", "random")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def all_spans(text, model):
    base = base_spans(text)
    runs = [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 20]

    def random(s):
        return sum(model.table[ord(a) * 128 + ord(b)] for a, b in zip(s, s[1:])) >= (len(s) - 1) * model.threshold

    free = [r for r in runs if not any(b[0] < r[2] and r[0] < b[2] for b in base) and random(text[r[0] : r[2]])]
    return sorted(base + free)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


CASES = [
    None, "", " ", "password=abcdef", "Password: 'abcdefg' token=abc", "password=token: abcdefgh", "api_key=\"sk-12345678\" apikey: x", "AKIA" + "A" * 15, "AKIA" + "Q" * 16 + " AKIA",
    "aAKIAAKIA" + "7" * 20, "deadbeef" * 3, "deadbee" * 3, "é😀 secret = s3cr3t-value 😀 " + "0123456789abcdef" * 2, "tokentoken=token=abcdef", "x" * 100000 + " passwd=hunter22 " + "ab" * 30,
    "key qZ8vK2xW9pLm3RtY7uB4nC6j end", "the_ordinary_identifier_name_here andAnotherCamelCaseOneToo", "password=abcdef", "ſecret=abcdef toKen=abcdef",
]


def check(spark, docs, model, texts):
    got = {r.doc_id: r for r in secrets.summary(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        text, r = text or "", got[i]
        base = base_spans(text)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in base) for k in range(3)], text[:80]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert r.spans == joined(all_spans(text, model)), text[:80]


def test_cases_and_the_small_tables_match_brute_force(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    model = secrets.train(secrets.generated_samples(bench))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, spans string")
    check(spark, docs, model, dict(enumerate(CASES)))
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, real, model, {r.doc_id: r.text for r in real.collect()})


def test_models_tell_random_strings_from_identifiers(spark):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    model = secrets.train(secrets.generated_samples(bench))
    good = ["qZ8vK2xW9pLm3RtY7uB4nC6j", hashlib.sha256(b"1").hexdigest()[:23].upper() + "xYz", "aGVsbG8gd29ybGQgMTIzNDU2Nzg5MA=="]
    bad = ["the_ordinary_identifier_name", "and-another-one-with-hyphens", "theThingThatIsInTheOther", "thentionthenerationing", "THE_CONSTANT_THAT_IS_HERE"]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = [bool(r.spans) for r in secrets.summary(docs, model).orderBy("doc_id").collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_empty_table(spark):
    model = secrets.train(spark.createDataFrame([], "sample string, secret int"))
    assert secrets.summary(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_query(spark):
    assert QUERIES["op1_secret_scan"](spark, "/root/testdata/sf0.001").count() == 200


def test_one_text_of_many_matches(spark):
    """Spans of a text with more matches than a block of the running folds holds; random runs only where no other span is."""
    model = secrets.MarkovPair((1000,) * (128 * 128), 0)  # every run counts as random
    parts = ["password=abc%06d" % k if k % 3 else "deadbeef" * 3 + "%04x" % k for k in range(3000)] + ["Zq+" * 9, "token: " + "deadbeef" * 4]
    text = "é ".join(parts)
    row = secrets.summary(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()[0]
    base = [("assign", m.start(), m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[1]) >= 6] + [("hex", m.start(), m.end()) for m in re.finditer(secrets.HEX, text)]
    runs = [("random", m.start(), m.end()) for m in re.finditer(secrets.RANDOM, text)]
    free = [r for r in runs if not any(b[1] < r[2] and r[1] < b[2] for b in base)]
    want = sorted(base + free, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    assert row.n_assign == 2001 and row.n_hex == 1001 and free
    assert row.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
