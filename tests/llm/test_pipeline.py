"""Each stage against a brute-force version on what its predecessor kept."""
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from test_jaccard import brute

from basalt.llm import mixing, packing, quality
from basalt.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        kept.append((docs, docs := spark.read.parquet(f"{tmp_path}/{k}")))
        assert k == 4 or docs.columns == columns, name
    texts = [({r.doc_id: r.text for r in a.collect()}, Counter(r.doc_id for r in b.collect())) for a, b in kept]

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.score(kept[0][0], labels).collect() if r.predicted}
    assert texts[0][1] == Counter(good)
    y = {r.doc_id: r.quality for r in labels.collect()}
    fine = [i for i in texts[0][0] if y.get(i) == 1]
    assert sum(i in good for i in fine) >= 0.9 * len(fine)

    first = {}
    for i, t in sorted(texts[1][0].items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert texts[1][1] == Counter(first.values())

    assert texts[2][1] == Counter(i for i, (_, c) in brute(list(texts[2][0].items())).items() if i == c)

    copies = {r.doc_id: r.copies for r in mixing.mix(kept[3][0]).collect()}
    assert texts[3][1] == Counter({i: n for i, n in copies.items() if n}) and max(copies.values()) <= 2

    tok = Tokenizer.from_file(packing.default_tokenizer())
    n = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts[4][0].items()}
    assert texts[4][1] == Counter({i: -(-n[i] // 2048) * c for i, c in texts[3][1].items()})
    rows = kept[4][1].collect()
    total = sum(r.length for r in rows)
    assert total == sum(n[i] * c for i, c in texts[3][1].items()) and len({r.sequence_id for r in rows}) <= -(-total // 2048) + 1


def test_run_and_query(spark):
    a = QUERIES["pipeline"](spark, SF)
    assert a.count() > 100 and corpus_pipeline.ORACLE_SQL is None



def test_null_doc_ids_go_through_all_stages(spark):
    """Rows without doc_id that the first stages keep are in the mix as often as it has copies of them, and are packed."""
    from basalt.llm.common import stored

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = docs.where("doc_id is not null").orderBy(F.length("text").desc()).limit(40).withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.concat("text", F.lit(" alone")))
    out = docs.unionByName(odd)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        if name == "mixing sources":
            want = mixing.mix(out).where("doc_id is null").agg(F.sum("copies")).head()[0]
        out = stored(stage(spark, out, d), "stage")
        counts.append(out.where("doc_id is null").count())
    assert want > 0 and all(counts) and counts[3] == want
