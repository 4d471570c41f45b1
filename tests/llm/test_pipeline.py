"""The pipeline's stages against the operators' rules, on whole small tables."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_pairs import plain_components, plain_hits

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    docs = docs.union(odd).union(docs.filter("doc_id = 1")).withColumn("n_words", F.lit("clash"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.stash(stage(spark, docs, SF), name)
        assert docs.columns == [*before[0].asDict()]
        steps[name] = before, docs.collect()
    before, after = steps["quality_rules"]
    assert 0.6 * len(before) < len(after) < len(before) and all(r.text for r in after)
    before, after = steps["minhash_near_dedup"]
    found = plain_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in found.values()})
    before, after = steps["benchmark_decontamination"]
    clean = [r.doc_id for r in before for n, k, _ in [plain_hits(r.text, items)] if not (k and 20 * k >= n)]
    assert sorted(r.doc_id for r in after) == sorted(clean)
    before, after = steps["mix_sources"]
    copies = Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 2 and {r.doc_id for r in after} <= {r.doc_id for r in before}
    size = sum(len(r.text.split()) for r in before)
    assert abs(sum(len(r.text.split()) for r in after) / (1.5 * size) - 1) < 0.25
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    start = 0
    for r, d in zip(got, sorted(after, key=lambda r: r.doc_id), strict=True):
        ids = [*tok.encode(d.text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


#: Names that the stages and operators use inside.
INSIDE = ["row", "h1", "h2", "key", "id", "k", "k1", "bad_id", "bad_h", "stats", "s", "votes", "n_words", "copies", "times", "part", "n", "kept", "component_id", "place", "source_size", "size", "segment", "spans", "copy"]


def test_odd_rows_and_clashing_columns(spark):
    good = " ".join(f"word{i} goes here" for i in range(60))
    rows = [(1, "a b"), (2, ""), (3, None), (None, good), (4, good + " end"), (4, good + " end"), (5, good[::-1]), (5, good.upper()), (6, "y " * 400_000), (7, " ".join(str(k * k) for k in range(150_000)))]
    docs = spark.createDataFrame([(*r, "en", None if i % 2 else "s", 5) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in INSIDE}).withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept[name] = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in out.collect())
    texts = {k: (t or "")[:20] for k, t in rows}
    assert kept["quality_rules"] and all(t for _, t in kept["quality_rules"])
    # Of id 4's equal rows one stays. An id is one document: a text of id 5 is like id 4's, so id 5 goes. The text without an id is linked with nothing.
    assert kept["minhash_near_dedup"] == sorted((k or 0, (t or "")[:20]) for k, t in dict(rows).items() if k != 5)
    assert len(kept["benchmark_decontamination"]) == len(rows)
    assert set(kept["mix_sources"]) <= {(k or 0, (t or "")[:20]) for k, t in rows} and texts[7] in {t for _, t in kept["mix_sources"]}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
