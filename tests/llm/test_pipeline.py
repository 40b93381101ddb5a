"""The pipeline over sf0.001 against the stages' rules, worked out in plain Python."""

from collections import Counter, defaultdict

import corpus_pipeline
from lumenframe.llm import packing, quality
from lumenframe.llm.common import table
from tests.llm.test_copies import brute as brute_copies
from tests.llm.test_lines_mixing import brute_lines
from tests.llm.test_packing import check_layout

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_rules(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    docs = table(spark, FOLDER, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality.train(docs, table(spark, FOLDER, "labels"))
    import numpy as np

    good = [i for i, r in rows.items() if model.score(np.array([quality.features(r["text"])]))[0] >= 0.5]
    texts = brute_lines([(i, rows[i]["text"]) for i in good])
    first = {i for i, c in brute_copies(texts) if i == c}
    kept = {i: t for i, t in texts if i in first}
    totals = Counter()
    for i, t in kept.items():
        totals[rows[i]["source"]] += len(t.split())
    stages = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stages = stage(spark, stages, FOLDER)
        assert stages.schema == docs.schema
        if k == 2:
            assert {r["doc_id"]: r["text"] for r in stages.collect()} == kept
    mixed = Counter(r["doc_id"] for r in stages.collect())
    assert set(mixed) == set(kept)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    check_layout(got, packing.CAPACITY)
    whole = defaultdict(int)
    for r in got:
        whole[r["doc_id"]] += r["length"]
    encode = packing._encoder(packing.tokenizer_path())
    assert whole == {i: n * (len(encode(kept[i])) + 1) for i, n in mixed.items()}


def test_odd_rows_go_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, __x string"
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "a", 0, 0.1, "q"), (3, "word " * 30_000, "en", "a", 1, 0.1, "q"), (3, "word " * 30_000, "en", "a", 1, 0.1, "q"), (None, "x y z", "en", "b", 5, 0.1, "q")]
    docs = spark.createDataFrame(rows, schema)
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            d = stage(spark, d, FOLDER)
            assert d.columns == docs.columns, name
        corpus_pipeline.STAGES[4][1](spark, d, FOLDER).collect()



def test_batches_have_a_bound_of_bytes(spark):
    """Long texts go to Python in batches of some megabytes, not 10,000 at once; a bound that the session has stays."""
    import pyarrow as pa

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = corpus_pipeline.BATCH
    texts = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat('abcd efg ', 1000) as text", "'a' as source")
    before = spark.conf.getAll.get(key)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, texts.limit(0), FOLDER)
            assert max(r["n"] for r in texts.mapInArrow(size, "n long").collect()) <= 2 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(key, "12345678")
        corpus_pipeline.STAGES[2][1](spark, texts.limit(0), FOLDER)
        assert spark.conf.get(key) == "12345678"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
