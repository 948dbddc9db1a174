"""The pipeline's stages, each on its input."""

import corpus_pipeline
from lemmata.llm import quality
from lemmata.llm.common import read

from test_jaccard import kept as brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    names = docs.columns
    for name, f in corpus_pipeline.STAGES[:-1]:
        kept = f(spark, docs, SF)
        assert kept.columns == names and kept.dtypes == docs.dtypes
        before, after = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, kept))
        assert after <= before
        if name == "quality rules":
            led = {r["doc_id"]: r["fail_bits"] for r in quality.ledger(docs, keep=["doc_id"]).collect()}
            assert after == {k for k, b in led.items() if not b & quality.mask(quality.POLICIES["web-2"])}
        if name.startswith("near-dedup"):
            # five-word Jaccard similarity of 0.8 or more, by brute force
            rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
            assert after == {rows[i][0] for i in brute([t for _, t in rows])}
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in last} == after
    assert sorted(r["sequence_id"] for r in last) == list(range(len(last)))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
