"""run() against plain Python, stage by stage, on the smallest tables."""

import collections
import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import packing, secret_scan, toxicity
from .test_dedup import _later, _near
from .test_scans import _base, _entropy

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_run(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{DATA}/labels.parquet"))
    docs = {r.doc_id: r.text for r in table.collect() if model.above(model.score(r.text or ""))[0] <= 0.5}
    docs = {i: t for i, (t, _) in _later(list(docs.items())).items()}
    docs = {i: docs[i] for i, (_, _, kept) in _near(list(docs.items())).items() if kept}
    for i, t in docs.items():
        out, at = "", 0
        for a, _, b, _ in sorted(_base(t) + _entropy(t)):
            out += t[at:a] + secret_scan.MASK if a >= at else ""
            at = max(at, b)
        docs[i] = out + t[at:]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in docs.items():
        ids, start = [*library.encode(t, add_special_tokens=False).ids, 1], 0
        for n in packing.decompose(len(ids)):
            want[i, start, tuple(ids[start : start + n])] += 1
            start += n
    got = collections.Counter((r.doc_id, r.start, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want


def test_stages(spark, nothing):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "token = abcdefghijkl0", "en", "s", 21), (3, "", "en", "s", 0)], nothing.schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, nothing, DATA).collect() == []
        docs = stage(spark, docs, DATA)
        assert docs.columns == list(corpus_pipeline.COLUMNS) or k == 4
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3}
