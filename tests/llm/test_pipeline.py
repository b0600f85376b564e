"""Every stage of the pipeline on its own input, against brute force."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers as P
from test_operators import measures, plain_spans, tokenizer

import corpus_pipeline as pipeline
from statloom.llm.common import written

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    quality, dedup, private, packing = [f for _, f in pipeline.STAGES]
    columns = docs.columns

    kept = written(quality(spark, docs, SMALL), "kept")
    assert kept.columns == columns
    before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in kept.collect()}
    for doc, r in before.items():
        n, chars, symbols, _, repeats = measures(r.text)
        if n < 10 or 100 * repeats > 20 * n or 10 * symbols > n:
            assert doc not in after
    assert all(after[d] == before[d] for d in after)

    single = written(dedup(spark, kept, SMALL), "single")
    assert single.columns == columns
    left = {r.doc_id: r for r in single.collect()}
    sets = {d: shingles(r.text) for d, r in after.items()}
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    names = sorted(left)
    assert not [(a, b) for k, a in enumerate(names) for b in names[:k] if likeness(a, b) >= 0.8]
    for gone in set(after) - set(left):
        assert max(likeness(gone, d) for d in after if d != gone) >= 0.8

    clean = written(private(spark, single, SMALL), "clean")
    assert clean.columns == columns
    for r in clean.collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        key = re.search('token = "[0-9a-f]{40}"', left[r.doc_id].text, re.I)
        assert not re.search('token = "[0-9a-f]{40}"', r.text, re.I)
        if not plain_spans(left[r.doc_id].text) and not key:
            assert r.text == left[r.doc_id].text

    t, ids = tokenizer(P.path("word_bpe_49k.json")), {}
    for r in clean.collect():
        ids[r.doc_id] = np.array(t.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
    tokens = collections.Counter()
    for r in packing(spark, clean, SMALL).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        tokens[r.doc_id] += r.length
    assert tokens == {d: len(x) for d, x in ids.items()}


def test_run_and_no_rows(spark, no_rows):
    assert pipeline.run(spark, SMALL).count() > 0
    docs = no_rows
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), "none")
    assert docs.count() == 0


def test_odd_rows(spark, odd):
    docs = odd
    for _, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), "odd")
        assert docs.columns == odd.columns
    assert pipeline.STAGES[-1][1](spark, docs, SMALL).count() > 0
