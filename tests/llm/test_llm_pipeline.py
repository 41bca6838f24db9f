"""The pipeline stage by stage against what each stage promises."""

import corpus_pipeline
from llm_cases import words
from test_llm_meaning import base_spans
from test_llm_text import measures, shingles
from test_llm_vectors import shares

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-dedup", "personal data", "mixing", "packing"]
    start = {r.doc_id: r for r in docs.collect()}
    step = []
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).cache()
        step.append(docs.collect())
    assert all([*r.asDict()][:5] == columns for s in step for r in s[:1])
    good = {r.doc_id for r in step[0]}
    for i, r in start.items():
        n, chars, symbols, lines, dup, rep = measures(r.text)
        assert (i in good) == (n >= 50 and 100 * rep <= 50 * n and 10 * symbols <= n and 100 * dup <= 50 * lines and 2 * n <= chars <= 12 * n)
    sets = {i: shingles(start[i].text, 5) for i in good}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    kept = {r.doc_id for r in step[1]}
    assert kept <= good and not any(near(a, b) for a in kept for b in kept if a < b)
    assert all(any(near(i, j) for j in good if j != i) for i in good - kept)
    assert {r.doc_id for r in step[2]} == kept
    assert not any(base_spans(r.text) for r in step[2])
    assert all(r.text == start[r.doc_id].text for r in step[2] if not any(c.isdigit() for c in start[r.doc_id].text))
    size = {}
    for r in step[2]:
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    want = shares(size)
    for s in size:
        got = sum(len(words(r.text)) for r in step[3] if r.source == s)
        assert abs(got - want[s]) <= 64
    assert sorted((r.doc_id, r.text) for r in step[3]) == sorted((r.doc_id, r.text) for r in step[4])
    assert all(r.n_tokens == len(words(r.text)) <= r.bucket_len for r in step[4])
    assert len({(r.bucket, r.batch, r.slot) for r in step[4]}) == len(step[4])
