"""The pipeline against a version in plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from lintarium.llm import bpe, mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_agree_with_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.documents([(r["text"] or "").encode() for r in rows], {})[0]
    clean = [r for r, s in zip(rows, scores) if s < 0.7]
    best = {}
    for r in clean:
        key = b"".join((r["text"] or "").encode().split())
        if key not in best or (-len(r["text"] or ""), r["doc_id"]) < (-len(best[key]["text"] or ""), best[key]["doc_id"]):
            best[key] = r
    single = list(best.values())
    # Near copies: groups of texts with a Jaccard index of 0.8 or more over shingles of five words keep their least id each.
    sets = {}
    for r in single:
        words = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids, up = sorted(sets), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    near = corpus_pipeline.near(spark, spark.createDataFrame(single, docs.schema), SF)
    stay = {r["doc_id"] for r in near.collect()}
    assert {root(i) for i in ids} <= stay and len(stay) <= len({root(i) for i in ids}) + 0.1 * sum(root(i) != i for i in ids)
    left = [r for r in single if r["doc_id"] in stay]
    table = spark.createDataFrame(left, docs.schema)
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(table).collect()})
    text = {r["doc_id"]: r["text"] or "" for r in left}
    codec = bpe.codec(open(bpe.default_tokenizer(), "rb").read())
    want = Counter({(i, len(codec.encode(text[i])) // 4): n for i, n in copies.items() if n})

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == rows[0].__fields__, name
    got = Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]
    assert defaultdict(int, Counter(n for n, _ in corpus_pipeline.STAGES)) == {n: 1 for n, _ in corpus_pipeline.STAGES}
