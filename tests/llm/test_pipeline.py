import hashlib
import json
from array import array

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from estimark.llm import bpe_tree, minhash_forest, pareto_mix, secret_scan, weak_rules

SF = "/root/testdata/sf0.001"


def test_stages_equal_each_operator(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    outs = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, outs[-1], SF).write.parquet(str(tmp_path / str(i)))
        outs.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(o.columns == names for o in outs[:-1])
    rows = [o.collect() for o in outs]
    kept = {r.doc_id for r in weak_rules.quality_votes(docs).collect() if r.kept}
    assert {r.doc_id for r in rows[1]} == kept and len(rows[1]) == len(kept) < len(rows[0])
    kept = {r.doc_id for r in minhash_forest.near_duplicates(outs[1], k=5, percent=80).collect() if r.kept}
    assert {r.doc_id for r in rows[2]} == kept and len(rows[2]) == len(kept) < len(rows[1])
    before = {r.doc_id: r.text for r in rows[2]}
    assert {r.doc_id for r in rows[3]} == set(before) and len(rows[3]) == len(before)
    for r in rows[3]:
        assert not secret_scan.base_spans(r.text)
        assert r.text == before[r.doc_id] or "[SECRET]" in r.text
    taken = {r.doc_id: r.copies for r in pareto_mix.mix(outs[3]).collect()}
    got = {}
    for r in rows[4]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: c for i, c in taken.items() if c}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_tree.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r.doc_id: r.text for r in rows[4]}
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        assert list(r.ids) == enc.encode_ordinary(text[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_and_odd_rows(spark, tmp_path):
    long = " ".join(f"Wort{i % 977} ist{i % 31}" for i in range(9000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "plain words of a text that has more than ten words in it", "en", None, 3),
            (3, long, "de", "s", 9), (3, long, "de", "s", 9), (4, long + " end", "de", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", "'x' size", "1 __n_words").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= {None, 3}
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
