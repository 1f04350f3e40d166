"""The registered queries on the smallest tables: DuckDB SQL, or brute force where SQL cannot express them."""

import hashlib
import struct
import zlib

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from odspark.llm import decontam, packing, quality, unigram_count
from odspark.llm import queries as Q
from oracle_harness import compare, duck
from test_dedup import brute_bytes, brute_components, brute_judge, brute_windows
from test_small_ops import brute_contaminated
from test_tokens import BYTE, PIECES, WORD, check_packing, library_ids

SF = "/root/testdata/sf0.001"


def documents():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return t["doc_id"], t["text"], t["source"]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    ok, problems, n = compare(Q.queries()[name](spark, SF), duck(SF), Q.oracle_sql()[name])
    assert ok and n, problems


def test_suffix_dedup_query(spark):
    ids, texts, _ = documents()
    got = Q.queries()["op2_suffix_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {
        ids[k]: v for k, v in brute_bytes(texts, 400).items()}


def test_token_queries(spark):
    from tokenizers import Tokenizer, normalizers
    from tokenizers.models import Unigram
    ids, texts, _ = documents()
    uni = Tokenizer(Unigram(unigram_count.load_vocabulary(PIECES), unk_id=0, byte_fallback=True))
    uni.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = {r.doc_id: r.n_tokens for r in Q.queries()["op3_token_counts"](spark, SF).collect()}
    assert got == {i: len(uni.encode(t or "", add_special_tokens=False).ids) for i, t in zip(ids, texts)}
    start, want = 0, {}
    whole = Tokenizer.from_file(WORD)
    for i, t in sorted(zip(ids, texts)):
        tok = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (start, len(tok), zlib.crc32(struct.pack(f"<{len(tok)}I", *tok)))
        start += len(tok)
    got = Q.queries()["op4_token_store"](spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_packing_query(spark):
    ids, texts, _ = documents()
    assert ids == list(range(len(ids)))
    rows = Q.queries()["op10_packing"](spark, SF).collect()
    fill, n = check_packing(rows, texts, lambda t: library_ids(BYTE, t))
    assert n * packing.SIZE < 1.02 * fill


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on the rows the stage before kept."""
    ids, texts, sources = documents()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test-stage")
        out[name] = {r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect()
    limits = (quality.LINE_MIN_DOCS, quality.LINE_MAX_SHARE, quality.MIN_KEPT_SHARE)
    judged = brute_judge(list(zip(sources, texts)), *limits)
    left = {i: (j[3] if j[1] else t) for i, t, j in zip(ids, texts, judged) if j[2]}
    assert {i: r.text for i, r in out["quality rules"].items()} == left
    order = sorted(left)
    comp = brute_components([left[i] for i in order])
    left = {i: left[i] for k, i in enumerate(order) if comp[k][2]}
    assert {i: r.text for i, r in out["near dedup"].items()} == left
    order = sorted(left)
    windows = brute_windows([left[i] for i in order])
    got = out["substring dedup"]
    assert sorted(got) == order
    for k, i in enumerate(order):
        assert " ".join((got[i].text or "").split()) == " ".join(windows[k][2].split())
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    bad = brute_contaminated([got[i].text for i in order], list(zip(items["item_id"], items["text"])))
    left = [i for k, i in enumerate(order) if k not in {d for d, _ in bad}]
    assert sorted(out["decontamination"]) == left
    renamed = [(left.index(r.doc_id), r) for r in out["packing"]]
    from types import SimpleNamespace
    rows = [SimpleNamespace(**{**r.asDict(), "doc_id": k}) for k, r in renamed]
    check_packing(rows, [out["decontamination"][i].text for i in left], lambda t: library_ids(BYTE, t))
    assert all(hashlib.sha256(bytes(r.ids)).digest() and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in out["packing"])
    assert decontam.PERCENT == 75
