from __future__ import annotations

import collections
import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
import test_decontaminate
import test_quality
import test_secret_scan
from dossier.llm import packing, quality
from dossier.storage import materialize, new_path, read_table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_stages_take_effect(spark):
    docs = read_table(spark, SF, "documents")
    columns, ids = docs.columns, [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert len(ids[1]) < len(ids[0]) and ids[4] == ids[3]
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    assert {i for i, q in labels.items() if q == 1} & ids[0] <= ids[1]
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == ids[4]


def test_stages_on_odd_tables(spark, clashing, empty_docs):
    for docs in (clashing, empty_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()


def plain_quality(docs, labels):
    least = {}
    for doc_id, label in labels:
        if doc_id is not None and label is not None:
            least[doc_id] = min(label, least.get(doc_id, label))
    x = {i: np.array(test_quality.plain_statistics(t)) for i, t in docs.items()}
    learnt = [[v for i, v in x.items() if least.get(i) == k and zlib.crc32(str(i).encode()) % 5] for k in range(2)]
    stacked = [np.stack(v) if v else np.zeros((0, len(quality.FEATURES))) for v in learnt]
    model = quality.solve(np.array([float(len(v)) for v in stacked]), np.stack([v.sum(0) for v in stacked]), np.stack([v.T @ v for v in stacked]))
    return {i: t for i, t in docs.items() if model.score(x[i][None])[0] >= quality.THRESHOLD}


def plain_dedup(docs):
    def shingle_set(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None

    sets = {i: shingle_set(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: t for i, t in docs.items() if find(i) == i}


def plain_redaction(text):
    out, at = "", 0
    for span in filter(None, test_secret_scan.brute(text).split(",")):
        kind, start, end = span.split(":")
        if int(start) >= at:
            out += text[at : int(start)] + f"<{kind}>"
        at = max(at, int(end))
    return out + text[at:]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_pipeline_against_plain_loops(spark):
    """Every stage's rows and the ids that the pieces stand for, by loops over all documents, pairs and windows of the smallest tables."""
    docs = {r["doc_id"]: r["text"] for r in read_table(spark, SF, "documents").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in read_table(spark, SF, "labels").collect()]
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    good = plain_quality(docs, labels)
    single = plain_dedup(good)
    tainted = {i for i, _ in test_decontaminate.brute(list(single.items()), items)}
    clean = {i: plain_redaction(t or "") for i, t in single.items() if i not in tainted}
    assert len(docs) > len(good) and clean
    packed = corpus_pipeline.run(spark, SF).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(clean)
    encoder = packing._encoder(packing.default_tokenizer_path(), packing.default_ranks_path())
    for i, own in pieces.items():
        ids, at = np.asarray([*encoder.exact.encode(clean[i], add_special_tokens=False).ids, 2], dtype="<u4"), 0
        for p in sorted(own, key=lambda p: p["piece"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_shared_ledger_changes_nothing(spark, edge_docs):
    first = sorted(map(repr, corpus_pipeline.secret_scans(spark, edge_docs, SF).collect()))
    spark.conf.set(corpus_pipeline.LEDGER_SETTING, new_path(spark, "shared-ledger"))
    try:
        for _ in range(2):
            assert sorted(map(repr, corpus_pipeline.secret_scans(spark, edge_docs, SF).collect())) == first
    finally:
        spark.conf.unset(corpus_pipeline.LEDGER_SETTING)


def test_packing_stage_on_odd_tables(spark, clashing, empty_docs):
    assert corpus_pipeline.best_fit_packing(spark, empty_docs, SF).count() == 0
    packed = corpus_pipeline.best_fit_packing(spark, clashing, SF).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert sum(r["piece"] == 0 for r in packed) == clashing.count()
