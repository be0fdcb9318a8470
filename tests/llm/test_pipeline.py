"""The pipeline's stages against plain versions of their decisions, on small tables."""

from __future__ import annotations

import zlib

import brute
import corpus_pipeline as cp
import numpy as np
import pytest
from inkspan.llm import mixing, quality, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = queries.table(spark, SF, "documents")
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    step = docs
    results = []
    for name, stage in cp.STAGES:
        step = cp.cut(stage(spark, step, SF), name)
        results.append(step)
    for r in results[:-1]:
        assert r.columns == COLUMNS
    ids = [sorted(x["doc_id"] for x in r.collect()) for r in results]
    assert ids[0] == sorted(r["doc_id"] for r in quality.judge(docs).filter("kept").collect())
    assert all(not brute.op9(texts[i][0])[-1] for i in ids[0])
    near = brute.op7([(i, texts[i][0]) for i in ids[0]], 5, 80)
    assert ids[1] == [i for i, _, c in near if i == c]
    bench = [(r["item_id"], r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    assert ids[2] == [r[0] for r in brute.op3([(i, texts[i][0]) for i in ids[1]], bench) if not r[2]]
    taken = {r["doc_id"]: r["n_copies"] for r in mixing.copies(results[2]).collect()}
    assert ids[3] == sorted(i for i in ids[2] for _ in range(taken[i]))
    t, at, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for i in ids[3]:
        x = np.array(t.encode(texts[i][0], add_special_tokens=False).ids + [cp.END_ID], "<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    last = sorted(tuple(r) for r in results[-1].collect())
    assert last == sorted(want)
    assert sorted(tuple(r) for r in cp.run(spark, SF).collect()) == last
