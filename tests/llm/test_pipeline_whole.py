"""What leaves the pipeline."""

import hashlib

import corpus_pipeline as cp
from corvane.llm.common import read

SF = "/root/testdata/sf0.001"


def test_ids_and_text_leave_the_pipeline(spark):
    rows = cp.bpe_stage(spark, read(spark, SF, "documents").limit(50), SF).collect()
    assert len(rows) == 50 and sum(r["n_tokens"] for r in rows) > 0
    for r in rows:
        assert len(r["ids"]) == r["n_tokens"]
        assert hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"]
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
