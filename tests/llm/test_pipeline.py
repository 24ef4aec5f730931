"""The pipeline against its stages in plain Python."""

import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tabloom.llm import quality, secrets, toxicity

from .conftest import frame
from .test_packing import gapless
from .test_secrets import ASSIGN
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.01"


def redacted(text):
    import re

    spans = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]{16,}|(?<![0-9a-f])[0-9a-f]{24,}", text)]
    out, at = "", 0
    for start, end in sorted(spans):
        if start > at or not out:
            out += text[at:start] + secrets.MARK
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def rows(spark):
    return corpus_pipeline.run(spark, SF).collect()


def test_rows_by_brute_force(spark, rows):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    left = [r for r in docs.collect() if r.doc_id in good]
    model = toxicity.learn(docs.where(docs.doc_id.isin(list(good))), spark.read.parquet(f"{SF}/labels.parquet"))
    left = [r for r, s in zip(left, model.scores([r.text for r in left])) if s < 0.5]
    parts = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in left])
    left = {r.doc_id: redacted(r.text) for r in left if parts[r.doc_id] == r.doc_id}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, text in left.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids), 2048), len(ids)]
        want |= {(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    gapless(rows, 2048)


def test_stages_keep_the_columns(spark, clash):
    docs = clash(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).unionByName(clash(frame(spark, [None, "", "x"], [1, None, 2])))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()


def test_empty_documents(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.collect() == [] and "sequence_id" in docs.columns
