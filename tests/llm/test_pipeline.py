"""The pipeline on the smallest tables, stage by stage against brute force."""

from __future__ import annotations

import os

import corpus_pipeline
import pytest
from brute_force import components, digest, item_copies
from test_repeats import without_repeats
from tokenizers import Tokenizer

from pairlab.llm import queries

SF_DIR = os.environ.get("PAIRLAB_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = queries.read(spark, SF_DIR, "documents")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, frames[-1], SF_DIR).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_columns(written):
    assert [len(written)] == [6]
    assert all(f.columns == written[0].columns for f in written[:5])


def test_lines(written):
    texts, _ = without_repeats(pairs(written[1]))
    assert dict(pairs(written[2])) == texts
    rows = written[2].select("text", "n_chars").collect()
    assert all(len(r.text) == r.n_chars for r in rows)


def test_near_copies(written):
    found = components(pairs(written[2]))
    want = {i for i, n, c, _ in found if not n or c == i}
    assert {i for i, _ in pairs(written[3])} == want


def test_decontamination(spark, written):
    items = queries.read(spark, SF_DIR, "benchmark").select("item_id", "text").collect()
    bad = {i for i, _ in item_copies(pairs(written[3]), [tuple(r) for r in items])}
    before = {i for i, _ in pairs(written[3])}
    assert {i for i, _ in pairs(written[4])} == before - bad and bad


def test_tokens(written):
    library = Tokenizer.from_file(queries.vocabulary())
    texts = dict(pairs(written[4]))
    for row in written[5].collect():
        own = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == own and row.n_tokens == len(own)
        assert row.decoded_sha256 == digest(texts[row.doc_id] or "")


def test_run_gives_the_same(spark, written):
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(found) == sorted(written[5].collect())
