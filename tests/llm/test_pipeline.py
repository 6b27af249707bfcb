"""The pipeline's stages against plain forms of what each must keep."""

from brute import near_groups
from conftest import CLASHES, EDGES, PROSE

import corpus_pipeline
from quillstream import work_dir
from quillstream.llm import op06_chosen_path, op09_bpe
from test_operators import by_repr, deduped, sha

DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_duplicates", "decontaminate", "byte_bpe"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for number, (name, function) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        path = work_dir(spark, name)
        function(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if number < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            assert {r.doc_id for r in rows} == set(before)  # every text here has letters
        if name == "line_dedup":
            kept = {r.doc_id: sha(r.text) for r in rows}
            assert kept == {d: s for d, _, _, s in deduped([(d, r.text) for d, r in before.items()])}
        if name == "near_duplicates":
            groups = near_groups([(d, r.text) for d, r in before.items()])
            assert {r.doc_id for r in rows} == {d for d, _, _, kept in groups if kept}
        if name == "decontaminate":
            assert all(before[r.doc_id] == r for r in rows) and len(rows) < len(before)
        if name == "byte_bpe":
            assert {r.doc_id: r.decoded_sha256 for r in rows} == {d: sha(r.text) for d, r in before.items()}


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_keep_columns_that_clash(spark, edges):
    near = op06_chosen_path.stage(spark, edges, DATA)
    assert near.columns == edges.columns and near.select(*CLASHES).distinct().count() == 1
    texts = [(r.doc_id, r.text) for r in near.collect()]
    gone = {d for d, _, _, kept in near_groups([(d, t) for d, t in EDGES if d is not None]) if not kept}
    assert by_repr(texts) == by_repr((d, t) for d, t in EDGES if d not in gone)
    assert (4, PROSE) in texts and op09_bpe.stage(spark, edges, DATA).count() == len(EDGES)
