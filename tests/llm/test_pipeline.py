import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sievework.llm import langid, packing, quality
from sievework.llm.common import table

from .test_simhash import brute_components, brute_keep, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = docs.toArrow()
    model = quality.train(quality.statistics_of(docs), table(spark, SF, "labels"))
    import numpy as np

    texts = rows.column("text").to_pylist()
    ids = rows.column("doc_id").to_pylist()
    good = model.scores(np.array([quality.statistics(t) for t in texts])) >= 0.7
    stage = corpus_pipeline.quality_filter(spark, docs, SF)
    assert stage.columns == columns
    assert sorted(r.doc_id for r in stage.select("doc_id").collect()) == sorted(i for i, g in zip(ids, good) if g)

    import pyarrow as pa

    kept = [(i, t) for i, t, g in zip(ids, texts, good) if g]
    langs, sure = langid.predict_texts(langid.train(stage), pa.array([t for _, t in kept]))
    second = corpus_pipeline.language_filter(spark, stage, SF)
    assert second.columns == columns
    kept = [k for k, lang, s in zip(kept, langs, sure) if lang != "und" and s >= langid.MIN_SCORE]
    assert sorted(r.doc_id for r in second.select("doc_id").collect()) == sorted(i for i, _ in kept)

    prints = {i: slow_fingerprint(t) for i, t in kept}
    comp = brute_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, p in prints.items():
        least[comp[p]] = min(least.get(comp[p], i), i)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(least.values())

    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept if i in set(least.values())}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, empty and very long texts, clashing columns: each stage against a plain count."""
    good = "The weather was good and they went with their friends through the old town, where {} of them stayed. "
    rows = [(k, (good.format(k) + good.format(k * 7)) * 4, "en") for k in range(40)]
    rows += [(None, rows[0][1], "en"), (None, "Nobody knows who wrote this plain report about rivers and hills. " * 6, None), (5, rows[5][1], "en"), (5, "A second text under an id that was there before, about quiet gardens. " * 6, "en")]
    rows += [(100, None, "en"), (101, "", "en"), (102, "½ ² " * 50, "en"), (103, (good.format("many") + "We walked on. ") * 4000, "en"), (104, "$$ ## @@ || !! " * 60, "en")]
    schema = "doc_id long, text string, lang string, row_ int, hash_ string, id_ string, score double"
    docs = spark.createDataFrame([(*r, k, "x", "y", 0.5) for k, r in enumerate(rows)], schema)
    spark.createDataFrame([(k, int(k != 104), 0) for k in (*range(0, 40), 104, 100)] + [(200 + k, 0, 0) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    staged = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, staged, sf)
        assert after.columns == docs.columns, name
        staged = spark.createDataFrame(after.toArrow(), docs.schema)
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == docs.columns and empty.count() == 0, name
    kept = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    groups = brute_keep([(r[0], r[1]) for r in rows])
    assert len(kept) == len(groups)
    for group in groups:
        ids = [i for i, _ in group if i is not None]
        assert [r.doc_id for r in kept if (r.doc_id, r.text) in group] == [min(ids) if ids else None]
    packed = corpus_pipeline.pack(spark, docs, sf)
    assert packed.where("piece = 0").count() == len(rows)
