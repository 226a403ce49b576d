"""Each stage of the pipeline on rows with nulls, empty and long texts, repeats, shared ids, an extra column, and on an empty table."""

import pytest

import corpus_pipeline
from ravelin.llm.common import table

SF = "/root/testdata/sf0.001"
PROSE = "The committee met in the old town hall and agreed that the bridge should be repaired before winter, since the river rises every year. "


@pytest.fixture(scope="module")
def odd(spark):
    docs = table(spark, SF, "documents")
    kind = docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    rows = [(None, PROSE * 3, "en", "s", 1), (1, None, None, None, None), (1, "", "en", "s", 0), (2, PROSE * 3000, "en", None, 1), (3, PROSE, "en", "s", 1), (3, PROSE, "en", "s", 1), (3, PROSE + "Nobody objected.", "en", "t", 1), (4, " \n\t ", "en", "s", 4)]
    made = spark.createDataFrame(rows, kind).select(*docs.columns)
    return docs.unionByName(made).selectExpr("*", "'x' AS score", "1 AS key")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, odd, name, stage):
    got = stage(spark, odd, SF).collect()
    if name == "packing":
        by_doc = {}
        for r in got:
            by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
        assert sorted(((r.sequence_id, r.offset) for r in got)) == sorted({(r.sequence_id, r.offset) for r in got}) and None in by_doc and by_doc[1] >= 2
        assert {r.doc_id for r in got} == {r.doc_id for r in odd.select("doc_id").collect()}
    else:
        assert set(got[0].asDict()) == set(corpus_pipeline.COLUMNS)
        texts = [(r.doc_id, r.text) for r in got]
        if name == "quality":
            # A text alone decides: all rows of it stay or none.
            whole = [(r.doc_id, r.text) for r in odd.collect()]
            stay = {t or "" for _, t in texts}
            assert sorted(texts, key=str) == sorted((r for r in whole if (r[1] or "") in stay), key=str) and 0 < len(texts) < len(whole)
        if name == "near_copies":
            # The texts of repeated prose share their shingles; one of those without any stays, and one of the null and empty ones.
            assert len(texts) == len(set(texts)) and sum(not t for _, t in texts) == 1 and sum((t or "").startswith("The committee") for _, t in texts) <= 2
        if name == "passages":
            assert len(got) == odd.count() and all(r.n_chars == len(r.text) for r in got)
            left = {t for i, t in texts if i == 2 and t.startswith(PROSE[:20])}
            assert len(left) == 1 and len(left.pop()) < len(PROSE) * 3
    assert stage(spark, odd.limit(0), SF).count() == 0
