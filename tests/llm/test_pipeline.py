"""The pipeline's stages against brute force on their own inputs, and the queries with SQL."""

import os

import pytest

import corpus_pipeline
from textwarden.llm import op8_toxicity as op8
from textwarden.llm import registry
from textwarden.llm.common import staged

from .test_operators import brute_classes, brute_hits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = staged(stage(spark, docs, SF))
        rows = out.collect()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
            after = {r.doc_id: r for r in rows}
            assert len(after) == len(rows)
        if name == "toxicity":
            model = op8.fit_tables(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {i for i, r in before.items() if model.score(op8.normal(r.text)) < 0.5}
        elif name == "line_dedup":
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            assert set(after) == set(brute_classes([(i, r.text) for i, r in before.items()]).values())
        elif name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not brute_hits(r.text, items)[1]}
        else:
            assert {r.doc_id for r in rows} == set(before)
        docs = out


def odd_tables(spark, path, rows):
    """Tables with nulls, empties, long texts, ties, repeated rows and columns of clashing names."""
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, _gone int, _host int, d int, score double, items string"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 2 == 1)) for i in range(40)] + [(None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (None, None), (3, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(k, f"Menu\n{words(k)}" + (" vile vile scoundrel" if k % 2 else ""), "en", "a" if k < 30 else None, 5) for k in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "a", 0), (52, " \n ", None, "a", 3), (53, "say the quick brown fox jumps over the lazy dog again", "en", "b", 1)]
    rows += [(54, words(54), "en", "b", 1), (54, words(54), "en", "b", 1), (55, words(54) + " more", "en", "b", 1), (None, words(54), "en", "b", 1), (None, None, None, None, None), (56, "long " * 40_000, "en", "b", 1)]
    odd_tables(spark, tmp_path, [(*r, 1, 2, 3, 0.5, "x") for r in rows])
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)))
        kept[name] = sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "line_dedup":
            assert all("Menu" not in (r.text or "") and r.n_chars == (None if r.text is None else len(r.text)) for r in docs.collect())
    clean = sorted([*range(0, 40, 2), 50, 51, 52, 53, 54, 54, 55, 56, -1, -1])
    assert kept["toxicity"] == kept["line_dedup"] == clean
    assert kept["near_dedup"] == [i for i in clean if i != 55]
    assert kept["decontamination"] == [i for i in kept["near_dedup"] if i != 53]
    assert sorted(set(kept["packing"])) == sorted(set(kept["decontamination"]))
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == kept["packing"]


def test_stages_on_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in registry.QUERIES.items():
        if name not in ("op5_html", "op7_chat"):  # they read other tables
            assert query(spark, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda d: sorted(map(tuple, d.astype(str).values.tolist()))
    assert rows(got) == rows(want)
