from test_decontaminate import brute as leaks
from test_line_dedup import brute as without_lines
from test_simhash import brute_components

import __spark_entry__ as driver
import corpus_pipeline
from tessera.llm.queries import MODEL
from tessera.llm.sentencepieces import Codec
from tessera.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, after = read(docs), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns[:5] == COLUMNS and (out.columns == COLUMNS or i == 4)
        out.write.parquet(f"{tmp_path}/{i}")
        after[name] = read(spark.read.parquet(f"{tmp_path}/{i}"))
        given = [(d, r["text"]) for d, r in before.items()]
        if name == "toxicity":
            judged = toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
            assert set(after[name]) == {r["doc_id"] for r in judged if r["score"] < 0.5}
        elif name == "line_dedup":
            wanted = {d: t for d, t, _, _ in without_lines(given)}
            assert {d: r["text"] for d, r in after[name].items()} == wanted
            assert all(r["n_chars"] == len(r["text"]) for r in after[name].values())
        elif name == "simhash_near_dedup":
            assert set(after[name]) == {root for _, _, root in brute_components(given)}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            found = {d for d, _ in leaks(given, items)}
            assert set(after[name]) == set(before) - found and found
        else:
            coder = Codec(MODEL)
            ids = coder.encode([r["text"] for r in after[name].values()])
            assert [r["token_ids"] for r in after[name].values()] == [i.tolist() for i in ids]
            assert set(after[name]) == set(before) and all(r["decodes"] for r in after[name].values())
        if name != "line_dedup":
            assert all(r[c] == before[d][c] for d, r in after[name].items() for c in COLUMNS)
        before, docs = after[name], spark.read.parquet(f"{tmp_path}/{i}")
    whole = read(driver.queries()["pipeline"](spark, sf))
    assert whole == after["sentencepiece"]


def test_odd_rows_through_every_stage(spark, odd, sf):
    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "n_words AS component_id", "count AS id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        n = out.count()
        assert n <= docs.count(), name
        assert out.columns[: len(docs.columns)] == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    ids = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))


def test_registered():
    names = driver.queries()
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    numbers = sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14))
    assert set(driver.oracle_sql()) <= set(names)
