import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators.cells import melt
from tessera.plans import bulk, store
from tessera.plans.query import query
from tessera.plans.store import Dataset
from tessera.session import scratch


@pytest.fixture
def root(spark):
    return scratch(spark, "bulk")


def sources(spark, *ids):
    return spark.createDataFrame([(i, f"raw/{i}.csv", f"wiki/{i}.md", "0" * 64) for i in ids], "source_id string, source_resource string, summary_page string, content_checksum string")


def cells(spark, rows):
    """``rows``: (source, dataset, row, [(label, text)])."""
    long = [(s, d, k, label, text, "null" if text is None else "str", n) for s, d, n, row in rows for k, (label, text) in enumerate(row)]
    return spark.createDataFrame(long, "source_id string, dataset string, pos int, column string, text string, tag string, _row long")


ROWS = [
    ("a", "People", 0, [("CPF", "529.982.247-25"), ("Nascimento", "01/02/1990"), ("Valor", "10"), ("valor", "x")]),
    ("a", "People", 1, [("CPF", "111.444.777-35"), ("Nascimento", "31/02/1990"), ("Valor", "-3"), ("valor", None)]),
    ("a", "people", 0, [("k", "1.5"), ("when", "2024-05-06 07:08")]),
    ("a b", "T", 5, [("source_id", "true"), ("1", "0012")]),
    ("a b", "T", 2, [("source_id", "false"), ("1", "7")]),
    ("a-b", "T", 0, [("only", None)]),
]


def test_tables_equal_those_stored_one_by_one(spark, root):
    stored = bulk.persist_many(spark, root, sources(spark, "a", "a b", "a-b", "none"), cells(spark, ROWS))
    assert sorted({r["table_name"] for r in stored.collect()}) == ["a__people", "a__people_2", "a_b__t", "a_b__t_2"]
    assert sorted(r["source_id"] for r in store.catalog(spark, root, "sources").collect()) == ["a", "a b", "a-b", "none"]
    other = scratch(spark, "single")
    by_source = {}
    for s, d, n, row in ROWS:
        by_source.setdefault(s, {}).setdefault(d, []).append((n, row))
    for s, datasets in by_source.items():
        made = []
        for d, rows in sorted(datasets.items()):
            labels = [label for label, _ in rows[0][1]]
            schema = ", ".join(["_row long", *(f"`c{k}` string" for k in range(len(labels)))])
            df = spark.createDataFrame([(n, *(t for _, t in row)) for n, row in rows], schema).toDF("_row", *labels) if len({x.lower() for x in labels}) == len(labels) else None
            made.append(Dataset(d, df) if df is not None else None)
        if None in made:
            continue
        store.persist_source(spark, other, s, "raw/x", "x.md", made, checksum="0")
    for row in store.catalog(spark, other, "tables").collect():
        name = store.catalog(spark, root, "tables").where((F.col("source_id") == row.source_id) & (F.col("dataset_name") == row.dataset_name)).first().table_name
        one, many = store.table(spark, other, row.table_name), store.table(spark, root, name)
        assert [(f.name, f.dataType) for f in one.schema] == [(f.name, f.dataType) for f in many.schema]
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    people = store.table(spark, root, "a__people").orderBy("valor").collect()
    assert [tuple(r)[:5] for r in people] == [("11144477735", None, -3, None, "a"), ("52998224725", datetime.date(1990, 2, 1), 10, "x", "a")]
    assert store.table(spark, root, "a_b__t").columns == ["source_id_2", "col_1", *store.RESERVED]
    lost = bulk.lost_examples(spark, cells(spark, ROWS), stored).collect()
    assert sorted((r["label"], r["example"]) for r in lost) == [("Nascimento", "31/02/1990")]


def test_first_rows_queries_and_rebuild(spark, root):
    bulk.persist_many(spark, root, sources(spark, "a", "a b", "a-b"), cells(spark, ROWS))
    names = store.catalog(spark, root, "tables").select("table_name")
    found = {(r["table_name"], r["rank"]): r["row"] for r in bulk.many_first_rows(spark, root, names, 1).collect()}
    assert found["a_b__t", 1] == '{"source_id_2":"false","col_1":"7"}' and len(found) == 4
    joined = query(spark, root, "SELECT p.valor, t.col_1 FROM a__people p JOIN a_b__t t ON p.valor > 0 WHERE t.source_id_2 = ? ", [True])
    assert [tuple(r) for r in joined.collect()] == [(10, "0012")]
    before = {r["table_name"]: r["location"] for r in store.catalog(spark, root, "tables").collect()}
    provenance = spark.createDataFrame([("a", "People", 3, "Lista", None)], "source_id string, dataset string, source_page long, source_section string, source_sheet string")
    bulk.persist_many(spark, root, sources(spark, "a"), cells(spark, ROWS[:2]), provenance, rebuild=True)
    after = {r["table_name"]: r["location"] for r in store.catalog(spark, root, "tables").collect()}
    assert sorted(after) == ["a__people", "a_b__t", "a_b__t_2"] and after["a_b__t"] == before["a_b__t"] and after["a__people"] != before["a__people"]
    assert store.table(spark, root, "a__people").select(*store.RESERVED).distinct().collect() == [("a", 3, "Lista", None)]
    store.vacuum(spark, root, min_age_hours=0)
    assert store.table(spark, root, "a_b__t").count() == 2
    # Single sources live beside them.
    store.persist_source(spark, root, "one", "raw/1", "1.md", [Dataset("T", spark.createDataFrame([("x",)], "v string"))], checksum="1")
    assert store.table(spark, root, "one__t").count() == 1


def test_nothing_is_stored_on_errors(spark, root):
    bulk.persist_many(spark, root, sources(spark, "a"), cells(spark, ROWS[:1]))
    big = [("n", "T", 0, [("v", "9" * 30)])]
    twice = [("n", "T", 0, [("v", "1"), ("v", "2")])]
    for wrong, kept, rebuild, why in [
        (sources(spark, "a"), ROWS[:1], False, "cataloged already"), (sources(spark, "b"), ROWS[:1], True, "not in the catalog"), (sources(spark, "n", "n"), big, False, "twice"),
        (sources(spark, ""), big, False, "without an id"), (sources(spark, "n"), big, False, "64 bits"), (sources(spark, "n"), twice, False, "two columns"), (sources(spark, "m"), twice[:0] + ROWS[:1], False, "not listed"),
    ]:
        with pytest.raises(ValueError, match=why):
            bulk.persist_many(spark, root, wrong, cells(spark, kept), rebuild=rebuild)
    assert [r["table_name"] for r in store.catalog(spark, root, "tables").collect()] == ["a__people"]
    bulk.persist_many(spark, root, sources(spark, "empty"), cells(spark, ROWS).limit(0))
    assert store.catalog(spark, root, "sources").count() == 2


def test_jobs_do_not_grow_with_datasets(spark, root):
    """As many Spark jobs for 300 datasets as for three."""
    tracker, made = spark.sparkContext.statusTracker(), []
    for n in (3, 300):
        df = spark.range(4 * n).select(F.col("id").alias("_row"), (F.col("id") % n).cast("string").alias("source_id"), F.col("id").cast("string").alias("v"), F.lit("01/02/2024").alias("data"))
        long = melt(df, ["v", "data"], F.col("source_id")).withColumnRenamed("dataset", "source_id").withColumn("dataset", F.lit("rows"))
        ids = spark.range(n).select(F.col("id").cast("string").alias("source_id"), F.lit("r").alias("source_resource"), F.lit("p").alias("summary_page"), F.lit("0").alias("content_checksum"))
        spark.sparkContext.setJobGroup(f"bulk{n}", "")
        bulk.persist_many(spark, scratch(spark, "bulk"), ids, long.withColumn("pos", F.when(F.col("column") == "v", 0).otherwise(1)))
        made.append(len(tracker.getJobIdsForGroup(f"bulk{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert made[1] <= made[0] + 3
