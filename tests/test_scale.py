"""Work that has to stay spread, small in memory or few in files, whatever the tables look like."""
import re
from pathlib import Path

from pyspark.sql import functions as F

from tessera.functions import temporal
from tessera.operators import formulas, worksheet
from tessera.plans import bulk, onboard, store
from tessera.session import counted
from tessera.sources import delimited, files
from tessera.workload import proposals, scans, wiki


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def recorded(monkeypatch, module) -> list:
    """The frames that ``module`` checkpoints from now on."""
    seen, keep = [], module.checkpointed

    def checkpointed(spark, df):
        seen.append(plan_of(df))
        return keep(spark, df)

    monkeypatch.setattr(module, "checkpointed", checkpointed)
    return seen


def test_pages_of_tables_in_one_split_are_dealt_out(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(wiki, "run", lambda *_: spark.range(50).select(F.concat(F.lit("wiki/entities/P"), "id").alias("path"), F.lit("x").alias("body")).coalesce(1))
    monkeypatch.setattr(wiki, "_once", lambda spark, sf_dir, what, make: made.append(make()) or made[-1])
    assert wiki.pages(spark, str(tmp_path)).count() == 50
    assert "REPARTITION_BY_COL" in plan_of(made[0])


def sheet(spark):
    rows = [("s", 2, 1, "Price", "str", False), ("s", 2, 2, "Total", "str", False), ("s", 3, 1, "4", "int", False), ("s", 3, 2, "=A3*2", "str", True),
            ("s", 4, 1, "5", "float", False), ("s", 4, 3, "x", "str", False), ("t", 1, 1, "only", "str", False)]
    return spark.createDataFrame(rows, "sheet string, row bigint, col int, value string, value_type string, is_formula boolean")


def test_cells_of_a_layout_are_not_sorted(spark, monkeypatch):
    seen = recorded(monkeypatch, worksheet)
    found = {tuple(r) for r in worksheet.layout(sheet(spark)).collect()}
    assert found == {("s", 2, 1, "Price", False, True), ("s", 2, 2, "Total", True, False), ("s", 2, 3, "", False, False), ("t", 1, 1, "only", False, None)}
    assert not [line for plan in seen for line in plan.splitlines() if "SortAggregate" in line and "is_formula" in line]


def test_inputs_of_formulas_are_not_sorted(spark):
    found = formulas.formula_inputs(sheet(spark))
    assert [tuple(r) for r in found.collect()] == [("s", 2, "=A3*2", "Price", 1)]
    assert "SortAggregate" not in plan_of(formulas.formula_inputs(sheet(spark)))


def test_files_are_written_by_more_than_one_task(spark):
    rows = [(f"n{n}", "csv", "a,b\n1,2") for n in range(40)]
    path = scans.export_files(spark, spark.createDataFrame(rows, "name string, extension string, body string").coalesce(1))
    found = [p.name[:10] for p in Path(path).rglob("part-*.csv")]
    assert len(found) == 40 and len(set(found)) > 4


def test_tasks_do_not_grow_with_small_files(spark, tmp_path):
    for n in range(2000):
        (tmp_path / f"f{n}.txt").write_text("x")
    assert files.listing(spark, str(tmp_path)).rdd.getNumPartitions() <= 9
    listed = spark.range(4000).select(F.concat(F.lit("/none/f"), "id").alias("path"), F.lit(1).cast("bigint").alias("length"))
    assert int(re.search(r"hashpartitioning\(path#\d+, node#\d+L?, (\d+)\)", plan_of(files.file_checksums(listed))).group(1)) <= 32


def test_splits_of_lines_stay_small(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n" + ("x" * 98 + ",\n") * 240_000)
    blocks = sorted(r.block for r in delimited.read_lines(spark, str(tmp_path)).select("block").distinct().collect())
    assert len(blocks) > 8 and max(b - a for a, b in zip(blocks, blocks[1:])) <= 2 << 20


def test_many_tables_take_few_files(spark, tmp_path):
    cells = spark.range(300).select(
        F.concat(F.lit("s"), "id").alias("source_id"), F.lit("d").alias("dataset"), F.lit(0).alias("pos"), F.lit("v").alias("column"),
        F.col("id").cast("string").alias("text"), F.lit("int").alias("tag"), F.col("id").alias("_row"),
    )
    sources = cells.select("source_id", F.lit("r").alias("source_resource"), F.lit("p").alias("summary_page"), F.lit("c").alias("content_checksum"))
    bulk.persist_many(spark, str(tmp_path), sources, cells)
    assert len(list((tmp_path / "data").rglob("*.parquet"))) < 50
    assert [tuple(r) for r in store.table(spark, str(tmp_path), "s7__d").select("v", "source_id").collect()] == [(7, "s7")]
    assert store.table(spark, str(tmp_path), "s8__d").count() == 1


def test_cells_of_a_row_move_together(spark, tmp_path, monkeypatch):
    """Whether or not the columns fit a broadcast, and also if cells of a row lie apart, are missing or have no row."""
    def cells(order):
        return spark.sql(f"""SELECT 'a' AS source_id, 'd' AS dataset, p AS pos, 'c' || p AS column, CASE WHEN p = 1 THEN 'x' || r ELSE r || '' END AS text,
            CASE p WHEN 1 THEN 'str' ELSE 'int' END AS tag, CASE WHEN r < 7 THEN struct(0L AS block, r AS id) END AS _row
            FROM (SELECT id AS r, explode(array(0, 1, 2)) AS p FROM range(0, 8, 1, 1)) WHERE r <> p ORDER BY {order}""")

    seen, keep = [], bulk._values
    monkeypatch.setattr(bulk, "_values", lambda df: seen.append(plan_of(df)) or keep(df))
    sources = spark.sql("SELECT 'a' AS source_id, 'r' AS source_resource, 'p' AS summary_page, 'c' AS content_checksum")
    for n, (order, small) in enumerate([("r, p", bulk.small), ("p, r", lambda df: df)]):
        monkeypatch.setattr(bulk, "small", small)
        bulk.persist_many(spark, f"{tmp_path}/{n}", sources, cells(order))
        found = {tuple(r)[:3] for r in store.table(spark, f"{tmp_path}/{n}", "a__d").collect()}
        assert found == {(None if r == 0 else r, None if r == 1 else f"x{r}", None if r == 2 else r) for r in range(8)}
    for plan in seen:
        assert "Generate" in plan[: plan.index("Exchange")] and "Generate" not in plan[plan.index("Exchange"):]
    assert bulk._packed(spark, cells("r, p").coalesce(1)).where("_row IS NOT NULL").count() == 7


def test_tables_in_folders_of_their_own_are_still_read(spark, tmp_path):
    spark.sql("SELECT 'a__d' AS table, 0L AS _row, 5L AS l0 UNION ALL SELECT '12', 0L, 6L").write.partitionBy("table").parquet(f"{tmp_path}/data/many/c=1")
    schema = '[{"name": "v", "type": "BIGINT", "slot": "l0"}]'
    assert [tuple(r) for r in store.stored_rows(spark, str(tmp_path), "data/many/c=1/table=12", schema).collect()] == [(6,)]


def test_numbers_do_not_reach_the_date_expression(spark):
    texts = ["123", "12.5", "20240131", "-1.0", "31/01/2024", " 5 de maio de 2024", "2024-1-5", "1.2.24.", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", temporal._pieces(F.col("t")).isNotNull().alias("tried"), temporal.parse_timestamp(F.col("t")).isNotNull().alias("dated"))
    assert {r.t for r in df.collect() if r.tried} == {r.t for r in df.collect() if r.dated} == set(texts[4:8])


def test_a_sample_is_cut_where_rows_are_read(spark, tmp_path, monkeypatch):
    cut = []
    monkeypatch.setattr(store, "first_rows", lambda df, keep=store.first_rows: cut.append(plan_of(df)) or keep(df))
    found = store.persist_source(spark, str(tmp_path), "s", "r", "p", [store.Dataset("d", spark.range(20, numPartitions=1))], checksum="1")
    assert [r["id"] for r in found[0].sample] == [0, 1, 2, 3, 4]
    assert cut and not [plan for plan in cut if "Exchange" in plan]


def test_what_a_small_file_becomes_is_not_broadcast_unmeasured(spark, tmp_path, monkeypatch):
    """Rows of text and cells taken from a table of little bytes, all of whose documents become tables."""
    spark.sql("SELECT id AS p_partkey, 'n' || id AS p_name, 'Brand#' || id % 3 AS p_brand, 'T' AS p_type, 1.5D AS p_retailprice FROM range(0, 30, 1, 1)").write.parquet(f"{tmp_path}/part.parquet")
    seen = recorded(monkeypatch, proposals)
    monkeypatch.setattr(bulk, "persist_many", lambda spark, root, sources, cells, *rest, keep=bulk.persist_many: seen.extend(map(plan_of, (sources, cells, *rest))) or keep(spark, root, sources, cells, *rest))
    found = proposals.gate(spark, str(tmp_path))
    assert not [plan for plan in [*seen, plan_of(found)] if "BroadcastExchange" in plan]
    assert "REPARTITION_BY_NUM" in seen[0]  # texts of one split are taken apart by all cores
    rows = sorted(tuple(r) for r in found.collect())
    assert len(rows) == 30 and rows[3] == (3, "approved", 3, "document_3__lista_de_brand_0", "lines 4-9", "n3 | 3\nT | 03\nBrand#0 | 1.50") and rows[4][1:] == ("rejected", None, None, None, None)


def test_a_side_is_broadcast_by_the_bytes_it_has(spark):
    own = counted(spark)
    joined = own.range(1000).join(own.range(10), "id")
    assert "Broadcast" not in plan_of(joined)
    assert joined.count() == 10
    ran = joined.groupBy("id").count()
    ran.collect()
    assert "BroadcastHashJoin" in plan_of(ran)
    assert counted(own).conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == spark.conf.get("spark.sql.autoBroadcastJoinThreshold")


def test_small_files_are_listed_and_opened_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("k,v\n1,\"x, y\"\n")
    (tmp_path / "b.csv").write_text("k;v\n1,5;2\n3;\"4\n5\"\n")
    (tmp_path / "c.tsv").write_text("k\tv\n1\t2\n")
    (tmp_path / "d.csv").write_text("k,v\n1\n2,3,4\n")
    (tmp_path / "e.csv").write_text("k,v\n1,\"open\n2,3\n")
    (tmp_path / "f.csv").write_text("k,v\n1,\"2\n3\"\n")
    read, listed = recorded(monkeypatch, delimited), []
    monkeypatch.setattr(delimited, "listing", lambda *given, keep=delimited.listing: listed.append(given) or keep(*given))
    routed = onboard.route(spark, str(tmp_path))
    assert {(r.file[-5:], r.status, r.n_rows) for r in routed.status.collect()} == {
        ("a.csv", "complete", 1), ("b.csv", "complete", 2), ("c.tsv", "complete", 1), ("d.csv", "malformed", 2), ("e.csv", "unclosed quote", 0), ("f.csv", "complete", 1)
    }
    assert {(r.file[-5:], r.pos, r.column, r.text) for r in routed.cells.collect()} == {
        ("a.csv", 0, "k", "1"), ("a.csv", 1, "v", "x, y"), ("b.csv", 0, "k", "1,5"), ("b.csv", 1, "v", "2"), ("b.csv", 0, "k", "3"), ("b.csv", 1, "v", "4\n5"),
        ("c.tsv", 0, "k", "1"), ("c.tsv", 1, "v", "2"), ("f.csv", 0, "k", "1"), ("f.csv", 1, "v", "2\n3"),
    }
    monkeypatch.setattr(onboard, "listing", lambda *_: listed.append(_))
    again = onboard.route(spark, str(tmp_path), listed=files.listing(spark, str(tmp_path)).select("path", "length")).status
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, routed.status.collect()), key=str)
    read = read[: len(read) // 2]  # those of the first time
    assert not listed and len([plan for plan in read if "FileScan text" in plan]) == 1 and "FileScan text" not in plan_of(routed.cells)


def test_lines_of_a_large_file_are_not_kept_and_tried_in_one_reading(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("k;v\n" + "1,5;x\n1;2\n" * 5000)
    read = recorded(monkeypatch, delimited)
    cells, status = delimited.read_cells(spark, str(tmp_path), files=files.listing(spark, str(tmp_path)).withColumnRenamed("path", "file"))
    assert [(r.sep, r.status, r.n_rows) for r in status.collect()] == [(";", "complete", 10_000)] and cells.count() == 20_000
    assert len([plan for plan in read if "FileScan text" in plan]) == 2


def test_files_are_written_as_they_are_and_without_a_process_each(spark):
    rows = [("a", "csv", "x,y\n\n1, 2 "), ("a", "tsv", ""), ("a", "csv", "x,y\n\n1, 2 "), ("b c=1%", "csv", "é\"\\\r"), (None, "txt", "n"), ("z", "csv", None), ("z", "pdf", "no"), ("z", None, "no")]
    path = scans.export_files(spark, spark.createDataFrame(rows, "name string, extension string, body string"))
    found = {(p.parent.name, p.suffix): p.read_bytes().decode() for p in Path(re.sub("^file:", "", path)).rglob("part-*")}
    assert found == {("name=a", ".csv"): "x,y\nx,y\n\n\n1, 2 \n1, 2 \n", ("name=a", ".tsv"): "\n", ("name=b c%3D1%25", ".csv"): "é\"\\\r\n", ("name=__HIVE_DEFAULT_PARTITION__", ".txt"): "n\n"}
    assert not list(Path(re.sub("^file:", "", path)).rglob(".*"))  # Spark's writer makes two files for one, with a process for the mode of each
    assert {r.path.rsplit("/", 2)[1] for r in files.listing(spark, path).collect()} == {"name=a", "name=b c%3D1%25", "name=__HIVE_DEFAULT_PARTITION__"}
    assert Path(re.sub("^file:", "", scans.export_files(spark, spark.createDataFrame(rows[-1:], "name string, extension string, body string")))).is_dir()
