import csv
import hashlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import delimited, files
from tessera.sources.manifest import manifest_cells, mismatched, read_manifests
from tessera.sources.pages import read_pages


def wide(df):
    return [tuple(r) for r in df.orderBy("_row").drop("_row").collect()]


def test_csv_keeps_codes_and_empty_cells(spark, raw):
    df, status = delimited.read_delimited(spark, raw("scores.csv", "﻿Name,Code,Value\nAna,0012,\n,,\n=1+1, x ,\"\"\n"))
    assert df.columns == ["Name", "Code", "Value", "_row"]
    assert wide(df) == [("Ana", "0012", None), ("=1+1", " x ", None)]
    assert status.first().status == "complete"


def test_tsv_default_separator(spark, raw):
    df, _ = delimited.read_delimited(spark, raw("scores.tsv", "Name\tCode\nAna\t0,012\n"))
    assert wide(df) == [("Ana", "0,012")]


def test_retry_only_when_ragged(spark, raw):
    raw("a.csv", "a;b\n1,5;2\n3;4\n")
    raw("b.csv", "only;one\n1;2\n")
    raw("c.csv", "a,b\n1\n1,2,3\n")
    raw("d.csv", "\n,,\n")
    raw("e.csv", "")
    raw("f.csv", "x,x\n1,2\n")
    cells, status = delimited.read_cells(spark, raw.folder)
    name = F.substring_index("file", "/", -1)
    got = {r.n: (r.status, r.sep, r.n_rows) for r in status.select(name.alias("n"), "status", "sep", "n_rows").collect()}
    assert got == {
        "a.csv": ("complete", ";", 2), "b.csv": ("complete", ",", 1), "c.csv": ("malformed", None, 2),
        "d.csv": ("empty", None, 0), "f.csv": ("duplicate header", ",", 1), "e.csv": ("empty", None, 0),
    } or "e.csv" not in got
    texts = {r.text for r in cells.collect()}
    assert texts == {"1,5", "2", "3", "4", "1;2"}


def test_duplicate_header_is_an_error(spark, raw):
    with pytest.raises(ValueError, match="columns 1 and 3"):
        delimited.read_delimited(spark, raw("x.csv", "a,b,a\n1,2,3\n"))


@pytest.mark.parametrize("split", ["134217728", "200"])
def test_quoted_fields_agree_with_the_csv_module(spark, raw, split):
    rnd = random.Random(5)
    rows = [["h1", "h2", "h3"]]
    for i in range(1500):
        rows.append(
            ["".join(rnd.choice('ab",\n "') for _ in range(rnd.randrange(0, 9))) if rnd.random() < 0.5 else str(i) for _ in range(3)]
        )
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    path = raw("r.csv", text.getvalue())
    wanted = [tuple(c or None for c in r) for r in csv.reader(io.StringIO(text.getvalue())) if any(r)][1:]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        blocks = delimited.read_lines(spark, path).select("block").distinct().count()
        assert (blocks > 20) == (split == "200")
        df, _ = delimited.read_delimited(spark, path)
        assert wide(df) == wanted
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_a_row_that_repeats_the_header_is_data(spark, raw):
    df, _ = delimited.read_delimited(spark, raw("x.csv", "a,b\n1,2\na,b\n"))
    assert wide(df) == [("1", "2"), ("a", "b")]


def test_checksums_and_listing(spark, raw):
    raw("a.bin", "content")
    raw("b.bin", "x" * 5000)
    got = sorted(r.checksum for r in files.checksums(spark, raw.folder).collect())
    assert got == sorted(hashlib.sha256(t.encode()).hexdigest() for t in ("content", "x" * 5000))


def test_containment_and_dispatch(spark):
    cases = {
        "/kb/raw/a.csv": True, "/kb/raw/../b.csv": False, "/kb/raw/x/../c.TSV": True, "/kb/rawness/d.xlsx": False,
        "file:/kb/raw/e": False, "/kb//raw/./f.xlsx": True, "/kb/raw": False,
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.ok for r in df.select("p", files.is_contained(F.col("p"), "/kb/raw").alias("ok")).collect()} == cases
    readers = {r.p: r.r for r in df.select("p", files.reader_for(F.col("p")).alias("r")).collect()}
    assert readers["/kb/raw/x/../c.TSV"] == "delimited" and readers["/kb//raw/./f.xlsx"] == "worksheet"
    assert readers["file:/kb/raw/e"] == "unsupported"


def test_manifest(spark, raw):
    payload = {
        "source_id": "s",
        "datasets": [
            {
                "name": "T", "columns": ["A", "B", "C"], "source_page": 3,
                "rows": [{"A": 1, "B": "x", "C": 9}, {"A": 2.0, "B": None}],
                "formulas": [{"column": "C", "formula": "=A2+1", "inputs": ["A"], "sql": None}],
            }
        ],
    }
    raw("m.json", json.dumps(payload, indent=1))
    found = read_manifests(spark, raw.folder)
    assert mismatched(found, "s").isEmpty() and mismatched(found, "other").count() == 1
    cells = manifest_cells(found).orderBy("_row", "pos").collect()
    assert [(r["_row"], r.column, r.text, r.tag) for r in cells] == [
        (0, "A", "1", "int"), (0, "B", "x", "str"), (1, "A", "2.0", "float"), (1, "B", None, "null"),
    ]


def test_read_pages(spark, tmp_path):
    (tmp_path / "wiki" / "entities").mkdir(parents=True)
    (tmp_path / "wiki" / "entities" / "A.md").write_text("---\ntype: Entity\n---\nx", encoding="utf-8")
    (tmp_path / "wiki" / "note.txt").write_text("no", encoding="utf-8")
    rows = read_pages(spark, str(tmp_path)).collect()
    assert [(r.path, r.body) for r in rows] == [("wiki/entities/A.md", "---\ntype: Entity\n---\nx")]


def test_paths_with_spaces_and_accents(spark, tmp_path):
    folder = tmp_path / "Área 1 + 50%" / "Minhas Notas"
    folder.mkdir(parents=True)
    (folder / "a b.csv").write_text('x,y\n1,"p\nq"\n', encoding="utf-8")
    (folder / "Minha Nota.md").write_text("oi", encoding="utf-8")
    df, status = delimited.read_delimited(spark, str(folder / "a b.csv"))
    assert wide(df) == [("1", "p\nq")] and status.first().status == "complete"
    assert [r.path for r in read_pages(spark, str(tmp_path)).collect()] == ["Área 1 + 50%/Minhas Notas/Minha Nota.md"]


def test_another_separator_is_a_full_re_read(spark, raw):
    raw("a.csv", '1;"two\nlines";3,50\n2;"x;y";4,1\n')
    raw("b.csv", ';;\nh1;h2;h3\n1;"p\n\nq";2,5\n;;\n3;4;5\n')
    cells, status = delimited.read_cells(spark, raw.folder)
    assert {(r.status, r.sep, r.width) for r in status.collect()} == {("complete", ";", 3)}
    got = {}
    for r in cells.collect():
        got.setdefault((r.dataset[-5:], r["_row"]), {})[r.column] = r.text
    assert sorted(tuple(x.values()) for (d, _), x in got.items() if d == "a.csv") == [("2", "x;y", "4,1")]
    assert sorted(tuple(x.values()) for (d, _), x in got.items() if d == "b.csv") == [("1", "p\n\nq", "2,5"), ("3", "4", "5")]


def test_a_quote_that_never_closes_is_a_status(spark, raw):
    path = raw("a.csv", 'a,b\n1,2\n3,"x\n' + "4,5\n" * 500)
    assert delimited.scan(spark, path).status.first().status == "unclosed quote"
    with pytest.raises(ValueError, match="unclosed quote"):
        delimited.read_delimited(spark, path)


def test_a_changed_split_layout_moves_no_header(spark, raw):
    for n in range(6):
        raw(f"{n}.csv", "a,b\n" + "".join(f"{i},x{n}\n" for i in range(2000)))
    keys = {"spark.sql.files.minPartitionNum": "23", "spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "10"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        df, _ = delimited.read_delimited(spark, raw.folder)
        cells, _ = delimited.read_cells(spark, raw.folder)
        for key, value in keys.items():
            spark.conf.set(key, value)
        assert df.count() == 12_000 and df.filter("a = 'a'").isEmpty()
        assert cells.count() == 24_000
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_whole_numbers_beyond_64_bits_stay_whole(spark, raw):
    rows = [{"n": 99999999999999999999}, {"n": -9223372036854775809}, {"n": 9223372036854775807}, {"n": 5.0}]
    raw("m.json", json.dumps({"source_id": "s", "datasets": [{"name": "N", "columns": ["n"], "rows": rows}]}))
    got = [(r.text, r.tag) for r in manifest_cells(read_manifests(spark, raw.folder)).orderBy("_row").collect()]
    assert got == [("99999999999999999999", "int"), ("-9223372036854775809", "int"), ("9223372036854775807", "int"), ("5.0", "float")]
