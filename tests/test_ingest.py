import hashlib
import json

import pytest

from tessera.plans import ingest, store
from tessera.session import scratch
from tessera.sources import files
from tessera.streaming.arrivals import normalize_upsert, raw_arrivals


def test_inspect_file(spark, raw):
    path = raw("frota.csv", "Placa,Vencimento,CEP\nQWE-1A23,19/03/2031,16180-339\nRTY-4B56,sem data,00000-001\n")
    (dataset,) = ingest.load_file(spark, path, raw.folder)
    seen = ingest.inspect(dataset)
    assert seen["name"] == "frota" and seen["row_count"] == 2
    assert {c["name"]: (c["type"], c["kind"]) for c in seen["columns"]} == {
        "Placa": ("VARCHAR", None), "Vencimento": ("DATE", "date"), "CEP": ("VARCHAR", "cep"),
    }
    assert [r["Vencimento"] for r in seen["sample"]] == ["2031-03-19", None]
    assert [r["CEP"] for r in seen["sample"]] == ["16180339", "00000001"]


def test_load_refuses(spark, raw):
    assert ingest.load_file(spark, raw("empty.csv", "\n,\n"), raw.folder) == []
    for name, text, reason in (("r.csv", "a,b\n1\n", "constant row width"), ("x.pdf", "x", "no reader"), ("b.xlsx", "x", "cells")):
        with pytest.raises(ValueError, match=reason):
            ingest.load_file(spark, raw(name, text), raw.folder)
    with pytest.raises(ValueError, match="below the raw folder"):
        ingest.load_file(spark, "/elsewhere/a.csv", raw.folder)


def test_header_only_file_is_an_empty_table(spark, raw):
    (dataset,) = ingest.load_file(spark, raw("h.csv", "a,b\n"), raw.folder)
    root = scratch(spark, "test-store")
    made = store.persist_source(spark, root, "h", "raw/h.csv", "h.md", [dataset], checksum="0")[0]
    assert made.row_count == 0 and made.columns[:2] == [("a", "VARCHAR"), ("b", "VARCHAR")]
    assert store.table(spark, root, "h__h").count() == 0


def test_manifest_to_table_keeps_cell_types(spark, raw):
    columns = {"Lote": [40, 41], "Peso": [3, 0.25], "Marca": [7, "sete"], "Vazio": [None, None], "Rota": ["007", "042"], "Soma": [43, None]}
    payload = {
        "source_id": "carga",
        "datasets": [
            {
                "name": "Carga do dia", "columns": list(columns), "source_page": 12,
                "rows": [{c: v[i] for c, v in columns.items()} for i in range(2)],
                "formulas": [{"column": "Soma", "formula": "=A2+B2"}],
            }
        ],
    }
    path = raw("carga.json", json.dumps(payload))
    with pytest.raises(ValueError, match="another source"):
        ingest.manifest_datasets(spark, path, "outra")
    root = scratch(spark, "test-store")
    made = store.persist_source(
        spark, root, "carga", path, "carga.md", ingest.manifest_datasets(spark, path, "carga"), raw_root=raw.folder
    )[0]
    (inspected,) = ingest.manifest_datasets(spark, path, "carga")
    assert ingest.inspect(inspected)["formulas"] == [{"column": "Soma", "formula": "=A2+B2", "inputs": None}]
    assert made.columns[:5] == [
        ("lote", "BIGINT"), ("peso", "DOUBLE"), ("marca", "VARCHAR"), ("vazio", "VARCHAR"), ("rota", "VARCHAR"),
    ]
    rows = store.table(spark, root, "carga__carga_do_dia").orderBy("lote").collect()
    assert [tuple(r)[:7] for r in rows] == [
        (40, 3.0, "7", None, "007", "carga", 12), (41, 0.25, "sete", None, "042", "carga", 12),
    ]


def test_a_manifest_beyond_64_bits_leaves_nothing(spark, raw):
    rows = [{"n": 1}, {"n": 99999999999999999999}]
    path = raw("m.json", json.dumps({"source_id": "big", "datasets": [{"name": "N", "columns": ["n"], "rows": rows}]}))
    root = scratch(spark, "test-store")
    with pytest.raises(RuntimeError, match="64 bits"):
        store.persist_source(spark, root, "big", path, "m.md", ingest.manifest_datasets(spark, path, "big"), checksum="0")
    assert store.catalog(spark, root, "sources").count() == 0


def test_sheets_to_tables(spark):
    rows = [
        ("Results", 1, 1, "A", "str", False), ("Results", 1, 2, "Total", "str", False),
        ("Results", 2, 1, "2", "int", False), ("Results", 2, 2, "=SUM(A2:A2)", "str", True),
        ("Other", 1, 1, "Code", "str", False), ("Other", 2, 1, "0012", "str", False),
        ("Empty", 1, 1, "x", "str", False),
    ]
    cells = spark.createDataFrame(rows, "sheet string, row int, col int, value string, value_type string, is_formula boolean")
    root = scratch(spark, "test-store")
    seen = {d.name: ingest.inspect(d)["formulas"] for d in ingest.sheet_datasets(cells)}
    assert seen == {"Other": [], "Results": [{
        "col": 2, "column": "Total", "formula": "=SUM(A2:A2)", "inputs": ["A"], "verdict": "derivable", "n_cells": 1, "n_derivable": 1,
    }]}
    made = store.persist_source(spark, root, "book", "raw/b.xlsx", "b.md", ingest.sheet_datasets(cells), checksum="0")
    assert {m.table_name: m.columns[0] for m in made} == {"book__other": ("code", "VARCHAR"), "book__results": ("a", "BIGINT")}
    assert store.table(spark, root, "book__results").select("a", "source_sheet").collect() == [(2, "Results")]


def test_stream_sees_each_file_once(spark, raw, tmp_path):
    raw("a.csv", "x\n")
    run = lambda: {r.path.rsplit("/", 1)[1]: (r.status, r.batch) for r in raw_arrivals(
        spark, raw.folder, str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect()}
    assert run() == {"a.csv": ("pending", 0)}
    raw("b.pdf", "y")
    assert run() == {"a.csv": ("pending", 0), "b.pdf": ("unsupported", 1)}
    assert run() == {"a.csv": ("pending", 0), "b.pdf": ("unsupported", 1)}


def test_csv_stream_goes_through_the_scanner(spark, raw, tmp_path):
    kinds = [("BIGINT", None), ("VARCHAR", None), ("BIGINT", None)]
    root = str(tmp_path / "store")
    go = lambda: normalize_upsert(spark, raw.folder, "a string, b string, c string", root, "s", kinds, str(tmp_path / "checkpoint"))
    raw("one.csv", 'a,b,c\n1,"um\ndois",3\n2,x,4\n')
    raw("ragged.csv", "a,b,c\n2,x\n3,y,4,extra\n")
    raw("other.csv", "a,b\n1,2\n")
    raw("open.csv", 'a,b,c\n1,"x,2\n')
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.n_rows) for r in go().collect()}
    assert got == {"one.csv": ("stored", 2), "ragged.csv": ("malformed", 2), "other.csv": ("other header", 1), "open.csv": ("unclosed quote", 0)}
    raw("again.csv", 'a,b,c\n1,"um\ndois",3\n2,x,4\n')
    raw("com espaço.csv", "a,b,c\n9,z,8\n")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in go().collect()}
    assert got["again.csv"] == "duplicate" and got["com espaço.csv"] == "stored" and len(got) == 6
    names = [r.table_name for r in store.catalog(spark, root, "tables").collect()]
    rows = sorted(tuple(r)[:3] for n in names for r in store.table(spark, root, n).collect())
    assert rows == [(1, "um\ndois", 3), (2, "x", 4), (9, "z", 8)]


def tree(data, size, fanout):
    level = [hashlib.sha256(data[i : i + size]).hexdigest() for i in range(0, max(len(data), 1), size)]
    while len(level) > 1:
        groups = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        level = [hashlib.sha256("".join(g).encode()).hexdigest() if len(g) > 1 else g[0] for g in groups]
    return level[0]


def test_checksums_of_ranges(spark, raw, monkeypatch):
    texts = {"a b+%25.csv": "x" * 9, "exact": "ab" * 32, "long": "".join(map(str, range(5000)))}
    for name, text in texts.items():
        raw(name, text)
    for size, fanout in ((64, 3), (1000, 2), (1 << 20, 1024)):
        want = {n: (len(t), tree(t.encode(), size, fanout)) for n, t in texts.items()}
        for opens in (files._opened, lambda scheme: None):  # by range, and as whole values
            monkeypatch.setattr(files, "_opened", opens)
            got = files.file_checksums(files.listing(spark, raw.folder), size, fanout).collect()
            assert {r.path.rsplit("/", 1)[1]: (r.length, r.checksum) for r in got} == want
            monkeypatch.undo()
    assert files.file_checksums(files.listing(spark, raw.folder).limit(0)).collect() == []


def test_a_file_above_two_gigabytes(spark, raw, tmp_path):
    """A sparse file is hashed in ranges, persists and arrives."""
    path = raw("big.bin", "x")
    with open(path, "r+b") as file:
        file.truncate((2 << 30) + 77)
    seen = raw_arrivals(spark, raw.folder, str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect()
    assert [(r.length, r.status, len(r.checksum)) for r in seen] == [((2 << 30) + 77, "unsupported", 64)]
    root = str(tmp_path / "store")
    store.persist_source(spark, root, "big", path, "big.md", [store.Dataset("t", spark.createDataFrame([("1",)], "a string"))])
    assert store.catalog(spark, root, "sources").first().content_checksum == seen[0].checksum


def test_stream_state_and_replay(spark, raw, tmp_path):
    """Contents seen in any earlier batch are duplicates, and so after a restart and a replay."""
    root, checkpoint = str(tmp_path / "store"), tmp_path / "checkpoint"
    go = lambda: {r.path.rsplit("/", 1)[1]: (r.status, r.n_rows, r.batch) for r in normalize_upsert(spark, raw.folder, "a string, b string", root, "s", [("BIGINT", None)] * 2, str(checkpoint)).collect()}
    raw("a.csv", "a,b\n1,2\n3,4\n")
    raw("b.csv", "a,b\n1,2\n3,4\n")
    raw("swapped.csv", "a,b\n3,4\n1,2\n")
    raw("x.pdf", "no reader")
    raw("y.pdf", "no reader")
    first = {"a.csv": ("stored", 2, 0), "b.csv": ("duplicate", 0, 0), "swapped.csv": ("stored", 2, 0), "x.pdf": ("unsupported", 0, 0), "y.pdf": ("unsupported", 0, 0)}
    assert go() == first
    raw("c.csv", "a,b\n1,2\n3,4\n")
    raw("d.csv", "a,b\n5,6\n")
    second = first | {"c.csv": ("duplicate", 0, 1), "d.csv": ("stored", 1, 1)}
    assert go() == second
    # The last batch of the storing stream runs again, as after a failure before its commit.
    for name in ("1", ".1.crc"):
        (checkpoint / "stored" / "commits" / name).unlink(missing_ok=True)
    assert go() == second
    names = [r.table_name for r in store.catalog(spark, root, "tables").collect()]
    rows = sorted(tuple(r)[:2] for n in names for r in store.table(spark, root, n).collect())
    assert rows == [(1, 2), (1, 2), (3, 4), (3, 4), (5, 6)]

