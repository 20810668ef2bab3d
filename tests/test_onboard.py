import json

import pytest

from tessera.plans import onboard, store
from tessera.session import scratch


def test_mixed_folder(spark, raw, tmp_path):
    files = {
        "good.csv": "a,b\n1,x\n2,y\n", "também + 1.tsv": "k\tv\n1\t2\n", "twice.csv": "a,b,a\n1,2,3\n", "ragged.csv": "a,b\n1\n1,2,3\n",
        "head.csv": "a,b\n", "open.csv": 'a,b\n1,"x\n', "note.txt": "text", "book.xlsx": "PK", "empty.xlsx": "PK", "double.xlsx": "PK", "unseen.xlsx": "PK",
    }
    for name, text in files.items():
        raw(name, text)
    book, empty, double = (f"file:{raw.folder}/{n}.xlsx" for n in ("book", "empty", "double"))
    cells = [(book, s, r, c, v, t, False) for s in ("S1", "S2") for r, c, v, t in ((1, 1, "n", "str"), (2, 1, "7", "int"), (1, 2, "m", "str"), (2, 2, s, "str"))]
    cells += [(empty, "S", 1, 1, "", "str", False), (double, "S", 1, 1, "n", "str", False), (double, "S", 1, 2, "n", "str", False), (double, "S", 2, 1, "1", "int", False)]
    sheets = spark.createDataFrame(cells, "file string, sheet string, row long, col int, value string, value_type string, is_formula boolean")
    told = {r.file.rsplit("/", 1)[1]: r for r in onboard.route(spark, raw.folder, worksheets=sheets).status.collect()}
    assert {n: (r.status, r.n_rows) for n, r in told.items()} == {
        "good.csv": ("complete", 2), "também + 1.tsv": ("complete", 1), "twice.csv": ("duplicate header", 1), "ragged.csv": ("malformed", 2),
        "head.csv": ("non-tabular", 0), "open.csv": ("unclosed quote", 0), "note.txt": ("unsupported", 0), "book.xlsx": ("complete", 2),
        "empty.xlsx": ("non-tabular", 0), "double.xlsx": ("duplicate header", 1), "unseen.xlsx": ("unread", 0),
    }
    assert told["twice.csv"].detail == "a at columns 1 and 3" and told["double.xlsx"].detail == "n in S at columns 1 and 2"
    root = scratch(spark, "onboard")
    decisions = spark.createDataFrame([(f"file:{raw.folder}/good.csv", True), (book, True), (f"file:{raw.folder}/também + 1.tsv", False)], "file string, approved boolean")
    done = {r.source_id: (r.status, r.n_tables) for r in onboard.onboard(spark, root, raw.folder, raw.folder, sheets, decisions).collect()}
    assert done["good.csv"] == ("complete", 1) and done["book.xlsx"] == ("complete", 2) and done["também + 1.tsv"] == ("rejected", 0) and done["note.txt"] == ("unsupported", 0)
    held = {r.table_name: r.source_id for r in store.catalog(spark, root, "tables").collect()}
    assert held == {"good_csv__good": "good.csv", "book_xlsx__s1": "book.xlsx", "book_xlsx__s2": "book.xlsx"}
    assert sorted(map(tuple, store.table(spark, root, "good_csv__good").select("a", "b").collect())) == [(1, "x"), (2, "y")]
    assert [tuple(r) for r in store.table(spark, root, "book_xlsx__s2").collect()] == [(7, "S2", "book.xlsx", None, None, "S2")]
    outside = onboard.route(spark, raw.folder, str(tmp_path / "elsewhere")).status
    assert {r.status for r in outside.collect()} == {"outside"}


def test_manifests(spark, raw):
    def manifest(source, *names):
        rows = [{"A": 1, "B": "x"}, {"A": 2.5, "B": None}]
        return json.dumps({"source_id": source, "datasets": [{"name": n, "columns": ["A", "B"], "rows": rows, "source_page": 4} for n in names]})

    raw("one.json", manifest("one", "T", "U"))
    raw("two.json", manifest("two", "T"))
    root = scratch(spark, "onboard")
    onboard.onboard_manifests(spark, root, raw.folder)
    assert sorted(r.table_name for r in store.catalog(spark, root, "tables").collect()) == ["one__t", "one__u", "two__t"]
    assert sorted(map(tuple, store.table(spark, root, "one__u").select("a", "b", "source_id", "source_page").collect())) == [(1.0, "x", "one", 4), (2.5, None, "one", 4)]
    raw("three.json", manifest("three", "T", "T"))
    with pytest.raises(ValueError, match="two datasets"):
        onboard.onboard_manifests(spark, root, raw.folder)
