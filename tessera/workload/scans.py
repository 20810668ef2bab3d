"""Readers over files that Spark writes from whole driver tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.cells import ROW
from tessera.plans import onboard
from tessera.session import dealt, filesystem, scratch
from tessera.sources import delimited, files
from tessera.sources.files import write_files
from tessera.sources.manifest import manifest_cells, read_manifests
from tessera.sources.pages import read_pages
from tessera.workload.inputs import for_oracle, run
from tessera.workload.registry import query


def export(spark, df: DataFrame, sep: str = ",", extension: str = "csv") -> str:
    """Write a table as delimited files with headers and return the folder."""
    path = scratch(spark, "raw") + "/files"
    df.write.option("extension", extension).csv(
        path, header=True, sep=sep, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return path


NOTED = """
SELECT cast(o_orderkey AS varchar(20)) AS "Pedido",
  'disse "' || o_orderpriority || '", sim' || chr(10) || chr(10) || o_orderstatus AS "Nota do cliente",
  CASE WHEN o_orderkey % 3 = 0 THEN '5" x ' || o_orderstatus ELSE {{dd/MM/yyyy}} END AS "Data"
FROM orders
"""


@query("scan_csv", for_oracle(NOTED))
def scan_csv(spark, sf_dir):
    source = NOTED.replace('"Pedido"', "Pedido").replace('"Nota do cliente"', "`Nota do cliente`").replace('"Data"', "Data")
    df, _ = delimited.read_delimited(spark, export(spark, run(spark, sf_dir, source)))
    return df.drop(ROW)


PLAIN = """
SELECT cast(o_orderkey AS varchar(20)) AS k, {{dd/MM/yyyy}} AS data, o_orderpriority || ', ' || o_orderstatus AS p FROM orders
"""


@query("scan_tsv", for_oracle(PLAIN))
def scan_tsv(spark, sf_dir):
    path = export(spark, run(spark, sf_dir, PLAIN), sep="\t", extension="tsv")
    return delimited.read_delimited(spark, path)[0].drop(ROW)


DECIMAL_COMMA = """
SELECT cast(o_orderkey AS varchar(20)) AS k, replace(cast(cast(o_totalprice AS decimal(18, 2)) AS varchar(30)), '.', ',') AS valor,
  CASE WHEN o_orderkey % 2 = 0 THEN 'a, b' ELSE o_orderstatus END AS nota FROM orders
"""


@query("scan_delimiter_retry", for_oracle(DECIMAL_COMMA))
def scan_retry(spark, sf_dir):
    path = export(spark, run(spark, sf_dir, DECIMAL_COMMA), sep=";")
    return delimited.read_delimited(spark, path)[0].drop(ROW)


@query(
    "scan_ragged_check",
    """SELECT o_orderstatus AS part, CASE WHEN o_orderstatus = 'P' THEN 'malformed' ELSE 'complete' END AS status,
    count(*) AS n_records FROM orders GROUP BY ALL""",
)
def scan_ragged(spark, sf_dir):
    source = """SELECT o_orderstatus AS part, cast(o_orderkey AS varchar(20)) || ',"' || o_orderpriority || ', x"' ||
      CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN ',extra' ELSE '' END AS line FROM orders"""
    path = scratch(spark, "raw") + "/lines"
    run(spark, sf_dir, source).write.partitionBy("part").text(path)
    found = delimited.scan(spark, path, sep=",").status
    part = F.regexp_extract("file", "part=([^/]+)/", 1)
    return found.groupBy(part.alias("part")).agg(
        F.max("status").alias("status"), F.sum(F.col("n_rows") + 1).alias("n_records")
    )


def export_files(spark, files: DataFrame) -> str:
    """Write the texts of ``files`` (name, extension, body), one file each, and return the folder.

    Lines go out as they are, through a writer without quotes, in their order.
    """
    path = scratch(spark, "raw") + "/mixed"
    lines = files.where(F.col("extension").isin(*EXTENSIONS)).select("name", "extension", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    own = dealt(lines, "name").sortWithinPartitions("name", "extension", "n").drop("n")
    if filesystem(spark, path).getUri().getScheme() == "file":
        write_files(own, path)
        return path
    for extension in EXTENSIONS:
        own.where(F.col("extension") == extension).drop("extension").write.mode("append").partitionBy("name").option("extension", extension).csv(
            path, sep="\u0001", quote="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
    return path


EXTENSIONS = ("csv", "tsv", "txt", "xlsx")
S = "cast(s_suppkey AS varchar(20))"
#: A file for each supplier: two that can be read, one each with a doubled label, a ragged row, no rows, and two nothing reads.
MIXED = f"""
SELECT s_suppkey AS k, 'f' || {S} AS name, CASE s_suppkey % 7 WHEN 1 THEN 'tsv' WHEN 5 THEN 'txt' WHEN 6 THEN 'xlsx' ELSE 'csv' END AS extension,
  CASE s_suppkey % 7 WHEN 0 THEN 'nome,chave' || chr(10) || s_name || ',' || {S} || chr(10) || '"a, b",0' || {S}
    WHEN 1 THEN 'nome' || chr(9) || 'chave' || chr(10) || s_name || chr(9) || {S}
    WHEN 2 THEN 'nome,chave,nome,chave' || chr(10) || s_name || ',1,2,3'
    WHEN 3 THEN 'nome,chave' || chr(10) || s_name || chr(10) || 'x,y,z'
    WHEN 4 THEN 'nome,chave' || chr(10) || ',' ELSE 'Supplier ' || s_name END AS body FROM supplier
"""


def file_name():
    return F.regexp_extract("file", "name=([^/]+)/", 1).alias("name")


@query(
    "scan_duplicate_header_check",
    f"""SELECT name, label, 2 AS n, pos AS first_pos, pos + 2 AS last_pos FROM ({MIXED}) m, (VALUES ('nome', 1), ('chave', 2)) t(label, pos) WHERE k % 7 = 2""",
)
def scan_duplicates(spark, sf_dir):
    """Labels that real files use twice, and no others."""
    found = delimited.scan(spark, export_files(spark, run(spark, sf_dir, MIXED)), names=files.DELIMITED)
    return delimited.duplicate_headers(delimited.header_labels(found.status)).select(file_name(), "label", "n", "first_pos", "last_pos")


SPARSE = """
SELECT CASE WHEN o_orderkey % 5 > 1 THEN cast(o_orderkey AS varchar(20)) END AS k,
  CASE WHEN o_orderkey % 5 > 2 THEN o_orderpriority WHEN o_orderkey % 5 = 1 THEN '' END AS p,
  CASE WHEN o_orderkey % 5 = 4 THEN ' ' WHEN o_orderkey % 5 = 3 THEN o_orderstatus END AS s
FROM orders
"""
SPARSE_READ = """
SELECT cast(o_orderkey AS varchar) AS k, CASE WHEN o_orderkey % 5 > 2 THEN o_orderpriority END AS p,
  CASE WHEN o_orderkey % 5 = 4 THEN ' ' WHEN o_orderkey % 5 = 3 THEN o_orderstatus END AS s
FROM orders WHERE o_orderkey % 5 > 1
"""


@query("scan_drop_blank_rows", f"SELECT count(*) AS n_rows, count(k) AS n_k, count(p) AS n_p, count(s) AS n_s FROM ({SPARSE_READ}) t")
def scan_blank_rows(spark, sf_dir):
    df, _ = delimited.read_delimited(spark, export(spark, run(spark, sf_dir, SPARSE)))
    return df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in ("k", "p", "s")])


@query("scan_empty_to_null", SPARSE_READ)
def scan_empty(spark, sf_dir):
    return delimited.read_delimited(spark, export(spark, run(spark, sf_dir, SPARSE)))[0].drop(ROW)


PATHS = """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/kb/raw/' || source || '/d' || cast(doc_id AS varchar(20)) || '.csv'
  WHEN 1 THEN '/kb/raw/../raw/./d' || cast(doc_id AS varchar(20)) || '.TSV'
  WHEN 2 THEN '/kb/raw/' || lang || '/../../secret/d' || cast(doc_id AS varchar(20)) || '.xlsx'
  WHEN 3 THEN '/kb/rawness/d' || cast(doc_id AS varchar(20)) || '.pdf'
  WHEN 4 THEN '/kb//raw/' || lang || '.v1/d' || cast(doc_id AS varchar(20))
  ELSE '/kb/raw/.csv' END AS path FROM documents
"""


@query(
    "scan_dispatch",
    f"""SELECT name, CASE extension WHEN 'txt' THEN 'unsupported' WHEN 'xlsx' THEN 'worksheet' ELSE 'delimited' END AS reader,
    strlen(body) + 1 AS length FROM ({MIXED}) m""",
)
def dispatch(spark, sf_dir):
    """Every file of a folder to its reader."""
    found = files.listing(spark, export_files(spark, run(spark, sf_dir, MIXED))).where("length > 0 AND path LIKE '%name=%'")
    return found.withColumnRenamed("path", "file").select(file_name(), files.reader_for(F.col("file")).alias("reader"), "length")


@query(
    "scan_mixed_folder",
    f"""SELECT name, CASE k % 7 WHEN 2 THEN 'duplicate header' WHEN 3 THEN 'malformed' WHEN 4 THEN 'non-tabular' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'unread' ELSE 'complete' END AS status,
    CASE k % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS n_rows, CASE WHEN k % 7 = 2 THEN 'nome at columns 1 and 3' END AS detail FROM ({MIXED}) m""",
)
def mixed(spark, sf_dir):
    """One status for every file of a folder, whatever became of it."""
    return onboard.route(spark, export_files(spark, run(spark, sf_dir, MIXED))).status.select(file_name(), "status", "n_rows", "detail")


@query("scan_raw_containment", f"SELECT doc_id, doc_id % 6 IN (0, 1, 4, 5) AS accepted FROM ({PATHS}) p")
def containment(spark, sf_dir):
    return run(spark, sf_dir, PATHS).select("doc_id", files.is_contained(F.col("path"), "/kb/raw").alias("accepted"))


MANIFEST = """
SELECT '{"source_id":"o-' || cast(o_orderkey AS varchar(20)) || '","datasets":[{"name":"pedido","columns":["Cliente","Valor","Nota","Total"],' ||
  '"rows":[{"Cliente":' || cast(o_custkey AS varchar(20)) || ',"Valor":' || cast(cast(o_totalprice AS decimal(18, 2)) AS varchar(30)) ||
  ',"Nota":"' || o_orderpriority || '","Total":99},{"Cliente":"c' || cast(o_custkey AS varchar(20)) || '","Valor":true,"Nota":null}],' ||
  '"source_page":' || cast(o_orderkey % 50 AS varchar(9)) || ',"formulas":[{"column":"Total","formula":"=SUM(A2:B2)"}]}]}' AS line
FROM orders
"""


@query(
    "scan_manifest_json",
    """WITH r AS (SELECT 'o-' || cast(o_orderkey AS varchar) AS source_id, o_orderkey % 50 AS source_page, o_custkey AS c,
      regexp_replace(cast(cast(o_totalprice AS decimal(18, 2)) AS varchar), '0$', '') AS v, o_orderpriority AS p FROM orders)
    SELECT source_id, source_page, 0 AS row, 'Cliente' AS "column", cast(c AS varchar) AS text, 'int' AS tag FROM r
    UNION ALL SELECT source_id, source_page, 0, 'Valor', v, 'float' FROM r
    UNION ALL SELECT source_id, source_page, 0, 'Nota', p, 'str' FROM r
    UNION ALL SELECT source_id, source_page, 1, 'Cliente', 'c' || cast(c AS varchar), 'str' FROM r
    UNION ALL SELECT source_id, source_page, 1, 'Valor', 'true', 'bool' FROM r
    UNION ALL SELECT source_id, source_page, 1, 'Nota', NULL, 'null' FROM r""",
)
def manifests(spark, sf_dir):
    path = scratch(spark, "raw") + "/manifests"
    run(spark, sf_dir, MANIFEST).write.text(path)
    cells = manifest_cells(read_manifests(spark, path, per_line=True))
    return cells.select("source_id", "source_page", F.col(ROW).alias("row"), "column", "text", "tag")


SUPPLIER_PAGE = """
SELECT 'Supplier_' || cast(s_suppkey AS varchar(20)) AS name,
  '---' || chr(10) || 'type: Source Summary' || chr(10) || '---' || chr(10) || 'Balance of ' || s_name AS body FROM supplier
"""


def export_pages(spark, pages: DataFrame) -> str:
    """Write ``pages`` (name, body), one file for each name, and return the folder."""
    path = scratch(spark, "wiki") + "/wiki"
    dealt(pages, "name").write.partitionBy("name").text(path)
    return path


@query("scan_page_corpus", f"SELECT name, body || chr(10) AS body FROM ({SUPPLIER_PAGE}) p")
def page_corpus(spark, sf_dir):
    """One file per page, as a corpus folder holds them."""
    path = export_pages(spark, run(spark, sf_dir, SUPPLIER_PAGE))
    pages = read_pages(spark, path, "*.txt")
    return pages.select(F.regexp_extract("path", r"\Aname=([^/]+)/", 1).alias("name"), "body")


@query("scan_checksum", f"SELECT name, cast(strlen(body) + 1 AS bigint) AS length, sha256(body || chr(10)) AS checksum FROM ({SUPPLIER_PAGE}) p")
def checksum(spark, sf_dir):
    """Lengths and checksums of real files, one for each supplier."""
    path = export_pages(spark, run(spark, sf_dir, SUPPLIER_PAGE))
    sums = files.checksums(spark, path).filter(F.col("path").endswith(".txt"))
    return sums.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "length", "checksum")
