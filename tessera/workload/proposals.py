"""Tables found in text, their proposals, and the approval gate."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import candidates
from tessera.operators.cells import melt
from tessera.plans import bulk, onboard, store
from tessera.session import checkpointed, counted, scratch, spread
from tessera.sources import files
from tessera.workload.inputs import run
from tessera.workload.registry import query
from tessera.workload.scans import MIXED, export_files

NL = "chr(10)"
P = "cast(p_partkey AS varchar(20))"
PRICE = "cast(cast(p_retailprice AS decimal(18, 2)) AS varchar(30))"

# A listing of three records per part.
LISTINGS = f"""
SELECT -1 - p_partkey AS doc_id, 'Catalogo ' || {P} || {NL} || 'nome;codigo;valor' || {NL} || p_name || ';' || {P} || ';' || {PRICE} || {NL}
  || p_brand || ';0' || {P} || ';' || {PRICE} || {NL} || p_type || ';' || {P} || ';n/a' || {NL} || 'Fim' AS text FROM part
"""

# Every document as it is, and every listing.
DOCS = f"SELECT doc_id, text FROM documents UNION ALL {LISTINGS}"

_WIDTHS = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM docs),
widths AS (SELECT *, length(line) - length(replace(line, sep, '')) + 1 AS w FROM lines CROSS JOIN (VALUES (','), (';'), (chr(9)), ('|')) s(sep)),
steps AS (SELECT *, CASE WHEN w = lag(w) OVER (PARTITION BY doc_id, sep ORDER BY n) THEN 0 ELSE 1 END AS step FROM widths),
islands AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, sep ORDER BY n) AS island FROM steps),
runs AS (SELECT doc_id, sep, w, island, min(n) AS first_line, max(n) AS last_line, arg_min(line, n) AS header FROM islands GROUP BY ALL HAVING w >= 2 AND count(*) >= 2)
"""


def docs(spark, sf_dir):
    return run(spark, sf_dir, DOCS)


@query(
    "candidate_text_records",
    f"WITH docs AS ({DOCS}), {_WIDTHS} SELECT doc_id AS doc, sep, w AS width, first_line, last_line FROM runs",
)
def records(spark, sf_dir):
    return candidates.text_records(docs(spark, sf_dir)).drop("lines", "title")


@query(
    "candidate_rows",
    f"""WITH docs AS ({DOCS}), {_WIDTHS} SELECT DISTINCT i.doc_id AS doc, i.sep, r.header, i.n AS line_no, i.line
    FROM islands i JOIN runs r USING (doc_id, sep, w, island) WHERE i.line <> r.header""",
)
def candidate_rows(spark, sf_dir):
    found = candidates.text_records(docs(spark, sf_dir))
    rows = found.select("doc", "sep", F.get("lines", F.lit(0)).alias("header"), "first_line", F.posexplode("lines").alias("o", "line"))
    return rows.filter("line <> header").select("doc", "sep", "header", (F.col("first_line") + F.col("o")).alias("line_no"), "line")


# A table interrupted by a page break that repeats its header.
BROKEN = f"""
SELECT p_partkey AS doc_id, 'Lista de ' || p_brand || {NL} || '| nome | codigo |' || {NL} || '|---|:--:|' || {NL}
  || '| ' || p_name || ' | ' || {P} || ' |' || {NL} || '| ' || p_type || ' | 0' || {P} || ' |' || {NL}
  || {NL} || 'pagina 2' || {NL} || '| nome | codigo |' || {NL} || '| ' || p_brand || ' | ' || {PRICE} || ' |' || {NL}
  || CASE WHEN p_partkey % 4 = 0 THEN '| sobra |' ELSE '' END AS text FROM part
"""


@query(
    "candidate_pipe_tables",
    """SELECT p_partkey AS doc, 2 AS width, 1 AS first_line, 4 AS last_line, 3 AS n_lines FROM part
    UNION ALL SELECT p_partkey, 2, 7, 8, 2 FROM part""",
)
def pipes(spark, sf_dir):
    found = candidates.pipe_tables(run(spark, sf_dir, BROKEN))
    return found.select("doc", "width", "first_line", "last_line", F.size(F.array_compact("lines")).alias("n_lines"))


@query(
    "candidate_merge_headers",
    f"""SELECT p_partkey AS doc, '| nome | codigo |' AS header, p_name || '/' || p_partkey AS fields FROM part
    UNION ALL SELECT p_partkey, '| nome | codigo |', p_type || '/0' || p_partkey FROM part
    UNION ALL SELECT p_partkey, '| nome | codigo |', p_brand || '/' || {PRICE} FROM part""",
)
def merged(spark, sf_dir):
    rows = candidates.merged(candidates.pipe_tables(run(spark, sf_dir, BROKEN)))
    return rows.select("doc", "header", F.array_join("fields", "/").alias("fields"))


HTML = f"""
SELECT p_partkey AS page_id, '<html><table class="x"><tr><th>nome</th><th>valor</th></tr>' || {NL} || '<TR><td> <b>' || p_name || '</b></td><td>' || {PRICE}
  || '</td></TR></table><p>' || p_type || '</p><table><tr><td>' || p_brand || '</td></tr></table></html>' AS html FROM part
UNION ALL SELECT -1 - page_id, html FROM pages
"""


@query(
    "candidate_html_tables",
    f"""SELECT p_partkey AS doc, 0 AS table_no, 0 AS row_no, 'nome/valor' AS fields FROM part
    UNION ALL SELECT p_partkey, 0, 1, p_name || '/' || {PRICE} FROM part
    UNION ALL SELECT p_partkey, 1, 0, p_brand FROM part""",
)
def html(spark, sf_dir):
    rows = candidates.html_tables(run(spark, sf_dir, HTML))
    return rows.select("doc", "table_no", "row_no", F.array_join("fields", "/").alias("fields"))


@query(
    "candidate_proposal",
    f"""SELECT -1 - p_partkey AS doc, 'Catalogo ' || p_partkey AS name, 2 AS first_line, 4 AS last_line, 'nome|codigo|valor' AS labels,
    'VARCHAR|VARCHAR|VARCHAR' AS types, 3 AS estimated_rows, p_name || ' | ' || p_partkey || ' | ' || {PRICE} || chr(10) || p_brand || ' | 0' || p_partkey
      || ' | ' || {PRICE} || chr(10) || p_type || ' | ' || p_partkey || ' | n/a' AS first_rows FROM part""",
)
def proposal(spark, sf_dir):
    found = candidates.proposals(candidates.merged(candidates.text_records(run(spark, sf_dir, LISTINGS))))
    joined = {"labels": "|", "types": "|", "first_rows": "\n"}
    return found.select("doc", "name", "first_line", "last_line", "estimated_rows", *(F.array_join(c, sep).alias(c) for c, sep in joined.items()))


@query(
    "candidate_preview",
    f"""SELECT p_partkey AS doc, 1 AS rank, p_name || ' | ' || p_partkey AS row FROM part
    UNION ALL SELECT p_partkey, 2, p_type || ' | 0' || p_partkey FROM part
    UNION ALL SELECT p_partkey, 3, p_brand || ' | ' || {PRICE} FROM part""",
)
def preview(spark, sf_dir):
    rows = candidates.merged(candidates.pipe_tables(run(spark, sf_dir, BROKEN)))
    doc = F.split_part("candidate", F.lit("/"), F.lit(1)).cast("bigint")
    return candidates.preview(rows).select(doc.alias("doc"), "rank", "row")


@query(
    "approval_gate",
    f"""SELECT p_partkey AS doc, CASE p_partkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, t.*
    FROM part LEFT JOIN LATERAL (SELECT 3 AS stored_rows, 'document_' || p_partkey || '__lista_de_' || lower(replace(p_brand, '#', '_')) AS table_name,
      'lines 4-9' AS section, p_name || ' | ' || p_partkey || chr(10) || p_type || ' | 0' || p_partkey || chr(10) || p_brand || ' | ' || {PRICE} AS first_rows
      WHERE p_partkey % 3 = 0) t ON true""",
)
def gate(spark, sf_dir):
    """Proposals, decisions, and what the store holds of the approved: counts, provenance and first rows are read from there."""
    spark = counted(spark)
    rows = checkpointed(spark, candidates.merged(candidates.pipe_tables(spread(run(spark, sf_dir, BROKEN)))))
    proposed = checkpointed(spark, candidates.candidate_names(rows))
    approvals = proposed.filter("doc % 3 < 2").select("candidate", (F.col("doc") % 3 == 0).alias("approved"))
    sources, cells, provenance = candidates.approved_tables(proposed, rows, approvals)
    sources = sources.withColumns({"summary_page": F.concat(F.lit("wiki/sources/"), "source_id"), "content_checksum": F.sha2("source_resource", 256)})
    root = scratch(spark, "store")
    bulk.persist_many(spark, root, sources, cells, provenance)
    held = store.catalog(spark, root, "tables")
    first = bulk.many_first_rows(spark, root, held)
    fields = F.array_join(F.map_values(F.from_json("row", "map<string,string>")), " | ")
    shown = first.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", fields.alias("t")))), lambda x: x["t"]), "\n").alias("first_rows"))
    listed = F.from_json("schema_json", "array<struct<name:string,value:string>>")
    section = F.filter(listed, lambda c: c["name"] == "source_section")[0]["value"]
    doc = F.regexp_extract("source_id", "[-0-9]+", 0).cast("bigint").alias("doc")
    stored = held.join(shown, "table_name").select(doc, F.col("row_count").alias("stored_rows"), "table_name", section.alias("section"), "first_rows")
    status = candidates.gate_status(proposed, approvals).join(proposed.select("candidate", "doc"), "candidate")
    return status.join(stored, "doc", "left").select("doc", "status", "stored_rows", "table_name", "section", "first_rows")


@query(
    "sink_persist_many",
    """SELECT 'supplier_' || l_suppkey || '__entregas' AS table_name, count(*) AS n_rows, cast(sum(l_orderkey) AS bigint) AS orders, sum(l_quantity) AS quantity,
    min(cast(l_shipdate AS date)) AS first_day, max(CASE WHEN l_linenumber % 2 = 0 THEN lpad(cast(l_partkey AS varchar), 8, '0') END) AS last_code
    FROM lineitem GROUP BY l_suppkey""",
)
def many(spark, sf_dir):
    """A dataset for each supplier, all of them typed, stored and cataloged together, and asked through the catalog."""
    source = """SELECT cast(l_suppkey AS varchar(20)) AS s, monotonically_increasing_id() AS _row, l_orderkey AS pedido, cast(l_quantity AS varchar(20)) AS qtd,
      date_format(l_shipdate, 'dd/MM/yyyy') AS data, CASE WHEN l_linenumber % 2 = 0 THEN lpad(cast(l_partkey AS varchar(20)), 8, '0') END AS cep FROM lineitem"""
    rows = run(spark, sf_dir, source)
    labels = ["pedido", "qtd", "data", "cep"]
    cells = melt(rows, labels, F.concat(F.lit("Supplier "), "s")).withColumnRenamed("dataset", "source_id")
    cells = cells.withColumns({"dataset": F.lit("Entregas"), "pos": F.array_position(F.array(*map(F.lit, labels)), F.col("column")).cast("int") - 1})
    sources = run(spark, sf_dir, "SELECT DISTINCT 'Supplier ' || cast(l_suppkey AS varchar(20)) AS source_id FROM lineitem")
    sources = sources.withColumns({"source_resource": F.lit("raw/lines.csv"), "summary_page": F.lit("wiki/sources/lines.md"), "content_checksum": F.sha2("source_id", 256)})
    root = scratch(spark, "store")
    bulk.persist_many(spark, root, sources, cells)
    # All tables have one shape, so the folder they lie in is one table as well.
    held = store.catalog(spark, root, "tables")
    first = held.first()
    whole = bulk.together(spark, root, first.location, first.schema_json)
    return whole.groupBy("table_name").agg(
        F.count("*").alias("n_rows"), F.sum("pedido").alias("orders"), F.sum("qtd").alias("quantity"), F.min("data").alias("first_day"), F.max("cep").alias("last_code")
    ).join(held.select("table_name"), "table_name")


@query(
    "extraction_status",
    f"""SELECT status, count(*) AS n_sources, cast(sum(CASE WHEN status = 'complete' THEN 1 ELSE 0 END) AS bigint) AS n_tables FROM (
      SELECT CASE k % 7 WHEN 2 THEN 'duplicate header' WHEN 3 THEN 'malformed' WHEN 4 THEN 'non-tabular' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'unread'
      ELSE CASE k % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'rejected' ELSE 'pending' END END AS status FROM ({MIXED}) m) s GROUP BY status""",
)
def statuses(spark, sf_dir):
    """A folder of mixed files, read, decided on and stored: what became of each source."""
    path = export_files(spark, run(spark, sf_dir, MIXED))
    listed = checkpointed(spark, files.listing(spark, path).select("path", "length"))
    keyed = listed.select(F.col("path").alias("file"), F.regexp_extract("path", "name=f([0-9]+)/", 1).try_cast("bigint").alias("k"))
    decisions = keyed.where("k % 3 < 2").select("file", (F.col("k") % 3 == 0).alias("approved"))
    root = scratch(spark, "store")
    told = onboard.onboard(spark, root, path, decisions=decisions, listed=listed).where("file LIKE '%name=%'")
    held = store.catalog(spark, root, "sources").select("source_id", F.lit(1).alias("held"))
    counted = told.join(held, "source_id", "left")
    return counted.groupBy("status").agg(F.count("*").alias("n_sources"), F.sum(F.when(F.col("held") == 1, F.col("n_tables")).otherwise(F.lit(0))).alias("n_tables"))
