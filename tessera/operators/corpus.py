"""Pages, their frontmatter, and the checks that need one page at a time."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.temporal import parse_timestamp
from tessera.functions.text import strip

# Keys with a meaning, names that are not pages, type per section.
KEYS = ("type", "title", "description", "resource", "tags", "sources", "generated", "verified")
RESERVED_PAGES = ("index", "log", "AGENTS")
SECTION_TYPES = {
    "sources": "Source Summary",
    "entities": "Entity",
    "concepts": "Concept",
    "synthesis": "Synthesis",
}
MAX_INDEX_LINE = 120

_FRONT = r"(?s)\A---[ \t]*\n(.*?)\n?---[ \t]*(?:\n|\z)"
_TOP = r"(?m)^([A-Za-z_][A-Za-z0-9_-]*):"


def _present(value: Column) -> Column:
    """Quotes and trailing comments off, empty to NULL."""
    text = strip(value)
    quoted = r"""\A(['"])(.*?)\1\s*(?:#.*)?\z"""
    plain = F.when(text.rlike(quoted), F.regexp_extract(text, quoted, 2)).otherwise(
        strip(F.regexp_replace(text, r"(?:\A|\s+)#.*\z", ""))
    )
    return F.nullif(plain, F.lit(""))


def _scalar(block: Column, key: str) -> Column:
    return _present(F.regexp_extract(block, rf"(?m)^[ \t]*{key}:[ \t]*(.*)$", 1))


def _top_scalar(front: Column, key: str) -> Column:
    return _present(F.regexp_extract(front, rf"(?m)^{key}:[ \t]*(.*)$", 1))


def _section_of(front: Column, key: str) -> Column:
    """Everything that belongs to a top-level key, without the key itself."""
    return F.regexp_extract(front, rf"(?m)^{key}:((?:.*)(?:\n(?:[ \t-].*+)?+)*+)", 1)


def _lines(entry: Column) -> Column:
    """A flow mapping ``{ a: 1, b: 2 }`` as one field per line."""
    inner = F.regexp_extract(entry, r"(?s)\A\s*[{](.*)[}]\s*\z", 1)
    return F.when(F.trim(entry).startswith("{"), F.regexp_replace(inner, r",\s*", "\n")).otherwise(entry)


def _entries(block: Column) -> Column:
    """List items of a block; a bare mapping counts as a list of one."""
    items = F.transform(F.split(block, r"(?m)^[ \t]*-[ \t]+"), lambda item: _lines(item))
    return F.filter(items, lambda item: item.rlike(r"(?m)^\s*[a-z_]+:"))


def _tags(block: Column) -> Column:
    flat = F.regexp_replace(block, r"[\[\]]", "")
    parts = F.transform(F.split(flat, r"\n[ \t]*-[ \t]+|,"), lambda tag: _present(tag))
    return F.filter(parts, lambda tag: tag.isNotNull())


def page_frontmatter(pages: DataFrame) -> DataFrame:
    """``pages(path, body)`` with the fixed keys as columns.

    Adds ``section, name, front, content`` and one column per known key;
    ``sources`` and ``verified`` are arrays of structs.
    """
    path, body = F.col("path"), F.col("body")
    split = pages.select(
        "path",
        F.regexp_extract(path, r"(?:\A|/)wiki/([^/]+)/", 1).alias("section"),
        F.regexp_replace(F.substring_index(path, "/", -1), r"[.]md\z", "").alias("name"),
        F.regexp_extract(body, _FRONT, 1).alias("front"),
        F.regexp_replace(body, _FRONT, "").alias("content"),
    )
    front = F.col("front")
    generated = _lines(_section_of(front, "generated"))

    def source(entry: Column) -> Column:
        return F.struct(
            _scalar(entry, "id").alias("id"),
            _scalar(entry, "resource").alias("resource"),
            _scalar(entry, "title").alias("title"),
            _scalar(entry, "author").alias("author"),
            _scalar(entry, "usage_count").try_cast("bigint").alias("usage_count"),
            _scalar(entry, "last_modified").alias("last_modified"),
        )

    def confirmation(entry: Column) -> Column:
        return F.struct(_scalar(entry, "by").alias("by"), _scalar(entry, "at").alias("at"))

    return split.select(
        "*",
        *[_top_scalar(front, key).alias(key) for key in ("type", "title", "description", "resource")],
        _tags(_section_of(front, "tags")).alias("tags"),
        F.transform(_entries(_section_of(front, "sources")), source).alias("sources"),
        F.struct(_scalar(generated, "by").alias("by"), _scalar(generated, "at").alias("at")).alias("generated"),
        F.transform(_entries(_section_of(front, "verified")), confirmation).alias("verified"),
    )


def concept_pages(parsed: DataFrame) -> DataFrame:
    """Pages proper, without indexes, logs and rules."""
    return parsed.filter(~F.col("name").isin(*RESERVED_PAGES))


def unknown_keys(parsed: DataFrame) -> DataFrame:
    """``[path, key, value]`` of extra frontmatter keys; they are kept as text."""
    names = F.array_except(F.regexp_extract_all("front", F.lit(_TOP), F.lit(1)), F.lit(list(KEYS)))
    listed = parsed.select("path", "front", F.explode(names).alias("key"))
    value = F.expr(r"regexp_extract(front, concat('(?m)^', key, ':[ \t]*(.*)$'), 1)")
    return listed.select("path", "key", F.trim(value).alias("value"))


def _finding(df: DataFrame, rule: str, severity: str, detail: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "path", detail.cast("string").alias("detail")
    )


def required_keys(parsed: DataFrame) -> DataFrame:
    needed = (("type", "error"), ("title", "warning"), ("description", "warning"))
    problems = F.array(
        *[
            F.when(F.col(key).isNull(), F.struct(F.lit(level).alias("severity"), F.lit(key).alias("detail")))
            for key, level in needed
        ]
    )
    found = concept_pages(parsed).select("path", F.explode(problems).alias("p")).filter("p is not null")
    return found.select(F.lit("missing key").alias("rule"), "p.severity", "path", "p.detail")


def type_matches_section(parsed: DataFrame) -> DataFrame:
    expected = F.create_map(*[F.lit(v) for pair in SECTION_TYPES.items() for v in pair])
    wanted = F.try_element_at(expected, F.col("section"))
    # Sections outside the four accept every type, and so do unknown types inside
    # them when the page says what it is: only a known type in the wrong place counts.
    misplaced = F.col("type").isin(*SECTION_TYPES.values()) & (F.col("type") != wanted)
    return _finding(concept_pages(parsed).filter(misplaced), "type outside its section", "error", F.col("type"))


def reserved_names(parsed: DataFrame) -> DataFrame:
    """Index and log files that pose as pages."""
    posing = F.col("name").isin("index", "log") & F.col("type").isNotNull()
    return _finding(parsed.filter(posing), "reserved name", "error", F.col("name"))


def timestamp_offsets(parsed: DataFrame) -> DataFrame:
    """Timestamps without an explicit offset."""
    stamps = F.concat(
        F.array(F.col("generated.at")), F.col("verified.at"), F.col("sources.last_modified")
    )
    listed = concept_pages(parsed).select("path", F.explode(stamps).alias("stamp"))
    bare = ~F.col("stamp").rlike(r"T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]+)?)?(?:Z|[+-][0-9]{2}:[0-9]{2})\z")
    return _finding(listed.filter(bare), "timestamp without offset", "error", F.col("stamp"))


def source_resource_required(parsed: DataFrame) -> DataFrame:
    listed = concept_pages(parsed).select("path", F.explode("sources").alias("s"))
    return _finding(listed.filter("s.resource is null"), "source without resource", "error", F.col("s.id"))


def page_search(parsed: DataFrame, pattern: str, top: int = 20) -> DataFrame:
    """Pages ranked by how often a pattern occurs in them."""
    hits = F.regexp_count("content", F.lit(pattern)) + F.regexp_count(
        F.coalesce("title", F.lit("")), F.lit(pattern)
    )
    found = concept_pages(parsed).select("path", hits.alias("hits")).filter("hits > 0")
    return found.orderBy(F.desc("hits"), "path").limit(top)


def actor_class(actor: Column) -> Column:
    return (
        F.when(actor.startswith("human:"), "human")
        .when(actor.startswith("process:"), "process")
        .when(actor.rlike(r"\A[^/\s:]+/\S+\z"), "agent")
        .when(actor.isNotNull(), "other")
    )


def trust_tier(parsed: DataFrame) -> DataFrame:
    by = F.filter(F.col("verified.by"), lambda actor: actor.isNotNull())
    tier = (
        F.when(F.exists(by, lambda actor: actor.startswith("human:")), "human-reviewed")
        .when(F.size(by) > 0, "machine-confirmed")
        .otherwise("unverified")
    )
    return concept_pages(parsed).select("path", "section", tier.alias("tier"))


def credibility_signals(parsed: DataFrame) -> DataFrame:
    """Objective signals per page; what they are worth is the reader's judgement."""
    listed = concept_pages(parsed).select("path", F.explode_outer("sources").alias("s"))
    return listed.groupBy("path").agg(
        F.count("s.resource").alias("n_sources"),
        F.count_distinct("s.author").alias("n_authors"),
        F.sum("s.usage_count").alias("usage_count"),
        F.max(parse_timestamp(F.col("s.last_modified"))).alias("newest"),
    )


def section_counts(parsed: DataFrame) -> DataFrame:
    return concept_pages(parsed).groupBy("section", "type").agg(F.count("*").alias("n_pages"))


def index_lines(pages: DataFrame) -> DataFrame:
    """``[dir, path, pos, line, title, target, description]`` of ``index.md`` files."""
    entry = r"\A\s*[*-]\s+\[([^\]]*)\][(]([^)]*)[)](?:\s*-\s*(.*))?\z"
    folder = F.regexp_replace("path", r"[^/]*\z", "")
    lines = pages.filter(F.col("path").rlike(r"(?:\A|/)index[.]md\z")).select(
        folder.alias("dir"), "path", F.posexplode(F.split("body", "\n")).alias("pos", "line")
    )
    found = lines.filter(F.col("line").rlike(entry))
    parts = [F.regexp_extract("line", entry, n).alias(name) for n, name in ((1, "title"), (2, "target"), (3, "description"))]
    return found.select("*", *parts)


def index_line_length(entries: DataFrame) -> DataFrame:
    long = entries.filter(F.length("line") > MAX_INDEX_LINE)
    return _finding(long, "index entry too long", "warning", F.length("line"))


def index_guided_lookup(entries: DataFrame, pages: DataFrame, term: str) -> DataFrame:
    """Pages reached through index entries that mention a term."""
    mention = F.instr(F.lower(F.concat_ws(" ", "title", "description")), term.lower()) > 0
    reached = entries.filter(mention).select(F.concat("dir", "target").alias("path"), F.col("title").alias("entry"))
    return reached.join(pages, "path")


def index_consistency(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """Entries without a page, pages without an entry, pages listed twice."""
    listed = entries.groupBy("dir", F.concat("dir", "target").alias("path")).agg(F.count("*").alias("n_entries"))
    pages = concept_pages(parsed).select("path", F.lit(True).alias("page"))
    both = listed.join(pages, "path", "full")
    detail = (
        F.when(F.col("page").isNull(), "entry without page")
        .when(F.col("n_entries").isNull(), "page without entry")
        .when(F.col("n_entries") > 1, "listed more than once")
    )
    found = both.withColumn("problem", detail).filter("problem is not null")
    return _finding(found, "index consistency", "warning", F.col("problem"))


def index_build(parsed: DataFrame) -> DataFrame:
    """``[dir, heading, title, line]``; sorted by the first three it is the file.

    Lines stay rows, so the index of a folder of any size is written by a range
    partitioning instead of being collected into one value.
    """
    folder = F.regexp_replace("path", r"[^/]*\z", "")
    shown = F.coalesce("title", "name")
    link = F.concat(F.lit("* ["), shown, F.lit("]("), F.substring_index("path", "/", -1), F.lit(")"))
    line = F.concat_ws(" - ", link, "description")
    return concept_pages(parsed).select(
        folder.alias("dir"), F.coalesce("type", F.lit("")).alias("heading"), shown.alias("title"), line.alias("line")
    )


def log_build(entries: DataFrame) -> DataFrame:
    """``entries(dir, date, pos, text)`` -> ``[dir, date, pos, line]``, headings included.

    Ordered by ``dir``, ``date`` descending and ``pos`` (headings have -1) the
    lines are the log file, newest date first.
    """
    heading = entries.select("dir", "date").distinct().select(
        "dir", "date", F.lit(-1).cast("bigint").alias("pos"),
        F.concat(F.lit("## "), F.date_format("date", "yyyy-MM-dd")).alias("line"),
    )
    lines = entries.select("dir", "date", F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("* "), "text").alias("line"))
    return heading.unionByName(lines)


def log_order(pages: DataFrame) -> DataFrame:
    """Date headings of ``log.md`` files that are newer than the one above them.

    A log is one text, so its headings are compared inside the row.
    """
    dates = F.regexp_extract_all("body", F.lit(r"(?m)^## ([0-9]{4}-[0-9]{2}-[0-9]{2})"), F.lit(1))
    logs = pages.filter(F.col("path").rlike(r"(?:\A|/)log[.]md\z")).select("path", dates.alias("dates"))
    pairs = F.arrays_zip(
        F.slice("dates", F.lit(2), F.greatest(F.size("dates") - 1, F.lit(0))).alias("below"),
        F.slice("dates", F.lit(1), F.greatest(F.size("dates") - 1, F.lit(0))).alias("above"),
    )
    listed = logs.select("path", F.posexplode(pairs).alias("pos", "pair")).filter("pair.below > pair.above")
    return _finding(listed, "log not newest first", "warning", F.col("pair.below"))


def footnote_resolution(parsed: DataFrame) -> DataFrame:
    """Footnote labels without a source of that id, and sources nobody cites."""
    labels = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[\^([^\]\s]+)\](?!:)"), F.lit(1)))
    ids = F.filter(F.array_distinct(F.col("sources.id")), lambda i: i.isNotNull())
    # Both lists belong to one page: they are compared in place.
    marked = concept_pages(parsed).select(
        "path",
        F.explode(
            F.concat(
                F.transform(F.array_except(labels, ids), lambda x: F.struct(x.alias("id"), F.lit("unresolved footnote").alias("rule"))),
                F.transform(F.array_except(ids, labels), lambda x: F.struct(x.alias("id"), F.lit("unused source").alias("rule"))),
            )
        ).alias("f"),
    )
    severity = F.when(F.col("f.rule") == "unresolved footnote", "error").otherwise("info")
    return marked.select("f.rule", severity.alias("severity"), "path", F.col("f.id").alias("detail"))
