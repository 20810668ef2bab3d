"""The link graph and the checks that need more than one page."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.naming import RESERVED, sanitize
from tessera.functions.normalize import normalize
from tessera.functions.temporal import parse_timestamp
from tessera.operators import corpus
from tessera.operators.cells import as_text
from tessera.operators.corpus import _finding, concept_pages, unknown_keys
from tessera.session import checkpointed

WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"


def wikilink_edges(parsed: DataFrame) -> DataFrame:
    """``[path, section, target, n_links]``, one row per page and target."""
    names = F.transform(F.regexp_extract_all("content", F.lit(WIKILINK), F.lit(1)), lambda name: F.trim(name))
    listed = concept_pages(parsed).select("path", "section", F.explode(names).alias("target"))
    return listed.groupBy("path", "section", "target").agg(F.count("*").alias("n_links"))


def page_names(parsed: DataFrame) -> DataFrame:
    """``[target, to_path]``: a page answers to its file name and to its title."""
    keys = F.array_distinct(F.filter(F.array("name", "title"), lambda key: key.isNotNull()))
    return concept_pages(parsed).select(F.col("path").alias("to_path"), F.explode(keys).alias("target"))


def orphans(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages no other page links to.

    Targets are made distinct before they meet the pages, so a page everybody
    links to costs one row. Links of a page to itself are kept out by counting.
    """
    inbound = edges.groupBy("target").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    reached = page_names(parsed).join(inbound, "target").filter(
        (F.col("lo") != F.col("to_path")) | (F.col("hi") != F.col("to_path"))
    )
    alone = concept_pages(parsed).join(reached.select(F.col("to_path").alias("path")), "path", "left_anti")
    return _finding(alone, "orphan page", "warning", F.col("name"))


def missing_targets(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """``[target, n_pages]``: names that are linked but have no page."""
    wanted = edges.groupBy("target").agg(F.count("*").alias("n_pages"))
    return wanted.join(page_names(parsed), "target", "left_anti")


def broken_links(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    gone = missing_targets(parsed, edges).select("target")
    return _finding(edges.join(gone, "target", "left_semi"), "broken link", "error", F.col("target"))


def missing_pages(parsed: DataFrame, edges: DataFrame, at_least: int = 2) -> DataFrame:
    """Names several pages link to although none of them exists."""
    return missing_targets(parsed, edges).filter(F.col("n_pages") >= at_least)


#: What parts the words of prose, and a word no title has: it stands for links and the ends of paragraphs.
APART, CUT = r"[^\p{L}\p{N}_#]+", "#"


def prose_words(parsed: DataFrame, lower: bool, stops: str = "") -> DataFrame:
    """``[path, words]`` of every page; links and what ``stops`` matches become a word that cuts a run."""
    cut = F.regexp_replace("content", rf"{WIKILINK}|\n\s*\n{stops}", f" {CUT} ")
    text = F.lower(cut) if lower else cut
    return concept_pages(parsed).select("path", F.filter(F.split(text, APART), lambda w: w != "").alias("words"))


def missing_crossrefs(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that name another page in their prose without linking to it.

    Titles are a dictionary by their first word. The different words of a page look
    up how long titles that begin with them are; then runs are built, inside the
    page, only where such a word stands and only of these lengths, and meet the
    titles in an equality join.
    """
    names = page_names(parsed).select("to_path", F.filter(F.split(F.lower("target"), APART), lambda w: w != "").alias("words"))
    names = names.filter(F.size("words") > 0).select("to_path", F.array_join("words", " ").alias("run"), F.get("words", F.lit(0)).alias("word"), F.size("words").alias("n"))
    prose = prose_words(parsed, lower=True)
    # As many lengths as titles with one first word have.
    begins = names.groupBy("word").agg(F.collect_set("n").alias("sizes"))
    seen = prose.select("path", F.explode(F.array_distinct("words")).alias("word")).join(begins, "word")
    known = seen.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("word", "sizes"))).alias("begins"))
    runs = F.flatten(
        F.transform(
            "words",
            lambda w, i: F.transform(
                F.coalesce(F.try_element_at("begins", w), F.array().cast("array<int>")), lambda n: F.array_join(F.slice("words", i + 1, n), " ")
            ),
        )
    )
    mentioned = prose.join(known, "path").select("path", F.explode(F.array_distinct(runs)).alias("run"))
    pairs = mentioned.join(names.select("run", "to_path").distinct(), "run").filter("path <> to_path")
    linked = edges.join(page_names(parsed), "target").select("path", "to_path")
    open_pairs = pairs.select("path", "to_path").distinct().join(linked, ["path", "to_path"], "left_anti")
    return _finding(open_pairs, "missing cross-reference", "info", F.col("to_path"))


def missing_names(parsed: DataFrame, at_least: int = 2) -> DataFrame:
    """``[name, n_pages]``: names that recur in the prose of ``at_least`` pages and have no page.

    A name is a run of words that begin with a capital or, but for the first, with a
    digit; the first word of a sentence is none, and links are no prose. Document
    frequencies are counted level by level: a run of n words is looked at only where
    both its runs of n-1 words are frequent, so what is shuffled shrinks with every
    level. A frequent run that lies in a longer one on as many pages is left out.
    """
    spark = parsed.sparkSession
    # The end of a sentence cuts, and takes the word after it along.
    words = prose_words(parsed, lower=False, stops=r"|(?:\A|[.!?:])\s*[\p{L}\p{N}_#]+|\n[-*#>\s]*[\p{L}\p{N}_#]+")
    listed = words.select("path", F.posexplode("words").alias("at", "phrase"))
    places = checkpointed(spark, listed.filter(F.col("phrase").rlike(r"\A[\p{Lu}\p{N}]")))
    found = None
    while True:
        counted = places.select("path", "phrase").distinct().groupBy("phrase").agg(F.count("*").alias("n_pages"))
        frequent = checkpointed(spark, counted.filter(F.col("n_pages") >= at_least))
        if frequent.isEmpty():
            break
        if found is not None:
            # A shorter run says nothing new if a longer one around it is on as many pages.
            parts = [F.regexp_replace("phrase", r"\s\S+\z", ""), F.regexp_replace("phrase", r"\A\S+\s", "")]
            inside = frequent.select(F.explode(F.array(*parts)).alias("phrase"), "n_pages").distinct()
            found = found.join(inside, ["phrase", "n_pages"], "left_anti")
        found = frequent if found is None else found.unionByName(frequent)
        kept = places.join(frequent.select("phrase"), "phrase", "left_semi")
        following = kept.select("path", (F.col("at") - 1).alias("at"), F.substring_index("phrase", " ", -1).alias("_last"))
        places = checkpointed(spark, kept.join(following, ["path", "at"]).select("path", "at", F.concat_ws(" ", "phrase", "_last").alias("phrase")))
    if found is None:
        return spark.createDataFrame([], "name string, n_pages bigint")
    titles = page_names(parsed).select(F.array_join(F.filter(F.split(F.lower("target"), APART), lambda w: w != ""), " ").alias("_title"))
    named = found.filter(F.col("phrase").rlike(r"\A\p{Lu}")).withColumn("_title", F.lower("phrase"))
    return named.join(titles, "_title", "left_anti").select(F.col("phrase").alias("name"), "n_pages")


def stale_claims(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages written before their newest source, or before a newer source about them.

    A source page that links to another page is about it.
    """
    pages = concept_pages(parsed).withColumn("written", parse_timestamp(F.col("generated.at")))
    own = (
        pages.select("path", F.explode("sources").alias("s"))
        .groupBy("path")
        .agg(F.max(parse_timestamp(F.col("s.last_modified"))).alias("own_newest"))
    )
    about = (
        edges.filter("section = 'sources'")
        .join(pages.select("path", "written"), "path")
        .groupBy("target")
        .agg(F.max("written").alias("newest"))
    )
    newer = page_names(parsed).join(about, "target").groupBy(F.col("to_path").alias("path")).agg(
        F.max("newest").alias("about_newest")
    )
    joined = pages.select("path", "written").join(own, "path", "left").join(newer, "path", "left")
    newest = F.greatest("own_newest", "about_newest")
    stale = joined.withColumn("newest", newest).filter("written < newest")
    return _finding(stale, "stale claim", "warning", F.date_format("newest", "yyyy-MM-dd HH:mm:ss"))


def page_facts(parsed: DataFrame, entity: str, kind: str) -> DataFrame:
    """``[entity, key, value, source]``: what front matter says of the document number it holds under ``entity``.

    Numbers are normalized by ``kind`` and keys to identifiers, so that pages and
    tables speak of the same entity and key however they are written.
    """
    extra = unknown_keys(concept_pages(parsed)).withColumn("key", sanitize(F.col("key")))
    known = extra.filter(F.col("key") == sanitize(F.lit(entity))).select("path", normalize(F.col("value"), kind).alias("entity"))
    stated = extra.filter(F.col("key") != sanitize(F.lit(entity))).join(known.filter("entity IS NOT NULL"), "path")
    return stated.select("entity", "key", F.nullif("value", F.lit("")).alias("value"), F.col("path").alias("source"))


def table_facts(df: DataFrame, entity: str, kind: str, source: str, columns: list[str] | None = None) -> DataFrame:
    """The same of a stored table: its columns unpivoted under the document number in ``entity``."""
    columns = [c for c in df.columns if c != entity and c not in RESERVED] if columns is None else columns
    cells = F.array(*(F.struct(F.lit(c).alias("key"), as_text(F.col(f"`{c}`"), df.schema[c].dataType).alias("value")) for c in columns))
    rows = df.select(normalize(F.col(f"`{entity}`").cast("string"), kind).alias("entity"), F.explode(cells).alias("c"))
    return rows.filter("entity IS NOT NULL").select("entity", "c.key", "c.value", F.lit(source).alias("source"))


def contradictions(facts: DataFrame) -> DataFrame:
    """``facts(entity, key, value)`` -> entities with several values for a key.

    Values are counted once each first, so a claim repeated by a third of all
    pages arrives as one row. With a column ``source`` the first sources of the
    first and last value are named.
    """
    sourced = "source" in facts.columns
    first = [F.min("source").alias("source")] if sourced else []
    values = facts.filter("value is not null").groupBy("entity", "key", "value").agg(F.count("*").alias("n"), *first)
    named = [F.min_by("source", "value").alias("first_source"), F.max_by("source", "value").alias("last_source")] if sourced else []
    return (
        values.groupBy("entity", "key")
        .agg(
            F.count("*").alias("n_values"),
            F.sum("n").alias("n_claims"),
            F.min("value").alias("first_value"),
            F.max("value").alias("last_value"),
            *named,
        )
        .filter("n_values > 1")
    )


def data_gaps(parsed: DataFrame) -> DataFrame:
    """Pages that no source supports."""
    bare = concept_pages(parsed).filter((F.size("sources") == 0) & (F.col("section") != "sources"))
    return _finding(bare, "no sources", "info", F.col("section"))


def null_rates(df: DataFrame) -> DataFrame:
    """``[column, n_rows, n_null, null_rate]`` in one pass over a table."""
    counted = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null")) for c in df.columns])
    return counted.select("_n", F.inline(rows)).select(
        "column",
        F.col("_n").alias("n_rows"),
        "n_null",
        F.try_divide(F.col("n_null").cast("double"), F.col("_n").cast("double")).alias("null_rate"),
    )


def lint(pages: DataFrame) -> DataFrame:
    """All findings over a corpus: ``[rule, severity, path, detail]``."""
    parsed = checkpointed(pages.sparkSession, corpus.page_frontmatter(pages))
    edges = checkpointed(pages.sparkSession, wikilink_edges(parsed))
    entries = corpus.index_lines(pages)
    missing = missing_pages(parsed, edges)
    found = [
        corpus.required_keys(parsed),
        corpus.type_matches_section(parsed),
        corpus.reserved_names(parsed),
        corpus.timestamp_offsets(parsed),
        corpus.source_resource_required(parsed),
        corpus.footnote_resolution(parsed),
        corpus.index_line_length(entries),
        corpus.index_consistency(entries, parsed),
        corpus.log_order(pages),
        orphans(parsed, edges),
        broken_links(parsed, edges),
        _finding(missing.withColumn("path", F.lit(None).cast("string")), "missing page", "info", F.col("target")),
        missing_crossrefs(parsed, edges),
        stale_claims(parsed, edges),
        data_gaps(parsed),
    ]
    return reduce(DataFrame.unionByName, found)


def lint_report(findings: DataFrame) -> DataFrame:
    """Counts per section and rule with subtotals; NULL stands for all."""
    section = F.regexp_extract(F.coalesce("path", F.lit("")), r"(?:\A|/)wiki/([^/]+)/", 1)
    return (
        findings.withColumn("section", section)
        .rollup("rule", "section")
        .agg(F.count("*").alias("n_findings"))
    )


def lineage(parsed: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``[path, ancestor, depth]``: pages a page ultimately rests on, for the pages in ``starts`` (path) or all.

    A source entry whose resource is the path of another page is an edge.
    """
    spark = parsed.sparkSession
    pages = concept_pages(parsed)
    listed = pages.select("path", F.explode("sources.resource").alias("parent")).filter("parent <> path")
    known = pages.select(F.col("path").alias("parent"))
    parents = checkpointed(spark, listed.distinct().join(known, "parent", "left_semi"))
    return closure(parents, starts)


def closure(parents: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Transitive closure of ``(path, parent)`` with the shortest depth, of the paths in ``starts`` or of all.

    The reach doubles with every round: after it all pairs up to depth ``2n`` are
    known. A shortest way of more than n steps has a point n steps from its begin,
    so pairs of exactly that depth meet all known ones, and nothing is found twice
    by different points unless ways of one length differ. Every round is
    checkpointed, so the plan does not grow and a lost executor repeats one round
    at most.
    """
    spark = parents.sparkSession
    reached = parents.filter("path <> parent").select("path", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    reached = checkpointed(spark, reached)
    own = reached if starts is None else checkpointed(spark, reached.join(starts.select("path"), "path", "left_semi"))
    n = 1

    def further(pairs: DataFrame) -> DataFrame:
        edge = pairs.filter(F.col("depth") == n).select("path", F.col("ancestor").alias("_by"))
        onward = reached.select(F.col("path").alias("_by"), "ancestor", (F.col("depth") + n).alias("depth"))
        met = edge.join(onward, "_by").filter("path <> ancestor").groupBy("path", "ancestor").agg(F.min("depth").alias("depth"))
        return checkpointed(spark, met.join(pairs, ["path", "ancestor"], "left_anti"))

    while True:
        new = further(own)
        if new.isEmpty():
            return own
        grown = new if starts is None else further(reached)
        reached = checkpointed(spark, reached.unionByName(grown))
        own = reached if starts is None else checkpointed(spark, own.unionByName(new))
        n *= 2
