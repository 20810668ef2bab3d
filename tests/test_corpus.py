from tessera.operators import candidates, corpus, links

PAGES = {
    "wiki/entities/Ana.md": """---
type: Entity
title: "Ana Lima"   # display
description: A person
tags:
  - people
  - 'lead'
owner: team-a
sources:
  - id: s1
    resource: wiki/entities/Bob.md
    author: human:x
    usage_count: 12
    last_modified: 2026-08-26T00:00:00-04:00
  - { id: s2, title: "no resource" }
generated: { by: agent/1.0, at: 2026-08-25T00:00:00Z }
verified: { by: process:nightly, at: 2026-08-26T12:00:00 }
---
Knows [[Bob|her friend]] and [[Ghost#x]]. Bob Reis appears. Claim.[^s1] [^nope]
[^s1]: text
""",
    "wiki/entities/Bob.md": """---
type: Concept
title: Bob Reis
verified:
  - by: process:a
    at: 2026-01-01T00:00:00Z
  - by: human:b
    at: 2026-01-01T00:00:00Z
sources:
  - resource: wiki/entities/Ana.md
---
Mentions Ana
Lima without a link, and [[Ghost]].
""",
    "wiki/concepts/Zed.md": "no frontmatter, [[Zed]] only",
    "wiki/entities/index.md": "# People\n* [Ana](Ana.md) - a\n* [Ana again](Ana.md)\n* [Gone](Gone.md) - " + "x" * 120 + "\n",
    "wiki/entities/log.md": "---\ntype: Entity\n---\n# Log\n## 2026-01-02\n* a\n## 2026-01-03\n* b\n## 2026-01-01\n",
}


def corpus_of(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "path string, body string")
    parsed = corpus.page_frontmatter(pages)
    return pages, parsed, links.wikilink_edges(parsed)


def found(df):
    return sorted((r.path, r.detail) for r in df.collect())


ANA, BOB, ZED = "wiki/entities/Ana.md", "wiki/entities/Bob.md", "wiki/concepts/Zed.md"


def test_frontmatter(spark):
    _, parsed, _ = corpus_of(spark)
    ana = parsed.filter(f"path = '{ANA}'").first()
    assert (ana.section, ana.name, ana.type, ana.title) == ("entities", "Ana", "Entity", "Ana Lima")
    assert ana.tags == ["people", "lead"]
    assert [tuple(s) for s in ana.sources] == [
        ("s1", BOB, None, "human:x", 12, "2026-08-26T00:00:00-04:00"), ("s2", None, "no resource", None, None, None),
    ]
    assert tuple(ana.generated) == ("agent/1.0", "2026-08-25T00:00:00Z")
    assert [tuple(v) for v in ana.verified] == [("process:nightly", "2026-08-26T12:00:00")]
    assert [(r.key, r.value) for r in corpus.unknown_keys(parsed).collect()] == [("owner", "team-a")]


def test_page_rules(spark):
    pages, parsed, _ = corpus_of(spark)
    assert (ZED, "type") in found(corpus.required_keys(parsed)) and (BOB, "description") in found(corpus.required_keys(parsed))
    assert found(corpus.type_matches_section(parsed)) == [(BOB, "Concept")]
    assert found(corpus.reserved_names(parsed)) == [("wiki/entities/log.md", "log")]
    assert found(corpus.timestamp_offsets(parsed)) == [(ANA, "2026-08-26T12:00:00")]
    assert found(corpus.source_resource_required(parsed)) == [(ANA, "s2")]
    assert found(corpus.footnote_resolution(parsed)) == [(ANA, "nope"), (ANA, "s2")]
    assert found(corpus.log_order(pages)) == [("wiki/entities/log.md", "2026-01-03")]
    tiers = {r.path: r.tier for r in corpus.trust_tier(parsed).collect()}
    assert tiers == {ANA: "machine-confirmed", BOB: "human-reviewed", ZED: "unverified"}


def test_index_rules(spark):
    pages, parsed, _ = corpus_of(spark)
    entries = corpus.index_lines(pages)
    assert found(corpus.index_line_length(entries)) == [("wiki/entities/index.md", str(len("* [Gone](Gone.md) - ") + 120))]
    assert found(corpus.index_consistency(entries, parsed)) == [
        (ZED, "page without entry"), (ANA, "listed more than once"), (BOB, "page without entry"),
        ("wiki/entities/Gone.md", "entry without page"),
    ]


def test_link_rules(spark):
    pages, parsed, edges = corpus_of(spark)
    assert found(links.orphans(parsed, edges)) == [(ZED, "Zed"), (ANA, "Ana")]
    assert found(links.broken_links(parsed, edges)) == [(ANA, "Ghost"), (BOB, "Ghost")]
    assert [(r.target, r.n_pages) for r in links.missing_pages(parsed, edges).collect()] == [("Ghost", 2)]
    assert found(links.missing_crossrefs(parsed, edges)) == [(BOB, ANA)]
    assert found(links.stale_claims(parsed, edges)) == [(ANA, "2026-08-26 04:00:00")]
    assert found(links.data_gaps(parsed)) == [(ZED, "concepts")]
    pairs = {(r.path, r.ancestor, r.depth) for r in links.lineage(parsed).collect()}
    assert pairs == {(ANA, BOB, 1), (BOB, ANA, 1)}
    report = links.lint_report(links.lint(pages)).filter("rule is null").first()
    assert report.n_findings == links.lint(pages).count()


def test_closure_depths_and_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("x", "y")]
    got = {(r.path, r.ancestor): r.depth for r in links.closure(spark.createDataFrame(edges, "path string, parent string")).collect()}
    assert got == {
        ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 1, ("b", "c"): 1, ("b", "a"): 2, ("b", "d"): 3,
        ("c", "a"): 1, ("c", "b"): 2, ("c", "d"): 2, ("d", "c"): 1, ("d", "a"): 2, ("d", "b"): 3, ("x", "y"): 1,
    }


def test_candidates(spark):
    text = "intro\na;b\n1;x\n2;y\n\nnext, one\nend, two\n| p | q |\n|---|---|\n| 1 | 0012 |\npage\n| p | q |\n| 2 | n/a |\n"
    docs = spark.createDataFrame([(1, text), (2, "only one line"), (3, "")], "doc_id long, text string")
    runs = {(r.doc, r.sep, r.first_line, r.last_line) for r in candidates.text_records(docs).collect()}
    assert runs == {(1, ";", 1, 3), (1, ",", 5, 6), (1, "|", 7, 9), (1, "|", 11, 12)}
    rows = candidates.merged(candidates.pipe_tables(docs))
    assert sorted((r.line_no, r.fields) for r in rows.collect()) == [(9, ["1", "0012"]), (12, ["2", "n/a"])]
    proposed = {r.label: (r.type, r.kind, r.estimated_rows) for r in candidates.proposal(rows).collect()}
    assert proposed == {"p": ("BIGINT", None, 2), "q": ("VARCHAR", None, 2)}
    shown = candidates.preview(rows).orderBy("rank").collect()
    assert [r.row for r in shown] == ["1 | 0012", "2 | n/a"]
    approvals = rows.selectExpr("candidate", "false AS approved").distinct()
    assert candidates.approved(rows, approvals).count() == 0
    assert [r.status for r in candidates.gate_status(rows, approvals).collect()] == ["rejected"]


def test_a_long_front_matter(spark):
    entries = "".join(f"  - id: s{i}\n    resource: raw/{i}.csv\n" for i in range(50_000))
    body = f"---\ntype: Entity\nsources:\n{entries}title: T\n---\ntext"
    row = corpus.page_frontmatter(spark.createDataFrame([("wiki/entities/a.md", body)], "path string, body string")).first()
    assert len(row.sources) == 50_000 and row.sources[-1].resource == "raw/49999.csv" and row.title == "T"


def test_text_records_read_documents_once(spark, tmp_path):
    spark.createDataFrame([(1, "a,b\n1,2\n\nx;y\n3;4")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    found = candidates.text_records(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted((r.sep, r.width, r.first_line, r.last_line, tuple(r.lines)) for r in found.collect()) == [
        (",", 2, 0, 1, ("a,b", "1,2")), (";", 2, 3, 4, ("x;y", "3;4")),
    ]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_closure_doubles_its_reach(spark, monkeypatch):
    """A chain of 1,000 pages in about ten rounds, whole or from a few starts."""
    chain = [(f"p{i:04}", f"p{i + 1:04}") for i in range(1000)] + [("p0500", "p0000"), ("q", "p0990"), ("q", "q")]
    parents = spark.createDataFrame(chain, "path string, parent string")
    rounds, kept = [], links.checkpointed
    monkeypatch.setattr(links, "checkpointed", lambda session, df: rounds.append(1) or kept(session, df))
    starts = spark.createDataFrame([("p0900",), ("q",), ("p0499",)], "path string")
    got = {(r.path, r.ancestor): r.depth for r in links.closure(parents, starts).collect()}
    assert len(rounds) < 60
    want = {("p0900", f"p{i:04}"): i - 900 for i in range(901, 1001)} | {("q", f"p{i:04}"): i - 989 for i in range(990, 1001)}
    want |= {("p0499", f"p{i:04}"): i - 499 for i in range(500, 1001)} | {("p0499", f"p{i:04}"): i + 2 for i in range(499)}
    assert got == want


def test_closure_of_any_graph(spark):
    import random

    rng = random.Random(4)
    edges = {(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(70)}
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    want = {}
    for start in up:
        level, depth = {start}, 0
        while level := {b for a in level for b in up.get(a, ()) if b != start and (start, b) not in want}:
            depth += 1
            want |= {(start, b): depth for b in level}
    parents = spark.createDataFrame(sorted(edges), "path string, parent string")
    assert {(r.path, r.ancestor): r.depth for r in links.closure(parents).collect()} == want
    some = spark.createDataFrame([(str(i),) for i in range(0, 40, 3)], "path string")
    assert {(r.path, r.ancestor): r.depth for r in links.closure(parents, some).collect()} == {k: d for k, d in want.items() if int(k[0]) % 3 == 0}


def page(path, body, front=""):
    return (path, f"---\ntype: Entity\n{front}---\n{body}")


def test_names_in_prose(spark):
    rows = [
        page("wiki/entities/A.md", "We met Ana Maria Lopes in Porto Alegre. Nobody asked. Porto is far."),
        page("wiki/entities/B.md", "Then Ana Maria Lopes left Porto Alegre and [[Porto Velho]]; so did Ana Maria."),
        page("wiki/entities/C.md", "In Porto Alegre and in Porto Velho, and Box 12 stays."),
        page("wiki/entities/D.md", "Also Box 12 and Box 13.\n\nAna went. The year 2024 Box."),
        page("wiki/entities/Porto_Alegre.md", "x", "title: Porto Alegre\n"),
    ]
    parsed = corpus.page_frontmatter(spark.createDataFrame(rows, "path string, body string"))
    assert {(r.name, r.n_pages) for r in links.missing_names(parsed).collect()} == {("Ana Maria Lopes", 2), ("Box 12", 2), ("Porto", 3)} - {("Porto", 3)}
    assert links.missing_names(parsed, 9).collect() == []


def test_titles_by_their_first_word(spark):
    rows = [
        page("wiki/entities/A.md", "The sea, the sea of Crete, and the [[Cliff]] walk. the\n\nlast", "title: The Sea\n"),
        page("wiki/entities/B.md", "Here the sea of crete ends: the last day.", "title: The sea of Crete\n"),
        page("wiki/entities/C.md", "One cliff.", "title: the last\n"),
        page("wiki/entities/Cliff.md", "nothing", "title: Cliff walk\n"),
    ]
    parsed = corpus.page_frontmatter(spark.createDataFrame(rows, "path string, body string"))
    edges = links.wikilink_edges(parsed)
    path = "wiki/entities/{}.md".format
    assert sorted((r.path, r.detail) for r in links.missing_crossrefs(parsed, edges).collect()) == [
        (path("A"), path("B")), (path("B"), path("A")), (path("B"), path("C")), (path("C"), path("Cliff")),
    ]


def test_facts_of_pages_and_tables(spark):
    rows = [page("wiki/entities/A.md", "x", "CPF: 529.982.247-25\nCidade: Porto\n"), page("wiki/entities/B.md", "x", "cpf: none\ncidade: Lima\n")]
    parsed = corpus.page_frontmatter(spark.createDataFrame(rows, "path string, body string"))
    table = spark.createDataFrame([("52998224725", "Manaus", 3), ("x", "Lima", 4)], "doc string, cidade string, n long")
    facts = links.page_facts(parsed, "cpf", "cpf").unionByName(links.table_facts(table, "doc", "cpf", "t"))
    assert sorted(map(tuple, facts.collect())) == [("52998224725", "cidade", "Manaus", "t"), ("52998224725", "cidade", "Porto", "wiki/entities/A.md"), ("52998224725", "n", "3", "t")]
    (found,) = links.contradictions(facts).collect()
    assert (found.n_values, found.first_value, found.first_source, found.last_source) == (2, "Manaus", "t", "wiki/entities/A.md")
