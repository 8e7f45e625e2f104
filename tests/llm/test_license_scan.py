from tidemark.llm import license_scan as ls


def test_given_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: set(r["licenses"]) for r in ls.scan(docs).collect()}
    want = {r["doc_id"]: ls.brute_force(r["text"], ls.TEMPLATES) for r in docs.collect()}
    assert got == want and sum(map(bool, want.values())) > 3


def test_edge_rows(spark):
    apache = ls.TEMPLATES["apache-2.0-header"]
    rows = [(1, None, 0), (2, "", 0), (3, "\n\n ", 0), (4, "MIT", 0), (5, "x y\nALL RIGHTS   RESERVED!\nAll rights reserved.", 0), (6, apache.replace(" you", "\n * you"), 0), (6, "text\n\n" + apache.replace("; ", "\n") + "\n\nend " * 3, 0), (None, "released under the mit license", 0), (8, "word " * 50_000, 0), (9, "é all rights reserved", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, best int")
    got = [(r["doc_id"], set(r["licenses"]), r["n_matches"]) for r in ls.scan(docs).collect()]
    assert sorted((str(i), sorted(s)) for i, s, _ in got) == sorted((str(i), sorted(ls.brute_force(t, ls.TEMPLATES))) for i, t, _ in rows)
    assert {i: n for i, _, n in got}[5] == 2
    assert ls.scan(docs.limit(0)).collect() == []
    assert {tuple(r["licenses"]) for r in ls.scan(docs, templates={}).collect()} == {()}


def test_whole_licences_are_found_by_name(spark):
    """Each template alone, wrapped, indented as a comment, and with a copyright line and prose around it."""
    import textwrap

    rows, names = [], sorted(ls.TEMPLATES)
    for k, name in enumerate(names):
        text = ls.TEMPLATES[name]
        wrapped = textwrap.fill(text, 72)
        rows += [(4 * k, text), (4 * k + 1, wrapped), (4 * k + 2, textwrap.indent(wrapped, " * ")), (4 * k + 3, f"Some words about a project.\n\nMore of them here\n\n{wrapped}\n\nThe end of the file.")]
    got = {r["doc_id"]: set(r["licenses"]) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, name in enumerate(names):
        for j in range(4):
            assert name in got[4 * k + j], (name, j)


def test_licences_of_several_paragraphs(spark):
    text = ls.TEMPLATES["mit-text"].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    rows = [(1, "MIT License\n\nCopyright (c) 2020 someone\n\n" + text), (2, "intro\n\n" * 3 + text + "\n\nand so on" * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: set(r["licenses"]) for r in ls.scan(docs).collect()}
    assert got == {i: ls.brute_force(t, ls.TEMPLATES) for i, t in rows} and all("mit-text" in v for v in got.values())


def test_templates_of_many_paragraphs_inside_a_text(spark):
    parts = [f"Part {c} says that the {c}-holder may {w} the work under terms of its own." for c, w in zip("abcdefg", ["copy", "print", "sell", "lend", "alter", "show", "keep"])]
    templates = {"seven-parts": "\n\n".join(parts), "short": "All rights reserved."}
    rows = [(1, "An introduction.\n\n" + templates["seven-parts"] + "\n\nThe end.\n\nAnd more of it here."), (2, "\n\n".join(parts[:3]) + "\n\nother words"), (3, "x\n \n" + "\n \t\n".join(parts) + "\n\ny")]
    got = {r["doc_id"]: r["licenses"] for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    assert got == {1: ["seven-parts"], 2: [], 3: ["seven-parts"]} and {i: sorted(ls.brute_force(t, templates)) for i, t in rows} == got
    assert ls.longest_run(ls.TEMPLATES) >= ls.RUN
