import json

import pytest

from cairn.chunking import formats
from cairn.chunking.absorb import absorb
from cairn.chunking.extract import extract, merge_small
from cairn.functions.ids import chunk_id_of
from cairn.plans.samples import SAMPLES
from cairn.sources.languages import LANGUAGES, detect


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_declarations_and_edges(language):
    source, want, edges = SAMPLES[language]
    chunks, raw = extract(source, "dir/a.x", "p", language)
    assert [(c.type, c.name, c.metadata.get("className"), c.start, c.end) for c in chunks] == want
    first = {c.id: c.start for c in chunks}
    assert [(e.type, e.symbol, e.file, first[e.source]) for e in raw] == edges
    lines = source.split("\n")
    for c in chunks:
        assert 1 <= c.start <= c.end <= len(lines) and c.id == chunk_id_of("p", "dir/a.x", c.start)
        assert c.content in c.context
    ids = {c.id for c in chunks}
    assert all(r.source in ids for r in raw)


def test_every_language_has_a_sample():
    assert set(SAMPLES) == set(LANGUAGES)


@pytest.mark.parametrize("language", sorted(LANGUAGES))
@pytest.mark.parametrize("text", ["", "\n\n", "x", "}{)(][", '"""', "/* open", "'" * 7, "end end end", "<a><b", "# "])
def test_strange_texts_give_something(language, text):
    chunks, _ = extract(text, "a", "p", language)
    assert chunks


def test_unknown_language_gives_nothing():
    assert extract("x", "a", "p", None) == ([], []) == extract("x", "a", "p", "cobol")


def test_breadcrumb_context_and_header():
    source, _, _ = SAMPLES["typescript"]
    chunks, _ = extract(source, "a.ts", "p", "typescript")
    greet = next(c for c in chunks if c.name == "label")
    parts = greet.context.split("\n\n")
    assert parts[0] == "// Class: Depot\n// Method: label" and parts[1].startswith("import {") and "export class Depot" in greet.context
    cls = next(c for c in chunks if c.name == "Depot")
    assert cls.content.startswith("/** doc */") and cls.start == 4


def test_edges_start_at_the_enclosing_function():
    source, _, _ = SAMPLES["typescript"]
    chunks, raw = extract(source, "a.ts", "p", "typescript")
    call = next(e for e in raw if e.symbol == "shown")
    assert call.source == next(c.id for c in chunks if c.name == "label")
    assert next(e for e in raw if e.type == "EXTENDS").file == "emitter"
    chunks, raw = extract(source, "a.ts", "p", "typescript", edge_source="first_chunk")
    assert {e.source for e in raw} == {chunks[0].id}


def test_absorb():
    lines = ["x", "// a", "// b", "", "f()"]
    assert absorb(lines, 4, "go") == 4  # a gap directly above is none
    assert absorb(["// a", "", "// b", "f()"], 3, "go") == 0
    assert absorb(["/**", " * d", " */", "@Inject", "f()"], 4, "typescript") == 0
    assert absorb(["# c", "f()"], 1, "go") == 1
    assert absorb(["// x"] * 100 + ["f()"], 100, "go") == 20


def test_markdown_breadcrumbs_and_long_sections():
    text = "# A\na\n### B\nb\n### C\nc\n"
    crumbs = [s.breadcrumb for s in formats.markdown_sections(text.split("\n"), 6000)]
    assert crumbs == ["A", "A > B", "A > B > C"]
    long = "# T\n\n" + "\n\n".join(f"paragraph {i} " + "x" * 50 for i in range(10))
    parts = formats.markdown_sections(long.split("\n"), 200)
    assert len(parts) > 3 and all(p.name is None and p.type == "section" for p in parts)
    assert formats.markdown_sections(["no heading"], 10)[0].type == "file"


def test_few_sections_stay_whole():
    assert [c.type for c in extract('{"a": 1}', "x.json", "p", "json")[0]] == ["file"]
    assert len(extract("a: 1\nb: 2\n", "x.yaml", "p", "yaml")[0]) == 1
    assert len(extract("<a/>", "x.xml", "p", "xml")[0]) == 1
    assert len(extract("<a><b>", "x.xml", "p", "xml")[0]) == 1


def test_small_neighbours_merge():
    source = "type A = string;\ntype B = number;\ntype C = boolean;\n"
    chunks, _ = extract(source, "a.ts", "p", "typescript", min_tokens=50)
    assert [(c.type, c.name, c.start, c.end) for c in chunks] == [("type", "A +2", 1, 3)]
    assert len(merge_small(chunks, 0)) == 1
    assert json.dumps(chunks[0].metadata)


def test_language_detection():
    assert [detect(p) for p in ("a.tsx", "b/c.PY", "x.mm", "y.m", "Makefile", "z.unknown", ".gitignore")] == ["typescript", "python", "objc", "matlab", None, None, None]


def test_kinds(spark):
    from cairn.chunking.kinds import chunk_type, chunk_type_of, imported_module, sections_from_outline

    want = {"Function_Declaration": "function", "impl": "class", "mod_item": "module", "type_item": "typealias", "alias_declaration": "typealias", "enum_class_declaration": "enum", "static_item": "const", "type_definition": "type", "module_type_definition": "module_type", "category_interface": "extension", "let": "variable", "import_statement": "import", "whatever": "file", "preproc_def": "macro"}
    assert {k: chunk_type(k) for k in want} == want
    df = spark.createDataFrame([(k,) for k in want], "k string").select("k", chunk_type_of("k").alias("t"))
    assert {r["k"]: r["t"] for r in df.collect()} == want
    assert [imported_module(s) for s in ("from a.b import c", "import static x.Y;", "use std::io;", "nothing")] == ["a.b", "x.Y", "std::io", None]
    chunks, edges = sections_from_outline("import a\nclass K\n m\nend", [("class", "K", 1, 3, [("method", "m", 2, 2)])], [(0, 0, "import a")])
    assert [(c.type, c.name, c.start, c.end) for c in chunks] == [("import", None, 1, 1), ("class", "K", 2, 4), ("method", "m", 3, 3)] and edges[0].symbol == "a"
    assert [c.type for c in sections_from_outline("x", [])[0]] == ["file"]


def test_all_documents_are_chunked(spark, tmp_path):
    from hashlib import md5

    from cairn.plans import catalogue

    docs = {1: "plain\ntext", 2: "before\n# A\na\n## B\nb\n\n# C\nc", 3: None, 4: "", 5: "#no heading\n#### nor this", 6: "### only"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in docs.items():
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if any(x.startswith("#" * n + " ") for n in (1, 2, 3))]
        for a, b in zip(at, [*at[1:], len(lines)]):
            want.append((f"d{i}.md", "section", lines[a].lstrip("#").strip(), a + 1, b, md5("\n".join(lines[a:b]).strip().encode()).hexdigest()))
        if not at:
            want.append((f"d{i}.md", "file", f"d{i}.md", 1, len(lines), md5((text or "").encode()).hexdigest()))
    got = catalogue.QUERIES["chunk_documents"](spark, str(tmp_path)).collect()
    assert sorted((r["file_path"], r["type"], r["name"], r["start_line"], r["end_line"], r["content_md5"]) for r in got) == sorted(want)
