import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folio.functions import markdown as m

SERVER = "markdown/api-reference/server-api-reference/"


def kinds(chunks):
    return [c["chunk_type"] for c in chunks]


def test_frontmatter_yaml_fallback_and_dates():
    fields, body = m.parse_frontmatter("---\ntitle: A\nlast_updated: 2024-05-06\nok: yes\nflag: true\n---\nbody")
    assert fields == {"title": "A", "last_updated": "2024-05-06", "ok": "yes", "flag": True} and body == "body"
    loose, _ = m.parse_frontmatter("---\ntitle: Uses: a colon\ntags: [a, b]\nempty:\nnumber: 3\nquoted: \"x\"\n---\n")
    assert loose == {"title": "Uses: a colon", "tags": ["a", "b"], "empty": "", "number": 3, "quoted": "x"}
    assert m.parse_frontmatter("no front matter") == ({}, "no front matter")


def test_api_document_with_html_table_and_entities():
    md = "# Thing API\n\n## Thing - run(String a)\n\nRuns it.\n\n<table><tr><th>Name</th><th>Type</th><th>Description</th></tr><tr><td>a</td><td>String</td><td>Use &lt;b&gt; &amp;\nmore</td></tr><tr><td>z</td></tr></table>|Type|Description|\n|---|---|\n|Boolean|Done|\n"
    c = m.chunk_document(SERVER + "c_ThingAPI.md", md, "main", "rel")
    assert kinds(c) == ["overview", "method", "parameter", "parameter", "returns"]
    assert "Parameter: a: String. Use <b> &\nmore" in c[2]["content"] and c[3]["content"].endswith("Parameter: z: .")
    assert c[1]["metadata"]["summary"] == "Runs it." and c[1]["method_name"] == "run" and c[0]["object_name"] == "Thing"


def test_rest_endpoints_long_examples_and_deprecation():
    md = "---\ntitle: Table (deprecated)\n---\n## Table - GET /now/table\n\nReads.\n\n```\n" + "\n".join(f"line number {k} of the example" for k in range(120)) + "\n```\n"
    c = m.chunk_document("markdown/api-reference/rest-apis/c_TableAPI.md", md, "main", "rel")
    assert kinds(c)[:2] == ["overview", "endpoint"] and set(kinds(c)[2:]) == {"example"} and len(c) > 3
    assert [x["metadata"]["chunk_part"] for x in c[2:]] == list(range(1, len(c) - 1)) and c[0]["metadata"]["deprecated"] is True
    assert c[0]["object_name"] == "TableAPI"


def test_headings_in_fences_are_no_headings():
    fence = "```\n## Fake - no()\n### fake term\n```\n"
    api = m.chunk_document(SERVER + "x.md", f"# X\n\n{fence}\n## X - go()\n\nGoes.\n", "main", "r")
    topic = m.chunk_document("markdown/p/t.md", f"# T\n\n{fence}\n## Real\n\ntext\n", "main", "r")
    terms = m.chunk_document("markdown/glossary/g.md", f"# G\n\n{fence}\n### real\nmeaning\n## A\nmore\n", "main", "r")
    assert kinds(api) == ["overview", "method", "example"] or kinds(api) == ["overview", "method"]
    assert [c["heading"] for c in topic] == [None, "Real"]
    assert [(c["heading"], c["metadata"]["definition"]) for c in terms] == [("real", "meaning more")]


def test_topics_glossaries_and_contents():
    assert m.chunk_document("markdown/p/toc.md", "---\ntopic_type: toc\n---\n# x\n", "b", "r") == []
    t = m.chunk_document("markdown/p/t.md", "---\nproduct: P\n---\n# T\n\nintro\n\n## One\n\n" + "\n\n".join("word " * 50 for _ in range(40)), "b", "r")
    assert kinds(t)[0] == "overview" and len(t) > 4 and all(c["content"].startswith("Title: T\n") for c in t) and [c["chunk_index"] for c in t] == list(range(len(t)))
    assert all(len(c["content"]) <= 1792 for c in t)
    g = m.chunk_document("markdown/glossary/g.md", "# G\n\nno terms", "b", "r")
    assert kinds(g) == ["overview"] and g[0]["classification"] == "glossary"


def test_tables_names_and_scopes():
    (keys, rows), = m.pipe_tables("|A b|C|\n|:-|-|\n|1|2|\n|only|\n|x||\nend\n")
    assert keys == ["a_b", "c"] and rows == [{"a_b": "1", "c": "2"}, {"a_b": "x", "c": ""}]
    assert list(m.pipe_tables("|A|B|\n|-|-|")) == []
    assert m.is_parameter_table(["name", "type", "description"]) and not m.is_return_table(["type"]) and m.is_return_table(["properties", "description"])
    assert m.object_name("Query - Scoped (deprecated)", "x/c_QueryAPI.md", "scripting-api") == "Query"
    assert m.object_name("Title", "x/r_FormScoped.md", "scripting-api") == "Form" and m.object_name("Title", "x/c_TableAPI.md", "rest-api") == "TableAPI"
    assert m.scopes("Scoped and global", "scoped again") == ["Scoped", "Global"]
    assert m.keywords("GlideHTTPRequest", "getURL") == "glide httprequest get url" or m.keywords("GlideHTTPRequest", "getURL") == "glide http request get url"


def test_summaries():
    assert m.summarize_method("\n- item\n\n<div>\nhidden\n</div>\n\nFirst line\nsecond.\n\nother") == "First line second."
    assert m.first_paragraph("# T\n\n- a\n\none\ntwo\n\nthree") == "one two"
    long = "word " * 200
    assert len(m.concise(long)) <= 500 and not m.concise(long).endswith(" ") and len(m.concise("x" * 900)) == 500


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n.é")), max_size=3000), st.integers(256, 900))
def test_split_text_keeps_every_word_within_the_limit(text, most):
    parts = m.split_text(text, most)
    assert all(len(p) <= most for p in parts) and parts
    joined = re.sub(r"\s+", "", "".join(parts))
    words = re.sub(r"\s+", "", text)
    assert set(joined) <= set(words) and len(joined) >= len(words)


def test_split_line_and_overlap():
    assert m.split_line("aaa bbb ccc", 7) == ["aaa bbb", "ccc"] and m.split_line("x" * 10, 4) == ["xxxx", "xxxx", "xx"]
    assert m.overlap_tail("a" * 300) == "a" * 200 and m.overlap_tail("x " + "b" * 150 + " " + "c" * 100) == "c" * 100
