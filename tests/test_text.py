import pytest
from pyspark.sql import functions as F

from folio.functions import hashing, markdown, text


def values(spark, column, *rows):
    df = spark.createDataFrame([(r if isinstance(r, tuple) else (r,)) for r in rows], ", ".join(f"c{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [r[0] for r in df.select(column).collect()]


TITLES = [("Query - Scoped (Deprecated)", "a/c_QueryAPI.md", "scripting-api"), ("T", "a/r_FormScoped.md", "scripting-api"), ("T", "a/c_TableAPI.md", "rest-api"), ("Plain (deprecated)", "a/c_API.md", "scripting-api"), ("T", "a/.md", "x")]


def test_columns_agree_with_the_chunker(spark):
    c = F.col("c0")
    cells = ["<b>x</b>&lt;y&gt;", " a\t b&nbsp;", "&amp;lt;", "", "  "]
    assert values(spark, text.clean_cell(c), *cells) == [markdown.clean_cell(x) for x in cells]
    assert values(spark, text.normalize_header(c), *cells) == [markdown.header_key(x) for x in cells]
    rows = ["|a|b|", "a|b", "||a||", "|", "", "x"]
    assert values(spark, text.pipe_cells(c), *rows) == [markdown.pipe_cells(x) for x in rows]
    long = ["word " * 150, "x" * 700, "short  text", "y" * 300 + " " + "z" * 400, ""]
    assert values(spark, text.concise(c), *long) == [markdown.concise(x) for x in long]
    assert values(spark, text.overlap_tail(c), *long) == [markdown.overlap_tail(x) for x in long]
    bodies = ["a\r\nb\\(c\\)", "</table>|x|", "</table>x", "a\n\n\n\nb \n", " x "]
    assert values(spark, text.normalize_markdown(c), *bodies) == [markdown.normalize(x) for x in bodies]
    assert values(spark, text.object_name(c, F.col("c1"), F.col("c2")), *TITLES) == [markdown.object_name(*t) for t in TITLES]
    scoped = [("Global thing", "scoped global"), ("none", "globally"), ("SCOPED", "Scoped")]
    assert values(spark, text.scopes(c, F.col("c1")), *scoped) == [markdown.scopes(*t) for t in scoped]
    names = [("HTTPRequest", "getURL2Text"), ("a_b", None), (None, None)]
    assert values(spark, text.identifier_keywords(c, F.col("c1")), *names) == [markdown.keywords(*t) for t in names]
    api = [("Obj", "m", "m(x)", "r", "detail"), ("Obj", None, "", "r", None)]
    col = text.api_content("Summary", c, F.col("c1"), F.col("c2"), F.col("c3"), F.col("c4"))
    assert values(spark, col, *api) == [markdown.api_content("Summary", *t) for t in api]
    code = ["```js\n a \n```\ntext\n```\n\n```", "none"]
    assert values(spark, text.examples(c), *code) == [markdown.examples(x) for x in code]
    paths = ["markdown/api-reference/rest-apis/a.md", "markdown/api-reference/x.md", "markdown/glossary/x.md", "markdown/x/y.md", "markdown/api-reference/a/b.md"]
    assert values(spark, text.doc_type(c), *paths) == [markdown.doc_type(p) for p in paths]


def test_titles_urls_and_small_ones(spark):
    c = F.col("c0")
    assert values(spark, text.extract_title(c, F.lit("")), "x\n# T \n", "none") == ["T", "Untitled document"]
    assert values(spark, text.percent_encoded(c), "a b(c)!'*~é") == ["a%20b(c)!'*~%C3%A9"]
    assert values(spark, text.raw_url(F.lit("b c"), c), "x/y z.md") == ["https://example.invalid/raw/b%20c/x/y%20z.md"]
    assert values(spark, text.method_name(c), "get\\(a\\) b", "run (x)", "none") == ["get", "run", "none"]
    assert values(spark, text.deprecated(c), "X (Deprecated)", "X \\( deprecated \\)", "X") == [True, True, False]
    assert values(spark, text.estimated_tokens(c), "", "a", "abc", "é") == [1, 1, 2, 1]
    assert values(spark, text.content_hash(c), "abc") == ["a9993e364706816aba3e25717850c26c9cd0d89d"]
    assert values(spark, text.publication(c), "a/b/c", "a") == ["b", ""]
    m = F.create_map(F.lit("full_content"), c, F.lit("k"), c)
    assert values(spark, text.stored_metadata(m), "v") == ['{"k":"v"}']


@pytest.mark.parametrize("word", ["a", "the", "sn_table", "0123456789abcdef"])
def test_hash_column_agrees_with_numpy(spark, word):
    h = values(spark, hashing.fnv1a(F.col("c0")), word)[0]
    assert hashing.hash_vector(word)[abs(h) % 64] == 1 and -(2**31) <= h < 2**31
