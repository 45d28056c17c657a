"""Queries that run the ingestion code (functions.markdown) over whole tables, and the SQL that gives the same rows.

Documents become Markdown by plain concatenation, so that the SQL can say what each part turns into.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_CHARACTERS, Collection
from ..functions import markdown as M
from .ingest import chunk_rows, parse
from .queries import PATH, docs, query

NL = "chr(10)"
WHITE = r"^\s+|\s+$"


def per_row(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """A row of results for each of the tuples that f gives for a row, in Arrow batches."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            rows = [x for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in f(*r)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, arrow, strict=True)], names=arrow.names)

    return df.mapInArrow(run, out)


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '{WHITE}', '', 'g')"


def cell_sql(c: str) -> str:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c if 'regexp' in c else f'regexp_replace({c}, $$<[^>]+>$$, $$ $$, $$g$$)'}, '{entity}', '{char}')"
    return trim_sql(f"regexp_replace({c}, '[ \\t]+', ' ', 'g')")


LINES_SQL = f"""lines AS (SELECT doc_id, unnest(string_split("text", {NL})) AS line, generate_subscripts(string_split("text", {NL}), 1) - 1 AS no FROM documents)"""


@query(f"""SELECT doc_id, source AS product, lang AS topic_type, '2024-01-31' AS last_updated, CASE WHEN doc_id % 3 = 0 THEN 'a: b: [c' END AS odd, sha1("text") AS body_sha1 FROM documents""")
def parse_frontmatter(spark, d):
    """Fields as YAML or, where a value is none, line by line; and the body after them."""
    odd = F.when(F.col("doc_id") % 3 == 0, F.lit("odd: a: b: [c\n")).otherwise("")
    text = F.concat(F.lit("---\nproduct: "), "source", F.lit("\ntopic_type: "), "lang", F.lit("\nlast_updated: 2024-01-31\n"), odd, F.lit("---\n"), "text")

    def one(doc_id, x):
        front, body = M.parse_frontmatter(x)
        yield doc_id, front.get("product"), front.get("topic_type"), front.get("last_updated"), front.get("odd"), M.hashlib.sha1(body.encode()).hexdigest()

    return per_row(docs(spark, d).select("doc_id", text), one, "doc_id long, product string, topic_type string, last_updated string, odd string, body_sha1 string")


@query(f"""SELECT doc_id, {trim_sql(f'''split_part("text", {NL}, 1)''')} AS first_line, 'Untitled document' AS without, lang AS stated FROM documents""")
def extract_title(spark, d):
    """The first heading, the fallback where there is none, and the stated title where there is one."""

    def one(doc_id, text, lang):
        title = lambda x: M.Document("markdown/a/b.md", x, "main", "r", CHUNK_CHARACTERS, Collection()).title
        first = text.split("\n")[0]
        yield doc_id, title(f"# {first}\n\nwords") if first.strip() else "", title(f"words\n## {first}"), title(f"---\ntitle: {lang}\n---\n# {first}")

    return per_row(docs(spark, d).select("doc_id", "text", "lang"), one, "doc_id long, first_line string, without string, stated string")


@query(f"""SELECT doc_id, 'https://example.invalid/raw/main/markdown/' || source || '/' || replace(url_encode(left(regexp_replace("text", '[^a-zA-Z0-9 ]+', ' ', 'g'), 40)), '+', '%20') || '%23%C3%A9!.md' AS url FROM documents""")
def raw_url(spark, d):
    name = F.substring(F.regexp_replace("text", "[^a-zA-Z0-9 ]+", " "), 1, 40)

    def one(doc_id, path):
        yield doc_id, M.Document(path, "x", "main", "r", CHUNK_CHARACTERS, Collection()).url

    return per_row(docs(spark, d).select("doc_id", F.concat(F.lit("markdown/"), "source", F.lit("/"), name, F.lit("#é!.md")).alias("path")), one, "doc_id long, url string")


@query(f"""WITH {LINES_SQL}, c AS (SELECT doc_id, no, list_transform(string_split(line, '|'), lambda x: {cell_sql('x')}) AS c FROM lines WHERE contains(line, '|')),
  h AS (SELECT doc_id, no, CASE WHEN c[1] = '' THEN c[2:] ELSE c END AS c FROM c), t AS (SELECT doc_id, no, CASE WHEN len(c) > 0 AND c[len(c)] = '' THEN c[:len(c) - 1] ELSE c END AS c FROM h)
  SELECT doc_id, CAST(no AS BIGINT) AS no, CAST(len(c) AS BIGINT) AS n, sha1(array_to_string(c, '|')) AS cells_sha1 FROM t""")
def pipe_cells(spark, d):
    """Cells of every line with a bar."""

    def one(doc_id, text):
        for no, x in enumerate(text.split("\n")):
            if "|" in x:
                c = M.pipe_cells(x)
                yield doc_id, no, len(c), M.hashlib.sha1("|".join(c).encode()).hexdigest()

    return per_row(docs(spark, d).select("doc_id", "text"), one, "doc_id long, no long, n long, cells_sha1 string")


_ROWS_SQL = f"""{LINES_SQL}, w AS (SELECT doc_id, no, {trim_sql("replace(replace(replace(line, '|', ' '), '<', ' '), '&', ' ')")} AS line FROM lines),
  r AS (SELECT doc_id, no, regexp_replace(line, '[ \\t]+', ' ', 'g') AS line FROM w)"""


def _table_rows(text: str) -> list[str]:
    return [x.replace("|", " ").replace("<", " ").replace("&", " ").strip() for x in text.split("\n")]


@query(f"""WITH {_ROWS_SQL} SELECT doc_id, no + 1 AS name, line AS type, CASE WHEN no % 2 = 0 THEN 'even' ELSE 'odd' END AS description FROM r""")
def pipe_tables(spark, d):
    """Rows of a table drawn with bars after some prose; one row with too few cells is left out."""

    def one(doc_id, text):
        rows = [f"|{k}|{x}|{'even' if k % 2 else 'odd'}|" for k, x in enumerate(_table_rows(text), 1)]
        section = "\n".join(["prose", "", "|Name|Type|Description|", "|---|:--|--:|", "|too|few|", *rows, "", "more prose"])
        for keys, found in M.pipe_tables(section):
            assert M.is_parameter_table(keys)
            for r in found:
                yield doc_id, int(r["name"]), r["type"], r["description"]

    return per_row(docs(spark, d).select("doc_id", "text"), one, "doc_id long, name long, type string, description string")


@query(f"""WITH {_ROWS_SQL} SELECT doc_id, CAST(no AS BIGINT) AS no, line AS properties, CASE WHEN no % 2 = 0 THEN '<b> & more' ELSE '' END AS description FROM r""")
def html_tables(spark, d):
    """Rows of a table in HTML with tags and entities in its cells; a missing cell is empty."""

    def one(doc_id, text):
        rows = [f"<tr>\n<td><i>{x}</i></td>{'<td>&lt;b&gt; &amp; more</td>' if k % 2 == 0 else ''}</tr>" for k, x in enumerate(_table_rows(text))]
        section = "before <TABLE class='x'><tr><th>Properties</th><th>Description</th></tr>" + "".join(rows) + "</TABLE> after"
        for keys, found in M.html_tables(section):
            assert M.is_return_table(keys) and not M.is_parameter_table(keys)
            for k, r in enumerate(found):
                yield doc_id, k, r["properties"], r["description"]

    return per_row(docs(spark, d).select("doc_id", "text"), one, "doc_id long, no long, properties string, description string")


@query(f"""WITH {LINES_SQL}, f AS (SELECT doc_id, no, {trim_sql('line')} AS x FROM lines),
  g AS (SELECT *, NOT (x = '' OR left(x, 1) IN ('#', '-', '|') OR left(x, 3) = '```') AS ok FROM f), s AS (SELECT doc_id, min(no) AS lo FROM g WHERE ok GROUP BY doc_id),
  e AS (SELECT doc_id, min(no) AS hi FROM g JOIN s USING (doc_id) WHERE NOT ok AND no > lo GROUP BY doc_id)
  SELECT documents.doc_id, coalesce(left(string_agg(x, ' ' ORDER BY no), 500), '') AS paragraph FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN g ON g.doc_id = documents.doc_id AND no >= lo AND (hi IS NULL OR no < hi) GROUP BY documents.doc_id""")
def first_paragraph(spark, d):
    return per_row(docs(spark, d).select("doc_id", "text"), lambda i, x: [(i, M.first_paragraph(x))], "doc_id long, paragraph string")


@query(f"""WITH l AS (SELECT doc_id, {trim_sql(f'''replace("text", {NL}, ' ')''')} AS line FROM documents), c AS (SELECT doc_id, regexp_replace(line, '\\s+', ' ', 'g') AS t, line FROM l),
  h AS (SELECT *, left(t, 500) AS h FROM c), b AS (SELECT *, length(h) - strpos(reverse(h), ' ') AS cut FROM h)
  SELECT doc_id, CASE WHEN line = '' OR left(line, 1) IN ('#', '<') OR contains(line, '|') OR regexp_matches(line, '^[-*+](\\s|$)') THEN 'after the table' WHEN length(t) <= 500 THEN t WHEN strpos(h, ' ') > 0 AND cut >= 250 THEN trim(left(h, CAST(cut AS BIGINT))) ELSE trim(h) END AS summary FROM b""")
def summarize_method(spark, d):
    """The first paragraph outside fences, HTML blocks, lists and headings; where the text is none, the one after it."""

    def one(doc_id, text):
        body = f"```js\nnot this\n```\n\n<table>\nnor this\n</table>\n\n- a list\n\n## a heading\n\n{text.replace(chr(10), ' ')}\n\nafter the table"
        yield doc_id, M.summarize_method(body)

    return per_row(docs(spark, d).select("doc_id", "text"), one, "doc_id long, summary string")


@query("""SELECT doc_id, concat(upper(source), ' x') AS stated, concat('Rec', doc_id) AS api, concat('Rec', doc_id, 'API') AS rest FROM documents""")
def object_name(spark, d):
    """From the title before a dash, else from the file's name without prefix and suffix, but for REST."""

    def one(doc_id, source):
        path = f"markdown/a/c_Rec{doc_id}API.md"
        yield doc_id, M.object_name(f"{source.upper()} x (deprecated) - y - z", path, "scripting-api"), M.object_name("No dash", path, "scripting-api"), M.object_name("No dash", path, "rest-api")

    return per_row(docs(spark, d).select("doc_id", "source"), one, "doc_id long, stated string, api string, rest string")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'Scoped' END, CASE WHEN length("text") < 980 THEN 'Global' END], lambda x: x IS NOT NULL), ',') AS scopes FROM documents""")
def scopes(spark, d):
    """Scopes in the title and in the first thousand characters of the body, in order. (No document holds the words itself.)"""

    def one(doc_id, text):
        body = text + " " * (980 - len(text)) + " GLOBAL" if len(text) < 980 else text[:980] + " " * 30 + "global"
        yield doc_id, ",".join(M.scopes("unscoped sCOPED" if doc_id % 2 == 0 else "globally", body))

    return per_row(docs(spark, d).select("doc_id", "text"), one, "doc_id long, scopes string")


@query(f"""WITH {LINES_SQL}, f AS (SELECT doc_id, no, no % 5 IN (1, 3) AS mark FROM lines), m AS (SELECT *, sum(CAST(mark AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
  SELECT doc_id, count(*) AS n, count(*) FILTER (mark OR coalesce(before, 0) % 2 = 1) AS fenced, CAST(sum(CASE WHEN mark OR coalesce(before, 0) % 2 = 1 THEN no ELSE 0 END) AS BIGINT) AS places FROM m GROUP BY doc_id""")
def fence_mask(spark, d):
    """Lines inside code fences, where every fifth line's neighbours are made fences."""

    def one(doc_id, text):
        mask = M.fence_mask(["  ```js" if k % 5 in (1, 3) else x for k, x in enumerate(text.split("\n"))])
        yield doc_id, len(mask), sum(mask), sum(k for k, m in enumerate(mask) if m)

    return per_row(docs(spark, d).select("doc_id", "text"), one, "doc_id long, n long, fenced long, places long")


def _packed_sql(pieces: str, gap: str, budget: str) -> str:
    """Pieces joined by `gap` into parts of at most `budget` characters, first come first packed; parts stand between chr(1)."""
    return f"""list_reduce({pieces}, lambda a, x: CASE WHEN length(split_part(a, chr(1), -1)) + {{n}} + length(x) <= {budget} THEN a || {gap} || x ELSE a || chr(1) || x END)"""


def _line_sql(line: str, budget: str) -> str:
    """A line cut at spaces, as long as no word is longer than half the budget."""
    return f"string_split({_packed_sql(f'''string_split({line}, ' ')''', chr(39) + ' ' + chr(39), budget).format(n=1)}, chr(1))"


_FLAT_SQL = f"""flat AS (SELECT doc_id, {trim_sql(f'''regexp_replace("text", '\\s+', ' ', 'g')''')} AS line FROM documents WHERE NOT regexp_matches("text", '\\S{{{{128}}}}'))""".replace("{{", "{").replace("}}", "}")


@query(f"""WITH {_FLAT_SQL} SELECT doc_id, CAST(len(p) AS BIGINT) AS n, sha1(array_to_string(p, {NL})) AS parts_sha1 FROM (SELECT doc_id, {_line_sql('line', '256')} AS p FROM flat)""")
def split_long_line(spark, d):
    """Texts in one line, cut into lines of 256 characters. (The SQL holds for words of up to half that length.)"""

    def one(doc_id, text):
        p = M.split_line(" ".join(text.split()), 256)
        yield doc_id, len(p), M.hashlib.sha1("\n".join(p).encode()).hexdigest()

    return per_row(docs(spark, d).select("doc_id", "text"), one, "doc_id long, n long, parts_sha1 string")


def split_sql(body: str, most: str, source: str) -> str:
    """CTEs from `source` (doc_id and columns) to `parts` (doc_id, part list): what split_text gives for `body` at `most`."""
    budget = f"greatest(256, {most} - 200)"
    lines = f"list_transform(list_filter(list_transform(string_split(b, {NL}), lambda l: {trim_sql('l')}), lambda l: l <> ''), lambda l: {_line_sql('l', 'budget')})"
    tail = "CASE WHEN length(x) <= 200 THEN x ELSE substr(right(x, 200), strpos(right(x, 200), ' ') + 1) END"
    return f"""blocks AS (SELECT doc_id, {most} AS most, {budget} AS budget, list_filter(list_transform(string_split_regex({body}, '\\n{{2,}}'), lambda x: {trim_sql('x')}), lambda x: x <> '') AS bs FROM {source}),
  pieces AS (SELECT doc_id, most, budget, flatten(list_transform(bs, lambda b: CASE WHEN length(b) <= budget THEN [b] ELSE flatten({lines}) END)) AS ps FROM blocks),
  packed AS (SELECT doc_id, most, CASE WHEN len(ps) = 0 THEN [''] ELSE string_split({_packed_sql('ps', f'{NL} || {NL}', 'budget').format(n=2)}, chr(1)) END AS p FROM pieces),
  parts AS (SELECT doc_id, list_transform(range(1, len(p) + 1), lambda k: CASE WHEN k = 1 OR {tail.replace('x', 'p[k - 1]').replace('p[k - 1]p', 'xp')} = '' THEN p[k] ELSE left({tail.replace('x', 'p[k - 1]')} || {NL} || {NL} || p[k], most) END) AS part FROM packed)"""


@query(f"""WITH src AS (SELECT doc_id, "text" FROM documents), {split_sql('"text"', '1792', 'src')}
  SELECT doc_id, CAST(unnest(range(0, len(part))) AS INTEGER) AS part, unnest(part) AS content FROM parts""")
def split_chunk_text(spark, d):
    """Parts of whole texts. (The SQL holds for lines whose words are up to 128 characters long.)"""
    return per_row(docs(spark, d).select("doc_id", "text"), lambda i, x: [(i, k, p) for k, p in enumerate(M.split_text(x))], "doc_id long, part int, content string")


_TOPIC_SQL = """'Title: Untitled document' || chr(10) || 'Release: all'"""
_BODY_SQL = trim_sql(f"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace("text", chr(13) || {NL}, {NL}), '\\(', '('), '\\)', ')'), '</table>(\\|)', '</table>' || {NL} || '\\1', 'g'), '</table>([^\\s])', '</table>' || {NL} || {NL} || '\\1', 'g'), '\\n{{3,}}', {NL} || {NL}, 'g')""")


@query(f"""WITH src AS (SELECT doc_id, {PATH} AS source_path, sha1("text") AS content_hash, {_BODY_SQL} AS body FROM documents),
  {split_sql('body', f'greatest(256, 1792 - length({_TOPIC_SQL}) - 2)', 'src')}
  SELECT source_path, 'overview' AS chunk_type, CAST(unnest(range(0, len(part))) AS INTEGER) AS chunk_index, 'Untitled document' AS title, {_TOPIC_SQL} || CASE WHEN body = '' THEN '' ELSE {NL} || {NL} || unnest(part) END AS content, content_hash FROM parts JOIN src USING (doc_id)""")
def chunk_documents(spark, d):
    """The topic chunker over whole documents. (The SQL holds for texts without headings.)"""
    s = docs(spark, d).select(F.expr(PATH).alias("path"), F.sha1(F.encode("text", "UTF-8")).alias("blob_sha"), F.col("text").alias("content"))
    return chunk_rows(parse(s, "main", "all")).select("source_path", "chunk_type", "chunk_index", "title", "content", "content_hash")


def _concise_sql(c: str) -> str:
    """White space collapsed; at most 500 characters, cut at the last space if that leaves 250."""
    t = f"regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"
    at = f"(length(left({t}, 500)) - strpos(reverse(left({t}, 500)), ' '))"
    return f"CASE WHEN length({t}) <= 500 THEN {t} WHEN strpos(left({t}, 500), ' ') > 0 AND {at} >= 250 THEN trim(left({t}, CAST({at} AS BIGINT))) ELSE trim(left({t}, 500)) END"


_METHOD_HEAD = f"'Object: Rec' || {NL} || 'Method: run' || doc_id || {NL} || 'Signature: run' || doc_id || '(String x)' || {NL} || 'Release: all' || {NL} || 'Keywords: rec run' || doc_id || {NL}"
_PLAIN_SQL = f"'Text ' || replace(replace(\"text\", {NL}, ' '), '|', ' ')"


@query(f"""WITH t AS (SELECT doc_id, 'markdown/api-reference/server-api-reference/c_Rec' || doc_id || 'API.md' AS source_path, {_concise_sql(_PLAIN_SQL)} AS summary, source, lang FROM documents)
  SELECT source_path, 0 AS chunk_index, 'overview' AS chunk_type, NULL AS heading, 'Rec' || doc_id AS object_name, NULL AS method_name, 'Object: Rec' || doc_id || {NL} || 'Release: all' || {NL} || 'Summary: About it.' || {NL} || 'Keywords: rec' || doc_id AS content FROM t
  UNION ALL SELECT source_path, 1, 'method', 'run' || doc_id || '(String x)', 'Rec', 'run' || doc_id, {_METHOD_HEAD} || 'Summary: ' || summary FROM t
  UNION ALL SELECT source_path, 2, 'parameter', 'run' || doc_id || '(String x)', 'Rec', 'run' || doc_id, {_METHOD_HEAD} || 'Parameter: x: String. of ' || source FROM t
  UNION ALL SELECT source_path, 3, 'returns', 'run' || doc_id || '(String x)', 'Rec', 'run' || doc_id, {_METHOD_HEAD} || 'Returns: ' || lang || ': told' FROM t
  UNION ALL SELECT source_path, 4, 'example', 'run' || doc_id || '(String x)', 'Rec', 'run' || doc_id, {_METHOD_HEAD} || 'Example: code' || doc_id FROM t""")
def chunk_api_doc(spark, d):
    """The API chunker over a document with one method for each text, which is what the method's summary comes from."""
    plain = F.translate("text", "\n|", "  ")
    text = F.concat(
        F.concat(F.lit("---\ntitle: Rec"), "doc_id", F.lit("\n---\nAbout it.\n\n## Rec - run"), "doc_id", F.lit("(String x)\n\nText "), plain),
        F.concat(F.lit("\n\n|Name|Type|Description|\n|---|---|---|\n|x|String|of "), "source", F.lit("|\n\n<table><tr><th>Type</th><th>Description</th></tr><tr><td>"), "lang"),
        F.concat(F.lit("</td><td>told</td></tr></table>\n\n```js\ncode"), "doc_id", F.lit("\n```\n")),
    )
    s = docs(spark, d).select(F.concat(F.lit("markdown/api-reference/server-api-reference/c_Rec"), "doc_id", F.lit("API.md")).alias("path"), F.lit("sha").alias("blob_sha"), text.alias("content"))
    return chunk_rows(parse(s, "main", "all")).select("source_path", "chunk_index", "chunk_type", "heading", "object_name", "method_name", "content")


_HEAD = {k: " || chr(10) || ".join(["'Title: T'", *([f"'Section: {k}'"] if k else []), "'Product: ' || source", "'Release: all'"]) for k in ("", "One", "Two")}


@query(f"""WITH src AS (SELECT doc_id, source, {PATH} AS source_path, {_BODY_SQL} AS body FROM documents), {split_sql('body', f"greatest(256, 1792 - length({_HEAD['One']}) - 2)", 'src')},
  one AS (SELECT *, {_HEAD['One']} AS head FROM src JOIN parts USING (doc_id))
  SELECT source_path, 0 AS chunk_index, 'overview' AS chunk_type, NULL AS heading, {_HEAD['']} || {NL} || {NL} || '# T' || {NL} || {NL} || 'intro' AS content FROM src
  UNION ALL SELECT source_path, CAST(1 + unnest(range(0, len(part))) AS INTEGER), 'section', 'One', head || CASE WHEN body = '' THEN '' ELSE {NL} || {NL} || unnest(part) END FROM one
  UNION ALL SELECT source_path, CAST(1 + len(part) AS INTEGER), 'section', 'Two', {_HEAD['Two']} || {NL} || {NL} || 'second' FROM one""")
def chunk_topic_doc(spark, d):
    """The topic chunker over documents whose text stands in the first of two sections."""
    text = F.concat(F.lit("---\nproduct: "), "source", F.lit("\n---\n# T\n\nintro\n\n## One\n\n"), "text", F.lit("\n\n## Two\n\nsecond\n"))
    s = docs(spark, d).select(F.expr(PATH).alias("path"), F.lit("sha").alias("blob_sha"), text.alias("content"))
    return chunk_rows(parse(s, "main", "all")).select("source_path", "chunk_index", "chunk_type", "heading", "content")


@query(f"""WITH {LINES_SQL}, m AS (SELECT doc_id, string_agg({trim_sql('line')}, ' ' ORDER BY no) FILTER ({trim_sql('line')} <> '') AS meaning FROM lines GROUP BY doc_id)
  SELECT doc_id, 0 AS chunk_index, 'term ' || doc_id AS heading, coalesce(meaning, '') AS meaning FROM m UNION ALL SELECT doc_id, 1, 'second', 'its meaning' FROM m""")
def chunk_glossary(spark, d):
    """The glossary chunker: each text is the meaning of a term."""
    text = F.concat(F.lit("# G\n\n### term "), "doc_id", F.lit("\n"), "text", F.lit("\n\n### second\nits\nmeaning\n"))
    s = docs(spark, d).select(F.concat(F.lit("markdown/glossary/"), "doc_id", F.lit(".md")).alias("path"), F.lit("sha").alias("blob_sha"), text.alias("content"))
    c = chunk_rows(parse(s, "main", "all"))
    return c.select(F.regexp_extract("source_path", r"(\d+)", 1).cast("long").alias("doc_id"), "chunk_index", "heading", F.get_json_object("metadata", "$.definition").alias("meaning"))
