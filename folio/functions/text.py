"""Scalar functions on paths, titles, identifiers and Markdown fragments, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import API_PREFIXES, GLOSSARY_PREFIX, SUMMARY_BOUNDARY, SUMMARY_CHARACTERS, TOP_LEVEL_API, Collection

# (?U): white space by Unicode, as the reference's language has it.
BLANKS, TRIM = r"(?U)\s+", r"(?U)^\s+|\s+$"


def _any_prefix(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


def trim(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def included(path: Column, area: str = "scripting") -> Column:
    """Is the path a document of the area? index.md never is."""
    page = F.startswith(path, F.lit("markdown/")) & F.endswith(path, F.lit(".md")) & (F.element_at(F.split(path, "/"), -1) != "index.md")
    server, client = (F.startswith(path, F.lit(p)) for p in API_PREFIXES[:2])
    top, scripts = path.rlike(TOP_LEVEL_API), F.startswith(path, F.lit("markdown/api-reference/scripts/"))
    areas = {"all-docs": F.lit(True), "server": server, "client": client | top, "scripts": scripts}
    return page & areas.get(area, server | client | top | scripts)


def doc_type(path: Column) -> Column:
    """The first rule that holds names the type."""
    starts = lambda p: F.startswith(path, F.lit(p))
    return (
        F.when(starts(API_PREFIXES[3]), "rest-api")
        .when(_any_prefix(path, API_PREFIXES) | path.rlike(TOP_LEVEL_API), "scripting-api")
        .when(starts(GLOSSARY_PREFIX), "glossary")
        .when(starts("markdown/release-notes/"), "release-notes")
        .when(starts("markdown/api-reference/scripts/"), "scripting-guide")
        .when(starts("markdown/api-reference/"), "developer-guide")
        .otherwise("product-doc")
    )


def publication(path: Column) -> Column:
    return F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit(""))


def percent_encoded(c: Column) -> Column:
    """As URI components: spaces as %20; letters, digits and -_.!~*'() stay."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def raw_url(branch: Column, path: Column, collection: Collection = Collection()) -> Column:
    return F.concat(F.lit(collection.raw_base + "/"), percent_encoded(branch), F.lit("/"), F.array_join(F.transform(F.split(path, "/"), percent_encoded), "/"))


def content_hash(c: Column) -> Column:
    return F.sha1(F.encode(c, "UTF-8"))


def normalize_markdown(c: Column) -> Column:
    for pattern, to in (("\r\n", "\n"), (r"\\\(", "("), (r"\\\)", ")"), (r"</table>(?=\|)", "</table>\n"), (r"(?U)</table>(?=\S)", "</table>\n\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return trim(c)


def clean_cell(c: Column) -> Column:
    """Tags go before entities are decoded, so that decoded angle brackets stay."""
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return trim(F.regexp_replace(c, r"[ \t]+", " "))


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(clean_cell(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def pipe_cells(line: Column) -> Column:
    """Cells of a table row; one empty cell at either end goes."""
    cells = F.transform(F.split(line, r"\|", -1), clean_cell)
    cells = F.when(F.get(cells, F.lit(0)) == "", F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells)
    return F.when((F.size(cells) > 0) & (F.element_at(F.concat(F.array(F.lit("-")), cells), -1) == ""), F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells)


def concise(c: Column) -> Column:
    """White space collapsed; at most 500 characters, cut at the last space if that leaves 250."""
    c = trim(F.regexp_replace(c, BLANKS, " "))
    head = F.substring(c, 1, SUMMARY_CHARACTERS)
    at = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last space
    cut = F.when((F.instr(head, " ") > 0) & (at >= SUMMARY_BOUNDARY), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= SUMMARY_CHARACTERS, c).otherwise(trim(cut))


def extract_title(body: Column, front_title: Column, collection: Collection = Collection()) -> Column:
    first = trim(F.regexp_extract(body, r"(?m)^# (.*)$", 1))
    return F.coalesce(blank_to_null(front_title), blank_to_null(first), F.lit(collection.fallback_title))


_DEPRECATED_END = r"(?iU)\s*\(deprecated\)\s*$"


def object_name(title: Column, path: Column, kind: Column) -> Column:
    bare = lambda c: trim(F.regexp_replace(c, _DEPRECATED_END, ""))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    name = F.regexp_replace(name, r"^[crp]_", "")
    name = bare(F.when(kind == "rest-api", name).otherwise(F.regexp_replace(name, r"(?i)(?:API|Scoped|Global)$", "")))
    return F.when(F.contains(title, F.lit(" - ")), bare(F.substring_index(title, " - ", 1))).otherwise(F.coalesce(blank_to_null(name), bare(title)))


def scopes(title: Column, body: Column) -> Column:
    found = F.regexp_extract_all(F.concat(title, F.lit("\n"), F.substring(body, 1, 1000)), F.lit(r"(?i)(?<!\w)(global|scoped)(?!\w)"), F.lit(1))
    return F.array_distinct(F.transform(found, F.initcap))


def is_parameter_table(headers: Column) -> Column:
    return F.array_contains(headers, "name") & F.array_contains(headers, "type") & F.array_contains(headers, "description")


def is_return_table(headers: Column) -> Column:
    return F.array_contains(headers, "description") & F.arrays_overlap(headers, F.array(F.lit("type"), F.lit("property"), F.lit("properties")))


def overlap_tail(c: Column, limit: int = 200) -> Column:
    tail = F.right(c, F.lit(limit))
    return F.when(F.length(c) <= limit, c).when(F.instr(tail, " ") == 0, tail).otherwise(F.substring(tail, F.instr(tail, " ") + 1, F.lit(limit)))


def identifier_terms(c: Column) -> Column:
    """Words of camel-case and acronym identifiers, lower-cased."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    c = F.regexp_replace(c, r"([a-z\d])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+"), F.lit(0))


def identifier_keywords(*names: Column) -> Column:
    return F.array_join(F.array_distinct(identifier_terms(F.concat_ws(" ", *(blank_to_null(n) for n in names)))), " ")


def api_content(label: str, obj: Column, method: Column, signature: Column, release: Column, detail: Column | None = None) -> Column:
    """The lines that head an API chunk; empty ones are left out."""
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws(
        "\n", F.concat(F.lit("Object: "), obj), line("Method", method), line("Signature", signature), F.concat(F.lit("Release: "), release),
        *([line(label, detail)] if detail is not None else []), F.concat(F.lit("Keywords: "), identifier_keywords(obj, method)),
    )


def examples(section: Column) -> Column:
    found = F.regexp_extract_all(section, F.lit(r"```[\w+-]*\n([\s\S]*?)\n```"), F.lit(1))
    return F.filter(F.transform(found, trim), lambda x: x != "")


def deprecated(title: Column) -> Column:
    return normalize_markdown(title).rlike(r"(?iU)\(\s*deprecated\s*\)")


def method_name(signature: Column) -> Column:
    return trim(F.substring_index(F.replace(signature, F.lit("\\("), F.lit("(")), "(", 1))


def stored_metadata(metadata: Column) -> Column:
    """JSON of a map without the two keys that hold whole bodies."""
    return F.to_json(F.map_filter(metadata, lambda k, _: ~k.isin("full_content", "section_content")))


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.octet_length(c) / 2)).cast("long")


def embedding_text(c: Column, most: int | None) -> Column:
    """Cut to `most` characters (code points, so never inside one); no limit if it is not positive."""
    return c if most is None or most <= 0 else F.substring(c, 1, most)
