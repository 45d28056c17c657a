"""Markdown documents into typed chunks: the procedural part of ingestion, which runs in Arrow batches on the executors.

A document is outlined once: `outline` finds headings outside code fences and gives each the lines up to the next. The three
document kinds then differ in their heading rule and in what a section turns into.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

import yaml

from ..config import API_PREFIXES, CHUNK_CHARACTERS, CHUNK_FLOOR, GLOSSARY_PREFIX, OVERLAP, SUMMARY_BOUNDARY, SUMMARY_CHARACTERS, TOP_LEVEL_API, Collection

METHOD_HEADING = re.compile(r"^##\s+(.+?)(?:\s+[-–—]\s*|\s*[-–—]\s+)(.+?)\s*$")
DEPRECATED_END = re.compile(r"\s*\(deprecated\)\s*$", re.I)
FENCED = re.compile(r"```[A-Za-z0-9_+-]*\n([\s\S]*?)\n```")
FRONT = re.compile(r"^---\s*\n([\s\S]*?)\n---\s*\n")
FIELDS = ("doc_type", "publication", "source_path", "release", "chunk_type", "chunk_index", "title", "heading", "content", "topic_type", "product", "classification", "last_updated", "object_name", "method_name", "metadata", "content_hash")


class _Loader(yaml.SafeLoader):
    """Scalars as YAML 1.2 has them: dates and yes/no words stay text."""


_Loader.yaml_implicit_resolvers = {k: [(tag, rx) for tag, rx in v if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def _yaml(text: str) -> Any:
    return yaml.load(text, _Loader)  # noqa: S506  a safe loader


def _loose_value(raw: str) -> Any:
    if not raw:
        return ""
    if raw[0] in "[{\"'" or re.fullmatch(r"true|false|null|-?\d+(\.\d+)?", raw, re.I):
        try:
            return _yaml(raw)
        except yaml.YAMLError:
            quoted = re.fullmatch(r"([\"'])(.*)\1", raw)
            return quoted[2] if quoted else raw
    return raw


def parse_frontmatter(markdown: str) -> tuple[dict[str, Any], str]:
    """The fields before the body and the body. Fields that are no YAML are read line by line."""
    m = FRONT.match(markdown)
    if not m:
        return {}, markdown
    try:
        fields = _yaml(m[1])
    except yaml.YAMLError:
        pairs = (re.match(r"^([A-Za-z0-9_]+):\s*(.*)$", x) for x in m[1].split("\n"))
        fields = {p[1]: _loose_value(p[2].strip()) for p in pairs if p}
    return (fields if isinstance(fields, dict) else {}), markdown[m.end() :]


def normalize(markdown: str) -> str:
    out = markdown.replace("\r\n", "\n").replace("\\(", "(").replace("\\)", ")")
    out = re.sub(r"</table>(?=\|)", "</table>\n", out)
    out = re.sub(r"</table>(?=\S)", "</table>\n\n", out)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def text_of(value: Any) -> str:
    return value if isinstance(value, str) else ""


def doc_type(path: str) -> str:
    if path.startswith(API_PREFIXES[3]):
        return "rest-api"
    if is_api(path):
        return "scripting-api"
    rules = {GLOSSARY_PREFIX: "glossary", "markdown/release-notes/": "release-notes", "markdown/api-reference/scripts/": "scripting-guide", "markdown/api-reference/": "developer-guide"}
    return next((kind for prefix, kind in rules.items() if path.startswith(prefix)), "product-doc")


def is_api(path: str) -> bool:
    return path.startswith(API_PREFIXES) or re.match(TOP_LEVEL_API, path) is not None


def clean_cell(cell: str) -> str:
    out = re.sub(r"<[^>]+>", " ", cell)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = out.replace(entity, char)
    return re.sub(r"[ \t]+", " ", out).strip()


def header_key(cell: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", clean_cell(cell).lower()).strip("_")


def pipe_cells(line: str) -> list[str]:
    cells = [clean_cell(x) for x in line.split("|")]
    lo = 1 if cells and cells[0] == "" else 0
    hi = len(cells) - 1 if len(cells) > lo and cells[-1] == "" else len(cells)
    return cells[lo:hi]


Table = tuple[list[str], list[dict[str, str]]]


def pipe_tables(section: str) -> Iterator[Table]:
    """(headers, rows) of the tables drawn with bars; rows with another number of cells than the header are left out."""
    lines = section.split("\n")
    at = 0
    while at < len(lines) - 2:
        head, rule = lines[at : at + 2]
        if "|" not in head or not rule or not re.match(r"^\s*\|?[\s:|-]+\|?\s*$", rule):
            at += 1
            continue
        keys = [header_key(x) for x in pipe_cells(head)]
        end = next((k for k in range(at + 2, len(lines)) if "|" not in lines[k]), len(lines))
        rows = [dict(zip(keys, cells, strict=True)) for cells in map(pipe_cells, lines[at + 2 : end]) if len(cells) == len(keys)]
        if rows:
            yield keys, rows
        at = end


def html_tables(section: str) -> Iterator[Table]:
    """Tables in HTML; a row that begins with a header cell sets the keys of the rows after it."""
    for table in re.finditer(r"<table\b[^>]*>([\s\S]*?)</table>", section, re.I):
        keys: list[str] = []
        rows = []
        for row in re.finditer(r"<tr\b[^>]*>([\s\S]*?)</tr>", table[1], re.I):
            cells = [(m[1].lower(), m[2]) for m in re.finditer(r"<(th|td)\b[^>]*>([\s\S]*?)</\1>", row[1], re.I)]
            if cells and cells[0][0] == "th":
                keys = [header_key(x) for _, x in cells]
            elif cells and keys:
                values = [clean_cell(x) for _, x in cells]
                rows.append({k: values[i] if i < len(values) else "" for i, k in enumerate(keys)})
        if rows:
            yield keys, rows


def is_parameter_table(keys: list[str]) -> bool:
    return {"name", "type", "description"} <= set(keys)


def is_return_table(keys: list[str]) -> bool:
    return "description" in keys and not {"type", "property", "properties"}.isdisjoint(keys)


def concise(text: str) -> str:
    flat = re.sub(r"\s+", " ", text).strip()
    if len(flat) <= SUMMARY_CHARACTERS:
        return flat
    cut = flat.rfind(" ", 0, SUMMARY_CHARACTERS)
    return flat[: cut if cut >= SUMMARY_BOUNDARY else SUMMARY_CHARACTERS].strip()


def _first_run(lines: Iterator[str | None]) -> str:
    """The first lines in a row that count, joined; None is a line that doesn't."""
    run: list[str] = []
    for x in lines:
        if x is not None:
            run.append(x)
        elif run:
            break
    return " ".join(run)


def first_paragraph(body: str) -> str:
    lines = (x.strip() for x in body.split("\n"))
    return _first_run(None if not x or x.startswith(("#", "-", "|", "```")) else x for x in lines)[:SUMMARY_CHARACTERS]


def summarize_method(body: str) -> str:
    """The first paragraph that stands outside fences, HTML blocks, lists, tables and headings. Fences and the inside of
    HTML blocks are passed over without ending a paragraph."""

    def lines():
        fenced, block = False, None
        for x in map(str.strip, body.split("\n")):
            if x.startswith("```"):
                fenced = not fenced
            elif fenced:
                continue
            elif block:
                block = None if re.search(f"</{block}>", x, re.I) else block
            else:
                m = re.match(r"<(table|div|section|aside|details|ul|ol|dl|pre)\b", x, re.I)
                if m and not re.search(f"</{m[1]}>", x, re.I):
                    block = m[1].lower()
                yield None if not x or x[0] in "#<" or "|" in x or re.match(r"[-*+](\s|$)", x) else x

    return concise(_first_run(lines()))


def object_name(title: str, path: str, kind: str) -> str:
    bare = lambda x: DEPRECATED_END.sub("", x).strip()
    if " - " in title:
        return bare(title.split(" - ")[0])
    file = path.rstrip("/").rsplit("/", 1)[-1]
    stem = file[: file.rfind(".")] if file.rfind(".") > 0 else file
    stem = re.sub(r"^[crp]_", "", stem)
    if kind != "rest-api":
        stem = re.sub(r"(?:API|Scoped|Global)$", "", stem, flags=re.I)
    return bare(stem) or bare(title)


def scopes(title: str, body: str) -> list[str]:
    found = re.findall(r"\b(global|scoped)\b", f"{title}\n{body[:1000]}", re.I | re.A)
    return list(dict.fromkeys(x.capitalize() for x in found))


def fence_mask(lines: list[str]) -> list[bool]:
    """Is the line in a code fence? The fence's own lines are."""
    out, inside = [], False
    for x in lines:
        mark = x.strip().startswith("```")
        out.append(mark or inside)
        inside ^= mark
    return out


def split_line(line: str, most: int) -> list[str]:
    out, rest = [], line.strip()
    while len(rest) > most:
        cut = rest.rfind(" ", 0, most + 1)
        cut = cut if cut >= most // 2 else most
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [*out, rest] if rest else out


def overlap_tail(text: str, limit: int = OVERLAP) -> str:
    if len(text) <= limit:
        return text
    tail = text[-limit:]
    return tail[tail.find(" ") + 1 :]


def split_text(body: str, most: int = CHUNK_CHARACTERS) -> list[str]:
    """Parts of at most `most` characters at paragraphs, else lines, else spaces; each after the first begins with the end
    of the one before it."""
    budget = max(CHUNK_FLOOR, most - OVERLAP)
    blocks = [b for b in (x.strip() for x in re.split(r"\n{2,}", body)) if b]
    pieces = [p for b in blocks for p in ([b] if len(b) <= budget else [q for line in b.split("\n") for q in split_line(line, budget)])]
    packed: list[str] = []
    for p in pieces:
        if packed and len(packed[-1]) + 2 + len(p) <= budget:
            packed[-1] += "\n\n" + p
        else:
            packed.append(p)
    if len(packed) < 2:
        return packed or [""]
    tails = [overlap_tail(x) for x in packed[:-1]]
    return [packed[0], *(f"{t}\n\n{x}"[:most] if t else x for t, x in zip(tails, packed[1:], strict=True))]


def split_topic(prefix: str, body: str, most: int = CHUNK_CHARACTERS) -> list[str]:
    gap = "\n\n" if body.strip() else ""
    return [f"{prefix}{gap}{x}" if x else prefix for x in split_text(body, max(CHUNK_FLOOR, most - len(prefix) - len(gap)))]


def keywords(*names: str | None) -> str:
    joined = " ".join(n for n in names if n)
    joined = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", joined)
    joined = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", joined)
    return " ".join(dict.fromkeys(re.findall(r"[a-z0-9_]+", joined.lower())))


def api_content(label: str, obj: str, method: str | None, signature: str | None, release: str, detail: str | None = None) -> str:
    lines = {"Method": method, "Signature": signature, "Release": release, label: detail}
    body = [f"{k}: {v}" for k, v in lines.items() if v or k == "Release"]
    return "\n".join([f"Object: {obj}", *body, f"Keywords: {keywords(obj, method)}"])


def split_api(label: str, obj: str, method: str | None, signature: str | None, release: str, detail: str, most: int = CHUNK_CHARACTERS) -> list[str]:
    prefix = f"{api_content(label, obj, method, signature, release)}\n{label}: "
    return [prefix + x for x in split_text(detail, max(CHUNK_FLOOR, most - len(prefix)))]


def examples(section: str) -> list[str]:
    return [x for x in (m[1].strip() for m in FENCED.finditer(section)) if x]


def outline(lines: list[str], match: Callable[[str], Any]) -> tuple[int, list[tuple[Any, int, int]]]:
    """Where the first heading is (or the end), and for each heading outside fences: what `match` gives, its line, the end."""
    found = [(m, k) for k, (x, fenced) in enumerate(zip(lines, fence_mask(lines), strict=True)) if not fenced and (m := match(x.strip())) is not None]
    ends = [k for _, k in found[1:]] + [len(lines)]
    return (found[0][1] if found else len(lines)), [(m, k, e) for (m, k), e in zip(found, ends, strict=False)]


class Document:
    """A parsed source and the columns that all its chunks share."""

    def __init__(self, path: str, markdown: str, branch: str, family: str, most: int, collection: Collection):
        self.path, self.branch, self.family, self.most, self.collection = path, branch, family, most, collection
        self.front, raw = parse_frontmatter(markdown)
        self.body = normalize(raw)
        self.lines = self.body.split("\n")
        heading = next((x[2:].strip() for x in self.lines if x.startswith("# ")), "")
        self.title = text_of(self.front.get("title")) or heading or collection.fallback_title
        self.release = text_of(self.front.get("release")) or family
        self.kind = doc_type(path)
        self.hash = hashlib.sha1(markdown.encode(), usedforsecurity=False).hexdigest()
        segments = path.split("/")
        self.publication = segments[1] if len(segments) > 1 else ""
        self.url = "/".join([collection.raw_base, *(quote(x, safe="-_.!~*'()") for x in (branch, *segments))])

    def field(self, name: str) -> str | None:
        return text_of(self.front.get(name)) or None

    def span(self, lo: int, hi: int) -> str:
        return "\n".join(self.lines[lo:hi]).strip()

    def chunk(self, **own: Any) -> dict[str, Any]:
        shared = {"doc_type": self.kind, "publication": self.publication, "source_path": self.path, "release": self.release, "title": self.title, "heading": None, "topic_type": None, "product": self.field("product"), "classification": self.field("classification"), "last_updated": self.field("last_updated"), "object_name": None, "method_name": None, "content_hash": self.hash}
        return shared | own


def _api_chunks(d: Document) -> Iterator[dict[str, Any]]:
    name = object_name(d.title, d.path, d.kind)
    first, methods = outline(d.lines, lambda x: (m[1].strip(), m[2].strip()) if (m := METHOD_HEADING.match(x)) else None)
    base = d.front | {"title": d.title, "release": d.release, "family": d.family, "branch": d.branch, "source_path": d.path, "url": d.url, "deprecated": re.search(r"\(\s*deprecated\s*\)", normalize(d.title), re.I) is not None, "object_name": name, "scopes": scopes(d.title, d.body)}
    about = concise(text_of(d.front.get("description"))) or first_paragraph(d.span(0, first))
    yield d.chunk(chunk_type="overview", content=api_content("Summary", name, None, None, d.release, about), object_name=name, metadata=base | {"full_content": d.body})
    for (obj, signature), lo, hi in methods:
        section = d.span(lo, hi)
        method = signature.replace("\\(", "(").split("(")[0].strip()
        summary = summarize_method("\n".join(d.lines[lo + 1 : hi]))
        tables = [*pipe_tables(section), *html_tables(section)]
        params = [r for keys, rows in tables if is_parameter_table(keys) for r in rows]
        returns = [r for keys, rows in tables if not is_parameter_table(keys) and is_return_table(keys) for r in rows]
        code = examples(section)
        about = base | {"object_name": obj, "method_name": method, "method_signature": signature, "summary": summary, "parameters": params, "returns": returns, "examples": code, "examples_count": len(code)}
        details: list[tuple[str, str, str, dict]] = [("endpoint" if d.kind == "rest-api" else "method", "Summary", summary, {"full_content": section})]
        details += [("parameter", "Parameter", f"{p['name']}: {p['type']}. {p.get('description', '')}".strip(), {"parameter": p}) for p in params]
        details += [("returns", "Returns", f"{next((r[k] for k in ('type', 'property', 'properties') if k in r), '')}: {r.get('description', '')}".strip(), {"return": r}) for r in returns]
        details += [("example", "Example", x, {"example": x, "example_index": k}) for k, x in enumerate(code, 1)]
        for kind, label, detail, extra in details:
            parts = split_api(label, obj, method, signature, d.release, detail, d.most)
            for k, content in enumerate(parts, 1):
                part = {"chunk_part": k} if len(parts) > 1 else {}
                yield d.chunk(chunk_type=kind, heading=signature, content=content, object_name=obj, method_name=method, metadata=about | extra | part | {"section": kind})


def _topic_chunks(d: Document) -> Iterator[dict[str, Any]]:
    if d.front.get("topic_type") == "toc":
        return
    meta = d.front | {"title": d.title, "release": d.release, "family": d.family, "branch": d.branch, "publication": d.publication, "source_path": d.path, "url": d.url}
    first, sections = outline(d.lines, lambda x: x[3:].strip() if x.startswith("## ") else None)

    def head(section: str | None = None) -> str:
        lines = {"Title": d.title, "Section": section, "Product": d.field("product"), "Release": d.release}
        return "\n".join(f"{k}: {v}" for k, v in lines.items() if v or k in ("Title", "Release"))

    for content in split_topic(head(), d.span(0, first), d.most):
        yield d.chunk(chunk_type="overview", content=content, topic_type=d.field("topic_type"), metadata=meta | {"full_content": d.body})
    for name, lo, hi in sections:
        for content in split_topic(head(name), d.span(lo + 1, hi), d.most):
            yield d.chunk(chunk_type="section", heading=name, content=content, topic_type=d.field("topic_type"), metadata=meta | {"section_content": d.span(lo, hi)})


def _glossary_chunks(d: Document) -> Iterator[dict[str, Any]]:
    product = d.collection.glossary_product
    shared = {"doc_type": "glossary", "topic_type": "reference", "product": product, "classification": "glossary"}
    where = {"source_path": d.path, "url": d.url, "release": d.release, "family": d.family}
    _, terms = outline(d.lines, lambda x: x[4:].strip() if x.startswith("### ") else None)
    if not terms:
        yield d.chunk(**shared, chunk_type="overview", content=f"Title: {d.title}\nProduct: {product}\nRelease: {d.release}\n\n{d.body}", metadata=where | {"full_content": d.body})
    for term, lo, hi in terms:
        words = (x.strip() for x in d.lines[lo + 1 : hi])
        meaning = " ".join(x for x in words if x and not x.startswith("## "))
        yield d.chunk(**shared, chunk_type="definition", heading=term, content=f"Term: {term}\nDefinition: {meaning}\nProduct: {product}\nRelease: {d.release}", metadata={"term": term, "definition": meaning} | where)


def chunk_document(path: str, markdown: str, branch: str, family: str, most: int = CHUNK_CHARACTERS, collection: Collection = Collection()) -> list[dict[str, Any]]:
    """The chunks of a document, in order; chunk_index is the place."""
    d = Document(path, markdown, branch, family, most, collection)
    rule = _api_chunks if is_api(path) else _glossary_chunks if path.startswith(GLOSSARY_PREFIX) else _topic_chunks
    return [c | {"chunk_index": k} for k, c in enumerate(rule(d))]


def metadata_json(metadata: dict[str, Any]) -> str:
    return json.dumps({k: v for k, v in metadata.items() if k not in ("full_content", "section_content")}, ensure_ascii=False, default=str, separators=(",", ":"))
