import json

import numpy as np
import pytest

from folio import cli
from folio.engine import Engine
from folio.functions.embedding import HashProvider
from folio.sources.index import IndexStore, stored_dimensions, stored_profile
from folio.sources.listing import read_tree
from folio.streaming.ingest import stream_tree

API = """---
title: Record API - Scoped
product: Platform
---
# Record API

Reads and writes records.

## Record - addFilter(String field, Object value)

Adds a filter to the query.

|Name|Type|Description|
|----|----|-----------|
|field|String|Name of the field|
|value|Object|Value to compare|

|Type|Description|
|----|-----------|
|Condition|The condition added|

```js
var r = new Record(); r.addFilter('active', true);
```
"""
TOPIC = "---\ntitle: Set up widgets\nproduct: Widgets\ntopic_type: task\n---\n# Set up widgets\n\nHow to configure widgets for a team.\n\n## Install\n\nInstall the widget package first.\n\n## Remove\n\nRemove the widget package again.\n"
PATHS = {"markdown/api-reference/server-api-reference/c_RecordAPI.md": API, "markdown/widgets/setup.md": TOPIC, "markdown/widgets/toc.md": "---\ntopic_type: toc\n---\n# Contents\n"}


def listing(spark, docs, shas=None):
    rows = [(p, (shas or {}).get(p, f"sha-{hash(t)}"), t) for p, t in docs.items()]
    return spark.createDataFrame(rows, "path string, blob_sha string, content string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index") / "i"))
    out = e.update(listing(spark, PATHS), "alpha")
    return e, out


def test_update_counts_sources_without_chunks_too(built):
    e, out = built
    assert (out["added"], out["changed"], out["deleted"], out["failures"]) == (3, 0, 0, [])
    assert out["chunks"] == 9  # 1 + method, 2 parameters, returns, example; overview and 2 sections; none
    assert e.status()["documents"] == 3


def test_unchanged_sources_are_left_alone(built, spark):
    e, _ = built
    again = e.update(listing(spark, PATHS), "alpha")
    assert (again["added"], again["changed"], again["chunks"]) == (0, 0, 0)


def test_search_finds_a_method_by_its_words(built):
    e, _ = built
    hits = e.search("record add filter", release="alpha", limit=5).collect()
    assert hits[0].object_name == "Record" and hits[0].method_name == "addFilter"
    assert [h["rank"] for h in hits] == list(range(1, len(hits) + 1))
    assert all(a.score >= b.score for a, b in zip(hits, hits[1:], strict=False))
    assert sum(h.source_path.endswith("c_RecordAPI.md") for h in hits) <= 3


def test_filters_and_threshold(built):
    e, _ = built
    assert {h.chunk_type for h in e.search("filter", chunk_type="parameter").collect()} <= {"parameter"}
    # A keyword hit stays however unlike it is.
    assert any(h.chunk_type == "parameter" for h in e.search("Name of the field", threshold=1.0, max_per_source=10).collect())
    for bad in ({"limit": 0}, {"limit": 51}, {"threshold": 2}, {"max_per_source": 11}, {"query": "  "}):
        with pytest.raises(ValueError):
            e.search(**({"query": "x"} | bad))


def test_reading(built):
    e, _ = built
    path = "markdown/widgets/setup.md"
    doc = e.get_document(path, "ALPHA")
    assert [c["chunk_index"] for c in doc] == [0, 1, 2] and doc[0]["content"].startswith("# Set up widgets") and "## Remove" in doc[0]["content"]
    assert [r.heading for r in e.get_outline(path).collect()] == [None, "Install", "Remove"]
    assert [(r.publication, r.document_count) for r in e.list_publications("alpha").collect()] == [("widgets", 1), ("api-reference", 1)]
    assert e.get_document("markdown/none.md") == []


def test_search_many_equals_search(built):
    e, _ = built
    many = e.search_many(["record add filter", "how to configure widgets"], limit=5).collect()
    for k, q in enumerate(["record add filter", "how to configure widgets"]):
        one = [(r.id, round(r.score, 9)) for r in e.search(q, limit=5).collect()]
        assert [(r.id, round(r.score, 9)) for r in sorted((m for m in many if m.query_id == k), key=lambda r: r["rank"])] == one


def test_two_releases_deletion_and_failures(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"), HashProvider(12))
    e.update(listing(spark, {"markdown/w/a.md": TOPIC, "markdown/w/b.md": "# B\n\nbeta"}), "one")
    e.update(listing(spark, {"markdown/w/a.md": TOPIC}), "two")
    both = e.search("widget package", limit=50, max_per_source=10).collect()
    single = e.search("widget package", limit=50, max_per_source=10, deduplicate_releases=True).collect()
    chunks = {(r.source_path, r.chunk_index) for r in both}
    assert len(both) > len(single) == len(chunks) == len({(r.source_path, r.chunk_index) for r in single})
    # Another release in the front matter fails as a whole, and the stored version stays.
    bad = listing(spark, {"markdown/w/a.md": TOPIC.replace("product:", "release: other\nproduct:"), "markdown/w/c.md": "# C\n\nnew"})
    out = e.update(bad, "one")
    assert (out["added"], out["changed"], out["deleted"]) == (1, 0, 1)
    assert [(f["source_path"], f["stage"]) for f in out["failures"]] == [("markdown/w/a.md", "embed")]
    assert [r.source_path for r in e.store.table("sources", "one").orderBy("source_path").collect()] == ["markdown/w/a.md", "markdown/w/c.md"]
    assert e.store.table("postings", "one").join(e.store.table("chunks", "one"), "id", "left_anti").isEmpty()


def test_a_failing_text_costs_only_its_source(spark, tmp_path):
    class Fussy(HashProvider):
        def embed(self, texts):
            if any("forbidden" in t for t in texts):
                raise RuntimeError("refused")
            return super().embed(texts)

    e = Engine(spark, str(tmp_path / "i"), Fussy(8))
    out = e.update(listing(spark, {"markdown/w/a.md": "# A\n\nfine", "markdown/w/b.md": "# B\n\nforbidden"}), "one")
    assert out["added"] == 1 and [(f["source_path"], f["stage"], f["error"]) for f in out["failures"]] == [("markdown/w/b.md", "embed", "refused")]


def test_limits_and_names_are_checked(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError):
        e.update(listing(spark, PATHS), "../x")
    with pytest.raises(ValueError):
        e.update(listing(spark, PATHS), "x", limit=0)
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "i"), oversample=65)
    out = e.update(listing(spark, PATHS), "x", limit=1)
    assert (out["discovered"], out["deleted"]) == (1, 0)


def test_another_provider_is_refused(spark, tmp_path):
    root = str(tmp_path / "i")
    Engine(spark, root).update(listing(spark, PATHS), "x")
    with pytest.raises(ValueError, match="dimensions"):
        Engine(spark, root, HashProvider(32))
    assert stored_dimensions(spark, root) == 64 and stored_profile(spark, root) is None and stored_dimensions(spark, root + "-none") is None
    store = IndexStore(spark, root)
    with pytest.raises(ValueError):
        store.reset()
    store.reset(yes=True)
    assert stored_dimensions(spark, root) is None


def write_tree(root, docs):
    for p, t in docs.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)


def test_tree_cli_and_stream(spark, tmp_path, capsys):
    tree = tmp_path / "tree"
    write_tree(tree, PATHS | {"markdown/widgets/index.md": "# no", "readme.txt": "no"})
    rows = read_tree(spark, str(tree)).collect()
    assert sorted(r.path for r in rows) == sorted(PATHS)
    args = cli.parser().parse_args(["--data-dir", str(tmp_path / "d"), "update", "--tree", str(tree), "--family", "alpha"])
    assert cli.run(args, spark)["added"] == 3
    args = cli.parser().parse_args(["--data-dir", str(tmp_path / "d"), "search", "record add filter", "--limit", "2"])
    found = cli.run(args, spark)
    assert len(found) == 2 and found[0]["method_name"] == "addFilter" and "metadata" not in found[0] and found[0]["source_url"].endswith("c_RecordAPI.md")
    assert cli.main(["--json", "search", "x", "--limit", "99"]) == 1
    assert "limit" in json.loads(capsys.readouterr().err)["error"]

    e = Engine(spark, str(tmp_path / "s"))
    q = stream_tree(e, str(tree), str(tmp_path / "c"), "alpha", files_per_batch=1)
    q.awaitTermination(120)
    assert e.status()["documents"] == 3


def counting_model(profile, dtype, threads):
    return lambda device: lambda texts: np.array([[len(t), *(t.count(c) for c in "abcdefg"), 1] + [0] * (profile.dimensions - 9) for t in texts], float)


def test_cli_providers(spark, tmp_path, monkeypatch):
    parse = lambda *a: cli.parser().parse_args([*a, "status"])
    p, name = cli.provider_for(parse())
    assert (p.name, p.dimensions, name) == ("deterministic-hash", 64, None) and cli.provider_for(parse(), None, 12)[0].dimensions == 12
    loader = f"{__name__}:counting_model"
    p, name = cli.provider_for(parse("--embedding-loader", loader, "--embedding-profile", "nomic-embed-text-v1.5", "--embedding-dimensions", "128", "--embedding-dtype", "q8", "--embedding-max-characters", "300"))
    assert (name, p.dimensions, p.dtype, p.max_characters, p.query_prefix) == ("nomic-embed-text-v1.5", 128, "q8", 300, "search_query: ")
    assert cli.provider_for(parse("--embedding-loader", loader), "all-minilm-l6-v2", 384)[0].dimensions == 384
    assert cli.provider_for(parse("--embedding-loader", loader, "--deterministic-embeddings"))[1] is None
    endpoint = ["--embedding-endpoint", "https://host/v1", "--embedding-endpoint-model", "m"]
    for bad, told in (
        (["--embedding-profile", "nomic-embed-text-v1"], "loader"),
        (["--embedding-loader", "nothing"], "MODULE:FUNCTION"),
        (["--embedding-loader", loader, "--embedding-dimensions", "9"], "dimensions"),
        (endpoint[:2], "together"),
        ([*endpoint, "--embedding-api-key-env", "not a name"], "name of an environment"),
        ([*endpoint, "--embedding-api-key-env", "NOT_SET_ANYWHERE"], "is not set"),
    ):
        with pytest.raises(ValueError, match=told):
            cli.provider_for(parse(*bad))
    monkeypatch.setenv("EMBEDDING_API_KEY", "k")
    p, _ = cli.provider_for(parse(*endpoint, "--embedding-loader", loader, "--embedding-endpoint-batch-size", "7", "--embedding-endpoint-timeout", "9"))
    assert (p.endpoint_model, p.api_key, p.batch_size, p.concurrency, p.timeout, p.dimensions, p.pooling) == ("m", "k", 7, 4, 9.0, 384, "mean")


def test_cli_with_a_model(spark, tmp_path):
    tree, d = tmp_path / "tree", str(tmp_path / "d")
    write_tree(tree, PATHS)
    own = lambda *a: cli.run(cli.parser().parse_args(["--data-dir", d, *a]), spark)
    loader = ["--embedding-loader", f"{__name__}:counting_model"]
    assert own(*loader, "update", "--tree", str(tree), "--family", "alpha")["added"] == 3
    assert len(own(*loader, "search", "record add filter", "--limit", "2", "--threshold", "-1")) == 2
    with pytest.raises(ValueError, match="provider"):
        own("search", "record")
    assert own("status")["documents"] == 3 and own("get", next(iter(PATHS)), "--family", "alpha")
    assert own("reset-index", "--yes") == {"reset": True}
