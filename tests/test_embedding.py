import json

import numpy as np
import pytest

from folio.functions import embedding as e
from folio.sources import listing


def test_batches_profiles_and_small_helpers():
    assert e.batches(["ccc", "a", "bb", "dddd"], 2) == [[1, 2], [0, 3]] and e.batches(["ccc", "a"], 5, by_length=False) == [[0, 1]]
    assert e.batches(["aaaa", "bbbb", "cc"], 9, True, 3) == [[2, 0], [1]]
    with pytest.raises(ValueError):
        e.batches(["a" * 50], 2, True, 10)
    assert e.truncate("abcdef", 3) == "abc" and e.truncate("abc", 0) == "abc" and e.truncate("abc", None) == "abc" and e.truncate("a😀b", 2) == "a😀"
    assert e.token_estimate("") == 1 and e.token_estimate("abc") == 2
    assert e.profile("nomic-embed-text-v1.5", 256).dimensions == 256 and e.profile(e.DEFAULT_PROFILE).dimensions == 384
    for bad in (("nope", None), ("bge-base-en-v1.5", 64), ("nomic-embed-text-v1.5", 32)):
        with pytest.raises(ValueError):
            e.profile(*bad)
    assert e.chunk_budget(1024) == 768 and e.chunk_budget(2048) == 1792 and e.chunk_budget(None) == 1792
    with pytest.raises(ValueError, match="input 1"):
        e.HashProvider().embed(["x", " "])


def test_layer_norm_slice_and_unit_length():
    v = e.finish(np.array([[1.0, 2, 3, 4], [0, 0, 0, 0]]), 2, True)
    assert v.shape == (2, 2) and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[1].any()


def test_model_halves_batches_and_falls_back():
    seen = []

    def load(device):
        def run(texts):
            seen.append((device, len(texts)))
            if device == "gpu":
                raise RuntimeError("device has been removed")
            if len(texts) > 1:
                raise RuntimeError("CUDA out of memory")
            return np.array([[len(t), 1.0, 0.0] for t in texts])

        return run

    p = e.ModelProvider(e.Profile("m", 2, "mean", False, "d: ", "q: ", 6), load, device="gpu", batch_size=2)
    v = p.embed(["aaaaa", "b"])
    assert len(v) == 2 and v[0][0] > v[1][0] and p.metrics.batch_splits == 1 and p.metrics.device_transitions == 1 and p.metrics.truncations == 1
    assert seen[0] == ("gpu", 2) and p.embed_query("x").shape == (2,)


def endpoint(answers, **kw):
    calls, waits = [], []

    def transport(url, headers, body, timeout):
        calls.append(body["input"])
        a = answers(body["input"], len(calls))
        if isinstance(a, Exception):
            raise a
        status, headers, payload = a
        return status, headers, payload if isinstance(payload, bytes) else json.dumps(payload).encode()

    p = e.EndpointProvider("https://host/v1", "m", 2, e.HashProvider(2), transport=transport, sleep=waits.append, **kw)
    return p, calls, waits


def good(texts, _):
    return 200, {}, {"data": [{"index": k, "embedding": [float(len(t)), 1.0, 9.0]} for k, t in reversed(list(enumerate(texts)))]}


def test_endpoint_orders_by_index_and_batches():
    p, calls, _ = endpoint(good, batch_size=2, document_prefix="d: ")
    v = p.embed(["a", "bbb", "cc"])
    assert sorted(map(len, calls)) == [1, 2] and calls[0][0].startswith("d: ") and v[1][0] > v[2][0] > v[0][0] and abs(np.linalg.norm(v[0]) - 1) < 1e-6
    assert p.embed_query("x").shape == (2,)


@pytest.mark.parametrize("data", [[], [{"embedding": [1.0]}], [{"embedding": [0.0, 0.0]}], [{"index": 3, "embedding": [1.0, 1.0]}], [{"embedding": [float("inf"), 1.0]}]])
def test_endpoint_refuses_bad_answers(data):
    p, _, _ = endpoint(lambda *_: (200, {}, {"data": data}))
    with pytest.raises(ExceptionGroup):
        p.embed(["a"])


def test_endpoint_retries_and_limits():
    p, calls, waits = endpoint(lambda t, n: (429, {"retry-after": "3"}, {"error": {"message": "slow"}}) if n == 1 else (503, {}, {}) if n == 2 else good(t, n))
    p.embed(["a"])
    assert waits == [3.0, 2.0] and p.metrics.retries == 2
    p, calls, waits = endpoint(lambda t, n: OSError("down"))
    with pytest.raises(ExceptionGroup):
        p.embed(["a"])
    assert len(calls) == 2
    p, calls, _ = endpoint(lambda t, n: (401, {}, {}))
    with pytest.raises(ExceptionGroup):
        p.embed(["a"])
    assert len(calls) == 1
    for bad in ("http://host/x", "https://user@host/x", "https://host/x?k=1"):
        with pytest.raises(ValueError):
            e.EndpointProvider(bad, "m", 2, e.HashProvider(2))


def test_endpoint_shortens_what_is_too_long():
    def answer(texts, n):
        if sum(map(len, texts)) > 30:
            return 400, {}, {"error": {"message": "You passed 100 input tokens but the context length is only 58 tokens"}}
        return good(texts, n)

    p, calls, _ = endpoint(answer, concurrency=1)
    assert len(p.embed(["x" * 40, "y" * 20])) == 2
    assert p.metrics.batch_splits == 1 and p.metrics.truncations >= 1 and len(calls[-1][0]) <= 30


def test_fetch_retries_like_the_listing_needs():
    waits = []
    answers = iter([(503, {}, b""), (429, {"retry-after": "2"}, b""), (200, {}, b"ok")])
    assert listing.fetch("u", "x", get=lambda *_: next(answers), sleep=waits.append) == b"ok" and waits == [0.5, 2.0]
    calls = []
    with pytest.raises(RuntimeError, match="after 1 attempt"):
        listing.fetch("u", "x", get=lambda *_: calls.append(1) or (404, {}, b""), sleep=waits.append)
    assert len(calls) == 1 and listing.retry_delay(None, 9, 0.5) == 8.0


def test_remote_listing_and_download(spark):
    tree = {"tree": [{"path": "markdown/a/b.md", "sha": "1", "type": "blob"}, {"path": "markdown/a/index.md", "sha": "2", "type": "blob"}, {"path": "markdown/a", "sha": "3", "type": "tree"}]}
    df = listing.remote_listing(spark, "u", get=lambda *_: (200, {}, json.dumps(tree).encode()))
    assert [(r.path, r.blob_sha) for r in df.collect()] == [("markdown/a/b.md", "1")]
    with pytest.raises(RuntimeError, match="truncated"):
        listing.remote_listing(spark, "u", get=lambda *_: (200, {}, b'{"truncated": true}'))
    got = listing.download(df, lambda p: p, get=lambda u, t: (404, {}, b"") if "x" in u else (200, {}, u.encode())).collect()
    assert got[0].content == "markdown/a/b.md" and got[0].error is None
    with pytest.raises(ValueError):
        listing.download(df, str, concurrency=65)


def test_git_checkout(spark, tmp_path):
    import subprocess

    def git(*a):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.invalid", *a], cwd=tmp_path / "o", check=True, capture_output=True)

    f = tmp_path / "o/markdown/p/a.md"
    f.parent.mkdir(parents=True)
    f.write_text("# a\n")
    git("init", "-q", "-b", "main")
    git("add", ".")
    git("commit", "-qm", "x")
    c1 = listing.git_sync(f"file://{tmp_path}/o", "main", str(tmp_path / "c"))
    rows = listing.git_listing(spark, str(tmp_path / "c")).collect()
    tree = listing.read_tree(spark, str(tmp_path / "c")).collect()
    assert [(r.path, r.blob_sha) for r in rows] == [(r.path, r.blob_sha) for r in tree]
    f.write_text("# b\n")
    git("commit", "-qam", "y")
    assert listing.git_sync(f"file://{tmp_path}/o", "main", str(tmp_path / "c")) != c1


def test_batches_that_go_well_are_kept_when_others_fail(spark):
    from folio.plans import ingest

    p, calls, _ = endpoint(lambda t, n: (400, {}, {"error": {"message": "refused"}}) if "bad" in t else good(t, n), batch_size=2, concurrency=1)
    vectors, lost = p.embed_some(["a", "b", "bad", "c", "d"])
    assert [v is None for v in vectors] == [False, False, True, True, False] and set(lost) == {2, 3} and len(calls) == 3

    class Counting:
        name = model = "x"
        dimensions = 2

        def __init__(self):
            self.metrics = e.Metrics()

        def embed(self, texts):
            self.metrics.requests += 1
            if "bad" in texts:
                raise ValueError("bad")
            return [np.ones(2, np.float32) for _ in texts]

    counters = ingest.metric_counters(spark)
    d = spark.createDataFrame([("a",), ("bad",), ("c",)], "content string").coalesce(1)
    got = {r.content: (r.embedding, r.error) for r in ingest.embed(d, Counting(), counters=counters).collect()}
    assert got["bad"] == (None, "bad") and got["a"] == ([1.0, 1.0], None) and got["c"][1] is None
    assert counters["requests"].value == 4 and counters["retries"].value == 0
