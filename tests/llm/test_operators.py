"""The operators against plain Python over small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import common, components, decontaminate, grams, kneser_ney, line_dedup, mixing, near_dedup, ppm, quality, records, sharding, stages, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, component int, shard string, _group int, key string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["ba", "ko", "ti", "ru", "Né", "so", "lo", "mi"]


def words(r, n):
    return ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n)]


def text(r, n):
    return " ".join(w + r.choice(["", "", "", ",", ".\n"]) for w in words(r, n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(k, text(r, r.randint(0, 120))) for k in range(60)]
    base = text(r, 200)
    for k in range(60, 75):  # near copies of one text, and of each other
        w = base.split(" ")
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = "zz" + str(r.randint(0, 9))
        out.append((k, " ".join(w)))
    out += [(k, base) for k in range(75, 90)]
    out += [(90, None), (91, ""), (92, " \n\t"), (93, "one two three"), (94, "One two  three"), (95, "a\n" * 5 + base), (96, text(r, 6000)), (97, "nul\0 and \x1f   wide   <|endoftext|> 😀..,,  x\r\n"), (98, "same line that repeats here\nX\nsame line that repeats here"), (99, "\tSame line that repeats HERE \nY")]
    out += [out[3], (3, out[3][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, None if i == 7 else f"s{(i or 0) % 3 if (i or 0) < 50 else 'hot'}", len(t or ""), "x", 1, "y", 2, "k") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


# --- 1 ------------------------------------------------------------------------------------------------------------------


def leaks(rows, items):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    cut = lambda t: find((t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    for d, t in rows:
        w, hit, ids = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        yield d, len(w), len(hit), len(ids), tuple(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, docs, rows, block):
    base = rows[75][1].split(" ")
    items = [(1, " ".join(base[10:50])), (2, "one, TWO three"), (3, None), (4, "..."), (5, " ".join(base[30:45])), (5, "ko"), (6, "not in any text at all")]
    b = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, words string")
    got = decontaminate.decontaminate(docs, b, block=block)
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in got.collect())
    assert got == collections.Counter(leaks(rows, items)) and any(k[5] for k in got)
    kept = decontaminate.clean(docs, b)
    assert kept.columns == docs.columns and counted(kept, "doc_id", "text") == collections.Counter((i, t) for (i, t), x in zip(rows, leaks(rows, items), strict=True) if x[2] == 0)
    for share, num, den in ((0.05, 1, 20), (0.3, 3, 10), (Fraction(1, 3), 1, 3), (1, 1, 1)):
        kept = decontaminate.clean(docs, b, min_share=share)
        assert counted(kept, "doc_id", "text") == collections.Counter((i, t) for (i, t), x in zip(rows, leaks(rows, items), strict=True) if x[2] == 0 or den * x[2] < num * x[1])


def test_one_passage_in_a_long_text_is_a_leak(spark, monkeypatch):
    r = random.Random(8)
    passage, long = words(r, 30), words(r, 1000)
    leak = " ".join(long[:400] + passage[5:20] + long[400:])
    d = frame(spark, [(1, leak), (2, " ".join(long)), (3, " ".join(passage[:12])), (None, leak), (None, "fine words"), (4, None), (5, ""), (5, "")])
    b = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    monkeypatch.setattr(stages, "table", lambda spark, sf_dir, name: b)
    got = stages.drop_leaks(spark, d, "")
    assert got.schema == d.schema
    assert counted(got, "doc_id", "text") == collections.Counter([(2, " ".join(long)), (3, " ".join(passage[:12])), (None, "fine words"), (4, None), (5, ""), (5, "")])


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty, none).count() == 0
    r = decontaminate.decontaminate(docs, none)
    assert r.count() == docs.count() and r.where("contaminated or n_hit > 0 or n_items > 0").count() == 0


# --- 2 ------------------------------------------------------------------------------------------------------------------


def test_mixing_keeps_every_row_and_meets_the_limit(spark, docs):
    m = mixing.mix(docs, most_repeats=2.0, blocks=8)
    assert m.columns == [*docs.columns, "mix_pass", "mix_block", "mix_position"]
    times = counted(m, "doc_id", "text")
    assert set(times) == set(counted(docs, "doc_id", "text"))
    whole = counted(docs, "doc_id", "text")
    assert all(whole[k] <= n <= 2 * whole[k] for k, n in times.items())
    tokens = lambda df: {r.source: r.t for r in df.groupBy("source").agg(F.sum(mixing.token_count(F.col("text"))).alias("t")).collect()}
    before, after = tokens(docs), tokens(m)
    a = mixing.exponent(spark.createDataFrame([(str(s), t / sum(before.values())) for s, t in before.items()], "source string, p double"), 2.0)
    top = max(before.values())
    for s, t in before.items():
        want = (t / top) ** (a - 1) * t
        assert want - 6100 <= after[s] <= want + 1  # the last document that doesn't fit is left to the next pass
    assert m.where("mix_position < 0 or mix_position >= 1").count() == 0


def realised(keyed, source_tokens, exponent, seed, blocks):
    """How often each row comes: whole passes, then blocks and documents in order until the budget of its source is met.
    keyed: (source, block, h, tokens, turn of the block, turn of the document)."""
    top = max(source_tokens.values())
    out = []
    for s, total in source_tokens.items():
        repeats = (total / top) ** (exponent - 1)
        whole = math.floor(repeats + 1e-9)
        left = max(0, math.floor((repeats - whole) * total))
        mine = sorted((x for x in keyed if x[0] == s), key=lambda x: (x[4], x[1], x[5]))
        done, stopped = 0, False
        for _, block in itertools.groupby(mine, key=lambda x: (x[4], x[1])):
            block = list(block)
            for _, ties in itertools.groupby(block, key=lambda x: x[5]):
                ties = list(ties)
                n = sum(x[3] for x in ties)
                taken = not stopped and done + n <= left
                stopped = stopped or not taken
                done += n if taken else 0
                out += [(x[2], whole + taken) for x in ties]
    return collections.Counter(out)


@pytest.mark.parametrize("blocks", [1, 8, 256])
def test_mixing_passes(spark, docs, blocks):
    m = mixing.mix(docs, most_repeats=3.0, blocks=blocks)
    d = docs.withColumn("s", F.coalesce("source", F.lit(mixing.NO_SOURCE))).withColumn("n", mixing.token_count(F.col("text"))).withColumn("h", F.xxhash64("doc_id", "text", F.lit(1)))
    total = {r.s: r.t for r in d.groupBy("s").agg(F.sum("n").alias("t")).collect()}
    a = mixing.exponent(spark.createDataFrame([(s, t / sum(total.values())) for s, t in total.items()], "source string, p double"), 3.0)
    whole = F.floor(F.pow(F.col("t") / max(total.values()), F.lit(a - 1.0)) + 1e-9).cast("int")
    d = d.join(spark.createDataFrame(list(total.items()), "s string, t long"), "s").withColumn("whole", whole).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    d = d.select("s", "block", "h", "n", F.xxhash64("s", "block", "whole", F.lit(1)).alias("block_turn"), F.xxhash64("h", "whole").alias("turn"))
    want = realised([tuple(r) for r in d.collect()], total, a, 1, blocks)
    times = collections.Counter((r.h, r["count"]) for r in m.groupBy(F.xxhash64("doc_id", "text", F.lit(1)).alias("h")).count().collect())
    rows_of = collections.Counter()
    for (h, n), k in want.items():
        rows_of[h] += n * k
    assert times == collections.Counter(rows_of.items())


def test_mixing_exponents(spark, empty):
    p = spark.createDataFrame([("a", 0.6), ("b", 0.3), ("c", 0.1)], "source string, p double")
    a = mixing.exponent(p, most_repeats=2.0)
    assert abs((0.1 / 0.6) ** (a - 1) - 2.0) < 1e-6
    h = mixing.entropy(p, [1.0, 0.0])
    assert abs(h[0] + sum(x * math.log(x) for x in (0.6, 0.3, 0.1))) < 1e-9 and abs(h[1] - math.log(3)) < 1e-9
    a = mixing.exponent(p, None, target_entropy=1.0)
    assert abs(mixing.entropy(p, [a])[0] - 1.0) < 1e-4
    assert mixing.exponent(p, None, target_entropy=2.0) == 0.0 and mixing.exponent(p, 100.0) == 0.0
    assert mixing.mix(empty).count() == 0


# --- 3 and 5 ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        good, toxic = k % 4 != 0, k % 5 == 0
        w = words(r, 60)
        if toxic:
            w[r.randrange(60)] = "vilewordone"
            w[r.randrange(60)] = "vilewordtwo"
        t = " ".join(w) if good else " ".join(x + r.choice(["###", "$$$", "|||"]) for x in w)
        rows.append((k, t))
        if k % 3 == 0:
            labels.append((k, int(good), int(toxic)))
        elif k % 10 == 1:
            labels.append((k, None, int(toxic)))
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int"), {k: (g, t) for k, g, t in labels}


def test_quality_learns_from_positives_and_unlabelled(labelled, spark, empty):
    docs, labels, _ = labelled
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [r for r in out.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.items())
    assert np.mean([r.predicted == int(k % 4 != 0) for k, r in ((r.doc_id, r) for r in held)]) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = quality.good(docs, labels)
    assert kept.schema == docs.schema and counted(kept, "doc_id") == collections.Counter((k,) for k, r in out.items() if r.predicted)
    odd = frame(spark, [(1, None), (2, ""), (2, ""), (None, "x" * 300_000), (4, "\0\x1f")])
    scores = quality.classify(odd.unionByName(docs), labels).where("doc_id is null or doc_id in (1, 2, 4)")
    assert scores.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_prior_from_positives_and_unlabelled():
    r = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        p, good, bad = r.normal(2, 1, 60_000), r.normal(2, 1, int(60_000 * share)), r.normal(-2, 1, 60_000 - int(60_000 * share))
        count = lambda x: np.histogram(x, np.linspace(-8, 8, 1001))[0]
        assert abs(quality.estimated_prior(count(p), count(np.concatenate([good, bad]))) - share) < 0.03
    assert quality.estimated_prior(np.zeros(3), np.ones(3)) == 0.5 and quality.estimated_prior(np.zeros(0), np.zeros(0)) == 0.5
    assert quality.estimated_prior(np.array([0, 5]), np.array([5, 0])) == 1 - quality.LARGEST  # no unlabelled text looks like a positive


def test_quality_never_learns_from_bad_labels(labelled, spark):
    docs, labels, _ = labelled
    score = lambda x: {r.doc_id: r.score for r in quality.classify(docs, x).collect()}
    other = labels.withColumn("quality", F.when(F.col("quality") == 0, None).otherwise(F.col("quality")))
    assert score(labels) == score(other)


def test_threshold_is_part_of_the_good(labelled, spark):
    docs, labels, _ = labelled
    r = quality.classify(docs, labels).orderBy("score").collect()[100]
    at = quality.classify(docs, labels, threshold=r.score)
    assert at.where("predicted = 1").count() == at.where(F.col("score") >= r.score).count() and at.where(F.col("doc_id") == r.doc_id).first().predicted == 1


def test_risk_never_goes_negative():
    r = np.random.default_rng(1)
    n = quality.Network(r.normal(1, 1, (300, 3)), np.concatenate([r.normal(1, 1, (200, 3)), r.normal(-1, 1, (100, 3))]), 0.66, steps=200)
    assert min(n.risk) >= 0 and n(np.array([[1.0, 1, 1]]))[0] > n(np.array([[-1.0, -1, -1]]))[0]


def test_toxicity_by_compression(labelled, spark, empty):
    docs, labels, _ = labelled
    out = [r for r in toxicity.classify(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)
    odd = frame(spark, [(1, None), (2, ""), (2, ""), (None, "ba " * 100_000), (4, "\0\x1f")])
    got = toxicity.classify(odd.unionByName(docs), labels).where("doc_id is null or doc_id in (1, 2, 4)")
    assert got.where("score is null").count() == 0 and got.count() == 8
    assert toxicity.classify(empty, labels).count() == 0 and {r.score for r in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0.0}


# --- 4 ------------------------------------------------------------------------------------------------------------------


def test_records_are_the_library_s_ids(spark, docs, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    path = f"file://{tmp_path}/r"
    got = records.read_records(spark, path, records.write_records(docs, path, file, shards=3)).collect()
    want = sorted(((i, x or "") for i, x in rows), key=lambda x: x[0])
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    ids = lambda x: [*t.encode(x, add_special_tokens=False).ids, 0]
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == collections.Counter((i, np.array(ids(x), "<u4").tobytes()) for i, x in want)


def test_encoder_pieces(tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(file), records.Encoder(file, keep=50)
    r = random.Random(3)
    texts = ["".join(r.choices("ab ,.\n'sté1😀_ \t!…", k=r.randint(1, 40))) for _ in range(3000)]
    for k in range(0, 3000, 100):
        got = e(texts[k : k + 100])
        for x, y in zip(texts[k : k + 100], got, strict=True):
            assert np.frombuffer(y, e.kind).tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_damaged_records_are_found(spark, empty, tmp_path):
    r = records.frame(b"abcd")
    assert records.unframe(r) == (b"abcd", len(r))
    for k in range(len(r)):
        bad = bytearray(r)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))
    import public_tokenizers

    path = f"file://{tmp_path}/none"
    m = records.write_records(empty, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert m.count() == 0 and records.read_records(spark, path, m).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 3, 7])
def test_shards(docs, n, rows):
    s = sharding.balanced_shards(docs, F.xxhash64(F.coalesce("text", F.lit(""))), [F.col("doc_id")], shards=n).collect()
    assert len(s) == len(rows)
    count = collections.Counter(r.shard for r in s)
    assert set(count) <= set(range(n)) and max(count.values()) - min(count.values()) <= 1
    for k in count:
        assert sorted(r.slot for r in s if r.shard == k) == list(range(count[k]))
    assert collections.Counter((r.doc_id, r.text) for r in s) == collections.Counter(rows)
    if n == 3:  # 16 copies fit one shard
        assert len({r.shard for r in s if r.text == rows[75][1]}) == 1


def test_more_shards_than_rows_and_none(spark, rows, empty):
    s = sharding.balanced_shards(frame(spark, rows[:5]), F.lit(1), [F.col("doc_id")], shards=8).collect()
    assert sorted(collections.Counter(r.shard for r in s).values()) == [1] * 5
    assert sharding.balanced_shards(empty, F.col("text"), [F.col("doc_id")], shards=4).count() == 0
    hot = spark.range(1000).withColumn("text", F.when(F.col("id") < 700, "x").otherwise(F.col("id").cast("string")))
    c = collections.Counter(r.shard for r in sharding.balanced_shards(hot, F.col("text"), [F.col("id")], shards=10).where("text = 'x'").collect())
    assert len(c) == 7 and set(c.values()) == {100}


def cut_groups(df, key, shards):
    """The sizes of groups in more than one shard."""
    s = sharding.balanced_shards(df, F.col(key), [F.col("id")], shards=shards).collect()
    count = collections.Counter(r.shard for r in s)
    assert len(count) == shards and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in s if r.shard == k) == list(range(n)) for k, n in count.items())
    found = collections.defaultdict(list)
    for r in s:
        found[r[key]].append(r.shard)
    return [len(x) for x in found.values() if len(set(x)) > 1]


def test_no_group_that_fits_is_cut(spark):
    r = random.Random(3)
    small = [k for k in range(600) for _ in range(r.randint(2, 5))]
    hot = small + [-1] * len(small) + list(range(1000, 1000 + len(small)))  # a third each: small groups, one hot group, unlinked
    for keys, over in ((small, 0), (hot, 1)):
        df = spark.createDataFrame(list(enumerate(keys)), "id long, k long").repartition(3)
        assert len(cut_groups(df, "k", 12)) == over


def test_groups_are_placed_by_exchange():
    whole, cut, room = sharding.place({4: 1, 3: 2, 2: 2}, [7, 7])  # by most room alone, a pair is left with a place in each
    assert not cut and room == [0, 0] and sum(whole, collections.Counter()) == {4: 1, 3: 2, 2: 2}
    whole, cut, room = sharding.place({2: 5}, [5, 5])  # odd shards can't be filled by pairs
    assert cut == [(2, [(0, 1), (1, 1)])] and room == [0, 0]
    count = collections.Counter
    whole, cut, room = sharding.place({}, [4, 4], [count({2: 3}), count({2: 1})])  # a shard beyond its quota
    assert [dict(x) for x in whole] == [{2: 2}, {2: 2}] and not cut and room == [0, 0]
    whole, cut, room = sharding.place({6: 1}, [4, 4], [count({2: 1}), count()])  # a group of more than a shard
    assert cut == [(6, [(1, 4), (0, 2)])] and dict(whole[0]) == {2: 1} and room == [0, 0]


def test_labels_are_propagated_under_quotas(spark):
    r = random.Random(7)
    rows = [(g, s, n) for g in range(300) for s in range(r.randint(1, 6)) for n in [r.randint(1, 3)]]
    total = sum(n for *_, n in rows)
    quota = [-(-total // 6)] * 6
    d = spark.createDataFrame(rows, "group long, slice int, n long")
    got = sharding.propagate(d, quota).collect()
    assert sorted((x.group, x.slice, x.n) for x in got) == sorted(rows)
    shards = collections.defaultdict(set)
    began, ends = collections.Counter(), collections.Counter()
    for x in d.select("n", F.pmod(F.xxhash64("group", "slice"), F.lit(6)).alias("s")).collect():
        began[x.s] += x.n
    for x in got:
        shards[x.group].add(x.shard)
        ends[x.shard] += x.n
    assert all(ends[s] <= 1.1 * max(quota[s], began[s]) for s in range(6))
    several = {g for g, s, _ in rows if s > 0}
    whole = sum(len(shards[g]) == 1 for g in several)
    assert whole > 0.5 * len(several)  # no room is to spare here; the repair does the rest
    free = sharding.propagate(d, [2 * total] * 6).collect()
    assert len({(x.group, x.shard) for x in free}) == 300


def test_cut_links(spark):
    d = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 1), ("b", 1), ("c", 2)], "k string, shard int")
    assert tuple(sharding.cut_links(d, F.col("k")).first()) == (4, 2)
    assert tuple(sharding.cut_links(d.limit(0), F.col("k")).first()) == (0, 0)


# --- 7 ------------------------------------------------------------------------------------------------------------------


def without_lines(rows):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOW)
    who = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                who[key(x)].add(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(who[key(x)]) < 2 or min(who[key(x)]) == i]
        yield i, len(lines), len(lines) - len(kept), "\n".join(kept)


@pytest.mark.parametrize("size", [1 << 28, 1 << 8])
def test_line_dedup(docs, rows, size):
    got = counted(line_dedup.dedup_lines(docs, filter_bytes=size), "doc_id", "n_lines", "n_dropped", "kept")
    assert got == collections.Counter(without_lines(rows)) and any(k[2] for k in got)


def test_line_dedup_of_null_ids_and_nothing(spark, empty):
    d = frame(spark, [(None, "a line that is long\nb"), (4, "A line that is long "), (None, "a line that is long\nc")])
    assert counted(line_dedup.dedup_lines(d), "doc_id", "n_dropped", "kept") == {(None, 1, "b"): 1, (None, 1, "c"): 1, (4, 0, "A line that is long "): 1}
    assert line_dedup.dedup_lines(empty).count() == 0


# --- 8 ------------------------------------------------------------------------------------------------------------------


def test_rule_counts_and_bands(docs, rows, empty):
    got = kneser_ney.perplexity_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t or "" for i, t in rows if i == r.doc_id)
        w = SPACED.findall(t)
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed) and r.entropy is not None
    assert kneser_ney.perplexity_rules(empty).count() == 0


def test_kneser_ney_is_a_distribution_and_joins_agree(docs):
    d = docs.where("lang = 'en' and doc_id < 40")
    order = 3
    pieces = [p for r in d.collect() for p in grams.symbols((r.text or "").encode(), order)]
    key, n = np.unique(grams.keys(pieces, order), return_counts=True)
    levels = kneser_ney._levels(key, n, order)
    two = np.unique(key & grams.mask(3)) & grams.mask(2)
    one = kneser_ney.Level(*np.unique(two, return_counts=True))
    levels[:2] = [kneser_ney.Level(*grams.totals(one.key & grams.mask(1), np.ones(len(one.key), np.int64))), one]
    disc = [kneser_ney.discounts([int((x.n == c).sum()) for c in (1, 2, 3, 4)]) for x in levels]
    for ctx in [*np.unique(key >> grams.BITS)[::40], 12345]:
        every = (int(ctx) << grams.BITS) + np.arange(1, grams.END + 1)
        assert abs((10 ** kneser_ney.log_probabilities(every, levels, disc, order)).sum() - 1) < 1e-9
    a = {r.doc_id: r.entropy for r in kneser_ney.perplexity_rules(d).collect()}
    b = {r.doc_id: r.entropy for r in kneser_ney.perplexity_rules(d, most_rows=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def kn_entropy(texts, order):
    """log10 a byte of each text of one language, under interpolated modified Kneser-Ney, by dictionaries of tuples."""
    padded = [[-1] * order + list(t) + [256] for t in texts]
    count = [{} for _ in range(order)] + [collections.Counter(tuple(s[i - order : i + 1]) for s in padded for i in range(order, len(s)))]
    for k in range(order - 1, -1, -1):
        count[k] = collections.Counter(g[1:] for g in count[k + 1])
    total, taken = [collections.Counter() for _ in count], [collections.Counter() for _ in count]
    cut = []
    for k, grams_of in enumerate(count):
        n1, n2, n3, n4 = (sum(v == c for v in grams_of.values()) for c in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        cut.append([0.0] + [min(max(x, 0.0), c + 0.9) for c, x in enumerate(d)])
        for g, c in grams_of.items():
            total[k][g[:-1]] += c
            taken[k][g[:-1]] += cut[k][min(c, 3)]
    out = []
    for s in padded:
        log = 0.0
        for i in range(order, len(s)):
            p = 1 / grams.END
            for k in range(order + 1):
                g = tuple(s[i - k : i + 1])
                if total[k][g[:-1]]:
                    c = count[k][g]
                    p = (c - cut[k][min(c, 3)]) / total[k][g[:-1]] + taken[k][g[:-1]] / total[k][g[:-1]] * p
            log += math.log10(p)
        out.append(-log / (len(s) - order))
    return out


def test_perplexity_verdicts_at_every_size(spark):
    r = random.Random(11)
    made = [(k, " ".join(words(r, r.randint(200, 300))), [None, "aa", "bb"][k % 3]) for k in range(90)]
    made += [(90 + k, " ".join("".join(chr(r.randint(33, 126)) for _ in range(6)) for _ in range(60)), [None, "aa", "bb"][k]) for k in range(3)]
    made += [(93 + k, "ba ko", f"rare{k}") for k in range(12)] + [(105, None, "aa"), (106, "", "only"), (None, made[4][1], "aa"), made[5], made[5]]
    want = collections.Counter()
    for lang in {x[2] for x in made}:
        here = [x for x in made if x[2] == lang]
        text_of = [(t or "").encode() for _, t, _ in here]
        e = kn_entropy(text_of, 3)
        long = [len((t or "").split()) >= 50 for _, t, _ in here]
        good = sorted(x for x, ok in zip(e, long, strict=True) if ok)
        q1, q2, q3 = (good[math.ceil(len(good) * p) - 1] for p in (0.25, 0.5, 0.75)) if good else (0, 0, 0)
        for (i, _, _), t, x, ok in zip(here, text_of, e, long, strict=True):
            wider = math.sqrt(1 + 200 / (len(t) + 1))
            want[i, lang, round(x, 4), ok and q2 - 8 * wider * max(q2 - q1, 0.002) <= x <= q2 + 6 * wider * max(q3 - q2, 0.002)] += 1
    assert [k[0] for k in want if k[0] in (90, 91, 92) and k[3]] == [] and sum(n for k, n in want.items() if k[3]) > 85
    d = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(4)
    for sizes in ({}, {"most_rows": 0}, {"most_languages": 3, "block_rows": 150}):
        got = kneser_ney.perplexity_rules(d, order=3, **sizes).collect()
        assert collections.Counter((x.doc_id, x.lang, round(x.entropy, 4), x.kept) for x in got) == want, sizes


# --- 9 ------------------------------------------------------------------------------------------------------------------


def ppm_score(text, ctx, order):
    s, total = [-1] * order + list(text) + [256], 0.0
    for i in range(order, len(s)):
        out = set()
        for k in range(order, -1, -1):
            if not (q := ctx[k].get(tuple(s[i - k : i]))):
                continue
            rest = {a: n for a, n in q.items() if a not in out}
            t = sum(rest.values())
            if s[i] in rest:
                total += math.log10((2 * rest[s[i]] - 1) / (2 * t))
                break
            if rest:
                total += math.log10(len(rest) / (2 * t))
            out |= set(q)
        else:
            total -= math.log10(257 - len(out))
    return total


@pytest.mark.parametrize("most", [16_000_000, 0])
def test_ppm(docs, rows, most):
    order = 3
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    ctx = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    c = collections.Counter()
    for i, t in rows:
        if train(i):
            b = (t or "").encode().lower()
            c.update([*b.split(), None])
            s = [-1] * order + list(b) + [256]
            for k in range(order, len(s)):
                for j in range(order + 1):
                    ctx[j][tuple(s[k - j : k])][s[k]] += 1
    n, v = sum(c.values()), len(c)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.score) for r in ppm.score_corpus(docs, common.fold(F.col("doc_id"), 7) != 2, order, most).collect()]
    want = []
    for i, t in rows:
        b = (t or "").encode().lower()
        w = [*b.split(), None]
        want.append((i, not train(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5), ppm_score(b, ctx, order)))
    got.sort(key=lambda x: x[:6])
    want.sort(key=lambda x: x[:6])
    assert [x[:6] for x in got] == [x[:6] for x in want]
    assert all(abs(g[6] - x[6]) < 1e-3 * max(1, abs(x[6])) for g, x in zip(got, want, strict=True))


def test_ppm_join_equals_broadcast(spark):
    rows = [(1, "a b a"), (1, "a b a"), (1, "a b a"), (1, "other b"), (None, "a b a"), (None, "a b a"), (None, None), (0, "a b a"), (0, ""), (2, "b Zz"), (2, "b Zz")]
    by_path = []
    for most in (16_000_000, 0):
        got = ppm.score_corpus(frame(spark, rows), F.col("doc_id") != 2, 3, most).collect()
        by_path.append(sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in got), key=repr))
    assert len(by_path[0]) == len(rows) and by_path[0] == by_path[1]


def test_ppm_without_training_rows(docs, empty):
    r = ppm.score_corpus(docs.where("doc_id = 93"), F.lit(False)).collect()[0]
    assert r.train_tokens == 0 and r.n_known == 0 and abs(r.score + 14 * math.log10(257)) < 1e-4
    assert ppm.score_corpus(empty, F.lit(True)).count() == 0


def test_lookup_and_pieces():
    r = np.random.default_rng(2)
    k = np.unique(r.integers(-(2**62), 2**62, 5000))
    t = grams.Lookup(k, np.arange(len(k)))
    q = np.concatenate([k[::3], k[:50] + 1])
    assert [(-1 if a < 0 else int(t.values[0][a])) for a in t.find(q)] == [int(np.searchsorted(k, x)) if x in set(k.tolist()) else -1 for x in q.tolist()]
    long = bytes(r.integers(0, 256, grams.PIECE + 1000, dtype=np.uint8))
    assert len(grams.keys(list(grams.symbols(long, 4)), 4)) == len(long) + 1
    whole = np.concatenate([np.zeros(4, np.int64), np.frombuffer(long, np.uint8).astype(np.int64) + 1, [grams.END]])
    want = sum(whole[k : len(whole) - 4 + k] << (9 * (4 - k)) for k in range(5))
    assert (grams.keys(list(grams.symbols(long, 4)), 4) == want).all()


# --- 10 -----------------------------------------------------------------------------------------------------------------


def linked(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, percent):
    want = linked(rows, percent)
    got = near_dedup.near_duplicates(docs, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)
    one = near_dedup.one_of_each(docs, percent)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in want.values()})


def test_large_family_of_near_copies(spark):
    """A bucket of many members that are mostly not linked to each other takes the later rounds."""
    r = random.Random(4)
    base = words(r, 150)
    rows = []
    for k in range(220):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(150)] = f"q{r.randint(0, 999)}"
        rows.append((k, " ".join(w)))
    got = near_dedup.near_duplicates(frame(spark, rows), 85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == linked(rows, 85)


def test_near_duplicates_of_null_ids_and_nothing(spark, empty):
    got = near_dedup.near_duplicates(frame(spark, [(None, "a b c d e f"), (4, "A b c d e f"), (None, "other"), (9, None)])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted([(None, 4, False), (4, 4, True), (None, None, True), (9, 9, True)], key=repr)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    e = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), *((100 + k, 101 + k) for k in range(40))]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {100 + k: 100 for k in range(41)}


# --- queries and pipeline -----------------------------------------------------------------------------------------------


def test_queries_equal_their_sql(spark):
    import duckdb

    from folio.llm.registry import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got, want = QUERIES[name](spark, sf).toPandas(), con.sql(sql).df()
        key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
        assert key(got) == key(want), name


def test_stages_against_plain_python(spark, rows, monkeypatch):
    """Each stage on what the one before it kept, row by row."""
    base = rows[75][1].split(" ")
    items = [(1, " ".join(base[10:50])), (2, "one, TWO three"), (3, None)]
    tables = {"benchmark": spark.createDataFrame(items, "item_id long, text string"), "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int")}
    monkeypatch.setattr(stages, "table", lambda spark, sf_dir, name: tables[name])
    d = common.written(frame(spark, rows), "test")
    at = [(r.doc_id, r.text) for r in d.collect()]
    step = lambda stage, d: common.written(stage(spark, d, ""), "test")
    d = step(stages.keep_good, d)  # without labels every score is 0.5, beyond the threshold
    assert counted(d, "doc_id", "text") == collections.Counter(at)
    d = step(stages.keep_one_of_each, d)
    at = [x for x in dict.fromkeys(at) if linked(rows, 80)[x[0]][1] == x[0]]
    assert counted(d, "doc_id", "text") == collections.Counter(at)
    d = step(stages.drop_leaks, d)
    found = dict(zip(at, leaks(at, items), strict=True))
    at = [x for x in at if not found[x][2]]
    assert len(at) < len(found) and counted(d, "doc_id", "text") == collections.Counter(at)
    d = step(stages.mix_sources, d)
    times = counted(d, "doc_id", "text")
    assert set(times) == set(at) and set(times.values()) <= {1, 2}
    out = stages.shard(spark, d, "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in out) == times
    count = collections.Counter(r.shard for r in out)
    assert max(count.values()) - min(count[s] for s in range(40)) <= 1 and all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in count.items())


def test_stages_on_nothing(spark, empty, monkeypatch):
    tables = {"benchmark": spark.createDataFrame([], "item_id long, text string"), "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int")}
    monkeypatch.setattr(stages, "table", lambda spark, sf_dir, name: tables[name])
    for name, stage in stages.STAGES:
        got = stage(spark, empty, "")
        assert got.count() == 0 and (name == "sharding" or got.columns == empty.columns)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = d
        d = common.written(stage(spark, d, sf), "test")
        if name != "sharding":
            assert d.columns == before.columns
    assert 0 < d.count() and {"shard", "slot"} <= set(d.columns)
    assert corpus_pipeline.run(spark, sf).count() == d.count()
