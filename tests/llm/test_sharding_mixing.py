import zlib

import pytest
from pyspark.sql import functions as F

from gristmill.llm.mixing import WORD, Mix, mix_counts, mix_documents, permuted, targets
from gristmill.llm.sharding import grown, layout, place, shard_documents

from .helpers import DDL, clashing, empty, odd


def placed(spark, n, tree):
    return {r.id: r.s for r in spark.range(n).select("id", place(F.col("id"), tree).alias("s")).collect()}


def descended(key, tree, seed=7):
    """The descent in plain Python."""
    import math
    import struct

    import xxhash

    at, regions = 0, []
    for layer in tree:
        for region in layer:
            own, at, racks = at, at + 1, []
            for rack in region:
                mine, at, shards = at, at + 1, []
                for shard, weight in rack:
                    shards.append((at, weight, shard))
                    at += 1
                racks.append((mine, sum(s[1] for s in shards), shards))
            regions.append((own, sum(r[1] for r in racks), racks))

    def draw(node):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", node[0]), h)
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / node[1]

    level = regions
    while isinstance(level, list):
        level = min((n for n in level if n[1] > 0), key=draw)[2]
    return level


def test_descent_against_plain_python(spark):
    for tree in (layout(40), grown(layout(40), 40), [[[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 0.0)]]]]):
        assert placed(spark, 500, tree) == {k: descended(k, tree) for k in range(500)}


def test_layouts_of_the_same_shards_differ(spark):
    flat, deep, wide = placed(spark, 3000, layout(40, 40, 1)), placed(spark, 3000, layout(40)), placed(spark, 3000, layout(40, 1, 40))
    for a, b in ((flat, deep), (deep, wide), (flat, wide)):
        assert sum(a[k] != b[k] for k in a) > 2000


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (1, 5, 16, 40):
        tree = layout(n)
        old = placed(spark, 4000, tree)
        for shard in (n, n + 1):
            tree = grown(tree, shard)
            new = placed(spark, 4000, tree)
            moved = [k for k in old if old[k] != new[k]]
            assert {new[k] for k in moved} == {shard} and abs(len(moved) - 4000 / (shard + 1)) < 5 * (4000 / (shard + 1)) ** 0.5
            old = new


def test_shards_follow_weights_and_movement_is_confined(spark):
    tree = [[[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 2.0)]]]]
    a = placed(spark, 8000, tree)
    counts = [sum(v == s for v in a.values()) for s in range(4)]
    assert all(abs(c - w * 1000) < 130 for c, w in zip(counts, (1, 3, 2, 2)))
    b = placed(spark, 8000, grown(tree, 3, 2.0))
    assert {b[k] for k in a if a[k] != b[k]} == {3}
    less = placed(spark, 8000, [[[[(0, 1.0), (1, 3.0)], [(2, 2.0)]], [[(3, 1.0)]]]])
    assert {a[k] for k in a if a[k] != less[k]} == {3}  # what loses weight loses rows, no other
    rack = placed(spark, 8000, [[[[(0, 1.0), (1, 1.5)], [(2, 2.0)]], [[(3, 2.0)]]]])
    assert {a[k] for k in a if a[k] != rack[k]} <= {0, 1, 2}  # rows leave the region whose weight changed, no other
    assert placed(spark, 10, [[[[(0, 0.0)]]]]) == dict.fromkeys(range(10))


def test_equal_rows_are_spread_over_buckets(spark):
    out = shard_documents(spark.createDataFrame([(1, "x", "", "", 0)], DDL).crossJoin(spark.range(9000).select(F.lit(0).alias("z"))), layout(3))
    assert sorted(r.slot for r in out.collect()) == list(range(9000))


@pytest.mark.parametrize("make", [odd, clashing])
def test_sharded_rows(spark, make):
    out = shard_documents(make(spark), layout(3), grown(layout(3), 3)).collect()
    assert len(out) == len(odd(spark).collect())
    texts = [(r.doc_id, r.text or "") for r in odd(spark).collect()]
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in texts)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 3)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert shard_documents(empty(spark), layout(3)).count() == 0


def test_slots_are_gapless_over_many_buckets(spark):
    from gristmill.llm.common import numbered, staged

    df = staged(spark.range(3000).select("id", (F.col("id") % 3 == 0).alias("g")), "rows")
    out = numbered(df, ["g"], ["id"], "slot", rows_per_bucket=100).collect()
    for g in (True, False):
        assert sorted(r.slot for r in out if r.g == g) == list(range(sum(r.g == g for r in out)))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit(9)).alias("x"))
        got = [r.x for r in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 50 or got != sorted(got))


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Repeated resharing of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while len(done) < len(names):
        left, open_ = total - sum(done.values()), [s for s in names if s not in done]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}
    return done


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 3}, {"z": 100}, {"é": 7, "e": 900, "Z": 0, "a": 1}, {"a": 0, "b": 0}, {None: 50, "": 2, "x": 4000, "y": 1, "q": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in targets(df, (1, 2, 3), 3).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def corpus(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(1 + (i * 37) % 300)), "en", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}", 0) for i in range(300)]
    return spark.createDataFrame(rows, DDL)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    first = [tuple(r) for r in mix_counts(corpus(spark)).orderBy("doc_id").collect()]
    assert first == [tuple(r) for r in mix_counts(corpus(spark).repartition(3)).orderBy("doc_id").collect()]
    by = {}
    for _, source, size, source_size, target, taken in first:
        assert taken <= 3 * size
        s = by.setdefault(source, [0, 0, source_size, target])
        s[0], s[1] = s[0] + size, s[1] + taken
    assert len(first) == 300 and all(s[0] == s[2] and abs(s[1] - s[3]) <= 130 for s in by.values())


def test_slots_are_dealt_by_shard(spark):
    mix = Mix(corpus(spark), shard_slots=100)
    slots = mix.slots.collect()
    want = {r.s: (r.want, r.blocks) for r in mix.sources.collect()}
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) == sum(w for w, _ in want.values())
    for s, (n, blocks) in want.items():
        mine = [(r.epoch, r.block) for r in slots if r.s == s]
        assert len(mine) == len(set(mine)) == n and all(b < blocks for _, b in mine)


def test_mixed_texts_hold_the_words_taken(spark):
    taken = {r.doc_id: r.taken for r in mix_counts(corpus(spark)).collect() if r.taken}
    out = mix_documents(corpus(spark), length_col="n_chars")
    words = {}
    for r in out.withColumn("w", F.regexp_count("text", F.lit(WORD))).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + r.w
        assert r.n_chars == len(r.text) and set(r.text.split()) <= {f"w{r.doc_id}x{k}" for k in range(300)}
    assert words == taken and out.columns == corpus(spark).columns


@pytest.mark.parametrize("make", [odd, clashing])
def test_mix_odd_rows(spark, make):
    got = mix_counts(make(spark)).collect()
    assert len(got) == 11 and sum(r["size"] for r in got) == sum(len((r.text or "").split()) for r in odd(spark).collect())
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mix_documents(make(spark)).columns == make(spark).columns
    assert mix_counts(empty(spark)).count() == 0 and mix_documents(empty(spark)).count() == 0


def test_rows_of_one_id_keep_their_own_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "en", "s", 0), (1, "a b c d", "fr", "s", 0), (1, "a b c d", "fr", "s", 0)], DDL)
    assert sorted(r.lang for r in mix_documents(df).collect()) == ["en", "fr", "fr"]


def test_parts_keep_line_ends(spark):
    text = "\n".join(f"line  {i}\tend" for i in range(200))
    df = spark.createDataFrame([(1, text, "en", "a", 0), (2, "x " * 3000, "en", "b", 0)], DDL)
    parts = [r.text for r in mix_documents(df, weights=(1, 9)).collect() if r.doc_id == 1]
    assert parts and all(p != text and "\n" in p and all(piece in text for piece in p.split("\n")) for p in parts)


def test_last_shards_are_multinomial_too(spark):
    mix = Mix(corpus(spark), shard_slots=50)
    total = sum(r.want for r in mix.sources.collect())
    share = {r.s: r.want / total for r in mix.sources.collect()}
    slots = mix.slots.collect()
    half = max(r.shard for r in slots) // 2
    for s, p in share.items():
        late = [r.s == s for r in slots if r.shard > half]
        assert abs(sum(late) - p * len(late)) < 5 * (p * (1 - p) * len(late)) ** 0.5 + 1
