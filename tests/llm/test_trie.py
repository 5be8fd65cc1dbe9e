"""The prefix trie against plain Python, with shards of all sizes."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gristmill.llm import trie
from gristmill.llm.queries import op12_prefix_trie
from gristmill.llm.trie import Louds, prefix_nodes

DDL = "conv_id long, turn int, role string, text string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        gain = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += gain
    text = lambda p: ",".join(map(str, sorted(ends[p]))) if p in ends else ""
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(text(p).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted(tuple(r[f] for f in FIELDS) for r in df.collect())


@pytest.mark.parametrize("light", [1, 7, None, 10**6])
def test_sf_table(spark, sf, light):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want = brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert found(prefix_nodes(table, light=light)) == want


def odd_rows():
    rows = [(c, t, "user" if t % 2 == 0 else None, f"turn {t} of all") for c in range(1, 60) for t in range(4)]  # copies
    rows += [(20, None, "system", None), (20, 5, "user", "x " * 5000), (20, 5, "user", "x " * 5000), (40, 1, "", ""), (40, 2, "", "z"), (None, 1, "user", "lost"), (-3, 0, "a", "b"), (-20, 0, "a", "c"), (-20, 1, "a", "d")]
    rows += [(1000, t, "user", f"long {t}") for t in range(700)] + [(1001, t, "user", f"long {t}") for t in range(500)] + [(2003, 0, "u", "one")]
    return rows


@pytest.mark.parametrize("light", [3, None])
def test_odd_rows(spark, light, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 5)
    monkeypatch.setattr(trie, "BAND", 3)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "own", 1, 2) for r in rows], DDL + ", c string, pos int, p1 int")
    assert found(prefix_nodes(df.repartition(7), light=light)) == brute(rows)


def test_equal_turns_have_one_order(spark):
    df = spark.createDataFrame([(c, 1, "user", f"text {k}") for c in range(9) for k in range(6)], DDL)
    assert found(prefix_nodes(df.repartition(5))) == found(prefix_nodes(df.repartition(2).orderBy("text")))


def test_empty_table(spark):
    assert prefix_nodes(spark.createDataFrame([], DDL)).count() == 0


def test_query_is_the_operator(spark, sf):
    got = op12_prefix_trie(spark, sf)
    assert tuple(got.columns) == FIELDS and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    root = got.where("depth = 0").collect()
    assert len(root) == 1 and root[0].parent_conv_id is None


def test_louds_navigates_as_the_tree():
    rng = np.random.default_rng(4)
    n = 400
    up = np.array([-1, -1, -1] + [int(rng.integers(0, i)) for i in range(3, n)])
    ids = rng.permutation(n * 2).reshape(n, 2).astype(np.int64)
    top = np.arange(n)
    pos = np.zeros(n, np.int64)
    for i in range(n):
        pos[i], top[i] = (i, i) if up[i] < 0 else (pos[up[i]] + 1, top[up[i]])
    parents = np.where(up[:, None] < 0, 0, ids[up])
    order = rng.permutation(n)
    built = Louds(pos[order], ids[order], parents[order], pos[top][order])
    assert len(built.bits) == 2 * n + 1 and built.bits.sum() == n
    place = {tuple(x): i for i, x in enumerate(built.labels.tolist())}
    mine = built.parents()
    for i in range(n):
        assert mine[place[tuple(ids[i].tolist())]] == (-1 if up[i] < 0 else place[tuple(ids[up[i]].tolist())])
    kids = np.bincount(up[up >= 0], minlength=n)
    assert [int(built.children()[place[tuple(x)]]) for x in ids.tolist()] == kids.tolist()
    size = np.ones(n, np.int64)
    for i in reversed(range(n)):
        if up[i] >= 0:
            size[up[i]] += size[i]
    assert [int(built.rolled_up(np.ones(n, np.int64))[place[tuple(x)]]) for x in ids.tolist()] == size.tolist()
    with pytest.raises(ValueError, match="parent"):
        Louds(np.array([0, 1]), np.array([[1, 1], [2, 2]]), np.array([[0, 0], [9, 9]]), np.array([0, 0]))
