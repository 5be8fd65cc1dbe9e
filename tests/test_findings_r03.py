"""What the review of round 3 found."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.operators import matching, ranking
from gristmill.plans import proxy

from .test_fuzzy import best
from .test_queries import canonical


def with_tables(spark, sf, folder, **made):
    """A folder of the tables of ``sf``, some of them others."""
    for f in os.listdir(sf):
        if f.split(".")[0] not in made:
            os.symlink(f"{sf}/{f}", folder / f)
    for name, df in made.items():
        df.toPandas().to_parquet(folder / f"{name}.parquet")
    return str(folder)


def same_as_sql(name, spark, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got, want = proxy.queries()[name](spark, folder).toPandas(), con.execute(proxy.oracle_sql()[name]).fetchdf()
    assert canonical(got) == canonical(want)


def test_rows_alike_are_all_in_the_cascade(spark):
    base = spark.createDataFrame([("o__r.12ab34cd.pr_1", 5), ("o__r.12ab34cd.pr_2", 7)], "instance_id string, row_index long")
    runs = spark.createDataFrame([("n__r_12ab34cd__other_run1",), ("n__r_12ab34cd__other_run1",), ("o__r.12ab34cd.pr_2",), ("none",)], "trajectory_id string")
    got = sorted(map(tuple, matching.resolve_mirrors(runs, base).collect()))
    assert got == [("n__r_12ab34cd__other_run1", 5, 3)] * 2 + [("o__r.12ab34cd.pr_2", 7, 0)]


def test_runs_of_one_id_and_several_images(spark):
    base = spark.createDataFrame([("own__rep-2", 3)], "instance_id string, row_index long")
    other = spark.createDataFrame([("zz", 9)], "instance_id string, row_index long")
    image = "sweb.eval.x86_64.own_1776_rep-2"
    runs = spark.createDataFrame([("zz", image), ("zz", image), ("zz", None)], "trajectory_id string, image string")
    got = sorted(map(tuple, matching.resolve_instances(runs, base, other).select("trajectory_id", "source", "row_index", "step").collect()))
    assert got == [("zz", 0, 3, 1), ("zz", 0, 3, 1), ("zz", 1, 9, 0)]


def test_tails_of_bands_are_whole_rows(spark, sf, tmp_path):
    few = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").limit(435)  # 43.5 rows a tail
    same_as_sql("g8_x6_stratified", spark, with_tables(spark, sf, tmp_path, embeddings=few))


def test_means_between_two_rounded_values(spark, sf, tmp_path):
    # 64 discounts of sum 3.18, the mean is 0.0496875: summed as doubles, it falls on either side by the order of rows
    values = [0.01, 0.09, 0.02, 0.08, 0.03, 0.07, 0.04, 0.06, 0.05, 0.05] * 6 + [0.07, 0.05, 0.03, 0.03]
    rows = [(k, v) for k, vs in enumerate((values, sorted(values), sorted(values, reverse=True))) for v in vs]
    lines = spark.createDataFrame(rows, "l_suppkey long, l_discount double").withColumns({"l_returnflag": F.lit("R"), "l_quantity": F.lit(20.0)})
    folder = with_tables(spark, sf, tmp_path, lineitem=lines)
    got = {(r.v_b, r.rank_b) for r in proxy.queries()["j8_full_outer_rank"](spark, folder).collect()}
    assert got == {(0.049688, 2.0)}


def test_near_texts_of_a_low_threshold_meet_in_bounded_units(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(matching, "ASKED", 16)
    monkeypatch.setattr(matching, "CANDIDATES", 64)
    monkeypatch.setattr(matching, "near_texts", lambda *a: seen.append(a))
    base = [(n, f"https://one.host.example/en/{n * 7919 % 100_000}/") for n in range(300)]
    asked = [(n, f"https://one.host.example/en/{n * 104_729 % 100_000}") for n in range(60)]
    left, right = spark.createDataFrame(asked, "id long, t string"), spark.createDataFrame(base, "row_index long, t string")
    got = {r.id: r.row_index for r in matching.fuzzy(left, "id", F.col("t"), F.lit("b"), right, F.col("t"), F.lit("b"), 0.9).collect()}
    assert got == {n: best(t, base, 0.9) for n, t in asked} and not seen


def test_texts_are_laid_out_a_bounded_number_of_characters_at_a_time():
    import pandas as pd

    texts = pd.Series([f"owner__name-{n}" * 10 for n in range(2_000)])
    parts = list(matching.text_parts.func(iter([texts])))
    assert sum(map(len, parts)) == 2_000 and max(p["size"].sum() for p in parts) <= matching.LAID_OUT + 200


def test_repeated_names_of_a_large_tree(spark):
    from gristmill.operators import tree

    paths = [f"d{n % 7}/f{n % 4_000}" for n in range(6_000)]  # 2,000 names stand twice
    rows = spark.createDataFrame([(1, [(p, "blob", 1) for p in paths], True, [paths[0]])], "id long, tree array<struct<path: string, type: string, size: bigint>>, truncated boolean, changed_files array<string>")
    out = tree.tree_features(rows).select("repo_basename_collision_count")
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()  # a look at all names for each name
    assert out.first()[0] == 2_000


def test_fits_read_rows_that_are_made_once(spark):
    from functools import partial

    from gristmill.operators import models

    rows = spark.range(60).select(F.col("id").alias("task_id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    plans = []

    def fit(df, *args, **params):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return partial(models.logistic, max_iter=2)(df, *args, **params)

    assert models.cross_validated(rows, ["x"], "y", "classification", fit, k=2).count() == 60
    models.nested(rows, ["x"], "y", "classification", fit, {"C": (1.0,)}, outer=2, n_iter=2, inner=2)
    assert plans and not any("Window" in p or "Join" in p or "Range" in p for p in plans)


def test_lines_of_patches_are_made_once(spark):
    from gristmill.operators import patch

    rows = spark.createDataFrame([(1, "diff --git a/x.py b/x.py\n@@ -1 +2 @@\n+def f():\n+  \n"), (2, None), (3, " NaN\n"), (4, "")], "patch_id long, patch string")
    out = patch.patch_features(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Expand" not in plan and "Join" not in plan
    got = {r.patch_id: (r.patch_present, r.patch_lines_added, r.ast_num_functions_modified, r.patch_primary_file_path) for r in out.collect()}
    assert got == {1: (1, 2, 1, "x.py"), 2: (0, 0, 0, ""), 3: (0, 0, 0, ""), 4: (0, 0, 0, "")}


def test_small_forests_need_no_joins_and_large_ones_give_the_same(spark, monkeypatch):
    from gristmill.operators import forest

    rows = [(d, s, k, (k - 1) // 2 if k else 0) for d in (None, 1, 2) for s in range(3) for k in range(1 + 20 * s)]
    df = spark.createDataFrame(rows, "d int, s int, k int, up int")
    both = lambda: [sorted(map(repr, forest.climb(df, ["d", "s"], "k", F.col("up"), {"even": (F.col("k") % 2 == 0).cast("long")}).collect())), sorted(map(repr, forest.subtree_sums(df, ["d", "s"], "k", F.col("up"), F.col("k").cast("long"), "n").collect()))]
    with monkeypatch.context() as m:
        m.setattr(forest, "_staged", None)  # nothing is written
        small = both()
    monkeypatch.setattr(forest, "IN_ONE", 25)
    assert small == both() and len(small[0]) == len(rows)


def walked(tokens):
    """Some metrics of one document (sent, place, head, dep, pos, space), token by token."""
    at = {t[1]: t for t in tokens}
    head = {t[1]: t[2] if t[2] in at else t[1] for t in tokens}
    inner = lambda i: head[i] != i
    words = [t for t in tokens if not t[5]]
    said = {t[0] for t in words}

    def above(i):
        while inner(i):
            i = head[i]
            yield i

    def size(i):
        kids = [t for t in tokens if head[t[1]] == i and t[1] != i and t[0] == at[i][0]]
        return (not at[i][5]) + sum(size(t[1]) for t in kids)

    mean = lambda x: sum(x) / len(x) if x else 0.0
    clauses, preps, chains = [t for t in words if t[3] == "ROOT"], [t for t in words if t[3] == "prep"], {}
    runs = []
    for t in preps:
        n = 1
        for i in above(t[1]):
            if at[i][3] != "prep" or not inner(i):
                break
            n += 1
        runs.append(n)
    for t in words:
        if t[3] == "conj":
            i = t[1]
            while at[i][3] == "conj" and inner(i):
                i = head[i]
            chains.setdefault(i, {i}).add(t[1])
    return {
        "prompt_sent_count": len(said) or 1, "prompt_clause_length_mean": mean([size(t[1]) for t in clauses]),
        "prompt_dep_depth_mean": mean([max(len(list(above(t[1]))) for t in words if t[0] == s) for s in said]),
        "prompt_dep_distance_max": max([abs(t[1] - head[t[1]]) for t in words], default=0),
        "prompt_clause_nesting_depth_mean": mean([sum(at[i][3] == "ROOT" and inner(i) for i in above(t[1])) for t in clauses]),
        "prompt_max_conj_chain_len": max(map(len, chains.values()), default=0), "prompt_mean_conj_chain_len": mean([len(c) for c in chains.values()]),
        "prompt_mean_pp_chain_depth": mean(runs), "prompt_pronoun_candidate_antecedent_density": mean([sum(u[4] == "NOUN" and u[0] == t[0] and u[1] < t[1] for u in words) for t in words if t[4] == "PRON"]),
    }


def test_documents_are_measured_many_at_a_time(spark):
    import random

    from gristmill.operators import nlp

    rng, docs = random.Random(3), {}
    for d in [*range(60), None]:
        n = rng.choice([1, 2, 9, 40])
        places = sorted(rng.sample(range(3 * n), n))
        order = rng.sample(places, n)  # heads come before in this order
        heads = {i: rng.choice([i, None, 10**6, *order[:k], *order[:k]]) for k, i in enumerate(order)}
        docs[d] = [(rng.randrange(3) if d and d % 2 else i // 9, i, heads[i], rng.choice(["ROOT", "prep", "prep", "conj", "conj", "x", None]), rng.choice(["NOUN", "PRON", None]), rng.random() < 0.3) for i in places]
    rows = [(d, *t, None) for d, tokens in docs.items() for t in rng.sample(tokens, len(tokens))]
    df = spark.createDataFrame(rows, "doc_id long, sent_id int, i int, head_i int, dep string, pos string, is_space boolean, is_punct boolean").repartition(3)
    plan = nlp.document_metrics(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # no call a document
    want = {d: {n: pytest.approx(x) for n, x in walked(tokens).items()} for d, tokens in docs.items()}
    got = nlp.document_metrics(df).collect()
    assert len(got) == len(docs) and {r.doc_id: {n: r[n] for n in want[0]} for r in got} == want


def test_documents_are_measured_in_slices_of_bounded_size(monkeypatch):
    import pyarrow as pa

    from gristmill.operators import nlp

    monkeypatch.setattr(nlp, "TOGETHER", 20)
    sizes = [3, 9, 1, 19, 50, 2, 2, 45, 1]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(sizes))), "i": [list(range(n)) for n in sizes]})
    parts = [p["doc_id"].to_pylist() for p in nlp.documents_together(batch)]
    assert sum(parts, []) == list(range(len(sizes))) and len(parts) > 3 and all(sum(sizes[d] for d in p[1:]) < 20 for p in parts)
    assert list(nlp.documents_together(batch.slice(0, 0))) == []


def test_trees_deeper_than_the_limit_of_depth(spark):
    from gristmill.operators import nlp

    n = 1_500  # each token is headed by the next
    df = spark.range(n).selectExpr("1L as doc_id", "0 as sent_id", "id as i", f"least(id + 1, {n - 1}) as head_i", "'ccomp' as dep", "'X' as pos", "false as is_space", "false as is_punct")
    got = nlp.document_metrics(df).first()
    assert got["prompt_clause_length_mean"] == (n + 1) / 2 and got["prompt_clause_nesting_depth_mean"] == (n - 1) * (n - 2) / 2 / n
    circle = df.where("i < 10").withColumn("head_i", F.expr("(i + 1) % 10"))
    assert nlp.document_metrics(circle).first()["prompt_dep_depth_mean"] == nlp.DEEPEST
