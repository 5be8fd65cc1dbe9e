"""What the review of round 4 found."""

import random

import pyarrow as pa

from gristmill.operators import nlp, patch
from gristmill.plans import proxy

from .test_findings_r03 import same_as_sql, with_tables


def mentions(tokens, named):
    """Spans of one document, token by token, from (i, head, dep, pos, lemma, text, alpha, stop)."""
    at = {t[0]: t for t in tokens}
    up = {i: t[1] if t[2] in nlp.BEFORE_NOUN and (t[1] or 0) > i and t[1] in at else i for i, t in at.items()}

    def top(i):
        return i if up[i] == i else top(up[i])

    spans = {(a, b) for a, b in named if any(a <= i < b for i in at)}
    for i in at:
        if up[i] == i and at[i][3] in (*nlp.NOUN, "PRON"):
            start = i
            while start - 1 in at and top(start - 1) == i:
                start -= 1
            spans.add((start, i + 1))
    for a, b in spans:
        inside = [at[i] for i in sorted(at) if a <= i < b]
        roots = [t[3] for t in inside if t[1] is not None and (t[1] == t[0] or not a <= t[1] < b)]
        lemmas = " ".join(t[4].lower() for t in inside if t[6] and t[7] is False and t[4] is not None)
        yield a, b, roots[0] if roots else None, (lemmas or " ".join(t[5].lower() for t in inside if t[6] and t[5] is not None)).strip()


def test_mentions_of_documents_are_found_together(spark):
    rng, docs, names = random.Random(5), {}, {}
    for d in [*range(50), None]:
        places = sorted(rng.sample(range(60), rng.choice([1, 2, 9, 40])))
        docs[d] = [
            (i, rng.choice([i, i + 1, i + 1, i + 2, None, 99, *places]), rng.choice(["det", "amod", "compound", "ROOT", None]), rng.choice(["NOUN", "PRON", "VERB", "", None]),
             rng.choice(["Car", "new", "", None]), rng.choice(["Cars", "New", "", None]), rng.choice([True, True, False, None]), rng.choice([True, False, False, None])) for i in places
        ]
        names[d] = [tuple(rng.sample(range(62), 2)) for _ in range(rng.choice([0, 0, 3]))]
    names[77] = [(0, 5)]  # without tokens
    rows = [(d, *t) for d, tokens in docs.items() for t in rng.sample(tokens, len(tokens))]
    df = spark.createDataFrame(rows, "doc_id int, i int, head_i int, dep string, pos string, lemma string, text string, is_alpha boolean, is_stop boolean").repartition(3)
    entities = spark.createDataFrame([(d, *n) for d, found in names.items() for n in found], "doc_id int, start int, end int")
    for named in (None, entities):
        want = sorted(map(repr, ((d, *s) for d, t in docs.items() for s in mentions(t, names[d] if named else []))))
        assert sorted(repr(tuple(r)) for r in nlp.mention_spans(df, named).collect()) == want


def test_mentions_are_found_in_slices_of_bounded_size(monkeypatch):
    sizes = [3, 0, 9, 1, 19, 50, 2, 0]
    lists = [pa.array([[f(k) for k in range(n)] for n in sizes], pa.list_(kind)) for f, kind in (
        (int, pa.int64()), (lambda k: k + k % 3, pa.int64()), (lambda k: nlp.HEADED + (nlp.LINK if k % 3 else nlp.HEAD), pa.int8()), (lambda k: "NOUN", pa.string()), (str, pa.string()), (lambda k: None, pa.string()),
    )]
    whole, seen, real = nlp._in_slices(lists), [], nlp._mentions
    monkeypatch.setattr(nlp, "TOGETHER", 20)
    monkeypatch.setattr(nlp, "_mentions", lambda x, named: seen.append(sum(map(len, x[0].to_pylist()))) or real(x, named))
    assert nlp._in_slices(lists).to_pylist() == whole.to_pylist() and len(seen) > 2 and sum(seen) == sum(sizes)


def test_mentions_of_texts_need_no_row_a_token(spark, sf):
    plan = proxy.queries()["g19_f31_mentions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # what is shuffled is counted by key
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("partial_sum") and "Join" not in plan and "posexplode" not in plan


def test_means_between_two_rounded_values_are_the_sql_s(spark, sf, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.randrange(11) / 100, flag, 20.0) for k in range(200) for flag in "AR" for _ in range(64)]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_returnflag string, l_quantity double")
    same_as_sql("j8_full_outer_rank", spark, with_tables(spark, sf, tmp_path, lineitem=lines))


def test_patches_are_counted_by_sections(spark):
    text = "+def before():\n" + "diff --git a/x.py b/x.py\r\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +5,3 @@\n+  \n+one\n+def f(a):\x0b+ if a:\n-\tasync def f (\n@@ -9 +2 @@\n+two\n" + "diff --git a/x.py b/x.py\n@@ -1 +30 @@\n+class K\n+def g(\n"
    out = patch.patch_features(spark.createDataFrame([(1, text)], "patch_id long, patch string"))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # state by lines
    r = out.first()
    assert (r.patch_num_files_changed, r.patch_num_hunks, r.patch_lines_added, r.patch_lines_deleted) == (2, 3, 8, 1)
    assert (r.ast_num_functions_modified, r.ast_num_classes_modified, r.cfg_conditionals_added, r.ast_syntax_node_change_count) == (2, 1, 1, 6)
    # in hunks from a definition on: 3 and 1 lines; starts 5, 2 and 30
    assert (r.func_avg_changed_lines_per_touched_function, r.patch_hunk_gap_mean, r.func_avg_hunk_span_modified) == (2.0, 14.0, 5 / 3)
