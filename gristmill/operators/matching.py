"""Matching runs to source rows: ranked candidate keys in one equi-join, and a blocked fuzzy join of filtered pairs."""

from __future__ import annotations

import difflib
import json
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import ids
from ..functions.text import py_strip


def index_by(df: DataFrame, key: Column, row: str = "row_index", last: bool = False) -> DataFrame:
    """key to the first (or last) row index; null and empty keys are left out."""
    pick = F.max(row) if last else F.min(row)
    return df.select(key.alias("key"), row).where(F.col("key").isNotNull() & (F.col("key") != "")).groupBy("key").agg(pick.alias(row))


def _names(row: str | Sequence[str]) -> list[str]:
    return [row] if isinstance(row, str) else list(row)


def cascade(rows: DataFrame, row: str | Sequence[str], keys: Sequence[Column], indexes: Sequence[DataFrame]) -> DataFrame:
    """(row, row_index, step): the match of each row by the first of its keys that its index has.

    All candidate keys are exploded with their rank and joined at once; no match, no row.  Rows alike in ``row`` and keys are as
    many rows of the result: each of them meets the same steps, so their number is that of matches by that of steps met.
    """
    names = _names(row)
    candidates = F.array(*(F.struct(F.lit(i).alias("step"), k.alias("key")) for i, k in enumerate(keys)))
    asked = rows.select(*names, candidates.alias("__keys")).withColumn("c", F.explode("__keys")).select(*names, "__keys", "c.step", "c.key").where(F.col("key").isNotNull())
    have = None
    for i, index in enumerate(indexes):
        part = index.select(F.lit(i).alias("step"), "key", "row_index")
        have = part if have is None else have.unionByName(part)
    found = asked.join(have, ["step", "key"])
    alike = (F.count(F.lit(1)) / F.bit_count(F.bit_or(F.expr("shiftleft(1, step)")))).cast("int")
    best = found.groupBy(*names, "__keys").agg(F.min_by(F.struct("row_index", "step"), "step").alias("m"), alike.alias("__alike"))
    return best.withColumn("m", F.explode(F.array_repeat("m", F.col("__alike")))).select(*names, "m.row_index", "m.step")


@pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of casefolded texts, with the library's own shortcuts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(a=x.casefold(), b=y.casefold()).ratio() for x, y in zip(a, b)], dtype="float64")


#: Candidates share a rare run of GRAM characters; kinds of runs and of characters are counted in so many hash bins.
GRAM, GRAM_BINS, LETTER_BINS = 3, 1 << 12, 64


def most_edits(length: Column, least: float) -> Column:
    """How many characters may be in only one of two texts, one of this length, whose ratio is above ``least``."""
    return F.ceil(length * (2.0 * (1.0 - least) / least) + 1e-9).cast("int")


GRAMS = ArrayType(StructType().add("gram", StringType()).add("nth", IntegerType()))


#: So many characters of texts are laid out at a time, which bounds what a Python worker holds.
LAID_OUT = 1 << 15


@pandas_udf(StructType().add("size", IntegerType()).add("letters", ArrayType(IntegerType())).add("grams", GRAMS))
def text_parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Of each casefolded text: its length, its characters by hash bin, and its runs of GRAM characters, the ends marked, equal
    runs told apart by their number."""
    for batch in batches:
        folded = batch.str.casefold()
        for _, texts in folded.groupby(folded.str.len().cumsum() // LAID_OUT, sort=False):
            rows = []
            for text in texts:
                marked, seen, grams = "\x02" * (GRAM - 1) + text + "\x03" * (GRAM - 1), Counter(), []
                for i in range(len(text) + GRAM - 1):
                    gram = marked[i : i + GRAM]
                    grams.append({"gram": gram, "nth": seen[gram]})
                    seen[gram] += 1
                rows.append((len(text), _letters(text).tolist(), grams))
            yield pd.DataFrame(rows, columns=["size", "letters", "grams"])


def _letters(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") % LETTER_BINS, minlength=LETTER_BINS)


def _bin(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BINS)).cast("int")


def _rarest(texts: DataFrame, often: Column, least: float) -> DataFrame:
    """Of distinct (block, text) the parts, with as many of the rarest grams as one unmatched text could break, and one more."""
    ranked = F.transform("grams", lambda g: F.struct(F.get(often, _bin(g["gram"])).alias("n"), g["gram"].alias("gram"), g["nth"].alias("nth")))
    return _parts(texts).withColumn("grams", F.slice(F.array_sort(ranked), F.lit(1), GRAM * most_edits(F.col("size"), least) + 1))


def _parts(texts: DataFrame) -> DataFrame:
    return texts.select("block", "text").distinct().withColumn("p", text_parts("text")).select("block", "text", "p.*")


def _frequencies(texts: DataFrame) -> Column:
    """How often each of the GRAM_BINS bins of grams occurs, counted here: a constant array that only orders grams."""
    seen = _parts(texts).select(F.explode("grams").alias("g")).groupBy(_bin(F.col("g.gram")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.bin: r.n for r in seen.collect()}
    return F.from_json(F.lit(json.dumps([counts.get(b, 0) for b in range(GRAM_BINS)])), "array<bigint>")


def near_texts(left: DataFrame, right: DataFrame, least: float = 0.97) -> DataFrame:
    """Distinct pairs (block, q, c) of texts of two tables (block, text) that may have a ratio above ``least``; no pair of such
    a ratio is missing.

    A ratio above ``least`` leaves less than ``1 - least`` of both texts' characters unmatched.  So the lengths differ
    little; nearly all characters, counted by kind, are in both; and as each unmatched one breaks at most ``GRAM`` runs,
    one of the rarest runs of either is among the rarest of the other.  Candidates come from an
    equi-join by block and rare run, so a block is no unit of work; the bounds on a pair are column expressions.  Where ``least`` is too
    low for the argument about runs, texts of a block meet by the other bounds alone.
    """
    often = _frequencies(right)
    asked, ours = _rarest(left, often, least), _rarest(right, often, least)
    a = asked.select("block", F.col("text").alias("q"), F.col("size").alias("a_size"), F.col("letters").alias("a_letters"), F.col("grams").alias("g"))
    c = ours.select("block", F.col("text").alias("c"), F.col("size").alias("c_size"), F.col("letters").alias("c_letters"), F.col("grams").alias("g"))
    whole = F.col("a_size") + F.col("c_size")
    near = (2.0 * F.least("a_size", "c_size") > least * whole - 1e-9) | (whole == 0)
    if GRAM * 2.0 * (1.0 - least) / least < 1.0:
        by_run = lambda t: t.withColumn("g", F.explode("g")).withColumns({"gram": F.col("g.gram"), "nth": F.col("g.nth")}).drop("g")
        x, y = by_run(a), by_run(c)
        kept = (x["block"] == y["block"]) & (x["gram"] == y["gram"]) & (x["nth"] == y["nth"]) & near
        pairs = x.join(y, kept).select(x["block"], "q", "c", "a_size", "c_size", "a_letters", "c_letters")
    else:
        x, y = a.drop("g"), c.drop("g")
        pairs = x.join(y, (x["block"] == y["block"]) & near).select(x["block"], "q", "c", "a_size", "c_size", "a_letters", "c_letters")
    common = F.aggregate(F.zip_with("a_letters", "c_letters", lambda m, n: F.least(m, n)), F.lit(0), lambda s, n: s + n)
    return pairs.where((2.0 * common > least * whole - 1e-9) | (whole == 0)).select("block", "q", "c").distinct()


#: Units of the search within blocks: texts asked for and candidates that meet in one.
ASKED, CANDIDATES = 1024, 1 << 14
#: Rare runs are worth a join while they are at most this share of a text's runs.
FEW_RUNS = 0.25


def _nearest_of_unit(least: float):
    def nearest(asked: pd.DataFrame, ours: pd.DataFrame) -> pd.DataFrame:
        """The best candidate of each text asked for: candidates go by a bound of their ratio, by characters of a kind, until it is
        no more than a ratio that was found."""
        ours = ours.sort_values("row_index")
        folded = [c.casefold() for c in ours["text"]]
        size, letters = np.array([len(c) for c in folded], "int64"), np.array([_letters(c) for c in folded], "uint16").reshape(len(folded), LETTER_BINS)
        found = []
        for text in asked["text"]:
            q = text.casefold()
            whole = size + len(q)
            bound = np.where(whole > 0, 2.0 * np.minimum(letters, _letters(q).astype("uint16")).sum(1, dtype="int64") / np.maximum(whole, 1), 1.0)
            near = np.flatnonzero(bound > least)
            top, at = least, None
            for i in near[np.argsort(-bound[near], kind="stable")]:
                if bound[i] < top:
                    break
                if at is not None and bound[i] == top and i > at:
                    continue
                ratio = difflib.SequenceMatcher(a=q, b=folded[i]).ratio()
                if ratio > top or (ratio == top and at is not None and i < at):
                    top, at = ratio, i
            if at is not None:
                found.append((asked["block"].iloc[0], text, int(ours["row_index"].iloc[at]), top))
        return pd.DataFrame(found, columns=["block", "text", "row_index", "ratio"])

    return nearest


def _nearest_in_blocks(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(block, text, row_index, ratio) of distinct texts: those of a block meet in units of bounded size, whatever the block's."""
    asked = left.select("block", "text").distinct()
    many = lambda t, most, out: t.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(out))
    units = many(asked, ASKED, "parts").join(many(right, CANDIDATES, "chunks"), "block")
    dealt = lambda t, n: t.join(units, "block").withColumn("own", F.pmod(F.xxhash64("text"), F.col(n)).cast("int"))
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = dealt(asked, "parts").select("block", "text", F.col("own").alias("part"), other("chunks").alias("chunk"))
    c = dealt(right, "chunks").select("block", "text", "row_index", F.col("own").alias("chunk"), other("parts").alias("part"))
    schema = StructType([left.schema["block"], StructField("text", StringType()), StructField("row_index", LongType()), StructField("ratio", DoubleType())])
    unit = ["block", "part", "chunk"]
    return a.groupBy(*unit).cogroup(c.groupBy(*unit)).applyInPandas(_nearest_of_unit(least), schema)


def fuzzy(rows: DataFrame, row: str | Sequence[str], query: Column, block: Column, base: DataFrame, candidate: Column, base_block: Column, least: float = 0.97) -> DataFrame:
    """(row, row_index, ratio): within equal blocks the candidate of the greatest ratio above ``least``, of ties the
    first.  Rows and candidates of a null text or block match nothing.  Equal texts of a block are compared once: those that
    ``near_texts`` pairs, or where ``least`` is too low for rare runs to tell texts apart, by bounds in units of a block."""
    names = _names(row)
    left = rows.select(*names, query.alias("text"), block.alias("block")).where("text is not null and block is not null")
    right = base.select("row_index", candidate.alias("text"), base_block.alias("block")).where("text is not null and block is not null")
    right = right.groupBy("block", "text").agg(F.min("row_index").alias("row_index"))
    best = F.min_by(F.struct("row_index", "ratio"), F.struct(-F.col("ratio"), F.col("row_index")))
    if GRAM * 2.0 * (1.0 - least) / least < FEW_RUNS:
        pairs = near_texts(left, right, least).withColumn("ratio", similarity_ratio("q", "c")).where(F.col("ratio") > least)
        found = pairs.join(right.withColumnRenamed("text", "c"), ["block", "c"]).withColumnRenamed("q", "text")
    else:
        found = _nearest_in_blocks(left, right, least).withColumn("row_index", F.col("row_index").cast(right.schema["row_index"].dataType))
    found = found.groupBy("block", "text").agg(best.alias("m"))
    return left.join(found, ["block", "text"]).select(*names, "m.row_index", "m.ratio")


def resolve_commits(runs: DataFrame, base: DataFrame, owners: Sequence[str] = ()) -> DataFrame:
    """Runs (trajectory_id, image) to base rows (commit_hash, repo_name): the commit with the image's repository,
    then with that of the id."""
    at = lambda commit, repo: F.when(commit.isNotNull() & repo.isNotNull(), F.concat_ws("\n", commit, repo))
    commit = ids.commit_of(F.col("trajectory_id"), F.col("image"))
    of_run = ids.repo_of_run(F.col("trajectory_id"), owners)
    index = index_by(base, at(F.lower("commit_hash"), F.lower("repo_name")))
    rows = runs.where("trajectory_id is not null and image is not null")
    return cascade(rows, "trajectory_id", [at(commit, F.coalesce(ids.repo_of_image(F.col("image")), of_run)), at(commit, of_run)], [index, index])


def resolve_mirrors(runs: DataFrame, base: DataFrame) -> DataFrame:
    """Runs to base rows (instance_id): the id itself, its pull-request form whatever the case, its form without
    separators, its repository and sha (first row).  Of instances alike but for case or separators the last counts."""
    t, inst = F.col("trajectory_id"), F.col("instance_id")
    first = index_by(base, inst).select(F.col("key").alias("instance_id"), "row_index")
    indexes = [index_by(base, inst), index_by(first, F.lower(inst), last=True), index_by(first, ids.separator_free(inst), last=True), index_by(first, ids.repo_sha_of_instance(inst))]
    return cascade(runs, "trajectory_id", [ids.without_run(t), F.lower(ids.pull_instance(t)), ids.separator_free(ids.without_run(t)), ids.repo_sha_of_run(t)], indexes)


def resolve_instances(runs: DataFrame, base: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Runs (trajectory_id, image) to (source, row_index, step): by id, by the image's instance whatever the case, by
    the most similar id of the same owner and repository; what is left, likewise in ``second``."""
    t, inst, run = F.col("trajectory_id"), F.col("instance_id"), ["trajectory_id", "image"]
    without = lambda rows, found: rows.join(found, rows["trajectory_id"].eqNullSafe(found["trajectory_id"]) & rows["image"].eqNullSafe(found["image"]), "left_anti")
    done, left = None, runs.where("trajectory_id is not null")
    for source, table in enumerate([base] + ([second] if second is not None else [])):
        first = index_by(table, inst).select(F.col("key").alias("instance_id"), "row_index")
        exact = cascade(left, run, [ids.without_incomplete(t), F.lower(ids.instance_of_image(F.col("image")))], [index_by(table, inst), index_by(first, F.lower(inst), last=True)])
        near = fuzzy(without(left, exact), run, F.lower(ids.without_incomplete(t)), ids.owner_repo(ids.without_incomplete(t)), first, F.lower(inst), ids.owner_repo(inst))
        found = exact.unionByName(near.select(*run, "row_index", F.lit(2).alias("step"))).withColumn("source", F.lit(source))
        done = found if done is None else done.unionByName(found)
        left = without(left, found)
    return done.drop("image")


def find_trees(wanted: DataFrame, trees: DataFrame) -> DataFrame:
    """(repo, commit) to the first file, by name, of a snapshot of the repository with a compatible sha; the file of
    just that commit goes first."""
    start = lambda c: F.left(F.lower(py_strip(F.col(c))), F.lit(ids.SHORTEST_SHA))  # noqa: E731  compatible ones begin alike
    have = trees.select("repo", "commit_sha", "file", start("commit_sha").alias("__start"))
    pairs = wanted.withColumn("__start", start("commit")).join(have, ["repo", "__start"]).where(ids.sha_compatible(F.col("commit_sha"), F.col("commit")))
    order = F.struct((F.lower(F.trim("commit_sha")) != F.lower(F.trim("commit"))).alias("other"), F.col("file"))
    return pairs.groupBy("repo", "commit").agg(F.min_by("file", order).alias("file"))
