"""Metrics of dependency parses over a token table: one row per token, heads by position.

Input columns: doc_id, sent_id, i, head_i (a root is its own head), dep, pos, lemma, text, is_space, is_punct,
is_stop, is_alpha.  Any parser can fill it; ``plain_tokens`` is a small rule-based stand-in.  Documents are dealt
whole and many of them are measured at once, so that a walk in trees is some array steps for all their tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.text import cosine, jaccard, py_strip
from .ranking import adjacent
from .rollup import reuse

# Label sets of the metrics.
CLAUSE = ("ROOT", "ccomp", "xcomp", "advcl", "relcl", "acl")
COORDINATION = ("cc", "conj")
MODIFIER = ("amod", "compound", "poss", "nmod")
COMPETING = (*MODIFIER, *COORDINATION, "prep", "mark", *CLAUSE)
NOUN, VERB = ("NOUN", "PROPN"), ("VERB", "AUX")
BEFORE_NOUN = ("det", "amod", "compound", "poss", "nummod", "nmod")
DEEPEST = 512

#: Tokens that are measured together, besides one document of any size.
TOGETHER = 1 << 15

#: What the metrics tell apart in dep and pos, 0 for the rest; the last two are labels in other cases.
DEPS = (CLAUSE, ("prep",), ("cc",), ("conj",), ("mark",), ("compound",), tuple(d for d in MODIFIER if d != "compound"))
POSES = (NOUN, VERB, ("PRON",))
PREP_LIKE, CONJ_LIKE = len(DEPS) + 1, len(DEPS) + 2


def _code(column: Column, sets: Iterable[tuple[str, ...]], more: Iterable[tuple[Column, int]] = ()) -> Column:
    pairs = [(column.isin(*labels), k) for k, labels in enumerate(sets, 1)] + list(more)
    out = F.when(*pairs[0])
    for pair in pairs[1:]:
        out = out.when(*pair)
    return out.otherwise(0)


def _kind() -> Column:
    """dep, pos, is_space and is_punct of a token as one number."""
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int")
    dep = _code(F.col("dep"), DEPS, [(F.lower("dep") == "prep", PREP_LIKE), (F.lower("dep") == "conj", CONJ_LIKE)])
    return (dep + 16 * _code(F.col("pos"), POSES) + 64 * yes("is_space") + 128 * yes("is_punct")).cast("smallint")


def _changes(*codes: np.ndarray) -> np.ndarray:
    """Where a run of equal codes starts."""
    new = np.zeros(len(codes[0]), bool)
    new[:1] = True
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _top(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size)
    np.maximum.at(out, at, x.astype(float))  # far slower on numbers of two kinds
    return out


def _per(n, d) -> np.ndarray:
    n, d = np.asarray(n, float), np.asarray(d, float)
    return np.divide(n, d, out=np.zeros(n.shape), where=d > 0)


def climbed(up: np.ndarray, step: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each token's top, and the sum of ``step`` over the links from it to there, else their number; roots point to themselves.
    In each round a token looks twice as far; one below a circle ends on it."""
    inner = up != np.arange(len(up))
    sums = inner.astype("int64") if step is None else np.where(inner, step, 0).astype("int64")
    for _ in range(len(up).bit_length() + 1):
        if not inner[up].any():
            break
        sums, up = sums + sums[up], up[up]
    return up, sums


class Parses:
    """Tokens of whole documents as arrays, by document and place; ``up`` is each token's head as an array position."""

    def __init__(self, doc: np.ndarray, sent: np.ndarray, i: np.ndarray, head: np.ndarray, kind: np.ndarray) -> None:
        """``doc`` numbers documents, in ascending order; ``kind`` is ``_kind``."""
        same = doc[1:] == doc[:-1]
        if (same & (i[1:] <= i[:-1])).any():
            order = np.lexsort((i, doc))
            i, sent, kind, head = i[order], sent[order], kind[order], head[order]
            if (same & (i[1:] == i[:-1])).any():
                raise ValueError("two tokens of a document at one place")
        self.i, self.doc, self.docs, here = i, doc, int(doc.max(initial=-1)) + 1, np.arange(len(i))
        self.up = _heads(doc, i, head)
        self.root = self.up == here
        dep, pos = kind & 15, kind >> 4 & 3
        self.dep, self.word = dep, (kind & 64) == 0
        self.content = self.word & ((kind & 128) == 0)
        self.clause, self.prep, self.conj, self.mark, self.compound = dep == 1, dep == 2, dep == 4, dep == 5, dep == 6
        self.coord, self.mods = (dep == 3) | self.conj, (dep == 6) | (dep == 7)
        self.competing = (dep > 0) & (dep < PREP_LIKE)
        self.noun, self.verb, self.pron = pos == 1, pos == 2, pos == 3
        top, depth = climbed(self.up)
        circle = ~self.root[top]
        self.depth = np.where(circle, DEEPEST, np.minimum(depth, DEEPEST))
        # walks leave a circle of heads where it leads to a later token
        self.way = np.where(circle & (self.up > here), here, self.up)
        runs, sents = _changes(doc, sent), np.unique(sent)
        wide = max(len(sents), 1)
        names, numbers = np.unique(doc[runs] * wide + np.searchsorted(sents, sent[runs]), return_inverse=True)
        self.sent = np.repeat(numbers, np.diff(np.append(runs, len(i))))
        self.doc_of = names // wide
        self.words = np.bincount(self.sent[self.word], minlength=len(names))
        self.said = self.words > 0  # sentences that aren't blank
        self.sents = np.bincount(self.doc_of[self.said], minlength=self.docs)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """By document, as all metrics are."""
        return np.bincount(self.doc[mask], minlength=self.docs).astype(float)

    def mean(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return _per(np.bincount(self.doc[mask], x[mask], self.docs), self.count(mask))

    def most(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return _top(x[mask], self.doc[mask], self.docs)

    def of_sentences(self, x: np.ndarray) -> np.ndarray:
        """The mean of sentences' values."""
        return _per(np.bincount(self.doc_of[self.said], x[self.said], self.docs), self.sents)

    def in_sentences(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.sent[mask], x[mask], len(self.words))

    def depths(self) -> np.ndarray:
        """The greatest depth of each sentence's words."""
        return _top(self.depth[self.word], self.sent[self.word], len(self.words))

    def children(self, mask: np.ndarray, same_sentence: bool = True) -> np.ndarray:
        """Number of each token's children in ``mask``."""
        mask = mask & ~self.root & ((self.sent == self.sent[self.up]) | (not same_sentence))
        return np.bincount(self.up[mask], minlength=len(self.up))

    def subtrees(self) -> np.ndarray:
        """Words of each token's subtree in its sentence: each adds what those that point to it have so far, and points twice as far."""
        inner = (self.way != np.arange(len(self.way))) & (self.sent == self.sent[self.up])
        size, up = self.word.astype("int64"), np.where(inner, self.way, -1)
        live = np.flatnonzero(inner)
        while len(live):
            size = size + np.bincount(up[live], size[live], len(up)).astype("int64")
            up[live] = up[up[live]]
            live = live[up[live] >= 0]
        return size

    def nesting(self) -> np.ndarray:
        """Clause heads above each token; the root of its tree never counts."""
        return climbed(self.way, self.clause[self.up] & ~self.root[self.up])[1]

    def prep_runs(self) -> np.ndarray:
        return climbed(np.where(self.prep[self.up] & ~self.root[self.up], self.way, np.arange(len(self.way))))[1]

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of conjunct chains at the token that conj heads lead to, with its conjuncts, and where there are any."""
        top, mine = climbed(np.where(self.conj, self.way, np.arange(len(self.way))))[0], self.conj & self.word
        sizes = np.bincount(top[mine], minlength=len(top))
        return sizes + ~mine, sizes > 0

    def antecedents(self) -> np.ndarray:
        """The nouns before each token in its sentence."""
        order = np.argsort(self.sent, kind="stable")
        nouns, sent = (self.noun & self.word)[order], self.sent[order]
        before, out = np.cumsum(nouns) - nouns, np.empty(len(order), "int64")
        out[order] = before - before[np.searchsorted(sent, sent)]
        return out

    def distances(self) -> tuple[np.ndarray, np.ndarray]:
        return np.abs(self.i - self.i[self.up]), self.word & ~self.root


def _heads(doc: np.ndarray, i: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The array position of each token's head in its document, its own for one that isn't there."""
    here = np.arange(len(i))
    at = here + (head - i)  # where places have no gaps in between
    known = (at >= 0) & (at < len(i))
    at = np.where(known, at, here)
    lost = np.flatnonzero((doc[at] != doc) | (i[at] != head))
    if len(lost):
        places = np.unique(i)
        rank, asked = np.searchsorted(places, i), np.minimum(np.searchsorted(places, head[lost]), len(places) - 1)
        key, mine = doc * len(places) + rank, doc[lost] * len(places) + asked
        found = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        at[lost] = np.where((key[found] == mine) & (i[found] == head[lost]), found, lost)
    return at


def prompt_metrics(p: Parses) -> dict[str, np.ndarray]:
    w, n = p.word, np.maximum(p.sents, 1)
    count = lambda m: p.count(m & w)
    clauses, preps, conj = count(p.clause), count(p.prep), p.conj & w
    kids, competing = p.children(w), p.children(w & p.competing)
    (chains, tops), ante, prons, (dist, far) = p.chains(), p.antecedents(), p.pron & w, p.distances()
    runs, nest = 1 + p.prep_runs(), p.nesting()
    by_head = np.bincount(p.up[p.prep & w], minlength=len(w))
    return {
        "prompt_sent_count": n.astype(float), "prompt_clauses_per_sentence": _per(clauses, n),
        "prompt_content_tokens_per_sentence": _per(p.count(p.content), n), "prompt_clause_length_mean": p.mean(p.subtrees(), p.clause & w),
        "prompt_dep_depth_mean": p.of_sentences(p.depths()),
        "prompt_dep_distance_mean": p.mean(dist, far), "prompt_dep_distance_max": p.most(dist, far), "prompt_branching_factor_mean": p.mean(kids, w & (kids > 0)),
        "prompt_clause_nesting_depth_mean": p.mean(nest, p.clause & w), "prompt_clausal_branching_factor": p.mean(p.children(p.clause, False), p.clause & w),
        "prompt_coordination_density": _per(count(p.coord), np.maximum(clauses, 1)), "prompt_mean_conj_chain_len": p.mean(chains, tops), "prompt_max_conj_chain_len": p.most(chains, tops),
        "prompt_verb_coordination_ratio": _per(p.count(conj & p.verb[p.up]), p.count(conj)), "prompt_noun_coordination_ratio": _per(p.count(conj & p.noun[p.up]), p.count(conj)),
        "prompt_pp_density_per_noun": _per(preps, np.maximum(count(p.noun), 1)), "prompt_pp_density_per_clause": _per(preps, np.maximum(clauses, 1)),
        "prompt_mean_pp_chain_depth": p.mean(runs, p.prep & w), "prompt_max_pp_chain_depth": p.most(runs, p.prep & w), "prompt_multi_pp_head_ratio": _per(p.count(by_head >= 2), p.count(by_head > 0)),
        "prompt_attachment_competition_ratio": _per(count(competing >= 2), count(competing > 0)), "prompt_mean_competing_dependents_per_head": p.mean(competing, w & (competing > 0)),
        "prompt_pronoun_ratio": _per(p.count(prons), np.maximum(p.count(p.content), 1)), "prompt_pronouns_per_sentence": _per(p.count(prons), n),
        "prompt_pronoun_candidate_antecedent_density": p.mean(ante, prons), "prompt_multi_antecedent_pronoun_ratio": _per(p.count(prons & (ante >= 2)), p.count(prons)),
    }


def parse_metrics(p: Parses) -> dict[str, np.ndarray]:
    """The ``prompt_parse_*`` set: counts, sentence means and products; nesting starts at 1 here."""
    w = p.word
    count = lambda m: p.count(m & w)
    conj, noun = p.conj & w, p.noun & w
    kids, competing = p.children(w), p.children(w & p.competing)
    kind = np.array([5, 0, 1, 2, 2, 4, 3, 3, 5, 5])[p.dep]
    share = _per(np.bincount(6 * p.sent[w] + kind[w], minlength=6 * len(p.words)).reshape(-1, 6), p.words[:, None] + np.zeros(6))
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
    one, b, c, more = np.ones(len(w)), w & (kids > 0), w & (competing > 0), w & (competing >= 2)
    sums = p.in_sentences
    each = {
        "nodes": p.words, "depth": p.depths(), "branch": _per(sums(kids, b), sums(one, b)), "preps": sums(one, w & (p.prep | (p.dep == PREP_LIKE))), "conj": sums(one, w & (p.conj | (p.dep == CONJ_LIKE))),
        "ratio": _per(sums(one, more), sums(one, c)), "heads": _per(sums(competing, more), sums(one, more)), "entropy": entropy,
    }
    a = {k: p.of_sentences(v) for k, v in each.items()}
    clauses, preps, n, prons = count(p.clause), count(p.prep), p.sents.astype(float), count(p.pron)
    nouns, content, of_nouns = count(p.noun), p.count(p.content), count(p.mods & p.noun[p.up])
    modifiers, compound = p.children(p.mods, False), p.children(p.compound, False)
    nest, (chains, tops), ante, (dist, far) = 1 + p.nesting(), p.chains(), p.antecedents(), p.distances()
    runs, by_head = 1 + p.prep_runs(), np.bincount(p.up[p.prep & w], minlength=len(w))
    least = lambda x: np.maximum(x, 1)
    coord, per_noun, per_clause, mod, cps = _per(count(p.coord), least(clauses)), _per(preps, least(nouns)), _per(preps, least(clauses)), _per(of_nouns, least(nouns)), _per(clauses, least(n))
    out = {
        "sent_count": n, "avg_node_count": a["nodes"], "avg_tree_depth": a["depth"], "avg_branching_factor": a["branch"], "avg_pp_count": a["preps"], "avg_conjunction_count": a["conj"],
        "ambiguity": a["depth"] + a["branch"] + a["preps"] + a["conj"], "num_sentences": n, "num_tokens": p.count(w), "num_content_tokens": content, "num_nouns": nouns,
        "num_verbs": count(p.verb), "num_clauses": clauses, "num_preps": preps, "num_conjunctions": count(p.coord), "num_pronouns": prons, "num_nominal_modifiers": of_nouns,
        "num_subordinate_markers": count(p.mark), "coordination_density": coord,
        "verb_coordination_ratio": _per(p.count(conj & p.verb[p.up]), least(p.count(conj))), "noun_coordination_ratio": _per(p.count(conj & p.noun[p.up]), least(p.count(conj))),
        "max_conj_chain_len": p.most(chains, tops), "mean_conj_chain_len": p.mean(chains, tops), "pp_density_per_noun": per_noun, "pp_density_per_clause": per_clause,
        "max_pp_chain_depth": p.most(runs, p.prep & w), "mean_pp_chain_depth": p.mean(runs, p.prep & w), "multi_pp_head_ratio": _per(p.count(by_head >= 2), p.count(by_head > 0)),
        "modifiers_per_noun": mod, "max_modifiers_on_single_noun": p.most(modifiers, noun), "mean_modifiers_on_noun": p.mean(modifiers, noun),
        "compound_noun_ratio": _per(p.count(noun & (p.compound | (compound > 0))), least(nouns)), "pronoun_ratio": _per(prons, least(content)), "pronouns_per_sentence": _per(prons, least(n)),
        "pronoun_candidate_antecedent_density": p.mean(ante, p.pron & w), "multi_antecedent_pronoun_ratio": _per(count(p.pron & (ante >= 2)), least(prons)), "clauses_per_sentence": cps,
        "subordination_density": _per(count(p.mark), least(clauses)), "max_clause_nesting_depth": p.most(nest, p.clause & w), "mean_clause_nesting_depth": p.mean(nest, p.clause & w),
        "clausal_branching_factor": p.mean(p.children(p.clause, False), p.clause & w), "coordination_pp_interaction": coord * per_noun, "coordination_clause_interaction": coord * cps,
        "modifier_clause_interaction": mod * cps, "pp_clause_interaction": per_clause * cps, "attachment_competition_ratio": a["ratio"], "mean_competing_dependents_per_head": a["heads"],
        "long_dependency_ratio": _per(p.count(far & (dist > 5)), p.count(far)), "mean_dependency_distance": p.mean(dist, far), "max_dependency_distance": p.most(dist, far),
        "mean_dep_entropy_per_sentence": a["entropy"], "max_dep_entropy_per_sentence": _top(entropy[p.said], p.doc_of[p.said], p.docs), "available": (n > 0).astype(float),
    }
    return {f"prompt_parse_{k}": v for k, v in out.items()}


METRICS = {"prompt": prompt_metrics, "parse": parse_metrics}


def metric_names(kind: str) -> list[str]:
    return list(METRICS[kind](Parses(*[np.zeros(0, "int64")] * 5)))


def _slices(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """First document and number of each slice: one of any size, and others of less than ``TOGETHER`` tokens."""
    upto = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(upto // TOGETHER)) + 1), len(sizes)]
    return ((int(a), int(b - a)) for a, b in zip(cuts, cuts[1:]) if b > a)


def documents_together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The documents of ``batch``, lists of tokens, in slices."""
    return (batch.slice(a, n) for a, n in _slices(pc.list_value_length(batch["i"])))


def _measured(batch: pa.RecordBatch, metrics: Callable[[Parses], dict[str, np.ndarray]]) -> pa.RecordBatch:
    lists = [batch[c] for c in ("sent_id", "i", "head_i", "kind")]
    doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
    found = metrics(Parses(doc, *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)))
    return pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, found.values())], ["doc_id", *found])


def document_metrics(tokens: DataFrame, kind: str = "prompt") -> DataFrame:
    """One row per document with tokens: the metrics of ``kind``, "prompt" or "parse".

    Tokens are shuffled once and go to Python as lists, a row a document: rows cost more there than what they hold."""
    names, of = metric_names(kind), METRICS[kind]
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    place = F.coalesce(F.col("i").cast("long"), F.raise_error(F.lit("a token without a place")).cast("long"))
    # lists leave nulls out: a token without a head is a root, and those of no sentence are one
    rows = tokens.select("doc_id", F.coalesce(F.col("sent_id").cast("long"), F.lit(-(1 << 63))).alias("sent_id"), place.alias("i"), F.coalesce(F.col("head_i").cast("long"), F.col("i").cast("long")).alias("head_i"), _kind().alias("kind"))
    lists = rows.groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in ("sent_id", "i", "head_i", "kind")))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (_measured(part, of) for part in documents_together(batch))
        pa.default_memory_pool().release_unused()  # idle workers stay beside the executor

    return lists.mapInArrow(measured, f"doc_id {id_type}, " + ", ".join(f"{n} double" for n in names))


def lemma_overlaps(tokens: DataFrame) -> DataFrame:
    """Mean and least Jaccard similarity of lemma sets of neighbouring sentences, 0 for two empty ones."""
    real = ~F.col("is_stop") & ~F.col("is_space") & ~F.col("is_punct")
    lemma = F.nullif(F.lower(py_strip(F.col("lemma"))), F.lit(""))
    sets = tokens.groupBy("doc_id", "sent_id").agg(F.collect_set(F.when(real, lemma)).alias("lemmas"), F.bool_or(~F.col("is_space")).alias("__said")).where("__said")
    out = adjacent(sets, ["doc_id"], "sent_id", jaccard, "lemmas")
    return out.select("doc_id", F.col("mean").alias("prompt_adjacent_lemma_overlap_mean"), F.col("min").alias("prompt_adjacent_lemma_overlap_min"))


def sentence_similarities(vectors: DataFrame) -> DataFrame:
    """Mean and least cosine of neighbouring sentence vectors (doc_id, sent_id, vector)."""
    out = adjacent(vectors, ["doc_id"], "sent_id", cosine, "vector")
    return out.select("doc_id", F.col("mean").alias("prompt_sentence_embedding_sim_mean"), F.col("min").alias("prompt_sentence_embedding_sim_min"))


LINK, HEAD, HEADED = 1, 2, 4


def mention_token(i: Column, head_i: Column, dep: Column, pos: Column, lemma: Column, text: Column, is_alpha: Column, is_stop: Column) -> Column:
    """What mention spans need of a token; of its words the one that a key can hold."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    kept = yes(is_alpha & ~is_stop)
    bit = lambda c, n: F.when(c, n).otherwise(0)
    kind = bit(dep.isin(*BEFORE_NOUN) & (head_i > i), LINK) + bit(pos.isin(*NOUN, "PRON"), HEAD) + bit(head_i.isNotNull(), HEADED)
    return F.struct(
        i.cast("long").alias("i"), F.coalesce(head_i, i).cast("long").alias("head_i"), kind.cast("tinyint").alias("kind"), pos.alias("pos"),
        F.when(kept, F.lower(lemma)).alias("lemma"), F.when(yes(is_alpha) & ~(kept & yes(lemma != "")), F.lower(text)).alias("text"),
    )


def _mentions(lists: Sequence[pa.Array], named: pa.Array | None) -> pa.Array:
    """The spans of each document, from lists of its tokens' fields and named spans."""
    docs, flat = len(lists[0]), [x.flatten() for x in lists]
    doc, i = np.repeat(np.arange(docs), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)), flat[0].to_numpy(zero_copy_only=False)
    same = doc[1:] == doc[:-1]
    if (same & (i[1:] <= i[:-1])).any():
        order = np.lexsort((i, doc))
        flat, i = [x.take(pa.array(order)) for x in flat], i[order]
        if (same & (i[1:] == i[:-1])).any():
            raise ValueError("two tokens of a document at one place")
    head, kind, (pos, lemma, text) = *(x.to_numpy(zero_copy_only=False) for x in flat[1:3]), flat[3:]
    here = np.arange(len(i))
    top = climbed(np.where((kind & LINK) > 0, _heads(doc, i, head), here))[0]
    new = np.ones(len(i), bool)
    new[1:] = ~same | (i[1:] != i[:-1] + 1) | (top[1:] != top[:-1])
    runs = np.flatnonzero(new)
    last = np.flatnonzero(((kind & HEAD) > 0) & (top == here))  # a run of tokens that lead to it ends with it
    of, lo, hi, start, end = doc[last], runs[np.cumsum(new)[last] - 1], last + 1, i[runs[np.cumsum(new)[last] - 1]], i[last] + 1
    if named is not None and len(given := named.flatten()):
        whose, (a, b) = np.repeat(np.arange(len(named)), pc.list_value_length(named).to_numpy(zero_copy_only=False)), (given.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        edges = np.searchsorted(doc, np.arange(docs + 1))
        within = lambda x: np.array([edges[d] + np.searchsorted(i[edges[d] : edges[d + 1]], v) for d, v in zip(whose, x)], "int64")
        spans = np.concatenate([np.stack([of, start, end, lo, hi]), np.stack([whose, a, b, within(a), within(b)])], axis=1)
        of, start, end, lo, hi = np.unique(spans[:, spans[3] < spans[4]], axis=1)
    size = hi - lo
    span = np.repeat(np.arange(len(of)), size)
    at = np.arange(len(span)) - np.repeat(np.cumsum(size) - size - lo, size)
    outside = ((kind[at] & HEADED) > 0) & ((head[at] == i[at]) | (head[at] < start[span]) | (head[at] >= end[span]))
    hits = np.flatnonzero(outside)
    who, first = np.unique(span[hits], return_index=True)
    root = np.full(len(of), -1)
    root[who] = at[hits[first]]

    def joined(words: pa.Array) -> pa.Array:
        said = words.is_valid().to_numpy(zero_copy_only=False)[at]
        upto = np.append(0, np.cumsum(np.bincount(span[said], minlength=len(of))))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, "int32"), words.take(pa.array(at[said]))), " ")

    lemmas = joined(lemma)
    keys = pc.if_else(pc.equal(lemmas, ""), joined(text), lemmas)
    found = [pa.array(start), pa.array(end), pos.take(pa.array(root, mask=root < 0)), pa.array([k.strip() for k in keys.to_pylist()], "string")]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(docs + 1)), "int32"), pa.StructArray.from_arrays(found, ["start", "end", "root_pos", "key"]))


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("root_pos", StringType()), StructField("key", StringType())]))


def _in_slices(lists: Sequence[pa.Array], named: pa.Array | None = None) -> pa.Array:
    cuts = list(_slices(pc.list_value_length(lists[0])))
    parts = [_mentions([x.slice(a, n) for x in lists], None if named is None else named.slice(a, n)) for a, n in cuts]
    pa.default_memory_pool().release_unused()  # idle workers stay beside the executor
    return pa.concat_arrays(parts)


@F.arrow_udf(SPANS)
def _chunks(i: pa.Array, head_i: pa.Array, kind: pa.Array, pos: pa.Array, lemma: pa.Array, text: pa.Array) -> pa.Array:
    return _in_slices([i, head_i, kind, pos, lemma, text])


@F.arrow_udf(SPANS)
def _chunks_and_named(i: pa.Array, head_i: pa.Array, kind: pa.Array, pos: pa.Array, lemma: pa.Array, text: pa.Array, named: pa.Array) -> pa.Array:
    return _in_slices([i, head_i, kind, pos, lemma, text], named)


def mentions_of(docs: DataFrame, named: bool = False) -> DataFrame:
    """The ``mention_spans`` of each row of ``docs``: doc_id, distinct, tokens, a list of ``mention_token``, and if ``named``, named,
    a list of spans.  Rows stay where they are."""
    lists = [F.col("tokens")[c] for c in ("i", "head_i", "kind", "pos", "lemma", "text")]
    # what may not be deterministic is kept out of filters that are inferred below an explode, and so is found once
    spans = _chunks_and_named.asNondeterministic()(*lists, "named") if named else _chunks.asNondeterministic()(*lists)
    return docs.select("doc_id", spans.alias("spans")).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.root_pos", "s.key")


def mention_spans(tokens: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, root_pos, key) of each distinct span: noun chunks, and ``entities`` (doc_id, start, end) of any
    recogniser.  A noun chunk is the run of tokens up to each noun or pronoun that isn't itself a modifier of a later token, as
    far as tokens lead to it by links of modifiers to later heads; a token that doesn't, a blank one too, ends the run.  A key
    is the lower-cased lemmas, in order, of the words that aren't stop words, else all words' texts; a span's root is its first
    token with a head outside.

    Tokens are shuffled once, with entities, and go to Python as lists, a row a document."""
    place = F.coalesce(F.col("i").cast("long"), F.raise_error(F.lit("a token without a place")).cast("long"))
    token = mention_token(place, *map(F.col, ("head_i", "dep", "pos", "lemma", "text", "is_alpha", "is_stop")))
    rows, lists = tokens.select("doc_id", token.alias("token")), [F.collect_list("token").alias("tokens")]
    if entities is not None:
        own, span = tokens.schema["doc_id"].dataType, F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        rows = rows.unionByName(entities.where("start < end").select(F.col("doc_id").cast(own).alias("doc_id"), span.alias("named")), allowMissingColumns=True)
        lists.append(F.collect_list("named").alias("named"))
    found = mentions_of(rows.groupBy("doc_id").agg(*lists), entities is not None)
    return found.withColumns({c: F.col(c).cast(tokens.schema["i"].dataType) for c in ("start", "end")})


def prompt_features(docs: DataFrame, tokens: DataFrame, count=None, vectors: DataFrame | None = None, entities: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """doc_id and the 33 prompt metrics of each row of ``docs`` (doc_id, distinct, and a text): 0 for what a document
    lacks, and all 0 for a blank or null text.  ``count`` is a function from a text column to its number of tokens
    (``text.token_count``), ``vectors`` has (doc_id, sent_id, vector), ``entities`` (doc_id, start, end)."""
    blank = py_strip(F.coalesce(F.col(text_col), F.lit(""))) == ""
    size = (count(F.col(text_col)) if count else F.lit(0)).cast("double")
    out = docs.select("doc_id", (~blank).alias("__said"), F.when(~blank, size).otherwise(0.0).alias("prompt_len_bpe"))
    parts = [document_metrics(tokens), lemma_overlaps(tokens), mention_reuse(mention_spans(tokens, entities))]
    if vectors is not None:
        parts.insert(2, sentence_similarities(vectors))
    for part in parts:
        named = part.withColumnRenamed("doc_id", "__d")
        out = out.join(named, out["doc_id"] == named["__d"], "left").drop("__d")
    zero = F.lit(0.0)
    return out.select("doc_id", *(F.when(F.col("__said"), F.coalesce(F.col(n).cast("double"), zero)).otherwise(zero).alias(n) if n in out.columns else zero.alias(n) for n in prompt_names()))


def prompt_names() -> list[str]:
    """The 33 names, in order."""
    similar = [f"prompt_{what}_{how}" for what in ("adjacent_lemma_overlap", "sentence_embedding_sim") for how in ("mean", "min")]
    return ["prompt_len_bpe", *metric_names("prompt"), *similar, "prompt_entity_reuse_ratio", "prompt_coref_chain_len_mean"]


def mention_reuse(mentions: DataFrame) -> DataFrame:
    """From (doc_id, start, end, root_pos, key): spans once each, without pronouns and empty keys."""
    real = mentions.dropDuplicates(["doc_id", "start", "end"]).where((F.coalesce(F.col("root_pos"), F.lit("")) != "PRON") & (F.col("key") != ""))
    out = reuse(real, ["doc_id"], "key")
    return out.select("doc_id", F.col("reuse_ratio").alias("prompt_entity_reuse_ratio"), F.col("chain_len_mean").alias("prompt_coref_chain_len_mean"))


def mention_summary(mentions: DataFrame) -> DataFrame:
    """Of distinct spans, in one pass over them: the columns of ``mention_reuse`` (null without a span that counts there), with
    the number and tokens of all spans and the key used most, of equals the last."""
    real = (F.coalesce(F.col("root_pos"), F.lit("")) != "PRON") & (F.col("key") != "")
    by_key = mentions.groupBy("doc_id", F.when(real, F.col("key")).alias("key")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("end") - F.col("start")).alias("n"))
    c = F.when(F.col("key").isNotNull(), F.col("c"))
    return by_key.groupBy("doc_id").agg(
        F.sum("c").alias("n_spans"), F.sum("n").alias("n_words"), F.try_divide(F.sum(c - 1), F.sum(c)).alias("prompt_entity_reuse_ratio"), F.avg(c).alias("prompt_coref_chain_len_mean"),
        F.max_by("key", F.when(c.isNotNull(), F.struct("c", "key"))).alias("most"),
    )


def plain_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A token table by rules, without a parser: sentences at . ! ? and newlines, every token headed by its
    sentence's first.  Its counts of sentences and tokens are real; its dependencies are not."""
    sents = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"), F.lit(0))).alias("sent_id", "s"))
    words = sents.select("doc_id", "sent_id", F.posexplode(F.regexp_extract_all("s", F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))).alias("k", "text"))
    word = (F.length("text") > 1) | F.col("text").rlike(r"(?U)^\w")  # what isn't a word is one character
    first = F.col("sent_id").cast("long") * F.lit(1 << 32)  # a text has fewer tokens
    i = first + F.col("k")
    return words.select(
        "doc_id", "sent_id", i.alias("i"), first.alias("head_i"), F.when(F.col("k") == 0, "ROOT").otherwise("dep").alias("dep"),
        F.when(word, "X").otherwise("PUNCT").alias("pos"), F.lower("text").alias("lemma"), "text", F.lit(False).alias("is_space"), (~word).alias("is_punct"), F.lit(False).alias("is_stop"), word.alias("is_alpha"),
    )
