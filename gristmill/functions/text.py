"""String functions with Python's semantics, and counters over issue texts, as column expressions."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# What the features count.
ISSUE_BLOCK = r"(?is)<issue_description>\s*(.*?)\s*</issue_description>"
BULLET = r"(?U)^\s*(?:[-*]|\d+\.)\s+"
ERROR_KEYWORD = r"(?i)(Error|Exception|Traceback|failed|raises)"
FILE_PATH = r"(?Ui)(?:(?:/[\w.\-]+)+|[\w.\-]+(?:/[\w.\-]+)+)\.(?:py|js|ts|java|go|rb|php|c|cpp|h|hpp|md|txt|json|yaml|yml|toml|ini|cfg)\b"
IDENTIFIER = r"(?U)\b[A-Za-z_][A-Za-z0-9_]*\b"
CALL_LIKE = r"(?U)\b[A-Za-z_][A-Za-z0-9_]*\s*\("
PHASE = r"(?Ui)\bphase\s+\d+\b"
FENCE = r"^[ \t]*```"
RUN_SUFFIX = r"_run\d+$"

_SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def py_strip(c: Column) -> Column:
    """str.strip: all Unicode white space, and the separators x1c to x1f."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def py_lines(c: Column) -> Column:
    """str.splitlines: no line for '', none after a final line end."""
    bare = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.get(F.transform(F.array(F.split(c, LINE_END, -1)), bare), 0)  # the text is split once


def blank(c: Column) -> Column:
    """Whether str.strip leaves nothing; a look up to the first other character."""
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def missing_text(c: Column) -> Column:
    """Null, blank or the text "nan"."""
    return c.isNull() | blank(c) | c.rlike(rf"(?Ui)\A{_SPACE}*nan{_SPACE}*\z")


def first_text(*cols: Column) -> Column:
    """The first column whose stripped text is neither empty nor "nan"; '' if none."""
    return F.coalesce(*(F.when(~missing_text(c), py_strip(c)) for c in cols), F.lit(""))


def unless_blank(a: Column, b: Column) -> Column:
    """``a`` unless it is null or blank, else ``b``."""
    return F.when(a.isNotNull() & (py_strip(a) != ""), a).otherwise(b)


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0.0 where d isn't positive."""
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def ratio_or_null(n: Column, d: Column) -> Column:
    return F.when(d > 0, n.cast("double") / d.cast("double"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[/:]", "__")


def plot_name(c: Column, most: int = 120) -> Column:
    """Runs of characters beyond word characters of any script, dot and dash become an underscore; at most ``most``."""
    return F.left(F.regexp_replace(c, r"(?U)[^\w.-]+", "_"), F.lit(most))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def lines_matching(c: Column, pattern: str) -> Column:
    return F.size(F.filter(py_lines(c), lambda s: s.rlike(pattern)))


def text_counters(c: Column) -> dict[str, Column]:
    """The counters of an issue text, by name; a null text counts like an empty one."""
    t = F.coalesce(c, F.lit(""))
    unfenced = F.regexp_replace(t, r"```[\s\S]*?```", "")
    return {
        "prompt_char_count": F.length(t), "prompt_line_count": F.size(py_lines(t)),
        "prompt_code_block_count": matches(t, FENCE), "prompt_fence_line_count": lines_matching(t, FENCE),
        "prompt_bullet_count": lines_matching(t, BULLET),
        "prompt_has_error_keyword": t.rlike(ERROR_KEYWORD).cast("int"), "prompt_error_line_count": lines_matching(t, ERROR_KEYWORD),
        "prompt_file_path_mention_count": matches(t, FILE_PATH), "prompt_inline_code_count": matches(unfenced, r"`[^`\n]+`"),
        "prompt_code_identifier_count": matches(t, IDENTIFIER), "prompt_function_call_like_count": matches(t, CALL_LIKE),
        "prompt_phase_count": matches(t, PHASE),
    }


def word_tokens(c: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def identifiers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(IDENTIFIER), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 when both are empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """0 for arrays of different or no length, or of norm 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot / n).otherwise(F.lit(0.0))


def token_count(tokenizer):
    """A pandas UDF that counts the tokens of each text; ``tokenizer`` makes, on the worker, a function from a
    text to its token ids.  Null and empty texts have none."""
    @pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = tokenizer()
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return count


@lru_cache(maxsize=4)
def _ranked(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_pairs(path: str, pattern: str):
    """For ``token_count``: byte-level pairs by a file of ranks (a token in base64 and its rank a line), read once a worker from
    a path that all have; ``pattern`` splits a text first.  Names of special tokens are plain text."""
    return lambda: _ranked(path, pattern).encode_ordinary
