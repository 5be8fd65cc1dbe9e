"""Repository names in texts and in nested JSON.

A JSON document is first laid out as (key, text) pairs, in Arrow batches; which names a text gives is then a column
expression that knows nothing of JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .text import py_strip

# Parts of names, makers of synthetic repositories, and the keys under which texts and ids are searched.
PART = "[A-Za-z0-9_.-]+"
SHA = "[0-9a-fA-F]{7,40}"
MAKERS = ("swesmith", "sweb.eval", "swerebench")
TEXT_KEYS = ("body", "content", "description", "message", "messages", "problem_statement", "prompt", "text")
ID_KEYS = ("base_repo", "id", "instance_id", "task_id", "trajectory_id")
#: Levels of nesting that are searched below a document.
DEEPEST = 4

SYNTHETIC = "(?:" + "|".join(m.replace(".", r"\.") for m in MAKERS) + r")\.x86_64\."


def names_in(value: Column, key: Column) -> Column:
    """Distinct ``owner/repo`` names that ``value``, found under ``key`` (lower case), gives; null gives none.

    It may be a plain name or end in an address of one, but for synthetic repositories; be the encoded name
    of an image; hold addresses, under a key of texts; or be an instance id, under a key of ids.
    """
    bare = py_strip(value)
    plain = F.regexp_extract(bare, rf"\A({PART}/{PART})\z", 1)
    address = F.regexp_extract(bare, rf"(?i)github\.com[:/]({PART}/{PART}?)(?:\.git)?\z", 1)
    one = F.when(plain != "", plain).otherwise(address)
    real = F.when(~F.substring_index(one, "/", -1).rlike("^" + SYNTHETIC), one)
    image = rf"(?i)\A{PART}/{SYNTHETIC}({PART})_\d+_({PART})\.{SHA}\z"
    instance = rf"\A(?:swesmith/)?({PART})__({PART})\.{SHA}\z"
    joined = lambda pattern: F.when(bare.rlike(pattern), F.concat_ws("/", F.regexp_extract(bare, pattern, 1), F.regexp_extract(bare, pattern, 2)))
    mentioned = F.regexp_extract_all(value, F.lit(rf"(?di)(?:https?://|git@)github\.com[:/]({PART}/{PART})(?:\.git)?(?:[/?#:]|$)"), F.lit(1))
    singles = F.array(real, joined(image), F.when(key.isin(*ID_KEYS), joined(instance)))
    found = F.concat(singles, F.when(key.isin(*TEXT_KEYS), mentioned).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "")))


def _pairs(text: str | None) -> list[tuple[str, str]]:
    """Keys and texts of a document, level by level; JSON within a text is a level of its own."""

    def parsed(s: str):
        s = s.strip()
        if s and s[0] in "[{" and s[-1] in "]}":
            try:
                return json.loads(s)
            except ValueError:
                pass
        return None

    def entries(nodes: list) -> Iterator[tuple[str | None, object]]:
        for node in nodes:
            yield from node.items() if isinstance(node, dict) else ((None, x) for x in node)

    try:
        level, found = [json.loads(text or "null")], []
    except ValueError:
        return []
    for _ in range(DEEPEST + 1):
        below = []
        for key, value in entries([n for n in level if isinstance(n, (dict, list))]):
            if isinstance(value, str):
                if key is not None:
                    found.append((key.lower(), value))
                    below.append(parsed(value))
            else:
                below.append(value)
        level = below
    return found


@F.pandas_udf(ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType())])))
def json_texts(docs: pd.Series) -> pd.Series:
    """All texts under keys of each JSON document, with their keys in lower case; null or broken documents have none."""
    return pd.Series([[{"key": k, "value": v} for k, v in _pairs(text)] for text in docs], dtype=object)


def repos_in_json(doc: Column | str) -> Column:
    """Sorted names in a JSON document."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    return F.array_sort(F.array_distinct(F.flatten(F.transform(json_texts(doc), lambda p: names_in(p["value"], p["key"])))))
