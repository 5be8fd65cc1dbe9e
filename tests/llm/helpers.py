"""Rows with every odd case: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ODD = [
    (1, "The first line here.\nshared line of text\nlast one", "en", "a", 10), (2, "Other words stand.\nSHARED line of text \nend", "en", "b", 11), (2, "Other words stand.\nSHARED line of text \nend", "en", "b", 11),
    (3, None, None, None, None), (4, "", "en", "", 0), (5, LONG, "xx", "a", len(LONG)), (6, "é ü  tabs\tand\nlines \n\n", "fr", "a", 3), (None, "shared line of text", "en", None, None), (7, "shared line of text", None, "b", 1),
    (-8, " ", "en", "c", 1), (9, "<|endoftext|> x", "en", "c", 1),
]
#: Names that operators use themselves.
CLASHING = ["key", "h", "size", "target", "score", "slot", "shard", "start", "id", "t", "n", "epoch", "block", "class_id", "media", "n_lines", "rank", "text_crc32"]


def odd(spark):
    return spark.createDataFrame(ODD, DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)


def clashing(spark):
    from pyspark.sql import functions as F

    return odd(spark).withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def rows(df, *columns):
    got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(got, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])
