"""Small tables with the awkward rows every operator must handle."""

import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """The same rows with columns that operators use inside."""
    from pyspark.sql import functions as F

    names = ["score", "held_out", "predicted", "rep", "component", "component_id", "token", "base", "spans", "key", "row", "length", "rank", "slot", "shard", "size", "digest", "lang_pred", "piece", "h", "n", "l"]
    return df.select("*", *(F.lit("x").alias(n) for n in names))


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id at all"), (5, "é" * 3 + " ß 中文 \U0001f600"), (6, "word " * 30_000), (7, "x" * 60_000)]


def learnable(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 != 2


def pmap(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
