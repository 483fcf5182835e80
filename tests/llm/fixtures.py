"""Small inputs that hold nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

DATA = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda omicron sigma".split()
#: Columns named as the operators name their own.
CLASH = ["row", "row_key", "fp", "n_lines", "n_removed", "kept_lines", "all_lines", "stays_at", "size", "copies", "mix_copies", "score", "toxicity", "text_in", "rid", "label", "bucket"]


def texts(n=40, seed=1):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(0, 12)))
    out = ["\n".join(line() for _ in range(r.randint(0, 5))) for _ in range(n)]
    out[3] = out[1]
    out[5] = out[1] + "\n"
    out[7] = None
    out[8] = ""
    out[9] = " \t\n\r\n \x0b"
    out[10] = "one long text of words " * 20_000
    out[11] = "x" * 100_000
    out[12] = "café naïve 日本語 \U0001f600\nGrüße"
    return out


def rows(n=40, seed=1):
    """(doc_id, text, lang, source, n_chars), with a null id, repeated ids and repeated rows."""
    out = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts(n, seed))]
    out[13] = (None, *out[13][1:])
    out[14] = (14, out[14][1], None, None, None)
    out[15] = (16, *out[15][1:])
    return [*out, out[20], out[20], (None, None, None, None, None)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def written(df, path):
    """df as a table that is read, as the operators ask for."""
    df.coalesce(3).write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def edge_docs(spark, path, clash=False, n=40):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(n), SCHEMA)
    if clash:
        df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    return written(df, path)


def empty_docs(spark, path):
    return written(spark.createDataFrame([], SCHEMA), path)


def plain(rows_, *cols):
    return sorted((tuple(r[c] for c in cols) for r in rows_), key=repr)
