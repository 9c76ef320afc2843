"""Small tables and plain re-computations for the tests of this folder."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k}" for k in range(30_000))
ODD_TEXTS = [None, "", " \n\t ", "one", "one two", "a b c d e f", "a b c d e f", "É́ Σσς İstanbul ﬁ ½. don't!", "<|endoftext|>. x", LONG, LONG, "p\x85q\xa0r s\x1ct", "#"]


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "a b c d e f", None, None, None), (None, None, None, None, None), (3, "one", "en", "s", 3)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("shard", "size", "rep", "token", "part", "row", "word", "group", "component", "judged", "n", "score", "secrets"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def classes_of(links, nodes):
    """Smallest id reachable, by repeated relabelling."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
