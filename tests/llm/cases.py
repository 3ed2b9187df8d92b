"""Small tables with the awkward rows that every operator must take."""

import random

LONG = "alpha beta gamma delta " * 20000
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, node long, size long, label int, w double"


def words(n, seed, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward():
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), None, "", " \n\t ", "one", "one two", base.upper(), LONG, words(90, 2), "été à Noël   x", "a b c d e f", "a b c d e f g", words(60, 3) + "\n" + words(60, 3), "\x1c\x1d word", "$$$ ### 12 34", "<|im_end|> <\\|x"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s3"][i % 4], None if t is None else len(t), "t", 5, 7, 1, 0.5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], rows[6]]  # repeated rows
    rows.append((None, words(80, 9), "en", "s1", 1, "t", 1, 1, 1, 1.0))
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOC_SCHEMA)
