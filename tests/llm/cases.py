"""Rows with every awkward case the contracts name."""

import random

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil jugs of fine mint tea near river stones"
CLASHES = "id long, n long, fp string, bucket string, cluster string, size string, target string, h long, chunk long, pi double, label int, " \
          "score string, _score string, _base string, _cands string, _key string, _copies int, _n int, row_key string, value string, links int, turns int"


def texts(seed: int = 1, n: int = 60) -> list:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(200)]
    out = [None, "", " \n\t ", "one", "one two three four", "one two three four", PROSE, PROSE, PROSE + " !", LONG, "\n\n" + PROSE + "\n" + PROSE]
    for _ in range(n):
        ws = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        out.append(" ".join(ws))
        if r.random() < 0.5:
            near = list(ws)
            for _ in range(r.randint(0, 3)):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            out.append(" ".join(near))
    return out


def documents(spark, seed: int = 1, clashes: bool = False):
    """Documents with nulls in any column, repeated rows and, if wanted, clashing extra columns."""
    r = random.Random(seed)
    rows = []
    for i, t in enumerate(texts(seed)):
        rows.append((i if i % 17 != 3 else None, t, r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", "c", None]), len(t) if t else None))
    rows += [rows[6], rows[20], rows[20]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clashes:
        from pyspark.sql import functions as F
        for part in CLASHES.split(", "):
            name, kind = part.split()
            df = df.withColumn(name, F.lit(None).cast(kind) if name in ("id", "n") else F.lit("7").cast(kind))
    return df


def no_rows(df):
    return df.filter("1 = 0")
