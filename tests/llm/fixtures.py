"""Small tables with every awkward case: nulls, blanks, ties, repeated rows, long texts, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = "the of and to in is was for on that with as his they at be this from have or by one had not but what all were when we there can an your which".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "ly", "ed"]) for _ in range(n))


def rows():
    rng = random.Random(42)
    out = [(k, "\n".join(prose(rng, rng.randint(4, 30)) for _ in range(rng.randint(1, 6)))) for k in range(40)]
    base = out[3][1]
    words = base.split(" ")
    out += [(100, base), (101, base), (102, base.upper()), (103, base + " tail"), (104, " ".join(words[1:])), (105, " ".join(words[: len(words) // 2]))]
    out += [(200, None), (201, ""), (202, "  \n\t "), (203, "word"), (204, "word"), (205, "\n\n"), (206, "ß é ☃ 漢字")]
    out += [(300, prose(rng, 30_000)), (301, "x" * 200_000), (302, "a b " * 20_000)]
    out += [(7, out[7][1]), (7, out[7][1])]  # repeated rows
    out += [(400, "same line here for all\n" + prose(rng, 20)), (401, "same line here for all\n" + prose(rng, 20)), (402, "Same  line here for ALL")]
    return out


def documents(spark, given=None):
    given = rows() if given is None else given
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 2}", None if t is None else len(t)) for i, t in given], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """The same table with further columns whose names the operators use inside."""
    names = ["score", "kept", "key", "node", "hub", "set_hash", "text_hash", "sig", "n", "line_no", "held_out", "predicted", "spans", "trusted", "root", "y", "idx", "__gone", "ids", "start"]
    return df.withColumns({c: F.lit("clash") for c in names})


def labels(spark, given):
    return spark.createDataFrame(given, "doc_id bigint, quality int, toxic int")
