"""Small fixtures: null, empty, long, tied and repeated rows, and columns whose names clash with the operators' own."""

import random

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
CLASHES = ["row", "r", "id", "key", "sha", "fp", "size", "rate", "copies", "bucket", "score", "t", "words", "kept"]


def texts() -> list[str]:
    return [x or "" for x in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()]


def edge_rows() -> list[tuple]:
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["alpha", "beta,", "gamma", "delta.", "épée", "zeta"]) + str(rng.randrange(50))
                             for _ in range(n))
    long_, copy, near = say(30_000), say(120), say(300)
    passage = say(120)
    rows = [(1, None, "s1"), (2, "", "s1"), (3, "   \n\t ", None), (4, copy, "s2"), (5, copy, "s2"), (5, copy, "s2"),
            (None, copy, "s2"), (None, None, None), (6, long_, "s3"), (7, near, "s3"), (8, near + " one", "s3"),
            (9, "Á b\x00 <|endoftext|> don't", ""), (10, "word", "s1"), (10, "word", "s1"),
            (11, say(60) + passage + say(60), "s1"), (12, passage + say(50), "s4"), (13, "x" * 900, "s4")]
    rows += [(100 + i, say(40), "hot") for i in range(20)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def edge(spark):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), *["x"] * len(CLASHES))
                                  for i, t, s in edge_rows()], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
