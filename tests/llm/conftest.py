import os
import random

import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"

#: Columns whose names operators use inside.
CLASHING = ["h", "c0", "score", "kind", "slice", "n", "sha", "part", "crc", "doc", "possible", "evidence", "starts", "toxicity_score"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)
WORDS = "the of and river mountain stone letter garden window morning quiet market bridge silver paper engine".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "s"]) for _ in range(n))


def rows(seed=1, n=40):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(n)]
    passage = prose(rng, 40)
    texts = list(base)
    texts += [base[0]] * 5 + [base[1], base[1] + " more", base[2].replace("the", "a", 1), base[3] + " end", "x " + base[3]]
    texts += [f"{b[:60]} {passage} {b[60:]}" for b in base[:6]]
    texts += [None, None, "", "", " \n\t", "a", "é" * 130, "ab" * 700, "Shti " * 300, "über naïve 中文 🙂 " * 30, prose(rng, 9000)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [out[4], out[4], (None, base[5]), (None, None), (7, "another text under an id that is there already " * 4), (-3, base[6])]
    return [(i, t, ["en", "de", None][k % 3], "s", len(t or ""), *["x"] * len(CLASHING)) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def edge_rows():
    return rows()


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("needs the driver tables")
    return FOLDER
