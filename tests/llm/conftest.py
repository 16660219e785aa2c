from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, _id long, rep long, size string"


def words(rnd, n, vocabulary=400):
    return [rnd.choice("bdfgklmnprst") + f"{rnd.randrange(vocabulary):x}" + rnd.choice(["a", "en", "é", "ion", "."]) for _ in range(n)]


def corpus():
    """Rows with nulls, blanks, long texts, near and exact copies, shared passages, repeated rows and clashing extra columns."""
    rnd = random.Random(11)
    rows = []
    passage = " ".join(words(rnd, 60))
    base = words(rnd, 120)
    for i in range(60):
        w = words(rnd, rnd.randint(60, 160))
        if i % 4 == 0:
            w[20:20] = passage.split()
        if i % 5 == 0:
            w = base[:]
            for _ in range(rnd.randrange(0, 12)):
                w[rnd.randrange(len(w))] = words(rnd, 1)[0]
        rows.append((i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)), f"s{i % 4}" if i % 9 else None))
    rows += [(100, None, "s0"), (101, "", "s1"), (102, " \t\n", "s2"), (103, "one two", None), (104, "ONE two", "s3"), (105, " ".join(words(rnd, 20_000)), "s1"), (106, rows[3][1], "s2"), (None, rows[3][1], "s1"), (None, "unlike anything else here", None), (107, "été " * 200, "s2")]
    rows += [rows[7], rows[7]]
    rows += [(200 + i, rows[0][1], "s0") for i in range(25)]
    return [(d, t, "en", s, len(t or ""), -1, "k", 9, 8, "big") for d, t, s in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
