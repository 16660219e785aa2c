"""The corpus queries over the smallest tables, against SQL or brute force, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import all_spans, contamination, kneser_ney, neardup, quality, repeats, secret_spans, UP, WORD
from compare import oracle_rows, spark_rows

from tracewell.llm import queries
from tracewell.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == oracle_rows(queries.ORACLE_SQL[name], SF)


def rows_of_documents(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def test_op1(spark):
    want = neardup(rows_of_documents(spark), 3, 85)
    got = queries.QUERIES["op1_neardup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_op4(spark):
    """Every column, the guessed spans too."""
    from tracewell.llm import secrets

    got = {r["doc_id"]: r for r in queries.QUERIES["op4_secrets"](spark, SF).collect()}
    rows = rows_of_documents(spark)
    assert len(got) == len(rows)
    for d, t in rows:
        base = secret_spans(t)
        counts = tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        assert (got[d]["n_assign"], got[d]["n_access"], got[d]["n_hex"]) == counts
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert got[d]["spans"] == ",".join(all_spans(t, secrets.dictionary().rank, secrets))


def test_op6(spark):
    got = queries.QUERIES["op6_substrings"](spark, SF).collect()
    assert Counter(tuple(r) for r in got) == Counter(repeats([(d, (t or "").encode()) for d, t in rows_of_documents(spark)], 100))


def test_op7(spark):
    from tokenizers import Tokenizer

    from tracewell.llm import tokens

    tk = Tokenizer.from_file(tokens.tokenizer_path())
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op7_tokens"](spark, SF).collect()}
    at = 0
    for d, t in sorted(rows_of_documents(spark)):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_op8(spark):
    from tracewell.llm import lm

    rows = [(d, WORD.findall((t or "").translate(UP))) for d, t in rows_of_documents(spark)]
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    p = kneser_ney([w for d, w in rows if not out(d)], lm.discounts, lm.ORDER)
    count = Counter(w for d, t in rows if not out(d) for w in [*t, None])
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_lm"](spark, SF).collect()}
    for d, t in rows:
        line, r = [*[""] * (lm.ORDER - 1), *t, None], got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(d), len(t) + 1, sum(count[w] > 0 for w in [*t, None]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*t, None]))
        assert r["score"] == pytest.approx(sum(math.log10(p(line[i : i + lm.ORDER - 1], line[i + lm.ORDER - 1])) for i in range(len(t) + 1)))


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, blanks, repeats and clashing columns go through all stages, and so does an empty table."""
    import corpus_pipeline as p

    rnd = random.Random(3)
    stop = "the of and to in a is that it for was with as on be".split()
    rows = [(i, None if i == 7 else "" if i == 8 else " ".join(rnd.choice(stop) if rnd.random() < 0.4 else f"w{rnd.randrange(4000)}" for _ in range(90)), "en", None if i % 5 == 0 else f"s{i % 3}", 1, 2, "k") for i in range(40)]
    rows += [(100 + i, rows[0][1], "en", "s1", 1, 2, "k") for i in range(3)] + [(None, rows[1][1], None, None, None, 2, "k"), rows[2], rows[2], (None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, _row string"
    for name, some in (("full", rows), ("none", rows[:0])):
        folder = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        table(spark, SF, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
        docs = table(spark, folder, "documents")
        sizes = []
        for i, (_, stage) in enumerate(p.STAGES):
            columns = docs.columns
            docs = written(stage(spark, docs, folder))
            assert i == len(p.STAGES) - 1 or docs.columns == columns
            sizes.append(docs.count())
        # Blank rows fail the rules; one document of each group stays, and the row without an id.
        assert sizes[:3] == ([44, 39, 39] if some else [0, 0, 0]) and sizes[3] == sizes[4]


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    seen = []
    for name, stage in p.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = written(stage(spark, docs, SF))
        after = docs.collect()
        ids = sorted(r["doc_id"] for r in after)
        if name == "quality_rules":
            assert not any(quality(r["text"])[-1] for r in after)
            assert len(after) >= 0.9 * sum(not quality(t)[-1] for _, t in before)
        elif name == "near_dedup":
            assert ids == sorted({c for _, c in neardup(before, 5, 80).values()})
        elif name == "decontamination":
            assert ids == sorted(d for d, t in before if not contamination(t, items)[-1])
        elif name == "mix_sources":
            assert set(ids) <= {d for d, _ in before} and max(ids.count(d) for d in set(ids)) <= 2
        else:
            assert ids == sorted(d for d, _ in before)
        seen.append(len(after))
    assert seen[0] >= seen[1] >= seen[2] > 0 and seen[3] == seen[4]
