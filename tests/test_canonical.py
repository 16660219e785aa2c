"""JSON texts in one form, against the standard library; the index's strings."""

from __future__ import annotations

import hashlib
import json
import random
import struct

from pyspark.sql import functions as F

from tracewell.functions.canonical import canonical_json, json_fingerprint
from tracewell.functions.regexes import LONG, strings
from tracewell.operators.batches import grams

TEXTS = [
    "1", "1.0", "-0", "-0.0", "1e5", "1E-7", "1.50", "123456789012345678901234567890", "1e16", "1e15", "0.0001", "0.00001", "1e999", "5e-324", "2e-3", "2.0e23", "8.41e21", "9007199254740993.0", "null", "true", '""', "[]", "{}", " [ 1 , 2.5,null ] ", "0.1", "100.0", "1e22", "123456.789e3", "9.999999999999999e22",
    '{"b": {"z": [1, {"y": "x,:\\" \\\\", "a": null}], "a": false}, "a": "\\u00e9\\u0000 \\u00005 \\u001f\\u000B\\u007f \\/ \\\\u001F \\n\\t"}', '{"é": 1, "e": 2, "E": 3, "": 4, "10": 5, "9": [[]]}', '"\\\\"', '["\\\\\\"", "1", "-5", "\\u0000-1", "\\u0000\\u00002"]', '{"1": {"2": 3}}',
]
WRONG = ["", "{", "01", "[1,]", "nul", '{"a": 1, "a": 2}', "'a'", '"\x01"', '"a', "[1 2]"]


def test_canonical_json(spark):
    rnd = random.Random(4)
    doubles = [struct.unpack("d", rnd.randbytes(8))[0] for _ in range(4000)] + [rnd.uniform(-1000, 1000) for _ in range(2000)] + [round(rnd.uniform(-1e6, 1e6), 2) * 10.0 ** rnd.randint(-25, 25) for _ in range(3000)]
    texts = [*TEXTS, *(repr(x) for x in doubles if x == x and "inf" not in repr(x)), "[" + ",".join(f'{{"k{i}":"{"x" * i}","a":{i}.5}}' for i in range(1500)) + "]", json.dumps("\\\"," * 100_000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts + WRONG + [None])], "i int, t string").select("i", canonical_json(F.col("t")).alias("c"), json_fingerprint(F.col("t")).alias("f")).collect()
    got = {r["i"]: r for r in got}
    bad = []
    for i, t in enumerate(texts):
        want = json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False)
        if got[i]["c"] != want or got[i]["f"] != hashlib.sha256(want.encode()).hexdigest():
            bad.append((t[:80], got[i]["c"] and got[i]["c"][:80], want[:80]))
    assert not bad, (len(bad), bad[:10])
    assert [t for i, t in enumerate(WRONG, len(texts)) if got[i]["c"] is not None] == []


def test_index_has_what_patterns_need(spark):
    texts = ["", "ab", "abc", "some longer line of words\nand another one, naïve and 😀 too", "x" * 50, "one\n\ntwo\r\nthree and four"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", grams(F.col("t")).alias("g")).collect():
        want = {g for line in r["t"].split("\n") for g in strings(line)}
        assert want <= set(r["g"]) and len(set(r["g"])) == len(r["g"])
    assert any(len(g) == LONG for g in strings(texts[3]))
