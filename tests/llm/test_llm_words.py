"""Token alignment, prefix counts and spelling variants against brute force and the tokenizers' own libraries."""

from __future__ import annotations

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from brute import alignment as plain_alignment, one_edit, token_bytes, variants as plain_variants, vocabulary as plain_vocabulary
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracewell.llm import alignment, prefixes, queries, variants
from tracewell.llm.common import table
from tracewell.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path(alignment.A_FILE), tokenizer_path(alignment.B_FILE)
ODD = [
    "a", " ", "  a", "a  ", "\n\n\nfoo \n bar\n", "don't they'll we've I'm x're 're '' 'r 've", "<|endoftext|>", "a <|endoftext|>b <|endoft", "<|endoftext|><|endoftext|> x", "<s>x</s> <unk> <0x41>",
    "naïve café 你好 世界 🤖🤖 \u2003x\u00a0y\x85z\x1c \x1d", "e\u0301 \u200b x\ufeff", "====" * 40, "ab" * 700, "x" * 300, "a\u2581b", "\u2581", "\x00\x01 \x00", "\t\tif x:\r\n\t\t\treturn  1  \r\n", "1234567890 12 3a4", "!!!??? ... 'll'll", "word\nword\n\n word \n\n\n  word",
]


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def bag(rows):
    return Counter(tuple(r) for r in rows)


ORDER = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op11(spark):
    got = queries.QUERIES["op11_alignment"](spark, SF).select(*ORDER).collect()
    assert bag(got) == Counter(plain_alignment(documents(spark), A, B))


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Odd texts, repeated rows, null ids and texts, clashing columns."""
    texts = [*ODD, None, "", *ODD[:6], *(r[1] for r in rows[:20]), " ".join(r[1] or "" for r in rows)]
    data = [(None if i in (3, 5) else i // 2, t, 1, b"x", "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id int, text string, block int, key binary, n_a string").repartition(3)


@pytest.mark.parametrize("size", [1, 40, alignment.BLOCK_GROUPS])
def test_alignment_odd(odd, size):
    """Whatever the blocks."""
    got = alignment.measured(alignment.aligned(odd, block_groups=size)).select(*ORDER).collect()
    assert bag(got) == Counter(plain_alignment([r[:2] for r in odd.collect()], A, B))


def test_alignment_last_space(spark):
    """A text may end with one space, whatever comes before it."""
    rows = list(enumerate(["a ", "word word ", "x\n ", "x.  y ", "\u4f60 ", "a" * 70 + " ", "a\u2581 ", "a"]))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = alignment.measured(alignment.aligned(docs)).select(*ORDER).collect()
    assert bag(got) == Counter(plain_alignment(rows, A, B))
    assert [r["doc_id"] for r in got if not r["n_a"]] == [6]


def test_alignment_forgets(monkeypatch, odd):
    """Numbers of groups start anew at a block, words and pieces are dropped: the blocks' tables say the same."""
    rows = [r[:2] for r in odd.collect()]

    def said(limit):
        monkeypatch.setattr(alignment, "KNOWN_GROUPS", limit)
        align, out = alignment.Aligner(A, B), []
        align.known.limit = align.a.words.limit = 10 if limit < 100 else 10**6
        for d, t in rows:
            block = alignment._Block(align)
            block.add(d, t)
            out += [r[:6] for r in block.rows(0) if r[8] is None]
            out.append(sorted((r[9], r[10]) for r in block.rows(0) if r[8] is not None))
        return out

    assert said(5) == said(10**9)


def test_alignment_calls():
    """What is new in a text takes one call of each tokenizer, what is known none."""
    align, texts = alignment.Aligner(A, B), []
    a, b = align.a, align.b
    align.a = lambda text: texts.append("A") or a(text)
    align.b = SimpleNamespace(encode=lambda text, **more: texts.append("B") or b.encode(text, **more))
    text = " ".join(f"w{i}x\u00e9 {i}" for i in range(500)) + " " + "y" * 100
    first = align(text)
    assert sorted(texts) == ["A", "B"]
    short = text[: text.rindex(" ")]
    assert align(short).tolist() == first[: len(align(short))].tolist() and sorted(texts) == ["A", "B"]
    assert align(f"{text} new\n").tolist()[: len(first)] == first.tolist() and len(texts) == 4
    assert not len(align(f"{short} a\u2581b other")) and align(f"{short} other").tolist()[: len(align(short))] == align(short).tolist()


def test_alignment_empty(empty):
    assert alignment.measured(alignment.aligned(empty)).count() == 0
    assert alignment.best_matches(empty).count() == 0


def test_token_bytes():
    align = alignment.Aligner(A, B)
    assert align.a_bytes[:-1] == token_bytes(A)[:-1] and align.b_bytes == token_bytes(B)
    with pytest.raises(ValueError):
        alignment.Aligner(tokenizer_path("word_bpe_49k.json"), B)


def test_best_matches(spark):
    docs = spark.createDataFrame([(1, "the the world"), (2, "the")], "doc_id int, text string")
    rows = {(bytes(r["b_bytes"]), bytes(r["a_bytes"])): r["count"] for r in alignment.best_matches(docs).collect()}
    assert rows[b" the", b" the"] == 3 and rows[b" world", b" world"] == 1
    by_docs = {(bytes(r["b_bytes"]), bytes(r["a_bytes"])): r["count"] for r in alignment.best_matches(docs, weight="in_docs").collect()}
    assert by_docs[b" the", b" the"] == 2
    with pytest.raises(ValueError):
        alignment.best_matches(docs, weight="other")


def test_groups_of_key():
    align = alignment.Aligner(A, B)
    keys = [align.keys[i] for i in align("tokenization of it")]
    assert [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in map(alignment.ids_of, keys)] == keys
    assert all(b"".join(align.a_bytes[i] for i in a) == b"".join(align.b_bytes[i] for i in b) for a, b in map(alignment.ids_of, keys))
    assert len(align("x\u2581y")) == 0


def test_op12(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(A)
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_token_counts"](spark, SF).collect()}
    rows = documents(spark)
    assert len(got) == len(rows)
    for d, t in rows:
        n, r = len(tk.encode(t or "", add_special_tokens=False).ids), got[d]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 1024)
        fit = r["n_fit"]
        if n <= 1024:
            assert fit == len(t or "")
        else:
            assert len(tk.encode(t[:fit], add_special_tokens=False).ids) <= 1024 < len(tk.encode(t[: fit + 1], add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def byte_level():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(A)
    return prefixes.ByteLevel(A), lambda s: len(tk.encode(s, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def pieces():
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=B)
    return prefixes.Pieces(B), lambda s: len(m.encode(s))


@pytest.mark.parametrize("kind", ["byte_level", "pieces"])
def test_every_prefix(kind, request, rows):
    count, library = request.getfixturevalue(kind)
    for t in [*ODD, *(r[1][:400] for r in rows[:12])]:
        steps = count(t)
        assert len(steps) == len(t)
        assert np.cumsum(steps).tolist() == [library(t[: i + 1]) for i in range(len(t))], t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c\n\t'rvels.!1<|éñ你🤖\u00a0\u2581 tionTHe", max_size=60))
def test_any_prefix(byte_level, pieces, text):
    for count, library in (byte_level, pieces):
        assert np.cumsum(count(text)).tolist() == [library(text[: i + 1]) for i in range(len(text))]


def test_counts_are_stored(spark, odd, empty):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(A)
    rows = odd.select("doc_id", "text").collect()
    stored = prefixes.prefix_counts(odd)
    got = stored.collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == Counter((d, len((t or "").encode()), len(tk.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    cut = prefixes.truncated(odd, 7)
    assert cut.columns == odd.columns
    assert all(len(tk.encode(r["text"] or "", add_special_tokens=False).ids) <= 7 for r in cut.collect())
    assert sum(r["text"] is None for r in cut.collect()) == 1
    fits = prefixes.within(stored, [0, 7, 10**9]).collect()
    assert all(r["fits"][0] <= r["fits"][1] <= r["fits"][2] for r in fits)
    places = spark.createDataFrame([(4, 1), (4, 10**6), (4, None), (4, 0), (-1, 3)], "doc_id int, place long")
    one = prefixes.prefix_counts(spark.createDataFrame([(4, "a <|endoftext|>b")], "doc_id int, text string"))
    assert bag(prefixes.tokens_at(one, places).collect()) == bag([(4, 1, 1), (4, 10**6, None), (4, None, None), (4, 0, 0)])
    assert prefixes.prefix_counts(empty).count() == 0 and prefixes.truncated(empty, 3).count() == 0
    for bad in ([], [-1]):
        with pytest.raises(ValueError):
            prefixes.within(stored, bad)
    with pytest.raises(ValueError):
        prefixes.counter(tokenizer_path("word_bpe_49k.json"))


def test_packed():
    for steps in ([], [1, -1], [127, -128], [128], [-129], [2**15], [-(2**31)]):
        stored = prefixes.packed(np.array(steps, dtype=np.int32))
        assert prefixes.unpacked(stored).tolist() == [0, *np.cumsum(np.array(steps, dtype=np.int64)).tolist()]
    assert prefixes.longest_within(np.array([0, 1, 2, 1, 3]), 1) == 3  # counts may fall


def test_op13(spark):
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.QUERIES["op13_variants"](spark, SF).collect()}
    assert got == plain_variants(plain_vocabulary(documents(spark)))
    assert any(f for f, *_ in got.values())


@pytest.mark.parametrize("bits,slab", [(27, 2**20), (16, 64)])
def test_variants(spark, monkeypatch, bits, slab):
    """Dense neighbours, runs of equal letters, a very long word, chains of forms, ties; with a full filter and small slabs too."""
    monkeypatch.setattr(variants, "FILTER_BITS", bits)
    monkeypatch.setattr(variants, "SLAB", slab)
    rnd = random.Random(5)
    count = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))): rnd.randint(1, 60) for _ in range(600)}
    count |= {"aaaaaa": 5, "aaaaa": 9, "é÷×ÿa": 3, "é÷×ÿ": 7, "x" * 3000: 2, "x" * 2999: 8, "😀ab": 1, "😀a": 2, "": 4}
    count |= {"z" * k: 2**k for k in range(10, 20)}
    want = plain_variants(Counter(count))
    given_rows = [(w, n) for w, n in count.items()] + [(None, 5)]
    got = variants.variant_groups(spark.createDataFrame(given_rows, "word string, n long"))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == want
    assert want["z" * 10][1] == "z" * 19


def test_neighbourhood_is_whole_and_distinct():
    full = np.full(2**16 // 64, 2**64 - 1, dtype=np.uint64)
    for w in ("aabba", "a", "", "abcab"):
        points = np.array([[ord(c) for c in w]], dtype="<u4").reshape(1, len(w))
        got = [c for _, c in variants.neighbourhood([w], points, "abc", full, 16)]
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + x + w[i:] for i in range(len(w) + 1) for x in "abc"} | {w[:i] + x + w[i + 1 :] for i in range(len(w)) for x in "abc"} - {w}
        assert len(got) == len(set(got)) and set(got) == want - {w}
        assert all(one_edit(w, c) for c in got)


def test_vocabulary(spark, odd, empty):
    rows = [(d, t) for d, t in odd.select("doc_id", "text").collect()] + [(1, "ABÉ× abÉ× ×÷×÷× Hello hellO hello " * 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = variants.vocabulary(docs, change=variants.misspelt)
    assert {r["word"]: r["n"] for r in got.collect()} == dict(plain_vocabulary(rows))
    every = variants.vocabulary(docs, change=lambda w: F.col("word"))
    assert {r["word"]: r["n"] for r in every.collect()} == dict(plain_vocabulary(rows, 2**40))
    assert variants.variant_groups(variants.vocabulary(empty)).count() == 0
