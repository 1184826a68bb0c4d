from __future__ import annotations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwood.functions import hashing as H
from tarnwood.functions import text as T
from tarnwood.functions import vectors as V


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first()[0]


def test_words_and_ngrams(spark):
    assert one(spark, "Iechä a_1, B", T.words("text")) == ["Iech", "a_1", "B"]
    assert one(spark, None, T.terms("text")) == []
    raw = "aéb".encode()
    assert one(spark, "aéb", T.byte_ngrams("text", 3, 5)) == [raw[i : i + k].hex().upper() for k in (3, 4, 5) for i in range(len(raw) - k + 1)]
    assert one(spark, "ab!", T.bounded_ngrams("text", 3, 3)) == ["3C6162", "61623E"]
    assert one(spark, "abcd", T.grams_of(F.col("text"))) == ["abc", "bcd", "abcd"]


def test_sentences_and_fields(spark):
    assert one(spark, " One.  Two?!\n\nThree ", T.sentences("text")) == ["One", "Two", "Three"]
    assert one(spark, "The the x cat-like it's", T.sentence_tokens("text")) == ["the", "cat-like", "it's"]
    assert one(spark, " a\tb  c d", T.lead_tokens("text", 3)) == " a b  c"
    assert one(spark, "the Cat and cat x dog", T.keyphrases("text")) == ["cat", "dog"]
    assert one(spark, "Gastritis DNA 5mg plain Base", T.entities("text")) == ["Gastritis", "DNA", "5mg"]
    long_ = "word " * 20
    assert one(spark, f"{long_}\nMETHODS\n{long_}end", T.aux_field("text")).startswith(long_ + " " + long_)
    assert one(spark, "", T.aux_field("text")) == ""


def test_bigrams(spark):
    t = T.terms("text")
    assert one(spark, "b a a", T.ordered_bigrams(t)) == ["b a", "a a"]
    assert sorted(one(spark, "b a a", T.unordered_bigrams(t, 2))) == ["a a", "a b", "a b"]
    assert one(spark, "one", T.ordered_bigrams(t)) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=8), st.integers(0, 2**64 - 1))
def test_xxh64_equals_the_library(items, seed):
    assert H.hash64(items, seed, "xxh64").tolist() == [xxhash.xxh64_intdigest(x, seed) for x in items]


def test_known_hashes():
    assert H.hash64([b"", b"abc"], 0, "xxh64").tolist() == [0xEF46DB3751D8E999, 0x44BC2CF5AD770999]
    assert H.hash64([b""], 1, "xxh64")[0] == 0xD5AFBA1336A3BE4B
    # the check value of CRC-32C, before it is widened
    t, c = H._castagnoli(), 0xFFFFFFFF
    for b in b"123456789":
        c = int(t[(c ^ b) & 0xFF]) ^ (c >> 8)
    assert c ^ 0xFFFFFFFF == 0xE3069283


def test_hashes_depend_on_every_byte_and_the_seed():
    for family in H.FAMILIES:
        base = bytes(range(20))
        changed = [base[:i] + bytes([base[i] ^ 1]) + base[i + 1 :] for i in range(20)]
        h = H.hash64([base, *changed], 7, family)
        assert len(set(h.tolist())) == 21
        assert H.hash64([base], 8, family)[0] != h[0]
        assert H.window_hashes(np.frombuffer(base, np.uint8), 4, 7, family).tolist() == H.hash64([base[i : i + 4] for i in range(17)], 7, family).tolist()


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<double>")
    got = df.select(V.dot(F.col("a"), F.col("b")), V.l2_normalize(F.col("a")), V.prefix_normalize(F.col("a"), 1), V.from_bf16(V.to_bf16(F.col("a"))), V.at_least(F.col("b"), F.lit(1.5))).collect()
    assert [r[0] for r in got] == [11.0, 0.0]
    assert np.allclose(got[0][1], [0.6, 0.8]) and got[1][1] == [0.0, 0.0]
    assert got[0][2] == [1.0] and got[0][3] == [3.0, 4.0] and got[0][4] == [1]
