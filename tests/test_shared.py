"""Steps that several operators share, against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwood.functions import hashing as H
from tarnwood.operators import embed, evaluate, fragments, minhash, pairs, rankers, recipes, strategies
from tarnwood.operators import lexindex as lx


def test_pairs_in_a_window_equal_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [str(w) for w in rng.choice(list("abcdefg"), int(rng.integers(0, 30)))]) for i in range(20)] + [(20, None)]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    vocab = spark.createDataFrame([(w,) for w in "abcde"], "token string")
    want = Counter()
    for _, t in rows:
        for i in range(len(t or [])):
            for j in range(i + 1, min(i + 4, len(t))):
                if t[i] in "abcde" and t[j] in "abcde":
                    want[tuple(sorted((t[i], t[j])))] += 1
    assert {(r["a"], r["b"]): r["n"] for r in pairs.cooccurring(df, vocab, 3).collect()} == want
    near = spark.createDataFrame([("b a",), ("c c",)], "term string")
    loose = spark.createDataFrame([("a f",), ("b c",)], "term string")
    got = {(r["leg"], r["term"], r["doc_id"]): r["tf"] for r in pairs.counted(df, near, loose, 4).collect()}
    brute = Counter()
    for k, t in rows:
        for i in range(len(t or [])):
            for j in range(i + 1, min(i + 5, len(t))):
                if j == i + 1 and f"{t[i]} {t[j]}" in ("b a", "c c"):
                    brute[0, f"{t[i]} {t[j]}", k] += 1
                if (p := " ".join(sorted((t[i], t[j])))) in ("a f", "b c"):
                    brute[1, p, k] += 1
    assert got == brute


def test_exact_search_in_blocks_equals_sorting(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, 6)).round(1)
    x[10:30] = x[5]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>")
    asked = docs.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    want = {q: sorted(range(90), key=lambda i: (-round(float(x[q] @ x[i]), 8), i))[:7] for q in range(0, 90, 9)}
    for block, tile in ((20_000, 2_048), (4, 8)):
        monkeypatch.setattr(evaluate, "QUERY_BLOCK", block)
        monkeypatch.setattr(evaluate, "TILE", tile)
        got = {}
        for r in sorted(evaluate.exact_dense(asked, docs, 7).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == want


@pytest.mark.parametrize("seed", [0, 3, 17])
def test_densified_rows_equal_a_loop_over_slots(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 1000, (12, 32))
    rows[rng.random(rows.shape) < 0.7] = minhash.EMPTY
    rows[0] = minhash.EMPTY
    step = int(H.mix(np.uint64(seed))) | 1
    for row, got in zip(rows.tolist(), minhash.densify(rows, seed).tolist()):
        for i in range(32):
            if row[i] == minhash.EMPTY:
                donors = ((r, row[((i + r * step) & 0xFFFFFFFF) % 32]) for r in range(1, 33))
                r, lent = next(((r, x) for r, x in donors if x != minhash.EMPTY), (0, 0))
                row[i] = int(H.mix(np.uint64(lent << 32 | r if r else seed ^ i))) & 0xFFFFFFFF
        assert row == got


def test_tokenised_documents_give_the_same_scores(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a dog sat"), (3, None), (4, "cat and dog and cat")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat sat dog"), (2, "nothing here")], "query_id long, text string")
    for v in ("atire", "sab", "sdm", "wsdm"):
        one, two = ({(r[0], r[1]): round(r[2], 9) for r in rankers.score(d, asked, v).collect()} for d in (docs, lx.tokenised(docs)))
        assert one == two and one
    many = {(r["leg"], r["query_id"], r["doc_id"]): r["score"] for r in rankers.score_many(docs, asked, ("atire", "plus")).collect()}
    alone = {(r[0], r[1]): r[2] for r in rankers.score(docs, asked, "plus").collect()}
    assert {k[1:]: v for k, v in many.items() if k[0] == "plus"} == pytest.approx(alone)


def test_digests_see_changes_and_no_order(spark):
    rows = [(i, f"t{i}", i / 7) for i in range(30)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "a long, b string, c double")
    one = strategies.digest(df, "a", "b", "c").first()
    assert one == strategies.digest(df.orderBy(F.desc("a")), "a", "b", "c").first()
    assert one["digest"] != strategies.digest(df.withColumn("b", F.lower(F.concat("b", F.lit("x")))), "a", "b", "c").first()["digest"]
    assert strategies.digest(df.limit(0), "a").first()["digest"] == "0"


def test_a_workspace_takes_only_what_it_was_made_for(spark):
    docs = spark.createDataFrame([(i, f"The {w} walks home today. It is a long way for a {w}. Nobody knows the {w} well.") for i, w in enumerate(("fox", "dog", "cat", "owl", "bee", "ant"))], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fox walks home"), (2, "owl")], "query_id long, text string")
    small = embed.EncoderConfig(features="both", sketch_dim=64, output_dim=16, projection="fwht")
    own = recipes.Workspace(docs, asked, recipes.RerankerConfig(builder="rich", storage="bf16", config=small))
    got = own.run(own.config).collect()
    assert {r["query_id"] for r in got} == {1, 2} and own.profile().first()["docs"] == 6
    with pytest.raises(ValueError):
        own.run(recipes.RerankerConfig(builder="basic", config=small))
    with pytest.raises(ValueError):
        recipes.RerankerConfig(storage="half")
    with pytest.raises(ValueError):
        recipes.Workspace(docs.limit(0), asked)


def test_word_vector_fragments(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma delta walks. Epsilon zeta eta theta sleeps. Alpha theta iota kappa sings."), (2, "unknown words only here now")], "doc_id long, text string")
    table = spark.createDataFrame([(w, [float(len(w)), float(i), 1.0]) for i, w in enumerate(("alpha", "beta", "theta", "kappa", "walks"))], "token string, vec array<double>")
    stats = lx.build(lx.words(docs)).stats
    for b in ("richcov_sif", "richcov_bsif"):
        got = fragments.build(docs, stats, builder=b, table=table).collect()
        assert {r["doc_id"] for r in got} == {1} and all(abs(np.linalg.norm(r["vec"]) - 1) < 1e-9 for r in got)
    same = fragments.build(docs, stats, embed.EncoderConfig(sketch_dim=64, output_dim=8), "richcov_sif")
    assert same.count() == fragments.build(docs, stats, embed.EncoderConfig(sketch_dim=64, output_dim=8), "rich_covered").count()
