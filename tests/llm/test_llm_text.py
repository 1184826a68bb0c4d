"""The operators on texts: brute force, round trips, held-out accuracy, and awkward rows."""

from __future__ import annotations

import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tarnwood.llm import crf, importance, packing, parity_join, pieces, placement, spans, textvec, tokens, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], schema)


def vocabulary(n=400, seed=0):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n)]


def corpus(seed=0, n=60, copies=4):
    """Texts of several lengths, each third one with near and exact copies."""
    rng, words, out = np.random.default_rng(seed), vocabulary(), []
    for i in range(n):
        w = list(rng.choice(words, rng.choice([3, 8, 40, 160, 700])))
        out.append(" ".join(w))
        if i % 3 == 0:
            for c in range(copies):
                v = list(w)
                for _ in range(c * max(1, len(v) // 60)):
                    v[rng.integers(len(v))] = words[rng.integers(len(words))]
                out.append(" ".join(v))
    return list(enumerate(out))


AWKWARD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (None, "a text without an id. It has words."), (5, "日本語 テキスト é ß \U0001f600"), (6, "x" * 3_000), (7, "word " * 20_000), (8, "!!! ??? ...")]


# 1 near copies


def grams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({" ".join(w)} if w else set())


def brute_groups(rows, t=0.55):
    g = {i: grams(x or "") for i, x in rows}
    root = {i: i for i in g}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(g)
    paired = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if g[a] and g[b]:
                c = len(g[a] & g[b])
                if c >= t * (len(g[a]) + len(g[b]) - c) - 1e-9:
                    paired |= {a, b}
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in paired}


def test_near_groups_equal_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r["keep_id"] for r in parity_join.near_groups(frame(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_wide_buckets_lose_no_pair(spark):
    rng, words = np.random.default_rng(31), vocabulary()
    phrase = list(rng.choice(words, 12))
    rows = list(corpus(4, 15))
    for i in range(60):
        w = [*phrase, *rng.choice(words, int(rng.integers(6, 14)))]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: -1 - i % 3]))]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: r["keep_id"] for r in parity_join.near_groups(frame(spark, rows), wide=2).collect()}
    assert got == brute_groups(rows)


def test_rarest_tokens_of_near_sets_meet():
    rng = np.random.default_rng(16)
    load = rng.integers(0, 9, 1 << 8)
    for a, b, c, times in ((1, 1, 1, 5), (3, 5, 3, 100), (16, 29, 16, 100), (100, 100, 72, 50), (150, 260, 146, 50), (900, 1100, 715, 20), (3000, 3000, 2150, 10)):
        for _ in range(times):
            x = rng.integers(0, 2**63, a + b - c, dtype=np.uint64)
            x, y = np.unique(x[:a]), np.unique(x[a - c :])
            doc, key, _ = parity_join.prefixes(np.r_[x, y], np.array([0, a, a + b]), load, 0.55)
            assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist()), (a, b)


def brute_links(rows, t=0.55):
    """(least of the group, number of near documents) of each document that has one; rows that repeat an id are one document."""
    g = {}
    for i, x in rows:
        g.setdefault(i, set()).update(grams(x or ""))
    near = {i: [j for j in g if j != i and g[i] and g[j] and len(g[i] & g[j]) >= t * len(g[i] | g[j]) - 1e-9] for i in g}
    root = {i: i for i in g}
    while True:
        new = {i: min([root[i], *(root[j] for j in near[i])]) for i in g}
        if new == root:
            return {i: (root[i], len(near[i])) for i in g if near[i]}
        root = new


def links(df, **more):
    return {r["doc_id"]: (r["keep_id"], r["links"]) for r in parity_join.near_groups(df, **more).collect()}


def test_links_equal_brute_force(spark, monkeypatch):
    rows = corpus(7, 30, 6)
    # rows that repeat an id, one of them a copy of another document
    rows += [(3, rows[0][1]), (40, rows[40][1]), (41, "a few more words"), (1000, rows[5][1])]
    want = brute_links(rows)
    assert links(frame(spark, rows)) == want
    monkeypatch.setattr(parity_join, "TILE", 2)
    monkeypatch.setattr(parity_join, "POSTINGS", 500)
    assert links(frame(spark, rows), wide=2) == want
    assert max(n for _, n in want.values()) >= 6


def test_pairs_without_a_common_block_are_found(spark):
    """Two pairs at the threshold of 16 and 29 grams, of which blocks with tokens share none."""
    rows = [(10 * k + j, " ".join(f"w{seed}x{i}" for i in range(size))) for k, seed in enumerate((54827, 59608)) for j, size in enumerate((18, 31))]
    for k in (0, 2):
        *_, first, h = textvec.words(pa.array([t for _, t in rows[k : k + 2]]))
        doc, key, _ = parity_join.block_keys(*textvec.shingles(h, first, 3), 0.55)
        assert not set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())
    assert links(frame(spark, rows)) == {0: (0, 1), 1: (0, 1), 10: (10, 1), 11: (10, 1)}


def test_wide_buckets_are_cut_without_loss():
    rng = np.random.default_rng(17)
    key, doc, size = rng.integers(0, 40, 600).astype(np.uint32), rng.integers(0, 90, 600), rng.integers(50, 60, 90)
    rank = np.zeros(600, np.int64)
    want = {tuple(sorted((a, b))) for k in range(40) for a in doc[key == k].tolist() for b in doc[key == k].tolist() if a != b}
    for wide in (1, 3, 1000):
        got = np.concatenate(list(parity_join.met(key, doc, rank, size, 0.55, wide)))
        assert {(c // 90, c % 90) for c in got.tolist()} == want


def test_documents_of_many_slices_keep_their_ids():
    """A part may hold more documents than a posting's 16 bits can tell apart; slices count their own."""
    slices = 3
    heads, entries = np.zeros((slices, 40_000), parity_join.HEAD), np.zeros((slices, 40_000), parity_join.POSTING)
    heads["id"], heads["size"] = np.arange(slices * 40_000).reshape(slices, -1), 20
    entries["doc"], entries["key"] = np.arange(40_000), np.arange(slices * 40_000).reshape(slices, -1)
    entries["key"][2, -1] = 7
    rows = pa.RecordBatch.from_pydict({"part": [0] * slices, "docs": [x.tobytes() for x in heads], "entries": [x.tobytes() for x in entries]})
    got = [r for b in parity_join._meet(0.55, 1024)(iter([rows])) for r in b.to_pylist()]
    assert got == [{"a": 7, "b": 119_999}]


def test_many_buckets_of_one_width_lose_no_pair():
    """Buckets of one width that make more pairs than are looked at at once: later blocks were made of the first one's places."""
    buckets, wide = 14, 600
    key, doc = np.repeat(np.arange(buckets), wide).astype(np.uint32), np.arange(buckets * wide)
    i, j = np.triu_indices(wide, 1)
    want = (np.arange(buckets)[:, None] * wide + i).ravel() * len(doc) + (np.arange(buckets)[:, None] * wide + j).ravel()
    got = list(parity_join.met(key, doc, np.zeros(len(doc), np.int64), np.full(len(doc), 50), 0.55))
    assert np.array_equal(np.unique(np.concatenate(got)), np.unique(want))


def test_meeting_takes_few_bytes_an_entry():
    """79 bytes an entry, and several parts in a task, took executors beyond their memory."""
    rng, slices, docs, per = np.random.default_rng(41), 50, 400, 20_000
    heads, entries = np.zeros((slices, docs), parity_join.HEAD), np.zeros((slices, per), parity_join.POSTING)
    heads["id"], heads["size"] = np.arange(slices * docs).reshape(slices, -1), 300
    entries["doc"] = np.repeat(np.arange(docs), per // docs)
    entries["key"] = rng.integers(1 << 20, 1 << 32, (slices, per), dtype=np.uint32)
    entries["key"][:, : per // 10] = rng.integers(0, 20_000, (slices, per // 10))
    rows = pa.RecordBatch.from_pydict({"part": [0] * slices, "docs": [x.tobytes() for x in heads], "entries": [x.tobytes() for x in entries]})
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in parity_join._meet(0.55, 1024)(iter([rows])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found and most < 40 * slices * per


def test_each_part_is_met_in_a_task_of_its_own(spark, monkeypatch):
    def parts(batches):
        own = [x for b in batches for x in b.column("part").to_pylist()]
        once = [1] * len(own[:1])
        yield pa.RecordBatch.from_pydict({"a": own[:1], "b": [len(set(own))] * len(once), "n": once, "least": once}, pa.schema({"a": pa.int64(), "b": pa.int64(), "n": pa.int32(), "least": pa.int32()}))

    monkeypatch.setattr(parity_join, "_meet", lambda *_: parts)
    rows = spark.range(64).selectExpr("cast(id % 16 as int) as part", "binary('') as docs", "binary('') as entries")
    assert {(r["a"], r["b"]) for r in parity_join.candidates(rows, 16, 0.55, 1024).collect()} == {(k, 1) for k in range(16)}


def test_near_sets_share_as_many_rarest_tokens_as_they_must():
    """With as few common tokens as near sets can have, wherever those are in the order; some pairs share no more than the least."""
    rng, spare = np.random.default_rng(43), []
    for _ in range(4000):
        a = int(rng.integers(1, 60))
        b = int(rng.integers(a, int(a / 0.55 + 1e-9) + 1))
        c = next(c for c in range(1, a + 1) if c >= 0.55 * (a + b - c) - 1e-9)
        x = np.sort(rng.integers(0, 2**63, a + b - c, dtype=np.uint64))
        # the load makes common tokens rare, frequent or neither
        common = rng.choice(len(x), c, replace=False) if rng.random() < 0.3 else np.arange(c)
        own = np.setdiff1d(np.arange(len(x)), common)
        load = np.zeros(1 << 12, np.int64)
        load[(x[common] & np.uint64(4095)).astype(int)] = rng.integers(0, 5)
        load[(x[own[: a - c]] & np.uint64(4095)).astype(int)] = rng.integers(0, 5)
        sets = [np.sort(np.r_[x[common], x[own[: a - c]]]), np.sort(np.r_[x[common], x[own[a - c :]]])]
        doc, key, _ = parity_join.prefixes(np.concatenate(sets), np.array([0, a, a + b]), load, 0.55)
        shared = len(set(key[doc == 0].tolist()) & set(key[doc == 1].tolist()))
        spare.append(shared - int(parity_join.least_shared(np.array(a), np.array(b), 0.55)))
    assert min(spare) == 0


def test_pairs_that_share_too_few_rarest_tokens_are_no_candidates(spark):
    """Two texts of one topic with a passage in common, far from near copies; a pair of near ones in which it stands too."""
    same = " ".join(f"s{i}" for i in range(12))
    rows = [(k, f"{same} " + " ".join(f"w{k}x{i}" for i in range(40))) for k in range(4)]
    rows += [(9, rows[3][1] + " more")]
    n = 3
    docs = frame(spark, rows).select("doc_id", "text")
    load = spark.sparkContext.broadcast(np.zeros(1 << 10, np.int8))
    postings = docs.mapInArrow(parity_join._rows(parity_join._postings(n, load, 8, 0.55)), "part int, docs binary, entries binary")
    assert [tuple(r) for r in parity_join.candidates(postings, 8, 0.55, 1024).collect()] == [(3, 9)]


def test_one_of_each_keeps_the_least(spark):
    rows = corpus(1, 20)
    groups = brute_groups(rows)
    kept = {r["doc_id"] for r in parity_join.one_of_each(frame(spark, rows)).collect()}
    assert kept == {i for i, _ in rows if groups.get(i, i) == i}


def test_small_bands_lose_no_pair():
    """Pigeonhole: two sets within the bound share a block."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = int(rng.integers(4, 60))
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        drop = int(size * 0.2)
        other = np.unique(np.r_[base[drop:], rng.integers(0, 2**63, max(0, drop // 2), dtype=np.uint64)])
        a = np.unique(base)
        c = len(np.intersect1d(a, other))
        if c < 0.55 * (len(a) + len(other) - c):
            continue
        doc, key, _ = parity_join.block_keys(np.r_[a, other], np.array([0, len(a), len(a) + len(other)]), 0.55)
        assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())


def test_smallest_sets_and_band_below_the_samples_lose_no_pair():
    rng = np.random.default_rng(15)
    for a, b, c, times in ((2, 3, 2, 300), (3, 5, 3, 300), (4, 4, 3, 300), (7, 11, 7, 300), (15, 20, 13, 300), (100, 100, 72, 20)):
        for _ in range(times):
            x = rng.integers(0, 2**63, a + b - c, dtype=np.uint64)
            x, y = np.unique(x[:a]), np.unique(x[a - c :])
            doc, key, _ = parity_join.block_keys(np.r_[x, y], np.array([0, a, a + b]), 0.55)
            assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist()), (a, b)
    assert parity_join.blocks_of(-1, 0.55) == 75


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(6)
    a, b = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)), np.unique(rng.integers(0, 2**63, 280, dtype=np.uint64))
    b = np.unique(np.r_[a[:150], b])
    sets, first = np.r_[a, b], np.array([0, len(a), len(a) + len(b)])
    n, s = parity_join.bit_sketch(sets, first, np.ones(len(sets), bool))
    far = sum(bin(int(x)).count("1") for x in (s[0] ^ s[1]).view(np.uint64))
    assert n.tolist() == [len(a), len(b)] and far <= len(np.setxor1d(a, b))


def test_near_groups_of_awkward_rows(spark):
    got = {r["doc_id"]: r["keep_id"] for r in parity_join.near_groups(frame(spark, AWKWARD)).collect()}
    assert got.keys() <= {4, 5, 6, 7}
    assert parity_join.near_groups(frame(spark, [])).count() == 0
    assert parity_join.one_of_each(frame(spark, [])).count() == 0


def test_filter_of_ids_lets_all_members_pass(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "doc_id")
    bits = parity_join.id_filter(ids)
    h = textvec.mix(np.arange(0, 5000, 7).view(np.uint64)) % np.uint64(len(bits) * 8)
    assert ((bits[(h >> np.uint64(3)).astype(int)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1).all()
    assert np.unpackbits(bits).mean() < 0.12
    assert parity_join.id_filter(ids, 100) is None


# 2 importance


def test_resampling_prefers_the_target(spark):
    rng, good, bad = np.random.default_rng(2), vocabulary(80, 3), vocabulary(80, 4)
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 60))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = importance.resample(frame(spark, rows), labels).collect()
    hit = [r["doc_id"] % 2 for r in got]
    assert len(got) == 100 and np.mean(hit) > 0.95
    kept = importance.keep_sampled(frame(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got}


def test_weights_equal_a_count_in_dictionaries(spark):
    rows = [(0, "a b a c"), (1, "b b c"), (2, "c a")]
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    ratio = importance.log_ratios(frame(spark, rows), importance.target_labels(labels))

    def feats(t):
        return [int(x) for x in importance.features(pa.array([t]))[0] if x >= 0]

    raw, target = Counter(f for _, t in rows for f in feats(t)), Counter(feats(rows[0][1]))
    scale = sum(target.values()) / sum(raw.values())
    want = {i: sum(math.log(target[f] + 5) - math.log(raw[f] * scale + 5) for f in feats(t)) for i, t in rows}
    w, _ = importance.weights(pa.array([t for _, t in rows]), ratio)
    assert np.allclose(w, [want[i] for i, _ in rows])


def test_kth_largest_equals_sorting(spark):
    x = np.random.default_rng(0).standard_normal(500).round(2).tolist()
    df = spark.createDataFrame([(v,) for v in x], "key double")
    for k in (1, 7, 250, 499):
        assert importance.kth_largest(df, k, 16) == sorted(x, reverse=True)[k - 1]
    assert importance.kth_largest(df, 500) == -math.inf and importance.kth_largest(df, 0) == math.inf


def test_resampling_of_awkward_rows(spark):
    labels = spark.createDataFrame([(4, 1, None), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    got = [r["doc_id"] for r in importance.resample(frame(spark, AWKWARD), labels).collect()]
    assert not {1, 2, 3} & set(got)
    assert importance.resample(frame(spark, []), labels).count() == 0
    assert importance.resample(frame(spark, [(1, "a b"), (2, None)]), labels.limit(0)).count() == 1


# 3 wavelet matrix


def test_wavelet_answers_equal_a_scan():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 300, 5000)
    first = np.array([0, 10, 10, 5000])
    shard = wavelet.WaveletShard(wavelet.build(ids, first, [7, None, 9], 300, block=64))
    at = rng.integers(0, 5000, 300)
    assert (shard.access(at) == ids[at]).all() and (shard.document(2) == ids[10:]).all()
    assert shard.doc_ids == [7, None, 9]
    for t in (0, 17, 299, 511, 600, -1):
        where = np.flatnonzero(ids == t)
        assert shard.count(t) == len(where) and shard.count(t, 100, 900) == ((where >= 100) & (where < 900)).sum()
        assert shard.locate(t) == where.tolist()
    with pytest.raises(IndexError):
        shard.access([5000])
    with pytest.raises(ValueError):
        wavelet.WaveletShard(b"nothing here")


def test_wavelet_shards_round_trip(spark):
    df = frame(spark, AWKWARD)
    want = Counter((i, t or "") for i, t in AWKWARD)
    got = Counter()
    for r in wavelet.wavelet_shards(df, shard_tokens=1000).collect():
        shard = wavelet.WaveletShard(bytes(r["data"]))
        got.update((i, tokens.decode(shard.document(d))) for d, i in enumerate(shard.doc_ids))
    assert got == want
    assert wavelet.wavelet_shards(frame(spark, [])).count() == 0


# 4 pieces


def brute_segmentations(voc, word, n):
    out = []

    def walk(at, ids, s):
        if at == len(word):
            out.append((s, ids))
        for j in range(at + 1, len(word) + 1):
            k = voc.ids.get(word[at:j])
            if k is not None:
                walk(j, [*ids, k], s + voc.score[k])

    walk(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])[:n]


def test_nbest_equals_all_segmentations():
    voc = pieces.vocabulary()
    for word in (b" the", b" house", b" aab", b"reading"):
        got, want = pieces.nbest_word(voc, word, 5), brute_segmentations(voc, word, 5)
        assert np.allclose([s for s, _ in got], [s for s, _ in want])
    ids, best, gap = pieces.segment(voc, np.frombuffer(b" reading", np.uint8), np.array([0]), np.array([8]))
    two = brute_segmentations(voc, b" reading", 2)
    assert np.isclose(best[0], two[0][0]) and np.isclose(gap[0], two[0][0] - two[1][0]) and list(ids[0]) == two[0][1]


def test_document_nbest_equals_brute_force():
    voc, text = pieces.vocabulary(), "to be or"
    ids, edges, score, others = pieces.encode_texts(voc, [text], 4)
    want = brute_segmentations(voc, b" to be or", 4)
    assert np.allclose([score[0], *(s for s, _ in others[0])], [s for s, _ in want])
    for _, edits in others[0]:
        assert pieces.decode_ids(voc, pieces.apply_edits(ids.tolist(), edits)) == text


def test_pieces_round_trip(spark):
    got = pieces.encode(frame(spark, AWKWARD))
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode(got).collect())
    assert back == Counter((i, t or "") for i, t in AWKWARD)
    assert pieces.encode(frame(spark, [])).count() == 0


# 5 languages


def languages(seed, n):
    rng, out = np.random.default_rng(seed), []
    sets = {c: ["".join(rng0.choice(list(a), rng0.integers(3, 8))) for _ in range(150)] for c, a, rng0 in (("aa", "abcdefgh", np.random.default_rng(1)), ("bb", "ijklmnop", np.random.default_rng(2)), ("cc", "abcdijkl", np.random.default_rng(3)))}
    for i in range(n):
        c = ("aa", "bb", "cc")[i % 3]
        out.append((i, " ".join(rng.choice(sets[c], 30)), c))
    return out, sets


def test_words_of_mixed_texts_are_labelled(spark):
    rows, sets = languages(0, 60)
    model = crf.fit([t for _, t, _ in rows], [c for *_, c in rows], sequences=600, epochs=3)
    rng = np.random.default_rng(9)
    right = total = 0
    for _ in range(20):
        gold = [c for c in rng.choice(list(sets), 4) for _ in range(6)]
        text = " ".join(rng.choice(sets[c]) for c in gold)
        p, best, _ = crf.label(model, pa.array([text]))
        assert np.allclose(p.sum(1), 1, atol=1e-4)
        right += sum(model.langs[b] == g for b, g in zip(best, gold))
        total += len(gold)
    assert right / total > 0.9


def test_every_language_is_trained_on(spark, monkeypatch):
    monkeypatch.setattr(crf, "fit", lambda texts, langs, seed: langs)
    rows = [(i, "some words", f"l{i // 2}", "src", 10) for i in range(140)]
    assert sorted(crf.train(spark.createDataFrame(rows, SCHEMA), per_lang=1)) == sorted({r[2] for r in rows})


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(4)
    e, move, start = rng.standard_normal((5, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    want, z = np.zeros((5, 3)), 0.0
    for path in np.ndindex(*[3] * 5):
        w = math.exp(start[path[0]] + sum(e[t, path[t]] for t in range(5)) + sum(move[path[t], path[t + 1]] for t in range(4)))
        z += w
        for t in range(5):
            want[t, path[t]] += w
    got = crf.marginals(e, np.array([0, 5]), move, start)
    assert np.allclose(got, want / z)


def test_identify_and_keep(spark):
    rows, _ = languages(5, 45)
    df = spark.createDataFrame([(i, t, c, "s", 1) for i, t, c in rows] + [(100, None, None, "s", 0), (101, "?!", "aa", "s", 2), (None, rows[0][1], None, None, None)], SCHEMA)
    got = {r["doc_id"]: r for r in crf.identify(df).collect()}
    assert np.mean([got[i]["lang_found"] == c for i, _, c in rows]) > 0.95
    assert got[100]["lang_found"] is None and not got[100]["kept"] and not got[101]["kept"]
    assert sum(r["words"] for r in got[0]["runs"]) == got[0]["n_words"] == 30
    kept = crf.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert not any(r["kept"] or r["lang_found"] for r in crf.identify(df.withColumn("lang", df["lang"].substr(9, 1)).where("false").unionByName(df.where("lang is null"))).collect())
    assert crf.identify(df.limit(0)).count() == 0 and crf.keep_identified(df.limit(0)).count() == 0


# 6 placement


def test_shares_and_movement(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    n = Counter((r["region"], r["rack"], r["shard"]) for r in placement.place(df).collect())
    total = placement.weight(placement.DEFAULT)
    for r, racks in placement.DEFAULT.items():
        for k, shards in racks.items():
            for s, w in shards.items():
                assert abs(n[r, k, s] / 20_000 - w / total) < 0.012
    after = {r: {k: dict(s) for k, s in racks.items()} for r, racks in placement.DEFAULT.items()}
    after["r1"]["k1"]["s0"], after["r1"]["k1"]["s1"] = 2, 6
    gone = placement.moved(df, placement.DEFAULT, after).collect()
    assert gone and all(x["from_shard"].startswith("r1/k1/") and x["to_shard"].startswith("r1/k1/") for x in gone)


def test_placement_of_awkward_keys(spark):
    df = spark.createDataFrame([(None, "r"), (1, "x"), (1, "y")], "doc_id long, region string")
    got = placement.place(df).collect()
    assert len(got) == 3 and all(r["shard"] for r in got) and got[1][1:] == got[2][1:]
    assert placement.place(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        placement.place(df, {"r": {"k": {"s": 0}}})


# 7 spans


def brute_spans(rows):
    seen, hits, per = {}, defaultdict(set), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        _, first, _, count, h = spans.units(pa.array([t or ""]))
        per[i] = len(h)
        for p in range(len(h) - 2):
            if count[p : p + 3].sum() >= 10:
                key = tuple(h[p : p + 3].tolist())
                if key in seen:
                    hits[i].update(range(p, p + 3))
                else:
                    seen[key] = i
    return {i: len(hits[i]) for i in per}


def test_spans_equal_brute_force(spark):
    rng, words = np.random.default_rng(7), vocabulary()
    sentence = lambda: " ".join(rng.choice(words, 9)).capitalize() + "."
    shared = [sentence() for _ in range(4)]
    rows = []
    for i in range(12):
        own = [sentence() for _ in range(5)]
        rows.append((i, " ".join(own[:2] + shared + own[2:] if i % 2 == 0 else own)))
    got = {r["doc_id"]: r for r in spans.drop_repeated_spans(frame(spark, rows)).collect()}
    assert {i: r["removed"] for i, r in got.items()} == brute_spans(rows)
    assert got[0]["text"] == rows[0][1] and got[1]["text"] == rows[1][1]
    assert all(s not in got[2]["text"] for s in shared) and got[2]["text"].startswith(rows[2][1][:20])


def test_a_long_sentence_is_cut_into_units():
    words = " ".join(f"w{i}" for i in range(40))
    assert spans.units(pa.array([words]))[3].tolist() == [16, 16, 8]


def test_spans_of_awkward_rows(spark):
    got = spans.drop_repeated_spans(frame(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[1] is None and texts[2] == "" and texts[None] == AWKWARD[5][1] and texts[8] == "!!! ??? ..."
    assert len(texts[7]) < 2000  # it repeats itself
    assert spans.drop_repeated_spans(frame(spark, [])).count() == 0


def test_passages_are_found_at_any_place(spark):
    """Fifty-one words repeat at other offsets of unpunctuated texts, and short lines repeat."""
    rng, words = np.random.default_rng(17), vocabulary(4000, 3)
    shared = [str(w) for w in rng.choice(words, 51)]
    rows = [(i, " ".join([*rng.choice(words, 20 + i), *shared, *rng.choice(words, 30)])) for i in range(20)]
    lines = "\n".join(words[:40])
    rows += [(30, lines), (31, "\n".join([*words[50:57], lines, *words[60:67]])), (32, " ".join(words[100:400]))]
    got = {r["doc_id"]: r for r in spans.drop_repeated_spans(frame(spark, rows)).collect()}
    for i in range(1, 20):
        left = got[i]["text"].split()
        assert got[i]["removed"] > 0 and len(left) <= len(rows[i][1].split()) - 35 and left[: 20 + i] == rows[i][1].split()[: 20 + i]
    assert got[0]["text"] == rows[0][1] and got[30]["text"] == lines and got[32]["removed"] == 0
    assert got[31]["removed"] == 40 and got[31]["text"].split() == [*words[50:57], *words[60:67]]


def test_of_repeated_rows_the_first_stays_whole(spark):
    t = "Alpha walks to the old harbour today. Beta carries four heavy boxes along. Gamma counts every gull above them. Delta sleeps until the evening comes."
    got = [(r["text"], r["removed"]) for r in spans.drop_repeated_spans(frame(spark, [(1, t), (1, t)])).collect()]
    assert sorted(got) == [("", 4), (t, 0)]
    rows = [(0, t), (1, "Omega is another sentence of six words. " + t), (1, "Short.")]
    got = sorted((r["doc_id"], r["text"], r["removed"]) for r in spans.drop_repeated_spans(frame(spark, rows)).collect())
    assert got == [(0, t, 0), (1, "Omega is another sentence of six words.", 4), (1, "Short.", 0)]


def test_repeated_ids_are_as_ids_of_their_own(spark):
    rng, words = np.random.default_rng(27), vocabulary()
    pool = [" ".join(rng.choice(words, 9)).capitalize() + "." for _ in range(12)]
    rows = [(int(rng.integers(0, 8)), " ".join(rng.choice(pool, int(rng.integers(0, 9))))) for _ in range(50)]
    df = frame(spark, rows + rows[:5] + [(None, rows[0][1])])
    got = Counter((r["text"], r["removed"]) for r in spans.drop_repeated_spans(df).collect() if r["doc_id"] is not None)
    order = [r["text"] for r in df.where("doc_id is not null").selectExpr("doc_id", "xxhash64(text) as x", "text").orderBy("doc_id", "x").collect()]
    want = spans.drop_repeated_spans(frame(spark, list(enumerate(order)))).collect()
    assert got == Counter((r["text"], r["removed"]) for r in want)


def test_long_words_are_cut_only_where_no_piece_reaches():
    voc = pieces.vocabulary()
    texts = ["日本語のテキストは空白なしで書かれる文章であり長い" * 6, "x" * 200, "supercalifragilistic" * 9, "é" * 90 + "\U0001f600" * 30 + "中文字符"]
    ids, first, score, _ = pieces.encode_texts(voc, texts)
    monotone, pieces.LONG_WORD = pieces.LONG_WORD, 1 << 30
    try:
        whole, edges, want, _ = pieces.encode_texts(voc, texts)
    finally:
        pieces.LONG_WORD = monotone
    assert np.allclose(score, want)
    assert len(pieces.split_words(texts, voc.pairs)[1]) > 30
    for d, t in enumerate(texts):
        assert pieces.decode_ids(voc, ids[first[d] : first[d + 1]].tolist()) == t


def test_scores_of_unigram_models_are_taken_as_they_are():
    live = np.array([True, True, False])
    assert np.allclose(pieces.piece_scores(np.array([-1.5, -2.25, 0.0]), live)[:2], [-1.5, -2.25])
    ranked = pieces.piece_scores(np.array([0.0, -1.0, 0.0]), live)
    assert np.isclose(np.exp(ranked[:2]).sum(), 1) and ranked[0] > ranked[1] and ranked[2] == -np.inf


def test_the_sample_is_the_top_of_weights_and_noise(spark):
    rng, words = np.random.default_rng(12), vocabulary()
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(3, 40))))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    ratio = importance.log_ratios(frame(spark, rows), importance.target_labels(labels))
    w, _ = importance.weights(pa.array([t for _, t in rows]), ratio)
    key = w + importance.gumbel(pa.array([i for i, _ in rows]), importance.SEED)
    k = math.ceil(120 * 20 / 60)
    want = {i for i, _ in sorted(zip(range(120), key), key=lambda x: -x[1])[:k]}
    assert {r["doc_id"] for r in importance.resample(frame(spark, rows), labels).collect()} == want


def test_a_key_may_be_named_as_a_result(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "region string")
    got = placement.place(df, key="region").collect()
    want = placement.place(df.withColumnRenamed("region", "doc_id")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, (tuple(r) for r in want))) and "key" in got[0].asDict()


# 10 packing


def test_buckets_are_folders_of_one_length(spark, tmp_path):
    rows = [(i, "one two three four five " * (i + 1)) for i in range(9)]
    packed = packing.pack(frame(spark, rows))
    packing.write_buckets(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert all(len(r["tokens"]) == 1 << r["bucket"] for r in back.collect())
    assert Counter(tuple(r["tokens"]) for r in back.collect()) == Counter(tuple(r["tokens"]) for r in packed.collect())


def test_packing_is_a_partition_of_the_tokens(spark):
    got = defaultdict(list)
    rows = [(k, t) for k, (_, t) in enumerate(AWKWARD)]
    for r in packing.pack(frame(spark, rows), longest=6).collect():
        assert len(r["tokens"]) == 1 << r["bucket"] and r["bucket"] <= 6
        got[r["doc_id"]].append(r)
    for k, t in rows:
        parts = sorted(got[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert tokens.decode([x for r in parts for x in r["tokens"]]) == (t or "")
        sizes = [r["bucket"] for r in parts]
        assert sizes == sorted(sizes, reverse=True) and all(n == 1 for b, n in Counter(sizes).items() if b < 6)
    assert packing.pack(frame(spark, [])).count() == 0


def test_clashing_columns_are_harmless(spark):
    df = frame(spark, [(i, f"the quick brown fox number {i} jumps. It jumps high over dogs. Then it sleeps all day long.") for i in range(5)])
    for name in ("keep_id", "rep", "size", "key", "keys", "rn", "pos", "h", "hits", "removed", "bucket", "token", "d", "v", "shard", "region", "n_tokens", "is_target"):
        df = df.withColumn(name, df["doc_id"])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert parity_join.one_of_each(df).columns == df.columns and parity_join.one_of_each(df).count() >= 1
    assert importance.keep_sampled(df, labels).columns == df.columns and importance.keep_sampled(df, labels).count() <= 5
    assert crf.keep_identified(df).count() == 5 and spans.without_spans(df).count() == 5
    assert placement.place(df).count() == 5 and packing.pack(df).count() >= 5 and wavelet.wavelet_shards(df).count() >= 1 and pieces.encode(df).count() == 5
