"""Byte-pair merges: learned from word counts, applied to distinct words."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.functions import text as T
from tarnwood.session import keep, prepare


def learn_from_counts(counts: dict[bytes, int], target: int = 512, least: int = 2) -> list[tuple[bytes, bytes]]:
    """The merges in order: at each step the commonest pair, of equals the one made of the earliest symbols, until the vocabulary has ``target`` symbols or no pair occurs ``least`` times."""
    ids: dict[bytes, int] = {}
    alphabet = sorted({bytes([b]) for w in counts for b in w})
    for s in alphabet:
        ids[s] = len(ids)
    words = [[bytes([b]) for b in w] for w in counts]
    weight = list(counts.values())
    n, where = Counter(), defaultdict(set)
    for k, w in enumerate(words):
        for pair in zip(w, w[1:]):
            n[pair] += weight[k]
            where[pair].add(k)
    heap = [(-c, ids[a], ids[b], (a, b)) for (a, b), c in n.items()]
    heapq.heapify(heap)
    merges: list[tuple[bytes, bytes]] = []
    while heap and len(ids) < target:
        c, _, _, pair = heapq.heappop(heap)
        if n[pair] != -c:
            if n[pair] > 0:
                heapq.heappush(heap, (-n[pair], ids[pair[0]], ids[pair[1]], pair))
            continue
        if -c < least:
            break
        merges.append(pair)
        new = pair[0] + pair[1]
        ids.setdefault(new, len(ids))
        changed = set()
        for k in sorted(where.pop(pair)):
            old, w = words[k], join_pair(words[k], pair)
            for p in zip(old, old[1:]):
                n[p] -= weight[k]
                changed.add(p)
            for p in zip(w, w[1:]):
                n[p] += weight[k]
                where[p].add(k)
                changed.add(p)
            words[k] = w
        for p in changed:
            if n[p] > 0:
                heapq.heappush(heap, (-n[p], ids[p[0]], ids[p[1]], p))
    return merges


def join_pair(symbols: list[bytes], pair: tuple[bytes, bytes]) -> list[bytes]:
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(symbols[i] + symbols[i + 1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def apply_word(word: bytes, rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The pieces of a word: the earliest merge that fits, everywhere, again and again."""
    s = [bytes([b]) for b in word]
    while len(s) > 1:
        best = min(zip(s, s[1:]), key=lambda p: rank.get(p, 1 << 60))
        if best not in rank:
            break
        s = join_pair(s, best)
    return s


def segmented(words: list[bytes], merges: list[tuple[int, int, int]]) -> np.ndarray:
    """The symbols of all words after the merges (left, right, new), -1 after each word."""
    s = np.frombuffer(b"\n".join(words) + b"\n", np.uint8).astype(np.int32)
    s[s == 10] = -1  # no word has a line feed
    for a, b, new in merges:
        hit = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
        if a == b and len(hit):
            # of a run of one symbol every other place
            head = np.flatnonzero(np.r_[True, np.diff(hit) > 1])
            place = np.arange(len(hit)) - np.repeat(head, np.diff(np.r_[head, len(hit)]))
            hit = hit[place % 2 == 0]
        if len(hit):
            s[hit] = new
            s = np.delete(s, hit + 1)
    return s


def pair_counts(words: DataFrame, merges: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """How often two symbols are neighbours in ``words(w, n)`` after the merges."""
    spark = prepare(words.sparkSession)
    shared = spark.sparkContext.broadcast(merges)
    side = 1 << 24

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = segmented([w.encode() for w in b.column(0).to_pylist()], shared.value)
            n = b.column(1).to_numpy(zero_copy_only=False)[np.cumsum(s == -1) - (s == -1)]
            live = (s[:-1] >= 0) & (s[1:] >= 0)
            code, at = np.unique(s[:-1][live].astype(np.int64) * side + s[1:][live], return_inverse=True)
            out = np.zeros(len(code), np.int64)
            np.add.at(out, at, n[:-1][live])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(out)], names=["code", "n"])

    got = words.select("w", "n").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return {divmod(int(c), side): int(n) for c, n in zip(got.code, got.n)}


def learn_from_words(words: DataFrame, target: int = 512, least: int = 2) -> list[tuple[bytes, bytes]]:
    """What ``learn_from_counts`` learns, from ``words(w, n)`` that stay where they are; the driver holds the counts of pairs of symbols alone.

    A count of all pairs gives several merges: those that come next in the order
    as long as no earlier one changes their count. A merge of a and b lowers
    pairs that begin with b or end with a, and what it makes can't be commoner
    than these were; of equal counts the pair with the newest symbol comes last.
    """
    prepare(words.sparkSession)
    count = words.select("w").mapInArrow(_bytes_used, "byte int").distinct().collect()
    names = [bytes([r["byte"]]) for r in sorted(count)]
    ids = {s: k for k, s in enumerate(names)}
    # symbols are told apart by their bytes' values first, by 256 and more where merged
    value = {s: s[0] for s in names}
    symbol = {v: s for s, v in value.items()}
    merges: list[tuple[bytes, bytes]] = []
    done: list[tuple[int, int, int]] = []
    while len(ids) < target:
        n = pair_counts(words, done)
        order = sorted((-c, ids[symbol[a]], ids[symbol[b]], a, b) for (a, b), c in n.items())
        firsts, seconds, began = set(), set(), len(merges)
        for c, _, _, a, b in order:
            if -c < least or len(ids) >= target or a in seconds or b in firsts:
                break
            left, right = symbol[a], symbol[b]
            new, known = left + right, left + right in ids
            if not known:
                ids[new] = len(ids)
                value[new] = 256 + len(value)
                symbol[value[new]] = new
            merges.append((left, right))
            done.append((a, b, value[new]))
            firsts.add(a)
            seconds.add(b)
            if known or a == b:
                break
        if len(merges) == began:
            break
    return merges


def _bytes_used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        used = np.unique(np.frombuffer("".join(b.column(0).to_pylist()).encode(), np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32))], names=["byte"])


#: Up to so many distinct words are learned from on the driver, more where they are; both ways learn the same.
LOCAL_WORDS = 50_000


def learn(docs: DataFrame, target: int = 512, least: int = 2, text: str = "text") -> DataFrame:
    """(rank, left, right): merges learned from white-space words, which are counted and, beyond ``LOCAL_WORDS``, stay in Spark."""
    spark = docs.sparkSession
    flat = docs.select(F.explode(F.regexp_extract_all(T.text_of(text), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))).alias("w"))
    words = keep(flat.groupBy("w").agg(F.count("*").alias("n")), "words")
    got = words.limit(LOCAL_WORDS + 1).collect()
    if len(got) > LOCAL_WORDS:
        merges = learn_from_words(words, target, least)
    else:
        merges = learn_from_counts({r["w"].encode(): r["n"] for r in sorted(got)}, target, least)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left binary, right binary")


def apply(words: DataFrame, merges: DataFrame, column: str = "word") -> DataFrame:
    """(word, pieces array<binary>) of the distinct words of a frame, to be joined back."""
    spark = prepare(words.sparkSession)
    rank = spark.sparkContext.broadcast({(bytes(r["left"]), bytes(r["right"])): r["rank"] for r in merges.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([apply_word(x.encode(), rank.value) for x in w], pa.list_(pa.binary()))], names=[column, "pieces"])

    return words.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().mapInArrow(run, f"{column} string, pieces array<binary>")


def subwords(docs: DataFrame, merges: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, word, pieces): the word tokens of each document in pieces; each distinct word is cut once."""
    flat = docs.select(key, F.posexplode(T.words(text)).alias("pos", "word"))
    return flat.join(apply(flat, merges), "word").select(key, "pos", "word", "pieces")


def to_text(merges: list[tuple[bytes, bytes]]) -> str:
    r"""One 'left\tright' a line; other than printable ASCII is written as \xNN, a backslash doubled."""
    show = lambda s: "".join("\\\\" if b == 92 else chr(b) if 33 <= b < 127 else f"\\x{b:02x}" for b in s)
    return "".join(f"{show(a)}\t{show(b)}\n" for a, b in merges)


def from_text(text: str) -> list[tuple[bytes, bytes]]:
    """What ``to_text`` wrote; malformed lines are skipped."""
    import re

    def read(s: str) -> bytes | None:
        if not re.fullmatch(r"(?:[^\\]|\\\\|\\x[0-9a-fA-F]{2})+", s):
            return None
        return b"".join(b"\\" if m == "\\\\" else bytes([int(m[2:], 16)]) if m.startswith("\\x") else m.encode() for m in re.findall(r"\\\\|\\x[0-9a-fA-F]{2}|[^\\]", s))

    out = []
    for line in text.split("\n"):
        parts = [read(p) for p in line.split("\t")]
        if len(parts) == 2 and None not in parts:
            out.append((parts[0], parts[1]))
    return out
