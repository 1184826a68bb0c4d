"""Text to vector: hashed n-gram count sketches, corpus-fitted weights, random projections, nested prefixes.

A frame of documents becomes vectors in one Arrow stage without a shuffle; the
projection is built once a worker. Weights by document frequency are learned
with one partial aggregation over hash buckets.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.functions import hashing as H
from tarnwood.session import prepare

from . import bpe

U = np.uint64
WORDS = re.compile(rb"[A-Za-z0-9_]+")
BOUNDED = re.compile(rb"[A-Za-z0-9_\x80-\xff]+")
#: The kinds of features of each setting, in their order.
FEATURES = {"char": ("char",), "word": ("word",), "both": ("char", "word"), "subword": ("subword",), "char_subword": ("char", "subword"), "all": ("char", "word", "subword")}
#: Sets the draws of very sparse projections apart from others of the same seed.
SALT = 0x7A526E9D41C3B85F
PROJECTIONS = ("none", "achlioptas", "gaussian", "very_sparse", "sparse_jl", "fwht")


@dataclass(frozen=True)
class EncoderConfig:
    features: str = "char"  # char, word, both, subword, char_subword, all
    least: int = 3
    most: int = 5
    bounded: bool = False
    fold: bool = False
    family: str = "splitmix64"
    seed: int = 0x6D1F94B07C25E83A
    weighting: str = "raw"  # raw, sqrt_tf
    signed_sqrt: bool = False
    sketch_dim: int = 4096
    output_dim: int = 384
    projection: str = "achlioptas"
    projection_seed: int = 0x39C7E15A8B604D2F
    sparse_eps: float = 0.1
    nested_decay: float | None = None
    nested_weights: tuple[float, ...] | None = None
    normalise: bool = True
    merges: tuple[tuple[bytes, bytes], ...] = ()  # byte-pair merges of the subword features, in order

    def __post_init__(self):
        finite = lambda x: bool(np.isfinite(x))
        wrong = [
            (self.features not in FEATURES, "features"),
            ("char" in FEATURES.get(self.features, ()) and not 1 <= self.least <= self.most, "least and most"),
            ("subword" in FEATURES.get(self.features, ()) and not self.merges, "subword features need merges"),
            (self.weighting != "raw" and self.signed_sqrt, "one of weighting and signed_sqrt"),
            (self.nested_decay is not None and not finite(self.nested_decay), "nested_decay is not finite"),
            (self.nested_weights is not None and not all(finite(w) and w >= 0 for w in self.nested_weights), "nested_weights are negative or not finite"),
            (self.projection == "none" and (self.nested_decay is not None or self.nested_weights is not None), "nested weights need a projection"),
            (self.family not in H.FAMILIES, "family"),
            (self.weighting not in ("raw", "sqrt_tf"), "weighting"),
            (self.sketch_dim < 1, "sketch_dim"),
            (self.projection not in PROJECTIONS, "projection"),
            (self.projection != "none" and self.output_dim < 1, "output_dim"),
            (not 0 < self.sparse_eps <= 1, "sparse_eps"),
            (self.projection == "fwht" and self.output_dim > 1 << (self.sketch_dim - 1).bit_length(), "output_dim is more than the padded sketch"),
            (self.nested_decay is not None and self.nested_decay <= 0, "nested_decay"),
            (self.nested_weights is not None and len(self.nested_weights) != self.dim, "nested_weights"),
        ]
        for bad, what in wrong:
            if bad:
                raise ValueError(f"encoder configuration: {what}")

    @property
    def dim(self) -> int:
        return self.sketch_dim if self.projection == "none" else self.output_dim


V1_384 = EncoderConfig()
COMPACT = EncoderConfig(features="both", bounded=True, fold=True, sketch_dim=8192, projection="fwht")


@dataclass(frozen=True)
class HashedIdf:
    """Fixed-point weights (1024 is 1) by hash bucket, with the encoder settings they were learned under."""

    weights: np.ndarray
    documents: int
    scope: str
    features: str
    least: int
    most: int
    bounded: bool
    fold: bool
    family: str
    seed: int

    def compatible(self, c: EncoderConfig) -> bool:
        return (self.features, self.least, self.most, self.bounded, self.fold, self.family, self.seed) == (c.features, c.least, c.most, c.bounded, c.fold, c.family, c.seed)

    def to_bytes(self) -> bytes:
        import json

        head = json.dumps({k: v for k, v in asdict(self).items() if k != "weights"}, sort_keys=True).encode()
        return b"TWIDF01\n" + len(head).to_bytes(4, "little") + head + self.weights.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> HashedIdf:
        import json

        if data[:8] != b"TWIDF01\n":
            raise ValueError("no weight table")
        n = int.from_bytes(data[8:12], "little")
        return cls(np.frombuffer(data[12 + n :], "<u2"), **json.loads(data[12 : 12 + n]))

    def fingerprint(self) -> str:
        import hashlib

        return hashlib.sha256(self.to_bytes()).hexdigest()


def with_idf(idf: HashedIdf, base: EncoderConfig = COMPACT, output_dim: int = 384) -> EncoderConfig:
    """The compact preset for a weight table of 65,536 buckets over all features, checked."""
    if len(idf.weights) != 65_536 or idf.scope != "all" or not idf.compatible(base):
        raise ValueError("the weight table doesn't fit the preset")
    return replace(base, output_dim=output_dim)


@functools.lru_cache(2)
def _ranks(merges: tuple) -> dict[tuple[bytes, bytes], int]:
    return {pair: k for k, pair in reversed(list(enumerate(merges)))}


@functools.lru_cache(100_000)
def _pieces(word: bytes, merges: tuple) -> tuple[bytes, ...]:
    return tuple(bpe.apply_word(word, _ranks(merges)))


def hashed_features(text: bytes, c: EncoderConfig) -> tuple[np.ndarray, np.ndarray]:
    """(hash, magnitude) of a text's features in order: 2 for character n-grams and subwords, 1 for words."""
    if c.fold:
        text = text.lower()
    h, mag = [], []
    kinds = FEATURES[c.features]
    if "char" in kinds:
        if c.bounded:
            grams = [w[i : i + k] for w in (b"<" + x + b">" for x in BOUNDED.findall(text)) for k in range(c.least, c.most + 1) for i in range(len(w) - k + 1)]
            own = H.hash64(grams, c.seed, c.family)
        else:
            buf = np.frombuffer(text, np.uint8)
            own = np.concatenate([H.window_hashes(buf, k, c.seed, c.family) for k in range(c.least, c.most + 1)])
        h.append(own)
        mag.append(np.full(len(own), 2, np.int64))
    if "word" in kinds:
        own = H.hash64(WORDS.findall(text), c.seed, c.family)
        h.append(own)
        mag.append(np.ones(len(own), np.int64))
    if "subword" in kinds:
        own = H.hash64([p for w in WORDS.findall(text) for p in _pieces(w, c.merges)], c.seed, c.family)
        h.append(own)
        mag.append(np.full(len(own), 2, np.int64))
    return np.concatenate(h), np.concatenate(mag)


def sketch(text: bytes, c: EncoderConfig, idf: HashedIdf | None = None) -> np.ndarray:
    """The count sketch of one text: buckets from the low 32 bits, signs from the highest."""
    h, mag = hashed_features(text, c)
    if c.weighting == "sqrt_tf":
        key, at, tf = np.unique(np.stack([h, mag.astype(U)]), axis=1, return_index=True, return_counts=True)
        h, mag = h[at], mag[at] * np.floor(np.sqrt(tf.astype(np.float64) * (1 << 20))).astype(np.int64)
    elif idf is not None:
        w = idf.weights[(h % U(len(idf.weights))).astype(np.int64)].astype(np.int64)
        if idf.scope != "all":
            w = np.where(mag == (2 if idf.scope == "char" else 1), w, 1024)
        mag = mag * w
    bucket = (h & U(0xFFFFFFFF)) % U(c.sketch_dim)
    out = np.bincount(bucket.astype(np.int64), np.where(h >> U(63), -mag, mag), c.sketch_dim)
    if c.signed_sqrt:
        out = np.sign(out) * np.floor(np.sqrt(np.abs(out) * (1 << 20)))
    return out


#: Bytes of text hashed at once.
RUN = 200_000


def bounded_windows(tokens: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all <token>s, starts of the windows of k bytes inside one of them, token of each of these)."""
    buf = np.frombuffer(b"<" + b"><".join(tokens) + b">" if tokens else b"", np.uint8)
    own = np.repeat(np.arange(len(tokens)), [len(x) + 2 for x in tokens])
    at = np.flatnonzero(own[: max(0, len(own) - k + 1)] == own[k - 1 :])
    return buf, at, own[at]


def _scaled(h: np.ndarray, mag: int, c: EncoderConfig, idf: HashedIdf | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, signed magnitude) of hashes of one kind."""
    value = np.full(len(h), mag, np.int64)
    if idf is not None and (idf.scope == "all" or mag == (2 if idf.scope == "char" else 1)):
        value = value * idf.weights[(h % U(len(idf.weights))).astype(np.int64)].astype(np.int64)
    elif idf is not None:
        value = value * 1024
    return ((h & U(0xFFFFFFFF)) % U(c.sketch_dim)).astype(np.int64), np.where(h >> U(63), -value, value)


def sketches(texts: list[bytes], c: EncoderConfig, idf: HashedIdf | None = None) -> np.ndarray:
    """``sketch`` of each text. Where no feature crosses a token and counts are raw, many texts are hashed at once, and each distinct word once."""
    if c.weighting != "raw" or ("char" in FEATURES[c.features] and not c.bounded):
        return np.stack([sketch(t, c, idf) for t in texts]) if texts else np.zeros((0, c.sketch_dim))
    out, at, size = np.zeros((len(texts), c.sketch_dim)), 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > RUN or i == len(texts) - 1:
            out[at : i + 1] = _sketch_run(texts[at : i + 1], c, idf)
            at, size = i + 1, 0
    return np.sign(out) * np.floor(np.sqrt(np.abs(out) * (1 << 20))) if c.signed_sqrt else out


def _sketch_run(texts: list[bytes], c: EncoderConfig, idf: HashedIdf | None) -> np.ndarray:
    kinds, cells, values = FEATURES[c.features], [], []
    if c.fold:
        texts = [t.lower() for t in texts]

    def add(row: np.ndarray, h: np.ndarray, mag: int) -> None:
        bucket, value = _scaled(h, mag, c, idf)
        cells.append(row * c.sketch_dim + bucket)
        values.append(value)

    if "char" in kinds:
        per = [BOUNDED.findall(t) for t in texts]
        tokens, row = [x for own in per for x in own], np.repeat(np.arange(len(texts)), [len(own) for own in per])
        for k in range(c.least, c.most + 1):
            buf, at, token = bounded_windows(tokens, k)
            if len(at):
                add(row[token], H.FAMILIES[c.family](np.lib.stride_tricks.sliding_window_view(buf, k)[at], c.seed), 2)
    if "word" in kinds or "subword" in kinds:
        per = [WORDS.findall(t) for t in texts]
        row, ids = np.repeat(np.arange(len(texts)), [len(own) for own in per]), {}
        word = np.fromiter((ids.setdefault(x, len(ids)) for own in per for x in own), np.int64, len(row))
        if "word" in kinds:
            add(row, H.hash64(list(ids), c.seed, c.family)[word], 1)
        if "subword" in kinds:
            cut = [_pieces(w, c.merges) for w in ids]
            n = np.array([len(p) for p in cut], np.int64)
            start = np.repeat((np.cumsum(n) - n)[word], n[word])
            place = np.arange(n[word].sum()) - np.repeat(np.cumsum(n[word]) - n[word], n[word])
            add(np.repeat(row, n[word]), H.hash64([x for p in cut for x in p], c.seed, c.family)[start + place], 2)
    if not cells:
        return np.zeros((len(texts), c.sketch_dim))
    return np.bincount(np.concatenate(cells), np.concatenate(values), len(texts) * c.sketch_dim).reshape(len(texts), -1)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) / 2.0**53


def _partial_shuffle(n: int, k: int, state) -> np.ndarray:
    """The first k places of a keyed shuffle of range(n)."""
    idx = np.arange(n)
    with np.errstate(over="ignore"):
        for i in range(k):
            state = H.mix(state + U(i))[()]
            j = i + int(state % U(n - i))
            idx[i], idx[j] = idx[j], idx[i]
    return idx[:k]


@functools.lru_cache(4)
def projection_matrix(mode: str, rows: int, cols: int, seed: int, eps: float = 0.1) -> np.ndarray:
    """The (rows, cols) matrix of a random projection; each cell depends on its place and the seed."""
    s = U(seed)
    key = (np.arange(rows, dtype=U)[:, None] << U(32)) ^ np.arange(cols, dtype=U)[None, :]
    if mode == "achlioptas":
        h = H.mix(key ^ s)
        return (np.where(h < U(0x2AAAAAAAAAAAAAAB), -1.0, 0.0) + np.where(h >= U(0xD555555555555555), 1.0, 0.0)) * np.sqrt(3 / rows)
    if mode == "gaussian":
        h0 = H.mix(key ^ s)
        h1 = H.mix(h0 ^ H.GOLDEN)
        u0, u1 = ((x >> U(11) | U(1)).astype(np.float64) / 2.0**53 for x in (h0, h1))
        return np.sqrt(-2 * np.log(u0)) * np.cos(2 * np.pi * u1) / np.sqrt(rows)
    if mode == "very_sparse":
        rare = max(1.0, np.sqrt(cols))
        u = _uniform(H.mix(key ^ s ^ U(SALT)))
        return np.where(u < 0.5 / rare, -1.0, np.where(u < 1 / rare, 1.0, 0.0)) * np.sqrt(rare / rows)
    if mode == "sparse_jl":
        per = min(rows, max(1, int(np.ceil(eps * rows))))
        out = np.zeros((rows, cols))
        with np.errstate(over="ignore"):
            for c in range(cols):
                own = H.mix(s ^ U(c) * H.GOLDEN)[()]
                r = _partial_shuffle(rows, per, own)
                sign = np.where(H.mix(own ^ (r.astype(U) * H.M1)) & U(1), -1.0, 1.0)
                out[r, c] = sign / np.sqrt(per)
        return out
    raise ValueError(mode)


@functools.lru_cache(4)
def fwht_plan(cols: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs, sampled rows) of the subsampled Hadamard projection."""
    pad = 1 << max(0, (cols - 1).bit_length())
    signs, state = np.empty(pad), H.mix(U(seed) ^ H.GOLDEN)[()]
    with np.errstate(over="ignore"):
        for i in range(pad):
            state = H.mix(state + U(i))[()]
            signs[i] = -1.0 if state & U(1) else 1.0
    return signs, _partial_shuffle(pad, rows, H.mix(U(seed) ^ H.M1)[()])


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unscaled Walsh-Hadamard transform of each row."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def project(x: np.ndarray, c: EncoderConfig) -> np.ndarray:
    if c.projection == "none":
        return x.astype(np.float64)
    if c.projection == "fwht":
        signs, rows = fwht_plan(c.sketch_dim, c.output_dim, c.projection_seed)
        wide = np.zeros((len(x), len(signs)))
        wide[:, : x.shape[1]] = x
        return hadamard(wide * signs)[:, rows] / np.sqrt(c.output_dim)
    return x @ projection_matrix(c.projection, c.output_dim, c.sketch_dim, c.projection_seed, c.sparse_eps).T


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def encode_texts(texts: list[str | None], c: EncoderConfig, idf: HashedIdf | None = None) -> np.ndarray:
    """The vectors of texts; null is as ''."""
    if idf is not None and (c.weighting != "raw" or c.signed_sqrt):
        raise ValueError("a weight table goes with raw counts")
    if idf is not None and not idf.compatible(c):
        raise ValueError("the weight table was learned under other settings")
    x = sketches([(t or "").encode() for t in texts], c, idf)
    y = project(x, c)
    if c.nested_weights is not None:
        y = y * np.asarray(c.nested_weights)
    elif c.nested_decay is not None:
        y = y / np.sqrt(1 + np.arange(y.shape[1]) / c.nested_decay)
    return unit(y) if c.normalise else y


def encode(docs: DataFrame, c: EncoderConfig = V1_384, idf: HashedIdf | None = None, key: str = "doc_id", text: str = "text", rows: int = 256, carry: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """(key, vec array<float>) of each row, with the columns to ``carry`` between them: one Arrow stage, ``rows`` texts at a time. ``exact`` keeps doubles."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(idf)
    names = [key, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                v = encode_texts(b.column(len(names)).to_pylist(), c, shared.value).astype(np.float64 if exact else np.float32)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], vec], names=[*names, "vec"])

    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{kinds}, vec array<{'double' if exact else 'float'}>")


def sketch_table(docs: DataFrame, c: EncoderConfig, idf: HashedIdf | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bucket, value): the count sketch of each row in long form, buckets of 0 left out."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x = sketches([(t or "").encode() for t in b.column(1).to_pylist()], c, shared.value)
                row, bucket = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(bucket), pa.array(x[row, bucket])], names=[key, "bucket", "value"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, bucket long, value double")


def learn_idf(docs: DataFrame, c: EncoderConfig = COMPACT, buckets: int = 65_536, scope: str = "all", text: str = "text") -> HashedIdf:
    """Weights round(1024 * ln((N + 1) / (df + 0.5))) of every bucket. Each task counts its own documents; one row a bucket and task is shuffled."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                h, mag = hashed_features((t or "").encode(), c)
                if scope != "all":
                    h = h[mag == (2 if scope == "char" else 1)]
                df[np.unique((h % U(buckets)).astype(np.int64))] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]])], names=["bucket", "df"])

    got = docs.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(buckets)
    inner = got[got.bucket >= 0]
    df[inner.bucket], n = inner.df, int(got[got.bucket < 0].df.sum())
    w = np.clip(np.floor(1024 * np.log((n + 1) / (df + 0.5)) + 0.5), 0, 65_535).astype(np.uint16)
    return HashedIdf(w, n, scope, c.features, c.least, c.most, c.bounded, c.fold, c.family, c.seed)


def builtin_sketch(docs: DataFrame, dim: int = 4096, least: int = 3, most: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bucket, value): the character count sketch by built-in expressions alone, with Spark's xxhash64."""
    from tarnwood.functions import text as T

    h = F.xxhash64("gram")
    grams = docs.select(key, F.explode(T.byte_ngrams(text, least, most)).alias("gram"))
    bucket = F.pmod(h.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(dim))
    return grams.groupBy(key, bucket.alias("bucket")).agg(F.sum(F.when(h < 0, -2).otherwise(2)).alias("value"))


def nested_weights(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """(dim, weight): each coordinate's population deviation over the mean one; 1 where all are 0."""
    sd = vectors.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.stddev_pop("x").alias("sd"))
    mean = sd.agg(F.avg("sd").alias("mean"))
    return sd.crossJoin(F.broadcast(mean)).select("dim", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(1.0).alias("weight"))
