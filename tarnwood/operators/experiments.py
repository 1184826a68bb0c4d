"""Experiments: manifests and their policies, calibrated coordinates, feature-family charts, the six-leg fusion."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions import vectors as V
from tarnwood.session import keep

from . import embed, evaluate, fusion, geometry, rankers, recipes


@dataclass
class Manifest:
    metadata: dict[str, str]
    variants: dict[str, dict[str, str]] = field(default_factory=dict)

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps([self.metadata, self.variants], sort_keys=True).encode()).hexdigest()


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"'}


def _value(raw: str, line: int) -> str:
    raw = raw.strip()
    if raw.startswith('"'):
        m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"', raw)
        if not m or any(e not in _ESCAPES for e in re.findall(r"\\(.)", m[1])):
            raise ValueError(f"line {line}: a string that isn't closed or has an unknown escape")
        return re.sub(r"\\(.)", lambda e: _ESCAPES[e[1]], m[1])
    if raw.startswith("'"):
        if len(raw) < 2 or raw[-1] != "'" or "'" in raw[1:-1]:
            raise ValueError(f"line {line}: a string that isn't closed")
        return raw[1:-1]
    return raw


def _bare(line: str) -> str:
    """The line without a comment; a # inside quotes is no comment."""
    quote, i = "", 0
    while i < len(line):
        c = line[i]
        if quote:
            i += c == "\\" and quote == '"'
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#":
            return line[:i]
        i += 1
    return line


def parse_manifest(text: str) -> Manifest:
    """Lines of ``key = value``, and sections ``[variant.name]``; duplicates, unknown sections and missing kinds are errors."""
    out = Manifest({})
    own = out.metadata
    for k, line in enumerate(text.splitlines(), 1):
        line = _bare(line).strip()
        if not line:
            continue
        if line.startswith("["):
            m = re.fullmatch(r"\[variant\.([A-Za-z0-9_-]+)\]", line)
            if not m:
                raise ValueError(f"line {k}: not a variant section")
            if m[1] in out.variants:
                raise ValueError(f"line {k}: variant {m[1]} again")
            own = out.variants[m[1]] = {}
            continue
        key, sep, raw = line.partition("=")
        key = key.strip()
        if not sep or not key:
            raise ValueError(f"line {k}: no key and value")
        if key in own:
            raise ValueError(f"line {k}: {key} again")
        own[key] = _value(raw, k)
    if out.metadata.get("schema") != "1" or not out.metadata.get("name") or not out.variants:
        raise ValueError("a manifest needs schema 1, a name and a variant")
    if any("kind" not in v for v in out.variants.values()):
        raise ValueError("a variant needs a kind")
    return out


def as_int(raw: str) -> int:
    if not re.fullmatch(r"[0-9]+|0x[0-9a-fA-F]+", raw):
        raise ValueError(f"no integer: {raw}")
    return int(raw, 0 if raw.lower().startswith("0x") else 10)


def as_bool(raw: str) -> bool:
    table = dict.fromkeys(("true", "1", "yes", "on"), True) | dict.fromkeys(("false", "0", "no", "off"), False)
    if raw not in table:
        raise ValueError(f"no truth value: {raw}")
    return table[raw]


def resolve(variant: dict[str, str], kinds: dict[str, type]) -> object:
    """A configuration from a variant's parameters by its kind's dataclass; unknown keys are errors."""
    kind = variant["kind"]
    if kind not in kinds:
        raise ValueError(f"no variant kind {kind!r}")
    fields = kinds[kind].__dataclass_fields__
    unknown = variant.keys() - fields.keys() - {"kind"}
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    read = {"int": as_int, "float": float, "bool": as_bool, "str": str}
    return kinds[kind](**{k: read[str(fields[k].type).split(" |")[0]](v) for k, v in variant.items() if k != "kind"})


@dataclass(frozen=True)
class CoordinateConfig:
    prefix: int = 32
    mode: str = "fixed"
    blend: float = 0.5
    kind: str = "standardise"
    margin: float = 0.05
    k: int = 100


@dataclass(frozen=True)
class AtlasConfig:
    mode: str = "independent"
    depth: int = 100


KINDS = {"encoder": embed.EncoderConfig, "bm25": rankers.Params, "geometry": geometry.GeometryConfig, "coordinate": CoordinateConfig, "atlas": AtlasConfig, "reranker": recipes.RerankerConfig}


def check_policy(mode: str, split: str, variants: int, lineage: str | None = None) -> None:
    """Exploration may not read the holdout; a frozen run has one variant and names where it comes from."""
    if mode not in ("exploration", "frozen"):
        raise ValueError(f"no run mode {mode!r}")
    if mode == "exploration" and split == "test":
        raise ValueError("exploration can't read the holdout")
    if mode == "frozen" and (variants != 1 or not lineage):
        raise ValueError("a frozen run needs one variant and its lineage")


def check_regime(regime: str, kinds: list[str]) -> None:
    """Without artifacts only encoders may run."""
    if regime not in ("artifact_free", "corpus_fitted"):
        raise ValueError(f"no training regime {regime!r}")
    if regime == "artifact_free" and any(k != "encoder" for k in kinds):
        raise ValueError("without artifacts only encoder variants may run")


def result_rows(per_query: DataFrame, variant: str, manifest: Manifest) -> DataFrame:
    """One JSON document a variant, with its mean metrics."""
    mean = evaluate.mean_metrics(per_query)
    named = mean.select(F.lit("experiment.result.v1").alias("schema"), F.lit(manifest.metadata["name"]).alias("experiment"), F.lit(variant).alias("variant"), F.lit(manifest.fingerprint()).alias("manifest"), F.struct(*mean.columns).alias("metrics"))
    return named.select(F.to_json(F.struct("*")).alias("value"))


def _moments(vectors: DataFrame) -> DataFrame:
    """One row: the means and deviations of all coordinates, as arrays."""
    per = vectors.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("dim", "m", "s")))
    return per.agg(rows.alias("r")).select(F.transform("r", lambda x: x["m"]).alias("mean"), F.transform("r", lambda x: x["s"]).alias("sd"))


def calibrate(vectors: DataFrame, moments: DataFrame, kind: str = "standardise", shrink: float = 0.5) -> DataFrame:
    """Unit vectors with each coordinate centred, or divided by its deviation shrunk towards the mean one."""
    level = F.aggregate("sd", F.lit(0.0), lambda s, x: s + x) / F.size("sd")
    inverse = V.let(level, lambda m: F.transform("sd", lambda s: 1 / (F.lit(shrink) * m + F.lit(1 - shrink) * s + 1e-9))) if kind == "standardise" else F.transform("sd", lambda s: F.lit(1.0))
    # of one row, made before it meets the vectors
    met = vectors.crossJoin(F.broadcast(moments.select("mean", inverse.alias("inverse"))))
    out = V.l2_normalize(V.affine(F.col("vec"), F.col("mean"), F.col("inverse"))) if kind != "none" else V.l2_normalize(F.col("vec"))
    return met.withColumn("vec", out).select(*vectors.columns)


def coordinate_search(queries: DataFrame, docs: DataFrame, prefix: int, mode: str = "fixed", blend: float = 0.5, kind: str = "standardise", margin: float = 0.05, k: int = 100) -> DataFrame:
    """(query_id, doc_id, score): cosines over the first ``prefix`` coordinates, full ones, or between.

    Modes: fixed (prefix), full, blend, and selective, which takes the full
    cosine for queries whose two best prefix cosines are within ``margin``.
    Coordinates are calibrated on the documents.
    """
    docs = keep(docs, "vectors")
    m = keep(_moments(docs), "moments")
    q, x = keep(calibrate(queries, m, kind), "asked"), keep(calibrate(docs, m, kind), "calibrated")
    cut = lambda df: df.withColumn("vec", V.prefix_normalize(F.col("vec"), prefix))
    if mode == "full":
        return evaluate.exact_dense(q, x, k).drop("rank")
    short = evaluate.exact_dense(cut(q), cut(x), k).drop("rank")
    if mode == "fixed":
        return short
    short = keep(short, "short")
    pool = short.join(q.withColumnRenamed("vec", "qv"), "query_id").join(x.withColumnRenamed("vec", "dv"), "doc_id")
    full = V.dot(F.col("qv"), F.col("dv"))
    if mode == "blend":
        return pool.select("query_id", "doc_id", (F.lit(blend) * F.col("score") + F.lit(1 - blend) * full).alias("score"))
    if mode == "selective":
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), "doc_id")
        lead = short.withColumn("nxt", F.lead("score").over(order)).withColumn("rn", F.row_number().over(order)).where("rn = 1")
        unsure = lead.select("query_id", (F.coalesce(F.col("score") - F.col("nxt"), F.lit(1.0)) < margin).alias("unsure"))
        return pool.join(unsure, "query_id").select("query_id", "doc_id", F.when(F.col("unsure"), full).otherwise(F.col("score")).alias("score"))
    raise ValueError(mode)


def coordinate_statistics(vectors: DataFrame) -> DataFrame:
    """One row: the length of the mean unit vector (anisotropy) and how many coordinates share the variance (effective dimension)."""
    unit = vectors.withColumn("vec", V.l2_normalize(F.col("vec")))
    per = unit.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return per.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("anisotropy"), (F.pow(F.sum("v"), 2) / F.sum(F.col("v") * F.col("v"))).alias("effective_dim"), F.count("*").alias("dim"))


def family_atlas(docs: DataFrame, queries: DataFrame, mode: str = "independent", depth: int = 100) -> DataFrame:
    """(query_id, doc_id, score): cosines in a chart of character features and one of words, each with its own document-frequency weights.

    ``independent`` adds query z-scores over the union of both pools, ``joint``
    encodes both kinds in one chart, ``joint_rms`` takes the root mean square of
    the two cosines, ``base_only`` characters alone, ``rrf`` fuses ranks.
    """
    def chart(features: str) -> DataFrame:
        c = embed.EncoderConfig(features=features, bounded=True, fold=True, sketch_dim=1024, output_dim=128, projection="fwht")
        idf = embed.learn_idf(docs, c)
        return evaluate.exact_dense(embed.encode(queries, c, idf, key="query_id"), embed.encode(docs, c, idf), depth).drop("rank")

    if mode == "joint":
        return chart("both")
    if mode == "base_only":
        return chart("char")
    legs = keep(fusion.legs(char=chart("char"), word=chart("word")), "charts")
    if mode == "joint_rms":
        # the root mean square of the two cosines, negative ones as 0, over the union of the pools
        both = fusion.over_pool(legs, fusion.pool_union(legs, depth), ["char", "word"])
        square = F.pow(F.greatest(F.col("score"), F.lit(0.0)), 2)
        return both.groupBy("query_id", "doc_id").agg(F.sqrt(F.avg(square)).alias("score"))
    if mode == "rrf":
        return fusion.rrf(legs)
    return fusion.convex_z(fusion.over_pool(legs, fusion.pool_union(legs, depth), ["char", "word"]), {"char": 0.5, "word": 0.5})


def six_leg_fusion(docs: DataFrame, queries: DataFrame, config: embed.EncoderConfig = embed.COMPACT, per_leg: int = 100, table: DataFrame | None = None, idf_weight: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score): 0.6 z(backoff dependence) + 0.4 z(Atire dependence) over the union of six legs' pools; with ``idf_weight`` the Atire leg takes that share."""
    p = recipes.six_legs(docs, queries, config, per_leg, table)
    if not idf_weight:
        return recipes.promoted(p)
    weights = {k: w * (1 - idf_weight) for k, w in recipes.PROMOTED.items()} | {"atire": idf_weight}
    return fusion.convex_z(p.over(list(weights)), weights)
