"""N-gram Jaccard join by parity sketches.

Each document is the set of its word trigrams. Sets with a Jaccard similarity
of at least t have t / (1 + t) * (a + b) tokens in common at least, a and b
being their sizes, so that they share one of their rarest tokens in any order
of tokens; sets are joined on those (``prefixes``), which finds every pair at
every size, and pairs that share fewer of them than near sets must
(``least_shared``) go before anything else is fetched for them. Tokens of a set are XORed into a parity sketch: a token toggles one
bit, so the Hamming distance of two sketches is never above the symmetric
difference of the sets. Candidates are pruned by that bound and verified on the
whole sets.

``block_keys`` has the sketches' blocks as keys of a join, by pigeonhole: two
sets of at most D = (1 - t) / (1 + t) * (a + b) different tokens agree on one of
D + 1 blocks. It loses pairs whose equal blocks are empty, and in bands of over
128 tokens it sees a hash sample alone; ``near_groups`` doesn't use it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .graph import components
from .runtime import Scratch, prepare

THRESHOLD, NGRAM, SAMPLE, BLOCKS, BITS = 0.55, 3, 128, 64, 1024
#: Sets of fewer tokens join on tokens, not on blocks.
SMALL = 16
#: Members of a bucket that are paired at once, and pairs held at once; greater buckets go block by block. Pairs looked at, or given, at once.
WIDE, PAIRS, LOOK = 1024, 1 << 21, 1 << 18
#: Cells of the table of tokens' counts, and documents it is made of, about; postings of a part, and documents of a tile.
CELLS, SAMPLE_DOCS, POSTINGS, TILE = 1 << 20, 50_000, 4_000_000, 256
#: Rounding that bounds allow for.
SLACK = 1e-6
#: Bits of the filter of ids, at most: 32 MB.
FILTER_BITS = 1 << 28
U = np.uint64


def blocks_of(level: int, threshold: float, sample: int = SAMPLE, most: int = BLOCKS) -> int:
    """Blocks of the sketches of one band: pigeonhole's D + 1, and in bands that join on samples ``most`` where that is more."""
    top = math.floor((1 - threshold) / (1 + threshold) * 2 * sample * 2.0 ** (min(level, 0) + 1))
    return max(1, top + 1 if level < 0 else min(most, top + 1))


def block_keys(sets: np.ndarray, first: np.ndarray, threshold: float, sample: int = SAMPLE, most: int = BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key, band) of every block or token that is joined on: a set of size s is in band floor(log2(s / sample)) and in the next one."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    level = level_of(size, sample)
    least = int(level_of(np.array([SMALL]), sample)[0])
    wide = max(most, 2 * sample + 1)
    tiny, small = small_keys(sets, first, level < least, threshold)
    docs, keys, bands = [tiny], [small], [level[tiny]]
    spread, place = tv.mix(sets ^ U(0x51ED270B)), tv.mix(sets ^ U(0x2545F491))
    for step in (0, 1):
        # a set of size s meets, in the next band up, sets of s / t tokens at most
        band = level + step
        joins = (level >= least) if not step else (size > 1) & (band >= least) & (np.floor(np.log2(size / threshold / sample + 1e-9)) >= band)
        g = band[doc]
        keep = joins[doc] & ((spread >> U(11)) < np.ldexp(1.0, 53 - np.maximum(g, 0)).astype(U))
        d, h, g, p = doc[keep], sets[keep], g[keep], place[keep]
        if not len(d):
            continue
        table = {int(x): blocks_of(int(x), threshold, sample, most) for x in np.unique(g)}
        low = min(table)
        count = np.array([table.get(low + i, 1) for i in range(max(table) - low + 1)], U)
        block = (p % count[g - low]).astype(np.int64)
        code = d * wide + block
        order = np.argsort(code, kind="stable")
        code, h, g = code[order], h[order], g[order]
        at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        n = np.diff(np.r_[at, len(code)])
        xor = np.bitwise_xor.reduceat(h, at)
        g = g[at]
        # one token alone is no evidence where blocks are fewer than D + 1
        enough = n >= np.where(g >= 0, 2, 1)
        band_block = tv.mix((g + 64).astype(U) * U(wide) + (code[at] % wide).astype(U))
        docs.append((code[at] // wide)[enough])
        keys.append(tv.mix(xor ^ band_block)[enough])
        bands.append(g[enough])
    d, k, g = np.concatenate(docs), np.concatenate(keys), np.concatenate(bands)
    order = np.argsort(d, kind="stable")
    return d[order], k[order], g[order]


def small_keys(sets: np.ndarray, first: np.ndarray, small: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(doc, key) of the tokens that small sets join on, the same in all their bands."""
    size = np.diff(first)
    # other sets than its own copies can be near a set of s only if s / (s + 1) is enough
    joins = small & (size > 0) & (size >= threshold * (size + 1) - 1e-9)
    doc = np.repeat(np.arange(len(size)), size)
    keep = joins[doc]
    d, h = doc[keep], tv.mix(sets[keep] ^ U(0x6A09E667))
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    rank = np.arange(len(d)) - np.searchsorted(d, d)
    keep = rank < (size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)[d]
    return d[keep], h[keep]


def level_of(size: np.ndarray, sample: int = SAMPLE) -> np.ndarray:
    return np.floor(np.log2(np.maximum(size, 1) / sample)).astype(np.int64)


def bit_sketch(sets: np.ndarray, first: np.ndarray, keep: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sketch) of each set's chosen tokens: parity sketches of ``bits`` bits, of which every token flips one."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))[keep]
    cell, times = np.unique(doc * bits + ((sets[keep] >> U(7)) % U(bits)).astype(np.int64), return_counts=True)
    cell = cell[times % 2 == 1]
    out = np.zeros(n * (bits // 64), U)
    np.bitwise_or.at(out, cell >> 6, U(1) << (cell & 63).astype(U))
    return np.bincount(doc, minlength=n), out.view(np.int64).reshape(n, -1)


def _sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, first) of the documents of a column of texts, or of lists of texts, whose sets are put together."""
    if not pa.types.is_list(column.type):
        *_, first, h = tv.words(column)
        return tv.shingles(h, first, n)
    *_, first, h = tv.words(column.flatten())
    sets, at = tv.shingles(h, first, n)
    rows = column.offsets.to_numpy().astype(np.int64)
    rows = at[rows - rows[0]]
    parts = [np.unique(sets[x:y]) for x, y in zip(rows[:-1].tolist(), rows[1:].tolist())]
    return (np.concatenate(parts) if parts else sets[:0]), np.r_[0, np.cumsum([len(x) for x in parts], dtype=np.int64)]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about a slice of text each; the few rows of lists of texts one by one."""
    if pa.types.is_list(batch.column("text").type):
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)
        tv.trim()
    else:
        yield from tv.slices(batch)


KEYS = "doc_id long, f1 long, f2 long, size int"


def _keys(n: int):
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets, at = _sets(b.column("text"), n)
        size = np.diff(at)
        sums = [np.r_[U(0), np.cumsum(x)] for x in (sets, tv.mix(sets))]
        sums = [pa.array((e[at[1:]] - e[at[:-1]]).view(np.int64)) for e in sums]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *sums, pa.array(size.astype(np.int32))], names=["doc_id", "f1", "f2", "size"]).filter(pa.array(size > 0))

    return run


SETS = "doc_id long, tokens array<long>"


def _tokens(n: int):
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets, at = _sets(b.column("text"), n)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), tv.lists(sets.view(np.int64), at, pa.int64())], names=["doc_id", "tokens"])

    return run


def bits_of(size: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bits of the sketch of a set of that size: two a token at least, and ``bits`` times a power of two, so that a wider sketch folds to a narrower one."""
    return bits << np.ceil(np.log2(np.maximum(2 * size / bits, 1))).astype(np.int64)


def _sketches(n: int):
    """Rows (doc_id, tokens) of sketches: the size of the set and the words of its sketch."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets, at = _sets(b.column("text"), n)
        size = np.diff(at)
        bits = bits_of(size)
        for k in np.unique(bits).tolist():
            rows = np.flatnonzero(bits == k)
            own = sets[np.repeat(bits == k, size)]
            _, words = bit_sketch(own, np.r_[0, np.cumsum(size[rows])], np.ones(len(own), bool), k)
            values = np.hstack([size[rows, None], words])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), tv.lists(values.reshape(-1), np.arange(len(rows) + 1) * values.shape[1], pa.int64())], names=["doc_id", "tokens"])

    return run


def id_filter(ids: DataFrame, most: int = FILTER_BITS) -> np.ndarray | None:
    """A bitmap of the hashes of the ids, 16 bits an id; None, which lets all pass, where that is more than ``most`` bits."""
    n = ids.count()
    size = 1 << max(13, math.ceil(math.log2(16 * max(n, 1))))
    if size > most:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = tv.mix(b.column(0).to_numpy().view(U)) % U(size)
            # one row a byte that isn't 0; equal bytes are put together by the aggregation
            at = (h >> U(3)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 12), pa.array(h.astype(np.int64) & 0x7FFF)], names=["part", "bit"])

    parts = ids.mapInArrow(run, "part long, bit long").groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    out = np.zeros(max(size // 8, 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out[: size // 8]


def may_hold(bits: np.ndarray | None, ids: pa.Array) -> np.ndarray:
    """Which ids the bitmap may hold; never a null."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    if bits is None:
        return known
    h = tv.mix(pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).view(U)) % U(len(bits) * 8)
    return known & ((bits[(h >> U(3)).astype(np.int64)] >> (h & U(7)).astype(np.uint8)) & 1 == 1)


def _rows(over, without=(), within=()):
    """``over`` for slices of the rows whose ids none of the bitmaps ``without`` and all of those ``within`` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids = whole.column("doc_id")
            keep = np.ones(len(ids), bool)
            for wanted in within:
                keep &= may_hold(wanted.value, ids)
            for other in without:
                keep &= ~may_hold(other.value, ids)
            whole = whole.filter(pa.array(keep))
            if whole.num_rows:
                for b in _slices(whole):
                    yield from over(b)

    return run


def _some(without):
    """The rows whose ids one of the bitmaps may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.any([may_hold(x.value, b.column("doc_id")) for x in without], axis=0)))

    return run


def over_sets(docs: DataFrame, over, schema: str, without: tuple, within: tuple = (), among: DataFrame | None = None) -> DataFrame:
    """``over`` on all documents ``within``; rows with ids in ``without`` are grouped by doc_id first and, if given, must be ``among`` others."""
    without = tuple(x for x in without if x.value is None or x.value.any())
    plain = docs.mapInArrow(_rows(over, without, within), schema)
    if not without:
        return plain
    rest = docs.mapInArrow(_some(without), docs.schema).groupBy("doc_id").agg(F.collect_list("text").alias("text"))
    if among is not None:
        rest = rest.join(among.hint("merge"), "doc_id", "left_semi")
    return plain.unionByName(rest.mapInArrow(_rows(over, (), within), schema))


def least_common(size, threshold: float):
    """Tokens that a set of that size has in common with any near set, at least."""
    return np.ceil(threshold * size - SLACK).astype(np.int64)


def least_of_pair(sizes, threshold: float):
    """Tokens that two near sets have in common at least, by the sum of their sizes."""
    return np.ceil(threshold / (1 + threshold) * sizes - SLACK).astype(np.int64)


def least_shared(a, b, threshold: float):
    """Of their rarest tokens, as ``prefixes`` gives them, two near sets of those sizes share at least so many.

    Let the rarest tokens of x end before those of the other set, y. Of what
    they have in common, no more than the rest of x, ``least_common`` less one,
    comes behind that end; all before it is among the rarest of both.
    """
    return least_of_pair(a + b, threshold) - least_common(np.maximum(a, b), threshold) + 1


def prefixes(sets: np.ndarray, first: np.ndarray, load: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key, rank) of the rarest tokens of each set, of which any two sets that are near share one.

    A set of s tokens has s - ceil(t * s) others at most than those in common
    with a set that is near, so one more are enough in any order that all sets
    share; the order is by ``load``, the count of a token's cell, so that common
    tokens come last, and by hash. The key holds both.
    """
    size = np.diff(first)
    codes = (load[(sets & U(len(load) - 1)).astype(np.int64)].astype(U) << U(58)) | (tv.mix(sets ^ U(0x6A09E667)) >> U(6))
    count = np.where(size > 0, size - least_common(size, threshold) + 1, 0)
    parts = [np.sort(codes[a:e])[:k] for a, e, k in zip(first[:-1].tolist(), first[1:].tolist(), count.tolist())]
    doc = np.repeat(np.arange(len(size)), count)
    return doc, (np.concatenate(parts) if parts else codes[:0]), np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)


def loads(docs: DataFrame, n: int, rate: float, cells: int = CELLS) -> np.ndarray:
    """About how many documents of a hash sample hold a token of each cell, as four times a logarithm: a table of fixed size, by which tokens are put in order and nothing is left out."""
    parts = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(cells, np.int32)
        for whole in batches:
            ids = tv.mix(whole.column("doc_id").to_numpy().view(U) ^ U(0x3C6EF372))
            for b in tv.slices(whole.filter(pa.array((ids >> U(11)).astype(float) < rate * 2.0**53))):
                sets, _ = _sets(b.column("text"), n)
                out += np.bincount((sets & U(cells - 1)).astype(np.int64), minlength=cells).astype(np.int32)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(out, parts)], pa.binary())], names=["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("part").to_pylist(), b.column("n")):
                sums[k] = sums.get(k, 0) + np.frombuffer(x.as_buffer(), np.int32).astype(np.int64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.floor(2 * np.log2(x + 1)).clip(0, 63).astype(np.int8).tobytes()], pa.binary())], names=["part", "n"])

    found = docs.mapInArrow(count, "part int, n binary").repartition("part").mapInArrow(add, "part int, n binary")
    out = np.zeros(cells, np.int8)
    for r in found.toLocalIterator():
        out[r["part"] * (cells // parts) : (r["part"] + 1) * (cells // parts)] = np.frombuffer(bytes(r["n"]), np.int8)
    return out


#: One entry of a posting: a key's bits and the document's place in the head.
POSTING = np.dtype([("key", np.uint32), ("doc", np.uint16)])
HEAD = np.dtype([("id", np.int64), ("size", np.int64)])


def _postings(n: int, load, parts: int, threshold: float):
    """Rows (part, docs, entries): the rarest tokens of a slice's sets by parts of the keys."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets, at = _sets(b.column("text"), n)
        ids, size = b.column("doc_id").to_numpy(), np.diff(at)
        doc, key, _ = prefixes(sets, at, load.value, threshold)
        for low in range(0, len(ids), 1 << 16):
            here = slice(*np.searchsorted(doc, [low, low + (1 << 16)]).tolist())
            d, k = doc[here], key[here]
            # the low bits choose the part and the next ones tell keys apart in it; keys that are taken for equal only add to what is shared
            part = (k % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            d, k, part = d[order], k[order], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
            heads, entries = [], []
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
                own, place = np.unique(d[x:y], return_inverse=True)
                head, out = np.empty(len(own), HEAD), np.empty(y - x, POSTING)
                head["id"], head["size"] = ids[own], size[own]
                out["key"], out["doc"] = (tv.mix(k[x:y]) >> U(32)).astype(np.uint32), place
                heads.append(head.tobytes())
                entries.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(heads, pa.binary()), pa.array(entries, pa.binary())], names=["part", "docs", "entries"])

    return run


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, their sums): each code once, in order."""
    code, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code)
    code, n = code[order], n[order]
    at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else order
    return code[at], np.add.reduceat(n, at, dtype=np.int32) if len(at) else n


def met(key: np.ndarray, doc: np.ndarray, rank: np.ndarray | None, size: np.ndarray, threshold: float, wide: int = WIDE) -> Iterator[np.ndarray]:
    """The codes alone of ``meetings``."""
    for code, _ in meetings(key, doc, rank, size, threshold, wide):
        yield code


def meetings(key: np.ndarray, doc: np.ndarray, rank: np.ndarray | None, size: np.ndarray, threshold: float, wide: int = WIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code, n): codes low * len(size) + high of pairs of documents that sizes don't rule out, and how many keys they share; a pair may come again with further keys.

    No bucket is cut: those of over ``wide`` members are paired block by block.
    If ranks are given, keys count only if the ranks allow them to be a pair's
    first common one: of two near sets the smaller one has its first common
    token among its s - ceil(2t / (1 + t) * s) + 1 rarest; behind that token, the
    rest of either set must hold what they have in common besides.
    """
    # keys and places are sorted in one array, and only keys that several entries have are looked at further, so that a part takes about 20 bytes an entry
    code = key.astype(U)
    code <<= U(32)
    code |= np.arange(len(key), dtype=np.uint32)
    del key
    code.sort()
    shared = np.zeros(len(code) + 1, bool)
    np.less(code[1:] ^ code[:-1], U(1 << 32), out=shared[1:-1])
    code = code[shared[1:] | shared[:-1]]
    del shared
    place = (code & U(0xFFFFFFFF)).astype(np.int64)
    doc, rank, key = doc[place], None if rank is None else rank[place], (code >> U(32)).astype(np.uint32)
    del code, place
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[at, len(key)])

    def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = doc[i], doc[j]
        na, nb = size[a], size[b]
        ok = (a != b) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - SLACK)
        if rank is not None:
            least = np.minimum(na, nb)
            early = np.where(na < nb, rank[i], np.where(nb < na, rank[j], np.minimum(rank[i], rank[j])))
            ok &= (early <= least - least_of_pair(2 * least, threshold)) & (np.minimum(na - rank[i], nb - rank[j]) >= least_of_pair(na + nb, threshold))
        a, b = a[ok], b[ok]
        code, n = np.unique(np.minimum(a, b).astype(np.int64) * len(size) + np.maximum(a, b), return_counts=True)
        return code, n.astype(np.int32)

    held, total = [], 0
    for w in np.unique(count[count > 1]).tolist():
        own = at[count == w]
        if w <= wide:
            # not i and j, which the loop over the blocks sets: the next block would be made of this one's
            low, high = np.triu_indices(w, 1)
            step = max(1, LOOK // len(low))
            blocks = (((own[q : q + step, None] + low).ravel(), (own[q : q + step, None] + high).ravel()) for q in range(0, len(own), step))
        else:
            cuts = [(x, min(x + wide, w)) for x in range(0, w, wide)]
            blocks = ((np.repeat(np.arange(s + x, s + xe), ye - y), np.tile(np.arange(s + y, s + ye), xe - x)) for s in own.tolist() for k, (x, xe) in enumerate(cuts) for y, ye in cuts[k:])
        for i, j in blocks:
            held.append(fit(i, j))
            total += len(held[-1][0])
            if total > PAIRS:
                held = [_counted(held)]
                total = len(held[0][0])
                if total > PAIRS // 2:
                    yield held.pop()
                    total = 0
    if total:
        yield _counted(held)


def _records(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(records of all rows, number of each row) of a binary column, without a copy."""
    raw, off = tv.bytes_of(column)
    return raw.view(kind), np.diff(off) // kind.itemsize


def _meet(threshold: float, wide: int, counts: bool = False):
    """Pairs (a, b) of ids, a < b, of the rows of a partition, which is one part; with ``counts``, also how many keys of the part they share and how many of all parts near ones must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            (head, heads), (entries, each) = _records(b.column("docs"), HEAD), _records(b.column("entries"), POSTING)
            shift = (count + np.cumsum(heads) - heads).astype(np.int32)
            held.append((head["id"].copy(), head["size"].astype(np.int32), entries["key"].copy(), entries["doc"] + np.repeat(shift, each)))
            count += len(head)
            # what is read is kept as four plain arrays; the batch goes before the next one comes
            del b, head, entries
        if not count:
            return
        columns = [list(x) for x in zip(*held)]
        held.clear()
        ids, sizes, key, doc = (np.concatenate(columns.pop(0)) for _ in range(4))
        ids, place = np.unique(ids, return_inverse=True)
        size = np.zeros(len(ids), np.int32)
        size[place] = sizes
        own = [key, place.astype(np.int32)[doc]]
        del sizes, place, key, doc
        for code, n in meetings(own.pop(0), own.pop(0), None, size, threshold, wide):
            for q in range(0, len(code), LOOK):
                low, high = code[q : q + LOOK] // len(ids), code[q : q + LOOK] % len(ids)
                out = {"a": ids[low], "b": ids[high]}
                if counts:
                    out |= {"n": n[q : q + LOOK], "least": least_shared(size[low], size[high], threshold).astype(np.int32)}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out.values()], names=list(out))
        tv.trim()

    return run


def candidates(postings: DataFrame, parts: int, threshold: float, wide: int) -> DataFrame:
    """All pairs (a, b), a < b, that may be near; each part is a partition of its own, so that no task holds two."""
    met = postings.repartitionById(parts, "part").mapInArrow(_meet(threshold, wide, True), "a long, b long, n int, least int")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where("n >= least").select("a", "b")


def within(values: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sketches, as ``_sketches`` has them, don't rule the pair out.

    The Hamming distance of two parity sketches of whole sets is never above
    the sets' symmetric difference, so no near pair is ruled out. The wider
    sketch of two is folded.
    """
    values, width = values.view(U), np.diff(first) - 1
    size = values[first[:-1]].astype(np.int64)
    a, b = np.where(width[a] <= width[b], a, b), np.where(width[a] <= width[b], b, a)
    out, kinds = np.zeros(len(a), bool), width[a] * (1 << 32) + width[b]
    for kind in np.unique(kinds).tolist():
        x, y = kind >> 32, kind & 0xFFFFFFFF
        own = np.flatnonzero(kinds == kind)
        for q in range(0, len(own), max(1, (1 << 20) // y)):
            at = own[q : q + max(1, (1 << 20) // y)]
            left = values[first[a[at], None] + 1 + np.arange(x)]
            right = np.bitwise_xor.reduce(values[first[b[at], None] + 1 + np.arange(y)].reshape(len(at), y // x, x), axis=1)
            far = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            out[at] = far <= (1 - threshold) / (1 + threshold) * (size[a[at]] + size[b[at]]) + SLACK
    return out


def near(sets: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have at least that Jaccard similarity."""
    sets, size = sets.view(U), np.diff(first)
    out, order = np.zeros(len(a), bool), np.argsort(a, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(a[order]) != 0]) if len(a) else order
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)]):
        k = a[order[x]]
        one, others = sets[first[k] : first[k + 1]], b[order[x:y]]
        for q in range(0, y - x, 256):
            some = others[q : q + 256]
            tokens = np.concatenate([sets[first[k] : first[k + 1]] for k in some.tolist()])
            hit = one[np.minimum(np.searchsorted(one, tokens), len(one) - 1)] == tokens
            common = np.add.reduceat(hit, np.cumsum(size[some]) - size[some], dtype=np.int64)
            out[order[x + q : x + q + len(some)]] = common >= threshold * (len(one) + size[some] - common) - 1e-9
    return out


def _decide(test, threshold: float):
    """The pairs that pass the test, of rows sorted by tile: (tile, a, b) for pairs, (tile, a, tokens) for documents."""

    def decide(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        is_pair = pc.is_valid(t.column("b"))
        pairs, own = t.filter(is_pair), t.filter(pc.invert(is_pair))
        ids, at = np.unique(own.column("a").to_numpy(), return_index=True)
        tokens = own.column("tokens").combine_chunks().take(pa.array(at))
        a, b = (pairs.column(x).to_numpy() for x in ("a", "b"))
        first = tokens.offsets.to_numpy().astype(np.int64)
        ok = test(tokens.flatten().to_numpy(), first - first[0], np.searchsorted(ids, a), np.searchsorted(ids, b), threshold)
        return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            tile = b.column("tile").to_numpy()
            if held and held[-1].column("tile")[-1].as_py() != tile[0]:
                yield decide(held)
                held = []
            cut = int(np.searchsorted(tile, tile[-1]))
            if cut:
                yield decide([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
        if held:
            yield decide(held)
        tv.trim()

    return run


def passing(pairs: DataFrame, own: DataFrame, test, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that pass the test on their documents' rows of ``own``.

    Each document goes with the least of those it is paired with, so that the
    rows of a cluster move once to a tile and not once a pair; tiles of over
    ``TILE`` documents are split, and pairs across tiles bring both sides' rows.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = scratch.keep(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")), "label")
    split = label.groupBy("label").agg(F.ceil(F.count("*") / TILE).alias("n"))
    code = scratch.keep(label.join(split.hint("merge"), "label").select(F.col("a").alias("doc"), F.expr("xxhash64(label, pmod(xxhash64(a), n))").alias("code")), "code")
    tiled = pairs.join(code.hint("merge").withColumnsRenamed({"doc": "a", "code": "x"}), "a").join(code.hint("merge").withColumnsRenamed({"doc": "b", "code": "y"}), "b")
    tiled = scratch.keep(tiled.select(F.expr("xxhash64(least(x, y), greatest(x, y))").alias("tile"), "a", "b"), "tiled")
    needed = tiled.select("tile", "a").unionByName(tiled.select("tile", F.col("b").alias("a"))).distinct()
    needed = needed.join(own.withColumnRenamed("doc_id", "a").hint("merge"), "a").select("tile", "a", F.lit(None).cast("long").alias("b"), "tokens")
    rows = tiled.select("tile", "a", "b", F.lit(None).cast("array<long>").alias("tokens")).unionByName(needed)
    found = scratch.keep(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_decide(test, threshold), "a long, b long"), "passing")
    scratch.drop(label, code, tiled)
    return found


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, wide: int = WIDE) -> DataFrame:
    """(doc_id, keep_id, links): each document that is near another, the least doc_id of its group, and how many documents it is near.

    Two documents are linked if their sets of word ``n``-grams have a Jaccard
    similarity of at least ``threshold``; groups are the connected components.
    No link is left out; a document without links has no row. Words are
    runs of letters and digits, folded for ASCII and Latin-1. A text of fewer
    than ``n`` words is one gram; a text of any length is read whole; a null,
    empty or wordless text is in no group; a null doc_id is left out; rows that
    repeat a doc_id are one document with the grams of all of them. Equal sets
    are linked, and the least doc_id stands for them. Other columns, whatever
    their names, are not read. An empty table gives no rows. The keeper has a
    row too, with its own id twice.

    Sets that differ are joined on their rarest tokens, of which any two near
    sets share one (``prefixes``), all pairs of a bucket; parity sketches and
    the whole sets decide. Equal sets go through the join as one, and count as
    often as there are documents with them, so thousands of copies cost no
    thousands of squares.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    scratch = Scratch(spark, "parity")
    share = spark.sparkContext.broadcast
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    twice = scratch.keep(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    repeats = share(id_filter(twice))
    raw = scratch.keep(over_sets(docs, _keys(n), KEYS, (repeats,)), "keys")
    same = ["f1", "f2", "size"]
    # aggregates combine before they shuffle, so a third of all rows may be one set
    copies = scratch.keep(raw.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "copies")
    equal = scratch.keep(raw.join(copies.where("n > 1").hint("merge"), same).select("doc_id", "rep"), "equal")
    others = share(id_filter(equal.where("doc_id <> rep").select("doc_id")))
    total = copies.agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first()
    load = share(loads(docs, n, min(1.0, SAMPLE_DOCS / max(1, total["docs"]))))
    parts = max(8, math.ceil(total["tokens"] * (1 - threshold) / POSTINGS))
    postings = over_sets(docs, _postings(n, load, parts, threshold), "part int, docs binary, entries binary", (repeats, others), among=copies.select(F.col("rep").alias("doc_id")))
    pairs = scratch.keep(candidates(postings, parts, threshold, wide), "pairs")
    # a bitmap lets nearly only their documents through; first their sketches, then the sets of those that are left
    of = lambda p: (share(id_filter(p.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())),)
    sketches = scratch.keep(over_sets(docs, _sketches(n), SETS, (repeats,), of(pairs)), "sketches")
    left = passing(pairs, sketches, within, threshold, scratch)
    scratch.drop(pairs, sketches)
    sets = scratch.keep(over_sets(docs, _tokens(n), SETS, (repeats,), of(left)), "sets")
    edges = passing(left, sets, near, threshold, scratch)
    scratch.drop(left, sets)
    label = components(edges, scratch)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = copies.select(F.col("rep").alias("b"), "n")
    links = both.join(weight.hint("merge"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    about = links.join(label.hint("merge").withColumnRenamed("node", "rep"), "rep")
    many = copies.where("n > 1").select("rep", "n")
    about = about.join(many.hint("merge"), "rep", "full").select("rep", F.coalesce("root", "rep").alias("keep_id"), (F.coalesce("near", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links"))
    about = scratch.keep(about, "about")
    members = equal.unionByName(about.join(many.hint("merge"), "rep", "left_anti").select(F.col("rep").alias("doc_id"), "rep"))
    final = scratch.keep(members.join(about.hint("merge"), "rep").select("doc_id", "keep_id", "links"), "groups")
    scratch.drop(twice, raw, copies, equal, edges, about)
    return final


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """The documents without those whose group keeps another one, with all their columns.

    Rows with a null doc_id, and null, empty or wordless texts, stay; rows that
    repeat a doc_id stay or go together; an empty table stays empty.
    """
    gone = near_groups(docs, threshold, n).where("doc_id <> keep_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
