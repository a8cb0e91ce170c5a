"""Operator 1: n-gram Jaccard join by PartEnum signatures.

Sets of word shingles are put into size bands; a band's pairs differ in at
most k features. The feature domain is cut into n1 parts with n1 * (LEAVE + 1)
> k, so some part holds at most LEAVE of the differences; each part is cut
into SUBPARTS, and the subsets of SUBPARTS - LEAVE of them are enumerated: one
subset holds no difference at all, and the hash of its features is a signature
that both sets share. Refinements that keep the join exact:

* Shingles that are frequent in the corpus (a bounded table, found by local
  counts) take no part in the first family of signatures; sets with too few
  rare shingles for the pigeonhole argument ("thin" ones) also sign with all
  their features in a second family.
* A subset in which a set has no feature signs nothing, unless the set is so
  small that all agreeing subsets could be empty.
* Signatures of up to SMALL sets give all their pairs, larger ones a star
  around one member. What stars leave in different components is compared in
  blocks of bounded size, first by sketches; what these leave possible, and for
  the number of links every component, is multiplied out in blocks of sets as
  incidence matrices. Blocks return counts and a spanning forest, never pairs.

A parity sketch of each set bounds the size of a difference from below, so
most false candidates go without their texts; the rest are verified on the
full sets, whose documents a filter of bounded size picks out in the scan.
Equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .store import discard, materialise, release, shuffle_partitions
from .words import hashed_words, mix, shingle_sets, slices

#: Largest bucket whose pairs are all emitted.
SMALL = 8
#: Shingles that local counts call frequent, at most; what each executor is sent is 8 bytes times this.
FREQUENT_MOST = 1 << 18
#: A shingle is frequent if the windows that hold it in two sets or more add up to so many sets.
FREQUENT_SETS = 8
#: Second-level cuts of a part of the feature domain, and how many of them a signature leaves out.
SUBPARTS, LEAVE = 3, 1
#: Features counted together.
WINDOW_FEATURES = 1 << 22
#: Words of 64 bits in a set's parity sketch, and bits of the filter that picks out documents by id.
SKETCH = 16
FILTER_BITS = 1 << 23
#: Members verified against one copy of their star's centre.
STAR_SHARE = 64
#: Sets and features of a block on average; two blocks are compared in one task.
BLOCK_SETS, BLOCK_FEATURES = 1024, 1 << 18

_SALT_BAND = np.uint64(0xD6E8FEB86659FD93)
_SALT_PART = np.uint64(0x9E3779B97F4A7C15)
_SALT_LEFT = np.arange(1, SUBPARTS + 1, dtype=np.uint64) * np.uint64(0x62B2AE3D27D4EB4F)


def set_keys(keys: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, independent of order; 0 for the empty set."""
    out = []
    n = np.diff(offsets)
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xA0761D6478BD642F)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ salt))])
        out.append(np.where(n > 0, mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64)), np.uint64(0)))
    return out[0], out[1]


def parity(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sketch of each set, n x SKETCH: bit i is the parity of its features that fall on i.

    A feature flips one bit, so two sketches differ in no more bits than their sets in features.
    """
    n, bits = len(offsets) - 1, 64 * SKETCH
    out = np.zeros((n, SKETCH), dtype=np.int64)
    for low in range(0, n, 1024):
        high = min(n, low + 1024)
        own = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
        bit = (keys[offsets[low] : offsets[high]] & np.uint64(bits - 1)).astype(np.int64)
        odd = (np.bincount(own * bits + bit, minlength=(high - low) * bits) & 1).astype(bool)
        out[low:high] = np.packbits(odd.reshape(high - low, bits), axis=1, bitorder="little").view(np.int64)
    return out


_WORDS = [f"w{i}" for i in range(SKETCH)]


def wide_sketches(keys: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """Parity sketches of sets larger than the bits of a short one, of as many bits at least as they have features; None for others.

    The number of bits is a power of two, so that exclusive or of its halves is the sketch of half as many.
    """
    out: list[bytes | None] = [None] * (len(offsets) - 1)
    for i in np.flatnonzero(np.diff(offsets) > 64 * SKETCH):
        own = keys[offsets[i] : offsets[i + 1]]
        bits = 1 << (len(own) - 1).bit_length()
        odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return out


def folded(sketch: bytes, size: int) -> np.ndarray:
    """Sketch of size words of 64 bits from a larger one."""
    x = np.frombuffer(sketch, dtype=np.uint64)
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def _allowed_by_wide(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """pairs(a, b) of large sets that wide(id, n, wide) leaves possible."""
    sides = [wide.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab"]

    def run(batches):
        for batch in batches:
            na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            most = (na + nb) * (den - num) // (den + num)
            keep = np.zeros(len(batch), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True)):
                size = min(len(x), len(y)) // 8
                keep[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum() <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long")


def _sketch_allows(l: str, r: str, num: int, den: int) -> str:
    """SQL: sizes and sketches of l and r leave a similarity of num / den possible."""
    apart = " + ".join(f"bit_count({l}.{w} ^ {r}.{w})" for w in _WORDS)
    return f"least({l}.n, {r}.n) * {den} >= greatest({l}.n, {r}.n) * {num} and ({apart}) * {den + num} <= ({l}.n + {r}.n) * {den - num}"


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs(id, text) whose id may be in ids; FILTER_BITS bits are sent to the executors, whatever the size of ids."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select((bit / 32).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) % 32 as int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    filled[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column(0))
            keep = (sent.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            yield batch.filter(pa.array(keep.astype(bool))).select([1, 2])

    return docs.select(bit.cast("long").alias("at"), "id", "text").mapInArrow(run, docs.select("id", "text").schema)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Bands:
    """Size bands of a threshold num / den and the first-level parts of each band's feature domain.

    There are `spread` times the parts that the differences need, so that a set
    stays safe with some parts empty, of which its frequent features are missing.
    """

    def __init__(self, num: int, den: int, spread: float = 1.35, largest: int = 1 << 40):
        low = [1]
        while low[-1] <= largest:
            low.append(low[-1] * den // num + 1)
        self.num, self.den, self.low = num, den, np.array(low, dtype=np.int64)
        high = self.low[1:] - 1
        #: Features in which two similar sets of a band differ at most, and the parts that this needs.
        self.apart = 2 * high * (den - num) // (den + num)
        self.parts = (spread * (self.apart // (LEAVE + 1) + 1)).astype(np.int64) + 1

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def distance(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Features in which a set of this size and one similar to it in the band can differ, at most."""
        return np.minimum(size * (self.den - self.num) // self.num, self.apart[band])

    def sql(self, size: str) -> str:
        """SQL: the band of a size below 2 ** 31."""
        return f"size(filter(array({', '.join(f'{x}L' for x in self.low if x < 1 << 31)}), x -> x <= {size})) - 1"


def signatures(bands: Bands, keys: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and the index of the set of each; common: sorted frequent features.

    In a part with a difference, the agreeing subset is the one without it: a
    set with features in two subparts or more signs a non-empty one whichever
    that is, a set with features in one subpart alone can lose it to a single
    difference. So a set is safe if its parts, counted twice or once, are more
    than the differences it can have; others are thin.
    """
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.minimum(np.searchsorted(common, keys), max(0, len(common) - 1))
    rare = common[at] != keys if len(common) else np.ones(len(keys), dtype=bool)
    signed, owners = [], []
    for step in (0, 1):
        band = bands.of(size) + step
        takes = size > 0
        if step:
            takes &= size * bands.den >= bands.low[band] * bands.num
        family, thin = 0, takes
        while family < 2 and thin.any():
            use = thin[owner] & (rare if family == 0 else True)
            feature, own = keys[use], owner[use]
            parts = bands.parts[band]
            # Features ascend, so the features of a part, and of a subpart, follow each other.
            fine = ((feature >> np.uint64(32)) * (SUBPARTS * parts[own]).astype(np.uint64)) >> np.uint64(32)
            fresh = np.ones(len(feature), dtype=bool)
            fresh[1:] = (own[1:] != own[:-1]) | (fine[1:] != fine[:-1])
            edge = np.flatnonzero(fresh)
            own, fine = own[edge], fine[edge].astype(np.int64)
            sub, part = fine % SUBPARTS, fine // SUBPARTS
            fresh = np.ones(len(edge), dtype=bool)
            fresh[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1])
            at = np.cumsum(fresh) - 1
            own, part = own[fresh], part[fresh]
            sums, held = np.zeros((len(own), SUBPARTS), np.uint64), np.zeros((len(own), SUBPARTS), bool)
            if len(edge):
                sums[at, sub], held[at, sub] = np.add.reduceat(mix(feature), edge), True
            salt = mix((band * 2 + family).astype(np.uint64) * _SALT_BAND)
            base = sums.sum(1) + mix(part.astype(np.uint64) * _SALT_PART + salt[own])
            filled = held.sum(1)
            for left in range(SUBPARTS):
                some = filled > held[:, left]
                signed.append(mix((base - sums[:, left] + _SALT_LEFT[left])[some]))
                owners.append(own[some])
            safe = np.bincount(own, np.minimum(LEAVE + 1, filled), len(size)).astype(np.int64)
            poor = thin & (safe <= bands.distance(size, band))
            if family == 1 and poor.any():
                for i in np.flatnonzero(poor):
                    full = np.zeros((parts[i], SUBPARTS), dtype=bool)
                    full[part[own == i]] = held[own == i]
                    empty, left = np.nonzero(full.sum(1)[:, None] == full)
                    signed.append(mix(mix(empty.astype(np.uint64) * _SALT_PART + salt[i]) + _SALT_LEFT[left]))
                    owners.append(np.full(len(empty), i))
            thin, family = poor, family + 1
    if not signed:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(signed), np.concatenate(owners)


def _digest(text: str, width: int, buckets: int):
    """Rows (id, n, k1, k2) of the documents, and rows (bucket, blob) of locally repeated shingles with their counts."""

    names = ["id", "n", "k1", "k2", *_WORDS, "wide", "bucket", "blob"]

    def run(batches):
        held, count, seen = [], 0, []

        def flush():
            if not held:
                return
            feature, times = np.unique(np.concatenate(held), return_counts=True)
            feature, times = feature[times > 1], times[times > 1]
            bucket = (feature >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            feature, times, bucket = feature[order], times[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [i for i in range(buckets) if edge[i] < edge[i + 1]]
            blobs = [feature[edge[i] : edge[i + 1]].tobytes() + times[edge[i] : edge[i + 1]].astype(np.uint32).tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64())] * (4 + SKETCH) + [pa.nulls(len(rows), pa.binary()), pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names)

        for whole in batches:
            for batch in slices(whole, text):
                keys, offsets = shingle_sets(*hashed_words(batch.column(text)), width)
                k1, k2 = set_keys(keys, offsets)
                n = np.diff(offsets)
                words = [pa.array(w) for w in np.ascontiguousarray(parity(keys, offsets).T)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), as_long(k1), as_long(k2), *words, pa.array(wide_sketches(keys, offsets), pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
                _, first = np.unique(k1, return_index=True)
                fresh = np.zeros(len(n), dtype=bool)
                fresh[first] = True
                if seen:
                    fresh &= ~np.isin(k1, np.concatenate(seen))
                held.append(keys[np.repeat(fresh, n)])
                seen.append(k1[fresh])
                count += len(held[-1])
                if count >= WINDOW_FEATURES:
                    yield from flush()
                    held, count, seen = [], 0, []
        yield from flush()

    return run


def _frequent(digests: DataFrame) -> np.ndarray:
    """Sorted frequent shingles, FREQUENT_MOST at most."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        feature, times = [], []
        for blob in frame["blob"]:
            n = len(blob) // 12
            feature.append(np.frombuffer(blob, np.uint64, n))
            times.append(np.frombuffer(blob, np.uint32, n, 8 * n))
        feature, inverse = np.unique(np.concatenate(feature), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(times)).astype(np.int64)
        keep = total >= FREQUENT_SETS
        return pd.DataFrame({"feature": feature[keep].view(np.int64), "total": total[keep]})

    counts = digests.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInPandas(add, "feature long, total long")
    top = counts.orderBy(F.desc("total"), "feature").limit(FREQUENT_MOST).select("feature").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def _sign(text: str, width: int, bands: Bands, buckets: int, common):
    """Rows (bucket, blob): set keys, signatures of each, and the low 32 bits of these signatures."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text):
                keys, offsets = shingle_sets(*hashed_words(batch.column(text)), width)
                k1, _ = set_keys(keys, offsets)
                n = np.diff(offsets)
                _, first = np.unique(k1, return_index=True)
                fresh = np.zeros(len(n), dtype=bool)
                fresh[first[n[first] > 0]] = True
                keys, k1 = keys[np.repeat(fresh, n)], k1[fresh]
                signed, owner = signatures(bands, keys, np.concatenate([[0], np.cumsum(n[fresh])]), common.value)
                bucket = (signed >> np.uint64(44)).astype(np.int64) % buckets
                order = np.lexsort((owner, bucket))
                signed, owner, bucket = signed[order].astype(np.uint32), owner[order], bucket[order]
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                rows, blobs = [], []
                for i in range(buckets):
                    low, high = edge[i], edge[i + 1]
                    if low < high:
                        who, times = np.unique(owner[low:high], return_counts=True)
                        rows.append(i)
                        blobs.append(np.uint32(len(who)).tobytes() + k1[who].tobytes() + times.astype(np.uint32).tobytes() + signed[low:high].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def _pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Candidate pairs (a, b, star) of one range of signatures."""
    sets, signed = [], []
    for blob in frame["blob"]:
        m = int(np.frombuffer(blob, np.uint32, 1)[0])
        times = np.frombuffer(blob, np.uint32, m, 4 + 8 * m)
        sets.append(np.repeat(np.frombuffer(blob, np.uint64, m, 4), times))
        signed.append(np.frombuffer(blob, np.uint32, int(times.sum()), 4 + 12 * m))
    sets, signed = np.concatenate(sets), np.concatenate(signed)
    # Most signatures occur once: their sets are never put in order.
    order = np.argsort(signed, kind="stable")
    signed = signed[order]
    same = signed[1:] == signed[:-1]
    shared = np.zeros(len(signed), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    sets, signed = sets[order[shared]], signed[shared]
    order = np.lexsort((sets, signed))
    sets, signed = sets[order], signed[order]
    fresh = np.ones(len(sets), dtype=bool)
    fresh[1:] = (sets[1:] != sets[:-1]) | (signed[1:] != signed[:-1])
    sets, signed = sets[fresh], signed[fresh]
    start = np.flatnonzero(np.concatenate([[True], signed[1:] != signed[:-1]])) if len(signed) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(signed)))
    a, b, star = [], [], []
    for m in range(2, SMALL + 1):
        low = start[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                a.append(sets[low + i])
                b.append(sets[low + j])
                star.append(np.zeros(len(low), dtype=bool))
    large = size > SMALL
    within = np.repeat(large, size)
    centre = np.repeat(start, size)[within]
    mine = np.flatnonzero(within)
    a.append(sets[centre][centre != mine])
    b.append(sets[mine][centre != mine])
    star.append(np.ones(len(a[-1]), dtype=bool))
    a, b, star = map(np.concatenate, (a, b, star))
    order = np.lexsort((~star, b, a))
    a, b, star = a[order], b[order], star[order]
    fresh = np.ones(len(a), dtype=bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pd.DataFrame({"a": a[fresh].view(np.int64), "b": b[fresh].view(np.int64), "star": star[fresh]})


def _verify(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(a, b, shared, na, nb) of document pairs (a, b); docs: (id, text).

    The centre's text goes once to each share of its partners and comes first
    there, so a task holds one set at a time, however large a star is.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(STAR_SHARE)).alias("shares"))
    spread = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), F.col("b").alias("id"), F.lit(False).alias("centre"))
    spread = materialise(spread.union(spread.select("a", "share").distinct().select("a", "share", F.col("a").alias("id"), F.lit(True))), "spread")
    picked = _picked(docs, spread.select("id"))
    rows = spread.join(picked, "id").select("id", "text", "a", "share", "centre")
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "a", "share").sortWithinPartitions("a", "share", F.desc("centre"))

    def run(batches):
        at, centre = None, None
        for whole in batches:
            for batch in slices(whole, "text"):
                keys, offsets = shingle_sets(*hashed_words(batch.column("text")), width)
                out = []
                ids, a, share, lead = (batch.column(c).to_pylist() for c in ("id", "a", "share", "centre"))
                for i, key in enumerate(zip(a, share, strict=True)):
                    own = keys[offsets[i] : offsets[i + 1]]
                    if lead[i]:
                        at, centre = key, own.copy()
                    elif at == key:
                        where = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                        out.append((a[i], ids[i], int(np.count_nonzero(centre[where] == own)), len(centre), len(own)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)], ["a", "b", "shared", "na", "nb"])

    return rows.mapInArrow(run, "a long, b long, shared long, na long, nb long").distinct()


def _cells(rows: DataFrame, group: list[str], n: str, bands: Bands) -> DataFrame:
    """rows with the cells that compare them: (cell, side, *columns), a row for each other block of its group.

    The sets of a size band are cut into blocks by a hash of their ids, and
    blocks are compared within the band and with those of the next one.
    """
    rows = rows.withColumn("band", F.expr(bands.sql(n)))
    blocks = rows.groupBy(*group, "band").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum(n) / F.lit(BLOCK_FEATURES))).cast("int").alias("blocks"))
    at = lambda step: blocks.select(*group, (F.col("band") - step).alias("band"), F.col("blocks").alias(f"b{step + 1}"))
    # Own blocks, those of the band above and of the band below.
    near = blocks.join(at(1), [*group, "band"], "left").join(at(-1), [*group, "band"], "left")
    columns = [c for c in rows.columns if c not in (*group, "band")]
    placed = rows.join(near, [*group, "band"]).withColumn("k", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    to = F.expr("""concat(
        transform(sequence(0, blocks - 1), j -> struct(band as low, 0 as up, least(k, j) as i, greatest(k, j) as j, int(k > j) as side)),
        if(b2 is null, array(), transform(sequence(0, b2 - 1), j -> struct(band as low, 1 as up, k as i, j as j, 0 as side))),
        if(b0 is null, array(), transform(sequence(0, b0 - 1), j -> struct(band - 1 as low, 1 as up, j as i, k as j, 1 as side))))""")
    sent = placed.select(*group, *columns, F.explode(to).alias("to"))
    # One block alone is compared with itself.
    return sent.select(F.struct(*group, "to.low", "to.up", "to.i", "to.j").alias("cell"), F.col("to.side").alias("side"), F.expr("to.up = 0 and to.i = to.j").alias("alone"), *columns)


def _each_cell(rows: DataFrame, columns: list[str], solve: Callable, schema: str) -> DataFrame:
    """solve(list of row tuples of columns, list of sides, alone) for every cell, streamed in order of the cells: a task holds one at a time."""
    spark = rows.sparkSession
    rows = rows.select(F.xxhash64("cell").alias("h"), F.to_json("cell").alias("cell"), "side", "alone", *columns)
    rows = rows.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h", "cell", "side")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        now, held = None, []

        def done():
            out = solve(held, now[1]) if held else []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names)

        for batch in batches:
            keys = list(zip(batch.column("cell").to_pylist(), batch.column("alone").to_pylist(), strict=True))
            parts = list(zip(batch.column("side").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True))
            for key, part in zip(keys, parts, strict=True):
                if key != now:
                    yield done()
                    now, held = key, []
                held.append(part)
        yield done()

    return rows.mapInArrow(run, schema)


def _forest(pairs) -> list[tuple[int, int]]:
    """The pairs (of labels, with the ids that stand for them) that join what earlier ones left apart."""
    top: dict[int, int] = {}

    def root(x):
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for la, lb, a, b in pairs:
        if (x := root(la)) != (y := root(lb)):
            top[x] = y
            out.append((a, b))
    return out


def _possible(num: int, den: int):
    """Of a cell of (side, id, label, n, sketch, wide): a forest of pairs of different labels that sizes and sketches leave possible."""

    def solve(rows, alone):
        side = np.array([r[0] for r in rows])
        ids, label, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))
        words = min(len(r[5]) // 8 if r[5] else SKETCH for r in rows)
        sketch = np.stack([folded(r[5], words) if r[5] else np.array(r[4], dtype=np.int64).view(np.uint64) for r in rows])
        names, at, times = np.unique(label, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return []
        # Members of the most common label meet the others alone.
        odd = np.flatnonzero(at != times.argmax())
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for low in range(0, len(odd), 64):
            mine = odd[low : low + 64]
            differ = np.zeros((len(mine), len(rows)), dtype=np.int64)
            for w in range(words):
                differ += np.bitwise_count(sketch[mine, w][:, None] ^ sketch[:, w][None])
            a, b = n[mine][:, None], n[None]
            able = (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (differ * (den + num) <= (a + b) * (den - num)) & (label[mine][:, None] != label[None])
            if not alone:
                able &= side[mine][:, None] != side[None]
            for i, j in zip(*np.nonzero(able), strict=True):
                x, y = int(mine[i]), int(j)
                found.setdefault((int(label[x]), int(label[y])), (int(ids[x]), int(ids[y])))
        return _forest((la, lb, a, b) for (la, lb), (a, b) in found.items())

    return solve


def shared_features(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Number of features that each of sets has in common with each of others; features are distinct within a set."""
    p, q = len(sets), len(others)
    every = np.concatenate([*sets, *others])
    _, code = np.unique(every, return_inverse=True)
    split = sum(map(len, sets))
    row, column = np.repeat(np.arange(p), [len(x) for x in sets]), np.repeat(np.arange(q), [len(x) for x in others])
    left, right = code[:split], code[split:]
    many = code.max(initial=-1) + 1
    dl, dr = np.bincount(left, minlength=many), np.bincount(right, minlength=many)
    out = np.zeros((p, q), dtype=np.float32)
    # Features that few pairs share are added pair by pair, others by a product of incidence matrices.
    for dense in (False, True):
        kind = (dl > 0) & (dr > 0) & ((dl * dr > 64) == dense)
        new = np.cumsum(kind) - 1
        use_l, use_r = kind[left], kind[right]
        l, r, x, y = new[left[use_l]], new[right[use_r]], row[use_l], column[use_r]
        width = int(kind.sum())
        if not width:
            continue
        if dense:
            ol, orr = np.argsort(l, kind="stable"), np.argsort(r, kind="stable")
            l, x, r, y = l[ol], x[ol], r[orr], y[orr]
            for low in range(0, width, 2048):
                high = min(width, low + 2048)
                a, b = np.zeros((p, high - low), np.float32), np.zeros((q, high - low), np.float32)
                at = slice(*np.searchsorted(l, (low, high)))
                a[x[at], l[at] - low] = 1
                at = slice(*np.searchsorted(r, (low, high)))
                b[y[at], r[at] - low] = 1
                out += a @ b.T
        else:
            order = np.argsort(r, kind="stable")
            r, y = r[order], y[order]
            first, times = np.searchsorted(r, l), dr[kind][l]
            place = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out += np.bincount(np.repeat(x, times) * q + y[place], minlength=p * q).reshape(p, q)
    return out


def _multiplied(width: int, num: int, den: int):
    """Of a cell of (side, id, label, text): (id, null, links) of sets with links in it, and (id, id, null) of a forest of links across labels."""

    def solve(rows, alone):
        # Repeated rows of an id are one node here.
        rows = list({(r[0], r[1]): r for r in rows}.values())
        keys, offsets = shingle_sets(*hashed_words(pa.array([r[3] for r in rows], pa.string())), width)
        sets = [keys[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        left = [i for i, r in enumerate(rows) if alone or not r[0]]
        right = left if alone else [i for i, r in enumerate(rows) if r[0]]
        if not left or not right:
            return []
        shared = shared_features([sets[i] for i in left], [sets[i] for i in right])
        n, ids, label = np.diff(offsets), np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64)
        left, right = np.array(left), np.array(right)
        linked = shared * den >= (n[left][:, None] + n[right][None] - shared) * num
        linked &= ids[left][:, None] != ids[right][None]
        out = []
        for who, many in [(left, linked.sum(1))] + ([] if alone else [(right, linked.sum(0))]):
            out += [(int(ids[i]), None, int(m)) for i, m in zip(who, many, strict=True) if m]
        across = linked & (label[left][:, None] != label[right][None])
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for i, j in zip(*np.nonzero(across), strict=True):
            x, y = left[i], right[j]
            found.setdefault((int(label[x]), int(label[y])), (int(ids[x]), int(ids[y])))
        return out + [(a, b, None) for a, b in _forest((la, lb, a, b) for (la, lb), (a, b) in found.items())]

    return solve


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100, links: bool = True) -> DataFrame:
    """Links and components of the documents whose word-shingle sets have a Jaccard similarity of num / den or more.

    Returns (doc_id, n_shingles, component_id, class_id, n_links), one row per
    input row: set size, smallest id reachable by links, smallest id with an
    equal set, number of other sets that are similar (equal sets count as one).
    With links=False n_links is left out, and pairs that the components do not
    need are not verified. A null text, an empty one and one without words have
    an empty set and link with nothing. A row with a null id links with nothing
    and keeps null ids. An id names one text; repeated rows of it give repeated
    result rows. Other columns are ignored. An empty table gives an empty
    result.
    """
    if not 0 < num < den:
        raise ValueError("the threshold must lie between 0 and 1")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = 1 << max(4, (shuffle_partitions(spark) - 1).bit_length())
    bands = Bands(num, den)
    digests = materialise(docs.mapInArrow(_digest("text", width, buckets), f"id long, n long, k1 long, k2 long, {', '.join(f'{w} long' for w in _WORDS)}, wide binary, bucket int, blob binary"), "digests")
    members = digests.where("bucket is null").select("id", "n", "k1", "k2", *_WORDS)
    nodes = materialise(members.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("class"), F.max("n").alias("n"), *(F.min(w).alias(w) for w in _WORDS)), "classes")
    common = spark.sparkContext.broadcast(_frequent(digests))

    known = docs.where("id is not null")
    signed = known.mapInArrow(_sign("text", width, bands, buckets, common), "bucket int, blob binary")
    found = signed.groupBy("bucket").applyInPandas(_pairs, "a long, b long, star boolean")
    found = found.groupBy("a", "b").agg(F.max("star").alias("star"))
    sides = [nodes.select(F.col("k1").alias(x), F.col("class").alias(f"c{x}"), F.struct("n", *_WORDS).alias(f"s{x}")) for x in "ab"]
    found = found.join(sides[0], "a").join(sides[1], "b").where("ca <> cb")
    found = found.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "star", F.expr(_sketch_allows("sa", "sb", num, den)).alias("able"), F.expr(f"least(sa.n, sb.n) > {64 * SKETCH}").alias("large"))
    found = materialise(found.where("star or able"), "candidates")
    release(spark)

    # A short sketch says little of a large set.
    wide = digests.where("wide is not null and id is not null").select("id", "n", "wide").dropDuplicates(["id"])
    able = found.where("able and not large").select("a", "b").union(_allowed_by_wide(found.where("able and large").select("a", "b"), wide, num, den))
    able = materialise(able, "able")
    near = materialise(_verify(able, known, width).where(f"shared * {den} >= (na + nb - shared) * {num}").select("a", "b"), "links")
    release(spark)
    labels = connected_components(near)
    sketches = nodes.select(F.col("class").alias("id"), "n", *_WORDS)
    labelled = sketches.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))

    # Stars whose members are in different components: which of these could still be one.
    stars = found.where("star").select("a", "b")
    groups = stars.union(stars.select("a", F.col("a").alias("b"))).distinct().withColumnRenamed("b", "id")
    groups = materialise(groups.join(labelled.select("id", "label"), "id"), "stars")
    open_ = groups.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("a")
    torn = groups.join(open_, "a", "left_semi")
    torn = torn.join(sketches, "id").join(wide.select("id", "wide"), "id", "left").select("a", "id", "label", "n", F.array(*_WORDS).alias("sketch"), "wide")
    maybe = materialise(_each_cell(_cells(torn, ["a"], "n", bands), ["id", "label", "n", "sketch", "wide"], _possible(num, den), "a long, b long"), "possible")

    # Components and what could join them are multiplied out: those of several labels, and for the links those of three sets or more.
    own = labelled.select("id", "label")
    edges = maybe.join(own.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(own.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    merged = connected_components(edges.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    whole = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("whole")), "label", "left").select(F.col("node").alias("id"), "label", F.coalesce("whole", "label").alias("whole"))
    # Sets without a link so far that could have one.
    alone = merged.join(labels.select("label"), merged["node"] == labels["label"], "left_anti").select(F.col("node").alias("id"), F.col("node").alias("label"), merged["label"].alias("whole"))
    whole = materialise(whole.union(alone), "whole")
    wide = whole.groupBy("whole").agg(F.count("*").alias("sets"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high" + (" or sets > 2" if links else "")).select("whole")
    asked = whole.join(wide, "whole", "left_semi").join(sketches.select("id", "n"), "id")
    asked = materialise(_cells(asked, ["whole"], "n", bands).select("cell", "side", "alone", "id", "label"), "cells")
    texts = asked.join(_picked(known, asked.select("id")), "id")
    solved = materialise(_each_cell(texts, ["id", "label", "text"], _multiplied(width, num, den), "a long, b long, links long"), "solved")
    release(spark)
    again = solved.where("b is not null").select("a", "b")
    if not again.isEmpty():
        labels = connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(again))

    named = nodes.join(labels, nodes["class"] == labels["node"], "left").select("k1", "k2", "class", F.coalesce("label", "class").alias("component"))
    has = F.col("n") > 0
    counted = []
    if links:
        # A set that was not multiplied out is alone or one of two.
        many = solved.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
        pair = whole.join(wide, "whole", "left_anti").select(F.col("id").alias("class"), F.lit(1).cast("long").alias("links"))
        named = named.join(many.union(pair), "class", "left")
        counted = [F.when(has & F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links")]
    named = materialise(named, "named")
    members = materialise(members.select("id", "n", "k1", "k2"), "members")
    discard(digests, nodes, found, able, near, groups, maybe, whole, asked, solved)
    return members.join(named, ["k1", "k2"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(has & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"),
        F.when(has & F.col("id").isNotNull(), F.col("class")).otherwise(F.col("id")).alias("class_id"),
        *counted,
    )
