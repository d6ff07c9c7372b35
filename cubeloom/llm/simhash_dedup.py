"""SimHash fingerprints and their connected groups within a Hamming distance.

Candidates come from the generalised pigeonhole principle. The 64 bits are grouped into ``parts`` sets of
correlated bits; every distinct fingerprint gets its own thresholds t_i >= -1 for the parts with
sum(t_i) = distance - parts + 1, chosen by dynamic programming so that the candidates expected from
exact per-part histograms are fewest; it probes, in part i, all values within t_i bits. Two fingerprints
within the distance then meet in at least one bucket. Buckets are verified in numpy and give a spanning
forest of their true links, never all pairs. Buckets that the histograms show to be large are dealt in
blocks. Groups are the connected components of the links (see :mod:`graph`).

Defined cases: null or wordless text has fingerprint zero and is linked like any other; a null doc_id
never names a group (the group of null ids only is null); repeated rows appear as often as they came in;
an empty table gives no rows. Only two columns are read, so clashing names do not matter.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, picked, texts_of, thrifty
from .graph import components

DISTANCE = 4
PARTS = 4
SHINGLE = 4
RADIUS = 2  # largest threshold of a part
BLOCK = 16_384  # members of a bucket that one task verifies together


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    n = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # counts of 255 rows fit the bytes of a word, so eight bits are added at once
        bits = np.unpackbits(hashes[i : i + 255].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        ones += bits.sum(0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return picked(docs, id_col, text_col).mapInArrow(thrifty(run), "doc_id long, fp long")


def longs(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).to_numpy(zero_copy_only=False)


def correlated_parts(nodes: DataFrame, parts: int = PARTS) -> list[list[int]]:
    """Bit numbers of each part. Groups grow greedily from the bit most correlated with those left."""

    def run(batches):
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            bits = np.unpackbits(np.ascontiguousarray(longs(batch, 0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.reshape(-1), n))], ["k", "n"])

    got = dict(nodes.select("fp").mapInArrow(thrifty(run), "k long, n long").groupBy("k").agg(F.sum("n")).collect())  # 4097 rows at most
    n = max(1, got.get(4096, 0))
    both = np.array([got.get(k, 0) for k in range(4096)], float).reshape(64, 64) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    left, out = list(range(64)), []
    for k in range(parts):
        group = [max(left, key=lambda b: (near[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < 64 // parts + (k < 64 % parts):
            group.append(max(left, key=lambda b: (near[b, group].sum(), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def part_values(fps: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """(parts, n): the bits of each part packed into a number."""
    u = fps.view(np.uint64)
    out = np.zeros((len(parts), len(fps)), np.int64)
    for i, bits in enumerate(parts):
        for j, b in enumerate(bits):
            out[i] |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def histograms(nodes: DataFrame, parts: list[list[int]]) -> list[np.ndarray]:
    """Exact count of distinct fingerprints per value of each part: parts * 2**(64/parts) numbers, however many rows."""
    sizes = [1 << len(p) for p in parts]

    def run(batches):
        counts = [np.zeros(s, np.int64) for s in sizes]
        for batch in batches:
            for c, v in zip(counts, part_values(longs(batch, 0), parts), strict=True):
                c += np.bincount(v, minlength=len(c))
        for i, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["part", "value", "n"])

    got = nodes.select("fp").mapInArrow(thrifty(run), "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    out = [np.zeros(s, np.int64) for s in sizes]
    part, value, n = (got.column(c).to_numpy() for c in ("part", "value", "n"))
    for i in range(len(parts)):
        out[i][value[part == i]] = n[part == i]
    return out


def flips(width: int, radius: int) -> list[int]:
    """Masks of exactly ``radius`` set bits."""
    return [sum(1 << b for b in c) for c in combinations(range(width), radius)]


def within(counts: np.ndarray, width: int, radius: int) -> list[np.ndarray]:
    """For e = 0..radius the members within e bits of each value."""
    at, out = np.arange(len(counts)), [counts.copy()]
    for e in range(1, radius + 1):
        total = out[-1].copy()
        for m in flips(width, e):
            total += counts[at ^ m]
        out.append(total)
    return out


def thresholds(values: np.ndarray, near: list[list[np.ndarray]], widths: list[int], distance: int, radius: int) -> np.ndarray:
    """(parts, n) thresholds that sum to distance - parts + 1 with the fewest expected candidates, probes counted too."""
    parts, n = values.shape
    want = distance + 1  # sum of (t + 1)
    best = np.full((want + 1, n), np.inf)
    best[0] = 0
    picks = np.zeros((parts, want + 1, n), np.int8)
    for i in range(parts):
        new = np.full((want + 1, n), np.inf)
        for used in range(min(want, radius + 1) + 1):  # used = t + 1
            cost = 0.0 if used == 0 else near[i][used - 1][values[i]] + 4.0 * sum(len(flips(widths[i], e)) for e in range(used))
            for s in range(want - used + 1):
                c = best[s] + cost
                better = c < new[s + used]
                new[s + used][better] = c[better]
                picks[i, s + used][better] = used
        best = new
    out = np.zeros((parts, n), np.int64)
    s = np.full(n, want)
    for i in reversed(range(parts)):
        used = picks[i, s, np.arange(n)]
        out[i] = used - 1
        s = s - used
    return out


DATA, PROBE = 1, 2


def bucket_rows(nodes: DataFrame, parts: list[list[int]], counts: list[np.ndarray], distance: int, radius: int) -> DataFrame:
    """(bucket, fp, role): each fingerprint as data of its own bucket in every part, and as a probe of the buckets
    that its thresholds reach. A bucket that may hold over BLOCK members is dealt in data blocks x probe blocks."""
    widths = [len(p) for p in parts]
    near = [within(c, w, radius) for c, w in zip(counts, widths, strict=True)]
    blocks = [np.maximum(1, -(-x[-1] // BLOCK)) for x in near]

    def run(batches):
        for batch in batches:
            fps = np.ascontiguousarray(longs(batch, 0))
            values = part_values(fps, parts)
            t = thresholds(values, near, widths, distance, radius)
            for i in range(len(parts)):
                own = np.where(t[i] >= 0, DATA | PROBE, DATA)
                yield from dealt(i, values[i], fps, own)
                for e in range(1, radius + 1):
                    far = np.flatnonzero(t[i] >= e)
                    for m in flips(widths[i], e) if len(far) else []:
                        there = values[i][far] ^ m
                        some = counts[i][there] > 0
                        yield from dealt(i, there[some], fps[far[some]], np.full(int(some.sum()), PROBE))

    def dealt(i, value, fps, role):
        k = blocks[i][value]
        mine = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % k
        one = k == 1
        yield rows(i, value[one], np.zeros(int(one.sum()), np.int64), fps[one], role[one])
        if one.all():
            return
        for r, flag in ((DATA, DATA), (PROBE, PROBE)):
            some = np.flatnonzero(~one & (role & flag > 0))
            for other in range(int(k[some].max()) if len(some) else 0):
                now = some[k[some] > other]
                a, b = (mine[now], other) if r == DATA else (other, mine[now])
                yield rows(i, value[now], a * k[now] + b + 1, fps[now], np.full(len(now), r))

    def rows(i, value, block, fps, role):
        bucket = (block * len(parts) + i) * (1 << max(widths)) + value
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(fps), pa.array(role.astype(np.int8))], ["bucket", "fp", "role"])

    return nodes.select("fp").mapInArrow(thrifty(run), "bucket long, fp long, role byte")


def forest(fps: np.ndarray, distance: int) -> list[np.ndarray]:
    """Links of a spanning forest of the graph on ``fps``: a search that compares each member with those not yet reached."""
    rest, out = fps, []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            close = np.bitwise_count(rest ^ x) <= distance
            if close.any():
                hit, rest = rest[close], rest[~close]
                out.append(np.column_stack([np.full(len(hit), x), hit]))
                todo.extend(hit)
    return out


def verified(bucket: np.ndarray, fps: np.ndarray, role: np.ndarray, distance: int, small: int = 64) -> np.ndarray:
    """True links of whole buckets (rows sorted by bucket), as unsigned pairs, the smaller first."""
    u = fps.view(np.uint64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(bucket)))
    links = []
    for a, n in zip(first[size > small], size[size > small], strict=True):
        links += forest(np.unique(u[a : a + n]), distance)
    group = np.repeat(np.arange(len(first)), size)
    little = size[group] <= small
    data, probe = np.flatnonzero(little & (role & DATA > 0)), np.flatnonzero(little & (role & PROBE > 0))
    n_data = np.bincount(group[data], minlength=len(first))
    begin = np.cumsum(n_data) - n_data
    for chunk in np.array_split(probe, max(1, len(probe) * small // 4_000_000)):
        times = n_data[group[chunk]]
        left = np.repeat(chunk, times)
        right = data[np.repeat(begin[group[chunk]] - np.cumsum(times) + times, times) + np.arange(len(left))]
        x = u[left] ^ u[right]
        ok = (x != 0) & (np.bitwise_count(x) <= distance)
        if ok.any():
            links.append(np.column_stack([u[left[ok]], u[right[ok]]]))
    if not links:
        return np.zeros((0, 2), np.uint64)
    pairs = np.concatenate(links).astype(np.uint64)
    return np.unique(np.sort(pairs, axis=1), axis=0)


def links_between(nodes: DataFrame, distance: int = DISTANCE, parts: int = PARTS, radius: int = RADIUS) -> DataFrame:
    """(u, v) links among distinct fingerprints that connect whatever is within ``distance``. nodes: column fp, distinct."""
    groups = correlated_parts(nodes, parts)
    radius = min(radius, distance)
    dealt = bucket_rows(nodes, groups, histograms(nodes, groups), distance, radius)

    def run(batches):
        held = None
        for batch in batches:
            rows = [longs(batch, k) for k in range(3)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
            held = [x[whole:] for x in rows]
            yield pairs([np.ascontiguousarray(x[:whole]) for x in rows])
        if held is not None:
            yield pairs([np.ascontiguousarray(x) for x in held])

    def pairs(rows):
        got = verified(*rows, distance).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["u", "v"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(thrifty(run), "u long, v long")


def labelled(fps: DataFrame, distance: int) -> DataFrame:
    """fp, label, component_id of every distinct fingerprint; label tells groups apart also where no member has an id."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    label = components(links_between(nodes, distance)).withColumnRenamed("node", "fp")
    named = nodes.join(label, "fp", "left").select("fp", "id", F.coalesce("label", "fp").alias("label"))
    return named.join(named.groupBy("label").agg(F.min("id").alias("component_id")), "label").select("fp", "label", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    fps = cut(fingerprints(docs, id_col, text_col))
    named = labelled(fps, distance).select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: that with the smallest id (a row without an id only if no
    member has one), and of rows with that id the one whose text has the smallest hash."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], ["doc_id", "h", "fp"])

    rows = cut(picked(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(thrifty(run), "doc_id long, h long, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("x")
    stay = rows.join(labelled(rows, distance).select("fp", "label"), "fp").groupBy("label").agg(first).select(F.col("x.doc_id").alias("__stays"), F.col("x.h").alias("__text"))
    kept = docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__stays")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__text")), "left_semi")
    return kept.dropDuplicates([id_col, text_col])
