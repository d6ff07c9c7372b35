"""Removal of bytes that a long string covers which also starts earlier in the corpus, exactly.

1. Each ``size``-byte window of a text chooses an anchor: the ``gram``-byte string in it whose hash is least
   (leftmost if tied). Equal windows choose equal anchors, so windows can only be equal under one anchor.
2. The windows of an anchor form an interval; its bytes are the anchor's context. Only a hash of the context is
   shuffled, deduplicated within each batch before. Of equal contexts the earliest keeps its windows, all others are
   covered. A first context whose anchor string has no other context is not covered at all. Only contexts of one anchor
   string are told apart by this hash (64 bits, beside the anchor's own 64): a thousand million contexts of the same
   string would hold 0.03 false pairs.
3. What is left are first contexts that share their anchor string with different contexts, as at the edges of
   repeated passages. Their bytes are sorted together by two-stage suffix sorting (:mod:`suffix_sort`); in runs of
   suffixes whose adjacent common prefixes reach ``size`` all but the earliest are covered. An anchor string with more
   than ``many`` contexts is not held in one task: its windows are hashed (128 bits) and grouped instead.

Very long texts are anchored in pieces. Earlier: smaller doc_id (null first), then smaller hash of the text where rows share a doc_id, then smaller start. Rows
that repeat a doc_id and its text are one document and get the same result. Null text is empty; an empty table
gives no rows; further columns are carried under their own names only on request (``rest``).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, texts_of, thrifty
from .suffix_sort import common_prefixes, joined, suffix_array

SIZE = 100
GRAM = 32
MANY = 20_000  # contexts of one anchor string that one task sorts
SORT_BYTES = 2_000_000  # text that one suffix array holds, beside the contexts of its last anchor string
SEGMENT = 1 << 20  # bytes that are anchored at once
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
ROW = 32_768


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Anchors of the windows of a piece of text."""

    def __init__(self, size: int = SIZE, gram: int = GRAM):
        self.size, self.gram = size, gram
        self.up, self.down = _powers(BASE, SEGMENT * 2 + 1), _powers(INVERSE, SEGMENT * 2 + 1)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A mixed 64-bit hash of each ``gram`` bytes."""
        n = len(data)
        if n > len(self.up):
            self.up, self.down = _powers(BASE, n), _powers(INVERSE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: n + 1 - self.gram]) * self.down[: n + 1 - self.gram]
        for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            h = (h ^ (h >> np.uint64(30))) * np.uint64(m)
        return h ^ (h >> np.uint64(31))

    def chosen(self, h: np.ndarray) -> np.ndarray:
        """For each window start the place of its anchor."""
        w = self.size - self.gram + 1
        n = len(h) - w + 1
        rows = -(-n // ROW)
        padded = np.full(rows * ROW + w - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(h)] = h[: len(padded)]
        x = np.lib.stride_tricks.as_strided(padded, (rows, ROW + w - 1), (ROW * 8, 8))
        x = (x & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(ROW + w - 1, dtype=np.uint64)  # the place breaks ties
        span = 1
        while span * 2 <= w:
            x = np.minimum(x[:, :-span], x[:, span:])
            span *= 2
        x = np.minimum(x[:, : x.shape[1] - (w - span)], x[:, w - span :]) if w > span else x
        at = (x & np.uint64(0xFFFF)).astype(np.int64) + np.arange(rows)[:, None] * ROW
        return at.reshape(-1)[:n]

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """doc, anchor place, first and last window start (places within the document) and the gram hash of every
        anchor of the documents laid end to end in ``data``."""
        found = []
        for d0, d1, a, b in self.segments(offsets):
            piece = data[a:b]
            if len(piece) < self.size:
                continue
            h = self.hashes(piece)
            at = self.chosen(h)
            first = np.arange(len(at))
            doc = np.searchsorted(offsets, first + a, "right") - 1
            ok = first + a + self.size <= offsets[doc + 1]
            first, at, doc = first[ok], at[ok], doc[ok]
            if not len(at):
                continue
            new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
            last = np.append(new[1:], len(at)) - 1
            base = a - offsets[doc[new]]
            found.append((doc[new], at[new] + base, first[new] + base, first[last] + base, h[at[new]]))
        if not found:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def segments(self, offsets: np.ndarray):
        """(first document, last, from, to): whole documents together, long ones in overlapping pieces."""
        d, n = 0, len(offsets) - 1
        while d < n:
            e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + SEGMENT, "right")) - 1)
            if offsets[e] - offsets[d] <= SEGMENT:
                yield d, e, int(offsets[d]), int(offsets[e])
            else:
                e = d + 1
                for a in range(int(offsets[d]), int(offsets[e]) - self.size + 1, SEGMENT):
                    yield d, e, a, min(a + SEGMENT + self.size - 1, int(offsets[e]))
            d = e


def context_hashes(data: memoryview, base: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Hash of each context with the anchor's place in it."""
    a, b = (base + first).tolist(), (base + last + size).tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[i:j], s) for i, j, s in zip(a, b, (place - first).tolist(), strict=True)), np.uint64, len(a))


def _key(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    more = [F.struct(*rest).alias("rest")] if rest else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("th"), text.alias("text"), *more)


def first_contexts(keyed: DataFrame, size: int, gram: int) -> DataFrame:
    """doc_id, th, code: one row for the earliest of each set of equal contexts; code = 2 * anchor interval's first window + 1
    if other contexts share the anchor string."""

    def find(batches):
        anchors = Anchors(size, gram)
        for batch in batches:
            data, offsets = bytes_of(batch.column(2))
            doc, place, first, last, h = anchors.of(data, offsets)
            if not len(doc):
                continue
            c = context_hashes(memoryview(data), offsets[doc], place, first, last, size)
            ids = batch.column(0).take(pa.array(doc))
            th = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
            sub = (th << 32) + first
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((sub, number, known, c, h))
            keep = order[np.append(True, (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]]))]
            cols = [pa.array(h[keep].view(np.int64)), pa.array(c[keep].view(np.int64)), ids.take(pa.array(keep)), pa.array(sub[keep])]
            yield pa.RecordBatch.from_arrays(cols, ["h", "c", "doc_id", "sub"])

    def firsts(batches):
        held = None  # the first context of the current anchor string, until it is known to be the only one
        last = None
        for batch in batches:
            h, c, sub = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            if not len(h):
                continue
            new_h = np.append(last is None or h[0] != last[0], h[1:] != h[:-1])
            new = new_h | np.append(last is None or c[0] != last[1], c[1:] != c[:-1])
            at = np.flatnonzero(new)
            opens = new_h[at]
            # shared: another first context of the same string follows or stands before
            shared = ~opens | np.append(~opens[1:], False)
            ids = batch.column(2).take(pa.array(at))
            out_ids, out_sub, out_shared = ids, sub[at], shared
            if held is not None:
                if len(at):
                    out_ids = pa.concat_arrays([held[0], ids])
                    out_sub = np.append(held[1], out_sub)
                    out_shared = np.append(held[2] or not opens[0], out_shared)
                else:
                    out_ids, out_sub, out_shared = held[0], np.array([held[1]]), np.array([held[2]])
            last = (h[-1], c[-1])
            held = (out_ids.slice(len(out_ids) - 1, 1), out_sub[-1], bool(out_shared[-1]))
            yield rows(out_ids.slice(0, len(out_ids) - 1), out_sub[:-1], out_shared[:-1])
        if held is not None:
            yield rows(held[0], np.array([held[1]]), np.array([held[2]]))

    def rows(ids, sub, shared):
        th = sub >> 32
        code = (sub - (th << 32)) * 2 + shared
        return pa.RecordBatch.from_arrays([ids, pa.array(th.astype(np.int32)), pa.array(code)], ["doc_id", "th", "code"])

    found = keyed.select("doc_id", "th", "text").mapInArrow(thrifty(find), "h long, c long, doc_id long, sub long")
    return found.repartition("h").sortWithinPartitions("h", "c", "doc_id", "sub").mapInArrow(thrifty(firsts), "doc_id long, th int, code long")


def covered_runs(n: int, free: np.ndarray, size: int) -> np.ndarray:
    """Maximal runs (start, end) of bytes in windows that are not free. free: (first, last) intervals of window starts."""
    windows = n - size + 1
    if windows <= 0:
        return np.zeros((0, 2), np.int64)
    step = np.zeros(windows + 1, np.int64)
    np.add.at(step, free[:, 0], 1)
    np.add.at(step, free[:, 1] + 1, -1)
    taken = np.append(np.cumsum(step[:-1]) == 0, False)
    edge = np.diff(np.append(False, taken).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + size - 1
    if not len(a):
        return np.zeros((0, 2), np.int64)
    apart = a[1:] > b[:-1]
    return np.column_stack([a[np.append(True, apart)], b[np.append(apart, True)]])


def without_runs(text: bytes, runs: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in runs.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])



def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, many: int = MANY, rest: list | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; kept (the text left, without characters that a
    cut has parted) if ``with_text``, and the columns ``rest`` of the input in a struct of that name."""
    rest = rest or []  # names or columns
    carry = ["rest"] if rest else []
    keyed = _key(docs, id_col, text_col, rest)
    own = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")
    carried = ", rest " + keyed.schema["rest"].dataType.simpleString() if rest else ""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def result(text: bytes, free: np.ndarray) -> tuple:
        runs = covered_runs(len(text), free, size)
        kept = without_runs(text, runs)
        return len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if with_text else [])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text

    def columns(results: list) -> list[pa.Array]:
        cols = list(zip(*[r or (None,) * len(kinds) for r in results], strict=True)) or [()] * len(kinds)
        return [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]

    def settle(batches):
        """Rows whose contexts are all settled get their result; others their contexts, and text for the last step."""
        anchors = Anchors(size, gram)
        for batch in batches:
            texts = [zlib.decompress(z) for z in texts_of(batch.column(2))]
            codes = batch.column(3).to_pylist()
            offsets = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
            data = np.frombuffer(b"".join(texts), np.uint8)
            doc, _, first, last, h = anchors.of(data, offsets)
            begin = np.searchsorted(doc, np.arange(len(texts) + 1))
            done, free_left, contexts, kept_z = [], [], [], []
            for d, text in enumerate(texts):
                mine = np.sort(np.array(codes[d] or [], np.int64))
                f, l, hd = (x[begin[d] : begin[d + 1]] for x in (first, last, h.view(np.int64)))
                at = np.searchsorted(f, mine >> 1)
                alone, shared = at[mine & 1 == 0], at[mine & 1 == 1]
                free = np.column_stack([f[alone], l[alone]])
                if not len(shared):
                    done.append(result(text, free))
                    free_left.append(None)
                    contexts.append(None)
                    kept_z.append(None)
                else:
                    done.append(None)
                    free_left.append(free.astype("<i8").tobytes())
                    contexts.append([{"h": int(hd[k]), "first": int(f[k]), "bytes": text[f[k] : l[k] + size]} for k in shared.tolist()])
                    kept_z.append(batch.column(2)[d].as_py())
            cols = [batch.column(0), batch.column(1), *columns(done), pa.array(kept_z, pa.binary()), pa.array(free_left, pa.binary()), pa.array(contexts, pa.list_(pa.struct([("h", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary())])))]
            head = ["doc_id", "th", *names[1:], "z", "free", "contexts"]
            if carry:
                cols.append(batch.column(4))
                head.append("rest")
            yield pa.RecordBatch.from_arrays(cols, head)

    def squeeze(batches):
        k = 2
        for batch in batches:
            z = pa.array([zlib.compress(t, 1) for t in texts_of(batch.column(k))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(i) if i != k else z for i in range(batch.num_columns)], ["doc_id", "th", "z"] + carry)

    # written, so that the shuffle of all contexts is released before texts are shuffled
    codes = cut(first_contexts(keyed, size, gram).groupBy("doc_id", "th").agg(F.collect_list("code").alias("codes")))
    codes = codes.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "codes")
    packed = keyed.mapInArrow(thrifty(squeeze), "doc_id long, th int, z binary" + carried)
    both = packed.join(codes, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "th", "z", "codes", *carry)
    settled = cut(both.mapInArrow(thrifty(settle), own.replace("doc_id long", "doc_id long, th int") + ", z binary, free binary, contexts array<struct<h:long,first:long,bytes:binary>>" + carried))

    open_rows = settled.where("contexts is not null")
    contexts = open_rows.select("doc_id", "th", F.explode("contexts").alias("x")).select("doc_id", "th", "x.h", "x.first", "x.bytes")
    freed = free_windows(contexts, size, many).groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("more"))
    freed = freed.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "more")

    def finish(batches):
        for batch in batches:
            done = []
            for z, free, more in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                extra = np.array([(x["first"], x["last"]) for x in more or []], np.int64).reshape(-1, 2)
                done.append(result(zlib.decompress(z), np.concatenate([np.frombuffer(free, "<i8").reshape(-1, 2), extra])))
            cols = [batch.column(0), *columns(done)]
            yield pa.RecordBatch.from_arrays(cols + ([batch.column(4)] if carry else []), names + carry)

    joined_rows = open_rows.join(freed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc_id", "z", "free", "more", *carry)
    last_rows = joined_rows.mapInArrow(thrifty(finish), own + carried)
    return settled.where("contexts is null").select(*names, *carry).unionByName(last_rows)


def free_windows(contexts: DataFrame, size: int, many: int) -> DataFrame:
    """doc_id, th, first, last: window starts of the contexts that no earlier equal window covers. Rows of one document
    that repeat count once."""
    crowded = cut(contexts.groupBy("h").count().where(F.col("count") > many).select("h"))
    usual = contexts.join(crowded, "h", "left_anti").select("h", "doc_id", "th", "first", "bytes")

    def sort(batches):
        held: list = []
        room = 0
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            for row in rows:
                if room > SORT_BYTES and row[0] != held[-1][0]:
                    yield free_of(held)
                    held, room = [], 0
                held.append(row)
                room += len(row[4])
        if held:
            yield free_of(held)

    def free_of(rows):
        rows = sorted(set(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))  # earliest first
        owner, first, last = free_in([r[4] for r in rows], size)
        doc, th, base = pa.array([r[1] for r in rows], pa.int64()), np.array([r[2] for r in rows], np.int32), np.array([r[3] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([doc.take(pa.array(owner)), pa.array(th[owner]), pa.array(base[owner] + first), pa.array(base[owner] + last)], ["doc_id", "th", "first", "last"])

    out = usual.repartition("h").sortWithinPartitions("h").mapInArrow(thrifty(sort), "doc_id long, th int, first long, last long")

    def windows(batches):
        for batch in batches:
            ids, rest_of = [], []
            for i, (first, data) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for s in range(len(data) - size + 1):
                    ids.append(i)
                    rest_of.append((xxhash.xxh3_128_digest(data[s : s + size]), first + s))
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rest_of], pa.binary()), batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rest_of], pa.int64())], ["w", "doc_id", "th", "first"])

    busy = contexts.join(crowded, "h", "left_semi").select("doc_id", "th", "first", "bytes").mapInArrow(thrifty(windows), "w binary, doc_id long, th int, first long")
    busy = busy.groupBy("w").agg(F.min(F.struct("doc_id", "th", "first")).alias("x")).select("x.doc_id", "x.th", "x.first", F.col("x.first").alias("last"))
    return out.union(busy)


def free_in(contexts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) runs of window starts that no window of an earlier context, or earlier in the same, equals.
    Contexts stand in the order of the corpus."""
    text, rest = joined(contexts)
    owner = np.repeat(np.arange(len(contexts)), [len(c) + 1 for c in contexts])
    sa = suffix_array(text, rest)
    sa = sa[rest[sa] >= size]
    run = np.cumsum(np.append(0, common_prefixes(text, rest, sa, size) < size)) if len(sa) else sa
    order = np.lexsort((sa, run))  # places ascend with the corpus
    keep = np.sort(sa[order[np.append(True, run[order[1:]] != run[order[:-1]])]]) if len(sa) else sa
    new = np.flatnonzero(np.append(True, (np.diff(keep) != 1) | (np.diff(owner[keep]) != 0))) if len(keep) else keep
    first, last = keep[new], keep[np.append(new[1:], len(keep)) - 1] if len(keep) else keep
    base = np.append(0, np.cumsum([len(c) + 1 for c in contexts]))
    who = owner[first]
    return who, first - base[who], last - base[who]
