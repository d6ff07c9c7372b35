"""Katz backoff language model of word n-grams, learnt from and applied to a whole corpus.

Counts up to ``TOP`` are discounted by Good-Turing, order by order; what the discount frees is left to words not seen after
a history, in proportion to their probability by the next lower order, by a backoff weight that makes every history sum to
one exactly. Unigrams leave their freed mass to one unknown word. Orders go up to ``order``; the history of a text's first
word is its beginning.

Nothing that grows with the corpus is gathered in one place. Texts become blocks of word numbers. Order by order a block
asks tables for what it needs to know: of its distinct words the counts and a global number, of its distinct n-grams,
named by the number of their history and of their last word, the counts and a number, and of their histories the
figures from which weights follow. Requests carry the block's own counts; the tables, each a part of the model by hash of
the history, add them up and are written to the shared folder. A history that no other block has is known
there in full, with all n-grams that begin with it, and is not asked for. A history with so many followers that one
table could not hold them is dealt over several tables by follower. A block sends one row to each table it asks, and
never more rows than it has n-grams. Only counts of counts (TOP + 3 numbers an order) reach the driver.

Words are told apart by 64-bit hashes; n-grams by exact numbers.

Defined cases: null or empty text is the end token alone; a null doc_id counts as empty text for the fold; rows that
repeat are counted as often as they come; a very long text is a block of its own; an empty table gives no rows; without any
training text all words are unknown and have probability one. Only two columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, picked, release, texts_of, thrifty

TOP = 5  # counts up to this are discounted
BLOCK_BYTES = 10_000_000
FOLDS, HELD_OUT = 5, 1
ORDER = 3
CROWD = 100_000  # a history seen more often may be dealt over several tables
END = 1  # stands for the hash of the end of a text
WORD_BITS = 40  # of a word's number
FORMAT = "<u8"


def squeezed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: small numbers leave long runs of zeros."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def spread(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


BLOCK_SCHEMA = "block long, ids binary, known_ids binary, sizes binary, tokens binary, words binary"


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as blocks of numbers of the block's distinct words (tokens), with the words' hashes."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, parts, room = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = text.lower().split()
                ids.append(key)
                parts.append(np.fromiter((*map(xxhash.xxh3_64_intdigest, words), END), np.uint64, len(words) + 1))
                room += len(text)
                if room >= BLOCK_BYTES:
                    yield block((part << 24) + number, ids, parts)
                    ids, parts, room, number = [], [], 0, number + 1
        if ids:
            yield block((part << 24) + number, ids, parts)

    def block(number, ids, parts):
        words, tokens, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # common words get small numbers
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words, tokens = words[order], place[tokens.reshape(-1)]
        cols = [
            pa.array([number]), pa.array([squeezed(np.array([x or 0 for x in ids], "<i8"))], pa.binary()), pa.array([squeezed(np.array([x is not None for x in ids]))], pa.binary()),
            pa.array([squeezed(np.array([len(p) for p in parts], "<i8"))], pa.binary()), pa.array([squeezed(tokens.reshape(-1).astype("<u4"))], pa.binary()), pa.array([words.astype(FORMAT).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["block", "ids", "known_ids", "sizes", "tokens", "words"])

    return picked(docs, id_col, text_col).mapInArrow(thrifty(run), BLOCK_SCHEMA)


def ranks(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    out[np.argsort(x)] = np.arange(len(x))
    return out


def sorted_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (from 0 up) in order, and their places. They are sorted together while both fit one word, which is faster than
    sorting places by keys."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()) < 1 << (63 - bits):
        both = np.sort((key << bits) | np.arange(len(key)))
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(key)
    return key[order], order


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys (from 0 up), ascending, a place of each, and for every place the number of its key."""
    n = len(key)
    if not n:
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, order = sorted_places(key)
    new = np.append(True, key[1:] != key[:-1])
    inverse = np.empty(n, np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], order[new], inverse


class Grams:
    """The distinct n-grams of a block: local numbers of history and last word, of the n-gram one word shorter (``low``), training
    counts here, and the n-gram of each token (-1: none). Then, from the tables, ``count`` over all blocks, ``number``, and whether other blocks have it (``shared``)."""

    def __init__(self, b: Block, low: Grams | None, scoring: bool = True):
        if low is None:  # words
            self.at = b.tokens
            self.own = np.bincount(b.tokens[b.train], minlength=b.n_words)
            return
        first = low.history is None
        history = np.append(np.int32(-1), low.at[:-1])
        history[b.begin] = len(low.own) if first else -1  # the beginning of the text
        some = np.flatnonzero(history >= 0)
        bits = b.n_words.bit_length()
        key, index, inverse = grouped((history[some].astype(np.int64) << bits) | b.tokens[some])
        self.history, self.word = (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32)
        self.low = low.at[some[index]]
        self.own = np.bincount(inverse[b.train[some]], minlength=len(key))
        self.at = np.full(len(b.tokens), -1, np.int32)
        self.at[some] = inverse
        #: Of each history the count over all blocks, its number and whether other blocks have it; the beginning of texts is everywhere.
        self.h_count = np.append(low.count, b.starts) if first else low.count
        self.h_number = np.append(low.number, 0) if first else low.number
        self.asked = (np.append(low.shared, True) if first else low.shared)[self.history]
        self.count, self.number, self.shared = self.own.copy(), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        #: Only scores need them, and they are the largest part of a block.
        self.figures = figures_of(self.history[~self.asked], self.own[~self.asked], low.count[self.low[~self.asked]], len(self.h_count)) if scoring else None

    history = None
    order = 1


class Block:
    """A block with the grams of the orders whose answers are given. ``d``: discounts by order, words first."""

    def __init__(self, row: dict, starts: int = 0, d: list[np.ndarray] = (), tables: int = 1, crowd: int = 1, answers: list[dict] | None = None, order: int = 0):
        known = spread(row["known_ids"], "?")
        self.ids = [x if k else None for x, k in zip(spread(row["ids"], "<i8").tolist(), known.tolist(), strict=True)]
        self.sizes = spread(row["sizes"], "<i8")
        self.tokens = spread(row["tokens"], "<u4").astype(np.int32)
        words = row["words"]  # hashes of distinct words, or once these are counted their counts and numbers
        if order:
            counts, numbers = (spread(x, "<i8") for x in unpacked(words))
            self.n_words = len(counts)
        else:
            self.words = np.frombuffer(words, FORMAT)
            self.n_words = len(self.words)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(np.array([fold(x) != HELD_OUT for x in self.ids]), self.sizes)
        self.starts, self.d = starts, d
        self.grams: list[Grams] = []
        for n in range(1, order + 1):
            self.grams.append(g := Grams(self, self.grams[-1] if self.grams else None))
            g.order = n
            if n == 1:
                g.count, g.number, g.shared = counts, np.abs(numbers), numbers > 0
                continue
            got = [x["answer"] for x in sorted((x for x in answers or [] if x["level"] == n), key=lambda x: x["table"])]
            if got:
                for (_, mine, hist), data in zip(self.asked_grams(g, tables, crowd), got, strict=True):
                    counts, shared, numbers, figures = unpacked(data)
                    g.count[mine] = spread(counts, "<i8")
                    if shared:
                        g.shared[mine] = spread(shared, "?")
                        g.number[mine[g.shared[mine]]] = np.cumsum(spread(numbers, "<i8"))
                    g.figures[:, hist] += spread(figures, "<i8").reshape(FIGURES, -1)

    def asked_words(self, tables: int) -> list[tuple[int, np.ndarray]]:
        return dealt((mixed(self.words) % np.uint64(tables)).astype(np.int64), tables)

    def asked_grams(self, g: Grams, tables: int, crowd: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(table, n-grams in the order of history's and word's number, histories by number). A history dealt over several
        tables is asked for in each of them."""
        mine = np.flatnonzero(g.asked)
        hist = np.unique(g.history[mine])
        wide = hist[g.h_count[hist] // crowd > 0]
        thin = hist[g.h_count[hist] // crowd == 0]
        spans = np.minimum(1 + g.h_count[wide] // crowd, tables)
        k = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
        all_h = np.append(thin, np.repeat(wide, spans))
        h_table = gram_tables(g.h_number[all_h], np.append(np.zeros(len(thin), np.int64), k), np.full(len(all_h), tables), tables)
        spans = np.minimum(1 + g.h_count[g.history[mine]] // crowd, tables)
        number = self.grams[0].number[g.word[mine]]
        table = gram_tables(g.h_number[g.history[mine]], (mixed(number.astype(np.uint64)) % spans.astype(np.uint64)).astype(np.int64), spans, tables)
        h_rank, w_rank = ranks(g.h_number), ranks(self.grams[0].number)
        order = sorted_places((h_rank[g.history[mine]] << len(w_rank).bit_length()) | w_rank[g.word[mine]])[1]
        by_table = {t: mine[order[at]] for t, at in dealt(table[order], tables)}
        order = np.argsort(g.h_number[all_h], kind="stable")
        none = np.zeros(0, np.int64)
        return [(t, by_table.get(t, none), all_h[order[at]]) for t, at in dealt(h_table[order], tables)]


def gram_tables(history: np.ndarray, part: np.ndarray, spans: np.ndarray, tables: int) -> np.ndarray:
    """Where an n-gram is counted: by its history, and the part of it if the history is dealt over several tables."""
    return ((mixed(history.astype(np.uint64)) % np.uint64(tables)).astype(np.int64) + part % spans) % tables


REQUEST = "table long, block long, a binary, b binary, c binary, d binary, e binary"
NAMES = [x.split()[0] for x in REQUEST.split(", ")]
KINDS = (pa.int64(), pa.int64(), *[pa.binary()] * 5)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(r + (None,) * (7 - len(r)) for r in rows), strict=True), KINDS, strict=True)], NAMES)


def dealt(table: np.ndarray, tables: int) -> list[tuple[int, np.ndarray]]:
    """(table, members in ascending order) of the tables that are asked."""
    order = np.argsort(table.astype(np.uint16) if tables < 1 << 16 else table, kind="stable")  # short numbers sort in one pass
    edges = np.flatnonzero(np.append(True, np.diff(table[order]) > 0)) if len(order) else []
    return [(int(table[p[0]]), p) for p in np.split(order, edges[1:])] if len(order) else []


def word_requests(rows: DataFrame, tables: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in one_by_one(batch):
                b = Block(row)
                counts = np.bincount(b.tokens[b.train], minlength=b.n_words)
                yield batch_of([(t, row["block"], b.words[at].tobytes(), squeezed(counts[at].astype("<u4"))) for t, at in b.asked_words(tables)])

    return rows.mapInArrow(thrifty(run), REQUEST)


ANSWER = "block long, table long, answer binary"


def answers(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True))
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "table", "answer"])


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    """Types seen 1 .. TOP + 1 times, all types, and the sum."""
    return np.append(np.bincount(np.minimum(counts, TOP + 2), minlength=TOP + 3)[1 : TOP + 2], [(counts > 0).sum(), counts.sum()]).astype("<i8")


def framed(*parts: bytes) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def unpacked(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def numbered(rows: DataFrame, tables: int) -> DataFrame:
    """Blocks with their words' counts and numbers in place of hashes."""

    def run(batches):
        for batch in batches:
            done = []
            for row in one_by_one(batch):
                b = Block(row)
                counts, numbers = np.zeros(b.n_words, np.int64), np.zeros(b.n_words, np.int64)
                for (_, at), x in zip(b.asked_words(tables), sorted(row["answers"], key=lambda x: x["table"]), strict=True):
                    counts[at], numbers[at] = (spread(y, "<i8") for y in unpacked(x["answer"]))
                done.append(framed(squeezed(counts), squeezed(numbers)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(done, pa.binary())], [x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

    return rows.mapInArrow(thrifty(run), BLOCK_SCHEMA)


def word_answers(tables: int):
    def run(table: pa.Table) -> pa.Table:
        """Each block's words' counts over all blocks, and their numbers, small for frequent words; as block -1 the table's
        counts of counts."""
        rows = table.to_pylist()
        keys = [np.frombuffer(r["a"], FORMAT) for r in rows]
        words, at = np.unique(np.concatenate(keys), return_inverse=True)
        at = at.reshape(-1)
        total = np.bincount(at, weights=np.concatenate([spread(r["b"], "<u4") for r in rows])).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -total))] = np.arange(len(words))
        number = (rank * tables + rows[0]["table"] + 1) * np.where(np.bincount(at) > 1, 1, -1)  # negative: no other block has it
        edges = np.cumsum([len(k) for k in keys])[:-1]
        out = [(r["block"], r["table"], framed(squeezed(c.astype("<i8")), squeezed(n.astype("<i8")))) for r, c, n in zip(rows, np.split(total[at], edges), np.split(number[at], edges), strict=True)]
        return answers([*out, (-1, rows[0]["table"], counts_of_counts(total).tobytes())])

    return run


def totals(answered: DataFrame) -> np.ndarray:
    """The sum of the tables' counts of counts, summed by Spark."""

    def run(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n = np.frombuffer(x, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["k", "n"])

    got = dict(answered.where("block = -1").select("answer").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect())
    return np.array([got.get(k, 0) for k in range(TOP + 3)], np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing factor of counts 0 .. TOP + 1 (the last for all above, 1). n[r-1]: types seen r times. A factor that the
    counts can't support (no type seen r or r + 1 times, or outside (0, 1]) is 1."""
    out = np.ones(TOP + 2)
    rest = (TOP + 1) * n[TOP] / n[0] if n[0] else 1.0
    for r in range(1, TOP + 1):
        if n[r - 1] and n[r] and rest < 1:
            d = ((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest)
            if 0 < d <= 1:
                out[r] = d
    return out


class Unigrams:
    """Probabilities of words by their count; one unknown word has what is left, at least 1 / (N + 1)."""

    def __init__(self, n: np.ndarray):
        self.total = int(n[TOP + 2])
        self.d = discounts(n)
        seen = n[:TOP] @ (np.arange(1, TOP + 1) * self.d[1 : TOP + 1])
        above = self.total - n[:TOP] @ np.arange(1, TOP + 1)
        mass = (seen + above) / self.total if self.total else 0.0
        self.unknown = max(1 - mass, 1 / (self.total + 1))
        self.scale = (1 - self.unknown) / mass / self.total if mass else 0.0

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.d[np.minimum(counts, TOP + 1)] * counts * self.scale, self.unknown)


#: Per history: followers seen 1 .. TOP times and the sum of all counts above; and the same by the followers' counts of one order lower.
FIGURES = 2 * (TOP + 1)


def figures_of(history: np.ndarray, count: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Of n histories, from their distinct followers' counts and counts of one order lower."""
    out = np.zeros((FIGURES, n), np.int64)
    seen = count > 0
    for k, c in ((0, count), (TOP + 1, low)):
        for r in range(1, TOP + 1):
            out[k + r - 1] = np.bincount(history[seen & (c == r)], minlength=n)
        many = seen & (c > TOP)
        out[k + TOP] = np.bincount(history[many], weights=c[many], minlength=n)
    return out


def gram_requests(rows: DataFrame, n: int, **given) -> DataFrame:
    """Histories by number with the count of their n-grams; per n-gram the word's number, its training count here, and the
    count of the n-gram one word shorter over all blocks. What is not asked for adds to the counts of counts only."""
    tables, crowd = given["tables"], given["crowd"]

    def run(batches):
        for batch in batches:
            for row in one_by_one(batch):
                b = Block(row, answers=row.pop("answers"), order=n - 1, **given)
                for g in b.grams[1:]:
                    g.figures = None
                g = Grams(b, b.grams[-1], scoring=False)
                low = b.grams[-1].count
                out = [(-1 - row["block"] % tables, row["block"], counts_of_counts(g.own[~g.asked]).tobytes())]
                for t, mine, hist in b.asked_grams(g, tables, crowd):
                    names = g.h_number[hist]
                    size = np.bincount(np.searchsorted(names, g.h_number[g.history[mine]]), minlength=len(hist))
                    out.append((t, row["block"], squeezed(np.diff(names, prepend=0).astype("<i8")), squeezed(size.astype("<u4")), squeezed(b.grams[0].number[g.word[mine]].astype("<i8")), squeezed(g.own[mine].astype("<u4")), squeezed(low[g.low[mine]].astype("<i8"))))
                yield batch_of(out)

    return rows.mapInArrow(thrifty(run), REQUEST)


def gram_answers(tables: int, last: bool):
    """``last``: no higher order will ask for these n-grams by number."""

    def run(table: pa.Table) -> pa.Table:
        """Per block its n-grams' counts, which other blocks have too and the numbers of these, and its histories' figures; as
        block -1 the counts of counts."""
        rows = table.to_pylist()
        at = rows[0]["table"]
        if at < 0:
            return answers([(-1, at, sum(np.frombuffer(r["a"], "<i8") for r in rows).tobytes())])
        own = [np.cumsum(spread(r["a"], "<i8")) for r in rows]
        sizes = [spread(r["b"], "<u4") for r in rows]
        names, place = np.unique(np.concatenate(own), return_inverse=True)
        h = np.repeat(place.reshape(-1), np.concatenate(sizes))
        w = np.concatenate([spread(r["c"], "<i8") for r in rows])
        if len(w) and (len(names) >= 1 << (63 - WORD_BITS) or w.max() >= 1 << WORD_BITS):
            raise OverflowError("a table has too many histories or words")
        gram, index, inverse = grouped((h.astype(np.int64) << WORD_BITS) + w)
        total = np.bincount(inverse, weights=np.concatenate([spread(r["d"], "<u4") for r in rows]), minlength=len(gram)).astype(np.int64)
        low = np.concatenate([spread(r["e"], "<i8") for r in rows])[index]
        figures = figures_of(gram >> WORD_BITS, total, low, len(names))
        counts, numbers, shared = total[inverse], inverse.astype(np.int64) * tables + at + 1, (np.bincount(inverse, minlength=len(gram)) > 1)[inverse]
        edges = np.cumsum([int(s.sum()) for s in sizes])[:-1]
        out = []
        for r, mine, c, k, s in zip(rows, np.split(place.reshape(-1), np.cumsum([len(x) for x in own])[:-1]), *(np.split(x, edges) for x in (counts, numbers, shared)), strict=True):
            out.append((r["block"], at, framed(squeezed(c.astype("<i8")), *((b"", b"") if last else (squeezed(s), squeezed(np.diff(k[s], prepend=0).astype("<i8")))), squeezed(figures[:, mine].astype("<i8")))))
        return answers([*out, (-1, at, counts_of_counts(total).tobytes())])

    return run


def weights(figures: np.ndarray, d: np.ndarray, lower: np.ndarray, d_lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per history the scale of its discounted counts and its backoff weight; a history never seen has weight 1.
    Where discounting leaves less than 1 / (n + 1), all counts of the history are scaled to leave that. ``lower``: the
    scale of the followers' discounted counts one order lower."""
    r = np.arange(1, TOP + 1)
    total = r @ figures[:TOP] + figures[TOP]
    raw = (r * d[1 : TOP + 1]) @ figures[:TOP] + figures[TOP]
    mass = lower * ((r * d_lower[1 : TOP + 1]) @ figures[TOP + 1 : -1] + figures[-1])
    known = total > 0
    safe = np.where(known, total, 1)
    left = np.maximum(1 - raw / safe, 1 / (safe + 1))
    scale = np.where(known, (1 - left) / np.where(raw > 0, raw, 1), 0.0)
    return scale, np.where(known, left / np.maximum(1 - mass, 1e-300), 1.0)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def token_probabilities(b: Block, unigrams: Unigrams) -> np.ndarray:
    """Of each token, by the longest history that the text gives it: p(w | u v) backs off to p(w | v), that to p(w)."""
    p, scale = unigrams.of(b.grams[0].count), np.array([unigrams.scale])
    out = p[b.tokens]
    for low, g, d_lower, d in zip(b.grams, b.grams[1:], b.d, b.d[1:], strict=False):
        shorter = np.zeros(len(g.h_count), np.int64)  # the history of each history's followers one order lower
        if low.history is not None:
            shorter[g.history] = low.history[g.low]
        scale, backoff = weights(g.figures, d, scale[shorter], d_lower)
        p = np.where(g.count > 0, d[np.minimum(g.count, TOP + 1)] * g.count * scale[g.history], backoff[g.history] * p[g.low])
        some = g.at >= 0
        out[some] = p[g.at[some]]
    return out


def one_by_one(batch: pa.RecordBatch):
    """Rows as Python objects, one at a time: a row here is a whole block."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def with_answers(rows: DataFrame, answered: list[DataFrame]) -> DataFrame:
    """Blocks with what the tables of the orders from the second on (or those of words alone) have answered."""
    if not answered:
        return rows.withColumn("answers", F.lit(None).cast("array<struct<level:int,table:bigint,answer:binary>>"))
    every = [x.where("block >= 0").select("block", F.struct(F.lit(n).alias("level"), "table", "answer").alias("x")) for n, x in enumerate(answered, 2)]
    union = every[0]
    for x in every[1:]:
        union = union.union(x)
    return rows.join(union.groupBy("block").agg(F.collect_list("x").alias("answers")), "block", "left")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the model's probability)."""
    rows = cut(blocks(docs, id_col, text_col))
    tables = max(1, rows.count())
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    counted = cut(word_requests(rows, tables).groupBy("table").applyInArrow(word_answers(tables), ANSWER))
    n1 = totals(counted)
    unigrams, vocabulary, total = Unigrams(n1), int(n1[TOP + 1]), int(n1[TOP + 2])
    given = {"starts": docs.where(~held).count(), "d": [discounts(n1)], "tables": tables, "crowd": max(CROWD, total // (4 * tables))}
    # no name holds on to what a step reads, so it is released once the step is written
    rows = cut(numbered(with_answers(rows, [counted]), tables))
    del counted
    answered: list[DataFrame] = []
    for n in range(2, order + 1):
        # requests are written, so the shuffle of blocks is released before theirs
        answered.append(cut(cut(gram_requests(with_answers(rows, answered), n, **given)).groupBy("table").applyInArrow(gram_answers(tables, n == order), ANSWER)))
        given["d"] = [*given["d"], discounts(totals(answered[-1]))]
    release(docs.sparkSession)  # of the last requests, before blocks and answers are dealt once more

    def run(batches):
        for batch in batches:
            for row in one_by_one(batch):
                yield score(Block(row, answers=row["answers"], order=order, **given))

    def score(b: Block):
        counts = b.grams[0].count
        base = np.log10((counts + 0.5) / (total + 0.5 * (vocabulary + 1)))[b.tokens]
        add = lambda x: np.add.reduceat(x, b.begin)
        cols = [pa.array(b.ids, pa.int64()), pa.array([fold(x) == HELD_OUT for x in b.ids]), pa.array(b.sizes), pa.array(add((counts > 0)[b.tokens].astype(np.int64))), pa.array(np.full(len(b.ids), total)), pa.array(add(base)), pa.array(add(np.log10(token_probabilities(b, unigrams))))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers(rows, answered).mapInArrow(thrifty(run), RESULT)
