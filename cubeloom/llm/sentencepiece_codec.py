"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

New words of equal length advance together. All substrings of a block of words are hashed from prefix sums and
looked up in the sorted hashes of the pieces; at every place the best candidate is a vectorised maximum over
piece lengths, whose length is the backpointer. For the unigram kind a candidate's value is the sum of piece
scores. The public models are of the BPE kind, for which a sum of scores is not the model's segmentation. There
a candidate only counts if its piece may follow the piece chosen before it, that is if merging the two pieces'
characters by the model's priorities ends in exactly these two. Merging is local, so the path found is the model's
own segmentation. Characters outside the vocabulary become byte pieces.

Words are separated before each run of the space mark and around those of line break and tab that stand in no
piece (checked when the model is read); each distinct word of a task is searched once.

Defined cases: null or empty text has no ids and decodes to the empty text; repeated rows get equal results; text of
one enormous word is searched in blocks of places; no rows give no rows; only two columns are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import picked, thrifty

MARK = "▁"
CACHE_WORDS = 800_000
CACHED_CHARS = 64
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BLOCK = 1 << 19  # places x words x piece lengths that are looked up at once
SLOTS = 1 << 20  # of the table of pairs that are known to fit or not
PRESENT_BITS = 20  # leading bits of a hash, by which substrings that are no piece are passed over
NEVER = np.int64(1) << 60


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[i : i + n]
            i += n


class Model:
    """The arrays of a model file. Field numbers are those of the public model format."""

    NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                kinds.append(piece.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        self.prefix = bool(normalizer.get(3, 1))
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only models that leave the text as it is are supported")
        if self.USER in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        normal = [i for i, k in enumerate(kinds) if k == self.NORMAL]
        if any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in normal):
            raise ValueError("pieces cross the space mark")
        self.breaks = "".join(set("\n\r\t").difference(*(self.pieces[i] for i in normal)))  # in no piece
        self.number = {self.pieces[i]: i for i in normal}
        self.byte = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == self.BYTE}
        self.unknown = kinds.index(self.UNKNOWN)
        self.none = len(self.pieces)  # stands for a character outside the vocabulary
        self.plain = [bytes([int(p[3:5], 16)]) if k == self.BYTE else p.encode() if k in (self.NORMAL, self.UNKNOWN) else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        self._index(normal)
        if self.bpe:
            self._merges(normal)

    def _index(self, normal: list[int]) -> None:
        usable = [i for i in normal if not self.bpe or self._reached(self.pieces[i])]
        self.longest = max(len(self.pieces[i]) for i in usable)
        codes = np.zeros((len(usable), self.longest), np.uint32)
        for k, i in enumerate(usable):
            codes[k, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        lengths = np.array([len(self.pieces[i]) for i in usable])
        keys = prefix_hashes(codes)[np.arange(len(usable)), lengths]
        order = np.argsort(keys)
        self.present = np.zeros(1 << PRESENT_BITS, bool)
        self.present[keys >> np.uint64(64 - PRESENT_BITS)] = True
        self.keys, self.codes, self.lengths, self.ids = keys[order], codes[order], lengths[order], np.array(usable)[order]
        self.value = np.append(np.array(self.scores), min(self.scores) - 10.0)

    def _steps(self, word: str) -> list[tuple[str, str]]:
        """The merges of a word in order, by plain repeated search; only for pieces, at start."""
        symbols, steps = list(word), []
        while True:
            best = None
            for i in range(len(symbols) - 1):
                n = self.number.get(symbols[i] + symbols[i + 1])
                if n is not None and (best is None or self.scores[n] > best[0]):
                    best = (self.scores[n], i)
            if best is None:
                return steps if len(symbols) == 1 else []
            i = best[1]
            steps.append((symbols[i], symbols[i + 1]))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    def _reached(self, piece: str) -> bool:
        return len(piece) == 1 or bool(self._steps(piece))

    def _merges(self, normal: list[int]) -> None:
        rank = np.full(self.none + 1, NEVER)
        rank[normal] = np.unique(-np.array([self.scores[i] for i in normal]), return_inverse=True)[1].reshape(-1)
        self.rank = rank
        pairs = {}
        for i in normal:
            s = self.pieces[i]
            for k in range(1, len(s)):
                a, b = self.number.get(s[:k]), self.number.get(s[k:])
                if a is not None and b is not None:
                    pairs[a * (self.none + 1) + b] = rank[i]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        halves = {i: self._steps(self.pieces[i])[-1] for i in self.ids.tolist() if len(self.pieces[i]) > 1}
        spines = []
        for side in (1, 0):  # what stands at the piece's right, and left, edge while it is merged: first to last
            rows = []
            for i in range(self.none + 1):
                row = [i]
                while row[-1] in halves:
                    row.append(self.number[halves[row[-1]][side]])
                rows.append(row[::-1])
            depth = max(map(len, rows))
            table = np.array([r + [r[-1]] * (depth - len(r)) for r in rows])
            top = np.array([len(r) - 1 for r in rows])
            when = np.where(np.arange(depth) <= top[:, None], rank[table], NEVER)
            when[:, 0] = -1
            if (np.diff(np.where(np.arange(depth) <= top[:, None], when, NEVER), axis=1) < 0).any():
                raise ValueError("a piece outranks its own parts")
            spines.append((table, np.column_stack([when, np.full(len(rows), NEVER)])))
        self.spines = spines

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of the two pieces ends in the two pieces: no pair that meets at the seam while
        the pieces grow is merged before one of its sides grows. Equal ranks merge from the left."""
        (lt, lw), (rt, rw) = self.spines
        out = np.ones(len(left), bool)
        live = np.arange(len(left))
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        while len(live):
            a, b = left[live], right[live]
            key = lt[a, i[live]] * (self.none + 1) + rt[b, j[live]]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            meet = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            na, nb = lw[a, i[live] + 1], rw[b, j[live] + 1]
            crossed = (meet < na) & (meet <= nb)
            out[live[crossed]] = False
            grow = ~crossed & (np.minimum(na, nb) < NEVER)
            first = grow & (na <= nb)
            i[live[first]] += 1
            j[live[grow & ~first]] += 1
            live = live[grow]
        return out


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """(rows, n+1): hash of each prefix; see substring_hashes."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
    return out


class Searcher:
    """Viterbi search of new words, with the ids of words already met. These are kept in two generations: when the newer
    one is full it becomes the older, and a word of the older one that is met again moves up."""

    def __init__(self, model: Model):
        self.m, self.known, self.older = model, {}, {}
        self.slots = np.zeros(SLOTS, np.int64)  # (pair + 1) * 2 + fits
        self.powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(model.longest, BASE)))
        self.split = re.compile(f"[{model.breaks}]|{MARK}*[^{MARK}{model.breaks}]+|{MARK}+" if model.breaks else f"{MARK}*[^{MARK}]+|{MARK}+")

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return self.split.findall((MARK if self.m.prefix else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh, passing = [], {}
        for w in set().union(*split):
            if w not in known:
                if (got := older.get(w)) is None:
                    fresh.append(w)
                else:
                    known[w] = got
        for w, ids in self.search(fresh):
            (known if len(w) <= CACHED_CHARS else passing)[w] = array("i", ids).tobytes()
        known = known | passing if passing else known
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.m.plain.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return out[1:] if self.m.prefix else out

    def search(self, words: list[str]):
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            step = max(1, BLOCK // (n * self.m.longest))
            for k in range(0, len(group), step):
                yield from zip(group[k : k + step], self.equal_length(group[k : k + step], n), strict=True)

    def candidates(self, codes: np.ndarray, hashes: np.ndarray, a: int, b: int) -> np.ndarray:
        """(words, places, lengths): the piece that ends at each place in (a, b] with each length, or -1."""
        m, n = self.m, len(codes)
        out = np.full((n, b - a, m.longest), -1, np.int64)
        for size in range(1, min(m.longest, b) + 1):
            ends = np.arange(max(a + 1, size), b + 1)
            if not len(ends):
                continue
            h = hashes[:, ends] - hashes[:, ends - size] * self.powers[size]
            w, p = np.nonzero(m.present[h >> np.uint64(64 - PRESENT_BITS)])  # most substrings are no piece
            h = h[w, p]
            hit = np.minimum(np.searchsorted(m.keys, h), len(m.keys) - 1)
            equal = (m.keys[hit] == h) & (m.lengths[hit] == size)
            w, p, hit = w[equal], p[equal], hit[equal]
            same = (codes[w[:, None], (ends[p] - size)[:, None] + np.arange(size)] == m.codes[hit, :size]).all(1)
            out[w[same], ends[p[same]] - a - 1, size - 1] = m.ids[hit[same]]
        single = out[:, :, 0]
        single[single < 0] = m.none  # a character of its own, in bytes later
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * (self.m.none + 1) + right
        slot = (pair * 0x9E3779B1 >> 7) & (SLOTS - 1)
        got = self.slots[slot]
        missing = got >> 1 != pair + 1
        out = (got & 1).astype(bool)
        if missing.any():
            out[missing] = self.m.fits(left[missing], right[missing])
            self.slots[slot[missing]] = (pair[missing] + 1) * 2 + out[missing]
        return out

    def equal_length(self, words: list[str], n: int) -> list[list[int]]:
        m = self.m
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n)
        hashes = prefix_hashes(codes)
        best = np.full((len(words), n + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((len(words), n + 1), m.none, np.int64)
        back = np.zeros((len(words), n + 1), np.int16)
        step = max(1, BLOCK // (len(words) * m.longest))
        for a in range(0, n, step):
            found = self.candidates(codes, hashes, a, min(n, a + step))
            for i in range(a + 1, min(n, a + step) + 1):
                sizes = min(i, m.longest)
                piece = found[:, i - a - 1, :sizes]
                before = i - 1 - np.arange(sizes)
                value = best[:, before] + np.where(piece >= 0, m.value[piece], -np.inf)
                if m.bpe:
                    w, k = np.nonzero((value > -np.inf) & (before > 0))
                    bad = ~self.fits(last[w, before[k]], piece[w, k])
                    value[w[bad], k[bad]] = -np.inf
                pick = value.argmax(1)
                rows = np.arange(len(words))
                best[:, i] = value[rows, pick]
                last[:, i] = piece[rows, pick]
                back[:, i] = pick + 1
        return [self.path(w, last[k], back[k], n) for k, w in enumerate(words)]

    def path(self, word: str, last: np.ndarray, back: np.ndarray, at: int) -> list[int]:
        out: list[int] = []
        last, back = last.tolist(), back.tolist()
        while at:
            p = last[at]
            if p == self.m.none:
                data = word[at - 1].encode("utf-8", "surrogatepass")
                out += [self.m.byte[b] for b in reversed(data)] if self.m.byte else [self.m.unknown]
            else:
                out.append(p)
            at -= back[at]
        return out[::-1]


@lru_cache(maxsize=2)
def read_model(path: str) -> Model:
    return Model(path)


_searchers: dict[str, Searcher] = {}


def searcher(path: str) -> Searcher:
    """One for each worker and model; words met in earlier tasks stay known."""
    if path not in _searchers:
        _searchers[path] = Searcher(read_model(path))
    return _searchers[path]


SCHEMA = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean, ids array<int>"


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Ids of every whole text, and what they decode to. One pass, no shuffle. ``path``: the model's file on the executors."""

    def run(batches):
        s = searcher(path or model_path())
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = s.encode(texts)
                back = [s.decode(x) if len(x) else "" for x in ids]
                sizes = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                cols = [
                    part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]), pa.array([b == t for b, t in zip(back, texts, strict=True)], pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip", "ids"])

    return picked(docs, id_col, text_col).mapInArrow(thrifty(run), SCHEMA)


def decoded(encoded_rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, text of rows of ids; null ids decode to the empty text."""

    def run(batches):
        s = searcher(path or model_path())
        for batch in batches:
            texts = [s.decode(np.array(x, np.int64)) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded_rows.select(encoded_rows[id_col].cast("long").alias("doc_id"), encoded_rows[ids_col].cast("array<int>").alias("ids")).mapInArrow(thrifty(run), "doc_id long, text string")
