"""Hierarchical packing of tokenised documents into context windows of several lengths.

Every document's ids are cut into whole long windows; the rest is routed to the shortest tier
that holds it. Tiers are packed from long to short: a window opens with the largest document of its tier,
its gap is filled by the largest fitting documents of shorter tiers, and what no document fits is filled by cutting
one, whose rest is routed anew. All tiers are powers of two, so only the last window of a pool can be
short; it is cut into powers of two, and nothing is padded. The finished sequences of a pool are dealt to
step groups of nearly equal token counts.

Packing is local to a task, in pools of bounded tokens, so no row is shuffled and a lost task is simply run
again. Sequence ids carry the partition number above ``SEQ_BITS``.

Defined cases: null or empty text is one document of the end id alone; a null doc_id is kept; repeated rows
are packed as documents of their own; a very long text is cut into whole windows; documents of equal length are packed
in the order in which the task reads them; no rows give no rows; only two columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import picked, texts_of, thrifty

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
POOL_TOKENS = 2_000_000
STEP_TOKENS = 65_536
SEQ_BITS = 33
CACHE_WORDS = 1_600_000  # remembered by a task
IDLE_WORDS = 800_000  # and by a worker between tasks, about 160 MB
CACHED_BYTES = 64  # longer words are not remembered
PLAIN = re.compile(r"[a-zß-öø-ÿ]+[!-/:-@\[-`{-~]*").fullmatch  # letters that no rule changes, then marks
JOINED_WORDS = 4096  # new words encoded in one call


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts. The tokenizer drops white space and never merges across it, so texts are
    encoded word by word, each new word once. New words are joined by a special token, which parts them in one call.

    Words met lately stay known in two generations: when the newer one is full it becomes the older, and a word of the
    older one that is met again moves up."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.mark_id, self.mark = next(((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special), (None, None))
        self.bare = self._without_rules()

    def _without_rules(self):
        """The merges without the tokenizer's rules on characters, for plain words: these only part letters from marks."""
        t = self.tokenizer
        letters, marks = ("".join(c for c in map(chr, range(33, 256)) if PLAIN(before + c)) for before in ("", "a!"))
        sample = letters + marks
        if (t.normalizer and t.normalizer.normalize_str(sample) != sample) or len(t.pre_tokenizer.pre_tokenize_str(sample)) != 2:
            return t
        rules = json.loads(t.to_str())
        rules["normalizer"] = None
        rules["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Punctuation", "behavior": "Contiguous"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        bare = type(t).from_str(json.dumps(rules))
        return bare if self.ids_of([sample], bare) == self.ids_of([sample], t) else t

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The little-endian ids of each word."""
        if len(self.known) + len(words) > CACHE_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        plain, other, passing = [], [], {}
        for w in words:
            if w not in known:
                if (ids := older.get(w)) is not None:
                    known[w] = ids
                else:
                    (plain if PLAIN(w.decode("utf-8", "replace")) else other).append(w)
        for group, tokenizer in ((plain, self.bare), (other, self.tokenizer)):
            for a in range(0, len(group), JOINED_WORDS):
                block = group[a : a + JOINED_WORDS]
                texts = [w.decode("utf-8", "replace") for w in block]
                for w, ids in zip(block, self.ids_of(texts, tokenizer), strict=True):
                    (known if len(w) <= CACHED_BYTES else passing)[w] = ids
        return known | passing if passing else known

    def ids_of(self, texts: list[str], tokenizer) -> list[bytes]:
        if self.mark is not None:
            joined = np.array(tokenizer.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(joined == self.mark_id)
            if len(ends) == len(texts) - 1:  # else a word holds the mark itself
                data, ends = joined.tobytes(), ends * 4
                return [data[s:e] for s, e in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(data)], strict=True)]
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        """Down to IDLE_WORDS; a generation holds no more."""
        if len(self.known) + len(self.older) > IDLE_WORDS:
            self.known, self.older = {}, max(self.known, self.older, key=len)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        known = self.learn(set().union(*split))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tier_of(n: int, tiers: tuple[int, ...] = TIERS) -> int:
    return bisect_left(tiers, n)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length). Each sequence's length is a power of two."""
    longest = tiers[-1]
    shelves: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # per tier (length, document, start), ascending
    done = []
    for d, n in enumerate(lengths):
        done += [[(d, s, longest)] for s in range(0, n - n % longest, longest)]
        if n % longest:
            shelves[tier_of(n % longest, tiers)].append((n % longest, d, n - n % longest))
    for shelf in shelves:
        shelf.sort()
    for k in reversed(range(len(tiers))):
        while shelves[k]:
            n, d, s = shelves[k].pop()
            window, gap = [(d, s, n)], tiers[k] - n
            while gap:
                for j in reversed(range(k + 1)):
                    if at := bisect_right(shelves[j], (gap, len(lengths), 0)):
                        n, d, s = shelves[j].pop(at - 1)
                        window.append((d, s, n))
                        gap -= n
                        break
                else:  # nothing fits whole: cut the shortest that is left
                    shelf = next((x for x in shelves if x), None)
                    if shelf is None:
                        break
                    n, d, s = shelf.pop(0)
                    window.append((d, s, gap))
                    insort(shelves[tier_of(n - gap, tiers)], (n - gap, d, s + gap))
                    gap = 0
            done += halved(window, tiers[k] - gap) if gap else [window]
    return done


def halved(window: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """A short window as sequences of powers of two."""
    out, todo = [], list(reversed(window))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            d, s, n = todo.pop()
            take = min(n, room)
            out[-1].append((d, s, take))
            room -= take
            if take < n:
                todo.append((d, s + take, n - take))
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: longest first, each to the group with the fewest tokens so far."""
    import heapq

    groups = max(1, -(-sum(sizes) // step_tokens))
    heap, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + sizes[i], g))
        out[i] = g
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece (see SCHEMA; with_ids adds ``ids array<int>``). ``path``: the tokenizer's file on the executors."""

    def run(batches):
        words = encoder(path or tokenizer_path())
        part = TaskContext.get().partitionId()
        state = {"seq": 0, "step": 0}
        names, ids, held = [], [], 0
        try:
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
                for a in range(0, len(texts), 1024):
                    for key, got in zip(keys[a : a + 1024], words.encode(texts[a : a + 1024]), strict=True):
                        names.append(key)
                        ids.append(np.append(got, np.array([end_id], "<u4")))
                        held += len(ids[-1])
                    if held >= POOL_TOKENS:
                        yield pool(names, ids, part, state)
                        names, ids, held = [], [], 0
        finally:
            words.forget()
        if names:
            yield pool(names, ids, part, state)

    def pool(names, ids, part, state):
        sequences = pack([len(x) for x in ids], tiers)
        sizes = [sum(p[2] for p in s) for s in sequences]
        groups = step_groups(sizes)
        rows = []
        for k, (seq, size, group) in enumerate(zip(sequences, sizes, groups, strict=True)):
            at = 0
            for d, s, n in seq:
                piece = ids[d][s : s + n]
                rows.append((names[d], s, n, zlib.crc32(piece), len(ids[d]), (part << SEQ_BITS) + state["seq"] + k, at, size, (part << SEQ_BITS) + state["step"] + group, piece) )
                at += n
        state["seq"] += len(sequences)
        state["step"] += max(groups, default=-1) + 1
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:9]]
        if with_ids:
            return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[9], pa.list_(pa.int32()))], [*NAMES, "ids"])
        return pa.RecordBatch.from_arrays(arrays, NAMES)

    return picked(docs, id_col, text_col).mapInArrow(thrifty(run), SCHEMA + (", ids array<int>" if with_ids else ""))
