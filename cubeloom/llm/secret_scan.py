"""Secret scans: one automaton for all rules finds every span in one pass over the bytes.

Rules are compiled together (see :mod:`automaton`). Texts are cut into lanes at bytes after which no rule is under way;
the automaton reads every byte once and tells where the matches of each rule end. From these few ends the reversed
rules are read backwards to the starts. Then matches that are too short are dropped.

Rules of one group are leftmost and do not overlap; the base rules are groups of their own, the formats of services are one.

Defined cases: null text is empty; a null doc_id is kept; repeated rows give repeated results; no rows give no rows; columns
of other names are not read; spans that begin together stand in the order of the rules; very long texts are read in
time that grows with their length. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton, compile_rules, matches
from .common import bytes_of, picked, thrifty

# Fixed values, most of them the public formats of tokens: kind, expression, either case, and the shortest match that counts
# (of assign: its value).
RULES = [
    [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 6)],
    [("access", r"AKIA[A-Z0-9]+", False, 20)],
    [("hex", r"[0-9a-f]{24,}", False, 24)],
    [("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", False, 1)],
    [("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 40)],
    [
        ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
        ("github_pat", r"github_pat_[A-Za-z0-9_]+", False, 60),
        ("gitlab", r"glpat-[A-Za-z0-9_-]+", False, 26),
        ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 20),
        ("slack_app", r"xapp-[A-Za-z0-9-]+", False, 24),
        ("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]+", False, 60),
        ("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", False, 32),
        ("stripe_hook", r"whsec_[A-Za-z0-9]+", False, 38),
        ("google", r"AIza[A-Za-z0-9_-]+", False, 39),
        ("google_oauth", r"ya29\.[A-Za-z0-9_-]+", False, 30),
        ("google_secret", r"GOCSPX-[A-Za-z0-9_-]+", False, 35),
        ("aws_temporary", r"ASIA[A-Z0-9]+", False, 20),
        ("sendgrid", r"SG\.[A-Za-z0-9_.-]+", False, 60),
        ("npm", r"npm_[A-Za-z0-9]+", False, 40),
        ("pypi", r"pypi-AgE[A-Za-z0-9_-]+", False, 60),
        ("rubygems", r"rubygems_[0-9a-f]+", False, 57),
        ("docker", r"dckr_pat_[A-Za-z0-9_-]+", False, 36),
        ("digitalocean", r"do[opr]_v1_[0-9a-f]+", False, 71),
        ("shopify", r"shp(at|ca|pa|ss)_[0-9A-Fa-f]+", False, 38),
        ("hugging_face", r"hf_[A-Za-z0-9]+", False, 37),
        ("databricks", r"dapi[0-9a-f]+", False, 36),
        ("linear", r"lin_api_[A-Za-z0-9]+", False, 48),
        ("postman", r"PMAK-[A-Za-z0-9-]+", False, 60),
        ("square", r"sq0[a-z]{3}-[A-Za-z0-9_-]+", False, 29),
    ],
]
BASE = 3  # the first rules are the base ones
FLAT = [rule for group in RULES for rule in group]
KINDS = [r[0] for r in FLAT]
GROUP_OF = np.array([g for g, group in enumerate(RULES) for _ in group])


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return compile_rules([[(r[1], r[2]) for r in group] for group in RULES])


def value_of(assignment: bytes) -> bytes:
    """What stands behind the first : or = and spaces and a quote."""
    at = min(k for k in (assignment.find(b":"), assignment.find(b"=")) if k >= 0)
    value = assignment[at + 1 :].lstrip(b" ")
    return value[1:] if value[:1] in (b'"', b"'") else value


def spans_in(auto: Automaton, buffer: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per document (start, rule, end) in code points, sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    for r, (doc, start, end) in enumerate(matches(auto, buffer, offsets, GROUP_OF)):
        for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
            if (len(value_of(buffer[a:b].tobytes())) if KINDS[r] == "assign" else b - a) >= FLAT[r][3]:
                out[d].append((a, r, b))
    for d, spans in enumerate(out):
        if spans:
            spans.sort()
            begins = np.append(0, np.cumsum((buffer[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80, dtype=np.int64))
            at = begins[np.array([(a, b) for a, _, b in spans]) - offsets[d]].tolist()
            out[d] = [(a, r, b) for (_, r, _), (a, b) in zip(spans, at, strict=True)]
    return out


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[r]}:{a}:{b}" for a, r, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. One pass, no shuffle."""
    auto = automaton()  # compiled on the driver; its arrays are bounded by the rules

    def run(batches):
        for batch in batches:
            spans = spans_in(auto, *bytes_of(batch.column(1)))
            base = [[s for s in x if s[1] < BASE] for x in spans]
            counts = [pa.array([sum(s[1] == r for s in x) for x in base], pa.int64()) for r in range(BASE)]
            sums = pa.array([hashlib.sha256(said(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sums, pa.array(map(said, spans), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return picked(docs, id_col, text_col).mapInArrow(thrifty(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(docs: DataFrame, text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """The rows of ``docs``, all columns, with every span of every rule replaced; overlapping spans become one mask.
    Null text stays null."""
    auto, schema = automaton(), docs.schema

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            column = batch.column(k)
            found = spans_in(auto, *bytes_of(column))
            if any(found):
                texts = column.to_pylist()
                for i, spans in enumerate(found):
                    if spans:
                        texts[i] = _cut(texts[i], spans, mask)
                batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, column.type))
            yield batch

    return docs.mapInArrow(thrifty(run), schema)


def _cut(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])
