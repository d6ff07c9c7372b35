"""Byte payloads as ISO base media files: a writer of one raw track, and a reader that walks the nested
boxes, decodes the sample tables, those of movie fragments too, and reports codec, duration and key-frame byte
ranges without decoding a payload.

Defined cases: null text is empty (one padded frame); a null id is kept; equal texts give equal files and repeated rows
equal rows; very long texts are one file, with 64-bit offsets where 32 bits don't reach; an empty table gives no rows; other
columns are not read, whatever their names. A file raises ValueError in which a box overruns its parent, a table has
more entries than its box holds, a sample lies outside the file, or samples have no chunk.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import picked, texts_of, thrifty

FRAME = 576  # bytes of a sample
KEY_EVERY = 16  # every so many samples one is a sync sample
CHUNK = 64  # samples of a chunk
TIMESCALE = 48_000
#: Boxes whose payload is boxes again.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def table(kind: bytes, rows: list[tuple[int, ...]], form: str) -> bytes:
    return full(kind, struct.pack(">I", len(rows)), *(struct.pack(form, *r) for r in rows))


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def write_media(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit mono samples; ``payload`` must be whole frames."""
    n, extra = divmod(len(payload), FRAME)
    if extra or not n:
        raise ValueError("the payload must be a positive multiple of a frame")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    mdat = box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - len(payload)
    chunks = -(-n // CHUNK)
    at = [(first + i * CHUNK * FRAME,) for i in range(chunks)]
    runs = [(1, CHUNK, 1)] if n >= CHUNK else []
    if n % CHUNK:
        runs.append((chunks, n % CHUNK, 1))
    wide = at[-1][0] >= 2**32
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        table(b"stts", [(n, FRAME)], ">II"),
        table(b"stss", [(i + 1,) for i in range(0, n, KEY_EVERY)], ">I"),
        table(b"stsc", runs, ">III"),
        full(b"stsz", struct.pack(">II", FRAME, n)),
        table(b"co64" if wide else b"stco", at, ">Q" if wide else ">I"),
    )
    units = n * FRAME
    v1 = lambda *parts: (struct.pack(">I", 1 << 24), *parts)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    mdhd = box(b"mdhd", *v1(struct.pack(">QQIQHH", 0, 0, TIMESCALE, units, 0x55C4, 0)))
    hdlr = full(b"hdlr", bytes(4), b"soun", bytes(13))
    minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    tkhd = box(b"tkhd", struct.pack(">I", (1 << 24) | 7), struct.pack(">QQIIQ", 0, 0, 1, 0, units), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), matrix, bytes(8))
    mvhd = box(b"mvhd", *v1(struct.pack(">QQIQIH", 0, 0, TIMESCALE, units, 1 << 16, 256), bytes(10), matrix, bytes(24), struct.pack(">I", 2)))
    return ftyp + mdat + box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, start and end of the payload) of each box, parents first."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut off")
        length, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if length == 1:
            if end - start < 16:
                raise ValueError("a box is cut off")
            length, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif length == 0:
            length = end - start
        if length < head or start + length > end:
            raise ValueError("a box overruns its parent")
        yield (*path, kind), start + head, start + length
        if kind in NESTED:
            yield from walk(data, start + head, start + length, (*path, kind))
        start += length


def read_tracks(data: bytes) -> list[dict]:
    """Per track: id, codec, timescale, duration (units), sample offsets and sizes, sync sample numbers (0-based)."""
    try:
        return _tracks(memoryview(data))
    except (struct.error, IndexError) as e:
        raise ValueError("a box is too short for its fields") from e


def _tracks(view: memoryview) -> list[dict]:
    tracks, defaults, fragments, top = [], {}, [], 0
    for path, a, b in walk(view):
        kind = path[-1]
        if len(path) == 1:
            start, top = top, b  # boxes of the file stand side by side
        if kind == b"moof":
            fragments.append({"start": start, "runs": []})
        elif kind == b"trex":
            number, _, duration, size, flags = struct.unpack_from(">5I", view, a + 4)
            defaults[number] = (duration, size, flags)
        elif kind == b"tfhd" and fragments:
            fragments[-1]["runs"].append({**_fragment_head(view, a), "parts": []})
        elif kind == b"trun" and fragments and fragments[-1]["runs"]:
            fragments[-1]["runs"][-1]["parts"].append(_fragment_run(view, a, b))
        if kind == b"trak":
            tracks.append({"duration": 0})
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"tkhd":
            t["id"] = struct.unpack_from(">I", view, a + (20 if view[a] else 12))[0]
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", view, a + 20) if view[a] else struct.unpack_from(">II", view, a + 12)
        elif kind == b"stsd":
            t["codec"] = bytes(view[a + 12 : a + 16]).decode("latin-1")
        elif kind in (b"stts", b"ctts"):
            t[kind.decode()] = _entries(view, a, b, ">II")
        elif kind == b"stss":
            t["sync"] = [x - 1 for (x,) in _entries(view, a, b, ">I")]
        elif kind == b"stsc":
            t["runs"] = _entries(view, a, b, ">III")
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", view, a + 4)
            if size * n > len(view):
                raise ValueError("more samples than the file holds")
            t["sizes"] = [size] * n if size else [x for (x,) in _entries(view, a + 4, b, ">I")]
        elif kind in (b"stco", b"co64"):
            t["chunks"] = [x for (x,) in _entries(view, a, b, ">I" if kind == b"stco" else ">Q")]
    for t in tracks:
        t.setdefault("sizes", [])
        t["offsets"] = _offsets(t)
        if len(t["offsets"]) != len(t["sizes"]):
            raise ValueError("samples without a chunk")
        t.setdefault("sync", list(range(len(t["offsets"]))))
    for f in fragments:
        _append(f, {t.get("id"): t for t in tracks}, defaults)
    for t in tracks:
        if any(at + n > len(view) for at, n in zip(t["offsets"], t["sizes"], strict=True)):
            raise ValueError("a sample lies outside the file")
    return tracks


def _entries(view: memoryview, start: int, end: int, form: str) -> list[tuple]:
    """The rows of a table: flags, a count, and so many entries."""
    n, w = struct.unpack_from(">I", view, start + 4)[0], struct.calcsize(form)
    if start + 8 + n * w > end:
        raise ValueError("a table has more entries than its box")
    return list(struct.iter_unpack(form, view[start + 8 : start + 8 + n * w]))


def _fragment_head(view: memoryview, a: int) -> dict:
    flags, number = struct.unpack_from(">II", view, a)
    out, at = {"id": number, "from_moof": bool(flags & 0x20000)}, a + 8
    for bit, name, form in ((0x1, "base", ">Q"), (0x2, "entry", ">I"), (0x8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I")):
        if flags & bit:
            out[name] = struct.unpack_from(form, view, at)[0]
            at += struct.calcsize(form)
    return out


def _fragment_run(view: memoryview, a: int, b: int) -> dict:
    """Where the run starts, if it says so, and per sample what it gives of duration, size and flags."""
    flags, n = struct.unpack_from(">II", view, a)
    at, out = a + 8, {"n": n}
    if flags & 0x1:
        out["offset"] = struct.unpack_from(">i", view, at)[0]
        at += 4
    if flags & 0x4:
        out["first_flags"] = struct.unpack_from(">I", view, at)[0]
        at += 4
    names = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if at + 4 * len(names) * n > b:
        raise ValueError("a table has more entries than its box")
    if not names and n > len(view):
        raise ValueError("more samples than the file holds")
    rows = struct.iter_unpack(f">{len(names)}I", view[at : at + 4 * len(names) * n]) if names else ((),) * n
    out["samples"] = [dict(zip(names, r, strict=True)) for r in rows]
    return out


def _append(fragment: dict, tracks: dict, defaults: dict) -> None:
    """The samples of a fragment behind those their tracks have."""
    end = fragment["start"]  # a part without a base starts where the part before it ended
    for part in fragment["runs"]:
        t = tracks.get(part["id"])
        if t is None:
            raise ValueError("a fragment of an unknown track")
        base = part.get("base", fragment["start"] if part["from_moof"] else end)
        duration, size, flags = (part.get(k, d) for k, d in zip(("duration", "size", "flags"), defaults.get(part["id"], (0, 0, 0)), strict=True))
        at = base
        for run in part["parts"]:
            at = base + run["offset"] if "offset" in run else at
            for k, x in enumerate(run["samples"]):
                own = x.get("flags", run["first_flags"] if k == 0 and "first_flags" in run else flags)
                if not own & 0x10000:  # not marked as depending on others
                    t["sync"].append(len(t["offsets"]))
                t["offsets"].append(at)
                t["sizes"].append(x.get("size", size))
                t["duration"] += x.get("duration", duration)
                at += t["sizes"][-1]
        end = at


def _offsets(t: dict) -> list[int]:
    sizes, out = t.get("sizes", []), []
    runs, chunks = t.get("runs", []), t.get("chunks", [])
    for k, (first, per, _) in enumerate(runs):
        last = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(chunks)
        for at in chunks[first - 1 : last]:
            for _ in range(per):
                if len(out) < len(sizes):
                    out.append(at)
                    at += sizes[len(out) - 1]
    return out


def payload_of(data: bytes, track: dict) -> bytes:
    return b"".join(data[a : a + n] for a, n in zip(track["offsets"], track["sizes"], strict=True))


def key_ranges(track: dict) -> list[tuple[int, int]]:
    """Byte ranges (start, end) of the sync samples."""
    return [(track["offsets"][i], track["offsets"][i] + track["sizes"][i]) for i in track["sync"]]


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, key_ranges array<struct<start:long,end:long>>"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a media file, written, read back through its sample tables and described. One pass, no shuffle."""

    def run(batches):
        ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [describe(x) for x in texts_of(batch.column(1))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 10
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), ranges]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "key_ranges"])

    return picked(docs, id_col, text_col).mapInArrow(thrifty(run), SCHEMA)


def describe(text: bytes) -> tuple:
    media = write_media(pad(text))
    track = read_tracks(media)[0]
    back = payload_of(media, track)
    keys = key_ranges(track)
    seconds = track["duration"] / track["timescale"]
    feature = f"codec={track['codec'].strip()};timescale={track['timescale']};duration={track['duration']};samples={len(track['sizes'])};keys={len(keys)};first_key={keys[0][0]}-{keys[0][1]};last_key={keys[-1][0]}-{keys[-1][1]}"
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, track["codec"].strip(), seconds, [{"start": a, "end": b} for a, b in keys]
