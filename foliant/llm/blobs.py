"""Arrays in compressed blobs, by which tasks ask other tasks about many small things in few rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the smallest type that holds them; others as they are."""
    a = np.asarray(a)
    if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
        most = int(a.max())
        return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))
    return a


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one blob: bytes of equal weight lie together, so that small numbers compress well."""
    heads, bodies = [], []
    for a in map(narrow, arrays):
        a = np.ascontiguousarray(a)
        heads.append(f"{a.dtype.str}:{len(a)}")
        bodies.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    raw = ",".join(heads).encode() + b"\n" + b"".join(bodies)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=4).compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    at, out = raw.index(b"\n"), []
    heads, at = raw[:at].decode().split(","), at + 1
    for h in heads:
        kind, n = h.split(":")
        kind, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n) if kind.itemsize > 1 else planes[0].view(kind) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def pack_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as two arrays: their lengths and their bytes."""
    return np.fromiter(map(len, texts), np.int64, len(texts)), np.frombuffer(b"".join(texts), np.uint8)


def unpack_texts(lengths: np.ndarray, data: np.ndarray) -> list[bytes]:
    ends, raw = np.cumsum(lengths, dtype=np.int64).tolist(), data.tobytes()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def parts_of(texts: list[bytes], n: int) -> np.ndarray:
    """The part, 0 to n - 1, that a byte string is asked in."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t) % n for t in texts), np.int64, len(texts))


def split_by(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, places of its members in order) for each part that occurs."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    return [(int(part[p[0]]), p) for p in np.split(order, cut) if len(p)]


def vocabulary_parts(chars: int) -> int:
    """Parts to deal the different words of a text to: words grow about as the text to the power 3/4, a part holds some tens of thousands."""
    return max(1, int(chars**0.75 / 50_000) + 1)


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def flat_slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all members of slices (start, length), one slice after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values; ends: where each run ends."""
    total = np.concatenate([[0], np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)])
    return np.diff(total[np.concatenate([[0], ends])])
