"""Numpy kernels over the UTF-8 bytes of whole Arrow batches.

All texts of a batch are worked on at once as one byte array with offsets, so
cost per byte is a few array passes.  Hashes are polynomials modulo 2**64 over
random byte values, taken from running sums, and finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Byte classes.  White space: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Word bytes: digits, letters and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[65:91] = WORD[128:] = True
#: A-Z to a-z, the rest unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher (xor-shift-multiply), in place."""
    with np.errstate(over="ignore"):
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random uint64 values that depend on nothing but the seed."""
    return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U((seed * 2 + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown for each worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 << 20:
            _powers[base] = have
    return have[:n]


def running(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums S with S[j] - S[i] = base**i * hash(values[i:j]), of len(values) + 1."""
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.multiply(values, powers(len(values), base), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    """Mixed hashes of values[start:end]."""
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse)[start])


def rolling_hash(sums: np.ndarray, width: int, inverse: int = INVERSE) -> np.ndarray:
    """Mixed hashes of values[i:i+width], for each i that has so many."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U)
    out = sums[width:] - sums[:n]
    out *= powers(n, inverse)
    return mix(out)


def columns_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets; null: no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes (a longer text alone)."""
    _, at = columns_bytes(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and n + 1 word offsets of the rows; a word also ends at each byte of ``cuts``."""
    inside = kind[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if cuts is not None:
        cut[cuts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside
    last = last & np.append(~inside[1:] | cut[1:n], True)
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, lower: bool = False) -> np.ndarray:
    table = seeded(256, seed)
    if lower:
        table = table[LOWER]
    return spans_hash(running(table[data]), start, end)


#: A prime modulus whose products fit 62 bits.
PRIME = (1 << 31) - 1
_residues: dict[int, np.ndarray] = {}


def residues(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME, kept and grown for each worker."""
    have = _residues.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U)
        while len(have) < max(n, 1 << 20):
            have = np.concatenate([have, have * U(pow(base, len(have), PRIME)) % U(PRIME)])
        if len(have) <= 8 << 20:
            _residues[base] = have
    return have[:n]


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME up to one multiple of it, for a PRIME of one bit less than a power of two."""
    return (x & U(PRIME)) + (x >> U(31))


def prime_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Polynomials of the bytes data[start:end] modulo a prime: unequal spans of n bytes agree for at most n of 2**31 bases."""
    base = int(seeded(1, seed)[0]) % (PRIME - 2) + 2
    table = seeded(256, seed + 1) % U(PRIME)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(folded(table[data] * residues(len(data), base)), out=sums[1:])
    back = residues(len(data) + 1, pow(base, -1, PRIME))
    return (sums[end] - sums[start]) % U(PRIME) * back[start] % U(PRIME)


def strong_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Word hashes that no pattern of letters can make equal: the ring's polynomial and one of prime modulus, mixed with the length."""
    prime = prime_hashes(data, start, end, seed + 101) << U(32) | (end - start).astype(U) & U((1 << 32) - 1)
    return mix(word_hashes(data, start, end, seed) ^ mix(prime))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each position."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of x[i:i+w], by doubling."""
    if w == 1:
        return x.copy()
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, cur = 1, x
    while have * 2 <= w:
        cur = np.minimum(cur[: len(cur) - have], cur[have:])
        have *= 2
    return np.minimum(cur[:n], cur[w - have : w - have + n]) if have < w else cur[:n]


POSITION_BITS = 24


def fragments(unit: np.ndarray, offsets: np.ndarray, window: int, k: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Runs of consecutive windows that share their anchor.

    ``unit``: a uint64 for each token (byte or word) of the rows; a window is
    ``window`` consecutive tokens of one row.  Its anchor is the leftmost of
    its k-grams with the least hash, so equal windows have equal anchors at
    equal offsets.  A run is a fragment: row, first window (token position in
    the row), number of windows, hash of the anchor, and hash of the tokens
    with the anchor's offset.  Equal windows either lie in equal fragments at
    equal places or in different fragments of one anchor.
    """
    n = len(unit) - window + 1
    none = {x: np.zeros(0, np.int64) for x in ("row", "start", "count", "anchor", "content", "offset")}
    if n <= 0:
        return none
    if len(unit) >= 1 << POSITION_BITS:
        return _long_fragments(unit, offsets, window, k, seed)
    sums = running(unit)
    gram = rolling_hash(sums, k)
    if seed:
        gram = mix(gram ^ U(seed))
    low = U((1 << POSITION_BITS) - 1)
    keyed = (gram & ~low) | np.arange(len(gram), dtype=U)
    place = (sliding_min(keyed, window - k + 1) & low).astype(np.int64)[:n]
    row = row_of(offsets)[:n]
    valid = np.arange(n) + window <= offsets[1:][row]
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return none
    total = np.append(0, np.cumsum(valid))
    stop = np.append(start[1:], n)
    count = total[stop] - total[start]
    where = row[start]
    content = spans_hash(sums, start, start + count + window - 1)
    content = mix(content ^ (place[start] - start).astype(U) * U(0xA24BAED4963EE407))
    return {"row": where, "start": start - offsets[where], "count": count, "anchor": gram[place[start]].view(np.int64), "content": content.view(np.int64), "offset": place[start] - start}


def _long_fragments(unit, offsets, window, k, seed):
    """Row by row, and rows of many tokens in stretches that share window - 1."""
    step, parts = 1 << (POSITION_BITS - 1), []
    for r in range(len(offsets) - 1):
        for a in range(int(offsets[r]), max(int(offsets[r]) + 1, int(offsets[r + 1]) - window + 1), step):
            b = min(int(offsets[r + 1]), a + step + window - 1)
            got = fragments(unit[a:b], np.array([0, b - a]), window, k, seed)
            got["row"] = got["row"] + r
            got["start"] = got["start"] + (a - int(offsets[r]))
            parts.append(got)
    return {x: np.concatenate([p[x] for p in parts]) for x in parts[0]}


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A mask of the positions in the union of the spans."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.minimum(starts, size), 1)
    np.add.at(edge, np.minimum(ends, size), -1)
    return np.cumsum(edge[:-1]) > 0
