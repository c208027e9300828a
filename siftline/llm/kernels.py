"""Vectorised text kernels over Arrow string buffers.

All work on whole texts, in slices of about ``SLICE_BYTES`` bytes of text (one text is never cut), so
that memory depends on the slice and on the longest text, not on the partition.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Fingerprints of words and windows are
64-bit and mixed nonlinearly by place, so that equal fingerprints stand for equal content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 125_000
SLICE_ROWS = 4_000

U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes of a piece of a span, and a random value for each place in a piece and byte.
PIECE = 32
_PLACES = mix(np.arange(1, PIECE * 256 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + size, "right")) - 1
        b = min(max(b, a + 1), a + SLICE_ROWS, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of the first word of each text (one more than texts)."""
    solid = ~_WS[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = off[:-1][off[:-1] < len(data)]
    first[edge] = solid[edge]
    edge = off[1:][off[1:] > 0] - 1
    last[edge] = solid[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the bytes from start to end of spans that follow each other without overlap; it does
    not depend on where they stand.

    Each place of a piece of PIECE bytes has its own random value for each byte, and the sums of pieces are mixed
    with the piece's number before they are added: unlike a polynomial modulo 2**64, no family of texts collides."""
    if not len(start):
        return np.zeros(0, U64)
    size = (end - start).astype(np.int64)
    pieces = np.maximum(-(-size // PIECE), 1)
    whole = int(pieces.max()) == 1
    if whole:
        a, b = start, end
    else:
        first = np.cumsum(pieces) - pieces
        number = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
        a = np.repeat(start, pieces) + number * PIECE
        b = np.minimum(a + PIECE, np.repeat(end, pieces))
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    place = np.zeros(len(data) + 1, kind)
    place[a] = a
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(data) + 1, dtype=kind), place, out=place)
    place = place[:-1]
    place &= PIECE - 1
    place <<= 8
    place |= data
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_PLACES.take(place), out=total[1:])
    sums = mix(total[b] - total[a])
    if not whole:
        sums = np.add.reduceat(np.where(number > 0, mix(sums + number.astype(U64) * U64(0xA0761D6478BD642F)), sums), first)
    return mix(sums + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def _next(hashes: np.ndarray, after: np.ndarray, step: int) -> np.ndarray:
    """Each fingerprint mixed with the one ``step`` places on; those without one stay."""
    out = hashes.copy()
    if step < len(out):
        out[:-step] = mix(out[:-step] * U64(0xD1342543DE82EF95) + after[step:])
    return out


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of the k hashes from each position on, whether the window stays in its text), by doubling."""
    size, power, rest = 0, 1, k
    double, out = hashes, hashes
    while rest:
        if rest & 1:
            out = double if not size else _next(out, double, size)
            size += power
        rest >>= 1
        if rest:
            double = _next(double, double, power)
            power *= 2
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    return out, left >= k


def sequences(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint of all hashes of each text, in their order."""
    size = np.diff(first)
    place = (np.arange(len(hashes)) - np.repeat(first[:-1], size)).astype(U64)
    total = np.concatenate(([U64(0)], np.cumsum(mix(hashes ^ mix(place + U64(0x5851F42D4C957F2D))))))
    return mix(total[first[1:]] - total[first[:-1]] + size.astype(U64))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text after A-Z are lowered: (fingerprints, offsets by text).

    A text of fewer words has its whole sequence as one shingle, a text without words none. The
    fingerprints have 52 bits and come in ascending order within a text."""
    start, end, first = words(data, off)
    h = span_hashes(LOWER[data], start, end)
    shingle, whole = windows(h, first, k)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    key = [(doc[whole].astype(U64) << U64(52)) | (shingle[whole] >> U64(12))]
    if len(short):
        key.append((short.astype(U64) << U64(52)) | (sequences(h, first)[short] >> U64(12)))
    key = np.sort(np.concatenate(key))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & U64((1 << 52) - 1), np.searchsorted(key >> U64(52), np.arange(len(off), dtype=U64))


#: Of a signature component that no element has reached.
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def superminhash(elements: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m components for each set of elements.

    An element draws a random permutation of the components and visits them in that order with ranks
    j + u, u uniform below 1; a component keeps its least rank. All elements of a slice take step j
    together, and the elements of a set stop as soon as each of its components has a rank, since later
    steps only bring larger ones. Rank j + u is stored as j * 2**32 + u * 2**32."""
    docs = len(off) - 1
    sig = np.full(docs * m, EMPTY, U64)
    doc = np.repeat(np.arange(docs), np.diff(off))
    seed = mix(elements + U64(0x9E3779B97F4A7C15))
    perm = None
    for j in range(m):
        if not len(seed):
            break
        r = mix(seed + U64((j + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
        pick = j + (((r & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            row = np.arange(len(seed))
            slot = perm[row, pick].astype(np.int64)
            perm[row, pick] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, doc * m + slot, (U64(j) << U64(32)) | (r >> U64(32)))
        open_ = (sig.reshape(docs, m) == EMPTY).any(axis=1)[doc]
        if j == 0:
            seed, doc, pick = seed[open_], doc[open_], pick[open_]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(seed), 1))
            perm[np.arange(len(seed)), pick] = 0
            perm[:, 0] = pick
        elif not open_.all() and (open_.sum() < 0.7 * len(open_)):
            seed, doc, perm = seed[open_], doc[open_], perm[open_]
    return sig.reshape(docs, m)


_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8).view(U64).ravel()


def simhashes(features: np.ndarray, first: np.ndarray, lanes: int) -> np.ndarray:
    """SimHash of ``lanes`` * 64 bits of each run of features (runs must not be empty).

    A bit is set if more than half of the run's features set it. Bits are counted eight to a 64-bit
    word, in pieces of at most 255 features so that no count overflows into the next."""
    runs = len(first) - 1
    size = np.diff(first)
    pieces = -(-size // 255)
    owner = np.repeat(np.arange(runs), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[:-1][owner] + 255 * within
    whole = pieces.max(initial=0) <= 1
    half = (size[:, None] // 2).astype(np.uint8 if whole else np.int64)
    out = np.zeros((runs, lanes), U64)
    for lane in range(lanes):
        h = mix(features + U64((lane + 1) * 0xE7037ED1A0B428DB & (1 << 64) - 1))
        for byte in range(8):
            spread = _SPREAD[((h >> U64(8 * byte)) & U64(255)).astype(np.intp)]
            counts = np.add.reduceat(spread, starts).view(np.uint8).reshape(-1, 8)
            if not whole:
                counts = np.add.reduceat(counts.astype(np.int64), np.cumsum(pieces) - pieces, axis=0)
            bits = np.packbits(counts > half, axis=1)[:, 0]
            out[:, lane] |= bits.astype(U64) << U64(8 * byte)
    return out


def lists(values: np.ndarray, off: np.ndarray, type_: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column; unsigned 64-bit values keep their bits as signed ones."""
    values = values.view(np.int64) if values.dtype == U64 else values
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, type_))


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))
