"""Vectorised work on the UTF-8 bytes of many texts at once, inside a task.

Texts arrive as Arrow string arrays; the functions here see one byte buffer and the offsets of the texts in it.
Hashes chain mixed blocks; polynomials modulo a power of two have whole families of words that collide. Texts with equal
chains can still be written on purpose, so chains bring candidates together and never decide.
"""

from __future__ import annotations

import ctypes
import hashlib
import inspect
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers without structure.
_STEP, _LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
#: Words longer than so many bytes are hashed one at a time.
LONG_WORD = 512
#: Texts are handled in slices of about so many bytes; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Digests held as objects at a time.
DIGESTS = 1 << 13


def give_back() -> None:
    """Return freed memory to the system: workers stay alive between tasks, and more of them than run at a time."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(work):
    """The task function `work` (of batches, of a group, or of two groups), giving memory back at its end."""
    if inspect.isgeneratorfunction(work):

        def of_batches(batches):
            try:
                yield from work(batches)
            finally:
                give_back()

        return of_batches
    if len(inspect.signature(work).parameters) == 2:

        def of_group(key, table):
            try:
                return work(key, table)
            finally:
                give_back()

        return of_group

    def of_groups(key, left, right):
        try:
            return work(key, left, right)
        finally:
            give_back()

    return of_groups


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, with zeros behind the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def chain_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each span of bytes: blocks of eight go through a mix one after another, so no spans of a certain form
    collide. Spans of over LONG_WORD bytes are hashed one by one."""
    eight, length = eights(raw), (ends - starts).astype(np.int64)
    out = mix(length.astype(np.uint64) * _LEFT + np.uint64(seed))
    long = np.flatnonzero(length > LONG_WORD)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    left = np.flatnonzero((length > 0) & (length <= LONG_WORD))
    at, rest = starts[left], length[left]
    while len(left):
        block = eight[at] & _MASKS[np.minimum(rest, 8)]
        out[left] = mix((out[left] ^ block) * _STEP)
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    return out


def identities(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a salted BLAKE2b digest of each span of bytes."""
    held, take = memoryview(np.ascontiguousarray(raw)), hashlib.blake2b
    both = np.empty((len(starts), 2), np.uint64)
    for at in range(0, len(starts), DIGESTS):
        spans = zip(starts[at : at + DIGESTS].tolist(), ends[at : at + DIGESTS].tolist(), strict=True)
        said = b"".join([take(held[a:b], digest_size=16, salt=salt).digest() for a, b in spans])
        both[at : at + DIGESTS] = np.frombuffer(said, np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def chain_values(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each run of values, taken one after another."""
    out = mix(lengths.astype(np.uint64) * _LEFT + np.uint64(seed))
    left = np.flatnonzero(lengths > 0)
    at, rest = starts[left], lengths[left]
    while len(left):
        out[left] = mix((out[left] ^ values[at]) * _STEP)
        more = rest > 1
        left, at, rest = left[more], at[more] + 1, rest[more] - 1
    return out


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` neighbours, from hashes of runs half as long; values must be hashes themselves."""
    if size > len(values) or size < 1:
        return values[:0]
    held, reach = values, 1
    while 2 * reach <= size:
        held = mix(held[:-reach] * _LEFT + (held[reach:] ^ np.uint64(reach)) * _RIGHT)
        reach *= 2
    if reach < size:
        rest = size - reach
        held = mix(held[:-rest] * _RIGHT + (held[rest:] ^ np.uint64(size)) * _LEFT)
    return held


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, step: int = 1 << 20) -> np.ndarray:
    """chain_bytes of words in order, over no more than about `step` bytes at a time."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
        a = starts[i]
        out[i:j] = chain_bytes(raw[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a, seed)
        i = j
    return out


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string or binary array; a null has no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, place, data = array.buffers()
    offsets = np.frombuffer(place, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about `limit` bytes of text."""
    for batch in batches:
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def table_of(keep) -> np.ndarray:
    """A lookup over the 256 byte values."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of words separated by ASCII white space.
SPACED = table_of(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words made of digits, lower-case letters and anything beyond ASCII.
ALPHANUMERIC = table_of(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (one more than texts)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = table[raw]
    begins = inside[1:-1] & ~inside[:-2]
    finishes = inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]  # a word never crosses from one text into the next
    begins[edge] = inside[1:-1][edge]
    finishes[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions starts[i] .. starts[i]+lengths[i]-1, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
