"""Elias-Fano coded monotone sequences over numpy arrays, with vectorised access and search, and files that hold them.

A sequence of n integers below u is cut into low bits, packed, and high parts, written in unary: for each value a one bit
after as many zeros as its high part has grown. Counts of ones before each word make select a search over words.
"""

from __future__ import annotations

import json
import tempfile
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs

U64 = np.uint64


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits each, one after another in 64-bit words, with a spare word."""
    words = np.zeros(len(values) * bits // 64 + 2, U64)
    if not bits or not len(values):
        return words
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(U64)
    v = values.astype(U64)
    np.bitwise_or.at(words, word, v << shift)
    over = (at & 63) + bits > 64
    np.bitwise_or.at(words, word[over] + 1, v[over] >> (U64(64) - shift[over]))
    return words


def unpack(words: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), U64)
    bit = at.astype(np.int64) * bits
    word, shift = bit >> 6, (bit & 63).astype(U64)
    out = words[word] >> shift
    over = np.flatnonzero((bit & 63) + bits > 64)
    out[over] |= words[word[over] + 1] << (U64(64) - shift[over])
    return out & U64((1 << bits) - 1)


ONES = U64(0x0101010101010101)
HIGH = U64(0x8080808080808080)
#: Place of the n-th one (from 0) of a byte, at 8 * byte + n.
IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.uint8).ravel()


def nth_one(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Position of the n-th one (from 0) in each word, which must have as many."""
    n = n.astype(U64)
    count = word - ((word >> U64(1)) & U64(0x5555555555555555))
    count = (count & U64(0x3333333333333333)) + ((count >> U64(2)) & U64(0x3333333333333333))
    count = ((count + (count >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * ONES
    # count has in each byte the ones up to its end; bytes that end before the n-th one keep their top bit below
    passed = np.bitwise_count(((n * ONES) | HIGH) - count & HIGH).astype(U64)
    shift = passed << U64(3)
    before = (count << U64(8)) >> shift & U64(255)
    byte = (word >> shift) & U64(255)
    return (shift + IN_BYTE[(byte << U64(3)) + n - before]).astype(np.int64)


class EliasFano:
    """values[i] by access(i); positions by search(x)."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.n, self.last, self.bits = (int(x) for x in arrays["shape"])
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        v = values.astype(U64)
        upper = (v >> U64(bits)).astype(np.int64)
        size = n + (universe >> bits) + 2
        high = np.zeros(size // 64 + 1, U64)
        at = upper + np.arange(n)
        np.bitwise_or.at(high, at >> 6, U64(1) << (at & 63).astype(U64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return {
            "shape": np.array([n, max(universe, 1) - 1, bits], U64), "low": pack(v & U64((1 << bits) - 1), bits), "high": high,
            "ones": ones.astype(np.uint32 if n < 1 << 32 else np.int64),
        }

    def access(self, i: np.ndarray) -> np.ndarray:
        # of one type, or all of ones would be converted
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), side="right") - 1
        at = (word << 6) + nth_one(self.high[word], i - self.ones[word].astype(np.int64))
        return ((at - i).astype(U64) << U64(self.bits)) | unpack(self.low, i, self.bits)

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below bucket: ones before the bucket-th zero."""
        if not hasattr(self, "zeros"):
            self.zeros = (np.arange(len(self.ones), dtype=np.int64) << 6) - self.ones
        k = np.maximum(bucket - 1, 0)
        word = np.searchsorted(self.zeros, k, side="right") - 1
        at = (word << 6) + nth_one(~self.high[word], k - self.zeros[word])
        return np.where(bucket > 0, at - k, 0)

    def _bucket_end(self, bucket: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """_before(bucket + 1), where begin is _before(bucket): a bucket's ones run from its begin to the next zero."""
        bit = begin + bucket
        word, shift = bit >> 6, (bit & 63).astype(U64)
        run = ~self.high[word] >> shift
        zero = run & (~run + U64(1))
        size = np.bitwise_count(zero - U64(1)).astype(np.int64)
        end = begin + size
        long = np.flatnonzero(run == 0)
        if len(long):
            end[long] = self._before(bucket[long] + 1)
        return end

    def search(self, x: np.ndarray) -> np.ndarray:
        """The position of each x, or -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        known = np.flatnonzero(x <= U64(self.last))
        upper = (x[known] >> U64(self.bits)).astype(np.int64)
        low = x[known] & U64((1 << self.bits) - 1)
        # values with the same high part lie side by side; a hot range may hold many, so it is halved
        at = self._before(upper)
        stop = self._bucket_end(upper, at)
        end = stop.copy()
        live = np.flatnonzero(at < end)
        while len(live):
            middle = (at[live] + end[live]) >> 1
            less = unpack(self.low, middle, self.bits) < low[live]
            at[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
            live = live[at[live] < end[live]]
        there = np.flatnonzero(at < stop)
        there = there[unpack(self.low, at[there], self.bits) == low[there]]
        out[known[there]] = at[there]
        return out


# ---------------------------------------------------------------- files


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file; it appears whole or not at all, so tasks may be run again."""
    store, path = _place(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += (a.nbytes + 63) // 64 * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    part = f"{path}.{np.random.default_rng().integers(1 << 62)}"
    with store.open_output_stream(part) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))
    store.move(part, path)


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped, as plain arrays (slices of a memmap cost far more); from a store that is no local folder, by an unnamed local copy."""
    store, path = _place(uri)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
    else:
        with tempfile.TemporaryFile() as local, store.open_input_stream(path) as f:
            while block := f.read(8 << 20):
                local.write(block)
            local.flush()
            raw = np.asarray(np.memmap(local, np.uint8, "r"))
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    return {k: raw[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in head.items()}


def under(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def inside(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k.removeprefix(prefix + "."): v for k, v in arrays.items() if k.startswith(prefix + ".")}
