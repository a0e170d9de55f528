"""Sorted string tables: a file of key-ordered entries that is searched without being read whole.

Layout (integers little-endian, varints as seven bits a byte, low first):

    block*  filter  index  footer

block   entries, then the restart offsets (u32 each), their number (u32); stored with a
        one-byte codec (0 plain, 1 zstd) before and a u32 crc32 behind.
entry   varint shared, varint own, varint value length, the own key bytes, the value;
        `shared` bytes are those of the key before. Every 16th entry is a restart: shared 0.
index   an entry per block: key is the block's last key, value the varints offset, stored
        size, number of entries and of tokens before the block.
filter  u32 number of probes, u64 number of bits, the Bloom bits.
footer  u64 x 6: offset and size of the filter and of the index, entries, tokens;
        u32 width of a token in bytes; the magic.

Keys are document identifiers as eight bytes, big-endian with the sign bit turned, so
that byte order is numeric order; a null identifier is the empty key and comes first.
Keys may repeat. Values are token ids of the footer's width.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

MAGIC = b"RLSSTAB1"
FOOTER = struct.Struct("<6QI8s")
RESTART = 16
BLOCK_BYTES = 64 << 10


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


class _Block:
    def __init__(self) -> None:
        self.data, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.data))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.data += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1

    def stored(self, compress) -> bytes:
        plain = bytes(self.data) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        packed = compress(plain)
        body = b"\x01" + packed if len(packed) < len(plain) else b"\x00" + plain
        return body + struct.pack("<I", zlib.crc32(body))


def _unpack(stored: bytes) -> tuple[bytes, list[int]]:
    """The entries' bytes and the restart offsets."""
    body, crc = stored[:-4], struct.unpack("<I", stored[-4:])[0]
    if zlib.crc32(body) != crc:
        raise ValueError("a block's checksum is wrong")
    plain = zstandard.ZstdDecompressor().decompress(body[1:]) if body[0] else body[1:]
    (n,) = struct.unpack("<I", plain[-4:])
    ends = len(plain) - 4 - 4 * n
    return plain[:ends], list(struct.unpack(f"<{n}I", plain[ends:-4]))


def _entries(data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
    last = b""
    while at < len(data):
        shared, at = _read_varint(data, at)
        own, at = _read_varint(data, at)
        size, at = _read_varint(data, at)
        last = last[:shared] + data[at : at + own]
        at += own
        yield last, data[at : at + size]
        at += size


def _seek(data: bytes, restarts: list[int], key: bytes) -> int:
    """Offset of the last restart whose key is below `key`: by binary search."""
    lo, hi = 0, len(restarts) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        _, at = _read_varint(data, restarts[mid])
        own, at = _read_varint(data, at)
        _, at = _read_varint(data, at)
        if data[at : at + own] < key:
            lo = mid
        else:
            hi = mid - 1
    return restarts[lo] if restarts else 0


def _probes(key: bytes, k: int, bits: int) -> Iterator[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    for i in range(k):
        yield (a + i * b) % 2**64 % bits


class Writer:
    """add() entries in key order, then finish(). Of the file, one block, the index and 8 bytes an entry are held."""

    def __init__(self, out, width: int, bits_per_key: int = 10, level: int = 1):
        self.out, self.width, self.bits_per_key = out, width, bits_per_key
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.block, self.index, self.at = _Block(), _Block(), 0
        self.entries = self.tokens = self.block_tokens = 0
        self.keys: list[bytes] = []
        self.first: bytes | None = None
        self.last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must ascend")
        if self.first is None:
            self.first = key
        self.block.add(key, ids.astype(f"<u{self.width}").tobytes())
        if not self.entries or key != self.last:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        self.block_tokens += len(ids)
        if len(self.block.data) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.block.count:
            return
        stored = self.block.stored(self.compress)
        self.index.add(self.block.last, _varint(self.at) + _varint(len(stored)) + _varint(self.entries - self.block.count) + _varint(self.tokens))
        self.out.write(stored)
        self.at += len(stored)
        self.tokens += self.block_tokens
        self.block, self.block_tokens = _Block(), 0

    def finish(self) -> int:
        """Write the filter, the index and the footer; the file's size."""
        self._flush()
        bits = max(64, len(self.keys) * self.bits_per_key)
        k = max(1, round(self.bits_per_key * math.log(2)))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[list(_probes(key, k, bits))] = True
        filt = struct.pack("<IQ", k, bits) + np.packbits(bloom, bitorder="little").tobytes()
        index = self.index.stored(self.compress)
        self.out.write(filt)
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, len(filt), self.at + len(filt), len(index), self.entries, self.tokens, self.width, MAGIC))
        return self.at + len(filt) + len(index) + FOOTER.size


class Reader:
    """Reads a table from a random-access file: iteration, or lookup of one key through filter, index and one block."""

    def __init__(self, file, size: int):
        self.file = file
        f_at, f_size, i_at, i_size, self.entries, self.tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted string table")
        self._filter_at = f_at, f_size
        self._filter: bytes | None = None
        data, _ = _unpack(self._read(i_at, i_size))
        self.index = []
        for key, value in _entries(data):
            at, p = _read_varint(value, 0)
            n, p = _read_varint(value, p)
            before, p = _read_varint(value, p)
            tokens, p = _read_varint(value, p)
            self.index.append((key, at, n, before, tokens))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, at, n, _, _ in self.index:
            for key, value in _entries(_unpack(self._read(at, n))[0]):
                yield id_of(key), self._ids(value)

    def may_hold(self, doc_id: int | None) -> bool:
        if self._filter is None:
            self._filter = self._read(*self._filter_at)
        k, bits = struct.unpack_from("<IQ", self._filter)
        return all(self._filter[12 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key_of(doc_id), k, bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of this key; [] if there is none."""
        if not self.may_hold(doc_id):
            return []
        key, lo, hi = key_of(doc_id), 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.index[mid][0] < key:
                lo = mid + 1
            else:
                hi = mid
        out = []
        for _, at, n, _, _ in self.index[lo:]:
            data, restarts = _unpack(self._read(at, n))
            for k, value in _entries(data, _seek(data, restarts, key)):
                if k > key:
                    return out
                if k == key:
                    out.append(self._ids(value))
        return out
