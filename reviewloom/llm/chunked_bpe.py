"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last 32 bytes has a fixed pattern, so equal
passages are cut alike wherever they stand. Cuts fall anywhere, also inside words. A
chunk is encoded as a text of its own, once a process, and its ids are reused by every
document that holds it (a memo of bounded bytes).

Ids near a cut may be wrong, so each join is repaired: a window that reaches over the cut,
from a boundary of the left chunk's splits to one of the right chunk's, is encoded too. It
begins and ends with a guard, a split of either chunk. If the window's ids begin with the ids
that the left chunk has for its guard, and end with those of the right chunk for its own,
with boundaries of splits behind and before them, the splits on both sides are those of the
whole text, because a split depends on nothing before it and on one character after it; the
window's ids replace those between. If they differ, the window is widened; a join that
agrees at no width, or whose chunk has no room for two windows, has its chunks encoded as one, up to the whole text.

Where the file's rules part words at white space (`encoder.word_rules` compares them),
chunks are encoded by remembered words, and boundaries are the ends of words; for any other
file the library encodes them and says where its splits end.

Defined results: null and empty texts have no ids and decode to the empty string;
white space alone has no ids; texts without white space (of any length) are one window;
special tokens' strings are found as the library finds them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import WORD, column, doc_texts
from .encoder import default_tokenizer, encoder, load, slices

MEAN_BYTES = 512
MIN_BYTES = 64
MAX_BYTES = 8192
MEMO_BYTES = 48 << 20


def _gear() -> np.ndarray:
    """256 fixed pseudo-random 32-bit numbers, from a hash of the byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


_GEAR = _gear()


def cut_points(data: bytes, mean: int = MEAN_BYTES) -> list[int]:
    """Ends of the chunks of UTF-8 `data`, the last included; never inside a character."""
    n = len(data)
    if n <= MIN_BYTES:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    # sum over the last 32 bytes of gear << age, by doubling
    for age in (1, 2, 4, 8, 16):
        h[age:] += h[:-age] << np.uint32(age) if age < n else 0
    bits = mean.bit_length() - 1
    hit = (h >> np.uint32(32 - bits)) == 0
    ends = np.flatnonzero(hit[:-1] & ((raw[1:] & 0xC0) != 0x80)) + 1
    out, at = [], 0
    for e in [*ends.tolist(), n]:
        while e - at > MAX_BYTES:  # no pattern for long
            cut = at + MAX_BYTES
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(cut)
            at = cut
        if e - at >= MIN_BYTES or e == n:
            out.append(e)
            at = e
    return out


#: How many splits a window leaves out at either side of the cut, by width; beyond these, chunks are joined to one.
WIDTHS = (1, 6, 24)
MEMO_SIZES = 500_000
_word = re.compile(WORD)


@dataclass(slots=True)
class _Chunk:
    """ids, and boundaries of splits as (characters from the chunk's start or end, ids before), outermost first, with the texts that reach to the last."""

    ids: bytes
    left: list[tuple[int, int]]
    right: list[tuple[int, int]]
    head: str
    tail: str

    @property
    def size(self) -> int:
        return len(self.ids) + len(self.head) + len(self.tail) + 1200


@dataclass(slots=True)
class _Join:
    keep: int  # ids of the left chunk that stay
    ids: bytes  # of the window, between the guards
    skip: int  # ids of the right chunk that go


class ChunkCodec:
    """Encodes texts to ids (little-endian unsigned 32-bit) and back, exactly as the tokenizers library."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        self.encoder, self.tokenizer = encoder(path), load(path)
        #: characters that a special token may reach over a cut
        self.reach = max([len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()], default=0)
        self.memo_bytes, self.held = memo_bytes, 0
        self.memo: dict = {}
        self.sizes: dict[str, int] = {}  # of words: how many ids
        self.encoded = self.reused = self.widened = self.merged = 0

    # chunks

    def _few(self, ends: Iterable[int], width: int) -> int:
        """How many boundaries to note, for those at these distances: a window that leaves out `width` splits and `reach` characters needs one more for its guard."""
        n = 0
        for n, c in enumerate(ends, 1):
            if n > width + 1 and c >= self.reach:
                return n + 1
        return n + 1

    def _by_words(self, texts: list[str], width: int) -> list[_Chunk]:
        ids = self.encoder.encode(texts)
        spans, ends = [], []
        for t in texts:
            both = []
            for own, edge in ((t, 1), (t[::-1], 0)):  # a boundary is the end of a word: from behind, where it starts
                n = self._few((m.span()[edge] for m in _word.finditer(own)), width)
                both.append([m.span() for m in islice(_word.finditer(own), n)])
            n = len(t)
            both[1] = [(n - b, n - a) for a, b in both[1]]
            spans.append(both)
            ends.append([[t[a:b] for a, b in side] for side in both])
        sizes = self.sizes
        new = list({w for both in ends for side in both for w in side}.difference(sizes))
        if len(sizes) + len(new) > MEMO_SIZES:
            sizes.clear()
            new = list({w for both in ends for side in both for w in side})
        sizes.update(zip(new, (len(x) // 4 for x in self.encoder.encode(new)), strict=True))
        out = []
        for t, own, both, (front, back) in zip(texts, ids, spans, ends, strict=True):
            left, at = [], 0
            for (_, b), w in zip(both[0], front, strict=True):
                at += sizes[w]
                left.append((b, at))
            right, at = [], len(own) // 4
            for (_, b), w in zip(both[1], back, strict=True):
                right.append((b, at))
                at -= sizes[w]
            # the end of the chunk is no boundary
            out.append(self._chunk(t, own, [x for x in left if x[0] < len(t)], [x for x in right if x[0] < len(t)]))
        return out

    def _by_splits(self, texts: list[str], width: int) -> list[_Chunk]:
        out = []
        for t, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            n = len(e.ids)

            def ends(ks, e=e, t=t):
                for k in ks:
                    if _parts(e, k) and not t[(c := e.token_to_chars(k - 1)[1]) - 1].isspace():
                        yield c, k

            left = list(islice(ends(range(1, n)), self._few((c for c, _ in ends(range(1, n))), width)))
            right = list(islice(ends(range(n - 1, 0, -1)), self._few((len(t) - c for c, _ in ends(range(n - 1, 0, -1))), width)))
            out.append(self._chunk(t, np.array(e.ids, "<u4").tobytes(), left, right))
        return out

    def _encode_chunks(self, texts: list[str], width: int) -> list[_Chunk]:
        return (self._by_words if self.encoder.by_words else self._by_splits)(texts, width)

    @staticmethod
    def _chunk(text: str, ids: bytes, left: list, right: list) -> _Chunk:
        right = [(len(text) - c, k) for c, k in right]
        return _Chunk(ids, left, right, text[: left[-1][0]] if left else "", text[len(text) - right[-1][0] :] if right else "")

    def _chunks(self, raws: dict[int, bytes]) -> dict[int, _Chunk]:
        """The chunks by their digests: those remembered, and the others encoded."""
        new = [h for h in raws if h not in self.memo]
        got = dict(zip(new, self._encode_chunks([raws[h].decode() for h in new], WIDTHS[0]), strict=True))
        self.encoded += len(new)
        return {h: self.memo.get(h) or got[h] for h in raws}

    # joins

    def _window(self, a: _Chunk, b: _Chunk, first: bool, last: bool, out: int) -> tuple | None:
        """(text, ids of the left guard, ids of the right guard, keep, skip) of the window that leaves out `out` splits a side; None: no room."""
        i = next((k for k in range(out, len(a.right)) if a.right[k][0] >= self.reach), None)
        j = next((k for k in range(out, len(b.left)) if b.left[k][0] >= self.reach), None)
        if i is not None and i + 1 < len(a.right):
            left, keep, guard = a.tail[len(a.tail) - a.right[i + 1][0] :], a.right[i][1], a.ids[4 * a.right[i + 1][1] : 4 * a.right[i][1]]
        elif first:
            left, keep, guard = None, 0, b""
        else:
            return None
        if j is not None and j + 1 < len(b.left):
            right, skip, after = b.head[: b.left[j + 1][0]], b.left[j][1], b.ids[4 * b.left[j][1] : 4 * b.left[j + 1][1]]
        elif last:
            right, skip, after = None, len(b.ids) // 4, b""
        else:
            return None
        return left, right, guard, after, keep, skip

    def _joined(self, asked: list[tuple]) -> list[_Join | None]:
        """For each (left chunk, right chunk, their texts, whether the left begins the document, whether the right ends it): the repaired join, or None."""
        out: list[_Join | None] = [None] * len(asked)
        todo = list(range(len(asked)))
        for width in WIDTHS:
            windows = []
            for k in todo:
                a, b, a_raw, b_raw, first, last = asked[k]
                if width > WIDTHS[0]:
                    a, b = self._encode_chunks([a_raw.decode(), b_raw.decode()], width)
                if w := self._window(a, b, first, last, width):
                    left, right, *rest = w
                    windows.append((k, (a_raw.decode() if left is None else left) + (b_raw.decode() if right is None else right), *rest))
            for (k, _, guard, after, keep, skip), (ids, parted) in zip(windows, self._encoded([w[1] for w in windows], windows), strict=True):
                if parted and len(ids) >= len(guard) + len(after) and ids.startswith(guard) and ids.endswith(after):
                    out[k] = _Join(keep, ids[len(guard) : len(ids) - len(after)], skip)
            todo = [k for k in todo if out[k] is None]
            if not todo:
                break
            self.widened += len(todo)
        return out

    def _encoded(self, texts: list[str], windows: list[tuple]) -> list[tuple[bytes, bool]]:
        """ids of the windows, and whether splits end behind the left and before the right guard."""
        if self.encoder.by_words:  # the guards are whole words
            return [(x, True) for x in self.encoder.encode(texts)]
        out = []
        for e, (_, _, guard, after, _, _) in zip(self.tokenizer.encode_batch(texts, add_special_tokens=False), windows, strict=True):
            n, i, j = len(e.ids), len(guard) // 4, len(after) // 4
            parted = i + j <= n and (not i or i == n or _parts(e, i)) and (not j or j == n or _parts(e, n - j))
            out.append((np.array(e.ids, "<u4").tobytes(), parted))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            data = t.encode()
            at, own = 0, []
            for e in cut_points(data):
                own.append(data[at:e])
                at = e
            split.append(own)
        seen = [h for own in split for h in map(_digest, own)]
        self.reused += len(seen) - len(set(seen).difference(self.memo))
        out: list[bytes] = [b""] * len(texts)
        todo = [k for k, own in enumerate(split) if own]
        while todo:
            named = {k: [_digest(r) for r in split[k]] for k in todo}
            chunks = self._chunks({h: r for k in todo for h, r in zip(named[k], split[k], strict=True)})
            joins: dict = {}
            for k in todo:
                n = len(split[k])
                for i in range(n - 1):
                    key = (named[k][i], named[k][i + 1], i == 0, i == n - 2)
                    joins.setdefault(key, (split[k][i], split[k][i + 1]))
            new = [key for key in joins if key not in self.memo]
            got = dict(zip(new, self._joined([(chunks[a], chunks[b], *joins[a, b, first, last], first, last) for a, b, first, last in new]), strict=True))
            look = {key: self.memo[key] if key in self.memo else got[key] for key in joins}
            again = []
            for k in todo:
                n = len(split[k])
                own = [look[named[k][i], named[k][i + 1], i == 0, i == n - 2] for i in range(n - 1)]
                parts, start, failed = [], 0, set()
                for i, h in enumerate(named[k]):
                    join = own[i] if i < n - 1 else None
                    end = len(chunks[h].ids) // 4 if i == n - 1 else join.keep if join else -1
                    if end < start:  # no agreement, or the windows of both sides meet inside the chunk
                        failed.add(min(i, n - 2))
                        start = 0
                        if join:
                            start = join.skip
                        continue
                    parts.append(chunks[h].ids[4 * start : 4 * end])
                    if join:
                        parts.append(join.ids)
                        start = join.skip
                if not failed:
                    out[k] = b"".join(parts)
                    continue
                self.merged += len(failed)
                whole: list[bytes] = []
                for i, raw in enumerate(split[k]):
                    if i and i - 1 in failed:
                        whole[-1] += raw
                    else:
                        whole.append(raw)
                split[k] = whole
                again.append(k)
            self._remember({h: c for h, c in chunks.items() if h not in self.memo} | {key: j for key, j in got.items() if j})
            todo = again
        return out

    def _remember(self, new: dict) -> None:
        size = sum(x.size if isinstance(x, _Chunk) else len(x.ids) + 300 for x in new.values())
        if self.held + size > self.memo_bytes:
            self.memo, self.held = {}, 0
        if size <= self.memo_bytes:
            self.memo.update(new)
            self.held += size

    def decode(self, ids: list[bytes]) -> list[str]:
        """Text of each ids value: decode(ids, skip_special_tokens=False)."""
        return self.tokenizer.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)


def _digest(raw: bytes) -> int:
    return xxhash.xxh3_128_intdigest(raw)


def _parts(e, k: int) -> bool:
    """Whether a split ends before the k-th id of an encoding."""
    a, b = e.token_to_word(k - 1), e.token_to_word(k)
    return a is not None and b is not None and a != b


_own: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    if path not in _own:
        _own[path] = ChunkCodec(path)
    return _own[path]


def encode(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of every whole text."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for batch in batches:
            keys, texts = column(batch, "doc_id"), column(batch, "text")
            for i, j in slices(texts):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec(path).encode(texts[i:j])]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return doc_texts(documents).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text: the decoded ids of encode()'s rows (null ids: null)."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for batch in batches:
            ids = column(batch, "ids")
            text = iter(codec(path).tokenizer.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else next(text) for x in ids], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: of the ids and of what they decode to, without storing either."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for batch in batches:
            keys, texts = column(batch, "doc_id"), column(batch, "text")
            for i, j in slices(texts):
                own = codec(path)
                ids = own.encode(texts[i:j])
                listed = [np.frombuffer(x, "<u4").tolist() for x in ids]
                back = own.tokenizer.decode_batch(listed, skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i:j], pa.int64()), pa.array([len(x) for x in listed], pa.int64()), pa.array([sha(" ".join(map(str, x)).encode()) for x in listed]), pa.array([sha(x.encode()) for x in back])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return doc_texts(documents).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
