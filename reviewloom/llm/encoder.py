"""Exact token ids of a public tokenizers file, with words remembered.

A file with the rules below (normalizer: NFC, white space to one space, lower case; splits
that never hold white space) encodes a text as the concatenation of its words'
encodings: ASCII white space composes with nothing and separates all splits. So a
word seen before needs no second encoding. The memo is bounded; what falls out of
it is encoded again. Files with any other rule are recognized, and whole texts are given to the library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from .common import words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters (precomposed, kept by NFC, lower case of one code point), and the characters of simple texts: those,
#: ASCII without control characters but white space, and general punctuation.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĹ-ňŊ-ŷ"
_simple = re.compile(f"[\t-\r -~×÷‐-‧{_LETTERS}]*").fullmatch
#: The tokenizer's own splits, for simple texts in lower case.
_splits = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+").findall
SPECIAL = "<|"
#: The rules under which words may be encoded apart, as tokenizers files state them.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
MEMO_WORDS = 100_000
MEMO_PARTS = 600_000
LONGEST_REMEMBERED = 64
WORD_END = "</w>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def word_rules(tokenizer) -> bool:
    """Whether the file has exactly the rules that this module relies on; its special tokens must hold no white space and show by SPECIAL."""
    own = json.loads(tokenizer.to_str())
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
    added = all(SPECIAL in t["content"] and words(t["content"]) == [t["content"]] and all(t[k] == v for k, v in plain.items()) for t in own["added_tokens"])
    return added and all(own.get(k) == v for k, v in RULES.items()) and all(own["model"].get(k) == v for k, v in MODEL.items())


class WordEncoder:
    """Texts to ids (little-endian unsigned 32-bit), as the tokenizers library gives them.

    Two memos: of the splits (a run of letters in lower case, a run of marks, ...) of
    simple texts, and of the words of others. Both are emptied when full, so that their
    memory is bounded whatever the corpus.

    >>> WordEncoder(path).encode(["a text", ""])  # one bytes object a text
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, memo_parts: int = MEMO_PARTS):
        self.tokenizer = load(path)
        self.by_words = word_rules(self.tokenizer)
        self.memo_words, self.memo_parts = memo_words, memo_parts
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(WORD_END)

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Each part is one split, of which just the last token has the word's end: many are encoded as one text."""
        ids = np.array(self.tokenizer.encode(" ".join(parts), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts):  # a vocabulary without ends of words
            return self._encode_each(parts)
        packed, cuts = ids.tobytes(), [0, *(cuts * 4).tolist()]
        return [packed[i:j] for i, j in zip(cuts, cuts[1:])]

    def _simple(self, texts: list[str]) -> list[bytes]:
        """Simple texts: the splits are found here, and only new ones are encoded."""
        split = [_splits(t.lower()) for t in texts]
        parts = self.parts
        new = set(chain.from_iterable(split)).difference(parts)
        if len(parts) + len(new) > self.memo_parts:
            parts.clear()
            new = set(chain.from_iterable(split))
        new = list(new)
        for i in range(0, len(new), 20_000):
            parts.update(zip(new[i : i + 20_000], self._encode_parts(new[i : i + 20_000]), strict=True))
        return [b"".join(map(parts.__getitem__, p)) for p in split]

    def _other(self, texts: list[str]) -> list[bytes]:
        """Any texts: words are encoded as texts of their own."""
        split = [words(t) for t in texts]
        known = self.words
        new = set(chain.from_iterable(split)).difference(known)
        if len(known) + len(new) > self.memo_words:
            known.clear()
            new = set(chain.from_iterable(split))
        new = list(new)
        got = dict(zip(new, self._encode_each(new), strict=True))
        kept = {w: v for w, v in got.items() if len(w) <= LONGEST_REMEMBERED}
        look = known if len(kept) == len(got) else known | got
        known.update(kept)
        return [b"".join(map(look.__getitem__, ws)) for ws in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._encode_each(texts)
        plain = [bool(_simple(t)) and SPECIAL not in t for t in texts]
        a = iter(self._simple([t for t, p in zip(texts, plain, strict=True) if p]))
        b = iter(self._other([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(a if p else b) for p in plain]


_own: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder for `path`."""
    if path not in _own:
        _own[path] = WordEncoder(path)
    return _own[path]


def slices(texts: list, at_most_chars: int = 2_000_000):
    """Index ranges of about `at_most_chars` each, so that a batch of long texts stays small in memory."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= at_most_chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
