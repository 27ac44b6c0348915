"""Token ids of whole texts, with a bounded cache of pre-tokens.

BPE never merges across pre-tokens, so ids of a pre-token can be remembered: most of them repeat. Texts within Latin-1 are cut
here by the tokenizer's own rules, in vector operations over one byte a character; any other text, and one that holds an added token, is encoded
whole by the tokenizers library, as is every pre-token that the cache lacks. Two forms of normalizer and pre-tokenizer are known, and told by the tokenizer's file:

* white space dropped and letters lowered ("words");
* byte-level with a leading space ("bytes").

Under a file of any other form all texts are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

from darkroom.llm import _text

#: Pre-tokens of the cache at most, and bits of its slots' numbers; and bytes of pre-tokens at most, so long ones don't fill it.
CACHE, SLOT_BITS, CACHE_BYTES = 1 << 20, 21, 1 << 24
#: Characters that are cut at once: few enough for their arrays to stay in a processor's cache.
CHUNK = 1 << 18
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = bytes(range(256)).decode("latin-1")
SPACE, LETTER, DIGIT, OTHER, END = range(5)
#: Fixed classes of the characters of Latin-1, and their lower case.
CLASSES = np.array([SPACE if re.match(f"[{_S}]", c) else LETTER if re.match(f"[{_L}]", c) else DIGIT if re.match(f"[{_N}]", c) else OTHER for c in _LATIN], np.uint8)
LOWER = np.frombuffer(_LATIN.lower().encode("latin-1"), np.uint8)
#: Fixed forms of the two, as tokenizer files write them.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
WORDS_FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            _BYTE_LEVEL | {"use_regex": False},
        ],
    },
)
BYTES_FORM = (None, _BYTE_LEVEL | {"use_regex": True})
_PLAIN_WORDS, _PLAIN_BYTES = re.compile(f"[{_L}]+"), re.compile(f" [{_L}]+")
_encoders: dict = {}


def cut(buf: np.ndarray, kind: np.ndarray, drops_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens. ``kind``: classes of the characters; ``END`` stands between texts, and three or more at the end.

    "words": 's|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^SLN]+, white space dropped; "bytes": 's|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+.
    """
    start = np.ones(len(buf), dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    if drops_space:
        start |= kind == DIGIT
    else:
        # the last of some white space before a character stands apart, and a blank goes with the character
        after = np.flatnonzero(start[1:] & (kind[:-1] == SPACE)) + 1
        after = after[kind[after] != END]
        start[after - 1] = True
        start[after[buf[after - 1] == 32]] = False
    # contractions begin where a pre-token does
    at = np.flatnonzero((buf == 39) & (kind == OTHER) & start)
    if len(at):
        one, two = buf[at + 1], buf[at + 2]
        short = (kind[at + 1] == LETTER) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (kind[at + 2] == LETTER) & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        start[at[short | long] + 1] = False
        after = np.concatenate([at[short] + 2, at[long] + 3])
        start[after[kind[after] == LETTER]] = True
    gone = (kind == END) | (kind == SPACE) if drops_space else kind == END
    edge = np.flatnonzero(start | gone)
    own = np.flatnonzero(~gone[edge])
    return edge[own], edge[own + 1]


class _Flat:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Cache:
    """Ids of pre-tokens in flat arrays, found by a hash. Callers compare the bytes, so no hash decides alone."""

    def __init__(self):
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.keys, self.begin, self.size, self.chars = _Flat(np.uint64), _Flat(np.int64), _Flat(np.int64), _Flat(np.uint8)
        self.ids_begin, self.ids_size, self.ids = _Flat(np.int64), _Flat(np.int64), _Flat("<u4")

    def find(self, key: np.ndarray) -> np.ndarray:
        """Entries by hash, -1 where there is none."""
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found = self.slots[slot]
        rest = np.flatnonzero((found >= 0) & (self.keys.data[found] != key))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << SLOT_BITS) - 1)
            found[rest] = self.slots[slot[rest]]
            rest = rest[(found[rest] >= 0) & (self.keys.data[found[rest]] != key[rest])]
        return found

    def add(self, key: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        """Add different keys that aren't held."""
        first = self.keys.n
        for lengths, begin, size, flat, values in (
            (np.array([len(w) for w in words]), self.begin, self.size, self.chars, np.frombuffer(b"".join(words), np.uint8)),
            (np.array([len(i) // 4 for i in ids]), self.ids_begin, self.ids_size, self.ids, np.frombuffer(b"".join(ids), "<u4")),
        ):
            begin.extend(flat.n + np.cumsum(lengths) - lengths)
            size.extend(lengths)
            flat.extend(values)
        self.keys.extend(key)
        slot, entry, rest = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.arange(first, self.keys.n, dtype=np.int32), np.arange(len(key))
        while len(rest):
            free = rest[self.slots[slot[rest]] < 0]
            self.slots[slot[free]] = entry[free]
            rest = rest[self.slots[slot[rest]] != entry[rest]]
            slot[rest] = (slot[rest] + 1) & ((1 << SLOT_BITS) - 1)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs, one run after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Encoder:
    """Ids of texts under one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            written = json.load(f)
        form = written.get("normalizer"), written.get("pre_tokenizer")
        added = [t for t in written.get("added_tokens") or ()]
        # added tokens that match normalized text, or take white space with them, need the library
        self.known = form in (WORDS_FORM, BYTES_FORM) and written["model"].get("type") == "BPE" and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in added)
        self.added = [t["content"] for t in added]
        self.drops_space = form == WORDS_FORM
        self.plain = (_PLAIN_WORDS if self.drops_space else _PLAIN_BYTES).fullmatch
        self.plain_tokenizer = self.tokenizer
        if self.known and self.drops_space:
            # words of letters that are lowered and cut already
            self.plain_tokenizer = Tokenizer.from_file(path)
            self.plain_tokenizer.normalizer = None
            self.plain_tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache = _Cache()

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _ask_plain(self, words: list[str]) -> list[bytes]:
        """Ids of words that keep apart when they are laid end to end."""
        if len(words) < 2:
            return self._ask(words)
        found = self.plain_tokenizer.encode((" " if self.drops_space else "").join(words), add_special_tokens=False)
        ids, owner = np.array(found.ids, dtype="<u4"), np.array(found.word_ids)
        ends = np.searchsorted(owner, np.arange(1, len(words) + 1))
        data, at, out = ids.tobytes(), 0, []
        for e in (4 * ends).tolist():
            out.append(data[at:e])
            at = e
        return out

    def _learn(self, key: np.ndarray, words: list[bytes]) -> None:
        """Put pre-tokens into the cache, each with its hash."""
        texts = [w.decode("latin-1") for w in words]
        plain = [bool(self.plain(t)) for t in texts]
        easy, found = [t for t, p in zip(texts, plain) if p], []
        for at in range(0, len(easy), 512):
            found += self._ask_plain(easy[at : at + 512])
        found, others = iter(found), iter(self._ask([t for t, p in zip(texts, plain) if not p]))
        self.cache.add(key, words, [next(found if p else others) for p in plain])

    def _pieces(self, buf: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Starts of pre-tokens and numbers of their ids, all ids, and starts whose hash misled. Cuts lie before white space, so they part no pre-tokens."""
        kind = CLASSES[buf]
        gaps = np.flatnonzero((kind[1:] == SPACE) & (kind[:-1] != SPACE)) + 1
        kind[breaks] = END
        at = 0
        while at < len(buf):
            to = np.searchsorted(gaps, at + CHUNK)
            to = int(gaps[to]) if to < len(gaps) else len(buf)
            part = np.append(buf[at:to], np.full(3, 10, np.uint8))
            start, end = cut(part, np.append(kind[at:to], np.full(3, END, np.uint8)), self.drops_space)
            key = _text.Rolling(part).of(start, end)
            found = self.cache.find(key)
            if (found < 0).any():
                keys, one = np.unique(key[found < 0], return_index=True)
                if self.cache.keys.n + len(keys) > CACHE or self.cache.chars.n > CACHE_BYTES:
                    self.cache = _Cache()
                    found[:] = -1
                    keys, one = np.unique(key, return_index=True)
                if len(keys) > CACHE:  # a text without white space
                    yield start + at, np.zeros(len(start), np.int64), np.zeros(0, "<u4"), start + at
                    at = to
                    continue
                one = np.flatnonzero(found < 0)[one]
                data = part.tobytes()
                self._learn(keys, [data[s:e] for s, e in zip(start[one].tolist(), end[one].tolist())])
                found[found < 0] = self.cache.find(key[found < 0])
            cache, size = self.cache, end - start
            same = cache.size.data[found] == size
            own = np.flatnonzero(same)
            apart = part[_runs(start[own], size[own])] != cache.chars.data[_runs(cache.begin.data[found[own]], size[own])]
            if apart.any():
                same[own] = np.add.reduceat(apart, np.cumsum(size[own]) - size[own], dtype=np.int64) == 0
            n = cache.ids_size.data[found]
            yield start + at, n, cache.ids.data[_runs(cache.ids_begin.data[found], n)], start[~same] + at
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        if not self.known:
            return self._ask(texts)
        out: list = [None] * len(texts)
        latin: dict[int, bytes] = {}
        for n, text in enumerate(texts):
            try:
                data = text.encode("latin-1")
            except UnicodeEncodeError:
                data = None
            if data is None or any(a in text for a in self.added):
                out[n] = self._ask([text])[0]
            else:
                latin[n] = data
        if not latin:
            return out
        buf = np.frombuffer(b"\n".join([*latin.values(), b""]), np.uint8)
        buf = LOWER[buf] if self.drops_space else buf
        breaks = np.cumsum([len(x) + 1 for x in latin.values()]) - 1
        start, n, ids, odd = (np.concatenate(x) for x in zip(*self._pieces(buf, breaks)))
        ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, breaks)]
        data, at = ids.tobytes(), 0
        for k, e in zip(latin, (4 * ends).tolist()):
            out[k] = data[at:e]
            at = e
        for k in set(np.searchsorted(breaks, odd).tolist()):
            k = list(latin)[k]
            out[k] = self._ask([texts[k]])[0]
        return out


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
