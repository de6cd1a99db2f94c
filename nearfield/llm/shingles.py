"""Word shingles of whole texts, for whole batches at a time.

Words are runs of digits, a-z and anything beyond ASCII of the lower-cased text;
a shingle is five consecutive words. A text of fewer words, but not none, has one
shingle of all its words; a text without words has none.

``hashed_sets`` names shingles by 128 bits that come from the words' MD5 digests;
``exact_sets`` numbers them by their words themselves, for the texts of one task.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np

WORDS = 5
#: Distinct words whose digests a table holds.
HELD = 1 << 18
# ASCII characters that are no part of a word become blanks, which split() splits at.
_BETWEEN = "".join(map(chr, range(128))).translate(str.maketrans("", "", string.digits + string.ascii_letters)).encode()
_BLANKS = bytes.maketrans(_BETWEEN, b" " * len(_BETWEEN))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(text: str) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class WordTable:
    """The digests of a bounded number of words, as two 64-bit hashes."""

    def __init__(self, size: int = HELD) -> None:
        self.size, self.numbers, self.digests = size, _Numbers(), np.empty((0, 2), np.uint64)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """(words, 2) hashes."""
        if len(self.numbers) > self.size:
            self.numbers, self.digests = _Numbers(), np.empty((0, 2), np.uint64)
        at = self.numbers.of(words)
        if self.numbers.new:
            more = b"".join([hashlib.md5(w).digest() for w in self.numbers.new])
            self.digests = np.concatenate([self.digests, np.frombuffer(more, np.uint64).reshape(-1, 2)])
            self.numbers.new.clear()
        return self.digests[at]


def _chained(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive words, none of a word's bits combining linearly with another's."""
    out = np.full((max(0, len(h) - n + 1), 2), n, np.uint64)
    for k in range(n):
        out = mix((out ^ h[k : k + len(out)]) + np.uint64(0x9E3779B97F4A7C15))
    return out


def hashed_sets(texts: list[list[bytes]], words: int = WORDS, table: WordTable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, given as words: (shingles, 2) hashes sorted within each text, and where each text's begin and the last ones end."""
    table = table or WordTable()
    sizes = np.array([len(w) for w in texts], np.int64)
    h = table.hashes([w for part in texts for w in part])
    first = np.cumsum(sizes) - sizes
    whole = _chained(h, words)
    each = np.maximum(0, sizes - words + 1)
    owner = np.repeat(np.arange(len(texts)), each)
    at = np.arange(each.sum()) + np.repeat(first - (np.cumsum(each) - each), each)
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    found = [whole[at], *(_chained(h[first[i] : first[i] + sizes[i]], int(sizes[i])) for i in short)]
    owner, found = np.concatenate([owner, short]), np.concatenate(found)
    # one sort by text and the hash's upper bits; that and the rest only where these don't tell all apart
    bits = np.uint64(max(1, len(texts)).bit_length())
    short_key = owner.astype(np.uint64) << (np.uint64(64) - bits) | found[:, 0] >> bits
    order = np.argsort(short_key)
    key, a, b = short_key[order], found[order, 0], found[order, 1]
    if ((key[1:] == key[:-1]) & ((a[1:] != a[:-1]) | (b[1:] != b[:-1]))).any():
        order = np.lexsort((found[:, 1], found[:, 0], owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1]).any(1)
    return found[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The first hashes of each text's shingles, sorted."""
    found, cut = hashed_sets([split_words(t) for t in texts], words)
    return [found[a:b, 0] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def exact_sets(texts: list[list[bytes]], words: int = WORDS) -> list[np.ndarray]:
    """Numbers of each text's distinct shingles, sorted; two shingles have one number if their words are equal, not only their hashes."""
    numbers = _Numbers()
    w = numbers.of([x for part in texts for x in part])
    sizes = np.array([len(part) for part in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    known: dict[int, np.ndarray] = {1: w}

    def code(n: int) -> np.ndarray:
        """A number for every ``n`` consecutive words."""
        if n not in known:
            a, b = code(n // 2), code(n - n // 2)
            size = max(0, len(w) - n + 1)
            pairs = a[:size] * (int(b.max(initial=0)) + 1) + b[n // 2 : n // 2 + size]
            known[n] = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        return known[n]

    whole = code(words)
    each = np.maximum(0, sizes - words + 1)
    at = np.arange(each.sum()) + np.repeat(first - (np.cumsum(each) - each), each)
    owner, found = np.repeat(np.arange(len(texts)), each), whole[at]
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(short):  # numbered after all others
        named: dict[bytes, int] = {}
        more = [len(w) + named.setdefault(b" ".join(texts[i]), len(named)) for i in short.tolist()]
        owner, found = np.concatenate([owner, short]), np.concatenate([found, np.array(more, np.int64)])
    pairs = np.unique(owner * (2 * len(w) + 1) + found)
    owner, found = pairs // (2 * len(w) + 1), pairs % (2 * len(w) + 1)
    return np.split(found, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []
