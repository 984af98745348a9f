"""Words, lines and word windows of many texts at once, with numpy over the UTF-8 bytes.

A byte table says which bytes belong to a word and what they become (A-Z may turn into a-z), so one pass over the
bytes of a batch yields the words of all its texts.  Words and windows are known by 64-bit hashes: polynomials in an
odd base over random byte values, which prefix sums give for all words together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _table(separators: range | list[int], lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[list(separators)] = 0
    if lower:
        table[0x41:0x5B] += 0x20
    return table


_SPACES = [0x20, *range(0x09, 0x0E)]
#: Words ``[^\x20\x09-\x0D]+``, as they are and with A-Z lowered.  Byte 0 belongs to such a word, so it is written as 0x20.
SPACED, SPACED_LOWER = _table(_SPACES, False), _table(_SPACES, True)
for _t in (SPACED, SPACED_LOWER):
    _t[0] = 0x20
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lowered.
ALNUM_LOWER = _table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], True)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown when a longer text comes."""

    up = _powers(_BASE, 1 << 16)
    down = _powers(_INVERSE, 1 << 16)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << int(n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``data``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


@dataclass
class Words:
    """Words of several texts: ``first[i]`` to ``first[i + 1]`` are those of text i."""

    data: np.ndarray  # bytes after the table
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def words(self, a: int, b: int) -> bytes:
        """Words a to b - 1, joined by a space."""
        raw = self.data.tobytes() if b - a > 4096 else None
        cut = (lambda s, e: raw[s:e]) if raw else (lambda s, e: self.data[s:e].tobytes())
        return b" ".join(cut(s, e) for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist()))


def split_words(data: np.ndarray, at: np.ndarray, table: np.ndarray, hashed: bool = True) -> Words:
    """The words of the texts data[at[i]:at[i + 1]]."""
    mapped = table[data]
    inside = mapped != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(mapped, start, end, np.searchsorted(start, at), span_hashes(mapped, start, end) if hashed else np.zeros(0, np.uint64))


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the hash of the n words from it on, and whether they lie within its text."""
    h = words.hash
    total = len(h)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(total, np.uint64)
    for k, factor in enumerate(_powers(_STEP, min(n, total))):
        out[: total - k] += h[k:] * factor
    last = np.repeat(words.first[1:], words.counts) - n
    return mix(out + np.uint64(n)), np.arange(total) <= last


def window_hash(hashes: np.ndarray) -> np.uint64:
    """What :func:`windows` gives for a window of just these words."""
    powers = _powers(_STEP, len(hashes))
    return mix(np.array([(hashes * powers).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0]


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles by text, each text's sorted by hash: the hashes and the n_texts + 1 places where they begin.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    h, whole = windows(words, n)
    text = words.text_of()
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    h, text = h[whole], text[whole]
    if len(short):
        h = np.concatenate([h, np.array([window_hash(words.hash[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)])
        text = np.concatenate([text, short])
    parts, ends = [], np.zeros(len(words.first), np.int64)
    order = np.argsort(text, kind="stable")
    h, cut = h[order], np.searchsorted(text[order], np.arange(len(words.first)))
    for i in range(len(words.first) - 1):
        own = np.unique(h[cut[i] : cut[i + 1]])
        parts.append(own)
        ends[i + 1] = len(own)
    return (np.concatenate(parts) if parts else h), np.cumsum(ends)
