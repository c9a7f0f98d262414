"""Words and other short units of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

WHITE = b" \t\n\r\x0b\x0c"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
_KEEP = np.append((np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
#: Bytes that every buffer of texts ends with, so that 16 bytes can be read anywhere.
PAD = 16


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """(the texts with white space between and behind, where each begins and the last ends)."""
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return b" ".join([*texts, b" " * (PAD - 1 + -(int(first[-1]) + PAD) % 8 + 1)]), first


def lanes(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of units as two 64-bit numbers, zero beyond their size."""
    wide = np.lib.stride_tricks.as_strided(text.view("<u8"), (len(text) - 8,), (1,))
    low, high = wide[at] & _KEEP[np.minimum(size, 8)], np.zeros(len(at), np.uint64)
    more = np.nonzero(size > 8)[0]
    high[more] = wide[at[more] + 8] & _KEEP[np.minimum(size[more] - 8, 8)]
    return low, high


def with_nul(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Units that hold a zero byte, which their first 16 bytes would not tell from shorter ones."""
    out = np.zeros(len(at), bool)
    nul = np.nonzero(text == 0)[0]
    if len(nul):
        k = np.searchsorted(at, nul, side="right") - 1
        k, nul = k[k >= 0], nul[k >= 0]
        out[k[nul < at[k] + size[k]]] = True
    return out


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, at, size, low, high): the text with A-Z lower-cased, and its words by place and key.

    The key of a word of up to 16 bytes is the word itself; that of a longer one, or
    one with a zero byte, a 128-bit hash.
    """
    from xxhash import xxh3_128_digest

    text = LOWER[np.frombuffer(data, np.uint8)]
    edge = np.diff((~_SPACE[text]).view(np.int8), prepend=np.int8(0))
    at, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    size = end - at
    if not len(at):
        return text, at, size, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    low, high = lanes(text, at, size)
    other = np.nonzero((size > 16) | with_nul(text, at, size))[0]
    if len(other):
        digests = b"".join([xxh3_128_digest(text[a:b].tobytes()) for a, b in zip(at[other].tolist(), end[other].tolist(), strict=True)])
        keys = np.frombuffer(digests, "<u8").reshape(-1, 2)
        low[other], high[other] = keys[:, 0] | np.uint64(1), keys[:, 1]
    return text, at, size, low, high


class KeyTable:
    """Keys of two 64-bit numbers, the first not 0, in open addressing; looked up many at once and compared whole."""

    def __init__(self, bits: int = 21):
        self.bits, self.slots = bits, 1 << bits
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.keys = 0

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xA0761D6478BD642F))) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not known."""
        slot = self._home(low, high)
        wrong = np.nonzero((self.low[slot] != low) | (self.high[slot] != high))[0]
        while len(wrong):  # no key is 0, so an empty slot ends a search
            at = slot[wrong]
            free = self.low[at] == 0
            slot[wrong[free]] = -1
            wrong = wrong[~free]
            at = (at[~free] + 1) & (self.slots - 1)
            slot[wrong] = at
            wrong = wrong[(self.low[at] != low[wrong]) | (self.high[at] != high[wrong])]
        return slot

    def put(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slots of distinct keys that are not known yet."""
        slot, left = self._home(low, high), np.arange(len(low))
        claim = np.empty(self.slots, np.int64) if len(low) > self.slots >> 4 else None
        self.keys += len(low)
        while len(left):
            at = slot[left]
            free = np.nonzero(self.low[at] == 0)[0]
            if claim is not None:
                claim[at[free]] = free  # of several for one slot, the last one written has it
                own = free[claim[at[free]] == free]
            else:
                own = free[np.unique(at[free], return_index=True)[1]]
            self.low[at[own]], self.high[at[own]] = low[left[own]], high[left[own]]
            rest = np.ones(len(left), bool)
            rest[own] = False
            left = left[rest]
            slot[left] = (slot[left] + 1) & (self.slots - 1)
        return slot


def distinct(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An index of each different key."""
    order = np.lexsort((high, low))
    first = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))
    return order[first] if len(order) else order
