"""SuperMinHash signatures: correlated permutation ranks per element, with early stopping.

Every element of a set walks through its own random permutation of the signature's slots (a Fisher-Yates shuffle
seeded by the element). At step j it offers its j-th slot the value j plus a random fraction. A slot keeps its
smallest offer, so one that was filled at step j is final after that step, and a set is finished as soon as all its
slots are: large sets stop after one or two steps. As every element reaches every slot once, the slots of a
signature are negatively correlated and the share of equal slots estimates the similarity with less variance than
independent minima do.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Slots of a signature.
SLOTS = 96
#: Elements that are shuffled at once.
BLOCK = 1 << 14
#: Word hashes a task remembers.
REMEMBERED = 1 << 20

_OPEN = np.uint64(2**64 - 1)
_LOW = np.uint64(2**32 - 1)
_HALF = np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words; fewer words make one run, none an empty set."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    run = min(words, len(w))
    out = np.full(len(w) - run + 1, run, np.uint64)
    for i in range(run):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - run + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` values for each set; an empty set keeps the largest value everywhere."""
    out = np.full((len(sets), slots), _OPEN, np.uint64)
    owners: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    held = 0
    for k, elements in enumerate(sets):
        for i in range(0, len(elements), BLOCK):
            part = elements[i : i + BLOCK]
            if held and held + len(part) > BLOCK:
                _offer(out, np.concatenate(parts), np.concatenate(owners))
                owners, parts, held = [], [], 0
            parts.append(part)
            owners.append(np.full(len(part), k))
            held += len(part)
    if held:
        _offer(out, np.concatenate(parts), np.concatenate(owners))
    return out


def _offer(out: np.ndarray, elements: np.ndarray, owners: np.ndarray) -> None:
    """Lower the slots of the owners' rows to what these elements offer."""
    slots = out.shape[1]
    first, last = owners[0], owners[-1] + 1
    rows = np.full((last - first, slots), _OPEN, np.uint64)
    flat, at = rows.reshape(-1), (owners - first) * slots
    order = None
    for j in range(slots):
        draw = mixed(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = (j + ((draw & _LOW) * np.uint64(slots - j) >> _HALF)).astype(np.int64)
        if order is None:
            slot = k
        else:
            here = np.arange(len(k))
            slot = order[here, k].astype(np.int64)
            order[here, k] = order[here, j]
            order[here, j] = slot
        # A slot filled at an earlier step holds a smaller value than any offer of this one.
        np.minimum.at(flat, at + slot, np.uint64(j << 32) | (draw >> _HALF))
        unfinished = (rows == _OPEN).any(axis=1)
        alive = unfinished[at // slots]
        if not alive.any():
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int64), (int(alive.sum()), 1))
            k = k[alive]
            here = np.arange(len(k))
            order[here, k] = 0
            order[here, 0] = k
        elif not alive.all():
            order = order[alive]
        if not alive.all():
            elements, at = elements[alive], at[alive]
    out[first:last] = np.minimum(out[first:last], rows)
