"""Counts of integer keys behind minimal perfect hashes.

Keys are dealt to shards by a hash, and each shard gets a hash of its own: a row of bit arrays, where a key owns the
first place that no other key of its level hits, and the rank of that bit is the key's slot.  So n keys have the
slots 0 to n - 1, for about four bits a key.  The key of each slot is kept beside it, so that strangers are told apart.
"""

from __future__ import annotations

import numpy as np

SPACE = 1.5  # bits of a level for each key that is left
_STEP = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each key."""
    h = keys.astype(np.uint64) + np.uint64((seed + 1) * _STEP % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, 999) % np.uint64(shards)).astype(np.int32)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits packed in 64-bit words, the keys by slot) of distinct keys."""
    sizes, words, owners, left = [], [], [], keys
    while len(left):
        size = -(-int(SPACE * len(left)) // 64) * 64 + 64
        place = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, np.uint8)
        bits[place[alone]] = 1
        owners.append(left[alone][np.argsort(place[alone])])
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone]
    return np.array(sizes, np.int32), np.concatenate(words or [np.zeros(0, "<u8")]), np.concatenate(owners or [keys])


class PerfectHash:
    """The hashes of some of the shards, as one; `known` has the keys by slot."""

    def __init__(self, shards: int, built: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
        self.shards = shards
        depth = max((len(sizes) for _, sizes, _, _ in built), default=0)
        self.sizes = np.zeros((depth + 1, shards), np.int64)  # the last level is empty
        self.begins = np.zeros((depth + 1, shards), np.int64)
        at = 0
        for shard, sizes, words, _ in built:
            self.sizes[: len(sizes), shard] = sizes
            self.begins[: len(sizes), shard] = at + np.cumsum(sizes) - sizes
            at += 64 * len(words)
        self.words = np.concatenate([w for _, _, w, _ in built] or [np.zeros(0, np.uint64)]).astype(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = (np.cumsum(ones) - ones).astype(np.int32)
        self.known = np.concatenate([k for _, _, _, k in built] or [np.zeros(0, np.int32)])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not known."""
        out = np.full(len(keys), -1, np.int64)
        shard = shard_of(keys, self.shards)
        rest = np.arange(len(keys))
        for level, (sizes, begins) in enumerate(zip(self.sizes, self.begins, strict=True)):
            own = shard[rest]
            size = sizes[own]
            rest, own, size = rest[size > 0], own[size > 0], size[size > 0]
            if not len(rest):
                break
            place = begins[own] + (mixed(keys[rest], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = self.ranks[place[hit] >> 6] + before[hit]
            rest = rest[~hit]
        found = out >= 0
        found[found] = self.known[out[found]] == keys[found]
        out[~found] = -1
        return out
