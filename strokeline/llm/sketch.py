"""Shingle sets and fast similarity sketches, computed in tasks on a slice of texts at a time.

A sketch has t coordinates. In round i < t every element of the set falls into a hashed bin with a hashed value and
counts i + value there; in round t + j every element counts in bin j. A coordinate keeps its smallest count, and the
rounds end when every bin is filled: after 2 t rounds at the latest, after about one round for sets much larger than t.
Two sketches agree in a coordinate with the probability of the sets' Jaccard similarity, and the number of agreeing
coordinates is concentrated around its mean as if the coordinates were sampled without replacement.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text_arrow import coded, hashes_of, mixed, words_of

_STEP = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of all texts, offsets by text).

    Words are lower-cased in A-Z; a shingle is `size` neighbouring words, and a text with fewer words has its whole
    sequence as its only shingle. A text without words has an empty set.
    """
    words, offsets = words_of(pc.ascii_lower(texts))
    codes, distinct = coded(words)
    word = hashes_of(distinct, seed=size)[codes]
    n = len(word)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        key[: n - k] += word[k:] * (_STEP[k % len(_STEP)] + np.uint64(2 * k))
    key = mixed(key)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= size:
            part = np.sort(key[a : b - size + 1])
            sets.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
        elif b > a:
            whole = np.uint64(b - a)
            for w in word[a:b]:
                whole = mixed(np.array([whole ^ w]))[0]
            sets.append(np.array([whole], dtype=np.uint64))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def fingerprints(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; equal sets have equal fingerprints."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat), dtype=np.uint64)])
    sums = total[offsets[1:]] - total[offsets[:-1]]
    return mixed(sums ^ mixed(np.diff(offsets).astype(np.uint64)))


def sketches(flat: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """[sets, t] coordinates, all 0 for an empty set."""
    n = len(offsets) - 1
    made = np.zeros((n, t), dtype=np.uint64)
    sizes = np.diff(offsets)
    active = np.flatnonzero(sizes > 0)
    filled = np.zeros((n, t), dtype=bool)
    element, owner = flat, np.repeat(np.arange(n), sizes)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(2 * t):
        if not len(active):
            break
        h = mixed(element ^ mixed(np.array([i + 1], dtype=np.uint64))[0])
        place = ((h >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        value = mixed(h + np.uint64(i))  # the round is part of the value: a count of round i never equals one of another round
        least = np.full(n * t if i == 0 else len(active) * t, top, dtype=np.uint64)
        if i == 0:
            row, rows = owner, np.arange(n)
        else:
            local = np.full(n, -1, dtype=np.int64)
            local[active] = np.arange(len(active))
            row, rows = local[owner], active
        np.minimum.at(least, row * t + place, value)
        least = least.reshape(-1, t)
        new = (least != top) & ~filled[rows]
        part = made[rows]
        part[new] = least[new]
        made[rows] = part
        filled[rows] |= new
        still = ~filled[active].all(axis=1)
        if not still.all():
            active = active[still]
            keep = np.zeros(n, dtype=bool)
            keep[active] = True
            mask = keep[owner]
            element, owner = element[mask], owner[mask]
    return made


def band_keys(made: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[sets, bands] 64-bit keys, each of `rows` neighbouring coordinates and the band's number."""
    parts = made[:, : bands * rows].reshape(len(made), bands, rows)
    key = mixed(np.arange(bands, dtype=np.uint64))[None, :].repeat(len(made), axis=0)
    for r in range(rows):
        key = mixed(key ^ parts[:, :, r])
    return key


def packed(flat: np.ndarray) -> bytes:
    """Shingle hashes, whole and in order, as bytes."""
    return flat.astype("<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u8")


def overlap(a: bytes, b: bytes) -> tuple[int, int]:
    """(intersection, union) of two packed sets."""
    x, y = unpacked(a), unpacked(b)
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common, len(x) + len(y) - common
