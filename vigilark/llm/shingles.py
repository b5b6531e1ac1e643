"""Word shingles of whole texts as 64-bit numbers, and fast similarity sketches of their sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted: runs of ``width`` words, lower-cased in A-Z.

    A text of fewer words has one shingle, the whole sequence; without words it has none.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    real = pc.binary_length(flat).to_numpy() > 0  # none before leading or after trailing white space
    ends = np.concatenate([[0], np.cumsum(real)])[ends - ends[0]]
    coded = flat.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64,
                         len(coded.dictionary))
    codes = hashes[coded.indices.to_numpy()[real]] if len(hashes) else np.zeros(0, np.uint64)
    if len(codes) >= width:
        rows = len(codes) - width + 1
        keys = np.full(rows, np.uint64(width))
        for k in range(width):
            keys = mix(keys * FACTOR + codes[k:k + rows])
    else:
        keys = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(keys[a:b - width + 1]))
        elif b > a:
            key = np.full(1, np.uint64(b - a))
            for k in range(a, b):
                key = mix(key * FACTOR + codes[k:k + 1])
            out.append(key)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(keys: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        one, two = mix(keys + FACTOR).sum(dtype=np.uint64), mix(keys * FACTOR + np.uint64(1)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


class Sketcher:
    """Fast similarity sketching (Dahlgaard, Knudsen, Thorup, 2017).

    In round i < t every element is hashed to one of t bins; in round t + b all go to bin b. A bin keeps
    its smallest (round, hash), so it is settled in the first round that reaches it, every bin is
    filled after 2t rounds at the latest, and after one for sets much larger than t. Two sets agree in a
    bin with a probability equal to their similarity, with the concentration of independent samples.
    """

    def __init__(self, bins: int = 128, seed: int = 17):
        if bins & (bins - 1) or bins > 512:
            raise ValueError("bins: a power of 2, at most 512")
        self.bins = bins
        self.shift = np.uint64(bins.bit_length() - 1)
        self.seeds = mix((np.arange(1, 2 * bins + 1, dtype=np.uint64) + np.uint64(seed)) * FACTOR)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        t, empty = self.bins, np.uint64(0xFFFFFFFFFFFFFFFF)
        out = np.full(t, empty)
        at = 0
        while at < t and (at == 0 or (out == empty).any()):
            # Several rounds at once for a small set; a later round never displaces an earlier one.
            rounds = np.arange(at, min(t, at + max(1, 512 // len(keys))), dtype=np.uint64)
            found = mix(keys[None, :] ^ self.seeds[rounds.astype(np.int64), None])
            place = (found & np.uint64(t - 1)).astype(np.int64).ravel()
            value = ((rounds[:, None] << np.uint64(54)) | (found >> np.uint64(10))).ravel()
            np.minimum.at(out, place, value)
            at += len(rounds)
        for bin_ in np.flatnonzero(out == empty).tolist():
            found = mix(keys ^ self.seeds[t + bin_])
            out[bin_] = (np.uint64(t + bin_) << np.uint64(54)) | (found >> np.uint64(10)).min()
        return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A number for each run of ``rows`` bins, its place included; equal if the bins are."""
    parts = sketch.reshape(-1, rows)
    keys = np.arange(1, len(parts) + 1, dtype=np.uint64) * FACTOR
    for k in range(rows):
        keys = mix(keys * FACTOR + parts[:, k])
    return keys.view(np.int64)
