"""A small causal self-attention model in numpy: forward, backward and training.

Symbols are classes of subword ids. A token's query comes from the symbol before it; keys and values come
from the symbols up to there, with a learned bias by distance; what the heads gather and the last
symbol pass one hidden layer, whose scores correct a table of symbol pairs counted from the corpus.
Queries and keys hang on symbols only, so scoring looks their products up in a table.
A symbol is predicted in two steps, its group of ``group`` symbols and its place there, so that the work
for a token grows with the root of their number.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

MASKED = np.float32(-1e4)


class Shape(NamedTuple):
    """symbols (the last is the end of a text; one more marks the beginning), sizes, and the window."""

    symbols: int
    group: int = 32
    width: int = 24
    heads: int = 1
    key: int = 16
    value: int = 32
    hidden: int = 48
    context: int = 16  # symbols that a window repeats from the one before
    stride: int = 32  # symbols that a window scores

    @property
    def groups(self) -> int:
        return self.symbols // self.group

    @property
    def span(self) -> int:
        return self.context + self.stride


def start(shape: Shape, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[-2])).astype(np.float32)
    s = shape
    return {
        "embed": rng.normal(size=(s.symbols + 1, s.width)).astype(np.float32) * np.float32(0.5),
        "query": draw(s.heads, s.width, s.key), "keys": draw(s.heads, s.width, s.key), "values": draw(s.heads, s.width, s.value),
        # One head looks near at first, the others far.
        "bias": np.stack([-np.arange(s.span) * (0.7 / (1 + 6 * h)) for h in range(s.heads)]).astype(np.float32),
        "inner": draw(s.width + s.heads * s.value, s.hidden), "offset": np.zeros(s.hidden, np.float32),
        "outer": np.zeros((s.hidden, s.symbols), np.float32), "first": np.zeros((s.hidden, s.groups), np.float32),
    }


def window_places(ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The text of each window, and its number there, for texts that lie one after another (``ends``: where each starts, with the end)."""
    counts = -(-np.diff(ends) // shape.stride)
    text = np.repeat(np.arange(len(counts)), counts)
    return text, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def windows(text: np.ndarray, nth: np.ndarray, ends: np.ndarray, shape: Shape) -> np.ndarray:
    """Overlapping windows, a row each: ``context`` + ``stride`` places, of which the last ``stride`` are scored.

    -1 stands before a text's beginning and behind its end. Every place is scored in exactly one window.
    """
    at = (nth * shape.stride)[:, None] + np.arange(-shape.context, shape.stride)
    inside = (at >= 0) & (at < np.diff(ends)[text][:, None])
    return np.where(inside, at + ends[:-1][text][:, None], -1)


def causal(bias: np.ndarray, shape: Shape) -> np.ndarray:
    """heads x stride x (span - 1): the bias of the distance between query and key, or the mask."""
    ahead = (shape.context + np.arange(shape.stride) - 1)[:, None] - np.arange(shape.span - 1)[None, :]
    return np.where(ahead >= 0, bias[:, np.maximum(ahead, 0)], MASKED)


class Tables(NamedTuple):
    """What hangs on symbols only: a row for each symbol, the beginning, and last what is not seen (zeros).

    first: the last symbol's part of the hidden layer; for each head, queries, keys, and values as the hidden layer takes them.
    A value's last entry is 1, to sum the weights; that of what is not seen is 0, so it has no weight.
    """

    first: np.ndarray
    heads: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def tables(p: dict[str, np.ndarray], shape: Shape) -> Tables:
    embed = np.vstack([p["embed"], np.zeros((1, shape.width), p["embed"].dtype)])
    seen = np.ones((len(embed), 1), embed.dtype)
    seen[-1] = 0
    return Tables(embed @ p["inner"][:shape.width] + p["offset"], [
        (embed @ (p["query"][h] * np.float32(shape.key ** -0.5)), embed @ p["keys"][h],
         np.hstack([embed @ (p["values"][h] @ p["inner"][rows_of(h, shape)]), seen])) for h in range(shape.heads)])


def rows_of(head: int, shape: Shape) -> slice:
    """The rows of ``inner`` that take what a head gathers."""
    return slice(shape.width + head * shape.value, shape.width + (head + 1) * shape.value)


def prepared(p: dict[str, np.ndarray], shape: Shape) -> tuple[np.ndarray, Tables]:
    """What ``forward`` needs of weights that stay: exp of the mask, and the tables."""
    return np.exp(causal(p["bias"], shape)), tables(p, shape)


def forward(p: dict[str, np.ndarray], seen: np.ndarray, known: np.ndarray, shape: Shape, ready=None, keep: bool = False):
    """The hidden layer for each scored place of ``seen`` (windows x span), and the symbol before it.

    ``known`` is False at places that must not be seen; ``ready``: what ``prepared`` gives, if made before. With ``keep``, also what ``backward`` needs.
    What a head gathers is linear in the values, so these are brought to the hidden layer once for each symbol, not for each place.
    """
    s, n = shape, len(seen)
    mask, made = ready or prepared(p, s)
    last, past = seen[:, s.context - 1:-1], np.where(known[:, :-1], seen[:, :-1], s.symbols + 1)
    hidden, kept = made.first.take(last, axis=0), []
    for h, (q, k, v) in enumerate(made.heads):
        query, key, value = q.take(last, axis=0), k.take(past, axis=0), v.take(past, axis=0)
        weights = np.matmul(query, key.transpose(0, 2, 1))
        np.exp(weights, out=weights)
        weights *= mask[h]
        found = np.matmul(weights, value)
        found[:, :, -1] += np.float32(1e-9)
        shares = 1 / found[:, :, -1:]
        found *= shares
        hidden += found[:, :, :-1]
        if keep:
            weights *= shares
            kept.append((weights, query, key, value[:, :, :-1], found[:, :, :-1]))
    hidden = np.maximum(hidden, 0, out=hidden).reshape(n * s.stride, -1)
    return hidden, last.ravel(), (last, past, known, hidden, made, kept)


class Priors(NamedTuple):
    """log P(symbol | the one before) and log P(its group | the one before)."""

    pairs: np.ndarray
    groups: np.ndarray


def priors(counts: np.ndarray, shape: Shape, weight: float = 5.0) -> Priors:
    """From counts of symbol pairs ((symbols + 1) x symbols), backed by how often a symbol occurs at all."""
    single = (counts.sum(axis=0) + 0.1) / (counts.sum() + 0.1 * shape.symbols)
    pairs = (counts + weight * single) / (counts.sum(axis=1, keepdims=True) + weight)
    groups = pairs.reshape(shape.symbols + 1, shape.groups, shape.group).sum(axis=2)
    return Priors(np.log(pairs).astype(np.float32), np.log(groups).astype(np.float32))


def log_likelihood(p: dict[str, np.ndarray], prior: Priors, hidden: np.ndarray, last: np.ndarray, target: np.ndarray,
                   shape: Shape, slopes: bool = False):
    """Natural logarithm of each target's probability; with ``slopes``, the slope of its negative by the layers.

    Corrections are small against the log probabilities they are added to, so no power overflows.
    """
    size, which = shape.group, target // shape.group
    every, ones = np.arange(len(target)), np.ones(max(size, shape.groups), hidden.dtype)
    logits = hidden @ p["first"]
    logits += prior.groups.take(last, axis=0)
    out = logits[every, which]
    np.exp(logits, out=logits)
    total = logits @ ones[:shape.groups]
    out -= np.log(total)
    # Tokens of one group lie one after another, so each group is one product. Small numbers are sorted by their bytes.
    order = np.argsort(which.astype(np.min_scalar_type(shape.groups)), kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=shape.groups))])
    inside = prior.pairs.reshape(-1, size).take(last[order] * shape.groups + which[order], axis=0)
    sorted_ = hidden.take(order, axis=0)
    for g in range(shape.groups):
        rows = slice(bounds[g], bounds[g + 1])
        inside[rows] += sorted_[rows] @ p["outer"][:, g * size:(g + 1) * size]
    place = target[order] % size
    picked = inside[every, place]
    np.exp(inside, out=inside)
    below = inside @ ones[:size]
    out[order] += picked - np.log(below)
    if not slopes:
        return out
    logits *= (1 / total)[:, None]
    logits[every, which] -= 1
    inside *= (1 / below)[:, None]
    inside[every, place] -= 1
    return out, logits, (order, bounds, sorted_, inside)


def summed(which: np.ndarray, change: np.ndarray, rows: int) -> np.ndarray:
    """``rows`` sums of those rows of ``change`` that have the same number in ``which``."""
    width = change.shape[-1]
    out = np.zeros(rows * width, change.dtype)
    # On flat arrays this costs less than sorting the rows and adding neighbours.
    np.add.at(out, (which.reshape(-1, 1) * width + np.arange(width)).ravel(), change.ravel())
    return out.reshape(rows, width)


def backward(p: dict[str, np.ndarray], shape: Shape, kept, first: np.ndarray, parts, share: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients, for the slopes that ``log_likelihood`` gives, each place weighted by its ``share``.

    Slopes are summed by symbol into the rows of ``Tables`` first, and from there to the weights.
    """
    s, size = shape, shape.group
    last, past, known, hidden, made, heads = kept
    order, bounds, sorted_, inside = parts
    n, width, embed = len(last), s.hidden + s.key, p["embed"]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    first = first * share[:, None]
    g["first"] = hidden.T @ first
    inside = inside * share[order, None]
    inner = np.empty_like(sorted_)
    for i in range(s.groups):
        rows, block = slice(bounds[i], bounds[i + 1]), slice(i * size, (i + 1) * size)
        g["outer"][:, block] = sorted_[rows].T @ inside[rows]
        np.matmul(inside[rows], p["outer"][:, block].T, out=inner[rows])
    back = np.empty_like(hidden)
    back[order] = inner
    back += first @ p["first"].T
    back *= hidden > 0
    back = back.reshape(n, s.stride, -1)
    ahead = (s.context + np.arange(s.stride) - 1)[:, None] - np.arange(s.span - 1)[None, :]
    of_last = np.empty((n, s.stride, s.hidden + s.heads * s.key), back.dtype)
    of_last[:, :, :s.hidden] = back
    of_past = np.empty((n, s.span - 1, s.heads * width), back.dtype)
    visible = known[:, None, :-1].astype(back.dtype)
    for h, (weights, query, key, value, found) in enumerate(heads):
        to_scores = np.matmul(back, value.transpose(0, 2, 1))
        to_scores -= np.einsum("nth,nth->nt", back, found)[:, :, None]
        to_scores *= weights
        to_scores *= visible
        own = of_past[:, :, h * width:(h + 1) * width]
        np.matmul(to_scores, key, out=of_last[:, :, s.hidden + h * s.key:s.hidden + (h + 1) * s.key])
        np.matmul(to_scores.transpose(0, 2, 1), query, out=own[:, :, :s.key])
        np.matmul(weights.transpose(0, 2, 1), back, out=own[:, :, s.key:])
        np.add.at(g["bias"][h], np.maximum(ahead, 0).ravel(), np.where(ahead >= 0, to_scores.sum(axis=0), 0).ravel())
    # What is not seen has no weights.
    by_last, by_past = summed(last, of_last, s.symbols + 1), summed(past, of_past, s.symbols + 2)[:-1]
    by_first = by_last[:, :s.hidden]
    g["offset"], g["inner"][:s.width] = by_first.sum(axis=0), embed.T @ by_first
    g["embed"] += by_first @ p["inner"][:s.width].T
    for h in range(s.heads):
        table = by_past[:, h * width + s.key:(h + 1) * width]
        g["inner"][rows_of(h, s)] = (embed @ p["values"][h]).T @ table
        # Queries are scaled.
        for name, table in (("query", by_last[:, s.hidden + h * s.key:s.hidden + (h + 1) * s.key] * np.float32(s.key ** -0.5)),
                            ("keys", by_past[:, h * width:h * width + s.key]), ("values", table @ p["inner"][rows_of(h, s)].T)):
            g[name][h] = embed.T @ table
            g["embed"] += table @ p[name][h].T
    return g


class Adam:
    """Weights ``p`` and the running means of their slopes; a step goes over some windows."""

    def __init__(self, p: dict[str, np.ndarray], prior: Priors, shape: Shape):
        self.p, self.prior, self.shape, self.steps = {k: v.copy() for k, v in p.items()}, prior, shape, 0
        self.one, self.two = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, seen: np.ndarray, known: np.ndarray, rate: float) -> None:
        """What is not ``known`` is neither seen nor scored; the first steps are short."""
        p, one, two, shape = self.p, self.one, self.two, self.shape
        self.steps += 1
        hidden, last, kept = forward(p, seen, known, shape, keep=True)
        target = seen[:, shape.context:].ravel()
        real = known[:, shape.context:].ravel() & (target < shape.symbols)
        _, first, parts = log_likelihood(p, self.prior, hidden, last, np.where(real, target, 0), shape, slopes=True)
        share = (real / max(1, real.sum())).astype(np.float32)
        now = rate * min(1, self.steps / 20)
        now = np.float32(now / (1 - 0.9 ** self.steps))
        even = np.float32(1 / (1 - 0.99 ** self.steps))
        for name, slope in backward(p, shape, kept, first, parts, share).items():
            one[name] *= np.float32(0.9)
            one[name] += np.float32(0.1) * slope
            slope *= slope
            two[name] *= np.float32(0.99)
            two[name] += np.float32(0.01) * slope
            p[name] -= now * one[name] / (np.sqrt(two[name] * even) + np.float32(1e-8))


def train(seen: np.ndarray, known: np.ndarray, prior: Priors, shape: Shape, steps: int, batch: int = 96, rate: float = 6e-3,
          seed: int = 3) -> dict[str, np.ndarray]:
    """Adam on windows of symbols drawn at random."""
    adam, rng = Adam(start(shape, seed), prior, shape), np.random.default_rng(seed)
    for step in range(1, steps + 1 if len(seen) else 1):
        pick = rng.integers(0, len(seen), batch)
        adam.step(seen[pick], known[pick], rate * (1 - 0.9 * step / steps))
    return adam.p
