"""Similarities of many pairs of texts at once: a text of up to 64 characters is one machine word, longer ones go singly.

Every function takes different texts and two arrays of places in them, one entry a pair, and returns a value a pair: the same
as the function of that name in ``similarity`` has for the two texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

import numpy as np

from erspark.functions import similarity

Kernel = Callable[[Sequence[str], np.ndarray, np.ndarray], np.ndarray]
LANES, CELLS, WORD, TOKENS = 1 << 15, 1 << 22, 64, 8
ONE, ALL = np.uint64(1), np.uint64(2**64 - 1)


class Coded:
    """Texts as one array of character codes, and for each text a table of the places of each character, as bits."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.texts = texts
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, codes = np.unique(points, return_inverse=True)
        self.codes, self.n = codes.astype(np.int64), max(1, len(letters))
        self.start = np.cumsum(self.size) - self.size
        self.whole = np.where(self.size >= WORD, ALL, (ONE << np.minimum(self.size, WORD - 1).astype(np.uint64)) - ONE)

    def places(self, backwards: bool = False) -> np.ndarray:
        """Bit k of entry (text, character): the text has that character k places from its start, or from its end."""
        text = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(self.codes)) - self.start[text]
        at = self.size[text] - 1 - at if backwards else at
        fits = self.size[text] <= WORD
        table = np.zeros(len(self.size) * self.n, np.uint64)
        np.bitwise_or.at(table, text[fits] * self.n + self.codes[fits], ONE << at[fits].astype(np.uint64))
        return table


def _sliced(f: Callable[[Coded, np.ndarray, np.ndarray], np.ndarray], texts: Sequence[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``f`` of slices of the pairs, each over its own texts, so that tables stay small."""
    out = np.empty(len(x), np.float64)
    todo = [(at, min(at + LANES, len(x))) for at in range(0, len(x), LANES)]
    while todo:
        low, high = todo.pop()
        own, back = np.unique(np.concatenate((x[low:high], y[low:high])), return_inverse=True)
        coded = Coded([texts[k] for k in own])
        if len(own) * coded.n > CELLS and high - low > 1:
            todo += [(low, (low + high) // 2), ((low + high) // 2, high)]
        else:
            out[low:high] = f(coded, back[: high - low], back[high - low :])
    return out


def _singly(f: Callable[[str, str], float], c: Coded, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.fromiter((f(c.texts[i], c.texts[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)), np.float64, len(x))


def _by_length(c: Coded, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides of each pair, the shorter text first."""
    turn = c.size[x] > c.size[y]
    return np.where(turn, y, x), np.where(turn, x, y)


def _consume(c: Coded, table: np.ndarray, short: np.ndarray, at: np.ndarray, steps: np.ndarray, step: int = 1, each: Callable | None = None) -> np.ndarray:
    """Bits of ``short`` that no longest common subsequence with ``steps`` characters from ``at`` on needs; longest runs first."""
    free = np.full(len(short), ALL)
    row, falling = short * c.n, -steps
    for k in range(int(steps[0]) if len(steps) else 0):
        n = int(np.searchsorted(falling, -k, "left"))  # runs of more than k steps
        f = free[:n]
        hit = f & table[row[:n] + c.codes[at[:n] + step * k]]
        free[:n] = (f + hit) | (f - hit)
        if each:
            each(k + 1, n, free[:n])
    return free


def _common(c: Coded, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    short, long = _by_length(c, x, y)
    out = np.zeros(len(x), np.float64)
    wide = c.size[short] > WORD
    out[wide] = _singly(similarity.common_subsequence, c, short[wide], long[wide])
    narrow = np.flatnonzero(~wide)
    narrow = narrow[np.argsort(-c.size[long[narrow]], kind="stable")]
    s, t = short[narrow], long[narrow]
    free = _consume(c, c.places(), s, c.start[t], c.size[t])
    out[narrow] = c.size[s] - np.bitwise_count(free & c.whole[s])
    return out


def _ratio(c: Coded, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = c.size[x] + c.size[y]
    return np.where(total == 0, 100.0, 200.0 * _common(c, x, y) / np.maximum(total, 1))


def _partial(c: Coded, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One run over the longer text's start gives all windows there, one backwards those at its end, one more each window."""
    short, long = _by_length(c, x, y)
    out = np.where(c.size[short] == 0, np.where(c.size[long] == 0, 100.0, 0.0), 0.0)
    wide = c.size[short] > WORD
    out[wide] = _singly(similarity.partial_of, c, short[wide], long[wide])
    narrow = np.flatnonzero(~wide & (c.size[short] > 0))
    narrow = narrow[np.argsort(-c.size[short[narrow]], kind="stable")]
    s, t = short[narrow], long[narrow]
    size, best, table = c.size[s], np.zeros(len(narrow)), c.places()

    def take(k: int, n: int, free: np.ndarray) -> None:
        got = size[:n] - np.bitwise_count(free & c.whole[s[:n]])
        best[:n] = np.maximum(best[:n], 200.0 * got / (size[:n] + k))

    _consume(c, table, s, c.start[t], size, 1, take)
    _consume(c, c.places(True), s, c.start[t] + c.size[t] - 1, size, -1, take)
    inner = np.maximum(c.size[t] - size - 1, 0)  # windows that touch neither end
    ends = np.cumsum(inner)
    for low in range(0, int(ends[-1]) if len(ends) else 0, 8 * LANES):
        window = np.arange(low, min(low + 8 * LANES, int(ends[-1])))
        pair = np.searchsorted(ends, window, "right")
        at = c.start[t[pair]] + 1 + window - (ends - inner)[pair]
        free = _consume(c, table, s[pair], at, size[pair])
        got = size[pair] - np.bitwise_count(free & c.whole[s[pair]])
        np.maximum.at(best, pair, 200.0 * got / (2 * size[pair]))
    out[narrow] = best
    return out


def _jaro_winkler(c: Coded, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.where(x == y, 1.0, 0.0)
    some = (x != y) & (c.size[x] > 0) & (c.size[y] > 0)
    wide = some & ((c.size[x] > WORD) | (c.size[y] > WORD))
    out[wide] = _singly(similarity.jaro_winkler_of, c, x[wide], y[wide])
    narrow = np.flatnonzero(some & ~wide)
    narrow = narrow[np.argsort(-c.size[x[narrow]], kind="stable")]
    if not len(narrow):
        return out
    a, b = x[narrow], y[narrow]
    m, n, table = c.size[a], c.size[b], c.places()
    reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
    taken, mine = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    for k in range(int(m[0])):
        w = int(np.searchsorted(-m, -k, "left"))
        low, high = np.minimum(np.maximum(k - reach[:w], 0), WORD), np.minimum(k + reach[:w] + 1, WORD)
        window = np.where(high >= WORD, ALL, (ONE << np.minimum(high, WORD - 1).astype(np.uint64)) - ONE)
        window &= np.where(low >= WORD, np.uint64(0), ~((ONE << np.minimum(low, WORD - 1).astype(np.uint64)) - ONE))
        hit = table[b[:w] * c.n + c.codes[c.start[a[:w]] + k]] & window & ~taken[:w]
        hit &= ~hit + ONE  # the first place only
        taken[:w] |= hit
        mine[:w] |= (hit != 0).astype(np.uint64) << np.uint64(k)
    found = np.bitwise_count(mine).astype(np.int64)
    swaps = np.zeros(len(a), np.int64)
    theirs = taken.copy()
    left = mine.copy()
    for _ in range(int(found.max())):
        one, other = left & (~left + ONE), theirs & (~theirs + ONE)
        at = np.bitwise_count(one - ONE).astype(np.int64)
        live = one != 0
        code = c.codes[c.start[a] + np.where(live, at, 0)]
        swaps += live & ((table[b * c.n + code] & other) == 0)
        left ^= one
        theirs ^= other
    hits = np.maximum(found, 1)
    jaro = np.where(found > 0, (found / m + found / n + (found - swaps // 2) / hits) / 3, 0.0)
    same, prefix = np.ones(len(a), bool), np.zeros(len(a), np.int64)
    for k in range(4):
        same &= (m > k) & (n > k)
        same &= c.codes[c.start[a] + np.where(same, k, 0)] == c.codes[c.start[b] + np.where(same, k, 0)]
        prefix += same
    out[narrow] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return out


def _shared(sets: list[list[str]], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of x's and of y's first tokens, whether the other text has it."""
    ids: dict[str, int] = {}
    table = np.full((len(sets), TOKENS), -1, np.int64)
    for row, tokens in enumerate(sets):
        for k, t in enumerate(tokens[:TOKENS]):
            table[row, k] = ids.setdefault(t, len(ids))
    wide = max(1, min(TOKENS, max(map(len, sets), default=1)))
    a, b = table[x, :wide], table[y, :wide]
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
    return same.any(2), same.any(1)


def _token_set(c: Coded, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The shared tokens begin both sides, so only what they do not share is compared."""
    sets = [sorted(set(t.split())) for t in c.texts]
    n = np.array([len(s) for s in sets])
    out = np.zeros(len(x), np.float64)
    wide = (n[x] > TOKENS) | (n[y] > TOKENS)
    out[wide] = _singly(similarity.token_set_of, c, x[wide], y[wide])
    narrow = np.flatnonzero(~wide & (n[x] > 0) & (n[y] > 0))
    x, y = x[narrow], y[narrow]
    in_x, in_y = _shared(sets, x, y)
    bits = 1 << np.arange(in_x.shape[1])
    rests: dict[str, int] = {}

    def rest(text: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Places in ``rests`` of the texts without shared tokens."""
        kinds, back = np.unique(text * 2**TOKENS + (shared * bits).sum(1), return_inverse=True)
        said = (" ".join(t for k, t in enumerate(sets[v >> TOKENS]) if not v >> k & 1) for v in kinds.tolist())
        return np.fromiter((rests.setdefault(s, len(rests)) for s in said), np.int64, len(kinds))[back]

    p, q = rest(x, in_x), rest(y, in_y)
    size = np.fromiter(map(len, rests), np.int64, len(rests))
    lengths = np.array([[len(t) for t in s[:TOKENS]] + [0] * (TOKENS - len(s)) for s in sets])[:, : in_x.shape[1]]
    n_both = in_x.sum(1)
    both = (lengths[x] * in_x).sum(1) + np.maximum(n_both - 1, 0)
    gap = (n_both > 0).astype(np.int64)  # the space between
    left, right = both + gap + size[p], both + gap + size[q]
    pairs, back = np.unique(p * max(1, len(rests)) + q, return_inverse=True)
    common = _sliced(_common, list(rests), pairs // max(1, len(rests)), pairs % max(1, len(rests)))[back]
    best = 200.0 * (both + gap + common) / np.maximum(left + right, 1)
    for side in (left, right):
        best = np.maximum(best, np.where(n_both > 0, 200.0 * both / (both + side), 0.0))
    out[narrow] = np.where((n_both > 0) & ((size[p] == 0) | (size[q] == 0)), 100.0, best)
    return out


def _jaccard(c: Coded, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    sets = [sorted(set(t.split("\n"))) if t else [] for t in c.texts]
    n = np.array([len(s) for s in sets])
    both = _shared(sets, x, y)[0].sum(1).astype(np.float64)
    wide = (n[x] > TOKENS) | (n[y] > TOKENS)
    both[wide] = [len({*sets[i]} & {*sets[j]}) for i, j in zip(x[wide].tolist(), y[wide].tolist(), strict=True)]
    return both / np.maximum(n[x] + n[y] - both, 1)


ratio: Kernel = partial(_sliced, _ratio)
partial_ratio: Kernel = partial(_sliced, _partial)
jaro_winkler: Kernel = partial(_sliced, _jaro_winkler)
token_set_ratio: Kernel = partial(_sliced, _token_set)
jaccard: Kernel = partial(_sliced, _jaccard)


def equal(texts: Sequence[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 for equal texts that are not empty."""
    return ((x == y) & np.array([t != "" for t in texts])[x]).astype(np.float64)


def acronym_match(texts: Sequence[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 where the acronym of either text is the other name; a text is an acronym, a space and the name without spaces."""
    ids: dict[str, int] = {"": -1}
    short, name = (np.array([ids.setdefault(t.split(" ")[k], len(ids)) for t in texts]) for k in (0, 1))
    return (((short[x] >= 0) & (short[x] == name[y])) | ((short[y] >= 0) & (short[y] == name[x]))).astype(np.float64)


def of_lists(kernel: Kernel, a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``kernel`` of two lists of texts, one pair after another."""
    ids: dict[str, int] = {}
    x, y = (np.fromiter((ids.setdefault(t, len(ids)) for t in side), np.int64, len(side)) for side in (a, b))
    return kernel(list(ids), x, y)


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds doubles: half up, by their decimal digits."""
    kinds, back = np.unique(values, return_inverse=True)
    unit = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in kinds.tolist()])[back]
