"""Hidden Markov decoding of state paths, window by window, in Arrow batches.

A window is one row (its probabilities and bases); windows are decoded where they are
read and never shuffled. All scores are logs in 32 bits, rebased at every step.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import cut
from .topology import NEXT

N, ABSENT = 20, -1000.0
#: Mean lengths of exons, introns, intergenic stretches and UTR exons, in bases.
LENGTHS = {"exon": 200, "intron": 4500, "intergenic": 10_000, "utr": 60}
#: Shares of genes that begin without a 5' UTR, and of stops that lead into a 3' UTR.
DIRECT_START, INTO_UTR = 0.1, 0.9
#: Splice and codon patterns (N any base) with their probabilities.
START = {"ATG": 1.0}
STOP = {"TAG": 0.34, "TAA": 0.33, "TGA": 0.33}
DONOR = {"NGT": 0.99, "NGC": 0.005, "NAT": 0.005}
ACCEPTOR = {"AGN": 0.99, "ACN": 0.01}


@lru_cache
def transitions() -> np.ndarray:
    """(20, 20) transition probabilities of the legal steps, rows adding up to 1."""
    t = np.zeros((N, N))
    for a, after in NEXT.items():
        t[a, list(after)] = 1 / len(after)
    out = 1 / LENGTHS["intergenic"]
    t[0, [0, 7, 15]] = 1 - out, out * DIRECT_START, out * (1 - DIRECT_START)
    for intron, back in ((1, 11), (2, 12), (3, 13), (18, 19)):
        t[intron, [intron, back]] = 1 - 1 / LENGTHS["intron"], 1 / LENGTHS["intron"]
    for exon, on, splice in ((4, 5, 8), (6, 4, 10)):
        t[exon, [on, splice]] = 1 - 1 / LENGTHS["exon"], 1 / LENGTHS["exon"]
    e = 1 / LENGTHS["exon"]
    t[5, [6, 9, 14]] = 1 - 2 * e, e, e
    t[14, [0, 16]] = 1 - INTO_UTR, INTO_UTR
    u = 1 / LENGTHS["utr"]
    t[15, [15, 7, 17]] = 1 - u, u / 2, u / 2
    t[16, [16, 0, 17]] = 1 - u, u / 2, u / 2
    return t / t.sum(axis=1, keepdims=True)


def log_or_absent(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.log(np.maximum(x, np.finfo(np.float32).tiny)), ABSENT).astype(np.float32)


def codon_table(patterns: dict[str, float]) -> np.ndarray:
    """(4, 4, 4) probabilities of codons; a pattern's weight is shared by the codons it stands for."""
    out = np.zeros((4, 4, 4))
    for pattern, p in patterns.items():
        hits = list(product(*[range(4) if c == "N" else ["ACGT".index(c)] for c in pattern]))
        for h in hits:
            out[h] += p / len(hits)
    return out


_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]


def base_codes(bases: str, width: int) -> np.ndarray:
    """0 to 3 for ACGT in either case; 4 for other bases and for what is missing."""
    out = np.full(width, 4, np.uint8)
    known = _CODE[np.frombuffer(bases.encode("ascii", "replace"), np.uint8)[:width]]
    out[: len(known)] = known
    return out


def _with_unknown(table: np.ndarray) -> np.ndarray:
    """(5, 5, 5): a codon table in which an unknown base counts as a quarter of each."""
    w = np.concatenate([np.eye(4), np.full((1, 4), 0.25)])
    return np.einsum("ia,jb,kc,abc->ijk", w, w, w, table)


@lru_cache
def _codon_scores() -> dict[str, np.ndarray]:
    coding = np.full((4, 4, 4), 1 / 61)
    for stop in STOP:
        coding[tuple("ACGT".index(c) for c in stop)] = 0
    tables = {"start": codon_table(START), "stop": codon_table(STOP), "donor": codon_table(DONOR), "acceptor": codon_table(ACCEPTOR), "coding": coding}
    return {name: _with_unknown(t) for name, t in tables.items()}


def codon_terms(codes: np.ndarray) -> np.ndarray:
    """(..., width, 20) codon and splice factors of the states, from the base codes beside each position."""
    beside = np.pad(codes, [(0, 0)] * (codes.ndim - 1) + [(2, 2)], constant_values=4)
    width = codes.shape[-1]

    def score(name, shift):
        return _codon_scores()[name][tuple(beside[..., shift + k : shift + k + width] for k in range(3))]

    out = np.full((*codes.shape, N), 1 / 64)
    coding = score("coding", 0)
    out[..., 7] = score("start", 2)
    out[..., 8:11] = score("donor", 2)[..., None]
    out[..., 14] = score("stop", 0)
    out[..., 11:14] = score("acceptor", 0)[..., None]
    out[..., 6] = coding
    out[..., 9] *= 64 * coding  # a donor on its left, no stop codon on its right
    return out


def _sources(steps: np.ndarray) -> np.ndarray:
    """(q, k) the states from which each state can be reached, lowest first, filled up with q."""
    found = [np.flatnonzero(steps[:, j]) for j in range(steps.shape[1])]
    out = np.full((len(found), max(1, *map(len, found))), len(steps))
    for j, f in enumerate(found):
        out[j, : len(f)] = f
    return out


def _best_step(v: np.ndarray, sources: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of v (q + 1, B; the last row never wins) the best value at each state and where it comes from
    (ties: the lowest source). weights: (q, k, 1) or (q, k, B)."""
    best, at = v[sources[:, 0]] + weights[:, 0], np.zeros((len(sources), v.shape[1]), np.uint8)
    for k in range(1, sources.shape[1]):
        other = v[sources[:, k]] + weights[:, k]
        better = other > best
        best = np.where(better, other, best)
        at[better] = k
    return best, at


def _traced(last: np.ndarray, back: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """(B, L) the states on the best way to ``last`` (B), by back (L, q, B)."""
    rows = np.arange(len(last))
    path = np.empty((len(last), len(back)), np.int64)
    for t in range(len(back) - 1, -1, -1):
        path[:, t] = last
        last = sources[last, back[t, last, rows]]
    return path


def viterbi(scores: np.ndarray, steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best paths of a batch: scores (B, L, q), steps (q, q), first (q). Ties go to the lowest state.

    Only steps that aren't absent are tried, but for rows in which an absent one may be the best."""
    return best_paths(lambda t: scores[:, t].T, scores.shape[:2], steps, first, scores.dtype)


def search_order(steps: np.ndarray) -> np.ndarray:
    """The states, those that can be reached from many others first."""
    found = _sources(steps > ABSENT)
    return np.argsort(-(found < len(steps)).sum(axis=1), kind="stable")


def best_paths(
    column: Callable[[int], np.ndarray], shape: tuple[int, int], steps: np.ndarray, first: np.ndarray, dtype: np.dtype, lengths: np.ndarray | None = None, ordered: bool = False, lazy: bool = True
) -> np.ndarray:
    """viterbi() of scores of a ``shape`` (B, L), of which column(t) gives those (q, B) of a position, its rows in search_order() if
    ``ordered``. first: (q) or (B, q).

    lengths (B), none above the one before it: where rows end; column(t) then has only the rows that go on at t, and
    paths are zero beyond their ends. ``lazy``: rows that take an absent step are decoded a second time, so that no others pay for these."""
    b, length, q = *shape, len(steps)
    lengths = np.full(b, length) if lengths is None else np.asarray(lengths)
    found, order = _sources(steps > ABSENT), search_order(steps)  # in this order states with a k-th source are a slice
    place = np.append(np.argsort(order), q)
    sources, kind = place[found[order]], np.result_type(steps, first, dtype)
    weights = np.concatenate([steps, np.full((1, q), -np.inf, steps.dtype)])[found[order], order[:, None]].astype(kind)[:, :, None]
    counts = (sources < q).sum(axis=0).tolist()
    slots = np.cumsum([0, *counts[1:]]).tolist()
    tries = [(sources[:n, k].copy(), weights[:n, k].copy(), n, slice(*slots[k - 1 : k + 1])) for k, n in enumerate(counts) if k]
    scores = column if ordered else lambda t: column(t)[order]
    # the best state before a step counts 0, so where all absent steps weigh ABSENT and one of them may be the best, it makes exactly that;
    # from which state is looked for only in rows whose path takes such a step
    alike = lazy and bool((steps[steps <= ABSENT] == ABSENT).all())
    dense: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    v = np.full((q + 1, b), -np.inf, kind)  # the last row never wins
    np.add(np.atleast_2d(first).T[order], scores(0), out=v[:q])
    last, backs, begun = np.empty(b, np.int64), [], 1
    for end in np.unique(lengths).tolist():  # stretches of positions that the same rows have
        b = int((lengths >= end).sum())
        v = np.ascontiguousarray(v[:, :b])
        live, best, top = v[:q], np.empty((q, b), kind), np.empty(b, kind)
        others, heads = [np.empty((n, b), kind) for _, _, n, _ in tries], [best[:n] for _, _, n, _ in tries]
        won = np.zeros((end - begun, slots[-1], b), bool)  # is the k-th source of a state better than those before it?
        lows = np.empty((end - begun if alike else 1, q, b), bool)
        head, added, upright = sources[:, 0].copy(), weights[:, 0].copy(), place[:q, None]
        for t in range(begun, end):
            np.maximum.reduce(live, axis=0, out=top)
            np.subtract(live, top, out=live)
            v.take(head, axis=0, out=best, mode="clip")
            np.add(best, added, out=best)
            here = won[t - begun]
            for (source, weight, _, own), other, so_far in zip(tries, others, heads):  # noqa: B905
                v.take(source, axis=0, out=other, mode="clip")
                np.add(other, weight, out=other)
                np.greater(other, so_far, out=here[own])
                np.maximum(so_far, other, out=so_far)
            low = lows[t - begun if alike else 0]
            np.less_equal(best, ABSENT, out=low)
            if alike:
                np.maximum(best, ABSENT, out=best)
            elif low.any():
                nth, row = low.nonzero()
                reach = v[upright, row] + steps.take(order.take(nth), axis=1)
                best[nth, row] = reach.max(axis=0)
                dense[t] = nth, row, reach.argmax(axis=0)
            np.add(best, scores(t), out=live)
        backs.append((begun, won, lows))
        last[:b] = live[place[:q]].argmax(axis=0)  # stands where the rows end here, else is written again
        begun = end
    # of each place and each set of its sources that were better: where the last of these is; places with fewer sources look at a slot of others, which doesn't count
    slot = np.array([[slots[k - 1] + r if r < counts[k] else 0 for r in range(q)] for k in range(1, len(counts))]).reshape(-1, q)
    source = np.empty((q, 1 << len(slot)), np.intp)
    for r, mask in np.ndindex(source.shape):
        source[r, mask] = sources[r, max([k for k in range(1, len(counts)) if mask >> (k - 1) & 1 and r < counts[k]], default=0)]
    source, bits = source.ravel(), len(slot)
    path, at, absent = np.zeros((length, len(lengths)), np.uint8), place[last[:0]], np.zeros(len(lengths), bool)
    for begun, won, lows in reversed(backs):
        n, b = len(won), won.shape[2]
        at = np.concatenate([at, place[last[len(at) : b]]])
        rows, size, flat = np.arange(b), won.shape[1] * b, won.reshape(-1).view(np.uint8)
        starts, low = [x * b for x in slot], lows.reshape(-1)
        for t in range(begun + n - 1, begun - 1, -1):
            path[t, :b] = at
            mask, base = at << bits, rows + (t - begun) * size
            for k, x in enumerate(starts):
                mask += flat.take(x.take(at) + base).astype(np.intp) << k
            before = source.take(mask)
            if alike:
                absent[:b] |= low.take(at * b + (rows + (t - begun) * q * b))
            elif t in dense:
                nth, row, reached = dense[t]
                through = at.take(row) == nth
                before[row[through]] = place[reached[through]]
            at = before
    path[0] = at
    path = np.append(order, 0).astype(np.uint8).take(path).T
    path = np.ascontiguousarray(path).astype(np.int64)
    if len(backs) > 1:
        path[np.arange(length) >= lengths[:, None]] = 0
    again = np.flatnonzero(absent)
    if len(again):
        own = lambda t: column(t)[:, again[lengths[again] > t]]
        path[again] = best_paths(own, (len(again), length), steps, first if first.ndim == 1 else first[again], dtype, lengths[again], ordered, False)
    return path


def posterior(scores: np.ndarray, steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(B, L, q) state probabilities by forward-backward with scaling."""
    e, t, b = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(steps), np.ones_like(scores, np.float64)
    a = np.empty_like(b)
    a[:, 0] = np.exp(first) * e[:, 0]
    for i in range(scores.shape[1]):
        if i:
            a[:, i] = (a[:, i - 1] @ t) * e[:, i]
        a[:, i] /= a[:, i].sum(axis=1, keepdims=True)
    for i in range(scores.shape[1] - 2, -1, -1):
        b[:, i] = (e[:, i + 1] * b[:, i + 1]) @ t.T
        b[:, i] /= b[:, i].sum(axis=1, keepdims=True)
    out = a * b
    return out / out.sum(axis=2, keepdims=True)


#: Codon position that each coding state completes (1 to 3), and the introns that carry a prefix on.
POSITION = {4: 1, 7: 1, 10: 1, 12: 1, 5: 2, 8: 2, 13: 2, 6: 3, 9: 3, 11: 3, 14: 3}
CARRY = {3: 1, 1: 2}
SIDED = (17, 18, 19)


@lru_cache
def expanded(stops: tuple[str, ...] = ("TAA", "TAG", "TGA")) -> tuple[list[tuple[int, str]], np.ndarray, np.ndarray]:
    """States with memory: nodes, allowed (5 bases, nodes, nodes) and initial nodes.

    Memory is the part of a stop codon that the open codon spells so far (if any), carried
    through introns, or the UTR side of a UTR intron. A step that would complete a stop
    codon before the stop state isn't allowed; nor is leaving a UTR intron to the other
    side. Base 4 is unknown and never spells a stop."""
    begun = {k: {""} | {s[:k] for s in stops} for k in (1, 2)}
    nodes = [(s, m) for s in range(N) for m in sorted(begun[POSITION.get(s) or CARRY[s]] if (POSITION.get(s) or CARRY.get(s)) in (1, 2) else {"5", "3"} if s in SIDED else {""})]
    index = {n: i for i, n in enumerate(nodes)}
    allowed = np.zeros((5, len(nodes), len(nodes)), bool)

    def after(s, m, target, base):
        """The target's memory, or None if the step isn't allowed."""
        if target in SIDED:
            return {15: "5", 16: "3"}.get(s, m)
        if target in (15, 16) and s == 19:
            return "" if m == {15: "5", 16: "3"}[target] else None
        if target in CARRY:
            return m
        k = POSITION.get(target)
        if k is None or target == 14:
            return ""
        spelled = ("" if k == 1 else m if len(m) == k - 1 else "?") + "ACGTN"[base]
        if k == 3:
            return None if spelled in stops else ""
        return spelled if spelled in begun[k] else ""

    for (s, m), base in product(nodes, range(5)):
        for target in NEXT[s]:
            to = after(s, m, target, base)
            if to is not None:
                allowed[base, index[s, m], index[target, to]] = True
    # a window may begin inside a codon or UTR intron of unknown past
    initial = np.array([[m == (("ACGTN"[b]) if POSITION.get(s) == 1 and "ACGTN"[b] in begun[1] else "") or s in SIDED for s, m in nodes] for b in range(5)])
    return nodes, allowed, initial


#: The non-coding reading that short frames compete with: UTR states whose side doesn't bind, entered from and left
#: to intergenic. Its places, and which of them follow one another.
SILENT = (("exon5", 15), ("exon3", 16), ("donor5", 17), ("intron5", 18), ("acceptor5", 19), ("donor3", 17), ("intron3", 18), ("acceptor3", 19))
SILENT_STEPS = (
    "exon5 exon5, exon5 donor5, donor5 intron5, intron5 intron5, intron5 acceptor5, acceptor5 exon5, acceptor5 exon3, exon5 exon3, "
    "exon3 exon3, exon3 donor3, donor3 intron3, intron3 intron3, intron3 acceptor3, acceptor3 exon3"
)


@lru_cache
def graph(silent: bool = False):
    """labels (n), initial (5 bases, n), sources (n, k), weights (5, n, k; -inf where a step isn't allowed),
    shown (n) and own (n): the automaton of expanded(), with the non-coding reading if ``silent``.
    shown is the state a place stands for in the result; own is false for the places of that reading."""
    nodes, allowed, initial = expanded()
    labels = np.array([s for s, _ in nodes])
    shown, own = labels, np.ones(len(labels), bool)
    if silent:
        place = {name: len(labels) + i for i, (name, _) in enumerate(SILENT)}
        between = nodes.index((0, ""))
        labels = np.append(labels, [s for _, s in SILENT])
        shown, own = np.append(shown, np.zeros(len(SILENT), int)), np.append(own, np.zeros(len(SILENT), bool))
        initial = np.pad(initial, ((0, 0), (0, len(SILENT))), constant_values=True)
        allowed = np.pad(allowed, ((0, 0), (0, len(SILENT)), (0, len(SILENT))))
        for step in SILENT_STEPS.split(", "):
            a, b = (place[x] for x in step.split())
            allowed[:, a, b] = True
        allowed[:, between, place["exon5"]] = allowed[:, place["exon3"], between] = True
    sources = _sources(allowed.any(axis=0))
    steps = np.where(allowed, log_or_absent(transitions())[np.ix_(labels, labels)], -np.inf)
    steps = np.concatenate([steps, np.full((5, 1, len(labels)), -np.inf)], axis=1).astype(np.float32)
    weights = steps[:, sources, np.arange(len(labels))[:, None]]
    return labels, initial, sources, weights, shown, own


@lru_cache
def walks() -> tuple[np.ndarray, np.ndarray]:
    """start (5 bases, 20 states, k) and after (nodes + 1, 20 states, 5 bases): the nodes of expanded() in which a path may begin,
    and the one node to which a state leads on; the last node stands for none."""
    nodes, allowed, initial = expanded()
    none = len(nodes)
    states = np.array([s for s, _ in nodes])
    begun = [[np.flatnonzero(initial[base] & (states == s)) for s in range(N)] for base in range(5)]
    start = np.full((5, N, max(len(x) for row in begun for x in row)), none)
    for base, s in product(range(5), range(N)):
        start[base, s, : len(begun[base][s])] = begun[base][s]
    after = np.full((none + 1, N, 5), none)
    for base, a, b in np.argwhere(allowed).tolist():
        after[a, states[b], base] = b
    return start, after


def legal_paths(paths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which of the paths (B, L) over base codes (B, L) keep to legal steps, with codon and UTR memory?
    The memory follows from the states, so each path is one walk from each node that it may begin in."""
    b, length = paths.shape
    if not length:
        return np.ones(b, bool)
    start, after = walks()
    node = start[codes[:, 0], paths[:, 0]].T
    table, width = after.ravel(), N * 5
    steps = np.ascontiguousarray((paths * 5 + codes).T)
    for t in range(1, length):
        node = table[node * width + steps[t]]
    return (node < len(after) - 1).any(axis=0)


def is_legal(path: np.ndarray, bases: str) -> bool:
    """Are all steps of a path legal, with codon and UTR memory?"""
    return bool(legal_paths(path[None], base_codes(bases, len(path))[None])[0])


def constrained_paths(scores: np.ndarray, codes: np.ndarray, fixed: np.ndarray | None = None, silent: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Best legal paths (B, L) of scores (B, L, 20) over base codes (B, L), and which rows have one.

    fixed (B, L) holds the states that a path must have at its positions, -1 where it is free. With
    ``silent`` the non-coding reading takes part wherever a path is free; it counts as intergenic."""
    labels, initial, sources, weights, shown, own = graph(silent)
    b, length, _ = scores.shape
    back = np.zeros((length, len(labels), b), np.uint8)
    table = np.ascontiguousarray(weights.transpose(1, 2, 0))
    v = np.full((len(labels) + 1, b), -np.inf, np.float32)

    def reached(t, best):
        best = best + scores[:, t].T[labels]
        if fixed is not None:
            kept = fixed[:, t]
            best[((labels[:, None] != kept) | ~own[:, None]) & (kept >= 0)] = -np.inf
        return best

    v[:-1] = reached(0, np.where(initial[codes[:, 0]].T, np.float32(0), np.float32(-np.inf)))
    for t in range(1, length):
        top = v.max(axis=0)
        v -= np.where(np.isfinite(top), top, 0)
        best, back[t] = _best_step(v, sources, table[:, :, codes[:, t]])
        v[:-1] = reached(t, best)
    ends = v[:-1]
    path = _traced(ends.argmax(axis=0), back, np.minimum(sources, len(labels) - 1))
    return shown[path], np.isfinite(ends.max(axis=0))


def constrained_viterbi(scores: np.ndarray, bases: str, anchors: dict[int, int] | None = None) -> np.ndarray:
    """Best legal path of one window (L, 20) under the memory constraints; ``anchors`` fixes
    states at positions. Raises if no path is legal."""
    fixed = np.full((1, len(scores)), -1)
    for at, state in (anchors or {}).items():
        fixed[0, at] = state
    paths, found = constrained_paths(scores[None], base_codes(bases, len(scores))[None], fixed)
    if not found[0]:
        raise ValueError("no legal path through this window")
    return paths[0]


def emissions(probs: np.ndarray, bases: str | np.ndarray | None, smoothing: float = 0.01) -> np.ndarray:
    """Log emission scores (..., L, 20): smoothed class probabilities times codon terms (bases as text or codes)."""
    kernel = np.full((N, N), smoothing / (N - 1))
    np.fill_diagonal(kernel, 1 - smoothing)
    out = probs @ kernel.T
    if bases is None:
        return log_or_absent(out)
    return log_or_absent(out * codon_terms(base_codes(bases, len(probs)) if isinstance(bases, str) else bases))


#: The coding bases below which a complete frame is short (a fixed value).
SHORT = 60


def stretches(on: np.ndarray) -> np.ndarray:
    """(n, 2) first and end of the runs of true values."""
    return np.flatnonzero(np.diff(np.pad(on.astype(np.int8), 1))).reshape(-1, 2)


def coding_frames(path: np.ndarray):
    """Every genic stretch with coding bases: first, end, and whether it is a complete frame of
    fewer than SHORT coding bases."""
    coding, heads, stops = (np.concatenate(([0], np.cumsum(x))) for x in ((path >= 4) & (path <= 14), path == 7, path == 14))
    for a, b in stretches(path != 0).tolist():
        n = coding[b] - coding[a]
        if n:
            yield a, b, bool(n < SHORT and heads[b] - heads[a] == 1 == stops[b] - stops[a])


def short_frames(path: np.ndarray) -> tuple[bool, np.ndarray]:
    """Is there a short complete frame, and which positions belong to the other coding
    stretches, which a second decoding must leave as they are?"""
    frames = list(coding_frames(path))
    protected = np.zeros(len(path), bool)
    for a, b, short in frames:
        protected[a:b] |= not short
    return any(short for *_, short in frames), protected


def repaired_paths(scores: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Best legal paths. Where one has short complete frames, it is decoded again with the non-coding reading
    beside the model's own, while all its other coding stretches stay as they are."""
    paths, found = constrained_paths(scores, codes)
    if not found.all():
        raise ValueError("no legal path through a window")
    short, protected = zip(*map(short_frames, paths), strict=True)
    again = np.flatnonzero(short)
    if len(again):
        fixed = np.where(np.array(protected)[again], paths[again], -1)
        paths[again], _ = constrained_paths(scores[again], codes[again], fixed, silent=True)
    return paths


#: Windows of one length that are decoded side by side, and positions of all of them together.
TOGETHER, POSITIONS = 256, 400_000
#: Partitions among which sequences are dealt for each shuffle partition: decoding takes far more time than its bytes suggest.
DEALT = 2


def side_by_side(sizes: list[int], together: int = TOGETHER, positions: int = POSITIONS):
    """Index lists of windows of one length above zero, few enough to be held together."""
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        by_length.setdefault(n, []).append(i)
    for n, part in by_length.items():
        most = max(1, min(together, positions // max(n, 1)))
        step = -(-len(part) // -(-len(part) // most))  # about equally many in each: a few rows take nearly the time of many
        yield from (part[i : i + step] for i in range(0, len(part) if n else 0, step))


def has_coding_signal(probs: np.ndarray, width: int = 200, least: float = 0.8) -> np.ndarray:
    """(B) has some frame of ``width`` positions (or the whole of a shorter window) of probs (B, L, 20) a mean
    probability of coding states of at least ``least``?"""
    coding = np.concatenate([np.zeros((len(probs), 1)), np.cumsum(probs[..., 4:15].sum(axis=-1), axis=1)], axis=1)
    width = min(width, probs.shape[1])
    return ((coding[:, width:] - coding[:, :-width]) / width >= least).any(axis=1)


def genic_slices(probs: np.ndarray, step: int = 50, mean: float = 0.1, above: float = 0.5, least: int = 50, buffer: int = 100) -> list[tuple[int, int]]:
    """Half-open stretches of a window (L, 20) that likely hold genes, as windows.genic_regions and
    intervals.expand_merge find them on positions; the whole window if there are none."""
    genic, size = probs[:, 1:].sum(axis=1), len(probs)
    heads = np.arange(0, size, step)
    if not len(heads):
        return []
    on = np.add.reduceat(genic, heads) / np.diff(np.append(heads, size)) >= mean
    high = np.add.reduceat((genic > above).astype(np.int64), heads)
    run = np.cumsum(~on) - ~on  # a bucket below the mean still belongs to the run that it ends
    found: list[list[int]] = []
    for r in np.unique(run[on]).tolist():
        own = np.flatnonzero(run == r)
        if high[own].sum() < least:
            continue
        start, end = max(0, int(heads[own[0]]) - buffer), min(size, int(heads[own[-1]]) + step + buffer)
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], end)
        else:
            found.append([start, end])
    return [tuple(x) for x in found] or [(0, size)]


def decoded(probs: np.ndarray, codes: np.ndarray | None, repair: bool = True, prefilter: bool = False, regions: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Paths (B, L) of windows of one length, and which were decoded again under the constraints.

    Every window takes its unconstrained best path; only those that break a memory rule take the
    best legal one. With ``prefilter`` windows without a coding signal are intergenic throughout; with
    ``regions`` only stretches that likely hold genes are decoded, each by itself, and the rest is intergenic."""
    paths, again = np.zeros(probs.shape[:2], np.int64), np.zeros(len(probs), bool)
    live = np.flatnonzero(has_coding_signal(probs)) if prefilter else np.arange(len(probs))
    if not len(live):
        return paths, again
    if regions:
        places = [(i, a, b) for i in live.tolist() for a, b in genic_slices(probs[i])]
        for same in side_by_side([b - a for _, a, b in places]):
            cut_out = lambda x: np.stack([x[places[k][0], places[k][1] : places[k][2]] for k in same])  # noqa: E731, B023
            own, redone = decoded(cut_out(probs), None if codes is None else cut_out(codes), repair)
            for k, path, done in zip(same, own, redone.tolist(), strict=True):
                i, a, b = places[k]
                paths[i, a:b], again[i] = path, again[i] or done
        return paths, again
    own = None if codes is None else codes[live]
    scores = emissions(probs[live], own)
    paths[live] = viterbi(scores, log_or_absent(transitions()), np.full(N, -np.log(N), np.float32))
    if repair and own is not None:
        bad = np.flatnonzero(~legal_paths(paths[live], own))
        if len(bad):
            paths[live[bad]], again[live[bad]] = repaired_paths(scores[bad], own[bad]), True
    return paths, again


#: Prior weights of the 20 states for motif_scorer: a frame without stop codons gains on intergenic with each base.
PRIOR = np.array([0.2] + [0.02] * 3 + [0.22] * 3 + [0.01] * 8 + [0.02] * 2 + [0.005, 0.02, 0.005])


def motif_scorer(codes: np.ndarray) -> np.ndarray:
    """(B, L, 20) class probabilities from the bases alone: PRIOR, raised at start and stop codons and splice
    sites and lowered where a motif is missing. A stand-in where no trained scorer's output is given."""
    out = PRIOR * (64 * codon_terms(codes) + 0.01)
    return out / out.sum(axis=-1, keepdims=True)


#: The bases on each side of a position that motif_scorer and codon_terms() look at.
BESIDE = 2
motif_scorer.beside = BESIDE
#: Windows of one length that are decoded side by side by contexts, and positions of all of them together.
MANY, MANY_POSITIONS = 1024, 2_400_000


@lru_cache
def context_scores(scorer: Callable) -> np.ndarray:
    """(20, 3125) emission scores of a position for each of the runs of five bases around it."""
    runs = np.array(list(product(range(5), repeat=2 * BESIDE + 1)), np.uint8)
    return np.ascontiguousarray(emissions(scorer(runs), runs)[:, BESIDE].T)


def decoded_by_context(codes: np.ndarray, scorer: Callable, repair: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """decoded() of windows (B, L) of base codes whose scorer sees no further than BESIDE bases: its scores are those of the
    bases around each position, so they are looked up and no probability is worked out."""
    table, (b, length) = context_scores(scorer), codes.shape
    beside = np.pad(codes, [(0, 0), (BESIDE, BESIDE)], constant_values=4).T.astype(np.intp)
    context = sum(beside[k : k + length] * 5 ** (2 * BESIDE - k) for k in range(2 * BESIDE + 1))
    steps, here = log_or_absent(transitions()), np.empty((N, b), table.dtype)
    placed = table[search_order(steps)]
    paths = best_paths(lambda t: placed.take(context[t], axis=1, out=here, mode="clip"), (b, length), steps, np.full(N, -np.log(N), np.float32), table.dtype, ordered=True)
    bad = np.flatnonzero(~legal_paths(paths, codes)) if repair else np.empty(0, int)
    for part in side_by_side([length] * len(bad)):
        rows = bad[part]
        paths[rows] = repaired_paths(table.T[context[:, rows].T], codes[rows])
    return paths, np.isin(np.arange(b), bad)


def _probabilities(column: pa.Array) -> list[np.ndarray]:
    """(length, 20) probabilities of each window of an Arrow column of lists, without a copy; none where it is null."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return [(values[a:b] if known else values[:0]).reshape(-1, N) for a, b, known in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]


def _lists(rows: list, dtype) -> pa.Array:
    """An Arrow column of lists."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(dtype) if len(rows) else np.empty(0, dtype)))


def _keys(keys: str) -> list:
    """The columns of a DDL list, in its types."""
    return [F.col(c.split()[0]).cast(c.split()[1]) for c in keys.split(",")]


def decode_windows(
    windows: DataFrame, keys: str, use_bases: bool = True, repair: bool = True, prefilter: bool = False, scorer: Callable | None = None, regions: bool = False,
    then: tuple[Callable, str] | None = None,
) -> DataFrame:
    """windows(keys..., p array<array<float>>, bases string in transcription order) -> keys,
    states array<int>, repaired boolean.

    keys: a DDL list of the columns to carry. Scores use the bases only with ``use_bases``; paths are
    repaired by them in any case, where a window has them. A window without probabilities has no states.
    prefilter and regions: see decoded().
    With a ``scorer``, a function from base codes (B, L) to probabilities (B, L, 20), p is not read: windows are
    scored where they are decoded and no probability is ever written or moved. With ``then``, a function from batches
    of what is decoded to other batches and the schema of these, the result is what it makes of them in the same task."""
    names = [c.split()[0] for c in keys.split(",")]
    by_context = getattr(scorer, "beside", BESIDE + 1) <= BESIDE and use_bases and not (prefilter or regions)
    bounds = (MANY, MANY_POSITIONS) if by_context else (TOGETHER, POSITIONS)

    def run(batches):
        for batch in batches:
            bases = batch.column("bases").to_pylist()
            if scorer is None:
                probs = _probabilities(batch.column("p"))
                sizes = [len(p) for p in probs]
            else:
                sizes = [len(b or "") for b in bases]
            out, fixed = [[]] * len(sizes), [False] * len(sizes)
            for same in side_by_side(sizes, *bounds):
                for known in (True, False):
                    own = [i for i in same if (bases[i] is not None) == known]
                    if not own:
                        continue
                    n = sizes[own[0]]
                    codes = np.stack([base_codes(bases[i], n) for i in own]) if known else None
                    if by_context:
                        for i, path, done in zip(own, *decoded_by_context(codes, scorer, repair), strict=True):
                            out[i], fixed[i] = path, bool(done)
                        continue
                    stack = np.stack([probs[i] for i in own]) if scorer is None else scorer(codes)
                    if use_bases or not known:
                        paths, again = decoded(stack, codes, repair, prefilter, regions)
                    else:
                        paths, again = decoded(stack, None, False, prefilter, regions)
                        bad = np.flatnonzero(~legal_paths(paths, codes)) if repair else []
                        if len(bad):
                            paths[bad], again[bad] = repaired_paths(emissions(stack[bad], None), codes[bad]), True
                    for i, path, done in zip(own, paths, again.tolist(), strict=True):
                        out[i], fixed[i] = path, done
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), _lists(out, np.int32), pa.array(fixed, pa.bool_())], [*names, "states", "repaired"])

    read = [*_keys(keys), "bases"] if scorer is not None else [*_keys(keys), F.flatten("p").alias("p"), "bases"]
    if then is None:
        return windows.select(*read).mapInArrow(run, f"{keys}, states array<int>, repaired boolean")
    return windows.select(*read).mapInArrow(lambda batches: then[0](run(batches)), then[1])


def posterior_windows(windows: DataFrame, keys: str, use_bases: bool = True) -> DataFrame:
    """windows(keys..., p, bases) -> keys, states array<int>, confidence array<float>: at each position the state
    that has the largest posterior probability over all paths (ties: the lowest), and that probability."""
    names = [c.split()[0] for c in keys.split(",")]

    def run(batches):
        steps, first = log_or_absent(transitions()), np.full(N, -np.log(N), np.float32)
        for batch in batches:
            probs, bases = _probabilities(batch.column("p")), batch.column("bases").to_pylist()
            states, sure = [[]] * len(probs), [[]] * len(probs)
            for same in side_by_side([len(p) for p in probs]):
                for known in (True, False):
                    own = [i for i in same if (use_bases and bases[i] is not None) == known]
                    if not own:
                        continue
                    codes = np.stack([base_codes(bases[i], len(probs[i])) for i in own]) if known else None
                    post = posterior(emissions(np.stack([probs[i] for i in own]), codes), steps, first)
                    for i, likeliest, top in zip(own, post.argmax(axis=2), post.max(axis=2), strict=True):
                        states[i], sure[i] = likeliest, top
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), _lists(states, np.int32), _lists(sure, np.float32)], [*names, "states", "confidence"])

    return windows.select(*_keys(keys), F.flatten("p").alias("p"), "bases").mapInArrow(run, f"{keys}, states array<int>, confidence array<float>")


# ---------------------------------------------------------------- whole sequences, in chunks


def chunk_matrices(scores: np.ndarray, steps: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """(B, q, q): for chunks (B, L, q), the best score from each state at the last position before the chunk,
    by the steps in ``entry`` (B, q, q), to each state at its end. These compose by sums and maxima, in any grouping."""
    b, length, q = scores.shape
    m = entry + scores[:, None, 0]
    sources = _sources(steps > ABSENT)
    weights = np.concatenate([steps, np.full((1, q), -np.inf)])[sources, np.arange(q)[:, None]]
    for t in range(1, length):
        best = m.max(axis=2, keepdims=True) + ABSENT  # what an absent step would give
        padded = np.concatenate([m, np.full((b, q, 1), -np.inf)], axis=2)
        for k in range(sources.shape[1]):
            best = np.maximum(best, padded[:, :, sources[:, k]] + weights[:, k])
        m = best + scores[:, None, t]
    return m


def border_states(matrices: np.ndarray) -> np.ndarray:
    """(C) the states at the ends of chunks (C, q, q) on the best path through all of them, with any state before the first."""
    v = matrices[0].max(axis=0)
    reached = [v - v.max()]
    for m in matrices[1:]:
        v = (reached[-1][:, None] + m).max(axis=0)
        reached.append(v - v.max())
    out = np.empty(len(matrices), np.int64)
    out[-1] = int(reached[-1].argmax())
    for c in range(len(matrices) - 1, 0, -1):
        out[c - 1] = int((reached[c - 1] + matrices[c][:, out[c]]).argmax())
    return out


#: Positions up to which a sequence is decoded as a whole; longer ones are decoded by the matrices of their chunks.
WHOLE = 20_000
#: Long sequences that may be broadcast.
BROADCAST_LONG = 1_000_000
#: Chunks whose border states may be broadcast; beyond it chunks and borders are shuffled.
BROADCAST_CHUNKS = 1_000_000


def chunk_scores(probs: list[np.ndarray], bases: list[str | None]):
    """Index lists of chunks of one length, and their scores (B, L, 20) in 64 bits."""
    for same in side_by_side([len(p) for p in probs]):
        for known in (True, False):
            own = [i for i in same if (bases[i] is not None) == known]
            if own:
                codes = np.stack([base_codes(bases[i], len(probs[i])) for i in own]) if known else None
                yield own, emissions(np.stack([probs[i] for i in own]), codes).astype(np.float64)


def whole_paths(sequences: list[tuple], steps: np.ndarray) -> list[list[np.ndarray]]:
    """Of sequences, each a list of (chunk, p, bases) in order, the paths of their chunks. Sequences are decoded
    side by side, the longest first, as many as hold POSITIONS together; they needn't be of one length."""
    sizes = [sum(len(p) for _, p, _ in parts) for parts in sequences]
    longest, out = sorted(range(len(sizes)), key=lambda i: -sizes[i]), [[]] * len(sizes)
    while longest:
        n = sizes[longest[0]]
        same = longest[: max(1, min(TOGETHER, POSITIONS // max(n, 1)))]
        longest = longest[len(same) :]
        parts = [part for i in same for part in sequences[i]]
        cells = [np.empty((0, N))] * len(parts)
        for own, scores in chunk_scores([p for _, p, _ in parts], [b for *_, b in parts]):
            for k, x in zip(own, scores, strict=True):
                cells[k] = x
        ends = np.cumsum([0, *(len(sequences[i]) for i in same)]).tolist()
        together, begun = np.zeros((n, len(same), N)), np.zeros((len(same), N))
        for j, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            together[: sizes[same[j]], j] = np.concatenate(cells[a:b])
            head = next((c for c, p, _ in parts[a:b] if len(p)), 0)
            begun[j] = steps.max(axis=0) if head else 0.0
        lengths = np.array([sizes[i] for i in same])
        some = lengths > 0
        live = np.array([(lengths > t).sum() for t in range(n)], int)
        paths = np.zeros((len(same), n), np.int64)
        if n:
            paths[some] = best_paths(lambda t: together[t, : live[t]].T, (int(some.sum()), n), steps, begun[some], np.float64, lengths[some])  # noqa: B023
        for j, i in enumerate(same):
            cuts = np.cumsum([0, *(len(p) for _, p, _ in sequences[i])]).tolist()
            out[i] = [paths[j, x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def decode_sequences(
    chunks: DataFrame, use_bases: bool = False, probabilities: Callable[[DataFrame], DataFrame] | None = None, shared: DataFrame | None = None
) -> DataFrame:
    """chunks(seq_name, chunk, p, bases), chunk counting from 0 along a sequence -> seq_name, chunk, states: the
    best path through the whole of each sequence, whatever its length. Chunks without positions have no states.

    The chunks of a sequence of up to WHOLE positions meet in one task, which decodes it as a whole. A longer one takes three
    steps: each chunk's matrix of best scores between its two borders, where the chunk is;
    one fold per sequence over the matrices (400 numbers a chunk), for the states at all borders; and each chunk's
    path between its own two border states, where the chunk is. Those chunks don't move while their borders
    are few enough to be broadcast. Where ``probabilities`` is given, it adds p to the chunks wherever they are decoded, so
    that chunks that move do so without it. Codon terms see no further than a chunk's own bases. Of equally good paths
    a longer sequence may have another than one decoding of the whole would take.

    ``shared``, rows (like, p) few enough for every task to have them all, holds what many chunks have in common: a chunk without p of its
    own has that of its column like. Neither p nor bases that aren't used then move, and a task decodes sequences that are alike throughout once."""
    rows = chunks.select("seq_name", F.col("chunk").cast("long").alias("chunk"), *(["p"] if probabilities is None else []), "bases", *([] if shared is None else ["like"]))
    size = F.length("bases") if probabilities is not None else F.when(F.col("p").isNotNull(), F.size("p"))
    table: dict = {}
    if shared is not None:
        shared = shared.select("like", F.flatten("p").cast("array<double>").alias("p"))
        table = {r.like: np.asarray(r.p or [], np.float64).reshape(-1, N) for r in shared.toLocalIterator()}
        size = F.coalesce(size, F.when(F.col("like").isNotNull(), F.lit(max(map(len, table.values()), default=0))))
        rows = cut(rows if use_bases else rows.withColumn("bases", F.lit(None).cast("string")))
    long = cut(rows.groupBy("seq_name").agg(F.sum(F.coalesce(size, F.lit(0)).cast("long")).alias("_n")).where(F.col("_n") > WHOLE).select("seq_name"))
    n = long.count()
    long = F.broadcast(long) if n <= BROADCAST_LONG else long
    short = _decoded_whole(rows.join(long, "seq_name", "left_anti"), use_bases, probabilities, table)
    if not n:
        return short
    if shared is not None:
        given = shared.select("like", F.transform("p", lambda x: F.array(x)).alias("_p"))
        probabilities = lambda df: df.join(F.broadcast(given), "like", "left").withColumn("p", F.coalesce("p", "_p"))
    return short.unionByName(_decoded_by_matrices(rows.join(long, "seq_name", "left_semi"), use_bases, probabilities))


def _scoring(df: DataFrame, probabilities: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    return (df if probabilities is None else probabilities(df)).withColumn("p", F.flatten("p").cast("array<double>"))


#: Positions of paths that a task keeps for sequences that are alike.
KEPT = 4_000_000


def _decoded_whole(rows: DataFrame, use_bases: bool, probabilities: Callable[[DataFrame], DataFrame] | None, table: dict[int, np.ndarray]) -> DataFrame:
    """decode_sequences() of sequences that are short enough for one task each. table: what is shared, by like."""
    kind = dict(rows.dtypes)["seq_name"]
    every = Window.partitionBy("seq_name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tasks = DEALT * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(tasks, "seq_name").withColumn("_n", F.count("*").over(every))

    def run(batches):
        steps, held, known, kept = log_or_absent(transitions()).astype(np.float64), {}, {}, 0
        for batch in batches:
            names, number, n = (batch.column(c).to_pylist() for c in ("seq_name", "chunk", "_n"))
            given, own = batch.column("p").is_valid().to_pylist(), _probabilities(batch.column("p"))
            like = batch.column("like").to_pylist() if table else [None] * len(names)
            like = [None if has else x for has, x in zip(given, like, strict=True)]
            probs = [own[i] if x is None else table.get(x, own[i]) for i, x in enumerate(like)]
            bases = batch.column("bases").to_pylist() if use_bases else [None] * len(names)
            done = []
            for name, most, *part in zip(names, n, number, probs, bases, like, strict=True):
                parts = held.setdefault(name, [])
                parts.append(part)
                if len(parts) == most:
                    done.append((name, sorted(held.pop(name), key=lambda x: x[0])))
            if kept > KEPT:
                known, kept = {}, 0
            alike = [tuple((c, x, b) for c, _, b, x in parts) if all(x is not None for *_, x in parts) else (None, name) for name, parts in done]
            fresh = {key: [part[:3] for part in parts] for key, (_, parts) in zip(alike, done, strict=True) if key not in known}
            paths = dict(zip(fresh, whole_paths(list(fresh.values()), steps), strict=True))
            own_states = _lists([x for key in alike for x in (paths[key] if key in paths else known[key])], np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array([name for name, parts in done for _ in parts], batch.schema.field("seq_name").type), pa.array([c for _, parts in done for c, *_ in parts], pa.int64()), own_states,
            ], ["seq_name", "chunk", "states"])
            for key, path in paths.items():
                if key[0] is not None:
                    known[key], kept = [x.astype(np.int8) for x in path], kept + sum(map(len, path))
            held = {name: [[c, p.copy() if x is None else p, b, x] for c, p, b, x in parts] for name, parts in held.items()}  # not views of a batch that goes

    read = ["seq_name", "chunk", "p", "bases", "_n"] + (["like"] if table else [])
    return _scoring(placed, probabilities).select(*read).mapInArrow(run, f"seq_name {kind}, chunk long, states array<int>")


def _decoded_by_matrices(rows: DataFrame, use_bases: bool, probabilities: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """decode_sequences() of sequences of any length."""
    kind = dict(rows.dtypes)["seq_name"]

    def scored(pdf):
        probs = [np.asarray([] if p is None else p, np.float64).reshape(-1, N) for p in pdf["p"]]
        yield from chunk_scores(probs, pdf["bases"].tolist() if use_bases else [None] * len(probs))

    def entries(state, chunk, steps):
        """Scores of the steps into a chunk from a state; where there is none, a free entry into the first chunk and any step into others."""
        return np.where((state < 0)[:, None], np.where((chunk == 0)[:, None], 0.0, steps.max(axis=0)), steps[state])

    def matrices(batches):
        steps = log_or_absent(transitions()).astype(np.float64)
        for pdf in batches:
            name, chunk = pdf["seq_name"].to_numpy(), pdf["chunk"].to_numpy()
            for same, scores in scored(pdf):
                entry = np.where((chunk[same] == 0)[:, None, None], 0.0, steps)
                yield pd.DataFrame({"seq_name": name[same], "chunk": chunk[same], "m": list(chunk_matrices(scores, steps, entry).reshape(len(same), -1))})

    def fold(pdf):
        pdf = pdf.sort_values("chunk")
        leave = border_states(np.stack(pdf["m"].to_numpy()).reshape(-1, N, N))
        return pd.DataFrame({"seq_name": pdf["seq_name"], "chunk": pdf["chunk"], "entry": np.append(-1, leave[:-1]), "leave": leave})

    def paths(batches):
        steps = log_or_absent(transitions()).astype(np.float64)
        for pdf in batches:
            states, ends, chunk = [[]] * len(pdf), pdf[["entry", "leave"]].to_numpy(), pdf["chunk"].to_numpy()
            for same, scores in scored(pdf):
                entry, leave = ends[same].astype(np.int64).T
                scores[np.arange(len(same)), -1] = np.where(np.arange(N) == leave[:, None], scores[:, -1], -np.inf)
                for i, path in zip(same, viterbi(scores, steps, entries(entry, chunk[same], steps)), strict=True):
                    states[i] = path
            yield pd.DataFrame({"seq_name": pdf["seq_name"], "chunk": pdf["chunk"], "states": states})

    found = _scoring(rows, probabilities).mapInPandas(matrices, f"seq_name {kind}, chunk long, m array<double>")
    borders = cut(found.groupBy("seq_name").applyInPandas(fold, f"seq_name {kind}, chunk long, entry long, leave long"))
    few = borders.count() <= BROADCAST_CHUNKS
    placed = rows.join(F.broadcast(borders) if few else borders, ["seq_name", "chunk"], "left")
    return _scoring(placed, probabilities).mapInPandas(paths, f"seq_name {kind}, chunk long, states array<int>")
