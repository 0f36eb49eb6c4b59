"""Forward-backward for hidden Markov models, many sequences at a time."""

from __future__ import annotations

import numpy as np

#: Numbers held per array (8 bytes each).
MAX_CELLS = 2_000_000
HELD_CELLS = 6_000_000


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, moved: np.ndarray | None = None) -> np.ndarray:
    """State probabilities of many sequences (none empty) laid end to end in ``emissions`` (rows x states).

    Sequences of similar length run side by side, one step at a time; what is
    held at once stays under about ``MAX_CELLS`` numbers per array. The expected
    transitions of all sequences are added to ``moved`` (states x states), if given.
    """
    out = np.empty_like(emissions)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        n = max(1, MAX_CELLS // (int(lengths[order[i]]) * emissions.shape[1]))
        some = order[i : i + n]
        rows = np.repeat(starts[some] - np.cumsum(lengths[some]) + lengths[some], lengths[some]) + np.arange(lengths[some].sum())
        out[rows] = _side_by_side(emissions[rows], lengths[some], transitions, start, moved)
        i += n
    return out


def _side_by_side(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, moved: np.ndarray | None) -> np.ndarray:
    """Forward-backward over sequences sorted by falling length."""
    seq = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    steps, k = int(lengths.max()), emissions.shape[1]
    grid = np.ones((steps, len(lengths), k))
    grid[pos, seq] = emissions
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    alpha = np.empty_like(grid)
    a = start * grid[0]
    a /= a.sum(1, keepdims=True)
    alpha[0] = a
    for t in range(1, steps):
        n = active[t]
        a = (a[:n] @ transitions) * grid[t, :n]
        a /= a.sum(1, keepdims=True)
        alpha[t, :n] = a
    b = np.ones((len(lengths), k))
    back = transitions.T
    for t in range(steps - 1, -1, -1):
        n = active[t]
        into = grid[t, :n] * b[:n]
        alpha[t, :n] *= b[:n]
        c = into @ back
        if moved is not None and t:
            before = alpha[t - 1, :n]
            moved += (before / (before * c).sum(1, keepdims=True)).T @ into * transitions
        b[:n] = c / c.max(1, keepdims=True)
    out = alpha[pos, seq]
    return out / out.sum(1, keepdims=True)


def held_forward_backward(emissions: np.ndarray, held: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, hold: int, least: int, counts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities and expected transitions (zeros without ``counts``) where one state lasts at least ``least`` (two or more) steps.

    State ``hold`` is entered with its emission in ``emissions`` (rows x k) and goes
    on with those in ``held`` (rows): its first ``least`` steps are a chain that can
    only go forward, the last link of which repeats itself or is left. Each sequence
    has its own ``transitions`` (sequences x k x k) and ``start`` (sequences x k);
    the entry (hold, hold) is the chance to go on. A sequence that ends earlier cuts
    the chain. Returns (rows x k) and (sequences x k x k).
    """
    out, moved = np.empty_like(emissions), np.empty_like(transitions)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    k, i = emissions.shape[1], 0
    while i < len(order):
        n = max(1, HELD_CELLS // (int(lengths[order[i]]) * (k + least)))
        some = order[i : i + n]
        rows = np.repeat(starts[some] - np.cumsum(lengths[some]) + lengths[some], lengths[some]) + np.arange(lengths[some].sum())
        out[rows], moved[some] = _held(emissions[rows], held[rows], lengths[some], transitions[some], start[some], hold, least, counts)
        i += n
    return out, moved


def _held(emissions: np.ndarray, held: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, hold: int, least: int, counts: bool) -> tuple[np.ndarray, np.ndarray]:
    """The recursion over sequences sorted by falling length; states run k plain ones (``hold`` is its last link), then the links before it."""
    seq = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    steps, k, n_seq = int(lengths.max()), emissions.shape[1], len(lengths)
    links = least - 1
    grid = np.ones((steps, k + 1, n_seq), np.float32)  # the k emissions, then that of a held step
    grid[pos, :k, seq] = emissions
    grid[pos, k, seq] = held
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    move = np.ascontiguousarray(np.moveaxis(transitions, 0, 2), np.float32)  # from, to, sequence
    enter = move[:, hold].copy()
    enter[hold] = 0.0
    move[np.arange(k) != hold, hold] = 0.0  # entered by the links only
    entry = grid[:, hold].copy()  # a held state is entered with its own emission
    grid[:, hold] = grid[:, k]
    alpha = np.zeros((steps, k + links, n_seq), np.float32)
    a = alpha[0]
    a[:k] = start.T * grid[0, :k]
    a[k] = start[:, hold] * entry[0]
    a[hold] = 0.0
    a /= a.sum(0)
    for t in range(1, steps):
        n = active[t]
        e, p, a = grid[t, :, :n], alpha[t - 1, :, :n], alpha[t, :, :n]
        np.einsum("in,ijn->jn", p[:k], move[:, :, :n], out=a[:k])
        a[hold] += p[-1]
        a[:k] *= e[:k]
        np.einsum("in,in->n", p[:k], enter[:, :n], out=a[k])
        a[k] *= entry[t, :n]
        if links > 1:
            np.multiply(p[k:-1], e[k], out=a[k + 1 :])
        a /= a.sum(0)
    b = np.ones((k + links, n_seq), np.float32)
    moved = np.zeros((k, k, n_seq))
    for t in range(steps - 1, 0, -1):
        n = active[t]
        e, p = grid[t, :, :n], alpha[t - 1, :, :n]
        into = b[:k, :n] * e[:k]  # what follows a step into each plain state
        first = b[k, :n] * entry[t, :n] * enter[:, :n]
        alpha[t, :, :n] *= b[:, :n]
        if links > 1:
            later = b[k + 1 :, :n] * e[k]
        new = b[:, :n]
        if counts:
            flow = move[:, :, :n] * into
            flow[:, hold] += first
            flow.sum(1, out=new[:k])
        else:
            np.einsum("ijn,jn->in", move[:, :, :n], into, out=new[:k])
            new[:k] += first
        if links > 1:
            new[k:-1] = later
        new[-1] = into[hold]
        norm = np.einsum("in,in->n", p, new)
        new /= norm
        if counts:
            flow *= (p[:k] / norm)[:, None]
            moved[:, :, :n] += flow
    alpha[0] *= b
    alpha[:, hold] += alpha[:, k:].sum(1)
    out = alpha[pos, :k, seq]
    return out / out.sum(1, keepdims=True), np.moveaxis(moved, 2, 0)
