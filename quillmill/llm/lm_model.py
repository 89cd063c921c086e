"""The language model of lm_score in numpy: corpus counts of subword pairs, corrected by one head of causal attention.

An id is predicted in two steps, its class and the id in its class. Both start from counts of adjacent ids over all
training documents; masked self-attention over the window corrects the classes. Ids beyond the TOP most frequent share
one row of the tables and are told apart by their own counts.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

CONTEXT, OVERLAP, DIM, CLASSES, TOP, FEATURES = 32, 8, 8, 32, 2048, 16
RATE, BATCH, DISCOUNT, LOG10 = 0.015, 256, 0.75, np.float32(1 / math.log(10))
#: Chunks of the repeat memory end where a hash of GRAM ids says so, CHUNK ids apart on average; KEY ids before one are its
#: key. A text's first cut comes after HEAD ids, which are a key themselves.
GRAM, CHUNK, KEY, HEAD = 4, 64, 8, 5
_VISIBLE, _CEILING = np.tril(np.ones((CONTEXT, CONTEXT), np.float32)), np.float32(60)
_M, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


class Counts(NamedTuple):
    """What the corpus says before any training: tables over rows (an id's row is row_of[id])."""

    row_of: np.ndarray  # ids -> rows, int32
    features: np.ndarray  # rows x FEATURES: unit vectors from the pair counts
    classes: np.ndarray  # rows -> class
    prior: np.ndarray  # rows x CLASSES: log P(class of the next id | row)
    inside: np.ndarray  # rows x rows: log10 P(row of the next id | row, its class)
    rest: np.ndarray  # ids: log10 P(id | its row)


def rows_of(counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The row of each id: the top - 1 most frequent have one of their own (ties by id), all others share the last."""
    rows = np.full(len(counts), top - 1, np.int32)
    order = np.lexsort((np.arange(len(counts)), -counts))[: top - 1]
    rows[order] = np.arange(len(order))
    return rows


def pair_features(pairs: np.ndarray, size: int = FEATURES) -> np.ndarray:
    """A unit vector for each row: leading eigenvectors of the symmetric pair counts, by subspace iteration. Degrees are
    raised by their mean, without which rare rows that meet only each other would take all directions."""
    both = pairs + pairs.T
    degree = both.sum(1)
    scale = np.sqrt(degree + degree.mean() + 1e-9)
    a = (both / scale[:, None] / scale).astype(np.float32)
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((len(a), size + 8)).astype(np.float32))[0]
    for _ in range(20):
        q = np.linalg.qr(a @ q)[0]
    values, vectors = np.linalg.eigh(q.T @ a @ q)
    order = np.argsort(-values)[1 : size + 1]  # the first tells frequency alone
    u = (q @ vectors)[:, order] * values[order] / scale[:, None] * math.sqrt(degree.sum() + 1)
    return (u / (np.linalg.norm(u, axis=1, keepdims=True) + 1e-3)).astype(np.float32)


def cluster(points: np.ndarray, mass: np.ndarray, k: int = CLASSES) -> np.ndarray:
    """k-means classes of weighted points, started from the heaviest point and then the heaviest far ones."""
    far = ((points - points[np.argmax(mass)]) ** 2).sum(1)
    centres = [points[np.argmax(mass)]]
    while len(centres) < k:
        centres.append(points[np.argmax(far * np.sqrt(mass))])
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(25):
        own = ((points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1)).argmin(1)
        weight = np.bincount(own, mass, k)
        for c in np.flatnonzero(weight):
            centres[c] = (points[own == c] * mass[own == c, None]).sum(0) / weight[c]
    return own.astype(np.int32)


def count_tables(counts: np.ndarray, pairs: np.ndarray) -> Counts:
    """Tables from the counts of each id and of each pair of rows. Without any counts all classes and ids are equal."""
    top = len(pairs)
    rows = rows_of(counts, top)
    pairs = pairs.astype(np.float64)
    features = pair_features(pairs)
    inn = pairs.sum(0) + 0.5
    classes = cluster(features, inn) if pairs.any() else (np.arange(top) % CLASSES).astype(np.int32)
    by_class = np.zeros((top, CLASSES))
    kinds = np.zeros((top, CLASSES))
    for c in range(CLASSES):
        by_class[:, c] = pairs[:, classes == c].sum(1)
        kinds[:, c] = (pairs[:, classes == c] > 0).sum(1)
    present = np.bincount(classes, minlength=CLASSES) > 0
    share = (by_class.sum(0) + 0.5) * present
    share /= share.sum()
    with np.errstate(divide="ignore"):
        prior = np.log((by_class + 2 * share) / (by_class.sum(1, keepdims=True) + 2))
    usual = inn / np.bincount(classes, inn, CLASSES)[classes]
    spare = DISCOUNT * kinds + 0.5
    inside = np.log10((np.maximum(pairs - DISCOUNT, 0) + spare[:, classes] * usual) / (by_class + 0.5)[:, classes])
    mass = counts + 0.5
    rest = np.log10(mass / np.bincount(rows, mass, top)[rows])
    return Counts(rows, features, classes, np.maximum(prior, -30).astype(np.float32), inside.astype(np.float32), rest.astype(np.float32))


class Windows(NamedTuple):
    """Windows of CONTEXT predictions over many id sequences laid end to end."""

    at: np.ndarray  # windows x (CONTEXT + 1): places of the ids
    scored: np.ndarray  # windows x CONTEXT: whether the id after each place is predicted here; each is, once


def windows_over(lengths: np.ndarray, overlap: int = OVERLAP) -> Windows:
    """Each window but a sequence's first repeats `overlap` places, which are context only."""
    step = CONTEXT - overlap
    ends = np.cumsum(lengths)
    n = np.maximum(1, -(-(lengths - 1 - overlap) // step)) * (lengths > 1)
    own = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    at = ((ends - lengths)[own] + k * step)[:, None] + np.arange(CONTEXT + 1)
    scored = (at[:, 1:] < ends[own][:, None]) & ((k == 0)[:, None] | (np.arange(CONTEXT) >= overlap))
    return Windows(np.minimum(at, (ends[own] - 1)[:, None]), scored)


class Heads(NamedTuple):
    """What each row of the tables brings to attention."""

    own: np.ndarray  # rows x (3 * DIM + 1): query (scaled), key, value and a one
    prior: np.ndarray  # rows x CLASSES, with the bias
    places: np.ndarray  # CONTEXT x (3 * DIM + 1): what its place adds
    safe: bool  # no score can reach the ceiling either way, so none is shifted


class Attention:
    """One causal head over the features of rows; what it finds is added to the classes' prior.

    All that precedes attention is linear, so it is summed once for each row of the tables (`heads`), not for each token.
    Attention weights stay unnormalised: a column of ones beside the values sums them in the same product.
    """

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(3)
        shapes = {"mix": (FEATURES, 3 * DIM), "ep": (CONTEXT, 3 * DIM), "wo": (DIM, CLASSES), "bias": (CLASSES,)}
        self.w = weights or {k: (rng.standard_normal(s) * (0.5 if k == "mix" else 0.0)).astype(np.float32) for k, s in shapes.items()}

    def heads(self, tables: Counts) -> Heads:
        """What stands before attention, and whether any score that comes out of it could overflow when raised."""
        own = np.ones((len(tables.prior), 3 * DIM + 1), self.w["mix"].dtype)
        own[:, : 3 * DIM] = tables.features @ self.w["mix"]
        own[:, :DIM] *= own.dtype.type(DIM**-0.5)
        places = np.zeros((CONTEXT, 3 * DIM + 1), own.dtype)
        places[:, : 3 * DIM] = self.w["ep"]
        prior = tables.prior + self.w["bias"]
        most = np.maximum(own.max(0), -own.min(0)) + np.abs(places).max(0)
        safe = most[:DIM] @ most[DIM : 2 * DIM] < _CEILING and prior.max() + (most[2 * DIM : 3 * DIM] @ np.abs(self.w["wo"])).max() < _CEILING
        return Heads(own, prior, places, bool(safe))

    def forward(self, rows: np.ndarray, heads: Heads, start: int = 0):
        """(class scores, queries, keys, values and ones, visible attention, its sums, what it gathers) at the places from
        start on; those before are context alone."""
        h = heads.own.take(rows, 0)
        h += heads.places
        q, k, v = h[:, start:, :DIM], h[..., DIM : 2 * DIM], h[..., 2 * DIM :]
        s = q @ k.transpose(0, 2, 1)
        if not heads.safe:  # the largest visible score of a place becomes 0: none overflows and not all vanish
            s -= np.where(_VISIBLE[start:] > 0, s, -np.inf).max(-1, keepdims=True)
            np.minimum(s, 0, out=s)
        np.exp(s, out=s)
        s *= _VISIBLE[start:]
        y = s @ v
        total = y[..., DIM:]
        y = y[..., :DIM] / total
        z = y.reshape(-1, DIM) @ self.w["wo"]
        z += heads.prior.take(rows[:, start:].ravel(), 0)
        if not heads.safe:
            z -= z.max(1, keepdims=True)
        return z, q, k, v, s, total, y

    def class_logs(self, rows: np.ndarray, target: np.ndarray, heads: Heads, start: int = 0) -> np.ndarray:
        """Log-probability of each target class at the places from start on."""
        z = self.forward(rows, heads, start)[0]
        at = z[np.arange(len(z)), target.ravel()]
        np.exp(z, out=z)
        return (at - np.log(z @ np.ones(CLASSES, z.dtype))).reshape(target.shape)

    def gradients(self, rows: np.ndarray, target: np.ndarray, mask: np.ndarray, tables: Counts) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the target classes where mask holds, and its gradients."""
        z, q, k, v, s, total, y = self.forward(rows, self.heads(tables))
        kind = z.dtype.type
        hot, share = (np.arange(target.size), target.ravel()), mask.ravel() / kind(max(1, mask.sum()))
        share = share.astype(kind)
        at = z[hot]
        np.exp(z, out=z)
        sums = z @ np.ones(CLASSES, kind)
        loss = float((np.log(sums) - at) @ share)
        z *= (share / sums)[:, None]
        z[hot] -= share
        g = {"bias": np.ones(len(z), kind) @ z, "wo": y.reshape(-1, DIM).T @ z}
        lead = np.empty(v.shape, kind)
        dy = np.divide((z @ self.w["wo"].T).reshape(y.shape), total, out=lead[..., :DIM])
        np.negative(np.einsum("bcd,bcd->bc", dy, y), out=lead[..., DIM])
        dh = np.empty((*rows.shape, 3 * DIM), kind)
        dh[..., 2 * DIM :] = s.transpose(0, 2, 1) @ dy
        s *= lead @ v.transpose(0, 2, 1)
        dh[..., :DIM] = s @ k
        dh[..., DIM : 2 * DIM] = s.transpose(0, 2, 1) @ q
        g["ep"] = dh.sum(0)
        flat = dh.reshape(-1, 3 * DIM)
        g["mix"] = tables.features.take(rows, 0).reshape(-1, FEATURES).T @ flat
        g["mix"][:, :DIM] *= kind(DIM**-0.5)
        return loss, g

    def fit(self, flat: np.ndarray, windows: Windows, tables: Counts, state: dict, rate: float = RATE, seed: int = 0) -> None:
        """One pass of Adam over windows of the rows flat; state carries the moments from call to call."""
        m, s = state.setdefault("m", {k: 0.0 for k in self.w}), state.setdefault("s", {k: 0.0 for k in self.w})
        order = np.random.default_rng(seed).permutation(len(windows.at))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            rows = flat.take(windows.at.take(some, 0))
            _, g = self.gradients(rows[:, :-1], tables.classes.take(rows[:, 1:]), windows.scored[some], tables)
            state["t"] = t = state.get("t", 0) + 1
            for k in self.w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                self.w[k] = self.w[k] - (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype(self.w[k].dtype)


def token_logs(model: Attention, tables: Counts, heads: Heads, flat: np.ndarray, lengths: np.ndarray, size: int = 128) -> np.ndarray:
    """log10 probability of every id but the first of each sequence (laid end to end in flat), in their order."""
    rows, inside = tables.row_of.take(flat), tables.inside.ravel()
    at, scored = windows_over(lengths)
    logs = np.zeros(scored.shape, np.float32)
    later, top = ~scored[:, 0], len(tables.inside)
    for which, start in ((np.flatnonzero(~later), 0), (np.flatnonzero(later), OVERLAP)):
        for lo in range(0, len(which), size):
            some = which[lo : lo + size]
            own = rows.take(at.take(some, 0))
            before, after = own[:, start:-1], own[:, start + 1 :]
            logs[some, start:] = model.class_logs(own[:, :-1], tables.classes.take(after), heads, start) * LOG10 + inside.take(before * np.int64(top) + after)
    keep = np.ones(len(flat), bool)
    keep[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    return logs[scored] + tables.rest[flat[keep]]


class Chunks(NamedTuple):
    """Parts of the sequences that the repeat memory knows by hash, in order; the first id of a sequence is in none."""

    own: np.ndarray  # which sequence
    start: np.ndarray  # place in the row of predicted ids (all sequences, their first ids left out)
    key: np.ndarray  # hash of the KEY ids before, int64
    pair: np.ndarray  # hash of key and chunk, int64
    keyed: np.ndarray  # whether enough ids of the same sequence come before


def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def chunks_over(flat: np.ndarray, lengths: np.ndarray) -> Chunks:
    """Cut sequences where the hash of the last GRAM ids says so, so that equal passages are cut alike wherever they stand."""
    n = len(flat)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    own = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(n) - begins[own]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(flat.astype(np.uint64) + np.uint64(77)) * _powers(n, _M)[:n])])
    down = _powers(n, pow(_M, -1, 1 << 64))

    def span(a, z):
        return (sums[z] - sums[a]) * down[a]

    at = np.flatnonzero((within >= GRAM) & (within < lengths[own] - 1))  # a cut after this place; the begin id does not count
    at = at[_mixed(span(at - GRAM + 1, at + 1)) >> np.uint64(40) < np.uint64((1 << 24) // CHUNK)] + 1
    at = at[within[at] > HEAD + 1]
    starts = np.unique(np.concatenate([at, (begins + 1)[lengths > 1], (begins + 1 + HEAD)[lengths > HEAD + 1]]))
    which = own[starts]
    stops = np.minimum(np.append(starts[1:], n), ends[which])
    keyed = within[starts] > HEAD
    key = _mixed(span(np.maximum(starts - KEY, begins[which]), starts))
    pair = _mixed(key * np.uint64(_M) + span(starts, stops) + (stops - starts).astype(np.uint64))
    return Chunks(which, starts - which - 1, key.view(np.int64), pair.view(np.int64), keyed)
