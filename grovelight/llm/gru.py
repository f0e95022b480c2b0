"""A small gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state.

Words are ids 0..head-1 in order of frequency; id ``head`` stands for every rarer word. Class c < classes holds
``per_class`` consecutive ids; one more class stands for the rarer words, whose distribution inside the class is the
caller's. The output biases start at the unigram frequencies, so an untrained model scores as the unigrams do.
"""

from __future__ import annotations

import heapq

import numpy as np

CLASSES = 32
PER_CLASS = 32
HEAD = CLASSES * PER_CLASS
START = HEAD + 1
#: Most tokens of a training stretch: a longer document is trained on in several, each after its former word.
STRETCH = 512
EMBED = 16
HIDDEN = 20
WINDOW = 32


def initial(counts: np.ndarray, rest: float, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters for smoothed counts of the head words (zero for unused ids) and the mass of all rarer words."""
    rng = np.random.default_rng(seed)
    shape = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    grouped = counts.reshape(CLASSES, PER_CLASS)
    floor = -30.0
    safe_log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-300)), floor)
    total = counts.sum() + rest
    mass = np.append(grouped.sum(1), rest)
    return {
        "emb": 0.1 * rng.standard_normal((HEAD + 2, EMBED)).astype(np.float32), "wx": shape(EMBED, 3 * HIDDEN), "u": shape(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
        "wc": np.zeros((HIDDEN, CLASSES + 1), np.float32), "bc": safe_log(mass / total).astype(np.float32),
        "ww": np.zeros((CLASSES, HIDDEN, PER_CLASS), np.float32), "bw": safe_log(grouped / np.maximum(mass[:-1, None], 1e-300)).astype(np.float32),
    }


def lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Deal documents to at most ``most`` lanes of about equal length, longest first; the longest lane comes first."""
    n = min(most, len(lengths))
    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (size + int(lengths[i]), k))
    return sorted(out, key=lambda own: -sum(int(lengths[i]) for i in own))


def stretches(docs: list[np.ndarray], most: int = STRETCH) -> tuple[list[np.ndarray], np.ndarray]:
    """Documents cut so that lanes come out even, and the input of each stretch's first step: START or the word before."""
    own = [(d[i : i + most], d[i - 1] if i else START) for d in docs for i in range(0, len(d), most)]
    return [d for d, _ in own], np.array([first for _, first in own], np.int32)


def lay_out(docs: list[np.ndarray], most: int, firsts: np.ndarray | None = None):
    """Targets, inputs, starts and owners as (steps, lanes); targets are -1 beyond a lane's end. ``firsts``: see ``stretches``."""
    lengths = np.array([len(d) for d in docs])
    own = lanes(lengths, most)
    steps = max((int(lengths[k].sum()) for k in own), default=0)
    target = np.full((steps, len(own)), -1, np.int32)
    source = np.full((steps, len(own)), START, np.int32)
    begins = np.zeros((steps, len(own)), np.bool_)
    owner = np.zeros((steps, len(own)), np.int32)
    for k, ids in enumerate(own):
        row = np.concatenate([docs[i] for i in ids])
        ends = np.cumsum(lengths[ids])
        target[: len(row), k], source[1 : len(row), k] = row, row[:-1]
        first = np.concatenate([[0], ends[:-1]])
        source[first, k], begins[first, k] = START if firsts is None else firsts[ids], True
        owner[: len(row), k] = np.repeat(ids, lengths[ids])
    return target, source, begins, owner


def exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each row, in the place of ``x``, and their sums; logits stay far below float32's limit, so no shift is needed."""
    e = np.exp(x, out=x)
    sums = e @ np.ones(x.shape[1], x.dtype)
    return e, sums


def outputs(p: dict, h: np.ndarray, target: np.ndarray, backward: bool = False):
    """Log-probability of each target after state h, with what backpropagation needs. A rarer word gets its class's.

    States and targets are put in order of the class once, so that each class has a slice of them.
    """
    cls = target // PER_CLASS
    order = np.argsort(cls.astype(np.int8), kind="stable")
    cls, hs = cls[order], h[order]
    k = target[order] - cls * PER_CLASS
    row = np.arange(len(target))
    classes = hs @ p["wc"]
    classes += p["bc"]
    picked = classes[row, cls]
    classes, sums = exponentials(classes)
    found = (picked - np.log(sums)).astype(np.float64)
    if backward:
        classes /= sums[:, None]
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
    inner = []
    for c, a, b in zip(range(CLASSES), cuts.tolist(), cuts[1:].tolist()):
        if a < b:
            x = hs[a:b] @ p["ww"][c]
            x += p["bw"][c]
            picked = x[row[: b - a], k[a:b]]
            x, sums = exponentials(x)
            found[a:b] += picked - np.log(sums)
            if backward:
                x /= sums[:, None]
                inner.append((c, a, b, x))
    logp = np.empty(len(target))
    logp[order] = found
    return logp, order, hs, cls, k, classes, inner


def run(p: dict, table: np.ndarray, h: np.ndarray, source: np.ndarray, begins: np.ndarray, backward: bool = False):
    """States that predict each target, shape (steps, lanes, HIDDEN): a step takes its input in first. Also what
    backpropagation needs of each step: the state before, z, r, n and the state's part of n."""
    gates, own = np.ascontiguousarray(table[:, : 2 * HIDDEN])[source], np.ascontiguousarray(table[:, 2 * HIDDEN :])[source]
    by_gates, by_own = np.ascontiguousarray(p["u"][:, : 2 * HIDDEN]), np.ascontiguousarray(p["u"][:, 2 * HIDDEN :])
    states = np.empty((*source.shape, HIDDEN), np.float32)
    before, handed = (np.empty_like(states), np.empty_like(states)) if backward else (None, None)
    fresh = begins.any(1).tolist()
    for t in range(len(source)):
        if fresh[t]:
            h = h * ~begins[t][:, None]
        zr, n, gn = gates[t], own[t], h @ by_own
        if backward:
            before[t], handed[t] = h, gn
        zr += h @ by_gates
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        gn *= zr[:, HIDDEN:]
        n += gn
        np.tanh(n, out=n)
        after = np.subtract(h, n, out=states[t])
        after *= zr[:, :HIDDEN]
        after += n
        h = after
    return states, (before, gates[:, :, :HIDDEN], gates[:, :, HIDDEN:], own, handed)


def score(p: dict, docs: list[np.ndarray], most: int = 256) -> np.ndarray:
    """Natural log-probability of each whole document (rarer words: of their class)."""
    if not docs:
        return np.zeros(0)
    target, source, begins, owner = lay_out(docs, most)
    table = p["emb"] @ p["wx"] + p["b"]
    out, h = np.zeros(len(docs)), np.zeros((target.shape[1], HIDDEN), np.float32)
    for t in range(0, len(target), WINDOW):
        part = target[t : t + WINDOW]
        n = int((part[0] >= 0).sum())  # lanes are in order of length, so those still running come first
        states, _ = run(p, table, h[:n], source[t : t + WINDOW, :n], begins[t : t + WINDOW, :n])
        h = states[-1]
        live = part[:, :n] >= 0
        logp, *_ = outputs(p, states[live], part[:, :n][live])
        out += np.bincount(owner[t : t + WINDOW, :n][live], logp, len(docs))
    return out


def train(p: dict, docs: list[np.ndarray], most: int = 32, rate: float = 4e-3) -> dict:
    """One pass over every token: truncated backpropagation with Adam; state runs on across windows of a stretch."""
    p = {k: v.copy() for k, v in p.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    docs, firsts = stretches(docs)
    target, source, begins, _ = lay_out(docs, most, firsts) if docs else (np.zeros((0, 0), np.int32),) * 4
    h, step = np.zeros((target.shape[1], HIDDEN), np.float32), 0
    for t in range(0, len(target), WINDOW):
        n = int((target[t] >= 0).sum())  # as in ``score``: lanes that have ended cost nothing
        goal, src, new, h = target[t : t + WINDOW, :n], source[t : t + WINDOW, :n], begins[t : t + WINDOW, :n], h[:n]
        live = goal >= 0
        table = p["emb"] @ p["wx"] + p["b"]
        states, gates = run(p, table, h, src, new, backward=True)
        h = states[-1]
        hs, aim = states[live], goal[live]
        _, order, hs, cls, k, d, inner = outputs(p, hs, aim, backward=True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        scale = np.float32(1 / len(aim))
        d[np.arange(len(aim)), cls] -= 1
        d *= scale
        g["wc"], g["bc"] = hs.T @ d, d.sum(0)
        dh_live = d @ p["wc"].T
        for c, a, b, e in inner:
            e[np.arange(b - a), k[a:b]] -= 1
            e *= scale
            g["ww"][c], g["bw"][c] = hs[a:b].T @ e, e.sum(0)
            dh_live[a:b] += e @ p["ww"][c].T
        dout = np.zeros_like(states)
        put = np.empty_like(dh_live)
        put[order] = dh_live
        dout[live] = put
        before, z, r, n, gn = gates
        # What the steps don't hand on is worked out for all of them at once.
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), gn * r * (1 - r)
        kept = ~new[:, :, None]
        du, inputs = (np.empty((*src.shape, 3 * HIDDEN), np.float32) for _ in range(2))
        carried, back = np.zeros_like(h), np.ascontiguousarray(p["u"].T)
        for s in range(len(goal) - 1, -1, -1):
            dh, own = dout[s] + carried, du[s]
            dn = dh * by_n[s]
            np.multiply(dh, by_z[s], out=own[:, :HIDDEN])
            np.multiply(dn, by_r[s], out=own[:, HIDDEN : 2 * HIDDEN])
            np.multiply(dn, r[s], out=own[:, 2 * HIDDEN :])
            inputs[s, :, 2 * HIDDEN :] = dn
            carried = (dh * z[s] + own @ back) * kept[s]
        inputs[:, :, : 2 * HIDDEN] = du[:, :, : 2 * HIDDEN]
        g["u"] = before.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
        order = np.argsort(src, axis=None, kind="stable")
        ids = src.ravel()[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        dtable = np.zeros_like(table)
        dtable[ids[first]] = np.add.reduceat(inputs.reshape(-1, table.shape[1])[order], first)
        g["emb"], g["wx"], g["b"] = dtable @ p["wx"].T, p["emb"].T @ dtable, dtable.sum(0)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        step += 1
        for k in p:
            x = g[k] * np.float32(min(1, 1 / max(norm, 1e-9)))
            mean[k] += 0.1 * (x - mean[k])
            square[k] += 0.01 * (x * x - square[k])
            p[k] -= np.float32(rate) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + np.float32(1e-8))
    return p


def average(models: list[tuple[dict, int]]) -> dict:
    """Mean of the parameters, weighted by training tokens."""
    total = sum(n for _, n in models)
    return {k: sum(m[k] * (n / total) for m, n in models).astype(np.float32) for k in models[0][0]}
