"""A gated recurrent word model in numpy: class-factored softmax, truncated backpropagation, carried state.

Word numbers are ranks by training count; a class is a run of ranks, and runs are cut where the summed square roots
of the counts reach equal shares. P(word) = P(class | state) P(word | class, state). The biases start at the logs of
the counts, so an untrained model is the unigram model. Texts are laid on slots one after another; slots advance in
windows, states are carried from window to window and set to 0 where a text begins.
"""

from __future__ import annotations

import heapq

import numpy as np

WINDOW = 32


def word_classes(counts: np.ndarray, classes: int) -> np.ndarray:
    """The first rank of each class, and the number of ranks at the end."""
    mass = np.cumsum(np.sqrt(np.maximum(counts, 0.5)))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes)
    return np.unique(np.concatenate(([0], cuts, [len(counts)])))


def new_model(counts: np.ndarray, hidden: int = 32, classes: int = 64, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    edges = word_classes(counts, min(classes, len(counts)))
    share = np.maximum(counts, 0.5) / np.maximum(counts, 0.5).sum()
    mass = np.add.reduceat(share, edges[:-1])
    small = lambda *shape: rng.normal(0, 0.08, shape).astype(np.float32)
    return {
        "edges": edges, "input": small(len(counts) + 1, 3 * hidden), "gates": small(hidden, 2 * hidden), "state": small(hidden, hidden),
        "class_w": 0.1 * small(len(edges) - 1, hidden), "class_b": np.log(mass).astype(np.float32),
        "word_w": 0.1 * small(len(counts), hidden), "word_b": np.log(share / np.repeat(mass, np.diff(edges))).astype(np.float32),
    }


def slots(texts: list[np.ndarray], most: int) -> tuple[list[list[int]], np.ndarray]:
    """The texts' numbers on each slot, longest texts first to the emptiest slot; slots in falling order of length."""
    heap = [(0, k) for k in range(max(1, min(most, len(texts))))]
    held: list[list[int]] = [[] for _ in heap]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        length, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (length + len(texts[i]), k))
    length = np.array([sum(len(texts[i]) for i in h) for h in held], np.int64)
    order = np.argsort(-length, kind="stable")
    return [held[k] for k in order], length[order]


class Layout:
    """Texts on slots, as flat arrays: targets, inputs (the token before, or -1 at a start), text numbers; memory grows with the tokens alone."""

    def __init__(self, texts: list[np.ndarray], most: int):
        held, self.length = slots(texts, most)
        order = [i for own in held for i in own]
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        self.target = np.concatenate([texts[i] for i in order] or [np.zeros(0, np.int32)]).astype(np.int32)
        self.owner = np.repeat(np.array(order, np.int32), sizes)
        self.source = np.concatenate(([-1], self.target[:-1])).astype(np.int32)[: len(self.target)]
        self.source[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
        self.first = np.cumsum(self.length) - self.length

    def windows(self):
        """For each window: slots still going, positions (steps by slots), and which of them hold a token."""
        for start in range(0, int(self.length.max(initial=0)), WINDOW):
            n = int((self.length > start).sum())
            steps = start + np.arange(min(WINDOW, int(self.length[0]) - start))[:, None]
            live = steps < self.length[None, :n]
            yield n, np.where(live, self.first[:n] + steps, 0), live


def _forward(m: dict, source: np.ndarray, state: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States after each step of a window; source: steps by slots. `keep` gets what backpropagation needs of all steps."""
    steps, (n, hidden) = len(source), state.shape
    out = np.empty((steps, n, hidden), np.float32)
    rows = m["input"].take(source, 0, mode="wrap")  # -1 is the last row
    some = (source < 0).any(1)
    gates, inner = m["gates"], m["state"]
    held = {k: np.empty((steps, n, w), np.float32) for k, w in (("before", hidden), ("gate", 2 * hidden), ("reset", hidden), ("new", hidden))} if keep is not None else None
    gate, reset, new = np.empty((n, 2 * hidden), np.float32), np.empty((n, hidden), np.float32), np.empty((n, hidden), np.float32)
    for t in range(steps):
        if some[t]:
            state = np.where(source[t][:, None] < 0, np.float32(0), state)
        if held is not None:
            gate, reset, new = held["gate"][t], held["reset"][t], held["new"][t]
            held["before"][t] = state
        x = rows[t]
        np.matmul(state, gates, out=gate)
        gate += x[:, : 2 * hidden]
        np.negative(gate, out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        np.multiply(gate[:, hidden:], state, out=reset)
        np.matmul(reset, inner, out=new)
        new += x[:, 2 * hidden :]
        np.tanh(new, out=new)
        ahead = np.subtract(new, state, out=out[t])
        ahead *= gate[:, :hidden]
        ahead += state
        state = ahead
    if keep is not None:
        keep.update(held)
    return out


_HIGH, _ONES = np.float32(80), np.ones(512, np.float32)


def _shares(x: np.ndarray) -> np.ndarray:
    """Each row's sum of exponentials; x becomes the exponentials. Logits of a trained model are far from the clipped ends."""
    np.minimum(x, _HIGH, out=x)
    np.exp(x, out=x)
    return x @ _ONES[: x.shape[1]] if x.shape[1] <= len(_ONES) else x.sum(1)


def _with_one(h: np.ndarray) -> np.ndarray:
    """The states with a 1 behind each, which meets the biases."""
    out = np.empty((len(h), h.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = h, 1
    return out


def _by_class(m: dict, target: np.ndarray):
    """The tokens' classes, their order by class, and for each class of two ranks or more its ranks and its stretch of that order."""
    of = np.repeat(np.arange(len(m["edges"]) - 1, dtype=np.uint16), np.diff(m["edges"]))[target]
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(m["edges"]))).tolist()
    edges = m["edges"].tolist()
    return of, order, [(slice(edges[k], edges[k + 1]), slice(first[k], first[k + 1])) for k in range(len(edges) - 1) if first[k] < first[k + 1] and edges[k + 1] - edges[k] > 1]


def log_probabilities(m: dict, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logs of the targets' probabilities."""
    of, order, groups = _by_class(m, target)
    states, mine, rank = states.take(order, 0), of[order], target[order]
    got, total = np.empty(len(rank), np.float32), np.empty(len(rank), np.float32)
    for start in range(0, len(rank), 2_048):
        at = slice(start, start + 2_048)
        x = states[at] @ m["class_w"].T
        x += m["class_b"]
        got[at] = x[np.arange(len(x)), mine[at]]
        total[at] = _shares(x)
    for ranks, at in groups:
        x = states[at] @ m["word_w"][ranks].T
        x += m["word_b"][ranks]
        got[at] += x[np.arange(len(x)), rank[at] - ranks.start]
        total[at] *= _shares(x)
    out = np.empty(len(got), np.float32)
    out[order] = got - np.log(total)
    return out


def score(m: dict, texts: list[np.ndarray], most: int = 256) -> np.ndarray:
    """The sum of natural log probabilities of each text's tokens."""
    total = np.zeros(len(texts))
    laid = Layout(texts, most)
    state = np.zeros((len(laid.length), m["state"].shape[0]), np.float32)
    for n, at, live in laid.windows():
        states = _forward(m, np.where(live, laid.source[at], 0), state[:n])
        state = states[-1]
        tokens = at[live]
        states = states.reshape(-1, states.shape[2]) if live.all() else states[live]
        total += np.bincount(laid.owner[tokens], log_probabilities(m, states, laid.target[tokens]), len(texts))
    return total


def segments(texts: list[np.ndarray], most: int = 2048) -> list[np.ndarray]:
    """Texts of more than `most` tokens in parts of at most so many, so that a text doesn't hold up its shard."""
    return [t[i : i + most] for t in texts for i in range(0, len(t), most)]


def _row_sums(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names and the sums of their rows: names met often one by one, the others by their first rows, second rows, and so on."""
    order = np.argsort(names, kind="stable")
    named = names[order]
    first = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
    count = np.diff(np.append(first, len(named)))
    down = np.argsort(-count, kind="stable")
    first, count = first[down], count[down]
    often = int((count > 12).sum())
    out = rows.take(order[first], 0)
    for k in range(often):
        out[k] = rows.take(order[first[k] : first[k] + count[k]], 0).sum(0)
    for j in range(1, int(count[often]) if often < len(count) else 0):
        more = often + int((count[often:] > j).sum())
        out[often:more] += rows.take(order[first[often:more] + j], 0)
    return named[first], out


def train(m: dict, texts: list[np.ndarray], most: int = 16, rate: float = 0.3) -> dict[str, np.ndarray]:
    """One pass over the texts: backpropagation through each window, AdaGrad steps."""
    if not texts:
        return {k: v.copy() for k, v in m.items()}
    hidden = m["state"].shape[0]
    # a bias is the last column of its weights here, and meets the 1 behind each state
    w = {k: m[k].copy() for k in ("edges", "input", "gates", "state")}
    w["class"], w["word"] = (np.concatenate((m[k + "_w"], m[k + "_b"][:, None]), 1) for k in ("class", "word"))
    seen = {k: np.full(v.shape, 1e-2, np.float32) for k, v in w.items() if k != "edges"}
    word_grad = np.zeros_like(w["word"])

    def step(name: str, grad: np.ndarray, where=None) -> None:
        old = seen[name] if where is None else seen[name].take(where, 0, mode="wrap")
        old += grad * grad
        grad *= rate
        grad /= np.sqrt(old)
        if where is None:
            w[name] -= grad
        else:
            seen[name][where] = old
            w[name][where] -= grad

    laid = Layout(texts, most)
    state = np.zeros((len(laid.length), hidden), np.float32)
    for n, at, live in laid.windows():
        keep: dict[str, np.ndarray] = {}
        source = np.where(live, laid.source[at], 0)
        states = _forward(w, source, state[:n], keep)
        state = states[-1]
        steps = len(states)
        y = laid.target[at[live]]
        scale = np.float32(1 / len(y))
        of, order, groups = _by_class(w, y)
        h, mine, rank = _with_one(states.reshape(-1, hidden).take(np.flatnonzero(live)[order], 0)), of[order], y[order]
        back, class_grad = np.empty((len(y), hidden), np.float32), np.zeros_like(w["class"])
        for start in range(0, len(y), 2_048):
            part = slice(start, start + 2_048)
            x = h[part] @ w["class"].T
            x *= (scale / _shares(x))[:, None]
            x[np.arange(len(x)), mine[part]] -= scale
            np.matmul(x, w["class"][:, :-1], out=back[part])
            class_grad += x.T @ h[part]
        word_grad[:] = 0
        for ranks, of_class in groups:
            own, weights = h[of_class], w["word"][ranks]
            x = own @ weights.T
            x *= (scale / _shares(x))[:, None]
            x[np.arange(len(x)), rank[of_class] - ranks.start] -= scale
            back[of_class] += x @ weights[:, :-1]
            np.matmul(x.T, own, out=word_grad[ranks])
        pull = np.zeros_like(states)
        pull.reshape(-1, hidden)[np.flatnonzero(live)[order]] = back
        before, reset, new = keep["before"], keep["reset"], keep["new"]
        z, r = keep["gate"][:, :, :hidden], keep["gate"][:, :, hidden:]
        rest = 1 - z
        by_new = (1 - new * new) * z
        by_z = (new - before) * z * rest
        by_r = reset * (1 - r)
        d_rows = np.empty((steps, n, 3 * hidden), np.float32)
        carried = np.zeros((n, hidden), np.float32)
        state_t, gates_t = np.ascontiguousarray(w["state"].T), np.ascontiguousarray(w["gates"].T)
        fresh = source < 0
        some = fresh.any(1)
        d_reset = np.empty_like(carried)
        for t in range(steps - 1, -1, -1):
            g, d = pull[t], d_rows[t]
            g += carried
            d_new, d_zr = d[:, 2 * hidden :], d[:, : 2 * hidden]
            np.multiply(g, by_new[t], out=d_new)
            np.matmul(d_new, state_t, out=d_reset)
            np.multiply(g, by_z[t], out=d[:, :hidden])
            np.multiply(d_reset, by_r[t], out=d[:, hidden : 2 * hidden])
            np.matmul(d_zr, gates_t, out=carried)
            g *= rest[t]
            carried += g
            d_reset *= r[t]
            carried += d_reset
            if some[t]:
                carried[fresh[t]] = 0
        d_rows = d_rows.reshape(-1, 3 * hidden)
        step("gates", before.reshape(-1, hidden).T @ d_rows[:, : 2 * hidden])
        step("state", reset.reshape(-1, hidden).T @ d_rows[:, 2 * hidden :])
        step("class", class_grad)
        step("word", word_grad)
        words, d_input = _row_sums(source.ravel(), d_rows)
        step("input", d_input, words)
    cuts = {f"{k}_{part}": np.ascontiguousarray(w[k][:, at]) for k in ("class", "word") for part, at in (("w", slice(0, hidden)), ("b", hidden))}
    return {k: cuts[k] if k in cuts else w[k] for k in m}
