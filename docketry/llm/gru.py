"""A gated recurrent language model in numpy with a class-factored output.

Input and output symbols are the most frequent words, and for all others a bucket by their last
bytes. P(word) = P(class) * P(word | class): frequent words share classes and have a softmax within
the class; a bucket is a class of its own, within which the caller's counts decide. Training is truncated
backpropagation through time over windows; the state runs on from window to window until a text ends.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

HIDDEN = 24
WINDOW = 32
LANES = 64
RATE = 6e-3
EPOCHS = 2
#: Symbols after which training lets go of a text's state, so that one long text doesn't hold up all lanes.
PIECE = 1_024
SCORE_LANES = 512
SCORE_WINDOW = 64


#: Rows whose logits are worked on at once, so that they stay in a core's cache.
BLOCK = 1_024
#: Rows of the same input, up to which they are summed beside those of other inputs.
FEW = 16
#: Logits up to this size need no shift before exp(): float32 ends at 88.
SAFE = 60


class Room:
    """Arrays to work in, each kept under a name and used again: the system clears all memory that is asked for anew."""

    def __init__(self, dtype: type = np.float32):
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, self.dtype)
        return self.held[name][:size].reshape(shape)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # exp() of a large number is infinite, and its inverse 0
        np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _softmax(s: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(exp, its sums, what was taken off) of logits, in place. safe: the largest of a row lies within SAFE of 0, so that nothing needs taking off."""
    top = 0.0
    if not safe:
        top = s.max(axis=1)
        s -= top[:, None]
    np.exp(s, out=s)
    return s, s @ np.ones(s.shape[1], s.dtype), top


class Gru:
    """n_words frequent words (id 0 marks the end of a text and its start), in classes of `share`, then n_buckets."""

    def __init__(self, word_counts: np.ndarray, bucket_counts: np.ndarray, share: int = 32, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.n_words, self.n_buckets, self.share, self.hidden = len(word_counts), len(bucket_counts), share, hidden
        self.n_classes = -(-self.n_words // share)
        padded = np.zeros(self.n_classes * share)
        padded[: self.n_words] = word_counts + 1.0
        by_class = padded.reshape(-1, share)
        shares = np.concatenate([by_class.sum(axis=1), bucket_counts + 1.0])
        n_in = self.n_words + self.n_buckets
        self.p = {
            "e": rng.normal(0, 0.1, (n_in, 3 * hidden)), "u": rng.normal(0, 0.3 / np.sqrt(hidden), (hidden, 3 * hidden)), "n": np.zeros(hidden),
            "c": rng.normal(0, 0.05, (hidden, len(shares))), "cb": np.log(shares / shares.sum()),
            "w": rng.normal(0, 0.05, (hidden, len(padded))), "wb": np.log(np.maximum(by_class / by_class.sum(axis=1, keepdims=True), 1e-30)).ravel(),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.n_words, ids // self.share, ids - self.n_words + self.n_classes)

    def step(self, x: np.ndarray, h: np.ndarray, room: Room | None = None, gates: np.ndarray | None = None) -> tuple:
        """x: the input's rows of e. (next state, r, z, n, a), the last four in `gates` if it is given."""
        k, m, room = self.hidden, len(h), room or Room(h.dtype)
        r, z, n, a = room("gates", 4, m, k) if gates is None else gates
        g = np.matmul(h, self.p["u"], out=room("g", m, 3 * k))
        rz = _sigmoid(np.add(x[:, : 2 * k], g[:, : 2 * k], out=room("rz", m, 2 * k)))
        r[:], z[:] = rz[:, :k], rz[:, k:]  # runs of their own are worked on faster
        np.add(g[:, 2 * k :], self.p["n"], out=a)
        np.multiply(r, a, out=n)
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        out = h - n
        out *= z
        out += n
        return out, r, z, n, a

    def _safe(self) -> tuple[bool, np.ndarray]:
        """Whether the largest logit of any state lies within SAFE of 0: over the classes, and within each class. States lie between -1 and 1."""
        p, within = self.p, (self.n_classes, self.share)
        reach, far = np.abs(p["c"]).sum(axis=0), np.abs(p["w"]).sum(axis=0)
        ends = lambda b, d: (np.abs((b + d).max(axis=-1)) <= SAFE) & (np.abs((b - d).max(axis=-1)) <= SAFE)
        return bool(ends(p["cb"], reach)), ends(p["wb"].reshape(within), far.reshape(within))

    def log_probs(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None, room: Room | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural-log probability of each target given its state; with grad also d(-sum)/dh, and grad is added to."""
        p, rows, room = self.p, np.arange(len(y)), room or Room(h.dtype)
        cls = self.class_of(y)
        # all is worked out in the order of classes, so that a class is a run of rows
        order = np.argsort(cls.astype(np.int16) if len(p["cb"]) < 1 << 15 else cls, kind="stable")
        # a state's last number is 1 and meets the biases
        k, y, cls, states = self.hidden, y[order], cls[order], h
        h = room("sorted", len(y), k + 1)
        h[:, :k], h[:, k] = states.take(order, axis=0, out=room("dh in order", *states.shape), mode="clip"), 1
        c, w = np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["w"], p["wb"][None]])
        all_safe, safe = self._safe()
        out, dh, c_back = np.empty(len(y), h.dtype), None if grad is None else room("dh", *states.shape), np.ascontiguousarray(p["c"].T)
        for at in range(0, len(y), BLOCK):
            run = slice(at, at + BLOCK)
            s = np.matmul(h[run], c, out=room("s", len(h[run]), c.shape[1]))
            i = rows[: len(s)]
            out[run] = s[i, cls[run]]
            e, total, top = _softmax(s, all_safe)
            out[run] -= np.log(total) + top
            if grad is not None:
                # what is narrower than e is divided by the sums in its place
                e[i, cls[run]] -= total
                total = (1 / total)[:, None]
                dc = np.multiply(h[run], total, out=room("divided", len(e), k + 1)).T @ e
                grad["c"] += dc[:k]
                grad["cb"] += dc[k]
                np.matmul(e, c_back, out=dh[run])
                dh[run] *= total
        ends = np.searchsorted(cls, np.arange(self.n_classes + 1))
        for kind in np.flatnonzero(np.diff(ends)):
            run, span = slice(ends[kind], ends[kind + 1]), slice(kind * self.share, (kind + 1) * self.share)
            s = np.matmul(h[run], w[:, span], out=room("s", len(h[run]), self.share))
            i, within = rows[: len(s)], y[run] - kind * self.share
            out[run] += s[i, within]
            e, total, top = _softmax(s, safe[kind])
            out[run] -= np.log(total) + top
            if grad is not None:
                e *= (1 / total)[:, None]
                e[i, within] -= 1
                dw = h[run].T @ e
                grad["w"][:, span] += dw[:k]
                grad["wb"][span] += dw[k]
                dh[run] += np.matmul(e, p["w"][:, span].T, out=room("dh of words", len(e), self.hidden))
        back = np.empty_like(order)
        back[order] = rows
        return out[back], None if dh is None else dh.take(back, axis=0, out=room("dh in order", *dh.shape), mode="clip")

    def copy(self) -> "Gru":
        other = object.__new__(Gru)
        other.__dict__.update(self.__dict__, p={k: v.copy() for k, v in self.p.items()})
        return other

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> "Gru":
        """Takes weights as flat() gives them."""
        ends = np.cumsum([v.size for v in self.p.values()])[:-1]
        self.p = {k: part.reshape(v.shape).copy() for (k, v), part in zip(self.p.items(), np.split(flat, ends))}
        return self

    def fit(self, texts: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE, n_lanes: int = LANES) -> "Gru":
        """texts: ids without the end mark. The bucket and word biases start at the corpus counts; the step size falls to a tenth of rate."""
        if not texts:
            return self
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        updates, room = 0, Room()
        pieces = [t[at : at + PIECE] for t in texts for at in range(0, max(1, len(t)), PIECE)]
        last = [at + PIECE >= len(t) for t in texts for at in range(0, max(1, len(t)), PIECE)]
        for _ in range(epochs):
            x, y, _, loads = lanes(pieces, min(n_lanes, len(pieces)), last)
            h = np.zeros((x.shape[1], self.hidden), np.float32)
            total = -(-len(x) // WINDOW) * epochs
            for at in range(0, len(x), WINDOW):
                grad, h = self._window(x[at : at + WINDOW], y[at : at + WINDOW], h, room)
                norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
                updates += 1
                step = rate * (1 - 0.9 * updates / total)
                for k, g in grad.items():
                    g *= min(1.0, 5.0 / max(norm, 1e-9))
                    t = np.multiply(g, 0.1, out=room("update", *g.shape))
                    m[k] *= 0.9
                    m[k] += t
                    np.multiply(g, g, out=t)
                    t *= 0.01
                    v[k] *= 0.99
                    v[k] += t
                    np.divide(v[k], 1 - 0.99**updates, out=t)
                    np.sqrt(t, out=t)
                    t += 1e-6
                    np.divide(m[k], t, out=t)
                    t *= step / (1 - 0.9**updates)
                    self.p[k] -= t
        return self

    def _window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, room: Room | None = None) -> tuple[dict, np.ndarray]:
        """Gradient of the mean loss of a window. y: -1 where a lane has ended; input 0 starts a text."""
        p, k, room = self.p, self.hidden, room or Room(h.dtype)
        grad = {name: np.zeros_like(a) for name, a in p.items()}
        live = (x != 0).astype(h.dtype)[:, :, None]
        before, states = room("states", 2, *x.shape, k)
        kept = room("kept", len(x), 4, x.shape[1], k)
        for t in range(len(x)):
            np.multiply(h, live[t], out=before[t])
            h = self.step(p["e"].take(x[t], axis=0, out=room("x", x.shape[1], 3 * k), mode="clip"), before[t], room, kept[t])[0]
            states[t] = h
        at = np.flatnonzero(y.ravel() >= 0)
        if not len(at):
            return grad, h
        every = states.reshape(-1, k)
        if len(at) == len(every):
            dh_all = self.log_probs(every, y.ravel(), grad, room)[1]
        else:
            dh_all = np.zeros_like(every)
            dh_all[at] = self.log_probs(every.take(at, axis=0), y.ravel()[at], grad, room)[1]
        dh_all = dh_all.reshape(states.shape)
        later = np.zeros_like(h)
        # gradients of a, r, z and n beside each other: the first three go back by u, the last three to the input
        back = room("back", *x.shape, 4 * k)
        u = p["u"]
        u_back = np.ascontiguousarray(np.concatenate([u[:, 2 * k :], u[:, : 2 * k]], axis=1).T)
        da, dr, dz, dn = room("of gates", 4, *h.shape)
        for t in range(len(x) - 1, -1, -1):
            r, z, n, a = kept[t]
            dh = dh_all[t]
            dh += later
            np.subtract(1, z, out=dz)
            dz *= dh
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= dz
            n -= before[t]
            dz *= n
            dz *= z
            np.negative(dz, out=dz)
            np.multiply(dn, r, out=da)
            np.subtract(1, r, out=dr)
            dr *= da
            dr *= a
            dh *= z
            for i, d in enumerate((da, dr, dz, dn)):
                back[t, :, i * k : (i + 1) * k] = d
            np.matmul(back[t, :, : 3 * k], u_back, out=later)
            later += dh
            later *= live[t]
        flat = back.reshape(-1, 4 * k)
        du = before.reshape(-1, k).T @ flat[:, : 3 * k]
        grad["u"] += np.concatenate([du[:, k:], du[:, :k]], axis=1)
        grad["n"] += np.ones(len(flat), h.dtype) @ flat[:, :k]
        # rows of the same input are summed in runs
        ids = x.ravel()
        order = np.argsort(ids.astype(np.int16) if len(p["e"]) < 1 << 15 else ids, kind="stable")
        symbols, first, sizes = np.unique(ids[order], return_index=True, return_counts=True)
        rows = flat.take(order, axis=0, out=room("flat", *flat.shape), mode="clip")[:, k:]
        ones = np.ones(sizes.max(), h.dtype)
        for i in np.flatnonzero(sizes > FEW).tolist():
            grad["e"][symbols[i]] += ones[: sizes[i]] @ rows[first[i] : first[i] + sizes[i]]
        # short runs: the first row of each, then the second
        symbols, first, sizes = symbols[sizes <= FEW], first[sizes <= FEW], sizes[sizes <= FEW]
        for i in range(sizes.max(initial=0)):
            more = sizes > i
            grad["e"][symbols[more]] += rows[first[more] + i]
        for g in grad.values():
            g /= np.float32(len(at))
        return grad, h

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural-log probability of each text, its end mark included (buckets: of the bucket only)."""
        if not texts:
            return np.zeros(0)
        # few lanes beside a text that is longer than all others together: the arrays stay about as large as the texts
        longest, total = max(map(len, texts)) + 1, sum(map(len, texts)) + len(texts)
        x, y, of, loads = lanes(texts, max(1, min(SCORE_LANES, len(texts), 4 * total // longest)))
        out = np.zeros(len(texts))
        h, room = np.zeros((x.shape[1], self.hidden), np.float32), Room()
        e, ends = self.p["e"], np.searchsorted(-loads, -np.arange(len(x)))  # lanes with more than t symbols come first
        for at in range(0, len(x), SCORE_WINDOW):
            window = ends[at : at + SCORE_WINDOW].tolist()
            states, end = room("states", sum(window), self.hidden), 0
            for t, n in enumerate(window, at):
                row = x[t, :n]
                before = np.multiply(h[:n], (row != 0)[:, None], out=room("before", n, self.hidden))
                h = self.step(e.take(row, axis=0, out=room("x", n, e.shape[1]), mode="clip"), before, room)[0]
                states[end : end + n] = h
                end += n
            some = np.arange(x.shape[1]) < ends[at : at + SCORE_WINDOW, None]
            logs, _ = self.log_probs(states, y[at : at + SCORE_WINDOW][some], room=room)
            out += np.bincount(of[at : at + SCORE_WINDOW][some], logs.astype(np.float64), len(texts))
        return out


def lanes(texts: list[np.ndarray], n: int, last: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other in n lanes of about equal length, longest lane first.

    (inputs, targets, text of each symbol, symbols in each lane): inputs start with 0, targets end with 0, or
    with none (-1) where last is false.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    heap, held = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for i in order:
        load, lane = heapq.heappop(heap)
        held[lane].append(i)
        heapq.heappush(heap, (load + len(texts[i]) + 1, lane))
    loads = np.array([sum(len(texts[i]) + 1 for i in lane) for lane in held])
    held = [held[k] for k in np.argsort(-loads, kind="stable")]
    loads = -np.sort(-loads, kind="stable")
    x, y, of = (np.full((int(loads[0]), n), fill, np.int32) for fill in (0, -1, 0))
    for k, lane in enumerate(held):
        at = 0
        for i in lane:
            size = len(texts[i])
            x[at + 1 : at + 1 + size, k] = texts[i]
            y[at : at + size, k] = texts[i]
            y[at + size, k] = 0 if last is None or last[i] else -1
            of[at : at + size + 1, k] = i
            at += size + 1
    return x, y, of, loads
