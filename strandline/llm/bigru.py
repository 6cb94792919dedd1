"""A bidirectional gated recurrent network over bytes that labels every position, in numpy.

Arrays are feature-major, [direction, feature, lane], so that each step of both
directions is a handful of whole-array operations over all lanes. Direction 0
reads forwards, direction 1 backwards. Training is backpropagation through time
with Adam; labelling carries the state over whole texts, however long.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np

#: Texts that are read side by side; numbers that are held of bytes which one direction has read (50 MB, and twice that at most); steps that are labelled at once.
LANES, HELD, BLOCK = 384, 12 << 20, 128


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return (1 + np.tanh(a / 2)) / 2


class BiGRU:
    """``wx`` [2, 3H, 256] is a byte's input to update, reset and candidate, ``u`` [2, 3H, H] the state's, ``b`` [2, 3H, 1]; ``v`` [2, C, H] and ``c`` [C, 1] label a position."""

    def __init__(self, classes: list[str], hidden: int = 12, seed: int = 7):
        rng, self.classes, self.h = np.random.default_rng(seed), classes, hidden
        p = {"wx": rng.normal(0, 0.5, (2, 3 * hidden, 256)), "u": rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)), "b": np.zeros((2, 3 * hidden, 1))}
        p |= {"v": rng.normal(0, 0.3, (2, len(classes), hidden)), "c": np.zeros((len(classes), 1))}
        self.p = {k: x.astype(np.float32) for k, x in p.items()}

    def _scan(self, xs: list[np.ndarray], h: np.ndarray, resets: list[dict], keep: np.ndarray | None, dirs: slice) -> np.ndarray:
        """Read ``xs`` (for each direction, bytes [T, B] in its own order) from state ``h`` [D, H, B]; what each state says of its byte goes to ``keep`` [D, C, T, B].

        ``resets``: for each direction, which lanes begin a text at a step.
        """
        n, p = self.h, self.p
        # A gate is (1 + tanh(a / 2)) / 2; the halves go into the weights where they can.
        half = np.repeat(np.float32([0.5, 1]), [2 * n, n])[:, None]
        u, v = (p["u"] * np.float32(0.5))[dirs], p["v"][dirs]
        # A byte's numbers side by side are taken at once and then turned, which beats picking them one by one.
        table, taken = np.ascontiguousarray(((p["wx"] + p["b"]) * half)[dirs].transpose(0, 2, 1)), np.empty((h.shape[2], 3 * n), np.float32)
        # One product gives a state's part of the gates and, behind them, what it says of the byte before.
        w = u if keep is None else np.concatenate([u, v], 1)
        a, g, zr = (np.empty((len(xs), k, h.shape[2]), np.float32) for k in (3 * n, w.shape[1], 2 * n))
        c, r, z = np.empty_like(h), zr[:, n:], zr[:, :n]
        a_gates, a_new, g_gates, g_new, one, half = a[:, : 2 * n], a[:, 2 * n :], g[:, : 2 * n], g[:, 2 * n : 3 * n], np.float32(1), np.float32(0.5)
        for t in range(len(xs[0])):
            np.matmul(w, h, out=g)
            if keep is not None and t:
                keep[:, :, t - 1] = g[:, 3 * n :]
            for d, x in enumerate(xs):
                table[d].take(x[t], axis=0, out=taken, mode="clip")
                a[d] = taken.T
                if (lanes := resets[d].get(t)) is not None:
                    h[d][:, lanes] = 0
                    g[d][:, lanes] = 0
            np.add(a_gates, g_gates, out=zr)
            np.tanh(zr, out=zr)
            np.add(zr, one, out=zr)
            np.multiply(r, g_new, out=c)
            np.add(c, a_new, out=c)
            np.tanh(c, out=c)
            np.subtract(h, c, out=h)
            np.multiply(h, z, out=h)
            np.multiply(h, half, out=h)
            np.add(h, c, out=h)
        if keep is not None and len(xs[0]):
            keep[:, :, -1] = np.matmul(v, h)
        return h

    def pooled(self, texts: list[bytes], lanes: int = LANES, held: int | None = None) -> np.ndarray:
        """For each text, the sum over all its bytes of their class probabilities: [len(texts), C].

        Texts are read longest first, a part at a time: those that ``held``
        positions hold in ``lanes`` are read once, from both ends together;
        longer ones stand in one part, whose states are found again.
        """
        held = held or max(lanes, HELD // len(self.classes))
        out = np.zeros((len(texts), len(self.classes)))
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        # Long ones stay together, as there are no more lanes than the longest text goes into all of them.
        n = bisect.bisect_left(order, -(held // lanes), key=lambda i: -len(texts[i]))
        parts, size = [order[:n]], held
        for i in order[n:]:
            if size + len(texts[i]) > held:
                parts.append([])
                size = 0
            parts[-1].append(i)
            size += len(texts[i])
        for part in filter(None, parts):
            self._read(texts, part, lanes, held, out)
        return out

    def _read(self, texts: list[bytes], order: list[int], lanes: int, held: int, out: np.ndarray) -> None:
        """Add up the texts ``order``, longest first.

        They follow one another in lanes of about equal length; a state begins
        at zero with each text and is carried to its end. Both directions start
        together; until they have met, what they say is held. Lanes that are
        longer than ``held`` allows are read in stretches: a first pass keeps
        the forward state before each stretch, then stretches are read from the
        last to the first.
        """
        total = sum(len(texts[i]) for i in order)
        lanes = min(lanes, len(order), -(-total // len(texts[order[0]])) + 1)
        heap, dealt, starts = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)], [[] for _ in range(lanes)]
        for i in order:
            size, k = heap[0]
            dealt[k].append(i)
            starts[k].append(size)
            heapq.heapreplace(heap, (size + len(texts[i]), k))
        steps = max(size for size, _ in heap)
        x = np.zeros((steps, lanes), np.uint8)
        begins: dict[int, list] = {}
        ends: dict[int, list] = {}
        for size, k in heap:
            x[:size, k] = np.frombuffer(b"".join([texts[i] for i in dealt[k]]), np.uint8)
            for at, end in zip(starts[k], [*starts[k][1:], size]):
                begins.setdefault(at, []).append(k)
                ends.setdefault(end - 1, []).append(k)
            starts[k].append(size)
        stretch = steps if steps * lanes <= 2 * held else max(1, held // lanes)
        cuts = [*range(0, steps, stretch), steps]
        state = np.zeros((1, self.h, lanes), np.float32)
        before = [state.copy()]
        for a, b in zip(cuts, cuts[1:-1]):
            state = self._scan([x[a:b]], state, [{t - a: begins[t] for t in range(a, b) if t in begins}], None, slice(0, 1))
            before.append(state.copy())
        back = np.zeros((1, self.h, lanes), np.float32)
        for a, b in reversed(list(zip(cuts, cuts[1:]))):
            h, met = np.concatenate([before.pop(), back]), {}
            # Blocks lie alike from either end, so that both directions come to the same ones.
            front = range(0, (b - a + 1) // 2, BLOCK)
            edges = sorted({*front, *(b - a - k for k in front)})
            blocks = [(a + k, a + e) for k, e in zip(edges, edges[1:])]
            for (k, e), (s, f) in zip(blocks, reversed(blocks)):
                resets = [{t - k: begins[t] for t in range(k, e) if t in begins}, {f - 1 - t: ends[t] for t in range(s, f) if t in ends}]
                keep = np.empty((2, len(self.classes), e - k, lanes), np.float32)
                h = self._scan([x[k:e], x[s:f][::-1]], h, resets, keep, slice(0, 2))
                if k < s:
                    met[k], met[s] = keep[0], keep[1][:, ::-1]
                    continue
                forth, back = keep[0], keep[1][:, ::-1]
                self._add_up(forth + (back if k == s else met.pop(k)), k, dealt, starts, out)
                if k > s:
                    self._add_up(met.pop(s) + back, s, dealt, starts, out)
            back = h[1:].copy()

    def _add_up(self, q: np.ndarray, first: int, dealt: list[list[int]], starts: list[list[int]], out: np.ndarray) -> None:
        """Turn ``q`` [C, T, B] into probabilities of the bytes from ``first`` on, and add them to their texts."""
        q += self.p["c"][:, :, None]
        q -= q.max(0)
        np.exp(q, out=q)
        q /= q.sum(0)
        end, whole, own = first + q.shape[1], q.sum(1), np.full(q.shape[2], -1)
        for lane, s in enumerate(starts):  # whose bytes these are
            i, at = bisect.bisect_right(s, first) - 1, first
            if i + 1 < len(s) and s[i + 1] >= end:
                own[lane], at = dealt[lane][i], end
            while i + 1 < len(s) and at < end:
                upto = min(s[i + 1], end)
                out[dealt[lane][i]] += q[:, at - first : upto - first, lane].sum(1)
                at, i = upto, i + 1
        one = own >= 0
        out[own[one]] += whole[:, one].T

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions of the windows ``x`` [T, B] of classes ``y`` [B], and its gradient."""
        n, p, (t_, b_) = self.h, self.p, x.shape
        kind = p["u"].dtype
        xs, table = np.stack([x, x[::-1]], 1), p["wx"] + p["b"]
        before, z, r, c, g2 = (np.zeros((t_, 2, n, b_), kind) for _ in range(5))
        states, h = np.empty((t_, 2, n, b_), kind), np.zeros((2, n, b_), kind)
        for t in range(t_):
            a, g = np.stack([table[d][:, xs[t, d]] for d in (0, 1)]), np.matmul(p["u"], h)
            zr = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
            before[t], z[t], r[t], g2[t] = h, zr[:, :n], zr[:, n:], g[:, 2 * n :]
            c[t] = np.tanh(a[:, 2 * n :] + r[t] * g2[t])
            h = c[t] + z[t] * (h - c[t])
            states[t] = h
        q = np.matmul(p["v"][0], states[:, 0]) + np.matmul(p["v"][1], states[::-1, 1]) + p["c"]
        q = np.exp(q - q.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        hit = q[:, y, np.arange(b_)]
        loss = float(-np.log(hit + 1e-9).mean())
        q[:, y, np.arange(b_)] -= 1
        q /= t_ * b_
        flat = lambda m: np.moveaxis(m, 1, 0).reshape(m.shape[1], -1)  # noqa: E731  [T, K, B] -> [K, T B]
        own = [q, q[::-1]]  # in each direction's own order
        grad = {"c": q.sum((0, 2))[:, None], "v": np.stack([flat(own[d]) @ flat(states[:, d]).T for d in (0, 1)])}
        side = np.stack([np.matmul(p["v"][d].T, own[d]) for d in (0, 1)], 1)
        into, dg, dh = np.empty((t_, 2, 3 * n, b_), kind), np.empty((t_, 2, 3 * n, b_), kind), np.zeros((2, n, b_), kind)
        ut = p["u"].transpose(0, 2, 1)
        for t in range(t_ - 1, -1, -1):
            dh = dh + side[t]
            dc = dh * (1 - z[t]) * (1 - c[t] * c[t])
            into[t, :, :n] = dh * (before[t] - c[t]) * z[t] * (1 - z[t])
            into[t, :, n : 2 * n] = dc * g2[t] * r[t] * (1 - r[t])
            into[t, :, 2 * n :] = dc
            dg[t] = into[t]
            dg[t, :, 2 * n :] *= r[t]
            dh = dh * z[t] + np.matmul(ut, dg[t])
        grad["u"] = np.stack([flat(dg[:, d]) @ flat(before[:, d]).T for d in (0, 1)])
        grad["wx"], grad["b"] = np.zeros_like(p["wx"]), into.sum((0, 3))[:, :, None]
        for d in (0, 1):
            byte = xs[:, d].ravel()
            order = np.argsort(byte, kind="stable")
            found, first = np.unique(byte[order], return_index=True)
            grad["wx"][d][:, found] = np.add.reduceat(flat(into[:, d])[:, order], first, 1)
        return loss, grad

    def train(self, windows: dict[int, tuple[np.ndarray, np.ndarray]], steps: int = 400, batch: int = 128, rate: float = 0.03, seed: int = 3) -> BiGRU:
        """``windows``: by length, the bytes [N, T] and their classes. Lengths take turns and classes weigh alike."""
        rng, lengths = np.random.default_rng(seed), sorted(windows)
        rows = {t: [np.flatnonzero(windows[t][1] == k) for k in np.unique(windows[t][1])] for t in lengths}
        m = {k: np.zeros_like(w) for k, w in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            t = lengths[step % len(lengths)]
            x, y = windows[t]
            i = np.array([rng.choice(rows[t][k % len(rows[t])]) for k in rng.permutation(max(batch, len(rows[t])))[:batch]])
            _, grad = self.gradient(x[i].T, y[i])
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g / max(1, norm)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self
