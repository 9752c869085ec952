"""A bidirectional gated recurrent network over bytes, in numpy: trained by
backpropagation through time, it labels every byte position of a text."""

from __future__ import annotations

import io

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) + np.float32(0.5) * np.tanh(x * np.float32(0.5))


def pad(seqs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes [n, width] padded right, the same with each text reversed, lengths)."""
    lens = np.array([len(s) for s in seqs], np.int64)
    x = np.zeros((len(seqs), width), np.uint8)
    y = np.zeros((len(seqs), width), np.uint8)
    for i, s in enumerate(seqs):
        a = np.frombuffer(s, np.uint8)
        x[i, : len(a)] = a
        y[i, : len(a)] = a[::-1]
    return x, y, lens


class ByteGRU:
    """Weights: for each direction ``wx`` [256, 3h] and ``u`` [h, 3h] (update,
    reset, candidate), and the output ``v`` [2h, classes], ``c`` [classes]."""

    def __init__(self, classes: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.classes = h, classes
        f = np.float32
        self.w = {"c": np.zeros(classes, f), "v": rng.normal(0, 0.3, (2 * h, classes)).astype(f)}
        for d in "fb":
            self.w["wx" + d] = rng.normal(0, 0.3, (256, 3 * h)).astype(f)
            self.w["wx" + d][:, :h] += 1  # remember at first
            self.w["u" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(f)

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        """States [t, n, h] over the columns of ``x``; with ``keep`` all gates."""
        n, steps = x.shape
        h3, h = 3 * self.hidden, self.hidden
        wx, u = self.w["wx" + d], self.w["u" + d]
        out = np.empty((steps + 1, n, h), np.float32)
        out[0] = 0
        gates = []
        for t in range(steps):
            gx = wx[x[:, t]]
            gh = out[t] @ u
            zr = _sigmoid(gx[:, : 2 * h] + gh[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            cand = np.tanh(gx[:, 2 * h : h3] + r * gh[:, 2 * h :])
            np.add(cand, z * (out[t] - cand), out=out[t + 1])
            if keep:
                gates.append((z, r, cand, gh[:, 2 * h :]))
        return (out, gates) if keep else out[1:]

    @staticmethod
    def _flip(states: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """States of reversed texts put back at the positions they stand for."""
        steps, n, _ = states.shape
        at = lens[None, :] - 1 - np.arange(steps)[:, None]
        return states[np.maximum(at, 0), np.arange(n)[None, :]]

    def log_probs(self, seqs: list[bytes], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities [t, n, classes] of every position, lengths)."""
        x, y, lens = pad(seqs, width or max(1, max(map(len, seqs))))
        hf, hb = self._run(x, "f"), self._flip(self._run(y, "b"), lens)
        h = self.hidden
        logits = hf @ self.w["v"][:h] + hb @ self.w["v"][h:] + self.w["c"]
        logits -= logits.max(-1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(-1, keepdims=True))
        return logits, lens

    def pooled(self, seqs: list[bytes], batch: int = 512, window: int = 256) -> np.ndarray:
        """[n, classes] sum of the positions' log probabilities of each text;
        texts beyond ``window`` bytes are labelled window by window."""
        pieces = [(i, s[k : k + window]) for i, s in enumerate(seqs) for k in range(0, max(1, len(s)), window)]
        pieces.sort(key=lambda p: len(p[1]))
        out = np.zeros((len(seqs), self.classes), np.float64)
        for lo in range(0, len(pieces), batch):
            part = [p for p in pieces[lo : lo + batch] if p[1]]
            if not part:
                continue
            lp, lens = self.log_probs([p[1] for p in part])
            lp *= (np.arange(lp.shape[0])[:, None] < lens[None, :])[:, :, None]
            np.add.at(out, [p[0] for p in part], lp.sum(0))
        return out

    def gradients(self, seqs: list[bytes], labels: np.ndarray, width: int) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss over positions, gradients) by backpropagation through time."""
        x, y, lens = pad(seqs, width)
        n, h = len(seqs), self.hidden
        of, gf = self._run(x, "f", True)
        ob, gb = self._run(y, "b", True)
        hb = self._flip(ob[1:], lens)
        hid = np.concatenate([of[1:], hb], -1)
        logits = hid @ self.w["v"] + self.w["c"]
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        mask = (np.arange(width)[:, None] < lens[None, :]).astype(np.float32)
        total = mask.sum()
        loss = -(np.log(p[:, np.arange(n), labels] + 1e-9) * mask).sum() / total
        p[:, np.arange(n), labels] -= 1
        p *= mask[:, :, None] / total
        grads = {"v": hid.reshape(-1, 2 * h).T @ p.reshape(-1, self.classes), "c": p.sum((0, 1))}
        dhid = p @ self.w["v"].T
        for d, out, gates, x_, dh_all in (("f", of, gf, x, dhid[:, :, :h]), ("b", ob, gb, y, self._flip(dhid[:, :, h:] * mask[:, :, None], lens) * mask[:, :, None])):
            u = self.w["u" + d]
            du = np.zeros_like(u)
            dgx = np.empty((width, n, 3 * h), np.float32)
            dh = np.zeros((n, h), np.float32)
            for t in range(width - 1, -1, -1):
                z, r, cand, ghn = gates[t]
                prev = out[t]
                dh = dh + dh_all[t]
                dcand = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (prev - cand) * z * (1 - z)
                dr = dcand * ghn * r * (1 - r)
                dgx[t] = np.concatenate([dz, dr, dcand], 1)
                dgh = np.concatenate([dz, dr, dcand * r], 1)
                du += prev.T @ dgh
                dh = dh * z + dgh @ u.T
            flat, byte = dgx.reshape(-1, 3 * h), x_.T.reshape(-1)
            order = np.argsort(byte, kind="stable")
            first = np.flatnonzero(np.diff(byte[order].astype(np.int64), prepend=-1))
            dwx = np.zeros((256, 3 * h), np.float32)
            dwx[byte[order][first]] = np.add.reduceat(flat[order], first)
            grads["wx" + d], grads["u" + d] = dwx, du
        return float(loss), grads

    def fit(self, seqs: list[bytes], labels: np.ndarray, weights: np.ndarray | None = None, width: int = 48, batch: int = 128, steps: int = 240, rate: float = 0.02, seed: int = 7, average: float = 0.98) -> list[float]:
        """Adam over random windows of ``width`` bytes, a class
        as often as the root of its number of texts, a text by its weight. The
        result is the running average of the weights over the last 40 % of the
        steps, which varies less than where the last step happens to end."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses, mean = [], None
        groups = [g for k in range(self.classes) if len(g := np.flatnonzero(labels == k))]
        cums = [np.cumsum(np.ones(len(g)) if weights is None else weights[g]) for g in groups]
        share = np.sqrt([len(g) for g in groups])
        for step in range(steps):
            pick = np.concatenate([g[np.searchsorted(c, rng.random(max(1, round(batch * x))) * c[-1], "right")] for g, c, x in zip(groups, cums, share / share.sum())])
            part = []
            for i in pick:
                at = rng.integers(0, max(1, len(seqs[i]) - width + 1))
                part.append(seqs[i][at : at + width])
            if step > 0.6 * steps:
                mean = {k: average * mean[k] + (1 - average) * w for k, w in self.w.items()} if mean else dict(self.w)
            loss, grads = self.gradients(part, labels[pick], width)
            losses.append(loss)
            lr = rate * min(1, (step + 1) / 20) * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - lr * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(s[k] / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
        if mean:
            self.w = {k: w.astype(np.float32) for k, w in mean.items()}
        return losses

    def dump(self) -> bytes:
        """The weights as bytes."""
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> ByteGRU:
        w = dict(np.load(io.BytesIO(data)))
        net = ByteGRU(len(w["c"]), len(w["v"]) // 2)
        net.w = w
        return net
