"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, emissions and decoding."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Parameters by name; `chars` is the alphabet (place 0 pads, place 1 is any other character), `tags` the labels."""

    def __init__(self, chars: str, tags: list[str], dim: int = 24, hidden: int = 40, seed: int = 7, params: dict[str, np.ndarray] | None = None):
        self.chars, self.tags, self.dim, self.hidden = chars, tags, dim, hidden
        self.code = {c: i + 2 for i, c in enumerate(chars)}
        if params is not None:
            self.p = {k: v.astype(np.float32) for k, v in params.items()}
        else:
            r = np.random.default_rng(seed)
            n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
            k = len(tags)
            self.p = {"embed": n(len(chars) + 2, dim) * 2, "out": n(2 * hidden, k), "out_b": np.zeros(k, np.float32), "move": np.zeros((k, k), np.float32), "start": np.zeros(k, np.float32)}
            for d in "fb":
                self.p |= {f"x{d}": n(dim, 4 * hidden), f"h{d}": n(hidden, 4 * hidden), f"c{d}": np.concatenate((np.ones(hidden), np.zeros(3 * hidden))).astype(np.float32)}
        self._tables: dict[str, np.ndarray] = {}

    def codes(self, text: str) -> list[int]:
        get = self.code.get
        return [get(c, 1) for c in text]

    def _lstm(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states [T, B, H] of one direction; x holds codes [T, B]."""
        H, p = self.hidden, self.p
        if keep is None:  # inference: the input's share of each gate is looked up by character
            table = self._tables.get(d)
            if table is None:
                table = self._tables[d] = p["embed"] @ p[f"x{d}"] + p[f"c{d}"]
        T, B = x.shape
        h, c, out = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32), np.empty((T, B, H), np.float32)
        w = p[f"h{d}"]
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            z = h @ w
            z += table[x[t]] if keep is None else keep[0][t]
            g = sigmoid(z[:, : 3 * H])
            f, i, o, u = g[:, :H], g[:, H : 2 * H], g[:, 2 * H :], np.tanh(z[:, 3 * H :])
            m = mask[t][:, None]
            c2 = f * c + i * u
            e = np.tanh(c2)
            if keep is not None:
                keep[1].append((t, f, i, o, u, c, e, h, m))
            h = m * (o * e) + (1 - m) * h
            c = m * c2 + (1 - m) * c
            out[t] = h
        return out

    def emissions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """[T, B, tags] of codes [T, B]."""
        H = self.hidden
        return self._lstm("f", x, mask, None) @ self.p["out"][:H] + self._lstm("b", x, mask, None) @ self.p["out"][H:] + self.p["out_b"]

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Best tag sequences of emissions [T, B, tags] under the transitions."""
        T, B, K = e.shape
        s = self.p["start"] + e[0]
        back = np.zeros((T, B, K), np.int8)
        last = np.array(lengths) - 1
        final = np.where((last == 0)[:, None], s, 0)
        for t in range(1, T):
            z = s[:, :, None] + self.p["move"]
            back[t] = z.argmax(axis=1)
            s = np.take_along_axis(z, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + e[t]
            final = np.where((last == t)[:, None], s, final)
        at = final.argmax(axis=1)
        out = np.zeros((T, B), np.int8)
        rows = np.arange(B)
        for t in range(T - 1, -1, -1):
            at = np.where(t == last, final.argmax(axis=1), at)
            out[t] = at
            at = np.where(t <= last, back[t][rows, at], at)
        return [out[: n, b] for b, n in enumerate(lengths)]

    def loss_and_grads(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tag sequences y [T, B], and its gradients."""
        p, H = self.p, self.hidden
        T, B = x.shape
        emb = p["embed"][x]
        kept = {d: [emb @ p[f"x{d}"] + p[f"c{d}"], []] for d in "fb"}
        hf, hb = (self._lstm(d, x, mask, kept[d]) for d in "fb")
        h = np.concatenate((hf, hb), axis=2)
        e = h @ p["out"] + p["out_b"]
        # CRF: forward and backward in log space
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        K = e.shape[2]
        alpha, beta = np.zeros((T, B, K)), np.zeros((T, B, K))
        alpha[0] = p["start"] + e[0]
        for t in range(1, T):
            a = lse(alpha[t - 1][:, :, None] + p["move"], 1) + e[t]
            alpha[t] = np.where(mask[t][:, None] > 0, a, alpha[t - 1])
        for t in range(T - 2, -1, -1):
            b = lse(p["move"][None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1][:, None] > 0, b, 0)
        z = lse(alpha[-1], 1)
        unary = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
        rows, n = np.arange(B), B
        gold = (p["start"][y[0]] + e[0][rows, y[0]]).astype(float)
        move_g, start_g = np.zeros((K, K)), unary[0].sum(axis=0)
        np.add.at(start_g, y[0], -1)
        for t in range(1, T):
            m = mask[t]
            gold += m * (p["move"][y[t - 1], y[t]] + e[t][rows, y[t]])
            both = np.exp(alpha[t - 1][:, :, None] + p["move"] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            move_g += (both * m[:, None, None]).sum(axis=0)
            np.add.at(move_g, (y[t - 1], y[t]), -m)
        unary[np.arange(T)[:, None], rows[None], y] -= mask
        de = (unary / n).astype(np.float32)
        g = {"out": np.tensordot(h, de, ((0, 1), (0, 1))), "out_b": de.sum(axis=(0, 1)), "move": move_g / n, "start": start_g / n, "embed": np.zeros_like(p["embed"])}
        dh = de @ p["out"].T
        demb = np.zeros_like(emb)
        for d, part in (("f", dh[:, :, :H]), ("b", dh[:, :, H:])):
            dz_all = np.zeros((T, B, 4 * H), np.float32)
            hs, dhn, dcn = np.zeros((T, B, H), np.float32), np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
            for t, f, i, o, u, c, ex, hp, m in reversed(kept[d][1]):
                dht = part[t] + dhn
                do, dc = dht * m * ex, dcn * m + dht * m * o * (1 - ex * ex)
                dz = np.concatenate((dc * c * f * (1 - f), dc * u * i * (1 - i), do * o * (1 - o), dc * i * (1 - u * u)), axis=1)
                dz_all[t], hs[t] = dz, hp
                dhn = dz @ p[f"h{d}"].T + dht * (1 - m)
                dcn = dc * f + dcn * (1 - m)
            g[f"h{d}"] = np.tensordot(hs, dz_all, ((0, 1), (0, 1)))
            g[f"x{d}"] = np.tensordot(emb, dz_all, ((0, 1), (0, 1)))
            g[f"c{d}"] = dz_all.sum(axis=(0, 1))
            demb += dz_all @ p[f"x{d}"].T
        np.add.at(g["embed"], x.ravel(), demb.reshape(-1, self.dim))
        return float((z - gold).mean()), g

    def train(self, texts: list[list[int]], tags: list[list[int]], epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 7, log=None) -> None:
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        total = epochs * len(groups)
        for ep in range(epochs):
            loss = 0.0
            for k in r.permutation(len(groups)):
                own = groups[k]
                x, mask = pad([texts[i] for i in own])
                y, _ = pad([tags[i] for i in own])
                one, g = self.loss_and_grads(x, mask, y)
                loss += one
                step += 1
                now = rate * (1 - step / total) + 1e-5
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for name, a in g.items():
                    a = (a * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                    m[name] += 0.1 * (a - m[name])
                    v[name] += 0.01 * (a * a - v[name])
                    self.p[name] -= now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
            if log:
                log(f"epoch {ep + 1}: loss {loss / len(groups):.4f}")
        self._tables.clear()


def pad(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows side by side [T, B], and which places they fill."""
    T = max(map(len, rows))
    x, mask = np.zeros((T, len(rows)), np.int64), np.zeros((T, len(rows)), np.float32)
    for b, r in enumerate(rows):
        x[: len(r), b], mask[: len(r), b] = r, 1
    return x, mask
