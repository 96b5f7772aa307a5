"""Character-level bidirectional LSTM with a CRF on top, in numpy.

It is trained by gradient descent on labelled spans that ``examples`` draws from
a fixed seed and puts into running text: personal data in the spellings that
patterns miss (no plus sign, dots for blanks, "(at)", "at ... dot", "[.]") and in
the plain ones, among sentences, shouted and marked words, amounts, dates,
hexadecimal strings and version numbers that are none. ``examples`` of another
seed are the held-out set.

A step of the LSTM reads two characters and scores the tags of both, so windows
have an even length.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # none; for each kind its first and its further characters
EMBED, HIDDEN, LENGTH = 12, 10, 56
STEPS, BATCH, RATE, SEED = 1000, 64, 0.03, 11
_PLAIN = string.ascii_lowercase + " \n" + string.punctuation
DIGIT, UPPER_OR_OTHER, PAD = len(_PLAIN) + 1, len(_PLAIN) + 2, 0
SYMBOLS = UPPER_OR_OTHER + 1
_CODE = np.full(128, UPPER_OR_OTHER, np.int16)
for _i, _c in enumerate(_PLAIN, 1):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i
_CODE[48:58] = DIGIT


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _CODE[np.minimum(points, 127)], UPPER_OR_OTHER).astype(np.int16)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


_PARTS = "en ta or il ma ou st er io ne ch th de la un ze go wh ing tion dé ß ñ ê".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_PARTS) for _ in range(r.randint(1, 5)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.digits) for _ in range(n))


def personal(r: random.Random) -> tuple[str, str]:
    """Kind and spelling of one piece of personal data."""
    kind = r.choice(KINDS)
    ascii_word = lambda: "".join(c for c in _word(r) if c.isascii()) or "me"
    if kind == "email":
        plain = [("@", ".")] * 2
        at, dot = r.choice([*plain, (" (at) ", "."), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT ")])
        name = ascii_word() + r.choice(["", ".", "_", "-"]) + r.choice(["", ascii_word(), str(r.randint(1, 99))])
        return kind, name.rstrip("._-") + at + ascii_word() + r.choice(["", str(r.randint(1, 9))]) + dot + r.choice(["example" + dot + "com", "org", "net", "com", "de", "fr"])
    if kind == "ip":
        return kind, r.choice([".", ".", "[.]", " . ", "(.)", ". "]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = _digits(r, r.choice([15, 16, 16, 16, 19]) - 1)
        d += next(c for c in string.digits if luhn(d + c))
        gap = r.choice(["", "", " ", "-", ".", "/", "  ", "_"])
        return kind, gap.join(d[i : i + 4] for i in range(0, len(d), 4))
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    head = r.choice(["", "", f"+{r.randint(1, 99)} ", f"00{r.randint(1, 99)} "])
    return kind, head + r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"{a} {b} {c}", f"{a} {b} {c}", f"{a}/{b}-{c}"])


def _harmless(r: random.Random) -> str:
    n = r.randint
    return r.choice([
        lambda: str(n(0, 99999)), lambda: f"{n(1, 31):02}/{n(1, 12):02}/{n(1950, 2030)}", lambda: f"{n(1950, 2030)}-{n(1, 12):02}-{n(1, 28):02}",
        lambda: f"{n(1, 999)}.{n(0, 999):03},{n(0, 99):02}", lambda: f"{n(1, 12)}.{n(0, 30)}.{n(0, 9)}", lambda: f'token = "{r.getrandbits(160):040x}"',
        lambda: f"{r.getrandbits(64):016x}", lambda: f"{n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}", lambda: f"#{n(1, 9999)}", lambda: f"{n(1, 99)}%",
        lambda: _digits(r, n(6, 20)), lambda: f"@{_word(r)}", lambda: f"{_word(r)} @ {n(1, 99)}", lambda: f"art. {n(1, 200)} ({n(1, 20)}) {n(1, 9)}", lambda: _word(r) + "(at)",
        lambda: "-".join(str(n(1, 99)) for _ in range(n(2, 5))), lambda: " ".join(str(n(1, 999)) for _ in range(n(2, 6))), lambda: "at " + _word(r), lambda: "dot " + _word(r),
        lambda: f"{n(1, 999)},{n(0, 999):03},{n(0, 999):03}", lambda: f"{n(1, 300)}. {n(1, 300)}.", lambda: r.choice("|*#$%&!<>-=_") * n(2, 9), lambda: f"http://{_word(r)}.org/{n(1, 9999)}",
    ])()


def sample(r: random.Random, size: int, rate: float) -> tuple[str, list[int]]:
    """Running text of ``size`` characters at least and the tag of each; ``rate`` of its items are personal."""
    parts, tags, length = [], [], 0
    marks = r.choice(["", "", "", "", "!!", "***", "&&&", "###", "%%%"])
    shouted = r.random() < 0.08
    capital = True
    while length < size:
        draw, new = r.random(), None
        if draw < rate:
            new, part = personal(r)
        elif draw < rate + 0.08:
            part = _harmless(r)
        else:
            part = r.choice([_word(r)] * 5 + ["at", "dot", "the", "de", "un", "que", "der"])
            part = part.upper() if shouted or r.random() < 0.03 else part.capitalize() if capital or r.random() < 0.06 else part
        k = 0 if new is None else 1 + 2 * KINDS.index(new)
        end = r.choice([""] * 12 + [",", ".", ".", "?", ";"]) if not marks or r.random() < 0.5 else marks
        gap = end + r.choice([" "] * 14 + ["\n", " | "])
        capital = end in (".", "?")
        parts += [part, gap]
        tags += [k] + [k + bool(k)] * (len(part) - 1) + [0] * len(gap)
        length += len(part) + len(gap)
    return "".join(parts), tags


def examples(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``LENGTH`` characters and the tag of each; some end early, as texts do."""
    r = random.Random(seed)
    x, y = np.full((n, LENGTH), PAD, np.int16), np.zeros((n, LENGTH), np.int8)
    for i in range(n):
        text, tags = sample(r, 2 * LENGTH, r.choice([0.0, 0.12, 0.3]))
        at = r.choice([0, r.randint(0, LENGTH), r.randint(0, LENGTH)])
        m = LENGTH if r.random() < 0.9 else r.randint(1, LENGTH)
        x[i, :m], y[i, :m] = encode(text[at : at + m]), tags[at : at + m]
    return x, y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"embed": draw(SYMBOLS, EMBED), "out": draw(2 * HIDDEN, 2 * TAGS), "bias": np.zeros(2 * TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            self.p |= {f"{way}x": draw(2 * EMBED, 4 * HIDDEN), f"{way}h": draw(HIDDEN, 4 * HIDDEN), f"{way}b": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"{way}b"][HIDDEN : 2 * HIDDEN] = 1

    def _inputs(self, way: str) -> tuple[np.ndarray, np.ndarray]:
        """The input's part of the gates for each symbol as the first and the second of its pair."""
        p = self.p
        return p["embed"] @ p[f"{way}x"][:EMBED] + p[f"{way}b"], p["embed"] @ p[f"{way}x"][EMBED:]

    def _lstm(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, row, hidden) of pairs (row, time, 2); way b reads from the end."""
        t, n, h = x.shape[1], x.shape[0], HIDDEN
        one, two = self._inputs(way)
        state, cell, out = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((t, n, h), np.float32)
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            g = one[x[:, i, 0]] + two[x[:, i, 1]] + state @ self.p[f"{way}h"]
            s, new = _sigmoid(g[:, : 3 * h]), np.tanh(g[:, 3 * h :])
            a, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            before, last = cell, state
            cell = f * cell + a * new
            squashed = np.tanh(cell)
            state = o * squashed
            out[i] = state
            if keep is not None:
                keep.append((i, a, f, o, new, before, squashed, last))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, tag, row) of windows (row, time): gates lie row after row, so each is one contiguous block."""
        p, h = self.p, HIDDEN
        x = np.ascontiguousarray((x[:, ::2].astype(np.intp) * SYMBOLS + x[:, 1::2]).T)
        t, n = x.shape
        out = np.empty((t, 2 * h, n), np.float32)
        half = np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(np.float32)[:, None]  # a sigmoid is a tanh of half
        for k, way in enumerate("fb"):
            one, two = self._inputs(way)
            inputs = np.ascontiguousarray((one[:, None] + two[None]).reshape(SYMBOLS * SYMBOLS, -1).T * half)
            weights = np.ascontiguousarray(p[f"{way}h"].T * half)
            gates, more = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
            state, cell, part = (np.zeros((h, n), np.float32) for _ in range(3))
            for i in range(t) if way == "f" else range(t - 1, -1, -1):
                np.take(inputs, x[i], axis=1, out=gates, mode="clip")
                gates += np.matmul(weights, state, out=more)
                np.tanh(gates, out=gates)
                s = gates[: 3 * h]
                s *= 0.5
                s += 0.5
                cell *= s[h : 2 * h]
                cell += np.multiply(s[:h], gates[3 * h :], out=part)
                np.multiply(s[2 * h :], np.tanh(cell, out=part), out=state)
                out[i, k * h : (k + 1) * h] = state
        return (np.matmul(np.ascontiguousarray(p["out"].T), out) + p["bias"][:, None]).reshape(2 * t, TAGS, n)

    def none_best(self, e: np.ndarray, margin: float = 1e-3) -> np.ndarray:
        """For each row of emissions (time, tag, row), whether no path beats that of no tag by more than ``margin``."""
        step = self.p["step"][:, :, None]
        score = e[0]
        for i in range(1, len(e)):
            score = (score[:, None, :] + step).max(axis=0) + e[i]
        return score.max(axis=0) <= e[:, 0].sum(axis=0) + (len(e) - 1) * step[0, 0] + margin

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tag sequence of each row (row, time)."""
        return self.paths(self.emissions(x))

    def paths(self, e: np.ndarray) -> np.ndarray:
        """The best tag sequence (row, time) under the CRF for emissions (time, tag, row)."""
        step = self.p["step"]
        scores = [e[0]]
        for i in range(1, len(e)):
            scores.append((scores[-1][:, None, :] + step[:, :, None]).max(axis=0) + e[i])
        tags = np.zeros((e.shape[2], len(e)), np.int8)
        at = scores[-1].argmax(axis=0)
        tags[:, -1] = at
        for i in range(len(e) - 1, 0, -1):
            at = (scores[i - 1] + step[:, at]).argmax(axis=0)
            tags[:, i - 1] = at
        return tags

    def score(self, e: np.ndarray, tags: np.ndarray) -> float:
        """How much better a span's tags are than none, from its emissions (time, tag)."""
        step, path = self.p["step"], [0, *tags.tolist(), 0]
        moves = sum(float(step[a, b]) for a, b in zip(path, path[1:], strict=False)) - (len(path) - 1) * float(step[0, 0])
        return moves + float(e[np.arange(len(tags)), tags].sum() - e[:, 0].sum())

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences and its gradients."""
        p, n, h = self.p, len(x), HIDDEN
        kept: dict[str, list] = {"f": [], "b": []}
        x = x.reshape(n, -1, 2)
        states = np.concatenate([self._lstm(x, w, kept[w]) for w in "fb"], axis=2)
        e = (states @ p["out"] + p["bias"]).reshape(-1, n, 2, TAGS).transpose(0, 2, 1, 3).reshape(-1, n, TAGS)
        t, step, rows = len(e), p["step"], np.arange(n)
        ahead, after = [e[0]], [np.zeros_like(e[0])]
        for i in range(1, t):
            ahead.append(_logsum(ahead[-1][:, :, None] + step[None], 1) + e[i])
        for i in range(t - 1, 0, -1):
            after.append(_logsum(step[None] + (after[-1] + e[i])[:, None, :], 2))
        after.reverse()
        total = _logsum(ahead[-1], 1)
        gold = sum(e[i][rows, y[:, i]] for i in range(t)) + sum(step[y[:, i - 1], y[:, i]] for i in range(1, t))
        de = np.exp(np.stack(ahead) + np.stack(after) - total[None, :, None])
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        for i in range(1, t):
            pair = ahead[i - 1][:, :, None] + step[None] + (after[i] + e[i])[:, None, :] - total[:, None, None]
            grads["step"] += np.exp(pair).sum(axis=0) / n
        np.add.at(grads["step"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1 / n)
        for i in range(t):
            de[i, rows, y[:, i]] -= 1
        de = (de / n).astype(np.float32)
        de = de.reshape(-1, 2, n, TAGS).transpose(0, 2, 1, 3).reshape(-1, n, 2 * TAGS)
        grads["out"] = states.reshape(-1, 2 * h).T @ de.reshape(-1, 2 * TAGS)
        grads["bias"] = de.sum(axis=(0, 1))
        dstates = de @ p["out"].T
        for w, part in (("f", dstates[:, :, :h]), ("b", dstates[:, :, h:])):
            one, two, every = np.zeros((SYMBOLS, 4 * h), np.float32), np.zeros((SYMBOLS, 4 * h), np.float32), np.arange(SYMBOLS)[:, None]
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for i, a, f, o, new, before, squashed, last in reversed(kept[w]):
                dh = dh + part[i]
                dc = dc + dh * o * (1 - squashed**2)
                dg = np.concatenate([dc * new * a * (1 - a), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * a * (1 - new**2)], axis=1)
                grads[f"{w}h"] += last.T @ dg
                one += (x[:, i, 0] == every).astype(np.float32) @ dg
                two += (x[:, i, 1] == every).astype(np.float32) @ dg
                dh, dc = dg @ p[f"{w}h"].T, dc * f
            grads[f"{w}b"] = one.sum(axis=0)
            grads[f"{w}x"] = np.concatenate([p["embed"].T @ one, p["embed"].T @ two])
            grads["embed"] += one @ p[f"{w}x"][:EMBED].T + two @ p[f"{w}x"][EMBED:].T
        return float((total - gold).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> list[float]:
        rng, losses = np.random.default_rng(SEED), []
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for s in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            loss, grads = self.gradients(x[pick], y[pick].astype(np.int64))
            losses.append(loss)
            rate = RATE * min(1, 2 * (1 - s / (steps + 1)))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.p[k] -= (rate * mean[k] / (1 - 0.9**s) / (np.sqrt(square[k] / (1 - 0.99**s)) + 1e-6)).astype(np.float32)
        return losses


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger for the fixed seed; a process trains it once."""
    tagger = Tagger()
    tagger.train(*examples(8000))
    return tagger
