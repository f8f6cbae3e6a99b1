"""Personal data by a character-level bidirectional LSTM with CRF transitions.

Base patterns give the certain spans.  The tagger is trained here, in numpy,
on labelled windows: texts of a bounded, hash-chosen sample with the base
spans as labels, and the same windows with their marks varied (other
separators or digits, words for marks, a country code left out), so that it learns the look of a span
rather than the pattern.  Tags are O and begin/inside of each kind; the
forward and backward LSTM give each character's tag scores, the CRF learns
tag transitions; training maximises the CRF likelihood by Adam.

Whole texts are read as windows that overlap by a margin, where two windows'
scores are blended, nearer a window's end counting less.  One Viterbi decoding
decides all tags of a text together.  It is cut exactly: where O leads by more
than any change of transitions could gain, the best path has O there, so the
stretches between such places are decoded alone, and only their scores kept;
a stretch in which O leads everywhere by more than spans can gain a place is O.
Texts of any length are scored a bounded number of characters at a time.

Spans the tagger adds carry the kind they were tagged with; base spans stay,
and an added span never overlaps one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # inside a run of digits no match begins that its start hasn't
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9@]")

WINDOW, STRIDE = 96, 48
SPAN, MARGIN = 512, 32  # of the windows that texts are read by, and what two of them share
SLICE = 7 << 16  # characters scored side by side before their sure ones are let go
REACH = 8  # places looked ahead to be sure of one
LOT = 16  # windows of about one length
ROWS, NEAR = 8, 1 << 14  # steps whose states are turned into scores at a time, and places that are looked at
PIECE = 4096  # characters of a training text
SAMPLE_TEXTS = 1500  # texts, about, that the tagger's windows come from
SAMPLE_WINDOWS = 1200  # and the most windows of them it is trained on
HIDDEN, EMBED, EPOCHS, BATCH = 8, 12, 8, 32
TAGS = 1 + 2 * len(KINDS)
SYMBOLS = 100
LEAST = 6  # characters of an added span


# ---------------------------------------------------------------- base spans
def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by kind as listed and then by start."""
    out = _emails(text)
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of a run of LOCAL, an at sign and a domain: from at
    sign to at sign, as no run crosses one, so a long run is read once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=lambda x: (KINDS.index(x[2]), x[0], x[1])))


# ---------------------------------------------------------------- windows
_CLASS = np.array([c - 30 if 33 <= c < 127 else 2 if c == 32 or 9 <= c <= 13 else 97 for c in range(192)] + [1], np.uint8)


def symbols(text: str) -> np.ndarray:
    """Printable ASCII one by one; other digits, letters, blanks and marks a class each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CLASS[np.minimum(c, 192)]
    if len(c) and not text.isascii():
        wide = np.flatnonzero(c >= 192)
        other, of = np.unique(c[wide], return_inverse=True)
        out[wide[np.array([chr(x).isdecimal() for x in other], bool)[of]]] = 98
    return out


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for a, z, kind in spans:
        if not out[a:z].any():
            out[a:z] = 2 + 2 * KINDS.index(kind)
            out[a] -= 1
    return out


def window_runs(text: str) -> list[tuple[int, int]]:
    """[first, last) characters of the runs of windows that hold every
    digit and at sign with half a window on either side: where the training
    examples come from."""
    runs: list[list[int]] = []
    for m in DIGIT.finditer(text):
        a = max(0, m.start() // STRIDE - 1) * STRIDE
        z = (m.start() // STRIDE + 2) * STRIDE
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(z, runs[-1][1])
        else:
            runs.append([a, z])
    return [(a, min(z, len(text))) for a, z in runs]


# ---------------------------------------------------------------- the tagger
def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place of tanh, a fifth of its time; gates are half of
    it plus a half."""
    return x / (1 + np.abs(x))


def _slope(s: np.ndarray) -> np.ndarray:
    """The derivative of the squashing, by its value."""
    return (1 - np.abs(s)) ** 2


class Tagger:
    """Parameters and passes.  Shapes: (time, batch, width)."""

    def __init__(self, seed: int = 0, weights: dict[str, np.ndarray] | None = None):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = weights or {"E": init(SYMBOLS, EMBED) * 3, "Wf": init(EMBED + HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN, np.float32),
                             "Wb": init(EMBED + HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32),
                             "U": init(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        if not weights:
            self.p["bf"][HIDDEN:2 * HIDDEN] = self.p["bb"][HIDDEN:2 * HIDDEN] = 1.0

    def _lstm(self, x: np.ndarray, W: np.ndarray, b: np.ndarray, keep: bool):
        T, B, _ = x.shape
        h, c, hs, saved = np.zeros((B, HIDDEN), np.float32), np.zeros((B, HIDDEN), np.float32), np.empty((T, B, HIDDEN), np.float32), []
        xw = x @ W[:EMBED] + b
        for t in range(T):
            a = xw[t] + h @ W[EMBED:]
            s = _squash(a)
            i, f, o, g = (s[:, k * HIDDEN: (k + 1) * HIDDEN] / (1 if k == 3 else 2) + (0 if k == 3 else 0.5) for k in range(4))
            before, was = h, c
            c = f * c + i * g
            tc = _squash(c)
            h = o * tc
            hs[t] = h
            if keep:
                saved.append((before, was, i, f, o, g, tc))
        return hs, saved

    def _lstm_back(self, x, W, saved, dh_all):
        dW, db, dx = np.zeros_like(W), np.zeros(4 * HIDDEN, np.float32), np.empty_like(x)
        dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
        for t in range(len(saved) - 1, -1, -1):
            before, was, i, f, o, g, tc = saved[t]
            dh = dh + dh_all[t]
            dc = dc + dh * o * _slope(tc)
            gate = lambda y: _slope(2 * y - 1) / 2
            da = np.concatenate([dc * g * gate(i), dc * was * gate(f), dh * tc * gate(o), dc * i * _slope(g)], axis=1)
            dW[:EMBED] += x[t].T @ da
            dW[EMBED:] += before.T @ da
            db += da.sum(axis=0)
            dx[t] = da @ W[:EMBED].T
            dh, dc = da @ W[EMBED:].T, dc * f
        return dW, db, dx

    def scores(self, chars: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """(batch, time) symbols to (tags, batch, time) scores, which lie in
        memory by time: both LSTMs step by step together, a row per window, so
        that a symbol's share of a gate is one copy.  With ``sizes``, falling,
        a window has so many symbols: the backward LSTM begins at its last, and
        windows that have ended take no further steps.

        The input's share of a gate is a table by symbol; the halves of the
        gates are folded into the weights, so a state is twice the training's."""
        p, (B, T) = self.p, chars.shape
        chars = np.ascontiguousarray(chars, np.uint8)
        sizes = np.full(B, T) if sizes is None else sizes
        runs = np.searchsorted(-sizes, -np.arange(T), "left")  # windows longer than t
        runs = np.minimum(-(-runs // LOT) * LOT, B).tolist()
        gates = lambda w: w.reshape(-1, 4, HIDDEN).swapaxes(0, 1)
        table = np.concatenate([gates(p["E"] @ p[w][:EMBED] + p[b]) for w, b in (("Wf", "bf"), ("Wb", "bb"))], axis=1)
        again = np.stack([gates(p[w][EMBED:] / 2) for w in ("Wf", "Wb")])
        steps = np.empty((T, 2, B), np.uint8)  # of the forward LSTM, and of the backward one as it goes
        steps[:, 0] = chars.T
        full = int(np.searchsorted(-sizes, -T, "right"))
        steps[:, 1, :full] = steps[::-1, 0, :full]
        begun, lanes = np.maximum(sizes[full:] - 1 - np.arange(T)[:, None], 0), np.arange(full, B)  # of shorter windows: the backward step of a place
        steps[:, 1, full:] = chars.reshape(-1).take(lanes * T + begun)
        steps[:, 1] += SYMBOLS
        states, cells = np.empty((2, ROWS, B, HIDDEN), np.float32), np.zeros((2, B, HIDDEN), np.float32)
        out, shorter = np.empty((TAGS, T, B), np.float32), np.empty((T, B - full, HIDDEN), np.float32)
        out[...] = p["c"][:, None, None]
        uf, ub, some = p["U"][:HIDDEN].T / 2, p["U"][HIDDEN:].T / 2, np.empty((TAGS, ROWS * B), np.float32)
        room, n, one, half = np.zeros((3, 4 * 2 * B * HIDDEN), np.float32), -1, np.float32(1), np.float32(0.5)
        for t in range(T):
            if n != runs[t]:
                n = runs[t]
                a, x = (y[: 4 * 2 * n * HIDDEN].reshape(4, 2, n, HIDDEN) for y in room[:2])
                small, cell, halves, (i, f, o, g) = room[2, : 2 * n * HIDDEN].reshape(2, n, HIDDEN), cells[:, :n], a[:3], a
                into = a.swapaxes(0, 1)
            if t:
                np.matmul(states[:, t % ROWS - 1, None, :n], again, out=into)
            table.take(steps[t, :, :n], 1, x, "clip")
            np.add(a, x, a)
            np.abs(a, x)
            np.add(x, one, x)
            np.divide(a, x, a)
            np.add(halves, one, halves)
            np.multiply(cell, f, cell)
            np.multiply(i, g, i)
            np.add(cell, i, cell)
            np.multiply(cell, half, cell)
            np.abs(cell, small)
            np.add(small, one, small)
            np.divide(cell, small, small)
            np.multiply(small, o, states[:, t % ROWS, :n])
            if n < B:
                states[:, t % ROWS, n:] = 0
            if t % ROWS == ROWS - 1 or t == T - 1:  # turned into scores while they are near the CPU
                k = t % ROWS + 1
                more, then = some[:, : k * B], out[:, T - 1 - t: T - 1 - t + k, :full]
                np.matmul(uf, states[0, :k].reshape(-1, HIDDEN).T, out=more)
                out[:, t + 1 - k: t + 1] += more.reshape(TAGS, k, B)
                np.matmul(ub, states[1, :k].reshape(-1, HIDDEN).T, out=more)
                then += more.reshape(TAGS, k, B)[:, ::-1, :full]
                shorter[t + 1 - k: t + 1] = states[1, :k, full:]
        for t in range(0, T if full < B else 0, ROWS):
            rows = shorter.reshape(-1, HIDDEN).take(begun[t: t + ROWS] * len(lanes) + lanes - full, 0)
            out[:, t: t + ROWS, full:] += (ub @ rows.reshape(-1, HIDDEN).T).reshape(TAGS, -1, len(lanes))
        return out.swapaxes(1, 2)

    def gradient(self, chars: np.ndarray, gold: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative CRF log likelihood of the batch and its gradient.
        ``real``: which characters aren't padding (a prefix of each row)."""
        p, x = self.p, self.p["E"][chars.T]
        f, sf = self._lstm(x, p["Wf"], p["bf"], True)
        b, sb = self._lstm(x[::-1], p["Wb"], p["bb"], True)
        hidden = np.concatenate([f, b[::-1]], axis=2)
        unary = (hidden @ p["U"] + p["c"]).astype(np.float64)
        T, B, trans, m = *unary.shape[:2], p["T"].astype(np.float64), real.T[:, :, None]
        alpha, beta = np.empty_like(unary), np.zeros_like(unary)
        alpha[0] = unary[0]
        lse = lambda v, axis: v.max(axis=axis) + np.log(np.exp(v - v.max(axis=axis, keepdims=True)).sum(axis=axis))
        for t in range(1, T):
            alpha[t] = np.where(m[t], lse(alpha[t - 1][:, :, None] + trans, 1) + unary[t], alpha[t - 1])
        for t in range(T - 2, -1, -1):
            beta[t] = np.where(m[t + 1], lse(trans + (unary[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        z = lse(alpha[-1], 1)
        du = np.exp(alpha + beta - z[None, :, None]) * m
        dT = np.zeros_like(trans)
        gold_t, rows, score = gold.T, np.arange(B), np.zeros(B)
        for t in range(T):
            r = real[:, t]
            score += np.where(r, unary[t, rows, gold_t[t]], 0)
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + trans + (unary[t] + beta[t])[:, None, :] - z[:, None, None]) * r[:, None, None]
                dT += pair.sum(axis=0)
                np.subtract.at(dT, (gold_t[t - 1][r], gold_t[t][r]), 1)
                score += np.where(r, trans[gold_t[t - 1], gold_t[t]], 0)
            du[t, rows[r], gold_t[t][r]] -= 1
        du = (du / B).astype(np.float32)
        g = {"T": (dT / B).astype(np.float32), "U": hidden.reshape(-1, 2 * HIDDEN).T @ du.reshape(-1, TAGS), "c": du.sum(axis=(0, 1))}
        dh = du @ p["U"].T
        g["Wf"], g["bf"], dxf = self._lstm_back(x, p["Wf"], sf, dh[:, :, :HIDDEN])
        g["Wb"], g["bb"], dxb = self._lstm_back(x[::-1], p["Wb"], sb, dh[::-1, :, HIDDEN:])
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], chars.T, dxf + dxb[::-1])
        return float((z - score).mean()), g

    def train(self, chars: np.ndarray, gold: np.ndarray, real: np.ndarray, epochs: int = EPOCHS, seed: int = 0, rate: float = 0.01) -> list[float]:
        r = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses, step = [], 0
        for _ in range(epochs):
            order = r.permutation(len(chars))
            for at in range(0, len(order), BATCH):
                pick = order[at: at + BATCH]
                loss, g = self.gradient(chars[pick], gold[pick], real[pick])
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.001 * (v * v - m2[k])
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return losses


def viterbi(unary: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tag sequence; inside tags only follow their own kind."""
    return decoded(unary, np.array([len(unary)]), trans)


def decoded(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tag sequence of each of the texts that lie one after another
    in ``unary``, each text as a whole, all texts step by step together."""
    at = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    lengths, at = lengths[order], at[order]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts longer than t
    begin = np.cumsum(active) - active  # all texts' first places, then the second ones, and so on
    step = np.repeat(np.arange(longest), active)
    turned = at[np.arange(len(step)) - begin[step]] + step
    best, into = np.ascontiguousarray(unary[turned].T), allowed(trans)
    best[2::2, : active[0]] = -1e9
    for t in range(1, longest):
        k, a, z = active[t], begin[t - 1], begin[t]
        best[:, z: z + k] += (best[:, None, a: a + k] + into[:, :, None]).max(axis=0)
    out = np.empty(len(turned), np.int64)
    last = begin[lengths - 1] + np.arange(len(lengths))
    out[last] = best[:, last].argmax(axis=0)
    for t in range(longest - 1, 0, -1):  # the tag before is looked up on the best path alone
        k, a, z = active[t], begin[t - 1], begin[t]
        out[a: a + k] = (best[:, a: a + k] + into[:, out[z: z + k]]).argmax(axis=0)
    tags = np.empty_like(out)
    tags[turned] = out
    return tags


def allowed(trans: np.ndarray) -> np.ndarray:
    """Transitions with an inside tag only after its own kind."""
    out = trans.copy()
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[[t for t in range(TAGS) if t not in (inside, inside - 1)], inside] = -1e9
    return out


def sure_margins(trans: np.ndarray) -> tuple[float, float, float]:
    """Bounds on what a span's transitions can gain over O's.  Say the best
    path had a span over place t.  End it before t and put O on the places up
    to m - 1: that gains their leads less ``inner`` for each after t, and loses
    at most ``plain`` if the span ended before m, else at most ``split`` and
    what the scores at m lose where the rest of the span then begins.  If it
    gains for every end, the best path has O at t."""
    t = allowed(trans.astype(np.float64))
    free, inside = [0, *range(1, TAGS, 2)], range(2, TAGS, 2)  # the tags that may follow O; the inside tags
    enter = (t - t[:, :1]).max(axis=0)  # of a tag at t, over the tags before it
    leave = (t[:, free] - t[0, free]).max(axis=1)  # of a span's last tag, over the tags after it
    # a span of one place has one tag; a longer one ends inside
    plain = max(max(enter[j] + leave[j] for j in range(1, TAGS)), enter[1:].max() + max(leave[j] for j in inside))
    split = enter[1:].max() + max(t[j, i] - t[0, i - 1] for i in inside for j in (i - 1, i)) + max(0.0, max((t[i] - t[i - 1]).max() for i in inside))
    return plain, split, max(t[j, i] for i in inside for j in (i - 1, i)) - t[0, 0]


def run_margin(trans: np.ndarray) -> float:
    """The most that a run of places without O can gain by its transitions, a
    place of it, over O's on all of them.  Where O leads by more on every
    place of a run between two O's, the best path has O on all of them."""
    t = allowed(trans.astype(np.float64)) - float(trans[0, 0])
    enter, leave, inner = t[0, 1:].max(), t[1:, 0].max(), t[1:, 1:].max()
    # of one place; of two; of ever more, as each adds no more than inner
    return float(max((t[0, 1:] + t[1:, 0]).max(), (enter + leave + inner) / 2, inner))


def _leads(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By how much O leads at each place, and the most an inside tag has over its beginning."""
    lead, gain = np.empty((2, u.shape[1]), u.dtype)
    for a in range(0, u.shape[1], NEAR):  # while they are near the CPU
        some = u[:, a: a + NEAR]
        np.subtract(some[0], some[1:].max(axis=0), out=lead[a: a + NEAR])
        np.max(some[2::2] - some[1::2], axis=0, out=gain[a: a + NEAR])
    return lead, gain


def unsure_places(u: np.ndarray, margins: tuple[float, float, float], reach: int = REACH, lanes: int = 1,
                  leads: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A flag for places of (tags, places) scores that may not be O in the best
    path; m is tried up to ``reach`` places on.  The last ones are always
    unsure, and a text's first and last ``reach`` are for the caller to add:
    there spans have no transition in or out.  Of several ``lanes`` side by
    side the first places come first, then the second ones."""
    plain, split, inner = (float(x) for x in margins)
    n = u.shape[1]
    lead, gain = _leads(u) if leads is None else leads
    sure = np.zeros(n, bool)
    for a in range(0, n - lanes, NEAR):
        z = min(a + NEAR, n - lanes)
        sums, told = lead[a:z].copy(), sure[a:z]
        open_ = sums > plain + 1e-3
        for m in range(1, reach + 1):
            after = slice(a + m * lanes, min(z + m * lanes, n))
            k = after.stop - after.start
            if k <= 0:
                break
            if m > 1:
                sums, told, open_ = sums[:k], told[:k], open_[:k]
                sums += lead[a + (m - 1) * lanes:][:k]
                sums -= inner
                open_ &= sums > plain + 1e-3
            sums_over = sums[:k] - gain[after]
            told[:k] |= open_[:k] & (sums_over > split + 1e-3)
    return ~sure


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first character, characters) of every window, text by text."""
    step = SPAN - MARGIN
    count = np.maximum(1, -(-(lengths - MARGIN) // step))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    of = np.repeat(np.arange(len(lengths)), count)
    first = (np.cumsum(lengths) - lengths)[of] + nth * step
    return of, first, np.minimum(SPAN, np.cumsum(lengths)[of] - first)


def _even(n: int, most: int) -> int:
    """The size of the fewest lots of at most ``most`` that are all alike: a
    step costs much the same for few windows as for many."""
    return -(-n // -(-n // most))


def unsure(chars: np.ndarray, lengths: np.ndarray, tagger: Tagger, run: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(places, their scores (places, tags)) of all texts' characters whose
    tag isn't O for sure; texts lie one after another in ``chars``.  Stretches
    of them where O leads by more than ``run`` throughout are left out."""
    of, first, size = _windows(lengths)
    margins = sure_margins(tagger.p["T"])
    step, ramp = SPAN - MARGIN, ((np.arange(MARGIN) + 0.5) / MARGIN).astype(np.float32)[:, None]
    begins, ends = np.append(True, of[1:] != of[:-1]), np.append(of[1:] != of[:-1], True)  # its text
    padded = np.concatenate([chars, np.zeros(SPAN, np.uint8)])
    places, kept, per = [], [], _even(len(of), max(1, SLICE // step))
    for a in range(0, len(of), per):
        z = min(len(of), a + per)
        back = int(not begins[a])  # its end is blended with the slice's beginning
        w = np.arange(a - back, z)
        w = w[np.argsort(-size[w], kind="stable")]  # a lane each, in the order of their lengths
        longest, lane = int(size[w[0]]), np.empty(len(w), np.int64)
        lane[w - (a - back)] = np.arange(len(w))
        scores = tagger.scores(np.lib.stride_tricks.sliding_window_view(padded, longest)[first[w]], size[w]).swapaxes(1, 2)
        # what two windows share is blended, for both: the places before it are told by it, too
        later = np.flatnonzero(~begins[w] & (w > a - back))
        if len(later):
            sooner = lane[w[later] - 1 - (a - back)]
            both = scores[:, :MARGIN, later] * ramp + scores[:, step: step + MARGIN, sooner] * (1 - ramp)
            scores[:, :MARGIN, later] = scores[:, step: step + MARGIN, sooner] = both
        u = scores.reshape(TAGS, -1)
        leads = _leads(u)
        keep, lead = unsure_places(u, margins, lanes=len(w), leads=leads).reshape(longest, len(w)), leads[0].reshape(longest, len(w))
        keep[0, begins[w]], lead[0, begins[w] | (w == a)] = True, -np.inf  # a stretch goes on from the slice before
        home = np.where(ends[w], size[w], step)
        for back_by in range(1, REACH + 1):  # a text's last places, and those that the next slice would tell
            cut = np.flatnonzero((ends[w] | (w == z - 1)) & (home >= back_by))
            keep[home[cut] - back_by, cut], lead[home[cut] - back_by, cut] = True, -np.inf
        home[w < a] = 0
        keep &= np.arange(longest)[:, None] < home
        window, nth = np.nonzero(keep.T[lane])  # in the order of the texts
        where, at = first[window + a - back] + nth, nth * len(w) + lane[window]
        if run < np.inf and len(at):
            new = np.append(True, np.diff(where) != 1)
            led = np.logical_or.reduceat(leads[0][at] <= run + 1e-3, np.flatnonzero(new))
            where, at = (x[led[np.cumsum(new) - 1]] for x in (where, at))
        places.append(where)
        kept.append(u[:, at].T)
    return np.concatenate(places), np.concatenate(kept)


def tag(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Tagged spans of every text, each decoded as one sequence."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    full = [d for d, t in enumerate(texts) if t]
    if not full:
        return out
    lengths = np.array([len(texts[d]) for d in full])
    ends = np.cumsum(lengths)
    at, unary = unsure(symbols("".join(texts[d] for d in full)), lengths, tagger, run_margin(tagger.p["T"]))
    if not len(at):
        return out
    doc = np.searchsorted(ends, at, "right")
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)]))
    last = np.append(first[1:], len(at)) - 1
    trans, starts = tagger.p["T"], ends - lengths
    unary[first] += np.where((at[first] > starts[doc[first]])[:, None], trans[0], 0)  # O stands before and after, unless the text ends there
    unary[last] += np.where((at[last] + 1 < ends[doc[last]])[:, None], trans[:, 0], 0)
    tags = decoded(unary, last - first + 1, trans)
    stop = np.repeat(last + 1, last - first + 1)
    for e in np.flatnonzero(tags % 2 == 1):
        z = int(e) + 1
        while z < stop[e] and tags[z] == tags[e] + 1:
            z += 1
        d = doc[e]
        out[full[d]].append((int(at[e] - starts[d]), int(at[e] - starts[d]) + z - int(e), KINDS[(tags[e] - 1) // 2]))
    return out


def added(text: str, tagged: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Tagged spans that are long enough and touch no base span."""
    out = []
    for a, z, k in tagged:
        while a < z and text[a].isspace():
            a += 1
        while z > a and text[z - 1].isspace():
            z -= 1
        if z - a >= LEAST and all(z <= p or q <= a for p, q, _ in base):
            out.append((a, z, k))
    return out


# ---------------------------------------------------------------- training data
WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def varied(text: str, kind: str, r: np.random.Generator) -> str:
    """A span's text with its marks or digits changed, as people write them."""
    if kind in ("phone", "card") and r.random() < 0.3:
        if kind == "phone" and r.random() < 0.4:
            return " ".join(WORDS[int(c)] for c in text if c in "0123456789")
        zero = r.choice([0xFF10, 0x660, 0x6F0, 0x966])
        return text.translate({48 + i: int(zero) + i for i in range(10)})
    if kind == "phone":
        return r.choice([text, text.replace("+1 ", ""), re.sub(r"[()+]", "", text), re.sub(r"[ ()]+", ".", text.lstrip("+"))])
    if kind == "email":
        return r.choice([text, text.replace("@", " @ "), text.replace("@", "(@)"), text.replace("@", " (at) ").replace(".", " dot "),
                         text.replace("@", " at ").replace(".", " dot "), text.replace("@", "(at)")])
    if kind == "card" and len(text) == 16 and text.isdigit():
        return r.choice([text, "-".join(text[i: i + 4] for i in range(0, 16, 4)), " ".join(text[i: i + 4] for i in range(0, 16, 4)), ".".join(text[i: i + 4] for i in range(0, 16, 4))])
    return text


def examples(texts: list[str], seed: int = 0, limit: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled windows of the whole texts: symbols, tags and which places are
    real; half of the spans have their marks varied."""
    r = np.random.default_rng(seed)
    rows = []
    for text in texts:
        spans, parts, at, moved = sorted(base_spans(text)), [], 0, []
        for a, z, kind in spans:
            if a < at:
                continue
            new = varied(text[a:z], kind, r) if r.random() < 0.5 else text[a:z]
            parts.append(text[at:a])
            start = sum(map(len, parts))
            parts.append(new)
            moved.append((start, start + len(new), kind))
            at = z
        text = "".join(parts) + text[at:]
        chars, tags = symbols(text), tags_of(len(text), moved)
        for s in range(0, max(1, len(text) - STRIDE), STRIDE):
            rows.append((chars[s: s + WINDOW], tags[s: s + WINDOW]))
    if len(rows) > limit:
        order = [int(i) for i in r.permutation(len(rows))]  # at most half of them, if there are others, hold spans
        held, plain = [i for i in order if rows[i][1].any()], [i for i in order if not rows[i][1].any()]
        held = held[: max(limit // 2, limit - len(plain))]
        rows = [rows[i] for i in sorted(held + plain[: limit - len(held)])]
    x, y, real = (np.zeros((len(rows), WINDOW), k) for k in (np.int64, np.int64, bool))
    for i, (c, t) in enumerate(rows):
        x[i, : len(c)], y[i, : len(t)], real[i, : len(c)] = c, t, True
    # a window may begin inside a span: its first tag is then a beginning
    y[:, 0] = np.where((y[:, 0] > 0) & (y[:, 0] % 2 == 0), y[:, 0] - 1, y[:, 0])
    return x, y, real


def fit(docs: DataFrame, seed: int = 0) -> Tagger:
    """A tagger trained on about ``SAMPLE_TEXTS`` texts that have a digit or
    an at sign and as many of all, chosen by hash; only the surroundings of
    their digits and at signs and a stretch from their middle reach the driver."""
    marked = F.col("text").rlike("[0-9@]")
    n, every = docs.agg(F.count_if(marked), F.count("*")).first()
    share = lambda k: F.lit(min(1.0, SAMPLE_TEXTS / max(1, k)) * (1 << 20))
    chosen = docs.filter(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 20)) < F.when(marked, share(n)).otherwise(share(every)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            words = [t for t in b.column("text").to_pylist() if t]
            cuts = [t[max(0, a - WINDOW): z + WINDOW] for t in words for a, z in window_runs(t)]
            cuts += [t[len(t) // 2: len(t) // 2 + 2 * WINDOW] for t in words]
            cuts = [c[i: i + PIECE] for c in cuts for i in range(0, len(c), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.string())], ["text"])  # training data only

    rows = chosen.mapInArrow(near, "text string").distinct().orderBy(F.xxhash64("text")).limit(2 * SAMPLE_TEXTS)
    tagger = Tagger(seed)
    x, y, real = examples(sorted(r["text"] for r in rows.collect()), seed)
    if y.any():
        tagger.train(x, y, real, seed=seed)
    else:
        tagger.p["c"][0] = 50.0  # nothing to learn from: every tag is O
    return tagger


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, base_sha256,
    and spans (base and added ones, kind:start:end in code points).

    Null or empty texts have no spans.  Without any digit or at sign in the
    table the tagger adds nothing.  Rows are independent of one another."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    model = texts.sparkSession.sparkContext.broadcast((tagger or fit(texts)).p)  # some 10,000 weights
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(weights=model.value)
        for b in small_batches(batches, "text", 4 << 20):
            words, rows = b.column("text").to_pylist(), []
            for text, tagged in zip(words, tag(words, own)):
                base = base_spans(text)
                kinds = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((*kinds, hashlib.sha256(_told(base).encode()).hexdigest(), _told(base + added(text, tagged, base))))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], names)

    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
