"""Finds personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: windows of the documents themselves, whose own base spans are labelled and into which made-up addresses, numbers and near misses are written. Texts are read in overlapping windows. Where windows overlap, a
character's tag scores are the mean of theirs, weighted by the distance to the window's border; each stretch of windows is then decoded once, by Viterbi over the whole stretch. Any span that can count holds a digit, an at sign, ' at ' or '(at)' (see fits), so
stretches are made of the windows around these, and grow to both sides as long as tags go on to their borders. Spans that fail the kind's own test, or meet a base span, are dropped; base spans stay as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_sample, documents, pieces
from .secrets import FOUND

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile("[0-9@]")

#: Window and stride in characters; rows of the sample that training windows come from; steps and windows a step; the network's sizes.
SPAN, STRIDE, SAMPLE_ROWS, STEPS, BATCH, EMB, HIDDEN = 96, 64, 400, 700, 64, 12, 24
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789@.+-()_ \n,:;/'\"#*"
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
#: How addresses are written; hints() covers the first.
AT, DOT = ("@", " at ", "(at)"), (".", " dot ", "(dot)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > end and text[i - 1] in LOCAL:
            i -= 1
        m = DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append(("email", i, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if HINT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def fits(kind: str, s: str) -> bool:
    """What a span of the network's must be to count."""
    digits = sum("0" <= c <= "9" for c in s)
    if kind == "email":
        low = s.lower()
        return len(s) >= 6 and any(x in low for x in AT) and any(x in low for x in DOT)
    if kind == "ip":
        parts = re.split(r"[^0-9]+", s.strip("[]() "))
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        d = "".join(c for c in s if "0" <= c <= "9")
        return 14 <= digits <= 19 and luhn(d) and digits > len(s) // 2
    return 7 <= digits <= 15 and ("(" in s or "-" in s or " " in s) and not set(s) - set("+0123456789 ().-/")


#: Characters that are decoded together.
CELLS = 1 << 19
_code = np.full(0x10000, len(SYMBOLS) + 1, np.int8)
for _i, _c in enumerate(SYMBOLS):
    _code[ord(_c)] = _i
    _code[ord(_c.upper())] = _i
PAD = len(SYMBOLS) + 2


def coded(text: str) -> np.ndarray:
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _code[np.minimum(u, 0xFFFF)]


class Tagger:
    """Weights p: E; W (inputs and state to gates) and b, for both directions; V and c to tag scores; T tag transitions."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    @staticmethod
    def start(rng) -> dict[str, np.ndarray]:
        g = lambda size, *s: (rng.standard_normal(s) * np.sqrt(1.0 / size)).astype(np.float32)
        b = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        return {"E": g(4, PAD + 1, EMB), "W": g(EMB + HIDDEN, 2, EMB + HIDDEN, 4 * HIDDEN), "b": np.array([b, b]), "V": g(2 * HIDDEN, 2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}

    def scores(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores (windows, characters, tags) of codes x. The backward direction runs over the reversed windows beside the forward one; sigmoids are tanh of half."""
        p, (n, t) = self.p, x.shape
        e = p["E"][x.T]  # time first
        half = np.full(4 * HIDDEN, 0.5, np.float32)
        half[3 * HIDDEN :] = 1
        gates = np.stack([e @ p["W"][0, :EMB] + p["b"][0], (e @ p["W"][1, :EMB] + p["b"][1])[::-1]], axis=1) * half
        w = p["W"][:, EMB:] * half
        h, c, out, saved = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32), np.empty((t, 2, n, HIDDEN), np.float32), []
        for i in range(t):
            u = np.tanh(gates[i] + h @ w)
            s, g = 0.5 * u[..., : 3 * HIDDEN] + 0.5, u[..., 3 * HIDDEN :]
            was, c = c, s[..., HIDDEN : 2 * HIDDEN] * c + s[..., :HIDDEN] * g
            tc = np.tanh(c)
            if keep is not None:
                saved.append((h, was, s, g, tc))
            h = s[..., 2 * HIDDEN :] * tc
            out[i] = h
        both = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        if keep is not None:
            keep |= {"e": e, "h": both, "saved": saved}
        return (both @ p["V"] + p["c"]).transpose(1, 0, 2)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y, and its gradients. Forward and backward probabilities are scaled at each character."""
        keep: dict = {}
        s, tr, (n, t) = self.scores(x, keep).astype(np.float64).transpose(1, 0, 2), self.p["T"].astype(np.float64), x.shape
        top = s.max(axis=2, keepdims=True)
        es, et = np.exp(s - top), np.exp(tr)
        al, be, scale = np.empty((t, n, TAGS)), np.ones((t, n, TAGS)), np.empty((t, n, 1))
        for i in range(t):
            a = es[i] if i == 0 else (al[i - 1] @ et) * es[i]
            scale[i] = a.sum(axis=1, keepdims=True)
            al[i] = a / scale[i]
        for i in range(t - 2, -1, -1):
            be[i] = ((es[i + 1] * be[i + 1]) @ et.T) / scale[i + 1]
        rows, at = np.arange(n), y.T
        gold = np.take_along_axis(s, at[:, :, None], 2)[:, :, 0].sum(0) + tr[at[:-1], at[1:]].sum(0)
        z = (np.log(scale) + top).sum(0)[:, 0]
        ds = al * be
        after = es[1:] * be[1:] / scale[1:]
        dt = et * (al[:-1].reshape(-1, TAGS).T @ after.reshape(-1, TAGS))
        ds[np.arange(t)[:, None], rows, at] -= 1
        np.subtract.at(dt, (at[:-1].ravel(), at[1:].ravel()), 1)
        ds = (ds / n).astype(np.float32)
        g = {"T": (dt / n).astype(np.float32), "V": keep["h"].reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, TAGS), "c": ds.sum((0, 1))}
        dh = ds @ self.p["V"].T
        dh = np.stack([dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]], axis=1)
        w, dz = self.p["W"], np.empty((t, 2, n, 4 * HIDDEN), np.float32)
        hs, hn, cn = np.empty((t, 2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        back = w[:, EMB:].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            h, was, sg, gg, tc = keep["saved"][i]
            a = dh[i] + hn
            si, sf, so = sg[..., :HIDDEN], sg[..., HIDDEN : 2 * HIDDEN], sg[..., 2 * HIDDEN :]
            c = cn + a * so * (1 - tc * tc)
            dz[i] = np.concatenate([c * gg * si * (1 - si), c * was * sf * (1 - sf), a * tc * so * (1 - so), c * si * (1 - gg * gg)], axis=2)
            hs[i] = h
            hn, cn = dz[i] @ back, c * sf
        e = np.stack([keep["e"], keep["e"][::-1]], axis=1)
        flat = lambda a: a.transpose(1, 0, 2, 3).reshape(2, t * n, -1)
        g["W"] = np.concatenate([flat(e).transpose(0, 2, 1) @ flat(dz), flat(hs).transpose(0, 2, 1) @ flat(dz)], axis=1)
        g["b"] = dz.sum((0, 2))
        de = dz @ w[:, None, :EMB].transpose(1, 0, 3, 2)
        ge = np.zeros_like(self.p["E"])
        np.add.at(ge, x.T.ravel(), (de[:, 0] + de[::-1, 1]).reshape(-1, EMB))
        g["E"] = ge
        return float((z - gold).mean()), g

    def decode(self, s: np.ndarray) -> np.ndarray:
        """Best tags (stretches, characters) of tag scores (stretches, characters, tags)."""
        tr = self.p["T"]
        n, t, _ = s.shape
        best, back = s[:, 0], np.empty((t, n, TAGS), np.int8)
        for i in range(1, t):
            a = best[:, :, None] + tr
            back[i] = a.argmax(1)
            best = a.max(1) + s[:, i]
        out = np.empty((n, t), np.int8)
        out[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[i][np.arange(n), out[:, i]]
        return out


def made_up(rng, kind: str) -> str:
    d = lambda n: "".join(str(v) for v in rng.integers(0, 10, n))
    w = lambda: "".join(chr(97 + v) for v in rng.integers(0, 26, rng.integers(2, 9)))
    one = lambda *a: a[rng.integers(0, len(a))]
    if kind == "email":
        at, dot = one(("@", "."), ("@", "."), (" at ", " dot "), (" @ ", "."), ("(at)", "(dot)"))
        return f"{w()}{one('', '.', '_', '-')}{one('', w(), d(2))}{at}{w()}{d(rng.integers(0, 2))}{dot}{one('com', 'org', 'example' + dot + 'com', 'net')}"
    if kind == "ip":
        return one(".", ".", ".", " . ", "[.]").join(str(v) for v in rng.integers(0, 256, 4))
    if kind == "card":
        n = int(rng.integers(14, 20))
        body = d(n - 1)
        body = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return one("", "", " ", "-", ".").join(body[i : i + 4] for i in range(0, n, 4))
    a = one("+1 ", "+" + d(2) + " ", "+" + d(2) + "-", "", "", "00" + d(2) + " ")
    return a + one(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(4)} {d(6)}", f"({d(3)}) {d(3)} {d(4)}")


def near_miss(rng) -> str:
    """What isn't personal data: hex, numbers, dates, times, versions, prices, names of parts, words with 'at' and 'dot'."""
    d = lambda n: "".join(str(v) for v in rng.integers(0, 10, n))
    w = lambda: "".join(chr(97 + v) for v in rng.integers(0, 26, rng.integers(2, 9)))
    k = int(rng.integers(0, 9))
    if k == 0:
        return "".join("0123456789abcdef"[v] for v in rng.integers(0, 16, rng.integers(12, 42)))
    if k == 1:
        return d(rng.integers(1, 13))
    if k == 2:
        return f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 32):02d}" + ("" if rng.random() < 0.5 else f" {rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}")
    if k == 3:
        return f"{rng.integers(1, 32)}{'./'[rng.integers(0, 2)]}{rng.integers(1, 13)}{'./'[rng.integers(0, 2)]}{rng.integers(1900, 2100)}"
    if k == 4:
        return "v" * int(rng.integers(0, 2)) + ".".join(d(rng.integers(1, 4)) for _ in range(rng.integers(2, 4)))
    if k == 5:
        return f"{rng.integers(1, 999)},{d(3)}.{d(2)}"
    if k == 6:
        return f"{w().upper()}-{d(rng.integers(2, 6))}-{d(rng.integers(2, 4))}"
    if k == 7:
        return f"{w()} at {w()} {w()}"
    return f"{d(rng.integers(1, 4))} {w()} {d(rng.integers(1, 4))}"


def labelled(rng, texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts with their own base spans tagged, most with a made-up span or a near miss written in, and their tags. Other digits of the texts are no span."""
    x, y = np.full((n, SPAN), PAD, np.int8), np.zeros((n, SPAN), np.int64)
    for r in range(n):
        t = texts[rng.integers(0, len(texts))]
        at = int(rng.integers(0, max(1, len(t) - SPAN)))
        t = t[at : at + SPAN]
        spans = base_spans(t)
        cut = int(rng.integers(0, len(t) + 1))
        if any(a < cut < b for _, a, b in spans):
            cut = 0
        what = int(rng.integers(0, 7))
        s = made_up(rng, KINDS[what]) if what < 4 else near_miss(rng) if what < 6 else ""
        left = t[:cut] + ("" if rng.random() < 0.1 or not s else " ")
        tail = ("" if rng.random() < 0.3 or not s else " ") + t[cut:]
        more = len(left) - cut + len(s) + len(tail) - len(t) + cut
        spans = [(k, a + more * (a >= cut), b + more * (a >= cut)) for k, a, b in spans]
        if what < 4:
            spans.append((KINDS[what], len(left), len(left) + len(s)))
        whole = left + s + tail
        shift = int(rng.integers(0, max(1, len(whole) - SPAN + 1)))
        c = coded(whole[shift : shift + SPAN])
        x[r, : len(c)] = c
        for kind, a, b in spans:
            tag, lo, hi = 1 + 2 * ORDER[kind], max(0, a - shift), min(SPAN, b - shift)
            if lo < hi:
                y[r, lo:hi] = tag + 1
                if a >= shift:
                    y[r, lo] = tag
    return x, y


def train(texts: list[str], seed: int = 11, steps: int = STEPS) -> Tagger:
    """A tagger from made-up spans in windows of the texts (Adam)."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t] or ["text without anything in it"]
    model = Tagger(Tagger.start(rng))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    for i in range(1, steps + 1):
        _, g = model.step(*labelled(rng, texts, BATCH))
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.015 * min(1.0, 5 / (norm + 1e-9)) * min(1.0, i / 20) * max(0.03, 1 - i / steps)
        for k, a in g.items():
            m[k] = 0.9 * m[k] + 0.1 * a
            v2[k] = 0.99 * v2[k] + 0.01 * a * a
            model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v2[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return model


def hints(c: np.ndarray) -> np.ndarray:
    """Where codes c have a digit or one of AT, of which every span that fits() accepts holds one."""
    hot = (c >= 26) & (c <= 36)
    if len(c) > 3:
        a, b, d, e = c[:-3], c[1:-2], c[2:-1], c[3:]
        blank, left, right = (SYMBOLS.index(x) for x in " ()")
        hot[:-3] |= (b == 0) & (d == 19) & (((a == blank) & (e == blank)) | ((a == left) & (e == right)))
    return np.flatnonzero(hot)


def _stitched(parts: list[tuple[int, np.ndarray]], first: int, length: int, whole: int) -> np.ndarray:
    """Scores of characters first to first + length of a text of ``whole``: the weighted mean of its windows' (start, scores)."""
    total, weight = np.zeros((length, TAGS), np.float32), np.zeros((length, 1), np.float32)
    for at, s in parts:
        n = min(len(s), whole - at)
        i = np.arange(n, dtype=np.float32)
        w = np.full(n, SPAN, np.float32)
        w = np.minimum(w, i + 1) if at else w
        w = (np.minimum(w, n - i) if at + n < whole else w)[:, None]
        lo = at - first
        total[lo : lo + n] += s[:n] * w
        weight[lo : lo + n] += w
    return total / np.maximum(weight, 1e-9)


def _long(model: Tagger, held: dict[int, np.ndarray], a: int, b: int, size: int, whole: int, piece: int = 1 << 10) -> np.ndarray:
    """Tags of a long stretch, windows a to b: scores are put together for ``piece`` windows at a time, and a character keeps a byte for each tag."""
    tr, back, best = model.p["T"], np.empty((size, TAGS), np.int8), None
    for lo in range(a, b + 1, piece):
        hi = min(b, lo + piece - 1)
        first, end = lo * STRIDE, a * STRIDE + size if hi == b else (hi + 1) * STRIDE
        reach = (SPAN - 1) // STRIDE
        near = [(f * STRIDE, held[f]) for f in range(max(a, lo - reach), min(b, hi + reach) + 1)]
        start = near[0][0]
        s = _stitched(near, start, min(whole, near[-1][0] + SPAN) - start, whole)[first - start : end - start]
        for i in range(len(s)):
            at = first - a * STRIDE + i
            if best is None:
                best = s[0]
                continue
            x = best[:, None] + tr
            back[at] = x.argmax(0)
            best = x.max(0) + s[i]
    out = np.empty(size, np.int8)
    out[-1] = best.argmax()
    for i in range(size - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def network_spans(model: Tagger, texts: list[str], most: int = 2048, cells: int = CELLS) -> list[list[tuple[str, int, int]]]:
    """Spans the network finds in each text, ``most`` windows at a time. Stretches are decoded ``cells`` characters at a time; a longer one is decoded by itself, in pieces, and a stretch's scores go when it doesn't grow any more."""
    codes = [coded(t) if t else np.empty(0, np.int8) for t in texts]
    # a text's last window is the first that reaches its end
    last = [max(0, -(-(len(c) - SPAN) // STRIDE)) for c in codes]
    edge = (SPAN - STRIDE) // 2
    chosen = [{*np.unique(np.clip((hints(c) - edge) // STRIDE, 0, last[k])).tolist()} for k, c in enumerate(codes)]
    held: list[dict[int, np.ndarray]] = [{} for _ in texts]
    tags: list[dict[tuple[int, int], np.ndarray]] = [{} for _ in texts]
    while True:
        # stretches of neighbouring windows that aren't decoded yet, those of like length together
        due = []
        for k, own in enumerate(chosen):
            own = sorted(own)
            stretches = {(own[i], own[j - 1]) for i, j in _consecutive(own)}
            tags[k] = {x: v for x, v in tags[k].items() if x in stretches}
            due += [(k, a, b) for a, b in stretches if (a, b) not in tags[k]]
        if not due:
            break
        new = [(k, f) for k, a, b in sorted(due) for f in range(a, b + 1) if f not in held[k]]
        for lo in range(0, len(new), most):
            part = new[lo : lo + most]
            x = np.full((len(part), SPAN), PAD, np.int8)
            for r, (k, f) in enumerate(part):
                w = codes[k][f * STRIDE : f * STRIDE + SPAN]
                x[r, : len(w)] = w
            for (k, f), s in zip(part, model.scores(x)):
                held[k][f] = s.copy()  # a view would keep the whole batch
        due.sort(key=lambda x: (x[2] - x[1], x))
        length = lambda k, a, b: min(len(codes[k]), b * STRIDE + SPAN) - a * STRIDE
        at = 0
        while at < len(due):
            end = at + 1
            while end < len(due) and end - at < 256 and (end + 1 - at) * length(*due[end]) <= cells:
                end += 1
            part, at = due[at:end], end
            size = [length(*x) for x in part]
            if size[-1] > cells:
                found = [_long(model, held[k], a, b, n, len(codes[k])) for (k, a, b), n in zip(part, size)]
            else:
                s = np.zeros((len(part), max(size), TAGS), np.float32)
                s[:, :, 0] = 1e4  # after a stretch's end nothing but O
                for r, (k, a, b) in enumerate(part):
                    s[r, : size[r]] = _stitched([(f * STRIDE, held[k][f]) for f in range(a, b + 1)], a * STRIDE, size[r], len(codes[k]))
                found = model.decode(s)
            for (k, a, b), n, g in zip(part, size, found):
                tags[k][a, b] = g = g[:n].copy()
                grows = [a - 1] * bool(g[0] and a) + [b + 1] * bool(g[-1] and b < last[k])
                chosen[k].update(grows)
                if not grows:
                    for f in range(a, b + 1):
                        del held[k][f]
    out = []
    for k, t in enumerate(texts):
        spans = []
        for (a, _), g in sorted(tags[k].items()):
            at = np.nonzero(g)[0]
            if len(at):
                kinds = (g[at] - 1) // 2
                new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (kinds[1:] != kinds[:-1]) | (g[at][1:] % 2 == 1)])
                first = np.nonzero(new)[0]
                for i, j in zip(first, [*first[1:], len(at)]):
                    lo, hi = a * STRIDE + int(at[i]), a * STRIDE + int(at[j - 1]) + 1
                    while hi > lo and t[hi - 1] in " .,;:-(":
                        hi -= 1
                    while lo < hi and t[lo] in " .,;:-)":
                        lo += 1
                    kind = KINDS[int(kinds[i])]
                    if fits(kind, t[lo:hi]):
                        spans.append((kind, lo, hi))
        out.append(spans)
    return out


def _consecutive(own: list[int]) -> list[tuple[int, int]]:
    """From and to of runs of consecutive numbers."""
    starts = [i for i in range(len(own)) if not i or own[i] != own[i - 1] + 1]
    return [*zip(starts, [*starts[1:], len(own)])]


def all_spans(model: Tagger, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    texts = [t or "" for t in texts]
    out = []
    for t, more in zip(texts, network_spans(model, texts)):
        base = base_spans(t)
        free = [s for s in more if not any(s[1] < b[2] and b[1] < s[2] for b in base)]
        out.append(sorted(base + free, key=lambda s: (s[1], ORDER[s[0]])))
    return out


def find(docs: DataFrame, model: Tagger, carry: list[str], text_col: str = "text") -> DataFrame:
    """Per row of docs: ``d`` (the carried columns), found (all spans by start, then kind; code points, end exclusive), base (those of the patterns).

    Null and empty texts hold nothing. Very long texts are read whole, in windows. Repeated rows get a result each; extra columns are ignored unless carried. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.p)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def each(batches):
        tagger = Tagger(shared.value)
        as_rows = lambda spans: pa.array([[{"kind": k, "start": i, "stop": j} for k, i, j in s] for s in spans], kind)
        for whole in batches:
            for part in pieces(whole, 1 << 20):
                for lo in range(0, part.num_rows, 512):
                    b = part.slice(lo, 512)
                    texts = b.column("t").to_pylist()
                    yield pa.RecordBatch.from_arrays([b.column("d"), as_rows(all_spans(tagger, texts)), as_rows([base_spans(t or "") for t in texts])], ["d", "found", "base"])

    rows = docs.select(F.struct(*carry).alias("d"), F.col(text_col).alias("t"))
    return rows.mapInArrow(each, f"d {rows.schema['d'].dataType.simpleString()}, found {FOUND}, base {FOUND}")


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS, text_col: str = "text") -> list[str]:
    """At most ``rows`` distinct texts (by a hash), of each 2000 characters from anywhere in it (by the hash): what training windows are cut from. Fewer only if there are fewer."""
    h = F.xxhash64("t")
    part = distinct_sample(docs.select(F.col(text_col).alias("t")).where("t is not null"), rows, "t")
    part = part.select(F.substring("t", (F.pmod(h, F.greatest(F.length("t") - 1999, F.lit(1))) + 1).cast("int"), F.lit(2000)).alias("t"))
    return sorted(r["t"] for r in part.collect())


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find(docs, train(sample_texts(docs)), ["doc_id"])
    spans = "array_join(transform(found, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"
    text = "array_join(transform(base, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("d.doc_id", *counts, F.sha2(F.expr(text), 256).alias("base_sha256"), F.expr(spans).alias("spans"))
