"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy, from labelled spans that `examples` writes out (invented prose around
personal data and secrets in many notations, and look-alikes such as versions, dates and numbers that are
none). It reads every character of every text, in windows of WINDOW characters that overlap by OVERLAP; all
windows are decoded by Viterbi, and each character takes its tag from the window in which it lies deeper, so
that spans are read off the whole text. Decoding allows only sound tag sequences (a span begins after
"outside" and goes on in its own kind), so a step needs a few sums for each kind. Where no stretch of a window,
taken at the best of all kinds character by character, outweighs "outside", Viterbi's result is known without it.

A predicted span is added if it touches no pattern's span and holds what its kind must hold (`passes`: enough
digits, Luhn's check, an at-sign and so on); its notation is the network's choice. Kind `secret` (keys and
tokens) comes from the network alone.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no spans; equal texts
have equal spans; input columns named `spans` or `redacted` are replaced; an empty table stays empty.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from segmenta.llm.common import map_batches, texts_of

#: Kinds with a fixed pattern, then those that only the network finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
WINDOW, OVERLAP = 256, 48
STRIDE = WINDOW - OVERLAP
#: Tags: 0 outside, 1 + 2k begins kind k, 2 + 2k goes on.
TAGS = 1 + 2 * len(KINDS)

# The patterns of the kinds; the look-behinds only skip starts that cannot match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def patterns(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and then start."""
    out: list[tuple[str, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            d = only_digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


# --- the network ---------------------------------------------------------------------------------

_CLASSES = {c: i + 12 for i, c in enumerate("@.-_+()[]{}:/,;=#*&'\"<>|")}
SYMBOLS = 12 + len(_CLASSES)


def _class_of(c: str) -> int:
    if c in _CLASSES:
        return _CLASSES[c]
    if c.isdigit():
        return 2 if c in "01" else 3 if c == "2" else 4
    if c.isspace():
        return 5
    if c.isalpha():
        low = c.lower()
        return 6 if low in "abcdef" else 7 if low in "at" else 8 if low in "do" else 9 if not c.isupper() else 10
    return 11 if ord(c) > 127 else 1


_BMP = np.array([_class_of(chr(c)) if not 0xD800 <= c < 0xE000 else 1 for c in range(1 << 16)], np.uint8)


def codes(text: str) -> np.ndarray:
    return _BMP[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Character BiLSTM-CRF over windows of equal length; class 0 pads."""

    def __init__(self, size: int = 20, width: int = 10, seed: int = 7) -> None:
        r = np.random.default_rng(seed)

        def w(*shape: int) -> np.ndarray:
            return r.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.size = size
        self.p = {"e": r.normal(0, 0.5, (SYMBOLS, width)), "o": w(2 * size, TAGS), "ob": np.zeros(TAGS), "t": r.normal(0, 0.1, (TAGS, TAGS))}
        for side in "fb":
            self.p |= {f"w{side}": w(width, 4 * size), f"u{side}": w(size, 4 * size), f"c{side}": np.concatenate([np.zeros(size), np.ones(size), np.zeros(2 * size)])}

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        p, h = self.p, self.size
        drive = x @ p[f"w{side}"] + p[f"c{side}"]
        hidden, cell = np.zeros((x.shape[0], h)), np.zeros((x.shape[0], h))
        out, tape = np.zeros((*x.shape[:2], h)), []
        for t in range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1):
            z = drive[:, t] + hidden @ p[f"u{side}"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before = (hidden, cell)
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            hidden = o * squashed
            out[:, t] = hidden
            tape.append((t, i, f, o, g, squashed, *before))
        return out, tape

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.p["e"][x]
        f, tape_f = self._lstm(e, "f")
        b, tape_b = self._lstm(e, "b")
        both = np.concatenate((f, b), 2)
        return both @ self.p["o"] + self.p["ob"], (e, both, tape_f, tape_b)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags of each window, by Viterbi."""
        return viterbi(np.ascontiguousarray(self.emissions(x)[0].transpose(1, 2, 0)), self.p["t"])

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood and its gradients."""
        p, n, length = self.p, len(x), x.shape[1]
        scores, (e, both, tape_f, tape_b) = self.emissions(x)
        forward, backward = [scores[:, 0]], [np.zeros((n, TAGS))]
        for t in range(1, length):
            forward.append(_log_sum(forward[-1][:, :, None] + p["t"], 1) + scores[:, t])
        for t in range(length - 1, 0, -1):
            backward.append(_log_sum(p["t"] + (scores[:, t] + backward[-1])[:, None, :], 2))
        backward.reverse()
        whole = _log_sum(forward[-1], 1)
        rows = np.arange(n)
        grad_s = np.exp(np.stack(forward, 1) + np.stack(backward, 1) - whole[:, None, None])
        grad_t = np.zeros_like(p["t"])
        gold = scores[rows[:, None], np.arange(length), y].sum(1) + p["t"][y[:, :-1], y[:, 1:]].sum(1)
        for t in range(1, length):
            grad_t += np.exp(forward[t - 1][:, :, None] + p["t"] + (scores[:, t] + backward[t])[:, None, :] - whole[:, None, None]).sum(0)
        np.add.at(grad_t, (y[:, :-1], y[:, 1:]), -1.0)
        grad_s[rows[:, None], np.arange(length), y] -= 1
        g = {"t": grad_t, "o": both.reshape(-1, both.shape[2]).T @ grad_s.reshape(-1, TAGS), "ob": grad_s.sum((0, 1))}
        grad_h = grad_s @ p["o"].T
        grad_e = np.zeros_like(e)
        for side, tape, part in (("f", tape_f, grad_h[:, :, : self.size]), ("b", tape_b, grad_h[:, :, self.size :])):
            self._unwind(side, tape, part, e, grad_e, g)
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], x, grad_e)
        return float((whole - gold).mean()), {k: v / n for k, v in g.items()}

    def _unwind(self, side: str, tape: list, part: np.ndarray, e: np.ndarray, grad_e: np.ndarray, g: dict) -> None:
        p, h = self.p, self.size
        gw, gu, gc = np.zeros_like(p[f"w{side}"]), np.zeros_like(p[f"u{side}"]), np.zeros(4 * h)
        dh, dc = np.zeros((len(e), h)), np.zeros((len(e), h))
        for t, i, f, o, new, squashed, hidden, cell in reversed(tape):
            dh = dh + part[:, t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate((dc * new * i * (1 - i), dc * cell * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)), 1)
            gw += e[:, t].T @ dz
            gu += hidden.T @ dz
            gc += dz.sum(0)
            grad_e[:, t] += dz @ p[f"w{side}"].T
            dh, dc = dz @ p[f"u{side}"].T, dc * f
        g |= {f"w{side}": gw, f"u{side}": gu, f"c{side}": gc}


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(windows, characters) best sound tags; scores: characters, tags, windows."""
    length, _, n = scores.shape
    stay, enter, leave_b, leave_i = moves[0, 0], moves[0, 1::2, None], moves[1::2, 0, None], moves[2::2, 0, None]
    first, on = np.diagonal(moves[1::2, 2::2])[:, None], np.diagonal(moves[2::2, 2::2])[:, None]
    begins, goes = scores[:, 1::2], scores[:, 2::2]
    # a window may start inside a span
    outside, begin, go = scores[0, 0].copy(), begins[0].copy(), goes[0].copy()
    # for each character: the tag that "outside" comes from, and whether a span's part comes from its beginning
    back, from_begin = np.zeros((length, n), np.uint8), np.zeros((length, len(KINDS), n), bool)
    used = np.zeros(n, bool)
    for t in range(1, length):
        by_b, by_i = begin + first, go + on
        np.greater(by_b, by_i, out=from_begin[t])
        end_b, end_i = begin + leave_b, go + leave_i
        top = np.maximum(end_b, end_i).max(0)
        begin = enter + outside
        begin += begins[t]
        go = np.maximum(by_b, by_i, out=by_b)
        go += goes[t]
        outside += stay
        left = np.flatnonzero(top > outside)
        if len(left):
            ends, is_go = np.maximum(end_b[:, left], end_i[:, left]), end_i[:, left] >= end_b[:, left]
            kind = ends.argmax(0)
            back[t, left] = 1 + 2 * kind + is_go[kind, np.arange(len(left))]
            used[left] = True
            np.maximum(outside, top, out=outside)
        outside += scores[t, 0]
    last = np.concatenate((outside[None], np.stack((begin, go), 1).reshape(-1, n))).argmax(0)
    out = np.zeros((n, length), np.uint8)
    # paths that stay outside all the way need no walk back
    walk = np.flatnonzero(used | (last > 0))
    tag = last[walk].astype(np.uint8)
    for t in range(length - 1, -1, -1):
        out[walk, t] = tag
        inside = (tag > 0) & (tag % 2 == 0)
        kind = np.where(tag > 0, (tag.astype(np.int64) - 1) // 2, 0)
        tag = np.where(tag == 0, back[t, walk], np.where(inside, tag - from_begin[t, kind, walk], 0)).astype(np.uint8)
    return out


class Reader:
    """A trained tagger made ready to read: single precision, inputs looked up in tables, one exponential of all gates a step."""

    def __init__(self, model: Tagger) -> None:
        p, h = model.p, model.size
        # all gates are 1 / (1 + exp(-z)), tanh(z) is 2 / (1 + exp(-2z)) - 1: the signs and doublings go into the weights
        scale = np.concatenate([np.full(3 * h, -1.0), np.full(h, -2.0)])
        self.size = h
        self.drive = {k: ((p["e"] @ p[f"w{k}"] + p[f"c{k}"]) * scale).astype(np.float32) for k in "fb"}
        self.state = {k: (p[f"u{k}"] * scale).astype(np.float32) for k in "fb"}
        self.read = {"f": np.ascontiguousarray(p["o"][:h].T).astype(np.float32), "b": np.ascontiguousarray(p["o"][h:].T).astype(np.float32)}
        self.bias, self.moves = p["ob"].astype(np.float32), p["t"].astype(np.float32)

    def _pass(self, x: np.ndarray, side: str, scores: np.ndarray) -> None:
        """Add one direction's part to the scores (characters, tags, windows)."""
        length, n, h = *x.shape, self.size
        drive, state, read = self.drive[side], self.state[side], self.read[side]
        z, fed = np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32)
        enter, keep, show, new = (z[:, k * h : (k + 1) * h] for k in range(4))
        cell, part, hidden = np.zeros((n, h), np.float32), np.empty((n, h), np.float32), np.zeros((n, h), np.float32)
        # an exponential beyond all bounds makes a gate 0, as it should
        with np.errstate(over="ignore"):
            for t in range(length) if side == "f" else range(length - 1, -1, -1):
                np.take(drive, x[t], axis=0, out=z, mode="clip")
                z += np.matmul(hidden, state, out=fed)
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                np.multiply(new, 2, out=part)
                part -= 1
                part *= enter
                cell *= keep
                cell += part
                np.multiply(cell, -2, out=part)
                np.exp(part, out=part)
                part += 1
                np.divide(2, part, out=part)
                part -= 1
                np.multiply(part, show, out=hidden)
                scores[t] += np.matmul(read, hidden.T)

    def tags(self, x: np.ndarray, batch: int = 1024) -> np.ndarray:
        """Best tags of windows (rows) of character classes.

        The network reads `batch` windows at once; the few that may hold spans are decoded together, since a step of
        Viterbi costs much the same for one as for many.
        """
        out, which, held = np.zeros(x.shape, np.uint8), [], []
        for k in range(0, len(x), batch):
            some = np.ascontiguousarray(x[k : k + batch].T)
            scores = np.empty((some.shape[0], TAGS, some.shape[1]), np.float32)
            scores[:] = self.bias[:, None]
            self._pass(some, "f", scores)
            self._pass(some, "b", scores)
            open_ = np.flatnonzero(self.may_hold_spans(scores))
            which.append(k + open_)
            held.append(scores[:, :, open_])
        if sum(map(len, which)):
            out[np.concatenate(which)] = viterbi(np.ascontiguousarray(np.concatenate(held, 2)), self.moves)
        return out

    def may_hold_spans(self, scores: np.ndarray) -> np.ndarray:
        """False for windows in which every span is worth less than staying outside: a bound over all stretches, from prefix sums."""
        t = self.moves - self.moves[0, 0]
        enter, leave = t[0, 1::2].max(), t[1:, 0].max()
        inside = max(np.diagonal(t[1::2, 2::2]).max(), np.diagonal(t[2::2, 2::2]).max())
        best = scores[:, 1].copy()
        for k in range(2, TAGS):
            np.maximum(best, scores[:, k], out=best)
        best -= scores[:, 0]
        best += inside
        sums = np.cumsum(best, axis=0, out=best)
        before = np.zeros_like(sums)
        np.minimum.accumulate(sums[:-1], axis=0, out=before[1:])
        np.minimum(before, 0, out=before)
        # a stretch that starts with the window has no entering move, one that ends with it no leaving move
        from_start, within = sums.max(0), (sums[1:] - before[1:]).max(0)
        to_end = sums[-1] - before[-1]
        most = np.maximum(np.maximum(from_start + leave, within + enter + leave), np.maximum(to_end + enter, sums[-1])) - inside
        return most >= -1e-3


# --- labelled spans ------------------------------------------------------------------------------

#: Characters of a training window.
TRAIN_WINDOW = 96


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented texts with the personal data they hold."""
    r = np.random.default_rng(seed)
    syllables = "an the ing er on ti mar ko lu sen da vi os que la ich ung re mo pa tal".split()

    def word(lo: int = 1, hi: int = 4) -> str:
        return "".join(r.choice(syllables, r.integers(lo, hi)))

    def digits(k: int) -> str:
        return "".join(map(str, r.integers(0, 10, k)))

    def card() -> str:
        d = str(r.choice(["4", "5", "6"])) + digits(int(r.integers(11, 18)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = str(r.choice(["", "", " ", "-", ".", "_"]))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def ip() -> str:
        return str(r.choice([".", ".", ".", "[.]", " . "])).join(map(str, r.integers(0, 256, 4)))

    def phone() -> str:
        a, b, c = str(r.integers(200, 990)), digits(3), digits(4)
        return str(r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{r.integers(20, 99)} {a} {b}{c}", f"+{r.integers(20, 99)}{a}{b}{c}", f"00{r.integers(20, 99)} {a} {b} {c}"]))

    def email() -> str:
        user = word() + str(r.choice(["", ".", "_", "+", "-"])) + str(r.choice([word(), digits(2), ""]))
        user, host, end = user.rstrip("._+-"), word() + str(r.choice(["", digits(1)])), str(r.choice(["com", "org", "net", "de", "example.com"]))
        return str(r.choice([f"{user}@{host}.{end}", f"{user}@{host}.{end}", f"{user} @ {host}.{end}", f"{user}[@]{host}.{end}", f"{user}(@){host}.{end}"]))

    def secret() -> tuple[str, str, str]:
        """What stands before it, the secret, what stands after it."""
        some = lambda letters, k: "".join(r.choice(list(letters), k))
        upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        body = str(r.choice([some("0123456789abcdef", int(r.choice([32, 40, 64]))), some("0123456789ABCDEF", 40), "AKIA" + some(upper + "0123456789", 16), "sk-" + some(low + upper + "0123456789", 32), "ghp_" + some(low + upper + "0123456789", 36), some(low + upper + "0123456789", int(r.integers(20, 44)))]))
        name = str(r.choice(["token", "api_key", "secret", "password", "key", "apikey", "access_token", "TOKEN", "Token"]))
        before, after = [(f'{name} = "', '"'), (f"{name}=", ""), (f"{name}: ", ""), (f"{name}: '", "'"), ("", "")][int(r.integers(0, 5))]
        return before, body, after

    def other() -> str:
        return str(r.choice([f"{r.integers(1, 9)}.{r.integers(0, 9)}", f"{r.integers(1, 9)}.{r.integers(0, 9)}.{r.integers(0, 9)}", f"20{digits(2)}-0{r.integers(1, 9)}-{r.integers(10, 28)}", f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{r.integers(1, 99)}%", f"No. {digits(5)}", f"({digits(1)})", f"{digits(1)}. {word()}", f"{digits(3)},{digits(3)}", f"@{word()}", f"{digits(4)}", f"{r.integers(1900, 2030)}", f"{digits(22)}", f"{digits(1)} {digits(1)} {digits(1)}", f"{word()} = {digits(2)}", f'"{word()}"', f"{word()}-{word()}", word(3, 7).upper(), f"{word()}{digits(2)}", f"http://{word()}.com/{digits(3)}"]))

    scripts = ["bcdfghjklmnpqrstvwxyz", "äöüßéèêçñíóúáà", "абвгдежзик", "αβγδεζηθ", "日本語中文字", "ابتثج"]

    def prose() -> str:
        made = word() if r.random() < 0.75 else word(0, 2) + "".join(r.choice(list(scripts[int(r.integers(0, len(scripts)))]), int(r.integers(1, 7)))) + word(0, 3)
        made = made.capitalize() if r.random() < 0.2 else made.upper() if r.random() < 0.1 else made
        return made + str(r.choice(["", "", "", "", ",", ".", ":", "!!", ".\n", " |", ";", "&&&", "$$$", "%%%", "###", "***"]))

    out = []
    for _ in range(n):
        text, spans = "", []
        # some texts are prose alone
        much = float(r.choice([1.0, 0.95, 0.7, 0.6]))
        while len(text) < TRAIN_WINDOW + 40:
            u = r.random()
            if u < much:
                text += prose()
            elif u < much + 0.4 * (1 - much):
                text += other() + str(r.choice(["", "", ",", ".", "&&&", "!!"]))
            else:
                kind = KINDS[int(r.integers(0, len(KINDS)))]
                before, piece, after = secret() if kind == "secret" else ("", {"email": email, "ip": ip, "card": card, "phone": phone}[kind](), "")
                text += before
                spans.append((kind, len(text), len(text) + len(piece)))
                text += piece + after + str(r.choice(["", "", "", ",", ".", "$$$", "%%%", "&&&", "!!", ";"]))
            text += str(r.choice([" ", " ", " ", "\n"]))
        out.append((text, spans))
    return out


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


@functools.lru_cache(maxsize=4)
def trained(texts: int = 6000, steps: int = 420, batch: int = 40, rate: float = 0.03, seed: int = 7) -> Tagger:
    """Adam on windows cut from `texts` examples; repeatable."""
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for text, spans in examples(texts, seed):
        at = int(r.integers(0, len(text) - TRAIN_WINDOW + 1))
        xs.append(codes(text)[at : at + TRAIN_WINDOW])
        ys.append(tags_of(len(text), spans)[at : at + TRAIN_WINDOW])
    x, y = np.stack(xs), np.stack(ys)
    model = Tagger(size=12, width=8, seed=seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    for t in range(1, steps + 1):
        some = r.choice(len(x), batch, replace=False)
        _, grads = model.step(x[some], y[some])
        now = rate * min(1.0, 1.5 * (1 - t / (steps + 1)))
        for k, g in grads.items():
            g = np.clip(g, -5, 5)
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            model.p[k] = model.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    return model


# --- whole texts ---------------------------------------------------------------------------------


def predicted(reader: Reader, texts: list[str], batch: int = 4096) -> list[list[tuple[str, int, int]]]:
    """Spans the network sees in each text, windows reconciled, before any check."""
    gap = np.zeros(WINDOW, np.uint8)
    rows = [codes(t) for t in texts]
    line = np.concatenate([x for row in rows for x in (row, gap)]) if rows else gap
    # windows start STRIDE apart; the last one of a text holds its end
    counts = [max(1, -(-(len(row) - OVERLAP) // STRIDE)) if len(row) else 0 for row in rows]
    bases = np.cumsum([0, *(len(row) + WINDOW for row in rows)])[:-1]
    starts = np.concatenate([base + STRIDE * np.arange(k) for base, k in zip(bases, counts, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    first = np.concatenate([np.arange(k) == 0 for k in counts] or [np.zeros(0, bool)])
    last = np.concatenate([np.arange(k) == k - 1 for k in counts] or [np.zeros(0, bool)])
    tags = np.zeros(len(line), np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(line, WINDOW)
    half = OVERLAP // 2
    for k in range(0, len(starts), batch):
        some = slice(k, k + batch)
        found = reader.tags(views[starts[some]])
        # where windows overlap, each has the half that lies deeper in it
        found[~first[some], :half] = 0
        found[~last[some], WINDOW - half :] = 0
        for row in np.flatnonzero(found.any(1)).tolist():
            at = starts[k + row]
            np.maximum(tags[at : at + WINDOW], found[row], out=tags[at : at + WINDOW])
    hits = np.flatnonzero(tags)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if len(hits):
        owner = np.searchsorted(bases, hits, "right") - 1
        for i in np.unique(owner).tolist():
            mine = hits[owner == i]
            mine = mine[mine < bases[i] + len(rows[i])]
            out[i] = _spans(dict(zip((mine - bases[i]).tolist(), tags[mine].tolist(), strict=True)))
    return out


def _spans(tags: dict[int, int]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for at in sorted(tags):
        kind, begins = KINDS[(tags[at] - 1) // 2], tags[at] % 2 == 1
        if out and not begins and out[-1][0] == kind and out[-1][2] == at:
            out[-1] = (kind, out[-1][1], at + 1)
        else:
            out.append((kind, at, at + 1))
    return out


def passes(kind: str, text: str, start: int, end: int) -> bool:
    """Whether the span holds what its kind must hold, and cuts no word or number."""
    piece = text[start:end]
    if start and (text[start - 1].isalnum() or text[start - 1] in "+@_") or end < len(text) and (text[end].isalnum() or text[end] in "@_"):
        return False
    d = only_digits(piece)
    if kind == "email":
        user, _, host = piece.partition("@")
        return bool(re.search("[A-Za-z0-9]", user)) and bool(re.search(r"[A-Za-z0-9][^A-Za-z0-9]{1,3}[A-Za-z]", host))
    if kind == "ip":
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^0-9 .\[\](){}]", piece)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9 ._-]", piece)
    if kind == "phone":
        return 9 <= len(d) <= 15 and len(set(d)) > 1 and bool(re.search(r"[ ().+/-]", piece)) and not re.search(r"[^0-9 ().+/-]", piece)
    return len(piece) >= 16 and len(d) >= 2 and bool(re.search("[A-Za-z]", piece)) and not re.search(r"[^A-Za-z0-9_/+=.-]", piece)


def spans_of(reader: Reader, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text, (kind, start, end, from a pattern), by kind and then start."""
    out = []
    for text, seen in zip(texts, predicted(reader, texts), strict=True):
        base = patterns(text)
        added = []
        for kind, a, b in seen:
            while b > a and text[b - 1] in " .,;:":
                b -= 1
            while a < b and text[a] == " ":
                a += 1
            if a < b and passes(kind, text, a, b) and not any(x < b and a < y for _, x, y in base + [s[:3] for s in added]):
                added.append((kind, a, b, False))
        out.append(sorted([(*s, True) for s in base] + added, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones become one."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(df: DataFrame, model: Tagger | None = None, text_col: str = "text", redacted: bool = False) -> DataFrame:
    """Add spans, an array of (kind, start, end, base), and if asked `redacted`, the text without them."""
    fields = [T.StructField("spans", SPANS), *([T.StructField("redacted", T.StringType())] if redacted else [])]
    kept = [f for f in df.schema.fields if f.name not in {"spans", "redacted"}]
    held = df.sparkSession.sparkContext.broadcast(Reader(model or trained()))

    def make():
        reader = held.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, text_col)
            spans = spans_of(reader, texts)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            arrays.append(pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in row] for row in spans], _ARROW_SPANS))
            if redacted:
                arrays.append(pa.array([redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()))
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept + fields])

        return step

    return map_batches(df, make, T.StructType(kept + fields))
