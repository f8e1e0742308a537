r"""Personal data in texts: fixed patterns, and a character-level BiLSTM with CRF transitions.

The patterns give the base spans.  The network, trained in numpy from labelled spans
(``labelled``: prose with personal data in many spellings, and with numbers and hashes
that aren't), adds what they miss: spelled-out and broken-up addresses, numbers without a
country code or with other separators, and kinds that only their surroundings tell,
such as secrets.  It reads windows of ``WINDOW`` characters at every ``STEP``; each is
decoded by Viterbi, and a span of at most ``LONGEST`` characters lies whole inside one
of them.  Spans of all windows of a text are then reconciled globally: the disjoint set
with the largest sum of scores is kept, and spans that touch a base span give way to it.

Any span holds a digit, an at sign, or one of at and dot spelled (``TRIGGER``).  Windows
cover the text within ``REACH`` characters of those; what lies further off can be part
of no span.  ``valid`` checks what the network finds, by what a kind is made of.
Patterns run in time linear in the text, also on endless runs of digits or letters.

Training takes bounded, generated rows (``BATCHES`` batches of ``BATCH`` windows) and
is deterministic; weights are made once per driver process and sent with the tasks.

Defined results: null text counts as empty (no spans); texts of any length are read
whole; repeated rows and ties are independent rows; ids may be null; the caller's
columns come back inside ``row``; empty tables give no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gives_back, row_of, table

#: The first four have base patterns; the others are the network's alone.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
BASE_KINDS = KINDS[:4]
WINDOW, LONGEST = 128, 64
#: No less than LONGEST, so that a window begins before any span that holds a trigger.
REACH = LONGEST
#: Of windows: a span needs a character before and behind it, save at the text's ends.
STEP = WINDOW - LONGEST - 1
BATCHES, BATCH, LENGTH, HIDDEN, EMBEDDED = 900, 48, 96, 28, 12
SIGNS = 130  # 0: padding; 1 to 128: ASCII; 129: all others
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]

# ---------------------------------------------------------------- base spans

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the sign isn't part of a local part, so each sign has one candidate."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Of a run of dotted numbers the first four are a match, then the next four."""
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(a, 0, z) for a, z in emails(text)] + [(a, 1, z) for a, z in addresses(text)]
    for m in DIGITS.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PLUS.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# ------------------------------------------------------------- labelled rows


def _with_luhn(rng: random.Random, first: str, size: int) -> str:
    body = first + "".join(rng.choice("0123456789") for _ in range(size - 2))
    return next(body + d for d in "0123456789" if luhn(body + d))


#: What stands before secrets, and before strings that look like them.
SECRET_WORDS = ("token", "token", "api_key", "apikey", "api key", "secret", "password", "passwd", "access_key", "auth_token", "client_secret", "private_key", "bearer", "credential")
HASH_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "etag", "checksum", "digest", "rev", "revision", "hash", "build", "blob", "object", "id")


def labelled(rng: random.Random) -> tuple[str, list[str]]:
    """A text with a tag for each character."""
    syllables = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "é", "ö", "ç", "ñ", "ung", "eau", "dot")
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    plain = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    joined = lambda sign, parts: sign.join(parts)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    set_to = lambda: rng.choice((" = ", "=", ": ", ":", " := ", " ", " is "))

    def personal() -> tuple[str, str, str, str]:
        """What stands before, the kind, the span, what stands behind."""
        kind = rng.choice((*KINDS, "email", "phone", "card", "secret", "secret"))
        if kind == "email":
            local = plain() + rng.choice(("", "." + plain(), "." + digits(2), "_" + plain(), digits(2)))
            host, end = plain() + rng.choice(("", digits(1))), rng.choice((("com",), ("org",), ("net",), ("example", "com"), ("co", "uk"), ("de",)))
            at, dot = rng.choice((("@", "."), ("@", "."), ("(at)", "."), (" (at) ", "."), ("[at]", "."), (" [at] ", "."), (" at ", " dot "), (" AT ", " DOT "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("@", "[.]")))
            return "", kind, f"{local}{at}{joined(dot, (host, *end))}", ""
        if kind == "ip":
            if rng.random() < 0.3:
                return "", kind, joined(":", [hexes(rng.randint(1, 4)) for _ in range(8)]), ""
            return "", kind, joined(rng.choice((".", ".", "[.]", "(.)")), [str(rng.randint(0, 255)) for _ in range(4)]), ""
        if kind == "card":
            number, sep = _with_luhn(rng, rng.choice("3456"), 16), rng.choice(("", "", " ", "-", ".", "  ", " - ", "_", "/"))
            return "", kind, joined(sep, [number[k : k + 4] for k in range(0, 16, 4)]), ""
        if kind == "ssn":
            return rng.choice(("", "", "ssn ", "SSN: ", "social security ")), kind, f"{digits(3)}-{digits(2)}-{digits(4)}", ""
        if kind == "secret":
            quote = rng.choice(('"', '"', "'", ""))
            value = rng.choice((hexes(32), hexes(40), hexes(40), hexes(40), hexes(64), mixed(rng.randint(20, 44)), "sk_live_" + mixed(24), "ghp_" + mixed(36)))
            return rng.choice(SECRET_WORDS) + (set_to() if quote or rng.random() < 0.5 else "=") + quote, kind, value, quote
        a, b, c = digits(3), digits(3), digits(4)
        two = [digits(2) for _ in range(4)]
        sep = rng.choice((" ", ".", "-"))
        return "", kind, rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", joined(sep, (a, b, c)), f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"({a}) {b} {c}", f"+{digits(11)}", f"1-{a}-{b}-{c}", joined(sep, ("0" + digits(1), *two)), f"0{digits(1)} {digits(4)} {digits(4)}")), ""

    def other() -> str:
        quote = rng.choice(('"', "", "", "'"))
        looks = f"{rng.choice((*HASH_WORDS, word(), word()))}{set_to()}{quote}{rng.choice((hexes(32), hexes(40), hexes(40), hexes(64), mixed(rng.randint(20, 44))))}{quote}"
        return rng.choice((digits(rng.randint(1, 6)), str(rng.randint(1900, 2030)), f"{digits(1)}.{digits(1)}", f"version {digits(1)}.{digits(1)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"${digits(3)},{digits(3)}", looks, looks, rng.choice(SECRET_WORDS) + " " + word(), digits(rng.randint(9, 11)), "@" + plain(), f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"ISBN {digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}", f"{word()} at {word()} dot", f"{digits(4)}/{digits(2)}/{digits(2)}"))

    text, tags = "", []
    while len(text) < LENGTH:
        r = rng.random()
        before, kind, part, behind = personal() if r < 0.25 else ("", "", other() if r < 0.4 else word(), "")
        if rng.random() < 0.1 and not kind:
            part = part.capitalize()
        text += before + part + behind
        tags += ["O"] * len(before) + ([f"B-{kind}"] + [f"I-{kind}"] * (len(part) - 1) if kind else ["O"] * len(part)) + ["O"] * len(behind)
        gap = rng.choice((" ", " ", " ", " ", ", ", ". ", "\n", ": ", " | "))
        text += gap
        tags += ["O"] * len(gap)
    text = text[:LENGTH]
    return text.upper() if rng.random() < 0.1 else text, tags[:LENGTH]


def signs(texts: list[str], length: int) -> np.ndarray:
    out = np.zeros((len(texts), length), np.int64)
    for k, t in enumerate(texts):
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[k, : len(points)] = np.where(points < 128, points + 1, 129)
    return out


# ------------------------------------------------------------------- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def allowed() -> np.ndarray:
    """CRF transitions: a span goes on only in its own kind."""
    return np.array([[not b.startswith("I") or a[2:] == b[2:] for b in TAGS] for a in TAGS])


class BiLstmCrf:
    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7):
        if weights is None:
            rng = np.random.default_rng(seed)
            w = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
            weights = {"embed": w(SIGNS, EMBEDDED), "out": w(2 * HIDDEN, len(TAGS)), "bias": np.zeros(len(TAGS), np.float32), "trans": np.zeros((len(TAGS), len(TAGS)), np.float32)}
            for d in "fb":
                forget = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
                weights |= {f"x{d}": w(EMBEDDED, 4 * HIDDEN), f"h{d}": w(HIDDEN, 4 * HIDDEN), f"c{d}": forget}
        self.w = weights
        self.barred = np.where(allowed(), 0, -1e4).astype(np.float32)
        self.first = np.array([-1e4 if t.startswith("I") else 0 for t in TAGS], np.float32)

    def _run(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """One direction over x (time, batch, embedded)."""
        time, batch, _ = x.shape
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c, out = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32), np.empty((time, batch, HIDDEN), np.float32)
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            z = pre[t] + h @ self.w[f"h{d}"]
            s, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before, c = c, f * c + i * g
            ct = np.tanh(c)
            if keep is not None:
                keep.append((t, h, before, i, f, o, g, ct))
            h = out[t] = o * ct
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """codes (batch, time) to scores (time, batch, tags)."""
        x = self.w["embed"][codes.T]
        steps = {"f": [] if keep is not None else None, "b": [] if keep is not None else None}
        both = np.concatenate([self._run(x, d, steps[d]) for d in "fb"], axis=2)
        if keep is not None:
            keep |= {"x": x, "steps": steps, "both": both}
        return both @ self.w["out"] + self.w["bias"]

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch, time) and the margin of each over no span."""
        e = self.emissions(codes)
        time, batch, tags = e.shape
        trans = self.w["trans"] + self.barred
        best, back = e[0] + self.first, np.empty((time, batch, tags), np.int8)
        for t in range(1, time):
            total = best[:, :, None] + trans
            back[t] = total.argmax(axis=1)
            best = total.max(axis=1) + e[t]
        path = np.empty((time, batch), np.int64)
        path[-1] = best.argmax(axis=1)
        for t in range(time - 1, 0, -1):
            path[t - 1] = back[t][np.arange(batch), path[t]]
        margin = np.take_along_axis(e, path[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return path.T, margin.T

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood for each sequence, and its gradients."""
        keep: dict = {}
        e = self.emissions(codes, keep)
        time, batch, tags = e.shape
        trans, gold = self.w["trans"] + self.barred, gold.T
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.first
        for t in range(1, time):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(time - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        pairs = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None])
        d_e = np.exp(alpha + beta - total[None, :, None])
        onehot = np.eye(tags, dtype=np.float32)
        score = np.take_along_axis(e, gold[:, :, None], 2).sum() + trans[gold[:-1], gold[1:]].sum() + self.first[gold[0]].sum()
        d_e = (d_e - onehot[gold]) / batch
        d_trans = (pairs.sum(axis=(0, 1)) - np.einsum("tbi,tbj->ij", onehot[gold[:-1]], onehot[gold[1:]])) / batch
        grads = {"trans": d_trans * allowed(), "bias": d_e.sum(axis=(0, 1)), "out": np.einsum("tbh,tbk->hk", keep["both"], d_e)}
        d_both = d_e @ self.w["out"].T
        d_x = np.zeros_like(keep["x"])
        for d, part in (("f", d_both[:, :, :HIDDEN]), ("b", d_both[:, :, HIDDEN:])):
            d_z = np.empty((time, batch, 4 * HIDDEN), np.float32)
            h_in = np.empty((time, batch, HIDDEN), np.float32)
            d_h, d_c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
            for t, h, before, i, f, o, g, ct in reversed(keep["steps"][d]):
                d_h = d_h + part[t]
                d_c = d_c + d_h * o * (1 - ct * ct)
                d_z[t] = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * ct * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
                h_in[t] = h
                d_h, d_c = d_z[t] @ self.w[f"h{d}"].T, d_c * f
            grads |= {f"x{d}": np.einsum("tbe,tbz->ez", keep["x"], d_z), f"h{d}": np.einsum("tbh,tbz->hz", h_in, d_z), f"c{d}": d_z.sum(axis=(0, 1))}
            d_x += d_z @ self.w[f"x{d}"].T
        grads["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(grads["embed"], codes.T, d_x)
        return float((total.sum() - score) / batch), grads

    def train(self, rows: Iterator[tuple[list[str], list[list[str]]]], rate: float = 0.015) -> float:
        """Adam over batches of texts and tags; the last loss."""
        number = {t: k for k, t in enumerate(TAGS)}
        m, v, loss = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0.0
        for step, (texts, tags) in enumerate(rows, 1):
            loss, grads = self.gradients(signs(texts, LENGTH), np.array([[number[t] for t in ts] for ts in tags]))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 2 * (1 - step / (BATCHES + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


@cache
def trained(seed: int = 11) -> BiLstmCrf:
    rng, model = random.Random(seed), BiLstmCrf()
    model.train(tuple(zip(*[labelled(rng) for _ in range(BATCH)])) for _ in range(BATCHES))
    return model


# ------------------------------------------------------------------- windows

#: What any valid span holds: a digit, a sign, or one of both spelled.
TRIGGER = re.compile(r"[0-9@]+|[(\[]at[)\]]|[ (\[]dot[ )\]]", re.I)
DOT = r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot |\[\.\])"
SPELLED = re.compile(rf"[\w.%+-]+(?: ?(?:@|\(at\)|\[at\]) ?| at )[a-z0-9-]+(?:{DOT}[a-z0-9-]+)+", re.I)
QUAD = re.compile(r"[0-9]+(?:(\.|\[\.\]|\(\.\))[0-9]+)(?:\1[0-9]+){2}")
SIXTEENS = re.compile(r"(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}", re.I)
CARD = re.compile(r"[3-6][0-9]*(?:( ?[-._/] ?| {1,2})[0-9]+)?(?:\1[0-9]+)*")
GROUPED = re.compile(r"\+[0-9]+|\+?(?:[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9 .-]*[0-9]")
SECRET = re.compile(r"[A-Za-z0-9_+/=-]{16,}")


def valid(kind: int, text: str, a: int, z: int) -> bool:
    """What a span of the network needs besides its score.  It may not begin or end inside a number or word."""
    part = text[a:z]
    digits = _digits(part)
    if a and z > a and text[a - 1].isalnum() and part[0].isalnum() or z < len(text) and text[z].isalnum() and part[-1:].isalnum():
        return False
    if kind == 0:
        return bool(SPELLED.fullmatch(part))
    if kind == 1:
        return bool(SIXTEENS.fullmatch(part)) or bool(QUAD.fullmatch(part)) and all(int(x) <= 255 for x in re.findall("[0-9]+", part))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and bool(CARD.fullmatch(part))
    if kind == 3:
        groups = len(re.findall("[0-9]+", part))
        return 10 <= len(digits) <= 15 and (part[0] == "+" and groups == 1 or groups in (3, 4, 5)) and bool(GROUPED.fullmatch(part))
    if kind == 4:
        return bool(SECRET.fullmatch(part)) and len(digits) >= 3 and len(digits) < len(part)
    return bool(re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", part))


def windows(text: str) -> list[int]:
    """Starts of the windows over what lies within REACH of a trigger."""
    regions: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, z = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = z
        else:
            regions.append([a, z])
    return [s for a, z in regions for s in range(a, max(a + 1, z - LONGEST), STEP)]


def reconciled(spans: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, kind, end, score): the disjoint spans with the largest sum that touch no base span."""
    free = sorted({s for s in spans if not any(s[0] < z and a < s[2] for a, _, z in base)}, key=lambda s: (s[2], s[0], s[1]))
    best: list[tuple[float, tuple]] = [(0.0, ())]
    for k, s in enumerate(free):
        last = k
        while last and free[last - 1][2] > s[0]:
            last -= 1
        with_it = best[last][0] + s[3]
        best.append((with_it, (s[:3], best[last][1])) if with_it > best[k][0] else best[k])
    out, node = [], best[-1][1]
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def read_spans(texts: list[str], model: BiLstmCrf) -> list[list[tuple[int, int, int, float]]]:
    """Of each text the network's valid spans in all windows: (start, kind's number, end, score)."""
    places = [(k, s) for k, t in enumerate(texts) for s in windows(t)]
    found: list[list] = [[] for _ in texts]
    for at in range(0, len(places), 512):
        some = places[at : at + 512]
        paths, margins = model.decode(signs([texts[k][s : s + WINDOW] for k, s in some], WINDOW))
        for (k, s), path, margin in zip(some, paths, margins):
            text, size = texts[k], min(WINDOW, len(texts[k]) - s)
            for a in np.flatnonzero(path[:size] % 2 == 1):
                kind, z = int(path[a] - 1) // 2, int(a) + 1
                while z < size and path[z] == path[a] + 1:
                    z += 1
                # Cut off by the window's edge: another one holds it whole.
                cut_off = (z == WINDOW and s + z < len(text)) or (a == 0 and s)
                if z - a <= LONGEST and not cut_off and valid(kind, text, s + int(a), s + z):
                    found[k].append((s + int(a), kind, s + z, float(margin[a:z].sum())))
    return found


def find_all(texts: list[str], model: BiLstmCrf) -> list[list[tuple[int, int, int, bool]]]:
    """Of each text: (start, kind's number, end, base), sorted."""
    own = [(base_spans(t), spans) for t, spans in zip(texts, read_spans(texts, model))]
    return [sorted([(*b, True) for b in base] + [(*x, False) for x in reconciled(spans, base)]) for base, spans in own]


def annotate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row``, ``text`` and ``spans``: array of (start, end, kind, base), by start and kind."""
    weights = trained().w

    @F.arrow_udf("array<struct<start:int,end:int,kind:string,base:boolean>>")
    @gives_back
    def spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = BiLstmCrf(weights)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))
        for batch in texts:
            yield pa.array([[{"start": a, "end": z, "kind": KINDS[k], "base": b} for a, k, z, b in one] for one in find_all(batch.to_pylist(), model)], kind)

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(row_of(docs).alias("row"), text.alias("text"), spans(text).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans become one mark, of the first."""
    weights = trained().w

    @F.arrow_udf("string")
    @gives_back
    def redacted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = BiLstmCrf(weights)
        for batch in texts:
            own = batch.to_pylist()
            out = []
            for text, found in zip(own, find_all([t or "" for t in own], model)):
                if not found:
                    out.append(text)
                    continue
                parts, at = [], 0
                for a, k, z, _ in found:
                    if a >= at:
                        parts += [text[at:a], f"<{KINDS[k].upper()}>"]
                    at = max(at, z)
                out.append("".join(parts) + text[at:])
            yield pa.array(out, pa.string())

    done = docs.select(row_of(docs).alias("row"), redacted(F.col(f"`{text_col}`")).alias("own"))
    return done.select(*[F.col("own").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.base)
    count = lambda kind: F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("row.doc_id").alias("doc_id"), *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
