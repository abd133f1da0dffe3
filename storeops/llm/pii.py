"""Operator 12: personal data by patterns and by a character LSTM with a CRF.

The patterns give the base spans. A bidirectional LSTM over characters with a
CRF on top, trained here in numpy, adds what they miss: addresses that are
written out, numbers with other separators, numbers of which a pattern took
too much. It learns from the base spans of a bounded sample of the table and
from such other spellings, put into lines of the sample.

A span of any kind holds a digit, an @ or an "at" in brackets, so only windows
that do are decoded. Windows overlap; a span that a window cuts is left to the windows that hold it
whole, the scores of equal spans are added, and of all candidates of a text
the set without overlaps that scores best is taken. A candidate counts if it
also has the form of its kind and touches no base span.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm import arrays as A
from storeops.llm.shared import Scratch, importable, passed, table

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and from one to the next: spans of up to WINDOW - STRIDE + 1 are whole in some window.
WINDOW, STRIDE = 64, 16
#: Documents that training looks at, about, windows that it takes of them at most, of one document at most, and generated lines.
SAMPLE, WINDOWS, OF_ONE, MADE = 20_000, 3_000, 4, 3_000
#: Sizes of the model and its training.
EMBEDDED, HIDDEN, STEPS, AT_ONCE, RATE = 12, 24, 450, 64, 0.02
#: Windows that are decoded at once.
DECODED = 256
Span = tuple[str, int, int]

GATE, WORDED = re.compile("[0-9@]"), re.compile(r"(?i)[\[(]\s?at\s?[\])]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(numbers: list[int]) -> bool:
    return not sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(numbers))) % 10


def is_ip(text: str) -> bool:
    parts = re.findall("[0-9]+", text)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def is_card(text: str) -> bool:
    return 12 <= len(found := digits(text)) <= 19 and luhn(found)


def is_phone(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the characters that may stand before it, not into the match before: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns by start, then kind."""
    if not GATE.search(text):
        return []
    found = [("email", a, b) for a, b in emails(text)]
    for kind, pattern, fits in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if fits(m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Other spellings, for training and as the forms that an added span must have.

AT, DOT = r"\s?(?:@|[\[(]\s?at\s?[\])])\s?", r"\s?(?:\.|[\[(]\s?dot\s?[\])])\s?"
WRITTEN = re.compile(rf"(?i)[^\s@()\[\]]+{AT}[\w-]+(?:{DOT}[\w-]+)+")


def fits(kind: str, text: str) -> bool:
    """Whether a text has the form of its kind."""
    if kind == "email":
        return bool(WRITTEN.fullmatch(text))
    return {"ip": is_ip, "card": is_card, "phone": is_phone}[kind](text) and not re.search(r"[^\W\d_]", text)


def written(rng: np.random.Generator, kind: str | None) -> str:
    """A spelling of a kind, or without one, a text with digits that is nothing of the sort."""

    def some(n: int, of: str = "0123456789") -> str:
        return "".join(rng.choice(list(of), n))

    def word() -> str:
        return some(int(rng.integers(2, 9)), "abcdefghijklmnopqrstuvwxyz")

    def one(*of: str) -> str:
        return str(rng.choice(list(of)))

    if kind == "email":
        name = word() + one("", ".", "_", "-") + one(word(), some(2), "")
        return (name.strip("._-") or "a") + one("@", "@", " @ ", " (at) ", "(at)", " [at] ", "[at]") + word() + one(".", ".", " (dot) ", "(dot)", " [dot] ") + one("com", "org", "net", "de", word())
    if kind == "ip":
        return one(".", ".", ".", " . ", "[.]").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == "card":
        body = one("4", "5", "37", "6011") + some(12)
        body = body[: int(rng.integers(12, 16))]
        whole = body + next(d for d in "0123456789" if luhn(digits(body + d)))
        sep = one("", "", " ", "-", ".", "  ", "/")
        return sep.join(whole[k : k + 4] for k in range(0, len(whole), 4))
    if kind == "phone":
        sep = one(" ", "-", ".", "")
        groups = [some(int(rng.integers(2, 5))) for _ in range(3)]
        abroad = one("+", "+", "00", "") + one("1", "45", "49", "33") + one(" ", "-") + sep.join(groups)
        return abroad if rng.random() < 0.6 else f"({some(3)}) {some(3)}-{some(4)}"
    times = (f"20{some(2)}-0{some(1)}-1{some(1)}", f"1{some(1)}:{some(2)}:{some(2)}")
    numbers = (f"{some(1)}.{some(1)}.{some(2)}", f"{some(1)}.", f"{some(2)}.", f"{some(3)},{some(2)}", f"v{some(1)}.{some(1)}", f"{some(1)} {some(1)} {some(2)}", some(int(rng.integers(1, 9))), some(int(rng.integers(20, 30))))
    tokens = (some(int(rng.integers(12, 40)), "0123456789abcdef"), some(int(rng.integers(12, 40)), "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP"), f"{word()}={some(10, '0123456789abcdefXYZ')}", f"@{word()}", f"{word()}{some(3)}")
    return one(*times, *numbers, *tokens)


def gates(text: str) -> np.ndarray:
    """The sorted places at which a span may be."""
    worded = WORDED.finditer(text) if "(" in text or "[" in text else ()
    return np.array(sorted([m.start() for p in (GATE.finditer(text), worded) for m in p]), np.int64)


# Characters and tags. Tag 0 is outside, then beginning and inside of each kind.

CLASSES = 3 + 128
TAGS = 1 + 2 * len(KINDS)


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point: ASCII characters of their own, all digits one, other letters one, all else one; 0 is beyond the text."""
    out = np.where(points < 128, points + 3, 1)
    out[(points >= 48) & (points < 58)] = 48 + 3
    other = np.flatnonzero(points >= 128)
    out[other] = [2 if chr(c).isalpha() else 1 for c in points[other].tolist()]
    return out.astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def tags(length: int, spans: list[Span], at: int = 0) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        a, b = max(0, start - at), min(length, end - at)
        if a < b and not out[a:b].any():
            out[a:b] = 2 + 2 * KINDS.index(kind)
            out[a] -= 1
    return out


def window_starts(held: np.ndarray) -> np.ndarray:
    """Where the windows begin that cover one of the sorted places; windows lie on a grid and may begin before the text."""
    last = held // STRIDE
    return np.unique(np.concatenate([(last - k) * STRIDE for k in range(WINDOW // STRIDE)])) if len(held) else held


def window(values: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    lo, hi = max(0, start), min(len(values), start + WINDOW)
    out[lo - start : hi - start] = values[lo:hi]
    return out


# The model.


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Scores of forbidden steps and beginnings: inside a kind only after its beginning or inside."""
    step, first = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)
    for k in range(2, TAGS, 2):
        first[k] = -1e4
        step[[j for j in range(TAGS) if j not in (k, k - 1)], k] = -1e4
    return step, first


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Model:
        def normal(*shape: int, by: float) -> np.ndarray:
            return (rng.standard_normal(shape) * by).astype(np.float32)

        # Letters of one case begin alike, and come apart where the labels need it.
        embedded = normal(CLASSES, EMBEDDED, by=0.5)
        for first in (65, 97):
            embedded[3 + first : 3 + first + 26] = embedded[3 + first] + normal(26, EMBEDDED, by=0.1)
        bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
        bias[:, :, HIDDEN : 2 * HIDDEN] = 1  # remembers at first
        both = {"x": normal(2, EMBEDDED, 4 * HIDDEN, by=EMBEDDED**-0.5), "h": normal(2, HIDDEN, 4 * HIDDEN, by=HIDDEN**-0.5), "b": bias}
        return cls(both | {"embedded": embedded, "out": normal(2 * HIDDEN, TAGS, by=0.2), "out_b": np.zeros(TAGS, np.float32), "step": normal(TAGS, TAGS, by=0.1), "first": np.zeros(TAGS, np.float32)})

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(scores of tags, what the backward pass needs) of windows, time first."""
        w = self.weights
        x = w["embedded"][ids]
        x = np.stack([x, x[::-1]], axis=1)  # time, direction, window, value
        h, kept = run(x, w["x"], w["h"], w["b"])
        both = np.concatenate([h[:, 0], h[::-1, 1]], axis=2)
        return both @ w["out"] + w["out_b"], (ids, x, both, kept)

    def gradients(self, d: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        w, (ids, x, both, own) = self.weights, kept
        flat = d.reshape(-1, TAGS)
        out = {"out": both.reshape(-1, 2 * HIDDEN).T @ flat, "out_b": flat.sum(axis=0)}
        dboth = d @ w["out"].T
        dx, out["x"], out["h"], out["b"] = back(np.stack([dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]], axis=1), x, w["x"], w["h"], own)
        of_class = np.zeros((ids.size, CLASSES), np.float32)
        of_class[np.arange(ids.size), ids.ravel()] = 1
        out["embedded"] = of_class.T @ (dx[:, 0] + dx[::-1, 1]).reshape(-1, EMBEDDED)
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags of the best path, how far each character's tag scores above outside) of windows, time first."""
        scores, _ = self.emissions(ids)
        step, first = (self.weights[k] + x for k, x in zip(("step", "first"), allowed(), strict=True))
        best, came = scores[0] + first, []
        for e in scores[1:]:
            each = best[:, :, None] + step
            came.append(each.argmax(axis=1))
            best = each.max(axis=1) + e
        path = [best.argmax(axis=1)]
        for c in reversed(came):
            path.append(np.take_along_axis(c, path[-1][:, None], axis=1)[:, 0])
        path = np.array(path[::-1])
        return path, np.take_along_axis(scores, path[:, :, None], axis=2)[:, :, 0] - scores[:, :, 0]


def run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """LSTMs over (time, direction, window, value), with weights for each direction: (outputs, what the backward pass needs)."""
    gates = x @ wx + b
    n, _, many, h = *x.shape[:3], wh.shape[1]
    hs, cs, tops = np.zeros((n + 1, 2, many, h), np.float32), np.zeros((n + 1, 2, many, h), np.float32), np.empty((n, 2, many, h), np.float32)
    for t in range(n):
        g = gates[t]
        g += hs[t] @ wh
        g[..., : 3 * h] *= 0.5
        np.tanh(g, out=g)
        g[..., : 3 * h] *= 0.5
        g[..., : 3 * h] += 0.5  # in, forget, out; then new
        np.multiply(g[..., h : 2 * h], cs[t], out=cs[t + 1])
        cs[t + 1] += g[..., :h] * g[..., 3 * h :]
        np.tanh(cs[t + 1], out=tops[t])
        np.multiply(g[..., 2 * h : 3 * h], tops[t], out=hs[t + 1])
    return hs[1:], (hs, cs, gates, tops)


def back(dh: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: tuple) -> tuple[np.ndarray, ...]:
    """Gradients of inputs, input weights, own weights and bias."""
    hs, cs, gates, tops = kept
    n, _, many, h = tops.shape
    i, f, o, g = (gates[..., k * h : (k + 1) * h] for k in range(4))
    slope = gates.copy()
    slope[..., : 3 * h] *= 1 - slope[..., : 3 * h]
    slope[..., 3 * h :] = 1 - g**2
    # What the change of a cell, or of the output, is multiplied with at each gate.
    slope *= np.concatenate([g, cs[:-1], tops, i], axis=3)
    through = o * (1 - tops**2)
    d, turned = np.empty_like(gates), wh.transpose(0, 2, 1)
    nh, nc = np.zeros((2, many, h), np.float32), np.zeros((2, many, h), np.float32)
    for t in reversed(range(n)):
        nh += dh[t]
        nc += nh * through[t]
        d[t, ..., : 2 * h] = slope[t, ..., : 2 * h] * np.concatenate([nc, nc], axis=2)
        d[t, ..., 2 * h : 3 * h] = slope[t, ..., 2 * h : 3 * h] * nh
        d[t, ..., 3 * h :] = slope[t, ..., 3 * h :] * nc
        nc = nc * f[t]
        nh = d[t] @ turned
    side = lambda a: a.transpose(1, 0, 2, 3).reshape(2, n * many, -1)
    flat = side(d)
    return d @ wx.transpose(0, 2, 1), side(x).transpose(0, 2, 1) @ flat, side(hs[:-1]).transpose(0, 2, 1) @ flat, flat.sum(axis=1, keepdims=True)


def crf(scores: np.ndarray, gold: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(mean negative log-likelihood, gradients of scores, steps and beginnings) by the forward-backward algorithm, scaled at each character."""
    n, many, _ = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e, go = np.exp(scores - top), np.exp(step)
    alpha, beta, c = np.empty_like(e), np.ones_like(e), np.empty((n, many, 1), e.dtype)
    alpha[0] = e[0] * np.exp(first)
    for t in range(n):
        if t:
            np.multiply(alpha[t - 1] @ go, e[t], out=alpha[t])
        c[t] = alpha[t].sum(axis=1, keepdims=True)
        alpha[t] /= c[t]
    for t in reversed(range(n - 1)):
        beta[t] = ((e[t + 1] * beta[t + 1]) @ go.T) / c[t + 1]
    each = alpha * beta
    pairs = go * np.einsum("tbi,tbj->ij", alpha[:-1], e[1:] * beta[1:] / c[1:], optimize=True)
    path = first[gold[0]] + np.take_along_axis(scores, gold[:, :, None], 2)[:, :, 0].sum(axis=0) + step[gold[:-1], gold[1:]].sum(axis=0)
    np.put_along_axis(each, gold[:, :, None], np.take_along_axis(each, gold[:, :, None], 2) - 1, 2)
    np.add.at(pairs, (gold[:-1].ravel(), gold[1:].ravel()), -1)
    whole = (np.log(c) + top).sum(axis=(0, 2))
    return float((whole - path).mean()), each / many, pairs / many, each[0].sum(axis=0) / many


def fit_windows(ids: np.ndarray, gold: np.ndarray, seed: int = 12, steps: int = STEPS) -> Model:
    """Trains on windows (rows) and their tags by Adam, the same rows giving the same model."""
    rng = np.random.default_rng(seed)
    model = Model.fresh(rng)
    w, (no_step, no_first) = model.weights, allowed()
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    order = np.concatenate([rng.permutation(len(ids)) for _ in range(1 + steps * AT_ONCE // len(ids))])
    for k in range(steps):
        some = order[k * AT_ONCE : (k + 1) * AT_ONCE]
        scores, kept = model.emissions(ids[some].T)
        _, d, d_step, d_first = crf(scores, gold[some].T, w["step"] + no_step, w["first"] + no_first)
        grads = model.gradients(d.astype(np.float32), kept) | {"step": d_step, "first": d_first}
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 3 * (1 - k / steps)) * min(1.0, 5 / max(norm, 1e-9))
        for name, g in grads.items():
            mean[name] = 0.9 * mean[name] + 0.1 * g
            square[name] = 0.99 * square[name] + 0.01 * g * g
            w[name] = (w[name] - rate * (mean[name] / (1 - 0.9 ** (k + 1))) / (np.sqrt(square[name] / (1 - 0.99 ** (k + 1))) + 1e-6)).astype(np.float32)
    return model


# Training data.


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of texts with their base spans, and a line of texts without digits, each with a hash that orders them."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            held = gates(text)
            each = [(text[max(0, s) : s + WINDOW], s) for s in window_starts(held).tolist()] if len(held) else [(text[:WINDOW], 0)]
            marked = [(int.from_bytes(hashlib.blake2b(f"{len(text)}:{s}:{t}".encode("utf-8", "replace"), digest_size=7).digest()), t, tags(WINDOW, spans, s)[max(0, -s) :][: len(t)].tobytes(), bool(len(held))) for t, s in each]
            rows += sorted(m for m in marked if not WORDED.search(m[1]))[:OF_ONE]  # patterns can't label those
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.bool_()), strict=True)], names=["hash", "text", "tags", "held"])


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, windows: int = WINDOWS) -> tuple[list[tuple[str, bytes]], list[str]]:
    """(windows with their tags, lines without digits) of about ``sample`` documents, picked by the hash of their ids; at most ``windows`` of each reach the driver."""
    scratch = Scratch(docs.sparkSession, "pii")
    share = sample / max(1, docs.count())
    picked = docs.filter(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(id_col, F.lit(12)), F.lit(1 << 20)) < share * (1 << 20)))
    rows = scratch.write(picked.select(F.col(text_col).alias("text")).mapInArrow(_labelled, "hash bigint, text string, tags binary, held boolean"), "windows")
    some = [rows.filter(F.col("held") == held).orderBy("hash", "text").limit(n).collect() for held, n in ((True, windows), (False, windows))]
    return [(r["text"], r["tags"]) for r in some[0]], [r["text"] for r in some[1]]


#: Lines for small tables.
LINES = ["some words of a line that holds nothing of the kind", "and another one, shorter", "this goes on for a while: one (or two), three", "el camino no es largo y no tiene nada que ver"]


def made_rows(lines: list[str], n: int = MADE, seed: int = 12) -> list[tuple[str, np.ndarray]]:
    """Lines with a spelling of some kind, or with digits that are none, put in at a space."""
    rng = np.random.default_rng(seed)
    lines = [x for x in lines if x.strip()]
    lines += LINES if len(lines) < 100 else []
    out = []
    for k in range(n):
        kind = KINDS[k % 8] if k % 8 < len(KINDS) else None
        line, told = str(lines[int(rng.integers(len(lines)))])[: WINDOW // 2], written(rng, kind)
        at = (line.rfind(" ", 0, int(rng.integers(1, WINDOW // 2))) + 1) if line else 0
        text = (line[:at] + told + str(rng.choice([" ", "\n", ", ", ".", ""], p=[0.6, 0.1, 0.1, 0.1, 0.1])) + line[at:])[:WINDOW]
        if at + len(told) > WINDOW:
            continue
        after = text[at + len(told) : at + len(told) + 1]
        if after.isalnum():
            text = text[: at + len(told)] + " " + text[at + len(told) :][: WINDOW - at - len(told) - 1]
        out.append((text, tags(len(text), [(kind, at, at + len(told))] if kind else [])))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, windows: int = WINDOWS, made: int = MADE) -> Model:
    """A model from base spans of a sample of ``docs`` and from generated lines; without any row, from generated lines alone."""
    found, lines = training_rows(docs, id_col, text_col, sample, windows)
    rows = [(t, np.frombuffer(g, np.int64)) for t, g in found] + made_rows(lines, made)
    ids, gold = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for k, (text, own) in enumerate(rows):
        ids[k, : len(text)] = classes(code_points(text))
        gold[k, : len(own)] = own
    return fit_windows(ids, gold)


# Search.


def window_spans(path: np.ndarray, above: np.ndarray, start: int, length: int) -> Iterator[tuple[Span, float]]:
    """The spans of a window's path with their scores, but for those that the window cuts."""
    marks = np.flatnonzero(path)
    k = 0
    while k < len(marks):
        a = int(marks[k])
        kind = (int(path[a]) - 1) // 2
        b = a + 1
        while b < WINDOW and path[b] == 2 + 2 * kind:
            b += 1
        k = int(np.searchsorted(marks, b))
        cut = a == 0 and start > 0 or b == WINDOW and start + WINDOW < length
        if not cut and start + a >= 0 and start + b <= length:
            yield (KINDS[kind], start + a, start + b), float(above[a:b].sum())


def best_set(scored: dict[Span, float]) -> list[Span]:
    """The spans without overlaps of the largest sum of scores; ties go to the earlier spans."""
    spans = sorted((s for s in scored if scored[s] > 0), key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    sums, take = [0.0], []
    for k, s in enumerate(spans):
        before = int(np.searchsorted(ends[:k], s[1], side="right"))
        with_it = sums[before] + scored[s]
        take.append(before if with_it > sums[-1] else -1)
        sums.append(max(sums[-1], with_it))
    out, k = [], len(spans)
    while k:
        if take[k - 1] >= 0:
            out.append(spans[k - 1])
            k = take[k - 1]
        else:
            k -= 1
    return out[::-1]


def added_spans(texts: list[str], base: list[list[Span]], model: Model) -> list[list[Span]]:
    """What the model finds in each text beside its base spans."""
    scored: list[dict[Span, float]] = [defaultdict(float) for _ in texts]
    queue: list[tuple[int, int, np.ndarray]] = []

    def work() -> None:
        if queue:
            path, above = model.decode(np.array([x for _, _, x in queue]).T)
            for k, (row, start, _) in enumerate(queue):
                for span, score in window_spans(path[:, k], above[:, k], start, len(texts[row])):
                    scored[row][span] += score
            queue.clear()

    for row, text in enumerate(texts):
        held = gates(text)
        if not len(held):
            continue
        ids = classes(code_points(text))
        for start in window_starts(held).tolist():
            queue.append((row, start, window(ids, start)))
            if len(queue) == DECODED:
                work()
    work()
    out = []
    for text, own, found in zip(texts, base, scored, strict=True):
        some = []
        for kind, a, b in best_set(found) if found else ():
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
            alone = not text[a - 1 : a].isalnum() and not text[b : b + 1].isalnum()
            if a < b and alone and fits(kind, text[a:b]) and not any(a < y and x < b for _, x, y in own):
                some.append((kind, a, b))
        out.append(some)
    return out


def _search(model):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, _, _ in A.chunks(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, model.value)
                spans = [[{"kind": k, "start": a, "end": b, "base": s < len(x)} for s, (k, a, b) in enumerate(x + y)] for x, y in zip(base, more, strict=True)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(spans, kind)], names=["id", "spans"])

    return run_


def find_pii(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (kind, start, end, base) in code points, base spans first.

    A null or empty text has no spans. Ids of any type, null or repeated, pass
    through; other columns are not looked at; an empty table gives an empty
    result. Nothing is shuffled: a text is searched where it is read, a very
    long one with a bounded number of windows at a time. Of patterns that
    overlap each keeps its spans; of the model's candidates equal scores go to
    the earlier.
    """
    spark = docs.sparkSession
    importable(spark)
    schema = passed(docs.schema[id_col].dataType, "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_search(spark.sparkContext.broadcast(model)), schema).withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, the number of base spans of each kind, base_sha256 and all spans as kind:start:end by start, then kind."""
    base = F.filter("spans", lambda s: s["base"])

    def told(spans):
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(id_col, *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(find_pii(docs, fit(docs)))
