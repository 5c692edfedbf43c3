"""Personal data by patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans of four kinds. The tagger, trained in numpy from labelled spans, adds what they
miss: it reads overlapping windows, each character takes its tag from the window in which it lies most centrally,
and the spans come from the tags so joined, so none is cut at a window's edge. An added span must lie between
characters that are neither letters nor digits, have its kind's count of digits, and touch no base span.

A span of these kinds holds a digit or an at sign; windows without one within reach hold no span and are not read.
That rule doesn't depend on the table's size, and all of every text is scanned for it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# --- the base patterns -------------------------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from every other one: the look-behind spares those attempts.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As a leftmost search for local part, at sign and domain would, but linear: the local part grows leftwards."""
    end = 0
    at = text.find("@")
    while at >= 0:
        before = text[end:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if local else None
        if found:
            yield "email", at - local, found.end()
            end = found.end()
        else:
            end = at + 1  # the next local part can't reach over an at sign
        at = text.find("@", max(end, at + 1) if found is None else end)


def base_spans(text: str | None) -> list[Span]:
    """By kind as in KINDS, then by start."""
    if not text:
        return []
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- labelled examples -------------------------------------------------------------------------------------------

_SYLLABLES = "an er th in on re ti es or te of ed is it al ar st to nt ing ha ve io le me se che que ción lich ung keit é ü ñ ç".split()


def labelled_examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """n made-up passages with their true spans: the patterns' formats, formats that they miss, and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    letters = lambda k: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, k))

    def word() -> str:
        w = "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))
        return pick((w, w, w, w.capitalize(), w.upper())) + pick(("", "", "", "", ",", ".", "!!", "%%%", "\n"))

    def email() -> str:
        host = pick(("mail", "post", letters(5))) + pick(("", digits(1))) + pick((".", ".")) + pick(("example", letters(6))) + pick((".com", ".org", ".de", ".net"))
        local = letters(int(rng.integers(2, 9))) + pick(("", ".", "_", "+", "-")) + pick(("", digits(2), letters(4)))
        return f"{local} @ {host}" if rng.random() < 0.25 else f"{local}@{host}"

    def ip() -> str:
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4))

    def card() -> str:
        sep = pick(("", "", " ", "-", "."))
        body = digits(15)
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+{digits(1)} ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(2)} {c} {digits(4)}"))

    def other() -> str:
        return pick((
            f"{digits(1)}.{digits(1)}.", f"version {digits(1)}.{digits(1)}", f"CC BY-NC {digits(1)}.0.", digits(4), digits(5), f"{digits(2)}:{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}",
            f"{digits(1)},{digits(3)},{digits(3)}", f"AKIA{letters(4).upper()}{digits(2)}{letters(5).upper()}{digits(1)}{letters(4).upper()}", f"password={hashlib.md5(digits(9).encode()).hexdigest()[:18]}", f'token = "{hashlib.sha1(digits(9).encode()).hexdigest()}"', f"@{letters(6)}", f"{digits(2)}%", f"({digits(2)})",
        ))

    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW + STRIDE:
            r = rng.random()
            if r < 0.28:
                kind = pick(KINDS)
                value = made[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + pick(("", "", ",", ".", "!!", "%%%"))
            elif r < 0.45:
                text += other()
            else:
                text += word()
            text += " "
        out.append((text, spans))
    return out


# --- the tagger --------------------------------------------------------------------------------------------------

WINDOW, STRIDE, REACH = 64, 32, 24
TAGS = 1 + 2 * len(KINDS)  # outside, then the first and any further character of each kind
_VOCAB = 132


def char_ids(points: np.ndarray) -> np.ndarray:
    """Code points to the tagger's alphabet: ASCII as it is, other letters 129, anything else 130; 131 pads."""
    return np.where(points < 128, points, np.where((points >= 0xC0) & (points < 0x2000), 129, 130)).astype(np.int64)


@dataclass
class Tagger:
    """Weights: embedding, the two directions' gates stacked, emission and CRF transitions."""

    hidden: int = 16
    seed: int = 3
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.p:
            rng, d, h = np.random.default_rng(self.seed), 12, self.hidden
            init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
            self.p = {"emb": init(_VOCAB, d), "w": init(2, d + h, 4 * h), "b": np.zeros((2, 1, 4 * h), np.float32), "u": init(2 * h, TAGS), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
            self.p["b"][:, :, h : 2 * h] = 1  # remember at first

    def _forward(self, ids: np.ndarray, keep: bool):
        """ids: (windows, WINDOW). Emissions (windows, WINDOW, TAGS), and what the backward pass needs."""
        p, h = self.p, self.hidden
        x = p["emb"][np.stack([ids, ids[:, ::-1]])]  # (2, n, T, d)
        n, steps = ids.shape
        d = x.shape[-1]
        base = np.matmul(x.reshape(2, n * steps, d), p["w"][:, :d]).reshape(2, n, steps, 4 * h) + p["b"][:, :, None]
        hs, cs = np.zeros((2, n, steps + 1, h), np.float32), np.zeros((2, n, steps + 1, h), np.float32)
        gates = np.empty((2, n, steps, 4 * h), np.float32) if keep else None
        for t in range(steps):
            z = base[:, :, t] + np.matmul(hs[:, :, t], p["w"][:, d:])
            z[..., : 3 * h] = 1 / (1 + np.exp(-z[..., : 3 * h]))
            z[..., 3 * h :] = np.tanh(z[..., 3 * h :])
            cs[:, :, t + 1] = z[..., h : 2 * h] * cs[:, :, t] + z[..., :h] * z[..., 3 * h :]
            hs[:, :, t + 1] = z[..., 2 * h : 3 * h] * np.tanh(cs[:, :, t + 1])
            if keep:
                gates[:, :, t] = z
        both = np.concatenate([hs[0, :, 1:], hs[1, :, :0:-1]], axis=-1)
        return both @ p["u"] + p["c"], (x, hs, cs, gates, both)

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a batch and its gradients."""
        p, h = self.p, self.hidden
        e, (x, hs, cs, gates, both) = self._forward(ids, True)
        n, steps = ids.shape
        t = p["t"]
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, steps):
            alpha[:, k] = lse(alpha[:, k - 1, :, None] + t[None], 1) + e[:, k]
        for k in range(steps - 2, -1, -1):
            beta[:, k] = lse(t[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows = np.arange(n)[:, None]
        gold = np.take_along_axis(e, tags[:, :, None], 2).sum(axis=(1, 2)) + t[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows, np.arange(steps)[None], tags] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        np.add.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        de /= n
        g = {"t": pair / n, "u": np.einsum("nth,ntk->hk", both, de), "c": de.sum(axis=(0, 1))}
        dboth = de @ p["u"].T
        dh_all = np.stack([dboth[..., :h], dboth[:, ::-1, h:]])
        d = x.shape[-1]
        dz_all = np.empty((2, n, steps, 4 * h), np.float32)
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for k in range(steps - 1, -1, -1):
            i, f, o, c = np.split(gates[:, :, k], 4, axis=-1)
            tc = np.tanh(cs[:, :, k + 1])
            dh = dh + dh_all[:, :, k]
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[:, :, k]
            dz[..., :h] = dc * c * i * (1 - i)
            dz[..., h : 2 * h] = dc * cs[:, :, k] * f * (1 - f)
            dz[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
            dz[..., 3 * h :] = dc * i * (1 - c * c)
            dh = np.matmul(dz, p["w"][:, d:].transpose(0, 2, 1))
            dc = dc * f
        flat = dz_all.reshape(2, n * steps, 4 * h)
        g["w"] = np.concatenate([np.matmul(x.reshape(2, n * steps, d).transpose(0, 2, 1), flat), np.matmul(hs[:, :, :-1].reshape(2, n * steps, h).transpose(0, 2, 1), flat)], axis=1)
        g["b"] = flat.sum(axis=1, keepdims=True)
        dx = np.matmul(flat, p["w"][:, :d].transpose(0, 2, 1)).reshape(2, n, steps, d)
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], ids, dx[0] + dx[1][:, ::-1])
        return float((z - gold).mean()), g

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int = 130, batch: int = 96, rate: float = 0.02) -> list[float]:
        """Adam over random batches; deterministic for a seed."""
        rng = np.random.default_rng(self.seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        losses = []
        for s in range(1, steps + 1):
            at = rng.integers(0, len(ids), batch)
            loss, g = self.step(ids[at], tags[at])
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            lr = rate * min(1, 2 * (1 - s / (steps + 1)))
            for k in self.p:
                x = g[k] * min(1, 5 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        e, _ = self._forward(ids, False)
        n, steps, _ = e.shape
        back = np.empty((n, steps, TAGS), np.int8)
        score = e[:, 0]
        for k in range(1, steps):
            s = score[:, :, None] + self.p["t"][None]
            back[:, k] = s.argmax(axis=1)
            score = s.max(axis=1) + e[:, k]
        out = np.empty((n, steps), np.int8)
        out[:, -1] = score.argmax(axis=1)
        for k in range(steps - 1, 0, -1):
            out[:, k - 1] = back[np.arange(n), k, out[:, k]]
        return out


def training_windows(examples: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows at two offsets of every passage, as ids and tags."""
    ids, tags = [], []
    for text, spans in examples:
        x = char_ids(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        y = np.zeros(len(x), np.int64)
        for kind, lo, hi in spans:
            k = 1 + 2 * KINDS.index(kind)
            y[lo:hi], y[lo] = k + 1, k
        for lo in (0, STRIDE):
            ids.append(x[lo : lo + WINDOW])
            tags.append(y[lo : lo + WINDOW])
    return np.array(ids), np.array(tags)


@lru_cache(maxsize=4)
def trained_tagger(n_examples: int = 2000, seed: int = 3, steps: int = 130) -> Tagger:
    """The tagger trained from labelled examples, once for each process and parameters."""
    tagger = Tagger(seed=seed)
    tagger.train(*training_windows(labelled_examples(n_examples, seed)), steps=steps)
    return tagger


# --- spans of whole texts ----------------------------------------------------------------------------------------


def _windows(points: np.ndarray) -> np.ndarray:
    """Starts of the windows within reach of a digit or an at sign."""
    trigger = np.flatnonzero(((points >= 48) & (points <= 57)) | (points == 64))
    if not len(trigger):
        return trigger
    # A window [s, s + WINDOW) is read if a trigger lies in [s - REACH, s + WINDOW + REACH).
    first = np.maximum(0, -((WINDOW + REACH - 1 - trigger) // STRIDE))
    last = np.minimum((trigger + REACH) // STRIDE, max(0, (len(points) - 1) // STRIDE))
    return _grid(first, last)


def _grid(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = int(last.max(initial=0)) + 2
    edge = np.zeros(size + 1, np.int64)
    ok = first <= last
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, last[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:size]) > 0) * STRIDE


def _added(text: str, points: np.ndarray, starts: np.ndarray, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans from one document's window tags, reconciled over the whole text."""
    best, depth = np.zeros(len(points) + WINDOW, np.int8), np.full(len(points) + WINDOW, -1, np.int16)
    centre = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.int16)
    for s, row in zip(starts.tolist(), tags):
        at = slice(s, s + WINDOW)
        own = centre if s else np.where(np.arange(WINDOW) < WINDOW // 2, WINDOW, centre)  # the text's start has no edge
        win = own > depth[at]
        best[at] = np.where(win, row, best[at])
        depth[at] = np.maximum(depth[at], own)
    best = best[: len(points)]
    out: list[Span] = []
    i, n = 0, len(best)
    some = np.flatnonzero(best)
    taken = sorted((lo, hi) for _, lo, hi in base)
    k = 0
    while k < len(some):
        i = int(some[k])
        kind = (int(best[i]) - 1) // 2
        j = i + 1
        while j < n and best[j] == 2 + 2 * kind:
            j += 1
        k = int(np.searchsorted(some, j))
        raw = text[i:j]
        lo = i + len(raw) - len(raw.lstrip(" .,;:!\n\t"))
        hi = j - (len(raw) - len(raw.rstrip(" .,;:!\n\t")))
        if _plausible(KINDS[kind], text, lo, hi) and not any(a < hi and lo < b for a, b in taken):
            out.append((KINDS[kind], lo, hi))
    return out


def _plausible(kind: str, text: str, lo: int, hi: int) -> bool:
    value = text[lo:hi]
    if not value or text[lo - 1 : lo].isalnum() or text[hi : hi + 1].isalnum():
        return False
    digits = sum(c in "0123456789" for c in value)
    if kind == "email":
        local, _, domain = value.partition("@")
        return bool(local.strip()) and "." in domain.strip(" .")
    if not re.fullmatch(r"[0-9 ().+-]+", value):
        return False
    if kind == "ip":
        return bool(re.fullmatch(r"\d{1,3}( ?\. ?\d{1,3}){3}", value)) and all(int(x) <= 255 for x in re.findall(r"\d+", value))
    if kind == "card":
        return 16 <= digits <= 19 and luhn(re.sub(r"\D", "", value))
    return 10 <= digits <= 15


def find_spans(texts: list[str | None], tagger: Tagger, batch: int = 512) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of whole texts, both by kind as in KINDS, then by start; offsets in code points."""
    found = [base_spans(t) for t in texts]
    docs, ids = [], []
    for i, t in enumerate(texts):
        if t and ("@" in t or _DIGIT.search(t)):
            points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = _windows(points)
            if len(starts):
                padded = np.concatenate([char_ids(points), np.full(WINDOW, 131, np.int64)])
                ids.append(padded[starts[:, None] + np.arange(WINDOW)[None]].astype(np.uint8))
                docs.append((i, points, starts))
    out = [(b, b) for b in found]
    if docs:
        flat = np.concatenate(ids)
        tags = np.concatenate([tagger.decode(flat[lo : lo + batch].astype(np.int64)) for lo in range(0, len(flat), batch)])
        at = 0
        for i, points, starts in docs:
            more = _added(texts[i], points, starts, tags[at : at + len(starts)], found[i])
            at += len(starts)
            if more:
                out[i] = (found[i], sorted(found[i] + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans one placeholder remains."""
    out, end = [], 0
    for kind, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2])):
        if lo >= end:
            out += [text[end:lo], f"<{kind.upper()}>"]
        end = max(end, hi)
    return "".join(out) + text[end:]


#: Rows whose texts and spans are held as Python objects at a time.
_STEP = 512


def _chunked(texts: pa.Array, tagger: Tagger, step: int = _STEP):
    for lo in range(0, len(texts), step):
        part = texts.slice(lo, step).to_pylist()
        yield from zip(part, find_spans(part, tagger))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all).

    Null and empty texts have no spans; their base_sha256 is that of the empty string. Repeated rows give repeated
    results. Other columns are ignored. A map-only plan; the weights travel with the task.
    """
    tagger = tagger or trained_tagger()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, base_sha, spans = [], [], []
            for _, (base, every) in _chunked(b.column(1), tagger):
                counts.append([sum(k == x for x, _, _ in base) for k in KINDS])
                base_sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, i]) for i in range(len(KINDS))), pa.array(base_sha, pa.string()), pa.array(spans, pa.string())], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return two.mapInArrow(run, f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", tagger: Tagger | None = None) -> DataFrame:
    """docs with the spans of its texts replaced by placeholders; length_col, where present, is brought up to date."""
    tagger = tagger or trained_tagger()
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(text_col)
            for lo in range(0, whole.num_rows, _STEP):  # handed on bit by bit, so that no copy of a whole batch is held
                b = whole.slice(lo, _STEP)
                texts = [t if not every else redact(t, every) for t, (_, every) in _chunked(b.column(at), tagger)]
                yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(length_col).isNotNull(), F.length(text_col)).cast(schema[length_col].dataType))
    return out
