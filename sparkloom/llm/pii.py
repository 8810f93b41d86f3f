"""Personal data: high-recall generators propose overlapping spans, boosted trees decide, calibrated thresholds redact.

Base generators (email, ip, card, phone) are exact formats whose spans always stay. Further generators propose masked mail addresses, defanged
addresses and numbers written without a country code or with other separators; a small gradient-boosted model over
format and context features, trained here on a seeded synthetic set, selects among them; its map to probabilities and each kind's threshold are calibrated on
spans of other formats and contexts than those it was trained on. A card number must pass Luhn to be proposed. Of overlapping selected spans the most probable stays (ties: first start,
then kind order). Null and empty texts have no spans. Positions are code points, end exclusive. Rows are judged one by one: repeated ones alike, none in an empty table;
result columns stand beside those kept by name.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import bounded_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always takes its last digit run whole, so starting inside a run never helps.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{2,64}+)\s?(?:\[at\]|\(at\)|\{at\}|\sat\s)\s?([A-Za-z0-9-]{2,63}+(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\sdot\s|\.)\s?[A-Za-z0-9-]{2,63}+){1,4})", re.IGNORECASE)
_FANGED = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]|\s\.\s)[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]|\s\.\s|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\]|\s\.\s|\.)[0-9]{1,3}(?![0-9A-Za-z])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}[0-9]{2,5}+){1,4}(?![0-9A-Za-z])")
_CUES = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|addr|host|server|from", re.I),
    "card": re.compile(r"card|visa|credit|payment|amex", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|\bfax|whatsapp|contact", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(q := p.lstrip("0") or "0") < 4 and int(q) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str) -> list[Span]:
    """Further spans, generously."""
    out = []
    if "at" in text or "AT" in text or "At" in text:
        if "[" in text or "(" in text or "{" in text or " dot " in text.lower():
            out += [("email", *m.span()) for m in _MASKED.finditer(text)]
    out += [("ip", *m.span()) for m in _FANGED.finditer(text)]
    for m in _NUMBER.finditer(text):
        digits = _digits(m[0])
        d = len(digits)
        if 7 <= d <= 15:
            out.append(("phone", *m.span()))
        if 12 <= d <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 12]
    digits = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    seps = {c for c in s if not c.isalnum()}
    return [
        KINDS.index(kind), len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0, len(seps), float("(" in s), float("." in s), float("-" in s), float("/" in s), float(" " in s), float(bool(_CUES[kind].search(before))),
        float(bool(digits) and luhn(digits)), float(bool(re.search(r"\[|\(at|\(dot|\{", s))), float(len(groups) == 4 and all(int(g) < 256 for g in re.findall(r"[0-9]{1,3}", s)[:4])), float(bool(re.match(r"(?:19|20)[0-9]{2}[./-]|[0-3]?[0-9][./-][01]?[0-9][./-]", s))), float(before[-1:].isalnum() or before[-1:] in "$#%€£"), float(after[:1] in "%$€£°"),
    ]


def _synthetic(n: int, seed: int, other: bool = False) -> tuple[list[list[float]], list[int]]:
    """Labelled spans in short contexts, made from templates; `other` ones differ in formats, cues and words."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = ("some from which part chapter volume dans les wir und para que box unit grade" if other else "the of and ra lo zu der une las with notes order item page total value section").split()
    x, y = [], []

    def add(kind: str, s: str, label: int, cue: str = "") -> None:
        left = " ".join(r.choice(words) for _ in range(3)) + " " + (cue + " " if cue else "")
        text = left + s + r.choice([" ", ". ", ", "]) + " ".join(r.choice(words) for _ in range(2))
        x.append(features(text, (kind, len(left), len(left) + len(s))))
        y.append(label)

    def card() -> str:
        body = d(15)
        return next(body + str(k) for k in range(10) if luhn(body + str(k)))

    cues = {"phone": ["call", "phone:", "tel.", "mobile", "", ""], "card": ["card", "visa", ""], "email": ["mail", "contact", ""], "ip": ["host", "ip", ""]}
    for _ in range(n):
        c, o = card(), [str(r.randrange(256)) for _ in range(4)]
        if other:
            add("phone", r.choice([f"({d(4)}) {d(3)} {d(3)}", f"0{d(3)}-{d(3)}-{d(4)}", f"{d(3)}/{d(3)}-{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]), 1, r.choice(["fax", "whatsapp", "phone", "contact us:"]))
            add("email", f"{r.choice(words)}.{r.choice(words)}{r.choice(['(at)', ' [at] ', ' AT '])}{r.choice(words)}{d(1)}{r.choice(['(dot)', ' [dot] ', ' DOT '])}{r.choice(['org', 'net', 'de'])}", 1, r.choice(["write to", "e-mail", ""]))
            add("ip", r.choice(["[.]", "[dot]"]).join(o), 1, r.choice(["server", "from", "addr"]))
            add("card", f"{c[:6]}.{c[6:12]}.{c[12:]}" if r.random() < 0.5 else f"{c[:4]}/{c[4:8]}/{c[8:12]}/{c[12:]}", 1, r.choice(["payment by", "credit card", ""]))
            add("phone", r.choice([f"{d(3)}-{d(1)}{d(2)}-{d(4)}-0", f"19{d(2)}/{r.randrange(1, 13):02d}/{r.randrange(1, 29):02d}", f"{r.randrange(1, 29):02d}.{r.randrange(1, 13):02d}.19{d(2)}", f"{d(4)}-{d(4)}", f"{d(3)}.{d(3)}.{d(3)}"]), 0, r.choice(["isbn", "page", "no.", ""]))
            add("email", f"{r.choice(words)} at {r.choice(words)}. {r.choice(words)}", 0)
            add("ip", " . ".join(d(2) for _ in range(4)), 0, r.choice(["version", ""]))
            continue
        add("phone", r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(4)}-{d(4)}"]), 1, r.choice(cues["phone"]))
        add("phone", r.choice([f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}"]), 1, r.choice(cues["phone"][:4]))
        at, dot = r.choice([("[at]", "[dot]"), (" (at) ", "."), (" at ", " dot "), ("{at}", "{dot}")])
        add("email", f"{r.choice(words)}{d(2)}{at}{r.choice(words)}mail{dot}com", 1, r.choice(cues["email"]))
        add("ip", r.choice(["[.]", "(.)", "[dot]"]).join(o), 1, r.choice(cues["ip"]))
        add("card", f"{c[:4]}/{c[4:8]}/{c[8:12]}/{c[12:]}" if r.random() < 0.3 else f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", 1, r.choice(cues["card"]))
        add("phone", f"20{d(2)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", 0)
        add("phone", r.choice([f"{d(2)} {d(2)} {d(3)}", f"{d(4)} {d(4)}", f"{d(5)} {d(5)}", f"{d(3)}/{d(4)}", f"{d(2)}.{d(2)}.20{d(2)}"]), 0)
        add("phone", f"{d(4)} {d(4)} {d(4)}", 0)
        add("card", r.choice([f"{c[:2]}.{c[2:4]}.{c[4:8]} {c[8:12]}.{c[12:]}", f"{c[:3]} {c[3:6]} {c[6:9]} {c[9:12]} {c[12:]}"]), 0)
        add("email", f"{r.choice(words)} at {r.choice(words)}.{r.choice(words)}", 0)
        add("ip", " . ".join(d(3) for _ in range(4)), 0)
    return x, y


class BoostedTrees:
    """Depth-2 regression trees on the logistic loss, Newton leaves; a Platt map and a threshold for each kind (the first feature) are set on the rows `held`."""

    def __init__(self, x: list[list[float]], y: list[int], held: tuple[list[list[float]], list[int]], rounds: int = 40, rate: float = 0.3, precision: float = 0.95):
        a, t = np.array(x, float), np.array(y, float)
        self.rate, self.trees = rate, []
        score = np.zeros(len(t))
        cuts = [np.unique(np.quantile(a[:, j], np.linspace(0.05, 0.95, 19))) for j in range(a.shape[1])]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = t - p, p * (1 - p)
            tree = self._split(a, g, h, cuts, 2)
            self.trees.append(tree)
            score += rate * self._apply(tree, a)
        # Platt calibration by a few Newton steps, then for each kind the lowest threshold that keeps the precision asked for
        seen, truth = np.array(held[0], float), np.array(held[1], float)
        s = self.raw(seen)
        w = np.array([1.0, 0.0])
        z = np.stack([s, np.ones_like(s)], 1)
        for _ in range(25):
            q = 1 / (1 + np.exp(-z @ w))
            hess = z.T @ (z * (q * (1 - q))[:, None]) + 1e-3 * np.eye(2)
            w = w + np.linalg.solve(hess, z.T @ (truth - q) - 1e-3 * w)
        self.platt = w
        prob = self.probability(seen)
        self.thresholds = {}
        for nth, kind in enumerate(KINDS):
            own = np.flatnonzero(seen[:, 0] == nth)
            values = np.unique(prob[own])
            good = [v for v in values if truth[own][prob[own] >= v].mean() >= precision]
            # halfway to the next lower candidate
            self.thresholds[kind] = float(good[0] + max(values[values < good[0]], default=0)) / 2 if good else 1.1

    def _split(self, a, g, h, cuts, depth):
        leaf = float(g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(g) < 8:
            return leaf
        best = (1e-9, None, None)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for j, at in enumerate(cuts):
            for c in at:
                m = a[:, j] <= c
                gl, hl = g[m].sum(), h[m].sum()
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                if gain > best[0]:
                    best = (gain, j, c)
        if best[1] is None:
            return leaf
        m = a[:, best[1]] <= best[2]
        return (best[1], float(best[2]), self._split(a[m], g[m], h[m], cuts, depth - 1), self._split(a[~m], g[~m], h[~m], cuts, depth - 1))

    def _apply(self, tree, a):
        if not isinstance(tree, tuple):
            return np.full(len(a), tree)
        m = a[:, tree[0]] <= tree[1]
        out = np.empty(len(a))
        out[m], out[~m] = self._apply(tree[2], a[m]), self._apply(tree[3], a[~m])
        return out

    def raw(self, a: np.ndarray) -> np.ndarray:
        return self.rate * sum(self._apply(t, a) for t in self.trees)

    def probability(self, a: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.raw(a) * self.platt[0] + self.platt[1])))


@lru_cache(maxsize=4)
def model(examples: int = 250, seed: int = 7) -> BoostedTrees:
    return BoostedTrees(*_synthetic(examples, seed), _synthetic(examples, seed + 1, other=True))


def find_spans(texts: list[str | None], judge: BoostedTrees) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans: base and selected ones."""
    base = [base_spans(t) if t else [] for t in texts]
    open_: list[tuple[int, Span]] = []
    for i, t in enumerate(texts):
        if t:
            open_ += [(i, s) for s in candidates(t) if all(s[2] <= b[1] or b[2] <= s[1] for b in base[i])]
    out = [list(b) for b in base]
    if open_:
        p = judge.probability(np.array([features(texts[i], s) for i, s in open_], float))
        rank = sorted((-round(float(q), 9), i, s[1], KINDS.index(s[0]), s) for q, (i, s) in zip(p, open_, strict=True) if q >= judge.thresholds[s[0]])
        taken: dict[int, list[Span]] = {}
        for _, i, _, _, s in rank:
            if all(s[2] <= o[1] or o[2] <= s[1] for o in taken.get(i, ())):
                taken.setdefault(i, []).append(s)
                out[i].append(s)
    return [(b, sorted(o, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))) for b, o in zip(base, out, strict=True)]


def redact(text: str, spans: list[Span]) -> str:
    """Each maximal covered stretch becomes <KIND> of its first span."""
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, *keep: Column) -> DataFrame:
    """Columns `keep` (doc_id if none), n_email .. n_phone (base spans), base_sha256, spans, n_added, redacted (null for a null text)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())
    keep = keep or (F.col("doc_id"),)
    rows = docs.select(F.col("text").alias("__text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for b in batches:
            texts = b.column(0).to_pylist()
            found = find_spans(texts, judge)
            counts = [pa.array([sum(s[0] == k for s in x) for x, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(join_spans(x).encode()).hexdigest() for x, _ in found], pa.string())
            yield pa.record_batch(
                [*b.columns[1:], *counts, digest, pa.array([join_spans(y) for _, y in found], pa.string()), pa.array([len(y) - len(x) for x, y in found], pa.int64()), pa.array([None if t is None else redact(t, y) if y else t for t, (_, y) in zip(texts, found, strict=True)], pa.string())],
                names=[*b.schema.names[1:], *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "redacted"],
            )

    schema = StructType([*rows.schema.fields[1:]])
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return rows.mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long").add("redacted", "string"))
