"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole spans, not single tokens: a candidate segment has features of all its characters (digits, separators,
check digit, range of dotted parts, marks) and of what stands around it. A dynamic programme over segments of at most
``LONGEST`` tokens chooses boundaries and types together. Its weights maximise the likelihood of the fixed patterns' own
findings in a bounded sample of texts, of rewritten forms of these (without the leading plus, dots and signs spelled out,
other separators), and of stretches without any.

Only stretches around seven digits or four digit groups, at-signs and spelled-out addresses are taken through the field.
Each row is worked on for itself, nothing is shuffled, and no text is cut short. The fit uses at most ``SAMPLE`` texts, the
first ``STRETCHES`` stretches of each, and of these ``STRETCHES`` examples of fewer than ``MOST_TOKENS`` tokens.

Defined cases: null and empty texts have no spans. A span that the field finds is added only where it overlaps no fixed
finding. Without any finding to learn from nothing is added. Rows that repeat are searched each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marketlake.llm.common import clear_of, text_or_empty

__all__ = ["KINDS", "Field", "base_spans", "find_pii", "fit", "luhn"]

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most, texts that the fit sees at most, stretches and steps of the fit.
LONGEST, SAMPLE, STRETCHES, STEPS = 24, 400, 120, 40
#: Tokens from which a stretch is not learnt from (it is searched all the same).
MOST_TOKENS = 400

Span = tuple[int, int, int]  # start, kind number, end

# Fixed patterns. The part of an address before its sign is found from the sign backwards, which gives the same spans in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    return all(len(p := part.lstrip("0") or "0") <= 3 and int(p) <= 255 for part in text.split("."))


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' findings, by start, then kind; within a kind leftmost and without overlap."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# words are taken from their starts only, and digit groups are bounded: a long run is passed in linear time
_STRETCH = re.compile(r"@|[0-9](?:[^A-Za-z0-9\n]{0,3}[0-9]){6,}|(?<![0-9])[0-9]{1,3}(?:[^A-Za-z0-9\n]{1,3}[0-9]{1,3}){3}(?![0-9])|(?<![A-Za-z0-9])[A-Za-z0-9]+ at [A-Za-z0-9]+(?: dot [A-Za-z0-9]+)+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|.", re.DOTALL)
_AROUND = 24
_CUES = tuple(re.compile(p) for p in (r"mail|contact|write", r"\bip\b|host|server|addr", r"card|visa|credit|pay", r"phone|tel|call|fax|mobile"))
_SPELLED = re.compile(r"[A-Za-z0-9]+ at [A-Za-z0-9]+(?: dot [A-Za-z0-9]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_GROUPED = re.compile(r"[0-9]+(?:[ ./-][0-9]+)*")
_DIALLED = re.compile(r"\+?\(?[0-9]+\)?(?:[ ().-]{1,2}[0-9]+)*")
_BINS = (0, 1, 7, 10, 13, 14, 16, 17, 20)


def _stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text that may hold a segment, with some characters around them, ends moved to blanks; merged where they touch."""
    out: list[tuple[int, int]] = []
    if not ("@" in text or " dot " in text or _DIGIT.search(text)):
        return out
    for m in _STRETCH.finditer(text):
        a, b = max(0, m.start() - _AROUND), min(len(text), m.end() + _AROUND)
        while a > 0 and not text[a - 1].isspace() and m.start() - a < 4 * _AROUND:
            a -= 1
        while b < len(text) and not text[b].isspace() and b - m.end() < 4 * _AROUND:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _features(text: str, start: int, end: int) -> list[float]:
    """Of a candidate segment as a whole."""
    part, before = text[start:end], text[max(0, start - 16) : start].lower()
    digits = _digits(part)
    n = len(digits)
    bins = [0.0] * len(_BINS)
    bins[max(i for i, least in enumerate(_BINS) if n >= least)] = 1.0
    letters = any(c.isalpha() for c in part)
    left, right = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    return [
        1.0, *bins, float(part[0] == "+"), float("@" in part and _DOMAIN.search(part) is not None), float(_SPELLED.fullmatch(part) is not None),
        float(_DOTTED.fullmatch(part) is not None and _octets(part)), float(14 <= n <= 19 and luhn(digits)), float(_GROUPED.fullmatch(part) is not None),
        float(_DIALLED.fullmatch(part) is not None), float(letters), float("(" in part), float(left.isspace() or left in ":=<(\""), float(right.isspace() or right in ",;:.)>\""),
        *[float(c.search(before) is not None) for c in _CUES],
    ]


def _possible(part: str, digits: int) -> list[int]:
    """Types (from 1) that a segment of this form can have at all."""
    out = []
    if _SPELLED.fullmatch(part) or "@" in part and not any(c.isspace() for c in part):
        out.append(1)
    if any(c.isalpha() for c in part) or not (part[0].isdigit() or part[0] in "+("):
        return out
    groups = re.findall("[0-9]+", part)
    if len(groups) == 4 and _octets(".".join(groups)):
        out.append(2)
    if 14 <= digits <= 19:
        out.append(3)
    return out + [4] if 9 <= digits <= 15 else out


_WIDTH = len(_features("x", 0, 1)) + 4  # and four that only single tokens outside of segments have


@dataclass
class _Lattice:
    """The segments of a stretch: token bounds, types, features, and which end at each token."""

    bounds: list[int]
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    features: np.ndarray
    ending: list[np.ndarray]
    beginning: list[np.ndarray]


def _lattice(text: str, a: int, b: int) -> _Lattice:
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, a, b)]
    bounds = [s for s, _ in tokens] + [b]
    rows, starts, ends, kinds = [], [], [], []
    blank = [0.0] * (_WIDTH - 4)
    for i, (s, e) in enumerate(tokens):
        c = text[s]
        rows.append(blank + [1.0, float("0" <= c <= "9"), float(e - s >= 7 and "0" <= c <= "9"), float(c == "@")])
        starts.append(i), ends.append(i + 1), kinds.append(0)
    for i, (s, _) in enumerate(tokens):
        if not (text[s].isalnum() or text[s] in "+(_.%-"):
            continue
        digits, sign, letters = 0, False, False
        for j in range(i, min(len(tokens), i + LONGEST)):
            t0, t1 = tokens[j]
            digits += t1 - t0 if "0" <= text[t0] <= "9" else 0
            sign = sign or text[t0] == "@" or text[t0:t1] == "dot"
            letters = letters or text[t0].isalpha()
            if text[t0] == "\n":
                break
            if letters and not sign:
                continue  # addresses only have letters
            if not text[t1 - 1].isalnum() and text[t1 - 1] not in "-)" or not (sign or 4 <= digits <= 20):
                continue
            kinds_here = _possible(text[s:t1], digits)
            if not kinds_here:
                continue
            row = _features(text, s, t1) + [0.0] * 4
            for kind in kinds_here:
                rows.append(row), starts.append(i), ends.append(j + 1), kinds.append(kind)
    start, end, kind = np.array(starts), np.array(ends), np.array(kinds)
    by_end, by_start = np.argsort(end, kind="stable"), np.argsort(start, kind="stable")
    ranks = np.arange(len(tokens) + 2)
    cut, first = np.searchsorted(end[by_end], ranks), np.searchsorted(start[by_start], ranks)
    return _Lattice(bounds, start, end, kind, np.array(rows), [by_end[cut[t] : cut[t + 1]] for t in range(len(tokens) + 1)], [by_start[first[t] : first[t + 1]] for t in range(len(tokens) + 1)])


@dataclass
class Field:
    """Weights of features by type, and of a type after another; without weights nothing is found."""

    weights: np.ndarray | None
    follows: np.ndarray | None

    def arcs(self, lattice: _Lattice) -> np.ndarray:
        return np.einsum("ij,ij->i", lattice.features, self.weights.T[lattice.kind])

    def best(self, lattice: _Lattice) -> list[tuple[int, int, int]]:
        """The best segmentation's typed segments: (first token, type, token after the last)."""
        arcs, n = self.arcs(lattice), len(lattice.bounds) - 1
        score = np.full((n + 1, 5), -np.inf)
        score[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for t in range(1, n + 1):
            own = lattice.ending[t]
            reach = score[lattice.start[own]] + self.follows[:, lattice.kind[own]].T
            via = reach.argmax(axis=1)
            value = arcs[own] + reach[np.arange(len(own)), via]
            for k in range(5):
                of = np.flatnonzero(lattice.kind[own] == k)
                if len(of):
                    top = of[value[of].argmax()]
                    score[t, k], back[t, k] = value[top], (int(own[top]), int(via[top]))
        out, at = [], (n, int(score[n].argmax()))
        while at[0]:
            arc, kind = back[at]
            if at[1]:
                out.append((int(lattice.start[arc]), at[1], at[0]))
            at = int(lattice.start[arc]), kind
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        if self.weights is None:
            return []
        found = []
        for a, b in _stretches(text):
            lattice = _lattice(text, a, b)
            found += [(lattice.bounds[i], k - 1, lattice.bounds[j]) for i, k, j in self.best(lattice)]
        return found

    def gradient(self, lattice: _Lattice, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log-likelihood of the gold arcs, by forward and backward sums over segmentations."""
        arcs, n = self.arcs(lattice), len(lattice.bounds) - 1
        ahead, behind = np.full((n + 1, 5), -1e30), np.full((n + 1, 5), -1e30)
        ahead[0, 0], behind[n] = 0.0, 0.0
        into = np.empty(len(arcs))
        for t in range(1, n + 1):
            own = lattice.ending[t]
            into[own] = arcs[own] + np.logaddexp.reduce(ahead[lattice.start[own]] + self.follows[:, lattice.kind[own]].T, axis=1)
            np.logaddexp.at(ahead[t], lattice.kind[own], into[own])
        for t in range(n - 1, -1, -1):
            own = lattice.beginning[t]
            out = arcs[own] + behind[lattice.end[own], lattice.kind[own]]
            behind[t] = np.logaddexp.reduce(self.follows[:, lattice.kind[own]] + out, axis=1)
        total = np.logaddexp.reduce(ahead[n])
        share = np.exp(into + behind[lattice.end, lattice.kind] - total)
        known = np.zeros(len(arcs))
        known[gold] = 1.0
        weights, follows = np.zeros_like(self.weights), np.zeros_like(self.follows)
        np.add.at(weights.T, lattice.kind, (known - share)[:, None] * lattice.features)
        pair = np.exp(ahead[lattice.start] + self.follows[:, lattice.kind].T + (arcs + behind[lattice.end, lattice.kind])[:, None] - total)
        np.add.at(follows.T, lattice.kind, -pair)
        order = gold[np.argsort(lattice.end[gold])]
        path = np.concatenate([[0], lattice.kind[order]])
        np.add.at(follows, (path[:-1], path[1:]), 1.0)
        return weights, follows, float(arcs[gold].sum() + self.follows[path[:-1], path[1:]].sum() - total)


def _gold(lattice: _Lattice, spans: list[Span]) -> np.ndarray | None:
    """The arcs of the segmentation with these spans and single tokens elsewhere; None where a span is no segment."""
    place = {b: t for t, b in enumerate(lattice.bounds)}
    arc = {(int(s), int(e), int(k)): i for i, (s, e, k) in enumerate(zip(lattice.start, lattice.end, lattice.kind))}
    out, at = [], 0
    for start, kind, end in spans:
        own = arc.get((place.get(start, -1), place.get(end, -1), kind + 1))
        if own is None or place[start] < at:
            return None
        out += [arc[t, t + 1, 0] for t in range(at, place[start])] + [own]
        at = place[end]
    return np.array(out + [arc[t, t + 1, 0] for t in range(at, len(lattice.bounds) - 1)])


def _rewritten(part: str, kind: int) -> str | None:
    """Another way to write a finding."""
    if kind == 0:
        local, _, domain = part.partition("@")
        local = local.replace(".", "")
        return f"{local} at {domain.replace('.', ' dot ')}" if local.isalnum() and domain.replace(".", "").isalnum() else None
    if kind == 1:
        return part.replace(".", "-")
    if kind == 2:
        d = _digits(part)
        return "/".join(d[i : i + 4] for i in range(0, len(d), 4))
    return part[1:] if kind == 3 else None


def _examples(texts: list[str]) -> list[tuple[_Lattice, np.ndarray]]:
    """Stretches with their segmentations: those with findings, rewritten ones, and others; equal shares as far as there are."""
    with_found: list[tuple[str, list[Span]]] = []
    others: list[tuple[str, list[Span]]] = []
    for text in texts:
        base = base_spans(text)
        for a, b in _stretches(text):
            own = [(s - a, k, e - a) for s, k, e in base if a <= s and e <= b]
            clear: list[Span] = []
            for span in sorted(own, key=lambda s: (s[0], -(s[2] - s[0]), s[1])):
                if not clear or span[0] >= clear[-1][2]:
                    clear.append(span)
            (with_found if clear else others).append((text[a:b], clear))
    rewritten = []
    for part, spans in with_found:
        if len(spans) == 1 and (new := _rewritten(part[spans[0][0] : spans[0][2]], spans[0][1])):
            s, k, e = spans[0]
            rewritten.append((part[:s] + new + part[e:], [(s, k, s + len(new))]))
    out = []
    for group in (with_found, rewritten, others):
        step = max(1, len(group) * 3 // STRETCHES)
        for part, spans in group[::step][: STRETCHES // 3]:
            lattice = _lattice(part, 0, len(part))
            if len(lattice.bounds) < MOST_TOKENS and (gold := _gold(lattice, spans)) is not None:
                out.append((lattice, gold))
    return out if with_found else []


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field:
    """The field that the fixed patterns' findings teach, by gradient steps on at most ``STRETCHES`` stretches."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    shown = own.rlike(r"@[A-Za-z0-9-]+\.|[0-9]{4}[ -]?[0-9]{4}|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]|\+[0-9][ (0-9]")
    some = docs.select(own.alias("text")).filter(shown).select("text", F.xxhash64("text").alias("at"))
    # the texts with the smallest hashes: only hashes are ordered, then these texts alone are fetched
    last = some.select("at").distinct().orderBy("at").limit(sample).agg(F.max("at")).first()[0]
    if last is None:
        return Field(None, None)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [text[a:b] for a, b in _stretches(text)[:STRETCHES]]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["at", "n", "part"])

    # stretches, not texts, come to the driver
    chosen = some.filter(F.col("at") <= last).dropDuplicates(["at"]).mapInArrow(over, "at long, n int, part string").collect()
    examples = _examples([r["part"] for r in sorted(chosen, key=lambda r: (r["at"], r["n"]))])
    if not examples:
        return Field(None, None)
    field = Field(np.zeros((_WIDTH, 5)), np.zeros((5, 5)))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.weights, field.follows)]
    for step in range(1, STEPS + 1):
        total = [-0.02 * field.weights, -0.02 * field.follows]
        for lattice, gold in examples:
            weights, follows, _ = field.gradient(lattice, gold)
            total[0] += weights
            total[1] += follows
        for x, g, (m, v) in zip((field.weights, field.follows), total, moments):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts by kind and digest of the fixed findings, and all spans."""
    field = fit(docs, text) if field is None else field
    rows = docs.select(F.col(doc_id), text_or_empty(text).alias("text"))
    names = [f"n_{k}" for k in KINDS]
    schema = T.StructType([rows.schema[0], *[T.StructField(n, T.LongType()) for n in names], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, texts = batch.slice(at, 512).columns
                counts, digests, spans = ([], [], [], []), [], []
                for plain in texts.to_pylist():
                    base = base_spans(plain)
                    clear = clear_of([(b, e) for b, _, e in base])
                    more = [s for s in field.spans(plain) if clear(s[0], s[2])]
                    for k in range(4):
                        counts[k].append(sum(s[1] == k for s in base))
                    digests.append(hashlib.sha256(_shown(base).encode()).hexdigest())
                    spans.append(_shown(sorted(base + more)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(spans, pa.string())], names=[doc_id, *names, "base_sha256", "spans"])

    return rows.mapInArrow(over, schema)
