"""Operator 5: personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field sees every stretch of text around
digits and at signs as tokens; candidate segments of bounded length are scored
by features of the whole span (shape, digits, separators, checksum, what stands
beside it), and one dynamic program over the stretch chooses boundaries and
types together. It learns from base spans of the corpus, and from the same
stretches with a phone number's country code taken away or written otherwise,
so it also knows numbers that the patterns miss.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import documents, map_texts, text_slices

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")

_HOT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[ \t-\r]+|.", re.DOTALL)
#: Two hot characters nearer than this are in one stretch; a stretch takes so much text on either side.
GAP, MARGIN = 12, 12
#: Most tokens and characters of a segment.
MAX_TOKENS, MAX_CHARS = 20, 80
#: Bounds of the training sample: stretches with and without a base span; steps over them.
TRAIN_WITH, TRAIN_WITHOUT, EPOCHS = 300, 200, 10
#: A segment is added if its score is that much better than leaving its tokens alone.
ODDS = 1.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its test.

    An address is found from its at sign: the characters before it, back to the
    match before, are the ones a search from the left would have started at. A
    number's first part is taken whole, which a search from the left does too;
    neither rescans a long run from each of its characters.
    """
    out = {k: [] for k in KINDS}
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            out["email"].append((start, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def stretches(text: str) -> list[tuple[int, int]]:
    """Where digits and at signs stand, with a margin that ends at white space or after MARGIN characters."""
    out = []
    for m in _HOT.finditer(text):
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and m.start() - out[-1][2] <= GAP:
            out[-1][1:] = [e, m.end()]
        else:
            out.append([s, e, m.end()])
    wide = []
    for s, e, _ in out:
        while s > 0 and not text[s - 1].isspace() and e - s < 4 * MAX_CHARS:
            s -= 1
        while e < len(text) and not text[e].isspace() and e - s < 4 * MAX_CHARS:
            e += 1
        if wide and s < wide[-1][1]:
            wide[-1] = (wide[-1][0], max(e, wide[-1][1]))
        else:
            wide.append((s, e))
    return wide


def _class(c: str) -> str:
    return "^" if not c else "a" if c.isalpha() else "9" if c.isdigit() else "_" if c.isspace() else c


def segment_features(text: str, s: int, e: int, tokens: int) -> list[str]:
    """Features of the whole span; each counts once for each type."""
    part = text[s:e]
    digits = _DIGITS.sub("", part)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", re.sub(r"\s+", "_", part)))
    n = len(digits)
    groups = re.findall(r"[0-9]+", part)
    out = ["bias", f"shape={shape[:32]}", f"digits={n if n < 20 else 20}", f"tokens={min(tokens, 12)}",
           f"left={_class(text[s - 1:s])}", f"right={_class(text[e:e + 1])}", f"at={min(part.count('@'), 2)}",
           f"groups={min(len(groups), 6)}", f"lens={'-'.join(str(len(g)) for g in groups[:6])}"]
    out += [f"has{c}" for c in "+(.-_" if c in shape]
    if "a" not in shape:
        out.append("no letters")
        if 13 <= n <= 19:
            out.append(f"luhn={luhn(digits)}")
        if len(groups) == 4 and "." in part:
            out.append(f"bytes={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    elif "@" in part:
        out.append(f"dotted={'.' in part.rsplit('@', 1)[1]}")
    return out


def segments(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """Token bounds of a stretch, and its candidate segments (first token, last token + 1, features).

    A segment begins and ends with a letter, a digit or a bracket or plus that
    numbers begin or end with, holds an at sign or four digits, and has white
    space only where it has no letter.
    """
    bounds = [m.span() for m in _TOKEN.finditer(text)]
    kind = ["a" if text[s].isascii() and text[s].isalpha() else "9" if text[s] in "0123456789" else "_" if text[s].isspace()
            else text[s] for s, _ in bounds]
    out = []
    for i, k in enumerate(kind):
        if k not in "a9+(._%-":
            continue
        letters = space = at = False
        digits = 0
        for j in range(i, min(len(bounds), i + MAX_TOKENS)):
            c = kind[j]
            s, e = bounds[i][0], bounds[j][1]
            letters |= c == "a"
            space |= c == "_"
            at |= c == "@"
            digits += (bounds[j][1] - bounds[j][0]) * (c == "9")
            if e - s > MAX_CHARS or letters and space or c not in "a9_+().-@%":
                break
            if c in "a9)" and (at or digits >= 4):
                out.append((i, j + 1, segment_features(text, s, e, j + 1 - i)))
    return bounds, out


class Field:
    """Weights by type and feature. Tokens outside segments score 0."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.w = np.zeros((len(KINDS), len(index)))

    def ids(self, features: list[str]) -> list[int]:
        return [self.index[f] for f in features if f in self.index]

    def scores(self, ids: list[list[int]]) -> np.ndarray:
        return np.array([self.w[:, i].sum(axis=1) for i in ids]).reshape(len(ids), len(KINDS))

    def expectations(self, n: int, segs, scores: np.ndarray) -> np.ndarray:
        """Probability of each segment and type: forward and backward over token positions."""
        ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for x, (s, e, _) in enumerate(segs):
            ends[e].append((s, x))
            starts[s].append((e, x))
        seg = np.logaddexp.reduce(scores, axis=1)
        fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
        for p in range(1, n + 1):
            fwd[p] = np.logaddexp.reduce([fwd[p - 1], *(fwd[s] + seg[x] for s, x in ends[p])])
        for p in range(n - 1, -1, -1):
            bwd[p] = np.logaddexp.reduce([bwd[p + 1], *(bwd[e] + seg[x] for e, x in starts[p])])
        lead = np.array([fwd[s] + bwd[e] for s, e, _ in segs]) - fwd[n]
        return np.exp(scores + lead[:, None])

    def best(self, n: int, segs, scores: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, end, type) of its segments that beat their tokens alone by ODDS."""
        kind, top = scores.argmax(axis=1), scores.max(axis=1) - ODDS
        ends = [[] for _ in range(n + 1)]
        for x, (s, e, _) in enumerate(segs):
            if top[x] > 0:
                ends[e].append((s, x))
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for p in range(1, n + 1):
            value[p] = value[p - 1]
            for s, x in ends[p]:
                if value[s] + top[x] > value[p]:
                    value[p], back[p] = value[s] + top[x], x
        out, p = [], n
        while p:
            if back[p] is None:
                p -= 1
            else:
                s, e, _ = segs[back[p]]
                out.append((s, e, int(kind[back[p]])))
                p = s
        return out[::-1]


def examples(text: str, spans: list[tuple[str, int, int]]):
    """The stretch with its labels, and the same with each phone's country code left out or written with zeros."""
    yield text, spans
    for k, s, e in spans:
        if k == "phone" and (m := re.match(r"\+[0-9]{1,3}[ .-]", text[s:e])):
            for lead in ("", "00" + m[0][1:]):
                by = len(lead) - m.end()
                yield (text[:s] + lead + text[s + m.end():],
                       [(x, b + by * (b > s), c + by * (c > s)) for x, b, c in spans])


def train(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    """Conditional likelihood with a small ridge, by adaptive gradient steps in a fixed order."""
    data, count = [], Counter()
    for text, spans in (x for r in rows for x in examples(*r)):
        bounds, segs = segments(text)
        at = {(bounds[s][0], bounds[e - 1][1]): x for x, (s, e, _) in enumerate(segs)}
        gold = [(at.get((s, e)), KINDS.index(k)) for k, s, e in spans]
        if segs and all(x is not None for x, _ in gold):
            data.append((len(bounds), segs, gold))
            count.update(f for _, _, fs in segs for f in set(fs))
    field = Field({f: i for i, f in enumerate(sorted(count))})
    data = [(n, segs, [field.ids(fs) for _, _, fs in segs], gold) for n, segs, gold in data]
    sums = np.full_like(field.w, 1e-6)
    for _ in range(EPOCHS):
        for i in range(0, len(data), 20):
            grad = -1e-3 * field.w * len(data[i:i + 20])
            for n, segs, ids, gold in data[i:i + 20]:
                p = field.expectations(n, segs, field.scores(ids))
                for x, k in gold:
                    p[x, k] -= 1
                for x in np.flatnonzero(np.abs(p).max(axis=1) > 1e-6):
                    grad[:, ids[x]] -= p[x][:, None]
            sums += grad ** 2
            field.w += 0.3 * grad / np.sqrt(sums)
    return field


def _training_rows(docs: DataFrame):
    """Stretches with base spans and without, each by hash order up to its bound; repeated stretches count once."""
    def cut(batches):
        for batch in (part for whole in batches for part in text_slices(whole)):
            rows = []
            for text in batch.column("text").to_pylist():
                if not _HOT.search(text):
                    continue
                spans = [(k, s, e) for k, v in base_spans(text).items() for s, e in v]
                for s, e in stretches(text):
                    if e - s <= 6 * MAX_CHARS:
                        own = sorted((b - s, c - s, k) for k, b, c in spans if s <= b and c <= e)
                        clash = any(x[1] > y[0] for x, y in zip(own, own[1:], strict=False))
                        if not clash and (own or sum(c.isdigit() for c in text[s:e]) >= 4):
                            rows.append((text[s:e], ",".join(f"{k}:{b}:{c}" for b, c, k in own)))
            yield pd.DataFrame(rows, columns=["stretch", "labels"])

    # the sample is taken by hash of the text, so it is the same in every run and order of rows
    near = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    found = near.mapInArrow(lambda b: (_batch(x) for x in cut(b)), "stretch string, labels string").distinct()
    for own, limit in ((F.col("labels") != "", TRAIN_WITH), (F.col("labels") == "", TRAIN_WITHOUT)):
        yield from found.where(own).orderBy(F.xxhash64("stretch"), "stretch").limit(limit).collect()


def _batch(pdf: pd.DataFrame):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({c: pa.array(pdf[c].tolist(), pa.string()) for c in pdf})


def learn(docs: DataFrame) -> Field:
    """The field, from at most TRAIN_WITH + TRAIN_WITHOUT stretches of the corpus (the only texts the driver sees)."""
    rows = []
    for r in _training_rows(docs):
        parts = [x.split(":") for x in r["labels"].split(",") if x]
        rows.append((r["stretch"], [(k, int(s), int(e)) for k, s, e in parts]))
    return train(rows)


def added_spans(text: str, base: dict, field: Field) -> dict[str, list[tuple[int, int]]]:
    """What the field finds beside the base spans."""
    out = {k: [] for k in KINDS}
    if not field.index:
        return out
    taken = sorted(x for v in base.values() for x in v)
    for s, e in stretches(text):
        bounds, segs = segments(text[s:e])
        if not segs:
            continue
        for first, last, kind in field.best(len(bounds), segs, field.scores([field.ids(f) for _, _, f in segs])):
            b, c = s + bounds[first][0], s + bounds[last - 1][1]
            if not any(x < c and b < y for x, y in taken):
                out[KINDS[kind]].append((b, c))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added.

    Offsets are code points, ends exclusive. Null text counts as empty: no spans
    and the hash of the empty string. Null ids and repeated rows are rows like
    others; an empty table gives no rows. Where the corpus has no base span
    there is nothing to learn from and nothing is added. Segments have at most
    MAX_TOKENS tokens and MAX_CHARS characters; base spans have no such bound.
    """
    docs = documents(docs)
    field = learn(docs)

    def make():
        def columns(texts):
            rows = []
            for text in texts:
                base = base_spans(text) if _HOT.search(text) else {k: [] for k in KINDS}
                more = added_spans(text, base, field)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(),
                             listed({k: base[k] + more[k] for k in KINDS}), sum(map(len, more.values()))))
            return list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in range(7)]

        return columns

    return map_texts(docs, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
                                 "n_added long")
