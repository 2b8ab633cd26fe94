"""Operator 6: personal data by candidate gradient boosting.

Base spans (email, ip, card, phone) come from fixed patterns and always stay.  Generators with high
recall propose further, overlapping spans around an at sign (also spelt out) and every window of
consecutive digit groups in a run of them that has a kind's number of digits;
gradient-boosted trees score each from its format and context; a span is added when its score reaches
the threshold of its kind, calibrated on all documents held out from the trees, and it overlaps no base
span and no better candidate (higher score, then longer, then earlier).

The trees learn from what the base patterns miss.  In a bounded sample of documents (``MAX_TRAIN_DOCS``, smallest
hashes of the id, at most ``MAX_TRAIN_SPANS`` candidates) every base span is rewritten in its own context into
forms that no base pattern matches (``at`` and dots spelt out, no prefix, other or wider separators, single
digits, lists): the candidate that is just the rewritten span is a positive, any that only overlaps it a
negative, as are ordinary numbers made of its digits and the text's own free candidates.  Free candidates
that read as a rewritten form could be either, so they are neither.  Only candidates clear of base spans
are learnt from and calibrated on, as only those can be added; no feature tells of ``@`` or ``+``.
The sample is drawn from one half of the ids; thresholds come from score bins counted over the whole other half.
Calibrating and searching each read whole texts in one narrow pass.

Defined cases: null text = empty text; null doc_id is kept (never in the sample); repeated rows are
searched each; a kind without base spans in the sample or the held-out half has nothing to learn from and none is
added; digits without a prefix or separator are no phone; whole texts are read, in time linear in their length
(patterns are possessive or bounded; one text gives at most ``MOST_SPANS`` spans and ``MOST_ROWS`` rows to the fit); an
address longer than one can be is no candidate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import gbt

MAX_TRAIN_DOCS = 5_000
MAX_TRAIN_SPANS = 50_000
PRECISION = 0.99
TREES, DEPTH = 80, 5
FORMS = 8      # rewritten forms of a base span, and half as many ordinary texts in its place
MOST_SPANS, MOST_ROWS = 64, 1000  # of one text, to learn from
HELD_FORMS = 2 # the same where thresholds are calibrated
BINS = 1 << 12 # score bins of the calibration
REACH = 120    # characters of context on each side of one
MOST_DIGITS = 20
KINDS = ["email", "ip", "card", "phone"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[{]\x20?(?:at|AT)|\x20(?:at|AT)\x20")
_AT = re.compile(r"@|[(\[{]\x20?(?:at|AT)\x20?[)\]}]|(?<=\x20)(?:at|AT)(?=\x20)")
_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?\Z")
_LABEL = re.compile(r"\x20?[A-Za-z0-9-]{1,63}")
_LABEL_PART = re.compile("[A-Za-z0-9-]")
_SPELT = r"\x20?[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20"
_DOT = re.compile(r"\x20?\.\x20?|" + _SPELT)
_NEXT = re.compile(rf"({_DOT.pattern})[A-Za-z0-9-]{{1,63}}")
_SPELT_DOT = re.compile(_SPELT)
_NUMBER = re.compile(r"[0-9]++(?:[\x20\xa0().,/\[\]_-]{1,3}+[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"(?<=[0-9])[^0-9]+(?=[0-9])")
_SEP_BEFORE = re.compile(r"[0-9]([^0-9A-Za-z\n]{1,3})\Z")
_SEP_AFTER = re.compile(r"([^0-9A-Za-z\n]{1,3})[0-9]")
_HINTS = re.compile(r"(?i)\b(e-?mail|mail|tel|phone|call|fax|mobile|card|visa|credit|ip|addr|address|host|ssn|id)\b")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches of the email pattern, found from each at sign: the local part
    is the run before it, as no other start can match when the domain does not follow."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` of the base spans, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    """Around each at sign, one span for every number of domain labels up to nine.  A bare word ``at`` counts
    only before a spelt-out dot."""
    out = []
    for m in _AT.finditer(text):
        left = _LEFT.search(text[max(0, m.start() - 65):m.start()])
        right = _LABEL.match(text, m.end())
        if not left or not right:
            continue
        at = m.start() - len(left[0])
        if text[right.end():right.end() + 1] and _LABEL_PART.match(text, right.end()) or at and text[at - 1] in _LOCAL:
            continue   # longer than an address can be
        ends = [right.end()]
        while len(ends) < 9 and (more := _NEXT.match(text, ends[-1])):
            ends.append(more.end())
        if m[0].isalpha() and not _SPELT_DOT.search(text, m.end(), ends[-1]):
            continue
        out += [(m.start() - len(left[0]), e) for e in ends]
    return out


def _windows(text: str) -> Iterator[tuple[int, int, int, int]]:
    """``(start, end, digits, groups)`` of consecutive digit groups of a run that hold 4 to ``MOST_DIGITS`` digits:
    at most that many from each start, so a run of any length takes time linear in it.  A plus sign or
    an opening parenthesis that is closed inside belongs to a window."""
    for m in _NUMBER.finditer(text):
        ahead: deque[tuple[int, int]] = deque()
        rest = _GROUP.finditer(text, m.start(), m.end())
        while True:
            while len(ahead) < MOST_DIGITS and (g := next(rest, None)):
                ahead.append(g.span())
            if not ahead:
                break
            start, n = ahead[0][0], 0
            for j, (a, e) in enumerate(ahead):
                n += e - a
                if n > MOST_DIGITS:
                    break
                if n >= 4:
                    s = start - (text[start - 1:start] == "(" and ")" in text[start:e])
                    yield s - (text[s - 1:s] == "+"), e, n, j + 1
            ahead.popleft()


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """Proposed ``(kind number, start, end)``; they may overlap."""
    yield from ((0, s, e) for s, e in _addresses(text))
    for s, e, n, groups in _windows(text):
        if groups == 4 and n <= 12 and text.count(".", s, e) >= 3:
            yield 1, s, e
        if n >= 12:
            yield 2, s, e
        if 7 <= n <= 16:
            yield 3, s, e


def free_candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """The candidates that meet no base span."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in base):  # spans that overlap as one
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for k, s, e in candidates(text):
        before = bisect.bisect_left(starts, e)
        if not before or ends[before - 1] <= s:
            yield k, s, e


N_FEATURES = 30


def features(text: str, kind: int, s: int, e: int) -> list[float]:
    """Format and context of one candidate."""
    span, before, after = text[s:e], text[max(0, s - 40):s], text[e:e + 20]
    d = _digits(span)
    groups = _GROUP.findall(span)
    sizes = [len(g) for g in groups] or [0]
    if kind == 0:
        domain = span[_AT.search(span).end():]
        parts, labels, left = _DOT.findall(domain), _DOT.split(domain), None
        right = _NEXT.match(after)
    else:
        parts, labels = _BETWEEN.findall(span), [""]
        left, right = _SEP_BEFORE.search(before), _SEP_AFTER.match(after)
    last = labels[-1].strip()
    kinds = len({p.strip() for p in parts}), len(set(parts))
    return [float(kind == 0), float(kind == 1), float(kind == 2), float(kind == 3), len(span), len(d), len(groups), sizes[0], sizes[-1],
            max(sizes), min(sizes), span.count("."), span.count("-"), span.count(" "), span.count("(") + span.count(")"),
            span.count(",") + span.count("/"), float(luhn(d)) if d else 0.0, max([0, *(min(int(g[:4]), 999) for g in groups)]),
            len(labels), len(last), float(last.isalpha() and last.islower()), float(before[-1:].isalnum()), float(after[:1].isalnum()),
            float(_HINTS.search(before) is not None), sum(c.isdigit() for c in before + after), *kinds,
            float(left is not None) + float(left is not None and left[1] in parts),
            float(right is not None) + float(right is not None and right[1] in parts), len(parts)]


def _rewritten(kind: int, span: str, rng: random.Random) -> list[str]:
    """One base span in a form that no base pattern is meant to match; several for a list of them."""
    if kind == 0:
        local, domain = span.rsplit("@", 1)
        dot = rng.choice([".", ".", " . ", "(dot)", " (dot) ", "[dot]", " [dot] ", " dot "])
        bare = [" at ", " AT "] if "dot" in dot else []
        at = rng.choice(["(at)", " (at) ", "[at]", " [at] ", " (AT) ", " {at} ", " @ ", *bare])
        return [local + at + domain.replace(".", dot)]
    groups = _GROUP.findall(span)
    if kind == 1:
        return [rng.choice(["[.]", "(.)", " . ", ". ", " ."]).join(groups)]
    d = "".join(groups)
    if kind == 2:
        fours = [d[i:i + 4] for i in range(0, len(d), 4)]
        if rng.random() < 0.2:  # a code right behind it
            return [" ".join(fours) + "\0 " + str(rng.randint(10, 999))]
        return [rng.choice([".", "/", "  ", " - ", " / ", ". ", "--"]).join(fours if rng.random() < 0.8 else list(d))]
    if len(groups) == 1:
        groups = [g for g in (d[:-10], d[-10:-7], d[-7:-4], d[-4:]) if g]
    if len(groups) > 2 and len(groups[0]) <= 3 and len(d) - len(groups[0]) >= 7 and rng.random() < 0.7:
        groups = groups[1:]
    out = []
    how, sep = rng.random(), rng.choice([" ", "-", ".", "/", " - "])
    for i in range(rng.choice([1, 1, 2, 3])):
        if i:
            groups = [*groups[:-1], "".join(str(rng.randint(0, 9)) for _ in groups[-1])]
        if how < 0.1:
            out.append(" ".join("".join(groups)))
        elif how < 0.2:
            out.append("+" + "/".join(groups))
        elif how < 0.4 and len(groups) > 2:
            j = len(groups) - 3
            out.append(" ".join([*groups[:j], f"({groups[j]})", rng.choice(["-", " "]).join(groups[j + 1:])]))
        else:
            out.append(sep.join(groups))
    return out


def _ordinary(kind: int, span: str, rng: random.Random) -> str:
    """A text like the base span's that is no personal data."""
    if kind == 0:
        return span.rsplit("@", 1)[0] + rng.choice([" (at) ", "@ ", " @ ", "[at]"]) + span.rsplit("@", 1)[1].split(".")[0]
    d = _digits(span)
    d += "".join(str(rng.randint(0, 9)) for _ in range(10))
    how = rng.randrange(8)
    if kind == 1 and how < 3:
        return " . ".join(str(rng.randint(256, 999)) if i == how else str(rng.randint(0, 255)) for i in range(4))
    if kind == 2 and how < 3:
        wrong = next(w for w in (d[:15] + c for c in "38") if not luhn(w))
        return rng.choice([".", "/", "  ", " - "]).join(wrong[i:i + 4] for i in range(0, 16, 4))
    if how < 3:  # a row of numbers
        sep = rng.choice([" ", ", ", " ", "  ", ",", "-", "/"])
        return sep.join(str(rng.randint(1, 10 ** rng.randint(1, 5))) for _ in range(rng.randint(3, 14)))
    if how == 3:
        return f"{int(d[:rng.randint(7, 12)]):,}"
    if how == 4:
        day = [str(rng.randint(1950, 2049)), f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"]
        day = day if rng.random() < 0.6 else day[::-1]
        return rng.choice(["-", "/", "."]).join(day) + rng.choice(["", f" {rng.randint(0, 23):02d}", f" - {day[0]}-{day[1]}-28"])
    if how == 5:
        return f"{d[:rng.randint(1, 7)]}.{d[7:7 + rng.randint(3, 7)]}"
    if how == 6:
        return f"{rng.randint(1900, 2049)}-{rng.randint(1900, 2049)}"
    return d[:rng.randint(7, 12)]


def _could_be(text: str, kind: int, s: int, e: int) -> bool:
    """Whether a free candidate reads as a rewritten form."""
    span = text[s:e]
    if kind == 0:
        labels = [x.strip() for x in _DOT.split(span[_AT.search(span).end():])]
        return len(labels) > 1 and labels[-1].isalpha() and len(labels[-1]) > 1
    groups = _GROUP.findall(span)
    n = sum(map(len, groups))
    if kind == 1:
        return len(groups) == 4 and max(int(g) for g in groups) <= 255
    if kind == 2:
        return 13 <= n <= 19 and luhn("".join(groups))
    return 9 <= n <= 15 and "," not in span and (len(groups) == n or (2 <= len(groups) <= 5 and max(map(len, groups)) <= 5
                                                                      and min(map(len, groups[1:])) >= 2))


def scenes(text: str, forms: int = FORMS, most: int | None = None) -> Iterator[tuple[str, Iterable[tuple[int, int, int, float | None]]]]:
    """``(text, (kind, start, end, label) of its free candidates)`` of a document as it stands and of its base
    spans (``most`` of them) rewritten, each in its context; a label of None is neither."""
    base = base_spans(text)
    yield text, ((k, s, e, None if _could_be(text, k, s, e) else 0.0) for k, s, e in free_candidates(text, base))
    for k, s, e in base if most is None else _some(base, most):
        rng = random.Random(f"{k}:{s}:{text[s:e]}")
        before, after = text[max(0, s - REACH):s], text[e:e + REACH]
        for planted in [*(_rewritten(k, text[s:e], rng) for _ in range(forms)), *[None] * (forms // 2)]:
            gap = rng.choice([", ", "; ", " | ", ",", " or "])
            said, spans = before, set()
            for i, form in enumerate(planted or []):
                said += gap if i else ""
                form, _, tail = form.partition("\0")
                spans.add((len(said), len(said) + len(form)))
                said += form + tail
            said += _ordinary(k, text[s:e], rng) if planted is None else ""
            stop = after[:1] == " " and rng.random() < 0.3  # a sentence that ends there
            at, end, said = len(before), len(said), said + (f". {after[1:2].upper()}{after[2:]}" if stop else after)
            rows = [(c, a, b, float(c == k and (a, b) in spans) if a < end and b > at else None)
                    for c, a, b in free_candidates(said, base_spans(said))]
            yield said, rows


def _some(rows: Iterable, most: int) -> list:
    """A random sample of ``most`` rows (all, if there are fewer), in one pass."""
    rng, out = random.Random(most), []
    for i, r in enumerate(rows):
        if i < most:
            out.append(r)
        elif (j := rng.randint(0, i)) < most:
            out[j] = r
    return out


def _labelled(text: str):
    """``(features, is a rewritten base span)`` of candidates to learn from, bounded for one text."""
    for said, rows in scenes(text, most=MOST_SPANS):
        for k, s, e, y in _some((r for r in rows if r[3] is not None), MOST_ROWS):
            yield features(said, k, s, e), y


def _scored(text: str, rows: Iterable[tuple], model: gbt.Trees, limits: list[float]) -> tuple[list[tuple], list[float]]:
    """The candidates that reach the limit of their kind, and their scores."""
    out, scores = [], []
    for part in batched(rows, 4096):
        for c, p in zip(part, model.score(np.array([features(text, *c[:3]) for c in part], float)).tolist(), strict=True):
            if p >= limits[c[0]]:
                out.append(c)
                scores.append(p)
    return out, scores


def _best(rows: list[tuple], score) -> list[int]:
    """Indexes of the candidates that overlap no better one: best score first, then longer, then earlier."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for i in sorted(range(len(rows)), key=lambda i: (-score[i], rows[i][1] - rows[i][2], rows[i][1], rows[i][0])):
        _, s, e = rows[i][:3]
        at = bisect.bisect_left(starts, s)
        if (at and ends[at - 1] > s) or (at < len(starts) and starts[at] < e):
            continue
        starts.insert(at, s)
        ends.insert(at, e)
        out.append(i)
    return out


def _best_by_kind(rows: list[tuple], score) -> list[int]:
    """As ``_best``, among the candidates of one kind."""
    out = []
    for k in range(len(KINDS)):
        mine = [i for i, c in enumerate(rows) if c[0] == k]
        out += [mine[i] for i in _best([rows[i] for i in mine], [score[i] for i in mine])]
    return out


def fit_sample(docs: DataFrame, max_docs: int, max_spans: int) -> gbt.Trees:
    """The trees, from a bounded sample of the documents that are not held out."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(d, i, x, y) for d, t in zip(part["doc_id"], part["text"], strict=True) if t and _ANY.search(t)
                for i, (x, y) in enumerate(_labelled(t))]
        return pd.DataFrame(rows, columns=["doc_id", "i", "x", "y"])
    ids = (docs.where("doc_id IS NOT NULL").where(~_held_out()).select("doc_id").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    seen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInPandas(
        C.per_batch(run, 32), "doc_id long, i int, x array<double>, y double")
    got = seen.orderBy(F.xxhash64("doc_id", "i"), "doc_id", "i").limit(max_spans).toPandas().sort_values(["doc_id", "i"])
    return gbt.fit(np.array(got["x"].tolist(), float).reshape(-1, N_FEATURES), got["y"].to_numpy(float), trees=TREES, depth=DEPTH)


def _held_out() -> Column:
    """Half of the ids (and null), by a hash of its own."""
    return F.col("doc_id").isNull() | (F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(2)) == 1)


def calibrate(docs: DataFrame, model: gbt.Trees) -> list[float]:
    """The threshold of each kind: the least score bin down to which ``PRECISION`` of the chosen candidates
    of all held-out documents are right; above 1 (nothing is added) only where no bin reaches it."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        seen, right = np.zeros((len(KINDS), BINS + 1), np.int64), np.zeros((len(KINDS), BINS + 1), np.int64)
        for t in part["text"]:
            for said, rows in scenes(t, HELD_FORMS) if t and _ANY.search(t) else ():
                good, score = _scored(said, rows, model, [0.5] * len(KINDS))
                for i in _best_by_kind(good, score):
                    k, _, _, y = good[i]
                    if y is not None:
                        seen[k, int(score[i] * BINS)] += 1
                        right[k, int(score[i] * BINS)] += y == 1
        k, b = np.nonzero(seen)
        return pd.DataFrame({"kind": k, "bin": b, "seen": seen[k, b], "right": right[k, b]})
    bins = docs.where(_held_out()).select("text").mapInPandas(C.per_batch(run), "kind int, bin int, seen long, right long")
    got = bins.groupBy("kind", "bin").agg(F.sum("seen").alias("seen"), F.sum("right").alias("right")).toPandas()
    limits = []
    for k in range(len(KINDS)):
        mine = got[got["kind"] == k].sort_values("bin", ascending=False)
        good = np.flatnonzero(mine["right"].cumsum().to_numpy() >= PRECISION * mine["seen"].cumsum().to_numpy())
        limits.append(max(0.5, float(mine["bin"].iloc[good[-1]]) / BINS) if len(good) else 2.0)
    return limits


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_spans: int = MAX_TRAIN_SPANS) -> tuple[gbt.Trees, list[float]]:
    """The trees and the threshold of each kind (above 1: nothing of this kind is added)."""
    model = fit_sample(docs, max_docs, max_spans)
    return model, calibrate(docs, model)


def added_spans(text: str, base: list[tuple[int, int, int]], model: gbt.Trees, limits: list[float]) -> list[tuple[int, int, int]]:
    good, score = _scored(text, free_candidates(text, base), model, limits)
    chosen = _best_by_kind(good, score)
    return sorted(good[chosen[i]] for i in _best([good[i] for i in chosen], [score[i] for i in chosen]))


def find(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_spans: int = MAX_TRAIN_SPANS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every document."""
    model, limits = train(docs, max_docs, max_spans)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for d, t in zip(part["doc_id"], part["text"], strict=True):
            base, more = [], []
            if t and _ANY.search(t):
                base = base_spans(t)
                more = added_spans(t, base, model, limits)
            said = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
            spans = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted([*base, *more]))
            rows.append((d, *[sum(k == i for k, _, _ in base) for i in range(4)], hashlib.sha256(said.encode()).hexdigest(), spans, len(more)))
        return pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
    # Ids pass Python as text: pandas would turn longs with nulls into doubles.
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        C.per_batch(run), "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").withColumn(
        "doc_id", F.col("doc_id").cast("long"))
