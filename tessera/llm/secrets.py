"""Operator 10: secret scan with multipart credential linking.

Strong spans (kinds ``assign``, ``access``, ``hex``) are reported as they are found.  Weak parts (short or
plain-looking identifiers, secrets and endpoints) mean little alone: an interval join within a document
pairs every part with the nearest complementary part on either side, and a weak part is reported only if
the gap is at most ``SCOPE`` code points (an endpoint only if both an identifier and a secret are that near).

Workers find the parts; the linking is Spark work: windows over one document's parts in order of
position carry the furthest end seen before and the nearest start to come for each role, so the join
yields one row a part and never pairs.  A part that overlaps a strong span is not a weak part.

Defined cases: null text = empty text: counts 0, empty span list, hash of the empty string; null doc_id
is kept; repeated rows are scanned each; whole texts are read, time is linear in their length (each
pattern starts at a fixed string, at a bounded run or is possessive); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

SCOPE = 200
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMED = re.compile(r"""(?ai:\b(user|username|login|client_id|account_id|key_id|(?:end_?point|host|server|base_url)))["']?\x20{0,4}[:=]\x20{0,4}["']?([A-Za-z0-9+/_.:@-]{3,}+)""")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_URL = re.compile(r"(?a:\b[a-z][a-z0-9]{1,9}://[^\s\"'<>]{3,}+)")


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the strong spans, ordered."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _secret_like(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and len(set(s)) >= 8


def weak_parts(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of parts that need a complement."""
    found = []
    for m in _RUN.finditer(text):
        s = m[0]
        if _secret_like(s):
            found.append((m.start(), 3 if s.isalnum() and s.upper() == s and len(s) <= 24 else 4, m.end()))
    if ":" in text or "=" in text:
        found += [(m.start(), 5 if m[1][0].lower() in "ehsb" else 3, m.end()) for m in _NAMED.finditer(text)]
        found += [(m.start(), 4, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) < 6]
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in _URL.finditer(text)]
    if not found:
        return []
    out, i, reach = [], 0, -1
    for start, kind, end in sorted(set(found)):  # sweep: strong spans that start before this part ends
        while i < len(strong) and strong[i][0] < end:
            reach = max(reach, strong[i][2])
            i += 1
        if reach <= start:
            out.append((start, kind, end))
    return out


def _scan(part: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for r, d, t in zip(part["row_id"], part["doc_id"], part["text"], strict=True):
        t = t or ""
        strong = strong_spans(t)
        n = [sum(k == i for _, k, _ in strong) for i in range(3)]
        said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in strong)
        parts = [{"start": s, "kind": k, "stop": e} for s, k, e in [*strong, *weak_parts(t, strong)]]
        rows.append((r, d, *n, hashlib.sha256(said.encode()).hexdigest(), parts))
    return pd.DataFrame(rows, columns=["row_id", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "parts"])


_SCHEMA = ("row_id long, doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, "
           "parts array<struct<start: long, kind: int, stop: long>>")


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join of ``parts(row_id, start, kind, stop)`` with the parts of the same row: adds
    ``near_id``, ``near_secret`` and ``near_endpoint`` (another part of that role at most ``scope`` away)."""
    names = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    out = parts.withColumn("_role", F.element_at(names, F.col("kind") + 1))
    key = [F.col("start"), F.col("kind"), F.col("stop")]
    ahead = Window.partitionBy("row_id").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row_id").orderBy(*[k.desc() for k in key]).rowsBetween(Window.unboundedPreceding, -1)
    for role in ("id", "secret", "endpoint"):
        mine = F.col("_role") == role
        out = out.withColumn(f"_end_{role}", F.max(F.when(mine, F.col("stop"))).over(ahead))
    for role in ("id", "secret", "endpoint"):
        mine = F.col("_role") == role
        out = out.withColumn(f"_start_{role}", F.min(F.when(mine, F.col("start"))).over(back))
    for role in ("id", "secret", "endpoint"):
        before = F.col("start") - F.col(f"_end_{role}") <= scope
        after = F.col(f"_start_{role}") - F.col("stop") <= scope
        out = out.withColumn(f"near_{role}", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))
        out = out.drop(f"_end_{role}", f"_start_{role}")
    return out


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` for every document."""
    rows, row_id = C.with_row_id(docs)
    # Ids pass Python as text: pandas would turn longs with nulls into doubles.
    found = rows.select(F.col(row_id).alias("row_id"), F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        C.per_batch(_scan), _SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))
    flat = found.withColumn("p", F.explode_outer("parts")).select("*", "p.*").drop("p", "parts")
    linked = link_parts(flat, scope)
    role = F.col("_role")
    weak_ok = (F.when(role == "id", F.col("near_secret")).when(role == "secret", F.col("near_id") | F.col("near_endpoint"))
               .otherwise(F.col("near_id") & F.col("near_secret")))
    shown = F.col("start").isNotNull() & ((F.col("kind") < 3) | weak_ok)
    said = F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1), F.col("start"), F.col("stop"))
    spans = F.sort_array(F.collect_list(F.when(shown, F.struct("start", "kind", "stop", said.alias("said")))))
    return (linked.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256")],
        F.concat_ws(",", F.transform(spans, lambda x: x["said"])).alias("spans"),
        F.count(F.when(shown & (F.col("kind") >= 3), 1)).alias("n_linked")).drop("row_id"))
