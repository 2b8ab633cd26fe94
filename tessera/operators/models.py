"""Pluggable models: any callable over lists, run as an Arrow-batched job.

A model is built once per Python worker, whatever the number of tasks the worker runs.  Texts longer than its input are
given to it in overlapping windows whose outputs a merge rule joins; inputs are batched by a budget of words after
sorting by length, so that a batch's texts are about equally long."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUILT: dict[str, Callable] = {}


def built(key: str, factory: Callable[[], Callable]) -> Callable:
    """The worker's model of ``key``, built when first asked for."""
    if key not in _BUILT:
        _BUILT[key] = factory()
    return _BUILT[key]


_WORD = re.compile(r"\S+")


def windows(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """``(start, piece)`` of the overlapping windows of ``size`` words of a text; one that fits is its own window.  Every run of
    ``overlap`` words lies whole in one of them."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) <= size:
        return [(0, text)]
    firsts = range(0, len(spans) - overlap, size - overlap)
    return [(spans[i][0], text[spans[i][0]:spans[min(i + size, len(spans)) - 1][1]]) for i in firsts]


def budget_batches(lengths: list[int], budget: int) -> list[list[int]]:
    """Positions by rising length, cut so that (texts x longest text) of a batch stays within ``budget``; a longer text is
    a batch of its own."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if out and (len(out[-1]) + 1) * max(1, lengths[i]) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def in_batches(model: Callable, inputs: list[list[str]], batch_size: int, budget: int | None) -> list:
    """The model's output of every row, in the rows' order: by batches of ``batch_size`` rows, or of ``budget`` words."""
    n = len(inputs[0])
    if budget is None:
        cuts = [list(range(a, min(a + batch_size, n))) for a in range(0, n, batch_size)]
    else:
        cuts = budget_batches([sum(len(g[i].split()) for g in inputs) for i in range(n)], budget)
    out: list = [None] * n
    for cut in cuts:
        for i, got in zip(cut, model(*[[g[i] for i in cut] for g in inputs]), strict=True):
            out[i] = got
    return out


class PandasTextModel:
    """Wrap a model over one or more text inputs as a job over (key, inputs...) rows.

    The model takes one list per input and returns one output per row: a dict of the other columns of
    ``schema`` (``many=False``), or a list of such dicts (``many=True``, e.g. entities), which become rows.
    ``schema`` names the key column first.  A NULL input is passed as ''.

    ``window`` (words): the longest last input that the model takes.  Longer ones go in as windows that share ``overlap``
    words, with the other inputs beside each, and ``merge(parts, call)`` makes one output of the windows' ``(start,
    output)``; ``call(texts)`` runs the model on further texts.  ``budget``: words of a batch, instead of ``batch_size``."""

    def __init__(self, factory: Callable[[], Callable], schema: str, batch_size: int = 32, many: bool = False,
                 window: int | None = None, overlap: int = 0, merge: Callable | None = None, budget: int | None = None):
        if window is not None and merge is None:
            raise ValueError("windows need a merge rule")
        self.factory, self.schema, self.batch_size, self.many = factory, schema, batch_size, many
        self.window, self.overlap, self.merge, self.budget = window, overlap, merge, budget
        self.key = uuid.uuid4().hex

    def apply(self, df: DataFrame, key: str, *inputs: str) -> DataFrame:
        factory, bs, many, model_key = self.factory, self.batch_size, self.many, self.key
        size, overlap, merge, budget = self.window, self.overlap, self.merge, self.budget
        columns = [c.strip().split()[0] for c in self.schema.split(",")]

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = built(model_key, factory)
            for pdf in it:
                given = [pdf[f"_in{i}"].fillna("").tolist() for i in range(len(inputs))]
                parts = [[(0, t)] if size is None else windows(t, size, overlap) for t in given[-1]]
                whole = [[v for v, p in zip(g, parts, strict=True) for _ in p] for g in given[:-1]]
                outs = iter(in_batches(model, [*whole, [t for p in parts for _, t in p]], bs, budget))
                rows = []
                for i, (k, p) in enumerate(zip(pdf["_key"], parts, strict=True)):
                    got = [(start, next(outs)) for start, _ in p]
                    others = [g[i] for g in given[:-1]]
                    call = lambda texts: in_batches(model, [*([v] * len(texts) for v in others), texts], bs, budget)  # noqa: B023, E731
                    out = got[0][1] if len(got) == 1 else merge(got, call)
                    rows += [{columns[0]: k, **o} for o in (out if many else [out])]
                yield pd.DataFrame(rows, columns=columns)

        src = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
        return src.mapInPandas(run, self.schema)
