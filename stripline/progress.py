"""Progress of the searches: metrics of what a step judged, handed to a callback when the step is written."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stripline.session import cut

Callback = Callable[[str, dict], None]
_listeners: ContextVar[tuple[Callback, ...]] = ContextVar("listeners", default=())


@contextmanager
def on_progress(callback: Callback) -> Iterator[None]:
    """Within the block, ``callback(step, metrics)`` hears of every step that a search has written, in the order of the steps."""
    token = _listeners.set((*_listeners.get(), callback))
    try:
        yield
    finally:
        _listeners.reset(token)


def cut_measured(df: DataFrame, step: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`cut`, and metrics of what is written, gathered by the tasks that write it: one job where an aggregate of its own would be a second."""
    seen = Observation(step)
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]))
    found: Mapping = seen.get
    return out, dict(found)


def cut_observed(df: DataFrame, step: str, **metrics: Column) -> DataFrame:
    """:func:`cut`, with the number of ``rows`` and the ``metrics`` of what is written told to the listeners; without any it is a plain cut."""
    listeners = _listeners.get()
    if not listeners:
        return cut(df)
    out, found = cut_measured(df, step, **metrics)
    for callback in listeners:
        callback(step, dict(found))
    return out
