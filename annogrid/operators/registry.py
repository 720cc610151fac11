"""Named analyses, detectors and views: functions from DataFrame to DataFrame, run with each one's errors kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame


class Registry:
    """A table of functions by name; unknown names raise ValueError."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def register(self, name: str) -> Callable:
        def put(fn: Callable) -> Callable:
            self.known[name] = fn
            return fn

        return put

    def get(self, name: str) -> Callable:
        if name not in self.known:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[name]

    def run_all(self, df: DataFrame) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """The result of each function that can be planned, and the error of each that can't."""
        done, failed = {}, {}
        for name, fn in self.known.items():
            try:
                done[name] = fn(df)
                done[name].schema  # noqa: B018  an analysis error shows here
            except (PySparkException, ValueError, KeyError) as e:
                failed[name] = str(e)
        return done, failed


analyses = Registry("analysis")
detectors = Registry("detector")
views = Registry("view")


def _defaults() -> None:
    from annogrid.operators import dashboard, pixels

    for fn in (pixels.luminance_metrics, pixels.exposure_issues, pixels.tonal_histogram, pixels.dynamic_range, pixels.exposure_grade):
        analyses.register(fn.__name__)(fn)
    for fn in (dashboard.overview, dashboard.category_traces, dashboard.scatter):
        views.register(fn.__name__)(fn)


_defaults()
