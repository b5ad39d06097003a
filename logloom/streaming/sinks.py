"""Sinks of micro-batches: several at once, counting only, appending JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from logloom.sources.schema import to_json

Sink = Callable[[DataFrame, int], None]


def jsonl(path: str) -> Sink:
    """Appends a batch as JSON lines below ``path``, in a folder of its own that a retry replaces."""
    return lambda df, batch: to_json(df).write.mode("overwrite").text(f"{path}/batch={batch}")


def discard() -> Sink:
    return lambda df, batch: df.write.format("noop").mode("overwrite").save()


def tee(*sinks: Sink) -> Sink:
    """Every batch to every sink: one failing sink doesn't keep it from the others; the first error is raised after all."""
    def run(df: DataFrame, batch: int) -> None:
        df = df.persist()
        errors = []
        try:
            for s in sinks:
                try:
                    s(df, batch)
                except Exception as e:  # raised below
                    errors.append(e)
        finally:
            df.unpersist()
        if errors:
            raise errors[0]

    return run
