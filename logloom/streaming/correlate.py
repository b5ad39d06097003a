"""The correlator over a stream: the batch operator's pure step, with state kept by source.

Events are taken in order of arrival, by sequence number within a micro-batch; there is no
watermark, as late events are judged by their own times. Incidents are built per batch, so
their running number, which only feeds their fingerprint, counts within the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.operators import correlate as C

STATE = "failures array<bigint>, users array<string>, alerted bigint, total bigint"
CARRIED = ("ingested_at", "timestamp", "host", "facility", "source_port", "user", "rule", "raw_sha256")
FOUND = "source_ip string, seq bigint, kind string, failures int, users string, n_users int, total int, ingested_at timestamp, timestamp timestamp, host string, facility string, source_port int, user string, rule string, raw_sha256 string"


def _advance(cfg: C.Config):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = C.State()
        if state.exists:
            failures, users, alerted, total = state.get
            s = C.State(list(failures), set(users), None if alerted is None or alerted < 0 else alerted, total)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            hit = C.step(s, int(r.at), bool(r.fail), r.user or "", cfg)
            if hit:
                out.append((key[0], r.seq, *hit, *[getattr(r, c) for c in CARRIED]))
        state.update((s.failures, sorted(s.users), -1 if s.alerted is None else s.alerted, s.total))
        yield pd.DataFrame(out, columns=[x.strip().split()[0] for x in FOUND.split(",")])

    return run


def triggers(events: DataFrame, cfg: C.Config | None = None) -> DataFrame:
    """The streaming twin of ``correlate.triggers``, with the trigger events' columns."""
    small = events.where((F.col("source_ip") != "") & (C.failure() | C.success()) & F.col("timestamp").isNotNull())
    small = small.select("source_ip", "seq", F.unix_micros("timestamp").alias("at"), C.failure().alias("fail"), *CARRIED)
    return small.groupBy("source_ip").applyInPandasWithState(_advance(cfg or C.Config()), FOUND, STATE, "append", GroupStateTimeout.NoTimeout)


def write_incidents(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, cfg: C.Config | None = None, **trigger):
    """Starts the query: each batch's incidents go to ``sink(incidents, batch_id)``."""
    cfg = cfg or C.Config()
    w = triggers(events, cfg).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(C.build(df, cfg), i))
    return (w.trigger(**trigger) if trigger else w).start()
