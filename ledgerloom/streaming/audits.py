"""Streaming variants (an extension: the batch operators have no stream counterpart elsewhere).

Continuity keeps each statement's last balance as state; break counts are windowed in event time, and rows later than the
watermark are left to a batch re-audit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR = 100


def stream_continuity(txns: DataFrame) -> DataFrame:
    """txns(doc_id, row_idx, debit_c, credit_c, balance_c) as a stream -> (doc_id, row_idx, diff_c, ok) of each transition.
    Within a batch rows are taken by row_idx; a missing balance breaks the chain, as in the batch audit."""

    def audit(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, last = state.get if state.exists else (False, 0)
        rows = pd.concat(list(frames)).sort_values("row_idx")
        out = []
        for r in rows.itertuples():
            if pd.isna(r.balance_c):
                known = False
                continue
            if known:
                diff = int(r.balance_c - (last + (0 if pd.isna(r.credit_c) else r.credit_c) - (0 if pd.isna(r.debit_c) else r.debit_c)))
                out.append((key[0], int(r.row_idx), diff, abs(diff) <= NEAR))
            known, last = True, int(r.balance_c)
        state.update((known, last))
        yield pd.DataFrame(out, columns=["doc_id", "row_idx", "diff_c", "ok"])

    return txns.groupBy("doc_id").applyInPandasWithState(audit, "doc_id long, row_idx long, diff_c long, ok boolean", "known boolean, last long", "append", "NoTimeout")


def windowed_breaks(transitions: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """transitions(ts, ok) -> breaks in tumbling windows of event time."""
    return transitions.withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("transitions"), F.count_if(~F.col("ok")).alias("breaks"))
