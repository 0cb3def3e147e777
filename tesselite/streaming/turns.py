"""Continuous ingestion with Structured Streaming: retained turns and changed files.

Both are twins of batch operators and give the same rows once the stream has brought the same input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesselite.operators import changes

TURN = "conv_id long, turn_no long, text string"


def retained_turns(messages: DataFrame, every: int = 1, chars: int = 1200) -> DataFrame:
    """Every `every`-th completed turn of a stream of messages (conv_id, turn, role, content).

    The state of a conversation is its number of turns and the user message that waits for its answer;
    messages of a micro-batch are taken in order of turn, and those of a conversation must arrive in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, waiting = state.get if state.exists else (0, None)
        out = []
        for row in pd.concat(list(batches)).sort_values("turn", kind="stable").itertuples():
            if row.role == "user":
                waiting = row.content or ""
            elif row.role == "assistant" and waiting is not None:
                count += 1
                if count % every == 0:
                    out.append((key[0], count, f"User: {waiting[:chars]}\nAssistant: {(row.content or '')[:chars]}"))
                waiting = None
            else:
                waiting = None
        state.update((count, waiting))
        yield pd.DataFrame(out, columns=["conv_id", "turn_no", "text"])

    return messages.groupBy("conv_id").applyInPandasWithState(step, TURN, "count long, waiting string", "append", GroupStateTimeout.NoTimeout)


def process_changes(scans: DataFrame, ledger: Callable[[], DataFrame], commit: Callable[[DataFrame, int], None], checkpoint: str, log: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Give each micro-batch's new or changed files to `commit`, which processes them and writes the ledger.

    A batch that failed comes again with the same number, and the ledger drops what an earlier try committed.
    A scan may arrive after a newer one of its file: the ledger must carry seen_at and scan_id of what was
    processed, or `log` give all scans so far, this batch included.
    """

    def each(batch: DataFrame, number: int) -> None:
        done = ledger()
        if log is None and not {"seen_at", "scan_id"} <= set(done.columns):
            raise ValueError("the ledger has no seen_at and scan_id, and there is no log of all scans")
        commit(changes.unprocessed(batch if log is None else log(), done, arrived=batch), number)

    return scans.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Entries per window of event time and category, with a watermark for late rows."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", width), "category").agg(F.count(F.lit(1)).alias("n"))
