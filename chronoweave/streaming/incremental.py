"""Keeping closures up to date while edges arrive.

Edges of a document are its state; each batch adds edges, closes the document's graph and gives what is new. State is
keyed by doc_id, so documents are spread over the cluster and a batch touches only those that it mentions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.functions import allen
from chronoweave.operators import statements

EDGE = "src string, tgt string, rel int"


def _turn(rel: int) -> int:
    return rel if rel == 0 else ((rel - 1) ^ 1) + 1


def extend(known: set, fresh: list, table: dict) -> list:
    """Add edges to a closed set and return all that are new: each edge is turned and composed with what is there."""
    out, todo = [], list(fresh)
    ahead: dict[str, set] = {}
    back: dict[str, set] = {}
    for s, t, r in known:
        ahead.setdefault(s, set()).add((t, r))
        back.setdefault(t, set()).add((s, r))
    while todo:
        edge = todo.pop()
        if edge in known:
            continue
        s, t, r = edge
        known.add(edge)
        out.append(edge)
        ahead.setdefault(s, set()).add((t, r))
        back.setdefault(t, set()).add((s, r))
        todo.append((t, s, _turn(r)))
        todo += [(s, w, table[r, q]) for w, q in ahead.get(t, ()) if w != s and (r, q) in table]
        todo += [(u, t, table[q, r]) for u, q in back.get(s, ()) if u != t and (q, r) in table]
    return out


def closure_stream(edges: DataFrame, dim: DataFrame) -> DataFrame:
    """A stream of doc_id, src, tgt, rel to the stream of all edges that become known; dim: r1, r2, r3 (169 rows at most)."""
    table = {(r.r1, r.r2): r.r3 for r in dim.collect()}
    kind = edges.schema["doc_id"].dataType.simpleString()

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {tuple(e) for e in zip(*state.get)} if state.exists else set()
        fresh = [(s, t, int(r)) for part in parts for s, t, r in zip(part["src"], part["tgt"], part["rel"])]
        new = extend(known, fresh, table)
        state.update(tuple([*c] for c in zip(*sorted(known))))
        yield pd.DataFrame({"doc_id": [key[0]] * len(new), "src": [e[0] for e in new], "tgt": [e[1] for e in new], "rel": [e[2] for e in new]})

    return edges.groupBy("doc_id").applyInPandasWithState(update, f"doc_id {kind}, {EDGE}", "src array<string>, tgt array<string>, rel array<int>", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Drain a stream's available input into Parquet at path and read it."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def statement_stream(lines: DataFrame, handle) -> None:
    """Feed a stream of statements (doc_id, epoch, text) to handle(parsed), batch by batch."""
    lines.writeStream.foreachBatch(lambda batch, _: handle(statements.parse(batch))).trigger(availableNow=True).start().awaitTermination()


def relation_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Windowed counts of a stream of timed events (ts, event_type), closed by watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"))


def dims(spark: SparkSession) -> DataFrame:
    return allen.core_dim(spark)
