"""The parser job on a stream of events: stateless, so the batch operator runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logfold.operators.parse import normalize_events, routed, write_schemas
from logfold.operators.templates import MASKS, masked


def normalize_stream(events: DataFrame, specs: DataFrame, declared: dict[str, str], named: DataFrame, masks: list[tuple[str, str]] = MASKS) -> DataFrame:
    """events(ord, text) from readStream -> wide normalised events.

    ``named`` is the static table (masked, cluster_id, ...) of mining (``templates.pattern_templates``): a line finds its
    cluster by its masked form, whatever words the template leaves open. Lines of unknown form give no row.
    """
    assigned = events.withColumn("masked", masked(F.col("text"), masks)).join(named.select("masked", "cluster_id"), "masked").drop("masked")
    return normalize_events(assigned, specs, declared)


def stream_schemas(events: DataFrame, specs: DataFrame, declared: dict[str, dict[str, str]], named: DataFrame, folder: str, checkpoint: str, masks: list[tuple[str, str]] = MASKS) -> StreamingQuery:
    """Starts the query that keeps a table for each schema, and one of the lines without a parser, below ``folder``.

    The tables are those that ``write_schemas`` makes of the same lines at once; a batch that is repeated after a failure
    replaces itself. Takes what there is and ends.
    """
    assigned = events.withColumn("masked", masked(F.col("text"), masks)).join(named.select("masked", "cluster_id"), "masked", "left").drop("masked")
    lines = routed(assigned, specs, declared)
    write = lambda rows, batch: write_schemas(rows, folder, declared, batch)
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
