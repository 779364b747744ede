"""Progress of a build from observed metrics: counted as rows pass by, without a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

def observed(tiles: DataFrame, by: str | Observation, body: str = "body") -> DataFrame:
    """tiles, whose number and bytes are reported under a name (of a stream) or to an Observation (of a batch) as they pass."""
    return tiles.observe(by, F.count(F.lit(1)).alias("tiles"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("bytes"), F.count_if(F.col(body).isNull()).alias("missing"))


class BuildProgress(StreamingQueryListener):
    """Tiles and bytes done so far of a stream observed under `name`, and the seconds that the rest of `total` tiles will take at the rate so far."""

    def __init__(self, name: str, total: int):
        self.name, self.total, self.tiles, self.bytes, self.missing, self.seconds, self.batches, self.ended = name, total, 0, 0, 0, 0.0, [], False

    @property
    def eta(self) -> float | None:
        """None until the first tiles are done."""
        return max(self.total - self.tiles, 0) * self.seconds / self.tiles if self.tiles else None

    @property
    def done(self) -> float:
        return min(1.0, self.tiles / self.total) if self.total else 1.0

    def onQueryStarted(self, event) -> None:
        self.ended = False

    def onQueryProgress(self, event) -> None:
        p = event.progress
        m = p.observedMetrics.get(self.name)
        if m is None or p.batchId in self.batches:  # another query's, or a batch told twice
            return
        self.batches.append(p.batchId)
        self.tiles += m["tiles"]
        self.bytes += m["bytes"]
        self.missing += m["missing"]
        self.seconds += p.batchDuration / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True
