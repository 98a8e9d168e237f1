"""A data source of observations that fetches slices of ids, each in a task of its own.

``spark.read.format("observations")`` names a fetcher (option ``fetcher``, ``module:Class``),
which is made in every task from the other options and knows two things: ranges of ids that
cover the survey, and the observations of a slice. Filters on source_id, t and band go to the
fetcher (with spark.sql.python.filterPushdown.enabled), so a search by ids asks for those ids
only, ``slice`` of them at a time, and a range of times leaves other epochs where they are.
The driver holds ranges and the ids that a query names, never those of the survey.

Defined results: an id that the survey doesn't have gives no rows; one named twice is fetched
once; null ids are never found; without any id left there is no task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib import import_module

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source_id string, band string, t double, mag double, mag_err double, ord long"
ARROW = pa.schema([("source_id", pa.string()), ("band", pa.string()), ("t", pa.float64()), ("mag", pa.float64()), ("mag_err", pa.float64()), ("ord", pa.int64())])
#: Ids of a request.
SLICE = 1_000


@dataclass
class Wanted:
    """What filters leave: ids and bands (None: all), and bounds of time with whether they are included."""

    ids: list[str] | None = None
    bands: list[str] | None = None
    after: tuple[float, bool] | None = None
    before: tuple[float, bool] | None = None

    def takes(self, f: Filter) -> bool:
        """Narrow by one filter; False if it has to be applied by Spark."""
        column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
        if isinstance(f, EqualTo | In) and column in ("source_id", "band"):
            values = list(f.value) if isinstance(f, In) else [f.value]
            name = "ids" if column == "source_id" else "bands"
            had = getattr(self, name)
            setattr(self, name, sorted({v for v in values if v is not None and (had is None or v in had)}))
            return True
        if column == "t" and isinstance(f, GreaterThan | GreaterThanOrEqual):
            bound = (f.value, isinstance(f, GreaterThanOrEqual))
            self.after = max(self.after or bound, bound, key=lambda b: (b[0], not b[1]))
            return True
        if column == "t" and isinstance(f, LessThan | LessThanOrEqual):
            bound = (f.value, isinstance(f, LessThanOrEqual))
            self.before = min(self.before or bound, bound, key=lambda b: (b[0], b[1]))
            return True
        return False


@dataclass
class Slice(InputPartition):
    """Ids by name, or a range of them as the fetcher counts."""

    ids: list[str] | None = None
    span: tuple | None = None
    wanted: Wanted = field(default_factory=Wanted)

    def __init__(self, ids: list[str] | None, span: tuple | None, wanted: Wanted) -> None:
        super().__init__(None)
        self.ids, self.span, self.wanted = ids, span, wanted


class ObservationReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.wanted = options, Wanted()

    def _fetcher(self):
        module, name = self.options["fetcher"].split(":")
        return getattr(import_module(module), name)(self.options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.takes(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        size = int(self.options.get("slice", SLICE))
        if self.wanted.ids is not None:
            ids = self.wanted.ids
            return [Slice(ids[k : k + size], None, self.wanted) for k in range(0, len(ids), size)]
        return [Slice(None, span, self.wanted) for span in self._fetcher().spans()]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from self._fetcher().fetch(partition.ids, partition.span, partition.wanted)


class ObservationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObservationReader:
        return ObservationReader(dict(self.options))


class TableFetcher:
    """Observations of a Parquet table of events (option ``path``): a source a user, one band. Spans are runs of row groups."""

    def __init__(self, options: dict[str, str]) -> None:
        self.table = ds.dataset(options["path"], format="parquet")
        self.groups = int(options.get("groups", 1))

    def spans(self) -> list[tuple[int, int, int]]:
        """(file, first row group, end) of each task."""
        return [(i, k, k + self.groups) for i, f in enumerate(self.table.get_fragments()) for k in range(0, f.num_row_groups, self.groups)]

    def fetch(self, ids: list[str] | None, span: tuple | None, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        if wanted.bands is not None and "r" not in wanted.bands:
            return
        where = None
        if ids is not None:
            # only a number's own decimal form is an id of this table
            own = [int(i) for i in ids if i.lstrip("-").isdecimal() and str(int(i)) == i and abs(int(i)) < 1 << 63]
            if not own:
                return
            where = pc.field("user_id").isin(pa.array(own, pa.int64()))
        source = self.table
        if span is not None:
            fragment = list(self.table.get_fragments())[span[0]]
            source = fragment.subset(row_group_ids=list(range(span[1], min(span[2], fragment.num_row_groups))))
        for batch in source.to_batches(columns=["user_id", "ts", "value", "event_id"], filter=where):
            t = pc.add(pc.divide(pc.cast(pc.cast(batch["ts"], pa.timestamp("us")), pa.int64()).cast(pa.float64()), 86400e6), 2440587.5)
            keep = pa.array([True] * batch.num_rows, pa.bool_())
            for bound, strict, loose in ((wanted.after, pc.greater, pc.greater_equal), (wanted.before, pc.less, pc.less_equal)):
                if bound is not None:
                    keep = pc.and_kleene(keep, (loose if bound[1] else strict)(t, bound[0]))
            step = pc.subtract(batch["event_id"], pc.multiply(pc.divide(batch["event_id"], 7), 7))
            columns = [pc.cast(batch["user_id"], pa.string()), pa.array(["r"] * batch.num_rows, pa.string()), t, pc.add(pc.divide(batch["value"], 100.0), 15.0), pc.add(pc.multiply(step.cast(pa.float64()), 0.01), 0.02), batch["event_id"]]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW).filter(keep)


def observations(spark: SparkSession, fetcher: str, **options: str):
    """The observations behind a fetcher; filters on source_id, t and band reach it."""
    spark.dataSource.register(ObservationSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("observations").options(fetcher=fetcher, **options).load()
