"""A paged REST search as a Spark data source for batches and streams, with a retry policy, and ingest helpers."""

from __future__ import annotations

import datetime
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

RETRIED = (429, 502, 503, 504)
ATTEMPTS = 5
SCHEMA = "id string, name string, created string, duration double, tags string, description string, query string"


def wait_before(attempt: int, status: int | None) -> float:
    """Seconds before the next attempt: doubling up to a minute, half a minute at least when told to slow down."""
    seconds = float(min(2**attempt, 60))
    return max(seconds, 30.0) if status == 429 else seconds


def fetch(url: str, get: Callable[[str], tuple[int, bytes]], sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON object at a URL; retried after time-outs and the statuses in RETRIED."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            status, body = get(url)
        except TimeoutError:
            status, body = None, b""
        if status == 200:
            found = json.loads(body)
            if not isinstance(found, dict) or not isinstance(found.get("results"), list):
                raise ValueError("no list of results")
            return found
        if attempt == ATTEMPTS or (status is not None and status not in RETRIED):
            raise RuntimeError(f"{url}: {status}")
        sleep(wait_before(attempt, status))
    raise AssertionError


def http_get(url: str, timeout: float = 30.0) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


#: Previews in the order they are tried, and the fewest bytes that are a sound.
PREVIEWS, LEAST_BYTES = ("preview-hq-mp3", "preview-lq-mp3"), 100


def sound_bytes(download: str | None, kind: str | None, previews: dict[str, str] | None, get: Callable[[str], tuple[int, bytes]], sleep: Callable[[float], None] = time.sleep) -> tuple[bytes, str] | None:
    """(bytes, ending) of a sound: the original, else the first preview that is there; None where there is none."""
    tried = [(download, kind or "wav"), *((dict(previews or {}).get(p), "mp3") for p in PREVIEWS)]
    for url, ending in tried:
        for attempt in range(1, ATTEMPTS + 1) if url else ():
            try:
                status, body = get(url)
            except TimeoutError:
                status, body = None, b""
            if status == 200 and len(body) > LEAST_BYTES:
                return body, ending
            if attempt == ATTEMPTS or (status is not None and status not in RETRIED):
                break
            sleep(wait_before(attempt, status))
    return None


def download(sounds: DataFrame, get: Callable[[str], tuple[int, bytes]] = http_get) -> DataFrame:
    """id, content, ending of (id, download, type, previews map) rows, fetched by the tasks; null where nothing could be had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                body, ending = sound_bytes(row["download"], row["type"], row["previews"], get) or (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([row["id"]], pa.string()), pa.array([body], pa.binary()), pa.array([ending], pa.string())], names=["id", "content", "ending"])

    return sounds.select("id", "download", "type", "previews").mapInArrow(run, "id string, content binary, ending string")


class _Page(InputPartition):
    def __init__(self, query: str, page: int, span: str):
        self.query, self.page, self.span = query, page, span


class _Search:
    """What is asked for: queries, durations, and a span of creation times (ISO text, either end may be open)."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.size = int(options.get("page_size", "50"))

    def _span(self, since: str | None, until: str | None) -> str:
        span = f"duration:[{self.options.get('shortest', '1')} TO {self.options.get('longest', '10')}]"
        return span + (f" created:[{since or '*'} TO {until or '*'}]" if since or until else "")

    def _ask(self, page: _Page) -> dict:
        ask = urllib.parse.urlencode({"query": page.query, "filter": page.span, "page": page.page, "page_size": self.size})
        return fetch(f"{self.options['url']}?{ask}", http_get)

    def pages(self, since: str | None, until: str | None) -> list[InputPartition]:
        """A partition for each page: as many as the option says, else as the number of results that the first page tells asks for."""
        span, out = self._span(since, until), []
        for query in self.options["queries"].split(","):
            told = self.options.get("pages")
            n = int(told) if told else -(-int(self._ask(_Page(query, 1, span)).get("count", 1)) // self.size)
            out += [_Page(query, p, span) for p in range(1, n + 1)]
        return out

    def rows(self, page: _Page) -> Iterator[tuple]:
        for r in self._ask(page)["results"]:
            text = " ".join(str(r.get("description") or "").split("\n"))[:500]
            yield str(r.get("id")), r.get("name"), r.get("created"), float(r.get("duration") or 0), "|".join(r.get("tags") or []), text, page.query


class _Reader(_Search, DataSourceReader):
    """A comparison of `created` with a text becomes an end of the span that is asked for (its ends belong to it)."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.since, self.until = options.get("created_after"), None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at = getattr(f, "value", None) if getattr(f, "attribute", None) == ("created",) and isinstance(getattr(f, "value", None), str) else None
            if at is not None and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.since = max(self.since or at, at)
            if at is not None and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.until = min(self.until or at, at)
            if at is None or not isinstance(f, (GreaterThanOrEqual, LessThanOrEqual, EqualTo)):
                yield f  # still to be tested on the rows

    def partitions(self) -> list[InputPartition]:
        return self.pages(self.since, self.until)

    def read(self, partition: _Page) -> Iterator[tuple]:
        return self.rows(partition)


class _Span(_Page):
    def __init__(self, page: _Page, since: str, until: str):
        super().__init__(page.query, page.page, page.span)
        self.since, self.until = since, until


class _Stream(_Search, DataSourceStreamReader):
    """Micro-batches of what was created from one look on to before the next; an offset is the time of a look."""

    def initialOffset(self) -> dict:
        return {"until": self.options.get("created_after", "")}

    def latestOffset(self) -> dict:
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        return {"until": self.options.get("created_before", now)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["until"] <= start["until"]:
            return []
        return [_Span(page, start["until"], end["until"]) for page in self.pages(start["until"], end["until"])]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for row in self.rows(partition):
            if row[2] is not None and partition.since <= row[2] < partition.until:
                yield row


class SoundSearch(DataSource):
    """register(spark); spark.read.format("sound_search").option("url", ...).option("queries", "rain,wind").load(), or spark.readStream."""

    @classmethod
    def name(cls) -> str:
        return "sound_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known, and has comparisons of `created` pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SoundSearch)


def new_only(found: DataFrame, known: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of sources not ingested yet, once each."""
    return found.dropDuplicates([key]).join(known.select(key).where(F.length(key) > 0).distinct(), key, "left_anti")


def drawn(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that depends on the seed and the key alone."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
