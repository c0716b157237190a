"""Web archives: one WARC record for each page, written, read back, and indexed by
merging sorted runs of captures."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_path
from .common import hinted, in_batches, pick
from .url_rules import split_url

# The format's marks and the base32 alphabet.
START = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of one archive file.
RECORDS_PER_FILE = 20_000
#: Index rows that one merging task holds.
ROWS_PER_MERGE = 200_000
#: Where captures without a time of their own begin (2020-01-01, one a second).
FIRST_SECOND = 1_577_836_800

RECORD = (
    "urlkey string, captured string, page_id bigint, payload_bytes bigint, "
    "payload_digest string, record_type string, refers_to bigint, run string, "
    "place bigint"
)
ORDER = ("urlkey", "captured", "page_id")


def base32_sha1(data: Column) -> Column:
    """SHA-1 as 32 base32 letters: five hexadecimal digits give four of them."""
    digits = F.sha1(data)

    def letter(i: Column) -> Column:
        group = F.substring(digits, (i / 4).cast("int") * 5 + 1, F.lit(5))
        shift = F.pow(F.lit(32), 3 - i % 4).cast("int")
        value = (F.conv(group, 16, 10).cast("int") / shift).cast("int") % 32
        return F.substring(F.lit(BASE32), value + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def url_key(url: Column) -> Column:
    """Host labels from the top level down, then the path and what follows."""
    host, _ = split_url(url)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.coalesce(rest, F.lit("")))


def captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Every page with its payload, digest and ``refers_to``: the smallest page id
    with an equal payload of at least ``min_bytes`` bytes, if that is another one.

    Only digests are grouped, with a map-side combined minimum; payloads are never
    shuffled for it unless the digests that occur twice exceed a broadcast."""
    rows = pick(pages, page_id="page_id", url="url", html="html").select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    digest = F.sha2(F.col("html").cast("binary"), 256).alias("same")
    firsts = (
        rows.where(F.octet_length("html") >= min_bytes)
        .select("page_id", digest)
        .groupBy("same")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("same", "first")
    )
    known = hinted(materialize(firsts), 120)
    other = F.col("first") < F.col("page_id")
    return (
        rows.withColumn("same", digest)
        .join(known, "same", "left")
        .select(
            "page_id",
            "url",
            "html",
            F.when(other, F.col("first")).alias("refers_to"),
            F.octet_length("html").cast("bigint").alias("payload_bytes"),
            base32_sha1(F.col("html").cast("binary")).alias("payload_digest"),
            url_key(F.col("url")).alias("urlkey"),
            F.date_format(
                F.to_utc_timestamp(
                    F.timestamp_seconds(
                        F.coalesce("page_id", F.lit(0)) + FIRST_SECOND
                    ),
                    F.current_timezone(),
                ),
                "yyyy-MM-dd'T'HH:mm:ss'Z'",
            ).alias("captured"),
        )
    )


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")).cast("binary"))
    return F.regexp_replace(
        h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>"
    )


def record_text() -> Column:
    """A capture as the text of a WARC record. Line ends in a url are escaped; a
    revisit carries the HTTP headers only."""
    line, revisit = F.lit("\r\n"), F.col("refers_to").isNotNull()
    url = F.regexp_replace("url", "[\r\n\x00]", "%0A")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.lit("Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    own = F.coalesce(F.col("page_id"), F.lit(-1))
    return F.concat(
        F.lit(START),
        F.lit("WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        line,
        F.lit("WARC-Record-ID: "),
        _record_id(own),
        line,
        F.lit("WARC-Target-URI: "),
        url,
        line,
        F.lit("WARC-Date: "),
        "captured",
        line,
        F.lit("WARC-Payload-Digest: sha1:"),
        "payload_digest",
        line,
        F.when(
            revisit,
            F.concat(
                F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "),
                _record_id(F.col("refers_to")),
                F.lit("\r\nRefers-To-Page: "),
                F.col("refers_to").cast("string"),
                line,
            ),
        ).otherwise(""),
        F.when(
            F.col("page_id").isNotNull(),
            F.concat(F.lit("Page-Id: "), F.col("page_id").cast("string"), line),
        ).otherwise(""),
        F.lit("Url-Key: "),
        F.regexp_replace("urlkey", "[\r\n\x00]", "%0A"),
        line,
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )


def write_archives(rows: DataFrame, path: str) -> None:
    """Each task writes its captures in order of url key and time to gzipped
    archives; an archive is a sorted run. Spark's writer commits them, so a lost
    executor leaves no half file."""
    (
        rows.sortWithinPartitions(*ORDER)
        .select(record_text().alias("value"))
        .write.mode("overwrite")
        .option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def _headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, mark, value = line.partition(": ")
        if mark:
            found[name] = value
    return found


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of a record, without its first line; None while more of
    it is to come."""
    head, mark, rest = data.partition(END.encode())
    if not mark:
        return None
    headers = _headers(head)
    size = int(headers["Content-Length"])
    return (headers, rest[:size]) if len(rest) >= size else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives: key, time, page, payload size and digest (both
    taken from the payload itself where there is one), type, run and place in it.

    Archives are streamed, cut where a record may start; a payload that holds such
    a start itself is put together again by its ``Content-Length``. A payload
    unlike its recorded digest raises an error."""
    start = START.encode()

    def record(data: bytes) -> tuple | None:
        parsed = parse_record(data)
        if parsed is None:
            return None
        headers, block = parsed
        http, _, payload = block.partition(END.encode())
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(_headers(http)["Content-Length"])
        if headers["WARC-Type"] == "response":
            size = len(payload)
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
        page, other = headers.get("Page-Id"), headers.get("Refers-To-Page")
        return (
            headers["Url-Key"],
            headers["WARC-Date"],
            int(page) if page else None,
            size,
            digest,
            headers["WARC-Type"],
            int(other) if other else None,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, place = None, b"", 0
        for batch in batches:
            rows = []
            for name, data in zip(
                batch.column("run").to_pylist(),
                batch.column("value").to_pylist(),
                strict=True,
            ):
                if name != run:
                    if held:
                        raise ValueError(f"{run} ends inside a record")
                    run, place = name, 0
                if not held and not data:
                    continue  # before the first record
                held = held + start + data if held else data
                found = record(held)
                if found:
                    rows.append((*found, run, place))
                    held, place = b"", place + 1
            columns = list(zip(*rows, strict=True)) or [()] * len(SCHEMA)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)],
                schema=SCHEMA,
            )
        if held:
            raise ValueError(f"{run} ends inside a record")

    lines = spark.read.option("lineSep", START).text(path)
    named = lines.select(
        F.col("value").cast("binary").alias("value"),
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("run"),
    )
    return in_batches(named, work, RECORD)


SCHEMA = pa.schema(
    [
        ("urlkey", pa.string()),
        ("captured", pa.string()),
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("run", pa.string()),
        ("place", pa.int64()),
    ]
)


class LoserTree:
    """K-way merge: inner nodes hold the loser of their match, so that the next
    smallest needs one match on each level."""

    def __init__(self, runs: Sequence[Sequence], key: Callable) -> None:
        self.runs, self.key = runs, key
        self.places = [0] * len(runs)
        self.heads = [self._head(k) for k in range(len(runs))]
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._build(1) if runs else -1

    def _head(self, k: int):
        run, place = self.runs[k], self.places[k]
        return (0, self.key(run[place]), k) if place < len(run) else (1, None, k)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x[0] or y[0]:
            return x[0] < y[0]
        return (x[1], a) < (y[1], b)

    def _build(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, loser = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and not self.heads[self.winner][0]:
            best = self.winner
            yield self.runs[best][self.places[best]]
            self.places[best] += 1
            self.heads[best] = self._head(best)
            node = (best + len(self.runs)) // 2
            while node:
                if self._beats(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


def capture_histories(
    records: DataFrame, rows_per_merge: int = ROWS_PER_MERGE
) -> DataFrame:
    """The captures of all runs in one order of url key, time and page.

    Ranges of that order go to tasks of about ``rows_per_merge`` rows, a url that
    is captured very often to several. A task merges the slices of the runs that
    fall into its range with a loser tree; partitions follow one another in order.
    """
    stored = materialize(records)
    parts = 1 + stored.count() // rows_per_merge
    ranged = stored.repartitionByRange(parts, *ORDER)
    sliced = ranged.sortWithinPartitions("run", "place")

    def key(row: tuple) -> tuple:
        return row[0], row[1], row[2] is not None, row[2] or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in SCHEMA.names]
            for row in zip(*columns, strict=True):
                runs.setdefault(row[-2], []).append(row)
        held = []
        for row in LoserTree(list(runs.values()), key):
            held.append(row)
            if len(held) == 10_000:
                yield _batch(held)
                held = []
        yield _batch(held)

    return sliced.mapInArrow(work, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(SCHEMA)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)],
        schema=SCHEMA,
    )


def archive(
    pages: DataFrame, path: str | None = None, min_bytes: int = 0
) -> DataFrame:
    """Write all pages as WARC archives under ``path`` (the shared folder if not
    given), read them back, and return the merged capture histories.

    Null html is an empty payload, a null url an empty target. Of equal payloads of
    at least ``min_bytes`` bytes the one with the smallest page id is the response
    and the others revisit it; repeated rows of one page are each a response if it
    is the smallest. Pages without an id are responses and refer to nothing; an
    empty table gives archives without records.
    """
    spark = pages.sparkSession
    if path is None:
        path = shared_path(spark, "-warc")
    write_archives(captures(pages, min_bytes), path)
    return capture_histories(read_archives(spark, path))
