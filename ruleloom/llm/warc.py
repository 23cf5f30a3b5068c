"""WARC archives: writing, reading back, and merging per-archive indexes into one capture history.

Each record is a gzip member of its own, so that a reader can start at any offset of the index. Spark's own text sink
writes the members, with an empty member as line separator, so that its commit protocol covers failed tasks. Each archive
read back gives a run: its captures sorted by URL key and time. The runs are cut into key ranges of bounded size, and each
range merges its slices of all runs with a loser tree.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, small_batches, tidied, written

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

EMPTY_MEMBER = gzip.compress(b"", mtime=0)

REVISIT_LEAST_BYTES = 1000
FIRST_SECOND = 1704067200  # 2024-01-01; a page without a capture time is placed this far on plus its id
RECORDS_PER_FILE = 20_000
RANGE_ROWS = 50_000  # captures that a task merges, about
LEVEL = 6  # of compression


def decide(pages: DataFrame, id_col: str, url_col: str, html_col: str, time_col: str | None) -> DataFrame:
    """row_id, page_id, url, second, html, n_bytes, digest, response_id, is_response. Of equal payloads of REVISIT_LEAST_BYTES or more the row with the largest id is the response."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    second = F.unix_timestamp(F.col(time_col)) if time_col else F.lit(FIRST_SECOND) + F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(10**9))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), second.cast("long").alias("second"), html.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("n_bytes"), F.sha1("html").alias("digest"), F.unhex(F.sha2("html", 256)).alias("equal"))
    groups = rows.filter(F.col("n_bytes") >= REVISIT_LEAST_BYTES).groupBy("equal").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    # only payloads that occur again need to meet their group
    again = groups.filter("n > 1").select("equal", "response_id")
    return rows.join(again, "equal", "left").drop("equal")


def record(rows: DataFrame) -> DataFrame:
    """One text value for each row: the WARC record without its terminator."""
    is_revisit = F.col("response_id").isNotNull() & ~F.col("response_id").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("html")))
    uri = F.coalesce(F.regexp_replace("url", "[\\s\\p{Cntrl}]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))

    def name(page_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))

    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds(F.coalesce("second", F.lit(FIRST_SECOND))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("response_id")))),
        F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(END), block).alias("value"))


def members(records: DataFrame) -> DataFrame:
    """value: each record, closed by its terminator, as the bytes of a gzip member. The text sink writes strings byte by byte, so these stand in a column of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch["value"]:
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                packed.append(pack.compress(value.as_py().encode() + END.encode()) + pack.flush())
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])

    small_batches(records.sparkSession)
    return records.mapInArrow(tidied(run), "value binary").select(F.col("value").cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, per_file: int = RECORDS_PER_FILE) -> None:
    """Writes a WARC record for each row into archives below path, each record as a gzip member. An archive holds the records of one task, per_file at most.

    A null payload is empty. A null URL becomes urn:page:<id>; white space and control characters in a URL become %20.
    Of equal payloads of 1000 bytes or more, rows with the largest id are responses and the others revisit it, so that
    repeated rows with that id are all responses. Payloads below that are all responses. Rows with one id have one record
    id, too.
    """
    records = members(record(decide(pages, id_col, url_col, html_col, time_col)))
    records.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("ISO-8859-1")).option("maxRecordsPerFile", per_file).text(path)


def read_member(archive: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member that starts at that byte of an archive, and where the next one starts."""
    unpack, content, end, step = zlib.decompressobj(31), [], at, 1 << 14
    try:
        while not unpack.eof and end < len(archive):
            content.append(unpack.decompress(archive[end : end + step]))
            end, step = end + step, min(2 * step, 1 << 20)
    except zlib.error as error:
        raise ValueError(f"no gzip member at {at}") from error
    if not unpack.eof:
        raise ValueError(f"member at {at} is cut short")
    return b"".join(content), min(end, len(archive)) - len(unpack.unused_data)


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    """Headers with lower-case names, and the block. Raises ValueError where the bytes are not one WARC record."""
    head, _, rest = raw.partition(END.encode())
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + len(END) or rest[size:] != END.encode():
        raise ValueError(f"record at {at} is cut short")
    return headers, rest[:size]


def read_records(archive: bytes | memoryview) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records of one archive: offset of the member, headers with lower-case names, block. Raises ValueError where the bytes are not WARC."""
    at, archive = 0, memoryview(archive)
    while at < len(archive):
        content, end = read_member(archive, at)
        if content:  # an empty member parts two others
            yield at, *parse_record(content, at)
        at = end


def url_key(url: str) -> str:
    """Sort-friendly key: the host's labels reversed, no scheme, port or fragment, e.g. com,example,www)/path?query."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url.lower()
    if not host:
        return url
    path = parts.path or "/"
    return ",".join(reversed(host.split("."))) + ")" + path + ("?" + parts.query if parts.query else "")


def _page(name: str | None) -> int | None:
    """The id in <urn:page:ID>; null where there is none."""
    value = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


RUN_SCHEMA = "run string, offset long, url_key string, url string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RUN_FIELDS = [(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (f.split() for f in RUN_SCHEMA.split(", "))]


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """Reads archives back. Each gives one run: its captures, sorted by URL key, time and page id.

    Digests and lengths of responses are taken anew from the payload and held against the header; those of revisits, of
    which the archive has no payload, come from the headers.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows = []
                for offset, h, block in read_records(content.as_buffer()):
                    http, _, payload = block.partition(END.encode())
                    said = h.get("warc-payload-digest", "").removeprefix("sha1:").lower()
                    if h["warc-type"] == "revisit":
                        lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        size, digest = int(lengths[0]), said
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest != said:
                            raise ValueError(f"{name}: payload at {offset} does not match its digest")
                    rows.append((name, offset, url_key(h["warc-target-uri"]), h["warc-target-uri"], h["warc-date"], _page(h["warc-record-id"]), size, digest, h["warc-type"], _page(h.get("warc-refers-to"))))
                rows.sort(key=capture_order)
                yield _batch(rows, RUN_FIELDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(tidied(runs), RUN_SCHEMA)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def capture_order(row: tuple) -> tuple:
    """URL key, time, page id (null last), place: the order of a capture history."""
    return row[2], row[4], row[5] is None, row[5] or 0, row[0], row[1]


def loser_tree(runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]) -> Iterator[tuple]:
    """Merges sorted runs: a tournament whose inner nodes hold losers, so that each row costs one path from leaf to root."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    keys = [None if h is None else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[a] is not None
        return (keys[a], a) < (keys[b], b)

    losers = [-1] * max(k, 1)
    winner = -1
    for leaf in range(k):  # each run climbs until it meets an empty node, where it waits
        node, run = (leaf + k) // 2, leaf
        while node > 0:
            if losers[node] < 0:
                losers[node], run = run, -1
                break
            if beats(losers[node], run):
                losers[node], run = run, losers[node]
            node //= 2
        if run >= 0:
            winner = run
    while winner >= 0 and heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(runs[winner], None)
        keys[winner] = None if heads[winner] is None else key(heads[winner])
        node, run = (winner + k) // 2, winner
        while node > 0:
            if beats(losers[node], run):
                losers[node], run = run, losers[node]
            node //= 2
        winner = run


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Merges the runs of all archives into one order: adds history_rank, from 1, which rises by URL key, time and page id over the whole result.

    The key ranges end at sampled captures, time and id included, so that one URL or host with very many captures is
    spread over several ranges too; there are as many as bring range_rows captures into each, so that a task's memory is
    bounded whatever the corpus. runs: cheap to read twice.
    """
    from pyspark import TaskContext

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slices.setdefault(row[0], []).append(row)
        where, out, n = TaskContext.get().partitionId(), [], 0
        for row in loser_tree([iter(slices[r]) for r in sorted(slices)], capture_order):
            out.append((*row, where, n := n + 1))
            if len(out) == 10_000:
                yield _batch(out, fields)
                out = []
        if out:
            yield _batch(out, fields)

    schema, fields = RUN_SCHEMA + ", key_range long, place long", [*RUN_FIELDS, ("key_range", pa.int64()), ("place", pa.int64())]
    order = ["url_key", "captured", F.col("page_id").asc_nulls_last(), "run", "offset"]
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    # the exchange may mix the blocks of one run; within the range each slice is put back in its run's order
    ranged = runs.repartitionByRange(ranges, *order).sortWithinPartitions("run", *order[:3], "offset")
    merged = written(ranged.mapInArrow(tidied(merge), schema), "history")
    # a row for each range, so one small partition and a small broadcast
    sizes = merged.groupBy("key_range").agg(F.count("*").alias("n"))
    before = sizes.select("key_range", F.coalesce(F.sum("n").over(Window.orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return merged.join(F.broadcast(before), "key_range").select(*runs.columns, (F.col("before") + F.col("place")).alias("history_rank"))


def capture_history(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Writes the archives below path, reads them back and merges their indexes: a row for each page with page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, archive, offset, history_rank.

    See write_archives for nulls, ties and repeated rows; an empty table gives an empty result; other columns aren't read.
    """
    write_archives(pages, path, id_col, url_col, html_col, time_col)
    runs = written(index_archives(pages.sparkSession, path), "warc-runs")
    kind = pages.schema[id_col].dataType
    return merge_runs(runs).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url_key", "captured", F.col("run").alias("archive"), "offset", "history_rank"
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """capture_history with archives in the shared folder."""
    return capture_history(pages, new_path(pages.sparkSession, "warc"))
