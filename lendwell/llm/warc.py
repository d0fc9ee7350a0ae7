"""WARC archives: written as whole-file gzip streams, normalised to one member per record.

`write_archives` lets Spark's own text writer lay the records down, which gives
files that are one gzip stream each. `normalise` inflates every such file once,
front to back, rewrites each record as a gzip member of its own and writes a
sidecar index of offsets. `read_records` fetches records by that index.

Tasks hold one record at a time besides fixed buffers. Files are written under
the name of the attempt and renamed when complete, so a lost executor leaves no
half file under a final name.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
READ = 1 << 20
#: Payloads below this many bytes are never replaced by a revisit.
LEAST_REVISIT = 100
#: Records of one archive file; with web pages of usual size about 100 MB.
FILE_RECORDS = 20_000
INDEX = "page_id long, file string, start long, length long, record_type string"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, payload_bytes and refers_to.

    Among equal payloads of at least `least` bytes the smallest page_id is
    stored; the others refer to it. Digests are counted before anything is
    joined, and only digests seen twice or more take part in the join, of which
    Spark splits the large partitions.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.sha2(html, 256).alias("digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
    )
    firsts = (
        rows.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("copied"), "first")
    )
    hit = F.when(F.col("payload_bytes") >= least, F.col("digest"))
    out = rows.join(firsts, hit == F.col("copied"), "left")
    later = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return out.select("page_id", "url", "html", "digest", "payload_bytes", later.alias("refers_to"))


def _record() -> Column:
    """One WARC record as text, without its last line end."""
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z{CRLF}Content-Type: application/http; msgtype=response{CRLF}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url, F.lit(CRLF))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "),
                name(F.col("refers_to")),
            ),
        ).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF * 2),
        block,
        F.lit(CRLF),
    )


def write_archives(pages: DataFrame, folder: str) -> None:
    """Every page as a record, in files that are one gzip stream each."""
    rows = with_revisits(pages)
    (
        rows.select(_record().alias("value"))
        .write.option("compression", "gzip")
        .option("lineSep", CRLF)
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(folder)
    )


def _open(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system, where


class _Stream:
    """Bytes of a gzip file of one or more members, a bounded piece at a time."""

    def __init__(self, source):
        self.source, self.box, self.between, self.held = source, zlib.decompressobj(31), True, bytearray()

    def _more(self) -> bool:
        """Inflate one more piece; False at the end of the file."""
        rest = self.box.unconsumed_tail
        if self.box.eof:
            rest, self.box = self.box.unused_data, zlib.decompressobj(31)
        raw = rest or self.source.read(READ)
        if not raw:
            if not self.between:
                raise ValueError("gzip stream ends early")
            return False
        self.held += self.box.decompress(raw, 4 * READ)
        self.between = self.box.eof
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and with `mark`; what is left if the file ends first."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                at = len(self.held) - len(mark)
                break
        return self._cut(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("record ends early")
        return self._cut(n)

    def _cut(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(source) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, header bytes, block) of every record of an open gzip file."""
    stream = _Stream(source)
    while head := stream.until(b"\r\n\r\n"):
        if not head.startswith(b"WARC/") or not head.endswith(b"\r\n\r\n"):
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        lines = head.decode("utf-8").split(CRLF)[1:-2]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("record isn't closed by two line ends")
        yield headers, head, block


def _page(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return None if text in ("", "null") else int(text)


def normalise(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Rewrite the archives of `folder` record by record into `out`.

    Returns the index, which also lies beside each file as `<name>.idx`: page_id,
    file, start, length, record_type. Any gzip WARC is accepted, of one member or many.
    """
    from lendwell.llm.common import settle

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    # Names only are dealt out: a task for every file.
    names = files.repartition(max(1, files.count()), "path")

    def rewrite(batches):
        for batch in batches:
            for path in batch["path"]:
                system, where = _open(path)
                target, top = _open(out)
                target.create_dir(top, recursive=True)
                name = where.rsplit("/", 1)[-1].split(".")[0] + ".warc.gz"
                draft = f"{top}/.{name}.{uuid.uuid4().hex}"
                rows, at = [], 0
                with system.open_input_stream(where, compression=None, buffer_size=READ) as source:
                    with target.open_output_stream(draft, compression=None) as sink:
                        for headers, head, block in records(source):
                            box = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = box.compress(head) + box.compress(block) + box.compress(b"\r\n\r\n") + box.flush()
                            sink.write(member)
                            rows.append((_page(headers["warc-record-id"]), f"{out}/{name}", at, len(member), headers["warc-type"]))
                            at += len(member)
                index = pd.DataFrame(rows, columns=["page_id", "file", "start", "length", "record_type"])
                index["page_id"] = index["page_id"].astype("Int64")
                with target.open_output_stream(f"{draft}.idx", compression=None) as sink:
                    sink.write(index.to_csv(index=False, sep="\t").encode())
                target.move(f"{draft}.idx", f"{top}/{name}.idx")
                target.move(draft, f"{top}/{name}")
                yield index

    return settle(names.mapInPandas(rewrite, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """The records that `index` names, each fetched by its own offset.

    Rows of the index are dealt by file and read in order of their offset. The
    digest and length of a response are computed from the payload read; those of
    a revisit, whose payload lies elsewhere, come from its headers.
    """

    def fetch(batches):
        handle, name = None, None
        for batch in batches:
            rows = []
            for file, start, length in zip(batch["file"], batch["start"], batch["length"], strict=True):
                if file != name:
                    if handle:
                        handle.close()
                    system, where = _open(file)
                    handle, name = system.open_input_file(where), file
                handle.seek(start)
                head, block = zlib.decompress(handle.read(length), 31).split(b"\r\n\r\n", 1)
                headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split(CRLF)[1:])}
                http, payload = block[: int(headers["content-length"])].split(b"\r\n\r\n", 1)
                if headers["warc-type"] == "response":
                    size, digest, refers = len(payload), hashlib.sha256(payload).hexdigest(), None
                else:
                    size = int(http.decode("latin-1").rsplit(":", 1)[-1])
                    digest, refers = headers["warc-payload-digest"].partition(":")[2], _page(headers.get("warc-refers-to"))
                    payload = None
                rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], refers, size, digest, payload))
                if sum(r[4] for r in rows if r[6]) > 8 * READ:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)
        if handle:
            handle.close()

    files = index.select("file").distinct().count()
    return index.repartition(max(1, files), "file").sortWithinPartitions("file", "start").mapInPandas(fetch, RECORD)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` as archives, normalise them and read every record back.

    Null html: an empty payload. Null url: no target header; control characters
    in one are escaped. Null page_id: always a response, never referred to.
    Repeated rows: a record each; rows of one page_id refer to no other row of
    it and are stored twice. Empty table: empty result. Further columns are
    ignored.
    """
    from lendwell.session import scratch_path

    spark = pages.sparkSession
    whole, single = scratch_path(spark, "warc-whole"), scratch_path(spark, "warc")
    write_archives(pages, whole)
    return read_records(normalise(spark, whole, single))


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
