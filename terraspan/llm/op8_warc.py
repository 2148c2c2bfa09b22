"""Operator 8: WARC archives, written by Spark and read by a Python data source.

Writing: a record per page is one string (header block, empty line, payload), so Spark's
text writer with the record terminator as line separator writes valid WARC 1.1 files to any
store that Spark writes to. Of records with equal payloads of at least ``LEAST`` bytes, the
one with the largest page_id is a response and the others are revisit records without a
payload that name it. The group's response comes from a partial aggregate over (digest,
size), joined back on the digest. Payloads that occur once are out of that join's right side,
which is broadcast if its counted rows allow it, so pages aren't shuffled; else AQE splits
the join where one payload is hot.

Reading: the data source ``warc`` plans partitions of whole files, accepts equality and
``In`` predicates on ``record_type`` and equality on the header columns ``page_id``,
``target_uri`` and ``payload_digest``, parses the header block first, and steps over the
payload of a record that fails them, by seeking if it isn't in the piece at hand. Without the
column ``payload`` in the ``columns`` option no payload is decoded at all. Files are opened
through Arrow's file systems, a local or a remote path alike, and read in pieces: memory
holds one record. A file, which is one reading task, has about FILE_BYTES of payload.

Defined cases: a null html is an empty payload; ``page_id`` null is written without the
header and never is what others refer to unless all are null; rows equal in page_id and
payload stay as they are, all of them responses if theirs is the largest id; a url that is
null or has line breaks is written without them; an empty table gives no rows.
"""

from __future__ import annotations


from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .common import materialize, maybe_broadcast, scratch_path, table, text_or_empty

LEAST = 1000
END = "\r\n\r\n"
SCHEMA = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload string"
#: Bytes that the reader asks for at once, and of payload for a file, by the mean size of pages.
PIECE, FILE_BYTES = 1 << 20, 128 << 20


def _header(lines: dict[str, Column]) -> Column:
    """The header block: named fields whose value isn't null."""
    given = [F.when(v.isNotNull(), F.concat(F.lit(f"{n}: "), v.cast("string"))) for n, v in lines.items()]
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *given), F.lit(END))


def records(pages: DataFrame) -> DataFrame:
    """``value``: one WARC record a page, without the terminator."""
    html, page = text_or_empty("html"), F.col("page_id").cast("long")
    base = pages.select(page.alias("page_id"), F.regexp_replace(F.col("url").cast("string"), r"[\r\n]+", "").alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    largest = base.filter(F.col("size") >= LEAST).groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("_n"))
    largest = materialize(largest.filter("_n > 1").select("digest", "size", "response"))
    linked = base.join(maybe_broadcast(largest), ["digest", "size"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    kind = F.when(revisit, "revisit").otherwise("response")
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = _header({
        "WARC-Type": kind, "WARC-Record-ID": F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">"))), "WARC-Date": F.lit("1970-01-01T00:00:00Z"),
        "WARC-Target-URI": F.col("url"), "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")), "X-Payload-Length": F.col("size"),
        "WARC-Refers-To": F.when(revisit, urn(F.col("response"))),
        "WARC-Profile": F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        "Content-Type": F.lit("text/html; charset=utf-8"), "Content-Length": F.octet_length(block),
    })
    return linked.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """WARC files of about FILE_BYTES at most under ``path``."""
    rows, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_or_empty("html")).cast("long"))).first()
    records(pages).write.option("lineSep", END).option("maxRecordsPerFile", max(1, rows * FILE_BYTES // max(1, size or 0))).text(path)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(path: str) -> tuple:
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WarcReader(DataSourceReader):
    """One partition a file; header predicates are applied before a payload is touched."""

    FIELDS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "page_id": "warc-record-id"}

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.wanted = path, columns, {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in self.FIELDS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self):
        import pyarrow.fs as fs

        where, root = _files(self.path)
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        found = where.get_file_info(fs.FileSelector(root, recursive=True))
        names = [x.path for x in found if x.is_file and x.size and not x.base_name.startswith(("_", "."))]
        return [_File(prefix + n) for n in sorted(names)] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        where, name = _files(partition.path)
        with where.open_input_file(name) as file:
            size, at = file.size(), 0
            piece, base = b"", 0  # a piece of the file and where it begins
            while at < size:
                end, want = piece.find(b"\r\n\r\n", at - base) if base <= at else -1, PIECE
                while end < 0:
                    file.seek(at)
                    piece, base = file.read(want), at
                    end, want = piece.find(b"\r\n\r\n"), want * 2
                    if end < 0 and at + len(piece) >= size:
                        if piece.strip():
                            raise ValueError(f"a record is cut off in {name}")
                        return
                head = self._parse(piece[at - base : end])
                body = base + end + 4
                at = body + int(head["content-length"])
                if at > size:
                    raise ValueError(f"a payload is cut off in {name}")
                row = self._row(head)
                if row is not None:
                    row["payload"] = None
                    if "payload" in self.columns:
                        if at <= base + len(piece):
                            block = piece[body - base : at - base]
                        else:
                            file.seek(body)
                            block = file.read(at - body)
                        row["payload"] = block.decode("utf-8", "surrogatepass")
                    yield tuple(row[c] for c in self.columns)
                at += len(END)  # the terminator follows the block

    @staticmethod
    def _parse(block: bytes) -> dict[str, str]:
        first, *lines = block.decode("utf-8", "surrogatepass").split("\r\n")
        if not first.lstrip().startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}

    @staticmethod
    def _page(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None

    def _row(self, head: dict[str, str]) -> dict | None:
        row = {
            "page_id": self._page(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"),
            "payload_digest": head.get("warc-payload-digest", "").partition(":")[2], "payload_bytes": int(head.get("x-payload-length", head["content-length"])),
            "refers_to": self._page(head.get("warc-refers-to")),
        }
        return row if all(row[c] in values for c, values in self.wanted.items()) else None


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``columns``: a comma-separated subset of the schema."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _columns(self) -> list[str]:
        all_ = [c.split()[0] for c in SCHEMA.split(", ")]
        return [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else all_

    def schema(self) -> str:
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self._columns())


def read(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """The records under ``path``; predicates on header columns are pushed into the source."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    return (reader.option("columns", columns) if columns else reader).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back: responses are measured anew, revisits tell what they stand for."""
    path = scratch_path(spark)
    write(table(spark, sf_dir, "pages"), path)
    full = read(spark, path).filter(F.col("record_type") == "response").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1(F.col("payload").cast("binary")).alias("payload_digest"), "record_type", "refers_to")
    names = "page_id,payload_bytes,payload_digest,record_type,refers_to"
    return full.unionByName(read(spark, path, names).filter(F.col("record_type") == "revisit"))


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (SELECT *, CASE WHEN n >= {LEAST} THEN max(page_id) OVER (PARTITION BY digest, n) END AS top FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM g
"""
