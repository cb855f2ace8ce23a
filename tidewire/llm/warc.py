"""Web archives: records written with an index, and read back by byte ranges.

A task writes its rows to archive files of bounded size and returns an index row per
record: file, offset, length, URL and digest. The index is written last and is what makes a
record exist; a file that a lost task leaves behind is named by no index row. Readers
sort the index, cut it into ranges of files, and fetch neighbouring records with one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut, join_small, partitions, shared_dir

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
#: A fixed capture time: the pages carry none, and archives of equal pages are then equal.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(file: str, offset: int) -> str:
    """No two records stand at one place, whatever their rows have in common."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file} {offset}')}>"


def safe_url(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(name: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One record as a gzip member of its own. A revisit, which names the response's URL, has the HTTP header but not the payload."""
    revisit = refers_url is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe_url(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {safe_url(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> dict:
    """The fields of one gzip member: record headers, payload length and payload (None for a revisit)."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    return {"fields": fields, "payload_bytes": declared, "payload": None if fields["WARC-Type"] == "revisit" else payload}


def choose(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, html, refers_to, refers_url): which rows repeat the payload of a smaller page_id; null for the others.

    Only digests are shuffled to find them. The repeated digests are joined back by broadcast
    if their table proves small.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.unhex(F.sha1(html)).alias("sha"))
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), F.col("page_id").alias("page_id"), F.col("url").alias("url"))
    repeated = cut(sized.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1").select("sha", "best"))
    joined = join_small(sized, repeated, "sha", "left", row_bytes=200)
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best.page_id")) & (F.octet_length("html") >= least)
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("best.page_id")).alias("refers_to"), F.when(revisit, F.col("best.url")).alias("refers_url"))


def write_archive(pages: DataFrame, folder: str, least: int = 0, segment_mb: int = 64) -> DataFrame:
    """Archives of ``pages`` under ``folder``, a URI that all executors reach; returns the index as a written table.

    Null html is an empty payload and a null url an empty one. Of equal payloads of at least
    ``least`` bytes the row with the smallest page_id is a response and the others revisit it;
    rows that share that page_id are responses too, and a null page_id comes last.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at, rows = None, "", 0, []

        def finish() -> pd.DataFrame:
            nonlocal out, rows
            out.close()
            done, out, rows = rows, None, []
            return pd.DataFrame(done, columns=[x.split()[0] for x in INDEX.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

        for frame in frames:
            for page_id, url, html, refers_to, refers_url in zip(*(frame[c].astype("object").where(frame[c].notna(), None) for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                page_id, refers_to = (None if x is None else int(x) for x in (page_id, refers_to))
                payload = html.encode()
                raw = record(record_id(name, at), page_id, url, payload, refers_to, refers_url)
                out.write(raw)
                rows.append((name, at, len(raw), url, base32_sha1(payload), page_id, "response" if refers_url is None else "revisit", refers_to))
                at += len(raw)
                if at >= segment_mb * 1_000_000:
                    yield finish()
        if out is not None:
            yield finish()

    return cut(choose(pages, least).mapInPandas(write, INDEX))


def read_records(index: DataFrame, folder: str, gap: int = 65_536, most: int = 8_000_000) -> DataFrame:
    """The records that ``index`` selects, read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Ranges of one file that are at most ``gap`` bytes apart become one read of up to ``most``
    bytes. The digest of a response is computed from what was read and must equal the index.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)

        def fetched(group: list) -> list[tuple]:
            begin, end = group[0].offset, group[-1].offset + group[-1].length
            with store.open_input_file(f"{root}/{group[0].file}") as f:
                raw = f.read_at(end - begin, begin)
            rows = []
            for x in group:
                got = parse(raw[x.offset - begin : x.offset - begin + x.length])
                digest = got["fields"]["WARC-Payload-Digest"].removeprefix("sha1:")
                if got["payload"] is not None and (base32_sha1(got["payload"]) != digest or len(got["payload"]) != got["payload_bytes"]) or digest != x.digest:
                    raise ValueError(f"{x.file} at {x.offset}: the payload does not have its digest")
                page, refers = (got["fields"].get(k) for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
                rows.append((page and int(page), got["payload_bytes"], digest, got["fields"]["WARC-Type"], int(refers) if refers and refers != "None" else None, x.url, got["payload"]))
            return rows

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        for frame in frames:
            group: list = []
            for x in frame.itertuples():
                if group and (x.file != group[0].file or x.offset - group[-1].offset - group[-1].length > gap or x.offset + x.length - group[0].offset > most):
                    yield pd.DataFrame(fetched(group), columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                    group = []
                group.append(x)
            if group:
                yield pd.DataFrame(fetched(group), columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = index.repartitionByRange(partitions(index), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every row of ``pages``, written and read back.

    See write_archive for nulls, ties and repeated rows. An empty table gives no rows. Other
    columns are ignored.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_records(write_archive(pages, folder, least), folder).drop("payload")
