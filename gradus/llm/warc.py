"""WARC archives with revisit records, and a two-level capture index to read single records back.

Capture keys (host reversed, then path) are sorted and written as compressed blocks; each index file ends in a sparse
directory with the first key of every block. A look-up finds the file, then the block, then the line by binary search,
and reads just that block and the record's bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import new_path, stage
from .arrow import in_slices, over_batches
from .token_files import open_folder

BLOCK_LINES = 512
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def sort_key(url: str | None) -> str:
    """``http://User@www.Example.org:80/a?b`` -> ``org,example)/a?b``; what is no URL is its own key."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url or "")
    if not found:
        return url or ""
    host = found[1].lower().removeprefix("www.")
    port = f":{found[2]}" if found[2] not in (None, "", "80", "443") else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (found[3] or "/")


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id, url: str | None, payload: bytes, refers_to, refers_url: str | None = None) -> bytes:
    """One compressed record; a revisit carries the headers of the response, not its payload.

    Record ids are unique, also where pages share an id; a revisit therefore names its response by target URI and date.
    ``X-Page-ID`` and ``X-Refers-To-Page`` hold the pages' own ids as JSON, so ids keep their type. All records are dated
    1970, as pages have no date.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": _DATE,
        "X-Page-ID": json.dumps(page_id),
        "WARC-Target-URI": _target(url),
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        **({"WARC-Refers-To-Target-URI": _target(refers_url), "WARC-Refers-To-Date": _DATE, "X-Refers-To-Page": json.dumps(refers_to),
            "WARC-Profile": REVISIT} if revisit else {}),
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode() + block + b"\r\n\r\n") + squeeze.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def find_revisits(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", payload_col: str = "html",
                  url_col: str = "url") -> DataFrame:
    """id, digest, refers_to and refers_url of every page whose payload of at least ``least_bytes`` an earlier page has; stored.

    Payloads meet as digests only. Counting and taking the smallest id are combined before the shuffle, so a payload
    that a third of all pages share costs no more than another.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.sha2(payload, 256).alias("_digest"),
                        F.octet_length(payload).alias("_size")).filter(F.col("_size") >= least_bytes)
    least = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_url"))).alias("_least")
    firsts = stage(rows.groupBy("_digest").agg(least, F.count("*").alias("_n")).filter("_n > 1 and _least is not null").select(
        "_digest", F.col("_least._id").alias("refers_to"), F.col("_least._url").alias("refers_url")), "first-captures")
    later = rows.select("_id", "_digest").join(firsts, "_digest").filter("_id is null or _id > refers_to")
    return stage(later.select("_id", "_digest", "refers_to", "refers_url").distinct(), "revisits")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for every page and return the captures: key, id, file, offset, size (stored).

    Pages that revisit none need not move: the list of revisits is stored and Spark broadcasts it only below its own
    size limit. Files of lost or repeated tasks are in no capture. Null payloads are empty, null URLs have an empty key.
    """
    target = new_path(pages.sparkSession, "warc")
    revisits = find_revisits(pages, id_col=id_col, payload_col=payload_col, url_col=url_col)
    digest = F.sha2(F.coalesce(F.col(payload_col), F.lit("")), 256)
    joined = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"), digest.alias("digest")).join(
        revisits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("id", "url", "payload", "refers_to", "refers_url")

    def run(source) -> Iterator[dict]:
        folder, root = open_folder(target)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in source:
            for part in in_slices(batch, "payload"):
                if out is None:
                    folder.create_dir(root, recursive=True)
                    out = folder.open_output_stream(f"{root}/{name}", compression=None)
                columns = (part.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to", "refers_url"))
                keys, offsets, sizes = [], [], []
                for page_id, url, payload, refers_to, refers_url in zip(*columns, strict=True):
                    data = record(page_id, url, (payload or "").encode(), refers_to, refers_url)
                    out.write(data)
                    keys.append(sort_key(url)), offsets.append(offset), sizes.append(len(data))
                    offset += len(data)
                yield {"key": keys, "id": part.column("id"), "file": [f"{target}/{name}"] * len(keys), "offset": offsets, "size": sizes}
        if out is not None:
            out.close()

    kind = pages.schema[id_col].dataType.simpleString()
    return stage(over_batches(joined, ["id", "url", "payload", "refers_to", "refers_url"], run, f"key string, id {kind}, file string, offset long, size long"), "captures")


def _order(key: str, page_id) -> tuple:
    """Order of captures as Spark sorts them: keys by bytes, ids ascending with null first."""
    return key.encode(), page_id is not None, page_id.encode() if isinstance(page_id, str) else page_id or 0


def write_index(captures: DataFrame) -> DataFrame:
    """Sort the captures into index files and return the top of the directory: part, file, first key and id (stored)."""
    target = new_path(captures.sparkSession, "cdx")
    ordered = captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id")

    def run(source) -> Iterator[dict]:
        from pyspark import TaskContext

        folder, root = open_folder(target)
        name, out, held, directory, offset = f"{uuid.uuid4().hex}.cdx", None, [], [], 0

        def flush(lines: list) -> None:
            nonlocal offset
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode())
            out.write(data)
            directory.append([*lines[0][:2], offset, len(data)])
            offset += len(data)

        for batch in source:
            held += map(list, zip(*(batch.column(c).to_pylist() for c in ("key", "id", "file", "offset", "size")), strict=True))
            if held and out is None:
                folder.create_dir(root, recursive=True)
                out = folder.open_output_stream(f"{root}/{name}", compression=None)
            while len(held) >= BLOCK_LINES:
                flush(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if out is not None:
            if held:
                flush(held)
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            yield {"part": [TaskContext.get().partitionId()], "file": [f"{target}/{name}"],
                   "first_key": [directory[0][0]], "first_id": [directory[0][1]]}

    kind = captures.schema["id"].dataType.simpleString()
    return stage(over_batches(ordered, ["key", "id", "file", "offset", "size"], run, f"part int, file string, first_key string, first_id {kind}"), "index")


class CaptureIndex:
    """One index file: the directory in memory, blocks read when a key falls into them."""

    def __init__(self, file: str):
        folder, path = open_folder(file)
        self.source = folder.open_input_file(path)
        end = self.source.size()
        size = int.from_bytes(self.source.read_at(8, end - 8), "little")
        self.directory = json.loads(zlib.decompress(self.source.read_at(size, end - 8 - size)))
        self.firsts = [_order(d[0], d[1]) for d in self.directory]
        self._block = (-1, [], [])

    def _lines(self, k: int) -> tuple[list, list]:
        if self._block[0] != k:
            data = self.source.read_at(self.directory[k][3], self.directory[k][2])
            lines = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
            self._block = k, lines, [_order(x[0], x[1]) for x in lines]
        return self._block[1:]

    def find(self, key: str, page_id) -> list[tuple[str, int, int]]:
        """File, offset and size of every capture of the key and id."""
        wanted, found = _order(key, page_id), []
        k = max(0, bisect_left(self.firsts, wanted) - 1)  # equal keys may begin in the block before
        while k < len(self.firsts) and self.firsts[k] <= wanted:
            lines, keys = self._lines(k)
            found += [tuple(x[2:]) for x in lines[bisect_left(keys, wanted):bisect_right(keys, wanted)]]
            k += 1
        return found


def look_up(spark: SparkSession, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of all captures of ``wanted`` (key, id): id, payload_bytes, payload_digest, record_type, refers_to.

    The top of the directory has a row for each index file, as many as the index had partitions, and goes to every
    task. Wanted keys are dealt to the files that may hold them; a task reads its keys in order, so each block is read
    once.
    """
    top = sorted(index.collect(), key=lambda r: _order(r.first_key, r.first_id))
    firsts, files = [_order(r.first_key, r.first_id) for r in top], [r.file for r in top]
    kind = wanted.schema["id"].dataType.simpleString()

    def deal(source) -> Iterator[dict]:
        for batch in source:
            keys, ids = batch.column("key"), batch.column("id")
            yield {"key": keys, "id": ids, "part": [max(0, bisect_right(firsts, _order(k, i)) - 1) for k, i in zip(keys.to_pylist(), ids.to_pylist(), strict=True)]}

    def run(source) -> Iterator[dict]:
        @lru_cache(32)
        def archive(file: str):
            folder, path = open_folder(file)
            return folder.open_input_file(path)

        part, opened = None, None
        for batch in source:
            rows = []
            for p, key, page_id in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "id")), strict=True):
                if p != part:
                    part, opened = p, CaptureIndex(files[p])
                for file, offset, size in opened.find(key, page_id):
                    rows.append((page_id, *_told(archive(file).read_at(size, offset))))
            if rows:
                yield dict(zip(("id", "payload_bytes", "payload_digest", "record_type", "refers_to"), map(list, zip(*rows)), strict=True))

    dealt = over_batches(wanted.select("key", "id").distinct(), ["key", "id"], deal, f"key string, id {kind}, part int")
    # a key equal to a file's first key may also close the file before; ranges never part equal keys and ids
    sorted_keys = dealt.repartition(max(1, len(files)), "part").sortWithinPartitions("part", "key", "id")
    return over_batches(sorted_keys, ["part", "key", "id"], run, f"id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")


def _told(data: bytes) -> tuple:
    fields, http, payload = parse(data)
    if fields["WARC-Type"] == "revisit":
        return int(http["Content-Length"]), fields["WARC-Payload-Digest"].partition(":")[2], "revisit", json.loads(fields["X-Refers-To-Page"])
    return len(payload), hashlib.sha256(payload).hexdigest(), "response", None


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write archives and index, then read every page's record back through the index.

    Of pages with equal payloads of at least 100 bytes, those with the smallest id are responses and the others revisit
    it (a page without id revisits; where no such page has an id, all are responses). Repeated rows have a record each.
    Ids are whole numbers or texts. An empty table gives no row. Other columns are not read.
    """
    captures = write_archives(pages, id_col, url_col, payload_col)
    index = write_index(captures)
    return look_up(pages.sparkSession, index, captures).withColumnRenamed("id", id_col)
