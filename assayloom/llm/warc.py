"""WARC archives with identical-payload revisits, and a capture index merged from sorted runs.

Each task writes one archive after the other (a gzip member per record) and the captures of each as a
run sorted by URL key and time. Runs meet in range partitions of the index, of a bounded number of
captures each; there a loser tree merges the partition's slices of the runs, which stay in Arrow's form
but for the few rows at their heads. That gives capture histories in one global order. Archives are
read back through that index.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import batches, fresh_path, lean_batches, stored, utf8
from assayloom.llm.files import open_fs, write_whole

RUN = "run string, urlkey string, ts string, page_id long, offset long, length long"
_EPOCH = datetime(2020, 1, 1, tzinfo=UTC)


def url_key(url: str | None) -> str:
    """The URL with its host's labels turned round, without scheme, ``www`` and fragment, in lower case."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return f"unparsed){url.lower()}"
    labels = host.split(".")
    labels = labels[1:] if len(labels) > 2 and labels[0] == "www" else labels
    return f"{','.join(reversed(labels))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    text = (record or "")[len("<urn:page:") : -1]
    return int(text) if text not in ("", "none") else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, when: datetime, level: int = 6) -> bytes:
    """One gzip member: a response record with its HTTP block, or a revisit record without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {when.strftime('%Y-%m-%dT%H:%M:%SZ')}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Identified-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by name in lower case, and the payload (what follows the HTTP head)."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class LoserTree:
    """Merges sorted iterators with one comparison a level for each row; ties go to the earlier iterator."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        self.k = len(sources)
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1 and building:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.heads[i]
            self.heads[i] = next(self.sources[i], None)
            self._replay(i)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of ``least_bytes`` or more, the smallest page_id is referred to.

    Groups are by SHA-1; the smallest id comes from partial aggregation, and a huge group's rows stay spread.
    """
    p = utf8(F.coalesce(F.col("html"), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), p.alias("payload")).withColumn("sha", F.sha1("payload"))
    first = rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least_bytes)).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("sha", "first")
    out = rows.join(first, "sha", "left")
    refers = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    return out.select("page_id", "url", "payload", F.when(F.octet_length("payload") >= least_bytes, refers).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = 32_000_000, level: int = 4) -> DataFrame:
    """Write the archives; return their captures (run, urlkey, ts, page_id, offset, length), each run sorted, stored.

    A record's date is 2020-01-01 and page_id seconds: a capture time for pages that have none.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, out, captures = TaskContext.get().partitionId(), 0, bytearray(), []

        def close() -> pa.RecordBatch:
            nonlocal files, out, captures
            path = f"{folder}/part-{part:06d}-{files:04d}.warc.gz"
            write_whole(path, bytes(out))
            captures.sort(key=lambda c: (c[0], c[1], -1 if c[2] is None else c[2]))
            keys, ts, ids, at, size = zip(*captures, strict=True)
            files, out, captures = files + 1, bytearray(), []
            return pa.RecordBatch.from_arrays([pa.array([path] * len(keys)), pa.array(keys), pa.array(ts), pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=["run", "urlkey", "ts", "page_id", "offset", "length"])

        for batch in batches(it, 200):
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                when = _EPOCH + timedelta(seconds=max(0, page_id or 0) % (1 << 31))
                record = make_record(page_id, url, payload, refers_to, when, level)
                captures.append((url_key(url), when.strftime("%Y%m%d%H%M%S"), page_id, len(out), len(record)))
                out += record
                if len(out) >= file_bytes:
                    yield close()
        if captures:
            yield close()

    lean_batches(pages.sparkSession)
    return stored(with_revisits(pages, least_bytes).mapInArrow(run, RUN), "captures")


def slices_of(it: Iterator[pa.RecordBatch]) -> list[list[pa.RecordBatch]]:
    """The rows of each run, as pieces of the batches they came in; batches are sorted by run, their first column."""
    slices: list[list[pa.RecordBatch]] = []
    last = None
    for batch in it:
        names = batch.column(0).dictionary_encode()
        code = np.asarray(names.indices)
        edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            name = names.dictionary[int(code[a])].as_py()
            if name != last:
                slices.append([])
                last = name
            slices[-1].append(batch.slice(a, b - a))
    return slices


def rows_of(pieces: list[pa.RecordBatch], ahead: int = 64) -> Iterator[tuple]:
    """A run's rows as (urlkey, ts, page, run, offset, length), ``ahead`` of them at a time."""
    for piece in pieces:
        for at in range(0, piece.num_rows, ahead):
            name, keys, ts, ids, offset, size = (c.to_pylist() for c in piece.slice(at, ahead).columns)
            yield from zip(keys, ts, [(i is not None, i or 0) for i in ids], name, offset, size, strict=True)


def merge_index(captures: DataFrame, part_rows: int = 200_000) -> DataFrame:
    """(part, row, run, urlkey, ts, page_id, offset, length): all captures in global order of (part, row).

    Parts are ranges of URL key, time, page and run, of about ``part_rows`` captures, so one key's captures can
    spread over several; each task merges its slices of the runs by a loser tree.
    """
    n_parts = max(1, -(-captures.count() // part_rows))
    cut = captures.repartitionByRange(n_parts, "urlkey", "ts", "page_id", "run").sortWithinPartitions("run", "urlkey", "ts", "page_id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        slices = [rows_of(pieces) for pieces in slices_of(it)]
        held, n = [], 0

        def batch() -> pa.RecordBatch:
            keys, ts, ids, name, at, size = zip(*held, strict=True)
            columns = [pa.array([part] * len(keys), pa.int64()), pa.array(range(n - len(keys), n), pa.int64()), pa.array(name), pa.array(keys), pa.array(ts), pa.array([i if some else None for some, i in ids], pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "row", "run", "urlkey", "ts", "page_id", "offset", "length"])

        for row in LoserTree(slices):
            held.append(row)
            n += 1
            if len(held) >= 5000:
                yield batch()
                held.clear()
        if held:
            yield batch()

    return cut.mapInArrow(run, "part long, row long, " + RUN)


def read_archives(index: DataFrame, most_tasks: int = 20_000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, ts, part, row) of every capture, from the archives.

    Captures go to tasks by archive, as many tasks as archives up to ``most_tasks``, and are read in the order of
    their places. A response's length and digest come from its payload, which must match the header; a
    revisit's from its header.
    """
    archives = index.select("run").distinct().count()
    rows = index.select("run", "offset", "length", "urlkey", "ts", "part", "row").repartition(max(1, min(archives, most_tasks)), "run").sortWithinPartitions("run", "offset")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches(it, 500):
            ids, sizes, digests, kinds, refers = [], [], [], [], []
            for path, at, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != name:
                    if f is not None:
                        f.close()
                    fs, inner = open_fs(path)
                    name, f = path, fs.open_input_file(inner)
                fields, payload = parse_record(f.read_at(size, at))
                kind = fields["warc-type"]
                digest, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-identified-payload-length"])
                if kind == "response" and (digest_of(payload), len(payload)) != (digest, n):
                    raise ValueError(f"{path} at {at}: the payload is not what its header says")
                ids.append(page_of(fields["warc-record-id"]))
                sizes.append(n)
                digests.append(digest)
                kinds.append(kind)
                refers.append(page_of(fields.get("warc-refers-to")))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(refers, pa.int64()), *(batch.column(i) for i in range(3, 7))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "part", "row"])
        if f is not None:
            f.close()

    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, ts string, part long, row long")


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) in the shared folder, merge their index, read them back.

    Null html is an empty payload; a null or odd URL is kept as it is. Rows with a null page_id are
    responses and come back with a null page_id. Rows that repeat the smallest page_id of a payload are
    responses too. Other columns are ignored.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return read_archives(stored(merge_index(write_archives(pages, folder, least_bytes)), "capture-index"))
