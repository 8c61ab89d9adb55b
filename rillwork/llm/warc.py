"""WARC archives of pages, and a two-level index of their captures.

Records are written by the tasks that hold the pages, each as a gzip member of
its own, so that a range read gives one record.  Equal payloads of at least
``LEAST`` bytes are stored once: the smallest page_id is the response, the
others revisit it.  The index is sorted by reversed-host URL keys; each shard of
it has compressed blocks of lines and, at its end, a sparse directory of the
blocks' first keys.  A lookup finds the shard, then the block, by binary search,
and reads the ranges of the directory, of the block and of the records.

Files lie below a folder that all executors share.  A task names its files
after its attempt, and only the rows of attempts that succeed name them, so a
repeated task leaves an unused file and no double rows.

Defined cases: a null html is an empty payload; of rows with equal page_id and
payload one is the response and the others revisit it; null page_ids come
last, and where all are null, refers_to is null too; a null url is looked up
as an empty one; an empty table gives an empty result; a url or payload may be
of any length; control characters in a url come back percent-encoded; other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Smaller payloads are stored as often as they occur.
LEAST = 100
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Lines of an index block.
BLOCK_LINES = 3000
#: Shards of an index at most, so that their bounds fit in each task.
SHARDS = 4096
#: Ranges this close are read at once, up to so many bytes.
GAP_BYTES, READ_BYTES = 1 << 16, 8 << 20

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_key(url: Column) -> Column:
    """The host's parts in reverse and in lower case, ``)``, then path and query; no scheme, user, default port or fragment.

    ``https://www.Example.com:443/a?b#c`` gives ``com,example,www)/a?b``.  What has no host is its own key.
    """
    whole = F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)#.*$", "")
    pattern = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?(.*)$"
    part = lambda k: F.regexp_extract(whole, pattern, k)
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.when(part(3).startswith("/"), part(3)).otherwise(F.concat(F.lit("/"), part(3)))
    return F.when(part(1) == "", whole).otherwise(F.concat(F.array_join(F.reverse(F.split(F.lower(part(1)), r"\.")), ","), port, F.lit(")"), path))


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, copy, first, revisit): ``first`` is the page_id that a revisit refers to.

    Digests are counted without the payloads; only repeated ones meet the pages.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    same = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest").alias("same")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"))
    large = rows.filter(F.octet_length(payload) >= LEAST).select("page_id", "digest")
    repeated = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    flags = large.distinct().join(repeated, "digest").select(same, "first", F.lit(True).alias("repeats"))
    # the join uses the window's partitioning
    rows = rows.select("*", same).withColumn("copy", F.row_number().over(Window.partitionBy("same").orderBy("url")))
    response = F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    return rows.join(flags, "same", "left").select("page_id", "url", "html", "digest", "copy", "first", (F.coalesce("repeats", F.lit(False)) & ~response).alias("revisit"))


def _store(uri: str):
    """(file system, path) of a folder or file that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


class _Writer:
    """Files of one task's attempt, one after the other."""

    def __init__(self, folder: str, suffix: str):
        self.fs, self.path = _store(folder)
        self.fs.create_dir(self.path, recursive=True)
        task = TaskContext.get()
        self.stem, self.suffix, self.k, self.out = f"{task.partitionId():06d}-{task.taskAttemptId()}", suffix, 0, None

    def put(self, data: bytes, most: int = ARCHIVE_BYTES, head: bytes = b"") -> tuple[str, int]:
        """The file and offset at which the bytes were written."""
        if self.out is None or self.at >= most:
            self.close()
            self.name = f"{self.stem}-{self.k:04d}{self.suffix}"
            self.out, self.k, self.at = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), self.k + 1, len(head)
            self.out.write(head)
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _member(*parts: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([*map(z.compress, parts), z.flush()])


def _head(fields: dict[str, str | None]) -> bytes:
    said = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{said}\r\n".encode()


def _record_id(page: str | None, digest: str, copy: int) -> str:
    return f"<urn:page:{quote(page, safe='')}:{digest}:{copy}>" if page is not None else f"<urn:row:{digest}:{copy}>"


def _page_of(record_id: str) -> str | None:
    kind, _, rest = record_id[5:-1].partition(":")
    return unquote(rest.split(":")[0]) if kind == "page" else None


def record(page: str | None, url: str | None, payload: bytes, digest: str, copy: int, first: str | None, revisit: bool, date: str) -> bytes:
    """A response, or a revisit that has the same HTTP head and no payload, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page, digest, copy),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _CONTROL.sub(lambda c: quote(c[0]), url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": _PROFILE if revisit else None,
        "WARC-Refers-To": _record_id(first, digest, 1) if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(http) + (0 if revisit else len(payload))),
    }
    return _member(_head(fields), http, b"" if revisit else payload, _END)


_ENTRY = "key string, file string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(key, file, offset, length) of each page's record; to be materialised once, since it writes the archives below the folder."""
    info = _member(_head({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:info>", "WARC-Date": date, "Content-Type": "application/warc-fields", "Content-Length": "20"}), b"format: WARC/1.1    ", _END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = _Writer(folder, ".warc.gz")
        for batch in batches:
            rows = []
            for key, page, url, html, digest, copy, first, revisit in zip(*batch.columns, strict=True):
                data = record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), copy.as_py(), first.as_py(), revisit.as_py(), date)
                rows.append((key.as_py(), *to.put(data, ARCHIVE_BYTES, info), len(data)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "file", "offset", "length"])
        to.close()

    text = lambda c: F.col(c).cast("string").alias(c)
    plan = planned(pages).select(capture_key(F.col("url")).alias("key"), text("page_id"), "url", "html", "digest", "copy", text("first"), "revisit")
    return plan.mapInArrow(run, _ENTRY)


def write_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(file, first, last, at, length) of each shard; to be materialised once, since it writes the shards below the folder.

    Entries are dealt out by range of key and place, so a key that a third of the entries have covers many shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, lines, directory, last, name = _Writer(folder, ".idx"), [], [], "", ""

        def block() -> str:
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode())
            name, at = to.put(data, 1 << 62)
            directory.append((lines[0][0], at, len(data)))
            lines.clear()
            return name

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(row)
                last = row[0]
                if len(lines) == block_lines:
                    name = block()
        if lines:
            name = block()
        if directory:
            data = zlib.compress(json.dumps(directory).encode())
            _, at = to.put(data, 1 << 62)
            to.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, directory[0][0], last, at, len(data))], ["file", "first", "last", "at", "length"])

    parts = min(SHARDS, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ("key", "file", "offset")
    return entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "file string, first string, last string, at long, length long")


def _range(opened: dict, folder: str, name: str, at: int, length: int) -> bytes:
    """A range of a file; only the file read last stays open."""
    if name not in opened:
        for f in opened.values():
            f.close()
        opened.clear()
        fs, path = _store(folder)
        opened[name] = fs.open_input_file(f"{path}/{name}")
    opened[name].seek(at)
    return opened[name].read(length)


def look_up(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """(key, file, offset, length) of all captures of the distinct keys in column ``key``.

    There are at most ``SHARDS`` shards, so their bounds go to all tasks; a key that covers several is searched in each.
    """
    known = sorted(map(tuple, shards.collect()), key=lambda s: (s[1], s[2]))
    firsts, lasts = [s[1] for s in known], [s[2] for s in known]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(n, k) for k in batch.column(0).to_pylist() for n in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.string())], ["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, shard, held, lines = {}, None, None, []
        for batch in batches:
            found = []
            for n, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, _, _, at, length = known[n]
                if n != shard:
                    directory = json.loads(zlib.decompress(_range(opened, folder, file, at, length)))
                    heads, shard, held = [d[0] for d in directory], n, None
                # the last block that begins before the key may end with it
                for k in range(max(bisect_left(heads, key) - 1, 0), bisect_right(heads, key)):
                    if k != held:
                        lines = [json.loads(x) for x in zlib.decompress(_range(opened, folder, file, *directory[k][1:])).split(b"\n")]
                        held, names = k, [x[0] for x in lines]
                    found += lines[bisect_left(names, key) : bisect_right(names, key)]
                    if len(found) >= 10_000:
                        yield entry_batch(found)
                        found = []
            yield entry_batch(found)

    def entry_batch(found: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], ["key", "file", "offset", "length"])

    routed = keys.select(F.coalesce("key", F.lit("")).alias("key")).distinct().mapInArrow(route, "shard int, key string")
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return routed.repartition(parts, "shard").sortWithinPartitions("shard", "key").mapInArrow(search, _ENTRY)


def parsed(member: bytes) -> tuple[str, str | None, str | None, int, str, str | None, bytes]:
    """(type, page, url, payload bytes, digest, page referred to, payload) of a record; a damaged one raises."""
    head, _, rest = zlib.decompress(member, 31).partition(_END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != _END:
        raise ValueError(f"record {fields['WARC-Record-ID']} has another length than it says")
    http, _, payload = block.partition(_END)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} has another payload than it says")
    url, refers = fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To")
    return fields["WARC-Type"], _page_of(fields["WARC-Record-ID"]), url, size, digest, refers and _page_of(refers), payload


def read_records(entries: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """(record_type, page_id, url, payload_bytes, payload_digest, refers_to[, payload]) of the records at the entries' places; ids are strings.

    An archive's entries are read in order by one task, near ranges at once.  Lengths and digests are checked.
    """
    names = ["record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if payloads else [])]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        near: list[tuple[str, int, int]] = []
        for batch in batches:
            for file, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if near and (file != near[0][0] or at - sum(near[-1][1:]) > GAP_BYTES or at + length - near[0][1] > READ_BYTES):
                    yield near
                    near = []
                near.append((file, at, length))
        if near:
            yield near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for near in ranges(batches):
            file, begin, _ = near[0]
            data = _range(opened, folder, file, begin, sum(near[-1][1:]) - begin)
            rows = [parsed(data[at - begin : at - begin + length]) for _, at, length in near]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    # an entry is small beside the record it stands for, so the number of tasks doesn't follow the entries' bytes
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = entries.select("file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n == 'payload' else 'string'}" for n in names))


def archive_and_read(pages: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, read back from the archives.

    The pages' keys are looked up in the index, and the records read at the places it gives.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    archives, index = f"{scratch.root}/archives", f"{scratch.root}/index"
    entries = scratch.put("entries", write_archives(pages, archives))
    shards = scratch.put("shards", write_index(entries, index, block_lines))
    scratch.drop("entries")
    places = look_up(pages.select(capture_key(F.col("url")).alias("key")), shards, index)
    kind = pages.schema["page_id"].dataType
    id_ = lambda c: F.col(c).cast(kind).alias(c)
    return read_records(places, archives, payloads=False).select(id_("page_id"), "payload_bytes", "payload_digest", "record_type", id_("refers_to"))
