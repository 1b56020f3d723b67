"""Operator 13: WARC records in ZIP packages, read by ranges without extraction.

A package is a ZIP whose members ``archive/*.warc`` or ``archive/*.warc.gz`` are stored as they are, so that a record lies
at a fixed place of the file, and ``indexes/*.cdx`` or ``*.cdxj`` say where records are in them. Reading goes in two
steps. A task for each package reads the end of the file, its central directory (with the ZIP64 one if there is one) and
the indexes, and plans ranges of adjacent records. The ranges are dealt out, and each task reads its own bytes only.

Payloads that occur more than once are written once, in a ``response`` record; the others ``revisit`` it. A writing
task returns the names of the files it has finished and only these are read, so what lost or repeated tasks leave behind counts for nothing.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from struct import unpack_from
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.memo import runs, tidy

ARCHIVES, INDEXES = re.compile(r"(^|/)[^/]+\.warc(\.gz)?$", re.I), re.compile(r"(^|/)[^/]+\.cdxj?(\.gz)?$", re.I)
CRLF = b"\r\n"
_URN = "<urn:page"


def _opened(path: str):
    """The file system that ``path`` (a URI, or a place all machines share) is on, and its place there."""
    from pyarrow.fs import FileSystem

    uri = re.sub(r"^file:/+", "file:///", path)
    return FileSystem.from_uri(uri)


# ---- ZIP directories -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    encrypted: bool
    header: int  # where its local header starts
    packed: int  # bytes as stored
    size: int


class Package:
    """A ZIP read by ranges: ``read(start, length)`` gives bytes of a file of ``size``."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size

    def _directory(self) -> tuple[int, int, int, int]:
        """(start, length, entries, shift) of the central directory; ``shift`` is what stands before the archive in the file."""
        begin = max(0, self.size - 22 - 65_535)
        tail = self.read(begin, self.size - begin)
        at = len(tail) - 22
        while at >= 0:  # the end record, whose comment fills the rest of the file
            at = tail.rfind(b"PK\5\6", 0, at + 4)
            if at >= 0 and at + 22 <= len(tail) and at + 22 + unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
            at -= 1
        if at < 0:
            raise ValueError("no end record: not a ZIP archive, or cut short")
        entries, length, start = unpack_from("<HII", tail, at + 10)
        end = begin + at
        locator = self.read(end - 20, 20) if end >= 20 else b""
        if locator[:4] == b"PK\6\7":  # else there is no ZIP64 directory
            told = unpack_from("<Q", locator, 8)[0]
            for place in (told, end - 20 - 56):  # where it is said to be, or right before where something stands before the archive
                record = self.read(place, 56) if 0 <= place <= end - 76 else b""
                if record[:4] == b"PK\6\6":
                    break
            else:
                raise ValueError("no ZIP64 end record where the locator says")
            entries, length, start = unpack_from("<QQQ", record, 32)
            end = place
        elif 0xFFFFFFFF in (length, start):
            raise ValueError("a ZIP64 directory is needed and there is none")
        shift = end - length - start
        if shift < 0:
            raise ValueError("the central directory is outside of the file")
        return start + shift, length, entries, shift

    def members(self, piece: int = 1 << 20) -> Iterator[Member]:
        """The central directory's entries, read in pieces."""
        at, length, entries, shift = self._directory()
        stop, held = at + length, b""
        for _ in range(entries):
            while True:
                need = 46 + sum(unpack_from("<HHH", held, 28)) if len(held) >= 46 else 46
                if len(held) >= need:
                    break
                more = self.read(at, min(max(piece, need), stop - at))
                if not more:
                    raise ValueError("the central directory ends too early")
                at, held = at + len(more), held + more
            if held[:4] != b"PK\1\2":
                raise ValueError("no entry where the central directory should have one")
            flags, method = unpack_from("<HH", held, 8)
            packed, size, name_n, extra_n, _, disk = unpack_from("<IIHHHH", held, 20)
            header = unpack_from("<I", held, 42)[0]
            name, extra = held[46 : 46 + name_n], held[46 + name_n : 46 + name_n + extra_n]
            held = held[need:]
            packed, size, header = self._wide(extra, packed, size, header)
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, bool(flags & 1), header + shift, packed, size)

    @staticmethod
    def _wide(extra: bytes, packed: int, size: int, header: int) -> tuple[int, int, int]:
        """Numbers that do not fit four bytes stand in the ZIP64 field, in this order and only those."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = unpack_from("<HH", extra, at)
            if kind == 1:
                field = at + 4
                out = []
                for short in (size, packed, header):
                    if short == 0xFFFFFFFF:
                        if field + 8 > at + 4 + n:
                            raise ValueError("a ZIP64 field is too short")
                        short, field = unpack_from("<Q", extra, field)[0], field + 8
                    out.append(short)
                return out[1], out[0], out[2]
            at += 4 + n
        if 0xFFFFFFFF in (packed, size, header):
            raise ValueError("a ZIP64 field is needed and there is none")
        return packed, size, header

    def data_start(self, member: Member) -> int:
        """Where a member's bytes start: its local header has a length of its own."""
        head = self.read(member.header, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {member.name}")
        return member.header + 30 + sum(unpack_from("<HH", head, 26))

    def content(self, member: Member) -> bytes:
        """A whole member, stored or deflated: for indexes."""
        raw = self.read(self.data_start(member), member.packed)
        if member.method not in (0, 8) or member.encrypted:
            raise ValueError(f"{member.name} is neither stored nor deflated")
        return raw if member.method == 0 else zlib.decompress(raw, -15)


# ---- records ---------------------------------------------------------------------------------------------------------


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a header block, names in lower case; the first line is no field."""
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", len(block))))
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF + CRLF


def record_id(key: str | None) -> str:
    return f"{_URN}>" if key is None else f"{_URN}:{quote(key, safe='')}>"


def key_of(name: str) -> str | None:
    """The key that :func:`record_id` was made from."""
    return unquote(name[len(_URN) + 1 : -1]) if name.startswith(f"{_URN}:") else None


def _line_safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(key: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str) -> tuple[bytes, str]:
    """(record, digest) of a page; a revisit holds the response's head only. Blanks and control characters of a url are percent-encoded."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.insert(1, ("WARC-Target-URI", _line_safe(url)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    return _record(fields, http if revisit else http + payload), digest


def read_record(raw: bytes) -> dict:
    """What a record says and holds. Its digest and length are worked out from the payload where it has one; a revisit's are as stated."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    head, sep, rest = raw.partition(CRLF + CRLF)
    if not head.startswith(b"WARC/") or not sep:
        raise ValueError("no WARC record where the index says")
    f = _fields(head)
    length = int(f["content-length"])
    block = rest[:length]
    if len(block) < length:
        raise ValueError("a WARC record is cut short")
    stated, kind, payload, declared = f.get("warc-payload-digest", ""), f.get("warc-type", ""), block, None
    if f.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(CRLF + CRLF)
        declared = _fields(http).get("content-length")
    out = {"record_type": kind, "record_id": f.get("warc-record-id", ""), "target_uri": f.get("warc-target-uri"), "refers_to": f.get("warc-refers-to")}
    stated = stated.removeprefix("sha1:")
    if kind == "revisit":
        return out | {"payload_bytes": int(declared or 0), "payload_digest": stated, "intact": None, "payload": None}
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return out | {"payload_bytes": len(payload), "payload_digest": found, "intact": found == stated if stated else None, "payload": payload}


# ---- writing ---------------------------------------------------------------------------------------------------------


class PackageWriter:
    """One package: records go into a stored member as they come, the index into another when it is closed."""

    def __init__(self, path: str, compress: bool, date: str):
        fs, place = _opened(path)
        self.path, self.compress, self.out = path, compress, fs.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.name = "data.warc.gz" if compress else "data.warc"
        self.member = self.zip.open(zipfile.ZipInfo(f"archive/{self.name}"), "w", force_zip64=True)
        self.lines: list[str] = []
        self.at, self.date = 0, date
        self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def _put(self, record: bytes) -> tuple[int, int]:
        if self.compress:
            work = zlib.compressobj(1, zlib.DEFLATED, 31)
            record = work.compress(record) + work.flush()
        self.member.write(record)
        self.at += len(record)
        return self.at - len(record), len(record)

    def add(self, record: bytes, digest: str, url: str | None, kind: str) -> None:
        start, length = self._put(record)
        host, _, path = re.sub(r"^[^:/]*://", "", _line_safe(url or "")).partition("/")
        key, stamp = f"{','.join(reversed(host.lower().split('.')))})/{path}", re.sub(r"\D", "", self.date)
        told = {"url": _line_safe(url or ""), "mime": "warc/revisit" if kind == "revisit" else "text/html", "digest": f"sha1:{digest}", "length": str(length), "offset": str(start), "filename": self.name}
        self.lines.append(f"{key} {stamp} {json.dumps(told)}\n")

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "".join(sorted(self.lines)).encode())
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.at


def mark_copies(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: the largest id among the rows of an equal payload of ``min_bytes`` or more, where it is not the row's own; else null.

    Rows that share the largest id all keep their payload; a row without an id refers to one that has one.
    """
    from pactlens.llm.common import free_name, join_hot, stash

    digest, largest = free_name(pages, "_digest"), free_name(pages, "_largest")
    body = F.coalesce(payload_col, F.lit(""))
    known = pages.withColumn(digest, F.when(F.octet_length(body) >= min_bytes, F.sha2(body, 256)))
    groups = known.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.max(id_col).alias(largest), F.count("*").alias("n")).where("n > 1").drop("n")
    told = join_hot(known, stash(groups, "page-copies"), [digest], "left")
    return told.withColumn("refers_to", F.when(~F.col(largest).eqNullSafe(F.col(id_col)), F.col(largest))).drop(digest, largest)


def write_packages(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, compress: bool = True, package_bytes: int = 256_000_000, date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row, and return (path, records, bytes) of the packages, a table that is written too.

    The payload is the UTF-8 text, null: empty. Equal payloads are told by :func:`mark_copies`. ``compress`` packs each record by
    itself. A task starts another package at ``package_bytes``; one without rows writes none. ``out`` is a folder
    that all machines share. Repeated rows give a record each; columns but the three are not written.
    """
    from pactlens.llm.common import stash

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for at, stop in runs(batch.column(2)):
                part = batch.slice(at, stop - at)
                keys, urls, refers = (part.column(i).to_pylist() for i in (0, 1, 3))
                for key, url, payload, refer in zip(keys, urls, part.column(2), refers, strict=True):
                    if writer is None:
                        writer = PackageWriter(f"{out.rstrip('/')}/{uuid.uuid4().hex}.zip", compress, date)
                    body = payload.as_buffer()
                    record, digest = page_record(key, url, body.to_pybytes() if body is not None else b"", refer, refer is not None, date)
                    writer.add(record, digest, url, "revisit" if refer is not None else "response")
                    if writer.at >= package_bytes:
                        done.append(writer.close())
                        writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    fs, place = _opened(out)
    fs.create_dir(place, recursive=True)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    marked = mark_copies(rows, "id", "payload", min_bytes)
    rows = marked.select(F.col("id").cast("string"), "url", F.coalesce("payload", F.lit("")).alias("payload"), F.col("refers_to").cast("string"))
    return stash(rows.mapInArrow(tidy(work), "path string, records long, bytes long"), "packages")


# ---- reading ---------------------------------------------------------------------------------------------------------


def _hop(read, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of a member without an index, from one to the next; compressed ones have to be unpacked for that."""
    at = 0
    packed = read(start, min(2, size)) == b"\x1f\x8b"
    while at < size:
        if packed:
            work, used = zlib.decompressobj(31), 0
            while not work.eof:
                raw = read(start + at + used, min(1 << 18, size - at - used))
                if not raw:
                    raise ValueError("a compressed record is cut short")
                work.decompress(raw)
                used += len(raw) - len(work.unused_data)
            yield at, used
            at += used
            continue
        head, n = b"", 1 << 13
        while (end := head.find(CRLF + CRLF)) < 0:
            if len(head) >= size - at:
                raise ValueError("a record's head does not end")
            head, n = read(start + at, min(n, size - at)), n * 4
        used = end + 4 + int(_fields(head[:end])["content-length"]) + 4
        yield at, used
        at += used


def places(package: Package) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """(member, where its bytes start, (offset, length) of its records in order) of each archive member. A member that no index names is gone through record by record."""
    members = list(package.members())
    told: dict[str, set[tuple[int, int]]] = {}
    for m in members:
        if INDEXES.search(m.name):
            raw = package.content(m)
            for line in (zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw).decode().splitlines():
                at = line.find("{")
                if at >= 0:
                    entry = json.loads(line[at:])
                    told.setdefault(entry["filename"].rsplit("/", 1)[-1], set()).add((int(entry["offset"]), int(entry["length"])))
    for m in members:
        if not ARCHIVES.search(m.name):
            continue
        if m.method != 0 or m.encrypted:
            raise ValueError(f"{m.name} is not stored as it is, so records cannot be read by ranges")
        start = package.data_start(m)
        found = told.get(m.name.rsplit("/", 1)[-1])
        found = sorted(found) if found is not None else list(_hop(package.read, start, m.size))
        if any(o < 0 or n <= 0 or o + n > m.size for o, n in found):
            raise ValueError(f"an index leads out of {m.name}")
        yield m.name, start, found


def _reader(path: str):
    fs, place = _opened(path)
    file = fs.open_input_file(place)
    size = file.size()
    return (lambda at, n: file.read_at(max(0, min(n, size - at)), at)), size, file


def plan_ranges(packages: DataFrame, path_col: str = "path", run: int = 4_000_000, gap: int = 65_536) -> DataFrame:
    """(path, member, start, length, offsets, lengths): ranges of about ``run`` bytes of adjacent records of the packages, one task's work each; offsets are from the range's start, which is a place in the file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                read, size, file = _reader(path)
                with file:
                    for member, base, records in places(Package(read, size)):
                        at = 0
                        while at < len(records):
                            begin, stop = records[at][0], at
                            end = begin
                            while stop < len(records) and (stop == at or (records[stop][0] <= end + gap and records[stop][0] + records[stop][1] - begin <= run)):
                                end = max(end, sum(records[stop]))
                                stop += 1
                            row = (path, member, base + begin, end - begin, [o - begin for o, _ in records[at:stop]], [n for _, n in records[at:stop]])
                            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["path", "member", "start", "length", "offsets", "lengths"])
                            at = stop

    return packages.select(F.col(path_col).alias("path")).mapInArrow(tidy(work), "path string, member string, start long, length long, offsets array<long>, lengths array<long>")


_RECORD = {"path": pa.string(), "member": pa.string(), "record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "intact": pa.bool_(), "payload": pa.binary()}
_DDL = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}


def read_packages(packages: DataFrame, path_col: str = "path", payload: bool = True, **plan) -> DataFrame:
    """The records of packages, a row each, from a table of their paths.

    ``payload_digest`` (base32 SHA-1) and ``payload_bytes`` are of the payload as read; a revisit has none and tells
    those of the one it refers to. ``intact`` says whether the digest is as stated, null where nothing is stated. A file that is no
    ZIP, an archive member that is not stored, or an index that leads nowhere is an error that names it. No paths give no rows.
    """
    kinds = {k: v for k, v in _RECORD.items() if payload or k != "payload"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read, file = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != held:
                    if file is not None:
                        file.close()
                    read, _, file = _reader(row["path"])
                    held = row["path"]
                raw = memoryview(read(row["start"], row["length"]))
                told = [read_record(bytes(raw[o : o + n])) | {"path": held, "member": row["member"]} for o, n in zip(row["offsets"], row["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kind) for k, kind in kinds.items()], list(kinds))
        if file is not None:
            file.close()

    spark = packages.sparkSession
    ranges = plan_ranges(packages, path_col, **plan).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    return ranges.mapInArrow(tidy(work), ", ".join(f"{k} {_DDL[v]}" for k, v in kinds.items()))


def page_key(name: str):
    """The id in a column of record ids, as text; null for rows without one."""
    return F.when(F.startswith(F.col(name), F.lit(f"{_URN}:")), F.url_decode(F.replace(F.regexp_extract(name, f"^{_URN}:(.*)>$", 1), F.lit("+"), F.lit("%2B"))))


def op13_warc_packages(spark, sf_dir):
    from pactlens.llm.common import shared_dir, table

    out = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = write_packages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out)
    read = read_packages(written, payload=False)
    return read.select(page_key("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_key("refers_to").cast("long").alias("refers_to"))


_DIGITS = "('0x' || substr(h, 5 * g + 1, 5))::INT"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_DIGITS} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
OP13_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages), d AS (SELECT page_id, last, strlen(t) AS n, sha1(t) AS h FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string([{_BASE32} for g in range(8)], '') AS payload_digest,
  CASE WHEN last IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to
FROM d
"""
