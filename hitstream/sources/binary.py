"""Binary formats: record files (.dat), wire packets, T2 payloads.

Files come through Spark's binaryFile reader, so any store works; a file is one rotated record file and bounded by the
writer's rotation size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: sizes in bytes, message types, limits, tags.
FILE_HEADER, RECORD_HEADER, NAME_BYTES, DATA_VERSION = 256, 12, 128, 4
MESSAGE_HEADER, MAX_PACKET = 8, 1 << 20
MT_T2, MT_DAQEVENT, MT_RAWEVENT = 0x03, 0x04, 0x05
DELIMITER_BYTES, MODE_BYTES = 1, 20
HIT_BYTES = 12
TAGS = ("ff12", "ee12")


def file_header(data: bytes) -> dict[str, int | str]:
    if len(data) < FILE_HEADER:
        raise ValueError("file too small for header")
    size, version, run, opened, closed, name_len = struct.unpack_from("<6I", data)
    name = data[24 : 24 + NAME_BYTES].split(b"\0", 1)[0].decode("utf-8", "replace")
    return {"head_size": size, "version": version, "run": run, "open_time": opened, "close_time": closed, "name_len": name_len, "name": name}


def records(data: bytes) -> Iterator[tuple[int, int, int, bytes, str | None]]:
    """(index, type, source, payload, error); an error ends the file with a row that says so."""
    at, index = FILE_HEADER, 0
    if len(data) < FILE_HEADER:
        yield 0, 0, 0, b"", "file too small for header"
        return
    while at < len(data):
        error = None
        if at + RECORD_HEADER > len(data):
            error = "truncated record header"
        else:
            size, kind, source = struct.unpack_from("<III", data, at)
            if size < RECORD_HEADER:
                error = "invalid record size"
            elif at + size > len(data):
                error = "truncated payload"
        if error:
            yield index, 0, 0, b"", error
            return
        yield index, kind, source, data[at + RECORD_HEADER : at + size], None
        at, index = at + size, index + 1


DAT = "path string, run long, open_time long, close_time long, idx long, rec_type long, source long, payload binary, error string"


def _parse_dat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in DAT.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.binary(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            data, rows, held = content.as_py(), [], 0
            head = file_header(data) if len(data) >= FILE_HEADER else {"run": None, "open_time": None, "close_time": None}
            for index, kind, source, payload, error in records(data):
                rows.append((path.as_py(), head["run"], head["open_time"], head["close_time"], index, kind, source, payload, error))
                held += len(payload)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def dat_records(spark: SparkSession, path: str, pattern: str = "*.dat") -> DataFrame:
    """Records of .dat files: path, run, open and close time, idx, rec_type, source, payload, error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_parse_dat, DAT)


def inspected(dat: DataFrame, first: int) -> DataFrame:
    """The first records of each file with payload size, prefix and tag offsets (-1: not there)."""
    found = {f"{t}_offset": (F.locate(t, F.lower(F.hex("payload"))) - 1) for t in TAGS}
    each = dat.where((F.col("idx") < first) & F.col("error").isNull())
    each = each.withColumns({"payload_size": F.octet_length("payload"), "prefix_hex": F.lower(F.hex(F.substring("payload", 1, 16)))})
    return each.withColumns({k: tag_offset("payload", k[:4]) for k in found}).drop("payload")


def tag_offset(payload: str, tag: str) -> Column:
    """Byte offset of a two-byte tag, -1 if absent: only even places of the hex form count."""
    text = F.lower(F.hex(payload))
    pairs = F.regexp_instr(F.regexp_replace(text, "(..)", "$1 "), F.lit(f"{tag[:2]} {tag[2:]}"))
    return F.when(pairs > 0, F.floor((pairs - 1) / 3)).otherwise(F.lit(-1)).cast("int")


def file_ids(dat: DataFrame) -> DataFrame:
    """One row: number of files, first and last file id (the number before the suffix)."""
    files = dat.select("path").distinct().withColumn("id", F.regexp_extract("path", r"-(\d+)\.dat$", 1).try_cast("long"))
    return files.agg(F.count("*").alias("files"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def record_at(dat: DataFrame, idx: int) -> DataFrame:
    return dat.where((F.col("idx") == idx) & F.col("error").isNull())


def inbound_payload(frames: list[bytes]) -> bytes | None:
    """Payload of two or three frames (delimiter, optional mode, payload); None if the framing is wrong."""
    if len(frames) not in (2, 3) or len(frames[0]) != DELIMITER_BYTES or (len(frames) == 3 and len(frames[1]) != MODE_BYTES):
        return None
    return frames[-1]


def packet(data: bytes, at: int = 0) -> tuple[int, str]:
    """(bytes of the packet at ``at``, kind): 0 if more are needed, -1 if it is none."""
    if len(data) - at < MESSAGE_HEADER:
        return -1, "unknown"
    size, kind = struct.unpack_from("<II", data, at)
    least = {MT_T2: ("t2", 1), MT_DAQEVENT: ("daqevent", 8), MT_RAWEVENT: ("rawevent", 2)}.get(kind)
    if least is None or not MESSAGE_HEADER <= size <= MAX_PACKET:
        return -1, "unknown"
    if len(data) - at < size:
        return 0, "unknown"
    return (size, least[0]) if size - MESSAGE_HEADER >= least[1] else (-1, "unknown")


def packets(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(kind, body) of the whole packets at the start of a buffer."""
    at = 0
    while at < len(data):
        size, kind = packet(data, at)
        if size <= 0:
            return
        yield kind, data[at + MESSAGE_HEADER : at + size]
        at += size


def _le(data: Column, start: Column | int, size: int) -> Column:
    """Little-endian unsigned integer of up to 8 bytes (the top bit of 8 must be clear)."""
    part = F.substring(data, start if isinstance(start, Column) else F.lit(start), F.lit(size))
    h = F.hex(part)
    swapped = F.concat(*[F.substring(h, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(size))])
    return F.conv(swapped, 16, 10).cast("long")


def t2_hits(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Hits of T2 payloads, natively: du, pos, t_ns, channel, score. A payload whose length does not fit gives none."""
    n = F.floor((F.octet_length(payload) - 4) / HIT_BYTES).cast("int")
    fits = (F.octet_length(payload) >= 4 + HIT_BYTES) & ((F.octet_length(payload) - 4) % HIT_BYTES == 0)
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pos"), (i * HIT_BYTES + 5).alias("o")))
    rows = payloads.where(fits).select("*", _le(F.col(payload), 1, 4).alias("du"), F.explode(at).alias("h"))
    o, p = F.col("h.o"), F.col(payload)
    return rows.select(*[c for c in payloads.columns if c != payload], "du", F.col("h.pos").alias("pos"), _le(p, o, 8).alias("t_ns"), _le(p, o + 8, 2).alias("channel"), _le(p, o + 10, 2).alias("score"))


def t2_payload(du: int, hits: list[tuple[int, int, int]]) -> bytes:
    return struct.pack("<I", du) + b"".join(struct.pack("<QHH", *h) for h in hits)


def samples(dat: DataFrame, files: int, records: int) -> DataFrame:
    """The first whole records of each of the first files (by path): path, idx, rec_type, source, name, payload. ``name`` is a file's for the sample."""
    good = dat.where(F.col("error").isNull() & (F.col("idx") < records))
    first = good.select("path").distinct().orderBy("path").limit(files)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.dat)?$", 1)
    name = F.format_string("%s_%04d.bin", stem, F.col("idx"))
    return good.join(F.broadcast(first), "path").select("path", "idx", "rec_type", "source", name.alias("name"), "payload")
