"""Sinks: tables and text, skip-if-exists, duplicate-reject logs, rotating record files."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from hitstream.sources.binary import DATA_VERSION, FILE_HEADER, NAME_BYTES, RECORD_HEADER

#: Fallback run numbers of the two record streams, the largest run number.
FIRST_RUN, FIRST_CD_RUN, LAST_RUN = 1, 10_001, (1 << 32) - 1


def write_scan(results: DataFrame, path: str) -> None:
    """Scan results by folder of showers."""
    results.write.mode("append").partitionBy("i_dir").parquet(path)


def not_yet_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work without an output yet: repeating a job repeats nothing."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def write_if_rows(df: DataFrame, path: str, form: str = "csv") -> bool:
    """Write CSV, JSON or Parquet, or nothing at all where there are no rows."""
    if not df.take(1):
        return False
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[form]()
    return True


def write_lookup(df: DataFrame, path: str) -> None:
    """A lookup table in the form that its name asks for: Parquet or CSV."""
    form = path.rstrip("/").rpartition(".")[2]
    if form not in ("parquet", "csv"):
        raise ValueError(f"{path}: a lookup table is written as .parquet or .csv")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def write_summary(summary: DataFrame, rows: DataFrame, path: str) -> bool:
    """A one-row summary as JSON, and its rows as CSV where there are any; tells whether there are."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return write_if_rows(rows, f"{path}/rows")


def each_result(stream: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """``call`` gets every micro-batch of results and its number, once it is complete: the callback of a running trigger. Not started yet."""
    return stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)


def fixed_lines(df: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    """Lines of fields separated by spaces, doubles with a fixed number of digits."""
    parts = [F.format_string(f"%.{digits}f", F.col(c)) if t == "double" else F.col(c).cast("string") for c, t in df.select(*columns).dtypes]
    return df.select(F.concat_ws(" ", *parts).alias("value"))


def duplicate_line(hits: Column) -> Column:
    """Log line of an event's hits (array of du, t_ns): the earliest time, then hits by (du, time) with times within their second."""
    ns = 1_000_000_000
    first = F.array_min(F.transform(hits, lambda h: h["t_ns"]))
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["du"].alias("du"), h["t_ns"].alias("t_ns"))))
    each = F.transform(ordered, lambda h: F.format_string("(%d, %d)", h["du"], h["t_ns"] % ns))
    return F.concat(F.format_string("%d.%09d", F.floor(first / ns).cast("long"), first % ns), F.lit(": ["), F.array_join(each, ", "), F.lit("]"))


def write_duplicate_log(events: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Text files of at most ``per_file`` events, in order of time within a file."""
    lines = events.select(F.array_min(F.transform("hits", lambda h: h["t_ns"])).alias("t"), duplicate_line(F.col("hits")).alias("value"))
    lines.repartitionByRange("t").sortWithinPartitions("t").select("value").write.option("maxRecordsPerFile", per_file).text(path)


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _signatures(payload: pd.Series) -> pd.Series:
    return payload.map(lambda p: None if p is None else f"{fnv1a64(bytes(p)):016x}")


def signature(payload: str) -> Column:
    """Hex signature of payloads as stage traces carry it."""
    return F.pandas_udf(_signatures, T.StringType())(payload)


def stage_trace(payloads: DataFrame) -> DataFrame:
    """JSON lines (du, size, signature) of a stage's payloads."""
    return payloads.select(F.to_json(F.struct("du", F.octet_length("payload").alias("size"), signature("payload").alias("signature"))).alias("value"))


def routes(mode: int) -> list[str]:
    """Streams that a DAQ mode writes to."""
    return [name for name, modes in (("l1", (1, 3, 4)), ("md", (4,)), ("cd", (2, 3))) if mode in modes]


def next_run(names: Iterable[str], token: str = "", fallback: int = FIRST_RUN) -> int:
    """One more than the largest RUN<n>_ among .dat names that hold ``token``; RUN counts at the start or behind an underscore."""
    found = [n for name in names if name.endswith(".dat") and token in name for r in re.findall(r"(?:^|(?<=_))RUN(\d+)(?=_)", name) if (n := int(r)) <= LAST_RUN]
    return min(LAST_RUN, max(found) + 1) if found else fallback


def file_name(module: str, when: int, run: int, tag: str, file_id: int, per_file: int | None = None) -> str:
    """{module}_{utc}_RUN{n}_{tag}-{id}; with ``per_file`` that number, padded, comes before the id."""
    stamp = datetime.fromtimestamp(when, UTC).strftime("%Y%m%d_%H%M%S")
    tail = f"{file_id:04d}" if per_file is None else f"{per_file:04d}-{file_id}"
    return f"{module}_{stamp}_RUN{run}_{tag}-{tail}.dat"


def encoded(run: int, opened: int, closed: int, name: str, records: Iterable[tuple[int, int, bytes]]) -> bytes:
    """A whole record file: header and (type, source, payload) records."""
    raw = name.encode()
    head = struct.pack("<6I", FILE_HEADER, DATA_VERSION, run, opened, closed, len(raw)) + raw[:NAME_BYTES]
    body = b"".join(struct.pack("<III", RECORD_HEADER + len(p), kind, source) + p for kind, source, p in records)
    return head.ljust(FILE_HEADER, b"\0") + body


Record = tuple[int, int, int, bytes]  # event, type, source, payload


def rotated(records: Iterable[Record], max_bytes: int, max_events: int | None = None) -> Iterator[list[Record]]:
    """Files of consecutive records: a new file begins when the size or the number of distinct events is reached, never inside an event."""
    now: list[Record] = []
    size, events, last = FILE_HEADER, set(), None
    for r in records:
        if now and r[0] != last and (size >= max_bytes or (max_events is not None and len(events | {r[0]}) > max_events)):
            yield now
            now, size, events = [], FILE_HEADER, set()
        now.append(r)
        events.add(r[0])
        size += RECORD_HEADER + len(r[3])
        last = r[0]
    if now:
        yield now


FILES = "shard int, file_id int, name string, content binary, events int"


def dat_files(rows: DataFrame, module: str, run: int, tag: str, opened: int, max_bytes: int, max_events: int | None = None, shards: int = 1) -> DataFrame:
    """Whole record files as rows (shard, file_id, name, content): events stay together, shards write side by side.

    ``rows``: event, seq, rec_type, source, payload. A task holds one file at a time.
    """

    def run_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: list[int] = []

        def stream() -> Iterator[Record]:
            for b in batches:
                for shard, event, kind, source, payload in b[["shard", "event", "rec_type", "source", "payload"]].itertuples(index=False):
                    current[:] = [int(shard)]
                    yield int(event) * shards + int(shard), int(kind), int(source), bytes(payload)

        counts: dict[int, int] = {}
        for part in rotated(stream(), max_bytes, max_events):
            shard = part[0][0] % shards
            counts[shard] = counts.get(shard, 0) + 1
            name = file_name(module, opened, run, f"{tag}-S{shard:04d}" if shards > 1 else tag, counts[shard])
            content = encoded(run, opened, opened, name, [r[1:] for r in part])
            yield pd.DataFrame([(shard, counts[shard], name, content, len({r[0] for r in part}))], columns=[f.split()[0] for f in FILES.split(", ")])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("event"), F.lit(shards)).cast("int"))
    return dealt.repartition("shard").sortWithinPartitions("shard", "event", "seq").mapInPandas(run_shard, FILES)
