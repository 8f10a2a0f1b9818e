"""MPEG transport streams (ISO/IEC 13818-1): write, check and read.

``mux`` stores a payload of 8-bit samples as one programme with one private
elementary stream: PAT and PMT, then PES packets with time stamps, each starting
with a random-access point and a clock reference. ``demux`` parses the programme tables,
checks continuity counters, reassembles the PES packets of any one-programme stream of
188-byte packets and gives samples, time stamps and random-access points.

Null texts count as empty (64 zero bytes); rows stay as many as they are; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

PACKET = 188
PMT_PID, ES_PID = 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Samples in a PES packet, samples a second, PES packets between two copies of the tables.
UNIT, RATE, TABLES_EVERY = 16_384, 8_000, 16


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ x]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A PSI section packet's payload with pointer field and checksum."""
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    section = head + body
    payload = b"\x00" + section + crc32_mpeg(section).to_bytes(4, "big")
    return payload + b"\xff" * (PACKET - 4 - len(payload))


PAT = _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _section(0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """The stored form of a payload; empty payloads give the tables alone."""
    out: list[bytes] = []
    tables = counter = 0
    for n, at in enumerate(range(0, max(len(payload), 1), unit)):
        if n % TABLES_EVERY == 0:
            for pid, body in ((0, PAT), (PMT_PID, PMT)):
                out.append(bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10 | tables & 15]) + body)
            tables += 1
        own = payload[at : at + unit]
        if not own:
            break
        pts = at * 90_000 // rate & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(own) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + own
        clock = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")  # random access, clock reference
        size = len(pes)
        first = min(size, PACKET - 4 - 1 - len(clock))
        count = 1 + -(-(size - first) // (PACKET - 4))
        p = np.empty((count, PACKET), dtype=np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
        p[0, 1] |= 0x40
        p[:, 3] = 0x10 | (counter + np.arange(count)) & 15
        counter += count
        raw = np.frombuffer(pes, dtype=np.uint8)

        def adapt(row: int, field: bytes, data: np.ndarray) -> None:
            """A packet that starts with an adaptation field, stuffed up to its data."""
            fill = PACKET - 4 - len(data) - 1
            p[row, 3] |= 0x20
            p[row, 4] = fill
            if fill:
                p[row, 5 : 5 + fill] = 0xFF
                p[row, 5] = 0
                p[row, 5 : 5 + len(field)] = np.frombuffer(field, dtype=np.uint8)
            p[row, PACKET - len(data) :] = data

        adapt(0, clock, raw[:first])
        whole = (size - first) // (PACKET - 4)
        p[1 : 1 + whole, 4:] = raw[first : first + whole * (PACKET - 4)].reshape(whole, PACKET - 4)
        if 1 + whole < count:
            adapt(count - 1, b"", raw[first + whole * (PACKET - 4) :])
        out.append(p.tobytes())
    return b"".join(out)


def demux(stream: bytes) -> dict:
    """payload; units: (pts, bytes, random access) of each PES packet; packets,
    continuity_errors, programs, stream_type. ValueError for what isn't a transport stream
    or fails a checksum."""
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if len(p) and not (p[:, 0] == 0x47).all():
        raise ValueError("sync byte missing")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    begins, control, counter = (p[:, 1] & 0x40) > 0, p[:, 3] >> 4 & 3, p[:, 3] & 15
    start = 4 + np.where(control & 2, p[:, 4].astype(np.int32) + 1, 0)
    has = (control & 1) > 0
    errors = 0
    for x in np.unique(pid):
        own = counter[(pid == x) & has].astype(np.int32)
        errors += int((np.diff(own) & 15 != 1).sum())

    def section(row: np.ndarray, at: int) -> bytes:
        at += 1 + int(row[at])
        size = 3 + (int(row[at + 1]) << 8 & 0xF00 | int(row[at + 2]))
        body = row[at : at + size].tobytes()
        if crc32_mpeg(body):
            raise ValueError("table checksum")
        return body

    programs: dict[int, int] = {}
    for k in np.flatnonzero((pid == 0) & begins)[:1]:
        body = section(p[k], start[k])
        for i in range(8, len(body) - 4, 4):
            programs[int.from_bytes(body[i : i + 2], "big")] = int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF
    streams: dict[int, int] = {}
    for table in programs.values():
        for k in np.flatnonzero((pid == table) & begins)[:1]:
            body = section(p[k], start[k])
            i = 12 + (int.from_bytes(body[10:12], "big") & 0xFFF)
            while i < len(body) - 4:
                streams[int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF] = body[i]
                i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0xFFF)
    units, parts = [], []
    for es in sorted(streams):
        rows = np.flatnonzero((pid == es) & has)
        q, s = p[rows], start[rows]
        data = q[np.arange(PACKET) >= s[:, None]].tobytes()
        at = np.concatenate([[0], np.cumsum(PACKET - s)])
        opens = np.flatnonzero(begins[rows])
        for i, k in enumerate(opens):
            until = at[opens[i + 1]] if i + 1 < len(opens) else at[-1]
            pes = data[at[k] : until]
            if pes[:3] != b"\x00\x00\x01":
                raise ValueError("packet start code missing")
            size, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
            pts = None
            if pes[7] & 0x80:
                a = pes[9:14]
                pts = (a[0] & 0x0E) << 29 | a[1] << 22 | (a[2] & 0xFE) << 14 | a[3] << 7 | a[4] >> 1
            own = pes[head : 6 + size if size else None]
            units.append((pts, len(own), bool(control[rows[k]] & 2 and q[k, 4] and q[k, 5] & 0x40)))
            parts.append(own)
    return {"payload": b"".join(parts), "units": units, "packets": len(p), "continuity_errors": errors, "programs": programs, "stream_type": next(iter(streams.values()), None)}


def padded(text: bytes, block: int = 64) -> bytes:
    """Zero bytes up to a positive multiple of ``block``."""
    return text + bytes(-len(text) % block or (0 if text else block))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's padded bytes as a transport stream."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes"))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                texts = [t.as_buffer().to_pybytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"]
                )

    return rows.mapInArrow(run, "id long, n_bytes long, media binary")


def features(d: dict) -> str:
    """Counts of packets, units, random-access points and continuity errors, first
    and last time stamp, mean and roughness of the samples in thousandths."""
    samples = np.frombuffer(d["payload"], dtype=np.uint8).astype(np.int64)
    rough = int(np.abs(np.diff(samples)).sum()) * 1000 // max(len(samples) - 1, 1)
    stamps = [u[0] for u in d["units"]]
    return (
        f"packets={d['packets']};units={len(stamps)};random={sum(u[2] for u in d['units'])};lost={d['continuity_errors']};pts={min(stamps, default=0)}-{max(stamps, default=0)}"
        f";mean={int(samples.sum()) * 1000 // max(len(samples), 1)};rough={rough}"
    )


def inspect(media: DataFrame) -> DataFrame:
    """Reads ``store``'s column back: one row per stream, with digests and features."""
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<boolean>"

    def run(batches):
        for b in batches:
            out = []
            for i, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                stream = m.as_buffer().to_pybytes()
                d = demux(stream)
                p = d["payload"]
                out.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), features(d), [u[0] for u in d["units"]], [u[2] for u in d["units"]]))
            types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            columns = list(zip(*out)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in schema.split(", ")])

    return media.mapInArrow(run, schema)
