"""Operator 4, media columns: Matroska files in a binary column and their packet tables.

``mux`` stores the UTF-8 bytes of a text, padded with spaces to a positive multiple of ``FRAME``, losslessly as
8-bit PCM samples of one audio track: frames of ``FRAME`` samples, up to ``LACED`` frames a block (the
lacing forms take turns), ``BLOCKS`` blocks a cluster, a cue for each cluster. ``packet_table`` parses
any Matroska column by the EBML structure: variable-length ids and sizes (unknown sizes too),
clusters, SimpleBlocks and BlockGroups, all lacing forms, and cues, and gives one row for each packet
with track, timestamp and byte range. ``media_digest`` reads the payload back through these ranges.

Defined cases: a null text counts as empty and becomes one frame of spaces; null media give no
packets; equal texts give equal media, whatever their ids; a damaged file raises an error; a row is
worked on alone, so ties and repeats need no rule; further columns are ignored.
"""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, LACED, BLOCKS, RATE = 192, 8, 32, 8000
BATCH = 256  # media values in an output batch

# Element ids of the public EBML and Matroska specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID = (
    0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC)
DOC_TYPE, TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = (
    0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86)
DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

PACKETS = ("{id} {kind}, packet_no long, track long, timestamp_ns long, duration_ns long, byte_offset long, "
           "byte_length long, lacing string, keyframe boolean, cluster_offset long, cued boolean")
LACING = ("none", "xiph", "fixed", "ebml")


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer: the leading bit tells the width."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(element: int, body: bytes) -> bytes:
    return _id(element) + _size(len(body)) + body


def _uint(element: int, n: int) -> bytes:
    return _element(element, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = _element(EBML, _element(DOC_TYPE, b"matroska"))
_DURATION = FRAME * 1_000_000_000 // RATE
_SETUP = (_element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000))
          + _element(TRACKS, _element(TRACK_ENTRY, b"".join([
              _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _element(CODEC, b"A_PCM/INT/LIT"),
              _uint(DEFAULT_DURATION, _DURATION),
              _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))]))))


def _block(payload, first: int, frames: int, relative: int, turn: int) -> bytes:
    """A SimpleBlock. Frames have equal sizes, which each form of lacing writes in its own way."""
    form = 0 if frames == 1 else 1 + turn % 3
    sizes = b"" if form == 0 else bytes([frames - 1])
    if form == 1:
        sizes += (b"\xff" * (FRAME // 255) + bytes([FRAME % 255])) * (frames - 1)
    elif form == 3:
        sizes += _size(FRAME, 2) + _size((1 << 6) - 1, 1) * (frames - 2)
    body = b"".join([b"\x81", struct.pack(">h", relative), bytes([0x80 | form << 1]), sizes,
                     payload[first * FRAME:(first + frames) * FRAME]])
    return _element(SIMPLE_BLOCK, body)


def mux_bytes(text: bytes) -> bytes:
    payload = text + b" " * (-len(text) % FRAME if text else FRAME)
    total = len(payload) // FRAME
    parts, cues, at = [_SETUP], [], len(_SETUP)
    for start in range(0, total, LACED * BLOCKS):
        began = start * FRAME * 1000 // RATE
        blocks = [_uint(TIMESTAMP, began)]
        for k, first in enumerate(range(start, min(total, start + LACED * BLOCKS), LACED)):
            blocks.append(_block(payload, first, min(LACED, total - first), first * FRAME * 1000 // RATE - began, k))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, began) + _element(
            CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(_element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts))


def _vint(data, at: int, keep_marker: bool = False):
    """Value, end and whether all value bits are set (for a size: unknown)."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError(f"no variable-length integer at byte {at}")
    raw = int.from_bytes(data[at:at + width], "big")
    if at + width > len(data):
        raise ValueError("the file ends inside an integer")
    value = raw & ((1 << 7 * width) - 1)
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES}


def elements(data, at: int, end: int):
    """(id, offset of the element, body, end of the body) of each element, parents first. A parent is
    entered, so an unknown size needs no end: its children come next."""
    while at < end:
        element, body, _ = _vint(data, at, True)
        size, body, unknown = _vint(data, body)
        stop = end if unknown else body + size
        if stop > end:
            raise ValueError(f"element {element:x} at byte {at} ends after the file")
        yield element, at, body, stop
        at = body if element in _MASTERS else stop


def _lace(data, at: int, end: int, form: int):
    """Byte ranges of the frames of a block body."""
    if form == 0 or data[at] == 0:
        at += form > 0
        return [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if form == 1:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif form == 3:
        size, at, _ = _vint(data, at)
        sizes = [size]
        for _ in range(count - 2):
            width = 9 - data[at].bit_length()
            step, at, _ = _vint(data, at)
            size += step - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes = sizes[:count - 1]
    else:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // count] * (count - 1)
    ranges = []
    for size in sizes:
        ranges.append((at, size))
        at += size
    if at > end:
        raise ValueError("laced frames end after their block")
    return [*ranges, (at, end - at)]


def _setup(data) -> tuple:
    """Timestamp scale, and the default duration of each track. The elements of a track entry come in any order, so an
    entry is read whole before its duration is assigned; the setup itself may follow the clusters."""
    scale, entries = 1_000_000, []
    for element, _, body, stop in elements(data, 0, len(data)):
        if element == TRACK_ENTRY:
            entries.append({})
        elif element == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[body:stop], "big")
        elif element in (TRACK_NUMBER, DEFAULT_DURATION) and entries:
            entries[-1][element] = int.from_bytes(data[body:stop], "big")
    return scale, {e.get(TRACK_NUMBER, 0): e.get(DEFAULT_DURATION, 0) for e in entries}


def packets(data) -> list:
    """Rows (track, timestamp, duration, offset, length, lacing, keyframe, cluster, cued) of a file. A packet's duration is its share
    of the block's own duration where the block group states one, else the track's default, else 0."""
    scale, durations = _setup(data)
    cluster, began, segment, rows, cued = -1, 0, 0, [], set()
    group, whole, reference = None, None, False
    blocks = []     # (first row, track, time) and what the group says of each block, known at its end

    def finish():
        if group is not None and blocks:
            first, _, time = blocks[-1]
            count = len(rows) - first
            for i in range(first, len(rows)):
                step = rows[i][2] if whole is None else whole * scale // count
                rows[i] = (rows[i][0], time + (i - first) * step, step, *rows[i][3:6], not reference, rows[i][7])

    for element, at, body, stop in elements(data, 0, len(data)):
        if group is not None and at >= group:
            finish()
            group, blocks = None, []
        if element == SEGMENT:
            segment = body
        elif element == CLUSTER:
            finish()
            group, blocks, cluster = None, [], at - segment
        elif element == BLOCK_GROUP:
            finish()
            group, whole, reference, blocks = stop, None, False, []
        elif element == REFERENCE:
            reference = True
        elif element == BLOCK_DURATION:
            whole = int.from_bytes(data[body:stop], "big")
        elif element == TIMESTAMP:
            began = int.from_bytes(data[body:stop], "big")
        elif element == CUE_CLUSTER:
            cued.add(int.from_bytes(data[body:stop], "big"))
        elif element in (SIMPLE_BLOCK, BLOCK):
            number, head, _ = _vint(data, body)
            relative, flags = struct.unpack_from(">hB", data, head)
            form, step = flags >> 1 & 3, durations.get(number, 0)
            key = bool(flags & 0x80) or element == BLOCK
            time = (began + relative) * scale
            if element == BLOCK:
                blocks.append((len(rows), number, time))
            rows += [(number, time + i * step, step, o, n, LACING[form], key, cluster)
                     for i, (o, n) in enumerate(_lace(data, head + 3, stop, form))]
    finish()
    return [(*r, r[7] in cued) for r in rows]


def mux(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media."""
    kind = docs.schema[key].dataType.simpleString()

    def write(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                texts = [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([mux_bytes(t) for t in texts], pa.binary())], [key, "n_bytes", "media"])

    return docs.select(key, F.col(text).cast("binary").alias("_b")).mapInArrow(
        write, f"`{key}` {kind}, n_bytes long, media binary")


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each packet of each file, in file order."""
    schema = PACKETS.format(id=f"`{key}`", kind=media.schema[key].dataType.simpleString())

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(1)[i]
                rows = packets(value.as_buffer().to_pybytes()) if value.is_valid else []
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type),
                         pa.array(range(len(rows)), pa.int64()), *map(pa.array, zip(*rows))],
                        [key, "packet_no", "track", "timestamp_ns", "duration_ns", "byte_offset", "byte_length", "lacing",
                         "keyframe", "cluster_offset", "cued"])

    return media.select(key, F.col(column)).mapInArrow(read, schema)


def _summary(data: bytes) -> tuple:
    rows = packets(data)
    view = memoryview(data)
    payload = b"".join(view[r[3]:r[3] + r[4]] for r in rows)
    samples = np.frombuffer(payload, np.uint8)
    lacing = [r[5] for r in rows]
    feature = (f"packets={len(rows)};tracks={len({r[0] for r in rows})};clusters={len({r[7] for r in rows})};"
               f"cued={sum(r[8] for r in rows)};"
               + ";".join(f"{form}={lacing.count(form)}" for form in LACING)
               + f";end_ms={(rows[-1][1] + rows[-1][2]) // 1_000_000};sum={int(samples.sum(dtype=np.int64))}"
               f";max={int(samples.max())}")
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data),
            hashlib.sha256(data).hexdigest(), feature)


def media_digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the packet ranges of each stored file hold."""
    kind = media.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches):
        for batch in batches:
            found = [_summary(v.as_buffer().to_pybytes()) for v in batch.column(2)]
            columns = zip(*found) if found else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    return media.select(key, "n_bytes", "media").mapInArrow(
        read, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
              "media_bytes long, media_sha256 string, feature string")
