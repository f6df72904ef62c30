"""AVI motion-JPEG: index and frame parsing, shot detection, and lossless payloads.

``read_avi`` walks the RIFF tree, takes the frames from the idx1 index (from
the movi list where there is none) and decodes baseline JPEG frames to their
luma. Entropy-coded segments between restart markers are decoded side by side,
one lane each, in numpy. Blocks without AC terms are flat, and stay one
sample; others go through the inverse DCT.

``write_payload`` stores bytes losslessly as such a video: each byte is the level of
one flat 8 x 8 block (its DC term; the quantiser is 8, so levels are exact), 64
blocks to a row, a restart interval for each row, FRAME_ROWS rows to a frame.

``shots`` cuts where the histogram difference of neighbouring frames stands
out from those before it (mean plus SPREAD deviations of up to MEMORY of them).

Null and empty texts are payloads of 64 zero bytes. Equal texts give equal
values. An empty table gives an empty result; other columns are not read.
Bytes that are not an AVI, cut files, and frames that are not baseline JPEG raise
ValueError; in ``clips`` such a file has one row, with the error and no times.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..runtime import read_table

UNIT, FRAME_ROWS, FPS = 64, 64, 25
BINS, MEMORY, SPREAD, FLOOR = 32, 8, 3.0, 0.25
# The JPEG zigzag order.
ZIGZAG = np.array(
    "0 1 8 16 9 2 3 10 17 24 32 25 18 11 4 5 12 19 26 33 40 48 41 34 27 20 13 6 7 14 21 28 "
    "35 42 49 56 57 50 43 36 29 22 15 23 30 37 44 51 58 59 52 45 38 31 39 46 53 60 61 54 47 55 62 63".split(),
    dtype=np.int64,
)
_k, _n = np.mgrid[0:8, 0:8]
DCT = np.cos((2 * _n + 1) * _k * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)


# --- writing -------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_header(rows: int) -> bytes:
    """Markers up to the scan of a gray frame of UNIT x rows blocks."""
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0]) + bytes([8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, UNIT * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, bytes([0x00]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))  # DC sizes, four bits each
        + _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))  # end of block, one bit
        + _segment(0xDD, struct.pack(">H", UNIT))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _scan_rows(payload: np.ndarray, last: np.ndarray, order: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded rows (n, UNIT), each with its closing marker, and where each ends."""
    level = payload.astype(np.int32) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = np.frexp(np.abs(diff).astype(np.float64))[1].astype(np.int32)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    value = ((size << size) | extra) << 1
    bits = size + 5
    ends = np.cumsum(bits, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    row_at = np.cumsum(row_bytes) - row_bytes
    bit = (ends - bits + row_at[:, None] * 8).ravel().astype(np.int64)
    window = value.ravel().astype(np.int64) << (24 - (bit & 7) - bits.ravel())
    total = int(row_bytes.sum())
    out = np.zeros(total + 3)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount((bit >> 3) + k, weights=((window >> shift) & 255).astype(np.float64), minlength=total + 3)[: total + 3]
    out[row_at + row_bytes - 1] += (1 << (row_bytes * 8 - ends[:, -1])) - 1
    data = out[:total].astype(np.uint8)
    full = data == 255
    before = np.cumsum(full)
    stuffed_end = row_at + row_bytes + before[row_at + row_bytes - 1] + 2 * np.arange(1, len(row_at) + 1)
    result = np.zeros(total + int(before[-1]) + 2 * len(row_at), np.uint8)
    place = np.arange(total) + before - full + 2 * np.repeat(np.arange(len(row_at)), row_bytes)
    result[place] = data
    result[stuffed_end - 2] = 0xFF
    result[stuffed_end - 1] = np.where(last, 0xD9, 0xD0 + order % 8)
    return result.tobytes(), stuffed_end


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi(frames: list[bytes], rows: int) -> bytes:
    width, height = UNIT * 8, rows * 8
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<3I2H4sI4I", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    at, index, movi = 4, [], [b"movi"]
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def write_payloads(payloads: list[bytes]) -> list[bytes]:
    """A video for each payload (a positive multiple of UNIT bytes)."""
    counts = np.array([len(p) // UNIT for p in payloads])
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = inside % FRAME_ROWS
    last = (order == FRAME_ROWS - 1) | (inside == np.repeat(counts, counts) - 1)
    coded, ends = _scan_rows(rows, last, order)
    starts = np.concatenate([[0], ends[:-1]])
    out, r = [], 0
    for n in counts.tolist():
        frames = []
        for a in range(r, r + n, FRAME_ROWS):
            b = min(a + FRAME_ROWS, r + n)
            frames.append(_frame_header(b - a) + coded[starts[a] : ends[b - 1]])
        out.append(_avi(frames, min(n, FRAME_ROWS)))
        r += n
    return out


# --- reading -------------------------------------------------------------------------


def frame_bytes(data: bytes) -> tuple[list[bytes], float]:
    """Frames of the first video stream, in index order, and seconds per frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micros, movi, index, found = 40_000, None, None, []
    at, stop = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= stop:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            where = data.find(b"avih", at, at + 8 + size)
            if where >= 0:
                micros = struct.unpack_from("<I", data, where + 8)[0] or micros
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + size)
        elif name == b"idx1":
            index = [struct.unpack_from("<4s3I", data, p) for p in range(at + 8, at + 8 + size - 15, 16)]
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    if index is not None:
        base = movi[0] if not index or index[0][2] < movi[0] else 0  # offsets from the list, or from the file's start
        found = [data[base + o + 8 : base + o + 8 + n] for name, _, o, n in index if name[2:] in (b"dc", b"db")]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name[2:] in (b"dc", b"db"):
                found.append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return found, micros / 1e6


def _huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16 bits ahead."""
    sym, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code = k = 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            a, b = code << (16 - n), (code + 1) << (16 - n)
            sym[a:b], length[a:b] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return sym, length


class Header:
    """Parsed markers of a baseline frame."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, tuple[bytes, bytes]] = {}
        self.restart, self.components, self.scan = 0, [], []
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        self.quant[body[0] & 15] = np.frombuffer(body[1:129], ">u2").astype(np.int64)
                        body = body[129:]
                    else:
                        self.quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int64)
                        body = body[65:]
            elif marker == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline frame")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                self.data_at = at + 2 + size
                return
            at += 2 + size

    def layout(self) -> list[tuple[int, int, int]]:
        """Component, DC table and AC table of each block of an MCU."""
        out = []
        for i, (cid, h, v, _) in enumerate(self.components):
            tables = dict(self.scan)[cid]
            out += [(i, tables >> 4, 0x10 | tables & 15)] * (h * v if len(self.components) > 1 else 1)
        return out

    def mcus(self) -> tuple[int, int]:
        h = max(c[1] for c in self.components) if len(self.components) > 1 else 1
        v = max(c[2] for c in self.components) if len(self.components) > 1 else 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def key(self):
        return (tuple(sorted(self.tables.items())), tuple(self.layout()))


class Bits:
    """Bit positions in many byte strings at once."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        d = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint32)
        self.words = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
        self.pos = starts.astype(np.int64) * 8

    def peek(self, lanes: np.ndarray | slice) -> np.ndarray:
        p = self.pos[lanes]
        at = np.minimum(p >> 3, len(self.words) - 1)
        return (self.words[at] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    v = (bits >> (16 - size)).astype(np.int64)
    return np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)


def decode_lanes(header: Header, data: np.ndarray, starts: np.ndarray, mcus: np.ndarray) -> tuple[np.ndarray, list]:
    """DC levels (lanes, blocks) and AC terms (lane, block, place, value) of restart intervals."""
    layout = header.layout()
    tables = {k: _huffman(*t) for k, t in header.tables.items()}
    most = int(mcus.max(initial=0))
    dc = np.zeros((len(starts), most * len(layout)), np.int32)
    level = np.zeros((len(header.components), len(starts)), np.int64)
    ac: list = []
    bits = Bits(data, starts)
    for m in range(most):
        lanes = slice(None) if (mcus > m).all() else np.flatnonzero(mcus > m)
        for b, (comp, dc_table, ac_table) in enumerate(layout):
            block = m * len(layout) + b
            sym, length = tables[dc_table]
            head = bits.peek(lanes)
            size = sym[head].astype(np.int64)
            bits.pos[lanes] += length[head]
            level[comp, lanes] += _extend(bits.peek(lanes), size)
            bits.pos[lanes] += size
            dc[lanes, block] = level[comp, lanes]
            sym, length = tables[ac_table]
            busy = lanes
            place = np.ones(len(starts), np.int64)
            while True:
                head = bits.peek(busy)
                s = sym[head].astype(np.int64)
                bits.pos[busy] += length[head]
                going = s != 0
                if not going.any():
                    break
                busy = np.flatnonzero(going) if isinstance(busy, slice) else busy[going]
                s = s[going]
                size = s & 15
                place[busy] += s >> 4
                v = _extend(bits.peek(busy), size)
                bits.pos[busy] += size
                put = size > 0
                if put.any():
                    ac.append((busy[put], np.full(int(put.sum()), block), np.minimum(place[busy[put]], 63), v[put]))
                place[busy] += 1
                busy = busy[place[busy] < 64]
                if not len(busy):
                    break
    return dc, ac


def _intervals(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Unstuffed bytes of a scan up to its end marker, and where each restart interval starts."""
    d = np.frombuffer(scan, np.uint8)
    mark = np.flatnonzero((d[:-1] == 255) & (d[1:] != 0))
    final = mark[(d[mark + 1] & 0xF8) != 0xD0]
    stop = int(final[0]) if len(final) else len(d)
    mark = mark[mark < stop]
    keep = np.ones(stop, bool)
    stuffed = np.flatnonzero((d[: stop - 1] == 255) & (d[1:stop] == 0)) + 1
    keep[stuffed] = keep[mark] = keep[mark + 1] = False
    where = np.cumsum(keep)
    return d[:stop][keep], np.concatenate([[0], where[mark + 1]])


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Luma of each frame as (block rows, block columns) levels where all blocks are flat,
    else as (height, width) samples. Frames with equal tables are decoded together."""
    groups: dict = {}
    for i, f in enumerate(frames):
        h = Header(f)
        groups.setdefault(h.key(), []).append((i, h, *_intervals(f[h.data_at :])))
    out: list = [None] * len(frames)
    for members in groups.values():
        base, starts, mcus = 0, [], []
        for _, h, data, at in members:
            w, v = h.mcus()
            step = h.restart or w * v
            starts.append(at + base)
            mcus.append(np.minimum(step, w * v - step * np.arange(len(at))))
            base += len(data)
        dc, ac = decode_lanes(members[0][1], np.concatenate([m[2] for m in members]), np.concatenate(starts), np.concatenate(mcus))
        terms = [np.concatenate(x) for x in zip(*ac)] if ac else None
        lane = 0
        for (i, h, _, at), n in zip(members, mcus):
            out[i] = _luma(h, dc[lane : lane + len(at)], n, terms, lane)
            lane += len(at)
    return out


def _luma(h: Header, dc: np.ndarray, mcus: np.ndarray, terms, lane: int) -> np.ndarray:
    layout = h.layout()
    first = [b for b, x in enumerate(layout) if x[0] == 0]
    across, down = h.mcus()
    hs, vs = (h.components[0][1], h.components[0][2]) if len(h.components) > 1 else (1, 1)
    quant = h.quant[h.components[0][3]]
    blocks = np.concatenate([row[: n * len(layout)].reshape(n, -1)[:, first] for row, n in zip(dc, mcus)])  # (mcus, luma blocks)
    inside = terms is not None and ((terms[0] >= lane) & (terms[0] < lane + len(dc)))
    order = lambda x, *tail: x.reshape(down, across, vs, hs, *tail)
    if terms is None or not inside.any():
        level = np.clip(np.rint(blocks * quant[0] / 8) + 128, 0, 255).astype(np.uint8)
        grid = order(level).transpose(0, 2, 1, 3).reshape(down * vs, across * hs)
        return grid[: -(-h.height // 8), : -(-h.width // 8)]
    coef = np.zeros((*blocks.shape, 64))
    coef[:, :, 0] = blocks
    row, block, place, value = (t[inside] for t in terms)
    mcu = (np.cumsum(mcus) - mcus)[row - lane] + block // len(layout)
    slot = np.full(len(layout), -1)
    slot[first] = np.arange(len(first))
    mine = slot[block % len(layout)] >= 0
    coef[mcu[mine], slot[block % len(layout)][mine], place[mine]] = value[mine]
    natural = np.zeros_like(coef)
    natural[:, :, ZIGZAG] = coef * quant
    pixels = DCT.T @ natural.reshape(-1, 8, 8) @ DCT
    pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).reshape(*blocks.shape, 8, 8)
    grid = order(pixels, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * vs * 8, across * hs * 8)
    return grid[: h.height, : h.width]


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last frame of each shot."""
    if not frames:
        return []
    hist = [np.bincount(f.ravel() // (256 // BINS), minlength=BINS) / max(f.size, 1) for f in frames]
    cuts, past = [0], []
    for i in range(1, len(hist)):
        d = float(np.abs(hist[i] - hist[i - 1]).sum()) / 2
        recent = past[-MEMORY:]
        limit = max(FLOOR, (np.mean(recent) + SPREAD * np.std(recent)) if recent else 0.0)
        if d > limit:
            cuts.append(i)
            past = []
        else:
            past.append(d)
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(frames)])]


def read_avi(videos: list[bytes]) -> list[tuple[list[np.ndarray], float]]:
    """Decoded luma frames and seconds per frame of each video."""
    try:
        parsed = [frame_bytes(v) for v in videos]
        decoded = decode_frames([f for frames, _ in parsed for f in frames])
    except (struct.error, LookupError, TypeError, ZeroDivisionError) as e:  # what a cut or damaged file leads to
        raise ValueError(f"damaged video: {e}") from e
    out, at = [], 0
    for frames, seconds in parsed:
        out.append((decoded[at : at + len(frames)], seconds))
        at += len(frames)
    return out


def clips(videos: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """Timed clip rows of AVI files: id, clip, start_s, end_s, frames, error.

    Null bytes give no row; a file that can't be read gives one with its error alone.
    """

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    frames, seconds = read_avi([data])[0]
                    found = [(k, a * seconds, (b + 1) * seconds, b - a + 1, None) for k, (a, b) in enumerate(shots(frames))]
                except ValueError as e:
                    found = [(None, None, None, None, str(e))]
                columns = [list(c) for c in zip(*found)] or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r] * len(found), pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string())))],
                    ["id", "clip", "start_s", "end_s", "frames", "error"],
                )

    kind = videos.schema[id_col].dataType.simpleString()
    return videos.select(videos[id_col].alias("id"), videos[bytes_col].alias("data")).mapInArrow(scan, f"id {kind}, clip bigint, start_s double, end_s double, frames bigint, error string")


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * ((-len(data)) % UNIT if data else UNIT)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (an AVI file) of every row."""
    return _stored(docs, id_col, text_col, "media binary", lambda size, media: [pa.array(media, pa.binary())])


def _stored(docs: DataFrame, id_col: str, text_col: str, types: str, columns) -> DataFrame:
    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            payloads = [payload_of(t) for t in batch.column(1).to_pylist()]
            a = 0
            while a < len(payloads):
                b, size = a, 0
                while b < len(payloads) and (b == a or size + len(payloads[b][1]) <= 1_500_000):
                    size += len(payloads[b][1])
                    b += 1
                n = [x for x, _ in payloads[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), *columns(n, write_payloads([p for _, p in payloads[a:b]]))], ["id", "n_bytes", *(t.split()[0] for t in types.split(", "))])
                a = b

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return source.mapInArrow(scan, f"id {kind}, n_bytes bigint, {types}")


DIGESTS = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _digests(sizes: list[int], media: list[bytes]) -> list[pa.Array]:
    out = []
    for data, (frames, seconds) in zip(media, read_avi(media)):
        back = b"".join(f.tobytes() for f in frames)
        found = shots(frames)
        feature = f"{len(frames)} frames;" + ",".join(f"{a * seconds:.2f}-{(b + 1) * seconds:.2f}" for a, b in found)
        out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]


def op5_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as a video, read it back, and detect its shots."""
    return _stored(read_table(spark, sf_dir, "documents"), "doc_id", "text", DIGESTS, _digests).withColumnRenamed("id", "doc_id")
