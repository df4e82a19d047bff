"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

``decode`` reads any GIF 87a or 89a stream: global and local palettes, interlacing, frames smaller than the screen,
transparent indices, the disposal methods, delays, loop counts; it checks what it reads and raises ``GifError``.
``encode`` writes frames of palette indices.  ``payload_gif`` stores bytes as grey samples, 24 to a row, in frames of at
most ``ROWS`` rows that follow one another in time; ``payload_of`` reads them back from the stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

UNIT = 576
WIDTH = 24
ROWS = 240
BINS = 8
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


class GifError(ValueError):
    """The bytes are not a whole, well-formed GIF."""


# ---------------------------------------------------------------- LZW


def lzw_encode(data: bytes, min_size: int) -> bytes:
    """Variable-width LZW codes, least significant bit first; the table starts anew when it is full."""
    clear = 1 << min_size
    end, free = clear + 1, clear + 2
    codes = [clear]
    bounds = [0]  # where the table starts anew
    emit = codes.append
    table: dict[int, int] = {}
    get = table.get
    if data:
        it = iter(data)
        prefix = next(it)
        for b in it:
            key = prefix << 8 | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            emit(prefix)
            prefix = b
            if free < 4096:
                table[key] = free
                free += 1
            else:
                bounds.append(len(codes))
                emit(clear)
                table.clear()
                free = clear + 2
        emit(prefix)
    emit(end)
    return _pack_bits(np.array(codes, np.uint32), bounds, min_size)


def _widths(n: int, min_size: int) -> np.ndarray:
    """Bits of the first n codes from a clear code on, that one not counted."""
    free = (1 << min_size) + 2 + np.maximum(np.arange(n) - 1, 0)
    # the decoder's table is one entry behind: a code gets wider when the next free entry needs more bits
    return np.minimum(np.maximum(np.floor(np.log2(np.maximum(free, 1))).astype(np.int64) + 1, min_size + 1), 12)


def _pack_bits(codes: np.ndarray, bounds: list[int], min_size: int) -> bytes:
    widths = np.empty(len(codes), np.int64)
    longest = _widths(4200, min_size)
    for a, b in zip(bounds, [*bounds[1:], len(codes)], strict=True):
        # a clear code itself still has the width that the codes before it have led to
        widths[a] = min_size + 1 if a == 0 else longest[min(a - prev - 1, len(longest) - 1)]
        widths[a + 1 : b] = longest[: b - a - 1]
        prev = a
    starts = np.cumsum(widths) - widths
    total = int(starts[-1] + widths[-1])
    words = np.zeros(total // 64 + 2, np.uint64)
    shift = (starts & 63).astype(np.uint64)
    at = starts >> 6
    value = codes.astype(np.uint64)
    # codes do not overlap, so sums are unions of bits
    first = np.flatnonzero(np.diff(at, prepend=-1))
    low = np.add.reduceat(value << shift, first)
    words[at[first]] += low
    high = np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    over = np.flatnonzero(high)
    np.add.at(words, at[over] + 1, high[over])
    return words.astype("<u8").tobytes()[: (total + 7) // 8]


def lzw_decode(stream: bytes, min_size: int, n: int) -> bytes:
    """The n samples of an LZW code stream."""
    if not 2 <= min_size <= 11:
        raise GifError(f"LZW code size {min_size}")
    clear, end = 1 << min_size, (1 << min_size) + 1
    single = [bytes([i]) for i in range(min(clear, 256))] + [b""] * (clear - min(clear, 256)) + [b"", b""]
    bits = np.frombuffer(stream + b"\0" * 16, np.uint8)
    plan = _widths(4200, min_size)
    plan_at = np.concatenate([[0], np.cumsum(plan)])
    total = len(stream) * 8
    out: list[bytes] = []
    at, made, finished = 0, 0, False
    table, previous = list(single), b""
    while at < total and not finished and made < n:
        # codes up to the next clear code: their places follow from their number alone (12 bits once the table is full)
        count = int(np.searchsorted(plan_at, total - at, side="right")) - 1
        steady = count >= len(plan)
        if steady:
            count = len(plan)
        if not count:
            break
        codes = _codes(bits, at + plan_at[:count], plan[:count])
        stop = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stop[0]) if len(stop) else count
        width = int(plan[used]) if len(stop) else 12  # of the code that stops this run
        previous = b""
        del table[clear + 2 :]
        previous, made = _expand(codes[:used].tolist(), table, out, previous, made, n, clear)
        at += int(plan_at[used])
        while not len(stop) and steady and made < n:
            room = (total - at) // 12
            count = min(room, 4096)
            if not count:
                break
            codes = _codes(bits, at + 12 * np.arange(count), np.full(count, 12))
            stop = np.flatnonzero((codes == clear) | (codes == end))
            used = int(stop[0]) if len(stop) else count
            previous, made = _expand(codes[:used].tolist(), table, out, previous, made, n, clear)
            at += 12 * used
        if not len(stop):
            break
        finished = codes[used] == end
        at += width
    data = b"".join(out)
    if len(data) < n:
        raise GifError(f"{len(data)} of {n} samples")
    return data[:n]


def _codes(bits: np.ndarray, places: np.ndarray, widths: np.ndarray) -> np.ndarray:
    byte = places >> 3
    value = bits[byte].astype(np.uint32) | bits[byte + 1].astype(np.uint32) << 8 | bits[byte + 2].astype(np.uint32) << 16
    return (value >> (places & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)


def _expand(codes: list[int], table: list[bytes], out: list[bytes], previous: bytes, made: int, n: int, clear: int) -> tuple[bytes, int]:
    size, emit, add = len(table), out.append, table.append
    for code in codes:
        if code < size:
            entry = table[code]
        elif code == size and previous and size < 4096:
            entry = previous + previous[:1]
        else:
            raise GifError(f"code {code} with {size} entries")
        if previous and size < 4096:
            add(previous + entry[:1])
            size += 1
        emit(entry)
        previous = entry
    return previous, made + sum(map(len, out[len(out) - len(codes) :])) if codes else made


# ---------------------------------------------------------------- container


@dataclass
class Frame:
    """Palette indices of a rectangle.  disposal: 0 or 1 leave it, 2 clear it, 3 bring back what was there before."""

    indices: np.ndarray  # rows x columns
    left: int = 0
    top: int = 0
    delay: int = 0  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None  # n x 3; None: the global one
    interlaced: bool = False


@dataclass
class Gif:
    width: int
    height: int
    palette: np.ndarray | None
    background: int
    frames: list[Frame]
    loops: int | None = None


def _palette_bits(palette: np.ndarray) -> int:
    return max(1, int(np.ceil(np.log2(max(2, len(palette))))))


def _palette_bytes(palette: np.ndarray) -> bytes:
    return palette.astype(np.uint8).tobytes() + b"\0" * (3 * ((1 << _palette_bits(palette)) - len(palette)))


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def interlace_rows(height: int) -> np.ndarray:
    """Rows in the order in which an interlaced frame stores them."""
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def encode(gif: Gif) -> bytes:
    out = [b"GIF89a", struct.pack("<HH", gif.width, gif.height)]
    bits = _palette_bits(gif.palette) if gif.palette is not None else 1
    out.append(bytes([(0x80 if gif.palette is not None else 0) | 0x70 | (bits - 1), gif.background, 0]))
    if gif.palette is not None:
        out.append(_palette_bytes(gif.palette))
    if gif.loops is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", gif.loops) + b"\0")
    for f in gif.frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0) + b"\0")
        h, w = f.indices.shape
        local = 0 if f.palette is None else 0x80 | (_palette_bits(f.palette) - 1)
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, local | 0x40 * f.interlaced))
        if f.palette is not None:
            out.append(_palette_bytes(f.palette))
        own = f.palette if f.palette is not None else gif.palette
        size = max(2, _palette_bits(own) if own is not None else 8)
        rows = f.indices[interlace_rows(h)] if f.interlaced else f.indices
        out.append(bytes([size]) + _blocks(lzw_encode(rows.astype(np.uint8).tobytes(), size)))
    return b"".join(out) + b"\x3b"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise GifError("cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)


def decode(data: bytes) -> Gif:
    r = _Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF header")
    width, height, flags, background, _ = struct.unpack("<HHBBB", r.take(7))
    palette = np.frombuffer(r.take(3 << ((flags & 7) + 1)), np.uint8).reshape(-1, 3) if flags & 0x80 else None
    gif, control = Gif(width, height, palette, background, []), (0, 0, None)
    while True:
        kind = r.take(1)[0]
        if kind == 0x3B:
            return gif
        if kind == 0x21:
            label = r.take(1)[0]
            body = r.blocks()
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                control = (packed >> 2 & 7, delay, index if packed & 1 else None)
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14 and body[11] == 1:
                gif.loops = struct.unpack("<H", body[12:14])[0]
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack("<HHHHB", r.take(9))
            own = np.frombuffer(r.take(3 << ((flags & 7) + 1)), np.uint8).reshape(-1, 3) if flags & 0x80 else None
            if own is None and palette is None:
                raise GifError("a frame without a palette")
            size = r.take(1)[0]
            indices = np.frombuffer(lzw_decode(r.blocks(), size, w * h), np.uint8).reshape(h, w)
            if flags & 0x40:
                rows = np.empty_like(indices)
                rows[interlace_rows(h)] = indices
                indices = rows
            gif.frames.append(Frame(indices, left, top, control[1], control[0], control[2], own, bool(flags & 0x40)))
            control = (0, 0, None)
        elif kind:
            raise GifError(f"block {kind:#x}")


def composed(gif: Gif) -> Iterator[tuple[int, Frame, np.ndarray]]:
    """(time in hundredths of a second, frame, RGBA screen) of each frame as it is shown; what nothing has been drawn
    on is transparent."""
    screen = np.zeros((gif.height, gif.width, 4), np.uint8)
    time = 0
    for f in gif.frames:
        before = screen.copy() if f.disposal == 3 else None
        palette = f.palette if f.palette is not None else gif.palette
        h, w = f.indices.shape
        h, w = max(0, min(h, gif.height - f.top)), max(0, min(w, gif.width - f.left))
        if h and w:
            part = f.indices[:h, :w]
            if part.max() >= len(palette):
                raise GifError("an index beyond the palette")
            target = screen[f.top : f.top + h, f.left : f.left + w]
            if f.transparent is None:
                target[..., :3] = palette[part]
                target[..., 3] = 255
            else:
                drawn = part != f.transparent
                target[..., :3][drawn] = palette[part[drawn]]
                target[..., 3][drawn] = 255
        yield time, f, screen.copy()
        time += f.delay
        if f.disposal == 2:
            screen[f.top : f.top + h, f.left : f.left + w] = 0
        elif before is not None:
            screen = before


def histogram(rgba: np.ndarray, bins: int = 4) -> np.ndarray:
    """Visible pixels by colour, bins (a power of two) to a channel."""
    pixel = np.ascontiguousarray(rgba).view("<u4").ravel()
    width, shown = bins.bit_length() - 1, pixel >= 1 << 24  # alpha is the highest byte
    if not shown.all():
        pixel = pixel[shown]
    red, green, blue = (pixel >> np.uint32(8 * (c + 1) - width) & np.uint32(bins - 1) for c in range(3))
    return np.bincount(red << np.uint32(2 * width) | green << np.uint32(width) | blue, minlength=bins**3)


# ---------------------------------------------------------------- media columns


FRAMES_DDL = "id long, frame int, time_cs int, delay_cs int, width int, height int, rgba binary, histogram array<long>"


def frames(media: DataFrame) -> DataFrame:
    """media (id, media): one row for each shown frame, with its time, screen and colour histogram.  Null media has no
    frames; bytes that are not a GIF raise GifError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blob is None:
                    continue
                gif = decode(blob)
                for k, (time, f, screen) in enumerate(composed(gif)):
                    row = {"id": i, "frame": k, "time_cs": time, "delay_cs": f.delay, "width": gif.width, "height": gif.height, "rgba": screen.tobytes(), "histogram": histogram(screen).tolist()}
                    yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("id", pa.int64()), ("frame", pa.int32()), ("time_cs", pa.int32()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64()))])
    return C.pick(media, id="id", media="media").mapInArrow(run, FRAMES_DDL)


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """The payload of a text: itself, then bytes 255 up to a positive multiple of the unit."""
    return text + b"\xff" * (max(1, -(-len(text) // unit)) * unit - len(text))


def payload_gif(payload: bytes) -> bytes:
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = [Frame(pixels[at : at + ROWS], delay=10, disposal=2) for at in range(0, len(pixels), ROWS)]
    return encode(Gif(WIDTH, min(ROWS, len(pixels)), GREY, 0, parts))


def samples(f: Frame, screen: np.ndarray) -> bytes:
    """Grey samples of a shown frame: its own rectangle of the screen."""
    return screen[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1], 0].tobytes()


def payload_of(gif: Gif) -> bytes:
    """Samples of the frames as they are shown."""
    return b"".join(samples(f, screen) for _, f, screen in composed(gif))


def text_media(docs: DataFrame, keep: bool = True) -> DataFrame:
    """docs (doc_id, text) stored as GIFs and read back: sizes and digests of payload and media, frames, length in
    time, the colour histogram (``BINS`` to a channel; ``colours`` names the filled bins) of all frames as they are shown, and the
    media itself if keep.

    A null text is an empty one; equal texts give equal rows but for the id; rows with one id are stored each on its
    own; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            data, offsets = C.text_buffers(texts)
            raw = data.tobytes()
            for a, b in C.doc_runs(offsets):
                rows = {f.name: [] for f in schema}
                for i in range(a, b):
                    text = raw[offsets[i] : offsets[i + 1]]
                    media = payload_gif(padded(text))
                    gif, parts, colours = decode(media), [], np.zeros(BINS**3, np.int64)
                    for _, f, screen in composed(gif):
                        parts.append(samples(f, screen))
                        colours += histogram(screen, BINS)
                    payload = b"".join(parts)
                    rows["doc_id"].append(batch.column(0)[i].as_py())
                    rows["n_bytes"].append(len(text))
                    rows["payload_bytes"].append(len(payload))
                    rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                    rows["tail_crc32"].append(zlib.crc32(payload[-32:]))
                    rows["media_bytes"].append(len(media))
                    rows["media_sha256"].append(hashlib.sha256(media).hexdigest())
                    rows["n_frames"].append(len(gif.frames))
                    rows["length_cs"].append(sum(f.delay for f in gif.frames))
                    filled = np.flatnonzero(colours)
                    rows["colours"].append(filled)
                    rows["histogram"].append(colours[filled])
                    rows["media"].append(media if keep else None)
                yield pa.RecordBatch.from_pydict(rows, schema)
            C.trim()

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64())]
        + [("media_sha256", pa.string()), ("n_frames", pa.int32()), ("length_cs", pa.int32()), ("colours", pa.list_(pa.int64())), ("histogram", pa.list_(pa.int64())), ("media", pa.binary())]
    )
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, length_cs int, colours array<long>, histogram array<long>, media binary"
    return C.pick(docs, doc_id="doc_id", text="text").mapInArrow(run, ddl)


def op5_gif_media(spark, sf_dir: str) -> DataFrame:
    rows = text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)
    filled = "transform(arrays_zip(colours, histogram), x -> concat(x.colours, ':', x.histogram))"
    feature = f"concat_ws(';', concat('frames=', n_frames), concat('cs=', length_cs), concat('colours=', concat_ws(',', {filled}))) AS feature"
    return rows.selectExpr("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)
