"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

``encode_gif`` and ``decode_gif`` implement the format on bytes; ``store_texts`` keeps texts as GIF columns and
``read_frames`` turns GIF columns into one row per composited frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import text_chunks

#: Payloads are padded to a positive multiple of this many bytes, which is also the frame width in pixels.
ROW = 192
#: Rows of pixels in a frame that holds text bytes, and its time on screen in hundredths of a second.
FRAME_ROWS, DELAY = 240, 10
#: Steps of each colour channel in a histogram.
LEVELS = 4
#: Largest screen and frame that is decoded, in pixels: four bytes each are held for the canvas, and as much again for a copy.
MAX_PIXELS = 1 << 24
KEEP, TO_BACKGROUND, TO_PREVIOUS = 1, 2, 3
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
_TABLE = 4096


@cache
def _widths(root: int) -> np.ndarray:
    """Bits of the j-th code after a clear code, from 0 on, for a root size in bits."""
    reached = (1 << root) + 1 + np.arange(_TABLE + 2)
    reached[0] = 1 << root
    return np.minimum(12, np.floor(np.log2(np.maximum(reached, 1))).astype(np.int64) + 1)


@cache
def _schedule(root: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, first bit) of the codes after a clear code, further than a full table goes."""
    widths = np.concatenate([_widths(root), np.full(_TABLE, 12)])  # its last value goes on if no clear code comes
    return widths, np.cumsum(widths) - widths


def _trie(root: int) -> list[dict[int, int | dict]]:
    """One node per sample; a node has its children by sample, and its own code under -1."""
    return [{-1: i} for i in range(1 << root)]


def lzw_encode(data: bytes, root: int = 8) -> bytes:
    """GIF LZW stream of samples of ``root`` bits (2 to 8), without sub-blocks."""
    clear, end = 1 << root, (1 << root) + 1
    segments: list[list[int]] = [[]]
    codes = segments[0]
    if data:
        nodes, nxt = _trie(root), end + 1
        node = nodes[data[0]]
        for b in data[1:]:
            if b in node:
                node = node[b]
                continue
            codes.append(node[-1])
            if nxt < _TABLE:
                node[b] = {-1: nxt}
                nxt += 1
            else:
                codes.append(clear)
                codes = []
                segments.append(codes)
                nodes, nxt = _trie(root), end + 1
            node = nodes[b]
        codes.append(node[-1])
    codes.append(end)
    widths = _widths(root)
    values = np.concatenate([np.array([clear]), *(np.array(s, np.int64) for s in segments)])
    bits = np.concatenate([np.array([root + 1]), *(widths[: len(s)] for s in segments)])
    out, carry = [], np.zeros(0, np.uint8)
    places = np.arange(12)
    for at in range(0, len(values), 1 << 16):
        v, w = values[at : at + (1 << 16), None], bits[at : at + (1 << 16), None]
        stream = np.concatenate([carry, (v >> places & 1).astype(np.uint8)[places < w]])
        whole = len(stream) // 8 * 8
        out.append(np.packbits(stream[:whole], bitorder="little").tobytes())
        carry = stream[whole:]
    return b"".join(out) + np.packbits(carry, bitorder="little").tobytes()


def _expand(codes: np.ndarray, root: int, most: int) -> np.ndarray:
    """Samples of the codes between two clear codes; about ``most`` of them are made, whole codes only.

    The j-th code after a clear code adds one table entry: the samples of code j and the first one of code j + 1. A
    code thus is a root or points at an earlier code, whose samples it has with one more.
    """
    first_entry = (1 << root) + 2
    is_root = codes < first_entry
    parent = np.where(is_root, np.arange(len(codes)), codes - first_entry)
    if is_root.size and not is_root[0]:
        raise ValueError("the LZW stream starts with an unknown code")
    if (parent > np.arange(len(codes)) - ~is_root).any():
        raise ValueError("the LZW stream has an unknown code")
    top, length = parent, np.where(is_root, 1, 2)
    while not is_root[top].all():
        length, top = length + length[top] - 1, top[top]
    ends = np.cumsum(length)
    n = int(np.searchsorted(ends, most)) + 1
    codes, is_root, parent, top, ends = codes[:n], is_root[:n], parent[:n], top[:n], ends[:n]
    if not len(codes):
        return np.zeros(0, np.uint8)
    first = codes[top].astype(np.uint8)
    last = np.where(is_root, first, first[np.minimum(parent + 1, len(codes) - 1)])
    out = np.empty(int(ends[-1]), np.uint8)
    at, source = ends - 1, np.arange(len(codes))
    while len(at):  # one sample of every code at a time, from its last one on
        out[at] = last[source]
        more = np.flatnonzero(~is_root[source])
        at, source = at[more] - 1, parent[source[more]]
    return out


def lzw_decode(stream: bytes, root: int, size: int) -> bytes:
    """Samples of a GIF LZW stream; ``size`` of them, or ValueError."""
    clear, end = 1 << root, (1 << root) + 1
    raw = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    windows = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    widths, offsets = _schedule(root)
    out, got, at, total_bits = [], 0, 0, 8 * len(stream)
    parts, place = [], 0
    while got < size:
        n = int(np.searchsorted(offsets[place:] + widths[place:] - offsets[place], total_bits - at, side="right"))
        where = at + offsets[place : place + n] - offsets[place]
        codes = (windows[where >> 3] >> (where & 7).astype(np.uint32)).astype(np.int64) & (1 << widths[place : place + n]) - 1
        marks = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(marks[0]) if len(marks) else n
        parts.append(codes[:stop])
        if n and stop == n:  # codes go on with a full table
            at += int(offsets[place + n - 1] - offsets[place] + widths[place + n - 1])
            place = min(place + n, _TABLE)
            continue
        made = _expand(np.concatenate(parts), root, size - got)
        out.append(made)
        got += len(made)
        if not n or codes[stop] == end:
            break
        at += int(offsets[place + stop] - offsets[place] + widths[place + stop])
        parts, place = [], 0
    if got < size:
        raise ValueError("the LZW stream has too few samples")
    return b"".join(o.tobytes() for o in out)[:size]


@dataclass
class Frame:
    """One image of a GIF: palette indices in their own rectangle, and how it is shown."""

    pixels: np.ndarray
    left: int = 0
    top: int = 0
    delay: int = 0
    disposal: int = KEEP
    transparent: int | None = None
    palette: np.ndarray | None = None
    interlaced: bool = False


def _table_bits(palette: np.ndarray) -> int:
    return max(1, (len(palette) - 1).bit_length())


def _colour_table(palette: np.ndarray) -> bytes:
    full = np.zeros((1 << _table_bits(palette), 3), np.uint8)
    full[: len(palette)] = palette
    return full.tobytes()


def _interlaced_rows(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def encode_gif(frames: list[Frame], palette: np.ndarray = GREY, width: int | None = None, height: int | None = None, background: int = 0) -> bytes:
    """A GIF89a file of ``frames`` with a global palette of 2 to 256 colours."""
    width = width or max(f.left + f.pixels.shape[1] for f in frames)
    height = height or max(f.top + f.pixels.shape[0] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | _table_bits(palette) - 1, background, 0), _colour_table(palette)]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay, f.transparent or 0) + b"\x00")
        local = f.palette is not None
        own = f.palette if local else palette
        flags = local << 7 | f.interlaced << 6 | (_table_bits(own) - 1 if local else 0)
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.pixels.shape[1], f.pixels.shape[0], flags))
        if local:
            out.append(_colour_table(own))
        root = max(2, _table_bits(own))
        pixels = f.pixels[_interlaced_rows(len(f.pixels))] if f.interlaced else f.pixels
        stream = lzw_encode(np.ascontiguousarray(pixels, np.uint8).tobytes(), root)
        out.append(bytes([root]))
        out += [bytes([len(block)]) + block for block in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\x00")
    return b"".join(out) + b"\x3b"


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def _read(data: bytes, max_pixels: int) -> Iterator[tuple[int, int] | Frame]:
    """The screen's width and height, then frame by frame."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > max_pixels:
        raise ValueError(f"a screen of {width} x {height} is over {max_pixels} pixels")
    yield width, height
    at, colours = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    control = (0, 0, None)
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            body, after = _sub_blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                flags, delay, index = struct.unpack_from("<BHB", body)
                control = (flags >> 2 & 7, delay, index if flags & 1 else None)
            at = after
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            if w * h > max_pixels:
                raise ValueError(f"a frame of {w} x {h} is over {max_pixels} pixels")
            at, own = at + 10, colours
            if flags & 0x80:
                n = 2 << (flags & 7)
                own = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            if own is None:
                raise ValueError("a frame has no palette")
            root = data[at]
            if not 2 <= root <= 8:
                raise ValueError("a frame's code size is not 2 to 8")
            stream, at = _sub_blocks(data, at + 1)
            pixels = np.frombuffer(lzw_decode(stream, root, w * h), np.uint8).reshape(h, w)
            if flags & 0x40:
                rows = np.empty_like(pixels)
                rows[_interlaced_rows(h)] = pixels
                pixels = rows
            if pixels.size and pixels.max() >= len(own):
                raise ValueError("a pixel is outside its palette")
            yield Frame(pixels, left, top, control[1], control[0], control[2], own, bool(flags & 0x40))
            control = (0, 0, None)
        else:
            raise ValueError("unknown block")


def _whole(parts: Iterator) -> Iterator:
    try:
        yield from parts
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF ends early") from e


def decode_gif(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame with the canvas that it leaves on screen: height x width x RGBA.

    The canvas starts transparent. Transparent pixels leave what is there; disposal 2 clears the frame's
    rectangle afterwards, disposal 3 puts back what was there before. Broken files raise ValueError, and so do
    screens and frames of more than ``max_pixels``; one frame at a time is held.
    """
    frames = _whole(_read(data, max_pixels))
    width, height = next(frames)
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == TO_PREVIOUS else None
        h, w = (max(0, min(n, m)) for n, m in zip(f.pixels.shape, (height - f.top, width - f.left), strict=True))
        indices = f.pixels[:h, :w]
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        if f.transparent is None:
            area[..., :3], area[..., 3] = f.palette[indices], 255
        else:
            shown = indices != f.transparent
            area[shown, :3], area[shown, 3] = f.palette[indices[shown]], 255
        yield f, canvas.copy()
        if f.disposal == TO_BACKGROUND:
            area[...] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Counts of the visible pixels by red, green and blue level, ``levels`` ** 3 of them."""
    step = np.arange(256) * levels >> 8
    red, green, blue = (step * levels**k for k in (2, 1, 0))
    bins = red[canvas[..., 0]] + green[canvas[..., 1]] + blue[canvas[..., 2]]
    return np.bincount(bins[canvas[..., 3] > 0], minlength=levels**3)


def text_to_gif(text: str) -> tuple[bytes, int]:
    """(GIF, unpadded bytes): the text's UTF-8 and spaces up to a positive multiple of ROW, as grey frames of ROW pixels a row."""
    raw = text.encode("utf-8", "surrogatepass")
    payload = raw + b" " * (-len(raw) % ROW if raw else ROW)
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return encode_gif([Frame(pixels[i : i + FRAME_ROWS], delay=DELAY) for i in range(0, len(pixels), FRAME_ROWS)]), len(raw)


def gif_to_payload(data: bytes) -> tuple[bytes, np.ndarray]:
    """The payload that ``text_to_gif`` stored, and the histogram summed over its composited frames."""
    parts, counts = [], np.zeros(LEVELS**3, np.int64)
    for f, canvas in decode_gif(data):
        shown = canvas[f.top : f.top + f.pixels.shape[0], f.left : f.left + f.pixels.shape[1]]
        parts.append(np.ascontiguousarray(shown[..., 0]).tobytes())
        counts += histogram(shown)
    return b"".join(parts), counts


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as a GIF.

    Null texts count as empty; equal texts and repeated rows give equal media; texts of any length become more
    frames. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "_text"):
            made = [text_to_gif(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([m for m, _ in made], pa.binary())], names=["_id", "n_bytes", "media"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("_id", id_col)


def read_payloads(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and a feature string of what GIFs of ``store_texts`` hold, from the decoded and composited frames.

    One row a row, repeated ones too; an empty table gives no rows; other columns are ignored. Media that
    ``store_texts`` did not write, and nulls, are for ``read_frames``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for value in part.column(2):
                    stored = value.as_py()
                    payload, counts = gif_to_payload(stored)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), ",".join(map(str, counts[np.arange(LEVELS) * (LEVELS**2 + LEVELS + 1)].tolist()))))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    source = media.select(F.col(id_col).alias("_id"), "n_bytes", "media")
    schema = f"_id {source.schema['_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def read_frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: id, frame, shown_at_ms, delay_ms, left, top, width, height, disposal, histogram, error.

    A null or broken file, and one of more than MAX_PIXELS pixels a frame, gives one row with its error and nulls;
    a file without frames gives none. Repeated rows are read each on their own; an empty table gives no rows;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 8 + [pa.list_(pa.int64()), pa.string()]
        names = ["frame", "shown_at_ms", "delay_ms", "left", "top", "width", "height", "disposal", "histogram", "error"]
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: its frames bound the memory
                rows, clock = [], 0
                try:
                    data = batch.column(1)[i].as_py()
                    if data is None:
                        raise ValueError("no file")
                    for k, (f, canvas) in enumerate(decode_gif(data)):
                        rows.append((k, clock, 10 * f.delay, f.left, f.top, f.pixels.shape[1], f.pixels.shape[0], f.disposal, histogram(canvas).tolist(), None))
                        clock += 10 * f.delay
                except ValueError as e:
                    rows = [(None,) * 9 + (str(e),)]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                ids = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["_id", *names])

    source = media.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_media"))
    longs = ", ".join(f"{n} long" for n in ("frame", "shown_at_ms", "delay_ms", "left", "top", "width", "height", "disposal"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, {longs}, histogram array<long>, error string").withColumnRenamed("_id", id_col)
