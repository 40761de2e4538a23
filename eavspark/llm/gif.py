"""GIF as a media column: bytes to frames and back, with the format's own code streams.

``encode`` lays a payload out as 8-bit samples, 24 to a row, in one or more frames of a
GIF89a stream with a grey palette. ``decode`` reads any GIF87a or GIF89a stream: global
and local palettes, interlacing, LZW with changing code widths, clear codes and deferred
clears, transparency, and the disposal of frames.
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
from pyspark.sql import functions as F

from eavspark.llm.shared import stage

WIDTH, UNIT = 24, 576
#: Rows of a frame at most: 64 units.
ROWS = 24 * 64
DELAY = 10  # hundredths of a second
GREY = bytes(v for k in range(256) for v in (k, k, k))
#: Bins of a histogram of one colour channel.
BINS = 16


def widths(count: int, low: int) -> np.ndarray:
    """Bits of each of ``count`` codes after a clear code; ``low`` is the bits of a sample.

    The n-th code after a clear is read when n - 1 entries have been added to the 2**low + 2.
    """
    added = np.maximum(np.arange(count) - 1, 0)
    entries = (1 << low) + 2 + added
    return np.minimum(12, np.maximum(low + 1, np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1))


def pack_bits(codes: np.ndarray, bits: np.ndarray) -> bytes:
    """Codes of the given widths, least significant bit first."""
    at = np.concatenate([[0], np.cumsum(bits)])
    out = np.zeros(int(at[-1] + 7) // 8 + 3, np.uint32)
    shifted = codes.astype(np.uint32) << (at[:-1] & 7).astype(np.uint32)
    byte = at[:-1] >> 3
    # codes overlap in bytes but not in bits, so sums are unions
    size = len(out)
    total = np.bincount(byte, shifted & 255, size) + np.bincount(byte + 1, (shifted >> 8) & 255, size) + np.bincount(byte + 2, shifted >> 16, size)
    return total.astype(np.uint8).tobytes()[: int(at[-1] + 7) // 8]


def lzw(samples: bytes, low: int = 8) -> bytes:
    """The code stream of samples: a clear first, one whenever the table is full, the end code."""
    clear, end = 1 << low, (1 << low) + 1
    out, runs = [clear], []
    table: dict[int, int] = {}
    find, add, n = table.get, out.append, end + 1
    stream = iter(samples)
    code = next(stream, None)
    if code is not None:
        for sample in stream:
            key = code << 8 | sample
            known = find(key)
            if known is not None:
                code = known
                continue
            add(code)
            if n < 4096:
                table[key] = n
                n += 1
            else:
                add(clear)
                runs.append(len(out))
                table.clear()
                n = end + 1
            code = sample
        add(code)
    add(end)
    # The code that opens the stream and those that clear have the width of their own run.
    bits, last = [np.array([low + 1])], 1
    for stop in [*runs, len(out)]:
        bits.append(widths(stop - last, low))
        last = stop
    return pack_bits(np.array(out), np.concatenate(bits))


def unlzw(data: bytes, low: int, count: int) -> bytes:
    """Samples of a code stream; ``count`` is how many the frame holds."""
    clear, end = 1 << low, (1 << low) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, at = len(data) * 8, 0
    parts: list[bytes] = []
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    have = 0

    def codes(start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to n codes from bit ``start``, as if no clear code came; and where each ends."""
        bits = widths(n, low)
        stops = start + np.cumsum(bits)
        n = int(np.searchsorted(stops, total, "right"))
        bits, stops = bits[:n], stops[:n]
        first = stops - bits
        byte = first >> 3
        window = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        return (window >> (first & 7).astype(np.uint32)) & ((1 << bits) - 1).astype(np.uint32), stops

    while at < total and have < count:
        ask = 4096
        while True:
            found, stops = codes(at, ask)
            marks = np.flatnonzero((found == clear) | (found == end))
            if len(marks) or len(found) < ask:
                break
            ask *= 4  # an encoder that defers its clear
        stop = int(marks[0]) if len(marks) else len(found)
        table = base.copy()
        last = b""
        push, size = table.append, len(table)
        for code in found[:stop].tolist():
            if code < size:
                entry = table[code]
                if last and size < 4096:
                    push(last + entry[:1])
                    size += 1
            elif code == size and last and size < 4096:
                entry = last + last[:1]
                push(entry)
                size += 1
            else:
                raise ValueError(f"code {code} is not in a table of {size}")
            parts.append(entry)
            last = entry
            have += len(entry)
        if stop >= len(found) or found[stop] == end:
            break
        at = int(stops[stop])
    return b"".join(parts)[:count]


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part := data[k : k + 255])]) + part for k in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, rows: int = ROWS) -> bytes:
    """A payload of a positive multiple of 24 bytes as a GIF; frames of up to ``rows`` rows follow in time."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload fills whole rows")
    height = min(rows, len(payload) // WIDTH)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), GREY]
    for k in range(0, len(payload), rows * WIDTH):
        part = payload[k : k + rows * WIDTH]
        out += [
            b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY, 0, 0),
            b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", blocks(lzw(part)),
        ]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """Samples as they lie in the file (row by row), and how they are shown."""

    left: int
    top: int
    width: int
    height: int
    samples: bytes
    palette: np.ndarray
    delay: int
    disposal: int
    clear: int | None


def frames(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a GIF stream; ValueError if it isn't one."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
        at, shared, out = 13, None, []
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        control = (0, 0, None)

        def sub(at: int) -> tuple[bytes, int]:
            parts = []
            while n := data[at]:
                parts.append(data[at + 1 : at + 1 + n])
                at += n + 1
            return b"".join(parts), at + 1

        while (kind := data[at]) != 0x3B:
            if kind == 0x21:
                label = data[at + 1]
                body, at = sub(at + 2)
                if label == 0xF9:
                    bits, delay, clear = struct.unpack_from("<BHB", body)
                    control = (delay, bits >> 2 & 7, clear if bits & 1 else None)
            elif kind == 0x2C:
                left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
                at += 10
                palette = shared
                if bits & 0x80:
                    n = 3 << (bits & 7) + 1
                    palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
                    at += n
                low = data[at]
                body, at = sub(at + 1)
                samples = unlzw(body, low, w * h).ljust(w * h, b"\0")
                if bits & 0x40:
                    lines = np.frombuffer(samples, np.uint8).reshape(h, w)
                    order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                    whole = np.empty_like(lines)
                    whole[order] = lines
                    samples = whole.tobytes()
                out.append(Frame(left, top, w, h, samples, palette, *control))
                control = (0, 0, None)
            else:
                raise ValueError(f"unknown block {kind}")
    except (IndexError, struct.error) as e:
        raise ValueError("the stream ends early") from e
    return width, height, out


def composed(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Delay and canvas (height, width, RGBA) of each frame, with disposal and transparency applied."""
    yield from compose(*frames(data))


def compose(width: int, height: int, all_frames: list[Frame]) -> Iterator[tuple[int, np.ndarray]]:
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in all_frames:
        before = canvas.copy() if f.disposal == 3 else None
        box = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        samples = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)[: box.shape[0], : box.shape[1]]
        palette = f.palette if f.palette is not None else np.frombuffer(GREY, np.uint8).reshape(-1, 3)
        colours = palette[np.minimum(samples, len(palette) - 1)]
        if f.clear is None:
            box[..., :3], box[..., 3] = colours, 255
        else:
            shown = samples != f.clear
            box[shown, :3], box[shown, 3] = colours[shown], 255
        yield f.delay, canvas.copy()
        if f.disposal == 2:
            box[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> list[int]:
    """Pixels of each of ``BINS`` steps of red, green and blue, opaque ones only."""
    opaque = canvas[..., 3] == 255
    seen = canvas.reshape(-1, 4) if opaque.all() else canvas[opaque]
    return np.concatenate([np.bincount(seen[:, c], minlength=256).reshape(BINS, -1).sum(axis=1) for c in range(3)]).tolist()


def payload(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    """Bytes of the text, and those with bytes 255 behind them up to a positive multiple of ``unit``."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw.ljust(max(1, -(-len(raw) // unit)) * unit, b"\xff")


def store(documents: DataFrame) -> DataFrame:
    """Write each whole text as a GIF: doc_id, n_bytes, media; and read the table back.

    A null text is an empty one, which is one unit of padding. Ids may be null or
    repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                made = [payload(t.as_py()) for t in rows["text"]]
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array([n for n, _ in made], pa.int64()), pa.array([encode(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"]
                )

    return stage(documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "gif")


#: A shown frame: when it comes and how long it stays (hundredths of a second), its size, and its opaque pixels by steps of each colour channel.
FRAME = "struct<at: long, delay: long, width: int, height: int, red: array<long>, green: array<long>, blue: array<long>>"


def timed(shown: Iterator[tuple[int, np.ndarray]]) -> list[dict]:
    """Shown frames with their times and histograms."""
    out, at = [], 0
    for delay, canvas in shown:
        counts = histogram(canvas)
        colours = {c: counts[k * BINS : (k + 1) * BINS] for k, c in enumerate(("red", "green", "blue"))}
        out.append({"at": at, "delay": delay, "width": canvas.shape[1], "height": canvas.shape[0], **colours})
        at += delay
    return out


def decoded(stored: DataFrame) -> DataFrame:
    """Decode the media column and store its timed frames beside the figures of what was decoded: one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                out = []
                for media in rows["media"].to_pylist():
                    width, height, found = frames(media)
                    samples = b"".join(f.samples for f in found)
                    out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), timed(compose(width, height, found))))
                columns = list(zip(*out))
                bins = pa.list_(pa.int64())
                frame = pa.struct([("at", pa.int64()), ("delay", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("red", bins), ("green", bins), ("blue", bins)])
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(frame))
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["n_bytes"], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames"],
                )

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames array<{FRAME}>"
    return stage(stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema), "frames")


def features(stored: DataFrame) -> DataFrame:
    """Sizes and digests of the samples and of the stored form of each document's media, and a feature of its stored frames.

    The feature names the frames, their time, and the histogram of each colour channel over all of them.
    """
    none = F.array_repeat(F.lit(0).cast("long"), BINS)
    total = lambda c: F.array_join(F.aggregate(f"frames.{c}", none, lambda x, y: F.zip_with(x, y, lambda a, b: a + b)).cast("array<string>"), ",")
    time = F.aggregate("frames.delay", F.lit(0).cast("long"), lambda x, y: x + y)
    feature = F.concat(F.lit("frames="), F.size("frames").cast("string"), F.lit(";time="), time.cast("string"), *[x for c in ("red", "green", "blue") for x in (F.lit(f";{c}="), total(c))])
    return decoded(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def frame_table(media: DataFrame) -> DataFrame:
    """One row a shown frame of a table (doc_id, media): doc_id, frame, and the columns of FRAME.

    A null or broken stream gives one row with a null frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("at", "delay", "width", "height", "red", "green", "blue")
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "frame", *names)}
            for doc_id, data in zip(batch["doc_id"].to_pylist(), batch["media"].to_pylist()):
                try:
                    shown = list(enumerate(timed(composed(data or b""))))
                except ValueError:
                    shown = [(None, dict.fromkeys(names))]
                for k, row in shown:
                    out["doc_id"].append(doc_id), out["frame"].append(k)
                    for c in names:
                        out[c].append(row[c])
            bins = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), bins, bins, bins)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    schema = "doc_id long, frame int, at long, delay long, width int, height int, red array<long>, green array<long>, blue array<long>"
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, schema)
