"""WARC archives and GIF columns: round trips, and streams made by hand."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from eavspark.llm import gif, warc
from eavspark.llm.shared import new_path

PAGES = "page_id long, url string, html string, digest string, payload string, row long"


def b32(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_archive(spark):
    rows = [(5, "http://x/5", "<p>a</p>"), (2, "http://x/2", "<p>a</p>"), (9, None, None), (7, "http://x/7", ""), (3, "http://é/3\r\nX: y", "日本 <b>"), (None, "u", "<p>a</p>"), (4, "q", "z" * 200_000), (5, "http://x/5", "<p>a</p>")]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([(*r, "d", "p", 1) for r in rows], PAGES).repartition(3), path)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    a = b"<p>a</p>"
    assert by[2] == [(8, b32(a), "response", None)] and by[5] == [(8, b32(a), "revisit", 2)] * 2 and by[None] == [(8, b32(a), "revisit", 2)]
    assert by[7] == [(0, b32(b""), "response", None)] and by[9] == [(0, b32(b""), "revisit", 7)]
    assert by[3] == [(len("日本 <b>".encode()), b32("日本 <b>".encode()), "response", None)]
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == 4
    for r in warc.records(spark, path).collect():
        head = bytes(r.header)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and head.endswith(b"\r\n\r\n") and b"\nX: y" not in head
        body = b"" if b"revisit" in head else bytes(r.payload)
        assert bytes(r.record) == head + body + b"\r\n\r\n" and f"Content-Length: {len(body)}\r\n".encode() in head


def test_archive_of_odd_urls(spark):
    """A url that tries to begin a line of its own stays in its line."""
    rows = [(k, f"http://a{c}X-Page: 999{c}WARC-Type: revisit", f"p{k}") for k, c in enumerate(["\r\n", "\n", "\r", "\x85", "\u2028", "\u2029", "\x0b", "\x00"])]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([(*r, "", "", 1) for r in rows], PAGES), path)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert set(got) == set(range(len(rows))) and all(r.verified and r.record_type == "response" for r in got.values())
    assert got[4].url == "http://a%E2%80%A8X-Page: 999%E2%80%A8WARC-Type: revisit" and got[0].url.startswith("http://a%0D%0AX-Page")
    kept = spark.read.parquet(f"{path}/payloads").orderBy("digest").collect()
    spark.createDataFrame(kept[1:], "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    less = warc.read(spark, path).collect()
    assert len(less) == len(rows) and sum(not r.verified for r in less) == 1


def test_archive_threshold_and_nothing(spark):
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([(1, "a", "xx", "", "", 1), (2, "b", "xx", "", "", 1)], PAGES), path, least=3)
    assert {r.record_type for r in warc.read(spark, path).collect()} == {"response"}
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([], PAGES), path)
    assert warc.read(spark, path).count() == 0


@pytest.mark.parametrize("n", [24, 576, 576 * 3, gif.ROWS * 24, gif.ROWS * 24 + 576])
@pytest.mark.parametrize("kind", ["text", "noise", "one"])
def test_gif_round_trip(n, kind):
    rng = random.Random(n)
    payload = rng.randbytes(n) if kind == "noise" else bytes(rng.choice(b"the quick brown fox ") for _ in range(n)) if kind == "text" else b"\xff" * n
    width, height, shown = gif.frames(gif.encode(payload))
    assert b"".join(f.samples for f in shown) == payload and width == 24 and height == min(gif.ROWS, n // 24)


def slow_lzw(data, low, count):
    """Code by code, from the format's own words."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    at, width, table, last, out = 0, low + 1, None, None, b""
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == 1 << low:
            table, width, last = {k: bytes([k]) for k in range(1 << low)}, low + 1, None
            n = (1 << low) + 2
            continue
        if code == (1 << low) + 1:
            return out[:count]
        entry = table[code] if code in table else last + last[:1]
        out += entry
        if last is not None and n < 4096:
            table[n] = last + entry[:1]
            n += 1
            if n == 1 << width and width < 12:
                width += 1
        last = entry


def test_code_streams_agree_with_a_slow_reader():
    rng = random.Random(4)
    for low, n in ((8, 30_000), (2, 5000), (4, 700)):
        data = bytes(rng.randrange(1 << low) for _ in range(n))
        stream = gif.lzw(data, low)
        assert slow_lzw(stream, low, n) == data == gif.unlzw(stream, low, n)


def test_deferred_clear():
    """An encoder may go on with a full table; the reader then adds nothing."""
    rng = random.Random(1)
    data = bytes(rng.randrange(4) for _ in range(60_000))
    table, codes, w, n = {bytes([k]): k for k in range(4)}, [4], b"", 6
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        codes.append(table[w])
        if n < 4096:
            table[w + bytes([b])] = n
            n += 1
        w = bytes([b])
    codes += [table[w], 5]
    assert len(codes) > 5000
    stream = gif.pack_bits(np.array(codes), np.concatenate([[3], gif.widths(len(codes) - 1, 2)]))
    assert gif.unlzw(stream, 2, len(data)) == data


def by_hand(frames, width=2, height=2, palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff"):
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | 1, 0, 0) + palette
    for samples, (left, top, w, h), disposal, clear, interlaced in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced) + b"\x02" + gif.blocks(gif.lzw(bytes(samples), 2))
    return out + b"\x21\xfe\x03abc\0\x3b"


def test_disposal_and_transparency():
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    data = by_hand([([1, 1, 1, 1], (0, 0, 2, 2), 1, None, 0), ([2, 3], (0, 0, 2, 1), 3, 3, 0), ([3], (1, 1, 1, 1), 2, None, 0), ([2], (0, 0, 1, 1), 0, None, 0)])
    canvases = [c for _, c in gif.composed(data)]
    look = lambda c: [tuple(map(int, p)) for p in c.reshape(-1, 4)]
    assert look(canvases[0]) == [red] * 4
    assert look(canvases[1]) == [green, red, red, red]  # 3 is transparent
    assert look(canvases[2]) == [red, red, red, blue]  # the second was put back
    assert look(canvases[3]) == [green, red, red, none]  # the third was cleared


def test_interlaced():
    rows = list(range(16))
    order = [*range(0, 16, 8), *range(4, 16, 8), *range(2, 16, 4), *range(1, 16, 2)]
    data = by_hand([([rows[k] % 4 for k in order], (0, 0, 1, 16), 0, None, 1)], 1, 16)
    assert list(gif.frames(data)[2][0].samples) == [k % 4 for k in rows]


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"PNG", gif.encode(b"a" * 24)[:-9]])
def test_broken_streams(data):
    with pytest.raises(ValueError):
        gif.frames(data)


def test_gif_query(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (None, "x" * 576), (4, "é" * 30_000), (1, "hello")]
    docs = spark.createDataFrame([(k, t, 1, "m") for k, t in rows], "doc_id long, text string, n_bytes long, media string")
    got = gif.features(gif.store(docs)).collect()
    assert len(got) == len(rows)
    for k, t in rows:
        n, p = gif.payload(t)
        r = next(r for r in got if r.doc_id == k and r.n_bytes == n)
        assert len(p) % 576 == 0 and len(p) > 0 and (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(gif.encode(p)).hexdigest() and r.media_bytes == len(gif.encode(p))
        # every sample is a grey pixel, on top of the frame before
        size, total = gif.ROWS * gif.WIDTH, [0] * 16
        canvas = bytearray(min(size, len(p)))
        for at in range(0, len(p), size):
            canvas[: len(p[at : at + size])] = p[at : at + size]
            for b in canvas:
                total[b // 16] += 1
        steps, count = ",".join(map(str, total)), -(-len(p) // size)
        assert r.feature == f"frames={count};time={10 * count};red={steps};green={steps};blue={steps}"
    assert len({tuple(r) for r in got if r.doc_id == 1}) == 1 and gif.features(gif.store(docs.limit(0))).count() == 0
    media = gif.store(docs).select("doc_id", "media")
    frames = gif.frame_table(media.unionByName(spark.createDataFrame([(77, b"junk"), (78, None)], "doc_id long, media binary"))).collect()
    assert [(r.frame, r.at) for r in sorted(frames, key=lambda r: r.frame or 0) if r.doc_id == 4] == [(0, 0), (1, 10)] and {r.frame for r in frames if r.doc_id in (77, 78)} == {None}


def test_opaque_canvas_is_not_copied():
    """Histograms count in place where every pixel is seen, and give what a loop over pixels gives where not."""
    import tracemalloc

    rng = np.random.default_rng(3)
    canvas = rng.integers(0, 256, (1536, 24, 4)).astype(np.uint8)
    canvas[..., 3] = 255
    tracemalloc.start()
    gif.histogram(canvas)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 11 * 1536 * 24
    for alpha in (255, rng.choice([0, 255], (1536, 24)), 0):
        canvas[..., 3] = alpha
        seen = [p for p in canvas.reshape(-1, 4).tolist() if p[3] == 255]
        assert gif.histogram(canvas) == [sum(p[c] // 16 == k for p in seen) for c in range(3) for k in range(16)]
