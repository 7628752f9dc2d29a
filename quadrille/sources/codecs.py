"""Binary formats in pure Python: PNG (gray + alpha), GeoTIFF (float64, stripped or tiled, deflate or none), LAS 1.2 points."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..errors import SourceError


def png_gray(gray: np.ndarray, alpha: np.ndarray) -> bytes:
    h, w = gray.shape
    rows = np.zeros((h, 1 + 2 * w), np.uint8)
    rows[:, 1::2], rows[:, 2::2] = gray, alpha
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 4, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png_gray(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of a PNG that png_gray wrote (no row filters)."""
    at, body, w, h = 8, b"", 0, 0
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h = struct.unpack(">II", part[:8])
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 2 * w)
    return rows[:, 1::2], rows[:, 2::2]


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8}
_FORMS = {1: "B", 3: "H", 4: "I", 12: "d"}


def write_geotiff(bands: np.ndarray, x0: float, y0: float, size: float, epsg: int) -> bytes:
    """bands: (count, height, width) float64, nodata NaN. One deflated strip, bands interleaved by pixel."""
    count, h, w = bands.shape
    body = zlib.compress(np.ascontiguousarray(np.moveaxis(bands, 0, -1)).astype("<f8").tobytes())
    geographic = epsg == 4326
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg & 0xFFFF]
    tags = {
        256: (4, [w]), 257: (4, [h]), 258: (3, [64] * count), 259: (3, [8]), 262: (3, [1]), 273: (4, [0]), 277: (3, [count]), 278: (4, [h]), 279: (4, [len(body)]), 284: (3, [1]),
        339: (3, [3] * count), 33550: (12, [size, size, 0.0]), 33922: (12, [0.0, 0.0, 0.0, x0, y0, 0.0]), 34735: (3, keys), 42113: (2, b"nan\0"),
    }
    if count > 1:
        tags[338] = (3, [0] * (count - 1))
    at = 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", {}
    for tag in sorted(tags):
        kind, values = tags[tag]
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{_FORMS[kind]}", *values)
        if len(raw) > 4:
            entries[tag] = (kind, len(values), struct.pack("<I", at + len(extra)))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries[tag] = (kind, len(values), raw.ljust(4, b"\0"))
    entries[273] = (4, 1, struct.pack("<I", at + len(extra)))
    out = b"II*\0" + struct.pack("<IH", 8, len(tags))
    return out + b"".join(struct.pack("<HHI", t, *entries[t][:2]) + entries[t][2] for t in sorted(entries)) + struct.pack("<I", 0) + extra + body


class GeoTiff:
    """Directories of a little- or big-endian TIFF: the full image and its overviews; windows decode only the blocks they touch."""

    def __init__(self, read, length: int | None = None):
        """read(offset, length) -> bytes, or the bytes of the whole file."""
        self.read = (lambda o, n, data=read: data[o : o + n]) if isinstance(read, (bytes, bytearray, memoryview)) else read
        head = bytes(self.read(0, 8))
        if head[:4] not in (b"II*\0", b"MM\0*"):
            raise SourceError("not a TIFF file")
        self.end = "<" if head[:2] == b"II" else ">"
        at, self.pages = struct.unpack(self.end + "I", head[4:])[0], []
        while at:
            n = struct.unpack(self.end + "H", self.read(at, 2))[0]
            raw = self.read(at + 2, 12 * n + 4)
            page = {}
            for i in range(n):
                tag, kind, count = struct.unpack(self.end + "HHI", raw[12 * i : 12 * i + 8])
                size = _SIZES.get(kind, 1) * count
                data = raw[12 * i + 8 : 12 * i + 12][:size] if size <= 4 else self.read(struct.unpack(self.end + "I", raw[12 * i + 8 : 12 * i + 12])[0], size)
                page[tag] = bytes(data) if kind == 2 else struct.unpack(self.end + f"{count}{_FORMS[kind]}", data) if kind in _FORMS else ()
            self.pages.append(page)
            at = struct.unpack(self.end + "I", raw[12 * n :])[0]
        first = self.pages[0]
        self.bands = first.get(277, (1,))[0]
        self.size, tie = first[33550][0], first[33922]
        self.x0, self.y0 = tie[3] - tie[0] * self.size, tie[4] + tie[1] * self.size
        keys = first.get(34735, ())
        self.epsg = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (2048, 3072)), 0)
        text = first.get(42113, b"nan\0").rstrip(b"\0 ")
        self.nodata = float(text or b"nan")

    def shape(self, page: int = 0) -> tuple[int, int]:
        return self.pages[page][257][0], self.pages[page][256][0]

    def page_size(self, page: int) -> float:
        return self.size * self.shape(0)[1] / self.shape(page)[1]

    def page_for(self, resolution: float) -> int:
        """The coarsest overview that isn't coarser than asked for."""
        fits = [i for i in range(len(self.pages)) if self.page_size(i) <= resolution * (1 + 1e-9)]
        return max(fits, key=self.page_size, default=0)

    def window(self, page: int, col0: int, row0: int, cols: int, rows: int) -> np.ndarray:
        """(bands, rows, cols) as float64, NaN for nodata and beyond the image."""
        p = self.pages[page]
        h, w = self.shape(page)
        n, planar = self.bands, p.get(284, (1,))[0]
        tiled = 322 in p
        bw, bh = (p[322][0], p[323][0]) if tiled else (w, p.get(278, (h,))[0])
        offsets, counts = (p[324], p[325]) if tiled else (p[273], p[279])
        across, down = -(-w // bw), -(-h // bh)
        kind = {1: "u", 2: "i", 3: "f"}[p.get(339, (1,))[0]] + str(p[258][0] // 8)
        out = np.full((n, rows, cols), np.nan)
        for by in range(max(0, row0 // bh), min(down - 1, (row0 + rows - 1) // bh) + 1):
            for bx in range(max(0, col0 // bw), min(across - 1, (col0 + cols - 1) // bw) + 1):
                for plane in range(n if planar == 2 else 1):
                    k = plane * across * down + by * across + bx
                    data = bytes(self.read(offsets[k], counts[k]))
                    if p.get(259, (1,))[0] in (8, 32946):
                        data = zlib.decompress(data)
                    elif p.get(259, (1,))[0] != 1:
                        raise SourceError(f"compression {p[259][0]} is not supported")
                    height = bh if tiled else min(bh, h - by * bh)
                    block = np.frombuffer(data, self.end + kind)[: height * bw * (1 if planar == 2 else n)].reshape(height, bw, -1)
                    if p.get(317, (1,))[0] == 2:
                        block = np.cumsum(block, axis=1, dtype=block.dtype)
                    block = np.moveaxis(block.astype(float), -1, 0)
                    r0, r1 = max(row0, by * bh), min(row0 + rows, by * bh + height, h)
                    c0, c1 = max(col0, bx * bw), min(col0 + cols, bx * bw + bw, w)
                    if r0 < r1 and c0 < c1:
                        to = slice(plane, plane + 1) if planar == 2 else slice(None)
                        out[to, r0 - row0 : r1 - row0, c0 - col0 : c1 - col0] = block[:, r0 - by * bh : r1 - by * bh, c0 - bx * bw : c1 - bx * bw]
        return out if self.nodata != self.nodata else np.where(out == self.nodata, np.nan, out)


def decimate(block: np.ndarray, factor: int) -> np.ndarray:
    """Means of finite values of factor x factor blocks; NaN where there are none."""
    n, h, w = block.shape
    parts = block[:, : h // factor * factor, : w // factor * factor].reshape(n, h // factor, factor, w // factor, factor)
    good = np.isfinite(parts)
    count = good.sum(axis=(2, 4))
    total = np.where(good, parts, 0).sum(axis=(2, 4))
    return np.where(count > 0, total / np.maximum(count, 1), np.nan)


def write_las(x, y, z, intensity, classification, scale: float = 0.001) -> bytes:
    """LAS 1.2, point format 0."""
    xyz = [np.asarray(v, float) for v in (x, y, z)]
    n = len(xyz[0])
    off = [float(np.floor(v.min())) if n else 0.0 for v in xyz]
    rec = np.zeros(n, np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("i", "<u2"), ("f", "u1"), ("c", "u1"), ("a", "i1"), ("u", "u1"), ("s", "<u2")]))
    for k, v, o in zip("xyz", xyz, off, strict=True):
        rec[k] = np.rint((v - o) / scale)
    rec["i"], rec["c"] = intensity, classification
    bounds = [b for v in xyz for b in ((float(v.max()), float(v.min())) if n else (0.0, 0.0))]
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"", 1, 2024, 227, 227, 0, 0, 20, n, n, 0, 0, 0, 0)
    return head + struct.pack("<3d3d6d", scale, scale, scale, *off, *bounds) + rec.tobytes()


def read_las(data: bytes) -> dict[str, np.ndarray]:
    """x, y, z, intensity, classification of LAS 1.x files, point formats 0 to 5."""
    if data[:4] != b"LASF":
        raise SourceError("not a LAS file")
    start, = struct.unpack_from("<I", data, 96)
    size, n = struct.unpack_from("<HI", data, 105)
    scale, off = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    if not n:
        raise SourceError("the point cloud is empty")
    kind = np.dtype({"names": ["x", "y", "z", "i", "c"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1"], "offsets": [0, 4, 8, 12, 15], "itemsize": size})
    rec = np.frombuffer(data, kind, n, start)
    return {"x": rec["x"] * scale[0] + off[0], "y": rec["y"] * scale[1] + off[1], "z": rec["z"] * scale[2] + off[2], "intensity": rec["i"].astype(np.int32), "classification": (rec["c"] & 31).astype(np.int8)}
