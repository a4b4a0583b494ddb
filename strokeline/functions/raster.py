"""Raster operators on one page at a time, in NumPy; a page's size is bounded, and Spark deals out the pages."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))  # from north, clockwise


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of a gray (H, W) or RGB (H, W, 3) image of bytes."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3):
        raise ValueError("an image is a two- or three-dimensional array of bytes")
    height, width = image.shape[:2]
    rows = np.hstack([np.zeros((height, 1), np.uint8), image.reshape(height, -1)]).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The image of an 8-bit PNG, gray or RGB (an alpha channel is dropped), without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        raise ValueError("only 8-bit gray and RGB images without interlacing")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int32)
    for y in range(height):
        method, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if method == 2:
            line = (line + above) & 255
        elif method in (1, 3, 4):
            line = line.copy()
            for x in range(len(line)):
                left = line[x - channels] if x >= channels else 0
                up, corner = above[x], above[x - channels] if x >= channels else 0
                if method == 1:
                    add = left
                elif method == 3:
                    add = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    add = left if a <= b and a <= c else up if b <= c else corner
                line[x] = (line[x] + add) & 255
        out[y], above = line, line
    image = out.reshape(height, width, channels)
    return image[:, :, 0] if channels <= 2 else image[:, :, :3]


def shifted(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The mask's value at (y + dy, x + dx), 0 beyond the edge."""
    padded = np.pad(mask, 1)
    return padded[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]]


def dilated(mask: np.ndarray) -> np.ndarray:
    return np.maximum.reduce([shifted(mask, y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)])


def eroded(mask: np.ndarray) -> np.ndarray:
    return np.minimum.reduce([shifted(mask, y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)])


def opened(mask: np.ndarray) -> np.ndarray:
    return dilated(eroded(mask))


def closed(mask: np.ndarray) -> np.ndarray:
    return eroded(dilated(mask))


def degrees(mask: np.ndarray) -> np.ndarray:
    """Set neighbours, of eight, of every set pixel."""
    ink = (mask > 0).astype(np.int32)
    return sum(shifted(ink, y, x) for y, x in _RING) * ink


def thinned(mask: np.ndarray) -> np.ndarray:
    """The skeleton by Guo and Hall's two alternating passes, until nothing changes."""
    ink = (mask > 0).astype(np.uint8)
    while True:
        before = ink
        for odd in (True, False):
            p2, p3, p4, p5, p6, p7, p8, p9 = (shifted(ink, y, x).astype(bool) for y, x in _RING)
            crossings = sum((~a & (b | c)).astype(np.int32) for a, b, c in ((p2, p3, p4), (p4, p5, p6), (p6, p7, p8), (p8, p9, p2)))
            one = sum((a | b).astype(np.int32) for a, b in ((p9, p2), (p3, p4), (p5, p6), (p7, p8)))
            two = sum((a | b).astype(np.int32) for a, b in ((p2, p3), (p4, p5), (p6, p7), (p8, p9)))
            near = np.minimum(one, two)
            kept = (p6 | p7 | ~p9) & p8 if odd else (p2 | p3 | ~p5) & p4
            goes = (ink > 0) & (crossings == 1) & (near >= 2) & (near <= 3) & ~kept
            ink = np.where(goes, 0, ink).astype(np.uint8)
        if np.array_equal(ink, before):
            return ink


def pruned(skeleton: np.ndarray, rounds: int) -> np.ndarray:
    """The skeleton after `rounds` times taking off the ends of branches; a single pixel stays."""
    ink = (skeleton > 0).astype(np.uint8)
    for _ in range(rounds):
        ends = degrees(ink) == 1
        if not ends.any():
            break
        ink = np.where(ends, 0, ink).astype(np.uint8)
    return ink


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(label of every pixel from 1, 0 for none; number of labels) of 8-connected components, numbered by their first pixel."""
    ink = mask > 0
    label = np.where(ink, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        least = label.copy()
        for y, x in _RING:
            near = shifted(label, y, x)
            least = np.where(ink & (near > 0), np.minimum(least, near), least)
        # jump to the label of the pixel that gave the label
        flat = np.concatenate([[0], least.ravel()])
        least = np.where(ink, flat[least], 0)
        if np.array_equal(least, label):
            break
        label = least
    values, index = np.unique(label[ink], return_inverse=True)
    out = np.zeros(mask.shape, dtype=np.int32)
    out[ink] = index + 1
    return out, len(values)


def component_boxes(label: np.ndarray, n: int) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, area) of each component."""
    ys, xs = np.nonzero(label)
    which = label[ys, xs] - 1
    low = lambda v: np.minimum.reduceat(v, starts)
    order = np.argsort(which, kind="stable")
    ys, xs, which = ys[order], xs[order], which[order]
    starts = np.searchsorted(which, np.arange(n))
    if not n:
        return []
    x0, y0, x1, y1 = low(xs), low(ys), -low(-xs), -low(-ys)
    area = np.bincount(which, minlength=n)
    return [(int(a), int(b), int(c - a + 1), int(d - b + 1), int(e)) for a, b, c, d, e in zip(x0, y0, x1, y1, area)]


def traced(skeleton: np.ndarray) -> list[list[tuple[int, int]]]:
    """Polylines (x, y) of a skeleton: from every end and junction along its branches, then the closed rings."""
    ink = skeleton > 0
    degree = degrees(skeleton)
    seeds = [tuple(p) for p in np.argwhere(ink & ((degree == 1) | (degree >= 3)))]
    stops, used, lines = set(seeds), set(), []

    def walk(start: tuple[int, int], second: tuple[int, int]) -> list[tuple[int, int]]:
        path = [start, second]
        used.add(frozenset((start, second)))
        while path[-1] not in stops:
            y, x = path[-1]
            following = [(y + a, x + b) for a, b in _RING if 0 <= y + a < ink.shape[0] and 0 <= x + b < ink.shape[1] and ink[y + a, x + b]]
            following = [q for q in following if q != path[-2] and frozenset((path[-1], q)) not in used and q not in path[-3:]]
            if not following:
                break
            used.add(frozenset((path[-1], following[0])))
            path.append(following[0])
        return path

    for start in seeds + [tuple(p) for p in np.argwhere(ink & (degree == 2))]:
        if start not in stops and any(start in e for e in used):
            continue
        y, x = start
        for a, b in _RING:
            q = (y + a, x + b)
            if 0 <= q[0] < ink.shape[0] and 0 <= q[1] < ink.shape[1] and ink[q] and frozenset((start, q)) not in used:
                lines.append([(int(px), int(py)) for py, px in walk(start, q)])
                if start not in stops:
                    break
    return lines


def simplified(points: list[tuple[float, float]], epsilon: float) -> list[tuple[float, float]]:
    """Douglas and Peucker's simplification of a polyline."""
    if len(points) < 3:
        return list(points)
    p = np.asarray(points, dtype=float)
    kept, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        length = np.hypot(*d)
        inner = p[a + 1 : b] - p[a]
        far = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / length if length > 0 else np.hypot(inner[:, 0], inner[:, 1])
        k = int(np.argmax(far))
        if far[k] > epsilon:
            kept.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[k] for k in sorted(kept)]


def drawn(segments: list[tuple[float, float, float, float]], size: int) -> np.ndarray:
    """A square mask with the segments' pixels set."""
    mask = np.zeros((size, size), np.uint8)
    for x0, y0, x1, y1 in segments:
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        xs, ys = np.rint(np.linspace(x0, x1, n + 1)).astype(int), np.rint(np.linspace(y0, y1, n + 1)).astype(int)
        inside = (xs >= 0) & (xs < size) & (ys >= 0) & (ys < size)
        mask[ys[inside], xs[inside]] = 255
    return mask


def ink_coverage(mask: np.ndarray, x0: float, y0: float, x1: float, y1: float, step: float = 3.0) -> float:
    """The part of the samples along a line that has ink; 0 for a line of under a pixel."""
    length = float(np.hypot(x1 - x0, y1 - y0))
    if length < 1:
        return 0.0
    n = max(2, int(np.ceil(length / max(1.0, step))))
    xs, ys = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
    inside = (xs >= 0) & (xs < mask.shape[1]) & (ys >= 0) & (ys < mask.shape[0])
    return float((mask[ys[inside], xs[inside]] > 0).sum() / n)


def retained_ink(rgb: np.ndarray, grid: np.ndarray | None = None, dark: int = 110, saturated: int = 60) -> np.ndarray:
    """Pixels that are dark or coloured, without those of the grid."""
    low, high = rgb.min(axis=2).astype(int), rgb.max(axis=2).astype(int)
    ink = (high < dark) | (high - low > saturated)
    return np.where(ink & (grid == 0 if grid is not None else True), 255, 0).astype(np.uint8)


def largest_difference(a: np.ndarray, b: np.ndarray) -> int | None:
    """Largest difference of a channel, null for images of different shapes."""
    return None if a.shape != b.shape else int(np.abs(a.astype(int) - b.astype(int)).max(initial=0))
