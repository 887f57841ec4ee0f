"""Lossless WebP: a decoder for whole files to pixel arrays, and an encoder.

Pixels are ``uint32`` ARGB.  The decoder reads prefix codes (simple and normal, one group or
many), back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms.

Prefix codes are decoded in bulk: the code length at *every* bit of a window is looked up
with numpy, which gives for each bit the bit where the next pixel would start; following
that chain from the first pixel finds the true starts, and only those are looked up.  Images
with several code groups, where a code depends on the pixel's place, are read pixel by pixel.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
TOOLS = ("predictor", "cross-colour", "subtract-green", "palette")
#: Predictor modes that take the neighbour on the left, or the one above.
LEFT, ABOVE = 1, 2
BLACK = 0xFF000000
#: Fixed value of the format: the order in which lengths of code-length codes are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Near distances by code: (x, y) offsets by growing distance, then by |x|, positive x first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
CACHE_FACTOR = 0x1E35A7BD
LENGTH_CODES, DISTANCE_CODES = 24, 40
#: Bits whose codes are looked up together: the tables of a window stay in a core's own cache.
WINDOW_BITS = 1 << 15
#: Bits of a code's length, where it stands beside its symbol.
LENGTH_BITS = 4
#: More bits than one pixel or back-reference can take.
REACH = 96


class Bits:
    """Reads a bit stream, least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        a = self.at
        return (int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


class Prefix:
    """A prefix code: symbol and length for every possible run of ``width`` bits."""

    def __init__(self, lengths):
        self.lengths = lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        if len(used) <= 1:  # one symbol takes no bits
            self.width, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0]), np.zeros(1, np.int64)
            self.both = self.symbol << LENGTH_BITS
            return
        self.width = int(lengths.max())
        self.symbol, self.length = np.zeros(1 << self.width, np.int64), np.zeros(1 << self.width, np.int64)
        room = 0
        for s, code, n in zip(*canonical(lengths), strict=True):
            self.symbol[code :: 1 << n], self.length[code :: 1 << n] = s, n
            room += 1 << (self.width - n)
        if room != 1 << self.width:
            raise ValueError("not a complete prefix code")
        self.both = self.symbol << LENGTH_BITS | self.length

    def read(self, bits: Bits) -> int:
        v = bits.peek(self.width)
        bits.at += int(self.length[v])
        return int(self.symbol[v])


def canonical(lengths) -> tuple[list[int], list[int], list[int]]:
    """Symbols, their codes with the first bit lowest, and lengths."""
    symbols, codes, sizes, code, last = [], [], [], 0, 0
    for n, s in sorted((int(n), s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        symbols.append(s)
        codes.append(int(f"{code:0{n}b}"[::-1], 2))
        sizes.append(n)
        code += 1
    return symbols, codes, sizes


def read_lengths(bits: Bits, size: int) -> np.ndarray:
    """The code lengths of one prefix code over ``size`` symbols."""
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    own = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    code = Prefix(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        run = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if at + run > size:
            raise ValueError("code lengths run over")
        lengths[at : at + run] = before if s == 16 else 0
        at += run
    return lengths


#: Code groups met before, as (bit in byte, cache bits, bits, value, group): equal headers need not be read again.
_GROUPS: list[tuple[int, int, int, int, list[Prefix]]] = []


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two lists of code lengths are the same, but for symbols at the end of one that have no code."""
    n = min(len(a), len(b))
    return np.array_equal(a[:n], b[:n]) and not a[n:].any() and not b[n:].any()


def read_group(bits: Bits, cache_bits: int) -> list[Prefix]:
    """The five prefix codes: green (with lengths and cache), red, blue, alpha, distance."""
    for k, (phase, cache, n, value, group) in enumerate(_GROUPS):
        if cache == cache_bits and phase == bits.at & 7 and bits.peek(n) == value:
            bits.at += n
            _GROUPS.insert(0, _GROUPS.pop(k))
            return group
    at = bits.at
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    group: list[Prefix] = []
    for lengths in [read_lengths(bits, n) for n in sizes]:
        group.append(next((g for g in group if alike(g.lengths, lengths)), None) or Prefix(lengths))  # equal codes share their tables
    n, bits.at = bits.at - at, at
    _GROUPS.insert(0, (at & 7, cache_bits, n, bits.peek(n), group))
    del _GROUPS[12:]
    bits.at += n
    return group


def prefix_value(code: int, bits: Bits) -> int:
    """A length or distance from its code and extra bits."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def cache_slot(argb: int, cache_bits: int) -> int:
    return (CACHE_FACTOR * argb & 0xFFFFFFFF) >> (32 - cache_bits)


def read_image(bits: Bits, width: int, height: int, top: bool = False, used: set[str] | None = None) -> np.ndarray:
    """An entropy-coded image, flat; only the top one can have several code groups.  ``used`` gets the tools met."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, scale = None, 0
    if top and bits.read(1):
        scale = bits.read(3) + 2
        meta = (read_image(bits, -(-width >> scale), -(-height >> scale)) >> np.uint32(8)) & np.uint32(0xFFFF)
    groups = [read_group(bits, cache_bits) for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    if len(groups) == 1:
        return read_bulk(bits, width, width * height, groups[0], cache_bits, used)
    return read_each(bits, width, width * height, groups, cache_bits, meta, scale)


def read_each(bits: Bits, width: int, total: int, groups: list[list[Prefix]], cache_bits: int, meta: np.ndarray | None = None, scale: int = 0) -> np.ndarray:
    """Pixel by pixel; the code group depends on the place."""
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    across = -(-width >> scale)
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, far = groups[int(meta[(at // width >> scale) * across + (at % width >> scale)]) if meta is not None else 0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            new = [a << 24 | r << 16 | s << 8 | b]
        elif s < 256 + LENGTH_CODES:
            n = prefix_value(s - 256, bits)
            back = distance(prefix_value(far.read(bits), bits), width)
            if back > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            new = []
            for k in range(n):
                new.append(out[at - back + k] if k < back else new[k - back])
        else:
            new = [cache[s - 256 - LENGTH_CODES]]
        if cache_bits:
            for v in new:
                cache[cache_slot(v, cache_bits)] = v
        out += new
    return np.array(out, np.uint32)


def read_bulk(bits: Bits, width: int, total: int, group: list[Prefix], cache_bits: int, used: set[str] | None = None) -> np.ndarray:
    """All pixels of one code group, a window of bits at a time."""
    green, red, blue, alpha, far = group
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # values, lengths (1 but for copies), distances (0: a pixel; -1: a cache slot)
    done = 0
    while done < total:
        base = bits.at >> 3
        raw = np.frombuffer(bits.data[base : base + (WINDOW_BITS + 2 * REACH >> 3)] + bytes(2 * REACH >> 3), np.uint8).astype(np.int64)
        wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
        look = np.empty((len(wide), 8), np.int64)
        for k in range(8):
            np.right_shift(wide, k, out=look[:, k])
        look = look.ravel()  # what follows each bit: 17 bits at least
        size = min(WINDOW_BITS, len(look) - REACH)
        place = np.arange(len(look))
        first = green.both.take(look & ((1 << green.width) - 1))
        after = first & ((1 << LENGTH_BITS) - 1)
        after += place
        nexts = {id(green): after}

        def step(code: Prefix, at: np.ndarray, look=look, place=place, nexts=nexts) -> np.ndarray:
            """Where the code that begins at each bit ends."""
            if not code.width:
                return at
            if id(code) not in nexts:
                nexts[id(code)] = code.length.take(look & ((1 << code.width) - 1))
                nexts[id(code)] += place
            return nexts[id(code)].take(at)

        def value(code: Prefix, at: np.ndarray, look=look) -> np.ndarray:
            return code.symbol.take(look.take(at) & ((1 << code.width) - 1))

        first, after = first[:size], after[:size]
        ends = after
        for code in (red, blue, alpha):
            ends = step(code, ends)
        odd = first >= 256 << LENGTH_BITS
        if odd.any():
            ends = np.where(odd, after, ends)
            odd = np.flatnonzero(odd & (first < 256 + LENGTH_CODES << LENGTH_BITS))
            code_at = (first[odd] >> LENGTH_BITS) - 256
            at = after[odd] + np.where(code_at < 4, 0, (code_at - 2) >> 1)
            seen = look.take(at) & ((1 << far.width) - 1)
            code_at = far.symbol.take(seen)
            ends[odd] = at + far.length.take(seen) + np.where(code_at < 4, 0, (code_at - 2) >> 1)
        follow, p = memoryview(ends), bits.at & 7
        starts: list[int] = []
        need = total - done
        add = starts.append
        try:
            for _ in range(need):
                add(p)
                p = follow[p]
        except IndexError:  # the next one begins beyond the window
            starts.pop()
        if not starts:
            raise ValueError("the data ends early")
        at = np.array(starts, np.int64)
        s = first[at] >> LENGTH_BITS
        a = after[at]
        r, a = value(red, a), step(red, a)
        b, a = value(blue, a), step(blue, a)
        values = value(alpha, a).astype(np.int64) << 24 | r.astype(np.int64) << 16 | s << 8 | b
        sizes, backs = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
        slots = s >= 256 + LENGTH_CODES
        values[slots], backs[slots] = s[slots] - 256 - LENGTH_CODES, -1
        for k in np.flatnonzero((s >= 256) & ~slots).tolist():
            here = Bits(bits.data, base * 8 + int(after[at[k]]))
            sizes[k] = prefix_value(int(s[k]) - 256, here)
            backs[k] = distance(prefix_value(far.read(here), here), width)
        ends_at = np.cumsum(sizes)
        fit = int(np.searchsorted(ends_at, need, "left")) + 1
        bits.at = base * 8 + (int(at[fit]) if fit < len(at) else p)
        parts.append((values[:fit], sizes[:fit], backs[:fit]))
        done += int(ends_at[min(fit, len(at)) - 1])
    values, sizes, backs = (np.concatenate(x) for x in zip(*parts, strict=True))
    if done != total or bits.at > 8 * len(bits.data):
        raise ValueError("the pixels do not fill the image")
    if used is not None:
        used |= {name for name, met in (("copies", (backs > 0).any()), ("cache", (backs < 0).any())) if met}
    return values.astype(np.uint32) if not backs.any() else unrolled(values, sizes, backs, total, cache_bits)


def unrolled(values: np.ndarray, sizes: np.ndarray, backs: np.ndarray, total: int, cache_bits: int) -> np.ndarray:
    """Pixels with back-references and cache slots resolved in order."""
    shift = 32 - cache_bits
    slots = (values.astype(np.uint32) * np.uint32(CACHE_FACTOR)) >> np.uint32(min(shift, 31))
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    for value, size, back, slot in zip(values.tolist(), sizes.tolist(), backs.tolist(), slots.tolist(), strict=True):
        if not back:
            out.append(value)
            if cache_bits:
                cache[slot] = value
        elif back < 0:
            out.append(cache[value])
        else:
            if back > len(out):
                raise ValueError("a back-reference leaves the image")
            have = out[len(out) - back :][:size]
            new = have if back >= size else (have * (size // back + 1))[:size]
            out += new
            if cache_bits:
                for v in new:
                    cache[cache_slot(v, cache_bits)] = v
    return np.array(out, np.uint32)


def channels(argb: np.ndarray) -> np.ndarray:
    """Flat pixels -> (pixels, 4) of alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: np.ndarray, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction of each pixel (rows of channels) from its neighbours by its mode."""
    out = np.zeros_like(left)
    mean = lambda a, b: (a + b) >> 1
    full = np.array([255, 0, 0, 0])
    clip = lambda x: np.clip(x, 0, 255)

    def half(a, b):
        d = a - b
        return clip(a + np.where(d < 0, -(-d >> 1), d >> 1))

    def nearer(a, b, c):
        return np.where((np.abs(b - c).sum(-1) < np.abs(a - c).sum(-1))[:, None], a, b)

    makes = {
        1: lambda a, b, c, d: a, 2: lambda a, b, c, d: b, 3: lambda a, b, c, d: c, 4: lambda a, b, c, d: d,
        5: lambda a, b, c, d: mean(mean(a, c), b), 6: lambda a, b, c, d: mean(a, d), 7: lambda a, b, c, d: mean(a, b),
        8: lambda a, b, c, d: mean(d, b), 9: lambda a, b, c, d: mean(b, c), 10: lambda a, b, c, d: mean(mean(a, d), mean(b, c)),
        11: lambda a, b, c, d: nearer(a, b, d), 12: lambda a, b, c, d: clip(a + b - d), 13: lambda a, b, c, d: half(mean(a, b), d),
    }
    for m in np.unique(mode).tolist():
        at = mode == m
        out[at] = makes[m](left[at], top[at], right[at], corner[at]) if m in makes else full
    return out


def predict_all(residual: np.ndarray, width: int, height: int, modes: np.ndarray, scale: int, invert: bool) -> np.ndarray:
    """Adds (or with ``invert`` false takes away) predictions, along fronts of pixels that do not need each other."""
    if len(modes) and modes[0] in (LEFT, ABOVE) and (modes == modes[0]).all():
        return predict_lines(residual, width, height, int(modes[0]), invert)
    image = channels(residual).reshape(height, width, 4)
    known = image.copy()
    across = -(-width >> scale)
    modes = modes.reshape(-1, across)
    for t in range(width + 2 * (height - 1)):
        y = np.arange(max(0, -(-(t - width + 1) // 2)), min(height - 1, t // 2) + 1)
        x = t - 2 * y
        up, aside = np.maximum(y - 1, 0), np.maximum(x - 1, 0)
        edge = x == width - 1
        left, top, corner = known[y, aside], known[up, x], known[up, aside]
        right = known[np.where(edge, y, up), np.where(edge, 0, np.minimum(x + 1, width - 1))]
        mode = modes[y >> scale, x >> scale]
        mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, mode))
        guess = predicted(mode, left, top, right, corner)
        if invert:
            known[y, x] = (image[y, x] + guess) & 255
        else:
            image[y, x] = (known[y, x] - guess) & 255
    return joined((known if invert else image).reshape(-1, 4))


def predict_lines(pixels: np.ndarray, width: int, height: int, mode: int, invert: bool) -> np.ndarray:
    """Predictions from the left, or from above, throughout: running sums of the first line across, then along all lines."""
    c = pixels.astype(">u4").view(np.uint8).reshape(height, width, 4)
    c = c if mode == LEFT else c.transpose(1, 0, 2)
    out = c.copy()
    if invert:
        out[0, 0, 0] -= 1  # plus the 255 of black, in bytes
        out[:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)
        out = np.cumsum(out, axis=1, dtype=np.uint8)
    else:
        out[:, 1:] -= c[:, :-1]
        out[1:, 0] -= c[:-1, 0]
        out[0, 0, 0] += 1
    return np.ascontiguousarray(out if mode == LEFT else out.transpose(1, 0, 2)).view(">u4").ravel().astype(np.uint32)


def crossed(argb: np.ndarray, width: int, height: int, elements: np.ndarray, scale: int, invert: bool) -> np.ndarray:
    """The cross-colour transform; each block's element holds its three signed factors."""
    across = -(-width >> scale)
    y, x = np.divmod(np.arange(width * height), width)
    e = channels(elements)[(y >> scale) * across + (x >> scale)].astype(np.int8).astype(np.int32)
    c = channels(argb)
    red_blue, green_blue, green_red = e[:, 1], e[:, 2], e[:, 3]
    signed = lambda v: v.astype(np.int8).astype(np.int32)
    green, old = signed(c[:, 2]), signed(c[:, 1])
    way = 1 if invert else -1
    c[:, 1] = (c[:, 1] + way * (green_red * green >> 5)) & 255
    red = signed(c[:, 1]) if invert else old
    c[:, 3] = (c[:, 3] + way * ((green_blue * green >> 5) + (red_blue * red >> 5))) & 255
    return joined(c)


def palette_bits(colours: int) -> int:
    """The power of two of indices that share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes, used: set[str] | None = None) -> np.ndarray:
    """A WebP file with one lossless image -> pixels (height, width) of ARGB; ``used`` gets the tools met."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if bits.read(4) >> 1:
        raise ValueError("unknown version")
    across, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if used is not None:
            used.add(TOOLS[kind])
        if kind in (PREDICTOR, CROSS_COLOR):
            scale = bits.read(3) + 2
            undo.append((kind, across, scale, read_image(bits, -(-across >> scale), -(-height >> scale))))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = joined(np.cumsum(channels(read_image(bits, n, 1)), axis=0))
            undo.append((kind, across, palette_bits(n), colours))
            across = -(-across >> palette_bits(n))
        else:
            undo.append((kind, across, 0, None))
    image = read_image(bits, across, height, top=True, used=used)
    for kind, own, scale, extra in reversed(undo):
        if kind == PREDICTOR:
            image = predict_all(image, own, height, (extra >> np.uint32(8)).astype(np.int64) & 15, scale, True)
        elif kind == CROSS_COLOR:
            image = crossed(image, own, height, extra, scale, True)
        elif kind == SUBTRACT_GREEN:
            c = channels(image)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            image = joined(c)
        else:
            index = ((image >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
            if scale:
                each = 8 >> scale
                index = (index[:, :, None] >> (np.arange(1 << scale, dtype=np.uint32) * each)) & np.uint32((1 << each) - 1)
                index = index.reshape(height, -1)[:, :own]
            table = np.zeros(256, np.uint32)
            table[: len(extra)] = extra
            image = table[index].ravel()
    return image.reshape(height, width)


class Writer:
    """Writes a bit stream, least significant bit first."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.size
        self.size += n

    def data(self) -> bytes:
        return self.value.to_bytes((self.size + 7) >> 3, "little")


def code_lengths(weights, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits for the symbols with a weight."""
    weights = np.asarray(weights, np.int64)
    lengths = np.zeros(len(weights), np.int64)
    used = np.flatnonzero(weights)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while True:
        heap = [(int(weights[s]), k, [int(s)]) for k, s in enumerate(used)]
        heapq.heapify(heap)
        lengths[:] = 0
        made = len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            lengths[x + y] += 1
            heapq.heappush(heap, (a + b, made, x + y))
            made += 1
        if lengths.max() <= most:
            return lengths
        weights = np.where(weights > 0, weights // 2 + 1, 0)


def put_lengths(out: Writer, lengths) -> None:
    """Stores the code lengths of one prefix code."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used.max() < 256):
        first = int(used[0]) if len(used) else 0
        out.put(1, 1)
        out.put(len(used) == 2, 1)
        out.put(1, 1)
        out.put(first, 8)
        if len(used) == 2:
            out.put(int(used[1]), 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    at, before = 0, 8
    values = [int(n) for n in lengths]
    while at < len(values):
        run = 1
        while at + run < len(values) and values[at + run] == values[at]:
            run += 1
        n = values[at]
        if n == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
        elif n and n == before and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run = 1
            tokens.append((n, 0, 0))
            before = n or before
        at += run
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    code = {s: (c, n) for s, c, n in zip(*canonical(own), strict=True)}
    if len(code) == 1:
        code = {s: (0, 0) for s in code}
    stored = max(k for k, s in enumerate(LENGTH_ORDER) if own[s]) + 1
    out.put(0, 1)
    out.put(max(stored, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(stored, 4)]:
        out.put(own[s], 3)
    out.put(0, 1)
    for s, extra, n in tokens:
        out.put(*code[s])
        out.put(extra, n)


def split_value(value: int) -> tuple[int, int, int]:
    """A length or distance -> its code, extra value and extra bits."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    code = 2 * extra + 2 + (v >> extra & 1)
    return code, v & ((1 << extra) - 1), extra


@lru_cache(maxsize=64)
def near_codes(width: int) -> dict[int, int]:
    """The codes of near distances in an image so wide."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def pixel_tokens(argb: list[int], width: int, cache_bits: int, copies: bool) -> list[tuple]:
    """Greedy: copies of runs that began with the same two pixels, cache slots, else pixels."""
    near = near_codes(width)
    seen: dict[tuple[int, int], int] = {}
    cache = [0] * (1 << cache_bits)
    out: list[tuple] = []
    at = 0
    while at < len(argb):
        n, key = 0, (argb[at], argb[at + 1] if at + 1 < len(argb) else -1)
        if copies and (back := at - seen.get(key, at)):
            while n < 4096 and at + n < len(argb) and argb[at + n] == argb[at + n - back]:
                n += 1
        if n >= 3:
            out.append(("copy", n, near.get(back, back + len(NEAR))))
        elif cache_bits and cache[slot := cache_slot(argb[at], cache_bits)] == argb[at]:
            n = 1
            out.append(("slot", slot))
        else:
            n = 1
            out.append(("pixel", argb[at]))
        for k in range(at, at + n):
            seen[(argb[k], argb[k + 1] if k + 1 < len(argb) else -1)] = k
            if cache_bits:
                cache[cache_slot(argb[k], cache_bits)] = argb[k]
        at += n
    return out


def put_image(out: Writer, argb: np.ndarray, width: int, cache_bits: int = 0, copies: bool = True, top: bool = False, groups: int = 1) -> None:
    """Stores an entropy-coded image; ``groups`` code groups take turns over 4 x 4 blocks."""
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    across = -(-width >> 2)
    groups = min(groups, across * -(-(len(argb) // width) >> 2))
    turn = np.zeros(0, np.int64)
    if top:
        out.put(groups > 1, 1)
        if groups > 1:
            out.put(0, 3)
            turn = np.arange(across * -(-(len(argb) // width) >> 2)) % groups
            put_image(out, turn.astype(np.uint32) << np.uint32(8), across)
    tokens = pixel_tokens(argb.tolist(), width, cache_bits, copies)
    counts = [[np.zeros(n, np.int64) for n in (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)] for _ in range(groups)]
    plan: list[tuple[int, list[tuple[int, int, int, int]]]] = []
    at = 0
    for t in tokens:
        g = int(turn[(at // width >> 2) * across + (at % width >> 2)]) if groups > 1 else 0
        if t[0] == "pixel":
            v = t[1]
            put = [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)]
        elif t[0] == "slot":
            put = [(0, 256 + LENGTH_CODES + t[1], 0, 0)]
        else:
            a, b = split_value(t[1]), split_value(t[2])
            put = [(0, 256 + a[0], *a[1:]), (4, *b)]
        for code, s, _, _ in put:
            counts[g][code][s] += 1
        plan.append((g, put))
        at += t[1] if t[0] == "copy" else 1
    books = []
    for own in counts:
        books.append([])
        for c in own:
            lengths = code_lengths(c)
            put_lengths(out, lengths)
            symbols, codes, sizes = canonical(lengths)
            books[-1].append({s: (k, n if len(symbols) > 1 else 0) for s, k, n in zip(symbols, codes, sizes, strict=True)})
    for g, put in plan:
        for code, s, extra, n in put:
            value, size = books[g][code][s]
            out.put(value if size else 0, size)
            out.put(extra, n)


def file_of(stream: bytes) -> bytes:
    """The RIFF container around an image stream."""
    body = b"\x2f" + stream
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def encode(pixels: np.ndarray, *, palette: bool = False, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, green: bool = False, scale: int = 2, cache_bits: int = 0, copies: bool = True, groups: int = 1) -> bytes:
    """Pixels (height, width) of ARGB -> a WebP file, with the transforms asked for.

    ``predictor``: modes 0 to 13 per block of ``2 ** scale`` pixels; ``cross``: an ARGB element per block.
    """
    height, width = pixels.shape
    out = Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    argb, across = pixels.astype(np.uint32).ravel(), width
    if palette:
        colours, index = np.unique(argb, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        put_image(out, joined(np.diff(channels(colours), axis=0, prepend=np.zeros((1, 4), np.int32))), len(colours))
        share = palette_bits(len(colours))
        across = -(-width >> share)
        wide = np.zeros((height, across << share), np.uint32)
        wide[:, :width] = index.reshape(height, width)
        packed = (wide.reshape(height, across, 1 << share) << (np.arange(1 << share, dtype=np.uint32) * (8 >> share))).sum(-1, dtype=np.uint32)
        argb = (packed << np.uint32(8) | np.uint32(BLACK)).ravel()
    if predictor is not None:
        out.put(1 | PREDICTOR << 1, 3)
        out.put(scale - 2, 3)
        put_image(out, predictor.astype(np.uint32).ravel() << np.uint32(8) | np.uint32(BLACK), -(-across >> scale))
        argb = predict_all(argb, across, height, predictor.astype(np.int64).ravel(), scale, False)
    if cross is not None:
        out.put(1 | CROSS_COLOR << 1, 3)
        out.put(scale - 2, 3)
        put_image(out, cross.astype(np.uint32).ravel(), -(-across >> scale))
        argb = crossed(argb, across, height, cross.astype(np.uint32).ravel(), scale, False)
    if green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        c = channels(argb)
        c[:, 1] -= c[:, 2]
        c[:, 3] -= c[:, 2]
        argb = joined(c)
    out.put(0, 1)
    put_image(out, argb, across, cache_bits, copies, top=True, groups=groups)
    return file_of(out.data())


class Codes:
    """Five prefix codes fixed beforehand: tables, and the bits that declare them after the transforms."""

    def __init__(self, green, other, far=(), cache_bits: int = 0):
        self.cache_bits = cache_bits
        self.lengths = [code_lengths(w) for w in (green, other, np.r_[np.array(far, np.int64), np.zeros(DISTANCE_CODES - len(far), np.int64)])]
        self.codes = []
        for lengths in self.lengths:
            table = np.zeros(len(lengths), np.uint64)
            symbols, codes, _ = canonical(lengths)
            table[symbols] = codes
            self.codes.append(table)
        self.head = Writer()
        self.head.put(cache_bits > 0, 1)
        if cache_bits:
            self.head.put(cache_bits, 4)
        self.head.put(0, 1)
        for k in (0, 1, 1, 1, 2):
            put_lengths(self.head, self.lengths[k])


def repeats(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs ``(from, to, back)``: the three pixels at each place of a run last began ``back`` pixels before."""
    if len(argb) < 4:
        return []
    wide = argb.astype(np.uint64)
    key = ((wide[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ wide[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ wide[2:]) * np.uint64(0x9E3779B97F4A7C15)
    below = np.uint64(len(key).bit_length())  # the lowest bits of a key make room for its place
    key = key >> below << below | np.arange(len(key), dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << below) - np.uint64(1))).astype(np.int64)
    key >>= below
    same = np.flatnonzero(key[1:] == key[:-1])
    back = np.zeros(len(key), np.int64)
    back[order[same + 1]] = order[same + 1] - order[same]
    at = np.flatnonzero(back)
    wrong = np.zeros(len(at), bool)
    for k in range(3):
        wrong |= argb[at + k] != argb[at - back[at] + k]
    back[at[wrong]] = 0  # equal keys of different pixels
    starts = np.flatnonzero(np.diff(back, prepend=0))
    ends = np.r_[starts[1:], len(back)]
    used = back[starts] > 0
    return list(zip(starts[used].tolist(), ends[used].tolist(), back[starts[used]].tolist(), strict=True))


#: The longest copy of the format.
MOST_COPIED = 4096


def coded(argb: np.ndarray, width: int, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """The bits, and their number, of each pixel, cache slot or copy that stands for pixels; the last two only if ``codes`` has them."""
    value, size = np.zeros(len(argb), np.uint64), np.zeros(len(argb), np.int64)
    for k, shift in ((0, 8), (1, 16), (1, 0), (1, 24)):
        part = ((argb >> np.uint32(shift)) & np.uint32(255)).astype(np.intp)
        value |= codes.codes[k].take(part) << size.view(np.uint64)
        size += codes.lengths[k].take(part)
    if not codes.cache_bits:
        return value, size
    slot = (argb * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - codes.cache_bits)
    order = np.argsort(slot.astype(np.uint16), kind="stable")  # sorted by digits
    again = (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    hit = order[1:][again]
    value[hit] = codes.codes[0][256 + LENGTH_CODES + slot[hit]]
    size[hit] = codes.lengths[0][256 + LENGTH_CODES + slot[hit]]
    near = near_codes(width)
    whole = np.ones(len(argb), bool)
    at = 0
    for start, end, back in repeats(argb):
        start = max(start, at)
        while start < end:
            n = min(end - start + 2, MOST_COPIED)
            (a, more, bits), (b, far, far_bits) = split_value(n), split_value(near.get(back, back + len(NEAR)))
            code, length = int(codes.codes[0][256 + a]), int(codes.lengths[0][256 + a])
            for v, m in ((more, bits), (int(codes.codes[2][b]), int(codes.lengths[2][b])), (far, far_bits)):
                code |= v << length
                length += m
            if length < size[start : start + n].sum():
                value[start], size[start] = code, length
                whole[start + 1 : start + n] = False
                start = at = start + n
            else:
                break
    return value[whole], size[whole]


def written(before: Writer, value: np.ndarray, size: np.ndarray) -> bytes:
    """A WebP file of the bits in ``before`` and those of the tokens after them."""
    ends = before.size + np.cumsum(size)
    starts = ends - size
    words = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    first = np.frombuffer(before.data().ljust(-(-before.size >> 6) * 8, b"\0"), "<u8")
    words[: len(first)] = first
    shift, word = (starts & 63).astype(np.uint64), starts >> 6
    np.add.at(words, word, value << shift)
    np.add.at(words, word + 1, np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0)))
    return file_of(words.astype("<u8").tobytes()[: (int(ends[-1]) + 7) >> 3])


@lru_cache(maxsize=256)
def one_mode(mode: int, across: int, down: int) -> tuple[int, int]:
    """The bits, and their number, of a predictor of one mode over so many blocks."""
    out = Writer()
    out.put(1 | PREDICTOR << 1, 3)
    out.put(7, 3)
    put_image(out, np.full(across * down, mode << 8 | BLACK, np.uint32), across)
    return out.value, out.size


def head(width: int, height: int, mode: int = 0) -> Writer:
    """The sizes of an image, and where ``mode`` is given a predictor of that mode throughout."""
    out = Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 4)
    if mode:
        out.put(*one_mode(mode, -(-width >> 9), -(-height >> 9)))
    out.put(0, 1)
    return out


def smallest(argb: np.ndarray, width: int, plain: Codes, tokens: Codes, residual: Codes) -> bytes:
    """The smallest file of flat pixels: as they are, with copies and cache slots, or as differences from the left or from above."""
    height = len(argb) // width

    def bits(mode: int, codes: Codes, pixels: np.ndarray) -> int:
        met = np.bincount(pixels.view(np.uint8), minlength=256)
        more = codes.lengths[0][:256] - codes.lengths[1]  # of green
        return head(width, height, mode).size + codes.head.size + int(codes.lengths[1] @ met) + (int(more.take((pixels >> np.uint32(8)) & np.uint32(255)).sum()) if more.any() else 0)

    ways = [(0, plain, argb), *[(mode, residual, predict_lines(argb, width, height, mode, False)) for mode in (LEFT, ABOVE)]]
    least, best = min((bits(*way), k) for k, way in enumerate(ways))
    mode, codes, pixels = ways[best]
    value, size = coded(argb, width, tokens)
    if head(width, height).size + tokens.head.size + int(size.sum()) < least:
        mode, codes = 0, tokens
    else:
        value, size = coded(pixels, width, codes)
    out = head(width, height, mode)
    out.put(codes.head.value, codes.head.size)
    return written(out, value, size)
