"""A lossless WebP decoder written from the public format description alone, a bit and a pixel at a time, for tests.

It shares nothing with the operator but the file."""

import struct

# Fixed values of the public format.
ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
MAP = """
0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1
-4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3
-5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1
-7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6
8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7
""".split()


class Stream:
    def __init__(self, data):
        self.data, self.at = data, 0

    def bit(self):
        b = self.data[self.at >> 3] >> (self.at & 7) & 1
        self.at += 1
        return b

    def bits(self, n):
        return sum(self.bit() << i for i in range(n))


class Tree:
    def __init__(self, lengths):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        self.codes, code = {}, 0
        for n in range(1, 16):
            code <<= 1
            for s in used:
                if lengths[s] == n:
                    self.codes[n, code] = s
                    code += 1

    def next(self, stream):
        if self.only is not None:
            return self.only
        n = code = 0
        while (n, code) not in self.codes:
            code = code * 2 + stream.bit()
            n += 1
        return self.codes[n, code]


def tree(stream, size):
    lengths = [0] * size
    if stream.bit():
        two = stream.bit()
        lengths[stream.bits(8 if stream.bit() else 1)] = 1
        if two:
            lengths[stream.bits(8)] = 1
        return Tree(lengths)
    first = [0] * 19
    for k in range(stream.bits(4) + 4):
        first[ORDER[k]] = stream.bits(3)
    inner = Tree(first)
    left = stream.bits(2 + 2 * stream.bits(3)) + 2 if stream.bit() else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = inner.next(stream)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n, v = (3 + stream.bits(2), before) if s == 16 else (3 + stream.bits(3), 0) if s == 17 else (11 + stream.bits(7), 0)
            lengths[at : at + n] = [v] * n
            at += n
    return Tree(lengths)


def number(stream, prefix):
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) // 2
    return (2 + prefix % 2 << extra) + stream.bits(extra) + 1


def image(stream, width, height, main):
    cache_bits = stream.bits(4) if stream.bit() else 0
    which, side, groups = None, 0, 1
    if main and stream.bit():
        side = stream.bits(3) + 2
        across = -(-width // (1 << side))
        which = [p >> 8 & 0xFFFF for p in image(stream, across, -(-height // (1 << side)), False)]
        groups = max(which) + 1
    trees = [[tree(stream, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    out, cache = [], [0] * (1 << cache_bits)

    def add(p):
        out.append(p)
        if cache_bits:
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> 32 - cache_bits] = p

    while len(out) < width * height:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, far = trees[which[(y >> side) * across + (x >> side)] if which else 0]
        s = green.next(stream)
        if s < 256:
            r = red.next(stream)
            b = blue.next(stream)
            add(alpha.next(stream) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = number(stream, s - 256)
            d = number(stream, far.next(stream))
            if d > 120:
                d -= 120
            else:
                dx, dy = map(int, MAP[d - 1].split(","))
                d = max(1, dx + dy * width)
            for _ in range(n):
                add(out[-d])
        else:
            add(cache[s - 280])
    return out


def split(p):
    return [p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255]


def join(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def signed(v):
    return (v & 255) - 256 if v & 128 else v & 255


def guess(mode, left, top, right, corner):
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    if mode == 11:
        p = [a + b - c for a, b, c in zip(left, top, corner)]
        return left if sum(abs(x - y) for x, y in zip(p, left)) < sum(abs(x - y) for x, y in zip(p, top)) else top
    if mode == 12:
        return [min(255, max(0, a + b - c)) for a, b, c in zip(left, top, corner)]
    if mode == 13:
        return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean(left, top), corner)]
    return [
        [255, 0, 0, 0], left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top),
        mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right)),
    ][mode]


def decode(data):
    """Rows of ARGB numbers of the first VP8L chunk."""
    at = 12
    while data[at : at + 4] != b"VP8L":
        at += 8 + (struct.unpack("<I", data[at + 4 : at + 8])[0] + 1) // 2 * 2
    stream = Stream(data[at + 8 :])
    assert stream.bits(8) == 0x2F
    width, height = stream.bits(14) + 1, stream.bits(14) + 1
    stream.bits(4)
    todo, wide, kinds = [], width, set()
    while stream.bit():
        kind = stream.bits(2)
        kinds.add(kind)
        if kind < 2:
            side = stream.bits(3) + 2
            across = -(-wide // (1 << side))
            todo.append((kind, side, across, wide, image(stream, across, -(-height // (1 << side)), False)))
        elif kind == 2:
            todo.append((kind, 0, 0, wide, None))
        else:
            n = stream.bits(8) + 1
            colours, last = [], [0] * 4
            for p in image(stream, n, 1, False):
                last = [(a + b) & 255 for a, b in zip(last, split(p))]
                colours.append(join(last))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, pack, 0, wide, colours))
            wide = -(-wide // (1 << pack))
    pixels = image(stream, wide, height, True)
    for kind, side, across, w, part in reversed(todo):
        if kind == 0:
            out = []
            for i, p in enumerate(pixels):
                y, x = divmod(i, w)
                if i == 0:
                    g = [255, 0, 0, 0]
                elif y == 0:
                    g = split(out[i - 1])
                elif x == 0:
                    g = split(out[i - w])
                else:
                    mode = part[(y >> side) * across + (x >> side)] >> 8 & 15
                    g = guess(mode, split(out[i - 1]), split(out[i - w]), split(out[i - w + 1]), split(out[i - w - 1]))
                out.append(join([a + b for a, b in zip(split(p), g)]))
            pixels = out
        elif kind == 1:
            for i, p in enumerate(pixels):
                y, x = divmod(i, w)
                _, rb, gb, gr = split(part[(y >> side) * across + (x >> side)])
                a, r, g, b = split(p)
                r = (r + (signed(gr) * signed(g) >> 5)) & 255
                pixels[i] = join([a, r, g, b + (signed(gb) * signed(g) >> 5) + (signed(rb) * signed(r) >> 5)])
        elif kind == 2:
            pixels = [join([c[0], c[1] + c[2], c[2], c[3] + c[2]]) for c in map(split, pixels)]
        else:
            per, depth, out = 1 << side, 8 >> side, []
            packed = len(pixels) // height
            for y in range(height):
                for x in range(w):
                    k = pixels[y * packed + x // per] >> 8 + x % per * depth & (1 << depth) - 1
                    out.append(part[k] if k < len(part) else 0)
            pixels = out
    return [pixels[i : i + width] for i in range(0, len(pixels), width)], kinds
