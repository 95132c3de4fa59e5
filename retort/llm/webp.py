"""Lossless WebP (VP8L): a decoder for the whole bitstream format, an encoder, and the media column operator.

The decoder reads prefix codes (simple and normal, one group or many), back-references with the neighbourhood distance
codes, the colour cache, and inverts the predictor, cross-colour, subtract-green and colour-indexing transforms. Where
every code of an image has one length for all its symbols, the pixels are read as an array instead of one by one; the
operator writes its images so. Pixels are uint32 ARGB arrays of (height, width).
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

# Fixed values of the public format: order in which code lengths of code lengths are stored, and the neighbours that
# distance codes 1 to 120 stand for, as (columns left, rows up).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0),
    (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1),
    (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5),
    (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0),
    (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7),
    (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
SIGNATURE, LITERALS, LENGTHS, DISTANCES, SIDE = 0x2F, 256, 24, 40, 16384
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK, CACHE_FACTOR = 0xFF000000, 0x1E35A7BD
FRAME = 1 << 26  #: payload bytes in one image at most
STRETCH = 1 << 14  #: bytes of the stream looked at together
WIDE, SMALL, BLOCK = 1024, 4096, 9  #: width from which images get higher than wide; bytes from which there are blocks, and their side's log
CACHE_BITS = 7  #: logarithm of the size of the greatest colour cache that is written; the codes of a larger one are longer than what it spares
SAME, COPY = 8, 4096  #: equal bytes from which a back-reference is written; pixels in one at most


class Bits:
    """Reader, least significant bit first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 6], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends too early")
        return value


class Code:
    """A canonical prefix code from its code lengths. A single symbol takes no bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = lengths.nonzero()[0]
        self.symbols = used[np.argsort(lengths[used], kind="stable")]
        self.lengths = np.sort(lengths[used]) if len(used) > 1 else np.zeros(len(used), int)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if len(used) > 1 and (np.left_shift(1, 15 - self.lengths)).sum() != 1 << 15:
            raise ValueError("an incomplete or oversubscribed prefix code")
        self.width = int(self.lengths[-1])
        self.uniform = bool(self.lengths[0] == self.width)
        spans = np.left_shift(1, self.width - self.lengths)
        self.codes = (np.cumsum(spans) - spans) >> (self.width - self.lengths)

    @cached_property
    def table(self) -> dict[int, int]:
        """Symbols by their code's bits after a leading one."""
        return dict(zip((np.left_shift(1, self.lengths) | self.codes).tolist(), self.symbols.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        if not self.width:
            return int(self.symbols[0])
        window, code = bits.peek(), 1
        for n in range(1, self.width + 1):
            code = code << 1 | window & 1
            window >>= 1
            if (s := self.table.get(code)) is not None:
                bits.at += n
                return s
        raise ValueError("no such code")


@cache
def _single(symbol: int) -> Code:
    """The code of a channel that doesn't change."""
    lengths = np.zeros(symbol + 1, int)
    lengths[symbol] = 1
    return Code(lengths)


@cache
def _turned(n: int) -> np.ndarray:
    """All numbers of n bits with their bits in reverse."""
    turned = np.zeros(1 << n, np.int64)
    for i in range(n):
        turned |= (np.arange(1 << n) >> i & 1) << (n - 1 - i)
    return turned


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):  # simple
        two, wide = bits.read(1), bits.read(1)
        one = bits.read(8 if wide else 1)
        if not two:
            return _single(one)
        lengths = np.zeros(alphabet, int)
        lengths[[one, bits.read(8)]] = 1
        return Code(lengths)
    lengths = np.zeros(alphabet, int)
    outer = np.zeros(19, int)
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        outer[k] = bits.read(3)
    code, left = Code(outer), alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    if code.uniform and code.width == 1 and code.symbols[-1] < 16 and left >= alphabet:  # one bit for each symbol
        raw = np.frombuffer(bits.data[bits.at >> 3 : (bits.at + alphabet + 7) >> 3], np.uint8)
        flags = np.unpackbits(raw, bitorder="little")[bits.at & 7 :][:alphabet]
        bits.read(alphabet)
        return Code(code.symbols[flags])
    symbols, taken = (x.tolist() for x in _lookup(code))
    mask, data, at, previous, found = (1 << code.width) - 1, bits.data, 0, 8, []
    byte = (bits.at >> 3) + 8
    window, have = int.from_bytes(data[byte - 8 : byte], "little") >> (bits.at & 7), 64 - (bits.at & 7)
    while at < alphabet and left:
        left -= 1
        if have < 14:  # a code and its extra bits
            window |= int.from_bytes(data[byte : byte + 5], "little") << have
            byte, have = byte + 5, have + 40
        k = symbols[window & mask]
        n = taken[window & mask]
        window >>= n
        have -= n
        if k < 16:
            found.append(k)
            at += 1
            previous = k or previous
            continue
        value, base, extra = ((previous, 3, 2), (0, 3, 3), (0, 11, 7))[k - 16]
        n = base + (window & ((1 << extra) - 1))
        window >>= extra
        have -= extra
        if at + n > alphabet:
            raise ValueError("too many code lengths")
        found += [value] * n
        at += n
    bits.at = 8 * byte - have
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image ends too early")
    lengths[: len(found)] = found
    return Code(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


@cache
def _near_distances(width: int) -> np.ndarray:
    """What the distance codes of neighbours stand for."""
    return np.array([max(1, x + y * width) for x, y in NEIGHBOURS], np.int64)


class _Shared(Exception):
    """Colours share a place in the cache, or one is asked for that holds none."""


def _decode_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, meta_bits, groups = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = _decode_pixels(bits, _up(width, meta_bits), _up(height, meta_bits), False) >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (LITERALS + LENGTHS + cache_size, 256, 256, 256, DISTANCES)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, _ = codes[0]
    if groups == 1 and not any(c.width for c in (green, red, blue, alpha)) and green.symbols[0] < LITERALS:
        return np.full((height, width), int(alpha.symbols[0]) << 24 | int(red.symbols[0]) << 16 | int(green.symbols[0]) << 8 | int(blue.symbols[0]), np.uint32)
    if groups == 1 and all(c.uniform for c in (green, red, blue, alpha)) and green.symbols[-1] < LITERALS:
        return _fixed_width(bits, total, (green, red, blue, alpha)).reshape(height, width)
    if groups == 1:
        begin = bits.at
        try:
            return _one_group(bits, width, total, codes[0], cache_bits).reshape(height, width)
        except _Shared:
            bits.at = begin
    out, cache = [0] * total, [0] * cache_size
    at = 0

    def remember(pixel: int) -> None:
        if cache_bits:
            cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while at < total:
        if meta is not None:
            green, red, blue, alpha, distance = codes[meta[at // width >> meta_bits, at % width >> meta_bits]]
        else:
            distance = codes[0][4]
        s = green.read(bits)
        if s < LITERALS:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            remember(out[at])
            at += 1
        elif s < LITERALS + LENGTHS:
            n = _extended(bits, s - LITERALS)
            d = _extended(bits, distance.read(bits))
            if d > len(NEIGHBOURS):
                d -= len(NEIGHBOURS)
            else:
                x, y = NEIGHBOURS[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference outside the image")
            for _ in range(n):
                out[at] = out[at - d]
                remember(out[at])
                at += 1
        else:
            out[at] = cache[s - LITERALS - LENGTHS]
            remember(out[at])
            at += 1
    return np.array(out, np.uint32).reshape(height, width)


def _fixed_width(bits: Bits, n: int, codes: tuple[Code, ...]) -> np.ndarray:
    """Pixels whose every channel takes as many bits as in any other pixel."""
    whole = sum(c.width for c in codes)
    end = bits.at + n * whole
    if end > 8 * len(bits.data):
        raise ValueError("the image ends too early")
    raw = np.frombuffer(bits.data, np.uint8, ((end + 7) >> 3) - (bits.at >> 3), bits.at >> 3)
    each = np.unpackbits(raw, bitorder="little")[bits.at & 7 :][: n * whole].reshape(n, whole)
    bits.at = end
    pixel, column = np.zeros(n, np.uint32), 0
    for c, shift in zip(codes, (8, 16, 0, 24), strict=True):
        number = np.zeros(n, np.uint8)
        for _ in range(c.width):  # most significant bit first
            number = number << 1 | each[:, column]
            column += 1
        pixel |= c.symbols.astype(np.uint32)[number] << np.uint32(shift)
    return pixel


def _lookup(code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and number of bits by the next bits of the stream, the first one lowest."""
    if not code.width:
        return code.symbols.astype(np.int32), np.zeros(1, np.int32)
    spans = np.left_shift(1, code.width - code.lengths)
    turned = _turned(code.width)
    return np.repeat(code.symbols.astype(np.int32), spans)[turned], np.repeat(code.lengths.astype(np.int32), spans)[turned]


_EIGHT = np.arange(8, dtype=np.uint64)


def _one_group(bits: Bits, width: int, total: int, codes: list[Code], cache_bits: int) -> np.ndarray:
    """Pixels of an image with one group of codes.

    In a stretch of the stream every bit position is looked up as if a pixel or reference began there; then the positions
    where one does are followed from the first, eight at a stride, and the pixels between references are taken as arrays.
    A place in the colour cache stands for the one colour that has it, once that has occurred; where several colours
    share a place, the cache is kept pixel by pixel."""
    first_at = np.full(1 << cache_bits, total, np.int64)  # by place in the cache: where its colour first occurs
    colour_of = np.zeros(1 << cache_bits, np.uint32)
    tables = [(_lookup(c), (1 << c.width) - 1) for c in codes]
    (green, green_n), green_mask = tables[0]
    is_ref = (green >= LITERALS) & (green < LITERALS + LENGTHS)
    still = not any(c.width for c in codes[1:4])
    # Extra bits and base of a length's or distance's prefix.
    prefix = np.arange(DISTANCES)
    extra = np.maximum(0, (prefix - 2) >> 1)
    base = np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + 1)
    out, at = np.zeros(total, np.uint32), 0
    data = np.frombuffer(bits.data, np.uint8)
    while at < total:
        first = bits.at >> 3
        reach = max(1, min(STRETCH, len(data) - first, 8 * (total - at) + 8))
        raw = np.zeros(reach + 32, np.uint8)
        part = data[first : first + reach + 32]
        raw[: len(part)] = part
        wide = np.ndarray((reach + 24,), "<u8", raw, strides=(1,))
        window = lambda pos: (wide[pos >> 3] >> (pos & 7).astype(np.uint64)).astype(np.int64)
        # At every position the next 32 bits.
        ahead = (wide[:reach, None] >> _EIGHT).astype(np.uint16).ravel() & np.uint16(green_mask)
        step = green_n[ahead]
        if still:
            pixel = np.uint32(int(codes[1].symbols[0]) << 16 | int(codes[2].symbols[0]) | int(codes[3].symbols[0]) << 24)
        else:
            pos = np.arange(8 * reach)
            pixel, end = np.zeros(8 * reach, np.uint32), pos + step
            for ((table, n), mask), shift in zip(tables[1:4], (16, 0, 24), strict=True):
                k = window(end) & mask
                pixel |= table[k].astype(np.uint32) << np.uint32(shift)
                end += n[k]
            step = np.where(green[ahead] < LITERALS, end - pos, step)
        refs = is_ref[ahead].nonzero()[0]
        length = distance = np.zeros(0, int)
        if len(refs):
            kind = green[ahead[refs]] - LITERALS
            end = refs + green_n[ahead[refs]]
            length = base[kind] + (window(end) & ((1 << extra[kind]) - 1))
            end += extra[kind]
            ((table, n), mask) = tables[4]
            k = window(end) & mask
            kind = table[k]
            end += n[k]
            distance = base[kind] + (window(end) & ((1 << extra[kind]) - 1))
            step[refs] = end + extra[kind] - refs
        # Where tokens begin, until the stretch or the image ends.
        begin, stop = bits.at & 7, 8 * reach
        if not step.any():  # every pixel is the same and takes no bits
            if green[0] >= LITERALS:
                raise ValueError("a back-reference outside the image")
            out[at:] = np.uint32(green[0] << 8) | pixel.ravel()[0]
            return out
        left = total - at
        then = np.full(stop + 1, stop, np.int32)
        np.minimum(np.arange(stop, dtype=np.int32) + step, stop, out=then[:stop], casting="unsafe")
        strides = [then]
        for _ in range(3):
            strides.append(strides[-1][strides[-1]])
        far, here, chain = memoryview(strides[3]), begin, []
        add = chain.append
        while here < stop:
            add(here)
            here = far[here]
        chain = np.array(chain, np.int32)
        for k in (2, 1, 0):
            chain = np.stack([chain, strides[k][chain]], 1).ravel()
        chain = chain[: np.searchsorted(chain, stop)]
        symbol, whole = green[ahead[chain]], ~is_ref[ahead[chain]]
        place = np.searchsorted(refs, chain[~whole])
        size = np.ones(len(chain), np.int64)
        size[~whole] = length[place]
        ends = np.cumsum(size)
        used = min(len(chain), int(np.searchsorted(ends, left)) + 1)
        chain, ends, size, whole, symbol = chain[:used], ends[:used], size[:used], whole[:used], symbol[:used]
        bits.at = 8 * first + int(chain[-1] + step[chain[-1]])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends too early")
        if ends[-1] > left:
            raise ValueError("a back-reference outside the image")
        starts = at + ends - size
        plain, to, symbol = chain[whole], starts[whole], symbol[whole]
        colour = symbol.astype(np.uint32) << np.uint32(8) | (pixel[plain] if pixel.ndim else pixel)
        if cache_bits:
            held = symbol >= LITERALS
            slot = np.where(held, symbol - LITERALS - LENGTHS, (colour * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.int32))
            k = (~held).nonzero()[0][::-1]  # the first of each comes last, and stays
            new = first_at[slot[k]] == total
            first_at[slot[k][new]], colour_of[slot[k][new]] = to[k][new], colour[k][new]
            shared = (colour_of[slot[~held]] != colour[~held]).any()
            colour[held] = np.where(first_at[slot[held]] < to[held], colour_of[slot[held]], np.uint32(0))
            if shared or (first_at[slot[held]] >= to[held]).any():
                raise _Shared
        out[to] = colour
        place = place[: used - int(whole.sum())]
        to, far = starts[~whole], distance[place]
        back = np.where(far > len(NEIGHBOURS), far - len(NEIGHBOURS), _near_distances(width)[np.minimum(far, len(NEIGHBOURS)) - 1])
        if (back > to).any():
            raise ValueError("a back-reference outside the image")
        for a, n, d in zip(to.tolist(), length[place].tolist(), back.tolist(), strict=True):
            if d >= n:
                out[a : a + n] = out[a - d : a - d + n]
            else:
                out[a : a + n] = np.resize(out[a - d : a], n)
        at += int(ends[-1])
    return out


# Channels are int arrays of (..., 4) in the order alpha, red, green, blue.
def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The prediction of one of the 14 modes from neighbouring pixels, given as channels."""
    mean = lambda a, b: (a + b) >> 1
    match mode:
        case 0:
            return np.zeros_like(left) + np.array([255, 0, 0, 0], np.int32)
        case 1:
            return left
        case 2:
            return top
        case 3:
            return top_right
        case 4:
            return top_left
        case 5:
            return mean(mean(left, top_right), top)
        case 6:
            return mean(left, top_left)
        case 7:
            return mean(left, top)
        case 8:
            return mean(top_left, top)
        case 9:
            return mean(top, top_right)
        case 10:
            return mean(mean(left, top_left), mean(top, top_right))
        case 11:  # the neighbour that is nearer to left + top - top_left
            nearer = np.abs(top - top_left).sum(-1, keepdims=True) < np.abs(left - top_left).sum(-1, keepdims=True)
            return np.where(nearer, left, top)
        case 12:
            return np.clip(left + top - top_left, 0, 255)
        case 13:
            m = mean(left, top)
            return np.clip(m + np.trunc((m - top_left) / 2).astype(np.int32), 0, 255)
        case _:
            return predict(0, left, top, top_right, top_left)


_FROM_ABOVE = frozenset({0, 2, 3, 4, 8, 9, 14, 15})  #: modes that need no pixel of the same row


def _undo_whole(residual: np.ndarray, mode: int) -> np.ndarray:
    """The predictor undone where black, the left or the upper pixel predicts the whole image: running sums of bytes."""
    out = np.ascontiguousarray(residual).view(np.uint8).reshape(*residual.shape, 4).copy()
    out[0, 0, 3:] += np.uint8(255)
    out[0] = np.cumsum(out[0], 0, np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], 0, np.uint8)
    if mode == 0:
        out[1:, 1:, 3] += np.uint8(255)
    elif mode == 1:
        out[1:] = np.cumsum(out[1:], 1, np.uint8)
    else:
        out = np.cumsum(out, 0, np.uint8)
        out[:, 0] = np.cumsum(np.ascontiguousarray(residual).view(np.uint8).reshape(*residual.shape, 4)[:, 0], 0, np.uint8)
        out[:, 0, 3] += np.uint8(255)
    return out.view(np.uint32)[..., 0]


def _undo_predictor(residual: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = residual.shape
    if (modes == modes.flat[0]).all() and int(modes.flat[0]) < 3 and sys.byteorder == "little":
        return _undo_whole(residual, int(modes.flat[0]))
    rest, out = _channels(residual), np.zeros((height, width, 4), np.int32)
    out[0] = np.cumsum(rest[0] + np.where(np.arange(width)[:, None] == 0, [255, 0, 0, 0], 0), 0) & 255
    for y in range(1, height):
        above, row = out[y - 1], out[y]
        row[0] = (rest[y, 0] + above[0]) & 255
        for x0 in range(0, width, 1 << size_bits):
            mode = int(modes[y >> size_bits, x0 >> size_bits])
            a, b = max(1, x0), min(width, x0 + (1 << size_bits))
            if a >= b:
                continue
            right = np.concatenate([above[a + 1 : b + 1], row[:1]]) if b == width else above[a + 1 : b + 1]
            if mode in _FROM_ABOVE:
                row[a:b] = (rest[y, a:b] + predict(mode, above[a:b], above[a:b], right, above[a - 1 : b - 1])) & 255
            elif mode == 1:
                row[a:b] = (row[a - 1] + np.cumsum(rest[y, a:b], 0)) & 255
            else:
                for x in range(a, b):
                    row[x] = (rest[y, x] + predict(mode, row[x - 1], above[x], right[x - a], above[x - 1])) & 255
    return _packed(out)


def _cross_colour(pixels: np.ndarray, elements: np.ndarray, size_bits: int, undo: bool) -> np.ndarray:
    if (elements == elements.flat[0]).all():
        elements = elements[:1, :1]
    else:
        y, x = np.indices(pixels.shape)
        elements = elements[y >> size_bits, x >> size_bits]
    c, e = _channels(pixels), _channels(elements).astype(np.int8).astype(np.int32)
    signed = lambda v: (v & 255).astype(np.uint8).astype(np.int8).astype(np.int32)
    green = signed(c[..., 2])
    sign = 1 if undo else -1
    red = c[..., 1] + sign * (e[..., 3] * green >> 5)
    true_red = red if undo else c[..., 1]
    blue = c[..., 3] + sign * ((e[..., 2] * green >> 5) + (e[..., 1] * signed(true_red) >> 5))
    return _packed(np.stack([c[..., 0], red, c[..., 2], blue], -1))


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    g = pixels >> np.uint32(8) & np.uint32(255)
    red, blue = pixels >> np.uint32(16) & np.uint32(255), pixels & np.uint32(255)
    g = g if sign > 0 else np.uint32(256) - g
    return pixels & np.uint32(0xFF00FF00) | ((red + g) & np.uint32(255)) << np.uint32(16) | (blue + g) & np.uint32(255)


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode_vp8l(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            part = _decode_pixels(bits, _up(now, size_bits), _up(height, size_bits), False)
            undo.append((kind, part, size_bits, now))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, None, 0, now))
        else:
            size = bits.read(8) + 1
            colours = _packed(np.cumsum(_channels(_decode_pixels(bits, size, 1, False)[0]), 0))
            undo.append((kind, colours, _palette_bits(size), now))
            now = _up(now, _palette_bits(size))
    pixels = _decode_pixels(bits, now, height, True)
    for kind, part, n, wide in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, part >> np.uint32(8) & np.uint32(15), n)
        elif kind == CROSS_COLOUR:
            pixels = _cross_colour(pixels, part, n, True)
        elif kind == SUBTRACT_GREEN:
            pixels = _green(pixels, 1)
        else:
            index = (pixels >> np.uint32(8) & np.uint32(255)).astype(int)
            if n:
                per, depth = 1 << n, 8 >> n
                index = (index[:, :, None] >> (np.arange(per) * depth) & ((1 << depth) - 1)).reshape(height, -1)[:, :wide]
            pixels = np.append(part, np.zeros(256, np.uint32))[index]
    return pixels


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Chunks of a RIFF file of form WEBP."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at, end = 12, 8 + struct.unpack("<I", data[4:8])[0]
    if end > len(data):
        raise ValueError("the file ends too early")
    yield from _parts(data, at, end)


def _parts(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    while at + 8 <= end:
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield data[at : at + 4], data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def frames(data: bytes) -> Iterator[np.ndarray]:
    """Pixels of the lossless image of a WebP file, or of each frame of an animation."""
    found = False
    for name, body in chunks(data):
        if name == b"VP8L":
            yield decode_vp8l(body)
            found = True
        elif name == b"ANMF":  # place, size, duration and flags, then the frame's own chunks
            for inner, part in _parts(body, 16, len(body)):
                if inner == b"VP8L":
                    yield decode_vp8l(part)
                    found = True
    if not found:
        raise ValueError("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file of one image."""
    first, *more = frames(data)
    if more:
        raise ValueError("the file has several frames")
    return first


def _changes(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new.nonzero()[0]


class Writer:
    """Bits, least significant first."""

    def __init__(self) -> None:
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 4096:
            whole = self.n >> 3
            self.parts.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def codes(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Many values, each of fewer than 64 bits and more than none: summed up in words, where no two overlap."""
        whole, off = self.n >> 3, self.n & 7
        self.parts.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
        ends = np.cumsum(sizes) + off
        begin, values = ends - sizes, values.astype(np.uint64)
        word, bit = begin >> 6, (begin & 63).astype(np.uint64)
        words = np.zeros((int(ends[-1]) >> 6) + 2, "<u8")
        first = _changes(word)
        words[word[first]] = np.add.reduceat(values << bit, first)
        over = ((begin & 63) + sizes > 64).nonzero()[0]
        words[word[over] + 1] |= values[over] >> (np.uint64(64) - bit[over])
        words[0] |= np.uint64(self.value >> 8 * whole)
        raw, total = words.tobytes(), int(ends[-1])
        self.parts.append(raw[: total >> 3])
        self.value, self.n = raw[total >> 3] & ((1 << (total & 7)) - 1), total & 7

    def done(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes((self.n + 7) >> 3, "little")


def _lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths by Huffman's method, with flatter counts until none is over the limit."""
    lengths = np.zeros(len(counts), int)
    used = counts.nonzero()[0]
    if len(used) < 2:
        lengths[used[0] if len(used) else 0] = 1
        return lengths
    weights, n = counts[used], len(used)
    while True:
        order = np.argsort(weights, kind="stable")
        # Leaves and what is made of them both come in order of weight; the least two are joined.
        leaves, made, parents = weights[order].tolist(), [], [0] * (2 * n - 1)
        i = j = 0
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if j >= len(made) or i < n and leaves[i] <= made[j]:
                    total += leaves[i]
                    parents[i] = node
                    i += 1
                else:
                    total += made[j]
                    parents[n + j] = node
                    j += 1
            made.append(total)
        depths = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depths[node] = depths[parents[node]] + 1
        lengths[used[order]] = depths[:n]
        if lengths.max() <= limit:
            return lengths
        weights = (weights + 1) // 2


def _pattern_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By symbol: its code's bits in the order of the stream, and their number."""
    pattern, size, code = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), Code(lengths)
    pattern[code.symbols] = _turned(15)[code.codes << (15 - code.lengths)]
    size[code.symbols] = code.lengths
    return pattern, size


def _bit_patterns(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    pattern, size = _pattern_table(lengths)
    return {s: (int(pattern[s]), int(size[s])) for s in lengths.nonzero()[0].tolist()}


def _write_single(w: Writer, symbol: int) -> None:
    """The code of a channel that doesn't change."""
    w.put(1 | (symbol > 1) << 2 | symbol << 3, 11 if symbol > 1 else 4)


def _write_code(w: Writer, lengths: np.ndarray) -> None:
    used = lengths.nonzero()[0].tolist()
    if len(used) == 1 and used[0] < 256:
        _write_single(w, used[0])
        return
    if len(used) == 2 and used[-1] < 256:
        w.put(1, 1)
        w.put(1, 1)
        w.put(int(used[0] > 1), 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        w.put(used[1], 8)
        return
    tokens, previous = [], 8
    edges = _changes(lengths)
    values, edges = lengths[edges].tolist(), [*edges.tolist(), len(lengths)]
    for v, run in zip(values, map(int.__sub__, edges[1:], edges), strict=True):
        if v and v != previous:
            tokens.append((v, 0, 0))
            previous, run = v, run - 1
        most = 6 if v else 138
        while run >= 3:
            n = min(run, most)
            tokens.append((16, n - 3, 2) if v else (18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
            run -= n
        tokens += [(v, 0, 0)] * run
    outer = _lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    stored = max(4, max(i + 1 for i, k in enumerate(CODE_LENGTH_ORDER) if outer[k]))
    w.put(0, 1)
    w.put(stored - 4, 4)
    for k in CODE_LENGTH_ORDER[:stored]:
        w.put(int(outer[k]), 3)
    w.put(0, 1)
    patterns = _bit_patterns(outer)
    value = size = 0
    for k, extra, n in tokens:
        bits, m = patterns[k]
        value |= (bits | extra << m) << size
        size += m + n
    w.put(value, size)


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of a length or distance from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def _tokens(pixels: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """(position, "pixel", argb), (position, "copy", length, distance code) or (position, "cache", index)."""
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEIGHBOURS)))}
    cache, where, found, at = {}, {}, [], 0
    while at < len(pixels):
        n = 1
        key = tuple(pixels[at : at + 3])
        if references and len(key) == 3 and (before := where.get(key)) is not None:
            n = 0
            while at + n < len(pixels) and n < 4096 and pixels[before + n] == pixels[at + n]:
                n += 1
            found.append((at, "copy", n, near.get(at - before, at - before + len(NEIGHBOURS))))
        else:
            p = pixels[at]
            slot = (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            found.append((at, "cache", slot) if cache_bits and cache.get(slot) == p else (at, "pixel", p))
        for i in range(at, at + n):
            where[tuple(pixels[i : i + 3])] = i
            if cache_bits:
                cache[(CACHE_FACTOR * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[i]
        at += n
    return found


def _write_pixels(w: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, groups: np.ndarray | None = None, group_bits: int = 2) -> None:
    height, width = pixels.shape
    if not cache_bits and groups is None and (pixels == pixels.flat[0]).all():  # codes of one symbol say it all
        p = int(pixels.flat[0])
        w.put(0, 1 + main)
        for symbol in (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24, 0):
            _write_single(w, symbol)
        return
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(groups is not None), 1)
        if groups is not None:
            w.put(group_bits - 2, 3)
            _write_pixels(w, groups.astype(np.uint32) << np.uint32(8) | np.uint32(BLACK), False)
    n_groups = int(groups.max()) + 1 if groups is not None else 1
    tokens = _tokens(pixels.ravel().tolist(), width, cache_bits, references)
    alphabets = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    counts = [[np.zeros(n, np.int64) for n in alphabets] for _ in range(n_groups)]
    items = []
    for at, kind, *rest in tokens:
        g = int(groups[at // width >> group_bits, at % width >> group_bits]) if groups is not None else 0
        if kind == "pixel":
            p = rest[0]
            parts = [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
        elif kind == "cache":
            parts = [(0, LITERALS + LENGTHS + rest[0], 0, 0)]
        else:
            (a, extra, n), (b, more, m) = _prefix(rest[0]), _prefix(rest[1])
            parts = [(0, LITERALS + a, extra, n), (4, b, more, m)]
        for c, s, _, _ in parts:
            counts[g][c][s] += 1
        items.append((g, parts))
    patterns = []
    for group in counts:
        lengths = [_lengths(c, 15) for c in group]
        for x in lengths:
            _write_code(w, x)
        patterns.append([_bit_patterns(x) for x in lengths])
    for g, parts in items:
        for c, s, extra, n in parts:
            w.put(*patterns[g][c][s])
            w.put(extra, n)


def _start(width: int, height: int, alpha: bool) -> Writer:
    w = Writer()
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(alpha), 1)
    w.put(0, 3)
    return w


def riff(*parts: tuple[bytes, bytes]) -> bytes:
    body = b"WEBP" + b"".join(name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1) for name, data in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode(pixels: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, green: bool = False, palette: bool = False, size_bits: int = 2, **coding) -> bytes:
    """A lossless WebP file. predictor: modes by block; cross: ARGB elements by block; coding: see _write_pixels()."""
    height, width = pixels.shape
    w = _start(width, height, True)
    if palette:
        colours, index = np.unique(pixels, return_inverse=True)
        steps = _packed(np.diff(_channels(colours), axis=0, prepend=0))
        n = _palette_bits(len(colours))
        w.put(1 | PALETTE << 1, 3)
        w.put(len(colours) - 1, 8)
        _write_pixels(w, steps[None, :], False)
        per, depth = 1 << n, 8 >> n
        index = np.pad(index.reshape(height, width), ((0, 0), (0, -width % per))).reshape(height, -1, per)
        pixels = ((index << (np.arange(per) * depth)).sum(-1).astype(np.uint32) << np.uint32(8)) | np.uint32(BLACK)
        width = pixels.shape[1]
    if predictor is not None:
        c = _channels(pixels)
        above = np.concatenate([np.zeros_like(c[:1]), c[:-1]])
        left = np.concatenate([np.zeros_like(c[:, :1]), c[:, :-1]], 1)
        top_left = np.concatenate([np.zeros_like(above[:, :1]), above[:, :-1]], 1)
        right = np.concatenate([above[:, 1:], c[:, :1]], 1)
        guess = np.zeros_like(c)
        y, x = np.indices(pixels.shape)
        mode = predictor[y >> size_bits, x >> size_bits]
        for m in np.unique(mode):
            guess = np.where((mode == m)[..., None], predict(int(m), left, above, right, top_left), guess)
        guess[0], guess[1:, 0], guess[0, 0] = left[0], above[1:, 0], [255, 0, 0, 0]
        pixels = _packed(c - guess)
        w.put(1 | PREDICTOR << 1, 3)
        w.put(size_bits - 2, 3)
        _write_pixels(w, predictor.astype(np.uint32) << np.uint32(8) | np.uint32(BLACK), False)
    if cross is not None:
        pixels = _cross_colour(pixels, cross, size_bits, False)
        w.put(1 | CROSS_COLOUR << 1, 3)
        w.put(size_bits - 2, 3)
        _write_pixels(w, cross, False)
    if green:
        pixels = _green(pixels, -1)
        w.put(1 | SUBTRACT_GREEN << 1, 3)
    w.put(0, 1)
    _write_pixels(w, pixels, True, **coding)
    return riff((b"VP8L", w.done()))


def _repeats(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of back-references, in order and apart: runs of SAME bytes and more that occur before."""
    n = len(values) - 7
    if n < SAME:
        return []
    keys = np.ndarray((n,), "<u8", np.ascontiguousarray(values), strides=(1,)).copy()
    if n < 1 << 20:  # a sort of hashes with their places is several times faster than a stable one of keys
        places = np.uint64((1 << 20) - 1)
        order = (np.sort(keys * np.uint64(0x9E3779B97F4A7C15) & ~places | np.arange(n, dtype=np.uint64)) & places).astype(np.int64)
    else:
        order = np.argsort(keys, kind="stable")
    again = (keys[order[1:]] == keys[order[:-1]]).nonzero()[0]
    back = np.zeros(n + 1, np.int64)
    back[order[again + 1]] = order[again + 1] - order[again]
    back[back > (1 << 20) - len(NEIGHBOURS)] = 0
    edges = _changes(back)
    found, at = [], 0
    for first, last, d in zip(edges[:-1].tolist(), edges[1:].tolist(), back[edges[:-1]].tolist(), strict=True):
        if d:
            first, end = max(first, at), last + 7
            while end - first >= SAME:
                n = min(end - first, COPY)
                found.append((first, n, d))
                at = first = first + n
    return found


@cache
def _near(width: int) -> dict[int, int]:
    return {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEIGHBOURS)))}


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix() of many values."""
    v = values - 1
    high = np.frexp(np.maximum(v, 1).astype(float))[1].astype(np.int64) - 1
    n = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(0, high - 1) & 1)), np.where(v < 4, 0, v & ((1 << np.maximum(0, n)) - 1)), n


def _cache_for(colours: np.ndarray) -> tuple[int, np.ndarray]:
    """The smallest colour cache, of CACHE_BITS at most, in which each of the colours has a place of its own, and their
    places; 0 if there is none."""
    for n in range(max(1, (len(colours) - 1).bit_length()), CACHE_BITS + 1):
        slots = (colours * np.uint32(CACHE_FACTOR) >> np.uint32(32 - n)).astype(np.int64)
        if len(np.unique(slots)) == len(colours):
            return n, slots
    return 0, np.zeros(0, np.int64)


def _write_green(w: Writer, green: np.ndarray, width: int, alpha: int, caching: bool = False) -> None:
    """An image whose only changing channel is green, with prefix codes of its own, back-references and, with caching, a
    colour cache, if one holds all colours: a value is a literal once, then its place there."""
    cache_bits = 0
    if caching:
        first = np.full(256, -1)
        first[green[::-1]] = np.arange(len(green) - 1, -1, -1)  # of equal values the first is written last
        values = (first >= 0).nonzero()[0]
        first = first[values]
        cache_bits, slots = _cache_for(np.uint32(alpha << 24) | values.astype(np.uint32) << np.uint32(8))
    w.put(int(cache_bits > 0) | cache_bits << 1, 5 if cache_bits else 1)
    w.put(0, 1)  # one group
    copied = np.array(_repeats(green), np.int64).reshape(-1, 3)
    starts, lengths = copied[:, 0], copied[:, 1]
    near = _near(width)
    (a, a_extra, a_n), (b, b_extra, b_n) = _prefixes(lengths), _prefixes(np.array([near.get(d, d + len(NEIGHBOURS)) for d in copied[:, 2].tolist()], np.int64))
    inside = np.zeros(len(green) + 1, np.int64)
    inside[starts] += 1
    inside[starts + lengths] -= 1
    literal = np.cumsum(inside)[:-1] == 0
    symbol = green.astype(np.int64)
    if cache_bits:
        place_of = np.zeros(256, np.int64)
        place_of[values] = slots + LITERALS + LENGTHS
        symbol = place_of[green]
        symbol[first] = values
    symbol[starts] = LITERALS + a
    literal[starts] = True
    made = []
    for used, alphabet in ((symbol[literal], LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)), (b, DISTANCES)):
        made.append(_lengths(np.bincount(used, minlength=alphabet), 15))
        if len(made) == 2:
            for still in (0, 0, alpha):  # red, blue, alpha
                _write_single(w, still)
        _write_code(w, made[-1])
    (pattern, size), (far_pattern, far_size) = map(_pattern_table, made)
    value, n = pattern[symbol], size[symbol] * literal
    bits = n[starts]
    more = value[starts]
    for v, m in ((a_extra, a_n), (far_pattern[b], far_size[b]), (b_extra, b_n)):
        more = more | v << bits
        bits = bits + m
    value[starts], n[starts] = more, bits
    told = n.nonzero()[0]
    if len(told):
        w.codes(value[told], n[told])


def _entropy(values: np.ndarray) -> float:
    counts = np.bincount(values.ravel(), minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(counts.sum() / counts)).sum())


def _grey_image(payload: bytes) -> tuple[bytes, int, int]:
    """One grey image, a pixel for each byte, with prefix codes and back-references. Few colours are a palette, several
    to a byte; of SMALL bytes and more red and blue are taken off by the cross-colour transform, from what the predictor
    leaves, whose mode is the cheapest for each block; of fewer bytes
    by subtract-green, and a colour cache holds the colours. Returns the bitstream, width and height."""
    values = np.frombuffer(payload, np.uint8)
    width = 64
    while -(-len(values) // width) > (SIDE if width >= WIDE else width):
        width *= 2
    height = -(-len(values) // width)
    grey = np.zeros((height, width), np.uint8)
    grey.ravel()[: len(values)] = values
    w = _start(width, height, False)
    colours = np.flatnonzero(np.bincount(grey.ravel(), minlength=256))
    alpha, caching = 255, False
    if len(colours) <= 16:
        n = _palette_bits(len(colours))
        w.put(1 | PALETTE << 1, 3)
        w.put(len(colours) - 1, 8)
        table = np.uint32(BLACK) | colours.astype(np.uint32) * np.uint32(0x010101)
        _write_pixels(w, _packed(np.diff(_channels(table), axis=0, prepend=0))[None, :], False)
        per, depth = 1 << n, 8 >> n
        index = np.searchsorted(colours, grey).reshape(height, -1, per)
        grey = (index << (np.arange(per) * depth)).sum(-1).astype(np.uint8)
    elif len(values) >= SMALL:
        left, top = np.diff(grey, axis=1, prepend=np.uint8(0)), np.diff(grey, axis=0, prepend=np.uint8(0))
        rest, modes = grey.copy(), np.zeros((_up(height, BLOCK), _up(width, BLOCK)), np.uint32)
        for (y, x), _ in np.ndenumerate(modes):
            block = np.s_[y << BLOCK : (y + 1) << BLOCK, x << BLOCK : (x + 1) << BLOCK]
            modes[y, x], rest[block] = min(((m, g[block]) for m, g in enumerate((grey, left, top))), key=lambda c: _entropy(c[1]))
        rest[0], rest[1:, 0], rest[0, 0] = left[0], top[1:, 0], grey[0, 0]
        grey, alpha = rest, 0
        w.put(1 | PREDICTOR << 1, 3)
        w.put(BLOCK - 2, 3)
        _write_pixels(w, modes << np.uint32(8) | np.uint32(BLACK), False)
        w.put(1 | CROSS_COLOUR << 1, 3)
        w.put(BLOCK - 2, 3)
        _write_pixels(w, np.full(modes.shape, 0xFF002020, np.uint32), False)  # all of green off red and off blue
    else:
        caching = True
        w.put(1 | SUBTRACT_GREEN << 1, 3)
    w.put(0, 1)  # no further transform
    _write_green(w, grey.ravel(), grey.shape[1], alpha, caching)
    return w.done(), width, height


def store(payload: bytes) -> bytes:
    """The payload as a WebP file: one image, or where it is longer than FRAME, an animation whose frames hold a part each."""
    size = b"SIZE", struct.pack("<Q", len(payload))
    if len(payload) <= FRAME:
        return riff((b"VP8L", _grey_image(payload)[0]), size)
    images = [_grey_image(payload[i : i + FRAME]) for i in range(0, len(payload), FRAME)]
    three = lambda *numbers: b"".join(n.to_bytes(3, "little") for n in numbers)
    canvas = struct.pack("<I", 2) + three(max(x for _, x, _ in images) - 1, max(y for _, _, y in images) - 1)
    shown = [(b"ANMF", three(0, 0, x - 1, y - 1, 0) + b"\0" + riff((b"VP8L", data))[12:]) for data, x, y in images]
    return riff((b"VP8X", canvas), (b"ANIM", bytes(6)), *shown, size)


def load(media: bytes) -> np.ndarray:
    """Samples of stored media: the green channel of its frames, without filling."""
    left = struct.unpack("<Q", dict(chunks(media))[b"SIZE"])[0]
    parts = []
    for image in frames(media):
        parts.append((image.ravel() >> np.uint32(8)).astype(np.uint8)[: min(FRAME, left)])
        left -= len(parts[-1])
    return np.concatenate(parts)


def pad(text: bytes) -> bytes:
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def feature(samples: np.ndarray) -> str:
    """Mean, standard deviation, mean step between neighbours, and shares of eight equal ranges of values."""
    counts = np.bincount(samples, minlength=256)
    n = len(samples)
    mean = counts @ np.arange(256) / n
    spread = np.sqrt(max(0.0, counts @ np.arange(256) ** 2 / n - mean * mean))
    step = np.maximum(samples[1:], samples[:-1]) - np.minimum(samples[1:], samples[:-1])
    shares = counts.reshape(8, 32).sum(1) / n
    return f"mean={mean:.4f};std={spread:.4f};step={int(step.sum(dtype=np.int64)) / max(1, n - 1):.4f};bins=" + ",".join(f"{s:.4f}" for s in shares)


def media(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, and with_media the stored file itself.

    The payload is the UTF-8 text with zero bytes up to a positive multiple of 64; all but n_bytes and the media's
    figures come from what was read back. A null text counts as empty. Repeated rows are stored each; an empty table
    gives an empty result; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = {
        "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
        "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
    } | ({"media": pa.binary()} if with_media else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                stored = store(pad(t or b""))
                samples = load(stored)
                payload = samples.tobytes()
                rows.append((len(t or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                             len(stored), hashlib.sha256(stored).hexdigest(), feature(samples), *([stored] if with_media else [])))
            columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", *fields])

    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = f"doc_id {kind}, " + ", ".join(f"{k} {sql[v]}" for k, v in fields.items())
    return docs.select("doc_id", docs["text"].cast("binary").alias("text")).mapInArrow(run, schema)


def pixels(files: DataFrame, column: str = "media") -> DataFrame:
    """files and width, height, pixels (row by row, ARGB in the bits of an int) of the lossless WebP files in the column.

    Any encoder's files are read. A null gives nulls; what is no lossless WebP file raises ValueError."""
    at = files.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row at a time, since images can be large
                data = b.column(at)[i].as_py()
                p = None if data is None else decode(data)
                row = b.slice(i, 1)
                for name, size in (("width", 1), ("height", 0)):
                    row = row.append_column(name, pa.array([None if p is None else p.shape[size]], pa.int32()))
                flat = pa.nulls(1, pa.list_(pa.int32())) if p is None else pa.ListArray.from_arrays(pa.array([0, p.size], pa.int32()), pa.array(p.ravel().view(np.int32)))
                yield row.append_column("pixels", flat)

    kind = IntegerType()
    schema = StructType([*files.schema.fields]).add("width", kind).add("height", kind).add("pixels", ArrayType(kind))
    return files.mapInArrow(run, schema)
