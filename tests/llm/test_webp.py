import hashlib
import zlib

import numpy as np
import pytest

from retort.llm import webp

from . import plain_webp


def picture(rng, height=23, width=37, colours=None):
    if colours:
        return rng.choice(rng.integers(0, 1 << 32, colours, dtype=np.uint32), (height, width))
    base = np.cumsum(rng.integers(-2, 3, (height, width, 4)), 1) + 100
    return webp._packed(base.astype(np.int32))


@pytest.mark.parametrize("coding", [{}, {"references": True}, {"cache_bits": 4}, {"cache_bits": 11, "references": True}])
@pytest.mark.parametrize("colours", [None, 1, 2, 3, 16, 40])
def test_coding(coding, colours):
    p = picture(np.random.default_rng(1), colours=colours)
    assert (webp.decode(webp.encode(p, **coding)) == p).all()


def test_groups():
    rng = np.random.default_rng(2)
    p = picture(rng)
    groups = rng.integers(0, 5, (webp._up(23, 3), webp._up(37, 3)))
    assert (webp.decode(webp.encode(p, groups=groups, group_bits=3, references=True, cache_bits=3)) == p).all()


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    p = picture(np.random.default_rng(3))
    modes = np.full((webp._up(23, 2), webp._up(37, 2)), mode)
    assert (webp.decode(webp.encode(p, predictor=modes)) == p).all()


def test_known_predictions():
    px = lambda *v: np.array(v, np.int32)
    left, top, right, corner = px(255, 10, 200, 3), px(255, 20, 100, 250), px(255, 30, 0, 7), px(255, 13, 50, 9)
    want = {5: (255, 20, 100, 127), 6: (255, 11, 125, 6), 10: (255, 18, 87, 67), 11: (255, 20, 100, 250), 12: (255, 17, 250, 244), 13: (255, 16, 200, 184)}
    for mode, value in want.items():
        assert webp.predict(mode, left, top, right, corner).tolist() == list(value), mode


def test_all_transforms():
    rng = np.random.default_rng(4)
    p = picture(rng)
    shape = (webp._up(23, 2), webp._up(37, 2))
    cross = rng.integers(0, 1 << 32, shape, dtype=np.uint32) | np.uint32(webp.BLACK)
    data = webp.encode(p, predictor=rng.integers(0, 14, shape), cross=cross, green=True, references=True, cache_bits=6)
    assert (webp.decode(data) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 5, 16, 17, 200])
def test_palette(colours):
    p = picture(np.random.default_rng(5), colours=colours)
    assert (webp.decode(webp.encode(p, palette=True)) == p).all()


def test_neighbours_grow_outwards():
    assert len(set(webp.NEIGHBOURS)) == 120
    assert all(0 <= y <= 7 and -7 <= x <= 8 and (y or x > 0) for x, y in webp.NEIGHBOURS)
    far = [x * x + y * y for x, y in webp.NEIGHBOURS]
    assert far == sorted(far)


def test_hand_made_stream():
    """1 x 1, no transform, five simple codes: green 7, red 6, blue 5, alpha 255, distance 0."""
    w = webp._start(1, 1, True)
    w.put(0, 3)
    for s in (7, 6, 5, 255):
        w.put(1 | 1 << 2, 3)
        w.put(s, 8)
    w.put(1, 4)
    assert webp.decode_vp8l(w.done()).tolist() == [[0xFF060705]]


@pytest.mark.parametrize("n", [64, 128, 64 * 16384, 64 * 16385])
@pytest.mark.parametrize("kinds", [1, 2, 3, 60, 256])
def test_samples(n, kinds):
    payload = np.random.default_rng(n + kinds).integers(256 - kinds, 256, n).astype(np.uint8).tobytes()
    stored = webp.store(payload)
    assert webp.load(stored).tobytes() == payload
    assert webp.decode(stored).shape[1] % 64 == 0


def test_frames(monkeypatch):
    monkeypatch.setattr(webp, "FRAME", 128)
    payload = bytes(range(256)) * 3
    assert webp.load(webp.store(payload)).tobytes() == payload


def test_broken_streams():
    good = webp.encode(picture(np.random.default_rng(6)))
    for cut in (13, 30, len(good) // 2):
        with pytest.raises(ValueError):
            webp.decode(good[:cut])


def test_frame(spark):
    texts = ["Grüße", None, "", "x" * 64, "y" * 200_000, "x" * 64]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    got = {r.doc_id: r for r in webp.media(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\0" * (64 - len(raw) if len(raw) < 64 else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
    assert got[3][1:] == got[5][1:] and got[1][1:] == got[2][1:]
    assert webp.media(docs.where("false")).collect() == []


def test_column_of_files(spark):
    """Files with any transform, cache, groups; also null."""
    rng = np.random.default_rng(7)
    shape = (webp._up(23, 2), webp._up(37, 2))
    images = [picture(rng), picture(rng), picture(rng, colours=3), picture(rng)]
    modes, cross = rng.integers(0, 14, shape), rng.integers(0, 1 << 32, shape, dtype=np.uint32)
    data = [
        webp.encode(images[0], predictor=modes, cross=cross, green=True, references=True, cache_bits=6),
        webp.encode(images[1], groups=rng.integers(0, 3, shape), references=True),
        webp.encode(images[2], palette=True, references=True), webp.encode(images[3]), None,
    ]
    files = spark.createDataFrame([(i, bytearray(x) if x else None) for i, x in enumerate(data)], "k int, media binary")
    got = {r.k: r for r in webp.pixels(files).collect()}
    for i, p in enumerate(images):
        assert (got[i].height, got[i].width) == p.shape
        assert (np.array(got[i].pixels, np.int32).view(np.uint32) == p.ravel()).all()
    assert got[4].pixels is None and got[4].width is None


def test_stored_images_use_the_format(monkeypatch):
    """Stored texts have codes of several lengths, back-references and, between them, all four transforms."""
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(300)]
    texts = [b" ".join(words[i] for i in rng.zipf(1.3, n) % 300) for n in (100, 5000, 60_000)] + [b"0110" * 100 + b"1"]
    kinds, references, lengths = set(), 0, set()
    undo, cross, green = webp._undo_predictor, webp._cross_colour, webp._green
    monkeypatch.setattr(webp, "_undo_predictor", lambda *a: (kinds.add("predictor"), undo(*a))[1])
    monkeypatch.setattr(webp, "_cross_colour", lambda *a: (kinds.add("cross"), cross(*a))[1])
    monkeypatch.setattr(webp, "_green", lambda *a: (kinds.add("green"), green(*a))[1])
    read = webp._read_code

    def look(bits, alphabet):
        nonlocal references
        code = read(bits, alphabet)
        lengths.add(len(set(code.lengths.tolist())))
        references += alphabet == 280 and code.symbols.max() >= 256
        return code

    monkeypatch.setattr(webp, "_read_code", look)
    for t in texts:
        assert webp.load(webp.store(webp.pad(t))).tobytes() == webp.pad(t)
        kinds |= {"palette"} if len(set(webp.pad(t))) <= 16 else set()
    assert kinds == {"predictor", "cross", "green", "palette"} and references >= 3 and max(lengths) > 3
    assert len(webp.store(webp.pad(texts[2]))) < len(texts[2]) / 2


@pytest.mark.parametrize("mode", [0, 1, 2])
def test_whole_images_undone_as_sums_are_as_those_undone_by_rows(mode):
    rng = np.random.default_rng(mode)
    for shape in ((1, 1), (1, 7), (5, 1), (9, 13)):
        rest = rng.integers(0, 1 << 32, shape, dtype=np.uint32)
        modes = np.full(((shape[0] + 3) >> 2, (shape[1] + 3) >> 2), mode, np.uint32)
        mixed = modes.copy()
        got = webp._undo_whole(rest, mode)
        c, out = webp._channels(rest), np.zeros((*shape, 4), np.int64)
        for y in range(shape[0]):
            for x in range(shape[1]):
                black = np.array([255, 0, 0, 0])
                guess = black if x == y == 0 else out[0, x - 1] if y == 0 else out[y - 1, 0] if x == 0 else (black, out[y, x - 1], out[y - 1, x])[mode]
                out[y, x] = (c[y, x] + guess) & 255
        assert (got == webp._packed(out)).all() and (webp._undo_predictor(rest, mixed, 2) == got).all()


def test_against_a_plain_decoder():
    """What the operator stores, of all kinds of texts, and pictures with every transform, read by another decoder."""
    rng = np.random.default_rng(3)
    words = ["river", "stone", "light", "é", "漢", "over", "and", "the", "\n", "42"]
    texts = [b"", b"ab" * 300, " ".join(rng.choice(words, 200)).encode(), " ".join(rng.choice(words, 1500)).encode(), bytes(range(256)) * 20, rng.bytes(5000)]
    met = set()
    for t in texts:
        payload = webp.pad(t)
        stored = webp.store(payload)
        rows, kinds = plain_webp.decode(stored)
        met |= kinds
        assert bytes(p >> 8 & 255 for row in rows for p in row)[: len(payload)] == payload
        assert (webp.decode(stored) == np.array(rows, np.uint32)).all()
    assert met == {0, 1, 2, 3}
    p = picture(rng)
    modes = rng.integers(0, 14, (6, 10)).astype(np.uint32)
    cross = rng.integers(0, 1 << 24, (6, 10), dtype=np.uint32) | np.uint32(webp.BLACK)
    for stored, want in (
        (webp.encode(p, predictor=modes), p), (webp.encode(p, cross=cross, green=True, cache_bits=6, references=True), p),
        (webp.encode(p, groups=rng.integers(0, 3, (6, 10)), group_bits=2), p),
        (webp.encode(q := picture(rng, colours=7), palette=True, references=True), q),
    ):
        rows, _ = plain_webp.decode(stored)
        assert (np.array(rows, np.uint32) == want).all() and (webp.decode(stored) == want).all()


def test_stored_texts_use_the_colour_cache():
    payload = webp.pad(b"the river runs over old stones and the light comes in " * 3 + b"slowly")
    stream = webp.Bits(dict(webp.chunks(webp.store(payload)))[b"VP8L"])
    stream.read(8 + 14 + 14 + 1 + 3)
    assert (stream.read(1), stream.read(2), stream.read(1)) == (1, webp.SUBTRACT_GREEN, 0)
    assert stream.read(1) == 1 and 1 <= stream.read(4) <= 11
    assert webp.load(webp.store(payload)).tobytes() == payload


def test_colours_that_share_a_place_in_the_cache():
    """The fast reading of the cache gives way to the one by pixels."""
    rng = np.random.default_rng(5)
    for bits in (1, 2, 3):
        p = rng.choice(rng.integers(0, 1 << 32, 6, dtype=np.uint32), (20, 20))
        assert (webp.decode(webp.encode(p, cache_bits=bits, references=True)) == p).all()
