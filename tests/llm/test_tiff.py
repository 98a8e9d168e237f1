import struct

import numpy as np
import pytest

from lyraflux.llm import tiff

RNG = np.random.default_rng(1)
IMAGES = [np.zeros((1, 64), np.uint8), RNG.integers(0, 256, (70, 64)).astype(np.uint8), np.repeat(RNG.integers(0, 9, (130, 4)), 25, axis=1).astype(np.uint8)]


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16, 64])
def test_pages_come_back(scheme, predictor, tile):
    pages = list(tiff.pages_of(tiff.write_tiff(IMAGES, scheme, predictor, tile)))
    assert [(p[0], p[1], p[2]) for p in pages] == [(k, i.shape[1], i.shape[0]) for k, i in enumerate(IMAGES)]
    assert all(p[8] == i.tobytes() and p[10] is None for p, i in zip(pages, IMAGES, strict=True))


def test_lzw_of_long_and_varied_data():
    for data in (b"", b"a", b"ab" * 40_000, RNG.integers(0, 256, 60_000).astype(np.uint8).tobytes(), bytes(range(256)) * 50):
        assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    # The worked example of the published format
    assert tiff.lzw_decode(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80]), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_packbits_example():
    # The worked example of the published format
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    plain = bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4 + [0x80, 0x00, 0x2A, 0x22] + [0xAA] * 10)
    assert tiff.packbits_decode(packed, len(plain)) == plain


def test_big_endian_sixteen_bits_with_predictor():
    samples = np.array([[1, 300, 299], [5, 4, 70]], np.uint16)
    diff = np.concatenate([samples[:, :1], np.diff(samples, axis=1)], axis=1).astype(">u2").tobytes()
    fields = [(256, 3), (257, 2), (258, 16), (259, 1), (262, 1), (273, 8), (277, 1), (278, 2), (279, len(diff)), (317, 2)]
    at = 8 + len(diff)
    data = b"MM" + struct.pack(">HI", 42, at) + diff + struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in fields) + b"\0" * 4
    (page,) = tiff.pages_of(data)
    assert page[10] is None and np.frombuffer(page[8], np.uint16).tolist() == samples.ravel().tolist()


def test_broken_files_say_so():
    good = tiff.write_tiff(IMAGES[:1])
    loop = bytearray(good)
    (first,) = struct.unpack_from("<I", good, 4)
    struct.pack_into("<I", loop, len(good) - 4, first)
    assert len(list(tiff.pages_of(bytes(loop)))) == 1
    for bad in (None, b"", b"PNG", good[:20], good[:8] + b"\xff" * (len(good) - 8)):
        assert all(p[8] is None or p[10] is None for p in tiff.pages_of(bad))
    assert next(tiff.pages_of(None))[10] == "no media"


def tiff_of(fields, body=b"", order="<"):
    """A file of one directory with fields (tag, type, values) behind ``body``, which begins at byte 8."""
    kinds, at = {3: "H", 4: "I"}, 8 + len(body)
    entries, extra = b"", b""
    behind = at + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        raw = struct.pack(f"{order}{len(values)}{kinds[kind]}", *values)
        if len(raw) > 4:
            place, extra = struct.pack(order + "I", behind + len(extra)), extra + raw
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + place
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at) + body + struct.pack(order + "H", len(fields)) + entries + b"\0" * 4 + extra


def header(width, height, bits=8, **more):
    own = {"scheme": 1, "spp": 1, "rows": height, "offsets": [8], "counts": [width * height], "predictor": 1, "form": 1} | more
    return [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits]), (259, 3, [own["scheme"]]), (273, 4, own["offsets"]), (277, 3, [own["spp"]]), (278, 4, [own["rows"]]),
            (279, 4, own["counts"]), (317, 3, [own["predictor"]]), (339, 3, [own["form"]])]


def test_sizes_that_cannot_be_give_one_row_with_an_error():
    tiles = lambda w, t: tiff_of([(256, 4, [w]), (257, 4, [4]), (258, 3, [8]), (322, 4, [t]), (323, 4, [4]), (324, 4, [8]), (325, 4, [16])], bytes(16))
    bad = [
        tiff_of(header(0, 4), bytes(16)), tiff_of(header(4, 0, rows=1), bytes(16)), tiff_of(header(4, 4, rows=0), bytes(16)), tiles(4, 0), tiles(0, 4),
        tiff_of(header(2_000_000, 2_000_000, counts=[16]), bytes(16)), tiff_of(header(2_000_000, 2_000_000, scheme=8, counts=[16]), bytes(16)), tiff_of(header(4, 4, spp=0), bytes(16)),
        tiff_of(header(2_000_000, 2_000_000, counts=[0xFFFFFFFF]), bytes(16)), tiff_of(header(4, 4, bits=7), bytes(16)), tiff_of(header(4, 4, scheme=6), bytes(16)), tiff_of(header(4, 4, rows=1), bytes(16)),
    ]
    for data in bad:
        (page,) = tiff.pages_of(data)
        assert page[0] == 0 and page[8] is None and page[10]


def test_files_without_a_whole_first_directory_give_one_row():
    good = tiff.write_tiff(IMAGES[:1])
    files = []
    for at in (0, len(good), len(good) + 5, 0xFFFFFFFF, len(good) - 1, len(good) - 2):  # the last one is a directory of nothing
        files.append(bytearray(good))
        struct.pack_into("<I", files[-1], 4, at)
    (first,) = struct.unpack_from("<I", good, 4)
    for data in [*files, good[: first + 1], good[: first + 20]]:
        (page,) = tiff.pages_of(bytes(data))
        assert page[0] is None and page[8] is None and page[10]
    broken = bytearray(good)
    struct.pack_into("<I", broken, len(good) - 4, 10**9)
    assert [(p[0], p[10] is None) for p in tiff.pages_of(bytes(broken))] == [(0, True), (None, False)]


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_small_samples_become_bytes(bits):
    samples = RNG.integers(0, 1 << bits, (5, 11)).astype(np.uint8)
    planes = (samples[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    raw = np.packbits(planes.reshape(5, -1), axis=1).tobytes()
    (page,) = tiff.pages_of(tiff_of(header(11, 5, bits, counts=[len(raw)]), raw))
    assert page[10] is None and page[8] == samples.tobytes()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("spp", [1, 3])
def test_floating_point_differences_are_undone(order, spp):
    samples = RNG.normal(0, 100, (4, 6, spp)).astype(np.float32)
    planes = samples.astype(">f4").view(np.uint8).reshape(4, 6 * spp, 4).transpose(0, 2, 1).reshape(4, -1, spp)
    steps = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
    (page,) = tiff.pages_of(tiff_of(header(6, 4, 32, spp=spp, predictor=3, form=3, counts=[len(steps)]), steps, order))
    assert page[10] is None and np.array_equal(np.frombuffer(page[8], np.float32), samples.ravel())
