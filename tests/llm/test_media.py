"""Images against their definitions and exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from conftest import SMALL, folder

from tesserix.llm import media


def test_round_trips():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (17, 24)):
        grey, colour = rng.integers(0, 256, (h, w), np.uint8), rng.integers(0, 256, (h, w, 3), np.uint8)
        assert (media.decode(media.encode_pgm(grey)) == grey).all()
        assert (media.decode(media.encode_bmp(colour)) == colour).all()


def test_plain_netpbm():
    assert media.decode(b"P1\n# a comment\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15 0 15").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]


@pytest.mark.parametrize("data", [b"", b"P5 2", b"P9 1 1 1 1", b"GIF89a", b"P5 9 9 255\nxx", b"BM"])
def test_unreadable(data):
    with pytest.raises((ValueError, IndexError, __import__("struct").error)):
        media.decode(data)


def test_area_resize():
    image = np.arange(24, dtype=float).reshape(4, 6)
    assert np.allclose(media.area_resize(image, 2, 3), image.reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(image, 3, 5).mean(), image.mean())
    assert np.allclose(media.area_resize(image, 8, 12), np.kron(image, np.ones((2, 2))))


def test_features(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (40, 30), np.uint8)
    df = spark.createDataFrame([(1, bytearray(media.encode_pgm(image)), "x"), (2, None, "y"), (3, bytearray(b"junk"), "z")], "id long, m binary, tile string")
    got = {r["id"]: r for r in media.image_features(df, "m").collect()}
    import io

    tile = np.load(io.BytesIO(got[1]["tile"]))
    assert (got[1]["height"], got[1]["width"], tile.shape) == (40, 30, (32, 32)) and (tile == media.tiles_of(image)).all()
    assert got[2]["dhash"] is None and got[3]["tile"] is None


def test_area_resize_in_slices():
    """One slice or many, tall, wide or coloured: the means by their definition."""
    rng = np.random.default_rng(3)
    for shape in ((1500, 24), (7, 900), (301, 11, 3)):
        image = rng.integers(0, 256, shape, np.uint8)
        whole = media.area_resize(image, 8, 9)
        assert np.allclose(whole, np.einsum("ai,bj,ij...->ab...", weights(shape[0], 8), weights(shape[1], 9), image))
        media.SLICE, old = 50, media.SLICE
        try:
            assert np.allclose(media.area_resize(image, 8, 9), whole)
        finally:
            media.SLICE = old


def weights(old, new):
    """Row k: the share of the new sample k that each old sample covers."""
    return np.array([[max(0.0, min((k + 1) * old / new, j + 1) - max(k * old / new, j)) * new / old for j in range(old)] for k in range(new)])


def brute_form(padded):
    """The stored form, the difference hash and the tile, by their definitions."""
    if zlib.crc32(padded) % 2:
        n = len(padded)
        pixels = np.frombuffer(padded, np.uint8).reshape(-1, 8, 3)
        head = b"BM" + (54 + n).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (8).to_bytes(4, "little") + len(pixels).to_bytes(4, "little")
        head += b"\x01\0\x18\0" + bytes(4) + n.to_bytes(4, "little") + 2 * (2835).to_bytes(4, "little") + bytes(8)
        form, image = head + b"".join(bytes(row[:, ::-1].tobytes()) for row in pixels[::-1]), pixels
    else:
        image = np.frombuffer(padded, np.uint8).reshape(-1, 24)
        form = f"P5\n24 {len(image)}\n255\n".encode() + padded
    small = lambda h, w: np.einsum("ai,bj,ij...->ab...", weights(image.shape[0], h), weights(image.shape[1], w), image.astype(float))
    seen = small(8, 9)
    seen = np.round(seen.mean(axis=2) if seen.ndim == 3 else seen, 6)
    bits = "".join("01"[int(b)] for b in (seen[:, 1:] > seen[:, :-1]).ravel())
    return hashlib.sha256(form).hexdigest(), len(form), f"{int(bits, 2):016x}", np.clip(np.rint(np.round(small(16, 16), 6)), 0, 255).astype(np.uint8)


def brute(rows):
    out = []
    for r in rows:
        data = (r["text"] or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        out.append((r["doc_id"], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    return sorted(out, key=str)


def test_edge_rows(spark, edge, none, tmp_path):
    got = media.op8_media(spark, folder(spark, tmp_path, documents=edge)).collect()
    assert sorted([(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got], key=str) == brute(edge.collect())
    assert all(r["media_bytes"] > r["payload_bytes"] and len(r["media_sha256"]) == 64 for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert media.op8_media(spark, folder(spark, tmp_path / "none", documents=none)).collect() == []


def test_query(spark, small):
    got = media.op8_media(spark, SMALL).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in small.collect()}
    for r in got[:150]:
        data = texts[r["doc_id"]]
        form, n, feature, tile = brute_form(data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff"))
        assert (r["media_sha256"], r["media_bytes"], r["feature"]) == (form, n, feature)
        assert r["tile_sha256"] == hashlib.sha256(media.npy(tile)).hexdigest()
    assert {r["media_type"] for r in got} == {"image/bmp", "image/x-portable-graymap"}
    assert sorted([(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got], key=str) == brute(small.collect())
