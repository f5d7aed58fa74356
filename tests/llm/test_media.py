import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import media as m

RNG = np.random.default_rng(4)


def test_round_trips():
    for shape in ((1, 1, 3), (7, 5, 3), (64, 64, 3)):
        x = RNG.integers(0, 256, shape, dtype=np.uint8)
        assert (m.decode(m.encode_ppm(x)) == x).all()
        assert (m.decode(m.encode_bmp(x)) == x).all()
    grey = RNG.integers(0, 256, (6, 9), dtype=np.uint8)
    assert (m.decode(m.encode_ppm(grey)) == grey).all()


def test_every_netpbm_kind():
    assert m.decode(b"P1\n# c\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert m.decode(b"P4 9 1\n\x80\x80").tolist() == [[0, 255, 255, 255, 255, 255, 255, 255, 0]]
    assert m.decode(b"P2 2 1 # x\n9\n3 9").tolist() == [[3, 9]]
    assert m.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert m.decode(b"P5 1 2 65535\n\x01\x02\x03\x04").tolist() == [[258], [772]]
    for bad in (b"", b"P7", b"P5 2 2 255\n\x01", b"P5 x", b"P2 2 2 9 1", b"BM", b"P6 1 1 0\n"):
        assert m.features(bad)["error"]


def test_bmp_with_palette_and_top_down():
    x = RNG.integers(0, 256, (3, 5, 3), dtype=np.uint8)
    data = bytearray(m.encode_bmp(x))
    data[22:26] = (-3).to_bytes(4, "little", signed=True)
    assert (m.decode(bytes(data)) == x[::-1]).all()


def slow_resize(x, h, w):
    """Pixel by pixel with the overlap of each cell."""
    out = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            y0, y1, x0, x1 = i * x.shape[0] / h, (i + 1) * x.shape[0] / h, j * x.shape[1] / w, (j + 1) * x.shape[1] / w
            for a in range(x.shape[0]):
                for b in range(x.shape[1]):
                    out[i, j] += x[a, b] * max(0, min(y1, a + 1) - max(y0, a)) * max(0, min(x1, b + 1) - max(x0, b))
            out[i, j] /= (y1 - y0) * (x1 - x0)
    return out


@pytest.mark.parametrize("shape,to", [((5, 7), (3, 2)), ((3, 3), (8, 9)), ((8, 8), (8, 8)), ((1, 1), (4, 4)), ((13, 6), (8, 9))])
def test_area_resize(shape, to):
    x = RNG.integers(0, 256, shape).astype(float)
    assert np.allclose(m.area_resize(x, *to), slow_resize(x, *to))


def test_bands_give_the_same_sums(monkeypatch):
    x = RNG.integers(0, 256, (57, 11, 3), dtype=np.uint8)
    want = m.area_resize(x, 8, 9)
    for band in (1, 40, 33 * 7):
        monkeypatch.setattr(m, "BAND", band)
        assert np.allclose(m.area_resize(x, 8, 9), want, atol=1e-9)


def test_tiles_are_scaled_by_the_largest_sample():
    tile = lambda data: np.load(io.BytesIO(m.features(data)["tile"]))
    assert set(tile(b"P2 1 1 9 3").ravel()) == {85} and set(tile(b"P5 1 1 65535\n\x80\x00").ravel()) == {128}
    assert set(tile(b"P1 1 1 0").ravel()) == {255} and set(tile(m.encode_ppm(np.full((3, 4), 200))).ravel()) == {200}


def test_bmp_with_masks():
    """Masks name the channels' places; 16 bits without masks have five for each channel."""
    def bmp(bits, body, masks=()):
        return b"BM" + (54 + 4 * len(masks) + len(body)).to_bytes(4, "little") + bytes(4) + (54 + 4 * len(masks)).to_bytes(4, "little") + b"".join(
            v.to_bytes(n, "little") for v, n in ((40, 4), (1, 4), (1, 4), (1, 2), (bits, 2), (3 if masks else 0, 4), (len(body), 4), (0, 4), (0, 4), (0, 4), (0, 4))
        ) + b"".join(x.to_bytes(4, "little") for x in masks) + body

    assert m.decode(bmp(32, bytes([1, 2, 3, 4]), (0xFF, 0xFF00, 0xFF0000))).tolist() == [[[1, 2, 3]]]
    assert m.decode(bmp(32, bytes([1, 2, 3, 4]), (0xFF000000, 0xFF0000, 0xFF00))).tolist() == [[[4, 3, 2]]]
    assert m.decode(bmp(16, (0b11111_100000_00001).to_bytes(2, "little") + bytes(2), (0xF800, 0x07E0, 0x001F))).tolist() == [[[255, 130, 8]]]
    assert m.decode(bmp(16, (0b0_11111_00000_00001).to_bytes(2, "little") + bytes(2))).tolist() == [[[255, 0, 8]]]
    assert m.features(bmp(32, bytes(4), (0b101, 0xFF00, 0xFF0000)))["error"] and m.features(bmp(24, bytes(4), (255, 255, 255)))["error"]


def test_hash_and_tile():
    ramp = np.tile(np.arange(0, 90, 10, dtype=np.uint8), (8, 1))
    assert m.difference_hash(ramp) == (1 << 64) - 1 and m.difference_hash(ramp[:, ::-1]) == 0
    assert np.load(io.BytesIO(m.npy_tile(np.full((5, 5, 3), 7, np.uint8)))).shape == (32, 32, 3)


def slow_areas(x, height, width):
    """Each cell as the sum of its pixels, those at its edges in part, over its area."""
    def shares(n, cells):
        out = np.zeros((cells, n))
        for k in range(cells):
            for i in range(n):
                out[k, i] = max(0.0, min(i + 1, (k + 1) * n / cells) - max(i, k * n / cells))
        return out / (n / cells)

    return np.einsum("ai,bj,ijc->abc", shares(x.shape[0], height), shares(x.shape[1], width), x)


def test_tiles_are_written(spark, tmp_path, odd_docs):
    rows = m.texts_as_media(odd_docs)
    back = m.write_tiles(rows, str(tmp_path / "tiles"), "doc_id")
    want = {(r.doc_id, r.f.dhash, bytes(r.f.tile)) for r in m.media_features(rows).select("doc_id", F.col("features").alias("f")).collect()}
    got = back.collect()
    assert len(got) == odd_docs.count() and {(r.doc_id, r.dhash, bytes(r.tile)) for r in got} == want
    assert all(m.load_tile(r.tile).shape == (32, 32, 3) for r in got)
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id int, media binary")
    assert m.write_tiles(broken, str(tmp_path / "none"), "doc_id").count() == 0


def test_query(spark, sf_dir, texts):
    by_text = {}
    for r in m.op9_media(spark, sf_dir).collect():
        body = (texts[r.doc_id] or "").encode()
        payload = body + b" " * (max(1, -(-len(body) // 192)) * 192 - len(body))
        stored = m.encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, 64, 3))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        if body not in by_text and len(by_text) < 60:
            # Means of areas cell by cell, from the samples.
            x = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).astype(float)
            small, tile = (slow_areas(x, *size) for size in ((8, 9), (32, 32)))
            luma = np.round(small @ [0.299, 0.587, 0.114], 6)
            bits = "".join("1" if luma[a, b] < luma[a, b + 1] else "0" for a in range(8) for b in range(8))
            out = io.BytesIO()
            np.save(out, np.rint(np.round(tile, 9)).astype(np.uint8))
            near = np.abs(tile % 1 - 0.5).min() < 1e-6 or np.abs(np.diff(small @ [0.299, 0.587, 0.114], axis=1)).min() < 2e-6
            assert near or r.feature == f"{int(bits, 2):016x}:{hashlib.sha256(out.getvalue()).hexdigest()[:16]}"
        assert by_text.setdefault(body, r.feature) == r.feature
    assert len(set(by_text.values())) > 0.9 * len(by_text)


def test_odd_rows(spark, odd_docs, no_docs):
    out = m.media_features(m.texts_as_media(odd_docs))
    assert out.where("features.error is not null or features.tile is null").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, b"junk")], "id int, media binary")
    got = {r.id: r.features for r in m.media_features(nulls).collect()}
    assert got[1].error is None and got[1].dhash is None and got[2].error
    assert m.media_features(m.texts_as_media(no_docs)).count() == 0
