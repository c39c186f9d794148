"""Progressive JPEG: what is stored comes back, and decoding agrees with plain formulas."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from emberlens.llm import media
from emberlens.llm import progressive_jpeg as J

TEXTS = ["", None, "ab", "ÿ" * 500, "The quick brown fox. " * 900, "\x00\x7f" * 64, "x" * 64, "The quick brown fox. " * 900]


def payloads():
    return [media.padded((t or "").encode()) for t in TEXTS]


@pytest.mark.parametrize("payload", payloads())
def test_round_trip_fast_and_field_by_field(payload):
    image = J.encode(payload, b"more")
    fast, slow = J.Decoder(image), J.Decoder(image, fast=False)
    assert fast.payload() == payload == slow.payload()
    assert all((a == b).all() for a, b in zip(fast.coefficients, slow.coefficients))


def test_pixels_follow_the_formula():
    rng = np.random.default_rng(3)
    image = J.Decoder(J.encode(rng.integers(0, 256, 64 * 3, dtype=np.uint8).tobytes()))
    for c in image.coefficients:
        got = J.pixels(c[:1], np.ones(64))[0].reshape(8, 8)
        f = np.zeros((8, 8))
        f.reshape(-1)[J.ZIGZAG] = c[0]
        for y in range(8):
            for x in range(8):
                s = sum(
                    (math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1) * f[v, u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
                    for u in range(8)
                    for v in range(8)
                )
                want = min(255, max(0, s / 4 + 128))
                assert abs(got[y, x] - want) <= 0.51
    rgb = image.tensor()
    y, cb, cr = (J.pixels(c, np.ones(64)) for c in image.coefficients)
    luma = y.reshape(2, 2, 8, 8).transpose(0, 2, 1, 3).reshape(16, 16)
    blue = np.clip(luma + 1.772 * (cb.reshape(8, 8).repeat(2, 0).repeat(2, 1) - 128), 0, 255)
    assert rgb.shape == (16, 16, 3) and np.abs(rgb[:, :, 2] - blue).max() <= 1


def java_bytes(jvm, data):
    return jvm.java.io.ByteArrayInputStream(data)


def java_pixels(jvm, image: bytes) -> np.ndarray:
    """Another decoder's pixels."""
    read = jvm.javax.imageio.ImageIO.read(java_bytes(jvm, image))
    h, w = read.getHeight(), read.getWidth()
    flat = np.array(list(read.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([flat >> 16 & 255, flat >> 8 & 255, flat & 255], 2)


def java_progressive(jvm, rgb: np.ndarray, quality: float) -> bytes:
    """A progressive file of another encoder, with tables, runs and refinements of its own."""
    h, w, _ = rgb.shape
    picture = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, rgb[y, x])
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setProgressiveMode(1)
    how.setCompressionMode(2)
    how.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), how)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("quality", [0.3, 0.95])
def test_files_of_another_encoder(spark, quality):
    jvm = spark._jvm
    y, x = np.mgrid[0:27, 0:41]
    grey = (128 + 60 * np.sin(x / 3) + 40 * np.cos(y * x / 40)).clip(0, 255)
    smooth = np.stack([4 * x + 20, 6 * y + 30, 200 - 3 * x], 2).clip(0, 255)
    for rgb, most in ((np.stack([grey] * 3, 2), 2), (smooth, 14)):  # chroma is doubled in another way there
        data = java_progressive(jvm, rgb.astype(int), quality)
        image = J.Decoder(data)
        assert bytes([0xFF, J.SOF2]) in data and data.count(b"\xff\xda") >= 8
        got, want = image.tensor().astype(int), java_pixels(jvm, data)
        assert got.shape == want.shape == (27, 41, 3) and np.abs(got - want).max() <= most
        assert media.features([image])[0].startswith("41x27;")


def test_another_decoder_reads_our_files(spark):
    for text in ("The quick brown fox. " * 60, "", "ä€😀" * 90):
        image = J.encode(media.padded(text.encode()))
        ours, theirs = J.Decoder(image), java_pixels(spark._jvm, image)
        y = J.pixels(ours.coefficients[0], np.ones(64)).reshape(2 * ours.down, 2 * ours.across, 8, 8).transpose(0, 2, 1, 3).reshape(ours.height, ours.width)
        luma = theirs @ np.array([0.299, 0.587, 0.114])
        inside = ((theirs > 0) & (theirs < 255)).all(2)  # elsewhere it was cut off
        assert theirs.shape == (ours.height, ours.width, 3) and inside.mean() > 0.97 and np.abs(luma - y)[inside].max() <= 2.5


def test_features_tell_texts_apart():
    texts = {"English": "The quick brown fox jumps over the lazy dog. " * 40, "digits": "0123456789 " * 150, "umlauts": "äöüß " * 200, "capitals": "THE QUICK BROWN FOX. " * 80}
    images = {n: J.Decoder(J.encode(media.padded(t.encode()))) for n, t in texts.items()}
    rgb = {n: d.tensor() for n, d in images.items()}
    assert all(((x == 0) | (x == 255)).mean() < 0.02 for x in rgb.values())
    tilt = {n: [float(v) for v in media.features([d])[0].split(";")[5].split(",")] for n, d in images.items()}
    pairs = [(a, b) for a in tilt for b in tilt if a < b]
    assert all(math.dist(tilt[a], tilt[b]) > 1 for a, b in pairs), tilt


def plain_feature(d) -> str:
    """The feature by loops over pixels and coefficients."""
    px = d.tensor().reshape(-1, 3).astype(int).tolist()
    n = len(px)
    levels = [0] * 8
    for r, g, b in px:
        levels[(306 * r + 601 * g + 117 * b) >> 15] += 1
    means = [f"{sum(p[k] for p in px) * 1000 // n / 1000:.3f}" for k in range(3)]
    deviations = [f"{math.sqrt(sum(p[k] ** 2 for p in px) / n - (sum(p[k] for p in px) / n) ** 2):.3f}" for k in range(3)]
    blocks = [c for part in d.coefficients for c in part.astype(int).tolist()]
    energy = [f"{sum(b[k] ** 2 for b in blocks for k in range(a, z + 1)) / len(blocks) / (z - a + 1):.3f}" for a, z in media.SPECTRUM]
    tilt = [f"{sum(b[k] for b in blocks for k in range(first, 64, 2)) / len(blocks) / len(range(first, 64, 2)):.3f}" for first in (2, 1)]
    return ";".join([f"{d.width}x{d.height}", *(",".join(x) for x in (means, [str(v * 1000 // n) for v in levels], deviations, energy, tilt))])


def test_a_very_long_text_is_one_image(spark):
    text = "a long line of text. " * 150_000
    row = media.describe(media.store(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row["n_bytes"], row["payload_sha256"]) == (len(text), hashlib.sha256(media.padded(text.encode())).hexdigest())


def foreign() -> tuple[bytes, np.ndarray]:
    """A grey 8 x 8 image with a run of zeros, a late coefficient and a refinement that adds one, coded by hand."""
    bits = lambda s: bytes(int(s[i : i + 8].ljust(8, "1"), 2) for i in range(0, len(s), 8))
    dc = J._table(0, 0, {2: [0, 3]})
    ac = J._table(1, 0, {2: [0x21, 0x00], 3: [0x31]})
    refine = J._table(1, 1, {2: [0x01, 0x00]})
    head = bytes([0xFF, J.SOI]) + J._segment(J.DQT, bytes([0] + [2] * 64)) + J._segment(J.SOF2, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + J._segment(J.DHT, dc + ac + refine)
    scans = [((0, 0), 0, 0, 0, "01" + "101"), ((1, 63), 0, 1, 0, "00" + "1" + "01"), ((1, 63), 1, 0, 1, "00" + "0" + "01" + "1")]
    body = b"".join(J._segment(J.SOS, bytes([1, 1, t, *band, h << 4 | low])) + bits(s) for band, h, low, t, s in scans)
    want = np.zeros(64, np.int16)
    want[0], want[3], want[1] = 5, 3, -1
    return head + body + bytes([0xFF, J.EOI]), want


def test_a_foreign_image():
    image, want = foreign()
    d = J.Decoder(image)
    assert d.coefficients[0][0].tolist() == want.tolist()
    assert d.tensor().shape == (8, 8, 3)
    assert media.features([d])[0].startswith("8x8;")


def test_store_and_describe(spark):
    docs = spark.createDataFrame([(i if i != 1 else None, t, "m", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, media string, n_bytes int")
    stored = media.store(docs)
    got = {r["doc_id"]: r for r in media.describe(stored).collect()}
    images = {r["doc_id"]: r["media"] for r in stored.collect()}
    for i, t in enumerate(TEXTS):
        r, raw = got[i if i != 1 else None], (t or "").encode()
        payload = media.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload)) and len(payload) % 64 == 0 and payload
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        image = images[i if i != 1 else None]
        assert r["media_bytes"] == len(image) and r["media_sha256"] == hashlib.sha256(image).hexdigest()
        assert r["feature"] == plain_feature(J.Decoder(image))
    assert got[4]["feature"] == got[7]["feature"]
    tensor = media.tensors(stored.where("doc_id = 2")).first()
    assert len(tensor["rgb"]) == tensor["height"] * tensor["width"] * 3
    assert media.describe(media.store(docs.limit(0))).count() == 0
