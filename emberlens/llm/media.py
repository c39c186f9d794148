"""Media columns: texts stored as progressive JPEG, and features of what is read back."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.llm.common import whole_text
from emberlens.llm.progressive_jpeg import Decoder, encode, mcu_rgb


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or 64 * (not data))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each whole text's UTF-8 in an image's coefficients.

    Null texts count as empty, of which a payload of zeros is stored; null ids and
    repeated rows stay; other columns, of any name, are left out; an empty table gives no rows. A text
    of any length is one image; the format's 65,535 pixels a side hold 3 GB, more than a text may have.
    """

    def run(batches):
        for batch in batches:
            n_bytes, media = [], []
            for text in batch.column(1).to_pylist():
                data = text.encode()
                n_bytes.append(len(data))
                media.append(encode(padded(data), len(data).to_bytes(8, "big")))
            for at, columns in _slices(batch.column(0), n_bytes, media):
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), whole_text(text_col).alias("text_")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def _groups(media: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Media in groups of about ``most`` bytes."""
    at = size = 0
    for k, m in enumerate(media, 1):
        size += len(m)
        if size >= most or k == len(media):
            yield media[at:k]
            at, size = k, 0


def _slices(ids: pa.Array, n_bytes: list[int], media: list[bytes], most: int = 1 << 26):
    """Rows in batches of about ``most`` bytes."""
    at = size = 0
    for k, m in enumerate(media, 1):
        size += len(m)
        if size >= most or k == len(media):
            yield at, [ids.slice(at, k - at), pa.array(n_bytes[at:k], pa.int64()), pa.array(media[at:k], pa.binary())]
            at, size = k, 0


#: MCUs whose pixels are made at a time.
MCUS = 2048
#: Bands of the spectrum in zigzag order, all but the mean, and the places of the payload's upper and lower half bytes.
SPECTRUM = ((1, 5), (6, 20), (21, 63))
_SQUARES, _PLACES = np.zeros((64, len(SPECTRUM)), np.float32), np.zeros((64, 2), np.float32)
for _k, (_a, _b) in enumerate(SPECTRUM):
    _SQUARES[_a : _b + 1, _k] = 1
_PLACES[2::2, 0], _PLACES[1::2, 1] = 1, 1


def _spectrum(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Of each block: the sum of squares in each band, and the sums at even and at odd places."""
    x = coefficients * quant.astype(np.float32)
    return np.concatenate([(x * x) @ _SQUARES, x @ _PLACES], 1).astype(np.float64)


def features(images: list[Decoder]) -> list[str]:
    """Of each image, parted by semicolons: its size; the mean of each channel; shares of eight levels of
    brightness in thousandths; the deviation of each channel; the mean square of coefficients in three bands; and their
    mean at even and at odd places. MCUs of many small images become pixels together."""
    n_images = len(images)
    sums, squares, levels, spectra = np.zeros((n_images, 3), np.int64), np.zeros((n_images, 3), np.int64), np.zeros((n_images, 8), np.int64), np.zeros((n_images, 5))

    def add(owner: np.ndarray, red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> None:
        for k, channel in enumerate((red, green, blue)):
            sums[:, k] += np.bincount(owner, channel.sum(1), n_images).astype(np.int64)
            squares[:, k] += np.bincount(owner, np.einsum("ij,ij->i", channel, channel), n_images).astype(np.int64)
        level = (306 * red + 601 * green + 117 * blue) >> 15
        levels.reshape(-1)[:] += np.bincount((owner[:, None] * 8 + level).ravel(), minlength=levels.size)

    def add_spectrum(owner: np.ndarray, blocks: np.ndarray, quant: np.ndarray) -> None:
        x = _spectrum(blocks, quant)
        for k in range(x.shape[1]):
            spectra[:, k] += np.bincount(owner, x[:, k], n_images)

    waiting: dict[bytes, list] = {}
    for i, image in enumerate(images):
        quants = [image.quant[c["q"]] for c in image.components]
        blocks = image.mcu_blocks()
        if blocks is None:
            for strip in image.strips():
                add(np.full(len(strip), i), *(strip[:, :, k].astype(np.int32) for k in range(3)))
            for c, q in zip(image.coefficients, quants):
                add_spectrum(np.full(len(c), i), c, q)
            continue
        waiting.setdefault(b"".join(q.tobytes() for q in quants), []).append((i, blocks, quants))
    for group in waiting.values():
        owner, quants = np.repeat([i for i, _, _ in group], [len(b[1]) for _, b, _ in group]), group[0][2]
        parts = [np.concatenate([b[k] for _, b, _ in group]) for k in range(3)]
        for at in range(0, len(owner), MCUS):
            some = [p[at : at + MCUS] for p in parts]
            own = owner[at : at + MCUS]
            add(own, *mcu_rgb(*some, quants))
            add_spectrum(np.repeat(own, 4), some[0].reshape(-1, 64), quants[0])
            for k in (1, 2):
                add_spectrum(own, some[k], quants[k])
    out = []
    for image, s, ss, x, sp in zip(images, sums.tolist(), squares.tolist(), levels.tolist(), spectra.tolist()):
        n, blocks = image.width * image.height, sum(map(len, image.coefficients))
        means = ",".join(f"{v * 1000 // n / 1000:.3f}" for v in s)
        deviations = ",".join(f"{math.sqrt(max(0, b * n - a * a)) / n:.3f}" for a, b in zip(s, ss))
        energy = ",".join(f"{v / blocks / (b - a + 1):.3f}" for v, (a, b) in zip(sp, SPECTRUM))
        tilt = ",".join(f"{v / blocks / c:.3f}" for v, c in zip(sp[3:], (31, 32)))
        out.append(f"{image.width}x{image.height};{means};{','.join(str(v * 1000 // n) for v in x)};{deviations};{energy};{tilt}")
    return out


def describe(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature)`` of what ``store`` stored, from the stored bytes alone.
    Pixels are made a strip at a time. Equal media have equal values."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for group in _groups(batch.column(1).to_pylist()):
                images = [Decoder(x) for x in group]
                for x, image, feature in zip(group, images, features(images)):
                    payload = image.payload()
                    own = (
                        int.from_bytes(image.comment[8:16], "big"), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                        len(x), hashlib.sha256(x).hexdigest(), feature,
                    )
                    for column, value in zip(rows, own):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds))], [id_col, *names])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "media").mapInArrow(
        run,
        f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def tensors(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, height, width, rgb)``: the full-resolution tensor of each image, row by row, three bytes a pixel. Rows are
    those of ``store``: null ids and repeated rows stay, an empty table gives none. It holds four bytes a byte of payload."""

    def run(batches):
        for batch in batches:
            for i, m in enumerate(batch.column(1).to_pylist()):
                t = Decoder(m).tensor()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([t.shape[0]], pa.int32()), pa.array([t.shape[1]], pa.int32()), pa.array([t.tobytes()], pa.binary())],
                    [id_col, "height", "width", "rgb"],
                )

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "media").mapInArrow(run, f"`{id_col}` {kind}, height int, width int, rgb binary")
