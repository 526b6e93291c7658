"""Media columns: AVI motion-JPEG made from texts, decoded again, and cut into shots.

A text's UTF-8 bytes, filled with spaces to a positive multiple of 192, become
the samples of 16 x 12 frames of an AVI file (see ``mjpeg``).  The file's bytes
are then parsed by their RIFF index, the intra frames decoded, and shots found
through adaptive differences of 16-bin histograms, giving timed clips.

Defined cases: a null text is empty, and an empty one is one frame of spaces;
a null doc_id stays null; equal texts give equal values in every column but
doc_id.  Ill-formed media raises ValueError in ``clips_of``.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import mjpeg, textkernel as tk
from .common import table

BINS = 16


def payload_of(text: bytes) -> bytes:
    """The text's bytes, filled with spaces to a positive multiple of 192."""
    return text + b" " * (-len(text) % mjpeg.SAMPLES if text else mjpeg.SAMPLES)


def histograms(samples: np.ndarray) -> np.ndarray:
    """Counts of ``BINS`` equal ranges of grey for each frame (row) of samples."""
    key = samples.reshape(len(samples), -1) // (256 // BINS) + np.arange(len(samples), dtype=np.int64)[:, None] * BINS
    return np.bincount(key.ravel(), minlength=len(samples) * BINS).reshape(-1, BINS)


def clips(hist: np.ndarray, fps: float) -> list[tuple[int, int, float, float]]:
    """(first frame, end frame, start second, end second) of each shot."""
    edges = [0, *mjpeg.cuts(hist).tolist(), len(hist)]
    return [(a, b, a / fps, b / fps) for a, b in zip(edges[:-1], edges[1:])]


def decode(media: bytes) -> tuple[list[np.ndarray], float]:
    """Frames of an AVI file as grey pixels; those of this package's own writer as samples, a pixel for each block."""
    found, fps = mjpeg.read_avi(media)
    frames = [media[a : a + n] for a, n in found]
    own = [f.startswith(mjpeg.HEADER) for f in frames]
    quick = iter(mjpeg.decode_frames([f for f, o in zip(frames, own) if o]))
    return [next(quick).reshape(mjpeg.HIGH, mjpeg.WIDE) if o else mjpeg.decode_jpeg(f) for f, o in zip(frames, own)], fps


def clips_of(media: DataFrame) -> DataFrame:
    """Timed clip rows (doc_id, clip, first_frame, end_frame, start_s, end_s) of a table (doc_id, media binary); null media has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            cols: list[tuple] = []
            for i, value in enumerate(batch.column("media")):
                if not value.is_valid:
                    continue
                frames, fps = decode(value.as_py())
                hist = np.concatenate([histograms(f.reshape(1, -1)) for f in frames]) if frames else np.zeros((0, BINS))
                for k, clip in enumerate(clips(hist, fps) if frames else []):
                    rows.append(i)
                    cols.append((k, *clip))
            columns = list(zip(*cols)) if cols else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s"],
            )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, clip long, first_frame long, end_frame long, start_s double, end_s double")


def _render(with_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            for first, end, raw, offs in tk.chunks(data, offsets, 1_000_000):
                texts = [raw[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])]
                filled = [payload_of(t) for t in texts]
                counts = [len(p) // mjpeg.SAMPLES for p in filled]
                jpegs = mjpeg.encode_frames(np.frombuffer(b"".join(filled), np.uint8).reshape(-1, mjpeg.SAMPLES))
                ends = np.cumsum(counts)
                files = [mjpeg.write_avi(jpegs[e - n : e]) for e, n in zip(ends.tolist(), counts)]
                stored, rates = [], []
                for f in files:
                    found, fps = mjpeg.read_avi(f)
                    stored += [f[a : a + n] for a, n in found]
                    rates.append(fps)
                samples = mjpeg.decode_frames(stored)
                hist = histograms(samples)
                out: list[tuple] = []
                for text, file, e, n, fps in zip(texts, files, ends.tolist(), counts, rates):
                    back = samples[e - n : e].tobytes()
                    shots = clips(hist[e - n : e], fps)
                    edges = np.array([s[0] for s in shots], "<u4").tobytes()
                    mean = hist[e - n : e].sum(axis=0)
                    feature = f"frames={n};shots={len(shots)};starts={zlib.crc32(edges):08x};peak={int(mean.argmax())};seconds={n / fps:.2f}"
                    out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [batch.column("doc_id").slice(first, end - first), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))]
                if with_media:
                    arrays.append(pa.array(files, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, NAMES + ["media"] * with_media)

    return run


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_columns(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Per document: sizes and digests of payload and media, a feature string and, unless left out, the AVI bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media
    return docs.select("doc_id", "text").mapInArrow(_render(with_media), schema)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), with_media=False)
