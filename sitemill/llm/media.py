"""Media columns: payloads stored as FLAC and read back as PCM blocks.

Writing and reading are narrow maps without a shuffle. A document's payload is
its text in UTF-8, filled with spaces to a positive multiple of ``UNIT`` bytes;
null texts are empty, so their payload is ``UNIT`` spaces. Equal texts give
equal streams. Texts go about ``MOST`` bytes at a time; a longer one goes
alone, in some 300 MB and eight times its size, its frames a run at a time.

Only the id and the text are read, so other columns and their names don't
matter. Rows that repeat an id or a text each give a row, ids may be null, no
order is asked for, so there are no ties, and an empty table gives none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import flac
from .common import enter, materialize, text_chunks

UNIT, MOST = 192, 1 << 20
#: Bytes of streams that are read together: steps are shared by more frames than on writing.
MOST_READ = 1 << 22
#: Streams have little to compress but their copies, which larger pages hold together.
STORED = {"parquet.page.size": str(8 << 20), "parquet.compression.codec.zstd.level": "9"}


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A FLAC stream for each document: ``doc_id, n_bytes, media``. Write it
    to store it; ``pcm_blocks`` and ``features`` read it back."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), MOST, "media"):
                media = flac.encode([payload(t) for t in chunk.rows()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), pa.array(np.diff(chunk.offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def _streams(column: pa.Array, most: int = MOST_READ) -> Iterator[tuple[int, bytes, flac.Stream]]:
    """Row, bytes and samples of each stored stream, about ``most`` bytes
    decoded together."""
    held: list[tuple[int, bytes]] = []
    size = 0

    def read() -> Iterator[tuple[int, bytes, flac.Stream]]:
        for (row, raw), stream in zip(held, flac.decode([raw for _, raw in held]), strict=True):
            yield row, raw, stream
        held.clear()

    for row, x in enumerate(column):
        if not x.is_valid:
            continue
        raw = x.as_py()
        if held and size + len(raw) > most:
            yield from read()
            size = 0
        held.append((row, raw))
        size += len(raw)
    if held:
        yield from read()


def _blocks(stream: flac.Stream) -> Iterator[tuple[int, int, bytes]]:
    """First sample, number of samples and PCM of each block."""
    for at, n in stream.blocks:
        yield at, n, flac.pcm_bytes(stream.samples[:, at : at + n], stream.info.bits)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Decodes streams to a row a block: ``doc_id, block, sample_offset,
    n_samples, pcm`` (interleaved signed little-endian), so a reader seeks by
    ``sample_offset``. Null streams give no block; a damaged one fails the
    task with the checksum that is wrong."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enter("media")
            for row, _, stream in _streams(batch.column(1)):
                rows = list(_blocks(stream))
                if rows:
                    first, count, pcm = zip(*rows, strict=True)
                    ids = batch.column(0).take(pa.array([row] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(rows)), pa.int32()), pa.array(first, pa.int64()), pa.array(count, pa.int32()), pa.array(pcm, pa.binary())], ["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    return media.select(id_col, media_col).mapInArrow(run, f"doc_id {kind}, block int, sample_offset long, n_samples int, pcm binary")


def feature(samples: np.ndarray) -> str:
    """Level and texture of a channel of samples, from whole-number sums."""
    n = max(len(samples), 1)
    total = squares = peak = crossings = steps = 0
    for lo in range(0, len(samples), MOST):
        x = samples[lo : lo + MOST + 1].astype(np.int64)  # with the first of the next part
        own = x[:MOST]
        total += int(own.sum())
        squares += int((own * own).sum())
        peak = max(peak, int(np.abs(own).max()))
        crossings += int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
        steps += int(np.abs(np.diff(x)).sum())
    return f"n={len(samples)};mean={total / n:.4f};rms={(squares / n) ** 0.5:.4f};peak={peak};zcr={crossings / n:.6f};step={steps / n:.4f}"


def features(stored: DataFrame) -> DataFrame:
    """Reads stored streams (``doc_id, n_bytes, media``) back as PCM blocks,
    with every checksum verified, and tells what they hold: ``doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature``."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    flip = bytes(b ^ 0x80 for b in range(256))  # signed samples are bytes of offset 128

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enter("media")
            rows = []
            for row, raw, stream in _streams(batch.column(2)):
                digest, size, tail = hashlib.sha256(), 0, b""
                for _, n, pcm in _blocks(stream):
                    back = pcm.translate(flip)
                    digest.update(back)
                    size += n
                    tail = (tail + back)[-16:]
                rows.append((row, size, digest.hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), feature(stream.samples[0])))
            if rows:
                of, size, sha, tail, held, held_sha, text = zip(*rows, strict=True)
                own = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(held, pa.int64()), pa.array(held_sha), pa.array(text)], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each payload as a FLAC stream in the shared folder and gives the
    ``features`` of what is read back from there."""
    return features(materialize(encode_media(docs, id_col, text_col), "media", "zstd", STORED))
