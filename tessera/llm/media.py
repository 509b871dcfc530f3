"""Media columns: telephony audio stored in WAV containers, decoded by lookup tables and block arithmetic.

A payload of bytes is one sample per byte (mu-law or A-law) or one IMA ADPCM block per ``BLOCK`` bytes.
``encode`` wraps each payload losslessly in a WAV container; ``decode`` reads the container back, expands
mu-law and A-law samples through 256-entry tables, decodes ADPCM with numpy across all blocks of a row
group at once, and resamples to 16 kHz linear PCM, a WAV file of its own; ``read_pcm`` reads that one back.
Both forms are meant to be stored in between (``save`` with ``LAYOUT``).

``encode`` takes whole texts (null: empty), pads their UTF-8 bytes with spaces to a positive multiple of
``BLOCK``, and never fails on empty texts; equal texts give equal media.  Other columns of the input are
ignored (but for the order of rows); an empty table gives an empty result.  A PCM file is one value of a
column and four times its payload, so very long texts need memory: 32 MB passed in a heap of 2 GB, 64 MB failed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import CHUNK_BYTES, arrow_schema, chunks, text_columns

#: Bytes of an ADPCM block, and the multiple to which payloads are padded.
BLOCK = 192
RATE, PCM_RATE = 8000, 16000
#: How media are stored.  Files lie plain in their column and are compressed by the page; ``encode`` sorts the rows of a
#: task so that like texts share a window.  Rows of a group are bounded as a reader may hold all of them at once.
LAYOUT = {
    "parquet.compression.codec.zstd.level": "12",
    "parquet.enable.dictionary": "false",
    "parquet.page.size": str(24 << 20),
    "parquet.page.size.row.check.min": "10",
    "parquet.block.row.count.limit": "2048",
}
# WAV format tags and the bits of a sample.
FORMATS = {"mulaw": (7, 8), "alaw": (6, 8), "ima_adpcm": (0x11, 4)}
# The step sizes and index changes of IMA ADPCM; steps grow by a tenth from 7.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int64)
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int64,
)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: sign, 3 bits of exponent and 4 of mantissa, complemented, with a bias of 132."""
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; the two lowest segments are linear."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    segment, size = (code >> 4) & 7, ((code & 15).astype(np.int32) << 4) + 8
    size = np.where(segment > 0, (size + 256) << np.maximum(segment.astype(np.int32) - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}
_STEP = STEPS[:, None]
_CODE = np.arange(16)
#: For each step index and code: the change of the sample, and the next index.
_CHANGE = (
    (_STEP >> 3) + np.where(_CODE & 4, _STEP, 0) + np.where(_CODE & 2, _STEP >> 1, 0) + np.where(_CODE & 1, _STEP >> 2, 0)
) * np.where(_CODE & 8, -1, 1)
_CHANGE = _CHANGE.astype(np.int32).ravel()
_NEXT = (np.clip(np.arange(89)[:, None] + INDEX_CHANGE[_CODE & 7], 0, 88) << 4).astype(np.int32).ravel()


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (uint8, one row a block): each step is taken for all blocks at once."""
    count, width = blocks.shape
    out = np.empty(((width - 4) * 2 + 1, count), dtype=np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) << 4
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    at = 1
    for column in body:
        for code in (column & 15, column >> 4):
            place = index + code
            value = np.clip(value + _CHANGE[place], -32768, 32767)
            index = _NEXT[place]
            out[at] = value
            at += 1
    return out.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; the last sample is held."""
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    if len(pcm):
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
    return out


def wav(payload: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A WAV file of one channel; the payload lies in its data chunk as it is."""
    if codec == "pcm":
        head = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    else:
        tag, bits = FORMATS[codec]
        if codec == "ima_adpcm":
            samples = (BLOCK - 4) * 2 + 1
            head = struct.pack("<HHIIHHHH", tag, 1, rate, rate * BLOCK // samples, BLOCK, bits, 2, samples)
        else:
            head = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, bits, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(payload)) + payload
    body += b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and payload of a WAV file, by walking its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", data, at + 8)
            codec = next((c for c, (t, _) in FORMATS.items() if t == tag), "pcm")
        elif name == b"data":
            return codec, rate, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def pcm_file(data: bytes) -> tuple[str, bytes]:
    """The codec of a stored file, and its samples as a WAV file of 16-bit PCM at 16 kHz."""
    codec, _, payload = read_wav(data)
    raw = np.frombuffer(payload, dtype=np.uint8)
    if codec == "ima_adpcm":
        pcm = adpcm_decode(raw[: len(raw) // BLOCK * BLOCK].reshape(-1, BLOCK)).reshape(-1)
    else:
        pcm = TABLES[codec][raw]
    return codec, wav(resample(pcm).astype("<i2").tobytes(), "pcm", PCM_RATE)


def padded(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % BLOCK if text else BLOCK)


_MEDIA, _MEDIA_ARROW = arrow_schema("doc_id long, n_bytes long, media binary")
_FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)
_READ, _READ_ARROW = arrow_schema(_FEATURES)
_DECODED, _DECODED_ARROW = arrow_schema(f"{_FEATURES}, pcm binary")
_PCM, _PCM_ARROW = arrow_schema("doc_id long, codec string, pcm binary")


def encode(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """doc_id, n_bytes (unpadded) and media: a WAV file whose samples are the padded text's bytes.

    The rows of a task are sorted by lang, where there is one, and text; that bears on the stored size only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([wav(padded(t), codec) for t in texts], _MEDIA_ARROW.field("media").type),
                ],
                schema=_MEDIA_ARROW,
            )

    lang = [F.col("lang").cast("string")] if [c.lower() for c in docs.columns].count("lang") == 1 else []
    return text_columns(docs.sortWithinPartitions(*lang, F.col("text"))).mapInArrow(run, _MEDIA)


def _loudness(pcm: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares and number of sign changes of each file in a joined run of samples."""
    wide = pcm.astype(np.int64)
    power = np.add.reduceat(wide * wide, cuts[:-1])
    change = np.zeros(len(pcm), dtype=np.int64)
    change[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    change[cuts[1:-1]] = 0
    return power, np.add.reduceat(change, cuts[:-1])


def features(payloads: list[bytes]) -> list[str]:
    """What the payload sounds like as mu-law, as A-law and as ADPCM."""
    joined = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    cuts = np.concatenate(([0], np.cumsum([len(p) for p in payloads])))
    parts = []
    for codec in ("mulaw", "alaw"):
        pcm = TABLES[codec][joined]
        power, changes = _loudness(pcm, cuts)
        parts.append((codec[0], power, changes))
    samples = adpcm_decode(joined.reshape(-1, BLOCK))
    power, changes = _loudness(samples.reshape(-1), cuts // BLOCK * samples.shape[1])
    parts.append(("i", power, changes))
    return [";".join(f"{name}:{power[k]}:{changes[k]}" for name, power, changes in parts) for k in range(len(payloads))]


def decode(media: DataFrame) -> DataFrame:
    """Read stored media back: lengths and digests of payload and file, acoustic features, and the PCM file at 16 kHz."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media"):
            files = batch.column("media").to_pylist()
            payloads = [read_wav(f)[2] for f in files]
            columns = [
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()),
                pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                pa.array(features(payloads)),
                pa.array([pcm_file(f)[1] for f in files], _DECODED_ARROW.field("pcm").type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_DECODED_ARROW)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _DECODED)


def read_pcm(decoded: DataFrame) -> DataFrame:
    """Read stored PCM files back: what ``decode`` gives, with the CRC of their samples at the feature's end and without the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "pcm", 4 * CHUNK_BYTES):
            crcs = []
            for data in batch.column("pcm").to_pylist():
                codec, rate, samples = read_wav(data)
                if (codec, rate) != ("pcm", PCM_RATE):
                    raise ValueError("not a PCM file at 16 kHz")
                crcs.append(zlib.crc32(samples))
            feature = [f"{x};pcm16k:{crc:08x}" for x, crc in zip(batch.column("feature").to_pylist(), crcs, strict=True)]
            columns = [pa.array(feature) if name == "feature" else batch.column(name) for name in _READ_ARROW.names]
            yield pa.RecordBatch.from_arrays(columns, schema=_READ_ARROW)

    return decoded.select(*_DECODED.names).mapInArrow(run, _READ)


def to_pcm(media: DataFrame) -> DataFrame:
    """doc_id, codec and a 16-bit PCM WAV file at 16 kHz of each stored file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media", 1 << 20):
            codecs, files = zip(*map(pcm_file, batch.column("media").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(codecs), pa.array(files, _PCM_ARROW.field("pcm").type)], schema=_PCM_ARROW
            )

    return media.select("doc_id", "media").mapInArrow(run, _PCM)
