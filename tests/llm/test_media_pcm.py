"""op2 stores the resampled PCM of every document and takes the CRC from what it reads back."""

import zlib
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import media, queries

TEXTS = [None, "", "a", "é ü", "a", "x" * 192, "one two " * 100, "longer text, " * 9000]


def plain(payload):
    """Mu-law by its formula and twice the rate sample by sample."""
    pcm = []
    for byte in payload:
        code = byte ^ 255
        size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
        pcm.append(-size if code & 128 else size)
    out = []
    for k, value in enumerate(pcm):
        out += [value, (value + pcm[k + 1]) >> 1 if k + 1 < len(pcm) else value]
    return np.array(out, dtype="<i2").tobytes()


def folders(spark, name):
    root = Path(spark.conf.get("spark.checkpoint.dir", "file:///nowhere").removeprefix("file://"))
    return set(root.glob(f"tessera/{name}-*"))


def test_query_stores_the_pcm_of_every_document(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    media_before, pcm_before = folders(spark, "media"), folders(spark, "pcm")
    found = {r.doc_id: r for r in queries.op2_media_columns(spark, str(tmp_path)).collect()}
    (files,), (stored,) = folders(spark, "media") - media_before, folders(spark, "pcm") - pcm_before
    files, stored = ({r.doc_id: r for r in spark.read.parquet(f"file://{x}").collect()} for x in (files, stored))
    assert set(found) == set(files) == set(stored) == set(range(len(TEXTS)))
    for d, text in enumerate(TEXTS):
        payload = media.padded((text or "").encode())
        assert media.read_wav(bytes(files[d].media)) == ("mulaw", 8000, payload)
        assert media.read_wav(bytes(stored[d].pcm)) == ("pcm", 16000, plain(payload))
        assert found[d].feature.endswith(f";pcm16k:{zlib.crc32(plain(payload)):08x}")


@pytest.mark.parametrize("codec", list(media.FORMATS))
def test_the_crc_follows_the_stored_file(spark, codec):
    decoded = media.decode(media.encode(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), codec)).toPandas()
    decoded["pcm"] = [media.wav(f"sample{k:02d}".encode(), "pcm", media.PCM_RATE) for k in decoded.doc_id]
    for r in media.read_pcm(spark.createDataFrame(decoded, media._DECODED)).collect():
        assert r.feature.endswith(f";pcm16k:{zlib.crc32(f'sample{r.doc_id:02d}'.encode()):08x}")


def test_other_files_are_refused(spark):
    decoded = media.decode(media.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"))).toPandas()
    decoded["pcm"] = [media.wav(b"aa")]
    with pytest.raises(Exception, match="not a PCM file"):
        media.read_pcm(spark.createDataFrame(decoded, media._DECODED)).collect()
