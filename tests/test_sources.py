"""Readers, writers, versions and the corpus job on files made here."""

import json
import struct

import numpy as np
import pytest

from parlance.functions import signal
from parlance.operators import corpus
from parlance.sources import files, versions, wav


@pytest.fixture
def folder(tmp_path):
    for speaker in ("ann", "bob"):
        (tmp_path / speaker).mkdir()
        for k in range(2):
            x, _ = signal.synthetic(ord(speaker[0]), k, 4.0, 3)
            (tmp_path / speaker / f"{k}.wav").write_bytes(wav.encode(x, signal.RATE))
    (tmp_path / "bob" / "copy.WAV").write_bytes((tmp_path / "ann" / "0.wav").read_bytes())
    (tmp_path / "bob" / "bad.wav").write_bytes(b"RIFFxxxxnope")
    (tmp_path / "bob" / "song.mp3").write_bytes(b"ID3")
    (tmp_path / "notes.txt").write_text("no")
    return tmp_path


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_decoding_pcm(bits):
    import struct

    x = np.array([0.0, 0.5, -0.5, 0.99])
    if bits == 8:
        body = np.round(x * 128 + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        body = b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x)
    else:
        body = np.round(x * ((1 << (bits - 1)) - 1)).astype(f"<i{bits // 8}").tobytes()
    raw = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000 * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", len(body)) + body
    rate, channels, got = wav.decode(raw)
    assert (rate, channels) == (8000, 1) and np.allclose(got, x, atol=0.01)


def test_decoding_aiff():
    import struct

    x = np.array([0.0, 0.5, -0.5])
    body = (x * 32767).astype(">i2").tobytes()
    comm = struct.pack(">hIhHQ", 1, 3, 16, 16383 + 15, int(44_100 * 2.0 ** (63 - 15)))
    chunks = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", 8 + len(body)) + bytes(8) + body
    rate, channels, got = wav.decode_aiff(b"FORM" + struct.pack(">I", 4 + len(chunks)) + b"AIFF" + chunks)
    assert (rate, channels) == (44_100, 1) and np.allclose(got, x, atol=1e-4)


@pytest.mark.parametrize("bits", [8, 12, 16, 24, 32])
@pytest.mark.parametrize("kind", [b"NONE", b"sowt"])
def test_decoding_aiff_of_any_width(bits, kind):
    """Integers in whole bytes, in both orders, behind an offset that the data chunk states."""
    width, values = -(-bits // 8), [0, 1, -1, (1 << (bits - 1)) - 1, -(1 << (bits - 1))]
    stored = b"".join((v << (8 * width - bits)).to_bytes(width, "little" if kind == b"sowt" else "big", signed=True) for v in values)
    form = struct.pack(">hIhHQ", 1, len(values), bits, 16383 + 15, 48_000 << 48) + (kind + b"\0\0" if kind == b"sowt" else b"")
    chunks = b"COMM" + struct.pack(">I", len(form)) + form + b"SSND" + struct.pack(">II", 8 + 6 + len(stored), 6) + b"\0\0\0\0" + b"ignore" + stored
    rate, channels, got = wav.decode_aiff(b"FORM" + struct.pack(">I", 4 + len(chunks)) + (b"AIFC" if kind == b"sowt" else b"AIFF") + chunks)
    assert (rate, channels) == (48_000, 1) and np.allclose(got, [v / (1 << (bits - 1)) for v in values])



def test_scan_and_corpus_job(spark, folder):
    found = files.scan(spark, str(folder))
    assert sorted(r.ext for r in found.select("ext").collect()) == ["mp3", "wav", "wav", "wav", "wav", "wav", "wav"]
    decoded = wav.read_wav(found)
    assert sorted(r.reason for r in decoded.where("reason is not null").collect()) == ["decode.notWav", "decode.unsupported"]
    mono = wav.best_channel(decoded)
    rows = corpus.without_copies(corpus.classified(corpus.analysed(mono), least_rate=16_000, least_seconds=2.0))
    table = spark.createDataFrame([("1.wav", "carl")], "file string, speaker string")
    rows = corpus.speaker_of(rows, table).cache()
    got = {(r.path.rsplit("/", 2)[-2], r.path.rsplit("/", 1)[-1]): r for r in rows.collect()}
    assert got["bob", "copy.WAV"]["class"] == "rejected" and "reject.duplicate" in got["bob", "copy.WAV"].codes
    assert got["ann", "1.wav"].speaker == "carl" and got["ann", "0.wav"].speaker == "ann"
    assert all(r.pitch_hz > 50 for k, r in got.items())
    people = corpus.speakers(rows).collect()
    assert {r.speaker for r in people} <= {"ann", "bob", "carl"}
    target = str(folder / "out")
    version = versions.digest(rows, ["path", "pcm"])
    assert version == versions.digest(rows.repartition(3), ["path", "pcm"]) and len(version) == 16
    versions.commit(spark, target, version, {"recording": rows, "speaker": corpus.speakers(rows)})
    versions.commit(spark, target, "next", {"recording": rows.limit(1)})
    assert versions.current(spark, target) == "next" and versions.table(spark, target, "recording").count() == 1
    assert versions.purge(spark, target) == [version]
    # A version that is current is written again; until its manifest is there, its tables stay.
    old = versions.table(spark, target, "recording")
    versions.commit(spark, target, "next", {"recording": old.unionByName(old)})
    assert old.count() == 1 and versions.table(spark, target, "recording").count() == 2
    assert versions.purge(spark, target, {"next"}) == [] and versions.purge(spark, target) == ["next"]


def test_wav_data_source(spark, folder):
    spark.dataSource.register(wav.WavSource)
    rows = spark.read.format("wav").option("paths", f"{folder}/ann/0.wav,{folder}/bob/bad.wav").load().collect()
    assert sorted((r.rate or 0, r.reason or "") for r in rows) == [(0, "decode.notWav"), (signal.RATE, "")]


def test_text_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text('file,speaker,language,labels\na.wav,"Ann ""A""",en,x\nb.wav,\n"c,d.wav",Bob\n')
    assert [(r.file, r.speaker) for r in files.speakers_csv(spark, str(tmp_path / "s.csv")).collect()] == [("a.wav", 'Ann "A"'), ("c,d.wav", "Bob")]
    (tmp_path / "p.txt").write_text("; comment\n 12 | F | name \n")
    assert [tuple(r) for r in files.piped(spark, str(tmp_path / "p.txt"), "id int, sex string, name string").collect()] == [(12, "F", "name")]
    (tmp_path / "r.csv").write_text("condition,metric,observed,target\na,m,1,2\na,m,3,2\n")
    assert [tuple(r) for r in files.results_csv(spark, str(tmp_path / "r.csv")).collect()] == [("a", "m", 2.0, 2.0, 2)]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps({"name": "x", "n": 1}))
    assert [(r.name, r.file) for r in files.json_folder(spark, str(tmp_path / "docs"), "name string, n int").collect()] == [("x", "a.json")]
    (tmp_path / "docs" / "b.json").write_text("{oops")
    with pytest.raises(Exception, match="b.json|Malformed"):
        files.json_folder(spark, str(tmp_path / "docs"), "name string, n int").collect()
    (tmp_path / "t.json").write_text(json.dumps({"seed": 3, "events": [{"id": 1, "start": -5, "end": 9}]}))
    assert [(r.seed, r.id, r.start) for r in files.timeline(spark, str(tmp_path / "t.json")).collect()] == [(3, 1, -5)]
    (tmp_path / "m1.json").write_text(json.dumps({"level": {"rmsDb": -3.0}}))
    (tmp_path / "m2.json").write_text(json.dumps({"metrics": {"level": {"rmsDb": -4.0}}}))
    assert sorted(r.level.rmsDb for r in files.metrics(spark, str(tmp_path / "m*.json"), "level:struct<rmsDb:double>").collect()) == [-4.0, -3.0]
