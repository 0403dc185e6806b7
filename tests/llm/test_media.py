import hashlib
import io
import wave
import zlib

import numpy as np
import pytest

from seriesmill.llm import media


def test_payloads():
    assert media.to_payload(None) == b" " * 192
    assert len(media.to_payload("a" * 192)) == 192 and len(media.to_payload("a" * 193)) == 384
    for text in ("", "é" * 500, "\x00\xff"):
        assert media.read_wav(media.write_wav(media.to_payload(text))) == media.to_payload(text)


def test_wav_is_standard():
    with wave.open(io.BytesIO(media.write_wav(b"abc" * 64))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, 192)


def test_a_tone_has_its_peak():
    t = np.arange(media.STEP * 20)
    for b in (5, 20, 40, 70):
        tone = (90 + 80 * np.sin(2 * np.pi * b * t / media.FRAME)).astype(np.uint8).tobytes()
        assert (media.spectrum_peaks(tone)[:, 0] == b).all()
    assert (media.spectrum_peaks(b" " * media.STEP * 9) == -1).all()


def plain_peaks(data):
    """Peaks by the sums of the definition."""
    out = []
    n = media.FRAME
    for at in range(0, len(data) - n + 1, media.STEP):
        frame = np.array(list(data[at : at + n]), float)
        frame = (frame - frame.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
        power = [round(abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(n) / n))) ** 2) for k in range(n // 2 + 1)]
        level = sum(power) / len(power)
        found = [k for k in range(1, n // 2) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > level]
        found = sorted(found, key=lambda k: (-power[k], k))[: media.PEAKS]
        out.append(found + [-1] * (media.PEAKS - len(found)))
    return out


def test_against_plain_transform():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, media.STEP * 30, dtype=np.uint8).tobytes()
    assert media.spectrum_peaks(data).tolist() == plain_peaks(data)
    text = media.to_payload("The quick brown fox jumps over the lazy dog, and so on and so on; 12 times 7 is 84. " * 20)
    assert media.spectrum_peaks(text).tolist() == plain_peaks(text)


def test_no_bin_rules():
    words = "of the and to thing erat onthe ation shed wh ntly edble".split()
    rng = np.random.default_rng(4)
    peaks = media.spectrum_peaks(media.to_payload(" ".join(rng.choice(words, 5000))))
    anchors = peaks[peaks >= 0]
    assert np.bincount(anchors).max() < len(anchors) / 5


def test_shifted_audio_keeps_its_codes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, media.STEP * 60, dtype=np.uint8).tobytes()
    t, c = media.pair_fingerprints(data)
    moved_t, moved_c = media.pair_fingerprints(b"\x80" * media.STEP * 5 + data)
    assert set(zip((t + 5).tolist(), c.tolist())) <= set(zip(moved_t.tolist(), moved_c.tolist()))


def test_all_pairs_of_peaks():
    for n in range(1, 8):
        data = np.random.default_rng(n).integers(0, 256, media.STEP * (n + 1), dtype=np.uint8).tobytes()
        peaks = media.spectrum_peaks(data).tolist()
        want = sorted((i, a << 16 | b << 8 | gap) for i in range(n) for gap in range(1, media.REACH + 1) if i + gap < n for a in peaks[i] for b in peaks[i + gap] if a >= 0 and b >= 0)
        t, c = media.pair_fingerprints(data)
        assert list(zip(t.tolist(), c.tolist())) == want


@pytest.mark.parametrize("at_once", [1, 7])
def test_blocks_change_nothing(monkeypatch, at_once):
    data = bytes(range(256)) * 30
    want = media.pair_fingerprints(data)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", at_once)
    assert all((a == b).all() for a, b in zip(want, media.pair_fingerprints(data)))


def test_table(docs, odd):
    rows = {r.doc_id: r for r in media.media_digests(docs([*odd, "a"])).collect()}
    for i, text in enumerate([*odd, "a"]):
        data, payload, r = (text or "").encode(), media.to_payload(text), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(payload) + 44, hashlib.sha256(media.write_wav(payload)).hexdigest())
    assert rows[4].feature == rows[len(odd)].feature and media.media_digests(docs([])).count() == 0
    assert len(rows[8].times) == len(rows[8].codes) == int(rows[8].feature.split(":")[0]) > 0
    full = media.media_columns(docs(["abc " * 200])).first()
    assert media.read_wav(full.media) == media.to_payload("abc " * 200) and len(full.times) == len(full.codes) > 0
