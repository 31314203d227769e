import hashlib
import hmac
import math
import struct
import zlib

import pytest

from markscope import queries as Q
from markscope.functions.rows import clean_text, hits_of, nfkc
from markscope.operators import containers as K
from markscope.operators import gumbel as G
from markscope.operators.characters import Options
from markscope.operators.stylometry import moving_ratio


def test_cleaning_of_planted_tails():
    for dirty, clean in ((Q.EMOJI, Q.EMOJI_CLEAN), (Q.FLAGS, Q.FLAGS_CLEAN), (Q.SCRIPTS, Q.SCRIPTS_CLEAN), (Q.ODD, Q.ODD_CLEAN), (Q.BIDI_TAIL, Q.BIDI_TAIL)):
        assert clean_text(dirty)[0] == clean
        assert clean_text(clean)[0] == clean
    assert clean_text(None)[0] is None and clean_text("")[0] == ""
    assert clean_text(Q.LOOKS, Options(aggressive=True))[0] == "aeopc"
    assert hits_of(Q.FLAGS) == [(0xE0001, "tag_chars", 1, [16]), (0xE0041, "tag_chars", 1, [17]), (0xE0067, "tag_chars", 1, [10])]
    assert nfkc("Ａb") == ("Ab", 1) and nfkc("ab") == ("ab", 0)


def test_moving_ratio():
    ws = [str(i * i % 37) for i in range(300)]
    want = sum(len(set(ws[i : i + 50])) / 50 for i in range(251)) / 251
    assert math.isclose(moving_ratio(ws), want) and moving_ratio([]) == 0.0 and moving_ratio(["a", "a"]) == 0.5


def test_replay():
    ids = [hashlib.sha256(w.encode()).digest()[:8] for w in "a b c d e f a b c d e f g".split()]
    got = G.replay(ids, G.Key.of("key"), 4)
    total, seen = 0.0, set()
    for t in range(4, len(ids)):
        w = b"".join(ids[t - 4 : t])
        if w not in seen:
            seen.add(w)
            seed = hmac.new(b"key", w, hashlib.sha256).digest()
            total -= math.log1p(-(int.from_bytes(hmac.new(seed, ids[t], hashlib.sha256).digest()[:8], "big") + 0.5) / 2**64)
    assert got["statistic"] == round(total, 6) and got["counted"] == len(seen) and got["skipped_repeated"] == len(ids) - 4 - len(seen)
    assert G.replay(ids[:3], G.Key.of("key"))["p_value"] == 1.0
    assert math.isclose(G.gamma_survival(2.0, 3), math.exp(-2) * (1 + 2 + 2))
    for bad in ("0x", "0xabc", "0xzz"):
        with pytest.raises(ValueError):
            G.Key.of(bad)
    for window, threshold in ((0, 0.5), (4, 0), (4, 1)):
        with pytest.raises(ValueError):
            G.check_options(window, threshold)


def chunk(kind, data):
    return struct.pack(">I4s", len(data), kind) + data + struct.pack(">I", zlib.crc32(kind + data))


def box(name, data):
    return struct.pack(">I4s", 8 + len(data), name) + data


def test_png():
    head, end = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13), chunk(b"IEND", b"")
    plain = head + chunk(b"IDAT", b"x") + end
    marked = head + chunk(b"zTXt", b"Software\0\0" + zlib.compress(b"made by ChatGPT")) + chunk(b"caBX", b"1") + chunk(b"IDAT", b"x") + end
    assert K.inspect_bytes(plain) == {"format": "png", "has_c2pa": False, "has_ai_metadata": False, "findings": []}
    assert K.inspect_bytes(marked)["findings"] == ["PNG zTXt: AI generator (Software=ChatGPT)", "PNG chunk caBX (possible C2PA container)"]
    assert K.clean_bytes(marked)["data"] == plain and K.clean_bytes(plain)["data"] == plain
    assert K.clean_bytes(marked[:-14])["actions"][-1].endswith("(file truncated)")


def test_jpeg_webp_gif_bmp():
    scan = b"\xff\xda\x00\x02data\xff\xd9"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xe1\x00\x08openai" + b"\xff\xfe\x00\x03c" + scan
    assert K.inspect_bytes(jpeg)["findings"] == ["JPEG APP1: OpenAI"]
    assert K.clean_bytes(jpeg)["data"] == b"\xff\xd8\xff\xe0\x00\x04ab" + scan
    body = b"WEBP" + b"VP8X" + struct.pack("<I", 10) + b"\x0c" + b"\0" * 9 + b"EXIF" + struct.pack("<I", 3) + b"abc\0"
    out = K.clean_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    assert out["data"][20] == 0x04 and b"EXIF" not in out["data"]
    gif = b"GIF89a" + b"\1\0\1\0\0\0\0" + b"\x21\xfe\x05hello\0" + b"\x21\xff\x0bNETSCAPE2.0\3\1\0\0\0" + b"\x3b"
    assert K.clean_bytes(gif)["actions"] == ["drop GIF comment extension"] and b"NETSCAPE" in K.clean_bytes(gif)["data"]
    bmp = b"BM" + struct.pack("<IHHIIiiHHII", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0, 0) + b"\0" * 16 + b"pix\0" + b"c2pa!"
    assert K.inspect_bytes(bmp)["has_c2pa"] and K.clean_bytes(bmp)["data"].endswith(b"pix\0")


def test_boxes_and_tiff():
    avif = box(b"ftyp", b"avif\0\0\0\0") + box(b"uuid", K.C.XMP_UUID + b"openai") + box(b"mdat", b"1234")
    out = K.clean_bytes(avif)
    assert len(out["data"]) == len(avif) and b"free" in out["data"] and b"openai" not in out["data"]
    assert K.clean_bytes(out["data"])["data"] == out["data"]
    text = b"made by OpenAI\0\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 3, 1, 1) + struct.pack("<HHII", 305, 2, 16, 38) + struct.pack("<I", 0) + text
    assert K.inspect_bytes(tiff)["findings"] == ["TIFF tag 305: OpenAI", "TIFF tag 305 (Software) present"]
    out = K.clean_bytes(tiff)
    assert len(out["data"]) == len(tiff) and out["data"].endswith(b"\0" * 16) and out["actions"] == ["drop TIFF tag 305 (Software)"]
    assert K.clean_bytes(out["data"])["data"] == out["data"]
    with pytest.raises(ValueError):
        K.clean_bytes(b"nothing")
