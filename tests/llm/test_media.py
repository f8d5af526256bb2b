import hashlib
import zlib

import numpy as np
import pytest

from tiersum.llm import media
from tiersum.llm.common import materialize


def plain_decode(data):
    """One image by the letter of the standard, bit by bit: coefficients of each component in diagonal order."""
    at, tables, interval, comps = 2, {}, 0, None
    while data[at + 1] != 0xD9:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xC4:
            while body:
                codes, code, k = {}, 0, 17
                for n in range(1, 17):
                    for _ in range(body[n]):
                        codes[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]], body = codes, body[k:]
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xC2:
            mcus = int.from_bytes(body[1:3], "big") // 16
            comps = [[[0] * 64 for _ in range(n * mcus)] for n in (4, 1, 1)]
        elif kind == 0xDA:
            blocks, first, last, high, low = comps[body[1] - 1], body[3], body[4], body[5] >> 4, body[5] & 15
            table = tables[0x10 | body[2] & 15] if first else tables[body[2] >> 4]
            end = at
            while not (data[end] == 255 and data[end + 1] not in (0, *range(0xD0, 0xD8))):
                end += 1
            pieces, piece, k = [], bytearray(), at
            while k < end:
                if data[k] == 255 and data[k + 1]:
                    pieces, piece, k = [*pieces, piece], bytearray(), k + 2
                else:
                    piece.append(data[k])
                    k += 2 if data[k] == 255 else 1
            pieces.append(piece)
            for p, piece in enumerate(pieces):
                plain_scan(piece, blocks[p * interval : (p + 1) * interval], table, first, last, high, low)
            at = end
    return comps


def plain_scan(piece, blocks, table, first, last, high, low):
    position, before, eob = 0, 0, 0

    def bit():
        nonlocal position
        position += 1
        return piece[(position - 1) // 8] >> (7 - (position - 1) % 8) & 1

    def bits(n):
        v = 0
        for _ in range(n):
            v = 2 * v + bit()
        return v

    def symbol():
        n = code = 0
        while (n, code) not in table:
            n, code = n + 1, 2 * code + bit()
        return table[n, code]

    def signed(n):
        v = bits(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def refine(b, k):
        if bit():
            b[k] += (1 if b[k] > 0 else -1) << low

    for b in blocks:
        if first == 0:
            if high:
                b[0] |= bit() << low
            else:
                before += signed(symbol())
                b[0] = before << low
            continue
        k = first
        while k <= last and not eob:
            r, s = divmod(symbol(), 16)
            if s == 0 and r < 15:
                eob = (1 << r) + bits(r)
                break
            if not high:
                k += r
                if s:
                    b[k] = signed(s) << low
                k += 1
            else:
                new = (2 * bit() - 1) << low if s else 0
                while k <= last:
                    if b[k]:
                        refine(b, k)
                    elif r == 0:
                        break
                    else:
                        r -= 1
                    k += 1
                if k <= last:
                    b[k] = new
                k += 1
        if eob:
            if high:
                for k in range(k, last + 1):
                    if b[k]:
                        refine(b, k)
            eob -= 1


RNG = np.random.default_rng(4)
PAYLOADS = {
    "text": media.payload_of("Hello, wörld. " * 90)[0],
    "empty": media.payload_of("")[0],
    "random": RNG.integers(0, 256, 576 * 3, dtype=np.uint8).tobytes(),
    "near zero": RNG.integers(126, 131, 576 * 4, dtype=np.uint8).tobytes(),
    "sparse": np.where(RNG.random(576 * 5) < 0.03, RNG.integers(0, 256, 576 * 5), 128).astype(np.uint8).tobytes(),
    "zeros": bytes([128]) * 576,
    "low": bytes(1152),
}


@pytest.mark.parametrize("name", PAYLOADS)
def test_round_trip_and_plain_decoder(name):
    p = PAYLOADS[name]
    (file,) = media.encode([p], [len(p) - 1])
    got = media.decode([file])
    assert got.payloads(1) == ([p], [len(p) - 1])
    assert sum(plain_decode(file), []) == got.coef.tolist()


def test_many_files_and_images(monkeypatch):
    monkeypatch.setattr(media, "MAX_MCUS", 3)
    files = media.encode(list(PAYLOADS.values()), [len(p) for p in PAYLOADS.values()])
    got = media.decode(files)
    assert got.payloads(len(files))[0] == list(PAYLOADS.values())
    assert max(got.mcus) == 3 and len(got.mcus) > len(files)
    alone = [media.decode([f]) for f in files]
    tall = media.rows_of(got.rgb(), got, len(files))
    for a, t in zip(alone, tall):
        assert (a.rgb() == t).all()


def test_end_of_band_runs_from_another_encoder():
    """A band whose blocks all end at once, coded as one run."""
    lanes = media.Lanes.of(np.array([5]))
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    length[:], symbol[:] = 1, 0x20  # a run of 4 to 7 blocks
    coef = np.ones((5, 64), np.int16) * 3
    media.decode_band(media.Bits(np.array([0b00100000], np.uint8)), np.array([0]), lanes, coef, (length, symbol), 1, 63, 1)
    media.decode_refining(media.Bits(np.array([0b00111111] + [255] * 50, np.uint8)), np.array([0]), lanes, coef, (length, symbol), 1, 63, 0)
    assert (coef[:, 1:] == 4).all()


def test_tensor_against_the_formula():
    p = PAYLOADS["random"]
    got = media.decode(media.encode([p], [len(p)]))
    rgb, n = got.rgb(), np.arange(8)
    basis = np.where(n == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16)
    square = np.empty((len(got.coef), 64))
    square[:, media.ZIGZAG] = got.coef
    level = [np.clip(np.floor(basis.T @ b.reshape(8, 8) @ basis + 128.5), 0, 255) for b in square]
    m = int(got.mcus[0])
    y = np.block([[level[2 * r], level[2 * r + 1]] for r in range(2 * m)])
    cb, cr = (np.kron(np.vstack(level[a * m : (a + 1) * m]), np.ones((2, 2))) - 128 for a in (4, 5))
    want = np.clip(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=-1), 0, 255)
    assert np.abs(want - rgb).max() < 3 and np.abs(want - rgb).mean() < 0.5  # samples may round to the next value before conversion


def test_damaged_files_are_refused():
    (file,) = media.encode([PAYLOADS["text"]], [1])
    scan = file.index(b"\xff\xda") + 12
    for bad in (file.replace(b"\xff\xc2", b"\xff\xd8", 1), file[:scan] + b"\xff\xd0" + file[scan:]):
        with pytest.raises((ValueError, IndexError)):
            media.decode([bad])


SCHEMA = "doc_id long, text string, media string, feature int"


def test_columns(spark):
    texts = [None, "", "x", "same", "same", "long text with ünïcode " * 3000, "\x7f\x01" * 500]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "same", "", 0), (0, None, "", 0)], SCHEMA)
    stored = media.store_texts(docs)
    got = media.read_media(stored).collect()
    assert len(got) == 9
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in got:
        text = "same" if r.doc_id is None else texts[r.doc_id]
        payload, size = media.payload_of(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest())
        assert len(r.rgb) == r.height * r.width * 3 and r.feature.startswith(f"{r.height}x16;")
    same = {(r.media_sha256, r.feature) for r in got if r.doc_id in (3, 4, None)}
    assert len(same) == 1
    assert media.read_media(media.store_texts(docs.limit(0)), tensors=False).count() == 0
    stored = stored.union(stored.limit(1).selectExpr("99L", "cast(null as binary)"))
    (lost,) = media.read_media(stored).filter("doc_id = 99").collect()
    assert all(v is None for c, v in lost.asDict().items() if c != "doc_id")
    assert media.read_media(stored).count() == 10


def test_tensors_survive_the_table(spark):
    """The stored column and the tensors, written and read again, are those of the payload."""
    texts = ["", "some text " * 40, "ünï" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in materialize(media.read_media(materialize(media.store_texts(docs), "media")), "tensors").collect():
        payload, size = media.payload_of(texts[r.doc_id])
        want = media.decode(media.encode([payload], [size])).rgb()
        assert (np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) == want).all()
