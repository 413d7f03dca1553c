import os
import random
import struct
import zlib

import numpy as np
import pytest

from sparkloom.llm import media as M


@pytest.mark.parametrize("units", [1, 2, 5, 4096])
def test_payload_comes_back(units):
    p = os.urandom(M.UNIT * units)
    image = M.Image(M.write(p))
    assert image.payload() == p and image.rgb().shape == (image.height, image.width, 3)


def test_documents_come_back(spark, documents, texts):
    for r in M.report(M.read(M.store(documents), tensors=False)).collect():
        p = M.padded(texts[r["doc_id"]])
        assert r["payload_bytes"] == len(p) and r["tail_crc32"] == zlib.crc32(p[-32:]) and r["n_bytes"] == len(texts[r["doc_id"]].encode())


class Writer:
    """A plain progressive writer for any coefficients: runs of zeros, end-of-band runs, refining passes."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> k) & 1 for k in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(s, 9)  # 256 codes of 9 bits, which leaves the code of ones free

    def number(self, v, n):
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def segment(self, components, band, high, low):
        return M._scan(components, 0, band, high, low, np.array(self.bits, np.uint8))


def progressive(coef, height, width, sampling, interval=0):
    """coef: {component: (blocks, 64) in scan order}."""
    table = bytes([0] * 8 + [255, 0, 0, 0, 0, 0, 0, 0])
    symbols = bytes(range(255))
    out = [b"\xff\xd8", M._segment(0xDB, bytes([0, *[2] * 64]))]
    out.append(M._segment(0xC2, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([c, h << 4 | v, 0]) for c, (h, v) in sampling.items())))
    out.append(M._segment(0xC4, b"\x00" + table + symbols + b"\x10" + table + symbols))
    shape = M.Image(b"".join([*out, b"\xff\xd9"]))
    shift = lambda x, n: np.where(x >= 0, np.abs(x) >> n, -(np.abs(x) >> n))
    w, last = Writer(), dict.fromkeys(sampling, 0)
    orders = {c: shape._order(c, len(sampling) == 1) for c in sampling}
    for u in range(len(next(iter(orders.values())))):
        for c in sampling:
            for b in orders[c][u]:
                v = int(coef[c][b, 0]) >> 1
                d, last[c] = v - last[c], v
                n = abs(d).bit_length()
                w.symbol(n)
                w.number(d, n)
    out.append(w.segment([*sampling], (0, 0), 0, 1))
    w = Writer()
    for u in range(len(next(iter(orders.values())))):
        for c in sampling:
            for b in orders[c][u]:
                w.put(int(coef[c][b, 0]) & 1, 1)
    out.append(w.segment([*sampling], (0, 0), 1, 0))
    for c in sampling:
        order = shape._order(c, True).reshape(-1)
        w, run = Writer(), 0

        def flush(w, run):
            while run:
                n = min(run.bit_length() - 1, 14)
                w.symbol(n << 4)
                w.put(run - (1 << n), n)
                run = 0

        for b in order:
            v, zeros = shift(coef[c][b], 1), 0
            for k in range(1, 64):
                if not v[k]:
                    zeros += 1
                    continue
                flush(w, run)
                run = 0
                while zeros > 15:
                    w.symbol(0xF0)
                    zeros -= 16
                n = int(abs(v[k])).bit_length()
                w.symbol(zeros << 4 | n)
                w.number(int(v[k]), n)
                zeros = 0
            run += zeros > 0
        flush(w, run)
        out.append(w.segment([c], (1, 63), 0, 1))
        w = Writer()
        for b in order:
            x = coef[c][b]
            old = shift(x, 1) != 0
            new = (np.abs(x) == 1) & ~old
            end = max(np.flatnonzero(new), default=0)
            k, zeros, held = 1, 0, []
            while k <= end:
                if old[k]:
                    held.append(int(abs(x[k])) & 1)
                elif new[k]:
                    w.symbol(zeros << 4 | 1)
                    w.put(int(x[k] > 0), 1)
                    for bit in held:
                        w.put(bit, 1)
                    zeros, held = 0, []
                else:
                    zeros += 1
                    if zeros == 16:
                        w.symbol(0xF0)
                        for bit in held:
                            w.put(bit, 1)
                        zeros, held = 0, []
                k += 1
            if end < 63:
                w.symbol(0)
                for q in range(end + 1, 64):
                    if old[q]:
                        held.append(int(abs(x[q])) & 1)
                for bit in held:
                    w.put(bit, 1)
        out.append(w.segment([c], (1, 63), 1, 0))
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("sampling,size", [({1: (1, 1)}, (16, 24)), ({1: (2, 2), 2: (1, 1), 3: (1, 1)}, (30, 40)), ({1: (1, 1), 2: (1, 1), 3: (1, 1)}, (8, 8))])
def test_general_files(sampling, size):
    rnd = random.Random(1)
    most = [max(s[k] for s in sampling.values()) for k in (0, 1)]
    mcus = (-(-size[1] // (8 * most[0])), -(-size[0] // (8 * most[1])))
    coef = {}
    for c, (h, v) in sampling.items():
        x = np.zeros((mcus[0] * h * mcus[1] * v, 64), int)
        for b in range(len(x)):
            x[b, 0] = rnd.randint(-200, 200)
            for _ in range(rnd.choice([0, 0, 3, 30])):
                x[b, rnd.randint(1, 63)] = rnd.choice([-1, 1, 2, -3, 5, 40])
        coef[c] = x
    image = M.Image(progressive(coef, *size, sampling))
    for c in sampling:
        whole = image._order(c, True).reshape(-1)
        assert (image.coef[c][:, 0] == coef[c][:, 0]).all() and (image.coef[c][whole, 1:] == coef[c][whole, 1:]).all()
    rgb = image.rgb()
    assert rgb.shape == (*size, 3)
    if len(sampling) == 1:  # against the transform by its definition
        f = np.zeros((8, 8))
        f.reshape(-1)[M.ZIGZAG] = coef[1][0] * 2
        a = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
        assert np.abs(np.clip(a.T @ f @ a + 128, 0, 255) - rgb[:8, :8, 0]).max() <= 0.51


def test_edge_cases(spark, edge):
    got = M.report(M.read(M.store(edge))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == edge.count() and by[1]["payload_bytes"] == M.UNIT and by[1]["media_sha256"] == by[2]["media_sha256"] and by[5]["feature"] == by[6]["feature"]
    assert M.store(edge.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.Image(b"GIF89a")
