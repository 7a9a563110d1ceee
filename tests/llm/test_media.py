import hashlib
import math
import random
import zlib

import numpy as np

from rollcall.llm import media


def test_round_trip_of_any_payload():
    rnd = random.Random(3)
    for k in (1, 2, 3, 5, 24):
        p = bytes(rnd.randrange(256) for _ in range(192 * k))
        m = media.encode(p)
        assert media.Picture(m).payload() == p
        # the same scans read bit by bit
        slow, quick = media.Picture(m, fast=False), media.Picture(m)
        assert (slow.coef == quick.coef).all()
        assert (slow.tensor() == quick.tensor()).all()


def test_several_rows_of_units(monkeypatch):
    monkeypatch.setattr(media, "WIDEST", 3)
    p = bytes(range(192)) * 21
    got = media.Picture(media.encode(p))
    assert (got.wide, got.high) == (3, 4) and got.payload() == p
    assert got.tensor().shape == (64, 48, 3)


def test_samples_are_the_inverse_transform():
    got = media.Picture(media.encode(bytes(192)))
    got.coef[:] = 0
    got.coef[:4, 0] = 80  # Y: 80 / 8 over the middle
    got.coef[4, 1] = 60  # Cb: first horizontal frequency
    c = 60 / 4 * np.cos((2 * np.arange(8) + 1) * np.pi / 16) / np.sqrt(2)
    blue = np.clip(np.rint(138 + 1.772 * c.repeat(2)), 0, 255)
    rgb = got.tensor()
    assert (abs(rgb[..., 2] - blue[None, :]) <= 1).all() and (rgb[..., 0] == 138).all()


def test_spectral_run_and_late_coefficients():
    """Runs, end-of-band runs and coefficients that appear in a refinement, written out by hand."""
    frame = b"\xff\xd8" + media._segment(0xDB, bytes([0] + [1] * 64)) + media._segment(0xC2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0]))
    ac = media._table(0x10, [0, 3], [0x21, 0x10, 0x00])  # codes 00, 01, 10
    first = "00" "1" "01" "0"  # block 0: two zeros, then +1; then no more for two to three blocks: bit 0 says two
    first += "10"  # block 2: nothing
    more = media._table(0x10, [0, 2], [0x01, 0x00])  # codes 00, 01
    # block 0: new -1 at k=1; then the old coefficient at k=3 is corrected while the band ends; blocks 1 and 2: nothing
    second = "00" "0" "01" "1" "01" "01"
    pack = lambda s: np.packbits([int(x) for x in s.ljust(-(-len(s) // 8) * 8, "1")]).tobytes()
    raw = frame + ac + media._scan([1], 1, 63, 0, 1, pack(first)) + more + media._scan([1], 1, 63, 1, 0, pack(second)) + b"\xff\xd9"
    c = media.Picture(raw).coef
    assert c[0, 3] == 3 and c[0, 1] == -1 and np.count_nonzero(c) == 2


class Plain:
    """A second reader, from the standard's text: a bit at a time, a block at a time, cosines summed out."""

    def __init__(self, raw):
        assert raw[:2] == b"\xff\xd8" and raw[-2:] == b"\xff\xd9"
        self.huff, at = {}, 2
        while raw[at + 1] != 0xD9:
            kind, n = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            seg = raw[at + 4 : at + 2 + n]
            at += 2 + n
            if kind == 0xDB:
                assert list(seg) == [0] + [1] * 64
            elif kind == 0xC2:
                self.h, self.w = int.from_bytes(seg[1:3], "big"), int.from_bytes(seg[3:5], "big")
                assert [tuple(seg[6 + 3 * i : 9 + 3 * i]) for i in range(3)] == [(1, 0x22, 0), (2, 0x11, 0), (3, 0x11, 0)]
                self.mw, self.mh = self.w // 16, self.h // 16
                size = {1: (2 * self.mw, 2 * self.mh), 2: (self.mw, self.mh), 3: (self.mw, self.mh)}
                self.blocks = {c: [[[0] * 64 for _ in range(x)] for _ in range(y)] for c, (x, y) in size.items()}
            elif kind == 0xC4:
                code, k, table = 0, 17, {}
                for length in range(1, 17):
                    for _ in range(seg[length]):
                        table[format(code, f"0{length}b")] = seg[k]
                        code, k = code + 1, k + 1
                    code *= 2
                self.huff[seg[0]] = table
            elif kind == 0xDA:
                end = at
                while raw[end] != 0xFF or raw[end + 1] == 0:
                    end += 1
                self.scan(seg, "".join(format(b, "08b") for b in raw[at:end].replace(b"\xff\x00", b"\xff")))
                at = end

    def take(self, n):
        self.pos += n
        return int(self.bits[self.pos - n : self.pos] or "0", 2)

    def symbol(self, table):
        code = ""
        while code not in table:
            code += self.bits[self.pos]
            self.pos += 1
        return table[code]

    def extended(self, n):
        v = self.take(n)
        return v if n == 0 or v >= 2 ** (n - 1) else v - 2**n + 1

    def scan(self, seg, bits):
        self.bits, self.pos, n = bits, 0, seg[0]
        comps = [seg[1 + 2 * i] for i in range(n)]
        first, last, high, low = seg[1 + 2 * n], seg[2 + 2 * n], seg[3 + 2 * n] >> 4, seg[3 + 2 * n] & 15
        if n > 1:
            order = [(c, b) for y in range(self.mh) for x in range(self.mw) for c in comps for b in ([self.blocks[1][2 * y + i][2 * x + j] for i in (0, 1) for j in (0, 1)] if c == 1 else [self.blocks[c][y][x]])]
        else:
            order = [(comps[0], b) for line in self.blocks[comps[0]] for b in line]
        seen, eob = dict.fromkeys(comps, 0), 0
        for c, b in order:
            if first == 0:
                if high:
                    b[0] += self.take(1) << low
                else:
                    seen[c] += self.extended(self.symbol(self.huff[0]))
                    b[0] = seen[c] << low
                continue
            k, table = first, self.huff[0x10]
            if not eob:
                while k <= last:
                    run, size = divmod(self.symbol(table), 16)
                    if size == 0 and run < 15:
                        eob = (1 << run) + self.take(run)
                        break
                    if not high:
                        k += run
                        b[k] = self.extended(size) << low if size else 0
                        k += 1
                        continue
                    new = (1 if self.take(1) else -1) << low if size else 0
                    while k <= last and (b[k] or run):
                        if b[k]:
                            b[k] += (self.take(1) << low) * (1 if b[k] > 0 else -1)
                        else:
                            run -= 1
                        k += 1
                    if k <= last:
                        b[k] = new
                    k += 1
            if eob:
                for j in range(k, last + 1):
                    if high and b[j]:
                        b[j] += (self.take(1) << low) * (1 if b[j] > 0 else -1)
                eob -= 1

    def pixels(self):
        zig = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda t: (sum(t), t[0] if sum(t) % 2 else t[1]))
        cos = [[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2 for u in range(8)] for x in range(8)]

        def samples(b):
            f = {uv: b[i] for i, uv in enumerate(zig)}
            half = [[sum(f[u, v] * cos[x][v] for v in range(8)) for x in range(8)] for u in range(8)]
            return [[min(255, max(0, 128 + sum(half[u][x] * cos[y][u] for u in range(8)))) for x in range(8)] for y in range(8)]

        planes = {c: [[samples(b) for b in line] for line in lines] for c, lines in self.blocks.items()}
        get = lambda c, y, x: planes[c][y // 8][x // 8][y % 8][x % 8]
        for y in range(self.h):
            for x in range(self.w):
                a, cb, cr = get(1, y, x), get(2, y // 2, x // 2) - 128, get(3, y // 2, x // 2) - 128
                yield [round(min(255, max(0, t))) for t in (a + 1.402 * cr, a - 0.344136 * cb - 0.714136 * cr, a + 1.772 * cb)]


def test_query_against_a_second_reader(spark, tmp_path):
    rnd = random.Random(5)
    texts = ["", "a b c", "".join(rnd.choices("abc \u00e9\u6f22 .", k=700)), "".join(map(chr, rnd.choices(range(32, 127), k=1500)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op5_media(spark, str(tmp_path)).collect()}
    for r in media.stored(docs).collect():
        raw, seen, rgb = bytes(r.media), Plain(bytes(r.media)), []
        coefficients = [b for c in (1, 2, 3) for line in seen.blocks[c] for b in line]
        payload = texts[r.doc_id].encode()
        payload += b" " * (got[r.doc_id].payload_bytes - len(payload))
        assert bytes(v - 256 for b in coefficients for v in b)[: len(payload)] == payload
        rgb = list(seen.pixels())
        bins = [sum(p[1] // 32 == k for p in rgb) for k in range(8)]
        mean = [sum(p[k] for p in rgb) // len(rgb) for k in range(3)]
        want = f"{seen.h}x{seen.w} {','.join(map(str, mean))} {','.join(map(str, bins))}"
        assert (got[r.doc_id].media_bytes, got[r.doc_id].media_sha256, got[r.doc_id].feature) == (len(raw), hashlib.sha256(raw).hexdigest(), want)


def test_query(spark):
    texts = [None, "", "a", "é" * 500, "same", "same", "x" * 192, "long " * 400_000]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.digests(media.stored(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[4].feature == got[5].feature and got[4].media_sha256 == got[5].media_sha256
    t = media.tensors(media.stored(docs.where("doc_id < 5"))).collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in t)
    assert media.digests(media.stored(docs.limit(0))).count() == 0
