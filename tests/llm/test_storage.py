"""Media columns, WARC and token files: exact round trips, a plain decoder, and lost tasks."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import odd
from plumbline.llm import progressive_jpeg as J
from plumbline.llm import token_output as T
from plumbline.llm import warc
from plumbline.llm.common import shared_folder, table

WORDS = public_tokenizers.path("word_bpe_49k.json")


# progressive JPEG


def random_blocks(rng, zeros, across=3, down=2, sampling=J.SAMPLING):
    def part(rows, cols):
        a = rng.integers(-128, 128, (rows, cols, 64))
        a[rng.random(a.shape) < zeros] = 0
        return a.astype(np.int16)

    return [part(down * sampling[1], across * sampling[0]), part(down, across), part(down, across)]


class PlainReader:
    """A decoder for one file, one bit at a time."""

    def __init__(self, data):
        self.data, self.at, self.tables, self.restart, self.out = data, 2, {}, 0, None
        while data[self.at + 1] != J.EOI:
            kind, size = data[self.at + 1], struct.unpack_from(">H", data, self.at + 2)[0]
            body = data[self.at + 4 : self.at + 2 + size]
            self.at += 2 + size
            if kind == J.DHT:
                self.tables[body[0]] = {(bits, code): s for s, (code, bits) in J.canonical(list(body[1:17]), list(body[17:])).items()}
            elif kind == J.DRI:
                self.restart = struct.unpack(">H", body)[0]
            elif kind == J.SOF2:
                _, h, w, _ = struct.unpack_from(">BHHB", body)
                self.factors = [(body[6 + 3 * i + 1] >> 4, body[6 + 3 * i + 1] & 15) for i in range(3)]
                hm, vm = self.factors[0]
                self.mcus = (-(-h // (8 * vm)), -(-w // (8 * hm)))
                self.out = [np.zeros((self.mcus[0] * v, self.mcus[1] * f, 64), int) for f, v in self.factors]
            elif kind == J.SOS:
                self.scan(body)

    def bit(self):
        if not self.left:
            self.byte, self.left = self.data[self.at], 8
            self.at += 2 if self.byte == 0xFF else 1
        self.left -= 1
        return self.byte >> self.left & 1

    def bits(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table_):
        code = n = 0
        while True:
            code, n = code << 1 | self.bit(), n + 1
            if (n, code) in table_:
                return table_[n, code]

    def value(self, size):
        v = self.bits(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def scan(self, body):
        n = body[0]
        comps, (first, last, approx) = [body[1 + 2 * i] - 1 for i in range(n)], body[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        self.left, done, previous, skip = 0, 0, [0] * 3, 0
        if n > 1:
            units = [[(c, r * self.factors[c][1] + y, k * self.factors[c][0] + x) for c in comps for y in range(self.factors[c][1]) for x in range(self.factors[c][0])] for r in range(self.mcus[0]) for k in range(self.mcus[1])]
        else:
            rows, cols = self.out[comps[0]].shape[:2]
            units = [[(comps[0], r, k)] for r in range(rows) for k in range(cols)]
        for unit in units:
            if self.restart and done and done % self.restart == 0:
                self.left = 0
                assert self.data[self.at] == 0xFF and 0xD0 <= self.data[self.at + 1] <= 0xD7
                self.at += 2
                previous, skip = [0] * 3, 0
            done += 1
            for c, r, k in unit:
                block = self.out[c][r, k]
                if first == 0:
                    if high:
                        block[0] |= self.bit() << low
                    else:
                        previous[c] += self.value(self.symbol(self.tables[0]))
                        block[0] = previous[c] << low
                elif not high:
                    skip = self.ac(block, first, last, low, skip)
                else:
                    skip = self.refine(block, first, last, low, skip)

    def ac(self, block, k, last, low, skip):
        if skip:
            return skip - 1
        while k <= last:
            s = self.symbol(self.tables[0x10])
            run, size = s >> 4, s & 15
            if size:
                k += run
                block[k] = self.value(size) << low
            elif run < 15:
                return (1 << run) + self.bits(run) - 1
            else:
                k += 15
            k += 1
        return 0

    def refine(self, block, k, last, low, skip):
        one = 1 << low

        def correct(i):
            if self.bit() and not abs(block[i]) & one:
                block[i] += one if block[i] > 0 else -one

        while k <= last and not skip:
            s = self.symbol(self.tables[0x10])
            run, size, new = s >> 4, s & 15, 0
            if size:
                new = one if self.bit() else -one
            elif run < 15:
                skip = (1 << run) + self.bits(run)
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif run:
                    run -= 1
                else:
                    block[k] = new
                    k += 1
                    break
                k += 1
        if skip:
            for i in range(k, last + 1):
                if block[i]:
                    correct(i)
            return skip - 1
        return 0


@pytest.mark.parametrize("zeros", [0, 0.3, 0.8, 0.97, 1])
def test_scans_by_a_plain_decoder(zeros):
    rng = np.random.default_rng(int(zeros * 100))
    coefs = [random_blocks(rng, zeros), random_blocks(rng, zeros, 1, 4)]
    files = J.encode(coefs, [b"one", b"two"])
    for want, data, (parsed, got) in zip(coefs, files, J.decode(files)):
        plain = PlainReader(data).out
        for w, p, g in zip(want, plain, got):
            assert (w == p).all() and (w == g).all()
        assert parsed.comment in (b"one", b"two")


def test_file_without_restart_markers():
    """The same entropy-coded data as one interval a scan, with an end-of-band run over several blocks."""
    spec = bytes([0, 2, 2] + [0] * 13 + [0x00, 0x01, 0x10, 0x11])
    codes = J.canonical(list(spec[:16]), list(spec[16:]))
    bits = []

    def put(symbol, extra="", table_=codes):
        code, n = table_[symbol]
        bits.append(format(code, f"0{n}b") + extra)

    blocks = 5
    for dc in (1, 0, -1, 1, 1):  # differences
        put(0x01 if dc else 0x00, {1: "1", -1: "0", 0: ""}[dc])
    dc_data = bits
    bits = []
    put(0x11, "1")  # block 0: coefficient 2 is 1
    put(0x10, "1")  # and no more, in this block and two others
    put(0x01, "0")  # block 3: coefficient 1 is -1
    put(0x00)
    put(0x00)
    pack = lambda b: int(("".join(b) + "1" * (-len("".join(b)) % 8)), 2).to_bytes(-(-len("".join(b)) // 8), "big").replace(b"\xff", b"\xff\0")
    frame = struct.pack(">BHHB", 8, 8, 8 * blocks, 1) + bytes([1, 0x11, 0])
    data = b"\xff\xd8" + J.segment(J.DQT, bytes([0]) + bytes([1] * 64)) + J.segment(J.DHT, b"\0" + spec) + J.segment(J.DHT, b"\x10" + spec) + J.segment(J.SOF2, frame)
    data += J.segment(J.SOS, bytes([1, 1, 0, 0, 0, 0])) + pack(dc_data) + J.segment(J.SOS, bytes([1, 1, 0, 1, 63, 0])) + pack(bits) + b"\xff\xd9"
    (parsed, (got,)),  = J.decode([data])
    want = np.zeros((1, blocks, 64), int)
    want[0, :, 0] = np.cumsum([1, 0, -1, 1, 1])
    want[0, 0, 2], want[0, 3, 1] = 1, -1
    assert (got == want).all() and J.to_rgb(parsed, [got]).shape == (8, 8 * blocks, 3)


def test_inverse_transform_and_colours():
    rng = np.random.default_rng(8)
    coefs = random_blocks(rng, 0.6, 2, 2)
    (parsed, got), = J.decode(J.encode([coefs], [b""]))
    planes = []
    for c, part in enumerate(got):
        rows, cols = part.shape[:2]
        plane = np.zeros((8 * rows, 8 * cols))
        for r in range(rows):
            for k in range(cols):
                square = np.zeros(64)
                square[J.ZIGZAG] = part[r, k]
                plane[8 * r : 8 * r + 8, 8 * k : 8 * k + 8] = J._C @ square.reshape(8, 8) @ J._C.T
        planes.append(np.clip(np.rint(plane + 128), 0, 255))
        assert np.abs(J.samples(part, parsed.quant[c]) - planes[-1]).max() <= 1
    rgb = J.to_rgb(parsed, got).astype(int)
    y = J.samples(got[0], parsed.quant[0])
    cb, cr = (np.kron(J.samples(got[c], parsed.quant[c]), np.ones((2, 2))) - 128 for c in (1, 2))
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    assert np.abs(rgb - np.clip(want, 0, 255)).max() <= 1.01


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (2, 2)])
def test_bytes_survive(sampling):
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (192, 384, 1920, 19200)] + [b" " * 192, bytes([128]) * 384]
    files = J.store_bytes(payloads, sampling)
    assert [J.load_bytes(*d) for d in J.decode(files)] == payloads
    assert [J.store_bytes([p], sampling)[0] for p in payloads] == files  # a file does not depend on its batch


def test_wide_layout(monkeypatch):
    monkeypatch.setattr(J, "ROWS", 3)
    payload = bytes(range(256)) * 12
    assert J.load_bytes(*J.decode(J.store_bytes([payload]))[0]) == payload and J.layout_of(48)[0] > 1


def check_media(r, text):
    raw = (text or "").encode()
    payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
    assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])


def test_media_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    rows = entry_point.queries()["op3_media"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check_media(r, texts[r["doc_id"]])


def test_media_of_odd_rows(spark):
    docs = odd.documents(spark)
    got = J.read_media(J.media_column(docs), tensors=True).collect()
    assert Counter((r["doc_id"], bytes(r["payload"])[: r["n_bytes"]].decode()) for r in got) == Counter((r[0], r[1] or "") for r in odd.ROWS)
    same = {}
    for r in got:
        assert len(r["rgb"]) == 3 * r["height"] * r["width"]
        assert same.setdefault(bytes(r["payload"]), (bytes(r["media"]), r["feature"])) == (bytes(r["media"]), r["feature"])
    assert J.read_media(J.media_column(docs.limit(0))).count() == 0


# WARC


def test_warc_of_odd_rows(spark):
    folder = shared_folder(spark, "test-warc")
    pages = odd.pages(spark)
    manifest = warc.write_warc(pages, folder, roll=2_000, shard_bytes=5_000)
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == pages.count()
    got = warc.read_warc(spark, folder).collect()
    html = Counter((r["page_id"], len((r["html"] or "").encode())) for r in pages.collect())
    assert Counter((r["page_id"], r["payload_bytes"]) for r in got) == html
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[2] == ("response", None) and kinds[3] == ("revisit", 2) and kinds[None] == ("revisit", 2)
    assert kinds[4] == ("response", None) and kinds[5] == ("revisit", 4) and kinds[9] == ("revisit", 4) and kinds[6] == ("response", None)
    again = shared_folder(spark, "test-warc")
    assert warc.write_warc(pages.repartition(5), again, roll=2_000, shard_bytes=5_000).orderBy("name").collect() == manifest.orderBy("name").collect()  # bytes and all
    none = shared_folder(spark, "test-warc")
    warc.write_warc(pages.limit(0), none)
    assert warc.read_warc(spark, none).count() == 0


def test_leftovers_of_lost_tasks_are_not_read(spark):
    from plumbline.llm.common import commit_files, filesystem

    folder = shared_folder(spark, "test-warc")
    manifest = warc.write_warc(odd.pages(spark), folder)
    store, root = filesystem(folder)
    with store.open_output_stream(f"{root}/_temp-of-a-lost-task") as f:
        f.write(b"half a record")
    names = manifest.select("name").collect()
    commit_files(spark.createDataFrame([("_temp-gone", n["name"]) for n in names], "temp string, name string"), folder)  # twice is harmless
    assert warc.read_warc(spark, folder).count() == odd.pages(spark).count()


def test_shards_are_ranges(spark):
    rows = spark.range(0, 5000).selectExpr("id", "id % 7 as w")
    bounds = warc.range_shards(rows, "id", warc.F.lit(10).cast("long"), 5_000)
    got = warc.sharded(rows, "id", bounds).select("id", "shard").collect()
    edges = {}
    for r in got:
        edges.setdefault(r["shard"], []).append(r["id"])
    assert len(edges) == len(bounds) + 1 and all(max(edges[k]) < min(edges[k + 1]) and len(edges[k]) <= 500 for k in range(len(bounds)))


# token files


def greedy_words(ids):
    """The fullest selector at each step, one id at a time."""
    out, i = [], 0
    while i < len(ids):
        room = min(T.BLOCK - i % T.BLOCK, len(ids) - i)
        s = next(s for s in range(16) if T.COUNTS[s] <= room and all(int(x) >> int(T.WIDTHS[s]) == 0 for x in ids[i : i + T.COUNTS[s]]))
        out.append(s << 60 | sum(int(ids[i + k]) << (k * int(T.WIDTHS[s])) for k in range(T.COUNTS[s] if s > 1 else 0)))
        i += int(T.COUNTS[s])
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 239, 1023, 1024, 1025, 3000])
def test_simple8b(n):
    rng = np.random.default_rng(n)
    for high in (1, 2, 300, 50_000, 1 << 31, (1 << 60) - 1):
        ids = (rng.integers(0, high, n) * (rng.random(n) < 0.8)).astype(np.uint64)
        words, offsets = T.encode_ids(ids)
        assert words.tolist() == greedy_words(ids) and (T.decode_ids(words) == ids).all()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert (T.decode_range(offsets, words, a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        T.encode_ids(np.array([1 << 60], np.uint64))


def test_words_equal_the_library():
    r = random.Random(5)
    tok = Tokenizer.from_file(WORDS)
    tok.encode_special_tokens = True
    letters = list(" \n\tABCabcΣσςİıéÉ̇'.,s!<|endoftext|>漢ß0  \x1c")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(800)] + [x[1] or "" for x in odd.ROWS] + ["<|endoftext|> don't, we'll."]
    for text, got in zip(texts, T.WordEncoder(WORDS)(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_equal_the_unmodified_library(spark):
    tok = Tokenizer.from_file(WORDS)
    assert T.TextEncoder(WORDS)(["hello <|endoftext|> you"]) == [np.array([3306, 49407, 592], "<u4").tobytes()]
    r = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "Hello", "don't", "é", "İ", "Σ", " ", "\n", ".", ","]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(600)]
    for text, got in zip(texts, T.TextEncoder(WORDS)(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
    folder = shared_folder(spark, "test-tokens")
    T.write_tokens(spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string"), folder, WORDS)
    start = 0
    for row in sorted(T.read_tokens(spark, folder).collect(), key=lambda x: x["doc_id"]):
        ids = tok.encode(texts[row["doc_id"]], add_special_tokens=False).ids + [1]
        assert row["start"] == start and np.frombuffer(row["ids"], "<u4").tolist() == ids
        start += len(ids)


def test_token_query(spark, small):
    tok = Tokenizer.from_file(WORDS)
    rows = {r["doc_id"]: r for r in entry_point.queries()["op9_token_output"](spark, small).collect()}
    start = 0
    for r in table(spark, small, "documents").orderBy("doc_id").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        got = rows.pop(r["doc_id"])
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows


def test_token_files_of_odd_rows(spark):
    folder = shared_folder(spark, "test-tokens")
    T.write_tokens(odd.documents(spark), folder, WORDS, shard_bytes=20_000)
    got = sorted(T.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in odd.ROWS), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r["start"] == at and r["ids"][-4:] == bytearray(struct.pack("<I", 1))
        at += len(r["ids"]) // 4
    none = shared_folder(spark, "test-tokens")
    T.write_tokens(odd.documents(spark).limit(0), none, WORDS)
    assert T.read_tokens(spark, none).count() == 0


def test_words_with_marks_are_learned_once():
    encode = T.WordEncoder(WORDS)
    seen, learn = [], encode._learn
    encode._learn = lambda words: (seen.extend(words), learn(words))
    texts = ["quetre, quetre&&& quetre.!!", "", "quetre\nquetre&&& don't!! 5%%", "İ&& ΣΑΣ.. é!!"]
    got = encode(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in encode.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert sum(w.startswith("quetre") for w in seen) == 1
