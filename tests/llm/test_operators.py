"""Edge cases by brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import chat, exact_dedup, language, media, mixing, quality, sentencepiece_bpe, similarity, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RND = random.Random(3)


def words(n, pool="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()):
    return " ".join(RND.choice(pool) + str(RND.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words(60)
    out = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two", "en", "b", 7), (5, "ONE  two", "en", None, 8)]
    out += [(6, base, "en", "a", 1), (7, base.replace(" ", "\t\t"), "en", "b", 1), (8, base.replace(base.split()[30], "changed"), "en", "c", 1), (9, base.upper(), "de", "c", 1)]
    out += [(10, words(9000), "en", "a", 1), (6, base, "en", "a", 1), (None, base, "fr", "b", 1), (12, "x" * 50_000, "fr", "b", 1), (13, "naïve ▁ \x00 😀 日本", "fr", "d", 1)]
    return out + [(100 + i, words(RND.randrange(1, 80)), "en", RND.choice("abcd"), 1) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("size", F.lit(-1))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_dedup(spark, docs, rows):
    for bits in (64, 3):  # few bits: contents share hashes and must be told apart
        got = exact_dedup.deduplicate(docs, bits).collect()
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups = defaultdict(list)
        for i, t, *_ in rows:
            groups[norm(t)].append(i)
        want = Counter((i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.deduplicate(empty(spark)).count() == 0


def test_similarity(spark, docs, rows):
    def shingle_set(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    want = Counter((r[0], len(sets[i]), None if r[0] is None else min(least[find(i)])) for i, r in enumerate(rows))
    for sizes in ((512, 4096), (2, 3)):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in similarity.join_similar(docs, *sizes).collect())
        assert got == want
    assert similarity.join_similar(empty(spark)).count() == 0


def test_similarity_fetches_each_class_once(spark):
    """The filter holds all its ids and few others, at whatever size; a text that repeats, or shares an id
    with another, comes once."""
    ids = np.arange(0, 3_000_000, 15)
    seen = similarity._holding(spark.range(0, 3_000_000, 15).toDF("least"), len(ids))
    assert similarity.filter_bits(len(ids)) == 22 and len(seen) == 1 << 19
    assert similarity._held(ids, seen).all() and similarity._held(np.arange(1, 3_000_000, 15), seen).mean() < 0.02
    assert similarity.filter_bits(0) == 21 and similarity.filter_bits(10**12) == 27
    assert not similarity._held(ids, similarity._holding(spark.createDataFrame([], "least bigint"), 0)).any()
    a, b = words(40), words(40)
    near = f"{a} more"
    docs = spark.createDataFrame([(1, a)] * 50 + [(1, b)] * 3 + [(2, near)] * 2 + [(3, None), (None, a)], "doc_id bigint, text string")
    digests = [similarity.digest(similarity.shingles(t)) for t in (a, near)]
    hashes = {r.doc_id: r.h for r in docs.where(F.col("text") != b).select("doc_id", F.xxhash64("text").alias("h")).collect()}
    reps = spark.createDataFrame([(7, 1, hashes[1], digests[0], 9, 1.0), (8, 2, hashes[2], digests[1], 9, 1.0)], "rep bigint, least bigint, least_hash bigint, digest binary, component bigint, bulk double")
    got = {r.rep: bytes(r.shingles) for r in similarity._sets(docs, reps).collect()}
    assert similarity._sets(docs, reps).count() == 2 and got == {7: similarity.shingles(a).tobytes(), 8: similarity.shingles(near).tobytes()}


def test_similarity_of_repeated_ids(spark):
    import corpus_pipeline

    a, b, c = (words(100) for _ in range(3))
    near = lambda t, k: " ".join([*t.split()[:-k], "other"])
    rows = [(1, a), (1, b), (2, near(a, 1)), (3, near(b, 1)), (7, c), (7, near(a, 2)), (9, near(c, 1)), (1, near(b, 2))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for group in (2, 512):
        for order in (docs, docs.repartition(5), docs.orderBy(F.desc("text"))):
            got = Counter((r.doc_id, r.component_id) for r in similarity.join_similar(order, group).collect())
            assert got == Counter([(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (7, 1), (7, 7), (9, 7)])
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert len(left) == 3 and {(1, a), (7, c)} < set(left) and set(left) & {(1, b), (1, near(b, 2))}


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        for s in over or list(open_):
            target[s] = 3.0 * sizes[s] if over else share * weight[s]
            open_.discard(s)
            left -= target[s]
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(WORD.findall(next(t for i, t, *_ in rows if i == r.doc_id) or ""))
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert math.isclose(r.target, target[r.source], abs_tol=1e-6) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mixing_targets_of_equal_sources(spark):
    for sizes, cycle in (([100] * 6, (1, 2, 3)), ([50] * 20, (1, 2, 3)), ([10, 20], (1, 2, 3)), ([10, 20, 30], (1, 2, 3)), ([0, 0, 5, 5], (1,)), ([7] * 9, (2, 2, 0.5))):
        want, left, open_ = {}, float(sum(sizes)), set(range(len(sizes)))
        while open_:
            share = left / sum(cycle[i % len(cycle)] for i in open_)
            over = [i for i in open_ if share * cycle[i % len(cycle)] > 3 * sizes[i]]
            for i in over or list(open_):
                want[i] = 3.0 * sizes[i] if over else share * cycle[i % len(cycle)]
                open_.discard(i)
                left -= want[i]
        sources = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size bigint")
        got = {int(r.source[1:]): r.target for r in mixing.targets(sources, tuple(map(float, cycle))).collect()}
        assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want) and math.isclose(sum(got.values()), sum(sizes))


def test_mixed_documents_of_null_and_repeated_ids(spark):
    few = [(1, "x y", "a"), (None, "p q", "a"), (2, "", "a"), (None, None, "a"), (3, " \t", "a")]
    many = [(1, " ".join(f"same{j}" for j in range(10)), "b")] + [(None if i % 2 else i, " ".join(f"w{i}" for _ in range(10)), "b") for i in range(10, 49)]
    docs = spark.createDataFrame([(*r, -1, -2) for r in few + many], "doc_id bigint, text string, source string, size int, times int")
    weights = spark.createDataFrame([(1, 2.0), (10, 0.5)], "doc_id bigint, weight double")
    for by in (None, weights):
        got = Counter(map(tuple, mixing.mixed_documents(docs, by).collect()))
        assert {r[:3]: n for r, n in got.items() if r[2] == "a"} == dict.fromkeys(few, 3)
        copies = [n for r, n in got.items() if r[2] == "b"]
        assert max(copies) == 1 and sum(copies) == 39  # of 404 words 12 go to a, so 392 to b
        assert got == Counter(map(tuple, mixing.mixed_documents(docs.repartition(5), by).collect()))
        taken = Counter()
        for r in mixing.mix(docs, by).collect():
            taken[r.source] += r.taken
        assert taken == {"a": 12, "b": 390}


def test_sentencepiece(spark, docs, rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = sentencepiece_bpe.encode_column(docs, path)
    got = found.select("doc_id", "text", *sentencepiece_bpe.digests(found)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    coder = sentencepiece_bpe.codec(open(path, "rb").read())
    for _ in range(2000):
        text = "".join(RND.choice("abcdeth  \n.,▁éßñ0123日<>s/😀") for _ in range(RND.randrange(50)))
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert coder.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids) and coder.decode(coder.encode(text)) == sp.decode(ids)
    assert sentencepiece_bpe.encode_column(empty(spark), path).count() == 0


def test_media(spark, docs, rows):
    import gzip
    import struct
    import zlib

    got = media.sniff(media.store_texts(docs)).collect()
    for r, (_, t, *_rest) in zip(sorted(got, key=lambda r: (r.n_bytes, r.doc_id or -1)), sorted(rows, key=lambda r: (len((r[1] or "").encode()), r[0] or -1)), strict=True):
        raw = (t or "").encode()
        n = max(64, -(-len(raw) // 64) * 64)
        assert r.n_bytes == len(raw) and bytes(r.payload) == raw.ljust(n, b"\0") and r.media_type == "audio/wav"
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")
    packed = gzip.compress(b"hello" * 50)
    assert media.signatures(png) == [("image/png", 0, len(png))]
    assert media.signatures(b"noise" + png + b"RIFF" + packed + b"BM") == [("image/png", 5, len(png)), ("application/gzip", 9 + len(png), len(packed))]
    assert media.carve(b"noise" + png, 5, len(png)) == png
    assert media.signatures(png[:-1] + b"x") == [] and media.signatures(b"") == []
    assert media.from_wav(media.to_wav(b"abcd")) == b"abcd"
    wrong = spark.createDataFrame([(png, "image/gif"), (None, None)], "media binary, said string")
    assert [(r.media_type, r.corrected) for r in media.sniff(wrong, declared="said").collect()] == [("image/png", True), (None, False)]


def flac_of(total, frames):
    """A mono 16-bit FLAC stream; a frame is its number of samples and the bits of its subframe."""

    def crc(data, poly, bits):
        r = 0
        for b in data:
            r ^= b << bits - 8
            for _ in range(8):
                r = (r << 1 ^ (poly if r >> bits - 1 & 1 else 0)) & (1 << bits) - 1
        return r

    out = b"fLaC\x80\x00\x00\x22" + bytes(10) + (44100 << 44 | 15 << 36 | total).to_bytes(8, "big") + bytes(16)
    for k, (n, bits) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x70, 0x08]) + chr(k).encode() + (n - 1).to_bytes(2, "big")
        bits += "0" * (-len(bits) % 8)
        frame = head + bytes([crc(head, 7, 8)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
        out += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
    return out


def test_media_lengths():
    import io
    import zipfile

    verbatim = "00000010" + "".join(f"{RND.randrange(1 << 16):016b}" for _ in range(300))
    rice = "00010010" + f"{7:016b}" + "00" + "0001" + "".join("0101" + "".join("0" * RND.randrange(9) + "1" + f"{RND.randrange(32):05b}" for _ in range(n)) for n in (99, 100))
    wasted = "00000001" + "001" + f"{5:013b}"
    frames = [(300, verbatim), (200, rice), (64, wasted)] + [(200, rice)] * 140
    head = b"\x89PNG\r\n\x1a\n"
    import struct
    import zlib

    png = head + struct.pack(">I4sI", 0, b"IEND", zlib.crc32(b"IEND"))
    for total in (sum(n for n, _ in frames), 0):
        tune = flac_of(total, frames)
        assert media.signatures(b"noise" + tune + b"tail" + png) == [("audio/flac", 5, len(tune)), ("image/png", 9 + len(tune), len(png))]
    assert media.signatures(flac_of(564, frames[:2])) == []

    def pdf(body, updates):
        out = b"%PDF-1.7\n" + body
        for _ in range(updates):
            at = len(out)
            out += b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % at + b"\n"
        return out.rstrip()

    one, two = pdf(b"text\n", 3), pdf(b"text\n", 1)
    linear = b"%PDF-1.7\nxref\n0 1\nstartxref\n0\n%%EOF\nbody\nstartxref\n9\n%%EOF"
    outer = pdf(b"stream\n" + two + b"\nendstream\n", 1)
    for x in (one, two, linear, outer):
        assert media.signatures(b"noise" + x + b"  " + one) == [("application/pdf", 5, len(x)), ("application/pdf", 7 + len(x), len(one))]

    def zipped(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, data)
        return out.getvalue()

    stored = zipped("a.zip", zipped("b", b"hello"))
    assert media.signatures(stored)[0] == ("application/zip", 0, len(stored))
    assert media.signatures(b"x" + stored + stored) == [("application/zip", 1, len(stored)), ("application/zip", 1 + len(stored), len(stored))]


def test_media_false_hits_cost_no_more_than_the_buffer():
    import struct
    import time
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    hostile = [b"%PDF-1", b"%PDF-1 startxref 9 %%EOF ", b"PK\x03\x04", b"\xff\xd8\xff\xe0\x00\x02", b"\x1f\x8b\x08\x08", b"GIF89a" + b"\1" * 9, b"RIFF\xff\xff\0\0WAVE", b"OggS\0\2" + bytes(20), b"ID3\3\0\0\0\0\0\5", b"\x1a\x45\xdf\xa3", b"fLaC\x80\0\0\x22" + bytes(34), b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + struct.pack(">I4s", 900_000, b"IDAT")]
    for piece in hostile:
        began = time.perf_counter()
        media.signatures(piece * (2_000_000 // len(piece)))
        assert time.perf_counter() - began < 6, piece
    began = time.perf_counter()
    media.signatures(b"".join(p * (20_000_000 // len(hostile) // len(p)) for p in hostile))
    assert time.perf_counter() - began < 60
    data = bytes(RND.randrange(256) for _ in range(50_000))
    b = media.Buffer(data)
    assert all(b.crc32(x, y) == zlib.crc32(data[x:y]) for x, y in ((0, 50_000), (17, 40_000), (4095, 12_289), (4096, 8193), (5, 5)))


def test_media_formats(spark):
    import struct

    box = lambda k, d: struct.pack(">I4s", 8 + len(d), k) + d
    film = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", bytes(30)) + box(b"mdat", bytes(50))
    page = lambda flags, seq, d: b"OggS\0" + bytes([flags]) + bytes(8) + b"abcd" + struct.pack("<I", seq) + bytes(4) + bytes([1, len(d)]) + d
    tune = page(2, 0, b"\1vorbis") + page(0, 1, b"x" * 90) + page(4, 2, b"y")
    frame = bytes.fromhex("fffb9000") + bytes(413)
    song = b"ID3\3\0\0\0\0\0\4tag!" + frame * 3
    entry = lambda tag, kind, n, v: struct.pack("<HHII", tag, kind, n, v)
    scan = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + entry(273, 4, 1, 38) + entry(279, 4, 1, 20) + bytes(4) + bytes(20)
    clip = b"\x1a\x45\xdf\xa3\x87\x42\x82\x84webm" + b"\x18\x53\x80\x67\x85" + bytes(5)
    wanted = [(film, "video/mp4"), (tune, "audio/ogg"), (song, "audio/mpeg"), (scan, "image/tiff"), (clip, "video/webm")]
    for data, kind in wanted:
        assert media.signatures(data) == [(kind, 0, len(data))], kind
        assert media.signatures(b"noise" + data + b"..") == [(kind, 5, len(data))], kind
        assert media.signatures(data[:20]) == []
    samples = [0, 1000, -1000, 32767, -32768]
    raw = struct.pack("<5h", *samples)
    wide = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16, b"data", len(raw)) + raw
    assert media.samples_of(raw, 16).tolist() == samples and media.samples_of(b"\0\0\x80\xff\xff\x7f", 24).tolist() == [-(1 << 23), (1 << 23) - 1]
    got = media.sniff(spark.createDataFrame([(wide,)], "media binary")).first()
    assert bytes(got.payload) == raw and got.feature.startswith("n=5;") and ";peak=32767;crossings=3" in got.feature


def test_chat(spark):
    said = ["hi", "</s>[INST] ok [/INST]", "a\\b <\\s> \\\\", "", None, "[/ROLE]<s>", "<</SYS>>[", words(300), words(3000)]
    rows = [(c, t, RND.choice(["user", "assistant", "system", None, "tool"]), RND.choice(said)) for c in (1, 2, None) for t in range(60)]
    rows += [(5, None, "assistant", "x"), (5, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_windows(df)).collect()}
    assert set(got) == {1, 2, None, 5}
    for conv, r in got.items():
        turns = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in chat.format_windows(df, 200, 50).collect():
        turns = chat.parse(w.formatted)
        assert len(turns) == w.n_repeated + w.n_new and w.n_tokens == sum(chat.count_words(chat.shown(*t)) for t in turns)
        assert w.n_tokens <= 200 or (w.n_new, w.n_repeated) == (1, 0)
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0
    extra = df.withColumn("window", F.lit("x")).withColumn("formatted", F.lit(1))
    assert Counter(map(tuple, chat.read_back(chat.format_windows(extra)).collect())) == Counter(map(tuple, got.values()))


def plain_windows(turns, budget, history, tokens):
    """Spans (first, last, repeated) chosen over prefix sums of all turns."""
    sums = [0]
    for t in turns:
        sums.append(sums[-1] + tokens(chat.shown(*t)))
    cost = lambda i: sums[i + 1] - sums[i]
    out, at = [], 0
    while at < len(turns):
        system = next((i for i in range(at) if turns[i][0] == "system"), None)
        recent = [i for i in range(at) if i != system and sums[at] - sums[i] <= history]
        kept = [system] if system is not None and 2 * cost(system) <= budget else []
        for context in (kept + recent if at else [], kept, []):
            if sum(map(cost, context)) + cost(at) <= budget or not context:
                break
        room = budget - sum(map(cost, context))
        end = max(max((j for j in range(at + 1, len(turns) + 1) if sums[j] - sums[at] <= room), default=0), at + 1)
        out.append((at, end, context))
        at = end
    return out


def test_chat_windows_by_prefix_sums(spark):
    import public_tokenizers

    rnd = random.Random(8)
    tokens = chat.ModelTokens(public_tokenizers.path("piece_bpe_32k.model"))
    for case, system in enumerate((None, 20, 600, 6000)):
        turns = [("system", "sys " * system)] if system else []
        turns += [(("user", "assistant")[i % 2], "日本語" * rnd.randrange(40) if i % 7 == 0 else " ".join(f"w{i}" for _ in range(rnd.choice((1, 5, 40, 150, 900))))) for i in range(60)]
        df = spark.createDataFrame([(case, i, *t) for i, t in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
        for count in (chat.count_words, tokens):
            windows = chat.format_windows(df, 500, 90, count)
            got = sorted(windows.collect(), key=lambda w: w.window)
            want = plain_windows(turns, 500, 90, count)
            assert [w.formatted for w in got] == ["".join(chat.shown(*turns[i]) for i in [*context, *range(a, b)]) for a, b, context in want]
            assert all(w.n_tokens <= 500 or (w.n_new, w.n_repeated) == (1, 0) for w in got)
            loss = "".join(chat.unescape(w.formatted[a:b]) for w in got for a, b in zip(w.loss_starts, w.loss_ends, strict=True))
            assert loss == "".join(t for r, t in turns if r == "assistant")
        whole = chat.read_back(windows, in_order=True).collect()
        assert whole == chat.read_back(windows.repartition(7)).collect()
        with pytest.raises(Exception, match="came after"):
            chat.read_back(windows.orderBy(F.desc("window")).coalesce(1), in_order=True).collect()
    assert tokens("日本語" * 300_000) > 100_000


def test_chat_digests_by_sql(spark, sf_dir):
    from granary.llm import registry
    from tests.compare import assert_same, connect

    sql = """WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM said GROUP BY conv_id"""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    assert_same(registry.op2_chat(spark, sf).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"), connect(sf), sql)


def test_other_models_are_refused(tmp_path):
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2

    path = public_tokenizers.path("piece_bpe_32k.model")
    for change in (lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[400], "type", 4)):
        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(sentencepiece_bpe.read_model(path))
        change(m)
        (tmp_path / "m").write_bytes(m.SerializeToString())
        with pytest.raises(ValueError):
            sentencepiece_bpe.read_model(str(tmp_path / "m"))


def test_templates_do_not_meet(spark):
    """Texts that share 80 to 88 % of their shingles aren't similar; what is shuffled stays near linear."""
    def met(n):
        common = " ".join(f"t{i}" for i in range(340))
        docs = spark.createDataFrame([(i, common + " " + " ".join(f"own{i}x{j}" for j in range(60 + i % 5))) for i in range(n)], "doc_id bigint, text string")
        rows = similarity.signed(docs, similarity.sketch(docs)).withColumn("rep", F.col("doc_id"))
        return similarity._runs(rows.select("rep", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "token"))).count(), docs

    (few, _), (many, docs) = met(100), met(400)
    assert many <= 4 * max(few, 50)
    assert all(r.component_id == r.doc_id for r in similarity.join_similar(docs, 16, 64).collect())


def test_shared_cut_and_many_sources(spark):
    rows = [(None, "same text", "a")] * 400 + [(7, "x y z", "b")] * 90 + [(100 + i, "w " * 4, "c") for i in range(50)] + [(None, f"t{i} u", "d") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got, by = mixing.mix(docs).collect(), defaultdict(int)
    target = {r.source: r.target for r in got}
    for r in got:
        by[r.source] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(by[s] - target[s]) <= 2 for s in target)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(9)).collect()))
    out = Counter(r.source for r in mixing.mixed_documents(docs).collect())
    assert all(out[s] * size == by[s] for s, size in (("a", 2), ("b", 3), ("c", 4), ("d", 2)))
    sources = spark.createDataFrame([(None if i == 77 else f"s{i:04}", (i * 37) % 101) for i in range(500)], "source string, source_size bigint")
    order = sorted((r for r in sources.collect()), key=lambda r: (r.source is None, r.source or ""))
    want, left, open_ = {}, float(sum(r.source_size for r in order)), set(range(500))
    while open_:
        share = left / sum(1 + i % 3 for i in open_)
        over = [i for i in open_ if share * (1 + i % 3) > 3 * order[i].source_size]
        for i in over or list(open_):
            want[order[i].source] = 3.0 * order[i].source_size if over else share * (1 + i % 3)
            open_.discard(i)
            left -= want[order[i].source]
    assert all(math.isclose(r.target, want[r.source], abs_tol=1e-6) for r in mixing.targets(sources).collect())


def test_sampled_documents_by_brute_force(spark, docs, rows):
    """Which documents are taken: those with the least keys, up to the rest that is nearest."""
    weights = {6: 2.0, 8: 0.5, 100: 2.0, 101: 0.5, 102: None, 103: -1.0}
    by = spark.createDataFrame(list(weights.items()), "doc_id bigint, weight double")
    mixed, taken, per = mixing.mix(docs, by).collect(), Counter(), defaultdict(list)
    for r in mixed:
        taken[r.doc_id, r.size] += r.taken
        per[r.source].append(r)
    want = Counter()
    for s, rs in per.items():
        total, target = rs[0].source_size, rs[0].target
        epochs = min(3, int(target / total + 1e-12)) if total else 0
        rest, keyed = target - epochs * total, []
        for i, t, _, source, _ in rows:
            if source == s:
                size = len(WORD.findall(t or ""))
                name = f"{i if i is not None else hashlib.md5((t or '').encode()).hexdigest()}:{size}"
                h = int(hashlib.md5(name.encode()).hexdigest()[:13], 16)
                w = weights.get(i) or 1.0
                keyed.append((-math.log((h + 0.5) / 2**52) / (w if w > 0 else 1.0), size, i))
        run = 0
        for key, size, i in sorted(keyed, key=lambda k: (k[0], k[1])):
            want[i, size] += size * (epochs + (run + size / 2 <= rest))
            run += size
    assert +taken == +want


def odd_tables(spark):
    """Null and repeated ids, null, empty and equal texts, and columns with names that stages use."""
    base = words(60)
    few = [(1, base), (1, base), (2, base.replace(" ", "  ")), (None, base), (None, "lone text of some words here"), (3, None), (3, ""), (4, base.replace(base.split()[30], "changed")), (5, words(80)), (5, words(70)), (6, words(2000))]
    odd = spark.createDataFrame([(i, t, "en", None if k % 4 == 0 else f"s{k % 3}", k, -1.5, "i", k) for k, (i, t) in enumerate(few)], "doc_id bigint, text string, lang string, source string, _id int, score double, ids string, n_chars bigint")
    odd = odd.withColumn("row", F.lit("r")).withColumn("key", F.lit(0)).withColumn("_sha", F.lit("s")).withColumn("hash", F.lit(1)).withColumn("a b", F.lit("odd"))
    return odd, odd.limit(0)


def test_stages_on_odd_tables(spark, sf_dir):
    import corpus_pipeline

    odd, empty_ = odd_tables(spark)
    given = Counter(map(tuple, odd.collect()))
    for name, step in corpus_pipeline.STAGES:
        none = step(spark, empty_, sf_dir)
        assert none.count() == 0 and set(odd.columns) <= set(none.columns)
        got = step(spark, odd, sf_dir)
        if name == "sentencepiece":
            assert got.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "ids"] and got.count() == odd.count()
            continue
        assert got.columns == odd.columns
        left = Counter(map(tuple, got.collect()))
        assert set(left) <= set(given)
        if name == "toxicity":
            assert left == given
        elif name == "exact_dedup":
            texts_ = [" ".join((r[1] or "").split()) for r in left.elements()]
            assert len(texts_) == len(set(texts_)) == len({" ".join((r[1] or "").split()) for r in given})
            assert left == Counter(map(tuple, step(spark, odd.repartition(5), sf_dir).collect()))
        elif name == "ngram_jaccard_join":
            assert {r[0] for r in left} == {1, None, 3, 5, 6}
            assert sum(n for r, n in left.items() if r[0] is None) == 2


def test_every_operator_on_an_empty_table_and_clashing_names(spark, sf_dir):
    from granary.llm import registry

    odd, none = odd_tables(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id bigint, quality int, toxic int")
    for given, n in ((odd, odd.count()), (none, 0)):
        assert exact_dedup.deduplicate(given).count() == n
        assert similarity.join_similar(given).count() == n
        assert mixing.mix(given).count() == n
        assert toxicity.score(given, toxicity.fit(given, labels)).count() == n
        assert quality.score(given, quality.fit(given, labels)).count() == n
        assert language.identify(given, language.fit(given)).count() == n
        found = media.sniff(media.store_texts(given).withColumn("payload", F.lit("x")).withColumn("kind", F.lit("y"))).collect()
        assert len(found) == n and all(r.kind == "y" for r in found)
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None)], "page_id bigint, url string").withColumn("host", F.lit("h")).withColumn("m", F.lit(1))
    outcomes = spark.createDataFrame([(1, 1)], "page_id bigint, bad bigint")
    assert urls.judge(pages, outcomes, registry.RULES).count() == 3 and urls.judge(pages.limit(0), outcomes, registry.RULES).count() == 0


def test_urls(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/")]
    cases = {
        "http://A.Example.COM/en/71?x": ("a.example.com", "/en/71", "example.com/en/7", "allow"), "http://example.com/en/81#y": ("example.com", "/en/81", "com/en/", "block"),
        "//x.net/de/": ("", "", None, "allow"), None: ("", "", None, "allow"), "ftp://x.net?/de/": ("x.net", "", None, "allow"), "a://xnet/de/": ("xnet", "/de/", None, "allow"),
        "a://b://c.net/de/1": ("b:", "//c.net/de/1", None, "allow"), "http://spam.org/1": ("spam.org", "/1", None, "block"),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(1000 + i, "http://spam.org/z") for i in range(200)] + [(2000 + i, f"http://good{i % 20}.org/z") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    marked = spark.createDataFrame([(1000 + i, 1) for i in range(200)] + [(2000 + i, 0) for i in range(400)], "page_id bigint, bad bigint")
    got = {r.page_id: r for r in urls.judge(pages, marked, rules).collect()}
    for i, u in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == cases[u]
    assert got[2000].verdict == "allow" and len(got) == len(rows)
    ported = spark.createDataFrame([(1, "http://me@spam.co.uk:8080/1"), (2, "http://spam.co.uk/2"), (3, "http://a.spam.co.uk:/3")], "page_id bigint, url string")
    many = ported.union(spark.createDataFrame([(1000 + i, "http://spam.co.uk:81/x") for i in range(200)], ported.schema))
    again = {r.page_id: r for r in urls.judge(many, marked, rules).collect()}
    assert again[1].host == "me@spam.co.uk:8080" and again[1].bad_share == again[2].bad_share and {again[i].verdict for i in (1, 2, 3)} == {"block"}
    free = urls.judge(many, marked, rules, suffixes=[])
    assert free.where("host = 'spam.co.uk'").count() == 1
    assert urls.judge(pages.limit(0), marked.limit(0), rules).count() == 0


def test_posterior_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    cases = [(0.5, 4.0), (0.9, 3.0), (0.02, 50.0), (0.7, 1000.0), (0.3, 0.8), (0.99, 200.0), (0.6, 1e6)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, m double, s double")
    got = {r.i: r.q for r in df.select("i", urls.lower_quantile(F.col("m"), F.col("s")).alias("q")).collect()}
    for i, (m, s) in enumerate(cases):
        drawn = rng.beta(m * s, (1 - m) * s, 400_000)
        assert abs((drawn < got[i]).mean() - urls.TAIL) < 0.003, (m, s)


def test_classifiers_on_odd_tables(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100, 140)] + [(100, 0, 0), (None, 1, 1), (101, None, None)], "doc_id bigint, quality int, toxic int")
    for marked in (labels, labels.limit(0)):
        scored = quality.score(docs, quality.fit(docs.select("doc_id", "text"), marked)).collect()
        assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
        scored = toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), marked)).collect()
        assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    for known in (docs, docs.limit(0)):
        found = language.identify(docs, language.fit(known)).collect()
        assert len(found) == len(rows) and all(r.lang_pred == "und" for r in found if not re.search(r"[^\W\d_]", r.text or ""))


def test_language_rejects_narrow_margins(spark, sf_dir):
    from granary.llm import registry

    got = registry.op10_language(spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    assert all(r.rejected == (r.lang_pred == "und" or r.score < language.MARGIN) for r in got)
    assert 0 < sum(r.rejected and r.lang_pred != "und" for r in got) < 0.05 * len(got)


def test_every_language_has_its_dictionary(spark):
    rows = [(i, " ".join(f"{a}{b}{c}" for c in "xyzuvw" for _ in range(3)), f"l{i:03}") for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqrstu" for b in "abcdefghijklmnopqrst")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    contents = language.fit(docs)
    assert len(contents) == len(rows) == 420
    model = language.Model(contents)
    assert model.predict(rows[-1][1])[0] == "l419" and len(model.kept) <= 2 * language.KEPT_LANGUAGES


def test_nearest_are_exact():
    import numpy as np

    rng = np.random.default_rng(5)
    n_terms, n = 30, 1000
    w = np.zeros((n_terms, n))
    for j in range(n):
        at = rng.choice(n_terms, rng.integers(1, 6), replace=False)
        w[at, j] = rng.random(len(at)) + 0.1
    w /= np.linalg.norm(w, axis=0)
    terms, places = np.nonzero(w)
    mixed = rng.permutation(len(terms))
    postings = toxicity.Postings(terms[mixed], places[mixed], w[terms, places][mixed], n_terms, n)
    for j in (0, 63, 64, 999):
        at, own = postings.example(j)
        assert at.tolist() == np.flatnonzero(w[:, j]).tolist() and np.allclose(own, w[at, j])
    for but in (-1, -1, 5, 64, 999) * 20:
        at = np.sort(rng.choice(n_terms, 4, replace=False))
        q = rng.random(4)
        q /= np.linalg.norm(q)
        exact = q @ w[at]
        want = sorted((i for i in range(n) if exact[i] > 1e-12 and i != but), key=lambda i: (-round(exact[i], 12), i))[:10]
        assert postings.nearest(at, q, 10, but)[0].tolist() == want
    assert toxicity.Postings(terms[:0], places[:0], w[0, :0], n_terms, 0).nearest(np.array([3]), np.ones(1), 5)[0].tolist() == []


def brute_toxicity(known, texts_, nearest=25):
    """Scores by dense vectors over all words, zero where a word isn't telling; ``known`` is (id, label, text)."""
    import numpy as np

    bag = lambda t: Counter(re.findall(r"\w+", t.lower()))
    kind = lambda t: int(x[0]) if len(x := similarity.shingles(t)) else None
    first = {}
    for i, y, t in sorted(known):
        first.setdefault((y, kind(t)), t)
    n = {v: sum(y == v for y, _ in first) for v in (0, 1)}
    seen = Counter((w, y) for (y, _), t in first.items() for w in set(bag(t)))
    words_ = sorted({w for w, y in seen if seen[w, 1] >= 3})
    bound = 2 * math.log(toxicity.SPARE * max(len(words_), 1))
    telling = {}
    for w in words_:
        a, b = seen[w, 1], seen[w, 0]
        c, d = n[1] - a, n[0] - b
        total = n[0] + n[1]
        chi2 = total * (a * d - b * c) ** 2 / ((a + b) * (total - a - b) * n[1] * n[0] + 1e-9)
        if chi2 >= bound and ((a + 0.5) / (n[1] + 1)) / ((b + 0.5) / (n[0] + 1)) >= 2:
            telling[w] = math.log1p(total / (a + b))
    order = sorted(telling)

    def vector(t):
        c = bag(t)
        v = np.array([(1 + math.log(c[w])) * telling[w] if c[w] else 0.0 for w in order])
        return v / (np.linalg.norm(v) or 1)

    own = {i: vector(t) for i, _, t in known}
    examples = [(i, y) for i, y, _ in sorted(known) if own[i].any()]
    empty = [y for i, y, _ in known if not own[i].any()]
    share = (sum(empty) + 0.1) / (len(empty) + 1)

    def vote(v, but=None):
        cos = sorted(((v @ own[i], y) for i, y in examples if i != but), key=lambda x: -round(x[0], 12))
        cos = [x for x in cos if x[0] > 1e-12]
        if len(cos) > nearest and round(cos[nearest - 1][0], 12) == round(cos[nearest][0], 12):
            return None  # a tie at the edge, which places in the index decide
        cos = cos[:nearest]
        if not cos:
            return math.log(share / (1 - share))
        mass, far = sum(1 / (1.02 - c) for c, _ in cos), 1 / 1.02
        p = (sum(y / (1.02 - c) for c, y in cos) + far * share) / (mass + far)
        return math.log(p / (1 - p))

    return telling, [vote(vector(t)) for t in texts_]


def test_toxicity_by_brute_force(spark):
    rnd = random.Random(11)
    bad = [f"vile{i}" for i in range(8)]
    say = lambda k, more=(): " ".join(rnd.sample([rnd.choice("alpha beta gamma delta".split()) + str(rnd.randrange(60)) for _ in range(k)] + list(more), k + len(more)))
    known = [(i, 1, say(rnd.randrange(8, 60), rnd.choices(bad, k=rnd.randrange(1, 5)))) for i in range(60)] + [(i, 0, say(rnd.randrange(3, 60), rnd.choices(bad, k=rnd.random() < 0.03))) for i in range(60, 260)]
    known += [(300 + i, 1, known[0][2] + f" once{i}") for i in range(9)]
    asked = [say(20, rnd.choices(bad, k=k)) for k in (0, 1, 2, 3) * 10]
    docs = spark.createDataFrame([(i, t) for i, _, t in known] + [(0, known[0][2])], "doc_id bigint, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, y, _ in known], "doc_id bigint, toxic int"))
    telling, votes = brute_toxicity(known, asked)
    assert set(index.terms) == set(telling) and len(telling) >= 6
    assert all(math.isclose(index.idf[i], telling[w], rel_tol=1e-9) for w, i in index.terms.items())
    sure = 0
    for t, v in zip(asked, votes, strict=True):
        if v is not None:
            sure += 1
            assert math.isclose(index.judge(t)[0], 1 / (1 + math.exp(-(index.curve[0] * v + index.curve[1]))), abs_tol=1e-6)
    assert sure >= 20
    score, near, cos, terms = index.judge(known[3][2])
    assert near is not None and cos > 0.99 and set(terms) <= set(known[3][2].lower().split()) & set(telling)


def test_trees_by_a_plain_walk():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] + x[:, 7] > 0.5)).astype(float)
    forest = quality.grow(x, y)

    def walk(row):
        total = forest.base
        for root in forest.roots:
            at = int(root)
            while forest.feature[at] >= 0:
                at = int(forest.left[at]) + int(row[forest.feature[at]] > forest.threshold[at])
            total += forest.value[at]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.95
    # The first tree's root is the best split of all, by trying each.
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
    best = max((gain(x[:, j] <= e) + gain(x[:, j] > e), j, e) for j in range(x.shape[1]) for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])))
    root = forest.roots[0]
    assert (forest.feature[root], forest.threshold[root]) == best[1:]
    leaf = int(forest.left[root])
    mine = x[:, best[1]] <= best[2]
    assert math.isclose(forest.value[leaf], -quality.RATE * g[mine].sum() / (h[mine].sum() + quality.RIDGE), rel_tol=1e-9)


def test_quality_reads_a_bounded_sample(spark):
    docs = spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).union(spark.range(50).select("id", F.lit("a b")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, quality int")
    from granary.llm.common import one_text_each

    once = one_text_each(docs, "doc_id", "text").collect()
    assert len(once) == 50 and [r.text for r in once if r.doc_id == 7] == [r.text for r in one_text_each(docs.repartition(5), "doc_id", "text").collect() if r.doc_id == 7]
    assert quality.fit(docs, labels, most_rows=20).base == quality.fit(docs.repartition(3), labels, most_rows=20).base


def test_languages_by_brute_force(spark):
    import zstandard

    rnd = random.Random(4)
    sounds = {"aa": "ka ta ma ra".split(), "bb": "blo gru stri pha".split(), "cc": "नम स्ते हिन् दी".split()}
    say = lambda name, k: " ".join("".join(rnd.choices(sounds[name], k=rnd.randrange(1, 4))) for _ in range(k))
    known = [(i, say(n, rnd.randrange(5, 200)), n) for i, n in enumerate(list(sounds) * 8)]
    asked = [say(n, k) for n in sounds for k in (1, 5, 400)] + ["Ka1TA!ma", "½ ²", "१२", "", None]
    contents = language.fit(spark.createDataFrame(known, "doc_id bigint, text string, lang string"))
    fold = lambda t: " ".join(re.sub("[^a-z\u0900-\u0965\u0970-\u097f]", " ", (t or "").lower()).split())
    for name, content in contents.items():
        whole = [f" {fold(t)} ".encode() for _, t, n in known if n == name and f" {fold(t)} ".encode() in content]
        assert len(whole) >= 5 and len(content) == sum(map(len, whole))  # each slot gives one document
    got = language.identify(spark.createDataFrame([(i, t, "x") for i, t in enumerate(asked)], "doc_id bigint, text string, score string"), contents).collect()
    for r in got:
        raw = f" {fold(r.text)} ".encode() if fold(r.text) else b""
        if not raw or r.text in ("१२",):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        sizes = {}
        for name in sorted(contents):
            d = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(c.compress(raw[i : i + language.BLOCK_BYTES])) for i in range(0, len(raw), language.BLOCK_BYTES))
        best = min(sizes, key=lambda n: (sizes[n], n))
        rest = min(v for n, v in sizes.items() if n != best)
        assert r.lang_pred == best and math.isclose(r.score, (rest - sizes[best]) / rest) and r.rejected == (r.score < language.MARGIN)


def test_language_samples_whole_documents(spark):
    rows = [(1, "long " * 5000, "x"), (2, "short one", "x"), (3, "other", "x"), (4, "very long " * 5000, "y"), (5, "½", "z")]
    got = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), most_bytes=100)
    assert set(got) == {"x", "y"} and set(got["x"].split()) == {b"short", b"one", b"other"} and len(got["y"].split()) == 10_000


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    from granary.llm import registry

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = registry.op10_language(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = registry.op9_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.98 * len(got)
    got = registry.op6_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits >= 0.9 * sum(r.predicted for r in got) and hits >= 0.9 * sum(r.toxic for r in got)
    loss = [math.log(max(r.score if r.toxic else 1 - r.score, 1e-9)) for r in got]
    share = sum(r.toxic for r in got) / len(got)
    assert -sum(loss) / len(loss) < 0.25 * -(share * math.log(share) + (1 - share) * math.log(1 - share))
