"""Operators against plain computations, exact round trips and held-out accuracy."""

import collections
import datetime
import hashlib
import io
import math
import os
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from reviewloom.llm import chunked_bpe, encoder, linededup, multiprobe, packing, pii, ppm, quality, shards, simhash, sstable, toxicity
from reviewloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
ODD = [*"aAbBéÉßÄçñİıſŠžΣσς’'s<|>1٣²  .,!?|*中한ᄀ각🙂", "̸", "\u0085", "\u001c", "\n", "\t", "<|endoftext|>", "<|startoftext|>", " the ", "ing"]


@pytest.fixture(scope="module")
def tok():
    return encoder.load(encoder.default_tokenizer())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    odd = ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(1500)]
    shared = " ".join(rng.choices(["alpha", "beta,", "Gamma", "δ", "eps."], k=700))
    return [*odd, shared, "x " + shared, shared + "tail", "head" + shared, "w" * 30_000, "é" * 20_000, " " * 9000, ""]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_encoder_equals_the_library(tok, texts):
    own = encoder.WordEncoder(encoder.default_tokenizer(), memo_words=300, memo_parts=200)
    got = [x for i in range(0, len(texts), 100) for x in own.encode(texts[i : i + 100])]
    assert got == [packed(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_codec_equals_the_library(tok, texts):
    own = chunked_bpe.ChunkCodec(encoder.default_tokenizer(), memo_bytes=200_000)
    got = [x for i in range(0, len(texts), 60) for x in own.encode(texts[i : i + 60])]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert got == [packed(x) for x in want]
    assert own.decode(got) == tok.decode_batch(want, skip_special_tokens=False)
    assert own.reused > 0


def plain_file(tmp_path, splits):
    """A small BPE over bytes, written by hand: with splits at white space kept in front, or without any split."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    vocab = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    merges = [("a", "l"), ("al", "p"), ("h", "a"), ("alp", "ha"), ("Ġ", "b"), ("e", "t"), ("a", ","), ("Ġb", "et"), ("w", "w"), ("ww", "ww"), ("Ġ", "Ġ")]
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    t = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=splits)
    t.decoder = decoders.ByteLevel()
    t.add_special_tokens(["<|endoftext|>"])
    t.save(f"{tmp_path}/plain{splits}.json")
    return f"{tmp_path}/plain{splits}.json"


@pytest.mark.parametrize("kind", ["byte level", "by hand", "without splits"])
def test_codec_with_other_files(texts, tmp_path, kind):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json") if kind == "byte level" else plain_file(tmp_path, kind == "by hand")
    rng = random.Random(5)
    long = ["".join(rng.choices(ODD, k=rng.randint(300, 4000))) for _ in range(60)] + ["a  \n\n b" * 2000, "<|endoftext|>" * 900, "x" * 9000 + " y" + "z" * 9000]
    mine = [*texts[:200], *long, *texts[1500:]]
    own = chunked_bpe.ChunkCodec(path, memo_bytes=2_000_000)
    assert not own.encoder.by_words
    got = [x for i in range(0, len(mine), 60) for x in own.encode(mine[i : i + 60])]
    want = [packed(e.ids) for e in own.tokenizer.encode_batch(mine, add_special_tokens=False)]
    assert got == want
    assert encoder.WordEncoder(path).encode(mine) == want
    assert own.reused > 0
    assert kind != "without splits" or own.merged > 0  # no join can agree: whole texts are encoded


def test_joins_widen_until_they_agree(tok):
    rng = random.Random(6)
    mine = ["".join(rng.choices(["a", "b ", " ", "<|endoftext|>", "c d e f ", "word"], k=rng.choice([50, 900, 3000]))) for _ in range(60)] + ["w" * 50_000, "a b " * 9000]
    own = chunked_bpe.ChunkCodec(encoder.default_tokenizer())
    assert own.encoder.by_words
    assert own.encode(mine) == [packed(e.ids) for e in tok.encode_batch(mine, add_special_tokens=False)]
    assert own.widened > 0
    assert own.merged > 0


def test_cuts_follow_the_content():
    rng = random.Random(2)
    passage = bytes(rng.choices(range(97, 123), k=20_000))
    a, b = (set(np.array(chunked_bpe.cut_points(p + passage)) - len(p)) for p in (b"", b"some other start " * 9))
    assert len(a & b) > 0.8 * len(a)
    data = "é中🙂".encode() * 4000
    at = 0
    for e in chunked_bpe.cut_points(data):
        data[at:e].decode()
        assert 0 < e - at <= chunked_bpe.MAX_BYTES
        at = e
    assert at == len(data)


def test_codec_tables(spark, tok, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:300])], "doc_id long, text string")
    ids = chunked_bpe.encode(df)
    want = tok.encode_batch(texts[:300], add_special_tokens=False)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: e.ids for i, e in enumerate(want)}
    assert {r.doc_id: r.text for r in chunked_bpe.decode(ids).collect()} == {i: tok.decode(e.ids, skip_special_tokens=False) for i, e in enumerate(want)}


def test_pieces_cover_and_waste_little():
    for n in [1, 2, 682, 683, 1023, 1024, 1025, 2047, 2048, 2049, 9999]:
        cuts = packing.cut(n, 2048, 1 / 64)
        assert [s for s, _ in cuts] == [0, *np.cumsum([k for _, k in cuts])[:-1]]
        assert sum(k for _, k in cuts) == n
        assert all(2048 - 2048 // k * k <= 32 for _, k in cuts)


def test_packing_is_exact_and_gapless(spark, tok):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["one", "two", "three,", "fourteen"], k=rng.choice([0, 3, 40, 900, 5000])))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    packer = packing.HarmonicPacker()
    pieces = packer.pack(df)
    rows = pieces.collect()
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in docs}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(packed(ids[r.doc_id][r.start : r.start + r.length]))
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for s, n in sorted(by_doc[i]):
            assert s == at
            at += n
        assert at == len(x)
    filled = {}
    for s, parts in by_seq.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        filled[s] = at
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(2048 - n for n in filled.values() if n & (n - 1)) < 0.02 * sum(filled.values()) + 2048
    real = {r.sequence_id: r.ids for r in packer.sequences(df, pieces).collect()}
    for r in rows:
        assert real[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]


def test_sorted_string_table():
    out = io.BytesIO()
    w = sstable.Writer(out, 2)
    keys = [None, -5, -5, *range(0, 40_000, 2)]
    for k in keys:
        w.add(sstable.key_of(k), np.arange(k % 7 if k else 3, dtype=np.uint32))
    size = w.finish()
    assert size == out.tell()
    r = sstable.Reader(out, size)
    assert [k for k, _ in r] == keys
    assert r.entries == len(keys)
    assert [len(x) for x in r.get(-5)] == [2, 2]
    assert len(r.get(None)) == 1
    assert r.get(39_998)[0].tolist() == list(range(39_998 % 7))
    assert r.get(1) == []
    assert sum(r.may_hold(k) for k in range(1, 20_000, 2)) < 400
    bad = bytearray(out.getvalue())
    bad[100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(sstable.Reader(io.BytesIO(bad), size))
    with pytest.raises(ValueError, match="ascend"):
        w.add(sstable.key_of(0), np.arange(1))


def test_shards_round_trip(spark, tok, tmp_path):
    docs = [(i * 3 - 30, f"text {i} " * (i % 50)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    own = shards.TokenShards(shard_bytes=4000)
    manifest = own.write(df, f"file://{tmp_path}/s")
    assert len(manifest) > 4
    before = 0
    for r, (i, t) in zip(own.read(spark, manifest).orderBy("start").collect(), sorted(docs), strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, before, len(ids), zlib.crc32(packed(ids)))
        before += len(ids)
    assert [x.tolist() for x in shards.lookup(manifest, 30)] == [[*tok.encode("text 20 " * 20, add_special_tokens=False).ids, 1]]
    assert shards.lookup(manifest, 31) == []


def components(links, nodes):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain_fingerprint(t, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + width] for i in range(len(w) - width + 1)] or [w])] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in ["", "a", "A b", "The cat sat on the mat, É the cat sat\ton", " \n", "x y z " * 300]:
        assert simhash.fingerprint(simhash.hashes(t)) & (2**64 - 1) == plain_fingerprint(t)


@pytest.mark.parametrize("split_over", [64, 2])
def test_links_in_a_dense_ball(spark, split_over):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(60)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = components([(signed(x), signed(y)) for i, x in enumerate(prints) for y in prints[i + 1 :] if (x ^ y).bit_count() <= 2], [signed(x) for x in prints])
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, split_over)).collect()}
    assert {k: v for k, v in want.items() if list(want.values()).count(v) > 1} == got


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(i, 500) for i in range(100, 140)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys([*range(100, 140), 500], 100)


@needs_tables
def test_quality_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = con.execute(ORACLE_SQL["op9_quality_divergence"])
    names = [d[0] for d in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in QUERIES["op9_quality_divergence"](spark, SF).collect()) == want


def test_quality_base_measures(spark):
    rows = ["a b c d e f a b c d e x", "one two three\n\none two three\n \nfour", "x" * 30, "k " * 40, None, "*** |a| $5 ok ok ok ok ok ok ok ok"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    for r in quality.QualityRules().score(df).collect():
        t = rows[r.doc_id] or ""
        w = t.split()
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(win)
        rep = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if x.strip()]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def luhn(d):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        body = "".join(rng.choices("0123456789", k=15))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        day = datetime.date(1950, 1, 1) + datetime.timedelta(rng.randrange(30_000))
        phone = f"+1 ({rng.randrange(1000):03}) 555-{rng.randrange(10000):04}"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        ssn = f"{rng.randrange(1, 600):03}-{rng.randrange(1, 99):02}-{rng.randrange(1, 9999):04}"
        rows.append((i, f"card {card} day {day} phone {phone} ip {ip} ssn {ssn} again {card}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, "k", count="n").collect()}
    pattern = r"card (\d{16}) day (\d{4}-\d\d-\d\d) phone (\+1 \(\d{3}\) 555-\d{4}|\+1 \(\d{3}\) \d{3}-\d{4}) ip (\d+\.\d+\.\d+\.\d+) ssn (\d{3}-\d\d-\d{4}) again (\d{16})$"
    images = collections.defaultdict(set)
    for i, t in rows:
        old, new = re.fullmatch(pattern, t).groups(), re.fullmatch(pattern, got[i].text).groups()
        assert got[i].n == 6
        assert new[0] == new[5]
        assert luhn(new[0])
        assert new[0][0] == old[0][0]
        datetime.date.fromisoformat(new[1])
        assert all(0 <= int(x) <= 255 for x in new[3].split("."))
        assert not new[4].startswith(("000", "666", "9"))
        assert all(a != b for a, b in zip(old[:3], new[:3], strict=True))
        for k, v in enumerate(zip(old, new, strict=True)):
            images[k % 5].add(v)
    for pairs in images.values():  # a permutation: equal to equal, different to different
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


@pytest.mark.parametrize(
    "t", ["9807915762804490", "999.1.1.1", "1.2.3.4.5", "2023-02-29", "000-12-3456", "666-12-3456", "DE89370400440532013001", "v1.2.3", "12 345 678", "a@b", "deadbeef", "$1\\1", ""]
)
def test_what_is_not_valid_stays(spark, t):
    assert pii.pseudonymize(spark.createDataFrame([(t,)], "text string"), "k").first().text == t


def feistel(key, kind, a, b, left, right):
    f = lambda i, m, v: int(hashlib.sha256(f"{key}|{kind}|{i}|{m}|{v}".encode()).hexdigest()[:13], 16) % m
    for i in range(8):
        if i % 2 == 0:
            left = (left + f(i, a, right)) % a
        else:
            right = (right + f(i, b, left)) % b
    return left, right


def test_feistel_against_python(spark):
    left, right = feistel("k", "ip", 65536, 65536, 10 * 256, 1)
    want = f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"
    assert pii.pseudonymize(spark.createDataFrame([("ip 10.0.0.1 x",)], "text string"), "k").first().text == f"ip {want} x"


def plain_alignment(x, y):
    """Patience diff of two lists, by recursion: pairs of places."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    if head:
        return [(k, k) for k in range(head)] + [(i + head, j + head) for i, j in plain_alignment(x[head:], y[head:])]
    tail = 0
    while tail < min(len(x), len(y)) and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    if tail:
        return plain_alignment(x[:-tail], y[:-tail]) + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]
    both = [(i, y.index(v)) for i, v in enumerate(x) if x.count(v) == 1 and y.count(v) == 1]
    if not both:
        return []
    longest = []
    for k, (_, j) in enumerate(both):
        longest.append(1 + max([longest[q] for q in range(k) if both[q][1] < j], default=0))
    chosen, want, limit = [], max(longest), len(both)
    while want:
        limit = max(k for k in range(limit) if longest[k] == want)
        chosen.insert(0, both[limit])
        want -= 1
    out, a, c = [], 0, 0
    for i, j in [*chosen, (len(x), len(y))]:
        out += [(a + p, c + q) for p, q in plain_alignment(x[a:i], y[c:j])]
        if i < len(x):
            out.append((i, j))
        a, c = i + 1, j + 1
    return out


def brute_lines(docs, least=50, rare=8):
    """Blocks of `least` words or more that are aligned with an earlier document go. docs: in order, with different ids."""
    lines = {d: [(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()] for d, t in docs}
    size = lambda own: sum(len(x.split()) for _, x in own)
    held = collections.defaultdict(list)
    for d, own in lines.items():
        spans = set()
        for a in range(len(own)):
            spans |= {(a, next((b for b in range(a + 1, len(own) + 1) if size(own[a:b]) >= least), None))}
            spans |= {(next((b for b in range(a, -1, -1) if size(own[b : a + 1]) >= least), None), a + 1)}
        for a, b in spans:
            if a is not None and b is not None:
                held[tuple(x for _, x in own[a:b])].append((d, a, b))
    order = [d for d, _ in docs]
    shared, partners = collections.defaultdict(set), collections.defaultdict(set)
    for places in held.values():
        ids = sorted({d for d, _, _ in places}, key=order.index)
        if len(ids) > 1:
            for d, a, b in places:
                shared[d] |= set(range(a, b))
            for k, d in enumerate(ids):
                partners[d] |= set(ids[:k] if len(ids) <= rare else ids[: min(k, 1)])
    out = {}
    for d, t in docs:
        gone, own = set(), lines[d]
        for e in partners[d]:
            x, y = sorted(shared[d]), sorted(shared[e])
            block = []
            for i, j in [*((x[i], y[j]) for i, j in plain_alignment([own[k][1] for k in x], [lines[e][k][1] for k in y])), (-9, -9)]:
                if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                    if size([own[k] for k, _ in block]) >= least:
                        gone |= set(range(own[block[0][0]][0], own[block[-1][0]][0] + 1))
                    block = []
                block.append((i, j))
        out[d] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 12, 30, 60]))) for _ in range(40)]
    docs = [(d, "\n".join(rng.choices([*lines, "", "  "], k=rng.randint(1, 14)))) for d in range(120)]
    docs += [(200, docs[0][1]), (201, docs[0][1] + "\nmore")]
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_moved_passages_against_brute_force(spark):
    rng = random.Random(16)
    line = lambda n: " ".join(f"m{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(rng.randint(8, 40)) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    docs = []
    for d in range(90):
        own = []
        for p in rng.sample(passages, rng.randint(0, 4)):
            own += [line(rng.randint(1, 30)) for _ in range(rng.randint(0, 2))] + p[rng.randint(0, 1) :]
        docs.append((d, "\n".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    results = []
    for rare in (2, 4, 100):
        results.append({r.doc_id: r.text for r in linededup.dedup(df, rare=rare).collect()})
        assert results[-1] == brute_lines(docs, rare=rare)


def test_what_crosses_the_alignment_stays(spark):
    a, b, c = (["\n".join(f"{x}{k} " * 20 for k in range(n))][0] for x, n in (("a", 3), ("b", 5), ("c", 4)))
    docs = [(1, f"{a}\n{b}"), (2, f"{b}\n{a}"), (3, f"{c}\nown words\n{c}"), (4, c), (5, f"{c}\nother words\n{c}\nend\n{c}")]
    got = {r.doc_id: r.text.strip() for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2] == a.strip()  # the longer passage is aligned, the other one moved
    assert got[3] == docs[2][1].strip()
    assert got[4] == ""
    assert got[5].split("\n")[0].strip() == "other words"
    assert got[5].count("c0 ") == 20  # two are aligned with those of document 3, the third is a repeat


def test_patience():
    assert linededup.increasing([3, 1, 2, 9, 5, 6]) == [1, 2, 4, 5]
    rng = random.Random(1)
    for _ in range(3000):
        x, y = (rng.choices(range(rng.choice([4, 12, 40])), k=rng.randint(0, 14)) for _ in range(2))
        assert linededup.patience(x, y) == plain_alignment(x, y)


def test_many_repeated_lines_take_seconds(spark):
    long = "\n".join(["the same words " * 17] * 100_000)
    mixed = "\n".join(f"{'the same words ' * 17}\nline {k}" for k in range(50_000))
    docs = [(1, long), (2, long), (3, "the same words " * 17), (4, mixed), (5, long + "\nend"), (6, mixed)]
    began = time.time()
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert (got[2], got[3], got[5], got[6]) == ("", "", "end", "")
    assert time.time() - began < 60


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    common = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(400)]
    bad = ["idiot", "moron", "pathetic", "worthless"]
    docs, marks = [], []
    for i in range(900):
        ws = rng.choices(common, k=rng.randint(5, 150))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        docs.append((i, " ".join(ws)))
        marks.append((i, int(toxic)))
    df, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.ToxicityModel().score(df, labels).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [got[i].held_out for i in range(900)] == [i in set(held) for i in range(900)]
    assert sum(got[i].predicted == marks[i][1] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_misspelt_words_share_vectors():
    rng = random.Random(9)
    common = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join([*rng.choices(common, k=20), *(["pathetic"] if i % 3 == 0 else [])]) for i in range(600)]
    m = toxicity.FastText().fit(texts, [int(i % 3 == 0) for i in range(600)])
    g, c = m.logits()
    s = toxicity.Scorer(g, c, m.slope, m.shift, m.bits)
    base = " ".join(common[:20])
    assert s.score(base) < 0.1
    assert s.score(base + " pathetic") > 0.5
    # words that were never seen are judged by the n-grams they share
    assert s.score(base + " pathetik") > 2 * s.score(base + " natsohei")
    assert s.score(base + " patthetic") > 2 * s.score(base + " natsohei")


def test_neighbours_against_all_distances(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1500:1600] = x[100]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in multiprobe.MultiProbe().search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    hit = 0
    x = x.astype(float)
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(3000) if i != q)[:10]
        assert len(got[q]) == 10
        assert got[q] == sorted(got[q])
        assert all(s == d[i] for s, i in got[q])
        hit += len({i for _, i in want} & {i for _, i in got[q]})
    assert hit / 300 >= 0.9
    assert [i for _, i in got[100]] == list(range(1500, 1510))


def plain_ppm(train):
    grams = [collections.defaultdict(collections.Counter) for _ in range(4)]
    for b in train:
        s = [0, 0, 0, *b, 256]
        for i in range(3, len(s)):
            for o in range(4):
                grams[o][tuple(s[i - o : i])][s[i]] += 1

    def prob(ctx, sym):
        out, p = set(), 1.0
        for o in (3, 2, 1, 0):
            c = ctx[3 - o :]
            x = {s: n for s, n in grams[o][c].items() if s not in out}
            if not x:
                continue
            n, q = sum(x.values()), len(x)
            if sym in x:
                return p * x[sym] / (n if q == 257 - len(out) else n + q)
            p *= q / (n + q)
            out |= set(x)
        return p / (257 - len(out))

    return lambda b: sum(math.log10(prob(tuple(s[i - 3 : i]), s[i])) for s in [[0, 0, 0, *b, 256]] for i in range(3, len(s)))


@pytest.mark.parametrize("contexts", [ppm.CONTEXTS3, 40, 1])
def test_ppm_against_plain_counts(spark, contexts):
    rng = random.Random(10)
    docs = [(i, " ".join(rng.choices(["Alpha", "beta", "gamma", "é", "delta.", "x"], k=rng.randint(0, 40)))) for i in range(60)] + [(100, None), (101, "zzz \u0000 ÿ new")]
    got = {r.doc_id: r for r in ppm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), contexts=contexts).collect()}
    low = {i: (t or "").encode().lower() for i, t in docs}
    train = [b for i, b in low.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    score = plain_ppm(train)
    words = collections.Counter(w for b in train for w in [*b.split(), "end"])
    n, v = sum(words.values()), len(words)
    for i, b in low.items():
        r, ws = got[i], [*b.split(), "end"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(words[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score == pytest.approx(score(b), rel=1e-5)


def test_ppm_holds_a_few_windows_of_a_slice():
    """Two megabytes of text took 100 MB and more of arrays, in each of an executor's workers at once."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 105, 100_000).astype(np.uint8).tobytes() for _ in range(20)]
    grams, n = ppm.count_grams(texts)
    assert n.sum() == 20 * 100_001
    two, at = np.unique(grams & (1 << 25) - 1, return_inverse=True)
    trie = ppm.Trie((two, np.bincount(at, n)), (grams, n.astype(float)))
    for work in (ppm.count_grams, trie.score):
        tracemalloc.start()
        work(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6, work


def test_ppm_windows_cut_texts_anywhere(monkeypatch):
    texts = [b"", b"a", b"", b"abcabcabc" * 3, b"\0\0\0\0", b"xyz"]
    plain = collections.Counter()
    for t in texts:
        s = [0, 0, 0, *t, 256]
        plain.update(s[i - 3] << 25 | s[i - 2] << 17 | s[i - 1] << 9 | s[i] for i in range(3, len(s)))
    for window in (1, 2, 3, 4, 7, 1000):
        monkeypatch.setattr(ppm, "WINDOW", window)
        keys, n = ppm.count_grams(texts)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == plain
        doc, gram = map(np.concatenate, zip(*ppm.grams(texts), strict=True))
        assert np.bincount(doc, minlength=len(texts)).tolist() == [len(t) + 1 for t in texts]
        assert (gram[np.cumsum([len(t) + 1 for t in texts]) - 1] & 511 == ppm.END).all()


def test_ppm_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    for _ in range(50):
        levels = [np.where(rng.random(257) < p, rng.integers(1, 9, 257), 0) for p in rng.choice([0, 0.01, 0.3, 1], 4)]
        assert ppm.probabilities(levels).sum() == pytest.approx(1)


@needs_tables
def test_pipeline_keeps_what_its_stages_decide(spark):
    spark.conf.set(pii.KEY_SETTING, "of the test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in QUERIES["op9_quality_divergence"](spark, SF).filter("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    lines = brute_lines(rows)
    sets = {}
    for i, t in lines.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = components([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], ids)
    left = [(i, lines[i]) for i in ids if root[i] == i]
    private = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame(left, "doc_id long, text string"), "of the test").collect()}
    tokens = encoder.load(encoder.default_tokenizer())
    want = {i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in private.items()}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    spark.conf.unset(pii.KEY_SETTING)
    assert got == want
