"""Small cases of every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns; and brute force."""

import collections
import hashlib
import html
import itertools
import json
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrata.llm import common, lang_cnn, line_dedup, mpeg_audio, phrase_index, rendezvous, repair_grammar, setsketch, subword_quality, vector_packing, wrapper_html

from .. import oracle

TOKENIZER = common.default_tokenizer()
LIBRARY = Tokenizer.from_file(TOKENIZER)
LONG = "word the of, and! " * 4000 + "Ärger " * 50
TEXTS = [(1, "Hello world, hello again. It's fine"), (2, None), (3, ""), (4, LONG), (5, "  \n\n x"), (5, "  \n\n x"), (6, "<|endoftext|>odd\ttext\r\n é 123"), (None, "no id here at all"), (7, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, repeats, a long text, and columns named like the operators' own."""
    rows = [(i, t, "en" if t else None, f"s{k % 2}", len(t or ""), k, "clash", [1], b"x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start int, shard string, place array<int>, rep binary")


def encode(text, end):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [end]


def test_shared_folder(spark, monkeypatch):
    class Bare:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Bare.sparkContext.master = master
        with pytest.raises(RuntimeError):
            common.shared_folder(Bare)


def test_tokens_equal_library():
    words = ["plain", "It's", "<|endoftext|>", "ÀÉ!!", "ﬁ", "İ", "a" * 300, "", "x%%%y", "naïve.", "１２", "ΣΑΣ", "a\x1cb"]
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(words, 30)) + "\n" for _ in range(50)] + [None]
    t = common.WordTokenizer(TOKENIZER, most=5)
    for _ in range(3):  # a full store, then a new one
        ids, bounds = t.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [encode(x, 0)[:-1] for x in texts]


def test_letters_and_marks_are_encoded_once(tmp_path):
    words = ["The", "the", "the,", "THE!", "The,!", "ÀÉß.", "àéß", "×,", "Ÿ!", "ÿ!", "ŒUVRE,", "ǅ.", "a\u0301,", "x\u0327.", "K.", "don't,", "'S!", "!the", ",", "!,", "a,b", "9,", "é#$&*", "\xa0a,", "ſ,", "É\u0301!"]
    texts = [*words, " ".join(words), "\n".join(words[::-1])]
    t = common.WordTokenizer(TOKENIZER)
    assert t.in_units
    t.encode(pa.array(["The the THE the, The, THE! the,! Cat, cat! CAT"]))
    assert sorted(t.known.to_pylist()) == ["!", ",", ",!", "cat", "the"]
    # a tokenizer that keeps case, and one that leaves marks with their letters
    made = json.loads(open(TOKENIZER, encoding="utf-8").read())
    cased = made | {"normalizer": {"type": "NFC"}}
    whole = made | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, made["pre_tokenizer"]["pretokenizers"][1]]}}
    for k, (kind, units) in enumerate(((made, True), (cased, False), (whole, False))):
        (path := tmp_path / f"{k}.json").write_text(json.dumps(kind))
        other, library = common.WordTokenizer(str(path)), Tokenizer.from_file(str(path))
        assert other.in_units == units
        ids, bounds = other.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_word_hashes_follow_the_words(monkeypatch):
    texts = [t for _, t in TEXTS] + ["É a!b", "w" * 5000, " " * 3000 + "z"]
    for kind, pattern in (("space", r"[^\x20\x09-\x0D]+"), ("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
        flat = [w for x in words for w in x]
        for piece in (1 << 20, 700):
            monkeypatch.setattr(common, "_PIECE", piece)
            h, bounds = common.hash_words(*common.string_bytes(pa.array(texts)), common.word_values(kind))
            assert np.diff(bounds).tolist() == [len(x) for x in words]
            assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist(), strict=True)))


# --- 1: grammar shards


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for seq in ([], [5], [7] * 50, [1, 2] * 40, list(range(30)), rng.integers(0, 9, 5000).tolist()):
        bounds = np.array([0, len(seq) // 2, len(seq) // 2, len(seq)])
        s = repair_grammar.Shard(repair_grammar.compress(np.array(seq, np.uint32), bounds, least=2))
        assert s.expand(s.symbols()).tolist() == seq
        assert [s.document(k).tolist() for k in range(3)] == [seq[bounds[k] : bounds[k + 1]] for k in range(3)]
        for a, b in rng.integers(0, len(seq) + 3, (50, 2)).tolist():
            assert s.ids(a, b).tolist() == seq[a : max(a, b)]
    with pytest.raises(ValueError):
        repair_grammar.Shard(b"nope" + bytes(16))


def test_grammar_saves_space():
    ids = np.tile(np.arange(40, dtype=np.uint32), 500)
    assert len(repair_grammar.compress(ids, np.array([0, len(ids)]))) < len(ids)


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(5)
    run, words = np.full(1 << 14, 3, np.uint32), np.tile(rng.integers(10, 400, 300).astype(np.uint32), 40)
    for parts in ([run], [run, words], [words, rng.integers(0, 30, 20_000).astype(np.uint32), run]):
        ids = np.concatenate(parts)
        bounds = np.array([0, 9, len(ids) // 2, len(ids)])
        s = repair_grammar.Shard(repair_grammar.compress(ids, bounds))
        assert s.expand(s.symbols()).tolist() == ids.tolist()
        pairs = collections.Counter()
        for k in range(3):
            part = s.symbols(s.symbol_bounds[k], s.symbol_bounds[k + 1]).tolist()
            assert s.document(k).tolist() == ids[bounds[k] : bounds[k + 1]].tolist()
            pairs.update(itertools.pairwise(part))
        assert max(pairs.values(), default=0) < repair_grammar.LEAST
        assert len(s.rules) == len({tuple(r) for r in s.rules.tolist()}) and int(s.lengths.max()) > 64


def test_bits_round_trip():
    rng = np.random.default_rng(9)
    for bits in (1, 3, 7, 8, 9, 16, 17, 31, 40, 56):
        for n in (0, 1, 7, 8, 9, 100):
            values = rng.integers(0, 1 << bits, n, dtype=np.int64)
            data = np.frombuffer(repair_grammar.pack_bits(values, bits), np.uint8)
            assert len(data) == repair_grammar.packed_size(n, bits)
            for low, high in ((0, n), (n // 3, n), (1, n // 2), (n, n)):
                assert repair_grammar.unpack_bits(data, low, high, bits).tolist() == values[low : max(low, high)].tolist()


def test_shard_of_text_is_small(spark):
    """Less than the ids as 16-bit numbers, on the whole table."""
    shards = repair_grammar.grammar_tokens(spark.read.parquet(f"{oracle.SF}/documents.parquet"), TOKENIZER)[0]
    ids, size = shards.agg(F.sum("n_ids"), F.sum(F.octet_length("payload"))).first()
    assert size < 2 * ids


@pytest.mark.parametrize("shard_ids", [1 << 20, 7])
def test_op1(spark, docs, shard_ids):
    shards, rows = repair_grammar.grammar_tokens(docs, TOKENIZER, 2, shard_ids)
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    at, expected = 0, []
    for i, t in order:
        ids = encode(t, 2)
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows.collect()), key=lambda x: x[1])
    assert got == expected
    assert repair_grammar.grammar_tokens(docs.limit(0), TOKENIZER)[1].count() == 0


# --- 2: MPEG audio


def test_carrier_and_parser():
    for n in (0, 1, 575, 576, 577, 40_000):
        raw = bytes(k % 251 for k in range(n))
        media = mpeg_audio.write_carrier(mpeg_audio.padded(raw))
        p = mpeg_audio.parse(media)
        assert mpeg_audio.read_carrier(media, p).rstrip(b"\xff") == raw
        assert (p["junk"], p["broken"], p["frames"]) == (0, 0, max(1, -(-n // 576)))
        assert p["table"]["frames"] == p["frames"] and p["duration"] == mpeg_audio.Fraction(576 * p["frames"], 16000)
    assert mpeg_audio.parse(b"")["frames"] == 0


def test_parser_resynchronises():
    media = mpeg_audio.write_carrier(mpeg_audio.padded(b"abc" * 4000))
    whole = mpeg_audio.parse(media)
    at = int(whole["offsets"][5])
    p = mpeg_audio.parse(media[:at] + b"\xff\xf2junk" * 9 + media[at:] + b"TAG" + b"t".ljust(125, b"\0"))
    assert p["frames"] == whole["frames"] and p["junk"] == 54 and p["tags"]["id3v1"]["title"] == "t"
    broken = bytearray(media)
    broken[at + 8] ^= 1  # side information of one frame
    assert mpeg_audio.parse(bytes(broken))["broken"] == 1
    assert mpeg_audio.seek(whole, 576 * 3 + 1) == whole["offsets"][3]


def test_frame_lengths():
    assert mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x64]), 0)["length"] == 417  # MPEG-1 layer 3, 128 kbit/s, 44.1 kHz
    assert mpeg_audio.header(bytes([0xFF, 0xFB, 0x92, 0x64]), 0)["length"] == 418
    assert mpeg_audio.header(bytes([0xFF, 0xFF, 0x10, 0xC4]), 0)["length"] == 32  # layer 1, 32 kbit/s, 44.1 kHz
    for bad in (b"\xff\xfb\xf0\x64", b"\xff\xfb\x9c\x64", b"\xff\xeb\x90\x64", b"\xff"):
        assert mpeg_audio.header(bad, 0) is None


def stream_of(layer, kbits, mode=0xC0, checked=True, seed=0, first=True):
    """Frames of random content with right checksums, each bit of these taken by itself."""
    rng, out = np.random.default_rng(seed), []
    for kbit in kbits:
        b1 = 0xE0 | (0x18 if first else 0x10) | (4 - layer) << 1 | (not checked)
        head = bytes([0xFF, b1, (mpeg_audio.BITRATES[first, layer].index(kbit) + 1) << 4 | (0 if first else 8), mode])
        h = mpeg_audio.header(head, 0)
        body = bytearray(rng.integers(0, 255, h["length"] - 4, dtype=np.uint8).tobytes())
        if checked:
            body[:2] = b"\0\0"
            n = mpeg_audio.layer2_bits(head + bytes(body), 0, h) if layer == 2 else 8 * mpeg_audio.covered(h)
            state = 0xFFFF
            for bit in "".join(f"{x:08b}" for x in head[2:4]) + "".join(f"{x:08b}" for x in body[2:])[:n]:
                state = (state << 1 ^ (0x8005 if (state >> 15) ^ int(bit) else 0)) & 0xFFFF
            body[:2] = state.to_bytes(2, "big")
        out.append(head + bytes(body))
    return out


def test_layers_and_checksums():
    assert [len(mpeg_audio.allocation_widths({"version": v, "kbit": k, "mono": m, "hz": hz})) for v, k, m, hz in (("1", 192, False, 48000), ("1", 192, False, 44100), ("1", 48, True, 32000), ("1", 32, True, 44100), ("2", 64, True, 16000))] == [27, 30, 12, 8, 30]
    for layer, kbits in ((1, (64, 96, 128)), (2, (64, 96, 192)), (3, (64, 128, 96))):
        for mode in (0xC0, 0x00, 0x40, 0x70):
            for first in (True, False):
                if not first and max(kbits) > 160:
                    kbits = tuple(min(k, 160) for k in kbits)
                frames = stream_of(layer, kbits * 5, mode, first=first, seed=mode)
                p = mpeg_audio.parse(b"".join(frames))
                assert (p["frames"], p["checked"], p["broken"], p["unchecked"], p["junk"]) == (15, 15, 0, 0, 0)
                assert p["offsets"].tolist() == list(itertools.accumulate([0] + [len(f) for f in frames[:-1]]))
                assert p["duration"] == sum(mpeg_audio.Fraction(h["samples"], h["hz"]) for h in (mpeg_audio.header(f, 0) for f in frames))
                broken = bytearray(b"".join(frames))
                broken[len(frames[0]) + 7] ^= 0x40  # in the allocation or side information of the second frame
                assert mpeg_audio.parse(bytes(broken))["broken"] == 1


def test_parser_work_follows_the_length(monkeypatch):
    """Bitrates that change every two frames: no header is compared more than a few times."""
    frames = stream_of(3, [64, 64, 96, 96] * 500, checked=False)
    seen = []
    monkeypatch.setattr(mpeg_audio, "_run", lambda view, at, end, size, run=mpeg_audio._run: seen.append(run(view, at, end, size)) or seen[-1])
    assert mpeg_audio.parse(b"".join(frames))["frames"] == 2000 and sum(seen) == 2000
    view = np.frombuffer(b"".join(frames[:1] * 100 + frames[2:]), np.uint8)
    assert mpeg_audio._run(view, 0, len(view), len(frames[0])) == 100


def test_tags_and_tables():
    frames = stream_of(3, [128] * 6, checked=False)
    side = 4 + mpeg_audio.header(frames[0], 0)["side"]
    lame = b"Xing" + (15).to_bytes(4, "big") + (5).to_bytes(4, "big") + (2000).to_bytes(4, "big") + bytes(range(100)) + (57).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    xing = bytearray(frames[0])
    xing[side : side + len(lame)] = lame
    title = "Tïtel".encode("utf-16")
    frame = b"TIT2" + len(b"\1" + title).to_bytes(4, "big") + b"\0\0" + b"\1" + title
    tag = b"ID3\x03\0\0" + bytes([0, 0, len(frame) + 20 >> 7, len(frame) + 20 & 127]) + frame + bytes(20)
    p = mpeg_audio.parse(tag + bytes(xing) + b"".join(frames[1:]))
    assert p["tags"]["id3v2"] == {"version": 3, "frames": {"TIT2": "Tïtel"}} and p["frames"] == 5 and p["junk"] == 0
    assert (p["table"]["frames"], p["table"]["bytes"], p["table"]["quality"], p["table"]["toc"][99]) == (5, 2000, 57, 99)
    assert p["duration"] == mpeg_audio.Fraction(5 * 1152, 44100) and p["played"] == p["duration"] - mpeg_audio.Fraction(1576, 44100)
    vbri = bytearray(frames[0])
    vbri[36 : 36 + 30] = b"VBRI" + bytes(6) + (2100).to_bytes(4, "big") + (5).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + bytes(2) + (7).to_bytes(2, "big") + (9).to_bytes(2, "big")
    p = mpeg_audio.parse(bytes(vbri) + b"".join(frames[1:]))
    assert p["table"] | {"at": 0} == {"kind": "VBRI", "bytes": 2100, "frames": 5, "toc": [21, 27], "at": 0} and p["frames"] == 5
    for n in (1, 3, 40, 417, 500, 900):  # cut anywhere
        assert mpeg_audio.parse((tag + bytes(xing) + b"".join(frames[1:]))[:-n])["frames"] == 5 - -(-n // 417)
    assert mpeg_audio.parse(tag[:30])["frames"] == 0


def test_parse_media_cases(spark):
    media = b"".join(stream_of(2, [64] * 3))
    df = spark.createDataFrame([(1, media, "x", 5), (1, media, "x", 5), (2, None, None, None), (3, b"", "", 0), (4, b"\xff" * 5000, "j", 1)], "id long, media binary, mp_other string, mp_frames int")
    got = sorted(((r.id, r.mp_frames, r.mp_checked, r.mp_junk, r.mp_numerator / r.mp_denominator, r.mp_other) for r in mpeg_audio.parse_media(df).collect()), key=str)
    assert got == [(1, 3, 3, 0, 3 * 1152 / 44100, "x")] * 2 + [(2, 0, 0, 0, 0, None), (3, 0, 0, 0, 0, ""), (4, 0, 0, 5000, 0, "j")]
    assert mpeg_audio.parse_media(df.limit(0)).count() == 0


def test_op2(docs):
    rows = mpeg_audio.text_features(docs).collect()
    expected = []
    for i, t in TEXTS:
        payload = mpeg_audio.padded((t or "").encode())
        expected.append((i, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    key = lambda r: (str(r[0]), r[1:])
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(expected, key=key)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values()) and len({f for v in by.values() for _, f in v}) == len(by)
    media = docs.select("doc_id", F.lit(mpeg_audio.write_carrier(mpeg_audio.padded(b"x"))).alias("media"), F.lit("x").alias("mp_frames"))
    assert mpeg_audio.parse_media(media.unionByName(media.limit(1).withColumn("media", F.lit(None).cast("binary")))).select("mp_frames").distinct().count() == 2
    assert mpeg_audio.text_features(docs.limit(0)).count() == 0


# --- 3 and 7: classifiers


def test_op3_learns_and_covers_cases(spark, docs):
    rng = np.random.default_rng(2)
    good, bad = ["walking", "along", "the", "river"], ["b$$$", "c###", "BUY!!", "d%%%"]
    rows = [(k, " ".join(rng.choice(bad if k % 4 == 0 else good, 30)), int(k % 4 != 0)) for k in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = subword_quality.fit(train.drop("quality"), train.select("doc_id", "quality", F.lit(1).alias("text")))
    held = {r.doc_id: r for r in subword_quality.score_documents(train, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in held.items())
    assert np.mean([held[i].predicted == q for i, _, q in rows]) > 0.97
    got = subword_quality.score_documents(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = subword_quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in subword_quality.score_documents(docs, none).collect()} == {0.5}
    assert subword_quality.score_documents(docs.limit(0), none).count() == 0


def quality_model(texts, labels):
    return subword_quality.train(list(subword_quality.bags(pa.array(texts))), labels)


def test_scores_do_not_depend_on_turns():
    m = quality_model(["a b c", "d e f"] * 20, [0, 1] * 20)
    col = pa.array(["a b c" * 50, None, "", "f e", "q " * 400])
    assert np.allclose(m.score(col), m.score(col, limit=10))


def test_scores_equal_a_loop():
    """The forward pass, and the parts that training sees, one word at a time."""
    texts = ["Good words and more words", None, "", "one", "ab ab ab\nab\tcd", "é ü! x" * 9]
    m = quality_model([t or "" for t in texts], [1, 0, 1, 0, 1, 0])
    parts, count, hashes = subword_quality.word_parts(words := sorted({w for t in texts for w in (t or "").split()}))
    ends = np.cumsum(count)
    of = {w: parts[e - n : e] for w, e, n in zip(words, ends, count, strict=True)}
    name = dict(zip(words, hashes, strict=True))
    assert all(len(of[w]) == 1 + sum(max(0, len(w) + 3 - n) for n in (2, 3, 4)) for w in words)
    for t, bag, p in zip(texts, subword_quality.bags(pa.array(texts)), m.score(pa.array(texts)), strict=True):
        w = (t or "").split()
        mine = collections.Counter(int(x) for v in w for x in of[v])
        with np.errstate(over="ignore"):
            two = collections.Counter([int(common.mix64((name[a] * np.uint64(0x9E3779B97F4A7C15) + name[b]).reshape(1))[0] % np.uint64(subword_quality.BUCKETS)) for a, b in itertools.pairwise(w)] + [subword_quality.END])
        mean = np.zeros(2 * subword_quality.DIMENSION)
        for s, counted in enumerate((mine, two)):
            for k, n in counted.items():
                mean[s * subword_quality.DIMENSION :][: subword_quality.DIMENSION] += m.vectors[s][k] * n / sum(counted.values())
            assert dict(zip(bag[2 * s].tolist(), bag[2 * s + 1].tolist(), strict=True)) == pytest.approx({k: n / sum(counted.values()) for k, n in counted.items()})
        x = (np.concatenate([mean, mean**2]) - m.middle) / m.spread
        z = np.exp(np.clip(x, -subword_quality.FURTHEST, subword_quality.FURTHEST) @ m.out + m.bias)
        assert np.allclose(p, z / z.sum(), atol=1e-4)


def test_op3_bounds_and_contradictions(spark):
    rows = [(k, f"w{k} " * (1 + k % 5), k % 2) for k in range(60)]
    df = spark.createDataFrame(rows + [(1, "again", 0), (1, "again", 0)], "doc_id long, text string, quality int")
    for most, parts in ((5000, 10**6), (10, 10**6), (5000, 50)):
        m = subword_quality.fit(df.drop("quality"), df.drop("text"), most=most, most_parts=parts)
        assert m.classes == [0, 1] and subword_quality.score_documents(df, m).count() == len(rows) + 2


def test_op7_learns_and_covers_cases(spark, docs):
    rng = np.random.default_rng(3)
    vocabulary = {"aa": ["kolo", "mura", "tala"], "bb": ["strenght", "xylz", "quorp"], "cc": ["ééà", "çuîs", "ôûê"]}
    rows = [(k, " ".join(rng.choice(vocabulary[v], int(rng.integers(3, 120)))), v) for k, v in enumerate(list(vocabulary) * 60)]
    table = spark.createDataFrame(rows + [(900, "12 34", "aa"), (901, None, "bb"), (902, "kolo", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lang_cnn.language_report(table).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert np.mean([got[k].lang_pred == v for k, _, v in rows]) > 0.98
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred in vocabulary
    net = lang_cnn.fit(table)
    assert lang_cnn.identify(docs, net).count() == len(TEXTS)
    found = lang_cnn.identify(docs, net).collect()
    for least in (0.0, 0.5, 0.999, 1.1):  # null and empty go, and what the network finds in no language
        kept = lang_cnn.keep_identified(docs, net, least)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.lang_pred != "und" and r.score >= least)
    assert lang_cnn.keep_identified(docs, net, 0.0).count() == len(TEXTS) - 2
    assert lang_cnn.keep_identified(docs, net, 1.1).count() == 0
    assert {r.lang_pred for r in lang_cnn.identify(docs, lang_cnn.fit(docs.limit(0))).collect()} == {"und"}


def network(texts, labels):
    return lang_cnn.train(list(lang_cnn.draw(pa.array(texts))), labels)


def test_prediction_does_not_depend_on_turns():
    net = network(["abc def " * 40, "xyz uvw " * 40] * 8, ["p", "q"] * 8)
    col = pa.array(["abc " * 900, None, "", "xyz", "1", "uvw abc " * 300, "é" * 700])
    a, b = lang_cnn.predict(net, col), lang_cnn.predict(net, col, limit=600)
    assert a[0] == b[0] and np.allclose(a[1], b[1], atol=1e-6)


def test_prediction_equals_a_loop():
    """Convolution, pooling and softmax, one window and one place at a time."""
    net = network(["abc def " * 40, "xyz uvw " * 40, "ééé"] * 8, ["p", "q", "r"] * 8)
    for text in ("abc " * 150, "x", "uvw é abc 12 " * 30, "z" * 256, "z" * 257):
        raw, reach = text.encode(), max(lang_cnn.WIDTHS)
        total = np.zeros(3)
        for start in range(0, len(raw), lang_cnn.WINDOW):
            own = (raw[start : start + lang_cnn.WINDOW + reach - 1]).ljust(lang_cnn.WINDOW + reach - 1, b"\0")
            pooled = [max(sum(net.taps[j, own[t + j], f] for j in range(reach)) for t in range(lang_cnn.WINDOW)) for f in range(len(net.bias))]
            total += min(lang_cnn.WINDOW, len(raw) - start) * (np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias)
        p = np.exp(total / len(raw) - (total / len(raw)).max())
        names, score = lang_cnn.predict(net, pa.array([text]))
        assert names == [net.languages[int(p.argmax())]] and score[0] == pytest.approx(p.max() / p.sum(), abs=1e-5)
    narrow = net.taps.reshape(reach, 256, len(lang_cnn.WIDTHS), -1)
    assert all((narrow[w:, :, k] == 0).all() and (narrow[:w, :, k] != 0).any() for k, w in enumerate(lang_cnn.WIDTHS))


def test_windows_are_drawn_from_whole_texts():
    raw = bytes(65 + k // 256 % 26 for k in range(256 * 200 + 9)).decode()
    few, all_, none = lang_cnn.draw(pa.array([raw, raw[:1000], None]), most=20)
    assert few.shape == (20, 260) and all_.shape == (4, 260) and none.shape == (0, 260)
    assert len({bytes(w) for w in few}) > 10 and max(raw.encode().find(bytes(w[:256])) for w in few) > 256 * 20
    assert bytes(all_[3]).rstrip(b"\0") == raw[768:1000].encode() and bytes(all_[0]) == raw[:260].encode()


# --- 4: near duplicates


def brute_groups(rows, width, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def near_rows():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(900)]
    base = rng.choice(vocabulary, 120).tolist()
    rows, chain = [], list(base)
    for k in range(60):  # a chain of edits: neighbours are near, ends are not
        chain[int(rng.integers(0, 120))] = str(rng.choice(vocabulary))
        rows.append((k, " ".join(chain)))
    rows += [(100 + k, " ".join(base[:60] + rng.choice(vocabulary, 25).tolist())) for k in range(25)]  # a shared passage
    rows += [(200 + k, "One TWO three") for k in range(5)] + [(300, "one two"), (301, None), (302, ""), (303, " \n"), (304, "five words are in here"), (305, "five words are in here now")]
    return rows + [(k, t) for k, t in rows[:3]] + [(None, rows[0][1])]


@pytest.mark.parametrize("width", [4, 5])
def test_op4_equals_brute_force(spark, width):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit("x"), "sketch": F.lit(1), "n": F.lit(2)})
    out = setsketch.near_duplicates(df, width, 80)
    got = out.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(rows, width, 80)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_op4_empty_and_stage(spark, docs):
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0
    left = setsketch.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(TEXTS) - 1  # 7 is 5's copy


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Cells of few rows give the same groups."""
    small = setsketch._cells
    monkeypatch.setattr(setsketch, "_cells", lambda live: small(live, rows=5, shingles=1000))
    rows = [r for r in near_rows() if r[0] is not None]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(rows, 4, 80)


def test_classes_that_share_half_a_hash(spark):
    """Equal sets are told by both halves, and their numbers are different."""
    few = spark.createDataFrame([(1, 5), (1, 9), (1, 7), (50, 1)], "h1 long, h2 long")
    assert {(r.h1, r.h2): r.rep for r in setsketch.numbered(few).collect()} == {(1, 5): 1, (1, 7): 2, (1, 9): 3, (50, 1): 50}


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        pool = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
        common_part = int(len(pool) * share)
        a, b = pool[: common_part + (len(pool) - common_part) // 2], np.concatenate([pool[:common_part], pool[common_part + (len(pool) - common_part) // 2 :]])
        x, y = setsketch.registers([a, b])
        est = setsketch.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(est - share) < 0.16
        assert (setsketch.merge(x, y) == setsketch.registers([pool])[0]).all()
    big = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    assert (setsketch.registers([big], limit=64) == setsketch.registers([big])).all()


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 40)] + [tuple(map(int, p)) for p in rng.integers(2000, 2100, (60, 2))]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.comp for r in setsketch.components(df, common.Scratch(spark, "t")).collect()}
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_components_of_few_edges_take_one_table(spark):
    rng = np.random.default_rng(7)
    chain = rng.permutation(3000) * 5 - 4000
    edges = [*zip(chain[:-1].tolist(), chain[1:].tolist(), strict=True), *((-9000, int(k)) for k in rng.integers(20000, 20300, 500)), (70000, 70000), (-(2**63), 2**63 - 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    one, many = common.Scratch(spark, "t"), common.Scratch(spark, "t")
    got = sorted(map(tuple, setsketch.components(df, one).collect()))
    assert one.n == 1  # rounds write four tables each
    assert got == sorted(map(tuple, setsketch.components(df, many, few=len(edges) // 2).collect()))
    assert many.n > 1
    assert got == sorted([*((int(k), -4000) for k in chain), *((k, -9000) for k in {-9000, *(b for a, b in edges if a == -9000)}), (-(2**63), -(2**63)), (2**63 - 1, -(2**63))])
    assert setsketch.components(df.where("a = b"), one).collect() == []


# --- 5: decontamination


def brute_hits(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [(i, {tuple(w[k : k + min(window, len(w))]) for k in range(max(1, len(w) - window + 1))}) for i, t in items if i is not None and (w := words(t))]
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, own in grams:
            for g in own:
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        hit |= set(range(k, k + len(g)))
                        found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("pass_bytes", "block_words"), [(1 << 20, 1 << 20), (60, 40)])
def test_op5_equals_brute_force(spark, pass_bytes, block_words):
    rng = np.random.default_rng(7)
    word = lambda n: " ".join(rng.choice(list("abcdefgh"), n))
    items = [(1, word(25)), (2, "Zebra, QUAGGA 12"), (2, "other é words"), (3, None), (4, "!!"), (None, "a b c"), (10, word(11)), (5, "a a a a a a a a a a a")]
    rows = [(k, word(60)) for k in range(20)] + [(50, "x " + items[0][1].upper() + " y"), (51, "zebra-quagga_12 zebra quagga 12"), (52, None), (53, ""), (54, "a " * 30), (54, "a " * 30), (55, items[6][1] + " " + items[0][1]), (None, "OTHER É words"), (56, "other\né\nwords")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1))
    out = phrase_index.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), 10, block_words, pass_bytes)
    assert sorted([tuple(r)[:6] for r in out.collect()], key=str) == brute_hits(rows, items)


def test_phrases_in_few_places_at_once():
    rng = np.random.default_rng(17)
    texts = [" ".join(rng.choice(list("abcde"), int(rng.integers(0, 60)))) for _ in range(40)]
    items = [(k % 9, t) for k, t in enumerate(texts[::4])] + [(50, "a"), (51, "e d c"), (None, "a b")]
    held = [(terms, bounds) for _, terms, bounds in phrase_index.text_terms(pa.array(texts))]
    terms, bounds = held[0]
    ranked, lists, places = phrase_index.invert(terms)
    block = phrase_index.Block(*(x.astype(k).tobytes() for x, k in zip((bounds, ranked, lists, places), ("<i8", "<u8", "<i8", "<i4"), strict=True)))
    expected = {r[0]: r[2:4] for r in brute_hits(list(enumerate(texts)), items)}
    for at_once in (1 << 20, 200, 80):
        hit, found = phrase_index.Phrases(items).search(block, at_once)
        assert {k: (int(hit[bounds[k] : bounds[k + 1]].sum()), len(found[k])) for k in range(len(texts))} == expected


def test_proximity_equals_brute_force(spark):
    rng = np.random.default_rng(18)
    rows = [(k, " ".join(rng.choice(list("abcdefg"), 40, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05]))) for k in range(12)]
    index = phrase_index.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), common.Scratch(spark, "t"), block_words=1 << 20)
    phrases, every = ["g a", "f g", "e d c", "a", "z a"], collections.Counter(w for _, t in rows for w in t.split())
    for reach in (0, 1, 3, 50):
        got = {(r.doc_id, r.phrase, r.place) for r in phrase_index.proximity(index, phrases, reach).collect()}
        expected = set()
        for k, p in enumerate(phrases):
            own = sorted(set(p.split()))
            if all(every[w] for w in own):
                least = min(every[w] for w in own)
                rare = [w for w in own if every[w] == least]
                assert len(rare) == 1
                for i, t in rows:
                    w = t.split()
                    expected |= {(i, k, at) for at, x in enumerate(w) if x == rare[0] and set(own) <= set(w[max(0, at - reach) : at + reach + 1])}
        assert got == expected


def test_op5_cases(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in phrase_index.contamination(docs, none).collect())
    some = spark.createDataFrame([(1, "hello world")], "item_id long, text string")
    assert phrase_index.contamination(docs.limit(0), some).count() == 0
    left = phrase_index.drop_contaminated(docs, some)
    assert left.columns == docs.columns and left.count() == len(TEXTS) - 1
    index = phrase_index.build_index(docs, common.Scratch(spark, "t"))
    near = phrase_index.proximity(index, ["again hello", "hello fine", "absent"], 2).collect()
    assert {(r.doc_id, r.phrase, r.place) for r in near} == {(1, 0, 3)}


# --- 6: wrappers

PAGE = "<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul>{nav}</ul></nav><div class='ad'>buy</div><article><h1>{t}</h1>{body}</article><footer>&copy; x</footer></body></html>"


def page(k):
    body = "".join(f"<p>para {k} {n} a &amp; b\n  <b>c</b></p>" for n in range(1 + k % 4))
    return PAGE.format(t=f"Title {k}", nav="".join(f"<li><a href='/{n}'>n{n}</a></li>" for n in range(2 + k % 3)), body=body), "\n".join([f"Title {k}"] + [f"para {k} {n} a & b c" for n in range(1 + k % 4)])


def test_op6(spark):
    rows = [(k, f"http://h{k % 3}.org/{k}", page(k)[0]) for k in range(30)] + [(90, None, None), (91, "http://h0.org/x", ""), (92, "no url", "just <b>text</b>"), (1, "http://h1.org/1", page(1)[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "wrapper": F.lit("x")})
    for limit in (1 << 20, 0):  # wrappers to every task, or joined by host
        got = {r.page_id: r for r in wrapper_html.extract(df, broadcast_bytes=limit).collect()}
        assert all(got[k].text == page(k)[1] and got[k].n_chars == len(page(k)[1]) and got[k].by_wrapper for k in range(30))
        assert (got[90].text, got[91].text, got[92].text) == ("", "", "just text")
    assert wrapper_html.extract(df.limit(0)).count() == 0


def test_wrapper_groups():
    w = wrapper_html.infer([page(k)[0] for k in range(6)])
    assert "(<li><a>#TEXT</a></li>)+" in w["expression"] and w["content"] == ["article", 0]
    one = "<html><body><div class='x'><h2>{0}</h2>{1}<p>{0} long enough text</p><div class='comments'>nice</div></div></body></html>"
    w = wrapper_html.infer([one.format("a", ""), one.format("b", "<em>new</em>"), one.format("c", "")])
    assert "(<em>new</em>)?" in w["expression"]
    assert wrapper_html.apply(w, one.format("q", ""))[0] == "q\nq long enough text"
    for odd in ("<<<>>> & <", "<p>open <b>never", "<!-- x", "<script>x", "</div></p>t", html.escape("<p>")):
        wrapper_html.apply(w, odd)


def test_wrapper_weighs_what_differs():
    legal = "<div class='imprint'>" + "".join(f"<p>Fixed clause {n} of the imprint that every page has word for word.</p>" for n in range(20)) + "</div>"
    apart = "<html><body><div class='outer'><div class='text'><p>{0} is short.</p></div>" + legal + "</div></body></html>"
    w = wrapper_html.infer([apart.format(x) for x in ("One", "Two", "Three")])
    assert w["content"] == ["div.text", 0] and wrapper_html.apply(w, apart.format("Four"))[0] == "Four is short."
    inside = "<html><body><div class='text'><p>{0} is short.</p>" + legal + "<p>Last of {0}.</p></div></body></html>"
    w = wrapper_html.infer([inside.format(x) for x in ("One", "Two", "Three")])
    assert wrapper_html.apply(w, inside.format("Four"))[0] == "Four is short.\nLast of Four."
    w = wrapper_html.infer([inside.format("One")] * 2)  # nothing differs, nothing is left out
    assert wrapper_html.apply(w, inside.format("One"))[0].count("clause") == 20


def test_long_streams_are_aligned_whole():
    inline = ("<b>{0}</b>", "<i>{0}</i>", "<a href='/'>{0}</a>", "<em>{0}</em>", "<code>{0}</code>")
    part = lambda k, n: "<p>" + "".join(f"w{k} " + inline[(n * (k + 1) // 5**d) % 5].format(n) for d in range(4)) + "</p>"
    long = lambda k, size: f"<html><body><div class='lead'>{part(k, k)}</div><div class='text'>" + "".join(part(k, n) for n in range(size)) + f"</div><div class='end'><p>end of {k}</p></div></body></html>"
    streams = [wrapper_html.fold(wrapper_html.stream(wrapper_html.Page(long(k, 150)))) for k in range(2)]
    assert min(map(len, streams)) > 400
    w = wrapper_html.infer([long(k, 150) for k in range(3)])
    assert w["content"] == ["div.text", 0] and w["expression"].endswith("<div.end><p>#TEXT</p></div></body></html>")
    text, by_wrapper = wrapper_html.apply(w, long(7, 150))
    assert by_wrapper and text.count("\n") == 149
    whole = wrapper_html._steps(*streams)
    blocks = wrapper_html._steps(*streams, step_bytes=5000)
    assert all(whole(i, j) == blocks(i, j) for i in range(len(streams[0])) for j in range(0, len(streams[1]), 7))


def test_each_template_has_its_place(spark):
    one = "<html><body><div class='text'><p>Story {0} of the host, told at some length.</p></div><div class='more'><p>Read on: {0}</p></div></body></html>"
    two = "<html><body><div class='text'><p>Menu</p></div><div class='recipe'><p>Recipe {0}: stir it {0} times and let it rest.</p></div></body></html>"
    rows = [(k, f"http://h.org/{k}", one.format(k)) for k in range(120)] + [(1000 + k, f"http://h.org/r{k}", two.format(k)) for k in range(4)]
    rows += [(2000 + k, "http://h.org/same", one.format("again")) for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in wrapper_html.extract(df.repartition(7)).collect()}
    assert len(got) == len(rows) and all(r.by_wrapper for r in got.values())
    assert all(got[k].text == f"Story {k} of the host, told at some length." for k in range(120))
    assert all(got[1000 + k].text == f"Recipe {k}: stir it {k} times and let it rest." for k in range(4))
    hosted = df.withColumn("host", F.lit("h.org"))
    found = [{r.template: json.loads(r.wrapper) for r in wrapper_html.infer_wrappers(hosted.repartition(n), fan_in).collect()} for n, fan_in in ((1, 16), (5, 16), (5, 2))]
    assert sorted(w["pages"] for w in found[0].values()) == [4, 121]
    assert found[0] == found[1] and [w["content"] for _, w in sorted(found[2].items())] == [w["content"] for _, w in sorted(found[0].items())]


class Article(HTMLParser):
    """Brute force for the driver's pages, which have one article each: its blocks."""

    def __init__(self, source):
        super().__init__()
        self.on, self.part, self.blocks = False, [], []
        self.feed(source)
        self.close()
        self.end()

    def end(self):
        text = re.sub(r"\s+", " ", "".join(self.part)).strip()
        self.blocks += [text] * bool(text)
        self.part = []

    def handle_starttag(self, tag, attrs):
        self.on = self.on or tag == "article"
        if tag in ("p", "h1"):
            self.end()
        elif tag == "br":
            self.part.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.end()
        self.on = self.on and tag != "article"

    def handle_data(self, data):
        if self.on:
            self.part.append(data)


def nameless(source):
    for tag, name in (("nav", "x1"), ("article", "x2"), ("footer", "x3")):
        source = source.replace(f"<{tag}>", f'<div class="{name}">').replace(f"</{tag}>", "</div>")
    return source.replace('class="ad"', 'class="x4"')


def test_op6_equals_brute_force_on_the_table(spark, monkeypatch):
    """The whole ``pages`` table: as it is, without the list of names, and with meaningless tags and names."""
    pages = spark.read.parquet(f"{oracle.SF}/pages.parquet")
    rows = pages.collect()
    expected = {r.page_id: "\n".join(Article(r.html or "").blocks) for r in rows}
    assert {r.page_id: r.text for r in wrapper_html.extract(pages).collect()} == expected
    monkeypatch.setattr(wrapper_html, "ASIDE_NAMES", set())
    monkeypatch.setattr(wrapper_html, "_SEEN", {})
    hosts = collections.defaultdict(list)
    for r in rows:
        hosts[re.match("[a-z]+://([^/]+)", r.url).group(1)].append(r)
    for own in hosts.values():
        for change in (str, nameless):
            if change is nameless and len(own) < 3:  # too few pages to tell what differs
                continue
            by = collections.defaultdict(list)
            for r in own:
                by[wrapper_html.Page(change(r.html)).template()].append(r)
            for some in by.values():
                w = wrapper_html.infer([change(r.html) for r in some])
                assert all(wrapper_html.apply(w, change(r.html)) == (expected[r.page_id], True) for r in some)


def test_names_are_hints():
    body = "<h1>On {0}</h1><p>First words of {0}.</p><section id='related-work'><h2>Related work</h2><p>Others on {0}.</p></section><p class='alert-level'>Level {0}</p><div class='social-history'><p>History of {0}.</p></div>"
    odd = "<div class='notice'>Cookies and {0}</div><ol class='comment-list'><li><b>Ann</b><p>I like {0}</p></li><li><b>Bob</b><p>{0} again</p></li></ol><ul class='k9'><li><a href='1'>a {0}</a></li><li><a href='2'>b {0}</a></li></ul>"
    pages = ["<html><body><div class='x1'>Menu</div><article>" + (body + odd).format(x) + "</article><div class='x3'>(c) us</div></body></html>" for x in ("ants", "bees", "cats", "dogs")]
    w = wrapper_html.infer(pages[:3])
    assert wrapper_html.apply(w, pages[3])[0] == "On dogs\nFirst words of dogs.\nRelated work\nOthers on dogs.\nLevel dogs\nHistory of dogs."
    whole = "<html><body><div class='comments'><p>All of the text about {0} is in here.</p></div></body></html>"
    w = wrapper_html.infer([whole.format(x) for x in ("ants", "bees", "cats")])  # a name can't do away with the content
    assert wrapper_html.apply(w, whole.format("dogs"))[0] == "All of the text about dogs is in here."


def test_wrapper_without_names_or_tags():
    one = "<html><body><div class='x1'><a href='/'>Home</a> Our menu</div><div class='x2'><h2>{0}</h2>{1}</div><div class='x3'>Copyright, all rights reserved, terms of use.</div></body></html>"
    pages = [one.format(k, "".join(f"<p>Part {n} of {k}.</p>" for n in range(1 + k % 3))) for k in range(6)]
    w = wrapper_html.infer(pages)
    assert w["content"] == ["div.x2", 0] and wrapper_html.apply(w, pages[5])[0] == "5\nPart 0 of 5.\nPart 1 of 5.\nPart 2 of 5."


def test_repeated_articles_stay_together():
    item = "<article><h2>{0}</h2><p>News of {0} and {1}.</p></article>"
    pages = ["<html><body><div class='all'>" + item.format(k, 1) + item.format(k, 2) + "</div></body></html>" for k in "abcd"]
    w = wrapper_html.infer(pages)
    assert wrapper_html.apply(w, pages[0])[0] == "a\nNews of a and 1.\na\nNews of a and 2."


def test_raw_elements():
    w = lambda x: wrapper_html.apply(None, f"<html><body><p>One two three.</p>{x}<p>Four five six.</p></body></html>")[0]
    assert w("<p><math><mi>x</mi></math> <object>fallback</object></p>") == "One two three.\nx fallback\nFour five six."
    assert w("<svg><title>icon</title></svg><select><option>o</select><noscript>n</noscript>") == "One two three.\nFour five six."
    assert w("<svg><canvas><math>") == "One two three.\nFour five six."
    assert w("<script>") == "One two three."


# --- 8 and 9: native operators


def test_op8_equals_brute_force(spark):
    rows = [(3, "Shared line here\nown\n shared LINE here \t\nend"), (1, "shared line here\n\nshared line here"), (2, None), (4, ""), (5, "Shared line here"), (6, "short\nshort"), (7, "short"), (5, "Shared line here"), (None, "shared line here"), (8, "a\r\nShared line here\r\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit(1), "first": F.lit(2), "key": F.lit(3), "n_chars": F.lit(0)})
    holders = collections.defaultdict(set)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n") if i is not None else ():
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    expected, texts = [], []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 2 or i == min(holders[key(x)])]
        expected.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
        texts.append((i, "\n".join(kept)))
    assert sorted([tuple(r) for r in line_dedup.line_report(df).collect()], key=str) == sorted(expected, key=str)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted(texts, key=str)
    three = line_dedup.line_report(df.where("doc_id < 4"), least_docs=3).collect()
    assert all(r.n_dropped == 0 for r in three)
    assert line_dedup.line_report(df.limit(0)).count() == 0


def test_op9(spark, docs):
    equal = {s: 1.0 for s in range(8)}
    many = docs.select("doc_id", "text").unionByName(spark.range(100, 4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).withColumns({"part": F.lit(1), "slot": F.lit(2)})
    rows = rendezvous.assign(many, equal, grown=equal | {8: 1.0}).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == len(TEXTS) + 3900
    assert 0.08 < np.mean([r.grown_shard == 8 for r in rows]) < 0.14
    heavy = rendezvous.assign(many, {0: 3.0, 1: 1.0}).collect()
    assert 0.72 < np.mean([r.shard == 0 for r in heavy]) < 0.78
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert rendezvous.assign(docs.limit(0), equal).count() == 0
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    hot = rendezvous.assign(same, equal).collect()  # one key: one shard, numbered in many groups
    assert len({r.shard for r in hot}) == 1 and sorted(r.slot for r in hot) == list(range(3000))
    with pytest.raises(ValueError):
        rendezvous.shard_of(F.lit("x"), {0: 0.0})


# --- 10: packing


def check_pieces(rows, texts, limits):
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append(r)
        by[(r.doc_id, r.doc_tokens)].append(r)
    for v in seq.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == list(itertools.accumulate([0] + [r.length for r in v[:-1]]))
        assert sum(r.length for r in v) <= limits.tokens and len(v) <= limits.segments and sum(r.loss_tokens for r in v) <= limits.loss
    total = 0
    for (i, n), v in by.items():
        ids = next(encode(t, 1) for j, t in texts if j == i)
        total += len(v)
        assert n == len(ids)
        for r in v:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    return seq


def test_op10(docs):
    limits = vector_packing.Limits()
    rows = vector_packing.pack_documents(docs.coalesce(1), TOKENIZER).collect()
    seq = check_pieces(rows, TEXTS, limits)
    want = sum(len(encode(t, 1)) for _, t in TEXTS)
    assert sum(r.length for r in rows) == want and len(seq) <= -(-want // 2048) + 1
    assert all(v[0].padded in (2048, sum(r.length for r in v)) for v in seq.values())
    ids = vector_packing.pack_documents(docs, TOKENIZER, with_ids=True).where("doc_id = 1").first()
    assert ids.ids == encode(TEXTS[0][1], 1)
    assert vector_packing.pack_documents(docs.limit(0), TOKENIZER).count() == 0


def test_instruction_data_meets_three_limits(spark):
    """The whole ``conversations`` table, prompts without loss, with odd turns added; each limit binds somewhere."""
    turns = spark.read.parquet(f"{oracle.SF}/conversations.parquet")
    odd = spark.createDataFrame([(9000, 5, "assistant", "alone"), (9001, 0, "user", None), (9001, 1, "assistant", None), (None, 1, "assistant", "x"), (9002, 3, "user", "b"), (9002, 3, "user", "a"), (9002, 4, "assistant", "reply")], "conv_id long, turn long, role string, text string")
    turns = turns.unionByName(odd).withColumn("prompt", F.lit(1))
    by = {(r.conv_id, r.turn): r for r in turns.where("conv_id < 9002").collect()}
    texts, free = {}, {}
    for (conv, turn), r in by.items():
        if r.role == "assistant":
            before = by.get((conv, turn - 1))
            prompt = (before.text or "") if before and before.role != "assistant" else ""
            texts[conv * (1 << 20) + turn], free[conv * (1 << 20) + turn] = (prompt + "\n" if prompt else "") + (r.text or ""), len(encode(prompt, 0)) - 1
    texts[9002 * (1 << 20) + 4], free[9002 * (1 << 20) + 4] = "b\nreply", len(encode("b", 0)) - 1
    limits = vector_packing.Limits(900, 3, 700)
    rows = vector_packing.pack_conversations(turns.coalesce(1), TOKENIZER, limits).collect()
    assert {r.doc_id for r in rows} == set(texts)
    seq = check_pieces(rows, list(texts.items()), limits)
    assert sum(r.length for r in rows) == sum(len(encode(t, 1)) for t in texts.values())
    assert sum(r.loss_tokens for r in rows) == sum(len(encode(t, 1)) - free[i] for i, t in texts.items())
    assert any(len(v) == 3 for v in seq.values()) and any(sum(r.loss_tokens for r in v) == 700 for v in seq.values()) and any(sum(r.length for r in v) == 900 for v in seq.values())
    assert vector_packing.pack_conversations(turns.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("limits", [vector_packing.Limits(), vector_packing.Limits(256, 4, 150), vector_packing.Limits(64, 1, 64)])
def test_packer_limits(limits):
    rng = np.random.default_rng(8)
    packer, rows, docs = vector_packing.Packer(limits, window=100), [], {}
    for i in range(700):
        docs[i] = rng.integers(0, 49000, int(rng.lognormal(4, 1.3)) + 1).astype(np.uint32)
        rows += packer.add(i, docs[i], len(docs[i]) // 2 if i % 2 else 0)
    rows += packer.flush()
    got, seq = collections.defaultdict(list), collections.defaultdict(list)
    for d, start, ids, _, q, offset, loss in rows:
        got[d].append((start, ids))
        seq[q].append((offset, len(ids), loss))
    for i, ids in docs.items():
        parts = sorted(got[i], key=lambda x: x[0])
        assert (np.concatenate([p for _, p in parts]) == ids).all()
    for v in seq.values():
        assert sum(n for _, n, _ in v) <= limits.tokens and len(v) <= limits.segments and sum(b for _, _, b in v) <= limits.loss
    if limits == vector_packing.Limits():
        assert sum(map(len, docs.values())) > 0.97 * limits.tokens * len(seq)
