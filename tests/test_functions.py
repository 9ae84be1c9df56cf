import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import chunker, codec, parity, text


def lengths(*args):
    return np.diff(np.concatenate([[0], chunker.boundaries(*args)])).tolist()


def test_chunker_vectors():
    assert lengths(b"", 1024, 4096, 8192) == []
    assert lengths(bytes(512), 1024, 4096, 8192) == [512]
    assert lengths(b"\xab" * 600, 64, 128, 256) == [64] * 9 + [24]
    assert lengths(bytes(600), 64, 128, 256) == [256, 256, 88]
    assert [chunker.mask_for(t) + 1 for t in (524288, 4096, 513, 500)] == [262144, 2048, 512, 256]


def test_chunker_equals_plain_loop():
    data = np.random.default_rng(3).integers(0, 256, 40_000).astype(np.uint8).tobytes()
    for sizes in ((64, 512, 4096), (32, 33, 100), (256, 1024, 2048)):
        assert (chunker.boundaries(data, *sizes) == chunker._slow_boundaries(data, *sizes)).all()
    assert sum(lengths(data, 8, 64, 128)) == len(data)
    with pytest.raises(ValueError):
        chunker.boundaries(data, 100, 50, 200)


def test_chunks_move_with_content():
    data = np.random.default_rng(4).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    cut = lambda d: {d[b - n : b] for b, n in zip(chunker.boundaries(d, 256, 1024, 4096), lengths(d, 256, 1024, 4096), strict=True)}
    assert len(cut(data) & cut(b"new head" + data)) > 0.8 * len(cut(data))


def test_zstd_frames():
    for level in (1, 3, 22):
        assert codec.unframe(codec.frame(b"text " * 50, level)) == b"text " * 50
    assert codec.unframe(codec.frame(b"")) == b""
    for bad in (b"abc", (1 << 30).to_bytes(4, "little") + b"x"):
        with pytest.raises(ValueError):
            codec.unframe(bad)
    with pytest.raises(ValueError):
        codec.frame(b"x", 23)


def test_envelope(spark):
    key = F.lit(bytes(32))
    df = spark.createDataFrame([(b"",), (b"secret",)], "raw binary")
    sealed = df.withColumn("e", codec.encrypt(F.col("raw"), key, F.lit(bytes(12))))
    rows = sealed.select("raw", F.hex("e").alias("h"), codec.decrypt(F.col("e"), key).alias("back"), codec.decrypt(F.concat(F.col("e"), F.lit(b"x")), key).alias("bad"), codec.decrypt(F.lit(b"abc"), key).alias("short")).collect()
    assert rows[0].h == "0C000000" + "00" * 12 + "530F8AFBC74536B9A963B4F1C4CB738B"
    assert all(bytes(r.back) == bytes(r.raw) and r.bad is None and r.short is None for r in rows)


def test_key_file():
    stored = codec.new_key_file("right", bytes(32))
    assert codec.open_key_file(stored, "right") == codec.derive_key("right", bytes(32))
    with pytest.raises(ValueError):
        codec.open_key_file(stored, "wrong")
    with pytest.raises(ValueError):
        codec.new_key_file("x", b"short")


def test_field():
    for a in range(256):
        for b in range(0, 256, 7):
            assert parity.mul(a, b) == parity.mul(b, a)
        if a:
            assert parity.mul(a, parity.inv(a)) == 1
    with pytest.raises(ZeroDivisionError):
        parity.inv(0)


@pytest.mark.parametrize("lost", [[0, 51], [0, 51, 65, 66, 67, 68], [1, 2, 3, 4, 5, 6, 7, 8], [64, 71], []])
def test_parity_patterns(lost):
    data = np.random.default_rng(5).integers(0, 256, (64, 33)).astype(np.uint8)
    every = [*map(bytes, data), *map(bytes, parity.encode(data, 8))]
    assert parity.reconstruct([None if k in lost else s for k, s in enumerate(every)], 64, 8) == [bytes(s) for s in data]


def test_parity_limits():
    with pytest.raises(ValueError):
        parity.reconstruct([None, None, b"a", b"b"], 3, 1)
    with pytest.raises(ValueError):
        parity.matrix(200, 57)


def test_text_functions(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1703936,), (5 << 40,)], "n long")
    assert [r[0] for r in df.select(text.format_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.00 KB", "1.62 MB", "5.00 TB"]
    urls = spark.createDataFrame([("/data/x",), ("s3://bucket/a/b",), ("s3://bucket",), ("sftp://h:2222/p",), ("sftp://h/p",), ("webdav://h/p",), ("ftp://h/p",), ("",), (None,)], "u string")
    got = [tuple(r[0]) for r in urls.select(text.parse_backend_url(F.col("u"))).collect()]
    assert [g[0] for g in got] == ["file", "s3", "s3", "sftp", "sftp", "webdav", None, None, None]
    assert [g[2] for g in got][3:5] == [2222, 22] and got[1][3] == "a/b" and got[2][3] == ""
    names = spark.createDataFrame([("a b/c.txt",), ("..",), ("",), ("é-1_",)], "n string")
    assert [r[0] for r in names.select(text.sanitize_name(F.col("n"))).collect()] == ["abc.txt", "unnamed", "unnamed", "é-1_"]
    paths = spark.createDataFrame([("documents/x/report.pdf",), ("a\\b\\n.txt",), ("n.TXT",)], "p string")
    assert [r[0] for r in paths.select(text.matches_globs(F.col("p"), ["documents/*.pdf", "*.txt", "["])).collect()] == [True, True, False]
    assert [r[0] for r in paths.select(text.matches_globs(F.col("p"), [])).collect()] == [True] * 3


def test_globs_that_no_engine_takes(spark):
    """Reversed and unclosed classes are skipped; signs that Java reads in a class stand for themselves."""
    df = spark.createDataFrame([("a/b.txt",), ("z",), ("[",), ("&",)], "path string")
    take = lambda *patterns: [r.path for r in df.where(text.matches_globs(F.col("path"), list(patterns))).collect()]
    assert take("[z-a]", "[", "*.txt") == ["a/b.txt"] and take("[[&]") == ["[", "&"]
    out = [r.path for r in df.where(~text.excluded(F.col("path"), ["[z-a]", "[x", "b.*"])).collect()]
    assert out == ["z", "[", "&"] and df.where(text.excluded(F.col("path"), ["[z-a]"])).count() == 0
