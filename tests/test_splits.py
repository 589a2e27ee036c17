"""Binary files read by ranges: equal to a task a file, whatever the cuts."""

import gzip
import pickle

import numpy as np
import pytest

from pairloom.sources import pairs as sources
from pairloom.sources import splits


def write_vectors(path, words, vectors, feed=b"\n"):
    path.write_bytes(b"%d %d\n" % vectors.shape + b"".join(w.encode() + b" " + v.astype("<f4").tobytes() + feed for w, v in zip(words, vectors, strict=True)))


@pytest.mark.parametrize("feed", [b"\n", b""])
def test_vectors_by_ranges_equal_one_task(spark, tmp_path, feed):
    rng = np.random.default_rng(1)
    words = [f"w{i}_{'é' * (i % 7)}" for i in range(4000)]
    vectors = rng.normal(size=(4000, 20)).astype("<f4")
    vectors[::3] = 0.15625  # its bytes hold a space
    vectors[1::5] = 0
    write_vectors(tmp_path / "v.bin", words, vectors, feed)
    want = {w: v.tolist() for w, v in zip(words, vectors, strict=True)}
    for split_bytes in (0, 3_001, 100_000):
        df = sources.read_word_vectors_binary(spark, f"{tmp_path}/v.bin", split_bytes)
        got = df.collect()
        assert len(got) == 4000 and {r["word"]: r["vec"] for r in got} == want
        assert (df.rdd.getNumPartitions() > 1) == (split_bytes > 0)


def test_every_cut_of_a_vector_file(tmp_path):
    rng = np.random.default_rng(2)
    words, vectors = [f"word{i}" for i in range(60)], rng.normal(size=(60, 5))
    write_vectors(tmp_path / "v.bin", words, vectors)
    size = (tmp_path / "v.bin").stat().st_size
    file = splits.VectorFile(f"{tmp_path}/v.bin", size)
    starts = [at for _, _, at in one_by_one(file, size)]
    for cut in range(size + 1):
        assert file.beginning(cut) == min([s for s in [file.first, *starts] if s >= cut and s < size - 1], default=size)


def one_by_one(file, size):
    at = file.first
    while at < size - 1:
        [(words, vectors, end)] = file.records(at, at + 1)
        yield words, vectors, end
        at = end


def test_cut_off_and_headless_files_are_errors(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"1 4\nword " + bytes(15))
    (tmp_path / "b.bin").write_bytes(b"no line of counts")
    for name in "ab":
        with pytest.raises(Exception, match="cut off|line of counts"):
            sources.read_word_vectors_binary(spark, f"{tmp_path}/{name}.bin").collect()
    (tmp_path / "c.bin").write_bytes(b"0 4\n")
    assert sources.read_word_vectors_binary(spark, f"{tmp_path}/c.bin").count() == 0
    with pytest.raises(Exception, match="missing"):
        sources.read_word_vectors_binary(spark, f"{tmp_path}/missing.bin").count()


def test_vectors_over_two_gigabytes(spark, tmp_path):
    """A sparse file: its numbers are holes, so it takes a few megabytes of disk."""
    dims, rows = 200_000, 2_750
    with open(tmp_path / "big.bin", "wb") as out:
        out.write(b"%d %d\n" % (rows, dims))
        for i in range(rows):
            out.write(b"w%d " % i)
            out.seek(4 * dims, 1)
        out.truncate(out.tell())
    assert (tmp_path / "big.bin").stat().st_size > 2 << 30
    df = sources.read_word_vectors_binary(spark, f"{tmp_path}/big.bin", 128 << 20)
    got = df.selectExpr("word", "size(vec) as n").groupBy("n").agg({"word": "count"}).collect()
    assert [tuple(r) for r in got] == [(dims, rows)] and df.rdd.getNumPartitions() > 10


def test_gzip_members_are_read_by_ranges(spark, tmp_path):
    rows = [[(i, f"text {i % 100}" * (i % 9)) for i in range(k, k + 50)] for k in range(0, 5000, 50)]
    (tmp_path / "m.gz").write_bytes(b"".join(gzip.compress(pickle.dumps(x)) for x in rows))
    (tmp_path / "one.gz").write_bytes(gzip.compress(b"".join(map(pickle.dumps, rows))))
    (tmp_path / "plain.pkl").write_bytes(b"".join(map(pickle.dumps, rows)))
    want = sorted(x for r in rows for x in r)
    for name in ("m.gz", "one.gz", "plain.pkl"):
        for split_bytes in (0, 500, 5_000):
            df = sources.read_pickled_rows(spark, f"{tmp_path}/{name}", "id bigint, word string", split_bytes)
            assert sorted(map(tuple, df.collect())) == want
    range_ = splits.Range(f"{tmp_path}/m.gz", 3000, 6000, (tmp_path / "m.gz").stat().st_size)
    assert 0 < sum(len(x) for x in splits.values_of(range_)) < 5000
    (tmp_path / "cut.gz").write_bytes(gzip.compress(pickle.dumps(rows[0]))[:-20])
    with pytest.raises(Exception, match="cut off"):
        sources.read_pickled_rows(spark, f"{tmp_path}/cut.gz", "id bigint, word string").collect()
    # a folder is all its files; hidden ones are no data
    (tmp_path / "d").mkdir()
    for k in range(3):
        (tmp_path / "d" / f"{k}.gz").write_bytes(gzip.compress(pickle.dumps(rows[k])))
    (tmp_path / "d" / "_SUCCESS").write_bytes(b"")
    assert sources.read_pickled_rows(spark, f"{tmp_path}/d", "id bigint, word string").count() == 150
