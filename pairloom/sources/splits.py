"""Binary files read by many tasks each: word vectors cut at records, gzipped pickles cut at members.

A task gets a range of bytes and reads what begins in it. Where the first record of a range begins is
found from the bytes around, and each task checks that it ends where the next one begins, so a wrong cut is an
error and never a wrong row. Files are opened by pyarrow's file systems: plain paths, file:, hdfs:, s3:, gs:.
"""

from __future__ import annotations

import io
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
#: Longest word of a vector file, in bytes; records that are looked through to find a beginning; bytes read at a time.
LONGEST_WORD, LOOK_RECORDS, READ_BYTES = 1000, 64, 8 << 20
ROWS = 1000
MEMBER = b"\x1f\x8b\x08"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder, by name; names that begin with . or _ are skipped."""
    system, local = opened(path)
    prefix = path.removesuffix(local) if ":/" in path else ""
    info = system.get_file_info(local)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(local, recursive=True))
    return sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name[:1] not in "._")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


def ranges(path: str, split_bytes: int) -> list[Range]:
    out = []
    for name, size in files_of(path):
        step = split_bytes or max(size, 1)
        out += [Range(name, at, min(at + step, size), size) for at in range(0, size, step)]
    return out


class VectorFile:
    """A word-vector file: a line with the number of words and of dimensions, then word, space and float32 numbers each.

    A record may be followed by a line feed, which counts to the next word.
    """

    def __init__(self, path: str, size: int):
        system, local = opened(path)
        self.file, self.size = system.open_input_file(local), size
        head, feed, _ = self.file.read_at(min(size, 1000), 0).partition(b"\n")
        if not feed:
            raise ValueError(f"{path} has no line of counts")
        self.dims, self.first = int(head.split()[1]), len(head) + 1

    def after(self, data: bytes, at: int) -> int:
        """Where the record that begins at data[at] ends; -1 if none begins there, len(data) + 1 or more if the data end before."""
        space = data.find(b" ", at, at + LONGEST_WORD + 1)
        if space < 0:
            return len(data) + 1 if at + LONGEST_WORD >= len(data) else -1
        return space + 1 + 4 * self.dims

    def chain(self, data: bytes, at: int, least: int, last: bool) -> int:
        """First record at data[least] or later of the records from data[at] on; -1 if they run into what is no record."""
        found = -1
        while True:
            if last and not data[at:].strip(b"\n"):
                return found if found >= 0 else len(data)
            if found < 0 and at >= least:
                found = at
            end = self.after(data, at)
            if end < 0 or (last and end > len(data)):
                return -1
            if end > len(data):
                return found
            at = end

    def beginning(self, at: int) -> int:
        """The first record that begins at byte `at` or later; the file's size if none does.

        Every place in the record before is tried. What follows a place must be records one after the
        other; chains soon break off or meet the true one, and then agree on what begins behind `at`.
        """
        if at <= self.first:
            return self.first
        longest = 4 * self.dims + LONGEST_WORD + 2
        start, look = max(self.first, at - 2 * longest), LOOK_RECORDS
        while True:
            data = self.file.read_at(min(self.size - start, 2 * longest + look * longest), start)
            last = start + len(data) >= self.size
            tries = range(1) if start == self.first else range(longest)
            found = {self.chain(data, k, at - start, last) for k in tries} - {-1}
            if len(found) == 1:
                return start + found.pop()
            if last:
                raise ValueError(f"no single place where the records after byte {at} may begin; read the file with split_bytes=0")
            look *= 4

    def records(self, start: int, end: int) -> Iterator[tuple[list[str], list[bytes], int]]:
        """Words, their numbers as bytes, and where the next record begins, of the records that begin in [start, end)."""
        at = start
        data, base = b"", start
        words: list[str] = []
        vectors: list[bytes] = []
        while at < end:
            stop = self.after(data, at - base) if at - base < len(data) else len(data) + 1
            if stop < 0:
                raise ValueError(f"no record at byte {at}")
            if stop > len(data):
                more = self.file.read_at(min(self.size - base - len(data), max(READ_BYTES, stop - len(data))), base + len(data))
                if not more:
                    if data[at - base :].strip(b"\n"):
                        raise ValueError(f"the record at byte {at} is cut off")
                    at = self.size
                    break
                data, base = data[at - base :] + more, at
                continue
            words.append(data[at - base : stop - 4 * self.dims - 1].lstrip(b"\n").decode("utf-8", "replace"))
            vectors.append(data[stop - 4 * self.dims : stop])
            at = base + stop
            if len(words) == ROWS:
                yield words, vectors, at
                words, vectors = [], []
        yield words, vectors, at


class VectorReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.split_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        source = VectorFile(partition.path, partition.size)
        start, next_start = source.beginning(partition.start), partition.size if partition.end == partition.size else source.beginning(partition.end)
        at = start
        schema = pa.schema([("word", pa.string()), ("vec", pa.list_(pa.float32()))])
        for words, vectors, at in source.records(start, next_start):
            values = pa.array(np.frombuffer(b"".join(vectors), "<f4"))
            offsets = pa.array(np.arange(len(words) + 1) * source.dims, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(offsets, values)], schema=schema)
        if max(at, start) != max(next_start, start):
            raise ValueError(f"{partition.path}: the records from byte {start} on end at {at}, the next ones begin at {next_start}")


class WordVectors(DataSource):
    """Format `word_vectors`: (word, vec) of binary word-vector files; option split_bytes, 0 for a task a file."""

    @classmethod
    def name(cls) -> str:
        return "word_vectors"

    def schema(self) -> str:
        return "word string, vec array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


class Member(io.RawIOBase):
    """The bytes of one gzip member that begins at a place of a file; `end` is where it ends, once all is read."""

    def __init__(self, file: pa.NativeFile, at: int):
        super().__init__()
        self.file, self.at, self.unzip, self.rest, self.end = file, at, zlib.decompressobj(31), b"", -1

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.unzip.eof:
            if not self.rest:
                self.rest = self.file.read_at(1 << 20, self.at)
                self.at += len(self.rest)
                if not self.rest:
                    raise EOFError("a gzip member is cut off")
            out = self.unzip.decompress(self.rest, len(target))
            self.rest = self.unzip.unconsumed_tail
            if self.unzip.eof:
                self.end = self.at - len(self.unzip.unused_data)
            if out:
                target[: len(out)] = out
                return len(out)
        return 0


def whole_member(file: pa.NativeFile, at: int) -> bool:
    """Whether a gzip member begins at this byte: all of it unpacks, and its checksum and length are right."""
    member = Member(file, at)
    buffer = memoryview(bytearray(1 << 16))
    try:
        while member.readinto(buffer):
            pass
    except (zlib.error, EOFError):
        return False
    return True


class PlainValues(pickle.Unpickler):
    """Reads containers, numbers and texts only: a file that names any class or function is refused."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} in a file of plain values")


def pickled(raw: io.RawIOBase) -> Iterator[object]:
    """The pickled values of a stream, one after the other."""
    reader = io.BufferedReader(raw, 1 << 20)
    while reader.peek(1):
        yield PlainValues(reader).load()


def values_of(part: Range) -> Iterator[object]:
    """The pickled values of the gzip members that begin in a range, or of a whole file that is not gzipped.

    A file of one member, and one that is not gzipped, is read by the task of its first range.
    """
    system, local = opened(part.path)
    file = system.open_input_file(local)
    if file.read_at(len(MEMBER), 0) != MEMBER:
        if part.start == 0:
            file.seek(0)
            yield from pickled(file)
        return
    at = part.start
    if at:  # look for the first member of the range
        window, step = b"", 1 << 20
        while at < part.end:
            window = file.read_at(step + len(MEMBER) - 1, at)
            k = window.find(MEMBER)
            while k >= 0 and at + k < part.end and not whole_member(file, at + k):
                k = window.find(MEMBER, k + 1)
            if 0 <= k < part.end - at:
                at += k
                break
            at += step
    while at < part.end:
        member = Member(file, at)
        yield from pickled(member)
        at = member.end
        if not file.read_at(1 << 16, at).strip(b"\0"):  # padding
            return


def sentence(side: dict) -> list[dict]:
    """Tokens by place, each with the labels of the tokens that hang on it; the root is no token."""
    tokens = [{"word": str(t["word"]).lower(), "pos": t["pos"], "ner": t["ner"], "deps": {}} for t in sorted(side["toks"], key=lambda t: t["index"])]
    for d in side["deps"]:
        if d["governor"] > 0:
            tokens[d["governor"] - 1]["deps"][d["dependent"] - 1] = d["dep"]
    return tokens


#: Layout of a parsed sentence, and of a pair of them.
SENTENCE = "array<struct<word:string,pos:string,ner:string,deps:map<int,string>>>"
ANNOTATED = f"pair_id bigint, is_duplicate int, question1 string, question2 string, s {SENTENCE}, t {SENTENCE}"
TOKEN = pa.struct([("word", pa.string()), ("pos", pa.string()), ("ner", pa.string()), ("deps", pa.map_(pa.int32(), pa.string()))])
ANNOTATED_ARROW = pa.schema([("pair_id", pa.int64()), ("is_duplicate", pa.int32()), ("question1", pa.string()), ("question2", pa.string()), ("s", pa.list_(TOKEN)), ("t", pa.list_(TOKEN))])


class PickleReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, annotated: bool, width: int):
        self.path, self.split_bytes, self.annotated, self.width = path, split_bytes, annotated, width

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.split_bytes)

    def read(self, partition: Range) -> Iterator:
        if not self.annotated:
            for value in values_of(partition):
                yield from (tuple(x) if self.width > 1 else (x,) for x in value)
            return
        rows: list[dict] = []
        for d in values_of(partition):
            rows.append({"pair_id": d.get("id", d.get("test_id")), "is_duplicate": d.get("is_duplicate"), "question1": d["q1"]["raw"], "question2": d["q2"]["raw"], "s": sentence(d["q1"]), "t": sentence(d["q2"])})
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=ANNOTATED_ARROW)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=ANNOTATED_ARROW)


class PickledRows(DataSource):
    """Format `pickled_rows`: pickled lists of tuples in a given schema; option split_bytes."""

    annotated = False

    @classmethod
    def name(cls) -> str:
        return "pickled_rows"

    def reader(self, schema) -> PickleReader:
        return PickleReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), self.annotated, len(schema.fields))


class AnnotatedPickles(PickledRows):
    """Format `annotated_pickles`: a pickled dictionary (id, is_duplicate, q1, q2) a pair; option split_bytes."""

    annotated = True

    @classmethod
    def name(cls) -> str:
        return "annotated_pickles"

    def schema(self) -> str:
        return ANNOTATED
