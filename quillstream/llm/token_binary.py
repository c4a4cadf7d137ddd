"""Operator 7, token-ID files: independent zstandard frames with a trailing seek table.

File format (the public seekable zstandard format): one frame a document, holding its token ids as
little-endian unsigned 32-bit integers; a last skippable frame (magic 0x184D2A5E) lists the compressed
size, plain size and checksum of each frame, then the number of frames, a descriptor byte and the magic
0x8F92EAB1. Frame 0 is the directory of the file: the document ids as signed 64-bit integers. A reader
takes the seek table and the directory, then decompresses the frames of the documents it wants and no others.
The checksum of a frame is the lowest 32 bits of the XXH64 of its plain bytes.

Scale: texts are encoded where they are read (a worker remembers the words it met, bounded, from task to task and
until files are packed), then only token ids are range partitioned by doc_id (files
hold disjoint, ascending id ranges); counts of earlier files are summed from one row a file. Files hold at
most `file_tokens` tokens or so, so a file fits in memory as one row.

Defined results: null counts as an empty text (the end id only); a null doc_id comes first; repeated ids
stay repeated, in an arbitrary but single order; other columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.bpe import byte_symbols
from quillstream.llm.common import bound_batches, drop, materialize, new_path, release, tidy
from quillstream.llm.zstd_frames import read_files, skippable, write_rows

SEEK_TABLE = 0x184D2A5E
SEEKABLE = struct.pack("<I", 0x8F92EAB1)
_BY_FILE: dict[str, "ChunkEncoder"] = {}
PLAIN = "\u0250"
#: ASCII characters that are no letter, digit or white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Most characters of a word that is remembered.
WORD_CHARS = 64
#: Normalizers (composed forms, white space, small letters) and pre-tokenizers (pieces by a pattern, bytes as
#: symbols) as (type, behavior, invert, add_prefix_space, use_regex).
STEPS = [("NFC", None, None, None, None), ("Replace", None, None, None, None), ("Lowercase", None, None, None, None), ("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]
#: Stands for a null doc_id in a file's directory.
NO_ID = -(2**63)


class Words(dict):
    """Words and what find() gives for them, worked out as they are asked for. Holds at most `keep` words and the
    `keep` before them; words that are asked for again move up, so it's the rare ones that are forgotten."""

    def __init__(self, find, keep: int):
        self.find, self.keep = find, keep
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.find(word)
            if len(word) > WORD_CHARS:
                return got
        if len(self) >= self.keep:
            self.older = self.copy()
            self.clear()
        self[word] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.older = {}


class ChunkEncoder:
    """The library's ids of whole texts. White space always ends a word for vocabularies that drop it, so
    stretches between spaces are encoded once each and remembered (bounded, the rare ones are forgotten).

    The library's whole encode() follows each character through normalizer and pre-tokenizer. For plain words
    (printable characters below PLAIN, where small letters and composed forms are beyond doubt) of a vocabulary with
    the steps in STEPS these come down to small letters and the pattern; the library's model then gets the pieces."""

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = Words(self._word, keep)
        self.size = self.tokenizer.get_vocab_size()
        #: Bytes of an id on its way to a file.
        self.kind, self.code = ("<u2", "H") if self.size <= 2**16 else ("<u4", "I")
        # A vocabulary that keeps white space gives "a b" other ids than "a" and "b".
        probe = [self._library([x])[0] for x in ("ab cd", "ab", "cd", "ab \n\tcd")]
        self.by_word = probe[0] == probe[1] + probe[2] == probe[3]
        self.pieces = self._pattern(json.loads(self.tokenizer.to_str()))
        self.symbols = dict(enumerate(byte_symbols()))

    @staticmethod
    def _pattern(spec: dict):
        """The pattern of the pieces of a word where the vocabulary takes STEPS and no others, and its special strings
        hold "<|"; else None."""
        steps = [x for part, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (spec.get(part) or {}).get(inner, [])]
        if [(x["type"], x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in steps] != STEPS or spec["model"]["type"] != "BPE":
            return None
        if any("<|" not in x["content"] for x in spec["added_tokens"]):
            return None
        return regex.compile(steps[3]["pattern"]["Regex"])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned integers of `kind`."""
        if not self.by_word:
            return self._library([t or "" for t in texts])
        ids, small = self.words.__getitem__, str if self.pieces is None else _small
        return [b"".join(map(ids, small(t).replace("\n", " ").split(" "))) if t else b"" for t in texts]

    def _direct(self, word: str) -> bytes:
        model, out = self.tokenizer.model.tokenize, []
        for p in (word,) if word.isalpha() else self.pieces.findall(word):
            out += [t.id for t in model(p if p.isascii() else p.encode().decode("latin-1").translate(self.symbols))]
        return struct.pack(f"<{len(out)}{self.code}", *out)

    def _word(self, word: str) -> bytes:
        """Ids of a stretch without spaces; marks at the end of a plain word's letters are a piece of their own."""
        small = word.lower()
        if self.pieces is None or "<|" in word or not word.isprintable() or not word.isascii() and (max(word) >= PLAIN or max(small) >= PLAIN):
            return self._library([word])[0]
        base = small.rstrip(MARKS)
        if len(base) < len(small) and base.isalpha():
            return self.words[base] + self.words[small[len(base) :]]
        return self._direct(small)


def _small(text: str) -> str:
    """Latin-1 texts in small letters, which leaves fewer different words; others as they are, and so are those that
    may hold a special string: in capitals it is none."""
    if "<|" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


def encoder(path: str) -> ChunkEncoder:
    if path not in _BY_FILE:
        _BY_FILE[path] = ChunkEncoder(path)
    return _BY_FILE[path]


def forget() -> None:
    """Give back the memory of the words that this worker's encoders remember."""
    if any(e.words for e in _BY_FILE.values()):
        for e in _BY_FILE.values():
            e.words.forget()
        release()


def pack_file(ids: list[int], payloads: list[bytes], level: int = 1) -> bytes:
    """A whole file: directory, one frame a document, seek table."""
    z = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    out, table = [], []
    for plain in (np.array(ids, "<i8").tobytes(), *payloads):
        frame = z.compress(plain)
        out.append(frame)
        table.append(struct.pack("<III", len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
    foot = b"".join(table) + struct.pack("<IB", len(table), 0x80) + SEEKABLE
    return b"".join(out) + skippable(foot, SEEK_TABLE)


class FileReader:
    """Reads documents of one file, given as bytes or as a function (start, end) -> bytes and a size; of
    the function only the seek table, the directory and the wanted frames are asked."""

    def __init__(self, data, size: int | None = None):
        if callable(data):
            self.read = data
        else:
            self.read, size = lambda a, b: data[a:b], len(data)
        tail = self.read(max(0, size - 9), size)
        if len(tail) < 9 or tail[-4:] != SEEKABLE:
            raise ValueError("no seek table")
        n, descriptor = struct.unpack_from("<IB", tail)
        if descriptor != 0x80:
            raise ValueError("the seek table has no checksums, or an unknown descriptor")
        start = size - 9 - 12 * n
        if start < 8 or struct.unpack("<II", self.read(start - 8, start)) != (SEEK_TABLE, 12 * n + 9):
            raise ValueError("the seek table's frame is broken")
        self.table = np.frombuffer(self.read(start, start + 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        if self.offsets[-1] != start - 8:
            raise ValueError("the frames' sizes don't add up")
        self.z = zstandard.ZstdDecompressor()
        self.ids = np.frombuffer(self._frame(0), "<i8")
        if len(self.ids) != n - 1:
            raise ValueError("the directory doesn't fit the seek table")

    def _frame(self, i: int) -> bytes:
        _, size, check = (int(x) for x in self.table[i])
        try:
            plain = self.z.decompress(self.read(int(self.offsets[i]), int(self.offsets[i + 1])), max_output_size=size)
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {i} is damaged") from e
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return plain

    def document(self, i: int) -> bytes:
        """The token ids of the i-th document of the file, as bytes; decompresses its frame alone."""
        return self._frame(i + 1)

    def lookup(self, doc_id: int) -> list[bytes]:
        return [self.document(int(i)) for i in np.flatnonzero(self.ids == doc_id)]


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str, file_tokens: int = 4_000_000) -> int:
    """Encode, order by doc_id and write the files of a folder; returns how many were asked for."""
    spark = docs.sparkSession
    bound_batches(spark)
    # On the way to its file an id takes two bytes where the vocabulary allows it.
    kind = encoder(vocabulary).kind
    if not 0 <= end_id < 256 ** np.dtype(kind).itemsize:
        raise ValueError("the end id doesn't fit the vocabulary")

    def encode(batches):
        e = encoder(vocabulary)
        end = struct.pack("<" + e.code, end_id)
        for b in batches:
            got = [x + end for x in e.encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.binary())], names=["doc_id", "ids"])

    def pack(batches):
        forget()  # whatever there was to encode is written
        ids, payloads, size = [], [], 0
        for b in batches:
            for i, p in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                ids.append(NO_ID if i is None else i)
                payloads.append(np.frombuffer(p, kind).astype("<u4").tobytes())
                size += len(p)
        if ids:  # the last four bytes come from the writer
            yield pa.RecordBatch.from_arrays([pa.array([pack_file(ids, payloads)[:-4]], pa.binary())], names=["file"])

    encoded, held = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(encode), "doc_id long, ids binary"),
        "token-ids",
    )
    total = encoded.agg(F.sum(F.length("ids"))).first()[0] or 0
    n = max(1, -(-total // (np.dtype(kind).itemsize * file_tokens)), spark.sparkContext.defaultParallelism)
    files = encoded.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(tidy(pack), "file binary")
    write_rows(files, "file", path, SEEKABLE)
    drop(spark, held)
    return n


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, in the files' order."""
    own = "file string, inner long, doc_id long, n_tokens long, ids_crc32 long"

    def read(batches):
        for b in batches:
            for k in range(b.num_rows):
                r = FileReader(b.column("content")[k].as_py())
                sizes, sums = np.empty(len(r.ids), np.int64), np.empty(len(r.ids), np.int64)
                for i in range(len(r.ids)):
                    plain = r.document(i)
                    sizes[i], sums[i] = len(plain) // 4, zlib.crc32(plain)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("path")[k].as_py()] * len(sizes)), pa.array(np.cumsum(sizes) - sizes), pa.array(r.ids, mask=r.ids == NO_ID), pa.array(sizes), pa.array(sums)],
                    names=["file", "inner", "doc_id", "n_tokens", "ids_crc32"],
                )

    rows, _ = materialize(read_files(spark, path).mapInArrow(tidy(read), own), "token-rows")
    # One row a file: how many ids the files before it hold. Files hold disjoint ranges of doc_id.
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("least"))
    before = Window.orderBy(F.col("least").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    base = per_file.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def lookup_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the documents asked for, from the files of a folder: of each file the seek table, the
    directory and the frames of these documents are decompressed and no others. The list is the caller's."""
    wanted = sorted(set(doc_ids))

    def read(batches):
        for b in batches:
            for k in range(b.num_rows):
                r = FileReader(b.column("content")[k].as_py())
                at = np.flatnonzero(np.isin(r.ids, wanted))
                if len(at):
                    ids = [np.frombuffer(r.document(int(i)), "<u4").astype(np.int64) for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array(r.ids[at]), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return read_files(spark, path).mapInArrow(tidy(read), "doc_id long, ids array<long>")


def open_file(spark: SparkSession, file: str) -> FileReader:
    """A reader of one file on any file system that Spark reaches, from the driver, by ranges: whatever is not
    asked for is not read either."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(file)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(start: int, end: int) -> bytes:
        stream = fs.open(at)
        try:
            stream.seek(start)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, end - start))
        finally:
            stream.close()

    return FileReader(read, fs.getFileStatus(at).getLen())


def token_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the token files of docs and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, vocabulary, end_id, path)
    return read_token_files(docs.sparkSession, path)
