"""Token ids as flat unsigned integer files with 64-bit document offsets.

A part covers a range of document ids in ascending order and has three files:
  <name>.ids   the ids of all its documents, little-endian unsigned 16- or 32-bit (16 where the vocabulary fits)
  <name>.off   little-endian unsigned 64-bit: for each document the ids before it in the whole corpus, then the end
  <name>.key   little-endian signed 64-bit: the documents' own ids
A part's base, the first value of its .off file, is the prefix sum of the sizes of the parts before it.
Readers map the files into memory, so a document costs two offsets and one slice.

Writing: rows are dealt by range of the key, each task encodes and writes one part with offsets from 0 and
reports its size; bases come from the prefix sum over the reported parts (one row per task, whatever the
corpus), and a second pass shifts the small offset files only. Each attempt of a task writes names of its own,
so a lost or repeated attempt leaves files that no manifest names.

Cases: null texts are documents with the end id alone; a very long text is encoded whole, in a step of its own; rows with
a null key are written first, with the smallest 64-bit number for a key; repeated keys stay separate documents, ordered by
text, in one part, as a part covers a range of keys; other columns are dropped; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm.util import arrow_folder, fresh_path, qualified, steps

NULL_KEY = -(1 << 63)
#: Bytes of stored input for each part, where that makes more parts than the session's shuffles have.
PART_BYTES = 128 << 20
_MANIFEST = "part int, name string, n_docs long, n_ids long"


def _mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where it is a local path, else read."""
    fs, path = arrow_folder(folder)
    path = f"{path}/{name}"
    if fs.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def lowers_first(normaliser: dict | None) -> bool:
    """Whether a tokenizer's normaliser lower-cases, after steps that lower-casing ASCII letters before them doesn't change."""
    steps_ = (normaliser or {}).get("normalizers", [normaliser] if normaliser else [])
    for step in steps_:
        if step["type"] == "Lowercase":
            return True
        blank = step["type"] == "Replace" and step["pattern"].get("Regex") in (r"\s", r"\s+")
        if not blank and step["type"] not in ("NFC", "NFD", "NFKC", "NFKD"):
            return False
    return False


class LibraryEncoder:
    """The tokenizers library behind a cache of words: its split never joins what white space separates,
    so each distinct word is encoded once by the library and a text is the sequence of its words' ids, which are
    kept as the bytes that go to the file."""

    CACHE_WORDS = 250_000
    CACHE_LENGTH = 48

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = max(self.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = self.packed([end_id])
        ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            self.lowers = lowers_first(json.load(f).get("normalizer"))
        marked = ids("7")
        self.mark = marked[0] if len(marked) == 1 and ids("a. 7 b") == [*ids("a."), *marked, *ids("b")] else None
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words. Words without the digit of the mark go to the library many at a time, joined by it."""
        out: dict[bytes, bytes] = {}
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        plain = [w for w in words if b"7" not in w and b"<|" not in w] if self.mark is not None else []
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for group, e in zip(groups, encode([" 7 ".join([w.decode() for w in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts, flat = np.flatnonzero(ids == self.mark).tolist(), ids.tobytes()
            step = self.dtype.itemsize
            begins = [0, *(step * (c + 1) for c in cuts)]
            out.update(zip(group, [flat[x:y] for x, y in zip(begins, [*(step * c for c in cuts), len(flat)], strict=True)], strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, [self.packed(e.ids) for e in encode([w.decode() for w in rest], add_special_tokens=False)], strict=True))
        return [out[w] for w in words]

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        if self.lowers:  # fewer distinct words; special tokens are told apart before the library lower-cases
            texts = [t if b"<|" in t else t.lower() for t in texts]
        split = [t.split() for t in texts]
        now = self.words
        missing = set().union(*split).difference(now) if split else set()
        if missing:
            kept = {w: self.older[w] for w in missing if w in self.older}
            now.update(kept)
            fresh = [w for w in missing if w not in kept]
            now.update(zip(fresh, self.encode_words(fresh), strict=True))
        ids = [b"".join(map(now.__getitem__, s)) for s in split]
        for w in missing:
            if len(w) > self.CACHE_LENGTH:
                del now[w]
        if len(now) > self.CACHE_WORDS:
            self.older, self.words = now, {}
        return ids


_LOADED: dict[tuple[str, int], LibraryEncoder] = {}


def _encoder(path: str, end_id: int) -> LibraryEncoder:
    if (path, end_id) not in _LOADED:
        _LOADED[path, end_id] = LibraryEncoder(path, end_id)
    return _LOADED[path, end_id]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, parts: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes all texts, appends end_id to each and writes the files below `folder`.

    Returns the manifest, also written to folder/manifest: part, name, n_docs, n_ids, base."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    if parts is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, by the planner
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES) if size < 1 << 60 else 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_path, end_id)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, top = arrow_folder(folder)
        fs.create_dir(top, recursive=True)
        n_docs = n_ids = 0
        with fs.open_output_stream(f"{top}/{name}.ids") as ids_file, fs.open_output_stream(f"{top}/{name}.loc") as off_file, fs.open_output_stream(f"{top}/{name}.key") as key_file:
            for whole in batches:
                for batch in steps(whole, text):
                    ids = encoder.encode_batch([t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()])
                    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // encoder.dtype.itemsize + 1
                    ids_file.write(encoder.end.join([*ids, b""]))
                    off_file.write((n_ids + np.cumsum(lengths) - lengths).astype("<u8").tobytes())
                    key_file.write(np.asarray(batch.column(key).fill_null(NULL_KEY).to_numpy(zero_copy_only=False), "<i8").tobytes())
                    n_docs, n_ids = n_docs + len(ids), n_ids + int(lengths.sum())
            off_file.write(np.array([n_ids], "<u8").tobytes())
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [n_docs], "n_ids": [n_ids]})
        else:
            for kind in ("ids", "loc", "key"):
                fs.delete_file(f"{top}/{name}.{kind}")

    # The written table fixes which attempts count; it has one row for each part.
    local = f"{folder}/sizes"
    ordered = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).repartitionByRange(parts, key)
    ordered.sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first()).mapInArrow(write, _MANIFEST).write.parquet(local)
    sizes = sorted(spark.read.schema(_MANIFEST).parquet(local).collect())
    bases = [0, *accumulate(r.n_ids for r in sizes)][: len(sizes)]
    manifest = spark.createDataFrame([(*r, b) for r, b in zip(sizes, bases, strict=True)], f"{_MANIFEST}, base long")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = arrow_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                moved = _mapped(folder, f"{row['name']}.loc", "<u8") + np.uint64(row["base"])
                own = f"{top}/{row['name']}.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as f:
                    f.write(moved.astype("<u8").tobytes())
                fs.move(own, f"{top}/{row['name']}.off")
            yield batch

    dealt = manifest.repartition(max(1, len(sizes)), "part") if sizes else manifest
    dealt.mapInArrow(shift, manifest.schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, vocabulary: int) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers). One task maps one part at a time."""
    folder = qualified(spark, folder)
    schema = f"{_MANIFEST}, base long"
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, keys = (_mapped(folder, f"{row['name']}.{k}", d) for k, d in (("ids", dtype), ("off", "<u8"), ("key", "<i8")))
                for at in range(0, len(keys), 8192):
                    own = offsets[at : at + 8193].astype(np.int64)
                    local = own - row["base"]
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(local[:-1].tolist(), local[1:].tolist(), strict=True)]
                    doc = keys[at : at + 8192].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, mask=doc == NULL_KEY), pa.array(own[:-1]), pa.array(np.diff(own)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    manifest = spark.read.schema(schema).parquet(f"{folder}/manifest")
    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(folder: str, name: str, base: int, at: int, vocabulary: int) -> np.ndarray:
    """The ids of the at-th document of a part, straight from the mapped files. folder: a full address."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    offsets = _mapped(folder, f"{name}.off", "<u8")
    return _mapped(folder, f"{name}.ids", dtype)[int(offsets[at]) - base : int(offsets[at + 1]) - base]


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the files into the shared folder and reads every document back from them."""
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, tokenizer_path, end_id)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = max(end_id + 1, len(spec["model"]["vocab"]) + len(spec["added_tokens"]))
    return read_token_files(docs.sparkSession, folder, vocabulary)
