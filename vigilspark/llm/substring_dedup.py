"""Repeated passages: removes words covered by a window whose word sequence also starts earlier.

Pass 1 estimates counts. Every window of `window` words has a leading stretch: among its runs of `stretch`
words the one with the smallest hash. A window that occurs twice has its leading stretch at two places, so the
count of the stretch is never below the window's. Each task counts its stretches in a count-min sketch, of which
it sends the cells that it touched; cells are dealt by range and added up, and what is left of the merged sketch
is a bit a cell: two or more. The sketch's width follows the corpus.

Pass 2 reads the texts again, keeps the windows estimated to occur twice or more and groups them by 128 bits of hash:
two 64-bit halves from word hashes of their own, so that unlike words agree in both by chance alone (2**-128 for a
pair). A window's first place is the smallest document (in it, the smallest start). Before the shuffle each task
settles what it can: of equal windows in its text only the first stays open. So a passage that a third of all
documents share costs a row or so for each task.

Pass 3 joins the settled windows to their documents and cuts the words out.

A lost file of the sketch is an error, as its windows would pass for unrepeated; a range without a file is one that
the merge has named no file for.

Cases: null texts have no words; texts shorter than a window lose nothing; a very long text is one step of a task,
whole; rows that repeat a doc_id are told apart by a hash of the text: none of them precedes another, each loses what
starts earlier in itself or in a smaller doc_id; a null doc_id comes before all others; other columns pass through,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.llm.util import arrow_folder, fresh_path, mix64, steps, text_bytes, unused

#: Rows of the sketch, and the most cells that one merging task holds.
SKETCH_ROWS = 2
RANGE_CELLS = 1 << 22
#: The sketch's width stays between these; beyond the largest more windows pass, none is lost.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 34
#: Stretches that a task gathers before it sends their cells.
GATHER = 1_000_000
#: Frequent windows that a task keeps in mind to settle later ones at once.
FREQUENT = 1 << 18
NULL_KEY = -(1 << 63)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)]


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_WORDS, _AGAIN = _Powers(0x9FB21C651E98DF25), _Powers(0xD6E8FEB86659FD93)
#: Words up to so many bytes are hashed by tables, longer ones by XXH3.
TABLED = 32
#: For each half of the hash: a random number for each place in a word and each byte there.
_TABLES = [np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, (TABLED, 256), np.uint64).reshape(-1) for seed in (1, 2)]


def _runs(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(values) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)]), down


class Words:
    """The words of a batch of texts: their hashes, and the row that each stands in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~_SPACE[data]
        n = len(data)
        starts = inside.copy()
        ends = inside.copy()
        if n:
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cuts = offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            starts[cuts] |= inside[cuts]
            ends[cuts - 1] |= inside[cuts - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.lengths = e - s
        self.ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths)])
        place = np.arange(self.ends[-1]) - np.repeat(self.ends[:-1], self.lengths)
        self.codes = np.minimum(place, TABLED - 1) << 8 | data[inside]
        long = np.flatnonzero(self.lengths > TABLED)
        self.long = long, [xxhash.xxh3_128_intdigest(data[s[i] : e[i]].tobytes()) for i in long.tolist()]
        self.first = np.searchsorted(s, offsets)  # of each row, and the end of the last
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.left = self.first[1:][self.row] - np.arange(len(s)) if len(s) else np.zeros(0, np.int64)

    def _hash(self, half: int) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLES[half][self.codes], dtype=np.uint64)])
        out = mix64(total[self.ends[1:]] - total[self.ends[:-1]] + self.lengths.astype(np.uint64) * _SEEDS[half])
        long, digests = self.long
        out[long] = np.array([d >> (64 * half) & (1 << 64) - 1 for d in digests], np.uint64)
        return out

    @cached_property
    def hash(self) -> np.ndarray:
        return self._hash(0)

    @cached_property
    def other(self) -> np.ndarray:
        return self._hash(1)

    def windows(self, size: int, again: bool = False) -> np.ndarray:
        """A hash of the run of `size` words from each word on; runs over a row's end mean nothing. again: the other half."""
        h = self.other if again else self.hash
        total, down = _runs(h, _AGAIN if again else _WORDS)
        n = max(0, len(h) - size + 1)
        return mix64((total[size : size + n] - total[:n]) * down[:n])

    def leading(self, window: int, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows, the place of each one's leading stretch, and the hashes of all stretches."""
        runs = self.windows(stretch)
        n = max(0, len(self.lengths) - window + 1)
        least, place = runs[:n].copy(), np.arange(n)
        for j in range(1, window - stretch + 1):
            lower = runs[j : j + n] < least
            least[lower] = runs[j : j + n][lower]
            place[lower] = (np.arange(j, j + n))[lower]
        starts = np.flatnonzero(self.left[:n] >= window)
        return starts, place[starts], runs


def _cells(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return mix64(hashes ^ _SEEDS[row]) >> np.uint64(64 - (cells.bit_length() - 1))


def _gaps(cells: np.ndarray) -> bytes:
    """Sorted cells as the gaps between them, which are small and compress well."""
    gaps = np.diff(cells, prepend=0)
    kind = "<u2" if not len(gaps) or gaps.max() < 1 << 16 else "<u4"
    return kind.encode() + gaps.astype(kind).tobytes()


def _ungapped(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob[3:], blob[:3].decode()), dtype=np.int64)


def sketch_width(docs: DataFrame, text: str, window: int, stretch: int) -> int:
    """Cells for a sketch row: some eight for each stretch to be counted, estimated from the bytes of text."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    stretches = size / 6 * 2 / (window - stretch + 2)
    return int(min(MOST_CELLS, max(LEAST_CELLS, 1 << int(8 * stretches).bit_length())))


def merged_sketch(docs: DataFrame, folder: str, cells: int, window: int, stretch: int, text: str) -> DataFrame:
    """Counts the stretches and writes the cells counted twice or more as bits, a file for each range of cells.

    Returns a row for each file: row, range, name. Each attempt of a task writes a name of its own."""
    size = min(cells, RANGE_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(held)
            held.clear()
            for row in range(SKETCH_ROWS):
                cell, times = np.unique(_cells(flat, row, cells), return_counts=True)
                part = (cell // np.uint64(size)).astype(np.int64)
                local = (cell % np.uint64(size)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part)) + 1
                blocks = [(p[0], _gaps(x[t == 1]), _gaps(x[t > 1])) for p, x, t in zip(*(np.split(v, cuts) for v in (part, local, times)), strict=True) if len(p)]
                yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(blocks), pa.int32()), "range": pa.array([b[0] for b in blocks], pa.int64()), "once": pa.array([b[1] for b in blocks], pa.binary()), "more": pa.array([b[2] for b in blocks], pa.binary())})

        for whole in batches:
            for batch in steps(whole, text):
                words = Words(*text_bytes(batch.column(text)))
                starts, place, runs = words.leading(window, stretch)
                if len(starts):
                    held.append(runs[np.unique(place)])
                    if sum(map(len, held)) >= GATHER:
                        yield from send()
        if held:
            yield from send()

    def merge(key: tuple, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros(size, bool), np.zeros(size, bool)
        for block in blocks:
            for once, more in zip(block.column("once"), block.column("more"), strict=True):
                x, y = (_ungapped(v.as_py()) for v in (once, more))
                twice[x] |= seen[x]
                seen[x] = True
                twice[y] = True
        row, part = (k.as_py() for k in key)
        fs, top = arrow_folder(folder)
        fs.create_dir(top, recursive=True)
        name = f"sketch-{row}-{part}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{top}/{name}") as f:
            f.write(np.packbits(twice, bitorder="little").tobytes())
        yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "range": pa.array([part], pa.int64()), "name": [name]})

    sent = docs.select(text).mapInArrow(count, "row int, range long, once binary, more binary")
    return sent.groupBy("row", "range").applyInArrow(merge, "row int, range long, name string")


@lru_cache(maxsize=4096)
def _bits(folder: str, name: str) -> np.ndarray:
    """A range of the merged sketch: mapped where the folder is local, else read."""
    fs, top = arrow_folder(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{top}/{name}", np.uint8, "r")
    with fs.open_input_file(f"{top}/{name}") as f:
        return np.frombuffer(f.read(), np.uint8)


def estimated_repeated(hashes: np.ndarray, folder: str, names: dict[tuple[int, int], str], cells: int) -> np.ndarray:
    """Whether the sketch's estimate for each stretch is two or more. names: the files, by row and range of the sketch."""
    good = np.ones(len(hashes), bool)
    size = min(cells, RANGE_CELLS)
    for row in range(SKETCH_ROWS):
        at = np.flatnonzero(good)
        if not len(at):
            break
        cell = _cells(hashes[at], row, cells)
        part, local = (cell // np.uint64(size)).astype(np.int64), (cell % np.uint64(size)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ranges, begins = np.unique(part[order], return_index=True)
        for p, own in zip(ranges.tolist(), np.split(order, begins[1:]), strict=True):
            name, x = names.get((row, p)), local[own]
            bits = None if name is None else _bits(folder, name)
            good[at[own]] = False if bits is None else (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
    return good


def repeated_windows(docs: DataFrame, window: int = 20, stretch: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, start, stop: windows from start to stop (inclusive) of a document whose word sequence also starts
    earlier; text_hash tells rows of one doc_id apart."""
    folder = fresh_path(docs.sparkSession, "sketch")
    cells = sketch_width(docs, text, window, stretch)
    names = {(r["row"], r["range"]): r["name"] for r in merged_sketch(docs, folder, cells, window, stretch, text).collect()}

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.zeros(0, np.uint64)  # first halves of the hashes, sorted
        second, earliest = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        for whole in batches:
            for batch in steps(whole, text):
                words = Words(*text_bytes(batch.column(text)))
                starts, place, runs = words.leading(window, stretch)
                if not len(starts):
                    continue
                places, back = np.unique(place, return_inverse=True)
                at = starts[estimated_repeated(runs[places], folder, names, cells)[back]]
                if not len(at):
                    continue
                h1, h2 = words.windows(window)[at], words.windows(window, again=True)[at]
                row = words.row[at]
                doc = np.asarray(batch.column(key).fill_null(NULL_KEY).to_numpy(zero_copy_only=False), np.int64)[row]
                start = at - words.first[row]
                mark = batch.column("text_hash").to_numpy()[row]
                order = np.lexsort((start, mark, doc, h2, h1))
                h1, h2, doc, mark, start = h1[order], h2[order], doc[order], mark[order], start[order]
                new = np.ones(len(h1), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                group = np.cumsum(new) - 1
                head = np.flatnonzero(new)
                new[1:] |= (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
                own = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first of the same window in the same row
                covered = (doc > doc[head][group]) | (start > start[own])
                if len(frequent):
                    f = np.minimum(np.searchsorted(frequent, h1), len(frequent) - 1)
                    covered |= (frequent[f] == h1) & (second[f] == h2) & (doc > earliest[f])
                times = np.bincount(group)
                many = head[(times > 1) & ~covered[head]]
                if len(many) and len(frequent) < FREQUENT:
                    frequent, second, earliest = np.concatenate([frequent, h1[many]]), np.concatenate([second, h2[many]]), np.concatenate([earliest, doc[many]])
                    o = np.lexsort((earliest, frequent))
                    frequent, second, earliest = frequent[o], second[o], earliest[o]
                    keep = np.ones(len(frequent), bool)
                    keep[1:] = frequent[1:] != frequent[:-1]
                    frequent, second, earliest = frequent[keep], second[keep], earliest[keep]
                # settled windows, as runs
                o = np.flatnonzero(covered)
                o = o[np.lexsort((start[o], mark[o], doc[o]))]
                d, m, s = doc[o], mark[o], start[o]
                first = np.ones(len(o), bool)
                first[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (s[1:] > s[:-1] + 1)
                last = np.ones(len(o), bool)
                last[:-1] = first[1:]
                d, m, s, e = d[first], m[first], s[first], s[last]
                # open ones: the first of their kind here
                o = np.flatnonzero(~covered)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h1[o].view(np.int64), d])),
                        pa.array(np.concatenate([h2[o].view(np.int64), s])),
                        pa.array(np.concatenate([doc[o], d])),
                        pa.array(np.concatenate([mark[o], m])),
                        pa.array(np.concatenate([start[o], s]).astype(np.int32)),
                        pa.array(np.concatenate([np.full(len(o), -1), e]).astype(np.int32)),
                    ],
                    names=["h1", "h2", "doc", "text_hash", "start", "stop"],
                )

    found = docs.select(F.col(key).cast("long").alias(key), text, F.hash(text).alias("text_hash")).mapInArrow(settle, "h1 long, h2 long, doc long, text_hash int, start int, stop int")
    # Settled runs travel with the open windows (one read of the texts) under their document's key.
    dealt = found.withColumn("settled", F.col("stop") >= 0)
    first = F.expr("min(doc) over (partition by h1, h2, settled)")
    places = dealt.withColumn("first", first).where("settled or doc > first")
    return places.select(F.when(F.col("doc") != NULL_KEY, F.col("doc")).alias("doc_id"), "text_hash", "start", F.when(F.col("settled"), F.col("stop")).otherwise(F.col("start")).alias("stop"))


def remove_repeats(docs: DataFrame, window: int = 20, stretch: int = 12, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_words", "n_removed", "kept_text")) -> DataFrame:
    """The columns of docs besides the text, and any of: n_words, n_removed, kept_text (kept words joined by one
    space; a text that loses nothing stays as it is), kept_sha256 (of the kept words joined by one space)."""
    spans = repeated_windows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), window, stretch)
    own_key, own_hash, packed = unused(docs, "key", "hash", "spans")
    spans = spans.groupBy(F.col("doc_id").alias(own_key), F.col("text_hash").alias(own_hash)).agg(F.collect_list(F.expr("shiftleft(bigint(start), 32) | stop")).alias(packed))
    same = docs[key].cast("long").eqNullSafe(F.col(own_key)) & (F.hash(docs[text]) == F.col(own_hash))
    joined = docs.join(spans, same, "left").drop(own_key, own_hash)
    others = [f for f in docs.schema.fields if f.name != text]
    kinds = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType(), "kept_sha256": T.StringType()}
    arrow = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "kept_sha256": pa.string()}
    schema = T.StructType([*others, *(T.StructField(o, kinds[o]) for o in outputs)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, text):
                out: dict[str, list] = {o: [] for o in outputs}
                for t, s in zip(batch.column(text).to_pylist(), batch.column(packed), strict=True):
                    words = (t or "").encode().split()
                    n, kept = len(words), words
                    if s.is_valid and n:
                        held = s.values.to_numpy()
                        begins = np.minimum(held >> 32, n)
                        ends = np.minimum((held & 0xFFFFFFFF) + window, n)
                        depth = np.cumsum(np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n]
                        kept = [words[i] for i in np.flatnonzero(depth == 0)]
                    for name, make in (
                        ("n_words", lambda: n),
                        ("n_removed", lambda: n - len(kept)),
                        ("kept_text", lambda: t if len(kept) == n else b" ".join(kept).decode()),
                        ("kept_sha256", lambda: hashlib.sha256(b" ".join(kept)).hexdigest()),
                    ):
                        if name in out:
                            out[name].append(make())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), *(pa.array(out[o], arrow[o]) for o in outputs)], names=schema.names)

    return joined.mapInArrow(cut, schema)
