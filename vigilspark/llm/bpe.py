"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each word. A word's proposal is its BPE encoding
exactly if every adjacent pair of proposed tokens encodes to itself, so vectorised compatibility
checks test all pairs of all new words at once; only words with a failing pair undergo exact
merging. Words recur, so their tokens are kept in a cache of bounded size.

Cases: a null text is encoded like an empty one (no tokens); rows, ties and repeated rows are
independent of each other; other columns pass or are dropped by name; an empty table gives an
empty table. Very long words leave the cache alone and are merged with a heap in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from vigilspark.llm.util import steps

_NO_RANK = np.int64(1) << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b], extra = chr(256 + extra), extra + 1
    return table


class WordBpe:
    """A tokenizer read from a tokenizers-library file: NFC, lower case, split, byte-level BPE with word ends."""

    CACHE_WORDS = 100_000
    CACHE_LENGTH = 48

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rules = Tokenizer.from_file(path)  # for its normaliser and its split only
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token: list[str] = [""] * self.size
        for text, i in chain(self.vocab.items(), self.special.items()):
            self.token[i] = text
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.specials = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.symbols = byte_symbols()
        self._rank_tables(merges)
        self.decimal = np.array([str(i) for i in range(self.size)], dtype=object)
        self.texts = np.array(self.token, dtype=object)
        self.gaps = "" in self.token
        self.words: dict[bytes, bytes] = {}  # packed ids
        self.older: dict[bytes, bytes] = {}
        self.speculated = self.merged = 0

    # -- tables -----------------------------------------------------------------------------

    def _rank_tables(self, merges: list[list[str]]) -> None:
        v = self.vocab
        n = self.size
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        twice = np.zeros(n, bool)
        for r, (a, b) in enumerate(merges):
            whole = a + b
            if a not in v or b not in v or whole not in v:
                continue
            x, y, z = v[a], v[b], v[whole]
            if (x, y) in self.merge:
                continue
            self.merge[x, y] = (r, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
            else:
                twice[z] = True
        keys = np.array([x * n + y for x, y in self.merge], np.int64)
        ranks = np.array([r for r, _ in self.merge.values()], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        # A token can be proposed if its own text encodes to it; others only arise inside exact merging.
        atoms = [s for c in self.symbols for s in (c, c + self.suffix)]
        sound = np.zeros(n, bool)
        sound[[v[s] for s in atoms if s in v]] = True
        made = np.flatnonzero(self.rank >= 0)
        whole = np.zeros(n, bool)
        whole[made] = self._compatible(self.left[made], self.right[made], self.rank[made])
        for z in made[np.argsort(self.rank[made])]:
            sound[z] = whole[z] and sound[self.left[z]] and sound[self.right[z]] and not twice[z]
        self.sound = sound
        self.greedy = {t: i for t, i in v.items() if sound[i]}
        # how far a proposal that begins with these symbols can reach
        self.reach: dict[str, int] = {}
        for t in self.greedy:
            n_symbols = len(t) - len(self.suffix) if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix) else len(t)
            if self.reach.get(t[:3], 0) < n_symbols > 2:
                self.reach[t[:3]] = n_symbols

    def _compatible(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of adjacent tokens encodes to itself, by undoing merges next to the
        boundary from the latest back: no merge across it may come before those that were made.
        own: ranks of the merges that joined the pairs, for whole tokens; these don't count as crossing."""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), _NO_RANK) if own is None else own.astype(np.int64).copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = np.minimum(np.searchsorted(self.pair_keys, x * self.size + y), len(self.pair_keys) - 1)
            crossing = np.where(self.pair_keys[at] == x * self.size + y, self.pair_ranks[at], _NO_RANK)
            fails = crossing < limit[live]
            good[live[fails]] = False
            undo_left = self.rank[x] > self.rank[y]
            done = fails | ((self.rank[x] < 0) & (self.rank[y] < 0))
            limit[live] = np.where(undo_left, self.rank[x], self.rank[y] + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~done]
        return good

    # -- one piece ---------------------------------------------------------------------------

    def propose(self, piece: str) -> list[int]:
        """Greedy longest match from the left over a piece in byte symbols."""
        got, at, n, find, reach = [], 0, len(piece), self.greedy, self.reach
        while at < n:
            end = min(n, at + reach.get(piece[at : at + 3], 2))
            if end == n and (i := find.get(piece[at:] + self.suffix)) is not None:
                got.append(i)
                break
            end = end - 1 if end == n else end
            while end > at and (i := find.get(piece[at:end])) is None:
                end -= 1
            if end == at:  # the last symbol's word-end form alone is out of the vocabulary
                return []
            got.append(i)
            at = end
        return got

    def exact(self, piece: str) -> list[int]:
        """Merges the lowest-ranked pair, leftmost first, until none is left."""
        ids = [self.vocab.get(s) for s in [*piece[:-1], piece[-1] + self.suffix]] if piece else []
        ids = [i for i in ids if i is not None]
        n = len(ids)
        if n <= 32:
            return self._exact_short(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := self.merge.get((z, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, z, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := self.merge.get((ids[before[i]], z))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], z, m[1]))
        return [i for i in ids if i >= 0]

    def _exact_short(self, ids: list[int]) -> list[int]:
        none, merge = (1 << 60, -1), self.merge
        pairs = [merge.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = merge.get((ids[i], ids[i + 1]), none)
            if i:
                pairs[i - 1] = merge.get((ids[i - 1], ids[i]), none)
        return ids

    # -- many words --------------------------------------------------------------------------

    def split(self, word: str) -> list[str | int]:
        """Pieces of a stretch without ASCII white space, in byte symbols; special tokens as ids."""
        out: list[str | int] = []
        parts = [word]
        if self.specials and "<" in word and self.specials.search(word):
            parts = [p for p in self.specials.split(word) if p]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            if max(part) > "\u024f":  # Unicode tables differ between versions: the file's own rules decide
                out += [p for p, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(part))]
                continue
            plain = unicodedata.normalize("NFC", part).lower()
            if plain.isascii() and plain.isprintable():
                out += self.pieces(plain)
            else:
                out += ["".join([self.symbols[b] for b in p.encode()]) for p in self.pieces(plain)]
        return out

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of words: proposals, a vectorised test of all their adjacent pairs, exact merging of the rest."""
        split = [self.split(w.decode()) for w in words]
        new = list({p for s in split for p in s if isinstance(p, str)})
        proposed = [self.propose(p) for p in new]
        flat = np.fromiter(chain.from_iterable(proposed), np.int64)
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        ends = np.cumsum(counts)
        failing = counts == 0
        if len(flat) > 1:
            inner = np.ones(len(flat) - 1, bool)
            inner[ends[(ends > 0) & (ends < len(flat))] - 1] = False
            at = np.flatnonzero(inner)
            pairs, back = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
            good = self._compatible(pairs // self.size, pairs % self.size)[back]
            failing[np.searchsorted(ends, at[~good], side="right")] = True
        for i in np.flatnonzero(failing):
            proposed[i] = self.exact(new[i])
        self.speculated += len(new)
        self.merged += int(failing.sum())
        tokens = dict(zip(new, proposed, strict=True))
        return [tuple(chain.from_iterable((p,) if isinstance(p, int) else tokens[p] for p in s)) for s in split]

    def encode_batch(self, texts: Iterable[bytes]) -> list[np.ndarray]:
        """Token ids of whole texts in UTF-8."""
        # ASCII capitals differ in nothing but special tokens; fewer distinct words
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        now = self.words
        missing = set().union(*split).difference(now) if split else set()
        if missing:
            kept = {w: self.older[w] for w in missing if w in self.older}
            now.update(kept)
            fresh = [w for w in missing if w not in kept]
            for at in range(0, len(fresh), 20_000):
                part = fresh[at : at + 20_000]
                now.update(zip(part, [struct.pack(f"<{len(i)}i", *i) for i in self.encode_words(part)], strict=True))
        ids = [np.frombuffer(b"".join(map(now.__getitem__, s)), "<i4") for s in split]
        if any(len(w) > self.CACHE_LENGTH for w in missing):
            for w in [w for w in missing if len(w) > self.CACHE_LENGTH]:
                del now[w]
        if len(now) > self.CACHE_WORDS:  # two generations: what recurs moves on, the rest goes
            self.older, self.words = now, {}
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decode without a decoder: tokens joined by one space, special ones too; unknown ids are left out."""
        at = np.asarray(ids, np.int64)
        known = (at >= 0) & (at < self.size)
        texts = self.texts[at if known.all() else at[known]].tolist()
        return " ".join([t for t in texts if t] if self.gaps else texts)


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One tokenizer for each file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with any of: n_tokens, ids, decoded (decoded from the ids again),
    ids_sha256 (hex of the decimal ids joined by one space), decoded_sha256 (hex of the decoded text).

    No shuffle: documents are encoded where they are read. Null texts count as empty."""
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    kind = next(f.dataType for f in docs.schema.fields if f.name == key)
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(o, kinds[o]) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        for whole in batches:
            for batch in steps(whole, text):
                texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
                ids = bpe.encode_batch(texts)
                columns = {"n_tokens": [len(i) for i in ids]}
                if "ids" in outputs:
                    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                if "ids_sha256" in outputs:
                    decimal = bpe.decimal
                    columns["ids_sha256"] = [hashlib.sha256(" ".join(decimal[i].tolist()).encode()).hexdigest() for i in ids]
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    decoded = [bpe.decode(i) for i in ids]
                    columns["decoded"] = decoded
                    columns["decoded_sha256"] = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
                yield pa.RecordBatch.from_arrays([batch.column(key), *(columns[o] if isinstance(columns[o], pa.Array) else pa.array(columns[o], arrow[o]) for o in outputs)], names=[key, *outputs])

    return docs.select(key, text).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of token ids, as the library's decode(ids, skip_special_tokens=False); null ids decode to null."""
    kind = next(f.dataType for f in encoded.schema.fields if f.name == key)
    schema = T.StructType([T.StructField(key, kind), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            decoded = [None if i is None else bpe.decode(i) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(decoded, pa.string())], names=[key, "decoded"])

    return encoded.select(key, ids).mapInArrow(run, schema)
