"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, every shard queried.

Vectors that are equal make one class. Classes are dealt to shards by hash; a task builds a shard's graph and
writes it with its vectors to the shared folder. A second set of tasks takes pairs of shards: the vectors of one
query the graph of the other (each unordered pair of shards once). Beams widen until an audit passes: of the links
that brute force finds for a sample of the queries and for perturbed copies of indexed vectors, turned away up to the
threshold, the searches must find all, or at the widest beam a share of LEAST_RECALL; a pair of shards that fails
there is answered by exact products. A query whose beam holds nothing but links is asked again with a wider one; one
with more links than DENSE is answered by exact products, block by block. Nodes that no path of the graph reaches are
kept in a list that every query looks through. Cosines are verified in double precision, by one routine.

A task holds at most PAIRS links of sparse queries and one block of a dense query's product at a time, and returns
counts of links and a spanning forest, so a group of near copies never has all its pairs in memory. Counting the
links of each member of such a group takes work in proportion to members times vectors, in products of matrices.

Shards hold a bounded number of vectors, so a task's memory is bounded; vectors grow beyond that by more shards, and
the longer the vectors, the fewer a shard holds. What the driver sees is a row per shard and per vector length.

Cases: null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
different lengths don't link; repeated rows are other vectors with cosine 1; a vec_id that names different vectors
gives each of its rows that row's own count; a null id counts as a vector, its component is the smallest id reachable
(null if there is none, and then the row is kept); other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.components import connected_components
from vigilspark.llm.simhash import forest
from vigilspark.llm.util import arrow_folder, checkpointed, discard, fresh_path

#: Vectors of a shard; fewer shards than LEAST_SHARDS only where they would hold under LEAST_ROWS vectors.
SHARD_ROWS, LEAST_SHARDS, LEAST_ROWS = 200_000, 8, 400
#: Bytes of a shard's vectors in double precision, so that long vectors make smaller shards.
SHARD_BYTES = 128 << 20
#: Links of a node (twice as many on the ground layer), beam while building, beams to begin with and at the widest.
M, BUILD_BEAM, BEAM, WIDEST = 12, 48, 24, 192
#: Audits: perturbed copies, sampled queries, the share of their links to be found at the widest beam.
AUDIT, AUDIT_QUERIES, LEAST_RECALL = 256, 256, 0.99
#: Nodes of the beam that are expanded at once.
EXPAND = 4
#: Links of one query beyond which it is answered by exact products; links of sparse queries that a task holds.
DENSE, PAIRS = 256, 16_000_000
#: Entries of a block of an exact product; new links that a full neighbour list weighs at once.
BLOCK, WEIGHED = 4_000_000, 48
#: Tasks that pairs of shards are dealt to, at most.
MOST_TASKS = 20_000


class Hnsw:
    """Layers of adjacency lists over unit vectors, built and searched for many vectors at once."""

    def __init__(self, x: np.ndarray, seed: int = 42):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 8) if n else np.zeros(0, int)
        order = np.argsort(-level, kind="stable")  # upper layers first: whoever comes later finds them complete
        self.level = level
        top = int(level.max()) if n else 0
        self.links = [np.full((n, 2 * M if layer == 0 else M), -1, np.int32) for layer in range(top + 1)]
        self.entry = int(order[0]) if n else -1
        self.top = top
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(done, 256, self._most(n)))]
            self._insert(batch)
            done += len(batch)

    @staticmethod
    def _most(n: int) -> int:
        return max(16, (16 << 20) // max(n, 1))

    def _insert(self, batch: np.ndarray) -> None:
        q = self.x[batch]
        entry = np.full((len(batch), 1), self.entry)
        among = q @ q.T
        for layer in range(self.top, -1, -1):
            here = self.level[batch] >= layer
            ids, sims = self._beam(q, entry, layer, BUILD_BEAM if here.any() else 1)
            entry = ids[:, :1]
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            # the batch's own members see each other by brute force
            near = np.argsort(-among[rows][:, rows], axis=1, kind="stable")[:, 1 : 1 + M]
            own_ids = batch[rows][near]
            own_sims = np.take_along_axis(among[rows][:, rows], near, axis=1)
            ids2, sims2 = np.concatenate([ids[rows], own_ids], 1), np.concatenate([sims[rows], own_sims], 1)
            at = np.argsort(-sims2, axis=1, kind="stable")
            ids2, sims2 = np.take_along_axis(ids2, at, 1), np.take_along_axis(sims2, at, 1)
            chosen = self._diverse(ids2, sims2, M)
            width = self.links[layer].shape[1]
            links = self.links[layer]
            links[batch[rows], :M] = chosen
            self._link_back(links, np.repeat(batch[rows], M), chosen.ravel().astype(np.int64))

    def _link_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Adds the sources to their targets' lists; full lists keep the diverse ones of all."""
        fresh = target >= 0
        fresh &= ~(links[np.maximum(target, 0)] == source[:, None]).any(1)
        source, target = source[fresh], target[fresh]
        if not len(source):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        count = np.diff(np.r_[heads, len(target)])
        place = np.arange(len(target)) - np.repeat(heads, count)
        node, width = target[heads], links.shape[1]
        used = (links[node] >= 0).sum(1)
        room = np.repeat(used + count <= width, count)
        # lists are filled from the left, so free slots follow the used ones
        links[target[room], (np.repeat(used, count) + place)[room]] = source[room]
        full = np.flatnonzero(used + count > width)
        full = full[np.argsort(count[full], kind="stable")]
        while len(full):
            most = int(count[full[0]])
            step = max(1, BLOCK // ((width + 4 * most) * self.x.shape[1]))
            part = full[:step]
            part = part[count[part] <= 4 * most]
            full = full[len(part) :]
            new = np.full((len(part), int(count[part].max())), -1, np.int64)
            for k, g in enumerate(part.tolist()):
                new[k, : count[g]] = source[heads[g] : heads[g] + count[g]]
            held = np.concatenate([links[node[part]].astype(np.int64), new], 1)
            sims = np.matmul(self.x[np.maximum(held, 0)], self.x[node[part]][:, :, None])[:, :, 0]
            sims = np.where(held >= 0, sims, -np.inf)
            best = np.argsort(-sims, axis=1, kind="stable")[:, : width + WEIGHED]
            links[node[part]] = self._diverse(np.take_along_axis(held, best, 1), np.take_along_axis(sims, best, 1), width)

    def strays(self) -> np.ndarray:
        """Nodes that no path on the ground layer reaches from where searches start there."""
        n = len(self.x)
        reached = np.zeros(n + 1, bool)
        reached[n] = True
        front = np.flatnonzero(self.level >= 1) if self.top else np.array([self.entry][:n])
        while len(front):
            reached[front] = True
            around = np.unique(self.links[0][front])
            front = around[~reached[around]]
        return np.flatnonzero(~reached[:n])

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates sorted by similarity: those nearer to the vector than to any chosen before; then the nearest others."""
        b, c = ids.shape
        v = self.x[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        usable = (ids >= 0) & np.isfinite(sims)
        chosen = np.zeros((b, c), bool)
        for k in range(c):
            ok = usable[:, k] & (chosen.sum(1) < most)
            ok &= ~((between[:, k] >= sims[:, k : k + 1]) & chosen).any(1)
            chosen[:, k] = ok
        room = max(1, most // 4)  # a few of the nearest others keep dense groups connected
        rank = np.where(chosen, 0, 1 + np.cumsum(usable & ~chosen, axis=1))
        rank = np.where(usable & (rank <= room), rank, c + 2)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        got = np.take_along_axis(ids, order, 1)
        got = np.where(np.take_along_axis(rank, order, 1) <= room, got, -1)
        if got.shape[1] < most:
            got = np.pad(got, ((0, 0), (0, most - got.shape[1])), constant_values=-1)
        return got.astype(np.int32)

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        b, n = len(q), len(self.x)
        rows = np.arange(b)[:, None]
        links = self.links[layer]
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        ids = np.full((b, ef), n, np.int64)
        sims = np.full((b, ef), -np.inf, np.float32)
        k = min(entry.shape[1], ef)
        ids[:, :k] = entry[:, :k]
        sims[:, :k] = np.einsum("bd,bkd->bk", q, self.x[entry[:, :k]])
        seen[rows, ids] = True
        open_ = sims > -np.inf
        live = np.arange(b)
        step = min(EXPAND, ef)
        while len(live):
            s = np.where(open_[live], sims[live], -np.inf)
            at = np.argsort(-s, axis=1, kind="stable")[:, :step]
            good = np.take_along_axis(s, at, 1) > -np.inf
            live = live[good.any(1)]
            at, good = at[good.any(1)], good[good.any(1)]
            if not len(live):
                break
            r = live[:, None]
            open_[r, at] &= ~good
            around = links[np.where(good, ids[r, at], 0)].astype(np.int64)
            around = np.where(good[:, :, None] & (around >= 0), around, n).reshape(len(live), -1)
            around.sort(axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = n
            around = np.where(seen[r, around], n, around)
            seen[r, around] = True
            new = np.einsum("bd,bkd->bk", q[live], self.x[np.minimum(around, n - 1)])
            new = np.where(around == n, -np.inf, new)
            all_ids, all_sims = np.concatenate([ids[live], around], 1), np.concatenate([sims[live], new], 1)
            all_open = np.concatenate([open_[live], new > -np.inf], 1)
            best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[live], sims[live], open_[live] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_sims, all_open))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, ids, -1), sims

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The beams (ids, similarities; -1 and -inf where there is none) of unit vectors q."""
        q = np.ascontiguousarray(q, np.float32)
        out = []
        for part in np.array_split(q, max(1, -(-len(q) // self._most(len(self.x) * max(1, ef // 64))))):
            entry = np.full((len(part), 1), self.entry)
            for layer in range(self.top, 0, -1):
                entry = self._beam(part, entry, layer, 4)[0][:, :1]
            out.append(self._beam(part, entry, 0, min(ef, max(1, len(self.x)))))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def perturbed(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors turned away from x, evenly between the threshold and x itself."""
    if x.shape[1] < 2:
        return x
    away = rng.standard_normal(x.shape)
    away = unit(away - (away * x).sum(1, keepdims=True) * x)
    c = rng.uniform(cosine, 1.0, (len(x), 1))
    return unit(c * x + np.sqrt(1 - c * c) * away)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with the same row of b."""
    return (a * b).sum(1)


def within(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b have a cosine of at least the threshold: a product, settled by `cosines` where it is close."""
    s = a @ b.T
    near = s >= threshold
    i, j = np.nonzero(np.abs(s - threshold) < 1e-9)
    near[i, j] = cosines(a[i], b[j]) >= threshold
    return near


class Shard:
    """A graph with its vectors in double precision, the ids and sizes of their classes and the nodes off all paths."""

    def __init__(self, index: Hnsw, x: np.ndarray, node: np.ndarray, size: np.ndarray, strays: np.ndarray):
        self.index, self.x, self.node, self.size, self.strays = index, x, node, size, strays

    @staticmethod
    def build(x: np.ndarray, node: np.ndarray, size: np.ndarray) -> Shard:
        index = Hnsw(x)
        return Shard(index, x, node, size, index.strays())

    def save(self, folder: str, name: str) -> None:
        held, index = io.BytesIO(), self.index
        links = {f"links{k}": v for k, v in enumerate(index.links)}
        np.savez(held, x=self.x, node=self.node, size=self.size, strays=self.strays, level=index.level, top=np.array(index.top), entry=np.array(index.entry), **links)
        fs, top = arrow_folder(folder)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{name}") as f:
            f.write(held.getbuffer())

    @staticmethod
    def load(folder: str, name: str) -> Shard:
        """A missing file is an error: an empty shard has no name in the manifest."""
        fs, top = arrow_folder(folder)
        with fs.open_input_file(f"{top}/{name}") as f, np.load(io.BytesIO(f.read())) as z:
            parts = dict(z)
        index = Hnsw.__new__(Hnsw)
        index.x = parts["x"].astype(np.float32)
        index.level, index.top, index.entry = parts["level"], int(parts["top"]), int(parts["entry"])
        index.links = [parts[f"links{k}"] for k in range(index.top + 1)]
        return Shard(index, parts["x"], parts["node"], parts["size"], parts["strays"])

    def sparse_links(self, q: np.ndarray, threshold: float, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, indexed vector) found by the graph, and the queries left to exact products."""
        n = len(self.x)
        most = max(BEAM, min(DENSE, PAIRS // max(len(q), 1)))
        i, j, dense, rows = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)], np.arange(len(q))
        while len(rows):
            again = [np.zeros(0, int)]
            for part in np.array_split(rows, max(1, -(-len(rows) * ef // 200_000))):
                ids, sims = self.index.search(q[part], ef)
                maybe = sims >= threshold - 1e-4
                full = maybe.all(1) & (ids.shape[1] < n)
                again.append(part[full])
                r, c = np.nonzero(maybe & ~full[:, None])
                r, c = part[r], ids[r, c]
                if len(self.strays):
                    a, b = np.nonzero(q[part[~full]].astype(np.float32) @ self.index.x[self.strays].T >= threshold - 1e-4)
                    codes = np.unique(np.concatenate([r * n + c, part[~full][a] * n + self.strays[b]]))
                    r, c = codes // n, codes % n
                for at in np.array_split(np.arange(len(r)), len(r) // 100_000 + 1):
                    exact = cosines(q[r[at]], self.x[c[at]]) >= threshold
                    i.append(r[at][exact])
                    j.append(c[at][exact])
            rows, ef = np.concatenate(again), 2 * ef
            if ef > most or ef >= n:
                dense.append(rows)
                break
        return np.concatenate(i), np.concatenate(j), np.concatenate(dense)

    def audited_beam(self, q: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[int, float]:
        """The beam from which on the sample's links are found, and the share that was; beam 0: ask by exact products."""
        asked = q[rng.choice(len(q), min(len(q), AUDIT_QUERIES), replace=False)]
        asked = np.concatenate([asked, perturbed(self.x[rng.choice(len(self.x), min(len(self.x), AUDIT), replace=False)], threshold, rng)])
        truth = np.concatenate([within(part, self.x, threshold).sum(1) for part in np.array_split(asked, max(1, len(asked) * len(self.x) // BLOCK))])
        ef, some = BEAM, truth > 0
        while ef < len(self.x):
            i, _, dense = self.sparse_links(asked, threshold, ef)
            found = np.bincount(i, minlength=len(asked))
            found[dense] = truth[dense]
            recall = float((found[some] / truth[some]).mean()) if some.any() else 1.0
            if recall >= 1.0 or (ef >= WIDEST and recall >= LEAST_RECALL):
                return ef, recall
            if ef >= WIDEST:
                break
            ef *= 2
        return 0, 1.0

    def fold(self, mine: Shard, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Counts of links and component labels of the other shard's nodes followed by this one's (of this shard's own
        where the two are the same), and how many queries were answered by exact products."""
        same, q, n = mine is self, mine.x, len(self.x)
        i, j, dense = self.sparse_links(q, threshold, beam) if beam else (np.zeros(0, int), np.zeros(0, int), np.arange(len(q)))
        offset = 0 if same else len(q)
        count = np.zeros(offset + n, np.int64)
        if same:
            i, j = i[i != j], j[i != j]
            held = np.sort(i * n + j)
            is_dense = np.zeros(n, bool)
            is_dense[dense] = True

        def unseen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Whether sparse a, asked itself, has missed b."""
            code = a * n + b
            at = np.minimum(np.searchsorted(held, code), max(len(held) - 1, 0))
            return held[at] != code if len(held) else np.ones(len(code), bool)

        def add(node: np.ndarray, size: np.ndarray) -> None:
            count[:] += np.bincount(node, size, len(count)).astype(np.int64)

        def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            add(i, self.size[j])
            if same:
                missed = ~is_dense[j]
                missed[missed] = unseen(j[missed], i[missed])
                add(j[missed], self.size[i[missed]])
            else:
                add(j + offset, mine.size[i])
            yield i, j + offset
            for rows in np.array_split(dense, max(1, -(-len(dense) * n // BLOCK))):
                if not len(rows):
                    continue
                near = within(q[rows], self.x, threshold)
                if same:
                    near[np.arange(len(rows)), rows] = False
                r, c = np.nonzero(near)
                r = rows[r]
                add(r, self.size[c])
                if same:
                    missed = ~is_dense[c]
                    missed[missed] = unseen(c[missed], r[missed])
                    add(c[missed], self.size[r[missed]])
                else:
                    add(c + offset, mine.size[r])
                yield r, c + offset

        label = forest(len(count), links())
        return count, label, len(dense)


_FOUND = "node long, n long, label long, query long, shard long, beam long, recall double, exact long"


def searched(classes: DataFrame, threshold: float) -> DataFrame:
    """classes: node, size, dim, embedding. Returns node, n (links to members of other classes found by one task), label
    (a node of the same component); and for each pair of shards a row without a node: its beam (0: exact products), the
    audited recall and how many queries were answered by exact products."""
    spark = classes.sparkSession
    folder = fresh_path(spark, "hnsw")
    n = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {d: max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * d))) for d in n}
    shards = {d: max(min(LEAST_SHARDS, c // LEAST_ROWS), -(-c // most[d]), 1) for d, c in n.items()}
    if not shards:
        return spark.createDataFrame([], _FOUND)

    def build(key: tuple, group: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in key)
        order = np.argsort(group.column("node").to_numpy(), kind="stable")
        x = np.array(group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        x = unit(x / np.abs(x).max(1, keepdims=True))[order]
        name = f"{dim}-{shard}-{uuid.uuid4().hex}"  # an attempt's own; the rows collected below are the manifest
        Shard.build(x, group.column("node").to_numpy()[order], group.column("size").to_numpy()[order]).save(folder, name)
        return pa.table({"dim": pa.array([dim], pa.int64()), "name": [name]})

    count = F.create_map(*(F.lit(v) for d, s in shards.items() for v in (d, s)))[F.col("dim")]
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("node"), count))
    names: dict[int, list[str]] = {}
    for row in sorted(dealt.groupBy("dim", "shard").applyInArrow(build, "dim long, name string").collect()):
        names.setdefault(row["dim"], []).append(row["name"])
    dims = list(names)
    ends = list(accumulate(len(names[d]) * (len(names[d]) + 1) // 2 for d in dims))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, Shard | None] = ("", None)
        for batch in batches:
            for at in batch.column("id").to_pylist():
                k = next(k for k, end in enumerate(ends) if at < end)
                own, at = names[dims[k]], at - (ends[k - 1] if k else 0)
                shard = int(((8 * at + 1) ** 0.5 - 1) / 2)
                shard += (shard + 1) * (shard + 2) // 2 <= at
                shard -= shard * (shard + 1) // 2 > at
                query = at - shard * (shard + 1) // 2
                theirs = held[1] if held[0] == own[shard] else Shard.load(folder, own[shard])
                held = (own[shard], theirs)
                mine = theirs if query == shard else Shard.load(folder, own[query])
                beam, recall = theirs.audited_beam(mine.x, threshold, np.random.default_rng(query))
                links, label, exact = theirs.fold(mine, threshold, beam)
                node = theirs.node if mine is theirs else np.concatenate([mine.node, theirs.node])
                has = np.flatnonzero(links)
                none = lambda kind, m=len(has): pa.nulls(m, kind)
                whole, real = pa.int64(), pa.float64()
                yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(links[has]), pa.array(node[label[has]]), none(whole), none(whole), none(whole), none(real), none(whole)], names=_NAMES)
                report = [pa.array([v], t) for v, t in ((None, whole), (None, whole), (None, whole), (query, whole), (shard, whole), (beam, whole), (recall, real), (exact, whole))]
                yield pa.RecordBatch.from_arrays(report, names=_NAMES)

    found = checkpointed(spark.range(0, ends[-1], 1, min(ends[-1], MOST_TASKS)).mapInArrow(ask, _FOUND))
    discard(spark, folder)
    return found


_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", embedding: str = "embedding", audits: str | None = None) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept.

    audits: a folder for the beam and audited recall of each pair of shards, as Parquet."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    fine = F.size(e) > 0
    fine &= ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    keyed = rows.withColumn("k1", F.when(F.col("fine"), F.xxhash64(e))).withColumn("k2", F.when(F.col("fine"), F.xxhash64(F.lit(1), F.reverse(e))))
    classes = keyed.where("fine").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding"))
    path = fresh_path(spark, "vectors")
    classes.select(F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dim"), "*").write.parquet(path)
    classes = spark.read.parquet(path)
    found = searched(classes.select("node", "size", "dim", "embedding"), threshold)
    if audits:
        found.where("node is null").select("query", "shard", "beam", "recall", "exact").write.parquet(audits)
    links = found.where("node is not null")
    reached = connected_components(links.select(F.col("node").alias("a"), F.col("label").alias("b")))
    links = links.groupBy("node").agg(F.sum("n").alias("n"))
    ids = classes.select("node", "k1", "k2", "size", "least")
    least = ids.join(reached, "node").groupBy("component").agg(F.min("least").alias("smallest"))
    reached = reached.join(least, "component").select("node", "smallest")
    named = ids.join(links, "node", "left").join(reached, "node", "left")
    named = checkpointed(named.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id")))
    discard(spark, path)
    out = keyed.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
