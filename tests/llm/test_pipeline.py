"""The pipeline against a brute-force version of its stages."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_operators import DOCS, LONG, PATH, plain_languages, plain_targets, prints, reach, split, without_repeats
from vigilspark.llm import language_id, mixing, near_copies

DIR = "/root/testdata/sf0.001"


def five_word_runs(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_copies(docs):
    """How often a mix of whole documents takes each: blocks of the sources' shuffled words under golden-ratio slots."""
    size = {i: len(split(r.text)) for i, r in docs.items()}
    total = Counter()
    for i, r in docs.items():
        total[r.source] += size[i]
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    target = plain_targets(total)
    blocks = {s: min(total[s], max(-(-total[s] // mixing.BLOCK_WORDS), mixing.LEAST_BLOCKS)) for s in names}
    want = {s: target[s] * blocks[s] / total[s] if blocks[s] else 0.0 for s in names}
    ends, at = {}, 0.0
    for s in names:
        at += want[s]
        ends[s] = at
    taken = {s: [] for s in names}
    for slot in range(round(at)):
        u = (slot + 0.5) * mixing.GOLDEN
        u -= math.floor(u)
        s = next(s for s in names if u < ends[s] / at)
        taken[s].append(len(taken[s]))
    times = {s: Counter(t % blocks[s] for t in turns if t < 2 * blocks[s]) for s, turns in taken.items()}

    def place(i, r):
        parts = ["42", f"={i}", hashlib.md5((r.text or "").encode()).hexdigest(), "" if r.source is None else f"={r.source}"]
        return hashlib.md5(":".join(parts).encode()).hexdigest()

    out = {}
    for s in names:
        q, rest = divmod(total[s], max(blocks[s], 1))
        start = 0
        for i, r in sorted(((i, r) for i, r in docs.items() if r.source == s), key=lambda x: place(*x)):
            if size[i]:
                block = start // (q + 1) if start < rest * (q + 1) else rest + (start - rest * (q + 1)) // max(q, 1)
                if times[s][block]:
                    out[i] = times[s][block]
            start += size[i]
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = out.collect()
        if name == "language ID":
            fused = plain_languages([(i, r.text, (r.lang or "").lower(), r.source) for i, r in before.items()])
            good = {i for i, (lang, p) in fused.items() if lang != "und" and p >= language_id.LEAST}
            assert {r.doc_id for r in rows} == good and len(good) >= 0.97 * len(before)
        if name == "SimHash near-dedup":
            ids = sorted(before)
            fp = [prints(before[i].text) for i in ids]
            runs = [five_word_runs(before[i].text) for i in ids]
            linked = lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2 or 5 * len(runs[i] & runs[j]) >= 4 * len(runs[i] | runs[j]) > 0
            least = reach([{j for j in range(len(ids)) if j != i and linked(i, j)} for i in range(len(ids))])
            assert sorted(r.doc_id for r in rows) == sorted({ids[x] for x in least})
        if name == "substring dedup":
            want = without_repeats([(i, r.text) for i, r in before.items()])
            assert {r.doc_id for r in rows} == {i for i, (n, gone, _) in want.items() if gone < n or n == 0}
            for r in rows:
                n, gone, digest = want[r.doc_id]
                assert hashlib.sha256(b" ".join(split(r.text))).hexdigest() == digest and r.n_chars == len(r.text)
                assert gone or r.text == before[r.doc_id].text
        if name == "source mix":
            copies = plain_copies(before)
            kept = {r.doc_id: 0 for r in rows}
            for r in rows:
                kept[r.doc_id] += 1
                assert r.text == before[r.doc_id].text
            assert kept == copies and max(kept.values()) <= 2
        if name == "BPE":
            t = Tokenizer.from_file(PATH)
            assert len(rows) == sum(kept.values())
            for r in rows:
                assert list(r.ids) == t.encode(before[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        else:
            assert out.columns == columns
        docs = out


def test_run(spark):
    a = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, DIR).collect())
    assert a == sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, DIR).collect()) and a


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0, name


def test_registered():
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and public_tokenizers.path(corpus_pipeline.TOKENIZER)
    assert sorted(int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))


def test_stages_take_odd_rows(spark, tmp_path):
    good = [f"the thing and the other {w} with some words of the text" for w in ("one", "two", "three")]
    rows = [(i, t, "en", "s", len(t), 1, 2, "q", "k", 3, 4, 5, 6) for i, t in enumerate([*good, LONG])]
    rows += [rows[0], (None, "a row without an id but with some words of the text", None, None, None, *[None] * 8), (7, None, None, None, None, *[None] * 8), (8, "", "en", "s", 0, *[None] * 8), (9, "12 34 56", "en", None, 8, *[None] * 8)]
    docs = spark.createDataFrame(rows, DOCS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name == "language ID":
            assert {r.doc_id for r in out.collect()} & {7, 8, 9} == set()
        if name != "BPE":
            assert out.columns == docs.columns
        docs = out


def test_stages_take_clashing_names_and_rows_without_ids(spark, tmp_path):
    """Columns named like the stages' own, a thousand rows without an id and a thousand of one id: each is judged by itself."""
    rng = random.Random(8)
    known = "the and of to in is that for it was on with as his they be at one have this".split()
    text = lambda: " ".join(rng.choice(known) + rng.choice(known) if rng.random() < 0.5 else rng.choice(known) for _ in range(40))
    names = ("_id", "copies", "_copy", "_key", "_spans", "_identity", "_number", "identity", "place", "row", "_hash")
    unlike = [text() for _ in range(2000)]
    rows = [(None, t, "en", "s", 1, *[k] * len(names)) for k, t in enumerate(unlike[:1000])] + [(5, t, "en", "t", 1, *[k] * len(names)) for k, t in enumerate(unlike[1000:])]
    rows += [(None, unlike[0], "en", "s", 1, *[9] * len(names))] * 300 + [(None, "", "en", "s", 0, *[9] * len(names))] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)).repartition(5)
    words = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        words[name] = out.selectExpr("sum(size(split(text, ' ')))").first()[0]
        assert out.columns == docs.columns
        if name == "language ID":
            assert out.where("text = ''").count() == 0 and out.count() >= 2200
        if name == "SimHash near-dedup":
            assert {r.text for r in out.collect()} == set(unlike) and out.count() == 2000
        if name == "substring dedup":
            assert out.count() == 2000
        docs = out
    assert words["source mix"] <= 2 * words["substring dedup"] and docs.count() <= 4000


@pytest.mark.parametrize("members", [4096, 7])
def test_near_copies_in_one_bucket(spark, monkeypatch, members):
    """Groups that share runs with one another without being alike: all links within, none between; by brute force."""
    monkeypatch.setattr(near_copies, "MEMBERS", members)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    common = [word() for _ in range(120)]
    texts = []
    for _ in range(12):  # groups alike in 120 of 190 words
        own = common + [word() for _ in range(70)]
        for _ in range(6):
            near = own.copy()
            near[rng.randrange(10, 180)] = word()
            texts.append(" ".join(near))
    runs = [five_word_runs(t) for t in texts]
    least = reach([{j for j in range(len(texts)) if j != i and 5 * len(runs[i] & runs[j]) >= 4 * len(runs[i] | runs[j])} for i in range(len(texts))])
    assert len(set(least)) == 12
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DIR).collect()} == set(least)


def test_similar():
    rng = np.random.default_rng(2)
    for _ in range(500):
        x, y = (np.unique(rng.integers(0, 30, rng.integers(1, 30)).astype(np.uint64)) for _ in range(2))
        assert near_copies.similar(x, y) == (5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y)))


@pytest.mark.parametrize("blocks", [1, 2])
def test_across_joins_what_is_similar(blocks):
    """Links join the components of all similar pairs (between the blocks, where there are two), and no others."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [str(rng.random()) for _ in range(150)]
        for _ in range(5):
            near = base.copy()
            for _ in range(rng.choice([1, 3, 6])):
                near[rng.randrange(150)] = str(rng.random())
            texts.append(" ".join(near).encode())
    sets = near_copies.run_sets(texts, 42)
    marks = near_copies.minima(sets)[1]
    n, own = len(texts), np.arange(len(texts)) % blocks
    component = np.arange(n) // 2 * 2
    group = pa.table({"node": np.arange(n), "component": component, "n": [len(s) for s in sets], "own": own, "marks": pa.array([m.tobytes() for m in marks], pa.binary()), "runs": pa.array([s.tobytes() for s in sets], pa.binary())})
    got = near_copies._across(group)
    pairs = list(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True))
    alike = {(i, j) for i in range(n) for j in range(i + 1, n) if near_copies.similar(sets[i], sets[j])}
    wanted = {(i, j) for i, j in alike if blocks == 1 or own[i] != own[j]}
    assert pairs and set(pairs) <= wanted and len(pairs) < n

    def merged(links):
        joined = [{j for j in range(n) if j != i and component[i] == component[j]} for i in range(n)]
        for i, j in links:
            joined[i].add(j)
            joined[j].add(i)
        return reach(joined)

    assert merged(pairs) == merged(wanted)


def test_near_copies_go(spark):
    """Five-word similarity of 0.8 or more, fingerprints beyond two bits; and pairs just under 0.8 stay."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts, kept = [], set()
    for k in range(40):
        base = [word() for _ in range(200)]
        near = base.copy()
        for at in range(10, 10 + (4 if k % 2 else 5) * 30, 30):
            near[at] = word()
        texts += [" ".join(base), " ".join(near)]
        sets = [{tuple(t[i : i + 5]) for i in range(196)} for t in (base, near)]
        alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8
        assert alike == bool(k % 2)
        kept |= {2 * k} if alike else {2 * k, 2 * k + 1}
    fp = [prints(t) for t in texts]
    assert all((fp[i] ^ fp[i + 1]).bit_count() > 2 for i in range(2, 80, 4))
    group = [word() for _ in range(200)]
    for k in range(30):  # each one word from the first
        texts.append(" ".join(group[: 5 * k] + [word()] + group[5 * k + 1 :]))
    kept.add(80)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DIR).collect()} == kept


def test_near_dedup_leaves_no_shuffle_files(spark):
    """The stage's many queries give their shuffle files back as they end, so that its disk is that of one of them."""
    import gc
    import time

    files = lambda: sum(str(b).startswith("shuffle_") for b in manager.getAllBlocks().mkString(",").split(","))
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    docs = spark.createDataFrame([(i, f"word{i % 7} two three four five six seven w{i % 11}") for i in range(60)], "doc_id long, text string")
    gc.collect()
    before = files()
    kept = near_copies.distinct_documents(docs)
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.5)
    assert files() <= before and kept.count() > 0
