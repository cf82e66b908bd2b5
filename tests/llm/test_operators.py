"""Each operator against a brute-force version on small tables, and on its odd cases: nulls in any column, empty and very
long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilspark.llm import bpe, chat, hnsw, language_id, mixing, order_minhash, queries, simhash, substring_dedup, token_files, url_filter, util
from vigilspark.llm.components import connected_components

DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, sig string, key string, row int, size int, block int, component_id int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [None, "", " \t\n", "one", "one", "a b", "The QUICK brown fox", "x" * 70_000, LONG, "émile Σ ΑΣ ǅ 日本語 <|endoftext|> it's", "dup " * 300, "\x00\x1c nul"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, clashing extra columns, texts of all kinds."""
    rows = [(i, t, None, None if i % 3 else "s", None, 1, 2, "q", "k", 3, 4, 5, 6) for i, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None, "a null id", None, None, None, *[None] * 8)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def split(t):
    return (t or "").encode().split()


# -- op1 -------------------------------------------------------------------------------------------


def bits(x):
    return x - (1 << 64) if x >> 63 else x


def signature(text, k=5, n_bins=64, keep=2):
    """The fingerprint from its definition. A k-mer's hash chains XXH64 over its words, each seeded by the one before."""
    words = split(text)
    if not words:
        return {}
    hashes = []
    for i in range(max(len(words) - k, 0) + 1):
        h = 42
        for w in words[i : i + k]:
            h = xxhash.xxh64_intdigest(w, h)
        hashes.append(bits(h))
    seen, picked = Counter(), defaultdict(list)
    for i, h in enumerate(hashes):
        top, c = h >> 31, seen[h >> 31]
        seen[top] += 1
        if c:
            x = xxhash.xxh64_intdigest(top.to_bytes(8, "little", signed=True), 42)
            x = xxhash.xxh64_intdigest(c.to_bytes(4, "little"), x)
            top = bits(x) >> 31
        picked[top >> (33 - 6)].append((top, i))
    out = {}
    for b, entries in picked.items():
        value = 42
        for _, i in sorted(sorted(entries)[:keep], key=lambda e: e[1]):
            value = xxhash.xxh64_intdigest(hashes[i].to_bytes(8, "little", signed=True), value)
        out[b + n_bins // 2] = value & 0xFFFF
    return out


def as_text(sig):
    return "".join(f"{b << 16 | v:06x}" for b, v in sorted(sig.items()))


def alike(a, b):
    either = a.keys() | b.keys()
    return 1.0 if not either else sum(a.get(x) == b.get(x) and x in a and x in b for x in either) / len(either)


def test_op1_brute_force(spark, texts):
    got = {r.doc_id: r for r in queries.op1_order_minhash(spark, DIR).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    sigs = {i: signature(t) for i, t in texts.items()}
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        n = len(texts[a])
        edited = texts[a][: n - n // 4] + texts[b][: n // 4]
        e, r = signature(edited), got[a]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (n, sha(edited), as_text(sigs[a]), as_text(e))
        assert math.isclose(r.near_edited, alike(sigs[a], e)) and math.isclose(r.near_next, alike(sigs[a], sigs[b]))
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.25 > 0.1 > np.mean([r.near_next for r in long])


def test_op1_order_counts(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    shuffled = [x for k in range(0, 400, 10) for x in words[390 - k : 400 - k]]
    df = order_minhash.with_signature(spark.createDataFrame([(" ".join(w),) for w in (words, moved, shuffled)], "text string"), "text", "s")
    a, b, c = ({x >> 16: x & 0xFFFF for x in r.s} for r in df.collect())
    assert alike(a, b) < 0.9 and alike(a, c) < alike(a, b)


def test_op1_odd(odd, empty):
    r = order_minhash.edited_fingerprints(odd).collect()
    assert len(r) == odd.count()
    assert len({x.fingerprint for x in r if x.doc_id == 3}) == 1
    one = order_minhash.edited_fingerprints(odd.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert order_minhash.edited_fingerprints(empty).count() == 0
    nothing = next(x for x in r if x.doc_id == 1)
    assert (nothing.n_chars, nothing.fingerprint, nothing.edited_sha256) == (0, "", sha(""))


def test_op1_next_over_many_ranges(spark):
    rng = random.Random(3)
    ids = sorted({rng.randint(-(10**15), 10**15) for _ in range(500)})
    df = spark.createDataFrame([(i, str(i)) for i in rng.sample(ids, len(ids))], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in order_minhash.with_next(df, ["text"], rows_per_task=20).collect()}
    assert got == {a: str(b) for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}


# -- op2 and op10 ------------------------------------------------------------------------------------


def test_op2_round_trip(spark, texts):
    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in queries.op2_bpe_round_trip(spark, DIR).collect()}
    for i, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_op2_odd(odd, empty):
    t = Tokenizer.from_file(PATH)
    enc = bpe.encode_documents(odd, PATH)
    by = {r.doc_id: list(r.ids) for r in enc.collect()}
    for i, text in enumerate(ODD):
        assert by[i] == t.encode(text or "", add_special_tokens=False).ids
    back = {r.doc_id: r.decoded for r in bpe.decode_documents(enc, PATH).collect()}
    assert back[6] == t.decode(by[6], skip_special_tokens=False) and back[0] == ""
    assert bpe.encode_documents(empty, PATH).count() == 0


def test_op2_speculation_is_exact():
    w, t = bpe.WordBpe(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    words = ["".join(rng.choice("aehinst") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    words += ["".join(rng.choice("abcdefghij'1.éßΣ<|>") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    words += ["a" + chr(c) + "b" + chr(c) * 2 for c in range(0x3000) if not chr(c).isspace()]
    mine = [i.tolist() for i in w.encode_batch([x.encode() for x in words])]
    assert mine == [e.ids for e in t.encode_batch(words, add_special_tokens=False)]
    assert 0 < w.merged < w.speculated
    # every accepted proposal is the exact merging's result, and every rejected one isn't
    pieces = list({p for x in words[:3000] for p in w.split(x) if isinstance(p, str)})
    exact = [w.exact(p) for p in pieces]
    for p, e in zip(pieces, exact, strict=True):
        g = np.array(w.propose(p))
        ok = bool(w._compatible(g[:-1], g[1:]).all())
        assert ok == (g.tolist() == e)


def test_op10_files(spark, docs, texts, tmp_path):
    t = Tokenizer.from_file(PATH)
    folder = str(tmp_path / "f")
    manifest = token_files.write_token_files(docs, folder, PATH, 2, parts=3).collect()
    got = {r.doc_id: r for r in token_files.read_token_files(spark, folder, 49408).collect()}
    start, flat = 0, []
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        flat.append(ids)
    parts = sorted(manifest)
    assert sum(p.n_ids for p in parts) == start and parts[0].base == 0
    at = 0
    for p in parts:
        assert p.base == sum(map(len, flat[:at]))
        assert token_files.ids_of(f"file:{folder}", p.name, p.base, 0, 49408).tolist() == flat[at]
        at += p.n_docs


def test_lower_casing_is_read_from_the_file():
    nfc, blank, lower = {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}
    assert token_files.lowers_first({"type": "Sequence", "normalizers": [nfc, blank, lower]}) and token_files.lowers_first(lower)
    other = {"type": "Replace", "pattern": {"String": "A"}, "content": "x"}
    assert not any(token_files.lowers_first(n) for n in (None, nfc, {"type": "Sequence", "normalizers": [other, lower]}))


def test_shared_folders(spark, tmp_path):
    """A path without a scheme, and one with, come to the same full address, which tasks open."""
    plain = util.qualified(spark, str(tmp_path))
    assert plain == util.qualified(spark, f"file:{tmp_path}") == f"file:{tmp_path}" and util.shared_dir(spark).startswith("file:/")
    fs, path = util.arrow_folder(plain)
    with fs.open_output_stream(f"{path}/x") as f:
        f.write(b"y")
    assert (tmp_path / "x").read_bytes() == b"y" and util.arrow_folder(f"file://{tmp_path}")[1] == path
    util.discard(spark, plain)
    assert not tmp_path.exists()


def test_op10_odd(spark, odd, empty):
    r = token_files.write_and_read(odd, PATH, 2).collect()
    assert len(r) == odd.count() and min(x.n_tokens for x in r) == 1
    null = next(x for x in r if x.doc_id is None)
    assert null.start == 0
    assert token_files.write_and_read(empty, PATH, 2).count() == 0


# -- op3 -------------------------------------------------------------------------------------------


def linked_classes(x, threshold):
    n = len(x)
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in x]
    links = [set() for _ in range(n)]
    for i, j in itertools.combinations(range(n), 2):
        if ok[i] and ok[j] and len(x[i]) == len(x[j]):
            a, b = np.array(x[i], np.float64), np.array(x[j], np.float64)
            if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def reach(links):
    out = list(range(len(links)))
    for i in range(len(links)):
        stack, seen = [i], {i}
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        out[i] = min(seen)
    return out


def test_op3_brute_force(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    links = linked_classes([r.embedding for r in rows], 0.95)
    least = reach(links)
    got = {r.vec_id: r for r in queries.op3_hnsw_near_dedup(spark, DIR).collect()}
    for k, r in enumerate(rows):
        g, first = got[r.vec_id], rows[least[k]].vec_id
        assert (g.n_links, g.component_id, g.kept) == (len(links[k]), first, first == r.vec_id)


def test_op3_odd(spark):
    v = [[1.0, 0.0], [2.0, 0.0], [1.0, 0.0], None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 1.0], [1.0, 0.0, 0.0], [0.31, 0.95]]
    schema = "vec_id long, embedding array<float>, label int, node int, size int, k1 long, dim int"
    rows = [(i, x, None, 1, 2, 3, 4) for i, x in enumerate(v)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    links = linked_classes(v, 0.95)
    assert got == {i: (len(links[i]), reach(links)[i], reach(links)[i] == i) for i in range(len(v))}
    assert hnsw.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_op3_repeated_and_null_ids(spark):
    """A vec_id that names two vectors gives each row its own count; null ids count, and are named by a linked vector."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [1.0, 0.02]), (None, [-1.0, 0.0]), (3, [0.01, 1.0]), (4, [0.0, 2.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0, True), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def dense_table(n, copies, noise, seed=0, dim=48):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(dim)
    x = hnsw.unit(np.concatenate([rng.standard_normal((n - copies, dim)), centre + noise * rng.standard_normal((copies, dim))]))
    rng.shuffle(x)
    return x


@pytest.mark.parametrize("noise", [0.02, 0.22])
def test_op3_a_third_near_copies(noise):
    """Tight groups, and loose ones that the threshold cuts through: counts and components as brute force has them."""
    x, y = dense_table(1800, 600, noise), dense_table(900, 300, noise)
    mine, theirs = (hnsw.Shard.build(v, np.arange(len(v)), np.ones(len(v), int)) for v in (y, x))
    for query in (theirs, mine):
        beam, recall = theirs.audited_beam(query.x, 0.95, np.random.default_rng(1))
        assert recall >= 0.99
        links, label, exact = theirs.fold(query, 0.95, beam)
        near = hnsw.within(query.x, x, 0.95)
        if query is theirs:
            np.fill_diagonal(near, False)
        truth = near.sum(1) if query is theirs else np.concatenate([near.sum(1), near.sum(0)])
        assert exact and links.sum() >= 0.999 * truth.sum() and (links <= truth).all()
        i, j = np.nonzero(near)
        assert (label == simhash.forest(len(truth), [(i, j + (0 if query is theirs else len(y)))])).mean() > 0.999


def test_op3_exact_products_agree(monkeypatch):
    """Queries answered by blocks of exact products count as those that the graph answers, whichever way a pair is found."""
    x = dense_table(700, 80, 0.1)
    shard = hnsw.Shard.build(x, np.arange(len(x)), np.arange(1, len(x) + 1))
    graph = shard.fold(shard, 0.95, 192)
    monkeypatch.setattr(hnsw, "BLOCK", 5000)
    for got in (shard.fold(shard, 0.95, 0), shard.fold(shard, 0.95, 24)):
        assert (got[0] == graph[0]).all() and (got[1] == graph[1]).all()


def test_op3_links_reach_strays():
    """Nodes that no path reaches are found by every query; a missing file is an error."""
    x = dense_table(400, 0, 0.1)
    shard = hnsw.Shard.build(x, np.arange(400), np.ones(400, int))
    lost = np.flatnonzero(shard.index.level == 0)[:20]
    for layer in shard.index.links[:1]:
        layer[np.isin(layer, lost)] = -1
    shard.strays = shard.index.strays()
    assert set(lost) <= set(shard.strays.tolist())
    i, j, _ = shard.sparse_links(x[lost], 0.95, 24)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(k, v) for k, v in enumerate(lost.tolist())]


def test_op3_lost_shard_raises(tmp_path):
    with pytest.raises(FileNotFoundError):
        hnsw.Shard.load(f"file:{tmp_path}", "1-2-gone")


def test_op3_audits_are_reported(spark, tmp_path):
    x = dense_table(1500, 500, 0.05)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df, audits=f"{tmp_path}/audits").collect()}
    audits = spark.read.parquet(f"{tmp_path}/audits").collect()
    assert len(audits) == 6 and all(r.recall >= 0.9 for r in audits)
    near = hnsw.within(x, x, 0.95)
    truth = near.sum(1) - 1
    found = np.array([got[i][0] for i in range(len(x))])
    assert found.sum() >= 0.99 * truth.sum() and (found <= truth).all()
    label = simhash.forest(len(x), [np.nonzero(near)])
    assert np.mean([got[i][1] == label[i] for i in range(len(x))]) > 0.999


# -- op4 -------------------------------------------------------------------------------------------


def plain_languages(rows, languages=("de", "en", "es", "fr"), pages=()):
    """id → (language, posterior), from rows (id, text, declared, host) and pages (id, text, declared, suffix, host, domain), by
    dictionaries of byte trigrams: what `identify` does while every labelled row is in its sample."""
    classes = [*languages, "und"]
    slots, fold = language_id.SLOTS, lambda b: b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    word = lambda b: letter(b) or b == 32 or 9 <= b <= 13

    def grams(text):
        t = (text or "").encode()
        out = Counter()
        for x, y, z in zip(t, t[1:], t[2:], strict=False):
            if word(x) and letter(y) and word(z):
                out[(((fold(x) << 16 | fold(y) << 8 | fold(z)) * 2654435761) & 0xFFFFFFFF) >> (32 - (slots.bit_length() - 1))] += 1
        return out

    everything = [(i, grams(t), d, None, h, None) for i, t, d, h in rows] + [(i, grams(t), *rest) for i, t, *rest in pages]
    counts = {c: Counter() for c in languages}
    for (_, g, _, _, _, _), (_, t, d, _) in zip(everything, rows, strict=False):
        if d in counts and t is not None:
            counts[d].update(g)
    total = {c: sum(v.values()) for c, v in counts.items()}
    pooled_all = sum(total.values()) + 0.01 * slots

    def log_p(c, s):
        pooled = (sum(counts[x][s] for x in languages) + 0.01) / pooled_all
        return math.log((1 - language_id.UNSEEN) * (counts[c][s] + 200 * pooled) / (total[c] + 200) + language_id.UNSEEN / slots)

    cache = {}
    evidence = []
    for _, g, *_ in everything:
        n = sum(g.values())
        e = None
        if n:
            e = []
            for c in languages:
                e.append(sum(k * cache.setdefault((c, s), log_p(c, s)) for s, k in g.items()))
            e.append(n * math.log(1 / slots))
            e = [x * min(1.0, language_id.TEXT_WEIGHT / n) for x in e]
        evidence.append(e)
    suggested = ["und" if e is None else classes[max(range(5), key=lambda k: (e[k], -k))] for e in evidence]
    seen = [float(suggested.count(c)) for c in classes]
    prior_all = [(x + 1) / (sum(seen) + 5) for x in seen]

    def tally(keys):
        out = defaultdict(lambda: [0.0] * 5)
        for key, s in zip(keys, suggested, strict=True):
            if key is not None:
                out[key][classes.index(s)] += 1
        return out

    smoothed = lambda own, above: [(x + language_id.HOST_PRIOR * p) / (sum(own) + language_id.HOST_PRIOR) for x, p in zip(own, above, strict=True)]
    hosted = [r[4] not in (None, "") for r in everything]
    domains = tally([(r[5],) if ok else None for r, ok in zip(everything, hosted, strict=True)])
    hosts = tally([(r[4], r[5]) if ok else None for r, ok in zip(everything, hosted, strict=True)])
    given = {}
    for column in (2, 3):
        for value, own in tally([r[column] or None for r in everything]).items():
            share = sum(own) / max(sum(seen), 1.0)
            given[column, value] = [math.log((x + language_id.DECLARED_PRIOR * share) / (m + language_id.DECLARED_PRIOR)) for x, m in zip(own, seen, strict=True)]
    out = {}
    for r, e, ok in zip(everything, evidence, hosted, strict=True):
        prior = smoothed(hosts[r[4], r[5]], smoothed(domains[r[5],], prior_all)) if ok else prior_all
        if e is None:
            out[r[0]] = ("und", 0.0)
            continue
        t = [x + math.log(p) for x, p in zip(e, prior, strict=True)]
        for column in (2, 3):
            t = [x + y for x, y in zip(t, given.get((column, r[column] or None), [0.0] * 5), strict=True)]
        p = [math.exp(x - max(t)) for x in t]
        k = max(range(5), key=lambda k: (p[k], -k))
        out[r[0]] = (classes[k], p[k] / sum(p))
    return out


def test_op4_brute_force(spark):
    """The fused posterior of every document and page, by dictionaries."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    pages = language_id.page_rows(spark.read.parquet(f"{DIR}/pages.parquet")).collect()
    want = plain_languages([(("d", r.doc_id), r.text, (r.lang or "").lower() or None, r.source) for r in docs], pages=[(("p", r.page_id), r.text, r.declared, r.suffix, r.host, r.domain) for r in pages])
    got = queries.op4_language_id(spark, DIR).collect()
    assert len(got) == len(want)
    for r in got:
        lang, p = want["d", r.doc_id] if r.doc_id is not None else want["p", r.page_id]
        assert r.lang == lang and abs(r.confidence - p) < 1e-4 and r.accepted == (lang != "und" and r.confidence >= language_id.LEAST)


def test_op4_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    logs = language_id.fit_text(language_id.labelled_documents(docs.where(~held)))
    rows = language_id.document_rows(docs.where(held)).withColumn("declared", F.lit(None).cast("string"))
    out = language_id.fuse(language_id.text_evidence(rows, logs)).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert np.mean([r.lang == r.truth for r in out]) > 0.97
    assert np.mean([r.accepted for r in out]) > 0.97


def test_op4_evidence_decides_short_texts(spark):
    logs = language_id.fit_text(language_id.labelled_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    rows = [("la", "fr", "fr", "a.fr", "a.fr")] * 200 + [("la", "es", "es", "b.es", "b.es")] * 200 + [("12345 67890 @@@@ ####", None, None, None, None), (None, "en", None, None, None), ("zz", "xx", "", "c", "c")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, declared string, suffix string, host string, domain string")
    out = {r.doc_id: r for r in language_id.fuse(language_id.text_evidence(df, logs)).collect()}
    assert len(out) == len(rows) and not out[401].accepted and out[401].lang == "und" and out[402].lang == "und"


def test_op4_rows(spark, odd, empty):
    whole = queries.op4_language_id(spark, DIR)
    n = spark.read.parquet(f"{DIR}/documents.parquet").count() + spark.read.parquet(f"{DIR}/pages.parquet").count()
    assert whole.count() == n and whole.where("accepted").count() >= 0.97 * n
    assert language_id.identify(odd).count() == odd.count()
    assert language_id.identify(empty).count() == 0 and language_id.accepted_documents(empty).columns == empty.columns


def test_trigrams_never_span_rows():
    from vigilspark.llm.util import text_bytes
    import pyarrow as pa

    rng = random.Random(2)
    t = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    slots, ends = language_id.trigram_slots(*text_bytes(pa.array(t)))
    one = lambda x: language_id.trigram_slots(*text_bytes(pa.array([x])))[0].tolist()
    assert [slots[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [one(x) for x in t]


# -- op5 -------------------------------------------------------------------------------------------


def without_repeats(rows, window=20):
    """rows: (doc_id, text); the definition."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = split(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (i, k))
    out = {}
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone.update(range(k, k + window))
        kept = [x for n, x in enumerate(w) if n not in gone]
        out[i] = (len(w), len(gone), sha(b" ".join(kept)))
    return out


def test_op5_brute_force(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_substring_dedup(spark, DIR).collect()}
    assert got == without_repeats(list(texts.items()))


def test_op5_random(spark):
    rng = random.Random(4)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 40))] + rng.choice(passages) + [rng.choice("ab")] * rng.randint(0, 50) + [f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        rows.append((i * 3 - 50, rng.choice([" ", "\n", " \t "]).join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df, outputs=("n_words", "n_removed", "kept_sha256")).collect()}
    assert got == without_repeats(rows)


def test_op5_colliding_words(spark):
    """Two Thue-Morse words agree in any polynomial hash modulo 2**64; the words before them repeat, the windows don't."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    x, y = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    nineteen = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{nineteen} {x}"), (2, f"{nineteen} {y}"), (3, f"{x} {nineteen}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()) == [(1, 20, 0), (2, 20, 0), (3, 20, 0)]


def test_op5_word_hashes():
    """Words of every length: equal words have equal hashes in both halves, unlike words in neither."""
    import pyarrow as pa

    rng = random.Random(7)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 30, 31, 32, 33, 34, 70]))) for _ in range(4000)]
    words += [w[::-1] for w in words]
    text = [" ".join(words[at : at + 50]) for at in range(0, len(words), 50)]
    got = substring_dedup.Words(*util.text_bytes(pa.array(text)))
    for half in (got.hash, got.other):
        assert len(set(zip(words, half.tolist(), strict=True))) == len(set(words)) == len(set(half.tolist()))
    assert not set(got.hash.tolist()) & set(got.other.tolist())


def test_op5_lost_sketch_raises(tmp_path):
    some = np.arange(1000, dtype=np.uint64)
    assert not substring_dedup.estimated_repeated(some, f"file:{tmp_path}", {}, 1 << 16).any()
    with pytest.raises(FileNotFoundError):
        substring_dedup.estimated_repeated(some, f"file:{tmp_path}", {(0, 0): "gone", (1, 0): "gone"}, 1 << 16)


def test_op5_rows_that_share_an_id(spark):
    """Rows of one id are told apart by their texts: what repeats in itself goes, the other row's spans don't touch it."""
    a, b = (" ".join(f"{c}{i}" for i in range(25)) for c in "ab")
    rows = [(None, f"{a} {a}", 1, 2), (None, f"{b} {b} tail", 3, 4), (None, f"{a} {a}", 5, 6), (5, f"{a} tail", 7, 8), (5, b, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int, _spans int").repartition(3)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r._key) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(0, 50, 25, 1), (0, 50, 25, 5), (0, 51, 25, 3), (5, 25, 25, 9), (5, 26, 25, 7)]


def test_op5_odd(odd, empty):
    r = substring_dedup.remove_repeats(odd).collect()
    assert len(r) == odd.count()
    by = {x.doc_id: x for x in r}
    assert (by[0].n_words, by[7].n_words, by[8].n_words) == (0, 1, 60_000)
    want = without_repeats([(i, t) for i, t in enumerate(ODD)])
    assert all((by[i].n_words, by[i].n_removed) == want[i][:2] for i in range(len(ODD)))
    assert substring_dedup.remove_repeats(empty).count() == 0


# -- op6 -------------------------------------------------------------------------------------------


def prints(t):
    w = (t or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1 if w else 0))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op6_brute_force(spark, texts):
    got = {r.doc_id: r for r in queries.op6_simhash_trie(spark, DIR).collect()}
    ids = sorted(texts)
    fp = [prints(texts[i]) for i in ids]
    least = reach([{j for j in range(len(ids)) if j != i and (fp[i] ^ fp[j]).bit_count() <= 2} for i in range(len(ids))])
    for k, i in enumerate(ids):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp[k]:016x}", ids[least[k]])


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_op6_trie_join(budget):
    rng = np.random.default_rng(budget)
    a = rng.integers(0, 1 << 64, 800, dtype=np.uint64)
    near = a[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    for x in (np.unique(np.concatenate([a, near])), np.unique(rng.integers(0, 1 << 10, 400, dtype=np.uint64))):
        i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= budget, 1))
        got = [p for p in simhash.trie_pairs(x, x, budget, True)]
        assert sorted((int(p), int(q)) for f, g in got for p, q in zip(f, g, strict=True)) == sorted(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("subtree,crowded", [(8192, 1 << 18), (8, 1 << 18), (16, 20), (1 << 20, 30)])
def test_op6_dealt_subtrees_lose_nothing(spark, monkeypatch, subtree, crowded):
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(5)
    fps = {x ^ (1 << rng.randrange(64)) for x in [rng.getrandbits(64) for _ in range(60)] for _ in range(6)}
    fps = sorted(fps | {(0x123456789 << 28) ^ rng.getrandbits(12) << rng.choice([0, 8, 20]) for _ in range(120)})  # a crowded prefix
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, node long")
    got = {r.node: r.component for r in connected_components(simhash.trie_links(df, 2)).collect()}
    least = reach([{j for j in range(len(fps)) if j != i and (fps[i] ^ fps[j]).bit_count() <= 2} for i in range(len(fps))])
    assert {k: got.get(k, k) for k in range(len(fps))} == dict(enumerate(least))


def test_op6_odd(odd, empty):
    r = simhash.near_duplicates(odd).collect()
    assert len(r) == odd.count()
    assert {x.component_id for x in r if x.doc_id in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(0, 200)]
    links = chain + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5000, 5000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    sets = defaultdict(set)
    for a, b in links:
        if a != b:
            sets[a].add(b)
            sets[b].add(a)
    ids = sorted(sets)
    at = {n: k for k, n in enumerate(ids)}
    least = reach([{at[m] for m in sets[n]} for n in ids])
    assert got == {n: ids[least[k]] for k, n in enumerate(ids)}


# -- op7 -------------------------------------------------------------------------------------------


def test_op7_from_the_rows(spark):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    by[-1] = [(0, "user", queries.HOSTILE), (1, "assistant", queries.HOSTILE)]
    got = {r.conv_id: r for r in queries.op7_chat_format(spark, DIR).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), sha(loss))


def test_op7_reversible(spark):
    rng = random.Random(7)
    bits_ = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<", "[", "/", "a", "\n", "[\\INST]", "<\\\\/s>", "é", "$1", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "".join(rng.choices(bits_, k=2)), None]), rng.choice([None, "".join(rng.choices(bits_, k=rng.randint(0, 9)))]), "x") for c in range(60) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = chat.formatted(chat.canonical(df))
    assert all(r.formatted.count(chat.END) == r.formatted.count(chat.OPEN) == r.formatted.count(chat.SHUT) for r in out.collect())
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((role or "", text or ""))
    for r in chat.read_back(out).collect():
        assert [(m.role, m.text) for m in r.turns] == by[r.conv_id]
        assert r.loss_text == "".join(t for role, t in by[r.conv_id] if role == "assistant")
    assert chat.read_back(chat.formatted(chat.canonical(df.limit(0)))).count() == 0


def test_op7_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    plain = lambda df: [[(m.role, m.text) for m in r.turns] for r in chat.canonical(df).collect()]
    assert plain(spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], 5)], "conv_id int, messages array<struct<role:string,content:string>>, extra int")) == [turns]
    assert plain(spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id int, conversations array<struct<`from`:string,value:string>>")) == [turns]
    assert plain(spark.createDataFrame([(1, "q", "", "a")], "conv_id int, instruction string, input string, output string")) == [turns]
    assert plain(spark.createDataFrame([(1, "q", "in", None)], "conv_id int, instruction string, input string, output string")) == [[("user", "q\nin"), ("assistant", "")]]
    assert plain(spark.createDataFrame([(1, "q", "a")], "conv_id int, prompt string, completion string")) == [turns]
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, "x")], "conv_id int, odd string"))
    records = ['{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"prompt": "q", "response": "a", "id": 3}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', '{"instruction": "q", "output": "a"}', "broken", None]
    got = chat.canonical_json(spark.createDataFrame(list(enumerate(records)), "conv_id int, record string")).orderBy("conv_id").collect()
    assert [r.layout for r in got] == ["messages", "prompt_response", "conversations", "instruction_only", chat.UNKNOWN, chat.UNKNOWN]
    assert [[(m.role, m.text) for m in r.turns] for r in got] == [turns] * 4 + [[]] * 2


def test_op7_fingerprints_select(spark, monkeypatch):
    """The hash of the field paths decides, for turn rows too: a renamed field has no layout until its hash is in the table."""
    turn_rows = spark.createDataFrame([(1, 1, "assistant", "a"), (1, 0, "user", "q")], "conv_id int, turn int, role string, text string")
    assert chat.table_layout(turn_rows) == chat.FINGERPRINTS[chat.fingerprint(("turn", "role", "text"))] == "turn_rows"
    renamed = turn_rows.withColumnRenamed("text", "body")
    with pytest.raises(ValueError):
        chat.canonical(renamed)
    paths, sql = chat.LAYOUTS["turn_rows"]
    monkeypatch.setitem(chat.LAYOUTS, "turn_rows", (("body", "role", "turn"), sql.replace("coalesce(text, '')", "coalesce(body, '')")))
    monkeypatch.setitem(chat.FINGERPRINTS, chat.fingerprint(("body", "role", "turn")), "turn_rows")
    monkeypatch.setattr(chat, "_KNOWN", [*chat._KNOWN, "body"])
    assert [[(m.role, m.text) for m in r.turns] for r in chat.canonical(renamed).collect()] == [[("user", "q"), ("assistant", "a")]]
    with pytest.raises(ValueError):
        monkeypatch.setattr(chat, "FINGERPRINTS", {})
        chat.table_layout(turn_rows)


def test_op7_records_of_more_than_one_layout(spark):
    """Fields of two layouts: the largest whole one. Elements that lack a field, and empty lists, have their layout all the same."""
    records = [
        '{"prompt": "p", "messages": [{"role": "user", "content": "q"}]}',
        '{"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]}',
        '{"messages": []}',
        '{"messages": [{"role": "user"}]}',
        '{"instruction": "i", "input": "n", "output": "o", "prompt": "p", "response": "r"}',
        '[1]',
    ]
    got = chat.canonical_json(spark.createDataFrame(list(enumerate(records)), "conv_id int, record string")).orderBy("conv_id").collect()
    assert [r.layout for r in got] == ["messages", "messages", "messages", chat.UNKNOWN, "instruction", chat.UNKNOWN]
    assert [[(m.role, m.text) for m in r.turns] for r in got] == [[("user", "q")], [("user", ""), ("assistant", "a")], [], [], [("user", "i\nn"), ("assistant", "o")], []]


def test_op7_odd(spark):
    """A null conv_id, repeated rows, ties of turns, a very long text; clashing names."""
    rows = [(None, 0, "user", "x"), (None, 0, "user", "x"), (1, None, None, None), (2, 3, "b", "t"), (2, 3, "a", "u"), (2, 3, "a", "t"), (3, 0, "assistant", LONG + " </s>")]
    df = spark.createDataFrame([(*r, "f", "p", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, _p string, turns int")
    got = {r.conv_id: [(m.role, m.text) for m in r.turns] for r in chat.read_back(chat.formatted(chat.canonical(df))).collect()}
    assert got == {None: [("user", "x")] * 2, 1: [("", "")], 2: [("a", "t"), ("a", "u"), ("b", "t")], 3: [("assistant", LONG + " </s>")]}


# -- op8 -------------------------------------------------------------------------------------------


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]


def plain_rule(host, path):
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


def test_op8_rules_and_scores(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op8_url_filter(spark, DIR).collect()}
    assert set(got) == set(urls)
    for i, u in urls.items():
        host, path = plain_parse(u)
        rule, verdict = plain_rule(host, path)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("allow" if r.score >= r.threshold else "block"))


def test_op8_parsing(spark):
    urls = [None, "", "a.com/x", "HTTP://Ex.COM", "x://a/b/c?d#e", "x://a?b/c", "x://a#b", "x://É.com/Ä", "x://u@h:8/p\nq", "x://a://b/c", "://", "x://com/en/1", "x://xcom/en/1", "x://a.com/en/", "x://example.com/en/7", "x://EXAMPLE.com/en/71", "x://b.example.net/de/8", "x://net/de/8"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(df).collect()}
    assert got == {i: (*plain_parse(u), plain_rule(*plain_parse(u))[0]) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_op8_held_out_accuracy(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        good = rng.random() < 0.5
        stem = "".join(rng.choice("aeioubdg" if good else "xzqkvwjy") for _ in range(8))
        rows.append((i, f"http://{stem}.{'net/de' if good else 'org/es'}/{i}" if i % 2 else f"http://{stem}.info/{i}", good))
    df = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert np.mean([got[i] == ("allow" if good else "block") for i, u, good in rows if i % 2 == 0]) > 0.95


def test_op8_scores_by_exact_counts(spark):
    """More n-grams than any fixed number of counters: scores are those of a dictionary of n-grams."""
    rng = random.Random(9)
    urls = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(60)) for _ in range(5000)]
    urls = [f"http://x.{('net/de/', 'org/es/', 'info/')[i % 3]}{u}" for i, u in enumerate(urls)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    held = {r.text for r in spark.createDataFrame([(u[7:],) for u in urls], "text string").where("pmod(xxhash64(text), 5) = 0").collect()}
    seen, before = Counter(), Counter()
    steps = lambda t: ((n, (("",) * 4 + tuple(t))[i + 4 - n : i + 4], c) for i, c in enumerate(t) for n in range(5))
    for i, u in enumerate(urls):
        if i % 3 < 2 and u[7:] not in held:
            for n, context, c in steps(u[7:]):
                seen[i % 3, n, context, c] += 1
                before[i % 3, n, context] += 1
    assert len(seen) > 1 << 18
    for i in range(2, 5000, 150):
        total, text = 0.0, urls[i][7:]
        p = [0.0, 0.0]
        for n, context, c in steps(text):
            for k in (0, 1):
                p[k] = (seen[k, n, context, c] + 2 * (p[k] if n else 1 / 256)) / (before[k, n, context] + 2)
            total += math.log(p[0] / p[1]) if n == 4 else 0
        assert abs(got[i].score - total / len(text)) < 1e-9


def test_op8_threshold(spark):
    """The cut that splits the held-out labelled URLs best, by trying every cut; verdicts follow it."""
    rows = queries.op8_url_filter(spark, DIR).collect()
    labelled = spark.createDataFrame([(r.page_id, r.host + r.path) for r in rows if r.rule], "page_id long, text string")
    held = {r.page_id for r in labelled.where(f"pmod(xxhash64(text), {url_filter.HELD_OUT}) = 0").collect()}
    bins = url_filter.BINS
    at = lambda r: min(max(math.floor((r.score + 4) * (bins / 8)), 0), bins)
    good, bad = ([at(r) for r in rows if r.page_id in held and r.verdict == v] for v in ("allow", "block"))
    assert good and bad
    wrong = {c: sum(b < c for b in good) / len(good) + sum(b >= c for b in bad) / len(bad) for c in range(bins + 2)}
    least = min(wrong.values())
    best = min((c * 8.0 / bins - 4 for c, w in wrong.items() if w <= least + 1e-12), key=abs)
    assert {r.threshold for r in rows} == {best}
    assert all(r.verdict == ("allow" if r.score >= best else "block") for r in rows if not r.rule)


def test_op8_odd(spark):
    """Repeated rows, null ids and URLs, a very long URL; other columns with clashing names."""
    urls = [(None, "http://a.com/en/1"), (1, None), (2, "http://a.com/en/1"), (2, "http://a.com/en/1"), (3, "http://x.info/" + "ab" * 50_000), (None, "http://y.info/q"), (None, "http://y.info/q"), (4, "no url")]
    df = spark.createDataFrame([(*r, "t", 1, 2.0) for r in urls], "page_id long, url string, text string, id int, score double")
    got = url_filter.judge(df).collect()
    assert len(got) == len(urls) and Counter(r.page_id for r in got) == Counter(i for i, _ in urls)
    assert all(r.rule == "com/en/" and r.verdict == "block" for r in got if r.host == "a.com")
    assert url_filter.judge(df.limit(0)).count() == 0


# -- op9 -------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if each * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: each * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("folder", [DIR, "/root/testdata/sf0.01"])
def test_op9_targets(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    size = {r.doc_id: len(split(r.text)) for r in rows}
    by = Counter()
    for r in rows:
        by[r.source] += size[r.doc_id]
    target = plain_targets(by)
    got = {r.doc_id: r for r in queries.op9_source_mix(spark, folder).collect()}
    taken = Counter()
    for r in rows:
        g = got[r.doc_id]
        assert (g.size, g.source_size) == (size[r.doc_id], by[r.source]) and math.isclose(g.target, target[r.source], rel_tol=1e-9)
        assert 0 <= g.taken <= 2 * g.size
        taken[r.source] += g.taken
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 1 for s in by)
    assert {r.doc_id: r.taken for r in queries.op9_source_mix(spark, folder).collect()} == {i: g.taken for i, g in got.items()}


def test_op9_odd(odd, empty):
    r = mixing.mix(odd).collect()
    assert len(r) == odd.count() and all(0 <= x.taken <= 2 * x.size for x in r)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).columns == empty.columns


def test_op9_null_and_repeated_ids_stay_rows(spark):
    """Rows with a null id, rows of one id and rows equal in all but another column: each is a document of its own."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 40)))
    rows = [(None, text(), "s0", 1, 1) for _ in range(1000)] + [(7, text(), "s1", 1, 1) for _ in range(1000)]
    rows += [(8, "the same text", "s0", 1, i) for i in range(1000)] + [(100 + i, text(), f"s{i % 3}", 1, 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, _copy int").repartition(7)
    want = sum(t.target for t in mixing.targets(mixing.sized(docs)).collect())
    mix = mixing.mix(docs).collect()
    assert len(mix) == 4000 and all(0 <= r.taken <= 2 * r.size for r in mix)
    assert abs(sum(r.taken for r in mix) - want) < 0.02 * want
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    times = Counter(tuple(r) for r in out.collect())
    have = Counter(rows)
    assert all(0 < n <= 2 * have[r] for r, n in times.items())
    assert abs(sum(n * len(split(r[1])) for r, n in times.items()) - want) < 0.1 * want
    again = Counter(tuple(r) for r in mixing.mixed_documents(docs.repartition(3)).select("doc_id", "text", "source").collect())
    by_text = Counter()
    for r, n in times.items():
        by_text[r[:3]] += n
    assert again == by_text


def test_op9_blocks_cover_each_word_once(spark):
    """With weight for two passes over everything each document is taken twice."""
    df = spark.createDataFrame([(i, "w " * (i % 37), f"s{i % 2}") for i in range(300)], "doc_id long, text string, source string")
    sizes = mixing.sized(df)
    t = mixing.targets(sizes, share=2.0)
    assert all(r.target == 2 * r.source_size for r in t.collect())
    sources, slots = mixing.schedule(t)
    n = {r.sid: r.blocks for r in sources.collect()}
    turns = Counter((r.sid, r.block) for r in slots.collect())
    assert max(turns.values()) <= 2 and sum(turns.values()) >= 0.97 * 2 * sum(n.values())


def test_op9_sources_stay_near_their_shares(spark):
    df = spark.createDataFrame([(i, "w " * 100, f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    sources, slots = mixing.schedule(mixing.targets(mixing.sized(df)))
    s = slots.orderBy("slot").collect()
    share = {r.sid: r.want for r in sources.collect()}
    total = sum(share.values())
    for n in (100, 500, len(s)):
        c = Counter(r.sid for r in s[:n])
        assert all(abs(c[k] - n * share[k] / total) < 6 for k in share)


def test_word_caches_leave_room_for_more_workers():
    """Two generations of some 200 bytes a word in each Python worker, of which an executor may hold more than it has cores."""
    from vigilspark.llm import bpe, token_files

    assert all(2 * 200 * kind.CACHE_WORDS <= 100 << 20 for kind in (bpe.WordBpe, token_files.LibraryEncoder))
