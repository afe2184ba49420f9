import random
from fractions import Fraction
import re

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import fingerprint_index, queries, simhash, word_hashes

DDL = "doc_id long, text string, block int, tag int, kept string, fp int, component_id int, n_words int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0, "x", 0, 0, 0) for i, t in rows], DDL)


# SimHash.


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB é\t\n\x1c\x85", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def some_fingerprints(seed, centres=60, hot=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, centres, dtype=np.uint64) * np.uint64(2)
    out = [base, np.array([0], np.uint64)]
    for k, n in ((1, 80), (2, 80), (3, 80)):
        x = rng.choice(base, n)
        for _ in range(k):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        out.append(x)
    x = np.full(hot, base[0])
    for _ in range(4):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, hot).astype(np.uint64))
    return np.unique(np.concatenate([*out, x]))


@pytest.mark.parametrize("pairwise", [16, 2048])
def test_variants_find_every_component(monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    fp = some_fingerprints(3, hot=400)
    fps, _, key = simhash.variants(fp)
    x, y = simhash.joined(fps, key)
    assert (np.bitwise_count(x ^ y) > 0).all()
    got = simhash.forest(np.searchsorted(fp, x), np.searchsorted(fp, y), len(fp))
    assert (got == simhash.forest(*simhash.close_pairs(fp), len(fp))).all()


def test_linking_by_masks_is_exact():
    fp = some_fingerprints(5, centres=3, hot=300)
    assert (simhash.forest(*simhash.close_links(fp), len(fp)) == simhash.forest(*simhash.close_pairs(fp), len(fp))).all()


def test_long_chains_become_one_component(spark):
    n = 60  # each two bits from the next
    ids = random.Random(1).sample(range(1000), n)
    fps = [(1 << i) - 1 for i in range(0, 2 * n, 2) if i < 63] + [-(1 << k) for k in range(n)]
    rows = [(ids[i], int(np.uint64(v & (2**64 - 1)).view(np.int64))) for i, v in enumerate(fps[:n])]
    got = {r["fp"]: r["component_id"] for r in simhash.components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    u = np.array([np.int64(f).view(np.uint64) for _, f in rows], np.uint64)
    order = np.argsort(u)
    label = simhash.forest(*simhash.close_pairs(u[order]), n)
    for lab in set(label.tolist()):
        group = [rows[k] for k in order[label == lab]]
        assert {got[f] for _, f in group} == {min(i for i, _ in group)}


def test_components_of_texts(spark):
    rng = random.Random(2)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
    near = base.replace(base.split()[200], "changed", 1)
    rows = [(9, base), (4, base), (4, base), (7, near), (3, "something else entirely here"), (None, base), (8, None), (6, ""), (5, " \n"), (11, "A b"), (2, "a B")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["fingerprint"] == f"{brute_fingerprint(dict(rows)[r['doc_id']]):016x}" for r in got)
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[9] == comp[4] == comp[None] and comp[8] == comp[6] == comp[5] == 5 and comp[11] == comp[2] == 2 and comp[3] == 3
    kept = simhash.keep_one(docs(spark, rows))
    left = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs(spark, rows).columns and left.count(4) == 1 and 9 not in left and None in left and {3, 5, 2} <= set(left) and 11 not in left
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


@pytest.mark.parametrize("segments", [2, 3, 6])
@pytest.mark.parametrize("at_once", [64, 1 << 20])
def test_every_pair_within_the_radius_is_found_once(monkeypatch, segments, at_once):
    monkeypatch.setattr(simhash, "AT_ONCE", at_once)
    fp, radius = some_fingerprints(7, centres=5, hot=80), 2 * segments - 1
    fp = np.concatenate([fp, fp[:9]])
    fps, which, _ = simhash.variants(fp, segments)
    node = np.tile(np.arange(len(fp)), 64)
    x, y = simhash.close_pairs(fp, radius)
    group = np.arange(len(fp)) % 7
    a, b = simhash.real_pairs(fps, which, group[node].astype(np.uint64), segments, radius)
    assert sorted(tuple(sorted(p)) for p in zip(node[a].tolist(), node[b].tolist())) == sorted((i, j) for i, j in zip(x.tolist(), y.tolist()) if group[i] != group[j])
    a, b = simhash.real_pairs(fps, which, None, segments, radius)
    assert set(zip(np.minimum(node[a], node[b]).tolist(), np.maximum(node[a], node[b]).tolist())) <= set(zip(x.tolist(), y.tolist()))
    assert (simhash.forest(node[a], node[b], len(fp)) == simhash.forest(x, y, len(fp))).all()


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def test_near_copies_are_similar_texts_within_the_radius(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(4):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for many in (0, 1, 2, 3, 4, 6, 9, 15, 15):
            w = list(base)
            for k in rng.sample(range(150), many):
                w[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += texts[:3] + ["one two three four", "One two three four", "one two three five", "", None]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    u = np.array([simhash.fingerprint((t or "").encode(), 3) for _, t in rows], np.uint64)
    sets = [shingle_set(t or "") for _, t in rows]
    alike = lambda i, j: 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    x, y = simhash.close_pairs(u, 11)
    ok = np.array([alike(i, j) for i, j in zip(x.tolist(), y.tolist())])
    want = simhash.forest(x[ok], y[ok], len(rows))
    assert 0 < (~ok).sum() and (np.bitwise_count(u[x] ^ u[y])[ok] > 2).any()
    got = simhash.near_duplicates(docs(spark, rows), segments=6, radius=11, similarity=0.8)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(want.tolist()))
    kept = corpus_pipeline.simhash_near_dedup(spark, docs(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.tolist()))
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs(spark, rows), segments=2, radius=4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from([f"w{k}" for k in range(9)]), max_size=40).map(" ".join), min_size=2, max_size=12), st.sampled_from(["0.8", "0.5"]))
def test_bounds_keep_all_similar_pairs(texts, least):
    sets = simhash.shingle_sets([t.encode() for t in texts], 5)
    assert [len(s) for s in sets] == [len(shingle_set(t)) if t.split() else 0 for t in texts]
    n, counted, bound = np.array([len(s) for s in sets]), np.stack([simhash.bins(s) for s in sets]), Fraction(least)
    x, y = np.triu_indices(len(texts), 1)
    may = simhash.may_share(x, y, n, counted, bound)
    assert all(ok for i, j, ok in zip(x, y, may) if len(shingle_set(texts[i]) & shingle_set(texts[j])) >= bound * len(shingle_set(texts[i]) | shingle_set(texts[j])))


def test_full_classes_say_nothing():
    wide = simhash.bins(np.arange(200_000, dtype=np.uint64))
    assert (wide == 255).all() and simhash.may_share(np.array([0]), np.array([1]), np.array([200_000] * 2), np.stack([wide] * 2), Fraction("0.8")).all()


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c", "x", 1, "p"), (1, "a b c", "x", 1, "p"), (2, "a b c", "y", 2, "q"), (3, "", None, 3, None), (None, None, "z", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, key long, `row` string")
    assert sorted(simhash.keep_one(df).collect(), key=str) == sorted(spark.createDataFrame([rows[0], rows[3], rows[4]], df.schema).collect(), key=str)


# Substring dedup.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té\x1c", max_size=30), max_size=6))
def test_words_and_windows(texts):
    h, first = word_hashes.words([t.encode() for t in texts])
    words = [w for t in texts for w in t.encode().split()]
    assert len(first) == len(texts) + 1 and first[-1] == len(words) == len(h)
    assert len(set(h.tolist())) == len(set(words))
    for size in (1, 2, 3, 5):
        rolled = word_hashes.rolling(h, size, 12345)
        windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        assert len(rolled) == len(windows) and len(set(rolled.tolist())) == len(set(windows))


def test_minimisers_are_leftmost_minima():
    m = np.random.default_rng(1).integers(0, 6, 200).astype(np.uint64)
    for span in (1, 2, 5, 11):
        assert fingerprint_index._minimisers(m, span).tolist() == [i + int(np.argmin(m[i : i + span])) for i in range(len(m) - span + 1)]


def passages(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "x" * 300, "é", f"w{rng.randrange(400)}"])
    shared = [[word() for _ in range(rng.randrange(15, 60))] for _ in range(5)] + [["ha"] * 70]
    out = []
    for i in rng.sample(range(1000), n):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(shared) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(40))]
        out.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    return out


def oracle(rows, size=20):
    """n_removed and kept words of (order, text) in the order given, the plain way."""
    seen, out = set(), []
    for text in rows:
        words, gone = (text or "").encode().split(), set()
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            if w in seen:
                gone |= set(range(i, i + size))
            seen.add(w)
        out.append((len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_removes_what_a_plain_pass_removes(spark, seed):
    rows = sorted(passages(seed)) + [(2000, None), (2001, "")]
    shuffled = random.Random(seed).sample(rows, len(rows))
    got = {r["in.doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in fingerprint_index.dedup(docs(spark, shuffled).repartition(5), buckets=3).collect()}
    assert got == dict(zip((i for i, _ in rows), oracle([t for _, t in rows]))) and sum(x[1] for x in got.values()) > 0


def test_null_ids_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (7, text + " tail"), (5, "other " + text)]
    got = sorted((r["in.doc_id"] or -1, r["n_words"], r["n_removed"]) for r in fingerprint_index.dedup(docs(spark, rows)).collect())
    assert got == [(-1, 30, 0), (5, 30, 30), (5, 30, 30), (5, 31, 30), (7, 31, 30)]
    assert fingerprint_index.dedup(docs(spark, [])).count() == 0


def results(df):
    return {r["in.doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("fan", [1, 2, 9])
def test_batches_through_an_index_equal_one_pass(spark, tmp_path, fan):
    rows = sorted(passages(5, 80))
    whole = {i: x for (i, _), x in zip(rows, oracle([t for _, t in rows]))}
    assert results(fingerprint_index.dedup(docs(spark, rows[::-1]), buckets=3, fan=fan, batches=4)) == whole
    got, folder = {}, str(tmp_path / "index")
    for k in range(4):  # an index that stays is opened again for every batch
        got |= results(fingerprint_index.dedup(docs(spark, rows[20 * k : 20 * k + 20]), index=folder, batches=1, buckets=3 + k, fan=fan))
        held = fingerprint_index.FingerprintIndex(spark, folder)
        assert held.batch == k + 1 and held.buckets == 3 and 1 <= len(held.runs) <= fan
    assert got == whole
    for r in held.history().collect():
        key, offset, count, check = fingerprint_index._read_run(r["blob"])
        assert (key[1:] >= key[:-1]).all() and len(check) == count.sum()


def test_a_batch_without_a_commit_is_repeated(spark, tmp_path, monkeypatch):
    rows, folder = sorted(passages(7, 60)), str(tmp_path / "index")
    whole = {i: x for (i, _), x in zip(rows, oracle([t for _, t in rows]))}
    step = lambda part: results(fingerprint_index.dedup(docs(spark, part), index=folder, batches=1, buckets=2))
    got = step(rows[:30])
    with monkeypatch.context() as m:
        m.setattr(fingerprint_index, "COMMIT", "no such type")
        with pytest.raises(Exception):
            step(rows[30:])
    got |= step(rows[30:])
    assert got == whole and fingerprint_index.FingerprintIndex(spark, folder).batch == 2


def test_runs_that_outgrow_their_buckets_are_dealt_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprint_index, "GROWN", 2000)
    rows, folder, got = sorted(passages(6, 80)), str(tmp_path / "index"), {}
    for i, j in [(0, 50), (50, 55), (55, 60), (60, 80)]:
        got |= results(fingerprint_index.dedup(docs(spark, rows[i:j]), index=folder, batches=1, buckets=1))
    assert fingerprint_index.FingerprintIndex(spark, folder).buckets > 1
    assert got == {i: x for (i, _), x in zip(rows, oracle([t for _, t in rows]))}


def test_a_line_in_all_documents_does_not_fill_one_bucket(spark):
    rng = random.Random(3)
    line = " ".join(f"b{k}" for k in range(19))
    word = lambda: f"w{rng.randrange(10**7)}"
    rows = [(i, " ".join([word() for _ in range(25)] + [line] + [word() for _ in range(25)])) for i in range(2000)]
    rows += [(2000 + i, rows[i][1]) for i in range(0, 60, 3)]
    df, buckets = docs(spark, rows), 256
    hot = fingerprint_index.hot_minimisers(df, buckets)
    assert 0 < len(hot) <= 4 * buckets
    texts = [t.encode() for _, t in rows]
    ids, zero = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    def most(hot):
        held = [0] * buckets
        for b, kind, _, blob in fingerprint_index.scan(texts, ids, zero, zero, buckets, np.array(hot, np.int64).view(np.uint64)):
            if kind == fingerprint_index.RECORDS:
                held[b] += len(fingerprint_index._unpack(blob, *["<i8", "<u4", "<u4", "<u4", "<u8"])[4])
        return max(held), sorted(held)[buckets // 2]
    assert most([])[0] > 20 * most([])[1] and most(hot)[0] < 3 * most(hot)[1]
    got = results(fingerprint_index.dedup(df, buckets=buckets))
    assert got == {i: x for (i, _), x in zip(rows, oracle([t for _, t in rows]))}


def test_very_long_and_many_null_texts(spark):
    long = " ".join(f"w{k % 70000}" for k in range(150_000))
    rows = [(1, long), (2, None), (3, None), (4, " ".join(f"w{k}" for k in range(100, 160)))]
    got = results(fingerprint_index.dedup(docs(spark, rows)))
    assert got[1][:2] == (150_000, 80_000) and got[2] == got[3] == (0, 0, "") and got[4] == (60, 60, "")


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2, "y"), (2, None, None, None, None)], "doc_id long, text string, whole string, block int, `in.text` string")
    found = fingerprint_index.dedup(df, keep_text=True)
    assert sorted(found.select(*(f"`in.{c}`" for c in df.columns)).collect()) == sorted(df.collect())


def test_merge_join():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.sort(rng.integers(0, 40, rng.integers(0, 30)).astype(np.uint64)) for _ in range(2))
        x, y = fingerprint_index.meeting(a, b)
        assert x.tolist() == np.isin(a, b).tolist() and y.tolist() == np.isin(b, a).tolist()


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES["op4_substring_dedup"](spark, sf)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == sorted(c.sql(queries.ORACLE["op4_substring_dedup"]).project("doc_id, n_words, n_removed, kept_sha256").fetchall())


def test_near_duplicate_query_against_brute_force(spark):
    """The registered query on a whole small table: plain fingerprints, every pair of them, plain components."""
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    fp = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and root[a] > root[b]:
                    root[a], changed = root[b], True
    got = queries.QUERIES["op7_simhash"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", root[i]) for i in fp} and len(got) == len(rows)
    assert len(set(root.values())) < len(root)


def test_very_long_texts_have_fingerprints(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, [(1, long), (2, long + " x"), (3, "w1 w2")])).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[3]["component_id"] == 3
    assert got[1]["fingerprint"] == f"{simhash.fingerprint(long.encode()):016x}"
