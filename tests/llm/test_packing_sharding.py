import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keelson.llm import interleave, queries, vector_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
DDL = "doc_id long, text string, source string, h int, b int, g string, r int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0, "x", 1) for i, t, s in rows], DDL)


ROWS = [(1, "the cat", "a"), (1, "the cat", "a"), (2, None, None), (3, "", "b"), (None, "word " * 3000, "a"), (5, "<|endoftext|> é😀\n\n  x", "b")] + [(i, "some words here " * (i % 90), "a" if i % 3 else "b") for i in range(10, 150)]


def test_packs_every_piece_once(spark):
    got = vector_packing.pack(docs(spark, ROWS), PATH, tokens=256).toPandas()
    tk = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in ROWS:
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = [0, *range((len(ids) - 1) % 256 + 1, len(ids), 256)]
        want += [(-1 if i is None else i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(at, [*at[1:], len(ids)]))]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.fillna(-1)[cols].astype(int).values.tolist())) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 2


def test_empty_tables(spark):
    assert vector_packing.pack(docs(spark, []), PATH).count() == 0
    assert interleave.interleave(docs(spark, [])).count() == 0


def plain_best_fit(lengths, caps, rule, weights):
    """Every open sequence is tried for every piece, one after the other."""
    tile = lambda n: sum(range(1, -(-n // 128) + 1))
    room, bins = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, best = (lengths[i], 1, tile(lengths[i])), None
        for j, left in enumerate(room):
            if all(a >= b for a, b in zip(left, size)):
                if rule == "norm":
                    rank = sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(weights, left, size, caps))
                else:
                    rank = -sum(w * b / c * a / c for w, a, b, c in zip(weights, left, size, caps))
                if best is None or rank < best[0] - 1e-12:
                    best = rank, j
        if best is None:
            room.append(list(caps))
            best = 0, len(room) - 1
        bins[i] = best[1]
        room[best[1]] = [a - b for a, b in zip(room[best[1]], size)]
    return [bins[i] for i in range(len(lengths))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(1, 5), st.integers(36, 60), st.sampled_from(["norm", "dot"]))
def test_every_capacity_holds(lengths, most, cost, rule):
    n = np.array(lengths, np.int64)
    bins, offsets = vector_packing.best_fit(n, 1000, most, cost, rule)
    for b in set(bins.tolist()):
        own = n[bins == b]
        assert own.sum() <= 1000 and len(own) <= most and vector_packing.tiles(own).sum() <= cost
        order = np.argsort(offsets[bins == b])
        assert offsets[bins == b][order].tolist() == [0, *own[order].cumsum().tolist()[:-1]]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_choices_are_those_of_a_plain_loop(rule):
    rng = random.Random(8)
    for many in (5, 40, 700):
        lengths = [rng.choice([rng.randrange(1, 40), rng.randrange(1, 1024)]) for _ in range(many)]
        caps = (1024, 12, 37)
        bins, _ = vector_packing.best_fit(np.array(lengths), *caps, rule)
        assert bins.tolist() == plain_best_fit(lengths, caps, rule, vector_packing.WEIGHTS)


def test_all_capacities_bind_on_the_documents(spark):
    """The query's own capacities refuse pieces that have room by tokens, and cost two sequences at most over the least number."""
    got = vector_packing.pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), PATH).toPandas()
    least = -(-got.length.sum() // 1024)
    n = np.sort(got.length[got.length < 1024].to_numpy())[::-1]
    one = vector_packing.best_fit(n, 1024, 10**6, 10**6, weights=(1.0, 0.0, 0.0))[0]
    free_docs, free_cost = (vector_packing.best_fit(n, 1024, *caps)[0] for caps in ((10**6, 37), (32, 10**6)))
    bound = vector_packing.best_fit(n, 1024, 32, 37)[0]
    assert (bound != one).sum() > 300 and (bound != free_docs).any() and (bound != free_cost).any()
    assert got.sequence_id.nunique() <= least + 2 and bound.max() <= one.max() + 1
    each = got.groupby("sequence_id").length
    assert each.size().max() == 32 and each.apply(lambda x: vector_packing.tiles(x).sum()).max() == 37


def test_a_capacity_that_binds_opens_more_sequences(spark):
    free, bound = (vector_packing.pack(docs(spark, ROWS), PATH, tokens=256, max_docs=k).toPandas() for k in (99, 2))
    assert bound.groupby("sequence_id").size().max() <= 2 and bound.sequence_id.nunique() > free.sequence_id.nunique()
    with pytest.raises(ValueError):
        vector_packing.pack(docs(spark, ROWS), PATH, tokens=256, max_cost=2)


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_fast_ids_are_those_of_tokenizers(text):
    text = text.encode("utf-8", "replace").decode()
    assert vector_packing.encoder(PATH)(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_other_vocabularies_run_on_tokenizers_itself():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert vector_packing.encoder(path)("Hello wide world").tolist() == Tokenizer.from_file(path).encode("Hello wide world", add_special_tokens=False).ids


def test_shards_match_the_mixture(spark):
    got = interleave.interleave(docs(spark, ROWS), shards=7).toPandas()
    assert len(got) == len(ROWS)
    sizes = got.groupby("shard").size()
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 1
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    table = got.fillna("-").groupby(["source", "shard"]).size().unstack(fill_value=0)
    expected = table.sum(axis=1).to_numpy()[:, None] / 7
    assert (abs(table.to_numpy() - expected) <= 1.5).all()
    text = {i: t or "" for i, t, _ in ROWS}
    for r in got.dropna(subset="doc_id").itertuples():
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))


def plain_interleave(spark, rows, shards, seed):
    """Sources shuffled by the seeded hash, all rows in one list by fractional rank, the list cut into equal stretches."""
    df = spark.createDataFrame([(k, i, zlib.crc32((t or "").encode()), s) for k, (i, t, s) in enumerate(rows)], "k int, doc_id long, crc long, source string")
    hashed = df.select("k", "doc_id", "crc", "source", F.xxhash64(F.lit(seed), "doc_id", "crc").alias("h"), F.xxhash64("source").alias("sh")).collect()
    by_source = {}
    for r in hashed:
        by_source.setdefault(r["source"], []).append(r)
    listed = []
    low = lambda x: (x is not None, x if x is not None else 0)
    for source, own in by_source.items():
        own.sort(key=lambda r: (r["h"], low(r["doc_id"]), r["crc"]))
        listed += [(Fraction(2 * k + 1, 2 * len(own)), r["sh"], k, r) for k, r in enumerate(own)]
    listed.sort(key=lambda x: x[:3])
    n, out = len(listed), {}
    for g, (*_, r) in enumerate(listed):
        shard = g * shards // n
        first = -(-shard * n // shards)
        out.setdefault((r["doc_id"], r["source"], r["crc"]), []).append((shard, g - first))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed,wide", [(3, 9), (3, 2048), (4, 1)])
def test_interleaving_equals_a_plain_sort(spark, monkeypatch, seed, wide):
    monkeypatch.setattr(interleave, "RANGE", wide)
    got = {}
    for r in interleave.interleave(docs(spark, ROWS), shards=5, seed=seed).collect():
        got.setdefault((r["doc_id"], r["source"], r["text_crc32"]), []).append((r["shard"], r["slot"]))
    assert {k: sorted(v) for k, v in got.items()} == plain_interleave(spark, ROWS, 5, seed)


def test_the_query_equals_a_plain_interleaving(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {}
    for r in queries.QUERIES["op8_interleave"](spark, sf).collect():
        assert r["law"] == "rows" and r["grown_shard"] is None
        got.setdefault((r["doc_id"], r["source"], r["text_crc32"]), []).append((r["shard"], r["slot"]))
    assert {k: sorted(v) for k, v in got.items()} == plain_interleave(spark, rows, 16, 11)


def test_very_long_texts_and_clashing_names(spark):
    long = "word and more words " * 120_000
    df = spark.createDataFrame([(1, long, "a", 1, 2, 3), (2, None, None, None, None, None)], "doc_id long, text string, source string, size int, shard int, _n int")
    got = {r["doc_id"]: r for r in interleave.interleave(df, shards=2).collect()}
    assert got[1]["size"] == len(long) + 1 and got[2]["size"] == 1 and {r["slot"] for r in got.values()} == {0}
    packed = vector_packing.pack(df, PATH).toPandas()
    assert packed[packed.doc_id == 1].length.sum() > 400_000 and (packed.doc_id == 2).sum() == 1


def test_one_source_and_fewer_rows_than_shards(spark):
    got = interleave.interleave(docs(spark, ROWS[:3]), shards=16).toPandas()
    assert len(got) == 3 and got.shard.is_unique and (got.slot == 0).all()


@pytest.mark.parametrize("long", [1, 2, 3, 4096])
def test_white_runs_are_cut_as_the_pattern_cuts_them(monkeypatch, long):
    monkeypatch.setattr(vector_packing, "LONG", long)
    ids_of, library, rng = vector_packing.encoder(PATH), Tokenizer.from_file(PATH), random.Random(long)
    bits = [" ", "  ", "\n", "\t", "a", "the", ".", "7", "　", "\x1c", "\x85", "\xa0", "'s", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert ids_of(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_very_long_white_runs():
    ids_of, library = vector_packing.encoder(PATH), Tokenizer.from_file(PATH)
    for text in (" " * 300_000, "a" + " " * 300_000 + "b", "x" + "\n" * 300_000 + " y"):
        assert ids_of(text).tolist() == library.encode(text, add_special_tokens=False).ids
