import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.llm import chat_windows, license_templates, mtree, piece_offsets, queries

SF = "/root/testdata/sf0.001"


# M-tree.


def brute(ids, x, q, k, skip):
    scored = sorted((-int(np.dot(v.astype(object), q.astype(object))), int(i)) for i, v in zip(ids, x) if i != skip)
    return [(-s, i) for s, i in scored[:k]]


@pytest.mark.parametrize("kind", ["random", "clusters", "copies", "far"])
def test_tree_is_exact(kind):
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (1500, 8))
    if kind == "clusters":
        x = rng.integers(-5, 5, (1500, 8)) + rng.choice(rng.integers(-200, 200, (5, 8)), 1500)
    if kind == "copies":
        x[:1200] = x[0]
    if kind == "far":
        x[:10] *= 1000
    ids = rng.permutation(5000)[:1500]
    tree = mtree.MTree.loads(mtree.MTree.build(ids, x).dumps())
    computed = []
    for i in range(0, 1500, 37):
        found, n = tree.search(x[i], 5, int(ids[i]))
        computed.append(n)
        assert found == brute(ids, x, x[i], 5, ids[i])
    if kind == "clusters":
        assert np.mean(computed) < 1000  # stored bounds spare computations


def test_search_over_odd_vectors(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [-0.001, 1.0]), (50, [0.1, 0.9]), (50, [0.1, 0.9]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, q int, tree int, blob string")
    got = mtree.search(df, every=50, k=3).collect()
    q = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (2 - len(v)) for i, v in rows if i in (0, 1, 2, 7, 8, 50)}
    for a in (0, 50):
        want = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:3]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == a] == want
    assert {r["query_id"] for r in got} == {0, 50} and mtree.search(df.limit(0)).count() == 0
    few = df.filter("vec_id in (0, 1)")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in mtree.search(few).collect()] == [(0, 1, 1)]


def test_many_trees_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 60)
    monkeypatch.setattr(mtree, "QUERIES", 4)
    same_as_sql(spark, "op1_mtree_search")


def test_an_id_with_several_vectors_is_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 0.9]), (3, [0.5, 0.5])]
    got = mtree.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 65536), (0, 2, 256 * 230), (0, 3, 128 * 256)]


def test_bounds_spare_trees_and_a_hot_vector_is_split(spark, monkeypatch):
    """Clustered rows, a third of them copies of one vector: most trees are never asked, no tree is large, and the answer is that of brute force."""
    monkeypatch.setattr(mtree, "TREE", 50)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * 0.05
    x[600:] = x[0]
    ids = rng.permutation(10_000)[:900]
    vectors = mtree.vectors_of(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")).cache()
    asked = []
    answers = mtree._answers
    monkeypatch.setattr(mtree, "_answers", lambda forest, routed, k: (asked.append((forest.count(), [len(mtree.MTree.loads(r["blob"]).ids) for r in forest.collect()], routed.select("cell", "part").distinct().count())), answers(forest, routed, k))[1])
    chosen = vectors.filter(F.col("vec_id") % 25 == 0)
    got = {}
    for r in mtree.top_k(vectors, chosen, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    q = {r["vec_id"]: np.array(r["q"]) for r in vectors.collect()}
    assert got == {i: brute(list(q), list(q.values()), q[i], 5, i) for i in q if i % 25 == 0}
    trees, sizes, _ = asked[0]
    assert trees >= 18 and max(sizes) < 120 and asked[1][2] < trees


def same_as_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLE[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


# SentencePiece.

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)
texts = st.text(alphabet=st.one_of(st.sampled_from(list("ab  ▁\n\x00é日😀\u3000<>/s")), st.characters(codec="utf-8")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_and_spans(text):
    ids, joined, begins, ends = next(piece_offsets.encoder(MODEL)([text]))
    raw = text.encode()
    assert ids == LIB.encode(text) and joined == ",".join(map(str, ids))
    assert (begins[1:] == ends[:-1]).all() and (not ids or (begins[0], ends[-1]) == (0, len(raw)))
    for i, b, e in zip(ids, begins, ends):
        if not LIB.is_byte(i):
            piece = LIB.id_to_piece(i).replace("▁", " ")
            assert raw[b:e].decode().replace("▁", " ") == (piece if b else piece.removeprefix(" ")) or b == 0


def test_character_map_takes_the_longest_prefix():
    table = {"ﬁ": "fi", "A": "a", "AB": "x y", "ABCD": "z", "　": " ", "é": ""}
    chars = piece_offsets.CharMap.parse(piece_offsets.CharMap.compile(table))
    norm, begins, ends = piece_offsets.Normaliser(chars)("  ﬁ　ABC é ABCD ".encode())
    assert norm.decode() == "▁fi▁x▁yC▁z"
    raw = "  ﬁ　ABC é ABCD ".encode()
    spans = {norm[k : k + 1]: raw[b:e].decode() for k, (b, e) in enumerate(zip(begins, ends)) if norm[k] < 128}
    assert spans == {b"f": "ﬁ", b"i": "ﬁ", b"x": "AB", b"y": "AB", b"C": "C", b"z": "ABCD"}
    assert piece_offsets.Normaliser(chars)(b"")[0] == b"" and piece_offsets.Normaliser(chars)(b"  ")[0] == b""


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="AaBCé ▁日", max_size=12), st.booleans())
def test_normalising_with_and_without_squeezing(text, squeeze):
    table = {"A": "a", "AB": "b", "aa": "c"}
    norm, begins, ends = piece_offsets.Normaliser(piece_offsets.CharMap.parse(piece_offsets.CharMap.compile(table)), squeeze=squeeze)(text.encode())
    plain, i = "", 0
    while i < len(text):
        source = next((s for s in ("AB", "aa", "A") if text.startswith(s, i)), text[i])
        plain, i = plain + table.get(source, source), i + len(source)
    if squeeze:
        plain = re.sub(" +", " ", plain).strip(" ")
    assert norm.decode() == ("▁" + plain.replace(" ", "▁") if plain else "")
    assert len(norm) == len(begins) == len(ends) and (begins <= ends).all() and (np.diff(begins) >= 0).all()


def test_encoding_documents(spark):
    rows = [(1, "Hello  world\n"), (1, "Hello  world\n"), (None, None), (3, ""), (4, "x" * 5000)]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, ids int, decoded string")
    got = piece_offsets.encode(df, MODEL).collect()
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in got] == [(i, LIB.encode(t or ""), LIB.decode(LIB.encode(t or ""))) for i, t in rows]
    short = piece_offsets.digests(df, MODEL).collect()
    for r, (_, t) in zip(short, rows):
        ids = LIB.encode(t or "")
        assert r["n_tokens"] == len(ids) and r["covered"] == len((t or "").encode())
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
    assert piece_offsets.digests(df.limit(0), MODEL).count() == 0


# License templates.


def as_regex(template):
    out = template
    while "<<optional>>" in out:  # the innermost first
        out = re.sub(r"<<optional>> ((?:(?!<<optional>>|<<end>>).)*) <<end>>", lambda m: f"(?:{m[1]} )?", out)
    out = re.sub(r"<<one of (.*?)>>", lambda m: f"(?:{m[1]})", out)
    out = re.sub(r"<<words (\d+)-(\d+)>> ?", lambda m: f"(?:[^ ]+ ){{{m[1]},{m[2]}}}", out)
    return re.compile(" " + re.sub(r"\)\? ", ")?", out) + " ")


WORDS = sorted({w for t in license_templates.TEMPLATES.values() for w in re.sub("<<.*?>>", "", t).split()} | {"released", "distributed", "acme", "2024"})
pieces = st.sampled_from([*(re.sub("<<.*?>>", "", t).replace("  ", " ") for t in license_templates.TEMPLATES.values()), "all rights reserved", "Licensed under the", "released under the", "MIT license", "gnu general public license", "copyright acme 2024", "cc by"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(WORDS), pieces), max_size=14))
def test_automata_accept_what_patterns_do(parts):
    text = "; ".join(parts)
    words = license_templates.words_of(text.encode())
    spaced = b" " + b" ".join(words) + b" "
    for name, t in license_templates.TEMPLATES.items():
        assert license_templates.Automaton.compile(t).found(words, spaced) == bool(as_regex(t).search(spaced.decode())), name


def test_scan_of_one_text():
    compiled = {k: license_templates.Automaton.compile(v) for k, v in license_templates.TEMPLATES.items()}
    assert license_templates.scan(b"", compiled) == (0, 0, None, None, "", "", 0.0)
    text = "CC-BY cc by Ünder a General PUBLIC\nLicense. Released under the MIT License".encode()
    assert license_templates.scan(text, compiled) == (14, 3, 0, 6, "cc-by,gpl", "cc-by,gpl,mit", 1.0)


BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
BSD_3 = "3. Neither the name of Acme Ltd. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_W = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'


def test_whole_notices_and_altered_ones():
    compiled = {k: license_templates.Automaton.compile(v) for k, v in license_templates.TEMPLATES.items()}
    of = lambda text: license_templates.scan(text.encode(), compiled)[5].split(",")
    assert of(BSD_1 + BSD_W) == ["bsd", "bsd-2-clause"] and of(BSD_1 + BSD_3 + BSD_W) == ["bsd", "bsd-3-clause"]
    assert of("x = 1\n" + GPL) == ["gpl", "gpl-3.0-notice"] and of("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007") == ["gpl", "gpl-3.0-title"]
    assert of("The MIT License\n" + MIT) == ["mit-notice", "mit-text"]
    # Altered conditions or warranty wording: the opening sentence alone is named.
    assert of(BSD_1 + "3. No warships.\n" + BSD_W) == ["bsd"] and of(BSD_1 + BSD_W.replace("CONSEQUENTIAL", "other")) == ["bsd"]
    assert of(MIT.replace("WITHOUT WARRANTY", "WITH A WARRANTY")) == ["mit-notice"] and of(GPL.replace("version 3", "version 2")) == ["gpl"]


def made_from(template, rng):
    """A text that a template accepts, by chance, and the places of its mandatory words."""
    out, fixed, skipping = [], [], []
    for mark, word in license_templates._MARKUP.findall(template):
        if mark == "optional":
            skipping.append(bool(skipping and skipping[-1]) or rng.random() < 0.5)
        elif mark == "end":
            skipping.pop()
        elif skipping and skipping[-1]:
            continue
        elif word:
            fixed += [len(out)] if not skipping else []
            out.append(word)
        elif mark.startswith("one of "):
            out.append(rng.choice(mark[7:].split("|")))
        else:
            low, high = map(int, mark.removeprefix("words ").split("-"))
            out += [f"name{k}" for k in range(rng.randint(low, high))]
    return out, fixed


@pytest.mark.parametrize("name", license_templates.TEMPLATES)
def test_texts_made_from_templates_and_near_misses(name):
    rng, template = random.Random(name), license_templates.TEMPLATES[name]
    automaton, sep = license_templates.Automaton.compile(template), ["\n", "; ", " -- ", " "]
    accepts = lambda words: automaton.found(w := license_templates.words_of(" ".join(x + rng.choice(sep) for x in words).encode()), b" " + b" ".join(w) + b" ")
    for _ in range(20):
        words, fixed = made_from(template, rng)
        around = ["before"] * rng.randrange(3), ["after"] * rng.randrange(3)
        assert accepts([*around[0], *words, *around[1]])
        k = rng.choice(fixed)
        assert not accepts([*words[:k], "altered", *words[k + 1 :]])
        inner = fixed[len(fixed) // 2]
        assert not accepts([*words[:inner], *words[inner + 1 :]]) or words[inner - 1 : inner + 2].count(words[inner]) > 1


def test_long_texts_are_scanned_whole(spark):
    long = "nothing of note here " * 200_000 + "Licensed under an MIT License"
    df = spark.createDataFrame([(1, long, "x", 1.0)], "doc_id long, text string, labels string, score double")
    r = license_templates.label(df).first()
    assert len(long) > 4 * 10**6 and r["n_words"] == 800_005 and r["labels"] == "" and r["score"] == 0.0
    granted = license_templates.label(df.selectExpr("doc_id", "replace(text, 'Licensed under an', 'Released under the') as text")).first()
    assert granted["labels"] == "mit" and granted["score"] == 1.0


def test_licenses_of_documents(spark):
    df = spark.createDataFrame([(1, None, "q"), (1, "cc by", "q"), (None, "cc by", "q")], "doc_id long, text string, labels string")
    assert sorted(map(str, ((r["doc_id"], r["n_base"], r["labels"]) for r in license_templates.label(df).collect()))) == sorted(map(str, [(1, 0, ""), (1, 1, "cc-by"), (None, 1, "cc-by")]))
    assert license_templates.label(df.limit(0)).count() == 0
    same_as_sql(spark, "op9_license_templates")


# Chat windows.

CONVS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a\\b<|im_end|>\n<\\|"), (1, 2, "assistant", "</s>[INST] ok [/INST]\\"), (1, 3, "user", "long " * 120), (1, 4, "assistant", "x<|im_new|>\n" * 30), (1, 5, "user", ""),
    (2, 0, "user", None), (2, None, None, "first"), (2, 0, "user", None), (None, 3, "assistant", "é😀"), (3, 0, "system", "only"), (4, 0, "ro\nle\\x", "\\x41"),
] + [(5, k, "assistant" if k % 2 else "user", f"turn {k} " + "word " * (k % 17)) for k in range(60)]


@pytest.mark.parametrize("budget, history", [(64, 2), (200, 0), (100_000, 4)])
def test_windows_read_back(spark, budget, history):
    df = spark.createDataFrame([(*r, 0, 0, "z") for r in CONVS], "conv_id long, turn int, role string, text string, c int, w int, i string")
    made = chat_windows.windows(df, budget, history).cache()
    got = {r["conv_id"]: r for r in chat_windows.read_back(made).collect()}
    for conv in {r[0] for r in CONVS}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in CONVS if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))]
        learnt = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(learnt) and r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    own = made.filter("conv_id = 5").orderBy("window").collect()
    assert all(r["n_tokens"] <= budget for r in own)
    if budget == 64:
        assert len(own) > 5 and all(r["formatted"].split(chat_windows.NEW)[0].count("<|im_start|>") <= 2 for r in own) and any(r["formatted"].split(chat_windows.NEW)[0] for r in own[1:])
        assert all(r["formatted"].startswith("<|im_start|>system\nbe kind") for r in made.filter("conv_id = 1 and window > 0").collect())
    made.unpersist()


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_windows.read_back(chat_windows.windows(df)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="\\<|>/s[INST]x\n", max_size=20))
def test_escapes_come_back(spark, text):
    from pyspark.sql import functions as F

    made, back = spark.range(1).select(chat_windows.escaped(F.lit(text)).alias("e")).select("e", chat_windows.unescaped(F.col("e"))).first()
    assert back == text and not re.search(r"<\||</?s>|\[/?INST\]", made)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_chat_query_against_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '/root/testdata/sf{sf}/conversations.parquet'")
    want = c.sql(queries.ORACLE["op5_chat_windows"])
    got = queries.QUERIES["op5_chat_windows"](spark, f"/root/testdata/sf{sf}")
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = sorted(map(tuple, got.select(*columns).collect()))
    assert rows == sorted(want.project(", ".join(columns)).fetchall()) and rows[0][0] == -1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1  # a text travels once


def test_the_budget_bounds_every_script(spark):
    text = {"latin": "word " * 400, "han": "\u6f22\u5b57" * 900, "long": "x" * 4000}
    rows = [(k, n, "user" if n % 2 == 0 else "assistant", t[: len(t) // 2]) for k, t in text.items() for n in range(8)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    made = chat_windows.windows(df, budget=2048).collect()
    assert all(r["n_tokens"] <= 2048 for r in made)
    assert all(r["formatted"].count("\u6f22") * 2 <= 2048 and len(r["formatted"]) <= 4 * 2048 for r in made)


def test_odd_turns(spark):
    """Null conversation, turn, role and text, repeated rows, a very long turn, and columns with the names used inside."""
    long = "so it goes. " * 60_000
    rows = [(None, 1, "user", "a"), (None, None, None, None), (1, 1, "user", "same"), (1, 1, "user", "same"), (1, 2, "assistant", long), (1, 3, "assistant", ""), (2, 0, "system", "be brief")]
    df = spark.createDataFrame([(*r, 7, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, i int, line string, w int")
    back = {r["conv_id"]: r for r in chat_windows.read_back(chat_windows.windows(df, 64, 2)).collect()}
    assert {k: r["n_turns"] for k, r in back.items()} == {None: 2, 1: 4, 2: 1}
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert back[None]["turns_sha256"] == digest(("", ""), ("user", "a")) and back[1]["turns_sha256"] == digest(("user", "same"), ("user", "same"), ("assistant", long), ("assistant", ""))
    assert back[1]["loss_chars"] == len(long) and back[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
