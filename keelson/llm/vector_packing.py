"""Best-fit packing of documents into training sequences under several capacities.

A sequence holds at most `tokens` tokens, `docs` pieces and `cost` tiles of causal attention: a piece of n tokens
touches t (t + 1) / 2 tiles, t = n / TILE rounded up, so short pieces cost more than their share. Pieces come in order of
falling length; each goes to the open sequence, among those with room in every capacity, whose weighted residual norm
after the piece is smallest (rule "norm") or whose residual has the largest weighted dot
product with the piece ("dot"); if none has room a new one opens.

Only documents longer than a sequence are cut, into full pieces with a shorter one
first; full pieces are sequences of their own. Tokenising is one pass without a shuffle;
then only lengths and checksums travel, to groups of about GROUP documents dealt by a
hash of all that travels, so no key can make one group large.

Defined results: a null or empty text is the end token alone; null ids and repeated rows
are packed as rows of their own; pieces of one length come in the order of their ids; a text of any length is
tokenised whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_slices

#: Documents packed together, about.
GROUP = 32768
#: Tokens along a side of a tile of attention.
TILE = 128
#: Pieces in a sequence at most, and tiles of attention beyond those of one full piece.
DOCS, SPARE = 32, 1
#: Weights of the residuals of tokens, documents and tiles.
WEIGHTS = (1.0, 0.1, 0.1)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: the pattern that byte-level vocabularies of this kind split by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: the characters that Unicode calls white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# End of fixed values.
#: White runs of this many characters or more are cut out ahead of the pattern.
LONG = 4096


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to the ids that the tokenizers library gives without special tokens, as uint32.

    A byte-level BPE whose merges stand in the order of their ids runs on tiktoken, which
    gives the same ids several times faster; any other file runs on tokenizers itself.
    """
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, pre = d["model"], d.get("pre_tokenizer") or {}
    merged = [model.get("vocab", {}).get("".join(m.split(" ", 1) if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
    plain = (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not d.get("normalizer")
        and not model.get("dropout") and not model.get("ignore_merges") and merged == sorted(merged) and len(set(merged)) == len(merged)
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in d.get("added_tokens", []))
    )
    if plain:
        import tiktoken

        letters, special = _byte_letters(), {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
        own = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def ids(text: str) -> np.ndarray:
            parts = [np.array(own._encode_single_piece(t), dtype=np.uint32) if alone else own.encode_to_numpy(t, allowed_special="all") for t, alone in spaced(text, tuple(special), LONG)]
            return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])

        return ids
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(path)
    return lambda text: np.array(other.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def spaced(text: str, special: tuple[str, ...], long: int):
    """Parts of a text to encode on their own, and whether a part is one whole word of white space.

    The pattern's look-ahead holds every character of a white run on its stack, so runs of `long` characters
    or more are cut out as it would cut them: all of a run but its last character, which may open the next
    word; a run ahead of a special token or at the end of the text is whole.
    """
    at = 0
    for run in re.finditer(f"[{WHITE}]{{{long},}}", text) if len(text) >= long else ():
        end = run.end()
        if end < len(text) and not text.startswith(special, end):
            end -= 1
        if run.start() > at:
            yield text[at : run.start()], False
        if end > run.start():
            yield text[run.start() : end], True
        at = end
    if at < len(text):
        yield text[at:], False


def cuts(n: int, most: int) -> list[int]:
    """Where the pieces of n tokens begin: a shorter one first, then full ones."""
    head = (n - 1) % most + 1
    return [0, *range(head, n, most)]


def tokenized(docs: DataFrame, path: str, most: int, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n tokens with the end token, and the crc32 of each piece's ids (little-endian, unsigned 32 bits)."""

    def rows(batches):
        ids_of = encoder(path)
        for b in in_slices(batches, "t"):
            n, crcs = [], []
            for t in b.column("t").to_pylist():
                ids = np.append(ids_of(t or ""), end).astype("<u4")
                at = cuts(len(ids), most)
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[s:e].tobytes()) for s, e in zip(at, [*at[1:], len(ids)])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n", "crcs"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(rows, f"doc_id {kind}, n long, crcs array<long>")


def tiles(lengths):
    """Tiles of causal attention that pieces of these lengths touch."""
    t = -(-lengths // TILE)
    return t * (t + 1) // 2


def best_fit(lengths: np.ndarray, tokens: int, docs: int, cost: int, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Lengths must be at most `tokens`, and their tiles at most `cost`."""
    caps, w = np.array([tokens, docs, cost], dtype=float), np.array(weights)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room, name = np.empty((3, 1024)), np.empty(1024, np.int64)
    opened = live = 0
    shortest = lengths.min(initial=tokens)
    sizes = np.stack([lengths, np.ones_like(lengths), tiles(lengths)]).astype(float)
    for k, i in enumerate(np.argsort(-lengths, kind="stable").tolist()):
        size = sizes[:, i : i + 1]
        now = room[:, :live]
        fits = np.flatnonzero((now >= size).all(axis=0))
        if len(fits):
            left = now[:, fits]
            if rule == "norm":
                rank = w @ (((left - size) / caps[:, None]) ** 2)
            else:
                rank = -(w * size[:, 0] / caps) @ (left / caps[:, None])
            j = int(fits[rank.argmin()])
        else:
            if live == room.shape[1]:
                room, name = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([name, np.empty_like(name)])
            j, live = live, live + 1
            room[:, j], name[j] = caps, opened
            opened += 1
        bins[i], offsets[i] = name[j], tokens - room[0, j]
        room[:, j] -= size[:, 0]
        if k % 512 == 511:  # sequences that nothing fits any more are closed
            open_ = np.flatnonzero((room[0, :live] >= shortest) & (room[1, :live] >= 1) & (room[2, :live] >= tiles(shortest)))
            room[:, : len(open_)], name[: len(open_)], live = room[:, open_], name[open_], len(open_)
    return bins, offsets


def pack(
    docs: DataFrame, path: str, tokens: int = 1024, max_docs: int = DOCS, max_cost: int | None = None, end: int = 2, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    max_cost (in tiles) must leave room for a full piece; by default it is that and SPARE tiles. Both it and max_docs bind
    where many short documents would share a sequence.
    """
    most_docs, most_cost = max_docs, max_cost or int(tiles(tokens)) + SPARE
    if most_cost < tiles(tokens):
        raise ValueError(f"max_cost must be at least {tiles(tokens)} tiles, those of a full piece")
    items = cut(tokenized(docs, path, tokens, end, doc_id, text))
    groups = max(1, -(-items.count() // GROUP))
    kind = items.schema["doc_id"].dataType.simpleString()

    def group(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        n = t.column("n").to_numpy()
        crcs = t.column("crcs").combine_chunks()
        many = -(-n // tokens)
        row = np.repeat(np.arange(len(n)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        head = (n - 1) % tokens + 1
        start = np.where(piece == 0, 0, head[row] + (piece - 1) * tokens)
        length = np.where(piece == 0, head[row], tokens)
        part = length < tokens
        bins, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        bins[part], offset[part] = best_fit(length[part], tokens, most_docs, most_cost, rule, weights)
        bins[~part] = bins[part].max(initial=-1) + 1 + np.arange((~part).sum())
        at = t.column("g")[0].as_py()
        return pa.table(
            {
                "doc_id": t.column("doc_id").take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                "ids_crc32": crcs.flatten(), "sequence_id": pa.array(bins + (at << 32)), "offset": pa.array(offset),
            }
        )

    dealt = items.withColumn("g", F.pmod(F.xxhash64("doc_id", "n", "crcs"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(group, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
