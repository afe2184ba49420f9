"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into segments. If two fingerprints differ in at most
2 * segments - 1 bits, one of the segments differs in at most one. So every segment is
indexed under its one-wildcard variants (one bit left out, 64 in all); fingerprints that are
equal in some variant are candidates, and each candidate is verified on all 64 bits.

Without a similarity, fingerprints within the radius are near copies. With one, two texts are near
copies if their fingerprints are within the radius and the Jaccard similarity of their sets of `words`-word
shingles (as 64-bit hashes) reaches it. Then real pairs travel: first a spanning forest of
each set of equal variants is verified, nearest pairs first, and after that every pair whose texts the verified
pairs have not joined yet, so that a large group of near copies does not send all its pairs. Pairs that cannot reach
the similarity never leave their task: sets whose sizes are too far apart, and in the second round sets whose
counts of shingles in BINS hash classes overlap too little. Both are upper bounds, so no pair is lost.

Only distinct fingerprints are indexed, so copies cost nothing. Variants are dealt to
buckets by their hash and travel as packed arrays; a bucket sorts them, which is the
equality join. Of a set of equal variants only a spanning forest of its links leaves the
task; sets too large to compare pair by pair are linked by sorting under every
two-bit mask instead, which is exact and takes m log m steps. Components then grow by
alternating stars, in tables.

Exact repeats of a row count once in `keep_one`, and a text of many megabytes is hashed in pieces; both
are whole rows to every result.

Defined results: a null or wordless text has fingerprint zero, linked like any other, and is similar to
wordless texts alone; texts with equal 64-bit hashes count as one; rows
with a null id get a component too but never name one; repeated rows stay rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, in_slices, tidy, trim
from .word_hashes import mix, rolling
from .word_hashes import words as word_hashes

SEED = 42
#: Sets of equal variants up to this size are compared pair by pair.
PAIRWISE = 2048
#: Variants in one bucket, about: where only links are made, and where pairs are.
BUCKET, PAIR_BUCKET = 1 << 21, 1 << 18
#: Hash classes in which shingles are counted for a bound on what two sets share.
BINS = 128
#: Fingerprint bits compared at once in a large set of equal variants, in pairs.
AT_ONCE = 1 << 18


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The hash of every run of `shingle` words, of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype="<u8")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits; bit i is set if more than half of the shingles' hashes set it."""
    hashes = shingles(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted set of 64-bit hashes of its `words`-word shingles (the whole sequence, if there are fewer words)."""
    h, first = word_hashes([t.lower() for t in texts])
    n = np.diff(first)
    by_size = {k: rolling(h, k, 0x9E3779B97F4A7C15 + 2 * k) for k in {words, *(int(x) for x in np.unique(n[(n > 0) & (n < words)]))}}
    return [np.unique(by_size[min(k, words)][s : s + max(k - words, 0) + 1]) if k else np.zeros(0, "<u8") for s, k in zip(first[:-1].tolist(), n.tolist())]


def bins(found: np.ndarray) -> np.ndarray:
    """How many hashes of a set fall into each of BINS classes, 255 at most."""
    return np.minimum(np.bincount((mix(found) % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, words: int = 0) -> DataFrame:
    """doc_id, key (64-bit hash of the text), fp, the fingerprint as a signed long, and n, the size of its set of `words`-word shingles, of every document."""

    def rows(batches):
        for b in in_slices(batches, "t"):
            texts = as_bytes(b.column("t"))
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            n = np.array([len(s) for s in shingle_sets(texts, words)] if words else [0] * len(texts), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fp), pa.array(n)], names=["doc_id", "key", "fp", "n"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), _key(text).alias("key"), F.col(text).cast("string").alias("t")).mapInArrow(rows, f"doc_id {kind}, key long, fp long, n long")


def _key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node it reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def close_pairs(fp: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions whose fingerprints differ in at most `most` bits, block by block."""
    found = []
    for i in range(0, len(fp), 256):
        x, y = np.nonzero(np.bitwise_count(fp[i : i + 256, None] ^ fp[None, i:]) <= most)
        found.append((x[x < y] + i, y[x < y] + i))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def close_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same positions as all pairs within two bits do, in m log m steps.

    Fingerprints that agree outside two bits are within two bits of each other, so those
    that are equal under a two-bit mask may be chained.
    """
    free = [k for k in range(64) if np.bitwise_count(np.bitwise_or.reduce(fp ^ fp[0]) & np.uint64(1 << k))]
    if len(free) < 2:
        return np.zeros(len(fp) - 1, int), np.arange(1, len(fp))
    found = []
    for i, p in enumerate(free):
        for q in free[i + 1 :]:
            masked = fp & ~np.uint64((1 << p) | (1 << q))
            order = np.argsort(masked, kind="stable")
            same = np.flatnonzero(masked[order[1:]] == masked[order[:-1]])
            found.append((order[same], order[same + 1]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _segments(segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of 64 bits: the number of its segment, where that begins, and its mask once shifted there."""
    if not 2 <= segments <= 32:
        raise ValueError(f"2 to 32 segments, not {segments}")
    first = 64 * np.arange(segments + 1) // segments
    wide = np.diff(first)
    of = np.repeat(np.arange(segments), wide)
    return of, first[of].astype(np.uint64), (np.uint64(1) << wide[of].astype(np.uint64)) - np.uint64(1)


def _keys(fps: np.ndarray, which: np.ndarray, segments: int) -> np.ndarray:
    """The key of a fingerprint's variant that leaves out bit `which`: that bit, and the rest of its segment."""
    _, first, mask = _segments(segments)
    w = which.astype(np.uint64)
    return (w << np.uint64(32)) | ((fps & ~(np.uint64(1) << w)) >> first[which] & mask[which])


def variants(fp: np.ndarray, segments: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every fingerprint 64 times with its variant's number (the bit left out) and key."""
    which = np.repeat(np.arange(64, dtype=np.uint64), len(fp))
    fps = np.tile(fp, 64)
    return fps, which, _keys(fps, which, segments)


def _owner(differ: np.ndarray, segments: int) -> np.ndarray:
    """The one variant that answers for a pair, by the bits it differs in: of the first segment with one such bit at most, that bit or its first."""
    of, first, mask = _segments(segments)
    out = np.full(len(differ), 64)
    for bit in reversed(range(64)):
        if bit and of[bit] == of[bit - 1]:
            continue
        part = differ >> first[bit] & mask[bit]
        one = np.bitwise_count(part) <= 1
        out[one] = bit + np.where(part[one] > 0, np.bitwise_count(part[one] - (part[one] > 0)), 0)
    return out


def _spread(key: np.ndarray) -> np.ndarray:
    x = key * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)


def joined(fps: np.ndarray, key: np.ndarray, radius: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, root) among fingerprints that share a key and differ in at most `radius` bits."""
    order = np.lexsort((fps, key))
    fps, key = fps[order], key[order]
    edge = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(edge)
    count = np.diff(np.append(start, len(key)))
    a, b = [], []
    small = np.repeat((count > 1) & (count <= 32), count)
    for d in range(1, 32):  # pairs at distance d in the sorted run
        i = np.flatnonzero(small[:-d] & (key[:-d] == key[d:])) if d < len(key) else np.zeros(0, int)
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        a.append(i)
        b.append(i + d)
    for s, c in zip(start[count > 32].tolist(), count[count > 32].tolist()):
        x, y = close_pairs(fps[s : s + c], radius) if c <= PAIRWISE or radius != 2 else close_links(fps[s : s + c])
        a.append(x + s)
        b.append(y + s)
    if not a or not sum(map(len, a)):
        return fps[:0], fps[:0]
    distinct, node = np.unique(fps, return_inverse=True)
    root = forest(node[np.concatenate(a)], node[np.concatenate(b)], len(distinct))
    moved = root != np.arange(len(distinct))
    return distinct[moved], distinct[root[moved]]


def spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs a-b those that join what `label` (changed in place) has not joined yet, without a cycle.

    Pairs with the smallest `apart` come first, and else chance picks, so that no node gets them all.
    """
    order = np.random.default_rng(len(a)).permutation(len(a))
    order = order if apart is None else order[np.argsort(apart[order], kind="stable")]
    a, b, kept = a[order], b[order], []
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        if not len(a):
            return tuple(np.concatenate(c) for c in zip(*kept)) if kept else (a, b)
        moved, i = np.unique(high, return_index=True)
        kept.append((a[i], b[i]))
        to = np.arange(len(label))
        to[moved] = low[i]
        while (further := to[to] != to).any():
            to[further] = to[to[further]]
        label[:] = to[label]


def may_share(x: np.ndarray, y: np.ndarray, n: np.ndarray, counted: np.ndarray, bound: Fraction) -> np.ndarray:
    """Whether sets x and y (positions) may be as similar as `bound`, by their sizes n and their counts in classes; never False for those that are."""
    out = np.zeros(len(x), bool)
    for i in range(0, len(x), 1 << 16):
        p, q = counted[x[i : i + (1 << 16)]], counted[y[i : i + (1 << 16)]]
        low = np.minimum(p, q)
        shared = low.sum(axis=1, dtype=np.int64)
        # similar: shared / (n + m - shared) >= bound; a class that is full in both says nothing.
        total = n[x[i : i + (1 << 16)]] + n[y[i : i + (1 << 16)]]
        out[i : i + (1 << 16)] = (shared * (bound.numerator + bound.denominator) >= total * bound.numerator) | (low == 255).any(axis=1)
    return out


def real_pairs(
    fps: np.ndarray, which: np.ndarray, group: np.ndarray | None, segments: int, radius: int, n: np.ndarray | None = None, bound: Fraction = Fraction(0), counted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in one bucket that share a variant and differ in at most `radius` bits, each in one variant of all only.

    group: what is joined already; all pairs between different groups are given. Without it, a spanning forest of each set of equal variants.
    n, counted: sizes of the shingle sets and their counts in classes; pairs that cannot be as similar as `bound` are left out.
    """
    key = _keys(fps, which, segments)
    n = np.zeros(len(fps), np.int64) if n is None else n.astype(np.int64)
    order = np.lexsort((n, key))
    fps, key, which, n = fps[order], key[order], which[order], n[order]
    group, counted = None if group is None else group[order], None if counted is None else counted[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    count = np.diff(np.append(start, len(key)))
    label, a, b = np.arange(len(key)), [], []

    def take(x: np.ndarray, y: np.ndarray, within: slice) -> None:
        """x holds the smaller sets, as a set of equal variants is in the order of n."""
        differ = fps[x] ^ fps[y]
        keep = (np.bitwise_count(differ) <= radius) & (n[x] * bound.denominator >= n[y] * bound.numerator)
        x, y, differ = x[keep], y[keep], differ[keep]
        mine = _owner(differ, segments) == which[x]
        x, y, differ = x[mine], y[mine], differ[mine]
        if group is not None:
            apart = group[x] != group[y]
            x, y = x[apart], y[apart]
            if counted is not None:
                near = may_share(x, y, n, counted, bound)
                x, y = x[near], y[near]
        elif len(x):
            part = label[within] - within.start
            x, y = (k + within.start for k in spanning(x - within.start, y - within.start, part, np.bitwise_count(differ)))
            label[within] = part + within.start
        a.append(order[x])
        b.append(order[y])

    small = np.repeat((count > 1) & (count <= 32), count)
    for d in range(1, 32):
        i = np.flatnonzero(small[:-d] & (key[:-d] == key[d:])) if d < len(key) else np.zeros(0, int)
        if not len(i):
            break
        take(i, i + d, slice(0, len(key)))
    for s, c in zip(start[count > 32].tolist(), count[count > 32].tolist()):
        # Sorted by n, so that the sets that may be as similar as the bound to one follow it closely.
        reach = np.searchsorted(n[s : s + c] * bound.numerator, n[s : s + c] * bound.denominator, "right")
        i = 0
        while i < c:
            rows = min(c - i, max(1, AT_ONCE // max(1, int(reach[i]) - i)))
            to = int(reach[i + rows - 1])
            x, y = np.nonzero(np.bitwise_count(fps[s + i : s + i + rows, None] ^ fps[None, s + i : s + to]) <= radius)
            take((x + s + i)[x < y], (y + s + i)[x < y], slice(s, s + c))
            i += rows
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _plain(column: pa.Array) -> np.ndarray:
    """Numbers as they are; BINS counts as rows of bytes."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BINS)
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _dealt(nodes: DataFrame, n: int, columns: list[str], segments: int, bucket: int) -> DataFrame:
    """bucket, the named columns (fp first) and which, packed: every node 64 times, dealt by the keys of its variants, about `bucket` of them together; n: rows of nodes."""
    buckets = max(1, -(-64 * n // bucket))

    def deal(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1 << 11):
                held = [_plain(b.column(c).slice(i, 1 << 11)) for c in columns]
                _, which, key = variants(held[0], segments)
                to = (_spread(key) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                row, which, to = order % len(held[0]), which[order].astype(np.uint8), to[order]
                first = np.searchsorted(to, np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), *(pa.array([x[first[k] : first[k + 1]].tobytes() for k in used], pa.binary()) for x in (*(h[row] for h in held), which))], names=["bucket", *columns, "which"]
                )

    return nodes.select(*columns).mapInArrow(deal, ", ".join(["bucket long", *(f"{c} binary" for c in columns), "which binary"]))


def _unpacked(t: pa.Table, *columns: str) -> list[np.ndarray]:
    raw = {c: b"".join(t.column(c).to_pylist()) for c in columns}
    return [np.frombuffer(raw[c], np.uint8).reshape(-1, BINS) if c == "counted" else np.frombuffer(raw[c], np.uint8 if c == "which" else "<u8") for c in columns]


def links(nodes: DataFrame, n: int, segments: int = 2, radius: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprints `fp` within the radius; n: rows of nodes."""

    def match(t: pa.Table) -> pa.Table:
        fps, which = _unpacked(t, "fp", "which")
        x, y = joined(fps, _keys(fps, which, segments), radius)
        return pa.table({"a": x.view(np.int64), "b": y.view(np.int64)})

    return _dealt(nodes, n, ["fp"], segments, BUCKET).groupBy("bucket").applyInArrow(match, "a long, b long").distinct()


def candidates(nodes: DataFrame, many: int, segments: int, radius: int, least: float, grouped: bool) -> DataFrame:
    """Pairs (a, b) of keys, as `real_pairs` gives them, of nodes (fp, key, n and, if grouped, the group and counted); many: rows of nodes."""
    columns, bound = ["fp", "key", "n", *(["group", "counted"] if grouped else [])], Fraction(str(least))

    def match(t: pa.Table) -> pa.Table:
        trim()
        fps, which, key, n, *more = _unpacked(t, "fp", "which", *columns[1:])
        group, counted = more if grouped else (None, None)
        x, y = real_pairs(fps, which, group, segments, radius, n, bound, counted)
        return pa.table({"a": key[x].view(np.int64), "b": key[y].view(np.int64)})

    return _dealt(nodes, many, columns, segments, PAIR_BUCKET).groupBy("bucket").applyInArrow(match, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles (key, s) have a Jaccard similarity of `least` or more."""
    bound = Fraction(str(least))

    def rows(batches):
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            keep = []
            for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                keep.append(both * bound.denominator >= either * bound.numerator)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    x, y = sets.select(F.col("key").alias("a"), F.col("s").alias("x")), sets.select(F.col("key").alias("b"), F.col("s").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(rows, "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars: (a, b) with b the smallest node of a's component.

    Minima are taken with partial aggregation and joined back, so that the
    centre of a large star is no hot group.
    """
    edges = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(edges.groupBy("a").agg(F.min("b").alias("b"))).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges = cut(small)
    return edges


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end, which is no larger end itself: then these are the components."""
    twice = edges.groupBy("a").count().filter("count > 1").select("a")
    between = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    with tidy(edges.sparkSession):
        return not twice.union(between).take(1)


def components(fps: DataFrame, segments: int = 2, radius: int = 2) -> DataFrame:
    """fp and component_id, the smallest id among the documents it reaches; one row for each distinct fp."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return _least(nodes, stars(links(nodes, nodes.count(), segments, radius)), "fp")


def _least(nodes: DataFrame, root: DataFrame, node: str) -> DataFrame:
    """The node and component_id, by the roots of `stars`."""
    owned = nodes.join(root.withColumnsRenamed({"a": node, "b": "root"}), node, "left").select(node, "least", F.coalesce("root", node).alias("root"))
    least = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    return owned.join(least, "root").select(node, "component_id")


def similar_components(docs: DataFrame, fps: DataFrame, doc_id: str, text: str, segments: int, radius: int, similarity: float, words: int) -> DataFrame:
    """key (of a text) and component_id over all pairs of texts within the radius that are similar enough."""
    nodes = cut(fps.groupBy("key").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.min("doc_id").alias("least")))
    pairs = cut(candidates(nodes, nodes.count(), segments, radius, similarity, False))
    # A text in any pair is in one of the forests, so nothing else needs to be read again.
    met = cut(nodes.join(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "key", "left_semi"))

    def rows(batches):
        for b in in_slices(batches, "t"):
            found = shingle_sets(as_bytes(b.column("t")), words)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([bins(s).tobytes() for s in found], pa.binary())], names=["key", "s", "counted"])

    # Of equal texts the one with the least id is read, so that a text with many copies is no hot key.
    texts = docs.select(F.col(doc_id).alias("least"), _key(text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    one = texts.join(met.select("least", "key"), (texts["least"].eqNullSafe(met["least"])) & (texts["key"] == met["key"]), "left_semi")
    sets = cut(one.select("key", "t").mapInArrow(rows, "key long, s binary, counted binary").dropDuplicates(["key"]))
    found = cut(similar(pairs, sets, similarity))
    group = met.join(stars(found).withColumnRenamed("a", "key"), "key", "left").select("fp", "key", "n", F.coalesce("b", "key").alias("group")).join(sets.select("key", "counted"), "key")
    rest = cut(candidates(group, met.count(), segments, radius, similarity, True)).join(pairs, ["a", "b"], "left_anti")
    return _least(nodes.select("key", "least"), stars(found.union(similar(rest, sets, similarity))), "key")


def _found(docs: DataFrame, doc_id: str, text: str, shingle: int, segments: int, radius: int, similarity: float | None, words: int) -> DataFrame:
    """doc_id, key, fp and component_id of every document."""
    if not 0 <= radius <= 2 * segments - 1:
        raise ValueError(f"{segments} segments find fingerprints within {2 * segments - 1} bits, not {radius}")
    fps = cut(fingerprints(docs, doc_id, text, shingle, 0 if similarity is None else words))
    if similarity is None:
        return fps.join(components(fps, segments, radius), "fp")
    return fps.join(similar_components(docs, fps, doc_id, text, segments, radius, similarity, words), "key")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, segments: int = 6, radius: int = 11, similarity: float | None = 0.8, words: int = 5
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    radius: bits in which fingerprints of near copies may differ, 2 * segments - 1 at most. With a similarity, only texts
    whose sets of `words`-word shingles are as similar as that are near copies.
    """
    found = _found(docs, doc_id, text, shingle, segments, radius, similarity, words)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, segments: int = 6, radius: int = 11, similarity: float | None = 0.8, words: int = 5
) -> DataFrame:
    """docs without the near copies: of each component the rows with its smallest id stay, rows that repeat another in id and text once (which of them is open).

    Rows with a null id cannot be named as copies and stay. All columns are kept, whatever their names.
    """
    row = F.struct(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns))).alias("row")
    named = docs.filter(F.col(doc_id).isNotNull())
    chosen = _found(named, doc_id, text, shingle, segments, radius, similarity, words).filter("doc_id = component_id").select("doc_id", "key").distinct()
    # The texts are dealt once, by id and text; both the join and the choice among repeats are content with that.
    packed = named.select(F.col(doc_id).alias("doc_id"), _key(text).alias("key"), row)
    first = Window.partitionBy("doc_id", "key").orderBy(F.lit(0))
    one = packed.join(chosen, ["doc_id", "key"], "left_semi").withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return one.select(*(F.col(f"row._{i}").alias(c) for i, c in enumerate(docs.columns))).unionByName(docs.filter(F.col(doc_id).isNull()))
