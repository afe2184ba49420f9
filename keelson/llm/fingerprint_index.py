"""Substring deduplication with a log-structured index of window hashes.

A window is `size` consecutive words. A word is removed if a window over it also starts
earlier: in a document with a smaller id, earlier in the same document, or in any
document of an earlier batch. Windows are judged on the input.

One pass hashes the text. Each window is filed under its minimiser, the half-window
with the smallest hash in it, so about one record in six windows travels, with its
windows' check hashes; equal windows always share a minimiser and its offset. Windows
that repeat inside a slice are settled there, so that a passage found everywhere sends one record a slice.
Records are dealt to buckets by minimiser, as packed arrays. A minimiser that holds more than a quarter
of a bucket's usual load (a line that stands in very many otherwise different documents) is dealt by whole window instead, in
which equal windows agree too; such minimisers are counted over all texts before the first batch.

A bucket sorts the batch's records and merge-joins them by minimiser with the sorted immutable runs of
earlier batches. Only where minimisers meet are windows looked at: two are equal if minimiser, offset and a 48-bit
check agree. The check is rolled over a second hash of every word, made from another seed, so that words or windows that
collide in one do not in the other. The records that hold a new window become the batch's run. When more than `fan`
runs have gathered, the same pass merges them into one, dealt to more buckets where they have outgrown these. A last pass
meets the documents with their removals, block by block.

Defined results: a null text has no words; texts of fewer than `size` words lose nothing; a
null id counts as smaller than any; rows that share an id are ordered by the crc32 of
their text, and rows that repeat another in id and text are that same document, so each
gets its result; an empty table gives no rows; a text of any length is one document (a slice holds one
text at least); other columns are kept by `dedup` as `in.<name>`, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, checkpoint_folder, cut, delete, in_slices, tidy, trim
from .word_hashes import mix, rolling, words

SIZE = 20
#: Bytes of text in a bucket of the index and in a block of documents, about.
SHARE = 8 << 20
#: Bytes of text hashed at once.
SLICE = 2 << 20
#: More runs than this are merged into one.
FAN = 4
#: A minimiser is hot from this many records on, if that is also more than a quarter of a bucket's mean load.
HOT = 256
#: Bytes of packed runs in a bucket from which a merge deals them to more buckets.
GROWN = 64 << 20

_ID = -(2**63)
_48 = np.uint64((1 << 48) - 1)
RECORDS, REMOVED, RUN = 0, 1, 2


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(arrays)}Q", *(a.nbytes for a in arrays)) + body)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}Q", raw), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _six(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = x.reshape(-1, 6)
    return out.view("<u8").ravel()


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for count[0] numbers, and so on."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _minimisers(m: np.ndarray, span: int) -> np.ndarray:
    """For each i the leftmost position of the smallest of m[i : i + span]."""
    value, at, have = m, np.arange(len(m)), 1
    while have < span:
        step = min(have, span - have)
        left, right = value[:-step], value[step:]
        keep = left <= right
        value, at = np.where(keep, left, right), np.where(keep, at[:-step], at[step:])
        have += step
    return at


def _ranges(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (doc, start) pairs as runs (doc, first start, how many)."""
    if not len(doc):
        return doc, start, start
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
    i = np.flatnonzero(new)
    return doc[i], start[i], np.diff(np.append(i, len(doc)))


def _windows(texts: list[bytes], size: int):
    """The texts' word hashes, where words of each text begin, the documents and starts of all windows and their minimisers' hashes and places."""
    h, first = words(texts)
    half = size // 2
    m = rolling(h, half, 0x9E3779B97F4A7C15)
    n = np.maximum(np.diff(first) - size + 1, 0)
    w = _spans(first[:-1], n)
    at = _minimisers(m, size - half + 1)[w] if len(w) else w
    return h, first, np.repeat(np.arange(len(texts)), n), w, m, at


def _single(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which x stand in the sorted array `among`."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _sub(offset: np.ndarray, check: np.ndarray) -> np.ndarray:
    """What tells windows of one minimiser apart, as one number."""
    return (offset.astype(np.uint64) << np.uint64(48)) | check


def _bucket(key: np.ndarray, sub: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Where records go: by minimiser, and those of hot ones (a window each) by window."""
    spread = np.where(_single(key, hot), mix(key ^ mix(sub)), key)
    return ((spread >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def scan(texts: list[bytes], ids: np.ndarray, tags: np.ndarray, blocks: np.ndarray, buckets: int, hot: np.ndarray, size: int = SIZE):
    """(bucket, kind, block, blob) of one slice: records for the index, and removals that the slice settles itself."""
    order = np.lexsort((tags, ids))
    ids, tags, blocks = ids[order], tags[order], blocks[order]
    fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    ids, tags, blocks, texts = ids[fresh], tags[fresh], blocks[fresh], [texts[k] for k in order[fresh]]
    h, first, doc, w, m, at = _windows(texts, size)
    if not len(w):
        return
    whole, check = rolling(h, size, 0xC2B2AE3D27D4EB4F)[w], rolling(words(texts, 0x5851F42D4C957F2D)[0], size, 0xA0761D6478BD642F)[w] & _48
    rank = np.argsort(whole, kind="stable")
    again = np.zeros(len(w), bool)
    again[rank[1:]] = (whole[rank[1:]] == whole[rank[:-1]]) & (check[rank[1:]] == check[rank[:-1]])
    # Runs of windows that share a minimiser, or single windows of a hot one; those with no window that is new here stay home.
    single = _single(m[at], hot)
    i = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]) | single)
    count = np.diff(np.append(i, len(w)))
    sent = np.add.reduceat(~again, i) > 0
    i, count = i[sent], count[sent]
    key, offset, owner = m[at[i]], (at[i] - w[i]).astype(np.uint8), doc[i]
    place = (w[i] - first[owner]).astype(np.uint32)
    to = _bucket(key, _sub(offset, check[i]), hot, buckets)
    o = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[o], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)):
        r = o[edge[b] : edge[b + 1]]
        who, runs = np.unique(owner[r], return_counts=True)  # r is in document order
        yield int(b), RECORDS, 0, _pack(
            ids[who], tags[who].astype(np.uint32), blocks[who].astype(np.uint32), runs.astype(np.uint32),
            key[r], place[r], offset[r], count[r].astype(np.uint8), _six(check[_spans(i[r], count[r])]),
        )
    for block, kind, blob in _removals(ids, tags, blocks, doc[again], (w - first[doc])[again]):
        yield block % buckets, kind, block, blob


def _removals(ids, tags, blocks, doc, start):
    """(block, REMOVED, blob) for windows (doc, start) in order."""
    doc, start, many = _ranges(doc, start)
    order = np.argsort(blocks[doc], kind="stable")
    doc, start, many = doc[order], start[order], many[order]
    block = blocks[doc]
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
    for s, e in zip(edge, np.append(edge[1:], len(block))):
        d = doc[s:e]
        yield int(block[s]), REMOVED, _pack(ids[d], tags[d].astype(np.uint32), start[s:e].astype(np.uint32), many[s:e].astype(np.uint32))


#: One sorted run of a bucket: minimisers, the offset and number of each one's windows, and the windows' checks.
Run = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _read_run(blob: bytes) -> Run:
    key, offset, count, check = _unpack(blob, "<u8", "u1", "u1", "u1")
    return key, offset, count, _from_six(check)


def _sorted_run(key: np.ndarray, offset: np.ndarray, count: np.ndarray, check: np.ndarray) -> Run:
    """Records in the order of their minimisers; of records sorted already in parts, the sort is a merge."""
    o = np.argsort(key, kind="stable")
    begin = np.cumsum(count, dtype=np.int64) - count
    return key[o], offset[o], count[o], check[_spans(begin[o], count[o].astype(np.int64))]


def merge(runs: list[Run]) -> Run:
    """One sorted run out of several."""
    return _sorted_run(*(np.concatenate(x) for x in zip(*runs)))


def meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge-join of two sorted arrays: which of a stand in b, and which of b in a."""
    both = np.concatenate([a, b])
    if not len(both):
        return np.zeros(0, bool), np.zeros(0, bool)
    o = np.argsort(both, kind="stable")  # a merge, as both parts are sorted
    start = np.flatnonzero(np.concatenate([[True], both[o[1:]] != both[o[:-1]]]))
    held = np.add.reduceat((o >= len(a)).astype(np.int64), start)
    many = np.diff(np.append(start, len(both)))
    met = np.zeros(len(both), bool)
    met[o] = np.repeat((held > 0) & (held < many), many)
    return met[: len(a)], met[len(a) :]


def match(blobs: list[bytes], runs: list[Run]):
    """One bucket: the documents of the batch (ids, tags, blocks), which windows (document, start) go, and the run of the records that hold a new window."""
    kinds = ("<i8", "<u4", "<u4", "<u4", "<u8", "<u4", "u1", "u1", "u1")
    parts = [_unpack(x, *kinds) for x in blobs]
    ids, tags, blocks, times, key, place, offset, count, check = (np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in enumerate(kinds))
    owner, check, count = np.repeat(np.arange(len(ids)), times), _from_six(check), count.astype(np.int64)
    o = np.argsort(key, kind="stable")
    begin = (np.cumsum(count) - count)[o]
    key, place, offset, count, owner = key[o], place[o].astype(np.int64), offset[o], count[o], owner[o]
    look = np.zeros(len(key), bool)  # records whose minimiser occurs elsewhere too
    same = np.flatnonzero(key[1:] == key[:-1])
    look[same] = look[same + 1] = True
    held = []
    for run in runs:
        here, there = meeting(key, run[0])
        look |= here
        n = run[2].astype(np.int64)
        at = np.cumsum(n) - n
        held.append((run[0][there], run[1][there], n[there], run[3][_spans(at[there], n[there])]))
    r = np.flatnonzero(look)

    def windows(key, offset, count):
        step = _spans(np.zeros(len(count), np.int64), count)
        return np.repeat(key, count), np.repeat(offset.astype(np.int64), count) - step, step

    wk, wo, step = windows(key[r], offset[r], count[r])
    wc, wr = check[_spans(begin[r], count[r])], np.repeat(r, count[r])
    who, start = owner[wr], place[wr] + step
    past = [(*windows(k, f, n)[:2], c) for k, f, n, c in held]
    k, f, c = (np.concatenate(x) for x in zip((wk, wo, wc), *past))
    old = np.arange(len(k)) >= len(wk)
    pad = np.zeros(int(old.sum()), np.int64)
    i, g, s, sub = np.concatenate([ids[who], pad]), np.concatenate([tags[who].astype(np.int64), pad]), np.concatenate([start, pad]), _sub(f, c)
    o = np.lexsort((s, g, i, ~old, sub, k))
    k, sub, old, i, g, s = k[o], sub[o], old[o], i[o], g[o], s[o]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (sub[1:] != sub[:-1])]) if len(k) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.zeros(0, int)
    gone = ~old & (old[lead] | (i != i[lead]) | (g != g[lead]) | (s != s[lead]))
    # The same document may come from several slices' records: it counts as one.
    doc, start = who[o[gone]], s[gone]
    o2 = np.lexsort((start, tags[doc], ids[doc]))
    doc, start = doc[o2], start[o2]
    repeat = np.concatenate([[False], (ids[doc][1:] == ids[doc][:-1]) & (tags[doc][1:] == tags[doc][:-1])]) if len(doc) else np.zeros(0, bool)
    doc = doc[np.maximum.accumulate(np.where(repeat, 0, np.arange(len(doc))))] if len(doc) else doc
    stays = ~look
    stays[wr[o[new & ~old]]] = True
    n = count[stays]
    return (ids, tags, blocks), (doc, start), (key[stays], offset[stays], n.astype(np.uint8), check[_spans(begin[stays], n)])


def shares_for(docs: DataFrame, text: str = "text") -> int:
    """How many buckets and blocks keep each near SHARE bytes of text."""
    return max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // SHARE))


def _numbered(docs: DataFrame, shares: int, doc_id: str, text: str) -> list:
    """Columns id, tag, block, t, of their own names."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tag = F.crc32(t.cast("binary"))
    return [F.col(doc_id).cast("long").alias("id"), tag.alias("tag"), F.pmod(F.xxhash64(F.col(doc_id), tag), F.lit(shares)).alias("block"), t.alias("t")]


def hot_minimisers(docs: DataFrame, buckets: int, text: str = "text", size: int = SIZE) -> list[int]:
    """Minimisers (as signed longs) with more records than a quarter of a bucket's mean load, and HOT at least: four a bucket at most.

    Counted over all texts; what stands in a slice of the texts only once is not reported from there. The set decides where
    records are dealt and never what is found.
    """

    def rows(batches):
        for b in in_slices(batches, "t", SLICE, 1 << 16):
            *_, m, at = _windows(as_bytes(b.column("t")), size)
            key, n = np.unique(m[at[np.concatenate([[True], at[1:] != at[:-1]])]], return_counts=True) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, int))
            many = n > 1
            total = pa.array([None, *key[many].view(np.int64).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([total, pa.array([int(n.sum()), *n[many].tolist()], pa.int64())], names=["key", "n"])

    found = cut(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInArrow(rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    records = found.filter("key is null").first()
    least = max(HOT, (records["n"] if records else 0) // buckets // 4)
    return sorted(r["key"] for r in found.filter(F.col("key").isNotNull() & (F.col("n") > least)).collect())


#: Blobs are packed already; small row groups keep few of them in a writer.
PLAIN = {"compression": "uncompressed", "parquet.block.size": 4 << 20, "parquet.enable.dictionary": "false"}
COMMIT = "batch int, runs array<int>, buckets int, size int, hot array<long>, bytes long"


@dataclass
class FingerprintIndex:
    """Sorted immutable runs of window hashes below a shared folder, one for each batch until they are merged.

    A batch writes its removals and its run to a folder of its own and counts once its commit is written, so a batch that failed
    half-way is repeated without a trace. The bucket count, the window size and the hot minimisers stand in the commits; a new
    index takes them from its arguments, an index opened again from the last commit.
    """

    spark: SparkSession
    folder: str
    buckets: int = 1
    size: int = SIZE
    fan: int = FAN
    hot: list[int] = field(default_factory=list)
    batch: int = field(default=0, init=False)
    runs: list[int] = field(default_factory=list, init=False)
    bytes: int = field(default=0, init=False)

    def __post_init__(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            last = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits").orderBy(F.desc("batch")).first()
            self.batch, self.runs, self.buckets, self.size, self.hot, self.bytes = (list(x) if isinstance(x, list) else x for x in last)

    def _kind(self, batch: int, kind: int) -> DataFrame:
        return self.spark.read.schema("place long, blob binary, kind int").parquet(f"{self.folder}/{batch}").filter(F.col("kind") == kind)

    def history(self) -> DataFrame:
        """bucket, blob of all runs that are valid now."""
        found = self.spark.createDataFrame([], "bucket long, blob binary")
        for k in self.runs:
            found = found.unionByName(self._kind(k, RUN).select(F.col("place").alias("bucket"), "blob"))
        return found

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Match a batch (id, tag, block, t, of `_numbered`) and take its windows in; gives its removals (block, blob). keep: without it the batch leaves no run."""
        number, buckets, size, hot = self.batch + 1, self.buckets, self.size, np.array(self.hot, np.int64).view(np.uint64)
        merging = keep and len(self.runs) + 1 > self.fan
        dealt_to = buckets * max(1, -(-self.bytes // (buckets * GROWN))) if merging else buckets

        def records(batches):
            for b in in_slices(batches, "t", SLICE, 1 << 16):
                ids = np.array([_ID if x is None else x for x in b.column("id").to_pylist()], dtype=np.int64)
                rows = list(scan(as_bytes(b.column("t")), ids, *(b.column(c).to_numpy() for c in ("tag", "block")), buckets, hot, size))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "kind", "block", "blob"])

        def bucket(t: pa.Table) -> pa.Table:
            trim()
            kinds, blocks, blobs = (t.column(c).to_pylist() for c in ("kind", "block", "blob"))
            at = t.column("bucket")[0].as_py()
            pick = lambda k: [x for x, kind in zip(blobs, kinds) if kind == k]
            out = [(b, REMOVED, x) for b, x, kind in zip(blocks, blobs, kinds) if kind == REMOVED]
            runs = [_read_run(x) for x in pick(RUN)]
            (ids, tags, batch_blocks), (doc, start), run = match(pick(RECORDS), runs)
            out += [(b, kind, blob) for b, kind, blob in _removals(ids, tags, batch_blocks, doc, start)]
            if keep:
                key, offset, count, check = merge([*runs, run]) if merging else run
                first = np.cumsum(count, dtype=np.int64) - count
                to = _bucket(key, _sub(offset, check[first]), hot, dealt_to) if dealt_to != buckets else np.full(len(key), at)
                for b in np.unique(to):
                    r = np.flatnonzero(to == b)
                    out.append((int(b), RUN, _pack(key[r], offset[r], count[r], _six(check[_spans(first[r], count[r].astype(np.int64))]))))
            return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], names=["place", "kind", "blob"])

        dealt = docs.select("id", "tag", "block", "t").mapInArrow(records, "bucket long, kind int, block long, blob binary")
        dealt = dealt.unionByName(self.history().select("bucket", F.lit(RUN).alias("kind"), F.lit(0).cast("long").alias("block"), "blob"))
        with tidy(self.spark):
            dealt.groupBy("bucket").applyInArrow(bucket, "place long, kind int, blob binary").write.mode("overwrite").partitionBy("kind").options(**PLAIN).parquet(f"{self.folder}/{number}")
        replaced = self.runs if merging else []
        self.runs, self.buckets = ([number] if merging else [*self.runs, number]) if keep else self.runs, dealt_to
        size_of = lambda k: self._kind(k, RUN).agg(F.sum(F.octet_length("blob"))).first()[0] or 0
        self.batch, self.bytes = number, (0 if merging else self.bytes) + (size_of(number) if keep else 0)
        row = (self.batch, self.runs, self.buckets, self.size, self.hot, self.bytes)
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        for k in replaced:
            delete(self.spark, f"{self.folder}/{k}/kind={RUN}")
        return self._kind(number, REMOVED).select(F.col("place").alias("block"), "blob")


def _apply(docs: DataFrame, removals: DataFrame, shares: int, doc_id: str, text: str, size: int, keep_text: bool) -> DataFrame:
    """docs, all columns as in.<name> (the text only with keep_text), with n_words, n_removed and kept."""
    rest = [c for c in docs.columns if c != text]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    plain = docs.select(*_numbered(docs, shares, doc_id, text), F.col(text).isNull().alias("no_text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)))

    def block(d: pa.Table, r: pa.Table) -> pa.Table:
        trim()
        gone: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for blob in r.column("blob").to_pylist():
            for i, tag, s, m in zip(*(x.tolist() for x in _unpack(blob, "<i8", "<u4", "<u4", "<u4"))):
                gone.setdefault((i, tag), []).append((s, m))
        total, lost, kept = [], [], []
        for i, tag, t in zip(d.column("id").to_pylist(), d.column("tag").to_pylist(), d.column("t").cast(pa.binary()).to_pylist()):
            w = t.split()
            total.append(len(w))
            if spans := gone.get((_ID if i is None else i, tag)):
                stay = np.ones(len(w), bool)
                for s, m in spans:
                    stay[s : s + m + size - 1] = False
                w = [w[k] for k in np.flatnonzero(stay).tolist()]
            lost.append(total[-1] - len(w))
            kept.append(b" ".join(w))
        own = [d.column(f"_{k}") for k in range(len(rest))]
        texts = [pc.if_else(d.column("no_text"), pa.scalar(None, pa.string()), d.column("t"))] if keep_text else []
        made = [pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table([*own, *texts, *made], names=[*(f"_{k}" for k in range(len(rest) + keep_text)), "n_words", "n_removed", "kept"])

    names = [*rest, *[text] * keep_text]
    schema = ", ".join([*(f"_{i} {kinds[c] if c != text else 'string'}" for i, c in enumerate(names)), "n_words long, n_removed long, kept string"])
    return plain.groupBy("block").cogroup(removals.groupBy("block")).applyInArrow(block, schema).withColumnsRenamed({f"_{i}": f"in.{c}" for i, c in enumerate(names)})


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, index: str | None = None, batches: int = 3, buckets: int | None = None, fan: int = 1, keep_text: bool = False
) -> DataFrame:
    """Every row of docs with its other columns (and with keep_text its text) as `in.<name>`, and n_words, n_removed and kept (words joined by one space).

    The documents go through an index in `batches` batches by rising id: each is merge-joined with the runs of those before it.
    index: the folder of an index that stays, for batches to come; what it holds already counts as earlier than all of docs, and
    its bucket count, window size and hot minimisers hold. Without it the index is this call's own and goes when the last batch
    is matched, and that batch leaves no run.
    """
    spark, own = docs.sparkSession, index is None
    folder = f"{checkpoint_folder(spark)}/fingerprints-{uuid.uuid4()}" if own else index
    shares = buckets or shares_for(docs, text)
    held = FingerprintIndex(spark, folder, shares, size, fan)
    if not held.batch:
        held.hot = hot_minimisers(docs, shares, text, held.size)
    rows = docs.select(*_numbered(docs, shares, doc_id, text))
    edges = sorted(set(docs.agg(F.percentile_approx(F.col(doc_id).cast("long"), [k / batches for k in range(1, batches)], 10000)).first()[0] or [])) if batches > 1 else []
    removals = []
    for k, (low, high) in enumerate(zip([None, *edges], [*edges, None])):
        inside = F.lit(True) if low is None else F.col("id") > low
        inside = inside if high is None else inside & (F.col("id") <= high)
        inside = inside | F.col("id").isNull() if low is None else inside
        removals.append(held.add(rows.filter(inside), keep=not own or k < len(edges)))
    found = removals[0]
    for r in removals[1:]:
        found = found.unionByName(r)
    if own:
        found = cut(found)
        delete(spark, folder)
    return _apply(docs, found, shares, doc_id, text, held.size, keep_text)
