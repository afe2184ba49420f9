"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation
weighs them, and the posterior decides.

Each rule looks at a document's statistics and votes good, bad or nothing. Strict rules hardly ever
err on good documents; loose ones (commas, lines, twins, letters) do so on one in five, and a
filter that asks all of them to pass would lose a third of what is good. Variety is the mean
share of distinct words in blocks of 1000 words over the whole text, as the share in the whole would
fall with its length. The
votes of a document form a pattern; there are at most 3 ** len(RULES) patterns,
so their counts over the whole corpus are a small table whatever its size. The
driver fits the rules' accuracies to that table: a document is good or bad in one of the ways of FAMILIES,
and rules of one family confirm each other. Every document gets the posterior of its pattern.

Defined results: a null text counts as empty; an empty text has zero counts, no good ratio to speak for it, and
fails the base rule; null ids and repeated rows are kept as rows of their own; a text of any length is measured whole;
an empty table gives no rows; other columns of the input are ignored by
`judge` and kept by `keep_good`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import doc_stats
from .common import as_bytes, cut, in_slices

GOOD, BAD, NONE = 1, 2, 0


def _two_sided(x: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def _ratios(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    words, letters, lines = (np.maximum(x, 1) for x in (s["n_words"], s["n_upper"] + s["n_lower"], s["n_lines"]))
    return {
        "symbols": s["n_symbols"] / words, "repeats": s["n_repeat_words"] / words, "dup_lines": s["n_dup_lines"] / lines, "upper": s["n_upper"] / letters,
        "bangs": s["n_bangs"] / words, "length": s["word_chars"] / words, "variety": s["block_distinct"] / np.maximum(s["block_words"], 1), "stops": s["n_stop_lines"] / lines,
        "twins": s["n_twins"] / words, "commas": s["n_commas"] / words, "line": s["n_words"] / lines, "letters": (s["n_upper"] + s["n_lower"]) / np.maximum(s["n_chars"], 1),
    }


# The rules. Each gives (votes bad, votes good) from the ratios r and the word count n.
RULES = {
    "symbols": lambda r, n: (r["symbols"] > 0.15, r["symbols"] < 0.03),
    "repeats": lambda r, n: (r["repeats"] > 0.3, r["repeats"] < 0.1),
    "dup_lines": lambda r, n: (r["dup_lines"] > 0.5, r["dup_lines"] < 0.05),
    "upper": lambda r, n: (r["upper"] > 0.4, r["upper"] < 0.15),
    "bangs": lambda r, n: (r["bangs"] > 0.1, r["bangs"] < 0.01),
    "length": lambda r, n: ((r["length"] < 2.5) | (r["length"] > 14), (r["length"] >= 3.5) & (r["length"] <= 10)),
    "variety": lambda r, n: (r["variety"] < 0.2, r["variety"] > 0.4),
    "stops": lambda r, n: (r["stops"] < 0.1, r["stops"] > 0.5),
    "commas": lambda r, n: (r["commas"] < 0.03, r["commas"] >= 0.045),
    "line": lambda r, n: (r["line"] > 60, r["line"] <= 45),
    "twins": lambda r, n: (r["twins"] > 0.012, r["twins"] < 0.006),
    "letters": lambda r, n: (r["letters"] < 0.72, r["letters"] >= 0.78),
}
# Ways of being bad, and the rules that see each.
FAMILIES = {
    "markup": ("symbols", "letters", "length"), "repetition": ("repeats", "variety", "dup_lines", "twins"), "shouting": ("upper", "bangs"), "unpunctuated": ("stops", "commas", "line"),
}
# End of fixed values.


def votes(s: np.ndarray) -> np.ndarray:
    """Votes of every rule (columns) on every row of a `doc_stats.table`."""
    named = {k: s[:, i] for i, k in enumerate(doc_stats.FIELDS)}
    r = _ratios(named)
    return np.stack([_two_sided(named["n_words"], *rule(r, named["n_words"])) for rule in RULES.values()], axis=1)


def codes(v: np.ndarray) -> np.ndarray:
    """A pattern of votes as one number in base 3."""
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def decode(code: np.ndarray, rules: int = len(RULES)) -> np.ndarray:
    return (np.asarray(code, dtype=np.int64)[:, None] // 3 ** np.arange(rules, dtype=np.int64)) % 3


def families() -> np.ndarray:
    """The number of each rule's family."""
    return np.array([next(k for k, names in enumerate(FAMILIES.values()) if rule in names) for rule in RULES])


def fit(v: np.ndarray, n: np.ndarray, rounds: int = 200, weight: float = 0.2, right: float = 0.95, seen: float = 0.8, rare: float = 0.1, family: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over patterns v seen n times.

    Documents are good (class 0) or bad in the way of one family of rules: shouting and repeating are different
    faults, and one class for both would let the rules that see only one of them drown each other. Returns the share
    of each class and table[class, rule, vote]: how often a rule that votes there says
    good or bad (not voting counts as no evidence, 1); a rule's accuracies are
    table[0, :, GOOD] and, in the bad classes, table[1:, :, BAD]. The start takes a document for bad
    as far as the rules of one family agree that it is (the square of their share, so that one loose vote says little). The prior, as strong as `weight` of the corpus, says only that rules are
    better than chance: right on good documents with probability `right`, and seeing the faults of their own family with `seen`, of
    others with 1 - seen, where each fault is `rare` as common as good documents. It also keeps classes in place that nothing belongs to.
    """
    family = families() if family is None else family
    kinds, cast = int(family.max()) + 1, np.stack([v == k for k in range(3)], axis=2).astype(float)
    own = family[None, :] == np.arange(kinds)[:, None]
    faults = ((v == BAD) @ own.T) / ((v != NONE) @ own.T + 0.5)
    worst = faults.max(axis=1, keepdims=True) ** 2
    p = np.hstack([1 - worst, worst * (faults + 1e-9) / (faults + 1e-9).sum(axis=1, keepdims=True)])
    prior = np.zeros((1 + kinds, v.shape[1], 3))
    prior[0, :, GOOD], prior[0, :, BAD] = right, 1 - right
    prior[1:, :, BAD] = rare * np.where(own, seen, 1 - seen)
    prior[1:, :, GOOD] = rare - prior[1:, :, BAD]
    for _ in range(rounds):
        w = n[:, None] * p
        table = np.einsum("ik,irv->krv", w, cast) + prior * weight * n.sum()
        table[:, :, NONE] = table[:, :, GOOD] + table[:, :, BAD]
        table /= table[:, :, NONE, None]
        share = (w.sum(0) + 1) / (n.sum() + 1 + kinds)
        p = _classes(v, share, table)
    return share, table


def _classes(v: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probability of every class (columns) for every pattern."""
    logs = np.log(share)[None, :] + np.log(table[:, np.arange(v.shape[1])[None, :], v]).sum(axis=2).T
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _posterior(v: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    return _classes(v, share, table)[:, 0]


def base_failed(s: np.ndarray) -> np.ndarray:
    """Under 50 words, or more than half of the words in repeated 3-word windows."""
    n, rep = s[:, 0], s[:, doc_stats.FIELDS.index("n_repeat_words")]
    return (n < 50) | (100 * rep > 50 * n)


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the five base counts, base_failed and the pattern of votes, for each document."""

    def rows(batches):
        for b in in_slices(batches, "t"):
            s = doc_stats.table(as_bytes(b.column("t")))
            cols = [b.column("doc_id"), *(pa.array(s[:, i]) for i in range(5)), pa.array(base_failed(s)), pa.array(codes(votes(s)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *doc_stats.FIELDS[:5], "base_failed", "pattern"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(
        rows, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern long"
    )


def learnt(stats: DataFrame) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """Posterior quality of each pattern, and the shares and accuracies of `fit`; one row for each pattern comes to the driver, at most 3 ** len(RULES)."""
    seen = sorted((r["pattern"], r["n"]) for r in stats.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())
    if not seen:
        return {}, np.zeros(0), np.zeros((0, len(RULES), 3))
    code, n = np.array([x[0] for x in seen]), np.array([x[1] for x in seen], dtype=float)
    v = decode(code)
    share, table = fit(v, n)
    return dict(zip(code.tolist(), _posterior(v, share, table).tolist())), share, table


def _weighed(spark, posteriors: dict[int, float]) -> DataFrame:
    """pattern, posterior to broadcast: at most 3 ** len(RULES) rows of 16 bytes (8.5 MB), whatever the corpus."""
    return F.broadcast(spark.createDataFrame(list(posteriors.items()), "pattern long, posterior double"))


def judge(docs: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its counts, base_failed, kept and the `posterior` quality."""
    s = cut(statistics(docs, doc_id, text))
    return s.join(_weighed(s.sparkSession, learnt(s)[0]), "pattern").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"), "posterior"
    )


def keep_good(docs: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns; texts are measured once and not shuffled."""
    own = {f"_{i}": c for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*own)
    at = next(k for k, c in own.items() if c == text)

    def rows(batches):
        for b in in_slices(batches, at):
            s = doc_stats.table(as_bytes(b.column(at)))
            good = pa.array(~base_failed(s))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes(votes(s))), good], names=[*own, "pattern", "passed"])

    marked = cut(plain.mapInArrow(rows, T.StructType([*plain.schema.fields, T.StructField("pattern", T.LongType()), T.StructField("passed", T.BooleanType())])))
    kept = marked.join(_weighed(docs.sparkSession, learnt(marked)[0]), "pattern").filter(F.col("passed") & (F.col("posterior") >= least))
    return kept.select(*(F.col(k).alias(c) for k, c in own.items()))
