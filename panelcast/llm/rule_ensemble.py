"""Quality classifier: a sparse rule ensemble.

Trees are grown on statistics of the text. Every path from a root to a node is a rule, a conjunction of
bounds on statistics. A lasso logistic regression over the rules gives most of them no weight, and the rest
are compiled into one column expression, so scoring is a projection of the statistics.

Labels are learned from at most about ``MAX_LABELLED`` documents, chosen by hash; statistics and scores
cover every document.

Defined results: null text has the statistics of empty text; a document with several labels has their
majority (1 in a draw); labels other than 0 and 1, and labels or documents without ``doc_id``, are not
learned from; without labels of both kinds the score is the same for all: the share of label 1, or 0.5;
repeated rows are scored once each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.text import as_bytes, is_held_out, is_learned, map_rows
from panelcast.sources.stage import stage

HELD_OUT = (5, 0)
PREDICT_AT = 0.3
MAX_LABELLED = 200_000
TREES = 20
DEPTH = 3
LASSO = 0.002
#: A rule must hold for at least this share of the rows learned from, and fail for as many.
LEAST_SUPPORT = 0.005

STATISTICS = (
    "log_words", "word_length", "longest_word", "upper", "digit", "symbol", "punctuation", "wide", "space",
    "line_words", "repeated_lines", "distinct_words", "top_word", "plain_words", "marked_words", "capital_words",
)

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGIT, _SYMBOL, _MARK = b"0123456789", b"#*$%&|<>=_~^@\\", b".,;:!?'\"()-"
_WIDE, _TAIL = bytes(range(0x80, 0x100)), bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\v\f\r"
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def share(text: bytes, kind: bytes) -> float:
    return (len(text) - len(text.translate(None, kind))) / len(text)


def statistics(text: bytes | None) -> tuple[float, ...]:
    """The values of ``STATISTICS`` for the whole text."""
    tokens = text.split() if text else []
    if not tokens:
        return (0.0,) * len(STATISTICS)
    n = len(tokens)
    lines = [line for line in text.split(b"\n") if line.strip()]
    often = Counter(tokens)
    inside = sum(map(len, tokens))
    plain = sum(k for w, k in often.items() if len(w.translate(None, _NOT_LETTERS)) == len(w))
    marked = sum(k for w, k in often.items() if w[-1] in _SYMBOL or w[-1:] == b"!")
    capital = sum(k for w, k in often.items() if len(w) > 1 and w.isupper())
    return (
        float(len(bin(n)) - 2), inside / n, float(min(200, max(map(len, often)))),
        share(text, _UPPER), share(text, _DIGIT), share(text, _SYMBOL), share(text, _MARK), share(text, _WIDE),
        share(text, _SPACE), min(1000.0, n / len(lines)), 1 - len(set(lines)) / len(lines), len(often) / n,
        max(often.values()) / n, plain / n, marked / n, capital / n,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each document."""

    def of_batch(batch: pa.RecordBatch) -> list:
        return list(map(list, zip(*map(statistics, as_bytes(batch.column("text"))))))

    added = ", ".join(f"{name} double" for name in STATISTICS)
    return map_rows(docs.select("doc_id", "text"), of_batch, added).drop("text")


Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(dump: str) -> set[Rule]:
    """All paths of a tree's printed form, as sorted (statistic, is upper bound, bound); tighter bounds replace wider."""
    rules, path = set(), []
    for line in dump.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, int(found[2]), found[3] == "<=", float(found[4])))
        bounds: dict[tuple[int, bool], float] = {}
        for _, feature, upper, value in path:
            old = bounds.get((feature, upper), value)
            bounds[feature, upper] = min(old, value) if upper else max(old, value)
        rules.add(tuple(sorted((f, upper, v) for (f, upper), v in bounds.items())))
    return rules


def holds(rule: Rule) -> Column:
    """The rule as a condition on the statistics."""
    condition = F.lit(True)
    for feature, upper, value in rule:
        column = F.col(STATISTICS[feature])
        condition = condition & (column <= value if upper else column > value)
    return condition


@dataclass(frozen=True)
class RuleEnsemble:
    """Probability of label 1: the logistic of ``bias`` plus the weights of the rules that hold."""

    bias: float
    weights: tuple[tuple[Rule, float], ...] = ()

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def one_label(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id`` and ``label``, one row each, of about ``most`` documents at most, chosen by hash."""
    clean = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    each = clean.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    n = each.count()
    if n > most:
        each = each.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return each


def constant(share_of_ones: float | None) -> RuleEnsemble:
    import math

    p = 0.5 if share_of_ones is None else min(max(share_of_ones, 1e-6), 1 - 1e-6)
    return RuleEnsemble(math.log(p / (1 - p)))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 1) -> RuleEnsemble:
    """From rows of statistics and ``label``, read several times."""
    share_of_ones = rows.agg(F.avg("label")).first()[0]
    if share_of_ones in (None, 0.0, 1.0):
        return constant(share_of_ones)
    vectors = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(vectors)
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not rules:
        return constant(share_of_ones)
    support = rows.agg(*[F.avg(holds(r).cast("double")) for r in rules]).first()
    rules = [r for r, s in zip(rules, support) if LEAST_SUPPORT <= s <= 1 - LEAST_SUPPORT]
    if not rules:
        return constant(share_of_ones)
    matrix = stage(rows.select(
        "label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features")), "rule_matrix")
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(matrix)
    weights = [(r, float(w)) for r, w in zip(rules, lasso_fit.coefficients) if w]
    return RuleEnsemble(float(lasso_fit.intercept), tuple(weights))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = stage(with_statistics(docs).withColumn("held_out", is_held_out(*HELD_OUT)), "text_statistics")
    learned = rows.join(one_label(labels.where(is_learned(*HELD_OUT))), "doc_id")
    model = fit(stage(learned.select("label", *STATISTICS), "labelled_statistics"))
    scored = rows.withColumn("score", model.column())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
