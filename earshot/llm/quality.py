"""A quality classifier as a sparse rule ensemble.

Trees are fitted on statistics of labelled texts; every path from a root to a node is a rule, a conjunction of bounds on
statistics. A logistic model with an L1 penalty weighs the rules, most get no weight, and the rest become one Spark
column expression. Labels, language, source and ids are no inputs of a score.

Labels are learned from at most ``max_rows`` labelled rows, chosen by a hash of the id; scoring reads every whole text.

Edge cases: null and empty texts have statistics zero and get a score as well; labels of one id are averaged; without
labelled rows of both classes every text gets the share of label 1 among them, or 1 where there are none, so nothing is
rejected for want of labels; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.base import carried, materialize, record, restored, text_bytes

#: Bound on the labelled rows that a model is fitted on.
MAX_ROWS = 20_000

# --- statistics ------------------------------------------------------------------------------------------------------

STATS = ("words", "word_length", "distinct_words", "repeated_words", "top_word", "upper", "digits", "stops", "marks", "symbols", "bars",
         "exclamations", "commas", "beyond_ascii", "lines", "line_words", "repeated_lines", "long_words", "capital_words", "entropy")

_UPPER, _DIGIT, _LETTER = (np.zeros(256, dtype=bool) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+<=>@\\^_`{}~"))


def statistics(text: bytes) -> tuple[float, ...]:
    """The numbers of :data:`STATS`; shares unless their name says a count."""
    words = text.split()
    if not words:
        return (0.0,) * len(STATS)
    n, size = len(words), len(text)
    bins = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    letters = int(bins[_LETTER].sum())
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [line for line in text.split(b"\n") if line.strip()]
    share = bins[bins > 0] / size
    return (
        float(n), float(lengths.mean()), len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n,
        float(bins[_UPPER].sum()) / max(letters, 1), float(bins[_DIGIT].sum()) / size, float(bins[46] + bins[63]) / n,
        float(size - letters - bins[32] - bins[10] - bins[_DIGIT].sum()) / size, float(bins[_SYMBOL].sum()) / n, float(bins[124]) / n,
        float(bins[33]) / n, float(bins[44]) / n, float(bins[128:].sum()) / size, float(len(lines)), n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1), float((lengths > 24).sum()) / n, sum(1 for w in words if w[:1].isupper()) / n,
        float(-(share * np.log2(share)).sum()))


def with_statistics(rows: DataFrame) -> DataFrame:
    """(doc, and the statistics) of rows (doc, text)."""
    def run(batches):
        for batch in batches:
            found = np.array([statistics(t) for t in text_bytes(batch.column("text"))], dtype=np.float64).reshape(-1, len(STATS))
            schema = pa.schema([batch.schema.field("doc"), *((name, pa.float64()) for name in STATS)])
            yield record(schema, doc=batch.column("doc"), **{name: found[:, k] for k, name in enumerate(STATS)})
    schema = T.StructType([rows.schema["doc"], *(T.StructField(name, T.DoubleType()) for name in STATS)])
    return rows.select("doc", "text").mapInArrow(run, schema)


# --- rules -----------------------------------------------------------------------------------------------------------

#: A rule: (statistic, at most, bound) for each of its conditions.
Rule = tuple[tuple[str, bool, float], ...]

_CONDITION = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)")


def tree_rules(described: str) -> set[Rule]:
    """Rules of all nodes below the root, from a tree's or forest's description: nested If and Else lines."""
    rules: set[Rule] = set()
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in described.splitlines():
        found = _CONDITION.match(line)
        if not found:
            if line.lstrip().startswith("Tree"):
                path = []
            continue
        depth, feature = len(found[1]), STATS[int(found[3])]
        path = [(d, c) for d, c in path if d < depth] + [(depth, (feature, found[4] == "<=", float(found[5])))]
        tightest: dict[tuple[str, bool], float] = {}
        for _, (name, most, bound) in path:
            held = tightest.get((name, most))
            tightest[name, most] = bound if held is None else (min if most else max)(held, bound)
        rules.add(tuple(sorted((name, most, bound) for (name, most), bound in tightest.items())))
    return rules


def rule_column(rule: Rule) -> Column:
    met = None
    for name, most, bound in rule:
        one = F.col(name) <= bound if most else F.col(name) > bound
        met = one if met is None else met & one
    return met.cast("double")


class RuleModel:
    """An intercept and weighted rules; ``score`` is a column over the statistics."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.lit(weight) * rule_column(rule)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _constant(share: float) -> RuleModel:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return RuleModel(float(np.log(share / (1 - share))), [])


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, trees: int = 16, depth: int = 4, penalty: float = 1e-3) -> RuleModel:
    """Trees, rules and weights from labelled rows that are not held out."""
    known = (labels.filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("labelled id"))
             .agg(F.avg(F.col("quality").cast("double")).alias("quality")).filter("quality is not null and `labelled id` is not null"))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("labelled id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    known = known.select("labelled id", (F.col("quality") >= 0.5).cast("double").alias("label"))
    rows = carried(docs.select("doc_id", "text"))
    # About max_rows ids at most, whatever the tables: small enough to send to every task.
    texts = rows.join(F.broadcast(known), F.col("doc.doc_id").cast("long") == F.col("labelled id"))
    told = texts.select(F.struct("label").alias("doc"), "text")
    sample = materialize(with_statistics(told).select(F.col("doc.label").alias("label"), *STATS), "quality-sample")
    # Some megabytes at most, from as many files as there were tasks; every pass of the fits would visit each of them.
    sample = sample.coalesce(8)
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        return _constant(1.0 if 1.0 in classes or not classes else 0.0)
    data = VectorAssembler(inputCols=list(STATS), outputCol="features").transform(sample).select("label", "features", *STATS)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.7, featureSubsetStrategy="onethird",
                                    minInstancesPerNode=5).fit(data)
    rules = sorted(tree_rules(forest.toDebugString))
    if not rules:
        return _constant(classes.get(1.0, 0) / sum(classes.values()))
    names = [f"rule {k}" for k in range(len(rules))]
    held = data.select("label", *(rule_column(r).alias(name) for r, name in zip(rules, names)))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(held).select("label", "features").cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=100).fit(vectors)
    vectors.unpersist()
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return RuleModel(float(lasso.intercept), weights)


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc, score) for every row."""
    return with_statistics(carried(docs)).select("doc", model.score().alias("score"))


#: A score of at least this is predicted good.
THRESHOLD = 0.7


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op4."""
    model = fit(docs, labels)
    return scored(docs.select("doc_id", "text"), model).select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), "score").select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted poor; columns as they were."""
    return restored(scored(docs, fit(docs, labels)).filter(F.col("score") >= THRESHOLD), docs)
