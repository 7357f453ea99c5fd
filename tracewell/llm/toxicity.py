"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a learned lexicon of words and word beginnings and of a short
fixed one, nearness of their hits to second-person words, shares of capitals and shouted words,
punctuation and exclamation rates, and how much of it is written to get past a filter (letters
mixed with digits or symbols). The lexicon is learned from the labelled rows by log-odds of
documents, so it follows the corpus's languages. Trees and the isotonic curve are fitted by
MLlib on at most MAX_TRAIN labelled rows, the ones with the least hashes; every document's
features are counted where it lies, and texts are never shuffled. Of the labelled rows of each
label every fourth is kept for the isotonic curve: neither lexicon nor trees see it, at any size.
The lexicon holds every unit above its odds and support (on sf0.1 249 of them, from 2,636 training
rows). A unit needs 4 in 1,000 of the toxic training rows, so MAX_TRAIN bounds the lexicon as well.

Defined cases: a null text is an empty one: all features are 0 and it gets the score of that.
Where one label is missing among the rows of the trees or of the curve, the score is the share of
toxic training rows everywhere. Repeated rows get equal scores. Labels that repeat a doc_id count as
often. A very long text is read whole. Ties in the choice of training rows go by doc_id and label,
those of units by name. An empty table gives no rows. Columns of docs besides doc_id and text may
have any names: judge() ignores them, keep() returns them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import crc_rest, cut, ship, spread, whole

MAX_TRAIN = 20_000
#: Distinct units that a task counts before it passes its counts on, and words whose weights a worker remembers.
MOST_UNITS = 100_000
MOST_KNOWN = 50_000
REJECT = 0.7
#: Plain insults, and second-person words of four languages.
INSULTS = frozenset("idiot moron stupid loser trash scum worthless pathetic disgusting clown dumb fool imbecile jerk liar ugly filthy vermin garbage coward".split())
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split())
#: Digits and symbols that stand for letters.
DISGUISE = str.maketrans("0134578@$!|", "oieastbasii")
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+(?:[@$!|*'’]+[^\W_]+)*")
N_FEATURES = 15


def units(text: str) -> set[str]:
    """The words of a text and their beginnings, the latter marked by a star."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:k] + "*" for w in found for k in PREFIXES if len(w) >= k}


def weigh(word: str, lexicon: dict[str, float]) -> float:
    return max((lexicon.get(u, 0.0) for u in (word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k))), default=0.0)


class Features:
    """Dense features of texts under a lexicon; remembers a bounded number of words' weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def weight(self, word: str) -> float:
        if (w := self.known.get(word)) is None:
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
            w = self.known[word] = weigh(word, self.lexicon)
        return w

    def __call__(self, text: str | None) -> list[float]:
        words = _WORD.findall(text or "")
        if not words:
            return [0.0] * N_FEATURES
        low = [w.lower() for w in words]
        weights = list(map(self.weight, low))
        hits = [i for i, w in enumerate(weights) if w > 0]
        second = [i for i, w in enumerate(low) if w in SECOND]
        near, j = 0.0, 0
        for i in hits:  # both lists ascend
            while j + 1 < len(second) and abs(second[j + 1] - i) <= abs(second[j] - i):
                j += 1
            if second:
                near = max(near, math.exp(-abs(second[j] - i) / 4))
        mixed = [w for w in low if not w.isalpha() and not w.isdigit()]
        disguised = sum(1 for w in mixed if self.weight(w) == 0 and ((x := w.translate(DISGUISE).replace("*", "")) in INSULTS or self.weight(x) > 0))
        n, chars = len(words), len(text)
        letters = sum(map(len, words))
        return [
            len(hits) / n,
            math.log1p(len(hits)),
            math.log1p(len({low[i] for i in hits})),
            max(weights),
            sum(weights) / n,
            sum(1 for w in low if w in INSULTS) / n,
            len(second) / n,
            near,
            sum(map(str.isupper, text)) / letters,
            sum(1 for w in words if len(w) > 1 and w.isupper()) / n,
            text.count("!") / chars,
            sum(map(text.count, ".,;:?!-\"'()*#")) / chars,
            len(mixed) / n,
            disguised / n,
            math.log1p(n),
        ]


def learn_lexicon(train: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Units with their log-odds of toxic against clean training documents."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {0: Counter(), 1: Counter()}

        def counted() -> pa.RecordBatch:
            names = list(count[0] | count[1])
            columns = [pa.array(names, pa.string()), pa.array([count[1][u] for u in names], pa.int64()), pa.array([count[0][u] for u in names], pa.int64())]
            count[0].clear(), count[1].clear()
            return pa.RecordBatch.from_arrays(columns, names=["unit", "a", "b"])

        for rows in batches:
            for text, label in zip(rows.column("text"), rows.column("toxic"), strict=True):
                count[label.as_py()].update(units(text.as_py() or ""))
                if len(count[0]) + len(count[1]) > MOST_UNITS:
                    yield counted()
        yield counted()

    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    support = max(3, round(0.004 * toxic))
    found = train.select("text", "toxic").mapInArrow(tally, "unit string, a long, b long").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = found.where(F.col("a") >= support).withColumn("odds", odds).where("odds >= 2.5")
    return {r.unit: r.odds for r in found.collect()}


class Model:
    """Fitted lexicon, trees and curve."""

    def __init__(self, lexicon, trees, curve, share: float):
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share

    def score(self, docs: DataFrame) -> DataFrame:
        """_doc, all columns of docs, and _score."""
        if self.trees is None:
            return docs.select(whole(docs).alias("_doc"), F.lit(self.share).alias("_score"))
        rows = docs.select(whole(docs).alias("_doc"), array_to_vector(_features(self.lexicon, F.col("text"))).alias("_features"))
        rows = self.trees.transform(rows).withColumn("_margin", vector_to_array("_raw")[1])
        return self.curve.transform(rows).withColumn("_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_curve")))).select("_doc", "_score")


def _features(lexicon: dict[str, float], text: Column) -> Column:
    make = Features(lexicon)

    @F.arrow_udf("array<double>")  # one text at a time: a batch is never turned to Python's strings whole
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([make(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return features(F.coalesce(text, F.lit("")))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, trees: int = 20, depth: int = 4) -> Model:
    """A model from the labelled rows of docs that are not held out (crc32(doc_id) mod 3 is not 1)."""
    ship(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_rest(F.col("doc_id"), 3) != 1))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_train)
    turn = F.row_number().over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id"))
    known = known.withColumn("_curve_part", turn % 4 == 0)
    train = cut(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id"))  # known: at most max_train rows
    by = {(r.toxic, r["_curve_part"]): r["count"] for r in train.groupBy("toxic", "_curve_part").count().collect()}
    share = sum(n for (toxic, _), n in by.items() if toxic) / max(1, sum(by.values()))
    if len(by) < 4:  # a label is missing in a part
        return Model({}, None, None, share)
    lexicon = learn_lexicon(train.where("not _curve_part"), by[1, False], by[0, False])
    rows = train.select(F.col("toxic").cast("double").alias("label"), "_curve_part", array_to_vector(_features(lexicon, F.col("text"))).alias("_features"))
    rows = cut(rows.coalesce(docs.sparkSession.sparkContext.defaultParallelism))  # features are counted in as many tasks as there are cores
    gbt = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=2, seed=7)
    fitted = gbt.fit(rows.where("not _curve_part"))
    fitted = fitted.setRawPredictionCol("_raw").setProbabilityCol("_p").setPredictionCol("_hard")
    margins = fitted.transform(rows.where("_curve_part")).select("label", vector_to_array("_raw")[1].alias("_margin"))
    curve = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_curve").fit(margins)
    return Model(lexicon, fitted, curve, share)


def judge(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    scored = fit(docs, labels).score(spread(docs.select("doc_id", "text")))
    return scored.select("_doc.doc_id", (crc_rest(F.col("_doc.doc_id"), 3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= reject).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of docs, all columns, that are not rejected."""
    return fit(docs, labels).score(spread(docs)).where(F.col("_score") < reject).select("_doc.*")
