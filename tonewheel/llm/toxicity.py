"""Toxicity by a classifier chain: categories one after the other, each linear model seeing the earlier probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewheel.session import settle

#: Labelled documents that the chain is fitted on at most, drawn by a hash of their ids; scoring reads every document.
MAX_LABELLED = 20_000
#: The model's size, not the rows': words per category whose share of positive documents is farthest from the category's; each in so many documents.
VOCABULARY, LEAST_DOCS = 1_500, 5
FOLDS = 2
STEPS = 30
PARTS = 2
PENALTY = 2e-4
GRID = [k / 100 for k in range(5, 100, 5)]


@dataclass
class Chain:
    words: CountVectorizerModel
    categories: list[str]
    models: list[LogisticRegressionModel] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    #: Categories with too few labels to leave a fold out: their training probabilities come from models that saw them.
    in_fold: list[str] = field(default_factory=list)
    #: Categories without two classes among the labels: no model, probability null.
    left_out: list[str] = field(default_factory=list)


def word_list(text: Column) -> Column:
    """Words in lower case; what is no letter, mark or digit parts them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _facts(docs: DataFrame) -> DataFrame:
    """``words`` and ``form``: shouted words and runs of symbols, per word. Null texts have none of either."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    count = F.greatest(F.size("words"), F.lit(1))
    return docs.withColumn("words", word_list(text)).withColumn("form", F.array(
        F.regexp_count(text, F.lit("[A-Z]{2,}")) / count, F.regexp_count(text, F.lit("[#$%&*!|]{2,}")) / count,
        F.log1p(F.size("words").cast("double")) / 10,
    ))


def _vectors(bagged: DataFrame, earlier: list[str], bag: str = "bag") -> DataFrame:
    parts = bagged
    for k, name in enumerate(("shout", "symbols", "length")):
        parts = parts.withColumn(f"_{name}", F.col("form")[k])
    made = VectorAssembler(inputCols=[bag, "_shout", "_symbols", "_length", *earlier], outputCol="features").transform(parts)
    return made.drop("_shout", "_symbols", "_length")


def _linear(category: str) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol=category, elasticNetParam=1.0, regParam=PENALTY, maxIter=STEPS,
        probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
    )


def _scored(model: LogisticRegressionModel, rows: DataFrame, category: str) -> DataFrame:
    made = model.transform(rows).withColumn(f"p_{category}", vector_to_array("_probability")[1])
    return made.drop("_probability", "_raw", "_prediction", "features")


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], bound: int) -> DataFrame:
    """Texts of at most about ``bound`` labelled documents with a label of some category (repeated labels: the largest).

    A null label is missing for its own category only.

    The sample's ids are bounded by the parameter, so they are broadcast; documents are not shuffled.
    """
    one = settle(labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(c).cast("double").alias(c) for c in categories])
                 .dropna("all", subset=categories))
    share = bound / max(one.count(), 1)
    drawn = one if share >= 1 else one.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003))
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(drawn), "doc_id")
    return settle(_facts(texts).drop("text"))


def telling_words(facts: DataFrame, categories: list[str]) -> list[list[str]]:
    """Vocabularies: one for each fold, chosen by the labels of the other folds only, and last that of all folds.

    For each category the words that tell most, by the distance of their counts from chance. Words are counted once.
    """
    sides = [F.col("fold") != fold for fold in range(FOLDS)] + [F.lit(True)]
    names = list(enumerate(categories))
    shares = facts.agg(*[F.avg(F.when(side, F.col(c))) for side in sides for c in categories]).first()
    sums = [
        [F.count(F.when(side, 1)).alias(f"docs_{k}")]
        + [F.sum(F.when(side, F.col(c))).alias(f"sum_{k}_{j}") for j, c in names]
        + [F.count(F.when(side, F.col(c))).alias(f"n_{k}_{j}") for j, c in names]
        for k, side in enumerate(sides)
    ]
    each = facts.select(F.explode(F.array_distinct("words")).alias("word"), "fold", *categories)
    counted = settle(each.groupBy("word").agg(*[c for side in sums for c in side]).filter(F.col(f"docs_{FOLDS}") >= LEAST_DOCS))
    found = []
    for k in range(len(sides)):
        words: set[str] = set()
        for j, _ in names:
            share = shares[k * len(categories) + j]
            if not share or share == 1:
                continue
            chance = F.col(f"n_{k}_{j}") * share
            far = F.abs(F.col(f"sum_{k}_{j}") - chance) / F.sqrt(chance * (1 - share))
            often = counted.filter((F.col(f"docs_{k}") >= LEAST_DOCS) & (F.col(f"n_{k}_{j}") > 0))
            words |= {r[0] for r in often.orderBy(far.desc(), "word").limit(VOCABULARY).select("word").collect()}
        found.append(sorted(words) or ["-"])
    return found


def _bags(vocabulary: list[str], name: str) -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol=name).setBinary(True)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], bound: int = MAX_LABELLED) -> Chain | None:
    """The chain in the order of ``categories`` (0/1 columns of ``labels``); None if none has two classes.

    A category with one class only, or without labels, is left out, and the next model goes without its probability.

    For training, a document's earlier probabilities come from models that did not see it (folds by a hash of the id),
    as they will for new documents; the words of such a model are chosen without their labels too. Where the labels are
    too few for that, the category is named in ``in_fold``. Each threshold is the one with the best F1 on such out-of-fold probabilities.
    """
    facts = labelled_sample(docs, labels, categories, bound)
    both = facts.agg(*[F.min(c) for c in categories], *[F.max(c) for c in categories]).first()
    left_out = [c for k, c in enumerate(categories) if both[k] is None or both[k] == both[k + len(categories)]]
    categories = [c for c in categories if c not in left_out]
    if not categories:
        return None
    facts = facts.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)))
    bags = [_bags(words, f"bag_{k}" if k < FOLDS else "bag") for k, words in enumerate(telling_words(facts, categories))]
    chain = Chain(bags[-1], categories, left_out=left_out)
    rows = facts
    for bag in bags:
        rows = bag.transform(rows)
    # the sample is bounded: in few parts, a step of the fit costs no more than its sums
    rows = settle(rows.drop("words").coalesce(PARTS))
    for k, category in enumerate(categories):
        earlier = [f"p_{c}" for c in categories[:k]]
        labelled = rows.filter(F.col(category).isNotNull())
        seen = {(r[0], r[1]) for r in labelled.select("fold", category).distinct().collect()}
        held = None
        for fold in range(FOLDS):
            # few labels may leave the other folds without one of the classes; then all are used
            enough = len({y for f, y in seen if f != fold}) == 2
            if not enough and category not in chain.in_fold:
                chain.in_fold.append(category)
            bag = f"bag_{fold}" if enough else "bag"
            others = labelled.filter(F.col("fold") != fold) if enough else labelled
            model = _linear(category).fit(_vectors(others, earlier, bag))
            part = _scored(model, _vectors(rows.filter(F.col("fold") == fold), earlier, bag), category)
            held = part if held is None else held.unionByName(part)
        chain.models.append(_linear(category).fit(_vectors(labelled, earlier)))
        rows = settle(held.coalesce(PARTS))
        chain.thresholds.append(_best_threshold(rows.filter(F.col(category).isNotNull()), category))
    return chain


def _best_threshold(rows: DataFrame, category: str) -> float:
    p, y = F.col(f"p_{category}"), F.col(category)
    sums = rows.agg(
        F.sum(y), *[F.sum((p >= t).cast("int")) for t in GRID], *[F.sum((p >= t).cast("int") * y) for t in GRID]
    ).first()
    f1 = [2 * (sums[1 + len(GRID) + k] or 0) / max((sums[0] or 0) + (sums[1 + k] or 0), 1) for k in range(len(GRID))]
    top = [t for t, f in zip(GRID, f1, strict=True) if f == max(f1)]
    return top[len(top) // 2]


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """``docs`` with ``p_<category>`` and ``is_<category>`` of every row.

    Rows keep their columns (a column of one of these names is replaced) and their number. A null text has no words and
    gets the probability of none. Without a chain (labels of one class only, so nothing to tell apart), and for a
    category that the chain leaves out, the two columns are null and false.
    """
    own = docs.columns
    if chain is None:
        names = [c for c in own if c not in ("p_low_quality", "is_low_quality", "p_toxic", "is_toxic")]
        return docs.select(*names, *[e for c in ("low_quality", "toxic") for e in (
            F.lit(None).cast("double").alias(f"p_{c}"), F.lit(False).alias(f"is_{c}"))])
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"))
    made = chain.words.transform(_facts(rows)).drop("words", "text")
    for k, category in enumerate(chain.categories):
        made = _scored(chain.models[k], _vectors(made, [f"p_{c}" for c in chain.categories[:k]]), category)
    new = {}
    for category in chain.left_out:
        new[f"p_{category}"] = F.lit(None).cast("double")
        new[f"is_{category}"] = F.lit(False)
    for category, threshold in zip(chain.categories, chain.thresholds, strict=True):
        new[f"p_{category}"] = F.col(f"p_{category}")
        new[f"is_{category}"] = F.col(f"p_{category}") >= threshold
    return made.select(*[F.col("_row")[c].alias(c) for c in own if c not in new], *[v.alias(n) for n, v in new.items()])


def with_categories(labels: DataFrame) -> DataFrame:
    """The two categories of the label table: low quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))
