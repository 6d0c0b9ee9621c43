"""Per-customer contributions to a score, and what to do about them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.config import KEY
from lapsewise.functions.text import display_name

# Advice per feature, (when it raises the risk, when it lowers it).
ACTIONS = {
    "Num Of Products": (
        "Review product bundling - customer may be over-committed",
        "Cross-sell additional products to increase stickiness",
    ),
    "Age": (
        "Target with age-appropriate retention offers",
        "Engage with youth-focused digital banking features",
    ),
    "Is Active Member": (
        "Customer engagement is low - activate re-engagement program",
        "Maintain current engagement level with loyalty rewards",
    ),
    "Balance": (
        "High balance risk - offer premium account benefits",
        "Incentivize deposits with competitive rates",
    ),
    "Estimated Salary": (
        "High earner at risk - provide personalized wealth services",
        "Offer value-tier products suited to income level",
    ),
    "Geography Germany": (
        "German market risk - review regional competitive offerings",
        "Leverage regional satisfaction drivers",
    ),
    "Geography Spain": (
        "Spanish market risk - address regional pain points",
        "Continue regional strategy success",
    ),
    "Geography France": (
        "French market risk - review local market conditions",
        "Maintain regional engagement approach",
    ),
    "Tenure": (
        "Long-term customer showing risk - priority VIP retention",
        "New customer - focus on onboarding experience",
    ),
    "Has Credit Card": (
        "Credit product driving risk - review terms and benefits",
        "Offer credit card with attractive rewards",
    ),
    "Has Cr Card": (
        "Credit product driving risk - review terms and benefits",
        "Offer credit card with attractive rewards",
    ),
    "Balance Per Product": (
        "Product-balance ratio unfavorable - optimize product mix",
        "Healthy product utilization - maintain current strategy",
    ),
    "Gender Female": (
        "Review offerings for female demographic preferences",
        "Continue current demographic targeting",
    ),
    "Gender Male": (
        "Review offerings for male demographic preferences",
        "Continue current demographic targeting",
    ),
    "Is Zero Balance": (
        "Zero balance indicates disengagement - initiate win-back",
        "Active account - maintain engagement",
    ),
    "Credit Score": (
        "Credit profile concern - offer credit improvement resources",
        "Strong credit customer - offer premium products",
    ),
    "Tenure Age Ratio": (
        "Loyalty ratio concerning - strengthen relationship",
        "Strong loyalty foundation - nurture with recognition",
    ),
    "High Value Customer": (
        "High-value at risk - assign dedicated relationship manager",
        "Develop customer value with growth incentives",
    ),
    "Age Group Young": (
        "Young customer at risk - enhance digital experience",
        "Engaged young customer - offer referral programs",
    ),
    "Age Group Middle": (
        "Mid-age customer risk - offer life-stage products",
        "Stable segment - maintain service quality",
    ),
    "Age Group Senior": (
        "Senior customer risk - simplify services and add support",
        "Loyal senior - recognize with tenure benefits",
    ),
}
# Advice when no feature of a customer has any.
NO_ACTION = "No action needed - customer is in good standing."
FALLBACKS = {
    "high": "Immediate intervention required. Offer retention incentives.",
    "medium": "Monitor closely. Send satisfaction survey.",
}


def by_size(contributions: Column, n: int) -> Column:
    """The ``n`` contributions largest in absolute value, by name on a tie. All
    contributions of a customer sit in one array, so nothing is shuffled."""
    keyed = F.transform(
        contributions,
        lambda c: F.struct((-F.abs(c["contribution"])).alias("k"), c["feature"].alias("f"), c["contribution"].alias("v")),
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, n),
        lambda s: F.struct(
            s["f"].alias("feature"),
            s["v"].alias("contribution"),
            F.when(s["v"] > 0, "increase").otherwise("decrease").alias("impact"),
        ),
    )


def linear_contributions(
    df: DataFrame, coefs: Mapping[str, float], means: DataFrame, n: int = 10, digits: int = 6
) -> DataFrame:
    """Exact contributions of a linear score: ``coef * (x - mean)`` per feature.

    ``means`` is one row with a column per feature. Adds ``base_value``,
    ``prediction_value`` (base plus all contributions) and ``top_features``.
    """
    row = means.first()
    base = sum(w * row[c] for c, w in coefs.items())
    parts = [
        F.struct(
            display_name(F.lit(c)).alias("feature"),
            F.round(F.lit(w) * (F.col(c) - F.lit(row[c])), digits).alias("contribution"),
        )
        for c, w in coefs.items()
    ]
    total = sum((F.lit(w) * (F.col(c) - F.lit(row[c])) for c, w in coefs.items()), F.lit(0.0))
    return df.withColumns(
        {
            "base_value": F.lit(base),
            "prediction_value": F.lit(base) + total,
            "top_features": by_size(F.array(*parts), n),
        }
    )


def contribution_rows(df: DataFrame, key: str = KEY) -> DataFrame:
    """``(key, position, feature, contribution, impact, percentage)``, one row per listed contribution."""
    size = F.aggregate("top_features", F.lit(0.0), lambda a, c: a + F.abs(c["contribution"]))
    rows = df.select(key, size.alias("size"), F.posexplode("top_features").alias("i", "c"))
    share = F.when(F.col("size") != 0, F.col("c.contribution") / F.col("size") * 100).otherwise(
        F.col("c.contribution") * 100
    )
    return rows.select(
        key,
        (F.col("i") + 1).alias("position"),
        "c.feature",
        "c.contribution",
        "c.impact",
        share.alias("percentage"),
    )


def recommend(df: DataFrame, level: str = "risk_level", actions: Mapping[str, tuple[str, str]] = ACTIONS) -> DataFrame:
    """Add ``recommendations``: advice for the three largest contributions.

    The advice table is a literal map inside the expression: a lookup per row, no join.
    """
    table = F.create_map(
        *[
            F.lit(text)
            for feature, pair in actions.items()
            for impact, advice in zip(("increase", "decrease"), pair)
            for text in (f"{feature}|{impact}", advice)
        ]
    )
    found = F.array_compact(
        F.transform(
            by_size(F.col("top_features"), 3),
            lambda c: F.try_element_at(table, F.concat_ws("|", c["feature"], c["impact"])),
        )
    )
    lev = F.col(level)
    spare = F.array(F.when(lev == "high", FALLBACKS["high"]).otherwise(FALLBACKS["medium"]))
    advice = F.when(lev == "low", F.array(F.lit(NO_ACTION))).when(F.size(found) > 0, found).otherwise(spare)
    return df.withColumn("recommendations", advice)


def _tree_arrays(model: PipelineModel) -> list[dict[str, np.ndarray]]:
    """Flat arrays of every tree of a boosted model: child indices, split and value.

    Sized by the model (trees x nodes), not by the data.
    """
    gbt = model.stages[-1]
    out = []
    for tree, weight in zip(gbt.trees, gbt.treeWeights):
        left, right, feature, cut, value = [], [], [], [], []

        def visit(node) -> int:
            i = len(left)
            for a in (left, right, feature, cut, value):
                a.append(0)
            stats = node.impurityStats().stats()
            count, total = stats[0], stats[1]
            value[i] = total / count if count else 0.0
            if node.subtreeDepth() == 0:
                left[i] = right[i] = -1
                value[i] = node.prediction()
            else:
                split = node.split()
                feature[i] = split.featureIndex()
                first, second = visit(node.leftChild()), visit(node.rightChild())
                if split.getClass().getSimpleName() == "CategoricalSplit":
                    # The only categories a vector holds here are one-hot 0 and 1.
                    cut[i] = 0.5
                    if list(split.leftCategories()) == [1.0]:
                        first, second = second, first
                else:
                    cut[i] = split.threshold()
                left[i], right[i] = first, second
            return i

        visit(tree._java_obj.rootNode())
        out.append(
            {
                "left": np.array(left),
                "right": np.array(right),
                "feature": np.array(feature),
                "cut": np.array(cut, dtype=float),
                "value": np.array(value, dtype=float) * weight,
            }
        )
    return out


def tree_contributions(
    df: DataFrame, model: PipelineModel, names: Sequence[str], key: str = KEY, n: int = 10
) -> DataFrame:
    """Path contributions of boosted trees: walking down a tree, each change of the
    node mean is credited to the feature split on.

    ``(key, base_value, prediction_value, top_features)``; base plus all
    contributions is the model's raw margin. Trees travel to the tasks as a
    broadcast; rows are worked on in Arrow batches and are not shuffled. All rows of a
    batch go down a tree together, and what the ways to its leaves credit is added up once.
    """
    trees = df.sparkSession.sparkContext.broadcast(_tree_arrays(model))
    vectors = PipelineModel(stages=model.stages[:-1]).transform(df)
    vectors = vectors.select(key, vector_to_array("features").alias("x"))
    width = len(names)

    def leaf_credits(tree: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """``(children, features, credits, depth)`` of a tree: left and right child of node ``i``
        at ``2 i`` and ``2 i + 1`` (a leaf is its own), the features it splits on, and by feature
        and node what the way from the root to the node credits to the feature."""
        left, right = tree["left"], tree["right"]
        features, column = np.unique(tree["feature"][left >= 0], return_inverse=True)
        credits, depth = np.zeros((len(features), len(left))), np.zeros(len(left), dtype=int)
        # Parents come before their children.
        for node, c in zip(np.flatnonzero(left >= 0), column):
            for child in (left[node], right[node]):
                credits[:, child] = credits[:, node]
                credits[c, child] += tree["value"][child] - tree["value"][node]
                depth[child] = depth[node] + 1
        itself = np.arange(len(left))
        children = np.stack([np.where(left >= 0, left, itself), np.where(left >= 0, right, itself)], axis=1).ravel()
        return children, features, credits, int(depth.max())

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = sum((t["value"][0] for t in trees.value), 0.0)
        ready = [(t["feature"], t["cut"], *leaf_credits(t)) for t in trees.value]
        for batch in batches:
            x = np.concatenate(batch["x"].to_numpy()) if len(batch) else np.zeros(0)
            credit = np.zeros((width, len(batch)))
            rows = np.arange(len(batch)) * width
            for feature, cut, children, features, credits, depth in ready:
                at = np.zeros(len(batch), dtype=int)
                for _ in range(depth):
                    down = x.take(rows + feature.take(at)) <= cut.take(at)
                    at = children.take(2 * at + ~down)
                for f, of_node in zip(features, credits):
                    credit[f] += of_node.take(at)
            yield pd.DataFrame(
                {
                    key: batch[key],
                    "base_value": base,
                    "prediction_value": base + credit.sum(axis=0),
                    "credit": list(credit.T.copy()),
                }
            )

    key_type = df.schema[key].dataType.simpleString()
    credited = vectors.mapInPandas(
        walk, f"`{key}` {key_type}, base_value double, prediction_value double, credit array<double>"
    )
    pairs = F.zip_with(
        F.array(*[display_name(F.lit(name)) for name in names]),
        F.col("credit"),
        lambda name, v: F.struct(name.alias("feature"), v.alias("contribution")),
    )
    return credited.select(key, "base_value", "prediction_value", by_size(pairs, n).alias("top_features"))
