"""Roll-ups of call ledgers, evaluations, parameters and version histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summarize(calls: DataFrame, by: str) -> DataFrame:
    """Calls, tokens, cost, whether any call was priced, and errors for each value of by."""
    key = F.when(F.coalesce(F.col(by), F.lit("")) == "", "(unattributed)").otherwise(F.col(by))
    return calls.groupBy(key.alias("key")).agg(
        F.count("*").alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"),
        F.bool_or(F.col("cost").isNotNull()).alias("priced"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def scopes(calls: DataFrame) -> DataFrame:
    """scope, its models in the order in which they came, and the cost, null where nothing was priced."""
    first = calls.groupBy("scope", "model").agg(F.min("seq").alias("first"), F.sum("cost").alias("cost"))
    return first.groupBy("scope").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "model"))), lambda x: x["model"]), ",").alias("models"), F.round(F.sum("cost"), 4).alias("cost"))


def evaluations(outcomes: DataFrame) -> DataFrame:
    """Per suite: runs, graded (not errored), passes, rate and whether it is flaky."""
    x = outcomes.groupBy("suite").agg(F.count("*").alias("runs"), F.count_if(~F.col("errored")).alias("graded"), F.count_if(F.col("passed") & ~F.col("errored")).alias("passes"))
    return x.select("*", F.round(F.col("passes") / F.nullif("graded", F.lit(0)), 6).alias("rate"), ((F.col("passes") > 0) & (F.col("passes") < F.col("graded"))).alias("flaky"))


def versions(history: DataFrame) -> DataFrame:
    """The rows of history (slug, ord, content) that differ from the one before, with version numbers from 1."""
    w = Window.partitionBy("slug").orderBy("ord")
    new = history.withColumn("last", F.lag("content").over(w)).where("last is null or content <> last")
    return new.select("slug", "ord", F.row_number().over(w).alias("version"), F.substring(F.sha2("content", 256), 1, 12).alias("content_hash"))


def longest(records: DataFrame, keys: list[str]) -> DataFrame:
    """One record of each key: the longest statement, of equal ones the earliest; blank keys go."""
    first = F.min(F.struct((-F.col("length")).alias("less"), "seq"))
    return records.where(" and ".join(f"{k} <> ''" for k in keys)).groupBy(*keys).agg(first.alias("x")).select(*keys, "x.seq", (-F.col("x.less")).alias("length"))


def longest_names(names: DataFrame) -> DataFrame:
    """name and the longest name that it begins, of equally long ones the greatest; names are distinct, not empty.

    Each name gives its beginnings, so that the names meet them by equality."""
    cut = names.select(F.col("name").alias("other"), F.explode(F.sequence(F.lit(1), F.length("name"))).alias("n")).select(F.expr("substring(other, 1, n)").alias("name"), "other")
    return cut.groupBy("name").agg(F.max(F.struct(F.length("other").alias("n"), "other"))["other"].alias("longest")).join(names, "name", "left_semi")


def unique_ids(rows: DataFrame) -> DataFrame:
    """seq and id, a repeated id with -2, -3 and so on."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    return rows.select("seq", F.when(n > 1, F.concat_ws("-", "id", n.cast("string"))).otherwise(F.col("id")).alias("id"))


def parameters_by_label(parameters: DataFrame, decisions: DataFrame) -> DataFrame:
    """label, total and decided."""
    d = decisions.where("value <> ''").select("key", F.lit(True).alias("d"))
    return parameters.join(d, "key", "left").groupBy("label").agg(F.count("*").alias("total"), F.count_if("d").alias("decided"))


def parameter_report(parameters: DataFrame, decisions: DataFrame) -> DataFrame:
    """state and n: decided, undecided, unreasoned (a value without a rationale) and stale (a decision of no parameter)."""
    x = parameters.select("key", F.lit(True).alias("p")).join(decisions, "key", "full_outer")
    state = F.when(F.col("p").isNull(), "stale").when(F.coalesce("value", F.lit("")) == "", "undecided").when(F.coalesce("rationale", F.lit("")) == "", "unreasoned").otherwise("decided")
    return x.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def verdicts(judged: DataFrame) -> DataFrame:
    """claim, supported if any verdict supports it, else the worst one; conflicts where some contradict a supported claim."""
    support, against = F.count_if(F.col("verdict") == "supports"), F.count_if(F.col("verdict") == "contradicts")
    return judged.groupBy("claim").agg(
        F.when(support > 0, "supported").when(against > 0, "contradicted").otherwise("unsupported").alias("verdict"), (F.least(support, F.lit(1)) * against).alias("conflicts")
    )
