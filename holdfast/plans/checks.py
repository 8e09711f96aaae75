"""The four checks: measures and verdict from the operators, words from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import fixed
from holdfast.functions.columns import counted, joined_names, percent, points
from holdfast.operators import baseline as ob
from holdfast.operators import integrity as oi
from holdfast.operators import leakage as ol
from holdfast.operators import variance as ov
from holdfast.operators.nearest import BlockPlan
from holdfast.plans.result import CheckResult, by_case, present
from holdfast.table import AuditTable


def _say(text: str, *values: Column) -> Column:
    return F.format_string(text, *values) if values else F.lit(text)


# ------------------------------------------------------------------ leakage

def leakage_check(table: AuditTable, threshold: float = fixed.DEFAULT_SIMILARITY,
                  plan: BlockPlan | None = None, holdout: str | None = None) -> CheckResult:
    found = ol.leakage_verdict(table, holdout, threshold=threshold, plan=plan)
    c = F.col
    reason, flagged = c("reason"), c("flagged")
    small_drop = (flagged > 0) & (c("drop_pts") < fixed.REPORTABLE_DROP_POINTS)
    headline = by_case(
        (reason == "no_features", "There are no feature columns, so rows cannot be compared."),
        (reason == "no_sides", "Train rows and hold-out rows are both needed for a comparison."),
        (reason == "not_encodable", "No feature column could be encoded."),
        ((reason == "too_narrow") & (c("status") == fixed.FAIL),
         _say("%s held-out rows are exact copies of rows in another split.", counted(c("exact_any_split")))),
        (reason == "too_narrow",
         _say("No exact copies; near copies were not looked for, because %d encoded dimensions are too few.", c("width"))),
        ((flagged == 0) & (c("exact_any_split") > 0),
         _say("%s held-out rows are exact copies of rows in another split.", counted(c("exact_any_split")))),
        (flagged == 0,
         _say("No held-out row reaches a similarity of %.3f with a training row; the closest pair has %.3f.",
              c("threshold"), c("max_similarity"))),
        otherwise=F.concat(
            _say("%s of %s held-out rows (%s) have a near-identical twin in train.",
                 counted(flagged), counted(c("holdout_rows")), percent(c("flagged_share"))),
            F.when(c("drop_pts") >= fixed.REPORTABLE_DROP_POINTS,
                   _say(" Without them accuracy goes from %s to %s.", percent(c("accuracy_all")), percent(c("accuracy_clean"))))
            .otherwise(F.lit(""))),
    )
    why = by_case(
        (c("status") == fixed.PASS, "The held-out score measures generalisation, not recall."),
        ((reason == "too_narrow") & (c("status") == fixed.SKIP),
         "In so few dimensions rows are close to each other by chance; a rate would mean nothing."),
        (c("status") == fixed.SKIP, "Without this comparison, memorised rows cannot be told from learned ones."),
        otherwise="Rows seen in training are recalled rather than predicted, which inflates the score.")
    what = by_case(
        (reason == "no_features", "Add the features or the embedding, one column per dimension."),
        (reason == "no_sides", "Check that the split column names train and test."),
        (reason == "not_encodable", "Check that feature columns hold numbers, categories or text."),
        ((reason == "too_narrow") & (c("status") == fixed.SKIP), "Rely on the id and group results of the integrity check."),
        (c("status") == fixed.PASS, "Nothing to do."),
        otherwise="Find the entity the pairs share, name it as the group, and split by group.")
    result = present(
        found.measures, "leakage", "Train/test leakage", headline=headline, why=why, what=what,
        metrics=[
            ("Held-out rows checked", counted(c("holdout_rows"))),
            ("Near-duplicates found", counted(flagged)),
            ("Share of held-out set", percent(c("flagged_share"))),
            ("Exact duplicates across splits", counted(c("exact_any_split"))),
            ("Exact duplicates in train", counted(c("exact_in_train"))),
            ("Similarity threshold used", _say("%.3f", c("threshold"))),
            ("Typical unrelated pair", F.when(c("background").isNotNull(), _say("%.3f", c("background")))),
            ("Highest similarity", F.when(c("max_similarity").isNotNull(), _say("%.3f", c("max_similarity")))),
            ("Encoded feature dimensions", c("width")),
            ("Encoded columns", c("encoding")),
            ("Accuracy on full held-out set", F.when(flagged > 0, percent(c("accuracy_all")))),
            ("Accuracy excluding leaked rows", F.when(flagged > 0, percent(c("accuracy_clean")))),
            ("Difference", F.when(flagged > 0, points(c("drop_pts")))),
        ],
        notes=[
            F.when(c("background") > c("requested"),
                   _say("Unrelated rows already reach %.3f, so the threshold rose from %.2f to %.3f.",
                        c("background"), c("requested"), c("threshold"))),
            F.when(small_drop,
                   _say("Leaving the flagged rows out moves accuracy by only %+.1f points: the overlap is likely at "
                        "the level of groups, so re-split by group instead of deleting rows.", c("drop_pts"))),
            F.when(reason == "too_narrow",
                   _say("Only exact copies were checked: similarity over %d dimensions is not reliable.", c("width"))),
        ])
    return CheckResult(result, found.measures, {} if found.pairs is None else {"most_similar_pairs": found.pairs})


# ------------------------------------------------------------------ baseline

def baseline_check(table: AuditTable, holdout: str | None = None) -> CheckResult:
    holdout = holdout or table.holdout
    judged = ob.baseline_verdict(table, holdout)
    c = F.col
    with_pred = table.prediction is not None
    skewed = c("majority_accuracy") >= fixed.IMBALANCE_SHARE
    weak = c("gain_pts") < fixed.GAIN_FAIL_POINTS
    no_pred = F.lit(not with_pred)
    headline = by_case(
        (c("status") == fixed.SKIP, "There are no held-out rows to evaluate."),
        (no_pred, _say("Always guessing '%s' would score %s here.", c("majority_class"), percent(c("majority_accuracy")))),
        (c("collapsed"), _say("The model answers '%s' for %s of the held-out set and scores %s; the bar is %s.",
                              c("top_predicted_class"), percent(c("top_predicted_share")),
                              percent(c("accuracy")), percent(c("majority_accuracy")))),
        (weak, _say("The model scores %s, %+.1f points against the %s of always guessing '%s'.",
                    percent(c("accuracy")), c("gain_pts"), percent(c("majority_accuracy")), c("majority_class"))),
        otherwise=_say("The model scores %s, %+.1f points above the %s of the majority class.",
                       percent(c("accuracy")), c("gain_pts"), percent(c("majority_accuracy"))))
    why = by_case(
        (c("status") == fixed.SKIP, "A score needs held-out rows."),
        (no_pred & skewed, "This is the bar to clear, and with classes this uneven accuracy hides the rare ones."),
        (no_pred, "This is the bar any accuracy has to clear; the classes are even enough for accuracy to be fair."),
        (c("collapsed"), _say("A model that nearly always gives one answer tracks the class shares, not the input; "
                              "its macro-F1 is %.3f.", c("macro_f1_truth_classes"))),
        (weak, _say("The gain is all the model adds over a constant, and the interval alone spans %.1f points.",
                    (c("ci_high") - c("ci_low")) * 100)),
        (skewed, "The model beats a constant guess, but with classes this uneven quote macro-F1 as well."),
        otherwise="The model beats a constant guess, and accuracy is a fair summary here.")
    what = by_case(
        (c("status") == fixed.SKIP, "Mark some rows as test or val."),
        (no_pred, "Add a prediction column to compare the model with this bar."),
        (c("collapsed"), "Look for a training fault: class weights, learning rate, or labels the features cannot tell."),
        (weak, "Report the gain over the baseline, with macro-F1 or per-class recall."),
        otherwise=_say("Quote the baseline and the interval (%s to %s) with the accuracy.",
                       percent(c("ci_low")), percent(c("ci_high"))))
    result = present(
        judged, "baseline", "Accuracy versus naive baseline", headline=headline, why=why, what=what,
        metrics=[
            ("Held-out rows", counted(c("holdout_rows"))), ("Classes", counted(c("n_classes"))),
            ("Majority class", c("majority_class")),
            ("Always-guess-majority accuracy", percent(c("majority_accuracy"))),
            ("Model accuracy", percent(c("accuracy"))),
            ("95% confidence interval", F.when(c("accuracy").isNotNull(),
                                              _say("%s to %s", percent(c("ci_low")), percent(c("ci_high"))))),
            ("Gain over baseline", F.when(c("gain_pts").isNotNull(), points(c("gain_pts")))),
            ("Macro-F1", F.when(c("macro_f1_truth_classes").isNotNull(), _say("%.3f", c("macro_f1_truth_classes")))),
            ("Most-predicted class share", F.when(c("collapsed"), percent(c("top_predicted_share")))),
        ])
    return CheckResult(result, judged, {"per_class": ob.per_class_report(table, holdout)} if holdout else {})


# ------------------------------------------------------------------ variance

def variance_check(scores: DataFrame) -> CheckResult:
    """``scores``: run_group ('seed' or 'split') and score as a fraction, one row per run."""
    judged = ov.variance_verdict(scores)
    c = F.col
    noisy = c("noise_ratio") >= fixed.NOISE_RATIO_FAIL
    what_varied = F.when(c("varied") == ov.SPLIT, "held-out sets").otherwise("training seeds")
    span = [percent(c("main_min")), percent(c("main_max"))]
    headline = by_case(
        (c("status") == fixed.SKIP, "No repeated-run scores were given."),
        (noisy, _say("Another seed moves the score by %.2f points, another held-out set by %.2f - %.0f times more.",
                     c("seed_sd") * 100, c("split_sd") * 100, c("noise_ratio"))),
        (c("main_n") < fixed.MIN_RUNS, _say("%d run(s) are too few to estimate the variance.", c("main_n"))),
        otherwise=_say("Scores of %d runs over %s span %.1f points (%s to %s).",
                       c("main_n"), what_varied, c("spread_pts"), *span))
    why = by_case(
        (c("status") == fixed.SKIP, "A single run cannot tell how noisy it is."),
        (noisy, _say("A small seed spread says only that training lands in the same place on the same data; over "
                     "held-out sets the score ranges from %s to %s.", percent(c("split_min")), percent(c("split_max")))),
        (c("main_n") < fixed.MIN_RUNS, "Two runs can differ by chance either way."),
        (c("spread_pts") >= fixed.SPREAD_FAIL_POINTS, "A gain smaller than this spread can come from re-running alone."),
        (c("spread_pts") >= fixed.SPREAD_WARN_POINTS, "A gain of a point or two cannot be told from noise."),
        otherwise="The result repeats at this level.")
    what = by_case(
        (c("status") == fixed.SKIP, "Run at least three seeds and three splits and give both sets of scores."),
        (c("main_n") < fixed.MIN_RUNS, "Run at least three seeds and three splits."),
        otherwise=F.concat(
            _say("Quote %s plus or minus %.1f points.", percent(c("main_mean")), c("main_sd") * 100),
            F.when(c("split_n").isNull(), F.lit(" Vary the split as well; it is usually the larger source."))
            .otherwise(F.lit(""))))

    def side(name: str, label: str) -> list[tuple[str, Column]]:
        has = c(f"{name}_n").isNotNull()
        return [
            (f"{label} runs", c(f"{name}_n")),
            (f"{label} spread", F.when(has, points(c(f"{name}_range") * 100, 2, signed=False))),
            (f"{label} std dev", F.when(has, points(c(f"{name}_sd") * 100, 2, signed=False))),
        ]

    result = present(
        judged, "variance", "Run-to-run variance", headline=headline, why=why, what=what,
        metrics=[
            *side("seed", "Seed"), *side("split", "Split"),
            ("Mean across splits", percent(c("split_mean"))),
            ("Split noise / seed noise", F.when(c("noise_ratio").isNotNull(), _say("%.0fx", c("noise_ratio")))),
        ])
    return CheckResult(result, judged, {"runs": ov.run_stats(scores)})


# ------------------------------------------------------------------ integrity

def _issue_text(table: AuditTable) -> Column:
    """Words for an issue, by its code, over the measures row."""
    c, i = F.col, F.col("issue.code")
    size = _say("The held-out set has %d rows, an error bar of about +/-%.0f points.",
                c("holdout_rows"), c("margin") * 100)
    return by_case(
        (i == "cross_split_ids", _say("%s ids lie in more than one split.", counted(c("cross_split_ids")))),
        (i == "duplicate_ids", _say("%s rows repeat an id within their split.", counted(c("duplicate_ids")))),
        (i == "group_overlap", _say("%s of %s held-out '%s' values (%s) are in train as well.",
                                    counted(c("overlapping_groups")), counted(c("holdout_groups")),
                                    F.lit(table.group or ""), percent(c("overlap_share"), 0))),
        (i == "unseen_classes", _say("%d class(es) are held out but never trained on: %s.", c("unseen_classes"),
                                     joined_names(c("unseen_names"), c("unseen_classes")))),
        (i == "untested_classes", _say("%d class(es) are trained on but never tested: %s.", c("untested_classes"),
                                       joined_names(c("untested_names"), c("untested_classes")))),
        (i == "label_drift", _say("Train and held-out class shares differ by %s.", percent(c("label_drift")))),
        (i == "small_holdout", size),
        (i == "unlabelled_rows", _say("%s rows have no split and belong to neither side.", counted(c("unlabelled_rows")))),
    )


def integrity_check(table: AuditTable, holdout: str | None = None) -> CheckResult:
    holdout = holdout or table.holdout
    judged = oi.integrity_verdict(table, holdout)
    c = F.col
    first, more = c("issues")[0], F.size("issues") - 1
    spelled = judged.withColumn("issue", F.when(F.size("issues") > 0, first)) \
        .withColumn("first_issue", _issue_text(table))
    grouped = F.lit(table.group is not None)
    headline = F.when(F.size("issues") == 0, _say("The split is well formed: ids, groups, classes and size are in order.")) \
        .otherwise(F.concat(c("first_issue"), F.when(more > 0, _say(" (%d more issue(s).)", more)).otherwise(F.lit(""))))
    why = by_case(
        (c("status") == fixed.PASS, "None of the faults that make a score unreadable is present."),
        (grouped, "Each row and each entity must be on one side, with every class on both, before a score means "
                  "anything; random row splits quietly put one entity on both sides."),
        otherwise="Each row must be on one side, with every class on both; without a group column, entities on "
                  "both sides cannot be seen.")
    what = by_case(
        (c("status") == fixed.PASS, "Nothing to do."),
        (grouped, "Fix this first: re-split by group, stratify by label, and train again."),
        otherwise="Fix this first, and stratify the split by label.")
    group_name = table.group or ""
    result = present(
        spelled, "integrity", "Split integrity", headline=headline, why=why, what=what,
        metrics=[
            ("Rows", counted(c("n_rows"))),
            ("Rows in train", counted(c("train_rows"))),
            (f"Rows in {holdout}", counted(c("holdout_rows"))),
            ("Duplicate ids", counted(c("duplicate_ids"))),
            ("Ids in more than one split", counted(c("cross_split_ids"))),
            (f"Distinct {group_name} values", counted(c("distinct_groups"))),
            ("Groups in both train and held-out", counted(c("overlapping_groups"))),
            ("Label distribution shift", percent(c("label_drift"))),
            ("Widest 95% error bar at this size",
             F.when(c("margin").isNotNull(), _say("+/-%.1f pts", c("margin") * 100))),
            ("Rows with no split", F.when(c("unlabelled_rows") > 0, counted(c("unlabelled_rows")))),
        ])
    issues = judged.withColumn("issue", F.explode("issues")) \
        .select(c("issue.seq").alias("seq"), c("issue.code").alias("code"), c("issue.status").alias("status"),
                _issue_text(table).alias("issue"))
    tables = {"issues": issues, "rows_per_split": _split_rows(table)}
    if table.id:
        tables["cross_split_ids"] = oi.cross_split_rows(table)
    if holdout:
        tables["class_balance"] = oi.class_balance(table, holdout)
        if table.group:
            tables["group_overlap"] = oi.group_overlap(table, holdout)
    return CheckResult(result, judged, tables)


def _split_rows(table: AuditTable) -> DataFrame:
    from holdfast.operators.summary import split_counts

    return split_counts(table)
