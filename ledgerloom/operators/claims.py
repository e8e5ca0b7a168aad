"""Claim checking against facts, and what follows from verdicts: taxonomy, coverage, scores, rankings.

Facts are long: (case_id, field_path, available, reason, number, text, currency). A claim is (case_id, claim_id,
field_path, claim_type, number, text, currency). Checking is one join and one CASE over the claim's kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUPPORTED, CONTRADICTED, UNVERIFIABLE = "SUPPORTED", "CONTRADICTED", "UNVERIFIABLE"
#: Tolerances and the class that a contradiction of each kind is.
RATIO_TOLERANCE = 0.01
MONEY_SHARE, MONEY_LEAST = 0.01, 0.01
TIME_SECONDS = 60
LIST = "; "
"""Between the members of a fact's set (an inventory, a vocabulary, the provisions that may be cited)."""
UNIT_HOURS = {"minutes": 1 / 60, "hours": 1.0, "days": 24.0}
CLASS = {"set": "H5", "count": "H2", "ratio": "H2", "money": "H2", "duration": "H3", "timestamp": "H3", "boolean": "H5", "categorical": "H5", "sequence": "H3", "entity": "H1", "regulatory": "H6"}


def agrees(kind: Column, claim_number: Column, claim_text: Column, claim_unit: Column, fact_number: Column, fact_text: Column, fact_unit: Column) -> Column:
    """Whether a claim's value agrees with the fact's, by kind."""
    gap = F.abs(claim_number - fact_number)
    hours = F.when(claim_unit == "minutes", UNIT_HOURS["minutes"]).when(claim_unit == "days", UNIT_HOURS["days"]).otherwise(UNIT_HOURS["hours"])
    return (
        F.when(kind == "count", claim_number == fact_number)
        .when(kind == "ratio", gap <= RATIO_TOLERANCE)
        .when(kind == "money", claim_unit.eqNullSafe(fact_unit) & (gap <= F.greatest(F.abs(fact_number) * MONEY_SHARE, F.lit(MONEY_LEAST))))
        .when(kind == "duration", F.abs(claim_number * hours - fact_number) <= hours)
        .when(kind == "timestamp", gap <= TIME_SECONDS)
        .when(kind.isin("entity", "set", "regulatory"), F.array_contains(F.split(fact_text, LIST), claim_text))
        .when(kind == "unavailable", F.lit(None).cast("boolean"))
        .otherwise(claim_text == fact_text)
    )


def reason_of(claim, fact) -> Column:
    """Why a claim can't be verified; null where it can. Both are structs, or columns by name."""
    return F.when(fact["available"].isNull(), "no_such_fact").when(~fact["available"], F.coalesce(fact["reason"], F.lit("unavailable"))).when(claim["claim_type"] == "unavailable", "never_available")


def verdict_of(claim, fact) -> Column:
    ok = agrees(claim["claim_type"], claim["number"], claim["text"], claim["unit"], fact["number"], fact["text"], fact["unit"])
    return F.when(reason_of(claim, fact).isNotNull(), UNVERIFIABLE).when(F.coalesce(ok, F.lit(False)), SUPPORTED).otherwise(CONTRADICTED)


def count_verdicts(df: DataFrame, claims: str, facts: str) -> DataFrame:
    """With n_claims, n_supported, n_contradicted and n_unverifiable of rows that hold a case's claims and facts as arrays (a field has one fact):
    what check and score_cases tell, without moving a row."""
    # A field without a fact has the null element behind the facts' end.
    fact = lambda c: F.get(facts, F.coalesce(F.array_position(F.transform(facts, lambda f: f["field_path"]), c["field_path"]), F.lit(0)).cast("int") - 1)
    both = F.transform(claims, lambda c: F.struct(c.alias("claim"), fact(c).alias("fact")))
    verdicts = F.transform(both, lambda x: verdict_of(x["claim"], x["fact"]))
    d = df.withColumn("_v", verdicts).withColumn("n_claims", F.size("_v").cast("long"))
    number = lambda v: F.size(F.filter("_v", lambda x: x == v)).cast("long")
    return d.withColumns({f"n_{v.lower()}": number(v) for v in (SUPPORTED, CONTRADICTED, UNVERIFIABLE)}).drop("_v")


def check(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claims with verdict, class and reason. A claim on no fact, or on one that isn't available, is never supported."""
    f = facts.select("case_id", "field_path", F.col("available").alias("_a"), F.col("reason").alias("_r"), F.col("number").alias("_n"), F.col("text").alias("_t"), F.col("unit").alias("_u"))
    j = claims.join(f, ["case_id", "field_path"], "left")
    fact = {"available": F.col("_a"), "reason": F.col("_r"), "number": F.col("_n"), "text": F.col("_t"), "unit": F.col("_u")}
    claim = {c: F.col(c) for c in ("claim_type", "number", "text", "unit")}
    why, verdict = reason_of(claim, fact), verdict_of(claim, fact)
    known = F.create_map(*[F.lit(x) for kv in CLASS.items() for x in kv])
    return j.withColumn("verdict", verdict).withColumn("reason", why).withColumn("hallucination_class", F.when(F.col("verdict") == CONTRADICTED, known[F.col("claim_type")])).drop("_a", "_r", "_n", "_t", "_u")


def score_cases(results: DataFrame, required: DataFrame) -> DataFrame:
    """case_id, n_claims, n_supported, n_contradicted, n_unverifiable, precision (1 without claims), coverage (1 if nothing is required): share of required fields with a claim that isn't contradicted."""
    tall = results.groupBy("case_id").agg(F.count("*").alias("n_claims"), *[F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in (SUPPORTED, CONTRADICTED, UNVERIFIABLE)])
    seen = results.where(F.col("verdict") != CONTRADICTED).select("case_id", "field_path").distinct().withColumn("_s", F.lit(1))
    cover = required.join(seen, ["case_id", "field_path"], "left").groupBy("case_id").agg(F.count("*").alias("_k"), F.count("_s").alias("_c"))
    j = tall.join(cover, "case_id", "full").fillna(0)
    return j.select("case_id", "n_claims", "n_supported", "n_contradicted", "n_unverifiable", F.when(F.col("n_claims") > 0, F.col("n_supported") / F.col("n_claims")).otherwise(1.0).alias("precision"), F.when(F.col("_k") > 0, F.col("_c") / F.col("_k")).otherwise(1.0).alias("coverage"))


def with_f1(scores: DataFrame) -> DataFrame:
    p, c = F.col("precision"), F.col("coverage")
    return scores.withColumn("f1", F.when(p + c > 0, 2 * p * c / (p + c)).otherwise(0.0))


def aggregate(scores: DataFrame, group: str) -> DataFrame:
    """group, macro means, pooled rates, cases without claims and without contradictions."""
    s = lambda c: F.sum(c)
    return scores.groupBy(group).agg(F.count("*").alias("n_cases"), F.avg("precision").alias("macro_precision"), F.avg("coverage").alias("macro_coverage"), (s("n_supported") / s("n_claims")).alias("micro_precision"), (s("n_contradicted") / s("n_claims")).alias("contradiction_rate"), F.count_if(F.col("n_claims") == 0).alias("n_without_claims"), F.avg((F.col("n_contradicted") == 0).cast("double")).alias("zero_hallucination_rate"))


def taxonomy(results: DataFrame, group: str) -> DataFrame:
    """group, hallucination_class, n, n_cases, per_case: contradictions by class."""
    cases = results.groupBy(group).agg(F.countDistinct("case_id").alias("_n"))
    g = results.where("hallucination_class IS NOT NULL").groupBy(group, "hallucination_class").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases"))
    return g.join(cases, group).select(group, "hallucination_class", "n", "n_cases", (F.col("n") / F.col("_n")).alias("per_case"))


def cross_tab(results: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts as a table, one column for each of the given values."""
    g = results.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1)))
    return g.select(rows, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def candidate_scores(scores: DataFrame) -> DataFrame:
    """case_id, candidate, score of candidates (a case's narratives): half freedom from contradiction, a third and some of coverage, the rest freedom from the unverifiable; the best of equals is the first."""
    n = F.greatest(F.col("n_claims"), F.lit(1))
    s = 0.5 * (1 - F.col("n_contradicted") / n) + 0.35 * F.col("coverage") + 0.15 * (1 - F.col("n_unverifiable") / n)
    return scores.withColumn("score", s)


def best_candidate(scored: DataFrame) -> DataFrame:
    return scored.groupBy("case_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "candidate")).alias("b")).select("case_id", F.col("b.candidate").alias("candidate"), (-F.col("b.s")).alias("score"))


def worst(scores: DataFrame, group: str, n: int) -> DataFrame:
    """The n worst cases of each group: most contradictions, then least f1, then id (a report's top list)."""
    w = W.partitionBy(group).orderBy(F.desc("n_contradicted"), "f1", "case_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def omissions(conditions: DataFrame, mentions: DataFrame) -> DataFrame:
    """case_id, rule: exculpatory conditions that hold and that no mention covers."""
    return conditions.where("holds").select("case_id", "rule").join(mentions.select("case_id", "rule").distinct(), ["case_id", "rule"], "left_anti")


def align_spans(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """case_id, a_id, b_id, iou: spans of two annotators matched one to one, best overlap first (ties by place). Spans: (case_id, id, start, end)."""
    x = a.select("case_id", F.col("id").alias("a_id"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    y = b.select("case_id", F.col("id").alias("b_id"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    common = F.least("e1", "e2") - F.greatest("s1", "s2")
    near = x.join(y, "case_id").where((F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1"))).withColumn("iou", common / (F.greatest("e1", "e2") - F.least("s1", "s2"))).where(F.col("iou") >= least)

    def match(pdf):
        left = pdf.sort_values(["iou", "s1", "s2"], ascending=[False, True, True], kind="stable")
        best = []
        while len(left):
            first = left.iloc[0]
            best.append((first["case_id"], first["a_id"], first["b_id"], first["iou"]))
            left = left[(left["a_id"] != first["a_id"]) & (left["b_id"] != first["b_id"])]
        import pandas as pd

        return pd.DataFrame(best, columns=["case_id", "a_id", "b_id", "iou"])

    return near.groupBy("case_id").applyInPandas(match, f"case_id {a.schema['case_id'].dataType.simpleString()}, a_id long, b_id long, iou double")
