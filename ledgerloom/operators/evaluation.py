"""Agreement, resampling, validation and reports beside the tests of `statistics`."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import statistics as st
from . import text

# --- p values of one-row statistics ------------------------------------------------------------------

def with_p(df: DataFrame, statistic: str, kind: str, freedom: str | None = None) -> DataFrame:
    """Adds `p`: the upper tail of a chi-square (`chi2`), or both tails of a normal (`normal`) or Student's t (`student`)."""
    @F.pandas_udf("double")
    def tail(x: pd.Series, n: pd.Series) -> pd.Series:
        f = {"chi2": lambda v, k: st.chi2_tail(v, int(k)), "normal": lambda v, _: 2 * st.normal_tail(abs(v)), "student": lambda v, k: 2 * st.student_tail(abs(v), k)}[kind]
        return pd.Series([None if pd.isna(v) else f(float(v), k) for v, k in zip(x, n, strict=True)], dtype="float64")

    return df.withColumn("p", tail(F.col(statistic).cast("double"), F.expr(freedom).cast("double") if freedom else F.lit(0.0)))


def inverse_erf(y: float) -> float:
    """By Newton steps on erf, whose slope is known."""
    if not -1 < y < 1:
        return math.copysign(math.inf, y) if abs(y) == 1 else math.nan
    x = math.copysign(math.sqrt(-math.log((1 - abs(y)) * (1 + abs(y)) or 5e-324)), y) * 0.8
    for _ in range(60):
        step = (math.erf(x) - y) / (2 / math.sqrt(math.pi) * math.exp(-x * x))
        x -= max(-0.5, min(0.5, step))
        if abs(step) < 1e-15 * max(1.0, abs(x)):
            break
    return x


# --- resampling --------------------------------------------------------------------------------------

RESAMPLES = 10_000
BLOCK = 500
EVALUATION_ROWS = 1_000_000
"""A test population that resamples draw from whole; a larger one raises."""


def bootstrap(df: DataFrame, group: str, key: str, value: str, resamples: int = RESAMPLES) -> DataFrame:
    """group, mean, low, high: percentile interval (linear quantiles) of the mean over Poisson resamples.

    A row's weight in a resample follows from the hash of its key and the resample's number, so runs repeat exactly. Tasks
    add up their rows' parts of all resamples; what is shuffled is one row for each task, group and resample. A resample
    in which a small group has no row is left out of its interval.
    """
    import numpy as np

    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    odd = np.uint64(0x9E3779B97F4A7C15)

    def add(batches):
        rounds = np.arange(1, resamples + 1, dtype=np.uint64) * odd
        sums: dict = {}
        for b in batches:
            for g, part in b.groupby("g"):
                own = sums.setdefault(g, np.zeros((2, resamples)))
                h, v = part["h"].to_numpy().astype(np.int64).view(np.uint64), part["v"].to_numpy()
                for r in range(0, resamples, BLOCK):
                    with np.errstate(over="ignore"):
                        x = h[:, None] ^ rounds[None, r : r + BLOCK]
                        for _ in range(2):
                            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                        x ^= x >> np.uint64(32)
                    w = np.searchsorted(steps, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(np.float64)
                    own[0, r : r + BLOCK] += w.sum(axis=0)
                    own[1, r : r + BLOCK] += v @ w
        for g, (n, s) in sums.items():
            yield pd.DataFrame({"g": g, "r": np.arange(resamples), "n": n, "s": s})

    rows = df.where(F.col(value).isNotNull()).select(F.col(group).cast("string").alias("g"), F.xxhash64(key).alias("h"), F.col(value).cast("double").alias("v"))
    parts = rows.mapInPandas(add, "g string, r int, n double, s double").groupBy("g", "r").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    m = parts.groupBy("g").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return rows.groupBy("g").agg(F.avg("v").alias("mean")).join(m, "g").withColumnRenamed("g", group)


def paired_bootstrap(pairs: DataFrame, group: str, key: str, a: str, b: str, resamples: int = RESAMPLES) -> DataFrame:
    """group, mean, low, high of the differences a - b."""
    return bootstrap(pairs.withColumn("_d", F.col(a) - F.col(b)), group, key, "_d", resamples)


def average_precision(labels, scores) -> float:
    """Precision at each distinct score, weighed by the recall gained there."""
    import numpy as np

    order = np.argsort(-scores, kind="stable")
    y, s = labels[order], scores[order]
    last = np.append(s[1:] != s[:-1], True)
    hits, n = np.cumsum(y)[last], (np.arange(len(y)) + 1)[last]
    return float((np.diff(hits, prepend=0) / max(hits[-1], 1) * hits / n).sum()) if len(y) else math.nan


def stratified_draws(labels, resamples: Iterable[int], seed: int):
    """For each resample the places drawn, as many of each label as there are; a resample's draw depends on its number alone."""
    import numpy as np

    places = [np.flatnonzero(labels == v) for v in np.unique(labels)]
    for r in resamples:
        rng = np.random.default_rng((seed, int(r)))
        yield r, np.concatenate([p[rng.integers(0, len(p), len(p))] for p in places])


def bootstrap_auc_pr(scored: DataFrame, label: str, score: str, against: str | None = None, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """One row: point, low, high, std, share_above_zero, n_resamples of the average precision, or of what one score's exceeds another's by.

    The test population (bounded: EVALUATION_ROWS) goes to every task; resamples are dealt among tasks.
    """
    import numpy as np

    columns = [score] + ([against] if against else [])
    if scored.limit(EVALUATION_ROWS + 1).count() > EVALUATION_ROWS:
        raise ValueError(f"more than {EVALUATION_ROWS} rows to draw from")
    data = scored.orderBy(*columns, label).select(F.col(label).cast("int").alias("y"), *[F.col(c).cast("double") for c in columns]).toPandas()
    spark = scored.sparkSession
    y, x = data["y"].to_numpy(), [data[c].to_numpy() for c in columns]
    shared = spark.sparkContext.broadcast((y, x))

    def value(y, x, at) -> float:
        own = [average_precision(y[at], s[at]) for s in x]
        return own[0] - own[1] if len(own) > 1 else own[0]

    def run(batches):
        labels, scores = shared.value
        for b in batches:
            yield pd.DataFrame({"v": [value(labels, scores, at) for _, at in stratified_draws(labels, b["id"], seed)]})

    v = spark.range(resamples, numPartitions=max(1, min(resamples // 50, 64))).mapInPandas(run, "v double").where(~F.isnan("v"))
    point = value(y, x, np.arange(len(y)))
    return v.agg(F.lit(point).alias("point"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"), F.stddev_pop("v").alias("std"), F.avg((F.col("v") > 0).cast("double")).alias("share_above_zero"), F.count("*").alias("n_resamples"))


# --- agreement and validation ------------------------------------------------------------------------

def pairs_of_annotators(annotations: DataFrame) -> DataFrame:
    """case_id and the first two annotators' columns by name (a_, b_); two annotations of a case by one annotator raise when read."""
    from ..sources.corpora import none_of

    twice = F.count("*").over(W.partitionBy("case_id", "annotator")) > 1
    own = none_of(annotations.withColumn("_t", twice), F.col("_t"), "an annotator has a case twice").drop("_t")
    r = own.withColumn("_r", F.row_number().over(W.partitionBy("case_id").orderBy("annotator")))
    side = lambda k, p: r.where(F.col("_r") == k).select("case_id", *[F.col(c).alias(p + c) for c in annotations.columns if c != "case_id"])
    return side(1, "a_").join(side(2, "b_"), "case_id")


def measure_agreement(annotations: DataFrame) -> DataFrame:
    """One row over doubly annotated cases (case_id, annotator, typology, mentioned, narrative, seconds): n_pairs, kappa, its band,
    mean Jaccard of what is mentioned, mean token F1, mean difference of seconds, the share of typologies agreed on."""
    p = pairs_of_annotators(annotations)
    both, either = F.size(F.array_intersect("a_mentioned", "b_mentioned")), F.size(F.array_union("a_mentioned", "b_mentioned"))
    f1 = text.token_f1(p.select(F.col("case_id").alias("pair_id"), F.col("a_narrative").alias("a"), F.col("b_narrative").alias("b"))).withColumnRenamed("pair_id", "case_id")
    j = p.join(f1, "case_id").agg(F.count("*").alias("n_pairs"), F.avg(F.when(either == 0, 1.0).otherwise(both / either)).alias("content_jaccard"), F.avg("f1").alias("text_f1"), F.avg(F.abs(F.col("a_seconds") - F.col("b_seconds"))).alias("seconds_apart"))
    k = st.cohens_kappa(p, "a_typology", "b_typology")
    return j.crossJoin(k.select("kappa", st.kappa_band(F.col("kappa")).alias("band"), F.col("observed").alias("typology_agreed")))  # one row each


def disagreements(annotations: DataFrame) -> DataFrame:
    """typologies (both, in order), n: pairs of annotators that differ."""
    p = pairs_of_annotators(annotations).where("a_typology <> b_typology")
    return p.groupBy(F.array_join(F.array_sort(F.array("a_typology", "b_typology")), "/").alias("typologies")).agg(F.count("*").alias("n"))


def score_annotator(annotations: DataFrame, calibration: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """annotator, n, typology, salience, hedging, factual (means over the calibration cases), passed: annotations (case_id,
    annotator, typology, mentioned, hedged, factual) against (case_id, typology, mentioned, hedged)."""
    c = calibration.select("case_id", F.col("typology").alias("_t"), F.col("mentioned").alias("_m"), F.col("hedged").alias("_h"))
    j = annotations.join(c, "case_id")
    either = F.size(F.array_union("mentioned", "_m"))
    g = j.groupBy("annotator").agg(F.count("*").alias("n"), F.avg((F.col("typology") == F.col("_t")).cast("double")).alias("typology"), F.avg(F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect("mentioned", "_m")) / either)).alias("salience"), F.avg((F.col("hedged") == F.col("_h")).cast("double")).alias("hedging"), F.avg("factual").alias("factual"))
    ok = F.lit(True)
    for name, least in thresholds.items():
        ok = ok & (F.col(name) >= least)
    return g.withColumn("passed", ok)


def validate_metrics(automatic: DataFrame, human: DataFrame) -> DataFrame:
    """metric, dimension, n, pearson, spearman of automatic (case_id, metric, value) against human (case_id, dimension, rating) values of the same cases."""
    j = automatic.join(human, "case_id")
    k = ("metric", "dimension")
    r = j.withColumn("_x", st.midrank("value", *k)).withColumn("_y", st.midrank("rating", *k))
    return r.groupBy(*k).agg(F.count("*").alias("n"), F.corr("value", "rating").alias("pearson"), F.corr("_x", "_y").alias("spearman"))


def against_baseline(means: DataFrame, baseline: str) -> DataFrame:
    """system, n_pairs, mean_difference, median_difference of raters' means (rater, system, value) against the baseline's."""
    base = means.where(F.col("system") == baseline).select("rater", F.col("value").alias("_b"))
    j = means.where(F.col("system") != baseline).join(base, "rater").withColumn("d", F.col("value") - F.col("_b"))
    return j.groupBy("system").agg(F.count("*").alias("n_pairs"), F.avg("d").alias("mean_difference"), F.percentile("d", 0.5).alias("median_difference"))


def rater_effects(ratings: DataFrame) -> DataFrame:
    """One row: grand mean, variance between raters and within them by the method of moments (a random intercept for each
    rater), and the share of the first: ratings (rater, value) need not be balanced."""
    g = ratings.groupBy("rater").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("mm"))
    mean, within = F.col("t") / F.col("N"), F.col("w") / F.greatest(F.col("N") - F.col("k"), F.lit(1))
    between = (F.col("mm") - F.col("N") * mean * mean) / F.greatest(F.col("k") - 1, F.lit(1))
    size = (F.col("N") - F.col("q") / F.col("N")) / F.greatest(F.col("k") - 1, F.lit(1))
    b = F.greatest(F.lit(0.0), F.when(size > 0, (between - within) / size).otherwise(0.0))
    return s.select(mean.alias("mean"), b.alias("between"), within.alias("within"), F.when(b + within > 0, b / (b + within)).otherwise(0.0).alias("share"), F.col("k").alias("n_raters"))


def balanced_subset(cells: DataFrame) -> DataFrame:
    """Cells (case_id, system, ...) of the largest balanced part of a design: cases of the commonest number of systems, less
    those with the rarest system until all systems come equally often. What is decided on is the different sets of systems."""
    sets = cells.groupBy("case_id").agg(F.array_sort(F.collect_set("system")).alias("_s"))
    there = {tuple(r["_s"]): r["n"] for r in sets.groupBy("_s").agg(F.count("*").alias("n")).collect()}  # as many as there are combinations of systems
    by_size: dict[int, int] = {}
    for s, n in there.items():
        by_size[len(s)] = by_size.get(len(s), 0) + n
    size = max(by_size, key=lambda k: (by_size[k] * k, k), default=0)
    kept = {s: n for s, n in there.items() if len(s) == size}
    while kept:
        times: dict[str, int] = {}
        for s, n in kept.items():
            for name in s:
                times[name] = times.get(name, 0) + n
        if len(set(times.values())) == 1:
            break
        rare = min(times, key=lambda name: (times[name], name))
        kept = {s: n for s, n in kept.items() if rare not in s}
    spark = cells.sparkSession
    own = spark.createDataFrame([(list(s),) for s in kept], "_s array<string>")
    return cells.join(sets.join(F.broadcast(own), "_s", "left_semi").select("case_id"), "case_id", "left_semi")


# --- summaries and reports ---------------------------------------------------------------------------

def distribution(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, least, p05, median, p95, most, mean; quantiles are the sorted values' places int(p * n), from 0."""
    w, all_ = W.partitionBy(group).orderBy(value), W.partitionBy(group)
    r = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(all_).alias("n"))
    at = lambda p: F.max(F.when(F.col("i") == F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("v")))
    return r.groupBy(group).agg(F.count("*").alias("n"), F.min("v").alias("least"), at(0.05).alias("p05"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max("v").alias("most"), F.avg("v").alias("mean"))


def size_bin(n: Column, edges: tuple[int, ...] = (0, 25, 50, 100)) -> Column:
    """The half-open size band [low, high) as text; beyond the last, open."""
    out = F.lit(f"{edges[-1]}+")
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when((n >= low) & (n < high), f"{low}-{high - 1}").otherwise(out)
    return F.when(n >= edges[0], out)


def latency_by_size(samples: DataFrame, value: str, nodes: str) -> DataFrame:
    return st.latency(samples.withColumn("band", size_bin(F.col(nodes))), value, "band")


def run_benchmark(call: Callable, items: list, warm_up: int = 20, measured: int = 100) -> list[float]:
    """Milliseconds of `measured` calls after `warm_up` that don't count; items are taken in turn."""
    out = []
    for i in range(warm_up + measured):
        start = time.perf_counter()
        call(items[i % len(items)])
        if i >= warm_up:
            out.append((time.perf_counter() - start) * 1000)
    return out


def breakeven_per_month(local_per_1000: Column, api_per_1000: Column, usd_per_hour: Column, utilisation: Column) -> Column:
    """Narratives a month from which a machine of one's own costs less than the API; null where it never does."""
    gap = api_per_1000 - local_per_1000
    return F.when((api_per_1000 > 0) & (gap > 0), 1000.0 * usd_per_hour * 730.0 * utilisation / gap)


def template_finding(scores: DataFrame, template: str, threshold: float) -> DataFrame:
    """metric, template_score, best_system, best_score, margin, non_discriminative: whether any system beats the template by the threshold."""
    t = scores.where(F.col("system") == template).select("metric", F.col("value").alias("template_score"))
    best = scores.where((F.col("system") != template) & F.col("value").isNotNull()).groupBy("metric").agg(F.min(F.struct((-F.col("value")).alias("v"), "system")).alias("x"))
    j = t.join(best, "metric").select("metric", "template_score", F.col("x.system").alias("best_system"), (-F.col("x.v")).alias("best_score"))
    return j.withColumn("margin", F.col("best_score") - F.col("template_score")).withColumn("non_discriminative", F.col("margin") < threshold)


def retention(assignment: DataFrame, kept: DataFrame, *by: str) -> DataFrame:
    """by, n, n_kept, share of assigned cases (case_id, teacher, ...) that were kept (case_id)."""
    j = assignment.join(kept.select("case_id").distinct().withColumn("_k", F.lit(1)), "case_id", "left")
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.count("_k").alias("n_kept"), (F.count("_k") / F.count("*")).alias("share"))


def balance(assignment: DataFrame, kept: DataFrame, stratum: str) -> DataFrame:
    """stratum, least, most, spread: how far teachers' shares of a stratum lie apart, of what was kept."""
    own = assignment.join(kept.select("case_id").distinct(), "case_id", "left_semi")
    teachers = assignment.select("teacher").distinct()
    strata = own.groupBy(stratum).agg(F.count("*").alias("_n"))
    n = own.groupBy(stratum, "teacher").agg(F.count("*").alias("n"))
    whole = strata.crossJoin(F.broadcast(teachers)).join(n, [stratum, "teacher"], "left").withColumn("share", F.coalesce("n", F.lit(0)) / F.col("_n"))  # teachers are a handful
    return whole.groupBy(stratum).agg(F.min("share").alias("least"), F.max("share").alias("most"), (F.max("share") - F.min("share")).alias("spread"))


def extraction_cells(cuts: DataFrame) -> DataFrame:
    """k, n_max, n, p50 and p90 of accounts (nearest rank), recovery: cut cases (k, n_max, n_nodes, n_flagged, n_flagged_seen) by parameters."""
    q = lambda p, n: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n_nodes)").cast("long").alias(n)
    return cuts.groupBy("k", "n_max").agg(F.count("*").alias("n"), q(0.5, "p50"), q(0.9, "p90"), F.avg(F.when(F.col("n_flagged") > 0, F.col("n_flagged_seen") / F.col("n_flagged"))).alias("recovery"))


def self_bleu_curve(docs: DataFrame, references: tuple[int, ...] = (1, 3, 5, 10, 50)) -> DataFrame:
    """references, self_bleu: the mean at several numbers of references, to show where it saturates."""
    out = None
    for k in references:
        one = text.self_bleu(docs, k).agg(F.lit(k).alias("references"), F.avg("bleu").alias("self_bleu"))
        out = one if out is None else out.unionByName(one)
    return out


def latex_table(rows: DataFrame, columns: list[str], places: int = 3) -> str:
    """A report's table (few rows) as LaTeX."""
    cell = lambda v: "--" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = [" & ".join(cell(r[c]) for c in columns) + r" \\" for r in rows.select(*columns).limit(1000).collect()]
    head = " & ".join(cell(c) for c in columns) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' + 'r' * (len(columns) - 1)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])


# --- responses of models -----------------------------------------------------------------------------

def json_of(response: Column) -> Column:
    """The JSON object in a response: in a fence, or from the first brace to the last."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(response, r"(?s)(\{.*\})", 1))


def parse_violations(responses: DataFrame) -> DataFrame:
    """case_id, sentence, reason: what a self-check reports; responses without JSON report nothing."""
    x = F.from_json(json_of(F.col("response")), "violations array<struct<sentence:string,reason:string>>")
    return responses.select("case_id", F.explode(x["violations"]).alias("v")).select("case_id", "v.*")


def parse_entailment(responses: DataFrame, claims: DataFrame) -> DataFrame:
    """case_id, index, verdict, rationale of claims (case_id, index): UNVERIFIABLE where the judge gives none, or none that is known."""
    x = F.from_json(json_of(F.col("response")), "verdicts array<struct<index:int,verdict:string,rationale:string>>")
    v = responses.select("case_id", F.posexplode(x["verdicts"]).alias("place", "v")).select("case_id", "place", F.col("v.index").alias("index"), F.upper(F.trim("v.verdict")).alias("verdict"), F.trim("v.rationale").alias("rationale"))
    last = v.where(F.col("verdict").isin("SUPPORTED", "CONTRADICTED", "UNVERIFIABLE")).groupBy("case_id", "index").agg(F.max_by(F.struct("verdict", "rationale"), "place").alias("x"))
    j = claims.select("case_id", "index").join(last, ["case_id", "index"], "left")
    return j.select("case_id", "index", F.coalesce("x.verdict", F.lit("UNVERIFIABLE")).alias("verdict"), F.coalesce("x.rationale", F.lit("the judge returned no verdict for this claim")).alias("rationale"))


def parse_extraction(responses: DataFrame) -> DataFrame:
    """case_id, index, field_path, value, evidence, start (character in the narrative; null if the evidence isn't there):
    each claim's evidence is looked for behind the one before it, then anywhere."""

    def run(batches):
        for b in batches:
            out = []
            for case, response, narrative in zip(b["case_id"], b["response"], b["narrative"], strict=True):
                found = re.search(r"(?s)```(?:json)?\s*(\{.*?\})\s*```|(\{.*\})", response or "")
                try:
                    listed = json.loads(next(g for g in found.groups() if g)).get("claims", []) if found else []
                except (ValueError, AttributeError):
                    listed = []
                cursor = 0
                for i, c in enumerate(c for c in listed if isinstance(c, dict)):
                    evidence = str(c.get("evidence") or "")
                    at = narrative.find(evidence, cursor) if evidence else -1
                    at = narrative.find(evidence) if at < 0 and evidence else at
                    cursor = at + len(evidence) if at >= 0 else cursor
                    out.append((case, i, c.get("field_path"), None if c.get("value") is None else str(c["value"]), evidence, at if at >= 0 else None))
            yield pd.DataFrame(out, columns=["case_id", "index", "field_path", "value", "evidence", "start"]).astype({"start": "Int64", "index": "int32"})

    return responses.select("case_id", "response", "narrative").mapInPandas(run, "case_id string, index int, field_path string, value string, evidence string, start long")


def inverted(display: dict[str, str]) -> dict[str, str]:
    """Display texts back to their values; two values of one text raise."""
    out = {v: k for k, v in display.items()}
    if len(out) != len(display):
        raise ValueError("two values are displayed alike")
    return out


def derangement(ids: DataFrame, column: str, seed: str = "17") -> DataFrame:
    """id, other: every id with another one: neighbours in hash order, the last with the first. Ids are numbered by range, not gathered."""
    h = ids.select(F.col(column).alias("id"), F.sha2(F.concat_ws(":", F.lit(seed), F.col(column).cast("string")), 256).alias("h"))
    n = numbered(h, "h")
    total = n.count()
    return n.select("id", "k").join(n.select(F.col("id").alias("other"), F.pmod(F.col("k") - 1, F.lit(max(total, 1))).alias("k")), "k").select("id", "other")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with k, their place (from 0) in a total order: sorted by range, counted by partition, numbered in each."""
    from .graph import keep

    s = keep(df.orderBy(*order).withColumn("_p", F.spark_partition_id()), df.sparkSession)
    sizes = s.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a partition
    return s.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1).join(F.broadcast(before), "_p").withColumn("k", F.col("_b") + F.col("_r")).drop("_p", "_r", "_b")


# --- cue rules ---------------------------------------------------------------------------------------

def cue_rule(pattern: str, field_path: str, claim_type: str) -> tuple[str, str, str]:
    """A rule: the pattern's first group is the claim's value. A pattern that doesn't compile, or has no group, raises."""
    if re.compile(pattern).groups < 1:
        raise ValueError(f"{pattern} has no group for the value")
    return pattern, field_path, claim_type


def claims_by_cues(docs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """case_id, claim_id, field_path, claim_type, raw: claims that rules find in texts (case_id, text), in the rules' order; of
    rules with one field the first that finds something speaks."""
    found = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(path).alias("field_path"), F.lit(kind).alias("claim_type"), F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("values")) for i, (pattern, path, kind) in enumerate(rules)])
    r = docs.select("case_id", F.explode(found).alias("x")).select("case_id", "x.*").where(F.size("values") > 0)
    first = r.withColumn("_k", F.row_number().over(W.partitionBy("case_id", "field_path").orderBy("rule"))).where("_k = 1")
    out = first.select("case_id", "rule", "field_path", "claim_type", F.posexplode("values").alias("place", "raw"))
    return out.select("case_id", F.concat_ws(":", "case_id", F.col("rule").cast("string"), F.col("place").cast("string")).alias("claim_id"), "field_path", "claim_type", "raw")
