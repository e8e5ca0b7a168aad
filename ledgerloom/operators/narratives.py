"""Narratives from facts: segments with slots, length bounds, claims read back from the text, live flags, the gate.

A segment is a struct (section, text, field_path, optional): text with at most one value, or plain text where
field_path is null. Spans are half-open character offsets in the narrative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formatting as fm
from . import text as tx

SEGMENT = "struct<section:int,text:string,field_path:string,optional:boolean>"
SLOT = "struct<field_path:string,start:int,end:int,rendered:string>"
LEAST_TOKENS, MOST_TOKENS = 80, 400
UNVERIFIABLE_BUDGET = 0.05
DUPLICATE = 0.85
#: Phrases that no narrative may hold, by the class of what they assert.
FORBIDDEN = (("guilt", "guilty"), ("guilt", "criminal"), ("guilt", "committed fraud"), ("guilt", "money launderer"), ("entity_type", "shell company"), ("entity_type", "casino"), ("completeness", "all transactions"), ("completeness", "no other activity"), ("motive", "in order to hide"), ("motive", "intended to conceal"))
ACCOUNT = r"\bN\d+\|A\d+\b"


def segment(section: int, text: Column, field_path: str | None = None, optional: bool = False) -> Column:
    return F.struct(F.lit(section).alias("section"), text.alias("text"), F.lit(field_path).cast("string").alias("field_path"), F.lit(optional).alias("optional"))


def assemble(df: DataFrame, segments: str = "segments") -> DataFrame:
    """Adds narrative and slots: segments run on within a section, sections are paragraphs."""
    step = lambda a, s: F.struct(
        F.concat(a["text"], F.when(a["section"] == s["section"], "").when(a["text"] == "", "").otherwise("\n\n"), s["text"]).alias("text"),
        s["section"].alias("section"),
        F.when(s["field_path"].isNull(), a["slots"]).otherwise(
            F.concat(a["slots"], F.array(F.struct(
                s["field_path"].alias("field_path"),
                (F.length(a["text"]) + F.when((a["section"] == s["section"]) | (a["text"] == ""), 0).otherwise(2)).alias("start"),
                (F.length(a["text"]) + F.when((a["section"] == s["section"]) | (a["text"] == ""), 0).otherwise(2) + F.length(s["text"])).alias("end"),
                s["text"].alias("rendered"),
            )))
        ).alias("slots"),
    )
    start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("section"), F.array().cast(f"array<{SLOT}>").alias("slots"))
    built = F.aggregate(segments, start, step)
    return df.withColumn("_b", built).withColumn("narrative", F.col("_b.text")).withColumn("slots", F.col("_b.slots")).drop("_b")


def account_segments(facts: DataFrame, variants: int = 3, keep: list[str] | None = None) -> DataFrame:
    """case_id (or the columns to keep), segments: four sections on an account's activity (case_id, n_out, n_in, total_out, total_in, first_ts, last_ts, role; tagged totals).

    The wording of the opening rotates by the case's digest; a total that isn't available is said to be so.
    """
    v = fm.variant(variants, F.lit("opening"), F.col("case_id"))
    opening = F.when(v == 0, "This review concerns account ").when(v == 1, "The subject of this review is account ").otherwise("Activity was reviewed for account ")

    def money(c: str, path: str, lead: str) -> list[Column]:
        have = F.col(f"{c}.available")
        return [segment(2, F.lit(lead)), segment(2, F.when(have, F.format_number(F.coalesce(F.col(f"{c}.value"), F.lit(0.0)), 2)).otherwise("an amount that is not available"), path), segment(2, F.when(have, F.lit(". ")).otherwise(F.concat(F.lit(" ("), F.regexp_replace(F.coalesce(F.col(f"{c}.reason"), F.lit("")), "_", " "), F.lit("). "))))]

    parts = [
        segment(0, opening), segment(0, F.col("case_id"), "focal.account"), segment(0, F.lit(".")),
        segment(1, F.lit("Between ")), segment(1, fm.format_timestamp(F.col("first_ts")), "temporal.first"), segment(1, F.lit(" and ")), segment(1, fm.format_timestamp(F.col("last_ts")), "temporal.last"),
        segment(1, F.lit(" it sent ")), segment(1, fm.format_count(F.col("n_out")), "flow.n_out"), segment(1, F.lit(" and received ")), segment(1, fm.format_count(F.col("n_in")), "flow.n_in"), segment(1, F.lit(" transfers.")),
        *money("total_out", "flow.total_out", "It paid "), *money("total_in", "flow.total_in", "It received "),
        segment(3, F.lit("Among its counterparties it acted as ")), segment(3, F.col("role"), "focal.role"), segment(3, F.lit("."), None), segment(3, F.lit(" No conclusion on intent is drawn."), None, True),
    ]
    return facts.select(*(keep or ["case_id"]), F.array(*parts).alias("segments"))


def bound_length(df: DataFrame, most: int, segments: str = "segments") -> DataFrame:
    """Optional segments go, the last first, until the estimated tokens of all are at most `most` (or none is left).

    Tokens are counted by segment, once; whether a segment goes follows from the optional ones after it.
    """
    d = df.withColumn("_n", F.transform(segments, lambda s: tx.heuristic_tokens(s["text"])))
    d = d.withColumn("_over", F.aggregate("_n", F.lit(0), lambda x, y: x + y) - most)
    # Long narratives are few: the others keep their segments without a second look.
    later = lambda i: F.aggregate(F.zip_with(F.slice(F.col(segments), i + 2, F.size(segments)), F.slice("_n", i + 2, F.size(segments)), lambda s, n: F.when(s["optional"], n).otherwise(0)), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))
    kept = F.filter(segments, lambda s, i: ~s["optional"] | (later(i) >= F.col("_over")))
    return d.withColumn(segments, F.when(F.col("_over") <= 0, F.col(segments)).otherwise(kept)).drop("_n", "_over")


def claims_from_slots(narratives: DataFrame) -> DataFrame:
    """Claims read from the text under each slot, never from the record: case_id, claim_id, field_path, claim_type, number, text, unit."""
    s = narratives.select("case_id", F.posexplode(slot_claims()).alias("i", "c"))
    return s.select("case_id", F.concat_ws(":", "case_id", F.col("i").cast("string")).alias("claim_id"), "c.*")


def slot_claims(narrative: str = "narrative", slots: str = "slots") -> Column:
    """The claims of one text, in the order of its slots: an array of (field_path, claim_type, number, text, unit)."""

    def read(s):
        return F.struct(s["field_path"].alias("field_path"), F.substring(F.col(narrative), s["start"] + 1, s["end"] - s["start"]).alias("span"))

    def claim(s):
        path, span = s["field_path"], s["span"]
        kind = F.when(path.isin("flow.n_out", "flow.n_in"), "count").when(path.like("flow.total%"), "money").when(path.like("temporal.%"), "timestamp").otherwise("categorical")
        number = F.when(kind.isin("count", "money"), F.regexp_replace(span, ",", "").try_cast("double")).when(kind == "timestamp", F.unix_micros(F.try_to_timestamp(span, F.lit("yyyy-MM-dd HH:mm"))) / 1e6)
        return F.struct(path.alias("field_path"), kind.alias("claim_type"), number.alias("number"), span.alias("text"), F.lit(None).cast("string").alias("unit"))

    return F.transform(F.transform(slots, read), claim)


def named_accounts(narrative: str = "narrative") -> Column:
    """The different account ids in a text, as an array."""
    return F.array_distinct(F.regexp_extract_all(narrative, F.lit(ACCOUNT), F.lit(0)))


def unlisted_entities(narratives: DataFrame, inventory: DataFrame) -> DataFrame:
    """case_id, entity: account ids in a text that the case's inventory (case_id, entity) lacks."""
    found = narratives.select("case_id", F.explode(named_accounts()).alias("entity"))
    return found.join(inventory.select("case_id", "entity").distinct(), ["case_id", "entity"], "left_anti")


def forbidden_phrases(narratives: DataFrame) -> DataFrame:
    """case_id, phrase_group, phrase: of each group the longest forbidden phrase."""
    spark = narratives.sparkSession
    phrases = spark.createDataFrame(list(FORBIDDEN), "phrase_group string, phrase string")
    return tx.phrase_hits(narratives.select(F.col("case_id").alias("doc_id"), F.col("narrative").alias("text")), phrases).withColumnRenamed("doc_id", "case_id")


def holds_forbidden(narrative: str = "narrative") -> Column:
    """Whether `forbidden_phrases` finds any in a text."""
    return reduce(lambda x, y: x | y, [F.contains(F.lower(narrative), F.lit(p)) for _, p in FORBIDDEN])


def near_duplicates(narratives: DataFrame, threshold: float = DUPLICATE, bands: int = 16) -> DataFrame:
    """case_id of narratives (case_id is unique) that a smaller, kept one nearly equals in its five-word shingles.

    Shingles that name an account are counted over all narratives first: of n shingles u that no other one holds, and at
    least v in every other, leave a likeness of at most (n - u) / (n + v). What can't reach the threshold so is near
    nothing, whatever else it says; only the rest is searched. So many texts of one wording, each on its own account,
    aren't compared with one another.
    """
    from .graph import keep

    spark = narratives.sparkSession
    s = narratives.select("case_id", tx.words(F.coalesce("narrative", F.lit(""))).alias("w")).select("case_id", tx.shingles(F.col("w")).alias("s"))
    named = F.transform(F.filter("s", lambda x: F.contains(x, F.lit("|"))), lambda x: F.xxhash64(x))
    held = s.select(F.struct("case_id", F.size("s").alias("n")).alias("doc"), F.explode(named).alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("doc").alias("doc"))
    own = keep(held.where("c = 1").groupBy("doc").agg(F.count("*").alias("u")).select("doc.case_id", "doc.n", "u"), spark)
    total = narratives.count()
    some, least = own.agg(F.count("*"), F.min("u")).first()
    alone = own.where((F.col("n") - F.col("u")) / (F.col("n") + F.lit(least if some == total else 0)) < threshold)
    if alone.count() == total:
        return narratives.limit(0).select("case_id")
    left = narratives.join(alone.select("case_id"), "case_id", "left_anti").select(F.col("case_id").alias("doc_id"), F.col("narrative").alias("text"))
    return tx.lsh_near_duplicates(keep(left, spark), threshold, bands=bands).select(F.col("b").cast(narratives.schema["case_id"].dataType).alias("case_id"))


def salience_in_text(narratives: DataFrame, required: DataFrame) -> DataFrame:
    """case_id, n_required, n_said, share: required values (case_id, field_path, needle) that the lower-cased text holds as they are."""
    j = required.join(narratives.select("case_id", F.lower("narrative").alias("t")), "case_id")
    return j.groupBy("case_id").agg(F.count("*").alias("n_required"), F.count_if(F.expr("contains(t, lower(needle))")).alias("n_said")).withColumn("share", F.col("n_said") / F.col("n_required"))


def relocate_slots(rewritten: DataFrame) -> DataFrame:
    """case_id, field_path, start, end: slots of a draft found again in a rewritten text, the longest value first, no place twice, whole words only."""

    def run(batches):
        import re

        import pandas as pd

        for pdf in batches:
            out = []
            for case, text, slots in zip(pdf["case_id"], pdf["rewritten"], pdf["slots"], strict=True):
                used = [False] * len(text or "")
                for s in sorted(slots, key=lambda s: (-len(s["rendered"]), s["start"])):
                    for m in re.finditer(rf"(?<!\w){re.escape(s['rendered'])}(?!\w)", text or ""):
                        if not any(used[m.start() : m.end()]):
                            used[m.start() : m.end()] = [True] * (m.end() - m.start())
                            out.append((case, s["field_path"], m.start(), m.end()))
                            break
            yield pd.DataFrame(out, columns=["case_id", "field_path", "start", "end"])

    return rewritten.select("case_id", "rewritten", "slots").mapInPandas(run, f"case_id {rewritten.schema['case_id'].dataType.simpleString()}, field_path string, start int, end int")


def residual_numbers(narratives: DataFrame) -> DataFrame:
    """case_id, text: numbers in a narrative that no slot covers (each would be a claim nobody backs)."""
    blank = F.aggregate("slots", F.col("narrative"), lambda t, s: F.overlay(t, F.repeat(F.lit("_"), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))
    return narratives.select("case_id", F.explode(F.regexp_extract_all(blank, F.lit(r"\b\d[\d,]*(?:\.\d+)?%?"), F.lit(0))).alias("text"))


def skeletons(narratives: DataFrame) -> DataFrame:
    """case_id, skeleton: the narrative with its slots' values blanked."""
    ordered = F.reverse(F.array_sort("slots", lambda a, b: a["start"] - b["start"]))
    return narratives.select("case_id", F.aggregate(ordered, F.col("narrative"), lambda t, s: F.overlay(t, F.concat(F.lit("{"), s["field_path"], F.lit("}")), s["start"] + 1, s["end"] - s["start"])).alias("skeleton"))


def gate(narratives: DataFrame, scores: DataFrame, entities: DataFrame, phrases: DataFrame, identifiers: DataFrame, duplicates: DataFrame, splits: DataFrame, graph_counts: DataFrame, version: str = "1.0.0") -> DataFrame:
    """case_id, failed (checks in order, joined by commas; empty: passed) of the ten points.

    narratives: (case_id, narrative, slots, split, schema_version, n_nodes, n_edges); scores as from claims; entities, phrases, identifiers
    and duplicates by case_id; splits: the frozen (case_id, split); graph_counts: (case_id, n_nodes, n_edges) of the stored graph. Verdicts are
    derived anew from the text, not read.
    """
    flag = lambda d, n: d.select("case_id").distinct().withColumn(n, F.lit(True))
    j = narratives.join(scores.select("case_id", "n_claims", "n_contradicted", "n_unverifiable"), "case_id", "left")
    for d, n in ((entities, "_e"), (phrases, "_p"), (identifiers, "_i"), (duplicates, "_d")):
        j = j.join(flag(d, n), "case_id", "left")
    j = j.join(splits.select("case_id", F.col("split").alias("_split")), "case_id", "left").join(graph_counts.select("case_id", F.col("n_nodes").alias("_nodes"), F.col("n_edges").alias("_edges")), "case_id", "left")
    return j.select("case_id", failed(gate_checks(version)).alias("failed"))


def gate_checks(version: str = "1.0.0") -> list[tuple[str, Column]]:
    """The ten points in order, by name, over a row that holds a record's columns and n_claims, n_contradicted and n_unverifiable; whether it
    has unlisted entities (_e), forbidden phrases (_p), identifiers (_i) and a duplicate (_d); its frozen _split; the stored graph's _nodes and _edges."""
    tokens = tx.heuristic_tokens(F.col("narrative"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = F.coalesce("n_claims", F.lit(0))
    return [
        ("schema_valid", F.col("narrative").isNotNull() & F.col("slots").isNotNull() & F.col("split").isNotNull()),
        ("graph_ref_resolves", F.coalesce((F.col("_nodes") == F.col("n_nodes")) & (F.col("_edges") == F.col("n_edges")), F.lit(False))),
        ("facts_schema_version", F.col("schema_version") == version),
        ("zero_contradicted", F.coalesce("n_contradicted", F.lit(0)) == 0),
        ("unverifiable_rate", (n == 0) | (F.coalesce("n_unverifiable", F.lit(0)) <= UNVERIFIABLE_BUDGET * n)),
        ("length_in_bounds", tokens.between(LEAST_TOKENS, MOST_TOKENS)),
        ("vocabulary_clean", ~yes("_e") & ~yes("_p")),
        ("no_identifiers", ~yes("_i")),
        ("not_duplicate", ~yes("_d")),
        ("split_consistent", F.coalesce(F.col("split") == F.col("_split"), F.lit(False))),
    ]


def failed(checks: list[tuple[str, Column]]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])), ",")


def serialise(facts: DataFrame, compact: bool = False) -> DataFrame:
    """case_id, serialised: available facts (case_id, field_path, available, number, text, unit) in path order, a line each or in one line."""
    value = F.coalesce(F.col("text"), F.format_string("%.2f", "number"))
    line = F.concat(F.col("field_path"), F.lit("=" if compact else ": "), value, F.when(F.col("unit").isNotNull(), F.concat(F.lit(" "), F.col("unit"))).otherwise(""))
    g = facts.where("available").groupBy("case_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select("case_id", F.array_join("lines", "|" if compact else "\n").alias("serialised"))


# --- references ---------------------------------------------------------------------------------------

def reference_scores(pairs: DataFrame) -> DataFrame:
    """pair_id, rouge1, rouge2, rougeL (F of unigrams, bigrams, longest common subsequence) and bleu (smoothed sentence BLEU-4) of a candidate a against a reference b."""

    def run(batches):
        import math
        from collections import Counter

        import pandas as pd

        def f(hit, x, y):
            return 2 * hit / (x + y) if x + y else 1.0

        for pdf in batches:
            out = []
            for key, a, b in zip(pdf["pair_id"], pdf["a"], pdf["b"], strict=True):
                x, y = tx.python_words(a or ""), tx.python_words(b or "")
                g = lambda t, n: Counter(zip(*[t[i:] for i in range(n)], strict=False))
                r = [f(sum((g(x, n) & g(y, n)).values()), max(len(x) - n + 1, 0), max(len(y) - n + 1, 0)) for n in (1, 2)]
                row = [0] * (len(y) + 1)
                for w in x:
                    last = 0
                    for j, v in enumerate(y, 1):
                        last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
                logs = sum(math.log((sum((g(x, n) & g(y, n)).values()) + (n > 1)) / (max(len(x) - n + 1, 0) + (n > 1)) if x and sum((g(x, 1) & g(y, 1)).values()) else 1e-9) for n in range(1, 5)) / 4
                brevity = 1.0 if len(x) >= len(y) or not x else math.exp(1 - len(y) / len(x))
                out.append((key, r[0], r[1], f(row[-1], len(x), len(y)), brevity * math.exp(logs) if x and y else float(not x and not y)))
            yield pd.DataFrame(out, columns=["pair_id", "rouge1", "rouge2", "rougeL", "bleu"])

    return pairs.select("pair_id", "a", "b").mapInPandas(run, f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, rouge1 double, rouge2 double, rougeL double, bleu double")
