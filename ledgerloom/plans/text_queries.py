"""Queries of the text operators, with their SQL (patterns are kept to what both engines' regular expressions share)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text
from .registry import query


def q(s: str) -> str:
    return s.replace("'", "''")


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


#: Unicode-aware classes differ between engines; texts are compared on their ASCII lower case.
WORDS = f"regexp_extract_all(lower({{}}), '{text.WORD}')"


def grams(w: str, n: int) -> str:
    return f"CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')) ELSE [] END"


@query("exact_duplicates", "WITH g AS (SELECT text, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, first_id, n FROM documents JOIN g USING (text)")
def exact_duplicates(spark, d):
    return text.exact_duplicates(docs(spark, d))


@query("shingle_counts", f"WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents) SELECT doc_id, CAST(CASE WHEN len(w) >= 5 THEN len(list_distinct({grams('w', 5)})) WHEN len(w) > 0 THEN 1 ELSE 0 END AS INTEGER) AS n_shingles FROM w")
def shingle_counts(spark, d):
    w = docs(spark, d).select("doc_id", text.words(F.coalesce("text", F.lit(""))).alias("w"))
    return w.select("doc_id", F.size(text.shingles(F.col("w"))).alias("n_shingles"))


@query("lsh_near_duplicates")
def lsh_near_duplicates(spark, d):
    """MinHash bands, exact confirmation (band seeds are ours: tested against brute force)."""
    return text.lsh_near_duplicates(docs(spark, d))


def _masked(c: str) -> str:
    for m in text.MASKS:
        c = f"regexp_replace({c}, '{q(m)}', ' ', 'g')"
    return c


@query("pii_hits")
def pii_hits(spark, d):
    """Identifiers under Unicode word rules, which the other engine's patterns lack (tested against Python's)."""
    return text.identifiers(docs(spark, d))


@query("pii_hits_folded", f"WITH m AS (SELECT doc_id, {_masked("regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g')")} AS m FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(m, '{q(p)}')) AS \"match\" FROM m" for k, p in text.IDENTIFIERS))
def pii_hits_folded(spark, d):
    """The same over texts whose other letters are folded to one, where both engines' word rules agree."""
    return text.identifiers(docs(spark, d).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "z")))


@query("pii_hits_pages", f"WITH m AS (SELECT page_id, {_masked("regexp_replace(html, '[^\\x00-\\x7F]', 'z', 'g')")} AS m FROM pages) " + " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, unnest(regexp_extract_all(m, '{q(p)}')) AS \"match\" FROM m" for k, p in text.IDENTIFIERS))
def pii_hits_pages(spark, d):
    return text.identifiers(spark.read.parquet(f"{d}/pages.parquet").withColumn("html", F.regexp_replace("html", r"[^\x00-\x7F]", "z")), "page_id", "html")


_PIECES = f"regexp_extract_all(text, '{q(text.PIECE)}')"


@query("heuristic_tokens", f"WITH p AS (SELECT doc_id, unnest({_PIECES}) AS p FROM documents), t AS (SELECT doc_id, CASE WHEN regexp_matches(p, '^[A-Za-z]') THEN greatest(1, CAST(round_even(length(p) / 3.5, 0) AS INTEGER)) WHEN regexp_matches(p, '^[0-9]') THEN CAST(ceil(length(p) / 3.0) AS INTEGER) ELSE 1 END AS n FROM p) SELECT d.doc_id, CAST(coalesce(sum(n), 0) AS INTEGER) AS n_tokens FROM documents d LEFT JOIN t USING (doc_id) WHERE d.text IS NOT NULL GROUP BY 1")
def heuristic_tokens(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", text.heuristic_tokens(F.col("text")).alias("n_tokens"))


@query("distinct_2", f"WITH w AS (SELECT lang, {WORDS.format('text')} AS w FROM documents), g AS (SELECT lang, unnest({grams('w', 2)}) AS g FROM w) SELECT lang, count(DISTINCT g) AS n_unique, count(*) AS n_total, count(DISTINCT g) / count(*) AS \"distinct\" FROM g GROUP BY 1")
def distinct_2(spark, d):
    return text.distinct_n(docs(spark, d), "lang", 2)


@query("distinct_3_conversations", f"WITH w AS (SELECT role, {WORDS.format('text')} AS w FROM conversations), g AS (SELECT role, unnest({grams('w', 3)}) AS g FROM w) SELECT role, count(DISTINCT g) AS n_unique, count(*) AS n_total, count(DISTINCT g) / count(*) AS \"distinct\" FROM g GROUP BY 1")
def distinct_3_conversations(spark, d):
    return text.distinct_n(spark.read.parquet(f"{d}/conversations.parquet"), "role", 3)


@query("type_token_ratio", f"WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_distinct(w)) AS INTEGER) AS n_types, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) END AS ttr FROM w")
def type_token_ratio(spark, d):
    return text.type_token_ratio(docs(spark, d))


@query("length_stats", "WITH k AS (SELECT source, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ')) END AS k FROM documents) SELECT source, count(*) AS n, avg(k) AS mean, round(stddev_pop(k), 6) AS std, CAST(min(k) AS INTEGER) AS least, CAST(max(k) AS INTEGER) AS most, quantile_cont(k, 0.5) AS median FROM k GROUP BY 1")
def length_stats(spark, d):
    return text.length_stats(docs(spark, d), "source")


_T = "regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '')"


@query("degeneracy_reasons", f"""WITH t AS (SELECT doc_id, {_T} AS t FROM documents), w AS (SELECT doc_id, t, {WORDS.format('t')} AS w, list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda p: NOT regexp_matches(p, '^\\s*$')) AS p FROM t),
 g AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest({grams('w', 5)}) AS g FROM w) GROUP BY 1, 2) GROUP BY 1)
SELECT w.doc_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(t, '{q(text.TERMINAL)}') THEN 'truncated' END, CASE WHEN coalesce(g.n, 0) >= 3 THEN 'repetitive' END, CASE WHEN len(p) < 4 THEN 'too_few_sections' END,
 CASE WHEN len(p) >= 4 AND len(list_filter(p, lambda x: len({WORDS.format('x')}) < 10)) > 0 THEN 'stub_section' END, CASE WHEN regexp_matches(t, '{q(text.MARKDOWN)}') OR regexp_matches(t, '{q(text.PREAMBLE)}') THEN 'preamble_or_markdown' END, CASE WHEN len(w) > 0 AND len(list_distinct(w)) / len(w) < 0.35 THEN 'low_lexical_variety' END], lambda x: x IS NOT NULL), ',') AS reasons FROM w LEFT JOIN g USING (doc_id)""")
def degeneracy_reasons(spark, d):
    return text.degeneracy(docs(spark, d))


@query("levenshtein_supplier_part", "SELECT p_partkey, p_type, p_brand, CASE WHEN greatest(length(p_type), length(p_brand)) = 0 THEN 0.0 ELSE levenshtein(p_type, p_brand) / greatest(length(p_type), length(p_brand)) END AS distance FROM part")
def levenshtein_supplier_part(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", "p_type", "p_brand", text.normalised_levenshtein(F.col("p_type"), F.col("p_brand")).alias("distance"))


@query("token_f1_turns", f"""WITH p AS (SELECT conv_id AS pair_id, a.text AS a, b.text AS b FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn = 0 AND b.turn = 1), x AS (SELECT pair_id, x, count(*) AS n FROM (SELECT pair_id, unnest({WORDS.format('a')}) AS x FROM p) GROUP BY 1, 2), y AS (SELECT pair_id, x, count(*) AS n FROM (SELECT pair_id, unnest({WORDS.format('b')}) AS x FROM p) GROUP BY 1, 2),
 c AS (SELECT pair_id, sum(least(x.n, y.n)) AS c FROM x JOIN y USING (pair_id, x) GROUP BY 1) SELECT pair_id, CASE WHEN len({WORDS.format('a')}) + len({WORDS.format('b')}) = 0 THEN 1.0 ELSE 2 * coalesce(c, 0) / (len({WORDS.format('a')}) + len({WORDS.format('b')})) END AS f1 FROM p LEFT JOIN c USING (pair_id)""")
def token_f1_turns(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    a, b = c.where("turn = 0").select(F.col("conv_id").alias("pair_id"), F.col("text").alias("a")), c.where("turn = 1").select(F.col("conv_id").alias("pair_id"), F.col("text").alias("b"))
    return text.token_f1(a.join(b, "pair_id"))


@query("self_bleu")
def self_bleu(spark, d):
    return text.self_bleu(docs(spark, d))


_PHRASES = [("licence", "licensed under"), ("licence", "licensed under the apache license"), ("legal", "all rights reserved"), ("legal", "copyright")]


@query("phrase_hits", "WITH p(phrase_group, phrase) AS (VALUES " + ", ".join(f"('{g}', '{x}')" for g, x in _PHRASES) + "), r AS (SELECT doc_id, phrase_group, phrase, row_number() OVER (PARTITION BY doc_id, phrase_group ORDER BY length(phrase) DESC, phrase) AS k FROM documents JOIN p ON contains(lower(text), phrase)) SELECT doc_id, phrase_group, phrase FROM r WHERE k = 1")
def phrase_hits(spark, d):
    return text.phrase_hits(docs(spark, d), spark.createDataFrame(_PHRASES, "phrase_group string, phrase string"))
