"""BM25 retrieval over documents: statistics, boosts, best section, top-k.

Only the query's terms are counted, inside the scan; what leaves a scan is one
narrow row a document, so nothing is shuffled but the one-row statistics and
the top-k heaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import tokens

# Fixed values of the scoring formula.
K1, B, GAIN = 1.2, 0.35, 2.2
TITLE_BOOST, PROPERTY_BOOST, PHRASE_BONUS = 2.0, 0.5, 2.5
TYPE_BOOST = {"learning": 1.25, "project-doc": 1.35}


def token_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): occurrences of each term in each document."""
    return docs.select(id_col, F.explode(tokens(text_col)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequency(stats: DataFrame, id_col: str) -> DataFrame:
    """(term, df, cf): documents that hold a term and its occurrences in all."""
    return stats.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _times(bag: Column, term: str) -> Column:
    return F.size(F.filter(bag, lambda t: t == F.lit(term))).cast("double")


def _idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25(
    docs: DataFrame,
    terms: list[str],
    k: int = 10,
    *,
    id_col: str = "id",
    text_col: str = "text",
    title: Column | None = None,
    properties: Column | None = None,
    kind: Column | None = None,
    phrase: str | None = None,
) -> DataFrame:
    """The k best documents as (id, score, matched): descending score, then id.

    Terms are those of the query's token set; title, properties and body are one text.  A title hit adds 2.0 a term, else
    a property hit 0.5; the whole phrase in title, properties or body adds 2.5
    (and alone makes a hit); learning notes count 1.25, project documents 1.35
    times.  No terms or k < 1 give no rows.
    """
    terms = sorted(set(terms))
    if not terms or k < 1:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched")).limit(0)
    counts = [_times(F.col("bag"), w) for w in terms]
    none = F.lit(None).cast("string")
    bag = tokens(F.concat_ws(" ", *(c if c is not None else none for c in (title, properties)), F.col(text_col)))
    base = docs.select(F.col(id_col), bag.alias("bag"), *((c if c is not None else none).alias(n) for n, c in (("title", title), ("props", properties), ("kind", kind))), F.col(text_col).alias("body"))
    base = base.select(id_col, F.size("bag").cast("double").alias("len"), *(c.alias(f"tf{i}") for i, c in enumerate(counts)), *_extras(terms, phrase), "kind")
    stats = base.agg(F.count("*").cast("double").alias("n"), F.greatest(F.lit(1.0), F.avg("len")).alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))))
    both = base.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"tf{i}")
        part = _idf(F.col("n"), F.col(f"df{i}")) * tf * GAIN / (tf + K1 * ((1 - B) + B * F.col("len") / F.col("mean")))
        score = score + F.when(tf > 0, part).otherwise(0.0) + F.col(f"extra{i}")
    score = score + F.col("phrase_bonus")
    factor = F.lit(1.0)
    for name, times in TYPE_BOOST.items():
        factor = F.when(F.col("kind") == name, times).otherwise(factor)
    matched = F.filter(F.array(*(F.when(F.col(f"tf{i}") > 0, F.lit(w)) for i, w in enumerate(terms))), lambda t: t.isNotNull())
    return both.select(id_col, F.round(score * factor, 5).alias("score"), matched.alias("matched")).where("score <> 0").orderBy(F.desc("score"), id_col).limit(k)


def _extras(terms: list[str], phrase: str | None) -> list[Column]:
    title, props = tokens(F.coalesce("title", F.lit(""))), tokens(F.coalesce("props", F.lit("")))
    out = []
    for i, w in enumerate(terms):
        hit = F.when(F.array_contains(title, w), TITLE_BOOST).when(F.array_contains(props, w), PROPERTY_BOOST).otherwise(0.0)
        out.append(hit.alias(f"extra{i}"))
    whole = F.lower(F.concat_ws(" ", "title", "props", "body"))
    bonus = F.when(F.contains(whole, F.lit(phrase.lower())), PHRASE_BONUS).otherwise(0.0) if phrase else F.lit(0.0)
    return [*out, bonus.alias("phrase_bonus")]


def best_section(sections: DataFrame, terms: list[str], stats: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Of (id, start_line, body) sections, each document's best by its query terms.

    ``stats`` has term, df and n.  Here the idf lacks the -df of documents; ties
    go to the earliest line."""
    terms = sorted(set(terms))
    weights = F.broadcast(stats.where(F.col("term").isin(terms)).select("term", F.log(F.lit(1.0) + (F.col("n") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    held = sections.select(id_col, "start_line", F.explode(F.array_distinct(F.filter(tokens("body"), lambda t: t.isin(terms)))).alias("term"))
    scored = held.join(weights, "term").groupBy(id_col, "start_line").agg(F.round(F.sum("idf"), 5).alias("score"))
    return scored.groupBy(id_col).agg(F.max(F.struct("score", (-F.col("start_line")).alias("minus"))).alias("b")).select(id_col, (-F.col("b.minus")).alias("start_line"), F.col("b.score").alias("score"))
