"""Search over a stored inverted index of notes: one call from a query to hits with section and snippet.

``build_index`` writes, under one folder, notes (dealt to parts by path), postings (a note's, dealt to buckets by term; each
task writes its own file of a bucket, so that a frequent term does not make one task's work), the dictionary of terms, and one row of statistics.
Only the dictionary is shuffled.  A search reads only the buckets of its terms and, for the hits, the parts of their notes.

A query's whole text anywhere in a note adds a bonus, also inside longer words.  Notes that may hold it are found by the dictionary: of the
phrase's pieces the one whose possible terms have the fewest postings gives candidates, whose texts are then searched.

Many queries go through at once: their terms meet the postings in one join, and the best hits of each are kept by a
row number with a limit, which Spark applies in each task before it shuffles.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumspark.functions.batches import arrow_rows_udf, cuts
from vellumspark.functions.markdown import sections
from vellumspark.operators.lexical import GAIN, K1, PHRASE_BONUS, PROPERTY_BOOST, TITLE_BOOST, TYPE_BOOST, B
from vellumspark.tables import dropped, written

BUCKETS, SPLITS, GRAM = 16, 4, 3

_ASCII, _HAN = re.compile("[A-Za-z0-9_]+"), re.compile("[一-鿿]+")


def _han_pieces(text: str) -> list[str]:
    runs = _HAN.findall(text)
    return [c for run in runs for c in run] + [run[k : k + 2] for run in runs for k in range(len(run) - 1)]


def words(text: str) -> list[str]:
    """The tokens of :func:`vellumspark.functions.text.tokens` of one text."""
    return [w.lower() for w in _ASCII.findall(text)] + _han_pieces(text)


def lowered(text: str) -> str:
    """``text`` in lower case, character by character: as long as before, ß stays apart from ss."""
    return text.replace("İ", "i").replace("Σ", "σ").lower()


#: How an index folds whole texts for phrases.
FOLDS = {"casefold": str.casefold, "lower": lowered}


def phrase_pieces(phrase: str) -> list[tuple[str, str]]:
    """(kind, text): what the terms of a text that holds the folded phrase must show.  A word at an end of the phrase may be
    part of a longer one: the term ends with it, begins with it or, if it is all there is, holds it."""
    out = []
    for m in _ASCII.finditer(phrase):
        kind = {(True, True): "holds", (True, False): "ends", (False, True): "begins"}.get((m.start() == 0, m.end() == len(phrase)), "is")
        out.append((kind, m[0]))
    return out + [("is", piece) for piece in _han_pieces(phrase)]


def excerpt(text: str, terms: list[str], width: int = 180, lead: int = 60) -> str:
    """:func:`vellumspark.functions.text.snippet` of one text, with every kind of line end."""
    flat = " ".join(filter(None, map(str.strip, text.splitlines())))
    places = [at for at in (flat.lower().find(t.lower()) for t in terms) if at >= 0]
    start = max(min(places, default=0) - lead, 0)
    return "..." * (start > 0) + flat[start : start + width] + "..." * (start + width < len(flat))


# --------------------------------------------------------------------------
# Building

_TERM = "array<struct<term:string,tf:int,boost:double>>"
_NOTE = "path string, id string, kind string, learning_kind string, offset int, length int, head string, body string"
_ROW = f"{_NOTE}, terms array<struct<bucket:int,items:{_TERM}>>"
_ITEMS_ARROW = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32()), ("boost", pa.float64())]))
_ROW_ARROW = pa.schema(
    [(n, pa.string()) for n in ("path", "id", "kind", "learning_kind")]
    + [("offset", pa.int32()), ("length", pa.int32()), ("head", pa.string()), ("body", pa.string()), ("terms", pa.list_(pa.struct([("bucket", pa.int32()), ("items", _ITEMS_ARROW)])))]
)


_SCHEMAS = {
    "notes": f"{_ROW}, part int",
    "postings": f"path string, kind string, length int, items {_TERM}, bucket int",
    "terms": "term string, df long, postings long, bucket int",
}


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    table = spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}")
    return table.select("path", "kind", "length", F.inline("items"), "bucket") if name == "postings" else table


def note_terms(path: str, names: list[str], values: list[list[str]], lists: list[str], body: str, fold: str = "casefold") -> tuple[int, str, list[dict]]:
    """(number of tokens, title and properties as written out, terms) of a note; the terms are those of both and of its body.

    Terms that only the folded text has are kept for phrases, with a frequency of 0."""
    properties = dict(zip(names, values))
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    title = " ".join([stem.replace("-", " "), " ".join(properties.get("aliases") or [])])
    written_out = " ".join(str(list(v)) if name in lists else v[0] for name, v in properties.items())
    head = f"{title} {written_out}"
    text = f"{head} {body}"
    bag, folded = words(text), FOLDS[fold](text)
    counts, in_title, in_properties = Counter(bag), set(words(title)), set(words(written_out))
    terms = [{"term": t, "tf": n, "boost": TITLE_BOOST if t in in_title else PROPERTY_BOOST if t in in_properties else 0.0} for t, n in counts.items()]
    return len(bag), head, terms + [{"term": t, "tf": 0, "boost": 0.0} for t in set(words(folded)) - counts.keys()]


def _term_batches(buckets: int, fold: str):
    def run(batches):
        for batch in batches:
            for k, n in cuts(batch.columns):
                rows = []
                for r in batch.slice(k, n).to_pylist():
                    length, head, terms = note_terms(r["path"], r["names"] or [], r["values"] or [], r["lists"] or [], r["body"] or "", fold)
                    dealt = {}
                    for t in terms:
                        dealt.setdefault(zlib.crc32(t["term"].encode()) % buckets, []).append(t)
                    rows.append({**{n: r[n] for n in ("path", "id", "kind", "learning_kind", "offset")}, "length": length, "head": head, "body": r["body"] or "", "terms": [{"bucket": b, "items": dealt[b]} for b in sorted(dealt)]})
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW_ARROW)

    return run


def _bucket(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("binary")), F.lit(n)).cast("int")


def build_index(notes: DataFrame, path: str, buckets: int = BUCKETS, splits: int = SPLITS, fold: str = "casefold") -> SearchIndex:
    """Writes the index of :func:`vellumspark.sources.vault.notes` under ``path``; phrases are compared by ``fold``, one of :data:`FOLDS`.

    Choose ``buckets`` so that one bucket of the postings is what a query may read; a bucket of the dictionary has ``splits`` files at most."""
    spark = notes.sparkSession
    taken = notes.select("path", "id", F.col("note_type").alias("kind"), "learning_kind", F.col("body_line_offset").alias("offset"), F.map_keys("properties").alias("names"), F.map_values("properties").alias("values"), F.col("list_properties").alias("lists"), "body")
    # Each task deals its own rows to the parts and buckets; a note's terms stay in its row, from which the postings are read.
    rows = taken.mapInArrow(_term_batches(buckets, fold), _ROW)
    rows.withColumn("part", _bucket("path", buckets)).write.mode("overwrite").partitionBy("part").parquet(f"{path}/notes")
    stored = _stored(spark, path, "notes")
    stored.select("path", "kind", "length", F.inline("terms")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    terms = stored.select(F.explode("terms.items").alias("i")).select(F.inline("i")).groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.count("*").alias("postings"))
    terms.withColumn("bucket", _bucket("term", buckets)).repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(splits))).sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    stored.agg(F.count("*").alias("notes"), F.greatest(F.lit(1.0), F.coalesce(F.avg("length"), F.lit(0.0))).alias("mean"), F.lit(buckets).alias("buckets"), F.lit(fold).alias("fold")).write.mode("overwrite").parquet(f"{path}/stats")
    return SearchIndex(spark, path)


# --------------------------------------------------------------------------
# Searching

_ASKED = T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("phrase", T.StringType()), T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("piece", T.StringType())])))])


@F.pandas_udf(_ASKED)
def asked_udf(query: pd.Series, phrase: pd.Series, fold: pd.Series) -> pd.DataFrame:
    phrases = [FOLDS[f](p or "") for p, f in zip(phrase, fold)]
    return pd.DataFrame({"terms": [sorted(set(words(q or ""))) for q in query], "phrase": phrases, "pieces": [[{"kind": k, "piece": p} for k, p in phrase_pieces(x)] for x in phrases]})


_BEST = T.StructType(
    [
        T.StructField("snippet", T.StringType()),
        T.StructField("heading", T.StringType()),
        T.StructField("heading_path", T.ArrayType(T.StringType())),
        T.StructField("anchor", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
    ]
)


def best_part(body: str, offset: int, weights: dict[str, float]) -> dict:
    """The section whose words of the query weigh most, the first of equal ones, and its snippet."""
    parts = sections(body, offset)
    weight = lambda part: sum(sorted(weights[w] for w in set(words(part["body"])) & weights.keys()))
    best = max(parts, key=weight) if parts else None
    found = {name: best[name] if best else None for name in ("heading", "heading_path", "anchor", "start_line", "end_line")}
    return {"snippet": excerpt(best["body"] if best else body, sorted(weights)), **found}


best_part_udf = arrow_rows_udf(_BEST, lambda body, offset, terms, weights: best_part(body or "", int(offset or 0), dict(zip(terms, weights))), 4)


def _of_kind(kind: str):
    return lambda gram: F.struct(F.lit(kind).alias("wanted"), gram.alias("gram"))


holds_udf = arrow_rows_udf(T.BooleanType(), lambda head, body, phrase, fold: phrase in FOLDS[fold](f"{head} {body}"), 4)


@dataclass
class SearchIndex:
    """A stored index; ``spark`` reads it anew for each search."""

    spark: SparkSession
    path: str

    def _read(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """A table of the index; with ``keys`` (key) only the buckets that hold them, of which there are as many as the index has at most."""
        table = _stored(self.spark, self.path, name)
        if keys is None:
            return table
        column = "part" if name == "notes" else "bucket"
        met = [r[0] for r in keys.select(_bucket("key", self.stats()["buckets"])).distinct().collect()]
        return table.where(F.col(column).isin(met))

    def stats(self) -> dict:
        if not hasattr(self, "_stats"):
            self._stats = self.spark.read.parquet(f"{self.path}/stats").first().asDict()
        return self._stats

    def _asked(self, cases: DataFrame) -> DataFrame:
        """(case_id, terms, phrase, pieces); a query without a term asks for nothing.

        The whole text that is searched is the query without blanks at its ends, or ``phrase`` as it is where cases have one."""
        phrase = F.col("phrase") if "phrase" in cases.columns else F.regexp_replace("query", "(?U)^\\s+|\\s+\\z", "")
        return cases.select("case_id", asked_udf("query", phrase, F.lit(self.stats()["fold"])).alias("a")).select("case_id", "a.*").where(F.size("terms") > 0)

    def phrase_notes(self, asked: DataFrame) -> DataFrame:
        """(case_id, path, kind) of the notes that hold a query's whole text."""
        wanted, piece = F.col("p.kind"), F.col("p.piece")
        gram = F.when(wanted == "is", piece).when(wanted == "ends", F.right(piece, F.lit(GRAM))).otherwise(F.left(piece, F.lit(GRAM)))
        pieces = written(asked.select("case_id", F.posexplode("pieces").alias("at", "p")).select("case_id", "at", wanted.alias("wanted"), piece.alias("piece"), gram.alias("gram")), "pieces")
        fits = {"holds": F.contains("term", F.col("piece")), "ends": F.endswith("term", F.col("piece")), "begins": F.startswith("term", F.col("piece")), "is": F.col("term") == F.col("piece")}
        fit = F.lit(False)
        for kind, test in fits.items():
            fit = F.when(F.col("wanted") == kind, test).otherwise(fit)
        # The dictionary's terms by what a piece of a kind may be found with; only the kinds that are asked for.
        sizes, places = F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("term"))), F.sequence(F.lit(1), F.length("term"))
        shown = {"is": F.array("term"), "begins": F.transform(sizes, lambda k: F.left(F.col("term"), k)), "ends": F.transform(sizes, lambda k: F.right(F.col("term"), k))}
        shown["holds"] = F.array_distinct(F.flatten(F.transform(places, lambda at: F.transform(sizes, lambda k: F.substring("term", at, k)))))
        kinds = [r[0] for r in pieces.select("wanted").distinct().collect()]  # four at most
        keys = F.concat(*(F.transform(shown[kind], _of_kind(kind)) for kind in kinds)) if kinds else F.array().cast("array<struct<wanted:string,gram:string>>")
        grams = self._read("terms").select("term", "postings", F.inline(keys))
        met = written(grams.join(pieces, ["wanted", "gram"]).where(fit).select("case_id", "at", "term", "postings"), "piece-terms")
        counted = pieces.select("case_id", "at").join(met.groupBy("case_id", "at").agg(F.sum("postings").alias("postings")), ["case_id", "at"], "left")
        least = counted.groupBy("case_id").agg(F.min(F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "at")).alias("m")).select("case_id", "m.at")
        chosen = met.join(least, ["case_id", "at"], "left_semi").select("case_id", "term")
        postings = self._read("postings", chosen.select(F.col("term").alias("key"))).select("term", "path")
        candidates = written(chosen.join(postings, "term").select("case_id", "path").distinct(), "candidates")
        notes = self._read("notes", candidates.select(F.col("path").alias("key"))).select("path", "kind", "head", "body")
        held = candidates.join(asked.select("case_id", "phrase"), "case_id").join(notes, "path").where(holds_udf("head", "body", "phrase", F.lit(self.stats()["fold"])))
        found = written(held.select("case_id", "path", "kind"), "phrase-notes")
        dropped(pieces, met, candidates)
        return found

    def rank(self, cases: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The ``k`` best (case_id, path, score, matched, rank) of each (case_id, query), and (case_id, terms, weights) of the queries.

        Descending score, then path; a note is a hit by one of the terms or by the whole text."""
        n, mean = float(self.stats()["notes"]), float(self.stats()["mean"])
        asked = written(self._asked(cases), "asked")
        terms = asked.select("case_id", F.explode("terms").alias("term"))
        known = self._read("terms", terms.select(F.col("term").alias("key"))).select("term", "df")
        df = F.coalesce("df", F.lit(0)).cast("double")
        weighed = written(terms.join(known, "term", "left").select("case_id", "term", F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5)).alias("idf"), F.log(F.lit(1.0) + (n + 0.5) / (df + 0.5)).alias("weight")), "weights")
        postings = self._read("postings", terms.select(F.col("term").alias("key"))).where("tf > 0")
        tf = F.col("tf").cast("double")
        part = F.col("idf") * tf * GAIN / (tf + K1 * ((1 - B) + B * F.col("length") / mean)) + F.col("boost")
        factor = lambda kind: reduce(lambda f, x: F.when(kind == x[0], x[1]).otherwise(f), TYPE_BOOST.items(), F.lit(1.0))
        # Numbers alone go with each hit: its words are looked up for the best.
        hits = postings.join(weighed, "term").groupBy("case_id", "path").agg(F.sum(part).alias("sum"), F.max(factor(F.col("kind"))).alias("factor"))
        phrases = self.phrase_notes(asked)
        both = hits.join(phrases.select("case_id", "path", factor(F.col("kind")).alias("phrase_factor"), F.lit(PHRASE_BONUS).alias("bonus")), ["case_id", "path"], "full_outer")
        score = (F.coalesce("sum", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))) * F.coalesce("factor", "phrase_factor")
        scored = both.select("case_id", "path", F.round(score, 5).alias("score"), score.alias("raw")).where("raw <> 0").drop("raw")
        place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "path"))
        top = written(scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= k), "top")
        words_ = postings.join(top.select("path").distinct(), "path", "left_semi").select("path", "term").join(weighed.select("case_id", "term"), "term")
        matched = words_.join(top.select("case_id", "path"), ["case_id", "path"], "left_semi").groupBy("case_id", "path").agg(F.array_sort(F.collect_set("term")).alias("matched"))
        best = written(top.join(matched, ["case_id", "path"], "left").select("case_id", "path", "score", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), "rank"), "ranked")
        queries = written(weighed.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("w")).select("case_id", F.col("w.term").alias("terms"), F.col("w.weight").alias("weights")), "queries")
        dropped(asked, weighed, phrases, top)
        return best, queries

    def search_all(self, cases: DataFrame, k: int = 10) -> DataFrame:
        """The hits of each (case_id, query): id, path, type, score, matched terms, best section and snippet."""
        if k < 1:
            cases, k = cases.limit(0), 1
        best, queries = self.rank(cases, k)
        notes = self._read("notes", best.select(F.col("path").alias("key"))).select("path", "id", F.col("kind").alias("type"), "learning_kind", "offset", "body")
        held = best.join(queries, "case_id").join(notes, "path").withColumn("b", best_part_udf("body", "offset", "terms", "weights"))
        return held.select("case_id", "rank", "id", "path", "type", "learning_kind", "score", F.col("matched").alias("matched_terms"), "b.*")

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """The best hits of one query."""
        one = self.spark.createDataFrame([(0, query)], "case_id long, query string")
        return self.search_all(one, limit).drop("case_id").orderBy("rank")


# --------------------------------------------------------------------------
# Evaluation


def evaluate(hits: DataFrame, suite: DataFrame) -> DataFrame:
    """(case_id, recall, reciprocal_rank, missing_terms, passed) of each case, from :meth:`SearchIndex.search_all`.

    ``suite`` has (case_id, expected_ids, required_terms).  Required terms must stand, whatever their case, in the snippets of
    the expected hits.  A case without expected ids is an error."""
    if not suite.where("coalesce(size(expected_ids), 0) < 1").isEmpty():
        raise ValueError("expected_ids must not be empty")
    none = F.array().cast("array<string>")
    asked = suite.select("case_id", F.array_distinct("expected_ids").alias("expected"), F.coalesce("required_terms", none).alias("required"))
    met = asked.select("case_id", F.explode("expected").alias("id")).join(hits.select("case_id", "id", "rank", "snippet"), ["case_id", "id"])
    shown = met.groupBy("case_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "snippet"))).alias("s"))
    joined = asked.join(shown, "case_id", "left")
    text = F.array_join(F.transform(F.coalesce(F.col("s.snippet"), none), lambda s: F.concat(s, F.lit(" {}"))), "\n")
    rows = joined.withColumn("missing_terms", missing_terms_udf("required", text))
    found = F.coalesce("found", F.lit(0))
    return rows.select(
        "case_id",
        (found / F.size("expected")).alias("recall"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        "missing_terms",
        ((found == F.size("expected")) & (F.size("missing_terms") == 0)).alias("passed"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def missing_terms_udf(required: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([[t for t in r if t.casefold() not in x.casefold()] for r, x in zip(required, text)])


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row: case_count, passed, mean_recall_at_k, mrr_at_k."""
    return rows.agg(F.count("*").alias("case_count"), F.count_if("passed").alias("passed"), F.avg("recall").alias("mean_recall_at_k"), F.avg("reciprocal_rank").alias("mrr_at_k"))
