"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumspark.functions.text import snippet, source_refs, stated_counts, tokens, universal_wording
from vellumspark.operators import lexical, vectors
from vellumspark.plans.registry import query, table

TERMS = ["and", "erst", "the", "zu"]
_TOKS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))"
_TF = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(TERMS))
_DF = ", ".join(f"sum((tf{i} > 0)::INT)::DOUBLE AS df{i}" for i in range(len(TERMS)))
_PART = "CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.65::DOUBLE + 0.35::DOUBLE * len / mean)) ELSE 0::DOUBLE END"
_BASE = f"""
WITH bag AS (SELECT *, {_TOKS} AS toks FROM documents),
base AS (SELECT *, len(toks)::DOUBLE AS len, {_TF} FROM bag),
stats AS (SELECT count(*)::DOUBLE AS n, greatest(1::DOUBLE, avg(len)) AS mean, {_DF} FROM base)
"""
_MATCHED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN tf{i} > 0 THEN '{t}' END" for i, t in enumerate(TERMS)) + "], lambda x: x IS NOT NULL), ',')"
_LEXICAL = " + ".join(_PART.format(i=i) for i in range(len(TERMS)))


@query(f"""{_BASE}, scored AS (SELECT doc_id, round({_LEXICAL}, 5) AS score, {_MATCHED} AS matched FROM base, stats)
SELECT * FROM scored WHERE score <> 0 ORDER BY score DESC, doc_id LIMIT 50""")
def bm25_topk(spark, sf_dir):
    hits = lexical.bm25(table(spark, sf_dir, "documents"), TERMS, 50, id_col="doc_id")
    return hits.withColumn("matched", F.array_join("matched", ","))


_KIND = "CASE WHEN source IN ('src1', 'src2') THEN 'learning' WHEN source = 'src3' THEN 'project-doc' ELSE 'other' END"
_BOOST = " + ".join(f"({_PART.format(i=i)}) + CASE WHEN list_contains(ttoks, '{t}') THEN 2.0::DOUBLE WHEN list_contains(ptoks, '{t}') THEN 0.5::DOUBLE ELSE 0::DOUBLE END" for i, t in enumerate(TERMS))


#: Title, properties and text are tokenized as one text.
_WHOLE = _BASE.replace("FROM documents)", "FROM (SELECT * REPLACE (title || ' ' || props || ' ' || text AS text), text AS own FROM (SELECT *, split_part(text, ' ', 1) AS title, lang || ' ' || split_part(text, ' ', 2) AS props FROM documents)))", 1)


@query(f"""{_WHOLE}, extra AS (SELECT *, list_transform(regexp_extract_all(title, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS ttoks,
  list_transform(regexp_extract_all(props, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS ptoks, {_KIND} AS kind FROM base),
scored AS (SELECT doc_id, round(({_BOOST} + CASE WHEN contains(lower(text), 'of the') THEN 2.5::DOUBLE ELSE 0::DOUBLE END)
  * CASE kind WHEN 'project-doc' THEN 1.35::DOUBLE WHEN 'learning' THEN 1.25::DOUBLE ELSE 1::DOUBLE END, 5) AS score FROM extra, stats)
SELECT * FROM scored WHERE score <> 0 ORDER BY score DESC, doc_id LIMIT 50""")
def bm25_boosted(spark, sf_dir):
    kind = F.when(F.col("source").isin("src1", "src2"), "learning").when(F.col("source") == "src3", "project-doc").otherwise("other")
    title = F.split_part("text", F.lit(" "), F.lit(1))
    props = F.concat(F.col("lang"), F.lit(" "), F.split_part("text", F.lit(" "), F.lit(2)))
    return lexical.bm25(table(spark, sf_dir, "documents"), TERMS, 50, id_col="doc_id", title=title, properties=props, kind=kind, phrase="of the").select("doc_id", "score")


@query(f"SELECT doc_id, len(toks)::BIGINT AS n_tokens, len(list_distinct(toks))::BIGINT AS n_distinct FROM (SELECT doc_id, {_TOKS} AS toks FROM documents)")
def token_stats(spark, sf_dir):
    bag = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("toks"))
    return bag.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.size(F.array_distinct("toks")).cast("long").alias("n_distinct"))


@query(f"SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM (SELECT doc_id, unnest({_TOKS}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf_dir):
    return lexical.document_frequency(lexical.token_stats(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS start_line FROM documents"


@query(f"""WITH lines AS ({_LINES}), held AS (SELECT DISTINCT doc_id, start_line, unnest(list_transform(regexp_extract_all(body, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS term FROM lines),
hit AS (SELECT * FROM held WHERE term IN ('and', 'erst', 'the', 'zu')),
df AS (SELECT term, count(DISTINCT doc_id)::DOUBLE AS df FROM hit GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
scored AS (SELECT doc_id, start_line, round(sum(ln(1 + (n + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ORDER BY term), 5) AS score FROM hit JOIN df USING (term), n GROUP BY doc_id, start_line)
SELECT doc_id, start_line::BIGINT AS start_line, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start_line) AS r FROM scored) WHERE r = 1""")
def best_section(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sections = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "body")).select("doc_id", (F.col("p") + 1).cast("long").alias("start_line"), "body")
    n = docs.agg(F.count("*").cast("double").alias("n"))
    df = docs.select("doc_id", F.explode(F.array_distinct(F.filter(tokens("text"), lambda t: t.isin(TERMS)))).alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df"))
    return lexical.best_section(sections, TERMS, df.crossJoin(F.broadcast(n)), id_col="doc_id")


_FLAT = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')"


@query(f"""WITH f AS (SELECT doc_id, {_FLAT} AS flat FROM documents),
p AS (SELECT *, coalesce(list_min(list_filter([strpos(lower(flat), 'erst'), strpos(lower(flat), 'zu')], lambda x: x > 0)), 1) - 1 AS first FROM f),
s AS (SELECT *, greatest(0, first - 60) AS start FROM p)
SELECT doc_id, CASE WHEN start > 0 THEN '...' ELSE '' END || substr(flat, start + 1, 180) || CASE WHEN start + 180 < length(flat) THEN '...' ELSE '' END AS snippet FROM s""")
def snippet_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", snippet("text", F.array(F.lit("erst"), F.lit("zu"))).alias("snippet"))


_DOT = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5)"


def _queried(spark, sf_dir):
    all_ = table(spark, sf_dir, "embeddings")
    one = all_.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return all_.crossJoin(F.broadcast(one))  # one row


@query(f"SELECT e.vec_id, {_DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return vectors.top_vectors(_queried(spark, sf_dir), F.col("q"), 20, id_col="vec_id", vector_col="embedding")


@query(f"""WITH s AS (SELECT e.vec_id, e.label, {_DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) WHERE r = 1""")
def vector_best_per_group(spark, sf_dir):
    return vectors.top_vectors(_queried(spark, sf_dir), F.col("q"), 1_000_000, id_col="vec_id", vector_col="embedding", group_col="label").select("label", "vec_id", "score")


@query("""WITH c AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM c)
SELECT vec_id, round(v[1] / norm, 6) AS first, round(v[16] / norm, 6) AS last, 16::BIGINT AS dims FROM n WHERE norm >= 1e-12""")
def vector_truncate_normalize(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalized(F.col("embedding"), 16).alias("v")).where("v is not null")
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[15], 6).alias("last"), F.size("v").cast("long").alias("dims"))


@query(f"""{_BASE}, lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS lexical_rank FROM (SELECT doc_id, round({_LEXICAL}, 5) AS score FROM base, stats) WHERE score <> 0 ORDER BY score DESC, doc_id LIMIT 20),
sem AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS semantic_rank FROM (SELECT e.vec_id AS doc_id, {_DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, doc_id LIMIT 20))
SELECT doc_id, lexical_rank::BIGINT AS lexical_rank, semantic_rank::BIGINT AS semantic_rank,
round((coalesce(1::DOUBLE / (60::DOUBLE + lexical_rank), 0::DOUBLE) + coalesce(1::DOUBLE / (60::DOUBLE + semantic_rank), 0::DOUBLE)) * CASE WHEN doc_id % 3 = 0 THEN 1.1::DOUBLE ELSE 1::DOUBLE END, 6) AS score
FROM lex FULL JOIN sem USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_rrf(spark, sf_dir):
    lex = vectors.ranked(lexical.bm25(table(spark, sf_dir, "documents"), TERMS, max(vectors.DEPTH, 10), id_col="doc_id"), "doc_id")
    sem = vectors.top_vectors(_queried(spark, sf_dir), F.col("q"), max(vectors.DEPTH, 10), id_col="vec_id", vector_col="embedding").withColumnRenamed("vec_id", "doc_id")
    return vectors.fuse(lex, vectors.ranked(sem, "doc_id"), 10, id_col="doc_id", boosted=F.col("doc_id") % 3 == 0)


_CASES = "SELECT b.item_id AS case_id, d.doc_id AS id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.n_chars, d.doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@query(f"""WITH hits AS ({_CASES}), expected AS (SELECT case_id, min(id) AS id FROM hits GROUP BY case_id UNION ALL SELECT item_id, -1 FROM benchmark WHERE item_id % 5 = 0),
found AS (SELECT e.case_id, count(h.rank)::DOUBLE / count(*) AS recall, coalesce(1::DOUBLE / min(h.rank), 0::DOUBLE) AS reciprocal
  FROM expected e LEFT JOIN (SELECT * FROM hits WHERE rank <= 3) h USING (case_id, id) GROUP BY e.case_id)
SELECT count(*)::BIGINT AS cases, round(avg(recall), 6) AS mean_recall, round(avg(reciprocal), 6) AS mrr, sum((recall = 1)::INT)::BIGINT AS passed FROM found""")
def retrieval_eval_metrics(spark, sf_dir):
    from pyspark.sql import Window

    items = F.broadcast(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")))  # an evaluation suite
    held = table(spark, sf_dir, "documents").join(items, F.contains("text", F.col("passage")))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("n_chars", "doc_id")).cast("long")
    hits = held.select(F.col("item_id").alias("case_id"), F.col("doc_id").alias("id"), rank.alias("rank"))
    missing = table(spark, sf_dir, "benchmark").where("item_id % 5 = 0").select(F.col("item_id").alias("case_id"), F.lit(-1).cast("long").alias("id"))
    return vectors.retrieval_metrics(hits, hits.groupBy("case_id").agg(F.min("id").alias("id")).unionByName(missing), 3)


@query("SELECT doc_id, regexp_matches(text, '(?i)\\b(?:all|every|none|only|never|both)\\b') AS universal FROM documents")
def universal_wording_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", universal_wording("text").alias("universal"))


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct(['repo://r' || (c_custkey % 7) || '@h' || c_nationkey || '/src/' || lower(c_mktsegment)] || ['paper:p' || c_custkey])), ' ') AS refs, 'r' || (c_custkey % 7) AS repo, 'h' || c_nationkey AS head, 'src/' || lower(c_mktsegment) AS path FROM customer")
def source_reference_parts(spark, sf_dir):
    from vellumspark.functions.text import REPO_REF

    ref = F.concat(F.lit("repo://r"), F.col("c_custkey") % 7, F.lit("@h"), F.col("c_nationkey"), F.lit("/src/"), F.lower("c_mktsegment"))
    text = F.concat(F.lit("see `"), ref, F.lit("`, and (paper:p"), F.col("c_custkey"), F.lit(") too"))
    made = table(spark, sf_dir, "customer").select("c_custkey", source_refs(text).alias("refs"), ref.alias("ref"))
    return made.select("c_custkey", F.array_join("refs", " ").alias("refs"), *(F.regexp_extract("ref", REPO_REF, k + 1).alias(n) for k, n in enumerate(("repo", "head", "path"))))


@query("SELECT o_orderkey, (o_orderkey % 12 + 1)::BIGINT AS word_count, (o_orderkey % 50)::BIGINT AS digit_count FROM orders")
def stated_count_parse(spark, sf_dir):
    from vellumspark.functions.text import NUMBER_WORDS

    word = F.element_at(F.array(*(F.lit(w) for w in NUMBER_WORDS)), (F.col("o_orderkey") % 12 + 1).cast("int"))
    text = F.concat(F.initcap(word), F.lit(" solutions differ, of "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" methods"))
    counts = stated_counts(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", counts[0].alias("word_count"), counts[1].alias("digit_count"))


@query("SELECT sha256(text) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def dedupe_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"""SELECT doc_id || '::' || substr(sha256('["' || doc_id || '",["Document"],' || start_line || ']'), 1, 24) AS chunk_id, doc_id, start_line::BIGINT AS start_line, sha256(body) AS content_hash FROM ({_LINES}) WHERE trim(body) <> ''""")
def semantic_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "body")).where(F.trim("body") != "")
    line = (F.col("p") + 1).cast("long")
    key = F.concat(F.lit('["'), F.col("doc_id"), F.lit('",["Document"],'), line, F.lit("]"))
    return lines.select(F.concat(F.col("doc_id"), F.lit("::"), F.substring(F.sha2(key, 256), 1, 24)).alias("chunk_id"), "doc_id", line.alias("start_line"), F.sha2("body", 256).alias("content_hash"))
