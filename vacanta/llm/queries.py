"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    """Registers a query; `sql` is the DuckDB statement that gives the same rows."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def tokenizer(name: str = TOKENIZER) -> str:
    """A public tokenizer file, found the same way on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Documents linked by the Jaccard similarity of their sets of five words in a row, and the smallest doc_id each one reaches.
_JOINED = r"""
    WITH RECURSIVE lists AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lists),
    runs AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS s, lead(w, 4) OVER o IS NOT NULL AS whole FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    s AS (SELECT DISTINCT doc_id, md5(s) AS s FROM runs WHERE whole OR i = 1),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {similar} * (na.n + nb.n - common)),
    reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b FROM reached r JOIN links ON a = r.other)
    SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id{more} FROM reached LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """


def joined_sql(similar: int, more: str = "") -> str:
    return _JOINED.replace("{similar}", str(similar)).replace("{more}", more)


@query("op6_near_duplicates", joined_sql(75, ", min(other) = doc_id AS kept"))
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from vacanta.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf, "documents"))


@query("op7_token_shards")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from vacanta.llm.token_shards import read_shards, write_shards

    return read_shards(*write_shards(table(spark, sf, "documents"), tokenizer()))


@query("op10_token_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from vacanta.llm.token_counts import token_counts

    return token_counts(table(spark, sf, "documents"), tokenizer())


@query(
    "op2_line_dedup",
    r"""
    WITH parts AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM parts),
    frequent AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
    marked AS (SELECT doc_id, pos, line, coalesce(doc_id <> holder, false) AS gone FROM keyed LEFT JOIN frequent USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from vacanta.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf, "documents")).drop("kept_text")


@query(
    "op4_top_k",
    """
    WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS c FROM embeddings
               WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.c, d.c)]) AS BIGINT) AS score
          FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from vacanta.llm.maxscore import top_k

    return top_k(table(spark, sf, "embeddings"), "vec_id % 20 = 0")


@query(
    "op9_warc",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
    """,
)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from vacanta.llm.warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf, "pages")))


@query(
    "op3_mixing",
    r"""
    WITH base AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
    shares AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS held FROM base GROUP BY source),
    ends AS (SELECT max(held) AS largest, min(held) AS smallest FROM shares WHERE held > 0),
    e AS (SELECT *, CASE WHEN smallest = largest THEN 0 ELSE greatest(0, 1 - ln(2.0) / ln(largest / smallest)) END AS exponent FROM ends),
    plan AS (SELECT source, held, CASE WHEN held > 0 THEN CAST(floor(pow(held / CAST(largest AS DOUBLE), exponent - 1) * held + 0.5) AS BIGINT) ELSE 0 END AS wanted FROM shares, e),
    n AS (SELECT greatest(1, CAST(ceil(sum(wanted) / 1000000.0) AS BIGINT)) AS blocks FROM plan),
    readings AS (SELECT *, unnest(range(0, CASE WHEN held > 0 THEN greatest(CAST(ceil(wanted / held) AS BIGINT), 1) ELSE 1 END)) AS pass FROM base JOIN plan USING (source)),
    starts AS (SELECT *, pass * held + coalesce(sum(tokens) OVER (PARTITION BY source, pass ORDER BY md5(concat_ws(':', 17, pass, doc_id)), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM readings),
    taken AS (SELECT *, least(CAST(floor(CAST(start AS DOUBLE) / greatest(wanted, 1) * blocks) AS BIGINT), blocks - 1) AS block FROM starts, n WHERE start < wanted OR (tokens = 0 AND pass = 0))
    SELECT doc_id, source, tokens, pass, block, CAST(row_number() OVER (PARTITION BY block ORDER BY md5(concat_ws(':', 17, 'block', pass, doc_id)), pass, doc_id, source, tokens) AS INTEGER) AS place FROM taken
    """,
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from vacanta.llm.mixing import mix

    return mix(table(spark, sf, "documents"))


@query("op1_decontamination")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from vacanta.llm.tiling import contaminated

    found = contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max(F.size("tiles")).alias("n_tiles"))


@query("op8_language_model")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from vacanta.llm.hmm import language_model_scores

    return language_model_scores(table(spark, sf, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


@query("op5_toxicity")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from vacanta.llm.toxicity import learn, toxicity_scores

    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf, "documents")
    scored = toxicity_scores(docs, learn(docs, table(spark, sf, "labels").where(~held_out)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query(
    "op11_collocations",
    r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    numbered AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    words AS (SELECT lang, p, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM numbered),
    runs AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
    grams AS (SELECT lang, 1 AS k, w1 AS phrase FROM runs UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
              UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
    n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
    candidates AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
    inner_ones AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase, a FROM candidates, range(1, 4) AS s(i), range(2, 4) AS t(m) WHERE m < k AND i + m - 1 <= k),
    longer AS (SELECT lang, phrase, max(a) AS f FROM inner_ones GROUP BY ALL),
    kept AS (SELECT c.* FROM candidates c LEFT JOIN longer g USING (lang, phrase) WHERE g.f IS NULL OR 100 * g.f < 80 * c.a),
    cuts AS (SELECT *, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS one, array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS two FROM kept, range(1, 4) AS t(c) WHERE c < k),
    scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, c, CAST((CAST(2000000 AS HUGEINT) * cuts.a) // (x.a + y.a) AS BIGINT) AS score
               FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = one JOIN f y ON y.lang = cuts.lang AND y.phrase = two
               QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, c) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM scored JOIN n USING (lang) QUALIFY rank <= 2000
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from vacanta.llm.collocations import collocations

    return collocations(table(spark, sf, "documents"))


@query("op12_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from vacanta.llm.whitening import whiten

    return whiten(table(spark, sf, "embeddings"))


@query(
    "op13_ngram_join",
    joined_sql(80),
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from vacanta.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf, "documents"))
