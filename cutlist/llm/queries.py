"""Queries of this subpackage's operators over the whole of their tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ego, gbt, langid, licenses, minhash, mixing, phrases, suffix, warc, wumanber


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residue(modulus: int):
    """crc32(doc_id as text) mod `modulus`."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those whose crc32 of the id mod 4 is not 2, by text and non-null lang.

    Null or letterless texts are `und` with score 0. Repeated rows are predicted each for itself and count each in training; ties
    go to the first language by name. No documents give no rows; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", residue(4) == 2)
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, keep=("doc_id", "held_out"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives as a WARC record and read back; see warc.write_archives for null html, urls and ids, ties and repeated rows.

    Payloads of any length are written whole; no pages give no rows.
    """
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok")


def op3_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word windows that occur twice; see phrases.dedup for nulls, short texts and repeated rows."""
    return phrases.dedup(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, component and whether it stays for every document; see minhash.near_duplicates for nulls, empty texts and repeated rows."""
    return minhash.public(minhash.near_duplicates(table(spark, sf_dir, "documents")))


def op5_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; see ego.epsilon_join for null, zero, non-finite and repeated vectors."""
    return ego.epsilon_join(table(spark, sf_dir, "embeddings"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier; see suffix.dedup for nulls, short texts and repeated rows."""
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; see mixing.pareto_mix for nulls, ties and repeated rows."""
    return mixing.pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, and their items; see wumanber.decontaminate for nulls and repeated items."""
    return wumanber.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from labels of ids whose crc32 mod 3 is not 1.

    Null text counts as empty and is scored too; repeated rows are scored alike; a score of 0.5 is predicted 1. No documents give no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", residue(3) == 1)
    trees = gbt.learn(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").where(residue(3) != 1))
    return gbt.score(docs, trees, keep=("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license that every document holds; see licenses.scan for nulls, ties and repeated rows."""
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_warc, op3_phrases, op4_minhash, op5_epsilon_grid, op6_mixing, op7_suffix_array, op8_decontamination, op9_quality, op10_licenses)}

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, url, strlen(html) AS n, sha1(html) AS h FROM p),
        g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS top FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
               CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top = page_id THEN NULL ELSE top END AS refers_to, url, true AS digest_ok
        FROM g""",
    "op3_phrases": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS p FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY p) AS n FROM win) WHERE n > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM rep),
        word AS (SELECT r, k, w[k] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
        kept AS (SELECT r, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, k) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "op4_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
               FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
        comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)""",
    "op5_epsilon_grid": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
               WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
        SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
        FROM v LEFT JOIN n USING (vec_id) JOIN comp USING (vec_id)""",
    "op7_suffix_array": """
        WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
        win AS (SELECT r, i, substr(x, 2 * i - 1, 200) AS p FROM (SELECT r, x, unnest(range(1, length(x) // 2 - 98)) AS i FROM d WHERE length(x) >= 200)),
        late AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY p ORDER BY r, i) AS k FROM win) WHERE k > 1),
        run AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM late),
        spans AS (SELECT r, min(i) AS s, max(i) + 100 AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM run) GROUP BY r, k),
        cut AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS from_ FROM spans),
        piece AS (SELECT r, from_ AS f, substr(x, 2 * from_ - 1, 2 * (s - from_)) AS t FROM cut JOIN d USING (r)
                  UNION ALL SELECT r, m AS f, substr(x, 2 * m - 1) AS t FROM (SELECT r, max(e) AS m FROM spans GROUP BY r) JOIN d USING (r)),
        kept AS (SELECT r, string_agg(t, '' ORDER BY f) AS t FROM piece GROUP BY r),
        n AS (SELECT r, sum(e - s) AS removed, count(*) AS spans FROM spans GROUP BY r)
        SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(t, x))) AS kept_sha256
        FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)""",
    "op6_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source, coalesce('s' || source, 'null') AS skey, coalesce(doc_id::VARCHAR, 'null ' || md5(coalesce(text, ''))) AS did,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                 (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null ' || md5(coalesce(text, ''))) || '|mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
          FROM documents),
        src AS (SELECT skey, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
        placed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM src),
        weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2 AS cap FROM placed),
        ranked AS (SELECT *, cap / weight AS ratio FROM weighed),
        levels AS (
          SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
          FROM ranked WINDOW w AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        lvl AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE cap > level * weight),
        plan AS (
          SELECT skey, source_size, target, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole,
                 CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS part
          FROM (SELECT s.*, least(cap::DOUBLE, coalesce(lvl.level * weight, cap::DOUBLE)) AS target FROM ranked s CROSS JOIN lvl)),
        need AS (SELECT *, target - whole * source_size AS need FROM plan),
        lens AS (SELECT skey, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY ALL),
        lefts AS (SELECT skey, size, need - coalesce(sum(size * n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "left",
                         sum(size::HUGEINT * size * n) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS squares
                  FROM lens JOIN need USING (skey) WHERE part > 0 WINDOW w AS (PARTITION BY skey ORDER BY size DESC)),
        pulls AS (SELECT skey, arg_max("left" / squares::DOUBLE, size) AS pull, arg_max("left", size) AS "left" FROM lefts WHERE "left" / squares::DOUBLE * size < 1 GROUP BY skey),
        f AS (SELECT d.*, p.source_size, target, whole, "left", coalesce(pull * size, 0) AS f FROM sized d JOIN need p USING (skey) LEFT JOIN pulls USING (skey)),
        q AS (SELECT *, CASE WHEN f > 0 AND f < 1 THEN u / (1 - u) * (1 - f) / f END AS q FROM f),
        r AS (SELECT *, coalesce(sum(size) FILTER (WHERE q IS NOT NULL) OVER (PARTITION BY skey ORDER BY q NULLS LAST, did, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM q)
        SELECT doc_id, size, source_size, target,
               ((whole + CASE WHEN f >= 1 OR (q IS NOT NULL AND ahead + size / 2.0 < "left") THEN 1 ELSE 0 END) * size)::BIGINT AS taken
        FROM r""",
    "op8_decontamination": r"""
        WITH lowered AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        dw AS (SELECT doc_id, r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
        bw AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        pat AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
                FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
        ms AS (SELECT DISTINCT m FROM pat),
        win AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS p
                FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw JOIN ms ON len(w) >= m)),
        hit AS (SELECT r, i, win.m, item_id FROM win JOIN pat USING (m, p)),
        n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r),
        it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN n USING (r) LEFT JOIN it USING (r)""",
}
