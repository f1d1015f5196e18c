"""The queries of the operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, lm_score, near_dup, packing, quality_classifier, quality_rules, simhash, spelling, substring, topk, url_filter, vector_codes
from .common import table

#: Host, beginning of the path, verdict.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def held_out(id_col: str) -> Column:
    """Whether a document's label is kept from the classifier."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    ids = bpe.encoded(table(spark, sf_dir, "documents"), path, keep=["doc_id"], packed=True)
    ids = ids.select(F.struct("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256")).alias("about"), "ids")
    return bpe.decoded(ids, path, keep=["about"]).select("row.about.*", F.sha2("text", 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep=["doc_id"])
    return packing.packed(parts).select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.searched(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20).withColumnRenamed("id", "vec_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filtered(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("row.page_id", "host", "path", "rule", "verdict")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.linked(table(spark, sf_dir, "documents"), keep=["doc_id"], size=2, percent=80).select("row.doc_id", "n_shingles", "component_id", "kept")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    out = quality_classifier.scored(docs, docs, labels, "quality", keep=["doc_id"]).select("row.doc_id", "score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality_classifier.LEAST).cast("int").alias("predicted"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations")).select(F.col("conv").alias("conv_id"), F.col("nth_row").alias("turn"), "part", "role", "rendered")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("log_score", "mean_score")))


def lm_score_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8_lm_score, with n-grams of one and two words only."""
    out = lm_score.scored(table(spark, sf_dir, "documents"), keep=["doc_id"], order=2)
    return out.select("row.doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("log_score", "mean_score")))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.deduplicated(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    out = quality_rules.judged(table(spark, sf_dir, "documents"), good)
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "fingerprint", "component_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, codebooks = vector_codes.encoded(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    coded = vector_codes.with_label_error(rows.select("row.vec_id", F.lower(F.hex("code")).alias("code"), "error", "row.label"), "label")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_topk": op3_topk,
    "op4_url_filter": op4_url_filter,
    "op5_near_dup": op5_near_dup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_chat": op7_chat,
    "op8_lm_score": op8_lm_score,
    "lm_score_order2": lm_score_order2,
    "op9_substring": op9_substring,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling": op11_spelling,
    "op12_simhash": op12_simhash,
    "op13_vector_codes": op13_vector_codes,
}

#: The words of a text, in SQL.
_WORDS = "list_filter(string_split_regex(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"



def _nearest(k: int) -> str:
    """Each part's nearest entry of codebook k."""
    far = "CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT)"
    return f"a{k} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min(far) AS d, arg_min(e, far * 64 + e) AS e FROM (SELECT vec_id, label, x.p, x, e, {far} AS far FROM x JOIN b{k} USING (p)) GROUP BY vec_id, p)"


def _round(k: int) -> str:
    """Codebook k + 1 from codebook k."""
    return f"""{_nearest(k)},
        m{k} AS (SELECT p, e, list(CAST(floor(y) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, e, i, sum(y)::DOUBLE / count(*) AS y FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
        b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))"""


SQL: dict[str, str] = {
    "op3_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS p FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.p, c.p) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op4_url_filter": """
        WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
        u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
        rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
                     ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        m AS (SELECT u.*, rule_host || rule_path AS rule, rule_verdict, length(rule_host) AS host_length FROM u JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
        w AS (SELECT page_id, rule, rule_verdict FROM m
              QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, host_length DESC, rule_verdict DESC) = 1)
        SELECT u.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM u LEFT JOIN w USING (page_id)""",
    "op5_near_dup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) END AS shingles FROM d),
        c AS (SELECT shingles, len(shingles) AS n, min(doc_id) AS id FROM s WHERE len(shingles) > 0 GROUP BY shingles),
        p AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS sizes, len(list_intersect(a.shingles, b.shingles)) AS same FROM c a JOIN c b ON a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        e AS (SELECT a, b FROM p WHERE 100 * same >= 80 * (sizes - same)),
        r AS (SELECT id, id AS other FROM c UNION SELECT e.b, r.other FROM r JOIN e ON r.id = e.a),
        m AS (SELECT id, min(other) AS component FROM r GROUP BY id)
        SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, s.doc_id = coalesce(m.component, s.doc_id) AS kept
        FROM s LEFT JOIN c ON s.shingles = c.shingles LEFT JOIN m ON c.id = m.id""",
    "op8_lm_score": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS c, generate_subscripts(w, 1) AS k FROM d),
        g AS (SELECT doc_id, k, c, lag(c) OVER (PARTITION BY doc_id ORDER BY k) AS b, lag(c, 2) OVER (PARTITION BY doc_id ORDER BY k) AS a FROM t),
        one AS (SELECT c, count(*) AS n FROM g GROUP BY c), two AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
        three AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
        x AS (SELECT g.doc_id, CASE WHEN three.n >= 2 THEN ln(three.n::DOUBLE / h2.n) ELSE CASE WHEN g.a IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END +
                     CASE WHEN two.n >= 2 THEN ln(two.n::DOUBLE / h1.n) ELSE CASE WHEN g.b IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END + ln(one.n::DOUBLE / (SELECT count(*) FROM t)) END END AS score
              FROM g JOIN one USING (c) LEFT JOIN two ON two.b = g.b AND two.c = g.c LEFT JOIN one h1 ON h1.c = g.b
              LEFT JOIN three ON three.a = g.a AND three.b = g.b AND three.c = g.c LEFT JOIN two h2 ON h2.b = g.a AND h2.c = g.b)
        SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, round(coalesce(sum(x.score), 0), 6) AS log_score, round(sum(x.score) / len(any_value(d.w)), 6) AS mean_score
        FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id""",
    "lm_score_order2": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
        g AS (SELECT doc_id, k, word, lag(word) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM t),
        one AS (SELECT word, count(*) AS n FROM g GROUP BY word), two AS (SELECT before, word, count(*) AS n FROM g WHERE before IS NOT NULL GROUP BY before, word),
        x AS (SELECT g.doc_id, CASE WHEN two.n >= 2 THEN ln(two.n::DOUBLE / h.n) ELSE CASE WHEN g.before IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END + ln(one.n::DOUBLE / (SELECT count(*) FROM t)) END AS score
              FROM g JOIN one USING (word) LEFT JOIN two ON two.before = g.before AND two.word = g.word LEFT JOIN one h ON h.word = g.before)
        SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, round(coalesce(sum(x.score), 0), 6) AS log_score, round(sum(x.score) / len(any_value(d.w)), 6) AS mean_score
        FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id""",
    "op9_substring": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, w FROM d WHERE len(w) >= 13),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
        m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k FROM g JOIN m USING (s) WHERE doc_id > least),
        t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM t ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS removed FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_spelling": """
        WITH RECURSIVE steps AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)) AS crc),
        runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        each_run AS (SELECT doc_id, run, count(*) AS n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM runs GROUP BY doc_id, run),
        h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crc[CAST(xor(c, b::BIGINT) & 255 AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM each_run, steps),
        slip AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
        w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slip WHERE length(word) >= 7 GROUP BY word HAVING sum(slip.n) >= 2),
        cut AS MATERIALIZED (SELECT word, i, left(word, CAST(i AS INTEGER)) AS a, substr(word, CAST(i AS INTEGER) + 2) AS b FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
        less AS (SELECT DISTINCT cut.word AS long, w.word AS short FROM cut JOIN w ON w.word = cut.a || cut.b),
        near AS (SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word UNION ALL SELECT long, short FROM less UNION ALL SELECT short, long FROM less),
        best AS (SELECT near.word, count(*) AS n_near, arg_min(near.near, {'a': -w.n, 'b': near.near}) AS near, max(w.n) AS near_n FROM near JOIN w ON w.word = near.near GROUP BY near.word),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
        r AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
        top AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN top USING (word)""",
    "op13_vector_codes": f"""
        WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
                                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS MATERIALIZED (SELECT vec_id, label, CAST(p AS INTEGER) AS p, z[p * (len(z) // 16) + 1:(p + 1) * (len(z) // 16)] AS x FROM v, generate_series(0, 15) AS t(p)),
        b0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) AS INTEGER) - 1 AS e, x AS c FROM x QUALIFY e < 64),
        {", ".join(_round(k) for k in range(2))},
        {_nearest(2)}
        SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error, CAST(sum(sum(d)) OVER (PARTITION BY any_value(label)) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(y, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM b2)) AS codebooks_sha256 FROM a2 GROUP BY vec_id""",
}
