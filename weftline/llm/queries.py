"""The corpus operators applied to the driver's tables, with SQL equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import cotraining, fingerprints, hard_negatives, language_id, line_dedup, minhash_dedup, mixing, packing, quality_rules, spelling, substring_dedup, suffix_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicate_report(_table(spark, sf_dir, "documents"), width=4)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_report(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.negatives_report(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_fingerprints": op2_fingerprints,
        "op3_quality_classifier": op3_quality_classifier,
        "op8_language_id": op8_language_id,
        "op4_quality_rules": op4_quality_rules,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_mixing": op7_mixing,
        "op5_token_counts": op5_token_counts,
        "op10_packing": op10_packing,
        "op9_substring_dedup": op9_substring_dedup,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_line_dedup": op12_line_dedup,
        "op13_hard_negatives": op13_hard_negatives,
    }


_SQL2 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), CASE WHEN row_number() OVER (ORDER BY doc_id DESC) = count(*) OVER () THEN first_value(text) OVER (ORDER BY doc_id DESC) END, '') AS following
  FROM documents
), texts AS (
  SELECT doc_id, 'own' AS kind, text, CAST(length(text) AS BIGINT) AS n FROM docs
  UNION ALL SELECT doc_id, 'edited', left(text, length(text) - length(text) // 3) || left(following, length(text) // 3), NULL FROM docs
), points AS (
  SELECT doc_id, kind, CAST(unicode(unnest(ps)) AS BIGINT) AS c, unnest(range(len(ps))) AS pos, len(ps) AS n FROM (SELECT doc_id, kind, regexp_extract_all(text, '(?s).') AS ps FROM texts)
), rolled AS (
  SELECT doc_id, kind, pos, greatest(n - 7, 1) AS n, %(hash)s AS h FROM points WINDOW w AS (PARTITION BY doc_id, kind ORDER BY pos)
), windows AS (
  SELECT doc_id, kind, pos, n, min(h * 2147483648 + 2147483647 - pos) OVER (PARTITION BY doc_id, kind ORDER BY pos ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING) AS least FROM rolled WHERE pos < n
), chosen AS (
  SELECT DISTINCT doc_id, kind, least // 2147483648 AS h, 2147483647 - least % 2147483648 AS pos FROM windows WHERE pos <= greatest(n - 48, 0)
), prints AS (
  SELECT doc_id, kind, string_agg(printf('%X', h), ' ' ORDER BY pos) AS print, list_distinct(list(h)) AS hashes FROM chosen GROUP BY doc_id, kind
), all_docs AS (
  SELECT t.doc_id, t.n AS n_chars, sha256(e.text) AS edited_sha256, coalesce(p.print, '') AS fingerprint, coalesce(q.print, '') AS edited_fingerprint,
    coalesce(p.hashes, []) AS a, coalesce(q.hashes, []) AS b
  FROM texts t JOIN texts e ON e.doc_id = t.doc_id AND e.kind = 'edited'
  LEFT JOIN prints p ON p.doc_id = t.doc_id AND p.kind = 'own' LEFT JOIN prints q ON q.doc_id = t.doc_id AND q.kind = 'edited' WHERE t.kind = 'own'
), beside AS (
  SELECT *, coalesce(lead(a) OVER (ORDER BY doc_id DESC), first_value(a) OVER (ORDER BY doc_id DESC)) AS c FROM all_docs
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, c)) / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next
FROM beside
"""


def _sql2() -> str:
    rolled = "c"
    for k in range(1, fingerprints.GRAM):
        rolled = f"(({rolled}) * {fingerprints.BASE} + coalesce(lead(c, {k}) OVER w, 0)) % {fingerprints.PRIME}"
    return _SQL2.replace("%(hash)s", rolled)


_SQL1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p+3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM words WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), classes AS (
  SELECT min(doc_id) AS node, n, sig FROM (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS sig FROM shingles GROUP BY doc_id) GROUP BY n, sig
), held AS (
  SELECT node, n, s FROM classes JOIN shingles ON doc_id = node
), common AS (
  SELECT x.node AS a, y.node AS b, x.n AS na, y.n AS nb, count(*) AS meet FROM held x JOIN held y ON x.s = y.s AND x.node < y.node AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY ALL
), links AS (
  SELECT a, b FROM common WHERE 100 * meet >= 80 * (na + nb - meet)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT node AS a, node AS b FROM classes UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b
), roots AS (
  SELECT a AS node, min(b) AS root FROM reached GROUP BY a
), of_doc AS (
  SELECT g.doc_id, c.node FROM (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS sig FROM shingles GROUP BY doc_id) g JOIN classes c USING (n, sig)
)
SELECT w.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(root, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN of_doc USING (doc_id) LEFT JOIN roots USING (node)
"""


_SQL6 = r"""
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM raw
), strings AS (
  SELECT doc_id, p, md5_number(substring(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM sized WHERE n >= 100)
), firsts AS (
  SELECT k, min(doc_id * 4294967296 + p) AS least FROM strings GROUP BY k
), lost AS (
  SELECT doc_id, p FROM strings JOIN firsts USING (k) WHERE least < doc_id * 4294967296 + p
), heads AS (
  SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true) AS head FROM lost
), runs AS (
  SELECT doc_id, min(p) AS b, max(p) + 100 AS e FROM (SELECT doc_id, p, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM heads) GROUP BY doc_id, r
), gaps AS (
  SELECT doc_id, e AS b, coalesce(lead(b) OVER (PARTITION BY doc_id ORDER BY b), n) AS e FROM runs JOIN sized USING (doc_id)
  UNION ALL SELECT doc_id, 0, coalesce(min(b), any_value(n)) FROM sized LEFT JOIN runs USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * b + 1, 2 * (e - b)), '' ORDER BY b) AS h FROM gaps JOIN sized USING (doc_id) GROUP BY doc_id
), removed AS (
  SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM sized LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


_SQL9 = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(ws[p:p+12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM words)
), owners AS (
  SELECT k, min(doc_id) AS owner FROM windows GROUP BY k
), lost AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i
  FROM windows JOIN owners USING (k) WHERE owner < doc_id
), spans AS (
  SELECT l.doc_id, count(*) AS n_removed, count(*) FILTER (WHERE b.i IS NULL) AS n_spans
  FROM lost l LEFT JOIN lost b ON b.doc_id = l.doc_id AND b.i = l.i - 1 GROUP BY l.doc_id
), placed AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t
  FROM placed ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id
)
SELECT words.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


_SQL4 = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), windows AS (
  SELECT doc_id, p, ws[p:p+2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM words)
), repeated AS (
  SELECT doc_id, count(DISTINCT i) AS n FROM (
    SELECT doc_id, unnest(range(p, p + 3)) AS i FROM windows JOIN (SELECT doc_id, k FROM windows GROUP BY doc_id, k HAVING count(*) > 1) USING (doc_id, k)
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, text, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
), rests AS (
  SELECT *, regexp_replace(text, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+', '', 'g') AS r1 FROM base
), rests2 AS (
  SELECT *, regexp_replace(r1, '[\x20\x09-\x0D]+', '', 'g') AS r2 FROM rests
), rests3 AS (
  SELECT *, regexp_replace(r2, '\p{Lu}+', '', 'g') AS r3 FROM rests2
), rests4 AS (
  SELECT *, regexp_replace(r3, '[.,;:!?''"()\-]+', '', 'g') AS r4 FROM rests3
), rests5 AS (
  SELECT *, length(regexp_replace(r4, '\p{N}+', '', 'g')) AS r5 FROM rests4
), counted AS (
  SELECT doc_id, length(text) AS n, unnest([length(text) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4), length(r4) - r5, r5]) AS c,
    unnest(range(1, 7)) AS i FROM rests5
), class_sums AS (
  SELECT lang, i, sum(c) AS c FROM counted JOIN documents USING (doc_id) WHERE lang IS NOT NULL AND documents.text IS NOT NULL GROUP BY lang, i
), class_refs AS (
  SELECT lang, i, c / sum(c) OVER (PARTITION BY lang) AS q FROM class_sums
), class_distance AS (
  SELECT doc_id, min(d) AS d FROM (
    SELECT doc_id, lang, sqrt(greatest(sum(CASE WHEN c > 0 THEN c / n * log2(c / n / ((c / n + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((c / greatest(n, 1) + q) / 2)) ELSE 0 END) / 2, 0)) AS d
    FROM counted JOIN class_refs USING (i) GROUP BY doc_id, lang) GROUP BY doc_id
), lower_words AS (
  SELECT doc_id, lang, w, count(*) AS c FROM (SELECT words.doc_id, lang, lower(unnest(ws)) AS w FROM words JOIN documents USING (doc_id)) GROUP BY ALL
), lang_words AS (
  SELECT lang, w, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS n FROM lower_words WHERE lang IS NOT NULL GROUP BY lang, w
), word_refs AS (
  SELECT lang, w, c / n AS q FROM lang_words QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c DESC, w) <= %(top)s
), word_shares AS (
  SELECT b.doc_id, r.lang, coalesce(f.c, 0) / b.n_words AS p, r.q FROM base b CROSS JOIN word_refs r LEFT JOIN lower_words f ON f.doc_id = b.doc_id AND f.w = r.w WHERE b.n_words > 0
), with_rest AS (
  SELECT * FROM word_shares UNION ALL SELECT doc_id, lang, greatest(1 - sum(p), 0), greatest(1 - sum(q), 0) FROM word_shares GROUP BY doc_id, lang
), word_distance AS (
  SELECT doc_id, min(d) AS d FROM (
    SELECT doc_id, lang, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS d
    FROM with_rest GROUP BY doc_id, lang) GROUP BY doc_id
), judged AS (
  SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (length(text) < %(guard_chars)s OR c.d <= %(class_max)s) AND (n_words < %(guard_words)s OR w.d <= %(word_max)s) AS near
  FROM base LEFT JOIN class_distance c USING (doc_id) LEFT JOIN word_distance w USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND near) AS kept FROM judged
"""


def _sql4() -> str:
    q = quality_rules
    values = {"top": q.TOP_WORDS, "guard_chars": q.CLASS_GUARD_CHARS, "guard_words": q.WORD_GUARD_WORDS, "class_max": q.MAX_CLASS_DISTANCE, "word_max": q.MAX_WORD_DISTANCE}
    out = _SQL4
    for name, value in values.items():
        out = out.replace(f"%({name})s", str(value))
    return out


_SQL11 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), pairs AS (
  SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT doc_id, run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(bytes, '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda h, b: xor(h >> 8, crc[(xor(h, b) & 255) + 1]))) AS h FROM pairs, crc_table
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3
), keys AS (
  SELECT DISTINCT word, n, unnest(list_prepend(word, list_transform(range(length(word)), lambda i: left(word, i) || substring(word, i + 2)))) AS k FROM words
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM keys a JOIN keys b ON a.k = b.k AND a.word <> b.word
  WHERE length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1
), best AS (
  SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word, n
), forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * words.n THEN other END AS form, CASE WHEN other_n >= 2 * words.n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
), led AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT led.word, form FROM led JOIN forms ON forms.word = led.root WHERE form IS NOT NULL
), roots AS (
  SELECT led.word, led.root FROM led JOIN forms ON forms.word = led.root WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


_SQL12 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents
), keyed AS (
  SELECT doc_id, p, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k, true AS goes FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE goes IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (k) GROUP BY doc_id
"""


_SQL13 = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(list_transform(a.q, lambda x: x::DOUBLE), list_transform(r.q, lambda x: x::DOUBLE)) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": _SQL1, "op2_fingerprints": _sql2(), "op4_quality_rules": _sql4(), "op6_suffix_dedup": _SQL6, "op9_substring_dedup": _SQL9, "op11_spelling_variants": _SQL11, "op12_line_dedup": _SQL12, "op13_hard_negatives": _SQL13}
