"""The thin queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontam, divergence, exact, linetemplate, lm, minhash, packing, pii, quality, suffixarray, suffixtree, toxicity, variants
from quillmark.llm.storage import written

TOKENIZER = "byte_bpe_50k.json"
#: Session setting with the key of pseudonyms, and the key of test data where it is unset.
PII_KEY, TEST_KEY = "spark.quillmark.pii.key", "test data only"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(folds: int = 3, fold: int = 1) -> Column:
    """Rows that no classifier learns a label from."""
    return F.crc32(F.col("doc_id").cast("string")) % folds == fold


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["words"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixtree.substring_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(PII_KEY, TEST_KEY))
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.PATTERNS]
    return out.select("doc_id", "text", F.size("found").cast("bigint").alias("n_found"), *counts)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixarray.suffix_array_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_read(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_read(spark, sf_dir, "documents"), percent=85).drop("mark")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(_read(spark, sf_dir, "documents"))


def op9_line_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linetemplate.line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out()))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_read(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    stats = written(quality.statistics(docs))
    model = quality.fit(stats, labels.where(~held_out(5, 0)))
    scored = quality.score_statistics(stats, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_line_template_dedup": op9_line_template_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_source_divergence": op12_source_divergence,
    "op13_quality": op13_quality,
}

_OP6 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
hits AS (SELECT doc_id, item, dw.n, i FROM dw JOIN bw USING (win)),
words AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM d, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * inter >= 85 * (a.c + b.c - inter)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(c, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

_OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 49)) AS t(i)),
low AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS k FROM win JOIN low USING (h) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM d),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
piece AS (SELECT doc_id, c * 500 AS base, substring(x, c * 1000 + 1, 1798) AS y FROM d, unnest(generate_series(0, length(x) // 1000)) AS t(c)),
pos AS (SELECT doc_id, base + i AS p, md5(substring(y, 2 * i + 1, 800)) AS h FROM piece, unnest(generate_series(0, length(y) // 2 - 400)) AS t(i)),
again AS (SELECT h FROM pos GROUP BY h HAVING count(*) > 1),
dup AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM pos SEMI JOIN again USING (h)),
isle AS (SELECT doc_id, p, count(*) FILTER (gap IS NULL OR gap > 400) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM dup),
span AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM isle GROUP BY doc_id, g),
part AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM span
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), length(any_value(x)) // 2 FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substring(x, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS t FROM part JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS r, count(*) AS n FROM span GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

# crc32 byte by byte, with its table of remainders computed from the polynomial
_OP11 = f"""
WITH RECURSIVE rem(i, step, v) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM rem WHERE step < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM rem WHERE step = 8),
run AS (SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z' || chr(192) || '-' || chr(255) || ']+'))")} AS w FROM documents WHERE text IS NOT NULL),
one AS (SELECT doc_id, w, count(*) AS k, hex(encode(doc_id || ':' || w)) AS x FROM run GROUP BY doc_id, w),
h AS (
  SELECT w, k, xor(list_reduce(
    list_transform(range(length(x) // 2), lambda i: ('0x' || substring(x, 2 * i::BIGINT + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM one, tab),
seen AS (SELECT CASE WHEN h % 199 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
words AS (SELECT word, sum(k)::BIGINT AS n FROM seen WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM words, unnest(generate_series(1, length(word))) AS t(i)),
near AS (
  SELECT a.word AS x, b.word AS y, b.n AS n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON rest = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON rest = words.word),
best AS (SELECT x, count(*) AS n_near, min((-n, y)) AS b FROM near GROUP BY x),
found AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b[1] >= 5 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 5 * n THEN -b[1] END AS form_n
  FROM words LEFT JOIN best ON word = x),
walk AS (SELECT word, word AS last, 0 AS d FROM found UNION ALL SELECT walk.word, form, d + 1 FROM walk JOIN found ON walk.last = found.word WHERE form IS NOT NULL),
ends AS (SELECT word, arg_max(last, d) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM found JOIN ends USING (word)
"""

_OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
ln AS (SELECT lang, sum(c)::HUGEINT AS n, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (gn.n + v) AS p,
         1 + 1000000000::HUGEINT * (k.c + 1) // (ln.n + v) AS q
  FROM g JOIN k USING (lang) JOIN ln USING (lang) JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": _OP2,
    "op3_substring_dedup": _OP3,
    "op5_suffix_array_dedup": _OP5,
    "op6_exact_dedup": _OP6,
    "op7_minhash_near_dedup": _OP7,
    "op11_spelling_variants": _OP11,
    "op12_source_divergence": _OP12,
}
