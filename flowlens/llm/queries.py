"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where it can be expressed."""

from __future__ import annotations

from flowlens.llm import (ann, collocations, cotrain, decontam, packing, ppm, secrets, simhash, spelling, substring, tokencount,
                          tokenfile, windowpack)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark, sf_dir):
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_simhash_near_duplicates(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_lm_scores(spark, sf_dir):
    return ppm.score_documents(_table(spark, sf_dir, "documents"), across=True)


def op5_token_file(spark, sf_dir):
    return tokenfile.token_digests(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark, sf_dir):
    return decontam.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_nearest_neighbours(spark, sf_dir):
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark, sf_dir):
    return cotrain.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_window_packing(spark, sf_dir):
    return windowpack.pack_windows(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return collocations.mine(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_substring_dedup, op3_simhash_near_duplicates, op4_lm_scores, op5_token_file, op6_token_counts,
    op7_benchmark_decontamination, op8_nearest_neighbours, op9_quality_classifier, op10_best_fit_packing, op11_window_packing,
    op12_spelling_variants, op13_collocations,
)}

#: SQL of the queries that it can express. The others hash with XXH64, encode, learn or search: tests hold them against brute
#: force, exact round trips or held-out rows.
ORACLES: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS g FROM w, unnest(range(1, len(words) - 33)) AS r(i)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS places FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM win SEMI JOIN again USING (g)) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(words) AS n, coalesce(len(places), 0) AS removed,
  CASE WHEN places IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(places, i)), lambda i: words[i]) END AS left_over
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_words, removed AS n_removed, sha256(coalesce(array_to_string(left_over, ' '), '')) AS kept_sha256 FROM kept""",
    "op7_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bi, unnest(range(1, len(w) - k + 2)) AS r(i)),
ks AS (SELECT DISTINCT k FROM bi),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN bs USING (k, g) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE n_shared >= 0.8 * n_item - 1e-9""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, x AS text FROM
  (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(text, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM w, range(1, 5) AS t(k), unnest(range(1, len(words) - k + 2)) AS r(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT lang, phrase, a, k AS size, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND a >= 30),
cut AS (SELECT c.lang, c.phrase, c.a, m AS cut_at, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM c, unnest(range(1, size)) AS t(m) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1 : m], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[m + 1 : size], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c b ON s.lang = b.lang AND b.size > s.size
  AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 80 * s.a),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM
 (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN inside USING (lang, phrase)) JOIN n USING (lang) WHERE rank <= 2000""",
}
