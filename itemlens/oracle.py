"""Independent SQL formulations of the registered queries (DuckDB dialect).

The label expressions are generated from the same rule tables the Spark
code folds into Columns, so a rule change moves both sides together; the
semantics (ordering, tie-breaks, NULL handling, rounding) are written out
in plain SQL.
"""

from __future__ import annotations

from itemlens.functions import rules as R
from itemlens.queries import (
    CONJ_CATEGORY,
    CONJ_LEVEL,
    CONJ_MIN_RATING,
    DEFAULT_AREA,
    DEFAULT_CATEGORY,
    FACTOR_K,
    FILTER_CATEGORY,
    FILTER_MIN_RATING,
    HOLDOUT_USERS,
    MIN_REVIEWS_FILTER,
    RULES,
    TOP_N,
)
from itemlens.sources import tables as TB

SEED = R.SEED


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rnd(expr: str, scale: int) -> str:
    return f"CAST(ROUND(TRY_CAST(({expr}) AS DECIMAL(38,12)), {scale}) AS DOUBLE)"


def text_or(expr: str, default: str) -> str:
    return f"COALESCE(NULLIF({expr}, ''), {lit(default)})"


def contains_sql(col: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN contains({col}, {lit(n)}) THEN {lit(v)}" for n, v in rules)
    return f"(CASE {whens} ELSE {lit(default)} END)"


def tokens_sql(col: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN {lit(k.lower())} THEN {lit(v)}" for k, v in rules)
    token = r"lower(regexp_replace(t, '^\s+|\s+$', '', 'g'))"
    mapped = f"list_transform(string_split({col}, ','), lambda t: CASE {token} {whens} END)"
    return f"COALESCE(list_filter({mapped}, lambda x: x IS NOT NULL)[1], {lit(default)})"


def area_sql(col: str, rules: R.AreaRules) -> str:
    d = f"regexp_extract({col}, {lit(rules.pattern)}, 1)"
    if rules.mode == "lpad2":
        return f"(CASE WHEN {d} <> '' THEN {lit(rules.prefix)} || lpad({d}, 2, '0') ELSE {lit(rules.default)} END)"
    s = rf"regexp_replace({d}, '^0+([0-9])', '\1')"
    pad = f"(CASE WHEN length({s}) < 2 THEN lpad({s}, 2, '0') ELSE {s} END)"
    named = " ".join(f"WHEN contains(lower({col}), {lit(a.lower())}) THEN {lit(a)}" for a in rules.named)
    return f"(CASE WHEN {d} <> '' THEN {lit(rules.prefix)} || {pad} {named} ELSE {lit(rules.default)} END)"


def level_sql(col: str, labels: dict[int, str], unknown: str = R.UNKNOWN_LEVEL) -> str:
    whens = " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in sorted(labels.items()))
    return f"(CASE {col} {whens} ELSE {lit(unknown)} END)"


def level_rank_sql(col: str, labels: dict[int, str]) -> str:
    whens = " ".join(f"WHEN {lit(v)} THEN {k}" for k, v in sorted(labels.items()))
    return f"(CASE {col} {whens} ELSE {max(labels) + 1} END)"


def bucket_sql(key: str, salt: str, buckets: int = 100) -> str:
    return f"(CAST(('0x' || substr(md5({lit(salt + ':')} || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % {buckets})"


def category_sql(col: str, rules: R.RuleSet = RULES) -> str:
    if rules.category_mode == "tokens":
        return tokens_sql(col, rules.token_rules, rules.default_category)
    return contains_sql(col, rules.contains_rules, rules.default_category)


# --- shared CTEs ---------------------------------------------------------------------

CAT_RAW = f"""
stats AS (SELECT l_partkey, COUNT(*) AS n_lines, SUM(l_quantity) AS qty_sum FROM lineitem GROUP BY l_partkey),
cat_raw AS (
  SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS item_key, p_name AS name, p_brand AS address,
         CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng,
         {rnd("qty_sum / n_lines / CAST(10 AS DOUBLE)", 1)} AS rating,
         CAST(n_lines AS INTEGER) AS total_ratings,
         CASE WHEN p_size >= 5 THEN CAST(FLOOR((p_retailprice - 900) / 20) AS INTEGER) END AS price_level,
         p_type || ', ' || replace(p_name, ' ', ', ') AS types,
         qty_sum AS activity_score
  FROM part LEFT JOIN stats ON p_partkey = l_partkey)"""

def cat_cte(rules: R.RuleSet) -> str:
    return (
        CAT_RAW
        + f""",
cat AS (
  SELECT CAST(row_number() OVER (ORDER BY item_key NULLS FIRST) AS INTEGER) AS item_id,
         item_key, name, address, lat, lng, rating, total_ratings, price_level, types, activity_score,
         {category_sql("types", rules)} AS category,
         {area_sql("address", rules.area)} AS area,
         {level_sql("price_level", rules.level_labels, rules.unknown_level)} AS level
  FROM cat_raw)"""
    )


CAT = cat_cte(RULES)

RATINGS = (
    CAT
    + f""",
inter AS (
  SELECT CAST(o_custkey AS INTEGER) AS user_id, 'P-' || CAST(l_partkey AS VARCHAR) AS item_key,
         l_quantity / CAST(10 AS DOUBLE) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pairs AS (SELECT user_id, item_key, AVG(value) AS v FROM inter GROUP BY user_id, item_key),
ratings AS (
  SELECT CAST(p.user_id AS INTEGER) AS user_id, c.item_id,
         {rnd("greatest(CAST(0.5 AS DOUBLE), least(CAST(5.0 AS DOUBLE), v))", 1)} AS rating
  FROM pairs p JOIN cat c ON p.item_key = c.item_key)"""
)

_PAIR = "CAST(user_id AS VARCHAR) || ':' || CAST(item_id AS VARCHAR)"

def split_cte(holdout: float) -> str:
    return (
        RATINGS
        + f""",
labelled AS (
  SELECT *, CASE WHEN {bucket_sql("user_id", f"{SEED}:user", 1_000_000)} < {int(round(holdout * 1_000_000))} THEN 'holdout'
                 WHEN {bucket_sql(_PAIR, str(SEED), 1_000_000)} < {int(round(R.TRAIN_FRACTION * 1_000_000))} THEN 'train'
                 ELSE 'test' END AS split
  FROM ratings),
train AS (SELECT user_id, item_id, rating FROM labelled WHERE split = 'train'),
test AS (SELECT user_id, item_id, rating FROM labelled WHERE split = 'test'),
users AS (SELECT DISTINCT CAST(c_custkey AS INTEGER) AS user_id FROM customer)"""
    )


SPLIT = split_cte(HOLDOUT_USERS)
SPLIT_ALL = split_cte(0.0)

_BASELINE = """,
mu AS (SELECT AVG(rating) AS mu FROM train),
ib AS (SELECT item_id, AVG(rating - (SELECT mu FROM mu)) AS b_item FROM train GROUP BY item_id),
ub AS (SELECT t.user_id, AVG(t.rating - (SELECT mu FROM mu) - ib.b_item) AS b_user
       FROM train t JOIN ib ON t.item_id = ib.item_id GROUP BY t.user_id),
pred AS (SELECT te.user_id, te.item_id, te.rating,
                (SELECT mu FROM mu) + COALESCE(ib.b_item, 0) + COALESCE(ub.b_user, 0) AS prediction
         FROM test te LEFT JOIN ib ON te.item_id = ib.item_id LEFT JOIN ub ON te.user_id = ub.user_id)"""
BASELINE = SPLIT + _BASELINE
BASELINE_ALL = SPLIT_ALL + _BASELINE


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def _meta(prefix: str = "") -> str:
    p = prefix
    return (
        f"{text_or(p + 'name', R.DEFAULT_NAME)} AS name, "
        f"{text_or(p + 'category', DEFAULT_CATEGORY)} AS category, "
        f"{text_or(p + 'area', DEFAULT_AREA)} AS area, "
        f"{text_or(p + 'level', R.UNKNOWN_LEVEL)} AS level"
    )


def _browse(order: str) -> str:
    proj = f"""
proj AS (
  SELECT item_key, {_meta()},
         {rnd("COALESCE(rating, 0.0)", 2)} AS rating,
         CAST(COALESCE(total_ratings, 0) AS INTEGER) AS total_ratings,
         {rnd("COALESCE(activity_score, 0.0)", 1)} AS activity_score
  FROM cat)"""
    return with_(
        CAT + "," + proj,
        f"""SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY {order}, item_key) AS INTEGER) AS rank, * FROM proj)
WHERE rank <= {R.BROWSE_DEFAULT_LIMIT}""",
    )


def _top_list(limit: int) -> str:
    return with_(
        CAT,
        f"""SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY rating DESC NULLS LAST, total_ratings DESC NULLS LAST, item_id) AS INTEGER) AS rank,
         item_id, {_meta()},
         COALESCE(rating, 0.0) AS rating, CAST(COALESCE(total_ratings, 0) AS INTEGER) AS total_ratings,
         COALESCE(activity_score, 0.0) AS activity_score, lat, lng
  FROM cat WHERE total_ratings >= {R.MIN_REVIEWS})
WHERE rank <= {limit}""",
    )


_FALLBACK = f"""
fallback AS (
  SELECT * FROM (
    SELECT CAST(row_number() OVER (ORDER BY COALESCE(rating, 0.0) DESC, COALESCE(total_ratings, 0) DESC, item_id) AS INTEGER) AS rank,
           item_id, {_meta()},
           {rnd("COALESCE(rating, 0.0)", 4)} AS predicted_rating,
           COALESCE(activity_score, 0.0) AS activity_score
    FROM cat)
  WHERE rank <= {TOP_N})"""

_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def oracle_sql() -> dict[str, str]:
    cat_cols = "item_key, name, address, lat, lng, rating, total_ratings, price_level, types, activity_score"
    q: dict[str, str] = {}
    # sources / sinks
    q["csv_scan_typed"] = with_(CAT_RAW, f"SELECT {cat_cols} FROM cat_raw")
    q["ratings_scan"] = with_(RATINGS, "SELECT user_id, item_id, rating FROM ratings")
    q["users_relation"] = "SELECT DISTINCT CAST(c_custkey AS INTEGER) AS user_id FROM customer"
    q["temp_view_scan"] = with_(CAT, "SELECT item_id, item_key, category, area, level FROM cat")
    q["json_artefact_roundtrip"] = _top_list(R.TOP_LIST_SIZE)
    q["top_list_array"] = _top_list(R.TOP_LIST_SIZE)
    q["csv_rejects"] = """WITH k AS (SELECT p_partkey, p_partkey % 7 = 0 OR p_partkey % 11 = 0 AS bad FROM part)
SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS item_key, (SELECT COUNT(*) FROM k WHERE bad) AS n_rejects,
  (SELECT COUNT(*) FROM k WHERE NOT bad) AS n_kept FROM k WHERE bad"""
    q["top_list_prefix"] = _top_list(R.TOP_LIST_READ_DEFAULT)
    # projections
    q["cast_tolerant"] = r"""SELECT event_id,
  TRY_CAST(trunc(TRY_CAST(regexp_extract(props, '"k":\s*([^,}]*)', 1) AS DOUBLE)) AS INTEGER) AS k_int,
  TRY_CAST(trunc(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS INTEGER) AS value_int,
  TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_double,
  TRY_CAST(trunc(TRY_CAST(event_type AS DOUBLE)) AS INTEGER) AS type_int
FROM events"""
    q["project_pruned"] = with_(CAT, "SELECT item_id, item_key, name, rating, total_ratings FROM cat")
    q["project_rename"] = with_(CAT, "SELECT item_key AS item_ref, name AS title, activity_score AS popularity FROM cat")
    q["null_defaults"] = """SELECT d.doc_id, COALESCE(NULLIF(d.lang, ''), 'unknown') AS lang,
  COALESCE(NULLIF(d.source, ''), 'unknown') AS source,
  COALESCE(l.quality, 0) AS quality, COALESCE(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
    q["rounded_projection"] = with_(
        CAT,
        f"""SELECT item_id, {rnd("COALESCE(rating, 0.0)", 2)} AS rating_2dp,
  {rnd("COALESCE(activity_score, 0.0)", 1)} AS activity_1dp,
  {rnd("activity_score / total_ratings", 4)} AS per_review_4dp
FROM cat""",
    )
    q["classify_contains"] = with_(
        CAT_RAW, f"SELECT item_key, {contains_sql('types', TB.PART_CONTAINS_RULES, DEFAULT_CATEGORY)} AS category FROM cat_raw"
    )
    q["classify_tokens"] = with_(
        CAT_RAW, f"SELECT item_key, {tokens_sql('types', TB.PART_TOKEN_RULES, DEFAULT_CATEGORY)} AS category FROM cat_raw"
    )
    q["area_lpad2"] = f"SELECT page_id, {area_sql('url', TB.PAGE_AREA_LPAD2)} AS area FROM pages"
    q["area_intpad_named"] = f"SELECT page_id, {area_sql('url', TB.PAGE_AREA_NAMED)} AS area FROM pages"
    q["level_label_serving"] = with_(
        CAT_RAW, f"SELECT item_key, price_level, {level_sql('price_level', R.LEVEL_LABELS_SERVING)} AS level FROM cat_raw"
    )
    q["level_label_artefact"] = with_(
        CAT_RAW, f"SELECT item_key, price_level, {level_sql('price_level', R.LEVEL_LABELS_ARTEFACT)} AS level FROM cat_raw"
    )
    q["output_contract"] = with_(
        CAT,
        f"""SELECT item_id AS rank, item_key, {_meta()},
  {rnd("COALESCE(rating, 0.0)", 2)} AS rating,
  CAST(COALESCE(total_ratings, 0) AS INTEGER) AS total_ratings,
  {rnd("COALESCE(activity_score, 0.0)", 1)} AS activity_score
FROM cat""",
    )
    base = "CASE WHEN rating IS NULL OR rating = 0 THEN CAST(3.0 AS DOUBLE) ELSE rating END"
    q["base_rating_default"] = with_(CAT, f"SELECT item_id, {base} AS base_rating FROM cat")
    # filters
    q["filter_equality"] = with_(CAT, f"SELECT item_id, category FROM cat WHERE category = {lit(FILTER_CATEGORY)}")
    q["filter_min_rating"] = with_(CAT, f"SELECT item_id, rating FROM cat WHERE rating >= {FILTER_MIN_RATING}")
    q["filter_conjunction"] = with_(
        CAT,
        f"""SELECT item_id, category, level, rating FROM cat
WHERE category = {lit(CONJ_CATEGORY)} AND level = {lit(CONJ_LEVEL)} AND rating >= {CONJ_MIN_RATING}""",
    )
    q["filter_clustered"] = q["filter_conjunction"]
    q["filter_min_reviews"] = with_(
        CAT, f"SELECT item_id, total_ratings FROM cat WHERE total_ratings >= {MIN_REVIEWS_FILTER}"
    )
    q["filter_specific_category"] = with_(
        CAT,
        f"""SELECT item_id, category, rating FROM cat
WHERE category <> {lit(DEFAULT_CATEGORY)} AND category IS NOT NULL AND rating IS NOT NULL""",
    )
    q["filter_scored_area"] = with_(
        CAT, "SELECT item_id, area, activity_score FROM cat WHERE area IS NOT NULL AND activity_score IS NOT NULL"
    )
    # joins
    q["enrich_left_join"] = with_(
        RATINGS,
        f"""SELECT r.user_id, r.item_id, r.rating, {_meta('c.')},
  COALESCE(c.activity_score, 0.0) AS activity_score
FROM ratings r LEFT JOIN cat c ON r.item_id = c.item_id""",
    )
    jb = f"""SELECT r.user_id, r.item_id, r.rating,
  CASE WHEN c.rating IS NULL OR c.rating = 0 THEN CAST(3.0 AS DOUBLE) ELSE c.rating END AS base_rating
FROM ratings r JOIN cat c ON r.item_id = c.item_id"""
    q["hot_item_enrich"] = with_(
        CAT,
        f"""SELECT l.l_orderkey, l.l_linenumber, l.item_key, c.item_id,
  CASE WHEN c.item_id IS NULL THEN NULL WHEN c.rating IS NULL OR c.rating = 0 THEN CAST(3.0 AS DOUBLE) ELSE c.rating END AS base_rating,
  {_meta('c.')}, COALESCE(c.activity_score, 0.0) AS activity_score
FROM (SELECT l_orderkey, l_linenumber,
        'P-' || CAST(CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_partkey END AS VARCHAR) AS item_key FROM lineitem) l
LEFT JOIN cat c ON l.item_key = c.item_key""",
    )
    q["join_base_rating"] = with_(RATINGS, jb)
    q["semi_known_users"] = with_(
        SPLIT, "SELECT user_id FROM users u WHERE EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id)"
    )
    q["anti_cold_users"] = with_(
        SPLIT, "SELECT user_id FROM users u WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id)"
    )
    q["factor_topk_per_user"] = f"""SELECT query_id, item_id, rank, {rnd("score", 4)} AS score FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_DOT} AS score,
         CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS INTEGER) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL)
WHERE rank <= {FACTOR_K}"""
    # aggregations
    q["trending_categories"] = with_(
        CAT,
        f"""SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY item_count DESC, avg_rating DESC NULLS LAST, category) AS INTEGER) AS rank, *
  FROM (SELECT category, COUNT(*) AS item_count, {rnd("AVG(rating)", 2)} AS avg_rating
        FROM cat WHERE category <> {lit(DEFAULT_CATEGORY)} AND category IS NOT NULL AND rating IS NOT NULL
        GROUP BY category))
WHERE rank <= {R.TRENDING_K}""",
    )
    q["busiest_areas"] = with_(
        CAT,
        f"""SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY avg_activity_score DESC NULLS LAST, area) AS INTEGER) AS rank, *
  FROM (SELECT area, COUNT(*) AS item_count, {rnd("AVG(activity_score)", 1)} AS avg_activity_score,
               {rnd("AVG(rating)", 2)} AS avg_rating
        FROM cat WHERE area IS NOT NULL AND activity_score IS NOT NULL GROUP BY area))
WHERE rank <= {R.TRENDING_K}""",
    )
    q["browse_total"] = with_(
        CAT, f"SELECT COUNT(*) AS total FROM cat WHERE category = {lit(CONJ_CATEGORY)} AND rating >= {CONJ_MIN_RATING}"
    )
    q["dedupe_by_key"] = """SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1"""
    q["catalog_dedupe"] = """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY total_ratings IS NULL, total_ratings DESC NULLS FIRST,
    name NULLS FIRST, address, types, rating, price_level, activity_score, lat, lng) AS rn
  FROM (SELECT CASE WHEN l_suppkey % 10 <> 0 THEN 'P-' || CAST(l_partkey AS VARCHAR) END AS item_key,
               CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS name, l_linestatus AS address,
               l_tax AS lat, l_discount AS lng, l_quantity / CAST(10 AS DOUBLE) AS rating,
               CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_linenumber % 2 AS INTEGER) END AS total_ratings,
               CAST(l_linenumber % 3 AS INTEGER) AS price_level, 'gizmo' AS types, l_extendedprice AS activity_score
        FROM lineitem))
WHERE rn = 1"""
    q["extend_ids"] = """WITH k AS (SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS user_key, o_orderstatus FROM orders),
old AS (SELECT user_key, row_number() OVER (ORDER BY user_key NULLS FIRST) AS user_id
        FROM (SELECT DISTINCT user_key FROM k WHERE o_orderstatus = 'O'))
SELECT user_key, CAST(user_id AS INTEGER) AS user_id FROM old
UNION ALL
SELECT user_key, CAST((SELECT MAX(user_id) FROM old) + row_number() OVER (ORDER BY user_key NULLS FIRST) AS INTEGER) AS user_id
FROM (SELECT DISTINCT user_key FROM k) n
WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_key IS NOT DISTINCT FROM n.user_key)"""
    q["id_registry"] = """WITH k AS (SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS user_key,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS version FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')),
firsts AS (SELECT user_key, MIN(version) AS since FROM k GROUP BY user_key)
SELECT user_key, CAST(since AS INTEGER) AS since,
  CAST(row_number() OVER (ORDER BY since, user_key NULLS FIRST) AS INTEGER) AS user_id FROM firsts"""
    q["rmse_bias_baseline"] = with_(
        BASELINE_ALL,
        f"""SELECT {rnd("sqrt(AVG(power(prediction - rating, 2)))", 4)} AS rmse, COUNT(*) AS n_scored
FROM pred WHERE prediction IS NOT NULL AND NOT isnan(prediction)""",
    )
    q["run_counts"] = with_(
        RATINGS,
        """SELECT COUNT(*) AS n_ratings, COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT item_id) AS n_items_rated,
  (SELECT COUNT(*) FROM cat) AS n_catalog FROM ratings""",
    )
    # windows / sorts / limits
    q["dense_ids"] = with_(CAT, "SELECT item_key, item_id FROM cat")
    q["sort_by_key"] = with_(
        RATINGS,
        """SELECT CAST(row_number() OVER (ORDER BY user_id NULLS FIRST, item_id NULLS FIRST) AS INTEGER) AS position,
  user_id, item_id FROM ratings""",
    )
    q["top_list_build"] = _top_list(R.TOP_LIST_SIZE)
    q["browse_by_rating"] = _browse("rating DESC NULLS LAST")
    q["browse_by_popularity"] = _browse("activity_score DESC NULLS LAST")
    q["browse_by_reviews"] = _browse("total_ratings DESC NULLS LAST")
    wanted = f"category = {lit(CONJ_CATEGORY)} AND rating >= {CONJ_MIN_RATING}"
    q["browse_page_total"] = with_(
        CAT,
        f"""SELECT t.total, p.* FROM (SELECT COUNT(*) AS total FROM cat WHERE {wanted}) t LEFT JOIN (
  SELECT CAST(row_number() OVER (ORDER BY total_ratings DESC, item_key) AS INTEGER) AS rank, * FROM (
    SELECT item_key, {_meta()}, {rnd("COALESCE(rating, 0.0)", 2)} AS rating,
      CAST(COALESCE(total_ratings, 0) AS INTEGER) AS total_ratings, {rnd("COALESCE(activity_score, 0.0)", 1)} AS activity_score
    FROM cat WHERE {wanted})
  QUALIFY rank <= {R.BROWSE_DEFAULT_LIMIT}) p ON true""",
    )
    q["browse_by_price"] = _browse(f"{level_rank_sql('level', RULES.level_labels)} ASC")
    q["cold_start_topn"] = with_(CAT + "," + _FALLBACK, "SELECT * FROM fallback")
    q["rerank_rounded"] = with_(
        BASELINE_ALL,
        f"""SELECT user_id, rank, item_id, {rnd("score", 4)} AS score FROM (
  SELECT user_id, item_id, prediction AS score,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY {rnd("prediction", 4)} DESC, {rnd("prediction", 10)} DESC, item_id) AS INTEGER) AS rank
  FROM pred)
WHERE rank <= {TOP_N}""",
    )
    # set operation
    q["warm_cold_union"] = with_(
        BASELINE
        + ","
        + _FALLBACK
        + f""",
trained AS (SELECT DISTINCT user_id FROM train),
best AS (SELECT item_id, b_item FROM ib ORDER BY {rnd("b_item", 10)} DESC, item_id LIMIT {TOP_N}),
warm_scores AS (
  SELECT u.user_id, b.item_id, (SELECT mu FROM mu) + b.b_item + ub.b_user AS score
  FROM users u JOIN ub ON u.user_id = ub.user_id CROSS JOIN best b),
warm AS (
  SELECT ws.user_id, false AS is_cold_start,
         CAST(row_number() OVER (PARTITION BY ws.user_id ORDER BY {rnd("ws.score", 4)} DESC, {rnd("ws.score", 10)} DESC, ws.item_id) AS INTEGER) AS rank,
         ws.item_id, {_meta('c.')}, {rnd("ws.score", 4)} AS predicted_rating,
         COALESCE(c.activity_score, 0.0) AS activity_score
  FROM warm_scores ws LEFT JOIN cat c ON ws.item_id = c.item_id),
cold AS (
  SELECT u.user_id, true AS is_cold_start, f.rank, f.item_id, f.name, f.category, f.area, f.level,
         f.predicted_rating, f.activity_score
  FROM users u CROSS JOIN fallback f
  WHERE NOT EXISTS (SELECT 1 FROM trained t WHERE t.user_id = u.user_id))""",
        f"""SELECT * FROM warm WHERE rank <= {TOP_N}
UNION ALL
SELECT * FROM cold""",
    )
    # ratings
    q["interaction_ratings"] = with_(RATINGS, "SELECT user_id, item_id, rating FROM ratings")
    lo, hi = R.RATINGS_PER_USER
    q["cap_per_user"] = with_(
        RATINGS,
        f"""SELECT user_id, item_id, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5({lit(f"{SEED}:cap:")} || {_PAIR}), item_id) AS rn
  FROM ratings)
WHERE rn <= {lo} + {bucket_sql("user_id", f"{SEED}:k", hi - lo + 1)}""",
    )
    q["bucketed_cap"] = q["cap_per_user"]
    q["user_offset"] = with_(
        RATINGS + f",\njb AS ({jb})",
        f"""SELECT user_id, {rnd("AVG(rating - base_rating)", 4)} AS user_offset, COUNT(*) AS n_ratings
FROM jb GROUP BY user_id""",
    )
    q["bucketed_offset"] = q["user_offset"]
    q["hash_split"] = with_(SPLIT, "SELECT user_id, item_id, split FROM labelled")
    q["prepare_catalog"] = with_(
        CAT,
        f"SELECT item_id, {cat_cols}, category, area, level FROM cat",
    )
    q["prepare_catalog_serving"] = with_(
        cat_cte(TB.PART_SERVING_RULES),
        f"SELECT item_id, {cat_cols}, category, area, level FROM cat",
    )
    # model: what the tables alone determine
    scored = """FROM test WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)"""
    q["als_fit_predict"] = with_(SPLIT_ALL, f"SELECT user_id, item_id, rating, true AS finite {scored}")
    q["als_eval"] = with_(SPLIT_ALL, f"SELECT COUNT(*) AS n_scored, true AS rmse_in_range {scored}")
    q["als_save_load"] = with_(SPLIT_ALL, "SELECT DISTINCT item_id, true AS same_factors, true AS nonnegative FROM train")
    ranks = f"(SELECT CAST(rank AS INTEGER) AS rank FROM range(1, {TOP_N} + 1) AS t(rank) WHERE rank <= (SELECT COUNT(DISTINCT item_id) FROM train))"
    warm = f"FROM users u, {ranks} WHERE u.user_id IN (SELECT user_id FROM train)"
    q["als_recommend_subset"] = with_(SPLIT, f"SELECT u.user_id, rank, true AS in_order, true AS has_item {warm}")
    empty = "NULL AS item_id, NULL AS name, NULL AS category, NULL AS area, NULL AS level, NULL AS predicted_rating, NULL AS activity_score"
    q["recommend_with_fallback"] = with_(
        SPLIT + "," + _FALLBACK,
        f"""SELECT u.user_id, false AS is_cold_start, rank, {empty} {warm}
UNION ALL
SELECT u.user_id, true AS is_cold_start, f.rank, f.item_id, f.name, f.category, f.area, f.level, f.predicted_rating, f.activity_score
FROM users u CROSS JOIN fallback f WHERE u.user_id NOT IN (SELECT user_id FROM train)""",
    )
    q["train_pipeline"] = with_(
        SPLIT_ALL,
        f"""SELECT (SELECT COUNT(*) {scored}) AS n_test_scored, (SELECT COUNT(*) FROM ratings) AS n_ratings,
  (SELECT COUNT(DISTINCT user_id) FROM ratings) AS n_users, (SELECT COUNT(DISTINCT item_id) FROM ratings) AS n_items""",
    )
    return q
