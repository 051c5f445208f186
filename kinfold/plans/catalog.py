"""All registered queries of the library over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import measures as m
from kinfold.functions import phonetics as p
from kinfold.functions import transforms as t
from kinfold.operators import candidates, classify, clustering, fusion
from kinfold.plans.pipeline import Deduplication, DuplicateDetection
from kinfold.plans.runtime import cut_lineage, ensure_checkpoint_dir, table
from kinfold.sources.tables import read_version
from kinfold.streaming.online import OnlineDetection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- similarity measures: every row of a table against the next --------------------------------------------

_PARTS = "SELECT a.p_partkey AS id, a.p_name AS l, b.p_name AS r, a.p_type AS lt, b.p_type AS rt FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"
_CUSTOMERS = "SELECT a.c_custkey AS id, a.c_name AS l, b.c_name AS r FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1"
_ORDERS = "SELECT a.o_orderkey AS id, a.o_totalprice AS l, b.o_totalprice AS r, a.o_orderdate AS ld, b.o_orderdate AS rd FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1"


def neighbours(spark: SparkSession, sf_dir: str, name: str, key: str, columns: dict[str, str]) -> DataFrame:
    """(id, l*, r*): each row of a table with the row of the next key."""
    rows = table(spark, sf_dir, name)
    a = rows.select(F.col(key).alias("id"), *[F.col(c).alias(f"l{s}") for s, c in columns.items()])
    b = rows.select((F.col(key) - 1).alias("id"), *[F.col(c).alias(f"r{s}") for s, c in columns.items()])
    return a.join(b, "id")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d, "part", "p_partkey", {"": "p_name", "t": "p_type"})


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d, "customer", "c_custkey", {"": "c_name"})


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(spark, d, "orders", "o_orderkey", {"": "o_totalprice", "d": "o_orderdate"})


def similarity(name: str, pairs: Query, measure: m.Measure, source: str, sql: str, left: str = "l", right: str = "r") -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return pairs(spark, d).select("id", F.round(measure(F.col(left), F.col(right)), 6).alias("similarity"))

    register(name, query, f"WITH p AS ({source}) SELECT id, round(CAST({sql} AS DOUBLE), 6) AS similarity FROM p")


LEV = "(1 - levenshtein(l, r) / CAST(greatest(length(l), length(r)) AS DOUBLE))"
CUT = "(CASE WHEN levenshtein(l, r) <= CAST(floor(greatest(length(l), length(r)) * (1 - {t}::DOUBLE)) AS INTEGER) THEN " + LEV + " ELSE 0 END)"
EQ = "CAST(l = r AS INTEGER)"
JW = "jaro_winkler_similarity(l, r)"
GRAMS = "(SELECT list(substr({c}, CAST(i AS BIGINT), {n})) FROM range(1, length({c}) - {n} + 2) x(i))"
SET_JACCARD = "(len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE))"
WL, WR = "string_split_regex(l, '\\s+')", "string_split_regex(r, '\\s+')"
_ONE_LEV = "(1 - levenshtein({x}, {y}) / CAST(greatest(length({x}), length({y})) AS DOUBLE))"
ELKAN = "(list_sum(list_transform(" + WL + ", lambda x: list_max(list_transform(" + WR + ", lambda y: " + _ONE_LEV.format(x="x", y="y") + ")))) / len(" + WL + "))"
PLACE = "((SELECT sum(" + _ONE_LEV.format(x=WL + "[i]", y=WR + "[i]") + ") FROM range(1, least(len(" + WL + "), len(" + WR + ")) + 1) z(i)) / len(" + WL + "))"
COSINE = (
    "(WITH a AS (SELECT unnest(" + WL + ") AS k), b AS (SELECT unnest(" + WR + ") AS k), c AS (SELECT k, count(*) AS n FROM a GROUP BY k), d AS (SELECT k, count(*) AS n FROM b GROUP BY k) "
    "SELECT coalesce((SELECT sum(c.n * d.n) FROM c JOIN d USING (k)), 0) / (sqrt((SELECT sum(n * n) FROM c)) * sqrt((SELECT sum(n * n) FROM d))))"
)

lev, jw, eq = m.levenshtein(), m.jaro_winkler(), m.equality()
similarity("sim_equality", _parts, eq, _PARTS, EQ)
similarity("sim_inequality", _parts, m.inequality(), _PARTS, f"1 - {EQ}")
similarity("sim_levenshtein", _parts, lev, _PARTS, LEV)
similarity("sim_levenshtein_cutoff", _customers, lev.cutoff(0.9), _CUSTOMERS, CUT.format(t=0.9))
similarity("sim_to_similarity", _parts, m.to_similarity(F.levenshtein), _PARTS, LEV)
similarity("sim_jaro_winkler", _customers, jw, _CUSTOMERS, JW)
similarity("sim_jaccard_bigram", _customers, m.jaccard().of(t.bigram()), _CUSTOMERS, SET_JACCARD.format(a=GRAMS.format(c="l", n=2), b=GRAMS.format(c="r", n=2)))
similarity("sim_jaccard_words", _parts, m.jaccard().of(t.words()), _PARTS, SET_JACCARD.format(a=WL, b=WR))
similarity("sim_cosine_words", _parts, m.cosine().of(t.words()), _PARTS, COSINE)
similarity("sim_monge_elkan", _parts, m.monge_elkan(lev).of(t.words()), _PARTS, ELKAN)
similarity("sim_position_wise", _parts, m.position_wise(lev).of(t.words()), _PARTS, PLACE)
similarity("sim_scaled_numeric", _orders, m.scaled_difference(99_991), _ORDERS, "greatest(0, 1 - abs(l - r) / 99991.0::DOUBLE)")
similarity("sim_scaled_days", _orders, m.scaled_difference(365, "DAY"), _ORDERS, "greatest(0, 1 - abs(date_sub('day', ld, rd)) / 365.0::DOUBLE)", "ld", "rd")
similarity("sim_max", _parts, m.max_(lev, eq), _PARTS, f"greatest({LEV}, {EQ})")
similarity("sim_min", _parts, m.min_(lev, eq), _PARTS, f"least({LEV}, {EQ})")
similarity("sim_mean", _parts, m.mean(lev, eq, m.unknown()), _PARTS, f"({LEV} + {EQ}) / 2")
similarity("sim_first", _parts, m.first(eq.unknown_if(lambda s: s == 0), lev), _PARTS, f"coalesce(nullif({EQ}, 0), {LEV})")
similarity("sim_last", _parts, m.last(lev, eq.unknown_if(lambda s: s == 0)), _PARTS, f"coalesce(nullif({EQ}, 0), {LEV})")
similarity("sim_generic_aggregate", _parts, m.aggregate(lambda s: s[0] * s[1], lambda s: s[0] * s[1], lev, lev), _PARTS, f"{LEV} * {LEV}")
similarity("mod_cutoff", _parts, lev.negate().cutoff(0.4), _PARTS, f"CASE WHEN 1 - {LEV} < 0.4 THEN 0 ELSE 1 - {LEV} END")
similarity("mod_scale_with_threshold", _parts, lev.scale_with_threshold(0.3), _PARTS, f"CASE WHEN {CUT.format(t=0.3)} > 0.3 THEN ({CUT.format(t=0.3)} - 0.3) / (1 - 0.3) ELSE 0 END")
similarity("mod_binarize", _parts, lev.binarize(), _PARTS, f"sign({LEV})")
similarity("mod_negate", _parts, lev.negate(), _PARTS, f"1 - {LEV}")
similarity("mod_unknown_if", _parts, lev.unknown_if(lambda s: s < 0.3), _PARTS, f"CASE WHEN {LEV} < 0.3 THEN NULL ELSE {LEV} END")
similarity("mod_unknown_if_zero", _parts, eq.unknown_if_zero(), _PARTS, f"CASE WHEN {EQ} <= 0 THEN NULL ELSE 1 END")


def _struct_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = neighbours(spark, d, "part", "p_partkey", {"": "p_name", "t": "p_type", "s": "p_size"})
    return x.select("id", F.struct(F.col("l").alias("name"), F.col("lt").alias("type"), F.col("ls").alias("size")).alias("l"), F.struct(F.col("r").alias("name"), F.col("rt").alias("type"), F.col("rs").alias("size")).alias("r"))


_STRUCT_SQL = "SELECT a.p_partkey AS id, a.p_name AS l, b.p_name AS r, a.p_type AS lt, b.p_type AS rt, a.p_size AS ls, b.p_size AS rs FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"
_WEIGHTED = m.weighted_average().add(2, "name", m.levenshtein()).add(1, "type", m.equality()).add(3, "size", m.scaled_difference(10).unknown_if(lambda s: s == 0))
_SIZE = "nullif(greatest(0, 1 - abs(ls - rs) / 10.0::DOUBLE), 0)"
WEIGHTED = f"((2 * {LEV} + CAST(lt = rt AS INTEGER) + coalesce(3 * {_SIZE}, 0)) / (3 + CASE WHEN {_SIZE} IS NULL THEN 0 ELSE 3 END))"
similarity("sim_weighted_average", _struct_pairs, _WEIGHTED, _STRUCT_SQL, WEIGHTED)
similarity("sim_weighted_aggregation", _struct_pairs, m.weighted_aggregation(lambda ws: F.greatest(*[w * s for w, s in ws])).add(2, "name", m.levenshtein()).add(1, "type", m.equality()), _STRUCT_SQL, f"greatest(2 * {LEV}, CAST(lt = rt AS INTEGER))")


def _cached(spark: SparkSession, d: str) -> DataFrame:
    return m.with_similarity(_customers(spark, d), m.jaro_winkler(), "l", "r", cache=True).select("id", F.round("similarity", 6).alias("similarity"))


register("sim_cached_jaro_winkler", _cached, f"WITH p AS ({_CUSTOMERS}) SELECT id, round({JW}, 6) AS similarity FROM p")


def _matching(matcher: str) -> Query:
    return lambda spark, d: _parts(spark, d).select("id", F.round(m.matching_similarity(matcher, m.levenshtein()).of(t.words())(F.col("l"), F.col("r")), 6).alias("similarity"))


# Names of two words each. Stability of the two matchings of a 2 x 2 table of scores can be written down.
_TABLE = f"WITH p AS ({_PARTS}), w AS (SELECT id, {WL} AS a, {WR} AS b FROM p), s AS (SELECT id, " + ", ".join(f"{_ONE_LEV.format(x=f'a[{i}]', y=f'b[{j}]')} AS s{i}{j}" for i in (1, 2) for j in (1, 2)) + " FROM w)"
# The left propose to the first of their best; who is asked changes only for a strictly better one.
_WEAK = """CASE WHEN (s12 > s11) <> (s22 > s21) THEN CASE WHEN s12 > s11 THEN s12 + s21 ELSE s11 + s22 END
    WHEN s12 > s11 THEN CASE WHEN s22 > s12 THEN s22 + s11 ELSE s12 + s21 END
    WHEN s21 > s11 THEN s21 + s12 ELSE s11 + s22 END"""
_BLOCKS = "(({x} > {y} AND {x} >= {z}) OR ({x} >= {y} AND {x} > {z}))"
# Without a strongly stable matching: one of the left likes both best and keeps one; or both like the same best, which drops both, and they go on to the other.
_STRONG = f"""CASE WHEN NOT {_BLOCKS.format(x='s12', y='s11', z='s22')} AND NOT {_BLOCKS.format(x='s21', y='s11', z='s22')} THEN s11 + s22
    WHEN NOT {_BLOCKS.format(x='s11', y='s12', z='s21')} AND NOT {_BLOCKS.format(x='s22', y='s12', z='s21')} THEN s12 + s21
    WHEN s11 = s21 AND s11 = greatest(s11, s12, s22) THEN CASE WHEN s12 = s22 THEN 0 ELSE greatest(s12, s22) END
    WHEN s12 = s22 AND s12 = greatest(s11, s12, s21) THEN CASE WHEN s11 = s21 THEN 0 ELSE greatest(s11, s21) END
    ELSE greatest(s11, s12, s21, s22) END"""
for _n, _m, _sql in (("sim_stable_matching", "weak", _WEAK), ("sim_strong_matching", "strong", _STRONG)):
    register(_n, _matching(_m), f"{_TABLE} SELECT id, round(CAST(({_sql}) / 2 AS DOUBLE), 6) AS similarity FROM s")

# --- transformations ---------------------------------------------------------------------------------------


def transformation(name: str, tf: t.Transform, sql: str | None, array: bool = False) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = tf(F.col("p_name"))
        return table(spark, d, "part").select("p_partkey", (F.array_join(out, "|") if array else out).alias("value"))

    register(name, query, sql and f"SELECT p_partkey, {sql} AS value FROM part")


transformation("tf_words", t.words(), "array_to_string(string_split_regex(p_name, '\\s+'), '|')", True)
transformation("tf_bigram", t.bigram(), f"coalesce(array_to_string({GRAMS.format(c='p_name', n=2)}, '|'), '')", True)
transformation("tf_trigram", t.trigram(), f"coalesce(array_to_string({GRAMS.format(c='p_name', n=3)}, '|'), '')", True)
transformation("tf_normalize_name", t.normalize_name(), "regexp_replace(regexp_replace(strip_accents(lower(p_name)), '\\(.*?\\)', '', 'g'), '[^0-9A-Za-z]', '', 'g')")
transformation("tf_compose", t.lower().and_then(t.transform(F.reverse)), "reverse(lower(p_name))")
_LETTERS = "regexp_replace(upper(p_name), '[^A-Z]', '', 'g')"


def _runs_once(text: str) -> str:
    """SQL for a list of the characters of a string, empty where one equals that before."""
    return f"list_transform(range(1, length({text}) + 1), lambda i: CASE WHEN i > 1 AND substr({text}, CAST(i AS BIGINT), 1) = substr({text}, CAST(i - 1 AS BIGINT), 1) THEN '' ELSE substr({text}, CAST(i AS BIGINT), 1) END)"


_COLOGNE = """CASE WHEN c IN ('A', 'E', 'I', 'J', 'O', 'U', 'Y') THEN '0' WHEN c = 'H' THEN '-' WHEN c = 'B' OR (c = 'P' AND n <> 'H') THEN '1' WHEN c IN ('D', 'T') THEN CASE WHEN n IN ('C', 'S', 'Z') THEN '8' ELSE '2' END
    WHEN c IN ('F', 'P', 'V', 'W') THEN '3' WHEN c IN ('G', 'K', 'Q') THEN '4' WHEN c = 'L' THEN '5' WHEN c IN ('M', 'N') THEN '6' WHEN c = 'R' THEN '7'
    WHEN c = 'X' THEN CASE WHEN b IN ('C', 'K', 'Q') THEN '8' ELSE '48' END
    WHEN c = 'C' AND n IN ('A', 'H', 'K', 'O', 'Q', 'U', 'X') AND b NOT IN ('S', 'Z') THEN '4' WHEN c = 'C' AND i = 1 AND n IN ('L', 'R') THEN '4' ELSE '8' END"""
_SOUNDEX_SQL = f"WITH l AS (SELECT p_partkey, {_LETTERS} AS w FROM part), c AS (SELECT p_partkey, w[1] AS f, translate(w[1] || regexp_replace(w[2:], '[HW]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{t.SOUNDEX_CLASSES}') AS k FROM l)"
register("tf_soundex", lambda spark, d: table(spark, d, "part").select("p_partkey", t.soundex()(F.col("p_name")).alias("value")), f"{_SOUNDEX_SQL} SELECT p_partkey, substr(f || replace(array_to_string({_runs_once('k')}[2:], ''), '0', '') || '000', 1, 4) AS value FROM c")
transformation("tf_refined_soundex", t.refined_soundex(), f"(SELECT w[1] || array_to_string({_runs_once('k')}, '') FROM (SELECT w, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{t.REFINED_CLASSES}') AS k FROM (SELECT {_LETTERS} AS w)))")
register(
    "tf_cologne_phonetic",
    lambda spark, d: table(spark, d, "part").select("p_partkey", p.cologne_phonetic()(F.col("p_name")).alias("value")),
    f"""WITH l AS (SELECT p_partkey, {_LETTERS} AS w FROM part), x AS (SELECT p_partkey, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] ELSE '' END AS b, w[i + 1] AS n FROM (SELECT p_partkey, w, unnest(range(1, length(w) + 1)) AS i FROM l)),
    k AS (SELECT p_partkey, string_agg({_COLOGNE}, '' ORDER BY i) AS k FROM x GROUP BY p_partkey), r AS (SELECT p_partkey, replace(array_to_string({_runs_once('k')}, ''), '-', '') AS k FROM k)
    SELECT p_partkey, k[1] || replace(k[2:], '0', '') AS value FROM r""",
)
transformation("tf_beider_morse", p.beider_morse(), None)  # rule tables are beyond SQL; tested against another encoder
register(
    "tf_iso_date_and_names",
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", t.iso_date()(F.col("o_orderdate")).alias("day"), t.concat_names("a", "b")(F.struct(F.col("o_orderstatus").alias("a"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("b"))).alias("names")),
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, concat_ws(' ', o_orderstatus, nullif(o_orderpriority, '5-LOW')) AS names FROM orders",
)

# --- candidates --------------------------------------------------------------------------------------------


def _offline_sql(key: str, id_: str, name: str, w: int) -> str:
    return f"SELECT greatest(a.i, b.i) AS left_id, least(a.i, b.i) AS right_id FROM (SELECT {id_} AS i, row_number() OVER (ORDER BY {key}, {id_}) AS n FROM {name}) a JOIN (SELECT {id_} AS i, row_number() OVER (ORDER BY {key}, {id_}) AS n FROM {name}) b ON b.n - a.n BETWEEN 1 AND {w - 1}"


def _online_sql(key: str, id_: str, name: str, w: int) -> str:
    one = "SELECT a.i AS left_id, b.i AS right_id, row_number() OVER (PARTITION BY a.i ORDER BY b.k {way}, b.i) AS n FROM r a JOIN r b ON b.i < a.i AND b.k {op} a.k"
    return f"SELECT left_id, right_id FROM (WITH r AS (SELECT {id_} AS i, {key} AS k FROM {name}) SELECT * FROM ({one.format(way='DESC', op='<=')}) UNION ALL SELECT * FROM ({one.format(way='ASC', op='>=')})) z WHERE n <= {w // 2}"


def _pairs_query(name: str, rows: str, id_: str, keys: list[candidates.SortingKey], w: int, online: bool) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, rows)
        if online:
            return candidates.online_sorted_neighborhood(df, keys, id_, id_, w)
        return candidates.sorted_neighborhood(df, keys, id_, w)

    return query


_K = candidates.sorting_key
register("snm_offline", _pairs_query("", "part", "p_partkey", [_K("name", "p_name")], 5, False), "SELECT DISTINCT * FROM (" + _offline_sql("p_name", "p_partkey", "part", 5) + ")")
register(
    "snm_multipass",
    _pairs_query("", "customer", "c_custkey", [_K("nation", "c_nationkey", "c_acctbal"), _K("segment", "c_mktsegment", "c_name")], 4, False),
    "SELECT DISTINCT * FROM (" + _offline_sql("c_nationkey, c_acctbal", "c_custkey", "customer", 4) + " UNION ALL " + _offline_sql("c_mktsegment, c_name", "c_custkey", "customer", 4) + ")",
)
register("snm_composite_key", _pairs_query("", "part", "p_partkey", [_K("brand", "p_brand").and_("p_type", "p_size")], 3, False), "SELECT DISTINCT * FROM (" + _offline_sql("p_brand, p_type, p_size", "p_partkey", "part", 3) + ")")
register("snm_online_exact", _pairs_query("", "part", "p_partkey", [_K("name", "p_name")], 6, True), "SELECT DISTINCT * FROM (" + _online_sql("p_name", "p_partkey", "part", 6) + ")")
register(
    "snm_online_multipass",
    _pairs_query("", "customer", "c_custkey", [_K("balance", "c_acctbal"), _K("segment", "c_mktsegment")], 4, True),
    "SELECT DISTINCT * FROM (" + _online_sql("c_acctbal", "c_custkey", "customer", 4) + " UNION ALL " + _online_sql("c_mktsegment", "c_custkey", "customer", 4) + ")",
)

# --- classification ----------------------------------------------------------------------------------------


def classification(name: str, rules: classify.RuleBasedClassifier, sql: str, handler: classify.Handler = classify.keep) -> None:
    """``sql`` gives (classification, confidence, explanation) of a row of the pairs as a struct expression."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        pairs = _struct_pairs(spark, d).withColumnsRenamed({"l": "left", "r": "right"})
        out = classify.handle_possible(rules.classify(pairs), handler)
        return out.select("id", F.col("result.classification").alias("classification"), F.round("result.confidence", 6).alias("confidence"), F.col("result.explanation").alias("explanation"))

    register(name, query, f"WITH p AS ({_STRUCT_SQL}), q AS (SELECT id, {sql} AS s FROM p) SELECT id, s.c AS classification, round(CAST(s.f AS DOUBLE), 6) AS confidence, s.e AS explanation FROM q")


_name = m.levenshtein().of("name")
_type = m.equality().of("type")
_R = "struct_pack(c := '{c}', f := CAST({f} AS DOUBLE), e := '{e}')"
_THRESHOLD = f"CASE WHEN {LEV} >= 0.5 THEN {_R.format(c='DUPLICATE', f=f'({LEV} - 0.5) / 0.5', e='default')} ELSE {_R.format(c='NON_DUPLICATE', f=f'(0.5 - {LEV}) / 0.5', e='default')} END"
classification("classify_threshold", classify.RuleBasedClassifier().default_rule(_name, 0.5), _THRESHOLD)
classification(
    "classify_rules",
    classify.RuleBasedClassifier().negative_rule("other type", _type.negate()).positive_rule("same name", m.equality().of("name")).default_rule(_name, 0.5),
    f"CASE WHEN lt <> rt THEN {_R.format(c='NON_DUPLICATE', f=1, e='other type')} WHEN l = r THEN {_R.format(c='DUPLICATE', f=1, e='same name')} ELSE {_THRESHOLD} END",
)
classification("classify_negative", classify.RuleBasedClassifier().negative_rule("size", m.scaled_difference(20).negate().of("size")), f"CASE WHEN 1 - greatest(0, 1 - abs(ls - rs) / 20.0::DOUBLE) > 0 THEN {_R.format(c='NON_DUPLICATE', f='1 - greatest(0, 1 - abs(ls - rs) / 20.0::DOUBLE)', e='size')} ELSE {_R.format(c='UNKNOWN', f=0, e='no rule')} END")
classification("classify_conditional", classify.RuleBasedClassifier().positive_rule("small", _name, lambda a, b: (a["size"] < 10) & (b["size"] < 10)), f"CASE WHEN ls < 10 AND rs < 10 AND {LEV} > 0 THEN {_R.format(c='DUPLICATE', f=LEV, e='small')} ELSE {_R.format(c='UNKNOWN', f=0, e='no rule')} END")
classification("classify_signed", classify.RuleBasedClassifier().rule("signed", m.Expression(lambda a, b: a - b).of("size")), f"CASE WHEN ls - rs <= 0 THEN {_R.format(c='NON_DUPLICATE', f='rs - ls', e='signed')} ELSE {_R.format(c='DUPLICATE', f='ls - rs', e='signed')} END")
_perhaps = classify.RuleBasedClassifier().positive_rule("same", _type).default_result(classify.POSSIBLE_DUPLICATE, 0.25, "perhaps")
for _n, _h, _c, _f, _e in (
    ("possible_keep", classify.keep, "POSSIBLE_DUPLICATE", 0.25, "perhaps"),
    ("possible_promote", classify.promote_to_duplicate, "DUPLICATE", 0, "possible duplicate promoted to duplicate"),
    ("possible_demote", classify.demote_to_non_duplicate, "NON_DUPLICATE", 0, "possible duplicate demoted to non-duplicate"),
    ("possible_unknown", classify.to_unknown, "UNKNOWN", 0, "possible duplicate is unknown"),
):
    classification(_n, _perhaps, f"CASE WHEN lt = rt THEN {_R.format(c='DUPLICATE', f=1, e='same')} ELSE {_R.format(c=_c, f=_f, e=_e)} END", _h)


def _oracle_classifier(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    pairs = candidates.sorted_neighborhood(parts, [_K("name", "p_name")], "p_partkey", 5)
    gold = neighbours(spark, d, "part", "p_partkey", {"": "p_name"}).where("l = r").select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    return classify.OracleClassifier(gold).classify(pairs).select("left_id", "right_id", F.col("result.classification").alias("classification"))


register(
    "classify_oracle",
    _oracle_classifier,
    "WITH c AS (SELECT DISTINCT * FROM (" + _offline_sql("p_name", "p_partkey", "part", 5) + f")), g AS (SELECT id FROM ({_PARTS}) x WHERE l = r) SELECT left_id, right_id, CASE WHEN left_id = right_id + 1 AND right_id IN (SELECT id FROM g) THEN 'DUPLICATE' ELSE 'NON_DUPLICATE' END AS classification FROM c",
)

# --- clustering --------------------------------------------------------------------------------------------


def _customer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Customers next to each other by balance within a nation, duplicates if the balances are within 5."""
    rows = table(spark, d, "customer")
    pairs = candidates.sorted_neighborhood(rows, [_K("balance", "c_nationkey", "c_acctbal")], "c_custkey", 3)
    joined = candidates.with_records(pairs, rows, "c_custkey", ["c_nationkey", "c_acctbal"])
    near = m.scaled_difference(5).of("c_acctbal")
    rules = classify.RuleBasedClassifier().negative_rule("nation", m.inequality().of("c_nationkey")).positive_rule("balance", near)
    return cut_lineage(rules.classify(joined).select("left_id", "right_id", "result"))


_EDGES_SQL = "SELECT c.left_id AS a, c.right_id AS b FROM (" + _offline_sql("c_nationkey, c_acctbal", "c_custkey", "customer", 3) + ") c JOIN customer x ON x.c_custkey = c.left_id JOIN customer y ON y.c_custkey = c.right_id WHERE x.c_nationkey = y.c_nationkey AND 1 - abs(x.c_acctbal - y.c_acctbal) / 5.0::DOUBLE > 0"


def closure_sql(edges: str) -> str:
    """(cluster_id, record_id) by recursive union over edges (a, b)."""
    return f"WITH RECURSIVE e0 AS ({edges}), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), r AS (SELECT a AS record_id, a AS reach FROM e UNION SELECT r.record_id, e.b FROM r JOIN e ON e.a = r.reach) SELECT min(reach) AS cluster_id, record_id FROM r GROUP BY record_id"


def _closure(spark: SparkSession, d: str) -> DataFrame:
    return clustering.transitive_closure(_customer_pairs(spark, d))


_CLOSURE = closure_sql(_EDGES_SQL)
register("transitive_closure", _closure, _CLOSURE)
register("cluster_sizes", lambda spark, d: clustering.nested(_closure(spark, d)).select("cluster_id", F.col("size").alias("n"), F.array_join("elements", ",").alias("records")), f"SELECT cluster_id, count(*) AS n, string_agg(CAST(record_id AS VARCHAR), ',' ORDER BY record_id) AS records FROM ({_CLOSURE}) GROUP BY cluster_id")
register("cluster_ids_prefix", lambda spark, d: clustering.numbered(_closure(spark, d), "c"), f"SELECT 'c' || (dense_rank() OVER (ORDER BY cluster_id) - 1) AS cluster_id, record_id FROM ({_CLOSURE})")
register("cluster_ids_number", lambda spark, d: clustering.numbered(_closure(spark, d)), f"SELECT dense_rank() OVER (ORDER BY cluster_id) - 1 AS cluster_id, record_id FROM ({_CLOSURE})")


def _consistent(spark: SparkSession, d: str) -> DataFrame:
    """The closures of customers, never splitting what shares an account balance."""
    rows = table(spark, d, "customer")
    before = rows.groupBy("c_acctbal").agg(F.min("c_custkey").alias("cluster_id"), F.collect_list("c_custkey").alias("ids")).where(F.size("ids") > 1).select("cluster_id", F.explode("ids").alias("record_id"))
    return clustering.consistent(_closure(spark, d), before)


register(
    "consistent_clustering",
    _consistent,
    closure_sql(f"SELECT cluster_id AS a, record_id AS b FROM ({_CLOSURE}) UNION ALL SELECT min(c_custkey) OVER (PARTITION BY c_acctbal), c_custkey FROM customer QUALIFY count(*) OVER (PARTITION BY c_acctbal) > 1"),
)


def _oracle_clusters(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster_id"), F.col("c_custkey").alias("record_id"))
    found = _customer_pairs(spark, d).where("result.classification = 'DUPLICATE'")
    return clustering.oracle_clustering(found, gold)


register("oracle_clustering", _oracle_clusters, f"WITH e AS ({_EDGES_SQL}), t AS (SELECT a AS i FROM e UNION SELECT b FROM e) SELECT c_nationkey AS cluster_id, c_custkey AS record_id FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer JOIN t ON t.i = c_custkey)")


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that differ from those of equal market segment within a balance."""
    now = _closure(spark, d)
    before = now.join(table(spark, d, "customer").select(F.col("c_custkey").alias("record_id"), "c_mktsegment"), "record_id").withColumn("cluster_id", F.when(F.col("c_mktsegment") == "BUILDING", F.col("cluster_id")).otherwise(F.col("record_id"))).select("cluster_id", "record_id")
    return clustering.changed_clusters(now, before)


register("changed_clusters", _changed, f"WITH n AS ({_CLOSURE}), b AS (SELECT n.record_id, n.cluster_id, CASE WHEN c_mktsegment = 'BUILDING' THEN cluster_id ELSE record_id END AS was FROM n JOIN customer ON c_custkey = record_id) SELECT cluster_id, record_id FROM n WHERE cluster_id IN (SELECT cluster_id FROM b WHERE was <> cluster_id)")


def _splits(spark: SparkSession, d: str) -> DataFrame:
    now = _closure(spark, d)
    before = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("cluster_id"), F.col("c_custkey").alias("record_id"))
    return clustering.split_events(now, before).select("old_id", F.size("parts").alias("n"), F.array_join("parts", ",").alias("parts"))


register("cluster_split_events", _splits, f"WITH p AS (SELECT CAST(c_nationkey AS BIGINT) AS old_id, cluster_id, count(*) AS n FROM ({_CLOSURE}) JOIN customer ON c_custkey = record_id GROUP BY c_nationkey, cluster_id) SELECT old_id, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY n DESC, cluster_id) AS parts FROM p GROUP BY old_id HAVING count(*) > 1")


def _refined(spark: SparkSession, d: str) -> DataFrame:
    """Closures of customers within a nation, refined by how near balances are."""
    rows = table(spark, d, "customer")
    near = m.scaled_difference(10).of("c_acctbal")
    rules = classify.RuleBasedClassifier().threshold_rule("balance", near, 0.5)

    def run(pairs: DataFrame) -> DataFrame:
        return rules.classify(candidates.with_records(pairs.select("left_id", "right_id"), rows, "c_custkey", ["c_nationkey", "c_acctbal"]))

    return clustering.refined_transitive_closure(_customer_pairs(spark, d), run)


register("refined_closure", _refined)

# --- fusion ------------------------------------------------------------------------------------------------

_E = "SELECT user_id, event_type AS v, value AS x, ts, event_id AS o, 's' || (event_id % 5) AS s, 1.0 + event_id % 3 AS w FROM events"


def _vals(spark: SparkSession, d: str, value: str | Column = "event_type") -> DataFrame:
    source, weight = F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")), 1.0 + F.col("event_id") % 3
    return fusion.group_values(table(spark, d, "events"), "user_id", value, ["event_id"], source, weight, "ts")


def fused_text(name: str, resolution: fusion.Resolution, where: str) -> None:
    """Entries left, and their values; ``where`` is a condition over windows of a user's events."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        left = _vals(spark, d).select("user_id", resolution.run(F.col("vals"), fusion.Context(F.col("user_id"))).alias("r"))
        each = F.array_join(F.array_sort(F.array_distinct(F.transform("r", lambda v: v["value"]))), ",")
        return left.select("user_id", F.size("r").alias("n"), each.alias("vals"))

    register(name, query, f"WITH e AS ({_E}), k AS (SELECT *, count(*) OVER (PARTITION BY user_id, v) AS f, sum(w) OVER (PARTITION BY user_id, v) AS g FROM e), z AS (SELECT * FROM k QUALIFY {where}) SELECT user_id, CAST(count(*) AS INTEGER) AS n, string_agg(DISTINCT v, ',' ORDER BY v) AS vals FROM z GROUP BY user_id")


_BY = "OVER (PARTITION BY user_id)"
fused_text("fuse_min", fusion.min_(), f"v = min(v) {_BY}")
fused_text("fuse_max", fusion.max_(), f"v = max(v) {_BY}")
fused_text("fuse_shortest", fusion.shortest(), f"length(v) = min(length(v)) {_BY}")
fused_text("fuse_longest", fusion.longest(), f"length(v) = max(length(v)) {_BY}")
fused_text("fuse_first", fusion.first(), f"o = min(o) {_BY}")
fused_text("fuse_last", fusion.last(), f"o = max(o) {_BY}")
fused_text("fuse_distinct", fusion.distinct(), "row_number() OVER (PARTITION BY user_id, v ORDER BY o) = 1")
fused_text("fuse_most_frequent", fusion.most_frequent(), f"f = max(f) {_BY}")
fused_text("fuse_vote", fusion.vote(), f"g = max(g) {_BY}")
fused_text("fuse_earliest", fusion.earliest(), f"ts = min(ts) {_BY}")
fused_text("fuse_latest", fusion.latest(), f"ts = max(ts) {_BY}")
_RANK = "CASE s WHEN 's3' THEN 1 WHEN 's1' THEN 2 ELSE 3 END"
fused_text("fuse_prefer_source", fusion.prefer_source("s3", "s1"), f"{_RANK} = min({_RANK}) {_BY}")


def _assume_equal(spark: SparkSession, d: str) -> DataFrame:
    """Per user and day, whether the events agree in their type: the value if so, else nothing and a message."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    rows = table(spark, d, "events").select(F.concat_ws(" ", "user_id", day).alias("k"), "event_id", "event_type")
    out = fusion.fuse(rows, "k", fusion.merge().field("event_type").with_(fusion.assume_equal_value()), arrival_col="event_id")
    return out.select("k", "fused.event_type", F.size("errors").alias("n_errors"))


register("fuse_assume_equal", _assume_equal, "SELECT user_id || ' ' || strftime(ts, '%Y-%m-%d') AS k, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS event_type, CAST(CASE WHEN count(DISTINCT event_type) > 1 THEN 1 ELSE 0 END AS INTEGER) AS n_errors FROM events GROUP BY ALL")
fused_text("fuse_chain_longest_vote", fusion.chain(fusion.longest(), fusion.vote()), f"length(v) = max(length(v)) {_BY} AND g = max(CASE WHEN length(v) = (SELECT max(length(event_type)) FROM events y WHERE y.user_id = k.user_id) THEN g END) {_BY}")
fused_text("fuse_transform", fusion.transform(F.upper), "f > 0 AND count(*) OVER () > 0")
ORACLES["fuse_transform"] = ORACLES["fuse_transform"].replace("string_agg(DISTINCT v", "string_agg(DISTINCT upper(v)").replace("ORDER BY v) AS vals", "ORDER BY upper(v)) AS vals")


def fused_number(name: str, resolution: fusion.Resolution, sql: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        left = _vals(spark, d, "value").select("user_id", resolution.run(F.col("vals"), fusion.Context(F.col("user_id"))).alias("r"))
        total = F.aggregate("r", F.lit(0.0), lambda a, v: a + v["value"])
        return left.select("user_id", F.round(total, 4).alias("value"))

    register(name, query, f"WITH e AS ({_E}) SELECT user_id, round({sql}, 4) AS value FROM e GROUP BY user_id")


fused_number("fuse_sum", fusion.sum_(), "sum(x)")
fused_number("fuse_mean", fusion.mean(), "avg(x)")
fused_number("fuse_median", fusion.median(), "CASE WHEN count(*) % 2 = 1 THEN median(x) ELSE 2 * median(x) END")


def _lists(union_all: bool) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        tags = F.array("event_type", F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")))
        r = fusion.union_all() if union_all else fusion.union()
        left = _vals(spark, d, tags).select("user_id", r.run(F.col("vals"), fusion.Context()).alias("r"))
        return left.select("user_id", F.array_join(F.array_sort(F.get("r", 0)["value"]), ",").alias("vals"))

    return query


_TAGS = f"WITH e AS ({_E}), z AS (SELECT user_id, v AS q FROM e UNION ALL SELECT user_id, s FROM e) SELECT user_id, string_agg({{d}}q, ',' ORDER BY q) AS vals FROM z GROUP BY user_id"
register("fuse_union", _lists(False), _TAGS.format(d="DISTINCT "))
register("fuse_union_all", _lists(True), _TAGS.format(d=""))


def _random(spark: SparkSession, d: str) -> DataFrame:
    return _vals(spark, d).select("user_id", F.get(fusion.random(1).run(F.col("vals"), fusion.Context(F.col("user_id"))), 0)["value"].alias("value"))


register("fuse_random", _random, f"WITH e AS ({_E}), v AS (SELECT user_id, list(v ORDER BY o) AS l FROM e GROUP BY user_id) SELECT user_id, l[CAST('0x' || substr(md5(user_id || '|1'), 1, 8) AS BIGINT) % len(l) + 1] AS value FROM v")


def _corresponding(spark: SparkSession, d: str) -> DataFrame:
    ctx = fusion.Context(F.col("user_id"))
    tagged = fusion.save_as(fusion.latest(), "newest").run(F.col("vals"), ctx)
    left = _vals(spark, d).select("user_id", F.size(tagged).alias("newest"), fusion.corresponding("newest").run(F.col("vals"), ctx).alias("r"))
    return left.select("user_id", "newest", F.size("r").alias("n"))


register("fuse_corresponding", _corresponding, f"WITH e AS ({_E}), t AS (SELECT user_id, s FROM e QUALIFY ts = max(ts) {_BY}) SELECT e.user_id, (SELECT CAST(count(*) AS INTEGER) FROM t WHERE t.user_id = e.user_id) AS newest, CAST(count(*) AS INTEGER) AS n FROM e WHERE e.s IN (SELECT s FROM t WHERE t.user_id = e.user_id) GROUP BY e.user_id")


def _merge(spark: SparkSession, d: str) -> DataFrame:
    """One record per user from all events."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts", F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")).alias("source"))
    f = fusion
    merging = f.merge().field("event_id").with_(f.max_()).field("event_type").with_(f.vote(), f.first()).field("value").with_(f.min_(), f.first()).field("ts").with_(f.latest()).field("source").with_(f.assume_equal_value())
    out = f.fuse(rows, "user_id", merging, "source", "ts", "event_id", {"s1": 2.0, "s2": 3.0})
    return out.select("user_id", "fused.event_id", "fused.event_type", "fused.value", "fused.ts", "fused.source", F.size("errors").alias("n_errors"), F.size("originals").alias("n_records"))


register(
    "fuse_merge",
    _merge,
    f"""WITH e AS ({_E}), w AS (SELECT user_id, v, sum(CASE s WHEN 's1' THEN 2.0 WHEN 's2' THEN 3.0 ELSE 1.0 END) AS g, min(o) AS o FROM e GROUP BY user_id, v),
    b AS (SELECT user_id, arg_min(v, o) AS v FROM (SELECT * FROM w QUALIFY g = max(g) {_BY}) GROUP BY user_id)
    SELECT e.user_id, max(o) AS event_id, any_value(b.v) AS event_type, min(x) AS value, max(ts) AS ts,
      CASE WHEN count(DISTINCT s) = 1 THEN any_value(s) END AS source, CAST(CASE WHEN count(DISTINCT s) > 1 THEN 1 ELSE 0 END AS INTEGER) AS n_errors, CAST(count(*) AS INTEGER) AS n_records
    FROM e JOIN b ON b.user_id = e.user_id GROUP BY e.user_id""",
)


def _hot(spark: SparkSession, d: str) -> DataFrame:
    """Few clusters of very many rows, by aggregates that combine before the shuffle."""
    rows = table(spark, d, "lineitem").withColumn("source", F.concat(F.lit("s"), (F.col("l_partkey") % 5).cast("string")))
    fields = {"cheapest": ("l_extendedprice", "min"), "n": ("l_quantity", "count"), "voted": ("l_linenumber", "vote"), "frequent": ("l_suppkey", "most_frequent"), "newest": ("l_orderkey", "latest"), "oldest": ("l_orderkey", "earliest"), "first_part": ("l_partkey", "first"), "last_part": ("l_partkey", "last"), "longest": ("l_linestatus", "longest")}
    return fusion.aggregate_fields(rows, "l_returnflag", fields, "source", "l_shipdate", "l_orderkey", {"s1": 2.0, "s2": 3.0})


register(
    "fuse_hot_clusters",
    _hot,
    """WITH e AS (SELECT *, CASE l_partkey % 5 WHEN 1 THEN 2.0 WHEN 2 THEN 3.0 ELSE 1.0 END AS w FROM lineitem),
    v AS (SELECT l_returnflag AS k, l_linenumber AS x FROM e GROUP BY l_returnflag, l_linenumber QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(w) DESC, l_linenumber) = 1),
    f AS (SELECT l_returnflag AS k, l_suppkey AS x FROM e GROUP BY l_returnflag, l_suppkey QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey) = 1),
    o AS (SELECT l_returnflag AS k, min(l_orderkey) AS x FROM (SELECT * FROM e QUALIFY l_shipdate = min(l_shipdate) OVER (PARTITION BY l_returnflag)) GROUP BY 1),
    n AS (SELECT l_returnflag AS k, min(l_orderkey) AS x FROM (SELECT * FROM e QUALIFY l_shipdate = max(l_shipdate) OVER (PARTITION BY l_returnflag)) GROUP BY 1),
    a AS (SELECT l_returnflag AS k, min(l_partkey) AS x FROM (SELECT * FROM e QUALIFY l_orderkey = min(l_orderkey) OVER (PARTITION BY l_returnflag)) GROUP BY 1),
    z AS (SELECT l_returnflag AS k, min(l_partkey) AS x FROM (SELECT * FROM e QUALIFY l_orderkey = max(l_orderkey) OVER (PARTITION BY l_returnflag)) GROUP BY 1)
    SELECT l_returnflag, min(l_extendedprice) AS cheapest, count(*) AS n, any_value(v.x) AS voted, any_value(f.x) AS frequent, any_value(n.x) AS newest, any_value(o.x) AS oldest, any_value(a.x) AS first_part, any_value(z.x) AS last_part, min(l_linestatus) AS longest
    FROM e JOIN v ON v.k = l_returnflag JOIN f ON f.k = l_returnflag JOIN o ON o.k = l_returnflag JOIN n ON n.k = l_returnflag JOIN a ON a.k = l_returnflag JOIN z ON z.k = l_returnflag GROUP BY l_returnflag""",
)

# --- whole pipelines ---------------------------------------------------------------------------------------


def document_deduplication() -> Deduplication:
    """Documents next to each other by text or reversed text within a language, alike in their words, one record per cluster."""
    text = F.col("text")
    keys = [_K("text", "lang", text), _K("end", "lang", F.reverse(text))]
    rules = classify.RuleBasedClassifier().default_rule(m.jaccard(distinct=True).of("words"), 0.8)

    def hashed(df: DataFrame) -> DataFrame:
        found = F.array_distinct(F.transform(t.words()(F.col("text")), lambda w: F.xxhash64(w)))
        return df.select("doc_id", found.alias("words")).withColumn("n", F.size("words"))

    # Sets of which one has less than 0.8 of the other's elements cannot share 0.8 of all.
    alike = (("n",), lambda a, b: F.least(a["n"], b["n"]) >= 0.8 * F.greatest(a["n"], b["n"]))
    detection = DuplicateDetection(lambda df: candidates.sorted_neighborhood(df, keys, "doc_id", 5), rules, "doc_id", ("words",), prepare=hashed, prune=alike)
    f = fusion
    merging = f.merge().field("doc_id").with_(f.min_()).field("text").with_(f.longest(), f.min_()).field("lang").with_(f.vote(), f.min_()).field("source").with_(f.vote(), f.min_()).field("n_chars").with_(f.max_())
    return Deduplication(detection, merging)


def _dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    out = document_deduplication().deduplicate(table(spark, d, "documents"))
    return out.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars", "n_records")


_DOC_W = "list_distinct(string_split_regex(text, '\\s+'))"
_DOC_PAIRS = _offline_sql("lang, text", "doc_id", "documents", 5) + " UNION " + _offline_sql("lang, reverse(text)", "doc_id", "documents", 5)
_DOC_EDGES = f"SELECT c.left_id AS a, c.right_id AS b FROM ({_DOC_PAIRS}) c JOIN w x ON x.doc_id = c.left_id JOIN w y ON y.doc_id = c.right_id WHERE len(list_intersect(x.s, y.s)) / CAST(len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)) AS DOUBLE) >= 0.8"
_DOC_CLUSTERS = closure_sql(_DOC_EDGES).replace("WITH RECURSIVE ", f"WITH RECURSIVE w AS (SELECT doc_id, {_DOC_W} AS s FROM documents), ")
register(
    "dedup_documents_e2e",
    _dedup_documents,
    f"""WITH c AS ({_DOC_CLUSTERS}), d AS (SELECT d.*, coalesce(c.cluster_id, d.doc_id) AS k FROM documents d LEFT JOIN c ON c.record_id = d.doc_id),
    t AS (SELECT k, min(text) AS text FROM (SELECT k, text FROM d QUALIFY length(text) = max(length(text)) OVER (PARTITION BY k)) GROUP BY k),
    l AS (SELECT k, min(lang) AS lang FROM (SELECT k, lang, count(*) AS n FROM d GROUP BY k, lang QUALIFY n = max(n) OVER (PARTITION BY k)) GROUP BY k),
    s AS (SELECT k, min(source) AS source FROM (SELECT k, source, count(*) AS n FROM d GROUP BY k, source QUALIFY n = max(n) OVER (PARTITION BY k)) GROUP BY k)
    SELECT min(d.doc_id) AS doc_id, md5(any_value(t.text)) AS text_md5, any_value(l.lang) AS lang, any_value(s.source) AS source, max(n_chars) AS n_chars, CAST(count(*) AS INTEGER) AS n_records
    FROM d JOIN t ON t.k = d.k JOIN l ON l.k = d.k JOIN s ON s.k = d.k GROUP BY d.k""",
)


def _detect_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_deduplication().detection.clusters(table(spark, d, "documents"))


register("detect_documents", _detect_documents, _DOC_CLUSTERS)


def _exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("cluster_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster_id", "n")


register("exact_duplicates", _exact_duplicates, "SELECT min(doc_id) AS cluster_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")


def _last_versions(spark: SparkSession, d: str) -> DataFrame:
    return clustering.last_versions(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


register("materialize_last_versions", _last_versions, "SELECT user_id, event_id, event_type, value FROM events QUALIFY event_id = max(event_id) OVER (PARTITION BY user_id)")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a stream of three micro-batches, clustered online by names that differ in one place."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    keys = [_K("name", F.reverse("s_name"))]
    rules = classify.RuleBasedClassifier().default_rule(m.scaled_difference(2000).of("s_acctbal"), 0.9)
    online = OnlineDetection(DuplicateDetection(lambda df: df, rules, "s_suppkey", ("s_acctbal",)), keys, f"{base}/state", "s_suppkey", 6)
    static = table(spark, d, "supplier")
    last = static.agg(F.max("s_suppkey")).first()[0] or 0
    part = F.least(F.floor(F.col("s_suppkey") * 3 / (last + 1)), F.lit(2))
    for i in range(3):  # in the order in which they arrive
        static.where(part == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    query = online.start(spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), f"{base}/checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return read_version(spark, f"{base}/state/clusters")[1].select("cluster_id", "record_id")


_SUPPLIER_EDGES = "SELECT c.left_id AS a, c.right_id AS b FROM (" + _online_sql("reverse(s_name)", "s_suppkey", "supplier", 6) + ") c JOIN supplier x ON x.s_suppkey = c.left_id JOIN supplier y ON y.s_suppkey = c.right_id WHERE greatest(0, 1 - abs(x.s_acctbal - y.s_acctbal) / 2000.0::DOUBLE) >= 0.9"
register("stream_foreach_batch", _stream, closure_sql(_SUPPLIER_EDGES))
