"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every row of a source should be taken target / size of the source times. The whole part is fixed; the fraction is
rounded dependently: rows meet in pairs and pass expected words from one to the other, in a random direction that
keeps each row's expectation, until one of the two is taken for certain or left for certain. In a leaf of about
``LEAF`` rows, which share one probability, each row in turn, the largest first, meets all that follow as one pool, so
that large rows are settled early and a small one stays open. The open rows of the leaves enter the next level of the
tree, where they meet in pairs; the sum of a source stays exact until its last open row is rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.operators.filters import key_filter, with_membership
from kinfold.plans.runtime import cut_lineage, table

#: Fixed values of the contract: weights in turn, and the largest number of copies.
WEIGHTS, LARGEST = (5, 2, 1), 3
WORDS = r"[^\x20\x09-\x0D]+"
LEAF = 64
#: Largest number of sources whose table is broadcast; beyond it they are joined by a shuffle.
FEW_SOURCES = 10_000
#: Equal rows that one task numbers.
BLOCK = 4096


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column], few: bool) -> DataFrame:
    """``df`` with the number of rows before each (``before``) and the sums over them. Many rows are sorted in ranges, which are shifted by what lies in those before; few lie in one."""
    dealt = df.coalesce(1) if few else df.repartitionByRange(*order)
    local = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as there are ranges.
    shift = ranges.select(F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in ("n", *sums)])
    out = local.join(F.broadcast(shift), F.col("_part") == F.col("_of"))
    out = out.withColumn("before", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before_n"))
    for n, c in sums.items():
        out = out.withColumn(n, F.coalesce(F.sum(c).over(here), F.lit(0.0)) + F.col(f"_before_{n}"))
    return out.drop("_part", "_of", *[f"_before_{n}" for n in ("n", *sums)])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, largest: float = LARGEST) -> DataFrame:
    """(source, source_size, n_open, rank, weight, target) from (source, size, rows), ``rows`` of that size each.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at
    ``largest`` times its source's size and the excess is shared anew. In order of the size at which they stop, the
    stopped sources come first, so one running sum over the sources (not the rows) finds the level of the others.
    """
    one = cut_lineage(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("rows")).otherwise(0)).alias("n_open")), sizes.count())
    n, total = one.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    few = n <= FEW_SOURCES
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _running(one, [F.col("source").asc_nulls_last()], {}, few).withColumn("rank", (F.col("before") + 1).cast("int")).drop("before")
    ranked = ranked.withColumn("weight", F.element_at(turn, (F.col("rank") - 1) % len(weights) + 1)).withColumn("stop", F.col("source_size") * F.lit(float(largest)))
    by_stop = [(F.col("stop") / F.col("weight")).asc(), F.col("rank").asc()]
    summed = cut_lineage(_running(ranked, by_stop, {"stops": F.col("stop"), "weights": F.col("weight")}, few), n)
    all_weights = summed.agg(F.sum("weight")).first()[0] or 0.0
    levelled = summed.withColumn("level", (F.lit(float(total or 0)) - F.col("stops")) / (F.lit(float(all_weights)) - F.col("weights"))).withColumn("stopped", F.col("stop") <= F.col("weight") * F.col("level"))
    rest = levelled.agg(F.max(F.when(~F.col("stopped"), F.col("level")))).first()[0]
    return levelled.withColumn("target", F.when(F.col("stopped"), F.col("stop")).otherwise(F.least("stop", F.col("weight") * F.lit(rest)))).select("source", "source_size", "n_open", "rank", "weight", "target")


_UNIT = "struct<size:bigint,u:double,doc_id:{id},tie:bigint,occ:int,p:double>"


def _unit(who: str, p: str) -> str:
    return f"named_struct('size', {who}.size, 'u', {who}.u, 'doc_id', {who}.doc_id, 'tie', {who}.tie, 'occ', {who}.occ, 'p', {p})"


def _leaf(units: str, kind: str) -> str:
    """SQL for rows of one probability, the largest first: each against the pool of those after it.

    The state: the pool's probability ``q``, the words of the rows not met yet, the value ``v`` of a pool that became
    whole (-1 before), the open row and the settled ones.
    """
    unit = _UNIT.format(id=kind)
    state = lambda q, v, cur, done: f"named_struct('q', {q}, 'rest', a.rest, 'v', {v}, 'cur', {cur}, 'done', {done})"
    settled = lambda p: f"concat(a.done, array({_unit('b', p)}))"
    taken = f"if((1 - a.q) * b.size <= a.q * a.rest, {state('greatest(a.q - a.d1 / a.rest, 0D)', '-1D', 'a.cur', settled('1D'))}, {state('a.q', '0D', _unit('b', 'least(a.q + a.d1 / b.size, 1D)'), 'a.done')})"
    left = f"if(a.q * b.size <= (1 - a.q) * a.rest, {state('least(a.q + a.d2 / a.rest, 1D)', '-1D', 'a.cur', settled('0D'))}, {state('a.q', '1D', _unit('b', 'greatest(a.q - a.d2 / b.size, 0D)'), 'a.done')})"
    step = f"case when a.v >= 0 then {state('a.q', 'a.v', 'a.cur', settled('a.v'))} when a.rest = 0 then {state('a.q', 'a.v', _unit('b', 'a.q'), 'a.done')} when b.u * (a.d1 + a.d2) < a.d2 then {taken} else {left} end"
    known = "named_struct('q', acc.q, 'rest', acc.rest - b.size, 'v', acc.v, 'cur', acc.cur, 'done', acc.done, 'd1', least((1 - acc.q) * b.size, acc.q * (acc.rest - b.size)), 'd2', least(acc.q * b.size, (1 - acc.q) * (acc.rest - b.size)))"
    start = f"named_struct('q', {units}[0].p, 'rest', aggregate({units}, 0L, (t, x) -> t + x.size), 'v', -1D, 'cur', cast(null as {unit}), 'done', cast(array() as array<{unit}>))"
    return f"aggregate({units}, {start}, (acc, b) -> element_at(transform(array({known}), a -> {step}), 1), s -> named_struct('cur', s.cur, 'done', s.done))"


def _fold(units: str, kind: str) -> str:
    """SQL that pairs the units of an array in order: struct of the one left open and the settled ones."""
    unit = _UNIT.format(id=kind)
    up, down = "least((1 - a.cur.p) * a.cur.size, b.p * b.size)", "least(a.cur.p * a.cur.size, (1 - b.p) * b.size)"
    cur = _unit
    end = lambda who, p: f"array({cur(who, p)})"
    # d words go from one to the other; whichever of the two bounds was reached first settles its unit.
    to_cur = f"if((1 - a.cur.p) * a.cur.size <= b.p * b.size, named_struct('cur', {cur('b', 'greatest(b.p - a.d1 / b.size, 0D)')}, 'done', concat(a.done, {end('a.cur', '1D')})), named_struct('cur', {cur('a.cur', 'least(a.cur.p + a.d1 / a.cur.size, 1D)')}, 'done', concat(a.done, {end('b', '0D')})))"
    to_new = f"if(a.cur.p * a.cur.size <= (1 - b.p) * b.size, named_struct('cur', {cur('b', 'least(b.p + a.d2 / b.size, 1D)')}, 'done', concat(a.done, {end('a.cur', '0D')})), named_struct('cur', {cur('a.cur', 'greatest(a.cur.p - a.d2 / a.cur.size, 0D)')}, 'done', concat(a.done, {end('b', '1D')})))"
    pair = f"element_at(transform(array(named_struct('cur', acc.cur, 'done', acc.done, 'd1', {up.replace('a.cur', 'acc.cur')}, 'd2', {down.replace('a.cur', 'acc.cur')})), a -> if(b.u * (a.d1 + a.d2) < a.d2, {to_cur}, {to_new})), 1)"
    start = f"named_struct('cur', cast(null as {unit}), 'done', cast(array() as array<{unit}>))"
    return f"aggregate({units}, {start}, (acc, b) -> if(acc.cur is null, named_struct('cur', b, 'done', acc.done), {pair}))"


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, weights: tuple[float, ...] = WEIGHTS, largest: float = LARGEST) -> DataFrame:
    """One row per row of ``df``: (key, source, tie, occ, size, source_size, target, copies, taken).

    ``tie`` is a hash of the text and ``occ`` numbers rows that agree in key, source and text. A null text has size 0;
    texts without words are never taken; null sources form one source, the last; an empty table gives no rows; other
    columns take no part. The random numbers are hashes of key, text and ``seed``, so reruns agree.
    """
    return _mixed(df, key, text, source, seed, weights, largest)[0]


def _mixed(df: DataFrame, key: str, text: str, source: str, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, largest: float = LARGEST) -> tuple[DataFrame, int]:
    """The mix, and its number of rows."""
    kind = df.schema[key].dataType.simpleString()
    measured = df.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("tie"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size")
    )
    # Rows that agree are counted, which combines before the shuffle, and numbered anew; very many of them are numbered in blocks.
    groups = cut_lineage(measured.groupBy("doc_id", "source", "tie").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    one = groups.where(F.col("rows") <= BLOCK).withColumn("occ", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    blocks = groups.where(F.col("rows") > BLOCK).withColumn("block", F.explode(F.expr(f"sequence(0L, (rows - 1) div {BLOCK})"))).repartition("doc_id", "source", "tie", "block")
    many = blocks.withColumn("occ", F.explode(F.expr(f"sequence(cast(block * {BLOCK} + 1 as int), cast(least(rows, (block + 1) * {BLOCK}) as int))")))
    sizes = one.select("doc_id", "source", "tie", "size", "occ").union(many.select("doc_id", "source", "tie", "size", "occ"))
    n_rows = left = groups.agg(F.sum("rows")).first()[0] or 0
    sources = cut_lineage(source_targets(groups, weights, largest))
    n_sources, most = sources.agg(F.count(F.lit(1)), F.max("n_open")).first()
    side = sources.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if n_sources <= FEW_SOURCES else side
    rows = sizes.join(side, sizes.source.eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(rate + 1e-12).cast("long")).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))
    about = ["rank", "source", "source_size", "target", "whole"]
    settled = [rows.where("p = 0").select(*about, "doc_id", "tie", "occ", "size", F.lit(0.0).alias("p"))]
    units = rows.where("p > 0").select(*about, F.col("n_open").alias("n"), "doc_id", "tie", "occ", "size", "p")
    level, most = 0, most or 0
    while most > 1:
        u = (F.xxhash64("doc_id", "tie", "occ", F.lit(seed), F.lit(level)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
        n_groups = F.ceil(F.col("n") / LEAF)
        group = F.pmod(F.xxhash64("doc_id", "tie", "occ", F.lit(seed + 1), F.lit(level)), n_groups)
        gathered = (
            units.withColumn("group", group)
            .withColumn("n", n_groups)
            .groupBy(*about, "n", "group")
            .agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", u.alias("u"), "doc_id", "tie", "occ", "p")))).alias("units"))
        )
        folded = cut_lineage(gathered.select(*about, "n", F.expr((_fold if level else _leaf)("units", kind)).alias("f")), left)
        settled.append(folded.select(*about, F.explode("f.done").alias("x")).select(*about, "x.doc_id", "x.tie", "x.occ", "x.size", "x.p"))
        units = folded.select(*about, "n", "f.cur.doc_id", "f.cur.tie", "f.cur.occ", "f.cur.size", "f.cur.p")
        most, left, level = -(-most // LEAF), left // LEAF + n_sources, level + 1
    last = (F.xxhash64("doc_id", "tie", "occ", F.lit(seed), F.lit(-1)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    out = units.select(*about, "doc_id", "tie", "occ", "size", F.when(last < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    for x in settled:
        out = out.unionByName(x)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(F.lit(0))
    out = out.select(F.col("doc_id").alias(key), F.col("source").alias(source) if source != key else F.col("source"), "tie", "occ", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
    return out, n_rows


def apply_mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **kwargs) -> DataFrame:
    """``df`` with each row as many times as the mix takes it, and its columns as they are.

    Most rows of a source are taken equally often, and stay in their partitions; only those that the mix takes once more
    or less than that (and the few that the filter takes for such) are joined with their number of copies. Repeated rows
    are numbered within the parts of the input, which the parts before shift, so that very many of them are split.
    """
    columns = ["_key", "_source", "_tie"]
    mixed, n_rows = _mixed(df, key, text, source, **kwargs)
    plan = cut_lineage(mixed.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col("tie").alias("_tie"), "size", "copies"), n_rows)
    usual = plan.where("size > 0").groupBy("_source", "copies").count().groupBy("_source").agg(F.max_by("copies", F.struct("count", -F.col("copies"))).alias("usual"))
    usual = cut_lineage(usual, n_rows)
    n = usual.count()

    def with_usual(rows: DataFrame, words: Column) -> DataFrame:
        side = usual.select(F.col("_source").alias("_s"), "usual")
        side = F.broadcast(side) if n <= FEW_SOURCES else side.limit(0)  # of very many sources all rows are joined
        return rows.join(side, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("usual", F.when(words, F.coalesce("usual", F.lit(-1))).otherwise(F.lit(0)))

    groups = with_usual(plan, F.col("size") > 0).groupBy(*columns).agg(F.count(F.lit(1)).alias("m"), F.min("copies").alias("least"), F.sum("copies").alias("taken"), F.max(F.col("copies") != F.col("usual")).alias("odd"))
    odd = cut_lineage(groups.where("odd").drop("odd"), n_rows)
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_key"), F.col(source).alias("_source"), F.xxhash64(text).alias("_tie"), F.coalesce(F.col(text).rlike(WORDS), F.lit(False)).alias("_words"))
    rows = with_membership(with_usual(rows, F.col("_words")), key_filter(odd, columns, n_rows), columns, "_moves").withColumn("_part", F.spark_partition_id())
    moved = rows.where("_moves")
    # Of m equal rows the first get one copy more than the others, so that all copies of the mix are given out.
    a, b = moved.alias("a"), odd.alias("b")
    same = F.expr("a._key <=> b._key and a._source <=> b._source and a._tie = b._tie")
    # Sorted, as a join may leave its rows in the order in which they came.
    single = a.join(b, same, "left").where("b.m is null or b.m = 1").select("a._tie", "a._key", "a._row", F.coalesce("b.taken", "a.usual").alias("n")).sortWithinPartitions("_tie", "_key").select("_row", "n")
    kept = rows.where("not _moves").select("_row", F.col("usual").alias("n"))
    out = kept.unionByName(single)
    repeated = odd.where("m > 1")
    if repeated.limit(1).count():
        # Kept, as a second reading of the input might part it otherwise.
        again = cut_lineage(a.join(repeated.alias("b"), same).select("a.*", "b.m", "b.least", "b.taken"))
        counts = again.groupBy(*columns, "_part").count()
        shift = counts.select(*columns, "_part", F.coalesce(F.sum("count").over(Window.partitionBy(*columns).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
        within = again.withColumn("at", F.row_number().over(Window.partitionBy(*columns, "_part").orderBy("_tie")))
        c, d = within.alias("c"), shift.alias("d")
        numbered = c.join(d, F.expr("c._key <=> d._key and c._source <=> d._source and c._tie = d._tie and c._part = d._part"))
        several = numbered.select("c._row", F.expr("c.least + if(c.at + d.shift <= c.taken - c.least * c.m, 1, 0)").alias("n"))
        out = out.unionByName(several)
    out = out.where("n > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
