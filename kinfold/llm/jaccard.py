"""N-gram Jaccard join by chosen paths, with exact links and classes.

Sets are the word five-grams of the texts; equal sets are one node. Each set is embedded into minwise tokens, and
recursively split: a node of the recursion samples coordinates, and the sets that share the token there go on
together. Small buckets are compared by brute force on the embedded tokens, larger ones are split further and at
last dealt out in pairs of blocks. Runs are repeated as often as the target recall needs at the threshold. The
candidate pairs are never listed: buckets give spanning edges, their components hold all linked sets, and within a
component all pairs are compared exactly, each once, for numbers of links and classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._text import chunks, mix, shingle_set, slices, texts_as_bytes, word_hashes
from kinfold.operators.components import connected_components
from kinfold.operators.filters import key_filter, with_membership
from kinfold.plans.runtime import cut_lineage, table

THRESHOLD, WORDS = 0.8, 5
#: Minwise tokens of 16 bits in the embedding; share of nodes that sample a second coordinate.
TOKENS, SECOND = 64, 0.25
#: Depth at first and at most, target recall of a pair at the threshold, largest bucket compared by one task.
DEPTH, DEEPEST, RECALL, BUCKET = 2, 4, 0.999, 4096
#: Components up to that many sets (and shingles) are compared by one task, larger ones in pairs of blocks.
WHOLE, WHOLE_SHINGLES = 256, 1 << 22

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def shared(similarity: float, depth: int, second: float = SECOND) -> float:
    """Probability that a pair whose tokens agree with this probability shares a path of one run."""
    s = 1.0
    for _ in range(depth):
        s = (1 - second) * similarity * s + second * (1 - (1 - similarity * s) ** 2)
    return s


def expected_recall(threshold: float, depth: int, runs: int) -> float:
    """Of pairs exactly at the threshold. All runs share one embedding, so it is an average over how many of its tokens agree."""
    need, total = tokens_needed(threshold), 0.0
    for k in range(need, TOKENS + 1):
        total += math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k) * (1 - (1 - shared(k / TOKENS, depth)) ** runs)
    return total


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEEPEST) -> int:
    """Runs after which the expected recall is reached by pairs whose buckets are split as deep as ``depth``."""
    return next(r for r in range(1, 1000) if expected_recall(threshold, depth, r) >= recall or expected_recall(threshold, depth, r + 1) - expected_recall(threshold, depth, r) < 1e-7)


def tokens_needed(threshold: float = THRESHOLD) -> int:
    """Equal tokens below which a pair is no candidate: four and a half standard deviations under the threshold."""
    return max(1, math.floor(TOKENS * (threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / TOKENS))))


def ratio(threshold: float) -> tuple[int, int]:
    """Numerator and denominator of the threshold, so that similarities are compared in whole numbers."""
    f = Fraction(threshold).limit_denominator(1_000_000)
    return f.numerator, f.denominator


def embed(s: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set of hashes."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[i : i + 4096, None] * _A + _B).min(0))
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def extend(key: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of recursion nodes, one node and its set's tokens a row: each node samples one coordinate, some a second, and a set goes on with its token there."""
    row = np.arange(len(key))
    first = (mix(key ^ np.uint64(0xA5A5)) % np.uint64(TOKENS)).astype(np.int64)
    other = (mix(key ^ np.uint64(0xC3C3)) % np.uint64(TOKENS)).astype(np.int64)
    twice = np.flatnonzero(((mix(key ^ np.uint64(0x9696)) >> np.uint64(11)).astype(np.float64) < SECOND * (1 << 53)) & (first != other))
    child = lambda r, c: mix(key[r] * np.uint64(0x9E3779B97F4A7C15) + (c.astype(np.uint64) << np.uint64(20)) + tokens[r, c].astype(np.uint64))
    return np.concatenate([row, twice]), np.concatenate([child(row, first), child(twice, other[twice])])


def paths(tokens: np.ndarray, runs: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of all nodes at ``depth`` in all runs."""
    n = len(tokens)
    who = np.tile(np.arange(n), runs)
    key = np.repeat(mix(np.arange(1, runs + 1, dtype=np.uint64)), n)
    for _ in range(depth):
        row, key = extend(key, tokens[who])
        who = who[row]
    return who, key


def _shingles(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    for a, b in chunks(texts):
        h, first = word_hashes(texts[a:b])
        for i in range(b - a):
            yield shingle_set(h[first[i] : first[i + 1]], texts[a + i], words)


def signatures(df: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """(doc_id, h1, h2, n, tokens) of every row with a key and a text."""

    def run(batches):
        for batch in slices(batches):
            h1, h2, n, tokens = [], [], [], []
            for s in _shingles(texts_as_bytes(batch.column(1)), words):
                h1.append(mix(s).sum(dtype=np.uint64))
                h2.append(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5DEECE66D))))
                n.append(len(s))
                tokens.append(embed(s).tobytes())
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), longs(h1), longs(h2), pa.array(n, pa.int64()), pa.array(tokens, pa.binary())], names=["doc_id", "h1", "h2", "n", "tokens"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, n long, tokens binary")


_KEYED = "key long, rep long, n int, tokens binary"


def _matrix(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, TOKENS)


def keyed_rows(sets: int, runs: int, depth: int = DEPTH) -> int:
    """About how many rows the paths of so many sets have."""
    return math.ceil(sets * runs * (1 + SECOND) ** depth)


def _keyed(reps: DataFrame, runs: int) -> DataFrame:
    """Rows of all paths. Paths follow tokens of 16 bits; into the buckets go 8 bits of each, which tell sets apart as well and weigh half."""
    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                if part.num_rows:
                    tokens = _matrix(part.column(2), np.uint16)
                    who, key = paths(tokens, runs)
                    low = pa.array([x.tobytes() for x in tokens.astype(np.uint8)], pa.binary())
                    yield from _taken(pa.RecordBatch.from_arrays([part.column(0), part.column(1), low], names=["rep", "n", "tokens"]), who, key)

    return reps.select("rep", F.col("n").cast("int").alias("n"), "tokens").mapInArrow(run, _KEYED)


def _taken(part: pa.RecordBatch, who: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(who), 20_000):
        at = pa.array(who[s : s + 20_000])
        yield pa.RecordBatch.from_arrays([pa.array(key[s : s + 20_000].view(np.int64)), *(part.column(i).take(at) for i in range(3))], names=["key", "rep", "n", "tokens"])


def _deeper(rows: DataFrame) -> DataFrame:
    """One more level for the rows of large buckets."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 20_000):
                part = batch.slice(s, 20_000)
                if part.num_rows:
                    row, key = extend(np.asarray(part.column(0)).view(np.uint64), _matrix(part.column(3)))
                    yield from _taken(pa.RecordBatch.from_arrays(part.columns[1:], names=["rep", "n", "tokens"]), row, key)

    return rows.select("key", "rep", "n", "tokens").mapInArrow(run, _KEYED)


def bucket_edges(rep: np.ndarray, n: np.ndarray, tokens: np.ndarray, threshold: float, need: int) -> list[tuple[int, int]]:
    """Spanning edges of the candidate graph of one bucket, smallest node first. Nodes leave once they are reached, so dense buckets cost little."""
    p, q = ratio(threshold)
    order = np.argsort(rep, kind="stable")
    rep, n, tokens = rep[order], n[order], tokens[order]
    open_ = np.arange(len(rep))
    edges = []
    while len(open_) > 1:
        root, open_ = open_[0], open_[1:]
        queue = [root]
        while queue and len(open_):
            x = queue.pop()
            low, high = np.minimum(n[open_], n[x]), np.maximum(n[open_], n[x])
            near = (q * low >= p * high) & ((tokens[open_] == tokens[x]).sum(1) >= need)
            found = open_[near]
            open_ = open_[~near]
            edges += [(int(rep[root]), int(rep[y])) for y in found if rep[y] != rep[root]]
            queue += found.tolist()
    return edges


def grouped(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of equal leading columns of sorted batches, each at once; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            now = tuple(c[s] for c in cols)
            if now != last and held:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = now
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held)


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _edges_of_buckets(rows: DataFrame, threshold: float) -> DataFrame:
    need = tokens_needed(threshold)

    def run(batches):
        out: list[tuple[int, int]] = []
        for g in grouped(batches):
            if g.num_rows > 1:
                out += bucket_edges(np.asarray(_one(g.column(1))), np.asarray(_one(g.column(2))), _matrix(_one(g.column(3))), threshold, need)
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return rows.select("key", "rep", "n", "tokens").repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(run, "src long, dst long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["src", "dst"])


def candidate_edges(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, deepest: int = DEEPEST) -> DataFrame:
    """(src, dst): spanning edges over nodes that may be linked."""
    runs = runs_needed(threshold, recall, max(deepest, DEPTH))
    rows, depth, edges, n = _keyed(reps, runs), DEPTH, None, reps.count()
    while True:
        large = cut_lineage(rows.groupBy("key").count().where(F.col("count") > bucket), keyed_rows(n, runs, depth) // bucket, after=True)
        if large.limit(1).count() == 0:
            found, rest = _edges_of_buckets(rows, threshold), None
        else:
            found = _edges_of_buckets(rows.join(large, "key", "left_anti"), threshold)
            rest = rows.join(large, "key")
        edges = found if edges is None else edges.union(found)
        if rest is None:
            return edges
        if depth >= deepest:
            return edges.union(_edges_of_buckets(_in_block_pairs(rest, bucket), threshold))
        rows, depth = cut_lineage(_deeper(rest)), depth + 1


def _in_block_pairs(rest: DataFrame, bucket: int) -> DataFrame:
    """Rows of buckets that no splitting made small, dealt so that every two rows of a bucket meet in some group of at most about ``bucket`` rows."""
    blocks = F.ceil(F.col("count") * 2 / bucket).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    every = rest.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return every.select(F.xxhash64("key", F.least("mine", "theirs"), F.greatest("mine", "theirs")).alias("key"), "rep", "n", "tokens")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Tokens of many sets go through matrix products, the others are counted pair by pair."""
    m = len(sets)
    inter = np.zeros((m, m), np.int32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = max(8, m // 16)
    dense = np.flatnonzero(count >= many)
    place = np.full(len(count), -1, np.int64)
    place[dense] = np.arange(len(dense))
    for s in range(0, len(dense), 2048):
        col = place[token]
        pick = (col >= s) & (col < s + 2048)
        x = np.zeros((m, min(2048, len(dense) - s)), np.float32)
        x[owner[pick], col[pick] - s] = 1
        inter += (x @ x.T).astype(np.int32)
    order = np.argsort(token, kind="stable")
    by_token, by_owner = token[order], owner[order]
    first = np.searchsorted(by_token, np.arange(len(count)))
    for f in np.unique(count[(count > 1) & (count < many)]).tolist():
        starts = first[count == f]
        i, j = np.triu_indices(f, 1)
        step = max(1, 2_000_000 // len(i))
        for s in range(0, len(starts), step):
            at = by_owner[starts[s : s + step, None] + np.arange(f)]
            a, b = at[:, i].ravel(), at[:, j].ravel()
            add = np.bincount(a * m + b, minlength=m * m).reshape(m, m).astype(np.int32) if m <= 1024 else None
            if add is None:
                np.add.at(inter, (a, b), 1)
                np.add.at(inter, (b, a), 1)
            else:
                inter += add + add.T
    inter[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return inter


def exact_links(rep: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of linked documents outside the node, smallest node of its class) within one group of sets.

    ``side`` 2: all pairs count; 0 and 1: only pairs between these sides.
    """
    p, q = ratio(threshold)
    size = np.array([len(s) for s in sets], np.int64)
    inter = intersections(sets)
    linked = np.empty(inter.shape, bool)
    for s in range(0, len(sets), 256):
        linked[s : s + 256] = inter[s : s + 256].astype(np.int64) * (p + q) >= p * (size[s : s + 256, None] + size)
    np.fill_diagonal(linked, False)
    if side[0] != 2:
        linked &= side[:, None] != side[None, :]
    links = linked.astype(np.float64) @ copies
    label = np.full(len(rep), -1, np.int64)
    for root in np.argsort(rep, kind="stable").tolist():
        if label[root] >= 0:
            continue
        label[root] = root
        queue = [root]
        while queue:
            near = np.flatnonzero(linked[queue.pop()] & (label < 0))
            label[near] = root
            queue += near.tolist()
    return links.astype(np.int64), rep[label]


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def verified(df: DataFrame, reps: DataFrame, components: DataFrame, key: str, text: str, threshold: float = THRESHOLD, words: int = WORDS, whole: int = WHOLE) -> DataFrame:
    """(rep, links, class) by exact comparison of all sets of each candidate component."""
    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return pd.Series([s.tobytes() for s in _shingles([t.encode() for t in x], words)], dtype=object)

    members = cut_lineage(components.withColumnRenamed("node", "rep").join(reps.select("rep", "n", "copies"), "rep"), reps.count())
    n_members = members.count()
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    block = F.least(F.greatest(F.col("m") / 24, F.lit(float(whole // 2))), F.lit(2048.0))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("shingles") * 2 / WHOLE_SHINGLES)).cast("int")
    large = cut_lineage(size.where((F.col("m") > whole) | (F.col("shingles") > WHOLE_SHINGLES)).select("component", blocks.alias("blocks"), "m"), n_members)
    n_large, n_sent = large.agg(F.count(F.lit(1)), F.sum(F.col("m") * F.col("blocks"))).first()
    split = n_large > 0
    texts = df.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).where("rep is not null and text is not null")
    # Most texts are candidates of nothing: they go no further than their own partition.
    asked = with_membership(texts, key_filter(members, ["rep"], n_members), ["rep"], "asked").where("asked").select("rep", "text")
    sets = asked.withColumn("shingles", packed("text")).drop("text").join(members.select("rep", "component", "copies"), "rep")
    if split:
        sets = sets.join(large.drop("m"), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        sets = sets.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        group = F.xxhash64("component", F.least("mine", "theirs"), F.greatest("mine", "theirs"))
        sets = sets.select(group.alias("group"), "rep", "copies", "shingles", F.expr("case when mine = theirs then 2 when mine < theirs then 0 else 1 end").alias("side"))
    else:
        sets = sets.select(F.col("component").alias("group"), "rep", "copies", "shingles", F.lit(2).alias("side"))

    def run(batches):
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for g in grouped(batches):
            rep = np.asarray(_one(g.column(1)))
            _, at, back = np.unique(rep, return_index=True, return_inverse=True)
            raw, copies, side = _one(g.column(3)), np.asarray(_one(g.column(2)))[at].astype(np.float64), np.asarray(_one(g.column(4)))[at]
            shingles = [_unpack(raw[int(i)].as_py()) for i in at]
            for i in np.flatnonzero(at[back] != np.arange(len(rep))).tolist():  # several texts of one key
                shingles[back[i]] = np.union1d(shingles[back[i]], _unpack(raw[i].as_py()))
            links, label = exact_links(rep[at], copies, shingles, side, threshold)
            out.append((rep[at], links, label))
            n += len(at)
            if n > 20_000:
                yield _links(out)
                out, n = [], 0
        yield _links(out)

    checked = sets.repartition(F.col("group")).sortWithinPartitions("group").mapInArrow(run, "rep long, links long, class long")
    if not split:
        return checked
    checked = cut_lineage(checked, n_members + n_sent, after=True)
    classes = connected_components(checked.select(F.col("rep").alias("src"), F.col("class").alias("dst")), most=n_members + n_sent)
    summed = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    return summed.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "links", F.coalesce("component", "rep").alias("class"))


def _links(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]) if out else [], pa.int64()) for i in range(3)], names=["rep", "links", "class"])


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, bucket: int = BUCKET, whole: int = WHOLE, deepest: int = DEEPEST) -> DataFrame:
    """One row per row: (doc_id, class_id, copy_of, n_links).

    Two documents are linked if the Jaccard similarity of their word n-gram sets is at least ``threshold``; n_links
    counts the others linked with a document, class_id is the smallest doc_id of its connected component, copy_of the
    smallest with an equal set. Texts with fewer words than an n-gram have one gram of all their words; texts without
    a word have one of the raw text, so that equal ones are linked. Rows with a null text are linked with nothing and
    are a class of their own; rows with a null key take no part and have null ids and no links. Keys are whole
    numbers that name documents: repeated rows are copies of one another, and where rows of one key differ in their texts
    that key stands for all of them, with the union of their sets in comparisons. An empty table gives no rows.
    """
    return _joined(df, key, text, threshold, words, recall, bucket, whole, deepest)[0]


def _joined(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, bucket: int = BUCKET, whole: int = WHOLE, deepest: int = DEEPEST) -> tuple[DataFrame, int]:
    """The join, and its number of rows with a key and a text."""
    if df.schema[key].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError(f"{key} must be a whole number")
    rows = cut_lineage(signatures(df, key, text, words))
    n_rows = rows.count()
    reps = cut_lineage(rows.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("tokens").alias("tokens")), n_rows)
    n = reps.count()
    most = keyed_rows(n, runs_needed(threshold, recall, max(deepest, DEPTH)))
    components = connected_components(candidate_edges(reps, threshold, recall, bucket, deepest), most=most)
    exact = verified(df, reps, components, key, text, threshold, words, whole)
    known = cut_lineage(reps.select("h1", "h2", "n", "rep", "copies").join(exact, "rep", "left"), n)
    out = rows.select("doc_id", "h1", "h2", "n").join(known, ["h1", "h2", "n"]).select(
        "doc_id", F.coalesce("class", "rep").alias("class_id"), F.col("rep").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    apart = df.where(F.col(key).isNull() | F.col(text).isNull()).select(F.col(key).cast("long").alias("doc_id"))
    return out.union(apart.select("doc_id", "doc_id", "doc_id", F.lit(0).cast("long"))), n_rows


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the rows of one key of each class, the smallest; of rows with equal key and text one stays.

    Rows with a null key stay. Columns keep their names, whatever they are. Only the rows in question move: those of
    classes with other keys and of repeated keys, and the few that the filter takes for such.
    """
    joined, n = _joined(df, key, text)
    ids = joined.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("class"))
    doubtful = cut_lineage(ids.where("n > 1 or class <> doc_id").select("doc_id", (F.col("class") == F.col("doc_id")).alias("head")), n, after=True)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    marked = with_membership(rows, key_filter(doubtful, ["doc_id"], doubtful.count()), ["id"], "moves")
    once = marked.where("moves").groupBy("id", F.xxhash64("text").alias("h"), F.col("text").isNull().alias("none")).agg(F.first("row").alias("row"))
    moved = once.join(doubtful, F.col("id") == F.col("doc_id"), "left").where("head is null or head").select("row")
    return marked.where("not moves").select("row").unionByName(moved).select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE ['raw ' || text] END) AS g
  FROM w
), f AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS n_both
  FROM f a JOIN f b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM o WHERE 9 * n_both >= 4 * (nx + ny)
), r AS (
  SELECT x AS d, x AS c FROM l UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.d
), e AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(g)) AS copy_of FROM s
)
SELECT d.doc_id, CAST(coalesce(least(m.c, d.doc_id), d.doc_id) AS BIGINT) AS class_id, CAST(coalesce(e.copy_of, d.doc_id) AS BIGINT) AS copy_of, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id
LEFT JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = d.doc_id
LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = d.doc_id
"""
