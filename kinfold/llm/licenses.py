"""License scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined to template positions; matches with one offset
(document position minus template position) form a diagonal, neighbouring diagonals are merged, and the words of
the merged spans are compared with the template's, one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.llm._text import chunks, grams, texts_as_bytes, word_hashes
from kinfold.operators.filters import key_filter, with_membership
from kinfold.plans.runtime import cut_lineage, table

# Fixed values of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Publicly known wordings of licenses and notices.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-short": "This work is licensed under the GNU General Public License, version 3.",
    "mit-short": "This work is licensed under the MIT License.",
    "apache-short": "This work is licensed under the Apache License, version 2.0.",
    "cc-by-short": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
}
#: Word k-gram lengths: of phrases, and of templates; of shorter ones as many words as they have.
SHORT, LONG = 2, 4
#: Offsets up to that far apart (or half a template's words, if fewer) belong to one copy of a template with words added or left out.
NEAR = 8
#: Words that are joined at once.
SLICE = 100_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | bytes) -> list[bytes]:
    return _WORD.findall((text.encode() if isinstance(text, str) else text).lower())


class Catalog:
    """Phrases, then templates, numbered: their labels, words and k-gram lengths. One without a word is refused."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        named = [(label, text, SHORT) for text, label in phrases.items()] + [(label, text, LONG) for label, text in templates.items()]
        self.n_phrases = len(phrases)
        self.labels, self.words = [n[0] for n in named], [words(n[1]) for n in named]
        if not all(self.words):
            raise ValueError("a phrase or template has no word")
        self.k = [min(n[2], len(w)) for n, w in zip(named, self.words, strict=True)]

    def table(self, spark: SparkSession, k: int) -> DataFrame:
        """(gram, places) of those with k-grams of this length; a place is (label, template number, its words, k, position). Size: that of the templates."""
        places: dict[int, list] = {}
        for number, (label, w) in enumerate(zip(self.labels, self.words, strict=True)):
            if self.k[number] == k:
                h, _ = word_hashes([b" ".join(w)])
                for at, g in enumerate(grams(h, k).view(np.int64).tolist()):
                    places.setdefault(g, []).append((label, number, len(w), k, at))
        return spark.createDataFrame(list(places.items()), "gram long, places array<struct<label:string,template:int,words:int,k:int,at:int>>")


def rolling_grams(df: DataFrame, key: str, text: str, lengths: list[int]) -> DataFrame:
    """(row, key, text_hash, n_words, pos, gram1, ...) with a column for each length: a row for every word of every text, and one with pos -1 for every text, which alone holds key, hash and number of words."""
    names = ["row", "key", "text_hash", "n_words", "pos", *(f"gram{k}" for k in lengths)]

    def run(batches):
        for batch in batches:
            rows, texts = np.asarray(batch.column(0)), texts_as_bytes(batch.column(3))
            no = lambda n, kind: pa.nulls(n, kind)
            for a, b in chunks(texts):
                h, first = word_hashes(texts[a:b])
                n = b - a
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, n) for i in range(3)), pa.array(np.diff(first)), pa.array(np.full(n, -1, np.int32)), *(no(n, pa.int64()) for _ in lengths)], names=names)
                for s in range(0, len(h), SLICE):
                    e = min(s + SLICE, len(h))
                    at = np.arange(s, e)
                    doc = np.searchsorted(first, at, "right") - 1
                    cols = []
                    for k in lengths:
                        g = np.zeros(e - s, np.int64)
                        x = grams(h[s : e + k - 1], k).view(np.int64)
                        g[: len(x)] = x
                        cols.append(pa.array(g, mask=at + k > first[doc + 1]))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[a + doc]), no(e - s, batch.column(1).type), no(e - s, pa.int64()), no(e - s, pa.int64()), pa.array((at - first[doc]).astype(np.int32)), *cols], names=names)

    kind = df.schema[key].dataType.simpleString()
    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return numbered.mapInArrow(run, f"row long, key {kind}, text_hash long, n_words long, pos int" + "".join(f", gram{k} long" for k in lengths))


def votes(df: DataFrame, key: str, text: str, catalog: Catalog) -> DataFrame:
    """The join: one row per row of ``df`` (pos -1) and one per match of a k-gram with a template position."""
    lengths = sorted(set(catalog.k))
    out = rolling_grams(df, key, text, lengths)
    for k in lengths:
        side = catalog.table(df.sparkSession, k).toDF(f"_gram{k}", f"places{k}")
        out = out.join(F.broadcast(side), (F.col("pos") >= 0) & (F.col(f"gram{k}") == F.col(f"_gram{k}")), "left")
    found = [F.col(f"places{k}") for k in lengths]
    empty = F.array().cast("array<struct<label:string,template:int,words:int,k:int,at:int>>")
    hit = F.col("pos") < 0
    for c in found:
        hit = hit | c.isNotNull()
    return out.where(hit).select("row", "key", "text_hash", "pos", "n_words", F.explode_outer(F.concat(empty, *[F.coalesce(c, empty) for c in found])).alias("place"))


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    if a == b:
        return len(a)
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1]


def _windows(raw: bytes, spans: list[tuple[int, int]]) -> dict[tuple[int, int], list[bytes]]:
    """The words of each span (start, end) of a text; only those are held."""
    spans = sorted(set(spans))
    held: dict[tuple[int, int], list[bytes]] = {x: [] for x in spans}
    waiting, open_ = 0, []
    for i, m in enumerate(_WORD.finditer(raw.lower())):
        while waiting < len(spans) and spans[waiting][0] <= i:
            open_.append(spans[waiting])
            waiting += 1
        open_ = [x for x in open_ if x[1] > i]
        if not open_ and waiting == len(spans):
            break
        for x in open_:
            held[x].append(m[0])
    return held


def verified(df: DataFrame, text: str, asked: DataFrame, catalog: Catalog) -> DataFrame:
    """(text_hash, template, lo, end, exact) for the spans ``asked``: the share of the template's words that stand in the span in their order.

    Equal texts are read once; texts without such a span do not move.
    """

    def run(batches):
        for batch in batches:
            out = []
            for h, raw, spans in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                held = _windows(raw, [(x["lo"], x["end"]) for x in spans])
                for x in spans:
                    own = catalog.words[x["template"]]
                    out.append((h, x["template"], x["lo"], x["end"], common_words(own, held[x["lo"], x["end"]]) / len(own)))
            cols = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["text_hash", "template", "lo", "end", "exact"])

    spans = asked.groupBy("text_hash").agg(F.collect_set(F.struct("template", "lo", "end")).alias("spans"))
    texts = df.select(F.xxhash64(text).alias("h"), F.col(text).alias("text")).where("text is not null")
    once = with_membership(texts, key_filter(asked, ["text_hash"]), ["h"], "asked").where("asked").groupBy("h").agg(F.first("text").alias("text"))
    return once.join(spans, F.col("h") == F.col("text_hash")).select("h", "text", "spans").mapInArrow(run, "text_hash long, template int, lo int, end int, exact double")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """One row per row of ``df``: (key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    Base labels stand where all words of a phrase follow one another; a template's label stands where at least
    ``coverage`` of its words are covered by the k-grams of one span of merged diagonals and stand there in their
    order, and ``spans`` lists those as (label, first word, end, share). ``score`` is the largest share, 1 with a base
    place. A null text counts as empty: no words, empty labels, score 0. Null and repeated keys keep a row each, as rows
    are told apart by their place in the input; other columns take no part, whatever their names.
    """
    catalog = Catalog(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    hits = votes(df, key, text, catalog).repartition(F.col("row"))
    diagonals = hits.groupBy("row", F.col("place.template").alias("template"), F.expr("pos - place.at").alias("diagonal")).agg(
        F.first("key", ignorenulls=True).alias("key"),
        F.max("text_hash").alias("text_hash"),
        F.max("n_words").alias("n_words"),
        F.max("place.label").alias("label"),
        F.max("place.words").alias("words"),
        F.max("place.k").alias("k"),
        F.collect_set("place.at").alias("ats"),
        F.min("pos").alias("lo"),
        F.max("pos").alias("hi"),
    )
    base = F.col("template") < catalog.n_phrases
    # By diagonal alone: votes of passages that a template repeats in itself lie on far diagonals, whose positions fall between the halves of an edited copy.
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    half = F.expr("greatest(1, words div 2)")
    apart = base | F.lag("diagonal").over(w).isNull() | (F.col("diagonal") - F.lag("diagonal").over(w) > F.least(F.lit(NEAR), half))
    chained = diagonals.withColumn("apart", F.when(apart, 1).otherwise(0)).withColumn("chain", F.sum("apart").over(w))
    # A chain that drifts by more than half a template is cut, so a span has a bounded length.
    drift = F.col("diagonal") - F.min("diagonal").over(Window.partitionBy("row", "template", "chain"))
    spans = (
        chained.withColumn("part", F.floor(drift / F.greatest(F.lit(NEAR), half)))
        .groupBy("row", "template", "chain", "part")
        .agg(
            F.first("key", ignorenulls=True).alias("key"),
            F.max("text_hash").alias("text_hash"),
            F.max("n_words").alias("n_words"),
            F.max("label").alias("label"),
            F.max("words").alias("words"),
            F.max("k").alias("k"),
            F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1)))))
    voted = spans.select(
        "row", "key", "n_words", "template", "label", "lo", (F.col("hi") + F.col("k")).alias("end"), F.when(F.size("ats") > 0, covered / F.col("words")).otherwise(0.0).alias("share"),
        # The hash of a text stands in its first row only, which has no template.
        F.max("text_hash").over(Window.partitionBy("row")).alias("text_hash"),
    )
    voted = cut_lineage(voted)
    exact = verified(df, text, voted.where(~base & (F.col("share") >= coverage)).select("text_hash", "template", "lo", "end"), catalog)
    checked = voted.join(exact, ["text_hash", "template", "lo", "end"], "left").withColumn("share", F.least("share", F.coalesce("exact", "share")))
    is_base = base & (F.col("share") == 1)
    is_own = ~base & (F.col("share") >= coverage)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return checked.groupBy("row").agg(
        F.first("key", ignorenulls=True).alias(key),
        F.max("n_words").alias("n_words"),
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("lo").cast("long"))).alias("first_word"),
        F.max(F.when(is_base, F.col("lo").cast("long"))).alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"),
        joined(F.when(is_base | is_own, F.col("label"))).alias("labels"),
        F.greatest(F.max(F.when(~base, F.col("share"))), F.when(F.count_if(is_base) > 0, 1.0), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(is_base | is_own, F.struct("label", F.col("lo").alias("start"), "end", "share")))).alias("spans"),
    ).drop("row")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
