"""License scans by diagonal voting.

Every rolling k-gram of a text's words is hashed and Spark-joined to the positions of the
templates' k-grams. A match at text position p and template position t votes for the
diagonal p - t. Votes are summed per (text, template, diagonal) within each task before
they are shuffled; neighbouring diagonals, as inserted or missing words make them, are merged
into spans, and a span is verified by the share of the template's words that its matches
cover. Phrases are templates that must be covered whole, on one diagonal; notices are longer
templates that must be covered to a given share.

The template side of the join is a fixed table whose size is checked (``MAX_TEMPLATE_GRAMS``);
beyond that the join is left to a shuffle. The text side is never shuffled: only matches are.
Words are compared through two independent 64-bit hashes of the k-gram.

Defined results: a null text counts as empty; a text with fewer words than k has no places;
repeated rows are separate rows (a row is known by its task and its place there, never by
doc_id); a null doc_id stays null; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Sentences by which a license's own text or notice is known, and their labels.
NOTICES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "apache-2.0": "licensed under the apache license version 2 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "mit-released": "released under the mit license",
}

#: Words are runs of digits, lower-case letters and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASE_GRAM = 2
NOTICE_GRAM = 4
#: Share of a notice's words that a span's matches must cover.
COVERED = 0.8
#: Diagonals this near to each other belong to one span.
NEIGHBOUR = 3
MAX_TEMPLATE_GRAMS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word, 7)
        return got


def _grams(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two rolling hashes of every k words in a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a = np.full(n, np.uint64(k))
    b = np.full(n, np.uint64(k * 31))
    for i in range(k):
        x = hashes[i : i + n]
        a = (a ^ x) * _MIX
        a ^= a >> np.uint64(29)
        b = (b + x) * _MIX2
        b ^= b >> np.uint64(31)
    return a, b


def template_grams(phrases: Mapping[str, str], notices: Mapping[str, str], phrase_gram: int = PHRASE_GRAM, notice_gram: int = NOTICE_GRAM) -> list[tuple]:
    """(gram, check, template, place, length, whole) for every k-gram of every template."""
    hashes, out = _WordHashes(), []
    for whole, k, texts in ((True, phrase_gram, list(phrases)), (False, notice_gram, list(notices.values()))):
        for i, text in enumerate(texts):
            own = words_of(text)
            if len(own) < k:
                raise ValueError(f"a template needs {k} words at least: {text!r}")
            a, b = _grams(np.array([hashes[w] for w in own], np.uint64), k)
            number = i if whole else len(phrases) + i
            out += [(int(x), int(y), number, place, len(own), whole) for place, (x, y) in enumerate(zip(a.view(np.int64), b.view(np.int64), strict=True))]
    return out


def _roll(gram_sizes: Sequence[int]):
    """Per text a row with its number of words (place -1), then a row for every k-gram."""
    names = ["row_no", "doc_id", "place", "gram", "check"]

    def run(batches):
        hashes = _WordHashes()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = pc.ascii_lower(pc.fill_null(batch.column(1), "")).cast(pa.binary())
            parts, rows = [], 0

            def give(parts):
                row_no, doc_id, place, gram, check = zip(*parts, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(row_no)), pa.concat_arrays(doc_id), pa.array(np.concatenate(place)), pa.array(np.concatenate(gram).view(np.int64)), pa.array(np.concatenate(check).view(np.int64))], names=names)

            for i, text in enumerate(texts):
                own = WORD.findall(text.as_py())
                h = np.array(list(map(hashes.__getitem__, own)), np.uint64)
                head = (np.array([row]), batch.column(0).slice(i, 1), np.array([-1]), np.array([len(own)], np.uint64), np.zeros(1, np.uint64))
                parts.append(head)
                for k in gram_sizes:
                    a, b = _grams(h, k)
                    if len(a):
                        parts.append((np.full(len(a), row), pa.nulls(len(a), pa.int64()), np.arange(len(a)), a, b))
                        rows += len(a)
                row += 1
                if rows > 250_000:
                    yield give(parts)
                    parts, rows = [], 0
            if parts:
                yield give(parts)

    return run


def scan_licenses(
    spark: SparkSession,
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    notices: Mapping[str, str] = NOTICES,
    covered: float = COVERED,
    neighbour: int = NEIGHBOUR,
) -> tuple[DataFrame, DataFrame]:
    """``spans(row_no, template, label, whole, first, last, score)`` and ``rows(row_no, doc_id, n_words, spans)``.

    ``first`` and ``last`` are the span's first and last word. ``rows`` has one row per
    document, with its spans as an array.
    """
    grams = template_grams(phrases, notices)
    names = [*phrases.values(), *notices]
    sizes = sorted({PHRASE_GRAM, NOTICE_GRAM})
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stream = narrow.mapInArrow(_roll(sizes), "row_no long, doc_id long, place long, gram long, check long")
    templates = spark.createDataFrame(grams, "t_gram long, t_check long, template int, t_place int, t_words int, whole boolean")
    if len(grams) <= MAX_TEMPLATE_GRAMS:
        templates = F.broadcast(templates)
    on = (F.col("gram") == F.col("t_gram")) & (F.col("check") == F.col("t_check")) & (F.col("place") >= 0)
    met = stream.join(templates, on, "left").where("template is not null or place < 0")
    gram_of = F.when(F.col("whole"), PHRASE_GRAM).otherwise(NOTICE_GRAM)
    # votes of a diagonal: the template places that it matches
    votes = met.groupBy("row_no", "template", (F.col("place") - F.col("t_place")).alias("diagonal")).agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("place") < 0, F.col("gram"))).alias("n_words"),
        F.first("whole").alias("whole"),
        F.first("t_words").alias("t_words"),
        F.first(gram_of).alias("k"),
        F.collect_set("t_place").alias("at"),
        F.min("place").alias("low"),
        F.max("place").alias("high"),
    )
    hit = F.struct("template", "diagonal", "whole", "t_words", "k", F.array_sort("at").alias("at"), "low", "high")
    rows = votes.groupBy("row_no").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("template").isNotNull(), hit))).alias("hits"),
    )
    spans = rows.select("row_no", "doc_id", "n_words", _spans(names, covered, neighbour)("hits").alias("spans"))
    flat = spans.select("row_no", "doc_id", F.inline("spans"))
    return flat, spans


def merge_diagonals(hits: list[dict], names: Sequence[str], covered: float, neighbour: int) -> list[dict]:
    """Spans of one text from its sorted diagonals.

    A phrase's diagonal stands if it matches all the phrase's places. Of a notice, diagonals no
    further than ``neighbour`` apart whose matched parts follow each other are merged; the span
    stands if the places that they match cover ``covered`` of the notice's words, and its score is
    that share.
    """
    out, open_span = [], None

    def words(hit) -> set[int]:
        return {p + i for p in hit["at"] for i in range(hit["k"])}

    def close():
        nonlocal open_span
        if open_span is not None:
            score = len(open_span["words"]) / open_span["t_words"]
            if score >= covered:
                out.append({"template": open_span["template"], "label": names[open_span["template"]], "whole": False, "first": open_span["low"], "last": open_span["high"], "score": score})
        open_span = None

    for hit in hits:
        if hit["whole"]:
            if len(hit["at"]) == hit["t_words"] - hit["k"] + 1:
                out.append({"template": hit["template"], "label": names[hit["template"]], "whole": True, "first": hit["diagonal"], "last": hit["diagonal"] + hit["t_words"] - 1, "score": 1.0})
            continue
        last = hit["high"] + hit["k"] - 1
        if open_span is not None and open_span["template"] == hit["template"] and hit["diagonal"] - open_span["diagonal"] <= neighbour and hit["low"] - open_span["high"] <= hit["t_words"]:
            open_span["words"] |= words(hit)
            open_span["diagonal"] = hit["diagonal"]
            open_span["low"], open_span["high"] = min(open_span["low"], hit["low"]), max(open_span["high"], last)
        else:
            close()
            open_span = {"template": hit["template"], "t_words": hit["t_words"], "diagonal": hit["diagonal"], "words": words(hit), "low": hit["low"], "high": last}
    close()
    return out


def _spans(names: Sequence[str], covered: float, neighbour: int):
    kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("whole", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<template:int,label:string,whole:boolean,first:long,last:long,score:double>>")
    def spans(hits: pa.Array) -> pa.Array:
        return pa.array([merge_diagonals(x, names, covered, neighbour) if x else [] for x in hits.to_pylist()], kind)

    return spans


def label_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: places of base phrases, their labels and the method's, and a score.

    ``score`` is the best coverage of any span, 0 without spans.
    """
    _, rows = scan_licenses(spark, docs)
    base = F.filter("spans", lambda s: s["whole"])
    of = lambda spans, field: F.transform(spans, lambda s: s[field])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(of(spans, "label"))), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(of(base, "first")).alias("first_word"),
        F.array_max(of(base, "first")).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(of(F.col("spans"), "score")), F.lit(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_documents(spark, table(spark, sf_dir, "documents"))
