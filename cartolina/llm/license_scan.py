"""License scans by diagonal voting, in DataFrame operations only.

Every rolling hash of k words of every text is joined to the positions at which templates have it. A hit's
diagonal is its place in the text less its place in the template: hits of one copied passage share it, and words
put in or left out move it a little. Votes are counted by diagonal, neighbouring diagonals merge, and
a merged span counts if it covers enough of its template without being stretched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed by the query's contract: phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as their licenses print them.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "mpl-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "licensed-under": "Licensed under the",
    "rights-reserved": "All rights reserved",
    "spdx": "SPDX License Identifier",
}

#: Words in a hash: of templates, and of phrases, the shortest of which has two words.
K, PHRASE_K = 3, 2
SLACK = 8
COVER = 0.5
STRETCH = 1.5
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """Lower case; the two letters beyond ASCII that would turn into ASCII ones first become other letters."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("ı")), F.lit("K"), F.lit("å")))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_lowered(text), GAP), "")


def _gram(parts: list[Column]) -> Column:
    """Two independent hashes, so that a hit means equal words for all purposes."""
    return F.struct(F.xxhash64(*parts).alias("h"), F.hash(*parts).alias("g"))


def _rolling(words: Column, k: int) -> Column:
    at = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), _gram([words[i + j] for j in range(k)]).alias("gram")))


def _grams(text: Column) -> Column:
    """All rolling hashes with their places; the split is done once, as a lambda's variable holds its words."""
    return F.transform(F.array(_words(text)), lambda w: F.concat(_rolling(w, PHRASE_K), _rolling(w, K)))[0]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _known(spark, templates: dict[str, str], phrases: dict[str, str]) -> DataFrame:
    """Each k-gram of each notice with its place there: constants of a few kB."""
    parts = []
    for k, notices in ((K, [(label, notice) for label, notice in templates.items()]), (PHRASE_K, [(label, phrase) for phrase, label in phrases.items()])):
        rows = []
        for label, notice in notices:
            words = [w for w in re.split(r"[^0-9a-z]+", notice.lower()) if w]
            rows += [(label, k, len(words) - k + 1, i, words[i : i + k]) for i in range(len(words) - k + 1)]
        table = spark.createDataFrame(rows, "label string, k int, grams int, t_pos int, words array<string>")
        parts.append(table.select("label", "k", "grams", "t_pos", _gram([F.col("words")[j] for j in range(k)]).alias("gram")))
    return parts[0].unionByName(parts[1])


def _votes(docs: DataFrame, id_col: str, text_col: str, templates: dict[str, str], phrases: dict[str, str]) -> DataFrame:
    """Hits by text, notice and diagonal: how far they reach, and which of the notice's places they hit."""
    rolling = _keyed(docs, id_col, text_col).select("doc_id", "text_hash", F.inline(_grams(F.col("text"))))
    hits = rolling.join(F.broadcast(_known(docs.sparkSession, templates, phrases)), "gram")
    by = ["doc_id", "text_hash", "label", "k", "grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")]
    return hits.groupBy(*by).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("t_pos").alias("at"))


def _spans(votes: DataFrame, slack: int, cover: float) -> DataFrame:
    """Merged and verified. A diagonal with all its notice's votes is a copy of its own and merges with no other; a phrase's must have all.

    Other neighbouring diagonals merge as long as their span isn't stretched: beyond that the next span begins, so that copies in a row stay apart.
    """
    phrase, whole = F.col("k") == PHRASE_K, (F.col("k") == PHRASE_K) | (F.size("at") == F.col("grams"))
    along = Window.partitionBy("doc_id", "text_hash", "label", "k").orderBy("diagonal")
    apart = F.coalesce((whole | F.lag(whole).over(along) | (F.col("diagonal") - F.lag("diagonal").over(along) > slack)).cast("int"), F.lit(0))
    runs = votes.withColumn("apart", apart).withColumn("run", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    held = runs.groupBy("doc_id", "text_hash", "label", "k", "grams", "run").agg(F.array_sort(F.collect_list(F.struct("diagonal", "lo", "hi", "at"))).alias("parts"))
    longest = STRETCH * (F.col("grams") + K - 1) + slack

    def ended(x: Column) -> Column:
        enough = F.when(phrase, F.size(x["at"]) == F.col("grams")).otherwise(F.size(x["at"]) / F.col("grams") >= cover)
        span = F.struct(x["lo"].cast("long").alias("first_word"), (x["hi"] + F.col("k") - 1).cast("long").alias("last_word"), F.size(x["at"]).alias("votes"))
        return F.when(x["lo"].isNotNull() & enough, F.concat(x["done"], F.array(span))).otherwise(x["done"])

    def merged(x: Column, y: Column) -> Column:
        lo, hi = F.least(x["lo"], y["lo"]), F.greatest(x["hi"], y["hi"])
        both = F.struct(lo.alias("lo"), hi.alias("hi"), F.array_union(x["at"], y["at"]).alias("at"), x["done"].alias("done"))
        new = F.struct(y["lo"].alias("lo"), y["hi"].alias("hi"), y["at"].alias("at"), ended(x).alias("done"))
        return F.when(x["lo"].isNotNull() & (hi - lo + F.col("k") <= longest), both).otherwise(new)

    none = F.lit(None).cast("int")
    start = F.struct(none.alias("lo"), none.alias("hi"), F.array().cast("array<int>").alias("at"), F.array().cast("array<struct<first_word:bigint,last_word:bigint,votes:int>>").alias("done"))
    spans = held.select("doc_id", "text_hash", "label", phrase.alias("phrase"), "grams", F.inline(F.aggregate("parts", start, merged, ended)))
    return spans.select("doc_id", "text_hash", "label", "phrase", "first_word", "last_word", "votes", (F.col("votes") / F.col("grams")).alias("cover"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """Verified spans: doc_id, text_hash, label, phrase (a phrase's place, not a template's), first_word, last_word, votes, cover (share of the template's k-grams).

    Rows that repeat an id and its text count once.
    """
    return _spans(_votes(docs, id_col, text_col, templates, PHRASES), slack, cover)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of a-z, 0-9 and characters beyond ASCII once A-Z are lower-cased; a null or empty text
    has none, so no places, null first_word and last_word, empty labels and score 0. A phrase stands where all its
    hashes vote for one diagonal, which is its start. The score is the best span's cover, and at least a half where a phrase stands.
    Repeated rows each get the same result; an empty table gives no rows; other columns are ignored.
    """
    spans = _spans(_votes(docs, id_col, text_col, templates, phrases), SLACK, COVER)
    start, base = F.when(F.col("phrase"), F.col("first_word")), F.when(F.col("phrase"), F.col("label"))
    found = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"), F.array_sort(F.collect_set(base)).alias("base"), F.array_sort(F.collect_set("label")).alias("all"), F.max(F.when(F.col("phrase"), 0.5).otherwise(F.col("cover"))).alias("score")
    )
    told = _keyed(docs, id_col, text_col).select("doc_id", "text_hash", F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    both = told.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return both.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
