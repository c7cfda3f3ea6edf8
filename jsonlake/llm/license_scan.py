"""License scans by diagonal voting, in DataFrame operations only.

Every rolling pair of words of every text is hashed and joined to the positions
of the same pair in the templates (a third word, where the template has one,
must agree too). A hit votes for the diagonal ``text position - template
position``. Votes are summed by diagonal, diagonals at most ``gap`` apart are
merged, and a merged span counts if the words it covers agree with the template
on enough of its length. The template side is broadcast: its size is that of
the template constants below, whatever the input.

The phrases of ``PHRASES`` use the same join: each must have all of its pairs on
one diagonal, so every diagonal is one place.

Edge cases: a null text is the empty text (0 words, no labels, score 0); rows
that share a doc_id are told apart by the hash of their text, and equal rows get
equal results; a null doc_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, stored, work_dir

#: Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Publicly known licence notices, by label. Several forms of one licence share a label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "Licensed under CC BY"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
]

#: What separates words once A-Z count as word characters: ASCII that is neither digit nor letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_TEMPLATE_WORDS = 100_000


def template_words(text: str) -> list[str]:
    import re

    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]


def template_table(spark, templates, phrases) -> DataFrame:
    """One row per rolling pair: hash, words, template number, position, size, label, base."""
    rows, total = [], 0
    for number, (label, text, base) in enumerate([(lab, t, False) for lab, t in templates] + [(lab, t, True) for t, lab in phrases.items()]):
        words = template_words(text)
        total += len(words)
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        for i in range(len(words) - 1):
            third = words[i + 2] if i + 2 < len(words) else None
            rows.append((words[i], words[i + 1], third, number, i, len(words), label, base))
    if total > MAX_TEMPLATE_WORDS:
        raise ValueError("the template side is broadcast; it must stay small")
    kind = T.StructType([T.StructField("t0", T.StringType()), T.StructField("t1", T.StringType()), T.StructField("t2", T.StringType()), T.StructField("tpl", T.IntegerType()), T.StructField("tpos", T.IntegerType()), T.StructField("tlen", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType())])
    return spark.createDataFrame(rows, kind).withColumn("th", F.xxhash64(F.lower("t0"), F.lower("t1")))


def hits(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """All agreeing (text position, template position) pairs, by document."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), SEPARATORS), "")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tkey"), words.alias("ws"))
    at = F.explode(F.sequence(F.lit(0), F.size("ws") - 2)).alias("pos")
    pairs = rows.where(F.size("ws") >= 2).select("doc_id", "tkey", "ws", at)
    pairs = pairs.select("doc_id", "tkey", "pos", F.get("ws", F.col("pos")).alias("w0"), F.get("ws", F.col("pos") + 1).alias("w1"), F.get("ws", F.col("pos") + 2).alias("w2"))
    same = (F.xxhash64(F.lower("w0"), F.lower("w1")) == F.col("th")) & (ascii_lower(F.col("w0")) == F.col("t0")) & (ascii_lower(F.col("w1")) == F.col("t1")) & (F.col("base") | F.col("t2").isNull() | (ascii_lower(F.col("w2")) == F.col("t2")))
    return pairs.join(F.broadcast(templates), same).select("doc_id", "tkey", "tpl", "tlen", "label", "base", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diag"))


def spans(found: DataFrame, gap: int, min_words: int, min_share: float) -> DataFrame:
    """Verified spans: doc_id, tkey, label, start, end (words from 0), matched words, share.

    Diagonals of one document and template at most ``gap`` apart become one span.
    """
    keys = ["doc_id", "tkey", "tpl", "tlen", "label"]
    votes = found.where(~F.col("base")).groupBy(*keys, "diag").agg(F.collect_set("pos").alias("ps"))
    along = Window.partitionBy(*keys).orderBy("diag")
    apart = F.coalesce(F.col("diag") - F.lag("diag").over(along) > gap, F.lit(True)).cast("int")
    grouped = votes.withColumn("apart", apart).withColumn("grp", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = grouped.groupBy(*keys, "grp").agg(F.array_distinct(F.flatten(F.collect_list("ps"))).alias("ps"))
    covered = F.size(F.array_union("ps", F.transform("ps", lambda p: p + 1)))
    out = merged.select("doc_id", "tkey", "tlen", "label", F.array_min("ps").alias("start"), (F.array_max("ps") + 1).alias("end"), covered.alias("words"))
    out = out.withColumn("share", F.col("words") / (F.col("end") - F.col("start") + 1))
    return out.where((F.col("words") >= F.least(F.col("tlen"), F.lit(min_words))) & (F.col("share") >= min_share))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, gap: int = 3, min_words: int = 6, min_share: float = 0.8) -> DataFrame:
    """Labels of every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is the share of a document's words inside verified spans and phrases, capped at 1.
    """
    spark = docs.sparkSession
    # Hits are few; written once, both votes below read them instead of scanning all texts again.
    found = stored(hits(docs, template_table(spark, templates, phrases)), work_dir(spark, "licenses") + "/hits")
    # Phrases: a diagonal with all pairs is one place.
    places = found.where("base").groupBy("doc_id", "tkey", "tpl", "tlen", "label", "diag").agg(F.countDistinct("pos").alias("n")).where(F.col("n") == F.col("tlen") - 1)
    base = places.select("doc_id", "tkey", "label", F.col("diag").alias("start"), (F.col("diag") + F.col("tlen") - 1).alias("end"), F.lit(True).alias("base"))
    other = spans(found, gap, min_words, min_share).select("doc_id", "tkey", "label", "start", "end", F.lit(False).alias("base"))
    every = base.unionByName(other).groupBy(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key")).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.array_sort(F.collect_set(F.struct("start", "end", "label"))).alias("spans"),
    )
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SEPARATORS), "")).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tkey"), n_words.alias("n_words"))
    # The union of the spans, from sorted spans: each adds what lies beyond the furthest end so far.
    inside = F.aggregate("spans", F.struct(F.lit(-1).alias("to"), F.lit(0).alias("n")), lambda acc, s: F.struct(F.greatest(acc["to"], s["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"] - 1))).alias("n")))["n"]
    out = rows.join(every, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tkey") == F.col("__key")), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.when(F.col("spans").isNull() | (F.col("n_words") == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), inside / F.col("n_words"))).alias("score"),
        "spans",
    )
