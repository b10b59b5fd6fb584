"""License scans by diagonal voting, with DataFrame functions only.

Every run of k words of a text is hashed and joined to the places of the templates where the same words stand. Hits of
one template with the same difference of places (a diagonal) vote together; neighbouring diagonals, as left by inserted
or missing words, are merged; a span counts if its votes cover enough of the template. Short phrases (k = 2) must be
covered wholly on one diagonal, so they are found exactly where their words stand consecutively.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm.common import table

#: Label and phrase.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Label and the words by which a license's notice is known.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Label and the whole text of short licenses.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
]
#: Templates of up to so many words are broadcast; more are joined by a shuffle.
MOST_TEMPLATE_WORDS = 200_000


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z. The two letters whose lower case would be a Latin one are put aside first; they stay word characters."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ķ")), F.lit("İ"), F.lit("į")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(frame: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """frame has words; a row per word with pos, w0, w1 ... and a hash h<k> of the k words from there (null near the end)."""
    most = max(sizes)
    out = frame.select("*", F.posexplode_outer("words").alias("pos", "w0"))
    out = out.withColumns({f"w{i}": F.get("words", F.col("pos") + i) for i in range(1, most)}).drop("words")
    return out.withColumns({f"h{k}": F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(*(f"w{i}" for i in range(k)))) for k in sizes})


def template_grams(spark: SparkSession, templates: list[tuple[int, str]], k: int) -> DataFrame:
    frame = grams(spark.createDataFrame(templates, "tid int, text string").select("tid", words_of(F.col("text")).alias("words")), (k,))
    return frame.where(F.col(f"h{k}").isNotNull()).select(F.col("tid").alias(f"tid{k}"), F.col("pos").alias(f"at{k}"), F.col(f"h{k}").alias(f"t{k}"), *(F.col(f"w{i}").alias(f"t{k}_{i}") for i in range(k)))


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES + TEXTS, k: int = 4, shift: int = 3, coverage: float = 0.6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of `docs`: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words: runs of a-z, 0-9 and characters outside ASCII, after lower-casing A-Z. n_base: places of the phrases, with the
    smallest and largest start (null if none); base_labels and labels: sorted, joined by commas, empty if none; score: the
    largest covered share of a template (1 for a phrase); spans: label, start, end (past the last word) and share of what
    was found. Null text: empty. Repeated rows each get a result, a null key is kept, an empty table gives an empty
    result, other columns are dropped. No text is cut. A place of a template votes once in a span, whatever its diagonal. Rows
    are told apart by their place in `docs`, so a `docs` with shuffles of its own is best written to a table first.
    """
    spark = docs.sparkSession
    plain = lambda t: re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", t).strip()
    named = [(label, plain(t), n) for own, n in ((phrases, 2), (notices, k)) for label, t in own]
    small = sum(len(t.split()) for _, t, _ in named) <= MOST_TEMPLATE_WORDS
    held = F.broadcast if small else lambda x: x
    known = spark.createDataFrame([(i, label, n, max(1, len(t.split()) - n + 1)) for i, (label, t, n) in enumerate(named)], "tid int, label string, k int, n_grams int")
    short = template_grams(spark, [(i, t) for i, (_, t, n) in enumerate(named) if n == 2], 2)
    long = template_grams(spark, [(i, t) for i, (_, t, n) in enumerate(named) if n != 2], k)
    frame = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    rows = grams(frame.withColumn("n_words", F.size("words")), (2, k))
    joined = rows
    for n, t in ((2, short), (k, long)):
        same = [F.col(f"h{n}") == F.col(f"t{n}"), *(F.col(f"w{i}") == F.col(f"t{n}_{i}") for i in range(n))]
        joined = joined.join(held(t), same, "left")
    met = joined.where(F.coalesce(F.col("pos"), F.lit(0)).eqNullSafe(0) | F.col("tid2").isNotNull() | F.col(f"tid{k}").isNotNull())
    hit = lambda n: F.struct(F.col(f"tid{n}").alias("tid"), (F.col("pos") - F.col(f"at{n}")).alias("diagonal"), F.col(f"at{n}").alias("at"))
    hits = met.select("row", "key", "n_words", "pos", F.inline(F.array(hit(2), hit(k))))
    votes = hits.groupBy("row", "key", "n_words", "tid", "diagonal").agg(F.collect_set("at").alias("voted"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    votes = votes.join(held(known), "tid", "left")
    own = Window.partitionBy("row", "tid").orderBy("diagonal")
    apart = F.when((F.col("k") != 2) & (F.col("diagonal") - F.lag("diagonal").over(own) <= shift), 0).otherwise(1)
    spans = votes.withColumn("_new", apart).withColumn("island", F.sum("_new").over(own))
    spans = spans.groupBy("row", "key", "n_words", "tid", "label", "k", "n_grams", "island").agg(F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).alias("votes"), F.min("first").alias("start"), (F.max("last") + F.max("k")).alias("end"), F.min("diagonal").alias("diagonal"))
    spans = spans.withColumn("share", F.least(F.lit(1.0), F.col("votes") / F.col("n_grams")))
    base = (F.col("k") == 2) & (F.col("votes") == F.col("n_grams"))
    full = (F.col("k") != 2) & (F.col("share") >= coverage) & (F.col("end") - F.col("start") <= 2 * (F.col("n_grams") + k))
    out = spans.groupBy("row", "key", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | full, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base | (F.col("k") != 2), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(base | full, F.struct("label", "start", "end", "share")))).alias("spans"),
    )
    return out.select(F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
