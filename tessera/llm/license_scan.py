"""License scans by diagonal voting, in DataFrame functions only.

Every window of K words of a text is hashed and joined with the windows of the license templates (a fixed list, so the
join is a broadcast one), the words themselves confirming the hash. A hit votes for the diagonal (place in the text
less place in the template). A diagonal with all of a template's windows is an exact copy that starts there; votes of
neighbouring diagonals (at most NEAR words put in or left out) make one candidate copy.

Each candidate's span is verified: its score is the share of the template's words that its windows cover, each word
once, less half of the words in the span that no window covers, and it must reach LEAST_SCORE. Templates share much of
their wording, so spans compete for the words of the text: each word goes to the best span over it (most matched words
net of the others, then the greater score, then the first template), and a span counts only if most of its words are its
own. The score of a text is the best of its spans that count or fell short of LEAST_SCORE. So a notice
of version 3 is not one of version 2, and a short phrase inside a long notice keeps the long notice whole. The base
phrases count wherever their words stand.

One row for each text, with an empty first word, passes the join beside the hits and carries the word count, so that
texts are read once and only hits are shuffled, by the row they come from. The words of a span are no more than about
twice those of its template, so the contest's rows grow with the licensed part of the texts.

Defined cases: a null or empty text has no words and no places (first_word and last_word null, labels empty, score 0);
a null doc_id is kept; repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
NEAR = 2  # words put in or left out between two diagonals that count as one copy
LEAST_SCORE = 0.7
# The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Names and notices of well-known licenses, as their publishers word them, and their labels.
MORE = (
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("gnu general public license", "gpl"),
    ("gnu general public license version 1", "gpl-1"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu lesser general public license version 2 1", "lgpl-2.1"),
    ("gnu lesser general public license version 3", "lgpl-3"),
    ("gnu library general public license version 2", "lgpl-2"),
    ("gnu affero general public license", "agpl"),
    ("gnu affero general public license version 3", "agpl-3"),
    ("mozilla public license version 1 1", "mpl-1.1"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("apache software license version 1 1", "apache-1.1"),
    ("apache license version 2 0", "apache-2"),
    ("eclipse public license version 1 0", "epl-1"),
    ("eclipse public license version 2 0", "epl-2"),
    ("boost software license version 1 0", "bsl-1"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("under cc by sa", "cc-by-sa"),
    ("under cc by 4 0", "cc-by"),
    ("under cc by nc 4 0", "cc-by-nc"),
    ("dedicated to the public domain under cc0 1 0", "cc0"),
    ("""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""", "gpl-2"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "gpl-3"),
    ("""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
    published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""", "lgpl-2.1"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
    published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "lgpl-3"),
    ("""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
    published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "agpl-3"),
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
    "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
    distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
    CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
    SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
    above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
    WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
    LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
    WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
    SOFTWARE.""", "isc"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
    met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution.""", "bsd"),
    ("""Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
    software without specific prior written permission.""", "bsd-3"),
    ("""THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
    TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", "bsd"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
    obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
    distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
    the License for the specific language governing permissions and limitations under the License.""", "apache-2"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
    You can obtain one at http://mozilla.org/MPL/2.0/.""", "mpl-2"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
    arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
    applications, and to alter it and redistribute it freely, subject to the following restrictions""", "zlib"),
    ("""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
    covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
    works of the Software""", "bsl-1"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
    distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
    means.""", "unlicense"),
)
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CARRIER = "t1 string, t2 string, t3 string, template int, place int, n_template int, label string, base boolean"


def template_words(phrase: str) -> list[str]:
    """The words of a template, as those of a text."""
    return [w for w in re.split(_SPLIT, phrase.translate(str.maketrans(_UPPER, _LOWER))) if w]


def templates(spark: SparkSession, base=BASE, more=MORE) -> DataFrame:
    """(hash, t1, t2, t3, template, place, n_template, label, base): a row for each window of each template, and the carrier row."""
    rows = [("", "", "", -1, 0, 1, "", False)]
    for n, (phrase, label) in enumerate((*base, *more)):
        words = template_words(phrase)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {phrase!r}")
        rows += [(*words[at : at + K], n, at, len(words), label, n < len(base)) for at in range(len(words) - K + 1)]
    table = spark.createDataFrame(rows, _CARRIER)
    return table.withColumn("hash", F.when(F.col("template") < 0, F.lit(0)).otherwise(F.xxhash64("t1", "t2", "t3")))


def _covered(places) -> F.Column:
    """How many words the windows at these places cover, each once."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + K - 1)))))


def scan(docs: DataFrame, base=BASE, more=MORE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs(doc_id, text)."""
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), _SPLIT), "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.concat(F.array(F.lit("")), words).alias("w"))
    texts = texts.select("doc_id", "row", (F.size("w") - 1).cast("long").alias("n_words"), "w")  # ahead of the windows, which then leave w behind
    windows = texts.select(
        "doc_id", "row", "n_words",
        F.posexplode(F.arrays_zip(F.col("w").alias("w1"), F.slice("w", 2, F.size("w")).alias("w2"), F.slice("w", 3, F.size("w")).alias("w3"))).alias("at", "x"),
    )
    hashed = windows.select("doc_id", "row", "n_words", "at", "x.w1", "x.w2", "x.w3", F.when(F.col("at") == 0, F.lit(0)).otherwise(F.xxhash64("x.w1", "x.w2", "x.w3")).alias("hash"))
    same = (F.col("template") < 0) & (F.col("at") == 0) | (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3"))
    votes = hashed.join(F.broadcast(templates(docs.sparkSession, base, more)), "hash").where(same)
    whole = ["row", "doc_id", "n_words"]
    hits = votes.select(*whole, "template", "n_template", "label", "base", "place", (F.col("at") - 1).cast("int").alias("at"), (F.col("at") - 1 - F.col("place")).cast("long").alias("start")).repartition("row")
    # neighbouring diagonals of one template are one candidate
    own = Window.partitionBy("row", "template").orderBy("start", "place")
    gap = F.coalesce((F.col("start") - F.lag("start").over(own) > NEAR).cast("int"), F.lit(0))
    grouped = hits.withColumn("gap", gap).withColumn("copy", F.sum("gap").over(own))
    diagonals = grouped.groupBy(*whole, "template", "n_template", "label", "base", "copy", "start").agg(F.collect_set("place").alias("places"), F.collect_set("at").alias("ats"))
    exact = F.col("base") & (F.size("places") == F.col("n_template") - K + 1)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    copies = diagonals.groupBy(*whole, "template", "n_template", "label", "base", "copy").agg(
        flat("places").alias("places"), flat("ats").alias("ats"),
        F.count_if(exact).alias("n_base"), F.min(F.when(exact, F.col("start"))).alias("first"), F.max(F.when(exact, F.col("start"))).alias("last"),
    )
    matched = F.least(_covered(F.col("places")), _covered(F.col("ats")))
    spans = copies.select(
        *whole, "template", "n_template", "label", "base", "n_base", "first", "last", F.array_min("ats").alias("lo"), (F.array_max("ats") + K - 1).alias("hi"),
        F.when(F.col("template") < 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (matched - (F.array_max("ats") + K - F.array_min("ats") - _covered(F.col("ats"))) / 2) / F.col("n_template"))).alias("score"),
    )
    # each word of the text goes to the best of the spans over it; other rows pass with a word of their own
    good = F.col("score") >= LEAST_SCORE
    rank = F.struct((F.col("score") * F.col("n_template")).alias("net"), "score", (-F.col("template")).alias("order"))
    over = spans.withColumn("word", F.explode(F.when(good, F.sequence("lo", "hi")).otherwise(F.array((-F.col("template") - 2).cast("int")))))
    best = F.max(rank).over(Window.partitionBy("row", "word"))
    owned = over.withColumn("own", (rank == best).cast("int")).groupBy(*whole, "template", "label", "n_base", "first", "last", "lo", "hi", "score").agg(F.sum("own").alias("own"))
    kept = (F.col("n_base") > 0) | good & (2 * F.col("own") > F.col("hi") - F.col("lo") + 1)
    joined = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    return owned.groupBy(*whole).agg(
        F.sum("n_base").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
        joined(F.col("n_base") > 0).alias("base_labels"), joined((F.col("template") >= 0) & kept).alias("labels"), F.max(F.when(kept | ~good, F.col("score"))).alias("score"),
    ).drop("row")
