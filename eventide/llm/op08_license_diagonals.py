"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined with the k-grams of license templates. A hit votes for the
diagonal text position - template position; votes are added up by diagonal, neighbouring diagonals (words put in or left
out) are merged, and a merged stretch is verified word by word: how much of the template and how much of the stretch the
matched grams cover. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The base phrases and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Well-known sentences of public licenses, matched approximately.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
# Whole texts of short public licenses, names and years left out.
LICENSES = (
    (
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
        other dealings in the software""",
        "mit",
    ),
    (
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution this software is
        provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to
        the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the
        copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages
        including but not limited to procurement of substitute goods or services loss of use data or profits or business
        interruption however caused and on any theory of liability whether in contract strict liability or tort including
        negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
        damage""",
        "bsd",
    ),
    (
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
        the author disclaims all warranties with regard to this software including all implied warranties of merchantability and
        fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
        whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
        arising out of or in connection with the use or performance of this software""",
        "isc",
    ),
    (
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed
        to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of
        any kind either express or implied see the license for the specific language governing permissions and limitations under
        the license""",
        "apache-2.0",
    ),
    (
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation either version 3 of the license or at your option any later version this
        program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details you should have
        received a copy of the gnu general public license along with this program if not see https www gnu org licenses""",
        "gpl-3.0",
    ),
    (
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for
        any damages arising from the use of this software permission is granted to anyone to use this software for any purpose
        including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the
        origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this
        software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered
        source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice
        may not be removed or altered from any source distribution""",
        "zlib",
    ),
    (
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
        sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
        commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public
        at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights to this software under copyright law""",
        "public-domain",
    ),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals at most so far apart are one stretch: so many words put in or left out at one place. A diagonal lies within
#: its template's length of the text, so a stretch can't gather far places.
DRIFT = 3
#: A template's label needs this share of its words, in the k-grams of a stretch that are at least DENSE of its words.
COVER, DENSE = 0.6, 0.5


def _grams(texts: list[tuple[int, list[str]]]) -> list[tuple]:
    return [(no, at, words[at : at + k]) for no, words in texts for k in (min(K, len(words)),) for at in range(len(words) - k + 1)]


def scan(docs: DataFrame, phrases=PHRASES, templates=(*TEMPLATES, *LICENSES)) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One row a document row. Null and empty texts have no words, no labels and score 0. score: the largest share of a
    template's words found, 1 where a base phrase stands. The text's end is joined as a gram of its own, so a document
    without a hit still gives its row. A row is told apart by its place in the scan: repeated or null doc_ids do no harm.
    Very long texts are scanned whole; of templates that cover equally all labels are told; no rows give none. Other columns
    are ignored."""
    spark = docs.sparkSession
    base_n = len(phrases)
    texts = [(i, p.split()) for i, (p, _) in enumerate([*phrases, *templates])]
    grams = _grams(texts)
    # a few thousand rows, fixed by the templates
    tpl = spark.createDataFrame([(no, at, len(g), *(g + [None] * (K - len(g)))) for no, at, g in grams] + [(-1, 0, 1, "", None, None)],
                                "tpl int, at int, k int, ta string, tb string, tc string")
    tpl = tpl.withColumn("h", F.xxhash64("k", "ta", "tb", "tc"))
    sizes = spark.createDataFrame([(no, len(w), len(w) - min(K, len(w)) + 1) for no, w in texts] + [(-1, 1, 1)], "tpl int, words int, grams int")

    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u0137")))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    rows = rows.withColumn("_w", F.concat("_w", F.array(F.lit(""))))
    at = rows.select("_row", "doc_id", "_w", F.posexplode("_w").alias("pos", "a"))
    at = at.withColumn("b", F.get("_w", F.col("pos") + 1)).withColumn("c", F.get("_w", F.col("pos") + 2)).drop("_w")
    none = F.lit(None).cast("string")
    # every gram of two and of three words goes to the join, and the end of the text
    gram = lambda k, *words: F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), *words, *[none] * (K - k)).alias("h"))
    kinds = F.when(F.col("a") == "", F.array(gram(1, F.lit("")))).otherwise(F.array(gram(2, "a", "b"), gram(3, "a", "b", "c")))
    at = at.withColumn("_g", F.explode(kinds)).select("_row", "doc_id", "pos", "a", "b", "c", "_g.h")
    hits = at.join(F.broadcast(tpl), "h").filter(
        (F.col("a") == F.col("ta")) & ((F.col("k") < 2) | (F.col("b") == F.col("tb"))) & ((F.col("k") < 3) | (F.col("c") == F.col("tc")))
    )
    hits = hits.select("_row", "doc_id", "tpl", "at", "k", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    # votes by diagonal; equal phrases elsewhere in the text lie on diagonals of their own. A diagonal has no more votes
    # than its template has grams
    votes = hits.groupBy("_row", "doc_id", "tpl", "diagonal").agg(
        F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("k").alias("k"), F.collect_list("at").alias("ats")
    )
    # merge neighbours
    line = Window.partitionBy("_row", "tpl").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(line) > DRIFT) | (F.col("tpl") < base_n)
    merged = votes.withColumn("stretch", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    places = lambda e: F.size(F.array_distinct(F.flatten(e)))
    each = F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1))
    merged = merged.withColumn("_t", F.flatten(each)).withColumn("_d", F.transform("_t", lambda a: a + F.col("diagonal")))
    merged = merged.groupBy("_row", "doc_id", "tpl", "stretch").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").alias("start"), (F.max("hi") + F.first("k") - F.min("lo")).alias("span"), places(F.collect_list("_t")).alias("of_template"), places(F.collect_list("_d")).alias("of_text")
    )
    # verify spans
    checked = merged.join(F.broadcast(sizes), "tpl").withColumn("share", F.col("of_template") / F.col("words"))
    exact = F.col("tpl").between(0, base_n - 1) & (F.col("votes") == F.col("grams"))
    near = (F.col("tpl") >= base_n) & (F.col("share") >= COVER) & (F.col("of_text") >= DENSE * F.col("span"))
    label = F.element_at(F.array(*[F.lit(x) for _, x in [*phrases, *templates]]), F.greatest(F.lit(1), F.col("tpl") + 1))
    out = checked.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("tpl") == -1, F.col("start"))).cast("long").alias("n_words"),
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact, label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact | near, label))), ",").alias("labels"),
        F.coalesce(F.max(F.when(exact | (F.col("tpl") >= base_n), F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return out.drop("_row")
