"""Licence notices per paragraph: trained n-gram classifier, confirmed against templates (DataFrame functions only).

Paragraphs are the lines of a text, and, as notices are wrapped, the runs of
``WINDOW`` consecutive lines that start at every ``STEP``-th one, of which lines
of at most ``WRAPPED`` characters take part (a longer line is a paragraph of its
own).  Words are runs of letters and digits, so comment signs at the ends of
lines do not part the words of a notice.  Multinomial logistic regression (MLlib)
over the word pairs of the licence templates tells the families and the
class of everything else; it is fitted on the templates, whole and in parts,
alone and inside ordinary text, and on the ordinary lines of all texts, equal
ones as one weighted row.  Half of these lines, by their hash, is held out and
calibrates the unknown class: the family must be likelier than nearly all of
them reach.  A
prediction is confirmed if the paragraph holds enough of the word pairs of a
template of the family.  A paragraph with a prediction may name more families:
each of which it holds nearly a whole template, and nearly all of its word
pairs that no other family has, is confirmed as well.  Runs of lines give only confirmed families
that none of their lines gives.

Every word pair of every text meets the pairs of the templates in a hash join
(the templates are a fixed list, so that side is bounded); paragraphs without
any have no evidence and are unknown.  The score of a paragraph is the sum of
its pairs' weights, so nothing but a few rows per licence paragraph is shuffled.
A run without a word pair that a single family has is left out before.

Defined cases: null and empty texts have no notices; rows with one (doc_id,
text) are one document; null ids are kept apart by their texts; extra columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import Scratch

#: Notices by family (fixed values: the wording of published licences and usual notices).
TEMPLATES = {
    "mit": [
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
        "SPDX-License-Identifier: MIT"],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "the GNU General Public License version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "SPDX-License-Identifier: LGPL-2.1-only"],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC"],
    "epl": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "which accompanies this distribution",
        "SPDX-License-Identifier: EPL-2.0"],
    "bsl": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0"],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib"],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
        "Released under CC0 1.0 Universal Public Domain Dedication."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain."],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
FAMILIES = ["unknown", *TEMPLATES]
WINDOW, STEP, WRAPPED = 8, 4, 200
#: How heavy a notice inside ordinary text is, beside the notice alone.
AROUND = 8.0
#: Everyday sentences with the words of notices, all of them unknown.
ORDINARY = ["He lost his driving license last week.", "The license plate of the car was new.",
            "The general public was asked to stay at home.", "They released a new version of the software in May.",
            "The terms of the agreement are under review.", "The source of the river is in the north.",
            "She was granted permission to enter.", "The warranty of the washing machine ended.",
            "All rights come with duties.",
            "In no event will the use of the building be held against them.", "The work is done under the direction of the author."]


def tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def word_pairs(w: Column) -> Column:
    """Neighbouring words as structs a, b."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"))


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def template_pairs(spark: SparkSession) -> DataFrame:
    """(family, template, a, b, n_pairs): the distinct word pairs of every template."""
    rows = [{"family": f, "template": k, "text": t} for k, (f, t) in
            enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    pairs = F.array_distinct(word_pairs(F.filter(tokens(F.col("text")), lambda w: w != "")))
    return (literal_table(spark, rows, "family string, template int, text string")
            .select("family", "template", F.size(pairs).alias("n_pairs"), F.explode(pairs).alias("s"))
            .select("family", "template", "n_pairs", "s.a", "s.b"))


def ordinary(line: Column) -> Column:
    """Whether a line counts as ordinary text: long enough, without the words that notices go by."""
    return (F.length(line) > 20) & ~F.lower(line).rlike("licen[cs]e|copyright|rights reserved|permission|public domain|cc by")


def held_out(line: Column) -> Column:
    """Half of the ordinary lines, by their hash: they set the threshold, the others are fitted."""
    return F.xxhash64(line, F.lit(7)) % 2 != 0


def ordinary_sets(docs: DataFrame, hits: DataFrame, scratch: Scratch) -> DataFrame:
    """(held, ks, n): how many ordinary lines of all texts, held out or not, have just the vocabulary's pairs ``ks``.

    Lines without any of these pairs are counted from the texts, the others from ``hits``.
    """
    sets = (hits.where("ordinary and not cross").groupBy(*LINE, "held").agg(F.sort_array(F.collect_set("k")).alias("ks"))
            .groupBy("held", "ks").agg(F.count(F.lit(1)).alias("n")))
    sets = scratch.write(sets, "sets")
    # rows with one (doc_id, text) are one document, as in ``hits``
    lines = F.filter(F.split("text", "\n"), ordinary)
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.size(lines).alias("n"),
                       F.size(F.filter(lines, held_out)).alias("held")).where("n > 0").distinct()
    total = here.agg(F.coalesce(F.sum(F.col("n") - F.col("held")), F.lit(0)).alias("fitted"),
                     F.coalesce(F.sum("held"), F.lit(0)).alias("held")).first()
    some = {r["held"]: r["n"] for r in sets.groupBy("held").agg(F.sum("n").alias("n")).collect()}
    rest = [{"held": held, "ks": [], "n": n - some.get(held, 0)} for held, n in ((False, total["fitted"]), (True, total["held"]))]
    return sets.union(literal_table(docs.sparkSession, rest, "held boolean, ks array<int>, n long")).where("n > 0")


def train(sets: DataFrame, vocabulary: list[str], scratch: Scratch, ordinary_weight: float) -> tuple[list[list[float]], list[float], float]:
    """(weights by class, intercepts, threshold of the unknown class), from ``ordinary_sets``.

    Equal ordinary lines are one row with their number as its weight, all of them
    together as heavy as ``ordinary_weight`` rows at most.
    """
    spark = sets.sparkSession
    base = literal_table(spark, [{"family": f, "text": t} for f, ts in TEMPLATES.items() for t in ts]
                         + [{"family": "unknown", "text": t} for t in ORDINARY], "family string, text string")
    w = F.filter(tokens(F.col("text")), lambda x: x != "")
    whole = base.select("family", w.alias("w"))
    # parts of long notices, cut at the front and at the back
    cut = whole.where(F.size("w") >= 12).select("family", F.explode(F.array(
        F.slice("w", 1, (F.size("w") * 2 / 3).cast("int")),
        F.slice("w", (F.size("w") / 3).cast("int") + 1, F.size("w")))).alias("w"))
    numbers = F.from_json(F.lit(json.dumps({v: k for k, v in enumerate(vocabulary)})), "map<string,int>")
    pairs = F.transform(word_pairs(F.col("w")), lambda s: F.concat_ws(" ", s["a"], s["b"]))
    known = F.array_distinct(F.filter(F.transform(pairs, lambda p: F.try_element_at(numbers, p)), lambda k: k.isNotNull()))
    index = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    fixed = scratch.write(whole.union(cut).select(index.cast("double").alias("label"), known.alias("ks"), F.lit(1.0).alias("n")).coalesce(1), "fixed")
    fitted = sets.where("not held")
    lines = fitted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # notices inside ordinary text: every set of pairs around one of them, dealt by its hash; lines without pairs around each
    own = whole.where("family <> 'unknown'").select(index.cast("double").alias("label"), known.alias("own")).collect()
    n_own = len(own)
    around = literal_table(spark, [{"at": k, **r.asDict()} for k, r in enumerate(sorted(own))], "at int, own array<int>, label double")
    share = F.col("n") * min(AROUND / max(lines, 1), 1.0)
    bare = F.size("ks") == 0
    inside = (fitted.where(bare).crossJoin(F.broadcast(around)).select("label", F.col("own").alias("ks"), share.alias("n"))
              .union(fitted.where(~bare).withColumn("at", F.pmod(F.xxhash64("ks"), F.lit(n_own)).cast("int")).join(F.broadcast(around), "at")
                     .select("label", F.array_union("own", "ks").alias("ks"), (share * n_own).alias("n"))))
    plain = fitted.select(F.lit(0.0).alias("label"), "ks", (F.col("n") * min(ordinary_weight / max(lines, 1), 1.0)).alias("n"))
    counter = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(vocabulary))], inputCol="ids", outputCol="features", minTF=1.0)
    counter.setBinary(True)
    rows = fixed.union(plain).union(inside)
    ready = counter.transform(rows.select("label", "n", F.col("ks").cast("array<string>").alias("ids")))
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, standardization=False, weightCol="n").fit(ready)
    # the score that all but one in a thousand of the held-out lines stay below, in steps of 1/10,000
    held = model.transform(counter.transform(sets.where("held").select(F.col("ks").cast("array<string>").alias("ids"), "n")))
    top = F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES) - 1))
    steps = sorted((r["p"], r["n"]) for r in held.groupBy(F.ceil(top * 10_000).cast("int").alias("p")).agg(F.sum("n").alias("n")).collect())
    want, seen, limit = 0.999 * sum(n for _, n in steps), 0, 0.0
    for p, n in steps:
        seen += n
        if seen >= want:
            limit = p / 10_000
            break
    return model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist(), min(0.9, max(0.5, limit))


def find_licenses(docs: DataFrame, ordinary_weight: float = 2000.0, min_match: float = 0.6) -> DataFrame:
    """Notices per paragraph with a predicted family.

    (doc_id, text_hash, paragraph, n_lines, family, probability, match, confirmed);
    ``paragraph`` is the first line, ``n_lines`` 1 or WINDOW, ``probability`` that
    of the predicted family of the paragraph.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "license")
    pairs = template_pairs(spark)
    # pairs that a single family has, and their number per template
    pairs = pairs.join(pairs.groupBy("a", "b").agg((F.count_distinct("family") == 1).alias("only")), ["a", "b"])
    pairs = pairs.join(pairs.groupBy("template").agg(F.count_if("only").alias("n_only")), "template")
    of = scratch.write(pairs.groupBy("a", "b", "only").agg(F.collect_list(F.struct("family", "template", "n_pairs", "n_only")).alias("templates"))
                       .coalesce(1), "pairs")
    vocabulary = sorted(f"{r.a} {r.b}" for r in of.select("a", "b").collect())
    ids = literal_table(spark, [{"a": v.split(" ")[0], "b": v.split(" ")[1], "k": k} for k, v in enumerate(vocabulary)], "a string, b string, k int")
    of = scratch.write(ids.join(of, ["a", "b"]).coalesce(1), "numbers")
    hits = scratch.write(line_pairs(docs).join(F.broadcast(of.select("a", "b", "k", "only")), ["a", "b"])
                         .select(*LINE, "short", "ordinary", "held", "cross", "k", "only").distinct(), "hits")
    weights, intercepts, limit = train(scratch.write(ordinary_sets(docs, hits, scratch), "ordinary"), vocabulary, scratch, ordinary_weight)
    table = literal_table(spark, [{"k": k, "w": [round(c[k], 9) for c in weights]} for k in range(len(vocabulary))], "k int, w array<double>")
    table = scratch.write(table.join(of, "k").coalesce(1), "vocabulary")
    lines = hits.where(~F.col("cross")).select(*LINE, F.lit(1).alias("n_lines"), "k")
    first = F.floor(F.col("paragraph") / STEP).cast("int") * STEP
    run = (hits.where("short").withColumn("paragraph", F.explode(F.array(first, first - STEP)))
           .select(*LINE, F.lit(WINDOW).alias("n_lines"), "k", "only").distinct())
    run = run.where(F.col("paragraph") >= 0)
    told = run.where("only").select(*LINE).distinct()
    one = scratch.write(notices(lines, table, intercepts, limit, min_match), "lines")
    run = run.drop("only").alias("r").join(told.alias("c"), same_place("r", "c"), "left_semi")
    many = scratch.write(notices(run, table, intercepts, limit, min_match).where("confirmed"), "runs")
    # what a line of the run or the run before gives is no other notice
    covered = (one.where("confirmed").select("doc_id", "text_hash", "family", F.explode(
        F.sequence(F.col("paragraph") - WINDOW + 1, F.col("paragraph"))).alias("paragraph")).where(F.col("paragraph") % STEP == 0))
    known = covered.union(many.select("doc_id", "text_hash", "family", F.col("paragraph") + STEP)).distinct()
    return one.union(many.alias("r").join(known.alias("c"), same_place("r", "c", "family"), "left_anti"))


LINE = ["doc_id", "text_hash", "paragraph"]


def same_place(left: str, right: str, *more: str) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in (*LINE, *more)]


def line_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, paragraph, short, ordinary, held, cross, a, b): the word pairs of every line, the first with the last word of the line before.

    ``cross`` marks the pair over the line end, ``short`` the lines that may be
    part of a wrapped notice, ``ordinary`` and ``held`` those that teach what is none.
    """
    kept = F.transform(F.split("text", "\n"), lambda t: F.struct(
        F.filter(tokens(t), lambda w: w != "").alias("w"), (F.length(t) <= WRAPPED).alias("short"),
        ordinary(t).alias("ordinary"), held_out(t).alias("held")))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), kept.alias("l"))
    last = F.concat(F.array(F.lit(None).cast("string")), F.transform("l", lambda t: F.when(
        F.size(t["w"]) > 0, F.element_at(t["w"], -1))))
    line = (text.select("doc_id", "text_hash", F.posexplode(F.arrays_zip(F.col("l").alias("l"), F.slice(last, 1, F.size("l")).alias("before"))))
            .select("doc_id", "text_hash", F.col("pos").alias("paragraph"), "col.l.w", "col.l.short", "col.l.ordinary", "col.l.held", "col.before"))
    pairs = F.arrays_zip(F.concat(F.array("before"), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("a"), F.col("w").alias("b"))
    return (line.where(F.size("w") > 0).select(*LINE, "short", "ordinary", "held", F.posexplode(pairs))
            .select(*LINE, "short", "ordinary", "held", (F.col("pos") == 0).alias("cross"), "col.a", "col.b").where("a is not null"))


def notices(hits: DataFrame, table: DataFrame, intercepts: list[float], limit: float, min_match: float,
            full_match: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, paragraph, n_lines, family, probability, match, confirmed) from the pairs ``k`` of paragraphs."""
    key = [*LINE, "n_lines"]
    hits = hits.join(F.broadcast(table.select("k", "w", "only", "templates")), "k")
    n = len(FAMILIES)
    sums = hits.groupBy(*key).agg(*[F.sum(F.col("w")[c]).alias(f"c{c}") for c in range(n)])
    raw = F.array(*[F.col(f"c{c}") + F.lit(float(intercepts[c])) for c in range(n)])
    top = F.array_max(F.slice("raw", 2, n - 1))
    total = F.aggregate("raw", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("raw")))
    scored = (sums.select(*key, raw.alias("raw"))
              .withColumn("likeliest", F.element_at(F.array(*[F.lit(f) for f in FAMILIES[1:]]),
                                                    F.array_position(F.slice("raw", 2, n - 1), top).cast("int")))
              .withColumn("probability", F.exp(top - F.array_max("raw")) / total)
              .where(F.col("probability") >= limit).select(*[F.col(c).alias(f"_{c}") for c in key], "likeliest", "probability"))
    match = (hits.select(*key, "only", F.explode("templates").alias("t")).select(*key, "only", "t.*")
             .groupBy(*key, "family", "template", "n_pairs", "n_only")
             .agg((F.count(F.lit(1)) / F.col("n_pairs")).alias("m"), F.count_if("only").alias("o"))
             .groupBy(*key, "family").agg(F.max("m").alias("match"), F.max(
                 F.when((F.col("o") > 0) & (F.col("o") >= full_match * F.col("n_only")), F.col("m"))).alias("own"))
             .groupBy(*key).agg(F.collect_list(F.struct("family", "match", "own")).alias("m")))  # one per family at most
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    both = scored.join(match, on, "left").select(*[F.col(f"_{c}").alias(c) for c in key], "likeliest", "probability", "m")
    more = F.filter("m", lambda x: (x["family"] != F.col("likeliest")) & (x["own"] >= full_match))
    main = F.filter("m", lambda x: x["family"] == F.col("likeliest"))
    none = F.array(F.struct(F.col("likeliest").alias("family"), F.lit(0.0).alias("match"), F.lit(None).cast("double").alias("own")))
    listed = F.concat(F.when(F.size(main) > 0, main).otherwise(none), F.coalesce(more, F.slice(none, 1, 0)))
    return (both.select(*key, "probability", F.explode(listed).alias("f"))
            .select(*key, "f.family", F.round("probability", 6).alias("probability"), F.round("f.match", 6).alias("match"),
                    (F.col("f.match") >= min_match).alias("confirmed")))


def per_document(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, families (of confirmed notices, sorted), n_confirmed and n_unconfirmed paragraphs per row of ``docs``."""
    one = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
        F.sum((~F.col("confirmed")).cast("long")).alias("n_unconfirmed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return (rows.join(one, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")), "left")
            .select("doc_id", F.coalesce("families", F.lit("")).alias("families"),
                    F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
                    F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed")))
