"""License scans by diagonal voting, with DataFrame operations only.

Templates are short phrases and notices. Every pair of neighbouring words of every text is joined by its hash (and, against
collisions, the words themselves) to the places of such pairs in the templates. A match votes for its diagonal: its place in
the text less its place in the template. The votes of a diagonal are a mask of template places, so partial sums are of fixed
size. A phrase stands where its diagonal has all votes. For notices, neighbouring diagonals, as inserted or lost words make
them, are merged; their span is accepted if it covers enough of the notice and isn't much longer. What isn't accepted so, as a
notice repeated at once, is taken apart where the template's places go back in the text, then into single diagonals.

A null text is the empty text and has no words. Texts may be of any length; repeated rows give repeated results. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD_BYTES, narrow

#: The phrases that count on their own, with their labels.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
#: Notices of well-known licenses, each of 64 word pairs at most, with their labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("rights-reserved", "All rights reserved"),
]
#: A notice's diagonal needs so many votes (or all, if it has fewer); diagonals this near are one; the share of its pairs that
#: a span must cover; how much longer than the notice the span may be.
VOTES, NEAR, COVER, STRETCH = 3, 8, 0.6, 1.5
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w.decode() for w in text.encode().translate(WORD_BYTES).split()]


def template_rows() -> list[tuple]:
    """template, base, label, pairs, place, first and second word."""
    out = []
    for n, (base, (label, text)) in enumerate([(True, x) for x in BASE] + [(False, x) for x in NOTICES]):
        words = template_words(text)
        assert 2 <= len(words) <= 65
        out += [(n, base, label, len(words) - 1, i, *words[i : i + 2]) for i in range(len(words) - 1)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (base, label, start, length, cover) of every document; words count from 0."""
    spark = docs.sparkSession
    df = narrow(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("h"), F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), _BREAK), "").alias("words"))
    pairs = df.select("doc_id", "h", "words", F.posexplode_outer("words").alias("pos", "w1")).select("doc_id", "h", "pos", "w1", F.get("words", F.col("pos") + 1).alias("w2"))
    pairs = pairs.filter("w2 is not null").withColumn("gram", F.xxhash64("w1", "w2"))
    # A fixed table of a few hundred rows.
    templates = spark.createDataFrame(template_rows(), "template int, base boolean, label string, pairs int, place int, t1 string, t2 string")
    templates = F.broadcast(templates.withColumn("gram", F.xxhash64("t1", "t2")))
    votes = pairs.join(templates, "gram").filter("w1 = t1 and w2 = t2")
    votes = votes.groupBy("doc_id", "h", "template", "base", "label", "pairs", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("place").alias("low"))
    count = F.bit_count("mask")
    votes = votes.filter(F.when(F.col("base"), count == F.col("pairs")).otherwise(count >= F.least(F.lit(VOTES), F.col("pairs"))))
    order = Window.partitionBy("doc_id", "h", "template").orderBy("diagonal")
    new = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR), 1).otherwise(0)
    votes = votes.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    cover, length = lambda mask: F.bit_count(mask) / F.col("pairs"), lambda first, last: last + 2 - first
    fits = lambda mask, first, last: (cover(mask) >= COVER) & (length(first, last) <= F.lit(STRETCH) * (F.col("pairs") + 1))
    by = ["doc_id", "h", "template", "island"]
    for part in ("part", "single"):
        whole = Window.partitionBy(*by)
        inside = whole.orderBy("first", "diagonal")
        back = F.when(F.col("low") <= F.lag("low").over(inside), 1).otherwise(0) if part == "part" else F.lit(1)
        votes = votes.withColumn("back", back).withColumn("fits", fits(F.bit_or("mask").over(whole), F.min("first").over(whole), F.max("last").over(whole)))
        votes = votes.withColumn(part, F.when(F.col("fits"), 0).otherwise(F.sum("back").over(inside)))
        by = [*by, part]
    spans = votes.groupBy(*by, "base", "label", "pairs").agg(F.bit_or("mask").alias("mask"), F.min("first").alias("start"), F.max("last").alias("last"))
    spans = spans.filter(fits(F.col("mask"), F.col("start"), F.col("last"))).withColumn("cover", cover("mask")).withColumn("length", length(F.col("start"), F.col("last")))
    places = spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "base", "label", "length", "cover"))).alias("places"))
    every = df.select(F.col("doc_id").alias("id"), F.col("h").alias("key"), F.size("words").cast("long").alias("n_words"))
    joined = every.join(places, every.id.eqNullSafe(places.doc_id) & (every.key == places.h), "left")
    return joined.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("places", F.expr("cast(array() as array<struct<start: int, base: boolean, label: string, length: int, cover: double>>)")).alias("places"))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["cover"])), F.lit(0.0)).alias("score"),
    )


def sql(words: str) -> str:
    """The query in DuckDB's SQL; words: the expression for a text's words."""
    rows = ",\n".join(f"({n}, {str(base).lower()}, '{label}', {pairs}, {place}, '{a}', '{b}')" for n, base, label, pairs, place, a, b in template_rows())
    assert not re.search(r"'[^',() ]*'[^',() ]*'", rows)
    fits = f"(bit_count(bit_or(mask) over (partition by {{0}})) / cast(pairs as double) >= {COVER} and max(l) over (partition by {{0}}) + 2 - min(f) over (partition by {{0}}) <= {STRETCH} * (pairs + 1))"
    return f"""
with t(template, base, label, pairs, place, t1, t2) as (values {rows}),
d as (select row_number() over () as r, doc_id, coalesce({words.format("text")}, []) as w from documents),
p as (select r, i - 1 as pos, w[i] as w1, w[i + 1] as w2 from (select r, w, unnest(range(1, len(w))) as i from d)),
v as (select r, template, base, label, pairs, pos - place as diagonal, bit_or(cast(1 as bigint) << place) as mask, min(pos) as f, max(pos) as l, min(place) as low
      from p join t on w1 = t1 and w2 = t2 group by all),
k as (select * from v where case when base then bit_count(mask) = pairs else bit_count(mask) >= least({VOTES}, pairs) end),
g as (select *, case when base or diagonal - lag(diagonal) over (partition by r, template order by diagonal) > {NEAR} then 1 else 0 end as new from k),
s as (select *, sum(new) over (partition by r, template order by diagonal) as island from g),
p1 as (select *, case when low <= lag(low) over (partition by r, template, island order by f, diagonal) then 1 else 0 end as back, {fits.format("r, template, island")} as fits from s),
q1 as (select *, case when fits then 0 else sum(back) over (partition by r, template, island order by f, diagonal) end as part from p1),
p2 as (select *, {fits.format("r, template, island, part")} as fits_part from q1),
q2 as (select *, case when fits_part then 0 else row_number() over (partition by r, template, island, part order by f, diagonal) end as single from p2),
m as (select r, base, label, pairs, bit_count(bit_or(mask)) / cast(pairs as double) as cover, min(f) as start, max(l) + 2 - min(f) as length
      from q2 group by r, template, base, label, pairs, island, part, single),
a as (select * from m where cover >= {COVER} and length <= {STRETCH} * (pairs + 1)),
o as (select r, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
      string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(cover) as score
      from a group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word,
       cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join o using (r)
"""
