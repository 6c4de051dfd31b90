"""License scans with a positional rare-token index.

The index holds, for each rare word of each license template, the word's places in the template. Document frequencies of
those words are counted over all documents. For each file and template the RARE words of highest IDF that the file holds
are chosen, and only these are looked up; a posting at place p of the template and at word w of the file proposes that the template starts
at w - p, and proposals are intersected: at least AGREE of those words must agree on one start. The few starts that are left are verified:
a template's other words are looked up in the file at the places where they should stand, and a start counts only if the
mandatory key phrases stand there, word for word. It may lie before the file's first word: files often open with the
license's name, and the words of the template before its key phrases are not mandatory. The score is the share of the template's IDF mass that stands at the best
start. The base phrases are templates too, all of whose words must stand.

One pass over the texts finds the hits; everything after it works on hits. Choosing and looking up happen within a file's row; what is
exchanged are proposed starts, and for verification only files with a start. All of it is DataFrame expressions. The postings
have a fixed size (the templates below), which is why they are broadcast.

Edge cases: a null or empty text has no words, no labels and the score 0. Repeated rows and repeated or null doc_ids give a
row each, told apart by a row number of their own. An empty table gives an empty result. Words of any length count; very
long texts are whole. Only doc_id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import cut, table, text_of

#: Highest-IDF words of a file that are looked up for a template, and how many of them must agree on a start.
RARE, AGREE = 4, 2
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public license notices, as (label, words, mandatory key phrases).
TEMPLATES = [
    ("agpl-3.0", "gnu affero general public license version 3", ["affero general public license", "version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["binary forms", "following conditions"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("gpl-2.0", "gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["copy modify", "hereby granted"]),
    ("lgpl-3.0", "gnu lesser general public license version 3", ["lesser general public license", "version 3"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free", "associated documentation files"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]
# Words too common to tell licenses apart; never indexed.
COMMON = set("a and any are for in into is of or that the this to under use with without".split())


def postings() -> list[tuple[int, str, int, str, int, int]]:
    """(template, label, base, word, place, key): key is 1 where the word is part of a mandatory phrase."""
    rows = []
    for t, (label, base, text, keys) in enumerate([(label, 1, text, [text]) for text, label in BASE.items()] + [(label, 0, text, keys) for label, text, keys in TEMPLATES]):
        words = text.split()
        held = set()
        for k in keys:
            k = k.split()
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            held |= set(range(at, at + len(k)))
        rows += [(t, label, base, w, p, int(p in held)) for p, w in enumerate(words) if w not in COMMON]
    return rows


def hits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: row, key, n_words, and hits, the places of indexed words."""
    indexed = sorted({w for _, _, _, w, _, _ in postings()})
    low = F.lower(F.replace(text_of(text), F.lit("K"), F.lit("�")))  # the Kelvin sign alone would turn into an ASCII letter
    words = docs.select(F.col(key), F.filter(F.split(low, SEPARATOR), lambda w: w != "").alias("w"))
    found = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(indexed))
    return cut(words.select(F.monotonically_increasing_id().alias("row"), key, F.size("w").cast("long").alias("n_words"), found.alias("hits")))


def proposed(found: DataFrame, rare: dict[int, list[tuple[str, int]]]) -> DataFrame:
    """From `hits`: row, template, start, where AGREE of the file's rarest words of the template agree. rare: of each template its (word, place), the
    highest IDF first."""
    held = F.array_distinct(F.transform("hits", lambda h: h["word"]))
    some = found.where(F.size("hits") > 0).select("row", "hits", held.alias("held"))

    def choice(t: int) -> Column:
        places = F.array(*(F.struct(F.lit(t).alias("template"), F.lit(w).alias("word"), F.lit(p).alias("place")) for w, p in rare[t]))
        here = F.slice(F.filter(places, lambda x: F.array_contains("held", x["word"])), 1, RARE)
        return F.filter(here, lambda x: F.size(here) >= AGREE)  # fewer cannot agree

    chosen = some.select("row", "hits", F.concat(*(choice(t) for t in rare)).alias("chosen")).where(F.size("chosen") > 0)
    starts = F.transform("chosen", lambda x: F.transform(F.filter("hits", lambda h: h["word"] == x["word"]), lambda h: F.struct(x["template"].alias("template"), (h["at"] - x["place"]).alias("start"))))
    each = chosen.select("row", F.explode(F.flatten(starts)).alias("s"))
    return each.groupBy("row", F.col("s.template").alias("template"), F.col("s.start").alias("start")).agg(F.count("*").alias("agree")).where(F.col("agree") >= AGREE).drop("agree")


def scan(found: DataFrame) -> DataFrame:
    """From `hits`: row, n_base, first_word, last_word, base_labels, labels, score for rows with a verified start."""
    spark, index = found.sparkSession, postings()
    n = found.count()
    words = found.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    df = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each indexed word
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for _, _, _, w, _, _ in index}
    by = {}
    for t, label, base, w, p, key in index:
        by.setdefault((t, label, base), []).append((w, p, key))
    post = spark.createDataFrame([(t, w, p, idf[w]) for t, _, _, w, p, _ in index], "template int, word string, place int, idf double")
    mask = lambda places: sum(1 << p for p in places)
    kinds = spark.createDataFrame([(t, label, base, mask(p for _, p, key in ws if key), sum(idf[w] for w, _, _ in ws)) for (t, label, base), ws in by.items()], "template int, label string, base int, key long, mass double")
    rare = {t: [(w, p) for w, p, _ in sorted(ws, key=lambda x: (-idf[x[0]], x[1]))] for (t, _, _), ws in by.items()}
    starts = cut(proposed(found, rare))
    asked = starts.join(F.broadcast(post), "template").select("row", "template", "start", "place", "idf", "word", (F.col("start") + F.col("place")).alias("at"))
    flat = found.join(starts.select("row").distinct(), "row", "left_semi").select("row", F.explode("hits").alias("h")).select("row", "h.at", "h.word")
    met = asked.join(flat, ["row", "at", "word"]).groupBy("row", "template", "start").agg(F.expr("bit_or(shiftleft(1L, place))").alias("bits"), F.sum("idf").alias("got"))
    sure = met.join(F.broadcast(kinds), "template").where(F.col("bits").bitwiseAND(F.col("key")) == F.col("key"))
    base = F.col("base") == 1
    mine = sure.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("b"), F.collect_set("label").alias("l"), F.max(F.when(~base, F.least(F.lit(1.0), F.col("got") / F.greatest("mass", F.lit(1e-12))))).alias("score"),
    )
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return mine.select("row", "n_base", "first_word", "last_word", text("b").alias("base_labels"), text("l").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its words, its places of base phrases, its labels and its score."""
    found = hits(table(spark, sf_dir, "documents"))
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = found.select("row", "doc_id", "n_words").join(scan(found), "row", "left")
    c = {k: F.coalesce(k, v) for k, v in none.items()}
    return out.select("doc_id", "n_words", c["n_base"].alias("n_base"), "first_word", "last_word", c["base_labels"].alias("base_labels"), c["labels"].alias("labels"), F.round(c["score"], 6).alias("score"))


_VALUES = ", ".join(f"({t}, '{label}', {base}, '{w}', {p}, {key})" for t, label, base, w, p, key in postings())
OP1_SQL = rf"""
WITH x(template, label, base, word, place, key) AS (VALUES {_VALUES}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT r, word, w FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS w FROM d) WHERE word IN (SELECT word FROM x)),
f AS (SELECT word, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))::DOUBLE) AS idf
      FROM (SELECT DISTINCT word FROM x) LEFT JOIN (SELECT word, count(DISTINCT r) AS n FROM h GROUP BY word) USING (word)),
p AS (SELECT x.*, idf, sum(idf) OVER (PARTITION BY template) AS mass FROM x JOIN f USING (word)),
a AS (SELECT r, template, label, base, place, key, idf, mass, w - place AS start FROM h JOIN p USING (word)),
t AS (SELECT r, template, place FROM (
  SELECT r, template, place, row_number() OVER (PARTITION BY r, template ORDER BY idf DESC, place) AS k FROM (SELECT DISTINCT r, template, place, idf FROM a)) WHERE k <= {RARE}),
s AS (
  SELECT a.r, a.template, any_value(label) AS label, any_value(base) AS base, start, sum(idf) AS got, any_value(mass) AS mass
  FROM a LEFT JOIN t ON a.r = t.r AND a.template = t.template AND a.place = t.place
  GROUP BY a.r, a.template, start
  HAVING count(t.place) >= {AGREE} AND sum(key) = (SELECT sum(x.key) FROM x WHERE x.template = a.template)),
m AS (SELECT r, count(*) FILTER (base = 1) AS n_base, min(start) FILTER (base = 1) AS first_word, max(start) FILTER (base = 1) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base = 1) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l,
             max(least(1.0, got / greatest(mass, 1e-12))) FILTER (base = 0) AS score FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(b, '') AS base_labels, coalesce(l, '') AS labels,
       round(coalesce(score, 0), 6) AS score
FROM d LEFT JOIN m USING (r)
"""
