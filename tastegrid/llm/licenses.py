"""License scan: Dice coefficient of word bigrams against license templates, in Spark SQL alone.

Every line of a text, and the whole text if it has several lines, is normalised and compared
as a unit. The coefficient of two sets can reach a threshold t only if the smaller set has at
least t / (2 - t) times the size of the larger; templates outside these bounds are not
compared, nor are units without any of the words of which every text near a template has at least one.
The scan needs no shuffle.

Notices wrapped over lines, above code or inside a sentence are found in windows over the words
of the whole text, each as long as its template; the templates there are complete license
texts and file headers too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Mapping
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8
WHOLE_TEXT = -1

# Public license notices and texts.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    ),
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
        "whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "reserved": "All rights reserved.",
}


@cache
def full_texts() -> dict[str, str]:
    """Complete license texts and file headers, from the files beside this module."""
    folder = resources.files(__package__) / "license_texts"
    files = [f for f in folder.iterdir() if f.name.endswith(".txt")]
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files}


def words(text: Column) -> Column:
    """Words of a normalised text: A-Z lowered, ASCII signs but letters and digits are spaces."""
    plain = F.regexp_replace(text, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " ")
    lowered = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, " "), lambda w: w != "")


def bigrams(word_list: Column) -> Column:
    """The different pairs of neighbouring words; a single word stands for itself."""
    n = F.size(word_list)
    pairs = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.concat_ws(" ", F.element_at(word_list, i), F.element_at(word_list, i + 1)),
    )
    return F.when(n > 1, F.array_distinct(pairs)).otherwise(word_list)


def _once(value: Column) -> Column:
    return F.explode(F.array(value))


def _template_array(docs: DataFrame, templates: Mapping[str, str]) -> Column:
    """The templates with their bigrams as one constant of the plan."""
    spark = docs.sparkSession
    table = spark.createDataFrame(sorted(templates.items()), "name STRING, text STRING")
    rows = table.select("name", bigrams(words(F.col("text"))).alias("grams")).collect()
    return F.array(
        *[
            F.struct(F.lit(r["name"]).alias("name"), F.array(*map(F.lit, r["grams"])).alias("grams"))
            for r in rows
        ]
    )


# Words found in texts of any kind; a text is not looked at for their sake if that can be helped.
COMMON = frozenset(
    "a above all also an and any are as at b be but by c can do each for from has have if in is it its may "
    "must no not of on only or other see shall such that the their then this to under use was were what when "
    "which will with without you your 0 1 2 3 4 5".split()
)


def _probe(grams: list[str], need: int) -> set[str]:
    """Words of which every text with ``need`` of the pairs has at least one.

    The pairs without any of these words are fewer than ``need``.
    """
    left, chosen = [set(g.split(" ")) for g in grams], set()
    while len(left) >= need:
        counts: dict[str, int] = {}
        for pair in left:
            for w in pair:
                counts[w] = counts.get(w, 0) + 1
        best = min(counts, key=lambda w: (w in COMMON, -counts[w], w))
        chosen.add(best)
        left = [pair for pair in left if best not in pair]
    return chosen


def _strings(values: list[str]) -> Column:
    """A constant array in one literal; no value holds a line feed."""
    return F.split(F.lit("\n".join(values)), "\n")


def _dice(one: Column, two: Column) -> Column:
    """``one`` has different values; ``two`` may repeat some."""
    return F.lit(2.0) * F.size(F.array_intersect(one, two)) / (F.size(one) + F.size(F.array_distinct(two)))


def _table(docs: DataFrame, templates: Mapping[str, str], least: float) -> list[dict]:
    """Words and bigrams of each template, and what a text needs to come near it; words are cut by Spark."""
    share, found = least / (2 - least), []
    table = docs.sparkSession.createDataFrame(sorted(templates.items()), "name STRING, text STRING")
    for r in table.select("name", words(F.col("text")).alias("words")).collect():
        pairs = [" ".join(p) for p in zip(r["words"], r["words"][1:])] or r["words"]
        grams = list(dict.fromkeys(pairs))
        # Dice of at least t needs t / (2 - t) of the pairs of the template.
        need = max(1, math.ceil(share * len(grams) - 1e-9))
        found.append({"name": r["name"], "m": len(r["words"]), "pairs": pairs, "grams": grams, "need": need, "probe": _probe(grams, need)})
    return found


def _probes(table: list[dict]) -> Column:
    return _strings(sorted(set().union(*(t["probe"] for t in table))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


# A unit or a window found; a unit has its line as ``begin`` and -1 as ``end``.
FOUND = "array<struct<low:double,short:int,license:string,begin:int,end:int>>"


def _told(table: list[dict], known: Column, least: float) -> Column:
    """The units of ``text`` that reach ``least``, with the best template of each."""
    share, probe = least / (2 - least), _probes(table)
    lines = F.split("text", "\n", -1)
    numbered = F.transform(lines, lambda t, i: F.struct(i.alias("line"), words(t).alias("words")))
    whole = F.array(F.struct(F.lit(WHOLE_TEXT).alias("line"), F.col("words").alias("words")))
    units = F.when(F.size(lines) > 1, F.concat(whole, numbered)).otherwise(numbered)

    def near(grams: Column) -> Column:
        # Rounded outwards, so that a bound met exactly is never lost to rounding.
        return F.filter(
            known,
            lambda t: F.least(F.size(t["grams"]), F.size(grams))
            >= F.greatest(F.size(t["grams"]), F.size(grams)) * (share - 1e-9),
        )

    def best(grams: Column) -> Column:
        dice = F.transform(near(grams), lambda t: F.struct(_dice(t["grams"], grams).alias("dice"), t["name"].alias("license")))
        return F.aggregate(
            dice,
            F.struct(F.lit(-1.0).alias("dice"), F.lit("").alias("license")),
            lambda top, d: F.when(d["dice"] > top["dice"], d).otherwise(top),
        )

    def scored(u: Column) -> Column:
        return _let(
            _let(bigrams(u["words"]), best),
            lambda x: F.struct(
                (-x["dice"]).alias("low"), F.lit(0).alias("short"), x["license"].alias("license"),
                u["line"].alias("begin"), F.lit(-1).alias("end"),
            ),
        )

    # A unit without any word of the probe has too few pairs of every template.
    able = F.filter(units, lambda u: F.arrays_overlap(u["words"], probe))
    return F.when(
        F.arrays_overlap("hits", probe), F.filter(F.transform(able, scored), lambda x: x["low"] <= -least)
    ).otherwise(F.array().cast(FOUND))


def _apart(table: list[dict], least: float) -> Column:
    """Windows that reach ``least`` and do not overlap, best first, from ``words``, ``pairs`` and ``near``."""

    def begins(t: Column) -> Column:
        placed = F.transform("pairs", lambda p, i: F.struct(i.alias("i"), F.array_position(t["once"], p).cast("int").alias("j")))
        placed = F.filter(placed, lambda x: x["j"] > 0)
        last = F.greatest(F.size("words") - t["m"], F.lit(0))
        return F.array_distinct(
            F.transform(placed, lambda x: F.greatest(F.least(x["i"] - F.element_at(t["at"], x["j"]), last), F.lit(0)))
        )

    def window(t: Column, begin: Column) -> Column:
        dice = _dice(t["grams"], F.slice("pairs", begin + 1, t["m"] - 1))
        end = F.least(begin + t["m"], F.size("words"))
        return F.struct(
            (-dice).alias("low"), (-t["m"]).alias("short"), t["name"].alias("license"), begin.alias("begin"), end.alias("end")
        )

    every = F.flatten(F.transform("near", lambda t: F.transform(begins(t), lambda b: window(t, b))))
    return _let(
        F.array_sort(F.filter(every, lambda x: x["low"] <= -least)),
        lambda good: F.aggregate(
            good,
            F.filter(good, lambda x: F.lit(False)),
            lambda taken, x: F.when(
                F.exists(taken, lambda y: (y["begin"] < x["end"]) & (x["begin"] < y["end"])), taken
            ).otherwise(F.concat(taken, F.array(x))),
        ),
    )


def _search(
    docs: DataFrame, units: Mapping[str, str], placed: Mapping[str, str], least: float, tell: bool = True
) -> DataFrame:
    """Units near ``units`` (if ``tell``) and windows near ``placed``; each text is read and normalised once."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    asked, table = _table(docs, units, least), [t for t in _table(docs, placed, least) if t["m"] > 1]
    known = _template_array(docs, units)
    probe = _probes(table + asked if tell else table)
    # Generators keep the optimizer from repeating an expression wherever its result is used.
    found = docs.select("doc_id", "text", _once(words(F.col("text"))).alias("words"))
    hits = _once(F.array_intersect(probe, F.col("words"))).alias("hits")
    found = found.select("doc_id", "text", "words", hits).where(F.size("hits") > 0)
    told = _told(asked, known, least) if tell else F.array().cast(FOUND)
    if not table:
        found = found.select("doc_id", F.explode(told).alias("x"))
        return found.select("doc_id", F.col("x.begin").alias("line"), F.col("x.license").alias("license"), (-F.col("x.low")).alias("dice"))
    rows = []
    for t in table:
        counts = Counter(t["pairs"])
        once = [(p, i) for i, p in enumerate(t["pairs"]) if counts[p] == 1]
        at = _strings([str(i) for _, i in once]).cast("array<int>")
        rows.append(
            F.struct(
                F.lit(t["name"]).alias("name"), F.lit(t["m"]).alias("m"), F.lit(t["need"]).alias("need"),
                _strings(sorted(t["probe"])).alias("probe"), _strings(t["grams"]).alias("grams"),
                _strings([p for p, _ in once]).alias("once"), at.alias("at"),
            )
        )
    pairs = F.zip_with(
        F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1),
        lambda x, y: F.concat_ws(" ", x, y),
    )
    pairs = F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>"))
    found = found.select("doc_id", "text", "words", "hits", _once(told).alias("told"))
    found = found.select("doc_id", "text", "words", "hits", "told", _once(pairs).alias("pairs"))
    near = F.filter(
        F.array(*rows),
        lambda t: F.arrays_overlap(t["probe"], F.col("hits"))
        & (F.size(F.array_intersect(t["grams"], F.col("pairs"))) >= t["need"]),
    )
    found = found.select("doc_id", "text", "words", "told", "pairs", _once(near).alias("near"))
    found = found.where((F.size("near") > 0) | (F.size("told") > 0))
    found = found.select("doc_id", "text", "words", F.explode(F.concat("told", _apart(table, least))).alias("x"))
    is_unit = F.col("x.end") < 0
    lines = F.split("text", "\n", -1)
    owners = F.flatten(F.transform(lines, lambda t, i: F.transform(words(t), lambda w: i)))
    found = found.select("doc_id", "words", "x", lines.alias("lines"), _once(F.when(~is_unit, owners)).alias("owners"))
    first = F.when(is_unit, F.col("x.begin")).otherwise(F.element_at("owners", F.col("x.begin") + 1))
    last = F.when(~is_unit, F.element_at("owners", F.col("x.end")))
    found = found.select("doc_id", "lines", "words", "x", first.alias("line"), last.alias("last"))

    def given(unit: Column) -> Column:
        return F.exists(
            known, lambda t: (t["name"] == F.col("x.license")) & (_dice(t["grams"], bigrams(unit)) >= least)
        )

    on_line = (F.col("line") == F.col("last")) & given(words(F.element_at("lines", F.col("line") + 1)))
    return found.where(is_unit | ~(given(F.col("words")) | on_line)).select(
        "doc_id", "line", F.col("x.license").alias("license"), (-F.col("x.low")).alias("dice")
    )


def scan(
    docs: DataFrame, templates: Mapping[str, str] | None = None, least: float = LEAST_DICE
) -> DataFrame:
    """``doc_id, line, license, dice``: the best template of each unit that reaches ``least``.

    ``line`` counts the lines of a text from 0, -1 stands for the whole text. Of templates with
    equal coefficients the first by name is given. Units without words, null or empty texts give no
    rows, nor do units below the threshold. Rows that repeat are scanned each; doc_id may be
    null. Only ``doc_id`` and ``text`` are read. No rows give no rows.
    """
    templates = TEMPLATES if templates is None else templates
    if not templates or any(not any(c.isalnum() for c in t) for t in templates.values()):
        raise ValueError("templates must have words")
    return _search(docs, templates, {}, least)


def windows(
    docs: DataFrame,
    templates: Mapping[str, str] | None = None,
    least: float = LEAST_DICE,
    units: Mapping[str, str] | None = None,
) -> DataFrame:
    """``doc_id, line, license, dice``: notices in windows of the whole text that reach ``least``.

    A window has as many words as its template, or all words of a shorter text. It is placed
    wherever a pair of words that a template has once would lie as in the template. Of windows
    that overlap, the one with the greatest coefficient is given, then the longest, the first by
    name, the first in the text. ``line`` is the line on which it begins; two windows may
    begin on one line. A window inside a line, or a text, that ``scan`` gives for the same
    template of ``units`` is not given again. Templates of one word have no windows. Null and empty
    texts and texts of one word give no rows; rows that repeat are searched each; doc_id may be null.
    Only ``doc_id`` and ``text`` are read. No rows give no rows.
    """
    templates = {**TEMPLATES, **full_texts()} if templates is None else templates
    return _search(docs, TEMPLATES if units is None else units, templates, least, tell=False)


def notices(docs: DataFrame, least: float = LEAST_DICE) -> DataFrame:
    """The rows of ``scan``, and those of ``windows`` that it does not have, from one reading of the texts.

    Odd rows are treated as there: no words, no rows; rows that repeat give their rows each; no rows
    give no rows.
    """
    return _search(docs, TEMPLATES, {**TEMPLATES, **full_texts()}, least)
