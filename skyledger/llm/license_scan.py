"""Licence recognition by known sentences and ordered sequence rules.

A sentence begins and ends at a line end or at white space after ``. ; : ! ?``; it
may run over line ends, but not over a blank line. What stands before the first
letter or digit of a line (indentation, comment marks, bullets) is not part of it,
and a line without any is blank. Sentences are normalised (A-Z lower-cased,
everything but a-z and 0-9 one space, trimmed) and mapped to the identifier of a
known sentence: ``PUBLISHED`` holds sentences of published licences and headers,
``SENTENCES`` short notices and parts of them; the longest that fits is taken.
The known identifiers of a text, in order, are held against the licence rules:
a rule names a sequence of identifiers that must follow one another; the first
rule that matches, in the rules' order, is the text's licence. A rule is passed
over where a longer one that begins with it matches.

``n_sentences`` counts pieces between line ends, as the SQL twin does; the twin knows
the notices only, and gives the same on texts without published licences.

Everything is an expression over one row: no shuffle, no skew, and a text of any
length stays in its row. Null and empty texts have no sentences; equal rows are
scanned each; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.license_texts import PUBLISHED, PUBLISHED_RULES, SLOTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sentences of public licence texts and notices, normalised.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "ccbync-notice": "licensed under cc by nc 4 0",
    "ccby-notice": "licensed under cc by 4 0",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "as-is": "the software is provided as is without warranty of any kind",
    "all-rights": "all rights reserved",
}

#: Licence rules in the order in which they are tried.
RULES = (
    ("Apache-2.0", ("apache-notice", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL", ("gpl-free", "gpl-terms")),
    ("BSD-3-Clause", ("bsd-terms", "bsd-source")),
    ("CC-BY-NC-4.0", ("ccbync-notice",)),
    ("CC-BY-4.0", ("ccby-notice",)),
    ("proprietary", ("all-rights",)),
)

_ENDS = r"([.;:!?])[\x20\x09-\x0D]+"


_EDGE = "\u0001"  # a sentence end or blank line; a line end stays as it is


def _stream(text: Column) -> Column:
    """The normalised words of a text between single spaces, line ends and edges."""
    lines = F.regexp_replace(F.translate(text, UPPER + _EDGE, LOWER + " "), r"(^|\n)[^a-z0-9\n]+", "$1")
    edged = F.regexp_replace(lines, r"[.;:!?][\x20\x09-\x0D]+|\n{2,}", _EDGE)
    spaced = F.regexp_replace(edged, f"[^a-z0-9\n{_EDGE}]+", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(spaced, r" ?\n ?", "\n"), f"[ \n]*{_EDGE}[ \n{_EDGE}]*", _EDGE))
    for before, name, after in SLOTS:
        out = F.regexp_replace(out, "(" + _wrapped(before) + rf")(?:[a-z0-9]+[ \n{_EDGE}]){{1,20}}?(" + _wrapped(after[1:]) + ")", f"$1{name} $2")
    return out


def _wrapped(text: str) -> str:
    return text.replace(" ", "[ \n]")


def scan(docs: DataFrame, sentences: dict[str, str] = {**SENTENCES, **PUBLISHED}, rules: tuple = PUBLISHED_RULES + RULES) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (known ones in order), licenses (all that match, in rule order) and license (the first)."""
    known = F.create_map(*[F.lit(x) for name, text in sentences.items() for x in (text, name)])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = F.filter(F.split(F.regexp_replace(text, _ENDS, "$1\n"), "\n"), lambda s: s.rlike("[A-Za-z0-9]"))
    # a text without the first two words of any known sentence is not normalised
    begins = "|".join(sorted({"[^A-Za-z0-9]+".join(s.split(" ")[:2]) for s in sentences.values()}))
    whole = "|".join(_wrapped(s) for s in sorted(sentences.values(), key=lambda s: (-len(s), s)))
    hits = F.regexp_extract_all(_stream(text), F.lit(f"(?:^|(?<=[\n{_EDGE}]))(?:{whole})(?=$|[\n{_EDGE}])"), 0)
    ids = F.when(text.rlike(f"(?i)(?:{begins})"), F.transform(hits, lambda s: known[F.translate(s, "\n", " ")])).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", F.size(cut).cast("long").alias("n_sentences"), ids.alias("ids"))
    line = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))

    def told(name: str, ids: tuple[str, ...]) -> Column:
        out = F.instr(line, f",{','.join(ids)},") > 0
        for other, more in rules:
            if other != name and len(more) > len(ids) and more[: len(ids)] == ids:
                out &= F.instr(line, f",{','.join(more)},") == 0
        return F.when(out, F.lit(name))

    hits = F.array_distinct(F.array_compact(F.array(*[told(name, ids) for name, ids in rules])))
    return (found.withColumn("hits", hits)
            .select("doc_id", "n_sentences", F.array_join("ids", ",").alias("sentence_ids"), F.array_join("hits", ",").alias("licenses"), F.get("hits", F.lit(0)).alias("license")))


def _sql() -> str:
    known = ", ".join(f"'{text}': '{name}'" for name, text in SENTENCES.items())
    hits = ", ".join(f"CASE WHEN contains(line, ',{','.join(ids)},') THEN '{name}' END" for name, ids in RULES)
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.;:!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, '[A-Za-z0-9]')) AS cut
  FROM documents
), known AS (SELECT MAP {{{known}}} AS known), found AS (
  SELECT doc_id, CAST(len(cut) AS BIGINT) AS n_sentences,
    list_filter(list_transform(cut, lambda s: known[trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL) AS ids
  FROM cut, known
), lined AS (SELECT *, ',' || coalesce(array_to_string(ids, ','), '') || ',' AS line FROM found), hit AS (
  SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS every FROM lined
), once AS (
  SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS hits FROM hit
)
SELECT doc_id, n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(hits, ','), '') AS licenses, hits[1] AS license
FROM once
"""


SQL = _sql()
