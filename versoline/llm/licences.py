"""Licence scan by sentence rules.

A text is cut into pieces (line ends, and white space after ``. ! ? ; :``); a piece is lower-cased and everything but ASCII
letters and digits becomes one blank.  A sentence of the list below is found where it equals a piece or a run of pieces that
only single line ends part, as in a text wrapped over lines; blank lines and the sentence marks end a run, except inside a
sentence that has such a mark itself.  Sentences found become their identifier, all others are dropped.  The sequence of
identifiers is then matched against ordered rules, longest first: where a rule's identifiers stand one after the other, they
become its licence.  Identifiers that no rule took stay as parts.  The oracle knows sentences on one line only.

Everything is column expressions on whole texts: no shuffle, no Python.  Null and empty texts have no sentence.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known licence sentences, normalised, by identifier.
SENTENCES = {
    "apache-ref": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-url": ["http www apache org licenses license 2 0", "https www apache org licenses license 2 0"],
    "apache-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-ref": ["released under the mit license", "licensed under the mit license", "mit license", "the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl3-ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl-received": ["you should have received a copy of the gnu general public license along with this program"],
    "cc-by-ref": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc-ref": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0-ref": ["released under cc0 1 0", "this work is dedicated to the public domain"],
}
#: Words of a listed sentence between which its standard wording has a colon or semicolon.
MARKED = ["free software you can"]
#: Licences by their ordered sentences.
RULES = [
    ("Apache-2.0", ["apache-ref", "apache-comply", "apache-copy", "apache-url", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-ref", "apache-comply"]),
    ("Apache-2.0", ["apache-ref"]),
    ("MIT", ["mit-ref", "mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-ref"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-received"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
]


def pattern() -> str:
    """Any listed sentence, the longest first, between line ends; one line end may stand for a blank."""
    known = sorted((sentence for each in SENTENCES.values() for sentence in each), key=len, reverse=True)
    wrapped = [re.sub(" ", r"[ \\n]", s) for s in known]
    for words in MARKED:
        first, last = words.rsplit(" you ", 1)
        at = re.sub(" ", r"[ \\n]", first), re.sub(" ", r"[ \\n]", f"you {last}")
        wrapped = [s.replace(r"[ \n]".join(at), r"(?: |\n\n?)".join(at)) for s in wrapped]
    return r"(?<=\n)(?:" + "|".join(wrapped) + r")(?=\n)"


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), licences (distinct, sorted, joined by commas; empty if none), matched (licences and
    left-over parts in text order)."""
    of = {sentence: name for name, known in SENTENCES.items() for sentence in known}
    names = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    marked = F.regexp_replace(F.lower(F.col("text").cast("string")), r"[.!?;:][ \t\r\n]+", "\n\n")  # a blank line ends a run
    plain = F.concat(F.lit("\n"), F.regexp_replace(F.regexp_replace(marked, r"[^a-z0-9\n]+", " "), r" *\n *", "\n"), F.lit("\n"))
    plain = F.regexp_replace(plain, r"^\n +| +\n$", "\n")
    known = F.transform(F.regexp_extract_all(plain, F.lit(pattern()), F.lit(0)), lambda s: names[F.regexp_replace(s, "\n+", " ")])
    found = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(known, F.array().cast("array<string>")).alias("known"))
    line = F.concat(F.lit(" "), F.array_join(F.transform("known", lambda k: F.concat(F.lit("<"), k, F.lit(">"))), " "), F.lit(" "))
    for licence, parts in sorted(RULES, key=lambda rule: -len(rule[1])):
        line = F.replace(line, F.lit("".join(f" <{p}>" for p in parts)), F.lit(f" {licence}"))
    matched = found.withColumn("matched", F.trim(line))
    words = F.filter(F.split("matched", " "), lambda w: (w != "") & ~w.startswith("<"))
    return matched.select("doc_id", F.size("known").cast("bigint").alias("n_sentences"), F.array_join(F.array_sort(F.array_distinct(words)), ",").alias("licences"), "matched")


def oracle() -> str:
    """The same as SQL: the identifiers by a join, the rules by replacement."""
    values = ", ".join(f"('{sentence}', '{name}')" for name, known in SENTENCES.items() for sentence in known)
    line = "' ' || coalesce(string_agg('<' || name || '>', ' ' ORDER BY place), '') || ' '"
    for licence, parts in sorted(RULES, key=lambda rule: -len(rule[1])):
        line = f"replace({line}, '{''.join(f' <{p}>' for p in parts)}', ' {licence}')"
    return f"""
WITH known(sentence, name) AS (VALUES {values}),
cut AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM documents),
each_one AS (SELECT doc_id, unnest(s) AS raw, unnest(range(len(s))) AS place FROM cut),
named AS (SELECT doc_id, place, name FROM each_one JOIN known ON sentence = trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'))),
lines AS (SELECT d.doc_id, count(n.name) AS n_sentences, trim({line}) AS matched FROM documents d LEFT JOIN named n ON d.doc_id = n.doc_id GROUP BY d.doc_id),
words AS (SELECT doc_id, string_agg(DISTINCT w, ',' ORDER BY w) AS licences FROM (SELECT doc_id, unnest(string_split(matched, ' ')) AS w FROM lines) WHERE w <> '' AND NOT starts_with(w, '<') GROUP BY doc_id)
SELECT l.doc_id, n_sentences, coalesce(licences, '') AS licences, matched FROM lines l LEFT JOIN words w ON l.doc_id = w.doc_id
"""
