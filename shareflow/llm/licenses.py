"""Licence scans by sentence rules.

1. A text is cut into pieces at line ends and sentence ends, each normalised.
2. Known licence sentences are recognised: a run of pieces that holds a sentence's words and nothing else is one occurrence
   of that sentence's identifier. Cuts inside a sentence don't matter: hard-wrapped lines, comment signs at their beginning,
   "v. 2.0" or "WARRANTY; without" cut a text where a sentence doesn't end, and it is found all the same. A `*` in a
   sentence stands for a name of up to GAP_WORDS words. Notices (NOTICES) count anywhere within a piece, SPDX identifiers
   at its end or before `or`, `and`, `with`.
3. Licence rules are ordered sequences of identifiers; a rule matches where occurrences of its identifiers follow one
   another without a gap, unless what follows begins with words that make it another licence (UNLESS).
4. A match that lies within a longer match of the same text is dropped.

Up to the matches all of it happens within a row, so texts are read once and never shuffled; only matches are, and those
within others are found by a window over the matches of a row.

- null or empty text has no sentences; pieces without a letter or digit don't count and leave no gap;
- a piece that is a list number ("1.") leaves no gap either, but counts in first_sentence and n_sentences;
- a document without a match gives no row; texts are looked at one by one, also those of one doc_id or of null ids; equal
  matches of rows that share a doc_id are given once;
- an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shareflow.llm.common import text_or_empty

# Sentences of public licences, normalised (lower case, one space between runs of letters and digits).
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-1": "licensed under the apache license version 2 0 the license",
    "apache-2": "you may not use this file except in compliance with the license",
    "apache-3": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-5": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-short-2": "licensed under the mit license",
    "mit-1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-3": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2only-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2only-2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    "gpl2only-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
    "gpl-2": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-3": "see the gnu general public license for more details",
    "bsd-1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-4": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
    "isc-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-1": "this is free and unencumbered software released into the public domain",
    "unlicense-2": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "mit-4": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-5": "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "lgpl21-1": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl21-2": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl21-3": "see the gnu lesser general public license for more details",
    "lgpl3-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-3": "see the gnu affero general public license for more details",
    "boost-1": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost-short": "distributed under the boost software license version 1 0",
    "zlib-1": "this software is provided as is without any express or implied warranty",
    "zlib-2": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-3": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "isc-2": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "epl-1": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "wtfpl-1": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "artistic-short": "licensed under the artistic license 2 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd-long": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
}

# Licence, and its sentences in order.
RULES = [
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-1", "apache-2"]),
    ("Apache-2.0", ["apache-1", "apache-2", "apache-3", "apache-4", "apache-5"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-short-2"]),
    ("MIT", ["mit-1", "mit-2"]),
    ("MIT", ["mit-1", "mit-2", "mit-3"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-3.0", ["gpl-1", "gpl-2", "gpl-3"]),
    ("GPL-2.0", ["gpl2-1", "gpl-2", "gpl-3"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4"]),
    ("MPL-2.0", ["mpl-1", "mpl-2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC0-1.0", ["cc0"]),
    ("ISC", ["isc-1"]),
    ("Unlicense", ["unlicense-1"]),
    ("Unlicense", ["unlicense-1", "unlicense-2"]),
    ("MIT", ["mit-1", "mit-2", "mit-3", "mit-4"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-5"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4", "bsd-5"]),
    ("LGPL-2.1", ["lgpl21-1", "lgpl21-2", "lgpl21-3"]),
    ("LGPL-3.0", ["lgpl3-1", "gpl-2", "lgpl21-3"]),
    ("AGPL-3.0", ["agpl3-1", "gpl-2", "agpl3-3"]),
    ("BSL-1.0", ["boost-1"]),
    ("BSL-1.0", ["boost-short"]),
    ("Zlib", ["zlib-1", "zlib-2", "zlib-3"]),
    ("ISC", ["isc-1", "isc-2"]),
    ("EPL-2.0", ["epl-1"]),
    ("WTFPL", ["wtfpl-1"]),
    ("Artistic-2.0", ["artistic-short"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-long"]),
]


# Licences that are found by an SPDX identifier, written as SPDX writes them.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
]


def normal(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


_SPDX_HEAD = "spdx license identifier"
SENTENCES |= {f"spdx-{x}": f"{_SPDX_HEAD} {normal(x)}" for x in SPDX}
RULES += [("GPL-2.0", [x, "gpl-2", "gpl-3"]) for x in ("gpl2only-1", "gpl2only-2", "gpl2only-3")] + [(x, [f"spdx-{x}"]) for x in SPDX]

#: Sentences that count within a longer piece: short notices, and SPDX identifiers, which end a piece or an alternative.
NOTICES = {SENTENCES[x] for x in SENTENCES if "-short" in x or x.startswith(("cc-", "cc0"))}
_SPDX = {SENTENCES[f"spdx-{x}"] for x in SPDX}
#: Licence of a rule, and how what follows its last sentence must not begin: the clause by which BSD-3 is more than BSD-2.
UNLESS = {"BSD-2-Clause": "neither the name"}
GAP_WORDS = 12


def within(sentence: str) -> str:
    """The pattern by which a sentence is found in a piece; pieces of a run are joined by line ends."""
    gap = rf"(?:[^ \n]+[ \n]){{1,{GAP_WORDS}}}?"
    parts = [re.escape(x).replace(r"\ ", r"[ \n]") for x in sentence.split("* ")]
    if sentence in _SPDX:
        name = sentence.removeprefix(f"{_SPDX_HEAD} ")
        # "or later" belongs to an identifier
        return f"(^| ){_SPDX_HEAD} (.* (or|and) )?{name}($| or ([^l]|l[^a])| and | with )"
    if sentence in NOTICES:
        return rf"(^| ){parts[0]}($| )"
    return f"^{gap.join(parts)}($|\\n)"


def _longest_part(sentence: str) -> str:
    return _SPDX_HEAD if sentence in _SPDX else max((x.strip() for x in sentence.split("*")), key=len)


def rule_steps() -> list[tuple[str, int, str, int, int]]:
    """A row per sentence of each rule: licence, rule number, sentence, its place in the rule, the rule's length."""
    return [(licence, k, SENTENCES[s], place, len(ids)) for k, (licence, ids) in enumerate(RULES) for place, s in enumerate(ids)]


def sentences(text: Column) -> Column:
    """Normalised sentences: cut at line ends and after . ! ? ; : that white space follows, but not before an SPDX identifier."""
    text = F.regexp_replace(text, r"(?i)(spdx-license-identifier):[ \t]*", "$1 ")
    lines = F.split(F.regexp_replace(text, r"([.!?;:])[ \t]+", "$1\n"), r"[\n\r]")
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    return F.array_remove(plain, "")


#: Every rule has a sentence with one of these in a word, so a text without any needs no closer look.
ANCHORS = ("licens", "permission", "redistribution", "software", "domain")


def _occurrences(kept: Column, sentence: Column, n_words: Column) -> Column:
    """Array of (at, end): where pieces of `kept` (an array of no, s), from the one at place `at` to before `end`, hold the sentence's words and no other."""

    def at(k: Column) -> Column:
        # a piece has a word at least, so a sentence takes n_words pieces at most
        text = F.array_join(F.transform(F.slice(kept, k, n_words), lambda x: x["s"]), "\n")
        head = F.substr(text, F.lit(1), F.length(sentence))
        whole = (F.translate(head, "\n", " ") == sentence) & F.substr(text, F.length(sentence) + 1, F.lit(1)).isin("", "\n")
        return F.when(whole, F.struct(k.alias("at"), (k + 1 + F.length(head) - F.length(F.translate(head, "\n", ""))).alias("end")))

    starts = F.filter(F.transform(kept, lambda x, k: F.when(F.startswith(sentence, x["s"]), k + 1)), lambda k: k.isNotNull())
    return F.array_compact(F.transform(starts, at))


def _gapped(kept: Column, sentence: Column, n_words: Column, pattern: Column) -> Column:
    """_occurrences() of a sentence that has a gap: found by its pattern from each place on whose words it may begin."""

    def at(k: Column) -> Column:
        text = F.array_join(F.transform(F.slice(kept, k, n_words + GAP_WORDS), lambda x: x["s"]), "\n")
        found = F.call_function("regexp_extract", text, pattern, F.lit(0))
        return F.when(found != "", F.struct(k.alias("at"), (k + 1 + F.length(F.rtrim(found, F.lit("\n"))) - F.length(F.translate(F.rtrim(found, F.lit("\n")), "\n", ""))).cast("int").alias("end")))

    head = F.substring_index(sentence, " *", 1)
    starts = F.filter(F.transform(kept, lambda x, k: F.when(F.startswith(head, x["s"]) | F.startswith(x["s"], head), k + 1)), lambda k: k.isNotNull())
    return F.array_compact(F.transform(starts, at))


def _inside(kept: Column, pattern: Column) -> Column:
    """The pieces that hold a notice; one that is wrapped is found like any sentence."""
    return F.array_compact(F.transform(kept, lambda x, k: F.when(F.regexp_like(x["s"], pattern), F.struct((k + 1).alias("at"), (k + 2).alias("end")))))


def _recognised(kept: Column, known: Column) -> Column:
    """Array of (id, at, end): the occurrences of all known sentences (an array of id, sentence, part, kind, pattern, n_words)."""
    text = F.array_join(F.transform(kept, lambda x: x["s"]), " ")
    span = "array<struct<at:int,end:int>>"
    # the text is a variable of a lambda, so that it is put together once and not for each sentence
    held = F.flatten(F.transform(F.array(text), lambda t: F.filter(known, lambda r: F.contains(t, r["part"]))))
    places = lambda r: F.when(r["kind"] == "inside", F.array_union(_inside(kept, r["pattern"]).cast(span), _occurrences(kept, r["sentence"], r["n_words"]).cast(span))).when(r["kind"] == "gap", _gapped(kept, r["sentence"], r["n_words"], r["pattern"]).cast(span)).otherwise(_occurrences(kept, r["sentence"], r["n_words"]).cast(span))
    found = F.transform(held, lambda r: F.transform(places(r), lambda o: F.struct(r["id"].alias("id"), o["at"].alias("at"), o["end"].alias("end"))))
    return F.flatten(found)


def _ruled(kept: Column, seen: Column, rules: Column) -> Column:
    """Array of (license, rule_id, first_sentence, n_sentences): where occurrences follow one another as a rule (license, rule_id, ids) says."""
    span = "array<struct<at:int,end:int>>"

    def chains(ids: Column) -> Column:
        begun = F.transform(F.filter(seen, lambda o: o["id"] == ids[0]), lambda o: F.struct(o["at"].alias("at"), o["end"].alias("end"))).cast(span)

        def longer(so_far: Column, wanted: Column) -> Column:
            return F.flatten(F.transform(so_far, lambda c: F.transform(F.filter(seen, lambda o: (o["id"] == wanted) & (o["at"] == c["end"])), lambda o: F.struct(c["at"].alias("at"), o["end"].alias("end"))))).cast(span)

        return F.aggregate(F.slice(ids, F.lit(2), F.size(ids)), begun, longer)

    def match(r: Column, c: Column) -> Column:
        first, last = F.get(kept, c["at"] - 1)["no"], F.get(kept, c["end"] - 2)["no"]
        return F.struct(r["license"].alias("license"), r["rule_id"].alias("rule_id"), first.alias("first_sentence"), (last - first + 1).alias("n_sentences"))

    def other(r: Column, c: Column) -> Column:
        """Whether what follows, a list number aside, makes the match another licence."""
        return F.exists(F.slice(kept, c["end"], F.lit(2)), lambda x: F.startswith(x["s"], r["unless"]))

    held = lambda r: F.filter(chains(r["ids"]), lambda c: r["unless"].isNull() | ~other(r, c))
    return F.flatten(F.transform(rules, lambda r: F.transform(held(r), lambda c: match(r, c))))


def _outermost(matches: DataFrame, row: str) -> DataFrame:
    """The matches that don't lie within a longer one of the same row."""
    end = F.col("first_sentence") + F.col("n_sentences")
    before = Window.partitionBy(row).orderBy("first_sentence").rangeBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy(row, "first_sentence")
    inside = F.coalesce(F.max(end).over(before) >= end, F.lit(False)) | (F.max("n_sentences").over(beside) > F.col("n_sentences"))
    return matches.withColumn("_inside", inside).filter("not _inside").drop("_inside")


def license_scan(docs: DataFrame, steps: list[tuple[str, int, str, int, int]] | None = None) -> DataFrame:
    """doc_id, license, rule_id, first_sentence, n_sentences: a row per match. The rules are the library's own fixed table.

    steps: other rules, as rule_steps() gives them. n_sentences counts the document's pieces, which are more than the
    rule's sentences where lines are wrapped.
    """
    steps = sorted(steps or rule_steps(), key=lambda x: (x[1], x[3]))
    number = {sentence: k for k, sentence in enumerate(dict.fromkeys(x[2] for x in steps))}
    ids: dict[tuple[str, int], list[int]] = {}
    for licence, rule_id, sentence, _, _ in steps:
        ids.setdefault((licence, rule_id), []).append(number[sentence])
    kind = lambda x: "inside" if x in NOTICES | _SPDX else "gap" if "*" in x else "whole"
    fields = lambda x, k: {"id": k, "sentence": x, "part": _longest_part(x), "kind": kind(x), "pattern": within(x), "n_words": x.count(" ") + 1}
    known = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in fields(x, k).items())) for x, k in number.items()))
    unless = lambda licence: F.lit(UNLESS.get(licence)).cast("string").alias("unless")
    rules = F.array(*(F.struct(F.lit(licence).alias("license"), F.lit(rule_id).alias("rule_id"), F.array(*map(F.lit, x)).alias("ids"), unless(licence)) for (licence, rule_id), x in ids.items()))
    anchored = all(any(a in " ".join(x[2] for x in steps if x[1] == rule_id) for a in ANCHORS) for _, rule_id in ids)
    likely = F.exists(F.array(F.lower(text_or_empty())), lambda t: reduce(Column.__or__, [F.contains(t, F.lit(a)) for a in ANCHORS])) if anchored else F.lit(True)
    numbered = F.transform(sentences(text_or_empty()), lambda x, k: F.struct(k.alias("no"), x.alias("s")))
    # every step passes a one-element generator, so that the next refers to its result and doesn't work it out again
    once = lambda df, name, value: df.withColumn(name, F.explode(F.array(value)))
    cut = once(docs.filter(likely).select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "all", numbered).drop("text")
    # a number on a line of its own may be a list's or, where the line was wrapped, the sentence's: both readings are tried
    cut = once(cut, "unlisted", F.filter("all", lambda x: ~x["s"].rlike("^[0-9]{1,3}$")))
    for kept in ("all", "unlisted"):
        cut = once(cut, f"seen_{kept}", _recognised(F.col(kept), known))
    cut = cut.filter("size(seen_all) > 0 or size(seen_unlisted) > 0")
    cut = once(cut, "matches", F.array_distinct(F.concat(*(_ruled(F.col(k), F.col(f"seen_{k}"), rules) for k in ("all", "unlisted")))))
    return _outermost(cut.select("row", "doc_id", F.inline("matches")), "row").drop("row").distinct()


def oracle() -> str:
    """The SQL sees sentences that are one piece, so a wrapped sentence is the operator's alone."""
    quoted = ", ".join("('{}', {}, '{}', {}, {}, '{}', {})".format(*x, within(x[2]).replace(r"($|\n)", "$").replace(r"\n", " "), f"'{UNLESS[x[0]]}'" if x[0] in UNLESS else "null") for x in rule_steps())
    return (
        f"with steps(license, rule_id, sentence, place, n_sentences, pattern, unless) as (values {quoted}),"
        + r"""
lines as (
  select row_number() over () as row_no, doc_id, list_filter(list_transform(
      regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)(spdx-license-identifier):[ \t]*', '\1 ', 'g'), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), '[\n\r]'),
      lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x <> '') as s
  from documents),
cut as (select row_no, doc_id, unnest(s) as piece, generate_subscripts(s, 1) - 1 as sentence_no from lines),
seen as (
  select piece, license, rule_id, place, n_sentences, unless from (select distinct piece from cut) p join steps on regexp_matches(piece, pattern)),
runs as (
  select row_no, doc_id, license, rule_id, cast(sentence_no - place as int) as first_sentence, n_sentences, unless
  from cut join seen using (piece) group by all having count(distinct place) = n_sentences),
kept as (
  select r.* from runs r where not exists (
    select 1 from cut c where c.row_no = r.row_no and c.sentence_no between r.first_sentence + r.n_sentences and r.first_sentence + r.n_sentences + 1 and starts_with(c.piece, r.unless)))
select distinct doc_id, license, rule_id, first_sentence, n_sentences from kept r where not exists (
  select 1 from kept w where w.row_no = r.row_no and w.n_sentences > r.n_sentences
    and r.first_sentence >= w.first_sentence and r.first_sentence + r.n_sentences <= w.first_sentence + w.n_sentences)
"""
    )
