"""License scans by sentence rules.

Sentences that may speak of licensing are normalised and mapped to the identifiers of
known licence sentences; a document's sequence of identifiers is then matched against
ordered rules. A rule that matches uses up its sentences, so the longer and more special
rules come first. Everything is DataFrame functions; only documents with a licensing word
are split into sentences.

A line is a sentence, or some, unless a pattern needs the lines of a paragraph together: then
the wrapped sentence is taken as a whole. The SQL twin reads lines only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sentence without any of these beginnings of words is not looked at.
ANCHORS = ["licen", "copyright", "copyleft", "permission", "warrant", "redistribut", "spdx", "public domain", "all rights reserved", "liab", "endorse"]

#: Identifiers of licence sentences and the pattern that a normalised sentence has; the first match counts.
SENTENCES = [
    ("NEGATED", r"\b(not|never|no longer|isn t|aren t|wasn t|cannot)( [a-z]+)? (licensed|released|distributed|available|dedicated) (under|to)\b"),
    ("SPDX_APACHE_2", r"^spdx license identifier apache 2\.0"),
    ("SPDX_MIT", r"^spdx license identifier mit"),
    ("SPDX_GPL_3", r"^spdx license identifier gpl 3"),
    ("SPDX_GPL_2", r"^spdx license identifier gpl 2"),
    ("SPDX_BSD_3", r"^spdx license identifier bsd 3"),
    ("SPDX_BSD_2", r"^spdx license identifier bsd 2"),
    ("SPDX_MPL_2", r"^spdx license identifier mpl 2"),
    ("SPDX_OTHER", r"^spdx license identifier "),
    ("LGPL_3", r"licensed under (the )?(terms of )?(the )?gnu (lesser|library) general public license.* version 3"),
    ("LGPL_2", r"licensed under (the )?(terms of )?(the )?gnu (lesser|library) general public license.* version 2"),
    ("AGPL_3", r"licensed under (the )?(terms of )?(the )?gnu affero general public license.* version 3"),
    ("GPL_3", r"(licensed|released|distributed) under (the )?(terms of )?(the )?gnu general public license version 3"),
    ("GPL_2", r"(licensed|released|distributed) under (the )?(terms of )?(the )?gnu general public license version 2"),
    ("AGPL_FREE_3", r"redistribute it and or modify it under the terms of the gnu affero general public license.* either version 3"),
    ("LGPL_FREE_3", r"redistribute it and or modify it under the terms of the gnu (lesser|library) general public license.* either version 3"),
    ("LGPL_FREE_2", r"redistribute it and or modify it under the terms of the gnu (lesser|library) general public license.* either version 2"),
    ("GPL_FREE_3", r"redistribute it and or modify it under the terms of the gnu general public license.* either version 3"),
    ("GPL_FREE_2", r"redistribute it and or modify it under the terms of the gnu general public license.* either version 2"),
    ("AGPL_FREE_SOFTWARE", r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("LGPL_FREE_SOFTWARE", r"redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("EITHER_3", r"^either version 3 of the license"),
    ("EITHER_2_1", r"^either version 2\.1 of the license"),
    ("EITHER_2", r"^either version 2 of the license"),
    ("GNU_FITNESS", r"without even the implied warranty of merchantability or fitness"),
    ("GNU_DETAILS", r"^see the gnu (lesser |library |affero )?general public license for more details"),
    ("LGPL_COPY", r"you should have received a copy of the gnu (lesser|library) general public license"),
    ("AGPL_COPY", r"you should have received a copy of the gnu affero general public license"),
    ("GPL_FREE_SOFTWARE", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("GPL_HOPE", r"distributed in the hope that it will be useful but without any warranty"),
    ("GPL_COPY", r"you should have received a copy of the gnu general public license"),
    ("APACHE_2", r"(licensed|released|distributed) under (the )?(terms of )?(the )?apache license version 2\.0"),
    ("APACHE_NOT_USE", r"you may not use this file except in compliance with the license"),
    ("APACHE_OBTAIN", r"you may obtain a copy of the license at"),
    ("APACHE_AS_IS", r"software distributed under the license is distributed on an as is basis"),
    ("APACHE_SEE", r"see the license for the specific language governing permissions and limitations"),
    ("CC_BY_NC_ND", r"(licensed|released|distributed|available) under (a |the )?(cc|creative commons) (by nc nd|attribution noncommercial noderiv)"),
    ("CC_BY_NC_SA", r"(licensed|released|distributed|available) under (a |the )?(cc|creative commons) (by nc sa|attribution noncommercial sharealike)"),
    ("CC_BY_NC", r"(licensed|released|distributed|available) under (a |the )?(cc|creative commons) (by nc|attribution noncommercial)"),
    ("CC_BY_SA", r"(licensed|released|distributed|available) under (a |the )?(cc|creative commons) (by sa|attribution sharealike)"),
    ("CC_BY_ND", r"(licensed|released|distributed|available) under (a |the )?(cc|creative commons) (by nd|attribution noderiv)"),
    ("CC_BY", r"(licensed|released|distributed|available) under (a |the )?(cc|creative commons) (by|attribution)"),
    ("CC0", r"(dedicated to the public domain|under (the )?cc0|creative commons zero)"),
    ("MIT_NAMED", r"(licensed|released|distributed|available) under (the )?(terms of )?(the )?mit license"),
    ("MIT_GRANT", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MIT_NOTICE", r"above copyright notice and this permission notice shall be included"),
    ("MIT_AS_IS", r"the software is provided as is without warranty of any kind"),
    ("MIT_LIABLE", r"in no event shall the authors or copyright holders be liable"),
    ("ISC_GRANT", r"permission to use copy modify and or distribute this software for any purpose"),
    ("ISC_AS_IS", r"the software is provided as is and the author disclaims all warranties"),
    ("BSD_NAMED", r"(licensed|released|distributed|available) under (the )?(terms of )?(the )?(new |modified |simplified )?bsd (2 clause |3 clause )?license"),
    ("BSD_REDISTRIBUTE", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSD_SOURCE", r"redistributions of source code must retain the above copyright notice"),
    ("BSD_BINARY", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSD_ENDORSE", r"may be used to endorse or promote products"),
    ("BSD_AS_IS", r"this software is provided by the copyright holders and contributors as is"),
    ("BSD_LIABLE", r"in no event shall the (copyright (holder|holders|owner)|regents) or contributors be liable"),
    ("ISC_LIABLE", r"in no event shall the author be liable"),
    ("MPL_2", r"subject to the terms of the mozilla public license v(ersion)?( ?\.? ?2\.0|$)"),
    ("MPL_OBTAIN", r"copy of the mpl was not distributed with this file"),
    ("EPL_2", r"eclipse public license v(ersion )?\.? ?2\.0"),
    ("UNLICENSE", r"this is free and unencumbered software released into the public domain"),
    ("PUBLIC_DOMAIN", r"(placed|released|is) in(to)? the public domain"),
    ("ALL_RIGHTS", r"all rights reserved"),
    ("COPYRIGHT", r"^(copyright|c) (c )?[0-9]{4}"),
]
UNKNOWN = "UNKNOWN"

#: Licences and the run of sentence identifiers that stands for each, in the order in which they are tried.
RULES = [
    ("Apache-2.0", ["APACHE_2", "APACHE_NOT_USE", "APACHE_OBTAIN", "APACHE_AS_IS", "APACHE_SEE"]),
    ("Apache-2.0", ["APACHE_2", "APACHE_NOT_USE", "APACHE_OBTAIN"]),
    ("GPL-3.0", ["GPL_3", "GPL_HOPE", "GPL_COPY"]),
    ("GPL-2.0", ["GPL_2", "GPL_HOPE", "GPL_COPY"]),
    ("GPL-3.0", ["GPL_FREE_3"]),
    ("GPL-3.0", ["GPL_FREE_SOFTWARE", "EITHER_3"]),
    ("GPL-2.0", ["GPL_FREE_2"]),
    ("GPL-2.0", ["GPL_FREE_SOFTWARE", "EITHER_2"]),
    ("LGPL-3.0", ["LGPL_FREE_3"]),
    ("LGPL-3.0", ["LGPL_FREE_SOFTWARE", "EITHER_3"]),
    ("LGPL-2.1", ["LGPL_FREE_2"]),
    ("LGPL-2.1", ["LGPL_FREE_SOFTWARE", "EITHER_2_1"]),
    ("LGPL-2.1", ["LGPL_FREE_SOFTWARE", "EITHER_2"]),
    ("LGPL-any", ["LGPL_FREE_SOFTWARE"]),
    ("AGPL-3.0", ["AGPL_FREE_3"]),
    ("AGPL-3.0", ["AGPL_FREE_SOFTWARE", "EITHER_3"]),
    ("AGPL-any", ["AGPL_FREE_SOFTWARE"]),
    ("GPL-any", ["GPL_FREE_SOFTWARE", "GPL_HOPE", "GPL_COPY"]),
    ("GPL-any", ["GPL_FREE_SOFTWARE"]),
    ("BSD-3-Clause", ["BSD_REDISTRIBUTE", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE", "BSD_AS_IS"]),
    ("BSD-2-Clause", ["BSD_REDISTRIBUTE", "BSD_SOURCE", "BSD_BINARY", "BSD_AS_IS"]),
    ("BSD-any", ["BSD_REDISTRIBUTE"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABLE"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS"]),
    ("MIT", ["MIT_GRANT", "MIT_AS_IS"]),
    ("MIT", ["MIT_GRANT", "MIT_NOTICE"]),
    ("ISC", ["ISC_GRANT", "ISC_AS_IS"]),
    ("ISC", ["ISC_GRANT"]),
    ("Apache-2.0", ["APACHE_2"]),
    ("Apache-2.0", ["SPDX_APACHE_2"]),
    ("MIT", ["MIT_NAMED"]),
    ("MIT", ["SPDX_MIT"]),
    ("LGPL-3.0", ["LGPL_3"]),
    ("LGPL-2.1", ["LGPL_2"]),
    ("AGPL-3.0", ["AGPL_3"]),
    ("GPL-3.0", ["GPL_3"]),
    ("GPL-3.0", ["SPDX_GPL_3"]),
    ("GPL-2.0", ["GPL_2"]),
    ("GPL-2.0", ["SPDX_GPL_2"]),
    ("BSD-3-Clause", ["SPDX_BSD_3"]),
    ("BSD-2-Clause", ["SPDX_BSD_2"]),
    ("BSD-any", ["BSD_NAMED"]),
    ("CC-BY-NC-ND", ["CC_BY_NC_ND"]),
    ("CC-BY-NC-SA", ["CC_BY_NC_SA"]),
    ("CC-BY-NC", ["CC_BY_NC"]),
    ("CC-BY-SA", ["CC_BY_SA"]),
    ("CC-BY-ND", ["CC_BY_ND"]),
    ("CC-BY", ["CC_BY"]),
    ("CC0", ["CC0"]),
    ("MPL-2.0", ["MPL_2"]),
    ("MPL-2.0", ["SPDX_MPL_2"]),
    ("EPL-2.0", ["EPL_2"]),
    ("Unlicense", ["UNLICENSE"]),
    ("public-domain", ["PUBLIC_DOMAIN"]),
    ("SPDX-other", ["SPDX_OTHER"]),
    ("all-rights-reserved", ["ALL_RIGHTS"]),
]

# The same expressions serve Spark and the SQL twin; they use what both dialects read alike.
_ANCHOR = "|".join(ANCHORS)
#: A sentence ends at a line end, or at a mark with white space behind it.
_END, _ENDED = r"([.!?;])[ \t\r\n]+", "\n"
_NOISE, _EDGE = r"[^\p{L}\p{N}.]+", r"^[ .]+|[ .]+$"


def normalised(sentence: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(sentence), _NOISE, " "), _EDGE, "")


def identifier(sentence: Column) -> Column:
    """Of a normalised sentence."""
    out = F.lit(UNKNOWN)
    for name, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(pattern), F.lit(name)).otherwise(out)
    return out


#: Wrapped sentences end at a mark with white space behind it, and before a line without letters and digits.
_GROUP = r"(?<=[.!?;])[ \t\r\n]+|\n(?=[^\p{L}\p{N}\n]*(?:\n|$))"
#: A line end with the marks of a comment.
_WRAP = r"[ \t\r]*\n[ \t\r*#/;>%|!-]*"
#: Anchors over line ends, and what patterns without an anchor begin to match at; a line with only the latter counts if a pattern has it.
_NEAR = "|".join([*(a.replace(" ", "[^a-z]+") for a in ANCHORS), r"creative[^a-z]+commons", r"\bcc[^a-z0-9]*(0|by)", r"\bc[^a-z0-9]+[0-9]{4}"])


def _named(text: Column) -> Column:
    return F.struct(text.alias("s"), identifier(normalised(text)).alias("id"))


def _of_group(lines: Column, whole: Column) -> Column:
    """Sentences of a group: its lines, unless its lines together are a known one that they hold in part."""
    known = F.filter(lines, lambda x: x["id"] != UNKNOWN)
    first = F.array_position(F.transform(known, lambda x: x["id"]), whole["id"])
    put = F.transform(known, lambda x, i: F.when(i == first - 1, whole).otherwise(x))
    return (
        F.when(whole.isNull() | (whole["id"] == UNKNOWN), lines)
        .when(first == 0, F.concat(F.array(whole), known))
        .when(F.size(known) < F.size(lines), put)
        .otherwise(lines)
    )


def sentences(text: Column) -> Column:
    """Sentences that may speak of licensing, as they stand (line ends as spaces), and their identifiers; none for null texts."""
    near = F.when(F.lower(text).rlike(_NEAR), text)

    def of(group: Column) -> Column:
        lines = F.transform(F.filter(F.split(group, "\n"), lambda s: F.lower(s).rlike(_NEAR)), _named)
        lines = F.filter(lines, lambda x: (x["id"] != UNKNOWN) | F.lower(x["s"]).rlike(_ANCHOR))
        whole = F.when(F.instr(group, "\n") > 0, _named(F.regexp_replace(group, _WRAP, " ")))
        # Bound once by an array of one, as either is used more than once.
        both = F.array(F.struct(lines.alias("lines"), whole.alias("whole")))
        return F.flatten(F.transform(both, lambda x: _of_group(x["lines"], x["whole"])))

    groups = F.filter(F.split(near, _GROUP), lambda g: F.lower(g).rlike(_NEAR))
    return F.coalesce(F.flatten(F.transform(groups, of)), F.array().cast("array<struct<s:string,id:string>>"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentences, sentence_ids, licenses (arrays) and n_unknown of every row of ``docs``.

    ``sentences`` are the document's own, ``sentence_ids`` their identifiers in order with
    ``UNKNOWN`` for those that no pattern has; ``licenses`` are named once each, in the
    order of the rules. Null and empty texts have none; null ids stay null; repeated rows
    give repeated results; further columns are not read; an empty table gives no rows.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), sentences(F.col(text_col).cast("string")).alias("__named"))
    out = out.select("doc_id", F.col("__named.s").alias("sentences"), F.col("__named.id").alias("sentence_ids"))
    # Each identifier stands between two commas of its own, so that runs that touch are told apart.
    out = out.withColumn("__run", F.concat(F.lit(","), F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit(","), s, F.lit(","))), ""), F.lit(",")))
    found = []
    for k, (name, ids) in enumerate(RULES):
        run = "".join(f",{i}," for i in ids)
        hit = F.when(F.instr("__run", run) > 0, F.lit(name))
        out = out.withColumn(f"__hit{k}", hit).withColumn("__run", F.replace(F.col("__run"), F.lit(run), F.lit(",;,")))
        found.append(F.col(f"__hit{k}"))
    licenses = F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return out.select("doc_id", "sentences", "sentence_ids", licenses.alias("licenses"), F.size(F.filter("sentence_ids", lambda s: s == UNKNOWN)).cast("long").alias("n_unknown"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "n_unknown",
        F.md5(F.array_join("sentences", "\n")).alias("sentences_md5"),
    )


def _oracle() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    case = " ".join(f"WHEN regexp_matches(b, {quoted(p)}) THEN '{n}'" for n, p in SENTENCES)
    hits, run = [], "run"
    steps = "SELECT doc_id, sentences, ids, run AS r0 FROM runs"
    for k, (name, ids) in enumerate(RULES):
        text = "".join(f",{i}," for i in ids)
        steps = f"SELECT * EXCLUDE (r{k}), CASE WHEN contains(r{k}, '{text}') THEN '{name}' END AS h{k}, replace(r{k}, '{text}', ',;,') AS r{k + 1} FROM ({steps})"
        hits.append(f"h{k}")
    return f"""
WITH near AS (
  SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{_ANCHOR}') THEN text END AS t FROM documents
), cut AS (
  SELECT doc_id, coalesce(list_filter(string_split(regexp_replace(t, '{_END}', '\\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(lower(s), '{_ANCHOR}')), []) AS sentences FROM near
), named AS (
  SELECT doc_id, sentences, list_transform(list_transform(sentences, lambda s: regexp_replace(regexp_replace(lower(s), '{_NOISE}', ' ', 'g'), '{_EDGE}', '', 'g')),
         lambda b: CASE {case} ELSE '{UNKNOWN}' END) AS ids FROM cut
), runs AS (
  SELECT *, ',' || array_to_string(list_transform(ids, lambda i: ',' || i || ','), '') || ',' AS run FROM named
), ruled AS ({steps})
SELECT doc_id, len(sentences)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       coalesce(array_to_string((SELECT list(h ORDER BY k) FROM (SELECT h, min(k) AS k FROM (SELECT unnest([{", ".join(hits)}]) AS h, unnest(range({len(hits)})) AS k) WHERE h IS NOT NULL GROUP BY h)), ','), '') AS licenses,
       len(list_filter(ids, lambda i: i = '{UNKNOWN}'))::BIGINT AS n_unknown, md5(array_to_string(sentences, chr(10))) AS sentences_md5
FROM ruled
"""


ORACLE_SQL = _oracle()
