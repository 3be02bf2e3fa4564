"""Licence scans by sentence rules (DataFrame functions only).

A text is lower-cased, cut into lines and at stops before white space, and each piece
is normalised (runs of signs become one space). A known sentence is one piece or, as
notices are wrapped, several in a row with single line ends between them; blank lines
(also those of signs only) and stops end it. Where two begin together the longer goes.
Sentences in ``SENTENCES`` and ``HEADERS`` become their identifiers, others fall out;
``n_sentences`` counts the pieces. The identifiers in order
are matched against ``RULES``, in their order: an earlier rule takes its identifiers
before a later one sees them, so whole texts go before single lines.

Sentences have slots (``SLOTS``): an organisation's name in a BSD clause, a program's in a
GPL header, SPDX tags joined by OR or AND, each of which is a sentence of its own then.

Defined cases: a null or empty text has no sentences and no licence; repeated
sentences count each time; repeated rows and null doc_ids keep a row each; a text of
any length stays in its row; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Sentences of published licences and their headers, normalised; ``|`` is a stop within one.
SENTENCES = {
    "apache-2-line": "licensed under the apache license version 2 0",
    "apache-2-use": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at",
    "apache-2-url": "http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-line": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl-3-line": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-line": "licensed under the bsd 3 clause license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-old": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-line": "distributed under the boost software license version 1 0",
    "mpl-2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "epl-1-line": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl-2-line": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc-by-nc-4-line": "licensed under cc by nc 4 0",
    "cc-by-4-line": "licensed under cc by 4 0",
    "cc-by-sa-4-line": "licensed under cc by sa 4 0",
    "cc-by-4-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-line": "dedicated to the public domain under cc0 1 0",
    "all-rights": "all rights reserved",
}

#: (rule, licence, identifiers in order); earlier rules go first.
RULES = [
    ("apache-2-notice", "Apache-2.0", ["apache-2-line", "apache-2-use", "apache-2-copy", "apache-2-url", "apache-as-is", "apache-see"]),
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("gpl-3-notice", "GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("gpl-2-notice", "GPL-2.0-or-later", ["gpl-2-free", "gpl-hope"]),
    ("gpl-2-only-notice", "GPL-2.0-only", ["gpl-2-only", "gpl-hope"]),
    ("agpl-3-notice", "AGPL-3.0-or-later", ["agpl-free", "gpl-hope"]),
    ("lgpl-21-notice", "LGPL-2.1-or-later", ["lgpl-21-free", "lgpl-hope"]),
    ("lgpl-3-notice", "LGPL-3.0-or-later", ["lgpl-3-free", "lgpl-hope"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "zlib-grant"]),
    ("unlicense-text", "Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("apache-2-all-rights", "Apache-2.0", ["all-rights", "apache-2-line"]),
    ("apache-2", "Apache-2.0", ["apache-2-line"]),
    ("mit-grant", "MIT", ["mit-grant"]),
    ("mit", "MIT", ["mit-line"]),
    ("mit-licensed", "MIT", ["mit-licensed"]),
    ("gpl-3", "GPL-3.0-only", ["gpl-3-line"]),
    ("gpl-3-free", "GPL-3.0-or-later", ["gpl-free"]),
    ("gpl-2-free", "GPL-2.0-or-later", ["gpl-2-free"]),
    ("gpl-2-only", "GPL-2.0-only", ["gpl-2-only"]),
    ("agpl-3-free", "AGPL-3.0-or-later", ["agpl-free"]),
    ("lgpl-21-free", "LGPL-2.1-or-later", ["lgpl-21-free"]),
    ("lgpl-3-free", "LGPL-3.0-or-later", ["lgpl-3-free"]),
    ("bsd-text", "BSD-3-Clause", ["bsd-redistribution"]),
    ("bsd", "BSD-3-Clause", ["bsd-line"]),
    ("isc", "ISC", ["isc-grant"]),
    ("isc-old", "ISC", ["isc-grant-old"]),
    ("0bsd", "0BSD", ["0bsd-grant"]),
    ("zlib", "Zlib", ["zlib-grant"]),
    ("bsl-1", "BSL-1.0", ["bsl-line"]),
    ("mpl-2", "MPL-2.0", ["mpl-2-form"]),
    ("epl-1", "EPL-1.0", ["epl-1-line"]),
    ("epl-2", "EPL-2.0", ["epl-2-line"]),
    ("unlicense", "Unlicense", ["unlicense-free"]),
    ("cc-by-nc-4", "CC-BY-NC-4.0", ["cc-by-nc-4-line"]),
    ("cc-by-sa-4", "CC-BY-SA-4.0", ["cc-by-sa-4-line"]),
    ("cc-by-4", "CC-BY-4.0", ["cc-by-4-line"]),
    ("cc-by-nc-4-work", "CC-BY-NC-4.0", ["cc-by-nc-4-work"]),
    ("cc-by-sa-4-work", "CC-BY-SA-4.0", ["cc-by-sa-4-work"]),
    ("cc-by-4-work", "CC-BY-4.0", ["cc-by-4-work"]),
    ("cc0", "CC0-1.0", ["cc0-line"]),
    ("all-rights-reserved", "Proprietary", ["all-rights"]),
]

_USE = f"{SENTENCES['apache-2-line']} the license {SENTENCES['apache-2-use']}"
_COPY = f"{SENTENCES['apache-2-copy']} {SENTENCES['apache-2-url']}"
_GRANT = f"{SENTENCES['mit-grant']} {SENTENCES['mit-notice']}"
#: Sentences of the canonical headers, longer than a line, and paragraphs that run on in one.
HEADERS = {
    "apache-2-header": _USE,
    "apache-2-copy-url": _COPY,
    "apache-2-copy-as-is": f"{_COPY} {SENTENCES['apache-as-is']}",
    "mit-grant-notice": _GRANT,
    "mpl-2-header": "this source code form is subject to the terms of the mozilla public license v|2 0",
}

#: As ``RULES``, and ahead of them.
HEADER_RULES = [
    *[
        (f"apache-2-{name}", "Apache-2.0", ["apache-2-header", *middle, "apache-see"])
        for name, middle in [
            ("header", ["apache-2-copy", "apache-2-url", "apache-as-is"]),
            ("header-two-lines", ["apache-2-copy-url", "apache-as-is"]),
            ("header-one-line", ["apache-2-copy-as-is"]),
        ]
    ],
    ("apache-2-header-line", "Apache-2.0", ["apache-2-header"]),
    ("mit-text-one-line", "MIT", ["mit-grant-notice", "mit-as-is"]),
    ("mit-grant-notice", "MIT", ["mit-grant-notice"]),
    ("mpl-2-header", "MPL-2.0", ["mpl-2-header"]),
]

# One identifier and rule for the SPDX tag of each licence.
for _licence in sorted({r[1] for r in RULES if r[1] != "Proprietary"}):
    _id = f"spdx-{_licence.lower()}"
    HEADERS[_id] = "spdx license identifier " + _licence.lower().replace("-", " ").replace(".", " ")
    HEADER_RULES.append((_id, _licence, [_id]))

#: Slots: a name, an organisation or a list of tags stands in a sentence. (what must be there, pattern,
#: what takes its place), in order; a space of a pattern may be a line's end, ``\\1`` is a group.
_NAMED = "(?:[^ \\n]+ ){1,%d}?"
_ACROSS = "(?:[^ \\n]+ +){1,%d}?"  # also over stops, as in "Inc."
_TAGS = "|".join(sorted((s.removeprefix("spdx license identifier ") for i, s in HEADERS.items() if i.startswith("spdx-")), key=len, reverse=True))
_TAG_PAIR = (f"(spdx license identifier (?:{_TAGS})) (?:or|and) ({_TAGS})(\\n|$)", "\\1\nspdx license identifier \\2\\3")
_TAG_LIST = (f"(spdx license identifier (?:{_TAGS})) (?:or|and) ((?:{_TAGS}) (?:or|and) )", "\\1\nspdx license identifier \\2")
SLOTS = [
    ("neither", f"neither the name of {_ACROSS % 12}nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("endorse", f"(^|\\n)the name of {_ACROSS % 12}may not be used to endorse", "\\1neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    ("free software", f"(^|\\n){_NAMED % 6}is free software you can redistribute it and or modify it under the terms of the gnu (affero )?general", "\\1this program is free software you can redistribute it and or modify it under the terms of the gnu \\2general"),
    ("free software", f"(^|\\n){_NAMED % 6}is free software you can redistribute it and or modify it under the terms of the gnu lesser", "\\1this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"),
    ("spdx", *_TAG_LIST),
    ("spdx", *_TAG_PAIR),
]


def _pattern(text: str) -> str:
    """A space is a space or a line's end, outside of brackets."""
    return re.sub(r"(\[[^\]]*\])| ", lambda m: m[1] or "[ \\n]", text)


STOPS = r"[.!?]+([ \t\n\f\r]|$)"
SIGNS = r"[^\p{L}\p{N}\n]+"


def pieces(text: Column) -> Column:
    """A text of normalised pieces: a line end between two lines, two or more where a sentence must end."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), STOPS, "\n\n"), SIGNS, " ")
    return F.trim(F.regexp_replace(cut, " ?\n ?", "\n"))


def filled(cut: Column) -> Column:
    """``pieces`` with each slot's sentence in its listed wording."""
    for need, pattern, wording in SLOTS:
        cut = F.when(cut.contains(need), F.regexp_replace(cut, _pattern(pattern), wording.replace("\\", "$"))).otherwise(cut)
    return cut


def known(cut: Column) -> Column:
    """Identifiers of the known sentences of ``pieces``, in order, as ``<id>`` joined."""
    every = {s: i for i, s in (SENTENCES | HEADERS).items()}
    ids = F.create_map(*[F.lit(x) for pair in every.items() for x in pair])
    words = [s.replace(" ", "[ \n]").replace("|", "\n\n+") for s in sorted(every, key=len, reverse=True)]
    found = F.regexp_extract_all(cut, F.lit(rf"(?<![^\n])({'|'.join(words)})(?![^\n])"), F.lit(1))
    plain = lambda s: F.translate(F.regexp_replace(s, "\n\n+", "|"), "\n", " ")
    return F.array_join(F.transform(found, lambda s: F.concat(F.lit("<"), F.element_at(ids, plain(s)), F.lit(">"))), "")


def rules(sequence: Column) -> Column:
    """The sequence with each rule's identifiers taken by ``[rule]``, rules in order."""
    return reduce(lambda left, r: F.replace(left, F.lit("".join(f"<{i}>" for i in r[2])), F.lit(f"[{r[0]}]")), HEADER_RULES + RULES, sequence)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, identifiers, rules and licences of every row, in order of the text."""
    licence = F.create_map(*[F.lit(x) for r in HEADER_RULES + RULES for x in r[:2]])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pieces(F.col("text")).alias("_s"))
    n = F.size(F.filter(F.split("_s", "\n"), lambda s: s != ""))
    rows = rows.select("doc_id", n.cast("long").alias("n_sentences"), known(filled(F.col("_s"))).alias("identifiers"))
    rows = rows.withColumn("rules", F.regexp_extract_all(rules(F.col("identifiers")), F.lit(r"\[([^\]]+)\]"), F.lit(1)))
    return rows.withColumn("licences", F.array_distinct(F.transform("rules", lambda r: F.element_at(licence, r))))


def op4_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "identifiers", F.array_join("rules", ",").alias("rules"), F.array_join("licences", ",").alias("licences"))


def _oracle() -> str:
    """The same in DuckDB, whose patterns can't look around: line ends are doubled, so that neighbours don't share one."""
    every = {s: i for i, s in (SENTENCES | HEADERS).items()}
    own = reduce(lambda left, x: f"regexp_replace({left}, '{_pattern(x[1])}', '{x[2]}', 'g')", SLOTS, "s")
    words = "|".join(s.replace("|", "\0").replace(" ", "(?: |\\n\\n)").replace("\0", "(?:\\n\\n){2,}") for s in sorted(every, key=len, reverse=True))
    ids = " ".join(f"when '{s}' then '<{i}>'" for s, i in every.items())
    taken = reduce(lambda left, r: f"replace({left}, '{''.join(f'<{i}>' for i in r[2])}', '[{r[0]}]')", HEADER_RULES + RULES, "identifiers")
    licence = " ".join(f"when '{r[0]}' then '{r[1]}'" for r in HEADER_RULES + RULES)
    return f"""
with cut as (
  select cast(doc_id as bigint) doc_id,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{STOPS}', chr(10) || chr(10), 'g'), '{SIGNS}', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ') s
  from documents
), found as (
  select doc_id, cast(len(list_filter(string_split(s, chr(10)), lambda x: x <> '')) as bigint) n_sentences,
    regexp_extract_all(chr(10) || replace({own}, chr(10), chr(10) || chr(10)) || chr(10), '\\n({words})\\n', 1) k
  from cut
), named as (
  select doc_id, n_sentences,
    coalesce(array_to_string(list_transform(k, lambda x: case replace(regexp_replace(x, '(\\n\\n)(\\n\\n)+', '|', 'g'), chr(10) || chr(10), ' ') {ids} end), ''), '') identifiers
  from found
), ruled as (
  select *, regexp_extract_all({taken}, '\\[([^\\]]+)\\]', 1) r from named
), licensed as (
  select *, list_transform(r, lambda x: case x {licence} end) l from ruled
)
select doc_id, n_sentences, identifiers, coalesce(array_to_string(r, ','), '') rules,
  coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') licences
from licensed
"""


ORACLE = _oracle()
