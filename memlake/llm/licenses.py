"""Licence scan: normalised sentences become known identifiers, and ordered rules read the identifier sequence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.base import ascii_lower, narrow, no_items

SPACE = r"[\x20\x09-\x0D]"
BREAK = "\x01"

#: A normalised sentence without any of these is none of the table below.
STEMS = (
    r"(?i)licen[cs]|copyright|warrant|redistribution|rights reserved|public domain|neither the name|permission|"
    r"cc[ -]by|cc0|creative commons|in no event shall|software is provided|mpl was"
)

#: A raw text without any of these holds none: line ends, comment marks and blanks may stand between two words.
RAW_STEMS = re.sub(r" |\[ -\]", "[^A-Za-z0-9]+", STEMS)

# Licence sentences in normal form (lower case, words of letters and digits), as whole-sentence patterns.
_V = r"(?: as published by the free software foundation)?"
_LATER = r" (?:or (?:at your option )?any later version)"
SENTENCES: list[tuple[str, str]] = [
    ("Spdx", r"spdx license identifier [a-z0-9 ]+"),
    ("Copyright", r"(?:c )?copyright (?:c )?[0-9]{4}.*"),
    ("AllRights", r"all rights reserved"),
    ("Apache2Ref", r"(?:this (?:file|work|program|document) is )?licensed under the apache license,? version 2 0"
                   r"(?: the license)?(?: you may not use this file except in compliance with the license)?"),
    ("ApacheCopy", r"you may obtain a copy of the license at.*"),
    ("ApacheLimit", r"unless required by applicable law or agreed to in writing software distributed under the license"
                    r" is distributed on an as is basis without warranties or conditions of any kind either express"
                    r" or implied"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", r"(?:(?:this \w+ is )?(?:released|licensed|distributed|available) )?under the (?:terms of the )?mit license"),
    ("MitTitle", r"(?:the )?mit license(?: mit)?"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and"
                 r" associated documentation files the software.*"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies or"
                  r" substantial portions of the software"),
    ("MitWarranty", r"the software is provided as is without warranty of any kind.*"),
    ("MitLiability", r"in no event shall the authors or copyright holders be liable.*"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted"
                 r" provided that the following conditions are met"),
    ("BsdSource", r"(?:1 )?redistributions of source code must retain the above copyright notice.*"),
    ("BsdBinary", r"(?:2 )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdNames", r"(?:3 )?neither the name of .* may be used to endorse or promote products.*"),
    ("BsdWarranty", r"this software is provided by the (?:copyright holders|regents|author).* as is.*"),
    ("BsdLiability", r"in no event shall the (?:copyright|regents|author).* be liable.*"),
    ("BsdRef", r"(?:\w+ )*under (?:the|a) (?:new |modified |3 clause )?bsd (?:style )?license"),
    ("IscGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is"
                 r" hereby granted.*"),
    ("Agpl3Ref", r"(?:\w+ )*gnu affero general public license (?:version|v) ?3(?: 0)?" + _V),
    ("Agpl3Later", r"(?:\w+ )*gnu affero general public license" + _V + r" (?:either )?(?:version|v) ?3(?: 0)?(?: of the license)?" + _LATER),
    ("Lgpl21Ref", r"(?:\w+ )*gnu lesser general public license (?:version|v) ?2 1" + _V),
    ("Lgpl3Ref", r"(?:\w+ )*gnu lesser general public license (?:version|v) ?3(?: 0)?" + _V),
    ("LgplLater", r"(?:\w+ )*gnu lesser general public license" + _V + r" (?:either )?(?:version|v) ?[23](?: [01])?(?: of the license)?" + _LATER),
    ("Gpl2Ref", r"(?:\w+ )*gnu general public license (?:version|v) ?2(?: 0)?" + _V),
    ("Gpl2Later", r"(?:\w+ )*gnu general public license" + _V + r" (?:either )?(?:version|v) ?2(?: 0)?(?: of the license)?" + _LATER),
    ("Gpl3Ref", r"(?:\w+ )*gnu general public license (?:version|v) ?3(?: 0)?" + _V),
    ("Gpl3Later", r"(?:\w+ )*gnu general public license" + _V + r" (?:either )?(?:version|v) ?3(?: 0)?(?: of the license)?" + _LATER),
    ("GplWarranty", r"this (?:program|library) is distributed in the hope that it will be useful.*without any warranty.*"),
    ("GplCopy", r"you should have received a copy of the gnu (?:lesser |affero )?general public license.*"),
    ("Mpl2Ref", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("Mpl2Copy", r"if a copy of the mpl was not distributed with this file you can obtain one at.*"),
    ("CcByNc", r"(?:\w+ )*(?:cc by nc|creative commons attribution non ?commercial) [0-9] 0(?: international)?(?: license)?"),
    ("CcBySa", r"(?:\w+ )*(?:cc by sa|creative commons attribution share ?alike) [0-9] 0(?: international)?(?: license)?"),
    ("CcByNd", r"(?:\w+ )*(?:cc by nd|creative commons attribution no ?derivatives) [0-9] 0(?: international)?(?: license)?"),
    ("CcBy", r"(?:\w+ )*licensed? under (?:a |the )?(?:cc by|creative commons attribution) [0-9] 0(?: international)?(?: license)?"),
    ("Cc0", r"(?:\w+ )*(?:cc0|creative commons zero) (?:1 0|license|public domain).*"),
    ("PublicDomain", r"this (?:\w+ )+(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial.*"),
    ("Proprietary", r"(?:\w+ )*(?:no part of this \w+ may be reproduced|unauthorized copying).*permission.*"),
]

# The first rule that fits takes its identifiers out of the sequence, then the next is tried.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("Apache2Ref", "ApacheCopy", "ApacheLimit", "ApacheSee")),
    ("Apache-2.0", ("Apache2Ref", "ApacheCopy", "ApacheLimit")),
    ("Apache-2.0", ("Apache2Ref", "ApacheCopy")),
    ("MIT", ("MitTitle", "MitGrant", "MitNotice", "MitWarranty", "MitLiability")),
    ("MIT", ("MitGrant", "MitNotice", "MitWarranty", "MitLiability")),
    ("MIT", ("MitGrant", "MitNotice", "MitWarranty")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames", "BsdWarranty", "BsdLiability")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdWarranty", "BsdLiability")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("ISC", ("IscGrant", "MitWarranty")),
    ("ISC", ("IscGrant",)),
    ("AGPL-3.0-or-later", ("Agpl3Later", "GplWarranty", "GplCopy")),
    ("AGPL-3.0-or-later", ("Agpl3Later",)),
    ("AGPL-3.0-only", ("Agpl3Ref",)),
    ("LGPL-or-later", ("LgplLater", "GplWarranty", "GplCopy")),
    ("LGPL-or-later", ("LgplLater",)),
    ("LGPL-2.1-only", ("Lgpl21Ref",)),
    ("LGPL-3.0-only", ("Lgpl3Ref",)),
    ("GPL-3.0-or-later", ("Gpl3Later", "GplWarranty", "GplCopy")),
    ("GPL-3.0-or-later", ("Gpl3Later",)),
    ("GPL-2.0-or-later", ("Gpl2Later", "GplWarranty", "GplCopy")),
    ("GPL-2.0-or-later", ("Gpl2Later",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("MPL-2.0", ("Mpl2Ref", "Mpl2Copy")),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("Apache-2.0", ("Apache2Ref",)),
    ("MIT", ("MitRef",)),
    ("MIT", ("MitTitle",)),
    ("BSD", ("BsdRef",)),
    ("CC-BY-NC", ("CcByNc",)),
    ("CC-BY-SA", ("CcBySa",)),
    ("CC-BY-ND", ("CcByNd",)),
    ("CC-BY", ("CcBy",)),
    ("CC0-1.0", ("Cc0",)),
    ("Unlicense", ("Unlicense",)),
    ("Zlib", ("ZlibGrant",)),
    ("Public-Domain", ("PublicDomain",)),
    ("SPDX-tag", ("Spdx",)),
    ("Proprietary", ("Proprietary",)),
    ("Proprietary", ("Copyright", "AllRights")),
    ("Proprietary", ("AllRights",)),
]

# A new sentence starts after an end mark and white space, after a blank line, and on a line that doesn't go on in
# lower case.
COMMENT = rf"(^|\n){SPACE}*(?://+|#+|/?\*+|--|;+)"
SENTENCE_BREAKS = [
    (rf"([.!?;:]){SPACE}+", r"$1" + BREAK),
    (rf"\n{SPACE}*\n", BREAK),
    (rf"\n({SPACE}*[^a-z\x20\x09-\x0D])", BREAK + r"$1"),
]


def sentences(text: Column) -> Column:
    """The sentences of a text in normal form: lower-case letters and digits, single spaces."""
    marked = F.regexp_replace(text, COMMENT, "$1")
    for pattern, to in SENTENCE_BREAKS:
        marked = F.regexp_replace(marked, pattern, to)
    return F.transform(
        F.split(marked, BREAK, -1),
        lambda s: F.trim(F.regexp_replace(ascii_lower(s), "[^a-z0-9]+", " ")),
    )


def identifier(sentence: Column) -> Column:
    """The first known sentence that a normalised sentence is, or null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        found = F.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


def _tag(names) -> str:
    return "".join(f"<{n}>" for n in names)


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences that a text states, sentence by sentence.

    Returns doc_id, sentence_ids (known sentences in order), licenses (in the order of the rules, each once)
    and unmatched (identifiers that no rule took), all arrays, one row per input row. The rules see the
    identifiers side by side even if other sentences lie between.

    Null and empty texts have none. Ids, ties and repeated rows don't matter; empty tables give no rows; other
    columns are ignored. Everything is computed inside the row.
    """
    rows = narrow(docs, doc_id=id, _text=text)
    known = F.when(
        F.col("_text").rlike(RAW_STEMS),
        F.filter(F.transform(F.filter(sentences(F.col("_text")), lambda s: s.rlike(STEMS)), identifier),
                 lambda x: x.isNotNull()),
    ).otherwise(no_items("string"))
    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(_tag(ids)).alias("tag")) for name, ids in RULES])
    start = F.struct(
        F.concat(F.lit(""), F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
        .alias("rest"),
        no_items("string").alias("licenses"),
    )

    def step(state, rule):
        fits = F.contains(state["rest"], rule["tag"])
        return F.struct(
            F.replace(state["rest"], rule["tag"], F.lit("|")).alias("rest"),
            F.when(fits, F.array_append(state["licenses"], rule["license"])).otherwise(state["licenses"])
            .alias("licenses"),
        )

    read = rows.select("doc_id", known.alias("sentence_ids")).withColumn(
        "_end", F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, step))
    )
    rest = F.regexp_extract_all(F.col("_end")["rest"], F.lit("<([A-Za-z0-9]+)>"), F.lit(1))
    return read.select(
        "doc_id", "sentence_ids",
        F.coalesce(F.array_distinct(F.col("_end")["licenses"]), no_items("string")).alias("licenses"),
        F.coalesce(rest, no_items("string")).alias("unmatched"),
    )
