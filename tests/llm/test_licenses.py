import re

import pytest

from memlake.llm.licenses import RULES, SENTENCES, STEMS, scan_licenses

BSD = """Copyright 2019 A. Person. All rights reserved.
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list.
2. Redistributions in binary form must reproduce the above copyright notice, this list.
"""


def scan(spark, text):
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return row["sentence_ids"], row["licenses"], row["unmatched"]


@pytest.mark.parametrize("text, licenses", [
    ("Some words.\nLicensed under the Apache License, Version 2.0.\nMore words.", ["Apache-2.0"]),
    ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", ["Apache-2.0"]),
    ("Released under the MIT License. Licensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("All rights reserved.", ["Proprietary"]),
    ("The license of the apache tribe was version 2.", []),
    (BSD, ["BSD-2-Clause", "Proprietary"]),
    ("", []), (None, []),
])
def test_licenses(spark, text, licenses):
    assert scan(spark, text)[1] == licenses


def test_ordered_rules_take_the_longest_sequence_first(spark):
    ids, licenses, rest = scan(spark, BSD)
    assert ids == ["Copyright", "AllRights", "BsdGrant", "BsdSource", "BsdBinary"]
    assert rest == []
    assert licenses == ["BSD-2-Clause", "Proprietary"]


def test_a_wrapped_comment_is_one_sentence(spark):
    text = '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may obtain a copy of the\n// license at x'
    assert scan(spark, text)[0] == ["Apache2Ref", "ApacheCopy"]


@pytest.mark.parametrize("text, ids", [
    ("This file was released into the public\n# domain", ["PublicDomain"]),
    ("All rights\nreserved.", ["AllRights"]),
    ("/* IN NO EVENT\n * SHALL THE REGENTS BE\n * LIABLE */", []),
    ("# in no event\n# shall the regents be liable for it.", ["BsdLiability"]),
    ("Made with  creative\t commons zero 1.0.", ["Cc0"]),
])
def test_wrapped_phrases_are_found(spark, text, ids):
    assert scan(spark, text)[0] == ids


def test_tables_agree():
    names = [n for n, _ in SENTENCES]
    assert len(set(names)) == len(names)
    assert {i for _, ids in RULES for i in ids} <= set(names)
    for _, pattern in SENTENCES:
        assert re.search(STEMS.removeprefix("(?i)"), pattern)


def test_odd_rows(odd_docs, no_docs):
    assert scan_licenses(odd_docs).count() == odd_docs.count()
    assert scan_licenses(no_docs).collect() == []
