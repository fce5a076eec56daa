import collections
import re

import pytest

from memlake.llm.line_quality import clean_lines

GOOD = "Here is a plain sentence of eight words."


def judge(spark, text):
    return clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


@pytest.mark.parametrize("line, kept", [
    (GOOD, True), ("An item, and more", True), ("no end of a sentence here", False),
    ("Home | News | Sport | Contact", False), ("One | thing in a long sentence is fine.", True),
    ("Please accept cookies to go on.", False), ("We all like to eat a cookier thing.", True),
    ("Wh### at### is%%% this&&& now.", False), ("RUN!! NOW!! OR!! ELSE!! GO.", False), ("   ", False),
])
def test_lines(spark, line, kept):
    assert judge(spark, f"{line}\n{GOOD}")["cleaned"] == (f"{line}\n{GOOD}" if kept else GOOD)


def test_documents_that_lose_too_much(spark):
    prose = "\n".join(f"s{i} says t{i} that u{i} thing v{i} is w{i} steps x{i}." for i in range(10))
    bars = "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(20))
    assert judge(spark, prose)["kept"] and judge(spark, prose + "\nshort tail")["kept"]
    assert not judge(spark, prose + "\n" + bars)["kept"]
    assert judge(spark, "Few words only.")["base_failed"]
    assert judge(spark, "again and " * 40)["base_failed"]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = collections.defaultdict(list)
    for i in range(len(words) - 2):
        runs[tuple(words[i : i + 3])].append(i)
    inside = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_counts(spark, rng, odd_docs):
    texts = ["".join(rng.choice("ab c\n#|é\U0001f600\x0b") for _ in range(rng.randint(0, 200))) for _ in range(100)]
    texts += [r["text"] for r in odd_docs.collect()]
    rows = clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == plain(texts[r["doc_id"]])


def test_odd_rows(odd_docs, no_docs):
    assert clean_lines(odd_docs).count() == odd_docs.count()
    assert clean_lines(odd_docs).where("kept AND (text IS NULL OR text = '')").isEmpty()
    assert clean_lines(no_docs).collect() == []
