import numpy as np
import pyarrow as pa
import pytest

from memlake.llm import tokens


def all_words(texts):
    parts = list(tokens.words_of(pa.array(texts)))
    return [np.concatenate([p.hashes for p in parts]), np.concatenate([p.tails for p in parts])]


@pytest.fixture
def one_chunk(monkeypatch):
    """The same words with chunks that hold any text of these tests."""
    def words(texts):
        with monkeypatch.context() as m:
            m.setattr(tokens, "CHUNK", 1 << 22)
            tokens._tables.cache_clear()
            found = all_words(texts)
        tokens._tables.cache_clear()
        return found

    return words


@pytest.mark.parametrize("before, size, after", [
    ("", (1 << 20) + 77, ""), ("two words ", (1 << 20) + 77, " and three more"), ("x " * 300_000, 1 << 20, "\n"),
    ("a ", 1 << 19, " b"), ("a ", (1 << 19) - 2, " b"), ("", 3 << 19, " b"), ("", 1 << 19, " " * (1 << 20) + "Z"),
])
def test_a_long_run_is_one_word(one_chunk, before, size, after):
    run = ("aGVsbG8K" * (size // 8 + 1))[:size]
    got, want = all_words([before + run + after]), one_chunk([before + run + after])
    assert len(got[0]) == len((before + run + after).split())
    assert all((g == w).all() and g.dtype == w.dtype for g, w in zip(got, want, strict=True))
