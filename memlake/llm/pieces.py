"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies.

A text is cut into symbols of one character. An agenda holds the adjacent pairs of symbols that are pieces of the
vocabulary, best score first and the leftmost first among equals; the best pair becomes one symbol until the agenda is
empty. Runs of characters that no piece spans are merged one by one and remembered.
"""

from __future__ import annotations

import codecs
import functools
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.base import as_key

SPACE = "▁"
#: Characters of a text that are encoded at once, where a word ends.
CHUNK = 1 << 20
#: Characters of words that a worker remembers before it starts to forget.
REMEMBERED = 1 << 22
#: Symbols up to which the agenda is a plain list; of more symbols it is a heap.
FEW = 24
_NO_PIECE = 1 << 40
#: New words after which a check is due, and how many of them make one text.
FRESH = 1 << 15
JOINED = 1 << 9
CHECKS = ("words", "texts", "none")


class _Known(dict):
    """Runs and their ids as bytes; what is not known yet is found and noted as ``fresh``."""

    def __init__(self, find):
        super().__init__()
        self.find, self.fresh, self.held, self.earlier = find, [], 0, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.earlier.get(word)
        if ids is None:
            ids = self.find(word)
            self.fresh.append(word)
        self[word] = ids
        self.held += len(word)
        return ids

    def checked(self) -> None:
        """Nothing is new any more. When much is held, what was not asked for since the last time is forgotten."""
        self.fresh = []
        if self.held > REMEMBERED:
            self.earlier = dict(self)
            self.clear()
            self.held = 0


class Vocabulary:
    """Pieces, scores and text rules of a model file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = proto.SentencePiece
        odd = {kinds.USER_DEFINED, kinds.UNUSED} & {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or odd:
            raise ValueError("only merge-type models without user-defined and unused pieces are supported")
        if proto.normalizer_spec.precompiled_charsmap or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that leave characters as they are and mark blanks are supported")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that mark the end of words are not supported")
        self.library = SentencePieceProcessor(model_proto=model)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.squeeze = proto.normalizer_spec.remove_extra_whitespaces
        self.bos, self.eos, self.unknown = (self.library.bos_id(), self.library.eos_id(), self.library.unk_id())
        normal = [(p.piece, p.score, i) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        place = {score: k for k, score in enumerate(sorted({score for _, score, _ in normal}, reverse=True))}
        #: Piece to its place on the agenda, the same for equal scores, and to its id.
        self.order = {piece: place[score] for piece, score, _ in normal}
        self.pieces = {piece: i for piece, _, i in normal}
        self.bytes = [-1] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.byte_fallback = proto.trainer_spec.byte_fallback
        shown = {kinds.CONTROL: "", kinds.UNKNOWN: proto.trainer_spec.unk_surface}
        #: What each id decodes to.
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
            else shown.get(p.type, p.piece.replace(SPACE, " ")).encode()
            for p in proto.pieces
        ]
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.normal = {i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        #: Neighbours inside some piece; no piece spans any others.
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.words, self.word_end = self._cuts()
        self.known = _Known(self.word_ids)

    def _cuts(self) -> tuple[re.Pattern, re.Pattern | None]:
        """Patterns of runs that can be merged by themselves, and of places between them.

        A run is marks with letters or with other characters. Letters that stand beside other characters in some piece
        count as such, so that no piece spans two runs.
        """
        if any(b == SPACE != a for a, b in self.pairs):
            return re.compile("(?s:.+)"), None
        letter, others = re.compile(r"[^\W\d_]"), ""
        while True:
            is_letter = lambda c: bool(letter.match(c)) and c not in others  # noqa: B023, E731
            odd = {(a if is_letter(a) else b) for a, b in self.pairs if a != SPACE and is_letter(a) != is_letter(b)}
            if not odd:
                break
            others += "".join(sorted(odd))
        kept = re.escape(others)
        runs = rf"{SPACE}*[^\W\d_{kept}]+|{SPACE}*(?:(?!{SPACE})[\W\d_{kept}])+|{SPACE}+"
        return re.compile(runs), re.compile(f"(?<=[^{SPACE}])(?={SPACE})")

    def normalized(self, text: str) -> str:
        """The text with marks for blanks, one in front if the model says so."""
        if self.squeeze:
            text = re.sub(" {2,}", " ", text.lstrip(" "))
        text = text.replace(" ", SPACE)
        text = SPACE + text if text and self.prefix else text
        return text.rstrip(SPACE) if self.squeeze else text

    def merged(self, word: str) -> list[str]:
        """The symbols that are left of a run of characters."""
        symbols, n = list(word), len(word)
        get = self.order.get
        agenda = list(map(get, map(add, word, word[1:]), repeat(_NO_PIECE)))
        if n <= FEW:
            while agenda and (best := min(agenda)) < _NO_PIECE:
                left = agenda.index(best)
                joined = symbols[left] = symbols[left] + symbols.pop(left + 1)
                del agenda[left]
                if left < len(agenda):
                    agenda[left] = get(joined + symbols[left + 1], _NO_PIECE)
                if left:
                    agenda[left - 1] = get(symbols[left - 1] + joined, _NO_PIECE)
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(order, i, 2) for i, order in enumerate(agenda) if order < _NO_PIECE]
        heapify(agenda)
        while agenda:
            _, left, size = heappop(agenda)
            right = after[left]
            # A pair is void once one of its symbols has become part of another.
            if right >= n or not symbols[left] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            joined = symbols[left] + symbols[right]
            symbols[left], symbols[right] = joined, ""
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
                found = get(joined + symbols[beyond])
                if found is not None:
                    heappush(agenda, (found, left, size + len(symbols[beyond])))
            prior = before[left]
            if prior >= 0:
                found = get(symbols[prior] + joined)
                if found is not None:
                    heappush(agenda, (found, prior, size + len(symbols[prior])))
        return [s for s in symbols if s]

    def word_ids(self, word: str) -> bytes:
        """Ids of one run; a symbol without a piece becomes the pieces of its bytes, or the unknown id."""
        ids = array("i")
        for symbol in self.merged(word):
            found = self.pieces.get(symbol)
            if found is not None:
                ids.append(found)
            elif self.byte_fallback:
                ids.extend([self.bytes[b] for b in symbol.encode()])
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def _blocks(self, text: str) -> Iterator[str]:
        """A long text in parts that end where a word does."""
        at = 0
        while self.word_end and len(text) - at > CHUNK:
            cut = self.word_end.search(text, at + CHUNK)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str, bos: bool = False, eos: bool = False) -> np.ndarray:
        parts = [np.array([self.bos] if bos else [], np.int32).tobytes()]
        for block in self._blocks(self.normalized(text)):
            parts.append(b"".join(map(self.known.__getitem__, self.words.findall(block))))
        ids = self._told(np.frombuffer(b"".join(parts), np.int32))
        return np.append(ids, np.int32(self.eos)) if eos else ids

    def _told(self, ids: np.ndarray) -> np.ndarray:
        """Unknown symbols in a row are one."""
        if self.byte_fallback:
            return ids
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again]

    def _one_text(self, runs: list[str]) -> list[str]:
        """Runs that stand by themselves if they are joined: between two that would grow together another one is put."""
        letter, other = SPACE + "a", SPACE + "."
        return [x for r in runs for x in ([] if r[0] == SPACE else [letter if self.words.match(letter + r).end() == 2 else other]) + [r]]

    def check(self) -> None:
        """Have the library encode all runs that were found since the last check; raises if it differs."""
        fresh, self.known.fresh = self.known.fresh, []
        some = [r for r in fresh if r.strip(SPACE)]
        joined = [self._one_text(some[i : i + JOINED]) for i in range(0, len(some), JOINED)]
        for runs in joined + [[r] for r in fresh if not r.strip(SPACE)]:
            whole = "".join(runs)
            text = whole[1:] if self.prefix else whole
            ids = self._told(np.frombuffer(b"".join(map(self.known.__getitem__, runs)), np.int32)).tolist()
            if self.normalized(text) == whole and ids != self.library.encode(text):
                raise RuntimeError(f"the sentencepiece library has other ids for {text[:80]!r}")
        self.known.checked()

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; a byte that is part of no character becomes U+FFFD."""
        shown = list(map(self.surface.__getitem__, ids))
        if self.prefix or self.squeeze:
            # Pieces lose a mark until one has given text.
            for i, id in enumerate(ids):
                if id in self.normal:
                    marked = shown[i].startswith(b" ")
                    shown[i] = shown[i][marked:]
                    if shown[i] or marked and not self.squeeze:
                        break
                elif id not in self.control:
                    break
        raw = b"".join(shown)
        return raw.decode("utf-8", "memlake.each_byte")


# Python's own replacement takes several bytes at once.
codecs.register_error("memlake.each_byte", lambda fault: ("\ufffd", fault.start + 1))


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.int32)])))


def encode(
    docs: DataFrame, model: str, text: str = "text", name: str = "pieces", bos: bool = False, eos: bool = False,
    back: bool = False, check: str = "words",
) -> DataFrame:
    """Add ``name``: a struct of ``ids``, the ids of every whole text, and ``decoded``, their text if ``back`` asks.

    ``model`` is the path of a model file on the driver; its bytes go to the tasks. A null text counts as empty and an
    empty text has no ids but the asked ends. The ids are never the library's, but each Arrow batch is checked against
    it: all new runs (of which every text is made, since no piece spans two), all whole ``texts``, or
    ``none``; a difference fails the job. Rows, their other columns and repeated rows stay as they are; a column called
    ``name`` is replaced.
    """
    if check not in CHECKS:
        raise ValueError(f"check must be one of {CHECKS}")
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def run(texts: pa.Array) -> pa.Array:
        words = vocabulary(shared.value)
        parts, shown = [], []
        for scalar in texts:
            row = scalar.as_py() or ""
            parts.append(words.encode(row, bos, eos))
            if back:
                shown.append(words.decode(parts[-1].tolist()))
            if check == "texts" and words.library.encode(row, add_bos=bos, add_eos=eos) != parts[-1].tolist():
                raise RuntimeError(f"the sentencepiece library has other ids for {row[:80]!r}")
            if check == "words" and len(words.known.fresh) > FRESH:
                words.check()
        if check == "words":
            words.check()
        shown = pa.array(shown, pa.string()) if back else pa.nulls(len(texts), pa.string())
        return pa.StructArray.from_arrays([_lists(parts), shown], ["ids", "decoded"])

    return docs.withColumn(name, run(as_key(text)))


def decode(ids: Column, model: str) -> Column:
    """The text of an ``array<int>`` column. A null array is null, a null or unknown id is left out."""
    content = _model_bytes(model)

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        words = vocabulary(content)
        lengths = pc.list_value_length(lists).fill_null(0).to_numpy()
        texts, at = [], 0
        flat = lists.flatten().fill_null(-1).to_numpy()
        for valid, n in zip(lists.is_valid().to_pylist(), lengths.tolist()):
            ids = flat[at : at + n]
            at += n
            texts.append(words.decode(ids[(ids >= 0) & (ids < len(words.surface))].tolist()) if valid else None)
        return pa.array(texts, pa.string())

    return run(ids)


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids, joined by blanks."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
