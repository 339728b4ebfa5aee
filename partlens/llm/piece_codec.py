"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protocol buffer; from its pieces, scores and
specifications the normaliser, the space mark, the merges (or unigram scores) and
the byte fallback are rebuilt as a pipeline of the tokenizers library, which
encodes each distinct word.  The tokens are held against sentencepiece's
own, and the decoded tokens against the text.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.llm.token_counts import MARK, REMEMBERED, _bounded, safe_parts, words_of

#: Fixed values of the file format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
#: Words that are encoded at a time; the libraries' answers take far more memory than the tokens that are kept.
WORDS_AT_ONCE = 16_384


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message: whole numbers, or bytes for all else."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"a field of kind {kind} at byte {at}")
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def read(cls, path: str) -> PieceModel:
        made = cls()
        with open(path, "rb") as file:
            data = file.read()
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                made.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trained = dict(fields(value))
                made.kind, made.byte_fallback = trained.get(3, UNIGRAM), bool(trained.get(35, 0))
            elif number == 3:
                normal = dict(fields(value))
                made.charsmap = normal.get(2, b"")
                made.dummy_prefix, made.squeeze, made.escape = (bool(normal.get(n, 1)) for n in (3, 4, 5))
        return made


def rebuild(model: PieceModel):
    """The model as a pipeline of the tokenizers library."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    ids = {text: i for i, (text, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(text, score) for text, score, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        plain = {text: score for text, score, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = [
            (-score, ids[text[:cut]], ids[text[cut:]], text[:cut], text[cut:])
            for text, score in plain.items() for cut in range(1, len(text)) if text[:cut] in plain and text[cut:] in plain
        ]
        core = models.BPE(
            ids, [m[3:] for m in sorted(merges)], unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback
        )
    else:
        raise ValueError(f"models of kind {model.kind} are not read")
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    made.normalizer = normalizers.Sequence(steps)
    made.decoder = decoder_of(model.dummy_prefix)
    return made


def decoder_of(dummy_prefix: bool):
    """The way back from tokens to text; ``dummy_prefix``: the space that encoding puts in front is taken off."""
    from tokenizers import decoders

    return decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if dummy_prefix else [])])


class Codec:
    """The rebuilt pipeline and sentencepiece's own, with the parts of texts met so far.

    A text is cut where no piece runs across.  Each distinct word is encoded once
    by the rebuilt model, encoded by sentencepiece and decoded; tokens of a text are those of its words in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(THREADS)
        import sentencepiece

        self.model = PieceModel.read(path)
        self.bare = rebuild(self.model)
        self.bare.normalizer = None
        self.bare.decoder = decoder_of(False)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.plain = not self.model.charsmap and not self.model.squeeze
        self.part, lone = safe_parts([text for text, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED)])
        self.front = "\n" if "\n" in lone else ""
        self.quick = self.plain and self.model.dummy_prefix and bool(self.front) and self.part.match(f"a{MARK}").end() == 1
        #: The tokens of a word, as 32-bit numbers in a row.
        self.words: dict[str, array] = {}
        self.old: dict[str, array] = {}
        #: The words and parts on which the libraries differ, and those that decoding does not give back.
        self.differ: set[str] = set()
        self.lossy: set[str] = set()

    @cached_property
    def whole(self):
        """The rebuilt pipeline for whole texts, made when it is first asked for: a plain model's words do without."""
        return rebuild(self.model)

    def cut(self, text: str) -> list[str]:
        """A text as words, or else as marked parts that are told from words by a space in front."""
        if not text:
            return []
        words = words_of(text) if self.quick else None
        if words is not None:
            return words
        marked = text.replace(" ", MARK) if self.plain else self.whole.normalizer.normalize_str(text)
        return [" " + p for p in self.part.findall(MARK + marked if self.plain and self.model.dummy_prefix else marked)]

    def learn(self, words: set[str]) -> None:
        """Encodes, compares and decodes the words not met before."""
        new = list(words.difference(self.words))
        if len(self.words) + len(new) > REMEMBERED:
            # Words met since the last time are kept for one more round; those met again move on.
            self.old, self.words = self.words, {}
            self.differ &= self.old.keys()
            self.lossy &= self.old.keys()
            new = list(words)
        again = self.old.keys() & new
        if again:
            self.words.update((w, self.old[w]) for w in again)
            new = [w for w in new if w not in again]
        for at in range(0, len(new), WORDS_AT_ONCE):
            self._learn(new[at : at + WORDS_AT_ONCE])

    def _learn(self, new: list[str]) -> None:
        parts = [[w[1:]] if w[:1] == " " else self.part.findall(w if w[:1] == "\n" else MARK + w) for w in new]
        flat = list(chain.from_iterable(parts))
        # Parts go past the normaliser, so the model alone gives their tokens.
        tokenize = self.bare.model.tokenize
        tokens = [[t.id for t in tokenize(p)] for p in flat]
        back = self.bare.decode_batch(tokens, skip_special_tokens=False)
        own = self._library(flat)
        at = 0
        for word, made in zip(new, parts, strict=True):
            to = at + len(made)
            self.words[word] = array("i", own[at] if to == at + 1 else chain.from_iterable(own[at:to]))
            at = to
        if tokens == own and back == [p.replace(MARK, " ") for p in flat]:
            return
        at = 0
        for word, made in zip(new, parts, strict=True):
            to = at + len(made)
            if tokens[at:to] != own[at:to]:
                self.differ.add(word)
            if "".join(back[at:to]) != "".join(made).replace(MARK, " "):
                self.lossy.add(word)
            at = to

    def _library(self, parts: list[str]) -> list[list[int]]:
        """Sentencepiece's tokens of parts: the mark it puts in front stands for a part's own, or is cut off again."""
        if not self.model.dummy_prefix:
            return self.library.encode(parts, num_threads=THREADS)
        marked = [p[0] == MARK and len(p) > 1 for p in parts]
        made = self.library.encode([p[1:] if m else self.front + p for p, m in zip(parts, marked, strict=True)], num_threads=THREADS)
        skip = len(self.library.encode(self.front)) if self.front else 1
        return [tokens if m else tokens[skip:] for tokens, m in zip(made, marked, strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(tokens: list[bytes | None]) -> pa.Array:
    """Lists of 32-bit numbers out of their bytes; none for none."""
    ends = np.cumsum([0, *(len(t or b"") // 4 for t in tokens)])
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(t or b"" for t in tokens))])
    none = np.array([t is None for t in tokens], bool)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(none) if none.any() else None)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_tokens``, ``tokens``, ``parity`` and ``round_trip`` of every row of ``docs``, over whole texts.

    ``parity``: both libraries gave the same tokens; where they differ the tokens
    are sentencepiece's.  ``round_trip``: the decoded tokens are the text.  A null
    text has null tokens, no count and null marks; an empty one no tokens.  Repeated
    rows are encoded each; an empty table gives an empty result; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = codec(model)
        for batch in batches:
            for rows in _bounded(batch):
                tokens, sizes, parity, exact = [], [], [], []
                texts = rows.column(1).to_pylist()
                cut = [tools.cut(t) if t else [] for t in texts]
                tools.learn(set().union(*cut))
                known = tools.words.__getitem__
                for text, words in zip(texts, cut, strict=True):
                    ids = b"".join(map(known, words))
                    same = tools.differ.isdisjoint(words) if tools.differ else True
                    if tools.plain:
                        back = (tools.lossy.isdisjoint(words) if tools.lossy else True) and MARK not in (text or "")
                    else:
                        back = tools.whole.decode(list(memoryview(ids).cast("i")), skip_special_tokens=False) == text
                    none = text is None
                    tokens.append(None if none else ids)
                    sizes.append(None if none else len(ids) // 4)
                    parity.append(None if none else same)
                    exact.append(None if none else back)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(sizes, pa.int64()), _lists(tokens), pa.array(parity, pa.bool_()), pa.array(exact, pa.bool_())],
                    names=["id", "n_tokens", "tokens", "parity", "round_trip"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, tokens array<int>, parity boolean, round_trip boolean")


def decode(tokens: DataFrame, model: str, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """``id`` and ``text`` of every row of ``tokens``; null tokens give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = codec(model).whole
        for batch in batches:
            rows = batch.column(1).to_pylist()
            texts = fast.decode_batch([r or [] for r in rows], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if r is None else t for r, t in zip(rows, texts, strict=True)], pa.string())], names=["id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("id"), F.col(tokens_col).cast("array<int>").alias("tokens")).mapInArrow(run, "id long, text string")
