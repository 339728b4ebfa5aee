"""The terms of a corpus: one Arrow pass over the texts counts them by chunk."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partlens.functions.text import ACCENTED, PLAIN

# Function words that carry no search meaning, and words that only look like plurals.
STOPWORDS = [
    "the", "and", "for", "with", "from", "that", "this", "are", "was", "its", "into", "onto", "not", "but", "all", "any",
    "can", "has", "have", "been", "will", "also", "such", "than", "then", "there", "they", "these", "those",
    "de", "del", "la", "el", "los", "las", "un", "una", "unos", "unas", "en", "con", "para", "por", "que", "se", "su",
    "sus", "al", "es", "son", "lo", "como", "pero", "mas", "este", "esta", "estos", "estas",
]
IES_WORDS = ["series", "species"]
# Bytes of text that a task counts together, and rows that it hands on at a time.
BYTES_AT_ONCE, ROWS_AT_ONCE = 2_000_000, 50_000
# What a byte of a folded text is; every other one is 0.
LETTER, DIGIT, SPACE, BREAK = 1, 2, 3, 4


class TermReader:
    """Tokens and terms of whole texts, as ``retrieval.tokenize`` and ``retrieval.term`` give them column by column.

    Many texts are read at once, as bytes with the case and the marks taken off: runs of
    letters and digits are tokens, all runs between two white spaces (those of a Java
    pattern's ``\\s``) joined are one more, and so are one to three letters with the number
    that is the next run, after a white space.  With ``asked`` only those terms are
    counted, numbered by their places in it.
    """

    def __init__(self, stopwords: list[str] | None = None, asked: Sequence[str] | None = None) -> None:
        self.plain = dict(zip(ACCENTED, PLAIN)) | dict.fromkeys(map(chr, range(0x300, 0x370)), "")
        self.stopwords = pa.array(STOPWORDS if stopwords is None else stopwords, pa.string())
        self.asked = None if asked is None else pa.array(asked, pa.string())
        self.kinds = np.zeros(256, np.uint8)
        for kind, signs in ((LETTER, b"abcdefghijklmnopqrstuvwxyz"), (DIGIT, b"0123456789"), (SPACE, b" \t\n\x0b\x0c\r"), (BREAK, b"\0")):
            self.kinds[list(signs)] = kind

    def terms(self, tokens: pa.Array) -> pa.Array:
        """The index terms of tokens; NULL for one letter and for stopwords; codes with digits stay as they are."""
        size, cut = pc.binary_length(tokens), lambda n: pc.utf8_slice_codeunits(tokens, 0, -n)
        ends = lambda suffix, n: pc.and_(pc.ends_with(tokens, suffix), pc.greater_equal(size, n))
        in_list = lambda words: pc.is_in(tokens, value_set=words)
        rules = [
            (pc.less(size, 2), pa.nulls(len(tokens), pa.string())),
            (pc.match_substring_regex(tokens, "[0-9]"), tokens),
            (in_list(self.stopwords), pa.nulls(len(tokens), pa.string())),
            (in_list(pa.array(IES_WORDS, pa.string())), tokens),
            (ends("ies", 5), pc.binary_join_element_wise(cut(3), "y", "")),
            (ends("ing", 6), cut(3)),
            (pc.and_not(ends("ed", 5), pc.ends_with(tokens, "eed")), cut(2)),
            (pc.and_not(ends("s", 4), pc.match_substring_regex(tokens, "(?:ss|us|is)$")), cut(1)),
        ]
        out = tokens
        for holds, told in reversed(rules):
            out = pc.if_else(holds, told, out)
        return out

    def _folded(self, texts: list[str]) -> np.ndarray:
        """The bytes of all texts in lower case and without marks, a zero byte between two of them."""
        joined = "\0".join([t.replace("\0", "\1") if "\0" in t else t for t in texts])
        if not joined.isascii():
            for letter in set(joined):
                if letter in self.plain:
                    joined = joined.replace(letter, self.plain[letter])
        return np.frombuffer(joined.lower().encode(), np.uint8)

    def count_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(text, term, count) of every term of every text, sorted by text, each text's number of different tokens, and the terms by number."""
        data, n = self._folded([t or "" for t in texts.to_pylist()]), len(texts)
        kind = self.kinds[data]
        held = np.concatenate([[False], (kind == LETTER) | (kind == DIGIT), [False]])
        edges = np.flatnonzero(held[1:] != held[:-1])
        starts, ends = edges[::2], edges[1::2]
        text = np.searchsorted(np.flatnonzero(kind == BREAK), starts)
        word = np.searchsorted(np.flatnonzero(kind >= SPACE), starts)
        # Places among the letters and digits alone, where runs that follow one another are joined already.
        signs = data[held[1:-1]]
        places = np.concatenate([[0], np.cumsum(ends - starts)])
        firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if word.size else np.zeros(0, np.int64)
        lasts = np.append(firsts[1:], word.size)
        several = np.flatnonzero(lasts - firsts > 1)
        digits = np.concatenate([[0], np.cumsum(kind == DIGIT)])
        short = (ends - starts <= 3) & (digits[ends] == digits[starts])
        glued = np.flatnonzero(short[:-1] & (kind[starts[1:]] == DIGIT) & (word[1:] != word[:-1]) & (text[1:] == text[:-1]))
        begin = np.concatenate([firsts[several], glued])
        end = np.concatenate([lasts[several], glued + 2])
        raw = signs.tobytes()
        more = pa.array([raw[a:b].decode() for a, b in zip(places[begin].tolist(), places[end].tolist())], pa.string())
        runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw))
        coded = pa.concat_arrays([runs, more]).dictionary_encode()
        owner, token = np.concatenate([text, text[begin]]), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner, token, counts = _summed(owner, token, max(len(coded.dictionary), 1))
        lengths = np.bincount(owner, minlength=n)
        terms = self.terms(coded.dictionary)
        if self.asked is None:
            named = terms.dictionary_encode()
            number, names = named.indices, named.dictionary
        else:
            number, names = pc.index_in(terms, value_set=self.asked, skip_nulls=True), self.asked
        number = pc.fill_null(number, -1).to_numpy(zero_copy_only=False).astype(np.int64)[token]
        stated = np.flatnonzero(number >= 0)
        owner, number, counts = _summed(owner[stated], number[stated], max(len(names), 1), counts[stated])
        return owner, number, counts, lengths, names

    def count(self, text: str) -> tuple[Counter[str], int]:
        """How often each term of one text occurs, and its number of different tokens."""
        _, terms, counts, lengths, names = self.count_all(pa.array([text], pa.string()))
        return Counter(dict(zip(names.take(pa.array(terms)).to_pylist(), counts.tolist()))), int(lengths[0])


def _listed(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the lists numbered ``at``, out of ``flat`` where list i has ``sizes[i]`` entries, each with its place in ``at``."""
    own = sizes[at]
    starts = (np.cumsum(sizes) - sizes)[at]
    owner = np.repeat(np.arange(at.size), own)
    return flat[np.arange(owner.size) + np.repeat(starts - (np.cumsum(own) - own), own)], owner


def _summed(a: np.ndarray, b: np.ndarray, width: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs (a, b), ``b`` below ``width``, sorted, with how many there are or the sums of their counts."""
    key = a * width + b
    if counts is None:
        key.sort()
    else:
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order]
    firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, np.int64)
    summed = np.diff(np.append(firsts, key.size)) if counts is None or not key.size else np.add.reduceat(counts, firsts)
    return key[firsts] // width, key[firsts] % width, summed


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of a batch, cut where some BYTES_AT_ONCE of text have come together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // BYTES_AT_ONCE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)


def index_rows(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, length): a row for each term of a chunk, and one with a NULL term for the chunk itself.

    ``length`` is the chunk's number of different tokens.  Ids name chunks, so nothing
    is shuffled here.  A NULL text has no terms and length 0.
    """
    kind = dict(chunks.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader()
        for batch in batches:
            for ids, texts in _slices(batch):
                at, terms, counts, lengths, names = reader.count_all(texts)
                names = names.take(pa.array(terms))
                none = pa.nulls(len(ids), pa.string())
                made = pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([names, none]), pa.concat_arrays([ids.take(pa.array(at)), ids]),
                     pa.array(np.concatenate([counts, np.zeros(len(ids), np.int64)]), pa.int32()), pa.array(np.concatenate([lengths[at], lengths]), pa.int32())],
                    names=["term", "id", "tf", "length"],
                )
                for start in range(0, made.num_rows, ROWS_AT_ONCE):
                    yield made.slice(start, ROWS_AT_ONCE)

    return chunks.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"term string, id {kind}, tf int, length int"
    )


def asked_terms(chunks: DataFrame, asked: Sequence[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, length, terms, tfs): a row for each chunk, with the places in ``asked`` of the terms that it holds and how often it does."""
    kind = dict(chunks.select(F.col(id_col).alias("id")).dtypes)["id"]
    sent = chunks.sparkSession.sparkContext.broadcast(list(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader(asked=sent.value)
        for batch in batches:
            for ids, texts in _slices(batch):
                at, terms, counts, lengths, _ = reader.count_all(texts)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(ids)))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (terms, counts)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int32()), *lists], names=["id", "length", "terms", "tfs"])

    return chunks.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, length int, terms array<int>, tfs array<int>"
    )


def corpus_stats(rows: DataFrame) -> DataFrame:
    """One row: how many chunks there are and how long they are on average."""
    return rows.filter("term is null").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
