"""Glosses out of large dictionaries: a trie over words, walked once along every text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions.text import fold_print, squeeze

# Phrases that may be sent to every task.
MOST_PHRASES = 2_000_000
WORD, END = frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), ""


class PhraseTrie:
    """Phrases cut as texts are: runs of letters and digits, and every other character by itself."""

    def __init__(self, terms: Mapping[str, str]):
        self.token = re.compile("[a-z0-9]+|[^a-z0-9]", re.DOTALL)
        self.root: dict = {}
        for phrase, told in terms.items():
            node = self.root
            for token in self.token.findall(phrase):
                node = node.setdefault(token, {})
            if node is not self.root:
                node[END] = told

    def replace(self, text: str) -> str:
        """The text with the longest phrase at each place replaced; no letter or digit may touch a phrase of several tokens."""
        tokens = self.token.findall(text)
        nodes = list(map(self.root.get, tokens))
        out, at, n = None, 0, len(tokens)
        # Only a token that begins a phrase can change; all others stay where they are.
        for start, node in enumerate(nodes):
            if node is None or start < at:
                continue
            # A mark by itself is a phrase wherever it stands.
            end, told = start + 1, node.get(END, tokens[start])
            if not (start and tokens[start - 1][0] in WORD):
                k = start + 1
                while node is not None:
                    if END in node and not (k < n and tokens[k][0] in WORD):
                        end, told = k, node[END]
                    node = node.get(tokens[k]) if k < n else None
                    k += 1
            if out is None:
                out = []
            out += tokens[at:start]
            out.append(told)
            at = end
        return text if out is None else "".join(out + tokens[at:])


def gloss_texts(texts: DataFrame, column: str, terms: Mapping[str, str] | DataFrame, rules: Sequence[tuple[str, str]] = (), name: str = "gloss") -> DataFrame:
    """``texts`` with ``name``: what :func:`partlens.functions.text.gloss` gives, for a dictionary of any size up to MOST_PHRASES.

    ``terms`` is a dictionary of folded phrases or a table (phrase, told); its size is
    checked before it is sent to the tasks.  Of a phrase that stands twice in the table
    the smallest translation counts.
    """
    if isinstance(terms, DataFrame):
        rows = terms.groupBy("phrase").agg(F.min("told").alias("told"))
        if rows.limit(MOST_PHRASES + 1).count() > MOST_PHRASES:
            raise ValueError(f"more than {MOST_PHRASES} phrases do not fit a task; cut the dictionary")
        terms = {r.phrase: r.told for r in rows.collect()}
    elif len(terms) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases do not fit a task; cut the dictionary")
    trie = texts.sparkSession.sparkContext.broadcast(PhraseTrie(terms))
    staged: Column = F.col("_start")
    for pattern, replacement in rules:
        staged = F.regexp_replace(staged, pattern, replacement)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trie.value
        for batch in batches:
            made = [None if t is None else known.replace(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=batch.schema.names)

    rows = texts.withColumn("_start", fold_print(F.col(column))).withColumn("_staged", staged)
    walked = rows.mapInArrow(run, rows.schema).withColumn("_staged", squeeze(F.col("_staged")))
    changed = (F.col("_start") != "") & (F.col("_staged") != F.col("_start"))
    return walked.withColumn(name, F.when(changed, F.col("_staged"))).drop("_start", "_staged")
