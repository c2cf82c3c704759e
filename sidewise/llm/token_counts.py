"""Greedy word-piece lengths by a linear longest-match automaton (operator 2).

A trie of the vocabulary has failure links: where no piece goes on, the link leads to the node
from which matching continues, and the number of pieces that are thereby complete is known
beforehand. So a word is read once, left to right, and only counts are kept, never pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, task
from .encoding import MEMO_BYTES, Memo, slices

VOCABULARY = "piece_bpe_32k.model"
START = "▁"


def public_vocabulary(name: str = VOCABULARY) -> list[str]:
    """Pieces of a public vocabulary; those that can begin a word begin with ``START``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    n = model.get_piece_size()
    return [model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Automaton:
    """``count(word)``: pieces of ``START + word`` by greedy longest match; 1 (unknown) for a
    word that can't be covered; 0 for an empty word."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        whole = {0: False}
        for piece in vocabulary:
            node = 0
            for c in piece:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    whole[nxt] = False
                    self.children[node][c] = nxt
                node = nxt
            whole[node] = node != 0
        self.fail, self.popped = [-1] * len(self.children), [0] * len(self.children)
        level = [(0, c, v) for c, v in self.children[0].items()]
        while level:
            for parent, c, node in level:
                if whole[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, n = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.children[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.children[at][c], n
            level = [(v, c, w) for _, _, v in level for c, w in self.children[v].items()]

    def count(self, word: str) -> int:
        if not word:
            return 0
        children, fail, popped, node, n = self.children, self.fail, self.popped, 0, 0
        for c in START + word:
            nxt = children[node].get(c)
            while nxt is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = children[node].get(c)
            node = nxt
        while node > 0:
            n += popped[node]
            node = fail[node]
        return n if node == 0 else 1


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row ``doc_id, n_words, n_tokens``: maximal runs of non-space characters and their
    word pieces. Null and empty texts have none; very long ones are counted whole. Repeated rows
    and null ids are kept, other columns ignored, whatever their names; an empty table gives an
    empty one. A task counts each distinct word of a slice of texts once and remembers words
    within ``MEMO_BYTES``."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(public_vocabulary(vocabulary))
        memo = Memo(MEMO_BYTES)
        learn = lambda words: list(map(automaton.count, words))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                some = texts.slice(a, b - a).fill_null("").cast(pa.large_string())
                lists = pc.ascii_split_whitespace(some)
                words = lists.flatten().dictionary_encode()
                counts = np.array(memo.values_of(words.dictionary.to_pylist(), learn), np.int64)
                code = words.indices.to_numpy()
                real = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False).astype(np.int64)
                first = lists.offsets.to_numpy()
                sums = [np.concatenate([[0], np.cumsum(x[code])])[first - first[0]] for x in (real, counts)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), *[pa.array(np.diff(x).astype(np.int64)) for x in sums]], names=["doc_id", "n_words", "n_tokens"]
                )

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_sql(vocabulary: str = VOCABULARY) -> str:
    """Greedy longest match over the same vocabulary, step by step for each distinct word."""
    pieces = public_vocabulary(vocabulary)
    listed = ", ".join("'" + p.replace("'", "''") + "'" for p in pieces)
    return (
        rf"""
WITH RECURSIVE vocabulary AS (SELECT unnest([{listed}]) AS piece),
words AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word FROM documents),
steps AS (
  SELECT word, '{START}' || word AS rest, 0 AS n FROM (SELECT DISTINCT word FROM words) WHERE word <> ''
  UNION ALL
  SELECT word, substr(rest, best + 1), n + 1 FROM (
    SELECT word, rest, n, max(k) AS best
    FROM (SELECT word, rest, n, unnest(range(1, least(len(rest), {max(map(len, pieces))}) + 1)) AS k FROM steps WHERE rest <> '')
    JOIN vocabulary ON piece = substr(rest, 1, k) GROUP BY word, rest, n)
), counted AS (SELECT word, max(n) FILTER (WHERE rest = '') AS n FROM steps GROUP BY word),
sums AS (SELECT doc_id, count(*) AS n_words, CAST(sum(coalesce(n, 1)) AS BIGINT) AS n_tokens FROM words JOIN counted USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_tokens, 0) AS n_tokens FROM documents LEFT JOIN sums USING (doc_id)
"""
    )
