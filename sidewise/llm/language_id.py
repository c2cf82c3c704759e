"""Language identification by unigrams summed over all segmentations (operator 10).

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, computed by the forward algorithm;
a text's is the product over its words. The probabilities are fitted by expectation maximisation
on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import SPACE_CHARS, SPACE_CLASS, WORD, bounded_batches, table, task

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
#: Of each language about this many characters of labelled texts are looked at, drawn in runs of
#: ``RUN_CHARS`` by a seeded hash: the only bound, and for fitting alone.
SAMPLE_CHARS = 1_500_000
RUN_CHARS = 2048
SEED = 41
ROUNDS = 4
SMOOTHING = 0.2
LEAST_P = 1e-7
#: Places after which sums are scaled: LEAST_P to that power is far above 1e-300.
RESCALE = 16
#: Bytes of words that go through the forward algorithm together.
BLOCK_BYTES = 1 << 16
#: Words that a worker remembers.
CACHED = 200_000
#: Texts scored below this have no language that stands out.
LEAST_SCORE = 0.35
_SLOTS = 20
_K = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Pieces and their beginnings in two tables addressed by hash. ``ids`` has a piece's number,
    or -1 where bytes only begin a piece."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = len(pieces)
        nodes: dict[bytes, int] = {}
        for i, piece in enumerate(pieces):
            for n in range(1, len(piece)):
                nodes.setdefault(piece[:n], -1)
            nodes[piece] = i
        self.longest = max(map(len, pieces))
        keys = np.array([self._hash(x) for x in nodes], np.uint64)
        self.keys, self.ids = np.append(keys, np.uint64(0)), np.append(np.array(list(nodes.values()), np.int64), -2)
        self.tables: list[np.ndarray] = []
        rest = np.arange(len(keys))
        while len(rest):  # what finds its slot taken goes to a further table
            slots = self._slots(keys[rest], len(self.tables))
            one = np.full(1 << _SLOTS, len(keys), np.int32)
            one[slots] = rest
            self.tables.append(one)
            rest = rest[one[slots] != rest]

    @staticmethod
    def _hash(raw: bytes) -> int:
        h = 0
        for b in raw:
            h = (h * int(_K) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slots(h: np.ndarray, k: int) -> np.ndarray:
        mixed = (h ^ (h >> np.uint64(29 + k))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        return (mixed >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers; -1: only the beginning of one; -2: neither."""
        at = self.tables[0][self._slots(h, 0)]
        miss = np.flatnonzero(self.keys[at] != h)
        for k, table_ in enumerate(self.tables[1:], 1):
            at[miss] = table_[self._slots(h[miss], k)]
            miss = miss[self.keys[at[miss]] != h[miss]]
        out = self.ids[at]
        out[miss] = -2
        return out


def public_pieces(name: str = VOCABULARY) -> list[bytes]:
    """Pieces of a public vocabulary; a word's first piece begins with a space. Every single
    byte is a piece too, so that any text can be cut."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    found = [bytes([b]) for b in range(256)]
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ")
        if " " not in piece[1:]:
            found.append(piece.encode())
    return list(dict.fromkeys(found))


def _matrix(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of bytes that begin with a space, filled up with zeros."""
    sizes = ends - starts
    out = np.zeros((len(starts), int(sizes.max(initial=0)) + 1), np.uint8)
    out[:, 0] = 0x20
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    out[row, inside + 1] = raw[np.repeat(starts, sizes) + inside]
    return out


def _blocks(sizes: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """Words of like length whose rows take at most ``most`` bytes together, or a single longer
    one."""
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        # Sorted, so the last word of a block is its longest.
        width = sizes[order[at:]] * np.arange(1, len(order) - at + 1)
        n = max(1, int(np.searchsorted(width, most, side="right")))
        yield order[at : at + n]
        at += n


def edges(pieces: Pieces, bytes_: np.ndarray, sizes: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(to, rows, piece numbers): where pieces that begin at place ``i`` end."""
    rows = np.flatnonzero(sizes > i)
    h = np.zeros(len(rows), np.uint64)
    for j in range(i + 1, min(bytes_.shape[1], i + pieces.longest) + 1):
        fit = sizes[rows] >= j
        if not fit.all():
            rows, h = rows[fit], h[fit]
        if not len(rows):
            break
        h = h * _K + bytes_[rows, j - 1].astype(np.uint64) + np.uint64(1)
        found = pieces.find(h)
        whole = found >= 0
        if whole.any():
            yield j, rows[whole], found[whole]
        alive = found > -2
        rows, h = rows[alive], h[alive]


def log_words(pieces: Pieces, p: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language (columns of ``p``), by the forward
    algorithm over the whole word. Only the places that a piece can still reach are held, and
    they are scaled as it goes on, so a word may be of any length."""
    out = np.zeros((len(starts), p.shape[1]))
    for some in _blocks(ends - starts):
        rows, sizes = _matrix(raw, starts[some], ends[some]), ends[some] - starts[some] + 1
        span = min(rows.shape[1], pieces.longest) + 1
        alpha, scale = np.zeros((span, len(some), p.shape[1])), np.zeros((len(some), p.shape[1]))
        alpha[0] = 1
        for i in range(rows.shape[1] + 1):
            now = alpha[i % span]
            done = np.flatnonzero(sizes == i)
            if len(done):
                out[some[done]] = np.log(np.maximum(now[done], 1e-300)) + scale[done]
            if i and i % RESCALE == 0:
                top = alpha.max(axis=0)
                top[top == 0] = 1  # words that have ended
                alpha /= top
                scale += np.log(top)
            for j, which, found in edges(pieces, rows, sizes, i):
                alpha[j % span, which] += now[which] * p[found]
            now[:] = 0
    return out


def _expected(pieces: Pieces, p: np.ndarray, rows: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words: forward and backward, each scaled."""
    width, n, out = rows.shape[1], len(rows), np.zeros(pieces.size)
    steps = [list(edges(pieces, rows, sizes, i)) for i in range(width)]
    forward, backward = np.zeros((width + 1, n)), np.zeros((width + 1, n))
    a, b = np.zeros((width + 1, n)), np.zeros((width + 1, n))  # logs of the scales
    forward[0] = 1
    backward[sizes, np.arange(n)] = 1

    def rescale(values: np.ndarray, ahead: slice, logs: np.ndarray, rest: slice) -> None:
        top = values[ahead].max(axis=0)
        top[top == 0] = 1
        values[ahead] /= top
        logs[rest] += np.log(top)

    for i in range(width):
        if i and i % RESCALE == 0:
            rescale(forward, slice(i, i + pieces.longest + 1), a, slice(i, None))
        for j, which, found in steps[i]:
            forward[j, which] += forward[i, which] * p[found]
    for i in range(width - 1, -1, -1):
        for j, which, found in steps[i]:
            backward[i, which] += backward[j, which] * p[found]
        if i and i % RESCALE == 0:
            # Words that end further on have nothing here yet.
            rescale(backward, slice(max(0, i - pieces.longest), i + pieces.longest + 1), b, slice(0, i + pieces.longest + 1))
    last = np.arange(n)
    total = np.log(np.maximum(forward[sizes, last], 1e-300)) + a[sizes, last]
    for i in range(width):
        for j, which, found in steps[i]:
            logs = a[i, which] + b[j, which] - total[which]
            with np.errstate(divide="ignore"):
                logs += np.log(forward[i, which]) + np.log(p[found]) + np.log(backward[j, which])
            out += np.bincount(found, weight[which] * np.exp(logs), pieces.size)
    return out


def fit(pieces: Pieces, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over its words."""
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    weight = np.asarray(counts, float)
    p = np.full(pieces.size, 1 / pieces.size)
    for _ in range(rounds):
        expected = np.zeros(pieces.size)
        for some in _blocks(ends - starts):
            rows, sizes = _matrix(raw, starts[some], ends[some]), ends[some] - starts[some] + 1
            expected += _expected(pieces, p, rows, sizes, weight[some])
        p = expected + SMOOTHING
        p = np.maximum(p / p.sum(), LEAST_P)
    return p


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


class Model:
    def __init__(self, languages: list[str], p: np.ndarray, prior: np.ndarray, pieces: list[bytes]) -> None:
        self.languages, self.p, self.prior, self.pieces = languages, p, prior, pieces


def _run(at: Column) -> Column:
    """Run number ``at`` of a text, with a space after the text's end."""
    run = F.substring(F.col("text"), at * RUN_CHARS + 1, F.lit(RUN_CHARS))
    return F.when(F.char_length(run) < RUN_CHARS, F.concat(run, F.lit(" "))).otherwise(run)


def sample(usable: DataFrame, chars: dict[str, int]) -> DataFrame:
    """``lang, part``: of each language's texts (columns ``id, text, lang``, ``chars`` in all)
    about SAMPLE_CHARS characters, or all. Texts are drawn by runs, so it doesn't matter how long
    they are. A word that begins in one run and ends in the next goes with the one it begins in;
    only a word without end in the next run is cut."""
    share = {k: min(1.0, SAMPLE_CHARS / max(1, n)) for k, n in chars.items()}
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    seeded = usable.select("lang", "text", F.xxhash64(F.lit(SEED), "id", "text").alias("seed"), limit.alias("limit"))

    def drawn(k: Column) -> Column:
        return F.pmod(F.xxhash64(F.col("seed"), k), F.lit(1 << 30)) / float(1 << 30) < F.col("limit")

    runs = F.sequence(F.lit(0), F.floor(F.char_length("text") / RUN_CHARS).cast("int"))
    found = seeded.select("lang", "text", F.explode(F.filter(runs, drawn)).alias("at"))
    head = rf"^{WORD}(?=[{SPACE_CLASS}])"
    own = F.when(F.col("at") > 0, F.regexp_replace(_run(F.col("at")), head, "")).otherwise(_run(F.col("at")))
    return found.select("lang", F.concat(own, F.regexp_extract(_run(F.col("at") + 1), head, 0)).alias("part"))


def _words(parts: DataFrame) -> pd.DataFrame:
    words = parts.select("lang", F.explode(F.regexp_extract_all("part", F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("n")).orderBy("lang", "word").toPandas()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on rows that aren't held out and have a language and a text; rows with a null id are
    not learned from. A language's sample is drawn by id, text and place; its share of all such
    rows is its prior. Every language with a word is learned."""
    names = {"id": F.col(id_col), "text": F.col(text_col), "lang": F.col(lang_col)}
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(*[c.alias(n) for n, c in names.items()])
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).orderBy("lang").collect()
    pieces = public_pieces()
    if not sizes:
        return Model([], np.zeros((len(pieces), 0)), np.zeros(0), pieces)
    words = _words(sample(usable, {r["lang"]: r["chars"] for r in sizes}))
    missed = [r["lang"] for r in sizes if r["lang"] not in set(words["lang"])]
    if missed:
        # Many copies of one row are drawn alike, mostly white space can hide words: one text each.
        first = usable.where(F.col("lang").isin(missed) & F.col("text").rlike(WORD))
        begun = F.left(F.ltrim("text", F.lit(SPACE_CHARS)), F.lit(SAMPLE_CHARS))
        first = first.groupBy("lang").agg(F.min(F.struct(F.xxhash64(F.lit(SEED), "id", "text"), begun.alias("part"))).alias("m"))
        words = pd.concat([words, _words(first.select("lang", "m.part"))])
    table_, found = Pieces(pieces), {k: g for k, g in words.groupby("lang")}
    languages = [r["lang"] for r in sizes if r["lang"] in found]
    p = np.stack([fit(table_, found[x]["word"].tolist(), found[x]["n"].to_numpy()) for x in languages], axis=1) if languages else np.zeros((len(pieces), 0))
    n = np.array([r["n"] for r in sizes if r["lang"] in found], float)
    return Model(languages, p, np.log(n / n.sum()) if len(n) else n, pieces)


class Scorer:
    """Scores texts in a worker; remembers words."""

    def __init__(self, model: Model) -> None:
        self.model, self.pieces = model, Pieces(model.pieces)
        self.known: dict[int, int] = {}
        self.values = np.zeros((0, len(model.languages)))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text under each language, and its number of words."""
        raw, offsets = hashing.buffers(texts)
        out, n = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        for a, b in hashing.chunks(offsets):
            part = raw[offsets[a] : offsets[b]]
            starts, ends, counts = hashing.word_bounds(part, offsets[a : b + 1] - offsets[a])
            h, first, inverse = np.unique(hashing.hash_words(part, starts, ends), return_index=True, return_inverse=True)
            if len(self.known) + len(h) > CACHED:
                self.known, self.values = {}, self.values[:0]
            at = np.array([self.known.get(x, -1) for x in h.tolist()], np.int64)
            new = np.flatnonzero(at < 0)
            if len(new):
                at[new] = len(self.values) + np.arange(len(new))
                self.known.update(zip(h[new].tolist(), at[new].tolist(), strict=True))
                self.values = np.concatenate([self.values, log_words(self.pieces, self.model.p, part, starts[first[new]], ends[first[new]])])
            sums = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(self.values[at[inverse]], axis=0)])
            out[a:b] = sums[counts[1:]] - sums[counts[:-1]]
            n[a:b] = np.diff(counts)
        return out, n


def _letters(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def _best(scorer: Scorer, texts: pa.Array, letters: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's language, its number (-1: unknown) and its score."""
    languages, told = scorer.model.languages, letters.to_numpy(zero_copy_only=False).astype(bool)
    if not languages:
        return [UNKNOWN] * len(texts), np.full(len(texts), -1), np.zeros(len(texts))
    logs, n = scorer.score(texts)
    logs = (logs + scorer.model.prior) / np.sqrt(np.maximum(n, 1))[:, None]
    best, share = logs.argmax(axis=1), 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    best = np.where(told, best, -1)
    return [languages[i] if i >= 0 else UNKNOWN for i in best.tolist()], best, np.where(told, share, 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, lang_pred, score``. The score is the best language's share when log
    probabilities are divided by the root of the number of words. A null text, one without a
    letter, and any text if no language was learned: ``und`` with score 0. Very long texts are
    scored whole. Ties go to the language that comes first. Repeated rows and null ids are kept,
    other columns ignored, whatever their names; an empty table gives an empty one."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                names, _, share = _best(scorer, some.column("text"), some.column("letters"))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(names, pa.string()), pa.array(share)],
                    names=["doc_id", "lang_pred", "score"],
                )

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _letters(text_col).alias("letters")
    )
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is told with a score of at least ``least``, all columns
    unchanged. Null texts and texts without a letter go."""
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                _, best, share = _best(scorer, some.column(at), some.column(batch.num_columns - 1))
                kept = some.filter(pa.array((share >= least) & (best >= 0)))
                yield kept.select(range(batch.num_columns - 1))

    # By position, so that a clashing name does no harm; rows without a letter are marked last.
    marked = docs.withColumn("__letters", _letters(text_col))
    return marked.mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
