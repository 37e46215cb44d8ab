"""Language-model scores of documents: a subword lattice over an existing vocabulary, and a word-frequency base."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import crc_rest, guarded, materialize, read_table, small_batches, text_or_empty
from quernstone.llm.lattice import Pieces, expected_pieces, from_sentencepiece, word_logp

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: So many of the commonest words are broadcast (a few MB at any size of the corpus); the others are joined.
HEAD = 65_536
#: A task hands on its word counts once it holds so many words.
FLUSH = 300_000


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    train: Counter = Counter()

    def rows() -> pa.RecordBatch:
        words = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([train[w] for w in words], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["word", "c", "n"])

    for batch in batches:
        for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
            words = tokens(text)
            seen.update(words)
            if not held:
                train.update(words)
            if len(seen) > FLUSH:
                yield rows()
                seen.clear()
                train.clear()
    if seen:
        yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (in documents that aren't held out), n (in all); docs: text, held_out."""
    return docs.mapInArrow(_count, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


#: Words that the lattice takes at once; fewer cost more in calls than in sums.
TOGETHER = 50_000


def gathered(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many or a little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _uses(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pieces.pieces))
        for batch in gathered(batches):
            words = [w.encode() for w in batch.column("word").to_pylist()]
            total += expected_pieces(words, batch.column("c").to_numpy().astype(float), pieces)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["piece", "uses"])

    return run


def learn_pieces(counts: DataFrame, pieces: Pieces) -> Pieces:
    """One round of expectation maximisation from the vocabulary's scores; one sum for each piece comes to the driver."""
    rows = counts.where("c > 0").select("word", "c").mapInArrow(_uses(pieces), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
    uses = np.exp(pieces.logp) * 100.0  # the scores count as a hundred uses
    for r in sorted(rows):
        uses[r.piece] += r.uses
    return pieces.with_logp(np.log(uses / uses.sum()))


class Model:
    """Sums over the training tokens, what a word and the end cost, and the piece probabilities."""

    def __init__(self, known: int, tokens: int, ends: int, pieces: Pieces) -> None:
        self.v, self.n, self.ends, self.pieces = known + (ends > 0), tokens + ends, ends, pieces
        self.end = (ends + 0.5) / (self.n + 1)
        self.go = math.log10(1 - self.end)

    def base(self, c: np.ndarray | int):
        return np.log10((np.asarray(c) + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def score_words(self, words: list[bytes]) -> np.ndarray:
        return word_logp(words, self.pieces) / math.log(10) + self.go


def _word_scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            scores = model.score_words([w.encode() for w in batch.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.base(batch.column("c").to_numpy())), pa.array(scores)], names=["word", "c", "n", "base", "lattice"])

    return run


def _head_sums(model: Model, head: dict[bytes, tuple[bool, float, float]], keep: list[str]):
    """Sums over a document's head words and the end; its other words and how often it has them."""
    first = (int(model.ends > 0), float(model.base(model.ends)), math.log10(model.end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, known, base, lattice, words, often = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = tokens(text)
                k, b, s = first
                rest = Counter()
                for w, n in Counter(own).items():
                    if w in head:
                        x = head[w]
                        k, b, s = k + n * x[0], b + n * x[1], s + n * x[2]
                    else:
                        rest[w] = n
                sizes.append(len(own) + 1), known.append(k), base.append(b), lattice.append(s), words.append(list(rest)), often.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(lattice, pa.float64()), pa.array(words, pa.list_(pa.string())), pa.array(often, pa.list_(pa.int64()))],
                names=[*keep, "n_tokens", "_known", "_base", "_lattice", "_words", "_often"],
            )

    return run


@guarded
def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each row of docs (with text and held_out) without text, with n_tokens, n_known, train_tokens, base_score, score.

    score is the log10 probability of the text's words and its end: each word costs its lattice probability and
    that the text goes on. A null text is empty: only the end. A null held_out counts as held out. Repeated rows
    each count and each get their scores. Columns named like a result are replaced. Without training documents
    counts are 0 and the vocabulary's own scores hold. An empty table gives none.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    clean = docs.drop(*made).withColumn("held_out", F.coalesce("held_out", F.lit(True)))
    small_batches(docs)
    keep = [c for c in clean.columns if c != "text"]
    counts = materialize(word_counts(clean.select("text", "held_out")), "word-counts")
    sums = counts.agg(F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = clean.where(~F.col("held_out")).count()
    model = Model(sums.v, sums.n, ends, learn_pieces(counts, from_sentencepiece(vocabulary)))
    scored = materialize(counts.mapInArrow(_word_scores(model), "word string, c long, n long, base double, lattice double"), "word-scores")
    top = scored.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    head = {r.word.encode(): (r.c > 0, r.base, r.lattice) for r in top}
    fields = [clean.schema[c] for c in keep] + [
        T.StructField("n_tokens", T.LongType()), T.StructField("_known", T.LongType()), T.StructField("_base", T.DoubleType()), T.StructField("_lattice", T.DoubleType()),
        T.StructField("_words", T.ArrayType(T.StringType())), T.StructField("_often", T.ArrayType(T.LongType())),
    ]
    # The number is given once, in the table, so that it stays whatever is computed again.
    summed = materialize(clean.mapInArrow(_head_sums(model, head, keep), T.StructType(fields)).withColumn("_row", F.monotonically_increasing_id()), "head-sums")
    tail = summed.select("_row", F.explode(F.arrays_zip("_words", "_often")).alias("t")).select("_row", F.col("t._words").alias("word"), F.col("t._often").alias("k"))
    costs = scored.select("word", (F.col("c") > 0).cast("long").alias("c"), "base", "lattice")
    added = tail.join(costs, "word").groupBy("_row").agg(F.sum(F.col("k") * F.col("c")).alias("_k"), F.sum(F.col("k") * F.col("base")).alias("_b"), F.sum(F.col("k") * F.col("lattice")).alias("_l"))
    whole = summed.drop("_words", "_often").join(added, "_row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select(*keep, "n_tokens", plus("_known", "_k").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), plus("_base", "_b").alias("base_score"), plus("_lattice", "_l").alias("score"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (crc_rest("doc_id", 5) == 1).alias("held_out"), text_or_empty().alias("text"))
    return score_documents(docs)
