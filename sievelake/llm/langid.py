"""Language identification (operator 10): unigram piece models, with all segmentations of a word summed by the forward algorithm.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all ways to cut it into pieces; a text's
is the product over its words. The piece probabilities are fitted by expectation maximisation over the same sum. A further model, in which all pieces are
alike, stands for texts of no language that was learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import discard, parallelism, reachable, table, written

VOCABULARY = "piece_bpe_32k.model"
#: Training documents of each language, about so many, chosen by a hash of their text.
SAMPLE_DOCS = 1500
ROUNDS, CACHE = 3, 400_000
#: Words of more characters are summed one by one in logarithms.
LONG_WORD = 32
#: Probability of a character that is no piece; what is added to every expected count.
UNKNOWN, SMOOTH = 1e-7, 0.01
MARK = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")


class Pieces:
    """The vocabulary: lower-case letter pieces, with or without the word mark, numbered from 1. 0 stands for an unknown character."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        kept = [p for p in names if p == MARK or (b := p.removeprefix(MARK)).isalpha() and b == b.lower()]
        self.number = {p: i for i, p in enumerate(dict.fromkeys(kept), 1)}
        self.length = np.array([1, *map(len, self.number)])
        self.finder = ahocorasick.Automaton()
        for p, i in self.number.items():
            self.finder.add_word(p, i)
        self.finder.make_automaton()

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in all words, and a character where it is no piece itself: word, start, end, number, sorted by end, then word."""
        line = " ".join(words)
        flat = np.fromiter(chain.from_iterable(self.finder.iter(line)), np.int64)
        at, number = flat[::2], flat[1::2]
        unknown = np.ones(len(line), bool)
        unknown[at[self.length[number] == 1]] = False
        n = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
        unknown[first[1:] - 1] = False  # the blanks
        extra = np.flatnonzero(unknown)
        at, number = np.concatenate((at, extra)), np.concatenate((number, np.zeros(len(extra), np.int64)))
        word = np.searchsorted(first, at, side="right") - 1
        end = at - first[word] + 1
        order = np.lexsort((word, end))
        word, end, number = word[order], end[order], number[order]
        return word, end - self.length[number], end, number


def forward(lattice: tuple[np.ndarray, ...], n_words: int, prob: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: by place, word and language. prob: rows by piece number."""
    word, start, end, number = lattice
    alpha = np.zeros((int(end[-1]) + 1, n_words, prob.shape[1]))
    alpha[0] = 1
    cuts = np.searchsorted(end, np.arange(1, len(alpha) + 1))
    for e, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
        part = alpha[start[lo:hi], word[lo:hi]] * prob[number[lo:hi]]
        new = np.flatnonzero(np.concatenate(([True], word[lo + 1 : hi] != word[lo : hi - 1])))
        alpha[e, word[lo:hi][new]] = np.add.reduceat(part, new, axis=0)
    return alpha


def forward_log(word: str, pieces: Pieces, prob: np.ndarray) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """For one word of any length: the (start, number) of the pieces by their end, and the logs of the sums for each prefix and language."""
    _, start, end, number = pieces.lattice([word])
    ends: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
    for s, e, p in zip(start.tolist(), end.tolist(), number.tolist(), strict=True):
        ends[e].append((s, p))
    log, alpha = np.log(np.maximum(prob, 1e-300)), np.zeros((len(word) + 1, prob.shape[1]))
    for e in range(1, len(word) + 1):
        alpha[e] = np.logaddexp.reduce([alpha[s] + log[p] for s, p in ends[e]])
    return ends, alpha


def _by_length(words: list[str]) -> tuple[list[list[int]], list[int]]:
    """Places of words of up to LONG_WORD characters, in groups of similar length and bounded size, and of the others."""
    order = sorted((i for i, w in enumerate(words) if len(w) <= LONG_WORD), key=lambda i: len(words[i]))
    return [order[k : k + 4096] for k in range(0, len(order), 4096)], [i for i, w in enumerate(words) if len(w) > LONG_WORD]


def log_words(words: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word under each language."""
    out = np.zeros((len(words), prob.shape[1]))
    short, long = _by_length(words)
    for at in short:
        own = [words[i] for i in at]
        out[at] = np.log(forward(pieces.lattice(own), len(own), prob)[[len(w) for w in own], np.arange(len(own))])
    for i in long:
        out[i] = forward_log(words[i], pieces, prob)[1][-1]
    return out


def words_of(chunk: str) -> list[str]:
    """Marked lower-case words of a run of text: maximal runs of letters."""
    low = chunk.lower()
    if low.isalpha():
        return [MARK + low]
    found = _LETTERS.findall(low)
    if not all(map(str.isalpha, found)):  # a few characters are neither letters nor digits
        found = "".join(c if c.isalpha() else " " for c in low).split()
    return [MARK + w for w in found]


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language (prob has one column), by forward and backward sums over all words."""
    out = np.zeros(len(prob))
    short, long = _by_length(words)
    for at in short:
        own = [words[i] for i in at]
        lattice = word, start, end, number = pieces.lattice(own)
        alpha = forward(lattice, len(own), prob)[:, :, 0]
        n, each = np.array([len(w) for w in own]), np.arange(len(own))
        beta = np.zeros_like(alpha)
        beta[n, each] = 1
        cuts = np.searchsorted(end, np.arange(1, len(alpha) + 1))
        for e in range(len(alpha) - 1, 0, -1):
            lo, hi = cuts[e - 1 : e + 1]
            np.add.at(beta, (start[lo:hi], word[lo:hi]), beta[e, word[lo:hi]] * prob[number[lo:hi], 0])
        share = counts[at] / alpha[n, each]
        out += np.bincount(number, share[word] * alpha[start, word] * prob[number, 0] * beta[end, word], len(prob))
    for i in long:
        ends, alpha = forward_log(words[i], pieces, prob)
        log, beta = np.log(np.maximum(prob[:, 0], 1e-300)), np.full(len(alpha), -np.inf)
        beta[-1] = 0
        for e in range(len(alpha) - 1, 0, -1):
            for s, p in ends[e]:
                beta[s] = np.logaddexp(beta[s], beta[e] + log[p])
                out[p] += counts[i] * math.exp(min(0.0, alpha[s, 0] + log[p] + beta[e] - alpha[-1, 0]))
    return out


_pieces: dict[str, Pieces] = {}


def pieces_of(name: str) -> Pieces:
    """The vocabulary, once for each process."""
    if name not in _pieces:
        import public_tokenizers

        _pieces[name] = Pieces(public_tokenizers.path(name))
    return _pieces[name]


class Model:
    """Languages, and their piece probabilities as columns of an array, the last for no language."""

    def __init__(self, languages: list[str], prob: np.ndarray, vocabulary: str):
        self.languages, self.prob, self.vocabulary = languages, prob, vocabulary


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for chunk, k in Counter(text.as_py().split()).items():
                for w in words_of(chunk):
                    n[lang, w] += k
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> Model:
    """Fit on about sample_docs documents of each language, used whole; rows with a null text or language are left out. No rows give a model that knows none.

    Words are counted and their expectations computed by tasks; the driver sees one number per language and piece: the model's size, about 200 kB a language.
    """
    rows = reachable(df).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    pieces = pieces_of(vocabulary)
    n_pieces = len(pieces.number) + 1
    prob = np.full((n_pieces, len(languages) + 1), 1.0 / n_pieces)
    prob[0] = UNKNOWN
    if not languages:
        return Model([], prob, vocabulary)
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int((1 << 30) * min(1.0, sample_docs / n))))), F.col("lang"))
    counted = rows.where(drawn).mapInArrow(_count_words, "lang string, word string, n long")
    counts = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(parallelism(df.sparkSession)), "word-counts")
    spark = df.sparkSession
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(prob.copy())

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, prob = pieces_of(vocabulary), now.value
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                lang, word, n = (np.array(batch.column(c).to_pylist(), object) for c in range(3))
                for k in sorted(set(lang)):
                    at = np.flatnonzero(lang == k)
                    i = languages.index(k)
                    got = expected_counts(list(word[at]), n[at].astype(float), own, prob[:, i : i + 1])
                    total[k] = total.get(k, 0) + got
            for k, got in total.items():
                at = np.flatnonzero(got[1:]) + 1
                yield pa.RecordBatch.from_arrays([pa.array([languages.index(k)] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(got[at], pa.float64())], names=["language", "piece", "n"])

        sums = counts.mapInArrow(expect, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).collect()
        new = np.full((n_pieces, len(languages)), SMOOTH)
        for r in sums:
            new[r["piece"], r["language"]] += r["n"]
        prob[:, :-1] = new / new[1:].sum(0)
        prob[0] = UNKNOWN
        now.unpersist()
    discard(counts)
    return Model(languages, prob, vocabulary)


class Scorer:
    """Sums of word log-probabilities of whole texts, with bounded caches over white-space runs and over the words in them."""

    def __init__(self, model: Model):
        self.prob, self.pieces = model.prob, pieces_of(model.vocabulary)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.rows, self.logs = np.zeros((1024, self.prob.shape[1] + 1)), np.zeros((1024, self.prob.shape[1]))  # the last column of rows counts words

    @staticmethod
    def room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate((array, np.zeros((max(len(array), n - len(array)), array.shape[1]))))

    def learn(self, chunks: list[str]) -> None:
        words = [words_of(c) for c in chunks]
        if new := [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in self.words]:
            first = len(self.words)
            self.logs = self.room(self.logs, first + len(new))
            self.logs[first : first + len(new)] = log_words(new, self.pieces, self.prob)
            self.words.update(zip(new, range(first, first + len(new)), strict=True))
        first = len(self.index)
        self.rows = self.room(self.rows, first + len(chunks))
        self.index.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        n = np.fromiter(map(len, words), np.int64, len(words))
        row = np.repeat(np.arange(first, first + len(chunks)), n)
        at = np.fromiter((self.words[w] for ws in words for w in ws), np.int64, int(n.sum()))
        self.rows[first : first + len(chunks)] = 0
        np.add.at(self.rows[:, :-1], row, self.logs[at])
        self.rows[first : first + len(chunks), -1] = n

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > CACHE:
            self.clear()
        split = [(t or "").split() for t in texts]
        flat, sizes = list(chain.from_iterable(split)), np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(at < 0)):
            new = [flat[k] for k in missing]
            self.learn(list(dict.fromkeys(new)))
            at[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        out, full = np.zeros((len(split), self.rows.shape[1])), np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(self.rows[at], (np.cumsum(sizes) - sizes)[full], axis=0)
        return list(out)


_scorers: dict[int, Scorer] = {}


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred and score, the posterior of lang_pred among the learned languages and none of them, all equally likely before.

    `und` with score 0 where the text is null or has no letter, or no language was learned. Ties go to the first language in order. The evidence of words
    adds up, so that the score of all but short texts is near 1, or near 0 for texts whose words look like no learned language. Texts are scored whole;
    characters outside the vocabulary count with a small constant probability; repeated rows are answered each; an empty table gives no rows; other columns
    are ignored.
    """
    held, languages = df.sparkSession.sparkContext.broadcast(model), model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(held.value)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(held.value)
        scorer = _scorers[key]
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                langs, scores = [], []
                for row in scorer.score(batch.column(1).to_pylist()):
                    if not row[-1] or not languages:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    best = int(row[:-2].argmax())
                    langs.append(languages[best])
                    scores.append(1 / math.fsum(np.exp(np.clip(row[:-1] - row[best], -700, 700))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = reachable(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id")))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
