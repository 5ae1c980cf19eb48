"""Language identification by unigram pieces over a fixed public vocabulary, summed over all segmentations."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trim

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: At most about as many documents of each language are learned from, taken by a hash of doc_id.
LEARN_DOCS = 400
EM_ROUNDS = 3
#: Pseudo-count of each piece in each language, and the probability of a letter that is no piece.
SMOOTHING, UNKNOWN = 0.05, 1e-6
#: Runs of more letters are cut: no language writes longer words, and products of probabilities stay above zero.
WORD_LETTERS = 40
#: Words whose scores a task keeps at once, and words scored at once.
CACHE_WORDS, BLOCK_WORDS = 300_000, 2_000
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


class Lattice(NamedTuple):
    """All pieces in a list of words: word, start, end and piece of each, in the order of end."""

    n: int
    length: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray


def vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    """Pieces by number, from 1; 0 is a letter that is no piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    usable = [p for p in pieces if p.lower() == p and "▁" not in p[1:] and (p == "▁" or _LETTERS.fullmatch(p.lstrip("▁")))]
    return {p: i for i, p in enumerate(usable, 1)}


def automaton(pieces: dict[str, int]) -> ahocorasick.Automaton:
    """Finds all pieces in a text, with the number and the length of each."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p, i in pieces.items():
        out.add_word(p, i << 8 | len(p))
    out.make_automaton()
    return out


def lattice(words: Sequence[str], pieces: dict[str, int], longest: int, found: ahocorasick.Automaton | None = None) -> Lattice:
    """The pieces of up to longest letters in words; found is their automaton, if it is built already.

    words begin with ▁ or, if they carry on a cut run, with a letter. They are searched as one text, with line feeds
    between them, which no piece has; a letter that is no piece is an edge of its own."""
    found = found or automaton({p: i for p, i in pieces.items() if len(p) <= longest})
    length = np.array([len(t) for t in words], np.int32)
    first = np.concatenate([[0], np.cumsum(length + 1)])  # where words begin
    hits = np.fromiter(found.iter("\n".join(words)), np.dtype("i8,i8")) if words else np.empty(0, np.dtype("i8,i8"))
    at, piece, size = hits["f0"] + 1, hits["f1"] >> 8, hits["f1"] & 255  # in the order of their ends, the longest first
    letter = np.ones(first[-1], bool)
    letter[first[1:] - 1] = False
    letter[at[size == 1] - 1] = False
    lone = np.flatnonzero(letter) + 1
    place = np.searchsorted(at, lone, "right")
    at, piece, size = np.insert(at, place, lone), np.insert(piece, place, 0), np.insert(size, place, 1)
    word = np.searchsorted(first, at, "left") - 1
    end = at - first[word]
    order = np.argsort(end.astype(np.int16), kind="stable")
    word, start, end, piece = (x[order].astype(np.int32) for x in (word, end - size, end, piece))
    return Lattice(len(words), length, word, start, end, piece)


def forward(lat: Lattice, prob: np.ndarray) -> np.ndarray:
    """alpha[position, word]: the probability of a word's first letters, over all segmentations."""
    top = int(lat.length.max(initial=0))
    alpha = np.zeros((top + 1, lat.n))
    alpha[0] = 1
    cuts = np.searchsorted(lat.end, np.arange(1, top + 2))
    for j in range(1, top + 1):
        e = slice(cuts[j - 1], cuts[j])
        alpha[j] = np.bincount(lat.word[e], alpha[lat.start[e], lat.word[e]] * prob[lat.piece[e]], lat.n)
    return alpha


def backward(lat: Lattice, prob: np.ndarray) -> np.ndarray:
    top = int(lat.length.max(initial=0))
    beta = np.zeros((top + 1, lat.n))
    beta[lat.length, np.arange(lat.n)] = 1
    order = np.argsort(lat.start, kind="stable")
    word, start, end, piece = (x[order] for x in (lat.word, lat.start, lat.end, lat.piece))
    cuts = np.searchsorted(start, np.arange(0, top + 2))
    for i in range(top - 1, -1, -1):
        e = slice(cuts[i], cuts[i + 1])
        beta[i] += np.bincount(word[e], beta[end[e], word[e]] * prob[piece[e]], lat.n)
    return beta


def letters(text: str | None) -> list[str]:
    """The runs of letters of text, in lower case; long ones are cut, and the rest of a run has no ▁."""
    found = _LETTERS.findall(text.lower()) if text else []
    if found and len(max(found, key=len)) > WORD_LETTERS:
        return [("▁" if not i else "") + w[i : i + WORD_LETTERS] for w in found for i in range(0, len(w), WORD_LETTERS)]
    return [f"▁{w}" for w in found]


class Model(NamedTuple):
    """Log-free unigram probabilities of pieces, a column for each language."""

    langs: list[str]
    pieces: dict[str, int]
    prob: np.ndarray

    def score(self, words: Sequence[str], found: ahocorasick.Automaton | None = None) -> np.ndarray:
        """The log-probability of each word in each language."""
        out = np.empty((len(words), len(self.langs)))
        found, longest = found or automaton(self.pieces), max(map(len, self.pieces))
        for at in range(0, len(words), BLOCK_WORDS):
            lat = lattice(words[at : at + BLOCK_WORDS], self.pieces, longest, found)
            for k in range(len(self.langs)):
                out[at : at + lat.n, k] = np.log(forward(lat, self.prob[:, k])[lat.length, np.arange(lat.n)])
        return out


def learn(counts: dict[str, dict[str, int]], path: str = VOCABULARY, rounds: int = EM_ROUNDS) -> Model:
    """Piece probabilities for each language by expectation-maximisation over the counts of its words."""
    pieces, langs = vocabulary(path), sorted(counts)
    found, longest = automaton(pieces), max(map(len, pieces))
    prob = np.empty((len(pieces) + 1, len(langs)))
    for k, lang in enumerate(langs):
        words = sorted(counts[lang])
        lat, n = lattice(words, pieces, longest, found), np.array([counts[lang][w] for w in words], float)
        p = np.full(len(pieces) + 1, 1.0 / len(pieces))
        for _ in range(rounds):
            alpha, beta = forward(lat, p), backward(lat, p)
            whole = alpha[lat.length, np.arange(lat.n)]
            share = n[lat.word] * alpha[lat.start, lat.word] * p[lat.piece] * beta[lat.end, lat.word] / whole[lat.word]
            p = np.bincount(lat.piece, share, len(pieces) + 1) + SMOOTHING
            p[0] = 0
            p /= p.sum()
            p[0] = UNKNOWN
        prob[:, k] = p
    return Model(langs, pieces, prob)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, path: str = VOCABULARY, learn_docs: int = LEARN_DOCS) -> Model | None:
    """Learn from text and lang of the documents that are not held out: of each language, all with a hash under a
    threshold that leaves learn_docs of them on average. None if no document has a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.groupBy("lang").agg(F.count("*").alias("n")).where("n > 0")
    share = n.select(F.col("lang").alias("_lang"), (F.lit(float(learn_docs)) / F.col("n")).alias("_share"))
    position = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.select("lang", "text", position.alias("_at")).join(F.broadcast(share) if n.count() <= 10_000 else share, F.col("lang") == F.col("_lang")).where("_at < _share")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                words[lang].update(letters(text))
        rows = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

    table = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, w, k in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][w] = k
    return learn(counts, path) if counts else None


class Scorer:
    """Scores texts, keeping the scores of the words it has met."""

    def __init__(self, model: Model):
        self.model, self.found = model, automaton(model.pieces)
        self.at, self.rows = {}, np.empty((0, len(model.langs)))

    def __call__(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        found = [letters(t) for t in texts]
        new = list(set().union(*found) - self.at.keys())
        if len(self.at) + len(new) > CACHE_WORDS:
            self.at, self.rows = {}, self.rows[:0]
            new = list(set().union(*found))
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.model.score(new, self.found)])
        for words in found:
            if not words:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            mean = self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].mean(axis=0)
            odds = np.exp(mean - mean.max())
            best = int(odds.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(1 / odds.sum()))
        return langs, scores


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced). Only text is read.

    score is the likeliest language's share when an average word of the text decides: 1 when all words speak for it,
    1 / languages when none does. A text that is null or has no letter gets und and 0, as do all texts without a
    model. Of languages that tie, the first in the order of their names wins.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    base = docs.select(*rest)
    if model is None:
        return base.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary, for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches):
            langs, scores = scorer(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    schema = base.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return base.mapInArrow(run, schema)


def keep(docs: DataFrame, least: float) -> DataFrame:
    """The rows of docs whose text is in one of the languages learned from docs, with a score of at least least. Only
    the texts travel to Python, and only the verdicts come back."""
    model = fit(docs)
    if model is None:
        return docs.where("false")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def speaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            out: list[bool] = []
            for at in range(0, len(texts), 500):
                langs, scores = scorer(texts.slice(at, 500).to_pylist())
                out += [g != UNDETERMINED and s >= least for g, s in zip(langs, scores, strict=True)]
            yield pa.array(out, pa.bool_())
            trim()

    return docs.where(F.arrow_udf(speaks, "boolean")(F.col("text")))


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def crc_mod(doc_id: int) -> int:
    """What held_out takes from a doc_id."""
    return zlib.crc32(str(doc_id).encode()) % 3
