"""Quality rules: base counts, and the divergence of a text from what its language looks like."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices, trim

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
#: Base: a text fails if more than this percentage of its words stand in repeated windows.
REPEAT_PERCENT = 50
WINDOW = 3
#: Common words of a language, of which it has COMMON_WORDS. A task hands on its counts when it holds those of MOST_COUNTS words.
COMMON_WORDS, MOST_COUNTS = 40, 200_000
#: Character histograms are compared from LEAST_CHARS characters on, word histograms from LEAST_COMPARED words on.
LEAST_CHARS, LEAST_COMPARED = 200, 50
#: A text fails if a Jensen-Shannon distance (0 to 1) from its language passes these; that of the words of a short text
#: may be larger by WORD_SAMPLING / sqrt(words), as few words scatter. The two of words were chosen on the documents of
#: sf0.1 with an even crc32(doc_id): of a grid, those that reject the most labelled bad ones and leave the clean ones, and
#: 3,000 texts put together from clean ones of two languages, by 0.01; README says what else was looked at.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE, WORD_SAMPLING = 0.32, 0.31, 0.75


def _classes() -> np.ndarray:
    """The class of each byte; -1 for the later bytes of a character."""
    out = np.full(256, 7, np.int64)  # other ASCII punctuation
    out[[*range(0x61, 0x7B)]] = 0
    out[[*range(0x41, 0x5B)]] = 1
    out[[*range(0x30, 0x3A)]] = 2
    out[[0x20, 9, 11, 12, 13]] = 3
    out[10] = 4
    out[[*b".,"]] = 5
    out[[*b"!?;:'\"()-"]] = 6
    out[[*SYMBOLS]] = 8
    out[[*range(0, 9), *range(14, 32), 127]] = 9
    out[0x80:0xC0] = -1
    out[0xC0:] = 10
    return out


N_CLASSES = 11
_CLASS = _classes()
_BLANK = [0x20, *range(9, 14)]


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    classes: np.ndarray
    words: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) <= WINDOW:
        return 0
    m = int(ids.max()) + 1
    key = ids[:-2] * m + ids[1:-1]
    if m > 2_000_000:  # three ids would not fit into 63 bits
        key = np.unique(key, return_inverse=True)[1]
    key = key * m + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        cover[k : k + len(again)] |= again
    return int(cover.sum())


def measure(text: str | None, common: Sequence[bytes]) -> Counts:
    """common: the common words of the text's language. The word histogram ends with all other words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    each = np.bincount(ids, minlength=len(seen))
    lower: Counter = Counter()
    for w in common:
        for form in (w, w.capitalize(), w.upper()) if w.isascii() else (w,):
            if form in seen and form not in lower:
                lower[form] = each[seen[form]]
    hist = np.array([sum(lower.get(f, 0) for f in {w, w.capitalize(), w.upper()}) for w in common] + [0], np.int64)
    hist[-1] = len(words) - hist.sum()
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else []
    classes = np.bincount(_CLASS[_CLASS >= 0], by_byte[_CLASS >= 0], N_CLASSES).astype(np.int64)
    return Counts(
        len(words), int(classes.sum() - by_byte[_BLANK].sum()), int(by_byte[[*SYMBOLS]].sum()), len(lines) - len(set(lines)), repeated_words(ids), classes, hist
    )


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The square root of the Jensen-Shannon divergence, in bits, of each row of p from the row of q; 0 for an empty row."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(p.sum(axis=1) > 0, np.sqrt(np.maximum(d / 2, 0)), 0)


def common_words(docs: DataFrame, n_words: int = COMMON_WORDS) -> dict[str, list[bytes]]:
    """The words that most texts of a language hold, counted over all its texts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def rows(found: dict[str, Counter]) -> pa.RecordBatch:
        each = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        return pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in each], pa.string()), "word": pa.array([r[1] for r in each], pa.binary()), "n": pa.array([r[2] for r in each], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found[lang].update(set(text.encode("utf-8", "surrogatepass").lower().split()))
            if sum(map(len, found.values())) > MOST_COUNTS:
                yield rows(found)
                found = defaultdict(Counter)
        yield rows(found)

    sums = known.select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best: dict[str, list[bytes]] = defaultdict(list)
    for r in sums.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n_words).orderBy("lang", "_rank").collect():
        best[r["lang"]].append(bytes(r["word"]))
    return dict(best)


COUNTED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, classes array<long>, words array<long>"


def _language(lang: str | None, data: str | None, common: dict[str, list[bytes]]) -> str | None:
    """A text without a known language counts as of that whose common words it has most of."""
    if lang in common or not common:
        return lang if lang in common else None
    each = Counter((data or "").encode("utf-8", "surrogatepass").lower().split())
    return max(sorted(common), key=lambda k: sum(each.get(w, 0) for w in common[k]))


def _counted(texts: list[str | None], given: list[str | None], common: dict[str, list[bytes]]) -> tuple[list[str | None], list[Counts]]:
    langs = [_language(g, t, common) for g, t in zip(given, texts, strict=True)]
    return langs, [measure(t, common.get(g, ())) for g, t in zip(langs, texts, strict=True)]


class References(NamedTuple):
    """What each language looks like: sums of the histograms of all its documents that pass the base rules."""

    common: dict[str, list[bytes]]
    classes: dict[str, list[int]]
    words: dict[str, list[int]]


def count_all(docs: DataFrame, common: dict[str, list[bytes]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, found = _counted(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), common)
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string())]
            cols += [pa.array([getattr(c, k) for c in found], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            cols += [pa.array([c.base_failed for c in found], pa.bool_())]
            cols += [pa.array([getattr(c, k).tolist() for c in found], pa.list_(pa.int64())) for k in ("classes", "words")]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in COUNTED.split(", ")])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, COUNTED)


def references(counted: DataFrame, common: dict[str, list[bytes]]) -> References:
    """Gathers one row for each language."""
    good = counted.where("NOT base_failed AND lang IS NOT NULL")
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)] + [F.sum(F.coalesce(F.get("words", F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(COMMON_WORDS + 1)]
    rows = good.groupBy("lang").agg(*sums).collect()
    return References(common, {r["lang"]: [r[f"c{i}"] for i in range(N_CLASSES)] for r in rows}, {r["lang"]: [r[f"w{i}"] for i in range(len(common[r["lang"]]) + 1)] for r in rows})


def distances(langs: Sequence[str | None], classes: Sequence, words: Sequence, ref: References) -> tuple[np.ndarray, np.ndarray]:
    """The two distances of each text from its language; 0 where the language has no reference."""
    by_class, by_word = np.zeros(len(langs)), np.zeros(len(langs))
    for g in set(langs) & ref.classes.keys():
        at = np.array([i for i, x in enumerate(langs) if x == g])
        by_class[at] = js_distance(np.array([classes[i] for i in at], float), np.array([ref.classes[g]], float))
        by_word[at] = js_distance(np.array([words[i] for i in at], float), np.array([ref.words[g]], float))
    return by_class, by_word


def verdict(n_words: np.ndarray, n_chars: np.ndarray, base_failed: np.ndarray, by_class: np.ndarray, by_word: np.ndarray) -> np.ndarray:
    odd = (n_chars >= LEAST_CHARS) & (by_class > MOST_CHAR_DISTANCE)
    odd |= (n_words >= LEAST_COMPARED) & (by_word > MOST_WORD_DISTANCE + WORD_SAMPLING / np.sqrt(np.maximum(n_words, 1)))
    return ~(base_failed | odd)


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> a row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, char_distance, word_distance.

    A null or empty text has no words, so it fails the base. A null or unknown lang is taken to be that whose
    common words the text has most of. Repeated rows are judged alike; a null doc_id stays null; an empty table gives an
    empty one.
    """
    common = common_words(docs)
    counted = materialize(count_all(docs, common), "quality")
    ref = references(counted, common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes = b.column("classes").to_pylist()
            by_class, by_word = distances(b.column("lang").to_pylist(), classes, b.column("words").to_pylist(), ref)
            n_words, failed = b.column("n_words").to_numpy(zero_copy_only=False), b.column("base_failed").to_numpy(zero_copy_only=False)
            kept = verdict(n_words, np.array([sum(c) for c in classes]), failed.astype(bool), by_class, by_word)
            plain = [b.column(k) for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(kept, pa.bool_()), pa.array(by_class), pa.array(by_word)], [x.split()[0] for x in JUDGED.split(", ")])

    return counted.mapInArrow(run, JUDGED)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge keeps, with all their columns. The texts are measured a second time, which is
    cheaper than a shuffle of them; only the verdicts come back from Python."""
    common = common_words(docs)
    ref = references(materialize(count_all(docs, common), "quality"), common)

    def passes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, given in batches:
            out: list[bool] = []
            for at in range(0, len(texts), 500):
                langs, found = _counted(texts.slice(at, 500).to_pylist(), given.slice(at, 500).to_pylist(), common)
                by_class, by_word = distances(langs, [c.classes for c in found], [c.words for c in found], ref)
                out += verdict(np.array([c.n_words for c in found]), np.array([int(c.classes.sum()) for c in found]), np.array([c.base_failed for c in found], bool), by_class, by_word).tolist()
            yield pa.array(out, pa.bool_())
            trim()

    return docs.where(F.arrow_udf(passes, "boolean")(F.col("text"), F.col("lang")))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).drop("char_distance", "word_distance")


#: Counts, common words, references and distances of all documents, in SQL of their own.
SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, text IS NOT NULL AS given FROM documents),
words AS (SELECT k, doc_id, lang, text, given, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(low, '[^\x20\x09-\x0D]+') AS v FROM texts),
places AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM words WHERE len(w) >= 3),
windows AS (SELECT k, i, count(*) OVER (PARTITION BY k, run) AS n FROM places),
again AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE n > 1) GROUP BY k),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM words),
doubled AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
counts AS (SELECT x.k, doc_id, lang, text, w, v, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words,
    len(w) < 50 OR 100 * coalesce(a.n, 0) > 50 * len(w) AS base_failed
    FROM words x LEFT JOIN again a ON a.k = x.k LEFT JOIN doubled d ON d.k = x.k),
held AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(v)) AS word FROM words WHERE given AND lang IS NOT NULL) GROUP BY lang, word),
common AS (SELECT lang, word, upper(word[1]) || word[2:] AS capital, upper(word) AS upper, regexp_full_match(word, '[\x00-\x7F]*') AS plain FROM held
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 40),
each AS (SELECT k, word, lower, count(*) AS n FROM (SELECT k, unnest(w) AS word, unnest(v) AS lower FROM counts) GROUP BY k, word, lower),
guess AS (SELECT k, common.lang, sum(n) AS n FROM each JOIN common ON common.word = each.lower WHERE k IN (SELECT k FROM counts WHERE lang IS NULL OR lang NOT IN (SELECT lang FROM common)) GROUP BY k, common.lang
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY sum(n) DESC, common.lang) = 1),
judged AS (SELECT c.k, c.doc_id, c.text, n_words, base_failed, CASE WHEN c.lang IN (SELECT lang FROM common) THEN c.lang ELSE coalesce(g.lang, (SELECT min(lang) FROM common)) END AS lang FROM counts c LEFT JOIN guess g ON g.k = c.k),
chars AS (SELECT k, lang, base_failed, unnest(['a', 'A', '0', ' ', 'n', '.', '!', '#', 'c', 'u', 'o']) AS class, unnest([
    length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^A-Z]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')),
    length(regexp_replace(text, '[^\x20\x09\x0B-\x0D]', '', 'g')), length(regexp_replace(text, '[^\n]', '', 'g')), length(regexp_replace(text, '[^.,]', '', 'g')),
    length(regexp_replace(text, '[^!?;:''"()-]', '', 'g')), length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')),
    length(regexp_replace(text, '[^\x00-\x08\x0E-\x1F\x7F]', '', 'g')), length(regexp_replace(text, '[\x00-\x7F]', '', 'g')),
    length(regexp_replace(text, '[^+/=@\[\\\]^_`{}~]', '', 'g'))]) AS n FROM judged),
found AS (SELECT j.k, c.word, sum(e.n) AS n FROM judged j JOIN common c ON c.lang = j.lang JOIN each e ON e.k = j.k AND (e.word = c.word OR c.plain AND (e.word = c.capital OR e.word = c.upper)) GROUP BY j.k, c.word),
slots AS (SELECT k, lang, n_words, base_failed, word AS class, coalesce(f.n, 0) AS n FROM (SELECT j.k, j.lang, j.n_words, j.base_failed, c.word FROM judged j JOIN common c ON c.lang = j.lang) LEFT JOIN found f USING (k, word)),
wordsof AS (SELECT k, lang, base_failed, class, n FROM slots UNION ALL SELECT k, lang, any_value(base_failed), NULL, any_value(n_words) - sum(n) FROM slots GROUP BY k, lang),
hist AS (SELECT *, 'chars' AS kind FROM chars UNION ALL SELECT *, 'words' FROM wordsof),
refs AS (SELECT kind, lang, class, sum(n) AS n FROM hist WHERE NOT base_failed GROUP BY kind, lang, class),
shares AS (SELECT h.k, h.kind, h.n / greatest(sum(h.n) OVER (PARTITION BY h.k, h.kind), 1) AS p, r.n / sum(r.n) OVER (PARTITION BY h.k, h.kind) AS q, h.n
    FROM hist h JOIN refs r ON r.kind = h.kind AND r.lang = h.lang AND r.class IS NOT DISTINCT FROM h.class),
far AS (SELECT k, kind, sum(n) AS n, CASE WHEN sum(n) > 0 THEN sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) ELSE 0 END AS d
    FROM shares GROUP BY k, kind)
SELECT c.doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed,
    NOT (c.base_failed OR coalesce(a.n >= 200 AND a.d > 0.32, false) OR coalesce(c.n_words >= 50 AND b.d > 0.31 + 0.75 / sqrt(c.n_words), false)) AS kept
FROM counts c LEFT JOIN far a ON a.k = c.k AND a.kind = 'chars' LEFT JOIN far b ON b.k = c.k AND b.kind = 'words'
"""
