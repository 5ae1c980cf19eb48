"""Packing documents into sequences: a configuration linear program over the histogram of lengths, by multiplicative weights."""

from __future__ import annotations

import math
import os
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY, END_ID = 4096, 1
#: A configuration covers this part of the pieces of a length at most before prices change again.
STEP = 0.34
#: Room that a configuration may leave free at prices that have changed since.
MOST_WASTE = 0.002
#: How fast the price of a length falls as its pieces are covered.
ETA = 4.0
#: Configurations taken at the same prices.
COLUMNS = 192
#: Parts of the rounded solution that are kept in turn, while best fit places the rest.
KEEPS = (1.0, 0.98, 0.9, 0.75, 0.5, 0.25, 0.1)
#: Pieces of one length that one group of the ranking holds, about, and groups whose sums one window adds up.
RANK_ROWS, RANK_GROUPS = 200, 1000
#: Parts of texts that are encoded in one go, between marks: a control character that is a token of its own.
TOGETHER, MARK = 2000, "\x01"
#: Parts of texts, and parts of these, whose ids a Python worker keeps, in about 70 MB each.
CACHE_WORDS = 300_000
PUNCTUATION = string.punctuation
SPECIAL = "<|"  # special tokens begin so; they are found before capitals are dropped

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts. The tokenizer drops white space and joins nothing across it, so the ids of a text are those of its
    parts between blanks and line feeds; of a part, those of its last letters up to there and of the ASCII punctuation
    behind them; and in ASCII, capitals do not count. Most of these come again and again."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.known: dict[str, bytes] = {"": b""}  # little-endian 32-bit numbers
        self.whole: dict[str, bytes] = {}  # of parts of texts as they are
        self.mark = int(self.ids(MARK)[0])

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, parts: list[str]) -> None:
        """Take the ids of parts into known."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
            known[""] = b""
        new = set(parts).difference(known)
        for w in [w for w in new if MARK in w]:
            known[w] = self.ids(w).tobytes()
            new.remove(w)
        todo = list(new)
        for i in range(0, len(todo), TOGETHER):
            some = todo[i : i + TOGETHER]
            ids = self.ids(f" {MARK} ".join(some))
            data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark)).tolist()
            known.update(zip(some, [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)], strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins, and the end."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        words = coded.dictionary.to_pylist()
        parts = list(map(self.whole.get, words))
        if new := [i for i, p in enumerate(parts) if p is None]:
            heads, tails = [], []
            for i in new:
                w = words[i]
                head = w.rstrip(PUNCTUATION)
                if SPECIAL in w or not head or not head[-1].isalpha():
                    heads.append(w)
                    tails.append("")
                    continue
                heads.append(head.lower() if head.isascii() else head)
                tails.append(w[len(head) :])
            self.learn([*heads, *tails])
            keep = len(self.whole) < CACHE_WORDS  # what comes first is what comes often
            for i, head, tail in zip(new, heads, tails, strict=True):
                parts[i] = self.known[head] + self.known[tail] if tail else self.known[head]
                if keep:
                    self.whole[words[i]] = parts[i]
        ids = np.frombuffer(b"".join(map(parts.__getitem__, index.tolist())), "<u4")
        n = (np.fromiter(map(len, parts), np.int64, len(parts)) // 4)[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]]


def encoder(tokenizer: str) -> Encoder:
    """One Encoder for all tasks of a Python worker, which knows the words of the tasks before."""
    import tokenizers

    held = getattr(tokenizers, "_galena_encoder", None)
    if held is None or held[0] != tokenizer:
        held = tokenizer, Encoder(tokenizer)
        tokenizers._galena_encoder = held
    return held[1]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> a row per piece: doc_id, piece, start, length, ids_crc32, and ids if asked for. A null or
    empty text is the end id alone."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of fixed size
    end = np.array([end_id], "<u4").tobytes()
    wide = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in slices(batches, 2500):
            rows = []
            found, cuts = encode(batch.column("text"))
            found, cuts = found.tobytes(), (4 * cuts).tolist()
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                data = found[a:b] + end
                for k, i in enumerate(range(0, len(data), wide)):
                    part = data[i : i + wide]
                    rows.append((doc_id, k, i // 4, len(part) // 4, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int32).tolist(),) if ids else ()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids array<int>" * ids)


class Plan(NamedTuple):
    """Where the pieces of each length go. Entry i takes those of length[i] with ranks from first[i] on: sequence[i] +
    n // each[i] and offset[i] + n % each[i] * length[i], for the n-th of them. No packing has fewer sequences than bound;
    value is the fractional solution's, priced the number of sequences that come from it."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int
    bound: int
    value: float
    priced: int


Configs = list[tuple[dict[int, int], int]]


def prices_to_values(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: value[c] is the most that lengths of sum c at most are worth; last[c] a length of such a
    choice, 0 where one token stays free."""
    capacity = len(price) - 1
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int32)
    lengths = np.flatnonzero(price)
    few = 3 * len(lengths) < capacity
    worths, fits = price[lengths], np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    back = np.zeros(capacity + 1)  # back[capacity - c] is value[c], so that slices run forwards
    for c in range(1, capacity + 1):
        if few:
            n = fits[c]
            worth = worths[:n] + value[c - lengths[:n]]
            k = int(worth.argmax()) if n else 0
            length = int(lengths[k]) if n else 0
        else:
            worth = price[1 : c + 1] + back[capacity - c + 1 : capacity + 1]
            k = int(worth.argmax())
            length = k + 1
        if length and worth[k] > value[c - 1]:
            value[c], last[c] = worth[k], length
        else:
            value[c] = value[c - 1]
        back[capacity - c] = value[c]
    return value, last


def solve(histogram: np.ndarray) -> tuple[list[tuple[dict[int, int], float]], float]:
    """The program: use as few configurations (pieces of each length) as possible, in any fractions, so that each length is
    covered as often as it has pieces. A solution, and a lower bound from its prices.

    Multiplicative weights: prices start in proportion to lengths and fall with exp(-ETA * part covered); covered lengths
    are worth nothing. At given prices, one knapsack table gives the dearest configuration, also with any one length set;
    those of the lengths that are least covered enter, each as far as covers STEP of its scarcest length. Prices over the
    dearest configuration's worth are a solution of the dual program, so what all pieces are worth then is a bound.
    """
    capacity = len(histogram) - 1
    total = histogram.astype(float)
    left, size = total.copy(), np.arange(capacity + 1, dtype=float)
    out: list[tuple[dict[int, int], float]] = []
    halves = (size > capacity / 2).astype(float) * (total > 0)  # no two of these share a sequence
    bound = float(halves @ total)
    while (todo := np.flatnonzero(left)).size:
        covered = 1 - left[todo] / total[todo]
        price = np.zeros(capacity + 1)
        price[todo] = size[todo] * np.exp(-ETA * covered)
        value, last = prices_to_values(price)
        bound = max(bound, float(total @ price) / value[capacity])
        full = np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0))  # what a choice for this room fills
        begun = len(out)
        for first in todo[np.lexsort((-todo, covered))][:COLUMNS].tolist():
            if not left[first]:
                continue
            config, room = {first: 1}, capacity - first
            while room := int(full[room]):
                k = int(last[room])
                config[k] = config.get(k, 0) + 1
                room -= k
            if not all(left[k] for k in config):  # prices are older than what is left: take the longest that is left and fits
                config = {k: a for k, a in config.items() if left[k]}
                room = capacity - sum(k * a for k, a in config.items())
                rest = np.flatnonzero(left[: room + 1])
                while len(rest) and (n := int(np.searchsorted(rest, room, "right"))):
                    k = int(rest[n - 1])
                    config[k] = config.get(k, 0) + 1
                    room -= k
                if room > MOST_WASTE * capacity and len(out) > begun:
                    continue
            amount = min(min(STEP * total[k], left[k]) / a for k, a in config.items())
            for k, a in config.items():
                left[k] -= a * amount
                if left[k] < 1e-9 * total[k]:
                    left[k] = 0
            out.append((config, amount))
    return out, bound


def rounded(solution: list[tuple[dict[int, int], float]], histogram: np.ndarray) -> Configs:
    """Configurations in whole numbers, of which no length has too few pieces: first the whole parts of the solution, then
    one more of each that still fits, those that waste least first, and of these the most used."""
    left = histogram.astype(np.int64).copy()
    capacity = len(histogram) - 1
    merged: dict[tuple[tuple[int, int], ...], float] = {}
    for config, amount in solution:
        key = tuple(sorted(config.items()))
        merged[key] = merged.get(key, 0.0) + amount
    order = sorted(merged.items(), key=lambda x: (capacity - sum(k * a for k, a in x[0]), -x[1], x[0]))
    times = dict.fromkeys(merged, 0)
    for more in (False, True):
        for config, amount in order:
            n = min(1 if more else int(amount + 1e-9), *(int(left[k]) // a for k, a in config))
            if n > 0:
                times[config] += n
                for k, a in config:
                    left[k] -= a * n
    return [(dict(c), times[c]) for c, _ in order if times[c]]


def configurations(histogram: np.ndarray) -> tuple[Configs, Configs, int, float]:
    """How often each configuration is used, so that all pieces of the histogram are placed: those of the program's
    solution, and those that best fit makes of what the rounding leaves; a lower bound, and the solution's value.

    Of the rounded solution, which begins with the fullest configurations, the parts KEEPS are kept in turn; the one with the
    fewest sequences in all is the plan. Should best fit alone need fewer than any of these, it is the plan.
    """
    solution, bound = solve(histogram)
    whole = rounded(solution, histogram)
    count = sum(n for _, n in whole)
    best: tuple[Configs, Configs] | None = None
    for keep in (*KEEPS, 0.0):
        room, part = round(keep * count), []
        for c, n in whole:
            if n := min(n, room):
                part.append((c, n))
                room -= n
        rest = histogram.astype(np.int64).copy()
        for c, n in part:
            for k, a in c.items():
                rest[k] -= a * n
        found = part, best_fit(rest)
        if best is None or sum(n for p in found for _, n in p) < sum(n for p in best for _, n in p):
            best = found
    return *best, math.ceil(bound - 1e-6), sum(x for _, x in solution)


def best_fit(histogram: np.ndarray) -> Configs:
    """Configurations and how often each is used: largest pieces first, each into the fullest sequence that can take it.

    Sequences that hold the same are one entry with a count, so the work depends on the lengths, not on the pieces."""
    capacity = len(histogram) - 1
    filled: dict[int, list[tuple[dict[int, int], int]]] = {}  # by room
    rooms: list[int] = []
    done: Configs = []

    def put(config: dict[int, int], times: int, room: int) -> None:
        if not room:
            done.append((config, times))
            return
        if room not in filled:
            filled[room] = []
            insort(rooms, room)
        filled[room].append((config, times))

    for k in range(capacity, 0, -1):
        n = int(histogram[k])
        while n:
            i = bisect_left(rooms, k)
            room = rooms[i] if i < len(rooms) else capacity
            if i < len(rooms):
                config, times = filled[room].pop()
                if not filled[room]:
                    del filled[room]
                    rooms.pop(i)
            else:
                config, times = {}, n // (capacity // k) or 1
            each = min(room // k, n)  # a sequence takes as many before the next one gets any
            used = min(times, n // each)
            if times > used:
                put(config, times - used, room)
            put({**config, k: each}, used, room - each * k)
            n -= used * each
    return done + [x for group in filled.values() for x in group]


def make_plan(histogram: np.ndarray) -> Plan:
    rows, sequence, placed = [], 0, np.zeros(len(histogram), np.int64)
    priced, fitted, bound, value = configurations(histogram)
    for config, times in priced + fitted:
        offset = 0
        for k, a in sorted(config.items(), reverse=True):
            rows.append((k, placed[k], sequence, a, offset))
            placed[k] += a * times
            offset += a * k
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Plan(*table.T, sequence, bound, value, sum(n for _, n in priced))


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, on disk, as they are read twice) with sequence_id and offset.

    Each sequence holds at most capacity tokens, without gaps from offset 0. What the driver gathers is a histogram of
    at most capacity rows. A null doc_id is a value like others, and repeated pieces are placed each; an empty table gives an
    empty one. A piece's rank among those of its length comes from groups of about RANK_ROWS pieces by
    a hash, so that a frequent length is no single task's.
    """
    counts = found.groupBy("length").agg(F.count("*").alias("n")).collect()
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts:
        histogram[length] = n
    plan = make_plan(histogram)
    groups = F.lit(np.maximum(1, -(-histogram // RANK_ROWS)).astype(int).tolist())
    keyed = found.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit("rank")), F.element_at(groups, (F.col("length") + 1).cast("int"))))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long"))
    sums = materialize(keyed.groupBy("length", "_group").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_group") / RANK_GROUPS)), "pack-groups")
    blocks = sums.groupBy("length", "_block").agg(F.sum("_n").alias("_n")).select("length", "_block", total(earlier("length").orderBy("_block")).alias("_start"))
    sums = sums.select("length", "_block", "_group", total(earlier("length", "_block").orderBy("_group")).alias("_inner")).join(blocks, ["length", "_block"])
    sums = materialize(sums.select("length", "_group", (F.col("_start") + F.col("_inner")).alias("_before")), "pack-ranks")
    order = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("_row", F.row_number().over(order)).join(sums, ["length", "_group"])
    ranked = ranked.select(*found.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    shared = found.sparkSession.sparkContext.broadcast(plan)  # grows with the number of lengths, not of pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        top = 1 << 44
        starts = p.length * top + p.first
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "_rank"))
            i = np.searchsorted(starts, length * top + rank, "right") - 1
            n = rank - p.first[i]
            cols = [b.column(k) for k in b.schema.names if k != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p.sequence[i] + n // p.each[i]), pa.array(p.offset[i] + n % p.each[i] * length)], [*(k for k in b.schema.names if k != "_rank"), "sequence_id", "offset"])

    schema = found.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, ids: bool = False) -> DataFrame:
    """docs (doc_id, text; other columns, whatever their names, are not read) -> a row per piece: doc_id, piece, start, length,
    ids_crc32 (and ids), sequence_id, offset.

    A null or empty text is one piece, the end id alone; a null doc_id stays null; repeated rows are packed each; an
    empty table gives an empty one.
    """
    return pack(materialize(pieces(docs, ids=ids), "pieces"))


def query(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
