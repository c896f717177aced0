"""Brown class-based bigrams: exchange clustering of words, class transitions and word emissions.

The corpus is cut once into chunks of whole documents: a chunk row holds its distinct words and its tokens as numbers
into them. Word counts come from grouping all chunks' words; they flow back to the chunks by a join, so that later
passes read numbers only.

Every training word is a *unit* of its own, whatever its count: units number the training words, and ``ENDINGS`` more
stand for the words unseen in training, by their last three characters. The class of each unit is one byte of a
broadcast array, so driver and workers hold a byte per distinct training word. A round of exchange counts, for every
training word of one half, the classes before and after it over all training tokens, grouped by blocks of words in the
shuffle, and moves it to the class that raises the likelihood of the class bigrams most; the next round takes the other
half. Rounds go on until they gain next to nothing. At last each ending takes the class that most training words of that ending have.

log10 p(w | v) = log10 p(class(w) | class(v)) + log10 p(w | class(w)), the first smoothed towards the class
frequencies, the second by one count for every word and one for all unseen words of the class; both sum to one.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, python_ready, staged, table

ENDINGS = 1 << 13
CLASSES = 48
# Rounds end when two in a row add less than this share to the information of the class bigrams: words move by turns,
# so that two rounds let each of them move.
LEAST_GAIN = 0.001
SMOOTHING = 20.0  # weight of the class frequencies in a transition, in tokens
END = " "  # the token after each text; no word holds a blank
CHUNK = 12_000_000  # bytes of text in a chunk
BLOCK = 8192  # words whose counts travel as one row
GROUP = 256  # rows of a block that are summed by one call; more are summed in two steps

_CHUNK_SCHEMA = ("chunk long, doc_ids array<long>, held array<boolean>, ends array<int>, tokens binary, "
                 "words array<string>, counts array<int>")


# What a pass over the tokens reads of the chunks.
_TOKENS = ("chunk", "held", "ends", "tokens", "unit")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by the places of their bytes, compressed: high bytes are mostly zero."""
    planes = numbers.view(np.uint8).reshape(-1, numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class _Numbers(dict):
    """Words by the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Chunk:
    def __init__(self):
        self.numbers = _Numbers()
        self.parts: list[np.ndarray] = []
        self.docs, self.held, self.ends, self.size, self.bytes = [], [], [], 0, 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = (text or b"").lower().split()
        words.append(END.encode())
        part = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.parts.append(part)
        self.size += len(part)
        self.bytes += len(text or b"")
        self.docs.append(doc_id)
        self.held.append(held_out(doc_id))
        self.ends.append(self.size)

    def batch(self, chunk: int) -> pa.RecordBatch:
        tokens = np.concatenate(self.parts)
        sizes = np.diff(np.array([0, *self.ends]))
        training = np.repeat(~np.array(self.held), sizes)
        counts = np.bincount(tokens[training], minlength=len(self.numbers)).astype(np.int32)
        words = [w.decode("utf-8", "replace") for w in self.numbers]
        return pa.RecordBatch.from_arrays([
            pa.array([chunk], pa.int64()), pa.array([self.docs], pa.list_(pa.int64())),
            pa.array([self.held], pa.list_(pa.bool_())), pa.array([self.ends], pa.list_(pa.int32())),
            pa.array([_packed(tokens)], pa.binary()), pa.array([words], pa.list_(pa.string())),
            pa.array([counts], pa.list_(pa.int32()))],
            ["chunk", "doc_ids", "held", "ends", "tokens", "words", "counts"])


def _chunks(batches):
    """Chunks of the rows of one partition, numbered by the first row in them."""
    chunk, first = _Chunk(), 0
    for batch in batches:
        for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "body"))):
            if not chunk.docs:
                first = row
            chunk.add(doc_id, text)
            if chunk.bytes >= CHUNK:
                yield chunk.batch(first)
                chunk = _Chunk()
    if chunk.docs:
        yield chunk.batch(first)


def vocabulary(chunks: DataFrame) -> tuple[DataFrame, int]:
    """``word, c, unit, ending`` and the number of training words.

    ``c``: how often a word occurs in training documents (0: in others only). Training words are numbered from 0 in
    any order, the others have the unit of their ending.
    """
    words = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("x"))
    counted = staged(words.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("c")).withColumn(
        "place", F.monotonically_increasing_id()), "lm-words")
    # Places run within partitions; what all partitions before hold closes the gaps. Words of others leave some.
    part = F.shiftright("place", 33).alias("part")
    sizes = counted.groupBy(part).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("part")
    first = (sizes["n"].cumsum() - sizes["n"]).tolist()
    total = int(sizes["n"].sum())
    offsets = counted.sparkSession.createDataFrame(list(zip(sizes["part"].tolist(), first)), "part long, first long")
    ending = F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(ENDINGS)).cast("int")
    number = F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1)
    return counted.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        "word", "c", F.when(F.col("c") > 0, number).otherwise(total + ending).alias("unit"), ending.alias("ending")), total


def _attach(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """Chunks with the training count and the unit of each of their words instead of the words, staged."""
    numbered = chunks.select("chunk", F.posexplode("words").alias("place", "word"))
    found = numbered.join(words, "word").select(F.col("chunk").alias("of"), "place", "c", "unit")

    def merge(key, rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        c, unit = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        c[counts["place"]] = counts["c"]
        unit[counts["place"]] = counts["unit"]
        return rows.assign(c=[_packed(c)] * len(rows), unit=[_packed(unit)] * len(rows))

    slim = chunks.select("chunk", "doc_ids", "held", "ends", "tokens")
    return staged(slim.groupBy("chunk").cogroup(found.groupBy("of")).applyInPandas(
        merge, "chunk long, doc_ids array<long>, held array<boolean>, ends array<int>, tokens binary, c binary, unit binary"),
        "lm-chunks")


def _opened(batch: pa.RecordBatch):
    """Per chunk: document ids, held-out marks, ends, and per token its number, unit and training mark."""
    for i in range(batch.num_rows):
        ends = np.array(batch.column("ends")[i].as_py(), np.int64)
        held = np.array(batch.column("held")[i].as_py(), bool)
        tokens = _unpacked(batch.column("tokens")[i].as_py(), np.int32)
        unit = _unpacked(batch.column("unit")[i].as_py(), np.int64)
        sizes = np.diff(np.append(0, ends))
        yield i, ends, held, sizes, tokens, unit


def _before(classes: np.ndarray, ends: np.ndarray, end_class: int) -> np.ndarray:
    """The class before each token; a text begins after an end."""
    before = np.empty_like(classes)
    before[1:] = classes[:-1]
    before[np.append(0, ends[:-1])] = end_class
    return before


def _neighbours(encoded: DataFrame, shared, end_unit: int) -> np.ndarray:
    """How often each class stands before and after each class in training: a k x 2k table.

    Ends have a class before them, but none after.
    """
    k = CLASSES

    def count(batches):
        total = np.zeros((k, 2 * k), np.int64)
        of = shared.value
        for batch in batches:
            for _, ends, held, sizes, tokens, unit in _opened(batch):
                now = of[unit][tokens].astype(np.int64)
                before = _before(now, ends, of[end_unit])
                training = np.repeat(~held, sizes)
                total += _pairs(now, before, ends, held, training)
        total = total.ravel()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = encoded.select(*_TOKENS).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    joint = np.zeros(k * 2 * k)
    joint[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return joint.reshape(k, 2 * k)


def information(joint: np.ndarray) -> float:
    """Bits that the class of a token tells about that of the next one, on average."""
    pairs = joint[:, :CLASSES] / max(joint[:, :CLASSES].sum(), 1)
    apart = np.outer(pairs.sum(axis=1), pairs.sum(axis=0))
    met = pairs > 0
    return float((pairs[met] * np.log2(pairs[met] / apart[met])).sum())


def _turn(unit: np.ndarray) -> np.ndarray:
    """Which of the two halves a word belongs to."""
    return (unit * 0x9E3779B1 >> 7) % 2


def _total(rows: pd.DataFrame, kind) -> np.ndarray:
    """Counts of all cells of a block."""
    counts = np.zeros(BLOCK * 2 * CLASSES, np.int64)
    for steps, n in zip(rows["steps"], rows["counts"]):
        counts[np.cumsum(_unpacked(steps, np.int32))] += _unpacked(n, kind)
    return counts


def _summed(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Some rows of counts of a block as one, with 64-bit counts."""
    counts = _total(rows, np.int32)
    cells = np.flatnonzero(counts)
    steps = np.diff(cells, prepend=0).astype(np.int32)
    return pd.DataFrame({"block": [key[0]], "steps": [_packed(steps)], "counts": [_packed(counts[cells])]})


def _pairs(now: np.ndarray, before: np.ndarray, ends: np.ndarray, held: np.ndarray, training: np.ndarray) -> np.ndarray:
    """How often each class stands before and after each class in the training texts of a chunk."""
    k = CLASSES
    pairs = np.bincount((now * k + before)[training], minlength=k * k).reshape(k, k)
    starts = np.append(0, ends[:-1])[~held]
    first = np.bincount(now[starts] * k + before[starts], minlength=k * k).reshape(k, k)
    # What stands before a token has the token after it, but for the end before a text.
    return np.concatenate([pairs, (pairs - first).T], axis=1)


def _exchange(encoded: DataFrame, shared, joint: np.ndarray, end_unit: int, parity: int, chunks: int,
              ) -> tuple[np.ndarray, np.ndarray]:
    """One round: the words of one half move to the class that fits their neighbours best, by the neighbours that
    classes had in ``joint``. The classes after it, and the neighbours of classes before it, both from one pass.
    """
    k = CLASSES

    def neighbours(batches):
        """Counts of (word, class before) and (word, class after) in each chunk, a row per block of words; block -1 has
        those of classes in all chunks of a task.
        """
        of, total, salt = shared.value, np.zeros((k, 2 * k), np.int64), 0
        for batch in batches:
            for i, ends, held, sizes, tokens, unit in _opened(batch):
                now = of[unit][tokens].astype(np.int64)
                before = _before(now, ends, of[end_unit])
                training = np.repeat(~held, sizes)
                total += _pairs(now, before, ends, held, training)
                # Training tokens whose word may move, and those of them with a token after them in the same text.
                asked = np.flatnonzero(training & (_turn(unit) == parity)[tokens])
                last = np.zeros(len(tokens), bool)
                last[ends - 1] = True
                base = (unit * (2 * k))[tokens[asked]]
                inner = ~last[asked]
                cells, n = np.unique(np.concatenate(
                    [base + before[asked], base[inner] + k + now[asked[inner] + 1]]), return_counts=True)
                blocks, starts = np.unique(cells // (BLOCK * 2 * k), return_index=True)
                rows = []
                for block, a, b in zip(blocks, starts, np.append(starts[1:], len(cells))):
                    steps = np.diff(cells[a:b], prepend=block * BLOCK * 2 * k).astype(np.int32)
                    rows.append((_packed(steps), _packed(n[a:b].astype(np.int32))))
                salt = int(batch.column("chunk")[i].as_py()) * 0x9E3779B1 % (1 << 31)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), pa.array(np.full(len(blocks), salt), pa.int64()),
                     pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())],
                    ["block", "salt", "steps", "counts"])
        cells = np.flatnonzero(total)
        # Pieces of 32 bits each, as the counts of blocks are.
        for low in range(0, 62, 31):
            part = total.ravel()[cells] >> low & ((1 << 31) - 1)
            steps = np.diff(cells + (low > 0) * k * 2 * k, prepend=0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1], pa.int64()), pa.array([salt], pa.int64()), pa.array([_packed(steps)], pa.binary()),
                 pa.array([_packed(part.astype(np.int32))], pa.binary())], ["block", "salt", "steps", "counts"])

    # log of how much likelier a neighbour class is beside a class than anywhere.
    with_class = joint + 0.5
    odds = [np.log(with_class[:, s]) - np.log(with_class[:, s].sum(axis=1, keepdims=True)) for s in (
        slice(0, k), slice(k, 2 * k))]
    fit = encoded.sparkSession.sparkContext.broadcast(np.concatenate(odds, axis=1))

    salts = math.ceil(chunks / GROUP)

    def choose(key, rows: pd.DataFrame) -> pd.DataFrame:
        """The words of one block that move, and their new classes; of block -1 the cells that are not empty."""
        counts = _total(rows, np.int64 if salts > 1 else np.int32)
        if key[0] < 0:
            low, high = counts[:k * 2 * k], counts[k * 2 * k:2 * k * 2 * k]
            return pd.DataFrame({"block": [-1], "unit": [(low + (high << 31)).tobytes()], "class": [b""]})
        counts = counts.reshape(BLOCK, 2 * k).astype(float)
        met = np.flatnonzero(counts.any(axis=1))
        unit = key[0] * BLOCK + met
        gain = counts[met] @ fit.value.T
        best = gain.argmax(axis=1)
        at = np.arange(len(unit))
        better = gain[at, best] > gain[at, shared.value[unit]] + 1e-9
        moves = better & (_turn(unit) == parity) & (unit != end_unit)
        return pd.DataFrame({"block": [key[0]], "unit": [_packed(unit[moves])], "class": [best[moves].astype(np.int8).tobytes()]})

    counts = encoded.select(*_TOKENS).mapInArrow(neighbours, "block long, salt long, steps binary, counts binary")
    # A chunk gives a block one row: many chunks are summed by their salt first, so that no call holds more than a group.
    if salts > 1:
        counts = counts.groupBy("block", F.pmod("salt", F.lit(salts))).applyInPandas(
            lambda key, rows: _summed(key, rows), "block long, steps binary, counts binary")
    moved = counts.drop("salt").groupBy("block").applyInPandas(
        choose, "block long, unit binary, class binary").toArrow()
    classes, before = shared.value.copy(), np.zeros((k, 2 * k))
    for block, unit, to in zip(*(moved[c].to_pylist() for c in ("block", "unit", "class"))):
        if block < 0:
            before += np.frombuffer(unit, np.int64).reshape(k, 2 * k)
        else:
            classes[_unpacked(unit, np.int64)] = np.frombuffer(to, np.int8)
    return classes, before


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from documents whose id's remainder modulo 7 is not 2. Null and empty texts are one end token; null ids are
    treated as the empty text is and stay null; repeated rows count as often as they occur; an empty table gives no
    rows; other columns are not looked at. Without training documents every score is that of unseen words.
    """
    spark = python_ready(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).cast("binary").alias("body"))
    chunks = staged(rows.mapInArrow(_chunks, _CHUNK_SCHEMA), "lm-texts")
    words, known = vocabulary(chunks)
    encoded = _attach(chunks, words)
    discard(chunks)

    # Start: the end and the most frequent words each have a class of their own, all other words share the last. Without
    # training documents the end has the unit of no word.
    frequent = words.where("c > 0").orderBy(F.desc("c"), "word").limit(CLASSES).select("word", "unit").collect()
    classes = np.full(known + ENDINGS, CLASSES - 1, np.int8)
    end_unit = next((r["unit"] for r in words.where((F.col("word") == END) & (F.col("c") > 0)).select("unit").collect()), known)
    own = [end_unit] + [r["unit"] for r in frequent if r["unit"] != end_unit]
    classes[own[:CLASSES - 1]] = np.arange(min(len(own), CLASSES - 1))
    context = spark.sparkContext
    shared = context.broadcast(classes)
    joint = _neighbours(encoded, shared, end_unit)
    told, turn, small, count = information(joint), 0, 0, encoded.count()
    while small < 2:
        classes, joint = _exchange(encoded, shared, joint, end_unit, turn % 2, count)
        shared = context.broadcast(classes)
        turn, last, told = turn + 1, told, information(joint)
        # The first round tells what is known already: the information of the start.
        small = small + 1 if turn > 1 and told - last < LEAST_GAIN * told or not told else 0
    joint = _neighbours(encoded, shared, end_unit)

    classes, *model = _estimate(words, shared, joint, known)
    shared = context.broadcast((classes, *model))

    def scores(batches):
        classes, step, emit_total, total, distinct = shared.value
        for batch in batches:
            for i, ends, held, sizes, tokens, unit in _opened(batch):
                c = _unpacked(batch.column("c")[i].as_py(), np.int64)
                of_word = classes[unit]
                now = of_word[tokens]
                base = np.log10((c + 1) / (total + distinct + 1))
                emit = np.log10((c + 1) / emit_total[of_word])
                starts = np.append(0, ends[:-1])
                each = step[_before(now, ends, classes[end_unit]), now] + emit[tokens]
                size = len(ends)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids")[i].values, pa.array(held), pa.array(sizes),
                    pa.array(np.add.reduceat((c > 0)[tokens].astype(np.int64), starts)),
                    pa.array(np.full(size, total, np.int64)), pa.array(np.add.reduceat(base[tokens], starts)),
                    pa.array(np.add.reduceat(each, starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                      "base_score double, score double")


def _estimate(words: DataFrame, shared, joint: np.ndarray, known: int):
    """Classes with those of endings; log10 transitions (class before x class), emission totals per class, training
    tokens, distinct words."""
    k = CLASSES
    joint = joint[:, :k].T
    tokens = joint.sum(axis=0)
    # Every class keeps a share, also one without training tokens: unseen words may fall into it.
    share = (tokens + 1) / (tokens.sum() + k)
    step = np.log10((joint + SMOOTHING * share) / (joint.sum(axis=1, keepdims=True) + SMOOTHING))

    def classed(batches):
        for batch in batches:
            found = shared.value[batch.column("unit").to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("ending"), pa.array(found, pa.int32()), batch.column("c")], ["ending", "class", "c"])

    met = words.where("c > 0").select("unit", "ending", "c").mapInArrow(
        classed, "ending int, class int, c long").groupBy("ending", "class").agg(
        F.count(F.lit(1)).alias("words"), F.sum("c").alias("c")).toPandas()
    types = np.zeros((ENDINGS, k))
    types[met["ending"], met["class"]] = met["words"]
    count = np.bincount(met["class"], met["c"].to_numpy(float), minlength=k)
    classes = shared.value.copy()
    # An ending that no training word has is treated as most words are.
    classes[known:] = np.where(types.any(axis=1), types.argmax(axis=1), types.sum(axis=0).argmax())
    return classes, step, count + types.sum(axis=0) + 1, int(met["c"].sum()), int(met["words"].sum())


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
