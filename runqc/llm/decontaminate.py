"""Benchmark decontamination: BM25 inverted index of test items, searched by block-max WAND."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runqc.llm.common import give_back

K1, B = 1.2, 0.75
#: A passage is kept if it scores at least this share of what the test unit's own text would.
RETRIEVE = 0.6
#: Shares of the question's and of the answer's word triples that the document must hold.
QUESTION, ANSWER = 0.8, 0.8
#: Words of a test unit, and of the passages that are looked up; a unit lies whole in one of the overlapping passages.
UNIT, PASSAGE = 64, 128
BLOCK = 32
#: Share of a unit's score that its commonest terms may have and still not be looked at before the search.
COMMON_SHARE = 0.3
#: Test units of one index. A larger test set is searched in as many passes, each with an index of at most about this size.
SHARD_UNITS = 50_000
WORD = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?]\s+(?=\S)")


def words_of(text: str | None) -> list[str]:
    return [] if text is None else WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Of an item given as one text: the last sentence is the answer; a single sentence is cut before its last third."""
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    question, answer = (words_of(text[: ends[-1]]), words_of(text[ends[-1]:])) if ends else ([], [])
    if not question or not answer:
        words = words_of(text)
        cut = len(words) - len(words) // 3
        question, answer = words[:cut], words[cut:]
    return question, answer


def triples(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], words: list[str]) -> float:
    """Share of the part's word triples (of fewer words: the whole part) found in ``words``; 1 for an empty part."""
    want = triples(part)
    n = min(3, len(part))
    return len(want & {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}) / len(want) if want else 1.0


def units_of(words: list[str]) -> list[list[str]]:
    """An item's words in as few equal parts as keep to the size of a unit."""
    parts = -(-len(words) // UNIT)
    cuts = [len(words) * i // parts for i in range(parts + 1)] if parts else [0]
    return [words[a:b] for a, b in zip(cuts, cuts[1:])]


class BlockMaxIndex:
    """Postings of test units by term in blocks, each with its largest impact.

    Impacts are BM25 weights divided by the unit's own score, so a unit scores 1 against its own text and one threshold
    suits long and short units. Documents ask with the set of their words.
    """

    def __init__(self, units: list[tuple[int, list[str]]], df: dict[str, int], n_units: int, mean_length: float):
        """``units``: (number, words); ``df``, ``n_units``, ``mean_length``: over all units, also of other indexes."""
        postings: dict[str, list[tuple[int, float]]] = {}
        for number, words in sorted(units):
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / mean_length)
            weight = {w: np.log(1 + (n_units - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            own = sum(weight.values())
            for w, x in weight.items():
                postings.setdefault(w, []).append((number, float(x / own)))
        self.terms = {w: i for i, w in enumerate(postings)}
        self.ids = [[n for n, _ in p] for p in postings.values()]
        self.impact = [[x for _, x in p] for p in postings.values()]
        self.block_max = [[max(x[i:i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impact]
        self.most = np.array([max(x) for x in self.impact])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (unit, score) with at least ``threshold``, for distinct ``terms``.

        The pivot is the first list, by current unit, at which the summed list maxima reach the threshold: earlier units
        cannot. If the maxima of the blocks the pivot falls in do not reach it either, the lists jump past the nearest
        block end; else the pivot is scored once all lists before it have caught up.
        """
        threshold -= 1e-9
        cursors = [[self.ids[t][0], t, 0] for t in terms]  # current unit, term, position
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            bound, ends = 0.0, []
            for _, t, p in cursors[:pivot + 1]:
                at = bisect_left(self.ids[t], unit, p)
                if at < len(self.ids[t]):
                    bound += self.block_max[t][at // BLOCK]
                    ends.append(self.ids[t][min(len(self.ids[t]), (at // BLOCK + 1) * BLOCK) - 1])
            if bound < threshold:
                target = min(ends, default=unit) + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, unit + 1)
            elif cursors[0][0] == unit:
                score = sum(self.impact[t][p] for _, t, p in cursors[:pivot + 1])
                if score >= threshold:
                    found.append((unit, score))
                target = unit + 1
            else:
                target = unit
            for c in cursors[:pivot + 1]:
                if c[0] < target:
                    c[2] = bisect_left(self.ids[c[1]], target, c[2])
                    c[0] = self.ids[c[1]][c[2]] if c[2] < len(self.ids[c[1]]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


class Detector:
    """An index with the items its units belong to: by a number of their own, as item ids may be NULL or clash.

    WAND's first question, whether list bounds reach the threshold at all, is asked for all passages of a text at once.
    Each unit's commonest terms, up to 0.3 of its score, are taken as given; only the postings of its other terms are
    summed by passage and unit. A passage in which no unit can reach the threshold that way is not searched.
    """

    def __init__(self, index: BlockMaxIndex, item_of: dict[int, int], items: dict[int, tuple[int | None, list[str], list[str]]],
                 retrieve: float, question: float, answer: float):
        self.index, self.item_of, self.items = index, item_of, items
        self.retrieve, self.question, self.answer = retrieve, question, answer
        term = np.repeat(np.arange(len(index.ids)), [len(i) for i in index.ids])
        unit = np.array([u for ids in index.ids for u in ids], np.int64)
        impact = np.array([x for impacts in index.impact for x in impacts])
        spread = np.array([len(i) for i in index.ids], np.int64)[term]
        order = np.lexsort((term, -spread, unit))  # by unit, commonest terms first
        running = np.cumsum(impact[order])
        first = np.r_[0, np.flatnonzero(np.diff(unit[order])) + 1]
        before = np.repeat(running[first] - impact[order][first], np.diff(np.r_[first, len(order)]))
        given = np.zeros(len(order), bool)
        given[order] = running - before <= COMMON_SHARE
        self.need = np.full(int(unit.max()) + 1, retrieve - 1e-6)
        np.subtract.at(self.need, unit[given], impact[given])
        self.unit, self.impact = unit[~given], impact[~given]
        self.first = np.searchsorted(term[~given], np.arange(len(index.ids) + 1))

    def hopeful(self, known: np.ndarray, passages: int) -> np.ndarray:
        """Passages in which some unit may reach the threshold."""
        place = np.flatnonzero(known >= 0)
        term = known[place]
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        last = np.repeat(place // (PASSAGE - UNIT), n)  # a word is in this passage and in the one before
        keys = np.concatenate([(last - back) * len(self.need) + self.unit[at] for back in (0, 1)])
        impact = np.tile(self.impact[at], 2)
        inside = (keys >= 0) & (keys < passages * len(self.need))
        order = np.argsort(keys[inside], kind="stable")
        keys, impact = keys[inside][order], impact[inside][order]
        if not len(keys):
            return keys
        begin = np.r_[0, np.flatnonzero(np.diff(keys)) + 1]
        reached = np.add.reduceat(impact, begin) >= self.need[keys[begin] % len(self.need)]
        return np.unique(keys[begin][reached] // len(self.need))

    def hits(self, text: str | None) -> list[dict]:
        """``item_id, score, question_overlap, answer_overlap`` of each item found in a whole text."""
        words = words_of(text)
        if not words:
            return []
        known = np.fromiter((self.index.terms.get(w, -1) for w in words), np.int64, len(words))
        starts = np.arange(0, max(1, len(words) - (PASSAGE - UNIT)), PASSAGE - UNIT)
        places: dict[int, list[tuple[float, int]]] = {}
        for start in starts[self.hopeful(known, len(starts))]:
            terms = np.unique(known[start:start + PASSAGE])
            for unit, score in self.index.search(terms[terms >= 0].tolist(), self.retrieve):
                places.setdefault(self.item_of[unit], []).append((score, int(start)))
        found = []
        for item, at in sorted(places.items()):
            item_id, question, answer = self.items[item]
            reach = len(question) + len(answer)
            for score, start in sorted(at, reverse=True):
                around = words[max(0, start - reach): start + PASSAGE + reach]
                q, a = overlap(question, around), overlap(answer, around)
                if q >= self.question and a >= self.answer:
                    found.append({"item_id": item_id, "score": score, "question_overlap": q, "answer_overlap": a})
                    break
        return sorted(found, key=lambda f: (f["item_id"] is None, f["item_id"] or 0))


HITS = "array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double>>"
HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def _detectors(benchmark: DataFrame, item_id: str, text: str, answer: str | None, thresholds: tuple[float, float, float]):
    """One detector per shard of the test set. Document frequencies and lengths are of all its units."""
    spark = benchmark.sparkSession
    chosen = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"),
                              (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")).where("text is not null")
    chosen = chosen.withColumn("item", F.xxhash64(F.col("item_id").isNull(), *chosen.columns)).dropDuplicates(["item"])
    shards = max(1, -(-chosen.count() // SHARD_UNITS))
    frequency = _unit_words(chosen).groupBy("word").agg(F.count_distinct("item", "unit").alias("df"))
    size = _unit_words(chosen).agg(F.count_distinct("item", "unit").alias("n"), F.count("*").alias("words")).first()
    for shard in range(shards):
        part = chosen.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
        df = {r.word: r.df for r in frequency.join(_unit_words(part).select("word").distinct(), "word", "left_semi").toLocalIterator()}
        items, units, item_of = {}, [], {}
        for r in sorted(part.toLocalIterator(), key=lambda r: r.item):
            items[r.item] = (r.item_id, *((words_of(r.text), words_of(r.answer)) if r.answer is not None else question_and_answer(r.text)))
            whole = words_of(r.text) + words_of(r.answer)
            for part_words in units_of(whole):
                item_of[len(units)] = r.item
                units.append((len(units), part_words))
        if units:
            yield spark.sparkContext.broadcast(Detector(BlockMaxIndex(units, df, size.n, size.words / size.n), item_of, items, *thresholds))


def _unit_words(items: DataFrame) -> DataFrame:
    """(item, unit, word), a row per occurrence."""
    schema = pa.schema([("item", pa.int64()), ("unit", pa.int64()), ("word", pa.string())])

    def run(batches):
        for batch in batches:
            rows = [(r["item"], i, w) for r in batch.to_pylist() for i, u in enumerate(units_of(words_of(r["text"]) + words_of(r["answer"]))) for w in u]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ((), (), ()), schema)], schema=schema)

    return items.mapInArrow(run, "item long, unit long, word string")


def _lookup(shared):
    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        found = pa.array([shared.value.hits(t.as_py()) for t in texts], HIT_TYPE)
        give_back()
        return found

    return hits


def benchmark_hits(text: Column, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", answer: str | None = None,
                   retrieve: float = RETRIEVE, question: float = QUESTION, answer_share: float = ANSWER) -> Column:
    """An array column: the test items that a text holds, each with BM25 share and overlaps.

    Every text is cut into overlapping passages of 128 words and each is looked up in the index of test units (items of
    up to 64 words, longer ones in pieces). What scores at least ``retrieve`` is verified: shares ``question`` and
    ``answer_share`` of the item's word triples must occur around the passage. Words are runs of letters and digits,
    lower-cased. NULL, empty and blank texts hold nothing; items without text or words are no test items; an empty test
    set finds nothing. Every text under an item_id, NULL too, is an item and reported under that id; equal texts under
    different ids are all reported, repeated rows once.
    """
    found = []
    for shared in _detectors(benchmark, item_id, item_text, answer, (retrieve, question, answer_share)):

        found.append(_lookup(shared)(text))
    return F.concat(*found) if found else F.array().cast(HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: a row per document and test item it holds."""
    return docs.select(F.col(doc_id).alias("doc_id"), benchmark_hits(F.col(text), benchmark, **how).alias("hits")).select("doc_id", F.inline("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    return docs.where(F.size(benchmark_hits(F.col(text), benchmark, **how)) == 0)
