"""Benchmark decontamination by canonical templates with checked slots."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, released, small_batches

WINDOW = 8
#: Least number of plain words in a window that can tie a text to an item.
LITERALS = 5
#: A passage is a leak if so many words in a row follow an item, or all of a shorter one.
LEAST_WORDS = 13
#: Least words of an item that is too short for a window: fewer say nothing of where they come from.
SHORTEST = 3
#: Words of benchmark items that one pass holds on each executor (some 100 MB); a larger benchmark takes more passes.
PASS_WORDS = 1_000_000

UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons lb pounds ounce ounces ml l litre litres liter liters "
    "gallon gallons s sec second seconds minute minutes hour hours day days week weeks month months year years percent % degree degrees "
    "dollar dollars cent cents euro euros usd eur gbp kmh mph hz khz mhz watt watts kw volt volts joule joules byte bytes kb mb gb".split()
)
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,/:]*(?:st|nd|rd|th|%)?", re.I)
_NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
#: A number with its unit attached: up to three letters, or a longer word of UNITS.
_ATTACHED = re.compile(r"(\W*\d[\d.,/:]*)([^\W\d_]+)(\W*)")
_ORDINALS = frozenset("st nd rd th".split())
_EDGES = "\"'`.,;:!?()[]{}<>*_|-–—…“”‘’«»¿¡&#%$~/\\"
#: START: a capitalised word that starts a sentence or line, a name or not.
LITERAL, NUMBER, NAME, UNIT, START = 0, 1, 2, 3, 4
_DIGITS = "0123456789"
_PLACEHOLDER = {NUMBER: 0x6E756D, NAME: 0x6E616D, UNIT: 0x756E69}


class Canon(dict):
    """word -> (kind if a sentence starts, kind elsewhere, hash, whether it ends a sentence); emptied when full."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> tuple[int, int, int, int, bool]:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        attached, word = word[0] == "\0", word.lstrip("\0")
        core = word.strip(_EDGES) or word
        low = core.lower()
        plain = xxhash.xxh64_intdigest(low)
        ends = word[-1:] in (*".!?:",) or word[-2:-1] in (*".!?",)
        if attached:
            kinds = (UNIT, UNIT)
        elif _NUMBER.fullmatch(word.strip("\"'()[]{};:,.!?")) or _NUMBER.fullmatch(core) or low in _NUMBER_WORDS:
            kinds = (NUMBER, NUMBER)
        elif low in UNITS:
            kinds = (UNIT, UNIT)
        else:
            kinds = (START, NAME) if core[:1].isupper() and core[1:].islower() else (LITERAL, LITERAL)
        value = self["\0" + word if attached else word] = (kinds[0], kinds[1], plain, ends)
        return value

    @staticmethod
    def _parts(word: str) -> tuple[str, ...]:
        """A number and its attached unit, which a NUL marks, or the word itself."""
        m = _ATTACHED.fullmatch(word)
        if not m or m[2].lower() in _ORDINALS or len(m[2]) > 3 and m[2].lower() not in UNITS:
            return (word,)
        return m[1], "\0" + m[2] + m[3]

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its word's place, its kind, its template hash and its own hash.

        Tokens are words, or a number and the unit attached to it. A capitalised word is a name unless a sentence or
        line starts with it; there the template has the word itself.
        """
        words: list[str] = []
        starts: list[int] = []
        for line in text.split("\n"):
            starts.append(len(words))
            words += line.split()
        if not words:
            return tuple(np.empty(0, t) for t in (np.int64, np.int8, np.uint64, np.uint64))
        place, begins = np.arange(len(words)), np.asarray(starts)
        if glued := [i for i, w in enumerate(words) if w[-1] not in _DIGITS and not w[0].isalpha() and len(self._parts(w)) > 1]:
            begins = begins + np.searchsorted(glued, begins)
            tokens: list[str] = []
            done = 0
            for i in glued:
                tokens += words[done:i]
                tokens += self._parts(words[i])
                done = i + 1
            words, place = tokens + words[done:], np.sort(np.concatenate([place, np.asarray(glued)]))
        at_start, elsewhere, plain, ends = zip(*map(self.__getitem__, words))
        first = np.zeros(len(words) + 1, bool)
        first[1:] = ends
        first[begins] = True
        kind = np.where(first[:-1], np.asarray(at_start, np.int8), np.asarray(elsewhere, np.int8))
        hashes = np.asarray(plain, np.uint64)
        template = hashes.copy()
        for k, mark in _PLACEHOLDER.items():
            template[kind == k] = mark
        return place, kind, template, hashes


def _named(kind: np.ndarray, template: np.ndarray) -> np.ndarray:
    """The template with capitalised words at starts as names, too."""
    return np.where(kind == START, np.uint64(_PLACEHOLDER[NAME]), template)


def _consistent(slots: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> Iterator[tuple[int, int]]:
    """The longest stretches in which each slot value of the item always stands for the same one in the text, and back.

    Word-for-word stretches are among or inside them. They may overlap: a run is cut on either side of a clash.
    """
    forth: dict[int, list[int]] = {}  # value -> [its counterpart, how often in the stretch]
    back: dict[int, list[int]] = {}
    places = np.nonzero(slots)[0].tolist()
    pairs = list(zip(theirs[slots].tolist(), mine[slots].tolist()))
    start = left = 0
    for at, (a, b) in zip(places, pairs):
        fits = lambda: forth.get(a, (b,))[0] == b and back.get(b, (a,))[0] == a
        if not fits():
            yield start, at
            while not fits():
                for table, key in zip((forth, back), pairs[left]):
                    table[key][1] -= 1
                    if not table[key][1]:
                        del table[key]
                start = places[left] + 1
                left += 1
        forth.setdefault(a, [b, 0])[1] += 1
        back.setdefault(b, [a, 0])[1] += 1
    yield start, len(mine)


class _Finder:
    """Joins the windows of texts with the windows of the items, extends matches along both, and checks slots."""

    def __init__(self, items: list[tuple[int, str]], window: int, least: int):
        self.window, self.least, self.canon = window, least, Canon()
        self.parsed = [(item, *self.canon.of(text)) for item, text in items]
        keys, self.where = [np.empty(0, np.uint64)], []
        self.short: dict[int, dict[int, list[int]]] = {}  # length -> hash of all words -> items
        for i, (_, place, kind, template, own) in enumerate(self.parsed):
            if len(own) < window:
                if len(own) >= SHORTEST:
                    self.short.setdefault(len(own), {}).setdefault(int(gram_hashes(own, len(own))[0]), []).append(i)
                continue
            plain = np.convolve((kind == LITERAL) | (kind == START), np.ones(window, int), "valid") >= LITERALS
            seen = set()
            for found, kept in ((template, plain), (_named(kind, template), plain), (own, np.ones(len(plain), bool))):
                for at, key in zip(np.nonzero(kept)[0].tolist(), gram_hashes(found, window)[kept].tolist()):
                    if (at, key) not in seen:
                        seen.add((at, key))
                        self.where.append((i, at))
                        keys.append(np.asarray([key], np.uint64))
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.where = keys[order], [self.where[i] for i in order.tolist()]
        # one bit for each value of the lower 22 bits: most windows are turned away by one look-up
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self._low(self.keys)] = True

    @staticmethod
    def _low(keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64((1 << 22) - 1)).astype(np.int64)

    def passages(self, text: str) -> Iterator[tuple]:
        """(item, first word here, first word there, words, coverage, changed slots)."""
        place, kind, template, plain = self.canon.of(text)
        for length, known in self.short.items():
            grams = gram_hashes(plain, length)
            for at in np.nonzero(np.isin(grams, np.fromiter(known, np.uint64, len(known))))[0].tolist():
                for i in known[int(grams[at])]:
                    words = int(place[at + length - 1] - place[at]) + 1
                    yield self.parsed[i][0], int(place[at]), 0, words, 1.0, 0
        grams = np.stack([gram_hashes(x, self.window) for x in (template, _named(kind, template), plain)])
        at, which = np.nonzero(self.sieve[self._low(grams)].T)
        if not len(at):
            return
        found = grams[which, at]
        lo, hi = (np.searchsorted(self.keys, found, side).tolist() for side in ("left", "right"))
        caps = (kind == NAME) | (kind == START)
        done: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the run that was looked at
        for at, a, b in zip(at.tolist(), lo, hi):
            for i, there in self.where[a:b]:
                if done.get((i, at - there), -1) > at:
                    continue
                item, places, kinds, t, p = self.parsed[i]
                k = min(at, there)
                n = min(len(template) - at, len(t) - there) + k
                x, y = slice(at - k, at - k + n), slice(there - k, there - k + n)
                named = caps[x] & ((kinds[y] == NAME) | (kinds[y] == START))
                equal = np.concatenate([[False], (template[x] == t[y]) | (plain[x] == p[y]) | named, [False]])
                breaks = np.nonzero(~equal)[0]
                end = int(breaks[np.searchsorted(breaks, k + 1)]) - 1
                start = int(breaks[np.searchsorted(breaks, k + 1) - 1])
                first, theirs, length = at - k + start, there - k + start, end - start
                done[i, at - there] = max(first + length, at + 1)
                mine, other = plain[first : first + length], p[theirs : theirs + length]
                slots = (kind[first : first + length] != LITERAL) | (mine != other)
                total = int(places[-1]) + 1
                for u, v in _consistent(slots, mine, other):
                    if v <= u:
                        continue
                    words = int(places[theirs + v - 1] - places[theirs + u]) + 1
                    if words >= min(self.least, total):
                        yield item, int(place[first + u]), int(places[theirs + u]), words, words / total, int((mine != other)[u:v].sum())


def _passages(items: list[tuple[int, str]], window: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(items, window, least)
        names = ["doc_id", "item_id", "text_word", "item_word", "words", "coverage", "changed_slots"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        for batch in batches:
            out = [(doc_id, *x) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in finder.passages(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return run


_SCHEMA = "doc_id long, item_id long, text_word long, item_word long, words long, coverage double, changed_slots long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """Passages of texts that repeat a benchmark item, word for word or with other names, numbers and units.

    Both sides become templates: numbers, units and names (capitalised words inside a sentence) turn into typed
    placeholders, other words lose their case and outer punctuation, and a unit attached to a number is a word of its
    own. A capitalised word that starts a sentence may be a name or not: both readings are tried. Windows of
    ``window`` template words with at least five plain ones, and all windows of the words themselves, are hash-joined;
    a match is extended as far as both templates agree, and cut where its slots clash: one value of the item always
    stands for one value of the text, and back. A passage, the longest stretch without a clash, counts if it runs
    over ``least_words`` words, or the whole of a shorter item. Passages on two sides of a clash may overlap. Items under
    ``window`` words are matched whole and word for word, case and outer punctuation aside; those of one or two words
    match nothing.

    Returns a row for each passage: ``doc_id, item_id``, its first word on both sides, its length, the share of the
    item and the number of slots with another value. Null or empty texts and items hold no passage. Rows with a null
    id are searched as any other. Repeated rows give repeated passages. Empty tables give no rows. Other columns are not read.

    The texts are read in one pass without a shuffle. The item side is a broadcast hash table of at most
    ``PASS_WORDS`` words; the driver counts the benchmark's words first and a larger one takes several passes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for part in _parts(benchmark, item_col):
        found = rows.mapInArrow(released(_passages(part, window, least_words)), _SCHEMA)
        out = found if out is None else out.union(found)
    return out


def _parts(benchmark: DataFrame, item_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in parts of about ``PASS_WORDS`` words; one empty part if there is none."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    part, held = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        part.append((r["item_id"], r["text"]))
        held += len(r["text"].split())
        if held >= PASS_WORDS:
            yield part
            part, held = [], 0
    if part or not held:
        yield part


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs without a passage that ``find_leaks`` finds, all columns unchanged, in the same pass.

    Null and empty texts stay, null ids are searched like others, repeated rows have one fate, and an empty table on
    either side drops nothing. Columns keep their names, whatever they are.
    """
    place, schema = docs.columns.index(text_col), docs.schema

    def clean(part: list[tuple[int, str]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _Finder(part, window, least_words)
            for batch in batches:
                yield batch.filter(pa.array([next(finder.passages(t or ""), None) is None for t in batch.column(place).to_pylist()], pa.bool_()))

        return run

    small_batches(docs.sparkSession)
    for part in _parts(benchmark, item_col):
        docs = docs.mapInArrow(released(clean(part)), schema)
    return docs


def op2_template_decontamination(spark, sf_dir: str) -> DataFrame:
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("passages"), F.max("words").alias("longest"), F.max("coverage").alias("coverage"), F.min("changed_slots").alias("changed_slots")
    )
