"""Token ids of whole texts in binary files of patched frame-of-reference blocks."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, released, scratch_path, small_batches, worker_state
from .pfor import chunks as chunks_of
from .pfor import encode_chunk

END_ID = 0
CHUNK_IDS = 1 << 20
CHUNKS_A_FILE = 16
#: Most pieces of text whose ids a worker remembers, at some 350 bytes each.
PIECES = 400_000


def by_pieces(tokenizer_json: str) -> bool:
    """Whether texts may be encoded piece by piece: a byte-level BPE whose pre-tokenizer parts words at their spaces."""
    made = json.loads(tokenizer_json)
    own, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    return (
        own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space") and not made.get("normalizer")
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Places(dict):
    """piece -> place in the table; a new piece gets the next place and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        value = self[piece] = len(self)
        self.new.append(piece)
        return value


def _gather(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ids that start at starts, one after the other."""
    ends = np.cumsum(counts)
    return ids[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, which sees a space-led piece once as long as the table holds it.

    The vocabulary's pre-tokenizer ends a token at a space that stands between two characters that are no white
    space, so " piece" is encoded alike wherever it stands; and a run of stops after a letter or number is a token run of
    its own. New pieces go to the library together, as one text: an id that starts with a space starts a
    piece. Texts in which some piece is empty, or begins or ends with white space, or holds a special token, go to the
    library whole, as do all texts of a tokenizer of another kind (see ``by_pieces``). When the table is full, the pieces
    that were met least often leave it.
    """

    STOPS = ".,;:!?"

    def __init__(self, tokenizer_json: str, most: int = PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # its own table of words is no use beside this one
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.apart = most, by_pieces(tokenizer_json)
        self._empty()

    def _empty(self) -> None:
        self.places = _Places()
        self.ids, self.used = np.empty(1 << 16, "<u4"), 0
        self.starts, self.counts = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.met = np.empty(0, np.int64)
        self.hot: dict[str, int] = {}
        self.turns = 0

    def _warm(self, most: int = 16_384) -> None:
        """A small table of the commonest pieces: it stays in a core's cache and answers most look-ups."""
        keys = list(self.places)
        top = np.argpartition(self.met, len(keys) - most)[len(keys) - most :] if len(keys) > most else range(len(keys))
        self.hot = {keys[i]: int(i) for i in top}

    def _shrink(self) -> None:
        """Keep the pieces that were met most often, at most half of the table."""
        places, ids, starts, counts, met = self.places, self.ids, self.starts, self.counts, self.met
        least = max(2, int(np.partition(met, len(met) - self.most // 2)[len(met) - self.most // 2]) + 1)
        stay = (met >= least) & (counts[: len(met)] >= 0)
        pieces = [p for p, own in zip(places, stay.tolist()) if own]
        old = np.nonzero(stay)[0]
        held = counts[old]
        flat = _gather(ids, starts[old], held)
        self._empty()
        self.places.update(zip(pieces, range(len(pieces))))
        self._put(np.arange(len(pieces)), flat, held)
        self.met = met[old] // 2

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _put(self, places: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Append the ids of these places; a count of -1 marks a piece that isn't encoded apart."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.places) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.counts))
        self.ids[self.used : self.used + len(ids)] = ids
        held = np.maximum(counts, 0)
        self.starts[places] = self.used + np.cumsum(held) - held
        self.counts[places] = counts
        self.used += len(ids)

    def _learn(self, pieces: list[str], at: np.ndarray) -> None:
        """Encode pieces without white space at their ends and put them in their places."""
        for i in range(0, len(pieces), 256):
            part = pieces[i : i + 256]
            ids = self._whole([" " + " ".join(part)])[0]
            starts = np.nonzero(self.leads[ids])[0]
            if len(starts) == len(part):
                self._put(at[i : i + 256], ids, np.diff(starts, append=len(ids)))
            else:  # some piece has an id that starts with a space inside
                found = self._whole([" " + p for p in part])
                self._put(at[i : i + 256], np.concatenate(found), np.asarray([len(x) for x in found]))

    def _settle(self) -> None:
        """Give every new piece its ids. New pieces have the last places, in order."""
        places, new = self.places, self.places.new
        letters = np.fromiter(map(str.isalpha, new), bool, len(new))
        base = len(places) - len(new)
        self._learn(list(compress(new, letters)), base + np.nonzero(letters)[0])
        plain, odd, stopped = [], [], []
        for p in compress(new, ~letters):
            if not p or p[0].isspace() or p[-1].isspace():
                odd.append(p)
                continue
            stem = p.rstrip(self.STOPS)
            if stem and stem != p and stem[-1].isalnum():
                stopped.append((p, stem, p[len(stem) :]))
            else:
                plain.append(p)
        places.new = []
        for _, stem, _ in stopped:
            places[stem]  # noqa: B018  a stem that is new gets its place here
        plain += places.new
        places.new = []
        self._learn(plain, np.fromiter(map(places.__getitem__, plain), np.int64, len(plain)))
        if odd:
            self._put(np.asarray([places[p] for p in odd]), np.empty(0, "<u4"), np.full(len(odd), -1))
        if stopped:
            runs = {r: i for i, r in enumerate({r for *_, r in stopped})}
            after = self._whole(list(runs))
            size = np.asarray([len(x) for x in after])
            pool = np.concatenate([self.ids[: self.used], *after])
            stem = np.fromiter((places[s] for _, s, _ in stopped), np.int64, len(stopped))
            run = np.fromiter((runs[r] for *_, r in stopped), np.int64, len(stopped))
            counts = np.stack([self.counts[stem], size[run]], 1)
            starts = np.stack([self.starts[stem], (self.used + np.cumsum(size) - size)[run]], 1).ravel()
            self._put(np.fromiter((places[p] for p, *_ in stopped), np.int64, len(stopped)), _gather(pool, starts, counts.ravel()), counts.sum(1))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of every text."""
        if not self.apart:
            return self._whole(texts)
        if len(self.places) > self.most:
            self._shrink()
        split = [None if any(s in t for s in self.special) else t.split(" ") for t in texts]
        lengths = [len(x) - 1 if x else 0 for x in split]
        flat = [p for x in split if x for p in x[1:]]
        at = np.fromiter(map(self.hot.get, flat, repeat(-1)), np.int64, len(flat))
        rare = np.nonzero(at < 0)[0]
        at[rare] = np.fromiter(map(self.places.__getitem__, [flat[i] for i in rare.tolist()]), np.int64, len(rare))
        self._settle()
        met = np.bincount(at, minlength=len(self.places))
        met[: len(self.met)] += self.met
        self.met = met
        self.turns += 1
        if self.turns in (2, 8) or self.turns % 32 == 0:
            self._warm()
        counts = self.counts[at]
        ends = np.cumsum([0, *lengths])
        # a text is encoded by pieces if none of them is odd
        odd = np.concatenate([[0], np.cumsum(counts < 0)])
        apart = [x is not None and bool(x[0]) and not x[0][-1].isspace() and odd[a] == odd[b] for x, a, b in zip(split, ends, ends[1:])]
        counts = np.maximum(counts, 0)
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = _gather(self.ids, self.starts[at], counts)
        firsts = iter(self._whole([x[0] for x, own in zip(split, apart) if own]))
        whole = iter(self._whole([t for t, own in zip(texts, apart) if not own]))
        return [np.concatenate([next(firsts), ids[upto[a] : upto[b]]]) if own else next(whole) for own, a, b in zip(apart, ends, ends[1:])]


def _encoder(tokenizer_json: str, end_id: int, pieces: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"token pieces {pieces} {zlib.crc32(tokenizer_json.encode())}"
        encoder, end = worker_state(key, lambda: PieceEncoder(tokenizer_json, pieces)), np.asarray([end_id], "<u4")
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0

        def chunk() -> pa.RecordBatch:
            data = encode_chunk(docs, [len(x) for x in ids], np.concatenate(ids))
            ids.clear()
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["chunk"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, found in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    ids.append(np.concatenate([found, end]))
                    docs.append(doc_id)
                    held += len(ids[-1])
                    if held >= CHUNK_IDS:
                        held = 0
                        yield chunk()
        if docs:
            yield chunk()

    return run


def write_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, pieces: int = PIECES) -> None:
    """Encode every whole text, append ``end_id``, and write the ids to binary files under ``path``.

    Documents stand in ascending id order over the files in name order: nulls first, ties in order of the texts'
    64-bit hashes, and repeated rows are documents of their own. Ids must be integers or castable to them; other columns,
    whatever their names, are not read. Each file
    holds at most 16 chunks (see ``pfor``) of about a million ids, so a reader never holds more than some 40 MB;
    a document is never split. Null text is empty and so only ``end_id``. An empty table writes no chunk.

    One range shuffle by (id, text) deals rows evenly, whatever the ids are; the files go through Spark's commit
    protocol, so a task that is run again after a lost executor leaves nothing double. The tokenizer file is read
    on the driver and travels with the tasks (1.5 MB, its size fixed by the vocabulary). ``pieces`` bounds the table of
    pieces that each worker keeps between tasks; it decides about time and memory, never about ids.
    """
    with open(tokenizer or tokenizer_path(), encoding="utf-8") as f:
        run = released(_encoder(f.read(), end_id, pieces))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    chunks = rows.mapInArrow(run, "chunk binary").select(F.col("chunk").cast("string").alias("value"))
    small_batches(docs.sparkSession)
    chunks.write.option("maxRecordsPerFile", CHUNKS_A_FILE).text(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, local start, doc_id, n_tokens, crc) of every document of each file."""
    for batch in batches:
        for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            start, rows = 0, {k: [] for k in ("file", "local", "doc_id", "n", "crc")}
            for chunk in chunks_of(data.as_buffer()):
                raw = memoryview(chunk.ids().astype("<u4").tobytes())
                for k, (null, doc_id, n) in enumerate(chunk.docs.tolist()):
                    a, b = int(chunk.offsets[k]), int(chunk.offsets[k + 1])
                    for name, value in (("file", file), ("local", start + a), ("doc_id", None if null else doc_id), ("n", n), ("crc", zlib.crc32(raw[4 * a : 4 * b]))):
                        rows[name].append(value)
                start += chunk.n_ids
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files under ``path``.

    The files are decoded once, a task each. A file's first place is a running sum over one row a file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    own = F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", 0)
    name = F.concat(F.lpad(F.regexp_extract(own, r"part-(\d+)", 1), 12, "0"), F.lpad(F.regexp_extract(own, r"-c(\d+)$", 1), 12, "0"))
    docs = materialise(files.select(name.alias("file"), "content").mapInArrow(released(_decode), "file string, local long, doc_id long, n long, crc long"), "token-index")
    totals = docs.groupBy("file").agg(F.sum("n").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = docs.join(totals.select("file", before.alias("before")), "file")
    return placed.select("doc_id", (F.col("before") + F.col("local")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op8_token_binary(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path)
