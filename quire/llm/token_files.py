"""Token ids of whole texts in binary files (operator 11).

Documents are dealt out by ranges of their id, so that files in order hold documents in order. Each task encodes its texts and writes one file:

    "QTF1", vocabulary (4 bytes)
    for each block: "B", bytes of the directory and of the ids (4 + 4), crc32 of the directory (4), directory, ids (range_coder.encode)
    "E", documents (8), ids (8), crc32 of these two (4)

The directory, JSON and deflated, lists the pieces of documents in the block: id, number of ids, and whether the document goes on in the next block. A file without its end is torn, and an error.
A manifest, a table in the shared folder, has a row for each file that was written whole, with its path and how many ids all files before it hold.

Files go to any store that pyarrow.fs opens by URI (file, hdfs, s3, gs) under a temporary name and are then moved to their own, so a task that runs again replaces its file by the same bytes.

The library sees each distinct run of letters once a worker: a run whose neighbours are ASCII characters that are neither letters nor, before it, an apostrophe, is encoded alone, and so is what stands between such
runs and ASCII blanks. The tokenizer normalises character by character within such runs and cuts there before it merges, so the ids are those of the whole text. Texts with the first two characters of an added token go
to the library whole. That holds for the tokenizer of the query (runs of letters, digits and others; blanks are dropped); other tokenizers take whole=True, which hands it whole texts.
A run of letters is put in lower case before it's looked up, as far as U+00DE, and goes to the library's model past the normalizer and the pattern, which would change nothing else of it.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import range_coder
from quire.llm.shared import staged
from quire.storage import new_path

BLOCK = 1 << 21  # ids a block
AT_ONCE = 1 << 22  # characters that are encoded at once
KNOWN = 1 << 20  # runs that a worker keeps
END_ID = 2
_START, _BLOCK, _END = struct.Struct("<4sI"), struct.Struct("<cIII"), struct.Struct("<cQQI")
_BLANK, _LETTER, _PLAIN, _QUOTE = 1, 2, 3, 4
_KINDS = np.zeros(256, np.uint8)  # 0: bytes of other characters
_KINDS[:128] = _PLAIN
_KINDS[[ord(c) for c in " \t\n\r"]], _KINDS[ord("'")] = _BLANK, _QUOTE
_KINDS[65:91] = _KINDS[97:123] = _LETTER
_OF_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
_NO_LETTERS = (0xC397, 0xC3B7, 0xC4B0)  # between U+00C0 and U+017F: the signs of times and division, and the one capital that two characters are in lower case
_NO_LETTER_BYTES = tuple(c.to_bytes(2) for c in _NO_LETTERS)
MANIFEST = T.StructType([T.StructField(n, T.StringType() if n == "file" else T.LongType()) for n in ("part", "file", "n_docs", "n_ids", "n_bytes")])


class _Known:
    """Runs and their ids, which lie one after the other."""

    def __init__(self):
        self.numbers, self.ids, self.stops, self.new = {}, np.zeros(0, "<u4"), np.zeros(1, np.int32), []

    def add(self, runs: list[bytes], ids: np.ndarray, stops: np.ndarray) -> None:
        """stops: how many of the ids there are up to the end of each run. The runs are new and distinct."""
        self.numbers.update(zip(runs, range(len(self.numbers), len(self.numbers) + len(runs))))
        self.new.append((ids, stops))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each number begin and those of the last end."""
        if self.new:
            before = np.cumsum([len(self.ids), *(len(ids) for ids, _ in self.new)])
            self.stops = np.concatenate([self.stops, *((stops + b).astype(np.int32) for (_, stops), b in zip(self.new, before))])
            self.ids, self.new = np.concatenate([self.ids, *(ids for ids, _ in self.new)]), []
        return self.ids, self.stops

    def __len__(self) -> int:
        return len(self.numbers)

    def __getitem__(self, run: bytes) -> np.ndarray:
        k, (ids, stops) = self.numbers[run], self.tables()
        return ids[stops[k] : stops[k + 1]]


def _kinds(step) -> list[str]:
    """The steps of a normalizer or a pre-tokenizer that is a sequence."""
    said = json.loads(step.__getstate__()) if step else {}
    return [s["type"] for s in said.get("normalizers", said.get("pretokenizers", []))]


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str, whole: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.whole, self.known = Tokenizer.from_file(path), whole, _Known()
        self.library.no_truncation()
        self.library.no_padding()
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        vocabulary, suffix = self.library.get_vocab(with_added_tokens=True), getattr(self.library.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        if suffix:
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.marks = tuple({t.content[:2] for t in self.library.get_added_tokens_decoder().values()})
        self.of_words = [self.library, self.library]  # for words of ASCII letters, and of others
        if (_kinds(self.library.normalizer), _kinds(self.library.pre_tokenizer)) == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):  # its steps leave words in lower case as they are, but for the signs of bytes
            blanks = pre_tokenizers.WhitespaceSplit()
            self.of_words = [Tokenizer(self.library.model), Tokenizer(self.library.model)]
            self.of_words[0].pre_tokenizer = blanks
            self.of_words[1].pre_tokenizer = pre_tokenizers.Sequence([blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> list[bytes]:
        """Encodes runs of plain letters as words of one text, cut where the ids of ends of words are, and returns the other runs."""
        plain, accented, others = [], [], []
        times, division, dotted = _NO_LETTER_BYTES
        for u in units:
            if u.isalpha():
                plain.append(u)
            else:
                (others if u.translate(None, _OF_LETTERS) or times in u or division in u or dotted in u else accented).append(u)
        for words, model in zip((plain, accented), self.of_words):
            for k in range(0, len(words), 1024):
                some = words[k : k + 1024]
                text = b" ".join(some).decode()
                ids = np.array(model.encode_batch_fast([text if model is self.library else text.lower()], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(self.last.take(ids)) + 1
                if len(stops) != len(some) or stops[-1] != len(ids):  # a tokenizer without such ids
                    others += some
                else:
                    self.known.add(some, ids, stops)
        return others

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        alone = [self.whole or any(m in t for m in self.marks) for t in texts]
        cut, units, upto = _cut(["" if a else t for t, a in zip(texts, alone)])
        if len(self.known) > KNOWN:
            self.known = _Known()
        known = self.known
        numbers = np.fromiter(map(known.numbers.get, units, repeat(-1)), np.int32, len(units))
        new = np.flatnonzero(numbers < 0)
        fresh = [units[k] for k in new.tolist()]
        others = self._learn(fresh)
        for k in range(0, len(others), 4096):  # as words of one input, which is cheaper than an input each
            some = others[k : k + 4096]
            made = self.library.encode([u.decode() for u in some], is_pretokenized=True, add_special_tokens=False)
            known.add(some, np.array(made.ids, "<u4"), np.cumsum(np.bincount(np.array(made.word_ids, np.int64), minlength=len(some))))
        numbers[new] = [known.numbers[u] for u in fresh]
        pool, stops = known.tables()
        first, each = stops.take(numbers), np.diff(stops).take(numbers)
        first, each = first.take(cut), each.take(cut)
        ends = np.cumsum(each, dtype=np.int32)  # a group of texts has fewer ids than bytes, and fewer than 2^31 of these
        where = np.repeat(first - ends + each, each)
        where += np.arange(len(where), dtype=np.int32)
        ids = pool.take(where)
        at = np.concatenate([[0], ends])[upto]
        return [np.frombuffer(self._encoded([t])[0], "<u4") if a else ids[at[k] : at[k + 1]] for k, (t, a) in enumerate(zip(texts, alone))]


def _cut(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The runs of texts: for each run the number of its distinct text, these texts, and how many runs come before each text and after the last. Runs of letters that stand alone are in lower case, as far as U+00DE."""
    raw = [t.encode() for t in texts]
    joined = bytearray(b"\n".join(raw) + b"\n")
    data, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS.tobytes()), np.uint8)
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    lead = lead[~np.isin(data[lead].astype(np.uint16) << 8 | data[lead + 1], _NO_LETTERS)]
    kind[lead] = kind[lead + 1] = _LETTER
    letter = np.concatenate([[False], kind == _LETTER, [False]])
    start, stop = np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(~letter[1:] & letter[:-1])
    before, after = np.where(start > 0, kind[start - 1], _BLANK), kind[np.minimum(stop, len(kind) - 1)]
    clean = ((before == _BLANK) | (before == _PLAIN)) & (after != 0)
    blank = kind == _BLANK
    begins = np.concatenate([[True], blank[:-1]])
    begins[start[clean]] = begins[stop[clean]] = True
    begins &= ~blank
    marked = lead[data[lead] == 0xC3] + 1
    capitals = np.concatenate([np.flatnonzero((data >= 65) & (data <= 90)), marked[data[marked] <= 0x9E]])
    capitals = capitals[clean[np.searchsorted(start, capitals, side="right") - 1]]
    data[capitals] += 32
    at = np.flatnonzero(begins)
    offsets = np.zeros(len(at) + 1, np.int32)
    np.cumsum(np.flatnonzero((blank | begins)[1:] & ~blank[:-1]) + 1 - at, out=offsets[1:])  # by where each run ends; the last byte is a blank
    runs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])]).dictionary_encode()
    ends = np.cumsum([len(r) + 1 for r in raw])
    return runs.indices.to_numpy(), runs.dictionary.to_numpy(zero_copy_only=False).tolist(), np.searchsorted(at, np.concatenate([[0], ends]))


@cache
def _encoder(path: str, whole: bool) -> Encoder:
    return Encoder(path, whole)


def _store(uri: str):
    """The file system of a URI or a local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*:", uri) else (fs.LocalFileSystem(), uri)


class _Writer:
    """One file; pieces of documents are gathered until a block is full."""

    def __init__(self, uri: str, vocabulary: int, block: int):
        self.store, self.path = _store(uri)
        folder, _, name = self.path.rpartition("/")
        self.store.create_dir(folder, recursive=True)
        self.made = f"{folder}/_{name}-{uuid.uuid4().hex}"
        self.out, self.vocabulary, self.block = self.store.open_output_stream(self.made), vocabulary, block
        self.out.write(_START.pack(b"QTF1", vocabulary))
        self.pieces, self.ids, self.held, self.n_docs, self.n_ids, self.n_bytes = [], [], 0, 0, 0, _START.size

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_docs, self.n_ids, at = self.n_docs + 1, self.n_ids + len(ids), 0
        while True:
            part = ids[at : at + self.block - self.held]
            at += len(part)
            self.pieces.append((doc_id, len(part), at < len(ids)))
            self.ids.append(part)
            self.held += len(part)
            if self.held == self.block:
                self.flush()
            if at == len(ids):
                return

    def flush(self) -> None:
        directory = zlib.compress(json.dumps(self.pieces).encode(), 1)
        coded = range_coder.encode(np.concatenate(self.ids), self.vocabulary)
        self.n_bytes += self.out.write(_BLOCK.pack(b"B", len(directory), len(coded), zlib.crc32(directory)) + directory + coded)
        self.pieces, self.ids, self.held = [], [], 0

    def close(self) -> None:
        if self.pieces:
            self.flush()
        self.n_bytes += self.out.write(_END.pack(b"E", self.n_docs, self.n_ids, zlib.crc32(struct.pack("<QQ", self.n_docs, self.n_ids))))
        self.out.close()
        self.store.move(self.made, self.path)


def blocks(uri: str) -> Iterator[tuple[list, np.ndarray]]:
    """The blocks of a file in order: pieces (id, number of ids, whether it goes on) and ids. ValueError if the file is torn or changed."""
    store, path = _store(uri)
    with store.open_input_stream(path) as source:

        def read(n: int) -> bytes:
            got = source.read(n)
            if len(got) != n:
                raise ValueError(f"{uri} is torn")
            return got

        if read(_START.size)[:4] != b"QTF1":
            raise ValueError(f"{uri} holds no token ids")
        n_docs = n_ids = 0
        while (kind := read(1)) == b"B":
            _, long_directory, long_ids, crc = _BLOCK.unpack(kind + read(_BLOCK.size - 1))
            directory = read(long_directory)
            if zlib.crc32(directory) != crc:
                raise ValueError(f"the directory of a block of {uri} does not match its checksum")
            pieces, ids = json.loads(zlib.decompress(directory)), range_coder.decode(read(long_ids))
            n_docs, n_ids = n_docs + sum(not more for _, _, more in pieces), n_ids + len(ids)
            yield pieces, ids
        if kind != b"E":
            raise ValueError(f"{uri} is changed")
        _, docs, total, crc = _END.unpack(kind + read(_END.size - 1))
        if (docs, total) != (n_docs, n_ids) or crc != zlib.crc32(struct.pack("<QQ", docs, total)):
            raise ValueError(f"the end of {uri} does not match its blocks")


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some AT_ONCE characters."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= AT_ONCE:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, whole: bool = False, block: int = BLOCK, files: int | None = None) -> DataFrame:
    """Writes the ids of all documents, in ascending order of their id, and returns the manifest: part, file, n_docs, n_ids, n_bytes, start.

    tokenizer: path of a tokenizers file, the same on each executor. folder: a URI that all executors reach; by default a new one in the shared folder. A null text is empty and has the end id alone; a null id comes
    first. files: as many at most; by default as the shuffle has partitions. Rows with the same id all stay, those of one text beside each other; a group of them is spread over files, since text and row number also deal out. Other columns play no part. An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("row")]
    rows = rows.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order).select("id", "text")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, out = _encoder(tokenizer, whole), TaskContext.get().partitionId(), None
        name = f"{folder}/part-{part:06d}.qtf"
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            texts = texts.to_pylist()
            for start, stop in _groups(texts):
                out = out or _Writer(name, max(encode.vocabulary, (end_id or 0) + 1), block)
                for doc_id, coded in zip(ids.slice(start, stop - start).to_pylist(), encode(texts[start:stop])):
                    out.add(doc_id, np.concatenate([coded, tail]))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [out.n_docs], "n_ids": [out.n_ids], "n_bytes": [out.n_bytes]})

    manifest = staged(rows.mapInArrow(written, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def _each_file(manifest: DataFrame) -> DataFrame:
    """A task for each file, as far as there are partitions."""
    files = staged(manifest.select("part", "file", "start"), "token-starts")
    return files.repartition(max(1, files.count()), "part")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, piece, start, ids (array): what the files hold, a row for each piece of a document in a block; start counts all ids before the piece."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for file, start in zip(rows["file"], rows["start"]):
                piece = 0
                for pieces, ids in blocks(file):
                    at, out = 0, []
                    for doc_id, n, more in pieces:
                        out.append((doc_id, piece, start + at, ids[at : at + n].astype(np.int64)))
                        at, piece = at + n, piece + 1 if more else 0
                    start += at
                    made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "ids"])
                    yield made.astype({"doc_id": "Int64"})

    return _each_file(manifest).mapInPandas(read, "doc_id long, piece int, start long, ids array<long>")


def documents_of(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of all ids of the document as little-endian unsigned 32-bit integers), read from the files block by block."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for file, start in zip(rows["file"], rows["start"]):
                n = crc = 0
                for pieces, ids in blocks(file):
                    at, out = 0, []
                    for doc_id, size, more in pieces:
                        crc, n, at = zlib.crc32(ids[at : at + size], crc), n + size, at + size
                        if not more:
                            out.append((doc_id, start, n, crc))
                            start, n, crc = start + n, 0, 0
                    made = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                    yield made.astype({"doc_id": "Int64"})

    return _each_file(manifest).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
