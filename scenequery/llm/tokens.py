"""Token-id output: Arrow IPC files of equal-length sequences, and their reader.

Documents are put in ascending doc_id order (ties: text; nulls first) over range
partitions, encoded, closed by an end id, and packed without gaps into rows of
`seq_len` ids.  A partition writes one Arrow IPC file whose record batches hold
`batch_rows` rows of two fixed-size lists: input_ids (uint16 where the
vocabulary fits, else uint32) and mask (bit-packed, false only behind the last id of a file).  All
batches but the last have the same shape, so sequence i is row i % batch_rows
of batch i // batch_rows: a memory-mapped file gives it without a copy.
Beside each file lies an index file (doc_id, start in the file, n_tokens).
A task writes under a name of its own and its manifest row names the file, so
that a repeated task leaves no half-written file in the result.

Encoding goes word by word through a bounded cache: the tokenizer must lower
case, drop white space, never join ids across it, and part letters from
punctuation (checked by the tests for the vocabulary used here); texts are cut
at spaces and line feeds only.

Defined results: a null or empty text is the end id alone; a null doc_id is
kept and sorts first; repeated rows are written each; an empty table writes no
file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenequery.llm.common import materialise, shared_dir

#: Ids of a sequence, sequences of a batch, words that a worker remembers, longest word that it remembers.
SEQ_LEN, BATCH_ROWS, CACHE_WORDS, CACHE_CHARS = 2048, 64, 900_000, 40
#: Characters that are split into words at a time, longest word that is kept once the cache is full; a character that parts words in one call.
SLICE_CHARS, SHORT, MARK = 500_000, 8, "\x01"

MANIFEST = "part int, path string, index_path string, n_docs bigint, n_tokens bigint, seq_len int"


class Encoder:
    """Text -> little-endian ids, through the library, word by word."""

    def __init__(self, tokenizer_json: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.most, self.cache = cache_words, {}
        self.marks = {m: self._ids(m) for m in ",."}
        self.mark = self.tok.encode(MARK, add_special_tokens=False).ids

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode many words in one call, with a mark between them whose single id no other text gives."""
        cache = self.cache
        alone = [w for w in words if MARK in w] if len(self.mark) == 1 else words
        words = [w for w in words if MARK not in w] if len(self.mark) == 1 else []
        cache.update((w, self._ids(w)) for w in alone)
        for i in range(0, len(words), 1 << 13):
            some = words[i : i + (1 << 13)]
            ids = np.array(self.tok.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = [*(np.flatnonzero(ids == self.mark[0]) * ids.itemsize).tolist(), ids.nbytes]
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                cache[w] = raw[start:end]
                start = end + ids.itemsize

    def end_task(self, words: int) -> None:
        """Between tasks, keep no more than the last one had use for."""
        if len(self.cache) > words:
            self.cache = {}
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):  # give the memory back, where the C library can
                ctypes.CDLL(None).malloc_trim(0)

    def trim(self, most: int) -> None:
        """Keep short words only, and none if they are too many."""
        if len(self.cache) > most:
            self.cache = {w: x for w, x in self.cache.items() if len(w) <= SHORT}
            if len(self.cache) > most:
                self.cache = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, some, chars = [], [], 0
        for t in texts:
            some.append(t or "")
            chars += len(some[-1])
            if chars > SLICE_CHARS:
                out += self._encode(some)
                some, chars = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        # The vocabulary is lower case; special tokens, which hold "<|", are matched before that.
        split = [(t if "<|" in t else t.encode().lower().decode()).replace("\n", " ").split(" ") for t in texts]
        if len(self.cache) > self.most:  # short words come back the most
            self.trim(self.most // 2)
        cache, new = self.cache, set()
        cache[""] = b""
        for words in split:
            new.update(words)
        new = new.difference(cache)
        # A full stop or comma behind a letter ends a word for the library too.
        base = {w: w[:-1] for w in new if w[-1] in self.marks and w[-2:-1].isalpha()}
        self._learn(sorted({base.get(w, w) for w in new}.difference(cache)))
        cache.update((w, cache[b] + self.marks[w[-1]]) for w, b in base.items())
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        if new and len(max(new, key=len)) > CACHE_CHARS:
            for w in new.union(base.values()):
                if len(w) > CACHE_CHARS:
                    cache.pop(w, None)
        return out


def encoder_of(tokenizer_json: str) -> Encoder:
    """This process's encoder: a worker that runs several tasks keeps what it has learnt."""
    held = sys.modules.setdefault("_scenequery_encoders", types.ModuleType("_scenequery_encoders")).__dict__
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in held:
        held[key] = Encoder(tokenizer_json)
    return held[key]


class SequenceWriter:
    """Packs ids into equal-length sequences of one Arrow IPC file."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS):
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out, self.dtype, self.seq_len, self.full = pa.ipc.new_file(sink, self.schema), dtype, seq_len, seq_len * batch_rows
        self.held, self.n = bytearray(), 0

    def add(self, ids: bytes) -> None:
        self.held += ids
        self.n += len(ids) // self.dtype.itemsize
        size = self.full * self.dtype.itemsize
        while len(self.held) >= size:
            self._put(bytes(self.held[:size]), self.full)
            del self.held[:size]

    def _put(self, ids: bytes, used: int) -> None:
        n = len(ids) // self.dtype.itemsize
        mask = pa.array(np.arange(n) < used)
        values = pa.array(np.frombuffer(ids, self.dtype))
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(v, self.seq_len) for v in (values, mask)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            used = len(self.held) // self.dtype.itemsize
            pad = -used % self.seq_len
            self._put(bytes(self.held) + bytes(pad * self.dtype.itemsize), used)
        self.out.close()


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(folder: str, tokenizer_json: str, end_id: int, seq_len: int):
    def run(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder, part = encoder_of(tokenizer_json), TaskContext.get().partitionId()
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        end = np.array([end_id], encoder.dtype).tobytes()
        ids, starts, counts = [], [], []
        with fs.open_output_stream(f"{root}/{name}.arrow") as sink:
            writer = SequenceWriter(sink, encoder.dtype, seq_len)
            batch = first
            while batch is not None:
                for doc_id, got in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                    ids.append(doc_id)
                    starts.append(writer.n)
                    writer.add(got)
                    writer.add(end)
                    counts.append(writer.n - starts[-1])
                batch = next(batches, None)
            writer.close()
        encoder.end_task(writer.n)
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with fs.open_output_stream(f"{root}/{name}.index.arrow") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}.arrow", "index_path": f"{folder}/{name}.index.arrow", "n_docs": len(ids), "n_tokens": writer.n, "seq_len": seq_len}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("seq_len", pa.int32())]))

    return run


def write(docs: DataFrame, tokenizer_json: str, end_id: int, folder: str | None = None, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write docs(doc_id, text); the manifest has a row per file, in doc_id order by part."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    x = x.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(x.mapInArrow(_write(folder, tokenizer_json, end_id, seq_len), MANIFEST), "tokens-manifest")


def open_sequences(uri: str):
    """The Arrow file of uri, memory-mapped where it is local."""
    fs, path = _fs(uri)
    return pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))


def sequence(file, i: int, batch_rows: int = BATCH_ROWS):
    """Sequence i of an open file: ids as a NumPy view, and the mask (an Arrow array)."""
    row = i % batch_rows
    batch = file.get_batch(i // batch_rows)
    ids, mask = batch.column(0), batch.column(1)
    n = ids.type.list_size
    return ids.values.slice((ids.offset + row) * n, n).to_numpy(zero_copy_only=True), mask.values.slice((mask.offset + row) * n, n)


def _read(batches):
    for batch in batches:
        for path, index_path, offset in zip(*(batch.column(i).to_pylist() for i in range(3))):
            index = open_sequences(index_path).read_all()
            counts, file = index["n_tokens"].to_numpy(), open_sequences(path)
            crcs, held, k = np.zeros(len(counts), np.int64), 0, 0
            left, crc = int(counts[0]) if len(counts) else 0, 0
            for b in range(file.num_record_batches):
                got = file.get_batch(b)
                ids = got.column(0).values.to_numpy(zero_copy_only=True)
                ids = ids[: int(np.count_nonzero(got.column(1).values.to_numpy(zero_copy_only=False)))].astype("<u4")
                held = 0
                while held < len(ids):
                    n = min(left, len(ids) - held)
                    crc = zlib.crc32(ids[held : held + n], crc)
                    held, left = held + n, left - n
                    if not left:
                        crcs[k], crc, k = crc, 0, k + 1
                        left = int(counts[k]) if k < len(counts) else 0
                        if k == len(counts):
                            break
            yield from pa.table({"doc_id": index["doc_id"].combine_chunks(), "start": pa.array(index["start"].to_numpy() + offset), "n_tokens": index["n_tokens"].combine_chunks(), "ids_crc32": pa.array(crcs)}).to_batches(max_chunksize=10_000)


def read(manifest: DataFrame) -> DataFrame:
    """A row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running sum goes over one row per file, not per document.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", "index_path", before.alias("offset"))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "path").mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
