"""Token-ID output: Arrow stream files of fixed-size-list batches.

Documents are range-partitioned by ``doc_id``; each task writes its stream of ids as one file of
equal-length sequences (``ids``: fixed-size list of unsigned integers as wide as the vocabulary
needs, ``mask``: fixed-size list of booleans, false on the padding of the last sequence) and one
file with an index (doc_id, start, n_tokens).  Local files are memory-mapped: ``TokenFile.sequence(i)`` is a
slice of the values buffer of one batch, without copying.

A file's name has the task attempt in it and is in the manifest only if that attempt was committed,
so a lost executor's half-written file is never read.

Edge cases: a null or empty text is the end id alone; rows with a null doc_id come first, as Spark
sorts; a repeated doc_id is encoded for each of its rows, in no fixed order among them; an empty
table gives no files and no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import each_text, staged, texts_of
from rankspark.llm.encode import encoder, vocabulary
from rankspark.session import scratch_dir

END_ID = 2
SEQUENCE = 2048      # ids in a sequence
BATCH = 256          # sequences in an Arrow batch
MANIFEST = "file int, path string, index_path string, n_docs long, n_tokens long"


def _open_fs(uri: str):
    """A file system and path for a folder of any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _SequenceWriter:
    """Cuts a stream of ids into sequences; memory is one batch, however long a document is."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.kind = pa.from_numpy_dtype(dtype)
        self.length, self.held, self.size, self.total = length, [], 0, 0
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.dtype, self.out = dtype, pa.ipc.new_stream(sink, self.schema)

    def add(self, packed: bytes) -> int:
        ids = np.frombuffer(packed, self.dtype)
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.length * BATCH:
            self._write(self.size // self.length)
        return len(ids)

    def _write(self, rows: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        now, later = flat[: rows * self.length], flat[rows * self.length:]
        self.held, self.size = [later] if len(later) else [], len(later)
        for at in range(0, len(now), self.length * BATCH):
            part = now[at: at + self.length * BATCH]
            self._batch(part, np.ones(len(part), bool))

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._write(self.size // self.length)
        if self.size:
            ids, mask = np.zeros(self.length, self.dtype), np.zeros(self.length, bool)
            ids[: self.size], mask[: self.size] = np.concatenate(self.held), True
            self._batch(ids, mask)
        self.out.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json",
                      end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Write the files below ``folder`` and return their manifest, a row for each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary(tokenizer))
        end = np.asarray([end_id], coder.dtype).tobytes()
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{base}/ids-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer, index, n_docs = None, None, 0
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for keys, texts in each_text(batches):
            if writer is None:
                sinks = fs.open_output_stream(f"{name}.arrow"), fs.open_output_stream(f"{name}.index.arrow")
                writer, index = _SequenceWriter(sinks[0], coder.dtype, length), pa.ipc.new_stream(sinks[1], kinds)
            start, counts = writer.total, [writer.add(coder.ids(t) + end) for t in texts]
            n_docs += len(keys)
            starts = start + np.cumsum([0, *counts[:-1]])
            index.write_batch(pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=kinds))
        if writer is None:
            return
        writer.close()
        index.close()
        for sink in sinks:
            sink.close()
        yield pa.RecordBatch.from_pydict({
            "file": pa.array([task.partitionId()], pa.int32()), "path": [f"{name}.arrow"],
            "index_path": [f"{name}.index.arrow"], "n_docs": pa.array([n_docs], pa.int64()),
            "n_tokens": pa.array([writer.total], pa.int64())})

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return staged(ordered.mapInArrow(write, MANIFEST))


class TokenFile:
    """One file, opened: sequences by number and runs of ids, all views of the Arrow buffers.

    A local file is memory-mapped, so that opening it reads the heads of its batches alone; files of other
    stores are held in memory as they are.  Nothing is joined or copied.
    """

    def __init__(self, fs, path: str):
        from pyarrow import fs as arrow_fs

        source = pa.memory_map(path) if isinstance(fs, arrow_fs.LocalFileSystem) else fs.open_input_file(path)
        with pa.ipc.open_stream(source) as stream:
            self.length = stream.schema.field("ids").type.list_size
            self.dtype = np.dtype(stream.schema.field("ids").type.value_type.to_pandas_dtype())
            self.batches = list(stream)
        #: Number of the first sequence of each batch, and of all sequences.
        self.firsts = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.firsts[-1])

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence ``i``; an IndexError if there is none."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.firsts, i, side="right")) - 1
        ids, mask = (self.batches[k].column(c)[i - int(self.firsts[k])].values for c in ("ids", "mask"))
        return ids.to_numpy(), mask

    def n_tokens(self) -> int:
        """Ids under the masks."""
        return sum(pc.sum(b.column("mask").flatten()).as_py() or 0 for b in self.batches)

    def parts(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """The ids from place ``start`` to ``stop`` of the file, batch by batch."""
        k = int(np.searchsorted(self.firsts, start // self.length, side="right")) - 1
        while start < stop:
            flat, before = self.batches[k].column("ids").flatten(), int(self.firsts[k]) * self.length
            part = flat.slice(start - before, stop - start).to_numpy()
            yield part
            start, k = start + len(part), k + 1


def _checksum(parts: Iterator[np.ndarray]) -> int:
    crc = 0
    for ids in parts:
        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
    return crc


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                held = TokenFile(fs, row["path"])
                if (n := held.n_tokens()) != row["n_tokens"]:
                    raise ValueError(f"{row['path']} has {n} ids, its manifest {row['n_tokens']}")
                with fs.open_input_file(row["index_path"]) as source:
                    for part in pa.ipc.open_stream(source):
                        starts, counts = (part.column(c).to_numpy() for c in ("start", "n_tokens"))
                        sums = [_checksum(held.parts(a, a + n)) for a, n in zip(starts.tolist(), counts.tolist())]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": part.column("doc_id"), "start": pa.array(starts + row["base"], pa.int64()),
                            "n_tokens": part.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64())})

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # the manifest is small however large the files are: a task for each file, not for each so many bytes
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", folder: str | None = None) -> DataFrame:
    """Write the files to ``folder`` (default: a new one in the shared scratch folder) and read them back."""
    folder = folder or scratch_dir(docs.sparkSession)
    return read_documents(write_token_files(docs, folder, tokenizer), folder)
