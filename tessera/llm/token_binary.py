"""Token ids as Arrow IPC files of fixed-size-list batches.

A shard is one Arrow file. Each row is one sequence of exactly ``seq_len`` ids with a mask of the
same length (true = a token, false = padding after the shard's last document); ids are uint16 where the vocabulary fits, else uint32. Every batch but the last
holds ``batch_rows`` sequences, so token ``t`` of a shard is in batch ``t // (seq_len *
batch_rows)`` at a computable place of a flat buffer: nothing is parsed or copied to reach it. A
second small Arrow file per shard lists the documents (doc_id, offset, n_tokens) in order.

Shards are ranges of doc_id, so reading shards in name order gives ascending doc_id. Defined
results: NULL and empty text encode to the end id alone; NULL doc_ids come first; rows with equal
doc_id are ordered by their text and all stay; an empty table gives no shards and no rows; extra
columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Cache, open_fs, publish, scratch, slices, small_batches, stored, table, tidy

SEQ_LEN, BATCH_ROWS, END_ID = 1024, 256, 0
CACHE_BYTES, SLICE_BYTES, CHUNK, BATCH_LIMIT = 64 << 20, 4 << 20, 1 << 20, 1000
_MERGING_SPACE = re.compile(r"\s (?:\s|\Z)")


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE spells bytes as printable letters: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Whole texts to ids with a ``tokenizers`` file, as little-endian bytes of the narrowest type that holds them.

    In a byte-level BPE, the pre-tokenizer always cuts before a single space that follows or leads
    a word, so the pieces of a text split at spaces encode alone. Arrow splits texts and numbers the distinct pieces of a
    chunk; their ids come from a bounded cache, and ids of texts are gathered by number. New pieces go to the library joined by
    spaces: only a piece's first token begins with a space, which tells them apart again. Texts in which a run of white space
    could cross such a cut, or which hold the string of an added token, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = Cache(CACHE_BYTES)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        space = _byte_letters()[32]
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids of tokens that begin with a space
        self.leads[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(space)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in done]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without spaces at their ends, each with the space before it."""
        ids = np.frombuffer(self._library([" " + " ".join(pieces)])[0], self.dtype)
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != len(pieces):
            return self._library([" " + p for p in pieces])
        raw, edges = ids.tobytes(), [*(starts * ids.itemsize).tolist(), ids.nbytes]
        return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Cache the ids of pieces that follow a space."""
        plain = [p for p in pieces if p and not p[0].isspace() and not p[-1].isspace()]
        odd = [p for p in pieces if not p or p[0].isspace() or p[-1].isspace()]
        for some, ids_of in ((plain, self._joined), (odd, lambda part: self._library([" " + p for p in part]))):
            for k in range(0, len(some), 20_000):
                part = some[k : k + 20_000]
                self.cache.add(part, ids_of(part))

    def _gathered(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each)."""
        coded = pieces.dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn(self.cache.missing(distinct))
        values = [self.cache[p] for p in distinct]
        flat = np.frombuffer(b"".join(values), self.dtype)
        n = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
        lengths = n[at]
        shift = (np.cumsum(n) - n)[at] - (np.cumsum(lengths) - lengths)
        return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))], lengths

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if _MERGING_SPACE.search(t) or any(a in t for a in self.added)]
        slow = dict(zip(whole, self._library([texts[i] for i in whole]), strict=True)) if whole else {}
        cut = [("", "", "") if i in slow else t.partition(" ") for i, t in enumerate(texts)]
        out = self._library([head for head, _, _ in cut])
        with_rest = [i for i, (_, space, _) in enumerate(cut) if space]
        split = pc.split_pattern(pa.array([cut[i][2] for i in with_rest], pa.large_string()), " ")
        del cut
        pieces, ends = split.flatten(), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        parts: list[list[bytes]] = [[] for _ in with_rest]
        for k in range(0, len(pieces), CHUNK):
            ids, lengths = self._gathered(pieces.slice(k, CHUNK))
            before = np.concatenate([[0], np.cumsum(lengths)])
            first, last = np.searchsorted(ends, [k, k + len(lengths) - 1], side="right")
            for j in range(first, last + 1):  # the texts that reach into this chunk
                a, b = max(0, (ends[j - 1] if j else 0) - k), min(len(lengths), ends[j] - k)
                parts[j].append(ids[before[a] : before[b]].tobytes())
        for j, i in enumerate(with_rest):
            out[i] = b"".join((out[i], *parts[j]))
        for i, ids in slow.items():
            out[i] = ids
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _schema(seq_len: int, dtype: str) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


_DOCS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "shard int, path string, docs_path string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, out: str, tokenizer: str, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Range-partition by doc_id, encode, write one Arrow file a partition; returns the manifest, stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        shard, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        encoder, per = _encoder(tokenizer), seq_len * batch_rows
        dtype, width = encoder.dtype, np.dtype(encoder.dtype).itemsize
        schema = _schema(seq_len, dtype)
        fs, root = open_fs(out)
        fs.create_dir(root, recursive=True)
        names = [f"{root}/shard-{shard:06d}.arrow", f"{root}/shard-{shard:06d}.docs.arrow"]
        total = n_docs = held = 0
        pending: list[bytes] = []
        end = np.array([END_ID], dtype=dtype).tobytes()

        with fs.open_output_stream(f"{names[0]}.{mine}") as sink, pa.ipc.new_file(sink, schema) as ids, fs.open_output_stream(f"{names[1]}.{mine}") as sink2, pa.ipc.new_file(sink2, _DOCS) as index:

            def emit(flat: np.ndarray, n: int) -> None:
                mask = np.arange(len(flat)) < n
                ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), seq_len)], schema=schema))

            def drain(last: bool) -> None:
                nonlocal pending, held
                flat = np.frombuffer(b"".join(pending), dtype=dtype)
                full = len(flat) // per * per
                for k in range(0, full, per):
                    emit(flat[k : k + per], per)
                rest = flat[full:]
                if last and len(rest):
                    padded = np.zeros(-(-len(rest) // seq_len) * seq_len, dtype=dtype)
                    padded[: len(rest)] = rest
                    emit(padded, len(rest))
                    rest = rest[:0]
                pending, held = [rest.tobytes()], len(rest)

            batch, first = first, None
            while batch is not None:
                for some in slices(batch, 1, SLICE_BYTES):
                    lengths = []
                    for raw in encoder.encode([t or "" for t in some.column(1).to_pylist()]):
                        pending += (raw, end)
                        lengths.append(len(raw) // width + 1)
                        held += lengths[-1]
                        if held >= 4 * per:
                            drain(False)
                    offsets = total + np.concatenate([[0], np.cumsum(lengths)[:-1]])
                    index.write_batch(pa.record_batch([some.column(0).cast(pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], schema=_DOCS))
                    total += int(sum(lengths))
                    n_docs += some.num_rows
                batch = next(batches, None)
            drain(True)
        for name in names:
            publish(fs, f"{name}.{mine}", name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{out}/shard-{shard:06d}.arrow"], "docs_path": [f"{out}/shard-{shard:06d}.docs.arrow"], "n_docs": [n_docs], "n_ids": [total]})

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    with small_batches(spark, BATCH_LIMIT):
        return stored(ranged.mapInArrow(tidy(write), _MANIFEST), "token-manifest")


class Shard:
    """Random access to one shard: ids of any token range, touching only the batches that hold it."""

    def __init__(self, path: str, docs_path: str):
        fs, at = open_fs(path)
        local = isinstance(fs, __import__("pyarrow.fs").fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(at) if local else fs.open_input_file(at))
        fs2, at2 = open_fs(docs_path)
        self.docs = pa.ipc.open_file(fs2.open_input_file(at2))
        self.seq_len = self.file.schema.field("input_ids").type.list_size
        self.per = len(self.file.get_batch(0).column(0)) * self.seq_len if self.file.num_record_batches else 1
        self._at, self._flat = -1, None

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        while n > 0:
            k, off = divmod(start, self.per)
            if k != self._at:
                self._at, self._flat = k, self.file.get_batch(k).column(0).flatten().to_numpy()
            part = self._flat[off : off + n]
            yield part
            start, n = start + len(part), n - len(part)

    def ids(self, start: int, n: int) -> np.ndarray:
        return np.concatenate([np.empty(0, "<u4"), *self.pieces(start, n)])

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ``row``: (ids, mask), both of seq_len."""
        rows = self.per // self.seq_len
        batch = self.file.get_batch(row // rows)
        return tuple(batch.column(c).slice(row % rows, 1).flatten().to_numpy(zero_copy_only=c == 0) for c in (0, 1))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["path"], row["docs_path"])
            for k in range(shard.docs.num_record_batches):
                docs = shard.docs.get_batch(k)
                crcs = []
                for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                    crc = 0
                    for part in shard.pieces(start, n):
                        crc = zlib.crc32(part.astype("<u4"), crc)
                    crcs.append(crc)
                yield pa.RecordBatch.from_pydict({"doc_id": docs.column(0), "start": pc.add(docs.column(1), row["base"]), "n_tokens": docs.column(2), "ids_crc32": pa.array(crcs, pa.int64()), "shard": pa.array([row["shard"]] * len(crcs), pa.int32())})


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start over all shards, n_tokens, ids_crc32, shard."""
    # one row a shard, so this window is over the file list; each shard is read with the ids before it, and documents meet no join
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", "docs_path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    spread = placed.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, out: str | None = None, seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    out = out or scratch(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, out, tokenizer, seq_len, batch_rows))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
