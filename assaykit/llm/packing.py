"""Power-of-two packing: documents become pieces of binary lengths, gathered by equal length.

A document's n tokens give n // most pieces of `most` tokens and one piece for each binary digit of
the rest, longest first. Each piece is a sequence of its own, so no sequence crosses documents
and none needs padding; sequences of one bucket (log2 of the length) have equal lengths.

Ids are those of the tokenizers library for the given vocabulary file.
"""

from __future__ import annotations

import json
import os
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import bound_batches, table, text_slices

#: The cuts that byte-level pre-tokenization makes, and its special signs of bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[int, Encoder] = {}


def _byte_signs() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts, as Tokenizer.encode gives them.

    A byte-level vocabulary whose ids stand in the order of its merges goes to tiktoken, which
    gives the same ids in a third of the time; other ones, and texts that it gives up on (very long
    runs of white space), to the tokenizers library itself.
    """

    def __init__(self, description: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.special: list[str] = []
        self.fast = self._ranks(json.loads(description))

    def _ranks(self, described: dict):
        import tiktoken

        model, pre = described["model"], described.get("pre_tokenizer") or {}
        added = described.get("added_tokens") or []
        plain = all(not x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        usual = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        bytelevel = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not described.get("normalizer")
        if not (plain and usual and bytelevel):
            return None
        signs, vocabulary = _byte_signs(), model["vocab"]
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in merged or merged != sorted(merged) or len(vocabulary) != 256 + len(merged):
            return None
        self.special = [x["content"] for x in added]
        ranks = {bytes(map(signs.__getitem__, t)): k for t, k in vocabulary.items() if t not in self.special}
        return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={x["content"]: x["id"] for x in added})

    def encode(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                has = any(x in text for x in self.special)
                return self.fast.encode_to_numpy(text, allowed_special="all" if has else set(), disallowed_special=()).astype("<u4").tobytes()
            except BaseException as e:  # the library's panics aren't Exceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def binary_lengths(n: int, most: int) -> list[int]:
    """Lengths of n tokens' pieces: as many of `most` as fit, then the rest's binary digits."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_le, doc_tokens, bucket, sequence_id, offset.

    tokenizer: path of a tokenizers JSON file, read on the driver (some MB, broadcast). most: a
    power of two. ids_le: the piece's ids as little-endian unsigned 32-bit numbers. end_id ends
    each document. sequence_id holds the input partition and a count within it, so it is the same
    when a task runs again over the same file split.

    A null text is an empty one: one piece with end_id alone. A null id stays null. Repeated rows
    are packed as often as they occur. Other columns are left out. No rows give no rows.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        description = spark.sparkContext.broadcast(f.read())
    kind = pa.int64()
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, start long, length long, ids_le binary, doc_tokens long, bucket int, sequence_id long, offset long"

    def run(batches):
        key = hash(description.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Encoder(description.value)
        encoder, end = _loaded[key], array("I", [end_id]).tobytes()
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        for batch in batches:
            for lo, hi in text_slices(batch, 1):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                buffers, row, start, length, total = [], [], [], [], []
                for k, text in enumerate(texts):
                    ids = encoder.encode(text or "") + end
                    buffers.append(ids)
                    at, n = 0, len(ids) // 4
                    for size in binary_lengths(n, most):
                        row.append(lo + k)
                        start.append(at)
                        length.append(size)
                        total.append(n)
                        at += size
                places = array("i", [0])
                for size in length:
                    places.append(places[-1] + 4 * size)
                pieces = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(b"".join(buffers))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())),
                        pa.array(start, kind),
                        pa.array(length, kind),
                        pieces,
                        pa.array(total, kind),
                        pa.array([x.bit_length() - 1 for x in length], pa.int32()),
                        pa.array(range(sequence, sequence + len(row)), kind),
                        pa.array([0] * len(row), kind),
                    ],
                    names=[id_column, "start", "length", "ids_le", "doc_tokens", "bucket", "sequence_id", "offset"],
                )
                sequence += len(row)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces so that each folder bucket=k holds sequences of 2**k tokens alone. Ids, nulls and repeats as pack_documents gives them; no pieces make no folder."""
    pieces.write.partitionBy("bucket").parquet(path)


def public_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def packed_rows(docs: DataFrame) -> DataFrame:
    """The pieces of documents with a digest in place of their ids. Nulls, empty texts and repeats: see pack_documents."""
    return pack_documents(docs, public_tokenizer()).select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, see packed_rows."""
    return packed_rows(table(spark, sf_dir, "documents"))
