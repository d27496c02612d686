"""Sizes in tokens of a public tokenizer. Its vocabulary is a parameter, a file as described in /opt/tokenizers/README.md."""

import base64
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

VOCABULARY = os.environ.get("HILITE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(data: bytes):
    """The encoder of a rank file's content, and the length in bytes of each token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    size = np.zeros(max(ranks.values()) + 1, np.int32)
    size[[*ranks.values()]] = [len(x) for x in ranks]
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def content_of(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_count(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """The number of tokens of text; 0 for null and empty texts. The vocabulary, under 1 MB, goes to the executors as a broadcast."""
    shared = spark.sparkContext.broadcast(content_of(path))

    @arrow_udf(IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        encode = encoding(shared.value)[0].encode_ordinary
        return pa.array([len(encode(x)) for x in texts.to_pylist()], pa.int32())

    return F.coalesce(F.when(text != "", count(F.coalesce(text, F.lit("")))), F.lit(0))


#: Boundary classes from the strongest: paragraph, line, sentence, clause, blank, character; BROKEN ends within a character.
PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, CHARACTER, BROKEN = "plscwxb"
# What ends a sentence and a clause, and what may close it.
SENTENCE_ENDS, CLAUSE_ENDS, CLOSERS = "。！？!?…‼⁇", "，,、;；:：—", "”’」』）)】》\"'"


def boundary_classes(data: bytes, ends: np.ndarray) -> np.ndarray:
    """The class of the boundary after each token, as bytes of ASCII; data: UTF-8 of the text, ends: where tokens end in it."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    after = np.append(b, 10)  # the text's end is the end of a line
    starts = (after & 0xC0) != 0x80
    kind = np.full(n + 1, ord(CHARACTER), np.uint8)
    space = np.isin(after, [32, 9, 10, 13])
    kind[1:][space[:-1]] = ord(BLANK)

    def ends_with(chars: str) -> np.ndarray:
        out = np.zeros(n + 1, bool)
        for c in chars:
            x = c.encode()
            if len(x) <= n:
                hit = b[: n - len(x) + 1] == x[0]
                for k in range(1, len(x)):
                    hit = hit & (b[k : n - len(x) + 1 + k] == x[k])
                out[len(x) :] |= hit
        return out

    clause, sentence = ends_with(CLAUSE_ENDS), ends_with(SENTENCE_ENDS)
    # a full stop ends a sentence before a blank, unless a single letter or a small letter and a stop stand before it, or no capital or wide character comes after
    stop = np.append(False, b == ord(".")) & space
    letter = ((after | 32) >= 97) & ((after | 32) <= 122)
    before = np.append([False, False], letter[: n - 1])  # the byte before the stop
    before2 = np.append([False, False, False], letter[: max(n - 2, 0)])[: n + 1]
    following = np.append(after[1:], 65)
    sentence |= stop & ~(before & ~before2) & ~((following >= 97) & (following <= 122))
    closers = ends_with(CLOSERS)
    for strong in (sentence, clause):
        at = np.flatnonzero(strong)
        for _ in range(2):  # closing signs and blanks after an end belong to it
            here = at[at < n]
            for width in (1, 2, 3):
                to = here + width
                fits = (to <= n) & starts[np.minimum(to, n)]
                to, frm = to[fits], here[fits]
                good = closers[to] | ((to - frm == 1) & space[frm])
                strong[to[good]] = True
            at = np.flatnonzero(strong)
    kind[clause] = ord(CLAUSE)
    kind[sentence] = ord(SENTENCE)
    line = np.append(False, b == 10) & (np.append(b, 0) != 10)
    kind[line] = ord(LINE)
    kind[line & np.append([False, False], b[:-1] == 10)] = ord(PARAGRAPH)
    kind[~starts] = ord(BROKEN)
    return kind[ends]


def mapped_array(texts: pa.Array, vocabulary: bytes, *, chunk: int = 4_000_000) -> pa.Array:
    """STRUCT<classes STRING, ends LIST<INT>> of each text of a string array; nulls as empty texts. Texts are looked at chunk bytes at a time."""
    encoder, size = encoding(vocabulary)
    all_classes, all_ends, counts = [], [], []
    data, ids, own, held = [], [], [], 0

    def flush() -> None:
        nonlocal data, ids, own, held
        if not own:
            return
        n = np.array(own)
        ends = np.cumsum(size[np.array(ids, np.int64)], dtype=np.int64)
        length = np.array([len(x) for x in data])
        before = np.cumsum(length) - length
        # texts stand after each other with a line end behind each
        all_classes.append(boundary_classes(b"\n".join(data) + b"\n", ends + np.repeat(np.arange(len(n)), n)))
        all_ends.append((ends - np.repeat(before, n)).astype(np.int32))
        counts.extend(own)
        data, ids, own, held = [], [], [], 0

    for x in texts:
        text = x.as_py() or ""
        tokens = encoder.encode_ordinary(text)
        data.append(text.encode())
        ids += tokens
        own.append(len(tokens))
        held += len(data[-1])
        if held >= chunk:
            flush()
    flush()
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    classes = pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *all_classes]).tobytes())
    ends = pa.array(np.concatenate([np.zeros(0, np.int32), *all_ends]), pa.int32())
    strings = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets.tobytes()), classes])
    return pa.StructArray.from_arrays([strings, pa.ListArray.from_arrays(pa.array(offsets), ends)], ["classes", "ends"])


def token_map(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """STRUCT<classes STRING, ends ARRAY<INT>>: for each token of text the class of the boundary after it and the byte where it ends."""
    shared = spark.sparkContext.broadcast(content_of(path))

    @arrow_udf(StructType([StructField("classes", StringType()), StructField("ends", ArrayType(IntegerType()))]))
    def mapped(texts: pa.Array) -> pa.Array:
        return mapped_array(texts, shared.value)

    return mapped(text)
