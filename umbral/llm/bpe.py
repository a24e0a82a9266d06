"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Nulls encode like the empty text (no ids); a null id list decodes to no bytes. Repeated rows are
encoded each for itself. All other columns of the input pass through; the added column
replaces one of the same name. Texts of any length are whole: long ones are cut only where a
match of the pattern ends whatever stands around it, so ids equal those of the uncut text. A very long run
of white space is one match, on which the library's pattern matching would run out of stack: it is found by a
plain scan and encoded as one piece.
"""

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longer texts are handed to the library in pieces of about this many characters.
PIECE = 1 << 16
#: Bytes of input whose results a worker holds at once, where rows are shorter.
BATCH_BYTES = 1 << 19

#: No match of the pattern spans these places: a letter or digit before white space, a letter
#: before a digit, a digit before a letter.
SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \t\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


#: White space as the pattern's \\s has it.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoding(path: str, pattern: str):
    """The tokenizer of a rank file; a Python worker builds it once and keeps it for later tasks."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_umbral_encodings", {})
    if (path, pattern) not in kept:
        kept[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=rank_table(path), special_tokens={})
    return kept[path, pattern]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of `size` characters or more, cut at safe places only."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def parts(text: str, size: int = PIECE) -> Iterator[tuple[bool, str]]:
    """The text in order, in runs of white space of `size` characters or more that are one match each (True), and what lies between."""
    start = 0
    for run in re.finditer(rf"{SPACE}{{{size},}}", text):
        # The last character of a run that does not end the text belongs to what follows.
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield False, text[start : run.start()]
        yield True, text[run.start() : end]
        start = end
    yield False, text[start:]


def encode_text(encoder, text: str | None, size: int = PIECE) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return encoder.encode_ordinary(text)
    ids: list[int] = []
    for run, part in parts(text, size):
        if run:
            ids += encoder._core_bpe.encode_single_piece(part.encode()) if part else []
        else:
            for piece in pieces(part, size):
                ids += encoder.encode_ordinary(piece)
    return ids


def _slices(batch: pa.RecordBatch, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose last column has about `size` bytes: ids take far more room than text."""
    width = max(1, batch.columns[-1].nbytes // max(1, batch.num_rows))
    step = max(1, size // width)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _add(df: DataFrame, added: dict[str, tuple[T.DataType, pa.DataType]], source: Column, start) -> DataFrame:
    """df without the columns `added`, then with them: start() gives a function from a value of source to theirs."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in added]
    schema = T.StructType([*df.select(*kept).schema, *(T.StructField(name, kind) for name, (kind, _) in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in batches:
            for part in _slices(b):
                found = [work(x) for x in part.columns[-1].to_pylist()]
                new = [pa.array([x[i] for x in found], kind) for i, (_, kind) in enumerate(added.values())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=schema.names)

    return df.select(*kept, source.alias("__source")).mapInArrow(run, schema)


IDS = T.ArrayType(T.IntegerType()), pa.list_(pa.int32())
BYTES = T.BinaryType(), pa.binary()


def encode(df: DataFrame, text_col: str, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """Adds the token ids of each text as an array of integers."""

    def start():
        encoder = encoding(path, pattern)
        return lambda text: (encode_text(encoder, text),)

    return _add(df, {out: IDS}, F.col(text_col), start)


def decode(df: DataFrame, ids_col: str, path: str, pattern: str, out: str = "decoded") -> DataFrame:
    """Adds the raw bytes that the ids stand for; they need not be valid UTF-8."""

    def start():
        decoder = encoding(path, pattern)
        return lambda ids: (decoder.decode_bytes(ids or []),)

    return _add(df, {out: BYTES}, F.col(ids_col), start)


def round_trip(df: DataFrame, text_col: str, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode, then decode of its ids, in one pass of one Python worker."""

    def start():
        coder = encoding(path, pattern)

        def both(text: str | None) -> tuple[list[int], bytes]:
            found = encode_text(coder, text)
            return found, coder.decode_bytes(found)

        return both

    return _add(df, {ids: IDS, decoded: BYTES}, F.col(text_col), start)


def digest(ids: Column) -> Column:
    """SHA-256 of decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)
