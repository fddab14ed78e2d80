"""Encoding of texts, and flat files of token ids.

A file is a run of little-endian ids of fixed width; each record ends with the end id. Files are
written by Spark's text writer, whose line separator is the end id's bytes, so they can go to
any store that Spark writes to.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_MEMO, CHUNK_MEMO = 600_000, 250_000  # entries that a worker remembers, some 120 MB and 50 MB
FILES = "path string, modificationTime timestamp, length long, content binary"
RECORDS_PER_FILE = 2_000  # bounds what a reader of one file holds

# The two settings under which a text's blank-separated chunks are encoded one by one.
NORMAL_FORM = ["NFC", "Replace", "Lowercase"]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as packed unsigned integers of two bytes (four if the vocabulary needs them).

    Equal to the tokenizers library's ``encode(text, add_special_tokens=False)``. Where the tokenizer cuts at
    blanks before anything else, each distinct chunk is encoded once per worker and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            set_up = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.code = {2: "H", 4: "I"}[width_for(self.size)]
        self.width = array(self.code).itemsize
        self.special = [t["content"] for t in set_up["added_tokens"]]
        kinds = [n.get("type") for n in (set_up.get("normalizer") or {}).get("normalizers", [])]
        cuts = [p.get("pattern", {}).get("Regex") for p in (set_up.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_chunk = kinds == NORMAL_FORM and cuts[:1] == [PIECES]
        self.model = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def pack(self, ids) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_chunk or any(s in text for s in self.special):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def word(self, text: str) -> bytes:
        """Ids of one piece that the tokenizer doesn't cut or change further."""
        found = self.words.get(text)
        if found is None:
            letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            found = self.pack([t.id for t in self.model(letters)])
            if len(self.words) < WORD_MEMO:
                self.words[text] = found
        return found


class _Chunks(dict):
    """Ids of chunks without blanks. Letters followed by marks are two pieces; all else goes through the whole tokenizer."""

    SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*$%&#|]*)")

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        simple = self.SIMPLE.fullmatch(chunk)
        if simple:
            word, marks = simple.groups()
            found = self.encoder.word(word.lower()) + (self.encoder.word(marks) if marks else b"")
        else:
            found = self.encoder.pack(self.encoder.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(self) < CHUNK_MEMO:
            self[chunk] = found
        return found


def width_for(ids: int) -> int:
    """Bytes of an id where there are so many: two, or four."""
    return 2 if ids <= 1 << 16 else 4


@cache
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    return Encoder(path)


def write_id_files(records: DataFrame, folder: str, end: int, width: int, by: str | None = None) -> None:
    """Write the binary column ``ids`` of each row, and the end id after it, in the order of the rows of each partition.

    ``by`` names a column whose values get folders of their own.

    The bytes of the end id must be below 128, as the separator is given as text.
    """
    separator = end.to_bytes(width, "little").decode("ascii")
    keys = [by] if by else []
    lines = records.select(F.expr("cast(ids as string)").alias("value"), *keys)
    lines.write.partitionBy(*keys).option("lineSep", separator).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def read_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """file_no (a sortable text: partition, then file), content. Files are whole rows: writers bound them by RECORDS_PER_FILE."""
    try:
        files = spark.read.schema(FILES).format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file_no string, content binary")  # nothing was written
    part = F.regexp_extract("path", r"part-(\d+)", 1)
    count = F.regexp_extract("path", r"[-.]c(\d+)(\.[^./-]*)?$", 1)
    return files.select(F.concat(F.lpad(part, 10, "0"), F.lit("-"), F.lpad(count, 10, "0")).alias("file_no"), "content")
