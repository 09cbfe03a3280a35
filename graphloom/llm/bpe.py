"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 16 characters cuts a text wherever its low bits are zero, so equal
passages are cut alike in whatever document they stand.  Each chunk is encoded once and
kept for the documents that share it.  Chunk joins are then repaired: around each cut the
text is re-encoded from the last sure boundary before it to the first one after it, and
the seam reaches over further chunks until both its ends are sure.  A sure boundary is a
single space between two visible characters: the splitting pattern of these vocabularies
always starts a new piece there and looks neither back over it nor past it from before,
and no special token holds a space.  There the encodings of both sides agree with the
encoding of the whole text.

Chunks are kept in the Python worker, across tasks, within KEEP_CHARS characters; the
oldest go first.  So reuse takes no shuffle and bounded memory.

The vocabulary is a tokenizers JSON file named by the caller.  If its ids are the order of
its merges (as in all byte-level vocabularies of this family) it is run by tiktoken, which
gives the same ids several times faster.  Any other file is run by the tokenizers library
itself, which encodes and decodes whole texts, as its rules need not agree at cuts; equal
texts are then what is reused.

Defined edge cases: null texts are empty and have no ids; the special tokens' strings
become their ids as in the library; repeated rows are repeated; an empty table gives no
rows; any other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import small_batches, utf8

CHUNK_BITS = 8
KEEP_CHARS = 3_000_000

#: The splitting pattern of byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SURE = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
_ODD = np.uint32(0x9E3779B1)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


def cuts(text: str) -> list[int]:
    """Content-defined cut positions inside the text."""
    if len(text) < 32:
        return []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) * _ODD
    h ^= h >> np.uint32(15)
    factor = _ODD
    for width in (1, 2, 4, 8):
        wide = h.copy()
        wide[width:] += h[:-width] * factor
        h, factor = wide, np.uint32((int(factor) * int(factor)) & 0xFFFFFFFF)
    h ^= h >> np.uint32(16)
    found = np.flatnonzero((h[15:-1] & np.uint32((1 << CHUNK_BITS) - 1)) == 0) + 16
    return found.tolist()


def spans(text: str) -> Iterator[str]:
    """The text in order as chunks and seams; all ends are sure boundaries or ends of the text."""
    begin = 0
    for cut in cuts(text):
        if cut < begin:
            continue  # a seam has reached over this cut
        left = _last_sure(text, begin, cut)
        if left > begin:
            yield text[begin:left]
        right = _SURE.search(text, cut)
        begin, end = left, right.start() if right else len(text)
        if end > begin:
            yield text[begin:end]
        begin = end
        if right is None:
            return
    if begin < len(text):
        yield text[begin:]


def _last_sure(text: str, begin: int, end: int) -> int:
    """The last sure boundary in (begin, end), or begin."""
    at = end
    while (at := text.rfind(" ", begin + 1, at)) > 0:
        if _SURE.match(text, at):
            return at
    return begin


class Codec:
    """Encodes pieces of text with reuse; decodes ids."""

    def __init__(self, path: str, keep_chars: int = KEEP_CHARS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.keep_chars = path, keep_chars
        self.kept: dict[str, tuple[bytes, int, bytes | None]] = {}
        self.kept_chars = 0
        self.engine = self.library = None
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        if ranks := self._merge_order(spec):
            import tiktoken

            self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
            self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()

    def _merge_order(self, spec: dict) -> dict[bytes, int] | None:
        """Ids by bytes, if the vocabulary is byte-level, splits by PATTERN and numbers its tokens in the order of its merges."""
        before, model, alphabet = spec.get("pre_tokenizer") or {}, spec.get("model") or {}, byte_alphabet()
        plain = [s for s in model.get("vocab", {}) if s not in self.special] if isinstance(model.get("vocab"), dict) else []
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        if (spec.get("decoder") or {}).get("type") != "ByteLevel" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")) or any(" " in s for s in self.special):
            return None
        if any(c not in alphabet for s in plain for c in s):
            return None
        new = [s for s in self.special if s not in model["vocab"]]  # the library numbers these itself
        if any(self.special[s] != model["vocab"].get(s, self.special[s]) for s in self.special) or [self.special[s] for s in new] != [len(model["vocab"]) + n for n in range(len(new))]:
            return None
        ranks = {bytes(alphabet[c] for c in s): model["vocab"][s] for s in plain}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if len(merges) + 256 != len(ranks) or sorted(ranks.get(bytes([b]), -1) for b in range(256)) != list(range(256)):
            return None
        if any(ranks.get(bytes(alphabet.get(c, 0) for c in a + b)) != 256 + n for n, (a, b) in enumerate(merges)):
            return None
        return ranks

    def ids(self, piece: str) -> list[int]:
        if self.library is not None:
            return self.library.encode(piece, add_special_tokens=False).ids
        return self.engine.encode(piece, allowed_special="all") if self._special.search(piece) else self.engine.encode_ordinary(piece)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text of ids; of a byte-level vocabulary the bytes as they are."""
        if self.library is not None:
            return utf8(self.library.decode(list(ids), skip_special_tokens=False))
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def piece(self, text: str) -> tuple[bytes, int, bytes | None]:
        """(decimal ids joined by commas, their number, what they decode to if not to the text) of a piece, encoded at most once while kept."""
        known = self.kept.get(text)
        if known is None:
            ids = self.ids(text)
            back = self.decode(ids)
            known = (",".join(map(str, ids)).encode(), len(ids), None if back == utf8(text) else back)
            self.kept[text] = known
            self.kept_chars += len(text)
            while self.kept_chars > self.keep_chars and len(self.kept) > 1:
                oldest = next(iter(self.kept))
                self.kept_chars -= len(oldest)
                del self.kept[oldest]
        return known

    def pieces(self, text: str) -> Iterator[tuple[str, tuple[bytes, int, bytes | None]]]:
        """Pieces of a whole text with their codes."""
        for part in spans(text) if self.library is None else [text] if text else []:
            yield part, self.piece(part)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, (code, n, _) in self.pieces(text or "") if n for i in code.split(b",")]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file in this process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens and SHA-256 of its ids and of the text decoded from them."""
    small_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("text", T.StringType())])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        c, out = codec(path), []
        for t in texts:
            ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
            for part, (code, k, decoded) in c.pieces(t or ""):
                if k:
                    ids.update(b"," + code if n else code)
                back.update(utf8(part) if decoded is None else decoded)
                n += k
            out.append((n, ids.hexdigest(), back.hexdigest()))
        return pd.DataFrame(out, columns=["n", "ids", "text"])

    e = docs.select("doc_id", run(F.col("text")).alias("e"))
    return e.select("doc_id", F.col("e.n").alias("n_tokens"), F.col("e.ids").alias("ids_sha256"), F.col("e.text").alias("decoded_sha256"))


def with_ids(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The documents with their token ids."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([codec(path).encode(t) for t in texts], dtype=object)

    return docs.withColumn(column, encode(F.col("text")))


def with_text(encoded: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; bytes that are not UTF-8 become U+FFFD; null stays null."""
    small_batches(encoded.sparkSession)

    @F.pandas_udf(T.StringType())
    def decode(lists: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else codec(path).decode(v).decode("utf-8", "replace") for v in lists], dtype=object)

    return encoded.withColumn(column, decode(F.col(ids)))
