"""What the training-data operators share: shared scratch tables, portable files and the memoising token encoder."""

from __future__ import annotations

import posixpath
import re
import uuid
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words everywhere in this package: space and 0x09-0x0D, which is also what bytes.split() takes.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and every executor see; a local one is set only where the session has none and is local itself."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/lodestone-checkpoint"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark)}/lodestone/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lost executors never bring back what lies before it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The most bytes of an Arrow batch between the JVM and a Python worker: long documents come in small batches.
BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches that are bounded in bytes as well as in rows, so that a worker's memory is."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def open_fs(uri: str):
    """(file system, path) of a URI or a plain path, by pyarrow: local, HDFS or an object store."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_dirs(uri: str) -> None:
    system, path = open_fs(uri)
    system.create_dir(path, recursive=True)


def join_path(base: str, name: str) -> str:
    return posixpath.join(base, name)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of doc_id as text has this remainder. A null doc_id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % modulus == remainder


def _has_map(kind) -> bool:
    """Whether a type holds a map anywhere; such values can't be hashed as they are."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, a hash of the whole row (_row) and all columns as one struct (_held): no column's name or type is in the way."""
    held = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema]
    return docs.select("doc_id", "text", F.xxhash64(*parts).alias("_row"), held.alias("_held"))


def restored(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns that carried() took along, by the names they had."""
    return rows.select(*[F.col(f"_held.c{k}").alias(c) for k, c in enumerate(names)])


def one_row(rows: DataFrame) -> DataFrame:
    """One of the carried rows that agree in doc_id and hash; the others are the same rows again."""
    return rows.dropDuplicates(["_row", "doc_id"])


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space that tokenizers see and that SPACE has not, as UTF-8, and separators on which str and tokenizers disagree.
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: The first bytes of the above.
_ODD_FIRST = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2", b"\xe1", b"\xe2", b"\xe3")
#: A space between white space: only there may a pre-token reach over a space.
_INNER_SPACE = tuple(b" " + bytes([x]) for x in b" \t\n\x0b\x0c\r")
_OTHER_SPACE = (b"\t", b"\x0b", b"\x0c", b"\r")
#: Composed Latin letters: one pre-token under either vocabulary. U+0130 lower-cases to two characters.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: The same as UTF-8.
_LETTER_BYTES = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+")
#: Characters whose runs are pre-tokens of their own behind a letter or digit: ASCII punctuation but the apostrophe.
_STOPS = bytes(x for x in range(33, 127) if not chr(x).isalnum() and x != 39)
#: Bytes of ASCII and of U+0080-U+017F, where all but two of the characters above U+00BF are letters; the two signs, and
#: U+0130, whose lower-case form ends in a combining dot that goes with the punctuation behind it.
_LATIN = bytes([*range(0x80), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5])
_SIGNS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")
#: Letters, digits and other bytes above ASCII as a, stops as they are, white space as a space, all else as x.
_SORTS = bytes(97 if x > 127 or chr(x).isalnum() else x if x in b".," else 32 if chr(x).isspace() else 120 for x in range(256))
_LONG = 256
#: About what a remembered piece takes besides its bytes and its ids: two objects and a place in a dictionary.
_ENTRY = 120


def _byte_letters() -> dict[int, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others for U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in kept)}


def _kinds(step) -> set[str]:
    """The kinds of a tokenizer file's normalizers or pre-tokenizers; a replacement of white space by a space changes no piece."""
    if not step:
        return set()
    if step["type"] == "Sequence":
        return set().union(*map(_kinds, step.get("normalizers") or step.get("pretokenizers") or []))
    return set() if step["type"] == "Replace" and step.get("pattern") == {"Regex": "\\s+"} and step.get("content") == " " else {step["type"]}


def _parts_words(tokenizer, spaced: bool) -> bool:
    """Whether texts may be taken apart at white space: by the kinds that the tokenizer's file names, and tried on samples."""
    import json

    d = json.loads(tokenizer.to_str())
    if d["model"].get("type") != "BPE" or _kinds(d.get("normalizer")) - {"NFC", "Lowercase"} or _kinds(d.get("pre_tokenizer")) - {"ByteLevel", "Split"} or "ByteLevel" not in _kinds(d.get("pre_tokenizer")):
        return False
    if spaced != ("Lowercase" not in _kinds(d.get("normalizer"))):
        return False
    letters = _byte_letters()
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    part = lambda t: [x.id for x in tokenizer.model.tokenize(t.encode().decode("latin-1").translate(letters))]
    text = "Einen \u00e9t\u00e9, Stra\u00dfe.\nthe other7; Words"
    words = re.findall("[ \n]?[^ \n]+", text) if spaced else text.split()
    own = part(" Words") + part(";,") if spaced else part("words") + part(";,")
    return ids(text) == [x for w in words for x in ids(w)] and ids(" Words;,") == own and len(ids("a\nb")) == len(ids("a")) + len(ids("b")) + spaced


class Encoder:
    """Token ids of whole texts, with the pieces between white space encoded once and remembered.

    A pre-tokenizer that never joins a non-space to a following space gives each piece the same ids wherever it stands;
    ``spaced`` says whether the white space before a piece belongs to it (byte-level) or is dropped (lower case, word
    ends). Punctuation behind a letter or digit is a piece of its own. Texts with other Unicode white space, or with a
    space between white space, are encoded as a whole, and so is every text if the tokenizer's file isn't of the kind that
    ``spaced`` says. Ids are little-endian, two bytes wide where the vocabulary allows. Memory is bounded: at most two
    generations of ``memory`` bytes, no piece of them longer than 256 bytes.

    Pieces are remembered by their bytes; one that begins a line stands behind a line end, others behind a space.
    """

    def __init__(self, path: str, spaced: bool, memory: int = 48_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.space = chr(self.letters[32])
        self.spaced, self.memory, self.memo, self.old, self.size, self.ends = spaced, memory, {}, {}, 0, {}
        self.apart = _parts_words(self.tokenizer, spaced)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        self.line = self._whole(b"\n")

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()

    def _remember(self, key: bytes, ids: bytes) -> bytes:
        if len(key) <= _LONG:
            if self.size > self.memory:
                self.old, self.memo, self.size = self.memo, {}, 0
            self.memo[key] = ids
            self.size += len(key) + len(ids) + _ENTRY
        return ids

    def _part(self, text: str) -> bytes:
        """The ids of one pre-token."""
        if not text.isalpha() or not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        return self._tokens(text)

    def _tokens(self, letters: str) -> bytes:
        """The ids of one pre-token that is written in the vocabulary's letters."""
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _stops(self, text: bytes) -> bytes:
        if (out := self.ends.get(text)) is None:
            out = self._part(text.decode())
            if len(text) <= 4:  # a few thousand such strings at most
                self.ends[text] = out
        return out

    def _piece(self, piece: bytes) -> bytes:
        """The ids of a piece that isn't among those seen lately."""
        if (out := self.old.get(piece)) is not None:
            return self._remember(piece, out)
        if piece.isalpha():  # ASCII: each byte is its own letter
            return self._remember(piece, self._tokens(self.space + piece.decode() if self.spaced else piece.lower().decode()))
        if _LETTER_BYTES.fullmatch(piece):
            text = b" " + piece if self.spaced else piece.decode().lower().encode()
            return self._remember(piece, self._tokens(text.decode("latin-1").translate(self.letters)))
        if piece[:1] == b"\x1f":
            return self._remember(piece, self._stops(piece[1:]))
        if self.spaced and b"\n" in piece[1:]:
            return self._lines(piece)
        stem = piece.rstrip(_STOPS)
        if len(stem) < len(piece) and stem and stem != b"\n" and (stem[-1:].isalnum() or stem[-1] > 127 and _LETTERS.fullmatch(stem.decode()[-1])):
            out = self.memo.get(stem)
            return (self._piece(stem) if out is None else out) + self._stops(piece[len(stem) :])
        text = piece.decode()
        starts = self.spaced and text.startswith("\n")
        if starts and _LETTERS.fullmatch(text, 1):
            out = self.line + self._part(text[1:])
        else:
            out = self._whole(piece if starts or not self.spaced else b" " + piece)
        return self._remember(piece, out)

    def _lines(self, piece: bytes) -> bytes:
        """The ids of a piece with line ends."""
        if piece.startswith(b"\n") or piece.endswith(b"\n") or b"\n\n" in piece:
            return self._whole(b" " + piece)
        first, *rest = piece.split(b"\n")
        return b"".join([self._seen(first), *(self._seen(b"\n" + x) for x in rest)])

    def _seen(self, piece: bytes) -> bytes:
        out = self.memo.get(piece)
        return self._piece(piece) if out is None else out

    def _cut(self, text: bytes) -> list[bytes] | None:
        """The pieces of a text, the first as if a line end stood before it; None if it can't be taken apart."""
        if any(x in text for x in _ODD_FIRST) and _ODD_SPACE.search(text):
            return None
        if self.spaced:
            if text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _INNER_SPACE) or any(x in text for x in _OTHER_SPACE):
                return None
        sorts = text.translate(_SORTS)
        behind = sorts.count(b"a. ") + sorts.count(b"a, ") == sorts.count(b". ") + sorts.count(b", ")  # every stop is behind a letter or digit
        if behind and (text.isascii() or not text.translate(None, _LATIN) and not any(x in text for x in _SIGNS)):
            # Stops become pieces of their own, marked by a byte that no text here has; a line's first word is one with its end.
            if not self.spaced:
                text = text.lower()  # no combining marks here, which would join otherwise to a lower-case letter
            for stop in (b".", b","):
                text = text.replace(stop + b" ", b" \x1f" + stop + b" ").replace(stop + b"\n", b" \x1f" + stop + b"\n")
            if self.spaced and b"\n\n" not in text and b"\n " not in text:
                text = text.replace(b"\n", b" \n")
        return (b"\n" + text).split(b" ") if self.spaced else text.split()

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as bytes."""
        if not text:
            return b""
        pieces = self._cut(text) if self.apart else None
        if pieces is None:
            return self._whole(text)
        if self.spaced and b"\n" in pieces[0][1:]:
            pieces[0] = b"x" + pieces[0]  # lines before the first space: taken apart behind a word that is cut off again
        ids = list(map(self.memo.get, pieces))
        if None in ids:
            own = {}
            for i in [i for i, x in enumerate(ids) if x is None]:
                p = pieces[i]
                x = own.get(p)
                if x is None:
                    own[p] = x = self._piece(p)
                ids[i] = x
        if self.spaced:
            ids[0] = ids[0][len(self.line) + (len(self._seen(b"x")) if pieces[0].startswith(b"x\n") else 0) :]
        return b"".join(ids)


#: What the operators remember in this Python worker: owner, and how it is let go.
_held: dict[str, object] = {}


def take_memory(owner: str, let_go=None) -> None:
    """A worker remembers things for one operator at a time: what others left in it is freed when a task of this one begins."""
    for other in [k for k in _held if k != owner]:
        _held.pop(other)()
    if let_go:
        _held[owner] = let_go


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder for this file; what it remembers serves all tasks of a Python worker."""
    take_memory("tokens", _encoders.clear)
    if (path, spaced) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders.clear()
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]
