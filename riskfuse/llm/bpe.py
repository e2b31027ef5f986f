"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Two adjacent bytes that no vocabulary token holds side by side can never be merged
across, so the place between them is a certain cut: what stands left and right of it
is encoded on its own and the ids are put together. ``ForcedBoundaryBPE`` collects the
pairs that do occur inside tokens once per worker, as a table of 256 x 256 truth values.
A slice of texts is one buffer of bytes; one lookup in the table for each adjacent pair
gives the mask of cuts, the mask gives the fragments, each distinct fragment is encoded
once (by tiktoken, or the library's model where it is long) and kept in a table that is
emptied when it is full, and the ids of all texts come from one gather.

The pre-tokenizer cuts first, and some of its cuts depend on what follows. So

* a space after a visible character always starts a fragment: no token of such a
  vocabulary holds "visible byte, space", and the pre-tokenizer starts a piece there too;
* inside a word (what stands between two such spaces) the table cuts, except in words
  with an apostrophe (contractions), other white space, or one of the lead bytes C2, E1,
  E2, E3 (some characters of theirs are white space): these are one fragment each;
* no cut falls inside a character.

If some vocabulary does join a visible byte with the white space after it, the spaces are
no certain cuts; a text is then one word.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfuse.llm import shared

#: Fragments longer than this are not kept in a worker's table, which holds at most TABLE_SIZE.
LONGEST_KEPT, TABLE_SIZE = 64, 500_000

#: Texts of more bytes than this are encoded in stretches.
LONGEST_TEXT = 1 << 22

#: Unicode's White_Space characters (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
WHITES = [chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c))]

#: The pre-tokenizer of byte-level vocabularies (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for the code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Decoder:
    """Bytes of each id of a tokenizer file; equal to the library's
    ``decode(ids, skip_special_tokens=False)``. Ids are bytes: little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        code = {c: b for b, c in enumerate(byte_alphabet())}
        pieces = {i: bytes(code[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in code for c in t)}
        self.index(pieces | {a["id"]: a["content"].encode() for a in spec.get("added_tokens") or []})

    def index(self, pieces: dict[int, bytes]) -> None:
        import numpy as np
        import pyarrow as pa
        self.pieces = pieces
        self._ids = np.array(sorted(pieces), dtype=np.uint32)
        self._bytes = pa.array([pieces[i] for i in self._ids.tolist()] + [b""], pa.large_binary())

    def joined(self, ids) -> tuple:
        """(bytes of the ids one after the other, end of each id's bytes) of an array of ids; unknown ids have no bytes."""
        import numpy as np
        place = np.searchsorted(self._ids, ids)
        known = place < len(self._ids)
        known[known] = self._ids[place[known]] == ids[known]
        found = self._bytes.take(np.where(known, place, len(self._ids)))
        ends = np.frombuffer(found.buffers()[1], np.int64)[1:len(found) + 1]
        return memoryview(found.buffers()[2] or b""), ends

    def decode(self, ids: bytes) -> str:
        import numpy as np
        return bytes(self.joined(np.frombuffer(ids, "<u4"))[0]).decode("utf-8", "replace")


class ForcedBoundaryBPE:
    """Encoder for one tokenizer file, equal to the library's ``encode(text, add_special_tokens=False)``
    without truncation and padding. Ids are bytes: little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: a byte-level BPE file without normalizer and prefix space is needed")
        self.alphabet = byte_alphabet()
        code = {c: b for b, c in enumerate(self.alphabet)}
        added = spec.get("added_tokens") or []
        vocabulary = {i: bytes(code[c] for c in t) for t, i in spec["model"]["vocab"].items()
                      if all(c in code for c in t)}
        inside = np.zeros((256, 256), dtype=bool)
        own = {a["id"] for a in added}
        for i, t in vocabulary.items():
            if i not in own:
                for a, b in zip(t, t[1:]):
                    inside[a, b] = True
        self.inside = inside
        self.special = {a["content"]: np.uint32(a["id"]).tobytes() for a in added}
        if any(a.get("single_word") or a.get("lstrip") or a.get("rstrip") for a in added):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not covered")
        self._special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._code = code
        white = b"\t\n\x0b\x0c\r "
        visible = [b for b in range(256) if b not in white and b not in (0x85, 0xA0)]
        self._sure = not inside[np.ix_(visible, list(white))].any()
        second = np.arange(256, dtype=np.uint8)
        self._cut = (~inside & ((second & 0xC0) != 0x80)).reshape(-1)
        self._context = (second < 32) | (second == ord("'")) | np.isin(second, [0xC2, 0xE1, 0xE2, 0xE3])
        self._split = re.compile(f"(?<=[^{WHITE}]) ")
        order = [spec["model"]["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in spec["model"]["merges"]]
        if all(a < b for a, b in zip(order, order[1:])) and not spec["model"].get("ignore_merges"):
            import tiktoken  # the same merges by rank, faster on short texts
            ranks = {t: i for i, t in vocabulary.items() if i not in own}
            self._short = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self._short = lambda fragment: self.library.encode(fragment, add_special_tokens=False).ids
        self._table = _Table(self._encode_fragment)

    def _encode_fragment(self, fragment: bytes) -> bytes:
        fragment = fragment.decode("utf-8", "replace")
        if len(fragment) <= LONGEST_KEPT:
            ids = self._short(fragment)
            return struct.pack(f"<{len(ids)}I", *ids)
        inside, alphabet, model, ids = self.inside, self.alphabet, self.library.model, []
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(fragment):
            raw = [self._code[c] for c in piece]
            start = 0
            for end in [k for k in range(1, len(raw)) if not inside[raw[k - 1], raw[k]]] + [len(raw)]:
                ids += [t.id for t in model.tokenize("".join(alphabet[b] for b in raw[start:end]))]
                start = end
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        import pyarrow as pa
        return self.encode_many(pa.array([text], pa.string()))[0].as_py()

    def encode_many(self, texts, special: bool = True):
        """Ids (binary array) of an array of texts; a null text has no ids. Without ``special``
        the strings of special tokens are ordinary text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        odd = pc.greater(pc.binary_length(texts), LONGEST_TEXT)
        for s in self.special if special else ():
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        if not odd:
            ids, ends = self._encode_rows(texts)
            return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)])
        plain = pc.if_else(pa.array(np.isin(np.arange(len(texts)), odd)), "", texts)
        out = self.encode_many(plain, False).to_pylist()
        for k in odd:
            text = texts[k].as_py()
            parts = self._special.split(text) if special and self._special is not None else [text]
            out[k] = b"".join([self.special[part] if special and part in self.special else self._long(part) for part in parts])
        return pa.array(out, pa.binary())

    def _long(self, text: str) -> bytes:
        """Ids of a text of any length, in stretches of about LONGEST_TEXT characters that end before a certain space."""
        import pyarrow as pa
        ids, start = [], 0
        while start < len(text):
            found = self._split.search(text, start + LONGEST_TEXT // 4) if self._sure else None
            end = found.start() if found else len(text)
            ids.append(self._encode_rows(pa.array([text[start:end]], pa.string()))[0].tobytes())
            start = end
        return b"".join(ids)

    def _fragments(self, texts):
        """(fragments as a binary array, first fragment of each text and their number) of a string array without nulls."""
        import numpy as np
        import pyarrow as pa

        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = (offsets - offsets[0]).astype(np.int64)
        if not len(raw):
            return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
        word = np.zeros(len(raw), bool)  # where a word starts
        if self._sure:
            at = np.flatnonzero(raw[1:] == 32) + 1
            word[at[~_white_before(raw, at)]] = True
        word[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        whole = self._context[raw] | ((raw == 32) & ~word)
        number = np.cumsum(word, dtype=np.int32)
        kept = np.zeros(int(number[-1]) + 1, bool)
        kept[number[whole]] = True
        cut = word
        cut[1:] |= self._cut[(raw[:-1].astype(np.uint16) << 8) | raw[1:]] & ~kept[number[1:]]
        starts = np.flatnonzero(cut)
        ends = np.append(starts, len(raw)).astype(np.int32)
        return (pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]),
                np.searchsorted(starts, offsets))

    def _encode_rows(self, texts):
        """(ids of all texts, place of each text's first id and their number)."""
        import numpy as np

        fragments, first = self._fragments(texts)
        if len(self._table) > TABLE_SIZE:
            self._table.clear()
        coded = fragments.dictionary_encode()
        found = list(map(self._table.__getitem__, values(coded.dictionary)))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, which = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        return ids[spread((np.cumsum(sizes) - sizes)[which], sizes[which])], ends[first]


def _white_before(raw, at):
    """Whether the character before each of the places ``at`` of UTF-8 bytes is white space."""
    import numpy as np
    last = raw[at - 1]
    found = last < 33
    far = np.flatnonzero(last >= 0x80)
    if len(far):
        p = at[far]
        a, b, c = raw[np.maximum(p - 3, 0)].astype(np.int64), raw[np.maximum(p - 2, 0)].astype(np.int64), last[far].astype(np.int64)
        known = [int.from_bytes(w.encode(), "big") for w in WHITES if ord(w) > 127]
        found[far] = np.isin(b << 8 | c, known) | np.isin(a << 16 | b << 8 | c, known)
    return found


def values(texts) -> list[bytes]:
    """The values of a binary or string array without nulls, from its buffers."""
    import numpy as np
    kind = np.int64 if str(texts.type).startswith("large") else np.int32
    ends = np.frombuffer(texts.buffers()[1] or b"\0" * 8, kind)[texts.offset:texts.offset + len(texts) + 1].tolist()
    raw = bytes(texts.buffers()[2] or b"")
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def spread(starts, sizes):
    """The places starts[k], ..., starts[k] + sizes[k] - 1 for every k, one after the other."""
    import numpy as np
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Table(dict):
    """Ids by fragment; a fragment that is missing is encoded, and kept if it is short."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self._encode(fragment)
        if len(fragment) <= LONGEST_KEPT:
            self[fragment] = ids
        return ids


_LOADED: dict[tuple, Decoder | ForcedBoundaryBPE] = {}


def loaded(path: str, kind: type = ForcedBoundaryBPE):
    """The encoder (or ``Decoder``) of this worker process for a tokenizer file."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = kind(path)
    return _LOADED[path, kind]


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row (``id_col``, ``ids`` binary) per row of ``df``: the ids of the whole text as
    little-endian unsigned 32-bit integers. A null text counts as empty and has no ids.
    Repeated rows are each encoded. One pass, no shuffle."""
    import pyarrow as pa

    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for batch in shared.in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.encode_many(batch.column(1))], names=["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with a column ``decoded``: the text of ``ids_col``. Unknown ids stand for nothing,
    null ids for an empty text; bytes that are not UTF-8 become U+FFFD."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        bpe = loaded(tokenizer_path, Decoder)
        for batch in shared.in_slices(batches):
            ids = [x or b"" for x in batch.column(ids_col).to_pylist()]
            raw, ends = bpe.joined(np.frombuffer(b"".join(ids), "<u4"))
            ends = np.append(0, ends)[np.cumsum([0, *map(len, ids)]) // 4].tolist()
            texts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())],
                                             names=[*batch.schema.names, "decoded"])

    kept = [c for c in df.columns if c != "decoded"]
    rows = df.select(*kept)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """The result of ``op4``: per document the number of ids and the digests of its ids and of the
    decoded text. Empty and null texts have 0 ids and the digest of the empty string."""
    both = decode(encode(df, tokenizer_path), tokenizer_path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
