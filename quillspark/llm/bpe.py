"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged across, so a cut between
its two bytes is certain. Each pre-token is cut at such pairs, the fragments are encoded independently by
merge rank, and their ids are concatenated. What stands between two spaces is encoded once and kept in a bounded table
per worker.

Defined results: a null text counts as empty and gives no ids; a null id list decodes to the empty text;
an added token's string inside a text becomes its one id, as the tokenizer file says; rows are returned
as often as given; an empty table gives no rows. Other columns are not read, unless passed through by name.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import tidied

#: Pieces of text kept in each of a worker's two tables; beyond that it is emptied.
TABLE_SIZE = 300_000
#: The white space of Unicode, and the contractions that byte-level pre-tokenizers split off.
SPACES = "\t-\r \x85\xa0                　"
CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"


def _ranges(kind: str, top: int) -> str:
    """The code points up to top of a general category's letter, as the inside of a character class."""
    out, start = [], None
    for c in range(top + 2):
        own = c <= top and unicodedata.category(chr(c))[0] == kind
        if own and start is None:
            start = c
        elif not own and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(2)
def splitter(top: int = sys.maxunicode) -> re.Pattern:
    """The pre-tokenizer's pattern for texts of code points up to top; small classes match faster."""
    letters, numbers, spaces = _ranges("L", top), _ranges("N", top), "".join(c for c in SPACES if ord(c) <= top or c == "-")
    return re.compile(f"{CONTRACTIONS}| ?[{letters}]++| ?[{numbers}]++| ?[^{spaces}{letters}{numbers}]++|[{spaces}]+(?![^{spaces}])|[{spaces}]++")


def pre_tokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return splitter().findall(text)
    return splitter(255).findall(text)


#: A space with white space beside it; a last one has none after it, as in a longer text.
_BESIDE = re.compile(f" [{SPACES}]|[{SPACES}] ")
_RARE = re.compile(f"[{SPACES.replace(' ', '').replace(chr(9) + '-', chr(9) + chr(11) + '-')}]")


def _apart(text: str) -> bool:
    """Whether no space has white space beside it."""
    if "  " in text or " \n" in text or "\n " in text:
        return False
    rare = any(c in text for c in "\t\x0b\x0c\r") if text.isascii() else _RARE.search(text)
    return not rare or not _BESIDE.search(text)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character to byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Marks that end a word.
ENDS = ".,;:!?"
#: What writes so many ids as little-endian int32.
PACKED = [struct.Struct(f"<{n}i").pack for n in range(65)]


def _keep(table: dict[str, bytes], key: str, ids: bytes) -> None:
    if len(table) >= TABLE_SIZE:
        table.clear()
    if len(key) <= 64:
        table[key] = ids


class ByteBpe:
    """The tables of one tokenizer file, and encoding and decoding by them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._assert_plain(spec)
        back = byte_alphabet()
        raw = lambda piece: bytes(back[c] for c in piece)
        vocab = {raw(piece): i for piece, i in spec["model"]["vocab"].items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.single = [vocab[bytes([b])] for b in range(256)]
        inside = {token[i : i + 2] for token in vocab for i in range(len(token) - 1)}
        self.joined = np.zeros((256, 256), bool)
        for a, b in inside:
            self.joined[a, b] = True
        self.joined_rows = [bytes(row) for row in self.joined.astype(np.uint8)]
        self.joined_pairs = frozenset((a, b) for a, b in inside)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added_split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = token
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.table: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.compiled = self._compiled(vocab)

    @staticmethod
    def _assert_plain(spec: dict) -> None:
        """Raises an error if the file asks for anything that is not done here."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [f"added {k}" for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
        if spec.get("normalizer") or model.get("type") != "BPE" or odd:
            raise ValueError(f"not a plain byte-level BPE file: {odd or 'normalizer or model'}")
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level pre-tokenizer and decoder")

    def _compiled(self, vocab: dict[bytes, int]):
        """A compiled merge loop, where ids rise with merge ranks, so that ids can stand for ranks; else None."""
        import tiktoken

        new = [i for _, i in sorted(self.merges.values())]
        if any(a >= b for a, b in zip(new, new[1:])) or max(self.single) >= new[0] or len(new) + 256 != len(vocab):
            return None
        encoding = tiktoken.Encoding("fragments", pat_str="(?s).+", mergeable_ranks=vocab, special_tokens={})
        core = getattr(encoding, "_core_bpe", None)
        return core.encode_single_piece if hasattr(core, "encode_single_piece") else encoding._encode_single_piece

    def fragments(self, word: bytes) -> list[bytes]:
        """word, cut wherever two neighbouring bytes stand together in no token."""
        if self.joined_pairs.issuperset(pairwise(word)):
            return [word]
        rows, out, start = self.joined_rows, [], 0
        for i in [i for i, (a, b) in enumerate(pairwise(word), 1) if not rows[a][b]]:
            out.append(word[start:i])
            start = i
        out.append(word[start:])
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """The ids of one fragment: the pair of lowest rank is merged first, from the left."""
        if self.compiled and len(fragment) > 1:
            return self.compiled(fragment)
        ids, merges = [self.single[b] for b in fragment], self.merges
        if len(ids) > 64:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = min((merges[p] for p in zip(ids, ids[1:]) if p in merges), default=None)
            if best is None:
                break
            rank, new = best
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and merges.get((ids[i], ids[i + 1]), (-1,))[0] == rank:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for fragments of any length."""
        import heapq

        n, merges = len(ids), self.merges
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j] = merges[pair][1], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (p := (ids[a], ids[after[a]])) in merges:
                    heapq.heappush(heap, (merges[p][0], a, p))
        return [x for x, own in zip(ids, alive) if own]

    def word(self, word: str) -> bytes:
        """The ids of one pre-token, as little-endian int32."""
        got = self.words.get(word)
        if got is None:
            got = self._ids(word.encode("utf-8", "surrogatepass"))
            _keep(self.words, word, got)
        return got

    def _ids(self, word: bytes) -> bytes:
        fragments, merge = self.fragments(word), self.compiled or self.merge
        if len(fragments) == 1:
            out = merge(word)
        else:
            out, single = [], self.single
            for f in fragments:
                if len(f) > 1:
                    out += merge(f)
                else:
                    out.append(single[f[0]])
        n = len(out)
        return PACKED[n](*out) if n < len(PACKED) else struct.pack(f"<{n}i", *out)

    def spaced(self, rest: str) -> bytes:
        """The ids of a space and the text up to the next one."""
        if rest.isalpha():  # letters alone, so one pre-token
            got = self._ids((" " + rest).encode("utf-8", "surrogatepass"))
        elif rest[-1:] in ENDS and (stem := rest[:-1]).isalpha():  # such a word and a mark, a pre-token of its own
            got = (self.table.get(stem) or self.spaced(stem)) + self.word(rest[-1])
        else:
            got = b"".join(map(self.word, pre_tokens(" " + rest)))
        _keep(self.table, rest, got)
        return got

    def _encoded(self, text: str) -> bytes:
        """A text without added tokens. No pre-token crosses a space that has no white space beside it, so what
        stands between two such spaces is encoded alone, and remembered."""
        if not text:
            return b""
        if not _apart(text):
            return b"".join(map(self.word, pre_tokens(text)))
        get, spaced = self.table.get, self.spaced
        first, *rest = text.split(" ")
        parts = [get(x) or spaced(x) for x in rest]
        return b"".join([*map(self.word, pre_tokens(first)), *parts])

    def encode_bytes(self, text: str) -> bytes:
        """The text's ids as little-endian int32."""
        if not (self.added_split and any(t in text for t in self.added)):
            return self._encoded(text)
        parts = self.added_split.split(text)
        return b"".join(np.array([self.added[p]], "<i4").tobytes() if k % 2 else self._encoded(p) for k, p in enumerate(parts))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _ids(bpe: ByteBpe, texts: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(bpe.encode_bytes(t) if t else b"", "<i4") for t in texts.to_pylist()]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and `ids`: each whole text's token ids."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], _lists(_ids(bpe, part.column(len(keep))))], [*keep, "ids"])

    source = df.select(*keep, F.col(text_col).alias("__quill_text"))
    return source.mapInArrow(tidied(run), f"{fields}, ids array<int>")


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The columns named in keep, and `decoded`: the text of each id list, special tokens included."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [bpe.decode(ids) if ids else "" for ids in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "decoded"])

    return df.select(*keep, F.col(ids_col).alias("__quill_ids")).mapInArrow(tidied(run), f"{fields}, decoded string")


def round_trip(df: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode() then decode() in one pass over the texts: the columns in keep, ids and decoded."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = _ids(bpe, part.column(len(keep)))
                texts = pa.array([bpe.decode(ids.tolist()) for ids in lists], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], _lists(lists), texts], [*keep, "ids", "decoded"])

    return df.select(*keep, F.col(text_col).alias("__quill_text")).mapInArrow(tidied(run), f"{fields}, ids array<int>, decoded string")
