"""Byte-level BPE by a deterministic automaton over tokens, compiled merge by merge."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import release_memory, small_batches

#: Fixed: the pre-split pattern of byte-level vocabularies.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a process remembers; beyond that it starts afresh.
CACHED_WORDS = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States are what may follow a token; arcs are labelled with tokens.

    A path from the start spells a token sequence that BPE produces, and each byte string has
    one. Tokens with the same state share a row of the transition table, tokens that are
    allowed after the same states share a column.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.special = special
        self._words: Words | None = None
        size = max([*labels, *special.values()]) + 1
        row_of, col_of = np.zeros(size, np.int32), np.zeros(size, np.int32)
        sharing_row, sharing_col = [0] * (len(merges) + 3), [0] * (len(merges) + 3)
        table = np.zeros((4096, 512), np.uint8)  # a column of the transitions a row, its rows as bits
        table[0, 0] = 1  # column 1 allows nothing
        made = {m[2] for m in merges}
        sharing_row[0] = sharing_col[0] = len(labels) - len(made)
        rows, cols, dead = 1, 2, 1
        for left, right, token in merges:
            # the merge gadget: after `left`, `right` is no longer read; `token` is read wherever
            # `left` was, and leads to where `right` led
            fires = table[col_of[right], row_of[left] >> 3] >> (row_of[left] & 7) & 1
            row_of[token] = row_of[right]
            sharing_row[row_of[token]] += 1
            if not fires:
                col_of[token] = dead
                continue
            if sharing_row[row_of[left]] > 1:
                if rows == table.shape[1] * 8:
                    table = np.concatenate((table, np.zeros_like(table)), axis=1)
                bit = table[:cols, row_of[left] >> 3] >> np.uint8(row_of[left] & 7) & np.uint8(1)
                table[:cols, rows >> 3] |= bit << np.uint8(rows & 7)
                sharing_row[row_of[left]] -= 1
                row_of[left], sharing_row[rows], rows = rows, 1, rows + 1
            if sharing_col[col_of[right]] > 1:
                if cols == len(table):
                    table = np.concatenate((table, np.zeros_like(table)))
                table[cols] = table[col_of[right]]
                sharing_col[col_of[right]] -= 1
                col_of[right], sharing_col[cols], cols = cols, 1, cols + 1
            table[col_of[right], row_of[left] >> 3] &= np.uint8(~(1 << (row_of[left] & 7)) & 255)
            col_of[token] = col_of[left]
            sharing_col[col_of[token]] += 1
        packed = lambda row: np.packbits(row, bitorder="little").tobytes()
        self.start = packed(np.arange(cols) != dead)
        self.rows: list[bytes] = []
        for lo in range(0, rows, 1024):
            block = np.unpackbits(table[:cols, lo >> 3 : (lo + 1024) >> 3], axis=1, bitorder="little")
            self.rows += map(packed, block.T[: rows - lo])
        self.row_of, self.col_of = row_of.tolist(), col_of.tolist()
        self.labels = [labels.get(i, b"") for i in range(size)]
        for text, i in special.items():
            self.labels[i] = text.encode()
        # the labels of the arcs as one table: (place in a label, next byte) -> place, and the token that ends there
        self.steps: dict[int, int] = {}
        self.token_at = [-1]
        for i, label in labels.items():
            at = 0
            for byte in label:
                at = self.steps.setdefault(at << 8 | byte, len(self.token_at))
                if at == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[at] = i
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        """Compile the vocabulary and merges of a tokenizers JSON file of a byte-level model.

        What this operator doesn't do is an error and not passed over: another model or pre-split, a normaliser,
        and added tokens that strip, stand alone or are normalised.
        """
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or split.get("use_regex") is False:
            raise ValueError(f"{path} is no byte-level BPE with the usual pre-split")
        if spec.get("normalizer"):
            raise ValueError(f"{path} has a normaliser")
        if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} has added tokens that strip or stand alone")
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        spell = lambda word: bytes(alphabet[c] for c in word)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        labels = {i: spell(w) for w, i in vocab.items() if w not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], special)
        release_memory()
        return made

    def words(self) -> Words:
        """The word table of this process; it goes with the automaton when its broadcast does."""
        if self._words is None:
            self._words = Words(self)
        return self._words

    def encode_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word: from each reached position, step through the table by
        the bytes that come next and take every arc that ends and which the state there has. Each position is
        reached by one token."""
        steps, token_at, rows, row_of, col_of = self.steps, self.token_at, self.rows, self.row_of, self.col_of
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if i and last[i] < 0:
                continue
            row = rows[row_of[last[i]]] if i else self.start
            at = 0
            for j in range(i, n):
                at = steps.get(at << 8 | word[j])
                if at is None:
                    break
                token = token_at[at]
                if token >= 0:
                    col = col_of[token]
                    if row[col >> 3] >> (col & 7) & 1:
                        last[j + 1], back[j + 1] = token, i
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special tokens, with whether the piece is one."""
        if not any(map(text.__contains__, self.special)):  # much faster than the pattern
            yield text, False
            return
        for k, piece in enumerate(self.split_special.split(text)):
            if piece:
                yield piece, bool(k & 1)

    def decode(self, ids: list[int]) -> str:
        """The labels of the ids, one after the other; what isn't UTF-8 is replaced."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class Words(dict):
    """Word -> its ids as little-endian 32-bit integers, filled on demand."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.find = automaton, regex.compile(PRE_SPLIT).findall

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.automaton.encode_word(word.encode()), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        get = self.__getitem__
        out = []
        for piece, special in self.automaton.pieces(text):
            if special:
                out.append(np.array([self.automaton.special[piece]], "<u4").tobytes())
            else:
                out += map(get, self.find(piece))
        return b"".join(out)


def _per_text(docs: DataFrame, path: str, make, schema: str, carry: list[str]) -> DataFrame:
    """make(words, text) -> tuple for each row, beside the columns of `carry`."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.from_file(path))  # size: that of the vocabulary
    small_batches(docs.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.words()
        kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        types = [kinds[x.strip().split(" ", 1)[1]] for x in schema.split(",")]
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for lo in range(0, batch.num_rows, 1024):
                made = [make(words, t.as_py() or "") for t in text.slice(lo, 1024)]
                rest = batch.slice(lo, 1024)
                cols = [rest.column(rest.schema.get_field_index(c)) for c in carry]
                new = [pa.array(list(x), t) for x, t in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, *new], names=[*carry, *names])
        release_memory()

    kept = docs.select(*carry, "text")
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name in carry)
    return kept.mapInArrow(run, f"{head}, {schema}")


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every whole text; null: no ids."""

    def make(words: Words, text: str) -> tuple:
        ids = np.frombuffer(words.encode(text), "<u4").astype(np.int32)
        return len(ids), ids

    return _per_text(docs, path, make, "n_tokens long, ids array<int>", ["doc_id"])


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids: empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Automaton.from_file(path))
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = [shared.value.decode(x.as_py() or []) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kept = encoded.select("doc_id", "ids")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digest(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, an array of int) for every row of docs.

    Encodes every whole text and decodes the ids again in one pass, without a shuffle; the
    automaton is broadcast (bounded by the vocabulary). Strings of special tokens in a text
    become that token's id, as the tokenizers library has it. Null and empty texts: 0 tokens
    and the hashes of nothing. Very long texts are encoded whole, a word at a time; a word of any length
    takes time in proportion to it. Repeated rows, null and shared doc_ids stay as they are; other columns are
    ignored, whatever their names. Empty input: no rows.
    """

    def make(words: Words, text: str) -> tuple:
        ids = words.encode(text)
        decoded = words.automaton.decode(np.frombuffer(ids, "<u4").tolist())
        digests = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        return (*digests, np.frombuffer(ids, "<i4")) if with_ids else digests

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _per_text(docs, path, make, schema, ["doc_id"])
