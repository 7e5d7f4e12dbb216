"""BPE encoding and decoding, with tree concatenation for long unsplit text.

Encoding equals ``Tokenizer.encode(text, add_special_tokens=False)`` of the tokenizers library for the vocabulary file
given by its path, with truncation and padding off; decoding equals ``decode(ids, skip_special_tokens=False)``. The
vocabulary splits at white space, so a text is encoded word by word: Arrow finds the distinct words of about ``CHUNK``
bytes of texts, the library encodes those that the task does not know (many in a call; it keeps at most ``CACHE``
words), and numpy puts the ids of all texts together.

A text of more than ``LONG`` code points is spread over the cluster:

1. It is cut at white space into segments, and a run without white space that is itself longer than ``LONG`` is brought
   to the vocabulary's units (normalised, pre-tokenized). A unit longer than ``LEAF`` symbols is halved until its
   leaves are short enough.
2. Segments and leaves are rows of their own and are encoded in parallel; only ids are shuffled, and batches of about
   ``CHUNK`` bytes of text bound a task's memory.
3. The leaves of a unit are concatenated as a tree: at each join a window of tokens on both sides is encoded again, and
   it doubles until its first tokens are the left side's and its last tokens are the right side's (or it covers the
   side). A sequence of tokens is the encoding of its text exactly when every adjacent pair is, and each pair then lies
   inside one valid encoding: left, window or right.

NULL and empty texts have no tokens. Rows are encoded one by one; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.llm.common import SPACE_CHARS, SPACE_RE, text_of

LONG = 32_768
LEAF = 4_096
CACHE = 300_000
CHUNK = 1 << 20
CALL = 4_096
BLOCK = 1 << 18
_AGREE = 2
_SPACE = re.compile(SPACE_RE)
_loaded: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """A tokenizer file with what the tree needs: units of a text and plain encoders of symbols."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @cached_property
    def special(self) -> re.Pattern:
        added = [a.content for a in self.whole.get_added_tokens_decoder().values()]
        return re.compile("|".join(sorted(map(re.escape, added), key=len, reverse=True)) or r"(?!)")

    @cached_property
    def plain(self) -> tuple:
        """Encoders of symbols inside a unit and at its end, and the suffix of an end."""
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = lambda **more: Tokenizer(BPE(vocab=model["vocab"], merges=merges, **more))
        inner = made()
        return inner, made(end_of_word_suffix=suffix) if suffix else inner, suffix

    @cached_property
    def spellings(self) -> pa.StringArray:
        """By id: a space and the token."""
        tokens = {i: token for token, i in self.whole.get_vocab(with_added_tokens=True).items()}
        return pa.array([f" {tokens.get(i, '')}" for i in range(max(tokens) + 1)], pa.string())

    @cached_property
    def numerals(self) -> pa.StringArray:
        """By id: a space and the id."""
        return pa.array([f" {i}" for i in range(len(self.spellings))], pa.string())

    @staticmethod
    def load(path: str) -> "Vocabulary":
        if path not in _loaded:
            _loaded[path] = Vocabulary(path)
        return _loaded[path]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids (int32) of each of some distinct runs without white space."""
        out: list[bytes | None] = []
        for w in words:
            got = self.young.get(w)
            if got is None:
                got = self.old.get(w)
                if got is not None:
                    self._keep(w, got)
            out.append(got)
        new = [i for i, got in enumerate(out) if got is None]
        for at in range(0, len(new), CALL):
            some = new[at : at + CALL]
            made = self.whole.encode([words[i] for i in some], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(made.ids, np.int32).tobytes()
            ends = 4 * np.cumsum(np.bincount(np.array(made.word_ids, np.int64), minlength=len(some)))
            start = 0
            for i, end in zip(some, ends.tolist()):
                out[i] = ids[start:end]
                start = end
                if len(words[i]) < 100:
                    self._keep(words[i], out[i])
        return out

    def _keep(self, word: str, ids: bytes) -> None:
        if len(self.young) >= CACHE // 2:  # words met since the last turn stay
            self.old, self.young = self.young, {}
        self.young[word] = ids

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        known = self.words(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        store = np.frombuffer(b"".join(known), np.int32)
        place = coded.indices.to_numpy()
        size = sizes[place]
        edges = np.concatenate(([0], np.cumsum(size)))
        ids = store[np.repeat((np.cumsum(sizes) - sizes)[place] - edges[:-1], size) + np.arange(edges[-1])]
        ends = edges[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def written(self, table: pa.StringArray, ids: np.ndarray) -> Iterator[memoryview]:
        """The table's entries of ids, joined by a space, in parts (UTF-8)."""
        for at in range(0, len(ids), BLOCK):
            taken = table.take(pa.array(ids[at : at + BLOCK]))
            ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset)
            yield memoryview(taken.buffers()[2])[int(ends[0]) + (at == 0) : int(ends[-1])]

    def decoded(self, ids: np.ndarray) -> Iterator[memoryview | bytes]:
        """The text of ids, in parts (UTF-8); without a decoder it is the tokens joined by a space."""
        if self.whole.decoder is None:
            yield from self.written(self.spellings, ids)
        else:
            yield self.whole.decode(ids.tolist(), skip_special_tokens=False).encode()

    def units(self, run: str) -> Iterator[tuple[bool, str]]:
        """(special?, symbols) of a run without white space; each unit is merged by itself."""
        at = 0
        for m in [*self.special.finditer(run), None]:
            part = run[at : m.start() if m else len(run)]
            if part:
                part = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for symbols, _ in self.whole.pre_tokenizer.pre_tokenize_str(part):
                    yield False, symbols
            if m:
                yield True, m.group()
                at = m.end()

    def symbols(self, symbols: str, end: bool) -> list[int]:
        """Token ids of symbols that are the end of a unit, or not."""
        return self.plain[1 if end else 0].encode(symbols, add_special_tokens=False).ids

    def spell(self, ids: list[int]) -> str:
        """The symbols of tokens."""
        out = "".join(map(self.whole.id_to_token, ids))
        return out.removesuffix(self.plain[2])

    def concatenate(self, left: list[int], right: list[int], end: bool) -> list[int]:
        """The encoding of both sides' text from the sides' encodings. end: the right side ends the unit."""
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            all_left, all_right = len(a) == len(left), len(b) == len(right)
            window = self.symbols(self.spell(a) + self.spell(b), end and all_right)
            if (all_left or window[:_AGREE] == a[:_AGREE]) and (all_right or window[-_AGREE:] == b[-_AGREE:]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """The encoding of a unit from its leaves' encodings, joined in pairs."""
        while len(leaves) > 1:
            paired = range(0, len(leaves) - 1, 2)
            joined = [self.concatenate(leaves[i], leaves[i + 1], i + 2 == len(leaves)) for i in paired]
            leaves = joined + leaves[2 * len(paired) :]
        return leaves[0]


def _halves(symbols: str, leaf: int) -> Iterator[str]:
    if len(symbols) <= leaf:
        yield symbols
    else:
        yield from _halves(symbols[: len(symbols) // 2], leaf)
        yield from _halves(symbols[len(symbols) // 2 :], leaf)


def pieces(vocabulary: Vocabulary, text: str, long: int = LONG, leaf: int = LEAF) -> Iterator[tuple[int, bool, str]]:
    """(unit, last leaf of the unit?, text) in order; unit -1: a segment of text, -2: a special token. One piece at least."""
    unit, at, none = 0, 0, True
    while len(text) - at > long:
        end = max(text.rfind(c, at, at + long + 1) for c in SPACE_CHARS)
        if end > at:
            yield -1, True, text[at:end]
            none = False
        if end >= at:
            at = end + 1
            continue
        found = _SPACE.search(text, at + long)
        end = found.start() if found else len(text)
        for special, symbols in vocabulary.units(text[at:end]):
            none = False
            if special:
                yield -2, True, symbols
                continue
            held = None
            for part in _halves(symbols, leaf):
                if held is not None:
                    yield unit, False, held
                held = part
            yield unit, True, held
            unit += 1
        at = end
    if at < len(text) or none:
        yield -1, True, text[at:]


Finish = Callable[[Vocabulary, np.ndarray], tuple]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
_PIECE = "row long, id long, seq int, unit int, last boolean, text string"
_CODED = "row long, id long, seq int, unit int, ids array<int>"


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, schema.split(", "))])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, with about ``CHUNK`` bytes of text in a batch."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK)) + 1).tolist(), len(ends)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield b.slice(start, end - start)


def _direct(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch], finish: Finish, schema: str) -> Iterator[pa.RecordBatch]:
    for b in _chunks(batches):
        yield _batch([(i, *finish(vocabulary, ids)) for i, ids in zip(b.column("id").to_pylist(), vocabulary.texts(b.column("text")))], schema)


def _cut(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch], long: int, leaf: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, i, text in zip(b.column("row"), b.column("id"), b.column("text")):
            held, size = [], 0
            for seq, piece in enumerate(pieces(vocabulary, text.as_py(), long, leaf)):
                held.append((row.as_py(), i.as_py(), seq, *piece))
                size += len(piece[-1])
                if size >= CHUNK:
                    yield _batch(held, _PIECE)
                    held, size = [], 0
            if held:
                yield _batch(held, _PIECE)


def _code(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _chunks(batches):
        unit, text = b.column("unit"), b.column("text")
        leaves = pc.greater_equal(unit, 0)
        ids = vocabulary.texts(pc.if_else(leaves, "", text))
        for k in np.flatnonzero(leaves.to_numpy(zero_copy_only=False)).tolist():
            ids[k] = np.array(vocabulary.symbols(text[k].as_py(), b.column("last")[k].as_py()), np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.list_(pa.int32()))], schema=_arrow(_CODED))


def _concatenate(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch], finish: Finish, schema: str) -> Iterator[pa.RecordBatch]:
    row, doc, parts, leaves, unit = None, None, [], [], -1

    def close_unit():
        if leaves:
            parts.append(np.array(vocabulary.tree(list(leaves)), np.int32))
            leaves.clear()

    def close():
        close_unit()
        return _batch([(doc, *finish(vocabulary, np.concatenate(parts)))], schema)

    for b in batches:
        for r, i, u, ids in zip(b.column("row").to_pylist(), b.column("id").to_pylist(), b.column("unit").to_pylist(), b.column("ids")):
            if r != row:
                if row is not None:
                    yield close()
                row, doc, unit = r, i, -1
                parts.clear()
            if u != unit:
                close_unit()
                unit = u
            if u >= 0:
                leaves.append(ids.as_py())
            else:
                parts.append(ids.values.to_numpy())
    if row is not None:
        yield close()


def _run(docs: DataFrame, path: str, finish: Finish, schema: str, long: int, leaf: int) -> DataFrame:
    """``docs``: id, text. A row (id, *finish(vocabulary, ids of its tokens)) for every row."""
    short = docs.filter(F.length("text") <= long).mapInArrow(lambda batches: _direct(Vocabulary.load(path), batches, finish, schema), schema)
    tall = docs.filter(F.length("text") > long).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    cut = tall.mapInArrow(lambda batches: _cut(Vocabulary.load(path), batches, long, leaf), _PIECE)
    made = cut.repartition("row", "seq").mapInArrow(lambda batches: _code(Vocabulary.load(path), batches), _CODED)
    whole = made.repartition("row").sortWithinPartitions("row", "seq")
    return short.unionByName(whole.mapInArrow(lambda batches: _concatenate(Vocabulary.load(path), batches, finish, schema), schema))


def encode(docs: DataFrame, path: str, id_col="doc_id", text_col="text", long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    whole = lambda vocabulary, ids: (ids, b"".join(vocabulary.decoded(ids)).decode())
    return _run(rows, path, whole, "doc_id long, ids array<int>, decoded string", long, leaf)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns with the decoded text of a column of ids; NULL ids decode to NULL."""
    schema = StructType.fromJson(encoded.schema.jsonValue()).add(out, "string")
    place = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Vocabulary.load(path).whole
        for b in batches:
            texts = [None if i is None else whole.decode(i, skip_special_tokens=False) for i in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema.names)

    return encoded.mapInArrow(run, schema)


def token_report(docs: DataFrame, path: str, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """doc_id, number of tokens and digests of the ids and of the decoded text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of("text").alias("text"))
    digests = lambda vocabulary, ids: (len(ids), _sha256(vocabulary.written(vocabulary.numerals, ids)), _sha256(vocabulary.decoded(ids)))
    return _run(rows, path, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", long, leaf)


def _sha256(parts: Iterator[memoryview | bytes]) -> str:
    made = hashlib.sha256()
    for part in parts:
        made.update(part)
    return made.hexdigest()
