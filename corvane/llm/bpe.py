"""BPE encoding and decoding of whole texts by tree concatenation.

No token spans white space, so a text is encoded by its runs without any. A
run that is itself long ("unsplit" text) is cut into halves until a part has at
most LEAF_CHARS characters; the parts are encoded on their own and neighbours
are joined pairwise: a window of words on both sides of the join is split again
and grows until its outermost words are those that both sides already have.

A word that is very long is joined in the same way with tokens for units: two
neighbouring tokens that stand side by side in some valid encoding are
compatible, and a sequence whose neighbours are all compatible is the
encoding, so agreement of the window's outermost tokens proves the join. Only
the windows' tokens are merged again, however long the word.

Texts over SPREAD_CHARS are dealt out in parts to all tasks. Cuts are made only
where both sides are normalised independently and no special token is cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import pickle
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import tidy

LEAF_CHARS = 4096
#: Texts longer than this are dealt out as rows, one for each part of a quarter of that.
SPREAD_CHARS = 65_536
#: A cut is made at the first fit place in so many characters; and no special token is longer.
ZONE = 64
#: Words with more symbols than this are encoded by halves.
LEAF_SYMBOLS = 256
#: Bytes of runs and words, each, that a worker keeps during a task, about.
CACHE_BYTES = 64 << 20
#: The separators of str.split() that the tokenizer takes for text.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[^\\S\x1c-\x1f]+")


def runs(text: str) -> list[str]:
    """The runs of a text without white space, as the tokenizer sees it."""
    return [c for c in _SPACE.split(text) if c] if _ODD.search(text) else text.split()


@cache
def _seconds() -> frozenset[int]:
    """Characters that may be composed with the one before them."""
    found = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and finals of Hangul
    for cp in range(0x30000):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            found.add(int(parts[1], 16))
    return frozenset(found)


def _fit(text: str, at: int, special: list[str]) -> bool:
    """Whether a text can be cut before its character `at`: what follows is normalised on its own, and no special token is cut."""
    c = text[at]
    if ord(c) >= 0x300:
        c = unicodedata.normalize("NFD", c)[0]
        if unicodedata.combining(c) or ord(c) in _seconds():
            return False
    return not any(s in text[max(0, at - len(s) + 1) : at + len(s) - 1] for s in special)


def cut_near(text: str, at: int, special: list[str]) -> int | None:
    """The first fit place for a cut from `at` on, within ZONE characters."""
    return next((i for i in range(at, min(at + ZONE, len(text))) if _fit(text, i, special)), None)


class SymbolBpe:
    """Byte-pair merges of one word's symbols, by halves."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges, lowest rank first and leftmost among equals."""
        left, right, alive = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1)), [True] * len(symbols)
        out, heap = list(symbols), []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(out) and (r := self.rank.get((out[i], out[j]))) is not None:
                heapq.heappush(heap, (r, i, out[i], out[j]))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not alive[i] or out[i] != a or (j := right[i]) >= len(out) or out[j] != b:
                continue
            out[i], alive[j], right[i] = a + b, False, right[j]
            if right[j] < len(out):
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [t for t, live in zip(out, alive, strict=True) if live]

    def symbols_of(self, tokens: list[str]) -> list[str]:
        """A token's symbols: its characters, the last one with the word's end mark if the token has it."""
        found: list[str] = []
        for t in tokens:
            if self.end and t.endswith(self.end):
                found += [*t[: -len(self.end) - 1], t[-len(self.end) - 1 :]]
            else:
                found += t
        return found

    def join(self, a: list[str], b: list[str]) -> list[str]:
        if not a or not b:
            return a + b
        k = 2
        while True:
            left, right = a[-k:], b[:k]
            window = self.merge(self.symbols_of(left + right))
            whole_left, whole_right = len(left) == len(a), len(right) == len(b)
            if (whole_left or window[0] == left[0]) and (whole_right or window[-1] == right[-1]):
                if len(window) > 1 or (whole_left and whole_right):
                    return a[: len(a) - len(left)] + window + b[len(right) :]
            k *= 2

    def encode(self, word: str) -> list[str]:
        """Tokens of one pre-tokenized word (in the tokenizer's byte alphabet)."""
        return self.tree([*word[:-1], word[-1] + self.end]) if word else []

    def close(self, tokens: list[str]) -> list[str]:
        """Tokens of a word whose end mark is still missing, with it."""
        last = tokens[-1]
        tail = [last[-1] + self.end]
        return self.join(self.join(tokens[:-1], self.merge([*last[:-1]])), tail) if len(tokens) > 1 or len(last) > 1 else tail

    def tree(self, symbols: list[str]) -> list[str]:
        if len(symbols) <= LEAF_SYMBOLS:
            return self.merge(symbols)
        mid = len(symbols) // 2
        return self.join(self.tree(symbols[:mid]), self.tree(symbols[mid:]))


#: Below this code point letters, numbers and lower case are the same in all versions of Unicode, and texts are in NFC as they are.
_PLAIN = 0x250


def _class(kind: str) -> str:
    """Members of a general category below _PLAIN, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] == kind)


#: The tokenizer's split of a chunk into words, for plain chunks.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")
_NOT_PLAIN = re.compile(f"[^\t-\r\x20-\x7e\xa1-\u012f\u0131-{chr(_PLAIN - 1)}]|<\\|")


#: The same for whole texts, in the syntax of Arrow's regular expressions; chunks() must split them at ASCII white space only.
_ODD_TEXT = f"[^\\t-\\r\\x20-\\x7e\\x{{a1}}-\\x{{12f}}\\x{{131}}-\\x{{{_PLAIN - 1:x}}}]|<\\|"


class _Memo(dict):
    """Values of a function by argument, made when first asked for.

    When the newer half of the bytes is used up, what the older half holds and
    was not asked for since then is forgotten: common words stay, rare ones go.
    """

    def __init__(self, make, most: int = CACHE_BYTES):
        super().__init__()
        self.make, self.most, self.size, self.old = make, most, 0, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LEAF_SYMBOLS:
            self.size += 200 + len(key) + len(value)
            if self.size > self.most // 2:
                self.old, self.size = dict(self), 0
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.size = {}, 0


class Decoder:
    """Ids -> text by the tokenizer's own rules; without any, tokens stand side by side with a space between."""

    def __init__(self, tok):
        self.tok = tok
        tokens = {i: t for t, i in tok.get_vocab(with_added_tokens=True).items()}
        self.tokens = None if tok.decoder is not None else [tokens.get(i) for i in range(max(tokens, default=-1) + 1)]

    def decode(self, ids: np.ndarray) -> str:
        """As decode(ids, skip_special_tokens=False); ids that no token has are left out."""
        if self.tokens is None:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False)
        try:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        except (IndexError, TypeError):
            return " ".join([t for i in ids.tolist() if i < len(self.tokens) and (t := self.tokens[i]) is not None])


class Word:
    """A word of unsplit text: its normalised characters, and its ids, or for a very long one its tokens without the end mark."""

    __slots__ = ("text", "ids", "open")

    def __init__(self, text: str, ids: bytes | None, open_: list[str] | None = None):
        self.text, self.ids, self.open = text, ids, open_


class Part:
    """An encoded part of a text.

    first and last are the words that touch the part's ends, body has the ids
    between them; last is None if the part has neither white space nor a special
    token, when first touches both ends.
    """

    __slots__ = ("first", "body", "last")

    def __init__(self, first: list[Word], body: bytes = b"", last: list[Word] | None = None):
        self.first, self.body, self.last = first, body, last


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.path = path
        self.decoder = Decoder(self.tok)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self._symbols: SymbolBpe | None = None
        self.word_ids = _Memo(self._word_ids)
        self.plain_ids = _Memo(lambda c: b"".join(map(self.word_ids.__getitem__, _WORDS.findall(c))))
        self.run_ids = _Memo(lambda c: b"".join(map(self.word_ids.__getitem__, _WORDS.findall(c.lower()))) if not _NOT_PLAIN.search(c) else self._odd_run(c))

    def forget(self) -> None:
        """Drop all memos; a task's common words are soon learned again."""
        for memo in (self.word_ids, self.plain_ids, self.run_ids):
            memo.forget()

    @property
    def symbols(self) -> SymbolBpe:
        self._symbols = self._symbols or SymbolBpe(self.path)
        return self._symbols

    def _packed(self, tokens: list[str]) -> bytes:
        vocab = self.symbols.vocab
        return struct.pack(f"<{len(tokens)}I", *[vocab[t] for t in tokens])

    def _raw_ids(self, raw: str) -> bytes:
        """Ids of a word in the tokenizer's byte alphabet; a very long one goes through the tree."""
        if len(raw) > LEAF_SYMBOLS:
            return self._packed(self.symbols.encode(raw))
        ids = [t.id for t in self.tok.model.tokenize(raw)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word_ids(self, word: str) -> bytes:
        """Ids of a word of plain text, in lower case."""
        return self._raw_ids(word if word.isascii() else self.tok.pre_tokenizer.pre_tokenize_str(word)[0][0])

    def _odd_run(self, run: str) -> bytes:
        """Ids of a run with rarer characters or special tokens, by the library but for very long words."""
        if len(run) <= LEAF_SYMBOLS:
            ids = self.tok.encode(run, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([self._raw_ids(w) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(run))])

    def ids(self, text: str) -> bytes:
        """Ids of a whole text."""
        if "<|" in text and self.split_special.search(text):
            return b"".join(self._pieces(text))
        got = runs(text)
        if len(text) <= LEAF_CHARS or max(map(len, got), default=0) <= LEAF_CHARS:
            return b"".join(map(self.run_ids.__getitem__, got))
        return b"".join([self.run_ids[r] if len(r) <= LEAF_CHARS else self._closed(self.tree(r)) for r in got])

    def _pieces(self, text: str) -> Iterator[bytes]:
        """Ids of a text between special tokens, and theirs."""
        at = 0
        for m in self.split_special.finditer(text):
            yield self.ids(text[at : m.start()])
            yield self.tok.token_to_id(m[0]).to_bytes(4, "little")
            at = m.end()
        yield self.ids(text[at:])

    def batch_ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each whole text of an array of strings without nulls.

        Plain texts are split and their distinct runs found by Arrow, so each
        of those is looked up once a batch, and numpy lays out the ids.
        """
        odd = pc.or_(pc.match_substring_regex(texts, _ODD_TEXT), pc.match_substring_regex(texts, rf"\S{{{LEAF_SYMBOLS}}}"))
        units = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        coded = units.flatten().dictionary_encode()
        distinct = coded.dictionary
        every = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct)
        known = list(map(self.plain_ids.__getitem__, pc.binary_join(every, " ")[0].as_py().split(" "))) if len(distinct) else []
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids = np.frombuffer(b"".join(known), "<u4")
        start = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        end = np.cumsum(n)
        flat = ids[np.repeat(start[at] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]
        cuts = np.concatenate([[0], end])[units.offsets.to_numpy()]
        out = [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[k] = np.frombuffer(self.ids(texts[k].as_py()), "<u4")
        return out

    # unsplit text: runs of words without white space or special tokens

    def words(self, norm: str) -> list[tuple[str, str]]:
        """(word, the same in the byte alphabet) of normalised text."""
        return [(norm[i:j], raw) for raw, (i, j) in self.tok.pre_tokenizer.pre_tokenize_str(norm)]

    def word(self, text: str, raw: str) -> Word:
        return Word(text, self._raw_ids(raw)) if len(raw) <= LEAF_SYMBOLS else Word(text, None, self.symbols.tree([*raw]))

    def _word_bytes(self, w: Word) -> bytes:
        return w.ids if w.open is None else self._packed(self.symbols.close(w.open))

    def _closed(self, words: list[Word]) -> bytes:
        return b"".join(map(self._word_bytes, words))

    def leaf(self, run: str) -> list[Word]:
        return [self.word(*w) for w in self.words(self.tok.normalizer.normalize_str(run))]

    def join(self, a: list[Word], b: list[Word]) -> list[Word]:
        """The words of two neighbouring parts of a run: a window around the join is split again and grows until its outermost words are as they were."""
        if not a or not b:
            return a + b
        k = 1
        while True:
            left, right = a[-k:], b[:k]
            window = self.words("".join([w.text for w in left + right]))
            whole_left, whole_right = k >= len(a), k >= len(b)
            if (whole_left or (k > 1 and window[0][0] == left[0].text)) and (whole_right or (k > 1 and window[-1][0] == right[-1].text)):
                break
            k *= 2
        same = 0
        while same < min(len(window), len(left)) and window[same][0] == left[same].text:
            same += 1
        tail = 0
        while tail < min(len(window) - same, len(right)) and window[-1 - tail][0] == right[-1 - tail].text:
            tail += 1
        middle = [self._joined(t, raw, left[-1], right[0]) for t, raw in window[same : len(window) - tail]]
        return a[: len(a) - len(left)] + left[:same] + middle + (right[len(right) - tail :] if tail else []) + b[len(right) :]

    def _joined(self, text: str, raw: str, a: Word, b: Word) -> Word:
        """A new word; of two parts with many symbols, only tokens around their join are merged again."""
        if len(raw) <= LEAF_SYMBOLS or text != a.text + b.text:
            return self.word(text, raw)
        opened = [w.open if w.open is not None else self.symbols.merge([*self.tok.pre_tokenizer.pre_tokenize_str(w.text)[0][0]]) for w in (a, b)]
        return Word(text, None, self.symbols.join(*opened))

    def tree(self, run: str) -> list[Word]:
        """Words of a run, by halves."""
        at = cut_near(run, len(run) // 2, self.special) if len(run) > LEAF_CHARS else None
        return self.leaf(run) if at is None else self.join(self.tree(run[:at]), self.tree(run[at:]))

    # parts of texts that are dealt out

    def part(self, text: str) -> Part:
        """A part of a text: the words at its ends stay open, what is between is encoded."""
        marks = [m.span() for m in self.split_special.finditer(text)]
        begin = marks[0][0] if marks else len(text)
        end = marks[-1][1] if marks else 0
        head, tail = _EDGE.match(text, 0, begin).end(), len(text) - _EDGE.match(text[::-1], 0, len(text) - end).end()
        if head == len(text) and not marks:
            return Part(self.tree(text))
        return Part(self.tree(text[:head]), self.ids(text[head:tail]), self.tree(text[tail:]))

    def join_parts(self, a: Part, b: Part) -> Part:
        if a.last is None and b.last is None:
            return Part(self.join(a.first, b.first))
        if a.last is None:
            return Part(self.join(a.first, b.first), b.body, b.last)
        if b.last is None:
            return Part(a.first, a.body, self.join(a.last, b.first))
        return Part(a.first, a.body + self._closed(self.join(a.last, b.first)) + b.body, b.last)

    def fold(self, parts: list[Part]) -> bytes:
        """Neighbouring parts joined pairwise, level by level; the ids of all."""
        while len(parts) > 1:
            parts = [self.join_parts(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return b"".join([self._closed(p.first) + p.body + self._closed(p.last or []) for p in parts])


#: What touches an end of a part: no white space of the tokenizer's.
_EDGE = re.compile("(?:[^\\s]|[\x1c-\x1f])*")

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _digest(enc: Encoder, ids: bytes) -> tuple[int, str, str]:
    text = enc.decoder.decode(np.frombuffer(ids, "<u4"))
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each whole text, in one task per text. A null text is empty: no ids."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.batch_ids(b.column(1).fill_null("")), pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row's ids, special tokens included. Null ids are none: an empty text; ids that no token has are left out."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = encoder(path).decoder
        for b in it:
            texts = [decoder.decode(np.array([i for i in ids or [] if i is not None], np.int64)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(batches, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text: encoded, and its ids decoded again.

    Texts up to SPREAD_CHARS are encoded in one task; longer ones are dealt out
    in parts to all tasks, encoded there, and joined per text. A text with no fit
    place for a cut in a whole zone (ZONE combining marks in a row) is encoded
    in the task that joins it. Null texts are empty, rows with a null id keep it,
    repeated rows each give a row; an empty table gives no rows; extra columns
    are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = src.filter(F.length("text") <= SPREAD_CHARS)
    long = src.filter(F.length("text") > SPREAD_CHARS)
    out = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    kinds = (pa.int64(), pa.string(), pa.string())

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in it:
            rows = [_digest(enc, enc.ids(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    step = SPREAD_CHARS // 4
    # each part with the zones in which its two cuts lie, and what may be a special token before the first
    around = f"transform(sequence(0, n - 1, {step}), i -> substring(text, greatest(i - {ZONE}, 0) + 1, {step} + least(i, {ZONE}) + 2 * {ZONE}))"
    parts = (
        long.withColumn("copy", F.monotonically_increasing_id())
        .withColumn("n", F.length("text"))
        .select("doc_id", "copy", F.posexplode(F.expr(around)).alias("at", "part"))
        .repartition("doc_id", "at")
    )

    def encode_parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in it:
            got = []
            for at, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                before = min(at * step, ZONE)
                begin = cut_near(t, before, enc.special) if at else 0
                end = cut_near(t, before + step, enc.special) if before + step < len(t) else len(t)
                raw = t[before : before + step]
                got.append(pickle.dumps((raw, None if begin is None or end is None else enc.part(t[begin:end]))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(got, pa.binary())], ["doc_id", "copy", "at", "part"])

    encoded = parts.mapInArrow(encode_parts, f"doc_id {kind}, copy bigint, at int, part binary")

    def rejoin(table: pa.Table) -> pa.Table:
        enc = encoder(path)
        got = [pickle.loads(p) for _, p in sorted(zip(table.column("at").to_pylist(), table.column("part").to_pylist()))]
        ids = enc.fold([p for _, p in got]) if all(p for _, p in got) else enc.ids("".join([raw for raw, _ in got]))
        n, a, b = _digest(enc, ids)
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [a], "decoded_sha256": [b]})

    joined = encoded.groupBy("doc_id", "copy").applyInArrow(rejoin, out)
    return short.mapInArrow(lambda it: tidy(whole(it), lambda: encoder(path).forget()), out).unionByName(joined)
