"""BPE encoding and decoding as streaming transducers of constant memory.

``Merges.lookahead`` is computed from the merge list: the bytes right of a token that can still change
it. Within a word a merge at rank ``r`` fails only if a merge of smaller rank takes its right part, so
outside influence runs along chains of falling rank, and the longest chain bounds the lookahead. A
token whose end lies at least that far from the end of what was read is stable. Words that are longer
than a block are therefore encoded block by block: stable tokens leave, the rest waits for more bytes.
Merges never cross a token border of the final answer, so what follows a stable token is encoded on its own.

Decoding is a state machine over ids: token bytes go through an incremental UTF-8 decoder that keeps at
most three bytes. What a task holds is a block of text, its ids, and a bounded memory of short words that is
dropped at its end.

A vocabulary is a JSON file in the format of the public ``tokenizers`` library: BPE with a word-end
suffix, NFC, white space folded, lower case, words cut by a pattern, bytes as printable letters.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import chunks, freeing

BLOCK = 4096
SHORT = 48  # up to so many symbols a plain search for the least rank is quicker than a heap
TEXT_BLOCK = 1 << 16  # characters of a text that are split into words at once
WORDS_KEPT = 100_000  # words in each of two generations of remembered words: some 40 MB, of words of up to 64 letters
_SHIFT = 20
_MASK = (1 << _SHIFT) - 1
_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """A merge list over token ids, ``(left, right, made)`` by rank, and its sufficient lookahead in symbols."""

    def __init__(self, merges: list[tuple[int, int, int]], sizes: dict[int, int]):
        self.merges, self.sizes = merges, sizes
        self.pairs = {a << _SHIFT | b: i << _SHIFT | made for i, (a, b, made) in enumerate(merges)}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Longest chain of merges of falling rank, each taking the part on which the one before depends."""
        made: dict[int, tuple[int, int]] = {}  # token -> rank and right part of the first merge that makes it
        for i, (_, b, token) in enumerate(self.merges):
            made.setdefault(token, (i, b))
        ranks: dict[int, list[int]] = {}  # by left part: ranks in order, and the farthest reach up to each
        reach: dict[int, list[int]] = {}

        def need(token: int, below: int) -> int:
            far, t, r = 0, token, below
            while True:
                at = bisect_left(ranks.get(t, []), r)
                if at:
                    far = max(far, reach[t][at - 1])
                if t not in made or made[t][0] >= r:
                    return far
                r, t = made[t]

        for i, (a, b, _) in enumerate(self.merges):
            w = self.sizes[b] + need(b, i)
            ranks.setdefault(a, []).append(i)
            before = reach.setdefault(a, [])
            before.append(max(w, before[-1] if before else 0))
        longest = max(self.sizes.values(), default=1)
        return longest + max((need(t, len(self.merges)) for t in self.sizes), default=0)

    def apply(self, symbols: list[int]) -> list[int]:
        """Merge in order of rank, leftmost first."""
        if len(symbols) > SHORT:
            return self._apply_long(symbols)
        get, part = self.pairs.get, list(symbols)
        ways = [get(a << _SHIFT | b, _NONE) for a, b in zip(part, part[1:])]
        while ways and (way := min(ways)) != _NONE:
            i = ways.index(way)
            part[i:i + 2] = [token] = [way & _MASK]
            del ways[i]
            if i < len(ways):
                ways[i] = get(token << _SHIFT | part[i + 1], _NONE)
            if i:
                ways[i - 1] = get(part[i - 1] << _SHIFT | token, _NONE)
        return part

    def _apply_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        n, get = len(symbols), self.pairs.get
        part, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(way, i, part[i], part[i + 1]) for i in range(n - 1) if (way := get(part[i] << _SHIFT | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            way, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = way & _MASK, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (way := get(part[i] << _SHIFT | part[k])) is not None:
                    heapq.heappush(heap, (way, i, part[i], part[k]))
            if (h := before[i]) >= 0 and (way := get(part[h] << _SHIFT | part[i])) is not None:
                heapq.heappush(heap, (way, h, part[h], part[i]))
        return [x for x in part if x >= 0]

    def stream(self, symbols: Iterable[int], block: int = BLOCK) -> Iterator[int]:
        """Tokens of one word, each as soon as no further symbol can change it."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= block + self.lookahead:
                done, stable = 0, len(held) - self.lookahead
                for token in self.apply(held):
                    if done + self.sizes[token] > stable:
                        break
                    done += self.sizes[token]
                    yield token
                if not done:  # never with a sound lookahead; read on rather than emit an unstable token
                    block *= 2
                held = held[done:]
        yield from self.apply(held)


class Vocabulary:
    """Ids, merges and text rules of one vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        first, second = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"], kinds, second["type"]) != ("BPE", ["NFC", "Replace", "Lowercase"], "ByteLevel") or model.get("unk_token"):
            raise ValueError(f"{path}: a BPE vocabulary with NFC, lower case and byte letters is wanted")
        if spec.get("decoder"):
            raise ValueError(f"{path}: a vocabulary without a decoding rule is wanted")
        self.suffix = model["end_of_word_suffix"] or ""
        self.word = regex.compile(first["pattern"]["Regex"])
        ids: dict[str, int] = model["vocab"]
        if max(ids.values()) > _MASK:
            raise ValueError(f"{path}: more than {_MASK} tokens")
        self.letters = byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        sizes = {i: len(t.removesuffix(self.suffix)) or len(t) for t, i in ids.items()}
        self.merges = Merges([(ids[a], ids[b], ids[a.removesuffix(self.suffix) + b]) for a, b in pairs], sizes)
        self.inner, self.final = ([ids[c + end] for c in self.letters] for end in ("", self.suffix))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_ids = special
        self.tokens = {i: t for t, i in (ids | special).items()}
        self.plain = {i: t.encode() for i, t in self.tokens.items()}
        self.words_kept = WORDS_KEPT
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        """NFC and lower case letter by letter; white space only parts words, so it stays as it is."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def symbols(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        inner = self.inner
        return [*[inner[b] for b in data[:-1]], self.final[data[-1]]]

    def word_ids(self, word: str) -> bytes:
        """Ids of one word as bytes. Words of up to 64 letters are remembered, the least recent generation is forgotten."""
        found = self.old.get(word)
        if found is None:
            symbols = self.symbols(word)
            ids = self.merges.apply(symbols) if len(symbols) <= BLOCK else list(self.merges.stream(symbols))
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.new) >= self.words_kept:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def forget(self) -> None:
        """Drop the remembered words."""
        self.old, self.new = {}, {}

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids of a text as bytes, block by block; the strings of special tokens become ids of their own."""
        own, at = self.word_ids, 0
        for m in self.special.finditer(text) if self.special and "<" in text else ():
            yield from self._words(text[at:m.start()], own)
            yield struct.pack("<I", self.special_ids[m[0]])
            at = m.end()
        yield from self._words(text[at:] if at else text, own)

    def _words(self, text: str, own) -> Iterator[bytes]:
        """A block ends before a space or line end: no word goes on there, and none of these joins the letter before it."""
        at = 0
        while at < len(text):
            end = at + TEXT_BLOCK
            if end < len(text):
                cuts = [c for c in (text.find(" ", end), text.find("\n", end)) if c >= 0]
                end = min(cuts, default=len(text))
            get = self.new.get
            part = [get(w) or own(w) for w in self.word.findall(self.normal(text[at:end]))]
            if part:
                yield b"".join(part)
            at = end

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(b"".join(self.pieces(text)), "<u4")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class TextDecoder:
    """Ids to text, piece by piece: a state machine over bytes in which at most three bytes wait for their letter to be whole.

    ``spelled``: the text that the ids spell, a word end being a space. Otherwise what a vocabulary without a decoding rule
    gives, tokens as they are with one space between two.
    """

    def __init__(self, vocab: Vocabulary, spelled: bool = True):
        self.vocab, self.spelled, self.started = vocab, spelled, False
        self.byte = {c: b for b, c in enumerate(vocab.letters)} if spelled else None
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def _spelled(self, i: int) -> bytes:
        token, suffix = self.vocab.tokens[i], self.vocab.suffix
        if token in self.vocab.special_ids:
            return token.encode()
        whole = bool(suffix) and token.endswith(suffix)
        return bytes(self.byte[c] for c in (token[:-len(suffix)] if whole else token)) + b" " * whole

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        if self.spelled:
            return self.state.decode(b"".join([self._spelled(int(i)) for i in ids]), last)
        data = b" ".join(map(self.vocab.plain.__getitem__, ids))
        if data:
            data, self.started = b" " * self.started + data, True
        return self.state.decode(data, last)


OUTPUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
                   words_kept: int = WORDS_KEPT) -> DataFrame:
    """Per row the number of ids, a digest of the ids, a digest of what they decode to and, if asked for, the ids. Null texts are empty; rows are
    taken one by one, so repeated rows, null ids and empty tables need no care; other columns are left out, whatever their names. Nothing
    is shuffled. Each block of a text is encoded, and its ids decoded, before the next is looked at."""

    def run(batches):
        vocab = vocabulary(path)
        vocab.words_kept = words_kept
        for batch in chunks(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                n, ids_sha, text_sha, decoder, kept = 0, hashlib.sha256(), hashlib.sha256(), TextDecoder(vocab, spelled=False), []
                for raw in vocab.pieces(text):
                    n += len(raw) // 4
                    ids_sha.update(raw)
                    text_sha.update(decoder.feed(np.frombuffer(raw, "<u4").tolist()).encode())
                    if with_ids:
                        kept.append(raw)
                text_sha.update(decoder.feed((), True).encode())
                rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest(), b"".join(kept)))
            n, a, b, ids = zip(*rows)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                cuts = pa.array(np.cumsum([0, *n]), pa.int32())
                cols.append(pa.ListArray.from_arrays(cuts, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:len(cols)])
        vocab.forget()  # the worker lives on and runs other tasks: it keeps neither words nor vocabulary, which is read again in a fraction of a second
        vocabulary.cache_clear()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(freeing(run), OUTPUT + (", ids array<int>" if with_ids else ""))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))
