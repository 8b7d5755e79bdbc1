"""Byte-pair encoding by guess and check.

Merging gives a word the only sequence of tokens in which every token is what merging makes of
its own characters and no two neighbours would have merged across their border. So a greedy
longest match proposes tokens, the borders of all words of a batch are checked at once, and
only words with a bad border are merged step by step.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.llm.common import row_groups, tidy, two_columns

NEVER = 1 << 40
# Stands for the suffix at the end of a word.
END = "\0"
# A task remembers the tokens of words, and of what blanks part, in so many bytes each; it starts anew beyond them.
REMEMBERED_BYTES = 32 << 20
# What an entry takes beside the word and its tokens.
ENTRY_BYTES = 200
BLANK = r"[\t-\r \x85\xa0  -     　]"


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the letters from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A vocabulary whose words end in a suffix; made from the JSON text of a tokenizer file."""

    def __init__(self, description: str) -> None:
        told = json.loads(description)
        model = told["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.size = 1 + max([*self.vocab.values(), *(t["id"] for t in told["added_tokens"])])
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", BLANK[1:-1]))
        letters = byte_letters()
        self.letters = letters
        self.texts = [""] * self.size
        for token, number in [*self.vocab.items(), *self.special.items()]:
            self.texts[number] = token
        # The special strings cut the raw text, the longest first.
        if any(c.isspace() for s in self.special for c in s):
            raise ValueError("a special token with white space is not supported")
        cut = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({cut})") if cut else None

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # By token: when it is made, and of what.
        self.made = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        pairs, self.product = np.zeros(len(merges), np.int64), np.zeros(len(merges), np.int64)
        for i, (a, b) in enumerate(merges):
            x, y, both = self.vocab[a], self.vocab[b], self.vocab[a + b]
            pairs[i], self.product[i] = x << 32 | y, both
            if self.made[both] < 0:
                self.made[both], self.left[both], self.right[both] = i, x, y
        self.pair_order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.pair_order]
        # Tokens of single letters, without and with the suffix.
        self.alone = np.full((2, 0x200), -1, np.int64)
        for letter in letters:
            self.alone[:, ord(letter)] = self.vocab.get(letter, -1), self.vocab.get(letter + self.suffix, -1)
        # Every beginning of a token that merging makes of its letters, with its number if it is one.
        ended = [t.removesuffix(self.suffix) for t in self.vocab if t.endswith(self.suffix) and t != self.suffix]
        inner = [t for t in self.vocab if not t.endswith(self.suffix)]
        proper = {t + END: ids[0] for t, ids in zip(ended, self.merged(ended)) if ids == [self.vocab[t + self.suffix]]}
        proper |= {t: ids[0] for t, ids in zip(inner, self.merged(inner, ended=False)) if ids == [self.vocab[t]]}
        self.begins = {token[:end]: -1 for token in proper for end in range(1, len(token))} | proper
        self.longest = max(map(len, proper))

    # -- exact merging

    def letters_of(self, words: list[str], ended: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all letters and the words' bounds; ``ended`` words have the suffix on the last."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        tokens = self.alone[0, points]
        if ended:
            tokens[bounds[1:] - 1] = self.alone[1, points[bounds[1:] - 1]]
        return tokens, bounds

    def merged(self, words: list[str], ended: bool = True) -> list[list[int]]:
        """Every word merged step by step: its neighbours of the lowest rank, leftmost first.

        Words of about one length are rows of one matrix, and each step merges a pair in every row.
        """
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        first = 0
        while first < len(order):
            most = 2 * len(words[order[first]]) + 8
            end = first
            while end < len(order) and end - first < 8192 and len(words[order[end]]) <= most:
                end += 1
            chosen = order[first:end]
            for i, ids in zip(chosen, self._merged_rows([words[i] for i in chosen], ended)):
                out[i] = ids
            first = end
        return out

    def _merged_rows(self, words: list[str], ended: bool) -> Iterator[list[int]]:
        tokens, bounds = self.letters_of(words, ended)
        sizes = np.diff(bounds)
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        rows = np.full((len(words), width + 1), -1, np.int64)
        rows[:, :-1][inside] = tokens
        ranks = np.full((len(words), width + 1), NEVER, np.int64)
        both = rows[:, 1:] >= 0
        ranks[:, :-1][both] = self._pair_rank(rows[:, :-1][both], rows[:, 1:][both])
        live = np.arange(len(words))
        part, rank = rows, ranks
        columns = np.arange(width + 1)
        while len(live):
            at = rank.argmin(axis=1)
            go = rank[np.arange(len(live)), at] < NEVER
            if not go.all():
                rows[live[~go], :part.shape[1]] = part[~go]
                rows[live[~go], part.shape[1]:] = -1
                live, part, rank, at = live[go], part[go], rank[go], at[go]
                if not len(live):
                    break
            n = np.arange(len(live))
            part[n, at] = self.product[rank[n, at]]
            # Drop the place after the merged one; the last place stays empty.
            moved = np.minimum(columns[None, :-1] + (columns[None, :-1] > at[:, None]), len(columns) - 1)
            part = np.take_along_axis(part, moved, axis=1)
            rank = np.take_along_axis(rank, moved, axis=1)
            columns = columns[:-1]
            right = np.minimum(at + 1, part.shape[1] - 1)
            ended = (right == at) | (part[n, right] < 0)
            rank[n, at] = np.where(ended, NEVER, self._pair_rank(part[n, at], part[n, right]))
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self._pair_rank(part[before, at[before] - 1], part[before, at[before]])
        for row in rows.tolist():
            yield row[:row.index(-1)]

    # -- guess and check

    def guess(self, word: str) -> list[int] | None:
        """Greedy longest match by tokens that merging would make; None if it gets stuck."""
        begins, out, at = self.begins, [], 0
        word += END
        size = len(word)
        while at < size:
            best = -1
            for end in range(at + 1, min(size, at + self.longest) + 1):
                found = begins.get(word[at:end])
                if found is None:
                    break
                if found >= 0:
                    best, stop = found, end
            if best < 0:
                return None
            out.append(best)
            at = stop
        return out

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        wanted = x << 32 | y
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_order[at], NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For neighbours x and y: would merging leave their border alone?

        Both are taken apart in the reverse order of their making. The pieces at the border
        would have merged if their pair ranks before the merge that is undone; if it ranks
        with it, the one on the left went first.
        """
        fine = np.ones(len(x), bool)
        live = np.arange(len(x))
        x, y = x.copy(), y.copy()
        before = np.full(len(x), NEVER)
        while len(live):
            bad = self._pair_rank(x, y) < before
            fine[live[bad]] = False
            go = ~bad & ((self.made[x] >= 0) | (self.made[y] >= 0))
            live, x, y = live[go], x[go], y[go]
            later = self.made[x] > self.made[y]
            before = np.where(later, self.made[x], self.made[y] + 1)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return fine

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of words in byte letters."""
        guesses = [self.guess(w) for w in words]
        sizes = np.array([len(g) if g else 0 for g in guesses], np.int64)
        flat = np.array([t for g in guesses if g for t in g], np.int64)
        ok = np.array([g is not None for g in guesses], bool)
        if len(flat):
            owner = np.repeat(np.arange(len(words)), sizes)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            ok[owner[inside[~self.compatible(flat[inside], flat[inside + 1])]]] = False
        exact = iter(self.merged([w for w, fine in zip(words, ok.tolist()) if not fine]))
        return [g if fine else next(exact) for g, fine in zip(guesses, ok.tolist())]

    # -- whole texts

    def split(self, chunk: str) -> list[str | int]:
        """Words of a text after normalisation; special tokens as numbers."""
        if self.cut is None or not self.cut.search(chunk):
            return self.words.findall(self.normal(chunk))
        out: list[str | int] = []
        for part in self.cut.split(chunk):
            out.extend([self.special[part]] if part in self.special else self.words.findall(self.normal(part)))
        return out

    def normal(self, text: str) -> str:
        """Composed, and letters lower-cased one by one; blanks may stay, as no word holds any."""
        if not text.isascii():
            # lower() knows a final sigma; one by one there is none.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def spelled(self, word: str) -> str:
        """A word in byte letters."""
        if word.isascii() and word.isprintable():
            return word
        return "".join(map(self.letters.__getitem__, word.encode()))


class Encoder:
    """Encodes texts in batches and remembers words.

    No word spans ASCII white space, so a text is looked up chunk by chunk as it stands; only
    chunks not seen before are normalised and split into words.
    """

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe = bpe
        self.of_chunk: dict[bytes, bytes] = {}
        self.of_word: dict[str | int, bytes] = {number: struct.pack("<I", number) for number in bpe.special.values()}
        self.n_special = len(self.of_word)
        self.chunk_bytes = self.word_bytes = 0

    def _learn(self, chunks: list[bytes]) -> None:
        split = [self.bpe.split(c.decode()) for c in chunks]
        if self.word_bytes > REMEMBERED_BYTES:
            self.of_word, self.word_bytes = dict(list(self.of_word.items())[:self.n_special]), 0
        new = list({w for words in split for w in words}.difference(self.of_word))
        for word, ids in zip(new, self.bpe.encode_words([self.bpe.spelled(w) for w in new])):
            self.of_word[word] = struct.pack(f"<{len(ids)}I", *ids)
            self.word_bytes += ENTRY_BYTES + len(word) + 4 * len(ids)
        get = self.of_word.__getitem__
        for chunk, words in zip(chunks, split):
            found = self.of_chunk[chunk] = b"".join(map(get, words))
            self.chunk_bytes += ENTRY_BYTES + len(chunk) + len(found)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every UTF-8 text as little-endian unsigned 32-bit integers."""
        split = [t.split() for t in texts]
        if self.chunk_bytes > REMEMBERED_BYTES:
            self.of_chunk, self.chunk_bytes = {}, 0
        self._learn(list({c for chunks in split for c in chunks}.difference(self.of_chunk)))
        get = self.of_chunk.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]

    def decode(self, ids: bytes) -> str:
        """Token texts joined by one space, as for a tokenizer file that names no decoder."""
        return " ".join(map(self.bpe.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, tokenizer_json: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` of every row.

    ``tokenizer_json`` is the text of a tokenizer file with words that end in a suffix (its
    size is that of the vocabulary). Null and blank texts have no ids; repeated rows stay.
    Strings of special tokens in a text become those tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(WordBpe(shared.value))
        for batch in batches:
            for first, texts in row_groups(batch.column("text")):
                ids = encoder.encode(texts)
                decoded = pa.array(map(encoder.decode, ids), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(texts)), pa.array(ids, pa.binary()), decoded], names=["id", "ids", "decoded"])

    rows = two_columns(docs, id_column, text_column)
    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """``id``, the number of ids, and the hashes of ids and decoded text."""
    return encoded.select(
        "id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
