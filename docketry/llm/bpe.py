"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can end its encoding: a vocabulary token
that is a suffix of the prefix (found with an Aho-Corasick automaton over the vocabulary) and that
may stand beside the last token of what precedes it. Whether two tokens may stand side by side is
told by undoing their merges from the boundary outwards, latest first: the pair is broken if a merge
across the boundary would have come before the merge that took one of its sides away. Following the
stored last tokens backwards gives the ids; no merge loop over the word is run.

Tokenizers are never trained here: the vocabulary file's path is a parameter.

Defined cases: null text counts as empty and gives no ids and an empty decoded text; texts and words
of any length are handled whole, in time linear in their length; strings of the special tokens in a
text become their ids, as the file says; an empty table gives an empty result; repeated rows give repeated
rows; other columns don't matter.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the tokenizers library's character tables differ from those of Python and regex, which have other
#: Unicode versions. Characters that are neither letters nor numbers to it; marks that it takes for characters
#: of their own; capitals that it lower-cases (and first and last of two alphabets, with the distance).
_NO_LETTER = (
    "\u0558\u058B\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959"
    "\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686"
    "\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2"
    "\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96"
    "\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE\U0001E6FF"
    "\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
_ALONE = (
    "\u07FD\u0898-\u089F\u08CA-\u08D3\u09FE\u0C3C\u0D3B\u0D3C\u0EBA\u1715\u1ABF-\u1ACE\u1DF6-\u1DFA\uA82C\U00010D24-\U00010D27\U00010EAB\U00010EAC"
    "\U00010EFD-\U00010EFF\U00010F46-\U00010F50\U00010F82-\U00010F85\U00011070\U0001133B\U0001145E\U00011839\U0001183A\U00011930\U0001193D\U0001193E\U00011943"
    "\U000119E0\U00011A34\U00011A47\U00011A99\U00011D42\U00011D44\U00011D45\U00011D97\U00011F41\U00011F42\U00016FF0\U00016FF1\U0001E08F\U0001E130-\U0001E136"
    "\U0001E2AE\U0001E2EC-\U0001E2EF\U0001E4EC-\U0001E4EF"
)
_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_CAPITAL_RANGES = ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
_END = "</w>"
#: Moves the last character of a word to code points that nothing else has.
_SHIFT = 0x2000
#: Words in each of the two generations of a worker's cache, and the longest word that is kept.
CACHE_WORDS = 160_000
CACHE_LENGTH = 64
#: Tests of neighbouring tokens that a worker keeps.
CACHE_PAIRS = 300_000


def byte_alphabet() -> list[str]:
    """Character for each byte: printable ones stand for themselves, the rest follow from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    keep = set(kept)
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


class _Cache(dict):
    """Ids by text. Two generations: what is still used moves on to the new one when it is full."""

    def __init__(self, make: Callable[[str], tuple[int, ...]], most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class Encoded:
    """An encoded text: its ids, and from them their decimal form and the decoded text."""

    __slots__ = ("ids", "_codec")

    def __init__(self, ids: list[int], codec: WordBpe):
        self.ids, self._codec = ids, codec

    @property
    def n_tokens(self) -> int:
        return len(self.ids)

    @property
    def ids_text(self) -> str:
        return " ".join(map(self._codec.decimals.__getitem__, self.ids))

    @property
    def decoded(self) -> str:
        return " ".join(map(self._codec.texts.__getitem__, self.ids))


class WordBpe:
    """Codec of a word-level BPE file whose words end in a marked character."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END or model.get("dropout"):
            raise ValueError("not a word-level BPE file")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern).findall
        self.find_newer = regex.compile(self._without(pattern), regex.V1).findall
        self.capitals = _CAPITALS | {c: c + d for a, b, d in _CAPITAL_RANGES for c in range(a, b + 1)}
        newer = _NO_LETTER + _ALONE + "".join(map(chr, self.capitals))
        self.newer = regex.compile(f"[{newer}]").search
        self.alone = regex.compile(f"([{_ALONE}])").split
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.decimals = {i: str(i) for i in self.texts}
        # the byte alphabet as a translation of Latin-1; printable ASCII stands for itself
        self.alphabet = dict(enumerate(byte_alphabet()))
        vocab = model["vocab"]
        automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            inner = text[: -len(_END)] if len(text) > len(_END) and text.endswith(_END) else None
            key = text if inner is None else inner[:-1] + chr(ord(inner[-1]) + _SHIFT)
            automaton.add_word(key, (len(key), i))
        automaton.make_automaton()
        self.matches = automaton.iter
        # rank: by token, -1 for single characters; parts: the two tokens it is made of; joins: rank by pair
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole, pair = vocab[a + b], (vocab[a], vocab[b])
            self.joins[pair], self.rank[whole], self.parts[whole] = n, n, pair
        self.beside: dict[int, bool] = {}
        self.cache, self.words = _Cache(self._chunk, CACHE_WORDS // 2), _Cache(self.encode_word, CACHE_WORDS)
        self.separators = regex.compile(r"[\x1c-\x1f]").search

    @staticmethod
    def _without(pattern: str) -> str:
        """The pattern with the library's letters and numbers."""
        return pattern.replace(r"[^\s\p{L}\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{_NO_LETTER}])").replace(r"[\p{L}]", f"[\\p{{L}}--[{_NO_LETTER}]]").replace(r"[\p{N}]", f"[\\p{{N}}--[{_NO_LETTER}]]")

    def may_follow(self, left: int, right: int) -> bool:
        """True if the encoding of both texts together is just these two tokens."""
        x, y = left, right
        end_x = end_y = len(self.joins)  # when the piece at the boundary is taken up by its own side
        while True:
            across = self.joins.get((x, y))
            if across is not None and across < end_x and across <= end_y:
                return False
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                end_x, x = rx, self.parts[x][1]
            else:
                end_y, y = ry, self.parts[y][0]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, given in plain characters."""
        symbols = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.alphabet)
        size = len(symbols)
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + _SHIFT)
        # for each prefix its last token and that token's length
        last, length = [-1] * (size + 1), [0] * (size + 1)
        beside, done = self.beside, 0
        for at, (n, token) in self.matches(symbols):
            if at < done:
                continue
            if start := at + 1 - n:
                pair = last[start] << 32 | token
                ok = beside.get(pair)
                if ok is None:
                    if len(beside) > CACHE_PAIRS:
                        beside.clear()
                    ok = beside[pair] = self.may_follow(last[start], token)
                if not ok:
                    continue
            done = at + 1
            last[done], length[done] = token, n
        if length[size] == size:
            return (last[size],)
        ids, at = [], size
        while at:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return tuple(ids)

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by one space, as the file names no decoder; unknown ids are left out."""
        return " ".join([self.texts[i] for i in ids if i in self.texts])

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Of characters without white space: no pre-token and no composition reaches beyond it."""
        find, words = self.find, self.words
        if chunk.isascii():
            chunk = chunk.lower()
            if chunk.isalpha():
                return words[chunk]
        else:
            if self.newer(chunk):
                chunk = "".join([unicodedata.normalize("NFC", part) for part in self.alone(chunk)]).translate(self.capitals)
                find = self.find_newer
            elif not unicodedata.is_normalized("NFC", chunk):
                chunk = unicodedata.normalize("NFC", chunk)
            # lower-cased character by character: a final sigma has no form of its own
            chunk = chunk.replace("Σ", "σ").lower()
        got = find(chunk)
        return words[got[0]] if len(got) == 1 else tuple(chain.from_iterable([words[w] for w in got]))

    def _ids(self, text: str) -> list[int]:
        # str.split() takes some characters for white space that the pattern doesn't
        chunks = regex.split(r"\s+", text) if self.separators(text) else text.split()
        return list(chain.from_iterable(map(self.cache.__getitem__, chunks)))

    def encode(self, text: str) -> Encoded:
        if self.split_special is None or "<" not in text:
            return Encoded(self._ids(text), self)
        ids: list[int] = []
        for part in self.split_special(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._ids(part)
        return Encoded(ids, self)


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One for each worker process and file."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str, make: Callable[[Encoded], tuple] | None = None, schema: str = "n_tokens long, ids array<int>, decoded string", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes and decodes every whole text -> (id, *keep, *schema), one row for each row of docs.

    make derives the columns of schema from an encoded text; by default its length, ids and decoded
    text. path must name the same file on every executor.
    """
    make = make or (lambda e: (e.n_tokens, e.ids, e.decoded))
    fields = [f.split()[0] for f in schema.split(", ")]
    first = docs.select(F.col(id_col), *keep).schema
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in first] + [schema])
    target = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in target]
        words = codec(path)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                rows = [make(words.encode(t.as_py() or "")) for t in part.column(part.num_columns - 1)]
                made = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *fields])

    return docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, out)
