"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of texts with that label. A text is cut
into blocks (whole characters, nothing left out), each block is compressed with every language's
dictionary, and the language with the smallest total wins. Blocks keep the dictionary's help from
fading in long texts, which otherwise compress with themselves. Only the letters and the spaces
between them count, lower-cased, so that digits, markup and layout don't decide.

score is the best language's share in a soft minimum over the bits that each spends on a byte;
documents whose margin is under `margin` are rejected.

Learning reads a bounded sample: for each language SAMPLE_DOCS documents drawn by a hash of the id, of
which the first DICTIONARY_BYTES bytes of words are used; it is the fit of a classifier, and prediction covers every
whole text. Texts of up to SAMPLE_CHARS characters are preferred; a language whose sample has none is learned from
the starts of longer ones.

Defined cases: null text or text without a letter: 'und', score 0, rejected. Without any labelled
text, as in an empty table, all are 'und'; an empty table gives an empty result. Texts of any length are read
whole, block by block. Ties go to the language with more learning rows. Rows that repeat are learned from
once and predicted alike; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import sample_of

#: Bounds of the learning sample, for each language.
SAMPLE_DOCS = 400
DICTIONARY_BYTES = 64_000
SAMPLE_CHARS = 4_000
BLOCK = 8_192
#: zstandard's levels: for texts of up to SHORT bytes, where each byte counts, and for others.
SHORT = 1_024
SHORT_LEVEL = 12
LEVEL = 6
#: Bits saved for each byte, over the next best language, below which a document is rejected.
MARGIN = 0.002
_LETTERS = re.compile(r"[^\W\d_]+").findall


def plain(text: str) -> bytes:
    """The words of a text, lower-cased, with one space between and around them."""
    found = _LETTERS(text.lower())
    return (" " + " ".join(found) + " ").encode("utf-8", "replace") if found else b""


def learn(docs: DataFrame, chosen: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """Raw dictionary content by language, from the rows where chosen holds. The driver gets the sample and
    the number of rows of each language."""
    rows = docs.filter(F.coalesce(chosen, F.lit(False)) & F.col(lang_col).isNotNull())
    picked = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(8)).alias("h"), F.substring(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 1, SAMPLE_CHARS + 1).alias("text"))
    drawn: dict[str, list[str]] = {}
    for r in sample_of(picked, "h", SAMPLE_DOCS, "lang"):
        drawn.setdefault(r["lang"], []).append(r["text"])
    out: dict[str, bytes] = {}
    for lang, texts in drawn.items():
        held = bytearray()
        for text in [t for t in texts if len(t) <= SAMPLE_CHARS] or texts:
            held += plain(text)
            if len(held) >= DICTIONARY_BYTES:
                break
        out[lang] = bytes(held[:DICTIONARY_BYTES])
    # ties are decided by this order
    often = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    return {k: v for k, v in sorted(out.items(), key=lambda x: (-often[x[0]], x[0])) if v}


class Compressors:
    """Two levels for each language: strong for short texts, where each byte counts, fast for others."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.by_level = {}
        for level in (LEVEL, SHORT_LEVEL):
            made = []
            for body in content.values():
                d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
            self.by_level[level] = made

    def sizes(self, body: bytes) -> list[int]:
        blocks, at = [], 0
        while at < len(body):
            end = at + BLOCK
            if end < len(body):
                space = body.rfind(b" ", at + 1, end)
                end = space if space > at else end
            blocks.append(body[at:end])
            at = end
        made = self.by_level[SHORT_LEVEL if len(body) <= SHORT else LEVEL]
        return [sum(len(c.compress(b)) for b in blocks) for c in made]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin in bits saved for each byte)."""
        body = plain(text or "")
        if not body or not self.langs:
            return "und", 0.0, 0.0
        sizes = self.sizes(body)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = order[0]
        if len(order) == 1:
            return self.langs[best], 1.0, 8.0
        gap = 8.0 * (sizes[order[1]] - sizes[best]) / len(body)
        total = sum(2.0 ** -min(60.0, 40.0 * 8.0 * (sizes[i] - sizes[best]) / len(body)) for i in order)
        return self.langs[best], 1.0 / total if math.isfinite(total) else 0.0, gap


@lru_cache(maxsize=4)
def _compressors(content: tuple[tuple[str, bytes], ...]) -> Compressors:
    return Compressors(dict(content))


def identify(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """-> (id, *keep, lang_pred, score, margin, accepted): one row for each row of docs."""
    first = docs.select(F.col(id_col), *keep).schema
    key = tuple(content.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _compressors(key).predict
        for batch in batches:
            rows = [predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64()))]
            ok = pa.array([r[0] != "und" and r[2] >= margin for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made, ok], names=[*batch.schema.names[:-1], "lang_pred", "score", "margin", "accepted"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first) + ", lang_pred string, score double, margin double, accepted boolean"
    return docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, out)


def judged(text: Column, content: dict[str, bytes], margin: float = MARGIN) -> Column:
    """As a column, struct(lang_pred, score, margin, accepted), so that other columns stay where they are."""
    key = tuple(content.items())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = _compressors(key).predict
        for part in parts:
            rows = [predict(t) for t in part]
            yield pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "margin": [r[2] for r in rows], "accepted": [r[0] != "und" and r[2] >= margin for r in rows]})

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang_pred string, score double, margin double, accepted boolean")(text.cast("string"))
