"""Language identification by compression.

Every language has a zstandard raw-content dictionary of its own text. A text is encoded in short blocks with each
dictionary, and the language with the smallest total wins. A narrow margin between the best two is a rejection.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.lineage import sized
from lithoframe.llm.common import add_text_columns, per_process

UNDETERMINED = "und"
SCHEMA = "lang_pred string, score double, margin double, rejected boolean"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    texts_per_language: int = 256   # bound of the training sample, texts
    chars_per_text: int = 1024      # and characters of each
    block: int = 2048               # bytes that are compressed at once, so that the dictionary matters to the end
    level: int = 3
    fine_level: int = 19            # for the second reading
    primer: int = 64                # bytes of the dictionary that go before it, so that a short match pays
    frame: int = 7                  # bytes of a frame that hold no text
    temperature: float = 2.0        # bytes of difference that change the odds by e
    narrow: float = 0.02            # rejected below this share between the best two


@dataclass(frozen=True)
class Dictionaries:
    content: tuple = field(default=())  # (language, bytes) by language
    settings: Settings = Settings()


def letters(text: str) -> str:
    """Lower-case words of letters, one space between them."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def learn(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang",
          settings: Settings = Settings()) -> Dictionaries:
    """A dictionary for each language, from a bounded sample of the rows where ``learnable`` holds.

    The sample of a language is its first ``texts_per_language`` different texts by hash, told apart by their first
    ``chars_per_text`` characters, so copies count once. A first pass finds the hash that ends the sample, a second its
    texts. Null texts, texts without letters and null languages teach nothing. Without any such row the result is empty,
    and every text is undetermined.
    """
    usable = docs.filter(learnable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    drawn = usable.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"),
                          F.substring(text, 1, settings.chars_per_text).alias("text"))
    different = drawn.groupBy("lang", F.xxhash64("text").alias("_cut")).agg(F.min("h").alias("h"))
    first = Window.partitionBy("lang").orderBy("h")
    last = sized(different.withColumn("rank", F.row_number().over(first))
                 .filter(F.col("rank") <= settings.texts_per_language)
                 .groupBy(F.col("lang").alias("_lang")).agg(F.max("h").alias("_last")))
    cut = (drawn.join(last, (F.col("lang") == F.col("_lang")) & (F.col("h") <= F.col("_last")))
           .groupBy("lang", "text").agg(F.min("h").alias("h")))
    found: dict[str, list] = {}
    for row in cut.select("lang", "h", "text").collect():
        found.setdefault(row["lang"], []).append((row["h"], row["text"]))
    return Dictionaries(tuple((k, " ".join(letters(t) for _, t in sorted(v)).encode()) for k, v in sorted(found.items())),
                        settings)


def compressors(model: Dictionaries) -> list:
    """By language: its name, a compressor for blocks, one for the second reading, and that one's primer and its size."""
    import zstandard

    made = []
    for name, content in model.content:
        pair = []
        for level in (model.settings.level, model.settings.fine_level):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            pair.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False,
                                                 write_dict_id=False, write_checksum=False))
        primer = content[:model.settings.primer]
        made.append((name, *pair, primer, len(pair[1].compress(primer))))
    return made


def judged(sizes: list[tuple[int, str]], s: Settings) -> tuple[str, float, float, bool]:
    sizes = sorted(sizes)
    best, name = sizes[0]
    margin = (sizes[1][0] - best) / max(1, sizes[1][0]) if len(sizes) > 1 else 1.0
    score = 1 / sum(math.exp(max(-700.0, (best - size) / s.temperature)) for size, _ in sizes)
    return name, score, margin, margin < s.narrow


def decide(text: str | None, ready: list, s: Settings) -> tuple[str, float, float, bool]:
    """The blocks decide. Where their margin is narrow (few words, or one word over and over), the different words do."""
    plain = letters(text) if text else ""
    if not plain or not ready:
        return UNDETERMINED, 0.0, 0.0, True
    data = plain.encode("utf-8", "replace")
    blocks = [data[i:i + s.block] for i in range(0, len(data), s.block)]
    found = judged([(sum(len(c.compress(b)) - s.frame for b in blocks), name) for name, c, *_ in ready], s)
    if not found[3]:
        return found
    words = f" {' '.join(dict.fromkeys(plain.split()))} ".encode("utf-8", "replace")
    blocks = [words[i:i + s.block] for i in range(0, len(words), s.block)]
    return judged([(sum(len(c.compress(primer + b)) - spent for b in blocks), name)
                   for name, _, c, primer, spent in ready], s)


def identify(docs: DataFrame, model: Dictionaries, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, margin (the share by which the best is shorter than the second) and rejected.

    A null text and a text without letters is ``und`` with score 0, rejected. Ties go to the first language by name
    and are rejected, their margin being 0. Whole texts are encoded.
    """
    def batch(texts: list) -> pd.DataFrame:
        ready = per_process(compressors, model)
        return pd.DataFrame([decide(t, ready, model.settings) for t in texts],
                            columns=["lang_pred", "score", "margin", "rejected"])

    return add_text_columns(docs, text, batch, SCHEMA, prefix)
