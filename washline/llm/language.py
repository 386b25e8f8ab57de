"""Language by compression: the language whose sample text helps zstandard most.

For each language a raw-content dictionary is filled with labelled texts. A text is lower-cased and cut
into blocks, each is compressed on its own with each dictionary, and the language with the smallest sum is taken,
ties going to the smaller name. Sizes are whole bytes, which says little about a short text: such a one is
compressed with several dictionaries of each language. The margin is the share by which the runner-up is larger; a text whose
margin is below ``margin`` is rejected.
"""

from collections.abc import Iterator
from itertools import islice

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go_after, written

UNDEFINED = "und"
#: Dictionaries are fitted on a sample: at most so many texts a language, so many characters of each, and so
#: many dictionaries of so many bytes; all languages together take ``MOST_BYTES``, so hundreds of them have
#: less each.
SAMPLE_TEXTS = 400
DRAWN = 16
SAMPLE_CHARACTERS = 4_000
DICTIONARY_BYTES = 32_000
DICTIONARIES = 6
SHORT_BYTES = 400
MOST_BYTES = 48 << 20
BLOCK = 16_384
LEVEL = 3
MARGIN = 0.001
LETTERS = r"\p{L}"


def lowered(text: str) -> bytes:
    return text.lower().encode()


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, list[bytes]]:
    """Dictionaries for every language, from texts with letters and a label.

    The sample is the same on every run: distinct texts in the order of a hash. Only the sample, of
    bounded size, reaches the driver.
    """
    labelled = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(LETTERS)
    ).withColumn("at", F.xxhash64("text"))
    # only hashes below a limit that some times the wanted texts pass are ranked, so that no task gathers a
    # language; the limit follows the different texts of a label, as copies have one hash and count once
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n"))
    wanted = DRAWN * SAMPLE_TEXTS
    limit = F.when(F.col("n") <= wanted, 1 << 30).otherwise(F.floor(float(wanted << 30) / F.col("n")))
    limits = written(counts.select("lang", limit.cast("long").alias("limit")))
    names = sorted(r["lang"] for r in limits.select("lang").collect())  # the labels that predictions take
    if not names:
        return {}
    room = min(DICTIONARIES * DICTIONARY_BYTES, MOST_BYTES // len(names))
    drawn = labelled.join(limits, "lang").where(F.pmod("at", F.lit(1 << 30)) < F.col("limit")).select(
        "lang", F.left("text", F.lit(SAMPLE_CHARACTERS)).alias("text"), "at"
    ).dropDuplicates(["lang", "at"])
    order = Window.partitionBy("lang").orderBy("at", "text")
    ranked = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_TEXTS)
    before = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # no more than dictionaries hold, and some for what is passed over
    rows = ranked.withColumn("before", before).where(F.coalesce("before", F.lit(0)) <= 1.25 * room).collect()
    size, many = min(DICTIONARY_BYTES, room), max(1, room // DICTIONARY_BYTES)
    found: dict[str, list[bytes]] = {name: [b""] for name in names}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        filled, text_bytes = found[row["lang"]], lowered(row["text"])
        if len(filled[-1]) >= size and len(filled) < many:
            filled.append(b"")
        if len(filled[-1]) < size and text_bytes not in filled[-1]:
            filled[-1] += text_bytes + b"\n"
    return {name: [d[:size] for d in filled] for name, filled in found.items()}


Ready = list[tuple[str, list[zstandard.ZstdCompressor]]]


def compressors(dictionaries: dict[str, list[bytes]]) -> Ready:
    """Matches of three bytes count, as words share no more than that across languages."""
    out = []
    for name in sorted(dictionaries):
        own = []
        for sample in dictionaries[name]:
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(sample), min_match=3, strategy=zstandard.STRATEGY_BTOPT,
                write_content_size=False, write_dict_id=False,
            )
            content = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            own.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=content))
        out.append((name, own))
    return out


def classify(text: bytes, ready: Ready) -> tuple[str, float]:
    """The language and the margin of the runner-up; a margin of 1 if there is one language only."""
    blocks = [text[i: i + BLOCK] for i in range(0, len(text), BLOCK)]
    used = min(len(own) for _, own in ready) if len(text) < SHORT_BYTES else 1
    sizes = sorted(
        (sum(len(c.compress(b)) for c in own[:used] for b in blocks), name) for name, own in ready
    )
    if len(sizes) < 2:
        return sizes[0][1], 1.0
    (least, name), (second, _) = islice(sizes, 2)
    return name, (second - least) / second


def identify(
    docs: DataFrame, dictionaries: dict[str, list[bytes]], text: str = "text", margin: float = MARGIN
) -> DataFrame:
    """All columns of ``docs``, then ``lang_pred``, ``score`` and ``rejected`` (replacing columns of
    these names).

    ``lang_pred`` is ``und`` for a text that is null or has no letter, and for every text if no
    language was learned; ``score`` is 0 then. Otherwise ``score`` is the margin. ``rejected`` marks
    both ``und`` and margins below ``margin``. The whole text is compressed.
    """
    base = docs.drop("lang_pred", "score", "rejected")
    if not dictionaries:
        return base.select(
            "*", F.lit(UNDEFINED).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(True).alias("rejected"),
        )

    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready = compressors(dictionaries)
        for batch in batches:
            yield pd.DataFrame(
                [(UNDEFINED, 0.0) if v is None else classify(lowered(v), ready) for v in batch],
                columns=["lang_pred", "score"],
            )

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from let_go_after(told)(batches)

    return base.withColumn("__found", predict(_with_letters(F.col(f"`{text}`")))).select(
        *[F.col(f"`{c}`") for c in base.columns], F.col("__found.lang_pred").alias("lang_pred"),
        F.col("__found.score").alias("score"),
        ((F.col("__found.lang_pred") == UNDEFINED) | (F.col("__found.score") < margin)).alias("rejected"),
    )


def _with_letters(text: Column) -> Column:
    return F.when(text.rlike(LETTERS), text)
