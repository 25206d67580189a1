"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of segments of a bounded sample of its labelled texts.
Texts are lower-cased and everything but letters becomes a blank. A text is cut into blocks, each block is set behind a
run of blanks (so that short ones aren't stored as they are) and compressed with every language's dictionary, and the
language whose total over the whole text is smallest is chosen. Texts of all lengths go the same way. The margin is the
share by which the runner-up is larger; texts with a narrow margin are rejected.

Defined results: null texts and texts without a letter get "und", score 0 and are rejected; ties go to the language
that sorts first; repeated rows get equal results; with no labelled texts everything is "und"; a single language takes
all texts with score 1; other columns, nulls in them included, pass as they are, and one that has the name of a result
is renamed to in_<name>; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructType

from .shared import hash_sample, set_apart, small_batches, written

#: Bounds of what is learned from: languages (those with most texts), whole texts of a language, bytes of a dictionary.
MAX_LANGS, MAX_TEXTS, DICT_BYTES = 256, 600, 112_640
SEGMENT, BLOCK, LEAD, MARGIN = 256, 4096, b" " * 512, 0.01
LETTER, OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}]+")
RESULTS = ("lang_pred", "score", "margin", "rejected")


def letters(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def segments(text: str, size: int = SEGMENT) -> list[bytes]:
    """The whole text in pieces of about size bytes that end at a blank."""
    data, at, out = letters(text).strip(), 0, []
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        out.append(data[at:end])
        at = end + 1
    return out


def learn(labelled: DataFrame, max_texts: int = MAX_TEXTS, dict_bytes: int = DICT_BYTES, max_langs: int = MAX_LANGS) -> dict[str, bytes]:
    """labelled (text, lang) -> a dictionary's bytes for each language, from max_texts texts of each at most.

    Texts are taken by the smallest hashes, and of the segments of these whole texts again those with the smallest
    hashes, whatever the order of rows. Of more than max_langs languages those with most texts are learned.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    taken = written(hash_sample(rows, max_texts, "lang", max_langs), "sample")

    def cut(batches):
        for b in batches:
            out = {(lang, s) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()) for s in segments(t)}
            out = [(lang, xxhash.xxh64_intdigest(s) >> 1, s) for lang, s in out]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "segment"])

    pieces = written(taken.mapInArrow(cut, "lang string, h long, segment binary").distinct(), "segments")
    limit = F.lit(0)
    for r in pieces.groupBy("lang").agg(F.sum(F.length("segment") + 1).alias("n")).collect():  # max_langs rows at most
        limit = F.when(F.col("lang") == r["lang"], F.lit(min((1 << 63) - 1, int(1.5 * dict_bytes / r["n"] * (1 << 63))))).otherwise(limit)
    out: dict[str, bytes] = {}
    for r in sorted(pieces.where(F.col("h") <= limit).collect(), key=lambda r: (r["lang"], r["h"], bytes(r["segment"]))):  # some 1.5 * dict_bytes a language
        own = out.get(r["lang"], b"")
        if len(own) + 1 + len(r["segment"]) <= dict_bytes:
            out[r["lang"]] = own + b" " * bool(own) + bytes(r["segment"])
    return out


class Classifier:
    """Chooses the language under whose dictionary a text compresses best."""

    def __init__(self, dicts: dict[str, bytes], block: int = BLOCK):
        self.langs, self.block, self.packers = sorted(dicts), block, []
        for lang in self.langs:
            params = zstandard.ZstdCompressionParameters.from_level(
                3, source_size=block + len(LEAD), dict_size=len(dicts[lang]), write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS, min_match=3, strategy=zstandard.STRATEGY_BTOPT
            )
            d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [LEAD + data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(map(len, map(p.compress, blocks))) for p in self.packers]

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score from 0 to 1, margin)."""
        if not self.langs or text is None or not LETTER.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(letters(text))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.langs[0], 1.0, 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        margin = (second - best) / max(second, 1)
        return self.langs[order[0]], min(1.0, 0.5 + 5 * margin), margin


def rejected(lang: str, margin: float, least: float = MARGIN) -> bool:
    return lang == "und" or margin < least


def identify(docs: DataFrame, dicts: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs (with text) -> its columns and lang_pred, score, margin, rejected."""
    small_batches(docs.sparkSession)
    docs = set_apart(docs, RESULTS)
    schema = StructType(list(docs.schema)).add("lang_pred", StringType()).add("score", DoubleType()).add("margin", DoubleType()).add("rejected", "boolean")
    names = to_arrow_schema(schema).names

    def run(batches):
        judge = Classifier(dicts)
        for b in batches:
            found = [judge(t) for t in b.column("text").to_pylist()]
            own = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *own, pa.array([rejected(x[0], x[2], margin) for x in found], pa.bool_())], names)

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, dicts: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of docs that aren't rejected, as they are."""
    small_batches(docs.sparkSession)

    def run(batches):
        judge = Classifier(dicts)
        for b in batches:
            found = [judge(t) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([not rejected(x[0], x[2], margin) for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def contract_dicts(docs: DataFrame) -> dict[str, bytes]:
    """Learned only from documents that are not held out."""
    return learn(docs.where(~F.coalesce(held_out(), F.lit(True))).select("text", "lang"))


def op4(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), contract_dicts(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), *RESULTS)
