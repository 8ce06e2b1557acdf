"""Quality rules by tokeniser fertility.

Two public vocabularies split each white-space separated word (the first with the leading space mark that its library
adds). Of a text this gives characters per token under both, tokens per word, the share of byte-fallback tokens, and the
entropy of its tokens as a share of the greatest that so many tokens can have. Words are split once per task and looked
up afterwards; all words of all texts count.

Bands. A text belongs to a group: the script that most of its letters are of (by Unicode block), its language where a
column names one, and its length (tokens, in steps of four times, since short texts scatter more). Of every group, over
all documents that pass the base rule, Spark takes the quartiles of each measure; the band is the median and WIDTH robust
standard deviations (quartile distance / 1.349, or a least one) to each side. A document outside of a band is rejected.
Groups of under LEAST documents use the band of their script and length, or of their script; without that, none.

Base counts stand beside these: words and their code points, symbols, lines that repeat an earlier line, and words in
5-word windows that occur twice or more.

Defined results: null and wordless texts have counts of zero, fail the base rule (under ten words) and have null
fertility; a null language is a language; repeated rows are judged one by one; a very long text is read whole, alone in
its slice; an empty table gives an empty result; further columns are kept whatever their names, except for those named
like a result, which are replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import SPACE, cut, few, per_text, read, slices, text_bytes, words
from driftwell.llm.decontaminate import mixed, run_hashes

FOLDER = "/opt/tokenizers"
PIECES, BYTE_PAIRS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The measures that have bands, with the least standard deviation of each.
MEASURES = {"chars_per_token": 0.02, "chars_per_token_2": 0.02, "tokens_per_word": 0.02, "byte_share": 0.01, "entropy_share": 0.01}
WIDTH = 5.0
LEAST = 30
#: Bands are broadcast up to so many rows.
MOST_BROADCAST = 10_000
#: Scripts, and the first bytes of their letters in UTF-8 (Unicode blocks; general punctuation has none).
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")
LEADS = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF], "cyrillic": [*range(0xD0, 0xD4)], "hebrew": [0xD6, 0xD7], "arabic": [*range(0xD8, 0xDC)], "indic": [0xE0], "kana": [0xE3], "han": [*range(0xE4, 0xEA)], "hangul": [*range(0xEA, 0xEE)], "other": [*range(0xCA, 0xCE), 0xD4, 0xD5, *range(0xDC, 0xE0), 0xE1, 0xEE, 0xEF, *range(0xF0, 0xF5)]}
LETTER = np.zeros(256, dtype=np.uint8)
for _name, _leads in LEADS.items():
    LETTER[_leads] = SCRIPTS.index(_name)


def at_texts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repeated_words(codes: np.ndarray, owner: np.ndarray, n: int, width: int = 5) -> np.ndarray:
    """Per text, its words in windows of `width` words that occur twice or more in it."""
    total = len(codes)
    if total < width:
        return np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(owner[: total - width + 1] == owner[width - 1 :])
    keys = run_hashes(mixed(codes.astype(np.uint64) + np.uint64(1)), width)[at] ^ mixed(owner[at].astype(np.uint64) + np.uint64(1 << 40))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    return per_text(owner[np.cumsum(edge[:-1]) > 0], n)


class Splitter:
    """Splits words with both vocabularies, remembering those it has seen; it starts afresh after `most` words."""

    def __init__(self, folder: str, most: int = 150_000):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        with open(f"{folder}/{BYTE_PAIRS}", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pairs = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.seen: dict[bytes, tuple[array, int]] = {}
        self.most = most

    def split(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all words, where each word's begin (one more than there are words), and its number of byte pairs."""
        if len(self.seen) > self.most:
            self.seen.clear()
        new = [w for w in found if w not in self.seen]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            texts = [w.decode("utf-8", "replace") for w in part]
            pieces = self.model.encode(texts, num_threads=1)
            self.seen.update((w, (array("H", p), len(self.pairs.encode_ordinary(" " + t)))) for w, p, t in zip(part, pieces, texts))
        ids = [self.seen[w] for w in found]
        ends = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum([len(x) for x, _ in ids], out=ends[1:])
        flat = np.frombuffer(b"".join(x.tobytes() for x, _ in ids), dtype=np.uint16).astype(np.int32)
        return flat, ends, np.array([n for _, n in ids], dtype=np.int64)


def fertility(codes: np.ndarray, owner: np.ndarray, n: int, ids: np.ndarray, ends: np.ndarray, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: number of tokens, number of byte-fallback tokens, entropy of the tokens in bits."""
    size = np.diff(ends)
    fallback = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(is_byte[ids], out=fallback[1:])
    fallback = fallback[ends[1:]] - fallback[ends[:-1]]
    tokens = per_text(owner, n, size[codes]).astype(np.int64)
    bytes_ = per_text(owner, n, fallback[codes]).astype(np.int64)
    pair, times = np.unique(owner * np.int64(len(size)) + codes, return_counts=True)
    text, code = pair // max(len(size), 1), pair % max(len(size), 1)
    each = size[code]
    at = np.repeat(ends[code] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    key = np.repeat(text, each) * np.int64(len(is_byte)) + ids[at]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.repeat(times, each)[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.add.reduceat(weight, first) if len(first) else weight
    text = key[first] // len(is_byte)
    total = np.maximum(tokens, 1)[text]
    return tokens, bytes_, per_text(text, n, -(count / total) * np.log2(count / total))


def script_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The script of most letters of each text, as an index into SCRIPTS; 0 without letters."""
    n = len(offsets) - 1
    letters = LETTER[data]
    at = np.flatnonzero(letters)
    owner = np.repeat(np.arange(n), np.diff(offsets))[at]
    counts = np.bincount(owner * len(SCRIPTS) + letters[at], minlength=n * len(SCRIPTS)).reshape(n, len(SCRIPTS))
    return counts.argmax(axis=1)


RESULTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_token_2 double, tokens_per_word double, byte_share double, token_entropy double, entropy_share double, script string, base_failed boolean"


def measure(docs: DataFrame, text: str = "text", folder: str = FOLDER, keep: list[str] | None = None, slice_bytes: int = 3 << 19, words_known: int = 150_000) -> DataFrame:
    """docs (or their columns `keep`) with the base counts, the measures, script and base_failed.

    slice_bytes of text are worked on at once and words_known remembered; both change time and memory, not results.
    """
    names = [x.split()[0] for x in RESULTS.split(", ")]
    kept_columns = [c for c in (docs.columns if keep is None else keep) if c not in (*names, *VERDICTS)]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(folder, words_known)
        for b in slices(found, "_text", slice_bytes):
            data, offsets = text_bytes(b.column("_text"))
            n = b.num_rows
            found_words, owner = words(data, offsets)
            coded = found_words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ids, ends, pairs = splitter.split(coded.dictionary.to_pylist())
            n_words = per_text(owner, n)
            chars = at_texts(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)
            repeats = repeated_words(codes, owner, n)
            lines = np.array([repeated_lines(x or "") for x in b.column("_text").to_pylist()], dtype=np.int64)
            tokens, fallback, entropy = fertility(codes, owner, n, ids, ends, splitter.is_byte)
            pairs = per_text(owner, n, pairs[codes])
            some = np.maximum(tokens, 1)
            failed = (n_words < 10) | (100 * repeats > 20 * n_words)
            none = tokens == 0
            values = [n_words, chars, at_texts(SYMBOL[data], offsets), lines, repeats, tokens]
            rates = [chars / some, chars / np.maximum(pairs, 1), tokens / np.maximum(n_words, 1), fallback / some, entropy, entropy / np.log2(np.maximum(tokens, 2))]
            script = pa.DictionaryArray.from_arrays(pa.array(script_of(data, offsets), pa.int32()), pa.array(SCRIPTS)).cast(pa.string())
            columns = [b.column(c) for c in kept_columns] + [pa.array(x.astype(np.int64)) for x in values] + [pa.array(x, pa.float64(), mask=none) for x in rates] + [script, pa.array(failed)]
            yield pa.RecordBatch.from_arrays(columns, names=kept_columns + names)

    chosen = docs.select(*[F.col(f"`{c}`") for c in kept_columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
    return docs.select(*[F.col(f"`{c}`") for c in kept_columns], F.col(f"`{text}`").alias("_text")).mapInArrow(batches, f"{schema}, {RESULTS}")


def length_class() -> Column:
    """Tokens in steps of four times: under 64, under 256, under 1024, and so on."""
    return F.greatest(F.lit(3), F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) / 2) + 1).cast("int")


def bands(measured: DataFrame) -> DataFrame:
    """(_script, _length, _language, level, and a low and a high bound of every measure) of measured(_language, ...).

    level 0: by all three keys; 1: by script and length; 3: by script.
    """
    rows = measured.filter(~F.col("base_failed") & (F.col("n_tokens") > 0)).select(F.col("script").alias("_script"), length_class().alias("_length"), "_language", *MEASURES)
    quartiles = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000)).alias(m) for m in MEASURES]
    grouped = rows.rollup("_script", "_length", "_language").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *quartiles).filter((F.col("n") >= LEAST) & (F.col("level") < 7))
    sides = []
    for m, least in MEASURES.items():
        spread = F.greatest((F.col(m)[2] - F.col(m)[0]) / F.lit(1.349), F.lit(least)) * F.lit(WIDTH)
        sides += [(F.col(m)[1] - spread).alias(f"{m}_low"), (F.col(m)[1] + spread).alias(f"{m}_high")]
    return grouped.select("_script", "_length", "_language", "level", F.struct(*sides).alias("band"))


VERDICTS = ("rejected_by", "kept")


def judge(docs: DataFrame, text: str = "text", language: str | None = None, folder: str = FOLDER, keep: list[str] | None = None, **sizes: int) -> DataFrame:
    """docs (or their columns `keep`) with what `measure` adds, the measures that reject each row, as a list, and kept.

    The measures are written once. sizes: slice_bytes and words_known of `measure`.
    """
    name = F.lit("") if language is None else F.coalesce(F.col(f"`{language}`").cast("string"), F.lit(""))
    measured = cut(measure(docs.withColumn("_language", name), text, folder, [*(docs.columns if keep is None else keep), "_language"], **sizes))
    fitted = cut(bands(measured))
    keyed = measured.withColumn("_script", F.col("script")).withColumn("_length", length_class())
    for level, keys in ((0, ["_script", "_length", "_language"]), (1, ["_script", "_length"]), (3, ["_script"])):
        keyed = keyed.join(few(fitted.filter(F.col("level") == level).select(*keys, F.col("band").alias(f"_band_{level}")), MOST_BROADCAST), keys, "left")
    band = F.coalesce("_band_0", "_band_1", "_band_3")
    outside = [F.when((F.col(m) < band[f"{m}_low"]) | (F.col(m) > band[f"{m}_high"]), F.lit(m)) for m in MEASURES]
    judged = keyed.withColumn("rejected_by", F.array_compact(F.array(*outside))).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    return judged.select(*[F.col(f"`{c}`") for c in measured.columns if c != "_language"], *VERDICTS)


def op8_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = judge(read(spark, sf_dir, "documents"), language="lang", keep=["doc_id"])
    return measured.select("doc_id", *COUNTS, "base_failed", "kept", "n_tokens", *MEASURES, "token_entropy", "script", F.array_join("rejected_by", ",").alias("rejected_by"))
