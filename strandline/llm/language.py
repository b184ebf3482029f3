"""Language of documents and of the segments that mixed-language texts consist of.

Words of running prose are scored per language; a word's script range narrows the
languages it may belong to; and a Viterbi pass over the words of a whole document,
in which changing the language costs a penalty, labels spans. Words that no language
knows are neutral one by one, but a run of them (gibberish) falls to a state of its own.

The word scores are trained here, on a bounded sample of labelled rows:
``SAMPLE_DOCS`` documents per language, chosen by a hash of their id. Labels may be
wrong, so the sample is labelled by the first model and counted again. Everything else
runs over all rows and whole texts, batch by batch in Arrow's and numpy's own loops.

Any language that some label names can be trained and found. Of scripts written without
blanks (Han, kana, Thai and others) each character is a word.

Headings, links, references, redirects, template and table fields are not prose; the
text of a quotation template is. Null or empty texts have no language. Equal texts get
equal results; rows with a null id are treated like others. Ties between languages go
to the alphabetically first. Confidence is the share of a span's known words that are more
likely in its language than in the average of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.shared import materialise

SAMPLE_DOCS = 400
#: Words of a language's vocabulary, the most frequent of the sample, and of all languages together.
VOCABULARY, MODEL_WORDS = 20_000, 400_000
SWITCH = 12.0
LEAST_LETTERS = 100
NONE = "zz"

#: Fixed: bibliographic three-letter codes that differ from the terminological ones.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de",
    "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}

#: Fixed: first code points of script ranges (Unicode blocks).
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "other"),
    (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xA960, "hangul"), (0xA980, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_FIRST = np.array([first for first, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])

_DROP = r"(?i)^\s*(\||!|\{\||==|#redirect|<includeonly|\[\[(category|file|image)\b[^\]]*\]\]\s*$)"
_MARKUP = r"(?i)<ref[^>/]*>[^<]*</ref>|<[^<>]*>|\{\{\{?[^{}]*\}?\}\}|\[\[[^\[\]]*\]\]|\[https?:[^\]]*\]|&#?[a-z0-9]+;"


#: Scripts written without blanks between words: each character is a word.
_SOLID = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"


@lru_cache(maxsize=1)
def label_table() -> dict[str, str]:
    """Labels to two-letter codes: ISO 639 codes of two and three letters and English names, as the JVM's locales list them."""
    jvm = SparkSession.active().sparkContext._jvm
    table: dict[str, str] = {}
    for two in jvm.java.util.Locale.getISOLanguages():
        locale = jvm.java.util.Locale(two)
        code = locale.getLanguage()
        for label in (two, code, locale.getISO3Language(), locale.getDisplayLanguage(jvm.java.util.Locale.ENGLISH).lower()):
            if label:
                table.setdefault(label, code)
    return table | BIBLIOGRAPHIC


def named(label: Column) -> Column:
    """Two-letter code of the language that a label names, or null."""
    m = F.create_map(*[F.lit(x) for kv in sorted(label_table().items()) for x in kv])
    plain = F.lower(F.trim(label))
    return F.coalesce(m[F.regexp_extract(plain, "^([a-z]+)(?:[-_][a-z0-9_-]+)?$", 1)], F.when(plain.contains(" "), m[plain]))


def prose_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of the prose and the index of the text each belongs to."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    parent = pc.list_parent_indices(lines)
    flat = pc.list_flatten(lines)
    keep = pc.invert(pc.match_substring_regex(flat, _DROP))
    flat, parent = flat.filter(keep), parent.filter(keep)
    flat = pc.replace_substring_regex(flat, r"(?i)\{\{\s*(quote|blockquote|cquote)\s*\|", " ")
    flat = pc.replace_substring_regex(flat, _MARKUP, " ")
    flat = pc.replace_substring_regex(flat, r"\{\{[^}]*$|\[\[(.*\|)?", " ")
    flat = pc.utf8_lower(pc.replace_substring_regex(flat, r"[^\p{L}\p{M}]+", " "))
    solid = pc.match_substring_regex(flat, _SOLID)
    if pc.any(solid).as_py():
        flat = pc.if_else(solid, pc.replace_substring_regex(flat, f"({_SOLID})", r" \1 "), flat)
    flat = pc.utf8_trim(flat, " ")
    words = pc.split_pattern(flat, " ")
    owner = parent.take(pc.list_parent_indices(words))
    words = pc.list_flatten(words)
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some), owner.filter(some).to_numpy(zero_copy_only=False).astype(np.int64)


def scripts_of(words: pa.Array) -> np.ndarray:
    """Index into SCRIPTS of each word's first character, by its code point."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.int64)
    a = words.cast(pa.large_string())
    _, offsets, data = a.buffers()
    start = np.frombuffer(offsets, dtype=np.int64)[a.offset : a.offset + len(a)]
    octets = np.frombuffer(data, dtype=np.uint8)
    lead = octets[start].astype(np.int64)
    point = lead.copy()
    # UTF-8: the lead octet gives the number of further ones, which give six bits each
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        some = np.flatnonzero(lead >= least)
        value = lead[some] & mask
        for k in range(1, more + 1):
            value = (value << 6) | (octets[np.minimum(start[some] + k, len(octets) - 1)] & 0x3F)
        point[some] = value
    return _SCRIPT[np.searchsorted(_FIRST, point, side="right") - 1]


class Model:
    """Word scores: rows are the vocabulary, then unknown words by script and length, then padding."""

    LENGTHS = 12

    def __init__(self, counts: dict[tuple[str, str], float], least: int = 5) -> None:
        totals: dict[str, float] = {}
        for (_, lang), n in counts.items():
            totals[lang] = totals.get(lang, 0.0) + n
        self.langs = sorted(totals)
        col = {lang: i for i, lang in enumerate(self.langs)}
        per: dict[str, np.ndarray] = {}
        for (word, lang), n in counts.items():
            per.setdefault(word, np.zeros(len(col)))[col[lang]] += n
        # a word is known if some language uses it often enough
        self.words = sorted(w for w, c in per.items() if c.max() >= least)
        size = np.array([totals[x] for x in self.langs])
        c = np.array([per[w] for w in self.words]).reshape(len(self.words), len(col))
        rate = (c + 0.05) / (size + 0.05 * max(len(self.words), 1))
        known = np.log(rate) - np.log(rate.mean(1, keepdims=True)) if len(self.words) else np.zeros((0, len(col)))
        home = np.zeros((len(SCRIPTS), len(col)), dtype=bool)  # scripts that a language is written in
        if self.words:
            s = scripts_of(pa.array(self.words))
            for j in range(len(SCRIPTS)):
                home[j] = rate[s == j].sum(0) > 0.1 * rate.sum(0)
            known = np.where(home[s], known, -6.0)
        unknown = np.array([[np.where(home[j], -0.25 * k, -6.0) for k in range(1, self.LENGTHS + 1)] for j in range(len(SCRIPTS))]).reshape(len(SCRIPTS) * self.LENGTHS, len(col))
        rows = np.vstack([np.clip(known, -6.0, 3.0), unknown, np.zeros((1, len(col)))])
        none = np.concatenate([np.full(len(self.words), -2.0), np.zeros(len(unknown) + 1)])
        self.scores = np.hstack([rows, none[:, None]]).astype(np.float32)
        self.states = [*self.langs, NONE]
        self._value_set: pa.Array | None = None

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score row and letters of each word; distinct words are looked up once."""
        if len(words) == 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if self._value_set is None:
            self._value_set = pa.array(self.words, pa.string())
        coded = words.dictionary_encode()
        each = coded.dictionary
        at = pc.index_in(each, value_set=self._value_set).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = pc.utf8_length(each).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.where(at >= 0, at, len(self.words) + scripts_of(each) * self.LENGTHS + np.minimum(letters, self.LENGTHS) - 1)
        where = coded.indices.to_numpy(zero_copy_only=False)
        return row[where], letters[where]

    def ids(self, words: pa.Array) -> np.ndarray:
        return self.encode(words)[0]


def viterbi(ids: np.ndarray, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best states for sequences in columns (steps x sequences), padded with the last score row.

    Values are kept relative to the best state, so changing costs the same everywhere and
    a step is four passes over states x sequences; from where a path came is worked out
    on the way back, only where it changes.
    """
    steps, n = ids.shape
    gain = np.take(np.ascontiguousarray(scores.T), ids, axis=1)
    before = np.empty((steps, scores.shape[1], n), dtype=np.float32)
    best = np.zeros((scores.shape[1], n), dtype=np.float32)
    least = np.float32(-switch)
    for t in range(steps):
        before[t] = best
        np.maximum(best, least, out=best)
        best += gain[:, t]
        best -= best.max(0)
    out = np.empty((steps, n), dtype=np.int16)
    state = best.argmax(0)
    every = np.arange(n)
    for t in range(steps - 1, -1, -1):
        out[t] = state
        moved = before[t, state, every] < least
        if moved.any():
            state[moved] = before[t][:, moved].argmax(0)
    return out


def label_words(ids: np.ndarray, owner: np.ndarray, texts: int, model: Model, values: int = 4_000_000) -> np.ndarray:
    """State of every word; texts of like length go through the Viterbi pass side by side."""
    pad = len(model.scores) - 1
    cells = values // model.scores.shape[1]
    length = np.bincount(owner, minlength=texts)
    first = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(len(ids), dtype=np.int16)
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * length[order[j]] <= cells and length[order[j]] <= 2 * length[order[i]] + 64:
            j += 1
        some = order[i:j]
        grid = np.full((int(length[some].max()), j - i), pad, dtype=np.int64)
        for k, doc in enumerate(some):
            grid[: length[doc], k] = ids[first[doc] : first[doc + 1]]
        states = viterbi(grid, model.scores)
        for k, doc in enumerate(some):
            out[first[doc] : first[doc + 1]] = states[: length[doc], k]
        i = j
    return out


def spans(words: pa.Array, owner: np.ndarray, texts: int, model: Model, whole: bool) -> dict[str, np.ndarray]:
    """Segments of one language (``whole``: all segments of a text's language as one row)."""
    ids, letters = model.encode(words)
    state = label_words(ids, owner, texts, model)
    known = ids < len(model.words)
    right = known & (model.scores[ids, state] > 0)
    L = len(model.states)
    if whole:
        key, group = np.unique(owner * L + state, return_inverse=True)
        lead = np.full(len(key), len(ids))
        np.minimum.at(lead, group, np.arange(len(ids)))
    else:
        new = np.flatnonzero(np.diff(owner * L + state, prepend=-1))
        lead = new
        group = np.cumsum(np.bincount(new, minlength=len(ids))) - 1 if len(ids) else np.zeros(0, dtype=int)
        key = (owner * L + state)[new]
    m = len(key)
    start = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=texts))])
    doc, lang = key // L, key % L
    total = np.bincount(group, weights=known, minlength=m)
    return {
        "text": doc, "state": lang, "first_word": lead - start[doc], "words": np.bincount(group, minlength=m), "letters": np.bincount(group, weights=letters, minlength=m).astype(np.int64),
        "confidence": np.where(total > 0, np.bincount(group, weights=right, minlength=m) / np.maximum(total, 1), 0.0),
    }


def _slices(batch: pa.RecordBatch, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with bounded text, so that memory doesn't grow with it."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + chars, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _count(df: DataFrame, model: Model | None, languages: int) -> dict[tuple[str, str], float]:
    """Words per language in (text, lang), of so many languages: by the label, or by the model's own labels."""
    states = model.states if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                words, owner = prose_words(part.column("text"))
                if model:
                    ids = model.ids(words)
                    lang = pa.array(states).take(pa.array(label_words(ids, owner, part.num_rows, model)))
                else:
                    lang = part.column("lang").take(pa.array(owner))
                t = pa.table({"word": words, "lang": lang}).group_by(["word", "lang"]).aggregate([([], "count_all")]).rename_columns(["word", "lang", "n"])
                yield from t.combine_chunks().to_batches()

    counted = df.select("text", "lang").mapInArrow(run, "word string, lang string, n bigint")
    sums = counted.where("length(word) <= 40").groupBy("word", "lang").agg(F.sum("n").alias("n")).where(F.col("lang") != NONE).where("n >= 2")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))  # of the sample's words only
    top = sums.withColumn("r", rank).where(F.col("r") <= min(VOCABULARY, MODEL_WORDS // max(languages, 1)))
    return {(r["word"], r["lang"]): float(r["n"]) for r in top.collect()}


def train(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    """Model from ``per_language`` labelled documents a language, chosen by a hash of doc_id."""
    d = docs.select("doc_id", "text", named(F.col("lang")).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 11) / F.lit(float(2**53))
    sample = materialise(d.where(u < rate[F.col("lang")]).select("text", "lang"))
    first = Model(_count(sample, None, len(sizes)))
    return Model(_count(sample, first, len(sizes))) if first.words else first


def identify(docs: DataFrame, model: Model, segments: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(keep..., language, first_word, words, letters, confidence) per document and language.

    ``segments`` gives one row per span instead. ``keep`` are columns to carry, by
    default doc_id. Spans of unknown words come as language ``zz``.
    """
    keep = keep or ["doc_id"]
    d = docs.select(*keep, "text")
    schema = T.StructType([*[d.schema[c] for c in keep], *[T.StructField(n, t()) for n, t in (("language", T.StringType), ("first_word", T.LongType), ("words", T.LongType), ("letters", T.LongType), ("confidence", T.DoubleType))]])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.states)
        for b in batches:
            for part in _slices(b):
                words, owner = prose_words(part.column("text"))
                s = spans(words, owner, part.num_rows, m, not segments)
                rows = pa.array(s["text"])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(rows) for c in keep], names.take(pa.array(s["state"])), *[pa.array(s[c].astype(np.int64)) for c in ("first_word", "words", "letters")], pa.array(s["confidence"].astype(np.float64))],
                    names=[*keep, "language", "first_word", "words", "letters", "confidence"],
                )

    return d.mapInArrow(run, schema)
