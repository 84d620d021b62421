"""Quality rules (operator 4): tokeniser fertility with rejection bands per language or script.

Base rules count words, symbols, repeated lines and repeated three-word windows.  The method proper encodes
every word with a public piece vocabulary and measures, over the whole text: characters per token,
share of byte-fallback tokens, and entropy of the token distribution (relative to its maximum for the
text's length).  For each language (column ``lang``, or the script where it is null or missing), all texts that pass
the base rules give what is usual: the median of the first two measures, and a line of entropy over the logarithm of the
number of tokens, with which it falls.  Distances from the usual, shortened for texts below the group's median length,
whose measures vary more, have quartiles; a text farther from the median distance than ``reach`` quartile distances is
rejected, and one whose entropy lies more than ``least_entropy`` of them below (symbol junk and lists repeat their
tokens; clean texts stray upwards rather than downwards).  Lines and bands are computed over the whole table by mergeable
sums and quantile summaries, one row per group.  A language of fewer than ``least_group`` such texts is judged by the lines and bands
of all texts of the script, and a script of fewer by those of the whole table, so every text is judged at every size.

Defined cases: null and empty texts have no words and fail the base rules; a text without letters belongs to
the script ``Zyyy``; repeated rows are judged each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")
#: Distances of short texts are not shortened below this share: that of texts of a quarter of the median length.
LEAST_SCALE = 0.5
COLUMNS = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, fallback_share double, token_entropy double"

#: First code points of letter ranges and the script that starts there (a coarse table of Unicode blocks).
SCRIPTS = ((0x41, "Latn"), (0x370, "Grek"), (0x400, "Cyrl"), (0x530, "Armn"), (0x590, "Hebr"), (0x600, "Arab"), (0x700, "Zyyy"), (0x900, "Deva"), (0x980, "Zyyy"), (0xE00, "Thai"), (0xE80, "Zyyy"), (0x1E00, "Latn"), (0x1F00, "Grek"), (0x2000, "Zyyy"), (0x3040, "Jpan"), (0x3100, "Zyyy"), (0x3400, "Hani"), (0xA000, "Zyyy"), (0xAC00, "Hang"), (0xD7B0, "Zyyy"))


class Pieces:
    """Token ids and count of byte-fallback tokens of single words, with a bounded memo."""

    def __init__(self, path: str, memo_size: int = 500_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.memo: dict[bytes, bytes] = {}
        self.memo_size = memo_size

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers."""
        memo = self.memo
        fresh = [w for w in words if w not in memo]
        if fresh:
            if len(memo) > self.memo_size:
                memo.clear()
                fresh = words
            coded = self.model.encode([w.decode("utf-8") for w in fresh], num_threads=1)
            memo.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(fresh, coded))
        return [memo[w] for w in words]


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def forget(most: int = 200_000) -> None:
    """Empty the memos of more than ``most`` words."""
    for own in _pieces.values():
        if len(own.memo) > most:
            own.memo = {}


common.memos.append(forget)


def script_of(text: str) -> str:
    """The script of most letters; ties go to the first name."""
    if text.isascii():
        return "Latn" if any(map(str.isalpha, text)) else "Zyyy"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    from .language import letter_table

    points = points[letter_table()[points]]
    if not len(points):
        return "Zyyy"
    where = np.searchsorted([s for s, _ in SCRIPTS], points, "right") - 1
    names = [n for _, n in SCRIPTS]
    counts: Counter[str] = Counter()
    for k, n in enumerate(np.bincount(where, minlength=len(names))):
        counts[names[k]] += int(n)
    return min(counts, key=lambda s: (-counts[s], s))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if distinct < 1 << 21:
        k = np.int64(distinct)
        keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * np.int64(distinct) + ids[1:], return_inverse=True)
        keys = pair[:-1] * np.int64(distinct) + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    covered = np.zeros(n, bool)
    at = order[twice]
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def measure(text: str, coder: Pieces) -> tuple:
    """All columns but doc_id and lang, for one text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    if not words:
        return (script_of(text), 0, chars, symbols, dup_lines, 0, None, None, None)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    coded = coder.of(list(seen))
    times = np.bincount(ids)
    tokens = np.frombuffer(b"".join(coded), "<u4")
    each = np.repeat(times, np.fromiter(map(len, coded), np.int64, len(coded)) // 4)
    total = int(each.sum())
    counts = np.bincount(tokens, weights=each)
    counts = counts[counts > 0]
    share = counts / total
    entropy = float(-(share * np.log2(share)).sum() / np.log2(total)) if total > 1 else 0.0
    return (script_of(text), len(words), chars, symbols, dup_lines, repeated_words(ids, len(seen)), chars / total, float(each[coder.is_byte[tokens]].sum() / total), entropy)


def measures(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, lang, the base counts and the three measures of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(vocabulary)
        kinds = [pa.string()] + [pa.int64()] * 5 + [pa.float64()] * 3
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for table in common.blocks(batches):
            rows = [measure(t, coder) for t in common.texts_of(table)]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), table.column("lang").combine_chunks(), *cols], names=names)

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(common.tidied(run, forget, cycles=False), COLUMNS)


WHOLE = "whole table"


def groups_of(measured: DataFrame) -> list[Column]:
    """The groups that a text belongs to: its language, its script, the whole table."""
    script = F.concat(F.lit("script "), "script")
    return [F.coalesce(F.concat(F.lit("language "), "lang"), script), script, F.lit(WHOLE)]


def chosen_groups(measured: DataFrame, least_group: int) -> DataFrame:
    """own_lang, own_script, group: the first group of each pair with ``least_group`` texts that pass the base rules, else the whole table."""
    pairs = measured.groupBy("lang", "script").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    levels = pairs.select("lang", "script", "n", *(g.alias(f"g{k}") for k, g in enumerate(groups_of(pairs))))
    for k in range(2):  # over pairs, not texts
        levels = levels.withColumn(f"n{k}", F.sum("n").over(Window.partitionBy(f"g{k}")))
    group = F.when(F.col("n0") >= least_group, F.col("g0")).when(F.col("n1") >= least_group, F.col("g1")).otherwise(F.lit(WHOLE))
    return levels.select(F.col("lang").alias("own_lang"), F.col("script").alias("own_script"), group.alias("group"))


def few(found: DataFrame, most: int = 50_000) -> DataFrame:
    """``found`` for a broadcast where it has ``most`` rows at most; more are left to the planner."""
    return F.broadcast(found) if found.limit(most + 1).count() <= most else found


def trends(measured: DataFrame) -> DataFrame:
    """One row per group: its median length, the medians of two measures, and the line of entropy over the logarithm of the number of tokens."""
    entropy, tokens = F.col("token_entropy"), F.log(F.col("word_chars") / F.col("chars_per_token"))
    slope = F.coalesce(F.regr_slope(entropy, tokens), F.lit(0.0))
    middle = [F.percentile_approx(m, 0.5, 10000).alias(f"usual_{m}") for m in ("n_words", *MEASURES[:2])]
    found = measured.groupBy("group").agg(F.count("*").alias("n"), *middle, F.round(slope, 6).alias("slope"), F.round(F.avg(entropy) - slope * F.avg(tokens), 6).alias("start"))
    return found.withColumnRenamed("group", "trend_group")


def distances(measured: DataFrame, trend: DataFrame) -> DataFrame:
    """Adds the distance of each measure from what is usual for the group (and the length), on the scale of the group's median length.

    Measures of n words vary as 1 / sqrt(n), so the distances of shorter texts are shortened before the quartiles are
    taken; by ``LEAST_SCALE`` at most.
    """
    out = measured.join(trend, F.col("group") == F.col("trend_group"), "left")
    scale = F.greatest(F.lit(LEAST_SCALE), F.sqrt(F.least(F.lit(1.0), F.col("n_words") / F.col("usual_n_words"))))
    usual = {m: F.col(f"usual_{m}") for m in MEASURES[:2]} | {"token_entropy": F.col("start") + F.col("slope") * F.log(F.col("word_chars") / F.col("chars_per_token"))}
    for m in MEASURES:
        out = out.withColumn(f"off_{m}", (F.col(m) - usual[m]) * scale)
    return out


def bands(placed: DataFrame) -> DataFrame:
    """One row per group: median and quartile distances of each measure's distance from the usual."""
    quartiles = [F.percentile_approx(f"off_{m}", [0.25, 0.5, 0.75], 10000).alias(m) for m in MEASURES]
    found = placed.groupBy("group").agg(*[F.first(f"usual_{m}").alias(f"usual_{m}") for m in MEASURES[:2]], *quartiles)
    out = [F.col("group").alias("band_group")]
    for m in MEASURES:
        low, mid, high = (F.col(m)[k] for k in range(3))
        # half a hundredth of the median at least: a near-constant measure must not reject all but its commonest value
        least = F.col(f"usual_{m}") * 0.005 if m in MEASURES[:2] else F.lit(0.0)
        out += [mid.alias(f"mid_{m}"), F.greatest(mid - low, least).alias(f"below_{m}"), F.greatest(high - mid, least).alias(f"above_{m}")]
    return found.select(*out)


def quality(docs: DataFrame, vocabulary: str, reach: float = 6.0, least_entropy: float = 4.0, margin: float = 0.005, least_group: int = 100) -> DataFrame:
    """The measures of every row with base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = common.stored(measures(docs, vocabulary).withColumn("base_failed", failed), "quality-measures")
    of_all = measured.filter("not base_failed")
    of_all = of_all.withColumn("group", F.explode(F.array_distinct(F.array(*groups_of(of_all)))))
    trend = common.stored(trends(of_all), "quality-trends")
    band = common.stored(bands(distances(of_all, few(trend))), "quality-bands")
    chosen = few(common.stored(chosen_groups(measured, least_group), "quality-groups"))
    grouped = measured.join(chosen, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("script").eqNullSafe(F.col("own_script")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        down = least_entropy if m == "token_entropy" else reach
        low, high = F.col(f"mid_{m}") - down * F.col(f"below_{m}") - margin, F.col(f"mid_{m}") + reach * F.col(f"above_{m}") + margin
        inside &= F.coalesce(F.col(f"off_{m}").between(low, high), F.lit(True))
    judged = distances(grouped, few(trend)).join(few(band), F.col("group") == F.col("band_group"), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & inside).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", *MEASURES, "group")
