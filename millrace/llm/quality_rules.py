"""Quality rules: fixed counts per text, then robust multivariate outliers per language and source.

The counts become a short vector of transformed rates. For every language and source a minimum
covariance determinant estimate is refined by concentration steps: keep the closer three quarters
of the rows, estimate centre and covariance from them, repeat. A row is rejected when its squared
Mahalanobis distance from its group's estimate passes the cut-off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import byte_view, slices, stage
from millrace.llm.words import Hashes, mix, runs_of, word_spans

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
LETTERS = np.ones(256, np.int64)
LETTERS[0x80:0xC0] = 0
UPPER = np.zeros(256, np.int64)
UPPER[ord("A") : ord("Z") + 1] = 1

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
FEATURES = 6
FLOORS = (0.3, 0.06, 0.02, 0.1, 0.08, 0.02)
"""Least standard deviation per feature, in its own unit: rates that are zero in most texts have no spread of their own, and one repeated line of five is no sign."""
LEAST_ROWS = 60
"""Groups with fewer rows are pooled by language, and pools with fewer over all languages."""
KEEP_SHARE = 0.75
STEPS = 3
CUT_OFF = 22.458
"""Squared distance beyond which a text is rejected: the 0.999 quantile of a chi-square of six degrees."""
CONSISTENCY = 1.0 / 0.7
"""Undoes the shrinking of the covariance of the closer three quarters."""


def count_words(batch: pa.RecordBatch, text: str) -> dict[str, np.ndarray]:
    raw, offsets = byte_view(batch.column(text))
    starts, ends, first = word_spans(raw, offsets)
    rows = len(offsets) - 1
    hashes = Hashes(raw)
    per_row = np.diff(first)
    row_of_word = np.repeat(np.arange(rows), per_row)
    sums = lambda values: np.concatenate([[0], np.cumsum(values)])
    letters = sums(LETTERS[raw])
    upper = sums(UPPER[raw])
    inside = sums(letters[ends] - letters[starts])
    shouted = sums(upper[ends] - upper[starts])
    symbols = sums(SYMBOLS[raw])

    windows = runs_of(hashes.of(starts, ends), 5)
    repeat = np.zeros(rows, np.int64)
    if len(windows):
        whole = np.flatnonzero(row_of_word[: len(windows)] == row_of_word[4:])
        keys = mix(windows[whole] + row_of_word[whole].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        hit = whole[times[which] > 1]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        repeat = np.bincount(row_of_word[np.cumsum(cover[:-1]) > 0], minlength=rows)

    breaks = np.flatnonzero(raw == 0x0A)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(raw)] if len(raw) else np.empty(0, np.int64)
    row_of_line = np.searchsorted(offsets, line_starts, side="right") - 1
    next_break = np.append(breaks, len(raw))[np.searchsorted(breaks, line_starts)] if len(line_starts) else line_starts
    line_ends = np.minimum(next_break, offsets[row_of_line + 1])
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    row_of_line, line_starts, line_ends = row_of_line[worded], line_starts[worded], line_ends[worded]
    keys = mix(hashes.of(line_starts, line_ends) + row_of_line.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, firsts = np.unique(keys, return_index=True)
    lines = np.bincount(row_of_line, minlength=rows)
    return {
        "n_words": per_row.astype(np.int64),
        "word_chars": inside[first[1:]] - inside[first[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": lines - np.bincount(row_of_line[firsts], minlength=rows),
        "n_repeat_words": repeat.astype(np.int64),
        "n_lines": lines,
        "n_upper": shouted[first[1:]] - shouted[first[:-1]],
    }


def text_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of every whole text, null as empty. Row per row, without a shuffle."""
    schema = documents.schema
    carried = [id_col, *keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                counts = count_words(batch, text_col)
                yield pa.record_batch(
                    [*(batch.column(c) for c in carried), *(pa.array(counts[c]) for c in COUNTS)], names=[*carried, *COUNTS]
                )

    fields = ", ".join([*(f"`{c}` {schema[c].dataType.simpleString()}" for c in carried), *(f"{c} long" for c in COUNTS)])
    return documents.select(*carried, text_col).mapInArrow(work, fields)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(F.col("n_symbols") / words),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / words,
        F.log1p(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x0..`` from the estimate in ``centre`` and ``inverse``."""
    away = [F.col(f"x{i}") - F.col("centre")[i] for i in range(FEATURES)]
    total = F.lit(0.0)
    for i in range(FEATURES):
        for j in range(i, FEATURES):
            total = total + (1 if i == j else 2) * away[i] * away[j] * F.col("inverse")[i * FEATURES + j]
    return total


def _estimates(moments: DataFrame, consistency: float) -> DataFrame:
    """Centre and inverse covariance of each group from its sums."""
    pairs = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            centres, inverses = [], []
            for row in frame.to_dict("records"):
                mean = np.array([row[f"s{i}"] for i in range(FEATURES)]) / row["n"]
                cov = np.zeros((FEATURES, FEATURES))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = row[f"p{i}_{j}"] / row["n"] - mean[i] * mean[j]
                cov = cov * consistency
                spread = np.sqrt(np.maximum(np.diag(cov), 0))
                cov[np.diag_indices(FEATURES)] += np.maximum(np.square(FLOORS) - np.square(spread), 1e-3 * np.square(FLOORS))
                centres.append(mean.tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
            yield pd.DataFrame({"grp": frame["grp"], "centre": centres, "inverse": inverses})

    return moments.mapInPandas(solve, "grp string, centre array<double>, inverse array<double>")


def _moments(rows: DataFrame) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(FEATURES)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(FEATURES) for j in range(i, FEATURES)]
    return rows.groupBy("grp").agg(F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(FEATURES)), *products)


def mcd_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``grp, centre, inverse`` from rows ``grp, x0..``, all rows counted.

    The first estimate is the median with a spread from the quartiles, without correlation; each
    step keeps the rows within the group's three-quarter quantile of distance. Everything is an
    aggregate with partial sums, so a hot group stays spread over the tasks that read it.
    """
    quartiles = rows.groupBy("grp").agg(
        *(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(FEATURES))
    )
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.35, F.lit(FLOORS[i])) for i in range(FEATURES)]
    inverse = [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(FEATURES) for j in range(FEATURES)]
    estimate = stage(
        quartiles.select("grp", F.array(*(F.col(f"q{i}")[1] for i in range(FEATURES))).alias("centre"), F.array(*inverse).alias("inverse")),
        "mcd",
    )
    for _ in range(steps):
        near = rows.join(estimate, "grp").withColumn("d2", _distance())
        bound = near.groupBy("grp").agg(F.percentile_approx("d2", KEEP_SHARE, 2000).alias("bound"))
        closer = near.join(bound, "grp").filter(F.col("d2") <= F.col("bound"))
        estimate = stage(_estimates(_moments(closer), CONSISTENCY), "mcd")
    return estimate


def quality_verdicts(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cut_off: float = CUT_OFF,
) -> DataFrame:
    """Each row's counts, ``base_failed``, ``distance`` and ``kept``.

    Rows that fail the base rules are not kept and not part of any estimate; of the others, those
    within ``cut_off`` of their group's estimate are kept. A null language or source is a group of
    its own. Rows whose group, language pool and overall pool are all smaller than ``LEAST_ROWS``
    have no estimate: their distance is null and they are kept. A null or empty text has no words
    and fails. Repeated rows and ties count as often as they occur and each gets the same verdict;
    null ids pass through; other columns are not read; an empty table gives an empty result.
    """
    counted = text_counts(
        documents.select(id_col, text_col, F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source")),
        id_col,
        text_col,
        ("_lang", "_source"),
    )
    counts = stage(
        counted.select("*", base_failed().alias("base_failed"), *(f.alias(f"x{i}") for i, f in enumerate(features()))), "quality"
    )
    part = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c)))
    fine, coarse = F.concat_ws("\0", part("_lang"), part("_source")), part("_lang")
    rows = counts.filter(~F.col("base_failed")).withColumn("fine", fine).withColumn("coarse", coarse)
    sizes = rows.groupBy("fine", "coarse").agg(F.count("*").alias("n"))
    pools = sizes.filter(F.col("n") < LEAST_ROWS).groupBy("coarse").agg(F.sum("n").alias("pool"))
    groups = stage(
        sizes.join(pools, "coarse", "left").select(
            "fine",
            F.when(F.col("n") >= LEAST_ROWS, F.col("fine"))
            .when(F.col("pool") >= LEAST_ROWS, F.concat(F.col("coarse"), F.lit("\0*")))
            .otherwise(F.lit("*"))
            .alias("grp"),
            "n",
        ),
        "groups",
    )
    fitted = groups.groupBy("grp").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_ROWS).select("grp")
    members = groups.join(fitted, "grp").select("fine", "grp")
    points = rows.join(members, "fine").select("grp", *(f"x{i}" for i in range(FEATURES)))
    estimates = mcd_estimates(stage(points, "points"))
    known = members.join(estimates, "grp").select("fine", "centre", "inverse")
    judged = counts.withColumn("fine", fine).join(known, "fine", "left").withColumn("distance", _distance())
    return judged.select(
        id_col,
        *COUNTS,
        "base_failed",
        "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cut_off, F.lit(True))).alias("kept"),
    )
