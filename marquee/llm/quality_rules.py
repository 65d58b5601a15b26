"""Operator 4: quality rules as a learned decision list, in native expressions only.

:func:`features` counts words, symbols, repeated lines and repeated three-word
windows of every whole text with built-in functions. :func:`learn` runs
sequential covering over the features of a bounded sample of labelled rows
(``most`` rows, the least by a hash of their ids): it grows a conjunction of
thresholds by information gain on two thirds of the rows, prunes it from its
end on the last third, keeps it if it is precise enough there, takes away what
it covers and goes on. :func:`verdict` is the ordered list as one Spark
conditional expression.

Defined results: null text has no words; no words or no labels never crash
(without labels nothing is rejected by the list). A label of a null or unknown
document is not used; a document that is labelled twice counts twice. Three-word
windows are ordered by 64 bits of a hash and then compared word by word. Columns
of the input that are called like one of the results are left out of features()
and judge(); kept_rows() returns the input's columns as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TRAINING_ROWS = 20_000
BINS = 32
LEAST_PRECISION = 0.9
LEAST_COVER = 5
MOST_RULES = 24
MOST_CONDITIONS = 3
_SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")

#: What the conditions look at, over the columns of features().
LEARNED = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words": "double(n_words)",
}


def _inner(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of docs as _c0, _c1, ... (so that no name clashes), and COUNTS."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    t = docs.toDF(*own)
    t = t.withColumn("_t", F.coalesce(F.col(own[docs.columns.index(text_col)]).cast("string"), F.lit("")))
    t = t.withColumn("_w", F.array_remove(F.split("_t", _SPACE), ""))
    t = t.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    t = t.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    # each window's hash with its place, sorted: equal windows become neighbours
    t = t.withColumn(
        "_s",
        F.expr("""
            if(size(_h) < 4, cast(array() as array<struct<h: bigint, p: int>>),
               sort_array(transform(sequence(0, size(_h) - 3),
                 i -> named_struct('h', xxhash64(get(_h, i), get(_h, i + 1), get(_h, i + 2)), 'p', i))))"""),
    )
    same = lambda a, b: f"({a}.h = {b}.h" + "".join(f" and get(_w, {a}.p + {d}) = get(_w, {b}.p + {d})" for d in range(3)) + ")"
    t = t.withColumn("_r", F.expr(f"filter(_s, (x, j) -> coalesce({same('x', 'get(_s, j + 1)')}, false) or (j > 0 and coalesce({same('x', 'get(_s, j - 1)')}, false)))"))
    t = t.withColumn("_r", F.expr("sort_array(transform(_r, x -> x.p))"))
    return t.select(
        *own,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(_r, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)").alias("n_repeat_words"),
    )


def _outer(docs: DataFrame, inner: DataFrame, *results: str) -> DataFrame:
    """inner with the columns of docs under their own names, without those called like a result."""
    keep = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in results]
    return inner.select(*keep, *results)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines and n_repeat_words (longs)."""
    return _outer(docs, _inner(docs, text_col), *COUNTS)


Rule = list[tuple[str, bool, float]]  # (feature, at least, threshold) conjunctions


def _thresholds(rows: list[tuple], k: int) -> list[float]:
    values = sorted({r[k] for r in rows})
    if len(values) <= BINS:
        return values
    ordered = sorted(r[k] for r in rows)
    some = {ordered[min(len(ordered) - 1, len(ordered) * i // BINS)] for i in range(BINS)}
    return sorted(some | {values[-1], values[1]})


def _covers(rule: list[tuple[int, bool, float]], row: tuple) -> bool:
    return all((row[k] >= x) == up for k, up, x in rule)


def _grow(rows: list[tuple]) -> list[tuple[int, bool, float]]:
    """Adds the condition of the greatest gain while it gains; rows end with 1 for what is to be rejected."""
    rule: list[tuple[int, bool, float]] = []
    while len(rule) < MOST_CONDITIONS:
        pos = sum(r[-1] for r in rows)
        if not pos or pos == len(rows):
            break
        base, best, gain = math.log2(pos / len(rows)), None, 1e-9
        for k in range(len(rows[0]) - 1):
            cuts = _thresholds(rows, k)
            ordered, i, p_low, n_low = sorted((r[k], r[-1]) for r in rows), 0, 0, 0
            for x in cuts:
                while i < len(ordered) and ordered[i][0] < x:
                    p_low, n_low, i = p_low + ordered[i][1], n_low + 1, i + 1
                for up, p, n in ((True, pos - p_low, len(rows) - n_low), (False, p_low, n_low)):
                    if p >= LEAST_COVER and (g := p * (math.log2(p / n) - base)) > gain:
                        best, gain = (k, up, x), g
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if _covers([best], r)]
    return rule


def cover(rows: list[tuple], names: list[str]) -> list[Rule]:
    """Sequential covering over rows (features..., 1 = reject), in the rows' order."""
    grow_rows, prune_rows, rules = [r for i, r in enumerate(rows) if i % 3], rows[::3], []
    while len(rules) < MOST_RULES and any(r[-1] for r in grow_rows):
        rule = _grow(grow_rows)
        best, best_score = [], -1.0
        for end in range(1, len(rule) + 1):
            hit = [r[-1] for r in prune_rows if _covers(rule[:end], r)]
            score = (sum(hit) + 1) / (len(hit) + 2) if hit else 0.5
            if score > best_score + 1e-9:
                best, best_score = rule[:end], score
        hit = [r[-1] for r in prune_rows if _covers(best, r)]
        if not best or not hit or sum(hit) < LEAST_PRECISION * len(hit):
            break
        rules.append([(names[k], up, x) for k, up, x in best])
        grow_rows = [r for r in grow_rows if not _covers(best, r)]
        prune_rows = [r for r in prune_rows if not _covers(best, r)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING_ROWS) -> list[Rule]:
    """Rules that reject, from labels (doc_id, quality): 0 is to be rejected."""
    some = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).where("_id is not null and _q is not null")
    some = some.orderBy(F.xxhash64("_id"), "_id", "_q").limit(most)
    known = features(docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")))  # at most `most` rows
    got = known.select("_id", *(F.expr(e).alias(n) for n, e in LEARNED.items()), (F.col("_q") == 0).cast("int").alias("bad")).collect()
    rows = [tuple(r)[1:] for r in sorted(got, key=lambda r: ((r[0] * 0x9E3779B1) & 0xFFFFFFFF, tuple(r)))]
    return cover(rows, list(LEARNED))


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional over the columns of features(): true keeps."""
    out = None
    for rule in rules:
        hit = F.lit(True)
        for name, up, x in rule:
            value = F.expr(LEARNED[name])
            hit = hit & ((value >= F.lit(x)) if up else (value < F.lit(x)))
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn(docs, labels)
    out = _inner(docs, "text").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with features(), base_failed and kept."""
    return _outer(docs, _judged(docs, labels), *COUNTS, "base_failed", "kept")


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns.

    The row number keeps the filter above the projections: pushed below, it
    would repeat their expressions many times over.
    """
    out = _judged(docs, labels).withColumn("_at", F.monotonically_increasing_id())
    return out.where(F.col("kept") & (F.col("_at") >= 0)).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
