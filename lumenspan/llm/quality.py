"""Quality rules whose cutoffs are certified on labelled holdouts.

Each rule rejects a document whose feature exceeds a cutoff. Cutoffs come from fixed
grids, not from data; labelled good documents only test them. For each rule and
stratum the grid is walked from the mildest cutoff on, and the walk goes on while the
exact (Clopper-Pearson) upper bound of the false rejection rate stays at or under the
rule's share of ``alpha``. A walk in fixed order needs no correction for its steps; the
walks of all rules and strata share ``delta`` by Bonferroni. So with probability
1 - delta every stratum's rules together reject at most ``alpha`` of its good documents.
A stratum with too few labels for shares of ``alpha`` is walked once instead, by all rules
together: each step tightens one rule, and what the rules reject between them is held
against the whole of ``alpha``. Which walk it is depends on the number of labels alone.
A stratum with too few labels for that as well gets no cutoff and keeps its documents.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, materialize

SYMBOLS = "[#*$%&|<>]"
#: Feature -> cutoffs from mild to strict. Shares of words, lines or characters.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_share": (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03),
    "repeat_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "dup_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "long_word": (30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0),
    "shout_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
}
#: Steps of the joint walk from mild to strict: (rule, its next cutoff); rules take turns by how far they are in their grids.
JOINT = tuple((r, g[i]) for _, r, g, i in sorted((i / len(g), r, g, i) for r, g in GRIDS.items() for i in range(len(g))))
MIN_WORDS, REPEAT_PERCENT = 50, 50
ALPHA, DELTA = 0.02, 0.05


def base_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_shouts of a whole text; zeros for null."""
    if not text:
        return (0,) * 6
    # bytes.split() parts at exactly the six ASCII white-space characters.
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS[1:-1]))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line in lines:
            dup += 1
        elif line.strip(" \t\v\f\r"):
            lines.add(line)
    grams = list(zip(words, words[1:], words[2:]))
    repeats = 0
    counts = Counter(grams)
    if len(counts) < len(grams):
        end = 0  # positions before it are counted
        for at, gram in enumerate(grams):
            if counts[gram] > 1:
                repeats += at + 3 - max(at, end)
                end = at + 3
    shouts = sum(w.isupper() and len(w) > 1 for w in words)
    return len(words), chars, symbols, dup, repeats, shouts


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, the columns in ``keep``, the counts of the whole text, its number of lines."""

    def make():
        def step(ids, texts, *kept):
            got = list(zip(*map(base_counts, texts), strict=True)) or [()] * len(COUNTS)
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            return {id_col: ids, "n_lines": lines} | dict(zip(COUNTS, got, strict=True)) | dict(zip(keep, kept, strict=True))

        return step

    schema = T.StructType([docs.schema[id_col], *[docs.schema[k] for k in keep]] + [T.StructField(c, T.LongType()) for c in (*COUNTS, "n_lines")])
    return map_rows(docs, [id_col, text_col, *keep], make, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))


def features() -> dict[str, F.Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "long_word": F.col("word_chars") / words,
        "shout_share": F.col("n_shouts") / words,
    }


def within_bound(k: int, n: int, alpha: float, delta: float) -> bool:
    """True if the exact upper bound at level delta of a rate seen k times of n is at most alpha: P(X <= k | n, alpha) <= delta."""
    if not n or k >= n:
        return False
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha) for i in range(k + 1)]
    top = max(log)
    return top + math.log(sum(math.exp(x - top) for x in log)) <= math.log(delta)


def certify(rejected: dict[tuple[str, str], list[int]], good: dict[str, int], alpha: float = ALPHA, delta: float = DELTA, joint: dict[str, list[int]] | None = None) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> strictest certified cutoff. ``rejected[stratum, rule][i]``: good documents above the rule's i-th cutoff; ``joint[stratum][i]``: those that the first i + 1 steps of JOINT reject."""
    walks = max(1, len(good) * len(GRIDS))
    out = {}
    for stratum, n in good.items():
        if joint and not within_bound(0, n, alpha / len(GRIDS), delta / walks):
            for (rule, cutoff), k in zip(JOINT, joint[stratum], strict=True):
                if not within_bound(k, n, alpha, delta / walks):
                    break
                out[stratum, rule] = cutoff
            continue
        for rule, grid in GRIDS.items():
            for cutoff, k in zip(grid, rejected[stratum, rule], strict=True):
                if not within_bound(k, n, alpha / len(GRIDS), delta / walks):
                    break
                out[stratum, rule] = cutoff
    return out


def first_step():
    """Number of the first step of JOINT that rejects a row; the number of steps if none does."""
    out = []
    for rule, value in features().items():
        when = F
        for i, (r, cutoff) in enumerate(JOINT):
            if r == rule:
                when = when.when(value > cutoff, i)
        out.append(when.otherwise(len(JOINT)))
    return F.least(*out)


def least_labels(alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Labelled good documents under which no bound at level ``delta`` reaches ``alpha``, even without a false rejection."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def fit(stats: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """Cutoffs from all labelled good rows of ``stats`` that pass the base rules (quality = 1; null labels take no part).

    A document labelled both 0 and 1 counts as good. Only counts reach the driver: one row
    per stratum with at least ``least_labels`` documents, whose tests the others don't
    share the risk of, as none of theirs could pass.
    """
    tests = features()
    good = labels.where("quality = 1").select(F.col(id_col).alias("_labelled")).distinct()
    held = stats.where(~base_failed()).join(good, F.col(id_col) == F.col("_labelled"), "left_semi").withColumn("_step", first_step())
    above = [F.count_if(tests[r] > c).alias(f"{r}_{i}") for r, grid in GRIDS.items() for i, c in enumerate(grid)]
    above += [F.count_if(F.col("_step") <= i).alias(f"joint_{i}") for i in range(len(JOINT))]
    counts = materialize(held.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")).agg(F.count("*").alias("n"), *above), "rule-counts")
    found = counts.where(F.col("n") >= least_labels(alpha, delta)).collect()
    return certify({(r["stratum"], rule): [r[f"{rule}_{i}"] for i in range(len(grid))] for r in found for rule, grid in GRIDS.items()}, {r["stratum"]: r["n"] for r in found}, alpha, delta, {r["stratum"]: [r[f"joint_{i}"] for i in range(len(JOINT))] for r in found})


def verdict(cutoffs: dict[tuple[str, str], float], stratum: str = "lang"):
    """True unless the base rules or a certified rule of the row's stratum reject it: a look-up of the stratum's cutoff for each rule."""
    own = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    over = F.lit(False)
    for rule, value in features().items():
        known = [F.lit(x) for (name, r), cutoff in cutoffs.items() if r == rule for x in (name, cutoff)]
        if known:
            over = over | F.coalesce(value > F.try_element_at(F.create_map(*known), own), F.lit(False))
    return ~base_failed() & ~over


def assess(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts, base_failed, kept.

    Null and empty texts have zero counts and fail the base rules. Rows with a null id
    or stratum are judged like others (null strata form one of their own); labels that
    repeat count once. Empty tables give no rows. Other columns are ignored.
    """
    stats = materialize(counted(docs, id_col, text_col, (stratum,)), "quality-counts")
    cutoffs = fit(stats, labels, stratum, id_col)
    return stats.select(id_col, *COUNTS[:5], base_failed().alias("base_failed"), verdict(cutoffs, stratum).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that ``assess`` rejects; all columns are kept. Each row is judged where it lies: texts aren't shuffled."""
    cutoffs = fit(counted(docs, id_col, text_col, (stratum,)), labels, stratum, id_col)
    own = docs.schema.fields
    mine = [f"_{i}" for i in range(len(own))]
    plain = docs.select(*[F.col(f.name).alias(m) for f, m in zip(own, mine, strict=True)])
    at = dict(zip([f.name for f in own], mine, strict=True))
    judged = counted(plain, at[id_col], at[text_col], tuple(m for m in mine if m != at[id_col]))
    kept = judged.where(verdict(cutoffs, at[stratum]))
    return kept.select(*[F.col(m).alias(f.name) for f, m in zip(own, mine, strict=True)])
