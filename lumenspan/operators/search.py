"""Full-text search: matching, BM25, boosts, files from chunks (FTS2-FTS15, AGG4, AGG6, AGG24, JN1, JN2, JN9, TOP1, TOP2).

A chunk's terms are an array column, so atoms are matched and counted row by row inside
the scan: no posting is shuffled for a query. Corpus statistics are one row of sums.
``lumenspan.operators.index`` holds the stored form, where a query reads only blocks of
its own terms.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.query import All, Any, Atom, Query, atoms, parse
from ..functions.text import porter_terms

#: Column, weight in the rank, bit of the match source.
COLUMNS = (("text", 1.0, 2), ("filename", 3.0, 1), ("folder_path", 1.0, 4))
K1, B = 1.2, 0.75
MOST_CANDIDATES = 600


@dataclass(frozen=True)
class Options:
    """SearchOptions; filter_stage tells whether extensions are filtered before or after the best are taken (Q2)."""

    top: int = 20
    per_file: int = 1
    extensions: tuple[str, ...] = ()
    filter_stage: str = "post"
    tokenizer: str = "porter"


def with_terms(chunks: DataFrame, tokenizer: str = "porter") -> DataFrame:
    """FTS1: adds the terms of each indexed column as arrays ``_text``, ``_filename``, ``_folder_path``.

    They come out of a one-row generator, so the optimizer doesn't copy the tokenizer
    into every expression (and every lambda) that reads them.
    """
    split = F.struct(*[X.terms(F.col(c), tokenizer).alias(f"_{c}") for c, _, _ in COLUMNS])
    return chunks.select("*", F.inline(F.array(split)))


def _atom_terms(atom: Atom, tokenizer: str) -> list[str]:
    if tokenizer == "porter":
        return porter_terms(atom.text)
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", atom.text.lower())


def occurrences(terms: Column, atom: Atom, tokenizer: str = "porter") -> Column:
    """FTS2, FTS3: how often an atom's consecutive terms occur in an array of terms, the last one as a prefix if the atom says so."""
    parts = _atom_terms(atom, tokenizer)
    if not parts:
        return F.lit(0)

    def fits(t: Column, k: int) -> Column:
        return t.startswith(parts[k]) if atom.prefix and k == len(parts) - 1 else t == parts[k]

    if len(parts) == 1:
        return F.size(F.filter(terms, lambda t: fits(t, 0)))
    spots = F.sequence(F.lit(0), F.size(terms) - len(parts))
    found = F.filter(spots, lambda i: reduce(lambda a, b: a & b, [fits(F.get(terms, i + k), k) for k in range(len(parts))]))
    return F.when(F.size(terms) >= len(parts), F.size(found)).otherwise(0)


def matches(query: Query, hit: dict[Atom, Column]) -> Column:
    """FTS4: the boolean expression over "atom occurs"."""
    if isinstance(query, Atom):
        return hit[query]
    parts = [matches(p, hit) for p in query.parts]
    return reduce((lambda a, b: a & b) if isinstance(query, All) else (lambda a, b: a | b), parts)


def bm25(chunks: DataFrame, query: Query, tokenizer: str = "porter") -> DataFrame:
    """FTS5-FTS7, AGG24: matching chunks with ``bm25`` and ``match_source`` (1 name, 2 content, 4 folder; content if none).

    Inverse document frequencies are floored at 1e-6, lengths count the terms of all columns.
    """
    asked = atoms(query)
    rows = with_terms(chunks, tokenizer)
    counts = {(i, c): occurrences(F.col(f"_{c}"), a, tokenizer) for i, a in enumerate(asked) for c, _, _ in COLUMNS}
    rows = rows.select(*chunks.columns, reduce(lambda a, b: a + b, [F.size(f"_{c}") for c, _, _ in COLUMNS]).alias("_long"), *[v.alias(f"_n{i}_{c}") for (i, c), v in counts.items()])
    hit = [reduce(lambda a, b: a | b, [F.col(f"_n{i}_{c}") > 0 for c, _, _ in COLUMNS]) for i in range(len(asked))]
    corpus = rows.agg(F.count("*").alias("_rows"), F.avg("_long").alias("_average"), *[F.count_if(h).alias(f"_df{i}") for i, h in enumerate(hit)])
    found = rows.where(matches(query, dict(zip(asked, hit, strict=True)))).crossJoin(F.broadcast(corpus))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(asked)):
        f = reduce(lambda a, b: a + b, [F.col(f"_n{i}_{c}") * w for c, w, _ in COLUMNS])
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_rows") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_long") / F.col("_average")))
    source = reduce(lambda a, b: a.bitwiseOR(b), [F.when(reduce(lambda a, b: a | b, [F.col(f"_n{i}_{c}") > 0 for i in range(len(asked))]), bit).otherwise(0) for c, _, bit in COLUMNS])
    return found.select(*chunks.columns, score.alias("bm25"), F.when(source == 0, 2).otherwise(source).alias("match_source"))


def match_counts(chunks: DataFrame, query: Query, files: DataFrame, tokenizer: str = "porter") -> DataFrame:
    """AGG4, JN2: per file of ``files`` (file_id), matching chunks and the first one's index."""
    rows = with_terms(chunks.join(files.select("file_id"), "file_id", "left_semi"), tokenizer)
    hit = {a: reduce(lambda p, q: p | q, [occurrences(F.col(f"_{c}"), a, tokenizer) > 0 for c, _, _ in COLUMNS]) for a in atoms(query)}
    return rows.where(matches(query, hit)).groupBy("file_id").agg(F.count("*").alias("match_count"), F.min("chunk_index").alias("first_match"))


def score_hits(scored: DataFrame, files: DataFrame, words: list[str], as_of: Column, boosts: DataFrame | None = None) -> DataFrame:
    """JN1, JN9, FTS10: candidates with file columns and the final ``score``.

    bm25 x recency x extension x (1 + click boost), and a half more if a query word
    stands in the file name by itself. ``boosts`` (path_key, click_boost) is joined on
    the normalised path on both sides (Q1). Candidates are few, so they go to the files.
    """
    own = files.select("file_id", "path", "extension", "modified_at", F.col("filename").alias("_name"))
    out = own.join(F.broadcast(scored) if getattr(scored, "_candidates_bounded", False) else scored, "file_id")
    out = out.withColumn("path_key", X.click_path(F.col("path")))
    if boosts is not None:
        out = out.join(boosts, "path_key", "left").withColumn("click_boost", F.coalesce("click_boost", F.lit(0.0)))
    else:
        out = out.withColumn("click_boost", F.lit(0.0))
    named = reduce(lambda a, b: a | b, [X.word_boundary_match(F.col("_name"), w) for w in words], F.lit(False))
    rank = F.col("bm25") * X.recency_boost(F.col("modified_at"), as_of) * X.extension_boost(F.col("extension")) * (1 + F.col("click_boost"))
    return out.withColumn("score", rank + F.when(named, 0.5).otherwise(0.0)).drop("_name", "path_key")


def most_candidates(options: Options) -> int:
    return min(options.top * options.per_file * 3, MOST_CANDIDATES)


def candidates(scored: DataFrame, options: Options) -> DataFrame:
    """TOP1: the best chunks by bm25, at most 600; ties by chunk id (Q26). A stored index finds them without scoring all (``Index.top``)."""
    out = scored.orderBy(F.desc("bm25"), "chunk_id").limit(most_candidates(options))
    out._candidates_bounded = True
    return out


def best_per_file(hits: DataFrame, options: Options) -> DataFrame:
    """AGG6, TOP2, FLT11: each file's best chunk, the best files of those."""
    best = Window.partitionBy("file_id").orderBy(F.desc("score"), F.desc("bm25"), "chunk_id")
    ext = F.lower(F.col("extension")).isin([e.lower() for e in options.extensions])
    if options.extensions and options.filter_stage == "pre":
        hits = hits.where(ext)
    out = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").orderBy(F.desc("score"), "file_id").limit(options.top)
    return out.where(ext) if options.extensions and options.filter_stage == "post" else out


def search(chunks, files: DataFrame, text: str, as_of: Column, options: Options = Options(), boosts: DataFrame | None = None) -> DataFrame:
    """The whole keyword search: best files for a query in words; no rows for a query without any.

    ``chunks`` is a stored index, of which only the query's terms are read, or a table
    of chunks, which is scanned.
    """
    from ..functions.query import is_stop, tokens

    query = parse(text)
    if query is None:
        query = Any((Atom(""), Atom("")))
    if isinstance(chunks, DataFrame):
        found = candidates(bm25(chunks, query, options.tokenizer), options)
    else:
        found = chunks.top(query, most_candidates(options))
    plain = [t for t in tokens(text or "") if not is_stop(t)]
    return best_per_file(score_hits(found, files, plain, as_of, boosts), options)


def filename_matches(files: DataFrame, token: str, limit: int = 20, tokenizer: str = "porter") -> DataFrame:
    """FTS8, JN7: files whose name, path or extension holds a term that starts so; single words that are Korean or of four letters and more only, else by LIKE."""
    from ..functions.query import has_korean
    from .catalogue import filename_search

    if " " in token.strip() or not (has_korean(token) or len(token) >= 4):
        return filename_search(files, token.split(), limit)
    atom = Atom(token, True)
    hit = reduce(lambda a, b: a | b, [occurrences(X.terms(F.col(c), tokenizer), atom, tokenizer) > 0 for c in ("filename", "path", "extension")])
    indexed = files.where(hit)
    none = indexed.agg((F.count("*") == 0).alias("_none"))
    like = filename_search(files, [token], limit).crossJoin(F.broadcast(none)).where("_none").drop("_none")  # one row
    return indexed.unionByName(like).orderBy(F.desc("modified_at"), "path").limit(limit)
