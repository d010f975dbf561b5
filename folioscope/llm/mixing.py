"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  Raking scales the cells in turn to
the source, language and topic marginals until all three hold.  A cell's raked share over
its present share is its weight; keep probabilities are the weights times one factor,
capped at one, with the factor chosen so that the expected tokens meet the budget.  A
document is sampled if a hash of its id, as a number in [0, 1), is below its probability,
so a rerun, or a rerun task, takes the same documents.

Targets: shares per value.  Values that a target does not name keep their present share,
and the named ones divide the rest in the given proportions; a margin without a target
takes the present shares tempered by a power below one (0.5 for source, 0.7 for language
and topic), which lifts small values.  ``TARGETS`` is what the query rakes to.

Topic: the form of a text by the share of its characters and lines that are code signs,
table cells, list items, digits or capitals; else prose.

Scale: one aggregation with map-side partial sums.  Up to ``max_cells`` cells are raked on
the driver.  More cells are dealt once by the margin with the most values; its factors
follow from the others' inside each task, so a round is a pass over the cells that sends
back one sum per value of the other two margins, and nothing is shuffled.  Both ways take
the same rounds, tolerance and targets.  Weights go back to the documents by a join on the
three columns; it is broadcast only when the cells are at most ``max_cells``.

Defined cases: null source or language is a value of its own; null and empty texts have
no tokens and take their cell's probability; a value without tokens cannot be lifted and
gets weight 1; if no value that is named occurs, all keep their present shares; rows with
equal id share one decision, those without an id by their text; other columns pass through
:func:`sample_mixture`, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import cut

MARGINS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET = 0.7
MAX_CELLS = 100_000
ROUNDS, TOLERANCE = 200, 1e-9


#: Raked to by default: shares of the languages and forms named, in proportion.
TARGETS = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": {"prose": 0.8, "list": 0.05, "table": 0.05, "code": 0.05, "figures": 0.03, "capitals": 0.02}}
#: Values that a margin may have while its factors are held on the driver.
NARROW = 1_000_000


def topic(text: str = "text") -> Column:
    """The form of a text: code, table, list, figures, capitals or prose (null and empty texts too)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size, lines = F.greatest(F.length(t), F.lit(1)), F.regexp_count(t, F.lit(r"\n")) + 1
    count = lambda p: F.regexp_count(t, F.lit(p))
    return (
        F.when(count(r"[{}();=<>\[\]]") * 25 >= size, "code")
        .when(count(r"(?md)^[^\n|\t]*[|\t][^\n]*$") * 2 >= lines, "table")
        .when((lines >= 3) & (count(r"(?md)^[ \t]*(?:[-*\u2022]|[0-9]{1,3}[.)])[ \t]") * 2 >= lines), "list")
        .when(count(r"[0-9]") * 5 >= size, "figures")
        .when(count(r"\p{Lu}") * 3 >= size, "capitals")
        .otherwise("prose")
    )


def n_tokens(text: str = "text") -> Column:
    """Words between ASCII white space, counted without building them."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_shares(present: Mapping[str | None, float], wanted: Mapping[str | None, float] | None, power: float) -> dict:
    """Shares that sum to one over the values that have tokens."""
    own = {k: v for k, v in present.items() if v > 0}
    total = sum(own.values())
    if wanted is None:
        raw = {k: v**power for k, v in own.items()}
        return {k: v / sum(raw.values()) for k, v in raw.items()}
    named = sum(wanted[k] for k in own if k in wanted)
    if named <= 0:
        return {k: v / total for k, v in own.items()}
    rest = sum(v for k, v in own.items() if k in wanted) / total
    return {k: wanted[k] / named * rest if k in wanted else v / total for k, v in own.items()}


def rake(tokens: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell shares whose marginals are the targets; codes[m, i] is the value of margin m in cell i."""
    share = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        worst = 0.0
        for m, target in enumerate(targets):
            now = np.bincount(codes[m], share, len(target))
            factor = np.divide(target, now, out=np.ones_like(target), where=now > 0)
            worst = max(worst, float(np.abs(now - target)[now > 0].max(initial=0.0)))
            share = share * factor[codes[m]]
        if worst < tolerance:
            break
    return share


def keep_probabilities(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """min(1, factor * weight), with expected tokens of budget times all tokens."""
    want = budget * tokens.sum()
    if want >= tokens[weight > 0].sum():
        return (weight > 0).astype(float)
    lo, hi = 0.0, 1.0
    while (tokens * np.minimum(1, hi * weight)).sum() < want:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        if (tokens * np.minimum(1, mid * weight)).sum() < want:
            lo = mid
        else:
            hi = mid
    return np.minimum(1, hi * weight)


def _on_driver(rows: list, targets: Mapping, budget: float, rounds: int = ROUNDS) -> list[tuple]:
    tokens = np.array([float(r.tokens) for r in rows])
    codes, wanted = [], []
    for m in MARGINS:
        values = sorted({r[m] for r in rows}, key=lambda v: (v is None, v))
        at = {v: i for i, v in enumerate(values)}
        code = np.array([at[r[m]] for r in rows], np.int64)
        present = dict(zip(values, np.bincount(code, tokens, len(values)).tolist()))
        shares = target_shares(present, targets.get(m), TEMPER[m]) if tokens.sum() > 0 else {}
        codes.append(code)
        wanted.append(np.array([shares.get(v, 0.0) for v in values]))
    if tokens.sum() > 0:
        share = rake(tokens, np.array(codes), wanted, rounds)
        weight = np.where(tokens > 0, share / np.maximum(tokens / tokens.sum(), 1e-300), 1.0)
    else:
        weight = np.ones(len(rows))
    keep = keep_probabilities(tokens, weight, budget) if len(rows) else weight
    return [(*(r[m] for m in MARGINS), float(w), float(p)) for r, w, p in zip(rows, weight, keep)]


def _distributed(cells: DataFrame, targets: Mapping, budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same raking over cells dealt by their widest margin; the other margins' factors are on the driver.

    A wide value's factor is its target over the sum of its cells, each times the factors
    of the others, so a pass needs only those: as they are now, and as they were when the
    wide margin was last met.
    """
    spark = cells.sparkSession
    cells = cut(cells)
    many = cells.agg(*(F.count_distinct(F.struct(m)).alias(m) for m in MARGINS), F.sum("tokens").alias("all")).first()
    total = float(many["all"] or 0)
    wide = max(MARGINS, key=lambda m: many[m])
    narrow = [m for m in MARGINS if m != wide]
    if max(many[m] for m in narrow) > NARROW:
        raise ValueError(f"two margins have more than {NARROW} values: {many.asDict()}")
    factors, goals, values = {}, {}, {}
    for m in narrow:
        rows = sorted(cells.groupBy(m).agg(F.sum("tokens").alias("t")).collect(), key=lambda r: (r[0] is None, r[0]))
        values[m] = [r[0] for r in rows]
        shares = target_shares({r[0]: float(r["t"]) for r in rows}, targets.get(m), TEMPER[m]) if total else {}
        goals[m], factors[m] = np.array([shares.get(v, 0.0) for v in values[m]]), np.ones(len(rows))
        codes = spark.createDataFrame([(v, i) for i, v in enumerate(values[m])], f"v_{m} string, c_{m} int")
        cells = cells.join(F.broadcast(codes), F.col(m).eqNullSafe(F.col(f"v_{m}")))
    own = cut(cells.select(F.col(wide).alias("w"), *(f"c_{m}" for m in narrow), F.col("tokens").cast("double").alias("tokens")).repartition("w"))

    # what the wide margin's targets divide by
    sums = own.groupBy("w").agg(F.sum("tokens").alias("t")).filter("t > 0")
    wanted = targets.get(wide)
    tempered, named, rest = 0.0, 0.0, 0.0
    if wanted is None:
        tempered = float(sums.agg(F.sum(F.pow("t", F.lit(TEMPER[wide])))).first()[0] or 0)
    else:
        given = F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in wanted.items()], "k string, given double"))
        got = sums.join(given, F.col("w").eqNullSafe(F.col("k"))).agg(F.sum("given"), F.sum("t")).first()
        named, rest = float(got[0] or 0), float(got[1] or 0) / (total or 1.0)

    def wide_goal(value: str | None, tokens: float) -> float:
        if wanted is None:
            return tokens ** TEMPER[wide] / tempered if tempered else 0.0
        if named > 0 and value in wanted:
            return wanted[value] / named * rest
        return tokens / (total or 1.0)

    def shares_of(batches: Iterator[pa.RecordBatch], now: list[np.ndarray], met: list[np.ndarray] | None) -> tuple | None:
        held = [b for b in batches if b.num_rows]
        if not held:
            return None
        table = pa.Table.from_batches(held)
        coded = pc.dictionary_encode(table.column("w").combine_chunks(), null_encoding="encode")
        group, (c1, c2, tokens) = coded.indices.to_numpy(), (table.column(k).to_numpy() for k in (1, 2, 3))
        size = len(coded.dictionary)
        t = np.bincount(group, tokens, size)
        goal = np.array([wide_goal(v, x) if x > 0 else 0.0 for v, x in zip(coded.dictionary.to_pylist(), t)])
        if met is None:  # before the wide margin was met: the present shares
            factor = np.full(size, 1 / (total or 1.0))
        else:
            then = np.bincount(group, tokens * met[0][c1] * met[1][c2], size)
            factor = np.divide(goal, then, out=np.full(size, 1 / (total or 1.0)), where=then > 0)
        return table, group, goal, (c1, c2), tokens, factor[group] * tokens * now[0][c1] * now[1][c2]

    def sums_by(margin: str, met: list[np.ndarray] | None) -> np.ndarray:
        """Present sums of a narrow margin, or (of the wide one) how far the worst value is off."""
        now = [factors[m] for m in narrow]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if (found := shares_of(batches, now, met)) is not None:
                _, group, goal, codes, _, share = found
                if margin == wide:
                    sums = np.bincount(group, share, len(goal))
                    got = np.array([np.abs(sums - goal)[sums > 0].max(initial=0.0)])
                else:
                    k = narrow.index(margin)
                    got = np.bincount(codes[k], share, len(now[k]))
                yield pa.record_batch([pa.array([got.tolist()], pa.list_(pa.float64()))], names=["sums"])

        parts = [r[0] for r in own.mapInArrow(run, "sums array<double>").collect()]
        return np.max(parts, axis=0) if margin == wide and parts else np.sum(parts, axis=0) if parts else np.zeros(1)

    met: list[np.ndarray] | None = None
    for _ in range(rounds if total else 0):
        worst = 0.0
        for m in MARGINS:
            if m == wide:
                worst = max(worst, float(sums_by(m, met)[0]))
                met = [factors[x].copy() for x in narrow]
            else:
                now = sums_by(m, met)
                worst = max(worst, float(np.abs(now - goals[m])[now > 0].max(initial=0.0)))
                factors[m] = factors[m] * np.divide(goals[m], now, out=np.ones_like(now), where=now > 0)
        if worst < tolerance:
            break

    last = [factors[m] for m in narrow]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := shares_of(batches, last, met)) is not None:
            table, _, _, codes, tokens, share = found
            weight = np.divide(share * total, tokens, out=np.ones_like(tokens), where=tokens > 0)
            known = [pa.array([values[m][c] for c in code], pa.string()) for m, code in zip(narrow, codes)]
            yield pa.record_batch([table.column("w").combine_chunks(), *known, pa.array(tokens), pa.array(weight)], names=[wide, *narrow, "tokens", "weight"])

    own = cut(own.mapInArrow(weigh, f"{wide} string, {narrow[0]} string, {narrow[1]} string, tokens double, weight double"))
    lo, hi, want = 0.0, float(2**40), budget * total
    if want >= float(own.filter("weight > 0").agg(F.sum("tokens")).first()[0] or 0):
        return own.select(*MARGINS, "weight", (F.col("weight") > 0).cast("double").alias("probability"))
    while float(own.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(hi) * F.col("weight")))).first()[0] or 0) < want:
        hi *= 2.0**40
    for _ in range(12):
        # expected tokens at 64 factors in one aggregation narrow the bracket 65-fold
        grid = [lo + (hi - lo) * k / 65 for k in range(1, 65)] if lo > 0 else [hi * 2.0 ** (k - 65) for k in range(1, 65)]
        got = own.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(f) * F.col("weight"))).alias(f"e{i}") for i, f in enumerate(grid))).first()
        below = [f for f, e in zip(grid, got) if (e or 0) < want]
        lo, hi = (below[-1] if below else lo), next((f for f, e in zip(grid, got) if (e or 0) >= want), hi)
    return own.select(*MARGINS, "weight", F.least(F.lit(1.0), F.lit(hi) * F.col("weight")).alias("probability"))


def _cell_columns(docs: DataFrame) -> list[Column]:
    return [docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), topic("text").alias("topic")]


def source_cells(docs: DataFrame) -> DataFrame:
    """Documents and tokens of each cell (source, language, topic)."""
    rows = docs.select(*_cell_columns(docs), n_tokens().alias("n_tokens"))
    return rows.groupBy(*MARGINS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))


def _chance(docs: DataFrame, seed: int) -> Column:
    """A number in [0, 1) by the id, or by the text where there is no id."""
    own = docs["doc_id"].cast("long")
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), own, F.when(own.isNull(), docs["text"])), 11) / F.lit(float(1 << 53))


def _with_weights(rows: DataFrame, cells: DataFrame, targets: Mapping | None, budget: float, max_cells: int) -> DataFrame:
    """rows (which have the cell columns and chance) with weight, probability and sampled."""
    targets = targets or {}
    first = cells.limit(max_cells + 1).collect()
    if len(first) <= max_cells:
        made = F.broadcast(rows.sparkSession.createDataFrame(_on_driver(first, targets, budget), "source string, lang string, topic string, weight double, probability double"))
    else:
        made = _distributed(cells, targets, budget)
    made = made.select(*(F.col(m).alias(f"cell_{m}") for m in MARGINS), "weight", "probability")
    same = [F.col(m).eqNullSafe(F.col(f"cell_{m}")) for m in MARGINS]
    return rows.join(made, same[0] & same[1] & same[2], "left").withColumn("sampled", F.col("chance") < F.col("probability"))


def mix_sources(docs: DataFrame, *, targets: Mapping[str, Mapping] | None = None, budget: float = BUDGET, seed: int = 17, max_cells: int = MAX_CELLS) -> DataFrame:
    """Per document row: doc_id, its cell and tokens, its weight and probability, and whether it is sampled."""
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_cell_columns(docs), n_tokens().alias("n_tokens"), _chance(docs, seed).alias("chance")))
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    return _with_weights(rows, cells, targets, budget, max_cells).select("doc_id", *MARGINS, "n_tokens", "weight", "probability", "sampled")


def sample_mixture(docs: DataFrame, *, targets: Mapping[str, Mapping] | None = None, budget: float = BUDGET, seed: int = 17, max_cells: int = MAX_CELLS) -> DataFrame:
    """The sampled document rows with all their columns, whatever their names; no shuffle of texts."""
    cells = docs.select(*_cell_columns(docs), n_tokens().alias("n_tokens")).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("document"), *_cell_columns(docs), _chance(docs, seed).alias("chance"))
    return _with_weights(rows, cells, targets, budget, max_cells).filter("sampled").select("document.*")
